"""Operator 3: document rates whose expected domain tokens match target weights.

Built-in functions only.  A classifier (multinomial over ``CELLS`` hashed distinct words) is fitted on
about ``per_domain`` rows of each domain of a labelled table, the bound of the sample; it gives every
document a posterior over the domains, softened to the evidence of ``SOFT_WORDS`` words.  Rates start
at 1 and follow projected gradient steps of the least squares between expected domain tokens and
targets: the gradient by a document's rate, for each of its tokens, is its posterior times the gap; it is
scaled by domain, taken with the step length that is best on the documents of positive rate, and the rate
cut off at 0.  Each step is one distributed aggregate of a few sums.  The state of the fit is the list of
steps, so a rate is a function of a document's posterior alone and nothing is joined.  A fit whose largest
gap stays above ``tolerance`` of all tokens after ``most_steps`` warns and returns its best step.

A token is a word here (a run without ASCII white space).

Edge cases: null and empty texts have no tokens and the prior's posterior; without labelled rows all
rates are 1; domains without a labelled row are left out and the other targets scaled up; labelled
domains without a target are fitted as one domain ``REST`` of weight 0, so their documents get rates near 0;
targets that no rates reach are met as nearly as the steps get; repeated rows are separate documents, whose
rates are equal; label rows without a document, or repeated, change only the prior's weights; an empty
table gives no rows; other columns, whatever their names, are ignored (``mix`` keeps them).
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, materialize, words_of

CELLS = 1 << 11
SOFT_WORDS = 40
#: The domain of labelled rows without a target.
REST = "(no target)"
#: Logarithms are kept in thousandths.
SCALE = 1000

#: Targets of the query and the pipeline: the share of tokens of each language and quality.
TARGETS = {"en/1": 0.42, "de/1": 0.18, "fr/1": 0.18, "es/1": 0.14, "en/0": 0.03, "de/0": 0.02, "fr/0": 0.02, "es/0": 0.01}


def _cells(text: Column) -> Column:
    return F.transform(F.array_distinct(words_of(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(CELLS)).cast("int"))


@dataclass
class DomainModel:
    domains: list[str]
    prior: list[float] = field(default_factory=list)
    #: thousandths of log shares, CELLS for each domain after the other
    table: list[int] = field(default_factory=list)

    def posterior(self, text: Column) -> Column:
        """One expression that holds the text and the table once each, however many domains there are."""
        k = len(self.domains)
        values = F.split(F.lit(",".join(map(str, self.table))), ",").cast("array<int>")

        def soft(values: Column, cells: Column) -> Column:
            n = F.greatest(F.lit(1), F.size(cells))
            scale = F.least(F.lit(1.0), F.lit(float(SOFT_WORDS)) / n) / SCALE

            def total(d: int) -> Column:
                return F.aggregate(cells, F.lit(0).cast("long"), lambda a, c: a + F.get(values, c + d * CELLS))

            return F.array(*(F.lit(self.prior[d]) + total(d) * scale for d in range(k)))

        def normal(z: Column) -> Column:
            e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
            return let(e, lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x)))

        return let(let(values, lambda v: let(_cells(text), lambda c: soft(v, c))), normal)


def fit_domains(docs: DataFrame, labelled: DataFrame, per_domain: int = 1500) -> DomainModel:
    """``labelled``: doc_id, domain.  At most ``CELLS`` rows for each domain reach the driver."""
    labelled = labelled.filter(F.col("doc_id").isNotNull() & F.col("domain").isNotNull())
    sizes = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return DomainModel([])
    domains = sorted(sizes)
    share = F.create_map(*[F.lit(x) for d in domains for x in (d, min(1.0, per_domain / sizes[d]))])
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("domain")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = labelled.filter(u < share[F.col("domain")])  # about per_domain rows of each, so it may be broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn.dropDuplicates(["doc_id", "domain"])), "doc_id")
    counts = sample.select("domain", F.explode(_cells(F.col("text"))).alias("cell")).groupBy("domain", "cell").agg(F.count(F.lit(1)).alias("n")).collect()
    m = np.ones((len(domains), CELLS))
    for r in counts:
        m[domains.index(r["domain"]), r["cell"]] += r["n"]
    logs = np.log(m / m.sum(axis=1, keepdims=True))
    total = sum(sizes.values())
    return DomainModel(domains, [float(np.log(sizes[d] / total)) for d in domains], [int(v) for v in np.rint(SCALE * logs).ravel()])


def rate(posterior: Column, steps: list[list[float]]) -> Column:
    """The rate after ``steps``: from 1, each step taken along the posterior and cut off at 0."""
    if not steps:
        return F.lit(1.0)
    taken = F.array(*(F.array(*(F.lit(float(x)) for x in s)) for s in steps))
    dot = lambda d: reduce(lambda a, b: a + b, [F.get(posterior, F.lit(k)) * F.get(d, F.lit(k)) for k in range(len(steps[0]))])
    return F.aggregate(taken, F.lit(1.0), lambda r, d: F.greatest(F.lit(0.0), r - dot(d)))


def gradient_step(gap: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The step down the gradient of half the squared ``gap``, scaled by domain and of the best length where ``g`` holds.

    ``g``: the sums of tokens times the products of two posteriors, over the documents that can move.
    """
    d = gap / np.maximum(np.diag(g), 1e-9 * max(1.0, float(np.trace(g))))
    moved = g @ d
    return d * (gap @ moved) / max(float(moved @ moved), 1e-30)


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], tolerance: float = 1e-4, most_steps: int = 30) -> list[list[float]]:
    """Steps of the fit over ``members`` (n_tokens, posterior)."""
    k = len(domains)
    weights = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    if k == 0 or weights.sum() <= 0:
        return []
    weights = weights / weights.sum()
    steps: list[list[float]] = []
    at = [(i, j) for i in range(k) for j in range(i, k)]
    best, best_error = steps, np.inf
    for _ in range(most_steps + 1):
        rows = members.select("n_tokens", "posterior", rate(F.col("posterior"), steps).alias("rate"))
        p = [F.get(F.col("posterior"), F.lit(i)) for i in range(k)]
        moved = F.col("n_tokens") * F.col("rate")
        free = F.when(F.col("rate") > 0, F.col("n_tokens")).otherwise(F.lit(0))
        sums = rows.agg(F.sum("n_tokens").alias("t"), *(F.sum(moved * p[i]).alias(f"m{i}") for i in range(k)), *(F.sum(free * p[i] * p[j]).alias(f"g{i}_{j}") for i, j in at)).first()
        total = float(sums["t"] or 0)
        if total <= 0:
            return []
        gap = np.array([float(sums[f"m{i}"]) for i in range(k)]) - weights * total
        error = float(np.abs(gap).max() / total)
        if error < best_error:
            best, best_error = list(steps), error
        if error <= tolerance:
            return best
        g = np.zeros((k, k))
        for i, j in at:
            g[i, j] = g[j, i] = float(sums[f"g{i}_{j}"])
        steps = [*steps, [float(x) for x in gradient_step(gap, g)]]
    warnings.warn(f"rates miss a target by {best_error:.2%} of all tokens after {most_steps} steps", stacklevel=2)
    return best


def fit_mixture(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, per_domain: int = 1500) -> tuple[DomainModel, list[list[float]], DataFrame, str]:
    """The classifier, the steps, and ``docs`` with a struct (n_tokens, posterior) in a new column, written; and its name."""
    targets = TARGETS if targets is None else targets
    model = fit_domains(docs, labelled.select("doc_id", F.when(F.col("domain").isNull() | F.col("domain").isin(*targets), F.col("domain")).otherwise(F.lit(REST)).alias("domain")), per_domain)
    tokens = F.size(words_of(F.col("text"))).cast("long").alias("n_tokens")
    posterior = (model.posterior(F.col("text")) if model.domains else F.array().cast("array<double>")).alias("posterior")
    (name,) = fresh(docs, "mixture")
    members = materialize(docs.withColumn(name, F.struct(tokens, posterior)))
    return model, fit_rates(members.select(f"{name}.*"), model.domains, targets), members, name


def document_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, per_domain: int = 1500) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), posterior, rate."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model, steps, members, name = fit_mixture(rows, labelled, targets, per_domain)
    names = F.array(*(F.lit(d) for d in model.domains)).cast("array<string>")
    likeliest = F.get(names, (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int"))
    return members.select("doc_id", f"{name}.*").select("doc_id", "n_tokens", likeliest.alias("domain"), "posterior", rate(F.col("posterior"), steps).alias("rate"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, per_domain: int = 1500) -> DataFrame:
    """``docs`` with each row as often as its rate says: the whole part, and once more with the odds of the rest.

    The odds are drawn by a hash of doc_id and text, so equal rows come equally often, and a run can be repeated.
    """
    _, steps, members, name = fit_mixture(docs, labelled, targets, per_domain)
    if not steps:
        return docs
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = let(F.col(name)["posterior"], lambda p: F.floor(rate(p, steps) + u).cast("int"))
    return members.withColumn(name, F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)
