"""Operator 13: documents whose sets of word shingles are near, by compressed MinHash registers.

1. A set's hashes fall into ``BUCKETS`` buckets.  Of the least hash in a bucket its register keeps the number of
   leading zeros and the ``MANTISSA`` bits behind the first one (HyperMinHash): two bytes a bucket, 0 for an empty one.
   Equal sets are one class (64-bit hash of the set).
2. ``BAND`` neighbouring registers are a band; classes that agree in a band that isn't empty are candidates.  Two sets at
   85 % agree in a bucket with a probability of 0.85 or more (empty ones agree), so all 42 bands miss such a
   pair about twice in 10^9.
3. Registers of candidates are compared whole: those that agree, less those that sets of these sizes have equal by
   chance, over those that aren't empty, estimate the similarity.  Pairs that are ``SIGMAS`` deviations below
   the threshold go.  Before, sizes and the parities of hash cells, which bound how much two sets differ, drop pairs
   where they meet in a list.
4. The others are verified exactly on their whole sets; ``linkage`` keeps large groups from becoming all pairs.

Edge cases: null, empty and white-space texts have no shingle, are linked with nothing, are their own component and are
kept; fewer words than a shingle make one shingle of all words; repeated rows are equal sets, and each row that has
the component's id is kept; a null doc_id is never a component's id if there is another, and kept only if there is none;
an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, arrow_column, arrow_map, materialize, mix, release, settled, written
from .jaccard_join import PARITY_WORDS, set_key, shingle_set, with_component
from .linkage import LIGHT, chosen_sets, linked, parity, set_verifier

#: Registers of a band, and of a set.
BAND = 6
BUCKETS = 42 * BAND
MANTISSA = 10
#: How far below the threshold, in deviations of the estimate, a pair is still verified; with fewer registers it always is.
SIGMAS, LEAST_REGISTERS = 6.0, 30
#: Orders that leaders of long lists are drawn by: one, so that the many lists of a group mostly have the same leader.
ORDERS = 1


def registers(h: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit hashes."""
    v = mix(h ^ np.uint64(0x5851F42D4C957F2D))
    bucket = ((v >> np.uint64(32)) * np.uint64(BUCKETS) >> np.uint64(32)).astype(np.int64)
    least = np.full(BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bucket, mix(v))
    # 53 bits are exact as a double, whose exponent counts the zeros
    share, exponent = np.frexp(np.maximum(least >> np.uint64(11), np.uint64(1)).astype(np.float64))
    zeros = np.minimum(53 - exponent, 62)
    out = (zeros + 1) << MANTISSA | ((share * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    return np.where(np.bincount(bucket, minlength=BUCKETS) > 0, out, 0).astype("<u2")


def chance_equal(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers that two sets of n and m with nothing in common are expected to have equal.

    Least hashes of n in a bucket are about exponential; both must fall into one cell of the register, of
    which those with k leading zeros have the width 2 ** -(k + 1 + MANTISSA).
    """
    a, b = n[:, None] / BUCKETS, m[:, None] / BUCKETS
    top = 2.0 ** -np.arange(53)
    both = np.exp(-(a + b) * top / 2) - np.exp(-(a + b) * top)
    return BUCKETS * (a * b / (a + b) * both * top / 2 / (1 << MANTISSA)).sum(1)


def likeness(n, m, x: list[bytes], y: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the similarity of sets of n and m from their registers, and how many registers each rests on."""
    p, q = (np.frombuffer(b"".join(r), "<u2").reshape(-1, BUCKETS) for r in (x, y))
    full = ((p > 0) | (q > 0)).sum(1)
    equal = ((p == q) & (p > 0)).sum(1)
    chance = chance_equal(np.asarray(n, float), np.asarray(m, float))
    return np.clip((equal - chance) / np.maximum(full - chance, 1e-9), 0.0, 1.0), full


def promising(percent: int):
    """A column of two sizes and registers: whether the estimate leaves it open that the similarity is reached."""

    def start():
        least = percent / 100

        def step(n, m, x, y):
            if not n:
                return []
            about, full = likeness(n, m, x, y)
            return list((full < LEAST_REGISTERS) | (about >= least - SIGMAS * np.sqrt(least * (1 - least) / np.maximum(full, 1))))

        return step

    return arrow_column("boolean", start)


def register_table(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, th (hash of the text), k (class), n (set size), bits (parity of the set) and regs of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")

    def start():
        cache = WordHashes()

        def step(ids, hashes, texts):
            out: list[list] = [ids, hashes, [], [], [], []]
            for t in texts:
                h = shingle_set(t, width, cache)
                regs = registers(h) if len(h) else None
                for column, value in zip(out[2:], (None, 0, None, None) if regs is None else (set_key(h), len(h), parity(h, PARITY_WORDS), regs.tobytes()), strict=True):
                    column.append(value)
            return out

        return step

    return arrow_map(rows, "doc_id long, th long, k long, n int, bits array<long>, regs binary", start)


def bands(classes: DataFrame) -> DataFrame:
    """k, n and s (hash of a band) for each band of a class that isn't empty."""
    size = 2 * BAND
    part = lambda b: F.substring("regs", b * size + 1, size)
    keys = [F.when(part(b) != F.lit(bytes(size)), F.xxhash64(F.lit(b), part(b))) for b in range(BUCKETS // BAND)]
    return classes.select("k", "n", F.explode(F.array_compact(F.array(*keys))).alias("s"))


def counted_lists(postings: DataFrame, payload: list[str], orders: int, rank: str | None = None) -> DataFrame:
    """Like ``linkage.shared_lists``, but keys are counted first, so that most postings go before they are dealt and a join may split a long list."""
    counts = postings.groupBy("s").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    shared = materialize(postings.join(counts, "s").select("s", "m", "k", *payload))
    order = F.struct(F.xxhash64("k", F.pmod("s", F.lit(orders))).alias("h"))
    heavy = shared.filter(F.col("m") > LIGHT)
    leads = heavy.groupBy("s").agg(F.min(F.struct(order.alias("r"), "k", *payload)).alias("lead"))
    light = shared.filter(F.col("m") <= LIGHT).withColumn("lead", F.lit(None).cast(leads.schema["lead"].dataType))
    return heavy.join(leads, "s").unionByName(light)


def _keep(percent: int):
    return lambda x, y: F.least(x("n"), y("n")) * 100 >= F.greatest(x("n"), y("n")) * percent


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    of = lambda c: classes.select(F.col("k").alias(c), F.struct("n", "regs").alias(f"{c}_x"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    near: Column = promising(percent)(F.col("a_x.n"), F.col("b_x.n"), F.col("a_x.regs"), F.col("b_x.regs"))
    return met.filter(near).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``."""
    spark = docs.sparkSession

    def sets_in():
        cache = WordHashes()

        def of(texts):
            for t in texts:
                h = shingle_set(t, width, cache)
                if len(h):
                    yield set_key(h), lambda h=h: h

        return of

    def build() -> DataFrame:
        whole, spent = written(register_table(docs, width))
        table, sets = materialize(whole.select("doc_id", "th", "k", "n")), whole.filter(F.col("k").isNotNull())
        classes = materialize(sets.groupBy("k").agg(F.min(F.struct("n", "bits", "regs")).alias("x")).select("k", "x.*"))
        release(spark, [spent])
        homes = table.filter(F.col("k").isNotNull()).select("k", "th")
        exact = set_verifier(lambda ids: chosen_sets(docs, ids, homes, sets_in), percent)
        verify = lambda pairs: exact(materialize(_estimated(pairs, classes, percent)))
        _, label = linked(bands(classes), ["n"], _keep(percent), verify, ORDERS, classes.select("k", "n", "bits"), percent, PARITY_WORDS, lists=counted_lists)
        rows = materialize(with_component(table.select("doc_id", "k", "n"), label))
        first = rows.filter(F.col("c").isNotNull()).groupBy("c").agg(F.min("doc_id").alias("first"))
        out = rows.join(first, "c", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("component_id"))
        return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

    return settled(spark, build)


def components_sql(width: int, percent: int, more: str = "") -> str:
    """The same rows in DuckDB's SQL: pairs of sets that share one of their rarest shingles are compared whole."""
    run = " || ' ' || ".join(["t", *(f"lead(t, {k}) OVER o" for k in range(1, width))])
    return f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
u AS (SELECT r, {run} AS t FROM (SELECT r, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM w WHERE len(w) >= {width}) WINDOW o AS (PARTITION BY r ORDER BY i)),
y AS (SELECT r, list_sort(list(DISTINCT hash(t))) AS x FROM u WHERE t IS NOT NULL GROUP BY r),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [hash(array_to_string(w, ' '))] ELSE x END AS x FROM w LEFT JOIN y USING (r)),
c AS MATERIALIZED (SELECT min(doc_id) AS id, len(x) AS n, x FROM s WHERE len(x) > 0 GROUP BY x),
e AS MATERIALIZED (SELECT id, n, unnest(x) AS h FROM c),
g AS (SELECT id, n, h, row_number() OVER (PARTITION BY id ORDER BY often, h) AS k FROM e JOIN (SELECT h, count(*) AS often FROM e GROUP BY h) USING (h)),
p AS MATERIALIZED (SELECT * FROM g WHERE k <= n - ceil({percent} * n / 100.0) + 1),
d AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.h = b.h AND a.id < b.id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)),
v AS MATERIALIZED (SELECT a, b, x.n + y.n AS total, len(list_intersect(x.x, y.x)) AS common FROM d JOIN c x ON x.id = a JOIN c y ON y.id = b),
l AS MATERIALIZED (SELECT a, b FROM v WHERE 100 * common >= {percent} * (total - common) UNION ALL SELECT b, a FROM v WHERE 100 * common >= {percent} * (total - common)),
r AS (SELECT id, id AS top FROM c UNION SELECT l.a, r.top FROM r JOIN l ON l.b = r.id WHERE r.top < l.a),
t AS (SELECT id, min(top) AS top FROM r GROUP BY id),
o AS (SELECT s.doc_id, len(s.x)::BIGINT AS n_shingles, coalesce(t.top, s.doc_id) AS component_id FROM s LEFT JOIN c ON s.x = c.x LEFT JOIN t ON t.id = c.id)
SELECT doc_id, n_shingles, component_id{more} FROM o
"""


NEAR_SQL = components_sql(3, 85, ", doc_id IS NOT DISTINCT FROM component_id AS kept")
