"""Operator 12: what five filters remove in each order, what of it others would have removed, and their Shapley values.

1. A row gets a mask of the filters that it fails; equal texts are known by their SHA-256.
2. Rows are counted by part and mask.  What a coalition of filters removes is the count of masks that meet it; all
   columns of any order's steps are differences of such counts.
3. The potential of a coalition (Hart and Mas-Colell) is what it removes and the potentials of the coalitions
   with one filter less, divided by its size; a filter's Shapley value is the potential of all filters less
   that of all others.  Sixty times a potential of five filters is whole, so all is counted in integers.

Edge cases: a null text is an empty one; a null source is the part of the empty string; a row with a null id has no
labels, repeats nothing and isn't repeated; rows of one id repeat each other no more than themselves; of several labels
of an id one that is 1 counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, materialize, settled

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: The least common multiple of the sizes of coalitions: this many potentials are a whole number.
WHOLE = 60
UPPER, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"


def text_mask(least_words: int = 200, least_distinct: int = 50, most_upper: int = 2):
    """A column of the filters A to D that a text fails, a bit for each."""

    def start():
        def mask(text: str | None) -> int:
            raw = (text or "").encode()
            words = raw.split()
            upper = len(raw) - len(raw.translate(None, UPPER))
            return (
                (len(words) < least_words)
                | (100 * len(set(words)) < least_distinct * len(words)) << 1
                | (100 * upper > most_upper * len(text or "")) << 2
                | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3
            )

        return lambda texts: [mask(t) for t in texts]

    return arrow_column("int", start)


def failed_filters(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask (filters failed, a bit for each) of each row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("h"), text_mask()(F.col("text")).alias("mask"))
    rows = materialize(rows)
    firsts = rows.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("h", "first")
    repeats = F.when(F.col("doc_id") > F.col("first"), F.lit(16)).otherwise(F.lit(0))
    return rows.join(firsts, "h", "left").select("doc_id", "part", F.col("mask").bitwiseOR(repeats).alias("mask"))


def removed_by(coalition: Column, cells: Column, count: str) -> Column:
    """How many of ``cells`` (mask and counts) any filter of the coalition removes."""
    return F.aggregate(F.filter(cells, lambda x: x["mask"].bitwiseAND(coalition) != 0), F.lit(0).cast("long"), lambda a, x: a + x[count])


def potentials(removed: Column) -> Column:
    """``WHOLE`` times the potential of each coalition, from what each removes."""

    def of(made: Column, c: Column) -> Column:
        without = [F.when(c.bitwiseAND(F.lit(1 << i)) != 0, F.get(made, c - (1 << i))).otherwise(F.lit(0)) for i in range(len(FILTERS))]
        total = F.get(removed, c) * WHOLE
        for x in without:
            total = total + x
        return F.concat(made, F.array(F.call_function("div", total, F.bit_count(c).cast("long"))))

    # a coalition's number is above those of its parts
    return F.aggregate(F.sequence(F.lit(1), F.lit(ALL)), F.array(F.lit(0).cast("long")), of)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""

    def build() -> DataFrame:
        one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
        known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
        rows = failed_filters(docs).join(known, "doc_id", "left")
        counts = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
        # at most 32 masks of a part
        parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"), F.sum("n").alias("total"))
        every = F.sequence(F.lit(0), F.lit(ALL))
        parts = parts.select("part", "total", *(F.transform(every, lambda c: removed_by(c, F.col("cells"), x)).alias(x) for x in ("n", "good", "toxic")))  # noqa: B023
        parts = parts.withColumn("potential", potentials(F.col("n")))
        steps = parts.withColumn("filter_order", F.explode(F.lit(ORDERS))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        bit = lambda k: F.expr(f"shiftleft(1, ascii(substring(filter_order, {k}, 1)) - ascii('A'))")
        before = sum((F.when(F.col("step") > k, bit(k)).otherwise(F.lit(0)) for k in range(1, len(FILTERS))), F.lit(0))
        own = bit("step")
        steps = steps.withColumns({"before": before, "own": own, "after": before + own, "others": F.lit(ALL) - own})
        at = lambda values, c: F.get(values, F.col(c) if isinstance(c, str) else F.lit(c))
        gone = lambda values: at(values, "after") - at(values, "before")
        return steps.select(
            "part", "filter_order", "step", (F.col("total") - at("n", "after")).alias("kept"), gone("n").alias("removed"), (at("n", "own") - gone("n")).alias("redundant"),
            (at("n", ALL) - at("n", "others")).alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"),
            ((at("potential", ALL) - at("potential", "others")) * (len(ORDERS) // WHOLE)).alias("shapley"),
        )

    return settled(docs.sparkSession, build)


#: The same rows in DuckDB's SQL: every order is applied to the masks, and Shapley values are sums over the orders.
AUDIT_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
f AS (SELECT doc_id, part, (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
e AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) e(x, bit)),
p AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM e a, e b, e c, e d, e e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, k AS step, bits[k] AS own, coalesce(list_sum(bits[:k - 1]), 0)::BIGINT AS before FROM p, range(1, 6) r(k)),
o AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (before + own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost FROM s, c GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
    toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM o
"""
