"""Operator 9: documents whose word shingles have a Jaccard similarity of at least a threshold.

1. Shingles are counted in ``FREQUENCY_CELLS`` hashed cells, over all documents: the order from rare
   to frequent.
2. Each document's set is sorted in that order and cut to its prefix; equal sets become one class
   (64-bit hash of the set).  Classes meet on prefix shingles; length, position and suffix (the
   parities of hash cells bound how much two sets differ) drop pairs that cannot reach the threshold.
3. Each remaining pair is verified once, exactly, on the sets of the classes in it; a bit table says
   which documents' sets are worth sending.  ``linkage`` keeps large groups from becoming all pairs.

The order by cells is only as fine as the cells, which costs candidates where the corpus is very large,
never a link.

Edge cases: null, empty and white-space texts have no shingle, are linked with nothing and are their
own component; fewer words than a shingle make one shingle of all words; repeated rows are equal
sets; a null doc_id links others but is never a component's id (null if there is no other); an empty
table gives no rows; other columns, whatever their names, are ignored (``keep_one_of_each`` keeps them).
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, arrow_map, fresh, materialize, mix, release, settled, signed, windows, written
from .linkage import chosen_sets, least_common, linked, parity, set_verifier

FREQUENCY_CELLS = 1 << 18
#: Longs of the parity of a set; as many bits as its suffix filter looks at.
PARITY_WORDS = 16
#: Orders that leaders of long lists are drawn by: documents have many lists, so few suffice.
ORDERS = 4


def shingle_set(text: str | None, width: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text, A-Z lower-cased, words cut at ASCII white space."""
    words = (text or "").encode().lower().split()
    return np.unique(windows(cache.of(words), width))


def set_key(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), seed=len(h)) - (1 << 63)


def _frequencies(texts: DataFrame, width: int) -> np.ndarray:
    def start():
        cache, total = WordHashes(), np.zeros(FREQUENCY_CELLS, np.int64)

        def step(column):
            for t in column:
                h = shingle_set(t, width, cache)
                np.add.at(total, (h & np.uint64(FREQUENCY_CELLS - 1)).astype(np.int64), 1)

        step.finish = lambda: [np.flatnonzero(total), total[np.flatnonzero(total)]]
        return step

    out = np.zeros(FREQUENCY_CELLS, np.int32)
    cells = arrow_map(texts, "cell int, n long", start, finish=True).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[np.array(cells["cell"], np.int64)] = np.minimum(np.array(cells["n"], np.int64), 2**31 - 1)
    return out


def prefix_table(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, th (hash of the text), k (class), n (set size), bits (parity of the set), prefix."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    order = docs.sparkSession.sparkContext.broadcast(_frequencies(rows.select("text"), width))

    def start():
        cache, often = WordHashes(), order.value

        def step(ids, hashes, texts):
            out: list[list] = [ids, hashes, [], [], [], []]
            for t in texts:
                h = shingle_set(t, width, cache)
                n = len(h)
                if n:
                    length = n - -(-percent * n // 100) + 1
                    rare = np.lexsort((mix(h), often[(h & np.uint64(FREQUENCY_CELLS - 1)).astype(np.int64)]))[:length]
                    values = (set_key(h), n, parity(h, PARITY_WORDS), signed(h[rare]))
                else:
                    values = (None, 0, None, np.zeros(0, np.int64))
                for column, value in zip(out[2:], values, strict=True):
                    column.append(value)
            return out

        return step

    return arrow_map(rows, "doc_id long, th long, k long, n int, bits array<long>, prefix array<long>", start)


def _keep(percent: int):
    def keep(x, y) -> Column:
        n, m = x("n"), y("n")
        length = F.least(n, m) * 100 >= F.greatest(n, m) * percent
        position = F.least(n - x("i"), m - y("i")) >= least_common(n, m, percent)
        return length & position

    return keep


def near_duplicate_classes(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, th, k, n of ``docs``, the verified links (a, b) between classes, and their components (id, label).

    What a step alone needs is written by itself and deleted after it.
    """
    spark = docs.sparkSession
    whole, spent = written(prefix_table(docs, width, percent))
    table, sets = materialize(whole.select("doc_id", "th", "k", "n")), whole.filter(F.col("k").isNotNull())
    bits = materialize(sets.select("k", "n", "bits").dropDuplicates(["k"]))
    classes, listed = written(sets.groupBy("k").agg(F.min(F.struct("n", "prefix")).alias("x")))
    release(spark, [spent])
    postings = classes.select("k", F.col("x.n").alias("n"), F.posexplode("x.prefix").alias("i", "s"))
    homes = table.filter(F.col("k").isNotNull()).select("k", "th")

    def sets_in():
        cache = WordHashes()

        def of(texts):
            for t in texts:
                h = shingle_set(t, width, cache)
                if len(h):
                    yield set_key(h), lambda h=h: h

        return of

    verify = set_verifier(lambda ids: chosen_sets(docs, ids, homes, sets_in), percent)
    # a set of which little is rarer than what it shares is likely to be what the others are copies of
    links, label = linked(postings, ["n", "i"], _keep(percent), verify, ORDERS, bits, percent, PARITY_WORDS, rank="i", listed=lambda: release(spark, [listed]))
    return table, links, label


def with_component(table: DataFrame, label: DataFrame) -> DataFrame:
    """``table`` with c, the label of its class (the class itself where nothing is linked; null for empty sets)."""
    return table.join(label.select(F.col("id").alias("k"), "label"), "k", "left").withColumn("c", F.coalesce("label", "k")).drop("label")


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``."""

    def build() -> DataFrame:
        table, _, label = near_duplicate_classes(docs, width, percent)
        rows = materialize(with_component(table.select("doc_id", "k", "n"), label))
        first = rows.filter(F.col("c").isNotNull()).groupBy("c").agg(F.min("doc_id").alias("first"))
        return rows.join(first, "c", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("component_id"))

    return settled(docs.sparkSession, build)


def lost_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, th (hash of the text) and how often (n) of the rows that aren't the first of their component, or aren't alone."""
    table, _, label = near_duplicate_classes(docs, width, percent)
    rows = materialize(with_component(table.select("doc_id", "th", "k"), label).filter(F.col("c").isNotNull()))
    # a null doc_id comes after all others; ties of doc_id are told apart by their texts
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "th")
    first = rows.groupBy("c").agg(F.min(rank).alias("f"), F.count(F.lit(1)).alias("of")).filter("of > 1")
    return rows.join(first, "c").groupBy("doc_id", "th").agg(F.min(rank.eqNullSafe(F.col("f"))).alias("stays"), F.count(F.lit(1)).alias("n")).filter("not stays or n > 1")


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest doc_id stays.

    Rows without a shingle stay, and of rows with equal doc_id and text one does.
    """
    cols = docs.columns
    th, d, t, stays = fresh(docs, "th", "d", "t", "stays")
    lost = settled(docs.sparkSession, lambda: lost_rows(docs.select("doc_id", "text"), width, percent)).select(F.col("doc_id").alias(d), F.col("th").alias(t), F.col("stays").alias(stays))
    keyed = docs.withColumn(th, F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(th) == F.col(t))
    if lost.filter(F.col(stays)).isEmpty():
        return keyed.join(lost, same, "left_anti").select(cols)
    marked = keyed.join(lost, same, "left").filter(F.coalesce(stays, F.lit(True)))
    return marked.filter(F.col(stays).isNull()).select(cols).unionByName(marked.filter(F.col(stays).isNotNull()).select(cols).dropDuplicates(["doc_id", "text"]))
