"""Operator 4: SimHash fingerprints of 63 bits, and the search of all within a Hamming radius.

Built-in functions only.  Terms are five-word shingles (a shorter text is one term); each occurrence
votes on every bit with its sign, so a term weighs as often as it occurs.  Votes of three bits are
added in one long (lanes of 21 bits), which makes 21 sums for a term inside generated code.

The next document is found without a global sort: documents fall into ranges of doc_id (quantiles,
at most ``most_ranges``), and the first document of each range is also sent to the range before it,
that of the first range to the last.  Within a range a window has the next text at hand.

Fingerprints within ``radius`` bits of each other agree in all of ``blocks - radius`` of the ``blocks``
blocks of their bits, so they meet in one of the permuted tables, one for each choice of so many blocks.
The classes of what is so connected come from ``linkage``: long lists of one key are compared with leaders
first, so a large group of copies isn't paired with itself.

Edge cases: null texts count as empty; a text without words has fingerprint 0; equal texts have equal
fingerprints; a null doc_id comes before all others; documents with one doc_id follow each other in
the order of their texts' hashes; a single document is its own next one; an empty table gives no rows;
other columns, whatever their names, are ignored.  A null fingerprint is near nothing.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize, settled, words_of
from .linkage import linked

BITS = 63
LANES = 21
_LANE = (1 << LANES) - 1
#: Terms of which a lane can hold the votes.
_LANE_TERMS = _LANE
WIDTH = 5


def term_hashes(text: Column) -> Column:
    """Hashes of the terms of a text, an array."""

    def of(w: Column) -> Column:
        n = F.greatest(F.lit(1), F.size(w) - (WIDTH - 1))
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(w, i, F.lit(WIDTH))))).otherwise(F.array().cast("array<bigint>"))

    return let(words_of(text), of)


def _votes(h: Column, weight: Column) -> list[Column]:
    mask = F.lit(1 | 1 << LANES | 1 << 2 * LANES)
    return [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(mask) * weight).alias(f"v{k}") for k in range(LANES)]


def _from_votes(terms: Column) -> Column:
    """The fingerprint: bit k + 21 j is set if more than half of the terms have it."""
    out = F.lit(0).cast("long")
    for k in range(LANES):
        for j in range(3):
            votes = F.shiftrightunsigned(F.col(f"v{k}"), LANES * j).bitwiseAND(F.lit(_LANE))
            out = out.bitwiseOR(F.when(votes * 2 > terms, F.lit(1 << (k + LANES * j)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def fingerprint(hashes: Column) -> Column:
    """The fingerprint of one array of term hashes, by itself; for texts with too many terms for the lanes."""
    bit = lambda b: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1)))
    out = F.lit(0).cast("long")
    for b in range(BITS):
        out = out.bitwiseOR(F.when(bit(b) * 2 > F.size(hashes), F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def add_fingerprints(rows: DataFrame, keys: list[str], terms: dict[str, str]) -> DataFrame:
    """``keys`` and a fingerprint for each of ``terms`` (new column: column of term hashes); keys are unique.

    Rows that are already dealt by some of the keys stay where they are: nothing is shuffled.
    """
    names = list(terms)
    many = [F.size(terms[n]) > _LANE_TERMS for n in names]
    slow = rows.select(*keys, *(F.when(m, fingerprint(F.col(terms[n]))).alias(f"slow_{n}") for m, n in zip(many, names, strict=True)), F.array(*(F.struct(F.lit(i).alias("which"), F.when(m, F.array().cast("array<bigint>")).otherwise(F.col(terms[n])).alias("h")) for i, (m, n) in enumerate(zip(many, names, strict=True)))).alias("sets"))
    slow_cols = [f"slow_{n}" for n in names]
    each = slow.select(*keys, *slow_cols, F.explode("sets").alias("x")).select(*keys, *slow_cols, F.col("x.which").alias("which"), F.explode_outer("x.h").alias("h"))
    weight = F.when(F.col("h").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long")
    votes = each.groupBy(*keys, *slow_cols, "which").agg(F.sum(weight).alias("n"), *_votes(F.coalesce("h", F.lit(0).cast("long")), weight))
    prints = votes.select(*keys, *slow_cols, "which", _from_votes(F.col("n")).alias("f"))
    found = prints.groupBy(*keys, *slow_cols).agg(*(F.max(F.when(F.col("which") == i, F.col("f"))).alias(f"fast_{n}") for i, n in enumerate(names)))
    return found.select(*keys, *(F.coalesce(f"slow_{n}", f"fast_{n}").alias(n) for n in names))


def likeness(a: Column, b: Column) -> Column:
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def _ranges(ids: DataFrame, rows_per_range: int, most_ranges: int) -> list[int]:
    """Bounds of ranges of about so many rows: at most ``most_ranges`` numbers."""
    n = ids.count()
    k = max(1, min(most_ranges, n // rows_per_range))
    if k == 1:
        return []
    cuts = ids.select(F.percentile_approx("id", [i / k for i in range(1, k)], 100 * k)).first()[0]
    return sorted(set(cuts or []))


def _prints(docs: DataFrame, rows_per_range: int, most_ranges: int) -> DataFrame:
    """doc_id, n_chars, sha, f, g, fn: the fingerprints of each text, its edited text and the next text.

    The edited text of a document has its last floor(n_chars / 2) code points replaced by the first as
    many of the next document, or all it has.
    """
    lowest = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t")).withColumn("id", F.coalesce("doc_id", lowest))
    ids = rows.select("id")
    cuts = _ranges(ids, rows_per_range, most_ranges)
    spark = docs.sparkSession
    bounds = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    # the number of bounds below the id, by halving
    def halved(place: Column, step: int) -> Column:
        return let(place, lambda p: F.when((p + step <= len(cuts)) & (F.get(bounds, p + (step - 1)) < F.col("id")), p + step).otherwise(p))

    place = F.lit(0)
    for bit in reversed(range(len(cuts).bit_length())):
        place = halved(place, 1 << bit)
    rows = rows.withColumn("r", place.cast("int"))
    firsts = sorted((x["f"], x["r"]) for x in rows.select("id", "r").groupBy("r").agg(F.min("id").alias("f")).collect())  # a row for each range
    before = [(f, firsts[i - 1][1]) for i, (f, _) in enumerate(firsts)]
    sent = spark.createDataFrame(before, "id long, to int")
    rows = rows.join(F.broadcast(sent), "id", "left")
    own = F.struct(F.col("r").alias("r"), F.lit(0).alias("extra"))
    dealt = rows.withColumn("go", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("to").alias("r"), F.lit(1).alias("extra")))))).select("go.r", "go.extra", "doc_id", "id", "t")
    # the first row of the next range is the first after the own rows
    w = Window.partitionBy("r").orderBy("extra", "id", F.xxhash64("t"), "t")
    near = dealt.withColumn("rn", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("t").over(w), F.lit("")))
    half = F.floor(F.length("t") / 2)
    edited = F.concat(F.substring(F.col("t"), F.lit(1), (F.length("t") - half).cast("int")), F.substring(F.col("next"), F.lit(1), half.cast("int")))
    texts = near.select("r", "rn", "extra", "doc_id", "t", F.length("t").cast("long").alias("n_chars"), edited.alias("e"))
    texts = texts.select("r", "rn", "extra", "doc_id", "n_chars", F.sha2("e", 256).alias("sha"), term_hashes(F.col("t")).alias("ht"), term_hashes(F.col("e")).alias("he"))
    prints = add_fingerprints(texts, ["r", "rn", "extra", "doc_id", "n_chars", "sha"], {"f": "ht", "g": "he"})
    after = F.lead("f").over(Window.partitionBy("r").orderBy("rn"))
    return prints.withColumn("fn", after).filter("extra = 0").select("doc_id", "n_chars", "sha", "f", "g", "fn")


def fingerprint_documents(docs: DataFrame, rows_per_range: int = 400, most_ranges: int = 20_000, radius: int = 3, blocks: int = 6) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_class, class_docs.

    near_class: the smallest fingerprint that steps of at most ``radius`` bits between fingerprints reach;
    class_docs: the documents of the class.
    """
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))

    def build() -> DataFrame:
        done = materialize(_prints(docs, rows_per_range, most_ranges))
        often = done.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
        classes = materialize(often.join(near_classes(often, radius, blocks), F.col("f") == F.col("id"), "left").select("f", "n", F.coalesce("label", "f").alias("c")))
        sizes = classes.groupBy("c").agg(F.sum("n").alias("class_docs"))
        # what stands alone needs no join
        known = classes.join(sizes.filter("class_docs > 1"), "c").select("f", "c", "class_docs")
        return done.join(known, "f", "left").select(
            "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), text("f").alias("fingerprint"), text("g").alias("edited_fingerprint"),
            likeness(F.col("f"), F.col("g")).alias("near_edited"), likeness(F.col("f"), F.col("fn")).alias("near_next"),
            text(F.coalesce("c", "f")).alias("near_class"), F.coalesce("class_docs", F.lit(1)).cast("long").alias("class_docs"),
        )

    return settled(docs.sparkSession, build)


def _tables(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """f, t, key: the distinct fingerprints in each of the permuted tables, with the bits that count in it."""
    if not 0 <= radius < blocks:
        raise ValueError("radius must be below the number of blocks")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    distinct = prints.select("f").distinct()
    tables = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen)
        tables.append(F.struct(F.lit(t).alias("t"), F.col("f").bitwiseAND(F.lit(mask)).alias("key")))
    return distinct.select("f", F.explode(F.array(*tables)).alias("x")).select("f", "x.t", "x.key")


def near_classes(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """id, label: of fingerprints (f) that have another within ``radius`` bits, the smallest one that such steps reach."""
    postings = _tables(prints.filter("f is not null"), radius, blocks).select(F.xxhash64("t", "key").alias("s"), F.col("f").alias("k"))
    near = lambda x, y: F.bit_count(x("k").bitwiseXOR(y("k"))) <= radius
    return linked(postings, [], near, lambda pairs: pairs, orders=4)[1]


def near_fingerprints(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs (a, b) of distinct fingerprints in column f (long) within ``radius`` bits, a < b: as many rows as there are pairs."""
    keyed = materialize(_tables(prints.filter("f is not null"), radius, blocks))
    x, y = keyed.alias("x"), keyed.alias("y")
    met = x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.f") < F.col("y.f")) & (F.bit_count(F.col("x.f").bitwiseXOR(F.col("y.f"))) <= radius))
    return met.select(F.col("x.f").alias("a"), F.col("y.f").alias("b")).distinct()
