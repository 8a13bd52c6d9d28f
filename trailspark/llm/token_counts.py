"""Operator 10: token counts without token ids.

The vocabulary of the tokenizer has no piece in which a word mark follows another character, so a
piece never crosses the start of a run of spaces, and no piece but a byte piece holds a line feed.
A text therefore falls apart into pre-tokens (spaces and what follows them, cut at line feeds)
whose counts simply add up.

1. The distinct pre-tokens of all texts, and how many texts have each, become a table; the pieces of each
   are counted once.
2. Each text's pre-token frequencies are joined to the counts and summed.  The join splits its keys: the
   ``COMMON`` pre-tokens that most texts have, a table of bounded size, are sent to every task, the others
   are joined by a shuffle, so neither a frequent pre-token nor the number of pre-tokens matters.

Pre-tokens are known by 64-bit hashes; no ids of a text are ever made.

Edge cases: a null or empty text has 0 bytes and 0 tokens; repeated rows give repeated rows; a null
doc_id stays null; a very long text without spaces is one pre-token, counted once; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, arrow_map, materialize, settled

DEFAULT_MODEL = "piece_bpe_32k.model"
#: Pre-tokens sent to every task at most: 8 bytes of hash and 4 of count each.
COMMON = 1 << 18
#: Characters of the pre-tokens a task gathers before it hands on what it has.
CHARS_HELD = 8_000_000
_RUN = re.compile(" +[^ ]*")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, without their first word mark."""
    if not text:
        return []
    text = text.replace("▁", " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [x[1:] for x in _RUN.findall(" " + text)]
    return text.split(" ")


def key_of(pre_token: str) -> int:
    return xxhash.xxh64_intdigest(pre_token.encode()) - (1 << 63)


class PieceCounts:
    """Pieces of a pre-token; after a line feed it has no word mark."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_path)

    def _pieces(self, text: str) -> int:
        return len(self.processor.encode(text, num_threads=1))

    def __call__(self, piece: str) -> int:
        if not piece:
            return 1  # a lone word mark
        head, *rest = piece.split("\n")
        # behind a line feed a word has no mark of its own: the mark and the feed come off again
        return (self._pieces(head) if head or not rest else 1) + sum(1 + (self._pieces("\n" + x) - 2 if x else 0) for x in rest)

    def text(self, text: str) -> int:
        return sum(map(self, pre_tokens(text)))


def distinct_pre_tokens(rows: DataFrame) -> DataFrame:
    """key, piece, n: the distinct pre-tokens of the texts (t) and how many texts have each, counted together in tasks first."""

    def start():
        held: Counter[str] = Counter()
        chars = 0

        def out() -> list[list]:
            nonlocal chars
            columns = [[key_of(x) for x in held], list(held), list(held.values())]
            held.clear()
            chars = 0
            return columns

        def step(texts):
            nonlocal chars
            for t in texts:
                have = set(pre_tokens(t or ""))
                chars += sum(len(x) for x in have if x not in held)
                held.update(have)
            return out() if chars > CHARS_HELD else None

        step.finish = out
        return step

    return arrow_map(rows.select("t"), "key long, piece string, n long", start, finish=True).groupBy("key").agg(F.first("piece").alias("piece"), F.sum("n").alias("n"))


def pre_token_counts(rows: DataFrame, model_path: str | None) -> DataFrame:
    """key, pieces, n: the pieces of each distinct pre-token, and how many texts have it; written."""

    def start():
        path = model_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(DEFAULT_MODEL)
        count = PieceCounts(path)
        return lambda keys, pieces, n: [keys, [count(x) for x in pieces], n]

    return materialize(arrow_map(distinct_pre_tokens(rows), "key long, pieces int, n long", start))


def least_common(counts: DataFrame, most: int) -> int:
    """In how many texts a pre-token must be, two at least, so that no more than ``most`` are: by steps of an eighth, from a small histogram."""
    step = F.floor(F.log2("n") * 6).cast("int")  # as many rows as there are steps reach the driver
    steps = sorted(counts.filter("n > 1").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n")).collect(), key=lambda r: -r["step"])
    least, total = (1 << 63) - 1, 0
    for r in steps:
        total += r["c"]
        if total > most:
            break
        least = r["n"]
    return least


def token_counts(docs: DataFrame, model_path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", most_common: int = COMMON) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``.

    ``model_path`` is a file that every executor has at the same place (None: the installed public one).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))

    def build() -> DataFrame:
        counts = pre_token_counts(rows, model_path)
        # at most ``most_common`` rows
        common = counts.filter(F.col("n") >= F.lit(least_common(counts, most_common))).select("key", "pieces").toArrow()
        known = spark.sparkContext.broadcast(dict(zip(common["key"].to_pylist(), common["pieces"].to_pylist(), strict=True)))

        def start():
            pieces, keys = known.value, {}

            def key(x: str) -> int:
                if len(keys) > CACHE_WORDS:
                    keys.clear()
                value = key_of(x)
                if len(x) < 40:
                    keys[x] = value
                return value

            def step(ids, texts):
                out: list[list] = [[], [], [], []]
                for doc_id, t in zip(ids, texts, strict=True):
                    total, rare = 0, []
                    for x, n in Counter(pre_tokens(t or "")).items():
                        k = keys.get(x)
                        k = key(x) if k is None else k
                        c = pieces.get(k)
                        if c is None:
                            rare.append({"key": k, "n": n})
                        else:
                            total += n * c
                    for column, value in zip(out, (doc_id, len((t or "").encode()), total, rare), strict=True):
                        column.append(value)
                return out

            return step

        # the number of a row is written with it, so it stays the same
        parts = materialize(arrow_map(rows, "doc_id long, n_bytes long, common long, rare array<struct<key:long,n:int>>", start).withColumn("row", F.monotonically_increasing_id()))
        rare = parts.select("row", F.explode("rare").alias("x")).select("row", F.col("x.key").alias("key"), F.col("x.n").alias("n"))
        sums = rare.join(counts.select("key", "pieces"), "key").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("rest"))
        return parts.select("row", "doc_id", "n_bytes", "common").join(sums, "row", "left").select("doc_id", "n_bytes", (F.col("common") + F.coalesce("rest", F.lit(0))).alias("n_tokens"))

    return settled(spark, build).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
