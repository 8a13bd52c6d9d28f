"""Operator 6: best-fit packing of tokenised documents into sequences of at most ``capacity`` tokens.

Tokenising is local to a row.  The default tokenizer cuts a text into pre-tokens (runs of letters, single
digits, runs of marks, contractions) that no id crosses; texts of Latin letters are cut here by the same
rule and a worker looks up the ids of each pre-token.  Other texts are cut at white space only, and texts
for a tokenizer with other rules (``tokenizer_path``) aren't cut at all.

The packing itself needs only how many pieces have each length, a table of at most ``capacity`` rows: on
it, pieces above a third of a sequence are matched greedily, at most two in a sequence, and smaller ones
go, longest first, to the smallest gap that holds them.  What this yields, ranges of ranks within a length
and where they go, is joined back to the pieces by length and rank.  Ranks of a frequent length are given
out in lanes of about ``LANE_ROWS`` pieces, so no task sorts more than that of it.

Edge cases: a null or empty text is the single id 1; a text longer than a sequence is cut into full
pieces and a rest; repeated rows are separate documents; a null doc_id stays null; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from array import array

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, kept, materialize

DEFAULT_TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Characters of pre-tokens in each of the two generations a worker keeps the ids of, about (40 more count for
#: each; some 400000 words, 70 MB), and of the longest it keeps.
CHARS_KEPT, LONGEST_KEPT = 20_000_000, 64
#: Pieces of one length in a lane, about.
LANE_ROWS = 250_000
#: The rules of the tokenizer whose texts are cut here.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: Letters, digits and white space among the characters that are cut here: Latin-1, dashes, quotes and dots.
_L, _N, _S = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \x85\xa0"
_OTHER = re.compile("[^\x00-\xff\u2010-\u2027\u20ac]")
_PRE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_WORD = re.compile(f"[{_L}]+")
_CHUNKS = re.compile("[^ \n]+")


class ChunkIds(dict):
    """Little-endian ids of the parts of texts; words of letters alone are encoded many at a time.

    When ``CHARS_KEPT`` is reached all parts become the old generation, in place of the one before; what
    is met again is taken over from it, so frequent parts stay and only those not met for long go.
    """

    def __init__(self, path: str):
        # a task has one core: no threads of the library's own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        model, added = rules["model"], rules["added_tokens"]
        self.known = all(rules[k] == v for k, v in _RULES.items()) and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not any(set(t["content"]) & set(" \n") or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        self.specials = [t["content"] for t in added]
        pieces = (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size()))
        self.ends = [x.endswith("</w>") for x in pieces]
        self.old: dict[str, bytes] = {}
        self.chars = 0

    def parts_of(self, text: str) -> list[str]:
        """Parts of a text whose ids add up."""
        if not self.known:
            return [text] if text else []
        if any(x in text for x in self.specials) or not text.isascii() and _OTHER.search(text):
            return _CHUNKS.findall(text)
        return _PRE.findall(text.lower())

    def encode(self, texts: list[str]) -> list[list[bytes]]:
        """The ids of each text, in parts; new parts of all texts go to the library in one call."""
        cut = [self.parts_of(t) for t in texts]
        if self.chars > CHARS_KEPT:
            self.old = dict(self)
            self.clear()
            self.chars = 0
        absent = set().union(*cut).difference(self)
        words, others = [], []
        for c in absent:
            if (ids := self.old.get(c)) is not None:
                self[c] = ids
            elif self.known and _WORD.fullmatch(c):
                words.append(c)
            else:
                others.append(c)
        for at in range(0, len(words), 500):
            others += self._words(words[at : at + 500])
        for c, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            self[c] = array("I", e.ids).tobytes()
        out = [list(map(self.__getitem__, c)) for c in cut]
        for c in absent:
            if len(c) > LONGEST_KEPT:
                del self[c]
            else:
                self.chars += len(c) + 40
        return out

    def _words(self, words: list[str]) -> list[str]:
        """Learns words set side by side, each one pre-token, so it ends with the only end of a word in it.

        Returns them where they don't come out as one end of word each.
        """
        ids = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        stops = [k + 1 for k, i in enumerate(ids) if self.ends[i]]
        if len(stops) != len(words) or stops[-1] != len(ids):
            return words
        data, at = array("I", ids).tobytes(), 0
        for w, stop in zip(words, stops, strict=True):
            self[w] = data[4 * at : 4 * stop]
            at = stop
        return []


def worker_chunks(path: str) -> ChunkIds:
    """The chunks that this Python worker knows; it may serve many tasks."""
    return kept(f"chunks {path}", lambda: ChunkIds(path))


def piece_rows(ids: list, texts: list[str | None], cache: ChunkIds, capacity: int) -> list[list]:
    out: list[list] = [[], [], [], [], []]
    end = array("I", [END_ID]).tobytes()
    for doc_id, parts in zip(ids, cache.encode([t or "" for t in texts]), strict=True):
        data = b"".join(parts) + end
        for piece, at in enumerate(range(0, len(data), 4 * capacity)):
            part = data[at : at + 4 * capacity]
            for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                column.append(value)
    return out


def tokenized_pieces(docs: DataFrame, capacity: int = 4096, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut at ``capacity``."""

    def start():
        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(DEFAULT_TOKENIZER)
        cache = worker_chunks(path)
        return lambda ids, texts: piece_rows(ids, texts, cache, capacity)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(rows, "doc_id long, piece int, start long, length long, ids_crc32 long", start, keeps=True)


class _Gaps:
    """Ranges of sequences with equal content, found by what room they have left."""

    def __init__(self) -> None:
        self.by_gap: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []

    def add(self, gap: int, first: int, count: int) -> None:
        if gap <= 0 or count <= 0:
            return
        if gap not in self.by_gap:
            bisect.insort(self.sizes, gap)
            self.by_gap[gap] = []
        self.by_gap[gap].append((first, count))

    def best(self, length: int) -> tuple[int, int, int] | None:
        at = bisect.bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        first, count = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            del self.by_gap[gap]
            self.sizes.pop(at)
        return gap, first, count


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, pieces per sequence, offset of the first) for all ranks.

    ``counts``: pieces by length.  A row's piece of rank r goes to sequence
    ``first sequence + (r - first rank) // per`` at ``offset + ((r - first rank) % per) * length``.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    left = {n: c for n, c in counts.items() if c > 0}
    given = dict.fromkeys(left, 0)
    gaps, sequences = _Gaps(), 0

    def place(length: int, ranks: int, first: int, per: int, offset: int) -> None:
        plan.append((length, given[length], ranks, first, per, offset))
        given[length] += ranks
        left[length] -= ranks

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):  # greedy matching: the longest takes the longest partner that fits
        while left[n] > 0:
            at = bisect.bisect_right(large, min(capacity - n, n)) - 1
            while at >= 0 and (left[large[at]] == 0 or large[at] == n and left[n] < 2):
                at -= 1
            if at < 0:
                count = left[n]
                place(n, count, sequences, 1, 0)
                gaps.add(capacity - n, sequences, count)
            elif (partner := large[at]) == n:
                count = left[n] // 2
                place(n, 2 * count, sequences, 2, 0)
                gaps.add(capacity - 2 * n, sequences, count)
            else:
                count = min(left[n], left[partner])
                place(n, count, sequences, 1, 0)
                place(partner, count, sequences, 1, n)
                gaps.add(capacity - n - partner, sequences, count)
            sequences += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):  # best fit of the rest
        while left[n] > 0:
            found = gaps.best(n)
            if found is None:
                per = capacity // n
                found = (capacity, sequences, -(-left[n] // per))
                sequences += found[2]
            gap, first, count = found
            per = gap // n
            full = min(count, left[n] // per)
            if full:
                place(n, full * per, first, per, capacity - gap)
                gaps.add(gap - per * n, first, full)
            if full < count and (rest := min(left[n], per)):
                place(n, rest, first + full, rest, capacity - gap)
                gaps.add(gap - rest * n, first + full, 1)
                full += 1
            gaps.add(gap, first + full, count - full)
    return plan


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` with sequence_id and offset; pieces must be a table that reads the same twice."""
    spark = pieces.sparkSession
    # at most ``capacity`` rows, whatever the input; then one for each lane
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    lanes_of = spark.createDataFrame([(n, -(-c // LANE_ROWS)) for n, c in counts.items()], "length long, lanes int")
    laned = pieces.join(F.broadcast(lanes_of), "length").withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("lanes")).cast("int")).drop("lanes")
    before, at = [], dict.fromkeys(counts, 0)
    for r in sorted(laned.groupBy("length", "lane").agg(F.count(F.lit(1)).alias("n")).collect()):
        before.append((r["length"], r["lane"], at[r["length"]]))
        at[r["length"]] += r["n"]
    plan = plan_packing(counts, capacity)
    w = Window.partitionBy("length", "lane").orderBy("doc_id", "piece", "ids_crc32")
    starts = spark.createDataFrame(before, "length long, lane int, before long")
    steps = spark.createDataFrame(plan, "length long, rank0 long, ranks long, seq0 long, per long, offset0 long")
    ranked = laned.withColumn("rn", F.row_number().over(w)).join(F.broadcast(starts), ["length", "lane"]).withColumn("rank", F.col("before") + F.col("rn") - 1)
    s, p = steps.alias("s"), ranked.alias("p")
    k = F.col("p.rank") - F.col("s.rank0")
    return p.join(F.broadcast(s), (F.col("p.length") == F.col("s.length")) & (k >= 0) & (k < F.col("s.ranks"))).select(
        "p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32",
        (F.col("s.seq0") + F.floor(k / F.col("s.per"))).cast("long").alias("sequence_id"),
        (F.col("s.offset0") + F.pmod(k, F.col("s.per")) * F.col("p.length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = 4096, tokenizer_path: str | None = None) -> DataFrame:
    return pack(materialize(tokenized_pieces(docs, capacity, tokenizer_path)), capacity)
