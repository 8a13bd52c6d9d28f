"""Operator 5: repeated paragraphs and passages of ``min_words`` words or more.

1. A paragraph is a line of ``min_words`` words or more, compared by five-word shingles of the lower-cased
   words.  Equal ones are one class.  MinHash bands are as many as a pair at the threshold needs to collide
   with probability ``recall``; classes that collide are verified by exact Jaccard similarity, and of each
   component of linked classes all that isn't in the document of the first occurrence (by doc_id, then
   text) is removed.
2. A passage is ``min_words`` words or more anywhere in a text's word stream, whatever its lines and
   punctuation.  It is found by the MinHash of every window of ``SEED_WINDOW`` runs of ``SEED_WORDS`` words,
   its seed, which any ``SEED_WORDS + SEED_WINDOW - 1`` equal words share.  Two passages of at least
   49 words whose similarity is 0.8 with words replaced have an unchanged stretch of 24 words (at most one
   word in 45 is replaced), so no such pair is missed.  A seed is matched with its first document; runs
   of matched seeds are extended word by word, over changed words too as far as the exact similarity stays
   at the threshold, and joined.  What then has ``min_words`` words or more is removed.

Shorter repeats, such as common one-sentence lines, stay, and so does what repeats within one document only.

Edge cases: null texts stay null, nothing is removed from them; rows with equal doc_id and text are
one document, so they keep or lose the same paragraphs; a document may lose all its text, which then
is empty; a null doc_id comes after all others; an empty table gives no rows; other columns, whatever
their names, are kept as they are.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEYS_KEPT, arrow_column, arrow_map, fresh, materialize, settled, signed, windows
from .linkage import ID_BITS, chosen_sets, id_bits, linked, parity, set_verifier

WIDTH = 5
PARITY_WORDS = 4
#: Orders that leaders of long lists are drawn by.
ORDERS = 12
#: Words that a removed paragraph or passage has at least.
MIN_WORDS = 50
#: Words of a seed of a passage, and how many runs of words a seed is the least of.
SEED_WORDS = SEED_WINDOW = 12
#: Words around a run of seeds that are compared with where they are first found.
CONTEXT = 32
#: Bytes of words that are summed up at once.
BLOCK = 1 << 16
_SPACE = np.array([bytes([c]).isspace() for c in range(256)])
#: A random number for each byte, the same for A and a, none for space; an odd factor and its inverse modulo 2**64.
_VALUES = np.where(_SPACE, np.uint64(0), np.random.default_rng(5).integers(1, 2**64, 256, dtype=np.uint64)[np.frombuffer(bytes(range(256)).lower(), np.uint8)])
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 2**64)


def tune_bands(threshold: float, recall: float, most_hashes: int = 64) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, whose bands reach ``recall`` within ``most_hashes``."""
    best = (most_hashes, 1)
    for rows in range(1, 9):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


class Paragraphs:
    """Lines of a batch of texts that are long enough, as arrays over one stream of word hashes."""

    def __init__(self, min_words: int):
        self.min_words = min_words

    def __call__(self, texts: list[str | None]):
        """doc, place, length, first word, words of each line; the word hashes; and where each text's begin.

        place and length are in bytes of the UTF-8 text.
        """
        parts = [(text or "").encode() for text in texts]
        data = b"\n".join(parts)
        texts_at = np.cumsum([0] + [len(p) + 1 for p in parts])
        starts, ends = word_places(data)
        feeds = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        begins, stops = np.concatenate(([0], feeds + 1)), np.append(feeds, len(data))
        firsts = np.append(np.searchsorted(starts, begins), len(starts))
        sizes = np.diff(firsts)
        long = np.flatnonzero(sizes >= self.min_words)
        docs = np.searchsorted(texts_at, begins[long], "right") - 1
        columns = docs, begins[long] - texts_at[docs], (stops - begins)[long], firsts[long], sizes[long]
        return list(zip(*(c.tolist() for c in columns), strict=True)), word_hashes(data, starts, ends), np.searchsorted(starts, texts_at).tolist()


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``data.split()`` start and end."""
    edges = np.diff(np.concatenate(([True], _SPACE[np.frombuffer(data, np.uint8)], [True])).astype(np.int8))
    return np.flatnonzero(edges < 0), np.flatnonzero(edges > 0)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(n - 1, f, np.uint64)))) for f in (_FACTOR, _INVERSE))


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of ``data.lower().split()``, which are where ``word_places`` says.

    Each distinct word is hashed once.  Equal words are known by 64-bit sums: a word's bytes are digits of a
    number to the base ``_FACTOR``, modulo 2**64, and spaces are 0, so all words are summed up without a
    Python object for each, in blocks of whole words, whatever the place where a word begins.
    """
    raw, sums = np.frombuffer(data, np.uint8), np.zeros(len(starts), np.uint64)
    up, down = _powers(min(len(raw), BLOCK)) if len(raw) else (sums, sums)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(starts, first + BLOCK)) - 1) if first + BLOCK < len(raw) else len(starts)
        end = int(starts[stop]) if stop < len(starts) else len(raw)
        if end - first > len(up):  # a word longer than a block
            up, down = _powers(end - first)
        places = starts[at:stop] - first
        sums[at:stop] = np.add.reduceat(_VALUES[raw[first:end]] * up[: end - first], places) * down[places]
        at = stop
    _, one, which = np.unique(sums, return_index=True, return_inverse=True)
    low, edges = data.lower(), zip(starts[one].tolist(), ends[one].tolist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(low[a:b]) for a, b in edges), np.uint64, len(one))[which]


def _pooled(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[: len(x) - step], x[step:])
        have += step
    return x


def seeds(h: np.ndarray, base: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where in the stream the seeds of its texts begin, and their hashes.

    Of any ``SEED_WINDOW`` runs of ``SEED_WORDS`` words that begin one after the other the least is a
    seed, wherever lines and sentences end.
    """
    if len(h) < SEED_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    most = np.uint64(2**64 - 1)
    s = np.concatenate((windows(h, SEED_WORDS), np.full(SEED_WORDS - 1, most)))
    for b in base[1:]:  # no run reaches into the next text
        s[max(0, b - SEED_WORDS + 1) : b] = most
    ends = np.full(SEED_WINDOW - 1, most)
    low = _pooled(np.concatenate((ends, s, ends)), SEED_WINDOW, np.minimum)
    at = np.flatnonzero((_pooled(np.where(low == most, np.uint64(0), low), SEED_WINDOW, np.maximum) == s) & (s != most))
    return at, s[at]


def _class(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), seed=len(h)) - (1 << 63)


def _shingles(h: np.ndarray, runs: np.ndarray, first: int, n: int) -> np.ndarray:
    """The set of a line of ``n`` words, of the runs of ``WIDTH`` words of all the stream."""
    return np.unique(runs[first : first + n - WIDTH + 1] if n >= WIDTH else windows(h[first : first + n], WIDTH))


def _bands(shingles: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes, one row for each set."""
    flat = np.concatenate(shingles)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in shingles])[:-1]))
    draw = np.random.default_rng(11)
    out = np.zeros((len(shingles), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(shingles), b + 1, np.uint64)
        for _ in range(rows):
            mult, add = draw.integers(1, 2**63, 2, dtype=np.uint64)
            low = np.minimum.reduceat((flat * (mult | np.uint64(1)) + add) >> np.uint64(8), starts)
            acc = (acc ^ low) * np.uint64(0x9E3779B97F4A7C15)
            acc ^= acc >> np.uint64(29)
        out[:, b] = acc
    return out


def paragraph_table(docs: DataFrame, min_words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, th, place, len, kind, k (class), n (shingles), bits (parity), s (band hashes); written.

    A row of kind 0 is a line; one of a class that the task has met before has neither bits nor bands.
    A row of kind 1 holds the seeds of a text: their first words in bits, their hashes in s.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")

    def start():
        cut, sent = Paragraphs(min_words), set()

        def step(ids, hashes, texts):
            lines, h, base = cut(texts)
            runs = windows(h, WIDTH)
            out: list[list] = [[] for _ in range(9)]
            sets: list[np.ndarray] = []
            none = np.zeros(0, np.int64)

            def put(*row) -> None:
                for column, value in zip(out, row, strict=True):
                    column.append(value)

            for d, place, length, first, n in lines:
                k = _class(h[first : first + n])
                if len(sent) > KEYS_KEPT:
                    sent.clear()
                if k in sent:
                    put(ids[d], hashes[d], place, length, 0, k, 0, None, none)
                else:
                    sent.add(k)
                    sets.append(_shingles(h, runs, first, n))
                    put(ids[d], hashes[d], place, length, 0, k, len(sets[-1]), parity(sets[-1], PARITY_WORDS), None)
            values = iter(signed(_bands(sets, bands, rows)) if sets else ())
            out[8] = [next(values) if s is None else s for s in out[8]]
            at, found = seeds(h, base)
            for d, (a, b) in enumerate(pairwise(np.searchsorted(at, base).tolist())):
                if b > a:
                    put(ids[d], hashes[d], 0, 0, 1, 0, 0, at[a:b] - base[d], signed(found[a:b]))
            return out

        return step

    return materialize(arrow_map(source, "doc_id long, th long, place int, len int, kind int, k long, n int, bits array<long>, s array<long>", start))


def _same_document():
    """Whether a place is in the document of the first one (f)."""
    return F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("th") == F.col("f.th"))


def repeated_runs(docs: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, th, runs: what of a document is made of seeds that an earlier place has.

    Each run comes twice, with the words before (side 0) the place where its first seed is found first,
    and with those after (side 1) that of its last seed: words [a, b) of the document; text t and word w of
    that place; 32-bit hashes.
    """
    each = table.filter("kind = 1").select("doc_id", "th", F.explode(F.arrays_zip(F.col("bits").alias("w"), F.col("s").alias("s"))).alias("x")).select(F.col("x.s").alias("s"), "doc_id", "th", F.col("x.w").cast("int").alias("w"))
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "th", "w")
    # minima come together within tasks first; the join of two tables then splits a key of very many rows
    first = materialize(each.groupBy("s").agg(F.min(order).alias("f"), F.max(order).alias("l")).filter(~F.col("f").eqNullSafe(F.col("l"))).select("s", "f"))
    hits = materialize(each.join(first, "s").filter(~_same_document()).select("doc_id", "th", "w", F.col("f.th").alias("bt"), F.col("f.w").alias("bw")))
    by_text = hits.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("w", "bt", "bw"))).alias("hits"))

    def chain():
        def step(ids, hashes, found):
            out: list[list] = [[] for _ in range(7)]
            for doc, th, hs in zip(ids, hashes, found, strict=True):
                runs: list[list[int]] = []
                for x in hs:
                    if runs and x["w"] <= runs[-1][1]:
                        runs[-1][1], runs[-1][4], runs[-1][5] = x["w"] + SEED_WORDS, x["bt"], x["bw"] + SEED_WORDS
                    else:
                        runs.append([x["w"], x["w"] + SEED_WORDS, x["bt"], x["bw"], x["bt"], x["bw"] + SEED_WORDS])
                for a, b, *places in runs:
                    for side in (0, 1):
                        for column, value in zip(out, (doc, th, a, b, side, *places[2 * side : 2 * side + 2]), strict=True):
                            column.append(value)
            return out

        return step

    runs = materialize(arrow_map(by_text, "doc_id long, th long, a int, b int, side int, t long, w int", chain))
    cells = np.zeros(1 << (ID_BITS - 6), np.uint64)
    if wanted := id_bits(runs, "t", ID_BITS):
        cells[np.fromiter(wanted, np.int64, len(wanted))] = np.array(list(wanted.values()), np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(cells)

    def cut():
        bits = shared.value

        def step(hashes, texts):
            out: list[list] = [[], []]
            for th, text in zip(hashes, texts, strict=True):
                x = th & ((1 << ID_BITS) - 1)
                if text and int(bits[x >> 6]) >> (x & 63) & 1:
                    out[0].append(th)
                    data = text.encode()
                    out[1].append(_short(data, *word_places(data)))
            return out

        return step

    words = arrow_map(docs.select(F.xxhash64("text").alias("th"), "text"), "t long, h array<int>", cut).groupBy("t").agg(F.first("h").alias("h"))
    before = F.slice("h", F.greatest(F.lit(1), F.col("w") - (CONTEXT - 1)), F.least(F.lit(CONTEXT), F.col("w")))
    near = F.when(F.col("side") == 0, before).otherwise(F.slice("h", F.col("w") + 1, F.lit(CONTEXT)))
    beside = runs.join(words, "t").select("doc_id", "th", F.struct("a", "side", "b", "t", "w", near.alias("near")).alias("run"))
    return beside.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list("run")).alias("runs"))


def _short(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (word_hashes(data, starts, ends) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _extended(own: list[int], source: list[int]) -> list[tuple[int, int, int]]:
    """How far two sequences agree from their start: (own words, source words, common shingles) without a change, and after each.

    A change is a word replaced, added or left out, with ``WIDTH`` words that agree after it.
    """
    i = j = common = begun = 0
    out = []
    while True:
        while i < len(own) and j < len(source) and own[i] == source[j]:
            i, j = i + 1, j + 1
        # the first stretch goes on from a run, so each of its words ends a shingle
        common += i if not out else max(0, i - begun - (WIDTH - 1))
        out.append((i, j, common))
        for x, y in ((1, 1), (1, 0), (0, 1)):
            if own[i + x : i + x + WIDTH] == source[j + y : j + y + WIDTH] and len(own) >= i + x + WIDTH and len(source) >= j + y + WIDTH:
                i, j = i + x, j + y
                begun = i
                break
        else:
            return out


def passages(own: list[int], runs: list[dict], percent: int, min_words: int) -> list[tuple[int, int]]:
    """The words [a, b) of passages that occur before: runs, extended and joined as far as the similarity allows."""

    def alike(n: int, m: int, common: int) -> bool:
        n, m = n - (WIDTH - 1), m - (WIDTH - 1)
        return common * 100 >= (n + m - common) * percent

    # own words, source words, common shingles; and the text and words of the source
    done: list[dict] = []
    for left, right in zip(runs[::2], runs[1::2], strict=True):
        a, b = left["a"], left["b"]
        n, m, common = b - a, b - a, b - a - (WIDTH - 1)
        before = _extended(own[max(0, a - CONTEXT) : a][::-1], list(left["near"])[::-1])
        x, y, more = next(e for e in reversed(before) if alike(n + e[0], m + e[1], common + e[2]))
        n, m, common, a, first = n + x, m + y, common + more, a - x, left["w"] - y
        after = _extended(own[b : b + CONTEXT], list(right["near"]))
        x, y, more = next(e for e in reversed(after) if alike(n + e[0], m + e[1], common + e[2]))
        r = {"lt": left["t"], "rt": right["t"], "rw": right["w"]}
        new = {"a": a, "b": b + x, "m": m + y, "common": common + more, "lt": r["lt"], "lw": first, "rt": r["rt"], "rw": r["rw"] + y}
        if done:
            last = done[-1]
            lap = last["b"] - new["a"]
            apart = new["lw"] - last["rw"]
            if lap >= 0:  # what both hold counts once
                last["common"] += max(0, new["common"] - max(0, lap - (WIDTH - 1)))
                last["m"] += max(0, new["m"] - lap)
                last["b"], last["rt"], last["rw"] = max(last["b"], new["b"]), new["rt"], new["rw"]
                continue
            if last["rt"] == new["lt"] and apart >= 0 and alike(new["b"] - last["a"], last["m"] + apart + new["m"], last["common"] + new["common"]):
                last["common"] += new["common"]
                last["m"] += apart + new["m"]
                last["b"], last["rt"], last["rw"] = new["b"], new["rt"], new["rw"]
                continue
        done.append(new)
    return [(d["a"], d["b"]) for d in done if d["b"] - d["a"] >= min_words]


def repeated_paragraphs(docs: DataFrame, threshold: float = 0.8, recall: float = 0.99, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th; cuts: the lines (place, len; in bytes) to remove from each document that has any; runs of its seeds."""
    bands, rows = tune_bands(threshold, recall)
    table = paragraph_table(docs, min_words, bands, rows)
    runs = repeated_runs(docs, table)
    percent = int(round(threshold * 100))
    lines = table.filter((F.col("kind") == 0) & F.col("bits").isNotNull())
    postings = lines.groupBy("k").agg(F.min(F.struct("n", "s")).alias("x")).select("k", F.col("x.n").alias("n"), F.explode("x.s").alias("s"))
    bits = lines.select("k", "n", "bits").dropDuplicates(["k"])

    def keep(x, y):
        return F.least(x("n"), y("n")) * 100 >= F.greatest(x("n"), y("n")) * percent

    def sets_in():
        cut = Paragraphs(min_words)

        def of(column):
            units, h, _ = cut(column)
            runs = windows(h, WIDTH)
            for *_, first, n in units:
                yield _class(h[first : first + n]), lambda first=first, n=n: _shingles(h, runs, first, n)

        return of

    verify = set_verifier(lambda ids: chosen_sets(docs, ids, lines.select("k", "th"), sets_in), percent)
    _, label = linked(postings, ["n"], keep, verify, ORDERS, bits, percent, PARITY_WORDS)
    # classes that occur more than once, alone or with what they are linked to
    places = materialize(table.filter("kind = 0").select("doc_id", "th", "place", "len", "k").join(label.select(F.col("id").alias("k"), "label"), "k", "left").select("doc_id", "th", "place", "len", F.coalesce("label", "k").alias("c")))
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "th", "place", "len")
    first = places.groupBy("c").agg(F.min(order).alias("f"), F.max(order).alias("l")).filter(~F.col("f").eqNullSafe(F.col("l"))).select("c", "f")
    cut = places.join(first, "c").filter(~_same_document())
    both = cut.select("doc_id", "th", F.struct("place", "len").alias("c"), F.lit(None).cast(runs.schema["runs"].dataType).alias("runs")).unionByName(runs.withColumn("c", F.lit(None).cast("struct<place:int,len:int>")))
    return both.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("c")).alias("cuts"), F.first("runs", ignorenulls=True).alias("runs"))


def without(data: bytes, cuts: list[tuple[int, int]]) -> tuple[str, list[dict]]:
    """A UTF-8 text without the bytes [a, b) of ``cuts``, and without lines that so lose all; and what went, in code points."""
    spans: list[list[int]] = []
    for a, b in sorted(cuts):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    raw = np.frombuffer(data, np.uint8)
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    line = np.concatenate(([0], np.cumsum(raw == 10)))
    kept, at = [], 0
    for a, b in spans:  # line feeds inside a passage stay for now, so lines keep their numbers
        kept += [data[at:a], b"\n" * int(line[b] - line[a])]
        at = b
    kept.append(data[at:])
    removed = {j for a, b in spans for j in range(int(line[a]), int(line[b]) + 1)}
    left = [content for j, content in enumerate(b"".join(kept).split(b"\n")) if j not in removed or content.strip()]
    return b"\n".join(left).decode(), [{"start": int(points[a]), "length": int(points[b] - points[a])} for a, b in spans]


def remove_repeated_paragraphs(docs: DataFrame, threshold: float = 0.8, recall: float = 0.99, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with text rid of repeated paragraphs, and a last column (removed): their spans in the old text, in code points."""
    cuts = settled(docs.sparkSession, lambda: repeated_paragraphs(docs.select("doc_id", "text"), threshold, recall, min_words))
    percent = int(round(threshold * 100))
    th, d, t, found, removed = fresh(docs, "th", "d", "t", "found", "removed")
    cuts = cuts.select(F.col("doc_id").alias(d), F.col("th").alias(t), F.struct("cuts", "runs").alias(found))
    joined = docs.withColumn(th, F.xxhash64("text")).join(cuts, F.col(d).eqNullSafe(F.col("doc_id").cast("long")) & (F.col(t) == F.col(th)), "left")

    def start():
        def step(texts, founds):
            out = []
            for text, f in zip(texts, founds, strict=True):
                if text is None or f is None:
                    out.append(None)
                    continue
                data = text.encode()
                spans = [(c["place"], c["place"] + c["len"]) for c in f["cuts"]]
                if f["runs"]:
                    starts, ends = word_places(data)
                    spans += [(int(starts[a]), int(ends[b - 1])) for a, b in passages(_short(data, starts, ends).tolist(), f["runs"], percent, min_words)]
                new, gone = without(data, spans) if spans else (text, [])
                out.append({"text": new, "removed": gone})
            return out

        return step

    # only texts of which something may go are sent to Python
    cut = arrow_column("text string, removed array<struct<start:long,length:long>>", start)
    done = joined.withColumn(found, cut(F.when(F.col(found).isNotNull(), F.col("text")), F.col(found)))
    text = F.when(F.col(found).isNull(), F.col("text")).otherwise(F.col(found)["text"]).alias("text")
    spans = F.coalesce(F.col(found)["removed"], F.array()).alias(removed)
    return done.select(*(text if c == "text" else F.col(f"`{c}`") for c in docs.columns), spans)
