"""Operator 8: toxicity by weak supervision.

Voters look at a text: fixed word lists, words that the labelled rows single out (lists of one word),
disguised spellings, several hits at once, shouting, and one that votes when nothing is found.  A
generative label model is fitted to the votes by EM: a hidden class, how often each voter speaks in either
class (its accuracy), and its correlation with one other voter, on whose vote its own depends (the tree of
greatest mutual information within the classes).  Labels choose the mined words, calibrate, and are weak
evidence of a row's class in the EM: votes alone may be as well explained by classes that divide the kinds
of toxic texts (languages share few voters) as by toxic and clean.  A linear classifier on the words of a text,
fitted by follow-the-regularised-leader to the label model's posteriors, gives the scores.  All is fitted
on about ``per_class`` labelled rows of each class, the bound of the sample.

Edge cases: null and empty texts get the score of a text without words; rows without a label are
scored like any other; a label row without a document, or repeated, changes nothing but its weight;
with no labelled row, or of one class only, the fixed lists alone decide; repeated rows give repeated rows
with equal scores; a null doc_id is never learned from; an empty table gives no rows; other columns,
whatever their names, are ignored (``ToxicityModel.score`` keeps them).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, arrow_map, give_back, lists_in, words_of
from .linear import ftrl

#: Insults by language.
LEXICONS = {
    "en": ("idiot", "moron", "loser", "pathetic", "worthless", "scum", "clown", "trash", "disgusting", "stupid", "imbecile", "bastard", "asshole", "retard", "vermin"),
    "de": ("idiot", "trottel", "dummkopf", "abschaum", "arschloch", "versager", "widerlich", "schwachkopf"),
    "es": ("idiota", "imbécil", "estúpido", "estúpida", "basura", "asqueroso", "escoria", "payaso"),
    "fr": ("idiot", "imbécile", "stupide", "ordure", "crétin", "connard", "minable", "dégoûtant"),
}
DIMS = 1 << 16
MINED = 60
#: Log odds that a row's hidden class is what its label says, in the label model: nine labels of ten are right.
LABEL_EVIDENCE = float(np.log(9.0))
#: Rows of the sample that a word or beginning must occur in to be a feature.
LEAST_ROWS = 4
#: Tokens a task keeps with all that is known of them, and those it keeps with their features alone.
WORDS_KEPT, FEATURES_KEPT = 50_000, 150_000
#: Letters of the beginnings of words that are features besides the words.
PREFIXES = (4, 5, 6)
_LOOKALIKE = str.maketrans("013457@$!", "oieastasi")
_EDGES = re.compile(r"^\W+|\W+$")
_LONG = re.compile(r"(.)\1{2,}")


def normal_word(token: str) -> tuple[str, bool]:
    """A word without case, edges, look-alike characters and stretched letters; whether that undid a disguise."""
    word = _EDGES.sub("", token.lower())
    if not word or word.isdigit():
        return word, False
    plain = _LONG.sub(r"\1", word.translate(_LOOKALIKE)) if not word.isalpha() or _LONG.search(word) else word
    plain = re.sub(r"[\W_]+", "", plain)
    return plain, plain != word


def keys_of(word: str) -> list[str]:
    """A word and its beginnings of four to six letters, which stand for its inflections."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def feature_of(key: str) -> int:
    return xxhash.xxh32_intdigest(key.encode()) & (DIMS - 1)


class Words(dict):
    """Features, voters and disguise of each token; ``voters``: the voters of a word or beginning."""

    def __init__(self, voters: dict[str, tuple[int, ...]], only: frozenset[int] | None = None):
        super().__init__()
        self.voters, self.only = voters, only

    def __missing__(self, token: str):
        if len(self) > WORDS_KEPT:
            self.clear()
        value = self[token] = self.look(token)
        return value

    def look(self, token: str):
        word, hidden = normal_word(token)
        raw = _EDGES.sub("", token.lower())
        # a spelling counts as a disguise only if a listed word is under it
        hidden = hidden and any(k in self.voters for k in keys_of(word))
        keys = keys_of(word if hidden else raw)
        hits = tuple({v for k in keys for v in self.voters.get(k, ())})
        features = tuple(f for f in map(feature_of, keys) if self.only is None or f in self.only)
        return features, hits, hidden, word


class WordFeatures(dict):
    """The features of each token alone: of most there is none, so a token costs little more than its letters."""

    def __init__(self, words: Words):
        super().__init__()
        self.words = words

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) > FEATURES_KEPT:
            self.clear()
        value = self[token] = self.words.look(token)[0]
        return value


def voter_names(mined: list[str]) -> list[str]:
    return [*LEXICONS, *(f"mined:{m}" for m in mined), "disguised", "two_words", "dense", "shouting", "nothing"]


def voters_of(mined: list[str]) -> dict[str, tuple[int, ...]]:
    out: dict[str, tuple[int, ...]] = {}
    for k, words in enumerate([*LEXICONS.values(), *([m] for m in mined)]):
        for w in words:
            out[w] = (*out.get(w, ()), k)
    return out


class Voters:
    """Votes of a text, 1 where a voter speaks; and its word features."""

    def __init__(self, mined: list[str]):
        self.words, self.names = Words(voters_of(mined)), voter_names(mined)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        votes = np.zeros(len(self.names))
        found = [self.words[t] for t in set((text or "").split())]
        for _, hits, hidden, _ in found:
            votes[list(hits)] = 1
            votes[-5] += hidden
        listed = {f[3] for f in found if f[1]}
        votes[-5] = votes[-5] > 0
        votes[-4] = len(listed) >= 2
        votes[-3] = 50 * len(listed) >= max(1, len(found))
        votes[-2] = text is not None and 40 * text.count("!") > len(text) > 0
        votes[-1] = not listed
        features = {f for x in found for f in x[0]}
        return votes, np.sort(np.fromiter(features, np.int64, len(features)))


@dataclass
class LabelModel:
    """What EM finds of voters: posteriors, rates of speaking in the clean and the toxic class, and whose vote each leans on."""

    posterior: np.ndarray
    rates: np.ndarray
    leans_on: np.ndarray


def vote_tree(votes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each voter the one whose votes say most of its own within the classes (-1: none says enough)."""
    n, m = votes.shape
    information = np.zeros((m, m))
    for weight in (q, 1 - q):
        total = weight.sum() + 1e-9
        on = votes.T @ weight
        both = (votes * weight[:, None]).T @ votes
        cells = np.stack([both, on[:, None] - both, on[None, :] - both, total - on[:, None] - on[None, :] + both]) + 0.01
        sides = np.stack([np.outer(a, b) for a in (on, total - on) for b in (on, total - on)]) + 0.01
        information += (cells * np.log(cells * total / sides)).sum(axis=0) / n
    np.fill_diagonal(information, 0)
    parent, best, at = np.full(m, -1), np.full(m, np.log(n) / n), 0
    left = set(range(1, m))
    while left:
        for j in left:
            if information[at, j] > best[j]:
                best[j], parent[j] = information[at, j], at
        at = max(left, key=lambda j: (best[j], -j))
        left.remove(at)
    return parent


def label_model(votes: np.ndarray, toxic_voters: np.ndarray, evidence: np.ndarray | float = 0.0, rounds: int = 40) -> LabelModel:
    """A hidden class by EM from 0/1 votes; it starts from how many of ``toxic_voters`` speak.

    ``evidence``: log odds of each row's class from elsewhere.
    """
    n, m = votes.shape
    p = np.clip(0.05 + 0.45 * votes[:, toxic_voters].sum(axis=1), 0.05, 0.95)
    p = 1.0 / (1.0 + np.exp(-(np.log(p / (1 - p)) + evidence)))
    parent = vote_tree(votes, p)
    for turn in range(rounds):
        if turn in (5, 10):
            parent = vote_tree(votes, p)
        # what each voter's vote depends on: nothing, or the vote of the one it leans on
        given = np.where(parent >= 0, votes[:, np.maximum(parent, 0)], 0.0)
        z = np.zeros(n) + evidence
        rates = np.zeros((2, m))
        for y, weight in ((0, 1 - p), (1, p)):
            rates[y] = (weight @ votes + 0.5) / (weight.sum() + 1.0)
            log = np.full(n, np.log(weight.sum() / n + 1e-9))
            for state in (0.0, 1.0):
                there = given == state
                w = weight[:, None] * there
                # few rows in this state: the voter's rate without it
                on = ((w * votes).sum(axis=0) + 2 * rates[y]) / (w.sum(axis=0) + 2)
                log += np.where(there, np.where(votes > 0, np.log(on), np.log(1 - on)), 0.0).sum(axis=1)
            z += log if y else -log
        after = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        done = np.abs(after - p).max() < 1e-4
        p = after
        if done and turn > 10:
            break
    return LabelModel(p, rates, parent)


def calibration(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from scores to labels, by Newton's method with a weak prior of (1, 0)."""
    x, theta = np.stack([z, np.ones(len(z))], axis=1), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 2.0 * (theta - [1.0, 0.0])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 2.0 * np.eye(2), slope)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(0.1, float(theta[0])), float(theta[1])


class ToxicityModel:
    """Weights of word features; and the label model's findings for each voter."""

    def __init__(self, mined: list[str], w: np.ndarray, b: float, voters: list[dict] | None = None):
        self.mined, self.w, self.b, self.voters = mined, w.astype(np.float32), b, voters or []

    def score(self, df: DataFrame, name: str = "score", text_col: str = "text") -> DataFrame:
        """``df`` with a column ``name``: the score of each text."""
        mined, b = self.mined, self.b
        weights = {int(f): float(self.w[f]) for f in np.flatnonzero(self.w)}

        def start():
            words = WordFeatures(Words(voters_of(mined), frozenset(weights)))

            def step(texts):
                scores = []
                for text in texts:
                    features = {f for t in set((text or "").split()) for f in words[t]}
                    z = b + sum(weights[f] for f in features)
                    scores.append(float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))))
                return scores

            return step

        return df.withColumn(name, arrow_column("double", start)(F.col(text_col)))


def _mined_words(sample: DataFrame) -> list[str]:
    """Words and beginnings far more frequent in the toxic rows of the bounded sample than in its clean ones."""
    sizes = sample.agg(F.sum(F.col("toxic")).alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = int(sizes["t"] or 0), int(sizes["n"] - (sizes["t"] or 0))
    if toxic < 20 or clean < 20:
        return []
    words = F.filter(words_of(F.regexp_replace(F.lower("text"), r"[^\p{L}\s]+", " ")), lambda w: F.length(w) >= 3)
    begins = [F.transform(F.filter(words, lambda w: F.length(w) > F.lit(k)), lambda w: F.concat(F.substring(w, 1, k), F.lit("*"))) for k in PREFIXES]  # noqa: B023
    word = F.explode(F.array_distinct(F.concat(words, *begins)))
    counts = sample.select("toxic", word.alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    share = (F.col("a") + 0.5) / (toxic + 1.0)
    odds = F.log(share) - F.log((F.col("b") + 0.5) / (clean + 1.0))
    best = counts.filter((F.col("a") >= max(5.0, 0.01 * toxic)) & (odds > 2.0)).orderBy((share * odds).desc(), F.desc("word")).limit(10 * MINED)
    chosen: dict[str, tuple[str, int, int]] = {}
    for r in best.select("word", "a", "b").collect():
        stem = r["word"].rstrip("*")
        # a word and its beginning that the same rows hold would be one voter twice
        if not any((r["a"], r["b"]) == (a, b) and (stem.startswith(s) or s.startswith(stem)) for s, a, b in chosen.values()):
            chosen[r["word"]] = (stem, r["a"], r["b"])
    return list(chosen)[:MINED]


def fit_toxicity_model(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> ToxicityModel:
    """``labels``: doc_id, toxic of the rows that may be learned from; about ``per_class`` of each class are drawn."""
    labels = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxic")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.when(F.col("toxic") == 1, per_class / max(1, sizes.get(1, 0))).otherwise(per_class / max(1, sizes.get(0, 0)))
    drawn = labels.filter(u < share)  # about 2 * per_class rows, so it may be broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").filter(F.col("text").isNotNull())
    mined = _mined_words(sample) if sizes else []

    def start():
        voters = Voters(mined)

        def step(toxic, texts):
            found = [voters(t) for t in texts]
            return [toxic, [v.tolist() for v, _ in found], [f for _, f in found]]

        return step

    gathered = arrow_map(sample.select("toxic", "text"), "toxic int, votes array<double>, features array<int>", start).toArrow()
    listed = sorted({feature_of(w) for v in LEXICONS.values() for w in v})
    if gathered.num_rows < 40 or len(set(gathered["toxic"].to_pylist())) < 2:
        w = np.zeros(DIMS)
        w[listed] = 4.0
        return ToxicityModel([], w, -3.0)
    votes, labelled = np.stack(lists_in(gathered["votes"])), gathered["toxic"].to_numpy().astype(float)
    names = voter_names(mined)
    speak = np.flatnonzero(votes.any(axis=0) & ~votes.all(axis=0))
    found_toxic = np.flatnonzero(speak < len(names) - 5)  # the word lists
    model = label_model(votes[:, speak], found_toxic, np.where(labelled == 1, LABEL_EVIDENCE, -LABEL_EVIDENCE))
    posterior, rates = model.posterior, model.rates
    if posterior @ (labelled - labelled.mean()) < 0:  # which of the two classes is the toxic one
        posterior, rates = 1 - posterior, rates[::-1]
    voters = [{"voter": names[k], "clean": float(rates[0, j]), "toxic": float(rates[1, j]), "leans_on": names[speak[model.leans_on[j]]] if model.leans_on[j] >= 0 else None} for j, k in enumerate(speak)]
    found = lists_in(gathered["features"])
    common = sum(np.bincount(f, minlength=DIMS) for f in found) >= LEAST_ROWS
    found = [f[common[f]] for f in found]
    # rows share one array of ones
    ones = np.ones(max(map(len, found)))
    rows = [(f, ones[: len(f)]) for f in found]
    w, b = ftrl(rows, np.stack([1 - posterior, posterior], axis=1), DIMS, alpha=0.5, l1=0.6, l2=0.01, epochs=max(8, min(60, 40_000 // len(rows))))
    w, b = w[:, 1] - w[:, 0], float(b[1] - b[0])
    # the sample has about as many rows of either class; scores are for texts as they come
    drawn = [(labelled == y).sum() for y in (0, 1)]
    weight = np.where(labelled == 1, sizes[1] / drawn[1], sizes[0] / drawn[0]) * len(labelled) / (sizes[0] + sizes[1])
    slope, offset = calibration(np.array([b + w[f].sum() for f, _ in rows]), labelled, weight)
    del gathered, found, rows
    give_back()
    return ToxicityModel(mined, slope * w, slope * b + offset, voters)


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted; learns labels from rows whose crc32(doc_id as text) mod 5 isn't 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    model = fit_toxicity_model(rows, known.filter(fold != 0), per_class)
    scored = model.score(rows.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text")).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

