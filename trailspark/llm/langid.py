"""Operator 7: language of a text, by sparse multinomial logistic regression on TF-IDF character n-grams.

n-grams of one to three characters of the lower-cased text, anything but letters read as a space, go
to ``DIMS`` hashed features.  Document frequencies are counted over every training row; the model is
fitted by follow-the-regularised-leader with an elastic net on about ``per_language`` training rows
of each language (the bound of the sample), a fifth of which set the temperature.

Edge cases: null texts and texts without a letter are ``und`` with score 0, as is everything when
there is no training row; rows with a null doc_id or lang aren't learned from but are predicted;
repeated rows give repeated rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .linear import ftrl, logits, softmax, temperature

DIMS = 1 << 14
UNKNOWN = "und"


def _letters() -> np.ndarray:
    return np.frombuffer(bytes(map(str.isalpha, map(chr, range(0x110000)))), np.bool_)


class Grams:
    """Hashed n-gram counts of a text: indices and counts; nothing for a text without a letter."""

    def __init__(self) -> None:
        self.letters = _letters()

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        if not text:
            return None
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = self.letters[c]
        if not is_letter.any():
            return None
        c = np.where(is_letter, c, 32)
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
        c = np.concatenate(([32], c[keep], [32])).astype(np.uint32)
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (c[1:] + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
        three = (two[:-1] ^ (c[2:] + np.uint32(0x165667B1))) * np.uint32(0xC2B2AE35)
        h = np.concatenate([one[c != 32], two, three])
        counts = np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(DIMS - 1), minlength=DIMS)
        found = np.flatnonzero(counts)
        return found, counts[found]


def _tfidf(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(counts)) * idf[found]
    return x / max(1e-12, float(np.sqrt(x @ x)))


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each feature occurs, and the number of texts; at most ``DIMS`` rows reach the driver."""

    def start():
        grams, df = Grams(), np.zeros(DIMS + 1, np.int64)

        def step(texts):
            for t in texts:
                df[DIMS] += 1
                if (x := grams(t)) is not None:
                    df[x[0]] += 1

        step.finish = lambda: [np.flatnonzero(df), df[np.flatnonzero(df)]]
        return step

    total = np.zeros(DIMS + 1, np.int64)
    for r in arrow_map(rows.select("text"), "feature int, n long", start, finish=True).groupBy("feature").agg(F.sum("n").alias("n")).collect():
        total[r["feature"]] = r["n"]
    return total[:DIMS], int(total[DIMS])


class LanguageModel:
    def __init__(self, langs: list[str], idf: np.ndarray, w: np.ndarray, b: np.ndarray, t: float):
        self.langs, self.idf, self.w, self.b, self.t = langs, idf.astype(np.float32), w.astype(np.float32), b, t

    def predict(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """``df`` without its text, with lang_pred and score."""
        langs, idf, w, b, t = self.langs, self.idf, self.w, self.b, self.t
        others = [c for c in df.columns if c != text_col]
        at = len(others)

        def start():
            grams = Grams()

            def step(*columns):
                names, scores = [], []
                for text in columns[at]:
                    x = grams(text) if langs else None
                    if x is None:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        p = softmax((_tfidf(*x, idf) @ w[x[0]] + b) / t)
                        names.append(langs[int(p.argmax())])
                        scores.append(float(p.max()))
                return [*columns[:at], names, scores]

            return step

        schema = ", ".join(f"`{c}` {k}" for c, k in df.select(*others).dtypes)
        return arrow_map(df.select(*others, text_col), f"{schema}, lang_pred string, score double", start)


def fit_language_model(train: DataFrame, per_language: int = 1500) -> LanguageModel:
    """``train``: doc_id, text, lang of the rows that may be learned from."""
    train = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    by_lang = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(by_lang)
    if not langs:
        return LanguageModel([], np.zeros(DIMS), np.zeros((DIMS, 1)), np.zeros(1), 1.0)
    df, n = document_frequencies(train)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    # a hash decides who is in the sample: the share of a language is what makes per_language rows
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / by_lang[k]))])
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def start():
        grams = Grams()

        def step(names, texts):
            out: list[list] = [[], [], []]
            for lang, text in zip(names, texts, strict=True):
                if (x := grams(text)) is not None:
                    for column, value in zip(out, (lang, x[0], x[1]), strict=True):
                        column.append(value)
            return out

        return step

    sample = arrow_map(train.filter(u < share[F.col("lang")]).select("lang", "text"), "lang string, found array<int>, counts array<int>", start).toArrow()
    ids = sample["lang"].to_pylist()
    rows = []
    for f, c in zip(sample["found"], sample["counts"], strict=True):
        found, counts = np.array(f.values), np.array(c.values)
        rows.append((found, _tfidf(found, counts, idf)))
    if not rows:
        return LanguageModel([], idf, np.zeros((DIMS, 1)), np.zeros(1), 1.0)
    targets = np.eye(len(langs))[[langs.index(x) for x in ids]]
    held = np.arange(len(rows)) % 5 == 0
    w, b = ftrl([r for r, h in zip(rows, held, strict=True) if not h] or rows, targets[~held] if (~held).any() else targets, DIMS, l1=0.002, l2=0.002)
    t = temperature(logits([r for r, h in zip(rows, held, strict=True) if h], w, b), targets[held])
    return LanguageModel(langs, idf, w, b, t)


def predict_languages(docs: DataFrame, per_language: int = 1500) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from rows whose crc32(doc_id as text) mod 3 isn't 1."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    model = fit_language_model(rows.filter(fold != 1), per_language)
    return model.predict(rows.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "text"))
