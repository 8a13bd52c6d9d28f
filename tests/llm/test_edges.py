"""Very long texts, clashing columns, nulls, ties and repeats through every operator; each result is checked, not only that there is one."""

import random
import re

import pytest
from pyspark.sql import functions as F

np = pytest.importorskip("numpy")
pa = pytest.importorskip("pyarrow")
pytest.importorskip("trailspark.llm")
from trailspark.llm import common, html_text, jaccard_join, langid, mixing, packing, paragraph_dedup, quality, simhash, token_counts, toxicity  # noqa: E402

#: Names that operators use inside, and names of their results.
CLASHES = ("score", "predicted", "removed", "label", "id", "k", "s", "n", "m", "th", "d", "t", "f", "r", "c", "i", "x", "h", "w", "a", "b", "found", "stays", "mixture", "lane", "kept", "piece", "row", "key", "rate", "domain", "posterior", "n_tokens", "near", "run", "repeated", "held_out")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(31)
    words = [f"term{i}" for i in range(3000)]
    long_text = " ".join(rng.choice(words) for _ in range(150_000))  # over 1 MB
    unspaced = "".join(rng.choice("abcdefgh") for _ in range(1_000_000))
    short = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(12)]
    rows = [(1, long_text), (2, unspaced), (3, None), (4, ""), (5, " \n\t "), (6, short[0]), (6, short[0]), (7, short[1]), (None, short[2]), (None, None), (8, long_text + "\nend")]
    return rows + [(10 + j, t) for j, t in enumerate(short[3:])]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    for c in CLASHES:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df.withColumn("lang", F.lit("en"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(30)] + [(None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


def ids(rows):
    return sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in rows)


def every(corpus):
    return sorted(-1 if d is None else d for d, _ in corpus)


def test_quality(docs, corpus):
    out = quality.quality_rules(docs).drop("clean_text").collect()
    assert ids(out) == every(corpus)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["n_words"] == 150_000 and by[2]["n_words"] == 1 and by[2]["word_chars"] == 1_000_000 and by[2]["base_failed"]


def test_html(spark, corpus):
    rows = [(d, "http://a/x", None if t is None else f"<nav>menu</nav><p>{t}</p>") for d, t in corpus]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("h", "th", "text", "repeated", "who", "main", "run"):
        df = df.withColumn(c, F.lit("own"))
    out = html_text.extract_main_text(df).collect()
    by = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and by[2] == corpus[1][1] and by[3] == by[4] == by[5] == ""
    # all but its end is on another page of the host
    assert by[1] == "" and by[8] == "end"
    assert [r["text"] for r in out if r["page_id"] == 6] == [corpus[5][1]] * 2


def test_mixing(docs, corpus, labels):
    from trailspark.llm.queries import labelled_domains

    domains = labelled_domains(docs.select("doc_id", "lang"), labels)
    out = mixing.document_rates(docs, domains, {"en/1": 0.5, "en/0": 0.5}).collect()
    assert ids(out) == every(corpus)
    twice = [r["rate"] for r in out if r["doc_id"] == 6]
    assert twice[0] == twice[1] and all(r["n_tokens"] == 0 for r in out if r["doc_id"] in (3, 4, 5))
    mixed = mixing.mix(docs, domains, {"en/1": 0.5, "en/0": 0.5})
    assert mixed.columns == docs.columns and {r["rate"] for r in mixed.select("rate").distinct().collect()} <= {"own rate"}


def test_rates_equal_a_reference_solver_and_unreachable_targets_warn(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(("red", "blue", "green")[i % 3 : i % 3 + 1]) + str(rng.randint(0, 9)) for _ in range(20 + i % 7))) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, "rbg"[i % 3]) for i in range(120)], "doc_id long, domain string")
    targets = {"r": 0.1, "b": 0.3, "g": 0.6}
    out = mixing.document_rates(df, lab, targets).toPandas()
    p, n = np.stack(out.posterior), out.n_tokens.to_numpy(float)
    want = np.array([targets[d] for d in "bgr"]) * n.sum()
    got = (p * (n * out.rate.to_numpy())[:, None]).sum(0)
    assert np.abs(got - want).max() <= 1e-3 * n.sum()
    # plain projected gradient on all documents ends at the same totals
    r = np.ones(len(n))
    step = 1.0 / np.linalg.eigvalsh((p * (n * n)[:, None]).T @ p).max()
    for _ in range(4000):
        r = np.maximum(0, r - step * n * (p @ ((p * (n * r)[:, None]).sum(0) - want)))
    assert np.abs((p * (n * r)[:, None]).sum(0) - got).max() <= 2e-3 * n.sum()
    with pytest.warns(UserWarning, match="miss a target"):
        mixing.fit_rates(spark.createDataFrame([(10, [0.5, 0.5])] * 5, "n_tokens long, posterior array<double>"), ["r", "b"], {"r": 0.9, "b": 0.1})


def test_fingerprints(docs, corpus):
    out = simhash.fingerprint_documents(docs, rows_per_range=4).collect()
    assert ids(out) == every(corpus)
    by = {r["doc_id"]: r for r in out}
    assert by[3]["fingerprint"] == by[4]["fingerprint"] == by[5]["fingerprint"] == "0" * 16
    assert by[1]["near_class"] == by[8]["near_class"] and by[1]["class_docs"] == 2
    assert by[2]["n_chars"] == 1_000_000


def test_paragraphs(docs, corpus):
    out = paragraph_dedup.remove_repeated_paragraphs(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert ids(rows) == every(corpus)
    text = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None}
    assert text[8].split() == ["end"] and text[1] == corpus[0][1] and text[2] == corpus[1][1] and text[3] is None
    assert all(r["text"] == corpus[5][1] for r in rows if r["doc_id"] == 6)


def test_packing(docs, corpus):
    out = packing.pack_documents(docs).collect()
    assert ids([r for r in out if r["piece"] == 0]) == every(corpus)
    assert all(r["length"] == 4096 for r in out if r["doc_id"] == 1 and (r["piece"] + 1) * 4096 <= sum(x["length"] for x in out if x["doc_id"] == 1))
    ends = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096


def test_token_ids_equal_the_library():
    """Quotes, brackets, contractions, marks, combining marks, emoji, odd spaces and special strings."""
    from array import array

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.DEFAULT_TOKENIZER)
    library, own = Tokenizer.from_file(path), packing.ChunkIds(path)
    assert own.known
    rng = random.Random(1)
    alphabet = "aZé ßÀ.,'\"”’“!?…-–—()[]{}<>|#$%&*\n\t\r\x0b\x0c\x1c\x1f\x85\xa0　​٠١" + "19²½ªºµ×÷̸́İΣσ😀中文日ñ'sT'LLreveMD_^~`=+/\\@:;\x00\x7f€™"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14))) for _ in range(6000)] + ["<|endoftext|>a", "x <|startoftext|>'s", "'sun it's IT'S", ').\'."', "." * 300, "a" * 300]
    got = [b"".join(parts) for parts in own.encode(texts)]
    assert got == [array("I", e.ids).tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    other = packing.ChunkIds(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.known and [b"".join(p) for p in other.encode(["Hello  it's"])] == [array("I", Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode("Hello  it's", add_special_tokens=False).ids).tobytes()]


def test_frequent_words_are_encoded_once(monkeypatch):
    """What each batch has stays known while rare words come and go; ids are the library's throughout."""
    from array import array

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.DEFAULT_TOKENIZER)
    monkeypatch.setattr(packing, "CHARS_KEPT", 3000)
    library, own, learned = Tokenizer.from_file(path), packing.ChunkIds(path), []
    learn = own._words
    monkeypatch.setattr(own, "_words", lambda words: learned.extend(words) or learn(words))
    rng = random.Random(3)
    for _ in range(40):
        texts = ["often, the same " + "".join(rng.choice("aeiounst") for _ in range(9)) for _ in range(30)]
        assert [b"".join(parts) for parts in own.encode(texts)] == [array("I", e.ids).tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        assert len(own) < 300
    assert [learned.count(w) for w in ("often", "the", "same")] == [1, 1, 1] and len(learned) > 1000


def test_a_large_vocabulary_is_encoded_once(monkeypatch):
    """As many words as a worker meets in tens of thousands of texts are still known when they come again."""
    from itertools import batched, product

    import public_tokenizers

    own, learned = packing.ChunkIds(public_tokenizers.path(packing.DEFAULT_TOKENIZER)), []
    learn = own._words
    monkeypatch.setattr(own, "_words", lambda words: learned.append(len(words)) or learn(words))
    texts = [" ".join(map("".join, words)) for words in batched(product("etaoinshrdlu", repeat=5), 5000)]
    first = [b"".join(own.encode([t])[0]) for t in texts]
    assert sum(learned) == 12**5
    assert [b"".join(own.encode([t])[0]) for t in texts] == first
    assert sum(learned) == 12**5


def test_workers_let_go_of_what_packing_keeps(spark):
    """A worker that has packed holds the tokenizer and its words; the next operator's task lets go of them."""
    import sys

    def held():
        return lambda column: [[sum(isinstance(v, dict) and any(type(c).__name__ == "ChunkIds" for c in v.values()) for v in vars(sys).values())] * len(column)]

    rows = spark.createDataFrame([(i, f"words of text {i}") for i in range(8)], "doc_id long, text string").coalesce(1)
    assert packing.pack_documents(rows).count() == 8
    assert {r["n"] for r in common.arrow_map(rows.select("doc_id"), "n long", held).collect()} == {0}


def test_batches_hold_little_text(spark):
    """A worker, and the executor that fills its batches, never hold more than about 1 MB of texts and one text at once."""
    rows = spark.range(1000, numPartitions=1).select("id", F.rpad(F.col("id").cast("string"), 16384, "x").alias("text"))

    def held():
        return lambda texts: [[sum(map(len, texts))]]

    def beside():
        return lambda texts: [sum(map(len, texts))] * len(texts)

    n = [r["n"] for r in common.arrow_map(rows.select("text"), "n long", held).collect()]
    assert sum(n) == 1000 * 16384 and max(n) <= 1.1 * 2**20
    assert [r["n"] <= 1.1 * 2**20 for r in rows.select(common.arrow_column("long", beside)("text").alias("n")).collect()] == [True] * 1000


def test_languages(docs, corpus):
    out = langid.predict_languages(docs).collect()
    assert ids(out) == every(corpus)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (3, 4, 5)} == {"und"} and len({(r["lang_pred"], r["score"]) for r in out if r["doc_id"] == 6}) == 1


def test_toxicity(docs, corpus, labels):
    out = toxicity.score_toxicity(docs, labels).collect()
    assert ids(out) == every(corpus) and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] == 6}) == 1 and len({r["score"] for r in out if r["doc_id"] in (3, 4, 5)}) == 1
    scored = toxicity.fit_toxicity_model(docs, labels).score(docs, "mine")
    assert scored.columns == [*docs.columns, "mine"] and scored.first()["score"] == "own score"


def test_label_model_needs_no_labels():
    """Voters that agree by chance, by class, and because one copies another: the class comes out, and the copy leans on its model."""
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.4
    rate = lambda a, b: (rng.random(4000) < np.where(y, a, b)).astype(float)
    votes = np.stack([rate(0.6, 0.03), rate(0.5, 0.05), rate(0.4, 0.02), rate(0.3, 0.01), rate(0.2, 0.2)], 1)
    copy = np.where(rng.random(4000) < 0.95, votes[:, 0], 1 - votes[:, 0])
    model = toxicity.label_model(np.column_stack((votes, copy)), np.arange(4))
    assert ((model.posterior > 0.5) == y).mean() > 0.85
    assert np.abs(model.rates[1, :4] - [0.6, 0.5, 0.4, 0.3]).max() < 0.08 and np.abs(model.rates[0, :4] - [0.03, 0.05, 0.02, 0.01]).max() < 0.05
    assert model.leans_on[5] == 0 or model.leans_on[0] == 5


def test_label_model_keeps_kinds_of_toxic_texts_together():
    """One kind of toxic text speaks to a few frequent voters, three others to many rare ones: all are one class, with no clean one in it (by votes alone 0.63 of the first kind)."""
    rng = np.random.default_rng(2)
    kind = rng.choice(5, 6000, p=[0.64, 0.22, 0.06, 0.04, 0.04])  # 0: clean
    words = np.concatenate([(rng.random((6000, n)) < np.where(kind == k, rate, 0.0)[:, None]) for k, n, rate in ((1, 10, 0.5), (2, 17, 0.3), (3, 17, 0.3), (4, 16, 0.3))], axis=1)
    words[:, -1] |= (kind == 0) & (rng.random(6000) < 0.01)
    lists = np.stack([words[:, :10].any(axis=1), words[:, [1, 12]].any(axis=1), words[:, [1, 30]].any(axis=1)], axis=1)
    listed = words.sum(axis=1)
    votes = np.column_stack((lists, words, listed >= 2, listed >= 5, listed == 0)).astype(float)
    label = (kind > 0) ^ (rng.random(6000) < 0.03)
    model = toxicity.label_model(votes, np.arange(63), np.where(label, toxicity.LABEL_EVIDENCE, -toxicity.LABEL_EVIDENCE))
    assert all(((model.posterior > 0.5) == (k > 0))[kind == k].mean() > 0.97 for k in range(5))


def test_lists_of_a_sample_are_views():
    column = pa.chunked_array([pa.array([[1, 2], [], [3]], pa.list_(pa.int32())), pa.array([[4]] * 3, pa.list_(pa.int32())).slice(1)])
    lists = common.lists_in(column)
    assert [x.tolist() for x in lists] == [[1, 2], [], [3], [4], [4]] and all(not x.flags.owndata for x in lists)


def test_letters_are_counted_of_lines_with_capitals(spark):
    """The first look at a line lets through every line that has too many capitals, and few others."""
    rows = [("A" * n + "a" * m + ".", n) for n in range(9, 23) for m in range(0, 25)]
    lines = spark.createDataFrame([(x, n, len(x) - 1 >= 20 and 2 * n > len(x) - 1) for x, n in rows], "line string, n int, bad boolean")
    out = lines.select("n", "bad", quality.bad_line(F.col("line")).alias("got"), F.col("line").rlike(quality.CAPITALS).alias("seen")).collect()
    assert all(r["got"] == r["bad"] and r["seen"] == (r["n"] > 10) for r in out)


def test_runs_of_pages_are_dealt_by_their_hash_alone(spark, monkeypatch):
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    real = common.materialize
    monkeypatch.setattr(common, "materialize", noted)
    monkeypatch.setattr(html_text, "materialize", noted)
    footer = "all the words of one long notice that every page of this host ends with again and again today"
    pages = [(i, f"http://h{i % 2}.org/{i}", f"<div>own {i} text of page {i * 7} here</div><div>{footer} {'x' if i % 2 else 'y'}</div>") for i in range(8)]
    pages += [(20, "http://other.org/1", f"<div>{footer} y</div>")]
    out = {r["page_id"]: r["text"] for r in html_text.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    # a run counts within its host only
    assert out == {i: f"own {i} text of page {i * 7} here" for i in range(8)} | {20: f"{footer} y"}
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", "\n".join(plans))
    assert not any("run#" in x and x.count("#") > 1 for x in dealt), dealt


def test_join(docs, corpus):
    out = jaccard_join.jaccard_components(docs)
    assert dict(out.dtypes)["n_shingles"] == "bigint"
    rows = out.collect()
    assert ids(rows) == every(corpus)
    by = {r["doc_id"]: r for r in rows}
    assert by[8]["component_id"] == by[1]["component_id"] == 1 and by[2]["n_shingles"] == 1 and by[2]["component_id"] == 2
    assert by[3]["n_shingles"] == 0 and by[3]["component_id"] == 3
    left = jaccard_join.keep_one_of_each(docs)
    # one of the two rows of 6 and the first of the two long texts stay; both rows without an id do
    assert left.columns == docs.columns and ids(left.collect()) == sorted([-1, -1, *({*every(corpus)} - {8, -1})])


def test_large_overlapping_groups_join_exactly(spark):
    """Three groups around hubs, of which only the hubs are alike enough to join copies; as the exact result has it."""
    rng = random.Random(17)
    base = [f"u{i}" for i in range(220)]
    texts, rows = [], []
    for g in range(3):
        hub = list(base)
        for j in range(4 * g):
            hub[50 * (j % 4) + j] = f"hub{g}x{j}"
        texts.append(hub)
        for _ in range(60):
            copy = list(hub)
            for p in rng.sample(range(0, 220, 5), rng.randint(1, 5)):
                copy[p] = f"new{rng.randint(0, 10**9)}"
            texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(t[i : i + 4]) for i in range(len(t) - 3)} for t in texts]
    label = list(range(len(sets)))
    changed = True
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    assert found == dict(enumerate(label))


def test_token_counts(docs, corpus):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.DEFAULT_MODEL))
    out = token_counts.token_counts(docs).collect()
    assert ids(out) == every(corpus)
    text = {d: t or "" for d, t in corpus if d is not None}
    assert all(r["n_tokens"] == len(sp.encode(text[r["doc_id"]])) and r["n_bytes"] == len(text[r["doc_id"]].encode()) for r in out if r["doc_id"] is not None)
