"""The ten operators on small tables with nulls, empty texts, ties, copies and extra columns."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

np = pytest.importorskip("numpy")
llm = pytest.importorskip("trailspark.llm")
from trailspark.llm import common, html_text, jaccard_join, langid, mixing, packing, paragraph_dedup, quality, simhash, token_counts, toxicity  # noqa: E402

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "lambda", "zeta", "iota", "rho"]


def text(rng, n):
    return " ".join(f"{rng.choice(WORDS)}{rng.randint(0, 99)}" for _ in range(n)) + "."


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    base = [text(rng, 120) for _ in range(12)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(base)]
    for j in range(40):  # near copies of the first, more than a light list holds
        words = base[0].split(" ")
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 10**6)}"
        rows.append((100 + j, " ".join(words), "en", "s", 1))
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0), (202, " \n ", "en", "s", 3), (203, "one two", "en", "s", 7), (203, "one two", "en", "s", 7), (None, base[1], "en", "s", 1), (204, "  a  b \n c  ", "en", "s", 9)]
    rows += [(300 + j, text(rng, 30) + "\n" + base[2], "en", "s", 1) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumn("k", F.lit("clash")).withColumn("th", F.lit(1)).withColumn("label", F.lit("x"))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id = -1")


def brute_components(rows, width, percent):
    sets = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    ids = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            ids[root(i)] = min(ids.get(root(i), r["doc_id"]), r["doc_id"])
    return sorted(((-1 if r["doc_id"] is None else r["doc_id"]), len(sets[i]), ids.get(root(i), -1)) for i, r in enumerate(rows))


def test_jaccard_components_equal_brute_force(docs, empty):
    found = jaccard_join.jaccard_components(docs).collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in found) == brute_components(docs.collect(), 4, 85)
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_one_of_each_stays(docs, empty):
    left = jaccard_join.keep_one_of_each(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    classes = brute_components(docs.collect(), 5, 80)
    assert {r["doc_id"] for r in rows if r["doc_id"] is not None} == {c[2] for c in classes if c[1]} | {200, 201, 202}
    assert sum(r["doc_id"] == 203 for r in rows) == 1
    assert jaccard_join.keep_one_of_each(empty).count() == 0


def test_repeated_paragraphs_stay_once(docs, empty):
    out = paragraph_dedup.remove_repeated_paragraphs(docs).collect()
    base = docs.filter("doc_id = 2").first()["text"]
    assert sum(base in (r["text"] or "") for r in out) == 1
    assert all(base not in r["text"] and r["text"] for r in out if (r["doc_id"] or 0) >= 300)
    assert [r["text"] for r in out if r["doc_id"] == 200] == [None]
    assert paragraph_dedup.remove_repeated_paragraphs(empty).count() == 0
    bands, rows = paragraph_dedup.tune_bands(0.8, 0.99)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99


def test_passages_in_other_lines_stay_once(spark):
    rng = random.Random(8)
    words = lambda n: [f"{rng.choice(WORDS)}{rng.randint(0, 9999)}" for _ in range(n)]
    plain, changed, wrapped = words(50), words(50), words(50)
    wrap = lambda ws, n: "\n".join(" ".join(ws[i : i + n]) for i in range(0, len(ws), n))
    rows, alone = [], {}

    def add(doc, passage):
        before, after = words(60), words(60)
        rows.append((doc, " ".join(before) + " " + passage + " " + " ".join(after)))
        alone[doc] = before + after

    for i in range(20):
        add(i, " ".join(plain))
        add(100 + i, wrap(wrapped, 5 + i))
        mine = list(changed)
        if i:
            mine[(5, 12, 25, 38, 44)[i % 5]] = f"new{i}"
        add(200 + i, " ".join(mine))
    out = {r["doc_id"]: r for r in paragraph_dedup.remove_repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for first in (0, 100, 200):
        assert out[first]["text"] == dict(rows)[first] and not out[first]["removed"]
        assert all(out[first + i]["text"].split() == alone[first + i] for i in range(1, 20))
    texts = dict(rows)
    assert all("".join(texts[d][s["start"] : s["start"] + s["length"]] for s in r["removed"]).split() for d, r in out.items() if d % 100)


def test_words_of_a_batch_are_hashed_once(monkeypatch):
    """Hashes are those of the words one by one, over borders of blocks too; a batch hashes no word twice."""
    import xxhash

    rng = random.Random(9)
    alphabet = "aAbBzZ.éÉß日😀\x00\x1c\x85\xa0"
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 12))) for _ in range(300)] + ["long" * 50]
    texts = [None, "", " \n "] + ["".join(rng.choice(words) + rng.choice(" \n\t\r\x0b\x0c") * rng.choice((1, 1, 90)) for _ in range(200)) for _ in range(10)]
    texts += [" ".join(f"w{i}" for i in range(120_000))] * 2  # more than a worker used to remember
    expected = [[xxhash.xxh64_intdigest(w) for w in (t or "").encode().lower().split()] for t in texts]
    hashed, digest = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda w: hashed.append(w) or digest(w))
    for block in (64, 1 << 16):
        monkeypatch.setattr(paragraph_dedup, "BLOCK", block, raising=False)
        hashed.clear()
        lines, h, base = paragraph_dedup.Paragraphs(5)(texts)
        assert [h[a:b].tolist() for a, b in zip(base, base[1:], strict=False)] == expected
        assert len(hashed) == len(set(hashed)) == len({w for t in texts for w in (t or "").encode().lower().split()})
        cut = [(d, text.encode()[place : place + n].lower().split()) for d, place, n, _, _ in lines for text in [texts[d]]]
        assert cut == [(d, ws) for d, t in enumerate(texts) for ws in ([line.lower().split() for line in (t or "").encode().split(b"\n")]) if len(ws) >= 5]
        assert [h[a : a + n].tolist() for *_, a, n in lines] == [[digest(w) for w in ws] for _, ws in cut]
    assert paragraph_dedup.Paragraphs(5)([])[0] == []


def test_packing_is_gapless_and_whole(docs, empty):
    out = packing.pack_documents(docs, capacity=64).collect()
    ends = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 64
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.DEFAULT_TOKENIZER))
    whole = {}
    for r in docs.collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        whole.setdefault(r["doc_id"], []).append(sorted((i // 64, len(ids[i : i + 64]), zlib.crc32(ids[i : i + 64].tobytes())) for i in range(0, len(ids), 64)))
    for d, expected in whole.items():
        assert sorted(sum(expected, [])) == sorted((r["piece"], r["length"], r["ids_crc32"]) for r in out if r["doc_id"] == d)
    assert packing.pack_documents(empty).count() == 0


def test_packing_plan_gives_every_rank_a_place():
    rng = random.Random(1)
    counts = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(60)}
    used, ranks = {}, {}
    for length, first, n, seq, per, offset in packing.plan_packing(counts, 100):
        assert ranks.get(length, 0) == first
        ranks[length] = first + n
        for k in range(n):
            used.setdefault(seq + k // per, []).append((offset + k % per * length, length))
    assert ranks == counts
    for spots in used.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 100


def test_token_counts_equal_the_library(docs, empty):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.DEFAULT_MODEL))
    odd = ["", " ", "\n", "a\n\nb ", "  a", "<s> ▁x", "é  z", "a \n  b"]
    counts = token_counts.PieceCounts(public_tokenizers.path(token_counts.DEFAULT_MODEL))
    assert [counts.text(t) for t in odd] == [len(sp.encode(t)) for t in odd]
    texts = [r["text"] or "" for r in docs.collect()]
    for common_ones in (0, 5, token_counts.COMMON):  # all by the shuffle, some, and all that repeat sent to tasks
        assert sorted(r["n_tokens"] for r in token_counts.token_counts(docs, most_common=common_ones).collect()) == sorted(len(sp.encode(t)) for t in texts)
    assert token_counts.token_counts(empty).count() == 0


def test_fingerprints(spark, docs, empty):
    rows = simhash.fingerprint_documents(docs, rows_per_range=5).collect()
    assert len(rows) == docs.count()
    by_text = {}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in rows:
        by_text.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
        assert 0 <= r["near_next"] <= 1 and r["n_chars"] == len(texts[r["doc_id"]])
    assert all(len(v) == 1 for v in by_text.values())
    assert simhash.fingerprint_documents(empty).count() == 0
    # the whole of it by brute force: next and edited texts, votes of the terms, likeness and classes
    import hashlib

    from pyspark.sql import functions as F

    terms = {}
    for r in docs.select("text", simhash.term_hashes(F.coalesce("text", F.lit(""))).alias("h")).collect():
        terms[r["text"] or ""] = r["h"]

    def bits_of(h):
        return sum(1 << b for b in range(63) if sum(x >> b & 1 for x in h) * 2 > len(h))

    order = sorted(docs.filter("doc_id <> 203 and doc_id is not null").collect(), key=lambda r: r["doc_id"])
    got = {r["doc_id"]: r for r in simhash.fingerprint_documents(docs.filter("doc_id <> 203 and doc_id is not null"), rows_per_range=7).collect()}
    edited = []
    for r, after in zip(order, [*order[1:], order[0]], strict=True):
        t, n = r["text"] or "", after["text"] or ""
        edited.append(t[: len(t) - len(t) // 2] + n[: len(t) // 2])
    hashes = [r["h"] for r in spark.createDataFrame([(i, e) for i, e in enumerate(edited)], "i long, e string").orderBy("i").select(simhash.term_hashes(F.col("e")).alias("h")).collect()]
    prints = [bits_of(terms[r["text"] or ""]) for r in order]
    for i, r in enumerate(order):
        g = got[r["doc_id"]]
        assert (g["edited_sha256"], g["fingerprint"], g["edited_fingerprint"]) == (hashlib.sha256(edited[i].encode()).hexdigest(), f"{prints[i]:016x}", f"{bits_of(hashes[i]):016x}")
        assert g["near_next"] == pytest.approx(1 - bin(prints[i] ^ prints[(i + 1) % len(prints)]).count("1") / 63)
        assert g["near_edited"] == pytest.approx(1 - bin(prints[i] ^ bits_of(hashes[i])).count("1") / 63)
    label = {p: p for p in prints}
    for _ in prints:
        for a in label:
            label[a] = min(label[b] for b in label if bin(a ^ b).count("1") <= 3)
    assert all(got[r["doc_id"]]["near_class"] == f"{label[p]:016x}" for r, p in zip(order, prints, strict=True))
    assert all(got[r["doc_id"]]["class_docs"] == sum(label[q] == label[p] for q in prints) for r, p in zip(order, prints, strict=True))
    rng = random.Random(2)
    prints = [rng.getrandbits(63) for _ in range(60)]
    prints += [p ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for p in prints]
    df = spark.createDataFrame([(p,) for p in prints], "f long")
    expected = {(a, b) for a in set(prints) for b in set(prints) if a < b and bin(a ^ b).count("1") <= 3}
    assert {(r["a"], r["b"]) for r in simhash.near_fingerprints(df, 3).collect()} == expected


def test_quality(docs, empty):
    out = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    assert not out[200]["kept"] and out[200]["n_words"] == 0
    assert out[0]["kept"] and out[0]["n_repeat_words"] == 0
    line = "one two three four five six seven eight nine ten eleven twelve."
    df = docs.sparkSession.createDataFrame([(1, "\n".join([line] * 3)), (2, "\n".join(["Home | News | Sport | Shop | More"] * 3 + [line, line + " x."]))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.quality_rules(df).collect()}
    assert got[1]["n_repeat_words"] == 36 and got[1]["base_failed"] and got[1]["n_dup_lines"] == 2
    assert got[2]["clean_text"].count("|") == 0 and not got[2]["kept"]
    assert quality.quality_rules(empty).count() == 0


def test_main_text():
    page = '<html><head><title>T</title><script>a<b</script></head><body><nav><a>menu</a></nav><div class="cookie-notice">ok?</div><article><h1>Head &amp; tail</h1><p>First  line<p>Second<aside>side</aside><div class="ad">buy</div></article><div id="comments">first!</div><footer>f</footer>'
    assert html_text.main_texts([html_text.blocks_of(page)]) == ["Head & tail\nFirst line\nSecond"]
    same = "our site has all the news of all the towns around here"
    pages = [f"<div>{same}</div><div>story {i} " + " ".join(f"w{i}x{k}" for k in range(20)) + "</div>" for i in range(6)]
    out = html_text.main_texts([html_text.blocks_of(p) for p in pages])
    assert all(same not in t and t.startswith("story") for t in out)
    assert html_text.main_texts([html_text.blocks_of(p) for p in (None, "", "plain &lt; text", "<p", "<!-- x")])[:3] == ["", "", "plain < text"]


def test_main_text_query_rows(spark):
    df = spark.createDataFrame([(1, "http://a/x", "<p>hello"), (None, None, None), (1, "http://a/x", "<p>hello")], "page_id long, url string, html string")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_text.extract_main_text(df).collect()) == [(0, "", 0), (1, "hello", 5), (1, "hello", 5)]


def test_boilerplate_is_found_over_the_whole_host(spark):
    note = "all prices on this page are without any warranty of ours"
    story = lambda i: f"story {i} " + " ".join(f"w{i}x{k}" for k in range(20))
    rows = [(i, f"http://a/{i}", f"<div>{story(i)}</div>" + (f"<div>{note}</div>" if i % 75 == 0 else "")) for i in range(300)]
    rows += [(i, "http://b/x", f"<div>{story(300)}</div><div>{note}</div>") for i in (300, 301)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for partitions in (1, 7):
        out = {r["page_id"]: r["text"] for r in html_text.extract_main_text(df, partitions=partitions).collect()}
        assert all(out[i] == story(i) for i in range(300))
        # what only copies of one page have is its own text
        assert out[300] == out[301] == f"{story(300)}\n{note}"


def test_main_texts_over_tables_equal_the_suffix_array(spark, empty):
    rng = random.Random(12)
    pool = [" ".join(f"{rng.choice(WORDS)}{rng.randint(0, 999)}" for _ in range(n)) for n in (4, 7, 8, 9, 15, 16, 17, 20, 24, 30)]
    rows = []
    for i in range(90):
        host = rng.choice(("a", "b", "c", "d"))
        parts = [rng.choice(pool) if rng.random() < 0.5 else text(rng, rng.randint(3, 40)) for _ in range(5)]
        if i % 3 == 0:  # two blocks, one cut by a repeated run in the middle
            parts[1] = text(rng, 5) + " " + rng.choice(pool) + " " + text(rng, 5)
        main = rng.random() < 0.5
        body = "".join(f"<p>{p}</p>" for p in parts)
        rows.append((i, f"http://{host}/{i}", f"<nav>{pool[9]}</nav>" + (f"<article>{body}</article><p>{pool[8]}</p>" if main else f"<div>{body}</div>")))
    rows += [(100, rows[0][1], rows[0][2]), (101, None, rows[1][2]), (102, "http://e/", None), (103, "http://e/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("h", F.lit("clash")).withColumn("text", F.lit("clash"))
    out = {r["page_id"]: r for r in html_text.extract_main_text(df, partitions=5).collect()}
    hosts = {}
    for i, url, page in rows:
        hosts.setdefault((url or "").removeprefix("http://").split("/")[0], []).append((i, html_text.blocks_of(page)))
    expected = {i: t for ps in hosts.values() for (i, _), t in zip(ps, html_text.main_texts([b for _, b in ps]), strict=True)}
    assert {i: r["text"] for i, r in out.items()} == expected
    # runs are cut from pages with and without a main zone
    assert {("<article>" in rows[i][2]) for i, r in out.items() if i < 90 and r["n_removed"]} == {True, False}
    assert html_text.extract_main_text(df.filter("page_id < 0")).count() == 0


def test_languages(spark, empty):
    rng = random.Random(4)
    kinds = {"aa": "abcde", "bb": "vwxyz"}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(5)) for _ in range(20)), k) for i in range(120) for k in [("aa", "bb")[i % 2]]]
    df = spark.createDataFrame([*rows, (500, None, "aa"), (501, "12 ..", "bb"), (None, rows[0][1], "aa")], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in langid.predict_languages(df).collect()}
    assert out[500]["lang_pred"] == out[501]["lang_pred"] == "und"
    assert all(out[i]["lang_pred"] == k for i, _, k in rows)
    assert langid.predict_languages(empty).count() == 0


def test_letters_beyond_the_first_plane():
    grams = langid.Grams()
    assert grams("\U0001f600 \U0001f680\U0001f680") is None
    assert grams("\U00010428\U00010429") is not None
    assert all((x == y).all() for x, y in zip(grams("ab \U0001f600 c"), grams("ab c"), strict=True))


def test_toxicity(spark, empty):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, text(rng, 40) + (" you idiot and moron" if bad else "")))
        labels.append((i, int(bad)))
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None), (7777, 1)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(df, lab).collect()}
    assert all(out[i]["predicted"] == y for i, y in labels)
    assert out[900]["predicted"] == out[901]["predicted"] == 0
    assert toxicity.score_toxicity(empty.select("doc_id", "text"), lab.limit(0)).count() == 0
    assert toxicity.normal_word("1d10t!!") == ("idiot", True)


def test_disguised_learnt_words_are_toxic(spark):
    rng = random.Random(9)
    rows = [(i, text(rng, 40) + (" you zorgblat" if i % 3 == 0 else "")) for i in range(300)]
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity_model(spark.createDataFrame(rows, "doc_id long, text string"), lab)
    assert "zorgblat" in model.mined
    new = spark.createDataFrame([(i, text(rng, 40) + end) for i, end in enumerate((" you z0rgbl4t", " you zorgblaaaat", " you zorgblat", " you there"))], "doc_id long, text string")
    assert [r["score"] >= 0.5 for r in model.score(new).orderBy("doc_id").collect()] == [True, True, True, False]


def test_rates_meet_targets(spark, empty):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(("red", "blue")[i % 2 : i % 2 + 1]) + str(rng.randint(0, 9)) for _ in range(30))) for i in range(200)]
    df = spark.createDataFrame([*rows, (900, None)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, ("r", "b")[i % 2]) for i in range(0, 100)], "doc_id long, domain string")
    out = mixing.document_rates(df, lab, {"r": 0.8, "b": 0.2}).toPandas()
    share = (np.stack(out.posterior) * (out.n_tokens * out.rate).to_numpy()[:, None]).sum(0) / out.n_tokens.sum()
    assert np.allclose(share, [0.2, 0.8], atol=1e-3) and (out.rate >= 0).all()
    assert mixing.document_rates(df, lab.limit(0), {"r": 1.0}).agg(F.min("rate"), F.max("rate")).first()[:] == (1.0, 1.0)
    assert mixing.document_rates(empty, lab.limit(0)).count() == 0


def test_domains_without_a_target_get_no_share(spark):
    rng = random.Random(10)
    kinds = ("red", "blue", "green", "grey")
    rows = [(i, " ".join(kinds[i % 4] + str(rng.randint(0, 9)) for _ in range(30))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, kinds[i % 4]) for i in range(200)], "doc_id long, domain string")
    out = mixing.document_rates(df, lab, {"red": 0.7, "blue": 0.3}).toPandas()
    share = {d: (g.n_tokens * g.rate).sum() / out.n_tokens.sum() for d, g in out.groupby("domain")}
    assert abs(share["red"] - 0.7) < 0.01 and abs(share["blue"] - 0.3) < 0.01 and share[mixing.REST] < 0.01


def test_tables_are_released(spark, docs):
    import os

    with common.tables_made() as made:
        kept = common.settled(spark, lambda: common.materialize(docs).filter("doc_id < 5"))
    assert len(made) == 1 and kept.count() == 5
    common.release(spark, made)
    assert not os.path.exists(made[0].removeprefix("file://"))
