"""The five stages on small tables, each judged on its own input, and all of them together."""

import os
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("trailspark.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from trailspark.llm import mixing  # noqa: E402
from trailspark.llm.queries import labelled_domains  # noqa: E402

WORDS = [f"word{i}" for i in range(400)]
INSULTS = ["idiot", "moron", "scum", "worthless", "pathetic"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of documents and labels; what is toxic, a near copy of another, and what holds the passage."""
    rng = random.Random(21)
    passage = prose(rng, 70)
    docs, labels, toxic, copies, holders = [], [], [], [], []
    for i in range(300):
        t = prose(rng, rng.randint(60, 200))
        if i % 6 == 0:
            at = t.split(" ")
            for w in rng.sample(INSULTS, 3):
                at.insert(rng.randrange(len(at)), w)
            t = " ".join(at)
            toxic.append(i)
        elif i % 10 == 1:
            t += " " + passage + " " + prose(rng, 40)
            holders.append(i)
        docs.append((i, t, rng.choice(("en", "de")), "s1", len(t)))
        if i % 3 != 2:
            labels.append((i, rng.randint(0, 1), int(i % 6 == 0)))
    for j, base in enumerate((2, 3, 4, 5)):
        words = docs[base][1].split(" ")
        words[len(words) // 2] = "changed"
        docs.append((1000 + j, " ".join(words), "en", "s2", 1))
        copies.append(1000 + j)
    docs += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (2002, "one two", "en", "s", 7), (2002, "one two", "en", "s", 7), (None, prose(rng, 80), "en", None, 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("score", "predicted", "removed", "label", "mixture", "th", "k", "d", "t", "found", "stays", "lane"):
        df = df.withColumn(c, F.lit(f"own {c}"))
    where = f"file://{tmp_path_factory.mktemp('corpus')}"
    df.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, set(toxic), set(copies), holders, passage


@pytest.fixture(scope="module")
def stages(spark, corpus, tmp_path_factory):
    """What each stage gets and gives, as rows."""
    out = tmp_path_factory.mktemp("stages")
    docs, seen = spark.read.parquet(f"{corpus[0]}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, corpus[0]).write.parquet(f"file://{out}/{name}")
        after = spark.read.parquet(f"file://{out}/{name}")
        seen.append((docs, after))
        docs = after
    return seen


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_toxic_documents_go_and_clean_ones_stay(stages, corpus):
    before, after = stages[0]
    assert after.columns == before.columns
    kept = by_id(after)
    lost = set(by_id(before)) - set(kept)
    assert lost == corpus[1]
    assert all(r["score"] == "own score" for r in kept.values()) and after.count() == before.count() - len(lost)


def test_one_of_near_copies_stays(stages, corpus):
    before, after = stages[1]
    assert after.columns == before.columns
    assert set(by_id(before)) - set(by_id(after)) == corpus[2]
    assert after.filter("doc_id = 2002").count() == 1 and before.filter("doc_id = 2002").count() == 2
    assert after.filter("doc_id in (2000, 2001)").count() == 2


def test_repeated_passages_go_and_no_document(stages, corpus):
    before, after = stages[2]
    assert after.columns == before.columns and after.count() == before.count()
    old, new = by_id(before), by_id(after)
    holders = [d for d in corpus[3] if d in new]
    assert corpus[4] in new[holders[0]]["text"]
    for d, r in new.items():
        if d in holders[1:]:
            assert r["text"].split() == old[d]["text"].replace(corpus[4], "").split() and r["n_chars"] == len(r["text"])
        else:
            assert r["text"] == old[d]["text"]


def test_rows_come_as_often_as_their_rates_say(spark, stages, corpus):
    before, after = stages[3]
    assert after.columns == before.columns
    rates = {r["doc_id"]: r["rate"] for r in mixing.document_rates(before, labelled_domains(before, spark.read.parquet(f"{corpus[0]}/labels.parquet"))).collect()}
    often = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert all(int(rate) <= often.get(d, 0) <= int(rate) + 1 for d, rate in rates.items())
    old = by_id(before)
    assert all(r["text"] == old[d]["text"] for d, r in by_id(after).items())


def test_every_document_is_packed(stages):
    before, after = stages[4]
    assert sorted(r["doc_id"] or -1 for r in after.filter("piece = 0").collect()) == sorted(r["doc_id"] or -1 for r in before.collect())


def test_the_plan_holds_the_posterior_once(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    labels = labelled_domains(docs, spark.read.parquet(f"{corpus[0]}/labels.parquet"))
    model = mixing.fit_domains(docs, labels)
    plan = docs.select(model.posterior(F.col("text")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert len(mixing.mix(docs, labels)._jdf.queryExecution().toString()) < 500_000


def test_run_leaves_one_table(spark, corpus):
    from trailspark.llm.common import shared_dir, tables_made

    folder = shared_dir(spark).removeprefix("file://")

    def tables():
        found = set()
        for kind in ("tables", "pipeline"):
            for d, _, files in os.walk(f"{folder}/{kind}"):
                if "_SUCCESS" in files:
                    found.add(d)
        return found

    before = tables()
    with tables_made() as made:
        out = corpus_pipeline.run(spark, corpus[0])
    assert out.columns[:2] == ["doc_id", "piece"] and not made
    assert len(tables() - before) == 1


def test_an_empty_table_stays_empty(spark, corpus, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{corpus[0]}/{name}.parquet").filter("doc_id = -1").write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
