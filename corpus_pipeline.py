"""A training corpus from documents: toxic texts out, one of near duplicates, repeated paragraphs out, mixed, packed.

Each stage is one of the operators of ``trailspark.llm``; it gets the rows its predecessor wrote and,
but for the last, returns the columns of documents, in their order, with any extra ones.

Edge cases: a null or empty text is clean, has no near duplicate, loses no paragraph and is packed as the
end id alone, if its rate lets it stay; a null doc_id is a document like others (the last of its group);
rows with equal doc_id and text become one at near duplicates; an empty table stays empty; extra columns,
whatever their names, are carried along up to packing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.llm.common import fresh, release, shared_dir, table, tables_made
from trailspark.llm.jaccard_join import keep_one_of_each
from trailspark.llm.mixing import mix
from trailspark.llm.packing import pack_documents
from trailspark.llm.paragraph_dedup import remove_repeated_paragraphs
from trailspark.llm.queries import labelled_domains
from trailspark.llm.toxicity import fit_toxicity_model

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: rows whose score is 0.5 or more go; labels of every fifth document aren't learned from."""
    labels = table(spark, sf_dir, "labels").filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    model = fit_toxicity_model(docs, labels)
    (score,) = fresh(docs, "score")
    return model.score(docs, score).filter(F.col(score) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each group of documents linked at 0.8 on five-word shingles the first stays."""
    return keep_one_of_each(docs)


def drop_repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: repeated paragraphs are cut out of the texts; no document goes."""
    out = remove_repeated_paragraphs(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: rows are repeated or left out as their rates say."""
    return mix(docs, labelled_domains(docs, table(spark, sf_dir, "labels")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the documents as pieces of sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("paragraph_dedup", drop_repeated_paragraphs),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores, hashed samples and packing aren't SQL: the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again; only the last one's table stays."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}/{name}"
        with tables_made() as made:
            try:
                stage(spark, docs, sf_dir).write.parquet(path)
            finally:
                release(spark, [*made, *before])
                made.clear()
        docs, before = spark.read.parquet(path), [path]
    return docs
