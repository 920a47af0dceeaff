"""A corpus from raw documents to packed sequences. Each stage works on all that the one before it kept.

All stages but the last return the columns they are given, whatever their names; a column that a stage does not name
passes through. A row counts as a document of its own, also where doc_id repeats or is null. No rows give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import decontaminate, jaccard, language, packing, secrets
from daybook.llm.common import held_out, table, work_dir
from daybook.llm.queries import tokenizer_path


def whole(docs: DataFrame):
    """A row as one value, out of reach of other columns' names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; texts that are null or have no letter go. lang is learned from and never replaced."""
    learned = language.learn_dictionaries(docs.where(~held_out()).select("text", "lang"))
    told = language.identify(docs.select(whole(docs).alias("row"), "text"), learned)
    return told.where("not rejected").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the smallest doc_id, a null one last, and of those the smallest text hash.

    Rows without words link with nothing and all stay. Of rows that share both id and text the least stays, by all columns.
    """
    classed = jaccard.classes(docs)
    first = classed.where("part is not null").groupBy("part").agg(
        F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "text_id")).alias("f")).select("f.doc_id", "f.text_id").distinct()
    key = F.xxhash64(F.coalesce(F.col("d.text"), F.lit("")))
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (key == F.col("f.text_id"))
    kept = docs.alias("d").join(first.alias("f"), same, "left_semi")
    chosen = kept.select(whole(docs).alias("row")).groupBy("row.doc_id", "row.text").agg(F.min("row").alias("row")).select("row.*")
    empty = classed.where("part is null").select("doc_id", "text_id").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("e.doc_id")) & (key == F.col("e.text_id"))
    return chosen.unionByName(docs.alias("d").join(empty.alias("e"), same, "left_semi"))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; each row is judged by its own text."""
    hit = decontaminate.contaminated_words(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id", "text_id").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.xxhash64(F.coalesce(F.col("d.text"), F.lit(""))) == F.col("h.text_id"))
    return docs.alias("d").join(hit.alias("h"), same, "left_anti")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars, where there is one, counted anew where something was. Null texts stay null."""
    masked = docs.select(whole(docs).alias("row"), secrets.redacted(F.col("text")).alias("masked"))
    fresh = {"text": F.col("masked").alias("text")}
    if "n_chars" in docs.columns:
        changed = ~F.col("masked").eqNullSafe(F.col("row.text"))
        fresh["n_chars"] = F.when(changed, F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")).alias("n_chars")
    return masked.select(*[fresh.get(c, F.col(f"row.`{c}`")) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2,048 tokens: the columns of ``packing.pack``. Null and empty texts are one end id."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", clean_of_benchmark),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs


ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
