"""A training corpus from raw documents: filter, deduplicate, decontaminate, sanitise, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows
as Parquet in the shared folder and reads them again as the next one's docs. All stages but
the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframe.llm import decontaminate, jaccard, quality, queries, sanitise
from nightframe.llm.blocks import ensure_checkpoint_dir, read, small

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2. Documents scored under the threshold go. Learned from the labels of documents
    whose crc32 mod 5 is not 0, as in its query."""
    labels = read(spark, sf_dir, "labels").where(queries.fold(5) != 0)
    ensemble = quality.train(docs, labels)
    return quality.scored(docs, ensemble).where("predicted = 1").select("row.*").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6. Of each group of linked documents the one with the least id stays. Rows that
    repeat an id are one document; the one with the least text stays."""
    groups = jaccard.jaccard_groups(docs).where("doc_id is not null")
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(small(gone), "doc_id", "left_anti")
    again = groups.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept.select(COLUMNS)
    # repeated ids are few rows; only they are sorted out
    repeated = kept.join(small(again), "doc_id", "left_semi")
    rest = F.struct(*[c for c in COLUMNS if c != "doc_id"])
    one = repeated.groupBy("doc_id").agg(F.min(rest).alias("r")).select("doc_id", "r.*").select(COLUMNS)
    return kept.join(small(again), "doc_id", "left_anti").select(COLUMNS).unionByName(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3. Documents of which a twentieth of the words or more is of the benchmark go."""
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hits(F.col("spans"))
    return found.where(~decontaminate.contaminated(F.col("n_words"), n_hit)).select("row.*").select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8. Personal data and the terms that disclose it are replaced in the text."""
    found = sanitise.sanitise(docs)
    text = F.when(F.col("row.text").isNotNull(), sanitise.redacted(F.col("row.text")))
    out = found.select(F.col("row.doc_id").alias("doc_id"), text.alias("text"), F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), F.col("row.n_chars").alias("before"))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "before")).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4. A row for each time that a document is read, with its epoch and the tokens taken."""
    mixed = queries.mixed(docs)
    return mixed.select("row.*", "domain", "n_tokens", "epoch", "taken").select(*COLUMNS, "domain", "n_tokens", "epoch", "taken")


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(COLUMNS)
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs


#: The quality stage is a trained model, which SQL cannot express.
ORACLE_SQL = None
