"""From raw documents to shards: language, near duplicates, benchmark leaks, mix, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudspark.llm.common import numbered, picked
from fraudspark.llm.decontaminate import contamination
from fraudspark.llm.jaccard import similar_documents
from fraudspark.llm.language import train, understood
from fraudspark.llm.mixing import mix
from fraudspark.llm.sharding import byte_shards
from fraudspark.sources.staging import stage

#: No SQL has the language model, the hashes of the mix or the checksum of the shards.
ORACLE_SQL = None
SEED = 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, null texts and texts far from every language go."""
    return understood(docs, train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over runs of five words, the one with
    the smallest id stays. Empty texts stay. Where ids are null or repeat, it is the first row."""
    rows, key = numbered(docs, "doc_id")
    found = similar_documents(rows, shingle=5, percent=80, id_col=key)
    gone = stage(found.where(F.col("component_id") != F.col(key)).select(key), "near-duplicates")
    return picked(rows, gone, key, "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside a benchmark window go."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"])
    found = contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row")
    return found.where("NOT contaminated").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words: the whole part of that ratio, and one
    more with the rest as its seeded chance. Documents without words are never taken."""
    rows, key = numbered(docs, "doc_id")
    chance = F.xxhash64(key, F.lit(SEED)).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    times = F.floor(F.col("taken") / F.col("size") + chance).cast("int")
    taken = mix(rows, id_col=key).where("size > 0").select(key, times.alias("times"))
    taken = stage(taken.where("times > 0").withColumnRenamed("times", f"{key}_times"), "mix-times")
    out = picked(rows, taken, key, "inner")
    again = F.explode(F.sequence(F.lit(1), F.col(f"{key}_times")))
    return out.withColumn(f"{key}_times", again).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_shards(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
    ("sharded", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
