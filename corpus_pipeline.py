"""From documents to a training mix: language ID, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, language, mixing, neardup
from lectern.llm.shared import Scratch, crc_mod


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str, wanted: list[str] | None = None, least_score: float = 0.5) -> DataFrame:
    """Documents in the languages that are wanted, all learned ones unless said; their prediction stands in for a missing lang.

    Those go that have no letter, are in another language, or are in none by the
    network: no language has half of the probability.  Where no row has a label to
    learn from, all documents with letters stay.
    """
    network = language.fit(docs, crc_mod(F.col("doc_id"), 4) != 2)
    if network is None:
        return docs.where(F.col("text").rlike("\\p{L}"))
    found = language.identify(docs, network).where(F.col("lang_pred").isin(wanted or network.labels) & (F.col("score") >= least_score))
    return found.select(*(F.coalesce(F.col("row")[c], F.col("lang_pred")).alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group (five-word shingles, 0.8)."""
    return neardup.one_of_each_group(spark, docs, shingle_words=5, percent=80)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in spans shared with benchmark items."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contaminated_spans(spark, docs, benchmark).where(~decontaminate.contaminated()).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what is left: a row for each part of a document in a slot of a shard."""
    parts, _, _ = mixing.mix(spark, docs)
    return parts.drop("start")


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)


#: A network's predictions cannot be said in SQL.
ORACLE_SQL = None
