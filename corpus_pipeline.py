"""From raw documents to token files: five stages, each written as Parquet and read as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm import decontam, langid, mixing, simhash, token_output
from crestline.llm.queries import tokenizer_path
from crestline.llm.shared import free_names, id_remainder, scratch, table

#: A document whose language scores less than this is rejected.
LEAST_LANG_SCORE = 0.5
#: Share of the tokens that the mixture keeps.
MIX_SHARE = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those of ``und`` or an uncertain language go."""
    model = langid.train(docs.where(id_remainder(F.col("doc_id")) != 0))
    (found,) = free_names(docs, "_lang")
    marked = docs.withColumn(found, langid.predict(F.col("text"), model, docs))
    return marked.where((F.col(f"{found}.lang_pred") != "und") & (F.col(f"{found}.score") >= LEAST_LANG_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id.

    The others are looked up, as they are the fewer. Rows without doc_id, which nothing can name,
    and rows that repeat a kept doc_id stay.
    """
    found = simhash.near_duplicates(docs)
    others = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and genres are nearer to the target mixture."""
    return mixing.mixed(docs, MIX_SHARE).where("mix.sampled").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' place, length and checksum in the token files."""
    path = scratch(spark, "pipeline-tokens")
    token_output.write_tokens(docs, path, tokenizer_path())
    return token_output.token_digest(token_output.read_tokens(spark, path))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Fingerprints, walks and encoders can't be written in SQL; tests/llm holds each operator against brute force and the stages against their operators.
ORACLE_SQL = None
