"""A training-data pipeline over `documents`: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, language_id, near_dedup, source_mix, token_store
from ledgerloom.llm.common import named, stored, table
from ledgerloom.llm.registry import tokenizer

#: A text is rejected if its language can't be told: no letter, or less than this posterior for the best language.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is found; `und` and unsure texts go."""
    langs, matrix = language_id.fit(docs, F.lit(True), key=F.col("doc_id"))
    whole = docs.select("doc_id", "text", F.struct(*map(named, docs.columns)).alias("row"))
    guessed = language_id.predict(whole, langs, matrix, keep=["row"])
    return guessed.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document that names each group of near copies stays; repeated rows of one id and text are one document."""
    return near_dedup.drop_near(docs, once=True)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    mixed = source_mix.mix(docs, weight=source_mix.by_length, carry=True).where("copies > 0")
    return mixed.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Written as token files and read back."""
    return token_store.store_and_read(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixing", mixing), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
