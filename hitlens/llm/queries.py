"""The operators' queries, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlens.llm import chat, codes, decontaminate, exact, mixing, near, negatives, packing, quality, render, secrets
from hitlens.llm import spelling, substrings
from hitlens.llm.common import table
from hitlens.session import ship_package

QUERIES = {}


def query(function):
    """Register a query under its function name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.extract(table(spark, sf_dir, "pages"))


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.words_taken(table(spark, sf_dir, "documents")).drop("row")


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), lines=True)


@query
def op6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.duplicates(table(spark, sf_dir, "documents")).drop("n_links")


@query
def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encoded(table(spark, sf_dir, "documents"), vocabulary_path())


# A conversation that holds control strings of the template.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


@query
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat.digests(chat.windows(rows.unionByName(more)))


@query
def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.content_groups(table(spark, sf_dir, "documents"))


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pieces(table(spark, sf_dir, "documents"), vocabulary_path())
    return found.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))
