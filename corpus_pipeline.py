"""A corpus pipeline of five stages, each of which takes all that its predecessor kept.

1. language: documents whose language can't be told go (no letters, or no language stands out by ``OVER_CHANCE``).
2. near_duplicates: of each group of near-duplicates one document stays.
3. substrings: bytes of strings of 200 bytes that also start at an earlier place go from the texts: of a repeated passage of
   some fifty words or more the first occurrence stays.
4. mixing: texts become the words that the source mix takes of them, a row for each time round.
5. pieces: texts are encoded; the rows carry the piece ids.

Defined results: rows that repeat an id are documents of their own until stage 2, which keeps one of those with one id;
null texts go in stage 1; documents of which no word is taken go in stage 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm import jaccard_forest, language_id, merge_dropout, source_mix, suffix_dedup
from helixframe.llm.frames import release, stored, temporary

#: Least mean probability of the language found, in shares of an even distribution over all languages.
OVER_CHANCE = 1.2
#: Vocabulary file of the last stage.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    found = language_id.identify(docs.select(*COLUMNS), over_chance=OVER_CHANCE)
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    with temporary(spark):
        groups = jaccard_forest.near_duplicates(docs.select("doc_id", "text"))
        gone = stored(groups.where("not kept").select("doc_id").distinct(), "pipeline-gone", True)
    left = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    once = left.join(again, "doc_id", "left_anti")
    return once.unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return suffix_dedup.dedup_texts(docs.select(*COLUMNS)).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return source_mix.mixed_texts(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    # rows of one id, from the rounds of the mix, are cut differently; those with one text too
    again = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("n_chars"))
    rounds = docs.select("doc_id", "text", F.xxhash64("text", again).alias("round"))
    return merge_dropout.encode(rounds, PIECES, rate=0.1, seed=1, round_col="round").select("doc_id", "pieces", F.size("pieces").cast("bigint").alias("n_pieces"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixing", mixing), ("pieces", pieces)]

#: SQL can't train the network of the first stage; the stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
