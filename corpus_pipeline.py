"""From documents to training tokens, in stages that each read what the one before has written.

Quality rules, near-duplicate removal, benchmark decontamination, mixing to target weights, token shards. SimHash links and
mixing exponents are not SQL, so the whole is tested against brute force on a small fixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import decontaminate, mixing, quality, simhash, token_binary, token_counts
from wardline.llm.queries import tokenizer_path
from wardline.llm.storage import staged

#: The power of a source's share of tokens that is its weight; and how often a small source may be repeated beside the
#: largest one, which is seen once. Sources that differ by more than 2 ** (1 / 0.7), or 2.7 times, meet the limit, others the power.
EXPONENT, MAX_REPETITION = 0.3, 2.0


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = quality.filtered(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in out.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, a similarity of 0.8 or more; one document of each group stays."""
    return simhash.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By tokens; the budget is the one at which every document is seen at least once."""
    return mixing.mixed(docs, exponent=EXPONENT, max_repetition=MAX_REPETITION, n_tokens=token_counts.tokens(F.col("text"), tokenizer_path("word_bpe_49k.json")))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_binary.round_trip(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix),
    ("token binary", write_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{k}")
    return docs
