"""A training corpus from raw documents, in five stages.

Every stage takes all that its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, copies, mixing, packing, quality, suffix
from tessera.llm.queries import word_tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither their own counts nor their host's verdict reject."""
    measured = common.materialise(quality.measure(docs))
    failed = measured.select(F.col("row.source").alias("host"), quality.base_rules().alias("failed"))
    rates = common.materialise(quality.host_rates(failed))  # a row per host
    judged = measured.where(~quality.base_rules()).select("row.*")
    bad = rates.where(F.col("rate") > 0.5)
    return judged.join(bad, judged["source"].eqNullSafe(bad["host"]), "left_anti")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts (0.8 over five words): that of the smallest id, rows without one last."""
    return copies.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; documents of which no word is left go."""
    done = suffix.remove_repeats(docs, as_text=True, pack_bytes=4 << 20).withColumnRenamed("kept", "text")
    done = done.where((F.size("spans") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    text = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return done.select(*[text.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeat_rows(mixing.mix_sources(docs, keep_rows=True))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack_sequences(docs, word_tokenizer(), cache_bytes=32 << 20)  # workers hold it beside what other stages left


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources", source_mixing),
    ("packing", sequence_packing),
]

#: Fingerprints (XXH64), byte-wise suffix sorting and tokenization are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with common.scratch() as keep:
            docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
