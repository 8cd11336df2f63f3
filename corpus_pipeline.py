"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

toxicity         drops documents whose score reaches ``TOXIC``
near_duplicates  keeps one document of each group of near copies (five-word shingles, 0.8)
substring_dedup  takes out passages that an earlier document has; the text is what is left
decontamination  drops documents that contain a benchmark item
packing          packs the rest into sequences of token ids: pieces with their ids and place

All but the last return the columns of ``documents``. A document that a stage leaves without words
stays, with an empty text. Every stage takes rows with null texts or ids, repeated rows, empty
tables and further columns. Near copies and leaks are judged and dropped row by row, with or without
an id; of a group of near copies the row with the least id stays, one without an id only if none has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from heliofleet.llm.decontaminate import without_items
from heliofleet.llm.minhash import near_duplicates
from heliofleet.llm.packing import pack_documents
from heliofleet.llm.queries import tokenizer_path
from heliofleet.llm.substring import remove_repeats
from heliofleet.llm.tables import crc_mod, keyed, staged
from heliofleet.llm.toxicity import score_toxicity
from heliofleet.session import configure

TOXIC = 0.3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, labels, lambda doc_id: crc_mod(doc_id, 4) != 2,
                            carry=COLUMNS[1:])
    return scored.where(F.col("score") < TOXIC).select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    rows, key = keyed(docs.select(*COLUMNS), "near-rows", "zstd")
    found = near_duplicates(rows, shingle=5, percent=80, key=key)
    return rows.join(found.where("not kept").select(key), key, "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    cut = remove_repeats(docs, carry=COLUMNS[1:])
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.select("doc_id", text.alias("text"), "lang", "source",
                      F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return without_items(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return pack_documents(docs, tokenizer_path(), 2048, with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


ORACLE_SQL = None  # a trained classifier and a tokenizer have no SQL form: tests/llm/test_pipeline.py compares the last four stages with brute force
