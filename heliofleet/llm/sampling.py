"""A bounded, repeatable sample of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, per_class: int,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, y``: at most ``per_class`` labelled training rows of each class, by hash of the id.

    The ids are drawn from the label table alone, so only ``2 * per_class`` of them meet the texts;
    that bound is what makes the broadcast safe. Null labels and ids are left out; of several labels
    of one id the greatest counts.
    """
    known = (labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
             .where("doc_id is not null and y in (0, 1)").where(train("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y")))
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(per_class) for y in (0, 1)]
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")


def class_share(labels: DataFrame, label: str, train, doc_id: str = "doc_id") -> float:
    """Share of ones among the labelled training rows, kept away from 0 and 1."""
    row = labels.where(F.col(label).isin(0, 1)).where(train(doc_id)).agg(F.sum(label), F.count("*")).first()
    return ((row[0] or 0) + 1) / (row[1] + 2)
