"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item's MinHash sketch is the least values among its shingles' hashes. Items are partitioned by
size (powers of two), and a partition's sketches are one longer than the number of shingles a match
may lack at the partition's upper size. So, by the pigeonhole principle, a document that contains
at least ``percent`` per cent of an item's shingles has some value of its sketch, however long the
document is: the search loses no match. Candidates are then verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from heliofleet.llm.tables import keyed, staged

WIDTH = 5


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+"), "")


def _grams(words: str, width: int, join) -> Column:
    """All runs of ``width`` words, each put through ``join``."""
    w = F.col(words)
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: join(*(w[i + j] for j in range(width))))
    return F.when(F.size(w) >= width, runs)


def _all_grams(words: str, widths: list[int], join) -> Column:
    return F.concat(*(F.coalesce(_grams(words, n, join), F.array()) for n in widths))


def _hash(*words: Column) -> Column:
    return F.xxhash64(*words)


def _text(*words: Column) -> Column:
    return F.concat_ws(" ", *words)


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    item_id: str = "item_id", item_text: str = "text", percent: int = 80) -> DataFrame:
    """Pairs of a document and a test item of whose distinct shingles it has at least ``percent`` per cent.

    ``doc_id, item_id, n_shingles, n_shared, containment``. Words are lower-cased runs without ASCII
    white space, shingles ``WIDTH`` words; an item with fewer words is one shingle as a whole. Null
    and empty texts and rows without an id match nothing. Rows that repeat an id count as one
    document (item): the pair's row has the greatest containment among them. Empty tables give no rows.
    """
    item = items.select(F.col(item_id).cast("long").alias("item_id"), _words(item_text).alias("w")).where(
        "item_id is not null and size(w) > 0").withColumn("width", F.least(F.size("w"), F.lit(WIDTH)))
    widths = sorted(r.width for r in item.select("width").distinct().collect())  # WIDTH rows at most
    if not widths:
        widths = [WIDTH]

    def of_width(join):
        return F.coalesce(*(F.when(F.col("width") == n, F.array_distinct(_grams("w", n, join))) for n in widths))

    item = staged(item.select("item_id", of_width(_hash).alias("hashes"), of_width(_text).alias("shingles"))
                  .withColumn("n_shingles", F.size("hashes")), "items")
    upper = F.pow(F.lit(2), F.floor(F.log2("n_shingles")) + 1) - 1  # the partition's largest size
    length = (F.floor(upper * (100 - percent) / 100) + 1).cast("int")
    sketches = staged(item.select("item_id", F.explode(F.slice(F.array_sort("hashes"), 1, length)).alias("h")).distinct(), "sketches")

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(
        "doc_id is not null and text is not null")
    words = rows.select("doc_id", _words("text").alias("w"))
    candidates = staged(words.select("doc_id", F.explode(_all_grams("w", widths, _hash)).alias("h"))
                        .join(sketches, "h").select("doc_id", "item_id").distinct(), "candidates")

    found = (rows.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
             .select("doc_id", _words("text").alias("w"))
             .select("doc_id", F.array_distinct(_all_grams("w", widths, _text)).alias("own"))
             .join(candidates, "doc_id").join(item.select("item_id", "shingles", "n_shingles"), "item_id")
             .select("doc_id", "item_id", F.col("n_shingles").cast("long").alias("n_shingles"),
                     F.size(F.array_intersect("own", "shingles")).cast("long").alias("n_shared"))
             .where(F.col("n_shared") * 100 >= F.col("n_shingles") * percent))
    best = F.max_by(F.struct("n_shingles", "n_shared"), F.col("n_shared") / F.col("n_shingles"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", "b.n_shingles", "b.n_shared", (F.col("b.n_shared") / F.col("b.n_shingles")).alias("containment"))


def without_items(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that contain no test item; each row is judged by its own text, with or without an id."""
    rows, key = keyed(docs, "decontamination-rows", "zstd")
    leaked = contained_items(rows, items, doc_id=key, **options).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(leaked, key, "left_anti").select(docs.columns)
