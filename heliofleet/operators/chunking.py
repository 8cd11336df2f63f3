"""Section-level chunks of Markdown documents, packing of long sections, corpus fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from heliofleet import fixed
from heliofleet.functions.text import slug, stripped

# Line ends as str.splitlines sees them.
_LINE_END = "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def pack_paragraphs(text: Column, max_chars: int = fixed.MAX_CHUNK_CHARS, sep: str = "\n\n") -> Column:
    """Greedy parts of at most ``max_chars``, cut between paragraphs; a longer paragraph stays whole.

    Only paragraph lengths are folded, to the first and last paragraph of each part; every text is
    put together once, at the end."""
    # String.split with a quoted literal; -1 keeps trailing empty paragraphs.
    paras = F.split(text, "\\Q" + sep + "\\E", -1)

    def step(state: Column, length: Column) -> Column:
        held, at = state["size"], state["at"]
        full = (held > 0) & (held + length + len(sep) > max_chars)
        fresh = full | (held == 0)  # nothing held: empty paragraphs before a part are dropped
        return F.struct(
            F.when(full, F.concat(state["cuts"], F.array(F.struct(state["first"].alias("first"), (at - 1).alias("last"))))).otherwise(state["cuts"]).alias("cuts"),
            F.when(fresh, at).otherwise(state["first"]).alias("first"),
            F.when(fresh, length).otherwise(held + length + len(sep)).alias("size"), (at + 1).alias("at"))

    start = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("cuts"), F.lit(1).alias("first"), F.lit(0).alias("size"), F.lit(1).alias("at"))

    def parts(own: Column) -> Column:
        cuts = F.aggregate(
            F.transform(own, F.length), start, step,
            lambda s: F.when(s["size"] > 0, F.concat(s["cuts"], F.array(F.struct(s["first"].alias("first"), (s["at"] - 1).alias("last"))))).otherwise(s["cuts"]))
        return F.transform(cuts, lambda c: F.array_join(F.slice(own, c["first"], c["last"] - c["first"] + 1), sep))

    packed = F.transform(F.array(paras), parts)[0]  # the text is split once
    return F.when(F.length(text) <= max_chars, F.array(text)).otherwise(packed)


def chunk_documents(
    docs: DataFrame, max_chars: int = fixed.MAX_CHUNK_CHARS, para_sep: str = "\n\n"
) -> DataFrame:
    """Chunks of documents (doc, text). ``# `` lines set the title of the whole document (the last
    one wins), ``## `` lines open sections (text before the first is "Overview"), empty sections
    vanish. Each document is cut by its own row; nothing is shuffled."""
    body = F.regexp_replace("text", _LINE_END, "\n")
    titles = F.regexp_extract_all("_body", F.lit(r"(?d)(?m)^# (.*)$"), F.lit(1))
    cut = (
        docs.select("doc", body.alias("_body"))
        .withColumn("title", F.coalesce(stripped(F.try_element_at(titles, F.lit(-1))), F.col("doc").cast("string")))
        .select("doc", "title", F.posexplode(F.split("_body", r"(?d)(?m)^(?=## )", -1)).alias("section_no", "_part"))
    )
    headed = F.col("_part").startswith("## ")
    heading = F.when(headed, stripped(F.substr(F.substring_index("_part", "\n", 1), F.lit(4)))).otherwise("Overview")
    inner = F.when(headed, F.regexp_replace("_part", r"(?d)\A[^\n]*(?:\n|\z)", "")).otherwise(F.col("_part"))
    text = stripped(F.regexp_replace(inner, r"(?d)(?m)^# .*(?:\n|\z)", ""))
    parts = (
        cut.select("doc", "title", "section_no", heading.alias("section"), text.alias("_text"))
        .where("_text <> ''")
        .select("doc", "title", "section", "section_no",
                F.posexplode(pack_paragraphs(F.col("_text"), max_chars, para_sep)).alias("part_no", "text"))
    )
    suffix = F.when(F.col("part_no") == 0, "").otherwise(F.concat(F.lit("-"), (F.col("part_no") + 1).cast("string")))
    return parts.select(
        F.concat(F.col("doc").cast("string"), F.lit("#"), slug(F.col("section")), suffix).alias("id"),
        "doc", "title", "section", "text", "section_no", "part_no")


def corpus_fingerprint(chunks: DataFrame) -> DataFrame:
    """Twelve hex digits that change with any chunk's id or text, in one partial aggregate.

    Ids are unique, so an order-free sum of per-chunk digests pins the same content as a hash of
    the concatenated corpus would, without ever concatenating it. The two values differ.
    """
    digest = F.sha2(F.concat(F.col("id").cast("string"), F.lit("\n"), "text", F.lit("\n")), 256)
    lanes = [F.conv(F.substring(F.col("_d"), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(5)]
    sums = chunks.select(digest.alias("_d")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(lane.cast("decimal(28,0)")).alias(f"s{i}") for i, lane in enumerate(lanes)])
    text = F.concat_ws(":", F.col("n").cast("string"), *[F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string") for i in range(5)])
    return sums.select(F.col("n").alias("chunks"), F.substring(F.sha2(text, 256), 1, 12).alias("fingerprint"))
