"""Registered queries of the text-pipeline operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from heliofleet.llm.annforest import nearest_vectors
from heliofleet.llm.decontaminate import contained_items
from heliofleet.llm.embedding import near_vectors
from heliofleet.llm.hardnegatives import hard_negatives
from heliofleet.llm.htmltext import extract_text
from heliofleet.llm.lm import score_texts
from heliofleet.llm.minhash import near_duplicates
from heliofleet.llm.packing import pack_documents
from heliofleet.llm.prefixtrie import conversation_trie
from heliofleet.llm.quality import score_quality
from heliofleet.llm.sharding import shard_by_bytes
from heliofleet.llm.substring import remove_repeats
from heliofleet.llm.tables import crc_mod
from heliofleet.llm.toxicity import score_toxicity
from heliofleet.session import configure


def _table(spark, sf_dir, name) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The word-end BPE vocabulary of the public tokenizers."""
    import public_tokenizers
    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_decontamination(spark, sf_dir) -> DataFrame:
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=80)


OP1_SQL = r"""
with w as (
    select doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
i as (
    select item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from benchmark),
ds as (
    select distinct doc_id, unnest(list_transform(range(0, len(w) - 4), lambda k: array_to_string(w[k + 1:k + 5], ' '))) as s from w where len(w) >= 5),
bs as (
    select distinct item_id, unnest(list_transform(range(0, len(w) - 4), lambda k: array_to_string(w[k + 1:k + 5], ' '))) as s from i where len(w) >= 5),
n as (select item_id, count(*) as n_shingles from bs group by 1)
select doc_id, item_id, n_shingles, count(*) as n_shared, count(*) / n_shingles as containment
from ds join bs using (s) join n using (item_id) group by doc_id, item_id, n_shingles
having count(*) * 100 >= n_shingles * 80
"""


def op2_quality(spark, sf_dir) -> DataFrame:
    def train(doc_id):
        return crc_mod(doc_id, 3) != 1
    scored = score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), train)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark, sf_dir) -> DataFrame:
    def train(doc_id):
        return crc_mod(doc_id, 4) != 2
    scored = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), train)
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_html_text(spark, sf_dir) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op6_embedding_dedup(spark, sf_dir) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), least=0.95)


def op5_byte_shards(spark, sf_dir) -> DataFrame:
    return shard_by_bytes(_table(spark, sf_dir, "documents"), 16)


def op7_substring_dedup(spark, sf_dir) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), window=13).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_lm_scores(spark, sf_dir) -> DataFrame:
    held_out = crc_mod("doc_id", 7) == 2
    scored = score_texts(_table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_near_duplicates(spark, sf_dir) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op10_packing(spark, sf_dir) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def op11_nearest_vectors(spark, sf_dir) -> DataFrame:
    return nearest_vectors(_table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark, sf_dir) -> DataFrame:
    return hard_negatives(_table(spark, sf_dir, "embeddings"))


OP12_SQL = """
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as ints
    from embeddings where vec_id is not null and label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
    select a.vec_id as anchor_id, r.vec_id, r.label = a.label as same,
           coalesce(list_sum(list_transform(list_zip(a.ints, r.ints), lambda p: p[1] * p[2])), 0)::bigint as score
    from v a join v r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id and len(a.ints) = len(r.ints)),
p as (
    select anchor_id, vec_id as positive_id, score as positive_score from s where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (
    select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank,
           vec_id as negative_id, positive_score, score as negative_score
    from p join s using (anchor_id)
    where not same and 80 * positive_score <= 100 * score and score <= positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""


def op13_conversation_trie(spark, sf_dir) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"))


REGISTERED = {
    "op1_decontamination": (op1_decontamination, OP1_SQL),
    "op2_quality": (op2_quality, None),
    "op3_toxicity": (op3_toxicity, None),
    "op4_html_text": (op4_html_text, None),
    "op5_byte_shards": (op5_byte_shards, None),
    "op6_embedding_dedup": (op6_embedding_dedup, None),
    "op7_substring_dedup": (op7_substring_dedup, None),
    "op8_lm_scores": (op8_lm_scores, None),
    "op9_near_duplicates": (op9_near_duplicates, None),
    "op10_packing": (op10_packing, None),
    "op11_nearest_vectors": (op11_nearest_vectors, None),
    "op12_hard_negatives": (op12_hard_negatives, OP12_SQL),
    "op13_conversation_trie": (op13_conversation_trie, None),
}
