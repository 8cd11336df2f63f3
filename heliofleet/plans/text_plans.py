"""Registered queries over text: tokens, chunks, keyword and vector ranking, answers, masking.

Documents stand in for the corpus (language as title, source as section), benchmark passages for
the questions, and embeddings for the dense vectors (``vec_id`` = ``doc_id``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from heliofleet import fixed
from heliofleet.functions import text as tx
from heliofleet.functions.columns import rounded
from heliofleet.operators import catalogue, chunking, evaluation, passages, quality, ranking
from heliofleet.operators.index import Index, files_version, stored_index
from heliofleet.plans.bindings import sql_round, table
from heliofleet.session import configure, shared_base


def corpus(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), F.col("lang").alias("title"),
        F.col("source").alias("section"), "text")


def questions(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def index(spark, sf) -> Index:
    """The stored index of the documents; queries over the same files share it."""
    return stored_index(corpus(spark, sf), shared_base(spark), files_version(table(spark, sf, "documents")))


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), "embedding")


def query_vectors(spark, sf) -> DataFrame:
    """A vector for each question: the one with its number."""
    return questions(spark, sf).join(table(spark, sf, "embeddings"), F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")


HEAD_WORDS = "The|In|On|Of|Le|La|En|De|El|Der|Die|Das"


def markdown(spark, sf) -> DataFrame:
    """Every document as Markdown: a title line, and a heading before lines opening with a
    function word."""
    configure(spark)
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("doc"),
        F.concat(F.lit("# "), "source", F.lit(" \n"),
                 F.regexp_replace("text", f"(?m)^({HEAD_WORDS}) ", "## $1 part\n")).alias("text"))


def chunks(spark, sf) -> DataFrame:
    return chunking.chunk_documents(markdown(spark, sf), para_sep="\n")


def packed(spark, sf) -> DataFrame:
    configure(spark)
    return table(spark, sf, "documents").select("doc_id", F.posexplode(
        chunking.pack_paragraphs(F.col("text"), sep="\n")).alias("part_no", "text"))


def token_counts(expand: bool):
    def build(spark, sf):
        found = table(spark, sf, "documents").select("doc_id", F.explode(tx.tokens(F.col("text"), expand)).alias("term"))
        return found.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return build


def expected_docs(spark, sf) -> DataFrame:
    """A document answers a question when they share a whole sentence of 30 characters or more."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(tx.sentences(F.col("text"))).alias("s"))
    asked = questions(spark, sf).select(F.col("query_id").alias("case_id"), F.explode(tx.sentences(F.col("query"))).alias("s"))
    long = F.length("s") >= 30
    return asked.where(long).join(docs.where(long), "s").select("case_id", "id").distinct()


def ranked_cases(spark, sf):
    expected = expected_docs(spark, sf)
    ranked = ranking.search(questions(spark, sf), index(spark, sf), k=5).select(F.col("query_id").alias("case_id"), "id", "rank")
    return evaluation.case_ranks(expected, ranked, corpus(spark, sf)), ranked


def retrieval_misses(spark, sf):
    ranks, ranked = ranked_cases(spark, sf)
    return evaluation.misses(ranks, ranked).select("case_id", F.array_join("got", ",").alias("got"))


def hits_with_text(spark, sf, idx):
    hits = ranking.search(questions(spark, sf), idx, k=4)
    return hits.join(corpus(spark, sf).select("id", "text"), "id").select("query_id", F.col("rank").alias("n"), "score", "text")


def best_sentences(spark, sf):
    idx = index(spark, sf)
    top = hits_with_text(spark, sf, idx).where("n <= 2").withColumn("take", F.lit(2))
    return passages.best_sentences(top, questions(spark, sf), idx.terms)


def extractive_answers(spark, sf):
    idx = index(spark, sf)
    return passages.extractive_answers(hits_with_text(spark, sf, idx), questions(spark, sf), idx.terms)


def citations(spark, sf):
    """Every order line as a cited answer."""
    li = table(spark, sf, "lineitem")
    answer = F.concat(
        F.lit("Output fell"),
        F.when(F.col("l_linenumber") != 4, F.concat(F.lit(" ["), F.col("l_linenumber").cast("string"), F.lit("]"))).otherwise(""),
        F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit(", then rose ["), (F.col("l_suppkey") % 5).cast("string"), F.lit("]."))).otherwise(" [n]."))
    given = F.when(F.col("l_quantity") > 40, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.lit(4)))
    return passages.check_citations(li.select(
        "l_orderkey", "l_linenumber", "l_partkey", answer.alias("text"), given.alias("given"))).drop("given")


def masked(spark, sf):
    return tx.mask_secrets(table(spark, sf, "documents").select("doc_id", "text"))


def masked_lines(spark, sf):
    """Log lines with secrets of every kind, made from customers."""
    k = F.col("c_custkey")
    line = F.concat_ws(" ", "c_name", F.element_at(F.array(
        F.concat(F.lit("postgresql://user:pw"), k, F.lit("@db.example/x")),
        F.concat(F.lit('{"x-api-key": "key'), k, F.lit('", "n": 1}')),
        F.concat(F.lit("Authorization: Bearer abcdefgh"), k),
        F.concat(F.lit("host=db password=pw"), k, F.lit(" dbname=x")),
        F.concat(F.lit("sent bearer abcdefgh"), k, F.lit(" on")),
        F.concat(F.lit("key sk-proj-ABCDEFGHIJKLMNOP"), k, F.lit(" rejected")),
        F.lit("password authentication failed; input_tokens: 120")), (k % 7 + 1).cast("int")))
    return tx.mask_secrets(table(spark, sf, "customer").select("c_custkey", line.alias("text")))


def latency_percentiles(spark, sf):
    return evaluation.rank_percentiles(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])


# ---------- SQL twins ----------

def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


STOP_SQL = "(" + ", ".join(q(w) for w in fixed.STOPWORDS) + ")"


def sql_stem(w: str) -> str:
    """Stem as two regular-expression steps over a word."""
    base = (f"CASE WHEN regexp_matches({w}, '^.{{3,}}ies$') THEN regexp_replace({w}, 'ies$', 'y') "
            f"WHEN regexp_matches({w}, '^.{{3,}}ing$') THEN regexp_replace({w}, 'ing$', '') "
            f"WHEN regexp_matches({w}, '^.{{3,}}ed$') THEN regexp_replace({w}, 'ed$', '') "
            f"WHEN regexp_matches({w}, '^.{{2,}}[^s]s$') THEN regexp_replace({w}, 's$', '') ELSE {w} END")
    return f"regexp_replace({base}, '^(.{{3,}})e$', '\\1')"


def sql_expand(w: str) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {w} || ' ' || {q(v)}" for k, v in fixed.QUERY_EXPANSIONS.items())
    return f"unnest(string_split(CASE {w} {cases} ELSE {w} END, ' '))"


def sql_tokens(source: str, keys: str, text: str, expand: bool = False) -> str:
    """A subquery (keys, term), one row per token."""
    raw = f"SELECT {keys}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS w FROM {source}"
    if expand:
        raw = f"SELECT {keys}, {sql_expand('w')} AS w FROM ({raw})"
    return f"SELECT {keys}, {sql_stem('w')} AS term FROM ({raw}) WHERE length(w) > 1 AND w NOT IN {STOP_SQL}"


SQL_CORPUS = f"""
doc_tokens AS ({sql_tokens('documents', 'doc_id', "concat_ws(' ', lang, source, source, text)")}),
posting AS (SELECT doc_id, term, count(*) AS tf FROM doc_tokens GROUP BY ALL),
doc_len AS (SELECT doc_id, sum(tf) AS len FROM posting GROUP BY 1),
corpus AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM posting) / (SELECT count(*) FROM documents) AS avg_len),
idf AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n FROM corpus) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posting GROUP BY 1)"""


def sql_hits(queries: str = "benchmark", key: str = "item_id", text: str = "text", p: str = "") -> str:
    """The best 20 documents of each query as ``lex``; ``p`` goes before the names of the subqueries."""
    return f"""
{p}qterm AS (SELECT DISTINCT {key}, term FROM ({sql_tokens(queries, key, text, True)})),
{p}bm AS (SELECT {key}, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT avg_len FROM corpus)))), 9) AS score
       FROM {p}qterm JOIN posting USING (term) JOIN idf USING (term) JOIN doc_len USING (doc_id) GROUP BY 1, 2),
{p}lex AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, doc_id) AS rank FROM {p}bm QUALIFY rank <= 20)"""


SQL_INDEX = f"{SQL_CORPUS},{sql_hits()}"

SQL_DENSE = """
dense AS (SELECT item_id, vec_id AS doc_id, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, vec_id) AS rank
  FROM (SELECT b.item_id, v.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS s
        FROM benchmark b JOIN embeddings a ON a.vec_id = b.item_id, embeddings v) QUALIFY rank <= 20),
fused AS (SELECT item_id, doc_id, round(coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + d.rank), 0), 12) AS score, l.rank AS lr, d.rank AS dr
  FROM lex l FULL JOIN dense d USING (item_id, doc_id)),
hyb AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, lr NULLS LAST, dr NULLS LAST) AS rank FROM fused QUALIFY rank <= 4)"""

def sql_sentences(text: str) -> str:
    return f"list_filter(string_split(regexp_replace(trim({text}, E' \\n\\t\\r'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


SQL_CASES = f"""
exp AS (SELECT DISTINCT item_id, doc_id FROM (SELECT item_id, unnest({sql_sentences('text')}) AS s FROM benchmark) a
        JOIN (SELECT doc_id, unnest({sql_sentences('text')}) AS s FROM documents) b USING (s) WHERE length(s) >= 30),
found AS (SELECT e.item_id, min(l.rank) FILTER (l.rank <= 5) AS rank FROM exp e LEFT JOIN lex l USING (item_id, doc_id) GROUP BY 1)"""

def sql_best(key: str = "item_id", p: str = "") -> str:
    """The sentences of each query's first two documents, ordered by the query terms they share."""
    return f"""
{p}sent AS (SELECT {key}, rank AS n, seq, s FROM (
   SELECT l.{key}, l.rank, l.score, unnest(ss) AS s, unnest(range(len(ss))) AS seq FROM {p}lex l
   JOIN (SELECT doc_id, {sql_sentences('text')} AS ss FROM documents) d USING (doc_id) WHERE l.rank <= 2)),
{p}st AS (SELECT DISTINCT {key}, n, seq, term FROM ({sql_tokens(f'{p}sent', f'{key}, n, seq', 's')})),
{p}ov AS (SELECT {key}, n, seq, round(sum(idf), 9) AS o FROM {p}st JOIN {p}qterm USING ({key}, term) JOIN idf USING (term) GROUP BY ALL),
{p}pick AS (SELECT {p}sent.*, row_number() OVER (PARTITION BY {key}, n ORDER BY coalesce(o, 0) DESC, seq) AS place FROM {p}sent LEFT JOIN {p}ov USING ({key}, n, seq)),
{p}piece AS (SELECT {key}, n, concat(string_agg(s, ' ' ORDER BY seq), ' [', max(n), ']') AS t FROM {p}pick
   WHERE (n = 1 AND place <= 3) OR (n = 2 AND place <= 2 AND EXISTS (SELECT 1 FROM {p}lex a JOIN {p}lex b USING ({key})
      WHERE a.{key} = {p}pick.{key} AND a.rank = 1 AND b.rank = 2 AND round(b.score, 4) >= 0.5 * round(a.score, 4))) GROUP BY {key}, n)"""


SQL_BEST = sql_best()

SQL_CHUNKS = f"""
WITH RECURSIVE md AS (SELECT doc_id AS doc, source, unnest(l) AS line, unnest(range(len(l))) AS i FROM (
     SELECT doc_id, source, string_split('# ' || source || E' \\n' || regexp_replace(text, '(?m)^({HEAD_WORDS}) ', E'## \\\\1 part\\n', 'g'), E'\\n') AS l FROM documents)),
sec AS (SELECT *, sum(CASE WHEN starts_with(line, '## ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY i) AS section_no FROM md),
ttl AS (SELECT doc, trim(substr(arg_max(line, i), 3)) AS title FROM md WHERE starts_with(line, '# ') GROUP BY 1),
body AS (SELECT doc, CAST(section_no AS INTEGER) AS section_no, coalesce(max(trim(substr(line, 4))) FILTER (starts_with(line, '## ')), 'Overview') AS section,
         trim(coalesce(string_agg(line, E'\\n' ORDER BY i) FILTER (NOT starts_with(line, '## ') AND NOT starts_with(line, '# ')), ''), E' \\n\\t\\r') AS text
  FROM sec GROUP BY ALL),
paras AS (SELECT doc, section_no, section, CASE WHEN length(text) <= 1200 THEN [text] ELSE string_split(text, E'\\n') END AS p FROM body WHERE text <> ''),
fold AS (SELECT doc, section_no, section, p, 1 AS i, p[1] AS cur, 0 AS part, CAST(NULL AS VARCHAR) AS done, CAST(NULL AS INTEGER) AS done_part FROM paras
  UNION ALL
  SELECT doc, section_no, section, p, i + 1,
    CASE WHEN cur = '' OR length(cur) + length(p[i + 1]) + 1 > 1200 THEN p[i + 1] ELSE cur || E'\\n' || p[i + 1] END,
    CASE WHEN cur <> '' AND length(cur) + length(p[i + 1]) + 1 > 1200 THEN part + 1 ELSE part END,
    CASE WHEN cur <> '' AND length(cur) + length(p[i + 1]) + 1 > 1200 THEN cur END,
    CASE WHEN cur <> '' AND length(cur) + length(p[i + 1]) + 1 > 1200 THEN part END
  FROM fold WHERE i < len(p)),
parts AS (SELECT doc, section_no, section, done AS text, done_part AS part_no FROM fold WHERE done IS NOT NULL
  UNION ALL SELECT doc, section_no, section, cur, part FROM fold WHERE i = len(p) AND cur <> ''),
chunked AS (SELECT doc || '#' || trim(regexp_replace(lower(section), '[^a-z0-9]+', '-', 'g'), '-') || CASE WHEN part_no > 0 THEN '-' || (part_no + 1) ELSE '' END AS id,
  doc, title, section, text, section_no, part_no FROM parts JOIN ttl USING (doc))"""

SQL_PACKED = """
WITH RECURSIVE paras AS (SELECT doc_id, CASE WHEN length(text) <= 1200 THEN [text] ELSE string_split(text, E'\\n') END AS p FROM documents),
fold AS (SELECT doc_id, p, 1 AS i, p[1] AS cur, 0 AS part, CAST(NULL AS VARCHAR) AS done FROM paras
  UNION ALL
  SELECT doc_id, p, i + 1,
    CASE WHEN cur = '' THEN p[i + 1] WHEN length(cur) + length(p[i + 1]) >= 1200 THEN p[i + 1] ELSE concat(cur, E'\\n', p[i + 1]) END,
    CASE WHEN cur <> '' AND length(cur) + length(p[i + 1]) >= 1200 THEN part + 1 ELSE part END,
    CASE WHEN cur <> '' AND length(cur) + length(p[i + 1]) >= 1200 THEN cur END
  FROM fold WHERE i < len(p))
SELECT doc_id, CAST(part - 1 AS INTEGER) AS part_no, done AS text FROM fold WHERE done IS NOT NULL
UNION ALL SELECT doc_id, part, cur FROM fold WHERE i = len(p) AND cur <> ''"""


def sql_mask(source: str, key: str) -> str:
    # The rules' own patterns as RE2 reads them: no Unicode flag, and quotes doubled for SQL.
    kinds = [(name, re.sub(r"^\(\?(i?)U\)", lambda m: "(?i)" if m.group(1) else "", pattern).replace("'", "''"), re.sub(r"\$(\d)", r"\\\1", replacement))
             for name, pattern, replacement in fixed.SECRET_RULES]
    sql = f"SELECT * FROM {source}"
    for name, pattern, replacement in kinds:
        sql = (f"SELECT * REPLACE (regexp_replace(text, '{pattern}', '{replacement}', 'g') AS text), "
               f"CAST(len(regexp_extract_all(text, '{pattern}')) AS INTEGER) AS hits_{name} FROM ({sql})")
    return sql


LINES_SQL = """(SELECT c_custkey, concat_ws(' ', c_name, [
 concat('postgresql://user:pw', c_custkey, '@db.example/x'), concat('{"x-api-key": "key', c_custkey, '", "n": 1}'),
 concat('Authorization: Bearer abcdefgh', c_custkey), concat('host=db password=pw', c_custkey, ' dbname=x'),
 concat('sent bearer abcdefgh', c_custkey, ' on'), concat('key sk-proj-ABCDEFGHIJKLMNOP', c_custkey, ' rejected'),
 'password authentication failed; input_tokens: 120'][c_custkey % 7 + 1]) AS text FROM customer)"""


REGISTERED = {
    "tokens": (token_counts(False), f"SELECT doc_id, term, count(*) AS n FROM ({sql_tokens('documents', 'doc_id', 'text')}) GROUP BY ALL"),
    "tokens_expanded": (token_counts(True), f"SELECT doc_id, term, count(*) AS n FROM ({sql_tokens('documents', 'doc_id', 'text', True)}) GROUP BY ALL"),
    "slugs": (
        lambda s, d: table(s, d, "benchmark").select("item_id", tx.slug(F.col("text")).alias("slug")),
        "SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), '-') AS slug FROM benchmark"),
    "pack_paragraphs": (packed, SQL_PACKED),
    "chunk_documents": (chunks, SQL_CHUNKS + " SELECT * FROM chunked"),
    "list_docs": (
        lambda s, d: catalogue.list_docs(chunks(s, d)).select("doc", "title", F.array_join(F.transform("sections", lambda x: x["id"]), ",").alias("ids")),
        SQL_CHUNKS + " SELECT doc, title, string_agg(id, ',' ORDER BY section_no, part_no) AS ids FROM chunked GROUP BY ALL"),
    "duplicate_chunk_ids": (
        lambda s, d: quality.key_rule(chunks(s, d), "chunk_id_unique", ["id"]),
        SQL_CHUNKS + " SELECT 'chunk_id_unique' AS rule, count(*) AS violations FROM (SELECT id FROM chunked GROUP BY id HAVING count(*) > 1)"),
    "corpus_fingerprint": (
        lambda s, d: chunking.corpus_fingerprint(corpus(s, d)),
        """SELECT n AS chunks, substr(sha256(concat_ws(':', n, s0, s1, s2, s3, s4)), 1, 12) AS fingerprint FROM (
 SELECT count(*) AS n, sum(('0x' || d[1:15])::BIGINT)::VARCHAR AS s0, sum(('0x' || d[16:30])::BIGINT)::VARCHAR AS s1,
        sum(('0x' || d[31:45])::BIGINT)::VARCHAR AS s2, sum(('0x' || d[46:60])::BIGINT)::VARCHAR AS s3,
        sum(('0x' || d[61:64])::BIGINT)::VARCHAR AS s4
 FROM (SELECT sha256(concat(doc_id, chr(10), text, chr(10))) AS d FROM documents))"""),
    "keyword_index_postings": (
        lambda s, d: index(s, d).postings().select("term", F.col("id").alias("doc_id"), "tf", "len"),
        f"WITH {SQL_INDEX.strip()} SELECT term, doc_id, tf, CAST(len AS INTEGER) AS len FROM posting JOIN doc_len USING (doc_id)"),
    "keyword_index_terms": (
        lambda s, d: index(s, d).terms.select("term", "df", rounded(F.col("idf"), 6).alias("idf")),
        f"WITH {SQL_INDEX.strip()} SELECT term, df, {sql_round('idf', 6)} AS idf FROM idf"),
    "bm25_top20": (
        lambda s, d: ranking.bm25_topk(questions(s, d), index(s, d)).select(
            "query_id", F.col("id").alias("doc_id"), rounded(F.col("score"), 6).alias("score"), "rank"),
        f"WITH {SQL_INDEX.strip()} SELECT item_id AS query_id, doc_id, {sql_round('score', 6)} AS score, CAST(rank AS INTEGER) AS rank FROM lex"),
    "search_keyword": (
        lambda s, d: ranking.search(questions(s, d), index(s, d)),
        f"WITH {SQL_INDEX.strip()} SELECT item_id AS query_id, CAST(rank AS INTEGER) AS rank, doc_id AS id, round(score, 4) AS score, 'bm25' AS method FROM lex WHERE rank <= 4"),
    "cosine_top20": (
        lambda s, d: ranking.cosine_topk(vectors(s, d).select(F.col("id").alias("query_id"), "embedding"), vectors(s, d)).select(
            "query_id", "id", rounded(F.col("score"), 6).alias("score"), "rank"),
        f"""SELECT query_id, id, {sql_round('s', 6)} AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INTEGER) AS rank
FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s
      FROM embeddings a, embeddings b) QUALIFY rank <= 20"""),
    "search_hybrid": (
        lambda s, d: ranking.search(questions(s, d), index(s, d), 4, query_vectors(s, d), vectors(s, d)),
        f"WITH {SQL_INDEX.strip()}, {SQL_DENSE.strip()} SELECT item_id AS query_id, CAST(rank AS INTEGER) AS rank, doc_id AS id, round(score, 4) AS score, 'hybrid' AS method FROM hyb"),
    "evaluate_retrieval": (
        lambda s, d: evaluation.evaluate_retrieval(ranked_cases(s, d)[0]),
        f"""WITH {SQL_INDEX.strip()}, {SQL_CASES.strip()} SELECT count(*) AS cases, {sql_round('avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END)', 3)} AS hit_at_1,
 {sql_round('avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END)', 3)} AS hit_at_3, {sql_round('avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END)', 3)} AS hit_at_5,
 {sql_round('avg(coalesce(1.0::DOUBLE / rank, 0))', 3)} AS mrr, {sql_round('avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END)', 3)} AS doc_hit_at_3 FROM found"""),
    "retrieval_misses": (
        retrieval_misses,
        f"""WITH {SQL_INDEX.strip()}, {SQL_CASES.strip()} SELECT f.item_id AS case_id, coalesce(string_agg(l.doc_id, ',' ORDER BY l.rank), '') AS got
FROM found f LEFT JOIN lex l ON l.item_id = f.item_id AND l.rank <= 3 WHERE f.rank IS NULL OR f.rank > 3 GROUP BY 1"""),
    "best_sentences": (
        best_sentences,
        f"WITH {SQL_INDEX.strip()}, {SQL_BEST.strip()} SELECT item_id AS query_id, CAST(n AS INTEGER) AS n, string_agg(s, ' ' ORDER BY seq) AS extract FROM pick WHERE place <= 2 GROUP BY ALL"),
    "extractive_answers": (
        extractive_answers,
        f"""WITH {SQL_INDEX.strip()}, {SQL_BEST.strip()}
SELECT b.item_id AS query_id, coalesce(string_agg(t, ' ' ORDER BY n), {q(fixed.NO_PASSAGES_TEXT)}) AS answer FROM benchmark b LEFT JOIN piece USING (item_id) GROUP BY 1"""),
    "check_citations": (citations, """
SELECT l_orderkey, l_linenumber, l_partkey, text, reason, reason IS NULL AS valid FROM (
 SELECT *, CASE WHEN NOT none AND len(c) = 0 THEN 'answer cites no passages'
   WHEN none AND len(c) > 0 THEN 'answer cites unknown passages [' || array_to_string(list_sort(c), ', ') || ']'
   WHEN len(list_filter(c, lambda x: x < 1 OR x > 4)) > 0 THEN 'answer cites unknown passages [' || array_to_string(list_sort(list_filter(c, lambda x: x < 1 OR x > 4)), ', ') || ']' END AS reason
 FROM (SELECT *, list_distinct(list_filter([CASE WHEN l_linenumber <> 4 THEN l_linenumber::BIGINT END, CASE WHEN l_partkey % 3 = 0 THEN l_suppkey % 5 END], lambda x: x IS NOT NULL)) AS c,
        l_quantity > 40 AS none,
        'Output fell' || CASE WHEN l_linenumber <> 4 THEN ' [' || l_linenumber || ']' ELSE '' END || CASE WHEN l_partkey % 3 = 0 THEN ', then rose [' || (l_suppkey % 5) || '].' ELSE ' [n].' END AS text
       FROM lineitem))"""),
    "mask_secrets": (masked, sql_mask("(SELECT doc_id, text FROM documents)", "doc_id")),
    "mask_secrets_log": (masked_lines, sql_mask(LINES_SQL, "c_custkey")),
    "rank_percentiles": (latency_percentiles, """
SELECT l_returnflag, l_linestatus, count(*) AS n, median(l_extendedprice) AS p50,
 list_sort(list(l_extendedprice))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS p95 FROM lineitem GROUP BY ALL"""),
}
