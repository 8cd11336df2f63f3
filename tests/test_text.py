import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heliofleet import fixed
from heliofleet.functions import text as tx
from heliofleet.operators import chunking, evaluation, passages, ranking
from heliofleet.operators.index import build_index, files_version, postings, stored_index
from heliofleet.sources.payloads import read_markdown_corpus
from helpers import rows


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(expression).first()[0]


@pytest.mark.parametrize("text, expand, want", [
    ("prices priced price", False, ["pric", "pric", "pric"]),
    ("How are you", True, []),
    ("What is the PR?", True, ["pr", "performanc", "ratio"]),
    ("ties boss bused seeing a x9 Ladies", False, ["tie", "boss", "bus", "see", "x9", "lady"]),
])
def test_tokens(spark, text, expand, want):
    assert one(spark, tx.tokens(F.col("t"), expand), t=text) == want


@pytest.mark.parametrize("raw, leaked", [
    ("fetch ftp://mara:quiet.lane@files.example.net/daily at noon", "quiet.lane"),
    ("amqps://relay:Zw7%21k@queue.example.org:5671/", "Zw7%21k"),
    ("curl --data api_key=9f-77-aa21 https://weather.example.org", "9f-77-aa21"),
    ('{"token": "mn0pq1rs", "site": 4}', "mn0pq1rs"),
    ("sent Bearer Qm9yZWFsLXRva2Vu.77 to the gateway", "Qm9yZWFsLXRva2Vu.77"),
    ("the model refused sk-live_0123456789abcdefghij twice", "0123456789abcdefghij"),
])
def test_masking(spark, raw, leaked):
    assert leaked not in tx.mask_secrets(spark.createDataFrame([(raw,)], "text string")).first()["text"]


def test_masking_leaves_ordinary_text(spark):
    text = "the secret of a good tariff, a token effort, 14 keys and https://solar.example.net/a@b"
    got = tx.mask_secrets(spark.createDataFrame([(text,)], "text string")).first()
    assert got["text"] == text and got["hits_key_value"] == 0


GUIDE = """# Draft title
Intro line.

## First Part!
Body one.
# Final title
More.

## Empty

##  Second -- part
""" + "\n\n".join("p%d " % i + "x" * 500 for i in range(4)) + "\n"


def test_chunks_of_markdown(spark, tmp_path):
    (tmp_path / "guide.md").write_text(GUIDE)
    (tmp_path / "plain.md").write_text("only text\r\nsecond\n")
    (tmp_path / "README.md").write_text("# skip me\n")
    (tmp_path / "notes.txt").write_text("skip me")
    got = chunking.chunk_documents(read_markdown_corpus(spark, str(tmp_path))).orderBy("doc", "section_no", "part_no").collect()
    assert [r["id"] for r in got] == ["guide#overview", "guide#first-part", "guide#second-part", "guide#second-part-2", "plain#overview"]
    assert {r["title"] for r in got if r["doc"] == "guide"} == {"Final title"} and got[-1]["title"] == "plain"
    assert got[0]["text"] == "Intro line." and got[1]["text"] == "Body one.\nMore." and got[-1]["text"] == "only text\nsecond"
    assert max(len(r["text"]) for r in got) <= fixed.MAX_CHUNK_CHARS and "".join(r["text"] for r in got[2:4]).count("p") == 4


def greedy(text, limit, sep):
    if len(text) <= limit:
        return [text]
    parts = []
    for para in text.split(sep):
        if parts and parts[-1] and len(parts[-1]) + len(para) + len(sep) <= limit:
            parts[-1] += sep + para
        elif parts and not parts[-1]:
            parts[-1] = para
        else:
            parts.append(para)
    return [p for p in parts if p]


def test_packing_matches_a_plain_loop(spark):
    rng = random.Random(3)
    texts = ["\n\n".join("y" * rng.choice([0, 1, 5, 9, 30]) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunking.pack_paragraphs(F.col("t"), 20).alias("p"))
    for r in df.collect():
        assert r["p"] == greedy(r["t"], 20, "\n\n"), repr(r["t"])


def test_fingerprint_sees_every_change_and_no_order(spark):
    a = spark.createDataFrame([("x", "one"), ("y", "two")], "id string, text string")
    value = chunking.corpus_fingerprint(a).first()["fingerprint"]
    assert value == chunking.corpus_fingerprint(a.orderBy(F.desc("id"))).first()["fingerprint"] and re.fullmatch("[0-9a-f]{12}", value)
    assert value != chunking.corpus_fingerprint(a.withColumn("text", F.upper("text"))).first()["fingerprint"]


CORPUS = [
    (1, "Trackers", "Wind stow", "Trackers go flat when the wind is strong. Stow protects the rows! Is it common? Yes."),
    (2, "Faults", "Inverter trips", "An inverter trips on insulation faults. Moisture and dew are likely causes in the morning."),
    (3, "Soiling", "Cleaning", "Dust lowers output. Cleaning pays after a long dry spell. Cleaning cleaning cleaning."),
    (4, "Soiling", "Copies", "Dust lowers output. Cleaning pays after a long dry spell. Cleaning cleaning cleaning."),
    (5, "Empty", "the", "of"),
]


def corpus(spark):
    return spark.createDataFrame([(i, i, t, s, x) for i, t, s, x in CORPUS], "id int, pos int, title string, section string, text string")


def python_bm25(token_lists, query_terms):
    n, lengths = len(token_lists), [len(t) for t in token_lists]
    avg = sum(lengths) / n
    df = Counter(t for toks in token_lists for t in set(toks))
    out = []
    for toks, length in zip(token_lists, lengths):
        tf = Counter(toks)
        out.append(sum(math.log(1 + (n - df[t] + .5) / (df[t] + .5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (.25 + .75 * length / avg))
                       for t in query_terms if tf[t]))
    return out


@pytest.mark.parametrize("stored", [True, False])
def test_bm25_matches_brute_force(spark, stored, tmp_path):
    docs = corpus(spark)
    text = F.concat_ws(" ", "title", "section", "section", "text")
    lists = [r[0] for r in docs.orderBy("pos").select(tx.tokens(text)).collect()]
    asked = ["wash the dust", "why do trackers trip in the wind", "how are you", "inverter"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    index = build_index(docs, str(tmp_path / "index") if stored else None)
    got = {(r["query_id"], r["id"]): r["score"] for r in ranking.bm25(queries, index).collect()}
    want = {}
    for q, line in enumerate(asked):
        terms = set(one(spark, tx.tokens(F.col("t"), True), t=line))
        want |= {(q, i + 1): s for i, s in enumerate(python_bm25(lists, terms)) if s > 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    top = ranking.search(queries, index, 2)
    assert [r["id"] for r in top.where("query_id = 0").orderBy("rank").collect()] == [3, 4]  # a tie goes to corpus order
    assert top.where("query_id = 2").count() == 0 and top.first()["method"] == "bm25"


def test_ranges_out_of_reach_are_skipped(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("heliofleet.operators.index.RANGE_CHUNKS", 4)
    rng = random.Random(6)
    rows_ = [(i, i, "", "", " ".join(["panel"] * rng.randrange(1, 4) + (["zebra"] if i % 10 == 0 else []) + ["fill"] * rng.randrange(9))) for i in range(400)]
    docs = spark.createDataFrame(rows_, "id int, pos int, title string, section string, text string")
    index = build_index(docs, str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "zebra panel"), (2, "panel"), (3, "nothing here"), (4, "zebra")], "query_id int, query string")
    asked, blocks = ranking.opened(queries, index)
    def ranges(k):
        found = ranking.ranges_in_reach(asked, index, blocks, k, fixed.BM25_K1, fixed.BM25_B)
        return {q: n for q, n in found.groupBy("query_id").agg(F.countDistinct("range")).collect()}
    every, reached = ranges(None), ranges(5)
    assert reached[1] < every[1] / 2 and 3 not in reached
    best = rows(ranking.bm25_topk(queries, index, 5), "query_id", "rank", "id", "score")
    assert best == rows(ranking.top_k(ranking.bm25(queries, index), 5), "query_id", "rank", "id", "score") and len(best) == 15
    # Beyond what the index keeps a bar for, nothing is skipped.
    assert ranges(30) == every and ranking.bm25_topk(queries, index, 30).count() == 90


@pytest.mark.parametrize("cells", [1 << 22, 40])
def test_scores_of_repeated_and_null_ids_match_sums_over_postings(spark, monkeypatch, tmp_path, cells):
    """Queries are added up some at a time; a question that stands twice counts twice, a chunk without an id is one."""
    monkeypatch.setattr("heliofleet.operators.index.RANGE_CHUNKS", 8)
    monkeypatch.setattr(ranking, "SUM_CELLS", cells)
    rng = random.Random(9)
    words = ["panel", "dust", "zebra", "wind", "moss", "dew"]
    rows_ = [(None if i % 17 == 0 else i % 40, None if i % 17 == 0 else i % 40, None, "s", " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for i in range(60)]
    docs = spark.createDataFrame(rows_, "id int, pos int, title string, section string, text string")
    index = build_index(docs, str(tmp_path / "index"))
    asked = [(1, "dust panel"), (1, "dust panel"), (2, "moss"), (3, "absent"), (4, " ".join(words)), (5, "zebra wind dew")]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    avg, idf, want = index.stats.first()["avg_len"], {r["term"]: r["idf"] for r in index.terms.collect()}, {}
    terms = [(r["query_id"], r["terms"]) for r in queries.select("query_id", tx.tokens(F.col("query")).alias("terms")).collect()]
    for r in index.postings().collect():
        for q, its in terms:
            if r["term"] in its:
                key = (q, r["id"], r["pos"])
                want[key] = want.get(key, 0.0) + idf[r["term"]] * r["tf"] * 2.2 / (r["tf"] + 1.2 * (0.25 + 0.75 * r["len"] / avg))
    got = {(r["query_id"], r["id"], r["pos"]): r["score"] for r in ranking.bm25(queries, index).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want) and any(k[1] is None for k in got)
    best = sorted(tuple(r)[:4] for r in ranking.bm25_topk(queries, index, 3).select("query_id", "rank", "score", "pos").collect())
    def first(q):  # a missing place in the corpus comes before any other
        return sorted(((k[2], s) for k, s in got.items() if k[0] == q), key=lambda x: (-x[1], -1 if x[0] is None else x[0]))[:3]
    assert best == [(q, n, s, p) for q in (1, 2, 4, 5) for n, (p, s) in enumerate(first(q), 1)]


def test_a_task_of_a_search_holds_a_bounded_part_of_the_corpus(spark, monkeypatch, tmp_path):
    """Shuffles of a search have partitions by the chunks of the index, and are as before after it."""
    monkeypatch.setattr("heliofleet.operators.index.RANGE_CHUNKS", 4)
    monkeypatch.setattr(ranking, "RANGE_CHUNKS", 4)
    monkeypatch.setattr(ranking, "TASK_RANGES", 2)
    docs = spark.range(200).select("id", F.col("id").alias("pos"), F.lit("").alias("title"), F.lit("").alias("section"), F.lit("dust on panel").alias("text"))
    index = build_index(docs, str(tmp_path / "index"))
    seen, write = [], ranking.staged
    def watched(df, purpose):
        seen.append((purpose, spark.conf.get("spark.sql.shuffle.partitions")))
        return write(df, purpose)
    monkeypatch.setattr(ranking, "staged", watched)
    best = ranking.bm25_topk(spark.createDataFrame([(1, "dust")], "query_id int, query string"), index, 3)
    assert [r["id"] for r in best.orderBy("rank").collect()] == [0, 1, 2]
    assert dict(seen)["search-best"] == "25" and spark.conf.get("spark.sql.shuffle.partitions") == "4"


@pytest.mark.parametrize("queries_per_task, rows_at_once", [(1 << 18, 512), (3, 2)])
def test_cells_of_queries_and_ranges_find_the_best_of_all(spark, monkeypatch, tmp_path, queries_per_task, rows_at_once):
    """Cells of several ranges with ties, string ids, missing ids and a term no chunk has give what all sums give."""
    monkeypatch.setattr("heliofleet.operators.index.RANGE_CHUNKS", 8)
    for name, value in (("RANGE_CHUNKS", 8), ("TASK_RANGES", 1), ("MOST_RANGES", 3), ("RANGE_QUERIES", 0), ("TASK_QUERIES", queries_per_task), ("QUERY_ROWS", rows_at_once)):
        monkeypatch.setattr(ranking, name, value)
    rng = random.Random(3)
    words = ["panel", "dust", "zebra", "wind", "moss", "dew"]
    rows_ = [(None if i % 19 == 0 else f"c{i}", None if i % 19 == 0 else i, None, "s", " ".join(rng.choices(words, k=rng.randrange(1, 5)))) for i in range(150)]
    index = build_index(spark.createDataFrame(rows_, "id string, pos int, title string, section string, text string"), str(tmp_path / "index"))
    asked = [(i, " ".join(rng.sample(words + ["absent"], 1 + i % 5))) for i in range(12)] + [(0, "dust dew"), (None, "dust")]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    def best(df):
        return sorted(map(tuple, df.where("query_id is not null").select("query_id", "rank", F.coalesce("id", F.lit("")), "score").collect()))
    every = ranking.bm25(queries, index)
    for k in (3, 30):
        found = ranking.bm25_topk(queries, index, k)
        assert best(found) == best(ranking.top_k(every, k))
        assert found.where("query_id is null").count() == (0 if k == 3 else 30)


def test_best_sentences_of_repeated_passages(spark):
    """Texts that share a passage's key are one passage; a passage without words has no extract, one without a query its first sentences."""
    given = [(1, 1, 2, "Dust falls. Moss grows. Dew and moss."), (1, 2, 1, "Nothing. Moss."), (2, 1, 1, "Dew."), (2, 1, 1, "Dust. Moss moss."), (3, 1, 2, "  "),
             (4, 1, 1, None), (None, 1, 1, "One. Moss.")]
    terms = spark.createDataFrame([("moss", 2.0), ("dew", 1.0), ("dust", 0.5)], "term string, idf double")
    queries = spark.createDataFrame([(1, "moss dew"), (2, "dew moss dust"), (2, "dust"), (None, "moss")], "query_id int, query string")
    got = passages.best_sentences(spark.createDataFrame(given, "query_id int, n int, take int, text string"), queries, terms)
    # Passage (2, 1): both texts' first sentences weigh 1 + 0.5 * 2 = 2.0 as its first place, "Moss moss." as its second weighs 2.0 too.
    assert {(r["query_id"], r["n"], r["extract"]) for r in got.collect()} - {(2, 1, "Dew."), (2, 1, "Dust.")} == {
        (1, 1, "Moss grows. Dew and moss."), (1, 2, "Moss."), (None, 1, "One.")}
    assert got.where("query_id = 2").count() == 1


def test_stored_index_is_built_once_per_version(spark, tmp_path):
    docs = corpus(spark)
    first = stored_index(docs, str(tmp_path))
    assert sorted(map(tuple, first.postings().collect())) == sorted(map(tuple, postings(docs).select("term", "id", "pos", "tf", "len").collect()))
    folders = sorted(p.name for p in tmp_path.iterdir())
    again = stored_index(docs.orderBy(F.desc("id")), str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == folders and len(list((tmp_path / folders[0]).glob("build-*"))) == 1
    assert rows(again.terms, "term", "df") == rows(first.terms, "term", "df")
    stored_index(docs.where("id < 4"), str(tmp_path))
    assert len(list(tmp_path.iterdir())) == 2


def test_a_build_that_died_is_not_read(spark, tmp_path):
    docs = corpus(spark)
    build_index(docs.limit(1), str(tmp_path / "keyword-index-x" / "build-dead"))
    docs.write.parquet(str(tmp_path / "docs"))
    table = spark.read.parquet(str(tmp_path / "docs"))
    version = files_version(table)
    assert stored_index(table, str(tmp_path), version).stats.first()["chunks"] == 5
    docs.limit(2).write.mode("overwrite").parquet(str(tmp_path / "docs"))
    table = spark.read.parquet(str(tmp_path / "docs"))
    assert files_version(table) != version and stored_index(table, str(tmp_path), files_version(table)).stats.first()["chunks"] == 2


def test_an_empty_corpus_answers_nothing(spark, tmp_path):
    index = build_index(corpus(spark).limit(0), str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "zebra panel")], "query_id int, query string")
    assert ranking.bm25_topk(queries, index, 5).count() == 0


def test_cosine_matches_brute_force_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 7)
    monkeypatch.setattr(ranking, "VECTOR_BLOCK", 11)
    rng = random.Random(5)
    vecs = {i: [rng.uniform(-1, 1) for _ in range(6)] for i in range(40)}
    vecs[40], vecs[41], vecs[42] = vecs[3], vecs[3], [0.0] * 6
    rows_ = [(i, i, [float(x) for x in v]) for i, v in vecs.items()]
    df = spark.createDataFrame(rows_, "id long, pos long, embedding array<double>")
    got = ranking.cosine_topk(df.select(F.col("id").alias("query_id"), "embedding"), df, 5)

    def cosine(a, b):
        na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0

    want = [(q, r + 1, i) for q in vecs for r, i in enumerate(sorted(vecs, key=lambda i: (-round(cosine(vecs[q], vecs[i]), 9), i))[:5])]
    assert rows(got, "query_id", "rank", "id") == sorted(want)


def test_cosine_refuses_unequal_lengths(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<double>")
    b = spark.createDataFrame([(1, 1, [1.0])], "id long, pos long, embedding array<double>")
    with pytest.raises(Exception, match="unequal length"):
        ranking.cosine_topk(a, b).collect()


def test_fusion_and_its_ties(spark):
    def ranks(ids):
        return spark.createDataFrame([(1, i, r + 1) for r, i in enumerate(ids)], "query_id int, id string, rank int")
    got = ranking.rrf(ranks(["a", "b", "c"]), ranks(["d", "b", "a"]), 4).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["a", "b", "d", "c"]
    assert got[0]["score"] == pytest.approx(1 / 61 + 1 / 63) and got[1]["score"] == pytest.approx(2 / 62)
    tied = ranking.rrf(ranks(["x"]), ranks(["y"]), 2).orderBy("rank").collect()
    assert [r["id"] for r in tied] == ["x", "y"]


def test_evaluation(spark):
    expected = spark.createDataFrame([(1, "d#a"), (2, "d#b"), (2, "e#a"), (3, "f#a")], "case_id int, id string")
    ranked = spark.createDataFrame([(1, "d#a", 1), (2, "d#x", 1), (2, "f#a", 2), (2, "e#a", 4), (3, "d#a", 1)], "case_id int, id string, rank int")
    known = spark.createDataFrame([("d#a",), ("d#b",), ("e#a",), ("f#a",), ("d#x",)], "id string")
    got = evaluation.evaluate_retrieval(evaluation.case_ranks(expected, ranked, known)).first()
    assert (got["hit_at_1"], got["hit_at_3"], got["hit_at_5"], got["mrr"], got["doc_hit_at_3"]) == (0.333, 0.333, 0.667, 0.417, 0.667)
    assert rows(evaluation.misses(evaluation.case_ranks(expected, ranked, known), ranked), "case_id", "got") == [(2, ["d#x", "f#a"]), (3, ["d#a"])]
    with pytest.raises(Exception, match="unknown expected id: f#a"):
        evaluation.case_ranks(expected, ranked, known.where("id <> 'f#a'")).collect()


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_rank_percentiles(spark, n):
    rng = random.Random(n)
    values = [rng.choice([1.0, 1.0, 2.5, rng.uniform(0, 9)]) for _ in range(n)]
    got = evaluation.rank_percentiles(spark.createDataFrame([("g", v) for v in values], "g string, v double").withColumnRenamed("v", "ms"), "ms", ["g"]).first()
    ordered = sorted(values)
    middle = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
    assert (got["n"], got["p50"], got["p95"]) == (n, pytest.approx(middle), ordered[int(0.95 * (n - 1))])


def test_percentiles_of_crowded_and_scattered_values(spark):
    rng = random.Random(9)
    crowd = [("crowd", rng.random() * 1e-9) for _ in range(4000)]  # all within one unit, and then one far out
    wide = [("wide", rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300)) for _ in range(1500)]
    same = [(None, 7.0)] * 900 + [(None, 8.0)] * 99
    data = crowd + [("crowd", 1e18)] + wide + same
    got = {r["g"]: r for r in evaluation.rank_percentiles(spark.createDataFrame(data, "g string, ms double"), "ms", ["g"]).collect()}
    for g in ("crowd", "wide", None):
        values = sorted(v for k, v in data if k == g)
        n = len(values)
        assert (got[g]["n"], got[g]["p50"], got[g]["p95"]) == (n, (values[(n - 1) // 2] + values[n // 2]) / 2, values[int(0.95 * (n - 1))])


def test_extractive_answer(spark):
    docs = corpus(spark)
    index = build_index(docs)
    queries = spark.createDataFrame([(1, "why do trackers stow in the wind"), (2, "how are you")], "query_id int, query string")
    hits = ranking.search(queries, index, 4).join(docs.select("id", "text"), "id").select("query_id", F.col("rank").alias("n"), "score", "text")
    got = dict(rows(passages.extractive_answers(hits, queries, index.terms)))
    assert got[1] == "Trackers go flat when the wind is strong. Stow protects the rows! Is it common? [1]"
    assert got[2] == fixed.NO_PASSAGES_TEXT


def test_citations(spark):
    df = spark.createDataFrame([(1, "fine [1].", [1, 2]), (2, "none", [1, 2]), (3, "bad [7]", [1, 2]), (4, "nothing given", [])], "i int, text string, given array<int>")
    assert rows(passages.check_citations(df), "i", "valid", "reason") == [
        (1, True, None), (2, False, "answer cites no passages"), (3, False, "answer cites unknown passages [7]"), (4, True, None)]


def test_blocks_of_queries_grow_before_they_become_many(spark, monkeypatch):
    """A vector is copied once per block of queries; each block leaves one row here."""
    import pandas as pd
    for name, size in (("QUERY_BLOCK", 2), ("FEW_BLOCKS", 3), ("MOST_QUERIES", 50)):
        monkeypatch.setattr(ranking, name, size, raising=False)

    def one_row(k):
        return lambda q, v: pd.DataFrame({"query_id": q["query_id"][:1], "id": v["id"][:1], "pos": v["pos"][:1], "score": [0.0] * len(q[:1])})
    monkeypatch.setattr(ranking, "_cell", one_row)
    vecs = spark.range(60).select("id", F.col("id").alias("pos"), F.array(F.lit(1.0)).alias("embedding"))
    assert ranking.cosine_topk(vecs.select(F.col("id").alias("query_id"), "embedding"), vecs, 3).count() == 3
