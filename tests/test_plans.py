"""Physical plans of the heavy operators keep the shape they were designed for."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from helpers import AT, FULL_SUN, LOW, fleet
from heliofleet.operators import catalogue, ranking, routing
from heliofleet.operators.index import _blocks, build_index, postings
from heliofleet.plans.registry import REGISTERED
from heliofleet.session import joined_as_dealt


def plan(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def no_loops(text):
    assert "NestedLoop" not in text and "Cartesian" not in text


def corpus(spark, tmp_path):
    docs = spark.range(20).select("id", F.col("id").alias("pos"), F.lit("t").alias("title"), F.lit("s").alias("section"),
                                  F.concat(F.lit("dust on panel "), F.col("id")).alias("text"))
    docs.write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def test_counting_terms_moves_the_texts_once(spark, tmp_path):
    text = plan(postings(corpus(spark, tmp_path)))
    assert len(re.findall(r"Exchange hash", text)) == 1 and "SortAggregate" not in text


def test_blocks_are_made_where_their_range_was_dealt(spark, tmp_path):
    """One exchange of texts in parts of bounded size; the counts and the blocks need none."""
    text = plan(_blocks(corpus(spark, tmp_path), 16, 2, 3))
    assert len(re.findall(r"Exchange ", text)) == 1
    assert re.search(r"Exchange hashpartitioning\(range#\d+, 3\), REPARTITION_BY_NUM", text)


def test_blocks_travel_as_one_row_per_term_of_a_task(spark, monkeypatch, tmp_path):
    """Blocks are dealt by bucket as a row per term, not per range; taken apart, they are the blocks again."""
    import heliofleet.operators.index as ix
    rows = [(None if i % 17 == 0 else f"c{i % 40}", i if i % 5 else None, "", "", " ".join(["panel"] * (1 + i % 7) + ["fill"] * (i % 11) + [f"w{i}"]))
            for i in range(90)]
    docs = spark.createDataFrame(rows, "id string, pos long, title string, section string, text string")
    blocks = _blocks(docs, 4, 23, 1).cache()
    joined = ix._joined_by_term(blocks)
    assert joined.count() == blocks.select("term").distinct().count() < blocks.count()
    def plain(df):
        return sorted((r["bucket"], r["term"], r["range"], r["top_tf"], r["least_len"], sorted(map(repr, r["entries"]))) for r in df.collect())
    assert plain(ix._taken_apart(joined)) == plain(ix._with_entries(blocks))
    # A task that writes has a bounded part of a bucket, and a term's blocks may lie in several.
    monkeypatch.setattr(ix, "RANGE_CHUNKS", 4)
    monkeypatch.setattr(ix, "DEAL_BYTES", 200)
    monkeypatch.setattr(ix, "PART_BYTES", 50)
    index = build_index(docs, str(tmp_path / "index"))
    files = [p.parent.name for p in (tmp_path / "index" / "blocks").glob("bucket=*/*.parquet")]
    assert len(files) > len(set(files))
    want = sorted(map(repr, postings(docs).select("term", "id", "pos", "tf", "len").collect()))
    assert sorted(map(repr, index.postings().collect())) == want


def test_terms_are_dealt_once(spark, tmp_path):
    """Counts and best weights of terms share one exchange."""
    import heliofleet.operators.index as ix
    index = build_index(corpus(spark, tmp_path), str(tmp_path / "index"))
    text = plan(ix._terms(index.blocks, F.lit(20), F.lit(5.0)))
    assert len(re.findall(r"Exchange ", text)) == 1 and "Join" not in text and "Window" not in text


def test_a_search_moves_no_structs_per_entry(spark, tmp_path):
    index = build_index(corpus(spark, tmp_path), str(tmp_path / "index"))
    text = plan(ranking.bm25(spark.createDataFrame([(1, "dust panel")], "query_id int, query string"), index, 3))
    dealt = re.findall(r"FlatMapCoGroupsInArrow .*", text)
    assert dealt and not any("entries#" in line for line in dealt)


def test_a_term_keeps_the_weight_of_its_twentieth_best_chunk(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("heliofleet.operators.index.RANGE_CHUNKS", 4)
    monkeypatch.setattr("heliofleet.operators.index.DEAL_BYTES", 200)
    docs = spark.createDataFrame([(i, i, "", "", " ".join(["panel"] * (1 + i % 7) + ["fill"] * (i % 11) + ["dust"] * (i < 19))) for i in range(90)],
                                 "id int, pos int, title string, section string, text string")
    index = build_index(docs, str(tmp_path / "index"))
    avg = index.stats.first()["avg_len"]
    weights = {}
    for r in index.postings().collect():
        weights.setdefault(r["term"], []).append(r["tf"] * 2.2 / (r["tf"] + 1.2 * (0.25 + 0.75 * r["len"] / avg)))
    want = {t: sorted(w)[-20] if len(w) >= 20 else 0.0 for t, w in weights.items()}
    got = {r["term"]: r["kth"] for r in index.terms.collect()}
    assert got.keys() == want.keys() == {"panel", "fill", "dust"} and all(abs(got[t] - want[t]) < 1e-9 for t in want)
    assert index.blocks.schema["entries"].dataType.elementType.fieldNames() == ["id", "pos", "tf", "len"]


def test_scores_are_summed_where_the_chunks_are(spark, tmp_path):
    index = build_index(corpus(spark, tmp_path), str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "dust panel")], "query_id int, query string")
    with joined_as_dealt(spark):
        text = plan(ranking.top_k(ranking.bm25(queries, index, 3), 3))
    no_loops(text)
    # Blocks are dealt by range; the only exchange above the sums moves each query's best rows.
    assert len(re.findall(r"Exchange hashpartitioning\(range#\d+, \d+\), REPARTITION_BY_COL", text)) == 2
    assert len(re.findall(r"Exchange hashpartitioning\(range#\d+, term", text)) == 0
    assert not re.search(r"Exchange hashpartitioning\(range#\d+, id", text) and text.count("WindowGroupLimit") == 2


def test_no_plan_node_holds_a_row_per_query_term_and_chunk(spark, tmp_path):
    """Scores are added up in matrices: entries are not exploded, and no aggregate or sort has a row per (query, chunk)."""
    index = build_index(corpus(spark, tmp_path), str(tmp_path / "index"))
    text = plan(ranking.bm25(spark.createDataFrame([(1, "dust panel")], "query_id int, query string"), index, 3))
    assert text.count("FlatMapCoGroupsInArrow") >= 1 and not re.search(r"Generate explode\(entries", text)
    assert not re.search(r"Aggregate\(keys=\[[^\]]*\bpos#", text)


def test_a_search_deals_queries_by_cell_not_by_range(spark, monkeypatch, tmp_path):
    """A query travels once per cell of ranges, with no row per (query, range) and none per (query, term, range)."""
    index = build_index(corpus(spark, tmp_path), str(tmp_path / "index"))
    seen, write = {}, ranking.staged
    def watched(df, purpose):
        seen[purpose] = plan(df)
        return write(df, purpose)
    monkeypatch.setattr(ranking, "staged", watched)
    ranking.bm25_topk(spark.createDataFrame([(1, "dust panel")], "query_id int, query string"), index, 3)
    text = seen["search-best"]
    assert "MapInArrow" in text and not re.search(r"keys=\[[^\]]*query_id#\d+, range#", text)
    assert len(re.findall(r"Exchange hashpartitioning\(", text)) <= 2 and "Generate explode(terms" not in text


def test_results_of_calls_do_not_move_with_questions(spark):
    """Questions meet the long results of calls and passages last: nothing is dealt by question after that."""
    from heliofleet.operators import answers
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chunks = spark.createDataFrame([(1, 1, "Faults", "Trips", "An inverter trips on dew.")], "id int, pos int, title string, section string, text string")
        questions = spark.createDataFrame([(1, "what is an inverter"), (2, "energy over the last 24 hours")], "question_id int, question string")
        texts = spark.createDataFrame([(1, "It trips [1].")], "question_id int, text string")
        told = answers.answer_batch(spark, questions, fleet(spark, LOW, FULL_SUN), chunks, build_index(chunks), texts=texts)
        text = plan(told)
        assert told.count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(question_id#" not in text and "hashpartitioning(call#" in text


def test_runs_of_words_are_not_dealt_to_meet_a_few_phrases(spark):
    questions = spark.createDataFrame([(1, "how is orchard flat")], "question_id int, question string")
    farms = spark.createDataFrame([("ORCH", "Orchard Flat Solar Farm")], "facility_code string, facility_name string")
    text = plan(routing.match_facility(questions, farms))
    assert "BroadcastHashJoin [_run#" in text and "hashpartitioning(_run#" not in text


def test_sentences_are_chosen_where_their_passage_lies(spark):
    from heliofleet.operators import passages
    given = spark.createDataFrame([(1, 1, 2, "Dust. Moss.")], "query_id int, n int, take int, text string")
    text = plan(passages.best_sentences(given, spark.createDataFrame([(1, "moss")], "query_id int, query string"),
                                        spark.createDataFrame([("moss", 2.0)], "term string, idf double")))
    assert "posexplode" not in text and "Window" not in text and "sentence#" not in text


def test_a_search_opens_only_its_buckets(spark, tmp_path):
    index = build_index(corpus(spark, tmp_path), str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "dust panel")], "query_id int, query string")
    wanted = {r[0] for r in index.terms.where("term in ('dust', 'panel')").select("bucket").collect()}
    text = plan(ranking.bm25(queries, index, 3))
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", text)
    listed = [set(map(int, re.findall(r"\b\d+\b", re.sub(r"#\d+", "", f)))) for f in filters if "bucket" in f]
    assert len(listed) >= 2 and all(found == wanted for found in listed) and 0 < len(wanted) < index.buckets


def test_vectors_and_names_meet_without_loops(spark):
    vecs = spark.range(10).select("id", F.col("id").alias("pos"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias("embedding"))
    no_loops(plan(ranking.cosine_topk(vecs.select(F.col("id").alias("query_id"), "embedding"), vecs, 3)))
    questions = spark.createDataFrame([(1, "how is orchard flat")], "question_id int, question string")
    farms = spark.createDataFrame([("ORCH", "Orchard Flat Solar Farm")], "facility_code string, facility_name string")
    no_loops(plan(routing.match_facility(questions, farms)))


@pytest.mark.parametrize("question", [
    catalogue.underperformers, catalogue.curtailed_farms, catalogue.underperformers_report, lambda f, **a: catalogue.fleet_summary(f, 72, **a)])
def test_one_scored_view_per_question(spark, tmp_path, question):
    f = fleet(spark, LOW, FULL_SUN, [("VIC1", AT, 20.0)], [("BRKNSF1", AT, 50.0, 200.0, 200.0, True)])
    for name in ("readings", "weather"):
        getattr(f, name).write.parquet(str(tmp_path / name))
    f = replace(f, readings=spark.read.parquet(str(tmp_path / "readings")), weather=spark.read.parquet(str(tmp_path / "weather")))
    text = plan(question(f, as_of=AT))
    assert text.count("FileScan parquet [duid") == 1 and text.count("FileScan parquet [facility_code") == 1
    no_loops(text)


def test_every_query_has_sql():
    assert [name for name, (_, sql) in REGISTERED.items() if sql is None] == []
