"""The corpus pipeline's stages against brute force: null ids and texts, repeated rows and ids, clashing columns."""

import collections
import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key long, key string"
ITEM = "what is the name of the river that runs past the old mill"


def texts():
    rng = random.Random(12)
    lexicon = ["".join(rng.choice("abdeghilmnorstu") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    new = lambda n: " ".join(rng.choice(lexicon) for _ in range(n))
    a, b, c, d, e, passage = new(50), new(40), new(60), new(45), new(30), new(20)
    near = lambda t: t + " end"
    return [
        (1, a), (2, b), (7, a), (7, c),  # the id of a copy also has a text of its own
        (2, b), (2, b),  # repeated rows
        (None, near(a)), (None, d), (None, near(d)), (None, d), (9, e), (None, e),  # copies without an id
        (None, f"{new(20)} {ITEM} {new(20)}"), (11, f"{new(20)} {ITEM.upper()}"), (12, new(30)), (12, f"{new(9)} {ITEM}"),  # leaks
        (20, f"{new(15)} {passage} {new(15)}"), (21, f"{new(25)} {passage}"),
        (None, None), (None, None), (None, ""), (30, None), (30, None), (31, "  "), (32, "one two")]


def words(text):
    return (text or "").split()


def shingles(text, n):
    w = [x.lower() for x in words(text)]
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def without_copies(rows):
    sets = [shingles(t, 5) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                group = [group[j] if g == group[i] else g for g in group]
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0, i)
    return [rows[i] for i in range(len(rows)) if order(i) == min(order(j) for j in range(len(rows)) if group[j] == group[i])]


def without_passages(rows):
    first = {}
    for i, t in rows:
        for k in range(len(words(t)) - 12):
            if i is not None:
                at = tuple(words(t)[k:k + 13])
                first[at] = min(i, first.get(at, i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {j for k in range(len(w) - 12) if i is not None and first[tuple(w[k:k + 13])] < i for j in range(k, k + 13)}
        out.append((i, " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t))
    return out


def without_leaks(rows):
    item = shingles(ITEM, 5)
    return [(i, t) for i, t in rows if 100 * len(item & shingles(t, 5)) < 80 * len(item)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "xx", "s", len(t or ""), 3, "clash") for i, t in texts()]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def counted(frame):
    return collections.Counter((r.doc_id, r.text) for r in frame.collect())


def test_near_copies_are_dropped_by_row(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = corpus_pipeline.minhash_near_dedup(spark, docs, tables)
    want = without_copies(texts())
    assert counted(got) == collections.Counter(want) and got.columns == list(corpus_pipeline.COLUMNS)
    by_id = collections.Counter(i for i, _ in want)
    assert by_id[7] == 1 and by_id[2] == 1 and by_id[30] == 2 and 15 < len(want) < len(texts())


def test_leaks_are_dropped_by_row(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = corpus_pipeline.decontamination(spark, docs, tables)
    want = without_leaks(texts())
    assert counted(got) == collections.Counter(want) and len(want) == len(texts()) - 3


def test_passages_of_earlier_documents_go(spark, tables):
    got = corpus_pipeline.substring_dedup(spark, spark.read.parquet(f"{tables}/documents.parquet"), tables)
    want = collections.Counter(without_passages(texts()))
    assert counted(got) == want and want != collections.Counter(texts())


def test_packing_gives_the_token_ids(spark, tables):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    got = corpus_pipeline.packing(spark, spark.read.parquet(f"{tables}/documents.parquet"), tables).collect()
    want = collections.Counter((i, *tokenizer.encode(t or "", add_special_tokens=False).ids, 1) for i, t in texts())
    assert collections.Counter((r.doc_id, *r.ids) for r in got) == want
