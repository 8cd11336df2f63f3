"""The text-pipeline operators against brute force, on small tables with nulls, ties and copies."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliofleet.llm.decontaminate import contained_items
from heliofleet.llm.embedding import build_graph, near_vectors, range_search
from heliofleet.llm.graph import components
from heliofleet.llm.htmltext import blocks_of, extract_text, host_of
from heliofleet.llm.lm import score_texts
from heliofleet.llm.minhash import near_duplicates
from heliofleet.llm.packing import first_fit, pack_documents
from heliofleet.llm.quality import score_quality
from heliofleet.llm.queries import tokenizer_path
from heliofleet.llm.sharding import shard_by_bytes
from heliofleet.llm.substring import remove_repeats
from heliofleet.llm.tables import crc_mod
from heliofleet.llm.toxicity import label_model, score_toxicity
from heliofleet.llm.words import blocks, gathered, pack, pack_small, split_words, unpack, unpack_small

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, bucket int"


def words_of(text, lower=True):
    text = text or ""
    return SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


def corpus():
    """Invented texts: copies, near copies, shared passages, empties, odd white space, long and short ones."""
    rng = random.Random(4)
    lexicon = ["".join(rng.choice("abdeghiklmnoprstuvéüß") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts = [" ".join(rng.choice(lexicon) for _ in range(rng.choice([3, 20, 60, 150]))) for _ in range(60)]
    passage = " ".join(rng.choice(lexicon) for _ in range(55))
    for i in range(0, 12):
        texts.append(texts[i] + "\n" + passage + " " + texts[-1 - i])
    base = texts[3].split() * 2 + texts[7].split()
    for i in range(25):  # near copies of one text
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = rng.choice(lexicon)
        texts.append(" ".join(own))
    texts += [texts[5]] * 8 + [texts[5].upper(), "", None, "   \t ", "one", "one two", "One TWO", "a\x0bb c d  e", "x" * 3000,
                               " ".join(rng.choice(lexicon) for _ in range(9000))]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "xx", "s", len(t or ""), "clash", 7) for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def test_words_and_binary_columns():
    import pyarrow as pa
    texts = ["  A b\x0bC ", None, "", "d"]
    words = split_words(pa.array(texts), lower=True)
    assert words.lengths.tolist() == [3, 0, 0, 1]
    assert [words.vocab[i].as_py() for i in words.codes] == ["a", "b", "c", "d"]
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64))
    assert (unpack(pack(keys, sorted_=True), np.uint64, sorted_=True) == keys).all()
    for values in ([], [0], [255, 3], [70_000, 2**40]):
        assert unpack_small(pack_small(np.array(values, np.int64))).tolist() == values
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", "c" * 9, "d", None])], names=["text"])
    assert [b.num_rows for b in blocks(batch, "text", 3)] == [1, 1, 2]
    assert [b.num_rows for b in gathered(iter([batch, batch.slice(0, 1), batch.slice(0, 0)]), "text", 10)] == [4, 1]
    assert list(gathered(iter([]), "text")) == []


def test_substring_removal(docs):
    got = {r.doc_id: r for r in remove_repeats(docs, carry=("root", "text")).collect()}
    first = {}
    for i, t in corpus():
        w = words_of(t, False)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k:k + 13]), i)
    for i, t in corpus():
        w = words_of(t, False)
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k:k + 13])] < i for j in range(k, k + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_text, r.root, r.text) == (len(w), len(gone), kept, "clash", t), i
        assert {j for s in r.spans for j in range(s.start, s.end)} == gone
    assert sum(r.n_removed for r in got.values()) > 500


def test_near_duplicates(docs):
    for shingle in (4, 5):
        sets = {}
        for i, t in corpus():
            w = words_of(t)
            sets[i] = {tuple(w[k:k + shingle]) for k in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
        group = {i: i for i in sets}
        for a in sets:
            for b in range(a):
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    old, new = sorted((group[a], group[b]), reverse=True)
                    group = {k: new if v == old else v for k, v in group.items()}
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, shingle=shingle).collect()}
        assert got == {i: (len(sets[i]), group[i], group[i] == i) for i in sets}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3), (9, 8)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_language_model(docs):
    train = crc_mod("doc_id", 7) != 2
    got = {r.doc_id: r for r in score_texts(docs, train).collect()}
    counts, pairs = collections.Counter(), collections.Counter()
    tokens = {i: [*words_of(t), None] for i, t in corpus()}
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(w)
    total, distinct = sum(counts.values()), len(counts)
    for i, w in tokens.items():
        base = sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(base) and r.score < 0
    seen = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    assert sum(got[i].score for i in seen) > sum(got[i].base_score for i in seen)
    assert not pairs


def test_language_model_is_a_distribution(spark):
    """The probabilities after one context add up to one, the unknown word included."""
    rows = [(i, "a b a c a b b") for i in range(40)]
    ask = [(1000, "a"), (1001, "b"), (1002, "c"), (1003, "zzz"), (1004, "")]
    df = spark.createDataFrame(rows + ask, "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_texts(df, F.col("doc_id") < 1000).collect()}
    # first word after the start mark, with the end after it taken out by a second question
    two = spark.createDataFrame(rows + [(2000 + k, t) for k, t in enumerate(["a", "a a", "a b", "a c", "a zzz"])], "doc_id long, text string")
    more = {r.doc_id: r.score for r in score_texts(two, F.col("doc_id") < 1000).collect()}
    assert got[1000] == pytest.approx(more[2000])
    assert all(x <= 0 for x in [*got.values(), *more.values()])


def test_packing(docs):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = pack_documents(docs, tokenizer_path(), 256, with_ids=True).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in corpus():
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted(by_doc[i], key=lambda r: r.start)
        assert [x for r in mine for x in r.ids] == want
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.doc_tokens == len(want)
    used = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
        used += at
    assert used / 256 / len(by_sequence) > 0.95


def test_word_ids_equal_whole_text_ids(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path())
    odd = ["Don't STOP, it's 3.14!", "naïve Ångström étude İstanbul", "a<|endoftext|>b <|startoftext|>", "x y z \x1c q", "### a&&& b*** (c)", "日本語 テスト", "ΑΣ Σ"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in pack_documents(df, tokenizer_path(), 4096, with_ids=True).collect()}
    for i, t in enumerate(odd):
        assert got[i] == tokenizer.encode(t, add_special_tokens=False).ids + [1], t


def test_first_fit_tree():
    rng = random.Random(2)
    sizes = sorted((rng.randint(1, 60) for _ in range(300)), reverse=True)
    rooms, want = [], []
    for s in sizes:
        at = next((k for k, room in enumerate(rooms) if room >= s), len(rooms))
        if at == len(rooms):
            rooms.append(100)
        want.append((at, 100 - rooms[at]))
        rooms[at] -= s
    assert list(zip(*first_fit(sizes, 100))) == want
    assert first_fit([], 10) == ([], [])


def test_byte_shards(docs):
    got = shard_by_bytes(docs, 16).collect()
    texts = dict(corpus())
    by = collections.defaultdict(list)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        by[r.shard].append(r)
    last = -1
    for k in sorted(by):
        rows = sorted(by[k], key=lambda r: r.slot)
        assert [r.slot for r in rows] == list(range(len(rows))) and rows[0].doc_id > last
        last = rows[-1].doc_id
    total, biggest = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert sum(map(len, by.values())) == len(texts) and set(by) <= set(range(16))
    assert all(sum(r["size"] for r in v) <= total / 16 + biggest for v in by.values())


def test_decontamination(spark, docs):
    texts = dict(corpus())
    long = words_of(texts[max(texts)])
    items = [(1, " ".join(long[4000:4030])), (2, " ".join(long[5000:5020]) + " never seen words here at all"), (3, "one two"),
             (4, None), (5, ""), (6, " ".join(long[100:140]).upper()), (7, "nothing of this is anywhere in it")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in contained_items(docs, bench).collect()}
    want = {}
    for j, t in items:
        w = (t or "").lower().split()
        n = min(5, len(w))
        own = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set()
        for i, text in texts.items():
            v = [x for x in re.split(r"[ \t-\r]+", (text or "").lower()) if x]
            both = own & {tuple(v[k:k + n]) for k in range(len(v) - n + 1)}
            if own and 100 * len(both) >= 80 * len(own):
                want[i, j] = (len(own), len(both))
    assert got == want and len(want) >= 3


def test_html(spark):
    page = ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a>Home base</a></nav>"
            "<div class='ad-box'>Buy &amp; go</div><article><h1>Head &copy;</h1><p><b>One<br>two<p>three\n  four &#233;&nbsp;x</p>"
            "<div class=comments><p>nice!</p></div><form>name</form>tail</article><aside>side</aside><footer>F</footer>")
    assert blocks_of(page) == [(1, "Home base"), (1, "Buy & go"), (0, "Head ©"), (0, "One two"), (0, "three four é x"), (1, "nice!"),
                               (1, "name"), (0, "tail"), (1, "side"), (1, "F")]
    assert host_of("HTTPS://u@A.b:80/x") == "a.b" and host_of(None) == ""
    shared = "welcome to the same long line on every page of this site"
    plain = [(i, f"http://h.example/{i}", f"<p>{shared}</p><p>only page {i} says this in full words</p>") for i in range(3)]
    rows = plain + [(10, "http://h.example/a", page), (11, None, None), (12, "http://o.example", f"<p>{shared}</p>"), (10, "http://h.example/a", page)]
    got = collections.defaultdict(list)
    for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got[r.page_id].append((r.text, r.n_chars))
    for i in range(3):
        assert got[i] == [(f"only page {i} says this in full words", len(f"only page {i} says this in full words"))]
    assert got[10] == [("Head ©\nOne two\nthree four é x\ntail", 34)] * 2 and got[11] == [("", 0)] and got[12] == [(shared, len(shared))]


@pytest.mark.parametrize("page, text", [
    ("<p>a <svg class=i/> b</p><p>c</p>", "a b|c"),
    ("<p>a<svg><text>no</text></svg> b</p><script src='x.js'/><p>c</p>", "a b|c"),
    ("<p>a<svg> b</p><p>c</p>", "a b|c"),
    ("<template/><p>a</p><iframe src=x/><p>b</p><script>if (1) {}", "a|b"),
    ('<div class="layout-with-sidebar"><main><p>a</p></main><div class="sidebar">no</div></div>', "a"),
    ("<form id=aspnet><nav>no</nav><main><p>a</p></main></form>", "a"),
    ("<form><article><p>a</p><div class=comments><article>no</article></div></article></form>", "a"),
    ('<div class="comments"><article>no</article></div><main><nav>no</nav>a</main>', "a"),
    ('<article><div class="article-header"><h1>Title</h1></div><div class="header">b</div><p>a</p></article>', "Title|b|a"),
    ('<section id="how-search-works"><h2 id="related-work">Related</h2><p>a</p></section><div id="search">no</div>', "Related|a"),
    ('<p data-class="ad">a</p><p class="ad-slot big">no</p>', "a"),
])
def test_pages_that_marks_might_empty(page, text):
    assert "|".join(t for role, t in blocks_of(page) if role != 1) == text


def test_menus_go_by_repeats_alone(spark, monkeypatch):
    """Without any marks, by class or by tag, what many pages of a host share still goes, and their own text stays."""
    from heliofleet.llm import htmltext
    monkeypatch.setattr(htmltext, "_MARKS", frozenset())
    monkeypatch.setattr(htmltext, "_MARKED_TAGS", frozenset())
    rng = random.Random(2)
    own = {i: [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(2, 30))) for _ in range(4)] for i in range(30)}
    rows = [(i, f"http://h.example/{i}", "<nav><a>Home</a> <a>News and views of today</a> <a>About</a></nav>"
             + "".join(f"<p>{t}</p>" for t in own[i]) + "<footer>All rights reserved by the people of this house</footer>") for i in own]
    taken = [(page_id, htmltext.blocks_of(html)) for page_id, _, html in rows]
    assert all(role == 2 for _, found in taken for role, _ in found)
    streams = [np.concatenate([htmltext._numbers(t.split(" ")) for _, t in found]) for _, found in taken]
    host = htmltext._host_key("h.example")
    runs = collections.Counter(k for s in streams for k in np.unique(htmltext.grams(s, htmltext.RUN) ^ host).tolist())
    repeated = np.array([k for k, n in runs.items() if n >= htmltext.MANY], np.uint64)
    line = htmltext._numbers("All rights reserved by the people of this house".split(" "))
    menu = htmltext._numbers("Home News and views of today About".split(" "))
    gone = np.array([htmltext._key(line, host), htmltext._key(menu, host)])
    for page_id, found in taken:
        assert htmltext.main_text(found, repeated, gone, "h.example")[0] == "\n".join(own[page_id])


def test_repeated_length_by_brute_force():
    """Longest beginning that enough pages have; a page with several suffixes counts once."""
    from heliofleet.llm.htmltext import repeated_length, suffix_array
    rng = np.random.default_rng(7)
    pages = [[rng.integers(0, 2, rng.integers(1, 9)).astype(np.uint64) for _ in range(rng.integers(1, 4))] for _ in range(40)]
    rows: dict = {}
    for own in pages:
        order, shared = suffix_array(own)
        for i, n in zip(order, shared):
            rows[own[i].tobytes()] = rows.get(own[i].tobytes(), 0) + 1
            if n:
                rows[own[i][:n].tobytes()] = rows.get(own[i][:n].tobytes(), 0) - 1
    suffixes = [np.frombuffer(k, np.uint64) for k in rows]
    for many in (1, 3, 10):
        got = repeated_length(suffixes, list(rows.values()), many)
        for s, n in zip(suffixes, got):
            have = [sum(any(len(o) >= d and (o[:d] == s[:d]).all() for o in own) for own in pages) for d in range(1, len(s) + 1)]
            assert n == max((d for d, c in enumerate(have, 1) if c >= many), default=0)


def test_html_without_article(spark):
    """Open paragraphs stay whole; only blocks that lie in a repeat on many pages go."""
    line, menu = "this long line stands on every page of the site", ["Home", "News of today", "About us", "Contact"]
    six = "one two three four five six"
    def page(i, *more):
        return "".join(f"<div>{m}</div>" for m in menu) + f"<p>Page {i} says {six} and then {i} again</p><h2>Summary</h2><p>{i} times</p>" + "".join(f"<p>{m}</p>" for m in more) + f"<p>{line}</p>"
    rows = [(i, f"http://a.example/{i}", page(i, *([f"before {line} after {i}"] if i == 2 else []))) for i in range(8)]
    copy = "<p>A text that is the same on both pages of this host</p><h2>Summary</h2><p>and goes on here for some words</p>"
    rows += [(20 + i, f"http://b.example/{i}", copy) for i in range(4)]
    rows += [(30, "http://c.example/1", f"<p>{six} seven</p>"), (31, "http://c.example/2", f"<p>zero {six}</p>")]
    got = {r.page_id: (r.text, r.n_repeated) for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        own = f"Page {i} says {six} and then {i} again\nSummary\n{i} times" + (f"\nbefore {line} after 2" if i == 2 else "")
        assert got[i][0] == own and got[i][1] > 0
    assert all(got[20 + i] == ("A text that is the same on both pages of this host\nSummary\nand goes on here for some words", 0) for i in range(4))
    assert got[30] == (f"{six} seven", 0) and got[31] == (f"zero {six}", 0)


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    x = np.vstack([base[i % 30] + rng.normal(size=16) * 0.12 for i in range(600)] + [base[0]] * 20).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None]), (904, [1.0, 2.0]), (905, [2.0, 4.0]), (906, [])]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    assert sum(got[i].n_links for i in range(len(x))) >= 0.97 * links.sum() and links.sum() > 400
    assert all(got[i].n_links <= links[i].sum() for i in range(len(x)))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (900, 901, 902, 903, 906))
    assert got[905].component_id == 904 and got[904].n_links == 1
    graph = build_graph(unit[:200])
    found = set(zip(*range_search(unit[:200], graph, unit[:40], 0.95)))
    true = set(zip(*np.nonzero(unit[:40] @ unit[:200].T >= 0.95)))
    assert len(true & found) >= 0.97 * len(true)


def test_classifiers(spark):
    rng = random.Random(8)
    good = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(500):
        words = [rng.choice(good) for _ in range(rng.randint(20, 120))]
        bad, toxic = i % 3 == 0, i % 5 == 0
        if bad:
            words = [w + rng.choice(["***", "###", "$$$"]) for w in words]
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = "zork" + rng.choice(["an", "el", "ig", "os"])
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1, int(toxic)))
    rows += [(900, None), (901, ""), (None, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(5000, None, None)], "doc_id long, quality int, toxic int")
    for score, label, at in ((score_quality, 1, 0.5), (score_toxicity, 2, 0.3)):
        got = {r.doc_id: r.score for r in score(docs, marks, lambda c: crc_mod(c, 4) != 2).collect()}
        held = [r for r in labels if zlib.crc32(str(r[0]).encode()) % 4 == 2]
        right = sum((got[r[0]] >= at) == (r[label] == 1) for r in held)
        assert right >= 0.95 * len(held) and len(got) == 503 and all(0 <= s <= 1 for s in got.values())
    none = score_toxicity(docs, marks.where("toxic is null"), lambda c: crc_mod(c, 4) != 2).collect()
    assert len(none) == 503


def test_quality_is_the_size_difference_alone(spark, monkeypatch):
    """Every score is the logistic of one number: compressed sizes under the two dictionaries, per byte."""
    from heliofleet.llm import quality
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("sun", "moon", "star") if i % 2 else ("x9", "q7", "zz0")) + str(rng.randrange(50)) for _ in range(rng.choice([3, 50, 900]))))
            for i in range(80)] + [(80, None), (81, ""), (None, "sun1 x9")]
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in rows], "doc_id long, text string, score double, y int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    books, weights = quality.fit(docs, labels, "quality", lambda c: F.col(c) % 5 != 0)
    monkeypatch.setattr(quality, "fit", lambda *a: (books, weights))
    pair = quality.compressors(*books)
    got = {r.doc_id: r.score for r in score_quality(docs, labels, None).collect()}
    assert len(weights) == 2 and len(got) == len(rows)
    for i, t in rows:
        data = (t or "").encode()
        sizes = [sum(len(c.compress(data[k:k + quality.PIECE])) for k in range(0, len(data), quality.PIECE)) for c in pair]
        z = quality.SCALE * (sizes[1] - sizes[0]) / (len(data) + quality.EMPTY) * weights[0] + weights[1]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)


def test_posterior_knows_no_label():
    """The label model takes votes and one prior; equal votes get equal posteriors whatever the labels are."""
    rng = np.random.default_rng(6)
    y = rng.random(2000) < 0.4
    votes = np.stack([np.where(rng.random(2000) < r, y, ~y).astype(int) for r in (0.9, 0.8, 0.7, 0.85)], axis=1)
    post, _, _ = label_model(votes, 0.4)
    for pattern in np.unique(votes, axis=0):
        assert np.ptp(post[(votes == pattern).all(axis=1)]) < 1e-12


def test_label_model_discounts_repeated_voters():
    rng = np.random.default_rng(5)
    y = rng.random(3000) < 0.3
    vote = lambda right: np.where(rng.random(3000) < right, y, ~y).astype(int)
    noisy = vote(0.6)
    votes = np.stack([vote(0.9), vote(0.85), vote(0.85), noisy, noisy, noisy], axis=1)
    post, _, discount = label_model(votes, 0.3)
    assert ((post > 0.5) == y).mean() > 0.9 and discount[3:].max() < discount[:3].min()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    train = lambda c: crc_mod(c, 4) != 2
    for result in (remove_repeats(docs), near_duplicates(docs), score_texts(docs, F.lit(True)), shard_by_bytes(docs),
                   pack_documents(docs, tokenizer_path()), contained_items(docs, spark.createDataFrame([], "item_id long, text string")),
                   score_quality(docs, labels, train), score_toxicity(docs, labels, train),
                   extract_text(spark.createDataFrame([], "page_id long, url string, html string")),
                   near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))):
        assert result.count() == 0


def test_kept_text_digest(docs):
    row = remove_repeats(docs).select(F.sha2("kept_text", 256).alias("h")).where("h is null").count()
    assert row == 0 and hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_near_duplicates_by_blocks(docs, monkeypatch):
    """Clusters larger than a task are compared by blocks, with the same result."""
    from heliofleet.llm import minhash
    whole = {tuple(r) for r in near_duplicates(docs, shingle=4).collect()}
    for name, value in (("SMALL", 2), ("BLOCK_MINOR", 3), ("BLOCK_ALL", 4)):
        monkeypatch.setattr(minhash, name, value)
    assert {tuple(r) for r in near_duplicates(docs, shingle=4).collect()} == whole


def test_components_contract_edges_in_tasks(spark, monkeypatch):
    import numpy as np
    from heliofleet.llm import graph
    u, v = graph._stars(np.array([9, 7, 5, 20, 31]), np.array([7, 5, 2, 11, 20]))
    assert dict(zip(u.tolist(), v.tolist())) == {5: 2, 7: 2, 9: 2, 20: 11, 31: 11}
    # A long path, held a few edges at a time: every node still gets the least one, and one star needs no round.
    monkeypatch.setattr(graph, "EDGES", 3)
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {(r.node, r.root) for r in graph.components(path.repartition(5)).collect()} == {(i, 0) for i in range(61)}
    star = spark.createDataFrame([(i, 0) for i in range(1, 9)], "u long, v long")
    assert graph._open(star) == 0 and graph._open(path.selectExpr("b u", "a v")) > 0


def test_a_bucket_of_counts_is_added_up_in_runs_of_keys(monkeypatch):
    import numpy as np
    import pyarrow as pa
    from heliofleet.llm import lm
    from heliofleet.llm.words import pack, pack_small, unpack_small
    monkeypatch.setattr(lm, "SLICE_KEYS", 2)
    keys = [[3, 9, 2**63 + 5, 2**64 - 1], [9, 2**63 + 5, 2**63 + 7], [9]]
    flags = [[1 * 2 + 1, 4 * 2, 700 * 2 + 1, 0], [6 * 2, 5 * 2 + 1, 1 * 2], [10 * 2]]
    got = lm._answer(pa.table({
        "bucket": pa.array([0, 0, 0], pa.int32()), "block": ["0-a", "1-b", "0-c"], "held": pa.array([0, 1, 0], pa.int32()),
        "keys": pa.array([pack(np.array(k, np.uint64), sorted_=True) for k in keys], pa.binary()),
        "counts": pa.array([pack_small(np.array(c)) for c in flags], pa.binary())})).to_pylist()
    assert [unpack_small(r["main"]).tolist() for r in got] == [[1, 14, 700, 0], [14, 700, 0], [14]]
    assert [unpack_small(r["apart"]).tolist() for r in got] == [[0, 6, 5, 0], [6, 5, 1], [6]]
    assert [sum(r[c] for r in got) for c in ("tokens_main", "tokens", "types_main", "types")] == [701, 706, 2, 2]
