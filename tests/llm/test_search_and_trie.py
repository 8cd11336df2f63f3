"""Nearest vectors, hard negatives and the conversation trie against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from heliofleet.llm.annforest import best_first, fit_tree, grow, nearest_vectors, route
from heliofleet.llm.hardnegatives import hard_negatives, inner, mined, pack
from heliofleet.llm.prefixtrie import conversation_trie
from heliofleet.llm.queries import op11_nearest_vectors, op12_hard_negatives, op13_conversation_trie

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<{}>, label int, cls long, tree int, query string, row int"
NAN = float("nan")


def vector_table(spark, rows, kind="float"):
    """Rows of id, vector and label, with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 7, 1, "x", 3) for r in rows], VECTORS.format(kind))


def usable(v, zero):
    return v is not None and None not in v and np.isfinite(v).all() and (zero or (len(v) and any(v)))


def true_nearest(rows, every, k):
    seen = sorted({(i, tuple(v)) for i, v, _ in rows if i is not None and usable(v, False)})
    out = {}
    for i, v in seen:
        if i % every == 0:
            ranked = sorted((-float(np.dot(np.float64(v), np.float64(w))), j) for j, w in seen if j != i and len(w) == len(v))
            out[i, v] = [(j, -s) for s, j in ranked[:k]]
    return out


def odd_vectors(width=6, n=150, seed=5):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-2.0, -1.0, -0.5, 0.25, 1.0, 3.0]) for _ in range(width)], i % 4) for i in range(n)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 1.0, 0.0, 0.5], 1) for i in range(60)]  # copies
    rows += [(2000, None, 1), (2020, [], 2), (2040, [0.0] * width, 2), (2060, [None] + [1.0] * 5, 1), (2080, [NAN] * width, 1),
             (2100, [float("inf")] + [1.0] * 5, 0), (None, [1.0] * width, 1), (2120, [1.0, 2.0], 1), (2121, [2.0, 2.0], 1), (2140, [1.0] * width, None)]
    return rows + rows[:3]  # repeated rows


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_vectors_with_room_for_all(spark, kind):
    rows = odd_vectors()
    got = nearest_vectors(vector_table(spark, rows, kind), every=20, k=8, target=1, leaf=16, sample=64).collect()
    want = true_nearest(rows, 20, 8)
    assert {(q, r, j) for (q, _), near in want.items() for r, (j, _) in enumerate(near, 1)} == {(g.query_id, g.rank, g.vec_id) for g in got}
    score = {(q, j): s for (q, _), near in want.items() for j, s in near}
    assert all(abs(score[g.query_id, g.vec_id] - g.score) < 1e-12 for g in got)
    assert {g.audit_recall for g in got} == {1.0}


def test_an_id_with_two_vectors_is_two_rows(spark):
    rows = [(20, [1.0, 0.0], 0), (20, [0.0, 1.0], 0), (1, [3.0, 1.0], 0), (2, [1.0, 4.0], 0)]
    got = sorted((g.vec_id, g.score) for g in nearest_vectors(vector_table(spark, rows)).collect())
    assert got == [(1, 1.0), (1, 3.0), (2, 1.0), (2, 4.0)]


def test_products_beyond_a_double(spark):
    rows = [(0, [1e200, 1e200], 0), (1, [1e200, 1.0], 0), (2, [-1e200, 1e200], 0), (3, [-1.0, 0.5], 0)]
    got = [(g.rank, g.vec_id) for g in nearest_vectors(vector_table(spark, rows, "double")).collect()]
    assert sorted(got)[0] == (1, 1) and len(got) == 3


def test_no_vectors(spark):
    assert nearest_vectors(vector_table(spark, [])).collect() == []
    assert nearest_vectors(vector_table(spark, [(None, [1.0], 1), (20, None, 1)])).collect() == []
    assert hard_negatives(vector_table(spark, [])).collect() == []


def test_forest_grows_in_rounds_and_a_small_budget_grows(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 12)) * 3
    x = centres[rng.integers(0, 40, 2400)] + rng.standard_normal((2400, 12))
    rows = [(i, v, 0) for i, v in enumerate(x.astype(np.float32).tolist())] + [(5000 + i, x[0].tolist(), 0) for i in range(300)]
    got = nearest_vectors(vector_table(spark, rows), first_budget=64, leaf=12, sample=120, least=4).collect()
    want = true_nearest(rows, 20, 20)
    found = collections.defaultdict(set)
    for g in got:
        found[g.query_id].add(g.vec_id)
    hits = [len(found[q] & {j for j, _ in near}) / len(near) for (q, _), near in want.items()]
    assert np.mean(hits) >= 0.9 and all(len(found[q]) == 20 for q, _ in want)
    assert abs(got[0].audit_recall - np.mean(hits)) < 0.08


def test_every_class_lies_in_one_leaf_of_each_tree(spark):
    rng = np.random.default_rng(1)
    data = [(i, v.tobytes(), 1.0, i, 4) for i, v in enumerate((rng.standard_normal((900, 4)) / 9).astype("<f4"))]
    classes = spark.createDataFrame(data, "cls long, vec binary, reach double, least long, dim int")
    levels, members = grow(classes, "<f4", trees=3, leaf=10, sample=100, least=5)
    rows = members.toPandas()
    assert len(levels) > 1 and (rows.groupby("cls")["tree"].agg(["count", "nunique"]) == 3).all().all()
    assert rows.groupby(["tree", "cell"]).size().max() <= 20
    assert sum(h["n"] for r in levels[0].collect() for h in r["held"]) == 2700


def test_tree_and_queue():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 5))
    planes, cuts, kids, leaves = fit_tree(x, 10, 1)
    leaf = route((planes, cuts, kids), x)
    counts = np.bincount(leaf, minlength=leaves).tolist()
    assert min(counts) >= 10 and sum(counts) == 300
    margins = (x[7] @ planes.T.astype(float) - cuts).tolist()
    order = list(best_first([(0, 0.0, margins, kids.tolist(), counts)], 10**9))
    assert order[0][1] == leaf[7] and sorted(o[1] for o in order) == list(range(leaves))
    assert [o[2] for o in order] == sorted(o[2] for o in order) and order[-1][3] == 300
    twins = fit_tree(np.ones((50, 3)), 2, 1)
    assert twins[3] == 1  # equal rows cannot be cut


def true_negatives(rows):
    out = []
    known = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(256 * x)) for x in v], n)
             for n, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and usable(v, True)]
    for a, label, u, n in known:
        if a % 100:
            continue
        ranked = sorted((-sum(p * q for p, q in zip(u, v)), i, m, lab) for i, lab, v, m in known if m != n and len(u) == len(v))
        for s, p, _, _ in [r for r in ranked if r[3] == label][:5]:
            window = [r for r in ranked if r[3] != label and 80 * s >= 100 * r[0] >= 100 * s]
            out += [(a, p, rank, r[1], -s, -r[0]) for rank, r in enumerate(window[:5], 1)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    rows = odd_vectors(n=330)
    want = true_negatives(rows)
    assert len(want) > 20
    assert sorted(map(tuple, hard_negatives(vector_table(spark, rows)).collect())) == want
    monkeypatch.setattr("heliofleet.llm.hardnegatives.ROW_BLOCK", 50)
    monkeypatch.setattr("heliofleet.llm.hardnegatives.ANCHOR_BLOCK", 2)
    assert sorted(map(tuple, hard_negatives(vector_table(spark, rows, "double")).collect())) == want


def test_hard_negatives_of_large_numbers(spark):
    rows = [(100, [3e9, 1.0], 1), (1, [4e9, 1.0], 1), (2, [3.9e9, 5.0], 2), (3, [3.3e9, 0.0], 2), (4, [1e30, 1.0], 2), (5, [2.0, 2.0], 2)]
    got = sorted(map(tuple, hard_negatives(vector_table(spark, rows, "double")).collect()))
    top = 2**63 - 1  # products beyond 64 bits all count as the greatest number
    assert got == [(100, 1, 1, 2, top, top), (100, 1, 2, 3, top, top), (100, 1, 3, 4, top, top)]


def test_inner_products_are_exact():
    rng = random.Random(2)
    for size in (100, 1 << 24, 1 << 28, 1 << 40):
        a, b = ([[rng.randrange(-size, size) for _ in range(5)] for _ in range(4)] for _ in range(2))
        want = [[max(1 - 2**63, min(2**63 - 1, sum(x * y for x, y in zip(u, v)))) for v in b] for u in a]
        assert inner(np.array(a), np.array(b)).tolist() == want


def test_windows_over_sorted_keys():
    keys = sorted([pack(-5, 1, 10, 0, 3, 0), pack(-5, 1, 10, 1, 1, 0), pack(-5, 1, 8, 1, 2, 0), pack(-5, 1, 7, 1, 4, 0),
                   pack(-5, 1, -3, 0, 9, 0), pack(-5, 1, 9, 0, -8, 0), pack(4, 0, 9, 1, 1, 1)])
    assert list(mined(keys)) == [(-5, 3, 1, 1, 10, 10), (-5, 3, 2, 2, 10, 8), (-5, -8, 1, 2, 9, 8)]


def true_trie(rows):
    word, own = re.compile(r"[^\x20\x09-\x0D]+"), collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(b"%d:" % len(role.encode()) + role.encode() + text.encode()).digest()
            own[conv].append((turn is not None, turn or 0, role, digest, text))
    built = {}
    for conv in own:
        h, base = zlib.crc32(str(conv).encode()) % 4, conv - int(np.fmod(conv, 20))
        built[conv] = [t[2::2] for t in sorted(own.get(base, []))[:h] + sorted(own[conv])[h:]]
    nodes = collections.defaultdict(list)
    for conv, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(conv)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[:len(key)] == key]
        inner_keys = {k[:-1] for k in below if k}
        ends = sorted(c for c in members if len(built[c]) == len(key))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), sum(len(k) == len(key) + 1 for k in below),
                    sum(k not in inner_keys for k in below), sum((len(nodes[k]) - 1) * len(word.findall(k[-1][1])) for k in below if k),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def turns_table(spark, rows):
    return spark.createDataFrame([(*r, 1, "y", 2) for r in rows], "conv_id long, turn long, role string, text string, d int, name string, conv int")


def test_trie_of_odd_conversations(spark):
    rng = random.Random(8)
    rows = []
    for conv in [*range(0, 45), *range(-6, 0), *range(10_000, 10_030)]:
        rows += [(conv, t, rng.choice(["user", "assistant"]), rng.choice(["", "a b", "a b c", "x" * 50, None])) for t in range(rng.randrange(1, 6))]
    rows += [(60, t, "user", f"turn {t // 2}") for t in range(70)]  # long, beside a twin that leaves it half way
    rows += [(61, t, "user", f"turn {t // 2}" if t < 41 else "other") for t in range(75)]
    rows += [(80 + i, t, "u", "same words here") for i in range(30) for t in range(6)]  # copies
    rows += [(7, None, "user", "first"), (7, None, None, None), (8, 0, None, "tie"), (8, 0, "z", "tie"), (8, 0, "z", "tie"), (None, 1, "user", "no conversation")]
    rows += [(205, 0, "user", "alone"), (2, 1, "user", "long " * 50_000)]
    rng.shuffle(rows)
    got = conversation_trie(turns_table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == true_trie(rows)


def test_trie_of_nothing(spark):
    assert conversation_trie(turns_table(spark, [])).collect() == []
    assert conversation_trie(turns_table(spark, [(None, 1, "user", "a")])).collect() == []
    lone = next(c for c in range(101, 120) if zlib.crc32(str(c).encode()) % 4 == 1)  # its first turn is dropped, and nothing replaces it
    assert [tuple(r)[:7] for r in conversation_trie(turns_table(spark, [(lone, 4, "u", "b c")])).collect()] == [(lone, 0, None, 1, 0, 1, 0)]


def test_registered_queries(spark):
    vectors = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = op11_nearest_vectors(spark, SMALL).collect()
    want = {(q, j) for (q, _), near in true_nearest(vectors, 20, 20).items() for j, _ in near}
    assert len(got) == len(want) and len(want & {(g.query_id, g.vec_id) for g in got}) >= 0.9 * len(want)
    assert sorted(map(tuple, op12_hard_negatives(spark, SMALL).collect())) == true_negatives(vectors)
    turns = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, op13_conversation_trie(spark, SMALL).collect()), key=str) == true_trie(turns)
