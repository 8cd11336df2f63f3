import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from heliofleet.operators.asof import nearest_in_time, observations_on_grid

T0 = dt.datetime(2024, 1, 1)


def m(n):
    return T0 + dt.timedelta(minutes=n)


def frames(spark, probes, observations):
    return (spark.createDataFrame(probes, "k string, at timestamp"),
            spark.createDataFrame(observations, "k string, seen timestamp, v double"))


def brute(probes, observations, tolerance, direction):
    out = []
    for k, at in probes:
        best = None
        for k2, seen, v in observations:
            gap = abs((seen - at).total_seconds())
            if k2 != k:
                continue
            if direction == "nearest" and gap > tolerance * 60:
                continue
            if direction == "backward" and not (at - dt.timedelta(minutes=tolerance) < seen <= at):
                continue
            if best is None or (gap, seen) < best[0]:
                best = ((gap, seen), v)
        out.append((k, at, best[1] if best else None))
    return sorted(out, key=repr)


def test_edges_ties_and_null_values(spark):
    probes = [("a", m(60)), ("b", m(60)), ("c", m(60)), ("d", m(60)), ("e", m(60))]
    seen = [("a", m(30), 1.0), ("b", m(90), 2.0), ("c", m(50), 3.0), ("c", m(70), 4.0), ("d", m(59), None), ("d", m(55), 5.0), ("e", m(29), 6.0)]
    p, o = frames(spark, probes, seen)
    grid = observations_on_grid(o, ["k"], "seen", ["v"], "at", 5, 30)
    want = [("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", None), ("e", None)]
    assert [(r["k"], r["v"]) for r in p.join(grid, ["k", "at"], "left").orderBy("k").collect()] == want
    free = nearest_in_time(p, o, ["k"], "at", "seen", ["v"], 30)
    assert [(r["k"], r["v"]) for r in free.orderBy("k").collect()] == want
    assert free.where("k = 'd'").first()["seen"] == m(59)


@pytest.mark.parametrize("direction, tolerance", [("nearest", 30), ("backward", 60)])
def test_both_forms_match_brute_force_under_skew(spark, direction, tolerance):
    rng = random.Random(7)
    keys = ["hot"] * 6 + ["x", "y"]
    probes = sorted({(rng.choice(keys), m(5 * rng.randrange(-60, 200))) for _ in range(150)})
    seen = {}
    while len(seen) < 400:
        seen[(rng.choice(keys), T0 + dt.timedelta(seconds=rng.randrange(-20000, 60000), microseconds=rng.randrange(10**6)))] = rng.random()
    observations = [(k, t, v) for (k, t), v in seen.items()]
    p, o = frames(spark, probes, observations)
    want = brute(probes, observations, tolerance, direction)
    grid = p.join(observations_on_grid(o, ["k"], "seen", ["v"], "at", 5, tolerance, direction), ["k", "at"], "left")
    assert sorted(((r["k"], r["at"], r["v"]) for r in grid.collect()), key=repr) == want
    free = nearest_in_time(p, o, ["k"], "at", "seen", ["v"], tolerance, direction=direction)
    assert sorted(((r["k"], r["at"], r["v"]) for r in free.collect()), key=repr) == want


def test_a_crowd_of_probes_asks_once(spark):
    """Copies of a probe, null keys and null times keep their rows; the window meets each (key, time) once."""
    probes = [("hot", m(60), i) for i in range(500)] + [("hot", m(61), -1), (None, m(60), -2), ("hot", None, -3), ("cold", m(60), -4)]
    p = spark.createDataFrame(probes, "k string, at timestamp, seen_by int")
    o = spark.createDataFrame([("hot", m(50), 1.0), ("hot", m(62), 2.0), (None, m(60), 9.0)], "k string, seen timestamp, v double")
    got = {r.seen_by: (r.k, r.at, r.v, r.seen) for r in nearest_in_time(p, o, ["k"], "at", "seen", ["v"], 30).collect()}
    assert len(got) == len(probes)
    assert all(got[i] == ("hot", m(60), 2.0, m(62)) for i in range(500)) and got[-1] == ("hot", m(61), 2.0, m(62))
    assert got[-2] == (None, m(60), None, None) and got[-3] == ("hot", None, None, None) and got[-4] == ("cold", m(60), None, None)
    back = nearest_in_time(p, o, ["k"], "at", "seen", ["v"], 30, direction="backward")
    assert back.where("v = 1").count() == 501
    assert back.columns == ["k", "at", "seen_by", "v", "seen"]


def test_probe_finer_than_resolution_is_refused(spark):
    p, o = frames(spark, [("a", T0 + dt.timedelta(microseconds=1))], [("a", T0, 1.0)])
    with pytest.raises(Exception, match="finer than"):
        nearest_in_time(p, o, ["k"], "at", "seen", ["v"], 30).collect()


def test_no_row_reads_the_rest_of_its_bucket(spark):
    """A frame that ends at the bucket's end is evaluated again for every row."""
    probes = spark.createDataFrame([("a", T0)], "k string, at timestamp")
    obs = spark.createDataFrame([("a", T0, 1.0)], "k string, seen timestamp, v double")
    plan = nearest_in_time(probes, obs, ["k"], "at", "seen", ["v"], 30)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "unboundedfollowing" not in plan.lower()
