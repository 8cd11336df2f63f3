"""Cases the first round got wrong: backslashes, fractions of a second, shared first words, long rules."""

import datetime as dt
import random
import re

from heliofleet import schemas
from heliofleet.operators import catalogue, chunking, routing
from heliofleet.sources.payloads import to_json_rows


def units(spark, names):
    rows = [(f"U{i}", f"CODE{i}", name, "QLD1", -27.0, 150.0, 80.0, None) for i, name in enumerate(names)]
    return spark.createDataFrame(rows, schemas.UNITS)


def test_backslashes_in_search_texts(spark):
    table = units(spark, ["Amber Hill 50% Array", "Birch Lane Array"])
    texts = spark.createDataFrame([("bir\\ch",), ("50\\%",), ("lane\\",), ("\\%\\%",)], "text string")
    got = {r.searched_for: r.facility_name for r in catalogue.find_facility_batch(table, texts).collect()}
    assert got == {"bir\\ch": "Birch Lane Array", "50\\%": "Amber Hill 50% Array", "lane\\": "Birch Lane Array"}
    assert catalogue.find_facility(table, "bir\\ch").first().facility_name == "Birch Lane Array"


def test_names_found_by_their_rarest_piece(spark):
    """Names and texts that share their common words, wildcards included, against a plain search."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    names = sorted({f"Solar Farm {word().title()} {word()}" for _ in range(60)})
    texts = sorted({rng.choice(names)[rng.randrange(12):][:rng.randint(1, 12)].strip() for _ in range(40)}
                   | {"solar%a", "%", "_", "solar farm", "zzz", "farm _", "SOLAR%b%", "b_ solar", "ab"} - {""})
    got = {r.searched_for: (r.facility_name, r.facility_code) for r in catalogue.find_facility_batch(
        units(spark, names), spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    want = {}
    for text in texts:
        like = re.compile("".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in text.lower()), re.S)
        hits = [(len(n), f"CODE{i}", n) for i, n in enumerate(names) if like.search(n.lower())]
        if hits:
            want[text] = (min(hits)[2], min(hits)[1])
    assert got == want and len(want) > 30


def test_a_farm_without_readings_has_a_summary(spark):
    from helpers import AT, FULL_SUN, fleet
    f = fleet(spark, [("BRKNSF1", AT, 210.0)], FULL_SUN)
    got = [catalogue.facility_summary(f, facility_code=code).collect() for code in ("BRKNSF", "NONE")]
    assert [(r.facility_code, r.intervals, r.energy_mwh, r.curtailed_intervals) for rows in got for r in rows] == [
        ("BRKNSF", 1, 17.5, 0), ("NONE", 0, None, 0)]


def test_fractions_of_a_second_are_kept(spark):
    at = dt.datetime(2031, 3, 4, 5, 6, 7)
    df = spark.createDataFrame([(1, at), (2, at.replace(microsecond=80_500))], "k int, at timestamp")
    assert [r.json for r in to_json_rows(df).orderBy("json").collect()] == [
        '{"k":1,"at":"2031-03-04T05:06:07Z"}', '{"k":2,"at":"2031-03-04T05:06:07.080500Z"}']


def test_names_with_one_first_word_do_not_pair_up(spark):
    table = units(spark, [f"Granite number{i} Solar Farm" for i in range(40)])
    asked = spark.createDataFrame([(i, f"how is granite number{i} doing") for i in range(40)], "question_id long, question string")
    got = routing.match_facility(asked, table)
    assert {(r.question_id, r.facility) for r in got.collect()} == {(i, f"CODE{i}") for i in range(40)}


def test_fingerprint_uses_every_digit(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"t{i}") for i in range(20)], "id string, text string")
    one = chunking.corpus_fingerprint(chunks).first()
    other = chunking.corpus_fingerprint(chunks.where("id <> 'c3'")).first()
    assert one.chunks == 20 and one.fingerprint != other.fingerprint
