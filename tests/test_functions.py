"""Literal edge cases of the scalar functions."""

import datetime as dt
import hashlib
import hmac
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchstrata.functions import address as ad
from matchstrata.functions import geo, spline
from matchstrata.functions import identity as idf
from matchstrata.functions import text as tx


def one(spark, values, expr, schema="v string"):
    df = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)
    return [r[0] for r in df.select(expr).collect()]


def test_clean_text_removes_unicode_space(spark):
    assert one(spark, ["a　b", None, " x\t"], tx.clean_text(F.col("v"))) == ["ab", "", "x"]


def test_parse_date_forms(spark):
    d = dt.date
    texts = ["45000", "bad", "2023-1-5", "2023/01/05", "20230105", "2023-01-05 10:00:00", "2023-02-30", "1", "61", None, "2023"]
    got = one(spark, texts, tx.parse_date(F.col("v")))
    expected = [d(2023, 3, 15), None, d(2023, 1, 5), d(2023, 1, 5), d(2023, 1, 5), d(2023, 1, 5), None, d(1900, 1, 1), d(1900, 3, 1), None]
    assert got[:10] == expected


def test_completed_age_on_leap_birthday(spark):
    rows = [(dt.date(2000, 2, 29), dt.date(2018, 2, 28)), (dt.date(2000, 2, 29), dt.date(2018, 3, 1))]
    assert one(spark, rows, tx.completed_age(F.col("b"), F.col("o")), "b date, o date") == [17, 18]


def _full(first17):
    w = idf.WEIGHTS
    return first17 + idf.CHECK_CHARS[sum(int(c) * k for c, k in zip(first17, w)) % 11]


def test_identity_classes(spark):
    good = _full("44010619800229123")
    wrong = good[:-1] + ("0" if good[-1] != "0" else "1")
    old = "440106800229123"
    no_day = _full("44010619800230124")
    got = one(spark, [good, wrong, old, no_day, "x"], idf.classify_id(F.col("v")))
    assert [r["label"] for r in got] == [idf.CHECK_OK, idf.CHECK_BAD, idf.OLD_FORMAT, idf.BAD_BIRTH, idf.NO_FORMAT]
    assert got[0]["birth"] == dt.date(1980, 2, 29) and got[0]["sex"] == "男" and got[1]["birth"] is None
    assert one(spark, [old, good], idf.canonical_id(F.col("v"))) == [good, good]


def test_identity_columns_equal_the_single_functions(spark):
    rng = random.Random(2)
    numbers = [_full("44010619800229123"), _full("44010619800229123")[:-1] + "x", "440106800229123", _full("44010619800230124"), "440106801330123", "x", "", None, "1" * 17, "0" * 18, "9" * 15]
    numbers += [_full("0" * (i % 3) + "".join(rng.choice("0123456789") for _ in range(17 - i % 3))) for i in range(40)]
    numbers += ["".join(rng.choice("0123456789X") for _ in range(rng.choice([15, 18]))) for _ in range(40)]
    df = idf.with_identity(spark.createDataFrame([(v,) for v in numbers], "v string"), "v")
    for r in df.select("*", idf.classify_id(F.col("v")).alias("want"), idf.canonical_id(F.col("v")).alias("canon")).collect():
        assert r["id_class"] == r["want"] and (r["want"]["birth"] is None or r["id_canonical"] == r["canon"]), r["v"]


def test_dates_of_cleaned_texts_equal_parse_date(spark):
    texts = ["45000", "45000.7", "59", "80001", "2023-1-5", "2023/01/05", "2023/1-5", "20230105", "20231305", "2023-01-0510:00:00", "2023-02-30", "2023-13-01", "2023-00-10", "", None, "abcdefgh", "2023-1-510:0:0"]
    df = spark.createDataFrame([(v,) for v in texts], "v string").withColumn("t", tx.clean_text(F.col("v")))
    df = df.withColumn("i", tx.dashed(F.col("t"))).select("v", tx.date_of(F.col("t"), F.col("i")).alias("got"), tx.parse_date(F.col("v")).alias("want"))
    d = dt.date
    known = {"45000": d(2023, 3, 15), "45000.7": d(2023, 3, 15), "59": d(1900, 2, 28), "80001": None, "2023-1-5": d(2023, 1, 5), "2023/1-5": None, "20231305": None, "2023-13-01": None, "2023-1-510:0:0": d(2023, 1, 5)}
    for r in df.collect():
        assert r["got"] == r["want"] and known.get(r["v"], r["got"]) == r["got"], r["v"]


def test_typed_records_parse_no_text_inside_a_lambda(spark):
    """Lambdas are interpreted for every record."""
    from matchstrata.operators import registry

    texts = ["onset", "birth", "report_date", "diagnosis_date", "sex", "diagnosis_text", "card_no", "review_status", "duplicate_flag", "first_onset_flag", "icd10", "identity", *registry.ADDRESS_PARTS]
    raw = spark.createDataFrame([], "source_year int, source_row long, identity_is_number int, " + ", ".join(f"{c} string" for c in texts))
    plan = registry.typed_records(raw, idf.ReadableTokens())._jdf.queryExecution().optimizedPlan().toString()
    inside = [x.split("lambdafunction(", 1)[1] for x in plan.split("transform(")[1:] if "lambdafunction(" in x]
    assert not any("RLIKE" in x.split(")], ")[0][:400] for x in inside) and "transform(array(regexp" not in plan


@pytest.mark.parametrize("salt", [b"short", b"x" * 80])
def test_tokens_equal_hmac_and_stay_out_of_the_plan(spark, salt):
    df = spark.createDataFrame([("440106",)], "v string").select(idf.Tokenizer.from_salt(spark, salt).token("person:", F.col("v")).alias("t"))
    assert df.first()[0] == hmac.new(salt, b"person:440106", hashlib.sha256).hexdigest()[:24]
    key = hashlib.sha256(salt).digest() if len(salt) > 64 else salt
    pad = bytes(b ^ 0x36 for b in key.ljust(64, b"\0")).hex()
    plan = df._jdf.queryExecution().toString().lower()
    assert pad[:16] not in plan


def test_clinical_flag_later_rule_wins(spark):
    rows = [("I20_0", "不稳定型心绞痛"), ("I20_0", "稳定型心绞痛"), ("I63", "脑出血"), ("", "x"), ("I61", "脑出血")]
    got = one(spark, rows, tx.clinical_flag(F.col("o"), F.col("d")), "o string, d string")
    assert got[:4] == ["unstable_text_agrees", "code_text_conflict", "code_text_conflict", "outside_five_prespecified_code_groups"]
    assert got[4] == "code_supported_text_not_contradictory"


def test_address_normalisation_and_anchors(spark):
    text = "广东省广州市广州市天河区 石牌街道中山大道１２３号２栋201房"
    norm = ad.normalise(F.col("v"))
    assert one(spark, [text], norm) == ["广东省广州市天河区石牌街道中山大道123号2栋201房"]
    p = one(spark, [text], ad.profile(norm))[0]
    assert (p["district"], p["roads"], p["numbers"], p["houses"], p["buildings"]) == (
        "天河区", ["中山大道"], ["123", "2"], ["123"], ["2"],
    )
    assert one(spark, ["x路5号3栋201房", "x路5号"], ad.building(F.col("v"))) == ["x路5号3栋", "x路5号"]
    assert one(spark, ["x路5号3栋", "东港社区后座", "石村委", "zz"], ad.coarse_prefix(F.col("v"))) == ["x路5号", "东港社区", "", ""]
    t = one(spark, ["广东省广州市天河区石牌街道东港社区9号"], ad.place_tokens(F.col("v")))[0]
    assert tuple(t) == ("天河区", "石牌街道", "东港社区")


def test_match_scores_follow_the_ratio(spark):
    a, t = "天河区中山大道12号", "广东省广州市天河区中山大道12号大院"
    df = spark.createDataFrame([(a, t)], "a string, t string").select(
        ad.profile(F.col("a")).alias("a"), ad.profile(F.col("t")).alias("t")
    )
    strict = df.select(ad.strict_score(F.col("a"), F.col("t"), F.lit("440106"))).first()[0]
    ratio = SequenceMatcher(None, "中山大道12号", "中山大道12号大院").ratio()
    assert strict["reason"] == "road_and_number_agree" and strict["score"] == pytest.approx(min(1, ratio + 0.18))
    loose = df.select(ad.loose_score(F.col("a"), F.col("t"), F.lit(False))).first()[0]
    ratio = SequenceMatcher(None, "天河区中山大道12号", "天河区中山大道12号大院").ratio()
    assert loose == pytest.approx(round(ratio + 0.6, 4), abs=1e-4)
    outside = df.select(ad.strict_score(F.col("a"), F.col("t"), F.lit("440600"))).first()[0]
    assert outside["score"] == -1.0 and outside["reason"] == "outside_guangzhou"


def test_points_and_datum(spark):
    got = one(spark, ["113.1,23.2", "1,2,3", "a,b", "nan,1", None, "112.5,23"], geo.parse_point(F.col("v"), geo.STUDY_BOX))
    assert [g is not None for g in got] == [True, False, False, False, False, False]
    df = spark.createDataFrame([(113.264385, 23.129112)], "x double, y double")
    r = geo.datum_shift(df, "x", "y").first()
    assert r["shift_error"] < 1e-6 and 0.004 < r["x"] - r["longitude"] < 0.007


def test_spline_is_linear_outside_and_spans_cubics():
    x = np.linspace(0, 1, 50)
    b = spline.spline_matrix(x, [0.3, 0.6], (0, 1))
    assert b.shape == (50, 3) and np.linalg.matrix_rank(np.column_stack([np.ones(50), b])) == 4
    out = spline.spline_matrix(np.array([1.0, 2.0, 3.0]), [0.3, 0.6], (0, 1))
    assert np.allclose(np.diff(out, n=2, axis=0), 0, atol=1e-9)
    assert spline.lag_basis(21, 3).shape == (22, 3) and spline.lag_basis(21, 4).shape == (22, 4)


def test_spline_columns_equal_matrix(spark):
    df = spark.createDataFrame([(float(v),) for v in range(20)], "x double")
    cols = spline.spline_columns(F.col("x"), [5.0, 11.0], (0.0, 19.0))
    got = np.array([list(r) for r in df.select(*cols).collect()])
    assert np.allclose(got, spline.spline_matrix(np.arange(20), [5.0, 11.0], (0.0, 19.0)))


def test_longest_pattern_in_one_walk():
    from matchstrata.functions.automaton import Patterns

    rng = random.Random(5)
    for _ in range(300):
        patterns = ["".join(rng.choices("ab天", k=rng.randrange(1, 6))) for _ in range(rng.randrange(12))]
        text = "".join(rng.choices("ab天c", k=rng.randrange(30)))
        held = [p for p in patterns if p in text]
        found = Patterns(patterns).find(text)
        assert (patterns[found] if found >= 0 else None) == (max(held, key=lambda p: (len(p), p)) if held else None)
    assert Patterns([]).find("a") == -1 and Patterns(["a"]).find("") == -1


def test_ratios_of_a_batch_equal_the_plain_ratio():
    from matchstrata.functions import similarity

    rng = random.Random(9)
    texts = ["".join(rng.choices("ab天河路1", k=rng.randrange(0, 26))) for _ in range(400)] + ["", "天河路" * 70, "ab" * 150, "x", "\U0001f600ab"]
    a, b = rng.choices(texts, k=1500), rng.choices(texts, k=1500)
    want = np.asarray([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])
    assert (similarity.ratios(a, b) == want).all()
    assert (similarity.bounds(a, b) >= want).all()
    least = np.asarray([rng.random() for _ in a])
    cut = similarity.ratios(a, b, least)
    assert (cut >= want).all() and (cut[want >= least] == want[want >= least]).all() and (cut[want < least] >= want[want < least]).all()
    assert len(similarity.ratios([], [])) == 0
