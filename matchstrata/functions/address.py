"""Address text: normalisation, anchors, match scores."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from matchstrata.core import let
from matchstrata.functions.similarity import ratios

# Districts of the study city and their area codes, in matching order.
DISTRICTS = {
    "荔湾区": "440103",
    "越秀区": "440104",
    "海珠区": "440105",
    "天河区": "440106",
    "白云区": "440111",
    "黄埔区": "440112",
    "番禺区": "440113",
    "花都区": "440114",
    "南沙区": "440115",
    "从化区": "440117",
    "增城区": "440118",
}
PROVINCE, CITY, CITY_CODE = "广东省", "广州市", "4401"
# Fixed patterns of the address rules.
ADMIN_NAMES = "|".join([PROVINCE, CITY, *DISTRICTS])
ROAD = r"[一-鿿]{2,12}(?:大道|路|巷|街)(?!道)"
TOWN_ONCE = r"^(.*?)[一-鿿]{2,8}(?:街道|镇)"
DOOR_NUMBER = r"(\d+(?:-\d+)?)(?:号|栋|幢|座)"
HOUSE_NUMBER = r"(?<!\d)(\d+(?:-\d+)?)(?:号)(?!楼|栋|幢)"
BUILDING_NUMBER = r"(?<!\d)([A-Za-z]?\d+|[A-Za-z])(?:栋|幢|座)"
ROOM_SUFFIX = r"(\d+(?:号|栋|幢|座|楼))((?:\d+单元)?(?:\d+[层楼])?(?:\d+(?:室|房))?)$"
COARSE_NUMBER = r"^(.*?\d+(?:号|栋|幢|座))"
COARSE_PLACE = r"^(.*?(?:社区|小区|花园|大厦|村)(?!委))"
CLAUSE_MARKS = r"(?U)[\s，,；;。]+"
TOWN_FIRST = r"^([一-鿿]{2,12}?(?:街道|镇))"
VILLAGE_NEXT = r"^([一-鿿]{2,16}?(?:社区|村|小区|花园))"
TOWN_ANYWHERE = r"([一-鿿]{2,10}(?:街道|镇))"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no built-in for it."""
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=a.index)
    known = a.notna() & b.notna()
    out[known] = ratios(a[known].tolist(), b[known].tolist(), least[known].to_numpy())
    return out.astype(object).where(known, None).astype("Float64")


def sequence_ratio(a: Column, b: Column, least: Column | float = 0.0) -> Column:
    """Matching-block similarity 2M/T of two texts; argument order matters, null if one is null.

    Where only ratios of ``least`` and more matter, a pair that can't reach it gets a bound below it, without a search for blocks.
    """
    return _ratio(a, b, least if isinstance(least, Column) else F.lit(float(least)))


def normalise(c: Column, compatibility: bool = True) -> Column:
    """Compatibility form, no spaces or clause marks, doubled admin names collapsed (F16)."""
    s = nfkc(c) if compatibility else c
    s = F.regexp_replace(s, CLAUSE_MARKS, "")
    return F.regexp_replace(s, rf"({ADMIN_NAMES})\1", "$1")


def district(c: Column) -> Column:
    """First district of the list found in the text, else '' (F17)."""
    return let(c, lambda t: F.coalesce(*[F.when(t.contains(d), F.lit(d)) for d in DISTRICTS], F.lit("")))


def without_admin(c: Column) -> Column:
    return F.regexp_replace(c, ADMIN_NAMES, "")


def roads(c: Column) -> Column:
    """Road names after admin names and one town token are removed."""
    return F.regexp_extract_all(_street_part(c), F.lit(f"({ROAD})"), F.lit(1))


def door_numbers(c: Column) -> Column:
    return F.regexp_extract_all(_street_part(c), F.lit(DOOR_NUMBER), F.lit(1))


def _street_part(c: Column) -> Column:
    return F.regexp_replace(without_admin(c), TOWN_ONCE, "$1")


def building(c: Column) -> Column:
    """Room, unit or floor suffix removed."""
    return F.regexp_replace(c, ROOM_SUFFIX, "$1")


def coarse_prefix(c: Column) -> Column:
    """Text up to a building number, else up to a community name, else '' (F20)."""
    numbered, placed = F.regexp_extract(c, COARSE_NUMBER, 1), F.regexp_extract(c, COARSE_PLACE, 1)
    return F.coalesce(F.nullif(numbered, F.lit("")), placed)


def profile(c: Column) -> Column:
    """Everything the scores read from one normalised address or candidate text.

    Computed once per address and once per candidate, before the two meet.
    """
    return let(c, _profile)


def _profile(c: Column) -> Column:
    return F.struct(
        c.alias("text"),
        district(c).alias("district"),
        without_admin(c).alias("plain"),
        roads(c).alias("roads"),
        door_numbers(c).alias("numbers"),
        F.regexp_extract_all(c, F.lit(HOUSE_NUMBER), F.lit(1)).alias("houses"),
        F.regexp_extract_all(c, F.lit(BUILDING_NUMBER), F.lit(1)).alias("buildings"),
    )


def place_tokens(c: Column) -> Column:
    """struct(district, town, village) read from left to right."""
    d = district(c)
    after = F.substr(c, F.instr(c, d) + F.length(d))
    rest = F.when(d != "", after).otherwise(
        F.replace(F.replace(c, F.lit(PROVINCE), F.lit("")), F.lit(CITY), F.lit(""))
    )
    town = F.regexp_extract(rest, TOWN_FIRST, 1)
    tail = F.substr(rest, F.length(town) + 1)
    village = F.regexp_extract(tail, VILLAGE_NEXT, 1)
    return F.struct(d.alias("district"), town.alias("town"), village.alias("village"))


def town_context(c: Column) -> Column:
    """struct(district, first town token)."""
    town = F.regexp_extract(without_admin(c), TOWN_ANYWHERE, 1)
    return F.struct(district(c).alias("district"), town.alias("town"))


def _first(c: Column) -> Column:
    return F.get(c, F.lit(0))


def _number_conflict(a: Column, t: Column) -> Column:
    n, tn = a["numbers"], t["numbers"]
    return (F.size(n) > 0) & (F.size(tn) > 0) & (_first(n) != _first(tn))


def _number_found(a: Column, t: Column) -> Column:
    return (F.size(a["numbers"]) > 0) & F.coalesce(F.array_contains(t["numbers"], _first(a["numbers"])), F.lit(False))


def _road_found(a: Column, t: Column) -> Column:
    return F.exists(a["roads"], lambda x: t["text"].contains(x))


def strict_score(a: Column, t: Column, adcode: Column, least: float = 0.0) -> Column:
    """struct(score, reason) of two profiles; any conflict gives -1 (F23). Scores below ``least`` may be too high, but stay below it."""
    has_road = F.size(a["roads"]) > 0
    strong = has_road & _number_found(a, t)
    reason = (
        F.when((a["district"] != "") & ~t["text"].contains(a["district"]), "district_conflict")
        .when(~F.coalesce(adcode, F.lit("")).startswith(CITY_CODE), "outside_guangzhou")
        .when(has_road & ~_road_found(a, t), "road_conflict_or_missing")
        .when(_number_conflict(a, t), "house_number_conflict")
        .when(strong, "road_and_number_agree")
        .otherwise("text_and_district")
    )
    fits = reason.isin("road_and_number_agree", "text_and_district")
    # Rejected pairs go to the ratio as nulls, as a condition doesn't keep a row from a Python function.
    extra = F.when(strong, 0.18).otherwise(0.0)
    # A little less, as the sum is rounded.
    ratio = sequence_ratio(F.when(fits, a["plain"]), F.when(fits, t["plain"]), F.lit(least) - extra - 1e-9)
    value = F.least(F.lit(1.0), ratio + extra)
    return F.struct(F.when(fits, value).otherwise(-1.0).alias("score"), reason.alias("reason"))


def loose_score(a: Column, t: Column, accepted: Column) -> Column:
    """Similarity with rewards and penalties, null on a district conflict."""
    d, td, has_road = a["district"], t["district"], F.size(a["roads"]) > 0
    found = _road_found(a, t)
    city_names = f"{PROVINCE}|{CITY}"

    def part(cond, weight):
        return F.when(cond, F.lit(weight)).otherwise(F.lit(0.0))

    fits = (d == "") | (td == "") | (td == d)
    value = (
        sequence_ratio(*(F.when(fits, F.regexp_replace(x["text"], city_names, "")) for x in (a, t)))
        + part((d != "") & t["text"].contains(d), 0.2)
        + part(has_road & found, 0.2)
        + part(_number_found(a, t), 0.2)
        + part(_number_conflict(a, t), -0.4)
        + part(has_road & (F.size(t["roads"]) > 0) & ~found, -0.25)
        + part(accepted, 2.0)
    )
    return F.when(fits, F.bround(value, 4))


EVIDENCE_FLAGS = [
    f"{what}_{kind}"
    for what in ("district", "road", "house_number", "building_number")
    for kind in ("conflict", "evidence_missing")
] + ["road_agree", "house_number_agree", "building_number_agree"]


def evidence(a: Column, t: Column, adcode: Column) -> Column:
    """struct of 11 agree / conflict / missing flags of two profiles."""
    by_code = F.coalesce(*[F.when(adcode == v, F.lit(k)) for k, v in DISTRICTS.items()], F.lit(""))
    d, td = a["district"], F.when(t["district"] != "", t["district"]).otherwise(by_code)
    r, tr = a["roads"], t["roads"]
    agree = F.exists(
        r, lambda x: t["text"].contains(x) | F.exists(tr, lambda y: x.endswith(y) | y.endswith(x))
    )
    out = {
        "district_conflict": (d != "") & (td != "") & (d != td),
        "district_evidence_missing": (d != "") & (td == ""),
        "road_conflict": (F.size(r) > 0) & (F.size(tr) > 0) & ~agree,
        "road_evidence_missing": (F.size(r) > 0) & (F.size(tr) == 0),
        "road_agree": agree,
    }
    for name, part in (("house_number", "houses"), ("building_number", "buildings")):
        x, y = a[part], t[part]
        both = (F.size(x) > 0) & (F.size(y) > 0)
        same = F.coalesce(_first(x) == _first(y), F.lit(False))
        out[f"{name}_conflict"] = both & ~same
        out[f"{name}_evidence_missing"] = (F.size(x) > 0) & (F.size(y) == 0)
        out[f"{name}_agree"] = both & same
    return F.struct(*[out[k].cast("int").alias(k) for k in EVIDENCE_FLAGS])
