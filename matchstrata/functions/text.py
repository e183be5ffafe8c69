"""Text, date, code and label columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchstrata.core import let

# Code prefix -> disease label of the registry.
DISEASE_OF_PREFIX = {
    "I20": "心绞痛（急性资格待核）",
    "I21": "急性心肌梗死",
    "I22": "急性心肌梗死",
    "I46": "心脏性猝死（定义待核）",
    "I60": "蛛网膜下腔出血",
    "I61": "脑出血",
    "I63": "脑梗死",
    "I64": "未特指卒中",
}
# Prefixes of the two broad groups, and of the five subtypes.
BROAD_GROUPS = {"CVD": ["I20", "I21", "I22", "I46"], "CBVD": ["I60", "I61", "I63", "I64"]}
SUBTYPES = {"MI": ["I21", "I22"], "ANGINA": ["I20"], "IS": ["I63"], "ICH": ["I61"], "SAH": ["I60"]}
# Outcome -> code prefixes, first match wins.
OUTCOME_PREFIXES = {"I63": ["I63"], "AMI": ["I21", "I22"], "I20_0": ["I20.0"], "I61": ["I61"], "I60": ["I60"]}
# Door-number texts that carry no number.
EMPTY_DOOR_TEXTS = ["无", "不详", "未知", "-", "0"]


def clean_text(c: Column) -> Column:
    """Null to '', all Unicode whitespace removed."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", "")


# Fixed pattern: year, month and day with '-' or '/', an optional clock time, whitespace removed.
DATE_TEXT = (
    r"^(\d{4})([-/])(1[0-2]|0[1-9]|[1-9])\2(3[01]|[12]\d|0[1-9]|[1-9])"
    r"(?:(?:2[0-3]|[01]\d|\d):[0-5]?\d:[0-5]?\d)?$"
)


def parse_date(c: Column) -> Column:
    """Spreadsheet serial number or one of five text formats to date, else null."""
    return let(clean_text(c), _date_of_text)


def _date_of_text(t: Column) -> Column:
    return date_of(t, dashed(t))


#: A year, a month and a day of one or two digits.
DASHED = r"^\d{4}-\d\d?-\d\d?$"


def dashed(t: Column) -> Column:
    """A cleaned date text of a text format with year, month and day between dashes; null or another text for others."""
    other = F.regexp_replace(F.regexp_replace(t, DATE_TEXT, "$1-$3-$4"), r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3")
    return F.when(t.rlike(DASHED), t).when(F.length(t) >= 8, other)


def date_of(t: Column, iso: Column) -> Column:
    """Date of a cleaned text and its ``dashed`` form."""
    # Only what looks like a number is cast: the cast raises and catches an exception per other text.
    serial = F.floor(F.when(t.rlike(r"^\d{1,5}(?:\.\d+)?$"), t).try_cast("double")).cast("int")
    # Serials below 60 are a day off, as the 1900 system counts a 29 February that year.
    days = F.when(serial.between(1, 80000), serial + (serial < 60).cast("int"))
    # A plain cast: the pattern-based parser raises and catches an exception per bad text.
    parsed = F.when(iso.rlike(DASHED), iso).try_cast("date")
    return F.coalesce(parsed, F.date_add(F.lit("1899-12-30").cast("date"), days))


def code_prefix(c: Column) -> Column:
    """Leading chapter-I category such as I21, '' when there is none."""
    return prefix_of(F.upper(clean_text(c)))


def prefix_of(code: Column) -> Column:
    """``code_prefix`` of a code that is cleaned and upper-cased already."""
    return F.regexp_extract(code, r"^(I\d{2})", 1)


def completed_age(birth: Column, on: Column) -> Column:
    """Completed years; 29 February birthdays count on 1 March."""

    return let(F.struct(birth.alias("b"), on.alias("d")), lambda p: years_between(p["b"], p["d"]))


def years_between(b: Column, d: Column) -> Column:
    """``completed_age`` of two plain columns, which it names several times."""
    before = (F.month(d) * 100 + F.dayofmonth(d)) < (F.month(b) * 100 + F.dayofmonth(b))
    return F.year(d) - F.year(b) - before.cast("int")


def is_warm(d: Column) -> Column:
    return F.month(d).between(4, 9).cast("int")


def season(d: Column) -> Column:
    """Warm season is April to September."""
    return F.when(is_warm(d) == 1, "暖季").otherwise("冷季")


def event_id(year: Column, row: Column) -> Column:
    """E{year}_{row, 7 digits}."""
    return F.format_string("E%d_%07d", year.cast("int"), row.cast("long"))


def label_by_prefix(code: Column, labels: dict[str, list[str]], default=None) -> Column:
    """First label of which a prefix starts the code."""
    out = None
    for label, prefixes in labels.items():
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | code.startswith(p)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out if default is None else out.otherwise(default)


def outcome(code: Column) -> Column:
    return label_by_prefix(code, OUTCOME_PREFIXES, "")


def disease(prefix: Column) -> Column:
    """Disease label of a code prefix, null when unmapped."""
    return _map(prefix, DISEASE_OF_PREFIX)


def _map(c: Column, pairs: dict[str, str]) -> Column:
    out = None
    for k, v in pairs.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


def clinical_flag(outcome_id: Column, diagnosis: Column) -> Column:
    """Code and diagnosis text agreement; the last applicable rule decides."""
    has = diagnosis.contains
    conflict = (
        ((outcome_id == "I20_0") & diagnosis.rlike("(?<!不)稳定"))
        | ((outcome_id == "I63") & (has("脑出血") | has("蛛网膜")))
        | ((outcome_id == "I61") & (has("脑梗死") | has("蛛网膜")))
    )
    return (
        F.when(outcome_id == "", "outside_five_prespecified_code_groups")
        .when(conflict, "code_text_conflict")
        .when((outcome_id == "I20_0") & has("不稳定"), "unstable_text_agrees")
        .when(outcome_id == "I20_0", "generic_angina_text_requires_subtype_review")
        .otherwise("code_supported_text_not_contradictory")
    )


def chronic_text(diagnosis: Column) -> Column:
    """Old, sequela or recovery wording."""
    return diagnosis.rlike("陈旧性|后遗症|恢复期|康复期").cast("int")


def address_detail(community: Column, door: Column) -> Column:
    """How far the address text goes."""
    has_door = (door != "") & ~door.isin(EMPTY_DOOR_TEXTS)
    return F.when(has_door, "门牌栏有文字").when(community != "", "有居委会或村文字").otherwise("仅街道及以上文字")


def treatment_category(c: Column) -> Column:
    """Treatment text class."""
    t = clean_text(c)
    up = F.upper(t)
    return (
        F.when(t == "", "缺失")
        .when(up.rlike("PCI|介入|支架"), "提及PCI/介入")
        .when(up.rlike("CABG|搭桥"), "提及CABG/搭桥")
        .otherwise("有填写（需按原表核实）")
    )


def gap_band(days: Column) -> Column:
    """Interval class of a day gap."""
    return (
        F.when(days == 0, "0")
        .when(days <= 28, "1-28")
        .when(days <= 90, "29-90")
        .when(days <= 365, "91-365")
        .when(days > 365, ">365")
    )


def rounded(c: Column, places: int = 4) -> Column:
    """Rounded value; null for non-finite input (F32)."""
    bad = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(~bad, F.bround(c, places))


def modifiers(age: Column, sex: Column, on: Column) -> dict[str, Column]:
    """Effect modifiers; unrecorded sex stays null."""
    return {
        "age65": (age >= 65).cast("int"),
        "male": F.when(sex.isin("男", "女"), (sex == "男").cast("int")),
        "warm": is_warm(on),
    }
