"""Identity number checks and salted tokens, all as built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchstrata.core import let

# Position weights and check characters of the 18-character identity number.
WEIGHTS = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]
CHECK_CHARS = "10X98765432"

OLD_FORMAT = "15位旧证件格式（可转换）"
CHECK_OK = "18位且校验码符合"
CHECK_BAD = "18位格式但校验码不符"
NO_FORMAT = "缺失或格式不符"
BAD_BIRTH = "证件内出生日期无效"


def _check_char(first17: Column) -> Column:
    """Null unless all 17 are digits."""
    digits = [F.substring(first17, k + 1, 1).try_cast("int") * w for k, w in enumerate(WEIGHTS)]
    return F.substring(F.lit(CHECK_CHARS), (reduce(lambda x, y: x + y, digits) % 11 + 1).cast("int"), F.lit(1))


def _check_char_of(digits: str) -> Column:
    """``_check_char`` of the name of a column that holds 17 digits as a long."""
    total = reduce(lambda x, y: x + y, [F.expr(f"({digits} div {10 ** (16 - k)}) % 10") * w for k, w in enumerate(WEIGHTS)])
    return F.substring(F.lit(CHECK_CHARS), (total % 11 + 1).cast("int"), F.lit(1))


def canonical_id(s: Column) -> Column:
    """15-character numbers expanded to 18 with the computed check character."""
    return let(s, _expanded)


def _expanded(s: Column) -> Column:
    base = F.concat(F.substring(s, 1, 6), F.lit("19"), F.substring(s, 7, 9))
    return F.when(s.rlike(r"^\d{15}$"), let(base, lambda b: F.concat(b, _check_char(b)))).otherwise(s)


def classify_id(s: Column) -> Column:
    """struct(label, birth, sex) of an upper-cased, whitespace-free number."""
    return let(s, _classified)


def _classified(s: Column) -> Column:
    return let(F.struct(s.alias("s"), s.rlike(r"^\d{15}$").alias("old"), s.rlike(r"^\d{17}[\dX]$").alias("new")), _checked)


def _checked(p: Column) -> Column:
    s, old, new = p["s"], p["old"], p["new"]
    century = F.concat(F.lit("19"), F.substring(s, 7, 6))
    # Birth digits and sex digit need no check character, which is computed for new numbers only.
    digits = F.when(old, century).when(new, F.substring(s, 7, 8))
    sex_digit = F.when(old, F.substring(s, 15, 1)).otherwise(F.substring(s, 17, 1))
    read = F.struct(
        F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)).try_cast("date").alias("birth"),
        F.when(new, _check_char(F.substring(s, 1, 17)) == F.substring(s, 18, 1)).alias("check_ok"),
    )
    return let(read, lambda r: _named(old, new, r["check_ok"], r["birth"], sex_digit))


def _named(old: Column, new: Column, check_ok: Column, birth: Column, sex_digit: Column) -> Column:
    usable = old | (new & check_ok)
    label = (
        F.when(new & ~check_ok, CHECK_BAD)
        .when(~usable, NO_FORMAT)
        .when(birth.isNull(), BAD_BIRTH)
        .when(old, OLD_FORMAT)
        .otherwise(CHECK_OK)
    )
    good = usable & birth.isNotNull()
    sex = F.when(sex_digit.try_cast("int") % 2 == 1, "男").otherwise("女")
    return F.struct(
        label.alias("label"), F.when(good, birth).alias("birth"), F.when(good, sex).alias("sex")
    )


def with_identity(df: DataFrame, number: str) -> DataFrame:
    """Adds id_old and id_new (the two formats), id_class (``classify_id``) and id_canonical (``canonical_id``) of a column.

    Each step is a column of its own, which the next one names as often as it likes: lambdas are interpreted row by row.
    """
    s, old, new = F.col(number), F.col("id_old"), F.col("id_new")
    known = df.withColumns({"id_old": s.rlike(r"^\d{15}$"), "id_new": s.rlike(r"^\d{17}[\dX]$")})
    # Birth digits and sex digit need no check character.
    long = F.when(old, F.concat(F.substring(s, 1, 6), F.lit("19"), F.substring(s, 7, 9))).when(new, F.substring(s, 1, 17))
    known = known.withColumn("id_17", long)
    at = [F.substring("id_17", i, n) for i, n in ((7, 4), (11, 2), (13, 2))]
    known = known.withColumn("id_digits", F.col("id_17").try_cast("long"))
    read = {"id_char": _check_char_of("id_digits"), "id_birth": F.concat_ws("-", *at).try_cast("date")}
    known = known.withColumns(read).withColumn("id_ok", F.when(new, F.col("id_char") == F.substring(s, 18, 1)))
    named = _named(old, new, F.col("id_ok"), F.col("id_birth"), F.substring("id_17", 17, 1))
    canonical = F.when(old, F.concat("id_17", "id_char")).otherwise(s)
    return known.withColumns({"id_class": named, "id_canonical": canonical}).drop("id_17", "id_digits", "id_char", "id_birth", "id_ok")


@dataclass
class Tokenizer:
    """Salted tokens: HMAC-SHA256 of prefix+value, first 24 hex characters.

    The two key pads come from a one-row table read by a scalar subquery, so neither the
    salt nor the pads are literals of the plan.
    """

    ipad: Column
    opad: Column

    @classmethod
    def from_salt(cls, spark: SparkSession, salt: bytes) -> "Tokenizer":
        import hashlib

        key = hashlib.sha256(salt).digest() if len(salt) > 64 else salt
        key = key.ljust(64, b"\0")
        row = [(bytearray(b ^ 0x36 for b in key), bytearray(b ^ 0x5C for b in key))]
        pads = spark.createDataFrame(row, "ipad binary, opad binary")
        return cls(pads.select("ipad").scalar(), pads.select("opad").scalar())

    def token(self, prefix: str, value: Column) -> Column:
        message = F.encode(F.concat(F.lit(prefix), value), "UTF-8")
        inner = F.unhex(F.sha2(F.concat(self.ipad, message), 256))
        return F.substring(F.sha2(F.concat(self.opad, inner), 256), 1, 24)


class ReadableTokens:
    """Prefix + value in clear. For synthetic tables only, where results are compared by eye or SQL."""

    def token(self, prefix: str, value: Column) -> Column:
        return F.concat(F.lit(prefix), value)
