"""Replaces personal data and secrets by keyed surrogates of the same type, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchstrata.core import ContractError, let, stored
from matchstrata.llm.base import query, table

#: Titles that tell a name's gender: m, f, or u (not told).
TITLES = {
    "m": ["Mr", "Mister", "Herr", "Herrn", "Señor", "Sr", "Don", "Monsieur", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Doña", "Madame", "Mme", "Mlle", "Госпожа", "Κυρία"],
    "u": ["Dr", "Prof", "Professor"],
}
ANY_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
SECRETS = "password|passwd|pwd|secret|token|api_?key"
#: Patterns by type; at a place of a text the first that matches counts.
PATTERNS = {
    "key": r"\b(?:(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36})\b|sk-[A-Za-z0-9_\-]{20,}+)",
    "secret": rf"\b(?i:{SECRETS})\b[ \t]{{0,3}}[=:][ \t]{{0,3}}(?:[\"'](?=(?:[^\s\"'\p{{L}}0-9]*+[\p{{L}}0-9]){{6}})[^\s\"']{{6,}}+(?=[\"']|$)|[\"']?(?=[^\s\"'0-9]*+[0-9])[^\s\"']{{6,}}+)",
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@[\p{L}\p{N}\-]{1,63}(?:\.[\p{L}\p{N}\-]{1,63}){0,6}\.\p{L}{2,24}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9.\-+])[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{1,4}(?:[ \-]?[0-9]{1,3})?(?![0-9\-])",
    "phone": r"(?<![\p{L}0-9+])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![0-9])",
    "name": rf"\b(?:{ANY_TITLE})\b\.? \p{{Lu}}\p{{L}}+(?:[ \-]\p{{Lu}}\p{{L}}+){{0,2}}",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity holds; spares most texts the long pattern.
HINT = rf"[0-9@]|(?:{ANY_TITLE})|(?i:{SECRETS})"
#: Attempts after which values that still collide are an error: then their type has hardly more forms than the data has values.
ROUNDS = 40
#: Types whose digits alone identify the entity, however they are set apart.
DIGITS = ("card", "phone", "ssn")
#: Syllables and endings of made-up names, by script (fixed values).
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fi ga go ha he jo ka ke ko la le li lo ma me mi mo na ne no pa pe ra re ro sa se ta te to va ve wi za".split(),
    "cyrillic": "ба бе бо да де до ва ве ви га го жо за ка ке ко ла ле ли ло ма ме ми мо на не но па пе ра ре ро са се та те то фа фе хо ца".split(),
    "greek": "βα βε βο δα δε δο φα φε φι γα γο θα θε κα κε κο λα λε λι λο μα με μι μο να νε νο πα πε ρα ρε ρο σα σε τα τε το χα χε ζα".split(),
}
ENDINGS = {
    "latin": {"m": ["rd", "rt", "n", "s"], "f": ["na", "ra", "lia", "tta"], "u": ["ry", "lle", "x", "dy"], "surname": ["nson", "rtz", "llet", "ndez"]},
    "cyrillic": {"m": ["р", "н", "й", "в"], "f": ["на", "ра", "лия", "тта"], "u": ["ри", "ль", "кс", "ди"], "surname": ["нко", "рук", "лян", "ндт"]},
    "greek": {"m": ["ρος", "νος", "ς", "λης"], "f": ["να", "ρα", "λια", "ττα"], "u": ["ρι", "λε", "ξ", "ντι"], "surname": ["νου", "κης", "λος", "δης"]},
}


def _among(words: list[str], value: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (value % len(words) + 1).cast("int"))


def _of_type(entity: Column) -> Column:
    """Type of a match: the first pattern that is the whole of it."""
    out = None
    for kind, pattern in PATTERNS.items():
        whole = entity.rlike(f"^(?:{pattern})$")
        out = F.when(whole, kind) if out is None else out.when(whole, kind)
    return out.otherwise("card")


def _title(entity: Column) -> Column:
    return F.regexp_extract(entity, rf"^(?:{ANY_TITLE})\b\.? ", 0)


def _kept(entity: Column, kind: Column) -> Column:
    """The part of a match that stays: a title, a secret's name, a key's prefix, a country code."""
    return (
        F.when(kind == "name", _title(entity))
        .when(kind == "secret", F.regexp_extract(entity, "^[A-Za-z_]+[ \\t]*[=:][ \\t]*[\"']?", 0))
        .when(kind == "key", F.regexp_extract(entity, "^(?:AKIA|ghp_|sk-)", 0))
        .when(kind == "phone", F.regexp_extract(entity, r"^\+[0-9]{1,3}(?=[ .\-(])", 0))
        .when(kind == "iban", F.substring(entity, 1, 4))
        .otherwise("")
    )


def atoms(entity: Column) -> Column:
    """What a match names, as an array of (kind, value): one value, or a name's parts, of which the last is the surname.

    Values that differ in case, spacing or punctuation only are one value, so all mentions get one surrogate.
    """
    return let(_of_type(entity), lambda kind: _atoms(entity, kind))


def _atoms(entity: Column, kind: Column) -> Column:
    kept = _kept(entity, kind)
    body = F.substring(entity, F.length(kept) + 1, F.length(entity))
    gender = F.when(_title(entity).rlike(f"^(?:{'|'.join(TITLES['m'])})\\b"), "m").when(_title(entity).rlike(f"^(?:{'|'.join(TITLES['f'])})\\b"), "f").otherwise("u")
    parts = F.split(body, "[ \\-]")
    names = F.transform(parts, lambda p, i: F.struct(F.when(i == F.size(parts) - 1, "surname").otherwise(F.concat(F.lit("given_"), gender)).alias("kind"), F.lower(p).alias("value")))
    value = (
        F.when(kind.isin(*DIGITS), F.regexp_replace(body, "[^0-9]", ""))
        .when(kind == "email", F.lower(body))
        .when(kind == "iban", F.concat(F.substring(kept, 1, 2), F.regexp_replace(body, " ", "")))
        .otherwise(body)
    )
    return F.when(kind == "name", names).otherwise(F.array(F.struct(kind.alias("kind"), value.alias("value"))))


def core(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The surrogate of a value: a keyed hash gives each character, digit, octet or syllable another of its sort."""
    seed = F.concat_ws(":", F.lit(key), kind, attempt.cast("string"), value)
    stream = F.transform(F.sequence(F.lit(0), F.floor(F.length(value) / 32).cast("int")), lambda j: F.sha2(F.concat_ws(":", seed, j.cast("string")), 256))
    return let(stream, lambda s: _core(s, kind, value))


def _core(stream: Column, kind: Column, value: Column) -> Column:
    def byte(i) -> Column:
        return F.conv(F.substring(F.get(stream, F.floor(i / 32).cast("int")), (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")

    hexed = value.rlike("^[0-9a-f]+$")

    def swapped(c: Column, i: Column) -> Column:
        v = byte(i)
        return (
            F.when(c.rlike("[0-9]"), F.when((i == 0) & (c != "0") & kind.isin(*DIGITS), F.when(kind == "card", c).otherwise((v % 9 + 1).cast("string"))).otherwise((v % 10).cast("string")))
            .when(hexed, F.substring(F.lit("abcdef"), v % 6 + 1, F.lit(1)))
            .when(c.rlike("[a-z]"), F.char(v % 26 + 97))
            .when(c.rlike("[A-Z]"), F.char(v % 26 + 65))
            .when(c.rlike("\\p{IsCyrillic}"), _among(list("бвгдежзклмнопрстуфхцч"), v))
            .when(c.rlike("\\p{IsGreek}"), _among(list("αβγδεζηθικλμνξοπρστυφχψω"), v))
            .when(c.rlike("\\p{L}"), F.char(v % 26 + 97))
            .otherwise(c)
        )

    chars = F.filter(F.split(value, ""), lambda c: c != "")
    plain = F.array_join(F.transform(chars, swapped), "")
    top = F.regexp_extract(value, r"\.\p{L}+$", 0)
    mail = F.concat(F.substring(plain, F.lit(1), F.length(value) - F.length(top)), top)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (byte(i) % 254 + 1).cast("string")), ".")

    def luhn(digits: Column) -> Column:
        reverse = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
        doubled = F.transform(reverse, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10))
        return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10

    # The last digit makes the check sum what it was, so valid numbers stay valid.
    body = F.substring(plain, F.lit(1), F.length(value) - 1)
    card = F.concat(body, ((luhn(value) - luhn(F.concat(body, F.lit("0"))) + 10) % 10).cast("string"))
    account = F.concat(F.substring(value, 1, 2), F.substring(plain, F.lit(3), F.length(value)))

    def named(script: str) -> Column:
        syllables, ends = SYLLABLES[script], ENDINGS[script]
        given = F.concat(_among(syllables, byte(F.lit(0))), _among(syllables, byte(F.lit(1))), _among(syllables, byte(F.lit(2))))
        last = byte(F.lit(4))
        return F.when(kind == "surname", F.concat(given, _among(syllables, byte(F.lit(3))), _among(ends["surname"], last))).otherwise(
            F.concat(given, F.when(kind == "given_m", _among(ends["m"], last)).when(kind == "given_f", _among(ends["f"], last)).otherwise(_among(ends["u"], last)))
        )

    name = F.when(value.rlike("\\p{IsCyrillic}"), named("cyrillic")).when(value.rlike("\\p{IsGreek}"), named("greek")).otherwise(named("latin"))
    return (
        F.when(kind.isin("surname", "given_m", "given_f", "given_u"), name)
        .when(kind == "ip", octets)
        .when(kind == "card", card)
        .when(kind == "email", mail)
        .when(kind == "iban", account)
        .otherwise(plain)
    )


def _poured(body: Column, new: Column, kind: Column) -> Column:
    """A surrogate in the format of a mention: its digits where that has digits, its letters in that one's case."""
    chars = F.filter(F.split(body, ""), lambda c: c != "")
    digits = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(new, F.length(F.regexp_replace(F.substring(body, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c)), "")
    cased = F.array_join(F.transform(chars, lambda c, i: F.when(c != F.lower(c), F.upper(F.substring(new, i + 1, F.lit(1)))).otherwise(F.substring(new, i + 1, F.lit(1)))), "")
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substring(new, F.length(F.regexp_replace(F.substring(body, F.lit(1), i + 1), " ", "")) + 2, F.lit(1)))), "")
    return F.when(kind.isin(*DIGITS), digits).when(kind == "email", cased).when(kind == "iban", spaced).otherwise(new)


def _mod97(account: Column) -> Column:
    """Check digits of an account number from its country and the characters behind its check digits."""
    rest = F.filter(F.split(F.concat(F.substring(account, 3, 64), F.substring(account, 1, 2), F.lit("00")), ""), lambda c: c != "")
    sum97 = F.aggregate(rest, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return F.lpad((F.lit(98) - sum97).cast("string"), 2, "0")


def replaced(key: str, entity: Column, attempts: Column | None) -> Column:
    """What stands in the place of a match; ``attempts`` maps kind and value to an attempt other than 0."""

    def new(kind: Column, value: Column) -> Column:
        tried = F.lit(0) if attempts is None else F.coalesce(F.try_element_at(attempts, F.concat_ws(":", kind, value)), F.lit(0))
        return core(key, kind, value, tried)

    def whole(kind: Column) -> Column:
        kept = _kept(entity, kind)
        body = F.substring(entity, F.length(kept) + 1, F.length(entity))
        named = F.zip_with(
            F.regexp_extract_all(body, F.lit("[^ \\-]+"), 0),
            F.transform(_atoms(entity, kind), lambda a: new(a["kind"], a["value"])),
            lambda old, x: F.when(old == F.upper(old), F.upper(x)).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 64))),
        )
        seps = F.concat(F.regexp_extract_all(body, F.lit("[ \\-]"), 0), F.array(F.lit("")))
        one = let(F.element_at(_atoms(entity, kind), 1), lambda a: let(new(a["kind"], a["value"]), lambda n: F.concat(F.when(kind == "iban", F.concat(F.substring(kept, 1, 2), _mod97(n))).otherwise(kept), _poured(body, n, kind))))
        return F.when(kind == "name", F.concat(kept, F.array_join(F.zip_with(named, seps, lambda a, b: F.concat(a, b)), ""))).otherwise(one)

    return let(_of_type(entity), whole)


def has_entity(text: Column) -> Column:
    return F.coalesce(text.rlike(HINT) & text.rlike(ENTITY), F.lit(False))


def _matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ENTITY), 0)


def collisions(values: DataFrame, key: str) -> DataFrame | None:
    """Values (kind, value) whose first surrogate is taken, with the attempt that gives them a free one; None if there are none.

    A surrogate is taken if another value has it or if it is itself a value of the data. Of values that meet, the one with fewer
    attempts, then the smallest, keeps it.
    """
    now = values.withColumn("attempt", F.lit(0))
    some = False
    for _ in range(ROUNDS):
        made = stored(now.withColumn("new", core(key, F.col("kind"), F.col("value"), F.col("attempt"))))
        used = made.select("kind", "new", F.struct("attempt", "value").alias("owner"), F.lit(False).alias("real"))
        real = values.select("kind", F.col("value").alias("new"), F.lit(None).cast(used.schema["owner"].dataType).alias("owner"), F.lit(True).alias("real"))
        met = used.unionByName(real).groupBy("kind", "new").agg(F.count("owner").alias("n"), F.min("owner").alias("keeps"), F.max("real").alias("taken")).where("n > 1 OR (n > 0 AND taken)")
        bad = stored(made.join(met, ["kind", "new"]).where("taken OR value <> keeps.value").select("kind", "value"))
        if bad.isEmpty():
            return made.where("attempt > 0").select("kind", "value", "attempt") if some else None
        some = True
        now = made.select("kind", "value", "attempt").join(bad.withColumn("again", F.lit(1)), ["kind", "value"], "left").select("kind", "value", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
    raise ContractError("a type has too few forms for the values of the data")


def pseudonymised(docs: DataFrame, key: str = "matchstrata") -> DataFrame:
    """``docs`` with every entity of text replaced; adds entities (long), the number of replaced matches of the text.

    Equal values have equal surrogates in all documents, different values different ones. A null text stays null, texts without an
    entity stay as they are; a column entities is replaced. Rows and their repeats are kept, no rows give none. A text of any length is taken whole,
    and so are secrets and sk- keys of any length. Not found are names without a title before them, and secrets that hold no digit unless they stand in quotes.
    """
    text = F.col("text")
    found = docs.select("text").where(has_entity(text))
    values = stored(found.select(F.explode(F.flatten(F.transform(_matches(text), atoms))).alias("a")).select("a.*").distinct())
    again = collisions(values, key)
    attempts = None
    # Rows are held as one value, so that no column of theirs meets a name used here.
    base = docs.select(F.struct(*docs.columns).alias("held"))
    if again is not None:
        # The few values on a later attempt, by the rows that hold them; equal rows hold the same ones.
        row = docs.where(has_entity(text)).select(F.col("doc_id").alias("row_doc"), F.xxhash64("text").alias("row_text"), F.explode(F.flatten(F.transform(_matches(text), atoms))).alias("a"))
        maps = (
            row.select("row_doc", "row_text", "a.kind", "a.value").join(again, ["kind", "value"]).distinct()
            .groupBy("row_doc", "row_text").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "value"), "attempt"))).alias("row_attempts"))
        )
        base = base.join(maps, F.col("held.doc_id").eqNullSafe(F.col("row_doc")) & (F.xxhash64("held.text") == F.col("row_text")), "left")
        attempts = F.coalesce("row_attempts", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")))
    text = F.col("held.text")
    pieces = F.concat(F.transform(_matches(text), lambda e: replaced(key, e, attempts)), F.array(F.lit("")))
    new = F.array_join(F.zip_with(F.split(text, ENTITY, -1), pieces, lambda a, b: F.concat(a, b)), "")
    changed = F.when(has_entity(text), F.struct(new.alias("text"), F.size(_matches(text)).cast("long").alias("n"))).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n")))
    out = base.select("held", changed.alias("changed"))
    return out.select(*[F.col("changed.text" if c == "text" else f"held.`{c}`").alias(c) for c in docs.columns if c != "entities"], F.col("changed.n").alias("entities"))


@query("op3_keyed_surrogates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))
