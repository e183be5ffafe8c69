"""Queries over the registry stand-in: typing, screening, timelines, adjudication, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchstrata.catalog.base import query, table
from matchstrata.catalog.bindings import registry_raw, with_registry
from matchstrata.core import keep, stored
from matchstrata.functions import text as tx
from matchstrata.functions.identity import ReadableTokens, Tokenizer
from matchstrata.operators import audit, registry, timeline, validate
from matchstrata.operators.multiplicity import benjamini_hochberg

# A fixed example salt for the synthetic tables; real salts come from a local file.
EXAMPLE_SALT = b"synthetic-tables-only"


#: Every year of the source; a pivot's columns must be known, its rows are not cut by them.
YEARS = list(range(1995, 2002))


def typed_now(spark, sf):
    return registry.typed_records(registry_raw(spark, sf), ReadableTokens())


def records(spark, sf):
    """Typed records, written once: every later step reads them instead of parsing again."""
    return keep(spark, (sf, "records"), lambda: stored(typed_now(spark, sf)))


def screened(spark, sf):
    return registry.screen(records(spark, sf))


def candidates(spark, sf):
    """Screened rows with '' or the key they lost by in de-duplication, written once."""
    return keep(spark, (sf, "candidates"), lambda: stored(registry.candidate_events(screened(spark, sf))))


def events(spark, sf):
    """Candidate events: screened and de-duplicated."""
    return candidates(spark, sf).filter("reason = ''").drop("reason")


def day(c):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def days(*cols):
    return [day(c) for c in cols]


# ---------------------------------------------------------------- scalars


@query(
    "F01_F02_F03_F04_F05_F07_typed_records",
    with_registry(
        """SELECT event_id, cast(onset AS varchar) AS onset, cast(birth AS varchar) AS birth,
        cast(report_date AS varchar) AS report_date, cast(diagnosis_date AS varchar) AS diagnosis_date,
        sex, icd10, icd_prefix, diagnosis_text, age, season, review_status FROM registry"""
    ),
)
def typed(spark, sf):
    return typed_now(spark, sf).select(
        "event_id", *days("onset", "birth", "report_date", "diagnosis_date"),
        "sex", "icd10", "icd_prefix", "diagnosis_text", "age", "season", "review_status",
    )


_IPAD = "".join(f"{b ^ 0x36:02x}" for b in EXAMPLE_SALT.ljust(64, b"\0"))
_OPAD = "".join(f"{b ^ 0x5C:02x}" for b in EXAMPLE_SALT.ljust(64, b"\0"))


@query(
    "F06_salted_tokens",
    with_registry(
        f"""SELECT event_id,
        substr(sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(location_id)))), 1, 24) AS location_token,
        CASE WHEN person_id IS NOT NULL THEN substr(sha256(unhex('{_OPAD}')
          || unhex(sha256(unhex('{_IPAD}') || encode(person_id)))), 1, 24) END AS person_token
        FROM registry"""
    ),
)
def salted(spark, sf):
    rows = registry.typed_records(registry_raw(spark, sf), Tokenizer.from_salt(spark, EXAMPLE_SALT))
    return rows.select(
        "event_id", F.col("location_id").alias("location_token"), F.col("person_id").alias("person_token")
    )


@query(
    "F08_F09_F35_identity_checks",
    with_registry(
        """SELECT event_id, CASE WHEN is18 AND chk <> substr(identity, 18, 1) THEN '18位格式但校验码不符'
        WHEN NOT is15 AND NOT is18 THEN '缺失或格式不符' WHEN id_birth IS NULL THEN '证件内出生日期无效'
        WHEN is15 THEN '15位旧证件格式（可转换）' ELSE '18位且校验码符合' END AS id_check,
        canonical_person_id, cast(coalesce(id_valid AND birth <> id_birth, false) AS integer) AS id_dob_conflict,
        cast(id_valid AND sex <> id_sex AS integer) AS id_sex_conflict, id_numeric_storage FROM registry"""
    ),
)
def identity_checks(spark, sf):
    return typed_now(spark, sf).select(
        "event_id", "id_check", "canonical_person_id", "id_dob_conflict", "id_sex_conflict", "id_numeric_storage"
    )


@query(
    "F10_F11_code_maps",
    with_registry(
        """SELECT event_id, CASE WHEN icd10 LIKE 'I63%' THEN 'I63' WHEN icd_prefix IN ('I21','I22') THEN 'AMI'
        WHEN icd10 LIKE 'I20.0%' THEN 'I20_0' WHEN icd_prefix = 'I61' THEN 'I61' WHEN icd_prefix = 'I60' THEN 'I60'
        ELSE '' END AS outcome, disease,
        CASE WHEN icd_prefix IN ('I20','I21','I22','I46') THEN 'CVD'
             WHEN icd_prefix IN ('I60','I61','I63','I64') THEN 'CBVD' END AS broad_group,
        CASE icd_prefix WHEN 'I21' THEN 'MI' WHEN 'I22' THEN 'MI' WHEN 'I20' THEN 'ANGINA' WHEN 'I63' THEN 'IS'
             WHEN 'I61' THEN 'ICH' WHEN 'I60' THEN 'SAH' END AS subtype FROM registry"""
    ),
)
def code_maps(spark, sf):
    p = F.col("icd_prefix")
    return records(spark, sf).select(
        "event_id",
        tx.outcome(F.col("icd10")).alias("outcome"),
        "disease",
        tx.label_by_prefix(p, tx.BROAD_GROUPS).alias("broad_group"),
        tx.label_by_prefix(p, tx.SUBTYPES).alias("subtype"),
    )


_OUTCOME = """CASE WHEN icd10 LIKE 'I63%' THEN 'I63' WHEN icd_prefix IN ('I21','I22') THEN 'AMI'
 WHEN icd10 LIKE 'I20.0%' THEN 'I20_0' WHEN icd_prefix = 'I61' THEN 'I61' WHEN icd_prefix = 'I60' THEN 'I60' ELSE '' END"""
_CLINICAL = """CASE WHEN outcome = '' THEN 'outside_five_prespecified_code_groups'
 WHEN outcome = 'I61' AND (diagnosis_text LIKE '%脑梗死%' OR diagnosis_text LIKE '%蛛网膜%') THEN 'code_text_conflict'
 WHEN outcome = 'I63' AND (diagnosis_text LIKE '%脑出血%' OR diagnosis_text LIKE '%蛛网膜%') THEN 'code_text_conflict'
 WHEN outcome = 'I20_0' AND replace(diagnosis_text, '不稳定', '') LIKE '%稳定%' THEN 'code_text_conflict'
 WHEN outcome = 'I20_0' AND diagnosis_text LIKE '%不稳定%' THEN 'unstable_text_agrees'
 WHEN outcome = 'I20_0' THEN 'generic_angina_text_requires_subtype_review'
 ELSE 'code_supported_text_not_contradictory' END"""


@query(
    "F12_F13_F14_F15_text_flags",
    with_registry(
        f"""SELECT event_id, {_CLINICAL} AS clinical_flag,
        cast(diagnosis_text LIKE '%陈旧性%' OR diagnosis_text LIKE '%后遗症%' OR diagnosis_text LIKE '%恢复期%'
          OR diagnosis_text LIKE '%康复期%' AS integer) AS chronic,
        CASE WHEN p6 <> '' AND p6 NOT IN ('无','不详','未知','-','0') THEN '门牌栏有文字'
          WHEN p5 <> '' THEN '有居委会或村文字' ELSE '仅街道及以上文字' END AS address_detail,
        CASE WHEN treatment = '' THEN '缺失'
          WHEN upper(treatment) LIKE '%PCI%' OR treatment LIKE '%介入%' OR treatment LIKE '%支架%' THEN '提及PCI/介入'
          WHEN upper(treatment) LIKE '%CABG%' OR treatment LIKE '%搭桥%' THEN '提及CABG/搭桥'
          ELSE '有填写（需按原表核实）' END AS treatment
        FROM (SELECT *, {_OUTCOME} AS outcome FROM registry)"""
    ),
)
def text_flags(spark, sf):
    raw = registry_raw(spark, sf)
    diagnosis = tx.clean_text(F.col("diagnosis_text"))
    code = F.upper(tx.clean_text(F.col("icd10")))
    return raw.select(
        tx.event_id(F.col("source_year"), F.col("source_row")).alias("event_id"),
        tx.clinical_flag(tx.outcome(code), diagnosis).alias("clinical_flag"),
        tx.chronic_text(diagnosis).alias("chronic"),
        tx.address_detail(tx.clean_text(F.col("addr_community")), tx.clean_text(F.col("addr_number"))).alias(
            "address_detail"
        ),
        tx.treatment_category(F.col("treatment")).alias("treatment"),
    )


@query(
    "F33_F34_F37_delays_modifiers_address",
    with_registry(
        """SELECT event_id, datediff('day', onset, report_date) AS onset_to_report,
        datediff('day', onset, diagnosis_date) AS onset_to_diagnosis,
        coalesce(cast(diagnosis_date < onset AS integer), 0) AS diagnosis_before_onset,
        coalesce(cast(report_date < onset AS integer), 0) AS report_before_onset,
        cast(age >= 65 AS integer) AS age65, CASE sex WHEN '男' THEN 1 WHEN '女' THEN 0 END AS male,
        CASE WHEN onset IS NULL THEN NULL WHEN month(onset) BETWEEN 4 AND 9 THEN 1 ELSE 0 END AS warm,
        address, cast(p6 <> '' AS integer) AS has_door_text, location_id FROM registry"""
    ),
)
def delays(spark, sf):
    m = tx.modifiers(F.col("age"), F.col("sex"), F.col("onset"))
    return records(spark, sf).select(
        "event_id", "onset_to_report", "onset_to_diagnosis", "diagnosis_before_onset", "report_before_onset",
        *[c.alias(n) for n, c in m.items()], "address", "has_door_text", "location_id",
    )


# ---------------------------------------------------------------- screening


@query(
    "P01_screening_reasons",
    with_registry("SELECT event_id, reason FROM screened"),
)
def screening(spark, sf):
    return screened(spark, sf).select("event_id", "reason")


@query("P02_greedy_deduplication", with_registry("SELECT event_id, lost AS reason FROM judged"))
def greedy(spark, sf):
    return registry.candidate_events(screened(spark, sf)).select("event_id", "reason")


_ZERO_SQL = "SELECT cast(0 AS bigint) AS violations"


@query("P02_greedy_property_check", _ZERO_SQL)
def greedy_property(spark, sf):
    """Rows whose decision contradicts the kept rows before them; none may exist."""
    held = registry.held_against_rule(registry.candidate_events(screened(spark, sf)))
    return held.agg(F.count_if(F.col("should") != F.col("reason")).alias("violations"))


@query(
    "A01_T01_screening_flow",
    with_registry(
        """SELECT source_year, step, n FROM (
        SELECT source_year, '原始非空记录' AS step, count(*) AS n FROM screened GROUP BY 1
        UNION ALL SELECT source_year, reason, count(*) FROM screened WHERE reason <> '' GROUP BY 1, 2
        UNION ALL SELECT source_year, CASE WHEN lost = '' THEN '保留候选记录（非最终事件）' ELSE lost END, count(*)
        FROM judged GROUP BY 1, 2)"""
    ),
)
def flow(spark, sf):
    return registry.screening_flow(screened(spark, sf), candidates(spark, sf)).orderBy("source_year", F.desc("n"), "step")


@query(
    "P17_U03_location_queue",
    with_registry(
        """SELECT DISTINCT location_id, address, cast(p6 <> '' AS integer) AS has_door_text,
        cast(NULL AS double) AS longitude, cast(NULL AS double) AS latitude, '' AS crs, '' AS verified_within_1km FROM ev"""
    ),
)
def queue(spark, sf):
    return registry.location_queue(events(spark, sf))


@query(
    "A02_categorical_audit",
    with_registry(
        """SELECT source_year, field, CASE WHEN coalesce(value, '') = '' THEN '(空)' ELSE value END AS value, count(*) AS n
        FROM (SELECT source_year, unnest(['duplicate_flag','review_status','icd3','city','first_onset_flag']) AS field,
          unnest([duplicate_flag, review_status, substr(icd10, 1, 3), p2, first_onset_flag]) AS value FROM registry)
        GROUP BY ALL"""
    ),
)
def categories(spark, sf):
    fields = {
        "duplicate_flag": F.col("duplicate_flag"),
        "review_status": F.col("review_status"),
        "icd3": F.substring("icd10", 1, 3),
        "city": F.col("addr_city"),
        "first_onset_flag": F.col("first_onset_flag"),
    }
    return audit.categorical_audit(records(spark, sf), ["source_year"], fields)


@query(
    "A03_disease_summary",
    with_registry(
        f"""SELECT disease, count(*) AS candidate_n, {", ".join(f"count(*) FILTER (year = {y}) AS n{y}" for y in YEARS)},
        count(*) FILTER (sex IN ('男','1')) AS male_n, count(*) FILTER (sex IN ('女','2')) AS female_n,
        count(*) FILTER (age >= 65) AS age65plus_n, count(*) FILTER (p6 <> '') AS door_text_n
        FROM ev GROUP BY disease"""
    ),
)
def disease_summary(spark, sf):
    conditions = {
        **{f"n{y}": F.col("year") == y for y in YEARS},
        "male_n": F.col("sex").isin("男", "1"),
        "female_n": F.col("sex").isin("女", "2"),
        "age65plus_n": F.col("age") >= 65,
        "door_text_n": F.col("has_door_text") == 1,
    }
    return audit.conditional_counts(events(spark, sf), ["disease"], conditions).withColumnRenamed("n", "candidate_n")


@query(
    "A04_person_multiplicity",
    with_registry(
        """SELECT rows_per_key, count(*) AS keys FROM
        (SELECT person_id, count(*) AS rows_per_key FROM ev GROUP BY 1) GROUP BY 1"""
    ),
)
def person_multiplicity(spark, sf):
    return audit.multiplicity(events(spark, sf), "person_id")


_AGE = """count(*) AS n, round(avg(age), 6) AS age_mean, round(stddev_samp(age), 6) AS age_sd,
 round(quantile_cont(age, 0.25), 4) AS age_q1, round(quantile_cont(age, 0.5), 4) AS age_median,
 round(quantile_cont(age, 0.75), 4) AS age_q3, min(age) AS age_min, max(age) AS age_max,
 count(*) FILTER (sex = '男') AS male_n, count(*) FILTER (sex = '女') AS female_n,
 count(*) FILTER (sex NOT IN ('男','女')) AS sex_other_n, count(*) FILTER (age < 65) AS age18_64_n,
 count(*) FILTER (age >= 65) AS age65plus_n, count(*) FILTER (season = '暖季') AS warm_n,
 count(*) FILTER (season = '冷季') AS cold_n, count(*) FILTER (review_status = '已终审') AS terminal_review_n"""


@query(
    "A05_age_profile",
    with_registry(
        f"""SELECT disease, cast(year AS varchar) AS year, {_AGE} FROM ev GROUP BY disease, ev.year
        UNION ALL SELECT disease, '合计', {_AGE} FROM ev GROUP BY disease"""
    ),
)
def ages(spark, sf):
    out = audit.age_profile(events(spark, sf), "disease", "year")
    for c, p in (("age_mean", 6), ("age_sd", 6), ("age_q1", 4), ("age_median", 4), ("age_q3", 4)):
        out = out.withColumn(c, F.round(c, p))
    return out


@query(
    "A06_inclusion_sensitivity",
    with_registry(
        """SELECT disease, count(*) AS all_candidate_n, count(*) FILTER (review_status = '已终审') AS terminal_review_only_n,
        count(DISTINCT person_id) AS first_record_per_person_n,
        count(*) - count(DISTINCT person_id) AS loss_if_first_only_n,
        count(*) FILTER (icd10 LIKE 'I20.0%') AS "I20_0_n" FROM ev GROUP BY 1"""
    ),
)
def inclusion(spark, sf):
    return audit.inclusion_counts(events(spark, sf), "disease")


@query(
    "A07_date_quality",
    with_registry(
        """SELECT year, field, CASE WHEN value IS NULL THEN '缺失或无效' WHEN value < onset THEN '早于发病'
        ELSE '日期逻辑正常' END AS status, count(*) AS n FROM (
        SELECT year, onset, unnest(['diagnosis_date','report_date']) AS field, unnest([diagnosis_date, report_date]) AS value
        FROM ev) GROUP BY ALL"""
    ),
)
def date_quality(spark, sf):
    return audit.date_quality(events(spark, sf), ["year"], "onset", ["diagnosis_date", "report_date"])


@query(
    "A08_treatment_and_address_counts",
    with_registry(
        """SELECT year, icd10, CASE WHEN treatment = '' THEN '缺失'
        WHEN upper(treatment) LIKE '%PCI%' OR treatment LIKE '%介入%' OR treatment LIKE '%支架%' THEN '提及PCI/介入'
        WHEN upper(treatment) LIKE '%CABG%' OR treatment LIKE '%搭桥%' THEN '提及CABG/搭桥'
        ELSE '有填写（需按原表核实）' END AS treatment_field, cast(NULL AS varchar) AS text_detail, count(*) AS n
        FROM ev WHERE icd10 LIKE 'I20%' GROUP BY ALL
        UNION ALL SELECT year, NULL, NULL, CASE WHEN p6 <> '' AND p6 NOT IN ('无','不详','未知','-','0') THEN '门牌栏有文字'
        WHEN p5 <> '' THEN '有居委会或村文字' ELSE '仅街道及以上文字' END AS text_detail, count(*) AS n
        FROM ev GROUP BY ALL"""
    ),
)
def address_counts(spark, sf):
    return audit.treatment_and_address_counts(events(spark, sf))


# ---------------------------------------------------------------- timelines


_CANON = """canon AS (SELECT canonical_person_id AS person, icd_prefix AS code, onset, event_id, location_id, icd10, source_year
 FROM registry WHERE canonical_person_id IS NOT NULL AND onset IS NOT NULL
 AND icd_prefix IN ('I20','I21','I22','I60','I61','I63','I64'))"""


def canonical(spark, sf):
    rows = records(spark, sf).filter("canonical_person_id IS NOT NULL AND onset IS NOT NULL")
    rows = rows.filter(F.col("icd_prefix").isin(registry.EPISODE_PREFIXES))
    return rows.select(
        F.col("canonical_person_id").alias("person"), F.col("icd_prefix").alias("code"),
        "onset", "event_id", "location_id", "icd10", "source_year",
    )


@query(
    "W01_adjacent_pairs",
    with_registry(
        """SELECT previous_event_id, event_id AS current_event_id, person, code,
        cast(previous_onset AS varchar) AS previous_onset, cast(onset AS varchar) AS current_onset, gap_days,
        cast(pl <> location_id AS integer) AS address_conflict, cast(pi <> icd10 AS integer) AS full_icd_conflict,
        cast(py <> source_year AS integer) AS cross_year,
        CASE WHEN gap_days = 0 THEN 'same_day_duplicate_candidate' ELSE 'within28_monitoring_episode_candidate' END AS classification
        FROM (SELECT *, datediff('day', previous_onset, onset) AS gap_days FROM (
          SELECT *, lag(event_id) OVER w AS previous_event_id, lag(onset) OVER w AS previous_onset,
          lag(location_id) OVER w AS pl, lag(icd10) OVER w AS pi, lag(source_year) OVER w AS py
          FROM canon WINDOW w AS (PARTITION BY person, code ORDER BY onset, event_id))) WHERE gap_days <= 28""",
        _CANON,
    ),
)
def adjacent(spark, sf):
    pairs = timeline.adjacent_pairs(
        canonical(spark, sf), ["person", "code"], "onset", "event_id",
        {"address_conflict": "location_id", "full_icd_conflict": "icd10", "cross_year": "source_year"},
    )
    return pairs.withColumn("previous_onset", day("previous_onset")).withColumn("current_onset", day("current_onset"))


_NEAR = """SELECT event_id, cast(coalesce(datediff('day', lag(onset) OVER w, onset) <= 28, false)
 OR coalesce(datediff('day', onset, lead(onset) OVER w) <= 28, false) AS integer) AS near
 FROM canon WINDOW w AS (PARTITION BY person, code ORDER BY onset, event_id)"""


@query("W02_near_endpoints", with_registry(_NEAR, _CANON))
def near(spark, sf):
    return timeline.flag_near(canonical(spark, sf), ["person", "code"], "onset").select("event_id", "near")


def _episodes(keys: str, source: str) -> tuple[str, ...]:
    """Recursive anchors: the next one is the least day more than 28 days after."""
    return (
        f"dd AS (SELECT DISTINCT {keys}, onset FROM {source})",
        f"""an AS (SELECT {keys}, min(onset) AS anchor, 1 AS episode FROM dd GROUP BY {keys}
        UNION ALL SELECT {", ".join("a." + k.strip() for k in keys.split(","))},
          (SELECT min(d.onset) FROM dd d WHERE {" AND ".join(f"d.{k.strip()} = a.{k.strip()}" for k in keys.split(","))}
             AND d.onset > a.anchor + 28), a.episode + 1
        FROM an a WHERE a.anchor IS NOT NULL)""",
        f"""spans AS (SELECT {keys}, anchor, episode, lead(anchor) OVER (PARTITION BY {keys} ORDER BY episode) AS upto
        FROM an WHERE anchor IS NOT NULL)""",
    )


@query(
    "W03_anchored_episodes",
    """WITH RECURSIVE o AS (SELECT o_custkey AS person, cast(o_orderdate AS date) AS onset FROM orders), """
    + ", ".join(_episodes("person", "o"))
    + """ SELECT o_orderkey AS event_id, s.person, cast(s.anchor AS varchar) AS anchor, s.episode
    FROM orders JOIN spans s ON o_custkey = s.person AND cast(o_orderdate AS date) >= s.anchor
    AND (s.upto IS NULL OR cast(o_orderdate AS date) < s.upto)""",
)
def episodes(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("person"), F.to_date("o_orderdate").alias("onset")
    )
    return timeline.with_episodes(rows, ["person"], "onset").select("event_id", "person", day("anchor"), "episode")


@query(
    "W03_registry_episode_openers",
    with_registry(
        """SELECT s.person, s.code, cast(s.anchor AS varchar) AS onset, min(c.event_id) AS event_id, s.episode
        FROM spans s JOIN canon c ON c.person = s.person AND c.code = s.code AND c.onset = s.anchor GROUP BY ALL""",
        _CANON,
        *_episodes("person, code", "canon"),
        recursive=True,
    ),
)
def openers(spark, sf):
    out = timeline.anchored_first(canonical(spark, sf), ["person", "code"], "onset", "event_id")
    return out.withColumn("onset", day("onset"))


@query(
    "W04_first_records",
    with_registry(
        """SELECT person, code, cast(onset AS varchar) AS onset, event_id FROM (SELECT *, row_number() OVER
        (PARTITION BY person, code ORDER BY onset, event_id) AS r FROM canon) WHERE r = 1""",
        _CANON,
    ),
)
def firsts(spark, sf):
    out = timeline.first_records(canonical(spark, sf), ["person", "code"], "onset", "event_id")
    return out.withColumn("onset", day("onset"))


_FAMILY = """fam AS (SELECT canonical_person_id AS person, icd_prefix AS code, onset, event_id, location_id,
 CASE WHEN icd_prefix IN ('I21','I22') THEN 'AMI' ELSE 'stroke' END AS family FROM registry
 WHERE canonical_person_id IS NOT NULL AND onset IS NOT NULL AND icd_prefix IN ('I21','I22','I60','I61','I63','I64'))"""
_FAMILY_PAIRS = """pairs AS (SELECT a.person, a.family, a.onset AS po, a.code AS pc, b.onset AS co, b.code AS cc,
 a.event_id AS pe, b.event_id AS ce, a.location_id <> b.location_id AS lc FROM fam a JOIN fam b
 ON a.person = b.person AND a.family = b.family AND a.code <> b.code
 AND datediff('day', a.onset, b.onset) BETWEEN 0 AND 28 AND (a.onset < b.onset OR a.code < b.code))"""


def family(spark, sf):
    rows = records(spark, sf).filter("canonical_person_id IS NOT NULL AND onset IS NOT NULL")
    fam = registry.pair_family(F.col("icd_prefix"))
    return rows.select(
        F.col("canonical_person_id").alias("person"), fam.alias("family"), F.col("icd_prefix").alias("code"),
        "onset", "event_id", "location_id",
    ).filter("family IS NOT NULL")


@query(
    "J13_cross_code_cells",
    with_registry(
        """SELECT person, family, cast(po AS varchar) AS previous_onset, pc AS previous_code,
        cast(co AS varchar) AS current_onset, cc AS current_code, datediff('day', po, co) AS gap_days,
        count(*) AS n_pairs, count(*) FILTER (lc) AS n_location_conflict FROM pairs GROUP BY ALL""",
        _FAMILY,
        _FAMILY_PAIRS,
    ),
)
def cross_cells(spark, sf):
    out = timeline.cross_code_cells(family(spark, sf), ["person", "family"], "code", "onset", "location_id")
    return out.withColumn("previous_onset", day("previous_onset")).withColumn("current_onset", day("current_onset"))


@query(
    "J13_cross_code_flags",
    with_registry(
        """SELECT event_id, cast(event_id IN (SELECT pe FROM pairs UNION ALL SELECT ce FROM pairs) AS integer) AS cross_near
        FROM fam""",
        _FAMILY,
        _FAMILY_PAIRS,
    ),
)
def cross_flags(spark, sf):
    return timeline.flag_cross_code(family(spark, sf), ["person", "family"], "code", "onset").select(
        "event_id", "cross_near"
    )


@query(
    "A09_F31_interval_bands",
    with_registry(
        """SELECT code, CASE WHEN g = 0 THEN '0' WHEN g <= 28 THEN '1-28' WHEN g <= 90 THEN '29-90'
        WHEN g <= 365 THEN '91-365' ELSE '>365' END AS interval, count(*) AS adjacent_pairs FROM (
        SELECT code, datediff('day', lag(onset) OVER (PARTITION BY person, code ORDER BY onset, event_id), onset) AS g
        FROM canon) WHERE g IS NOT NULL GROUP BY ALL""",
        _CANON,
    ),
)
def bands(spark, sf):
    return audit.interval_bands(canonical(spark, sf), "person", "code", "onset", "event_id")


@query(
    "A10_duplicate_groups",
    with_registry(
        """SELECT count(*) AS groups, cast(coalesce(sum(n), 0) AS bigint) AS rows_in_groups,
        count(*) FILTER (la > 1) AS different_address, count(*) FILTER (li > 1) AS different_code FROM (
        SELECT count(*) AS n, count(DISTINCT location_id) AS la, count(DISTINCT icd10) AS li FROM registry
        WHERE person_id IS NOT NULL AND onset IS NOT NULL GROUP BY person_id, onset, icd_prefix) WHERE n > 1"""
    ),
)
def duplicate_groups(spark, sf):
    rows = records(spark, sf).filter("person_id IS NOT NULL AND onset IS NOT NULL")
    return audit.duplicate_groups(
        rows, ["person_id", "onset", "icd_prefix"], {"different_address": "location_id", "different_code": "icd10"}
    )


_ID_LABEL = """CASE WHEN is18 AND chk <> substr(identity, 18, 1) THEN '18位格式但校验码不符'
 WHEN NOT is15 AND NOT is18 THEN '缺失或格式不符' WHEN id_birth IS NULL THEN '证件内出生日期无效'
 WHEN is15 THEN '15位旧证件格式（可转换）' ELSE '18位且校验码符合' END"""


@query(
    "A12_identity_audit",
    with_registry(
        f"""SELECT source_year, audit, result, count(*) AS n FROM (
        SELECT source_year, 'format' AS audit, {_ID_LABEL} AS result FROM registry
        UNION ALL SELECT source_year, 'storage', 'numeric' FROM registry WHERE id_numeric_storage = 1
        UNION ALL SELECT source_year, 'birth', CASE WHEN birth IS NULL THEN 'missing' WHEN birth = id_birth THEN 'same'
          ELSE 'differs' END FROM registry WHERE id_valid
        UNION ALL SELECT source_year, 'sex', CASE WHEN sex = id_sex THEN 'same' ELSE 'differs' END
          FROM registry WHERE id_valid) GROUP BY ALL"""
    ),
)
def identity_audit(spark, sf):
    rows = records(spark, sf)
    valid = F.col("canonical_person_id").isNotNull()
    fields = {
        "format": F.col("id_check"),
        "storage": F.when(F.col("id_numeric_storage") == 1, "numeric"),
        "birth": F.when(
            valid,
            F.when(F.col("birth").isNull(), "missing").when(F.col("id_dob_conflict") == 0, "same").otherwise("differs"),
        ),
        "sex": F.when(valid, F.when(F.col("id_sex_conflict") == 0, "same").otherwise("differs")),
    }
    out = audit.categorical_audit(rows, ["source_year"], fields, blank="")
    return out.filter("value <> ''").select("source_year", F.col("field").alias("audit"), F.col("value").alias("result"), "n")


@query(
    "A21_A22_link_and_card_collisions",
    with_registry(
        """SELECT kind, key, n FROM (
        SELECT 'linked_tokens' AS kind, canonical_person_id AS key, count(DISTINCT person_id) AS n FROM registry
          WHERE canonical_person_id IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'card_rows', source_year || '/' || card_token, count(*) FROM registry
          WHERE card_token IS NOT NULL GROUP BY 2) WHERE n > 1"""
    ),
)
def collisions(spark, sf):
    rows = records(spark, sf)
    links = registry.linked_tokens(rows).select(
        F.lit("linked_tokens").alias("kind"), F.col("canonical_person_id").alias("key"), F.col("linked_tokens").alias("n")
    )
    cards = registry.card_rows(rows).select(
        F.lit("card_rows").alias("kind"),
        F.concat_ws("/", F.col("source_year").cast("string"), "card_token").alias("key"),
        F.col("card_rows").alias("n"),
    )
    return links.unionByName(cards).filter("n > 1")


# ---------------------------------------------------------------- adjudication


_ADJ = (
    _CANON,
    f"nearby AS ({_NEAR})",
    _FAMILY,
    _FAMILY_PAIRS,
    "crossed AS (SELECT pe AS event_id FROM pairs UNION SELECT ce FROM pairs)",
    """linked AS (SELECT event_id, lag(event_id) OVER w AS previous_event_id,
      datediff('day', lag(onset) OVER w, onset) AS gap FROM canon WINDOW w AS (PARTITION BY person, code ORDER BY onset, event_id))""",
    """toks AS (SELECT canonical_person_id, count(DISTINCT person_id) AS k FROM registry
      WHERE canonical_person_id IS NOT NULL GROUP BY 1)""",
    "cards AS (SELECT source_year, card_token, count(*) AS k FROM registry WHERE card_token IS NOT NULL GROUP BY 1, 2)",
    "framed AS (SELECT s.* REPLACE (coalesce(j.lost, s.reason) AS reason) FROM screened s LEFT JOIN judged j USING (event_id))",
    f"""base AS (SELECT s.*, CASE WHEN s.reason = '' THEN {_OUTCOME} ELSE '' END AS outcome, coalesce(n.near, 0) AS near,
      cast(x.event_id IS NOT NULL AS integer) AS crossed, l.previous_event_id, l.gap, t.k AS toks, c.k AS cards
      FROM framed s LEFT JOIN nearby n USING (event_id) LEFT JOIN crossed x USING (event_id)
      LEFT JOIN linked l USING (event_id) LEFT JOIN toks t USING (canonical_person_id)
      LEFT JOIN cards c ON c.source_year = s.source_year AND c.card_token = s.card_token)""",
    f"noted AS (SELECT *, CASE WHEN reason = '' THEN {_CLINICAL} END AS note FROM base)",
    """flagged AS (SELECT *, list_filter([
      CASE WHEN review_status <> '已终审' AND review_status LIKE '%不通过%' THEN 'REVIEW_REJECTED' END,
      CASE WHEN review_status <> '已终审' AND review_status NOT LIKE '%不通过%' THEN 'REVIEW_INCOMPLETE' END,
      CASE WHEN canonical_person_id IS NULL THEN 'IDENTITY_INVALID' END,
      CASE WHEN id_valid AND birth <> id_birth THEN 'IDENTITY_DOB_CONFLICT' END,
      CASE WHEN id_valid AND sex <> id_sex THEN 'IDENTITY_SEX_CONFLICT' END,
      CASE WHEN id_numeric_storage = 1 THEN 'IDENTITY_NUMERIC_STORAGE' END,
      CASE WHEN toks > 1 THEN 'CANONICAL_ID_LINK_CHANGE' END,
      CASE WHEN diagnosis_date < onset OR report_date < onset THEN 'DATE_SEQUENCE_CONFLICT' END,
      CASE WHEN regexp_matches(diagnosis_text, '陈旧性|后遗症|恢复期|康复期') THEN 'CHRONIC_DIAGNOSIS_REVIEW' END,
      CASE WHEN duplicate_flag IN ('是', '1', '1.0') THEN 'SOURCE_DUPLICATE_FLAG' END,
      CASE WHEN duplicate_flag = '#NUM!' THEN 'SOURCE_DUPLICATE_ERROR' END,
      CASE WHEN near = 1 THEN 'SAME_PREFIX_WITHIN28_REVIEW' END,
      CASE WHEN crossed = 1 THEN 'CROSS_PREFIX_WITHIN28_REVIEW' END,
      CASE WHEN cards > 1 THEN 'DUPLICATE_CARD_REVIEW' END,
      CASE WHEN note = 'code_text_conflict' THEN 'CODE_TEXT_CONFLICT' END,
      CASE WHEN outcome = 'I20_0' AND note <> 'unstable_text_agrees' THEN 'ACUTE_ANGINA_TEXT_REVIEW' END,
      CASE WHEN outcome = 'I20_0' AND source_year > 1997 AND near = 1 THEN 'ANGINA_LOCAL_WINDOW_UNCONFIRMED' END],
      lambda f: f IS NOT NULL) AS flags FROM noted)""",
    """adj AS (SELECT *, CASE WHEN reason <> '' THEN 'outside_existing_candidate_frame' WHEN outcome = '' THEN 'excluded'
      WHEN list_contains(flags, 'REVIEW_REJECTED') THEN 'excluded' WHEN len(flags) > 0 THEN 'pending_review'
      ELSE 'included' END AS decision,
      CASE WHEN crossed = 1 THEN 'cross_subtype_short_interval_pending'
      WHEN near = 1 THEN 'duplicate_or_same_monitoring_episode_pending'
      WHEN previous_event_id IS NOT NULL THEN 'new_monitoring_episode_gt28_clinical_recurrence_unconfirmed'
      WHEN canonical_person_id IS NOT NULL THEN 'first_observed_same_prefix_record_not_lifetime_first'
      ELSE 'not_classified' END AS relation FROM flagged)""",
)


def adjudicated(spark, sf):
    return registry.adjudicate(records(spark, sf), events(spark, sf), angina_rule_year=1997)


@query(
    "P04_P05_P06_J24_adjudication",
    with_registry(
        """SELECT event_id, array_to_string(flags, ';') AS review_flags, decision,
        CASE WHEN decision = 'included' THEN 1 WHEN decision = 'pending_review' THEN NULL ELSE 0 END AS eligible,
        cast(decision IN ('included', 'excluded') AS integer) AS dedup_finalized, relation AS event_relation,
        previous_event_id, gap AS days_since_previous, outcome AS final_outcome FROM adj""",
        *_ADJ,
    ),
)
def adjudication(spark, sf):
    return adjudicated(spark, sf).select(
        "event_id", F.concat_ws(";", "review_flags").alias("review_flags"), "decision", "eligible", "dedup_finalized",
        "event_relation", "previous_event_id", "days_since_previous", "final_outcome",
    )


@query(
    "A20_decision_and_flag_counts",
    with_registry(
        """SELECT kind, name, count(*) AS n FROM (SELECT 'decision' AS kind, decision AS name FROM adj WHERE reason = ''
        UNION ALL SELECT 'flag', unnest(flags) FROM adj WHERE reason = '') GROUP BY ALL""",
        *_ADJ,
    ),
)
def decision_counts(spark, sf):
    rows = adjudicated(spark, sf).filter("candidate_present = 1")
    decisions = audit.count_by(rows, "decision").select(F.lit("decision").alias("kind"), F.col("decision").alias("name"), "n")
    flags = audit.flag_counts(rows).select(F.lit("flag").alias("kind"), F.col("flag").alias("name"), "n")
    return decisions.unionByName(flags)


@query("T03_pending_queue", with_registry("SELECT event_id FROM adj WHERE decision = 'pending_review'", *_ADJ))
def pending(spark, sf):
    return adjudicated(spark, sf).filter("decision = 'pending_review'").select("event_id")


@query("V04_adjudication_invariants", with_registry("SELECT event_id FROM registry WHERE source_row % 71 = 0 OR source_row % 73 = 0"))
def adjudication_invariants(spark, sf):
    """Included rows that aren't eligible, and pending ones that are settled, are planted by the source row."""
    row = F.col("source_row")
    rows = adjudicated(spark, sf)
    rows = rows.withColumn("decision", F.when(row % 71 == 0, "included").when(row % 73 == 0, "pending_review").otherwise(F.col("decision")))
    rows = rows.withColumn("eligible", F.when((row % 71 == 0) | (row % 73 == 0), 0).otherwise(F.col("eligible")))
    return validate.adjudication_violations(rows).select("event_id")


def scope(spark, sf):
    return registry.two_group_scope(adjudicated(spark, sf).drop("year"), events(spark, sf))


_SCOPE = """CASE WHEN icd_prefix IN ('I20','I21','I22','I46') THEN 'CVD' ELSE 'CBVD' END"""
_SUBTYPE = """CASE icd_prefix WHEN 'I21' THEN 'MI' WHEN 'I22' THEN 'MI' WHEN 'I20' THEN 'ANGINA' WHEN 'I63' THEN 'IS'
 WHEN 'I61' THEN 'ICH' WHEN 'I60' THEN 'SAH' END"""


@query(
    "P14_P15_P16_J07_scopes",
    with_registry(
        f"""SELECT event_id, {_SCOPE} AS study_group, {_SUBTYPE} AS subtype,
        coalesce(canonical_person_id, person_id) AS cluster_id,
        cast(decision = 'included' AS integer) AS strict_event_approved
        FROM adj WHERE reason = '' AND {_SUBTYPE} IS NOT NULL""",
        *_ADJ,
    ),
)
def scopes(spark, sf):
    broad = scope(spark, sf)
    sub = registry.subtype_scope(broad.withColumnRenamed("study_group", "broad").withColumn("study_group", F.lit("")))
    return sub.select(
        "event_id", F.col("broad").alias("study_group"), F.col("study_group").alias("subtype"),
        registry.cluster_id().alias("cluster_id"), "strict_event_approved",
    )


@query(
    "A20_status_table",
    with_registry(
        f"""SELECT {_SCOPE} AS study_group, icd_prefix, year, decision, count(*) AS n FROM adj WHERE reason = '' GROUP BY ALL""",
        *_ADJ,
    ),
)
def status_table(spark, sf):
    return audit.count_by(scope(spark, sf), "study_group", "icd_prefix", "year", "decision")


# ---------------------------------------------------------------- surveillance


def coded(spark, sf):
    return events(spark, sf).withColumn("outcome_id", tx.outcome(F.col("icd10"))).filter("outcome_id <> ''")


_CODED = f"coded AS (SELECT * FROM (SELECT *, {_OUTCOME} AS outcome_id FROM ev) WHERE outcome_id <> '')"
_DAILY = """daily AS (SELECT k.outcome_id, g.d AS onset, count(c.event_id) AS n
 FROM (SELECT DISTINCT outcome_id FROM coded) k
 CROSS JOIN (SELECT cast(unnest(generate_series(date '1995-01-01', date '2001-12-31', interval 1 day)) AS date) AS d) g
 LEFT JOIN coded c ON c.outcome_id = k.outcome_id AND c.onset = g.d GROUP BY 1, 2)"""


def daily_counts(spark, sf):
    return audit.dense_daily(coded(spark, sf), ["outcome_id"], "onset", "1995-01-01", "2001-12-31")


@query(
    "J22_A11_daily_grid",
    with_registry("SELECT outcome_id, cast(onset AS varchar) AS onset, n FROM daily", _CODED, _DAILY),
)
def daily_grid(spark, sf):
    return daily_counts(spark, sf).withColumn("onset", day("onset"))


@query(
    "A11_monthly_counts",
    with_registry(
        "SELECT outcome_id, strftime(onset, '%Y-%m') AS month, cast(sum(n) AS bigint) AS n FROM daily GROUP BY ALL",
        _CODED,
        _DAILY,
    ),
)
def monthly_counts(spark, sf):
    return audit.monthly(daily_counts(spark, sf), ["outcome_id"], "onset")


@query(
    "A13_A35_outcome_year_pivot",
    with_registry(
        f"""SELECT r AS row_order, o AS outcome_id, {", ".join(f"count(*) FILTER (year = {y}) AS y{y}" for y in YEARS)},
        count(year) AS total
        FROM (VALUES (0, 'I63'), (1, 'AMI'), (2, 'I20_0'), (3, 'I61'), (4, 'I60')) t(r, o)
        LEFT JOIN coded ON outcome_id = o GROUP BY 1, 2""",
        _CODED,
    ),
)
def pivot(spark, sf):
    return audit.outcome_year_pivot(
        coded(spark, sf), "outcome_id", "year", YEARS, list(tx.OUTCOME_PREFIXES)
    )


@query(
    "A13_coding_consistency",
    with_registry(
        f"""SELECT year, outcome AS proposed_outcome, {_CLINICAL} AS clinical_review_flag, count(*) AS n
        FROM (SELECT *, {_OUTCOME} AS outcome FROM ev) GROUP BY ALL"""
    ),
)
def coding_consistency(spark, sf):
    return audit.count_by(registry.outcome_annotations(events(spark, sf)), "year", "proposed_outcome", "clinical_review_flag")


_DELAY = "datediff('day', onset, report_date)"


@query(
    "A14_timing_summary",
    with_registry(
        f"""SELECT source_year, count(*) AS n, count(*) FILTER (onset IS NULL) AS onset_missing,
        count(*) FILTER (report_date IS NULL) AS report_missing, count(*) FILTER ({_DELAY} < 0) AS report_before_onset,
        count(*) FILTER (diagnosis_date < onset) AS diagnosis_before_onset,
        round(quantile_cont({_DELAY}, 0.5), 4) AS report_delay_median, round(quantile_cont({_DELAY}, 0.95), 4) AS report_delay_p95,
        max({_DELAY}) AS report_delay_max, count(*) FILTER ({_DELAY} > 30) AS report_delay_over30,
        count(*) FILTER ({_DELAY} > 90) AS report_delay_over90,
        count(*) FILTER (onset = diagnosis_date AND onset = report_date) AS onset_diagnosis_report_identical
        FROM registry GROUP BY 1"""
    ),
)
def timing(spark, sf):
    out = audit.timing_summary(records(spark, sf), ["source_year"])
    return out.withColumn("report_delay_median", F.round("report_delay_median", 4)).withColumn(
        "report_delay_p95", F.round("report_delay_p95", 4)
    )


@query(
    "A15_report_days",
    with_registry(
        f"""SELECT cast(report_date AS varchar) AS report_date, count(*) AS n, count(*) FILTER ({_DELAY} > 30) AS late_over30,
        count(*) FILTER ({_DELAY} > 90) AS late_over90, round(quantile_cont({_DELAY}, 0.5), 4) AS delay_median,
        round(quantile_cont({_DELAY}, 0.95), 4) AS delay_p95 FROM registry WHERE report_date IS NOT NULL GROUP BY 1"""
    ),
)
def report_profile(spark, sf):
    out = audit.report_days(records(spark, sf))
    return out.select(
        day("report_date"), "n", "late_over30", "late_over90",
        F.round("delay_median", 4).alias("delay_median"), F.round("delay_p95", 4).alias("delay_p95"),
    )


@query(
    "A16_onset_spikes",
    with_registry(
        """SELECT d.outcome_id, cast(d.onset AS varchar) AS onset, d.n, round(t.threshold, 4) AS threshold FROM daily d JOIN (
        SELECT outcome_id, y, greatest(2.0, 3 * med, med + 6 * 1.4826 * median(abs(n - med))) AS threshold FROM (
          SELECT outcome_id, year(onset) AS y, n, median(n) OVER (PARTITION BY outcome_id, year(onset)) AS med FROM daily)
        GROUP BY outcome_id, y, med) t ON t.outcome_id = d.outcome_id AND t.y = year(d.onset) AND d.n > t.threshold""",
        _CODED,
        _DAILY,
    ),
)
def spikes(spark, sf):
    out = audit.onset_spikes(daily_counts(spark, sf), ["outcome_id"], "onset", floor=2.0)
    return out.select("outcome_id", day("onset"), "n", F.round("threshold", 4).alias("threshold"))


@query(
    "A17_late_batches",
    with_registry(
        f"""SELECT cast(report_date AS varchar) AS report_date, count(*) AS n FROM registry
        WHERE {_DELAY} > 30 GROUP BY 1 HAVING count(*) >= 5"""
    ),
)
def batches(spark, sf):
    return audit.late_batches(records(spark, sf), least=5).select(day("report_date"), "n")


@query(
    "A18_report_spikes",
    with_registry(
        """SELECT cast(k.report_date AS varchar) AS report_date, k.n, k.late AS late_over30, round(t.threshold, 4) AS threshold
        FROM known k JOIN (SELECT y, greatest(2.0, med + 6 * 1.4826 * median(abs(n - med))) AS threshold FROM (
          SELECT y, n, median(n) OVER (PARTITION BY y) AS med FROM filled) GROUP BY y, med) t
        ON t.y = year(k.report_date) AND k.n > t.threshold AND k.late >= 2 AND k.late / k.n >= 0.75""",
        f"""late AS (SELECT * REPLACE (CASE WHEN source_row % 20 = 0 THEN make_date(source_year + 1, 2, 3) ELSE report_date END AS report_date) FROM registry),
        known AS (SELECT report_date, count(*) AS n, count(*) FILTER ({_DELAY} > 30) AS late FROM late
        WHERE report_date <= date '2001-06-30' GROUP BY 1)""",
        """filled AS (SELECT e.y, g.d, coalesce(k.n, 0) AS n FROM
        (SELECT year(report_date) AS y, max(report_date) AS last FROM known GROUP BY 1) e
        CROSS JOIN LATERAL (SELECT cast(unnest(generate_series(make_date(e.y, 1, 1), e.last, interval 1 day)) AS date) AS d) g
        LEFT JOIN known k ON k.report_date = g.d)""",
    ),
)
def report_spike_days(spark, sf):
    # One day of each year gets a twentieth of the year before, as when a backlog is entered.
    backlog = F.col("source_row") % 20 == 0
    rows = records(spark, sf).withColumn("report_date", F.when(backlog, F.make_date(F.col("source_year") + 1, F.lit(2), F.lit(3))).otherwise(F.col("report_date")))
    rows = rows.withColumn("onset_to_report", F.datediff("report_date", "onset"))
    out = audit.report_spikes(audit.report_days(rows), "2001-06-30", floor=2.0, late_floor=2)
    return out.select(day("report_date"), "n", "late_over30", F.round("threshold", 4).alias("threshold"))


_CUTOFFS = {
    1995: "1995-12-20", 1996: "1996-12-31", 1997: "1998-01-15", 1998: "1998-12-24", 1999: "1999-11-30", 2000: "2001-01-10", 2001: "2001-07-31",
}


@query(
    "A19_after_cutoff",
    with_registry(
        f"""SELECT source_year, cast(cutoff AS varchar) AS cutoff, field, count(*) FILTER (value > cutoff) AS after_extract_cutoff
        FROM (SELECT source_year, CASE source_year {" ".join(f"WHEN {y} THEN date '{d}'" for y, d in _CUTOFFS.items())} END AS cutoff, unnest(['onset','report_date','diagnosis_date']) AS field,
          unnest([onset, report_date, diagnosis_date]) AS value FROM registry)
        WHERE cutoff IS NOT NULL GROUP BY ALL"""
    ),
)
def cutoffs(spark, sf):
    out = audit.after_cutoff(records(spark, sf), "source_year", _CUTOFFS, ["onset", "report_date", "diagnosis_date"])
    return out.withColumn("cutoff", day("cutoff"))


# ---------------------------------------------------------------- sets, queues, contracts


@query("V02_key_uniqueness", with_registry("SELECT event_id, cast(2 AS bigint) AS rows FROM registry WHERE source_row % 113 = 0"))
def uniqueness(spark, sf):
    rows = records(spark, sf)
    return validate.duplicate_keys(rows.unionByName(rows.filter("source_row % 113 = 0")), ["event_id"])


@query(
    "U04_J08_set_operations",
    with_registry(
        """SELECT 'both' AS kind, count(*) AS n FROM (SELECT person_id FROM ev WHERE icd_prefix = 'I21'
          INTERSECT SELECT person_id FROM ev WHERE icd_prefix = 'I63')
        UNION ALL SELECT 'first_only', count(*) FROM (SELECT person_id FROM ev WHERE icd_prefix = 'I21'
          EXCEPT SELECT person_id FROM ev WHERE icd_prefix = 'I63')
        UNION ALL SELECT 'members', count(*) FROM ev WHERE person_id IN (SELECT person_id FROM ev WHERE icd_prefix = 'I63')"""
    ),
)
def set_operations(spark, sf):
    rows = events(spark, sf).select("person_id", "icd_prefix")
    a = rows.filter("icd_prefix = 'I21'").select("person_id")
    b = rows.filter("icd_prefix = 'I63'").select("person_id")
    parts = [
        ("both", a.intersect(b)),
        ("first_only", a.distinct().join(b, "person_id", "left_anti")),
        ("members", rows.join(b, "person_id", "left_semi")),
    ]
    counts = [d.agg(F.lit(k).alias("kind"), audit.n_rows()) for k, d in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "U02_set_equality",
    """SELECT o_orderkey AS key, 'left' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 1)
    UNION ALL SELECT l_orderkey, 'right' FROM lineitem WHERE l_linenumber > 1 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1
    EXCEPT SELECT o_orderkey, 'left' FROM orders WHERE o_orderstatus = 'P'""",
)
def set_equality(spark, sf):
    """Settled orders against orders with a second line: both sides miss some of the other."""
    left = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("key")).distinct()
    right = table(spark, sf, "lineitem").filter("l_linenumber > 1").select(F.col("l_orderkey").alias("key")).distinct()
    return validate.set_difference(left, right)


@query(
    "U01_T05_union_and_queue_head",
    """SELECT kind, id, pending, attempts FROM (SELECT 'order' AS kind, o_orderkey AS id, o_orderpriority AS pending, NULL AS attempts
    FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'event', event_id, NULL, cast(floor(value) AS bigint) FROM events
    WHERE event_type = 'error') ORDER BY kind, id DESC LIMIT 30""",
)
def union_queue(spark, sf):
    orders = table(spark, sf, "orders").filter("o_orderstatus = 'P'")
    one = orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("pending"))
    log = table(spark, sf, "events").filter("event_type = 'error'")
    two = log.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.floor("value").alias("attempts"))
    return one.unionByName(two, allowMissingColumns=True).orderBy("kind", F.desc("id")).limit(30)


@query(
    "J09_exclude_flagged_dates",
    with_registry(
        """SELECT event_id FROM ev WHERE onset NOT IN (SELECT onset FROM ev GROUP BY 1 HAVING count(*) >= 4)"""
    ),
)
def exclude_dates(spark, sf):
    rows = events(spark, sf).select("event_id", "onset")
    busy = audit.count_by(rows, "onset").filter("n >= 4").select("onset")
    return rows.join(busy, "onset", "left_anti").select("event_id")


@query(
    "W13_benjamini_hochberg",
    """WITH t AS (SELECT o_orderkey AS id, o_orderpriority AS family, (o_orderkey * 7919 % 100003 + 1) / 100004e0 AS p FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS rn, count(*) OVER (PARTITION BY family) AS m FROM t)
    SELECT id, family, round(least(1.0, min(m * p / rn) OVER (PARTITION BY family ORDER BY rn
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS q FROM r""",
)
def bh(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("family"),
        F.expr("(o_orderkey * 7919 % 100003 + 1) / 100004e0").alias("p"),
    )
    return benjamini_hochberg(rows, ["family"], "p", "id").select("id", "family", F.round("q", 8).alias("q"))


_MARKED = (
    *_ADJ,
    f"""sc AS (SELECT *, coalesce(canonical_person_id, person_id) AS cl, {_SCOPE} AS study_group,
      array_to_string(flags, ';') AS rf, decision = 'included' AS strict, age % 3 = 0 AS imputed, age % 2 = 0 AS core, age % 5 = 0 AS coarse
      FROM adj WHERE reason = '')""",
    "busy AS (SELECT onset FROM sc GROUP BY 1 HAVING count(*) >= 6)",
    "fr AS (SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY cl, study_group ORDER BY onset, event_id) AS r FROM sc) WHERE r = 1)",
    *_episodes("cl, icd_prefix", "sc"),
    """ao AS (SELECT min(c.event_id) AS event_id FROM spans s JOIN sc c ON c.cl = s.cl AND c.icd_prefix = s.icd_prefix
      AND c.onset = s.anchor GROUP BY s.cl, s.icd_prefix, s.anchor)""",
)
_SAMPLES = {
    "all_registry_all_coordinates": "true",
    "no_imputed_coordinates": "NOT imputed",
    "core_addresses": "core",
    "core_plus_coarse_addresses": "core OR coarse",
    "final_review_only": "review_status = '已终审'",
    "strict_previous_adjudication": "strict",
    "identity_consistent": "NOT regexp_matches(rf, 'IDENTITY_|CANONICAL_ID_LINK_CHANGE')",
    "no_duplicate_interval_flags": "NOT regexp_matches(rf, 'SOURCE_DUPLICATE_|SAME_PREFIX_WITHIN28|CROSS_PREFIX_WITHIN28|DUPLICATE_CARD')",
    "first_person_group_record": "event_id IN (SELECT event_id FROM fr)",
    "anchored28_ICD3_scenario": "event_id IN (SELECT event_id FROM ao)",
    "acute_code_restriction": "CASE WHEN study_group = 'CVD' THEN icd_prefix IN ('I21','I22') OR icd10 LIKE 'I20.0%' "
    "ELSE icd_prefix IN ('I60','I61','I63') END",
    "exclude_flagged_onset_dates": "onset NOT IN (SELECT onset FROM busy)",
    "strict_event_core_address": "strict AND core",
    "strict_event_core_plus_coarse": "strict AND (core OR coarse)",
}


@query(
    "P09_P13_A33_J09_sample_flow",
    with_registry(
        " UNION ALL ".join(
            f"SELECT study_group, '{name}' AS scenario, count(*) AS candidate_events FROM sc WHERE {rule} GROUP BY 1"
            for name, rule in _SAMPLES.items()
        ),
        *_MARKED,
        recursive=True,
    ),
)
def sample_flow(spark, sf):
    rows = scope(spark, sf).withColumns(
        {
            "coordinate_imputed": (F.col("age") % 3 == 0).cast("int"),
            "sensitivity_core_eligible": (F.col("age") % 2 == 0).cast("int"),
            "sensitivity_coarse_eligible": (F.col("age") % 5 == 0).cast("int"),
        }
    )
    busy = audit.count_by(rows, "onset").filter("n >= 6").select(F.col("onset").alias("date"))
    marked = registry.with_selection_marks(rows, busy)
    return registry.sample_flow(registry.with_scenarios(marked))
