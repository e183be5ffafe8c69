"""Registry records: typing, screening, greedy de-duplication, scope and adjudication."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchstrata.core import apart, flag, stored
from matchstrata.functions import identity as idf
from matchstrata.functions import text as tx
from matchstrata.operators import timeline
from matchstrata.operators.graph import components

ADDRESS_PARTS = ["addr_province", "addr_city", "addr_district", "addr_street", "addr_community", "addr_number"]
# Prefixes that take part in the 28-day episodes, and the two pair families.
EPISODE_PREFIXES = ["I20", "I21", "I22", "I60", "I61", "I63", "I64"]
PAIR_FAMILIES = {"AMI": ["I21", "I22"], "stroke": ["I60", "I61", "I63", "I64"]}
CITY_NAMES = ["广州", "广州市"]
# Reasons of the screening steps, in order.
REASONS = {
    "onset": "缺失无效或非对应年度发病日期",
    "age": "出生日期缺失或年龄异常",
    "adult": "年龄小于18岁",
    "city": "现住市非广州或缺失",
    "code": "未映射ICD类别",
    "identity": "缺少格式有效的身份证标识（待其他证件链接）",
    "address": "缺少街道及以下现住址",
}
KEPT = "保留候选记录（非最终事件）"
DUP_CARD = "重复报告卡号候选（待复核）"
DUP_EVENT = "同人同日同类重复候选"
FINAL_REVIEW = "已终审"
# Columns that flags, decisions and relations are made of.
JUDGED_BY = [
    "event_id", "person_id", "canonical_person_id", "icd_prefix", "onset", "location_id", "source_year", "source_row",
    "candidate_present", "clinical_review_flag", "proposed_outcome", "linked_tokens", "card_rows", "review_status",
    "duplicate_flag", "first_onset_flag", "id_check", "id_dob_conflict", "id_sex_conflict", "id_numeric_storage",
    "diagnosis_before_onset", "report_before_onset", "chronic_diagnosis_flag",
]


def typed_records(raw: DataFrame, tokens) -> DataFrame:
    """Cleaned, typed and tokenised columns of raw registry rows (F01-F11, F33, F35, F37), with the treatment text of sources that have one."""

    def text(name: str) -> Column:
        return tx.clean_text(F.col(name))

    plain = ["sex", "diagnosis_text", "card_no", "review_status", "duplicate_flag", "first_onset_flag"]
    dates = ["onset", "birth", "report_date", "diagnosis_date"]
    more = [c for c in ["treatment"] if c in raw.columns]
    # Step by step over named columns: what several expressions need is worked out once, by compiled code.
    clean = raw.select(
        "source_year",
        "source_row",
        apart(tx.event_id(F.col("source_year"), F.col("source_row"))).alias("event_id"),
        *[text(c).alias(c) for c in dates],
        *[text(c).alias(c) for c in plain],
        *[F.upper(text(c)).alias(c) for c in ("icd10", "identity")],
        *[text(c).alias(c) for c in [*ADDRESS_PARTS, *more]],
        F.col("identity_is_number").cast("int").alias("id_numeric_storage"),
    )
    clean = clean.withColumns({f"{c}_dashed": tx.dashed(F.col(c)) for c in dates})
    clean = clean.withColumns({c: tx.date_of(F.col(c), F.col(f"{c}_dashed")) for c in dates})
    clean = idf.with_identity(clean, "identity")
    address = F.concat(*[F.col(c) for c in ADDRESS_PARTS])
    idbirth, idsex = F.col("id_class.birth"), F.col("id_class.sex")
    valid = idbirth.isNotNull()
    known = clean.withColumn("icd_prefix", apart(tx.prefix_of(F.col("icd10"))))
    return known.select(
        "source_year",
        "source_row",
        "event_id",
        "onset",
        "birth",
        "report_date",
        "diagnosis_date",
        "sex",
        "diagnosis_text",
        "review_status",
        "duplicate_flag",
        "first_onset_flag",
        "icd10",
        "icd_prefix",
        "id_numeric_storage",
        *ADDRESS_PARTS,
        *more,
        tx.disease(F.col("icd_prefix")).alias("disease"),
        F.year("onset").alias("year"),
        tx.years_between(F.col("birth"), F.col("onset")).alias("age"),
        tx.season(F.col("onset")).alias("season"),
        address.alias("address"),
        (F.col("addr_number") != "").cast("int").alias("has_door_text"),
        (F.col("id_old") | F.col("id_new")).alias("identity_format_ok"),
        F.when(F.col("identity") != "", tokens.token("person:", F.col("identity"))).alias("person_id"),
        tokens.token("location:", address).alias("location_id"),
        F.when(F.col("card_no") != "", tokens.token("card:", F.col("card_no"))).alias("card_token"),
        F.when(valid, tokens.token("canonical_person:", F.col("id_canonical"))).alias(
            "canonical_person_id"
        ),
        F.col("id_class.label").alias("id_check"),
        flag(valid & F.col("birth").isNotNull() & (F.col("birth") != idbirth)).alias("id_dob_conflict"),
        # An unrecorded sex counts as a conflict.
        flag(valid & (F.col("sex") != idsex)).alias("id_sex_conflict"),
        apart(F.datediff("diagnosis_date", "onset")).alias("onset_to_diagnosis"),
        F.datediff("report_date", "onset").alias("onset_to_report"),
        flag(F.col("diagnosis_date") < F.col("onset")).alias("diagnosis_before_onset"),
        flag(F.col("report_date") < F.col("onset")).alias("report_before_onset"),
        tx.chronic_text(F.col("diagnosis_text")).alias("chronic_diagnosis_flag"),
    )


def screening_reason() -> Column:
    """First failing screening rule, '' when all hold."""
    age = F.col("age")
    street_on = F.concat("addr_street", "addr_community", "addr_number")
    return (
        F.when(F.col("onset").isNull() | (F.year("onset") != F.col("source_year")), REASONS["onset"])
        .when(age.isNull() | ~age.between(0, 120), REASONS["age"])
        .when(age < 18, REASONS["adult"])
        .when(~F.col("addr_city").isin(CITY_NAMES), REASONS["city"])
        .when(F.col("disease").isNull(), REASONS["code"])
        .when(~F.col("identity_format_ok"), REASONS["identity"])
        .when(street_on == "", REASONS["address"])
        .otherwise("")
    )


def screen(records: DataFrame) -> DataFrame:
    return records.withColumn("reason", screening_reason())


def join_known(rows: DataFrame, other: DataFrame, keys: list[str], unique: list[str], how: str = "left") -> DataFrame:
    """Left or anti join in which rows with a null key, that match nothing, are dealt out by ``unique`` and not to one task.

    The number that deals them out is a hash of the key for all other rows: a constant would be folded out of the join's keys.
    """
    unknown = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    spread = rows.withColumn("__s", F.when(unknown, F.xxhash64(*unique)).otherwise(F.xxhash64(*keys)))
    return spread.join(other.withColumn("__s", F.xxhash64(*keys)), [*keys, "__s"], how).drop("__s")


#: Rows of a conflict component that one task goes through; a larger one is thinned out by rounds first.
FOLD = 1 << 20


def _round(left: DataFrame, order: list[str], key_sets: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """One round of the greedy rule: the rows that are first in all their key groups, and those that neither lead nor conflict with one that does."""
    cols, place = left.columns, F.struct(*order)
    mine, lead = left, F.lit(True)
    for name, ks in key_sets.items():
        first = left.dropna(subset=ks).groupBy(*ks).agg(F.min(place).alias(f"__f_{name}"))
        mine = join_known(mine, first, ks, order)
        lead = lead & (F.col(f"__f_{name}").isNull() | (F.col(f"__f_{name}") == place))
    marked = stored(mine.withColumn("__keep", lead).select(*cols, "__keep"))
    kept, rest = marked.filter("__keep").select(*cols), marked.filter("NOT __keep").select(*cols)
    for ks in key_sets.values():
        rest = join_known(rest, kept.dropna(subset=ks).select(*ks), ks, order, "left_anti").select(*cols)
    return kept, stored(rest)


def _fold(rows: DataFrame, order: list[str], key_sets: dict[str, list[str]]) -> DataFrame:
    """The rows that the rule keeps, going through each ``component`` in order; a task holds the kept keys of one component."""
    cols = [c for c in rows.columns if c != "component"]
    sets = list(key_sets.values())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, [set() for _ in sets]
        for batch in batches:
            component = batch.column("component").to_pylist()
            keys = [list(zip(*(batch.column(c).to_pylist() for c in ks))) for ks in sets]
            keep = []
            for i, c in enumerate(component):
                if c != now:
                    now, held = c, [set() for _ in sets]
                mine = [(h, k[i]) for h, k in zip(held, keys) if None not in k[i]]
                keep.append(all(k not in h for h, k in mine))
                if keep[-1]:
                    for h, k in mine:
                        h.add(k)
            yield batch.filter(pa.array(keep, pa.bool_())).select(cols)

    return rows.repartition("component").sortWithinPartitions("component", *order).mapInArrow(walk, rows.select(*cols).schema)


def greedy_distinct(rows: DataFrame, order: list[str], key_sets: dict[str, list[str]], label: str = "reason", fold: int = FOLD) -> DataFrame:
    """Order-dependent de-duplication on several keys.

    Going through the rows in ``order``, a row is dropped when any of its keys is held by a kept row; a key with a null
    part never conflicts. ``label`` is '' for kept rows, else the first key set in conflict. A round keeps every row that is first in all its key
    groups and drops what conflicts with these, so that a key of any number of rows is decided at once. What is left falls into
    components of rows that share keys; each is gone through in order by one task, so long chains take no round for each link. A
    component of more than ``fold`` rows goes through another round first.
    """
    keys = sorted({c for ks in key_sets.values() for c in ks})
    cols = list(dict.fromkeys([*order, *keys]))
    place = F.struct(*order)
    every = stored(rows.select(*cols))
    kept, left = _round(every, order, key_sets)
    while not left.isEmpty():
        firsts = [left.dropna(subset=ks).groupBy(*ks).agg(F.min(place).alias("b")) for ks in key_sets.values()]
        edges = [left.dropna(subset=ks).join(first, ks).select(place.alias("a"), "b") for ks, first in zip(key_sets.values(), firsts)]
        found = components(reduce(DataFrame.unionByName, edges))
        placed = left.withColumn("__p", place).join(found, F.col("__p") == F.col("node"), "left")
        # A row that shares no key any more stands alone.
        placed = stored(placed.select(*cols, F.coalesce("component", "__p").alias("component")))
        size = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        large = stored(size.filter(F.col("n") > fold).select("component"))
        kept = kept.unionByName(_fold(placed.join(large, "component", "left_anti").select(*cols, "component"), order, key_sets))
        if large.isEmpty():
            break
        more, left = _round(placed.join(large, "component", "left_semi").select(*cols), order, key_sets)
        kept = kept.unionByName(more)
    kept = stored(kept)
    judged = every
    why = F.lit("")
    for name, ks in reversed(key_sets.items()):
        # A key has at most one kept holder.
        holder = kept.dropna(subset=ks).select(*ks, place.alias(f"__h_{name}"))
        judged = join_known(judged, holder, ks, order)
        why = F.when(F.col(f"__h_{name}") < place, name).otherwise(why)
    return rows.join(judged.select(*order, why.alias(label)), order)


def candidate_events(screened: DataFrame) -> DataFrame:
    """Kept candidate events after screening and greedy de-duplication."""
    passed = screened.filter("reason = ''").drop("reason").withColumn(
        "__card_year", F.when(F.col("card_token").isNotNull(), F.col("source_year"))
    )
    judged = greedy_distinct(
        passed,
        ["source_year", "source_row"],
        {DUP_CARD: ["__card_year", "card_token"], DUP_EVENT: ["person_id", "onset", "disease"]},
    )
    return judged.drop("__card_year")


def held_against_rule(judged: DataFrame) -> DataFrame:
    """Each judged row's ``reason`` and the one that the kept rows before it give it, ``should``."""
    order = ["source_year", "source_row"]
    place = F.struct(*order)
    kept = judged.filter("reason = ''")
    by_card = kept.filter("card_token IS NOT NULL").groupBy("source_year", "card_token").agg(F.min(place).alias("c"))
    by_event = kept.groupBy("person_id", "onset", "disease").agg(F.min(place).alias("e"))
    # Rows without a card match nothing; they are dealt out, or those of a year would meet in one task.
    rows = judged.select(*order, "card_token", "person_id", "onset", "disease", "reason")
    checked = join_known(rows, by_card, ["source_year", "card_token"], order)
    checked = join_known(checked, by_event, ["person_id", "onset", "disease"], order)
    should = F.when(F.col("c") < place, DUP_CARD).when(F.col("e") < place, DUP_EVENT).otherwise("")
    return checked.select("reason", should.alias("should"))


def screening_flow(screened: DataFrame, deduplicated: DataFrame | None = None) -> DataFrame:
    """Counts per year and step: all rows, each exclusion, kept."""
    total = screened.groupBy("source_year").agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.lit("原始非空记录"))
    steps = screened.filter("reason <> ''").select("source_year", F.col("reason").alias("step"))
    kept = deduplicated if deduplicated is not None else screened.filter("reason = ''")
    last = kept.select("source_year", F.when(F.col("reason") == "", KEPT).otherwise(F.col("reason")).alias("step"))
    counts = steps.unionByName(last).groupBy("source_year", "step").agg(F.count(F.lit(1)).alias("n"))
    return total.unionByName(counts)


def location_queue(events: DataFrame) -> DataFrame:
    """One row per location token with blank coordinate fields."""
    blank = [F.lit(None).cast("double").alias(c) for c in ("longitude", "latitude")]
    once = events.groupBy("location_id").agg(
        F.max("address").alias("address"), F.max("has_door_text").alias("has_door_text")
    )
    return once.select("*", *blank, F.lit("").alias("crs"), F.lit("").alias("verified_within_1km"))


def outcome_annotations(events: DataFrame, where: Column | None = None) -> DataFrame:
    """Events with coded outcome and code/text agreement (F10, F12); '' and null outside ``where``."""
    out = tx.outcome(F.col("icd10"))
    note = tx.clinical_flag(out, F.col("diagnosis_text"))
    if where is not None:
        out, note = F.when(where, out).otherwise(""), F.when(where, note)
    return events.withColumns({"clinical_review_flag": note, "proposed_outcome": out})


def pair_family(prefix: Column) -> Column:
    return tx.label_by_prefix(prefix, PAIR_FAMILIES)


def cluster_id() -> Column:
    """Canonical person, else the salted person token."""
    return F.coalesce(F.nullif(F.col("canonical_person_id"), F.lit("")), F.col("person_id"))


def review_flags() -> Column:
    """Independent review conditions as an array, in fixed order."""
    ann = F.col("clinical_review_flag")
    i20 = F.col("proposed_outcome") == "I20_0"
    not_final = F.col("review_status") != FINAL_REVIEW
    rejected = F.col("review_status").contains("不通过")
    rules = [
        ("REVIEW_REJECTED", not_final & rejected),
        ("REVIEW_INCOMPLETE", not_final & ~rejected),
        ("IDENTITY_INVALID", F.col("canonical_person_id").isNull()),
        ("IDENTITY_DOB_CONFLICT", F.col("id_dob_conflict") == 1),
        ("IDENTITY_SEX_CONFLICT", F.col("id_sex_conflict") == 1),
        ("IDENTITY_NUMERIC_STORAGE", F.col("id_numeric_storage") == 1),
        ("CANONICAL_ID_LINK_CHANGE", F.col("linked_tokens") > 1),
        ("DATE_SEQUENCE_CONFLICT", (F.col("diagnosis_before_onset") == 1) | (F.col("report_before_onset") == 1)),
        ("CHRONIC_DIAGNOSIS_REVIEW", F.col("chronic_diagnosis_flag") == 1),
        ("SOURCE_DUPLICATE_FLAG", F.col("duplicate_flag").isin("是", "1", "1.0")),
        ("SOURCE_DUPLICATE_ERROR", F.col("duplicate_flag") == "#NUM!"),
        ("SAME_PREFIX_WITHIN28_REVIEW", F.col("near") == 1),
        ("CROSS_PREFIX_WITHIN28_REVIEW", F.col("cross_near") == 1),
        ("DUPLICATE_CARD_REVIEW", F.col("card_rows") > 1),
        ("CODE_TEXT_CONFLICT", ann == "code_text_conflict"),
        ("ACUTE_ANGINA_TEXT_REVIEW", i20 & ~ann.eqNullSafe(F.lit("unstable_text_agrees"))),
        ("ANGINA_LOCAL_WINDOW_UNCONFIRMED", i20 & (F.col("source_year") > F.col("angina_rule_year")) & (F.col("near") == 1)),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))


def decision() -> Column:
    """Decision from candidate presence, outcome and flags."""
    return (
        F.when(F.col("candidate_present") == 0, "outside_existing_candidate_frame")
        .when(F.col("proposed_outcome") == "", "excluded")
        .when(F.array_contains("flags", "REVIEW_REJECTED"), "excluded")
        .when(F.size("flags") > 0, "pending_review")
        .otherwise("included")
    )


def relation() -> Column:
    """Relation to the person's other events."""
    return (
        F.when(F.col("cross_near") == 1, "cross_subtype_short_interval_pending")
        .when(F.col("near") == 1, "duplicate_or_same_monitoring_episode_pending")
        .when(F.col("previous_event_id").isNotNull(), "new_monitoring_episode_gt28_clinical_recurrence_unconfirmed")
        .when(F.col("canonical_person_id").isNotNull(), "first_observed_same_prefix_record_not_lifetime_first")
        .otherwise("not_classified")
    )


def linked_tokens(records: DataFrame) -> DataFrame:
    """Number of original person tokens per canonical person."""
    pairs = records.filter("canonical_person_id IS NOT NULL").select("canonical_person_id", "person_id").distinct()
    return pairs.groupBy("canonical_person_id").agg(F.count(F.lit(1)).alias("linked_tokens"))


def card_rows(records: DataFrame) -> DataFrame:
    """Rows per (year, card)."""
    return records.filter("card_token IS NOT NULL").groupBy("source_year", "card_token").agg(
        F.count(F.lit(1)).alias("card_rows")
    )


def adjudicate(records: DataFrame, candidate_ids: DataFrame, angina_rule_year: int = 2023) -> DataFrame:
    """Versioned decision per record with flags, relation and episode."""
    ids = candidate_ids.select("event_id").distinct().withColumn("candidate_present", F.lit(1))
    base = records.join(ids, "event_id", "left").withColumn("candidate_present", F.coalesce("candidate_present", F.lit(0)))
    base = outcome_annotations(base, F.col("candidate_present") == 1)
    base = join_known(base, linked_tokens(records), ["canonical_person_id"], ["event_id"])
    base = join_known(base, card_rows(records), ["source_year", "card_token"], ["event_id"])
    base = stored(base.select(*JUDGED_BY))
    person = ["canonical_person_id", "icd_prefix"]
    dated = F.col("canonical_person_id").isNotNull() & F.col("onset").isNotNull()
    slim = base.filter(dated).select("event_id", *person, "onset", "location_id")
    in_episode = slim.filter(F.col("icd_prefix").isin(EPISODE_PREFIXES))
    linked = timeline.with_previous_event(in_episode, person, "onset", "event_id").select(
        "event_id", *person, "onset", F.col("previous.event_id").alias("previous_event_id"), "gap_days"
    )
    days = timeline.near_days(in_episode, person, "onset").join(
        timeline.episode_days(in_episode, person, "onset"), [*person, "onset"]
    )
    linked = linked.join(days, [*person, "onset"]).drop(*person, "onset")
    family = slim.withColumn("family", pair_family(F.col("icd_prefix"))).filter("family IS NOT NULL")
    crossed = timeline.flag_cross_code(
        family, ["canonical_person_id", "family"], "icd_prefix", "onset"
    ).select("event_id", "cross_near")
    out = (
        base.join(linked, "event_id", "left")
        .join(crossed, "event_id", "left")
        .withColumn("angina_rule_year", F.lit(angina_rule_year))
        .withColumn("flags", review_flags())
    )
    out = out.withColumn("decision", decision())
    return out.select(
        "event_id",
        "person_id",
        "canonical_person_id",
        F.when(F.col("decision") == "included", 1).when(F.col("decision") != "pending_review", 0).alias("eligible"),
        "decision",
        F.col("proposed_outcome").alias("final_outcome"),
        F.col("decision").isin("included", "excluded").cast("int").alias("dedup_finalized"),
        F.when(
            F.col("episode").isNotNull(),
            F.concat_ws("|", "canonical_person_id", "icd_prefix", F.format_string("M%07d", F.col("episode"))),
        ).alias("monitoring_episode_id"),
        relation().alias("event_relation"),
        "previous_event_id",
        F.col("gap_days").alias("days_since_previous"),
        "review_status",
        "id_check",
        "id_dob_conflict",
        "id_sex_conflict",
        "id_numeric_storage",
        "first_onset_flag",
        F.col("flags").alias("review_flags"),
        "source_year",
        "source_row",
        "candidate_present",
    )


def two_group_scope(adjudication: DataFrame, events: DataFrame) -> DataFrame:
    """Broad-group scope of all candidates with the strict approval flag."""
    cols = ["event_id", "location_id", "icd10", "icd_prefix", "onset", "age", "sex", "season", "year"]
    strict = (
        (F.col("decision") == "included") & (F.col("eligible") == 1) & (F.col("dedup_finalized") == 1)
    )
    return adjudication.join(events.select(*cols), "event_id").select(
        "*",
        tx.label_by_prefix(F.col("icd_prefix"), tx.BROAD_GROUPS).alias("study_group"),
        F.lit(1).alias("registry_analysis_inclusion"),
        flag(strict).alias("strict_event_approved"),
    )


def subtype_scope(scope: DataFrame) -> DataFrame:
    """Five-subtype relabel; unmapped prefixes leave the scope."""
    return scope.withColumn("study_group", tx.label_by_prefix(F.col("icd_prefix"), tx.SUBTYPES)).filter(
        "study_group IS NOT NULL"
    )


def acute_code(group: Column) -> Column:
    """Acute-code restriction of the broad groups and their subtypes."""
    heart = F.col("icd_prefix").isin("I21", "I22") | F.col("icd10").startswith("I20.0")
    brain = F.col("icd_prefix").isin("I60", "I61", "I63")
    return F.when(group.isin("CVD", "MI", "ANGINA"), heart).otherwise(brain)


def scenario_selectors() -> dict[str, Column]:
    """Named sensitivity samples as predicates; a null predicate leaves the event out."""
    flags = F.coalesce(F.concat_ws(";", "review_flags"), F.lit(""))
    core, coarse = F.col("sensitivity_core_eligible") == 1, F.col("sensitivity_coarse_eligible") == 1
    return {
        "no_imputed_coordinates": F.col("coordinate_imputed") == 0,
        "core_addresses": core,
        "core_plus_coarse_addresses": core | coarse,
        "final_review_only": F.col("review_status") == FINAL_REVIEW,
        "strict_previous_adjudication": F.col("strict_event_approved") == 1,
        "identity_consistent": ~flags.rlike("IDENTITY_|CANONICAL_ID_LINK_CHANGE"),
        "no_duplicate_interval_flags": ~flags.rlike(
            "SOURCE_DUPLICATE_|SAME_PREFIX_WITHIN28|CROSS_PREFIX_WITHIN28|DUPLICATE_CARD"
        ),
        "first_person_group_record": F.col("is_first_record") == 1,
        "anchored28_ICD3_scenario": F.col("is_anchored_record") == 1,
        "acute_code_restriction": acute_code(F.col("study_group")),
        "exclude_flagged_onset_dates": F.col("onset_flagged") == 0,
    }


def joint_selectors() -> dict[str, Column]:
    """Strictly approved events at core, or core and coarse, addresses."""
    strict = F.col("strict_event_approved") == 1
    core, coarse = F.col("sensitivity_core_eligible") == 1, F.col("sensitivity_coarse_eligible") == 1
    return {
        "strict_event_core_address": strict & core,
        "strict_event_core_plus_coarse": strict & (core | coarse),
    }


def with_selection_marks(scope: DataFrame, flagged_dates: DataFrame) -> DataFrame:
    """Add the first-record, anchored-record and flagged-date marks the selectors read."""
    who = scope.withColumn("cluster_id", cluster_id())
    first = timeline.first_records(who, ["cluster_id", "study_group"], "onset", "event_id").select(
        "event_id", F.lit(1).alias("is_first_record")
    )
    anchored = timeline.anchored_first(who, ["cluster_id", "icd_prefix"], "onset", "event_id").select(
        "event_id", F.lit(1).alias("is_anchored_record")
    )
    dates = flagged_dates.select(F.col("date").alias("onset")).distinct().withColumn("onset_flagged", F.lit(1))
    out = who.join(first, "event_id", "left").join(anchored, "event_id", "left").join(dates, "onset", "left")
    return out.fillna(0, ["is_first_record", "is_anchored_record", "onset_flagged"])


def with_scenarios(scope: DataFrame) -> DataFrame:
    """Add ``scenarios``: names of the sensitivity samples an event belongs to."""
    hits = [F.when(c, F.lit(n)) for n, c in {**scenario_selectors(), **joint_selectors()}.items()]
    return scope.withColumn("scenarios", F.array_compact(F.array(*hits)))


def sample_flow(marked: DataFrame) -> DataFrame:
    """Events per outcome and scenario, the full sample included."""
    everyone = F.array(F.lit("all_registry_all_coordinates"))
    rows = marked.select("study_group", "event_id", F.explode(F.concat(everyone, "scenarios")).alias("scenario"))
    return rows.groupBy("study_group", "scenario").agg(F.count_distinct("event_id").alias("candidate_events"))
