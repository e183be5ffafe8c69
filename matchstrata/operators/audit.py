"""Counts, profiles and surveillance screens over registry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchstrata.functions import text as tx
from matchstrata.operators import timeline
from matchstrata.operators.segments import ranked_values

MAD_SCALE = 1.4826


def n_rows(alias: str = "n") -> Column:
    return F.count(F.lit(1)).alias(alias)


def count_by(df: DataFrame, *keys, alias: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(n_rows(alias))


def categorical_audit(df: DataFrame, keys: list[str], fields: dict[str, Column], blank: str = "(空)") -> DataFrame:
    """Value counts of several fields in one pass."""
    pairs = [F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in fields.items()]
    long = df.select(*keys, F.explode(F.array(*pairs)).alias("p"))
    value = F.when(F.coalesce("p.value", F.lit("")) == "", blank).otherwise(F.col("p.value"))
    return count_by(long.select(*keys, F.col("p.field").alias("field"), value.alias("value")), *keys, "field", "value")


def conditional_counts(df: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    """Group size plus one conditional count per name."""
    return df.groupBy(*keys).agg(n_rows(), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def multiplicity(df: DataFrame, key: str) -> DataFrame:
    """Histogram of rows per key: how many keys have 1, 2, ... rows."""
    per_key = count_by(df, key, alias="rows_per_key")
    return count_by(per_key, "rows_per_key", alias="keys")


def age_profile(df: DataFrame, group: str, year: str, age: str = "age") -> DataFrame:
    """Age profile per group x year and per group in total, in one grouping-sets pass.

    Ages are small integers, so the exact percentile buffer stays small.
    """
    a = F.col(age)
    return df.groupingSets([[F.col(group), F.col(year)], [F.col(group)]], F.col(group), F.col(year)).agg(
        n_rows(),
        F.avg(a).alias("age_mean"),
        F.stddev_samp(a).alias("age_sd"),
        F.percentile(a, F.lit(0.25)).alias("age_q1"),
        F.percentile(a, F.lit(0.5)).alias("age_median"),
        F.percentile(a, F.lit(0.75)).alias("age_q3"),
        F.min(a).alias("age_min"),
        F.max(a).alias("age_max"),
        F.count_if(F.col("sex") == "男").alias("male_n"),
        F.count_if(F.col("sex") == "女").alias("female_n"),
        F.count_if(~F.col("sex").isin("男", "女")).alias("sex_other_n"),
        F.count_if(a < 65).alias("age18_64_n"),
        F.count_if(a >= 65).alias("age65plus_n"),
        F.count_if(F.col("season") == "暖季").alias("warm_n"),
        F.count_if(F.col("season") == "冷季").alias("cold_n"),
        F.count_if(F.col("review_status") == "已终审").alias("terminal_review_n"),
    ).withColumn(year, F.coalesce(F.col(year).cast("string"), F.lit("合计")))


def inclusion_counts(events: DataFrame, group: str, person: str = "person_id") -> DataFrame:
    """Sample size under alternative inclusion rules.

    One first record exists per person and group, so their number is the number of persons.
    """
    per_person = events.groupBy(group, person).agg(
        n_rows("rows"),
        F.count_if(F.col("review_status") == "已终审").alias("final"),
        F.count_if(F.col("icd10").startswith("I20.0")).alias("i20_0"),
    )
    return per_person.groupBy(group).agg(
        F.sum("rows").alias("all_candidate_n"),
        F.sum("final").alias("terminal_review_only_n"),
        n_rows("first_record_per_person_n"),
        (F.sum("rows") - F.count(F.lit(1))).alias("loss_if_first_only_n"),
        F.sum("i20_0").alias("I20_0_n"),
    )


def date_quality(df: DataFrame, keys: list[str], onset: str, fields: list[str]) -> DataFrame:
    """Missing / before onset / in order, per date field."""
    status = {
        f: F.when(F.col(f).isNull(), "缺失或无效").when(F.col(f) < F.col(onset), "早于发病").otherwise("日期逻辑正常")
        for f in fields
    }
    return categorical_audit(df, keys, status).withColumnRenamed("value", "status")


def treatment_and_address_counts(events: DataFrame) -> DataFrame:
    """Events by angina code and treatment text class, and by detail of the address text (A08); the other table's columns are null."""
    angina = events.filter(F.col("icd10").startswith("I20"))
    treated = count_by(angina, "year", "icd10", tx.treatment_category(F.col("treatment")).alias("treatment_field"))
    detail = tx.address_detail(F.col("addr_community"), F.col("addr_number")).alias("text_detail")
    return treated.unionByName(count_by(events, "year", detail), allowMissingColumns=True)


def interval_bands(events: DataFrame, person: str, code: str, onset: str, event_id: str) -> DataFrame:
    """Adjacent same-person same-code gaps by band.

    The gap of adjacent events is 0 within a day and the day distance across days, so person-days
    suffice: a day with k events adds k-1 zero gaps.
    """
    w = Window.partitionBy(person, code).orderBy(onset)
    days = timeline.event_days(events, [person, code], onset).withColumn(
        "gap", F.datediff(onset, F.lag(onset).over(w))
    )
    gaps = days.select(
        code,
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("gap"), (F.col("day_events") - 1).alias("n")),
                F.struct(F.col("gap"), F.lit(1).cast("long").alias("n")),
            )
        ).alias("g"),
    ).filter("g.gap IS NOT NULL AND g.n > 0")
    return gaps.groupBy(code, tx.gap_band(F.col("g.gap")).alias("interval")).agg(F.sum("g.n").alias("adjacent_pairs"))


def duplicate_groups(df: DataFrame, keys: list[str], differing: dict[str, str]) -> DataFrame:
    """Statistics of key groups with several rows (A10); one row.

    ``min <> max`` tells whether a column differs, with a two-value buffer per group.
    """
    differs = [(F.min(c) != F.max(c)).cast("int").alias(n) for n, c in differing.items()]
    groups = df.groupBy(*keys).agg(n_rows("rows"), *differs).filter("rows > 1")
    return groups.agg(
        n_rows("groups"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_in_groups"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in differing],
    )


def dense_daily(df: DataFrame, keys: list[str], date: str, start: str, end: str, alias: str = "n") -> DataFrame:
    """Zero-filled daily counts per key over a date range.

    The grid is generated by one ``sequence`` per key, and keys are those of the counts.
    """
    counts = df.groupBy(*keys, date).agg(n_rows(alias))
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    grid = counts.select(*keys).distinct().withColumn(date, F.explode(days))
    return grid.join(counts, [*keys, date], "left").fillna(0, [alias])


def monthly(daily: DataFrame, keys: list[str], date: str, alias: str = "n") -> DataFrame:
    return daily.groupBy(*keys, F.date_format(date, "yyyy-MM").alias("month")).agg(F.sum(alias).alias(alias))


def outcome_year_pivot(df: DataFrame, row: str, year: str, years: list[int], rows: list[str]) -> DataFrame:
    """Outcome x year counts with total, rows in a fixed order and zero-filled."""
    wide = df.groupBy(row).pivot(year, years).agg(n_rows())
    order = df.sparkSession.createDataFrame([(i, r) for i, r in enumerate(rows)], f"row_order int, {row} string")
    full = order.join(wide, row, "left").fillna(0)
    total = sum((F.col(str(y)) for y in years[1:]), F.col(str(years[0])))
    return full.select(
        "row_order", row, *[F.col(str(y)).alias(f"y{y}") for y in years], total.alias("total")
    )


def timing_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Delays of report and diagnosis against onset (A14). Delays are day counts."""
    r, d = F.col("onset_to_report"), F.col("onset_to_diagnosis")
    same = (F.col("onset") == F.col("diagnosis_date")) & (F.col("onset") == F.col("report_date"))
    return df.groupBy(*keys).agg(
        n_rows(),
        F.count_if(F.col("onset").isNull()).alias("onset_missing"),
        F.count_if(F.col("report_date").isNull()).alias("report_missing"),
        F.count_if(r < 0).alias("report_before_onset"),
        F.count_if(d < 0).alias("diagnosis_before_onset"),
        F.percentile(r, F.lit(0.5)).alias("report_delay_median"),
        F.percentile(r, F.lit(0.95)).alias("report_delay_p95"),
        F.max(r).alias("report_delay_max"),
        F.count_if(r > 30).alias("report_delay_over30"),
        F.count_if(r > 90).alias("report_delay_over90"),
        F.count_if(same).alias("onset_diagnosis_report_identical"),
    )


def report_days(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Volume and delay profile per report date."""
    r = F.col("onset_to_report")
    return (
        df.filter("report_date IS NOT NULL")
        .groupBy(*keys, "report_date")
        .agg(
            n_rows(),
            F.count_if(r > 30).alias("late_over30"),
            F.count_if(r > 90).alias("late_over90"),
            F.percentile(r, F.lit(0.5)).alias("delay_median"),
            F.percentile(r, F.lit(0.95)).alias("delay_p95"),
        )
    )


def _median_and_mad(daily: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and median absolute deviation per key of a daily series (bounded by days)."""
    med = daily.groupBy(*keys).agg(F.median(value).alias("med"))
    dev = daily.join(med, keys).withColumn("dev", F.abs(F.col(value) - F.col("med")))
    return dev.groupBy(*keys).agg(F.first("med").alias("med"), F.median("dev").alias("mad"))


def onset_spikes(
    daily: DataFrame, keys: list[str], date: str, value: str = "n", floor: float = 20.0
) -> DataFrame:
    """Days above the robust yearly threshold of a zero-filled series."""
    yearly = daily.withColumn("year", F.year(date))
    stats = _median_and_mad(yearly, [*keys, "year"], value)
    threshold = F.greatest(F.lit(float(floor)), F.col("med") * 3, F.col("med") + F.col("mad") * (6 * MAD_SCALE))
    return (
        yearly.join(stats.withColumn("threshold", threshold), [*keys, "year"])
        .filter(F.col(value) > F.col("threshold"))
        .select(*keys, date, value, "threshold")
    )


def late_batches(df: DataFrame, keys: list[str] = (), least: int = 20, late: int = 30) -> DataFrame:
    """Report dates with at least ``least`` records later than ``late`` days."""
    slow = df.filter((F.col("onset_to_report") > late) & F.col("report_date").isNotNull())
    return slow.groupBy(*keys, "report_date").agg(n_rows()).filter(F.col("n") >= least)


def report_spikes(
    per_day: DataFrame, today: str, keys: list[str] = (), floor: float = 100.0, late_floor: int = 100
) -> DataFrame:
    """Report dates above the yearly threshold that are mostly late.

    Each year's series is zero-filled from 1 January to its last report date, capped by 31 December.
    """
    keys = list(keys)
    known = per_day.filter(F.col("report_date") <= F.lit(today).cast("date")).withColumn("year", F.year("report_date"))
    ends = known.groupBy(*keys, "year").agg(F.max("report_date").alias("last"))
    grid = ends.select(
        *keys,
        "year",
        F.explode(F.sequence(F.make_date("year", F.lit(1), F.lit(1)), F.col("last"))).alias("report_date"),
    )
    filled = grid.join(known.select(*keys, "report_date", "n"), [*keys, "report_date"], "left").fillna(0, ["n"])
    stats = _median_and_mad(filled, [*keys, "year"], "n")
    threshold = F.greatest(F.lit(float(floor)), F.col("med") + F.col("mad") * (6 * MAD_SCALE))
    return (
        known.join(stats.withColumn("threshold", threshold), [*keys, "year"])
        .filter(
            (F.col("n") > F.col("threshold"))
            & (F.col("late_over30") >= late_floor)
            & (F.col("late_over30") / F.col("n") >= 0.75)
        )
        .select(*keys, "report_date", "n", "late_over30", "threshold")
    )


def after_cutoff(df: DataFrame, year: str, cutoffs: dict[int, str], fields: list[str]) -> DataFrame:
    """Dates later than the extract cut-off of their source year."""
    limit = None
    for y, d in cutoffs.items():
        step = F.lit(d).cast("date")
        limit = F.when(F.col(year) == y, step) if limit is None else limit.when(F.col(year) == y, step)
    with_limit = df.withColumn("cutoff", limit).filter("cutoff IS NOT NULL")
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]
    long = with_limit.select(year, "cutoff", F.explode(F.array(*pairs)).alias("p"))
    return long.groupBy(year, "cutoff", F.col("p.field").alias("field")).agg(
        F.count_if(F.col("p.value") > F.col("cutoff")).alias("after_extract_cutoff")
    )


def flag_counts(adjudication: DataFrame) -> DataFrame:
    """Non-exclusive review flag counts."""
    return count_by(adjudication.select(F.explode("review_flags").alias("flag")), "flag")


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, value) -> average rank among equal values, ranks from 1."""
    ranked = ranked_values(df, keys, value)
    return ranked.select(*keys, value, (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias(name))


def spearman(df: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """Rank correlation on pairwise complete rows.

    Rows are counted per value pair before ranks are attached, so repeated pairs are joined once.
    """
    complete = df.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    pairs = complete.groupBy(*keys, first, second).agg(n_rows("w"))
    r1, r2 = average_ranks(complete, keys, first, "r1"), average_ranks(complete, keys, second, "r2")
    both = pairs.join(r1, [*keys, first]).join(r2, [*keys, second])
    w, x, y = F.col("w"), F.col("r1"), F.col("r2")
    sums = both.groupBy(*keys).agg(
        F.sum(w).alias("n"),
        F.sum(w * x).alias("sx"),
        F.sum(w * y).alias("sy"),
        F.sum(w * x * x).alias("sxx"),
        F.sum(w * y * y).alias("syy"),
        F.sum(w * x * y).alias("sxy"),
    )
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return sums.select(*keys, "n", (cov / F.sqrt(vx * vy)).alias("spearman_r"))


def spearman_matrix(df: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """Rank correlation of every two of ``variables`` on their pairwise complete rows (A32): (keys, variable1, variable2, n, spearman_r).

    All pairs are columns of one long table, so rows are read once and one pass of ranks serves all pairs.
    """
    pairs = [(a, b) for i, a in enumerate(variables) for b in variables[i + 1 :]]
    both = [F.struct(F.lit(a).alias("variable1"), F.lit(b).alias("variable2"), F.col(a).cast("double").alias("__x"), F.col(b).cast("double").alias("__y")) for a, b in pairs]
    long = df.select(*keys, F.inline(F.array(*both))).where("__x IS NOT NULL AND __y IS NOT NULL")
    return spearman(long, [*keys, "variable1", "variable2"], "__x", "__y")


def autocorrelation(daily: DataFrame, date: str, value: str, max_lag: int = 21, keys: list[str] = ()) -> DataFrame:
    """Autocorrelation of the daily series of each of ``keys`` at row lags 1..max_lag.

    Days are numbered within a series, which the calendar bounds, and each meets its earlier ones by number.
    """
    keys = list(keys)
    every = daily.withColumn("__one", F.lit(0)) if not keys else daily
    by = keys or ["__one"]
    mean = every.groupBy(*by).agg(F.avg(value).alias("__m"))
    named = every.join(mean, by).select(*by, date, (F.col(value) - F.col("__m")).alias("__c"))
    named = named.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(date)))
    earlier = named.select(*by, F.col("__c").alias("__b"), F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag"), "__i").withColumn("__i", F.col("__i") + F.col("lag"))
    whole = named.groupBy(*by).agg(F.sum(F.col("__c") * F.col("__c")).alias("__c0"))
    sums = named.join(earlier, [*by, "__i"]).groupBy(*by, "lag").agg(F.sum(F.col("__c") * F.col("__b")).alias("__s"))
    return sums.join(whole, by).select(*keys, "lag", (F.col("__s") / F.col("__c0")).alias("acf"))
