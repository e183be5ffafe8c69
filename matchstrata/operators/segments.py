"""Ordered per-key work that does not put one key into one task.

A plain window sends all rows of a key to one task. Here rows are range-partitioned on
(key, order) first, so a hot key is split over several segments. Each segment is windowed on
its own, and only keys that lie across a segment border (at most two per segment) pass
a small carry row on to the next segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchstrata.core import partitions, stable

SEG = "__seg"


class Segmented:
    """Rows split in (keys, order) order; ``order`` must make rows distinct per key."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], parts: int | None = None):
        self.keys, self.order = list(keys), list(order)
        parts = parts or partitions(df.sparkSession)
        ranged = df.repartitionByRange(parts, *[F.col(c) for c in self.keys + self.order])
        # The segment number must stay the same for every reader, hence the checkpoint.
        self.df = stable(ranged.withColumn(SEG, F.spark_partition_id()))

    @property
    def _window(self):
        return Window.partitionBy(SEG, *self.keys).orderBy(*self.order)

    def _border_keys(self) -> DataFrame:
        """(key, segment) pairs of keys found in several segments: at most 2 per segment."""
        if not self.keys:
            return self.df.groupBy(SEG).agg(F.count(F.lit(1)).alias("__n")).drop("__n")
        key = F.struct(*self.keys)
        ends = self.df.groupBy(SEG).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
        pairs = ends.select(SEG, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("k"))
        spans = pairs.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.collect_set(SEG).alias("segs"))
        return spans.filter("n > 1").select("k.*", F.explode("segs").alias(SEG))

    def _carry(self, summary: list[Column], carried: dict[str, Column]) -> DataFrame:
        """Per border (key, segment): value handed over from the segments before it."""
        border = F.broadcast(self._border_keys())
        marked = self._null_safe_join(self.df, border, "left_semi")
        sums = marked.groupBy(SEG, *self.keys).agg(*summary)
        before = Window.partitionBy(*self.keys).orderBy(SEG)
        return sums.select(SEG, *self.keys, *[c.over(before).alias(n) for n, c in carried.items()])

    def _null_safe_join(self, left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        names = [SEG, *self.keys]
        renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in names else F.col(c) for c in right.columns])
        cond = F.lit(True)
        for c in names:
            cond = cond & left[c].eqNullSafe(renamed[f"__r_{c}"])
        joined = left.join(renamed, cond, how)
        return joined.drop(*[f"__r_{c}" for c in names])

    def with_previous(self, cols: list[str], alias: str) -> DataFrame:
        """Add struct ``alias`` with the previous row's ``cols`` of the same key."""
        prev = F.struct(*cols)
        base = self.df.withColumn("__p", F.lag(prev).over(self._window))
        carry = self._carry(
            [F.max_by(prev, F.struct(*self.order)).alias("__last")],
            {"__c": F.lag("__last")},
        )
        out = self._null_safe_join(base, F.broadcast(carry), "left")
        return out.withColumn(alias, F.coalesce("__p", "__c")).drop("__p", "__c", SEG)

    def with_running(self, aggs: dict[str, tuple[str, str]]) -> DataFrame:
        """Add running totals; ``aggs`` maps a name to ('sum'|'min'|'max', column)."""
        upto = self._window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        base = self.df
        summary, carried = [], {}
        for name, (kind, col) in aggs.items():
            fn = getattr(F, kind)
            base = base.withColumn(f"__in_{name}", fn(col).over(upto))
            summary.append(fn(col).alias(f"__s_{name}"))
        before = Window.partitionBy(*self.keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
        border = F.broadcast(self._border_keys())
        sums = self._null_safe_join(self.df, border, "left_semi").groupBy(SEG, *self.keys).agg(*summary)
        carry = sums.select(
            SEG,
            *self.keys,
            *[getattr(F, k)(f"__s_{n}").over(before).alias(f"__c_{n}") for n, (k, _) in aggs.items()],
        )
        out = self._null_safe_join(base, F.broadcast(carry), "left")
        for name, (kind, _) in aggs.items():
            inside, outside = F.col(f"__in_{name}"), F.col(f"__c_{name}")
            if kind == "sum":
                total = inside + F.coalesce(outside, F.lit(0))
            else:
                pick = F.least if kind == "min" else F.greatest
                total = pick(inside, outside)
            out = out.withColumn(name, total).drop(f"__in_{name}", f"__c_{name}")
        return out.drop(SEG)


def ranked_values(df: DataFrame, keys: list[str], value: str, times: str | None = None) -> DataFrame:
    """Distinct (keys, value) with count ``n`` and running count ``upto``; nulls left out. A row counts ``times`` times."""
    rows = F.sum(times) if times else F.count(F.lit(1))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(rows.alias("n"))
    return Segmented(counts, keys, [value]).with_running({"upto": ("sum", "n")})


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], times: str | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per key, with no key gathered into one task.

    The built-in ``percentile`` keeps every distinct value of a group in one buffer, which is
    right for ages or day counts but not for a continuous value over a very large group.
    """
    ranked = ranked_values(df, keys, value, times).withColumn("__one", F.lit(1))
    by = keys or ["__one"]
    totals = ranked.groupBy(*by).agg(F.max("upto").alias("total"))
    if keys:
        cond = [ranked[k].eqNullSafe(totals[k]) for k in keys]
        placed = ranked.join(totals, cond, "inner").select(ranked["*"], totals["total"])
    else:
        placed = ranked.join(F.broadcast(totals), "__one")
    picks = []
    for name, p in probs.items():
        h = (F.col("total") - 1) * F.lit(float(p))
        for tag, pos in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            inside = (F.col("upto") > pos) & (F.col("upto") - F.col("n") <= pos)
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"{name}_{tag}"))
    got = placed.groupBy(*by).agg(F.first("total").alias("total"), *picks)
    out = []
    for name, p in probs.items():
        h = (F.col("total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"{name}_lo").cast("double"), F.col(f"{name}_hi").cast("double")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return got.select(*keys, F.col("total").alias("n"), *out)
