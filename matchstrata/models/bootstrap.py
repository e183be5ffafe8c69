"""Year-stratified month-block bootstrap with all draws advancing together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchstrata.core import collect_bounded
from matchstrata.models import clogit
from matchstrata.models.clogit import Fit, ModelSpec
from matchstrata.models.strata import StrataTable, read_batches

MAX_MONTHS = 2400


def draw_table(months: DataFrame, draws: int = 200, seed: int = 20261003) -> DataFrame:
    """(draw, month, freq): per year as many months drawn with replacement as it has.

    Each pick is taken from the md5 of "seed:draw:year:slot", so any task, and any other system, computes the same draw.
    """
    spark = months.sparkSession
    names = sorted(r[0] for r in collect_bounded(months.select("month").distinct(), MAX_MONTHS, "months"))
    by_year: dict[str, list[str]] = {}
    for m in names:
        by_year.setdefault(m[:4], []).append(m)
    years = F.array(
        *[
            F.struct(F.lit(y).alias("year"), F.array(*[F.lit(m) for m in ms]).alias("months"))
            for y, ms in by_year.items()
        ]
    )
    slots = (
        spark.range(draws)
        .select(F.col("id").cast("int").alias("draw"), F.explode(years).alias("y"))
        .select("draw", "y.year", "y.months", F.explode(F.sequence(F.lit(0), F.size("y.months") - 1)).alias("slot"))
    )
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), "year", F.col("slot").cast("string")))
    pick = F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.size("months").cast("long")).cast("int")
    return slots.groupBy("draw", F.get("months", pick).alias("month")).agg(F.count(F.lit(1)).alias("freq"))


def _weights(draws: DataFrame) -> tuple[np.ndarray, list[str]]:
    rows = collect_bounded(draws.select("draw", "month", "freq"), 2_000_000, "draw table")
    months = sorted({r["month"] for r in rows})
    at = {m: i for i, m in enumerate(months)}
    w = np.zeros((1 + max(r["draw"] for r in rows), len(months)))
    for r in rows:
        w[r["draw"], at[r["month"]]] = r["freq"]
    return w, months


#: Strata that all draws go through at once.
STRATA = 1024


def _draw_sums(d: np.ndarray, beta: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(log-likelihood, score, information) of each draw; d is (strata, dates, terms), beta (draws, terms), w (strata, draws)."""
    m, n, k = d.shape
    flat = d.reshape(m * n, k)
    eta = (flat @ beta.T).reshape(m, n, -1)
    top = eta.max(axis=1)
    p = np.exp(eta - top[:, None])
    total = p.sum(axis=1)
    loglik = np.where(w > 0, w * -(top + np.log(total)), 0.0).sum(axis=0)
    p /= total[:, None]
    mean = np.matmul(p.transpose(0, 2, 1), d)
    p *= w[:, None]
    score = -(p.reshape(m * n, -1).T @ flat)
    i, j = np.triu_indices(k)
    info = np.empty((len(beta), k, k))
    info[:, i, j] = info[:, j, i] = p.reshape(m * n, -1).T @ (flat[:, i] * flat[:, j])
    mean = np.ascontiguousarray((mean * np.sqrt(w)[:, :, None]).transpose(1, 0, 2))
    info -= np.matmul(mean.transpose(0, 2, 1), mean)
    return np.concatenate([loglik[:, None], score, info.reshape(len(beta), -1)], axis=1)


def _weighted_sums(spec: ModelSpec, betas: dict[int, np.ndarray], weights, months, table: StrataTable):
    """Weighted Newton sums of every active draw; strata of one month share a weight."""
    at = {m: i for i, m in enumerate(months)}
    cols, scen, needed, k = table.columns, table.scenarios, spec.needed(), len(spec.terms)
    beta = np.array(list(betas.values()))
    drawn = np.column_stack([weights[list(betas)], np.zeros(len(betas))]).T  # by month; the last row is of months in no draw

    def run(batches):
        import pyarrow as pa

        acc = np.zeros((len(betas), 1 + k + k * k))
        for batch in read_batches(batches, cols, needed):
            for block in batch.blocks:
                _, whole = clogit._selection(block, spec, scen)
                if not whole.any():
                    continue
                d = clogit._design(block, whole, spec)
                month = np.array([at.get(m, -1) for m in block.month[whole]])
                times = block.weight[whole]
                for i in range(0, len(d), STRATA):
                    some = slice(i, i + STRATA)
                    acc += _draw_sums(d[some], beta, drawn[month[some]] * times[some, None])
        yield pa.RecordBatch.from_arrays(
            [pa.array([str(b) for b in betas]), pa.array(acc.tolist(), pa.list_(pa.float64()))],
            ["model_id", "v"],
        )

    return run


def bootstrap_fits(table: StrataTable, base: Fit, draws: DataFrame) -> dict[int, float | None]:
    """Log OR of the target per draw; None where the draw did not converge.

    A block drawn f times enters with weight f, which equals f cloned copies of its strata.
    Every pass advances all unfinished draws from the base estimate.
    """
    weights, months = _weights(draws)
    spec, k = base.spec, len(base.spec.terms)
    beta = {b: base.beta.copy() for b in range(len(weights))}
    last = {b: None for b in beta}
    step = {b: np.zeros(k) for b in beta}
    out: dict[int, float | None] = {}
    target = base.index(spec.target)
    pool = table.pooled(spec.needed(), [] if spec.scenario is None else [spec.scenario])
    for _ in range(clogit.MAX_ITERATIONS):
        active = {b: beta[b] for b in beta if b not in out}
        if not active:
            break
        job = pool.scan(spec.needed()).mapInArrow(
            _weighted_sums(spec, active, weights, months, pool), "model_id string, v array<double>"
        )
        sums = clogit._collect_sums(job)
        for b in active:
            v = sums[str(b)]
            ll, score, info = v[0], v[1 : 1 + k], v[1 + k :].reshape(k, k)
            kept = clogit._independent(info)
            if not np.isfinite(ll) or not kept[target]:
                out[b] = None
                continue
            if last[b] is not None and ll < last[b] and abs(1 - last[b] / ll) > clogit.TOLERANCE:
                step[b] = step[b] / 2
                beta[b] = beta[b] - step[b]
                continue
            if last[b] is not None and abs(1 - last[b] / ll) <= clogit.TOLERANCE:
                out[b] = float(beta[b][target])
                continue
            last[b] = ll
            step[b] = clogit._solve(info, score, kept)
            beta[b] = beta[b] + step[b]
    return {b: out.get(b) for b in beta}


def bootstrap_interval(draw_log_or: dict[int, float | None]) -> tuple[float | None, float | None, int, int]:
    """(lower, upper, requested, successful): percentile interval if 80% of draws succeeded."""
    good = [v for v in draw_log_or.values() if v is not None and np.isfinite(v)]
    asked = len(draw_log_or)
    if len(good) < 0.8 * asked:
        return None, None, asked, len(good)
    lo, hi = np.exp(np.quantile(good, [0.025, 0.975]))
    return float(lo), float(hi), asked, len(good)


def draws_frame(spark: SparkSession, draw_log_or: dict[int, float | None]) -> DataFrame:
    return spark.createDataFrame(sorted(draw_log_or.items()), "draw int, log_or double")
