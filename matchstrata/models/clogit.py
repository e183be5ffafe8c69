"""Conditional logistic regression on matched strata as driver-iterated Spark jobs.

With one case per stratum the exact, Efron and Breslow likelihoods agree. Every Newton step is
one pass over the packed strata: tasks return a few sums per model, the driver solves k x k
systems. All models of a grid advance together, so a pass is shared by all of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchstrata.models.strata import Block, StrataTable, read_batches

MAX_ITERATIONS = 50
TOLERANCE = 1e-9
LEAST_STRATA = 20
Z95 = 1.96


@dataclass(frozen=True)
class Term:
    """Design column: scale x product of table columns."""

    name: str
    columns: tuple[str, ...]
    scale: float = 1.0


@dataclass(frozen=True)
class ModelSpec:
    """One model of a grid."""

    model_id: str
    terms: tuple[Term, ...]
    target: str
    group: str | None = None
    scenario: str | None = None
    also_complete: tuple[str, ...] = ()
    # 'variation' asks for enough strata with varying exposure, 'events' for enough strata.
    gate: str = "variation"
    labels: tuple[tuple[str, str], ...] = ()

    def needed(self) -> list[str]:
        return list(dict.fromkeys([c for t in self.terms for c in t.columns] + list(self.also_complete)))


@dataclass
class Fit:
    """State and outcome of one model."""

    spec: ModelSpec
    beta: np.ndarray
    kept: np.ndarray
    n_before: int = 0
    n_events: int = 0
    n_varying: int = 0
    loglik: float = float("nan")
    info: np.ndarray | None = None
    robust: np.ndarray | None = None
    clusters: int = 0
    iterations: int = 0
    status: str = "running"

    def index(self, name: str) -> int:
        return [t.name for t in self.spec.terms].index(name)

    @property
    def ok(self) -> bool:
        return self.status == "estimated"


# ---------------------------------------------------------------- block arithmetic (in tasks)


def _selection(block: Block, spec: ModelSpec, scenarios: list[str]):
    """(strata of the model's sample, those of them without a missing value)."""
    keep = np.ones(len(block.rows), bool)
    if spec.group is not None:
        keep &= block.group == spec.group
    if spec.scenario is not None:
        keep &= (block.bits & (1 << scenarios.index(spec.scenario))) != 0
    return keep, keep & ~block.missing(spec.needed())


def _design(block: Block, whole: np.ndarray, spec: ModelSpec) -> np.ndarray:
    """(strata, dates, terms), centred on the case row."""
    out = np.empty((int(whole.sum()), block.values[spec.terms[0].columns[0]].shape[1], len(spec.terms)))
    for j, t in enumerate(spec.terms):
        out[:, :, j] = block.term(t.columns, t.scale)[whole]
    return out


def _all_needed(specs) -> list[str]:
    return list(dict.fromkeys(c for s in specs for c in s.needed()))


def _likelihood(d: np.ndarray, beta: np.ndarray):
    """Per-stratum log-likelihood, score and fitted probabilities; d is centred on the case."""
    eta = d @ beta
    top = eta.max(axis=1, keepdims=True)
    e = np.exp(eta - top)
    total = e.sum(axis=1, keepdims=True)
    p = e / total
    mean = np.einsum("mn,mnk->mk", p, d)
    loglik = -(top[:, 0] + np.log(total[:, 0]))
    return loglik, -mean, p


def _by_date(block: Block, whole: np.ndarray, spec: ModelSpec) -> np.ndarray:
    """``_design`` as (terms, dates, strata): sums over dates and products run along whole rows."""
    every = bool(whole.all())
    parts = [block.by_date(t.columns, t.scale) for t in spec.terms]
    out = np.empty((len(parts), parts[0].shape[0], int(whole.sum())))
    for j, v in enumerate(parts):
        out[j] = v if every else v[:, whole]
    return out


def _sums_by_date(d: np.ndarray, beta: np.ndarray):
    """Log-likelihood and score (terms, strata) of each stratum, and d times the fitted probabilities."""
    eta = np.tensordot(beta, d, 1)
    top = eta.max(axis=0)
    e = np.exp(eta - top)
    total = e.sum(axis=0)
    weighted = d * (e / total)
    return -(top + np.log(total)), -weighted.sum(axis=1), weighted


def _newton_sums(specs, betas, table: StrataTable):
    cols, scen, needed = table.columns, table.scenarios, _all_needed(specs)

    def run(batches):
        import pyarrow as pa

        acc = {}
        for batch in read_batches(batches, cols, needed):
            for block in batch.blocks:
                for s in specs:
                    keep, whole = _selection(block, s, scen)
                    if not keep.any():
                        continue
                    k = len(s.terms)
                    w = block.weight[whole]
                    d = _by_date(block, whole, s)
                    ll, score, weighted = _sums_by_date(d, betas[s.model_id])
                    info = (weighted * w).reshape(k, -1) @ d.reshape(k, -1).T - (score * w) @ score.T
                    target = d[[t.name for t in s.terms].index(s.target)]
                    part = np.concatenate(
                        [[block.weight[keep].sum(), w.sum(), w[(target != 0).any(axis=0)].sum(), ll @ w], score @ w, info.ravel()]
                    )
                    acc[s.model_id] = acc.get(s.model_id, np.zeros(4 + k + k * k)) + part
        if acc:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(acc)), pa.array([v.tolist() for v in acc.values()], pa.list_(pa.float64()))],
                ["model_id", "v"],
            )

    return run


def _score_sums(specs, betas, table: StrataTable, key: str, sorted_by_key: bool):
    """Per-cluster score sums. Clusters inside a stretch of consecutive rows are closed there
    ('meat'); only those at its two ends, which may go on elsewhere, are passed on ('edge')."""
    cols, scen, needed = table.columns, table.scenarios, _all_needed(specs)

    def run(batches):
        import pyarrow as pa

        meat = {s.model_id: np.zeros((len(s.terms),) * 2) for s in specs}
        closed = {s.model_id: 0 for s in specs}
        edges: list[tuple[str, str, np.ndarray]] = []
        open_key, open_sum, first, last_pos = None, None, True, None
        loose: dict = {}

        def close(name, sums, at_edge):
            for m, u in sums.items():
                if u is None:
                    continue
                if at_edge:
                    edges.append((m, name, u))
                else:
                    meat[m] += np.outer(u, u)
                    closed[m] += 1

        for batch in read_batches(batches, cols, needed, key):
            names, pos = batch.key, batch.pos
            broken = np.r_[last_pos is None or pos[0] != last_pos + 1, pos[1:] != pos[:-1] + 1]
            last_pos = pos[-1]
            starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]] | broken)
            sums, seen = {}, {}
            for s in specs:
                scores, touched = np.zeros((batch.size, len(s.terms))), np.zeros(batch.size, bool)
                for block in batch.blocks:
                    _, whole = _selection(block, s, scen)
                    if whole.any():
                        _, score, _ = _sums_by_date(_by_date(block, whole, s), betas[s.model_id])
                        scores[block.rows[whole]] = score.T
                        touched[block.rows[whole]] = True
                sums[s.model_id] = np.add.reduceat(scores, starts, axis=0)
                seen[s.model_id] = np.add.reduceat(touched.astype(int), starts) > 0
            if not sorted_by_key:
                number: dict = {}
                code = np.array([number.setdefault(c, len(number)) for c in names[starts]])
                for m in sums:
                    total = np.zeros((len(number), sums[m].shape[1]))
                    np.add.at(total, code, sums[m])
                    some = np.bincount(code, seen[m], len(number)) > 0
                    for c, i in number.items():
                        if some[i]:
                            loose[m, c] = loose.get((m, c), 0.0) + total[i]
                continue
            # Clusters that begin and end inside this batch and stretch are closed at once.
            free = ~broken[starts]
            free[:-1] &= ~broken[starts[1:]]
            free[[0, -1]] = False
            for m in sums:
                inside = sums[m][free & seen[m]]
                meat[m] += inside.T @ inside
                closed[m] += len(inside)
            for i in np.flatnonzero(~free):
                at = starts[i]
                now = {m: (sums[m][i] if seen[m][i] else None) for m in sums}
                if broken[at] and open_key is not None:
                    # A new stretch of rows: what is open may go on in another task.
                    close(open_key, open_sum, True)
                    open_key, first = None, True
                if i and free[i - 1]:
                    close(open_key, open_sum, first)
                    open_key, first = None, False
                if open_key is not None and names[at] == open_key:
                    for m, u in now.items():
                        if u is not None:
                            open_sum[m] = u if open_sum[m] is None else open_sum[m] + u
                    continue
                if open_key is not None:
                    close(open_key, open_sum, first)
                    first = False
                open_key, open_sum = names[at], now
        if open_key is not None:
            close(open_key, open_sum, True)
        edges.extend((m, c, u) for (m, c), u in loose.items())
        kinds, models, keys, values = [], [], [], []
        for m, v in meat.items():
            if closed[m]:
                kinds.append("meat"), models.append(m), keys.append(""), values.append([float(closed[m]), *v.ravel()])
        for m, c, u in edges:
            kinds.append("edge"), models.append(m), keys.append(c), values.append(u.tolist())
        if kinds:
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds), pa.array(models), pa.array(keys), pa.array(values, pa.list_(pa.float64()))],
                ["kind", "model_id", "cluster", "v"],
            )

    return run


def _outer(batches):
    import pyarrow as pa

    for rb in batches:
        v = [np.asarray(u) for u in rb.column("v").to_pylist()]
        if v:
            out = [[1.0, *np.outer(u, u).ravel()] for u in v]
            yield pa.RecordBatch.from_arrays(
                [rb.column("model_id"), pa.array(out, pa.list_(pa.float64()))], ["model_id", "v"]
            )


def _sum_arrays(df: DataFrame, keys: list[str]) -> DataFrame:
    """Element-wise array sums per key, combined map-side."""
    flat = df.select(*keys, F.posexplode("v").alias("i", "e"))
    sums = flat.groupBy(*keys, "i").agg(F.sum("e").alias("e"))
    per_key = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "e"))).alias("s"))
    return per_key.select(*keys, F.transform("s", lambda r: r["e"]).alias("v"))


def _collect_sums(df: DataFrame) -> dict[str, np.ndarray]:
    return {r["model_id"]: np.asarray(r["v"]) for r in _sum_arrays(df, ["model_id"]).collect()}


# ---------------------------------------------------------------- driver side (k x k algebra)


def _independent(info: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """Columns with within-stratum variation that do not repeat earlier ones."""
    k = len(info)
    kept = np.zeros(k, bool)
    scale = np.diag(info).copy()
    for j in range(k):
        if not scale[j] > 0:
            continue
        at = np.flatnonzero(kept)
        left = scale[j]
        if len(at):
            s = np.sqrt(scale[at])
            a = info[np.ix_(at, at)] / np.outer(s, s)
            b = info[at, j] / s
            left = scale[j] - b @ np.linalg.solve(a, b)
        kept[j] = left > tol * scale[j]
    return kept


def _solve(info, score, kept):
    step = np.zeros(len(score))
    at = np.flatnonzero(kept)
    if len(at):
        s = np.sqrt(np.maximum(np.diag(info)[at], 1e-300))
        a = info[np.ix_(at, at)] / np.outer(s, s)
        step[at] = np.linalg.solve(a, score[at] / s) / s
    return step


def _inverse(info, kept):
    k = len(info)
    out = np.zeros((k, k))
    at = np.flatnonzero(kept)
    if len(at):
        s = np.sqrt(np.maximum(np.diag(info)[at], 1e-300))
        out[np.ix_(at, at)] = np.linalg.inv(info[np.ix_(at, at)] / np.outer(s, s)) / np.outer(s, s)
    return out


def fit_models(table: StrataTable, specs: list[ModelSpec], cluster: str = "cluster_id") -> dict[str, Fit]:
    """Fit all models together (M01-M03, M18); robust variance by person or by month."""
    fits = {s.model_id: Fit(s, np.zeros(len(s.terms)), np.ones(len(s.terms), bool)) for s in specs}
    steps = {m: np.zeros(len(f.beta)) for m, f in fits.items()}
    active = list(specs)
    pool = table.pooled(_all_needed(specs), [s.scenario for s in specs if s.scenario is not None])
    for round_no in range(MAX_ITERATIONS + 1):
        betas = {s.model_id: fits[s.model_id].beta for s in active}
        job = pool.scan(_all_needed(active)).mapInArrow(_newton_sums(active, betas, pool), "model_id string, v array<double>")
        sums = _collect_sums(job)
        for s in active:
            f, k = fits[s.model_id], len(s.terms)
            v = sums.get(s.model_id, np.zeros(4 + k + k * k))
            loglik, score, info = v[3], v[4 : 4 + k], v[4 + k :].reshape(k, k)
            if round_no == 0:
                f.n_before, f.n_events, f.n_varying = int(v[0]), int(v[1]), int(v[2])
                f.kept = _independent(info)
                enough = f.n_varying if s.gate == "variation" else f.n_events
                if enough < LEAST_STRATA:
                    f.status = "insufficient_within_stratum_variation"
                    continue
            f.iterations = round_no
            if not np.isfinite(loglik) or not np.isfinite(info).all():
                f.status = "nonconvergence_or_nonfinite"
                continue
            if round_no and loglik < f.loglik and abs(1 - f.loglik / loglik) > TOLERANCE:
                # Step halving towards the last accepted point.
                steps[s.model_id] = steps[s.model_id] / 2
                f.beta = f.beta - steps[s.model_id]
                continue
            settled = round_no and abs(1 - f.loglik / loglik) <= TOLERANCE
            f.loglik, f.info = loglik, info
            if settled or (loglik == 0.0):
                f.status = "converged"
                continue
            try:
                steps[s.model_id] = _solve(info, score, f.kept)
            except np.linalg.LinAlgError:
                f.status = "fit_error"
                continue
            f.beta = f.beta + steps[s.model_id]
        active = [s for s in active if fits[s.model_id].status == "running"]
        if not active:
            break
    for s in active:
        fits[s.model_id].status = "nonconvergence_or_nonfinite"
    done = [s for s in specs if fits[s.model_id].status == "converged"]
    if done:
        _robust_variance(table, done, fits, cluster)
    for s in done:
        f = fits[s.model_id]
        if not f.kept[f.index(s.target)]:
            f.status = "term_not_estimable"
        else:
            se = math.sqrt(max(f.robust[f.index(s.target), f.index(s.target)], 0.0))
            good = np.isfinite(f.beta).all() and np.isfinite(se) and se > 0
            f.status = "estimated" if good else "nonconvergence_or_nonfinite"
    return fits


def _robust_variance(table: StrataTable, specs, fits, cluster: str) -> None:
    betas = {s.model_id: fits[s.model_id].beta for s in specs}
    run = _score_sums(specs, betas, table, cluster, sorted_by_key=cluster == table.cluster)
    parts = table.scan(_all_needed(specs)).mapInArrow(run, "kind string, model_id string, cluster string, v array<double>").persist()
    try:
        edges = _sum_arrays(parts.filter("kind = 'edge'").drop("kind"), ["model_id", "cluster"])
        meat = parts.filter("kind = 'meat'").select("model_id", "v")
        whole = meat.unionByName(edges.select("model_id", "v").mapInArrow(_outer, "model_id string, v array<double>"))
        sums = _collect_sums(whole)
    finally:
        parts.unpersist()
    for s in specs:
        f, k = fits[s.model_id], len(s.terms)
        v = sums[s.model_id]
        bread = _inverse(f.info, f.kept)
        f.clusters = int(v[0])
        f.robust = bread @ v[1:].reshape(k, k) @ bread


# ---------------------------------------------------------------- scoring


def scored(table: StrataTable, fits: dict[str, Fit], carry: dict[str, str] | None = None) -> DataFrame:
    """Fitted probabilities of every row of the complete strata of each estimated model.

    Rows are (model_id, event_id, date, case, prob, carried): the softmax of the linear predictor within the stratum, and the value of
    the model's column in ``carry``. One pass over the packed strata serves all models; nothing is shuffled.
    """
    done = [f for f in fits.values() if f.ok]
    carry = carry or {}
    cols, scen, needed = table.columns, table.scenarios, _all_needed([f.spec for f in done])
    schema = "model_id string, event_id string, date date, case int, prob double, carried double"

    def run(batches):
        import pyarrow as pa

        for rb in batches:
            event = np.asarray(rb.column("event_id").to_pylist(), dtype=object)
            sizes = rb.column("n").to_numpy(zero_copy_only=False)
            first = np.cumsum(sizes) - sizes
            days = rb.column("dates").flatten().to_numpy(zero_copy_only=False)
            for batch in read_batches([rb], cols, needed):
                for block in batch.blocks:
                    for f in done:
                        _, whole = _selection(block, f.spec, scen)
                        if not whole.any():
                            continue
                        d = _design(block, whole, f.spec)
                        *_, p = _likelihood(d, f.beta)
                        at, n = block.rows[whole], d.shape[1]
                        kept = block.values[carry[f.spec.model_id]][whole].ravel() if f.spec.model_id in carry else np.full(p.size, np.nan)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([f.spec.model_id] * p.size), pa.array(np.repeat(event[at], n), pa.string()), pa.array(days[(first[at][:, None] + np.arange(n)).ravel()], pa.date32()),
                                pa.array(np.tile([1] + [0] * (n - 1), len(at)), pa.int32()), pa.array(p.ravel()), pa.array(kept),
                            ],
                            ["model_id", "event_id", "date", "case", "prob", "carried"],
                        )

    every = table.scan(needed, F.col("event_id").cast("string").alias("event_id"), "dates")
    return every.mapInArrow(run, schema)


# ---------------------------------------------------------------- tails and result rows


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def t_p(t: float, df: float) -> float:
    """Two-sided p of Student's t by the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_quantile(p: float, df: float) -> float:
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_p(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def contrast(fit: Fit, terms: list[str], weights) -> list[tuple[float, float, float, float]]:
    """(log OR, OR, lower, upper) of linear combinations of coefficients."""
    at = [fit.index(t) for t in terms]
    b = np.atleast_2d(np.asarray(weights, float))
    eta = b @ fit.beta[at]
    var = np.einsum("ij,jk,ik->i", b, fit.robust[np.ix_(at, at)], b)
    se = np.sqrt(np.maximum(var, 0.0))
    return [(e, math.exp(e), math.exp(e - Z95 * s), math.exp(e + Z95 * s)) for e, s in zip(eta, se)]


RESULT_SCHEMA = (
    "model_id string, term string, n_events long, events_lost_missing long, variable_exposure_events long, "
    "log_or double, robust_se double, odds_ratio double, lower double, upper double, p double, "
    "clusters long, status string"
)


def result_row(fit: Fit, term: str | None = None, use_t: bool = False) -> tuple:
    """One result row; empty estimates unless the model was estimated."""
    term = term or fit.spec.target
    head = (fit.spec.model_id, term, fit.n_events, fit.n_before - fit.n_events, fit.n_varying)
    if not fit.ok:
        return (*head, *[None] * 6, fit.clusters, fit.status)
    i = fit.index(term)
    b, se = float(fit.beta[i]), math.sqrt(max(float(fit.robust[i, i]), 0.0))
    if not se > 0:
        return (*head, *[None] * 6, fit.clusters, "term_not_estimable")
    q = t_quantile(0.975, fit.clusters - 1) if use_t else Z95
    p = t_p(b / se, fit.clusters - 1) if use_t else normal_p(b / se)
    return (*head, b, se, math.exp(b), math.exp(b - q * se), math.exp(b + q * se), p, fit.clusters, fit.status)


def results(spark: SparkSession, fits: dict[str, Fit], use_t: bool = False, all_terms: bool = False) -> DataFrame:
    """Result table, one row per model (or per model and term)."""
    rows = []
    for f in fits.values():
        for t in [t.name for t in f.spec.terms] if all_terms else [None]:
            rows.append(result_row(f, t, use_t))
    return spark.createDataFrame(rows, RESULT_SCHEMA)
