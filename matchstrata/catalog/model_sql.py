"""SQL twins of conditional logistic models with any number of terms: Newton steps over lists, and elimination of the dense system.

The twins take every model to be estimable (as all are from sf0.01 on) and give no row for one that isn't.
"""

from __future__ import annotations

from matchstrata.catalog import exposure_queries as eq
from matchstrata.functions import spline
from matchstrata.operators.exposure import POLLUTANTS
from matchstrata.operators.weather import CONFIGS, BasisConfig

_RH = eq._spline_sql("rh_ma03", ["k1", "k2"], "lo", "hi")


def _cross_basis(config: BasisConfig, prefix: str) -> tuple[str, str]:
    """Columns of the temperature spline (``prefix``t0, ...) and of its sums over the lag basis (``prefix``1, ...)."""
    knots = [f"q{config.var_df}_{i}" for i in range(1, config.var_df)]
    parts = eq._spline_sql("temp", knots, "lo", "hi")
    lags = spline.lag_basis(config.lag, config.lag_df)
    sums = [
        " + ".join(f"{float(lags[k, b])!r} * " + (f"{prefix}t{a}" if k == 0 else f"lag({prefix}t{a}, {k}) OVER w") for k in range(config.lag + 1)) + f" AS {prefix}{a * config.lag_df + b + 1}"
        for a in range(config.var_df)
        for b in range(config.lag_df)
    ]
    return ", ".join(f"{c} AS {prefix}t{i}" for i, c in enumerate(parts)), ", ".join(sums)


def _adjust(config: BasisConfig, prefix: str, holiday: str) -> str:
    terms = [f"{prefix}{i}" for i in range(1, config.var_df * config.lag_df + 1)] + ["rh1", "rh2", "rh3", holiday, "cast(dayofmonth(e.date) = 15 AS double)"]
    return "[" + ", ".join(terms) + "]"


_HOLIDAY, _BREAK = "cast(dayofmonth(e.date) <= 3 AS double)", "cast(dayofmonth(e.date) <= 5 AS double)"
_PREFIX = {"main": "cb", "lag14": "sb", "lag28": "lb", "df4": "fb"}
_BASES = {name: _cross_basis(CONFIGS[name], p) for name, p in _PREFIX.items()}


def _weather(configs: list[str]) -> str:
    """Weather terms of the configurations, per grid and day."""
    probs = sorted({(n, i) for c in configs for n in [CONFIGS[c].var_df] for i in range(1, n)})
    return f"""tp AS (SELECT {", ".join(f"quantile_cont(temp, {i}/{n}.0) AS q{n}_{i}" for n, i in probs)}, min(temp) AS lo, max(temp) AS hi FROM rolled),
 tt AS (SELECT weather_grid_id, date, {", ".join(_BASES[c][0] for c in configs)} FROM rolled, tp),
 tc AS (SELECT weather_grid_id, date, {", ".join(_BASES[c][1] for c in configs)} FROM tt WINDOW w AS (PARTITION BY weather_grid_id ORDER BY date)),"""


_LAG01 = ", ".join(f'("{p}_l0" + "{p}_l1") / 2 AS "{p}"' for p in POLLUTANTS) + ", " + ", ".join(f'"PM25_l{k}"' for k in range(8))
def design(configs: list[str]) -> str:
    """``base``: one row per event and date with exposures, sample marks and the adjustment terms of each configuration."""
    lists = [f"{_adjust(CONFIGS[c], _PREFIX[c], _HOLIDAY)} AS {'adjust' if c == 'main' else 'adjust_' + c}" for c in configs]
    return f"""{", ".join(eq.BASE)}, {eq._WEATHER}, {_weather(configs)}
 hp AS (SELECT quantile_cont(rh_ma03, 1/3.0) AS k1, quantile_cont(rh_ma03, 2/3.0) AS k2, min(rh_ma03) AS lo, max(rh_ma03) AS hi FROM rolled),
 hc AS (SELECT weather_grid_id, date, {_RH[0]} AS rh1, {_RH[1]} AS rh2, {_RH[2]} AS rh3 FROM rolled, hp),
 base AS (SELECT e.event_id, e.location_id AS person, CASE WHEN substr(priority, 1, 1) IN ('1', '2') THEN 'CVD' ELSE 'CBVD' END AS grp,
   cast(e.date AS date) AS date, strftime(cast(e.date AS date), '%Y-%m') AS month, e."case" AS c, {_LAG01},
   cast(e.location_id % 3 = 0 AS int) AS age65, CASE WHEN e.location_id % 7 <> 0 THEN e.location_id % 2 END AS male, cast(month(e.date) BETWEEN 4 AND 9 AS int) AS warm,
   {", ".join(lists)}, {_adjust(CONFIGS["main"], "cb", _BREAK)} AS adjust_break
   FROM exposed e LEFT JOIN tc ON tc.weather_grid_id = 'R' || (e.location_id % 5) AND tc.date = e.date
   LEFT JOIN hc ON hc.weather_grid_id = 'R' || (e.location_id % 5) AND hc.date = e.date)"""


DESIGN = design(["main"])


def models(select: str) -> str:
    """``z``: the complete strata of ``select``, rows (model_id, event_id, cluster, c, x, target), x the list of terms."""
    return f"""zr AS ({select}), lost AS (SELECT DISTINCT model_id, event_id FROM zr WHERE len(list_filter(x, lambda v: v IS NULL)) > 0),
 z AS (SELECT * FROM zr ANTI JOIN lost USING (model_id, event_id))"""


def _system(i: int, right: str) -> str:
    """Probabilities, scores and the information at step i, and its elimination with the right-hand sides ``right`` (a list, of u, j and ws)."""
    return f"""r{i} AS (SELECT z.*, b, exp(list_dot_product(x, b)) / sum(exp(list_dot_product(x, b))) OVER (PARTITION BY model_id, event_id) AS p FROM z JOIN b{i} USING (model_id)),
 l{i} AS (SELECT model_id, event_id, cluster, c, p, target, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS j FROM r{i}),
 m{i} AS (SELECT model_id, event_id, cluster, target, j, sum(p * v) AS m, sum(c * v) AS xc FROM l{i} GROUP BY ALL),
 u{i} AS (SELECT model_id, target, j, sum(xc - m) AS u FROM m{i} GROUP BY ALL),
 q{i} AS (SELECT model_id, j, k, sum(p * x[j] * x[k]) AS v FROM (SELECT model_id, p, x, j, unnest(range(1, j + 1)) AS k FROM (SELECT model_id, p, x, unnest(range(1, len(x) + 1)) AS j FROM r{i})) GROUP BY ALL
   UNION ALL SELECT a.model_id, a.j, b.j, -sum(a.m * b.m) FROM m{i} a JOIN m{i} b ON a.model_id = b.model_id AND a.event_id = b.event_id AND b.j <= a.j GROUP BY ALL),
 h{i} AS (SELECT model_id, j, k, sum(v) AS v FROM q{i} GROUP BY ALL),
 s{i} AS (SELECT model_id, j, k, v FROM h{i} UNION ALL SELECT model_id, k, j, v FROM h{i} WHERE j <> k),
 f{i} AS (SELECT model_id, j, list(v ORDER BY k) AS line FROM s{i} GROUP BY ALL),
 a{i} AS (SELECT f.model_id, list(list_concat(line, {right}) ORDER BY j) AS a FROM f{i} f JOIN u{i} USING (model_id, j) JOIN rhs USING (model_id) GROUP BY f.model_id),
 g{i} AS (SELECT model_id, 0 AS s, a FROM a{i} UNION ALL
   SELECT model_id, s + 1, list_transform(a, lambda line, n: CASE WHEN n = s + 1 THEN list_transform(line, lambda v: v / a[s + 1][s + 1])
     ELSE list_transform(line, lambda v, k: v - line[s + 1] * a[s + 1][k] / a[s + 1][s + 1]) END) FROM g{i} WHERE s < len(a))"""


def newton(contrasts: str, rounds: int = 6) -> str:
    """``fit``: the rows of ``contrasts`` (model_id, k, w, ...; k from 1 in each model) with log_or, se, clusters, n_events and varying."""
    steps = [f"cw AS ({contrasts})", "rhs AS (SELECT model_id, list(w ORDER BY k) AS ws FROM cw GROUP BY ALL)"]
    steps.append("b0 AS (SELECT DISTINCT model_id, list_transform(x, lambda v: 0e0) AS b FROM z)")
    for i in range(rounds):
        steps.append(_system(i, "[u]"))
        steps.append(f"b{i + 1} AS (SELECT model_id, list_transform(b, lambda v, k: v + a[k][len(a) + 1]) AS b FROM b{i} JOIN g{i} USING (model_id) WHERE s = len(a))")
    last = rounds
    steps.append(_system(last, "list_transform(ws, lambda w: cast(w[j] AS double))"))
    steps.append(f"con AS (SELECT cw.*, list_transform(a, lambda line: line[len(a) + k]) AS d, list_dot_product(cast(w AS double[]), b) AS log_or FROM cw JOIN g{last} g USING (model_id) JOIN b{last} USING (model_id) WHERE s = len(a))")
    steps.append(f"uc AS (SELECT model_id, cluster, j, sum(xc - m) AS u FROM m{last} GROUP BY ALL)")
    steps.append("meat AS (SELECT con.model_id, con.k, cluster, sum(d[j] * u) AS gu FROM uc JOIN con USING (model_id) GROUP BY ALL)")
    steps.append("rob AS (SELECT model_id, k, sqrt(sum(gu * gu)) AS se, count(*) AS clusters FROM meat GROUP BY ALL)")
    steps.append("per AS (SELECT model_id, event_id, max(x[target]) > min(x[target]) AS moves FROM z GROUP BY model_id, event_id)")
    steps.append("siz AS (SELECT model_id, count(*) AS n_events, count(*) FILTER (moves) AS varying FROM per GROUP BY ALL)")
    steps.append("fit AS (SELECT con.*, se, clusters, n_events, varying FROM con JOIN rob USING (model_id, k) JOIN siz USING (model_id))")
    return ", ".join(steps)


def several(model_id: str, terms: str) -> str:
    """A list of exposure terms and the adjustment."""
    return f"""SELECT {model_id} AS model_id, event_id, date, NULL AS level, person AS cluster, c, 1 AS target, list_concat({terms}, adjust) AS x FROM base"""


def one_hot(size: str, at: str) -> str:
    return f"list_transform(range(1, {size} + 1), lambda j: CASE WHEN j = {at} THEN 1e0 ELSE 0e0 END)"


#: One contrast a model: its target's coefficient.
TARGET = f"SELECT DISTINCT model_id, 1 AS k, {one_hot('len(x)', 'target')} AS w FROM z"


def normal_p(z: str) -> str:
    """Two-sided p of a normal deviate by a series of positive terms."""
    x = f"(abs({z}) / sqrt(2e0))"
    terms = f"list_sum(list_transform(range(0, 160), lambda n: exp(2 * n * ln(2e0) + lgamma(n + 1e0) + (2 * n + 1) * ln({x}) - lgamma(2 * n + 2e0))))"
    return f"(1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * {terms})"


ESTIMATE = """round(exp(log_or), 6) AS odds_ratio, round(exp(log_or - 1.96 * se), 6) AS lower, round(exp(log_or + 1.96 * se), 6) AS upper"""
SHOWN = f"""n_events, varying AS variable_exposure_events, 'estimated' AS status, round(log_or, 6) AS log_or, round(se, 6) AS robust_se, {ESTIMATE}, round({normal_p('log_or / se')}, 6) AS p"""


ROUNDS = 6


def fitted(select: str, shown: str, contrasts: str = TARGET, more: str = "", last: str = "FROM fit", design: str = DESIGN) -> str:
    """Rows of the models of ``select`` (see ``models``); ``more`` are further tables made of ``base``, ``r6`` has the fitted probabilities."""
    return f"WITH RECURSIVE {design}, {more}{models(select)}, {newton(contrasts, ROUNDS)} SELECT {shown} {last}"


def interaction(model_id: str, pollutant: str, modifier: str, where: str = "true") -> str:
    """The exposure, the adjustment and the exposure of those with the modifier, whose value is ``level``."""
    exposed = f'"{pollutant}" / 10'
    return f"""SELECT {model_id} AS model_id, event_id, date, {modifier} AS level, person AS cluster, c, 16 AS target, list_append(list_prepend({exposed}, adjust), "{pollutant}" * {modifier} / 10) AS x FROM base WHERE {where}"""


def single(model_id: str, pollutant: str, cluster: str = "person", where: str = "true", adjust: str = "adjust") -> str:
    return f"""SELECT {model_id} AS model_id, event_id, date, NULL AS level, {cluster} AS cluster, c, 1 AS target, list_prepend("{pollutant}" / 10, {adjust}) AS x FROM base WHERE {where}"""


def spline_terms(x: str, knots: list[str], lo: str, hi: str) -> str:
    return f"[{', '.join(eq._spline_sql(x, knots, lo, hi))}]"
