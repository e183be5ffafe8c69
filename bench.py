"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from matchstrata.catalog import load, model_queries
from matchstrata.core import local_session
from matchstrata.models import bootstrap, clogit, grid
from matchstrata.plans import slices

HEADLINE = [
    "J01_W05_W06_J12_P10_exposure_contrast",
    "J02_J12_W05_F32_exposure_rows",
    "F08_F09_F35_identity_checks",
    "P02_greedy_deduplication",
    "P04_P05_P06_J24_adjudication",
    "W01_adjacent_pairs",
    "W03_anchored_episodes",
    "J13_cross_code_cells",
    "A05_age_profile",
    "A16_onset_spikes",
    "A30_spline_parameters",
    "A32_spearman",
    "W08_F30_cross_basis",
    "A23_reference_points",
    "J14_J19_P08_location_audit",
    "A24_leader_clusters",
    "M01_M02_conditional_logistic_fit",
]


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    entries = load()
    # One warm-up so that the first query does not pay for starting the engine.
    slices.exposure_contrast(spark, folder).collect()
    times = {}
    for key in HEADLINE:
        times[key] = timed(lambda k=key: entries[k].run(spark, folder).write.format("noop").mode("overwrite").save())
    # Model work, table preparation and fits apart.
    times["model_table_build"] = timed(lambda: model_queries.full_table(spark, folder))
    table = model_queries.full_table(spark, folder)
    fit = {}
    specs = [grid.single("CVD", "PM25_lag01", model_queries.ADJUST, "CVD")]
    times["adjusted_fit"] = timed(lambda: fit.update(clogit.fit_models(table, specs)))
    every = grid.scenario_grid(model_queries.GROUPS, model_queries.SCENARIOS)
    times["scenario_grid_144_models"] = timed(lambda: clogit.fit_models(table, every))
    draws = bootstrap.draw_table(table.df.select("month"), draws=200)
    times["bootstrap_200_draws"] = timed(lambda: bootstrap.bootstrap_fits(table, fit["CVD"], draws))
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").split("sf")[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
