"""False-discovery control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchstrata.operators.segments import Segmented


def benjamini_hochberg(
    results: DataFrame, family: list[str], p: str, row_id: str, family_size: int | None = None, out: str = "q"
) -> DataFrame:
    """Step-up q-values with an optional fixed family size.

    q is the running minimum of m * p / rank from the largest p down. Non-finite p stay
    without q and out of the ranking.
    """
    usable = results.filter(F.col(p).isNotNull() & ~F.isnan(p)).select(row_id, *family, p)
    counted = usable.withColumn("__one", F.lit(1).cast("long"))
    ranked = Segmented(counted, family, [p, row_id]).with_running({"__rank": ("sum", "__one")})
    if family_size is None:
        size = F.count(F.lit(1)).alias("__m")
        if family:
            ranked = ranked.join(usable.groupBy(*family).agg(size), family)
        else:
            ranked = ranked.withColumn("__m", usable.agg(size).scalar())
    else:
        ranked = ranked.withColumn("__m", F.lit(family_size))
    stepped = ranked.withColumn("__raw", F.col("__m") * F.col(p) / F.col("__rank")).withColumn("__down", -F.col("__rank"))
    lowest = Segmented(stepped, family, ["__down"]).with_running({"__q": ("min", "__raw")})
    q = lowest.select(row_id, F.least(F.lit(1.0), F.col("__q")).alias(out))
    return results.join(q, row_id, "left")
