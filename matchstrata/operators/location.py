"""Location candidates: canonical queries, cached responses, selection, audit, tiers, fallbacks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchstrata.core import stable
from matchstrata.functions import address as ad
from matchstrata.functions import geo
from matchstrata.functions.automaton import Patterns
from matchstrata.operators import clusters
from matchstrata.operators.segments import exact_quantiles

CONFLICTS = ["district_conflict", "road_conflict", "house_number_conflict", "building_number_conflict"]
RESPONSE = (
    "status string, geocodes array<struct<location:string, formatted_address:string, adcode:string, level:string>>"
)
# Provider levels of doors, buildings, roads and places.
DOOR_LEVELS = ["门牌号", "门址"]
BUILDING_LEVELS = ["住宅区", "商务住宅", "楼宇"]
SEARCH = "search:"


# ---------------------------------------------------------------- queries and caches


def canonical_queries(rows: DataFrame, location_id: str = "location_id", address: str = "address") -> DataFrame:
    """Link table location -> canonical query, with the canonical address."""
    text = ad.building(ad.normalise(F.col(address)))
    linked = rows.select(location_id, text.alias("canonical_address"))
    return linked.select(
        location_id, F.substring(F.sha2("canonical_address", 256), 1, 24).alias("query_id"), "canonical_address"
    )


def query_table(links: DataFrame) -> DataFrame:
    """One row per canonical query."""
    return links.groupBy("query_id").agg(F.min("canonical_address").alias("address"))


def parse_responses(cache: DataFrame, key: str = "address", response: str = "response", provider: str = "amap") -> DataFrame:
    """Cached JSON responses to one candidate per row, in response order."""
    parsed = cache.select(key, F.from_json(response, RESPONSE).alias("r"))
    rows = parsed.select(key, F.posexplode("r.geocodes").alias("pos", "g"))
    return compact(
        rows.select(
            key, "pos", F.lit(provider).alias("provider"), "g.location", "g.formatted_address", "g.adcode", "g.level"
        )
    )


def explode_ids(rows: DataFrame, ids: str = "ids", out: str = "location_id") -> DataFrame:
    """'|'-joined id lists to one row per id."""
    return rows.withColumn(out, F.explode(F.split(F.col(ids), r"\|"))).drop(ids)


def compact(rows: DataFrame) -> DataFrame:
    """Candidates with a usable point, normalised text and blanks for missing fields."""
    p = geo.parse_point(F.col("location"))
    keep = [c for c in rows.columns if c not in ("location", "formatted_address", "adcode", "level")]
    return rows.select(
        *keep,
        "location",
        p["lon"].alias("lon"),
        p["lat"].alias("lat"),
        ad.normalise(F.coalesce("formatted_address", F.lit(""))).alias("text"),
        F.coalesce("adcode", F.lit("")).alias("adcode"),
        F.coalesce("level", F.lit("")).alias("level"),
    ).filter("lon IS NOT NULL")


@dataclass(frozen=True)
class Pool:
    """Candidates of locations: those of a request once for all locations that make it, those of single locations by location."""

    shared: DataFrame
    own: DataFrame
    links: DataFrame


def candidate_pool(locations: DataFrame, by_address: DataFrame, by_location: DataFrame) -> Pool:
    """Candidates from the address cache, the coarse search and the id lists (J14); ``locations``: location_id, request, address.

    Exact repeats (provider, point, text) count once; the earliest source keeps its place. Locations of one request see the same
    cached candidates, so these stay with the request; ``links`` gives each location's request and address. A location_id
    that comes with several requests or addresses has all its candidates among its own.
    """
    point = ["provider", "lon", "lat", "text"]
    cols = [*point, "adcode", "level", "pos"]
    per = locations.select("location_id", "request", "address").distinct()
    several = per.groupBy("location_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("location_id").alias("__id"))
    twofold = F.col("location_id").eqNullSafe(F.col("__id"))
    links = per.join(several, twofold, "left_anti")
    # A shared address is asked once per provider, point and text, whatever its cached rows repeat.
    rest = F.min(F.struct("pos", "adcode", "level")).alias("r")
    by_address = by_address.groupBy("address", *point).agg(rest).select("address", *point, "r.*")
    asked = per.select("request").distinct()
    coarse = asked.select("request", F.concat(F.lit(SEARCH), ad.coarse_prefix(F.col("request"))).alias("address"))
    first = F.min(F.struct("source", "pos", "adcode", "level")).alias("f")
    seen = [
        asked.withColumn("address", F.col("request")).join(by_address, "address").select("request", F.lit(0).alias("source"), *cols),
        coarse.join(by_address, "address").select("request", F.lit(1).alias("source"), *cols),
    ]
    shared = seen[0].unionByName(seen[1]).groupBy("request", *point).agg(first).select("request", *point, "f.*")
    shared = stable(shared.withColumn("t", ad.profile(F.col("text"))))
    mixed = per.join(several, twofold, "left_semi").select("location_id", "request").distinct().join(shared, "request")
    own = by_location.select("location_id", F.lit(2).alias("source"), *cols).unionByName(mixed.select("location_id", "source", *cols))
    own = own.groupBy("location_id", *point).agg(first).select("location_id", *point, "f.*")
    own = own.join(links.select("location_id", "request"), "location_id", "left")
    again = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("request", *point)]
    known = shared.select(*[F.col(c).alias(f"__{c}") for c in ("request", *point)])
    own = own.join(known, reduce(lambda a, b: a & b, again), "left_anti").drop("request")
    return Pool(shared, own.withColumn("t", ad.profile(F.col("text"))), links)


def with_profile(rows: DataFrame, address: str = "address") -> DataFrame:
    """Add the profile ``a`` of the normalised address."""
    return rows.withColumn("__n", ad.normalise(F.col(address))).select(*rows.columns, ad.profile(F.col("__n")).alias("a"))


def sync_queue(queue: DataFrame, upstream: DataFrame, key: str = "id") -> DataFrame:
    """Upstream unresolved rows the queue does not hold yet (J21); append them to the queue."""
    return upstream.join(queue.select(key), key, "left_anti")


def fan_out(links: DataFrame, selected: DataFrame) -> DataFrame:
    """Canonical results back to every original location."""
    return links.join(selected, "query_id", "left")


def progress(queries: DataFrame, links: DataFrame) -> DataFrame:
    """Queries and resolved locations by stage and provider status."""
    per = links.groupBy("query_id").agg(F.count(F.lit(1)).alias("locations"))
    status = F.get_json_object("response", "$.status").alias("provider_status")
    return (
        queries.join(per, "query_id", "left")
        .groupBy("stage", status)
        .agg(F.count(F.lit(1)).alias("queries"), F.sum(F.coalesce("locations", F.lit(0))).alias("locations"))
    )


# ---------------------------------------------------------------- selection


def _top_two(scored: DataFrame, key: str) -> DataFrame:
    """Best and second-best candidate per key.

    The rank filter is applied map-side before the shuffle (window group limit), so a key with
    very many candidates sends two rows per task.
    """
    w = Window.partitionBy(key).orderBy(F.desc("score"), "pos")
    top = scored.withColumn("rank", F.row_number().over(w)).filter("rank <= 2")
    best = F.max_by(F.struct(*[c for c in scored.columns if c != key]), F.col("rank") == 1)
    return top.groupBy(key).agg(
        best.alias("best"),
        F.count(F.lit(1)).alias("shown"),
        F.max(F.when(F.col("rank") == 2, F.struct("score", "location"))).alias("next"),
    )


def choose(scored: DataFrame, queries: DataFrame, key: str = "query_id", method: str = "direct") -> DataFrame:
    """Selected candidate per query with margin rules.

    ``scored`` has pos, score, reason, location and level per valid candidate; a query of ``queries`` that has none is unmatched.
    """
    top = queries.select(key).distinct().join(_top_two(scored, key), key, "left")
    score, second = F.col("best.score"), F.coalesce("next.score", F.lit(-1.0))
    margin = score - second
    several = F.col("shown") > 1
    outcome = (
        F.when(F.col("best").isNull(), "unmatched")
        .when(score < 0, "candidate_conflict")
        .when(several & ((score < 0.72) | (margin < 0.15)), "ambiguous")
        .when(~several & (score < 0.35), "weak_text_match")
        .otherwise("selected")
    )
    door = F.col("best.level").isin(DOOR_LEVELS) & (F.col("best.reason") == "road_and_number_agree") & F.lit(method == "direct")
    return top.select(
        key,
        outcome.alias("outcome"),
        F.when(outcome == "selected", F.col("best.location")).alias("location"),
        F.round(score, 4).alias("match_score"),
        F.round(margin, 4).alias("candidate_margin"),
        F.when(outcome == "selected", method).alias("match_method"),
        F.when(F.col("best").isNotNull(), F.when(door, "door_or_building_unverified").otherwise("coarse_or_fuzzy_unverified")).alias("match_quality"),
    )


def provider_select(
    candidates: DataFrame, key: str, least_score: float = 0.55, least_reliability: float | None = None,
    margin: float = 0.15,
) -> DataFrame:
    """Provider rules: area, box, district and number filters, then the margin rule.

    Two close candidates at the same point are not ambiguous.
    """
    rated = with_profile(candidates).withColumn("t", ad.profile(F.col("text")))
    d, n = F.col("a.district"), F.col("a.numbers")
    same_number = F.coalesce(F.get(n, F.lit(0)) == F.get(F.col("t.numbers"), F.lit(0)), F.lit(False))
    keep = (
        F.col("adcode").startswith(ad.CITY_CODE)
        & geo.in_box(F.col("lon"), F.col("lat"))
        & ((d == "") | (F.col("district") == d))
        & ((F.size(n) == 0) | same_number)
    )
    if least_reliability is not None:
        keep = keep & (F.coalesce("reliability", F.lit(0)) >= least_reliability)
    s = ad.strict_score(F.col("a"), F.col("t"), F.col("adcode"), least_score)
    scored = rated.filter(keep).withColumn("s", s).select(
        key, "pos", "location", F.col("s.score").alias("score"), F.col("s.reason").alias("reason")
    ).filter(F.col("score") >= least_score)
    top = _top_two(scored, key)
    close = (F.col("best.score") - F.col("next.score") < margin) & (F.col("best.location") != F.col("next.location"))
    got = top.select(
        key,
        F.when(F.coalesce(close, F.lit(False)), "ambiguous").otherwise("selected").alias("outcome"),
        F.col("best.location").alias("location"),
        F.col("best.score").alias("match_score"),
    )
    asked = candidates.select(key).distinct()
    return asked.join(got, key, "left").withColumn(
        "outcome", F.coalesce("outcome", F.lit("candidate_conflict_or_insufficient_anchor"))
    )


def best_of_pool(pool: DataFrame, key: str = "location_id", least: float = 0.35) -> DataFrame:
    """Best candidate of a pool by (score, text, provider), if accepted or good enough."""
    rest = [c for c in pool.columns if c not in (key, "fuzzy_score", "text", "provider")]
    best = pool.groupBy(key).agg(F.max(F.struct("fuzzy_score", "text", "provider", *rest)).alias("b"))
    return best.select(key, "b.*").filter(F.col("accepted") | (F.col("fuzzy_score") >= least))


def missing_pool(rows: DataFrame, candidates: DataFrame, key: str = "location_id") -> DataFrame:
    """Scored pool of the locations without coordinates, out-of-area codes left out."""
    missing = with_profile(rows.filter(F.col("longitude").isNull() | F.col("latitude").isNull()).select(key, "address"))
    inside = candidates.filter((F.col("adcode") == "") | F.col("adcode").startswith(ad.CITY_CODE))
    inside = inside.filter(geo.in_box(F.col("lon"), F.col("lat")))
    inside = inside.withColumn("t", ad.profile(F.col("text")))
    score = ad.loose_score(F.col("a"), F.col("t"), F.col("accepted"))
    rated = inside.join(missing, key).withColumn("fuzzy_score", score)
    return rated.filter("fuzzy_score IS NOT NULL").drop("address", "a", "t")


# ---------------------------------------------------------------- audit


def category() -> Column:
    """Address category from provider level and match quality."""
    # Categories, provider levels and the marks that qualities and levels hold.
    level, quality, fuzzy = F.col("provider_level"), F.col("match_quality"), F.col("fuzzy_level")
    return (
        F.when(fuzzy.contains("city_reference"), "city_reference")
        .when(fuzzy.contains("district_reference"), "district_reference")
        .when(
            fuzzy.contains("town_reference") | quality.contains("township_reference") | level.isin("乡镇", "街道"),
            "township_street_reference",
        )
        .when(
            fuzzy.contains("village_reference") | quality.contains("village_reference") | (level == "村庄"),
            "village_community_reference",
        )
        .when(
            level.isin(*DOOR_LEVELS, "9") | quality.contains("door_or_building") | quality.contains("building_anchor"),
            "door_building_candidate",
        )
        .when(level.isin("10", "11", *BUILDING_LEVELS), "building_poi_candidate")
        .when(level.isin("道路", "路", "7"), "road_reference")
        .otherwise("fuzzy_candidate")
    )


def disposition() -> Column:
    """Audit disposition."""
    # Dispositions.
    return (
        F.when(F.col("audit_category").endswith("reference"), "reference_only")
        .when(F.col("conflict"), "address_conflict")
        .when(F.col("ambiguous"), "multiple_plausible_locations")
        .when(F.col("passed"), "text_consistent_spatial_unverified")
        .otherwise("insufficient_address_evidence")
    )


def review_priority() -> Column:
    """Review priority 1 (most urgent) to 4."""
    c, bad = F.col("audit_category"), F.col("conflict") | F.col("ambiguous")
    precise = c.isin("door_building_candidate", "building_poi_candidate")
    return (
        F.when((c == "door_building_candidate") & bad, 1)
        .when(bad | (precise & ~F.col("passed")), 2)
        .when(c.endswith("reference") | ~F.col("passed"), 3)
        .otherwise(4)
    )


def _strict(rows: DataFrame) -> DataFrame:
    """Rank ``s`` and evidence ``c`` of rows of an address profile ``a`` and a candidate."""
    score = ad.strict_score(F.col("a"), F.col("t"), F.col("adcode"))["score"]
    place = F.struct((-F.col("source")).alias("a"), (-F.col("pos")).alias("b"), "text")
    return rows.withColumn("score", score).withColumns({"s": F.struct("score", place), "c": F.struct("a", "t", "adcode")})


def evidence_match(locations: DataFrame, shared: DataFrame, own: DataFrame, within_m: float = 2.0) -> DataFrame:
    """Best candidate of the saved provider within 2 m of the saved point, with evidence flags.

    Of a request's candidates at one point only the best counts, and points meet saved points by cells of ``within_m``.
    """
    provider = F.replace("coordinate_source", F.lit("existing_"), F.lit(""))
    saved = locations.select("location_id", "a", "gcj_lon", "gcj_lat", provider.alias("saved"))
    metres = geo.great_circle(F.col("gcj_lon"), F.col("gcj_lat"), F.col("lon"), F.col("lat"), geo.EARTH_M)
    near = own.join(saved, "location_id").filter((metres <= within_m) & (F.col("provider") == F.col("saved")))
    deg = within_m / clusters.METRES_PER_DEGREE * 1.01

    def column(x: str) -> Column:
        """Number of the cell of a longitude in the row of cells ``cy``; near a pole all are one."""
        edge = (F.abs("cy") + 2) * deg
        return F.when(edge < 89, F.floor(F.col(x) * F.cos(F.radians(edge)) / deg)).otherwise(F.lit(0).cast("long"))

    best = _strict(shared).groupBy("ask", "provider", "lon", "lat").agg(F.max("s").alias("s"), F.max_by("c", "s").alias("c"))
    best = best.withColumn("cy", F.explode(F.sequence(*[F.floor(F.col("lat") / deg) + i for i in (-1, 1)])))
    best = best.withColumn("cx", column("lon")).withColumn("cx", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)))
    points = locations.filter("ask IS NOT NULL").select("location_id", "ask", "gcj_lon", "gcj_lat", provider.alias("provider"))
    points = points.withColumn("cy", F.floor(F.col("gcj_lat") / deg)).withColumn("cx", column("gcj_lon"))
    both = points.join(best, ["ask", "provider", "cx", "cy"]).filter(metres <= within_m)
    chosen = _strict(near).select("location_id", "s", "c").unionByName(both.select("location_id", "s", "c"))
    chosen = chosen.groupBy("location_id").agg(F.max_by("c", "s").alias("c"))
    flags = ad.evidence(F.col("c.a"), F.col("c.t"), F.col("c.adcode"))
    return chosen.select("location_id", flags.alias("e")).select("location_id", "e.*", F.lit(1).alias("candidate_evidence_found"))


def plausible_points(rows: DataFrame, key: str) -> DataFrame:
    """Points of the candidates without conflict that confirm every anchor of the address (input of A24).

    A point seen twice is one point; the earliest place keeps the order.
    """
    rated = rows.filter("text <> ''").withColumn("e", ad.evidence(F.col("a"), F.col("t"), F.col("adcode")))
    keep = F.lit(True)
    for c in CONFLICTS:
        keep = keep & (F.col(f"e.{c}") == 0)
    for part, agreed in (("roads", "road_agree"), ("houses", "house_number_agree"), ("buildings", "building_number_agree")):
        keep = keep & ((F.size(F.col(f"a.{part}")) == 0) | (F.col(f"e.{agreed}") == 1))
    return rated.filter(keep).groupBy(key, "lon", "lat").agg(F.min(F.struct("source", "pos", "text")).alias("ord"))


def candidate_spread(locations: DataFrame, shared: DataFrame, own: DataFrame) -> DataFrame:
    """Leader clusters of each location's plausible points and their largest distance.

    A request's cached candidates come before a location's own, so their leaders are those of every location of the request; a
    location adds the leaders of its own points that these don't cover, and its farthest pair is one of both, or of its own
    leaders and the rim of the request's.
    """
    asked = locations.filter("ask IS NOT NULL").select("location_id", "ask").distinct()
    common = stable(clusters.leaders(plausible_points(shared, "ask"), "ask", "ord", "lon", "lat"))
    points = plausible_points(own.join(locations.select("location_id", "a"), "location_id"), "location_id").join(asked, "location_id", "left")
    more = stable(clusters.leaders(clusters.uncovered(points, common, "ask", "lon", "lat"), "location_id", "ord", "lon", "lat"))
    added = more.groupBy("location_id").agg(F.count(F.lit(1)).alias("added"))
    edge = asked.join(added, "location_id", "left_semi").join(clusters.rim(common, "ask"), "ask")
    both = more.select("location_id", "x", "y").unionByName(edge.select("location_id", "x", "y"))
    far = clusters.separation(both, "location_id").select("location_id", F.col("max_separation_m").alias("far"))
    rows = asked.join(clusters.separation(common, "ask"), "ask").drop("ask").join(added.join(far, "location_id"), "location_id", "full")
    return rows.select(
        "location_id",
        (F.coalesce("clusters", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("clusters"),
        F.greatest("max_separation_m", "far").alias("max_separation_m"),
    )


def audit_locations(locations: DataFrame, pool: Pool) -> DataFrame:
    """Consistency audit of every location."""
    asks = stable(pool.links.select("request", "address").distinct().withColumn("ask", F.monotonically_increasing_id()))
    # Address texts are profiled once per location and once per request, and read twice (evidence and clusters).
    linked = pool.links.join(asks, ["request", "address"]).select("location_id", "ask")
    locations = stable(with_profile(locations).join(linked, "location_id", "left"))
    shared = with_profile(asks).join(pool.shared, "request").drop("request", "address")
    own = stable(pool.own)
    evidence = evidence_match(locations, shared, own)
    spread = candidate_spread(locations, shared, own)
    rows = locations.join(evidence, "location_id", "left").join(spread, "location_id", "left")
    rows = rows.fillna(0, [*ad.EVIDENCE_FLAGS, "candidate_evidence_found", "clusters", "max_separation_m"])
    conflict = F.greatest(*[F.col(c) for c in CONFLICTS]) == 1
    number_agrees = ((F.size("a.houses") > 0) & (F.col("house_number_agree") == 1)) | (
        (F.size("a.buildings") > 0) & (F.col("building_number_agree") == 1)
    )
    passed = (
        (F.col("candidate_evidence_found") == 1)
        & ~conflict
        & (F.col("district_evidence_missing") == 0)
        & (F.col("road_agree") == 1)
        & number_agrees
        & (F.col("house_number_evidence_missing") == 0)
        & (F.col("building_number_evidence_missing") == 0)
    )
    rows = rows.select(
        "*",
        category().alias("audit_category"),
        conflict.alias("conflict"),
        (F.col("clusters") > 1).alias("ambiguous"),
        passed.alias("passed"),
    )
    return rows.select(
        *rows.columns,
        disposition().alias("audit_disposition"),
        review_priority().alias("review_priority"),
        F.col("ambiguous").cast("int").alias("multiple_plausible_locations"),
        F.round("max_separation_m").cast("long").alias("plausible_candidate_max_separation_m"),
        F.lit(0).alias("independently_verified_within_1km"),
    ).drop("conflict", "ambiguous", "passed", "max_separation_m", "a", "ask")


def review_queue(audited: DataFrame) -> DataFrame:
    """Urgent rows, most urgent first."""
    return audited.filter("review_priority <= 2").orderBy("review_priority", "location_id")


def tiers(audited: DataFrame) -> DataFrame:
    """Analysis tier, eligibility flags and reasons of each location."""
    cat, source = F.col("audit_category"), F.col("coordinate_source")
    finite = F.col("longitude").between(-1e9, 1e9) & F.col("latitude").between(-1e9, 1e9)
    valid = F.coalesce((F.col("crs") == "EPSG:4326") & finite, F.lit(False))
    conflicts = F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in CONFLICTS]))
    clean = (F.size(conflicts) == 0) & (F.col("multiple_plausible_locations") == 0)
    consistent = F.col("audit_disposition") == "text_consistent_spatial_unverified"
    precise = cat.isin("door_building_candidate", "building_poi_candidate")
    proven = F.col("independently_verified_within_1km") == 1
    core = valid & consistent & clean
    coarse = (
        valid
        & cat.isin("road_reference", "township_street_reference", "village_community_reference")
        & (F.col("candidate_evidence_found") == 1)
        & (F.col("district_evidence_missing") == 0)
        & clean
        & (source != "local_matched_address_reference")
    )
    imputed = cat.isin("city_reference", "district_reference") | (source == "local_matched_address_reference")
    tier = (
        F.when(imputed, "excluded_reference_imputation")
        .when(core & precise & proven, "main_qualified")
        .when(core & precise, "primary_candidate_pending_spatial_validation")
        .when(core, "sensitivity_text_consistent_fuzzy")
        .when(coarse, "sensitivity_coarse_reference")
        .otherwise("excluded_pending_quality_review")
    )
    staged = audited.select(
        "*",
        tier.alias("analysis_tier"),
        valid.alias("__valid"),
        conflicts.alias("__conflicts"),
        core.alias("__core"),
        coarse.alias("__coarse"),
        (core & precise & proven).alias("__main"),
        (core & precise & ~proven).alias("__primary"),
    )
    t = F.col("analysis_tier")
    why = (
        F.when(t == "excluded_reference_imputation", "reference_imputation_not_individual_residence")
        .when(t == "primary_candidate_pending_spatial_validation", "within_1km_not_verified")
        .when(t == "sensitivity_text_consistent_fuzzy", "unverified_or_fuzzy_candidate")
        .when(t == "sensitivity_coarse_reference", "coarse_reference_position_only")
        .when(t == "excluded_pending_quality_review", "address_consistency_or_specificity_insufficient")
    )
    reasons = F.array_distinct(
        F.concat(
            F.array_compact(F.array(F.when(~F.col("__valid"), "invalid_coordinate_or_crs"))),
            F.col("__conflicts"),
            F.array_compact(
                F.array(
                    F.when(F.col("multiple_plausible_locations") == 1, "multiple_plausible_locations"),
                    F.when(F.col("candidate_evidence_found") != 1, "saved_coordinate_candidate_evidence_missing"),
                    why,
                )
            ),
        )
    )
    usable = ~t.startswith("excluded_")
    out = staged.select(
        *audited.columns,
        "analysis_tier",
        F.coalesce(F.nullif(F.array_join(reasons, ";"), F.lit("")), F.lit("validated_precise_address")).alias("eligibility_reason"),
        (usable & F.col("__main")).cast("int").alias("main_eligible"),
        (usable & F.col("__primary")).cast("int").alias("primary_candidate_pending_validation"),
        (usable & F.col("__core")).cast("int").alias("sensitivity_core_eligible"),
        (usable & F.col("__coarse")).cast("int").alias("sensitivity_coarse_eligible"),
    )
    return out.select(
        "*",
        F.col("main_eligible").alias("verified_within_1km"),
        (F.col("sensitivity_core_eligible") + F.col("sensitivity_coarse_eligible")).alias("sensitivity_eligible"),
    )


ELIGIBILITY = [
    "main_eligible",
    "primary_candidate_pending_validation",
    "sensitivity_eligible",
    "sensitivity_core_eligible",
    "sensitivity_coarse_eligible",
]


def tier_totals(rows: DataFrame) -> DataFrame:
    """Locations and eligibility totals per tier."""
    return rows.groupBy("analysis_tier").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ELIGIBILITY]
    )


# ---------------------------------------------------------------- references and fallbacks

LEVELS = ["village", "town", "district", "city"]


def _place_keys(rows: DataFrame, address: str) -> DataFrame:
    t = ad.place_tokens(F.col(address))
    staged = rows.withColumn("__t", t)
    d, town, v = F.col("__t.district"), F.col("__t.town"), F.col("__t.village")
    return staged.select(
        *rows.columns,
        F.when((d != "") & (town != "") & (v != ""), F.concat_ws("|", d, town, v)).alias("village"),
        F.when((d != "") & (town != ""), F.concat_ws("|", d, town)).alias("town"),
        F.nullif(d, F.lit("")).alias("district"),
        F.lit(ad.CITY).alias("city"),
    )


def reference_points(rows: DataFrame, address: str = "address", least: int = 3) -> DataFrame:
    """Median point per village, town, district and city with enough support."""
    located = rows.filter(geo.in_box(F.col("longitude"), F.col("latitude")))
    keyed = _place_keys(located, address)
    long = keyed.select(
        "longitude", "latitude", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(k).alias("place")) for k in LEVELS])).alias("p")
    ).filter("p.place IS NOT NULL").select("longitude", "latitude", "p.level", "p.place")
    keys = ["level", "place"]
    x = exact_quantiles(long, keys, "longitude", {"ref_longitude": 0.5}).withColumnRenamed("n", "support")
    y = exact_quantiles(long, keys, "latitude", {"ref_latitude": 0.5}).drop("n")
    return x.join(y, keys).filter(F.col("support") >= least)


def hierarchical_fallback(missing: DataFrame, references: DataFrame, address: str = "address") -> DataFrame:
    """First reference level with support: village, town, district, city.

    City and district references come from a fixed list of names, so they are broadcast; town
    and village references are joined on their key.
    """
    out = _place_keys(missing, address)
    for level in LEVELS:
        ref = references.filter(F.col("level") == level).select(
            F.col("place").alias(level),
            F.struct(F.lit(level).alias("level"), "ref_longitude", "ref_latitude", "support").alias(f"__{level}"),
        )
        if level in ("district", "city"):
            ref = F.broadcast(ref)
        out = out.join(ref, level, "left")
    found = F.coalesce(*[F.col(f"__{level}") for level in LEVELS])
    return out.select(*missing.columns, found.alias("r")).select(*missing.columns, "r.*")


def house_anchors(selected: DataFrame, spread: float = 0.0008) -> DataFrame:
    """(district, town, road, number) groups whose points lie within ``spread`` degrees."""
    keyed = _anchor_keys(selected).filter("road IS NOT NULL AND number IS NOT NULL")
    return (
        keyed.groupBy("district", "town", "road", "number")
        .agg(
            F.min_by(F.struct("lon", "lat"), "query_id").alias("p"),
            (F.max("lon") - F.min("lon")).alias("dx"),
            (F.max("lat") - F.min("lat")).alias("dy"),
            F.count(F.lit(1)).alias("members"),
        )
        .filter((F.col("dx") < spread) & (F.col("dy") < spread))
        .select("district", "town", "road", "number", "p.lon", "p.lat", "members")
    )


def _anchor_keys(rows: DataFrame) -> DataFrame:
    a = F.col("address")
    c = ad.town_context(a)
    return rows.select(
        "*",
        c["district"].alias("district"),
        c["town"].alias("town"),
        F.get(ad.roads(a), F.lit(0)).alias("road"),
        F.get(ad.door_numbers(a), F.lit(0)).alias("number"),
    )


def reuse_house_anchor(unresolved: DataFrame, anchors: DataFrame) -> DataFrame:
    """Unresolved queries that share a house anchor."""
    keyed = _anchor_keys(unresolved.select("query_id", "address"))
    return keyed.join(anchors, ["district", "town", "road", "number"]).select("query_id", "lon", "lat", "members")


def admin_references(points: DataFrame, least_length: int = 9) -> DataFrame:
    """Administrative prefix -> point, prefixes with several points left out."""
    prefix = F.regexp_replace(F.replace("text", F.lit(ad.PROVINCE), F.lit("")), r"[\d].*$", "")
    rows = points.withColumn("district", ad.district(F.col("text"))).withColumn("prefix", prefix)
    level = F.col("level")
    keep = (
        (F.col("district") != "")
        & F.col("adcode").startswith(ad.CITY_CODE)
        & (F.length("prefix") >= least_length)
        & (
            ((level == "村庄") & F.col("prefix").contains("村"))
            | ((level == "乡镇") & F.col("prefix").rlike("街道|镇"))
        )
    )
    single = F.min("location") == F.max("location")
    once = rows.filter(keep).groupBy("prefix").agg(
        F.min("district").alias("district"), F.min("location").alias("location"), F.min("level").alias("level"), single.alias("single")
    )
    return once.filter("single").drop("single")


#: Prefixes of one automaton, and addresses that walk one; larger districts are dealt out.
AUTOMATON, WALKERS = 1 << 16, 1 << 17


def longest_prefix(unresolved: DataFrame, references: DataFrame, automaton: int = AUTOMATON, walkers: int = WALKERS) -> DataFrame:
    """Longest administrative prefix contained in the address, same district.

    Each district's prefixes form automata of bounded size; an address walks each of its district's once, and the longest of what
    they accept counts, of equally long prefixes the last in order. A district of any number of prefixes or addresses is dealt out
    by hash on both sides. Null addresses and districts without a reference find nothing.
    """
    text = F.replace(ad.normalise(F.col("address")), F.lit(ad.PROVINCE), F.lit(""))
    rows = unresolved.select("query_id", ad.district(F.col("address")).alias("district"), text.alias("t")).where("t IS NOT NULL")
    refs = references.select("district", "prefix", "location", "level").where("prefix <> ''")

    def parts(side: DataFrame, room: int, name: str) -> DataFrame:
        return side.groupBy("district").agg(F.ceil(F.count(F.lit(1)) / room).cast("int").alias(name))

    dealt = parts(refs, automaton, "shards").join(parts(rows, walkers, "salts"), "district")

    def among(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    held = refs.join(dealt, "district").withColumn("shard", among("prefix", "shards")).withColumn("salt", each("salts")).drop("shards", "salts")
    asked = rows.join(dealt, "district").withColumn("salt", among("query_id", "salts")).withColumn("shard", each("shards")).drop("shards", "salts")
    held = held.select(*(F.col(c).alias(f"r_{c}") for c in held.columns))

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        walker = Patterns(right.column("r_prefix").to_pylist())
        found = [walker.find(t) for t in left.column("t").to_pylist()]
        hit = pa.array([i for i, n in enumerate(found) if n >= 0], pa.int64())
        best = right.select(["r_prefix", "r_location", "r_level"]).take(pa.array([n for n in found if n >= 0], pa.int64()))
        return pa.table([left.column("query_id").take(hit), *best.columns], names=["query_id", "prefix", "location", "level"])

    schema = rows.select("query_id").schema.add("prefix", "string").add("location", "string").add("level", "string")
    keys = ["district", "shard", "salt"]
    hits = asked.groupBy(*keys).cogroup(held.groupBy(*(f"r_{k}" for k in keys))).applyInArrow(walk, schema)
    best = hits.groupBy("query_id").agg(F.max(F.struct(F.length("prefix").alias("n"), "prefix", "location", "level")).alias("b"))
    return best.select("query_id", "b.prefix", "b.location", "b.level")
