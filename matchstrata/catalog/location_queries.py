"""Queries over address text, match candidates, location tiers and fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchstrata.catalog.base import query, table
from matchstrata.catalog.bindings import DuckDialect, SparkDialect, _pick
from matchstrata.core import keep, stable
from matchstrata.functions import address as ad
from matchstrata.operators import clusters, validate
from matchstrata.operators import location as loc

# ---------------------------------------------------------------- stand-in data

_DISTRICTS = list(ad.DISTRICTS)
_TOWNS = ["石牌街道", "东沙镇", "沙河街道", ""]
_ROADS = ["中山大道", "天河路", "沿江西路", "长堤街"]


def _int(x: str) -> str:
    return f"cast(floor({x}) as bigint)"


def address_sql(q, customer="customer"):
    c = "c_custkey"
    d = f"CASE WHEN {c} % 11 = 0 THEN '' ELSE {_pick('c_nationkey', _DISTRICTS)} END"
    place = f"CASE WHEN {c} % 6 = 0 THEN '石溪村' ELSE {_pick(_int(f'{c} / 3'), _ROADS)} END"
    tail = f"CASE WHEN {c} % 5 = 0 THEN '３栋２０１房' WHEN {c} % 7 = 0 THEN '，8楼' ELSE '' END"
    doubled = f"CASE WHEN {c} % 4 = 1 THEN '广州市广州市' ELSE '广州市' END"
    return f"""SELECT {c} AS location_id,
      '广东省 ' || {doubled} || {d} || {_pick(c, _TOWNS)} || {place} || {q.num(f"{c} % 50 + 1")} || '号' || {tail} AS address,
      112.9e0 + ({c} % 40) / 1e2 AS longitude, 22.9e0 + ({c} % 30) / 1e2 AS latitude,
      c_mktsegment AS segment FROM {customer}"""


def candidate_sql(q, orders="orders", customer="customer"):
    """One match candidate per order of a customer."""
    c, k = "c_custkey", "o_orderkey"
    d = f"CASE WHEN {k} % 7 = 0 THEN '番禺区' ELSE {_pick('c_nationkey', _DISTRICTS)} END"
    road = f"CASE WHEN {k} % 10 = 0 THEN '环市东路' ELSE {_pick(_int(f'{c} / 3'), _ROADS)} END"
    number = f"CASE WHEN {k} % 9 = 0 THEN '' ELSE {q.num(f'{c} % 50 + 1 + CASE WHEN {k} % 4 = 0 THEN 1 ELSE 0 END')} || '号' END"
    return f"""SELECT {c} AS location_id, {k} AS pos, '广东省广州市' || {d} || {_pick(c, _TOWNS)} || {road} || {number} AS text,
      CASE WHEN {k} % 13 = 0 THEN '440600' ELSE '440106' END AS adcode,
      {_pick(k, ["门牌号", "道路", "村庄", "兴趣点"])} AS level,
      112.9e0 + ({c} % 40) / 1e2 + ({k} % 5) * 4e-4 AS lon, 22.9e0 + ({c} % 30) / 1e2 + ({k} % 3) * 3e-4 AS lat
      FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""


def addresses(spark, sf):
    return spark.sql(address_sql(SparkDialect, "{customer}"), customer=table(spark, sf, "customer"))


def candidates(spark, sf):
    return spark.sql(
        candidate_sql(SparkDialect, "{orders}", "{customer}"),
        orders=table(spark, sf, "orders"),
        customer=table(spark, sf, "customer"),
    )


_HAN = "一-鿿"
_ADMIN = "广东省|广州市|" + "|".join(_DISTRICTS)


def _collapse(x: str) -> str:
    for n in ["广东省", "广州市", *_DISTRICTS]:
        x = f"replace({x}, '{n}{n}', '{n}')"
    return x


_NORM = _collapse("regexp_replace(translate(address, '０１２３', '0123'), '[\\s　，；。,;]+', '', 'g')")
_DISTRICT = "CASE " + " ".join(f"WHEN {{x}} LIKE '%{d}%' THEN '{d}'" for d in _DISTRICTS) + " ELSE '' END"


def _district(x: str) -> str:
    return _DISTRICT.format(x=x)


def _profile(prefix: str, x: str) -> str:
    """Anchors of a text; the data hold no word on which a look-ahead would matter."""
    street = f"regexp_replace(regexp_replace({x}, '{_ADMIN}', '', 'g'), '[{_HAN}]{{2,8}}(?:街道|镇)', '')"
    return f"""{_district(x)} AS {prefix}d,
    regexp_extract_all({street}, '[{_HAN}]{{2,12}}(?:大道|路|巷|街)') AS {prefix}r,
    regexp_extract_all({street}, '([0-9]+(?:-[0-9]+)?)(?:号|栋|幢|座)', 1) AS {prefix}n,
    regexp_extract_all({x}, '([0-9]+(?:-[0-9]+)?)号', 1) AS {prefix}h,
    regexp_extract_all({x}, '([A-Za-z]?[0-9]+|[A-Za-z])(?:栋|幢|座)', 1) AS {prefix}b"""


_ADDR = f"addr AS (SELECT *, {_NORM} AS norm FROM ({address_sql(DuckDialect)}))"
_PROFILED = f"prof AS (SELECT *, {_profile('a', 'norm')} FROM addr)"
_CAND = f"cand AS (SELECT *, {_profile('t', 'text')} FROM ({candidate_sql(DuckDialect)}))"


# ---------------------------------------------------------------- text


@query(
    "F16_F17_F18_F21_address_profile",
    f"""WITH {_ADDR}, {_PROFILED} SELECT location_id, norm, ad AS district, array_to_string(ar, '|') AS roads,
    array_to_string(an, '|') AS numbers, array_to_string(ah, '|') AS houses, array_to_string(ab, '|') AS buildings FROM prof""",
)
def profiles(spark, sf):
    rows = loc.with_profile(addresses(spark, sf))
    lists = [F.concat_ws("|", f"a.{c}").alias(c) for c in ("roads", "numbers", "houses", "buildings")]
    return rows.select("location_id", F.col("a.text").alias("norm"), F.col("a.district").alias("district"), *lists)


@query(
    "F19_F20_F22_F36_address_parts",
    f"""WITH {_ADDR}, t AS (SELECT *, {_district('norm')} AS d FROM addr),
    u AS (SELECT *, CASE WHEN d <> '' THEN substr(norm, instr(norm, d) + length(d)) ELSE replace(replace(norm, '广东省', ''), '广州市', '') END AS rest FROM t),
    v AS (SELECT *, regexp_extract(rest, '^([{_HAN}]{{2,12}}?(?:街道|镇))', 1) AS town FROM u)
    SELECT location_id, regexp_replace(norm, '([0-9]+(?:号|栋|幢|座|楼))((?:[0-9]+单元)?(?:[0-9]+[层楼])?(?:[0-9]+(?:室|房))?)$', '\\1') AS building,
    CASE WHEN regexp_matches(norm, '[0-9]+(?:号|栋|幢|座)') THEN regexp_extract(norm, '^(.*?[0-9]+(?:号|栋|幢|座))', 1)
      ELSE regexp_extract(norm, '^(.*?(?:社区|小区|花园|大厦|村))', 1) END AS coarse, d AS district, town,
    regexp_extract(substr(rest, length(town) + 1), '^([{_HAN}]{{2,16}}?(?:社区|村|小区|花园))', 1) AS village,
    regexp_extract(regexp_replace(norm, '{_ADMIN}', '', 'g'), '([{_HAN}]{{2,10}}(?:街道|镇))', 1) AS context_town FROM v""",
)
def address_parts(spark, sf):
    rows = addresses(spark, sf).select("location_id", ad.normalise(F.col("address")).alias("n"))
    n = F.col("n")
    t, c = ad.place_tokens(n), ad.town_context(n)
    return rows.select(
        "location_id", ad.building(n).alias("building"), ad.coarse_prefix(n).alias("coarse"),
        t["district"].alias("district"), t["town"].alias("town"), t["village"].alias("village"),
        c["town"].alias("context_town"),
    )


def matched(spark, sf):
    left = loc.with_profile(addresses(spark, sf).select("location_id", "address"))
    right = candidates(spark, sf).withColumn("t", ad.profile(F.col("text")))
    return right.join(left, "location_id")


_PAIRS = "pair AS (SELECT * FROM cand JOIN prof USING (location_id))"
_REASON = """CASE WHEN ad <> '' AND text NOT LIKE '%' || ad || '%' THEN 'district_conflict'
 WHEN adcode NOT LIKE '4401%' THEN 'outside_guangzhou'
 WHEN len(ar) > 0 AND len(list_filter(ar, lambda x: contains(text, x))) = 0 THEN 'road_conflict_or_missing'
 WHEN len(an) > 0 AND len(tn) > 0 AND an[1] <> tn[1] THEN 'house_number_conflict'
 WHEN len(ar) > 0 AND len(an) > 0 AND list_contains(tn, an[1]) THEN 'road_and_number_agree' ELSE 'text_and_district' END"""


@query(
    "F23_match_reason",
    f"WITH {_ADDR}, {_PROFILED}, {_CAND}, {_PAIRS} SELECT location_id, pos, {_REASON} AS reason FROM pair",
)
def match_reason(spark, sf):
    s = ad.strict_score(F.col("a"), F.col("t"), F.col("adcode"))
    return matched(spark, sf).select("location_id", "pos", s["reason"].alias("reason"))


def _ratio_sql(pairs: str) -> str:
    """``ratio`` (x, y, r) of the distinct texts (x, y) of ``pairs``: the longest common block, first in x and then in y, and the same left and right of it."""
    blocks = "[{{'l': l, 'i': -i}} for l in range(1, length(a) - i + 2) if contains(b, substr(a, i, l))]"
    return f"""rs AS (SELECT DISTINCT x, y FROM ({pairs})),
    seg AS (SELECT x, y, x AS a, y AS b, 0::BIGINT AS m FROM rs
      UNION ALL SELECT x, y, unnest([substr(a, 1, i - 1), substr(a, i + l)]), unnest([substr(b, 1, j - 1), substr(b, j + l)]), unnest([l, 0]) FROM
        (SELECT x, y, a, b, k.l AS l, -k.i AS i, instr(b, substr(a, -k.i, k.l)) AS j FROM
          (SELECT x, y, a, b, list_max(flatten([{blocks.format()} for i in range(1, length(a) + 1)])) AS k FROM seg WHERE a <> '' AND b <> '') WHERE k IS NOT NULL)),
    ratio AS (SELECT x, y, CASE WHEN length(x) + length(y) = 0 THEN 1e0 ELSE 2e0 * sum(m) / (length(x) + length(y)) END AS r FROM seg GROUP BY x, y)"""


def _plain(x: str) -> str:
    return f"regexp_replace({x}, '{_ADMIN}', '', 'g')"


def _cityless(x: str) -> str:
    return f"regexp_replace({x}, '广东省|广州市', '', 'g')"


_STRICT = f"CASE WHEN {_REASON} IN ('road_and_number_agree', 'text_and_district') THEN least(1e0, r + CASE WHEN {_REASON} = 'road_and_number_agree' THEN 0.18e0 ELSE 0e0 END) ELSE -1e0 END"
_ROAD_FOUND = "len(list_filter(ar, lambda x: contains(text, x))) > 0"
_LOOSE = f"""CASE WHEN ad = '' OR td = '' OR ad = td THEN round_even(r
  + CASE WHEN ad <> '' AND contains(text, ad) THEN 0.2e0 ELSE 0e0 END + CASE WHEN len(ar) > 0 AND {_ROAD_FOUND} THEN 0.2e0 ELSE 0e0 END
  + CASE WHEN len(an) > 0 AND list_contains(tn, an[1]) THEN 0.2e0 ELSE 0e0 END + CASE WHEN len(an) > 0 AND len(tn) > 0 AND an[1] <> tn[1] THEN -0.4e0 ELSE 0e0 END
  + CASE WHEN len(ar) > 0 AND len(tr) > 0 AND NOT ({_ROAD_FOUND}) THEN -0.25e0 ELSE 0e0 END + CASE WHEN {{accepted}} THEN 2e0 ELSE 0e0 END, 4) END"""
_PAIRED = f"WITH RECURSIVE {_ADDR}, {_PROFILED}, {_CAND}, {_PAIRS}"


@query(
    "F23_strict_score",
    f"""{_PAIRED}, t AS (SELECT *, {_plain('norm')} AS x, {_plain('text')} AS y FROM pair), {_ratio_sql('SELECT x, y FROM t')}
    SELECT location_id, pos, round({_STRICT}, 6) AS strict FROM t JOIN ratio USING (x, y)""",
)
def strict_scores(spark, sf):
    s = ad.strict_score(F.col("a"), F.col("t"), F.col("adcode"))
    return matched(spark, sf).select("location_id", "pos", F.round(s["score"], 6).alias("strict"))


@query(
    "F24_loose_score",
    f"""{_PAIRED}, t AS (SELECT *, {_cityless('norm')} AS x, {_cityless('text')} AS y FROM pair), {_ratio_sql('SELECT x, y FROM t')}
    SELECT location_id, pos, {_LOOSE.format(accepted='pos % 17 = 0')} AS loose FROM t JOIN ratio USING (x, y)""",
)
def loose_scores(spark, sf):
    loose = ad.loose_score(F.col("a"), F.col("t"), F.col("pos") % 17 == 0)
    return matched(spark, sf).select("location_id", "pos", loose.alias("loose"))


@query("F23_F24_match_scores")
def match_scores(spark, sf):
    """Both similarity scores; their twins are those of the two queries above."""
    s = ad.strict_score(F.col("a"), F.col("t"), F.col("adcode"))
    loose = ad.loose_score(F.col("a"), F.col("t"), F.lit(False))
    return matched(spark, sf).select(
        "location_id", "pos", F.round(s["score"], 6).alias("strict"), loose.alias("loose")
    )


_AGREE = """len(list_filter(ar, lambda x: contains(text, x) OR len(list_filter(tr, lambda y: ends_with(x, y) OR ends_with(y, x))) > 0)) > 0"""
_CODE_DISTRICT = "CASE WHEN td <> '' THEN td WHEN adcode = '440106' THEN '天河区' ELSE '' END"


@query(
    "F25_evidence_flags",
    f"""WITH {_ADDR}, {_PROFILED}, {_CAND}, {_PAIRS}, e AS (SELECT *, {_AGREE} AS ok, {_CODE_DISTRICT} AS t_d FROM pair)
    SELECT location_id, pos, cast(ad <> '' AND t_d <> '' AND ad <> t_d AS integer) AS district_conflict,
    cast(ad <> '' AND t_d = '' AS integer) AS district_evidence_missing,
    cast(len(ar) > 0 AND len(tr) > 0 AND NOT ok AS integer) AS road_conflict,
    cast(len(ar) > 0 AND len(tr) = 0 AS integer) AS road_evidence_missing, cast(ok AS integer) AS road_agree,
    cast(len(ah) > 0 AND len(th) > 0 AND ah[1] <> th[1] AS integer) AS house_number_conflict,
    cast(len(ah) > 0 AND len(th) = 0 AS integer) AS house_number_evidence_missing,
    cast(len(ah) > 0 AND len(th) > 0 AND ah[1] = th[1] AS integer) AS house_number_agree,
    cast(len(ab) > 0 AND len(tb) > 0 AND ab[1] <> tb[1] AS integer) AS building_number_conflict,
    cast(len(ab) > 0 AND len(tb) = 0 AS integer) AS building_number_evidence_missing,
    cast(len(ab) > 0 AND len(tb) > 0 AND ab[1] = tb[1] AS integer) AS building_number_agree FROM e""",
)
def evidence(spark, sf):
    e = ad.evidence(F.col("a"), F.col("t"), F.col("adcode"))
    return matched(spark, sf).select("location_id", "pos", e.alias("e")).select("location_id", "pos", "e.*")


# ---------------------------------------------------------------- queries, caches, selection

_BUILDING = "regexp_replace(norm, '([0-9]+(?:号|栋|幢|座|楼))((?:[0-9]+单元)?(?:[0-9]+[层楼])?(?:[0-9]+(?:室|房))?)$', '\\1')"
_LINKS = f"links AS (SELECT location_id, substr(sha256({_BUILDING}), 1, 24) AS query_id, {_BUILDING} AS canonical_address FROM addr)"


@query(
    "J20_canonical_queries",
    f"""WITH {_ADDR}, {_LINKS} SELECT query_id, canonical_address AS address, count(*) AS locations FROM links GROUP BY 1, 2""",
)
def canonical(spark, sf):
    links = loc.canonical_queries(addresses(spark, sf))
    per = links.groupBy("query_id").agg(F.count(F.lit(1)).alias("locations"))
    return loc.query_table(links).join(per, "query_id")


@query(
    "J25_fan_out",
    f"""WITH {_ADDR}, {_LINKS}, s AS (SELECT query_id, min(location_id) AS chosen FROM links GROUP BY 1)
    SELECT location_id, query_id, chosen FROM links JOIN s USING (query_id)""",
)
def fan_out(spark, sf):
    links = loc.canonical_queries(addresses(spark, sf))
    chosen = links.groupBy("query_id").agg(F.min("location_id").alias("chosen"))
    return loc.fan_out(links, chosen).select("location_id", "query_id", "chosen")


_RESPONSE_SQL = """SELECT o_custkey AS address, '{{"status":"' || {status} || '","geocodes":[{{"location":"' || {x} || ',23.1","formatted_address":"'
 || o_orderpriority || '","adcode":"440106","level":"路"}},{{"location":"bad","level":"路"}}]}}' AS response, o_orderkey AS id,
 o_orderstatus AS stage FROM {orders}"""


def _responses(q, orders):
    status = "CASE WHEN o_orderkey % 3 = 0 THEN '0' ELSE '1' END"
    return _RESPONSE_SQL.format(status=status, x=q.num("112 + o_orderkey % 5"), orders=orders)


def responses(spark, sf):
    return spark.sql(_responses(SparkDialect, "__orders").replace("{", "{{").replace("}", "}}").replace("__orders", "{orders}"), orders=table(spark, sf, "orders"))


@query(
    "S06_response_cache",
    f"""WITH r AS ({_responses(DuckDialect, 'orders')}), g AS (SELECT address, id, unnest(from_json(json_extract(response, '$.geocodes'),
      '[{{"location":"VARCHAR","formatted_address":"VARCHAR","adcode":"VARCHAR","level":"VARCHAR"}}]')) AS g FROM r)
    SELECT address, id, cast(split_part(g.location, ',', 1) AS double) AS lon, cast(split_part(g.location, ',', 2) AS double) AS lat,
    replace(g.formatted_address, ' ', '') AS text, g.adcode AS adcode, g.level AS level FROM g WHERE g.location LIKE '%,%'""",
)
def response_cache(spark, sf):
    rows = responses(spark, sf).withColumn("key", F.struct("address", "id"))
    out = loc.parse_responses(rows, "key")
    return out.select("key.address", "key.id", "lon", "lat", "text", "adcode", "level")


@query(
    "A37_progress",
    f"""WITH r AS ({_responses(DuckDialect, 'orders')}) SELECT stage, json_extract_string(response, '$.status') AS provider_status,
    count(*) AS queries, cast(sum((SELECT count(*) FROM lineitem WHERE l_orderkey = id)) AS bigint) AS locations FROM r GROUP BY 1, 2""",
)
def progress(spark, sf):
    queries = responses(spark, sf).withColumnRenamed("id", "query_id")
    links = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"))
    return loc.progress(queries, links)


@query(
    "J21_S06_queue_sync_and_ids",
    """SELECT e.event_id AS id, count(*) AS members FROM (SELECT event_id, unnest(string_split(ids, '|')) AS m FROM
    (SELECT event_id, cast(user_id AS varchar) || '|' || event_type AS ids FROM events)) e
    WHERE e.event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""",
)
def queue_sync(spark, sf):
    upstream = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("ids")
    )
    queue = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    fresh = loc.explode_ids(loc.sync_queue(queue, upstream))
    return fresh.groupBy("id").agg(F.count(F.lit(1)).alias("members"))


_SCORED = """SELECT o_custkey AS query_id, o_orderkey AS pos, (o_orderkey * 37 % 1000) / 1e3 - 0.05e0 AS score,
 CASE WHEN o_orderkey % 2 = 0 THEN 'road_and_number_agree' ELSE 'text_and_district' END AS reason,
 CASE WHEN o_orderkey % 3 = 0 THEN '门牌号' ELSE '道路' END AS level, o_orderpriority AS location FROM {orders}
 WHERE o_custkey % 9 <> 0"""


@query(
    "W09_choose_candidate",
    f"""WITH s AS ({_SCORED.format(orders='orders')}), r AS (SELECT *, row_number() OVER w AS rn,
      lead(score) OVER w AS nxt, count(*) OVER (PARTITION BY query_id) AS n FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, pos)),
    b AS (SELECT *, score - coalesce(nxt, -1) AS margin, CASE WHEN score < 0 THEN 'candidate_conflict'
      WHEN n > 1 AND (score < 0.72 OR score - nxt < 0.15) THEN 'ambiguous' WHEN n = 1 AND score < 0.35 THEN 'weak_text_match'
      ELSE 'selected' END AS outcome FROM r WHERE rn = 1)
    SELECT c_custkey AS query_id, coalesce(outcome, 'unmatched') AS outcome, CASE WHEN outcome = 'selected' THEN location END AS location,
    round(score, 4) AS match_score, round(margin, 4) AS candidate_margin, CASE WHEN outcome = 'selected' THEN 'direct' END AS match_method,
    CASE WHEN query_id IS NULL THEN NULL WHEN level = '门牌号' AND reason = 'road_and_number_agree'
      THEN 'door_or_building_unverified' ELSE 'coarse_or_fuzzy_unverified' END AS match_quality
    FROM customer LEFT JOIN b ON query_id = c_custkey""",
)
def choose(spark, sf):
    """Candidates of orders for all customers; those of every ninth customer are malformed and so not valid."""
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"))
    return loc.choose(spark.sql(_SCORED, orders=table(spark, sf, "orders")), asked)


@query(
    "W10_provider_selection",
    f"""{_PAIRED}, t AS (SELECT *, {_plain('norm')} AS x, {_plain('text')} AS y, concat_ws(',', lon, lat) AS point FROM
      (SELECT cand.*, prof.* EXCLUDE (location_id, longitude, latitude) FROM cand JOIN prof USING (location_id))
      WHERE adcode LIKE '4401%' AND lon > 112.5e0 AND lon < 114.7e0 AND lat > 22e0 AND lat < 24.8e0 AND (ad = '' OR td = ad) AND (len(an) = 0 OR an[1] = tn[1])),
    {_ratio_sql('SELECT x, y FROM t')}, s AS (SELECT location_id, pos, point, {_STRICT} AS score FROM t JOIN ratio USING (x, y)),
    o AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS score2, lead(point) OVER w AS point2 FROM s WHERE score >= 0.55e0 WINDOW w AS (PARTITION BY location_id ORDER BY score DESC, pos))
    SELECT q.location_id, CASE WHEN o.k IS NULL THEN 'candidate_conflict_or_insufficient_anchor'
      WHEN score - score2 < 0.15e0 AND point <> point2 THEN 'ambiguous' ELSE 'selected' END AS outcome, point AS location, round(score, 6) AS match_score
    FROM (SELECT DISTINCT location_id FROM cand) q LEFT JOIN o ON q.location_id = o.location_id AND o.k = 1""",
)
def provider_selection(spark, sf):
    rows = candidates(spark, sf).join(addresses(spark, sf).select("location_id", "address"), "location_id")
    rows = rows.withColumn("district", ad.district(F.col("text"))).withColumn(
        "location", F.concat_ws(",", F.col("lon").cast("string"), F.col("lat").cast("string"))
    )
    return loc.provider_select(rows, "location_id").withColumn("match_score", F.round("match_score", 6))


@query(
    "W11_J26_best_of_pool",
    f"""{_PAIRED}, t AS (SELECT *, {_cityless('norm')} AS x, {_cityless('text')} AS y FROM pair
      WHERE segment = 'MACHINERY' AND (adcode = '' OR adcode LIKE '4401%') AND lon > 112.5e0 AND lon < 114.7e0 AND lat > 22e0 AND lat < 24.8e0),
    {_ratio_sql('SELECT x, y FROM t')}, s AS (SELECT *, {_LOOSE.format(accepted='pos % 17 = 0')} AS fuzzy_score, pos % 17 = 0 AS accepted FROM t JOIN ratio USING (x, y)),
    o AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY fuzzy_score DESC, text DESC, adcode DESC, level DESC, lon DESC, lat DESC, accepted DESC) AS k FROM s WHERE fuzzy_score IS NOT NULL)
    SELECT location_id, fuzzy_score, text, 'amap' AS provider, adcode, level, lon, lat, accepted FROM o WHERE k = 1 AND (accepted OR fuzzy_score >= 0.35e0)""",
)
def pool_best(spark, sf):
    rows = addresses(spark, sf).withColumn("longitude", F.when(F.col("segment") != "MACHINERY", F.col("longitude")))
    pool = candidates(spark, sf).select(
        "location_id", "text", "adcode", "level", "lon", "lat", F.lit("amap").alias("provider"),
        (F.col("pos") % 17 == 0).alias("accepted"),
    )
    return loc.best_of_pool(loc.missing_pool(rows, pool))


@query(
    "W11_best_by_score",
    f"""WITH s AS ({_SCORED.format(orders='orders')}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY score DESC, location DESC, reason DESC) AS rn FROM s)
    SELECT query_id AS location_id, round(score, 4) AS fuzzy_score, location AS text, reason AS provider FROM r
    WHERE rn = 1 AND (level = '门牌号' OR score >= 0.9)""",
)
def best_by_score(spark, sf):
    rows = spark.sql(_SCORED, orders=table(spark, sf, "orders")).select(
        F.col("query_id").alias("location_id"), F.col("score").alias("fuzzy_score"), F.col("location").alias("text"),
        F.col("reason").alias("provider"), (F.col("level") == "门牌号").alias("accepted"),
    )
    out = loc.best_of_pool(rows, least=0.9)
    return out.select("location_id", F.round("fuzzy_score", 4).alias("fuzzy_score"), "text", "provider")


# ---------------------------------------------------------------- references and fallbacks

_PLACES = f"""toks AS (SELECT *, {_district('norm')} AS d FROM addr),
 rests AS (SELECT *, CASE WHEN d <> '' THEN substr(norm, instr(norm, d) + length(d)) ELSE replace(replace(norm, '广东省', ''), '广州市', '') END AS rest FROM toks),
 towns AS (SELECT *, regexp_extract(rest, '^([{_HAN}]{{2,12}}?(?:街道|镇))', 1) AS t FROM rests),
 vills AS (SELECT *, regexp_extract(substr(rest, length(t) + 1), '^([{_HAN}]{{2,16}}?(?:社区|村|小区|花园))', 1) AS v FROM towns),
 keyed AS (SELECT location_id, segment, longitude, latitude, unnest(['village','town','district','city']) AS level,
   unnest([CASE WHEN d <> '' AND t <> '' AND v <> '' THEN d || '|' || t || '|' || v END,
           CASE WHEN d <> '' AND t <> '' THEN d || '|' || t END, nullif(d, ''), '广州市']) AS place FROM vills),
 refs AS (SELECT level, place, count(*) AS support, quantile_cont(longitude, 0.5) AS x, quantile_cont(latitude, 0.5) AS y
   FROM keyed WHERE place IS NOT NULL AND segment <> 'MACHINERY' GROUP BY 1, 2 HAVING count(*) >= 3)"""


def located(spark, sf):
    rows = addresses(spark, sf).withColumn("address", ad.normalise(F.col("address")))
    # One market segment stands for the locations that have no coordinates yet.
    missing = F.col("segment") == "MACHINERY"
    return rows.filter(~missing), rows.filter(missing)


@query(
    "A23_reference_points",
    f"WITH {_ADDR}, {_PLACES} SELECT level, place, support, round(x, 6) AS ref_longitude, round(y, 6) AS ref_latitude FROM refs",
)
def reference_points(spark, sf):
    out = loc.reference_points(located(spark, sf)[0])
    return out.select(
        "level", "place", "support", F.round("ref_longitude", 6).alias("ref_longitude"), F.round("ref_latitude", 6).alias("ref_latitude")
    )


@query(
    "J18_hierarchical_fallback",
    f"""WITH {_ADDR}, {_PLACES}, j AS (SELECT k.location_id, r.*, row_number() OVER (PARTITION BY k.location_id ORDER BY
      CASE r.level WHEN 'village' THEN 1 WHEN 'town' THEN 2 WHEN 'district' THEN 3 ELSE 4 END) AS rn
      FROM keyed k JOIN refs r ON r.level = k.level AND r.place = k.place WHERE k.segment = 'MACHINERY')
    SELECT location_id, level, support, round(x, 6) AS ref_longitude, round(y, 6) AS ref_latitude FROM j WHERE rn = 1""",
)
def fallback(spark, sf):
    have, missing = located(spark, sf)
    out = loc.hierarchical_fallback(missing, loc.reference_points(have))
    return out.select(
        "location_id", "level", "support", F.round("ref_longitude", 6).alias("ref_longitude"), F.round("ref_latitude", 6).alias("ref_latitude")
    )


_ANCHOR = f"""anc AS (SELECT p.location_id, segment, longitude, latitude, ad AS d, ar[1] AS road, an[1] AS number,
 regexp_extract(regexp_replace(norm, '{_ADMIN}', '', 'g'), '([{_HAN}]{{2,10}}(?:街道|镇))', 1) AS town FROM prof p)"""


@query(
    "J15_house_anchor_reuse",
    f"""WITH {_ADDR}, {_PROFILED}, {_ANCHOR}, g AS (SELECT d, town, road, number, arg_min(longitude, location_id) AS lon,
      arg_min(latitude, location_id) AS lat, count(*) AS members FROM anc WHERE segment <> 'MACHINERY' AND road IS NOT NULL AND number IS NOT NULL
      GROUP BY 1, 2, 3, 4 HAVING max(longitude) - min(longitude) < 0.3e0 AND max(latitude) - min(latitude) < 0.3e0)
    SELECT a.location_id AS query_id, round(lon, 6) AS lon, round(lat, 6) AS lat, members FROM anc a JOIN g USING (d, town, road, number) WHERE a.segment = 'MACHINERY'""",
)
def house_reuse(spark, sf):
    have, missing = located(spark, sf)
    names = {"location_id": "query_id", "longitude": "lon", "latitude": "lat"}
    anchors = loc.house_anchors(have.withColumnsRenamed(names), spread=0.3)
    out = loc.reuse_house_anchor(missing.withColumnsRenamed(names), anchors)
    return out.select("query_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "members")


_ADMIN_POINTS = """SELECT DISTINCT '广东省广州市' || d || town || v || '1号' AS text, '440106' AS adcode,
  CASE WHEN v = '' THEN '乡镇' ELSE '村庄' END AS level, CASE WHEN town = '东沙镇' AND v <> '' THEN d || '/' || k ELSE d END AS location
  FROM (SELECT {district} AS d, {town} AS town, CASE WHEN c_custkey % 2 = 0 THEN '石溪村' ELSE '' END AS v, c_custkey % 2 AS k,
  c_custkey FROM {customer}) t"""


def _admin_sql(customer):
    return _ADMIN_POINTS.format(
        district=_pick("c_nationkey", _DISTRICTS), town=_pick("c_custkey", _TOWNS[:3]), customer=customer
    )


_ADMIN_REFS = f"""pts AS ({_admin_sql('customer')}), refx AS (SELECT regexp_replace(replace(text, '广东省', ''), '[0-9].*$', '') AS prefix,
 {_district('text')} AS d, min(location) AS location, min(level) AS level FROM pts GROUP BY 1, 2
 HAVING min(location) = max(location) AND length(prefix) >= 9)"""


def admin(spark, sf):
    return loc.admin_references(spark.sql(_admin_sql("{customer}"), customer=table(spark, sf, "customer")))


@query("J17_admin_references", f"WITH {_ADMIN_REFS} SELECT prefix, d AS district, location, level FROM refx")
def admin_references(spark, sf):
    return admin(spark, sf)


@query(
    "J16_longest_prefix",
    f"""WITH {_ADDR}, {_ADMIN_REFS}, t AS (SELECT location_id, replace(norm, '广东省', '') AS t, {_district('norm')} AS d FROM addr),
    h AS (SELECT t.location_id, r.*, row_number() OVER (PARTITION BY t.location_id ORDER BY length(prefix) DESC, prefix DESC) AS rn
      FROM t JOIN refx r ON r.d = t.d AND contains(t.t, r.prefix))
    SELECT location_id AS query_id, prefix, location, level FROM h WHERE rn = 1""",
)
def longest_prefix(spark, sf):
    rows = addresses(spark, sf).select(F.col("location_id").alias("query_id"), ad.normalise(F.col("address")).alias("address"))
    return loc.longest_prefix(rows, admin(spark, sf))


# ---------------------------------------------------------------- audit and tiers


@query("J14_J19_P08_location_audit")
def audit(spark, sf):
    return audited_now(spark, sf)


def audited(spark, sf):
    return keep(spark, (sf, "audited"), lambda: stable(audited_now(spark, sf)))


def audited_now(spark, sf):
    rows = addresses(spark, sf)
    quality = {0: "door_or_building_unverified", 1: "coarse_or_fuzzy_unverified", 2: "village_reference_only"}
    picked = F.coalesce(*[F.when(F.col("location_id") % 3 == i, F.lit(v)) for i, v in quality.items()])
    rows = rows.select(
        "*",
        F.col("longitude").alias("gcj_lon"),
        F.col("latitude").alias("gcj_lat"),
        F.lit("existing_amap").alias("coordinate_source"),
        F.when(F.col("location_id") % 5 == 0, "门牌号").otherwise("道路").alias("provider_level"),
        picked.alias("match_quality"),
        F.lit("").alias("fuzzy_level"),
        F.lit("EPSG:4326").alias("crs"),
        ad.normalise(F.col("address")).alias("request"),
    )
    cached = candidates(spark, sf).withColumn("provider", F.lit("amap")).join(
        rows.select("location_id", F.col("request").alias("address")), "location_id"
    )
    direct = F.col("level").isin("门牌号", "道路")
    by_address = cached.filter(direct).drop("location_id")
    by_location = cached.filter(~direct).drop("address")
    pool = loc.candidate_pool(rows.select("location_id", "request", "address"), by_address, by_location)
    return loc.audit_locations(rows.drop("request"), pool)


@query("P07_T02_A25_location_tiers")
def tier_counts(spark, sf):
    return loc.tier_totals(loc.tiers(audited(spark, sf)))


@query("V05_location_invariants", "SELECT c_custkey AS location_id FROM customer WHERE c_custkey % 43 = 0 OR c_custkey % 47 = 0")
def location_invariants(spark, sf):
    """Eligibility against the verification, and tiers that don't add up, are planted by the location's key."""
    key = F.col("location_id")
    rows = loc.tiers(audited(spark, sf)).withColumn("main_eligible", F.when(key % 43 == 0, 1 - F.col("verified_within_1km")).otherwise(F.col("main_eligible")))
    rows = rows.withColumn("sensitivity_eligible", F.when(key % 47 == 0, F.col("sensitivity_core_eligible") + F.col("sensitivity_coarse_eligible") + 1).otherwise(F.col("sensitivity_eligible")))
    return validate.location_violations(rows).select("location_id")


@query(
    "V06_coordinates_unchanged",
    """SELECT c_custkey AS location_id, 'lost' AS change FROM customer WHERE c_custkey % 37 = 0
    UNION ALL SELECT c_custkey, 'changed' FROM customer WHERE c_custkey % 41 = 0 AND c_custkey % 37 <> 0
    UNION ALL SELECT -c_custkey - 1, 'gained' FROM customer WHERE c_custkey % 53 = 0""",
)
def unchanged(spark, sf):
    """Lost, gained and changed locations are planted among the audited ones."""
    key = F.col("location_id")
    after = loc.tiers(audited(spark, sf)).select("location_id", "longitude", "latitude")
    gained = after.filter(key % 53 == 0).withColumn("location_id", -key - 1)
    moved = after.filter(key % 37 != 0).withColumn("longitude", F.when(key % 41 == 0, F.coalesce("longitude", F.lit(0.0)) + 1).otherwise(F.col("longitude")))
    return validate.changed_rows(addresses(spark, sf), moved.unionByName(gained), "location_id", ["longitude", "latitude"])


_AUDIT_SQL = """SELECT c_custkey AS location_id, {level} AS provider_level, {quality} AS match_quality, {fuzzy} AS fuzzy_level,
 CASE WHEN c_custkey % 9 = 0 THEN 'local_matched_address_reference' ELSE 'existing_amap' END AS coordinate_source,
 CASE WHEN c_custkey % 31 = 0 THEN 'GCJ02' ELSE 'EPSG:4326' END AS crs, 113e0 AS longitude, 23e0 AS latitude,
 cast(c_custkey % 10 = 0 AS int) AS district_conflict, cast(c_custkey % 14 = 0 AS int) AS road_conflict,
 0 AS house_number_conflict, cast(c_custkey % 22 = 0 AS int) AS building_number_conflict,
 cast(c_custkey % 8 = 0 AS int) AS district_evidence_missing, cast(c_custkey % 5 <> 0 AS int) AS candidate_evidence_found,
 cast(c_custkey % 12 = 0 AS int) AS multiple_plausible_locations, cast(c_custkey % 3 = 1 AS int) AS independently_verified_within_1km,
 c_custkey % 2 = 1 AS passed FROM {customer}"""


def _audit_sql(customer):
    return _AUDIT_SQL.format(
        level=_pick("c_custkey", ["门牌号", "道路", "村庄", "乡镇", "楼宇", "兴趣点", "9"]),
        quality=_pick(_int("c_custkey / 7"), ["coarse_or_fuzzy_unverified", "door_or_building_unverified", "village_reference_only"]),
        fuzzy=_pick(_int("c_custkey / 5"), ["", "", "city_reference", "town_reference", "district_reference", "fuzzy_candidate"]),
        customer=customer,
    )


_CATEGORY = """CASE WHEN fuzzy_level LIKE '%city_reference%' THEN 'city_reference' WHEN fuzzy_level LIKE '%district_reference%' THEN 'district_reference'
 WHEN fuzzy_level LIKE '%town_reference%' OR provider_level IN ('乡镇','街道') THEN 'township_street_reference'
 WHEN match_quality LIKE '%village_reference%' OR provider_level = '村庄' THEN 'village_community_reference'
 WHEN provider_level IN ('门牌号','门址','9') OR match_quality LIKE '%door_or_building%' THEN 'door_building_candidate'
 WHEN provider_level IN ('10','11','住宅区','商务住宅','楼宇') THEN 'building_poi_candidate'
 WHEN provider_level IN ('道路','路','7') THEN 'road_reference' ELSE 'fuzzy_candidate' END"""
_AUDITED = f"""aud0 AS (SELECT *, {_CATEGORY} AS audit_category, district_conflict + road_conflict + building_number_conflict > 0 AS bad,
   multiple_plausible_locations = 1 AS amb FROM ({_audit_sql('customer')})),
 aud AS (SELECT *, CASE WHEN audit_category LIKE '%reference' THEN 'reference_only' WHEN bad THEN 'address_conflict'
   WHEN amb THEN 'multiple_plausible_locations' WHEN passed THEN 'text_consistent_spatial_unverified'
   ELSE 'insufficient_address_evidence' END AS audit_disposition,
   CASE WHEN audit_category = 'door_building_candidate' AND (bad OR amb) THEN 1
   WHEN bad OR amb OR (audit_category IN ('door_building_candidate','building_poi_candidate') AND NOT passed) THEN 2
   WHEN audit_category LIKE '%reference' OR NOT passed THEN 3 ELSE 4 END AS review_priority FROM aud0)"""


def synthetic_audit(spark, sf):
    rows = spark.sql(_audit_sql("{customer}"), customer=table(spark, sf, "customer"))
    bad = (F.col("district_conflict") + F.col("road_conflict") + F.col("building_number_conflict")) > 0
    rows = rows.withColumns(
        {"audit_category": loc.category(), "conflict": bad, "ambiguous": F.col("multiple_plausible_locations") == 1}
    )
    return rows.select("*", loc.disposition().alias("audit_disposition"), loc.review_priority().alias("review_priority"))


@query(
    "P08_T02_audit_labels_and_queue",
    f"WITH {_AUDITED} SELECT location_id, audit_category, audit_disposition, review_priority FROM aud WHERE review_priority <= 2",
)
def labels(spark, sf):
    return loc.review_queue(synthetic_audit(spark, sf)).select(
        "location_id", "audit_category", "audit_disposition", "review_priority"
    )


_TIERS = """til AS (SELECT *, crs = 'EPSG:4326' AS valid, audit_disposition = 'text_consistent_spatial_unverified' AND crs = 'EPSG:4326' AND NOT bad AND NOT amb AS core,
  crs = 'EPSG:4326' AND audit_category IN ('road_reference','township_street_reference','village_community_reference') AND candidate_evidence_found = 1
   AND district_evidence_missing = 0 AND NOT bad AND NOT amb AND coordinate_source <> 'local_matched_address_reference' AS coarse,
  audit_category IN ('door_building_candidate','building_poi_candidate') AS precise,
  audit_category IN ('city_reference','district_reference') OR coordinate_source = 'local_matched_address_reference' AS imputed FROM aud),
 tie AS (SELECT *, CASE WHEN imputed THEN 'excluded_reference_imputation' WHEN core AND precise AND independently_verified_within_1km = 1 THEN 'main_qualified'
  WHEN core AND precise THEN 'primary_candidate_pending_spatial_validation' WHEN core THEN 'sensitivity_text_consistent_fuzzy'
  WHEN coarse THEN 'sensitivity_coarse_reference' ELSE 'excluded_pending_quality_review' END AS analysis_tier FROM til)"""


@query(
    "P07_A25_tiers",
    f"""WITH {_AUDITED}, {_TIERS} SELECT analysis_tier, count(*) AS n,
    count(*) FILTER (NOT imputed AND core AND precise AND independently_verified_within_1km = 1) AS main_eligible,
    count(*) FILTER (NOT imputed AND core AND precise AND independently_verified_within_1km = 0) AS primary_candidate_pending_validation,
    count(*) FILTER (NOT imputed AND (core OR coarse)) AS sensitivity_eligible, count(*) FILTER (NOT imputed AND core) AS sensitivity_core_eligible,
    count(*) FILTER (NOT imputed AND coarse) AS sensitivity_coarse_eligible FROM tie GROUP BY 1""",
)
def tier_totals(spark, sf):
    return loc.tier_totals(loc.tiers(synthetic_audit(spark, sf)))


@query(
    "P07_eligibility_reasons",
    f"""WITH {_AUDITED}, {_TIERS} SELECT location_id, analysis_tier, coalesce(nullif(array_to_string(list_filter([
      CASE WHEN NOT valid THEN 'invalid_coordinate_or_crs' END, CASE WHEN district_conflict = 1 THEN 'district_conflict' END,
      CASE WHEN road_conflict = 1 THEN 'road_conflict' END, CASE WHEN building_number_conflict = 1 THEN 'building_number_conflict' END,
      CASE WHEN amb THEN 'multiple_plausible_locations' END,
      CASE WHEN candidate_evidence_found <> 1 THEN 'saved_coordinate_candidate_evidence_missing' END,
      CASE analysis_tier WHEN 'excluded_reference_imputation' THEN 'reference_imputation_not_individual_residence'
        WHEN 'primary_candidate_pending_spatial_validation' THEN 'within_1km_not_verified'
        WHEN 'sensitivity_text_consistent_fuzzy' THEN 'unverified_or_fuzzy_candidate'
        WHEN 'sensitivity_coarse_reference' THEN 'coarse_reference_position_only'
        WHEN 'excluded_pending_quality_review' THEN 'address_consistency_or_specificity_insufficient' END],
      lambda x: x IS NOT NULL), ';'), ''), 'validated_precise_address') AS eligibility_reason FROM tie""",
)
def reasons(spark, sf):
    return loc.tiers(synthetic_audit(spark, sf)).select("location_id", "analysis_tier", "eligibility_reason")


def spread_points(spark, sf):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        c.alias("location_id"), k.alias("ord"), (F.lit(113.0) + (k % 13) * 4e-4).alias("lon"), (F.lit(23.0) + (k % 7) * 4e-4).alias("lat")
    )


_POINTS = "pts AS (SELECT o_custkey AS location_id, o_orderkey AS ord, 113e0 + (o_orderkey % 13) * 4e-4 AS lon, 23e0 + (o_orderkey % 7) * 4e-4 AS lat FROM orders)"
_M = "2 * 6371008.8e0 * asin(sqrt(least(1e0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


@query(
    "A24_leader_clusters",
    f"""WITH RECURSIVE {_POINTS},
    step AS (SELECT location_id, [min(ord)] AS led FROM pts GROUP BY 1
      UNION ALL SELECT * FROM (SELECT s.location_id, list_append(s.led, (SELECT min(p.ord) FROM pts p WHERE p.location_id = s.location_id
        AND p.ord > s.led[-1] AND NOT EXISTS (SELECT 1 FROM pts l WHERE l.location_id = p.location_id AND list_contains(s.led, l.ord)
          AND {_M.format(a='l', b='p')} <= 100))) AS led FROM step s) WHERE led[-1] IS NOT NULL),
    fin AS (SELECT location_id, arg_max(led, len(led)) AS led FROM step GROUP BY 1),
    lead AS (SELECT p.* FROM pts p JOIN fin f ON f.location_id = p.location_id AND list_contains(f.led, p.ord)),
    far AS (SELECT a.location_id, max({_M.format(a='a', b='b')}) AS m FROM lead a JOIN lead b ON a.location_id = b.location_id GROUP BY 1)
    SELECT location_id, len(led) AS clusters, round(m, 2) AS max_separation_m FROM fin JOIN far USING (location_id)""",
)
def leader_clusters(spark, sf):
    found = clusters.leaders(spread_points(spark, sf), "location_id", "ord", "lon", "lat")
    out = clusters.separation(found, "location_id")
    return out.withColumn("max_separation_m", F.round("max_separation_m", 2))


@query(
    "J03_J04_event_tier_join",
    f"""WITH {_AUDITED}, {_TIERS} SELECT o_orderstatus AS status, analysis_tier, count(*) AS events
    FROM orders LEFT JOIN tie ON o_custkey = location_id GROUP BY 1, 2""",
)
def event_tiers(spark, sf):
    tiers = loc.tiers(synthetic_audit(spark, sf)).select("location_id", "analysis_tier")
    events = table(spark, sf, "orders").select(F.col("o_custkey").alias("location_id"), F.col("o_orderstatus").alias("status"))
    joined = events.join(tiers, "location_id", "left")
    return joined.groupBy("status", "analysis_tier").agg(F.count(F.lit(1)).alias("events"))
