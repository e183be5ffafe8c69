"""Registry-like inputs derived from the driver tables.

The derivations are one SQL text rendered in two dialects, so that a query and its twin start
from the same rows. They hold only the stand-in data; all processing is done by the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchstrata.core import partitions
from matchstrata.operators.registry import DUP_CARD, DUP_EVENT
from matchstrata.catalog.base import table


class SparkDialect:
    @staticmethod
    def plus(d: str, n: str) -> str:
        return f"date_add({d}, cast({n} as int))"

    @staticmethod
    def diff(a: str, b: str) -> str:
        return f"datediff({a}, {b})"

    @staticmethod
    def ymd(d: str) -> str:
        return f"date_format({d}, 'yyyyMMdd')"

    @staticmethod
    def num(x: str) -> str:
        return f"cast({x} as string)"


    @staticmethod
    def apart(x: str) -> str:
        """As ``core.apart``: the projection is compiled in small methods."""
        return f"get(transform(array({x}), v -> v), 0)"


class DuckDialect(SparkDialect):
    @staticmethod
    def apart(x: str) -> str:
        return x

    @staticmethod
    def plus(d: str, n: str) -> str:
        return f"({d} + cast({n} as integer))"

    @staticmethod
    def diff(a: str, b: str) -> str:
        return f"datediff('day', {b}, {a})"

    @staticmethod
    def ymd(d: str) -> str:
        return f"strftime({d}, '%Y%m%d')"

    @staticmethod
    def num(x: str) -> str:
        return f"cast({x} as varchar)"


def _pick(expr: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE ({expr}) % {len(values)} {whens} END"


def registry_sql(q, orders: str = "orders", customer: str = "customer") -> str:
    """Raw registry rows from orders and customers."""
    k, c = "o_orderkey", "c_custkey"
    d = "cast(o_orderdate as date)"
    iso = q.num(d)
    slashed = f"replace({iso}, '-', '/')"
    serial = q.num(q.diff(d, "date '1899-12-30'"))
    yy = f"lpad({q.num(f'{c} % 85 + 15')}, 2, '0')"
    mm = f"lpad({q.num(f'{c} % 12 + 1')}, 2, '0')"
    dd = f"lpad({q.num(f'{c} % 28 + 1')}, 2, '0')"
    id_dd = f"lpad({q.num(f'CASE WHEN {c} % 13 = 0 THEN 30 ELSE {c} % 28 + 1 END')}, 2, '0')"
    seq = f"lpad({q.num(f'{c} % 1000')}, 3, '0')"
    districts = ["荔湾区", "越秀区", "海珠区", "天河区", "白云区", "黄埔区", "番禺区", "花都区", "南沙区", "从化区", "增城区"]
    codes = ["I20.0", "I20.9", "I21.1", "I22.0", "I46.9", "I60.1", "I61.0", "I63.9", "I64", "I10", " i21.9", "I63.3"]
    texts = ["急性心肌梗死", "不稳定型 心绞痛", "稳定型心绞痛", "脑梗死", "脑出血后遗症", "陈旧性脑梗死", "蛛网膜下腔出血", "脑出血"]
    return f"""
    SELECT
      {q.apart(f'year({d})')} AS source_year,
      {k} AS source_row,
      CASE WHEN {k} % 40 = 7 THEN 'n/a'
           WHEN {k} % 5 = 0 THEN {iso}
           WHEN {k} % 5 = 1 THEN {slashed}
           WHEN {k} % 5 = 2 THEN {q.ymd(d)}
           WHEN {k} % 5 = 3 THEN {iso} || ' 08:30:00'
           ELSE {serial} END AS onset,
      '19' || {yy} || '-' || {mm} || '-' || {dd} AS birth,
      {q.num(q.plus(d, f"{k} % 97 - 3"))} AS report_date,
      {q.num(q.plus(d, f"{k} % 6 - 1"))} AS diagnosis_date,
      CASE WHEN {c} % 7 = 0 THEN '' WHEN {c} % 2 = 1 THEN '男' ELSE ' 女' END AS sex,
      {_pick(k, codes)} AS icd10,
      {_pick(f"cast(floor({k} / 3) as bigint)", texts)} AS diagnosis_text,
      CASE WHEN {c} % 10 = 9 THEN 'X' || {q.num(c)}
           WHEN {c} % 5 < 3 THEN '440103' || {yy} || {mm} || {id_dd} || {seq}
           ELSE '440106' || '19' || {yy} || {mm} || {id_dd} || {seq}
                || substr('10x98765432', cast({c} % 11 + 1 as int), 1) END AS identity,
      CASE WHEN {c} % 50 = 4 THEN 1 ELSE 0 END AS identity_is_number,
      CASE WHEN {k} % 9 = 0 THEN '' ELSE 'C ' || {q.num(f"cast(floor({k} / 4) as bigint)")} END AS card_no,
      CASE WHEN o_orderstatus = 'P' THEN '待审核'
           WHEN o_orderstatus = 'O' AND {k} % 10 = 0 THEN '审核不通过' ELSE '已终审' END AS review_status,
      CASE WHEN {k} % 23 = 0 THEN '是' WHEN {k} % 23 = 1 THEN '#NUM!' WHEN {k} % 23 = 2 THEN '1.0' ELSE '否' END
        AS duplicate_flag,
      {_pick(k, ["是", "否", ""])} AS first_onset_flag,
      {_pick(f"cast(floor({k} / 5) as bigint)", ["", "行PCI术", "植入支 架", "cabg 搭桥", "药物"])} AS treatment,
      '广东省' AS addr_province,
      CASE WHEN {c} % 12 = 0 THEN '佛山市' ELSE '广州市' END AS addr_city,
      {_pick("c_nationkey", districts)} AS addr_district,
      CASE WHEN {c} % 17 = 0 THEN '' ELSE {_pick(c, ["石牌街道", "东沙镇", "沙河街道"])} END AS addr_street,
      CASE WHEN {c} % 3 = 0 AND {c} % 17 <> 0 THEN {_pick(f"cast(floor({c} / 3) as bigint)", ["东港　社区", "石溪村"])}
           ELSE '' END AS addr_community,
      CASE WHEN {c} % 17 = 0 THEN ''
           WHEN {c} % 4 = 0 THEN '无'
           WHEN {c} % 4 = 1 THEN '' ELSE '中山大道' || {q.num(f"{c} % 200 + 1")} || '号' END AS addr_number
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey
    """


def registry_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Few tasks read a file of few row groups, and would type and write all of its records; so orders are dealt out first.
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return spark.sql(
        registry_sql(SparkDialect, "{orders}", "{customer}"),
        orders=orders.repartition(partitions(spark), "o_orderkey", "o_custkey", "o_orderdate"),
        customer=table(spark, sf_dir, "customer"),
    )


# The twin's own reading of the raw rows: cleaning, dates, age, identity, all in plain SQL.
_CHECK = " + ".join(
    f"{w} * cast(substr(id17, {i + 1}, 1) as integer)"
    for i, w in enumerate([7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2])
)


def _clean(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '[\\s\\u3000]+', '', 'g')".replace("\\u3000", "　")


def _duck_date(c: str) -> str:
    t = _clean(c)
    return (
        f"CASE WHEN regexp_full_match({t}, '[0-9]{{1,5}}') THEN date '1899-12-30' + cast({t} as integer) "
        f"ELSE cast(coalesce(try_strptime({t}, '%Y-%m-%d'), try_strptime({t}, '%Y/%m/%d'), "
        f"try_strptime({t}, '%Y%m%d'), try_strptime({t}, '%Y-%m-%d%H:%M:%S')) as date) END"
    )


def _rounds(n: int = 8) -> str:
    """Greedy de-duplication in unrolled rounds: rows that are first in both their groups stay, what meets them goes.

    ``judged`` has every screened row with '' or the key it lost by, ``ev`` the rows that stay; a row that is still undecided
    after the last round makes the query fail.
    """
    cols = "event_id, source_year, source_row, card_token, person_id, onset, disease"
    out = [f"left0 AS MATERIALIZED (SELECT {cols} FROM passed)"]
    for k in range(n):
        out.append(
            f"""mark{k} AS MATERIALIZED (SELECT *,
    (card_token IS NULL OR row_number() OVER (PARTITION BY source_year, card_token ORDER BY source_row) = 1)
    AND row_number() OVER (PARTITION BY person_id, onset, disease ORDER BY source_year, source_row) = 1 AS leads FROM left{k}),
  left{k + 1} AS MATERIALIZED (SELECT {cols} FROM mark{k} m WHERE NOT leads
    AND NOT EXISTS (FROM mark{k} c WHERE c.leads AND c.source_year = m.source_year AND c.card_token = m.card_token)
    AND NOT EXISTS (FROM mark{k} c WHERE c.leads AND c.person_id = m.person_id AND c.onset = m.onset AND c.disease = m.disease))"""
        )
    kept = " UNION ALL ".join(f"SELECT {cols} FROM mark{k} WHERE leads" for k in range(n))
    out.append(f"stay AS MATERIALIZED ({kept})")
    out.append(
        f"""judged AS MATERIALIZED (SELECT p.event_id, p.source_year, CASE
    WHEN EXISTS (FROM stay c WHERE c.source_year = p.source_year AND c.card_token = p.card_token AND c.source_row < p.source_row) THEN '{DUP_CARD}'
    WHEN EXISTS (FROM stay c WHERE c.person_id = p.person_id AND c.onset = p.onset AND c.disease = p.disease
      AND (c.source_year < p.source_year OR c.source_year = p.source_year AND c.source_row < p.source_row)) THEN '{DUP_EVENT}'
    ELSE '' END AS lost FROM passed p WHERE CASE WHEN (SELECT count(*) FROM left{n}) > 0 THEN error('undecided rows') ELSE true END)"""
    )
    out.append("ev AS (SELECT p.* FROM passed p JOIN judged j USING (event_id) WHERE j.lost = '')")
    return ", ".join(out)


REGISTRY_CTE = f"""
raw AS ({registry_sql(DuckDialect)}),
typed AS (
  SELECT source_year, source_row,
    'E' || source_year || '_' || lpad(cast(source_row as varchar), 7, '0') AS event_id,
    {_duck_date("onset")} AS onset, {_duck_date("birth")} AS birth,
    {_duck_date("report_date")} AS report_date, {_duck_date("diagnosis_date")} AS diagnosis_date,
    {_clean("sex")} AS sex, upper({_clean("icd10")}) AS icd10, {_clean("diagnosis_text")} AS diagnosis_text,
    upper({_clean("identity")}) AS identity, identity_is_number AS id_numeric_storage,
    {_clean("card_no")} AS card_no, {_clean("review_status")} AS review_status,
    {_clean("duplicate_flag")} AS duplicate_flag, {_clean("first_onset_flag")} AS first_onset_flag,
    {_clean("treatment")} AS treatment,
    {_clean("addr_province")} AS p1, {_clean("addr_city")} AS p2, {_clean("addr_district")} AS p3,
    {_clean("addr_street")} AS p4, {_clean("addr_community")} AS p5, {_clean("addr_number")} AS p6
  FROM raw),
ids AS (
  SELECT *, CASE WHEN length(identity) = 15 THEN substr(identity, 1, 6) || '19' || substr(identity, 7, 9)
                 ELSE substr(identity, 1, 17) END AS id17,
    regexp_full_match(identity, '[0-9]{{15}}') AS is15,
    regexp_full_match(identity, '[0-9]{{17}}[0-9X]') AS is18
  FROM typed),
checked AS (
  SELECT *, CASE WHEN is15 OR is18 THEN substr('10X98765432', cast(({_CHECK}) % 11 as integer) + 1, 1) END AS chk
  FROM ids),
born AS (
  SELECT *, CASE WHEN is15 OR (is18 AND chk = substr(identity, 18, 1))
                 THEN cast(try_strptime(substr(id17, 7, 8), '%Y%m%d') as date) END AS id_birth
  FROM checked),
reg AS (
  SELECT *, id_birth IS NOT NULL AS id_valid,
    CASE WHEN try_cast(substr(id17, 17, 1) as integer) % 2 = 1 THEN '男' ELSE '女' END AS id_sex,
    year(onset) AS year,
    year(onset) - year(birth)
      - CASE WHEN month(onset) < month(birth) OR (month(onset) = month(birth) AND day(onset) < day(birth))
             THEN 1 ELSE 0 END AS age,
    CASE WHEN regexp_matches(icd10, '^I[0-9][0-9]') THEN substr(icd10, 1, 3) ELSE '' END AS icd_prefix,
    CASE WHEN month(onset) IN (4,5,6,7,8,9) THEN '暖季' ELSE '冷季' END AS season,
    p1 || p2 || p3 || p4 || p5 || p6 AS address,
    CASE WHEN identity <> '' THEN 'person:' || identity END AS person_id,
    'location:' || p1 || p2 || p3 || p4 || p5 || p6 AS location_id,
    CASE WHEN card_no <> '' THEN 'card:' || card_no END AS card_token,
    CASE WHEN id_birth IS NOT NULL THEN 'canonical_person:' || id17 || chk END AS canonical_person_id
  FROM born),
registry AS (
  SELECT *, CASE icd_prefix WHEN 'I20' THEN '心绞痛（急性资格待核）' WHEN 'I21' THEN '急性心肌梗死'
      WHEN 'I22' THEN '急性心肌梗死' WHEN 'I46' THEN '心脏性猝死（定义待核）' WHEN 'I60' THEN '蛛网膜下腔出血'
      WHEN 'I61' THEN '脑出血' WHEN 'I63' THEN '脑梗死' WHEN 'I64' THEN '未特指卒中' END AS disease
  FROM reg),
screened AS (
  SELECT *, CASE
      WHEN onset IS NULL OR year(onset) <> source_year THEN '缺失无效或非对应年度发病日期'
      WHEN age IS NULL OR age < 0 OR age > 120 THEN '出生日期缺失或年龄异常'
      WHEN age < 18 THEN '年龄小于18岁'
      WHEN p2 NOT IN ('广州', '广州市') THEN '现住市非广州或缺失'
      WHEN disease IS NULL THEN '未映射ICD类别'
      WHEN NOT (is15 OR is18) THEN '缺少格式有效的身份证标识（待其他证件链接）'
      WHEN p4 || p5 || p6 = '' THEN '缺少街道及以下现住址'
      ELSE '' END AS reason
  FROM registry),
passed AS MATERIALIZED (SELECT * FROM screened WHERE reason = ''),
{_rounds()}
"""


def with_registry(sql: str, *ctes: str, recursive: bool = False) -> str:
    """A twin query that starts from the registry CTEs (registry, screened, ev)."""
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head} {', '.join([REGISTRY_CTE, *ctes])} {sql}"
