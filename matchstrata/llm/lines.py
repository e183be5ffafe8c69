"""Removes lines that spread over many sites (boilerplate), all but their first occurrence."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchstrata.core import stored
from matchstrata.llm.base import query, signed, sliced, table

#: Sites on which a line must stand to count as boilerplate.
MIN_SITES = 8
#: log2 of a sketch's registers, and the part of the threshold within which a sketch's estimate is not trusted (over five standard errors).
LG_K, BAND = 12, 0.1
#: Boilerplate lines that are sent to the executors (24 bytes each); more of them are joined.
SENT = 200_000


def line_table(docs: DataFrame) -> DataFrame:
    """One row per line that isn't blank: doc_id, pos (from 0, blank lines counted), key of the line without spaces around it, source."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", F.trim("line").alias("line"), "source").where("line <> ''").select("doc_id", "pos", F.xxhash64("line").alias("key"), "source")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """key, doc_id and pos of the first occurrence of every line that stands on at least ``min_sites`` sources.

    One sketch per line, merged map-side and then by key, so a line that every document has is one row per task. Estimates
    clearly above the threshold decide; those near it are counted exactly, from the lines of these keys alone. A null source is no site.
    """
    lines = line_table(docs)
    spread = lines.groupBy("key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64("source"), F.lit(LG_K))).alias("sites"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "pos"))).alias("first"),
    )
    low, high = min(min_sites * (1 - BAND), min_sites - 1), max(min_sites * (1 + BAND), min_sites + 1)
    wide = stored(spread.where(F.col("sites") >= low))
    near = wide.where(F.col("sites") < high).select("key")
    exact = lines.join(near, "key", "left_semi").where("source is not null").select("key", "source").distinct().groupBy("key").agg(F.count("*").alias("n"))
    sure = wide.where(F.col("sites") >= high)
    return sure.unionByName(wide.join(exact.where(F.col("n") >= min_sites), "key", "left_semi").where(F.col("sites") < high)).select("key", "first.doc_id", "first.pos")


def without_lines(docs: DataFrame, found: DataFrame, sent: int = SENT) -> DataFrame:
    """``docs`` with the lines of ``found`` taken out of text, but for their first occurrence; adds lines_removed (long)."""
    spark, n = docs.sparkSession, found.count()
    plain = docs.withColumn("lines_removed", F.lit(0).cast("long"))
    if n == 0:
        return plain
    if n <= sent:
        first = spark.sparkContext.broadcast({r.key: (r.doc_id, r.pos) for r in found.collect()})

        def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, digest = first.value, xxhash.xxh64_intdigest
            for batch in sliced(batches):
                out, removed = [], []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    if text is None:
                        out.append(None)
                        removed.append(0)
                        continue
                    lines = text.split("\n")
                    keep = []
                    for pos, line in enumerate(lines):
                        bare = line.strip(" ")
                        at = kept.get(signed(digest(bare.encode(), 42))) if bare else None
                        if at is None or at == (doc, pos):
                            keep.append(line)
                    out.append(text if len(keep) == len(lines) else "\n".join(keep))
                    removed.append(len(lines) - len(keep))
                columns = dict(zip(batch.schema.names, batch.columns)) | {"text": pa.array(out, pa.string()), "lines_removed": pa.array(removed, pa.int64())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        return plain.mapInArrow(strip, plain.schema)
    # More lines than are sent: the positions to drop are found by a join on the line key and gathered per document and text.
    told = docs.withColumn("source", F.xxhash64("text").cast("string"))
    hits = (
        line_table(told)
        .join(found.select("key", F.col("doc_id").alias("first_doc"), F.col("pos").alias("first_pos")), "key")
        .where(~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("pos") == F.col("first_pos"))))
        .groupBy(F.col("doc_id").alias("hit_doc"), F.col("source").alias("hit_text"))
        .agg(F.collect_set("pos").alias("hit_pos"))
    )
    joined = plain.join(hits, plain["doc_id"].eqNullSafe(hits["hit_doc"]) & (F.xxhash64(plain["text"]).cast("string") == hits["hit_text"]), "left")
    kept = F.array_join(F.transform(F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains("hit_pos", s["i"])), lambda s: s["x"]), "\n")
    return joined.select(
        *[
            (F.when(F.col("hit_pos").isNull(), F.col("text")).otherwise(kept) if c == "text" else F.coalesce(F.size("hit_pos").cast("long"), F.lit(0).cast("long")) if c == "lines_removed" else plain[c]).alias(c)
            for c in plain.columns
        ]
    )


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, sent: int = SENT) -> DataFrame:
    """``docs`` (doc_id, text, source and any others) without the repeats of lines that stand on ``min_sites`` sources or more.

    The occurrence with the smallest (doc_id, position) stays, so one whole copy of each passage is left. Blank lines stay as they
    are. Rows without doc_id hold no first occurrence. A text of which nothing is left is empty, a null text null; every row comes
    out. A column lines_removed is added, in place of one of that name.
    """
    return without_lines(docs, stored(boilerplate(docs, min_sites)), sent)


@query(
    "op5_line_site_spread",
    f"""
    WITH l AS (
      SELECT doc_id, source, pos - 1 AS pos, lines[pos] AS line, trim(lines[pos], ' ') AS bare
      FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)
    ), b AS (
      SELECT bare, min({{'d': doc_id, 'p': pos}}) AS first FROM l WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= {MIN_SITES}
    ), k AS (
      SELECT l.doc_id, l.pos, l.line, b.bare IS NULL OR (b.first.d = l.doc_id AND b.first.p = l.pos) AS keep FROM l LEFT JOIN b USING (bare)
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS lines_removed,
      md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '')) AS text_md5
    FROM k GROUP BY doc_id
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = dedup_lines(docs.select("doc_id", "text", "source", F.size(F.split("text", "\n")).cast("long").alias("n_lines")))
    return out.select("doc_id", "n_lines", "lines_removed", F.md5("text").alias("text_md5"))
