"""Mixing sources to target weights by systematic sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, stage


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> tuple[DataFrame, int]:
    """One row a source: its number by code point (null last), size, weight and target.

    The excess over ``most`` times a source's size is reshared by weight: each round caps the
    sources above it and needs one small aggregate; rounds end when none is newly capped.
    """
    sums = stage(sized.groupBy("mx_source").agg(F.sum("mx_size").alias("mx_total"), F.count(F.lit(1)).alias("mx_rows")))
    ordered = sums.orderBy(F.col("mx_source").asc_nulls_last())
    # A global sort numbers its rows by partition; the offsets are one row a partition.
    numbered = stage(ordered.withColumn("mx_mid", F.monotonically_increasing_id()))
    parts = numbered.groupBy(F.shiftright("mx_mid", 33).alias("mx_part")).agg(F.count(F.lit(1)).alias("mx_n"))
    before = parts.withColumn("mx_before", F.sum("mx_n").over(Window.orderBy("mx_part")) - F.col("mx_n"))
    no = F.col("mx_before") + F.col("mx_mid").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("mx_no") % len(weights) + 1).cast("int"))
    sources = stage(
        numbered.withColumn("mx_part", F.shiftright("mx_mid", 33)).join(before.select("mx_part", "mx_before"), "mx_part")
        .select("mx_source", "mx_total", "mx_rows", no.alias("mx_no")).withColumn("mx_weight", weight)
    )
    count, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("mx_total"), F.lit(0))).first()
    cap, weight = most * F.col("mx_total"), F.col("mx_weight")
    rest, open_weight, capped = share * total, None, -1
    level = F.lit(False)
    while True:
        row = sources.agg(
            F.count_if(level), F.coalesce(F.sum(F.when(level, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~level, weight)), F.lit(0)),
        ).first()
        if row[0] == capped:
            break
        capped, rest, open_weight = row[0], share * total - row[1], row[2]
        if not open_weight:
            break
        level = cap * open_weight < F.lit(rest) * weight
    aim = F.least(cap, F.lit(float(rest)) * weight / F.lit(float(open_weight))) if open_weight else cap
    return sources.withColumn("mx_target", aim.cast("double")), count


def systematic_mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17,
) -> DataFrame:
    """How often a mix takes each document: ``doc_id, source, size, source_size, target, copies, taken``.

    Each document of a source has the same expected number of copies, target / source_size.
    Within a source, documents stand by falling size (ties by doc_id), so that those near each
    other in the order are of one size; the prefix sum of the expected copies, plus one offset
    for each source drawn from ``seed``, is cut at the integers, and a document is emitted once
    for each integer it crosses. So a source misses its target by about one document at most.

    The order comes from one range shuffle of (source, size, doc_id), which splits a hot source;
    row numbers in each partition and one total a (partition, source) give the prefix sums.

    A null text has size 0, a null source is a source of its own and comes last, rows with equal
    doc_id count one by one, a null doc_id sorts first, and no rows give no rows.
    """
    sized = stage(docs.select(
        F.col("doc_id").alias("mx_id"), F.col("source").cast("string").alias("mx_source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("mx_size"),
    ))
    sources, count = source_targets(sized, weights, share, most)
    small = broadcast_if_small(sources, count)
    same = sized["mx_source"].eqNullSafe(small["mx_source"])
    placed = sized.join(small, same).select("mx_id", sized["mx_source"], "mx_size", "mx_no", "mx_total", "mx_target")
    parts = sized.sparkSession.conf.get("spark.sql.shuffle.partitions")
    order = [F.col("mx_no"), F.col("mx_size").desc(), F.col("mx_id").asc_nulls_first()]
    ranked = stage(
        placed.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
        .withColumn("mx_mid", F.monotonically_increasing_id()).withColumn("mx_part", F.shiftright("mx_mid", 33))
    )
    pieces = ranked.groupBy("mx_no", "mx_part").agg(F.min("mx_mid").alias("mx_first"), F.count(F.lit(1)).alias("mx_n"))
    before = F.sum("mx_n").over(Window.partitionBy("mx_no").orderBy("mx_part")) - F.col("mx_n")
    # One row for each source and for each partition boundary.
    pieces = broadcast_if_small(pieces.select("mx_no", "mx_part", (before - F.col("mx_first") + 1).alias("mx_shift")), count + int(parts))
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("mx_no").cast("string"))), 1, 13), 16, 10)
    offset = digest.cast("double") / F.lit(float(1 << 52))
    rank = (F.col("mx_mid") + F.col("mx_shift")).cast("double")
    rate = F.col("mx_target") / F.col("mx_total")
    copies = F.when(F.col("mx_total") > 0, F.floor(rank * rate + offset) - F.floor((rank - 1.0) * rate + offset)).otherwise(F.lit(0))
    return ranked.join(pieces, ["mx_no", "mx_part"]).select(
        F.col("mx_id").alias("doc_id"), F.col("mx_source").alias("source"), F.col("mx_size").alias("size"),
        F.col("mx_total").alias("source_size"), F.col("mx_target").alias("target"), copies.cast("long").alias("copies"),
    ).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_rows(docs: DataFrame, **options: object) -> DataFrame:
    """``docs`` with each row as often as ``systematic_mix`` takes it; all columns stay.

    Rows find their copies by doc_id and source. Where several rows have both alike, their copies are summed and dealt
    out again: row by row, the share of each, the remainder to the first. A null text, whose size is 0, is taken as often as
    its source's other documents; a null source or doc_id matches itself. No rows give no rows.
    """
    taken = systematic_mix(docs, **options).groupBy(F.col("doc_id").alias("mx_id"), F.col("source").alias("mx_from"))
    copies = taken.agg(F.sum("copies").alias("mx_copies"), F.count(F.lit(1)).alias("mx_rows")).where("mx_copies > 0")
    same = docs["doc_id"].eqNullSafe(copies["mx_id"]) & docs["source"].cast("string").eqNullSafe(copies["mx_from"])
    joined = docs.join(copies, same)
    # Nearly every document is one row; only repeated ones are numbered.
    alone = joined.where("mx_rows = 1").withColumn("mx_each", F.col("mx_copies"))
    number = F.row_number().over(Window.partitionBy("mx_id", "mx_from").orderBy(F.xxhash64(*docs.columns)))
    share = F.floor(F.col("mx_copies") / F.col("mx_rows")) + F.when(number <= F.col("mx_copies") % F.col("mx_rows"), 1).otherwise(0)
    repeated = joined.where("mx_rows > 1").withColumn("mx_each", share.cast("long"))
    both = alone.unionByName(repeated).where("mx_each > 0")
    return both.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("mx_each"))).alias("mx_copy")).drop("mx_copy")


#: The same rows by DuckDB: the level at which the excess is shared out, by sorted caps.
SYSTEMATIC_MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {documents}
), sums AS (
  SELECT source, SUM(size)::BIGINT AS total FROM sized GROUP BY source
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM sums
), weighed AS (
  SELECT *, [3, 1, 2][(no % 3 + 1)::BIGINT] AS weight FROM numbered
), levels AS (
  SELECT *, 1.5 * SUM(total) OVER () - COALESCE(SUM(2.0 * total) OVER w, 0.0) AS rest, SUM(weight) OVER u AS open_weight
  FROM weighed
  WINDOW w AS (ORDER BY 2.0 * total / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         u AS (ORDER BY 2.0 * total / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT rest::DOUBLE AS rest, open_weight::DOUBLE AS open_weight FROM levels WHERE 2.0 * total * open_weight >= rest * weight
  ORDER BY 2.0 * total / weight, no LIMIT 1
), targets AS (
  SELECT w.*, LEAST(2.0 * total, level.rest * weight / level.open_weight)::DOUBLE AS target,
         ('0x' || substr(md5('17:' || no::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 AS off
  FROM weighed w, level
), ranked AS (
  SELECT s.*, total, target, off,
         row_number() OVER (PARTITION BY no ORDER BY s.size DESC, s.doc_id ASC NULLS FIRST)::DOUBLE AS rank
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copied AS (
  SELECT *, CASE WHEN total > 0 THEN (floor(rank * (target / total) + off) - floor((rank - 1.0) * (target / total) + off))::BIGINT ELSE 0 END AS copies
  FROM ranked
)
SELECT doc_id, size, total AS source_size, target, copies * size AS taken FROM copied
"""
