"""Proportional stratified interleaving of rows into shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import documents, materialize


def _offsets(rows: DataFrame, part: list[str], bucket: str) -> DataFrame:
    """Rows before each bucket within ``part``: counts a bucket, then a running sum over those few counts."""
    counts = rows.groupBy(*part, bucket).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*[F.col(c) for c in part]).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _ranked(rows: DataFrame, part: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """Rank from 0 within ``part`` by (bucket, order), without sorting any part in one task."""
    own = Window.partitionBy(*[F.col(c) for c in [*part, bucket]]).orderBy(*order)
    numbered = rows.withColumn("__rn", F.row_number().over(own) - 1)
    offsets = _offsets(rows, part, bucket).drop("n")
    return numbered.join(offsets, [*part, bucket]).withColumn(name, (F.col("before") + F.col("__rn")).cast("long")).drop("before", "__rn")


def interleave(
    df: DataFrame,
    n_shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "source",
    seed: int = 42,
    rows_per_bucket: int = 20_000,
) -> DataFrame:
    """(id, stratum, size, text_crc32, position, shard, slot) for every row.

    Rows of a stratum are shuffled by a seeded hash and get the fractional rank
    (rank + 1/2) / rows; the sort by that rank is cut into ``n_shards`` runs whose
    lengths are at most one apart, so that each holds the strata in proportion.
    A null stratum is one of its own, a null text is empty.  Ties are broken by
    id, size and checksum; rows equal in all of these are interchangeable.  Ranks
    come from counts by hash range and a numbering inside each range, so no
    stratum is sorted in one task.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    ident, crc = F.col(f"`{id_col}`"), F.crc32(text)
    shuffle = F.xxhash64(ident.cast("string"), crc, F.lit(seed))
    rows = df.select(ident.alias("id"), F.concat(F.lit("="), F.col(f"`{stratum_col}`").cast("string")).alias("named"), (F.octet_length(text) + 1).cast("long").alias("size"), crc.alias("text_crc32"), shuffle.alias("h"))
    # A null stratum is no name, an empty one the name "=".
    rows = materialize(rows.withColumn("stratum", F.coalesce("named", F.lit(""))), "shard-rows")
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("n"))
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    ties = [F.col("h"), F.col("id"), F.col("size"), F.col("text_crc32")]
    # Hash ranges as equal parts of the signed 64-bit range.
    ranges = max(64, -(-most // rows_per_bucket))
    bucket = F.floor((F.shiftright("h", 11) + F.lit(1 << 52)) * float(ranges) / float(1 << 53))
    ranked = _ranked(rows.withColumn("range", bucket), ["stratum"], "range", ties, "rank").drop("range")
    ranked = ranked.join(sizes, "stratum")
    frac = (2 * F.col("rank") + 1).cast("double") / (2 * F.col("n")).cast("double")
    cuts = max(64, -(-total // rows_per_bucket))
    ranked = ranked.withColumn("frac", frac).withColumn("cut", F.least(F.lit(cuts - 1), F.floor(F.col("frac") * float(cuts))).cast("long"))
    ranked = ranked.withColumn("all", F.lit(0))
    order = [F.col("frac"), F.col("stratum"), *ties]
    placed = _ranked(ranked, ["all"], "cut", order, "position").drop("all", "cut", "frac", "rank", "n", "h")
    # Row p goes to the shard s with first(s) <= p < first(s + 1), first(s) = ceil(s * rows / shards).
    shard = F.expr(f"(position * {n_shards}L) div {max(1, total)}L").cast("int")
    first = F.expr(f"(cast(shard as bigint) * {max(1, total)}L + {n_shards - 1}L) div {n_shards}L")
    placed = placed.withColumn("stratum", F.substring("named", 2, 1 << 30)).drop("named")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("position") - first)


def write_shards(df: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``df`` as one folder a shard, each in the order of its slots.  Ids must be unique."""
    where = placed.select(F.col("id").alias("__id"), "shard", "slot")
    rows = df.drop("shard", "slot").join(where, F.col(f"`{id_col}`") == F.col("__id")).drop("__id")
    rows.repartition("shard", F.expr("slot div 100000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    out = interleave(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
