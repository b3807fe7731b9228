"""Joins, ranks, running sums and percentiles that stay parallel when one key holds a third of all rows.

Spark's adaptive planner splits the hot partitions of a join by itself, so look-ups are plain joins by default. What it
cannot split (order inside a key, windows, percentiles) is cut into slices here. A session may ask for salted look-ups,
too, by setting ``spark.copytrail.hotRows``. Nothing is dropped or capped: how many salts or slices a key gets follows
from its number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
SALTS = 64


def _setting(df: DataFrame, name: str, default: int) -> int:
    return int(df.sparkSession.conf.get(f"spark.copytrail.{name}", str(default)))


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with at least ``hotRows`` rows and their ``_salts``, one for so many rows; counted with map-side partial sums."""
    floor = _setting(df, "hotRows", HOT_ROWS)
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= floor)
    return counts.select(*keys, F.lit(True).alias("_hot"), (F.ceil(F.col("_n") / floor) + 1).cast("int").alias("_salts"))


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
                counted: DataFrame | None = None, spread: Sequence[str] | None = None) -> DataFrame:
    """Equi-join ``left`` to ``right``, whose rows are few per key.

    By default a plain join, whose hot partitions the adaptive planner splits. With ``spark.copytrail.hotRows`` set, rows
    of hot left keys get a salt from the hash of ``spread`` (by default the whole row; naming an id lets the scan skip
    columns nobody else asks for), and the matching right rows are repeated once per salt of their key. The result is the
    same. ``counted`` names a cheaper frame with the same key frequencies, for a ``left`` that is costly to compute twice.
    """
    if left.sparkSession.conf.get("spark.copytrail.hotRows", None) is None:
        return left.join(right, list(keys), how)
    hot = hot_keys(left if counted is None else counted, keys)
    salts = F.when(_any_null(keys), _setting(left, "salts", SALTS)).otherwise(F.coalesce("_salts", F.lit(1)))
    salt = F.pmod(F.xxhash64(*(spread or left.columns)), salts).cast("int")
    salted = left.join(hot, list(keys), "left").withColumn("_salt", salt).drop("_hot", "_salts")
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    repeated = right.join(hot, list(keys), "left").withColumn("_salt", F.explode(copies)).drop("_hot", "_salts")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def _any_null(keys: Sequence[str]) -> Column:
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    return missing


def sparse_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Sequence[str]) -> DataFrame:
    """Left join on keys that many left rows lack; those rows match nothing and are not sent to one task."""
    salts = _setting(left, "salts", SALTS)
    salt = F.when(_any_null(keys), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    return left.withColumn("_salt", salt).join(right.withColumn("_salt", F.lit(0)), [*keys, "_salt"], "left").drop("_salt")


def slice_hot(df: DataFrame, keys: Sequence[str], order: str, slices: int = 128, name: str = "_slice") -> DataFrame:
    """Number the slices of each hot key along ``order`` so that they hold about equally many rows; other keys get slice 0.

    The cuts are approximate quantiles of a bounded sketch, ``slices`` numbers for each hot key, whatever the
    distribution in time: one crowded day is cut as finely as the rest. Only rows of equal order stay together.
    """
    hot = hot_keys(df, keys).select(*keys)
    grid = [n / slices for n in range(1, slices)]
    cuts = df.select(*keys, order).join(hot, list(keys)).groupBy(*keys).agg(F.percentile_approx(order, grid, 10000).alias("_cuts"))
    below = F.size(F.filter("_cuts", lambda c: c < F.col(order)))
    return df.join(cuts, list(keys), "left").withColumn(
        name, F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(below)).drop("_cuts")


def rank_in_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str = "rank") -> DataFrame:
    """Zero-based position of each row within its key.

    ``bucket`` must not decrease along ``order`` (a hash prefix, a time slice): positions are counted inside
    (key, bucket) and shifted by the sizes of earlier buckets, so no task sorts a whole hot key.
    """
    marked = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = marked.groupBy(*keys, "_bucket").agg(F.count("*").alias("_size"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = marked.withColumn("_pos", F.row_number().over(inside) - 1)
    return ranked.join(starts, [*keys, "_bucket"]).withColumn(name, F.col("_start") + F.col("_pos")).drop(
        "_bucket", "_start", "_pos")


def _running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, bucket: Column, reduce) -> DataFrame:
    marked = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.groupBy(*keys, "_bucket").agg(reduce(value).alias("_total"))
    starts = totals.withColumn("_start", reduce("_total").over(before)).drop("_total")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("_inner", reduce(value).over(inside)).join(starts, [*keys, "_bucket"])


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, bucket: Column, name: str) -> DataFrame:
    """Running sum of ``value`` within a key, in the two steps of ``rank_in_key``."""
    return _running(df, keys, order, value, bucket, F.sum).withColumn(
        name, F.coalesce("_start", F.lit(0)) + F.col("_inner")).drop("_bucket", "_start", "_inner")


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, bucket: Column, name: str) -> DataFrame:
    """Running maximum of ``value`` within a key, in the two steps of ``rank_in_key``."""
    return _running(df, keys, order, value, bucket, F.max).withColumn(
        name, F.greatest("_start", "_inner")).drop("_bucket", "_start", "_inner")


def previous_in_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], bucket: Column) -> DataFrame:
    """Add ``previous_<value>`` columns from the row before in the key.

    The first row of each (key, bucket) takes the last row of the nearest earlier bucket, found from one
    aggregated row per bucket.
    """
    marked = df.withColumn("_bucket", bucket)
    last = marked.groupBy(*keys, "_bucket").agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("_last"))
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket")
    carried = last.withColumn("_carry", F.lag("_last").over(by_bucket)).drop("_last")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    stepped = marked.withColumn("_prev", F.lag(F.struct(*values)).over(inside))
    joined = stepped.join(carried, [*keys, "_bucket"])
    for value in values:
        joined = joined.withColumn(f"previous_{value}", F.coalesce(F.col("_prev"), F.col("_carry"))[value])
    return joined.drop("_bucket", "_prev", "_carry")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles per key without holding a key's values in one task.

    A bounded approximate sketch cuts each key into about a hundred slices; exact slice counts tell which
    slices hold the wanted positions; only those slices are ordered, and by distinct value with its count.
    """
    grid = [i / 100 for i in range(1, 100)]
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value)
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(value, grid, 10000).alias("_cuts"), F.count("*").alias("_n"))
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    sliced = lookup_join(counted, cuts, keys, "inner", counted=rows, spread=[value]).withColumn(
        "_slice", F.size(F.filter("_cuts", lambda c: c < F.col(value))))
    wanted = F.array(*[
        F.struct(F.lit(label).alias("label"), (F.lit(float(q)) * (F.col("_n") - 1)).alias("at"))
        for label, q in fractions.items()])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sliced.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_size"), F.max("_n").alias("_n")).withColumn(
        "_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    hits = slices.withColumn("_want", F.filter(wanted, lambda w: (F.floor(w["at"]) < F.col("_start") + F.col("_size")) & (
        F.ceil(w["at"]) >= F.col("_start")))).filter(F.size("_want") > 0).select(*keys, "_slice", "_start", "_want")
    inside = Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = sliced.join(hits, [*keys, "_slice"]).withColumn("_upto", F.col("_start") + F.sum("_c").over(inside))
    found = placed.select(*keys, value, "_c", "_upto", F.explode("_want").alias("w")).filter(
        (F.floor("w.at") < F.col("_upto")) & (F.ceil("w.at") >= F.col("_upto") - F.col("_c")))
    low = F.max(F.when((F.floor("w.at") < F.col("_upto")) & (F.floor("w.at") >= F.col("_upto") - F.col("_c")), F.col(value)))
    high = F.max(F.when((F.ceil("w.at") < F.col("_upto")) & (F.ceil("w.at") >= F.col("_upto") - F.col("_c")), F.col(value)))
    share = F.max(F.col("w.at") - F.floor("w.at"))
    points = found.groupBy(*keys, F.col("w.label").alias("label")).agg((low + (high - low) * share).alias("_p"))
    return points.groupBy(*keys).agg(*[
        F.max(F.when(F.col("label") == label, F.col("_p"))).alias(label) for label in fractions])
