"""Writing result rows, audit rows and once-only rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copytrail.functions.evidence import redact_metadata
from copytrail.session import materialize


def _canonical(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text with sorted members, for flat formats."""
    def as_text(field: T.StructField):
        if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(F.col(field.name), {"ignoreNullFields": "false", "sortKeys": "true"}).alias(field.name)
        return F.col(field.name)

    return df.select(*[as_text(f) for f in df.schema.fields])


def write_results(rows: DataFrame, path: str, key: str = "row_id") -> None:
    """JSON lines and CSV of the rows, ordered by key across files: ranges are split before they are sorted.

    Files are compressed, for a line names every member, most of them null; readers unpack them by their names.
    """
    ordered = rows.repartitionByRange(key).sortWithinPartitions(key)
    ordered.write.option("ignoreNullFields", "false").option("compression", "gzip").json(f"{path}/results.jsonl")
    _canonical(ordered).write.option("header", True).option("compression", "gzip").csv(f"{path}/results.csv")


def write_shards(rows: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder of JSON lines per shard, named so that ``union_shards`` finds its number."""
    rows.withColumn("part", F.concat(F.lit("shard-"), F.col(shard).cast("string"))).drop(shard).write.partitionBy("part").json(path)


def append_audit(events: DataFrame, path: str) -> None:
    """Append audit rows, redacted first. There is no way here to change or remove written rows."""
    safe = events.withColumn("metadata", redact_metadata(F.col("metadata_json"))).drop("metadata_json").withColumn(
        "event_date", F.to_date("created_at"))
    safe.write.mode("append").partitionBy("organization_id", "event_date").parquet(path)


def _existing(df: DataFrame, path: str) -> DataFrame | None:
    try:
        return df.sparkSession.read.schema(df.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def new_rows(rows: DataFrame, existing: DataFrame | None, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, by ``order``, that is not stored yet. Only the keys of stored rows are read."""
    rest = [c for c in rows.columns if c not in keys]
    firsts = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f")).select(*keys, "_f.*").select(*rows.columns)
    return firsts if existing is None else firsts.join(existing.select(*keys), list(keys), "left_anti")


def append_once(rows: DataFrame, path: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Append rows whose key is not stored yet; writing the same rows again changes nothing."""
    new_rows(rows, _existing(rows, path), keys, order).write.mode("append").parquet(path)


def append_once_batches(path: str, keys: Sequence[str], order: Sequence[str]):
    """The same as a micro-batch writer for streams: a replayed batch is a no-op."""
    def write(batch: DataFrame, _batch_id: int) -> None:
        append_once(batch, path, keys, order)

    return write


SLOT = "_slot"


def append_indexed(rows: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], slots: int = 256) -> None:
    """``append_once`` into a store that is cut by a hash of the key: only the slots that the new rows' keys fall into are read.

    A replayed or small batch costs its own slots, not the keys of the whole store. The first row of each key by ``order`` is
    kept. A store keeps the number of slots it was begun with: ``slots`` must not change. At most ``slots`` small numbers reach the driver.
    """
    slotted = rows.withColumn(SLOT, F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int"))
    own = [SLOT, *keys]
    firsts = materialize(new_rows(slotted, None, own, order), "once")
    stored = _existing(slotted, path)
    if stored is not None:
        touched = [r[0] for r in firsts.select(SLOT).distinct().collect()]
        firsts = firsts.join(stored.filter(F.col(SLOT).isin(touched)).select(*own), own, "left_anti")
    firsts.repartition(SLOT).write.mode("append").partitionBy(SLOT).parquet(path)


def read_indexed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of such a store, without the slot."""
    return spark.read.parquet(path).drop(SLOT)
