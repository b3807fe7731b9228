"""Queries that write rows derived from the tables and read them back."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from copytrail.catalog import query
from copytrail.catalog.lifecycle import ts, ts_sql
from copytrail.functions import geometry as G
from copytrail.plans import benchmark as B
from copytrail.session import scratch_path
from copytrail.sources import readers, sinks


def _results(i):
    rows = i.result_rows
    wide = rows.withColumn("limitations", F.array("limitation")).withColumn("psnr_db", F.col("psnr_db").cast("string")).drop("limitation")
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in readers.RESULT_ROW.fields if f.name not in wide.columns]
    return wide.select("*", *missing).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in readers.RESULT_ROW.fields])


@query("read_results", """
    SELECT row_id, profile_id, fixture_id, page_index, expected_id, decoded_id, reason, eligible, round(psnr_db, 6) AS psnr_db,
      round(ssim, 6) AS ssim, round(elapsed_ms, 6) AS elapsed_ms, limitation FROM result_rows""")
def _(i):
    path = scratch_path(i.spark, "results")
    sinks.write_results(_results(i), path)
    back = readers.read_results(i.spark, f"{path}/results.jsonl")
    return back.select("row_id", "profile_id", "fixture_id", "page_index", "expected_id", "decoded_id", "reason", "eligible",
                       F.round(F.col("psnr_db").cast("double"), 6).alias("psnr_db"), F.round("ssim", 6).alias("ssim"),
                       F.round("elapsed_ms", 6).alias("elapsed_ms"), F.get("limitations", F.lit(0)).alias("limitation"))


LINE = T.StructType([T.StructField(n, k) for n, k in (
    ("row_id", T.StringType()), ("page_index", T.IntegerType()), ("eligible", T.BooleanType()), ("decoded_id", T.StringType()), ("ssim", T.DoubleType()),
    ("tamper_ground_truth", T.ArrayType(readers.RECT)))])
#: Broken rules of the lines by what JSON functions of the checking database see in them.
BROKEN = """
    WITH k AS (SELECT value, json_valid(value) AS valid, CASE WHEN json_valid(value) THEN CAST(value AS JSON) END AS j FROM result_lines),
    m AS (SELECT *, json_keys(j) AS names, json_keys(j, '$.tamper_ground_truth[0]') AS inner_names, json_type(j, '$.row_id') AS t1, json_type(j, '$.page_index') AS t2,
            json_type(j, '$.eligible') AS t3 FROM k),
    e AS (SELECT value, j, CASE WHEN NOT valid THEN 'malformed'
        WHEN len(list_distinct(names)) < len(names) OR len(list_distinct(inner_names)) < len(inner_names) THEN 'repeated_member'
        ELSE concat_ws(',', CASE WHEN t3 IS NULL THEN 'missing:eligible' END, CASE WHEN t1 <> 'VARCHAR' THEN 'type:row_id' END, CASE WHEN t2 = 'DOUBLE' THEN 'type:page_index' END,
          CASE WHEN t3 <> 'BOOLEAN' THEN 'type:eligible' END, CASE WHEN len(inner_names) > 4 THEN 'type:tamper_ground_truth' END,
          CASE WHEN list_contains(names, 'extra') THEN 'unknown:extra' END) END AS errors FROM m)"""


@query("strict_rejects", BROKEN + " SELECT value, errors FROM e WHERE errors <> ''")
def _(i):
    path = scratch_path(i.spark, "lines")
    i.result_lines.write.text(path)
    return readers.read_strict(i.spark, path, LINE)[1].select("value", F.array_join("errors", ",").alias("errors"))


@query("strict_results", BROKEN + """
    SELECT j->>'$.row_id' AS row_id, CAST(j->>'$.page_index' AS INT) AS page_index, CAST(j->>'$.eligible' AS BOOLEAN) AS eligible, j->>'$.decoded_id' AS decoded_id,
      CAST(j->>'$.ssim' AS DOUBLE) AS ssim, json_array_length(j, '$.tamper_ground_truth') AS regions FROM e WHERE errors = ''""")
def _(i):
    path = scratch_path(i.spark, "lines")
    i.result_lines.write.text(path)
    rows = readers.read_strict(i.spark, path, LINE)[0]
    return rows.withColumn("regions", F.size("tamper_ground_truth")).drop("tamper_ground_truth")


@query("write_results", "SELECT row_id, concat('[\"', limitation, '\"]') AS limitations, reason, expected_id FROM result_rows")
def _(i):
    path = scratch_path(i.spark, "results")
    sinks.write_results(_results(i), path)
    flat = T.StructType([T.StructField(f.name, T.StringType()) for f in readers.RESULT_ROW.fields])
    return i.spark.read.schema(flat).option("header", True).csv(f"{path}/results.csv").select("row_id", "limitations", "reason", "expected_id")


@query("union_shards", """
    SELECT CAST(substr(run_id, 4) AS STRING) AS shard, count(*) AS rows, count(*) FILTER (reason = 'execution_error') AS errors
    FROM run_rows GROUP BY 1""")
def _(i):
    path = scratch_path(i.spark, "shards")
    rows = i.run_rows.withColumn("shard", F.substring("run_id", 4, 9)).drop("run_id")
    sinks.write_shards(rows, path)
    back = readers.union_shards(i.spark, f"{path}/*", rows.drop("shard").schema)
    return readers.shard_counts(back)


@query("append_audit", f"""
    SELECT event_id, organization_id, action, {ts_sql('created_at', 'created_at')}, CASE WHEN contains(metadata_json, 'k') THEN 0 ELSE 1 END AS kept FROM audit""")
def _(i):
    path = scratch_path(i.spark, "audit")
    sinks.append_audit(i.audit, path)
    return i.spark.read.parquet(path).select("event_id", "organization_id", "action", ts("created_at"), F.size("metadata").cast("int").alias("kept"))


@query("append_once", """
    SELECT user_id, event_type, CASE WHEN min(CASE WHEN ts < TIMESTAMP '2024-01-10 00:00:00' THEN event_id END) IS NULL THEN min(event_id)
      ELSE min(CASE WHEN ts < TIMESTAMP '2024-01-10 00:00:00' THEN event_id END) END AS event_id FROM events GROUP BY 1, 2""")
def _(i):
    path = scratch_path(i.spark, "once")
    events = i.table("events").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    early = events.filter(F.col("ts") < F.expr("TIMESTAMP '2024-01-10 00:00:00'"))
    for batch in (early, early, events):
        sinks.append_once(batch, path, ["user_id", "event_type"], ["event_id"])
    return i.spark.read.parquet(path).select("user_id", "event_type", "event_id")


@query("append_indexed", """
    SELECT user_id, event_type, CASE WHEN min(CASE WHEN ts < TIMESTAMP '2024-01-10 00:00:00' THEN event_id END) IS NULL THEN min(event_id)
      ELSE min(CASE WHEN ts < TIMESTAMP '2024-01-10 00:00:00' THEN event_id END) END AS event_id FROM events GROUP BY 1, 2""")
def _(i):
    path = scratch_path(i.spark, "indexed")
    events = i.table("events").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    early = events.filter(F.col("ts") < F.expr("TIMESTAMP '2024-01-10 00:00:00'"))
    for batch in (early, events, early):
        sinks.append_indexed(batch, path, ["user_id", "event_type"], ["event_id"], slots=16)
    return sinks.read_indexed(i.spark, path).select("user_id", "event_type", "event_id")


@query("read_corpus", """
    WITH n AS (SELECT fixture_id, count(*) AS n FROM corpus_entries GROUP BY 1)
    SELECT ordinal, fixture_id, concat_ws(',', CASE WHEN n > 1 THEN 'duplicate_fixture_id' END,
      CASE WHEN kind NOT IN ('clean_pdf', 'clean_image', 'tamper_ground_truth', 'negative_external') THEN 'kind' END,
      CASE WHEN relative_path LIKE '/%' OR relative_path LIKE '../%' THEN 'relative_path' END, CASE WHEN length(sha256) <> 64 THEN 'sha256' END, CASE WHEN pages < 1 THEN 'pages' END,
      CASE WHEN region AND x + 0.25 > 1 THEN 'ground_truth_invalid' END, CASE WHEN kind = 'tamper_ground_truth' AND NOT region THEN 'ground_truth_missing' END) AS errors
    FROM corpus_entries JOIN n USING (fixture_id)""")
def _(i):
    path = scratch_path(i.spark, "corpus")
    region = F.when(F.col("region"), F.array(G.rect(F.col("x"), F.lit(0.0), F.lit(0.25), F.lit(0.5)))).otherwise(F.array().cast(G.RECTS))
    B.write_corpus(i.corpus_entries.withColumn("ground_truth_regions", region).drop("region", "x"), path)
    back = B.read_corpus(i.spark, path, pieces=True)
    return back.select("ordinal", "fixture_id", F.array_join("errors", ",").alias("errors"))
