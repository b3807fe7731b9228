"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copytrail.llm.common import written

BAND = 1024


def counted(docs: DataFrame, encode: Callable[[list[str | None]], list[np.ndarray]]) -> DataFrame:
    """(doc_id, n_tokens) of every document; null and empty texts have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                some = batch.slice(begin, 256)
                n = [len(ids) for ids in encode(some.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long")


def histogram(counts: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): documents by encoded length, added up in every task before the shuffle."""
    return counts.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limits(lengths: DataFrame) -> DataFrame:
    """What every context limit equal to an occurring length needs, from the histogram alone.

    n_docs, docs_at_least and tokens_at_least (documents of that length, of that length or more, and all their tokens);
    truncated_total: tokens kept if every document is cut at this limit; total_tokens and total_docs; quantile: share of
    documents no longer than this. A limit between two lengths has the row of the next longer one, less docs_at_least
    for each id of difference. Lengths are summed in bands of 1024, and the bands then, so no task sorts all lengths.
    An empty table gives no rows. The histogram is written first, so texts are encoded once.
    """
    h = written(lengths, "lengths").withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("band", F.expr(f"n_tokens div {BAND}"))
    up = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    bands = h.groupBy("band").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    bands = bands.select("band", F.coalesce(F.sum("d").over(up), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("t").over(up), F.lit(0)).alias("tokens_above"),
                         F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    inside = Window.partitionBy("band").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    rows = h.withColumn("d", F.sum("n_docs").over(inside)).withColumn("t", F.sum("tokens").over(inside)).join(bands, "band")
    docs, tokens = F.col("d") + F.col("docs_above"), F.col("t") + F.col("tokens_above")
    return rows.select(
        "n_tokens", "n_docs", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"),
        (F.col("total_tokens") - tokens + F.col("n_tokens") * docs).alias("truncated_total"), "total_docs", "total_tokens",
        ((F.col("total_docs") - docs + F.col("n_docs")) / F.col("total_docs")).alias("quantile"))


def answer(suffixes: DataFrame, limit: int) -> DataFrame:
    """(limit, kept_tokens, cut_docs) of any context limit, from ``limits``; without documents both are 0."""
    longer = suffixes.filter(F.col("n_tokens") > limit).orderBy("n_tokens").limit(1).select(
        (F.col("truncated_total") - (F.col("n_tokens") - limit) * F.col("docs_at_least")).alias("kept"), F.col("docs_at_least").alias("cut"))
    total = suffixes.agg(F.max("total_tokens").alias("total"))
    both = longer.unionByName(total.select(F.col("total").alias("kept"), F.lit(None).cast("long").alias("cut")))
    return both.agg(F.coalesce(F.min("kept"), F.lit(0)).alias("kept_tokens"), F.coalesce(F.max("cut"), F.lit(0)).alias("cut_docs")).select(
        F.lit(limit).alias("limit"), "kept_tokens", "cut_docs")


def quantile(suffixes: DataFrame, share: float) -> DataFrame:
    """(n_tokens): the smallest length that at least this share of the documents does not exceed."""
    return suffixes.filter(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))
