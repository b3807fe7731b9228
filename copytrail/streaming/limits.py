"""Request limits over tables: a trailing window in which only allowed requests count."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copytrail import constants as C
from copytrail.session import materialize
from copytrail.skew import hot_keys, running_max, slice_hot


def admit(times: Iterable[int], past: Iterable[int], limit: int, window: int) -> tuple[list[bool], list[int]]:
    """Decisions for ordered request times, given earlier allowed times, and the times still inside the window."""
    recent, out = deque(past), []
    for now in times:
        while recent and recent[0] <= now - window:
            recent.popleft()
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(now)
    return out, list(recent)


def _placed(rows: DataFrame, limit: int) -> DataFrame:
    """(key, event_id, micros, _slice, pos, old): each request's place in its key, and the time ``limit`` requests before it.

    Hot keys are cut into slices along time, so places are counted inside slices and shifted. The order is written once.
    """
    inside = Window.partitionBy("key", "_slice").orderBy("micros", "event_id")
    cut = slice_hot(rows, ["key"], "micros").withColumn("_at", F.row_number().over(inside) - 1).withColumn("_old", F.lag("micros", limit).over(inside))
    sizes = cut.groupBy("key", "_slice").agg(F.count("*").alias("_size"))
    before = Window.partitionBy("key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    placed = cut.join(starts, ["key", "_slice"]).withColumn("pos", F.col("_start") + F.col("_at")).drop("_start", "_at")
    placed = materialize(placed, "request_order")
    # Only the first requests of a later slice have to look into the slices before it.
    edge = F.col("_old").isNull() & (F.col("pos") >= limit)
    far = placed.select("key", (F.col("pos") + limit).alias("pos"), F.col("micros").alias("_far"))
    edges = placed.filter(edge).drop("_old").join(far, ["key", "pos"]).withColumnRenamed("_far", "old")
    return placed.filter(~edge).withColumnRenamed("_old", "old").unionByName(edges)


def _after_doubt(placed: DataFrame, window: int) -> DataFrame:
    """``placed`` with ``full`` (``limit`` requests stand in the window before it) and ``clean`` (no full one does)."""
    full = F.col("old") > F.col("micros") - window
    marked = placed.withColumn("full", F.coalesce(full, F.lit(False))).withColumn("_full_at", F.when(full, F.col("micros")))
    inside = Window.partitionBy("key", "_slice").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy("key", "_slice").agg(F.max("_full_at").alias("_m")).withColumn("_carried", F.max("_m").over(before)).drop("_m")
    last = F.greatest(F.max("_full_at").over(inside), F.col("_carried"))
    return marked.join(carried, ["key", "_slice"]).withColumn("_last", last).withColumn(
        "clean", F.coalesce(F.col("_last") <= F.col("micros") - window, F.lit(True))).drop("_last", "_full_at", "_carried")


def walk(times: list[int], recent: list[int], limit: int, window: int) -> list[int]:
    """Places of the allowed among ordered request times; ``recent``, the allowed times before them, grows by theirs.

    The next allowed request is the first at which the ``limit``-th last allowed one has left the window, found by halving.
    """
    places, at = [], 0
    while at < len(times):
        if len(recent) >= limit:
            at = bisect_left(times, recent[-limit] + window, at)
            if at == len(times):
                break
        places.append(at)
        recent.append(times[at])
        at += 1
    return places


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it."""
    if pa.types.is_nested(column.type):
        values = column.to_pylist()
        return np.array([a != b for a, b in pairwise(values)], bool)
    return pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)


def _walked(steps: DataFrame, group: list[str], rates: list[tuple[int, int]]) -> DataFrame:
    """``steps`` (group columns, rate, micros) with ``allowed`` for micros; rows of a group stand together, in order.

    Requests with fewer than ``limit`` requests in the window before them are told by arrays, a batch at a time. Only from a
    group's first other request on are its times walked. Between batches at most ``limit`` times are kept.
    """
    kept = [c for c in steps.columns if c != "micros"]
    limits, windows = (np.array(x, np.int64) for x in zip(*rates, strict=True))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, carried = None, []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(c) for c in group]
            if tuple(c[0].as_py() for c in columns) != current:
                carried = []
            current = tuple(c[n - 1].as_py() for c in columns)
            rate = batch.column("rate").to_numpy()
            times = np.concatenate([np.array(carried, np.int64), batch.column("micros").to_numpy()])
            own = len(carried)
            # Groups of the batch as places in times; what is carried belongs to the first.
            starts = np.concatenate([[0], own + 1 + np.flatnonzero(np.logical_or.reduce([_changes(c) for c in columns]))])
            ends = np.append(starts[1:], own + n)
            first = np.repeat(starts, ends - starts)[own:]
            back = np.arange(own, own + n) - limits[rate]
            full = (back >= first) & (times[np.maximum(back, 0)] > times[own:] - windows[rate])
            allowed = ~full
            at_full = own + np.flatnonzero(full)
            walks = np.searchsorted(at_full, starts)
            limit = int(limits[rate[-1]])
            carried = times[max(starts[-1], own + n - limit):].tolist()
            for g in np.flatnonzero(walks < np.searchsorted(at_full, ends)):
                begin, end, r = int(at_full[walks[g]]), int(ends[g]), rate[max(starts[g] - own, 0)]
                recent = times[begin - limits[r]:begin].tolist()
                places = walk(times[begin:end].tolist(), recent, int(limits[r]), int(windows[r]))
                allowed[begin - own:end - own] = False
                allowed[np.array(places, np.int64) + (begin - own)] = True
                if end == own + n:
                    carried = recent[-limit:]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(allowed)], names=[*kept, "allowed"])

    return steps.mapInArrow(decide, T.StructType([*(steps.schema[c] for c in kept), T.StructField("allowed", T.BooleanType())]))


def _cut_walks(rows: DataFrame, limit: int, window: int) -> DataFrame:
    """(key, event_id, allowed) for (key, event_id, micros) of hot keys, each of them spread over many tasks where it can be.

    Where no request of the window before it was full, a request's state is known: it is decided by built-in functions, and
    the key is cut there. Only what follows a full window without such a cut is walked, from the known requests before it.
    """
    judged = materialize(_after_doubt(_placed(rows, limit), window), "request_windows")
    known = judged.filter("clean").select("key", "event_id", (~F.col("full")).alias("allowed"))
    open_rows = judged.filter("full OR NOT clean").withColumn("_head", F.when(F.col("full") & F.col("clean"), F.col("pos")))
    runs = running_max(open_rows, ["key"], [F.col("pos")], "_head", F.col("_slice"), "run")
    heads = runs.filter("_head IS NOT NULL").select("key", "run", F.explode(F.expr(f"sequence(run - {limit}, run - 1)")).alias("pos"))
    context = judged.select("key", "pos", "event_id", "micros").join(heads, ["key", "pos"]).withColumn("known", F.lit(True))
    # The head of a run is decided above; it belongs to the walk as the request that was denied, and leaves no trace in it.
    # Before it stand ``limit`` known requests, which the walk allows as the first of their run.
    walked = runs.filter("NOT clean").withColumn("known", F.lit(False))
    columns = ["key", "run", "pos", "micros", "event_id", "known"]
    steps = walked.select(columns).unionByName(context.select(columns)).withColumn("rate", F.lit(0))
    ordered = steps.repartition("key", "run").sortWithinPartitions("key", "run", "pos")
    found = _walked(ordered, ["key", "run"], [(limit, window)]).filter("NOT known")
    return known.unionByName(found.select("key", "event_id", "allowed"))


def _decided(rows: DataFrame, rates: list[tuple[int, int]]) -> DataFrame:
    """(rate, key, event_id, allowed) for (rate, key, event_id, micros), where rate is a place in ``rates`` (limit, window).

    All rates share one shuffle: a key's requests are sorted and walked in one task. Only keys too hot for one task are cut.
    Requests without a time count against nothing and are allowed.
    """
    timed = rows.filter("micros IS NOT NULL")
    hot = materialize(hot_keys(timed, ["rate", "key"]).select("rate", "key"), "hot_request_keys")
    busy = sorted(r.rate for r in hot.select("rate").distinct().collect())
    whole = timed.join(hot, ["rate", "key"], "left_anti") if busy else timed
    ordered = whole.repartition("rate", "key").sortWithinPartitions("key", "rate", "micros", "event_id")
    parts = [_walked(ordered, ["key", "rate"], rates), rows.filter("micros IS NULL").withColumn("allowed", F.lit(True))]
    for rate in busy:
        cut = timed.filter(F.col("rate") == rate).join(hot, ["rate", "key"], "left_semi").drop("rate")
        parts.append(_cut_walks(cut, *rates[rate]).withColumn("rate", F.lit(rate)))
    return reduce(DataFrame.unionByName, (part.select("rate", "key", "event_id", "allowed") for part in parts))


def _micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp")).alias("micros")


def rate_limit(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """(key, event_id, allowed): admit or deny each request of (key, ts, event_id).

    A request is allowed when fewer than ``limit`` allowed ones lie in the window before it. With fewer than ``limit``
    requests of any kind there, it surely is; only the others need the decisions before them. A key is walked in order by one
    task, with a state of at most ``limit`` times. Keys of a million rows or more (``spark.copytrail.hotRows``) are sorted in
    slices and cut where the state is known, so those below the limit spread over all tasks; a stretch that keeps asking
    beyond its limit is one walk, because each of its decisions depends on the one before. Requests of equal time go by
    event_id. A request without a key counts against nothing and is allowed.
    """
    if limit < 1:
        return requests.select("key", "event_id", F.col("key").isNull().alias("allowed"))
    rows = requests.select(F.lit(0).alias("rate"), "key", "event_id", _micros())
    found = _decided(rows.filter("key IS NOT NULL"), [(limit, seconds * 1_000_000)]).select("key", "event_id", "allowed")
    return found.unionByName(rows.filter("key IS NULL").select("key", "event_id", F.lit(True).alias("allowed")))


JOB_KINDS = ("issuance_job", "verification_job")


def _entries(requests: DataFrame) -> DataFrame:
    """(scope, digest, ts, event_id): ``scoped_requests`` with keys as bare digests."""
    hashed = requests.select("event_id", "ts", "job_kind", F.unhex(F.sha2("account_id", 256)).alias("account"),
                             F.unhex(F.sha2(F.coalesce("source_ip", F.lit("None")), 256)).alias("source_ip"))

    def entry(scope: Column, digest: str, applies: Column) -> Column:
        return F.when(applies, F.struct(scope.alias("scope"), F.col(digest).alias("digest")))

    known = F.col("account").isNotNull()
    scopes = F.array(entry(F.lit("account"), "account", known), entry(F.lit("source_ip"), "source_ip", F.lit(True)),
                     entry(F.col("job_kind"), "account", known & F.col("job_kind").isin(*JOB_KINDS)))
    return hashed.select("event_id", "ts", F.explode(scopes).alias("s")).filter("s IS NOT NULL").select("s.scope", "s.digest", "ts", "event_id")


def _key() -> Column:
    kind = F.when(F.col("scope").isin(*JOB_KINDS), F.concat(F.lit(":"), "scope")).otherwise(F.lit(""))
    return F.concat(F.lower(F.hex("digest")), kind).alias("key")


def scoped_requests(requests: DataFrame) -> DataFrame:
    """(scope, key, ts, event_id): what each request of (event_id, ts, account_id, source_ip, job_kind) counts against.

    Its account, unless it is anonymous; its address; and, for a known account, the job kind it starts. Keys are digests,
    so neither accounts nor addresses are stored.
    """
    return _entries(requests).select("scope", _key(), "ts", "event_id")


def scoped_limits(requests: DataFrame, rates: dict[str, tuple[int, int]] = C.RATES) -> DataFrame:
    """(scope, key, event_id, allowed): every scope of every request by the scope's own rate (requests, seconds).

    All scopes are decided together. Digests travel as bytes and become text behind the walk.
    """
    entries = _entries(requests)
    names = [scope for scope, (limit, _) in rates.items() if limit >= 1]
    shut = entries.filter(F.col("scope").isin([scope for scope in rates if scope not in names])).withColumn("allowed", F.lit(False))
    if not names:
        return shut.select("scope", _key(), "event_id", "allowed")
    scopes = F.array(*map(F.lit, names))
    rows = entries.filter(F.col("scope").isin(names)).select(
        (F.array_position(scopes, F.col("scope")) - 1).cast("int").alias("rate"), F.col("digest").alias("key"), "event_id", _micros())
    found = _decided(rows, [(rates[scope][0], rates[scope][1] * 1_000_000) for scope in names])
    named = found.select(F.element_at(scopes, F.col("rate") + 1).alias("scope"), F.col("key").alias("digest"), "event_id", "allowed")
    both = named if len(names) == len(rates) else named.unionByName(shut.select(named.columns))
    return both.select("scope", _key(), "event_id", "allowed")
