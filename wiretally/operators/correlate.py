"""Correlation of alerts into incidents.

Rule: alerts of one source are taken in time order; an anchor alert opens a window of
300 s; when the window holds two or more threat classes it becomes an incident and the
next anchor is the first alert after it, otherwise the next alert is the next anchor.

Done naively this walks all alerts of a source in one task. It is split exactly:

* Whether an anchor opens an incident depends only on the 300 s after it, and alerts with
  the same time share the verdict, so (source, time, class) cells carry everything and the
  opening times are found with window functions over short chunks of time.
* Most openers stand alone and are anchors. For the others, within a chunk, the walk is a step function from the time it is
  entered to the time it is left; only entries within one window of the chunk start can
  occur and neighbouring entries with one exit are merged, so a chunk sums up in few rows.
* The chunk functions of a source are composed in order (rows per chunk, not per alert),
  and every chunk then replays its own part from its known entry time.

A source that raises a third of all alerts is thereby spread over its chunks.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.operators.alerts import uuid_of
from wiretally.session import materialise

WINDOW_SECONDS = 300
_MICROS = 1_000_000


def _in_chunks(times: DataFrame, chunk: int, before: int, after: int) -> DataFrame:
    """Repeat rows whose time lies within ``before``/``after`` of a neighbouring chunk."""
    t = F.col("_t")
    spots = F.array(F.floor(t / chunk), F.floor((t - after) / chunk), F.floor((t + before) / chunk))
    return times.withColumn("_chunk", F.explode(F.array_distinct(spots)))


def find_openers(cells: DataFrame, window: int, chunk: int) -> DataFrame:
    """(source, _t) of every time whose window holds at least two classes.

    In time order, the next cell of another class is the next change of class; a chunk
    sees one window past its end, so the answer is local to it.
    """
    part = Window.partitionBy("source", "_chunk").orderBy("_t", "_class")
    ahead = part.rowsBetween(1, Window.unboundedFollowing)
    changed = F.when(F.col("_class") != F.lag("_class").over(part), F.col("_t"))
    return (
        _in_chunks(cells, chunk, 0, window)
        .withColumn("_change", changed)
        .withColumn("_other", F.first("_change", ignorenulls=True).over(ahead))
        .filter((F.col("_other") - F.col("_t") <= window) & (F.floor(F.col("_t") / chunk) == F.col("_chunk")))
        .select("source", "_t")
        .distinct()
    )


def _walk(openers: list[int], start: int, stop: int, window: int) -> list[int]:
    """Anchors in [start, stop) of the greedy walk entering at ``start``."""
    anchors = []
    at = bisect.bisect_left(openers, start)
    while at < len(openers) and openers[at] < stop:
        anchors.append(openers[at])
        at = bisect.bisect_right(openers, openers[at] + window)
    return anchors


def chunk_function(openers: list[int], low: int, high: int, window: int) -> list[tuple[int, int]]:
    """The walk through [low, high) as steps (entered up to, left at); left at 0 means
    that no anchor follows in the chunk."""
    exits = [0] * len(openers)
    for at in range(len(openers) - 1, -1, -1):
        follower = bisect.bisect_right(openers, openers[at] + window)
        exits[at] = exits[follower] if follower < len(openers) else openers[at] + window + 1
    steps: list[tuple[int, int]] = []
    entry = low
    while True:
        at = bisect.bisect_left(openers, entry)
        inside = at < len(openers)
        upto, leaves = (openers[at], exits[at]) if inside else (high, 0)
        if steps and steps[-1][1] == leaves:
            steps.pop()
        steps.append((upto, leaves))
        if not inside or upto >= low + window:
            return steps
        entry = upto + 1


def find_anchors(openers: DataFrame, window: int, chunk: int) -> DataFrame:
    """(source, _t) of the openers the greedy walk stops at.

    An opener with no other opener within a window on either side is always an anchor and
    never affects another one; only the rest goes through the chunked walk.
    """
    part = Window.partitionBy("source", "_chunk").orderBy("_t")
    near = lambda other: F.coalesce(F.abs(F.col("_t") - other) <= window, F.lit(False))
    judged = (
        _in_chunks(openers, chunk, window, window)
        .withColumn("_crowded", near(F.lag("_t").over(part)) | near(F.lead("_t").over(part)))
        .filter(F.floor(F.col("_t") / chunk) == F.col("_chunk"))
    )
    judged = materialise(judged, "openers")
    chunks = materialise(
        judged.filter("_crowded").groupBy("source", "_chunk").agg(F.sort_array(F.collect_list("_t")).alias("_times")), "chunks"
    )

    # Many chunks hold few openers each, so a call works on a batch of chunks.
    @F.pandas_udf("array<struct<_upto: bigint, _leaves: bigint>>")
    def summarise(times: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series(
            [
                [{"_upto": u, "_leaves": v} for u, v in chunk_function(t.tolist(), n * chunk, (n + 1) * chunk, window)]
                for t, n in zip(times, number.tolist())
            ]
        )

    @F.pandas_udf("array<bigint>")
    def replay(times: pd.Series, entry: pd.Series, number: pd.Series) -> pd.Series:
        rows = zip(times, entry.tolist(), number.tolist())
        return pd.Series([_walk(t.tolist(), e, (n + 1) * chunk, window) for t, e, n in rows])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_chunk", "_upto"])
        numbers, first = np.unique(pdf._chunk.to_numpy(), return_index=True)
        upto, leaves = pdf._upto.to_numpy(), pdf._leaves.to_numpy()
        entries, carry = [], 0
        for number, low, high in zip(numbers.tolist(), first, [*first[1:], len(pdf)]):
            entry = max(number * chunk, carry)
            entries.append(entry)
            step = low + int(np.searchsorted(upto[low:high], entry, side="left"))
            if step < high and leaves[step] > 0:
                carry = int(leaves[step])
        return pd.DataFrame({"source": pdf.source.iloc[0], "_chunk": numbers, "_entry": entries})

    entries = (
        chunks.select("source", "_chunk", F.inline(summarise("_times", "_chunk")))
        .groupBy("source")
        .applyInPandas(compose, "source string, _chunk bigint, _entry bigint")
    )
    walked = chunks.join(entries, ["source", "_chunk"]).select("source", F.explode(replay("_times", "_entry", "_chunk")).alias("_t"))
    return judged.filter(~F.col("_crowded")).select("source", "_t").unionByName(walked)


def correlate(
    alerts: DataFrame, window_seconds: int = WINDOW_SECONDS, chunk_seconds: int | None = None
) -> DataFrame:
    """Add correlation_id and incident_start to alerts (columns alert_id, ts, source,
    threat_class); alerts outside any incident keep NULL there.

    Peers of an alert are the other rows with its correlation_id; they stay a relation
    rather than a list per alert, whose total size would be quadratic in an incident.
    """
    window = window_seconds * _MICROS
    chunk = (chunk_seconds or 12 * window_seconds) * _MICROS
    if chunk < window:
        raise ValueError("chunk_seconds must not be below window_seconds")

    stamped = alerts.withColumn("_t", F.unix_micros("ts"))
    cells = (
        stamped.filter(F.coalesce("source", F.lit("")) != "")
        .select("source", "_t", F.coalesce("threat_class", F.lit("")).alias("_class"))
        .distinct()
    )
    anchors = find_anchors(find_openers(cells, window, chunk), window, chunk)

    # Windows of incidents do not overlap, so a time belongs to at most one: that of the
    # latest anchor at or before it. A fill per (source, chunk) finds it without pairing.
    marks = _in_chunks(anchors, chunk, window, 0).select("source", "_chunk", "_t", F.col("_t").alias("_anchor"))
    times = cells.select("source", "_t").distinct().withColumn("_chunk", F.floor(F.col("_t") / chunk))
    before = (
        Window.partitionBy("source", "_chunk")
        .orderBy("_t", F.asc_nulls_last("_anchor"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    assigned = (
        times.withColumn("_anchor", F.lit(None).cast("bigint"))
        .unionByName(marks)
        .withColumn("_hit", F.last("_anchor", ignorenulls=True).over(before))
        .filter(F.col("_anchor").isNull() & (F.col("_t") - F.col("_hit") <= window))
        .select("source", "_t", "_hit")
    )
    incident = uuid_of(F.lit("incident"), F.col("source"), F.col("_hit").cast("string"))
    return (
        stamped.join(assigned, ["source", "_t"], "left")
        .withColumn("correlation_id", F.when(F.col("_hit").isNotNull(), incident))
        .withColumn("incident_start", F.timestamp_micros("_hit"))
        .drop("_t", "_hit")
    )


def correlation_groups(correlated: DataFrame) -> DataFrame:
    """One row per incident: source, members, start, end and distinct classes."""
    return (
        correlated.filter(F.col("correlation_id").isNotNull())
        .groupBy("correlation_id", "source")
        .agg(
            F.count(F.lit(1)).alias("alert_count"),
            F.min("ts").alias("start_time"),
            F.max("ts").alias("end_time"),
            F.array_sort(F.collect_set("threat_class")).alias("threat_classes"),
        )
    )
