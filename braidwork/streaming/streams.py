"""Event-time streams: watermarks, windows, interval joins, admission of plans, sinks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.guards import NotAdmitted
from ..operators.joins import event_time_between

APPEND, UPDATE, COMPLETE = "append", "update", "complete"


def watermark(df: DataFrame, field: str, *, delay: str = "10 minutes") -> DataFrame:
    if df.schema[field].dataType.typeName() != "timestamp":
        raise ValueError(f"{field} is no timestamp")
    return df.withWatermark(field, delay)


def time_window(event_time, duration: str, *, slide: str | None = None, start: str | None = None) -> Column:
    """struct(start, end), tumbling or sliding."""
    return F.window(event_time, duration, slide, start)


def session_window(event_time, gap: str) -> Column:
    return F.session_window(event_time, gap)


def window_time(window) -> Column:
    """The last instant of a window, for windows of windows."""
    return F.window_time(window)


def windowed(df: DataFrame, event_time: str, duration: str, *keys: str, delay: str = "10 minutes", slide: str | None = None, metrics: dict[str, Column]) -> DataFrame:
    """Watermarked counts and sums by window and keys."""
    marked = watermark(df, event_time, delay=delay) if df.isStreaming else df
    grouped = marked.groupBy(F.window(event_time, duration, slide).alias("w"), *keys).agg(*[c.alias(n) for n, c in metrics.items()])
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *metrics)


def rewindowed(windows: DataFrame, window: str, duration: str, *keys: str, metrics: dict[str, Column]) -> DataFrame:
    """Windows of windows: (window_start, window_end, *keys, *metrics) over the column of windows that an earlier aggregate has made."""
    grouped = windows.groupBy(F.window(F.window_time(window), duration).alias("w"), *keys).agg(*[c.alias(n) for n, c in metrics.items()])
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *metrics)


def sessions(df: DataFrame, event_time: str, gap: str, *keys: str, delay: str = "10 minutes", metrics: dict[str, Column]) -> DataFrame:
    """Sessions of keys that end where nothing happens for the gap."""
    if not keys:
        raise NotAdmitted("sessions need a key")
    marked = watermark(df, event_time, delay=delay) if df.isStreaming else df
    grouped = marked.groupBy(F.session_window(event_time, gap).alias("w"), *keys).agg(*[c.alias(n) for n, c in metrics.items()])
    return grouped.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, *metrics)


def interval_join(left: DataFrame, right: DataFrame, on: Column, left_time: str, right_time: str, *, upper: str, lower: str = "0 seconds", how: str = "inner", left_delay: str = "10 minutes", right_delay: str = "10 minutes") -> DataFrame:
    """left with the rows of right within the interval of its time; state is kept no longer than that needs."""
    if how not in ("inner", "left", "right", "full", "left_semi"):
        raise NotAdmitted(f"no {how} join of two streams")
    l = watermark(left, left_time, delay=left_delay) if left.isStreaming else left
    r = watermark(right, right_time, delay=right_delay) if right.isStreaming else right
    return l.join(r, on & event_time_between(F.col(left_time), F.col(right_time), upper=upper, lower=lower), how)


@dataclass(frozen=True)
class Shape:
    """What a plan wants to do, to be admitted or not."""

    operation: str
    watermarked: bool = False
    how: str = "inner"
    other_streaming: bool = False
    other_watermarked: bool = False
    interval: bool = False
    output: str = APPEND
    stateful_before: int = 0
    chained: bool = False


_ROW_LOCAL = {"where", "project", "explode", "udf", "union_all", "union_by_name"}
_BATCH_ONLY = {"order_by", "limit", "offset", "sample", "analytic_window", "latest_by", "earliest_by", "select_first_qualified", "require", "hierarchy", "scan", "temporal_one", "as_of_one", "lookup_dedupe", "intersect", "subtract", "except_all"}
_STATEFUL = {"window_aggregate", "session_aggregate", "key_aggregate", "dedupe"}


def admit(shape: Shape) -> str:
    """'ok', or 'unbounded' where state only grows; NotAdmitted says why a shape is refused."""
    op = shape.operation
    if op in _ROW_LOCAL:
        if op.startswith("union") and not shape.other_streaming:
            raise NotAdmitted("a stream is united with streams only")
        return "ok"
    if op in _BATCH_ONLY:
        raise NotAdmitted(f"{op} is for batches")
    stream_join = op == "join" and shape.other_streaming
    if (op in _STATEFUL or stream_join) and shape.stateful_before:
        if not (op == "window_aggregate" and shape.chained and shape.stateful_before == 1 and shape.output == APPEND):
            raise NotAdmitted("one stateful operation a stream, but for windows over the time of windows, appended")
    if op == "window_aggregate":
        if not shape.watermarked or shape.output == COMPLETE:
            raise NotAdmitted("a windowed aggregate needs a watermark, and append or update")
        return "ok"
    if op == "session_aggregate":
        if not shape.watermarked or shape.output != APPEND:
            raise NotAdmitted("sessions need a watermark, and append")
        return "ok"
    if op == "key_aggregate":
        if shape.output == APPEND:
            raise NotAdmitted("an aggregate without event time can't append")
        return "unbounded"
    if op == "dedupe":
        if not shape.watermarked:
            raise NotAdmitted("deduplication needs a watermark")
        return "ok"
    if op == "join" and not shape.other_streaming:
        if shape.how not in ("left", "inner", "left_semi"):
            raise NotAdmitted(f"no {shape.how} join of a stream with a table")
        return "ok"
    if stream_join:
        if shape.how not in ("inner", "left", "right", "full", "left_semi") or not (shape.watermarked and shape.other_watermarked and shape.interval):
            raise NotAdmitted("two streams join by an interval, both watermarked; not cross or anti")
        return "ok"
    raise NotAdmitted(f"{op} is unknown")


_NODES_BATCH_ONLY = {"Sort": "order_by", "GlobalLimit": "limit", "LocalLimit": "limit", "Offset": "offset", "Sample": "sample", "Window": "analytic_window", "Intersect": "intersect", "Except": "subtract"}


def _children(node) -> list:
    seq = node.children()
    return [seq.apply(i) for i in range(seq.size())]


def _window_keys(aggregate) -> tuple[bool, bool]:
    """Whether an aggregate groups by a time window, by a session."""
    keys = aggregate.groupingExpressions()
    text = " ".join(keys.apply(i).sql() + str(keys.apply(i).dataType().catalogString()) for i in range(keys.size())).lower()
    session = "session_window" in text
    return "struct<start:timestamp,end:timestamp>" in text and not session, session


def shapes(df: DataFrame, output: str = APPEND) -> list[Shape]:
    """The shapes of a stream's analysed plan, from its sources to its end; the parts of it that are tables have none."""
    out: list[Shape] = []

    def walk(node) -> tuple[bool, int, bool]:
        """Whether the node has a watermark below, how many stateful operations, and whether the last of these is a window."""
        below = [walk(c) for c in _children(node) if c.isStreaming()]
        marked, before, window = any(b[0] for b in below), sum(b[1] for b in below), any(b[2] for b in below)
        kind = node.nodeName()
        if not node.isStreaming():
            return False, 0, False
        if kind == "EventTimeWatermark":
            return True, before, window
        if kind in _NODES_BATCH_ONLY:
            out.append(Shape(_NODES_BATCH_ONLY[kind]))
        elif kind == "Aggregate":
            by_window, by_session = _window_keys(node)
            operation = "session_aggregate" if by_session else "window_aggregate" if by_window else "key_aggregate"
            out.append(Shape(operation, watermarked=marked, output=output, stateful_before=before, chained=by_window and window))
            return marked, before + 1, by_window
        elif kind.startswith("Deduplicate") or kind == "Distinct":
            out.append(Shape("dedupe", watermarked=marked, stateful_before=before))
            return marked, before + 1, False
        elif kind == "Union":
            out.append(Shape("union_all", other_streaming=len(below) == len(_children(node))))
        elif kind == "Join":
            how = {"leftouter": "left", "rightouter": "right", "fullouter": "full", "leftsemi": "left_semi", "leftanti": "left_anti"}.get(node.joinType().sql().replace(" ", "").lower(), node.joinType().sql().lower())
            left, right = (c.isStreaming() for c in _children(node))
            if left and right:
                condition = node.condition()
                text = condition.get().sql() if condition.isDefined() else ""
                out.append(Shape("join", how=how, watermarked=below[0][0], other_streaming=True, other_watermarked=below[1][0], interval=" <= " in text or " >= " in text, stateful_before=before))
                return marked, before + 1, False
            out.append(Shape("join", how=how if left else {"left": "right", "right": "left", "left_semi": "right_semi"}.get(how, how)))
        return marked, before, window

    walk(df._jdf.queryExecution().analyzed())
    return out


def admit_plan(df: DataFrame, output: str = APPEND) -> str:
    """admit() for all that the plan of a stream does: 'ok' or 'unbounded'. Hooks in Python are admitted as row-local: what they do isn't seen."""
    if not df.isStreaming:
        raise NotAdmitted("this isn't a stream")
    return "unbounded" if "unbounded" in [admit(s) for s in shapes(df, output)] else "ok"


def to_files(df: DataFrame, path: str, checkpoint: str, *, output: str = APPEND, format: str = "parquet") -> StreamingQuery:
    """What is there now, written once; a later call with the same checkpoint goes on."""
    admit_plan(df, output)
    return df.writeStream.format(format).outputMode(output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def to_memory(df: DataFrame, name: str, checkpoint: str, *, output: str = APPEND) -> StreamingQuery:
    """What is there now, in a table of the session; for tests."""
    admit_plan(df, output)
    return df.writeStream.format("memory").queryName(name).outputMode(output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def for_each_batch(df: DataFrame, function: Callable[[DataFrame, int], None], checkpoint: str, *, output: str = APPEND) -> StreamingQuery:
    """function gets each batch and its number, at least once; a repeated batch has its number again."""
    admit_plan(df, output)
    return df.writeStream.foreachBatch(function).outputMode(output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
