"""Streaming queries, run to the end of the files that are there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import readers
from ..streaming import streams as S
from .book import Book, Tables

BOOK = Book()


#: Files of a micro-batch.
FILES = 1000


def _folder(t: Tables) -> str:
    """A new folder that all executors share; where the session names none a local one (tests) has one of this machine, a cluster an error."""
    base = t.spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = t.spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/streams-{uuid.uuid4().hex}"


def _events(t: Tables) -> DataFrame:
    """The events as a stream, with ts as a timestamp."""
    path = f"{t.folder}/events.parquet"
    schema = readers.inspect_schema(t.spark, path=path)
    folder, _, name = path.rpartition("/")
    is_folder = t.spark.read.parquet(path).inputFiles()[0].rstrip("/").rpartition("/")[2] != name
    stream = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).option("pathGlobFilter", "*.parquet" if is_folder else name)
    return stream.parquet(path if is_folder else folder).withColumn("ts", F.col("ts").cast("timestamp"))


def _run(t: Tables, df: DataFrame, output: str, keys: Sequence[str] = ()) -> DataFrame:
    """All results, kept in files: all batches of an append, of updates the last row of each key, of complete results the last batch."""
    folder, done = _folder(t), set()

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")  # a repeated batch takes its own place
        done.add(number)

    query = S.for_each_batch(df, keep, f"{folder}/checkpoint", output=output)
    query.awaitTermination()
    wanted = sorted(done)[-1:] if output == S.COMPLETE else sorted(done)
    if not wanted:
        return t.spark.createDataFrame([], df.schema)
    if output != S.UPDATE:
        return t.spark.read.schema(df.schema).parquet(*[f"{folder}/out/batch={n}" for n in wanted])
    rows = t.spark.read.option("basePath", f"{folder}/out").parquet(*[f"{folder}/out/batch={n}" for n in wanted])
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), "batch").alias("row")).select("row.*")


@BOOK.query("SELECT event_id, event_type, value * 2 AS twice FROM events WHERE event_type IN ('click', 'view')")
def stream_row_local(t: Tables) -> DataFrame:
    return _run(t, _events(t).where("event_type in ('click', 'view')").select("event_id", "event_type", (F.col("value") * 2).alias("twice")), S.APPEND)


@BOOK.query("SELECT event_type, epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling_window(t: Tables) -> DataFrame:
    windows = S.windowed(_events(t), "ts", "1 day", "event_type", delay="40 days", metrics={"n": F.count("*"), "total": F.sum("value")})
    out = _run(t, windows, S.UPDATE, ["window_start", "event_type"])
    return out.select("event_type", F.unix_seconds("window_start").alias("day"), "n", F.round("total", 4).alias("total"))


@BOOK.query("""SELECT epoch(s)::BIGINT AS start_, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL (6 * k) HOUR AS s FROM events, range(2) r(k)) GROUP BY s""")
def stream_sliding_window(t: Tables) -> DataFrame:
    out = _run(t, S.windowed(_events(t), "ts", "12 hours", delay="40 days", slide="6 hours", metrics={"n": F.count("*")}), S.UPDATE, ["window_start"])
    return out.select(F.unix_seconds("window_start").alias("start_"), "n")


@BOOK.query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def stream_key_aggregate(t: Tables) -> DataFrame:
    return _run(t, _events(t).groupBy("user_id").agg(F.count("*").alias("n")), S.COMPLETE)


@BOOK.query("""WITH g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events))
    SELECT user_id, count(*) AS n, epoch_us(min(ts))::BIGINT AS begin_ FROM g GROUP BY user_id, s""")
def sessions(t: Tables) -> DataFrame:
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = S.sessions(events, "ts", "3 hours", "user_id", metrics={"n": F.count("*")})
    return out.select("user_id", "n", F.unix_micros("session_start").alias("begin_"))


@BOOK.query("""WITH g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events)),
    a AS (SELECT user_id, count(*) AS n, min(ts) AS b, max(ts) + INTERVAL 3 HOUR AS e FROM g GROUP BY user_id, s) SELECT user_id, n, epoch_us(b)::BIGINT AS begin_ FROM a WHERE e <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(t: Tables) -> DataFrame:
    """Sessions are appended once the watermark has passed their end; the last ones are open still."""
    out = _run(t, S.sessions(_events(t), "ts", "3 hours", "user_id", delay="1 hour", metrics={"n": F.count("*")}), S.APPEND)
    return out.select("user_id", "n", F.unix_micros("session_start").alias("begin_"))


@BOOK.query("""WITH h AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type, count(*) AS n FROM events GROUP BY ALL), d AS (SELECT time_bucket(INTERVAL 1 DAY, w) AS day, event_type, max(n) AS busiest, sum(n)::BIGINT AS n FROM h GROUP BY ALL)
    SELECT epoch(day)::BIGINT AS day, event_type, busiest, n FROM d WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_windows_of_windows(t: Tables) -> DataFrame:
    """The busiest hour of each day: an aggregate by hour, and one by day over the time of its windows."""
    hours = S.watermark(_events(t), "ts", delay="1 hour").groupBy(F.window("ts", "1 hour").alias("hour"), "event_type").agg(F.count("*").alias("m"))
    out = _run(t, S.rewindowed(hours, "hour", "1 day", "event_type", metrics={"busiest": F.max("m"), "n": F.sum("m")}), S.APPEND)
    return out.select(F.unix_seconds("window_start").alias("day"), "event_type", "busiest", "n")


@BOOK.query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(t: Tables) -> DataFrame:
    marked = S.watermark(_events(t), "ts", delay="40 days")
    return _run(t, marked.dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type"), S.APPEND)


@BOOK.query("SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey")
def stream_static_join(t: Tables) -> DataFrame:
    joined = _events(t).join(t.customer.select("c_custkey", "c_name"), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name")
    return _run(t, joined, S.APPEND)


@BOOK.query("""SELECT v.event_id AS view_id, c.event_id AS click_id FROM events v JOIN events c ON v.user_id = c.user_id AND v.event_type = 'view' AND c.event_type = 'click' AND c.ts >= v.ts AND c.ts <= v.ts + INTERVAL 2 HOUR""")
def stream_interval_join(t: Tables) -> DataFrame:
    views = _events(t).where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", "ts")
    clicks = _events(t).where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("who"), F.col("ts").alias("at"))
    return _run(t, S.interval_join(views, clicks, F.col("user_id") == F.col("who"), "ts", "at", upper="2 hours", left_delay="40 days", right_delay="40 days").select("view_id", "click_id"), S.APPEND)


@BOOK.query("SELECT event_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_id FROM events WHERE event_type = 'view'")
def stream_union(t: Tables) -> DataFrame:
    events = _events(t)
    return _run(t, events.where("event_type = 'click'").select("event_id").unionAll(events.where("event_type = 'view'").select("event_id")), S.APPEND)


@BOOK.query("""WITH v AS (SELECT * FROM events WHERE event_type = 'view'), c AS (SELECT * FROM events WHERE event_type = 'click')
    SELECT epoch(time_bucket(INTERVAL 1 DAY, v.ts))::BIGINT AS day, count(*) AS clicks FROM v JOIN c ON v.user_id = c.user_id AND c.ts >= v.ts AND c.ts <= v.ts + INTERVAL 1 HOUR GROUP BY 1""")
def stream_click_model(t: Tables) -> DataFrame:
    """Impressions and clicks, each without repeats, joined within an hour; the matches are counted by day of the impression, as a batch."""
    dedupe = lambda df, time: S.watermark(df, time, delay="40 days").dropDuplicatesWithinWatermark(["event_id"])
    views = dedupe(_events(t).where("event_type = 'view'").select("event_id", "user_id", "ts"), "ts")
    views = _run(t, views, S.APPEND)
    clicks = _events(t).where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("who"), F.col("ts").alias("at"))
    matched = _run(t, clicks.join(views, (F.col("user_id") == F.col("who")) & S.event_time_between(F.col("ts"), F.col("at"), upper="1 hour")), S.APPEND)
    return matched.groupBy(F.unix_seconds(F.date_trunc("day", "ts")).alias("day")).agg(F.count("*").alias("clicks"))


@BOOK.query("SELECT event_type, user_id, count(*) AS n, epoch_us(max(ts)) AS last_, epoch_us(min(ts)) AS first_ FROM events JOIN customer ON user_id = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY ALL")
def stream_progress(t: Tables) -> DataFrame:
    """Enriched by a table, then progress by key in complete mode."""
    ours = _events(t).join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("user_id") == F.col("c_custkey"), "left_semi")
    out = _run(t, ours.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_"), F.min("ts").alias("first_")), S.COMPLETE)
    return out.select("event_type", "user_id", "n", F.unix_micros("last_").alias("last_"), F.unix_micros("first_").alias("first_"))
