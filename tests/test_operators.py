"""What SQL doesn't show: failing guards, ties, contracts, admission, streams that restart."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.functions import documents as D
from braidwork.operators import aggregates as A
from braidwork.operators import guards as G
from braidwork.operators import hierarchy as H
from braidwork.operators import joins as J
from braidwork.operators import relations as R
from braidwork.operators import scan as S
from braidwork.plans import registry
from braidwork.sources import readers
from braidwork.streaming import streams as T


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k long, v string")


ACTIONS = [lambda df: df.collect(), lambda df: df.count(), lambda df: df.agg(F.max("k")).collect(), lambda df: df.limit(1).collect()]


@pytest.mark.parametrize("act", ACTIONS)
@pytest.mark.parametrize(
    "guard, code",
    [
        (lambda df: G.require_unique(df, "k"), "KEY_REPEATS"),
        (lambda df: G.require_all(df, F.col("v") != "z"), "ROW_FAILS"),
        (lambda df: G.require_reference(df, "k", df.where("k = 1"), "k"), "NO_REFERENCE"),
        (lambda df: G.require_reference(df, "v", df.where("v is not null"), "v", nulls="reject"), "NO_REFERENCE"),
        (lambda df: G.exactly_one(df), "NOT_ONE_ROW"),
        (lambda df: R.latest_by(df.withColumn("t", F.lit(1)), "t", partition_by=["k"]), "TIE"),
        (lambda df: R.select_first_qualified(df, ["k"], where=F.col("v").isNotNull(), order_by="v", missing="error"), "NONE_QUALIFIES"),
        (lambda df: J.lookup_join(df, df.withColumn("t", F.lit(1)), ["k"], latest_by="t"), "TIE"),
    ],
)
def test_guards_fire_in_every_action(pairs, guard, code, act):
    with pytest.raises(Exception, match=code):
        act(guard(pairs))


def test_satisfied_guards_let_rows_through(pairs):
    assert G.require_unique(pairs, "k", "v").count() == 3
    assert G.require_all(pairs, F.col("k") > 0).count() == 3
    assert G.require_reference(pairs, "v", pairs.where("v is not null"), "v").count() == 3
    assert G.exactly_one(pairs.where("k = 2")).count() == 1
    assert R.latest_by(pairs, "v", partition_by=["k"]).count() == 2
    assert R.latest_by(pairs.withColumn("t", F.lit(1)), "t", partition_by=["k"], ties="any").count() == 2


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def test_as_of_directions_tolerance_and_ties(spark):
    left = spark.createDataFrame([(1, "x", at(10)), (2, "x", at(3)), (3, None, at(5)), (4, "x", None), (5, "y", at(1))], "id long, key string, t timestamp")
    right = spark.createDataFrame([("x", at(4), 4), ("x", at(9), 9), ("x", at(12), 12), (None, at(5), 0), ("x", None, -1)], "key string, u timestamp, n int")
    find = lambda **o: {r.id: r.n for r in J.as_of_one(left, right, ["key"], "t", "u", **o).collect()}
    assert find() == {1: 9, 2: None, 3: None, 4: None, 5: None}
    assert find(direction="forward") == {1: 12, 2: 4, 3: None, 4: None, 5: None}
    assert find(direction="nearest") == {1: 9, 2: 4, 3: None, 4: None, 5: None}
    assert find(direction="forward", tolerance="90 seconds") == {1: None, 2: 4, 3: None, 4: None, 5: None}
    assert find(how="inner") == {1: 9}
    even = spark.createDataFrame([("x", at(8), 8), ("x", at(12), 12)], "key string, u timestamp, n int")
    with pytest.raises(Exception, match="TIE"):
        J.as_of_one(left, even, ["key"], "t", "u", direction="nearest").collect()


def test_overlapping_versions_raise(spark):
    rows = spark.createDataFrame([("x", at(5))], "key string, t timestamp")
    good = spark.createDataFrame([("x", at(0), at(5), 1), ("x", at(5), None, 2)], "key string, f timestamp, u timestamp, n int")
    assert [r.n for r in J.temporal_one(rows, good, ["key"], "t", "f", "u").collect()] == [2]
    bad = good.unionAll(spark.createDataFrame([("x", at(4), at(6), 3)], good.schema))
    with pytest.raises(Exception, match="OVERLAP"):
        J.temporal_one(rows, bad, ["key"], "t", "f", "u").collect()


def test_param_join_needs_one_row(spark, pairs):
    with pytest.raises(Exception, match="NOT_ONE_ROW"):
        J.param_join(pairs, pairs.select("v")).collect()
    with pytest.raises(ValueError):
        J.cross_join(pairs, pairs)


def test_scan_guards(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("b", 1, 1)], "g string, t int, x int")
    run = lambda d, n=10: S.scan(d, initial=F.struct(F.lit(0).alias("s")), step=lambda s, r: F.struct((s["s"] + r["x"]).alias("s")), partition_by=["g"], order_by=["t"], max_rows=n)
    assert sorted((r.g, r.t, r.state.s) for r in run(df).collect()) == [("a", 1, 0), ("a", 2, 5), ("b", 1, 0)]
    assert run(df.limit(0)).count() == 0
    for bad, n in ((df.unionAll(df), 10), (df, 1), (df.withColumn("t", F.lit(None).cast("int")), 10)):
        with pytest.raises(Exception, match="SCAN"):
            run(bad, n).collect()


def test_hierarchy_guards(spark):
    make = lambda rows: spark.createDataFrame(rows, "id long, up long")
    check = lambda rows, n=5: H.require_parent_hierarchy(make(rows), "id", "up", order_by="id", max_depth=n).count()
    assert check([(1, None), (2, 1), (3, 2)]) == 3
    for rows, n in (([(1, None), (3, 2)], 5), ([(1, 2), (2, 1)], 5), ([(1, None), (2, 1), (3, 2)], 1), ([(2, None), (1, 2)], 5)):
        with pytest.raises(Exception, match="HIERARCHY"):
            check(rows, n)


def test_ordered_lists_and_filters(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (1, "c", 1), (1, None, 0)], "k long, v string, o int")
    r = df.groupBy("k").agg(A.collect_list("v", order_by="o").alias("l"), A.count(where=F.col("o") > 1).alias("n"), A.mode("o", deterministic=True).alias("m")).first()
    assert (r.l, r.n, r.m) == (["c", "a", "b"], 2, 2)


def test_union_defaults_and_contracts(spark, pairs):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    out = R.union_by_name(pairs, spark.createDataFrame([(9,)], "k long"), allow_missing_columns=True, defaults={"v": "none"})
    assert {r.v for r in out.where("k = 9").collect()} == {"none"}
    nested = pairs.select("k", F.struct("v").alias("s"))
    more = pairs.select("k", F.struct("v", F.lit(1).alias("n")).alias("s"))
    assert R.union_by_name(nested, more, allow_missing_columns=True, defaults={"s.n": 5}).where("s.n = 5").count() == 3
    schema = StructType([StructField("v", StringType()), StructField("k", LongType())])
    assert readers.conform(pairs, schema).columns == ["v", "k"]
    extra = pairs.withColumn("z", F.lit(1))
    with pytest.raises(readers.ContractError):
        readers.conform(extra, schema)
    assert readers.conform(extra, schema, mode="allow").columns == ["v", "k", "z"] and readers.conform(extra, schema, mode="project").columns == ["v", "k"]
    with pytest.raises(readers.ContractError):
        readers.conform(pairs.withColumn("k", F.lit("x")), schema)
    assert readers.optional_input(spark, None, schema).count() == 0
    space = {}
    exec(readers.schema_source(schema), space)
    assert space["SCHEMA"] == schema


def test_files_round_trip(spark, pairs, tmp_path):
    for kind in ("parquet", "orc", "json"):
        readers.write(pairs, f"file://{tmp_path}/{kind}", format=kind)
        assert sorted(map(str, readers.read(spark, f"file://{tmp_path}/{kind}", format=kind, schema=pairs.schema).collect())) == sorted(map(str, pairs.collect()))


def test_unavailable_functions_say_so(spark):
    with pytest.raises(D.Unavailable):
        D.variant_set(F.lit(1), "$.a", F.lit(1))
    with pytest.raises(D.Unavailable):
        D.geometry_from_wkt(spark, F.lit("POINT (0 0)"), srid=4326)


@pytest.mark.parametrize(
    "shape, answer",
    [
        (T.Shape("where"), "ok"), (T.Shape("explode"), "ok"), (T.Shape("window_aggregate", watermarked=True), "ok"), (T.Shape("window_aggregate"), None), (T.Shape("key_aggregate", output="update"), "unbounded"), (T.Shape("key_aggregate"), None),
        (T.Shape("session_aggregate", watermarked=True), "ok"), (T.Shape("session_aggregate", watermarked=True, output="update"), None), (T.Shape("dedupe"), None), (T.Shape("dedupe", watermarked=True), "ok"), (T.Shape("dedupe", watermarked=True, stateful_before=1), None),
        (T.Shape("join", how="left"), "ok"), (T.Shape("join", how="left_anti"), None), (T.Shape("join", how="full"), None), (T.Shape("join", other_streaming=True, watermarked=True, other_watermarked=True, interval=True, how="full"), "ok"),
        (T.Shape("join", other_streaming=True, watermarked=True, other_watermarked=True), None), (T.Shape("union_all", other_streaming=True), "ok"), (T.Shape("union_all"), None), (T.Shape("order_by"), None), (T.Shape("scan"), None), (T.Shape("as_of_one"), None), (T.Shape("nonsense"), None),
    ],
)
def test_admission(shape, answer):
    if answer is None:
        with pytest.raises(T.NotAdmitted):
            T.admit(shape)
    else:
        assert T.admit(shape) == answer


def test_stream_restarts_and_emits_late_windows_once(spark, tmp_path):
    source, out, checkpoint = f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"
    batch = lambda *minutes: spark.createDataFrame([(m, at(0) + dt.timedelta(minutes=m)) for m in minutes], "id int, ts timestamp").coalesce(1).write.mode("append").parquet(source)
    batch(1, 2, 12)
    stream = readers.read(spark, source, schema=spark.read.parquet(source).schema, streaming=True)
    windows = T.windowed(stream, "ts", "10 minutes", delay="5 minutes", metrics={"n": F.count("*")})
    T.to_files(windows, out, checkpoint).awaitTermination()
    batch(40)
    T.to_files(windows, out, checkpoint).awaitTermination()
    batch(3, 55)  # 3 is late
    T.to_files(windows, out, checkpoint).awaitTermination()
    got = sorted((r.window_start.minute, r.n) for r in spark.read.parquet(out).collect())
    assert got == [(0, 2), (10, 1), (40, 1)]


def test_session_stream_equals_batch(spark, tmp_path):
    rows = [(u, at(m)) for u, m in [(1, 0), (1, 3), (1, 20), (2, 5)]] + [(9, dt.datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "user long, ts timestamp")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = readers.read(spark, f"file://{tmp_path}/in", schema=df.schema, streaming=True)
    made = T.sessions(stream, "ts", "10 minutes", "user", delay="1 minute", metrics={"n": F.count("*")})
    T.to_memory(made, "sessions_", f"file://{tmp_path}/checkpoint").awaitTermination()
    want = T.sessions(df, "ts", "10 minutes", "user", metrics={"n": F.count("*")}).where("user < 9")
    assert sorted(map(str, spark.table("sessions_").collect())) == sorted(map(str, want.collect()))


def test_step_graphs(spark, pairs):
    from braidwork.plans import compose

    graph = compose.Graph(b=lambda a: a.where("k = 1"), c=lambda b, pairs: b.unionAll(pairs), a=lambda pairs: pairs.where("v is not null"))
    assert graph.order({"pairs": pairs}) == ["a", "b", "c"]
    assert graph.run(pairs=pairs)["c"].count() == 5
    assert graph.extend(a=lambda pairs: pairs).run(pairs=pairs)["b"].count() == 2
    with pytest.raises(compose.GraphError, match="no pairs"):
        graph.run()
    with pytest.raises(compose.GraphError, match="cycle"):
        compose.Graph(x=lambda y: y, y=lambda x: x).run()
    assert compose.chain(lambda df: df.where("k = 1"), lambda df: df.limit(1))(pairs).count() == 1
    assert "Filter" in compose.plan_text(pairs.where("k = 1"))


def _in_parts(spark, folder, tmp_path):
    """The events in three files, so that there are three micro-batches."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    events.repartitionByRange(3, "ts").write.parquet(f"{tmp_path}/events.parquet")
    for name in ("customer",):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["stream_tumbling_window", "stream_sliding_window", "stream_key_aggregate", "stream_progress", "stream_row_local", "stream_dedupe", "stream_union", "stream_static_join"])
def test_streams_in_several_batches_are_the_same(spark, folder, tmp_path, monkeypatch, name):
    from braidwork.plans import registry
    from braidwork.plans import streams as plans

    monkeypatch.setattr(plans, "FILES", 1)
    got = registry.queries()[name](spark, _in_parts(spark, folder, tmp_path))
    want = registry.queries()[name](spark, folder)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_plans_are_admitted_or_refused(spark, folder):
    from braidwork.plans import streams as plans
    from braidwork.plans.book import Tables
    from braidwork.streaming import streams as S

    t = Tables(spark, folder)
    events = plans._events(t)
    marked = S.watermark(events, "ts", delay="1 hour")
    by_hour = marked.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    other = S.watermark(plans._events(t).select(F.col("user_id").alias("who"), F.col("ts").alias("at")), "at", delay="1 hour")
    on = F.col("user_id") == F.col("who")
    near = on & S.event_time_between(F.col("ts"), F.col("at"), upper="1 hour")
    fine = [(events.where("value > 1"), S.APPEND, "ok"), (by_hour, S.UPDATE, "ok"), (events.groupBy("user_id").count(), S.UPDATE, "unbounded"), (S.rewindowed(by_hour, "w", "1 day", metrics={"n": F.sum("n")}), S.APPEND, "ok"),
            (marked.dropDuplicatesWithinWatermark(["event_id"]), S.APPEND, "ok"), (marked.join(other, near), S.APPEND, "ok"), (events.join(t.customer, F.col("user_id") == F.col("c_custkey"), "left"), S.APPEND, "ok"), (S.sessions(events, "ts", "1 hour", "user_id", metrics={"n": F.count("*")}), S.APPEND, "ok")]
    assert [S.admit_plan(df, output) for df, output, _ in fine] == [word for *_, word in fine]
    refused = [(events.orderBy("ts"), S.APPEND), (events.limit(3), S.APPEND), (events.groupBy(F.window("ts", "1 hour")).count(), S.APPEND), (by_hour, S.COMPLETE), (events.groupBy("user_id").count(), S.APPEND), (by_hour.groupBy("event_type").count(), S.COMPLETE), (S.rewindowed(by_hour, "w", "1 day", metrics={"n": F.sum("n")}), S.UPDATE),
               (events.dropDuplicates(["event_id"]), S.APPEND), (marked.join(other, on), S.APPEND), (events.join(other, near), S.APPEND), (events.join(t.customer, F.col("user_id") == F.col("c_custkey"), "right"), S.APPEND), (events.select(F.row_number().over(Window.partitionBy("user_id").orderBy("ts"))), S.APPEND), (t.events, S.APPEND)]
    for df, output in refused:
        with pytest.raises(S.NotAdmitted):
            S.for_each_batch(df, lambda batch, n: None, "/tmp/never", output=output)


def test_batch_operators_refuse_streams(spark, folder):
    from braidwork.operators import joins as J
    from braidwork.operators import relations as R
    from braidwork.operators.guards import NotAdmitted
    from braidwork.plans import streams as plans
    from braidwork.plans.book import Tables

    t = Tables(spark, folder)
    events = plans._events(t)
    for refused in (lambda: R.order_by(events, "ts"), lambda: R.limit(events, 1, "ts"), lambda: R.sample(events, 0.5, seed=1), lambda: R.latest_by(events, "ts", partition_by=["user_id"]), lambda: R.top_k(events, 1, partition_by=["user_id"], order_by=[F.col("ts")]), lambda: R.subtract(events, events), lambda: R.union_all(events, t.events.withColumn("ts", F.col("ts").cast("timestamp"))), lambda: J.as_of_one(events, t.events, ["user_id"], "ts", "ts")):
        with pytest.raises(NotAdmitted):
            refused()


def test_helper_columns_leave_those_of_the_tables_alone(spark):
    from braidwork.operators import joins as J
    from braidwork.operators import relations as R

    df = spark.createDataFrame([(1, 1, "a", "g", "me"), (1, 2, "b", "g", "you"), (2, 1, "c", "h", "it")], "k int, t int, place_ string, guard string, rank string")
    assert sorted(map(tuple, R.latest_by(df, "t", partition_by=["k"]).collect())) == [(1, 2, "b", "g", "you"), (2, 1, "c", "h", "it")]
    looked = J.lookup_join(spark.createDataFrame([(1,), (3,)], "k int"), df.withColumnRenamed("place_", "Place"), ["k"], latest_by="t")
    assert looked.columns == ["k", "t", "Place", "guard", "rank"] and sorted(r.Place or "" for r in looked.collect()) == ["", "b"]
    with pytest.raises(ValueError):
        R.top_k(df, 1, partition_by=["k"], order_by=[F.desc("t")])
    assert sorted((r["rank"], r.n) for r in R.top_k(df, 1, partition_by=["k"], order_by=[F.desc("t")], rank="n").collect()) == [("it", 1), ("you", 1)]


def test_folds_in_chunks_of_any_length(spark):
    from braidwork.operators.scan import scan

    rows = [(k, i, float(i % 7)) for k, n in ((0, 1), (1, 2), (2, 5), (3, 17), (4, 1000)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    got = {(r.k, r.i): r.state for r in scan(df, initial=F.lit(0.0), step=lambda s, r: s * 0.5 + r["v"], partition_by=["k"], order_by=["i"], max_rows=2000).collect()}
    for k in range(5):
        state = 0.0
        for _, i, v in [r for r in rows if r[0] == k]:
            assert got[k, i] == pytest.approx(state)
            state = state * 0.5 + v


@pytest.mark.parametrize("broadcast", [True, False])
def test_band_join_meets_bins_and_not_all_rows(spark, monkeypatch, broadcast):
    nan = float("nan")
    bands = [(1, 0.0, 10.0), (2, -7.5, 31.0), (3, 10.0, 10.0), (4, None, 5.0), (5, 9.0, 3.0), (6, -10.0, 0.0), (7, nan, 4.0), (8, 2.0, nan), (1, 0.0, 10.0)]
    values = [(i, v) for i, v in enumerate([-10.0, -7.5, -0.1, 0.0, 0.1, 9.99, 10.0, 30.9, 31.0, None, 5.0, 5.0, nan])]
    if not broadcast:
        monkeypatch.setattr(J, "BAND_ROWS", 0)
    left, right = spark.createDataFrame(bands, "bin long, lo double, hi double"), spark.createDataFrame(values, "id long, low double")
    out = J.band_join(left, right, F.col("lo"), F.col("hi"), F.col("low"), width=10)
    assert out.columns == ["bin", "lo", "hi", "id", "low"]
    want = [(b, i) for b, lo, hi in bands for i, v in values if None not in (lo, hi, v) and lo < v < hi]
    assert sorted((r["bin"], r["id"]) for r in out.collect()) == sorted(want)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_theta_join_compares_no_row_with_all(spark, folder):
    plan = registry.queries()["theta_join"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("deepest", range(1, 12))
def test_hierarchy_depth_is_exact(spark, deepest):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(deepest + 1)] + [(100, None), (101, 100)], "id long, parent long")
    assert H.require_parent_hierarchy(chain, "id", "parent", order_by="id", max_depth=deepest).count() == deepest + 3
    with pytest.raises(Exception, match="HIERARCHY"):
        H.require_parent_hierarchy(chain, "id", "parent", order_by="id", max_depth=deepest - 1).count()


def test_hierarchy_depth_takes_few_joins(spark, folder):
    plan = registry.queries()["checked_hierarchy"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") < 40 and H._ancestors(spark.createDataFrame([(i + 1, i) for i in range(30)], "from_ long, to_ long"), 21).count() == 10


def test_shared_members_are_counted_once_a_pair(spark):
    import itertools
    import random

    from braidwork.plans import pipelines as P

    r = random.Random(3)
    rows = list({(r.randrange(12), r.randrange(9)) for _ in range(60)} | {(0, u) for u in range(9)}) + [(None, 1), (None, 2), (3, None)]
    members = {}
    for p, u in rows:
        if p is not None and u is not None:
            members.setdefault(p, set()).add(u)
    counts = {}
    for us in members.values():
        for pair in itertools.combinations(sorted(us), 2):
            counts[pair] = counts.get(pair, 0) + 1
    df = spark.createDataFrame(rows, "p long, u long")
    out = P.shared_members(df, "p", "u", least=3, tasks=7)
    assert sorted(map(tuple, out.collect())) == sorted((*k, n) for k, n in counts.items() if n >= 3)
    assert out.rdd.getNumPartitions() == 7


@pytest.mark.parametrize("block", [1 << 22, 700])
def test_vector_search_over_blocks_with_copies(spark, monkeypatch, block):
    import numpy as np

    from braidwork.plans import pipelines as P

    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "ASKED", 50)
    r = np.random.default_rng(5)
    base = [*r.normal(size=(40, 7)).astype("float32").tolist(), [0.0] * 7, None, [1.0, None], *r.normal(size=(9, 3)).astype("float32").tolist()]
    rows = [(i, base[i % len(base)]) for i in range(4 * len(base))] + [(3, base[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")

    def product(x, y):
        total = 0.0
        for p, q in zip(x, y):
            total += float(np.float32(p)) * float(np.float32(q))
        return total

    live = [(i, v) for i, v in rows if v and None not in v and any(v)]
    want = []
    for i, v in live:
        near = sorted((-(product(v, w) / (product(v, v) ** 0.5 * product(w, w) ** 0.5)), j) for j, w in live if i != j and len(v) == len(w))
        want += [(i, j, -s) for s, j in near[:6]] if i != 3 else []
    got = [(x["query_id"], x["vec_id"], x["score"]) for x in P.vector_search(df, df, 6).orderBy("query_id", "rank").collect() if x["query_id"] != 3]
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want, key=lambda x: x[0])]


def test_vector_search_sends_vectors_and_no_blocks(spark, folder):
    plan = registry.queries()["exact_vector_search"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_documents_are_scored_where_they_lie(spark, monkeypatch, folder):
    from braidwork.plans import pipelines as P

    queries = registry.queries()
    for name in ("bm25_scores", "blended_scores"):
        plan = queries[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Generate explode" not in plan
    plan = queries["overlap_filter"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate explode" not in plan

    docs = spark.createDataFrame([(i, "  ".join(f"W{j % 7}" for j in range(i % 11)) if i % 5 else None) for i in range(60)] + [(60, ""), (61, " w1\tw1\u00e9 ")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "w1 w2 w3 w1"), (2, "w6 w5"), (3, ""), (4, None), (5, "zz"), (6, "w1\u00e9 w0")], "item_id long, text string")
    split = lambda text: (text or "").lower().split()
    pairs = [(i["item_id"], d["doc_id"], len(set(split(i["text"])) & set(split(d["text"])))) for i in items.collect() for d in docs.collect()]
    monkeypatch.setattr(P, "PASS_TERMS", 2)
    monkeypatch.setattr(P, "PLACES", 3)
    want = sorted((i, d, n) for i, d, n in pairs if n)
    assert sorted((r["item_id"], r["doc_id"], r["matched"]) for r in P.bm25(docs, items).collect()) == want
    best = sorted(want, key=lambda x: (x[0], -x[2], x[1]))
    best = [x for k, x in enumerate(best) if k < 4 or best[k - 4][0] != x[0]]
    assert [tuple(r)[:3] for r in P.overlaps(docs, items, 4).orderBy("item_id", "rank").collect()] == best
    assert P.bm25(docs, items.where("item_id = 3")).count() == P.overlaps(docs, items.where("item_id = 4"), 4).count() == 0
