"""Queries of aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import windows as W
from .book import Book, Tables

BOOK = Book()


@BOOK.query("""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(DISTINCT o_custkey) AS customers,
      count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') AS customers_f, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean,
      round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 2) AS sum_p, bool_and(o_totalprice > 900) AS all_, bool_or(o_totalprice > 499000) AS any_
    FROM orders GROUP BY o_orderpriority""")
def filtered_metrics(t: Tables) -> DataFrame:
    f, p, price = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P", F.col("o_totalprice")
    return A.group_by(t.orders, "o_orderpriority", metrics={
        "n": A.count(), "n_f": A.count(where=f), "customers": A.count_distinct("o_custkey"), "customers_f": A.count_distinct("o_custkey", where=f), "lo": A.min(price), "hi": A.max(price),
        "mean": F.round(A.avg(price), 4), "sum_p": F.round(A.sum(price, where=p), 2), "all_": A.bool_and(price > 900), "any_": A.bool_or(price > 499000),
    })


@BOOK.query("SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS lines, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def global_aggregate(t: Tables) -> DataFrame:
    return A.group_by(t.lineitem, metrics={"n": A.count(), "lines": A.sum("l_linenumber"), "suppliers": A.count_distinct("l_suppkey")})


@BOOK.query("""WITH m AS (SELECT l_returnflag AS f, l_quantity AS x, l_extendedprice AS y FROM lineitem), a AS (SELECT f, avg(x) AS mu FROM m GROUP BY f)
    SELECT m.f AS l_returnflag, round(stddev_samp(x), 6) AS sd, round(var_samp(x), 6) AS var, round(avg((x - mu) ** 3) / pow(avg((x - mu) ** 2), 1.5), 6) AS skew,
      round(avg((x - mu) ** 4) / pow(avg((x - mu) ** 2), 2) - 3, 6) AS kurt, round(corr(x, y), 6) AS r, round(covar_samp(x, y), 4) AS cov
    FROM m JOIN a ON m.f = a.f GROUP BY m.f""")
def moments(t: Tables) -> DataFrame:
    x, y = "l_quantity", "l_extendedprice"
    r = lambda c, n=6: F.round(c, n)
    return A.group_by(t.lineitem, "l_returnflag", metrics={"sd": r(A.stddev(x)), "var": r(A.variance(x)), "skew": r(A.skewness(x)), "kurt": r(A.kurtosis(x)), "r": r(A.corr(x, y)), "cov": r(A.covar(x, y), 4)})


@BOOK.query("""SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.25), 6) AS q1, round(quantile_cont(c_acctbal, 0.9) FILTER (WHERE c_acctbal > 0), 6) AS q9 FROM customer GROUP BY c_mktsegment""")
def exact_percentiles(t: Tables) -> DataFrame:
    return A.group_by(t.customer, "c_mktsegment", metrics={"q1": F.round(A.percentile("c_acctbal", 0.25), 6), "q9": F.round(A.percentile("c_acctbal", 0.9, where=F.col("c_acctbal") > 0), 6)})


@BOOK.query()
def approximate_aggregates(t: Tables) -> DataFrame:
    return A.group_by(t.orders, "o_orderstatus", metrics={"customers": A.approx_count_distinct("o_custkey", relative_sd=0.02), "median": A.approx_percentile("o_totalprice", 0.5, accuracy=1000)})


@BOOK.query("""WITH n AS (SELECT c_mktsegment, c_nationkey, count(*) AS k FROM customer GROUP BY ALL)
    SELECT c_mktsegment, c_nationkey AS common FROM n QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY k DESC, c_nationkey) = 1""")
def deterministic_mode(t: Tables) -> DataFrame:
    return A.group_by(t.customer, "c_mktsegment", metrics={"common": A.mode("c_nationkey", deterministic=True)})


@BOOK.query("""SELECT user_id, list(event_id ORDER BY ts) AS in_order, list_sort(list(DISTINCT event_type)) AS kinds, arg_min(event_id, ts) AS first_id, arg_max(event_id, ts) AS last_id,
      arg_max(event_id, ts) FILTER (WHERE event_type = 'click') AS last_click FROM events GROUP BY user_id""")
def collected(t: Tables) -> DataFrame:
    return A.group_by(t.events, "user_id", metrics={
        "in_order": A.collect_list("event_id", order_by="ts"), "kinds": F.sort_array(A.collect_set("event_type")), "first_id": A.first_value("event_id", order_by="ts"),
        "last_id": A.last_value("event_id", order_by="ts"), "last_click": A.last_value("event_id", order_by="ts", where=F.col("event_type") == "click"),
    })


@BOOK.query("SELECT year(o_orderdate)::INT AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL HAVING n > 60")
def named_keys_and_having(t: Tables) -> DataFrame:
    return A.group_by(t.orders, "o_orderstatus", y=F.year("o_orderdate"), metrics={"n": A.count()}, having=F.col("n") > 60)


_LEVELS = "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, grouping(l_returnflag, l_linestatus)::BIGINT AS g FROM lineitem GROUP BY "
_METRICS = {"n": A.count, "q": lambda: F.round(A.sum("l_quantity"), 2), "g": lambda: A.grouping_id()}


def _metrics() -> dict:
    return {n: f() for n, f in _METRICS.items()}


@BOOK.query(_LEVELS + "ROLLUP (l_returnflag, l_linestatus)")
def rollup(t: Tables) -> DataFrame:
    return A.rollup(t.lineitem, "l_returnflag", "l_linestatus", metrics=_metrics())


@BOOK.query(_LEVELS + "CUBE (l_returnflag, l_linestatus)")
def cube(t: Tables) -> DataFrame:
    return A.cube(t.lineitem, "l_returnflag", "l_linestatus", metrics=_metrics())


@BOOK.query("""SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) = 1 AS no_flag FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""")
def grouping_sets(t: Tables) -> DataFrame:
    return A.grouping_sets(t.lineitem, [["l_returnflag"], ["l_linestatus"], []], metrics={"n": A.count(), "no_flag": A.is_grouped("l_returnflag")})


@BOOK.query("""SELECT c_custkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, round(percent_rank() OVER v, 9) AS pr, round(cume_dist() OVER v, 9) AS cd, ntile(4) OVER w AS quarter
    FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey), v AS (PARTITION BY c_mktsegment ORDER BY c_nationkey)""")
def rankings(t: Tables) -> DataFrame:
    by, w, v = {"partition_by": "c_mktsegment"}, [F.desc("c_acctbal"), F.asc("c_custkey")], W.window(partition_by="c_mktsegment", order_by="c_nationkey")
    return t.customer.select(
        "c_custkey", W.row_number(**by, order_by=w).alias("rn"), W.rank(**by, order_by="c_nationkey").alias("rk"), W.dense_rank(**by, order_by="c_nationkey").alias("dr"), F.round(W.percent_rank(over=v), 9).alias("pr"),
        F.round(W.cume_dist(over=v), 9).alias("cd"), W.ntile(4, over=W.window(partition_by="c_mktsegment", order_by=w)).alias("quarter"),
    )


@BOOK.query("""SELECT event_id, lag(value) OVER w AS before, lag(value, 2, -1.0) OVER w AS before2, lead(event_id) OVER w AS next_id, nth_value(value, 3) OVER f AS third,
      first_value(value) OVER f AS first_, last_value(value) OVER f AS last_ FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts), f AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def offsets(t: Tables) -> DataFrame:
    by = {"partition_by": "user_id", "order_by": "ts"}
    f = W.window(**by, frame=W.rows_between(W.unbounded_preceding(), W.unbounded_following()))
    return t.events.select(
        "event_id", W.lag("value", **by).alias("before"), W.lag("value", **by, offset=2, default=-1.0).alias("before2"), W.lead("event_id", **by).alias("next_id"), W.nth_value("value", 3, over=f).alias("third"),
        W.first_value("value", over=f).alias("first_"), W.last_value("value", over=f).alias("last_"),
    )


@BOOK.query("""SELECT event_id, round(sum(value) OVER w, 6) AS s, round(avg(value) OVER w, 6) AS a, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def rolling(t: Tables) -> DataFrame:
    by = {"partition_by": "user_id", "order_by": "ts", "preceding": 4}
    return t.events.select("event_id", F.round(W.rolling_sum("value", **by), 6).alias("s"), F.round(W.rolling_avg("value", **by), 6).alias("a"), W.rolling_min("value", **by).alias("lo"), W.rolling_max("value", **by).alias("hi"))


@BOOK.query("""SELECT event_id, round(sum(value) OVER w, 6) AS s, count(*) OVER w AS n, bool_and(value > 1) OVER w AS all_, bool_or(value > 90) OVER w AS any_, round(stddev_samp(value) OVER w, 6) AS sd,
      round(var_samp(value) OVER w, 6) AS var, list(event_id) OVER w AS ids, len(list_distinct(list(event_type) OVER w)) AS kinds
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING)""")
def framed(t: Tables) -> DataFrame:
    w = W.window(partition_by="user_id", order_by="ts", frame=W.rows_between(W.preceding(3), W.following(1)))
    return t.events.select(
        "event_id", F.round(W.window_sum("value", over=w), 6).alias("s"), W.window_count(over=w).alias("n"), W.window_bool_and(F.col("value") > 1, over=w).alias("all_"), W.window_bool_or(F.col("value") > 90, over=w).alias("any_"),
        F.round(W.window_stddev("value", over=w), 6).alias("sd"), F.round(W.window_variance("value", over=w), 6).alias("var"), W.window_collect_list("event_id", over=w).alias("ids"), W.window_count_distinct("event_type", over=w).alias("kinds"),
    )


@BOOK.query("""SELECT p_partkey, count(*) OVER w AS n, round(avg(p_retailprice) OVER w, 6) AS mean FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def range_frame(t: Tables) -> DataFrame:
    w = W.window(partition_by="p_brand", order_by="p_size", frame=W.range_between(W.preceding(5), W.current_row()))
    return t.part.select("p_partkey", W.window_count("p_partkey", over=w).alias("n"), F.round(W.window_avg("p_retailprice", over=w), 6).alias("mean"))
