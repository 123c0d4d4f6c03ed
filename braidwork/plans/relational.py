"""Queries of filters, projections, joins, row selection and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import relations as R
from .book import Book, Tables

BOOK = Book()


@BOOK.query("""SELECT n_name, c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS line_count
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE l_returnflag <> 'R' GROUP BY n_name, c_mktsegment""")
def revenue_by_nation_segment(t: Tables) -> DataFrame:
    sold = R.where(t.lineitem, F.col("l_returnflag") != "R").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    joined = J.inner_join(sold, t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    joined = J.inner_join(joined, t.customer, F.col("o_custkey") == F.col("c_custkey"))
    grouped = A.group_by(joined, "c_nationkey", "c_mktsegment", metrics={"revenue": F.round(A.sum("net"), 2), "line_count": A.count()})
    named = J.inner_join(grouped, t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("n_name", "c_mktsegment", "revenue", "line_count")


@BOOK.query("""SELECT o_orderkey, o_orderstatus IS NULL AS no_status, o_orderpriority IS NOT DISTINCT FROM '5-LOW' AS low,
      o_orderpriority LIKE '%URGENT' AS urgent, o_orderpriority ILIKE '1-u%' AS urgent_too, contains(o_orderpriority, 'HIGH') AS high,
      starts_with(o_orderpriority, '3') AS third, regexp_matches(o_orderpriority, '^[45]-') AS last_two,
      CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size
    FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 50000 AND 400000 AND NOT (o_orderpriority = '2-HIGH' AND o_orderstatus = 'P')
      AND (o_totalprice >= 60000 OR o_totalprice < 55000) AND o_orderpriority <> '4-NOT SPECIFIED'""")
def filters_and_predicates(t: Tables) -> DataFrame:
    c = F.col
    kept = R.where(
        t.orders, c("o_orderstatus").isin("F", "P"), c("o_totalprice").between(50000, 400000), ~((c("o_orderpriority") == "2-HIGH") & (c("o_orderstatus") == "P")),
        (c("o_totalprice") >= 60000) | (c("o_totalprice") < 55000), c("o_orderpriority") != "4-NOT SPECIFIED",
    )
    p = c("o_orderpriority")
    size = F.when(c("o_totalprice") > 300000, "big").when(c("o_totalprice") > 100000, "middle").otherwise("small")
    return R.project(kept, ["o_orderkey"], no_status=c("o_orderstatus").isNull(), low=p.eqNullSafe("5-LOW"), urgent=p.like("%URGENT"), urgent_too=p.ilike("1-u%"), high=p.contains("HIGH"), third=p.startswith("3"), last_two=p.rlike("^[45]-"), size=size)


@BOOK.query("""SELECT s_suppkey, struct_pack(name := s_name, place := struct_pack(nation := s_nationkey)).name AS name,
      s_nationkey AS nation, (s_acctbal > 0) AS solvent, s_nationkey + 1 AS next FROM supplier""")
def nested_fields(t: Tables) -> DataFrame:
    nested = t.supplier.select("s_suppkey", "s_acctbal", F.struct(F.col("s_name").alias("name"), F.struct(F.col("s_nationkey").alias("nation")).alias("place"), F.lit(1).alias("spare")).alias("who"))
    changed = nested.withColumn("who", F.col("who").dropFields("spare").withField("next", F.col("who.place.nation") + 1))
    return changed.select("s_suppkey", "who.name", "who.place.nation", (F.col("s_acctbal") > 0).alias("solvent"), "who.next")


@BOOK.query("SELECT c_custkey, c_name, n_name, n_regionkey FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c_nationkey = n_nationkey")
def left_join(t: Tables) -> DataFrame:
    return J.left_join(t.customer, t.nation.where("n_regionkey < 3"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "n_regionkey")


@BOOK.query("SELECT s_suppkey, n_nationkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) RIGHT JOIN nation ON s_nationkey = n_nationkey")
def right_join(t: Tables) -> DataFrame:
    return J.right_join(t.supplier.where("s_acctbal > 5000"), t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_nationkey")


@BOOK.query("""SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal > 8000) FULL JOIN
    (SELECT * FROM supplier WHERE s_acctbal > 8000) ON c_nationkey = s_nationkey""")
def full_join(t: Tables) -> DataFrame:
    return J.full_join(t.customer.where("c_acctbal > 8000"), t.supplier.where("s_acctbal > 8000"), F.col("c_nationkey") == F.col("s_nationkey"), strategy="sort_merge").select("c_custkey", "s_suppkey")


@BOOK.query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_join(t: Tables) -> DataFrame:
    return J.cross_join(t.region, t.nation, allow_cartesian=True).select("r_name", "n_name")


@BOOK.query("SELECT p_partkey, p_retailprice / mean AS relative FROM part CROSS JOIN (SELECT max(p_retailprice) AS mean FROM part)")
def param_join(t: Tables) -> DataFrame:
    mean = t.part.agg(F.max("p_retailprice").alias("mean"))
    return J.param_join(t.part, mean).select("p_partkey", (F.col("p_retailprice") / F.col("mean")).alias("relative"))


@BOOK.query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def exists(t: Tables) -> DataFrame:
    return J.exists(t.customer, t.orders.where("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


@BOOK.query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def not_exists(t: Tables) -> DataFrame:
    return J.not_exists(t.customer, t.orders.where("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name")


@BOOK.query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) ON o_custkey = c_custkey""")
def lookup_latest(t: Tables) -> DataFrame:
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return J.lookup_join(t.customer, orders, ["c_custkey"], latest_by="o_orderkey").select("c_custkey", "o_orderkey", "o_totalprice")


@BOOK.query("""SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def self_join(t: Tables) -> DataFrame:
    a, b = J.relation_alias(t.nation, "a"), J.relation_alias(t.nation, "b")
    return J.inner_join(a, b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("one"), F.col("b.n_name").alias("other"))


@BOOK.query("""SELECT p.p_partkey, s.s_suppkey FROM part p JOIN supplier s ON p.p_size * 100 < s.s_acctbal AND s.s_acctbal < p.p_size * 100 + 50""")
def theta_join(t: Tables) -> DataFrame:
    low = F.col("p_size") * 100
    return J.band_join(t.part.select("p_partkey", "p_size"), t.supplier.select("s_suppkey", "s_acctbal"), low, low + 50, F.col("s_acctbal"), width=50).select("p_partkey", "s_suppkey")


_VERSIONS = """(SELECT user_id, value AS price, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS valid_to FROM events WHERE event_type = 'signup')"""


@BOOK.query(f"""SELECT e.event_id, v.price FROM (SELECT * FROM events WHERE event_type = 'purchase') e LEFT JOIN {_VERSIONS} v
    ON e.user_id = v.user_id AND v.valid_from <= e.ts AND (e.ts < v.valid_to OR v.valid_to IS NULL)""")
def temporal_one(t: Tables) -> DataFrame:
    ev = t.events
    after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts"))
    versions = ev.where("event_type = 'signup'").select("user_id", F.col("value").alias("price"), F.col("ts").alias("valid_from"), after.alias("valid_to"))
    return J.temporal_one(ev.where("event_type = 'purchase'"), versions, ["user_id"], "ts", "valid_from", "valid_to").select("event_id", "price")


def _as_of(t: Tables, direction: str, tolerance: str | None = None) -> DataFrame:
    left = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = t.events.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view_id"))
    return J.as_of_one(left, right, ["user_id"], "ts", "seen", direction=direction, tolerance=tolerance).select("event_id", "view_id", "seen")


@BOOK.query("""SELECT e.event_id, v.event_id AS view_id, v.ts AS seen FROM (SELECT * FROM events WHERE event_type = 'purchase') e
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def as_of_backward(t: Tables) -> DataFrame:
    return _as_of(t, "backward")


@BOOK.query("""SELECT e.event_id, v.event_id AS view_id, v.ts AS seen FROM (SELECT * FROM events WHERE event_type = 'purchase') e
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts <= v.ts""")
def as_of_forward(t: Tables) -> DataFrame:
    return _as_of(t, "forward")


@BOOK.query("""SELECT e.event_id, v.event_id AS view_id, v.ts AS seen FROM (SELECT * FROM events WHERE event_type = 'purchase') e LEFT JOIN LATERAL (
      SELECT * FROM events v WHERE v.event_type = 'view' AND v.user_id = e.user_id AND abs(epoch_us(v.ts) - epoch_us(e.ts)) <= 6 * 3600000000
      ORDER BY abs(epoch_us(v.ts) - epoch_us(e.ts)) LIMIT 1) v ON true""")
def as_of_nearest(t: Tables) -> DataFrame:
    return _as_of(t, "nearest", "6 hours")


@BOOK.query("""SELECT v.event_id AS view_id, c.event_id AS click_id FROM events v JOIN events c ON v.user_id = c.user_id AND v.event_type = 'view'
    AND c.event_type = 'click' AND c.ts >= v.ts AND c.ts <= v.ts + INTERVAL 2 HOUR""")
def interval_join(t: Tables) -> DataFrame:
    v = t.events.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", "ts")
    c = t.events.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("who"), F.col("ts").alias("at"))
    return J.inner_join(v, c, (F.col("user_id") == F.col("who")) & J.event_time_between(F.col("ts"), F.col("at"), upper="2 hours")).select("view_id", "click_id")


@BOOK.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def order_and_limit(t: Tables) -> DataFrame:
    return R.limit(t.orders.select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), F.asc("o_orderkey"))


@BOOK.query("SELECT s_suppkey FROM supplier ORDER BY s_suppkey OFFSET 5")
def order_and_offset(t: Tables) -> DataFrame:
    return R.offset(t.supplier.select("s_suppkey"), 5, "s_suppkey")


@BOOK.query("""SELECT c_custkey, row_number() OVER (ORDER BY least_ NULLS LAST, c_custkey) AS place FROM (
    SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS least_ FROM customer) ORDER BY least_ NULLS LAST, c_custkey LIMIT 30""")
def null_ordering(t: Tables) -> DataFrame:
    valued = t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("least_"))
    first = R.limit(valued, 30, F.asc_nulls_last("least_"), "c_custkey")
    return first.select("c_custkey", F.row_number().over(Window.orderBy(F.asc_nulls_last("least_"), "c_custkey")).alias("place"))


@BOOK.query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1")
def latest_by(t: Tables) -> DataFrame:
    return R.latest_by(t.events, "ts", partition_by=["user_id"]).select("user_id", "event_id", "value")


@BOOK.query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts) = 1")
def earliest_by(t: Tables) -> DataFrame:
    return R.earliest_by(t.events, "ts", partition_by=["event_type"]).select("event_type", "event_id")


@BOOK.query("SELECT user_id, event_id FROM events WHERE event_type = 'purchase' AND value > 20 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts) = 1")
def select_first_qualified(t: Tables) -> DataFrame:
    return R.select_first_qualified(t.events, ["user_id"], where=(F.col("event_type") == "purchase") & (F.col("value") > 20), order_by="ts").select("user_id", "event_id")


@BOOK.query("SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 3")
def top_k_per_group(t: Tables) -> DataFrame:
    return R.top_k(t.customer, 3, partition_by=["c_mktsegment"], order_by=[F.desc("c_acctbal"), F.asc("c_custkey")]).select("c_mktsegment", "c_custkey", "rank")


@BOOK.query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct(t: Tables) -> DataFrame:
    return R.distinct(t.customer.select("c_mktsegment", "c_nationkey"))


@BOOK.query("SELECT DISTINCT p_brand, p_type FROM part")
def drop_duplicates(t: Tables) -> DataFrame:
    return R.drop_duplicates(t.part, "p_brand", "p_type").select("p_brand", "p_type")


@BOOK.query()
def sample(t: Tables) -> DataFrame:
    return R.sample(t.orders.select("o_orderkey"), 0.2, seed=7)


_A, _B = "SELECT o_custkey % 50 AS k FROM orders WHERE o_orderstatus = 'F'", "SELECT o_custkey % 70 AS k FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 20000"


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    a = t.orders.where("o_orderstatus = 'F'").select((F.col("o_custkey") % 50).alias("k"))
    return a, t.orders.where("o_orderstatus = 'P' AND o_totalprice > 20000").select((F.col("o_custkey") % 70).alias("k"))


@BOOK.query(f"{_A} UNION ALL {_B}")
def union_all(t: Tables) -> DataFrame:
    return R.union_all(*_sides(t))


@BOOK.query(f"SELECT k, 'a' AS origin FROM ({_A}) UNION ALL SELECT k, 'none' AS origin FROM ({_B})")
def union_by_name_defaults(t: Tables) -> DataFrame:
    a, b = _sides(t)
    return R.union_by_name(a.withColumn("origin", F.lit("a")), b, allow_missing_columns=True, defaults={"origin": "none"})


@BOOK.query(f"{_A} INTERSECT {_B}")
def intersect(t: Tables) -> DataFrame:
    return R.intersect(*_sides(t))


@BOOK.query(f"{_A} INTERSECT ALL {_B}")
def intersect_all(t: Tables) -> DataFrame:
    return R.intersect_all(*_sides(t))


@BOOK.query(f"{_B} EXCEPT {_A}")
def subtract(t: Tables) -> DataFrame:
    a, b = _sides(t)
    return R.subtract(b, a)


@BOOK.query(f"{_A} EXCEPT ALL {_B}")
def except_all(t: Tables) -> DataFrame:
    return R.except_all(*_sides(t))
