"""Queries of the outer, ordinal and hinted forms of operators, and of the rarer window and ordering functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import collections as C
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import generators as G
from ..operators import joins as J
from ..operators import relations as R
from ..operators import windows as W
from .book import Book, Tables

BOOK = Book()

_WORDS = "(SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN list_filter(string_split(p_name, ' '), lambda w: w <> '') END AS words FROM part)"


def _words(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.filter(F.split("p_name", " "), lambda w: w != "")).alias("words"))


@BOOK.query(f"SELECT p_partkey, unnest(CASE WHEN len(words) > 0 THEN words ELSE [NULL] END) AS word FROM {_WORDS}")
def explode_outer_array(t: Tables) -> DataFrame:
    return G.explode_array(_words(t), "words", "word", outer=True).select("p_partkey", "word")


@BOOK.query(f"SELECT p_partkey, unnest(words) AS word, unnest(range(len(words))) AS i FROM {_WORDS} WHERE len(words) > 0")
def posexplode_array(t: Tables) -> DataFrame:
    return G.explode_array(_words(t), "words", "word", ordinal="i").select("p_partkey", "word", "i")


_PAIRS = "(SELECT n_nationkey, unnest(['key', 'name']) AS k, unnest([n_nationkey::VARCHAR, n_name]) AS v, unnest([0, 1]) AS i FROM nation WHERE n_nationkey % 4 <> 0)"


def _maps(t: Tables) -> DataFrame:
    made = F.create_map(F.lit("key"), F.col("n_nationkey").cast("string"), F.lit("name"), F.col("n_name"))
    return t.nation.select("n_nationkey", F.when(F.col("n_nationkey") % 4 != 0, made).alias("m"))


@BOOK.query(f"SELECT n_nationkey, k, v FROM {_PAIRS}")
def explode_map(t: Tables) -> DataFrame:
    return G.explode_map(_maps(t), "m", "k", "v").select("n_nationkey", "k", "v")


@BOOK.query(f"SELECT n_nationkey, k, v, i::BIGINT AS i FROM {_PAIRS} UNION ALL SELECT n_nationkey, NULL, NULL, NULL FROM nation WHERE n_nationkey % 4 = 0")
def posexplode_outer_map(t: Tables) -> DataFrame:
    return G.explode_map(_maps(t), "m", "k", "v", outer=True, ordinal="i").select("n_nationkey", "k", "v", "i")


_LINES = "(SELECT s_suppkey, s_name, n_name, unnest([0, 1]) AS i FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 0)"
_NO_LINES = "SELECT s_suppkey, NULL, NULL{} FROM supplier WHERE s_suppkey % 3 = 0"


def _structs(t: Tables) -> DataFrame:
    joined = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    two = F.array(F.struct(F.lit("name").alias("what"), F.col("s_name").alias("is")), F.struct(F.lit("nation").alias("what"), F.col("n_name").alias("is")))
    return joined.select("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, two).alias("facts"))


@BOOK.query(f"SELECT s_suppkey, CASE i WHEN 0 THEN 'name' ELSE 'nation' END AS what, CASE i WHEN 0 THEN s_name ELSE n_name END AS is_ FROM {_LINES} UNION ALL {_NO_LINES.format('')}")
def explode_outer_struct(t: Tables) -> DataFrame:
    return G.explode_struct(_structs(t), "facts", "f", outer=True).select("s_suppkey", "f.what", F.col("f.is").alias("is_"))


@BOOK.query(f"SELECT s_suppkey, CASE i WHEN 0 THEN 'name' ELSE 'nation' END AS what, CASE i WHEN 0 THEN s_name ELSE n_name END AS is_, i::BIGINT AS i FROM {_LINES} UNION ALL {_NO_LINES.format(', NULL')}")
def posexplode_outer_struct(t: Tables) -> DataFrame:
    return G.explode_struct(_structs(t), "facts", "f", outer=True, ordinal="i").select("s_suppkey", "f.what", F.col("f.is").alias("is_"), "i")


@BOOK.query("""SELECT o_orderkey, min(o_totalprice) OVER w AS least, list_sort(list_distinct(list(o_orderstatus) OVER w)) AS seen FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def window_least_and_sets(t: Tables) -> DataFrame:
    w = W.window(partition_by="o_custkey", order_by="o_orderkey", frame=W.rows_between(W.preceding(3), W.current_row()))
    return t.orders.select("o_orderkey", W.window_min("o_totalprice", over=w).alias("least"), F.array_sort(W.window_collect_set("o_orderstatus", over=w)).alias("seen"))


@BOOK.query("SELECT c_mktsegment, c_nationkey, grouping(c_mktsegment) * 2 + grouping(c_nationkey) AS level, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def grouping_levels(t: Tables) -> DataFrame:
    return A.cube(t.customer, "c_mktsegment", "c_nationkey", metrics={"level": A.grouping_id(), "n": F.count("*")})


@BOOK.query("SELECT p_partkey, coalesce(CASE WHEN p_size % 3 <> 0 THEN p_size END, -p_size) AS size, p_name LIKE '%s' AS ends FROM part")
def ifnull_and_endswith(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.ifnull(F.when(F.col("p_size") % 3 != 0, F.col("p_size")), -F.col("p_size")).alias("size"), F.col("p_name").endswith("s").alias("ends"))


@BOOK.query("SELECT o_custkey, max(o_orderkey) AS last_, min(o_orderkey) AS first_ FROM orders GROUP BY o_custkey")
def deduped_orders(t: Tables) -> DataFrame:
    last = R.dedupe_latest_by(t.orders, "o_orderkey", partition_by=["o_custkey"]).select("o_custkey", F.col("o_orderkey").alias("last_"))
    first = R.dedupe_earliest_by(t.orders, "o_orderkey", partition_by=["o_custkey"]).select("o_custkey", F.col("o_orderkey").alias("first_"))
    return last.join(first, "o_custkey")


@BOOK.query("SELECT c_custkey, min(o_orderkey) AS first_ FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def lookup_earliest(t: Tables) -> DataFrame:
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("first_"))
    return J.lookup_join(t.customer.select("c_custkey"), orders, ["c_custkey"], earliest_by="first_")


@BOOK.query("SELECT strategy, c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES ('broadcast_hash'), ('shuffle_hash'), ('sort_merge'), ('shuffle_replicate_nl')) s(strategy)")
def hinted_joins(t: Tables) -> DataFrame:
    """The same join by each strategy; the last one is for small sides only, such as the 25 nations."""
    on = F.col("c_nationkey") == F.col("n_nationkey")
    one = lambda s: J.inner_join(t.customer, t.nation, on, strategy=s).select(F.lit(s).alias("strategy"), "c_custkey", "n_name")
    first, *others = map(one, J.STRATEGIES)
    for other in others:
        first = R.union_all(first, other)
    return first


_SIZED = "(SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_size END AS s FROM part)"


@BOOK.query(f"(SELECT 'up' AS way, p_partkey FROM {_SIZED} ORDER BY s ASC NULLS FIRST, p_partkey LIMIT 50) UNION ALL (SELECT 'down', p_partkey FROM {_SIZED} ORDER BY s DESC NULLS FIRST, p_partkey LIMIT 50)")
def nulls_first(t: Tables) -> DataFrame:
    """The first fifty in either order."""
    sized = t.part.select("p_partkey", F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("s"))
    top = lambda way, order: R.limit(sized, 50, order, F.asc("p_partkey")).select(F.lit(way).alias("way"), "p_partkey")
    return top("up", F.col("s").asc_nulls_first()).unionAll(top("down", F.col("s").desc_nulls_first()))


@BOOK.query("SELECT n_nationkey, n_name AS first_, n_name || '!' AS last_, 2 AS n FROM nation")
def maps_with_repeated_keys(t: Tables) -> DataFrame:
    a = F.create_map(F.lit("name"), F.col("n_name"))
    b = F.create_map(F.lit("name"), F.concat("n_name", F.lit("!")), F.lit("region"), F.col("n_regionkey").cast("string"))
    first, last = C.map_concat(a, b, duplicates="first"), C.map_concat(a, b, duplicates="last")
    return t.nation.select("n_nationkey", first["name"].alias("first_"), last["name"].alias("last_"), F.size(last).alias("n"))
