"""Queries of assertions, hierarchies and ordered folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import udfs
from ..operators import guards as G
from ..operators import hierarchy as H
from ..operators import scan as S
from ..sources import readers
from . import compose
from .book import Book, Tables

BOOK = Book()


@BOOK.query("SELECT o_orderkey, o_custkey FROM orders")
def guarded_orders(t: Tables) -> DataFrame:
    orders = G.require_unique(t.orders, "o_orderkey")
    orders = G.require_all(orders, F.col("o_totalprice") > 0)
    return G.require_reference(orders, "o_custkey", t.customer, "c_custkey").select("o_orderkey", "o_custkey")


@BOOK.query("SELECT max(c_custkey) AS top FROM customer")
def exactly_one(t: Tables) -> DataFrame:
    return G.exactly_one(t.customer.agg(F.max("c_custkey").alias("top")))


#: A tree of customers: each one's parent has half its key, but every 64th is a root.
_TREE = "(SELECT c_custkey AS id, CASE WHEN c_custkey % 64 = 0 THEN NULL ELSE c_custkey // 2 END AS parent FROM customer)"


def _tree(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 64 != 0, F.floor(F.col("c_custkey") / 2)).alias("parent"))


@BOOK.query(f"""WITH RECURSIVE tree AS (SELECT * FROM {_TREE}), up AS (SELECT id AS node_id, id AS ancestor_id, 0::BIGINT AS depth, parent FROM tree
    UNION ALL SELECT u.node_id, u.parent, u.depth + 1, t.parent FROM up u LEFT JOIN tree t ON u.parent = t.id WHERE u.parent IS NOT NULL AND u.depth < 4)
    SELECT node_id, ancestor_id, depth FROM up""")
def hierarchy_closure(t: Tables) -> DataFrame:
    return H.hierarchy_closure(_tree(t), "id", "parent", max_depth=4)


@BOOK.query(f"SELECT id, parent FROM {_TREE}")
def checked_hierarchy(t: Tables) -> DataFrame:
    return H.require_parent_hierarchy(_tree(t), "id", "parent", order_by="id", max_depth=20)


@BOOK.query(f"""WITH RECURSIVE tree AS (SELECT * FROM {_TREE}), f AS (SELECT id AS source, 0::INT AS ordinal, [id] AS path FROM tree
    UNION ALL SELECT f.source, f.ordinal + 1, CASE WHEN t.parent IS NULL OR list_contains(f.path[1:len(f.path) - 1], t.parent) THEN f.path[1:len(f.path) - 1] ELSE list_append(f.path[1:len(f.path) - 1], t.parent) END
      FROM f LEFT JOIN tree t ON f.path[-1] = t.id WHERE len(f.path) > 0 AND f.ordinal < 3)
    SELECT source, ordinal, path, CASE WHEN len(path) > 0 THEN sha256(array_to_string(path, '/')) END AS fallback_id FROM f""")
def hierarchy_fallbacks(t: Tables) -> DataFrame:
    sources = _tree(t).select(F.col("id").alias("source"), F.array("id").alias("path"))
    return H.hierarchy_fallbacks(sources, "source", "path", _tree(t), parent_id="id", parent="parent", max_steps=3)


@BOOK.query("""SELECT user_id, event_id, coalesce(sum(event_id) OVER w, 0)::BIGINT AS total, (row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1)::BIGINT AS seen
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def scan_running_state(t: Tables) -> DataFrame:
    initial = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("seen"))
    step = lambda s, r: F.struct((s["total"] + r["event_id"]).alias("total"), (s["seen"] + 1).alias("seen"))
    out = S.scan(t.events.select("user_id", "event_id", "ts"), initial=initial, step=step, partition_by=["user_id"], order_by=["ts"], max_rows=1_000_000)
    return out.select("user_id", "event_id", "state.total", "state.seen")


def _ticks(t: Tables, n: int) -> DataFrame:
    return t.spark.range(n).select(F.lit(0).alias("series"), F.col("id").alias("tick"))


@BOOK.query("WITH RECURSIVE f(tick, a, b) AS (SELECT 0::BIGINT, 0::BIGINT, 1::BIGINT UNION ALL SELECT tick + 1, b, a + b FROM f WHERE tick < 49) SELECT tick, a AS fibonacci FROM f")
def scan_fibonacci(t: Tables) -> DataFrame:
    initial = F.struct(F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b"))
    step = lambda s, r: F.struct(s["b"].alias("a"), (s["a"] + s["b"]).alias("b"))
    return S.scan(_ticks(t, 50), initial=initial, step=step, partition_by=["series"], order_by=["tick"], max_rows=100).select("tick", F.col("state.a").alias("fibonacci"))


@BOOK.query("""SELECT k::BIGINT AS tick, (SELECT list(p ORDER BY p) FROM range(2, k + 2) q(p) WHERE NOT EXISTS (SELECT 1 FROM range(2, q.p) r(d) WHERE q.p % r.d = 0)) AS primes FROM range(1, 40) s(k)""")
def scan_primes(t: Tables) -> DataFrame:
    initial = F.struct(F.array().cast("array<bigint>").alias("primes"), F.lit(2).cast("long").alias("next"))
    is_prime = lambda s: F.forall(s["primes"], lambda p: s["next"] % p != 0)
    step = lambda s, r: F.struct(F.when(is_prime(s), F.array_append(s["primes"], s["next"])).otherwise(s["primes"]).alias("primes"), (s["next"] + 1).alias("next"))
    return S.scan(_ticks(t, 40), initial=initial, step=step, partition_by=["series"], order_by=["tick"], max_rows=100).where("tick > 0").select("tick", "state.primes")


@BOOK.query("""SELECT tick, round(4 * coalesce(sum((CASE WHEN tick % 2 = 0 THEN 1.0 ELSE -1.0 END) / (2 * tick + 1)) OVER w, 0), 9) AS pi, round(coalesce(sum((CASE WHEN tick % 2 = 0 THEN 1.0 ELSE -1.0 END) / (tick + 1)) OVER w, 0), 9) AS ln2
    FROM range(60) s(tick) WINDOW w AS (ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def scan_series(t: Tables) -> DataFrame:
    initial = F.struct(F.lit(0.0).alias("pi"), F.lit(0.0).alias("ln2"))
    sign = lambda r: F.when(r["tick"] % 2 == 0, 1.0).otherwise(-1.0)
    step = lambda s, r: F.struct((s["pi"] + sign(r) / (2 * r["tick"] + 1)).alias("pi"), (s["ln2"] + sign(r) / (r["tick"] + 1)).alias("ln2"))
    return S.scan(_ticks(t, 60), initial=initial, step=step, partition_by=["series"], order_by=["tick"], max_rows=100).select("tick", F.round(F.col("state.pi") * 4, 9).alias("pi"), F.round("state.ln2", 9).alias("ln2"))


@BOOK.query("SELECT n_nationkey, n_name FROM nation")
def conformed(t: Tables) -> DataFrame:
    schema = readers.inspect_schema(t.spark, path=f"{t.folder}/nation.parquet")
    wanted = schema.fields[:2]
    return readers.conform(t.nation, type(schema)(wanted), mode="project")


@BOOK.query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def projected_from_sources(t: Tables) -> DataFrame:
    n, r = t.nation.alias("n"), t.region.alias("r")
    target = readers.merge_schemas(t.nation.select("n_nationkey", "n_name").schema, t.region.select("r_name").schema)
    return readers.from_sources(target, {"n": t.nation, "r": t.region}, n.join(r, F.col("n_regionkey") == F.col("r_regionkey")))


@BOOK.query("SELECT p_partkey, length(p_name) * 2 + 1 AS odd, 'P-' || upper(p_brand) AS tag FROM part")
def arrow_udfs(t: Tables) -> DataFrame:
    odd = udfs.vectorised("long")(lambda s: s.str.len() * 2 + 1)
    tag = udfs.scalar("string")(lambda b: None if b is None else "P-" + b.upper())
    return t.part.select("p_partkey", odd("p_name").alias("odd"), tag("p_brand").alias("tag"))


@BOOK.query("""WITH m AS (SELECT p_partkey, p_size + 1.0 AS a, 2.0 AS b, p_partkey % 7 AS c, p_retailprice AS d FROM part)
    SELECT p_partkey, unnest([0, 0, 1, 1])::BIGINT AS i, unnest([0, 1, 0, 1])::BIGINT AS j, unnest([round(d / (a * d - b * c), 9), round(-b / (a * d - b * c), 9), round(-c / (a * d - b * c), 9), round(a / (a * d - b * c), 9)]) AS x FROM m""")
def matrix_inversion(t: Tables) -> DataFrame:
    """Inverts each part's matrix of cells (i, j, x), many matrices a batch."""
    cells = F.array(F.array(F.col("p_size") + 1.0, F.lit(2.0)), F.array((F.col("p_partkey") % 7).cast("double"), F.col("p_retailprice")))

    def invert(batches):
        for pdf in batches:
            inverse = np.linalg.inv(np.array([[list(r) for r in m] for m in pdf["m"]], dtype=float)) if len(pdf) else np.zeros((0, 2, 2))
            n, k, _ = inverse.shape
            yield pd.DataFrame({"p_partkey": np.repeat(pdf["p_partkey"].to_numpy(), k * k), "i": np.tile(np.repeat(np.arange(k), k), n), "j": np.tile(np.arange(k), n * k), "x": inverse.ravel().round(9)})

    return t.part.select("p_partkey", cells.alias("m")).mapInPandas(invert, "p_partkey long, i long, j long, x double")


@BOOK.query("""SELECT c_mktsegment, count(*) AS big, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000 GROUP BY c_mktsegment""")
def step_graph(t: Tables) -> DataFrame:
    graph = compose.Graph(
        split=lambda orders: {"big": orders.where("o_totalprice > 200000"), "rest": orders.where("o_totalprice <= 200000")},
        report=lambda split, customer: split["big"].join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("big"), F.round(F.sum("o_totalprice"), 2).alias("total")),
    )
    return graph.run(orders=t.orders, customer=t.customer)["report"]
