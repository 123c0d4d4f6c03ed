"""Queries of scalar, array, map, JSON, CSV and Variant functions, and of generators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import collections as C
from ..functions import documents as D
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import generators as G
from .book import Book, Tables

BOOK = Book()


@BOOK.query("""SELECT p_partkey, lower(p_brand) AS lo, upper(p_name) AS up, trim('  ' || p_name || ' ') AS tr, ltrim('  ' || p_name) AS lt, rtrim(p_name || '  ') AS rt, substring(p_name, 2, 4) AS sub,
      regexp_replace(p_name, '[aeiou]', '*', 'g') AS masked, regexp_extract(p_brand, '#([0-9]+)', 1) AS number, length(p_name)::INT AS len, reverse(p_name) AS rev, translate(p_name, 'abc', 'xyz') AS tl,
      instr(p_name, 'i')::INT AS at_i, levenshtein(p_name, p_type)::INT AS lev, concat_ws('-', p_brand, p_type, NULL) AS joined, string_split(p_name, ' ') AS parts FROM part""")
def string_functions(t: Tables) -> DataFrame:
    n = F.col("p_name")
    return t.part.select(
        "p_partkey", S.lower("p_brand").alias("lo"), S.upper(n).alias("up"), S.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("tr"), S.ltrim(F.concat(F.lit("  "), n)).alias("lt"), S.rtrim(F.concat(n, F.lit("  "))).alias("rt"),
        S.substring(n, start=2, length=4).alias("sub"), S.regexp_replace(n, pattern="[aeiou]", replacement="*").alias("masked"), S.regexp_extract("p_brand", pattern="#([0-9]+)").alias("number"), S.length(n).alias("len"), S.reverse(n).alias("rev"),
        S.translate(n, matching="abc", replacement="xyz").alias("tl"), S.instr(n, substring="i").alias("at_i"), S.levenshtein(n, "p_type").alias("lev"), S.concat_ws("-", "p_brand", "p_type", F.lit(None).cast("string")).alias("joined"), S.split(n, pattern=" ").alias("parts"),
    )


@BOOK.query("""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS cap, md5(p_name) AS m, sha1(p_name) AS s1, sha256(p_name) AS s2,
      base64(encode(p_name)) AS b64, decode(from_base64(base64(encode(p_name)))) AS back FROM part""")
def hashes_and_codes(t: Tables) -> DataFrame:
    n = F.col("p_name")
    return t.part.select("p_partkey", S.initcap(n).alias("cap"), S.md5(n).alias("m"), S.sha1(n).alias("s1"), S.sha2(n, 256).alias("s2"), S.base64(S.encode(n)).alias("b64"), S.decode(S.unbase64(S.base64(S.encode(n)))).alias("back"))


@BOOK.query()
def engine_hashes(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.hash("p_name", "p_size").alias("h"), S.xxhash64("p_name").alias("x"))


@BOOK.query("""SELECT o_orderkey, (o_orderdate::DATE + 30) AS plus, (o_orderdate::DATE - 7) AS minus, date_diff('day', o_orderdate::DATE, DATE '2000-01-01')::INT AS days, date_trunc('month', o_orderdate)::DATE AS mon,
      date_trunc('year', o_orderdate)::DATE AS yr, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, strptime('2024-03-0' || (1 + o_orderkey % 9), '%Y-%m-%d')::DATE AS parsed FROM orders""")
def date_functions(t: Tables) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return t.orders.select(
        "o_orderkey", S.date_add(d, 30).alias("plus"), S.date_sub(d, 7).alias("minus"), S.datediff(F.lit("2000-01-01").cast("date"), d).alias("days"), S.trunc(d, unit="month").alias("mon"), S.trunc(d, unit="year").alias("yr"), S.year(d).alias("y"),
        S.month(d).alias("m"), S.dayofmonth(d).alias("d"), S.to_date(F.concat(F.lit("2024-03-0"), (1 + F.col("o_orderkey") % 9).cast("string")), "yyyy-MM-dd").alias("parsed"),
    )


@BOOK.query("""SELECT event_id, hour(ts)::INT AS h, minute(ts)::INT AS mi, second(ts)::INT AS s, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour_start,
      epoch(strptime(strftime(ts, '%Y/%m/%d %H:%M'), '%Y/%m/%d %H:%M'))::BIGINT - epoch(TIMESTAMP '2024-01-01')::BIGINT AS since FROM events""")
def time_functions(t: Tables) -> DataFrame:
    ts = F.col("ts")
    parse = lambda c: F.unix_seconds(S.to_timestamp(c, "yyyy/MM/dd HH:mm"))
    return t.events.select("event_id", S.hour(ts).alias("h"), S.minute(ts).alias("mi"), S.second(ts).alias("s"), F.date_format(S.date_trunc(ts, unit="hour"), "yyyy-MM-dd HH:mm:ss").alias("hour_start"), (parse(F.date_format(ts, "yyyy/MM/dd HH:mm")) - parse(F.lit("2024/01/01 00:00"))).alias("since"))


@BOOK.query("""SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 0) AS r, ceil(c_acctbal)::BIGINT AS c, floor(c_acctbal)::BIGINT AS f, round(sqrt(abs(c_acctbal)), 9) AS sq, round(exp(c_acctbal / 10000), 9) AS e, sign(c_acctbal)::DOUBLE AS sg,
      round(pow(c_nationkey, 2), 6) AS p, round(ln(c_custkey + 1), 9) AS l, round(log2(c_custkey + 1), 9) AS l2, c_custkey + c_nationkey AS s, c_custkey - 1 AS d, c_custkey * 3 AS m, c_custkey / 4 AS q, c_custkey % 7 AS mo, -c_custkey AS n,
      c_custkey & 6 AS b1, c_custkey | 6 AS b2, xor(c_custkey, 6) AS b3, ~c_custkey AS b4, round_even(c_acctbal, 1) AS br FROM customer""")
def math_functions(t: Tables) -> DataFrame:
    k, b, n = F.col("c_custkey"), F.col("c_acctbal"), F.col("c_nationkey")
    r = lambda c: F.round(c, 9)
    return t.customer.select(
        "c_custkey", S.abs(b).alias("a"), S.round(b, 0).alias("r"), S.ceil(b).alias("c"), S.floor(b).alias("f"), r(S.sqrt(S.abs(b))).alias("sq"), r(S.exp(b / 10000)).alias("e"), S.signum(b).alias("sg"), F.round(S.pow(n, F.lit(2)), 6).alias("p"), r(S.log(k + 1)).alias("l"),
        r(S.log(k + 1, base=2)).alias("l2"), (k + n).alias("s"), (k - 1).alias("d"), (k * 3).alias("m"), (k / 4).alias("q"), (k % 7).alias("mo"), (-k).alias("n"), S.bitwise_and(k, 6).alias("b1"), S.bitwise_or(k, 6).alias("b2"), S.bitwise_xor(k, 6).alias("b3"), S.bitwise_not(k).alias("b4"), S.bround(b, 1).alias("br"),
    )


_P = "CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END"


@BOOK.query(f"""SELECT p_partkey, {_P} IS NULL AS n1, {_P} IS NOT NULL AS n2, coalesce({_P}, 0) AS co, coalesce({_P}, -1) AS nv, CASE WHEN {_P} IS NOT NULL THEN 'y' ELSE 'n' END AS n3, coalesce({_P}, 0) AS z, nullif(p_size, 10) AS nu,
      isnan(CASE WHEN p_size = 1 THEN 'nan'::DOUBLE ELSE 1.5 END) AS nan_, CASE WHEN p_size = 1 THEN 0.0 ELSE 1.5 END::DOUBLE AS nn, p_retailprice::DECIMAL(12, 2) AS dec, try_cast(p_brand AS INT) AS tc, p_size::VARCHAR AS st, p_size::DOUBLE AS db FROM part""")
def null_control_and_casts(t: Tables) -> DataFrame:
    p = F.when(F.col("p_size") % 3 != 0, F.col("p_size"))
    maybe = F.when(F.col("p_size") == 1, F.lit(float("nan"))).otherwise(1.5)
    return t.part.select(
        "p_partkey", S.isnull(p).alias("n1"), S.isnotnull(p).alias("n2"), S.coalesce(p, F.lit(0)).alias("co"), S.nvl(p, F.lit(-1)).alias("nv"), S.nvl2(p, F.lit("y"), F.lit("n")).alias("n3"), S.zeroifnull(p).alias("z"), S.nullif("p_size", F.lit(10)).alias("nu"),
        S.isnan(maybe).alias("nan_"), S.nanvl(maybe, F.lit(0.0)).alias("nn"), S.to_decimal("p_retailprice", precision=12, scale=2).alias("dec"), S.try_cast("p_brand", "int").alias("tc"), F.col("p_size").cast("string").alias("st"), F.col("p_size").astype("double").alias("db"),
    )


_E = "(SELECT vec_id, list_transform(embedding, lambda x: (x * 100)::INT) AS a, list_transform(list_reverse(embedding), lambda x: (x * 50)::INT) AS b FROM embeddings)"


def _arrays(t: Tables) -> DataFrame:
    whole = lambda items, by: F.transform(items, lambda x: F.rint(x * F.lit(by).cast("float")).cast("int"))  # noqa: E731  # as float: a double product rounds otherwise near halves
    return t.embeddings.select("vec_id", whole("embedding", 100).alias("a"), whole(F.reverse("embedding"), 50).alias("b"))


@BOOK.query(f"""SELECT vec_id, len(a)::INT AS n, list_contains(a, 3) AS c, coalesce(list_position(a, 3), 0)::BIGINT AS p, a[2] AS e, a[100] AS te, a[2:4] AS sl, list_append(a, 9) AS ap, list_prepend(9, a) AS pr, list_concat(a[1:1], [7], a[2:]) AS ins,
      list_filter(a, lambda x: x <> 3) AS rm, list_sort(list_distinct(list_concat(a, b))) AS un, list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))) AS ex, list_sort(list_intersect(a, b)) AS it, list_sort(list_distinct(a)) AS di,
      flatten([a, b]) AS fl, list_reverse(a) AS rv, list_sort(a) AS so, list_filter([a[1], NULL, a[2]], lambda x: x IS NOT NULL) AS co, [vec_id, vec_id] AS re, range(1, 6, 2) AS sq FROM {_E}""")
def array_functions(t: Tables) -> DataFrame:
    a, b, v = F.col("a"), F.col("b"), F.col("vec_id")
    return _arrays(t).select(
        "vec_id", C.size(a).alias("n"), C.array_contains(a, 3).alias("c"), C.arr_position(a, 3).alias("p"), C.element_at(a, 2).alias("e"), C.try_element_at(a, F.lit(100)).alias("te"), C.slice(a, 2, 3).alias("sl"), C.arr_append(a, 9).alias("ap"), C.arr_prepend(a, 9).alias("pr"),
        C.arr_insert(a, 2, 7).alias("ins"), C.arr_remove(a, 3).alias("rm"), C.arr_sort(C.array_union(a, b)).alias("un"), C.arr_sort(C.array_except(a, b)).alias("ex"), C.arr_sort(C.array_intersect(a, b)).alias("it"), C.arr_sort(C.arr_distinct(a)).alias("di"),
        C.arr_flatten(C.array(a, b)).alias("fl"), C.arr_reverse(a).alias("rv"), C.arr_sort(a).alias("so"), C.arr_compact(C.array(a[0], F.lit(None).cast("int"), a[1])).alias("co"), C.array_repeat(v, 2).alias("re"), C.sequence(F.lit(1), F.lit(5), F.lit(2)).cast("array<bigint>").alias("sq"),
    )


@BOOK.query(f"""SELECT vec_id, list_transform(a, lambda x: x * 2) AS tr, list_transform(a, lambda x, i: x + i - 1) AS tri, list_filter(a, lambda x: x > 0) AS fi, len(list_filter(a, lambda x: x > 15)) > 0 AS ex, len(list_filter(a, lambda x: x > -40)) = len(a) AS fa,
      list_transform(list_zip(a, b), lambda p: p[1] * p[2]) AS zw, list_sum(a)::INT + 10 AS ag, list_reverse_sort(list_transform(a, lambda x: abs(x))) AS sb FROM {_E}""")
def higher_order_functions(t: Tables) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    total = C.arr_aggregate(a, F.lit(None).cast("bigint"), lambda s, x: F.coalesce(s + x, s, x), lambda s: s.cast("int") + 10)  # as in SQL: without nulls, null of no items
    zipped = F.coalesce(C.arr_zip_with(a, b, lambda x, y: x * y), F.array().cast("array<int>"))  # as in SQL: empty for no arrays
    return _arrays(t).select(
        "vec_id", C.arr_transform(a, lambda x: x * 2).alias("tr"), C.arr_transform(a, lambda x, i: x + i.cast("bigint")).alias("tri"), C.arr_filter(a, lambda x: x > 0).alias("fi"), C.arr_exists(a, lambda x: x.isNotNull() & (x > 15)).alias("ex"),
        C.arr_forall(a, lambda x: x.isNotNull() & (x > -40)).alias("fa"), zipped.alias("zw"), total.alias("ag"), C.arr_transform(C.arr_sort_by(a, lambda x: F.abs(x), descending=True), lambda x: F.abs(x)).alias("sb"),
    )


@BOOK.query("""SELECT n_nationkey, ['key', 'name'] AS ks, [n_nationkey::VARCHAR, n_name] AS vs, true AS has, n_name AS got, ['KEY', 'NAME'] AS tk, ['v' || n_nationkey, 'v' || n_name] AS tv, ['name'] AS fk, ['key', 'name', 'region'] AS ck,
      [n_nationkey || '/' || n_nationkey, n_name || '/' || n_name] AS zv, 2 AS entries FROM nation""")
def map_functions(t: Tables) -> DataFrame:
    m = F.col("m")
    made = t.nation.withColumn("m", C.map_from_entries(C.array(F.struct(F.lit("key").alias("k"), F.col("n_nationkey").cast("string").alias("v")), F.struct(F.lit("name").alias("k"), F.col("n_name").alias("v")))))
    more = F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"))
    return made.select(
        "n_nationkey", C.map_keys(m).alias("ks"), C.map_values(m).alias("vs"), C.map_contains_key(m, "name").alias("has"), C.element_at(m, "name").alias("got"), C.map_keys(C.map_transform_keys(m, lambda k, v: F.upper(k))).alias("tk"), C.map_values(C.map_transform_values(m, lambda k, v: F.concat(F.lit("v"), v))).alias("tv"),
        C.map_keys(C.map_filter(m, lambda k, v: k == "name")).alias("fk"), C.map_keys(C.map_concat(m, more)).alias("ck"), C.map_values(C.map_zip_with(m, m, lambda k, x, y: F.concat(x, F.lit("/"), y))).alias("zv"), C.size(C.map_entries(m)).alias("entries"),
    )


@BOOK.query("""SELECT event_id, (props::JSON->>'$.k')::INT AS k, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS packed, event_type || ',' || user_id AS line, event_type AS kind, user_id AS who FROM events""")
def json_and_csv(t: Tables) -> DataFrame:
    pair = F.struct("event_type", "user_id")
    line = D.to_csv(pair)
    parsed = D.from_csv(line, schema="kind string, who bigint")
    return t.events.select("event_id", D.from_json("props", schema="k int")["k"].alias("k"), D.to_json(pair).alias("packed"), line.alias("line"), parsed["kind"].alias("kind"), parsed["who"].alias("who"))


@BOOK.query("""SELECT event_id, (props::JSON->>'$.k')::INT AS k, NULL::INT AS missing, false AS is_null, true AS broken, 'OBJECT<k: BIGINT>' AS shape, 5 AS five, event_type AS kind FROM events""")
def variants(t: Tables) -> DataFrame:
    v = D.parse_json(F.col("props"))
    return t.events.select(
        "event_id", D.variant_get(v, "$.k", as_type="int").alias("k"), D.try_variant_get(v, "$.none", as_type="int").alias("missing"), D.is_variant_null(v).alias("is_null"), D.try_parse_json(F.concat(F.lit("{"), "props")).isNull().alias("broken"),
        D.schema_of_variant(v).alias("shape"), D.variant_get(D.variant_literal('{"x": 5}'), "$.x", as_type="int").alias("five"), D.variant_get(D.to_variant_object(F.struct("event_type")), "$.event_type", as_type="string").alias("kind"),
    )


@BOOK.query("SELECT 'OBJECT<k: BIGINT>' AS merged")
def variant_schema_of_all(t: Tables) -> DataFrame:
    return t.events.select(D.parse_json(F.col("props")).alias("v")).agg(A.schema_of_variant_agg("v").alias("merged"))


@BOOK.query("SELECT event_id, key, value FROM (SELECT event_id, 'k' AS key, (props::JSON->>'$.k')::INT AS value FROM events)")
def variant_explode(t: Tables) -> DataFrame:
    out = G.variant_explode(t.events.select("event_id", D.parse_json(F.col("props")).alias("v")), "v")
    return out.select("event_id", "key", D.variant_get(F.col("value"), "$", as_type="int").alias("value"))


@BOOK.query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def explode_array(t: Tables) -> DataFrame:
    return G.explode_array(t.part.select("p_partkey", F.split("p_name", " ").alias("w")), "w", "word").select("p_partkey", "word")


@BOOK.query("""SELECT p_partkey, i - 1 AS place, w[i] AS word FROM (SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda x: length(x) > 4) AS w FROM part) CROSS JOIN LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)
    UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: length(x) > 4)) = 0""")
def posexplode_outer_array(t: Tables) -> DataFrame:
    words = t.part.select("p_partkey", F.filter(F.split("p_name", " "), lambda x: F.length(x) > 4).alias("w"))
    return G.explode_array(words, "w", "word", outer=True, ordinal="place").select("p_partkey", "place", "word")


@BOOK.query("SELECT n_nationkey, unnest(['key', 'region']) AS k, unnest([n_nationkey, n_regionkey]) AS v, unnest([0, 1])::BIGINT AS place FROM nation")
def posexplode_map(t: Tables) -> DataFrame:
    m = F.create_map(F.lit("key"), F.col("n_nationkey"), F.lit("region"), F.col("n_regionkey"))
    return G.explode_map(t.nation.select("n_nationkey", m.alias("m")), "m", "k", "v", ordinal="place").select("n_nationkey", "k", "v", "place")


@BOOK.query("SELECT c_nationkey, c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_acctbal > 5000")
def inline_structs(t: Tables) -> DataFrame:
    rows = F.filter(F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))), lambda s: s["balance"] > 5000)
    return G.inline_struct(t.customer.groupBy("c_nationkey").agg(rows.alias("r")), "r").select("c_nationkey", "id", "balance")


@BOOK.query("SELECT c_nationkey, c_custkey AS id FROM customer WHERE c_acctbal > 5000")
def explode_structs(t: Tables) -> DataFrame:
    rows = F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")))
    out = G.explode_struct(t.customer.groupBy("c_nationkey").agg(rows.alias("r")), "r", "s")
    return out.where("s.balance > 5000").select("c_nationkey", "s.id")


@BOOK.query("""SELECT n_nationkey, 'key' AS k, n_nationkey AS v FROM nation WHERE n_regionkey > 1 UNION ALL SELECT n_nationkey, NULL, NULL FROM nation WHERE n_regionkey <= 1""")
def explode_outer_map(t: Tables) -> DataFrame:
    m = F.when(F.col("n_regionkey") > 1, F.create_map(F.lit("key"), F.col("n_nationkey")))
    return G.explode_map(t.nation.select("n_nationkey", m.alias("m")), "m", "k", "v", outer=True).select("n_nationkey", "k", "v")


@BOOK.query("""SELECT c_nationkey, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place FROM customer""")
def posexplode_structs(t: Tables) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))))
    return G.explode_struct(t.customer.groupBy("c_nationkey").agg(rows.alias("r")), "r", "s", ordinal="place").select("c_nationkey", "s.id", "place")


@BOOK.query("""SELECT n_nationkey, c_custkey AS id FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) ON c_nationkey = n_nationkey""")
def inline_outer_structs(t: Tables) -> DataFrame:
    rows = t.customer.where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.collect_list(F.struct(F.col("c_custkey").alias("id"))).alias("r"))
    joined = t.nation.join(rows, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return G.inline_struct(joined, "r", outer=True).select("n_nationkey", "id")


@BOOK.query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'k' END AS key, CASE WHEN event_type = 'click' THEN (props::JSON->>'$.k')::INT END AS value FROM events""")
def variant_explode_outer(t: Tables) -> DataFrame:
    v = F.when(F.col("event_type") == "click", D.parse_json(F.col("props")))
    out = G.variant_explode(t.events.select("event_id", v.alias("v")), "v", outer=True)
    return out.select("event_id", "key", D.try_variant_get(F.col("value"), "$", as_type="int").alias("value"))
