"""One registered query for each operator, beside the same query as plain SQL.

The SQL text is what a second engine runs on the same tables; column names and
types of both sides agree.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsons as J
from ..functions import scalar as S
from ..functions import temporal as T
from ..functions import vectors as V
from ..functions.models import ModelRegistry
from ..operators import relational as R
from ..operators import timeseries as TS
from ..operators import vector_index as VI
from ..operators import vector_search as VS
from ..session import scratch_dir
from ..streaming import streams
from .registry import ORACLES, QUERIES, Tables, query, rounded

# ---- projection and filter ---------------------------------------------------


@query("SELECT * FROM nation")
def scan_full(t):
    return t.nation


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def scan_point_get(t):
    return t.orders.filter("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 5, 9, 77, 100000000)")
def scan_batch_get(t):
    return t.orders.filter(F.col("o_orderkey").isin(1, 5, 9, 77, 100000000)).select("o_orderkey", "o_totalprice")


@query("SELECT o.o_orderkey, o.o_custkey FROM orders o WHERE o.o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def scan_by_id_list(t):
    ids = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(ids, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey BETWEEN 100 AND 300")
def scan_index_range(t):
    return t.orders.filter(F.col("o_orderkey").between(100, 300)).select("o_orderkey", "o_orderdate")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '2023-12-31' AND l_returnflag BETWEEN 'A' AND 'N'")
def scan_filter_between(t):
    ship_ = F.col("l_shipdate").between(F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("2023-12-31").cast("timestamp_ntz"))
    return t.lineitem.filter(F.col("l_quantity").between(10, 20) & ship_ & F.col("l_returnflag").between("A", "N")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_name LIKE '%a%' AND p_type LIKE '_%' AND p_brand NOT LIKE 'Brand#1%'")
def filter_like(t):
    return t.part.filter(F.col("p_name").like("%a%") & F.col("p_type").like("_%") & ~F.col("p_brand").like("Brand#1%")).select("p_partkey", "p_name", "p_type")


@query(
    r"SELECT v, v LIKE 'test%' AS prefix, v LIKE '%test' AS suffix, v LIKE '%test%' AS inner_, v LIKE '_test' AS one, v LIKE '100\%' ESCAPE '\' AS escaped FROM (VALUES ('test'), ('testing'), ('test123'), ('123test'), ('100%')) AS x(v)"
)
def filter_like_escape(t):
    v = F.col("v")
    df = t.spark.createDataFrame([("test",), ("testing",), ("test123",), ("123test",), ("100%",)], "v string")
    return df.select("v", v.like("test%").alias("prefix"), v.like("%test").alias("suffix"), v.like("%test%").alias("inner_"), v.like("_test").alias("one"), v.like(r"100\%").alias("escaped"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 OR NOT o_orderpriority <> '1-URGENT' AND o_totalprice < 50000")
def filter_bool_precedence(t):
    price, status, urgent = F.col("o_totalprice"), F.col("o_orderstatus"), F.col("o_orderpriority")
    return t.orders.filter(((status == "F") & (price > 100000)) | (~(urgent != "1-URGENT") & (price < 50000))).select("o_orderkey")


@query("SELECT c_custkey, c_acctbal < 0 AS overdrawn FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> 'BUILDING' AND c_nationkey >= 5 AND c_nationkey <= 20 AND c_nationkey != 7")
def filter_comparisons(t):
    n = F.col("c_nationkey")
    return t.customer.withColumn("overdrawn", F.col("c_acctbal") < 0).filter(F.col("overdrawn") & (F.col("c_mktsegment") != "BUILDING") & (n >= 5) & (n <= 20) & (n != 7)).select("c_custkey", "overdrawn")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS s, (CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END) IS NULL AS missing FROM orders WHERE (CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 1 END) IS NOT NULL")
def filter_nulls(t):
    s = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))
    return t.orders.filter(F.when(F.col("o_orderkey") % 2 != 0, 1).isNotNull()).select("o_orderkey", s.alias("s"), s.isNull().alias("missing"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_extendedprice / nullif(l_discount, 0) AS ratio, -l_quantity AS neg, l_quantity > 25 AS big FROM lineitem")
def project_arith(t):
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return t.lineitem.select("l_orderkey", "l_linenumber", charge.alias("charge"), S.divide(F.col("l_extendedprice"), F.col("l_discount")).alias("ratio"), (-F.col("l_quantity")).alias("neg"), (F.col("l_quantity") > 25).alias("big"))


@query("SELECT CAST(1 + 2 * 3 AS INTEGER) AS a, CAST((1 + 2) * 3 AS INTEGER) AS b, 'x' AS c, TRUE AND NOT FALSE AS d")
def project_tableless(t):
    return t.spark.range(1).select((F.lit(1) + F.lit(2) * F.lit(3)).alias("a"), ((F.lit(1) + F.lit(2)) * 3).alias("b"), F.lit("x").alias("c"), (F.lit(True) & ~F.lit(False)).alias("d"))


@query("SELECT doubled FROM (SELECT c_nationkey * 2 AS doubled FROM customer) WHERE doubled > 20")
def filter_on_alias(t):
    return t.customer.select((F.col("c_nationkey") * 2).alias("doubled")).filter("doubled > 20")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'F'), 'done') AS st, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def project_case_in_exists(t):
    band = F.when(F.col("o_totalprice") > 200000, "high").when(F.col("o_totalprice") > 100000, "mid").otherwise("low")
    rich = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    rows = t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).join(rich, "o_custkey", "left_semi")
    return rows.select("o_orderkey", band.alias("band"), F.coalesce(F.nullif("o_orderstatus", F.lit("F")), F.lit("done")).alias("st"), F.col("o_totalprice").cast("bigint").alias("p"))


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_multi(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("SELECT DISTINCT c_mktsegment FROM customer ORDER BY 1 LIMIT 3")
def distinct_limit(t):
    return t.customer.select("c_mktsegment").distinct().orderBy("c_mktsegment").limit(3)


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority DESC, o_totalprice ASC, o_orderkey LIMIT 50")
def order_multi_limit(t):
    return R.top_k(t.orders, 50, F.desc("o_orderpriority"), F.asc("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT o_orderkey, v FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS v FROM orders) ORDER BY v ASC NULLS FIRST, o_orderkey LIMIT 20")
def order_nulls_first(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("v")).orderBy(F.asc_nulls_first("v"), "o_orderkey").limit(20)


# ---- joins -------------------------------------------------------------------


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 150000")
def join_inner(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).filter("o_totalprice > 150000").select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) o ON c_custkey = o_custkey")
def join_left(t):
    return t.customer.join(t.orders.filter("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(t):
    return t.supplier.filter("s_acctbal > 5000").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_name")


@query("SELECT n_nationkey, s_suppkey FROM (SELECT * FROM nation WHERE n_regionkey < 3) n FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON n_nationkey = s_nationkey AND s_acctbal > 2000")
def join_full(t):
    on = (F.col("n_nationkey") == F.col("s_nationkey")) & (F.col("s_acctbal") > 2000)
    return t.nation.filter("n_regionkey < 3").join(t.supplier.filter("s_acctbal > 0"), on, "full").select("n_nationkey", "s_suppkey")


@query("SELECT r_name, n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name, n_name")
def join_chain(t):
    joined = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey")).join(t.customer, F.col("n_nationkey") == F.col("c_nationkey")).join(t.orders, F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_orders"), rounded(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(t):
    a = t.nation.select(F.col("n_nationkey").alias("a"), "n_regionkey")
    b = t.nation.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    return a.join(b, "n_regionkey").filter("a < b").select("a", "b")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey AND r_name = 'ASIA'")
def join_on_literal(t):
    return t.nation.join(t.region, (F.col("n_regionkey") == F.col("r_regionkey")) & (F.col("r_name") == "ASIA")).select("n_nationkey", "n_name", "r_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_semi(t):
    return t.customer.join(t.orders.filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def join_anti(t):
    return t.customer.join(t.orders.filter("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    return t.region.select("r_name").crossJoin(F.broadcast(t.nation.select("n_name")))  # two tables of fixed size: 5 and 25 rows


@query(
    "WITH b AS (SELECT user_id, ts, value FROM events WHERE event_type = (SELECT min(event_type) FROM events)), a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = (SELECT max(event_type) FROM events)) "
    "SELECT event_id, a.user_id, arg_max(b.value, b.ts) AS last_value FROM a LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM b GROUP BY user_id, ts) b ON a.user_id = b.user_id AND b.ts <= a.ts GROUP BY event_id, a.user_id"
)
def join_asof(t):
    kinds = t.events.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    tagged = t.events.crossJoin(F.broadcast(kinds))  # one row
    left = tagged.filter("event_type = hi").select("event_id", "user_id", "ts")
    right = tagged.filter("event_type = lo").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return R.asof_join(left, right, "ts", ["user_id"], ["last_value"]).select("event_id", "user_id", "last_value")


@query("SELECT p_partkey, band FROM part JOIN (VALUES (900.0, 1200.0, 'low'), (1200.0, 1600.0, 'mid'), (1600.0, 99999.0, 'high')) AS b(lo, hi, band) ON p_retailprice >= lo AND p_retailprice < hi")
def join_interval(t):
    bands = t.spark.createDataFrame([(900.0, 1200.0, "low"), (1200.0, 1600.0, "mid"), (1600.0, 99999.0, "high")], "lo double, hi double, band string")
    return R.interval_join(t.part, bands, "p_retailprice", "lo", "hi", 500.0).select("p_partkey", "band")


@query("SELECT o_custkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey")
def join_salted(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("k"), "l_extendedprice", "l_linenumber")
    joined = R.salted_join(lines, t.orders.select(F.col("o_orderkey").alias("k"), "o_custkey"), ["k"], salts=4)
    return joined.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("l_extendedprice"), 2).alias("total"))


# ---- aggregation -------------------------------------------------------------


@query("SELECT count(*) AS n, count(v) AS nv, round(sum(v), 2) AS s, round(avg(v), 6) AS a, min(v) AS lo, max(v) AS hi FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders)")
def agg_basic(t):
    v = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))
    return t.orders.select(v.alias("v")).agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("nv"), rounded(F.sum("v"), 2).alias("s"), rounded(F.avg("v"), 6).alias("a"), F.min("v").alias("lo"), F.max("v").alias("hi"))


@query("SELECT count(*) AS n, sum(o_totalprice) AS s, avg(o_totalprice) AS a FROM orders WHERE o_orderkey < 0")
def agg_empty(t):
    return t.orders.filter("o_orderkey < 0").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"), F.avg("o_totalprice").alias("a"))


@query(
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 8) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"
)
def agg_group_multi(t):
    rows = t.lineitem.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), rounded(F.sum("l_extendedprice"), 2).alias("sum_base"), rounded(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), rounded(F.avg("l_discount"), 8).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


@query("SELECT year(o_orderdate) AS y, o_orderstatus AS st, count(*) AS n FROM orders GROUP BY year(o_orderdate), o_orderstatus")
def agg_group_expression(t):
    return t.orders.groupBy(F.year("o_orderdate").cast("bigint").alias("y"), F.col("o_orderstatus").alias("st")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 500000")
def agg_having_alias(t):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s")).filter("n > 12 AND s > 500000").select("o_custkey", "n", rounded(F.col("s"), 2).alias("total"))


@query("SELECT o_orderpriority, round(var_pop(o_totalprice), 0) AS vp, round(var_samp(o_totalprice), 0) AS vs, round(stddev_pop(o_totalprice), 4) AS sp, round(stddev_samp(o_totalprice), 4) AS ss FROM orders GROUP BY o_orderpriority")
def agg_stats(t):
    p = "o_totalprice"
    return t.orders.groupBy("o_orderpriority").agg(rounded(F.var_pop(p), 0).alias("vp"), rounded(F.var_samp(p), 0).alias("vs"), rounded(F.stddev_pop(p)).alias("sp"), rounded(F.stddev_samp(p)).alias("ss"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY l_returnflag")
def agg_count_distinct(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("supps"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def agg_rollup(t):
    return t.customer.rollup("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def agg_grouping_sets(t):
    return t.views("orders").sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@query("SELECT l_returnflag, true AS orders, true AS median_price FROM lineitem GROUP BY l_returnflag")
def agg_approx_distinct(t):
    """Whether the approximations are within a tenth of the exact values.

    Each exact value has an aggregate of its own: beside a distinct count Spark
    would keep the sketches of every pair of flag and order. Pairs are dealt to a
    fixed number of tasks: joined by bytes into few, their sets of keys would spill.
    """
    near = lambda a, b: F.col(a).eqNullSafe(F.col(b)) | (F.abs(F.col(a) - F.col(b)) < 0.1 * F.abs(F.col(b)))
    by_flag = t.lineitem.groupBy("l_returnflag")
    rough = by_flag.agg(F.approx_count_distinct("l_orderkey").alias("about"), F.percentile_approx("l_extendedprice", 0.5).alias("near_median"))
    pairs = t.lineitem.select("l_returnflag", "l_orderkey").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "l_returnflag", "l_orderkey").distinct()
    orders = pairs.groupBy("l_returnflag").agg(F.count("l_orderkey").alias("n"))
    medians = R.exact_percentile(t.lineitem, "l_returnflag", "l_extendedprice")
    same = lambda a, b: a["l_returnflag"].eqNullSafe(b["l_returnflag"])
    both = rough.join(orders, same(rough, orders)).join(medians, same(rough, medians), "left")
    return both.select(rough["l_returnflag"], near("about", "n").alias("orders"), near("near_median", "exact").alias("median_price"))


@query("SELECT l_linestatus, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS n, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS r FROM lineitem GROUP BY l_linestatus")
def agg_pivot(t):
    out = t.lineitem.groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).count()
    return out.select("l_linestatus", *(F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c.lower()) for c in "ANR"))


# ---- windows -----------------------------------------------------------------

_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


def _customer(*order: str) -> Window:
    return Window.partitionBy("o_custkey").orderBy(*(order or ("o_orderdate", "o_orderkey")))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS rn, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS rk, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS dr FROM part")
def win_rank(t):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return t.part.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")).cast("bigint").alias("rn"), F.rank().over(w).cast("bigint").alias("rk"), F.dense_rank().over(w).cast("bigint").alias("dr"))


@query("SELECT p_partkey, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS q FROM part")
def win_ntile(t):
    return t.part.select("p_partkey", F.ntile(4).over(Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")).cast("bigint").alias("q"))


@query(f"SELECT o_orderkey, lag(o_totalprice) OVER ({_W}) AS prev, lead(o_totalprice, 2, -1.0) OVER ({_W}) AS next2 FROM orders")
def win_lag_lead(t):
    return t.orders.select("o_orderkey", F.lag("o_totalprice").over(_customer()).alias("prev"), F.lead("o_totalprice", 2, -1.0).over(_customer()).alias("next2"))


@query(f"SELECT o_orderkey, first_value(o_totalprice) OVER ({_W}) AS f, last_value(o_totalprice) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM orders")
def win_first_last(t):
    whole = _customer().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.orders.select("o_orderkey", F.first("o_totalprice").over(_customer()).alias("f"), F.last("o_totalprice").over(whole).alias("l"))


@query("SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS cd FROM part")
def win_pct(t):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return t.part.select("p_partkey", rounded(F.percent_rank().over(w), 9).alias("pr"), rounded(F.cume_dist().over(w), 9).alias("cd"))


@query(
    f"SELECT o_orderkey, count(*) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f1, count(*) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f2, max(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS f3, min(o_totalprice) OVER ({_W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS f4, max(o_totalprice) OVER ({_W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS f5 FROM orders"
)
def win_frame_each(t):
    w, p, n = _customer(), Window.unboundedPreceding, Window.unboundedFollowing
    x = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.count(F.lit(1)).over(w.rowsBetween(p, 0)).alias("f1"), F.count(F.lit(1)).over(w.rowsBetween(0, n)).alias("f2"), F.max(x).over(w.rowsBetween(-2, 0)).alias("f3"), F.min(x).over(w.rowsBetween(0, 2)).alias("f4"), F.max(x).over(w.rowsBetween(-1, 1)).alias("f5"))


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 7) AS mean, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey), 7) AS diff FROM orders")
def win_aggregate(t):
    mean = F.avg("o_totalprice").over(Window.partitionBy("o_custkey"))
    return t.orders.select("o_orderkey", rounded(mean, 7).alias("mean"), rounded(F.col("o_totalprice") - mean, 7).alias("diff"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def win_top_k_by(t):
    return R.top_k_by(t.orders, ["o_custkey"], 3, F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


# ---- set operations ------------------------------------------------------------


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey FROM supplier")
def set_union_all(t):
    return t.customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(t):
    return t.customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 6000")
def set_except(t):
    return t.nation.select(F.col("n_nationkey").alias("k")).subtract(t.supplier.filter("s_acctbal > 6000").select("s_nationkey"))


# ---- scalar functions ----------------------------------------------------------


@query("SELECT p_partkey, p_brand || '-' || CAST(p_size AS VARCHAR) AS cc, substring(p_name, 1, 4) AS s1, substring(p_name, 3) AS s2, upper(p_name) AS u, lower(p_brand) AS l, CAST(strlen(p_name) AS BIGINT) AS bytes, length(p_name) AS chars FROM part")
def fn_string(t):
    n = F.col("p_name")
    return t.part.select("p_partkey", S.concat(F.col("p_brand"), F.lit("-"), F.col("p_size")).alias("cc"), S.substring(n, 0, 4).alias("s1"), S.substring(n, 3).alias("s2"), F.upper(n).alias("u"), F.lower("p_brand").alias("l"), S.byte_length(n).alias("bytes"), S.char_length(n).alias("chars"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, length(text) AS chars, starts_with(text, 'The') AS st, contains(text, 'é') AS has FROM documents")
def fn_utf8(t):
    x = F.col("text")
    return t.documents.select("doc_id", S.byte_length(x).alias("bytes"), S.char_length(x).alias("chars"), S.starts_with(x, "The").alias("st"), S.contains(x, "é").alias("has"))


@query(
    "SELECT event_id, abs(-value) AS a, round(sqrt(abs(value)), 9) AS q, round(power(value, 2), 9) AS p, round(sin(value), 9) AS si, round(cos(value), 9) AS co, round(exp(-abs(value)/100), 9) AS e, round(ln(abs(value) + 1), 9) AS lg, round(value, 1) AS r, CAST(ceil(value) AS DOUBLE) AS ce, CAST(floor(value) AS DOUBLE) AS fl, CAST(-event_id % 3 AS BIGINT) AS m FROM events"
)
def fn_math(t):
    v = F.col("value")
    return t.events.select(
        "event_id", F.abs(-v).alias("a"), rounded(F.sqrt(F.abs(v)), 9).alias("q"), rounded(F.pow(v, F.lit(2)), 9).alias("p"), rounded(F.sin(v), 9).alias("si"), rounded(F.cos(v), 9).alias("co"), rounded(F.exp(-F.abs(v) / 100), 9).alias("e"),
        rounded(S.natural_log(F.abs(v) + 1), 9).alias("lg"), F.round(v, 1).alias("r"), S.ceil(v).alias("ce"), S.floor(v).alias("fl"), (-F.col("event_id") % 3).cast("bigint").alias("m"),
    )


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') END || '+00:00' AS iso, strftime(ts, '%Y/%m/%d %H:%M:%S %y') AS c FROM events")
def fn_time_format(t):
    return t.events.select("event_id", T.to_iso8601(F.col("ts")).alias("iso"), T.to_char(F.col("ts"), "YYYY/MM/DD HH24:MI:SS YY").alias("c"))


@query("SELECT event_id, round(epoch(ts), 9) AS e, ts + INTERVAL 90 MINUTE AS later, CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS BIGINT) AS d FROM events")
def fn_epoch(t):
    ts = F.col("ts")
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return t.events.select("event_id", rounded(T.to_epoch(ts), 9).alias("e"), (ts + F.expr("INTERVAL 90 MINUTE")).alias("later"), T.difference_micros(ts, start).alias("d"))


@query("SELECT event_id, timezone('America/New_York', ts AT TIME ZONE 'UTC') AS ny FROM events")
def fn_time_zone(t):
    return t.events.select("event_id", T.at_time_zone(F.col("ts").cast("timestamp"), "America/New_York").cast("timestamp_ntz").alias("ny"))


# ---- JSON ------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def json_extract(t):
    return t.events.select("event_id", J.extract(F.col("props"), "$.k", "bigint").alias("k")).filter("k > 50")


_DOCS = [(1, '{"a":1,"b":"x","c":[1,2,3],"d":{"e":null,"f":true}}'), (2, '{"a":null,"c":[],"d":{"z":1.5}}'), (3, '[1,{"a":2}]'), (4, '{"b":"5"}')]
_DOCS_SQL = "(VALUES " + ", ".join(f"({i}, '{d}')" for i, d in _DOCS) + ") AS x(id, d)"


def _docs(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(_DOCS, "id int, d string")


@query(f"SELECT id, json_exists(d, '$.a') AS a, json_exists(d, '$.d.e') AS e, json_exists(d, '$.nope') AS nope FROM {_DOCS_SQL}")
def json_has(t):
    d = F.col("d")
    return _docs(t).select("id", J.has(d, "$.a").alias("a"), J.has(d, "$.d.e").alias("e"), J.has(d, "$.nope").alias("nope"))


@query(
    "SELECT id, CASE json_type(d, '$.a') WHEN 'UBIGINT' THEN 'number' WHEN 'NULL' THEN 'null' END AS a, CASE json_type(d, '$.b') WHEN 'VARCHAR' THEN 'string' END AS b, CASE json_type(d, '$.c') WHEN 'ARRAY' THEN 'array' END AS c, CASE json_type(d) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' END AS root FROM "
    + _DOCS_SQL
)
def json_type(t):
    d = F.col("d")
    return _docs(t).select("id", J.type_of(d, "$.a").alias("a"), J.type_of(d, "$.b").alias("b"), J.type_of(d, "$.c").alias("c"), J.type_of(d).alias("root"))


@query(f"SELECT id, json_extract_string(d, '$.b') AS b, CASE WHEN json_type(d, '$.c') = 'ARRAY' THEN CAST(json_extract(d, '$.c') AS VARCHAR) END AS c, CASE WHEN json_type(d, '$.d') = 'OBJECT' THEN CAST(json_extract(d, '$.d') AS VARCHAR) END AS dd FROM {_DOCS_SQL}")
def json_value_query(t):
    d = F.col("d")
    return _docs(t).select("id", J.value(d, "$.b").alias("b"), J.query(d, "$.c").alias("c"), J.query(d, "$.d").alias("dd"))


@query(f"SELECT id, CAST(coalesce(CASE WHEN json_type(d, '$.c') = 'ARRAY' THEN json_array_length(d, '$.c') END, 0) AS BIGINT) AS n, CAST(coalesce(CASE WHEN json_type(d) = 'ARRAY' THEN json_array_length(d) END, 0) AS BIGINT) AS root FROM {_DOCS_SQL}")
def json_array_length(t):
    return _docs(t).select("id", J.array_length(F.col("d"), "$.c").alias("n"), J.array_length(F.col("d")).alias("root"))


@query("""SELECT * FROM (VALUES (1, '["a","b","c","d"]'), (2, '["a","c","d"]'), (3, '[]'), (4, '["b"]')) AS x(id, ks)""")
def json_keys(t):
    return _docs(t).select("id", J.keys(F.col("d")).alias("ks"))


@query("""SELECT * FROM (VALUES (1, '{"a":9,"b":"x","c":[1,2,3],"d":{"e":null,"f":true}}', '{"b":"x","c":[1,2,3],"d":{"e":null,"f":true}}', '{"b":"x","c":[1,2,3],"d":{"e":null,"f":true},"n":1}', '{"a":1,"b":"x","c":[1,2,3,4],"d":{"e":null,"f":true}}')) AS x(id, st, rm, mp, ap)""")
def json_edit(t):
    d = F.col("d")
    return _docs(t).filter("id = 1").select("id", J.set_value(d, "$.a", "9").alias("st"), J.remove(d, "$.a").alias("rm"), J.merge_patch(d, '{"a":null,"n":1}').alias("mp"), J.array_append(d, "$.c", "4").alias("ap"))


@query("SELECT event_id, CAST(json_merge_patch(props, '{\"src\":\"web\"}') AS VARCHAR) AS p FROM events")
def json_merge_patch(t):
    return t.events.select("event_id", J.merge_patch(J.set_value(F.col("props"), "$.src", "x"), '{"src":"web"}').alias("p"))


@query("SELECT p_partkey, CAST(json_array(p_partkey, p_brand, p_size > 10) AS VARCHAR) AS a, CAST(json_object('k', p_partkey, 'b', p_brand) AS VARCHAR) AS o FROM part")
def json_build(t):
    k, b = F.col("p_partkey"), F.col("p_brand")
    return t.part.select("p_partkey", J.array(k, b, F.col("p_size") > 10).alias("a"), J.obj(F.lit("k"), k, F.lit("b"), b).alias("o"))


@query("SELECT event_id, json_valid(props) AS ok, json_valid(props || '[') AS bad FROM events")
def json_valid(t):
    return t.events.select("event_id", J.is_valid(F.col("props")).alias("ok"), J.is_valid(F.concat("props", F.lit("["))).alias("bad"))


# ---- time series -----------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '15 minutes', ts) AS bucket, round(avg(value), 9) AS mean, count(*) AS n FROM events GROUP BY 1 ORDER BY 1")
def ts_bucket(t):
    return t.events.groupBy(T.time_bucket("15m", F.col("ts")).alias("bucket")).agg(rounded(F.avg("value"), 9).alias("mean"), F.count(F.lit(1)).alias("n")).orderBy("bucket")


@query("SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2024-01-01 00:30:00') AS bucket, count(*) AS n FROM events GROUP BY 1")
def ts_bucket_origin(t):
    return t.events.groupBy(T.time_bucket("1h", F.col("ts"), "2024-01-01 00:30:00").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS ts, round(avg(value), 9) AS value FROM events GROUP BY 1, 2")
def ts_sample_by(t):
    return TS.sample_by(t.events, "ts", ["value"], "1h", keys=["event_type"]).withColumn("value", rounded(F.col("value"), 9))


_FILL = """
WITH b AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS ts, avg(value) AS value FROM events GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(ts) FROM b), (SELECT max(ts) FROM b), INTERVAL '5 minutes')) AS ts),
f AS (SELECT g.ts, b.value FROM g LEFT JOIN b ON g.ts = b.ts),
n AS (SELECT ts, value, last_value(value IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv, first_value(value IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
 last_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt, first_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt FROM f)
SELECT ts, round({}, 9) AS value FROM n
"""


def _filled(t: Tables, fill) -> DataFrame:
    return TS.sample_by(t.events, "ts", ["value"], "5m", fill=fill).withColumn("value", rounded(F.col("value"), 9))


@query(_FILL.format("pv"))
def ts_fill_prev(t):
    return _filled(t, "prev")


@query(_FILL.format("nv"))
def ts_fill_next(t):
    return _filled(t, "next")


@query(_FILL.format("CASE WHEN value IS NOT NULL THEN value ELSE pv + (nv - pv) * (epoch(ts) - epoch(pt)) / (epoch(nt) - epoch(pt)) END"))
def ts_fill_linear(t):
    return _filled(t, "linear")


@query(_FILL.format("coalesce(value, 2.5)"))
def ts_fill_const(t):
    return _filled(t, 2.5)


@query(_FILL.format("value"))
def ts_fill_null(t):
    return _filled(t, "null")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 9) AS ma FROM events")
def ts_moving_avg(t):
    return TS.moving(t.events, "value", 5, ["ts", "event_id"], keys=["user_id"], name="m").select("event_id", rounded(F.col("m"), 9).alias("ma"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 9) AS ms FROM events")
def ts_moving_sum(t):
    return TS.moving(t.events, "value", 3, ["ts", "event_id"], keys=["user_id"], how=F.sum, name="m").select("event_id", rounded(F.col("m"), 9).alias("ms"))


@query("SELECT event_id, ts, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'")
def ts_range_scan(t):
    return TS.between(t.events, "ts", "2024-01-05", "2024-01-06").select("event_id", "ts", "value")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def ts_latest(t):
    return TS.latest(t.events, "ts", 25, "event_id").select("event_id", "ts")


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, round(sum(value), 9) AS sum, round(avg(value), 9) AS avg, min(value) AS min, max(value) AS max, count(value) AS count FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-10' GROUP BY 1 ORDER BY 1")
def ts_window_agg(t):
    return TS.window_aggregates(t.events, "ts", "value", "2024-01-03", "2024-01-10", "6h").withColumns({c: rounded(F.col(c), 9) for c in ("sum", "avg")})


@query("SELECT count(value) AS count, round(sum(value), 4) AS sum, round(avg(value), 9) AS avg, min(value) AS min, max(value) AS max FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-10'")
def ts_range_agg(t):
    return TS.range_aggregate(t.events, "ts", "value", "2024-01-03", "2024-01-10").withColumns({"sum": rounded(F.col("sum")), "avg": rounded(F.col("avg"), 9)})


@query("SELECT s AS window_start, s + INTERVAL '2 hours' AS window_end, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS s FROM events) GROUP BY 1, 2")
def ts_sliding(t):
    return TS.sliding(t.events, "ts", "2h", "1h", F.count(F.lit(1)).alias("n"))


@query(
    "WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS id FROM m) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '2 hours' AS session_end, count(*) AS n FROM s GROUP BY user_id, id"
)
def ts_session(t):
    return TS.sessions(t.events, "ts", "2h", F.count(F.lit(1)).alias("n"), keys=["user_id"])


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL '7 days'")
def ts_retention(t):
    return TS.retain_time(t.events, "ts", "7d", "2024-01-31").select("event_id")


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL '14 days') WHERE n <= 5")
def ts_retention_hybrid(t):
    return TS.retain(t.events, "ts", keep="14d", now="2024-01-31", n=5, keys=["user_id"], ties=["event_id"]).select("event_id")


@query("SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS bucket, round(sum(value), 9) AS sum, count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 9) AS avg FROM events GROUP BY 1, 2")
def ts_rollup(t):
    hourly = TS.rollup(t.events, "ts", "value", "1h", ["event_type"])
    return TS.with_average(TS.coarsen(hourly, "1d", ["event_type"])).withColumns({c: rounded(F.col(c), 9) for c in ("sum", "avg")})


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS bucket, count(value) AS count, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2")
def ts_rollup_merge(t):
    parts = [TS.rollup(t.events.filter(F.col("event_id") % 2 == k), "ts", "value", "1h", ["event_type"]) for k in (0, 1)]
    return TS.merge_rollups(*parts, keys=["event_type"]).drop("sum")


@query("SELECT event_id, event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS delta FROM events")
def ts_delta(t):
    return TS.delta(t.events, "event_id", ["ts", "event_id"], ["user_id"]).select("event_id", "delta")


@query("WITH d AS (SELECT *, event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS d1 FROM events) SELECT event_id, d1 - coalesce(lag(d1) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS delta2 FROM d")
def ts_delta_of_delta(t):
    return TS.delta_of_delta(t.events, "event_id", ["ts", "event_id"], ["user_id"]).select("event_id", "delta2")


@query(
    "WITH m AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m) SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS length, min(ts) AS first FROM r GROUP BY user_id, run"
)
def ts_rle(t):
    return TS.run_lengths(t.events, "event_type", ["ts", "event_id"], ["user_id"])


# ---- vectors ---------------------------------------------------------------------

_Q = [0.1, -0.2, 0.05, 0.3] * 16
_QSQL = "[" + ", ".join(map(str, _Q)) + "]::DOUBLE[]"
_E = "embedding::DOUBLE[]"


@query(f"SELECT vec_id, round(list_distance({_E}, {_QSQL}), 9) AS distance FROM embeddings ORDER BY list_distance({_E}, {_QSQL}), vec_id LIMIT 10")
def vec_l2_topk(t):
    return VS.knn(t.embeddings, "embedding", _Q, 10, ties=("vec_id",)).select("vec_id", rounded(F.col("distance"), 9).alias("distance"))


@query(f"SELECT vec_id, round(list_inner_product({_E}, {_QSQL}), 9) AS distance FROM embeddings ORDER BY list_inner_product({_E}, {_QSQL}) DESC, vec_id LIMIT 10")
def vec_ip_topk(t):
    return VS.knn(t.embeddings, "embedding", _Q, 10, metric="ip", ties=("vec_id",)).select("vec_id", rounded(F.col("distance"), 9).alias("distance"))


@query(f"SELECT vec_id, round(list_cosine_similarity({_E}, {_QSQL}), 9) AS distance FROM embeddings ORDER BY list_cosine_similarity({_E}, {_QSQL}) DESC, vec_id LIMIT 10")
def vec_cosine_topk(t):
    return VS.knn(t.embeddings, "embedding", _Q, 10, metric="cosine", ties=("vec_id",)).select("vec_id", rounded(F.col("distance"), 9).alias("distance"))


@query(f"SELECT vec_id, round(list_distance({_E}, {_QSQL}), 9) AS distance FROM embeddings WHERE list_distance({_E}, {_QSQL}) < 1.8")
def vec_range(t):
    return VS.within(t.embeddings, "embedding", _Q, 1.8).select("vec_id", rounded(F.col("distance"), 9).alias("distance"))


@query(f"SELECT vec_id, label, round(list_distance({_E}, {_QSQL}), 9) AS distance FROM embeddings WHERE label IN (1, 2, 3) AND list_distance({_E}, {_QSQL}) < 2.5 ORDER BY list_distance({_E}, {_QSQL}), vec_id LIMIT 10")
def vec_hybrid(t):
    near = VS.within(t.embeddings, "embedding", _Q, 2.5, where=F.col("label").isin(1, 2, 3))
    return near.orderBy("distance", "vec_id").limit(10).select("vec_id", "label", rounded(F.col("distance"), 9).alias("distance"))


@query(f"SELECT vec_id, round(2 * list_sum({_E}) + list_sum({_QSQL}), 4) AS s FROM embeddings")
def vec_arith(t):
    v = V.add(V.scale(F.col("embedding"), 2.0), V.literal(_Q))
    return t.embeddings.select("vec_id", rounded(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 4).alias("s"))


@query(f"SELECT vec_id, round(1 - list_cosine_similarity({_E}, {_QSQL}), 9) AS d, list_cosine_similarity({_E}, {_QSQL}) >= 0.1 AS near FROM embeddings")
def vec_functions(t):
    e, q = F.col("embedding"), V.literal(_Q)
    return t.embeddings.select("vec_id", rounded(V.distance(e, q, "cosine"), 9).alias("d"), V.similar(e, q, "cosine", 0.1).alias("near"))


@query(ORACLES["vec_l2_topk"])
def vec_ivf(t):
    index = VI.IvfIndex(t.embeddings, "embedding", lists=8)
    return index.search(_Q, 10, probes=4, ties=("vec_id",)).select("vec_id", rounded(F.col("distance"), 9).alias("distance"))


@query(ORACLES["vec_l2_topk"])
def vec_ivf_pq(t):
    index = VI.ProductCodes(t.embeddings, "embedding", parts=8)
    return index.search(_Q, 10, ties=("vec_id",)).select("vec_id", rounded(F.col("distance"), 9).alias("distance"))


@query("SELECT 10::BIGINT AS k, true AS recalled")
def vec_hnsw(t):
    """Whether at least nine of the ten nearest are found by the graph."""
    found = VI.GraphIndex(t.embeddings, "embedding", "vec_id").search(_Q, 10, beam=256)
    near = VS.knn(t.embeddings, "embedding", _Q, 10, ties=("vec_id",))
    return near.join(found, near.vec_id == found.key, "left").agg(F.count(F.lit(1)).alias("k"), (F.count("key") >= 9).alias("recalled"))


@query(ORACLES["vec_l2_topk"])
def vec_binary(t):
    return VS.binary_knn(t.embeddings, "embedding", _Q, 10, ties=("vec_id",)).select("vec_id", rounded(F.col("distance"), 9).alias("distance"))


@query(f"SELECT vec_id, CAST(list_sum([CAST(round((greatest(least(x, 1.0), -1.0) + 1.0) * 255 / 2.0) AS INTEGER) FOR x IN {_E}]) AS BIGINT) AS s FROM embeddings")
def vec_scalar_quantized(t):
    q = VS.scalar_quantize(F.col("embedding"), -1.0, 1.0)
    return t.embeddings.select("vec_id", F.aggregate(q, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("s"))


# ---- models ----------------------------------------------------------------------


@query(
    """WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '\\s+')) AS w FROM documents), c AS (SELECT doc_id, (md5_number_upper(w) & 4294967295) % 16 AS slot, sum(CASE WHEN md5_number_lower(w) & 1 = 1 THEN 1 ELSE -1 END) AS n FROM w WHERE w <> '' GROUP BY 1, 2)
    SELECT doc_id, CAST(slot AS INTEGER) AS slot, round(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS DOUBLE), 4) AS x FROM c WHERE n <> 0"""
)
def model_embed(t):
    ModelRegistry(t.spark).create("doc_embed", "hash:16", [("text", "TEXT")], "VECTOR(16)", if_not_exists=True)
    embedded = t.documents.select("doc_id", F.posexplode(F.expr("doc_embed(text)")).alias("slot", "x"))
    return embedded.filter("x <> 0").select("doc_id", "slot", rounded(F.col("x").cast("double"), 4).alias("x"))


# ---- changes ---------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, 'X' FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey + 100000000, 'X' FROM orders WHERE o_orderkey % 50 = 0")
def upsert(t):
    target = t.orders.select("o_orderkey", "o_orderstatus")
    new = target.filter("o_orderkey % 7 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus")).union(target.filter("o_orderkey % 50 = 0").select(F.col("o_orderkey") + 100000000, F.lit("X")))
    return R.upsert(target, new, ["o_orderkey"])


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 25, 'new' FROM nation WHERE n_nationkey >= 15")
def insert_ignore(t):
    target = t.nation.select("n_nationkey", "n_name")
    return R.insert_ignore(target, target.select((F.col("n_nationkey") + 10).cast("int").alias("n_nationkey"), F.lit("new").alias("n_name")).filter("n_nationkey < 25").union(target.filter("n_nationkey >= 15").select((F.col("n_nationkey") + 25).cast("int"), F.lit("new"))), ["n_nationkey"])


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey FROM customer")
def update_rewrite(t):
    rows = t.customer.select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    return R.update(rows, {"c_acctbal": F.col("c_acctbal") * 2, "c_nationkey": F.col("c_nationkey") + 1}, F.col("c_mktsegment") == "BUILDING").drop("c_mktsegment")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 1000)")
def delete_rewrite(t):
    return R.delete(t.orders, (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 1000)).select("o_orderkey")


# ---- SQL text through the engine ----------------------------------------------------


def _engine(t: Tables, *names: str):
    from ..engine import Engine

    engine = Engine(t.spark, f"{scratch_dir(t.spark)}/engine-{uuid.uuid4().hex}")
    t.views(*names)
    return engine


@query(_FILL.format("pv"))
def sql_sample_by(t):
    return _engine(t, "events").sql("SELECT ts, value FROM events SAMPLE BY 5m FILL(PREV)").withColumn("value", rounded(F.col("value"), 9))


@query("SELECT event_type, time_bucket(INTERVAL '6 hours', ts) AS b, count(*) AS n, round(avg(value), 9) AS a FROM events WHERE value > 1 GROUP BY 1, 2")
def sql_time_bucket(t):
    out = _engine(t, "events").sql("SELECT event_type, TIME_BUCKET('6h', ts) AS b, count(*) AS n, avg(value) AS a FROM events WHERE value > 1 GROUP BY event_type, b")
    return out.withColumn("a", rounded(F.col("a"), 9))


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 9) AS m FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def sql_moving_average(t):
    out = _engine(t, "events").sql("SELECT user_id, event_id, MOVING_AVERAGE(value, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS m FROM events WHERE JSON_HAS(props, '$.k')")
    return out.withColumn("m", rounded(F.col("m"), 9))


@query(f"SELECT vec_id, label, round(list_distance({_E}, {_QSQL}), 9) AS d FROM embeddings WHERE label < 5 AND list_cosine_similarity({_E}, {_QSQL}) > 0 ORDER BY list_distance({_E}, {_QSQL}), vec_id LIMIT 15")
def sql_vector_search(t):
    out = _engine(t, "embeddings").sql(f"SELECT vec_id, label, embedding <-> {_Q} AS d FROM embeddings WHERE label < 5 AND embedding <=> {_Q} > 0 ORDER BY embedding <-> {_Q}, vec_id LIMIT 15")
    return out.withColumn("d", rounded(F.col("d"), 9))


@query("SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN upper(n_name) ELSE n_name END AS name, CAST(n_regionkey + CASE WHEN n_regionkey = 1 THEN 10 ELSE 0 END AS BIGINT) AS region FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 100, 'new', 7")
def sql_changes(t):
    engine = _engine(t, "nation")
    for s in (
        "CREATE TABLE places (id INT PRIMARY KEY, name VARCHAR(64) NOT NULL, region BIGINT DEFAULT 7)",
        "INSERT INTO places SELECT n_nationkey, n_name, n_regionkey FROM nation",
        "INSERT IGNORE INTO places (id, name) VALUES (100, 'new'), (3, 'ignored')",
        "BEGIN",
        "UPDATE places SET name = UPPER(name), region = region + 10 WHERE region = 1",
        "DELETE FROM places WHERE region = 2",
        "COMMIT",
        "BEGIN",
        "DELETE FROM places",
        "ROLLBACK",
    ):
        engine.sql(s)
    return engine.sql("SELECT id, name, region FROM places")


# ---- streams: what they end with is what a batch gives ------------------------------


def _final(t: Tables, stream: DataFrame) -> DataFrame:
    """The last complete result of a stream over what is there now."""
    out = f"{scratch_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    started = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/rows"))
    started.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{out}/rows")


def _stream(t: Tables, name: str) -> DataFrame:
    return streams.records(t.spark, f"{t.sf_dir}/{name}.parquet", getattr(t, name).schema)


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS bucket, round(sum(value), 9) AS sum, count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 9) AS avg FROM events GROUP BY 1, 2")
def stream_rollup(t):
    out = _final(t, streams.rollup(_stream(t, "events"), "ts", "value", "1h", keys=["event_type"]))
    return out.withColumns({"bucket": F.col("bucket").cast("timestamp_ntz"), "sum": rounded(F.col("sum"), 9), "avg": rounded(F.col("avg"), 9)})


@query(ORACLES["ts_sliding"].replace("count(*) AS n", "count(value) AS count").replace("SELECT unnest", "SELECT value, unnest").replace("s AS window_start, s + INTERVAL '2 hours' AS window_end", "s AS bucket").replace("GROUP BY 1, 2", "GROUP BY 1"))
def stream_sliding(t):
    out = _final(t, streams.rollup(_stream(t, "events"), "ts", "value", "2h", slide="1h"))
    return out.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "count")


@query(ORACLES["ts_session"])
def stream_session(t):
    out = _final(t, streams.sessions(_stream(t, "events"), "ts", "2h", keys=["user_id"]))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_deduplicate(t):
    rows = _stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = f"{scratch_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    streams.to_files(streams.without_duplicates(rows, ["user_id", "event_type"], "ts", "60d").select("user_id", "event_type"), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{out}/rows")


@query("SELECT 1::BIGINT AS seq, 'INSERT' AS op, count(*) AS n FROM region UNION ALL SELECT 2, 'UPDATE', count(*) FROM region WHERE r_regionkey < 2 UNION ALL SELECT 3, 'DELETE', count(*) FROM region WHERE r_regionkey = 4")
def stream_change_feed(t):
    engine = _engine(t, "region")
    for s in ("CREATE TABLE r (id INT PRIMARY KEY, name TEXT)", "INSERT INTO r SELECT r_regionkey, r_name FROM region", "UPDATE r SET name = 'x' WHERE id < 2", "DELETE FROM r WHERE id = 4"):
        engine.sql(s)
    return _final(t, streams.changes(engine.db, "r").groupBy("seq", "op").agg(F.count(F.lit(1)).alias("n")))
