"""Table operators, one query each, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, Rows
from .operators import grouping, joins, ordering

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = lambda spark, sf_dir: f(Engine(spark, sf_dir))
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


# grouping and aggregation


@query("SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY 1")
def group_by_customer(e):
    out = grouping.group_by(e.rows("orders"), {"o_custkey": "o_custkey"}, {"total": ("sum", "o_totalprice"), "n": ("count", ".")})
    return ordering.sort(Rows(out), ("total", {"order": "descending"}))


@query("SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS qty, sum(l_extendedprice * (1 - l_discount)) AS revenue, avg(l_discount) AS disc, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def group_by_composite(e):
    rows = e.rows("lineitem").where("l_shipdate <= xs:dateTime('1998-09-02T00:00:00')")
    return grouping.group_by(rows, {"flag": "l_returnflag", "status": "l_linestatus"}, {"qty": ("sum", "l_quantity"), "revenue": ("sum", "l_extendedprice * (1 - l_discount)"), "disc": ("avg", "l_discount"), "first_ship": ("min", "l_shipdate"), "last_ship": ("max", "l_shipdate"), "n": ("count", ".")})


@query("SELECT token, count(*) AS n FROM (SELECT p_partkey, unnest(list_distinct(string_split(p_type, ' '))) AS token FROM part) GROUP BY 1")
def group_by_multi_value(e):
    return grouping.group_by(e.rows("part"), {"token": "tokenize(p_type)"}, {"n": ("count", ".")})


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 3")
def group_having(e):
    return grouping.group_by(e.rows("part"), {"p_brand": "p_brand"}, {"n": ("count", ".")}, having="n > 3")


@query("SELECT year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2")
def group_by_expression(e):
    return grouping.group_by(e.rows("orders"), {"y": "year-from-dateTime(o_orderdate)", "m": "month-from-dateTime(o_orderdate)"}, {"total": ("sum", "o_totalprice")})


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY 1")
def group_string_join(e):
    return grouping.group_by(e.rows("orders"), {"o_custkey": "o_custkey"}, {"keys": ("string-join", "o_orderkey", ","), "first_key": ("first", "o_orderkey"), "last_key": ("last", "o_orderkey")}, order="o_orderkey")


@query("SELECT user_id, event_type AS grouping_key, n, first_id FROM (SELECT user_id, event_type, run, count(*) AS n, min(event_id) AS first_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM events) GROUP BY 1, 2, 3)")
def group_adjacent(e):
    out = grouping.group_adjacent(e.rows("events"), ["user_id"], ["ts", "event_id"], "event_type", {"n": ("count", "."), "first_id": ("min", "event_id")})
    return out.drop(grouping.GROUP)


@query("SELECT user_id, g AS group_no, count(*) AS n, sum(value) AS total FROM (SELECT *, sum((event_type = 'signup' OR rn = 1)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)) GROUP BY 1, 2")
def group_starting_with(e):
    return grouping.group_starting_with(e.rows("events"), ["user_id"], ["ts", "event_id"], "event_type = 'signup'", {"n": ("count", "."), "total": ("sum", "value")})


@query("SELECT user_id, g AS group_no, count(*) AS n FROM (SELECT *, 1 + coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM events) GROUP BY 1, 2")
def group_ending_with(e):
    return grouping.group_ending_with(e.rows("events"), ["user_id"], ["ts", "event_id"], "event_type = 'purchase'", {"n": ("count", ".")})


@query("SELECT count(*) AS n, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def aggregate_totals(e):
    return grouping.totals(e.rows("orders"), {"n": ("count", "."), "total": ("sum", "o_totalprice"), "mean": ("avg", "o_totalprice"), "low": ("min", "o_totalprice"), "high": ("max", "o_totalprice")})


@query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY ROLLUP (1, 2)")
def group_rollup(e):
    return grouping.rollup(e.rows("lineitem"), {"flag": "l_returnflag", "status": "l_linestatus"}, {"n": ("count", ".")})


@query("SELECT o_custkey, CAST(sum(o_totalprice) AS DOUBLE) AS folded FROM orders GROUP BY 1")
def group_fold(e):
    return grouping.fold(e.rows("orders"), ["o_custkey"], ["o_orderkey"], "0e0", "$acc + $item/o_totalprice", "folded")


@query("SELECT DISTINCT p_brand AS value FROM part")
def distinct_values(e):
    return ordering.distinct_values(e.rows("part"), "p_brand")


@query("SELECT o_orderpriority, list(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY 1")
def group_distinct(e):
    return grouping.group_by(e.rows("orders"), {"o_orderpriority": "o_orderpriority"}, {"statuses": ("distinct-values", "o_orderstatus")})


# joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def key_lookup(e):
    return joins.lookup(e.rows("orders"), "o_custkey", e.rows("customer"), "c_custkey", columns={"c_name": "c_name"}).select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def key_lookup_left(e):
    return joins.lookup(e.rows("customer"), "c_custkey", e.rows("orders"), "o_custkey", "left", {"o_orderkey": "o_orderkey"}).select("c_custkey", "o_orderkey")


@query("SELECT a.l_orderkey, a.l_linenumber, b.n FROM lineitem a JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey")
def key_lookup_composite(e):
    pairs = Rows(e.table("lineitem").groupBy("l_partkey", "l_suppkey").count())
    return joins.lookup(e.rows("lineitem"), ["l_partkey", "l_suppkey"], pairs, ["l_partkey", "l_suppkey"], columns={"n": "count"}).select("l_orderkey", "l_linenumber", "n")


@query("SELECT p_partkey, word, n_regionkey FROM (SELECT p_partkey, unnest(list_distinct(string_split(upper(p_name), ' '))) AS word FROM part) JOIN nation ON substr(n_name, 1, 1) = substr(word, 1, 1)")
def key_lookup_multi_value(e):
    rows = e.rows("part").with_columns(words="distinct-values(tokenize(upper-case(p_name)))")
    exploded = Rows(rows.df.select("p_partkey", F.explode("words").alias("word")))
    return joins.lookup(exploded, "substring(word, 1, 1)", e.rows("nation"), "substring(n_name, 1, 1)", columns={"n_regionkey": "n_regionkey"}).select("p_partkey", "word", "n_regionkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_join(e):
    return joins.lookup(e.rows("customer"), "c_custkey", e.rows("orders"), "o_custkey", "semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 150000)")
def anti_join(e):
    return joins.lookup(e.rows("customer"), "c_custkey", e.rows("orders").where("o_orderstatus = 'F' and o_totalprice > 150000"), "o_custkey", "anti").select("c_custkey")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def nested_for_join(e):
    return joins.nested(e.rows("nation"), e.rows("region"), "n_regionkey = r_regionkey and r_name != 'ASIA'").select("n_name", "r_name")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal < c_acctbal")
def theta_join(e):
    return joins.nested(e.rows("supplier"), e.rows("customer"), "s_nationkey = c_nationkey and s_acctbal < c_acctbal").select("s_suppkey", "c_custkey")


@query("SELECT p_partkey, s_suppkey FROM part, supplier WHERE p_retailprice >= s_acctbal AND p_retailprice < s_acctbal + 40")
def band_join(e):
    suppliers = Rows(e.table("supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 40).alias("high")))
    return joins.band(e.rows("part"), "p_retailprice", suppliers, "low", "high", 40.0).select("p_partkey", "s_suppkey")


@query("SELECT e.event_id, p.event_id AS last_event_id FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def as_of_join(e):
    rows = e.table("events").select("event_id", "user_id", "ts")
    bought = e.table("events").where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    return joins.as_of(Rows(rows), "ts", Rows(bought), "ts", ["user_id"], ["event_id"]).select("event_id", "last_event_id")


@query("SELECT coalesce(a.k, b.k) AS merge_key, coalesce(a.n, NULL) AS parts, b.n AS lines, a.k IS NOT NULL AS in_part, b.k IS NOT NULL AS in_line FROM (SELECT p_partkey AS k, count(*) AS n FROM part GROUP BY 1) a FULL JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1) b ON a.k = b.k")
def merge_groups(e):
    return joins.merge({"part": (e.rows("part"), "p_partkey"), "line": (e.rows("lineitem"), "l_partkey")}, {"parts": ("part", "count", "."), "lines": ("line", "count", ".")})


@query("SELECT row_number() OVER (ORDER BY ts, event_id, event_type) AS place, ts AS k0, event_id AS k1, CASE event_type WHEN 'error' THEN 0 ELSE 1 END AS source_no, CASE event_type WHEN 'error' THEN 'errors' ELSE 'signups' END AS source, value FROM events WHERE event_type IN ('error', 'signup')")
def merge_ordered(e):
    logs = {"errors": (e.rows("events").where("event_type = 'error'"), ["ts", "event_id"]), "signups": (e.rows("events").where("event_type = 'signup'"), ["ts", "event_id"])}
    return ordering.numbered(joins.merge_rows(logs, {"value": "value"}), "place")


@query("SELECT r_regionkey, n_nationkey FROM (SELECT n_regionkey AS r_regionkey, string_agg(n_nationkey::VARCHAR, ' ') AS refs FROM nation GROUP BY 1) r, nation WHERE list_contains(string_split(refs, ' '), n_nationkey::VARCHAR)")
def id_join(e):
    refs = Rows(e.table("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.collect_list(F.col("n_nationkey").cast("string")), " ").alias("refs")))
    nations = Rows(e.table("nation").select("n_nationkey", F.col("n_nationkey").cast("string").alias("id")))
    return joins.idrefs(refs, "refs", nations, "id").select("r_regionkey", "n_nationkey")


@query("SELECT s_suppkey, n_nationkey FROM (SELECT s_suppkey, s_nationkey, (s_nationkey + 7) % 25 AS other FROM supplier), nation WHERE n_nationkey IN (s_nationkey, other)")
def idref_join(e):
    """Nodes that name an id among several: suppliers by each of the nations their references name."""
    refs = Rows(e.table("supplier").select("s_suppkey", F.concat_ws(" ", F.col("s_nationkey").cast("string"), ((F.col("s_nationkey") + 7) % 25).cast("string")).alias("refs")))
    nations = Rows(e.table("nation").select("n_nationkey", F.col("n_nationkey").cast("string").alias("id")))
    return joins.idrefs(refs, "refs", nations, "id").select("s_suppkey", "n_nationkey")


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey + 1 AND x.o_orderstatus = o.o_orderstatus AND x.o_orderpriority = o.o_orderpriority)")
def deep_equal_join(e):
    """Orders whose status and priority are, together, those of an order of the next customer."""
    shifted = Rows(e.table("orders").withColumn("o_custkey", (F.col("o_custkey") - 1).cast("bigint")))
    rows = Rows(e.table("orders").withColumn("o_custkey", F.col("o_custkey").cast("bigint")))
    return joins.deep_equal(rows, shifted, ["o_custkey", "o_orderstatus", "o_orderpriority"]).select("o_orderkey")


@query("SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1")
def join_chain(e):
    orders = e.rows("orders").where("o_orderdate >= xs:dateTime('1995-01-01T00:00:00') and o_orderdate < xs:dateTime('1996-01-01T00:00:00')")
    out = joins.lookup(Rows(orders.df.select("o_orderkey", "o_custkey")), "o_custkey", e.rows("customer"), "c_custkey", columns={"c_nationkey": "c_nationkey"})
    out = joins.lookup(e.rows("lineitem"), "l_orderkey", Rows(out), "o_orderkey", columns={"c_nationkey": "c_nationkey"})
    out = joins.lookup(Rows(out), "c_nationkey", e.rows("nation"), "n_nationkey", columns={"n_name": "n_name"})
    return grouping.group_by(Rows(out), {"n_name": "n_name"}, {"revenue": ("sum", "l_extendedprice * (1 - l_discount)")})


# sets


@query("SELECT p_partkey FROM part WHERE p_size < 10 UNION SELECT p_partkey FROM part WHERE p_retailprice > 1500")
def set_union(e):
    return ordering.union(e.rows("part").where("p_size < 10").df, e.rows("part").where("p_retailprice > 1500").df, ["p_partkey"]).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size < 30 INTERSECT SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#21')")
def set_intersect(e):
    return ordering.intersect(e.rows("part").where("p_size < 30").df, e.rows("part").where("p_brand = ('Brand#11', 'Brand#12', 'Brand#21')").df, ["p_partkey"]).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size < 10 EXCEPT SELECT p_partkey FROM part WHERE p_retailprice > 1200")
def set_except(e):
    return ordering.except_(e.rows("part").where("p_size < 10").df, e.rows("part").where("p_retailprice > 1200").df, ["p_partkey"]).select("p_partkey")


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def set_concatenate(e):
    return ordering.concatenated(e.rows("nation").select(name="n_name"), e.rows("region").select(name="r_name"))


@query("SELECT DISTINCT c_nationkey::BIGINT AS value FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def value_set_intersect(e):
    a, b = ordering.distinct_values(e.rows("customer"), "c_nationkey"), ordering.distinct_values(e.rows("supplier"), "s_nationkey")
    return ordering.intersect(a, b, ["value"]).select(F.col("value").cast("bigint").alias("value"))


# order and positions


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders")
def sort_keys(e):
    """The place of each order in the sorted sequence, counted in the partitions the sort leaves."""
    out = ordering.sort(e.rows("orders"), "o_orderpriority", ("o_totalprice", {"order": "descending"}), stable=["o_orderkey"]).select("o_orderkey")
    return ordering.numbered(out, "place")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def sort_top_k(e):
    return ordering.top(e.rows("orders"), 20, ("o_totalprice", {"order": "descending"}), stable=["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, position FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders) WHERE position <= 3")
def top_in_group(e):
    return ordering.top_in_group(e.rows("orders"), 3, ["o_custkey"], ("o_totalprice", {"order": "descending"}), stable=["o_orderkey"]).select("o_custkey", "o_orderkey", "position")


@query("SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 10 OFFSET 5")
def limit_subsequence(e):
    return ordering.subsequence(e.rows("part"), ["p_partkey"], 6, 10).select("p_partkey")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, count(*) OVER (PARTITION BY conv_id) AS last FROM conversations")
def position_last(e):
    return ordering.positions(e.rows("conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "position", "last")


@query("SELECT event_id, lag(event_type) OVER w AS preceding, lead(event_type) OVER w AS following FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def sibling_neighbours(e):
    return ordering.neighbours(e.rows("events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "preceding", "following")


@query("SELECT event_id, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS number FROM events")
def number_single(e):
    return ordering.number(e.rows("events"), ["user_id"], ["ts", "event_id"], "event_type = 'error'").select("event_id", "number")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS number FROM (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)")
def number_any_from(e):
    return ordering.number(e.rows("events"), ["user_id"], ["ts", "event_id"], "true()", since="event_type = 'signup'").select("event_id", "number")


@query("SELECT n_nationkey, a || '.' || b AS number FROM (SELECT n_nationkey, dense_rank() OVER (ORDER BY n_regionkey) AS a, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation)")
def number_multiple(e):
    return ordering.number_multiple(e.rows("nation"), ["n_regionkey", "n_nationkey"], ["n_nationkey"]).select("n_nationkey", "number")


@query("SELECT event_id, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS value_before, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value_after FROM events")
def accumulator(e):
    return ordering.accumulator(e.rows("events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "value_before", "value_after")


@query("SELECT event_id FROM (SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE coalesce(before, 0) <= 100")
def iterate_break(e):
    return ordering.iterate_until(e.rows("events"), ["user_id"], ["ts", "event_id"], "value", "running_sum > 100").select("event_id")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE count(*) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) - (g > 0)::INT END AS streak FROM (SELECT *, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS g FROM events)")
def iterate_state(e):
    def step(row, state):
        state = {"n": 0 if row["event_type"] == "error" else state["n"] + 1}
        return state, {"event_id": row["event_id"], "streak": state["n"]}, True

    return ordering.iterate(Rows(e.table("events").select("event_id", "user_id", "ts", "event_type")), ["user_id"], ["ts", "event_id"], {"n": 0}, step, "event_id long, streak long")


@query("SELECT p_partkey, sum(l_quantity) AS qty FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_size BETWEEN 5 AND 15 GROUP BY 1")
def user_function(e):
    rows = e.rows("part").function("f:within", ["x", "a", "b"], "$x ge $a and $x le $b").where("f:within(p_size, 5, 15)")
    lines = joins.lookup(e.rows("lineitem"), "l_partkey", rows, "p_partkey", columns={"p_partkey": "p_partkey"})
    return grouping.group_by(Rows(lines), {"p_partkey": "p_partkey"}, {"qty": ("sum", "l_quantity")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
