"""One query for each operator of the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import joined_text_key, mixed_key, null_as_zero
from ..keyspec import Key, KeySpec
from ..operators.audit import audit
from ..operators.edit import Rule
from ..sources import read
from ..storage import materialize
from ..table import FrozenError, SortedTable

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


ORDER_KEY = KeySpec.of("o_orderkey")
ORDER_COLS = ("o_orderkey", "o_custkey", "o_totalprice")
ITEM_KEY = KeySpec.of("l_orderkey", "l_linenumber")
ITEM_SEQ = ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def _orders(spark: SparkSession, sf: str, *cols: str) -> SortedTable:
    return SortedTable(read(spark, sf, "orders").select(*(cols or ORDER_COLS)), ORDER_KEY)


def _events(spark: SparkSession, sf: str) -> SortedTable:
    return SortedTable(read(spark, sf, "events").select("event_id", "user_id", "event_type"), "event_id")


def _numbered(df: DataFrame, *order) -> DataFrame:
    """Adds ``pos`` for a result whose row order is the point; only for small results."""
    from pyspark.sql import Window

    return df.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("bigint") - 1)


# ranges and scans ---------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 500")
def get_range(spark, sf):
    return _orders(spark, sf).get_range(100, 500)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 500")
def get_range_inclusive(spark, sf):
    return _orders(spark, sf).get_range(100, 500, include_high=True)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 500 ORDER BY 1 LIMIT 25")
def get_range_limit(spark, sf):
    return _orders(spark, sf).get_range(100, 500, max_length=25)


@query("SELECT * FROM (SELECT 'exclusive' AS kind, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' UNION ALL SELECT 'inclusive', count(*) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1997-01-01' UNION ALL SELECT 'inverted', 0)")
def range_count(spark, sf):
    from datetime import datetime

    t = SortedTable(read(spark, sf, "lineitem").select("l_shipdate"), "l_shipdate")
    lo, hi = datetime(1996, 1, 1), datetime(1997, 1, 1)
    counts = [("exclusive", t.count_range(lo, hi)), ("inclusive", t.count_range(lo, hi, True)), ("inverted", t.count_range(hi, lo))]
    out = None
    for kind, df in counts:
        df = df.select(F.lit(kind).alias("kind"), "n")
        out = df if out is None else out.unionByName(df)
    return out


@query("SELECT o_orderkey, o_totalprice, 7 + row_number() OVER (ORDER BY o_orderkey) - 1 AS counter FROM orders WHERE o_orderkey >= 1000")
def range_counter(spark, sf):
    return _orders(spark, sf, "o_orderkey", "o_totalprice").for_range(1000, None, initial=7)


@query("WITH s AS (SELECT min(o_orderkey) k FROM orders WHERE o_totalprice > 400000) SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS counter FROM orders, s WHERE s.k IS NULL OR o_orderkey <= s.k")
def for_each_break(spark, sf):
    return _orders(spark, sf, "o_orderkey", "o_totalprice").for_each(stop=F.col("o_totalprice") > 400000).select("o_orderkey", "counter")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 2000 ORDER BY o_orderkey LIMIT 1")
def find_first(spark, sf):
    return _orders(spark, sf, "o_orderkey", "o_totalprice").find_first(F.col("o_totalprice") < 2000)


@query("SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events WHERE event_id >= 900")
def entries_seek(spark, sf):
    t = _events(spark, sf)
    return SortedTable(t.entries(900), t.keys).for_each().select("event_id", "user_id", F.col("counter").alias("pos"))


@query("SELECT event_id, user_id, row_number() OVER (ORDER BY event_id DESC) - 1 AS pos FROM events WHERE event_id <= 900")
def entries_reversed(spark, sf):
    return _numbered(_events(spark, sf).entries_reversed(900).select("event_id", "user_id"), F.desc("event_id"))


@query("SELECT event_id, user_id, row_number() OVER (ORDER BY event_id DESC) - 1 AS pos FROM events WHERE event_id < 900")
def skip_highest(spark, sf):
    return _numbered(_events(spark, sf).entries_reversed(900, skip_highest=True).select("event_id", "user_id"), F.desc("event_id"))


@query("SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS pos FROM nation")
def keys_array(spark, sf):
    return _numbered(SortedTable(read(spark, sf, "nation"), "n_name").keys_array(), "n_name")


@query("SELECT n_nationkey, n_regionkey FROM nation")
def values_array(spark, sf):
    return SortedTable(read(spark, sf, "nation"), "n_name").values_array()


@query("SELECT * FROM (SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 3)")
def to_array(spark, sf):
    return SortedTable(read(spark, sf, "region"), "r_regionkey").to_array(3)


@query("SELECT string_agg(r_regionkey::VARCHAR || ',' || r_name, ',' ORDER BY r_regionkey) AS text FROM region")
def to_string(spark, sf):
    return SortedTable(read(spark, sf, "region"), "r_regionkey").to_string()


@query("SELECT o_orderkey FROM orders")
def as_set(spark, sf):
    return _orders(spark, sf).as_set()


@query("SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON o_orderkey >= c_custkey * 7 AND o_orderkey < c_custkey * 7 + 20 GROUP BY c_custkey")
def range_join(spark, sf):
    ranges = read(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") * 7).alias("lo"), (F.col("c_custkey") * 7 + 20).alias("hi"))
    return _orders(spark, sf, "o_orderkey").range_join(ranges, "lo", "hi", 20).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, p_size, p_partkey, row_number() OVER (ORDER BY p_brand, p_size DESC, p_partkey) - 1 AS counter FROM part")
def custom_order(spark, sf):
    spec = KeySpec.of("p_brand", Key("p_size", ascending=False), "p_partkey")
    return SortedTable(read(spark, sf, "part").select("p_brand", "p_size", "p_partkey"), spec).for_each()


@query("SELECT o_orderkey FROM orders WHERE o_orderkey <= 300 AND o_orderkey > 120")
def reverse_order_range(spark, sf):
    spec = KeySpec.of(Key("o_orderkey", ascending=False))
    return SortedTable(_orders(spark, sf, "o_orderkey").df, spec).get_range(300, 120)


@query("SELECT * FROM (VALUES ('nan', 0), ('-inf', 1), ('-1', 2), ('0', 3), ('inf', 4), ('null', 5)) t(name, pos)")
def nan_null_order(spark, sf):
    rows = [("inf", float("inf")), ("null", None), ("nan", float("nan")), ("0", 0.0), ("-inf", float("-inf")), ("-1", -1.0)]
    df = spark.createDataFrame(rows, "name string, k double")
    spec = KeySpec.of("k", allow_null=True)
    return _numbered(df, *spec.order(df)).select("name", F.col("pos").cast("int").alias("pos"))


@query("SELECT * FROM (VALUES ('false', 0), ('true', 1), ('nan', 2), ('2', 3), ('null', 4), ('date', 5), ('text', 6)) t(name, pos)")
def mixed_type_order(spark, sf):
    rows = [("text", None, None, None, "10"), ("2", None, 2.0, None, None), ("true", True, None, None, None), ("null", None, None, None, None), ("nan", None, float("nan"), None, None), ("date", None, None, "2020-01-01 00:00:00", None), ("false", False, None, None, None)]
    df = spark.createDataFrame(rows, "name string, b boolean, n double, t string, s string")
    key = mixed_key(F.col("b"), F.col("n"), F.col("t").cast("timestamp"), F.col("s"))
    return _numbered(df.select("name", key.alias("k")), "k").select("name", F.col("pos").cast("int").alias("pos"))


@query("SELECT * FROM (VALUES ('10', 0), ('9', 1), ('null', 0), ('-1', -1)) t(name, pos)")
def alternative_orders(spark, sf):
    arrays = spark.createDataFrame([("9", [9]), ("10", [10])], "name string, k array<int>")
    text = _numbered(arrays.select("name", joined_text_key(F.col("k")).alias("k")), "k").select("name", F.col("pos").cast("int").alias("pos"))
    nulls = spark.createDataFrame([("null", None), ("-1", -1)], "name string, k int")
    return text.unionByName(nulls.select("name", null_as_zero(F.col("k")).alias("pos")))


# lookups -------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def get_one(spark, sf):
    t = _orders(spark, sf)
    found = t.get(77)
    return spark.createDataFrame([found] if found else [], t.df.schema)


@query("SELECT c.o_orderkey, coalesce(o.o_totalprice, -1.0) AS o_totalprice, o.o_orderkey IS NOT NULL AS found FROM (SELECT c_custkey * 13 AS o_orderkey FROM customer) c LEFT JOIN orders o USING (o_orderkey)")
def get_batch(spark, sf):
    probes = read(spark, sf, "customer").select((F.col("c_custkey") * 13).alias("o_orderkey"))
    return _orders(spark, sf).get_batch(probes, "o_totalprice", -1.0)


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def has_batch(spark, sf):
    placed = SortedTable(read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey")
    return placed.has_batch(read(spark, sf, "customer").select("c_custkey"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def missing_keys(spark, sf):
    placed = SortedTable(read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey")
    return placed.missing(read(spark, sf, "customer").select("c_custkey"))


@query("SELECT count(*) AS n, count(*) = 0 AS empty FROM orders")
def size(spark, sf):
    t = _orders(spark, sf)
    return spark.createDataFrame([(t.size(), t.is_empty())], "n long, empty boolean")


@query("SELECT 'min' AS edge, min(o_orderkey) AS o_orderkey FROM orders UNION ALL SELECT 'max', max(o_orderkey) FROM orders")
def min_max_key(spark, sf):
    t = _orders(spark, sf)
    return t.min_key().select(F.lit("min").alias("edge"), "o_orderkey").unionByName(t.max_key().select(F.lit("max").alias("edge"), "o_orderkey"))


@query("SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1) UNION ALL SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 1)")
def min_max_pair(spark, sf):
    t = _orders(spark, sf, "o_orderkey", "o_totalprice")
    return t.min_pair().unionByName(t.max_pair())


# neighbours ------------------------------------------------------------------------


@query("SELECT 'lower' AS side, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey < 250 UNION ALL SELECT 'higher', min(o_orderkey) FROM orders WHERE o_orderkey > 250 UNION ALL SELECT 'same_or_lower', max(o_orderkey) FROM orders WHERE o_orderkey <= 250 UNION ALL SELECT 'same_or_higher', min(o_orderkey) FROM orders WHERE o_orderkey >= 250 UNION ALL SELECT 'highest', max(o_orderkey) FROM orders UNION ALL SELECT 'lowest', min(o_orderkey) FROM orders")
def nearest_constant(spark, sf):
    t = _orders(spark, sf)
    found = {"lower": t.next_lower_key(250), "higher": t.next_higher_key(250), "same_or_lower": t.get_pair_or_next_lower(250), "same_or_higher": t.get_pair_or_next_higher(250), "highest": t.next_lower_key(), "lowest": t.next_higher_key()}
    out = None
    for side, df in found.items():
        df = df.select(F.lit(side).alias("side"), "o_orderkey")
        out = df if out is None else out.unionByName(df)
    return out


def _asof(spark, sf, direction: str, strict: bool) -> DataFrame:
    orders = read(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    spec = KeySpec.of("o_custkey", "o_orderdate")
    table = SortedTable.from_pairs(orders, spec, F.col("o_orderkey"))
    probes = orders.select(F.col("o_orderkey").alias("probe"), "o_custkey", F.col("o_orderdate").alias("at"))
    return table.asof(probes, "o_orderdate", "at", ["o_custkey"], ["o_orderkey"], direction, strict)


def _asof_sql(op: str) -> str:
    return f"WITH t AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) SELECT p.o_orderkey AS probe, p.o_custkey, p.o_orderdate AS at, t.o_orderdate AS matched_o_orderdate, t.o_orderkey FROM orders p ASOF LEFT JOIN t ON p.o_custkey = t.o_custkey AND p.o_orderdate {op} t.o_orderdate"


@query(_asof_sql(">"))
def next_lower(spark, sf):
    return _asof(spark, sf, "lower", True)


@query(_asof_sql("<"))
def next_higher(spark, sf):
    return _asof(spark, sf, "higher", True)


@query(_asof_sql(">="))
def or_next_lower(spark, sf):
    return _asof(spark, sf, "lower", False)


@query(_asof_sql("<="))
def or_next_higher(spark, sf):
    return _asof(spark, sf, "higher", False)


_BUSY = "WITH t AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0), p AS (SELECT o_orderkey AS probe, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END AS g, o_orderkey AS at FROM orders) SELECT p.probe, p.g, t.o_orderkey AS matched_k, t.o_totalprice FROM p ASOF LEFT JOIN (SELECT CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END AS g, o_orderkey, o_totalprice FROM t) t ON p.g = t.g AND p.probe > t.o_orderkey"


@query(_BUSY)
def busy_next_lower(spark, sf):
    """One group has a third of all rows and is swept by many tasks."""
    g = F.when(F.col("o_custkey") % 3 == 0, 0).otherwise(F.col("o_custkey")).alias("g")
    orders = read(spark, sf, "orders")
    table = SortedTable(orders.filter("o_orderkey % 2 = 0").select(g, F.col("o_orderkey").alias("k"), "o_totalprice"), KeySpec.of("g", "k"))
    return table.asof(orders.select(F.col("o_orderkey").alias("probe"), g), "k", "probe", ["g"], ["o_totalprice"], "lower", True, skewed=True)


@query("WITH t AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') SELECT e.event_id, e.user_id, e.ts AS at, t.ts AS matched_ts, t.value FROM events e ASOF LEFT JOIN t ON e.user_id = t.user_id AND e.ts >= t.ts")
def last_purchase(spark, sf):
    events = read(spark, sf, "events")
    table = SortedTable(events.filter(F.col("event_type") == "purchase").select("user_id", "ts", "value"), KeySpec.of("user_id", "ts"))
    return table.asof(events.select("event_id", "user_id", F.col("ts").alias("at")), "ts", "at", ["user_id"], ["value"], "lower", False)


def _global(spark, sf, direction: str, strict: bool) -> DataFrame:
    table = SortedTable(read(spark, sf, "orders").select(F.col("o_orderkey").cast("double").alias("k"), "o_totalprice"), "k")
    probes = read(spark, sf, "events").select("event_id", (F.col("event_id") * 1.5 - 10).alias("at"))
    return table.asof(probes, "k", "at", [], ["o_totalprice"], direction, strict)


def _global_sql(op: str) -> str:
    return f"SELECT p.event_id, p.at, t.k AS matched_k, t.o_totalprice FROM (SELECT event_id, event_id::DOUBLE * 1.5 - 10 AS at FROM events) p ASOF LEFT JOIN (SELECT o_orderkey::DOUBLE AS k, o_totalprice FROM orders) t ON p.at {op} t.k"


@query(_global_sql(">="))
def global_or_next_lower(spark, sf):
    return _global(spark, sf, "lower", False)


@query(_global_sql("<"))
def global_next_higher(spark, sf):
    return _global(spark, sf, "higher", True)


# edits -----------------------------------------------------------------------------

_ITEM_ORDER = ", ".join(f"{c} DESC" for c in ITEM_SEQ)


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ITEM_ORDER}) = 1")
def set_pairs(spark, sf):
    items = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *ITEM_SEQ)
    return SortedTable.from_pairs(items, ITEM_KEY, [F.col(c) for c in ITEM_SEQ]).df.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(ITEM_SEQ)}) = 1")
def set_pairs_first_wins(spark, sf):
    items = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *ITEM_SEQ)
    return SortedTable.from_pairs(items, ITEM_KEY, [F.col(c) for c in ITEM_SEQ], overwrite=False).df.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def _changes(spark, sf) -> DataFrame:
    return read(spark, sf, "orders").select((F.col("o_orderkey") * 3).alias("o_orderkey"), (F.col("o_totalprice") * 2).alias("o_totalprice"))


_CHANGES = "(SELECT o_orderkey * 3 AS o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders)"


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_CHANGES}) UNION ALL SELECT * FROM {_CHANGES}")
def upsert(spark, sf):
    return _orders(spark, sf, "o_orderkey", "o_totalprice").set_pairs(_changes(spark, sf), F.lit(0)).df


@query(f"SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT * FROM {_CHANGES} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def set_if_not_present(spark, sf):
    return _orders(spark, sf, "o_orderkey", "o_totalprice").set_pairs(_changes(spark, sf), F.lit(0), overwrite=False).df


@query(f"SELECT count(*) AS n FROM {_CHANGES} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def added_count(spark, sf):
    return _orders(spark, sf, "o_orderkey", "o_totalprice").added(_changes(spark, sf))


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 2, 'changed' UNION ALL SELECT 9, 'new'")
def set_one(spark, sf):
    t = SortedTable(read(spark, sf, "region"), "r_regionkey")
    return t.set({"r_regionkey": 2, "r_name": "changed"}).set({"r_regionkey": 9, "r_name": "new"}).set_if_not_present({"r_regionkey": 1, "r_name": "ignored"}).df


@query(f"SELECT o.o_orderkey, coalesce(c.o_totalprice, o.o_totalprice) AS o_totalprice FROM orders o LEFT JOIN {_CHANGES} c USING (o_orderkey)")
def change_if_present(spark, sf):
    return _orders(spark, sf, "o_orderkey", "o_totalprice").change_if_present(_changes(spark, sf)).df


@query("SELECT o_orderkey FROM orders WHERE o_orderkey <> 10")
def delete_one(spark, sf):
    return _orders(spark, sf, "o_orderkey").delete(10).df


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey * 5 FROM customer)")
def delete_keys(spark, sf):
    return _orders(spark, sf, "o_orderkey").delete_keys(read(spark, sf, "customer").select((F.col("c_custkey") * 5).alias("o_orderkey"))).df


@query("SELECT count(*) AS n FROM orders WHERE o_orderkey IN (SELECT c_custkey * 5 FROM customer)")
def deleted_count(spark, sf):
    keys = read(spark, sf, "customer").select((F.col("c_custkey") * 5).alias("o_orderkey"))
    return _orders(spark, sf, "o_orderkey").removed(keys.unionByName(keys))


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderkey >= 50 AND o_orderkey <= 900)")
def delete_range(spark, sf):
    return _orders(spark, sf, "o_orderkey").delete_range(50, 900, include_high=True).df


@query("SELECT o_orderkey FROM orders WHERE false")
def clear(spark, sf):
    return _orders(spark, sf, "o_orderkey").clear().df


def _edit() -> Rule:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    return Rule(set={"o_totalprice": price + 1}, when=F.col("o_custkey") % 2 == 0, delete=k % 5 == 0, stop=(k > 1000) & (price > 150000))


_STOP_SQL = "WITH s AS (SELECT min(o_orderkey) k FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 2000 AND o_orderkey > 1000 AND o_totalprice > 150000), o AS (SELECT o.*, o_orderkey >= 100 AND o_orderkey < 2000 AND (s.k IS NULL OR o_orderkey <= s.k) AS active FROM orders o, s) "


@query(_STOP_SQL + "SELECT o_orderkey, o_custkey, CASE WHEN active AND o_custkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM o WHERE NOT (active AND o_orderkey % 5 = 0)")
def edit_range(spark, sf):
    return _orders(spark, sf).edit_range(100, 2000, False, _edit()).df


@query(_STOP_SQL + "SELECT count(*) AS n FROM o WHERE active")
def edit_range_scanned(spark, sf):
    return _orders(spark, sf).edit_range_count(100, 2000, False, _edit())


@query("SELECT o_orderkey, o_custkey, o_totalprice + c AS o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS c FROM orders) WHERE c % 3 <> 0")
def edit_all_counter(spark, sf):
    rule = Rule(set={"o_totalprice": F.col("o_totalprice") + F.col("counter")}, delete=F.col("counter") % 3 == 0, uses_counter=True)
    return _orders(spark, sf).edit_all(rule).df


# persistent forms ----------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT DISTINCT c_custkey * 50, NULL::DOUBLE FROM customer WHERE c_custkey * 50 NOT IN (SELECT o_orderkey FROM orders)")
def with_keys(spark, sf):
    return _orders(spark, sf, "o_orderkey", "o_totalprice").with_keys(read(spark, sf, "customer").select((F.col("c_custkey") * 50).alias("o_orderkey"))).df


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)")
def without_keys(spark, sf):
    return _orders(spark, sf, "o_orderkey").freeze().without_keys(read(spark, sf, "customer").select(F.col("c_custkey").alias("o_orderkey"))).df


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderkey >= 10 AND o_orderkey < 700)")
def without_range(spark, sf):
    return _orders(spark, sf, "o_orderkey").without_range(10, 700).df


@query("SELECT p_partkey, p_size FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS c FROM part) WHERE c % 2 = 1 AND p_size > 10")
def filter_counter(spark, sf):
    t = SortedTable(read(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    return t.filter((F.col("c") % 2 == 1) & (F.col("p_size") > 10), counter="c").df


@query("SELECT p_partkey, upper(p_brand) AS brand, p_size * 2 AS doubled FROM part")
def map_values(spark, sf):
    t = SortedTable(read(spark, sf, "part"), "p_partkey")
    return t.map_values(brand=F.upper("p_brand"), doubled=F.col("p_size") * 2).df


@query("SELECT sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, min(o_totalprice) AS lowest, max(o_totalprice) AS highest, count(*) AS n FROM orders")
def reduce_sum(spark, sf):
    x = F.col("o_totalprice")
    return _orders(spark, sf).reduce(total=F.sum(x.cast("decimal(18,2)")).cast("double"), lowest=F.min(x), highest=F.max(x), n=F.count(F.lit(1)))


@query("SELECT o_custkey, list_reduce(list_prepend(7::BIGINT, list(round(o_totalprice * 100)::BIGINT ORDER BY o_orderkey)), lambda a, x: (a * 31 + x) % 1000003) AS value FROM orders GROUP BY o_custkey")
def reduce_ordered(spark, sf):
    cents = lambda x: F.round(x["o_totalprice"] * 100).cast("bigint")
    return _orders(spark, sf).reduce_ordered(F.lit(7).cast("bigint"), lambda acc, x: (acc * 31 + cents(x)) % 1000003, by=["o_custkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0")
def keyed_intersect(spark, sf):
    t = _orders(spark, sf, "o_orderkey")
    return t.filter(F.col("o_orderkey") % 2 == 0).intersect(t.filter(F.col("o_orderkey") % 3 == 0)).df


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def keyed_union(spark, sf):
    t = _orders(spark, sf, "o_orderkey")
    return t.filter(F.col("o_orderkey") % 2 == 0).union_keep(t.filter(F.col("o_orderkey") % 3 == 0)).df


@query("SELECT o_orderkey, o_totalprice FROM orders")
def greedy_clone(spark, sf):
    return _orders(spark, sf, "o_orderkey", "o_totalprice").greedy_clone().df


# diff and audit -------------------------------------------------------------------------


def _versions(spark, sf) -> tuple[SortedTable, SortedTable]:
    t = _orders(spark, sf, "o_orderkey", "o_totalprice")
    k = F.col("o_orderkey")
    b = t.filter(k % 5 != 0).map_values(o_totalprice=F.when(k % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return t.filter(k % 7 != 0), b


_DIFF = "SELECT * FROM (SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b' WHEN a.v IS DISTINCT FROM b.v THEN 'different' END AS status, a.v AS a_o_totalprice, b.v AS b_o_totalprice FROM (SELECT o_orderkey k, o_totalprice v FROM orders WHERE o_orderkey % 7 <> 0) a FULL JOIN (SELECT o_orderkey k, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END v FROM orders WHERE o_orderkey % 5 <> 0) b ON a.k = b.k) WHERE status IS NOT NULL"


@query(_DIFF)
def diff(spark, sf):
    a, b = _versions(spark, sf)
    return a.diff_against(b)


@query(_DIFF + " AND status = 'only_a'")
def diff_only_a(spark, sf):
    a, b = _versions(spark, sf)
    return a.diff_against(b, only_b=False, different=False)


@query(_DIFF + " AND status = 'only_b'")
def diff_only_b(spark, sf):
    a, b = _versions(spark, sf)
    return a.diff_against(b, only_a=False, different=False)


@query(_DIFF + " AND status = 'different'")
def diff_changed(spark, sf):
    a, b = _versions(spark, sf)
    return a.diff_against(b, only_a=False, only_b=False)


@query(_DIFF)
def diff_digest(spark, sf):
    a, b = _versions(spark, sf)
    return a.diff_digest(b, F.floor(F.col("o_orderkey") / 1000))


@query(_DIFF)
def diff_stored_digest(spark, sf):
    """Digests of both snapshots are written once; the diff then reads only buckets that moved."""
    a, b = _versions(spark, sf)
    bucket = F.floor(F.col("o_orderkey") / 1000)
    return a.diff_digest(b, bucket, materialize(a.digest(bucket), "digest"), materialize(b.digest(bucket), "digest"))


@query(_DIFF + " ORDER BY o_orderkey DESC LIMIT 1")
def diff_first(spark, sf):
    a, b = _versions(spark, sf)
    return a.diff_first(b)


@query("SELECT 'orders' AS name, count(*) AS size, 0::BIGINT AS repeated_keys, 0::BIGINT AS null_keys FROM orders UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), count(*), 0 FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def check_valid(spark, sf):
    orders = audit(_orders(spark, sf).df, ORDER_KEY).select(F.lit("orders").alias("name"), "*")
    return orders.unionByName(audit(read(spark, sf, "lineitem"), ITEM_KEY).select(F.lit("lineitem").alias("name"), "*"))


# what the table answers or refuses ---------------------------------------------------------


_PRICES = ("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, CASE WHEN o_orderkey = 7 THEN -1.0 ELSE o_totalprice END AS o_totalprice FROM orders UNION ALL SELECT -5, 0.5")
def with_one(spark, sf):
    frozen = _orders(spark, sf, *_PRICES).freeze()
    out = frozen.with_({"o_orderkey": 7, "o_totalprice": -1.0}).with_({"o_orderkey": -5, "o_totalprice": 0.5})
    return out.with_({"o_orderkey": -5, "o_totalprice": 9.0}, overwrite=False).df


@query("SELECT 'clone' AS name, o_orderkey FROM orders UNION ALL SELECT 'edited', o_orderkey FROM orders WHERE o_orderkey >= 1000")
def clone_independence(spark, sf):
    t = _orders(spark, sf, "o_orderkey")
    copy, edited = t.clone(), t.delete_range(None, 1000)
    return copy.df.select(F.lit("clone").alias("name"), "o_orderkey").unionByName(edited.df.select(F.lit("edited").alias("name"), "o_orderkey"))


@query("SELECT * FROM (VALUES ('frozen', true, true), ('clone', false, false), ('unfrozen', false, false), ('edited', false, false)) s(name, frozen, refused), (SELECT count(*) AS n FROM orders)")
def freezing(spark, sf):
    def row(name: str, t: SortedTable) -> tuple:
        try:
            t.delete_range(None, 10)
        except FrozenError:
            return name, t.is_frozen, True, t.size()
        return name, t.is_frozen, False, t.size()

    t = _orders(spark, sf, "o_orderkey").freeze()
    rows = [row("frozen", t), row("clone", t.clone()), row("edited", t.without(-1))]
    return spark.createDataFrame([*rows, row("unfrozen", t.unfreeze())], "name string, frozen boolean, refused boolean, n long")


@query("SELECT 0::BIGINT AS n, true AS empty, true AS frozen, min(o_orderkey) AS o_orderkey, min(o_totalprice) AS o_totalprice FROM orders")
def empty_table(spark, sf):
    full = _orders(spark, sf, *_PRICES)
    t = SortedTable.empty(spark, full.df.schema, ORDER_KEY)
    first = t.with_pairs(full.df, F.col("o_orderkey")).min_pair().select("o_orderkey")
    lowest = full.reduce(o_totalprice=F.min("o_totalprice"))
    return first.join(F.broadcast(lowest), F.lit(True)).select(F.lit(t.size()).cast("bigint").alias("n"), F.lit(t.is_empty()).alias("empty"), F.lit(t.is_frozen).alias("frozen"), "*")


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders ORDER BY 1 LIMIT 40")
def iteration(spark, sf):
    """The first rows that the table's iterator hands to the driver, one partition at a time."""
    rows = [(*r, i) for i, r in zip(range(40), _orders(spark, sf, *_PRICES), strict=False)]
    return spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, place long")


@query("SELECT * FROM (VALUES ('new', true), ('old', false), ('gone', true), ('absent', false), ('changed', true), ('unknown', false)) t(step, told)")
def told(spark, sf):
    t = _orders(spark, sf, *_PRICES)
    lowest = t.min_key().first()[0]
    steps = {
        "new": t.set_told({"o_orderkey": -3, "o_totalprice": 1.0}),
        "old": t.set_told({"o_orderkey": lowest, "o_totalprice": 1.0}),
        "gone": t.delete_told(lowest),
        "absent": t.delete_told(-3),
        "changed": t.change_told({"o_orderkey": lowest, "o_totalprice": 1.0}),
        "unknown": t.change_told({"o_orderkey": -3, "o_totalprice": 1.0}),
    }
    return spark.createDataFrame([(k, v) for k, (_, v) in steps.items()], "step string, told boolean")


@query("SELECT CASE WHEN o_orderkey = k THEN -1.0 ELSE o_totalprice END AS o_totalprice, o_orderkey FROM orders, (SELECT min(o_orderkey) AS k FROM orders)")
def change_one(spark, sf):
    t = _orders(spark, sf, *_PRICES)
    return t.change_told({"o_orderkey": t.min_key().first()[0], "o_totalprice": -1.0})[0].change_told({"o_orderkey": -3, "o_totalprice": 1.0})[0].df


@query("SELECT * FROM (VALUES ('without', true), ('with_keys', true), ('without_keys', true), ('without_range', true), ('filter', true), ('removed', false)) t(step, same)")
def same_table(spark, sf):
    t = _orders(spark, sf, *_PRICES)
    some = read(spark, sf, "orders").filter("o_orderkey < 100").select("o_orderkey")
    steps = {
        "without": t.without(-3, same_if_unchanged=True),
        "with_keys": t.with_keys(some, same_if_unchanged=True),
        "without_keys": t.without_keys(some.select((-F.col("o_orderkey") - 1).alias("o_orderkey")), same_if_unchanged=True),
        "without_range": t.without_range(-9, -3, same_if_unchanged=True),
        "filter": t.filter(F.col("o_orderkey") >= 0, same_if_unchanged=True),
        "removed": t.without_keys(some, same_if_unchanged=True),
    }
    return spark.createDataFrame([(k, v is t) for k, v in steps.items()], "step string, same boolean")


@query("SELECT * FROM (VALUES ('right', false), ('wrong size', true), ('repeated keys', true)) t(name, raised)")
def check(spark, sf):
    t = _orders(spark, sf, "o_orderkey", "o_custkey")
    twice = SortedTable(t.df.select(F.col("o_custkey").alias("k")), "k")
    rows = []
    for name, table, expected in (("right", t, t.size()), ("wrong size", t, t.size() + 1), ("repeated keys", twice, None)):
        try:
            table.check_valid(expected)
            rows.append((name, False))
        except (AssertionError, ValueError):
            rows.append((name, True))
    return spark.createDataFrame(rows, "name string, raised boolean")


# keys in another order, NaN, nulls -------------------------------------------------------------


@query("SELECT event_id, row_number() OVER (ORDER BY event_id <> 5, event_id) - 1 AS counter FROM events WHERE event_id = 5 OR event_id <= (SELECT min(event_id) FROM events WHERE event_id > 20)")
def stop_after_nan(spark, sf):
    """NaN is the least key, so it is visited first."""
    k = F.when(F.col("event_id") == 5, F.lit(float("nan"))).otherwise(F.col("event_id") / 2)
    t = SortedTable(read(spark, sf, "events").select("event_id", k.alias("k")), "k")
    return t.for_each(stop=F.col("event_id") > 20).select("event_id", "counter")


@query("SELECT event_id, CASE WHEN event_id = 5 OR event_id <= (SELECT min(event_id) FROM events WHERE event_id > 20) THEN 'seen' ELSE event_type END AS event_type FROM events")
def edit_until_stop_after_nan(spark, sf):
    k = F.when(F.col("event_id") == 5, F.lit(float("nan"))).otherwise(F.col("event_id") / 2)
    t = SortedTable(read(spark, sf, "events").select("event_id", "event_type", k.alias("k")), "k")
    return t.edit_all(Rule(set={"event_type": F.lit("seen")}, stop=F.col("event_id") > 20)).df.select("event_id", "event_type")


@query("WITH s AS (SELECT min(o_orderkey) AS k FROM orders WHERE o_orderkey >= 200 AND o_totalprice > 300000), c AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders, s WHERE o_orderkey >= 200 AND (k IS NULL OR o_orderkey <= k)) SELECT o.o_orderkey, CASE WHEN c.n IS NULL THEN o.o_totalprice ELSE c.n::DOUBLE END AS o_totalprice FROM orders o LEFT JOIN c USING (o_orderkey) WHERE c.n IS NULL OR c.n % 3 <> 1")
def edit_with_counter_until_stop(spark, sf):
    n = F.col("counter")
    rule = Rule(set={"o_totalprice": n.cast("double")}, delete=n % 3 == 1, stop=F.col("o_totalprice") > 300000, uses_counter=True)
    return _orders(spark, sf, *_PRICES).edit_range(200, None, False, rule).df


_DOWN = "SELECT p.event_id, p.at, t.k AS matched_k, t.o_totalprice FROM (SELECT event_id, event_id::DOUBLE * 1.5 - 10 AS at FROM events) p ASOF LEFT JOIN (SELECT o_orderkey::DOUBLE AS k, o_totalprice FROM orders) t ON p.at {op} t.k"


def _descending(spark, sf, direction: str, strict: bool) -> DataFrame:
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").cast("double").alias("k"), "o_totalprice")
    probes = read(spark, sf, "events").select("event_id", (F.col("event_id") * 1.5 - 10).alias("at"))
    return SortedTable(rows, KeySpec.of(Key("k", ascending=False))).asof(probes, "k", "at", [], ["o_totalprice"], direction, strict)


@query(_DOWN.format(op="<"))
def descending_next_lower(spark, sf):
    """What comes before in a descending table has a larger key."""
    return _descending(spark, sf, "lower", True)


@query(_DOWN.format(op=">="))
def descending_or_next_higher(spark, sf):
    return _descending(spark, sf, "higher", False)


@query("WITH t AS (SELECT o_custkey, max(o_totalprice) AS o_totalprice FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1), p AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey::DOUBLE END AS probe, c_custkey % 5 = 0 AS odd FROM customer), e AS (SELECT max(o_custkey) AS hi FROM t) SELECT c_custkey, k::DOUBLE AS matched_k, t.o_totalprice FROM (SELECT c_custkey, CASE WHEN probe IS NULL THEN hi WHEN odd THEN -1 ELSE (SELECT max(o_custkey) FROM t WHERE o_custkey < probe) END AS k FROM p, e) x LEFT JOIN t ON o_custkey = k")
def asof_of_nan_and_null(spark, sf):
    """A null probe is an open end; a NaN probe, told by -1 here, is below all numbers and finds nothing."""
    orders = read(spark, sf, "orders").filter("o_custkey % 3 <> 0").select(F.col("o_custkey").cast("double").alias("k"), "o_totalprice")
    t = SortedTable.from_pairs(orders, "k", F.col("o_totalprice"))
    at = F.when(F.col("c_custkey") % 7 == 0, F.lit(None)).when(F.col("c_custkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("c_custkey"))
    found = t.asof(read(spark, sf, "customer").select("c_custkey", at.cast("double").alias("at")), "k", "at", [], ["o_totalprice"], "lower", True)
    return found.select("c_custkey", F.when(F.isnan("at"), F.lit(-1.0)).otherwise(F.col("matched_k")).alias("matched_k"), "o_totalprice")


@query("SELECT event_id, s.status, s.kind FROM events, (VALUES ('different', 'exact')) s(status, kind) WHERE event_id % 3 = 1 UNION ALL SELECT event_id, 'different', k FROM events, (VALUES ('exact'), ('plain')) s(k) WHERE event_id % 3 = 2")
def diff_of_odd_values(spark, sf):
    """NaN equals NaN; -0.0 differs from 0.0 only if asked for; null differs from a value."""
    events = read(spark, sf, "events").select("event_id")
    third = F.col("event_id") % 3
    side = lambda zero, last: SortedTable(events.select("event_id", F.when(third == 0, F.lit(float("nan"))).when(third == 1, F.lit(zero)).otherwise(F.lit(last)).cast("double").alias("x")), "event_id")
    a, b = side(-0.0, None), side(0.0, 1.0)
    kinds = [a.diff_against(b, exact_zero=exact).select("event_id", "status", F.lit(k).alias("kind")) for k, exact in (("exact", True), ("plain", False))]
    return kinds[0].unionByName(kinds[1])


# Python callbacks ---------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 = 3")
def filter_python(spark, sf):
    return _orders(spark, sf, *_PRICES).filter_with(lambda b: b["o_orderkey"] % 7 == 3).df


@query("SELECT o_orderkey, o_custkey * 2 + 1 AS x FROM orders")
def map_values_python(spark, sf):
    return _orders(spark, sf).map_values_with(lambda b: (b[["o_custkey"]] * 2 + 1).rename(columns={"o_custkey": "x"}), "x long").df


@query("WITH s AS (SELECT min(o_orderkey) AS k FROM orders WHERE o_orderkey >= 200 AND o_totalprice > 300000) SELECT o_orderkey, CASE WHEN o_orderkey >= 200 AND (k IS NULL OR o_orderkey <= k) THEN -o_totalprice ELSE o_totalprice END AS o_totalprice FROM orders, s WHERE NOT (o_orderkey >= 200 AND (k IS NULL OR o_orderkey <= k) AND o_orderkey % 2 = 0)")
def edit_range_python(spark, sf):
    return _orders(spark, sf, *_PRICES).edit_range_with(200, None, False, lambda b: b.assign(_delete=b["o_orderkey"] % 2 == 0, _stop=b["o_totalprice"] > 300000, o_totalprice=-b["o_totalprice"])).df
