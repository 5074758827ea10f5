"""SortedTable against a dict, and its edges."""

import bisect
import math
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from tideline import Key, KeySpec, SortedTable, storage
from tideline.functions import joined_text_key, mixed_key
from tideline.operators.audit import InvalidTable
from tideline.operators.edit import Rule
from tideline.sources import read_table, write_table
from tideline.storage import materialize, shared_dir
from tideline.table import FrozenError


def table(spark, model, keys="k"):
    return SortedTable(spark.createDataFrame(sorted(model.items()), "k int, v int"), keys)


def pairs(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_edits_equal_a_dict(spark, seed):
    rng = random.Random(seed)
    model = {rng.randrange(60): rng.randrange(100) for _ in range(30)}
    t = table(spark, model)
    for step in range(8):
        low, high = sorted((rng.randrange(60), rng.randrange(60)))
        kind = step % 4
        if kind == 0:
            new = [(rng.randrange(60), rng.randrange(100), n) for n in range(12)]
            over = rng.random() < 0.5
            change = spark.createDataFrame(new, "k int, v int, n int")
            t = t.set_pairs(change, F.col("n"), overwrite=over)
            for k, v, _ in new:
                if over or k not in model:
                    model[k] = v
        elif kind == 1:
            inc = rng.random() < 0.5
            t = t.delete_range(low, high, inc)
            model = {k: v for k, v in model.items() if not (low <= k < high or inc and k == high)}
        elif kind == 2:
            rule = Rule(set={"v": F.col("v") + 1}, when=F.col("k") % 2 == 0, delete=F.col("k") % 7 == 0, stop=F.col("k") % 5 == 4)
            stop = min((k for k in model if low <= k < high and k % 5 == 4), default=high)
            t = t.edit_range(low, high, False, rule)
            seen = {k for k in model if low <= k < high and k <= stop}
            model = {k: v + 1 if v is not None and k in seen and k % 2 == 0 else v for k, v in model.items() if not (k in seen and k % 7 == 0)}
        else:
            t = t.with_keys(spark.createDataFrame([(low,), (low,), (high,)], "k int"))
            model = {low: None, high: None} | model
        t = SortedTable(materialize(t.df, "step"), "k")
        t.check_valid(len(model))
        assert pairs(t.entries()) == sorted(model.items())
    keys = sorted(model)
    for probe in (-1, keys[0], keys[len(keys) // 2], keys[-1], 99):
        assert [r.k for r in t.next_lower_key(probe).collect()] == [k for k in keys if k < probe][-1:]
        assert [r.k for r in t.next_higher_key(probe).collect()] == [k for k in keys if k > probe][:1]
        assert [r.k for r in t.get_pair_or_next_lower(probe).collect()] == [k for k in keys if k <= probe][-1:]
        assert [r.k for r in t.get_pair_or_next_higher(probe).collect()] == [k for k in keys if k >= probe][:1]


def test_empty_table(spark):
    t = SortedTable.empty(spark, spark.createDataFrame([], "k int, v int").schema, "k")
    assert t.is_frozen and t.is_empty() and t.size() == 0
    assert pairs(t.min_key()) == [] and pairs(t.next_higher_key()) == [] and pairs(t.to_array()) == []
    assert pairs(t.reduce(n=F.count(F.lit(1)))) == [(0,)]
    one = table(spark, {1: 2})
    assert pairs(one.diff_against(t)) == [(1, "only_a", 2, None)] and pairs(t.diff_against(t)) == []
    assert pairs(t.for_each()) == []


def test_bounds_of_one_row(spark):
    t = table(spark, {5: 1})
    assert t.get_range(5, 5).count() == 0 and t.get_range(5, 5, True).count() == 1
    assert pairs(t.count_range(9, 1)) == [(0,)]
    assert t.get(5).v == 1 and t.get(9, "none") == "none" and t.get(4, "none") == "none"
    assert t.has(5) and not t.has(6)


def test_limits_and_counters(spark):
    t = table(spark, {k: k for k in range(20)})
    assert len(pairs(t.get_range(3, 15, max_length=4))) == 4
    assert [r.counter for r in t.for_range(3, 8, initial=10).orderBy("k").collect()] == [10, 11, 12, 13, 14]
    assert [r.k for r in t.for_each(stop=F.col("k") % 7 == 6).orderBy("k").collect()] == list(range(7))
    assert [r.k for r in t.for_each(stop=F.col("k") > 99).orderBy("k").collect()] == list(range(20))
    assert [r.k for r in t] == list(range(20))
    assert [r.k for r in t.entries_reversed(10, skip_highest=True).collect()] == list(range(9, -1, -1))
    assert [r.k for r in t.entries_reversed(skip_highest=True).collect()][0] == 19


def test_float_keys(spark):
    rows = [(x, i) for i, x in enumerate([math.inf, None, math.nan, 0.0, -math.inf, -1.0])]
    spec = KeySpec.of("k", allow_null=True)
    t = SortedTable(spark.createDataFrame(rows, "k double, v int"), spec)
    order = [r.v for r in t.entries().collect()]
    assert order == [2, 4, 5, 3, 0, 1]
    assert [r.v for r in t.entries(-1.0).collect()] == [5, 3, 0, 1]
    assert [r.v for r in t.get_pair_or_next_lower(-math.inf).collect()] == [4]
    assert [r.v for r in t.next_lower_pair(-math.inf).collect()] == [2]
    assert t.has(-0.0) and t.get(math.nan).v == 2
    with pytest.raises(InvalidTable):
        SortedTable(t.df, "k").check_valid()


def test_composite_and_descending_keys(spark):
    rows = [(a, b) for a in "xyz" for b in (1, 2, 3)]
    spec = KeySpec.of("a", Key("b", ascending=False))
    t = SortedTable(spark.createDataFrame(rows, "a string, b int"), spec)
    want = sorted(rows, key=lambda r: (r[0], -r[1]))
    assert pairs(t.entries()) == want
    assert pairs(t.get_range(("x", 2), ("y", 2))) == want[1:4]
    assert pairs(t.next_lower_pair(("y", 3))) == [("x", 1)]
    down = SortedTable(spark.range(6).withColumnRenamed("id", "k"), KeySpec.of(Key("k", ascending=False)))
    assert [r.k for r in down.get_range(4, 1).collect()] == [4, 3, 2]
    assert [r.k for r in down.delete_range(4, 2, True).entries().collect()] == [5, 1, 0]


def test_frozen_tables_refuse_every_mutation(spark):
    t = table(spark, {1: 1, 2: 2}).freeze()
    some = spark.createDataFrame([(1, 5)], "k int, v int")
    for act in (lambda: t.set({"k": 3, "v": 3}), lambda: t.add({"k": 3, "v": 3}), lambda: t.clear(), lambda: t.delete(1), lambda: t.delete_keys(some), lambda: t.delete_range(0, 9), lambda: t.edit_all(Rule()), lambda: t.set_pairs(some, F.lit(0)), lambda: t.change_if_present(some), lambda: t.set_if_not_present({"k": 1, "v": 2})):
        with pytest.raises(FrozenError):
            act()
    assert not t.without(1).is_frozen and t.without(1).size() == 1
    assert t.with_({"k": 1, "v": 9}).get(1).v == 9  # overwrites unless told otherwise
    assert t.with_({"k": 1, "v": 9}, overwrite=False).get(1).v == 1
    assert t.unfreeze().delete(1).size() == 1
    assert not t.clone().is_frozen


def test_same_table_when_nothing_changes(spark):
    t = table(spark, {1: 1, 2: 2})
    none = spark.createDataFrame([(9,)], "k int")
    assert t.without_keys(none, same_if_unchanged=True) is t
    assert t.without_range(5, 9, same_if_unchanged=True) is t
    assert t.filter(F.col("v") > 0, same_if_unchanged=True) is t
    assert t.filter(F.col("v") > 1, same_if_unchanged=True) is not t


def test_diff_of_odd_values(spark):
    a = SortedTable(spark.createDataFrame([(1, math.nan), (2, -0.0), (3, None), (4, 1.0)], "k int, v double"), "k")
    b = SortedTable(spark.createDataFrame([(1, math.nan), (2, 0.0), (3, None), (4, None)], "k int, v double"), "k")
    assert [r.k for r in a.diff_against(b).collect()] == [4]
    assert sorted(r.k for r in a.diff_against(b, exact_zero=True).collect()) == [2, 4]
    assert pairs(a.diff_digest(b, F.floor(F.col("k") / 2)).select("k", "status")) == [(4, "different")]
    keys = lambda *k: SortedTable(spark.createDataFrame([(x,) for x in k], "k int"), "k")
    assert sorted(pairs(keys(1, 2, 4).diff_against(keys(2, 3)))) == [(1, "only_a"), (3, "only_b"), (4, "only_a")]
    with pytest.raises(ValueError):
        a.diff_against(SortedTable(b.df, KeySpec.of(Key("k", ascending=False))))


def test_specs_reject_what_has_no_order(spark):
    df = spark.sql("SELECT map('a', 1) AS m, 1 AS k")
    with pytest.raises(TypeError):
        SortedTable(df, "m")
    with pytest.raises(ValueError):
        SortedTable(df, "absent")
    with pytest.raises(ValueError):
        KeySpec.of().validate(df)


def test_audit_finds_repeated_keys(spark):
    with pytest.raises(InvalidTable):
        SortedTable(spark.createDataFrame([(1, 1), (1, 2)], "k int, v int"), "k").check_valid()
    with pytest.raises(InvalidTable):
        table(spark, {1: 1}).check_valid(expected_size=2)


def test_other_key_orders(spark):
    df = spark.createDataFrame([([10],), ([9],)], "k array<int>")
    assert [r.k for r in df.orderBy(joined_text_key(F.col("k"))).collect()] == [[10], [9]]
    assert [r.k for r in df.orderBy("k").collect()] == [[9], [10]]
    rank = mixed_key(number=F.col("n"), text=F.col("s"))
    rows = spark.createDataFrame([(None, "5"), (7.0, None), (None, None)], "n double, s string")
    assert [(r.n, r.s) for r in rows.orderBy(rank).collect()] == [(7.0, None), (None, None), (None, "5")]


def test_files_round_trip_and_ranges_reach_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    write_table(table(spark, {k: k * k for k in range(1000)}), path, files=4)
    t = read_table(spark, path, "k")
    assert t.size() == 1000
    plan = t.get_range(100, 110)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,100)" in plan and "LessThan(k,110)" in plan


def test_counter_keeps_rows_spread(spark):
    t = table(spark, {k: k for k in range(500)})
    out = t.for_each()
    assert [r.counter for r in out.orderBy("k").collect()] == list(range(500))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # the counts of the partitions


def test_intermediate_tables_go_to_the_shared_folder(spark):
    df = materialize(spark.range(3), "probe")
    assert all(shared_dir(spark).removeprefix("file://") in f for f in df.inputFiles())


def test_stream_upserts(spark, tmp_path):
    from tideline.streaming import read_version, upsert_stream

    src = f"{tmp_path}/src"
    spec = KeySpec.of("k")
    for n, rows in enumerate([[(1, 10, 1), (2, 20, 1)], [(2, 21, 2), (3, 30, 2)]]):
        spark.createDataFrame(rows, "k int, v int, n int").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("k int, v int, n int").parquet(src)
        upsert_stream(stream, spec, F.col("n"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted(pairs(read_version(spark, f"{tmp_path}/out", 1).select("k", "v"))) == [(1, 10), (2, 21), (3, 30)]


def test_batch_neighbours_follow_the_key_order(spark):
    """Each probe of a batch finds what the constant lookup finds, in both directions, with NaN and without ``by``."""
    nan = float("nan")
    rows = [(0, nan, 10), (0, -1.0, 11), (0, 0.0, 12), (0, 5.0, 13), (1, 2.0, 14)]
    probes = [(i, g, x) for i, (g, x) in enumerate((g, x) for g in (0, 1) for x in (nan, -2.0, -1.0, -0.0, 0.5, 5.0, 9.0, None))]
    p = spark.createDataFrame(probes, "i int, g int, at double")
    for up in (True, False):
        for lower in (True, False):
            for strict in (True, False):
                for by, skewed in (([], False), (["g"], False), (["g"], True)):
                    keys = [*by, "k"]
                    spec = KeySpec.of(*by, Key("k", ascending=up))
                    t = SortedTable(spark.createDataFrame(rows if by else rows[:4], "g int, k double, v int"), spec)
                    got = {r.i: r.v for r in t.asof(p, "k", "at", by, ["v"], "lower" if lower else "higher", strict, skewed).collect()}
                    held = rows if by else rows[:4]
                    for i, g, x in probes:
                        assert got[i] == _constant(held, g if by else None, x, up, lower, strict), (up, lower, strict, by, g, x)
                    one = SortedTable(t.df.filter("g = 0"), KeySpec.of(Key("k", ascending=up)))
                    find = {(True, True): one.next_lower_pair, (False, True): one.next_higher_pair, (True, False): one.get_pair_or_next_lower, (False, False): one.get_pair_or_next_higher}[(lower, strict)]
                    row = find(0.5).first()
                    assert (row.v if row else None) == _constant(rows, 0, 0.5, up, lower, strict)


def _constant(rows, g, x, up, lower, strict):
    rank = lambda k: (k == k, 0.0 if k != k else k + 0.0)
    own = sorted(((rank(k), v) for h, k, v in rows if g is None or h == g), reverse=not up)
    if not lower:
        own = own[::-1]
    if x is None:
        return own[-1][1]
    before = (lambda a, b: a < b) if up == lower else (lambda a, b: a > b)
    fit = [v for k, v in own if before(k, rank(x)) or (not strict and k == rank(x))]
    return fit[-1] if fit else None


def _neighbours_in_linear_time(spark, up, lower, strict):
    """Wide gaps, so that whole partitions hold no table row; no frame may end with its partition, as Spark reads such a frame once for each row."""
    keys = [float(k) for k in (*range(0, 300, 3), *range(20_000, 20_300, 3))]
    t = SortedTable(spark.createDataFrame([(k, int(k)) for k in keys], "k double, v int"), KeySpec.of(Key("k", ascending=up)))
    probes = [(i, i - 5.0) for i in range(20_400)]
    out = t.asof(spark.createDataFrame(probes, "i int, at double"), "k", "at", [], ["v"], "lower" if lower else "higher", strict)
    assert "unboundedfollowing" not in out._jdf.queryExecution().analyzed().toString().lower()
    got = {r.i: r.v for r in out.collect()}
    if up == lower:
        want = {i: bisect.bisect_left(keys, x) if strict else bisect.bisect_right(keys, x) for i, x in probes}
        assert got == {i: keys[n - 1] if n else None for i, n in want.items()}
    else:
        want = {i: bisect.bisect_right(keys, x) if strict else bisect.bisect_left(keys, x) for i, x in probes}
        assert got == {i: keys[n] if n < len(keys) else None for i, n in want.items()}


@pytest.mark.parametrize("strict", [True, False])
def test_neighbours_after_in_a_descending_table_take_linear_time(spark, strict):
    _neighbours_in_linear_time(spark, False, False, strict)


@pytest.mark.parametrize("strict", [True, False])
def test_neighbours_after_in_an_ascending_table_take_linear_time(spark, strict):
    _neighbours_in_linear_time(spark, True, False, strict)


@pytest.mark.parametrize("skewed", [True, False])
def test_neighbours_after_within_a_group_take_linear_time(spark, skewed):
    t = SortedTable(spark.range(0, 4000, 4).selectExpr("0 g", "id k", "id v"), KeySpec.of("g", "k"))
    out = t.asof(spark.range(5000).selectExpr("0 g", "id at"), "k", "at", ["g"], ["v"], "higher", True, skewed)
    assert "unboundedfollowing" not in out._jdf.queryExecution().analyzed().toString().lower()
    assert {r.at: r.v for r in out.collect()} == {x: (x // 4 + 1) * 4 if x < 3996 else None for x in range(5000)}


def test_batch_neighbours_where_nulls_are_keys(spark):
    t = SortedTable(spark.createDataFrame([(None, 1), (3, 2), (5, 3)], "k int, v int"), KeySpec.of(Key("k", nulls="first"), allow_null=True))
    p = spark.createDataFrame([(0, None), (1, 4)], "i int, at int")
    assert {r.i: r.v for r in t.asof(p, "k", "at", [], ["v"], "lower", False).collect()} == {0: 1, 1: 2}
    assert {r.i: r.v for r in t.asof(p, "k", "at", [], ["v"], "lower", True).collect()} == {0: None, 1: 2}
    assert {r.i: r.v for r in t.asof(p, "k", "at", [], ["v"], "higher", True).collect()} == {0: 2, 1: 3}


def test_batch_neighbours_of_clashing_names(spark):
    t = SortedTable(spark.createDataFrame([(1, 10)], "k int, v int"), "k")
    p = spark.createDataFrame([(2, 7, 8, 9)], "at int, v int, matched_k int, matched_v int")
    out = t.asof(p, "k", "at", [], ["v"], "lower", True)
    assert out.columns == ["at", "v", "matched_k", "matched_v", "matched_matched_k", "matched_matched_v"]
    assert tuple(out.first()) == (2, 7, 8, 9, 1, 10)


def test_stops_on_float_and_composite_keys(spark):
    nan = float("nan")
    t = SortedTable(spark.createDataFrame([(5.0, 1), (nan, 2), (0.0, 3), (-1.0, 4)], "k double, v int"), "k")
    assert [(r.v, r.counter) for r in t.for_each(stop=F.col("k") == 0).orderBy("counter").collect()] == [(2, 0), (4, 1), (3, 2)]
    assert t.edit_range_count(None, None, False, Rule(stop=F.col("k") == 0)).first().n == 3
    both = SortedTable(spark.createDataFrame([(1, "b", 1), (1, None, 2), (2, "a", 3), (None, "z", 4)], "a int, b string, v int"), KeySpec.of("a", Key("b", ascending=False), allow_null=True))
    got = [r.v for r in both.for_each(stop=F.col("v") == 2).orderBy("counter").collect()]
    assert got == [1, 2]
    assert [r.v for r in both.for_each(stop=F.col("v") == 99).orderBy("counter").collect()] == [1, 2, 3, 4]


def test_python_edits(spark):
    t = SortedTable(spark.createDataFrame([(i, float(i)) for i in range(20)], "k int, v double"), "k")
    out = t.edit_range_with(5, 15, False, lambda b: b.assign(v=b["counter"] * 10.0, _delete=b["k"] == 6, _stop=b["k"] == 9), uses_counter=True)
    assert {r.k: r.v for r in out.df.collect()} == {i: float(i) for i in range(20) if i != 6} | {5: 0.0, 7: 20.0, 8: 30.0, 9: 40.0}
    assert t.without_range(None, None).edit_range_with(None, None, False, lambda b: b.assign(v=0.0)).size() == 0
    with pytest.raises(Exception, match="the rows that it gets"):
        t.edit_range_with(None, None, False, lambda b: b.head(1))


def test_scratch_needs_a_shared_folder_on_a_cluster():
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))


def test_partitions_follow_the_size(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert storage.spread(rows) == least
    assert least < storage.spread(rows, each=10_000) < 1000
    assert storage.spread(rows, each=10, most=500) == 500
    joined = rows.alias("a").join(rows.alias("b"), F.lit(True)).join(rows.alias("c"), F.lit(True)).select("a.l_orderkey")
    assert storage.spread(joined) == least
    assert storage.spread(spark.createDataFrame([(1,)], "k int").union(rows.select("l_linenumber"))) == least


def test_released_scratch_is_gone(spark):
    gone = []
    with storage.released(spark):
        path = storage.scratch_path(spark, "brief")
        storage.on_remove(path, lambda: gone.append(1))
        assert materialize(spark.range(5), "brief", into=path).count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    assert gone == [1]
