"""Engine tests: worked examples, randomized checks against slow oracles, parsing, storage, streaming."""

import json
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold import model
from chronofold.functions import aggregators, generations, parsing, timeutil
from chronofold.operators import filters, rollup, series
from chronofold.plans import metadata, query, routing
from chronofold.sources import lines, store
from chronofold.streaming import ingest

T0 = 1_704_067_200


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, s string, ts bigint, value double")


def points(spark, rows):
    """rows: (metric, tags, ts, value, seq)."""
    raw = spark.createDataFrame([(m, t, ts, "INT" if isinstance(v, int) else "FLOAT", v if isinstance(v, int) else None, None if isinstance(v, int) else float(v), q) for m, t, ts, v, q in rows], "metric string, tags map<string,string>, ts bigint, kind string, int_value bigint, float_value double, write_seq bigint")
    return model.complete(raw)


def slow(rows, agg):
    groups = {}
    for g, s, t, v in rows:
        groups.setdefault(g, {}).setdefault(s, []).append((t, v))
    out = {}
    for g, own in groups.items():
        own = [sorted(p) for p in own.values() if len(p) > 1]
        for x in sorted({t for p in own for t, _ in p}):
            ys = []
            for p in own:
                for (x1, y1), (x2, y2) in zip(p, p[1:]):
                    if x1 <= x <= x2:
                        ys.append(y1 if x == x1 else y2 if x == x2 else y1 + ((y2 - y1) * (x - x1)) / (x2 - x1))
                        break
            if ys:
                out[g, x] = {"sum": sum, "min": min, "max": max, "avg": lambda v: sum(v) / len(v)}[agg](ys)
    return out


def _tied(path, n=3000):
    """Tables whose series have several events in one second, some of them first or last ones; they
    are of one value, as SQL leaves their order open."""
    import shutil

    import duckdb

    path.mkdir()
    shutil.copy("/root/testdata/sf0.001/lineitem.parquet", path / "lineitem.parquet")
    duckdb.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds((i // 36 * 7919) % 41 * 50000 + i % 36 * 7) AS ts, (i % 12)::BIGINT AS user_id,
      (['click', 'view', 'scroll'])[1 + (i // 12) % 3] AS event_type, round(((i % 36 * 41 + i // 36 % 41) * 31337 % 10007) / 100.0, 2) AS value, '{{"k": 1}}' AS props FROM range({n}) t(i)) TO '{path / "events.parquet"}'""")
    return str(path)


@pytest.mark.parametrize("name", ["interp_sum", "interp_avg", "interp_min", "interp_max", "interp_sum_join", "interp_sum_sweep", "interp_downsample", "rate", "segments", "stored_scan", "rollup_job", "result_json", "result_text"])
def test_events_of_one_second_as_in_sql(spark, tmp_path, name):
    import duckdb

    from chronofold import catalog

    path = _tied(tmp_path / "tied")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    assert con.sql("SELECT count(*) FROM (SELECT 1 FROM events GROUP BY event_type, user_id, ts HAVING count(*) > 1)").fetchall()[0][0] > 100
    df = catalog.queries()[name](spark, path)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    near = lambda v: ("nan" if math.isnan(v) else f"{v + 0.0:.4g}") if isinstance(v, float) else str(v)
    got = sorted([near(r[c]) for c in want.columns] for r in df.collect())
    assert got == sorted([near(v) for v in r] for r in want.fetchall())


def test_points_of_one_second_follow_in_the_order_of_writes(spark):
    rows = spark.createDataFrame([("s", 0, 5.0, 2), ("s", 0, 1.0, 1), ("s", 0, 1.0, 3), ("s", 4, 9.0, 4)], "s string, ts bigint, value double, write_seq bigint")
    got = [(r.write_seq, r.value) for r in series.rate(rows, ["s"]).orderBy("write_seq").collect()]
    assert got == [(2, math.inf), (3, -math.inf), (4, 2.0)]
    assert [(r.y1, r.y2, r["first"]) for r in series.segments(rows, ["s"]).orderBy("x2", "y2").collect()] == [(5.0, 1.0, False), (1.0, 5.0, True), (1.0, 9.0, False)]


def test_a_time_does_not_meet_all_segments_of_its_group():
    """30,000 series of a group: 0.9 * 10**9 pairs of a time and a segment before."""
    n = 30_000
    rng = np.random.default_rng(0)
    grid = np.arange(n)
    x1, x2 = np.zeros(n, np.int64), np.full(n, n - 1)
    y1, y2 = rng.random(n), rng.random(n)
    tree = series._Tree(grid, x1, x2, y1, y2, np.zeros(n, np.int64), np.full(n, n))
    assert sum(len(seg) for _, _, seg in tree.pieces()) <= 2 * n * 15
    for x in (0, 1, 777, n - 1):
        y = np.where(x == n - 1, y2, y1 + (y2 - y1) * x / (n - 1))
        assert math.isclose(tree.total()[x], y.sum(), rel_tol=1e-12) and math.isclose(tree.least(1.0)[x], y.min(), abs_tol=1e-12) and math.isclose(-tree.least(-1.0)[x], y.max())


def test_keys_of_events_are_written_out(spark):
    """Sorting a map of tags for each event took most of the scan."""
    rows = spark.createDataFrame([(0, "click", 5, 1.0), (1, "click", -3, 1.0), (2, "click", None, 1.0)], "event_id bigint, event_type string, user_id bigint, value double")
    p = model.event_points(rows.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")))
    assert "array_sort" not in p.select("series_key")._jdf.queryExecution().optimizedPlan().toString()
    got = p.orderBy("write_seq").select("series_key", model.series_key(F.col("tags"))).collect()
    assert [tuple(r) for r in got] == [("cluster=c1,user=5",) * 2, ("cluster=c-3,user=-3",) * 2, ("", "")]


def test_segments_are_shuffled_once_to_their_slots(spark):
    """By one number that they are sorted by alone; a shuffle to the cuts of their group came before."""
    rows = frame(spark, [(g, f"s{i}", t, 1.0) for g in "ab" for i in range(3) for t in range(5)])
    plan = series.interpolate(rows, ["g"], ["s"], "sum")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "Sort [_task#" in plan and plan.count("Exchange hashpartitioning(_task#") == 1


@pytest.mark.parametrize("name", ["interp_min", "interp_downsample"])
def test_queries_shuffle_points_and_segments_once(spark, name):
    from chronofold import catalog

    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # points to their series, segments to their slots, and no sorting of segments by text
    assert plan.count("Exchange hashpartitioning(_task#") == 1 and plan.count("Window [") == 1
    assert "SortMergeJoin" not in plan and "array_sort" not in plan and "Sort [_task#" in plan


@pytest.mark.parametrize("name", ["interp_downsample", "interp_min"])
def test_groups_of_one_task_are_shuffled_once(spark, name):
    """Points were sorted to series, and their segments shuffled again, before."""
    from chronofold import catalog

    df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.count() == len(df.collect()) > 0
    done = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in done and "Exchange hashpartitioning(_group#" in done
    assert "Window [" not in done and "EmptyRelation" in done  # the part for greater groups
    assert "map(" not in done  # no tags row by row


@pytest.mark.parametrize("agg", ["min", "max", "sum", "avg"])
@pytest.mark.parametrize("most,slot", [(0, 10**6), (60, 10**6), (60, 7), (10**6, 7), (10**6, 1)])
def test_groups_of_any_size_against_slow_oracle(spark, monkeypatch, agg, most, slot):
    monkeypatch.setattr(series, "GROUP_POINTS", most)
    monkeypatch.setattr(series, "SLOT_POINTS", slot)
    rng = random.Random(2)
    rows = [(g, f"s{i}", t, rng.random()) for g, n in (("a", 9), ("b", 3), (None, 7), ("c", 1)) for i in range(n) for t in rng.sample(range(-40, 200), rng.randint(1, 20))]
    got = series.interpolate(frame(spark, rows).repartition(3), ["g"], ["s"], agg).collect()
    want, got = slow(rows, agg), {(r.g, r.ts): r.value for r in got}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


@pytest.mark.parametrize("agg,most", [("min", 0), ("min", 100), ("sum", 0), ("sum", 100)])
def test_writes_of_one_second_and_nulls_in_groups_of_any_size(spark, monkeypatch, agg, most):
    monkeypatch.setattr(series, "GROUP_POINTS", most)
    rows = [("g", None, "x", 0, 5.0, 7), ("g", None, "x", 0, 1.0, -3), ("g", None, "x", 4, 9.0, 2), ("g", None, "x", None, 1.0, 1), ("g", 1, "x", 0, 3.0, 3), ("g", 1, "x", 4, 3.0, None), ("g", 1, "x", 4, 2.0, 1), ("g", 2, "x", 2, None, 1), ("g", 2, "x", 3, 4.0, 1), ("h", 1, "x", 1, 1.0, 1), ("h", 1, "x", None, 1.0, 1)]
    points = spark.createDataFrame(rows, "g string, a int, b string, ts bigint, value double, n int").withColumn("write_seq", F.col("n").cast("decimal(38,0)"))
    got = {(r.g, r.ts): r.value for r in series.interpolate(points, ["g"], ["a", "b"], agg).collect()}
    x = {0: (5.0, 3.0), 2: (7.0, 3.0), 3: (8.0, 3.0, 4.0), 4: (9.0, 3.0)}  # a line starts from the last write of a second and ends at the first
    assert got == {("g", t): {"min": min, "sum": sum}[agg](v) for t, v in x.items()}


def test_slots_that_share_a_number_are_parted(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(g, f"s{i}", t, rng.random()) for g in ("a", "b", None) for i in range(6) for t in rng.sample(range(100), 9)]
    points = frame(spark, rows)
    monkeypatch.setattr(series.F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))
    got = {(r.g, r.ts): r.value for r in series.interpolate(points, ["g"], ["s"], "sum", slot=40).collect()}
    want = slow(rows, "sum")
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def _tree(x1, x2, y1, y2):
    grid = np.unique(np.concatenate([x1, x2]))
    return series._Tree(grid, x1, x2, y1, y2, np.searchsorted(grid, x1), np.searchsorted(grid, x2, "right"))


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_lines_far_from_the_least_are_not_compared(sign, monkeypatch):
    """Each piece was evaluated five times and sorted before."""
    rng = np.random.default_rng(0)
    ts, y = np.sort(rng.integers(0, 2_592_000, (4000, 13)), axis=1), np.round(rng.exponential(50, (4000, 13)), 2)
    x1, x2, y1, y2 = (a.ravel() for a in (ts[:, :-1], ts[:, 1:], y[:, :-1], y[:, 1:]))
    on = x1 < x2
    tree = _tree(x1[on], x2[on], y1[on], y2[on])
    met, at = [0], series._Tree.at
    monkeypatch.setattr(series._Tree, "at", lambda self, seg, x: met.__setitem__(0, met[0] + len(seg)) or at(self, seg, x))
    got = sign * tree.least(sign)
    assert met[0] < sum(len(seg) for _, _, seg in tree.pieces())
    for i in rng.integers(0, len(tree.grid), 50):
        held = np.flatnonzero((tree.begin <= i) & (i < tree.end))
        assert got[i] == sign * (sign * at(tree, held, tree.grid[i])).min()


def test_crossing_lines_are_all_kept():
    """Tangents of a parabola: each is the greatest somewhere."""
    at = np.arange(0, 4000, 2)
    x1, x2 = np.zeros(len(at), np.int64), np.full(len(at), 4000)
    tree = _tree(np.concatenate([x1, at]), np.concatenate([x2, at + 1]), np.concatenate([-at * at, -9e9 + at]).astype(float), np.concatenate([8000 * at - at * at, -9e9 + at]).astype(float))
    line = lambda x: (8000 * at - at * at + at * at) * x / 4000 - at * at
    assert np.allclose(-tree.least(-1.0), [line(x).max() for x in tree.grid], rtol=1e-12) and np.allclose(tree.least(1.0), np.minimum([line(x).min() for x in tree.grid], [-9e9 + x - x % 2 if x < 4000 else 0 for x in tree.grid]))


@pytest.mark.parametrize("agg", ["min", "max"])
def test_values_that_overflow_are_as_in_the_join(spark, agg):
    rows = frame(spark, [("g", "a", 0, -1.7e308), ("g", "a", 100, 1.7e308), ("g", "b", 0, 1.0), ("g", "b", 50, 2.0), ("g", "b", 100, 1e307)])
    got, want = ({r.ts: r.value for r in series.interpolate(rows, ["g"], ["s"], agg, m).collect()} for m in ("slots", "join"))
    assert got == want and math.isinf(want[50] if agg == "max" else -math.inf)


@pytest.mark.parametrize("agg,method", [("sum", "slots"), ("min", "slots"), ("avg", "join"), ("max", "slots")])
def test_interpolation_over_nulls(spark, agg, method):
    rows = [("g", "a", 0, 1.0), ("g", "a", 10, None), ("g", "a", 20, 3.0), ("g", "b", 0, None), ("g", "b", 5, 2.0), ("g", "b", 15, 4.0), ("g", "c", 30, None), ("g", "c", 31, None)]
    got = {r.ts: r.value for r in series.interpolate(frame(spark, rows), ["g"], ["s"], agg, method).collect()}
    assert got == {0: 1.0, 5: 2.0, 10: 3.0, 15: 4.0, 20: 3.0, 30: None, 31: None}


@pytest.mark.parametrize("agg,method,slot", [("sum", "join", None), ("avg", "join", None)])
def test_join_of_buckets_against_slow_oracle(spark, agg, method, slot):
    rng = random.Random(1)
    rows = [(g, f"s{i}", t, rng.random()) for g in "ab" for i in range(12) for t in rng.sample(range(-4_000_000, 9_000_000), rng.randint(1, 30)) + rng.sample(range(-400, 600), 5)]
    got = {(r.g, r.ts): r.value for r in series.interpolate(frame(spark, rows), ["g"], ["s"], agg, method, slot).collect()}
    want = slow(rows, agg)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


@pytest.mark.parametrize("agg,method,slot", [("max", "slots", None), ("min", "slots", 7), ("sum", "slots", 13), ("avg", "slots", 50), ("max", "join", None), ("sum", "sweep", None), ("avg", "sweep", None)])
def test_interpolation_against_slow_oracle(spark, agg, method, slot):
    rng = random.Random(0)
    rows = [(g, f"s{i}", t, rng.random()) for g in "ab" for i in range(12) for t in rng.sample(range(-40, 200), rng.randint(1, 30))]
    got = {(r.g, r.ts): r.value for r in series.interpolate(frame(spark, rows), ["g"], ["s"], agg, method, slot).collect()}
    want = slow(rows, agg)
    assert got.keys() == want.keys()
    for k in want:
        assert (got[k] == want[k]) if agg in ("min", "max") and method != "sweep" else math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9)


def test_registered_aggregator_uses_the_join(spark):
    if "spread" not in aggregators.names():
        aggregators.register("spread", lambda c: F.max(c) - F.min(c))
    rows = [("a", "x", 0, 0.0), ("a", "x", 10, 10.0), ("a", "y", 0, 5.0), ("a", "y", 10, 5.0)]
    got = {r.ts: r.value for r in series.interpolate(frame(spark, rows), ["g"], ["s"], "spread").collect()}
    assert got == {0: 5.0, 10: 5.0}
    with pytest.raises(ValueError):
        aggregators.register("sum", F.sum)


def test_single_point_series_vanish_and_identical_series_emit_once(spark):
    rows = [("a", "x", 0, 1.0)] + [("b", f"s{i}", t, 0.0) for i in range(3) for t in (0, 1)]
    got = series.interpolate_and_downsample(frame(spark, rows), ["g"], ["s"], "max", 10).collect()
    assert [(r.g, r.ts, r.value) for r in got] == [("b", 5, 0.0)]


def test_downsample_example_and_rate(spark):
    rows = [("a", "x", 100, 1.0), ("a", "x", 200, 1.0), ("a", "x", 350, 2.0), ("a", "x", 500, 2.0)]
    got = sorted((r.ts, r.value) for r in series.downsample(frame(spark, rows), ["g", "s"], 300, "max").collect())
    assert got == [(150, 1.0), (450, 2.0)]
    got = sorted((r.ts, r.value) for r in series.rate(frame(spark, rows), ["g", "s"]).collect())
    assert got == [(200, 0.0), (350, 1 / 150), (500, 0.0)]


def test_last_write_wins_and_int_before_float(spark):
    t = {"cluster": "a"}
    got = series.last_write(points(spark, [("m", t, 1, 5, 1), ("m", t, 1, 6, 2), ("m", t, 2, 1.5, 3), ("m", t, 2, 7, 3)])).collect()
    assert sorted((r.ts, r.value, r.kind) for r in got) == [(1, 6.0, "INT"), (2, 7.0, "INT")]


def test_filters_ranges_and_extra_tags(spark):
    rows = [("m", {"type": k, "attr": "a", "cluster": "p"}, t, 1, t) for k in ("foo", "bar", "junk") for t in range(0, 7201, 1200)]
    p = points(spark, rows)
    count = lambda *fs, **kw: filters.select(p, "m", filters=list(fs), **kw).count()
    assert count(filters.of("type", "foo")) == 7
    assert count(filters.of("type", "foo|bar")) == 14
    assert count(filters.of("type", "*"), filters.of("none", "*")) == 0
    assert sorted(r.ts for r in filters.select(p, "m", 1200, 4801, [filters.of("type", "foo")]).collect()) == [1200, 2400, 3600, 4800]
    assert filters.group_tags(filters.from_text("a->x;b->x y;c->*")) == ["b", "c"]
    for bad in ("a->", "x"):
        with pytest.raises(ValueError):
            filters.from_text(bad)
    with pytest.raises(ValueError):
        filters.of("a", "x|")
    with pytest.raises(ValueError):
        filters.require_shard(filters.from_mapping({"cluster": "*"}))


def test_durations():
    assert timeutil.duration("2w") == 1_209_600 and timeutil.downsample_spec("5m-avg", aggregators.names()) == (300, "avg")
    for bad in ("5x", "m", "5m-foo", "5m"):
        with pytest.raises(ValueError):
            timeutil.downsample_spec(bad, aggregators.names()) if "-" in bad or bad == "5m" else timeutil.duration(bad)


def parsed(spark, *texts):
    rows = parsing.parse_lines(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, line string"))
    return [r for r in sorted(rows.collect(), key=lambda r: r.i)]


def test_lines(spark):
    ok, lists, ints, neg, empty = parsed(spark, "put m 10 1.5 cluster=a host=h\r", "put m 10 [1,2,3.0] cluster=a", "put  m 10 [1,2] cluster=a", "put m 10 -7 b=c cluster=a", "put m 1 [] cluster=a")
    assert (ok.error, ok.metric, ok.ts, ok.float_value, ok.series_key) == (None, "m", 10, 1.5, "cluster=a,host=h")
    assert lists.float_list == [1.0, 2.0, 3.0] and lists.kind == "FLOAT_LIST" and ints.int_list == [1, 2]
    assert neg.int_value == -7 and neg.tags == {"b": "c", "cluster": "a"} and empty.error == "empty values list"
    bad = parsed(spark, "", None, "put m x 1 cluster=a", "put m 10 1 cluster=a cluster=b", "put m 10 1 cluster", "put m 10 1 h=x", "put m! 10 1 cluster=a", "put m 10 99999999999999999999 cluster=a", "put m 10 1e400 cluster=a", "put m 4294967000 1 cluster=a", "put m 10 [1,x] cluster=a", "put m 10 1 cluster=a h=" + "x" * 2048)
    assert [r.error for r in bad] == ["unknown command", "unknown command", "invalid timestamp", "duplicate tag", "invalid tag", "exactly one shard tag needed", "illegal character", "invalid value", "value is not finite", "timestamp out of range", "invalid value", "line too long"]


def test_json_points(spark):
    body = json.dumps([{"HOST/metric": {"value": 3.14, "timestamp": 1364451167, "type": "numeric"}}, {"a/b/c": {"value": 7, "timestamp": 5, "type": "numeric"}}])
    rows = parsing.parse_json(spark.createDataFrame([(body,), (json.dumps({"h/m": {"value": 1, "timestamp": 2, "type": "numeric"}}),)], "body string")).collect()
    assert sorted((r.metric, r.tags["host"], r.ts, r.kind) for r in rows) == [("l.b/c", "a", 5, "INT"), ("l.m", "h", 2, "INT"), ("l.metric", "HOST", 1364451167, "FLOAT")]


def test_inflated_lines_in_any_chunks():
    raw = b"".join(b"put m %d 1 cluster=a\n" % i for i in range(1, 50))
    for wbits in (15, -15):
        z = zlib.compressobj(wbits=wbits)
        packed = z.compress(raw) + z.flush()
        for n in (1, 7, 1000):
            assert list(lines.inflated(packed[i : i + n] for i in range(0, len(packed), n))) == raw.decode().splitlines()
    with pytest.raises(ValueError):
        list(lines.inflated([zlib.compress(b"x" * 5000)]))


def test_generations(spark):
    periods = generations.calendar([("26/02/15", 26), ("01/01/15", 1)])
    assert [p.start for p in periods] == sorted(p.start for p in periods)
    now = periods[1].start
    ts = [periods[0].start - 1, periods[0].start, periods[0].start + timeutil.SPAN, periods[1].start, periods[1].start + 60 * timeutil.SPAN]
    rows = spark.createDataFrame([(t,) for t in ts], "ts bigint").select("ts", generations.generation(F.col("ts"), periods, now).alias("g")).collect()
    assert [r.g for r in rows] == [-1, 0, 1, periods[1].first, -1]
    for r in rows:
        if r.g >= 0:
            a, b = generations.time_range(r.g, periods)
            assert a <= r.ts < b
    assert generations.covering(periods[0].start, periods[0].start + timeutil.SPAN, periods) == [0]
    assert generations.covering(0, 1, periods) == []


def test_a_further_period_cuts_no_generation():
    first, second = generations.calendar([("01/01/15", 26), ("26/02/15", 1)])
    assert second.start == 1482969600 and second.first == 2 and (second.start - first.start) % first.length == 0
    assert [generations.time_range(g, [first, second])[1] for g in (0, 1, 2)] == [first.start + first.length, second.start, second.start + timeutil.SPAN]


def test_skewed_groups_get_slots_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(series, "SLOT_POINTS", 100)
    rows = [("dense", f"s{i % 3}", i, float(i % 7)) for i in range(2000)] + [("sparse", "s", t, 1.0) for t in (0, 4 * 10**8)]
    slots = {(r.g, r._slot): r.n for r in series.slotted(frame(spark, rows), ["g"], ["s"]).groupBy("g", "_slot").agg(F.count("*").alias("n")).collect()}
    assert max(slots.values()) < 250 and sum(g == "dense" for g, _ in slots) >= 15 and sum(g == "sparse" for g, _ in slots) == 1
    want = slow(rows, "sum")
    for method in ("slots", "sweep", "join"):
        got = {(r.g, r.ts): r.value for r in series.interpolate(frame(spark, rows), ["g"], ["s"], "sum", method).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


def test_last_write_and_hourly_plans(spark):
    p = points(spark, [("m", {"cluster": "a"}, i, i, i) for i in range(10)])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan(series.last_write(p)) and "HashAggregate" in plan(series.last_write(p))
    text = plan(rollup.hourly(p, ["metric", "series_key"]))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Scan") == 1


def test_write_seq_of_many_partitions(spark):
    rows = spark.range(0, 1000, 1, 200)
    got = [r.s for b in (0, 1) for r in rows.select(ingest.write_seq(b).alias("s")).collect()]
    assert len(set(got)) == 2000 and min(got[1000:]) > max(got[:1000])


def test_replay_brings_the_drop_back_once(spark, tmp_path):
    drop, out = str(tmp_path / "drop"), str(tmp_path / "out")
    spark.range(5).write.parquet(f"{drop}/batch=0")
    state = f"file://{tmp_path}/replay"
    ingest.replay(spark, drop, ingest.parquet_sink(out), state)
    ingest.replay(spark, drop, ingest.parquet_sink(out), state)
    spark.range(5, 8).write.parquet(f"{drop}/batch=1")
    query = ingest.replay(spark, drop, ingest.parquet_sink(out), state)
    assert spark.read.parquet(out).count() == 8
    assert ingest.meters(query)["rows"] == 3 and ingest.meters(query)["p95_ms"] >= ingest.meters(query)["median_ms"] > 0
    (tmp_path / "replay" / "replaying").write_text("")
    with pytest.raises(RuntimeError):
        ingest.replay(spark, drop, ingest.parquet_sink(out), state)


def test_supervised_waits_longer_each_time():
    class Query:
        def __init__(self, ok):
            self.ok = ok

        def awaitTermination(self):
            if not self.ok:
                raise RuntimeError("lost")

    runs, waits = iter([Query(False), Query(False), Query(True)]), []
    assert ingest.supervised(lambda: next(runs), first_wait=0.5, sleep=waits.append) == 2 and waits == [0.5, 1.0]
    with pytest.raises(RuntimeError):
        ingest.supervised(lambda: Query(False), retries=1, sleep=waits.append)


def test_counted_points(spark):
    rows, seen = ingest.counted(parsing.parse_lines(spark.createDataFrame([("put m 1 1 cluster=a",), ("put m 1 1.5 cluster=a",), ("put m 1 [1] cluster=a",), ("x",)], "line string")))
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"all": 4, "rejected": 1, "int": 1, "float": 1, "int_list": 1, "float_list": 0}


def test_compressed_socket_lands_in_files_that_are_streamed(spark, tmp_path):
    import socket

    a, b = socket.socketpair()
    a.sendall(zlib.compress(b"".join(b"put m %d 1 cluster=a\n" % i for i in range(1, 26))))
    a.close()
    assert lines.land(lines.inflated(lines.received(b, 7)), str(tmp_path / "in"), 10) == 3
    ingest.ingest(lines.stream_files(spark, str(tmp_path / "in"), 2), ingest.parquet_sink(str(tmp_path / "out")), ingest.black_hole, ingest.black_hole, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 25


def test_kafka_rows_hold_lines(spark):
    p = points(spark, [("m", {"cluster": "a", "h": "x"}, 5, 7, 1), ("m", {"cluster": "a", "h": "x"}, 6, 1.5, 2)])
    rows = lines.kafka_rows(p).select(F.col("key").cast("string"), F.col("value").cast("string").alias("line")).orderBy("line").collect()
    assert [(r.key, r.line) for r in rows] == [("cluster=a,h=x", "put m 5 7 cluster=a h=x"), ("cluster=a,h=x", "put m 6 1.5 cluster=a h=x")]


def test_compacting_changed_partitions_alone(spark, tmp_path):
    periods = generations.calendar([("01/01/24", 1)])
    at, path = periods[0].start, str(tmp_path / "a")
    one = lambda c, v: store.write(store.placed(points(spark, [("m", {"cluster": c}, at, v, v)]), periods, at), path)
    one("a", 1), one("a", 2), one("b", 5)
    before = {f for f in spark.read.parquet(path).inputFiles() if "shard=b" in f}
    assert store.compact_changed(spark, path, str(tmp_path / "staging")) == 1
    rows = spark.read.parquet(path)
    assert sorted((r.shard, r.value) for r in rows.collect()) == [("a", 2.0), ("b", 5.0)]
    assert before == {f for f in rows.inputFiles() if "shard=b" in f}


def test_http_write_splits_points(spark):
    from chronofold.plans import http

    kept, bad = [], []
    service = http.Service(spark.range(1), sink=lambda df: kept.extend(df.collect()), quarantine=lambda df: bad.extend(df.collect()))
    body = json.dumps([{"h/m": {"value": 3, "timestamp": 5, "type": "numeric"}}, {"h!/m": {"value": 1.5, "timestamp": 5, "type": "numeric"}}])
    assert service.answer("POST", "/write", body)[::2] == (200, '{"written": 1, "rejected": 1}')
    assert [(r.metric, r.value) for r in kept] == [("l.m", 3.0)] and [r.error for r in bad] == ["illegal character"]
    assert service.answer("POST", "/write", "{")[0] == 400


def test_rollups(spark):
    rows = [("g", "s", i * 60, float(i * 60 // 3600)) for i in range(3600)]
    hours = rollup.hourly(frame(spark, rows), ["g", "s"])
    avg = {r.ts: r.value for r in hours.filter("resolution = 3600 and agg = 'avg'").collect()}
    assert avg == {i * 3600: float(i) for i in range(60)}
    days = {(r.agg, r.ts): r.value for r in rollup.daily(hours, ["g", "s"]).collect()}
    assert days["max", 0] == 23.0 and days["min", 86400] == 24.0 and days["avg", 0] == 11.5
    for bad in ((0, 100, "hour"), (0, 3600, "day"), (3600, 3600, "hour"), (0, 3600, "week")):
        with pytest.raises(ValueError):
            rollup.check_range(*bad)


def test_routing_takes_finer_pieces_for_the_tail(spark):
    raw = frame(spark, [("g", "s", t, 1.0) for t in range(0, 10_800, 60)]).select("g", "s", "ts", "value")
    rolled = spark.createDataFrame([("g", "s", 0, 10.0, 3600, "max"), ("g", "s", 3600, 5.0, 300, "max"), ("g", "s", 0, 99.0, 300, "max"), ("g", "s", 0, 77.0, 3600, "min")], "g string, s string, ts bigint, value double, resolution int, agg string")
    got = sorted((r.ts, r.value) for r in routing.pieces(raw, rolled, 0, 4200, 3600, "max").collect())
    assert got[:2] == [(0, 10.0), (3600, 5.0)] and got[2] == (3900, 1.0) and len(got) == 2 + 5
    assert routing.pieces(raw, rolled, 0, 3600, 60, "max").count() == 60
    assert routing.chosen(86_400) == [86_400, 3600, 300, 0] and routing.chosen(None) == [0]


def test_sines_end_to_end(spark):
    rows = [("sin", {"cluster": "c", "period": str(p), "amp": str(a)}, t, a * math.sin(t / p), t) for p in (100, 200) for a in (10, 20) for t in range(0, 2000, 100)]
    p = points(spark, rows)
    body = {"start": 0, "end": 2_000_000, "queries": [{"metric": "sin", "aggregator": "max", "tags": {"cluster": "c", "period": "*"}}, {"metric": "none", "aggregator": "sum", "tags": {"cluster": "c"}}]}
    request = query.parse(json.dumps(body))
    found, none = query.run(p, request)
    got = {(r.tag_period, r.ts): r.value for r in found.collect()}
    assert len(got) == 40 and none.count() == 0
    for (period, t), v in got.items():
        assert math.isclose(v, max(a * math.sin(t / int(period)) for a in (10, 20)), rel_tol=1e-5, abs_tol=1e-5)
    text = query.to_json_rows(found, "sin").orderBy("group").first().json
    assert json.loads(text)["tags"] == {"period": "100"} and len(json.loads(text)["dps"]) == 20


def test_store_prunes_compacts_and_keeps_outlanders(spark, tmp_path):
    periods = generations.calendar([("01/01/24", 1)])
    at = periods[0].start
    rows = [("m", {"cluster": c, "h": "x"}, at + d, i, i) for c in "ab" for i, d in enumerate((0, 0, 100, 5 * timeutil.SPAN))]
    path, packed = str(tmp_path / "a"), str(tmp_path / "b")
    store.write(store.placed(points(spark, rows), periods, at), path)
    store.compact(spark, path, packed)
    assert store.outlanders(spark, path).count() == 2
    found = store.scan(spark, packed, "m", at, at + 1000, filters.from_mapping({"cluster": "a", "h": "*"}), periods)
    assert sorted((r.ts, r.value) for r in found.collect()) == [(at, 1.0), (at + 100, 2.0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "shard" in plan.split("PartitionFilters")[1][:400]
    store.create_table(spark, "stored_points", packed)
    spark.sql("DROP TABLE stored_points")


def test_metadata(spark):
    p = points(spark, [("aaa", {"host": f"h{i}", "cluster": "c"}, t, 1, 1) for i in range(10) for t in ((75, 85) if i < 9 else (75,))] + [("aab", {"host": "x", "cluster": "c"}, 85, 1, 1), ("abc", {"cluster": "c"}, 1, 1, 1)])
    known = metadata.names(p)
    assert [r.name for r in metadata.suggest(known, "aa", "metrics").collect()] == ["aaa", "aab"]
    assert [r.name for r in metadata.suggest(known, "", "metrics", 1).collect()] == ["aaa"]
    assert metadata.unregistered(known, known).count() == 0
    good = metadata.health(p, "aaa", [], "host", 100, 10).first()
    assert (good.count1, good.count2, good.healthy) == (10, 9, True)
    assert metadata.health(p, "none", [], "host", 100, 10).first().healthy is False


def test_failover_and_drop_strategy(spark, tmp_path):
    rows = spark.createDataFrame([("send",), ("drop",)], "metric string")
    sink = ingest.failover(ingest.parquet_sink(str(tmp_path / "main")), ingest.parquet_sink(str(tmp_path / "drop")), F.col("metric") == "drop")
    sink(rows, 1)
    assert [r.metric for r in spark.read.parquet(str(tmp_path / "main")).collect()] == ["send"]
    assert [r.metric for r in spark.read.parquet(str(tmp_path / "drop")).collect()] == ["drop"]
    ingest.failover(ingest.failing, ingest.parquet_sink(str(tmp_path / "drop")), F.col("metric") == "drop")(rows, 2)
    assert spark.read.parquet(str(tmp_path / "drop")).filter("batch = 2").count() == 2
    with pytest.raises(RuntimeError):
        ingest.failover(ingest.failing, ingest.failing)(rows, 3)


def test_stream_restarts_without_repeats(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.txt").write_text("put m 10 1 cluster=a\nbad\n")
    start = lambda: ingest.ingest(lines.stream_files(spark, str(source), 1), ingest.parquet_sink(out), ingest.black_hole, ingest.parquet_sink(out + "-bad"), str(tmp_path / "state")).awaitTermination()
    start()
    (source / "b.txt").write_text("put m 10 2 cluster=a\n")
    start()
    rows = spark.read.parquet(out)
    assert rows.count() == 2 and series.last_write(rows.drop("batch", "line")).first().value == 2.0
    assert spark.read.parquet(out + "-bad").count() == 1


def test_lag_and_text_result(spark):
    w = spark.createDataFrame([(0, 10), (1, 5)], "partition int, offset bigint")
    r = spark.createDataFrame([(0, 4)], "partition int, offset bigint")
    assert tuple(ingest.lag(w, r).first()) == (11, 6)
    t = query.to_text_lines(spark.createDataFrame([("k=v", 1, 2.0)], "group string, ts bigint, value double"))
    assert [x.text for x in t.orderBy("group", "line").collect()] == ["{k=v}", "1 2.0"]


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_http_front(spark):
    import threading
    import urllib.request

    from chronofold.plans import http

    p = points(spark, [("m", {"cluster": "c", "h": h}, t, float(t), t) for h in "xy" for t in (0, 10, 20)]).cache()
    server = http.serve(http.Service(p, now=lambda: 30), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}"
    body = json.dumps({"start": 0, "queries": [{"metric": "m", "aggregator": "sum", "tags": {"cluster": "c"}}]}).encode()
    got = json.loads(urllib.request.urlopen(urllib.request.Request(f"{url}/api/query", body)).read())
    assert got == [{"metric": "m", "tags": {}, "dps": {"0": 0.0, "10": 20.0, "20": 40.0}}]
    assert json.loads(urllib.request.urlopen(f"{url}/api/suggest?type=tagv&q=x").read()) == ["x"]
    assert urllib.request.urlopen(f"{url}/points/m?start=0&end=11&attrs=cluster-%3Ec;h-%3Ex&agrg=max").read() == b"{}\n0 0.0\n10 10.0\n"
    assert json.loads(urllib.request.urlopen(f"{url}/health?metric=m&fixed_attrs=cluster-%3Ec&count_attr=h&time_interval=10").read()) == {"count1": 2, "count2": 2, "healthy": True}
    service = http.Service(p)
    assert service.answer("GET", "/nowhere")[0] == 404 and service.answer("POST", "/api/query", '{"start": 0, "queries": [{"metric": "m", "aggregator": "median"}]}')[0] == 400
    server.shutdown()


def test_entry_without_the_training_data_subpackage(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "chronofold", tmp_path / "chronofold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'interp_sum' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q), q; assert set(o) <= set(q)"
    for _ in range(2):
        subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
        (tmp_path / "chronofold" / "llm").mkdir(exist_ok=True)


def test_streaming_rollup_keeps_points_of_many_files(spark, tmp_path):
    from chronofold import catalog

    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(1010)
    sf = str(tmp_path)
    rows.repartition(1010, "event_id").sortWithinPartitions("ts").write.option("maxRecordsPerFile", 1).parquet(f"{sf}/events.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64KB")
    try:
        got = catalog.streaming_rollup(spark, sf).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    points = catalog._points(spark, sf)
    assert got == points.select("metric", "series_key", F.expr("ts - ts % 3600")).distinct().count()
