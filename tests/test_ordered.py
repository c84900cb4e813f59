"""Ordered operators against literal loops, with segments so small that every hand-over is exercised."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clusterlens.operators import features, models, periods, segments, states, windows
from clusterlens.operators.windows import WindowSpec

T0 = datetime(2020, 1, 1)
CUTS = [{}, {"width": 4_000_000}, {"width": 3_600_000_000, "split_rows": 3}]


def at(second):
    return T0 + timedelta(seconds=second)


def pair_loop(events):
    """Literal start/finish simulation over (second, kind, value)."""
    out, opened = [], None
    for second, kind, value in events:
        if kind == "s" and opened is None:
            opened = (second, value)
        elif kind != "s" and opened is not None:
            out.append((*opened, second, "finish" if kind == "f" else "container_finish"))
            opened = None
    if opened is not None:
        out.append((*opened, None, "open"))
    return out


@pytest.mark.parametrize("cut", CUTS)
def test_pairing_equals_simulation(spark, cut):
    rng = random.Random(7)
    messages, finishes, expected = [], [], []
    for c in range(40):
        container = f"container_1_{c:04d}_01_000002"
        moments = rng.sample(range(40), 14)
        marks = [m for m in moments if rng.random() < 0.2]
        finishes += [(container, at(m), m) for m in marks]
        for key in ("k1", "k2"):
            own = [(m, rng.choice("ssf"), float(m)) for m in moments if m not in marks and rng.random() < 0.7]
            messages += [
                (container, "a", at(m), "period", "task", {"TID": key}, v, kind == "f", 0, 0, m) for m, kind, v in own
            ]
            merged = sorted(own + [(m, "x", None) for m in marks])
            expected += [(container, key, *p) for p in pair_loop(merged)]
    df = spark.createDataFrame(
        messages,
        "container_id STRING, app_id STRING, ts TIMESTAMP, type STRING, name STRING, tags MAP<STRING,STRING>, "
        "value DOUBLE, is_finish BOOLEAN, rule_id INT, group_id INT, seq BIGINT",
    )
    marks_df = spark.createDataFrame(finishes, "container_id STRING, ts TIMESTAMP, seq BIGINT")
    got = [
        (
            r.container_id,
            r.tags["TID"],
            int((r.start_ts - T0).total_seconds()),
            r.value,
            None if r.end_ts is None else int((r.end_ts - T0).total_seconds()),
            r.closed_by,
        )
        for r in periods.pair(df, marks_df, **cut).toLocalIterator()
    ]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize(
    ("start", "end", "closed_by", "ticks"),
    [
        (3, 27, "finish", [10, 20]),
        (3, 7, "finish", [10]),
        (3, 7, "container_finish", []),
        (10, 20, "finish", [10]),
        (10, 10, "finish", [10]),
        (12, None, "open", [20, 30, 40]),
    ],
)
def test_expansion(spark, start, end, closed_by, ticks):
    df = spark.createDataFrame(
        [("c", "a", "period", "n", {"k": "v"}, 2.0, at(start), None if end is None else at(end), closed_by)],
        "container_id STRING, app_id STRING, type STRING, name STRING, tags MAP<STRING,STRING>, value DOUBLE, "
        "start_ts TIMESTAMP, end_ts TIMESTAMP, closed_by STRING",
    )
    out = periods.expand(df, 10_000, F.lit(at(40)))
    assert sorted(int((r.ts - T0).total_seconds()) for r in out.toLocalIterator()) == ticks


def test_long_period_expands_in_chunks(spark):
    df = spark.createDataFrame(
        [("c", "a", "period", "n", {}, 1.0, at(0), at(20_000), "finish")],
        "container_id STRING, app_id STRING, type STRING, name STRING, tags MAP<STRING,STRING>, value DOUBLE, "
        "start_ts TIMESTAMP, end_ts TIMESTAMP, closed_by STRING",
    )
    out = periods.expand(df, 1000, F.lit(at(0)))
    assert out.agg(F.count("*"), F.countDistinct("ts"), F.max("ts")).first()[:] == (20_000, 20_000, at(19_999))


def window_loop(ticks, size, stride):
    out, ticks = [], sorted(ticks)
    while ticks:
        run = [ticks[0]]
        while len(run) < len(ticks) and ticks[len(run)] == run[-1] + 1:
            run.append(ticks[len(run)])
        for start in range(0, len(run), stride):
            out += [(t, run[start], len(run[start : start + size])) for t in run[start : start + size]]
        ticks = ticks[len(run) :]
    return out


@pytest.mark.parametrize(("size", "stride"), [(1000, 1000), (3, 2), (4, 1)])
def test_gap_aware_golden_and_simulation(spark, rows, monkeypatch, size, stride):
    monkeypatch.setattr(segments, "SPLIT_ROWS", 4)
    rng = random.Random(size)
    scopes = {"golden": [*range(10), *range(15, 25)]}
    scopes |= {f"s{i}": rng.sample(range(40), rng.randint(1, 36)) for i in range(30)}
    data = [(s, t, f"container_{c}") for s, ticks in scopes.items() for t in ticks for c in range(2)]
    cells = spark.createDataFrame(data, "scope STRING, tick BIGINT, container_id STRING")
    out = windows.gap_aware(cells, WindowSpec(size, stride), scope=["scope"])
    expected = [(s, *w) for s, ticks in scopes.items() for w in window_loop(ticks, size, stride)]
    assert rows(out, "scope", "tick", "window_start", "n_ticks") == sorted(expected, key=repr)
    whole = windows.gap_aware(cells.where("scope = 'golden'"), WindowSpec(size, stride))
    assert whole.select("window_start").distinct().count() == {1000: 2, 3: 10, 4: 20}[size]


def test_window_options():
    assert WindowSpec.from_options(3, 2) == WindowSpec(1000, 1000)
    assert WindowSpec.from_options(3, 5, ms_resolution=True) == WindowSpec(3, 3)
    assert WindowSpec.from_options() == WindowSpec(1000, 1000)
    with pytest.raises(ValueError):
        WindowSpec(0, 1)


def positional_loop(values, size, stride):
    out, index = [], 0
    while index < len(values):
        out.append(values[index : index + size])
        if index + size > len(values):
            break
        index += stride
    return out


@pytest.mark.parametrize("cut", CUTS)
@pytest.mark.parametrize(("size", "stride"), [(6, 5), (2, 1), (2, 2), (2, 3)])
def test_positional_equals_simulation(spark, rows, cut, size, stride):
    scopes = {f"n{n}": list(range(1, n + 1)) for n in (1, 2, 4, 5, 6, 7, 13, 20)}
    data = [(s, at(v), v) for s, values in scopes.items() for v in values]
    df = spark.createDataFrame(data, "source STRING, ts TIMESTAMP, v BIGINT")
    out = windows.positional(
        df, segments.micros(), ["ts", "v"], size, stride, ["source"],
        [F.min("v").alias("lo"), F.max("v").alias("hi"), windows.reducer("count", "v").alias("n")], **cut,
    )
    expected = [
        (s, k, w[0], w[-1], len(w))
        for s, values in scopes.items()
        for k, w in enumerate(positional_loop(values, size, stride))
    ]
    assert rows(out, "source", "window_no", "lo", "hi", "n") == sorted(expected, key=repr)


@pytest.mark.parametrize("cut", CUTS)
@pytest.mark.parametrize("size, stride", [(1, 1), (2, 1), (4, 2), (4, 4), (6, 5), (5, 7), (3, 2), (60, 1)])
def test_merged_halves_equal_simulation(spark, rows, cut, size, stride):
    scopes = {f"n{n}": [(7 * v) % 11 for v in range(1, n + 1)] for n in (1, 2, 4, 5, 6, 7, 13, 20, 130)}
    data = [(s, at(i), i, v) for s, values in scopes.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "source STRING, ts TIMESTAMP, i BIGINT, v BIGINT")
    how = {name: (name, "v") for name in windows.MERGED}
    out = windows.positional_reduce(df, segments.micros(), ["ts", "i"], size, stride, ["source"], how, **cut)
    expected = [
        (s, k, sum(w) / len(w), max(w), min(w), max(w) - min(w), sum(w), len(w))
        for s, values in scopes.items()
        for k, w in enumerate(positional_loop(values, size, stride))
    ]
    assert rows(out, "source", "window_no", *how) == sorted(expected, key=repr)


def test_pairing_is_one_shuffle(spark, tmp_path):
    schema = "container_id STRING, app_id STRING, ts TIMESTAMP, type STRING, name STRING, tags MAP<STRING,STRING>, value DOUBLE, is_finish BOOLEAN, rule_id INT, group_id INT, seq BIGINT"
    rows = [(f"c{i % 3}", "a", at(i), "period", "task", {"TID": str(i % 7)}, 1.0, i % 2 == 1, 0, 0, i) for i in range(50)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "facts"))
    spark.createDataFrame([("c1", at(30), 99)], "container_id STRING, ts TIMESTAMP, seq BIGINT").write.parquet(str(tmp_path / "marks"))
    plain, cut = (
        periods.pair(spark.read.parquet(str(tmp_path / "facts")), spark.read.parquet(str(tmp_path / "marks")), **how)
        for how in ({}, {"split_rows": 5})
    )
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and plan.count("FileScan") == 2
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))


def test_long_windows_copy_no_rows(spark):
    df = spark.createDataFrame([("a", at(i), i) for i in range(300)], "k STRING, ts TIMESTAMP, v BIGINT")
    out = windows.positional_reduce(df, segments.micros(), ["ts"], 60, 1, ["k"], {"x": ("sum", "v")})
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 242
    with pytest.raises(ValueError):
        windows.positional_reduce(df, segments.micros(), ["ts"], 60, 1, ["k"], {"x": ("median", "v")})


def test_a_hot_tick_is_cut_by_container(spark, rows):
    """One tick of one source in several tasks, with the same windows."""
    ids = [f"container_15_0001_01_{n:06d}" for n in range(300)] + ["", "x"]
    data = [("s", 1000, c, float(i), float(i % 7)) for i, c in enumerate(ids)] + [("s", 2000, c, 1.0, 2.0) for c in ids[:5]]
    df = spark.createDataFrame(data, "source STRING, tick BIGINT, container_id STRING, x DOUBLE, y DOUBLE")
    cut = segments.assign(df, ["source"], F.col("tick"), width=1000, split_rows=40, minor="container_id")
    sizes = [r["n"] for r in cut.where("tick = 1000").groupBy(segments.SEGMENT).agg(F.count("x").alias("n")).collect()]
    assert len(sizes) > 7 and max(sizes) <= 40
    whole = features.training_set(df, 6, 5)
    split = features.training_set(df, 6, 5, split_rows=40, width=1000)
    assert rows(split, "source", "window_no", "x", "y") == rows(whole, "source", "window_no", "x", "y")
    ordered = sorted(data, key=lambda r: (r[1], r[2]))
    loops = positional_loop(ordered, 6, 5)
    want = [("s", k, sum(r[3] for r in w), max(r[4] for r in w) / 1e6) for k, w in enumerate(loops)]
    assert rows(split, "source", "window_no", "x", "y") == sorted(want, key=repr)


def test_extractors_of_parts_and_of_windows_agree(spark, rows):
    data = [(f"c{c}", t * 1000, float(t + c)) for c in range(3) for t in (1, 2, 3, 5, 6, 7, 8) if (c + t) % 3]
    cells = spark.createDataFrame(data, "container_id STRING, tick BIGINT, memory DOUBLE")
    spec = windows.WindowSpec(4, 2, 1000)
    features.register_extractor("whole", lambda w: features.window_mean(w, "memory").withColumnRenamed("mean", "value"))
    got = [features.run_extractor(name, cells, spec) for name in ("memory", "whole")]
    columns = ["window_start", "container_id", "value"]
    assert rows(got[0], *columns) == rows(got[1], *columns)
    plan = got[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate")


def test_unknown_reducers():
    with pytest.raises(ValueError):
        windows.reducer("median", "v")
    with pytest.raises(ValueError):
        features.reduce_messages(None, "median")


@pytest.mark.parametrize("cut", CUTS)
def test_sessions_equal_simulation(spark, rows, cut):
    rng = random.Random(3)
    scopes = {f"s{i}": sorted(rng.choices(range(120), k=rng.randint(1, 30))) for i in range(20)}
    df = spark.createDataFrame(
        [(s, at(v)) for s, values in scopes.items() for v in values], "scope STRING, ts TIMESTAMP"
    )
    expected = []
    for s, values in scopes.items():
        runs = [[values[0]]]
        for v in values[1:]:
            runs[-1].append(v) if v - runs[-1][-1] < 9 else runs.append([v])
        expected += [(s, at(r[0]), at(r[-1]), len(r)) for r in runs]
    assert rows(windows.idle_sessions(df, 9000, ["scope"], **cut)) == sorted(expected, key=repr)


@pytest.mark.parametrize("cut", CUTS)
def test_as_of_and_live_info(spark, rows, cut):
    rng = random.Random(5)
    timeline = [("c", s, at(t), i) for i, (s, t) in enumerate([("NEW", 10), ("RUNNING", 20)])]
    probes = [("c", at(t), t) for t in (5, 10, 15, 20, 99)] + [("d", at(1), 1)]
    out = states.state_as_of(
        spark.createDataFrame(probes, "container_id STRING, ts TIMESTAMP, seq BIGINT"),
        spark.createDataFrame(timeline, "container_id STRING, state STRING, ts TIMESTAMP, seq BIGINT"),
        **cut,
    )
    assert rows(out, "container_id", "seq", "state") == [
        ("c", 10, "NEW"), ("c", 15, "NEW"), ("c", 20, "RUNNING"), ("c", 5, "NEW"), ("c", 99, "RUNNING"), ("d", 1, "NEW"),
    ]
    data, expected = [], []
    for c in range(30):
        info = None
        for t in range(rng.randint(1, 25)):
            finish, value = rng.random() < 0.2, f" v {rng.randint(0, 1)}"
            data.append((f"c{c}", "stage", value, finish, at(t), t))
            shown = value.strip().replace(" ", "_")
            if finish:
                info = None
            elif info is None or info[0] != shown:
                info = (shown, t)
        if info:
            expected.append((f"c{c}", f"stage:{info[0]}", at(info[1])))
    df = spark.createDataFrame(
        data, "container_id STRING, name STRING, value_text STRING, is_finish BOOLEAN, ts TIMESTAMP, seq BIGINT"
    )
    assert rows(states.live_info(df, **cut), "container_id", "info", "ts") == sorted(expected, key=repr)


def series_tables(spark):
    memory = [10.0, 20.0, 35.0, 30.0, 50.0]
    cells = [(t + 1, c, m) for c in ("c2", "c_000001", "c3") for t, m in enumerate(memory)]
    tasks = [(2, c, v) for c in ("c2", "c_000001") for v in (1.0, 3.0)] + [(4, c, 5.0) for c in ("c2", "c_000001")]
    tasks.append((3, "c3", 1.0))
    long = [(t, c, "period", "task", v) for t, c, v in tasks]
    return (
        spark.createDataFrame(cells, "tick BIGINT, container_id STRING, memory DOUBLE"),
        spark.createDataFrame(long, "tick BIGINT, container_id STRING, kind STRING, key STRING, value DOUBLE"),
    )


@pytest.mark.parametrize(("how", "x"), [("count", [2.0, 0.0, 1.0]), ("sum", [4.0, 0.0, 5.0]), ("avg", [2.0, 0.0, 5.0])])
@pytest.mark.parametrize(("use_rate", "y"), [(False, [20.0, 35.0, 30.0]), (True, [20.0, 15.0, -5.0])])
def test_aligned_series(spark, how, x, use_rate, y):
    cells, long = series_tables(spark)
    out = features.aligned_series(cells, long, "memory", "task", how, use_rate=use_rate, width=2)
    got = [(r.container_id, r.tick, r.x, r.y) for r in out.orderBy("tick").toLocalIterator()]
    assert got == [("c2", t, a, b) for t, a, b in zip((2, 3, 4), x, y, strict=True)]


def test_window_mean_and_key_counts(spark, rows):
    cells = spark.createDataFrame(
        [(t, "A", 8.0) for t in range(4)] + [(t, "B", 8.0) for t in (1, 2)],
        "tick BIGINT, container_id STRING, memory DOUBLE",
    )
    windowed = windows.windowed(cells, WindowSpec(4, 4))
    assert rows(features.window_mean(windowed, "memory"), "container_id", "mean") == [("A", 8.0), ("B", 4.0)]
    assert rows(features.run_extractor("memory", windowed), "container_id", "value") == [("A", 8.0), ("B", 4.0)]
    counts = spark.createDataFrame(
        [(1, "B", "period", "task", 3), (2, "B", "period", "task", 1)],
        "tick BIGINT, container_id STRING, kind STRING, key STRING, n BIGINT",
    )
    out = features.window_key_counts(windowed, counts)
    assert rows(out, "container_id", "key", "n") == [("B", "task", 1)]


@pytest.mark.parametrize(("size", "stride"), [(4, 4), (4, 2), (3, 2), (5, 1)])
def test_panes_equal_copied_cells(spark, rows, size, stride):
    """Runs with gaps, a null scope, a container that comes and goes."""
    ticks = [0, 1, 2, 3, 4, 5, 6, 10, 11, 20]
    data = [(a, t, c, float(t + i)) for a in ("x", None) for t in ticks for i, c in enumerate("AB") if c == "A" or t % 3]
    cells = spark.createDataFrame(data, "app_id STRING, tick BIGINT, container_id STRING, memory DOUBLE")
    spec = WindowSpec(size, stride)
    copied = features.window_mean(windows.windowed(cells, spec, ["app_id"]), "memory", ["app_id"])
    panes = features.pane_mean(cells, spec, "memory", ["app_id"])
    assert panes.count() == copied.count() > 0
    assert panes.exceptAll(copied.select(panes.columns)).isEmpty()


def test_panes_reduce_before_copies(spark):
    cells = spark.createDataFrame([(t, "A", 1.0) for t in range(9)], "tick BIGINT, container_id STRING, memory DOUBLE")
    plan = features.pane_mean(cells, WindowSpec(6, 3), "memory")._jdf.queryExecution().optimizedPlan().toString()
    copies = plan.index("Generate explode")
    assert "Aggregate" in plan[:copies] and "sum(memory" in plan[copies:]


def test_training_set(spark, rows):
    data = [(t, "c", float(t), t * 1e6) for t in range(1, 14)]
    series = spark.createDataFrame(data, "tick BIGINT, container_id STRING, x DOUBLE, y DOUBLE")
    both = features.union_sources({"a": series, "b": series.where("tick <= 6")})
    out = features.training_set(both, 6, 5, width=4)
    assert rows(out, "source", "window_no", "x", "y") == [
        ("a", 0, 21.0, 6.0), ("a", 1, 51.0, 11.0), ("a", 2, 36.0, 13.0), ("b", 0, 21.0, 6.0), ("b", 1, 6.0, 6.0),
    ]




def test_linear_fit_and_band(spark):
    data = [(float(x), 1.0 + 2.0 * x + d) for x, d in zip(range(6), (0.1, -0.1, 0.0, 0.2, -0.2, 0.0), strict=True)]
    df = spark.createDataFrame(data, "x DOUBLE, y DOUBLE")
    fit = models.linear_fit(df).first()
    n, mx, my = 6, sum(x for x, _ in data) / 6, sum(y for _, y in data) / 6
    sxy = sum((x - mx) * (y - my) for x, y in data)
    sxx = sum((x - mx) ** 2 for x, _ in data)
    syy = sum((y - my) ** 2 for _, y in data)
    slope, intercept = sxy / sxx, my - sxy / sxx * mx
    mse = sum((y - intercept - slope * x) ** 2 for x, y in data) / n
    assert fit.slope == pytest.approx(slope) and fit.intercept == pytest.approx(intercept)
    assert fit.r2 == pytest.approx(sxy**2 / sxx / syy) and fit.mse == pytest.approx(mse)
    assert fit.corr == pytest.approx(sxy / (sxx * syy) ** 0.5)
    error = (syy / 5) ** 0.5 / 6**0.5
    band = models.interval(models.linear_fit(df), 3.0).first()
    half = 2.1318467863 * error
    assert (band.low, band.high) == (pytest.approx(band.y0 - half), pytest.approx(band.y0 + half))
    given = models.interval(models.linear_fit(df), 3.0, t=1.0).first()
    assert given.high - given.y0 == pytest.approx(error)


def test_regression_by_hand(spark):
    """x 0..5 against 1 3 2 5 4 6: both squares sum to 17.5 about their means, the products to 15.5."""
    data = [(float(x), float(y)) for x, y in enumerate([1, 3, 2, 5, 4, 6])]
    fit = models.linear_fit(spark.createDataFrame(data, "x DOUBLE, y DOUBLE"))
    row = models.interval(fit, 3.0).first()
    assert (row.n, row.slope, row.intercept) == (6, pytest.approx(31 / 35), pytest.approx(9 / 7))
    assert (row.r2, row["corr"]) == (pytest.approx((31 / 35) ** 2), pytest.approx(31 / 35))
    assert (row.std_err, row.mse) == (pytest.approx((3.5 / 6) ** 0.5), pytest.approx(22 / 35))
    half = 2.1318468 * (3.5 / 6) ** 0.5
    assert (row.low, row.high) == (pytest.approx(138 / 35 - half, abs=1e-6), pytest.approx(138 / 35 + half, abs=1e-6))
    two_sided = models.interval(fit, 3.0, t=2.0).first()
    assert two_sided.high - two_sided.low == pytest.approx(4 * (3.5 / 6) ** 0.5)


@pytest.mark.parametrize(
    ("p", "degrees", "t"),
    [(0.95, 19, 1.7291328), (0.975, 19, 2.0930241), (0.95, 20, 1.7247182), (0.95, 1, 6.3137515), (0.05, 20, -1.7247182)],
)
def test_student_quantile(p, degrees, t):
    assert models.student_quantile(p, degrees) == pytest.approx(t, abs=1e-6)


def test_student_quantile_many_degrees():
    z = 1.6448536269514722
    for n in (5000, 5001, 10**9):
        assert models.student_quantile(0.95, n) == pytest.approx(z + (z**3 + z) / (4 * n), abs=1e-6)


def test_null_keys_are_keys(spark, rows):
    """Segment summaries and window joins treat null like any other key."""
    df = spark.createDataFrame([(None, i, float(i)) for i in range(6)] + [("a", 0, 9.0)], "k STRING, t BIGINT, v DOUBLE")
    before = segments.lag(df, ["k"], F.col("t"), ["t"], {"p": "v"}, width=2)
    assert rows(before.where("k is null"), "t", "p") == [(0, None), *[(i, float(i - 1)) for i in range(1, 6)]]
    sums = windows.positional(df, F.col("t"), ["t"], 4, 2, ["k"], [F.count("v").alias("n")], width=2)
    assert rows(sums.where("k is null"), "window_no", "n") == [(0, 4), (1, 4)] + [(2, 2)]
    ticks = df.select(F.col("k").alias("app_id"), (F.col("t") * 1000).alias("tick"))
    spec = windows.WindowSpec(3, 3, 1000)
    assert windows.gap_aware(ticks, spec, scope=["app_id"]).count() == 7
    assert windows.windowed(ticks, spec, scope=["app_id"]).count() == 7


def test_kmeans_separates(spark):
    data = [(float(i % 2) * 100, float(i % 2) * 50 + i * 0.01) for i in range(20)]
    out = models.kmeans(spark.createDataFrame(data, "x DOUBLE, y DOUBLE"))
    groups = {r.cluster: r.xs for r in out.groupBy("cluster").agg(F.collect_set("x").alias("xs")).toLocalIterator()}
    assert groups == {0: [0.0], 1: [100.0]}


def test_kmeans_of_odd_rows(spark, rows):
    data = spark.createDataFrame([(1.0, 1.0), (1.0, None), (9.0, 1.0), (8.0, 1.0), (2.0, 1.0)], "x DOUBLE, y DOUBLE")
    assert rows(models.kmeans(data), "x", "cluster") == rows(
        spark.createDataFrame([(1.0, 0), (1.0, None), (2.0, 0), (8.0, 1), (9.0, 1)], "x DOUBLE, cluster INT"), "x", "cluster"
    )
    assert models.kmeans(data.where("x > 100")).isEmpty()
    assert {r.cluster for r in models.kmeans(data.where("x = 9"), k=3).toLocalIterator()} == {0}


def test_tasks_hold_so_many_rows(spark, monkeypatch):
    """What a task sorts or groups does not grow with the table: each gets about TASK_ROWS (or COPIES) rows, in one chain of windows."""
    monkeypatch.setattr(segments, "WHOLE_ROWS", 100)
    monkeypatch.setattr(segments, "TASK_ROWS", 200)
    monkeypatch.setattr(windows, "COPIES", 1000)
    df = spark.range(4000).select((F.col("id") % 50).alias("k"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("v"))
    out = windows.positional_reduce(df, segments.micros(), ["ts"], 4, 2, ["k"], {"x": ("sum", "v")})
    assert out.rdd.getNumPartitions() >= 20 and out.count() == 50 * 40
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # the ordered rows are stored once, not worked out for each half
    cells = spark.range(4000).select((F.col("id") % 400).alias("tick"), F.floor(F.col("id") / 400).alias("container_id"), F.lit(1.0).alias("memory"))
    means = features.pane_mean(cells, WindowSpec(60, 1), "memory")
    assert means.rdd.getNumPartitions() >= 200
    # windows are made behind the only shuffle of the cells, so their copies go over none
    lines = means._jdf.queryExecution().executedPlan().toString().splitlines()
    generate = [i for i, x in enumerate(lines) if "Generate" in x]
    assert not any("Exchange" in x for x in lines[: generate[0]])
    assert means.count() == 400 * 10 and means.where("window_start < 341 and abs(mean - 1) > 1e-9").isEmpty()
