"""Fixed vectors, edge cases, and results that don't depend on how rows are dealt out."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import joins, merges, ordering, stateless, windows
from millrace.plans import apps
from millrace.plans.flow import Flow, PortSchema
from millrace.sources import files, sinks


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 20)
    monkeypatch.setattr(windows, "BLOCK_ROWS", 16)


@pytest.fixture
def sequence(spark):
    """A key with most rows, some of a few, one of null."""
    return spark.range(300).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 9 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), F.col("id").alias("t"), ((F.col("id") * 37) % 101).cast("double").alias("x"))


def test_ema_vectors(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 4.0), (3, None)], "t int, x double")
    assert [v for _, v in rows(windows.ema(df, [], ["t"], "x", 0.5), "t", "value")] == pytest.approx([10.0, 7.0, 3.5])
    assert rows(windows.ema(df, [], ["t"], "x", 1.0), "value") == [(0.0,), (4.0,), (10.0,)]
    with pytest.raises(ValueError):
        windows.ema(df, [], ["t"], "x", 0.0)


@pytest.mark.parametrize("weight", [0.001, 0.3, 0.97])
def test_ema_over_blocks(spark, small_ranges, sequence, weight):
    want, state = [], {}
    for r in sequence.orderBy("t").collect():
        state[r.k] = r.x if r.k not in state else weight * r.x + (1 - weight) * state[r.k]
        want.append((r.t, state[r.k]))
    got = rows(windows.ema(sequence, ["k"], ["t"], "x", weight), "t", "value")
    assert [t for t, _ in got] == [t for t, _ in want]
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for (_, a), (_, b) in zip(got, want, strict=True))


def test_count_window_vectors(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 3, 3)], "k string, t int, v int")
    fold = lambda start: rows(windows.fold_window(df, ["k"], ["t"], 2, F.lit(start), lambda acc, r: acc + r["v"]), "window", "value")
    assert fold(4) == [(0, 7)] and fold(3) == [(0, 6)]
    assert rows(windows.count_window(df, ["k"], ["t"], 2, {"v": F.sum("v")}, partial=True), "window", "v") == [(0, 3), (1, 3)]


def test_sliding_vector(spark):
    df = spark.createDataFrame([("a", float(p), float(v), t) for t, (p, v) in enumerate([(5, 20), (10, 25), (30, 60), (40, 50), (50, 40)])], "tickersymbol string, myvwap double, volume double, timestamp long")
    assert rows(apps.vwap(df, ["timestamp"], 3, 2), "svwap", "svolume") == [(45.0, 105.0), (120.0, 150.0)]


def test_bargain_vectors(spark):
    values = spark.createDataFrame([("a", 50.0, 0), ("a", 60.0, 1)], "tickersymbol string, cvwap double, timestamp long")
    quotes = spark.createDataFrame([("a", 0.4, 1, 0), ("a", 0.3, 2, 1), ("a", 0.7, 1, 2), ("b", 0.1, 1, 3)], "tickersymbol string, askptickersymbolprice double, asksize int, timestamp long")
    got = [r[0] for r in rows(apps.bargain_index(values, quotes), "bargainindex")]
    assert all(math.isclose(a, b) for a, b in zip(got, [math.exp(10), 2 * math.exp(30)], strict=True))


def test_barrier(spark):
    ports = [spark.createDataFrame([(t, i) for t in range(n)], f"t{i} int, count int") for i, n in enumerate((2, 3, 2))]
    order = [[f"t{i}"] for i in range(3)]
    assert rows(merges.barrier(ports, order), "count") == [(0,), (0,)]
    assert rows(merges.barrier(ports, order, policy=merges.OVERWRITE), "count") == [(2,), (2,)]
    with pytest.raises(ValueError):
        merges.barrier(ports, order, unequal="error")


def test_positions_don_t_depend_on_ranges(spark, sequence, small_ranges, monkeypatch):
    aggs = {"s": ("sum", "x"), "n": ("count", "x"), "a": ("min", "x"), "b": ("max", "x"), "l": ("last", "x")}
    made = lambda: (
        rows(ordering.numbered(sequence, ["k"], ["t"]), "t", "pos"),
        rows(ordering.numbered(sequence, [], ["t"]), "t", "pos"),
        rows(windows.running(sequence, ["k"], ["t"], aggs), "t", *aggs),
        rows(windows.moving(sequence, ["k"], ["t"], 7, {"m": F.sum("x")}), "t", "m"),
    )
    split = made()
    monkeypatch.setattr(ordering, "RANGE_ROWS", 10**6)
    monkeypatch.setattr(windows, "BLOCK_ROWS", 4096)
    assert split == made()
    assert [p for _, p in split[1]] == list(range(1, 301))


def test_asof_over_ranges(spark, sequence, small_ranges):
    right = sequence.where("t % 5 = 0").select("k", "t", F.col("t").alias("u"))
    got = rows(joins.asof_join(sequence, right, ["k"], "t", ["u"], exact=False), "t", "u")
    last, want = {}, []
    for r in sequence.orderBy("t").collect():
        if r.k in last:
            want.append((r.t, last[r.k]))
        if r.t % 5 == 0:
            last[r.k] = r.t
    assert got == want


def test_texts_and_times_as_order(spark, small_ranges):
    df = spark.range(100).select(F.format_string("%05d", F.col("id")).alias("s"), F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("n"))
    for by in ("s", "ts"):
        assert all(p == n + 1 for n, p in rows(ordering.numbered(df, [], [by]), "n", "pos"))


def test_stateless(spark):
    df = spark.createDataFrame([(1, "  a b  c\n"), (2, ""), (3, None)], "i int, s string")
    assert [r.word for r in stateless.split_words(df.where("i = 1"), "s").collect()] == ["a", "b", "", "c"]
    assert rows(stateless.split_words(df, "s", ["i"])) == [(1, ""), (1, "a"), (1, "b"), (1, "c"), (2, "")]
    assert stateless.duplicate(df, 0).count() == 0 and stateless.duplicate(df, 3).count() == 9
    assert stateless.filter_rows(df, F.col("s") == "").count() == 1
    assert rows(stateless.mod_filter(df, 2, ["i"]), "i") == [(1,), (3,)]
    assert rows(stateless.cvwap(spark.createDataFrame([("a", 1.0, 0.0, 1)], "tickersymbol string, svwap double, svolume double, timestamp int")), "cvwap") == [(None,)]


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "k string, t long, x double")
    assert windows.ema(df, ["k"], ["t"], "x", 0.5).count() == 0
    assert windows.count_window(df, ["k"], ["t"], 2, {"n": F.count("*")}).count() == 0
    assert windows.running(df, ["k"], ["t"], {"s": ("sum", "x")}).count() == 0
    assert joins.asof_join(df, df.select("k", "t", F.col("x").alias("y")), ["k"], "t", ["y"]).count() == 0
    assert merges.barrier([df, df], [["t"], ["t"]]).count() == 0


def test_prefix_keys_need_one_shuffle(spark):
    df = spark.createDataFrame([(a, b, 1) for a in range(4) for b in range(3) for _ in range(5)], "a int, b int, v int")
    found = apps.prefix_key_sums(df, ["a", "b"], 1, "v")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {r[2] for r in rows(found)} == {5}


def test_log_lines(spark, tmp_path):
    (tmp_path / "log").write_text("Aug  1 10:00:00 node cron[1]: run it\nJul  1 10:00:00 node x: y\nAug  2 1:1:1 n sshd[2]: authentication failure; a\n")
    found = files.log_lines(spark, str(tmp_path / "log")).collect()
    assert [(r.host, r.srvc, r.msg) for r in found] == [("node", "cron[1]:", ["run", "it"])]


def test_format_tuple(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "b int, a string")
    assert rows(df.select(sinks.format_tuple(df))) == [("Tuple({a=x},{b=2})",), ("Tuple({b=1})",)]


def test_flow(spark):
    df = spark.range(6)
    flow = Flow().add("a", lambda: df, inputs=0).add("b", lambda d: [d.where("id % 2 = 0"), d.where("id % 2 = 1")], outputs=2).add("c", lambda d: d.select((F.col("id") * 10).alias("id")))
    flow.connect("a", "b").connect("b", "c", from_port=0).connect("b", "c", from_port=1)
    assert rows(flow.run()["c"][0]) == [(10 * i,) for i in range(6)]
    assert flow.sources() == ["a"] and len(flow.inbound("c")) == 2 and flow.outbound("a") == [("a", 0, "b", 0)]


def test_flow_errors():
    wide, narrow = PortSchema({"x": "bigint"}), PortSchema({"x": "int", "y": "string"})
    assert wide.accepts(narrow) and not narrow.accepts(wide)
    with pytest.raises(ValueError):
        PortSchema({"x": "int"}, exact=True).extend({"y": "int"})
    with pytest.raises(ValueError):
        wide.extend({"x": "int"})
    one = lambda: Flow().add("a", lambda d: d).add("b", lambda d: d)
    for wrong in (lambda f: f.add("a", lambda d: d), lambda f: f.connect("a", "c"), lambda f: f.connect("a", "a"), lambda f: f.connect("a", "b", 1), lambda f: f.connect("a", "b").connect("b", "a"), lambda f: f.build()):
        with pytest.raises(ValueError):
            wrong(one())
    with pytest.raises(ValueError):
        Flow().add("a", lambda: None, inputs=0).add("b", lambda: None, inputs=0).build()
    with pytest.raises(ValueError):
        Flow().build()
    with pytest.raises(ValueError):
        Flow().add("a", lambda x, y: x, inputs=[wide, narrow], partition_by=["x"])


def test_windows_at_the_end_of_input(spark):
    """A stream's counts by window are whole, also of windows that the watermark has not passed."""
    from collections import Counter

    from millrace.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    want = Counter((r.ts.date(), r.event_type) for r in spark.read.parquet(f"{sf}/events.parquet").collect())
    assert {(r.start.date(), r.event_type): r.n for r in QUERIES["stream_windowed_counts"](spark, sf).collect()} == want


def test_asof_by_text(spark, small_ranges):
    """Texts with a common beginning are ranged by their whole values, above the size of a range as below it."""
    rows = spark.range(400)
    name = F.concat(F.lit("https://example.org/a/common/beginning/"), F.lpad(F.col("id").cast("string"), 6, "0"))
    left = rows.select((F.col("id") % 3).alias("k"), name.alias("at"), "id")
    right = rows.where("id % 5 = 0").select((F.col("id") % 3).alias("k"), name.alias("at"), F.col("id").alias("met"))
    got = {r.id: r.met for r in joins.asof_join(left, right, ["k"], "at", ["met"], how="left").collect()}
    assert got == {i: max((m for m in range(0, i + 1, 5) if m % 3 == i % 3), default=None) for i in range(400)}
    ranges = left.select(ordering.ranges_of(left, "at").alias("r")).groupBy("r").count().collect()
    assert len(ranges) > 5 and max(r["count"] for r in ranges) < 200


def test_order_by_other_types(spark, small_ranges):
    rows = spark.range(200).select("id", F.col("id").cast("string").cast("binary").alias("b"), F.struct((F.col("id") % 2).alias("x"), "id").alias("s"), F.when(F.col("id") > 3, F.col("id").cast("decimal(10,2)")).alias("d"))
    for by, key in (("b", lambda i: str(i).encode()), ("s", lambda i: (i % 2, i)), ("d", lambda i: i if i > 3 else -1)):
        got = {r.id: r.pos for r in ordering.numbered(rows, [], [by, "id"]).collect()}
        assert got == {i: k + 1 for k, i in enumerate(sorted(range(200), key=lambda i: (key(i), i)))}


def test_console_and_metrics(spark):
    import io
    import time

    from millrace.sources import sinks

    out = io.StringIO()
    shown = sinks.console(spark.range(50).select("id", F.lit(None).cast("string").alias("x")), out=out)
    assert sorted(out.getvalue().split()) == sorted(f"Tuple({{id={i}}})" for i in range(50)) and shown.count() == 50
    seen = []
    log = sinks.MetricsLog(lambda name, batch, values: seen.append((name, values["n"])))
    spark.streams.addListener(log)
    rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 7).load()
    rows, _ = sinks.watched(rate, "passed", n=F.count("*"))
    query = rows.writeStream.format("noop").start()
    for _ in range(100):
        if seen:
            break
        time.sleep(0.2)
    query.stop()
    spark.streams.removeListener(log)
    assert seen and seen[0] == ("passed", 7)


def test_console_prints_in_tasks(spark, tmp_path, monkeypatch):
    """Every row is printed once as a whole line by its task; none goes to the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    from millrace.plans.catalog import QUERIES
    from millrace.sources import sinks

    def refuse(self, *_, **__):
        raise AssertionError("rows on the driver")

    for way in ("collect", "toLocalIterator", "toPandas"):
        monkeypatch.setattr(DataFrame, way, refuse)
    path = tmp_path / "printed"
    shown = sinks.console(spark.range(0, 30_000, 1, 6), out=str(path))
    sinks.console(spark.range(3))
    QUERIES["sink_console"](spark, "/root/testdata/sf0.001")
    monkeypatch.undo()
    assert sorted(path.read_text().splitlines()) == sorted(f"Tuple({{id={i}}})" for i in range(30_000)) and shown.count() == 30_000


@pytest.fixture(scope="module")
def readings(spark):
    """Rows of 40 keys (one null, two that differ in the last digit beyond 2 ** 53) over three slices; null values, and ids beyond 2 ** 53 beside a null one."""
    big = 2**60
    rows = []
    for i in range(600):
        key = None if i % 40 == 0 else big + i % 40
        rows.append((None if i == 7 else big + i, i if i != 7 else 600, key, "purchase" if i % 3 == 0 else "view", None if i % 11 == 0 else i / 4))
    frame = spark.createDataFrame(rows, "id bigint, ts bigint, k bigint, kind string, value double").withColumn("slice", F.col("ts"))
    return rows, frame


def _by_key(rows):
    keyed = {}
    for row in sorted(rows, key=lambda r: r[1]):
        keyed.setdefault(row[2], []).append(row)
    return keyed


@pytest.mark.parametrize("name", ["asof", "count_window", "ema", "running"])
def test_streams_in_lots(spark, readings, name):
    """Keys that share a lot don't mix, from micro-batch to micro-batch; null and large keys and ids stay as they are."""
    from millrace import streaming

    rows, frame = readings
    stream = streaming.as_stream(spark, frame, "slice", ["k"], files=2)
    order, want = ["ts", "id"], []
    for key, own in _by_key(rows).items():
        numbers = [r[4] or 0.0 for r in own]
        if name == "running":
            want += [(key, r[1], r[0], n + 1, sum(numbers[: n + 1])) for n, r in enumerate(own)]
        elif name == "count_window":
            want += [(key, w, sum(numbers[4 * w : 4 * w + 4])) for w in range(len(own) // 4)]
        elif name == "ema":
            mean = numbers[0]
            for r, x in zip(own, numbers, strict=True):
                mean = 0.3137 * x + (1 - 0.3137) * mean
                want.append((key, r[1], r[0], round(mean, 6)))
        elif key is not None:  # as of: null keys meet nothing
            met = None
            for r in own:
                met = r if r[3] == "purchase" else met
                if r[3] == "view" and met:
                    want.append((key, r[1], r[4], met[4]))
    if name == "asof":
        ours, theirs = (stream.where(F.col("kind") == k) for k in ("view", "purchase"))
        made = streaming.stream_asof(ours, theirs.withColumnRenamed("value", "price"), ["k"], "ts", "price", "value")
    elif name == "count_window":
        made = streaming.stream_count_window(stream, ["k"], order, 4, "value")
    elif name == "ema":
        made = streaming.stream_ema(stream, ["k"], order, "value", 0.3137)
    else:
        made = streaming.stream_running(stream, ["k"], order, "value")
    got = streaming.run_available(made)
    if name == "ema":
        got = got.withColumn("value", F.round("value", 6))
    text = lambda found: sorted(map(repr, found))
    assert text(tuple(r) for r in got.collect()) == text(want)


def test_a_call_takes_many_keys(spark, readings):
    """A lot's keys come in one call for each micro-batch, so that calls don't grow with keys."""
    import pandas as pd

    from millrace import streaming

    def step(before, rows):
        return before.assign(n=1).astype("int64"), pd.DataFrame({"met": len(before)}, index=rows.index[:1])

    stream = streaming.as_stream(spark, readings[1], "slice", ["k"], files=2)
    got = streaming.run_available(streaming.in_lots(stream, ["k"], ["ts"], "n bigint", step, [], "met int", lots=2)).collect()
    assert len(got) == 6 and sum(r.met for r in got) == 3 * 40


def test_rated_streams(spark):
    from millrace.sources import generators

    counts = []

    def start(df):
        return df.writeStream.foreachBatch(lambda rows, _: counts.append((len(phases), rows.count()))).start()

    phases = []
    for rate in (5, 10):
        phases.append(rate)
        generators.run_rated(spark, [(3, rate)], start, n=F.col("value"))
    assert sum(n for p, n in counts if p == 1) > 0 and sum(n for p, n in counts if p == 2) > 0


def test_summaries_of_nulls(spark):
    from millrace.functions import summaries

    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("b", 5.0), (None, 3.0), ("c", None)], "k string, v double")
    got = {r.k: (r.median, r.p75, r.most if "most" in r else r.max) for r in summaries(rows, ["k"], "v").collect()}
    assert got == {"a": (1.5, 1.75, 2.0), "b": (5.0, 5.0, 5.0), None: (3.0, 3.0, 3.0)}
