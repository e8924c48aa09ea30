import random

import pytest
from pyspark.sql import functions as F

from quern.operators import batch, pack, ranges, sample


@pytest.fixture
def spread(spark):
    """No coalescing, so that small tables fill several ranges."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_prefix_scan_of_one_hot_key(spread):
    pick = random.Random(1)
    data = [("hot" if i % 10 else ("cold", None)[i % 20 == 0], i, pick.choice([None, 1, 2, 5, -3]), pick.random()) for i in range(500)]
    df = spread.createDataFrame(data, "k string, o int, n int, x double").repartition(5)
    assert ranges.dealt(df, ["k", "o"]).where("k = 'hot'").select("__range").distinct().count() > 4
    for how, column, fold in (("sum", "n", sum), ("min", "x", min), ("max", "x", max), ("min", "n", min)):
        got = {r.o: r.p for r in ranges.prefix_scan(df, column, ["o"], "p", how, ["k"]).collect()}
        at = {"n": 2, "x": 3}[column]
        for k, o, *_ in data:
            before = [r[at] for r in data if r[0] == k and r[1] < o and r[at] is not None]
            assert got[o] == (fold(before) if before else (0 if how == "sum" else None))
    total = {r.o: r.p for r in ranges.prefix_scan(df, "x", ["o"], "p").collect()}
    assert total[499] == pytest.approx(sum(r[3] for r in data[:499]))
    assert sorted(r.ord for r in ranges.numbered(df.where("k = 'hot'"), ["o"], keys=["k"]).collect()) == list(range(450))
    assert ranges.prefix_scan(df.limit(0), "x", ["o"], "p").collect() == []


def test_pick_ranks(spread):
    df = spread.createDataFrame([("a" if i % 4 else "b", i) for i in range(400)], "k string, o int").repartition(3)
    picks = spread.createDataFrame([("a", 0, "x"), ("a", 299, "y"), ("b", 57, "z"), ("b", 100, "none"), ("c", 0, "none")], "k string, rank long, what string")
    got = {(r.what, r.k, r.o) for r in ranges.pick_ranks(df, picks, "k", ["o"]).collect()}
    assert got == {("x", "a", 1), ("y", "a", 399), ("z", "b", 228)}


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_quantiles(spread, few, monkeypatch):
    monkeypatch.setattr(ranges, "FEW", few)
    monkeypatch.setattr(ranges, "SHARPNESS", 4)
    pick = random.Random(few)
    for n in (1, 2, 7, 400):
        data = [(pick.choice([0.0, 1.5, pick.gauss(0, 1), pick.lognormvariate(0, 20)]), i % 3 == 0 and None or float(i)) for i in range(n)]
        df = spread.createDataFrame(data, "x double, y double")
        asked = {f"{c}{i}": (c, q) for c in "xy" for i, q in enumerate((0.0, 0.01, 0.5, 0.95, 1.0))}
        got = ranges.quantiles(df, asked)
        for name, (c, q) in asked.items():
            values = sorted(r["xy".index(c)] for r in data if r["xy".index(c)] is not None)
            import math

            assert got[name] == (values[max(0, math.ceil(q * len(values)) - 1)] if values else None)
    assert ranges.quantiles(df.limit(0), {"a": ("x", 0.5)}) == {"a": None}


def brute_turns(sizes):
    live, left, cursor, out = sorted(sizes), dict(sizes), 0, []
    while live:
        name = live[cursor % len(live)]
        if not left[name]:
            live.remove(name)
            continue
        out.append((name, sizes[name] - left[name] + 1))
        left[name] -= 1
        cursor += 1
    return out


@pytest.mark.parametrize("seed", range(30))
def test_turns_in_closed_form(seed):
    pick = random.Random(seed)
    sizes = {f"g{i}": pick.choice([0, 1, 2, 3, 9, 30]) for i in range(pick.randint(0, 7))}
    assert sample.round_robin_schedule(sizes) == brute_turns(sizes)
    assert len(sample.round_robin_segments(sizes)) <= len(sizes)


def test_round_robin_by_hours_alone(spread):
    sizes = {"a": 40, "b": 7, "c": 90, "d": 1}
    rows = [(f"{g}{i:03}", g, "train", float(1 + i % 5)) for g, n in sizes.items() for i in range(n)]
    df = spread.createDataFrame(rows, "id string, dataset string, split string, duration double").repartition(4)
    bucket = lambda c: F.length(c) * 0  # noqa: E731  ties, so that ids give the order
    whole = [(g, r) for g, r in brute_turns(sizes)]
    want = [f"{g}{r - 1:03}" for g, r in whole]
    assert [r.id for r in sample.round_robin(df, "train", bucket=bucket).orderBy("position").collect()] == want
    seconds = {r[0]: r[3] for r in rows}
    for hours in (0.0, 10 / 3600, 123 / 3600, 1.0):
        n, s = 0, 0.0
        for key in want:
            n, s = n + 1, s + seconds[key]
            if s >= hours * 3600:
                break
        got = sample.round_robin(df, "train", target_hours=hours, bucket=bucket).orderBy("position")
        assert [r.id for r in got.collect()] == want[:n]
    assert [r.id for r in sample.round_robin(df, "train", max_examples=11, target_hours=1.0, bucket=bucket).orderBy("position").collect()] == want[:11]


def test_stratified_plan_has_no_window_by_stratum(spread):
    df = spread.createDataFrame([(f"{i:04}", ("Dev", "dev", "test")[i % 3]) for i in range(300)], "id string, source_split string").repartition(4)
    got = sample.stratified(df, 10)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("__range" in line for line in plan.split("\n") if "Window" in line)
    by = {k: sorted(r.id for r in df.collect() if r.source_split.lower() == k) for k in ("dev", "test")}
    want = {(k, i, by[k][round(i * (len(by[k]) - 1) / (c - 1))]) for k, c in (("dev", 7), ("test", 3)) for i in range(c)}
    assert {(r.source_split.lower(), r.pick, r.id) for r in got.collect()} == want


@pytest.mark.parametrize("block", [1, 3, 7, 64])
def test_blocks_over_ranges(spread, block):
    pick = random.Random(block)
    docs = [(i, [pick.randrange(9) + 1 for _ in range(pick.choice([0, 1, 5, 40]))]) for i in range(60)]
    stream = [t for _, d in docs if d for t in [*d, 0]]
    got = pack.pack_blocks(spread.createDataFrame(docs, "i int, ids array<int>").repartition(5), "ids", 0, block, ["i"]).orderBy("block_id").collect()
    assert [r.block_id for r in got] == list(range(len(stream) // block)) and [t for r in got for t in r.tokens] == stream[:len(stream) // block * block]
    assert batch.numbered(spread.range(50).repartition(5), ["id"]).where("ord <> id").isEmpty()
