"""Window states, grid, splits, scaling, ranges, digests."""
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from netstate.config import Options
from netstate.operators import chunks
from netstate.operators.grid import index_states, regular_states
from netstate.operators.scaling import Scaler
from netstate.operators.sequences import with_samples, with_split
from netstate.operators.states import window_distincts, window_states
from netstate.plans.events import event_flows
from netstate.schema import feature_names
from netstate.session import materialize
from tests.conftest import moment

O = Options(window_seconds=3600)


def states_at(spark, seconds, options=None):
    options = options or Options()
    rows = [("s", moment(x)) for x in seconds]
    base = spark.createDataFrame(rows, "source string, timestamp timestamp_ntz")
    return base.select("*", *[F.lit(1.0).alias(n) for n in feature_names(options)], F.lit(0.0).alias("attack_flows"),
                       F.lit(0.0).alias("attack_fraction"), F.lit("Benign").alias("stage"),
                       F.lit(False).alias("is_attack"), F.lit(False).alias("filled"))


def test_gap_fill_and_segments(spark):
    grid = regular_states(states_at(spark, [0, 10, 40, 5400, 5400]), Options()).orderBy("row").collect()
    assert [r["filled"] for r in grid] == [False, False, True, True, False, False]
    assert [r["segment"] for r in grid] == [0] * 5 + [1]
    assert [r["pos"] for r in grid] == [0, 1, 2, 3, 4, 0]
    assert all(r["flow_count"] == 0 and r["scan_score"] == 0 for r in grid if r["filled"])


def test_gap_limit(spark):
    o = Options(chunk_windows=4)
    assert regular_states(states_at(spark, [0, 70]), o).agg(F.max("segment")).first()[0] == 0
    assert regular_states(states_at(spark, [0, 80]), o).agg(F.max("segment")).first()[0] == 1


def test_chunks_do_not_matter(spark, sf):
    o = Options(window_seconds=600)
    table = materialize(window_states(event_flows(spark, sf, o), o), "t")
    results = [regular_states(table, o.having(chunk_windows=c), 19).select(
        "source", "segment", "pos", "seg_len", "row", "source_rows", "filled", "timestamp") for c in (5, 4096)]
    assert results[0].exceptAll(results[1]).isEmpty() and results[1].exceptAll(results[0]).isEmpty()


def test_partitions_do_not_matter(spark, sf):
    """Sums may come in another order, so features agree to 1e-9, everything else exactly."""
    names = feature_names(O)
    one, many = (window_states(event_flows(spark, sf).repartition(n), O) for n in (1, 7))
    both = one.join(many.select("source", "timestamp", F.col("stage").alias("_stage"),
                                *[F.col(n).alias(f"_{n}") for n in names]), ["source", "timestamp"], "full_outer")
    off = [F.abs(F.col(n) - F.col(f"_{n}")) > 1e-9 * (1 + F.abs(n)) for n in names]
    wrong = F.coalesce(F.array_contains(F.array(*off), True) | (F.col("stage") != F.col("_stage")), F.lit(True))
    assert both.where(wrong).isEmpty()


def test_stage_tie_goes_to_first_stage(spark):
    flow = event_flows(spark, "/root/testdata/sf0.001").limit(1)
    stages = F.explode(F.array(*[F.lit(s) for s in ["Impact", "Reconnaissance", "Impact", "Reconnaissance"]]))
    row = window_states(flow.drop("stage").select("*", stages.alias("stage")), O).first()
    assert row["stage"] == "Reconnaissance" and row["is_attack"]


def test_approximate_distinct_is_close(spark, sf):
    exact = window_distincts(event_flows(spark, sf), O).agg(F.sum("unique_src_ips")).first()[0]
    rough = window_distincts(event_flows(spark, sf), O.having(approximate_distinct=True)).agg(
        F.sum("unique_src_ips")).first()[0]
    assert abs(exact - rough) < 0.1 * exact


@pytest.fixture(scope="module")
def table(spark):
    from netstate.plans.registry import regular
    return regular(spark, "/root/testdata/sf0.01")


def test_split_counts(table):
    got = {r["split"]: r["n"] for r in with_split(table, O).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"train": 1008, "val": 144, "test": 288}
    n = with_samples(table, O).where("is_sample").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in n} == {"train": 906, "val": 110, "test": 220}


@pytest.mark.parametrize("strategy", ["blocked", "day_chronological", "chronological"])
def test_no_sample_crosses_a_split(table, strategy):
    o = O.having(split_strategy=strategy)
    rows = with_samples(table, o).select("source", "segment", "pos", "split", "is_sample").collect()
    split = {(r["source"], r["segment"], r["pos"]): r["split"] for r in rows}
    for r in rows:
        if r["is_sample"]:
            span = {split.get((r["source"], r["segment"], p)) for p in range(r["pos"] - 11, r["pos"] + 7)}
            assert span == {r["split"]}


def test_index_of_a_loaded_table(table):
    again = index_states(table, O).select("source", "timestamp", F.col("pos").alias("p"), F.col("row").alias("r"))
    assert again.join(table, ["source", "timestamp"]).where("p <> pos or r <> row").isEmpty()


def test_scaler(spark, table):
    s = Scaler.fit(table, O)
    assert s == Scaler.from_json(s.to_json()) and s == Scaler.from_params(s.params(spark))
    assert not s.active[s.names.index("urg_count")]
    z = s.transform(table).agg(F.avg("flow_count").alias("m"), F.stddev_pop("flow_count").alias("d"),
                               F.max(F.abs("urg_count")).alias("u")).first()
    assert abs(z["m"]) < 1e-9 and abs(z["d"] - 1) < 1e-9 and z["u"] == 0
    with pytest.raises(ValueError):
        s.transform(table.drop("flow_count"))


@pytest.mark.parametrize("chunk", [4096, 3])
def test_one_time_line_over_all_sources(spark, chunk):
    """Two levels give the rank of a plain sort, with one group of sources or several."""
    rows = [(f"host-{s:02d}", 0, i, moment(3600 * i)) for s in range(17) for i in range(40) if (s * 7 + i) % 5]
    states = spark.createDataFrame(rows, "source string, segment int, pos long, timestamp timestamp_ntz")
    options = Options(window_seconds=3600, split_strategy="chronological", chunk_windows=chunk)
    got = {(r["source"], r["pos"]): r["split"] for r in with_split(states, options).collect()}
    line = sorted(rows, key=lambda r: (r[3], r[0]))
    span, n = options.history + options.horizon, len(line)
    train, val = int(n * options.train_fraction), int(n * (options.train_fraction + options.val_fraction))
    want = {(r[0], r[2]): "train" if i < train else "val" if train + span <= i < val else "test" if i >= val + span else "gap"
            for i, r in enumerate(line)}
    assert got == want


def test_value_ranges_are_bounded(spark):
    """Ranges of a skewed distribution hold at most so many rows, in the order of the values; equal ones stay together."""
    rng = np.random.default_rng(2)
    values = [(k, float(v)) for k in "ab" for v in np.exp(rng.normal(0, 6, 3000))] + [("a", 1e6 + i * 1e-9) for i in range(2000)] + [("b", 7.0)] * 500
    df = spark.createDataFrame(values, "k string, v double")
    rows = chunks.by_value_chunks(df, ["k"], "v", most=100).collect()
    by_range = {}
    for r in rows:
        by_range.setdefault((r["k"], r["_vchunk"]), []).append(r["v"])
    assert len(rows) == len(values) and len(by_range) > 60
    assert all(len(v) <= 100 or len(set(v)) == 1 for v in by_range.values())
    for k in "ab":
        edges = [(min(v), max(v)) for (key, _), v in sorted(by_range.items()) if key == k]
        assert all(x[1] < y[0] for x, y in zip(edges, edges[1:]))
    whole = chunks.by_value_chunks(df, ["k"], "v")
    assert whole.agg(F.countDistinct("_vchunk")).first()[0] == 1


def test_file_digests(spark, tmp_path):
    import hashlib

    from netstate.operators import quality
    rng = np.random.default_rng(4)
    sizes = {"a/one.bin": 1, "a/two.bin": 10, "b.bin": 1000, "c/d/e.bin": 5000}
    for name, size in sizes.items():
        (tmp_path / "x" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "x" / name).write_bytes(rng.bytes(size))

    def node(parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def root(leaves, fan):
        while True:
            leaves = [node(leaves[i:i + fan]) for i in range(0, len(leaves), fan)]
            if len(leaves) == 1:
                return leaves[0]
    got = {r["path"].split("/x/")[-1]: r for r in quality.file_digests(spark, str(tmp_path / "x"), 100, 4).collect()}
    for name, size in sizes.items():
        data = (tmp_path / "x" / name).read_bytes()
        blocks = [hashlib.sha256(data[i:i + 100]).hexdigest() for i in range(0, max(1, size), 100)]
        assert (got[name]["length"], got[name]["blocks"], got[name]["digest"]) == (size, len(blocks), root(blocks, 4))
    shutil.copytree(tmp_path / "x", tmp_path / "y")
    first, copy = (quality.fingerprint(spark, str(tmp_path / d)) for d in "xy")
    assert quality.unchanged(first, copy) and first.first()["files"] == 4 and first.first()["bytes"] == 6011
    (tmp_path / "y" / "b.bin").write_bytes(b"other")
    assert not quality.unchanged(first, quality.fingerprint(spark, str(tmp_path / "y")))
