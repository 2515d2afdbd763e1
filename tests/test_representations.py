"""New mechanisms against numpy, plain Python and hand-made fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tsloom.operators import decompose, embed, metrics, models, prepare, represent, sample, schedule, windows
from tsloom.plans import evaluate
from tsloom.plans.registry import QUERIES
from tsloom.sources import arrays, cache, registry, synthetic
from tsloom.streaming.events import event_windows


def long(spark, rows):
    return spark.createDataFrame([(s, t, None if v is None else float(v)) for s, x in rows.items() for t, v in enumerate(x)], "series_id long, t long, value double")


# --- fixtures worked out by hand


def test_context_blocks_leave_out_the_tables_last_block_only(spark):
    """16 steps a block; the longest series has 86: six starts, the last block is left out, and so are blocks with padding."""
    df = long(spark, {1: range(50), 2: range(86), 3: range(15), 4: range(80)})
    got = {(r.series_id, r.block) for r in windows.context_blocks(df, ["series_id"], 16).collect()}
    assert got == {(1, b) for b in range(3)} | {(2, b) for b in range(5)} | {(4, b) for b in range(5)}
    even = windows.context_blocks(long(spark, {1: range(32)}), ["series_id"], 16)  # two starts: the second block is the last
    assert {r.block for r in even.collect()} == {0}


def test_sections_are_even(spark):
    p = spark.createDataFrame([(5, [0.0, 1.0, 2.0, 3.0, 4.0]), (3, [7.0, 8.0, 9.0]), (8, [float(i) for i in range(8)])], "n int, x array<double>")
    got = {(r.n, r.section): r.x for r in windows.sections(p, 4).collect()}
    assert [got[5, k] for k in range(4)] == [[0, 1], [2, None], [3, None], [4, None]]
    assert [got[3, k] for k in range(4)] == [[7], [8], [9], [None]]
    assert [got[8, k] for k in range(4)] == [[0, 1], [2, 3], [4, 5], [6, 7]]


def test_instance_norm_is_over_channels(spark):
    x = np.array([[1.0, 5], [2, 9], [6, 1]])  # steps x channels
    df = spark.createDataFrame([(1, t, c, float(x[t, c])) for t in range(3) for c in range(2)], "series_id int, t int, channel int, value double")
    left = x - x.mean(0)
    want = left / np.sqrt(left.var(axis=1, keepdims=True) + 1e-5)
    for r in prepare.instance_normed(df, ["series_id"], "channel").collect():
        assert r.value == pytest.approx(want[r.t, r.channel])


@pytest.mark.parametrize("channels", [4, 5])
def test_season_basis_counts_turns_from_one(spark, channels):
    t = np.arange(12) / 12
    half = channels // 2
    want = np.array([np.cos(2 * np.pi * p * t) for p in range(1, half + 1)] + [np.sin(2 * np.pi * p * t) for p in range(1, channels - half + 1)])
    x = np.random.default_rng(0).normal(size=12)
    got = {r.channel: r.value for r in decompose.season_projection(long(spark, {1: x}), ["series_id"], 12, channels).collect()}
    assert np.allclose([got[c] for c in range(channels)], want @ x)
    assert decompose.season_count(24) == 12 and decompose.season_count(200) == 32


def test_histogram_leaves_nan_out(spark):
    df = spark.createDataFrame([(0, v) for v in (0.0, 1.0, 10.0, float("nan"), None)] + [(1, 2.0)], "side int, value double")
    got = {(r.side, r.bin): r.p for r in metrics.histogram(df, "side", 10).collect()}
    assert got == {(0, 0): pytest.approx(1 / 3), (0, 1): pytest.approx(1 / 3), (0, 9): pytest.approx(1 / 3), (1, 0): 1}


# --- sliding inference and pooling


@pytest.mark.parametrize("causal", [False, True])
@pytest.mark.parametrize("padding", [0, 3, 50])
def test_sliding_inference_equals_frames_in_numpy(spark, causal, padding):
    rng = np.random.default_rng(padding)
    data = {s: rng.normal(size=n) for s, n in ((1, 1), (2, 7), (3, 8), (4, 30))}
    data[4][5] = np.nan
    encode = represent.dilated_smoother(2)
    df = long(spark, {s: [None if np.isnan(v) else v for v in x] for s, x in data.items()})
    got = {(r.series_id, r.t): r.value for r in represent.sliding_encoded(df, ["series_id"], 8, padding, encode, causal).collect()}
    assert len(got) == sum(map(len, data.values()))
    for s, x in data.items():
        wide = np.concatenate([np.full(padding, np.nan), x, np.full(padding + 8, np.nan)])
        for b in range(0, len(x), 8):
            z = encode(wide[None, b : b + 8 + padding * (1 if causal else 2)])[0, padding : padding + 8]
            for k in range(min(8, len(x) - b)):
                assert got[s, b + k] == pytest.approx(z[k])


def test_multiscale_pooling_equals_windows(spark):
    rng = np.random.default_rng(3)
    data = {s: rng.normal(size=n) for s, n in ((1, 1), (2, 2), (3, 3), (4, 6), (5, 37), (6, 64), (7, 66))}
    got = {(r.series_id, r.p, r.t): r.pooled for r in windows.multiscale_pooled(long(spark, data), ["series_id"]).collect()}
    want = {}
    for s, x in data.items():
        p = 0
        while (1 << p) + 1 < len(x):
            for t in range(len(x)):
                want[s, p, t] = x[max(0, t - (1 << p)) : t + (1 << p) + 1].max()
            p += 1
    assert got == want
    assert windows.multiscale_pooled(long(spark, {}), ["series_id"]).count() == 0


# --- spectra


def test_spectrogram_image_there_and_back(spark):
    rng = np.random.default_rng(5)
    rows = [(i, c, [float(v) for v in rng.normal(size=24) * (c + 1)]) for i in range(20) for c in range(2)]
    df = spark.createDataFrame(rows, "sample int, channel int, x array<double>")
    image = embed.SpectrogramImage(8, 4, 24, 2).fit(df, ["sample"])
    cells = image.transform(df, ["sample"])
    assert {r.channel for r in cells.select("channel").distinct().collect()} == {0, 1, 2, 3}
    lo, hi = cells.agg(F.min("value"), F.max("value")).first()
    assert -1 - 1e-9 <= lo and hi <= 1 + 1e-9
    back = {(r.sample, r.channel): r.x for r in image.inverse(cells, ["sample"]).collect()}
    for i, c, x in rows:
        assert np.allclose(back[i, c], x, atol=1e-5)


def test_stft_of_arrays_of_several_lengths(spark):
    rng = np.random.default_rng(6)
    data = {i: rng.normal(size=n) for i, n in enumerate((9, 12, 12, 20))}
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in data.items()], "i int, x array<double>")
    got = {(r.i, r.frame, r.f): complex(r.re, r.im) for r in embed.stft(df, ["i"], 8, 4).collect()}
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(8) / 8)
    for i, x in data.items():
        p = np.pad(x, 4, mode="reflect")
        for k in range((len(p) - 8) // 4 + 1):
            for f, z in enumerate(np.fft.rfft(p[4 * k : 4 * k + 8] * hann)):
                assert np.isclose(got.pop((i, k, f)), z)
    assert not got


def test_image_spectral_loss_equals_fft2(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(2, 3, 4, 4))
    df = spark.createDataFrame([(i, r, c, float(a[i, r, c]), float(b[i, r, c])) for i in range(3) for r in range(4) for c in range(4)], "i int, r int, c int, a double, b double")
    for row in decompose.image_spectral_loss(df, ["i"], 4, "a", "b").collect():
        gap = a[row.i] - b[row.i]
        z = np.fft.fft2(gap, norm="forward")
        assert row.loss == pytest.approx((z.real**2 + z.imag**2 + gap**2).mean())


# --- orders, masks, drop-out


def test_global_order_with_hot_values_and_nulls(spark):
    rng = np.random.default_rng(8)
    values = [None if v == 9 else 5 if v > 5 else int(v) for v in rng.integers(0, 10, 3000)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i long").repartition(7)
    got = {r.i: r.place for r in sample.globally_sorted(df, ["v", "i"], "place", size="n").collect()}
    want = sorted(range(3000), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert [got[i] for i in want] == list(range(3000))
    assert sample.globally_sorted(df.limit(0), ["v"], "place").count() == 0
    text = spark.createDataFrame([(w,) for w in ("b", "a", None, "c", "b")], "w string")
    assert sorted((r.w or "", r.code) for r in sample.coded(text, "w").collect() if r.w) == [("a", 0), ("b", 1), ("b", 1), ("c", 2)]


def test_no_plan_ranks_a_whole_table_in_one_task(spark, sf_dir):
    """What goes to a single partition is an aggregate's rows (one, or one for each range, worker or side), not a table's."""
    for name in ("argsort_values", "prefix_limit", "category_codes", "shared_prefix", "koopman_operator", "perm_hash", "split_random_80_20", "repeated_epochs", "interleave_batches", "window_context_blocks", "mean_cov"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString() + "\n"
        plan += QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        for k, line in enumerate(lines):
            if "SinglePartition" in line:
                below = lines[k + 1]
                assert "Aggregate" in below or "LocalLimit" in below, (name, line, below)


def test_runs_of_missing_points(spark):
    df = long(spark, {s: range(n) for s, n in ((1, 40), (2, 3), (3, 1))})
    got = {}
    for r in embed.runs_masked(df, ["series_id"], 5, 0.1, 3).collect():
        got.setdefault(r.series_id, {})[r.t] = r.kept
    for s, n in ((1, 40), (2, 3), (3, 1)):
        width = max(int(n * 0.1), 1)
        gone = [t for t, k in got[s].items() if not k]
        assert len(got[s]) == n and width <= len(gone) <= width * max(min(5, n // 2), 1)


def test_exactly_so_many_cells_drop_out(spark):
    df = long(spark, {s: range(s * 37) for s in range(1, 12)}).repartition(5)
    n = df.count()
    for rate in (0.0, 0.1, 0.5, 1.0):
        for least in (1, 4096):
            out = synthetic.cells_dropped_out(df, ["series_id", "t"], rate, 2, least=least)
            assert out.where("value IS NULL").count() == int(n * rate), (rate, least)
    one = {(r.series_id, r.t) for r in synthetic.cells_dropped_out(df, ["series_id", "t"], 0.3, 2, least=1).where("value IS NULL").collect()}
    assert one == {(r.series_id, r.t) for r in synthetic.cells_dropped_out(df, ["series_id", "t"], 0.3, 2).where("value IS NULL").collect()}


# --- noise levels and operators


def test_nearest_noise_level(spark):
    levels = schedule.iddpm_levels()
    assert len(levels) == 1001 and levels[-1] == 0 and all(a > b for a, b in zip(levels, levels[1:]))
    rng = np.random.default_rng(1)
    xs = [0.0, 1e9, levels[0], levels[500], *rng.uniform(0, 100, 200), *rng.uniform(0, 0.1, 50)]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    for r in df.select("x", schedule.nearest_level(F.col("x"), levels).alias("j")).collect():
        assert r.j == int(np.argmin(np.abs(np.array(levels) - r.x)))
    few = [4.0, 2.0, 0.0]
    assert [r.j for r in spark.createDataFrame([(1.0,), (3.0,), (3.1,)], "x double").select(schedule.nearest_level(F.col("x"), few).alias("j")).collect()] == [1, 0, 0]


def _event_paths(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").toPandas().sort_values(["user_id", "ts", "event_id"])
    return {u: np.lib.stride_tricks.sliding_window_view(g.value.to_numpy() / 500, 4) for u, g in e.groupby("user_id")}


def test_penalties_and_roll_out_of_the_tables(spark, sf_dir):
    paths = _event_paths(spark, sf_dir)
    pen = {r.series_id: r for r in QUERIES["eigen_penalties"](spark, sf_dir).collect()}
    roll = {r.series_id: r.error for r in QUERIES["roll_out"](spark, sf_dir).collect()}
    assert set(pen) == set(roll) == set(paths)
    for u, z in paths.items():
        a = np.linalg.lstsq(z[:-1], z[1:], rcond=None)[0]
        size = np.sort(np.abs(np.linalg.eigvals(a)))
        for name, k in (("top2", 2), ("top3", 3), ("every", 4)):
            assert pen[u][name] == pytest.approx(((size[-k:] - 1) ** 2).mean(), abs=2e-5)
        error, hat = 0, z[:-1]
        for k in range(1, 9):
            hat = hat @ a
            part = hat[: len(z) - k]
            error += ((part - z[k:]) ** 2).mean() / np.linalg.norm(part)
        assert roll[u] == pytest.approx(error, abs=2e-5)


# --- scores


def test_scores_of_the_tables(spark, sf_dir):
    """The discriminative score is |1/2 - accuracy|; the predictive one beats the constant forecast of a half."""
    disc = QUERIES["disc_score"](spark, sf_dir).first()
    assert 0 <= disc.disc_mean <= 0.5 and 0 <= disc.disc_std <= 0.25
    pred = QUERIES["pred_score"](spark, sf_dir).first()
    many = QUERIES["pred_score_channels"](spark, sf_dir).first()
    e = spark.read.parquet(f"{sf_dir}/events.parquet").toPandas()
    spread = np.abs(e.value / 500 - (e.value / 500).mean()).mean()
    assert 0 < pred.pred_mean < 1.5 * spread and 0 < many.pred_mean < 1.5 * spread


def test_shorter_series_count_in_the_discriminative_score(spark):
    rng = np.random.default_rng(0)
    low, high = ({i: rng.uniform(a, a + 0.3, 6 if i % 2 else 3) for i in range(80)} for a in (0.1, 0.7))
    assert models.discriminative(long(spark, low), long(spark, high), repeats=2).first().disc_mean == 0.5


def test_prepared_and_generators_take_whole_series(spark):
    df = long(spark, {1: range(10), 2: range(25), 3: range(24)})
    got = evaluate.prepared(df, evaluate.Config(length=8))
    steps = {(r.series_id) for r in got.select("series_id").distinct().collect()}
    assert steps == {"1:0", "1:2", "2:0", "2:8", "2:16", "2:17", "3:0", "3:8", "3:16"}
    assert got.groupBy("series_id").count().where("count <> 8").count() == 0
    for model in (models.Jitter(0.0), models.BlockBootstrap(4)):
        made = model.fit(df).sample(spark, 5, 8, seed=1)
        assert made.groupBy("series_id").count().where("count <> 8").count() == 0
        assert made.select("series_id").distinct().count() == 5
    far = models.BlockBootstrap(4).fit(df).sample(spark, 60, 8, seed=1).agg(F.max("value")).first()[0]
    assert far > 8  # steps beyond the first eight are drawn as well


# --- arrays, cache, stream


def test_arrays_of_rank_three_in_row_ranges(spark, tmp_path):
    a = np.random.default_rng(2).normal(size=(1000, 3, 2))
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", np.arange(24).reshape(4, 3, 2))
    df = arrays.read_arrays(spark, str(tmp_path), rows_per_task=150)
    assert df.rdd.getNumPartitions() == 8
    rows = df.orderBy("file", "row").collect()
    assert np.array_equal(np.array([r.x for r in rows if r.file == "a.npy"]), a)
    assert [r.x for r in rows if r.file == "b.npy"] == np.arange(24).reshape(4, 3, 2).tolist()
    assert df.schema["x"].dataType.simpleString() == "array<array<double>>"
    np.save(tmp_path / "c.npy", np.arange(3))
    with pytest.raises(Exception, match="different ranks"):
        arrays.read_arrays(spark, str(tmp_path)).count()


def test_drop_out_written_back_and_read_again(spark, tmp_path):
    a = np.random.default_rng(3).normal(size=(200, 5))
    np.save(tmp_path / "a.npy", a)
    steps = arrays.read_arrays(spark, str(tmp_path / "a.npy"), 60).select("row", F.posexplode("x").alias("t", "value"))
    gone = synthetic.cells_dropped_out(steps, ["row", "t"], 0.25, 1)
    back = windows.packed(gone, ["row"])
    out = str(tmp_path / "out")
    for _ in range(2):  # the second time over the first
        arrays.write_arrays(back, out, partitions=3, rows_per_file=50)
    again = np.array([r.x for r in arrays.read_arrays(spark, out).orderBy("file", "row").collect()])
    assert again.shape == (200, 5) and np.isnan(again).sum() == 250
    assert np.array_equal(again[~np.isnan(again)], a[~np.isnan(again)])
    arrays.write_arrays(back.limit(0), out, 2)
    assert arrays.read_arrays(spark, out).count() == 0


def test_cache_is_read_while_its_inputs_stand(spark, tmp_path):
    source, folder, built = str(tmp_path / "in"), str(tmp_path / "cache"), []
    spark.range(5).write.parquet(source)

    def build():
        built.append(1)
        return spark.read.parquet(source).selectExpr("id * 2 AS id")

    one = cache.cached(spark, folder, [source], {"k": 2}, build)
    two = cache.cached(spark, folder, [source], {"k": 2}, build)
    assert len(built) == 1 and two.agg(F.sum("id")).first()[0] == 20
    assert all("/cache/" in f for f in two.inputFiles())
    assert sorted(one.inputFiles()) == sorted(two.inputFiles())
    cache.cached(spark, folder, [source], {"k": 3}, build)
    spark.range(1).write.mode("append").parquet(source)
    assert cache.cached(spark, folder, [source], {"k": 2}, build).count() == 6 and len(built) == 3


def test_two_writers_of_one_cache(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "cache")
    spark.range(5).write.parquet(source)

    def build():  # another writer comes first while this one builds
        inner = cache.cached(spark, folder, [source], {}, lambda: spark.read.parquet(source))
        return inner.union(inner)

    assert cache.cached(spark, folder, [source], {}, build).count() == 5


def test_event_windows_do_not_depend_on_arrival(spark, tmp_path):
    kind = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", kind)
    try:
        rng = np.random.default_rng(4)
        rows = pd.DataFrame({"series_id": np.repeat([1, 2, 3], 40), "n": np.tile(np.arange(40), 3)})
        rows["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(rows.n * 5 + rows.series_id, unit="min")
        rows["value"] = rng.integers(0, 100, len(rows)).astype(float)
        order = np.argsort(rows.n + rng.uniform(-6, 6, len(rows)))  # some six steps, half an hour, out of order
        end = pd.DataFrame({"series_id": [9], "n": [0], "ts": [pd.Timestamp("2024-03-01")], "value": [0.0]})
        parts = [*np.array_split(rows.iloc[order], 5), end, end.assign(n=1)]
        schema = "series_id long, n long, ts timestamp, value double"
        for k, p in enumerate(parts):
            spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = event_windows(stream, "series_id", "ts", "n", 8, 3, delay="2 hours")
        q = out.writeStream.format("memory").queryName("in_order").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = sorted((r.series_id, r.start, r["mean"]) for r in spark.table("in_order").collect())
        batch = spark.createDataFrame(rows[["series_id", "n", "value"]]).withColumnRenamed("n", "t")
        want = sorted((r.series_id, r.start, r["mean"]) for r in windows.window_stats(batch, ["series_id"], 8, 3).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


# --- small parts


def test_presets_horizons_and_resolver(spark, tmp_path):
    assert len(registry.PRESETS) == 17 and len(registry.HORIZONS) == 54 and registry.HORIZONS["m4_hourly"] == 48
    lines = ["date,a,OT"] + [f"2020-01-01 00:{k // 60:02d}:{k % 60:02d},{k},{-k}" for k in range(20)]
    (tmp_path / "x.csv").write_text("\n".join(lines))
    df = registry.read(spark, {"data": "ETTh1", "path": str(tmp_path / "x.csv"), "features": "MS"})
    assert set(df.columns) == {"t", "ts", "a", "OT"} and df.count() == 20
    parts = registry.splits({"data": "custom"}, prepare.with_length(df, []), 4)
    assert {k: v.count() for k, v in parts.items()} == {"train": 14, "val": 6, "test": 8}
    assert set(registry.splits({"data": "stock"}, df, 4)) == {"train"}
    with pytest.raises(KeyError, match="ETTh1"):
        registry.read(spark, {"data": "none"})
    made = registry.resolve({"target": "tsloom.operators.models.Jitter", "params": {"share": 0.5}})
    assert isinstance(made, models.Jitter) and made.share == 0.5 and registry.resolve(None) is None
    with pytest.raises(KeyError):
        registry.resolve({"params": {}})


def test_plateau_warms_up_and_cools_down(spark):
    """Worked out by hand: two losses of warm-up to 1.0; then a bad one each step; patience 1, cooldown 2."""
    x = [9.0, 9.0] + [1.0] + [2.0] * 8
    rates = []
    for k in range(1, len(x) + 1):
        df = spark.createDataFrame([(x[:k],)], "x array<double>")
        rates.append(schedule.plateau_rates(df, 0.2, 0.5, 1, warm=2, warm_top=1.0, cooldown=2).first().lr)
    assert rates == pytest.approx([0.6, 1.0, 1.0, 1.0, 0.5, 0.5, 0.5, 0.5, 0.25, 0.25, 0.25])


def test_mixed_trend_of_one_kernel_is_its_average(spark):
    df = long(spark, {1: [1, 5, 2, 8, 3, 9]})
    got = [r.trend for r in decompose.mixed_trend(df, ["series_id"], [4], [0.3], [1.0]).orderBy("t").collect()]
    assert got == [2, 2.25, 4, 4.5, 5.5, 7.25]


def test_moments_far_from_zero(spark):
    x = np.random.default_rng(1).normal(size=(300, 3)) + 5
    df = spark.createDataFrame([(k % 2, [float(u) for u in r]) for k, r in enumerate(x)], "g int, v array<double>").repartition(3)
    means, covs = metrics.moments(df, ["g"], "v", 3)
    for g in (0, 1):
        assert np.allclose([r.mu for r in means.where(f"g = {g}").orderBy("i").collect()], x[g::2].mean(0))
        got = np.array([r["cov"] for r in covs.where(f"g = {g}").orderBy("i", "j").collect()]).reshape(3, 3)
        assert np.allclose(got, np.cov(x[g::2].T))
    one = metrics.moments(df.limit(1), ["g"], "v", 3)[1].collect()
    assert all(r["cov"] is None for r in one)
