import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tsloom.functions import timefeat
from tsloom.operators import decompose, embed, metrics, models, prepare, sample, schedule, windows
from tsloom.plans.evaluate import Config, evaluate
from tsloom.plans.registry import QUERIES
from tsloom.sources import files, registry
from tsloom.streaming.windows import count_windows


def frame(spark, values, name="s"):
    return spark.createDataFrame([(name, i, None if v is None else float(v)) for i, v in enumerate(values)], "series_id string, t long, value double")


def values(df, column="value"):
    return [r[column] for r in df.orderBy("t").collect()]


def test_moving_average_repeats_its_ends(spark):
    assert values(decompose.moving_average(frame(spark, [1, 5, 2, 8, 3, 9]), ["series_id"], 4), "trend") == [2, 2.25, 4, 4.5, 5.5, 7.25]


def test_interpolation(spark):
    run = lambda v: values(prepare.interpolated(frame(spark, v), ["series_id"]))
    assert run([None, 2, None, None, 8, None]) == [2, 2, 4, 6, 8, 8]
    assert run([None, None]) == [None, None]


def test_window_counts(spark):
    f = frame(spark, range(10))
    assert windows.window_stats(f, ["series_id"], 4).count() == 7
    assert windows.window_stats(f, ["series_id"], 4, tail=False).count() == 6
    assert windows.window_stats(f, ["series_id"], 4, 3).count() == 3
    assert windows.exploded_windows(f, ["series_id"], 4, 3).count() == 12
    assert spark.range(1).select(windows.window_count(F.lit(10), 4, 3), windows.window_count(F.lit(3), 4)).first()[:] == (3, 0)


def test_delay_columns_and_inverse(spark):
    assert embed.delay_columns(24, 8, 8) == [(0, 8), (8, 8), (16, 8)]
    assert embed.delay_columns(10, 4, 3) == [(0, 4), (3, 4), (6, 4), (9, 1)]
    f = frame(spark, range(10))
    cells = embed.delay_embedded(f, 10, 4, 3)
    assert values(embed.delay_inverse(cells, ["series_id"], 3)) == list(range(10))
    with pytest.raises(ValueError):
        embed.delay_embedded(f, 100, 2, 1)


def test_scalers_invert(spark):
    f = frame(spark, [0, 5, 10])
    fit = prepare.stats(f, ["series_id"])
    z = prepare.scaled(f, fit, ["series_id"], "minmax", 1e-7)
    assert values(z) == pytest.approx([0, 0.5, 1], abs=1e-6)
    assert values(prepare.unscaled(z, fit, ["series_id"], "minmax", 1e-7)) == pytest.approx([0, 5, 10])
    flat = frame(spark, [3, 3])
    assert values(prepare.scaled(flat, prepare.stats(flat, []), [], "standard")) == [0, 0]


def test_splits(spark):
    f = prepare.with_length(frame(spark, range(101)), ["series_id"])
    got = {k: (p.agg(F.min("t")).first()[0], p.agg(F.max("t")).first()[0] + 1) for k, p in prepare.ratio_split(f, 4).items()}
    assert got == {"train": (0, 70), "val": (66, 81), "test": (77, 101)}
    hours = spark.range(14400).withColumnRenamed("id", "t")
    got = {k: (p.agg(F.min("t")).first()[0], p.agg(F.max("t")).first()[0] + 1) for k, p in prepare.calendar_split(hours, 24).items()}
    assert got == {"train": (0, 8640), "val": (8616, 11520), "test": (11496, 14400)}


def test_subset_wraps_around(spark):
    ranks = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, rank long")
    rows = sample.subset(ranks, F.lit(7)).orderBy("slot").collect()
    assert [r.rank for r in rows] == [0, 1, 2, 0, 1, 2, 0]
    assert sample.batched(ranks, 2, [], drop_last=True).count() == 2


def test_permutation_is_a_bijection_for_any_partitioning(spark):
    one = sample.globally_ranked(spark.range(500, numPartitions=1), 4, F.col("id")).orderBy("rank").collect()
    many = sample.globally_ranked(spark.range(500, numPartitions=7), 4, F.col("id")).orderBy("rank").collect()
    assert one == many and [r["rank"] for r in one] == list(range(500)) and [r["id"] for r in one] != list(range(500))


def test_interleaving_keeps_order_within_a_dataset(spark):
    b = spark.createDataFrame([(x, i) for x, n in (("a", 5), ("b", 9)) for i in range(n)], "dataset string, batch long")
    rows = sample.interleaved(b, "dataset", "batch", 1).orderBy("slot").collect()
    assert [r.batch for r in rows if r.dataset == "b"] == list(range(9)) and [r.slot for r in rows] == list(range(14))


def test_frequencies():
    assert timefeat.BY_UNIT["H"][0] == "hour_of_day"
    with pytest.raises(ValueError):
        timefeat.features_of("xyz", None)


def test_distances(spark):
    v = spark.createDataFrame([(i % 2, float(i // 2)) for i in range(100)], "side long, value double")
    assert metrics.jensen_shannon(metrics.histogram(v, "side"), "side", 0, 1).first().jsd == 0
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    rows = [(s, [float(u) for u in r]) for s in (0, 1) for r in x]
    df = spark.createDataFrame(rows, "side int, v array<double>")
    assert metrics.frechet(df, "side", "v", 3).first().fid == pytest.approx(0, abs=1e-6)
    pc = metrics.projected(df, "side", 0, "v").where("side = 0").agg(F.avg("pc1"), F.var_samp("pc1")).first()
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert pc[0] == pytest.approx(0, abs=1e-9) and pc[1] == pytest.approx(s[0] ** 2 / 59)


def test_moments_match_numpy(spark):
    x = np.random.default_rng(1).normal(size=(40, 3))
    df = spark.createDataFrame([(0, [float(u) for u in r]) for r in x], "g int, v array<double>")
    _, covs = metrics.moments(df, ["g"], "v", 3)
    got = np.zeros((3, 3))
    for r in covs.collect():
        got[r.i, r.j] = r["cov"]
    assert np.allclose(got, np.cov(x.T))


def test_spectrum_and_stft(spark):
    x = np.random.default_rng(2).normal(size=24)
    f = frame(spark, x)
    want = np.fft.rfft(x)[1:12]
    rows = decompose.spectrum(f, ["series_id"], 24).orderBy("f").collect()
    assert np.allclose([complex(r.re, r.im) for r in rows], want)
    p = windows.packed(f, ["series_id"])
    back = embed.istft(embed.stft(p, ["series_id"], 8, 4), ["series_id"], 8, 4, 24).first().x
    assert np.allclose(back, x)


def test_scores_tell_apart_and_predict(spark):
    rng = np.random.default_rng(0)
    as_frame = lambda x: spark.createDataFrame([(i, t, float(v)) for i, r in enumerate(x) for t, v in enumerate(r)], "series_id long, t long, value double")
    low, same, high = (as_frame(rng.uniform(a, a + 0.4, (60, 6))) for a in (0, 0, 0.6))
    assert models.discriminative(low, high, repeats=2).first().disc_mean == 0.5
    assert models.discriminative(low, same, repeats=2).first().disc_mean < 0.35
    walk = as_frame([[0.9**t * (i + 1) for t in range(8)] for i in range(30)])
    assert models.predictive(walk, walk, repeats=2).first().pred_mean < 1e-3
    two = walk.withColumn("other", F.col("value") * 2).withColumn("target", F.lag("other", 1, 0.0).over(Window.partitionBy("series_id").orderBy("t")))
    assert models.predictive(two, two, repeats=2, channels=["value", "other", "target"]).first().pred_mean < 1e-3
    assert models.predictive(low, high, repeats=2).first().pred_mean > 0.2


def test_koopman_and_components_of_the_tables(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    want = np.linalg.lstsq(x[:-1], x[1:], rcond=None)[0]
    got = np.zeros((64, 64))
    for r in QUERIES["koopman_operator"](spark, sf_dir).collect():
        got[r.i, r.j] = r.a
    assert np.allclose(got, want, atol=2e-5)
    side = np.array([r.vec_id % 2 for r in rows])
    centred = x[side == 0] - x[side == 0].mean(0)
    v = np.linalg.svd(centred, full_matrices=False)[2][:2]
    v *= np.sign(v[np.arange(2), np.abs(v).argmax(1)])[:, None]
    p = {r.vec_id: (r.pc1, r.pc2) for r in QUERIES["pca2"](spark, sf_dir).collect()}
    assert np.allclose([p[r.vec_id] for r in rows], (x - x[side == 0].mean(0)) @ v.T, atol=2e-3)
    c = [np.cov(x[side == s].T) for s in (0, 1)]
    m = x[side == 0].mean(0) - x[side == 1].mean(0)
    roots = np.sqrt(np.linalg.eigvals(c[0] @ c[1]).astype(complex)).real.sum()
    assert QUERIES["fid_full"](spark, sf_dir).first().fid == pytest.approx(m @ m + np.trace(c[0]) + np.trace(c[1]) - 2 * roots, abs=1e-4)


def test_names_of_sizes_and_durations(spark):
    n = spark.createDataFrame([(x,) for x in (0, 1024, 1025, 1536, 2**20, 3 * 2**19, 2**30 + 1, 5 * 2**30)], "n long")
    assert [r[0] for r in n.select(metrics.size_name(F.col("n"))).collect()] == ["0", "1024", "1.0K", "1.5K", "1024.0K", "1.5M", "1.0G", "5.0G"]
    s = spark.createDataFrame([(x,) for x in (5.9, 65.0, 3723.0, 2 * 86400 + 3723.0)], "s double")
    assert [r[0] for r in s.select(metrics.duration_name(F.col("s"))).collect()] == ["05s", "01m:05s", "01h:02m:03s", "2d:01h:02m:03s"]


def test_samplers_keep_known_points(spark):
    sig = [r.sigma for r in schedule.edm_steps(spark, 12).orderBy("step").collect()]
    known = spark.createDataFrame([(0, [1.0, None, 3.0])], "series_id long, x array<double>")
    rows = {r.series_id: r.x for r in models.heun(spark, lambda x, s: x / (1 + s * s), sig, 3, 3, 0, known).collect()}
    assert rows[0][0] == 1.0 and rows[0][2] == 3.0 and len(rows) == 3 and np.isfinite(rows[0]).all()
    bars = [r.alpha_bar for r in schedule.alpha_bars(schedule.cosine_betas(spark, 20)).orderBy("step").collect()]
    out = models.ddpm(spark, lambda x, step: np.full_like(x, 0.5), bars, 4, 5, 0, eta=0.0, steps=5).collect()
    assert np.allclose([r.x for r in out], 0.5)


def test_generators_and_run(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = prepare.indexed(e.withColumnRenamed("user_id", "series_id"), ["series_id"], ["ts", "event_id"]).select("series_id", "t", "value")
    for g in (models.AutoRegression(), models.Jitter(), models.BlockBootstrap()):
        out = g.fit(s).sample(spark, 8, 12, 0)
        assert out.count() == 96 and {"series_id", "t", "value"} <= set(out.columns)
    c = Config(length=12, subset_p=0.5, repeats=1, iterations=10, metrics=["disc", "jsd", "fid"])
    rows = {(r.dataset, r.metric): r.value for r in evaluate(spark, {"a": s, "b": s}, models.AutoRegression(), c).collect()}
    assert rows["a", "pred_mean"] == -1 and rows["mean", "jsd"] == pytest.approx(rows["a", "jsd"], abs=1e-4) and len(rows) == 18


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,x,OT,y\n2020-01-01 00:00:00,1,2,3\n2020-01-01 01:00:00,4,,6\n")
    df = registry.read(spark, {"data": "dated_csv", "path": str(tmp_path / "a.csv")})
    assert [tuple(r)[1:4] for r in df.orderBy("t").collect()] == [(1.0, 3.0, 2.0), (4.0, 6.0, None)] and df.columns == ["ts", "x", "y", "OT", "t"]
    back = files.numeric_csv(spark, str(tmp_path / "a.csv"), (1, 3), reverse=True)
    assert [r.x for r in back.orderBy("t").collect()] == [4.0, 1.0]
    assert files.anomaly_csv(spark, str(tmp_path / "a.csv"), drop_first=True, label_last=True).columns == ["t", "x", "OT"]
    folder = tmp_path / "ts"
    folder.mkdir()
    (folder / "Toy_TRAIN.ts").write_text("@problem\n@data\n1,2,?:4,5:A\n7,NaN:9:B\n")
    (folder / "Toy_TEST.ts").write_text("@data\n1:2:C\n")
    nested = files.classification_text(spark, str(folder), "train")
    assert [(r.label, r.dims) for r in nested.orderBy("sample_id").collect()] == [("A", [[1, 2, None], [4, 5]]), ("B", [[7, None], [9]])]
    assert files.nested_to_long(nested).count() == 8
    (tmp_path / "i.json").write_text("\n".join(json.dumps({"item_id": k, "start": "2020-01-01", "target": v}) for k, v in (("a", [1, 2]), ("b", [3, 4]))))
    items = files.item_series(spark, str(tmp_path / "i.json"))
    assert [tuple(r) for r in files.stacked_items(items, ["a", "b"]).orderBy("t").collect()] == [(0, 1.0, 3.0), (1, 2.0, 4.0)]
    np.save(tmp_path / "m.npy", np.arange(6).reshape(3, 2))
    assert [r.x for r in files.numpy_arrays(spark, str(tmp_path)).orderBy("t").collect()] == [[0, 1], [2, 3], [4, 5]]
    registry.register_source("range", lambda s, n: s.range(n))
    assert registry.read(spark, {"data": "range", "n": 3}).count() == 3
    with pytest.raises(KeyError):
        registry.read(spark, {"data": "none"})
    files.save_frames({"k": df}, str(tmp_path / "out"))
    assert files.load_frames(spark, str(tmp_path / "out"), ["k"])["k"].count() == 2
    scores = spark.createDataFrame([("a", 1, "m", 0.5)], "dataset string, epoch int, metric string, value double")
    sink = files.fan_out([lambda d: files.append_scores(d, str(tmp_path / "s1")), lambda d: files.append_scores(d, str(tmp_path / "s2"))])
    sink(scores)
    sink(scores)
    assert spark.read.parquet(str(tmp_path / "s2")).count() == 2


def test_stream_of_windows_equals_batch(spark, tmp_path):
    s = pd.DataFrame({"series_id": [1, 2] * 20, "t": [i // 2 for i in range(40)], "value": [float(i * i % 17) for i in range(40)]})
    for k in (0, 1):
        spark.createDataFrame(s[(s.t >= 10) == k]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series_id long, t long, value double").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = count_windows(stream, "series_id", 4, 2).writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(tuple(r) for r in spark.table("w").select("series_id", "start", "mean").collect())
    want = windows.window_stats(spark.createDataFrame(s), ["series_id"], 4, 2).select("series_id", "start", "mean").collect()
    assert got == sorted(tuple(r) for r in want)


def test_embedding_of_other_shapes(spark):
    p = spark.createDataFrame([("a", [None, 1.0, 2.0, None, None, None])], "series_id string, x array<double>")
    assert p.select(windows.centred("x")).first()[0] == [None, None, 1.0, 2.0, None, None]
    assert windows.sections(p, 4).count() == 4
    assert models.summary_embedding(spark.createDataFrame([("a", [1.0, 3.0])], "s string, x array<double>")).first().embedding == [2, 1, 1, 3, 1, 3, 1]
