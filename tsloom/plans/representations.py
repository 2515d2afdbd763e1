"""Queries of representations, spectra, masks and operators over the driver's tables, with their DuckDB twins.

The module adds to the queries of tsloom.plans.queries, whose series, windows and SQL parts it shares.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tsloom.functions.hashing import digits
from tsloom.operators import decompose, embed, metrics, models, represent, sample, schedule, windows
from tsloom.plans.queries import _COLS, _E, _PLACES, _U, _W, KEY, WINDOW, cut, packs, query, series
from tsloom.session import table
from tsloom.sources.synthetic import cells_dropped_out

# --- sliding inference and pooling

LENGTH, PADDING, DEPTH = 16, 4, 3


def _encoded_sql(causal: bool, pool: int | None, tail: str) -> str:
    """Each block's own frame, layer by layer."""
    wide = LENGTH + PADDING * (1 if causal else 2)
    layer = lambda k: f"l{k + 1} AS (SELECT series_id, block, n, pos, t, 0.25 * lag(v, {1 << k}, 0.0::DOUBLE) OVER w + 0.5 * v + 0.25 * lead(v, {1 << k}, 0.0::DOUBLE) OVER w AS v FROM l{k} WINDOW w AS (PARTITION BY series_id, block ORDER BY pos))"
    last = f"max(v) OVER (PARTITION BY series_id, block ORDER BY pos ROWS BETWEEN {pool // 2} PRECEDING AND {pool - 1 - pool // 2} FOLLOWING)" if pool else "v"
    return f"""WITH {_E}, f AS (SELECT series_id, block, n, pos, block * {LENGTH} - {PADDING} + pos AS t FROM (SELECT DISTINCT series_id, n, t // {LENGTH} AS block FROM e), (SELECT unnest(range(0, {wide})) AS pos)),
l0 AS (SELECT f.series_id, block, f.n, pos, f.t, coalesce(value, 0.0::DOUBLE) AS v FROM f LEFT JOIN e ON e.series_id = f.series_id AND e.t = f.t), {", ".join(map(layer, range(DEPTH)))},
z AS (SELECT series_id, n, pos, t, {last} AS v FROM l{DEPTH}), o AS (SELECT series_id, t, v FROM z WHERE pos >= {PADDING} AND pos < {PADDING + LENGTH} AND t < n) {tail}"""


#: The smoothed values have at most eight places: none is halfway between two roundings.
_STEPS = "SELECT series_id, t, round(v, 8) + 0.0 AS value FROM o"


def _encoded(spark, d, **options):
    return represent.sliding_encoded(series(spark, d), KEY, LENGTH, PADDING, represent.dilated_smoother(DEPTH), **options)


@query(_encoded_sql(False, None, _STEPS))
def sliding_encode(spark, d):
    return _encoded(spark, d).select("series_id", "t", digits(F.col("value"), 8).alias("value"))


@query(_encoded_sql(True, None, _STEPS))
def sliding_encode_causal(spark, d):
    return _encoded(spark, d, causal=True).select("series_id", "t", digits(F.col("value"), 8).alias("value"))


@query(_encoded_sql(False, 5, _STEPS))
def sliding_encode_pooled(spark, d):
    return _encoded(spark, d, window=5).select("series_id", "t", digits(F.col("value"), 8).alias("value"))


@query(_encoded_sql(False, None, "SELECT series_id, round(max(v), 8) + 0.0 AS value FROM o GROUP BY 1"))
def sliding_encode_series(spark, d):
    return _encoded(spark, d, window="series").select("series_id", digits(F.col("value"), 8).alias("value"))


@query(f"""WITH {_E}, p AS (SELECT unnest(range(0, 30)) AS p), x AS (SELECT series_id, t, p, n, max(value) OVER (PARTITION BY series_id, p ORDER BY t ROWS BETWEEN (1 << p) PRECEDING AND (1 << p) FOLLOWING) AS pooled FROM e JOIN p ON (1 << p) + 1 < n)
SELECT series_id, t, p::INT AS p, round(pooled, 6) + 0.0 AS pooled FROM x""")
def max_pool_multiscale(spark, d):
    return windows.multiscale_pooled(series(spark, d), KEY).select("series_id", "t", "p", digits(F.col("pooled")).alias("pooled"))


@query(f"WITH {_E} SELECT series_id, round(max(value), 6) + 0.0 AS pooled FROM e GROUP BY 1")
def max_pool_series(spark, d):
    return windows.whole_pooled(series(spark, d), KEY).select("series_id", digits(F.col("pooled")).alias("pooled"))


# --- spectrogram images

_CUT2 = _W.replace("SELECT DISTINCT series_id, start, t - start AS t, value FROM", "SELECT DISTINCT series_id, start, t - start AS t, value, hour(ts)::DOUBLE AS hour FROM")
_FRAMES = f"""{_CUT2}, ch AS (SELECT series_id, start, t, unnest([0, 1]) AS channel, unnest([value, hour]) AS value FROM w),
x AS (SELECT series_id, start, channel, frame, k, abs(frame * 4 + k - 4) AS p FROM (SELECT DISTINCT series_id, start, channel FROM ch), (SELECT unnest(range(0, 7)) AS frame), (SELECT unnest(range(0, 8)) AS k)),
v AS (SELECT x.series_id, x.start, x.channel, frame, k, value * (0.5 - 0.5 * cos(2 * pi() * k / 8)) AS v FROM x JOIN ch ON ch.series_id = x.series_id AND ch.start = x.start AND ch.channel = x.channel AND ch.t = least(p, 46 - p)),
z AS (SELECT series_id, start, channel, frame, f, sum(v * cos(2 * pi() * f * k / 8)) AS re, sum(-v * sin(2 * pi() * f * k / 8)) AS im FROM v, (SELECT unnest(range(0, 5)) AS f) GROUP BY 1, 2, 3, 4, 5),
c AS (SELECT series_id, start, channel, frame, f, re AS value FROM z UNION ALL SELECT series_id, start, channel + 2, frame, f, im FROM z),
m AS (SELECT *, min(value) OVER g AS lo, max(value) OVER g AS hi FROM c WINDOW g AS (PARTITION BY channel, frame, f))"""


def _two_channels(spark, d):
    """series_id, start, channel, x of windows of 24 steps: the values, and the hours."""
    s = windows.covering_windows(series(spark, d).select("series_id", "t", "value", F.hour("ts").cast("double").alias("hour")), KEY, 24)
    both = F.array(F.struct(F.lit(0).alias("channel"), F.col("value").alias("v")), F.struct(F.lit(1).alias("channel"), F.col("hour").alias("v")))
    long = s.select("series_id", "start", F.col("pos").alias("t"), F.explode(both).alias("b")).select("series_id", "start", "t", "b.channel", F.col("b.v").alias("value"))
    return windows.packed(long, [*WINDOW, "channel"])


# parts whose range is rounding noise (an imaginary part that is 0) would be scaled up to anything: both sides leave out cells of no width
@query(f"WITH {_FRAMES} SELECT series_id, start, channel::INT AS channel, frame::INT AS frame, f::INT AS f, round(((value - lo) / (hi - lo + 1e-7) - 0.5) * 2, 5) + 0.0 AS value FROM m WHERE hi - lo > 1e-6")
def stft_image(spark, d):
    x = _two_channels(spark, d)
    image = embed.SpectrogramImage(8, 4, 24, 2).fit(x, WINDOW)
    wide = image.fitted.where("hi - lo > 1e-6").select("channel", "frame", "f")
    cells = image.transform(x, WINDOW).join(wide, ["channel", "frame", "f"], "left_semi")
    return cells.select(*WINDOW, "channel", "frame", "f", digits(F.col("value"), 5).alias("value"))


@query(f"WITH {_CUT2} SELECT series_id, start, t, unnest([0, 1])::INT AS channel, round(unnest([value, hour]), 3) + 0.0 AS value FROM w")
def stft_image_inverse(spark, d):
    """There and back: the series that went in."""
    x = _two_channels(spark, d)
    image = embed.SpectrogramImage(8, 4, 24, 2).fit(x, WINDOW)
    back = image.inverse(image.transform(x, WINDOW), WINDOW)
    return back.select(*WINDOW, "channel", F.posexplode("x").alias("t", "value")).select(*WINDOW, F.col("t").cast("long").alias("t"), "channel", digits(F.col("value"), 3).alias("value"))


@query(f"""WITH {_W}, p(c, a, m) AS (VALUES {_PLACES}), x AS (SELECT series_id, start, c, (t - a) AS r, value - 250 AS g FROM w JOIN p ON t >= a AND t < a + m),
s AS (SELECT series_id, start, fr, fc, sum(g * cos(2 * pi() * (fr * r + fc * c) / 8)) AS re, sum(-g * sin(2 * pi() * (fr * r + fc * c) / 8)) AS im FROM x, (SELECT unnest(range(0, 8)) AS fr), (SELECT unnest(range(0, 8)) AS fc) GROUP BY 1, 2, 3, 4),
q AS (SELECT series_id, start, sum(g * g) AS time FROM x GROUP BY 1, 2)
SELECT series_id, start, round((sum(re * re + im * im) / 4096 + any_value(time)) / 64, 4) + 0.0 AS loss FROM s JOIN q USING (series_id, start) GROUP BY 1, 2""")
def fourier_loss_2d(spark, d):
    cells = embed.delay_embedded(cut(spark, d), 24, 8, 5).withColumn("guess", F.lit(250.0))
    return decompose.image_spectral_loss(cells, WINDOW, 8, "value", "guess").select(*WINDOW, digits(F.col("loss"), 4).alias("loss"))


# --- orders, masks and drop-out


@query("SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS place, dense_rank() OVER (ORDER BY user_id) - 1 AS user_code FROM events")
def argsort_values(spark, d):
    """The place of each event in the order of all values, and the code of its user among all users."""
    e = sample.coded(table(spark, d, "events").select("event_id", "value", "user_id"), "user_id", "user_code")
    placed = sample.globally_sorted(e, ["value", "event_id"], "place")
    return placed.select("event_id", "place", F.col("user_code").cast("long").alias("user_code"))


_RUN_START = f"CAST(floor({_U.format("series_id || ':' || i || ':8'")} * (n - l + 1)) AS BIGINT)"


@query(f"""WITH {_E}, k AS (SELECT series_id, n, greatest(least(floor(n * 0.1::DOUBLE)::BIGINT, n // 2), 1) AS k, greatest(floor(n * 0.05::DOUBLE)::BIGINT, 1) AS l FROM (SELECT DISTINCT series_id, n FROM e)),
r AS (SELECT series_id, {_RUN_START} AS s, l FROM (SELECT *, unnest(range(0, k)) AS i FROM k)),
g AS (SELECT DISTINCT e.series_id, e.t FROM e JOIN r ON r.series_id = e.series_id AND e.t >= s AND e.t < s + l)
SELECT e.series_id, e.t, CAST(g.t IS NULL AS INT) AS runs, CAST({_U.format("e.series_id || ':' || e.t || ':2'")} >= 0.5 AS INT) AS binomial, CAST(e.t <> n - 1 AS INT) AS last FROM e LEFT JOIN g ON g.series_id = e.series_id AND g.t = e.t""")
def masks_drawn(spark, d):
    s = embed.runs_masked(series(spark, d), KEY, 0.1, 0.05, 8, name="runs")
    return s.select("series_id", "t", "runs", embed.random_mask(0.5, F.col("series_id"), F.col("t"), 2).alias("binomial"), embed.last_mask(F.col("t"), F.col("n")).alias("last"))


@query(f"""WITH {_E}, r AS (SELECT series_id, t, value, row_number() OVER (ORDER BY md5(series_id || ':' || t || ':6'), series_id, t) AS k, count(*) OVER () AS all_ FROM e)
SELECT series_id, t, CASE WHEN k > floor(all_ * 0.1::DOUBLE) THEN round(value, 6) + 0.0 END AS value FROM r""")
def drop_out_cells(spark, d):
    s = cells_dropped_out(series(spark, d).select("series_id", "t", "value"), ["series_id", "t"], 0.1, 6)
    return s.select("series_id", "t", digits(F.col("value")).alias("value"))


# --- noise levels and operators


@query("""WITH RECURSIVE u(j, u) AS (SELECT 1000, 0.0::DOUBLE UNION ALL SELECT j - 1, sqrt((u * u + 1) / greatest(pow(sin(0.5 * pi() * (j - 1) / 1000 / 1.008), 2) / pow(sin(0.5 * pi() * j / 1000 / 1.008), 2), 0.001) - 1) FROM u WHERE j > 0),
e AS (SELECT event_id, value / 10 AS v FROM events), b AS (SELECT event_id, arg_min(j, [abs(u - v), j::DOUBLE]) AS j FROM e, u GROUP BY 1)
SELECT event_id, 1.0::DOUBLE AS c_skip, round(-v, 6) + 0.0 AS c_out, round(1 / sqrt(v * v + 1), 6) + 0.0 AS c_in, 999 - j AS c_noise FROM e JOIN b USING (event_id)""")
def iddpm_precond(spark, d):
    c = schedule.preconditioning(F.col("value") / 10.0, kind="iddpm")
    return table(spark, d, "events").select("event_id", *[digits(c[n]).alias(n) for n in ("c_skip", "c_out", "c_in")], c["c_noise"].cast("int").alias("c_noise"))


DIM = 4


def _paths(spark, d):
    """series_id, t, z: four consecutive values of each event series, in [0, 1], as one vector."""
    line = Window.partitionBy("series_id").orderBy("t")
    z = F.array(*[F.lead(F.col("value") / 500.0, k).over(line) for k in range(DIM)])
    return series(spark, d).select("series_id", "t", "n", z.alias("z")).where(F.col("t") <= F.col("n") - DIM).drop("n")


def _operators(spark, d):
    nxt = F.lead("z").over(Window.partitionBy("series_id").orderBy("t"))
    pairs = _paths(spark, d).withColumn("_y", nxt).where("_y IS NOT NULL").select("series_id", F.col("z").alias("_x"), "_y")
    return models.operators_of(pairs, KEY, DIM)


@query()
def eigen_penalties(spark, d):
    """Of one matrix for each series: how far the magnitudes of its largest two, three and of all eigenvalues are from 1."""
    p = models.eigenvalue_penalties(_operators(spark, d), KEY, DIM)
    return p.select("series_id", *[digits(F.col(c)).alias(c) for c in ("top2", "top3", "every")])


@query()
def roll_out(spark, d):
    """The error of each series' matrix over eight steps."""
    e = models.roll_out_error(_paths(spark, d), _operators(spark, d), KEY, "t", "z", DIM, 8)
    return e.select("series_id", digits(F.col("error")).alias("error"))


@query()
def pred_score_channels(spark, d):
    """Three channels, the last one predicted from the others: trained on the windows of even users, judged on those of odd ones."""
    e = series(spark, d).select("series_id", "t", (F.hour("ts") / 23.0).alias("hour"), (F.minute("ts") / 59.0).alias("minute"), (F.col("value") / 500.0).alias("value"))
    w = windows.covering_windows(e, KEY, 24).select((F.col("series_id") % 2).alias("side"), F.concat_ws(":", "series_id", "start").alias("series_id"), F.col("pos").alias("t"), "hour", "minute", "value")
    return models.predictive(w.where("side = 1").drop("side"), w.where("side = 0").drop("side"), channels=["hour", "minute", "value"])


# --- trends, rates and counts


def _average(k: int) -> str:
    after = (k - 1) // 2
    before = k - 1 - after
    frame = "(PARTITION BY series_id ORDER BY t"
    return f"(sum(value) OVER {frame} ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING) + greatest(0, {before} - t) * first_value(value) OVER {frame}) + greatest(0, t + {after} - (n - 1)) * first_value(value) OVER {frame} DESC)) / {k}"


@query(f"""WITH {_E}, m AS (SELECT series_id, t, value, {_average(4)} AS a, {_average(9)} AS b, exp(0.01::DOUBLE * value) AS wa, exp(2 - 0.01::DOUBLE * value) AS wb FROM e), x AS (SELECT *, (a * wa + b * wb) / (wa + wb) AS trend FROM m)
SELECT series_id, t, round(trend, 6) + 0.0 AS trend, round(value - trend, 6) + 0.0 AS season FROM x""")
def trend_mixed(spark, d):
    m = decompose.mixed_trend(series(spark, d).select("series_id", "t", "value"), KEY, [4, 9], [0.01, -0.01], [0.0, 2.0])
    return m.select("series_id", "t", digits(F.col("trend")).alias("trend"), digits(F.col("season")).alias("season"))


@query(f"WITH {_W}, p(c, a, m) AS (VALUES {_PLACES}) SELECT series_id, start, c::INT AS c, r::INT AS r, round(coalesce(value, 0), 6) + 0.0 AS value FROM (SELECT DISTINCT series_id, start FROM w) k CROSS JOIN p CROSS JOIN (SELECT unnest(range(0, 8)) AS r) LEFT JOIN w USING (series_id, start) WHERE w.t = a + r OR (r >= m AND w.t = a)".replace("coalesce(value, 0)", "CASE WHEN r < m THEN value ELSE 0 END"))
def square_unpad(spark, d):
    """Padded to a square and back: the columns of the delay embedding, with the zero tail of the last one."""
    cells = embed.delay_embedded(cut(spark, d), 24, 8, 5)
    image = windows.square_unpadded(windows.square_padded(cells, 8, WINDOW), 8, len(_COLS))
    return image.select(*WINDOW, "c", "r", digits(F.col("value")).alias("value"))


@query(f"""WITH RECURSIVE {_E}, r(series_id, t, best, bad, cool, lr) AS (SELECT DISTINCT series_id, -1::BIGINT, 'inf'::DOUBLE, 0, 0, 0.0001::DOUBLE FROM e UNION ALL
SELECT series_id, t, CASE WHEN NOT warming AND better THEN value ELSE best END, CASE WHEN warming THEN bad WHEN worse > 2 THEN 0 ELSE worse END, CASE WHEN warming THEN cool WHEN worse > 2 THEN 4 ELSE greatest(cool - 1, 0) END,
  CASE WHEN warming THEN lr + (0.001::DOUBLE - 0.0001::DOUBLE) / 5 WHEN worse > 2 AND lr - greatest(lr * 0.5, 0.00002::DOUBLE) > 1e-8::DOUBLE THEN greatest(lr * 0.5, 0.00002::DOUBLE) ELSE lr END
FROM (SELECT *, CASE WHEN better OR cool > 0 THEN 0 ELSE bad + 1 END AS worse FROM (SELECT e.series_id, e.t, e.value, r.best, r.bad, r.cool, r.lr, e.t < 5 AS warming, e.value < r.best * (1 - 0.0001::DOUBLE) AS better FROM r JOIN e ON e.series_id = r.series_id AND e.t = r.t + 1)))
SELECT r.series_id, round(lr, 9) + 0.0 AS lr FROM r JOIN e ON r.series_id = e.series_id AND r.t = e.t WHERE r.t = n - 1""")
def plateau_warm_lr(spark, d):
    rates = schedule.plateau_rates(packs(spark, d), 0.0001, 0.5, 2, least=0.00002, warm=5, warm_top=0.001, cooldown=4)
    return rates.select("series_id", digits(F.col("lr"), 9).alias("lr"))


_SHORT = "CASE WHEN {0} > 1073741824 THEN round_even({0} / 1073741824.0::DOUBLE, 2)::VARCHAR || 'G' WHEN {0} > 1048576 THEN round_even({0} / 1048576.0::DOUBLE, 2)::VARCHAR || 'M' WHEN {0} > 1024 THEN round_even({0} / 1024.0::DOUBLE, 2)::VARCHAR || 'K' ELSE {0}::VARCHAR END"


@query(f"""WITH p AS (SELECT p_brand AS brand, sum(p_size) FILTER (p_partkey % 3 <> 0) AS a, sum(p_size) AS c FROM part GROUP BY 1), q AS (SELECT brand, coalesce(a, 0)::BIGINT AS a, (c - coalesce(a, 0))::BIGINT AS b, c::BIGINT AS c FROM p UNION ALL SELECT 'overall', sum(coalesce(a, 0))::BIGINT, sum(c - coalesce(a, 0))::BIGINT, sum(c)::BIGINT FROM p)
SELECT brand, {_SHORT.format("a")} AS trainable, {_SHORT.format("b")} AS non_trainable, {_SHORT.format("c")} AS total FROM q""")
def parameter_counts(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").cast("long").alias("size"), (F.col("p_partkey") % 3 != 0).alias("trains"))
    return metrics.parameter_counts(p, "brand", "size", "trains")
