"""Queries against their twins on small tables with odd values."""

import datetime
from pathlib import Path

import oracle
import pytest

from tsloom.plans.registry import QUERIES, SQL


def events(spark, folder, sf_dir, values, users=None):
    """A folder with a table of events of these values, in order, and the other tables."""
    for f in Path(sf_dir).glob("*.parquet"):
        if f.stem != "events":
            (folder / f.name).symlink_to(f)
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, day + datetime.timedelta(minutes=i), users[i] if users else i % 3, "view", v, None) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["edm_precond", "ve_precond", "vp_precond"])
def test_a_level_of_zero(spark, tmp_path, sf_dir, name):
    d = events(spark, tmp_path, sf_dir, [0.0, -0.0, 5.0, 120.25, None])
    assert oracle.compare(spark, QUERIES[name], SQL[name], d) == 5


@pytest.mark.parametrize("name", ["split_ratio_70_10_20", "std_scale_fit_train", "window_slide_stats"])
def test_a_share_that_is_a_whole_number(spark, tmp_path, sf_dir, name):
    """0.7 * 90 is less than 63 in doubles."""
    users = [0] * 90 + [1] * 10 + [2] * 30 + [3] * 73
    d = events(spark, tmp_path, sf_dir, [(i * 7919) % 1009 / 3 for i in range(len(users))], users)
    assert oracle.compare(spark, QUERIES[name], SQL[name], d) > 0


def test_own_odd_values_are_not_planted_holes(spark, tmp_path, sf_dir):
    nan, inf = float("nan"), float("inf")
    d = events(spark, tmp_path, sf_dir, [nan, nan, None, inf, -inf, 1.5, -0.0, None, 1e300, inf, 3.0, None, 2.0, 4.0])
    assert oracle.compare(spark, QUERIES["nan_to_zero"], SQL["nan_to_zero"], d) == 14


@pytest.mark.parametrize(
    ("name", "values"),
    [
        ("nan_to_zero", [None, 2.0583435, 4.1578195, 8.0468555, 1e300, -8.0468555, 1.0000005, 1e-7, 1.7976931348623157e308]),
        ("ve_precond", [None, 5.093865, 6.971715, 40.393775, 0.0, 9.380856639585881e299]),
        ("edm_precond", [None, 0.0017157809236311465, 0.0, 120.25, -3.5]),
    ],
)
def test_halves_of_the_last_digit(spark, tmp_path, sf_dir, name, values):
    """The seventh digit is a 5 in decimals, not in doubles."""
    d = events(spark, tmp_path, sf_dir, values)
    assert oracle.compare(spark, QUERIES[name], SQL[name], d) == len(values)
