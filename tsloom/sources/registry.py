"""Readers by key, and the catalogue of datasets."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsloom.operators import prepare
from tsloom.sources import arrays, files, synthetic

Reader = Callable[..., DataFrame]
READERS: dict[str, Reader] = {
    "dated_csv": files.dated_csv,
    "numeric_csv": files.numeric_csv,
    "anomaly_csv": files.anomaly_csv,
    "classification_text": files.classification_text,
    "item_series": files.item_series,
    "numpy": files.numpy_arrays,
    "arrays": arrays.read_arrays,
    "parquet": lambda spark, path: spark.read.parquet(path),
    "sine": synthetic.sines,
}


@dataclass(frozen=True)
class Preset:
    """A known dataset: its reader, the arguments that its files ask for, and how its series are split (or not)."""

    reader: str
    args: dict[str, Any] = field(default_factory=dict)
    split: Callable[[DataFrame, int], dict[str, DataFrame]] | None = None


def _months(per_hour: int) -> Callable[[DataFrame, int], dict[str, DataFrame]]:
    return lambda df, look_back: prepare.calendar_split(df, look_back, per_hour)


#: Fixed keys of known datasets.
PRESETS: dict[str, Preset] = {
    "ETTh1": Preset("dated_csv", split=_months(1)),
    "ETTh2": Preset("dated_csv", split=_months(1)),
    "ETTm1": Preset("dated_csv", split=_months(4)),
    "ETTm2": Preset("dated_csv", split=_months(4)),
    "custom": Preset("dated_csv", split=prepare.ratio_split),
    "PSM": Preset("anomaly_csv", {"drop_first": True}, prepare.same_start_split),
    "MSL": Preset("numpy", split=prepare.same_start_split),
    "SMAP": Preset("numpy", split=prepare.same_start_split),
    "SMD": Preset("numpy", split=prepare.same_start_split),
    "SWAT": Preset("anomaly_csv", {"label_last": True}, prepare.same_start_split),
    "UEA": Preset("classification_text"),
    "gluonts": Preset("item_series"),
    "sine": Preset("sine"),
    "stock": Preset("numeric_csv", {"reverse": True}),
    "energy": Preset("numeric_csv", {"reverse": True}),
    "mujoco": Preset("arrays"),
    "AirQuality": Preset("numeric_csv", {"columns": (2, 15), "reverse": True}),
}

#: Fixed horizons of known collections of item series.
HORIZONS: dict[str, int] = {
    "exchange_rate": 30, "solar-energy": 24, "electricity": 24, "traffic": 24, "exchange_rate_nips": 30, "electricity_nips": 24, "traffic_nips": 24,
    "solar_nips": 24, "wiki2000_nips": 30, "wiki-rolling_nips": 30, "taxi_30min": 24, "kaggle_web_traffic_without_missing": 59,
    "kaggle_web_traffic_weekly": 8, "m1_yearly": 10, "m1_quarterly": 8, "m1_monthly": 18, "nn5_daily_without_missing": 56, "nn5_weekly": 8,
    "tourism_monthly": 24, "tourism_quarterly": 8, "tourism_yearly": 4, "cif_2016": 12, "wind_farms_without_missing": 60,
    "car_parts_without_missing": 12, "dominick": 8, "fred_md": 12, "pedestrian_counts": 48, "hospital": 12, "covid_deaths": 30,
    "kdd_cup_2018_without_missing": 48, "weather": 30, "m3_monthly": 18, "m3_quarterly": 8, "m3_yearly": 6, "m3_other": 8, "m4_hourly": 48,
    "m4_daily": 14, "m4_weekly": 13, "m4_monthly": 18, "m4_quarterly": 8, "m4_yearly": 6, "uber_tlc_daily": 7, "uber_tlc_hourly": 24,
    "airpassengers": 12, "australian_electricity_demand": 60, "electricity_hourly": 48, "electricity_weekly": 8, "rideshare_without_missing": 48,
    "saugeenday": 30, "solar_10_minutes": 60, "solar_weekly": 5, "sunspot_without_missing": 30, "temperature_rain_without_missing": 30,
    "vehicle_trips_without_missing": 30,
}


def splits(config: dict, df: DataFrame, look_back: int) -> dict[str, DataFrame]:
    """The parts of a known dataset's series (columns t, n), by the key of its config; datasets without a split are one part, train."""
    preset = PRESETS.get(config["data"])
    return preset.split(df, look_back) if preset and preset.split else {"train": df}


def resolve(config: dict | None) -> Any:
    """What a config names: target is a module and an attribute of it, joined by a dot, params its keyword arguments. None for None."""
    if config is None:
        return None
    if "target" not in config:
        raise KeyError("a config names its target")
    module, _, name = config["target"].rpartition(".")
    return getattr(importlib.import_module(module), name)(**config.get("params", {}))


def register_source(key: str, reader: Reader) -> None:
    READERS[key] = reader


def read(spark: SparkSession, config: dict) -> DataFrame:
    """The frame of a config: data names the reader, or a known dataset with its reader and arguments; the rest are arguments."""
    args = dict(config)
    key = args.pop("data")
    if key in PRESETS:
        key, args = PRESETS[key].reader, PRESETS[key].args | args
    if key not in READERS:
        raise KeyError(f"no reader {key!r}; known: {', '.join(sorted([*READERS, *PRESETS]))}")
    return READERS[key](spark, **args)


@dataclass(frozen=True)
class Catalogue:
    """Ordered dataset names; a class id is a place in the list, the first `pretrain` names are for pretraining."""

    names: list[str]
    pretrain: int = 0

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, i) for i, n in enumerate(self.names)], "name string, class_id int").withColumn("pretrain", F.col("class_id") < self.pretrain)

    def chosen(self, wanted: list[str]) -> list[str]:
        """The wanted names in catalogue order."""
        return [n for n in self.names if n in set(wanted)]
