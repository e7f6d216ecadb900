"""The reference operators' queries by name, over the tables that stand in for images, series and feature matrices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analysis, imaging, modelling, monitoring, quality

FLAGSHIP = "control_chart"
PLANS = (imaging, monitoring, modelling, quality, analysis)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for plan in PLANS for f in plan.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.ORACLES.items()}
