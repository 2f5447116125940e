"""Registry of the analytic jobs: name, Spark job and, where SQL can say it, oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from originline.plans.workspace import Workspace, workspace

Job = Callable[[Workspace], DataFrame]
JOBS: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def job(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    """Register a job under a query key, with the SQL its result must equal."""

    def keep(fn: Job) -> Job:
        if name in JOBS:
            raise ValueError(f"{name} is registered twice")
        JOBS[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def callable_for(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn = JOBS[name]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(workspace(spark, folder))

    run.__name__ = name
    return run
