"""Kernels that leave a row with a message where they fail, beside the results of all other groups.

A guarded operator has one more column, ``error``: null on results, and on a failed group's single row its message, with
the group's keys set and all else null. Only errors of the kernel are turned into rows; what Spark itself fails on still
fails the job.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 2000


def message(gone: BaseException) -> str:
    return f"{type(gone).__name__}: {gone}"[:LONGEST]


def with_error(schema: str, guard: bool) -> str:
    return f"{schema}, error string" if guard else schema


def names(schema: str) -> list[str]:
    return [c.split()[0].strip("`") for c in schema.split(", ")]


def guarded(run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: list[str], guard: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A group's kernel; with ``guard``, its failure becomes a row of the group's keys and the message."""
    if not guard:
        return run
    columns = [*names(schema), "error"]

    def safe(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return run(pdf).assign(error=None)[columns]
        except Exception as gone:  # noqa: BLE001 - whatever the kernel raises is this group's result
            row = {c: pdf[c].iloc[0] if c in keys else None for c in columns}
            return pd.DataFrame([row | {"error": message(gone)}], columns=columns, dtype=object)

    return safe


def results(df: DataFrame) -> DataFrame:
    return df.where("error is null").drop("error")


def failures(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each failed key: the least of its messages and how many groups of it failed."""
    return df.where("error is not null").groupBy(*keys).agg(F.min("error").alias("message"), F.count("*").alias("n_failed"))
