"""Equality of results as bags of rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import Files


def differences(left: DataFrame, right: DataFrame) -> tuple[int, int]:
    """Rows of each side that the other lacks, counted with repeats; order doesn't matter, NaN equals NaN."""
    if left.dtypes != right.dtypes:
        raise ValueError(f"schemas differ: {left.dtypes} and {right.dtypes}")
    return left.exceptAll(right).count(), right.exceptAll(left).count()


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    return left.dtypes == right.dtypes and differences(left, right) == (0, 0)


def compare_outputs(spark, expected_dir: str, actual_dir: str, clients: list[str] | None = None, queries: list[str] | None = None) -> dict[str, str]:
    """'OK', 'DIFFERENT' or 'MISSING' for each client/query.csv that the first folder has, or some of them.

    Values that are numbers throughout a column on both sides are compared as numbers, others as text. A client that
    the second folder lacks as a whole is reported by its folder alone.
    """
    expected, actual = Files(spark, expected_dir), Files(spark, actual_dir)
    read = lambda path, **options: spark.read.options(header=True, **options).csv(path)
    out = {}
    for client in clients or expected.names(expected_dir):
        if not actual.exists(f"{actual_dir}/{client}"):
            out[client] = "MISSING"
            continue
        for query in queries or [f.removesuffix(".csv") for f in expected.names(f"{expected_dir}/{client}") if f.endswith(".csv")]:
            name = f"{client}/{query}.csv"
            if not expected.exists(f"{expected_dir}/{name}"):
                continue
            if not actual.exists(f"{actual_dir}/{name}"):
                out[name] = "MISSING"
                continue
            sides = [f"{folder}/{name}" for folder in (expected_dir, actual_dir)]
            kinds = [dict(read(side, inferSchema=True).dtypes) for side in sides]
            number = [c for c in kinds[0] if all(re.match("(int|bigint|double|decimal)", k.get(c, "")) for k in kinds)]
            left, right = (read(side).select(*[F.col(f"`{c}`").try_cast("double").alias(c) if c in number else F.col(f"`{c}`") for c in k]) for side, k in zip(sides, kinds, strict=True))
            out[name] = "OK" if same_rows(left, right) else "DIFFERENT"
    return out


def all_match(compared: dict[str, str]) -> bool:
    return all(verdict == "OK" for verdict in compared.values())
