"""What the jobs share."""

from __future__ import annotations

import json
import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def config(spark: SparkSession, path: str | None, known: dict) -> dict:
    """A config file in JSON over the values that a job has without one; a name it does not know is an error."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if set(given) - set(known):
        raise ValueError(f"unknown settings: {sorted(set(given) - set(known))}")
    return known | given


def there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table by its path; without rows where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    """Equal columns, nulls too."""
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def logged() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
