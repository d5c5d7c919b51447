"""Dimension tables: state factors, event calendar, uplift, segment labels.

``fixed`` holds the default tables. A user's own tables are CSVs of the same columns.
"""

from __future__ import annotations

import csv
import os

from pyspark.sql import DataFrame, SparkSession, types as T

from ..schema import EVENT_SCHEMA, LABEL_SCHEMA, UPLIFT_SCHEMA

STATE_SCHEMA = T.StructType([T.StructField("state", T.StringType())] + [
    T.StructField(c, T.DoubleType()) for c in ("population_m", "gdp_b", "tourism_b", "hotel_rooms_k")])
SCHEMAS = {"state_reference": STATE_SCHEMA, "event_calendar": EVENT_SCHEMA,
           "event_uplift": UPLIFT_SCHEMA, "segment_labels": LABEL_SCHEMA}


def read_dimension(spark: SparkSession, name: str, path: str | None = None) -> DataFrame:
    """A dimension from a CSV every executor can reach, or the fixed table when no path is given.

    The fixed tables ship with the package on the driver, hold fewer than 200 rows each,
    and become literal frames.
    """
    schema = SCHEMAS[name]
    if path:
        return spark.read.schema(schema).csv(path, header=True, comment="#")
    here = os.path.join(os.path.dirname(__file__), "fixed", f"{name}.csv")
    casts = [{"string": str, "integer": int, "double": float}[f.dataType.typeName()] for f in schema.fields]
    with open(here, encoding="utf-8", newline="") as lines:
        rows = list(csv.reader(line for line in lines if not line.startswith("#")))[1:]
    return spark.createDataFrame([tuple(c(v) for c, v in zip(casts, row)) for row in rows], schema)
