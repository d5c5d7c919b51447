"""File sources and sinks: raw CSV, cached CSV, parquet, JSON reports, marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import parse_year_month
from ..schema import MONEY, RAW_SCHEMA, RAW_TO_FACT


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw purchase lines, all text. A splittable scan; a bad line becomes nulls."""
    return spark.read.schema(RAW_SCHEMA).csv(path, header=True, mode="PERMISSIVE")


def raw_to_fact(raw: DataFrame) -> DataFrame:
    """Raw text columns -> typed fact columns; unreadable numbers become null.

    The raw file has neither prices nor a row key. Prices are null, and the key is a digest of
    the whole line, so lines equal in every column share it.
    """
    typed = {
        "year_month": lambda c: parse_year_month(c),
        "rooms": lambda c: c.try_cast("double"),
        "spend": lambda c: c.try_cast(MONEY),
    }
    keep = typed.get
    line = F.to_json(F.struct(*[F.col(f"`{source}`") for source in raw.columns]))
    return raw.select(F.sha2(line, 256).alias("row_id"), *[
        keep(name, lambda c: c)(F.col(f"`{source}`")).alias(name)
        for source, name in RAW_TO_FACT.items()],
        *[F.lit(None).cast(MONEY).alias(name) for name in ("list_price", "savings")])


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             names: list[str] | None = None) -> DataFrame:
    """A small cached CSV with a declared schema; ``names`` renames by position."""
    df = spark.read.schema(schema).csv(path, header=True)
    return df.toDF(*names) if names else df


def read_keyed_csv(spark: SparkSession, path: str, key: str, schema: T.StructType) -> DataFrame:
    """A CSV whose first column is a nameless row key; it becomes an ordinary column."""
    df = spark.read.schema(schema).csv(path, header=True)
    return df.withColumnRenamed(df.columns[0], key)


def snake_case(df: DataFrame) -> DataFrame:
    """Column names in lower case with underscores."""
    return df.toDF(*[name.lower().replace(" ", "_") for name in df.columns])


def read_report(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A metric frame as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_mart(df: DataFrame, path: str, by_month: bool = True, months: list[int] | None = None) -> None:
    """A mart as parquet, in place of the one that was there.

    With ``months`` only these are replaced, and a month that has become empty goes. Rows of
    a month meet in a bounded number of tasks: the month alone would send a hot month to one
    writer, so the rebalance may split it.
    """
    if not by_month:
        df.write.mode("overwrite").parquet(path)
        return
    mode = "static" if months is None else "dynamic"
    (df.hint("rebalance", "year_month").write.mode("overwrite")
     .option("partitionOverwriteMode", mode).partitionBy("year_month").parquet(path))
    if months is not None:
        found = df.select("year_month").distinct().collect()  # at most the months asked for
        _drop_months(df.sparkSession, path, set(months) - {row[0] for row in found})


def _drop_months(spark: SparkSession, path: str, months: set[int]) -> None:
    """Removes the partitions of a mart's months, by the file system that holds it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for month in months:
        partition = hadoop(path, f"year_month={month}")
        partition.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(partition, True)


def read_mart(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def refresh_mart(fact: DataFrame, build, path: str, months: list[int]) -> None:
    """Rebuild only the given months of a month-grained mart."""
    changed = fact.filter(F.col("year_month").isin(months))
    write_mart(build(changed), path, months=months)


def file_fingerprint(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, lengths and times of the files under the paths; their content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select(
        F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string")).alias("f"))
    # The sum of digests is the same in any order, and one number comes back.
    row = found.agg(F.sum(F.xxhash64("f").cast("decimal(38,0)")).alias("a"), F.sum(F.hash("f").cast("long")).alias("b"), F.count("*")).first()
    return "/".join(map(str, row))
