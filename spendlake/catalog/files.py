"""Sources and sinks: data derived from the given tables is written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions import rounded
from ..operators import rollup
from ..schema import RAW_TO_FACT, SIZE_BUCKETS
from ..session import scratch_path, stored
from ..sources import files, snapshots, star
from .base import fact, query, r, sql, state_month

_BY_SEGMENT = f"""
SELECT segment, count(spend) AS n, {r('sum(spend)')} AS spend FROM fact GROUP BY segment"""


@query("S01_raw_csv_scan", sql(_BY_SEGMENT, "fact"))
def raw_csv(spark, folder):
    df = fact(spark, folder)
    month = F.concat_ws("-", F.floor(F.col("year_month") / 100), F.lpad((F.col("year_month") % 100).cast("string"), 2, "0"))
    have = set(df.columns)
    raw = df.withColumn("year_month", month).select(
        F.lit(None).cast("string").alias("Year Name"),
        *[(F.col(name) if name in have else F.lit(None)).cast("string").alias(source)
          for source, name in RAW_TO_FACT.items()])
    path = scratch_path(spark, "raw-csv")
    files.write_csv(raw, path)
    back = files.raw_to_fact(files.read_raw_csv(spark, path)).filter("year_month IS NOT NULL")
    return back.groupBy("segment").agg(
        F.count("spend").alias("n"), rounded(F.sum("spend"), 4).alias("spend"))


_STATE_MONTH = sql(f"SELECT state, year_month, {r('spend')} AS spend FROM state_month", "state_month")


@query("S02_cached_csv", _STATE_MONTH)
def cached_csv(spark, folder):
    path = scratch_path(spark, "state-csv")
    files.write_csv(state_month(spark, folder).toDF("State", "Year Month", "Spend"), path)
    schema = T.StructType([T.StructField("State", T.StringType()),
                           T.StructField("Year Month", T.IntegerType()),
                           T.StructField("Spend", T.DoubleType())])
    df = files.read_csv(spark, path, schema, ["state", "year_month", "spend"])
    return df.withColumn("spend", rounded(F.col("spend"), 4))


@query("S03_keyed_csv", sql(_BY_SEGMENT, "fact"))
def keyed_csv(spark, folder):
    stats = rollup.key_stats(fact(spark, folder, "segment", "spend"), "segment")
    path = scratch_path(spark, "keyed-csv")
    files.write_csv(stats.select(F.col("segment").alias("key"), "transactions", "total_spend"), path)
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("n", T.LongType()),
                           T.StructField("spend", T.DoubleType())])
    df = files.read_keyed_csv(spark, path, "segment", schema)
    return df.withColumn("spend", rounded(F.col("spend"), 4))


@query("S04_parquet_scan", f"""
SELECT l_returnflag AS flag, count(*) AS n, {r('sum(CAST(l_extendedprice AS DECIMAL(18,4)))')} AS spend
FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag""")
def parquet_scan(spark, folder):
    return (star.table(spark, folder, "lineitem").filter("l_quantity > 25")
            .groupBy(F.col("l_returnflag").alias("flag"))
            .agg(F.count("*").alias("n"),
                 rounded(F.sum(F.col("l_extendedprice").cast("decimal(18,4)")), 4).alias("spend")))


@query("S05_snake_case_names", _STATE_MONTH)
def snake_names(spark, folder):
    df = files.snake_case(state_month(spark, folder).toDF("State", "Year Month", "Spend"))
    return df.withColumn("spend", rounded(F.col("spend"), 4))


@query("S06_json_report_read", sql(_BY_SEGMENT, "fact"))
def json_report(spark, folder):
    path = scratch_path(spark, "report")
    files.write_report(fact(spark, folder, "segment", "spend").groupBy("segment").agg(
        F.count("spend").alias("n"), rounded(F.sum("spend"), 4).alias("spend")), path)
    schema = T.StructType([T.StructField("segment", T.StringType()), T.StructField("n", T.LongType()),
                           T.StructField("spend", T.DoubleType())])
    return files.read_report(spark, path, schema)


@query("S07_parquet_mart", _STATE_MONTH)
def parquet_mart(spark, folder):
    path = scratch_path(spark, "mart")
    files.write_mart(state_month(spark, folder), path)
    return files.read_mart(spark, path).select(
        "state", F.col("year_month").cast("int"), rounded(F.col("spend"), 4).alias("spend"))


@query("S08_csv_sink", sql(_BY_SEGMENT, "fact"))
def csv_sink(spark, folder):
    path = scratch_path(spark, "sink-csv")
    files.write_csv(rollup.key_stats(fact(spark, folder, "segment", "spend"), "segment").select(
        "segment", F.col("transactions").alias("n"), F.col("total_spend").alias("spend")), path)
    df = spark.read.schema("segment string, n long, spend double").csv(path, header=True)
    return df.withColumn("spend", rounded(F.col("spend"), 4))


@query("S09_json_sink", sql(f"""
SELECT year_month, {r('sum(spend)')} AS spend FROM fact GROUP BY year_month""", "fact"))
def json_sink(spark, folder):
    path = scratch_path(spark, "sink-json")
    files.write_report(fact(spark, folder, "year_month", "spend").groupBy("year_month").agg(
        rounded(F.sum("spend"), 4).alias("spend")), path)
    return spark.read.schema("year_month int, spend double").json(path)


@query("S10_mart_refresh", sql(f"""
SELECT segment, year_month, {r('sum(spend)')} AS spend FROM fact
WHERE cat_l1 <> 'PROMO' OR year_month IN (200001, 200002) GROUP BY segment, year_month""", "fact"))
def mart_refresh(spark, folder):
    """A mart without one category, then two months rebuilt from the whole fact."""
    df = fact(spark, folder, "segment", "year_month", "cat_l1", "spend")
    build = lambda part: part.groupBy("segment", "year_month").agg(F.sum("spend").alias("spend"))
    path = scratch_path(spark, "refresh")
    files.write_mart(build(df.filter("cat_l1 <> 'PROMO'")), path)
    files.refresh_mart(df, build, path, [200001, 200002])
    return files.read_mart(spark, path).select(
        "segment", F.col("year_month").cast("int"), rounded(F.col("spend"), 4).alias("spend"))


@query("S10_snapshot_refresh", sql(f"""
SELECT segment, year_month, {r('sum(spend)')} AS spend, '200001,200002' AS rebuilt, 0 AS rebuilt_again
FROM fact GROUP BY segment, year_month""", "fact"))
def snapshot_refresh(spark, folder):
    """The mart finds the two months in which its source has changed; a further refresh has nothing to do.

    The lines are joined and written once: each refresh reads them for its fingerprints, and again to build.
    """
    df = stored(fact(spark, folder, "segment", "year_month", "cat_l1", "spend"), "lines")
    build = lambda part: part.groupBy("segment", "year_month").agg(F.sum("spend").alias("spend"))
    path = scratch_path(spark, "snapshots")
    snapshots.refresh(df.filter("cat_l1 <> 'PROMO' OR year_month NOT IN (200001, 200002)"), build, path)
    rebuilt = snapshots.refresh(df, build, path)
    again = snapshots.refresh(df, build, path)
    return snapshots.read(spark, path, build(df).schema).select(
        "segment", "year_month", rounded(F.col("spend"), 4).alias("spend"),
        F.lit(",".join(map(str, rebuilt))).alias("rebuilt"), F.lit(len(again)).alias("rebuilt_again"))


@query("S11_literal_dimension", sql(f"""
SELECT b.size_bucket, b.size_no, count(p.customer_id) AS customers, {r('coalesce(sum(p.spend), 0)')} AS spend
FROM (VALUES ('<100 rooms', 1), ('100–250', 2), ('250–500', 3), ('500–1000', 4), ('1000+', 5)) b(size_bucket, size_no)
LEFT JOIN (SELECT *, CASE WHEN rooms < 100 THEN '<100 rooms' WHEN rooms < 250 THEN '100–250'
   WHEN rooms < 500 THEN '250–500' WHEN rooms < 1000 THEN '500–1000' ELSE '1000+' END AS size_bucket
   FROM props) p ON p.size_bucket = b.size_bucket GROUP BY ALL""", "props"))
def literal_dimension(spark, folder):
    sizes = spark.createDataFrame(list(zip(SIZE_BUCKETS, range(1, 6))), "size_bucket string, size_no int")
    props = rollup.properties(fact(spark, folder, "segment", "customer_id", "rooms", "spend"))
    placed = props.withColumn("size_bucket", rollup.size_bucket())
    return sizes.join(placed, "size_bucket", "left").groupBy("size_bucket", "size_no").agg(
        F.count("customer_id").alias("customers"),
        rounded(F.coalesce(F.sum("spend"), F.lit(0)), 4).alias("spend"))
