"""Declared schemas. Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)

#: Raw purchase lines as they arrive: all text, in file order.
RAW_COLUMNS = [
    "Year Name", "Year Month", "Business Entity Type", "Country",
    "Customer Market Segment Id", "Client ID", "Customer Id", "Customer Brand Id",
    "Customer Brand Parent Id", "City", "State", "Zip", "Number of Rooms",
    "Ecommerce Status", "Distributor ID", "Distributor Group", "Manufacturer ID",
    "Category ID", "Category Level 1", "Category Level 2", "Category Level 3",
    "Category Level 4", "Spend Random Factor",
]
RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS])

#: Raw column -> fact column.
RAW_TO_FACT = {
    "Year Month": "year_month",
    "Business Entity Type": "entity_type",
    "Country": "country",
    "Customer Market Segment Id": "segment",
    "Client ID": "client_id",
    "Customer Id": "customer_id",
    "Customer Brand Id": "brand_id",
    "Customer Brand Parent Id": "brand_parent_id",
    "City": "city",
    "State": "state",
    "Zip": "zip",
    "Number of Rooms": "rooms",
    "Ecommerce Status": "ecomm_status",
    "Distributor ID": "distributor_id",
    "Distributor Group": "distributor_group",
    "Manufacturer ID": "manufacturer_id",
    "Category ID": "category_id",
    "Category Level 1": "cat_l1",
    "Category Level 2": "cat_l2",
    "Category Level 3": "cat_l3",
    "Category Level 4": "cat_l4",
    "Spend Random Factor": "spend",
}

CATEGORY_LEVELS = ["cat_l1", "cat_l2", "cat_l3", "cat_l4"]

#: Categoricals that models encode as integers.
ENCODED = [
    "entity_type", "segment", "cat_l1", "cat_l2", "cat_l3", "state",
    "distributor_group", "ecomm_status",
]

DETAIL_KEYS = ["segment", "client_id", "customer_id", "state", "cat_l1", "year_month"]

EVENT_SCHEMA = T.StructType([
    T.StructField("state", T.StringType()),
    T.StructField("year_month", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("score", T.DoubleType()),
])
UPLIFT_SCHEMA = T.StructType([
    T.StructField("state", T.StringType()),
    T.StructField("year_month", T.IntegerType()),
    T.StructField("uplift_m", T.DoubleType()),
])
STATE_REFERENCE_SCHEMA = T.StructType([
    T.StructField("state", T.StringType()),
    T.StructField("population_m", T.DoubleType()),
    T.StructField("gdp_b", T.DoubleType()),
    T.StructField("tourism_b", T.DoubleType()),
    T.StructField("hotel_count", T.DoubleType()),
    T.StructField("hotel_rooms_k", T.DoubleType()),
    T.StructField("events", T.ArrayType(T.StringType())),
    T.StructField("notes", T.StringType()),
])
LABEL_SCHEMA = T.StructType([
    T.StructField("segment", T.StringType()),
    T.StructField("label", T.StringType()),
])

# Fixed values.
UNKNOWN = "UNKNOWN"
DEFAULT_REFERENCE = {"population_m": 5.0, "gdp_b": 300.0, "tourism_b": 10.0, "hotel_rooms_k": 80.0}
SIZE_BUCKETS = ["<100 rooms", "100–250", "250–500", "500–1000", "1000+"]
SIZE_EDGES = [100, 250, 500, 1000]
ECOMM_STATUSES = ["ACTIVE", "INACTIVE", "PENDING"]
