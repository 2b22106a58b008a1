"""dim_product seed (literal rows)."""
from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from finlake.schemas import DIM_PRODUCT

# ---- fixed values: the seed rows, in seed order ----
# key, product line, category, is_recurring, standard COGS %, product group
PRODUCTS = [
    (1, "Core Platform", "Subscription", 1, "22.00", "Revenue"),
    (2, "Analytics Add-on", "Subscription", 1, "22.00", "Revenue"),
    (3, "API Suite", "Subscription", 1, "22.00", "Revenue"),
    (4, "Mobile Module", "Subscription", 1, "22.00", "Revenue"),
    (5, "Compliance Pack", "Subscription", 1, "22.00", "Revenue"),
    (6, "Core Platform", "Professional Services", 0, "55.00", "Services"),
    (7, "Analytics Add-on", "Professional Services", 0, "55.00", "Services"),
    (8, "API Suite", "Professional Services", 0, "55.00", "Services"),
    (9, "Mobile Module", "Professional Services", 0, "55.00", "Services"),
    (10, "Compliance Pack", "Professional Services", 0, "55.00", "Services"),
    (11, "Core Platform", "Training", 0, "40.00", "Services"),
    (12, "Analytics Add-on", "Training", 0, "40.00", "Services"),
    (13, "API Suite", "Training", 0, "40.00", "Services"),
    (14, "Mobile Module", "Training", 0, "40.00", "Services"),
    (15, "Compliance Pack", "Training", 0, "40.00", "Services"),
    (16, "Core Platform", "Support Premium", 1, "30.00", "Revenue"),
    (17, "Analytics Add-on", "Support Premium", 1, "30.00", "Revenue"),
    (18, "API Suite", "Support Premium", 1, "30.00", "Revenue"),
    (19, "Mobile Module", "Support Premium", 1, "30.00", "Revenue"),
    (20, "Compliance Pack", "Support Premium", 1, "30.00", "Revenue"),
    (21, "Core Platform", "Overage Charges", 0, "10.00", "Revenue"),
    (22, "Analytics Add-on", "Overage Charges", 0, "10.00", "Revenue"),
    (23, "API Suite", "Overage Charges", 0, "10.00", "Revenue"),
    (24, "Mobile Module", "Overage Charges", 0, "10.00", "Revenue"),
    (25, "Compliance Pack", "Overage Charges", 0, "10.00", "Revenue"),
]


def product_rows() -> list[tuple]:
    return [(*row[:4], Decimal(row[4]), row[5]) for row in PRODUCTS]


def product_seed(spark: SparkSession) -> DataFrame:
    """The 25-row product dimension.  Made from an Arrow table, so that Spark
    knows its size and broadcasts it: a join by one of 25 keys would put the
    rows of a fact into 25 tasks at most."""
    columns = zip(*product_rows())
    rows = pa.table([pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, DIM_PRODUCT.fields)], DIM_PRODUCT.names)
    return spark.createDataFrame(rows, DIM_PRODUCT)
