"""Questions over the sales tables. Join sides are left to the optimizer, which measures them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def customers_by_region(customers: DataFrame, region: str = "region") -> DataFrame:
    return customers.groupBy(region).agg(F.count(F.lit(1)).alias("customers"))


def revenue_by(orders: DataFrame, dimension: DataFrame, key: str, group: str, amount) -> DataFrame:
    """Revenue per value of one dimension column.

    Amounts are summed per key before the join, so a customer or product holding a third of all orders
    reaches it as one row.
    """
    per_key = orders.groupBy(key).agg(F.sum(amount).alias("_amount"), F.count(F.lit(1)).alias("_n"))
    return (
        per_key.join(dimension.select(key, group), key).groupBy(group)
        .agg(F.sum("_amount").alias("revenue"), F.sum("_n").alias("orders"))
    )
