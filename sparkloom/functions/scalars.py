"""Column expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def revenue(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    """Price less discount, in exact decimals so that the sum does not depend on the partitions."""
    return F.col(price).cast("decimal(15,2)") * (F.lit(1).cast("decimal(3,2)") - F.col(discount).cast("decimal(3,2)"))


def month(ts: str) -> Column:
    return F.trunc(F.col(ts).cast("date"), "month")


def dot(a: str, b: str) -> Column:
    """Dot product of two array columns in double precision."""
    products = F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
