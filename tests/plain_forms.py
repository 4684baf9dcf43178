"""Plain window forms of ranks, to check the split forms against."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def avg_rank(value, partition, descending=False):
    """Rank with ties averaged; NULL values stay NULL and take no position."""
    v = F.col(value)
    w = Window.partitionBy(*partition).orderBy(v.desc_nulls_last() if descending else v.asc_nulls_last())
    r = F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, v)) - 1) / 2.0
    return F.when(v.isNotNull(), r.cast("double"))


def pct_rank_nonnull(value, partition):
    """(min_rank - 1) / (n - 1) over non-NULL values; NULL for one value."""
    v = F.col(value)
    n = F.count(v).over(Window.partitionBy(*partition))
    pr = F.try_divide((F.rank().over(Window.partitionBy(*partition).orderBy(v.asc_nulls_last())) - 1).cast("double"),
                      (n - 1).cast("double"))
    return F.when(v.isNotNull() & (n > 1), pr)
