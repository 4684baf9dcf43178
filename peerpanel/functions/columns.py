"""Column helpers shared by the operators (scaling,
normal tail probabilities). All built-in expressions, no Python UDFs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def standardize(value, partition: Sequence[str]) -> Column:
    """(x - mean) / sample sd over the partition; NULL if sd is 0/NULL."""
    v = _col(value)
    w = Window.partitionBy(*partition)
    return F.try_divide(v - F.avg(v).over(w), F.stddev_samp(v).over(w))


# Abramowitz & Stegun 7.1.26 rational approximation of erf (fixed
# published constants), |error| < 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x) -> Column:
    x = _col(x)
    ax = F.abs(x)
    t = 1.0 / (1.0 + ERF_P * ax)
    a1, a2, a3, a4, a5 = ERF_A
    poly = t * (a1 + t * (a2 + t * (a3 + t * (a4 + t * a5))))
    y = 1.0 - poly * F.exp(-ax * ax)
    return F.when(x < 0, -y).otherwise(y)


def norm_cdf(x) -> Column:
    return 0.5 * (1.0 + erf(_col(x) / math.sqrt(2.0)))


def round_doubles(df, digits: int = 6):
    """Round every double column (result-comparison hygiene)."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
