"""The distribution functions as pandas UDFs, for columns of small aggregated tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    from tidemark.functions import stats

    return stats.apply(stats.normal_cdf, x)


@F.pandas_udf(DoubleType())
def normal_ppf(p: pd.Series) -> pd.Series:
    from tidemark.functions import stats

    return stats.apply(stats.normal_ppf, p)


@F.pandas_udf(DoubleType())
def t_sf(t: pd.Series, df: pd.Series) -> pd.Series:
    from tidemark.functions import stats

    return stats.apply(stats.t_sf, t, df)


@F.pandas_udf(DoubleType())
def binom_sf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    from tidemark.functions import stats

    return stats.apply(lambda a, b, c: stats.binom_sf(int(a), int(b), c), k, n, p)
