"""Numbers as text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fixed_all(values: Column | str, digits: int) -> Column:
    """The numbers of an array with ``digits`` places, each rounded from its exact binary value with ties to even.

    ``format_string`` rounds the shortest decimal text of a number, and its ties up.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def text(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else [f"{v:.{digits}f}" for v in a])

    return text(values)
