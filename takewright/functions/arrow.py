"""Arrow functions whose types are read when they are first used, so that modules import without a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf as spark_arrow_udf
from pyspark.sql.functions import pandas_udf as spark_pandas_udf


def pandas_udf(schema: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*columns: Column | str) -> Column:
            return spark_pandas_udf(f, schema)(*columns)

        return call

    return wrap


def arrow_udf(schema: str) -> Callable[[Callable], Callable[..., Column]]:
    """As pandas_udf, of Arrow arrays: for lists of structs, which pandas would get as a Row each."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*columns: Column | str) -> Column:
            return spark_arrow_udf(f, schema)(*columns)

        return call

    return wrap
