"""Rows by a condition that is dear to work out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_where(df: DataFrame, condition: Column, *columns: Column | str) -> DataFrame:
    """``columns`` of the rows that meet ``condition``.

    The planner moves a filter below the columns that it reads and so works them out twice for each row, once for the
    filter and once for what it keeps. Here a row is a list of one or no row behind those columns, which stay as they are.
    """
    return df.select(F.inline(F.when(condition, F.array(F.struct(*columns)))))
