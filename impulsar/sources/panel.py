"""Panel input: Spark, pandas, Arrow (polars too) or NumPy tables, checked by one aggregate."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME_ERROR = "time must hold exact integers in the int64 range: integers, integral floats up to 2**53 - 1, or base-10 integer strings"
_EXACT = float(2**53 - 1)


def to_spark(data, column_names=None) -> DataFrame:
    """A Spark DataFrame from a Spark or pandas table, one that exports Arrow data, or a named two-dimensional array."""
    if isinstance(data, np.ndarray):
        if data.ndim != 2:
            raise ValueError("NumPy input must be two-dimensional")
        if column_names is None:
            raise ValueError("column_names is required for NumPy input")
        names = tuple(column_names)
        if isinstance(column_names, str) or len(names) != data.shape[1] or len(set(names)) < len(names) or not all(isinstance(n, str) for n in names):
            raise ValueError("column_names must hold one unique name per column")
        data = pd.DataFrame(data, columns=list(names))
    elif column_names is not None:
        raise ValueError("column_names is only for NumPy input")
    if isinstance(data, pd.DataFrame):
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        complex_columns = [c for c in data.columns if np.iscomplexobj(data[c].to_numpy())]
        if complex_columns:
            raise ValueError(f"columns must be real: {complex_columns}")
        return spark.createDataFrame(data)
    if isinstance(data, DataFrame):
        return data
    if hasattr(data, "__arrow_c_stream__"):
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        return spark.createDataFrame(pa.table(data))
    raise TypeError("data must be a Spark DataFrame, a pandas or Arrow table or a NumPy array")


def read_panel(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """A panel from files: Parquet, or CSV with a header and inferred types, or any other source of Spark's."""
    if format == "csv":
        options = {"header": True, "inferSchema": True} | options
    return spark.read.format(format).options(**options).load(path)


def name(column: str) -> str:
    return f"`{column}`"


def clock(df: DataFrame, column: str) -> Column:
    """The column as an exact long; null where a value is no exact integer."""
    kind, value = df.schema[column].dataType, F.col(name(column))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return value.cast("long")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        wide = value.cast("double")
        return F.when((F.abs(wide) <= _EXACT) & (wide == F.floor(wide)), F.expr(f"try_cast({name(column)} as long)"))
    if isinstance(kind, T.StringType):  # casts trim blanks, so the pattern comes first
        return F.when(value.rlike(r"\A[+-]?[0-9]+\z"), F.expr(f"try_cast({name(column)} as long)"))
    raise ValueError(TIME_ERROR)


def number(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if not isinstance(kind, (T.NumericType, T.StringType, T.BooleanType)):
        raise ValueError(f"column {column!r} must be numeric")
    return F.expr(f"try_cast({name(column)} as double)")


@dataclass
class Panel:
    """Checked rows; the clock is ``__t``, counted from the first period, numbers are doubles."""

    frame: DataFrame
    rows: int
    first_time: int
    span: int


def prepare(df: DataFrame, *, required: list[str], numeric: list[str], time: str) -> Panel:
    """Project to the required columns and reject incomplete, non-numeric or non-finite values."""
    required = list(dict.fromkeys(required))
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"data is missing required columns: {missing}")
    df = df.select(*map(name, required))
    checked = df.select("*", clock(df, time).alias("__t"), *[number(df, c).alias(f"__n{i}") for i, c in enumerate(numeric)])
    quoted = [f"`{c.replace('`', '``')}`" for c in required]
    bad = [f"{q} is null" + (f" or isnan({q})" if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else "") for c, q in zip(required, quoted, strict=True)]
    of = dict(zip(required, bad, strict=True))
    counted = [*bad, *[f"__n{i} is null and not ({of[c]})" for i, c in enumerate(numeric)], *[f"not abs(__n{i}) < double('infinity')" for i in range(len(numeric))]]
    facts = ["count(*)", "min(__t)", "max(__t)", "count_if(__t is null)", *[f"count_if({x})" for x in counted]]
    found = checked.agg(F.expr(f"array({', '.join(facts)})")).first()[0]  # one expression: every one costs a call of the JVM
    marks = [*[f"blank{i}" for i in range(len(required))], *[f"text{i}" for i in range(len(numeric))], *[f"wild{i}" for i in range(len(numeric))]]
    stats = dict(zip(["rows", "low", "high", "bad_time", *marks], found, strict=True))
    if not stats["rows"]:
        raise ValueError("data must contain at least one panel unit")
    if incomplete := [c for i, c in enumerate(required) if stats[f"blank{i}"]]:
        raise ValueError(f"the estimator requires complete data; missing values in {incomplete}")
    if wrong := [c for i, c in enumerate(numeric) if stats[f"text{i}"]]:
        raise ValueError(f"columns must be numeric: {wrong}")
    if wild := [c for i, c in enumerate(numeric) if stats[f"wild{i}"]]:
        raise ValueError(f"columns must be finite: {wild}")
    if stats["bad_time"]:
        raise ValueError(TIME_ERROR)
    span = stats["high"] - stats["low"]
    if span > 2**63 - 1:
        raise ValueError("the time span exceeds the int64 range")
    keep = [F.col(name(c)) for c in required if c not in numeric]
    frame = checked.select((F.col("__t") - F.lit(stats["low"])).alias("__t"), *keep, *[F.col(f"__n{i}").alias(f"__v_{c}") for i, c in enumerate(numeric)])
    return Panel(frame, stats["rows"], stats["low"], span)


def key(columns: tuple[str, ...]) -> Column:
    """One exact grouping key for one or several columns; ``"01"`` and ``"1"`` differ."""
    return F.col(name(columns[0])) if len(columns) == 1 else F.to_json(F.struct(*[F.col(name(c)).alias(f"k{i}") for i, c in enumerate(columns)]))


def period_index(timestamp: Column, unit: str = "month") -> Column:
    """A sequential integer clock from dates: days, months, quarters or years since 1970."""
    date = timestamp.cast("date")
    months = (F.year(date) - 1970) * 12 + F.month(date) - 1
    return {"day": F.datediff(date, F.lit("1970-01-01").cast("date")), "month": months, "quarter": F.floor(months / 3), "year": F.year(date) - 1970}[unit].cast("long")
