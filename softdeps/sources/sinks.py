"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from softdeps.functions.formatting import number_text
from softdeps.operators.pairs import q


def decimal_comma(df: DataFrame, mark: str = ",") -> DataFrame:
    """Fractional columns as text with another decimal mark."""
    fractional = (T.DoubleType, T.FloatType, T.DecimalType)
    text = lambda f: q(f.name).cast("string") if isinstance(f.dataType, T.DecimalType) else number_text(q(f.name))
    swap = {f.name: F.translate(text(f), ".", mark) for f in df.schema if isinstance(f.dataType, fractional)}
    return df.withColumns(swap) if swap else df


def write_rfds(df: DataFrame, path: str, sep: str = ";", decimal: str = ".", fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write dependencies as parquet (default) or as delimited text with a header."""
    if fmt == "csv":
        out = df if decimal == "." else decimal_comma(df, decimal)
        out.write.mode(mode).csv(path, sep=sep, header=True)
    else:
        df.write.mode(mode).format(fmt).save(path)
