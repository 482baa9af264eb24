"""Compiles predicates to columns by the attribute's type, never by implicit casts.

Numbers compare with numbers by widening; a number never matches a text, whatever the operator, and a text never a
number; a missing or null attribute makes every predicate false. An attribute with values of several types under
one label is a struct of i, d and s, and the literal's type picks the field."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..pattern import Pred

_COMPARE = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
MIXED = T.StructType([T.StructField("i", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType())])


def to_column(pred: Pred, kind: T.DataType, name: str) -> Column:
    """The predicate over column ``name`` of type ``kind``."""
    compare = _COMPARE[pred.op]
    text = isinstance(pred.value, str)
    column = F.col(f"`{name}`")
    if isinstance(kind, T.StructType):
        if text:
            return compare(column["s"], F.lit(pred.value))
        # integers stay exact among themselves; a row holds one of the two
        return F.when(column["i"].isNotNull(), compare(column["i"], F.lit(pred.value))).otherwise(compare(column["d"], F.lit(pred.value)))
    if text != isinstance(kind, T.StringType) or not (text or isinstance(kind, T.NumericType)):
        return F.lit(False)
    return compare(column, F.lit(pred.value))


def apply(df: DataFrame, preds: tuple[Pred, ...]) -> DataFrame:
    """The rows on which all predicates are true."""
    for p in preds:
        df = df.filter(to_column(p, df.schema[p.key].dataType, p.key)) if p.key in df.columns else df.filter(F.lit(False))
    return df
