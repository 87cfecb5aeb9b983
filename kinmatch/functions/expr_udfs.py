"""Decisions about expression columns, as vectorised functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.functions import exprs as x


@F.pandas_udf(T.DoubleType())
def tree_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """Least edit distance under renamings of two expressions in prefix notation; infinite if inputs differ in number."""
    return pd.Series([None if a is None or b is None else x.tree_distance(x.tree_of(x.parsed(a)), x.tree_of(x.parsed(b))) for a, b in zip(left, right, strict=True)], dtype="float64")


@F.pandas_udf(T.BooleanType())
def tree_equal(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else x.tree_equal(x.tree_of(x.parsed(a)), x.tree_of(x.parsed(b))) for a, b in zip(left, right, strict=True)], dtype="object")


@F.pandas_udf(T.StringType())
def formula_equal(left: pd.Series, right: pd.Series) -> pd.Series:
    """equal, different, unknown or too_many_vars."""

    def decide(a, b):
        if a is None or b is None:
            return None
        try:
            return x.prove_equal(x.parsed(a), x.parsed(b))
        except x.TooManyVariables:
            return "too_many_vars"

    return pd.Series([decide(a, b) for a, b in zip(left, right, strict=True)], dtype="object")


def _decided(prove, a, b):
    if a is None or b is None:
        return None
    try:
        return prove(x.parsed(a), x.parsed(b))
    except x.TooManyVariables:
        return "too_many_vars"


@F.pandas_udf(T.StringType())
def formula_contained(left: pd.Series, right: pd.Series) -> pd.Series:
    """Whether the left constraint implies the right one under a renaming: equal (it does), different, unknown or too_many_vars."""
    return pd.Series([_decided(x.prove_contained, a, b) for a, b in zip(left, right, strict=True)], dtype="object")


@F.pandas_udf(T.StringType())
def constraint_equivalent(left: pd.Series, right: pd.Series) -> pd.Series:
    """Whether two constraints say the same under a renaming."""
    return pd.Series([_decided(x.prove_equivalent, a, b) for a, b in zip(left, right, strict=True)], dtype="object")


def tree_distance_of(executable: Sequence[tuple[int, int]], data: Sequence[tuple[int, int]]) -> Callable:
    """``tree_distance`` where constants in code or data ranges are pointers."""

    @F.pandas_udf(T.DoubleType())
    def distance(left: pd.Series, right: pd.Series) -> pd.Series:
        tree = lambda text: x.tree_of(x.parsed(text), executable, data)
        return pd.Series([None if a is None or b is None else x.tree_distance(tree(a), tree(b)) for a, b in zip(left, right, strict=True)], dtype="float64")

    return distance


@F.pandas_udf(T.ArrayType(T.StringType()))
def inputs(texts: pd.Series) -> pd.Series:
    """Distinct names of an expression's symbols, in order of appearance."""
    return pd.Series([None if t is None else list(x.symbols(x.parsed(t))) for t in texts], dtype="object")


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("width", T.LongType())]))
def plain(texts: pd.Series) -> pd.DataFrame:
    """Formulas without null checks and with 32-bit values widened: text and width."""
    out = [x.widened(x.without_null_checks(x.parsed(t))) for t in texts]
    return pd.DataFrame({"text": [x.text_of(e) for e in out], "width": [e[-1].width for e in out]})
