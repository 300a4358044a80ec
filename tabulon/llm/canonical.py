"""One consistent form for texts that look the same (problem 3).

Quick-check properties mark the characters at which a text may be unstable; only the runs of letters and marks that
hold one are normalized, with the whole run as boundary context, and spliced back into the text, which is otherwise
untouched. Most texts hold none and are settled by a pattern in the JVM.

Defined cases: a null text stays null and an empty one empty; signs (superscripts, fractions, dashes, quotes) and
words of another script stay; repeated rows stay repeated; very long texts are treated whole.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions import lookalikes


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(lookalikes.canonical, na_action="ignore")


@F.pandas_udf(T.StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lookalikes.fold, na_action="ignore")


def unstable(text: Column) -> Column:
    """Whether text may differ from its canonical form; where this is false it does not."""
    return F.coalesce(text.rlike(lookalikes.JVM_UNSTABLE), F.lit(False))


def canonical(text: Column) -> Column:
    """The canonical form of each text. Evaluated in Python for every row; see with_canonical for the cheap way."""
    return _canonical(text)


def fold(text: Column) -> Column:
    return _fold(text)


def with_canonical(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """df with out_col; only texts that fail the quick check are looked at in Python, the others reach it as nulls."""
    form = _canonical(F.when(unstable(F.col(text_col)), F.col(text_col)))
    return df.withColumn(out_col, F.coalesce(form, F.col(text_col)))


def changed(df: DataFrame, text_col: str) -> DataFrame:
    """The rows of df whose text isn't stored in its canonical form."""
    suspect = df.where(unstable(F.col(text_col)))
    return suspect.where(~F.col(text_col).eqNullSafe(_canonical(F.col(text_col))))
