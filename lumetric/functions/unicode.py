"""Unicode composition, the only text step without a built-in: Arrow functions that see
nothing but texts beyond ASCII, since all others are composed already."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _of(form: str) -> tuple[Callable, Callable]:
    @F.pandas_udf(T.StringType())
    def one(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize(form, t) if isinstance(t, str) else None)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def many(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ts: None if ts is None else [None if t is None else unicodedata.normalize(form, t) for t in ts])

    return one, many


def composed(text: Column, form: str = "NFC") -> Column:
    beyond = text.rlike(r"[^\x00-\x7F]")
    return F.when(beyond, _of(form)[0](F.when(beyond, text))).otherwise(text)


def all_composed(texts: Column, form: str = "NFC") -> Column:
    beyond = F.exists(texts, lambda t: t.rlike(r"[^\x00-\x7F]"))
    return F.when(beyond, _of(form)[1](F.when(beyond, texts))).otherwise(texts)
