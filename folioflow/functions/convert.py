"""Script conversion by a caller-supplied mapping table."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .phrases import PhraseTrie, replaced_in_slices
from .text import _col, is_blank, substitute, trim_u

# Locale styles that ask for conversion.
CONVERTING = ("simplified", "zh_cn", "zh-cn", "zh-hans")


def wants_conversion(style: str | None) -> bool:
    return (style or "").strip().lower() in CONVERTING


def to_simplified(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Convert text; blank text passes through.  Single-character maps stay in the JVM; phrases, the
    leftmost and there the longest, are replaced in one Arrow pass (see `phrases`), by a trie that is
    built once and broadcast: the caller's mapping is what bounds its size."""
    x = _col(c)
    if all(len(k) == 1 for k in mapping):
        return F.when(is_blank(x), x).otherwise(substitute(x, mapping))
    trie = SparkSession.getActiveSession().sparkContext.broadcast(PhraseTrie(mapping))

    def convert(texts: pa.Array) -> pa.Array:
        return replaced_in_slices(texts, trie.value)

    return F.when(is_blank(x), x).otherwise(F.arrow_udf(convert, "string")(x))


def keyword_for_locale(keyword: Column | str, style: Column | str, mapping: Mapping[str, str]) -> Column:
    k = _col(keyword)
    s = F.lower(trim_u(style))
    return F.when(s.isin(*CONVERTING), to_simplified(k, mapping)).otherwise(k)


def _where_given(c: str) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.when(F.get(F.col(c), i).isNotNull(), x)


def convert_columns(df: DataFrame, style: str | None, mapping: Mapping[str, str], columns: list[str],
                    arrays: list[str] = ()) -> DataFrame:
    """Convert text columns, and array-of-text columns, when the locale style asks for it."""
    if not wants_conversion(style):
        return df
    out = {c: to_simplified(c, mapping) for c in columns}
    # the items of an array as one text: a phrase holds no line separator, so it cannot join two items
    mark = "\u2028"
    safe = {k: v for k, v in mapping.items() if mark not in k}
    for c in arrays:
        plain = F.transform(c, lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit(mark), F.lit("\n")))
        whole = F.split(F.coalesce(to_simplified(F.array_join(plain, mark), safe), F.lit("")), mark)
        out[c] = F.when(F.size(c) > 0, F.transform(whole, _where_given(c))).otherwise(F.col(c))
    return df.withColumns(out)
