"""Explicit schemas of every table and message; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


DOCUMENT = _struct(url=_S, html=_S, title=_S, text=_S, favicon=_S, score=_D)
CLICK = _struct(url=_S, title=_S, query=_S)
QUERY = _struct(text=_S, highlight=_S, fields=T.ArrayType(_S))
RULES = _struct(skip=T.ArrayType(_S), priority=T.ArrayType(_S), aliases=T.MapType(_S, _S))
POSTING = _struct(url=_S, field=_S, term=_S, freq=_I, positions=T.ArrayType(_I), field_len=_I, all_len=_I)
STORED = _struct(url=_S, title=_S, text=_S, html=_S, favicon=_S, score=_D, added=_TS, batch=_L)
DOC_FREQ = _struct(field=_S, term=_S, df=_L)
CLICK_EVENT = _struct(query=_S, url=_S, title=_S, ts=_TS, click_id=_S)
