"""Expressions over the text of single objects: entries of dictionaries, references, digests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.pdf.syntax import DocError, Reader, Ref, text_of


def _value(raw) -> object:
    try:
        return Reader(raw.encode("utf-8") if isinstance(raw, str) else bytes(raw or b"")).value()
    except (DocError, IndexError, ValueError):
        return None


def _shown(v) -> str | None:
    return None if v is None else text_of(v) if isinstance(v, bytes) else str(v)


def dict_value(raw: Column, key: str) -> Column:
    """The entry of a dictionary as text: strings decoded, names without slash; null where there is none."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([_shown(d.get(key)) if isinstance(d := _value(x), dict) else None for x in s], dtype=object)

    return run(raw)


def dict_values(raw: Column, keys: list[str]) -> Column:
    """``dict_value`` of several keys, in their order, as an array: the object is read once."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([[_shown(d.get(k)) for k in keys] if isinstance(d := _value(x), dict) else [None] * len(keys) for x in s], dtype=object)

    return run(raw)


def refs(raw: Column) -> Column:
    """Object numbers that an object refers to, in order, however deep."""

    def found(v) -> list[int]:
        if isinstance(v, Ref):
            return [v[0]]
        return [n for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()) for n in found(x)]

    @F.pandas_udf("array<long>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([found(_value(x)) for x in s], dtype=object)

    return run(raw)


def digests(data: Column) -> Column:
    """Fingerprints of the bytes of images and streams."""
    return F.struct(F.sha2(data, 256).alias("sha256"), F.md5(data).alias("md5"))
