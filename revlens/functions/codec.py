"""JSON that rides along in a marker: deflated, in base64, bounded both ways."""

from __future__ import annotations

import base64
import binascii
import json
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of a marker, and bytes that one may inflate to.
MOST_TOKEN, MOST_BYTES = 8192, 1 << 20


def pack(text: str | None, most: int = MOST_TOKEN) -> str:
    """A token for a text; empty for none, or if it would be longer than `most`."""
    if text is None:
        return ""
    token = base64.b64encode(zlib.compress(text.encode(), 9)).decode()
    return token if len(token) <= most else ""


def unpack(token: str | None, most: int = MOST_TOKEN, most_bytes: int = MOST_BYTES) -> str | None:
    """The JSON in a token. None for one that is too long, broken or no JSON, and for one that inflates beyond `most_bytes`, where inflating stops."""
    if not token or len(token) > most:
        return None
    try:
        pump = zlib.decompressobj()
        raw = pump.decompress(base64.b64decode(token.encode("ascii"), validate=True), most_bytes)
        if pump.unconsumed_tail:
            return None
        text = raw.decode()
        json.loads(text)
    except (ValueError, binascii.Error, zlib.error, RecursionError):
        return None
    return text


def encoded(document: Column, most: int = MOST_TOKEN) -> Column:
    """pack() of each JSON text of a column, a batch at a time."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pack(None if pd.isna(t) else t, most))

    return run(document)


def decoded(token: Column, most: int = MOST_TOKEN, most_bytes: int = MOST_BYTES) -> Column:
    """unpack() of each token of a column, a batch at a time."""

    @F.pandas_udf("string")
    def run(tokens: pd.Series) -> pd.Series:
        return pd.Series([unpack(None if pd.isna(t) else t, most, most_bytes) for t in tokens], dtype=object)

    return run(token)
