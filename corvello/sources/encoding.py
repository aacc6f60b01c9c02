"""Bytes to text and back: marks, declared charsets and single-byte codepages, in Arrow batches where Spark has no codec."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

# Fixed codepages: of whole language numbers, and of languages by the number's low ten bits; all others have 1252.
LCID_CODEPAGES = {0x0404: 950}
LANGUAGE_CODEPAGES = {
    0x01: 1256, 0x02: 1251, 0x04: 936, 0x05: 1250, 0x08: 1253, 0x0D: 1255, 0x0E: 1250, 0x11: 932, 0x12: 949, 0x15: 1250,
    0x18: 1250, 0x19: 1251, 0x1A: 1250, 0x1E: 874, 0x1F: 1254, 0x22: 1251, 0x25: 1257, 0x26: 1257, 0x27: 1257, 0x2A: 1258,
}
DBCS = (932, 936, 949, 950, 1361)


def codec(codepage: int) -> str:
    """Python's name of a codepage."""
    return "utf-8" if codepage in (0, 65001) else {874: "cp874", 949: "cp949", 1361: "johab", 1200: "utf-16-le"}.get(codepage, f"cp{codepage}")


def codepage_for_lcid(lcid):
    """A language number's codepage as a column: by the whole number, by the language, else 1252."""
    whole = F.create_map(*(F.lit(x) for kv in LCID_CODEPAGES.items() for x in kv))
    language = F.create_map(*(F.lit(x) for kv in LANGUAGE_CODEPAGES.items() for x in kv))
    n = lcid.cast("int")
    return F.coalesce(F.try_element_at(whole, n), F.try_element_at(language, n.bitwiseAND(1023)), F.lit(1252))


def is_dbcs(codepage):
    return codepage.isin(*DBCS)


def decode_bytes(data: bytes, codepage: int = 1252) -> str:
    """By byte order mark, then a declared charset in the first 2048 bytes, then valid UTF-8, then the codepage."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    told = re.search(rb"charset\s*=\s*[\"']?([a-z0-9_-]+)", data[:2048].lower())
    if told:
        name = told[1].decode()
        if name in ("utf-8", "utf8"):
            return "".join(_lenient(data))
        if name in ("iso-8859-1", "latin1"):
            codepage = 1252
        elif number := re.fullmatch(r"(?:windows-|cp)([0-9]{3,5})", name):
            codepage = int(number[1])
    elif any(b >= 128 for b in data):
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            pass
    try:
        return data.decode(codec(codepage), "replace")
    except LookupError:
        return data.decode("latin-1")


def _lenient(data: bytes) -> Iterator[str]:
    """UTF-8 in which a byte that fits nowhere is a letter of Latin-1."""
    at = 0
    while at < len(data):
        try:
            yield data[at:].decode("utf-8")
            return
        except UnicodeDecodeError as e:
            yield data[at : at + e.start].decode("utf-8")
            yield chr(data[at + e.start])
            at += e.start + 1


def encode_text(text: str, codepage: int = 1252) -> bytes:
    """In a codepage, letters that it lacks as ?; double-byte codepages stay UTF-8."""
    return text.encode("utf-8" if codepage in DBCS else codec(codepage), "replace")


@F.pandas_udf(StringType())
def decoded(data: pd.Series, codepage: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else decode_bytes(bytes(d), int(c)) for d, c in zip(data, codepage, strict=True)])


@F.pandas_udf(BinaryType())
def encoded(text: pd.Series, codepage: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else encode_text(t, int(c)) for t, c in zip(text, codepage, strict=True)])
