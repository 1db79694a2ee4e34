"""Scalar functions: sizes, modes, times, paths, similarity."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def size_string(c: Column) -> Column:
    """Bytes as b, kb, mb or gb with one decimal, rounded half to even and without a trailing ``.0``."""
    size = F.abs(c)
    text = lambda unit, power: F.concat(F.regexp_replace(F.bround(c.cast("decimal(38,12)") / F.lit(1024**power).cast("decimal(38,0)"), 1).cast("decimal(38,1)").cast("string"), r"\.0$", ""), F.lit(unit))
    return F.when(size < 1024, text("b", 0)).when(size < 1024**2, text("kb", 1)).when(size < 1024**3, text("mb", 2)).otherwise(text("gb", 3))


def size_bytes(c: Column) -> Column:
    """The inverse: a number and a unit ending in ``b``; null where the text is no size."""
    number = F.regexp_extract(F.lower(c), r"^([0-9]+(?:\.[0-9]*)?|\.[0-9]+)([kmg]?)b$", 1)
    unit = F.regexp_extract(F.lower(c), r"^([0-9.]+)([kmg]?)b$", 2)
    scale = F.when(unit == "k", 1024).when(unit == "m", 1024**2).when(unit == "g", 1024**3).otherwise(1)
    return (F.nullif(number, F.lit("")).try_cast("double") * scale).try_cast("long")


def strip_bidi(c: Column) -> Column:
    """Without the isolate signs of writing directions (U+2068, U+2069)."""
    return F.translate(c, "\u2068\u2069", "")


def decode_octal_escapes(c: Column) -> Column:
    """``\\#ooo`` as the character of that octal number."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(\\#[0-7]{3}|.[^\\]*)"), F.lit(1))
    code = lambda x: F.lpad(F.conv(F.substring(x, 3, 3), 8, 16), 4, "0")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\\#[0-7]{3}$"), F.decode(F.unhex(code(x)), "UTF-16BE")).otherwise(x)), "")


def octal(c: Column) -> Column:
    return F.concat(F.lit("0"), F.conv(c.cast("string"), 10, 8))


def dirname(c: Column) -> Column:
    return F.when(F.instr(c, "/") == 0, "").otherwise(F.regexp_replace(c, "/[^/]*$", ""))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def ancestors(c: Column) -> Column:
    """The path itself and all its parents but the root, shortest first."""
    parts = F.split(c, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def escape(c: Column) -> Column:
    """Python's unicode_escape; the identity on printable ASCII without a backslash."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else x.encode("unicode_escape").decode())

    return run(c)


def similarity(a: Column, b: Column) -> Column:
    """Ratio of matching blocks of two paths; not symmetric."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(a=p, b=q).ratio() for p, q in zip(x, y)])

    return run(a, b)


def glob_regex(pattern: str) -> str:
    """A filter pattern as a regular expression for ``rlike``: a leading slash anchors, ``*`` stays within
    a path component, ``**`` does not. Signs of other glob dialects are refused."""
    if re.search(r"[?\[\\]", pattern):
        raise ValueError(f"unsupported pattern: {pattern!r}")
    anchored, directory = pattern.startswith("/"), pattern.endswith("/")
    body = "".join({"**": ".*", "*": "[^/]*"}.get(x, re.sub(r"([^\w/ -])", r"\\\1", x)) for x in re.split(r"(\*\*|\*)", pattern.strip("/") if directory else pattern.lstrip("/")))
    return ("(?ds)^" if anchored else "(?ds)^(?:.*/)?") + body + ("/$" if directory else "/?$")
