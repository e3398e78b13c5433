"""Scalar services beside the operators: formula guard, redaction, anonymising, digests."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import WHITE, EngineError, kind, qcol

# Marks that begin a formula, their full-width and small forms, and what is skipped before them.
FORMULA_MARKS = "=+\\-@＝＋－＠﹢﹣﹦﹫"
SKIPPED = "\\uFEFF\\u200B-\\u200D\\u2060"
# What redaction replaces, in this order, and the keys whose values it hides.
REDACTED = "[REDACTED]"
PRIVATE = (
    r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    r"(?<![0-9])(?:\+?[0-9][0-9 .()-]{7,}[0-9])(?![0-9])",
    r"\b(?:sk-|pk_)[A-Za-z0-9_-]{12,}\b",
)
PRIVATE_KEYS = re.compile(
    r"password|passwd|secret|api[_-]?key|token|otp|bank|account|card|credential", re.IGNORECASE
)


def starts_formula(c: Column) -> Column:
    bare = F.regexp_replace(c, f"(?U)[{WHITE}{SKIPPED}]+", "")
    return F.coalesce(bare.rlike(f"^[{FORMULA_MARKS}]"), F.lit(False))


def neutral(c: Column) -> Column:
    return F.when(starts_formula(c) & ~c.startswith("'"), F.concat(F.lit("'"), c)).otherwise(c)


def neutral_text(value: str) -> str:
    bare = "".join(x for x in unicodedata.normalize("NFKC", value) if not x.isspace() and x not in "﻿​‌‍⁠")
    return "'" + value if bare[:1] and bare[0] in "=+-@" and not value.startswith("'") else value


def redacted(c: Column) -> Column:
    for pattern in PRIVATE:
        c = F.regexp_replace(c, pattern, REDACTED)
    return c


def redact(value, key: str | None = None):
    """Hides private parts of a nested value of the driver's."""
    if key is not None and PRIVATE_KEYS.search(key):
        return REDACTED
    if isinstance(value, dict):
        return {k: redact(v, str(k)) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return type(value)(redact(v) for v in value)
    if isinstance(value, str):
        for pattern in PRIVATE:
            value = re.sub(pattern, REDACTED, value)
    return value


def shape_marker(df: DataFrame, name: str) -> Column:
    """What a cell is, without its content."""
    c, t = qcol(name), kind(df, name)
    if isinstance(t, T.BooleanType):
        mark: Column = F.lit("<boolean>")
    elif isinstance(t, T.IntegralType):
        mark = F.lit("<integer>")
    elif isinstance(t, T.NumericType):
        mark = F.lit("<number>")
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        mark = F.lit("<datetime>")
    elif isinstance(t, T.DateType):
        mark = F.lit("<date>")
    else:
        mark = F.concat(F.lit("<text:length="), F.length(c.cast("string")).cast("string"), F.lit(">"))
    return F.when(c.isNull(), "<blank>").otherwise(mark)


def fingerprint(path: str | Path) -> tuple[str, int]:
    """(SHA-256, bytes) of a local file, or of the sorted listing of a folder's files with theirs."""
    path = Path(path)
    if path.is_dir():
        parts = [(str(p.relative_to(path)), *fingerprint(p)) for p in sorted(path.rglob("*")) if p.is_file()]
        return hashlib.sha256(repr(parts).encode()).hexdigest(), sum(p[2] for p in parts)
    digest, size = hashlib.sha256(), 0
    with path.open("rb") as file:
        while block := file.read(1 << 20):
            digest.update(block)
            size += len(block)
    return digest.hexdigest(), size


def verify_unchanged(path: str | Path, before: tuple[str, int]) -> None:
    if fingerprint(path) != before:
        raise EngineError(f"{Path(path).name} has changed since it was read")
