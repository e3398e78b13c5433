"""text.clean: an ordered pipeline of actions on text columns."""

from __future__ import annotations

from typing import Annotated, Literal

from pydantic import Field
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import (
    EngineError,
    casefolded,
    collapse,
    is_text,
    kind,
    literal_map,
    normalized,
    qcol,
    require_columns,
    title_case,
    ustrip,
    with_columns,
)
from .base import OpResult, Params, operator


class Simple(Params):
    kind: Literal["trim", "collapse_spaces", "remove_non_printing", "proper_case", "uppercase", "lowercase"]


class NormalizeUnicode(Params):
    kind: Literal["normalize_unicode"]
    form: Literal["NFC", "NFKC"] = "NFKC"


class Replace(Params):
    kind: Literal["replace"]
    find: str = Field(min_length=1)
    replacement: str


class MappingReplace(Params):
    kind: Literal["mapping_replace"]
    mapping: dict[str, str] = Field(min_length=1)


class RemoveCharacters(Params):
    kind: Literal["remove_characters"]
    characters: str = Field(min_length=1)


class RemoveAffixes(Params):
    kind: Literal["remove_prefixes", "remove_suffixes"]
    values: list[str] = Field(min_length=1)
    case_sensitive: bool = True


Action = Annotated[
    Simple | NormalizeUnicode | Replace | MappingReplace | RemoveCharacters | RemoveAffixes, Field(discriminator="kind")
]


class TextClean(Params):
    columns: list[str] = Field(min_length=1)
    actions: list[Action] = Field(min_length=1)


SIMPLE = {
    "trim": ustrip,
    "collapse_spaces": collapse,
    "remove_non_printing": lambda c: F.regexp_replace(c, r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^ ]]", ""),
    "proper_case": title_case,
    "uppercase": F.upper,
    "lowercase": F.lower,
}


def _without_affix(c: Column, action: RemoveAffixes) -> Column:
    """The first listed affix that matches goes, once."""
    prefix = action.kind == "remove_prefixes"
    ascii_only = all(v.isascii() for v in action.values)
    held = c if action.case_sensitive else F.lower(c) if ascii_only else casefolded(c)
    out = None
    for value in action.values:
        wanted, n = (value if action.case_sensitive else value.casefold()), len(value)
        matches = held.startswith(wanted) if prefix else held.endswith(wanted)
        if prefix:
            rest = F.substring(c, n + 1, 1 << 30)
        else:
            rest = F.left(c, F.greatest(F.length(c) - n, F.lit(0))) if n else c
        out = F.when(matches, rest) if out is None else out.when(matches, rest)
    return out.otherwise(c)


def clean(c: Column, action) -> Column:
    if isinstance(action, Simple):
        return SIMPLE[action.kind](c)
    if isinstance(action, NormalizeUnicode):
        return normalized(action.form)(c)
    if isinstance(action, Replace):
        return F.replace(c, F.lit(action.find), F.lit(action.replacement))
    if isinstance(action, MappingReplace):
        return F.coalesce(literal_map(action.mapping, c), c)
    if isinstance(action, RemoveCharacters):
        return F.translate(c, action.characters, "")
    return _without_affix(c, action)


@operator("text.clean", TextClean)
def text_clean(df: DataFrame, p: TextClean) -> OpResult:
    """Cleans text columns by the listed actions in order; null stays null."""
    require_columns(df, p.columns)
    for name in p.columns:
        if not is_text(kind(df, name)):
            raise EngineError(f"text cleaning requires a text column: {name}")
    new = {}
    for name in p.columns:
        c = qcol(name).cast("string")
        for action in p.actions:
            c = clean(c, action)
        new[name] = c
    return OpResult(with_columns(df, new))
