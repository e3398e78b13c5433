"""A small offline parser from instructions to plan steps. What it doesn't understand in full, it refuses."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import Any
from uuid import UUID

from ..functions.core import EngineError
from .schema import PlanStep


def _quoted_or_number(text: str) -> tuple[str, Any] | None:
    """('text', value) of a quoted text, ('number', value) of a number."""
    if m := re.fullmatch(r"""(['"])(.*)\1""", text.strip()):
        return "text", m[2]
    if re.fullmatch(r"-?(?:\d+(?:\.\d*)?|\.\d+)", text.strip()):
        return "number", float(text)
    return None


class InstructionParser:
    """Reads clauses about one table, given its columns and which of them hold text.

    Clauses end at semicolons, line ends and 'then'; each has to be of exactly one kind: duplicates, row filter, sort,
    standardization or text cleaning. Each step depends on the one before.
    """

    # Words that name text actions, value modes and comparisons.
    TEXT = (
        (r"\b(?:trim|strip)\b|clean whitespace", "trim"),
        (r"collapse.*(?:space|whitespace)|(?:space|whitespace).*collapse", "collapse_spaces"),
        (r"non-?printing", "remove_non_printing"),
        (r"normali[sz]e unicode", "normalize_unicode"),
        (r"(?:proper|title) case", "proper_case"),
        (r"\bupper ?case\b", "uppercase"),
        (r"\blower ?case\b", "lowercase"),
    )
    MODES = (
        (r"\bstate\b", "state"),
        (r"\b(?:phone|telephone|mobile)\b", "telephone"),
        (r"\be-?mail\b", "email"),
        (r"\bdate\b", "date"),
        (r"\b(?:numeric|number|integer)\b", "numeric_text"),
    )
    COMPARISONS = {">": "gt", ">=": "ge", "<": "lt", "<=": "le", "=": "eq", "==": "eq"}

    def __init__(self, source_id: UUID, sheet: str, columns: Sequence[str], text_columns: Sequence[str] | None = None):
        self.source_id, self.sheet, self.columns = source_id, sheet, list(columns)
        self.text_columns = list(columns if text_columns is None else text_columns)
        self.kinds: tuple[Callable[[str], dict[str, Any] | None], ...] = (
            self.duplicates,
            self.filter,
            self.sort,
            self.standardize,
            self.text,
        )

    def named(self, clause: str) -> list[str]:
        """The columns that a clause names, in its order; where names overlap, the longer one counts."""
        longest = "|".join(re.escape(c) for c in sorted(self.columns, key=len, reverse=True))
        by_fold = {c.casefold(): c for c in self.columns}
        hits = re.finditer(rf"(?<!\w)(?:{longest})(?!\w)", clause, re.IGNORECASE) if longest else []
        return list(dict.fromkeys(by_fold[m[0].casefold()] for m in hits if m[0].casefold() in by_fold))

    def duplicates(self, clause: str) -> dict[str, Any] | None:
        if not re.search(r"\b(?:duplicates?|deduplicate)\b", clause, re.I):
            return None
        remove = re.search(r"\b(?:remove|delete|deduplicate)\b", clause, re.I) is not None
        mark = re.search(r"\b(?:mark|flag|identify)\b", clause, re.I) is not None
        if remove == mark:
            raise EngineError("say whether duplicates are to be marked or removed")
        keys = self.named(clause)
        return {
            "operation": "duplicates.handle",
            "parameters": {"keys": keys, "mode": "remove" if remove else "mark", "keep": "first"},
            "columns": keys,
            "destructive": remove,
            "explanation": "Remove exact duplicates but the first." if remove else "Mark exact duplicates.",
        }

    def filter(self, clause: str) -> dict[str, Any] | None:
        m = re.fullmatch(r"\s*(keep|include|remove|exclude|filter)\s+(?:the\s+)?rows?\s+where\s+(.+?)\s*", clause, re.I | re.S)
        if m is None:
            return None
        body = m[2]
        starts = [c for c in self.columns if re.match(rf"{re.escape(c)}(?=[\s<>=])", body, re.I)]
        if not starts:
            raise EngineError("a filter begins with the name of a column")
        column = max(starts, key=len)
        rest = body[len(column) :].strip()
        value = None
        if blank := re.fullmatch(r"is\s+(not\s+)?(?:blank|empty)", rest, re.I):
            condition = {"kind": "blank", "is_blank": blank[1] is None}
        elif (text := re.fullmatch(r"(contains|starts\s+with|ends\s+with|equals|is)\s+(.+)", rest, re.I | re.S)) and (
            value := _quoted_or_number(text[2])
        ):
            word = "_".join(text[1].casefold().split())
            if value[0] != "text":
                raise EngineError("texts to compare with are quoted")
            condition = {"kind": "exact", "value": value[1]} if word in ("equals", "is") else {"kind": word, "value": value[1], "case_sensitive": False}
        elif (number := re.fullmatch(r"(>=|<=|==|=|>|<)\s*(\S+)", rest)) and (value := _quoted_or_number(number[2])) and value[0] == "number":
            condition = {"kind": "numeric", "operator": self.COMPARISONS[number[1]], "value": value[1]}
        else:
            raise EngineError("a filter compares with blank, a quoted text or a number")
        return {
            "operation": "rows.filter",
            "parameters": {
                "conditions": [condition | {"column": column}],
                "match": "all",
                "keep_matching": m[1].casefold() in ("keep", "include", "filter"),
            },
            "columns": [column],
            "destructive": True,
            "explanation": "Keep or remove rows by an explicit condition.",
        }

    def sort(self, clause: str) -> dict[str, Any] | None:
        if not re.search(r"\bsort\b", clause, re.I):
            return None
        columns = self.named(clause)
        if not columns:
            raise EngineError("name a column to sort by")
        falling = re.search(r"\b(?:descending|desc|newest first|largest first|z to a)\b", clause, re.I) is not None
        keys = [{"column": c, "descending": falling, "nulls_last": True} for c in columns]
        return {"operation": "rows.sort", "parameters": {"keys": keys}, "columns": columns, "explanation": "Sort rows by the named columns."}

    def standardize(self, clause: str) -> dict[str, Any] | None:
        if not re.search(r"\b(?:standardi[sz]e|normali[sz]e|convert)\b", clause, re.I):
            return None
        modes = [mode for pattern, mode in self.MODES if re.search(pattern, clause, re.I)]
        if not modes:
            return None
        columns = self.named(clause)
        if len(modes) > 1 or len(columns) != 1:
            raise EngineError("standardize one column to one kind of value in a clause")
        parameters: dict[str, Any] = {"column": columns[0], "mode": modes[0], "invalid_policy": "leave"}
        if modes[0] == "telephone" and (code := re.search(r"\bcountry\s+code\s*\+?(\d{1,4})\b", clause, re.I)):
            parameters["default_country_code"] = code[1]
        if modes[0] == "numeric_text" and re.search(r"\binteger\b", clause, re.I):
            parameters["numeric_target"] = "integer"
        return {"operation": "values.standardize", "parameters": parameters, "columns": columns, "explanation": "Standardize values and leave uncertain ones."}

    def text(self, clause: str) -> dict[str, Any] | None:
        actions = [{"kind": kind} for pattern, kind in self.TEXT if re.search(pattern, clause, re.I | re.S)]
        if not actions:
            return None
        everywhere = re.search(r"\ball (?:text|string) columns\b", clause, re.I)
        columns = self.text_columns if everywhere else self.named(clause)
        if not columns:
            raise EngineError("name a text column to clean")
        return {"operation": "text.clean", "parameters": {"columns": columns, "actions": actions}, "columns": columns, "explanation": "Clean text by the named actions."}

    def parse(self, instruction: str) -> list[PlanStep]:
        clauses = [c.strip(" ,.") for c in re.split(r";|\r?\n|\bthen\b", instruction, flags=re.I)]
        clauses = [c for c in clauses if c]
        if not clauses:
            raise EngineError("the instruction is empty")
        steps: list[PlanStep] = []
        for clause in clauses:
            found = [x for x in (kind(clause) for kind in self.kinds) if x is not None]
            if len(found) != 1:
                raise EngineError(f"this clause can't be read with certainty: {clause!r}")
            x = found[0]
            destructive = x.get("destructive", False)
            steps.append(
                PlanStep(
                    step_id=f"{x['operation'].replace('.', '-')}-{len(steps) + 1}",
                    operation=x["operation"],
                    parameters=x["parameters"],
                    target={"source_id": self.source_id, "sheet": self.sheet, "columns": x["columns"]},
                    risk_level="high" if destructive else "low",
                    destructive=destructive,
                    confirmation_required=destructive,
                    explanation=x["explanation"],
                    depends_on=[steps[-1].step_id] if steps else [],
                )
            )
        return steps
