"""Operators that work row by row, over streams."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from ..functions.core import EngineError
from ..operators import REGISTRY

#: Operators whose result for a row depends on that row alone.
STATELESS = {"text.clean", "rows.filter"}
#: Calculations that do, too.
STATELESS_CALCULATIONS = {
    "addition", "subtraction", "multiplication", "division", "percentage", "quantity_price", "gst", "date_difference",
    "age", "conditional_classification", "lookup_value",
}


def _is_stateless(operation: str, parameters: dict[str, Any]) -> bool:
    """Whether no row needs another one: row numbers do, and so does an error about values that can't be converted or found,
    which has to be known before the first row leaves."""
    if operation == "calculate.column":
        return parameters.get("action", {}).get("kind") in STATELESS_CALCULATIONS
    if operation == "columns.transform":
        return not any(a.get("kind") == "row_number" or a.get("unmatched_policy") == "reject" for a in parameters.get("actions", []))
    if operation == "values.standardize":
        if parameters.get("mode") == "numeric_text":
            return parameters.get("invalid_policy") == "null" and parameters.get("numeric_target", "number") == "number"
        return parameters.get("invalid_policy") != "reject"
    return operation in STATELESS


def apply_to_stream(stream: DataFrame, operation: str, **parameters: Any) -> DataFrame:
    """Applies an operator to a streaming DataFrame; those that need other rows are refused."""
    if not _is_stateless(operation, parameters):
        raise EngineError(f"{operation} needs all rows of a table and can't run over a stream")
    op = REGISTRY[operation]
    return op.build(stream, op.params.model_validate(parameters)).df
