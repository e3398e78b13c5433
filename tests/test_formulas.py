import json

import pytest
from pydantic import ValidationError

from lodeframe.functions.core import EngineError
from lodeframe.operators.calculations import CalculateColumn
from lodeframe.plans.responses import parse_response
from lodeframe.sources.formulas import FormulaSpec, formula, letters, spec_of

HEADERS = ["A", "B", "C"]


@pytest.mark.parametrize(
    ("spec", "expected"),
    [
        ({"kind": "addition", "operand_columns": ["A", "B", "C"]}, "=A2+B2+C2"),
        ({"kind": "subtraction", "operand_columns": ["B", "A"]}, "=B2-A2"),
        ({"kind": "multiplication", "operand_columns": ["A", "C"]}, "=A2*C2"),
        ({"kind": "division", "operand_columns": ["A", "B"]}, '=IFERROR(A2/B2,"")'),
        ({"kind": "percentage", "operand_columns": ["A", "B"]}, '=IFERROR(A2/B2*100,"")'),
        ({"kind": "quantity_price", "operand_columns": ["A", "B"]}, "=A2*B2"),
        ({"kind": "gst", "operand_columns": ["A"], "rate_percent": 18, "include_base": True}, "=A2+A2*18.0/100"),
        ({"kind": "date_difference", "operand_columns": ["A", "B"]}, "=B2-A2"),
        ({"kind": "age", "operand_columns": ["A"], "as_of": "2026-07-17"}, '=DATEDIF(A2,DATE(2026,7,17),"Y")'),
    ],
)
def test_formulas(spec, expected):
    assert formula(FormulaSpec(output_column="O", **spec), HEADERS, 2) == expected


def test_formula_errors():
    for wrong in ({"kind": "division", "operand_columns": ["A"]}, {"kind": "gst", "operand_columns": ["A"]}, {"kind": "age", "operand_columns": ["A"]}):
        with pytest.raises(ValidationError):
            FormulaSpec(output_column="O", **wrong)
    for column, operands in (("A", ["B"]), ("O", ["Z"])):
        with pytest.raises(EngineError):
            formula(FormulaSpec(output_column=column, kind="addition", operand_columns=operands), HEADERS, 2)
    assert [letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_formulas_of_calculations():
    of = lambda **a: spec_of(CalculateColumn(action=a | {"output": "O"}).action)
    assert of(kind="addition", operands=[{"column": "A"}, {"column": "B"}]).operand_columns == ["A", "B"]
    assert of(kind="addition", operands=[{"column": "A"}, {"value": 1}]) is None
    assert of(kind="date_difference", start_column="A", end_column="B", unit="months") is None
    assert of(kind="group_total", group_by=["A"], value_column="B") is None


def test_responses():
    assert parse_response('{"steps": []}').steps == []
    deep = "[" * 60 + "]" * 60
    for bad in ("no", "[]", '{"steps": NaN}', '{"other": 1}', f'{{"steps": {deep}}}', json.dumps({"steps": [0] * 60_000}), " " * 1_000_001):
        with pytest.raises(EngineError):
            parse_response(bad)
