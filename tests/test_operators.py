"""The operators on small tables, with expected values written out."""

import datetime as dt

import pytest
from pydantic import ValidationError
from pyspark.sql import functions as F

from lodeframe.functions.core import ORDER, ROW_ID, EngineError
from lodeframe.operators import REGISTRY, apply
from lodeframe.plans.identity import identified
from lodeframe.plans.runner import exported


def frame(spark, schema, *rows):
    return identified(spark.createDataFrame(list(rows), schema).coalesce(1))


def column(df, name):
    return [r[name] for r in exported(df).collect()]


def test_twelve_operators_are_registered():
    assert sorted(REGISTRY) == [
        "calculate.column", "calculate.summary", "columns.transform", "duplicates.fuzzy_review", "duplicates.handle",
        "quality.validate", "rows.filter", "rows.sort", "table.split_by_category", "tables.merge", "text.clean",
        "values.standardize",
    ]


@pytest.mark.parametrize(
    ("value", "action", "expected"),
    [
        # white space at the ends: ASCII, no-break, the separators of ASCII
        ("\n\u00a0note \t", {"kind": "trim"}, "note"),
        ("\x1drow\x1e", {"kind": "trim"}, "row"),
        ("one\u2003\n two", {"kind": "collapse_spaces"}, "one two"),
        # prefixes: the first that fits, once
        ("ccd", {"kind": "remove_prefixes", "values": ["x", "c", "cc"]}, "cd"),
        ("dR. Who", {"kind": "remove_prefixes", "values": ["Dr. "], "case_sensitive": False}, "Who"),
        ("dR. Who", {"kind": "remove_prefixes", "values": ["Dr. "]}, "dR. Who"),
        ("Acme GmbH", {"kind": "remove_suffixes", "values": [" AG", " GmbH"]}, "Acme"),
        ("Acme", {"kind": "remove_suffixes", "values": [""]}, "Acme"),
        # characters and texts are taken literally
        ("1^2\\3", {"kind": "remove_characters", "characters": "^\\"}, "123"),
        ("x*y*", {"kind": "replace", "find": "*", "replacement": "\\0"}, "x\\0y\\0"),
        ("left\x07\u200bright", {"kind": "remove_non_printing"}, "leftright"),
        # letters beyond ASCII
        ("\ufb01n", {"kind": "normalize_unicode"}, "fin"),
        ("u\u0308", {"kind": "normalize_unicode", "form": "NFC"}, "\u00fc"),
        ("gro\u00df", {"kind": "uppercase"}, "GROSS"),
        ("\u00c4RGER", {"kind": "lowercase"}, "\u00e4rger"),
        ("d'arcy 2nd-born", {"kind": "proper_case"}, "D'Arcy 2Nd-Born"),
        ("no", {"kind": "mapping_replace", "mapping": {"no": "0", "yes": "1"}}, "0"),
        ("No", {"kind": "mapping_replace", "mapping": {"no": "0", "yes": "1"}}, "No"),
    ],
)
def test_text_clean(spark, value, action, expected):
    df = frame(spark, "Text string", (value,), (None,))
    assert column(apply("text.clean", df, columns=["Text"], actions=[action]).df, "Text") == [expected, None]


def test_cleaning_refuses_numbers(spark):
    with pytest.raises(EngineError, match="text column"):
        apply("text.clean", frame(spark, "N double", (0.5,)), columns=["N"], actions=[{"kind": "uppercase"}])


@pytest.mark.parametrize(
    ("value", "parameters", "expected"),
    [
        # The format's names of states
        ("PONDICHERRY", {"mode": "state"}, "Puducherry"),
        ("uttaranchal ", {"mode": "state"}, "Uttarakhand"),
        # own mappings, whatever the case
        ("nrt", {"mode": "district", "mapping": {"NRT": "North"}}, "North"),
        ("open ", {"mode": "status_category", "mapping": {"Open": "Active", "shut": "Closed"}}, "Active"),
        # what can't be told stays, or becomes null
        ("Atlantis", {"mode": "state"}, "Atlantis"),
        ("Atlantis", {"mode": "state", "invalid_policy": "null"}, None),
        ("\t", {"mode": "district", "mapping": {"a": "b"}, "invalid_policy": "null"}, "\t"),
        ("30/02/2025", {"mode": "date"}, "30/02/2025"),
        # dates: the day before the month
        ("01/12/2025", {"mode": "date"}, "2025-12-01"),
        ("09/01/2025", {"mode": "date", "output_date_format": "%d/%m/%y"}, "09/01/25"),
        (" Info@Example.Org", {"mode": "email"}, "info@example.org"),
        ("(030) 123-4567", {"mode": "telephone", "default_country_code": "49"}, "+490301234567"),
        ("+1 202 555 0143", {"mode": "telephone"}, "+12025550143"),
    ],
)
def test_standardize(spark, value, parameters, expected):
    out = apply("values.standardize", frame(spark, "Value string", (value,)), column="Value", **parameters)
    assert column(out.df, "Value") == [expected]


def test_standardize_counts_what_it_leaves(spark):
    df = frame(spark, "Value string", ("Unknown State",), ("Goa",), (None,))
    out = apply("values.standardize", df, column="Value", mode="state")
    assert out.counts["uncertain_values"] == 1 and len(out.told()) == 1
    with pytest.raises(EngineError):
        apply("values.standardize", df, column="Value", mode="state", invalid_policy="reject")


def test_numeric_text(spark):
    good, bad = frame(spark, "V string", ("1",), ("2.5",)), frame(spark, "V string", ("1",), ("unknown",))
    assert column(apply("values.standardize", good, column="V", mode="numeric_text").df, "V") == [1.0, 2.5]
    for policy in ("leave", "reject"):
        with pytest.raises(EngineError):
            apply("values.standardize", bad, column="V", mode="numeric_text", invalid_policy=policy)
    out = apply("values.standardize", bad, column="V", mode="numeric_text", invalid_policy="null", numeric_target="integer")
    assert column(out.df, "V") == [1, None]
    with pytest.raises(EngineError, match="whole"):
        apply("values.standardize", good, column="V", mode="numeric_text", numeric_target="integer")


ROWS = [
    (1, "Alpha one", 5, "2026-01-01", None, "A"),
    (2, "beta ONE", 10, "2026-06-30", "", "B"),
    (3, "gamma", 15, "bad", "x", None),
    (4, "alphabet", 20, "2027-01-01", " \t", "A"),
]


@pytest.mark.parametrize(
    ("condition", "expected"),
    [
        ({"kind": "exact", "column": "Group", "value": "A"}, [1, 4]),
        ({"kind": "exact", "column": "Group", "value": None}, [3]),
        ({"kind": "contains", "column": "Text", "value": "one"}, [1, 2]),
        ({"kind": "starts_with", "column": "Text", "value": "ALPHA"}, [1, 4]),
        ({"kind": "ends_with", "column": "Text", "value": "one", "case_sensitive": True}, [1]),
        ({"kind": "numeric", "column": "Amount", "operator": "ge", "value": 10}, [2, 3, 4]),
        ({"kind": "numeric", "column": "Date", "operator": "ne", "value": 1}, []),
        ({"kind": "date_range", "column": "Date", "start": "2026-01-01", "end": "2026-12-31"}, [1, 2]),
        ({"kind": "date_range", "column": "Date"}, [1, 2, 4]),
        ({"kind": "blank", "column": "Blank"}, [1, 2, 4]),
        ({"kind": "blank", "column": "Blank", "is_blank": False}, [3]),
        ({"kind": "include_values", "column": "Group", "values": ["B", None]}, [2, 3]),
        ({"kind": "exclude_values", "column": "Group", "values": ["A"]}, [2, 3]),
        ({"kind": "exclude_values", "column": "Group", "values": ["A", None]}, [2]),
    ],
)
def test_filter(spark, condition, expected):
    df = frame(spark, "ID int, Text string, Amount int, Date string, Blank string, Group string", *ROWS)
    out = apply("rows.filter", df, conditions=[condition])
    assert column(out.df, "ID") == expected
    assert out.counts["removed_rows"] == 4 - len(expected)
    inverse = apply("rows.filter", df, conditions=[condition], keep_matching=False)
    assert column(inverse.df, "ID") == [i for i in (1, 2, 3, 4) if i not in expected]


def test_filter_literals_and_types(spark):
    df = frame(spark, "ID int, Text string", (1, "a.b"), (2, "a+b"), (3, "axb"))
    assert column(apply("rows.filter", df, conditions=[{"kind": "contains", "column": "Text", "value": "A.B"}]).df, "ID") == [1]
    with pytest.raises(EngineError, match="another type"):
        apply("rows.filter", df, conditions=[{"kind": "exact", "column": "Text", "value": 1}])
    with pytest.raises(EngineError, match="unknown columns"):
        apply("rows.filter", df, conditions=[{"kind": "blank", "column": "text"}])
    with pytest.raises(ValidationError):
        apply("rows.filter", df, conditions=[{"kind": "blank", "column": "Text", "sql": "1"}])


def test_sort_is_stable_and_remembers(spark):
    df = frame(spark, "Name string, Score int", ("b", 2), ("a", 1), ("a", 3), (None, 0))
    out = apply("rows.sort", df, keys=[{"column": "Name"}], preserve_original_order_metadata=True).df
    assert column(out, "Score") == [1, 3, 2, 0]
    again = apply("rows.sort", out, keys=[{"column": "Name", "descending": True, "nulls_last": False}]).df
    assert column(again, "Score") == [0, 2, 1, 3]
    assert ROW_ID in again.columns and ORDER in again.columns
    with pytest.raises(EngineError):
        apply("rows.sort", out, keys=[{"column": "Name"}], preserve_original_order_metadata=True)


def test_duplicates_follow_the_present_order(spark):
    df = frame(spark, "ID int, Name string", (1, "first"), (1, "last"), (2, "only"))
    marked = apply("duplicates.handle", df, keys=["ID"], mode="mark")
    assert column(marked.df, "Is Duplicate") == [True, True, False]
    assert (marked.counts["duplicate_rows"], marked.counts["duplicate_group_rows"]) == (1, 2)
    assert column(apply("duplicates.handle", df, keys=["ID"], mode="remove").df, "Name") == ["first", "only"]
    assert column(apply("duplicates.handle", df, keys=["ID"], mode="remove", keep="last").df, "Name") == ["last", "only"]
    turned = apply("rows.sort", df, keys=[{"column": "Name", "descending": True}]).df
    assert column(apply("duplicates.handle", turned, keys=["ID"], mode="remove").df, "Name") == ["only", "last"]


def test_duplicate_keys_of_nulls_and_floats(spark):
    nan = float("nan")
    df = frame(spark, "V double", (None,), (None,), (nan,), (nan,), (0.0,), (-0.0,))
    assert column(apply("duplicates.handle", df, mode="mark").df, "Is Duplicate") == [True] * 4 + [False] * 2
    moved = apply("duplicates.handle", df, mode="move").aux["Duplicates"]
    assert moved.count() == 2


def test_merge_complementary(spark):
    df = frame(spark, "ID int, Email string, Phone string", (1, None, "5"), (1, "a@b.co", " "), (2, None, None))
    rules = [{"column": "Email", "strategy": "first_non_blank"}, {"column": "Phone", "strategy": "require_equal"}]
    out = apply("duplicates.handle", df, keys=["ID"], mode="merge_complementary", merge_rules=rules)
    assert [tuple(r) for r in exported(out.df).collect()] == [(1, "a@b.co", "5"), (2, None, None)]
    with pytest.raises(EngineError, match="exactly one rule"):
        apply("duplicates.handle", df, keys=["ID"], mode="merge_complementary", merge_rules=rules[:1])
    clash = frame(spark, "ID int, Phone string", (1, "5"), (1, "6"))
    with pytest.raises(EngineError, match="conflicting"):
        apply("duplicates.handle", clash, keys=["ID"], mode="merge_complementary", merge_rules=rules[1:])
    joined = apply("duplicates.handle", clash, keys=["ID"], mode="merge_complementary", merge_rules=[{"column": "Phone", "strategy": "join_unique"}])
    assert column(joined.df, "Phone") == ["5; 6"]


def test_fuzzy_review(spark):
    df = frame(spark, "Name string", ("Jon Smith",), ("John  SMITH",), ("Jane Doe",), (None,))
    out = apply("duplicates.fuzzy_review", df, columns=["Name"], threshold=0.8)
    assert column(out.df, "Fuzzy Review Group") == [1, 1, None, None]
    assert out.told()
    with pytest.raises(EngineError, match="comparisons"):
        apply("duplicates.fuzzy_review", df, columns=["Name"], max_comparisons=5)


def test_unique_texts_are_joined_in_their_order(spark):
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"k{i % 5}", f"t{(i * 7) % 4}" if i % 4 else " ", i % 3 * 0.5) for i in range(600)]
    df = spark.createDataFrame(rows, "`ID` long, `a.K` string, T string, V double").withColumn(ROW_ID, F.col("ID")).repartition(5)
    rules = [{"column": "ID", "strategy": "last_non_blank"}, {"column": "T", "strategy": "join_unique", "delimiter": "|"}, {"column": "V", "strategy": "join_unique"}]
    out = apply("duplicates.handle", df, keys=["a.K"], mode="merge_complementary", merge_rules=rules).df
    wanted = {}
    for i, k, t, v in rows:
        own = wanted.setdefault(k, [i, {}, {}])
        own[0] = i
        if t.strip():
            own[1].setdefault(t)
        own[2].setdefault(str(v))
    got = {r["a.K"]: (r["ID"], r["T"], r["V"]) for r in out.collect()}
    assert got == {k: (i, "|".join(t) or None, "; ".join(v)) for k, (i, t, v) in wanted.items()}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    lists = [line for line in plan.splitlines() if "collect_list" in line]
    assert lists and all("text" in line and "min(" not in line for line in lists)  # of different texts, not of rows


def test_split_reads_the_table_once_for_all_parts(spark):
    df = spark.range(3000).selectExpr("id AS `Row`", "concat('c', id % 180) AS `a.C`", "cast(null AS void) AS n", "double(id) AS v").repartition(4)
    df = df.withColumn(ROW_ID, F.col("Row") + 1)
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    plain = df.drop("n").withColumnRenamed("a.C", "C")
    counted = plain.mapInPandas(seen, plain.schema).withColumn("n", F.lit(None)).withColumnRenamed("C", "a.C")
    parts = apply("table.split_by_category", counted, category_column="a.C", drop_category_column=True, table_prefix="x").aux
    before = reads.value
    assert list(parts) == [f"xc{i}" for i in range(180)] and before <= 2 * 3000
    for i in (0, 7, 179):
        rows = parts[f"xc{i}"].collect()
        assert parts[f"xc{i}"].columns == ["Row", "v", ROW_ID, "n"]
        assert sorted((r["Row"], r[ROW_ID], r["n"]) for r in rows) == [(k, k + 1, None) for k in range(i, 3000, 180)]
    assert reads.value == before  # the parts are read from where they were written
    assert "part=7" not in parts["xc8"]._jdf.queryExecution().executedPlan().toString()
    numbers = spark.sql("SELECT * FROM VALUES (1.5D), (double('NaN')), (null), (-0.0D), (0.0D), (double('NaN')) AS t(v)")
    found = {n: t.count() for n, t in apply("table.split_by_category", numbers, category_column="v").aux.items()}
    assert sorted(found.values()) == [1, 1, 2, 2] and found["Blank"] == 1


@pytest.mark.parametrize("operands", [[{"column": "A"}], [{"column": "A"}] * 3, [{"column": "A"}, {}], [{"column": "A"}, {"column": "B", "value": 2}]])
def test_operands_of_a_division(spark, operands):
    df = frame(spark, "A int, B int", (6, 3))
    with pytest.raises(ValidationError):
        apply("calculate.column", df, action={"kind": "division", "output": "C", "operands": operands})
    with pytest.raises(ValidationError):
        apply("columns.transform", df, actions=[{"kind": "row_number", "step": 0}])
    out = apply("calculate.column", df, action={"kind": "division", "output": "C", "operands": [{"column": "A", "value": None}, {"value": 4}]})
    assert column(out.df, "C") == [1.5]


def test_columns(spark):
    df = frame(spark, "A int, B int", (1, 2))
    actions = [
        {"kind": "rename", "mapping": {"A": "B", "B": "A"}},
        {"kind": "add", "name": "C.d", "value": "x"},
        {"kind": "reorder", "columns": ["C.d"]},
        {"kind": "remove", "columns": ["A"]},
    ]
    out = exported(apply("columns.transform", df, actions=actions).df)
    assert out.columns == ["C.d", "B"] and tuple(out.first()) == ("x", 1)
    with pytest.raises(EngineError, match="exists already"):
        apply("columns.transform", df, actions=[{"kind": "add", "name": "a"}])


def test_split_combine_extract(spark):
    df = frame(spark, "Full string", ("Ada|Love|lace",), ("x",), ("",), (None,))
    split = {"kind": "split", "source": "Full", "delimiter": "|", "output_columns": ["F", "L"], "keep_source": False}
    out = apply("columns.transform", df, actions=[split]).df
    assert column(out, "F") == ["Ada", "x", "", None] and column(out, "L") == ["Love|lace", None, None, None]
    cut = lambda kind: {"kind": kind, "source": "Full", "output": "O", "delimiter": "|"}
    assert column(apply("columns.transform", df, actions=[cut("extract_before")]).df, "O") == ["Ada", "x", "", None]
    assert column(apply("columns.transform", df, actions=[cut("extract_after")]).df, "O") == ["Love|lace", "", "", None]
    names = frame(spark, "First string, Middle string, N double", ("Ada", None, 1e16))
    combine = {"kind": "combine", "columns": ["First", "Middle", "N"], "output": "O"}
    assert column(apply("columns.transform", names, actions=[combine]).df, "O") == ["Ada 1e+16"]
    assert column(apply("columns.transform", names, actions=[combine | {"skip_nulls": False}]).df, "O") == ["Ada  1e+16"]


def test_lookup_number_and_id(spark):
    df = frame(spark, "Code string, Name string", ("A", "é"), ("B", "x"), (None, "y"))
    lookup = {"kind": "lookup", "source": "Code", "output": "S", "mapping": {"A": "Active", "None": "Nothing"}}
    out = apply("columns.transform", df, actions=[lookup, {"kind": "row_number", "output": "N", "start": 10, "step": 2}])
    assert column(out.df, "S") == ["Active", "B", "Nothing"] and column(out.df, "N") == [10, 12, 14]
    assert out.counts["unmatched_lookups"] == 1
    with pytest.raises(EngineError):
        apply("columns.transform", df, actions=[lookup | {"unmatched_policy": "reject"}])
    make = {"kind": "deterministic_id", "output": "I", "columns": ["Name", "Code"], "namespace": "n", "prefix": "P", "length": 12}
    import hashlib

    text = '{"namespace":"n","values":["\\u00e9","A"]}'
    assert column(apply("columns.transform", df, actions=[make]).df, "I")[0] == "P" + hashlib.sha256(text.encode()).hexdigest()[:12]


def calc(df, **action):
    return column(apply("calculate.column", df, action=action | {"output": "O"}).df, "O")


def test_arithmetic(spark):
    df = frame(spark, "A int, B int, T string", (2, 10, "0"), (4, 20, "x"))
    a, b, t = {"column": "A"}, {"column": "B"}, {"column": "T"}
    assert calc(df, kind="addition", operands=[a, b, {"value": 1}]) == [13.0, 25.0]
    assert calc(df, kind="subtraction", operands=[b, a]) == [8.0, 16.0]
    assert calc(df, kind="multiplication", operands=[a, b]) == [20.0, 80.0]
    assert calc(df, kind="division", operands=[b, a]) == [5.0, 5.0]
    assert calc(df, kind="division", operands=[b, t]) == [None, None]
    assert apply("calculate.column", df, action={"kind": "division", "output": "O", "operands": [b, t]}).counts["division_by_zero"] == 1
    assert calc(df, kind="percentage", numerator=a, denominator=b) == [20.0, 20.0]
    assert calc(df, kind="quantity_price", quantity_column="A", price_column="B") == [20, 80]
    assert calc(df, kind="gst", base_column="B", rate_percent=18, include_base=True) == [11.8, 23.6]
    with pytest.raises(EngineError):
        calc(df, kind="quantity_price", quantity_column="A", price_column="T")


def test_dates(spark):
    df = frame(spark, "S string, E date, B string", ("2020-01-01", dt.date(2022, 3, 5), "2000-07-18"), ("2020-02-29", dt.date(2021, 2, 28), "x"))
    assert calc(df, kind="date_difference", start_column="S", end_column="E", unit="months") == [26, 12]
    assert calc(df, kind="date_difference", start_column="S", end_column="E", unit="years") == [2, 0]
    assert calc(df, kind="date_difference", start_column="S", end_column="E") == [794, 365]
    assert calc(df, kind="age", birth_date_column="B", as_of="2026-07-17") == [25, None]
    assert calc(df, kind="age", birth_date_column="S", as_of="2020-02-01") == [0, None]


def test_groups_and_totals(spark):
    df = frame(spark, "G string, V int, C string", ("A", 10, "x"), ("A", 20, "y"), ("B", 5, "z"), (None, None, "x"))
    assert calc(df, kind="group_total", group_by=["G"], value_column="V") == [30.0, 30.0, 5.0, 0.0]
    assert calc(df, kind="group_total", group_by=["G"], value_column="V", aggregation="count") == [2, 2, 1, 0]
    assert calc(df, kind="running_total", group_by=["G"], value_column="V") == [10.0, 30.0, 5.0, None]
    assert calc(df, kind="running_total", value_column="V", order_by=["V"]) == [15.0, 35.0, 5.0, None]
    assert calc(df, kind="lookup_value", source_column="C", mapping={"x": "Known"}, default="Other") == ["Known", "Other", "Other", "Known"]
    high = {"conditions": [{"kind": "numeric", "column": "V", "operator": "gt", "value": 15}], "value": "High"}
    assert calc(df, kind="conditional_classification", rules=[high], default=1) == ["1", "High", "1", "1"]


def test_summary(spark):
    df = frame(spark, "A int", (1,), (2,), (None,))
    wanted = ["count", "null_count", "unique_count", "sum", "mean", "min", "max", "median"]
    out = apply("calculate.summary", df, columns=["A"], statistics=wanted).aux["Summary Statistics"]
    assert {r["Statistic"]: r["Value"] for r in out.collect()} == dict(zip(wanted, [2, 1, 3, 3, 1.5, 1, 2, 1.5]))


def test_validation(spark):
    rows = [(1, None, "123", "a@b.co", "2026-01-01", "5", "A", None), (1, "x", "9876543210", "bad", "no", "x", None, "#REF!"), (2, "y", None, None, None, "50", "C", "1")]
    df = frame(spark, "ID int, R string, P string, E string, D string, N string, S string, F string", *rows)
    rules = [
        {"kind": "required_fields", "columns": ["R", "S"]}, {"kind": "telephone", "column": "P"}, {"kind": "email", "column": "E"},
        {"kind": "date_range", "column": "D", "maximum": "2026-12-31"}, {"kind": "numeric_range", "column": "N", "maximum": 10},
        {"kind": "allowed_values", "column": "S", "values": ["A"]}, {"kind": "missing_lookup", "column": "S", "allowed_keys": ["A", None]},
        {"kind": "duplicate_id", "columns": ["ID"]}, {"kind": "row_count", "expected": 3}, {"kind": "total", "column": "N", "expected": 55},
        {"kind": "formula_errors"}, {"kind": "blank_rows"}, {"kind": "invalid_headers"},
    ]
    report = apply("quality.validate", df, rules=rules).report
    found = {(i.code, i.column): (i.affected_rows, i.rows) for i in report.issues}
    assert found == {
        ("missing_required", "R"): (1, (2,)), ("missing_required", "S"): (1, (3,)), ("invalid_telephone", "P"): (1, (2,)),
        ("invalid_email", "E"): (1, (3,)), ("invalid_date_range", "D"): (2, (3, 4)), ("invalid_numeric_range", "N"): (2, (3, 4)),
        ("value_not_allowed", "S"): (2, (3, 4)), ("missing_lookup", "S"): (1, (4,)), ("duplicate_id", "ID"): (2, (2, 3)),
        ("formula_error", None): (1, (3,)),
    }
    assert not report.passed and report.checks_run == len(rules)


def test_blank_rows_ignore_the_row_id(spark):
    df = frame(spark, "A string, B int", (" ", None), ("x", None))
    report = apply("quality.validate", df, rules=[{"kind": "blank_rows"}]).report
    assert [(i.code, i.affected_rows) for i in report.issues] == [("blank_row", 1)]


def test_merge_and_split(spark):
    jan, feb = frame(spark, "ID int, Value int", (1, 2)), frame(spark, "ID int, Other string", (3, "x"))
    out = apply("tables.merge", {"January": jan, "February": feb}, schema_mode="union", source_column="Month").df
    rows = sorted(tuple(r) for r in out.select("ID", "Value", "Month", "Other").collect())
    assert rows == [(1, 2, "January", None), (3, None, "February", "x")]
    with pytest.raises(EngineError):
        apply("tables.merge", {"January": jan, "February": feb})
    mixed = apply("tables.merge", {"a": frame(spark, "V int", (1,)), "b": frame(spark, "V string", ("x",))}, schema_mode="union").df
    assert sorted(r["V"] for r in mixed.collect()) == ["1", "x"]
    df = frame(spark, "R string, V int", ("N", 1), (None, 2), (" ", 3), ("N", 4), ("a/b", 5))
    parts = apply("table.split_by_category", df, category_column="R").aux
    assert {n: sorted(r["V"] for r in t.collect()) for n, t in parts.items()} == {"N": [1, 4], "Blank": [2], "Blank (2)": [3], "a_b": [5]}
    with pytest.raises(EngineError):
        apply("table.split_by_category", df, category_column="R", max_tables=2)
