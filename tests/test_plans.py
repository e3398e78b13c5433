"""Plans, previews, differences, execution, instructions and the store."""

import json
import uuid

import pytest
from pydantic import ValidationError

from lodeframe.functions.core import EngineError
from lodeframe.functions.stored import release
from lodeframe.plans import diff, reconcile
from lodeframe.plans.identity import identified
from lodeframe.plans.instructions import InstructionParser
from lodeframe.plans.runner import approve, execute, exported, preview, reconcile_run, run_plan, validate_run, without_rejected
from lodeframe.plans.schema import OperationPlan, validate_plan
from lodeframe.plans.store import Store, plan_from, template_of
from lodeframe.sources.writers import write_tables

SOURCE = uuid.UUID(int=7)


def step(i, operation, parameters, destructive=False, **more):
    return {
        "step_id": f"s{i}", "operation": operation, "parameters": parameters, "target": {"source_id": SOURCE, "sheet": "CSV"},
        "destructive": destructive, "confirmation_required": destructive, "explanation": "x",
    } | more


def plan(*steps, validations=()):
    return OperationPlan.model_validate(
        {
            "job_name": "job",
            "source_files": [{"source_id": SOURCE, "file_name": "a.csv", "sha256": "0" * 64}],
            "steps": list(steps),
            "validations": list(validations),
            "output": {"output_name": "out.csv", "format": "csv"},
        }
    )


@pytest.fixture
def tables(spark):
    rows = [(1, " Ada ", 5.0), (2, " Bob", None), (3, "Cy", 1.0)]
    return {(SOURCE, "CSV"): spark.createDataFrame(rows, "ID int, Name string, V double").coalesce(1)}


TRIM = step(1, "text.clean", {"columns": ["Name"], "actions": [{"kind": "trim"}]})
DROP = step(2, "rows.filter", {"conditions": [{"kind": "numeric", "column": "ID", "operator": "lt", "value": 3}]}, True)


def result(tables):
    return [tuple(r) for r in exported(next(iter(tables.values()))).collect()]


def test_run(tables):
    run = run_plan(plan(TRIM, DROP), tables)
    assert result(run.tables) == [(1, "Ada", 5.0), (2, "Bob", None)]
    assert run.metrics()["s2"] == {"input_rows": 3, "output_rows": 2, "removed_rows": 1}
    kinds = [[r["kind"] for r in diff.sample(s.changes()).collect()] for s in run.steps]
    assert kinds == [["cell_changed", "cell_changed"], ["row_deleted"]]


@pytest.mark.parametrize(
    "bad",
    [
        step(1, "text.unknown", {}),
        step(1, "text.clean", {"columns": ["Name"], "actions": [{"kind": "trim", "more": 1}]}),
        step(1, "columns.transform", {"actions": [{"kind": "lookup", "source": "a", "output": "b", "mapping": {"sql": "x"}}]}),
        step(1, "columns.transform", {"actions": [{"kind": "add", "name": "__LF_x"}]}),
        step(1, "columns.transform", {"actions": [{"kind": "remove", "columns": ["a"]}]}),
        step(1, "rows.sort", {"keys": [{"column": "a"}]}, True),
    ],
)
def test_plans_that_are_refused(bad):
    with pytest.raises(EngineError):
        validate_plan(plan(bad))


def test_models_are_strict():
    with pytest.raises(ValidationError):
        plan(TRIM | {"destructive": True})
    with pytest.raises(ValidationError):
        plan(TRIM, TRIM)
    with pytest.raises(ValidationError):
        plan(TRIM | {"depends_on": ["s2"]}, DROP)
    with pytest.raises(ValidationError):
        plan(TRIM | {"target": {"source_id": uuid.uuid4()}})
    with pytest.raises(EngineError):
        validate_plan(plan(TRIM | {"enabled": False}, DROP | {"depends_on": ["s1"]}))


@pytest.mark.parametrize(
    ("privacy", "fits"),
    [
        ({}, True),
        ({"metadata_upload_consent": True}, False),
        ({"raw_data_upload_consent": True}, False),
        ({"mode": "ai_assisted"}, True),
        ({"mode": "ai_assisted", "metadata_upload_consent": True}, True),
        ({"mode": "ai_assisted", "raw_data_upload_consent": True}, False),
        ({"mode": "ai_assisted", "metadata_upload_consent": True, "raw_data_upload_consent": True}, True),
    ],
)
def test_consents(privacy, fits):
    whole = plan(TRIM).model_dump(mode="json") | {"privacy": privacy}
    if fits:
        OperationPlan.model_validate(whole)
    else:
        with pytest.raises(ValidationError):
            OperationPlan.model_validate(whole)


def test_preview_reject_execute(spark, tables, tmp_path):
    p = plan(TRIM, DROP)
    seen = preview(p, tables)
    assert seen.changes == 3
    ada = next(c for c in seen.sample if c["old"] == " Ada ")
    with pytest.raises(EngineError, match="confirm"):
        approve(seen)
    with pytest.raises(EngineError, match="rejected"):
        approve(seen, ["s2"], [c["change_id"] for c in seen.sample if c["kind"] == "row_deleted"])
    ok = approve(seen, ["s2"], [ada["change_id"]])
    assert result(without_rejected(seen, ok.rejected_changes)) == [(1, " Ada ", 5.0), (2, "Bob", None)]
    audit = execute(p, tables, seen, ok, tmp_path / "out", lambda t, folder: write_tables(t, folder))
    assert (tmp_path / "out" / "CSV.csv").read_bytes().decode("utf-8-sig") == "ID,Name,V\n1, Ada ,5.0\n2,Bob,\n"
    assert audit["reconciliation"]["tables"]["CSV"]["rows_removed"] == 1
    assert json.loads((tmp_path / "out" / "audit.json").read_text())["rejected_changes"] == 1
    with pytest.raises(EngineError, match="exists"):
        execute(p, tables, seen, ok, tmp_path / "out", lambda t, folder: None)
    other = {k: t.limit(1) for k, t in tables.items()}
    with pytest.raises(EngineError, match="changed"):
        execute(p, other, seen, ok, tmp_path / "new", lambda t, folder: None)
    assert not (tmp_path / "new").exists()


def test_kept_states_are_compared_without_a_shuffle(spark, tables):
    steps = [
        step(1, "text.clean", {"columns": ["Name"], "actions": [{"kind": "trim"}]}),
        step(2, "rows.sort", {"keys": [{"column": "ID", "descending": True}]}),
        step(3, "rows.filter", {"conditions": [{"kind": "numeric", "column": "ID", "operator": "lt", "value": 3}]}, True),
        step(4, "columns.transform", {"actions": [{"kind": "rename", "mapping": {"V": "a.W"}}]}),
        step(5, "duplicates.handle", {"keys": ["ID"], "mode": "move"}, True),
    ]
    plain, kept = run_plan(plan(*steps), tables), run_plan(plan(*steps), tables, keep=True)
    assert plain.digest() == kept.digest()
    told = lambda s: sorted(map(repr, (tuple(r) for r in s.changes().collect())))
    for a, b in zip(plain.steps, kept.steps, strict=True):
        assert told(a) == told(b)
        assert "Exchange" not in b.changes()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in a.changes()._jdf.queryExecution().executedPlan().toString()
    assert reconcile_run(plain) == reconcile_run(kept)
    key = (SOURCE, "CSV")
    joined = reconcile.row_changes(kept.first_sides[key], kept.last_sides[key])._jdf.queryExecution().executedPlan().toString()
    assert joined.count("Exchange") == 1  # of the one row of figures
    assert "__lf_place" not in kept.tables[key].columns and release(spark) > 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lf_")]


def test_rejecting_two_steps_restores_the_first_value(tables):
    steps = [step(i, "text.clean", {"columns": ["Name"], "actions": [{"kind": "mapping_replace", "mapping": {a: b}}]}) for i, (a, b) in enumerate([("Cy", "B"), ("B", "C")], 1)]
    seen = preview(plan(*steps), tables)
    final = without_rejected(seen, frozenset(c["change_id"] for c in seen.sample))
    assert result(final)[2][1] == "Cy"


def test_failed_validation_publishes_nothing(tables, tmp_path):
    p = plan(TRIM, validations=[{"name": "required_fields", "parameters": {"columns": ["V"]}}])
    seen = preview(p, tables)
    assert [i.code for i in validate_run(seen.run).issues] == ["missing_required"]
    with pytest.raises(EngineError, match="missing_required"):
        execute(p, tables, seen, approve(seen), tmp_path / "out", lambda t, folder: None)
    assert list(tmp_path.iterdir()) == []


def test_steps_that_validate_gate_the_result(tables, tmp_path):
    rule = {"kind": "required_fields", "columns": ["V"]}
    p = plan(step(1, "quality.validate", {"rules": [rule]}), TRIM | {"step_id": "s2"})
    seen = preview(p, tables)
    with pytest.raises(EngineError, match="missing_required"):
        execute(p, tables, seen, approve(seen), tmp_path / "out", lambda t, folder: None)
    assert list(tmp_path.iterdir()) == []
    told = reconcile_run(seen.run)
    assert told["status"] == "failed" and told["missing_required"] == told["invalid_records"] == 1
    assert told["warnings"] >= 1


def test_status_of_a_run(tables):
    clean = reconcile_run(run_plan(plan(TRIM), tables))
    assert clean["status"] == "passed" and clean["warnings"] == clean["invalid_records"] == 0
    assert clean["modified_tables"] == ["CSV"] == list(clean["tables"])
    email = step(1, "values.standardize", {"column": "Name", "mode": "email"})
    warned = reconcile_run(run_plan(plan(email), tables))
    assert (warned["status"], warned["warnings"]) == ("passed_with_warnings", 1)


def test_row_ids_are_unique_over_tables_and_merge(spark):
    north, south = (spark.createDataFrame([(i,), (i + 1,)], "ID int").coalesce(1) for i in (1, 5))
    merge = step(1, "tables.merge", {}, target={"source_id": SOURCE, "sheet": "North"})
    run = run_plan(plan(merge), {(SOURCE, "North"): north, (SOURCE, "South"): south})
    merged = run.tables[SOURCE, "North"]
    assert [r["ID"] for r in exported(merged).collect()] == [1, 2, 5, 6]
    assert {r["kind"] for r in run.steps[0].changes().collect()} == {"row_added"}


def test_auxiliary_tables_and_sorted_changes(spark, tables):
    run = run_plan(plan(step(1, "duplicates.handle", {"keys": ["ID"], "mode": "move"}, True), step(2, "rows.sort", {"keys": [{"column": "ID", "descending": True}]})), tables)
    assert (SOURCE, "Duplicates") in run.tables and result(run.tables)[0][0] == 3
    assert sorted(r["row_id"] for r in run.steps[1].changes().collect()) == [1, 3]
    assert reconcile_run(run)["created_tables"] == ["Duplicates"]


def test_changes_of_columns_nulls_and_nan(spark):
    before = identified(spark.createDataFrame([(1, float("nan"), None), (2, 1.0, "x")], "A int, B double, C string").coalesce(1))
    after = before.selectExpr("A", "B", "cast(null as string) D", "`__lf_row`")
    found = sorted((r["row_id"], r["kind"], r["column"]) for r in diff.changes(before, after).collect())
    assert found == [(1, "column_added", "D"), (1, "column_deleted", "C"), (2, "column_added", "D"), (2, "column_deleted", "C")]
    assert reconcile.row_changes(before, after).first()["rows_changed"] == 2
    assert diff.search(diff.changes(before, after), "deleted", "c").count() == 2


PARSER = InstructionParser(SOURCE, "CSV", ["Name", "Full Name", "Phone", "Amount", "Created"], ["Name", "Full Name", "Phone"])


@pytest.mark.parametrize(
    ("text", "operation", "parameters"),
    [
        ("Trim and lowercase Full Name.", "text.clean", {"columns": ["Full Name"], "actions": [{"kind": "trim"}, {"kind": "lowercase"}]}),
        ("trim all text columns", "text.clean", {"columns": ["Name", "Full Name", "Phone"], "actions": [{"kind": "trim"}]}),
        ("sort by Created newest first", "rows.sort", {"keys": [{"column": "Created", "descending": True, "nulls_last": True}]}),
        ("standardise the phone number in Phone", None, None),
        ("standardize mobile in Phone country code +91", "values.standardize", {"column": "Phone", "mode": "telephone", "invalid_policy": "leave", "default_country_code": "91"}),
        ("convert Amount to integer", "values.standardize", {"column": "Amount", "mode": "numeric_text", "invalid_policy": "leave", "numeric_target": "integer"}),
        ("mark duplicates by Name", "duplicates.handle", {"keys": ["Name"], "mode": "mark", "keep": "first"}),
        ("remove rows where Full Name is blank", "rows.filter", {"conditions": [{"kind": "blank", "is_blank": True, "column": "Full Name"}], "match": "all", "keep_matching": False}),
        ("keep rows where Amount >= 1.5", "rows.filter", {"conditions": [{"kind": "numeric", "operator": "ge", "value": 1.5, "column": "Amount"}], "match": "all", "keep_matching": True}),
        ("keep rows where Name starts with 'A'", "rows.filter", {"conditions": [{"kind": "starts_with", "value": "A", "case_sensitive": False, "column": "Name"}], "match": "all", "keep_matching": True}),
        ("filter rows where Name is 'A b'", "rows.filter", {"conditions": [{"kind": "exact", "value": "A b", "column": "Name"}], "match": "all", "keep_matching": True}),
        ("mark and remove duplicates", None, None),
        ("keep rows where Amount ~ 3", None, None),
        ("sort", None, None),
        ("make it nice", None, None),
        ("", None, None),
    ],
)
def test_instructions(text, operation, parameters):
    if operation is None:
        with pytest.raises(EngineError):
            PARSER.parse(text)
        return
    (found,) = PARSER.parse(text)
    assert (found.operation, found.parameters) == (operation, parameters)


def test_clauses_become_dependent_steps():
    steps = PARSER.parse("trim Name; sort by Amount then remove duplicates")
    assert [s.operation for s in steps] == ["text.clean", "rows.sort", "duplicates.handle"]
    assert [s.depends_on for s in steps] == [[], [steps[0].step_id], [steps[1].step_id]] and steps[2].destructive
    validate_plan(plan(*[s.model_dump(mode="json") for s in steps]))


def test_templates_and_history(tmp_path):
    p = plan(DROP)
    template = template_of(p, {"below": {"kind": "number", "path": [0, "parameters", "conditions", 0, "value"], "default": 3}})
    store = Store(tmp_path / "s.db")
    store.save_template(template)
    made = plan_from(store.template("job"), [{"file_name": "b.csv", "sha256": "1" * 64}], {"below": 9})
    assert made.steps[0].parameters["conditions"][0]["value"] == 9 and made.source_files[0].file_name == "b.csv"
    for wrong in ({"below": "x"}, {"other": 1}):
        with pytest.raises(EngineError):
            plan_from(template, [{"file_name": "b.csv", "sha256": "1" * 64}], wrong)
    job = store.add_job(made, "job")
    store.move(job, "previewed")
    with pytest.raises(EngineError):
        store.move(job, "completed")
    for status in ("approved", "running", "completed"):
        store.move(job, status)
    assert store.jobs(status="completed", text="JO") == [(str(job), "job", "completed")] and store.jobs(workflow="none") == []
    assert store.prune(0) == 1
