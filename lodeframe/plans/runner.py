"""Running a plan over tables, previewing it, rejecting changes and publishing the result."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path
from typing import Any
from uuid import UUID

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import HIDDEN, ORDER, ORIGINAL_ORDER, ROW_ID, EngineError, check_names, position, qcol, require_columns, visible, with_columns
from ..operators import REGISTRY
from ..operators.base import OpResult
from ..operators.validation import Report, validate_table
from ..sources.formulas import FormulaSpec, spec_of
from . import diff, reconcile
from .backup import back_up
from .digests import table_digest
from .identity import apart, identified
from .publish import Publication, digests, output_names, source_state, write_parts
from .schema import OperationPlan, PlanStep, plan_rules, validate_plan

TableKey = tuple[UUID, str]


@dataclass
class StepRun:
    step: PlanStep
    key: TableKey
    result: OpResult
    before: DataFrame
    after: DataFrame

    #: The states before and after as diff.side() stores them, where a run has kept them.
    sides: tuple[DataFrame, DataFrame] | None = None

    def changes(self) -> DataFrame:
        return diff.changes(*(self.sides or (self.before, self.after)))


@dataclass
class Run:
    plan: OperationPlan
    sources: dict[TableKey, DataFrame]
    tables: dict[TableKey, DataFrame]
    steps: list[StepRun] = field(default_factory=list)
    #: With kept states, the first and the last of each table.
    first_sides: dict[TableKey, DataFrame] = field(default_factory=dict)
    last_sides: dict[TableKey, DataFrame] = field(default_factory=dict)

    def warnings(self) -> list[str]:
        return [f"{s.step.step_id}: {w}" for s in self.steps for w in s.result.told()]

    def metrics(self) -> dict[str, dict[str, Any]]:
        return {s.step.step_id: s.result.counts.values for s in self.steps}

    def digest(self) -> str:
        parts = [(str(k[0]), k[1], table_digest(t)) for k, t in sorted(self.tables.items(), key=lambda x: (str(x[0][0]), x[0][1]))]
        return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


def with_ids(tables: dict[TableKey, DataFrame]) -> dict[TableKey, DataFrame]:
    """Tables with row ids that no two rows of the job share, table after table in the order of their keys."""
    return apart({key: tables[key] for key in sorted(tables, key=lambda k: (str(k[0]), k[1]))})


def _target(step: PlanStep, tables: dict[TableKey, DataFrame]) -> TableKey:
    own = [k for k in tables if k[0] == step.target.source_id]
    if step.target.sheet is not None:
        own = [k for k in own if k[1] == step.target.sheet]
    if len(own) != 1:
        raise EngineError(f"{step.step_id}: the target names {len(own)} tables")
    return own[0]


def run_plan(plan: OperationPlan, tables: dict[TableKey, DataFrame], keep: bool = False) -> Run:
    """Runs the enabled steps in order. Everything stays lazy but for what a step has to know of its data.

    With ``keep``, each state of a table that a step changes is stored once, in buckets of the row ids: the next step and the
    comparisons of both steps read it, so that no step runs again for a later one and no comparison shuffles.
    """
    params = validate_plan(plan)
    sources = with_ids(tables)
    run = Run(plan, sources, dict(sources))
    side_of = run.last_sides

    def kept(key: TableKey, df: DataFrame) -> DataFrame:
        side_of[key] = diff.side(df)
        run.tables[key] = side_of[key].drop(diff.PLACE)
        return run.tables[key]

    if keep:
        targets = {step.target.source_id for step in plan.steps if step.enabled}
        for key in sources:
            if key[0] in targets:
                sources[key] = kept(key, sources[key])
        run.first_sides.update(side_of)
    for step in plan.steps:
        if not step.enabled:
            continue
        op = REGISTRY[step.operation]
        if op.many:
            own = {k: t for k, t in run.tables.items() if k[0] == step.target.source_id}
            key = (step.target.source_id, step.target.sheet) if step.target.sheet else next(iter(sorted(own, key=lambda k: k[1])), None)
            if key not in own:
                raise EngineError(f"{step.step_id}: unknown target")
            before = own[key]
            result = op.build({k[1]: t for k, t in own.items()}, params[step.step_id])
        else:
            key = _target(step, run.tables)
            before = run.tables[key]
            require_columns(before, step.target.columns)
            result = op.build(before, params[step.step_id])
        after = result.df if ROW_ID in result.df.columns else identified(result.df)
        check_names(after)
        run.tables[key] = after
        sides = None
        if keep:
            earlier = side_of[key]
            after = kept(key, after)
            sides = (earlier, side_of[key])
        for name, table in result.aux.items():
            if (key[0], name) in run.tables:
                raise EngineError(f"{step.step_id}: table {name!r} exists already")
            if not table.columns:
                continue
            run.tables[key[0], name] = table if ROW_ID in table.columns else identified(table)
            if keep:
                kept((key[0], name), run.tables[key[0], name])
        run.steps.append(StepRun(step, key, result, before, after, sides))
    return run


def named(plan: OperationPlan, keys: Iterable[TableKey]) -> dict[TableKey, str]:
    """The names that tables leave the engine under: no two of a job are equal, though their sheets' may be."""
    return output_names(list(keys), {s.source_id: s.file_name for s in plan.source_files})


def exported(df: DataFrame) -> DataFrame:
    """A table as it leaves the engine: in order, without hidden columns."""
    ordered = df.orderBy(position(df)) if ROW_ID in df.columns else df
    return ordered.select(*[qcol(c) for c in visible(df)])


def validate_run(run: Run) -> Report:
    """The plan's own rules, on the table of its last enabled step (or its only table)."""
    rules = plan_rules(run.plan)
    if not rules:
        return Report(0, ())
    key = run.steps[-1].key if run.steps else next(iter(run.tables))
    table = run.tables[key]
    bare = table.select(*[qcol(c) for c in table.columns if not c.startswith(HIDDEN) or c in (ROW_ID, ORDER)])
    return validate_table(bare, rules, visible(run.sources[key]) if key in run.sources else None)


def all_reports(run: Run) -> Report:
    """What the steps that validate found and what the plan's own rules find at the end, as one report: any error in it keeps
    a result from being published."""
    reports = [s.result.report for s in run.steps if s.result.report is not None] + [validate_run(run)]
    return Report(sum(r.checks_run for r in reports), tuple(i for r in reports for i in r.issues))


@dataclass
class Preview:
    run: Run
    plan_digest: str
    result_digest: str
    changes: int
    sample: list[dict[str, Any]]

    @property
    def digest(self) -> str:
        return hashlib.sha256(f"{self.plan_digest}:{self.result_digest}".encode()).hexdigest()


def preview(plan: OperationPlan, tables: dict[TableKey, DataFrame], limit: int = 10_000) -> Preview:
    """Runs a plan and gathers what a reviewer sees: how many changes, and the first of them."""
    run = run_plan(plan, tables, keep=True)
    total, seen = 0, []
    for s in run.steps:
        found = s.changes()
        total += found.count()
        if len(seen) < limit:
            seen += [r.asDict() | {"step_id": s.step.step_id} for r in diff.sample(found, limit - len(seen)).collect()]
    return Preview(run, plan.digest(), run.digest(), total, seen)


@dataclass(frozen=True)
class Approval:
    digest: str
    confirmed_steps: frozenset[str] = frozenset()
    rejected_changes: frozenset[str] = frozenset()


def approve(seen: Preview, confirmed_steps: Iterable[str] = (), rejected_changes: Iterable[str] = ()) -> Approval:
    """Approves what was previewed. Each destructive step has to be confirmed; only changed cells of the sample can be
    rejected."""
    confirmed, rejected = frozenset(confirmed_steps), frozenset(rejected_changes)
    open_steps = {s.step.step_id for s in seen.run.steps if s.step.destructive} - confirmed
    if open_steps:
        raise EngineError("steps to confirm: " + ", ".join(sorted(open_steps)))
    cells = {c["change_id"] for c in seen.sample if c["kind"] == "cell_changed"}
    if not rejected <= cells:
        raise EngineError("only changed cells of the preview can be rejected")
    return Approval(seen.digest, confirmed, rejected)


def without_rejected(seen: Preview, rejected: frozenset[str]) -> dict[TableKey, DataFrame]:
    """The run's tables with rejected changes undone, the latest first, so that a cell gets back the value that it had
    before the earliest rejected step. One broadcast join for each table."""
    steps = {s.step.step_id: s for s in seen.run.steps}
    undo: dict[TableKey, dict[tuple[int, str], Any]] = {}
    for c in reversed(seen.sample):
        if c["change_id"] in rejected:
            undo.setdefault(steps[c["step_id"]].key, {})[c["row_id"], c["column"]] = c["old"]
    tables = dict(seen.run.tables)
    for key, cells in undo.items():
        df = tables[key]
        for column in sorted({c for _, c in cells}):
            rows = [(i, v) for (i, c), v in cells.items() if c == column]
            table = F.broadcast(df.sparkSession.createDataFrame(rows, "`__lf_undo` long, `__lf_old` string"))
            joined = df.join(table, qcol(ROW_ID) == F.col("__lf_undo"), "left")
            old = F.col("__lf_old").cast(df.schema[column].dataType)
            df = with_columns(joined, {column: F.when(F.col("__lf_undo").isNotNull(), old).otherwise(qcol(column))}).drop("__lf_undo", "__lf_old")
        tables[key] = df
    return tables


def reconcile_run(run: Run, tables: dict[TableKey, DataFrame] | None = None, report: Report | None = None) -> dict[str, Any]:
    """How the tables differ from their sources (rows, totals, created and modified tables), the records that break rules, the
    required values that are missing, the warnings, and a status: failed, passed_with_warnings or passed."""
    tables = tables or run.tables
    report = all_reports(run) if report is None else report
    names = named(run.plan, tables)
    out: dict[str, Any] = {"created_tables": sorted(names[k] for k in tables if k not in run.sources), "tables": {}}
    modified = []
    for key, before in run.sources.items():
        same = tables[key] is run.tables[key] and key in run.first_sides
        sides = (run.first_sides[key], run.last_sides[key]) if same else (before, tables[key])
        row = reconcile.row_changes(*sides).first().asDict()
        row["totals"] = {r["column"]: (r["before"], r["after"]) for r in reconcile.totals(before, tables[key]).collect()}
        out["tables"][names[key]] = row
        if visible(before) != visible(tables[key]) or row["rows_changed"] + row["rows_added"] + row["rows_removed"]:
            modified.append(names[key])
    out["modified_tables"] = sorted(modified)
    out["invalid_records"] = sum(i.affected_rows for i in report.issues)
    out["missing_required"] = sum(i.affected_rows for i in report.issues if i.code == "missing_required")
    out["warnings"] = len(run.warnings()) + sum(i.severity == "warning" for i in report.issues)
    out["status"] = "failed" if not report.passed else "passed_with_warnings" if out["warnings"] else "passed"
    out["duplicates_removed"] = sum(m.get("duplicate_rows", 0) for s, m in run.metrics().items() if next(x for x in run.steps if x.step.step_id == s).step.destructive)
    return out


def retained_formulas(plan: OperationPlan, tables: dict[TableKey, DataFrame]) -> dict[str, list[FormulaSpec]]:
    """For each table that leaves the engine, the calculations that a spreadsheet can do again, if the plan asks for them;
    only those whose columns are all still there."""
    found: dict[str, list[FormulaSpec]] = {}
    if not plan.output.retain_calculation_formulas:
        return found
    params, names = validate_plan(plan), named(plan, tables)
    for step in plan.steps:
        spec = spec_of(params[step.step_id].action) if step.enabled and step.operation == "calculate.column" else None
        own = [k for k in tables if k[0] == step.target.source_id and step.target.sheet in (None, k[1])]
        if spec is not None and own and {spec.output_column, *spec.operand_columns} <= set(tables[own[0]].columns):
            found.setdefault(names[own[0]], []).append(spec)
    return found


def execute(
    plan: OperationPlan, tables: dict[TableKey, DataFrame], seen: Preview, approval: Approval, destination: str | Path, write=None,
    sources: Iterable[str | Path] = (), backup_folder: str | Path | None = None, failed_folder: str | Path | None = None,
) -> dict[str, Any]:
    """Runs an approved plan anew and publishes its result as one step, or not at all.

    Tables are named by their sheets, or with several sources by file and sheet. Without ``write``, the executors write them
    as CSV or Parquet, as the plan says, to any store. ``write(tables, folder)`` instead writes local files, workbooks
    say, into a folder beside a destination on this machine. What is written takes the destination's place only if the
    result is that of the preview and meets the plan's rules. Nothing is ever overwritten. ``sources`` are files or folders
    that must not change meanwhile; backups of them can be made of local ones.
    """
    spark = next(iter(tables.values())).sparkSession
    with Publication(spark, destination, failed_folder, str(plan.job_id)) as staged:
        if approval.digest != seen.digest or plan.digest() != seen.plan_digest:
            raise EngineError("the approval is of another preview")
        before = {str(s): source_state(spark, s) for s in sources}
        receipts = [back_up(s, backup_folder, str(plan.job_id)) for s in before] if backup_folder else []
        run = run_plan(plan, tables, keep=True)
        if run.digest() != seen.result_digest:
            raise EngineError("the data or the plan has changed since the preview")
        final = without_rejected(Preview(run, seen.plan_digest, seen.result_digest, seen.changes, seen.sample), approval.rejected_changes)
        report = all_reports(Run(plan, run.sources, final, run.steps))
        if not report.passed:
            raise EngineError("validation failed: " + "; ".join(i.code for i in report.issues))
        names = named(plan, final)
        leaving = {names[k]: exported(t) for k, t in final.items()}
        if write is None:
            known = write_parts(leaving, staged.folder, "csv" if plan.output.format == "csv" else "parquet")
        else:
            formulas = retained_formulas(plan, final)
            write(leaving, staged.local(), **({"formulas": formulas} if formulas else {}))
            known = {}
        audit = {
            "plan": seen.plan_digest,
            "preview": seen.digest,
            "job": plan.job_name,
            "finished": datetime.now(UTC).isoformat(),
            "steps": [{"id": s.step.step_id, "operation": s.step.operation, "metrics": s.result.counts.values} for s in run.steps],
            "rejected_changes": len(approval.rejected_changes),
            "checks_run": report.checks_run,
            "reconciliation": reconcile_run(run, final, report),
            "sources": before,
            "backups": [r.copy for r in receipts],
        }
        parts = digests(spark, staged.folder)
        staged.store.write(f"{staged.folder}/audit.json", json.dumps(audit, default=str, indent=1))
        changed = [s for s, f in before.items() if source_state(spark, s) != f]
        if changed:
            raise EngineError("sources have changed meanwhile: " + ", ".join(changed))
        staged.commit({"job": str(plan.job_id), "plan": seen.plan_digest, "tables": known, "parts": parts})
    return audit


__all__ = ["Approval", "Preview", "Run", "approve", "execute", "preview", "run_plan", "all_reports", "validate_run", "without_rejected", "ORIGINAL_ORDER"]
