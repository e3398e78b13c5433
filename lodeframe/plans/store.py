"""Workflow templates and the history of jobs, in a small SQLite file of the driver's."""

from __future__ import annotations

import copy
import json
import sqlite3
from datetime import UTC, datetime
from pathlib import Path
from typing import Any
from uuid import UUID, uuid4

from ..functions.core import EngineError
from .schema import OperationPlan

# Types of template parameters, and the states of a job with those that may follow.
KINDS = {"text": str, "integer": int, "number": (int, float), "boolean": bool, "date": str, "column": str, "choice": str}
FOLLOWING = {
    "draft": {"previewed", "cancelled"},
    "previewed": {"approved", "cancelled", "draft"},
    "approved": {"running", "cancelled"},
    "running": {"completed", "failed"},
    "completed": set(),
    "failed": {"draft"},
    "cancelled": set(),
}


def template_of(plan: OperationPlan, parameters: dict[str, dict[str, Any]]) -> dict[str, Any]:
    """A plan without its files: sources become slots. parameters: name -> kind, path (of keys and indexes within the
    steps), and optionally default and choices."""
    body = plan.model_dump(mode="json")
    slots = {s["source_id"]: f"source{i}" for i, s in enumerate(body["source_files"])}
    for step in body["steps"]:
        step["target"]["source_id"] = slots[step["target"]["source_id"]]
    for name, p in parameters.items():
        if p["kind"] not in KINDS:
            raise EngineError(f"{name}: unknown kind {p['kind']!r}")
        _at(body["steps"], p["path"])
    return {
        "name": plan.job_name,
        "slots": list(slots.values()),
        "steps": body["steps"],
        "validations": body["validations"],
        "output": body["output"],
        "parameters": parameters,
    }


def _at(value: Any, path: list) -> Any:
    for key in path:
        try:
            value = value[key]
        except (KeyError, IndexError, TypeError) as e:
            raise EngineError(f"no place {path!r}") from e
    return value


def plan_from(template: dict[str, Any], sources: list[dict[str, Any]], values: dict[str, Any] | None = None) -> OperationPlan:
    """A plan for files (file_name, sha256, ...), one for each slot, with the values of the parameters."""
    values = dict(values or {})
    if len(sources) != len(template["slots"]):
        raise EngineError(f"{len(template['slots'])} files are needed")
    steps = copy.deepcopy(template["steps"])
    for name, p in template["parameters"].items():
        value = values.pop(name, p.get("default"))
        fits = isinstance(value, KINDS[p["kind"]]) and not (isinstance(value, bool) and p["kind"] in ("integer", "number"))
        if not fits or (p.get("choices") and value not in p["choices"]):
            raise EngineError(f"{name}: {value!r} doesn't fit")
        _at(steps, p["path"][:-1])[p["path"][-1]] = value
    if values:
        raise EngineError("unknown parameters: " + ", ".join(values))
    files = [{"source_id": str(uuid4())} | s for s in sources]
    ids = {slot: f["source_id"] for slot, f in zip(template["slots"], files)}
    for step in steps:
        step["target"]["source_id"] = ids[step["target"]["source_id"]]
    return OperationPlan.model_validate(
        {"job_name": template["name"], "source_files": files, "steps": steps, "validations": template["validations"], "output": template["output"]}
    )


class Store:
    def __init__(self, path: str | Path):
        self.db = sqlite3.connect(path)
        self.db.execute("CREATE TABLE IF NOT EXISTS template (name TEXT PRIMARY KEY, body TEXT NOT NULL)")
        self.db.execute(
            "CREATE TABLE IF NOT EXISTS job (id TEXT PRIMARY KEY, name TEXT, workflow TEXT, status TEXT, plan TEXT, at TEXT)"
        )

    def save_template(self, template: dict[str, Any]) -> None:
        with self.db:
            self.db.execute("INSERT OR REPLACE INTO template VALUES (?, ?)", (template["name"], json.dumps(template)))

    def template(self, name: str) -> dict[str, Any]:
        row = self.db.execute("SELECT body FROM template WHERE name = ?", (name,)).fetchone()
        if row is None:
            raise EngineError(f"no template {name!r}")
        return json.loads(row[0])

    def add_job(self, plan: OperationPlan, workflow: str | None = None) -> UUID:
        at = datetime.now(UTC).isoformat()
        with self.db:
            self.db.execute("INSERT INTO job VALUES (?, ?, ?, 'draft', ?, ?)", (str(plan.job_id), plan.job_name, workflow, plan.model_dump_json(), at))
        return plan.job_id

    def status(self, job: UUID) -> str:
        row = self.db.execute("SELECT status FROM job WHERE id = ?", (str(job),)).fetchone()
        if row is None:
            raise EngineError("no such job")
        return row[0]

    def move(self, job: UUID, status: str) -> None:
        if status not in FOLLOWING.get(self.status(job), ()):
            raise EngineError(f"a job can't go from {self.status(job)} to {status}")
        with self.db:
            self.db.execute("UPDATE job SET status = ? WHERE id = ?", (status, str(job)))

    def jobs(self, status: str | None = None, workflow: str | None = None, text: str = "", limit: int = 50, offset: int = 0) -> list[tuple]:
        """(id, name, status), the latest first."""
        return self.db.execute(
            "SELECT id, name, status FROM job WHERE (?1 IS NULL OR status = ?1) AND (?2 IS NULL OR workflow = ?2)"
            " AND instr(lower(name), lower(?3)) > 0 ORDER BY at DESC, id LIMIT ?4 OFFSET ?5",
            (status, workflow, text, limit, offset),
        ).fetchall()

    def prune(self, keep: int) -> int:
        """Drops finished jobs beyond the latest ``keep``."""
        with self.db:
            return self.db.execute(
                "DELETE FROM job WHERE status IN ('completed', 'cancelled', 'failed') AND id NOT IN"
                " (SELECT id FROM job ORDER BY at DESC, id LIMIT ?)",
                (keep,),
            ).rowcount
