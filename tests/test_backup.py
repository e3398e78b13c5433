import json
import uuid

import pytest

from lodeframe.functions.core import EngineError
from lodeframe.plans.backup import back_up, backups, restore
from lodeframe.plans.runner import approve, execute, preview
from lodeframe.plans.schema import OperationPlan
from lodeframe.sources.readers import read_csv
from lodeframe.sources.writers import write_tables


def test_backups_are_whole_and_checked(tmp_path):
    one, many = tmp_path / "a.csv", tmp_path / "t"
    one.write_text("x\n1\n")
    many.mkdir()
    (many / "part").write_text("y")
    receipts = [back_up(p, tmp_path / "kept", "job") for p in (one, many)]
    assert backups(tmp_path / "kept", "job") == receipts and backups(tmp_path / "kept", "other") == []
    one.write_text("changed")
    assert restore(receipts[0], tmp_path / "new.csv").read_text() == "x\n1\n" and (restore(receipts[1], tmp_path / "u") / "part").read_text() == "y"
    with pytest.raises(EngineError):
        restore(receipts[0], one)
    (tmp_path / "kept" / "job" / "junk").mkdir()
    (tmp_path / "kept" / "job" / "junk" / "receipt.json").write_text("{}")
    with open(receipts[1].copy + "/part", "w") as f:
        f.write("damaged")
    assert backups(tmp_path / "kept", "job") == receipts[:1]
    with pytest.raises(EngineError):
        restore(receipts[1], tmp_path / "v")
    with pytest.raises(EngineError):
        back_up(tmp_path / "none", tmp_path / "kept", "job")


def test_a_job_backs_up_and_puts_failures_aside(spark, tmp_path):
    source, path = str(uuid.uuid4()), tmp_path / "c.csv"
    path.write_text("Name\n A \n")
    step = {"step_id": "s", "operation": "text.clean", "parameters": {"columns": ["Name"], "actions": [{"kind": "trim"}]}, "target": {"source_id": source}, "explanation": "x"}
    plan = OperationPlan.model_validate({"job_name": "j", "source_files": [{"source_id": source, "file_name": "c.csv", "sha256": "0" * 64}], "steps": [step], "output": {"output_name": "o", "format": "csv"}})
    tables = {(uuid.UUID(source), "CSV"): read_csv(spark, str(path))}
    seen = preview(plan, tables)

    def failing(t, folder):
        write_tables(t, folder)
        raise OSError("disk full")

    places = {"sources": [path], "backup_folder": tmp_path / "kept", "failed_folder": tmp_path / "failed"}
    with pytest.raises(OSError):
        execute(plan, tables, seen, approve(seen), tmp_path / "out", failing, **places)
    (failed,) = (tmp_path / "failed").iterdir()
    assert (failed / "failed.txt").read_text() == "disk full" and (failed / "CSV.csv").exists() and not (tmp_path / "out").exists()

    def meanwhile(t, folder):
        write_tables(t, folder)
        path.write_text("Name\nother\n")

    with pytest.raises(EngineError, match="changed meanwhile"):
        execute(plan, tables, seen, approve(seen), tmp_path / "out", meanwhile, **places)
    assert not (tmp_path / "out").exists()
    path.write_text("Name\n A \n")
    audit = execute(plan, tables, seen, approve(seen), tmp_path / "out", write_tables, **places)
    assert len(audit["backups"]) == 1 and len(backups(tmp_path / "kept", str(plan.job_id))) == 3
    assert json.loads((tmp_path / "out" / "audit.json").read_text())["sources"] and not [p for p in tmp_path.iterdir() if p.name.startswith(".staged")]
