"""Copies of sources that a job can't lose."""

from __future__ import annotations

import json
import shutil
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from pathlib import Path
from uuid import uuid4

from ..functions.core import EngineError
from ..functions.scalars import fingerprint


@dataclass(frozen=True)
class Receipt:
    """What is known of a copy: its job, the source's name, the copy's place and the source's fingerprint."""

    job: str
    source: str
    copy: str
    fingerprint: tuple[str, int]
    made: str


def _copied(source: Path, target: Path) -> None:
    """Copies a file or a folder to where nothing is yet; it appears there whole or not at all."""
    if target.exists():
        raise EngineError(f"{target.name} exists already")
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.parent / f".part-{uuid4().hex}"
    try:
        shutil.copytree(source, part) if source.is_dir() else shutil.copy2(source, part)
        if fingerprint(part) != fingerprint(source):
            raise EngineError(f"{source.name} has changed while it was copied")
        part.rename(target)
    finally:
        if part.is_dir():
            shutil.rmtree(part)
        else:
            part.unlink(missing_ok=True)


def back_up(source: str | Path, folder: str | Path, job: str) -> Receipt:
    """A copy of a source in the job's folder of backups, with a receipt beside it."""
    source, own = Path(source), Path(folder) / str(job)
    if not source.exists():
        raise EngineError(f"{source.name} doesn't exist")
    now = datetime.now(UTC)
    place = own / f"{now:%Y%m%dT%H%M%S}-{uuid4().hex}" / source.name
    seen = fingerprint(source)
    _copied(source, place)
    receipt = Receipt(str(job), source.name, str(place), seen, now.isoformat())
    (place.parent / "receipt.json").write_text(json.dumps(asdict(receipt)))
    return receipt


def backups(folder: str | Path, job: str) -> list[Receipt]:
    """The job's receipts whose copies are there and unchanged, the oldest first."""
    found = []
    for path in (Path(folder) / str(job)).glob("*/receipt.json"):
        try:
            told = json.loads(path.read_text())
            receipt = Receipt(**told | {"fingerprint": tuple(told["fingerprint"])})
            copy = path.parent / Path(receipt.copy).name
            if receipt.job == str(job) and copy == Path(receipt.copy) and fingerprint(copy) == receipt.fingerprint:
                found.append(receipt)
        except (OSError, KeyError, TypeError, ValueError):
            continue  # a receipt that can't be read stands for nothing
    return sorted(found, key=lambda r: r.made)


def restore(receipt: Receipt, destination: str | Path) -> Path:
    """The backed-up source at a new place; nothing is overwritten."""
    destination = Path(destination)
    if not Path(receipt.copy).exists() or fingerprint(receipt.copy) != receipt.fingerprint:
        raise EngineError(f"the copy of {receipt.source} is damaged")
    _copied(Path(receipt.copy), destination)
    return destination
