"""Plans from elsewhere, as JSON: bounded in size, depth and number of values before they are looked at."""

from __future__ import annotations

import json
from typing import Any

from pydantic import Field, ValidationError

from ..functions.core import EngineError
from .schema import PlanStep, Strict

# Bytes, depth and values of a response at most.
BYTES, DEPTH, VALUES = 1_000_000, 40, 50_000


class Response(Strict):
    steps: list[PlanStep] = Field(default_factory=list)


def _refuse(text: str) -> Any:
    raise ValueError(f"{text} is no JSON number")


def parse_response(text: str) -> Response:
    """One JSON object and nothing else."""
    try:
        if len(text.encode()) > BYTES:
            raise EngineError("the response is too long")
        value = json.loads(text, parse_constant=_refuse)
    except EngineError:
        raise
    except (ValueError, RecursionError) as e:
        raise EngineError("the response is no JSON") from e
    if not isinstance(value, dict):
        raise EngineError("the response must be one JSON object")
    level, seen = [value], 0
    for _ in range(DEPTH + 1):
        seen += len(level)
        if seen > VALUES:
            raise EngineError("the response holds too many values")
        level = [v for x in level if isinstance(x, (dict, list)) for v in (x.values() if isinstance(x, dict) else x)]
        if not level:
            break
    else:
        raise EngineError("the response is nested too deeply")
    try:
        return Response.model_validate(value)
    except ValidationError as e:
        raise EngineError("the response is no plan") from e
