"""The registered operators."""

from . import calculations, cleaning, columns, duplicates, filtering, fuzzy, sorting, standardise, tables, validation  # noqa: F401
from .base import REGISTRY, OpResult, Operator, apply  # noqa: F401
