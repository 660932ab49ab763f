"""Every operator as a named query over the given tables, with a SQL twin where SQL can say it."""

from . import index_family, modelling, observing, references, reporting, stage_zero, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
