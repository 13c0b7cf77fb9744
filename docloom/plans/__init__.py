"""The catalogue of queries, each with SQL that gives the same rows."""

from . import comparing, extracting, files, inspecting, laying_out, relating, ruling, selecting, streaming  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
