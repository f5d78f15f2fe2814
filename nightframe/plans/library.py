"""All queries of the library's own operators."""

from . import almanac, detection, evaluation, files, frames, lines, pictures, raster, sky, solver, telemetry, text  # noqa: F401
from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
