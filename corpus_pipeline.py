"""The corpus pipeline, whose stages are in ``tessera.llm.pipeline``."""

from __future__ import annotations

from tessera.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
