"""The corpus pipeline over ``documents``: the stages, their SQL and ``run`` of plumbline.llm.pipeline."""

from plumbline.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
