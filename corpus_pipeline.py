"""The corpus pipeline: quality rules, n-gram join, substring dedup, mixing, packing. See the subpackage ``llm``."""

from tallyweave.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
