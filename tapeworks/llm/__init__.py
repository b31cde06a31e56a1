"""Operators for preparing training data at corpus scale, one module each.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries
when it is there.
"""

from tapeworks.llm.registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
