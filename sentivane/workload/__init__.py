"""The registered queries, each next to its SQL twin."""

from sentivane.workload import finance, reports, text, weak  # noqa: F401
from sentivane.workload.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
