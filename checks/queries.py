"""All registered queries."""

from checks import queries_lookup  # noqa: F401
from checks import queries_spatial  # noqa: F401
from checks import queries_text  # noqa: F401
from checks import queries_resolve  # noqa: F401
from checks import queries_upkeep  # noqa: F401
from checks import queries_intake  # noqa: F401
from checks import queries_review  # noqa: F401
from checks.registry import ORACLES, QUERIES, callables

__all__ = ["ORACLES", "QUERIES", "callables"]
