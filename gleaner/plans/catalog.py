"""Every registered query: importing the modules fills the registry."""

from . import analytics, citations, code, episodes, followup, joint, lifecycle, positions, relational, retrieval, set_returning, state, validation  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
