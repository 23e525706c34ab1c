"""Queries of the engine's own operators and the SQL that each must agree with."""

from . import learned, recovery, sequences, statistics  # noqa: F401
from .book import ORACLE_SQL, QUERIES  # noqa: F401
