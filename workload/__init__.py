"""Bookkeeping queries over the driver's tables, each with an equivalent SQL statement."""

from . import booking, books, journal, publishing, review, rules  # noqa: F401
from .tables import ORACLE, QUERIES  # noqa: F401
