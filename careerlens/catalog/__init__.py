"""All named checks."""

from careerlens.catalog import extraction, reports, rules, scoring  # noqa: F401
from careerlens.catalog.registry import ORACLES, QUERIES  # noqa: F401
