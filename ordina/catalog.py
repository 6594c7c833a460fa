"""Imports the modules that register queries."""

from .operators import auditing, building, contracts, events, fusion, geometry, layout, packages, panel, redaction, relational, review, sampling, scans, sequences, text  # noqa: F401
from .streaming import reviews, sessions  # noqa: F401
