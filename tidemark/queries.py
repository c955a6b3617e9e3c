"""All registered queries; importing the plan modules fills the registry."""

from tidemark.plans import filings, outcomes, panels, relational, served, studies  # noqa: F401
from tidemark.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
