"""Importing this module registers every query."""

from voucherflow.plans import classification, console, evaluation, gst, learning, matching, normalization, streams  # noqa: F401
from voucherflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
