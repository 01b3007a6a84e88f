"""Checking SQL: each registered query written a second time for an outside engine."""

from oracles.sql import ORACLES

__all__ = ["ORACLES"]
