"""Registered queries and their SQL."""

from . import answers, arrival, audit, checks, evidence, history, indicators, inquiry, panel, proofs, relations
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "answers", "arrival", "audit", "checks", "evidence", "history", "indicators", "inquiry", "panel", "proofs", "relations"]
