"""Leakage audits of labelled corpora and benchmarks, on Spark DataFrames."""

from leaksift.session import build_session, materialise

__all__ = ["build_session", "materialise"]
