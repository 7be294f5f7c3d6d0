"""Spark-native econometrics for large panels of time series.

A *panel* is a DataFrame in long form: ``series_id STRING, ts TIMESTAMP, value DOUBLE`` with at most
one row per ``(series_id, ts)``. Every operator takes and returns DataFrames and is lazy.
"""

from panelflow.session import build_session

__all__ = ["build_session"]
