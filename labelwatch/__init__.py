"""Spark-native audit of labelled tables: leakage, duplicates, transfer and attribution agreement."""

from labelwatch.session import audit_session
from labelwatch.sources.views import LabelledTable

__all__ = ["LabelledTable", "audit_session"]
