"""Docketry: a PySpark engine for triaging records that people must review."""
