"""Failure-triage analytics on PySpark."""
