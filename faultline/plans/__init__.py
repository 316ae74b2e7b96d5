"""Queries, with oracle SQL for those that SQL can express."""
