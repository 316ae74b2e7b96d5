"""Sources, sinks and the views that stand for the domain tables."""
