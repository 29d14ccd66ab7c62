"""Operators of a training-data pipeline; each module states its method, bounds and defined results."""
