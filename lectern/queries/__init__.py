"""Queries over the driver's tables.

The tables hold no boxes, images or requests, so these are derived from their
columns by integer arithmetic that Spark and SQL evaluate alike.
"""
