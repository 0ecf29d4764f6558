"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Each operator lives in a
module of its own with a general interface; ``queries`` registers the thin
``opN_<name>`` queries over the driver's tables.
"""
