"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames, keeps one row per input row unless it says otherwise, and
cuts lineage only by tables written to the shared checkpoint folder, so that a
lost executor never loses a result.
"""
