"""Operators of a training-data pipeline, one module per operator.

Nothing else in the package imports this subpackage.  Every operator takes and
returns DataFrames, selects the columns it needs first (further columns of the
input, whatever their names, are ignored) and keeps its own intermediates in
the cluster's shared folder (``spark.checkpoint.dir``).
"""
