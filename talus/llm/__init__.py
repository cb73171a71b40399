"""Operators of a training-data pipeline: one module per operator, their queries in `queries`.

Nothing else in the library imports this package. Every operator takes frames with at least the columns it names,
ignores any others (whatever their names) and returns what its docstring says.
"""
