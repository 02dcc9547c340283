"""Helpers for writing Spark SQL expressions as text.

The geometry and projection functions build one expression text each, which Spark parses in one
go. Arguments and results are SQL text; wrap a result in ``F.expr`` to use it as a column.
"""


def num(value):
    """A DOUBLE literal. A bare ``2.0`` would be a DECIMAL and change the arithmetic."""
    return f"{float(value)!r}D"


def let(name, value, body):
    """``body`` with ``name`` bound to ``value``, which is then worked out only once."""
    return f"transform(array({value}), {name} -> {body})[0]"
