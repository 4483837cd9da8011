"""Naming an intermediate value inside an expression."""

from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bound(fn):
    """Decorator: the first column argument is named, so lambdas inside fn do not recompute it."""

    @wraps(fn)
    def wrapped(first: Column, *args, **kwargs) -> Column:
        return let(first, lambda v: fn(v, *args, **kwargs))

    return wrapped
