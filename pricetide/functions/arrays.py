"""Small array helpers over images and history."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_or_null(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def last_or_null(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def known_elements(array: Column) -> Column:
    """The non-null elements; an empty array where there is none."""
    return F.coalesce(F.filter(array, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def non_empty(array: Column) -> Column:
    return F.when(F.size(array) > 0, array)


def newest(history: Column, n: int) -> Column:
    """The n newest entries, newest first. Entries start with their day, so they sort by it."""
    return F.slice(F.sort_array(history, False), 1, n)


def last_n(history: Column, n: int) -> Column:
    """The last n entries of an already ordered array, last one first."""
    return F.slice(F.reverse(history), 1, n)


def first_priced(history: Column) -> Column:
    return first_or_null(F.filter(history, lambda entry: entry["price"].isNotNull()))


def without(array: Column, element: Column) -> Column:
    """Distinct elements, minus one."""
    return F.array_except(F.array_distinct(array), F.array(element))
