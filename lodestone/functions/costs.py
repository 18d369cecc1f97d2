"""Costs of reading one code for another, in hundredths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings

#: Characters that are mistaken for one another, each group by the digit it is written with.
CONFUSED, CANONICAL = "ODILBSZGQ", "001185269"


def canonical(text: Column) -> Column:
    """Each character as its confusion group's digit."""
    return F.translate(text, CONFUSED, CANONICAL)


def substitution(a: Column, b: Column, settings: Settings = SETTINGS) -> Column:
    """Cost of reading character a for b: nothing, little within a confusion group, else all."""
    return F.when(a == b, F.lit(0)).when(canonical(a) == canonical(b), F.lit(settings.confused)).otherwise(F.lit(settings.replaced))


def length_cost(read: Column, code: Column, settings: Settings = SETTINGS) -> Column:
    """The least cost that the lengths alone imply."""
    return F.when(read > code, settings.spurious * (read - code)).otherwise(settings.dropped * (code - read))


def budget(code_length: Column, cap: int, settings: Settings = SETTINGS) -> Column:
    """The most that a match of a code may cost: less for shorter codes."""
    return F.least(F.lit(cap), (code_length - 2) * settings.per_digit)


def distance(read: Column, code: Column, settings: Settings = SETTINGS) -> Column:
    """Cost of having read ``read`` where ``code`` stood.

    Equal lengths are compared place by place, and only by substitution, which is the rule even
    where insertions and deletions would be cheaper. Unequal lengths take the cheapest alignment,
    a missing character costing ``dropped`` and an extra one ``spurious``.
    """
    t, c = F.split(read, ""), F.split(code, "")
    pairwise = F.aggregate(F.zip_with(t, c, lambda a, b: substitution(a, b, settings)), F.lit(0), lambda x, y: x + y)
    first = F.transform(F.sequence(F.lit(0), F.length(code)), lambda j: j.cast("int") * settings.dropped)

    def row(above: Column, i: Column) -> Column:
        def cell(left: Column, j: Column) -> Column:
            cost = substitution(F.get(t, i - 1), F.get(c, j - 1), settings)
            best = F.least(F.get(above, j) + settings.spurious, F.get(left, j - 1) + settings.dropped, F.get(above, j - 1) + cost)
            return F.concat(left, F.array(best))

        return F.when(F.length(code) > 0, F.aggregate(F.sequence(F.lit(1), F.length(code)), F.array(i * settings.spurious), cell)).otherwise(F.array(i * settings.spurious))

    aligned = F.when(F.length(read) > 0, F.aggregate(F.sequence(F.lit(1), F.length(read)), first, row)).otherwise(first)
    return F.when(F.length(read) == F.length(code), F.when(F.length(read) > 0, pairwise).otherwise(F.lit(0))).otherwise(F.element_at(aligned, -1))
