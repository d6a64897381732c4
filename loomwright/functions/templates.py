"""Prompt templates as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELD = re.compile(r"\{\{\s*(\w+)\s*\}\}")


def fields_of(template: str) -> list[str]:
    return list(dict.fromkeys(_FIELD.findall(template)))


def rendered(template: str, columns: Iterable[str]) -> Column:
    """``template`` with each ``{{field}}`` replaced by the column; null is empty, an unknown field a ValueError."""
    known = set(columns)
    if missing := [f for f in fields_of(template) if f not in known]:
        raise ValueError(f"the template names unknown columns: {missing}")
    parts, at = [], 0
    for m in _FIELD.finditer(template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(F.col(f"`{m[1]}`").cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def rendered_each(items: Column, template: str, separator: str = "\n") -> Column:
    """A loop over an array of structs: ``template`` for each item, joined."""
    def one(item: Column) -> Column:
        parts, at = [], 0
        for m in _FIELD.finditer(template):
            parts += [F.lit(template[at : m.start()]), F.coalesce(item[m[1]].cast("string"), F.lit(""))]
            at = m.end()
        return F.concat(*parts, F.lit(template[at:]))

    return F.array_join(F.transform(items, one), separator)
