"""Constant tables as single expressions, folded to a literal by the optimizer."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(values: Iterable[str]) -> str:
    items = ", ".join(sql_text(value) for value in values)
    return f"array({items})" if items else "CAST(array() AS ARRAY<STRING>)"


def text_array(values: Iterable[str]) -> Column:
    return F.expr(sql_array(values))


def text_map(table: dict[str, str]) -> Column:
    return F.expr(f"map_from_arrays({sql_array(table)}, {sql_array(table.values())})")


def no_texts() -> Column:
    return F.expr("CAST(array() AS ARRAY<STRING>)")
