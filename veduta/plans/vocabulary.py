"""Words dealt to rows by their keys, so that rules written for words meet all of them in every table.

The same list as a Column for the query and as SQL for its counterpart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _literal(value: object) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def dealt(words: Sequence[str | None], key: Column) -> Column:
    """The word number ``key`` modulo their number."""
    return F.get(F.array(*[F.lit(w) for w in words]), F.pmod(key, F.lit(len(words))).cast("int"))


def dealt_sql(words: Sequence[str | None], key: str) -> str:
    return f"([{', '.join(map(_literal, words))}])[(({key}) % {len(words)}) + 1]"


def values_sql(rows: Sequence[Sequence[object]], name: str, columns: str) -> str:
    """A table of constants, as ``FROM``/``JOIN`` take it."""
    return f"(VALUES {', '.join('(' + ', '.join(str(x) if isinstance(x, int) else _literal(x) for x in r) + ')' for r in rows)}) AS {name}({columns})"
