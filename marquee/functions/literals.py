"""Columns holding Python literal lists of dicts, and the names taken from them.

JSON readers turn ``None``, ``True`` and ``\\x`` escapes into NULL, so the literal
itself is parsed in one Arrow-batched UDF; everything after it is native.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRIES = T.ArrayType(
    T.StructType([T.StructField("name", T.StringType()), T.StructField("job", T.StringType())])
)


def _entry(entry):
    if not isinstance(entry, dict):
        return {"name": None, "job": None}
    name, job = entry.get("name"), entry.get("job")
    return {
        "name": name if isinstance(name, str) else None,
        "job": job if isinstance(job, str) else ("" if "job" in entry else None),
    }


def _entries(value):
    try:
        return [_entry(entry) for entry in ast.literal_eval(value)]
    except Exception:
        return None


@F.pandas_udf(ENTRIES)
def parse_entries(values: pd.Series) -> pd.Series:
    return values.map(_entries)


def _joined(names: Column) -> Column:
    # A missing name makes the whole value unusable, as an unparseable list does.
    broken = F.exists(names, lambda n: n.isNull())
    return F.when(names.isNull() | broken, F.lit("")).otherwise(F.array_join(names, " "))


def _squeezed(entry: Column) -> Column:
    return F.replace(entry["name"], F.lit(" "), F.lit(""))


def genre_names(entries: Column) -> Column:
    return _joined(F.transform(entries, lambda e: e["name"]))


def keyword_names(entries: Column) -> Column:
    return _joined(F.transform(entries, _squeezed))


def cast_names(entries: Column, n: int = 3) -> Column:
    return _joined(F.transform(F.slice(entries, 1, n), _squeezed))


def director_name(entries: Column) -> Column:
    """Name of the first crew member whose job is Director.

    An entry without a job ahead of the director spoils the list, so the first
    entry that either has no job or directs decides.
    """
    decisive = F.try_element_at(
        F.filter(entries, lambda e: e["job"].isNull() | (e["job"] == "Director")), F.lit(1)
    )
    return F.when(decisive["job"] == "Director", F.coalesce(_squeezed(decisive), F.lit(""))).otherwise(
        F.lit("")
    )
