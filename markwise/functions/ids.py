"""Content hashes and path ids."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_key(*parts: Column) -> Column:
    """sha256 of the concatenated parts."""
    return F.sha2(F.concat(*[p.cast("string") for p in parts]), 256)


def canonical_json(params: Column) -> Column:
    """A string map as JSON with sorted keys and Python's separators."""
    quote = lambda c: F.to_json(F.array(c))  # escapes; the brackets are cut off
    inner = lambda c: F.substr(quote(c), F.lit(2), F.length(quote(c)) - 2)
    entries = F.transform(
        F.array_sort(F.map_entries(params)), lambda e: F.concat(inner(e["key"]), F.lit(": "), inner(e["value"]))
    )
    return F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))


def recipe_key(params: dict) -> str:
    """sha256 of a recipe's parameters; part of every conversation id."""
    return hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()


def question_path(*parts: Column) -> Column:
    """``category/template/idx/kind/video/number/shuffle``."""
    return F.concat_ws("/", *[p.cast("string") for p in parts])
