"""Design parameters: parsing them from comment text, and reading them out of maps."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sweeplane.functions.complexcols import NAN

#: Fixed value: how a comment states parameters.
PATTERN = r"(?i)Parameters\s*=\s*\{([^}]*)\}"
_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:nan|inf|infinity)$"


def raw_params(comments: Column) -> Column:
    """The text between the braces, from an array of comment lines; empty without any."""
    return F.regexp_extract(F.array_join(F.transform(comments, F.trim), " "), PATTERN, 1)


def _number(text: Column) -> Column:
    plain = F.replace(text, F.lit(","), F.lit("."))
    return F.when(plain.rlike(_NUMBER), plain.try_cast("double"))


def _entries(raw: Column) -> Column:
    """place, k, v: trimmed keys and texts in their order; items without '=' or key are dropped, the last of a repeated key wins.

    Every step reads the one before it once: an expression named twice is worked out twice, and in a lambda for each item.
    """
    item = lambda x, n: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), (-n).alias("back"), F.trim(F.substr(x, F.instr(x, "=") + 1)).alias("v"))
    items = F.filter(F.transform(F.filter(F.split(raw, ";"), lambda x: F.instr(x, "=") > 0), item), lambda x: x["k"] != "")
    # Sorted by key, later items first: the first of a key is its last.
    last = lambda all_: F.filter(all_, lambda x, n: F.coalesce(F.get(all_, n - 1)["k"] != x["k"], F.lit(True)))
    kept = F.flatten(F.transform(F.array(F.sort_array(items)), last))
    return F.sort_array(F.transform(kept, lambda x: F.struct((-x["back"]).alias("place"), x["k"].alias("k"), x["v"].alias("v"))))


def numeric_params(raw: Column) -> Column:
    """key -> double of the values that read as numbers (a comma counts as the decimal mark)."""
    read = F.transform(_entries(raw), lambda x: F.struct(x["k"].alias("k"), _number(x["v"]).alias("v")))
    return F.map_from_entries(F.filter(read, lambda x: x["v"].isNotNull()))


def text_params(raw: Column) -> Column:
    """key -> text of the other values."""
    texts = F.filter(_entries(raw), lambda x: _number(x["v"]).isNull())
    return F.map_from_entries(F.transform(texts, lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"))))


def split_params(raw: str) -> tuple[dict[str, float], dict[str, str]]:
    """The same in Python, for readers of single files."""
    numbers: dict[str, float] = {}
    texts: dict[str, str] = {}
    for item in raw.split(";"):
        key, mark, value = item.partition("=")
        key, value = key.strip(), value.strip()
        if mark and key:
            numbers.pop(key, None)
            texts.pop(key, None)
            plain = value.replace(",", ".")
            if re.match(_NUMBER, plain):
                numbers[key] = float(plain)
            else:
                texts[key] = value
    return numbers, texts


def param(params: Column | str, key: str) -> Column:
    """A parameter's value, NaN where the sample has none."""
    return F.coalesce(F.try_element_at(params if isinstance(params, Column) else F.col(params), F.lit(key)), F.lit(NAN))


def select_keys(params: str, keys: list[str]) -> Column:
    """Only the listed keys, as far as they are there."""
    return F.map_filter(params, lambda k, _: k.isin(keys)) if keys else F.map_filter(params, lambda k, _: F.lit(False))
