"""File formats by extension and the reader options each of them takes."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension -> (family, exact source format).
FORMATS = {
    ".parquet": ("parquet", "parquet"),
    ".csv": ("csv", "csv"),
    ".tsv": ("tsv", "tsv"),
    ".psv": ("psv", "psv"),
    ".json": ("json", "json"),
    ".jsonl": ("json", "jsonl"),
    ".ndjson": ("json", "ndjson"),
    ".avro": ("avro", "avro"),
    ".orc": ("orc", "orc"),
    ".arrow": ("arrow", "arrow"),
    ".ipc": ("arrow", "ipc"),
    ".feather": ("feather", "feather"),
    ".xlsx": ("workbook", "xlsx"),
}
DELIMITERS = {"csv": ",", "tsv": "\t", "psv": "|"}
ENCODINGS = {
    "utf-8": "utf-8",
    "utf8": "utf-8",
    "latin-1": "latin-1",
    "latin1": "latin-1",
    "iso-8859-1": "latin-1",
    "utf-16": "utf-16",
    "utf16": "utf-16",
}


def format_of(path: str) -> tuple[str, str]:
    """(family, exact format) of a path, folder or glob by its extension."""
    lowered = path.lower().rstrip("/")
    for extension, found in FORMATS.items():
        if lowered.endswith(extension):
            return found
    raise ValueError(f"{path!r} has none of the supported extensions: {', '.join(FORMATS)}.")


def family_of(path: Column) -> Column:
    """The family of each path by its extension, or null."""
    found = F.lit(None).cast("string")
    for extension, (family, _) in FORMATS.items():
        found = F.when(F.lower(path).endswith(extension), F.lit(family)).otherwise(found)
    return found


@dataclass(frozen=True)
class Option:
    """An option's usual value, and the function that turns a given value into a valid one or raises ``ValueError``."""

    usual: object
    valid: Callable[[object], object]


def _flag(value: object) -> bool:
    if isinstance(value, (bool, int)):
        return bool(value)
    raise ValueError("it is neither true nor false")


def _text(least: int, most: int | None) -> Callable[[object], str]:
    def valid(value: object) -> str:
        if not isinstance(value, str) or len(value) < least or (most is not None and len(value) > most):
            raise ValueError(f"it is not a text of {least} to {most} characters" if most is not None else f"it is not a text of {least} characters or more")
        return value

    return valid


def _encoding(value: object) -> str:
    found = ENCODINGS.get(str(value).strip().lower())
    if not found:
        raise ValueError(f"the encodings are {', '.join(sorted(set(ENCODINGS.values())))}")
    return found


def _row(least: int) -> Callable[[object], int]:
    def valid(value: object) -> int:
        if isinstance(value, bool) or not isinstance(value, int) or value < least:
            raise ValueError(f"it is not a row number from {least} on")
        return value

    return valid


def record_path(value: object) -> str:
    """``$.a.b``, ``.a.b`` and ``a.b`` all mean ``a.b``; ``$`` and nothing mean the whole document."""
    if value is not None and not isinstance(value, str):
        raise ValueError("it is not a text")
    return re.sub(r"^(\$$|\$\.|\.)", "", (value or "").strip())


def _delimited(delimiter: str) -> dict[str, Option]:
    return {
        "header": Option(True, _flag),
        "delimiter": Option(delimiter, _text(1, None)),
        "encoding": Option("utf-8", _encoding),
        "quote": Option('"', _text(0, 1)),
        "escape": Option('"', _text(0, 1)),
        "null_string": Option("", _text(0, None)),
    }


# The options of each family; families that are not named take none.
OPTIONS: dict[str, dict[str, Option]] = {family: _delimited(delimiter) for family, delimiter in DELIMITERS.items()} | {
    "json": {"flatten": Option(False, _flag), "record_path": Option("", record_path), "require_objects": Option(False, _flag)},
    "workbook": {"header_row": Option(1, _row(0)), "data_start_row": Option(None, _row(1)), "infer_types": Option(False, _flag)},
}


def normalize_options(family: str, options: dict | None = None) -> dict:
    """The options of the family: given ones that are valid, usual ones for those not given (or null).

    An invalid value raises ``ValueError`` with the option's name; names the family does not know are left to the caller.
    """
    given = {k: v for k, v in (options or {}).items() if v is not None}
    result = {}
    for name, option in OPTIONS.get(family, {}).items():
        try:
            result[name] = option.valid(given[name]) if name in given else option.usual
        except ValueError as problem:
            raise ValueError(f"Option {name!r} cannot be {given[name]!r}: {problem}.") from None
    if family == "workbook":
        header = result["header_row"]
        if result["data_start_row"] is None:
            result["data_start_row"] = max(2, header + 1)
        if result["data_start_row"] <= header:
            raise ValueError("Data cannot start in or above the header row.")
    return result
