"""Column and view names: quoting, making unique, matching by likeness."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """Backtick-quote a column name so that dots and spaces are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by its literal name (``F.col`` would split it at dots)."""
    return F.col(quoted(name))


def unique_names(names: Iterable[str], blank: str = "column") -> list[str]:
    """``x, x, '' -> x, x_2, column``; a generated name never meets a given one."""
    given = [str(n or "").strip() or blank for n in names]
    taken: set[str] = set()
    result = []
    for name in given:
        pick, n = name, 1
        while pick in taken or (n > 1 and pick in given):
            n += 1
            pick = f"{name}_{n}"
        taken.add(pick)
        result.append(pick)
    return result


def view_name(relative_path: str) -> str:
    """View name for a file: its relative path without extension, cleaned."""
    stem = re.sub(r"\.[^./\\]*$", "", relative_path)
    cleaned = re.sub(r"[^0-9A-Za-z_]+", "_", stem).strip("_") or "data"
    return f"_{cleaned}" if cleaned[0].isdigit() else cleaned


def unique_view_names(relative_paths: Iterable[str]) -> list[str]:
    """View names that differ also when case is ignored."""
    taken: set[str] = set()
    result = []
    for path in relative_paths:
        name = base = view_name(path)
        n = 1
        while name.lower() in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name.lower())
        result.append(name)
    return result


def letters_and_digits(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def likeness(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()
