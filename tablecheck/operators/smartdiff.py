"""Diff of two tables with inferred column mapping and key."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names, values
from ..functions import types as ty
from ..plans.aggregate import column_metrics
from ..plans.joining import outer_join
from ..plans.small import small_frame
from .compare import UNCHANGED, Pair, check_mapping, compared_columns

# Confidence of each kind of name match, key name scores and weights.
EXACT, OTHER_CASE, SAME_LETTERS = 1.0, 0.96, 0.9
LEAST_CONFIDENCE = 0.78
KEY_NAMES = ("id", "key", "pk")
KEY_ENDINGS = ("id", "key")
KEY_HINTS = ("uuid", "guid", "code", "number", "no")
KEY_NAME_SCORE, KEY_ENDING_SCORE, KEY_HINT_SCORE = 6, 4, 3
SAME_NAME_BONUS = 1
UNIQUE_WEIGHT = NULL_WEIGHT = 4
# Standard deviation of a distinct count from a sketch, and how many of them the bounds are away.
SKETCH_ERROR, SKETCH_WIDTH = 0.02, 8


def _confidence(base: str, compare: str) -> tuple[float, str]:
    if base == compare:
        return EXACT, "exact"
    if base.lower() == compare.lower():
        return OTHER_CASE, "case-insensitive"
    a, b = names.letters_and_digits(base), names.letters_and_digits(compare)
    if a and a == b:
        return SAME_LETTERS, "normalized"
    return names.likeness(a, b), "fuzzy"


def infer_pairs(base: DataFrame, other: DataFrame) -> list[Pair]:
    """Best free compare column of the same type for each base column, in order."""
    free = list(other.schema.fields)
    pairs = []
    for b in base.schema.fields:
        scored = [(*_confidence(b.name, c.name), c) for c in free if ty.signature(b.dataType) == ty.signature(c.dataType)]
        if not scored:
            continue
        confidence, kind, best = max(scored, key=lambda s: s[0])
        if confidence >= LEAST_CONFIDENCE:
            free.remove(best)
            pairs.append(Pair(b.name, best.name, kind, round(confidence, 2)))
    if not pairs:
        raise ValueError("No columns of the two tables have like names and types.")
    return pairs


def infer_mapping(base: DataFrame, other: DataFrame) -> DataFrame:
    """Inferred pairs, then the columns left out on either side (``match_type`` 'skipped')."""
    pairs = infer_pairs(base, other)
    rows = [(p.base, p.compare, p.display, p.match_type, p.confidence) for p in pairs]
    used_base, used_compare = {p.base for p in pairs}, {p.compare for p in pairs}
    rows += [(c, None, c, "skipped", None) for c in base.columns if c not in used_base]
    rows += [(None, c, c, "skipped", None) for c in other.columns if c not in used_compare]
    return small_frame(base.sparkSession, rows, "base_column string, compare_column string, display_column string, match_type string, confidence double"
    )


def mapping_counts(pairs: list[Pair]) -> tuple[int, int]:
    """(exact, fuzzy): a difference in case alone counts as exact."""
    exact = sum(p.match_type in ("exact", "case-insensitive") for p in pairs)
    return exact, len(pairs) - exact


def _name_score(name: str) -> int:
    plain = names.letters_and_digits(name)
    if plain in KEY_NAMES:
        return KEY_NAME_SCORE
    if plain.endswith(KEY_ENDINGS):
        return KEY_ENDING_SCORE
    return KEY_HINT_SCORE if any(hint in plain for hint in KEY_HINTS) else 0


def _candidate_counts(df: DataFrame, columns: list[str], side: str) -> DataFrame:
    """total, distinct and null count of each column: one read, one shuffle.

    Each value becomes a (position, text) pair, so any number of columns
    shares the same two-step count and a hot value is combined before the
    shuffle.
    """
    texts = [values.compact(values.as_text(names.col(c), df.schema[c].dataType)).alias(f"v{i}") for i, c in enumerate(columns)]
    stacked = ", ".join(f"{i}, v{i}" for i in range(len(columns)))
    long = df.select(*texts).selectExpr(f"stack({len(columns)}, {stacked}) as (pos, v)")
    return (
        long.groupBy("pos", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("pos")
        .agg(
            F.sum("n").alias(f"{side}_total"),
            F.count("v").alias(f"{side}_distinct"),
            F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias(f"{side}_nulls"),
        )
    )


def _usable(base: DataFrame, other: DataFrame, pairs: list[Pair]) -> list[Pair]:
    """Pairs whose columns can be keys."""
    return [p for p in pairs if ty.can_be_key(base.schema[p.base].dataType) and ty.can_be_key(other.schema[p.compare].dataType)]


def _pair_score(pair: Pair) -> float:
    """What the names alone give."""
    return float(max(_name_score(pair.base), _name_score(pair.compare)) + SAME_NAME_BONUS * (pair.base == pair.compare))


def key_stats(base: DataFrame, other: DataFrame, pairs: list[Pair] | None = None) -> DataFrame:
    """Counts and key score of each mapped pair that can be a key."""
    usable = _usable(base, other, pairs or infer_pairs(base, other))
    rows = [(i, p.base, p.compare, _pair_score(p)) for i, p in enumerate(usable)]
    known = small_frame(base.sparkSession, rows, "pos int, base_column string, compare_column string, name_score double")
    counts = ("base_total", "base_distinct", "base_nulls", "compare_total", "compare_distinct", "compare_nulls")
    if usable:
        known = known.join(_candidate_counts(base, [p.base for p in usable], "base"), "pos", "left")
        known = known.join(_candidate_counts(other, [p.compare for p in usable], "compare"), "pos", "left")
    else:
        known = known.select("*", *[F.lit(0).alias(c) for c in counts])
    known = known.fillna(0, list(counts))

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    unique = share("base_distinct", "base_total") + share("compare_distinct", "compare_total")
    empty = share("base_nulls", "base_total") + share("compare_nulls", "compare_total")
    score = F.col("name_score") + unique * UNIQUE_WEIGHT - empty * NULL_WEIGHT
    return known.select("pos", "base_column", "compare_column", *counts, score.alias("score"))


@dataclass(frozen=True)
class ScoreBounds:
    """A pair and the limits its exact key score lies between."""

    pair: Pair
    low: float
    high: float


def key_bounds(base: DataFrame, other: DataFrame, pairs: list[Pair]) -> list[ScoreBounds]:
    """Limits of the key scores from one pass over each table, with a sketch of distinct values for each column.

    Rows and nulls are exact. A sketch is off by ``SKETCH_ERROR`` in the
    standard deviation; limits are ``SKETCH_WIDTH`` of these away, and a column
    never has more distinct values than filled rows, nor none if it has one.
    No value is shuffled. Brings a row per mapped column to the driver.
    """
    usable = _usable(base, other, pairs)

    def measured(df: DataFrame, columns: list[str]) -> dict[str, tuple]:
        schema = {"total": "bigint", "filled": "bigint", "distinct_count": "bigint"}

        def metrics(name: str, dtype: T.DataType) -> dict[str, Column]:
            value = values.plain_zero(names.col(name), dtype)
            return {"total": F.count(F.lit(1)), "filled": F.count(value), "distinct_count": F.approx_count_distinct(value, SKETCH_ERROR)}

        return {r["column"]: (r["total"], r["filled"], r["distinct_count"]) for r in column_metrics(df, metrics, schema, columns).collect()}

    if not usable:
        return []
    one, two = measured(base, [p.base for p in usable]), measured(other, [p.compare for p in usable])
    found = []
    for pair in usable:
        low = high = _pair_score(pair)
        for total, filled, distinct in (one[pair.base], two[pair.compare]):
            if not total:
                continue
            empty = (total - filled) / total * NULL_WEIGHT
            least = max(min(1, filled), distinct * (1 - SKETCH_WIDTH * SKETCH_ERROR))
            most = min(filled, distinct * (1 + SKETCH_WIDTH * SKETCH_ERROR) + 1)
            low += min(least, filled) / total * UNIQUE_WEIGHT - empty
            high += most / total * UNIQUE_WEIGHT - empty
        found.append(ScoreBounds(pair, low, high))
    return found


def infer_key(base: DataFrame, other: DataFrame, pairs: list[Pair]) -> Pair:
    """The first pair with the best score; the first pair if none can be a key.

    Bounds come first; values are counted exactly only for pairs whose upper
    bound reaches the best lower one, and not at all if that is one pair.
    """
    bounds = key_bounds(base, other, pairs)
    best_low = max((b.low for b in bounds), default=0.0)
    left = [b for b in bounds if b.high >= best_low]
    if not left or max(b.high for b in left) <= -1:
        return pairs[0]
    if len(left) == 1 and left[0].low > -1:
        return left[0].pair
    best = key_stats(base, other, [b.pair for b in left]).orderBy(F.col("score").desc(), "pos").limit(1).collect()
    if best[0].score <= -1:
        return pairs[0]
    return next(p for p in pairs if p.base == best[0].base_column)


def infer_match(base: DataFrame, other: DataFrame, mapping: list | None = None) -> tuple[list[Pair], tuple[str, str]]:
    """The mapping and the key of two tables, found once, for ``mapping`` and ``key`` of both ``smart_diff`` and ``smart_diff_summary``."""
    pairs, by = _settled(base, other, mapping, None)
    return pairs, (by.base, by.compare)


def _settled(base: DataFrame, other: DataFrame, mapping, key) -> tuple[list[Pair], Pair]:
    pairs = infer_pairs(base, other) if mapping is None else check_mapping(base, other, mapping)
    return pairs, (Pair(*key) if key else infer_key(base, other, pairs))


def smart_diff(
    base: DataFrame,
    other: DataFrame,
    mapping: list[tuple[str, str]] | None = None,
    key: tuple[str, str] | None = None,
    nan_as_mismatch: bool = False,
) -> DataFrame:
    """Every row of both tables matched on the key, with its state.

    Null keys match each other and duplicate keys multiply, as in a full join
    on ``IS NOT DISTINCT FROM``; ``smart_diff_summary`` counts the same pairs
    without producing them. Rows are unordered; see ``compare.preview``.
    """
    pairs, by = _settled(base, other, mapping, key)
    key_type = base.schema[by.base].dataType
    other_type = other.schema[by.compare].dataType

    def side(df: DataFrame, which: str) -> DataFrame:
        mapped = [names.col(getattr(p, which)).alias(f"{which}.{p.display}") for p in pairs]
        return df.select(names.col(getattr(by, which)).alias(f"__key_{which}"), F.lit(True).alias(f"__in_{which}"), *mapped)

    left, right = side(base, "base"), side(other, "compare")
    left_key, right_key = F.col("__key_base"), F.col("__key_compare")
    if not ty.can_be_grouped(key_type):
        left_key, right_key = values.as_text(left_key, key_type), values.as_text(right_key, other_type)
    joined = outer_join(left, right, left_key, right_key, "full", null_safe=True)
    status, mismatched = compared_columns(
        base, other, pairs, F.col("__in_base").isNotNull(), F.col("__in_compare").isNotNull(), nan_as_mismatch
    )
    text = F.coalesce(values.as_text(F.col("__key_base"), key_type), values.as_text(F.col("__key_compare"), other_type))
    shown = [names.col(f"{which}.{p.display}") for which in ("base", "compare") for p in pairs]
    return joined.select(text.alias("key"), status.alias("status"), mismatched.alias("mismatched_columns"), *shown)


def smart_diff_summary(
    base: DataFrame,
    other: DataFrame,
    mapping: list[tuple[str, str]] | None = None,
    key: tuple[str, str] | None = None,
    nan_as_mismatch: bool = False,
) -> DataFrame:
    """Counts of inserted, deleted, changed and unchanged rows.

    No join: both tables are stacked and counted by (key, row). With b and c
    rows of a key, the diff has b * c pairs, of which equal rows give the
    unchanged ones; so duplicate keys cost nothing extra and a key or row
    that fills a third of a table is combined before it is shuffled.
    """
    pairs, by = _settled(base, other, mapping, key)

    def side(df: DataFrame, which: str) -> DataFrame:
        keys, broken = [], F.lit(False)
        for i, p in enumerate([by, *pairs]):
            name = getattr(p, which)
            dtype = df.schema[name].dataType
            keys.append(values.group_key(names.col(name), dtype).alias(f"k{i}"))
            if nan_as_mismatch and i and isinstance(dtype, (T.FloatType, T.DoubleType)):
                broken = broken | F.coalesce(F.isnan(names.col(name)), F.lit(False))
        return df.select(*keys, broken.alias("broken"), F.lit(which).alias("side"))

    # The union widens mapped columns of different types as a comparison would.
    both = side(base, "base").unionByName(side(other, "compare"))
    rows = both.groupBy(*[f"k{i}" for i in range(len(pairs) + 1)], "broken").agg(
        F.count_if(F.col("side") == "base").alias("b"), F.count_if(F.col("side") == "compare").alias("c")
    )
    by_key = rows.groupBy("k0").agg(
        F.sum("b").alias("b"),
        F.sum("c").alias("c"),
        F.sum(F.when(F.col("broken"), 0).otherwise(F.col("b") * F.col("c"))).alias("same"),
    )
    b, c, same = F.col("b"), F.col("c"), F.col("same")

    def total(value: Column, name: str) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(name)

    counted = by_key.agg(
        total(F.when(b == 0, c), "inserted_rows"),
        total(F.when(c == 0, b), "deleted_rows"),
        total(b * c - same, "changed_rows"),
        total(same, "unchanged_rows"),
        total(b, "total_rows_base"),
        total(c, "total_rows_compare"),
        F.count_if((b > 1) | (c > 1)).alias("duplicate_keys"),
    )
    states = ("inserted_rows", "deleted_rows", "changed_rows", "unchanged_rows")
    compared = reduce(lambda x, y: x + y, [F.col(s) for s in states])
    return counted.select(*states, compared.alias("rows_compared"), "total_rows_base", "total_rows_compare", "duplicate_keys")


def diff_by_column(diff: DataFrame) -> DataFrame:
    """How many rows differ in each column."""
    changed = diff.filter(F.col("status") != UNCHANGED).select(F.explode("mismatched_columns").alias("column"))
    return changed.groupBy("column").agg(F.count(F.lit(1)).alias("changed_rows"))
