"""Mixing sources to target weights by min-cost flow.

Documents are summed by membership pattern, the set of sources that they belong to. Words flow from patterns to the sources in them:
each pattern has its words once at no cost, a second time at cost 1, a third time at cost 2, and so on up to the allowed number of
copies, so that no pattern is repeated while another that could serve the same source is fresh. The flow of least cost into the
targets tells how many words to take from each pattern. Only these sums reach the driver: one row for each pattern, of which a mixture
that people write down has few; more than ``MAX_PATTERNS`` raise an error.

Within a pattern every document is taken as often as the flow fills the pattern whole; the rest comes from documents in the order
of a seeded hash. The hash is cut into equal ranges of about ``RANGE_ROWS`` rows, sums of the ranges find the one range in which the rest ends,
and only that range is sorted. Documents are taken whole: those of that range one after the other where they still fit, at last the
smallest of the others if that comes closer. No text is shuffled and no window spans a source.

Targets: sources by code point, null last, share all words by their weights; no source gets more than ``copies`` times its words, and what that
leaves is shared again by weight until none is above.

Results: null or blank texts have size 0 and take no words; equal rows are drawn one after the other; reruns agree.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.llm.common import WORD, bind, seeded_hash

MAX_PATTERNS = 100_000
RANGE_ROWS = 2_000
_HASHES = float(1 << 60)


def cycle_weights(sources: Sequence[str | None]) -> dict[str | None, float]:
    """Weights 1, 2, 3 and again, over sources by code point, null last."""
    ordered = sorted((s for s in sources if s is not None)) + [s for s in sources if s is None]
    return {s: 1.0 + i % 3 for i, s in enumerate(ordered)}


def targets(sizes: Mapping[str | None, int], total: int, weights: Mapping[str | None, float], copies: int) -> dict[str | None, float]:
    """Words for each source: shares by weight, cut at so many copies, the excess shared again."""
    fixed: dict[str | None, float] = {}
    open_ = [s for s in sizes if weights[s] > 0]
    while open_:
        left, weight = total - sum(fixed.values()), sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / weight > copies * sizes[s]]
        if not over:
            fixed |= {s: left * weights[s] / weight for s in open_}
            break
        fixed |= {s: float(copies * sizes[s]) for s in over}
        open_ = [s for s in open_ if s not in fixed]
    return {s: fixed.get(s, 0.0) for s in sizes}


def route(patterns: Mapping[tuple, int], wanted: Mapping, copies: int) -> dict[tuple[tuple, object], int]:
    """Words from each pattern to each of its sources: the cheapest flow that brings most words to the targets."""
    start, goal = ("start",), ("goal",)
    edges: list[list] = []  # [to, room, cost]; the edge back is at the next odd place
    at: dict[object, list[int]] = defaultdict(list)

    def connect(a, b, room: int, cost: int) -> None:
        at[a].append(len(edges))
        edges.append([b, room, cost])
        at[b].append(len(edges))
        edges.append([a, 0, -cost])

    links: dict[tuple[tuple, object], int] = {}
    for pattern, size in patterns.items():
        for copy in range(copies):
            connect(start, ("p", pattern), size, copy)
        for source in pattern:
            links[pattern, source] = len(edges)
            connect(("p", pattern), ("s", source), copies * size, 0)
    for source, words in wanted.items():
        connect(("s", source), goal, round(words), 0)

    price: dict[object, int] = defaultdict(int)  # keeps reduced costs from being negative
    while True:
        cost, came, heap, done = {start: 0}, {}, [(0, 0, start)], set()
        while heap:
            c, _, node = heapq.heappop(heap)
            if node in done:
                continue
            done.add(node)
            for e in at[node]:
                to, room, step = edges[e]
                if room > 0 and to not in done and (new := c + step + price[node] - price[to]) < cost.get(to, 1 << 60):
                    cost[to], came[to] = new, e
                    heapq.heappush(heap, (new, e, to))
        if goal not in cost:
            break
        for node, c in cost.items():
            price[node] += min(c, cost[goal])
        for node in at:
            if node not in cost:
                price[node] += cost[goal]
        # Fill every cheapest path that is left at this price, one after the other.
        path, node = [], goal
        while node != start:
            path.append(came[node])
            node = edges[came[node] ^ 1][0]
        room = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= room
            edges[e ^ 1][1] += room
    return {link: edges[e ^ 1][1] for link, e in links.items()}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(rows: DataFrame, members: Column, weights: Callable[[Sequence], Mapping] = cycle_weights, copies: int = 3, seed: str = "mix") -> DataFrame:
    """The rows (with ``doc_id`` and ``size``) and how often the mix takes each: ``mix_copies``, ``mix_pattern``.

    ``members``: an array of the sources a row belongs to, null for the null source; no source, no words.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("mix_pattern", F.sort_array(F.array_distinct(F.coalesce(members, F.array().cast("array<string>"))))).withColumn("mix_drawn", seeded_hash(seed, "doc_id"))
    sums = keyed.groupBy("mix_pattern").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"More than {MAX_PATTERNS} membership patterns: name coarser sources.")
    patterns = {tuple(r["mix_pattern"] or ()): r["words"] for r in sums}
    sizes: dict = defaultdict(int)
    for pattern, words in patterns.items():
        for source in pattern:
            sizes[source] += words
    wanted = targets(sizes, sum(patterns.values()), weights(list(sizes)), copies)
    flow = route(patterns, wanted, copies)
    taken: dict[tuple, int] = defaultdict(int)
    for (pattern, _), words in flow.items():
        taken[pattern] += words

    plan_rows = []
    for r in sums:
        pattern = tuple(r["mix_pattern"] or ())
        whole, rest = divmod(taken[pattern], r["words"]) if r["words"] else (0, 0)
        plan_rows.append((r["mix_pattern"], int(whole), int(rest), -(-r["n"] // RANGE_ROWS), [(s, int(sizes[s]), float(wanted[s])) for s in pattern]))
    kind = keyed.schema["mix_pattern"].dataType.simpleString()
    plan = spark.createDataFrame(plan_rows, f"pattern {kind}, whole int, rest long, ranges int, mix_sources array<struct<source:string,size:long,target:double>>")
    # One row for each pattern, whose number is checked above.
    drawn = keyed.join(F.broadcast(plan), F.col("mix_pattern") == F.col("pattern")).drop("pattern")
    drawn = drawn.withColumn("mix_range", F.least(F.floor(F.col("mix_drawn") / F.lit(_HASHES) * F.col("ranges")), F.col("ranges") - 1).cast("int"))
    before = Window.partitionBy("mix_pattern").orderBy("mix_range")
    last = (
        drawn.groupBy("mix_pattern", "mix_range", "rest")
        .agg(F.sum("size").alias("words"))
        .withColumn("before", F.sum("words").over(before) - F.col("words"))
        .filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        .select(F.col("mix_pattern").alias("pattern"), F.col("mix_range").alias("last"), (F.col("rest") - F.col("before")).alias("missing"))
    )
    # The range in which the rest ends: one row for each pattern at most.
    placed = drawn.join(F.broadcast(last), F.col("mix_pattern") == F.col("pattern"), "left").drop("pattern")
    inside = F.coalesce(F.col("mix_range") == F.col("last"), F.lit(False))
    outside = placed.filter(~inside).withColumn("more", F.coalesce(F.col("mix_range") < F.col("last"), F.lit(False)))

    order = Window.partitionBy("mix_pattern").orderBy("mix_drawn", "doc_id", "size")
    lined = placed.filter(inside).withColumn("line", F.row_number().over(order))
    # One list for each pattern, of the lines and sizes of one range: about RANGE_ROWS entries.
    lists = lined.groupBy(F.col("mix_pattern").alias("pattern"), F.col("missing").alias("open")).agg(F.sort_array(F.collect_list(F.struct("line", "size"))).alias("rows"))
    chosen = lists.select("pattern", _fill(F.col("rows"), F.col("open")).alias("lines"))
    edge = lined.join(chosen, F.col("mix_pattern") == F.col("pattern")).withColumn("more", F.array_contains("lines", F.col("line"))).drop("line", "lines", "pattern")
    both = outside.unionByName(edge).withColumn("mix_copies", F.col("whole") + F.col("more").cast("int"))
    return both.drop("mix_drawn", "whole", "rest", "ranges", "mix_range", "last", "missing", "more")


def _fill(rows: Column, room: Column) -> Column:
    """Lines of the rows that are taken, in order, wherever one still fits; at last the smallest of the others, if that comes closer."""
    nothing = F.struct(room.alias("room"), F.array().cast("array<int>").alias("lines"))

    def take(state: Column, row: Column) -> Column:
        taken = F.struct((state["room"] - row["size"]).alias("room"), F.concat(state["lines"], F.array(row["line"])).alias("lines"))
        return F.when(row["size"] <= state["room"], taken).otherwise(state)

    def close(state: Column) -> Column:
        others = F.filter(rows, lambda row: ~F.array_contains(state["lines"], row["line"]))
        least = F.array_min(F.transform(others, lambda row: F.struct(row["size"].alias("size"), row["line"].alias("line"))))
        closer = F.coalesce(least["size"] - state["room"] < state["room"], F.lit(False))
        return F.when(closer, F.concat(state["lines"], F.array(least["line"]))).otherwise(state["lines"])

    return bind(F.aggregate(rows, nothing, take), close)


def mix_documents(docs: DataFrame, copies: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of documents that belong to one source each."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix(rows, F.array("source"), copies=copies)
    return mixed.select("doc_id", "size", F.col("mix_sources")[0]["size"].alias("source_size"), F.col("mix_sources")[0]["target"].alias("target"), (F.col("mix_copies") * F.col("size")).alias("taken"))
