"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. A flow network routes words from patterns to the
quotas of the sources: every pattern may send its words once at cost 1, again at cost 2 and a third time at cost 4,
so repetition is convex in price and spread out before it is piled up; a word that a quota can't get costs more than
any route. Within a pattern, documents are ordered by a seeded hash: whole repetitions go to all of them, the rest of
the flow to documents below a hash threshold, found from a histogram. Of the documents around the threshold, large
ones are taken while they fit, and of the 64 smallest the subset that comes nearest to what is left.

Beyond max_patterns patterns only those of sources that overlap go to the network. For any other source the cheapest
flow is its quota, so its plan is made by aggregation, and the targets too: nothing that grows with the sources is
collected. Only more than max_patterns patterns of overlapping sources are an error.

Defined cases: a null text has size 0; a document of size 0 is never taken; the null source is a source and sorts
last; an empty table gives no rows. Rows are told apart by doc_id and text. Rows equal in both are one entry with a
count, of which any number may be taken, so neither null nor repeated ids keep a source from its target. Only doc_id,
text, source and the column named by members are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewell.functions.ordering import row_numbers
from brinewell.llm.shared import Scratch, at_most, row_key, stash

WEIGHTS = (5, 2, 1)
#: Price of a word's first, second and third use.
REPEAT_COSTS = (1, 2, 4)
_SHORTFALL = 100
_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: int = len(REPEAT_COSTS)) -> list[float]:
    """Shares of the total by weight; a share above most times the source's size stops there and its excess is reshared."""
    out = [0.0] * len(sizes)
    free, left = list(range(len(sizes))), float(total)
    while free and left > 0:
        by = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / by > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / by
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def min_cost_flow(patterns: Sequence[tuple[frozenset[int], int]], quotas: Sequence[int], costs: Sequence[int] = REPEAT_COSTS) -> list[dict[int, int]]:
    """Words that each pattern (its sources, its size) sends to each source's quota: cheapest total, by successive shortest paths."""
    n, m = len(patterns), len(quotas)
    start, end = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # [to, capacity left, cost, index of the reverse edge]

    def edge(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, (members, size) in enumerate(patterns):
        for cost in costs:
            edge(start, p, size, cost)
        for s in sorted(members):
            edge(p, n + s, size * len(costs), 0)
    for s, quota in enumerate(quotas):
        edge(n + s, end, quota, 0)
    potential = [0] * len(graph)
    while True:
        far: list[float] = [float("inf")] * len(graph)
        far[start], by, heap = 0, {}, [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, (b, room, cost, _) in enumerate(graph[a]):
                if room > 0 and (x := d + cost + potential[a] - potential[b]) < far[b]:
                    far[b], by[b] = x, (a, k)
                    heapq.heappush(heap, (x, b))
        if far[end] == float("inf"):
            break
        for a, d in enumerate(far):
            potential[a] += int(d) if d < float("inf") else 0
        if potential[end] - potential[start] >= _SHORTFALL:
            break
        path, b = [], end
        while b != start:
            a, k = by[b]
            path.append((a, k))
            b = a
        push = min(graph[a][k][1] for a, k in path)
        for a, k in path:
            e = graph[a][k]
            e[1] -= push
            graph[e[0]][e[3]][1] += push
    return [{e[0] - n: graph[e[0]][e[3]][1] for e in graph[p] if n <= e[0] < n + m and graph[e[0]][e[3]][1]} for p in range(n)]


def nearest_subset(sizes: Sequence[int], goal: int, resolution: int = 1 << 20) -> list[bool]:
    """Which sizes to take so that their sum comes nearest to goal: reachable sums as the bits of a number, one for each prefix."""
    unit = max(1, goal // resolution)
    steps = [round(s / unit) for s in sizes]
    aim = round(goal / unit)
    mask, reach = (1 << (2 * aim + 1)) - 1, [1]
    for s in steps:
        reach.append((reach[-1] | reach[-1] << s) & mask)
    last = reach[-1]
    below = (last & ((1 << (aim + 1)) - 1)).bit_length() - 1
    above = (last >> (aim + 1)) & -(last >> (aim + 1))
    at = aim + above.bit_length() if above and above.bit_length() < aim - below else below
    taken = []
    for s, before in zip(reversed(steps), reversed(reach[:-1]), strict=True):
        taken.append(not before >> at & 1)
        at -= s * taken[-1]
    return taken[::-1]


def _parts(many: int) -> list[int]:
    """Powers of two, and a rest, that add up to any number from 0 to many."""
    out, step = [], 1
    while many > 0:
        out.append(min(step, many))
        many -= out[-1]
        step *= 2
    return out


def _fill(exact: int = 64):
    """Takes documents of a pattern's boundary cell while they fit, large ones first, and of the smallest ones the best subset."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "position", "doc_id", "key_hi", "key_lo"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        left, extra, sizes, counts = int(pdf["left"].iloc[0]), [], pdf["size"].tolist(), pdf["many"].tolist()
        for size, many in zip(sizes[:-exact], counts[:-exact], strict=True):
            extra.append(min(many, left // size))
            left -= size * extra[-1]
        parts = [(i, size, n) for i, (size, many) in enumerate(zip(sizes[-exact:], counts[-exact:], strict=True)) for n in _parts(many)]
        last = [0] * len(sizes[-exact:])
        for (i, _, n), taken in zip(parts, nearest_subset([size * n for _, size, n in parts], left), strict=True):
            last[i] += n * int(taken)
        return pdf.assign(extra=extra + last)[["_k", *_ROW, "many", "extra"]]

    return fill


_ROW = ("doc_id", "key_hi", "key_lo")
_PLAN = "_pattern string, _k long, _whole int, _rest long, _docs long"


def _keyed(docs: DataFrame, seed: int, members: str | None) -> DataFrame:
    """docs with _size, _members, _pattern, _position and the key of the row: what the plan speaks of."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    own = F.array(source) if members is None else F.coalesce(F.array_sort(F.array_distinct(F.col(members).cast("array<string>"))), F.array(source))
    hi, lo = row_key()
    position = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), hi), F.lit(1 << 52)) / F.lit(float(1 << 52))
    size = F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"_size": size, "_members": own, "_position": position, "_key_hi": hi, "_key_lo": lo, "_id": F.col("doc_id").cast("long")}).withColumn("_pattern", F.to_json(F.struct("_members")))


def _entries(keyed: DataFrame) -> DataFrame:
    """Rows equal in doc_id and text as one, with their count."""
    by = keyed.groupBy("_pattern", F.col("_id").alias("doc_id"), F.col("_key_hi").alias("key_hi"), F.col("_key_lo").alias("key_lo"))
    return by.agg(F.first("_members").alias("_members"), F.first("_size").alias("size"), F.first("_position").alias("position"), F.count("*").alias("many"))


def _wide_targets(sizes: DataFrame, weights: Sequence[float], total: float, most: int = len(REPEAT_COSTS)) -> DataFrame:
    """targets() for sources(name, words) in a table: name, source_size, target. A round of aggregation for each round of capping."""
    named = row_numbers(sizes.where("name is not null"), "name", "rank")
    ranked = named.unionByName(sizes.where("name is null").withColumn("rank", F.lit(named.count() + 1).cast("long")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = stash(ranked.select("name", F.col("words").cast("long").alias("words"), weight.alias("weight")), "mix-ranked")
    level, capped = 0.0, F.lit(most) * F.col("words") < F.lit(0.0) * F.col("weight")
    while True:
        sums = ranked.agg(F.sum(F.when(capped, F.lit(most) * F.col("words"))).alias("spent"), F.sum(F.when(~capped, F.col("weight"))).alias("by")).first()
        now = (total - (sums["spent"] or 0)) / sums["by"] if sums["by"] else float("inf")
        if now <= level:
            break
        level, capped = now, F.lit(now) * F.col("weight") > F.lit(most) * F.col("words")
        if now == float("inf"):
            break
    return ranked.select("name", F.col("words").alias("source_size"), F.when(capped, F.lit(float(most)) * F.col("words")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def _network(found: list, sources: Sequence[str | None], goal: Sequence[float]) -> list[tuple]:
    """Rows of the plan for patterns(_pattern, members, words, docs) by min-cost flow."""
    at = {s: i for i, s in enumerate(sources)}
    flows = min_cost_flow([(frozenset(at[s] for s in r.members), r.words) for r in found], [round(g) for g in goal])
    return [(r._pattern, k, *(divmod(sum(f.values()), r.words) if r.words else (0, 0)), r.docs) for k, (r, f) in enumerate(zip(found, flows, strict=True))]


def _planned(entries: DataFrame, weights: Sequence[float], max_patterns: int, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """From the stashed entries: the plan by pattern, and the sources(_name, source_size, target)."""
    spark = entries.sparkSession
    patterns = entries.groupBy("_pattern").agg(F.first("_members").alias("members"), F.sum(F.col("size") * F.col("many")).alias("words"), F.sum("many").alias("docs"))
    patterns = keep.stash(patterns, "mix-patterns")
    key = lambda s: (s is None, (s or "").encode())
    if at_most(patterns, max_patterns):
        found = sorted(patterns.collect(), key=lambda r: r._pattern)
        sizes: dict[str | None, int] = {}
        for r in found:
            for s in r.members:
                sizes[s] = sizes.get(s, 0) + r.words
        sources = sorted(sizes, key=key)
        goal = targets([sizes[s] for s in sources], [float(weights[i % len(weights)]) for i in range(len(sources))], sum(r.words for r in found))
        by_source = spark.createDataFrame([(s, int(sizes[s]), float(g)) for s, g in zip(sources, goal, strict=True)], "_name string, source_size long, target double")
        return spark.createDataFrame(_network(found, sources, goal), _PLAN), by_source

    each = patterns.select(F.explode("members").alias("name"), "words", (F.size("members") > 1).alias("overlaps"))
    sizes = keep.stash(each.groupBy("name").agg(F.sum("words").alias("words"), F.max("overlaps").alias("overlaps")), "mix-sources")
    by_source = keep.stash(_wide_targets(sizes.select("name", "words"), weights, patterns.agg(F.sum("words")).first()[0]), "mix-targets")
    shared = sizes.where("overlaps").select(F.col("name").alias("_name"))
    some = patterns.join(shared, F.exists("members", lambda m: m.eqNullSafe(F.col("_name"))), "left_semi") if shared.limit(1).count() else patterns.limit(0)
    found = sorted(some.limit(max_patterns + 1).collect(), key=lambda r: r._pattern)
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} patterns of overlapping sources")
    near = by_source.join(F.broadcast(shared), F.col("name").eqNullSafe(F.col("_name")), "left_semi").collect() if found else []  # no more than found has
    goal = {r.name: r.target for r in near}
    sources = sorted(goal, key=key)
    plan = spark.createDataFrame(_network(found, sources, [goal[s] for s in sources]), _PLAN) if found else spark.createDataFrame([], _PLAN)
    single = patterns.where(F.size("members") == 1).join(plan.select(F.col("_pattern").alias("_done")), F.col("_pattern") == F.col("_done"), "left_anti")
    single = single.join(by_source, F.element_at("members", 1).eqNullSafe(F.col("name")))
    flow = F.least(F.rint("target").cast("long"), F.col("words") * len(REPEAT_COSTS))
    whole = F.when(F.col("words") > 0, F.floor(flow / F.col("words"))).otherwise(0)
    rest = F.when(F.col("words") > 0, F.pmod(flow, F.col("words"))).otherwise(0)
    direct = single.select("_pattern", (F.monotonically_increasing_id() + max_patterns).alias("_k"), whole.cast("int").alias("_whole"), rest.cast("long").alias("_rest"), F.col("docs").alias("_docs"))
    return keep.stash(plan.unionByName(direct), "mix-plan"), by_source.withColumnRenamed("name", "_name")


def _plan(keyed: DataFrame, keep: Scratch, weights: Sequence[float], cell_docs: int, max_cells: int, max_patterns: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The plan by pattern with its boundary cell, what is taken of entries in boundary cells, and the sources."""
    entries = keep.stash(_entries(keyed), "mix-entries")
    plan, by_source = _planned(entries, weights, max_patterns, keep)
    plan = plan.withColumn("_cells", F.greatest(F.lit(1), F.least(F.lit(max_cells), F.floor(F.col("_docs") / cell_docs))).cast("int")).drop("_docs")
    placed = _placed(entries.drop("_members"), plan, "position")
    before = F.coalesce(F.sum("words").over(Window.partitionBy("_k").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = placed.where("_rest > 0").groupBy("_k", "_cell").agg(F.sum(F.col("size") * F.col("many")).alias("words"), F.first("_rest").alias("rest")).withColumn("before", before)
    edges = keep.stash(cells.where("before <= rest and rest < before + words").select(F.col("_k").alias("_ek"), F.col("_cell").alias("_edge"), (F.col("rest") - F.col("before")).alias("left")), "mix-edges")  # one cell a pattern
    near = placed.join(edges, (F.col("_k") == F.col("_ek")) & (F.col("_cell") == F.col("_edge"))).where("size > 0").select("_k", *_ROW, "size", "position", "many", "left")
    near = stash(near.groupBy("_k").applyInPandas(_fill(), "_k long, doc_id long, key_hi long, key_lo long, many long, extra long").where("extra > 0"), "mix-near")
    plan = stash(plan.join(edges.drop("left"), F.col("_k") == F.col("_ek"), "left").drop("_ek"), "mix-plan")
    return plan, near, stash(by_source, "mix-sources")


def _placed(rows: DataFrame, plan: DataFrame, position: str = "_position") -> DataFrame:
    """rows with the plan of their pattern and their cell."""
    cell = F.least(F.floor(F.col(position) * F.col("_cells")), F.col("_cells") - 1).cast("int")
    plan = plan.withColumnRenamed("_pattern", "_planned")
    return rows.join(F.broadcast(plan) if at_most(plan, 100_000) else plan, F.col("_pattern") == F.col("_planned")).drop("_planned").withColumn("_cell", cell)


def _with_repeats(placed: DataFrame, near: DataFrame) -> DataFrame:
    """placed with _repeats. What is taken of boundary cells is a list of entries: broadcast while it is short.

    Of an entry that is taken in part, rows are numbered: within the partitions of a written table, and these by their counts.
    """
    listed = near.select(F.col("_k").alias("_near_k"), F.col("doc_id").alias("_near_id"), F.col("key_hi").alias("_near_hi"), F.col("key_lo").alias("_near_lo"), F.col("many").alias("_many"), F.col("extra").alias("_extra"))
    listed = F.broadcast(listed) if at_most(listed, 500_000) else listed
    same = (F.col("_k") == F.col("_near_k")) & F.col("_id").eqNullSafe(F.col("_near_id")) & (F.col("_key_hi") == F.col("_near_hi")) & (F.col("_key_lo") == F.col("_near_lo")) & (F.col("_cell") == F.col("_edge"))
    rows = placed.join(listed, same, "left").drop("_near_k", "_near_id", "_near_hi", "_near_lo")
    sure = F.when(F.col("_cell") < F.col("_edge"), 1).otherwise(0)

    def repeats(more: Column) -> Column:
        return F.when(F.col("_size") > 0, F.col("_whole") + more).otherwise(0).cast("int")

    if not near.where("extra < many").limit(1).count():
        return rows.withColumn("_repeats", repeats(F.when(F.col("_cell") == F.col("_edge"), F.col("_extra").isNotNull().cast("int")).otherwise(sure)))
    whole = rows.where("_extra is null or _extra >= _many").withColumn("_repeats", repeats(F.when(F.col("_cell") == F.col("_edge"), F.col("_extra").isNotNull().cast("int")).otherwise(sure)))
    entry = ("_k", "_id", "_key_hi", "_key_lo")
    some = stash(rows.where("_extra < _many").withColumn("_n", F.monotonically_increasing_id()), "mix-some").withColumn("_part", F.shiftright("_n", 33))
    counts = some.groupBy(*entry, "_part").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*entry).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = stash(counts.select(*[F.col(c).alias(f"_b{c}") for c in (*entry, "_part")], before.alias("_before")), "mix-ahead")
    own = (F.col("_k") == F.col("_b_k")) & F.col("_id").eqNullSafe(F.col("_b_id")) & (F.col("_key_hi") == F.col("_b_key_hi")) & (F.col("_key_lo") == F.col("_b_key_lo")) & (F.col("_part") == F.col("_b_part"))
    some = some.withColumn("_rank", F.row_number().over(Window.partitionBy(*entry, "_part").orderBy("_n"))).join(ahead, own)
    some = some.withColumn("_repeats", repeats((F.col("_before") + F.col("_rank") <= F.col("_extra")).cast("int")))
    return whole.unionByName(some.select(*whole.columns))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = 7, cell_docs: int = 2000, max_cells: int = 1 << 16, max_patterns: int = 10_000, members: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats and taken (= repeats * size) for every document.

    docs: doc_id, text, source and, for overlapping sources, the column named by members, array<string>; without it a
    document belongs to its source alone. Weights repeat over the sources in code-point order, null last.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), *([members] if members else []))
    with Scratch(docs.sparkSession) as keep:
        keyed = stash(_keyed(docs, seed, members).drop("text"), "mix-sizes")
        plan, near, by_source = _plan(keyed, keep, weights, cell_docs, max_cells, max_patterns)
    out = _with_repeats(_placed(keyed, plan), near).join(F.broadcast(by_source) if at_most(by_source, 100_000) else by_source, F.col("source").eqNullSafe(F.col("_name")), "left")
    return out.select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", F.col("_repeats").alias("repeats"), (F.col("_size") * F.col("_repeats")).alias("taken"))


def take_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = 7, cell_docs: int = 2000, max_cells: int = 1 << 16, max_patterns: int = 10_000, members: str | None = None) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it. Texts are not shuffled, but for copies of which some are taken."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")  # whatever its columns are called
    keyed = _keyed(docs.select(row, "doc_id", "text", "source", *([members] if members else [])), seed, members)
    with Scratch(docs.sparkSession) as keep:
        own = keep.stash(keyed.drop("_row", "text"), "mix-sizes")
        plan, near, _ = _plan(own, keep, weights, cell_docs, max_cells, max_patterns)
    placed = _with_repeats(_placed(keyed.drop("text"), plan), near).where("_repeats > 0")
    return placed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_repeats")))).select("_row.*")


def mixture_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
