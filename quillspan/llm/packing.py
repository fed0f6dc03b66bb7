"""Filling containers of fixed capacity with items of varying size, by bin completion.

Items of one size are interchangeable, so the search runs on the table of sizes and how often each occurs: its rows
are bounded by the capacity, however many items there are. A filling found for the largest size left is repeated as
often as its sizes last. Items then take their places by their rank among those of their size.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.common import cut, partitions

NODES = 400  # search nodes a filling; the best filling met so far is taken beyond
WIDTH = 8  # sizes tried a node while a filling is searched; the branching below tries all
STEPS = 1_000_000  # sizes looked at while branching over fillings; the best packing met so far is taken beyond
_RANKED = 500_000  # items of one size that are ranked together
_BLOCK = 1 << 20  # ranks of one size that are placed together
_SLOTS = "pack string, cost bigint, first_rank bigint, places bigint, container bigint, uses int, position int, containers bigint, least bigint"


def _best_filling(costs: list[int], counts: dict[int, int], room: int, nodes: int) -> list[int]:
    """Costs that fill ``room`` best, larger ones first; costs is ascending and has what counts still holds.

    Depth first from the best-fit filling. A filling is dominated by one that has a single item for several of its
    own at no more waste, so of equal fillings the one met first, with larger items, stays. A branch is left when not
    even a full container would be better than the incumbent.
    """
    best: list[int] = []
    least, left = room + 1, nodes
    used: dict[int, int] = {}
    chosen: list[int] = []

    def search(room: int, top: int) -> bool:
        nonlocal best, least, left
        if room < least:
            best, least = chosen.copy(), room
        left -= 1
        if least == 0 or left <= 0:
            return True
        if room <= top and counts.get(room, 0) > used.get(room, 0):  # closes the container
            best, least = [*chosen, room], 0
            return True
        at = bisect_right(costs, min(room, top)) - 1
        tried = 0
        while at >= 0 and tried < WIDTH:
            c = costs[at]
            at -= 1
            if counts[c] <= used.get(c, 0):
                continue
            tried += 1
            used[c] = used.get(c, 0) + 1
            chosen.append(c)
            stop = search(room - c, c)
            chosen.pop()
            used[c] -= 1
            if stop:
                return True
        return False

    search(room, room)  # no deeper than the nodes allowed
    return best


def _best_fit(costs: list[int], counts: dict[int, int], room: int) -> list[int]:
    out: list[int] = []
    at = bisect_right(costs, room) - 1
    while at >= 0:
        c = costs[at]
        n = min(counts[c], room // c)
        out += [c] * n
        room -= n * c
        at = bisect_right(costs, room, 0, at) - 1
    return out


def _undominated(counts: dict[int, int], capacity: int, spent: list[int]) -> Iterator[dict[int, int]]:
    """Every undominated filling with the largest size (cost: uses), those with more of the larger sizes first.

    A filling is dominated if items of it (or none) can be replaced by one left out that is as large as all of them or
    larger and still fits: whatever is packed with it can be packed as well with the other one.
    """
    sizes = sorted(counts, reverse=True)
    falling = [-c for c in sizes]
    chosen: list[list[int]] = []

    def extend(at: int, room: int) -> int:
        while (at := max(at, bisect_left(falling, -room))) < len(sizes):
            n = min(counts[sizes[at]], room // sizes[at])
            chosen.append([at, n])
            room -= n * sizes[at]
            at += 1
        spent[0] += len(chosen)
        return room

    def dominated(room: int) -> bool:
        uses = {sizes[i]: n for i, n in chosen}
        one, more = 0, 0  # bits: sums of one item, of several
        for c, n in uses.items():
            for _ in range(n):
                more |= (one | more) << c
                one |= 1 << c
            spent[0] += n * (1 + (capacity >> 12))
        sums, window = 1 | one | more, (1 << room) - 1
        for c in sizes:
            spent[0] += 1
            if counts[c] > uses.get(c, 0) and (c <= room or (sums >> (c - room)) & window or (more >> c) & 1):
                return True
        return False

    room = extend(0, capacity)
    while True:
        if not dominated(room):
            yield {sizes[i]: n for i, n in chosen}
        at, n = chosen[-1]
        if at == 0 and n == 1:
            return
        room += sizes[at]
        if n == 1:
            chosen.pop()
        else:
            chosen[-1][1] -= 1
        room = extend(at + 1, room)
        if spent[0] > spent[1]:
            return


def _bound(counts: dict[int, int], capacity: int) -> int:
    """Waste bound: no packing has fewer containers than without any space lost, or than there are halves exceeded."""
    return max(-(-sum(c * n for c, n in counts.items()) // capacity), sum(n for c, n in counts.items() if 2 * c > capacity))


def _branched(sizes: dict[int, int], capacity: int, most: int, steps: int) -> list[tuple[int, list[int]]] | None:
    """The best packing with fewer than ``most`` containers, if there is one and the steps suffice to meet it.

    Depth first over the undominated fillings around the largest size left and over how often each is used. A branch
    is left if its containers and the bound of what it leaves reach the incumbent, or if the same was left with as few
    containers before. It is exact if it ends within the steps.
    """
    counts = {c: n for c, n in sizes.items() if n > 0}
    least, spent, used = _bound(counts, capacity), [0, steps], 0
    best: list[tuple[int, list[int]]] | None = None
    path: list[tuple[int, dict[int, int]]] = []
    seen: dict[frozenset, int] = {}

    def moves(left: dict[int, int]) -> Iterator[tuple[int, dict[int, int]]]:
        for uses in _undominated(left, capacity, spent):
            for times in range(min(left[c] // u for c, u in uses.items()), 0, -1):
                yield times, uses

    frames = [moves(counts)]
    lefts = [counts]
    while frames and most > least and spent[0] <= steps:
        move = next(frames[-1], None)
        if move is None:
            frames.pop()
            lefts.pop()
            if path:
                used -= path.pop()[0]
            continue
        times, uses = move
        left = {c: n - times * uses.get(c, 0) for c, n in lefts[-1].items() if n > times * uses.get(c, 0)}
        spent[0] += len(lefts[-1])
        if not left:
            if used + times < most:
                most = used + times
                best = [(t, [c for c, u in f.items() for _ in range(u)]) for t, f in [*path, move]]
        elif used + times + _bound(left, capacity) < most and seen.get(key := frozenset(left.items()), most) > used + times:
            seen[key] = used + times
            used += times
            path.append(move)
            frames.append(moves(left))
            lefts.append(left)
    return best


def fillings(sizes: dict[int, int], capacity: int, *, nodes: int = NODES, steps: int = STEPS) -> tuple[list[tuple[int, list[int]]], int]:
    """(how often, costs) of all containers for items of ``sizes`` (cost: count), and the least possible number.

    Best fit gives the first incumbent; if that is above the bound, one filling after the other is searched and kept,
    and if the better one is still above, bin completion branches over all fillings.
    """
    least = _bound(sizes, capacity)
    best: list[tuple[int, list[int]]] | None = None
    for search in (False, True):
        counts = {c: n for c, n in sizes.items() if n > 0}
        costs, made = sorted(counts), []
        while costs:
            top = costs[-1]
            counts[top] -= 1
            if not counts[top]:
                costs.pop()
            rest = _best_filling(costs, counts, capacity - top, nodes) if search else _best_fit(costs, counts, capacity - top)
            if search and sum(rest) < capacity - top:
                plain = _best_fit(costs, counts, capacity - top)
                rest = plain if sum(plain) > sum(rest) else rest
            counts[top] += 1
            if counts[top] == 1:
                costs.append(top)
            filling = [top, *rest]
            uses = {c: filling.count(c) for c in dict.fromkeys(filling)}
            times = min(counts[c] // u for c, u in uses.items())
            made.append((times, filling))
            for c, u in uses.items():
                counts[c] -= times * u
                if not counts[c]:
                    del costs[bisect_right(costs, c) - 1]
                    del counts[c]
        if best is None or sum(t for t, _ in made) < sum(t for t, _ in best):
            best = made
        if sum(t for t, _ in best) <= least:
            return best, least
    return _branched(sizes, capacity, sum(t for t, _ in best), steps) or best, least


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    """The places of one pack: which ranks of each cost go to which containers."""
    pack, capacity = rows["pack"].iloc[0], int(rows["room"].iloc[0])
    made, least = fillings(dict(zip(rows["cost"].tolist(), rows["n"].tolist())), capacity)
    total = sum(t for t, _ in made)
    given: dict[int, int] = {}
    out, container = [], 0
    for times, filling in made:
        for c in dict.fromkeys(filling):
            uses = filling.count(c)
            out.append((pack, c, given.get(c, 0), times * uses, container, uses, filling.index(c), total, least))
            given[c] = given.get(c, 0) + times * uses
        container += times
    return pd.DataFrame(out, columns=[f.split()[0] for f in _SLOTS.split(", ")])


def _placed(key, items: pa.Table, slots: pa.Table) -> pa.Table:
    """The last slot of the same pack and cost that begins at or before the item's rank."""
    n = slots.num_rows
    packs = pa.chunked_array([*slots.column("pack").chunks, *items.column("pack").chunks], pa.string()).combine_chunks().dictionary_encode()
    packs = packs.unify_dictionaries().combine_chunks() if isinstance(packs, pa.ChunkedArray) else packs
    both = lambda a, b: np.concatenate((slots.column(a).to_numpy(), items.column(b).to_numpy()))
    is_item = np.arange(n + items.num_rows) >= n
    order = np.lexsort((is_item, both("first_rank", "rank"), both("cost", "cost"), packs.indices.to_numpy()))
    last = np.maximum.accumulate(np.where(is_item[order], -1, np.arange(len(order))))
    at = np.empty(items.num_rows, dtype=np.int64)
    mine = is_item[order]
    at[order[mine] - n] = order[last[mine]]
    of = lambda c: slots.column(c).to_numpy()[at]
    k = items.column("rank").to_numpy() - of("first_rank")
    return pa.table({
        "pack_name": items.column("pack"), "container": of("container") + k // of("uses"), "position": (of("position") + k % of("uses")).astype(np.int32),
        "doc_id": items.column("doc_id"), "piece": items.column("piece"), "token_start": items.column("token_start"), "n_tokens": items.column("size"),
    })


def _items(sizes: DataFrame, packs: list[tuple[str, int, int]]) -> DataFrame:
    """One row per pack and piece; documents above the capacity make full pieces and a rest.

    The cost of an item is its size and a separator, so a container has room for the capacity and a separator.
    """
    each = F.array(*[F.struct(F.lit(p).alias("pack"), F.lit(c).cast("bigint").alias("capacity"), F.lit(s).cast("bigint").alias("sep")) for p, c, s in packs])
    rows = sizes.select("doc_id", "n_tokens", F.explode(each).alias("p")).select("doc_id", "n_tokens", "p.*")
    last = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")) - 1, F.lit(0))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    size = F.least(F.col("n_tokens") - F.col("piece") * F.col("capacity"), F.col("capacity"))
    return rows.select("pack", "doc_id", "piece", (F.col("piece") * F.col("capacity")).cast("bigint").alias("token_start"), size.cast("bigint").alias("size"), (F.greatest(size, F.lit(1)) + F.col("sep")).cast("bigint").alias("cost"), (F.col("capacity") + F.col("sep")).alias("room"))


def pack(sizes: DataFrame, packs: list[tuple[str, int, int]]) -> tuple[DataFrame, DataFrame]:
    """Places of all items of ``sizes`` (doc_id, n_tokens) in each pack (name, capacity, separator), and the slots.

    Places are (pack_name, container, position, doc_id, piece, token_start, n_tokens): containers are numbered from 0
    in each pack, positions from 0 in each container. An item is divided only if it is above the capacity: into
    pieces as long as the capacity and the rest. An empty item takes a place of its own and counts as one token in
    the search. Equal rows are items of their own; packs of null or non-positive capacity get nothing.
    """
    spark = sizes.sparkSession
    packs = [(p, c, s or 0) for p, c, s in packs if p is not None and c is not None and c > 0]
    if not packs:
        none = spark.createDataFrame([], _SLOTS)
        return sizes.select(F.lit("").alias("pack_name"), F.lit(0).cast("bigint").alias("container"), F.lit(0).alias("position"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("token_start"), "n_tokens").where("false"), none
    # As many salts as items of one size may need, for all may have one size.
    salts = partitions(spark, sizes.count(), _RANKED)
    items = _items(sizes, packs).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    salted = cut(items.groupBy("pack", "room", "cost", "salt").agg(F.count("*").alias("n")))  # at most capacity x salts rows a pack
    slots = cut(salted.groupBy("pack", "room", "cost").agg(F.sum("n").alias("n")).groupBy("pack").applyInPandas(_solve, _SLOTS))
    before = Window.partitionBy("pack", "cost").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.select("pack", "cost", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("pack", "cost", "salt").orderBy("doc_id", "piece")) - 1
    ranked = items.withColumn("rank", rank.cast("bigint")).join(offsets, ["pack", "cost", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("offset"))
    n = partitions(spark, salted.agg(F.sum("n")).first()[0] or 0, _RANKED)
    bucket = lambda block: F.pmod(F.xxhash64("pack", "cost", block), F.lit(n)).alias("bucket")
    left = ranked.select(bucket(F.floor(F.col("rank") / _BLOCK)), "pack", "cost", "rank", "doc_id", "piece", "token_start", "size")
    reached = F.sequence(F.floor(F.col("first_rank") / _BLOCK), F.floor((F.col("first_rank") + F.col("places") - 1) / _BLOCK))
    right = slots.withColumn("block", F.explode(reached)).select(bucket(F.col("block")), "pack", "cost", "first_rank", "container", "uses", "position").distinct()
    schema = "pack_name string, container bigint, position int, doc_id bigint, piece int, token_start bigint, n_tokens bigint"
    placed = left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(_placed, schema)
    return placed, slots


def pack_report(sizes: DataFrame, packs: list[tuple[str, int, int]]) -> DataFrame:
    """(pack_name, capacity_tokens, n_containers, least_containers, n_items, n_tokens, n_divided, fill) of each pack."""
    spark = sizes.sparkSession
    _, slots = pack(sizes, packs)
    items = _items(sizes, packs).groupBy("pack").agg(
        F.count("*").alias("n_items"), F.sum("size").alias("n_tokens"), F.sum((F.col("piece") == 1).cast("long")).alias("n_divided")
    )
    made = slots.groupBy("pack").agg(F.max("containers").alias("n_containers"), F.max("least").alias("least_containers"))
    dims = spark.createDataFrame([(p, c) for p, c, _ in packs], "pack string, capacity_tokens bigint")
    return dims.join(made, "pack").join(items, "pack").select(
        F.col("pack").alias("pack_name"), "capacity_tokens", "n_containers", "least_containers", "n_items", "n_tokens", "n_divided",
        (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill"),
    )


def violations(placed: DataFrame, sizes: DataFrame, packs: list[tuple[str, int, int]]) -> DataFrame:
    """(pack_name, item, problem) of places that break a rule; ``item`` is the container or the document.

    A container holds no more than its capacity with separators between its items, its positions follow each other;
    every document is there with all its tokens in each pack, and divided only if it is above the capacity. ``sizes``
    has one row a document here.
    """
    spark = placed.sparkSession
    dims = F.broadcast(spark.createDataFrame([(p, c, s or 0) for p, c, s in packs if c and c > 0], "pack_name string, capacity bigint, separator bigint"))  # a row per pack
    row = lambda item, problem: ["pack_name", F.col(item).alias("item"), F.lit(problem).alias("problem")]
    held = placed.groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"), F.max("position").alias("last"), F.countDistinct("position").alias("places")).join(dims, "pack_name")
    over = held.where(F.col("n") + F.col("separator") * (F.col("k") - 1) > F.col("capacity")).select(*row("container", "above capacity"))
    gaps = held.where((F.col("k") != F.col("last") + 1) | (F.col("k") != F.col("places"))).select(*row("container", "positions"))
    got = placed.groupBy("pack_name", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"))
    both = sizes.join(dims).join(got, ["pack_name", "doc_id"], "left")
    lost = both.where(F.col("n").isNull() | (F.col("n") != F.col("n_tokens"))).select(*row("doc_id", "tokens"))
    cut_up = both.where((F.col("k") > 1) & (F.col("n_tokens") <= F.col("capacity"))).select(*row("doc_id", "divided"))
    return over.unionByName(gaps).unionByName(lost).unionByName(cut_up)
