"""Filling containers of fixed capacity: bin completion with best-fit solutions as incumbents."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.operators.storage import durable

#: Items solved together. A task's work and memory are bounded by this, whatever the input.
ITEMS_PER_GROUP = 4_000
#: Nodes of the search tree looked at before the incumbent is kept, and fillings tried per container.
NODES, FILLINGS = 2_000, 20


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; `sizes` must descend. Containers as lists of indexes."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room left, container), ascending
    for i, s in enumerate(sizes):
        k = bisect.bisect_left(room, (s, -1))
        if k == len(room):
            bins.append([i])
            bisect.insort(room, (capacity - s, len(bins) - 1))
        else:
            left, b = room.pop(k)
            bins[b].append(i)
            bisect.insort(room, (left - s, b))
    return bins


def _dominates(a: list[int], b: list[int]) -> bool:
    """The items `b` fit into places of the sizes `a` (both descending): a filling `a` is then no worse."""
    if sum(a) < sum(b):
        return False
    if not b:
        return True
    for k, x in enumerate(a):
        if x >= b[0] and (k == 0 or a[k - 1] != x):
            rest = sorted(a[:k] + a[k + 1 :] + [x - b[0]], reverse=True)
            if _dominates(rest, b[1:]):
                return True
    return False


def fillings(sizes: list[int], alive: list[int], capacity: int, most_waste: int) -> list[list[int]]:
    """Undominated ways to fill the container of the largest live item, least waste first.

    alive: indexes of the items left, largest first. A filling that would waste more than
    `most_waste` can't lead to a better solution and is not followed; one that leaves nothing
    unused dominates all others of no larger items and ends the enumeration.
    """
    first, rest = alive[0], alive[1:]
    room = capacity - sizes[first]
    tail = np.concatenate([np.cumsum([sizes[i] for i in rest][::-1])[::-1], [0]])
    found: list[tuple[int, list[int]]] = []
    steps = 0
    stack: list[tuple[int, int, list[int]]] = [(0, room, [])]
    while stack and steps < NODES:
        steps += 1
        at, left, chosen = stack.pop()
        if left == 0 or at == len(rest) or sizes[rest[-1]] > left:
            if left <= most_waste:
                found.append((left, chosen))
                if left == 0 and len(found) >= FILLINGS:
                    break
            continue
        if left - tail[at] > most_waste:
            continue
        k = at
        while k < len(rest) and sizes[rest[k]] > left:
            k += 1
        if k == len(rest):
            if left <= most_waste:
                found.append((left, chosen))
            continue
        skip = k + 1
        while skip < len(rest) and sizes[rest[skip]] == sizes[rest[k]]:
            skip += 1
        stack.append((skip, left, chosen))  # without any item of this size
        stack.append((k + 1, left - sizes[rest[k]], [*chosen, rest[k]]))
    found.sort(key=lambda x: (x[0], len(x[1])))
    kept: list[list[int]] = []
    for _, c in found[: 4 * FILLINGS]:
        own = [sizes[i] for i in c]
        if not any(_dominates([sizes[i] for i in other], own) for other in kept if len(other) <= 6 and len(own) <= 6):
            kept.append(c)
        if len(kept) == FILLINGS:
            break
    return [[first, *c] for c in kept]


def complete(sizes: list[int], capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Containers (lists of indexes) for `sizes` (descending, none above `capacity`).

    The best-fit solution is the first incumbent; if it needs no more containers than the total
    size demands, it is proven best. Otherwise containers are completed one after the other around
    the largest item left, depth first. A branch is cut once its waste so far rules out saving
    a container. After `nodes` branches the incumbent is kept.
    """
    best = best_fit(sizes, capacity)
    least = max(1, math.ceil(sum(sizes) / capacity))
    if len(best) <= least:
        return best
    positive = [i for i, s in enumerate(sizes) if s > 0]
    zero = [i for i, s in enumerate(sizes) if s == 0]
    allowed = (len(best) - 1) * capacity - sum(sizes)  # waste of a solution with one container less
    path: list[list[int]] = []
    options: list[list[list[int]]] = [fillings(sizes, positive, capacity, allowed)]
    waste = [0]
    seen = 0
    while options and seen < nodes:
        if not options[-1]:
            options.pop()
            if path:
                path.pop()
            waste.pop()
            continue
        seen += 1
        chosen = options[-1].pop(0)
        w = waste[-1] + capacity - sum(sizes[i] for i in chosen)
        if w > allowed:
            continue
        path.append(chosen)
        used = {i for c in path for i in c}
        alive = [i for i in positive if i not in used]
        if not alive:
            best = [list(c) for c in path]
            if zero:
                best[0].extend(zero)
            if len(best) <= least:
                break
            allowed = (len(best) - 1) * capacity - sum(sizes)
            path.pop()
            continue
        if len(path) + math.ceil(sum(sizes[i] for i in alive) / capacity) >= len(best):
            path.pop()
            continue
        options.append(fillings(sizes, alive, capacity, allowed - w))
        waste.append(w)
    return best


def as_items(df: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece_no, first_token, n_tokens): every record as one item, larger ones in pieces.

    A record above the capacity gives as many full pieces as it holds and one for the rest. Null
    sizes count as 0.
    """
    n = F.coalesce(df[size], F.lit(0)).cast("int")
    whole = df.select(df[key].alias(key), n.alias("__n"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("__n") - 1, F.lit(0)), F.lit(capacity))
    cut = whole.select(key, "__n", F.posexplode(starts).alias("p", "first_token"))
    return cut.select(key, (F.col("p") + 1).alias("piece_no"), "first_token", F.least(F.lit(capacity), F.col("__n") - F.col("first_token")).alias("n_tokens"))


def pack(df: DataFrame, key: str, size: str, capacity: int, *, items_per_group: int = ITEMS_PER_GROUP, waste: float = 0.02) -> DataFrame:
    """(container_id, key, piece_no, first_token, n_tokens): every item in exactly one container.

    No container holds more than `capacity`; no record is divided unless it alone exceeds it.
    Records of size 0 or null lie in some container as well. Keys must be unique and not null;
    an empty table gives no container.

    Items are hashed into groups of about `items_per_group`, each solved by `complete` in one task;
    only keys and sizes travel. Containers that stay emptier than `waste` allows (about one per
    group) are opened again and their items packed together in the next round, until one group is
    left or a round hardly helps; no group ever exceeds its bound. Full pieces of oversized records are containers of their own from the start.
    """
    kind = df.schema[key].dataType.simpleString()
    items = durable(as_items(df, key, size, capacity))
    full = items.filter(F.col("n_tokens") == capacity)
    open_ = items.filter(F.col("n_tokens") < capacity)

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["n_tokens", key, "piece_no"], ascending=[False, True, True], ignore_index=True)
        sizes = g["n_tokens"].tolist()
        where, left = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
        for b, held in enumerate(complete(sizes, capacity)):
            where[held] = b
            left[held] = capacity - sum(sizes[i] for i in held)
        return g.assign(b=where, room=left)

    done, number, n = None, 0, open_.count()
    while n:
        groups = max(1, math.ceil(n / items_per_group))
        keyed = open_.withColumn("g", F.pmod(F.xxhash64(F.lit(number), F.col(key), F.col("piece_no")), F.lit(groups)).cast("int"))
        solved = durable(keyed.groupBy("g").applyInPandas(solve, f"{key} {kind}, piece_no int, first_token int, n_tokens int, g int, b long, room long"))
        open_ = solved.filter(F.col("room") > waste * capacity).select(key, "piece_no", "first_token", "n_tokens")
        left = open_.count()
        # Where more than half of the items lie in such containers, their sizes allow no better: all containers of the round are kept.
        last = groups == 1 or left > n // 2
        final = solved if last else solved.filter(F.col("room") <= waste * capacity)
        ids = final.select(F.concat_ws("-", F.lit(number), "g", "b").alias("container_id"), key, "piece_no", "first_token", "n_tokens")
        done = ids if done is None else done.unionAll(ids)
        if last:
            break
        n, number = left, number + 1
    alone = full.select(F.concat_ws("-", F.lit("full"), F.col(key), "piece_no").alias("container_id"), key, "piece_no", "first_token", "n_tokens")
    return alone if done is None else done.unionAll(alone)
