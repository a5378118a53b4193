"""Best-first walk with budgets. What it keeps depends on the order of discovery, so it is replayed in order, on steps fetched as they are needed."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import HUB, _steps, cut


def walk(steps, seeds: list[str], depth: int, budget: int, share: float, layer_of, fetch=None) -> list[tuple]:
    """(id, cost, hops) in order of discovery. A node is selected when first met and not again; later, cheaper ways lower its cost only.

    No layer beyond the first seeds may take more than ``share`` of the budget. Ties are first in, first out. ``fetch(at, queue, best)`` is
    called before the steps of a node are read."""
    best, order, counts, queue, turn = {}, [], {}, [], 0
    for s in seeds:
        best[s] = 0
        order.append((s, 0))
        heapq.heappush(queue, (0, turn, s, 0))
        turn += 1
    while queue:
        cost, _, at, hops = heapq.heappop(queue)
        if cost > best.get(at, cost) or hops == depth:
            continue
        if fetch:
            fetch(at, queue, best)
        for to, step in steps.get(at, ()):
            total = cost + step
            if to not in best:
                layer = layer_of(to)
                if len(order) >= budget or counts.get(layer, 0) >= max(1, int(budget * share)):
                    continue
                counts[layer] = counts.get(layer, 0) + 1
                order.append((to, hops + 1))
            elif total >= best[to]:
                continue
            best[to] = total
            turn += 1
            heapq.heappush(queue, (total, turn, to, hops + 1))
    return [(n, best[n], h) for n, h in order]


class Fetched:
    """Steps of the nodes that a walk pops, fetched for the next ``budget`` nodes of the queue at a time.

    Of a node's steps to a layer the first ``budget`` that lead to nodes not yet selected are enough, as no more can be selected; steps to
    selected nodes are all kept. A node whose steps were cut short is fetched again if nodes were selected since."""

    def __init__(self, adjacency: DataFrame, depth: int, budget: int):
        self.adjacency, self.depth, self.budget = adjacency, depth, max(1, budget)
        self.steps: dict[str, list] = {}
        self.known: dict[str, int] = {}

    def get(self, at, default=()):
        return self.steps.get(at, default)

    def __call__(self, at: str, queue: list, best: dict) -> None:
        if at in self.steps and self.known.get(at, len(best)) == len(best):
            return
        ahead = [n for _, _, n, hops in heapq.nsmallest(self.budget, queue) if hops < self.depth and n not in self.steps]
        nodes = list(dict.fromkeys([at, *ahead]))
        selected = self.adjacency.sparkSession.createDataFrame([(n,) for n in best], "to string").withColumn("selected", F.lit(True))
        near = self.adjacency.where(F.col("at").isin(nodes)).join(F.broadcast(selected), "to", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
        first = W.partitionBy("at", "selected", F.split("to", ":")[0]).orderBy("cost", "to")
        kept = near.withColumn("place", F.row_number().over(first)).where(F.col("selected") | (F.col("place") <= self.budget + 1))
        for n in nodes:
            self.steps[n] = []
            self.known.pop(n, None)
        for r in kept.collect():
            if r["place"] > self.budget and not r["selected"]:
                self.known[r["at"]] = len(best)
            else:
                self.steps[r["at"]].append((r["to"], int(r["cost"])))
        for n in nodes:
            self.steps[n].sort(key=lambda x: (x[1], x[0]))


def capped_walk(edges: DataFrame, seeds: DataFrame, depth: int, budget: int, share: float = 0.5, most: int = HUB) -> DataFrame:
    """(id, cost, hops, place) of at most ``budget`` nodes and the seeds. The walk runs in the driver and holds the seeds and the steps of the nodes it
    pops, whatever lies within ``depth`` of the seeds."""
    seeds = cut(seeds.select("id").distinct())
    fetched = Fetched(cut(_steps(edges, seeds, most)), depth, budget)
    found = walk(fetched, sorted(r[0] for r in seeds.collect()), depth, budget, share, lambda n: n.split(":")[0], fetched)
    return edges.sparkSession.createDataFrame([(n, c, h, i) for i, (n, c, h) in enumerate(found)], "id string, cost long, hops long, place long")
