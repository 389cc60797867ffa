"""Routes that trade distance against sun, for many requests at once.

Requests whose boxes reach the same tiles form a region. A region's edges are sent once to each of its salted
groups of requests, where exact shortest paths are searched request by request; costs depend on the request's
departure and step only, so nothing changes during a search.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parasol.functions.shade import UNKNOWN, WALKING, crossing_cost, sun
from parasol.sources.lineage import cut

START, END = -1, -2  # nodes of departure and arrival in paths
HALVING, LEAST_K = 2.0, 0.25  # fixed values: the ladder of weights under a detour cap
GROUP = 512  # requests searched by one task
EDGE = "struct<seq: int, de: bigint, vers: bigint, kind: string, l: double, i: int, src: string, step: int, val: smallint>"
ROUTES = f"route_id long, reachable boolean, k double, k_effectif double, plafonne boolean, base_m double, facteur double, edges array<{EDGE}>"


def ladder(k: float) -> list[float]:
    """Weights tried in turn: the one asked for, then halves down to a quarter."""
    rungs = [k] if k > 0 else []
    while rungs and rungs[-1] / HALVING >= LEAST_K:
        rungs.append(rungs[-1] / HALVING)
    return rungs


class Region:
    """Edges of a region, with the links of each node."""

    def __init__(self, edges: pd.DataFrame):
        self.rows = list(edges[["lo", "hi", "kind", "l", "i", "src", "fixed", "mx", "my", "vals"]].itertuples(index=False, name=None))
        self.links: dict[int, list[tuple[int, int]]] = {}
        for k, row in enumerate(self.rows):
            self.links.setdefault(row[0], []).append((row[1], k))
            self.links.setdefault(row[1], []).append((row[0], k))

    def search(self, request, k: float, cost_of) -> list[tuple[int, int, int | None, float]] | None:
        """Cheapest path from START to END as (from, to, edge or None, metres); ties by number of edges, then node."""
        extra: dict[int, list[tuple[int, float]]] = {}
        for near, end in ((START, "d"), (END, "a")):
            for node, metres in ((request[end + "_a"], request[end + "_proj"]), (request[end + "_b"], request[end + "_rest"])):
                extra.setdefault(near, []).append((node, metres))
                extra.setdefault(node, []).append((near, metres))
        if request["d_i"] == request["a_i"]:
            extra[START].append((END, abs(request["d_proj"] - request["a_proj"])))
        best, queue, settled = {START: (0.0, 0)}, [(0.0, 0, START)], set()
        came: dict[int, tuple[int, int | None, float]] = {}
        while queue:
            cost, hops, node = heapq.heappop(queue)
            if node in settled:
                continue
            settled.add(node)
            if node == END:
                break
            steps = [(v, e, self.rows[e][3], cost_of(e, k)) for v, e in self.links.get(node, ())]
            steps += [(v, None, m, m) for v, m in extra.get(node, ())]
            for v, e, metres, price in steps:
                reached = (cost + price, hops + 1)
                if v not in settled and reached < best.get(v, (math.inf, 0)):
                    best[v] = reached
                    came[v] = (node, e, metres)
                    heapq.heappush(queue, (*reached, v))
        if END not in came:
            return None
        path, node = [], END
        while node != START:
            before, e, metres = came[node]
            path.append((before, node, e, metres))
            node = before
        return path[::-1]


def _routes(requests: pd.DataFrame, edges: pd.DataFrame, step_minutes: int) -> pd.DataFrame:
    region = Region(edges)
    seconds = 60 * step_minutes
    out = []
    for r in requests.to_dict("records"):
        steps: dict[int, int] = {}

        def step_of(e: int, r=r, steps=steps) -> int:
            if e not in steps:
                row = region.rows[e]
                at = int(r["start_step"])
                if row[2] == "trottoir" and r["by_passage"]:
                    d = math.hypot(row[7] - r["d_px"], row[8] - r["d_py"])
                    at = min(at + math.floor(d / WALKING / seconds), int(r["n_steps"]) - 1)
                steps[e] = at
            return steps[e]

        def cost_of(e: int, k: float, r=r, step_of=step_of) -> float:
            row = region.rows[e]
            sunny = 0.0
            if k and row[2] == "trottoir":
                if row[9] is None or len(row[9]) == 0:
                    raise ValueError(f"no shade for segment {row[4]}")
                value = row[9][step_of(e)]
                sunny = 0.0 if value == UNKNOWN else 1 - value / 100
            return row[3] * (1 + k * sunny) + r["facteur"] * row[6]

        base = region.search(r, 0.0, cost_of)
        chosen, k_used, capped, base_m = base, 0.0, False, None
        if base is not None:
            base_m = sum(x[3] for x in base)
            for n, k in enumerate(ladder(r["k"])):
                path = region.search(r, k, cost_of)
                if sum(x[3] for x in path) <= r["plafond"] * base_m:
                    chosen, k_used, capped = path, k, n > 0
                    break
                capped = True
        path = []
        for n, (u, v, e, metres) in enumerate(chosen or ()):
            row = region.rows[e] if e is not None else (None,) * 10
            step = step_of(e) if e is not None else int(r["start_step"])
            value = int(row[9][step]) if e is not None and row[2] == "trottoir" and row[9] is not None and len(row[9]) else None
            path.append({"seq": n, "de": u, "vers": v, "kind": row[2] or "attache", "l": metres, "i": None if row[2] != "trottoir" else int(row[4]), "src": row[5], "step": step, "val": value})
        out.append((r["route_id"], base is not None, r["k"], k_used, capped, base_m, r["facteur"], path))
    return pd.DataFrame(out, columns=["route_id", "reachable", "k", "k_effectif", "plafonne", "base_m", "facteur", "edges"])


def priced(edges: DataFrame, nodes: DataFrame, shade: DataFrame) -> DataFrame:
    """Edges with fixed cost, middle of their nodes, and shade values by step (vals)."""
    at = lambda side: nodes.select(F.col("nid").alias(side), F.col("x").alias("x_" + side), F.col("y").alias("y_" + side))
    rows = edges.join(at("lo"), "lo", "left").join(at("hi"), "hi", "left")
    by = shade.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "val"))), lambda c: c.val).alias("vals"))
    rows = rows.join(by, "i", "left").withColumn("fixed", crossing_cost(F.col("kind"), F.col("src")))
    return rows.withColumn("mx", (F.col("x_lo") + F.col("x_hi")) / 2).withColumn("my", (F.col("y_lo") + F.col("y_hi")) / 2).drop("x_lo", "x_hi", "y_lo", "y_hi")


def routes(requests: DataFrame, edges: DataFrame, step_minutes: int = 15) -> DataFrame:
    """requests (attached, with region and start_step) by priced edges (with region; shade every step_minutes) -> ROUTES."""
    counts = requests.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups"))
    again = counts.select(F.col("region").alias("zone"), F.col("groups").alias("salts"))
    asked = requests.withColumnRenamed("region", "zone").join(again, "zone").withColumn("part", F.pmod(F.xxhash64("route_id"), F.col("salts")).cast("int"))
    sent = edges.join(counts, "region").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    return asked.groupBy("zone", "part").cogroup(sent.groupBy("region", "part")).applyInPandas(lambda a, b: _routes(a, b, step_minutes), ROUTES)


def summary(found: DataFrame) -> DataFrame:
    """Totals of each route; null figures where the end was not reached."""
    e = F.col("edges")
    add = lambda f: F.aggregate(F.transform(e, f), F.lit(0.0), lambda a, x: a + x)
    sunny = lambda x: F.coalesce(sun(x.val, x.kind), F.lit(0.0))
    walked = lambda x, v: F.when(x.kind == "trottoir", v).otherwise(0.0)
    rows = found.select(
        "route_id", "reachable", "k", "k_effectif", "plafonne", "base_m",
        add(lambda x: x.l).alias("distance_m"),
        add(lambda x: x.l * (1 + F.col("k_effectif") * sunny(x)) + F.col("facteur") * crossing_cost(x.kind, x.src)).alias("cout_pondere"),
        add(lambda x: walked(x, x.l * (1 - sunny(x)))).alias("distance_ombre_m"),
        add(lambda x: walked(x, x.l * sunny(x))).alias("distance_soleil_m"),
        add(lambda x: F.when(x.kind == "trottoir", 0.0).otherwise(x.l)).alias("distance_non_evaluee_m"),
        F.size(F.filter(e, lambda x: x.kind == "traversee")).alias("nb_traversees"),
    )
    measured = F.col("distance_ombre_m") + F.col("distance_soleil_m")
    return rows.withColumn("fraction_ombre_trajet", F.when(measured > 0, F.col("distance_ombre_m") / measured)).withColumn(
        "ratio_detour", F.when(F.col("base_m") > 0, F.col("distance_m") / F.col("base_m")).otherwise(1.0)
    )


def path_rows(found: DataFrame) -> DataFrame:
    return found.select("route_id", F.explode("edges").alias("e")).select("route_id", "e.*")


def costs_by_relaxation(links: DataFrame, sources: DataFrame, rounds: int = 10_000) -> DataFrame:
    """Least cost from each source to each node, by joins alone: links (u, v, cost), sources (source).

    Each round relaxes the links of nodes that have become cheaper; ends when none has; it is an error if `rounds` do not suffice. Rounds are written to
    the session's checkpoint folder, so a lost executor costs one.
    """
    best = sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.lit(True).alias("new"))
    for _ in range(rounds):
        step = best.where("new").join(links, F.col("node") == F.col("u")).select("source", F.col("v").alias("node"), (best.cost + links.cost).alias("cost"), F.lit(True).alias("new"))
        both = best.withColumn("new", F.lit(False)).unionByName(step)
        # A known cost wins ties, so an equal one is not new.
        best = cut(both.groupBy("source", "node").agg(F.min(F.struct("cost", "new")).alias("m")).select("source", "node", "m.cost", "m.new"))
        if best.where("new").isEmpty():
            return best.drop("new")
    raise RuntimeError(f"costs still fall after {rounds} rounds")
