"""A joint fit of regional states from several delayed sources, without a matrix of all regions.

The log state of every region and day is the least-squares fit of what the sources show,
each with a delay and an offset of its own, under two penalties: curvature in time, and differences to neighbouring
regions. A region's days are one banded block. Blocks that aren't neighbours don't touch, so the regions of one colour of
the graph are solved side by side, given messages from their neighbours, colour after colour; offsets are sums over all
regions. Each step lowers the whole loss, and where it rests is the solution of the whole system.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut


def colours(edges: list[tuple], nodes: list) -> dict:
    """A colour for each node such that neighbours differ, of most neighbours first; for small graphs."""
    near: dict = {n: set() for n in nodes}
    for a, b in edges:
        if a != b:
            near[a].add(b), near[b].add(a)
    out: dict = {}
    for n in sorted(nodes, key=lambda n: (-len(near[n]), str(n))):
        used = {out[m] for m in near[n] if m in out}
        out[n] = next(c for c in range(len(nodes)) if c not in used)
    return out


def solve_banded(diagonal: np.ndarray, right: np.ndarray, curvature: float) -> np.ndarray:
    """x of (diag(diagonal) + curvature D'D) x = right for many rows at once, D being second differences."""
    n, days = diagonal.shape
    a, b, c = diagonal.astype(float).copy(), np.zeros((n, days)), np.zeros((n, days))  # main, first and second band
    for t in range(days - 2):
        a[:, t] += curvature
        a[:, t + 1] += 4 * curvature
        a[:, t + 2] += curvature
        b[:, t] -= 2 * curvature
        b[:, t + 1] -= 2 * curvature
        c[:, t] += curvature
    x = right.astype(float).copy()
    for t in range(days):  # forward, clearing the two rows below
        for band, step in ((b, 1), (c, 2)):
            if t + step < days:
                f = band[:, t] / a[:, t]
                a[:, t + step] -= f * band[:, t]
                if step == 1 and t + 2 < days:
                    b[:, t + 1] -= f * c[:, t]
                x[:, t + step] -= f * x[:, t]
    for t in range(days - 1, -1, -1):
        for band, step in ((b, 1), (c, 2)):
            if t + step < days:
                x[:, t] -= band[:, t] * x[:, t + step]
        x[:, t] /= a[:, t]
    return x


def _sums(obs: DataFrame, node: str, source: str, day: str, z: str, variance: str, first: int, days: int, delays: dict[str, int]) -> DataFrame:
    """Per node, arrays over the days of the window: weights and weighted values of each source, laid on the day it tells of."""
    late = F.create_map(*[x for s, d in delays.items() for x in (F.lit(s), F.lit(d))])
    w = 1 / F.greatest(F.col(variance), F.lit(1e-12))
    laid = obs.where(F.col(source).isin(*delays) & F.col(z).isNotNull() & F.col(variance).isNotNull()).select(F.col(node).alias("node"), F.col(source).alias("source"), (F.col(day) - late[F.col(source)] - first).cast("int").alias("at"), w.alias("w"), F.col(z).alias("z"))
    cells = laid.where((F.col("at") >= 0) & (F.col("at") < days)).groupBy("node", "source", "at").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("z")).alias("wz"))
    each = cells.groupBy("node", "source").agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("w", "wz")))).alias("m"))
    spread = lambda c: F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda t: F.coalesce(F.try_element_at("m", t)[c], F.lit(0.0)))
    return each.groupBy("node").agg(F.collect_list(F.struct("source", spread("w").alias("w"), spread("wz").alias("wz"))).alias("seen"))


def _solver(days: int, curvature: float, coupling: float, offsets: dict[str, float]):
    def run(frames):
        for frame in frames:
            n = len(frame)
            diagonal, right = np.full((n, days), 1e-9), np.zeros((n, days))
            for i, (seen, mass, near) in enumerate(zip(frame["seen"], frame["mass"], frame["near"], strict=True)):
                for s in seen if seen is not None else ():
                    w, wz = np.asarray(s["w"], float), np.asarray(s["wz"], float)
                    diagonal[i] += w
                    right[i] += wz - offsets[s["source"]] * w
                if near is not None:
                    diagonal[i] += coupling * mass
                    right[i] += coupling * np.asarray(near, float)
            yield pd.DataFrame({"node": frame["node"], "x": list(solve_banded(diagonal, right, curvature))})

    return run


def joint_fit(obs: DataFrame, edges: DataFrame, node: str, day: str, source: str, z: str, variance: str, delays: dict[str, int], first: int, days: int, curvature: float = 10.0, coupling: float = 1.0, offset_ridge: float = 1e-6, sweeps: int = 60, tolerance: float = 1e-6, most: int = 20_000) -> tuple[DataFrame, dict[str, float]]:
    """The fitted state (node, day, x, and its growth q and acceleration c) and each source's offset.

    obs: (node, day as a whole number, source, z on the log scale, variance); a source tells of `delays` days before. edges:
    src, dst, weight, taken both ways. days: the window from `first` on. The first source by name has no offset. Nodes
    without observations are carried by their neighbours. The graph is a dimension: more than `most` nodes are
    refused, as its colours are found on the driver; states and observations never reach it.
    """
    spark = obs.sparkSession
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    found = [r[0] for r in obs.select(node).union(both.select("src")).distinct().where(f"`{node}` IS NOT NULL").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} nodes; fit a coarser level")
    kind = dict(obs.dtypes)[node]
    of = colours([(r.src, r.dst) for r in both.select("src", "dst").collect()], found)
    table = spark.createDataFrame(list(of.items()) or [], f"node {kind}, colour int")
    mass = both.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("mass"))
    seen = _sums(obs, node, source, day, z, variance, first, days, delays)
    rows = cut(table.join(seen, "node", "left").join(mass, "node", "left").withColumn("mass", F.coalesce("mass", F.lit(0.0))))
    state = cut(rows.select("node", "colour", F.array_repeat(F.lit(0.0), days).alias("x")))
    sources = sorted(delays)
    offsets = dict.fromkeys(sources, 0.0)
    each = rows.select("node", F.explode("seen").alias("s")).select("node", "s.*")
    weights = {r.source: r.w for r in each.groupBy("source").agg(F.sum(F.aggregate("w", F.lit(0.0), lambda a, b: a + b)).alias("w")).collect()}
    for _ in range(sweeps):
        before, held = state, []
        for colour in sorted(set(of.values())):
            told = both.join(state.select(F.col("node").alias("src"), "x"), "src").select("dst", "weight", F.posexplode("x").alias("t", "v")).groupBy(F.col("dst").alias("node"), "t").agg(F.sum(F.col("weight") * F.col("v")).alias("v"))
            near = told.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda p: p["v"]).alias("near"))
            own = rows.where(F.col("colour") == colour).join(near, "node", "left").select("node", "seen", "mass", "near")
            new = own.mapInPandas(_solver(days, curvature, coupling, offsets), f"node {kind}, x array<double>").withColumn("colour", F.lit(colour))
            state = state.where(F.col("colour") != colour).unionByName(new.select("node", "colour", "x")).persist()
            held.append(state)
        state = cut(state)
        for h in held:
            h.unpersist()
        dot = F.aggregate(F.zip_with("w", "x", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        off = each.join(state.select("node", "x"), "node").groupBy("source").agg(F.sum(F.aggregate("wz", F.lit(0.0), lambda a, b: a + b) - dot).alias("g")).collect()
        moved = 0.0
        for r in off:
            if r.source != sources[0]:
                new_offset = r.g / (weights[r.source] + offset_ridge)
                moved, offsets[r.source] = max(moved, abs(new_offset - offsets[r.source])), new_offset
        apart = F.array_max(F.zip_with("x", "y", lambda a, b: F.abs(a - b)))
        moved = max(moved, state.join(before.select("node", F.col("x").alias("y")), "node").agg(F.max(apart).alias("m")).first().m or 0.0)
        if moved < tolerance:
            break
    x = F.col("x")
    step = lambda a: F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda t: F.when(t > 0, F.get(a, t) - F.get(a, t - 1)))
    q = state.withColumn("q", step(x))
    q = q.withColumn("c", step(F.col("q")))
    out = q.select(F.col("node").alias(node), F.posexplode(F.arrays_zip("x", "q", "c")).alias("t", "p")).select(node, (F.col("t") + first).alias(day), "p.x", "p.q", "p.c")
    return out, offsets
