"""Local phase of several delayed sources, and renewal forecasts by simulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _moments(kernel: np.ndarray, q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log sum of k_a exp(-a q + a (a - 1) c / 2) over ages a, and the means of a and of a (a - 1) / 2 under its terms."""
    age = np.arange(len(kernel), dtype=float)
    pairs = age * (age - 1) / 2
    with np.errstate(divide="ignore"):
        terms = np.log(kernel)[None, :] - np.outer(q, age) + np.outer(c, pairs)
    top = terms.max(1, keepdims=True)
    weight = np.exp(terms - top)
    total = weight.sum(1)
    return np.log(total) + top[:, 0], weight @ age / total, weight @ pairs / total


def phase_fit(df: DataFrame, keys: list[str], z: str, variance: str, kernels: list[list[float]], ridge: tuple[float, float] = (1e-4, 1e-3), bounds: tuple[float, float] = (1.0, 0.5), least: float = 1e-5) -> DataFrame:
    """Growth q and acceleration c of each row from what several sources show, whose kernels delay it: of
    z = x + f(q, c) the level x is profiled out, and the weighted squares of the rest with a ridge are least within
    bounds. z and variance are arrays, a place for each kernel, null where a source is missing.

    Adds q, c, level, information (of q alone, and the lesser eigenvalue of both) and warnings. Rows are fitted
    side by side in batches, by damped Gauss-Newton steps.
    """
    shapes = [np.asarray(k, float) for k in kernels]
    limit, pen = np.array(bounds), np.array(ridge)
    out = T.StructType([*df.select(*keys).schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("q", "c", "level", "information_q", "information")), T.StructField("warnings", T.ArrayType(T.StringType()))])

    def look(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [_moments(k, p[:, 0], p[:, 1]) for k in shapes]
        return np.stack([f for f, _, _ in found], 1), np.stack([np.stack([-a, b], 1) for _, a, b in found], 1)

    def fit(frames):
        for frame in frames:
            n = len(frame)
            seen = np.array([[np.nan if x is None else x for x in r] for r in frame[z]], float).reshape(n, len(shapes))
            var = np.array([[1.0 if x is None or x != x else max(x, 1e-12) for x in r] for r in frame[variance]], float).reshape(n, len(shapes))
            w = np.where(np.isnan(seen), 0.0, 1 / var)
            seen, mass = np.nan_to_num(seen), np.maximum(w.sum(1), 1e-300)
            project = w[:, :, None] * np.eye(len(shapes)) - w[:, :, None] * w[:, None, :] / mass[:, None, None]

            def loss(p):
                f, _ = look(p)
                r = seen - f  # noqa: B023
                return np.einsum("ni,nij,nj->n", r, project, r) + (pen * p * p).sum(1)  # noqa: B023

            p, damp = np.zeros((n, 2)), np.full(n, 1e-3)
            best = loss(p)
            for _ in range(200):
                f, jac = look(p)
                pull = np.einsum("nsk,nst->nkt", jac, project)
                curve = pull @ jac + np.diag(pen)
                slope = np.einsum("nkt,nt->nk", pull, seen - f) - pen * p
                step = np.linalg.solve(curve + damp[:, None, None] * np.eye(2), slope[:, :, None])[:, :, 0]
                # what lies on a bound and is pushed outward stays there, the other moves alone
                stuck = (np.abs(p) >= limit) & (np.sign(slope) == np.sign(p))
                alone = slope / (np.diagonal(curve, axis1=1, axis2=2) + damp[:, None])
                step = np.where(stuck, 0.0, np.where(stuck.any(1, keepdims=True), alone, step))
                tried = np.clip(p + step, -limit, limit)
                now = loss(tried)
                good = now <= best
                moved = np.abs(tried - p).max(1) * good
                p, best, damp = np.where(good[:, None], tried, p), np.where(good, now, best), np.clip(np.where(good, damp / 5, damp * 5), 1e-9, 1e9)
                if (good & (moved < 1e-10) | (damp >= 1e8)).all():
                    break
            f, jac = look(p)
            info = np.einsum("nsk,nst,ntl->nkl", jac, project, jac)
            own, both = info[:, 0, 0], np.linalg.eigvalsh(info)[:, 0]
            few = (w > 0).sum(1) < 2
            notes = [[x for x, on in (("few_sources", a), ("growth_unknown", b < least), ("acceleration_unknown", e < least)) if on] for a, b, e in zip(few, own, both, strict=True)]
            level = (w * (seen - f)).sum(1) / mass
            yield pd.DataFrame({**{k: frame[k] for k in keys}, "q": p[:, 0], "c": p[:, 1], "level": np.where(w.sum(1) > 0, level, np.nan), "information_q": own, "information": both, "warnings": notes})

    return df.select(*keys, z, variance).mapInPandas(fit, out)


def renewal_forecast(history: DataFrame, edges: DataFrame, region: str, step: str, value: str, interval: list[float], horizon: int, samples: int = 400, imported: float = 0.05, size: float = 20.0, noise: float = 0.05, range_r: tuple[float, float] = (0.2, 5.0), seed: int = 7, most: int = 2000) -> DataFrame:
    """Quantiles (10, 50, 90 per cent) and the chance of a rise, per region and step ahead, of simulated renewals.

    Each sample starts from the last values with noise on the log scale. Its reproduction number follows from
    growth and acceleration of the last steps under the generation interval; new cases are negative binomial
    around the weighted past, of which a share comes in over the edges (src, dst, weight). Regions are a dimension
    (at most `most`, checked) whose last steps every task holds; samples are dealt over tasks, each with a
    generator of its own number, so a rerun gives the same rows.
    """
    spark, depth = history.sparkSession, max(len(interval), 3)
    if history.select(region).distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} regions; forecast a coarser level")
    last = history.select(step).distinct().orderBy(F.desc(step)).limit(depth)
    rows = history.join(F.broadcast(last), step).groupBy(region, step).agg(F.sum(value).alias("n")).toPandas().pivot(index=step, columns=region, values="n").sort_index().fillna(0.0)
    names = rows.columns.tolist()
    past, at = np.maximum(rows.to_numpy(float), 0), {n: i for i, n in enumerate(names)}
    flow = np.zeros((len(names), len(names)))
    for r in edges.select("src", "dst", "weight").collect():
        if r.src in at and r.dst in at:
            flow[at[r.dst], at[r.src]] += r.weight
    g = np.asarray(interval, float) / np.sum(interval)
    lag = np.arange(1, len(g) + 1)

    def simulate(frames):
        for frame in frames:
            out = []
            for number in frame["id"]:
                rng = np.random.default_rng([seed, int(number)])
                n = past.copy()
                n[-1] = (n[-1] + 1) * np.exp(rng.normal(0, noise, len(names))) - 1 if noise else n[-1]
                n = np.maximum(n, 0)
                for h in range(1, horizon + 1):
                    x = np.log(n[-3:] + 1)
                    q = x[-1] - x[-2]
                    c = q - (x[-2] - x[-3]) if len(x) > 2 else np.zeros(len(names))
                    with np.errstate(divide="ignore"):
                        terms = np.log(g)[:, None] - lag[:, None] * q + 0.5 * (lag * (lag - 1))[:, None] * c
                    top = terms.max(0)
                    r = np.clip(np.exp(-(top + np.log(np.exp(terms - top).sum(0)))), *range_r)
                    force = sum(w * ((1 - imported) * n[max(0, len(n) - k)] + imported * (flow @ n[max(0, len(n) - k)])) for k, w in zip(lag, g, strict=True))
                    mean = np.maximum(r * force, 1e-12)
                    new = rng.negative_binomial(size, size / (size + mean)).astype(float) if size else mean
                    n = np.vstack([n[1:], new]) if len(n) >= depth else np.vstack([n, new])
                    out.append(pd.DataFrame({"region": names, "ahead": h, "n": new, "up": new > past[-1]}))
            yield pd.concat(out) if out else pd.DataFrame({"region": [], "ahead": [], "n": [], "up": []})

    kind = history.schema[region].dataType.simpleString()
    drawn = spark.range(samples).mapInPandas(simulate, f"region {kind}, ahead int, n double, up boolean")
    q = F.percentile("n", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    m = drawn.groupBy("region", "ahead").agg(q.alias("q"), F.avg(F.col("up").cast("double")).alias("p_up"))
    return m.select(F.col("region").alias(region), "ahead", *(F.col("q")[i].alias(f"q{k}") for i, k in enumerate((10, 50, 90))), "p_up")
