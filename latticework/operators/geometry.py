"""Electrode geometry: distances, head normalisation, spline kernel and interpolation, arcs, views."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.scalar import legendre


def channel_distance(ch: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, i < j, dist over the channels (keys, channel, x, y, z) of each montage; channels of different montages don't meet."""
    keys = list(keys)
    a = ch.select(*keys, F.col("channel").alias("i"), *[F.col(c).alias(f"{c}1") for c in "xyz"])
    b = ch.select(*keys, F.col("channel").alias("j"), *[F.col(c).alias(f"{c}2") for c in "xyz"])
    both = a.join(b, keys) if keys else a.crossJoin(b)  # a montage is a few hundred rows
    return both.filter("i < j").select(*keys, "i", "j", F.sqrt(sum(((F.col(f"{c}1") - F.col(f"{c}2")) ** 2 for c in "yz"), (F.col("x1") - F.col("x2")) ** 2)).alias("dist"))


def on_unit_sphere(ch: DataFrame, centre: tuple[float, float, float] = (0.0, 0.0, 30.0)) -> DataFrame:
    moved = ch.select("channel", *[(F.col(c) - o).alias(c) for c, o in zip("xyz", centre, strict=True)])
    r = F.nullif(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2), F.lit(0.0))
    return moved.select("channel", *[(F.col(c) / r).alias(c) for c in "xyz"])


def rotated(ch: DataFrame, nose: str) -> DataFrame:
    angle = {"+x": 0.0, "+y": 1.5 * math.pi, "-x": math.pi}.get(nose.lower(), 0.5 * math.pi)
    c, s = math.cos(angle), math.sin(angle)
    return ch.select("channel", (c * F.col("x") - s * F.col("y")).alias("x"), (s * F.col("x") + c * F.col("y")).alias("y"), "z")


def placement(shift: Sequence[float] = (0, 0, 0), turn: Sequence[float] = (0, 0, 0), scale: Sequence[float] = (1, 1, 1)) -> np.ndarray:
    """The homogeneous matrix that scales points, turns them about the z, the y and then the x axis (angles given as x, y, z), and moves them."""
    cos, sin = np.cos(turn), np.sin(turn)
    out = np.diag([*map(float, scale), 1.0])
    for axis in (2, 1, 0):
        a, b = (axis + 1) % 3, (axis + 2) % 3
        m = np.eye(4)
        m[a, a] = m[b, b] = cos[axis]
        m[a, b], m[b, a] = -sin[axis], sin[axis]
        out = m @ out
    out[:3, 3] += np.asarray(shift, float)
    return out


def transformed(ch: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Points under a homogeneous matrix of three or four rows; other columns stay."""
    rows = np.asarray(matrix, float)[:3].tolist()
    return ch.withColumns({c: F.col("x") * r[0] + F.col("y") * r[1] + F.col("z") * r[2] + r[3] for c, r in zip("xyz", rows, strict=True)})


def spline_kernel(pairs: DataFrame, dist: str = "dist", terms: int = 7) -> DataFrame:
    """Adds g: the summed Legendre terms at e = 1 - dist over 4 pi."""
    p = legendre(1 - F.col(dist), terms)
    g = sum(((2 * n + 1) / (n**4 * (n + 1) ** 4) * p[n - 1] for n in range(2, terms + 1)), 3 / 16 * p[0])
    return pairs.withColumn("g", g / (4 * math.pi))


def kernel(dist: np.ndarray, terms: int = 7) -> np.ndarray:
    c = [0.0] + [(2 * n + 1) / (n**4 * (n + 1) ** 4) for n in range(1, terms + 1)]
    return np.polynomial.legendre.legval(1 - dist, c) / (4 * math.pi)


def spherical_spline(values: DataFrame, channels: pd.DataFrame, mesh: pd.DataFrame, keys: list[str]) -> DataFrame:
    """Values (keys, channel, value) interpolated at the mesh's points (vertex, x, y, z); channels and mesh are fixed small tables."""
    at = channels.set_index("channel")[["x", "y", "z"]]
    points, vertices = mesh[["x", "y", "z"]].to_numpy(), mesh["vertex"].to_numpy()
    kinds = {f.name: f.dataType.simpleString() for f in values.schema}

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p[p["channel"].isin(at.index) & p["value"].notna()]
        own, v = at.loc[p["channel"]].to_numpy(), p["value"].to_numpy()
        mean = v.mean() if len(v) else 0.0
        g = kernel(np.linalg.norm(own[:, None] - own[None], axis=2))
        c = np.linalg.pinv(np.vstack([g + 0.1, np.ones(len(own))])) @ np.append(v - mean, 0.0)
        out = kernel(np.linalg.norm(points[:, None] - own[None], axis=2)) @ c + mean
        return pd.DataFrame({**{k: [p[k].iloc[0]] * len(out) for k in keys}, "vertex": vertices, "value": out})

    return values.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", vertex long, value double")


def nearest_vertices(ch: DataFrame, mesh: DataFrame, n: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """The n closest vertices (keys, vertex, x, y, z) of each channel (keys, channel, x, y, z), of its own head where keys name one."""
    keys = list(keys)
    d = sum(((F.col(c) - F.col(f"m{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("mx")) ** 2)
    points = mesh.select(*keys, "vertex", *[F.col(c).alias(f"m{c}") for c in "xyz"])
    both = ch.join(points, keys) if keys else ch.crossJoin(points)  # a montage and a mesh, a few hundred rows each
    rank = F.row_number().over(Window.partitionBy(*keys, "channel").orderBy("d", "vertex"))
    return both.withColumn("d", F.sqrt(d)).withColumn("rank", rank).filter(F.col("rank") <= n)


def on_scalp(ch: DataFrame, mesh: DataFrame, factor: float = 1.06, keys: Sequence[str] = ()) -> DataFrame:
    """Channels at the mean of their three nearest vertices, a little outside."""
    return nearest_vertices(ch, mesh, keys=keys).groupBy(*keys, "channel").agg(*[(factor * F.avg(f"m{c}")).alias(c) for c in "xyz"])


def colour_limits(df: DataFrame, value: str, keys: list[str], absolute: bool = False, margin: float = 0.02) -> DataFrame:
    a = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.max(F.abs(value)).alias("m"))
    if absolute:
        return a.select(*keys, (-F.col("m") * (1 + margin)).alias("lo"), (F.col("m") * (1 + margin)).alias("hi"))
    pad = (F.col("hi") - F.col("lo")) * margin
    return a.select(*keys, (F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi"))


def arc_points(ends: DataFrame, height: float = 1.3, samples: int = 100) -> DataFrame:
    """Points k = 0.. on the circle through (x1..), the raised mid-point and (x2..).

    With centre o and radius vectors u and v of the ends, a point is their spherical mean around the middle: the circle
    is kept in the plane of o, the first end and the raised middle.
    """
    p = lambda s: [F.col(f"{c}{s}") for c in "xyz"]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    sub = lambda a, b: [x - y for x, y in zip(a, b, strict=True)]
    names = lambda df, n, v: df.withColumns({f"{n}{k}": c for k, c in enumerate(v)})
    get = lambda n: [F.col(f"{n}{k}") for k in range(3)]
    df = names(ends, "m", [(a + b) / 2 * height for a, b in zip(p(1), p(2), strict=True)])
    df = names(names(df, "u", sub(get("m"), p(1))), "v", sub(p(2), p(1)))
    u, v = get("u"), get("v")
    uu, vv, uv = dot(u, u), dot(v, v), dot(u, v)
    den = F.nullif(2 * (uu * vv - uv * uv), F.lit(0.0))
    df = df.withColumns({"s": vv * (uu - uv) / den, "t": uu * (vv - uv) / den})
    df = names(df, "o", [a + F.col("s") * x + F.col("t") * y for a, x, y in zip(p(1), u, v, strict=True)])
    df = names(names(df, "a", sub(p(1), get("o"))), "b", sub(get("m"), get("o")))
    a, b = get("a"), get("b")
    r2 = dot(a, a)
    df = names(df.withColumn("r2", r2), "w", [y - x * dot(a, b) / r2 for x, y in zip(a, b, strict=True)])
    w = get("w")
    df = names(df, "e", [x * F.sqrt("r2") / F.nullif(F.sqrt(dot(w, w)), F.lit(0.0)) for x in w])
    end = sub(p(2), get("o"))
    angle = F.atan2(dot(end, get("e")), dot(end, a))
    df = df.withColumn("angle", F.when(angle < 0, angle + 2 * math.pi).otherwise(angle)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    at = F.col("angle") * F.col("k") / (samples - 1)
    return df.select(*[c for c in ends.columns], "k", *[(F.col(f"o{n}") + F.col(f"a{n}") * F.cos(at) + F.col(f"e{n}") * F.sin(at)).alias(f"p{c}") for n, c in enumerate("xyz")])
