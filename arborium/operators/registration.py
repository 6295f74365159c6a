"""Affine registrations as fifteen parameters and back, and splines with many landmarks, over tables.

Parameters are, in this order, shifts, rotations in degrees, scales, shears and a centre, three numbers each. A matrix acts on
columns (x, y, z, 1): it is R S about the centre, with R the turns about z, y and x, one after the other (z last and backwards),
and S scales with the shears above its diagonal. Older files have their shears apart, each a matrix with one number
below the diagonal that acts after R and the scales, the last one first: legacy.

Defined results: nulls give nulls; a singular matrix is an error; a mirrored one has a negative first scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geometry import AXES, spline_kernel

#: The names and the order of parameters in registration files.
NAMES = ("tx", "ty", "tz", "rx", "ry", "rz", "sx", "sy", "sz", "shx", "shy", "shz", "cx", "cy", "cz")
#: Landmarks of a spline that the driver solves for and each task holds, and distances that a task makes at a time.
MOST_LANDMARKS, AT_A_TIME = 5000, 1 << 21


def matrices(params: np.ndarray, legacy: bool = False) -> np.ndarray:
    """4 x 4 matrices (n, 4, 4) of parameters (n, 15)."""
    shift, turn, scale, shear, centre = (params[:, k : k + 3] for k in range(0, 15, 3))
    n = len(params)
    (a, b, c), one, nil = np.radians(turn).T, np.ones(n), np.zeros(n)
    stack = lambda *rows: np.moveaxis(np.array(rows), 2, 0)
    about_x = stack((one, nil, nil), (nil, np.cos(a), -np.sin(a)), (nil, np.sin(a), np.cos(a)))
    about_y = stack((np.cos(b), nil, np.sin(b)), (nil, one, nil), (-np.sin(b), nil, np.cos(b)))
    about_z = stack((np.cos(c), np.sin(c), nil), (-np.sin(c), np.cos(c), nil), (nil, nil, one))
    turned = about_z @ about_y @ about_x
    if legacy:
        linear = turned * scale[:, None, :]
        for k, (row, column) in reversed(list(enumerate(((1, 0), (2, 0), (2, 1))))):
            one_shear = np.tile(np.eye(3), (n, 1, 1))
            one_shear[:, row, column] = shear[:, k]
            linear = one_shear @ linear
    else:
        linear = turned @ stack((scale[:, 0], shear[:, 0], shear[:, 1]), (nil, scale[:, 1], shear[:, 2]), (nil, nil, scale[:, 2]))
    out = np.tile(np.eye(4), (n, 1, 1))
    out[:, :3, :3] = linear
    out[:, :3, 3] = shift + centre - np.einsum("nij,nj->ni", linear, centre)
    return out


def parameters(held: np.ndarray, centres: np.ndarray | None = None) -> np.ndarray:
    """Parameters (n, 15) of matrices (n, 4, 4) about centres (n, 3), the origin unless given."""
    n = len(held)
    centres = np.zeros((n, 3)) if centres is None else centres
    turned, upper = np.linalg.qr(held[:, :3, :3])
    signs = np.where(np.diagonal(upper, axis1=1, axis2=2) < 0, -1.0, 1.0)
    turned, upper = turned * signs[:, None, :], upper * signs[:, :, None]
    if n and np.diagonal(upper, axis1=1, axis2=2).min() < np.finfo(float).eps:
        raise ValueError("a matrix is singular")
    mirrored = np.where(np.linalg.det(turned) < 0, -1.0, 1.0)
    turned[:, :, 0] *= mirrored[:, None]
    upper[:, 0, :] *= mirrored[:, None]
    level = np.hypot(turned[:, 0, 0], turned[:, 1, 0])
    flat = level > 1e-8
    a = np.where(flat, np.arctan2(turned[:, 2, 1], turned[:, 2, 2]), np.arctan2(-turned[:, 1, 2], turned[:, 1, 1]))
    c = np.where(flat, np.arctan2(-turned[:, 1, 0], turned[:, 0, 0]), 0.0)
    b = np.arctan2(-turned[:, 2, 0], level)
    shift = held[:, :3, 3] - centres + np.einsum("nij,nj->ni", held[:, :3, :3], centres)
    return np.column_stack([shift, np.degrees(a), np.degrees(b), np.degrees(c), np.diagonal(upper, axis1=1, axis2=2), upper[:, 0, 1], upper[:, 0, 2], upper[:, 1, 2], centres])


def composed(table: DataFrame, legacy: bool = False) -> DataFrame:
    """table with columns NAMES -> table with matrix, 16 numbers by rows; null if a parameter is."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p = f[list(NAMES)].astype(float).to_numpy()
            known = np.isfinite(p).all(1)
            made = iter(matrices(p[known], legacy).reshape(-1, 16).tolist())
            yield f.assign(matrix=pd.Series([next(made) if k else None for k in known], index=f.index, dtype=object))

    kinds = ", ".join(f"`{c}` {t}" for c, t in table.dtypes)
    return table.mapInPandas(work, f"{kinds}, matrix array<double>")


def decomposed(table: DataFrame) -> DataFrame:
    """table with matrix (16 numbers by rows) and, if it has them, cx, cy, cz -> table with columns NAMES."""
    centred = all(c in table.columns for c in NAMES[12:])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            known = f["matrix"].notna().to_numpy()
            held = np.array(f["matrix"][known].tolist(), float).reshape(-1, 4, 4)
            out = np.full((len(f), 15), np.nan)
            out[known] = parameters(held, f.loc[known, list(NAMES[12:])].astype(float).to_numpy() if centred else None)
            yield f.assign(**{c: out[:, k] for k, c in enumerate(NAMES)})

    others = [(c, t) for c, t in table.dtypes if c not in NAMES]
    out = table.select(*(c for c, _ in others), *(NAMES[12:] if centred else ())).mapInPandas(work, ", ".join([*(f"`{c}` {t}" for c, t in others), *(f"{c} double" for c in NAMES)]) if not centred else ", ".join([*(f"`{c}` {t}" for c, t in others), *(f"{c} double" for c in (*NAMES[12:], *NAMES[:12]))]))
    return out.select(*(c for c, _ in others), *(F.when(F.col("matrix").isNotNull(), F.col(c)).alias(c) for c in NAMES))


def spline(points: DataFrame, landmarks: DataFrame) -> DataFrame:
    """points (x, y, z and others) under the thin-plate spline of landmarks (x, y, z, to_x, to_y, to_z), MOST_LANDMARKS at most.

    The driver solves for one weight a landmark; tasks take sums over all of them for some points at a time, so the plan doesn't
    grow with the landmarks.
    """
    rows = landmarks.select(*AXES, *(f"to_{c}" for c in AXES)).limit(MOST_LANDMARKS + 1).collect()
    if len(rows) > MOST_LANDMARKS:
        raise ValueError(f"a spline has {MOST_LANDMARKS} landmarks at most")
    held = np.array(sorted(map(tuple, rows)), float).reshape(-1, 6)
    weights, flat = spline_kernel(held[:, :3], held[:, 3:])
    shared = points.sparkSession.sparkContext.broadcast((held[:, :3], weights, flat))
    step = max(1, AT_A_TIME // max(1, len(held)))

    def move(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, w, affine = shared.value
        for f in frames:
            p = f[list(AXES)].astype(float).to_numpy()
            out = affine[0] + p @ affine[1:]
            for k in range(0, len(p), step):
                out[k : k + step] += np.linalg.norm(p[k : k + step, None] - source[None], axis=2) @ w
            yield f.assign(**{c: out[:, k] for k, c in enumerate(AXES)})

    return points.mapInPandas(move, ", ".join(f"`{c}` {'double' if c in AXES else t}" for c, t in points.dtypes))
