"""Clouds in memory: preprocessing for display."""

from __future__ import annotations

from dataclasses import replace

import numpy as np

from pointweave.functions.bits import VOXEL_BIAS, VOXEL_BITS
from pointweave.model import Header
from pointweave.plans.planner import geometry, with_time_resolution


def voxel_keys(xyz: np.ndarray, resolution: float) -> np.ndarray:
    """The 63-bit key of each row of three 32-bit floats; as ``bits.voxel_key``."""
    scaled = (xyz * (np.float32(1) / np.float32(resolution))).astype(np.float64)
    ticks = np.trunc(scaled + np.copysign(0.5, scaled)).astype(np.int64) + VOXEL_BIAS & (1 << VOXEL_BITS) - 1
    return ticks[:, 0] | ticks[:, 1] << VOXEL_BITS | ticks[:, 2] << 2 * VOXEL_BITS


def visual(header: Header, points: np.ndarray) -> tuple[Header, np.ndarray]:
    """Only the first finite point of each voxel of x, y and z's resolution, in order, and times in microseconds. A header
    without a geometry, and an empty cloud, stay as they are."""
    own = geometry(header)
    if own is None or not len(points):
        return header, points
    header = with_time_resolution(replace(header, width=len(points), height=1))
    xyz = np.stack([points[f.name] for f in own], axis=1)
    finite = np.flatnonzero(np.isfinite(xyz).all(axis=1))
    _, first = np.unique(voxel_keys(xyz[finite], own[0].resolution), return_index=True)
    kept = points[finite[np.sort(first)]]
    return replace(header, width=len(kept), height=1), kept
