"""Small reference computations used by the tests."""

from __future__ import annotations

import numpy as np

from herdlens.config import EARTH_RADIUS_KM


def neighbour_matrix(points, eps_km, eps_days):
    lat, lon = np.radians(points[:, 0]), np.radians(points[:, 1])
    day = points[:, 2]
    dlat = lat[:, None] - lat[None, :]
    dlon = lon[:, None] - lon[None, :]
    h = np.sin(dlat / 2) ** 2 + np.cos(lat)[:, None] * np.cos(lat)[None, :] * np.sin(dlon / 2) ** 2
    km = 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.clip(h, 0, 1)))
    return (km <= eps_km) & (np.abs(day[:, None] - day[None, :]) <= eps_days)


def sequential_labels(points, eps_km, eps_days, min_samples):
    """Density clusters by visiting rows in order."""
    near = neighbour_matrix(np.asarray(points, dtype=float), eps_km, eps_days)
    core = near.sum(axis=1) >= min_samples
    labels = [-1] * len(core)
    cluster = -1
    seen = set()
    for start in range(len(core)):
        if not core[start] or start in seen:
            continue
        cluster += 1
        stack = [start]
        seen.add(start)
        while stack:
            row = stack.pop()
            labels[row] = cluster
            for other in np.flatnonzero(near[row]):
                if core[other]:
                    if other not in seen:
                        seen.add(other)
                        stack.append(other)
                elif labels[other] == -1:
                    labels[other] = cluster
    return labels
