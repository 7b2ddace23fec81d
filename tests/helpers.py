"""Random trajectories as arrays and as tables, and brute-force formulas in numpy."""

import numpy as np
import pandas as pd

from driftframe.model import Trajectory, atoms_of_types


def trajectory(spark, positions, types, velocities=None, cell=None, timestep=1.0, cells=None, traj_id=0):
    n, m, _ = positions.shape
    data = {"traj_id": np.full(n * m, traj_id, np.int32), "step": np.repeat(np.arange(n), m), "atom_idx": np.tile(np.arange(m, dtype=np.int32), n)}
    data |= {c: positions[:, :, k].ravel() for k, c in enumerate("xyz")}
    if velocities is not None:
        data |= {f"v{c}": velocities[:, :, k].ravel() for k, c in enumerate("xyz")}
    table = None
    if cells is not None:
        names = [r + c for r in "abc" for c in "xyz"]
        table = spark.createDataFrame(pd.DataFrame({"traj_id": np.full(n, traj_id, np.int32), "step": np.arange(n)} | {c: cells.reshape(n, 9)[:, k] for k, c in enumerate(names)}))
    return Trajectory(spark.createDataFrame(pd.DataFrame(data)), atoms_of_types(spark, types, traj_id), timestep, cell, table)


def array_of(frames, columns, n, m):
    out = np.full((n, m, len(columns)), np.nan)
    for r in frames.select("step", "atom_idx", *columns).collect():
        out[r[0], r[1]] = r[2:]
    return out


def msd(r, atoms, nt, s, q, b, nb):
    """[block, k, i, j], normalised by q/(B n)."""
    out = np.zeros((nb, nt, 3, 3))
    for block in range(nb):
        for k in range(nt):
            for t in range(block * b, (block + 1) * b, q):
                d = r[t + s * (k + 1), atoms] - r[t, atoms]
                out[block, k] += np.einsum("ai,aj->ij", d, d)
    return out * q / (b * len(atoms))


def vaf(v, atoms, nt, s, q, b, nb):
    out = np.zeros((nb, nt))
    for block in range(nb):
        for k in range(nt):
            out[block, k] = np.mean([(v[t + s * k, atoms] * v[t, atoms]).sum(axis=1).mean() for t in range(block * b, (block + 1) * b, q)])
    return out


def corner_distances(r, cell):
    """Matrix of distances by the nearest of eight corners."""
    d = r[None, :, :] - r[:, None, :]
    f = (d @ np.linalg.inv(cell)) % 1.0
    at = f @ cell
    corners = np.array([[i, j, k] for i in (0, 1) for j in (0, 1) for k in (0, 1)]) @ cell
    return np.sqrt(((at[:, :, None, :] - corners) ** 2).sum(axis=-1)).min(axis=-1)
