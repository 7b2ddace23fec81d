"""Storing trajectories: a folder of Parquet tables, and archives of numpy arrays."""

from __future__ import annotations

import io
import json
import tarfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from driftframe.functions import geometry as G
from driftframe.model import ATOM_ARRAYS, STEP_ARRAYS, Trajectory, atoms_of_types

#: Steps per partition of a stored trajectory.
CHUNK_STEPS = 100_000


def save(traj: Trajectory, path: str, by_type: bool = False) -> None:
    """Parquet tables under ``path``; frames clustered by trajectory and step, or in a folder for each type.

    ``by_type`` makes selections of a species skip the files of others.
    """
    spark = traj.spark
    frames = traj.frames
    if by_type:
        frames = traj.of_atoms(traj.atoms, "type")
        frames.sortWithinPartitions("traj_id", "step", "atom_idx").write.partitionBy("type").mode("overwrite").parquet(f"{path}/frames")
    else:
        frames.sortWithinPartitions("traj_id", "step", "atom_idx").write.mode("overwrite").parquet(f"{path}/frames")
    traj.atoms.write.mode("overwrite").parquet(f"{path}/atoms")
    for name in ("cells", "steps"):
        if (table := getattr(traj, name)) is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")
    meta = {"timestep_fs": traj.timestep_fs, "cell": traj.cell, "attrs": dict(traj.attrs), "tables": [n for n in ("cells", "steps") if getattr(traj, n) is not None]}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/attributes")


def load(spark: SparkSession, path: str) -> Trajectory:
    meta = json.loads(spark.read.text(f"{path}/attributes").first().value)
    frames = spark.read.parquet(f"{path}/frames")
    frames = frames.drop("type")
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in meta["tables"]}
    cell = None if meta["cell"] is None else tuple(map(tuple, meta["cell"]))
    return Trajectory(frames, spark.read.parquet(f"{path}/atoms"), meta["timestep_fs"], cell, tables.get("cells"), tables.get("steps"), meta["attrs"])


def save_arrays(traj: Trajectory, path: str, traj_id: int = 0) -> None:
    """An archive (tar.gz) of .npy arrays, attributes.json and types.json: an export to one local file, array by array.

    Rows are streamed to the driver in order, partition by partition; an array must fit there once.
    """
    import numpy as np

    frames = traj.frames.where(F.col("traj_id") == traj_id)
    steps = traj.nsteps[traj_id]
    types = [r.type for r in traj.atoms.where(F.col("traj_id") == traj_id).orderBy("atom_idx").collect()]
    with tarfile.open(path, "w:gz") as tar:

        def add(name: str, data: bytes) -> None:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))

        def add_array(name: str, array: np.ndarray) -> None:
            held = io.BytesIO()
            np.save(held, array)
            add(f"{name}.npy", held.getvalue())

        add("attributes.json", json.dumps({**traj.attrs, "timestep_fs": traj.timestep_fs}).encode())
        add("types.json", json.dumps({"types": types, "cell": traj.cell}).encode())
        for name in traj.array_names():
            columns = list(traj.columns_of(name))
            own = frames if set(columns) <= set(frames.columns) and name != "cells" else (traj.cells if name == "cells" else traj.steps).where(F.col("traj_id") == traj_id)
            per_atom = own is frames
            out = np.empty((steps, len(types), len(columns)) if per_atom else (steps, len(columns)))
            for r in own.select("step", *(["atom_idx"] if per_atom else []), *columns).toLocalIterator():
                out[(r[0], r[1]) if per_atom else r[0]] = r[1 + per_atom :]
            if name == "cells":
                out = out.reshape(steps, 3, 3)
            add_array(name, out[..., 0] if len(columns) == 1 else out)


def load_arrays(spark: SparkSession, path: str, types: list[str] | None = None) -> Trajectory:
    """Reads such an archive: one task decodes it and emits rows by chunks of steps.

    ``types`` replaces those stored (archives made elsewhere hold none that can be read).
    """
    source = spark.read.format("binaryFile").load(path).select("content")

    def info(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                arrays, texts = _unpack(content)
                shapes = {n: list(a.shape) for n, a in arrays.items()}
                yield pd.DataFrame({"meta": [json.dumps({"shapes": shapes, "attributes": json.loads(texts.get("attributes.json", b"{}")), "types": json.loads(texts.get("types.json", b"{}"))})]})

    meta = json.loads(source.mapInPandas(info, "meta string").first().meta)
    shapes, attributes = meta["shapes"], meta["attributes"]
    if "positions" not in shapes:
        raise ValueError(f"{path}: no positions")
    steps, nat = shapes["positions"][:2]
    per_atom = {n: ATOM_ARRAYS.get(n) or ((n,) if len(s) == 2 else tuple(f"{n}{i}" for i in range(s[2]))) for n, s in shapes.items() if s[:2] == [steps, nat] and len(s) in (2, 3) and n != "cells"}
    per_step = {n: STEP_ARRAYS.get(n) or ((n,) if len(s) == 1 else tuple(f"{n}{i}" for i in range(s[1]))) for n, s in shapes.items() if s[:1] == [steps] and len(s) in (1, 2) and n not in per_atom and n != "cells"}

    def rows(names: dict, with_atoms: bool):
        def emit(batches):
            import numpy as np
            import pandas as pd

            for pdf in batches:
                for content in pdf["content"]:
                    arrays, _ = _unpack(content)
                    size = max(1, CHUNK_STEPS // max(1, nat if with_atoms else 1))
                    for a in range(0, steps, size):
                        n = min(size, steps - a)
                        data = {"traj_id": 0, "step": np.repeat(np.arange(a, a + n), nat if with_atoms else 1)}
                        if with_atoms:
                            data["atom_idx"] = np.tile(np.arange(nat), n)
                        for name, columns in names.items():
                            part = arrays[name][a : a + n].reshape(len(data["step"]), len(columns))
                            data |= {c: part[:, k].astype(float) for k, c in enumerate(columns)}
                        yield pd.DataFrame(data)

        keys = "traj_id int, step long" + ", atom_idx int" * with_atoms
        return source.mapInPandas(emit, ", ".join([keys, *(f"`{c}` double" for columns in names.values() for c in columns)]))

    found = types or meta["types"].get("types") or ["H"] * nat
    cell = meta["types"].get("cell")
    timestep = float(attributes.pop("timestep_fs", 1.0))
    cells = rows({"cells": G.CELL}, False) if "cells" in shapes else None
    return Trajectory(rows(per_atom, True), atoms_of_types(spark, found), timestep, None if cell is None else tuple(map(tuple, cell)), cells, rows(per_step, False) if per_step else None, attributes)


def _unpack(content: bytes) -> tuple[dict, dict]:
    import numpy as np

    arrays, texts = {}, {}
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
        for member in tar:
            name = member.name.rsplit("/", 1)[-1]
            if not member.isfile():
                continue
            data = tar.extractfile(member).read()
            if name.endswith(".npy"):
                arrays[name.removesuffix(".npy")] = np.load(io.BytesIO(data), allow_pickle=False)
            elif name.endswith(".json"):
                texts[name] = data
    return arrays, texts
