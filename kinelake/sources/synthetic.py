"""Seeded synthetic pose clips: a fixture source, one clip per row of a plan."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from kinelake.sources.tables import JOINTS, POSE

#: A standing body in torso lengths (x to its left, y up, z ahead).
BODY_SHAPE = {"nose": (0, 1.45, 0.1), "eye": (0.05, 1.5, 0.08), "ear": (0.1, 1.47, 0), "shoulder": (0.22, 1.0, 0), "elbow": (0.26, 0.55, 0.02), "wrist": (0.27, 0.1, 0.05), "hip": (0.15, 0.0, 0), "knee": (0.16, -0.85, 0.02), "ankle": (0.16, -1.7, 0)}


def clip(seed: int, reps: int, azimuth: float, fault: str | None, frames_per_rep: int = 60, noise: float = 0.6, scale: float = 100.0) -> pd.DataFrame:
    """Long pose rows of a squat clip seen from an azimuth (degrees)."""
    rng = np.random.default_rng(seed)
    n = reps * frames_per_rep
    depth = {"shallow": 0.25}.get(fault, 0.6) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / frames_per_rep))
    turn = np.radians(azimuth)
    rows = []
    for joint in JOINTS:
        side = 1 if joint.startswith("left") else -1 if joint.startswith("right") else 0
        x, y, z = BODY_SHAPE[joint.split("_")[-1]]
        x = np.full(n, x * side, float)
        z = np.full(n, z, float)
        y = np.full(n, y, float)
        if "ankle" not in joint:
            y = y - depth * (0.5 if "knee" in joint else 1.0)
        if "knee" in joint:
            z = z + depth * 0.8
            x = x * (1 - depth * 0.9) if fault == "knees_in" else x
        if fault == "lean" and y.mean() > 0.3:
            z = z + depth * 0.8
        px = (x * np.sin(turn) + z * np.cos(turn)) * scale + 320 + rng.normal(0, noise, n)
        py = -y * scale + 240 + rng.normal(0, noise, n)
        rows.append(pd.DataFrame({"frame": np.arange(n), "joint": joint, "x": px, "y": py, "c": np.clip(rng.normal(0.95, 0.02, n), 0, 1)}))
    return pd.concat(rows, ignore_index=True)


def generate(spark: SparkSession, plan: list[tuple[str, int, int, float, str | None]]) -> DataFrame:
    """Pose rows of a plan (video, seed, reps, azimuth, fault)."""
    rows = spark.createDataFrame(plan, "video string, seed long, reps int, azimuth double, fault string")

    def work(part: pd.DataFrame) -> pd.DataFrame:
        r = part.iloc[0]
        out = clip(int(r.seed), int(r.reps), float(r.azimuth), r.fault)
        return out.assign(video=r.video)[["video", "frame", "joint", "x", "y", "c"]]

    return rows.groupBy("video").applyInPandas(work, POSE)
