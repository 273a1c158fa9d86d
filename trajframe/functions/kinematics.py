"""Forward kinematics of a joint chain, batch by batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _cos_sin(angle: float) -> tuple[float, float]:
    """Cosine and sine, exact at quarter turns: the rest of 6e-17 that floats leave there would decide the sign of a half turn."""
    quarters = angle / (np.pi / 2)
    if abs(quarters - round(quarters)) < 1e-12:
        return ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0))[round(quarters) % 4]
    return float(np.cos(angle)), float(np.sin(angle))


def forward_kinematics(chain: list[dict], degrees: bool = True, modified: bool = False):
    """A function of array<double> joint angles to array<double> (x, y, z, yaw, pitch, roll).

    ``chain`` has a, alpha, d, theta_offset of each joint (standard or modified convention). With ``degrees`` all angles are
    degrees and converted once. At a pitch of a quarter turn yaw takes all of the turn and roll is 0; a yaw of exactly half a turn is -pi, whatever the
    sign of its zero. Rows whose vector has another length, or a null, give null.
    """
    unit = np.pi / 180 if degrees else 1.0
    twists = [_cos_sin(j["alpha"] * unit) for j in chain]

    @F.pandas_udf("array<double>")
    def pose(angles: pd.Series) -> pd.Series:
        good = angles.map(lambda v: v is not None and len(v) == len(chain) and all(x is not None for x in v))
        out: list = [None] * len(angles)
        if not good.any():
            return pd.Series(out, index=angles.index, dtype=object)
        q = np.stack([np.asarray(v, float) for v in angles[good]])
        m = np.broadcast_to(np.eye(4), (len(q), 4, 4))
        for i, j in enumerate(chain):
            t = q[:, i] * unit + j["theta_offset"] * unit
            (ca, sa), ct, st = twists[i], np.cos(t), np.sin(t)
            step = np.zeros((len(q), 4, 4))
            if modified:
                step[:, 0] = np.stack([ct, -st, 0 * ct, 0 * ct + j["a"]], 1)
                step[:, 1] = np.stack([st * ca, ct * ca, 0 * ct - sa, 0 * ct - sa * j["d"]], 1)
                step[:, 2] = np.stack([st * sa, ct * sa, 0 * ct + ca, 0 * ct + ca * j["d"]], 1)
            else:
                step[:, 0] = np.stack([ct, -st * ca, st * sa, j["a"] * ct], 1)
                step[:, 1] = np.stack([st, ct * ca, -ct * sa, j["a"] * st], 1)
                step[:, 2] = np.stack([0 * ct, 0 * ct + sa, 0 * ct + ca, 0 * ct + j["d"]], 1)
            step[:, 3, 3] = 1
            m = m @ step
        flat = np.hypot(m[:, 0, 0], m[:, 1, 0])
        locked = flat < 1e-6
        over, along = np.where(locked, -m[:, 0, 1], m[:, 1, 0]), np.where(locked, m[:, 1, 1], m[:, 0, 0])
        yaw = np.where((over == 0) & (along < 0), -np.pi, np.arctan2(over, along))
        pitch = np.arctan2(-m[:, 2, 0], flat)
        roll = np.where(locked, 0.0, np.arctan2(m[:, 2, 1], m[:, 2, 2]))
        for i, row in zip(np.flatnonzero(good), np.column_stack([m[:, :3, 3], yaw, pitch, roll]), strict=True):
            out[i] = row
        return pd.Series(out, index=angles.index, dtype=object)

    return pose
