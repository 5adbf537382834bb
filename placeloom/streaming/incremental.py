"""The same computations over streams: sticky motion flags, running voxel sums, chunk windows, session upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from placeloom.operators import clouds


def sticky_tracks(detections: DataFrame, max_step: float) -> DataFrame:
    """(session, track_id, n, dynamic) whenever a track has news; once dynamic, a track stays so.

    State by track: the last position, all steps so far and the flag.  ``detections``: session,
    track_id, seq, x, y, z; within a batch they are taken by seq.
    """
    import numpy as np

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, steps, flag, n = ([], [], False, 0) if not state.exists else (list(state.get[0]), list(state.get[1]), state.get[2], state.get[3])
        rows = pd.concat(list(frames)).sort_values("seq")
        for p in rows[["x", "y", "z"]].to_numpy():
            if last:
                steps.append(float(np.linalg.norm(p - last)))
            last = p.tolist()
            n += 1
            flag = flag or (n >= 3 and float(np.median(steps)) > max_step)
        state.update((last, steps, bool(flag), n))
        yield pd.DataFrame({"session": [key[0]], "track_id": [key[1]], "n": [n], "dynamic": [bool(flag)]})

    kinds = dict(detections.dtypes)
    return detections.groupBy("session", "track_id").applyInPandasWithState(
        run, f"session {kinds['session']}, track_id {kinds['track_id']}, n long, dynamic boolean", "last array<double>, steps array<double>, dynamic boolean, n long", "update", GroupStateTimeout.NoTimeout
    )


def voxel_sums(points: DataFrame, size: float) -> DataFrame:
    """Running sums by voxel for update mode; x = sx / n as in the batch operator."""
    return points.groupBy(*clouds.voxel_cells(size)).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{c}") for c in "xyz"])


def label_counts(detections: DataFrame) -> DataFrame:
    """Running label counts and support by track."""
    return detections.groupBy("session", "track_id", "label").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


def chunk_windows(frames: DataFrame, size: int) -> DataFrame:
    """Count-based tumbling windows by position, the partial last one included."""
    return frames.groupBy("session", F.floor(F.col("seq") / size).alias("chunk")).agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def windowed_events(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Event-time windows with a watermark, as an extension: frames themselves come in order."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def upsert_sessions(batch: DataFrame, path: str) -> None:
    """For foreachBatch: each batch replaces the sessions it holds, so that a repeated batch changes nothing."""
    from placeloom.sources.maps import write_session

    write_session(batch, path)
