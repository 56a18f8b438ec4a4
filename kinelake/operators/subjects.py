"""Which of several tracked people a clip is about."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: frames that the chosen track may be away before another is chosen.
GAP = 6


def followed(tracks: list[list], largest: list, gap: int = GAP) -> Iterator[tuple]:
    """For each frame in turn the track that is shown, the one that is followed, and its frames away.

    The followed track is shown while it is there; while it is away for up to `gap`
    frames the largest box is shown; then the largest box's track is followed.
    """
    chosen, away = None, 0
    for here, top in zip(tracks, largest, strict=True):
        if chosen is not None and chosen in here:
            away = 0
            yield chosen, chosen, away
            continue
        if chosen is not None and away < gap:
            away += 1
        else:
            chosen, away = top, 0
        yield top, chosen, away


def subjects(boxes: DataFrame, clip: str, gap: int = GAP) -> DataFrame:
    """clip, frame, shown, followed and away for every frame with a tracked box.

    boxes has the clip, frame, track and area.  The largest box and the set of tracks of
    a frame are aggregates; only the fold over a clip's frames is a loop, in a group of
    one row a frame.  Of boxes of one area the smallest track counts; a null area counts
    as 0; boxes without a track or frame are left out, and so are frames without boxes,
    which change nothing.
    """
    kept = boxes.filter("track IS NOT NULL AND frame IS NOT NULL")
    area = F.coalesce(F.col("area"), F.lit(0)).cast("double")
    frames = kept.groupBy(clip, "frame").agg(F.collect_set("track").alias("tracks"), F.min_by("track", F.struct(-area, "track")).alias("largest"))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame", kind="stable")
        out = list(followed([set(t) for t in rows["tracks"]], rows["largest"].tolist(), gap))
        return rows[[clip, "frame"]].assign(shown=[o[0] for o in out], followed=[o[1] for o in out], away=[o[2] for o in out])

    kind = {f.name: f.dataType.simpleString() for f in kept.schema}
    return frames.groupBy(clip).applyInPandas(fold, f"`{clip}` {kind[clip]}, frame {kind['frame']}, shown {kind['track']}, followed {kind['track']}, away int")
