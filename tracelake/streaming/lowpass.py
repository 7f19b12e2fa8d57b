"""Online low-pass of growing traces: filter state per unit between micro-batches (an extension of the batch filter)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake.kernels import signal

OUT = "rec_id string, roi_id int, frame long, lp double"
STATE = "z0 double, z1 double, next long"


def online_lowpass(chunks: DataFrame, fps: float, cutoff: float = 1.0) -> DataFrame:
    """(rec_id, roi_id, start long, values array<double>) to filtered frames, exactly those of the batch filter.

    Chunks of a unit arrive in order of ``start``; inside a micro-batch they are sorted. Frames at or before the last
    filtered one (a chunk sent twice) are left out. A gap holds the state. Null or empty chunks give nothing.
    """
    b, a = signal.butterworth2(fps, cutoff)

    def run(key, parts, state: GroupState):
        pdf = pd.concat(list(parts), ignore_index=True).sort_values("start", kind="stable")
        z0, z1, after = state.get if state.exists else (None, None, None)
        frames, out = [], []
        for start, values in zip(pdf["start"], pdf["values"], strict=True):
            x = np.asarray(values if values is not None else [], float)
            skip = 0 if after is None else max(0, int(after - start))
            x, start = x[skip:], int(start) + skip
            if not len(x):
                continue
            if z0 is None:
                z0 = z1 = float(x[0])
            y, (z0, z1) = signal.run_section(x, b, a, (z0, z1))
            frames.append(np.arange(start, start + len(x)))
            out.append(y)
            after = start + len(x)
        if after is not None:
            state.update((float(z0), float(z1), int(after)))
        if out:
            yield pd.DataFrame({"rec_id": key[0], "roi_id": key[1], "frame": np.concatenate(frames), "lp": np.concatenate(out)})

    keyed = chunks.select("rec_id", "roi_id", "start", "values").groupBy("rec_id", "roi_id")
    return keyed.applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
