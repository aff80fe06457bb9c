"""An extra: collapsing a stream of frame labels, with the batch operator's results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from vellum.operators.alphabet import NULL_CODE


def collapsed(frames: DataFrame, sequence: str, time: str, label: str = "label", null: int = NULL_CODE) -> DataFrame:
    """(sequence, time, label) of the frames that begin a run of a label other than null.

    State is the last label of each sequence.  Frames must come in order of time within a sequence from one
    micro-batch to the next; inside a batch they are sorted.
    """
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    schema = f"{sequence} {kinds[sequence]}, {time} {kinds[time]}, {label} {kinds[label]}"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(time)
        last = state.get[0] if state.exists else None
        before = rows[label].shift(1)
        before.iloc[0] = last
        state.update((int(rows[label].iloc[-1]),))
        yield rows[(rows[label] != before) & (rows[label] != null)][[sequence, time, label]]

    return frames.select(sequence, time, label).groupBy(sequence).applyInPandasWithState(run, schema, "last int", "append", "NoTimeout")
