"""Running a step function frame by frame.

A step function takes the state of a key and one frame's rows (dictionaries in
order) and returns the rows to emit; it may change the state in place. In batch
the rows are dealt and sorted by key, then streamed: memory holds one frame and
one state, however long a key's history is. In streams the same function runs
on keyed state and holds back the newest frame until a newer one arrives.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[dict, list[dict]], list[dict]]


def _frames(batches: Iterator[pd.DataFrame], keys: list[str], frame: str) -> Iterator[tuple[tuple, list[dict]]]:
    """(key, rows) of each frame, in order, across batch borders."""
    held: list[dict] = []
    at: tuple | None = None
    for batch in batches:
        for row in batch.to_dict("records"):
            here = (*(row[k] for k in keys), row[frame])
            if here != at:
                if held:
                    yield at[:-1], held
                held, at = [], here
            held.append(row)
    if held:
        yield at[:-1], held


def by_frame(d: DataFrame, step: Callable[[], Step], schema: str, keys: list[str], frame: str = "frame_idx", order: list[str] | None = None, in_turn: bool = False) -> DataFrame:
    """Batch run: a fresh state for each key, frames in ascending order, rows of a frame by ``order``.

    With ``in_turn`` the tasks take keys by their (first, whole) number in turn:
    hashes of a few keys often meet in one task, which then takes twice the time.
    """
    columns = [c.split()[0] for c in schema.split(", ")]
    if in_turn:
        tasks = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")) | 1  # odd: numbers in even steps fill all tasks too
        dealt = d.repartitionById(tasks, F.pmod(keys[0], F.lit(tasks)).cast("int"))
    else:
        dealt = d.repartition(*keys)
    ordered = dealt.sortWithinPartitions(*keys, frame, *(order or ["det_id"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        current: tuple | None = None
        out: list[dict] = []
        work = step()
        for key, rows in _frames(batches, keys, frame):
            if key != current:
                state, current = {}, key
            out += work(state, rows)
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    return ordered.mapInPandas(run, schema)


def in_stream(stream: DataFrame, step: Callable[[], Step], schema: str, key: str, frame: str = "frame_idx", order: str = "det_id", idle_ms: int | None = None) -> DataFrame:
    """Streaming run on keyed state: the same rows as in batch for data in order.

    A key's newest frame waits until a newer one comes, a row says ``last`` (a
    Boolean column, if there is one), or, with ``idle_ms``, the key has had no
    rows for so long. (A stream with such a limit never ends by itself, so it
    doesn't suit a trigger that stops when all data is read.) Rows of frames
    that were emitted are late and dropped.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(name, batches, state):
        memory, held, done = pickle.loads(state.get[0]) if state.exists else ({}, [], None)
        rows = held + [r for b in batches for r in b.to_dict("records")]
        if done is not None:
            rows = [r for r in rows if r[frame] > done]
        rows.sort(key=lambda r: (r[frame], r[order]))
        newest = rows[-1][frame] if rows else None
        ended = (idle_ms is not None and state.hasTimedOut) or any(r.get("last") for r in rows)
        work, out = step(), []
        at = 0
        while at < len(rows) and (ended or rows[at][frame] < newest):
            end = at
            while end < len(rows) and rows[end][frame] == rows[at][frame]:
                end += 1
            out += work(memory, rows[at:end])
            done, at = rows[at][frame], end
        state.update((pickle.dumps((memory, rows[at:], done)),))
        if rows[at:] and idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=columns)

    return stream.groupBy(key).applyInPandasWithState(run, schema, "state binary", "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout")
