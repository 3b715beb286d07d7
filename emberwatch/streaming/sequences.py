"""Ordered sequences on a stream; keys share buckets, whose waiting rows are filed in order of time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberwatch.streaming.run import is_marker

HOUR_MS = 3_600_000
HOUR_US = HOUR_MS * 1000

#: So many buckets the keys are dealt out to, by their hash. A checkpoint's state goes with this number.
BUCKETS = 512
#: Rows of a bucket that are sorted at once.
SORTED = 1 << 18
#: Rows from which on a piece of a bucket's waiting rows ends with the hour.
PIECE = 1 << 12
#: No sequence has begun.
NEVER = np.iinfo(np.int64).min

#: Rows in Python: keys, times in microseconds, stages.
Rows = tuple[pa.Array, np.ndarray, np.ndarray]


def staged(stream: DataFrame, stages: list[tuple[Column, str]], ts: str) -> DataFrame:
    """(key, ts, us, stage) rows; each stage may keep the key in a column of its own, of any type but a nested one.

    Rows without a key or a time are in no sequence. The row that closes a bounded stream passes as stage -1.
    The stream is read once, whatever the number of stages.
    """
    us, closes = F.unix_micros(ts).alias("us"), is_marker(ts)
    keys = F.array(*[F.when(test & F.col(ts).isNotNull() & ~closes, F.col(key)) for test, key in stages])
    rows = stream.select(F.col(ts).alias("ts"), us, closes.alias("_closes"), F.posexplode(keys).alias("_place", "key"))
    rows = rows.filter(F.col("key").isNotNull() | (F.col("_closes") & (F.col("_place") == 0)))
    return rows.select("key", "ts", "us", F.when(F.col("_closes"), -1).otherwise(F.col("_place")).alias("stage"))


def _joined(parts: list[Rows]) -> Rows:
    keys, us, stage = zip(*parts)
    return pa.concat_arrays(keys), np.concatenate(us), np.concatenate(stage)


def _chosen(rows: Rows, which: np.ndarray) -> Rows:
    """Rows by a mask or by their places."""
    keys = rows[0].filter(pa.array(which)) if which.dtype == bool else rows[0].take(pa.array(which))
    return keys, rows[1][which], rows[2][which]


class _Sequences(StatefulProcessor):
    """Rows of a bucket wait until the watermark has passed their hour; then they are read in order, once.

    Waiting rows are filed in pieces of whole hours, by number. A batch adds pieces and rewrites none; hours that
    close take their pieces away, and what is left of a piece, fewer than ``PIECE`` rows and one hour's, is filed anew.
    Of all partial sequences of a key that have reached a stage only the one that began last matters, so what a key
    leaves behind is one start per stage. State is kept as Arrow's bytes: a batch asks the store a few times for each
    bucket and piece, however many keys and hours there are.
    """

    def __init__(self, n_stages: int, span_us: int, key_type: pa.DataType):
        self.n_stages, self.span_us, self.width = n_stages, span_us, max(1, n_stages - 1)
        self.filed = pa.schema([("key", key_type), ("us", pa.int64()), ("stage", pa.int16())])
        self.left = pa.schema([("key", key_type), *((f"start{i}", pa.int64()) for i in range(self.width))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "number long", "rows binary")
        #: Number, first and last hour of each piece.
        self.waiting = handle.getValueState("waiting", "pieces binary")
        self.starts = handle.getValueState("starts", "keys binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] < 0:
            return iter(())
        pieces = self._pieces()
        due = min((first for _, first, _ in pieces), default=None)
        held: list[Rows] = []
        for batch in rows:
            keys = pa.array(batch["key"], self.filed.field("key").type, from_pandas=False)  # NaN is a key, not a null
            held.append((keys, batch["us"].to_numpy(np.int64), batch["stage"].to_numpy(np.int16)))
            if sum(len(us) for _, us, _ in held) >= SORTED:
                self._file(_joined(held), pieces)
                held = []
        if held:
            self._file(_joined(held), pieces)
        self._wait(pieces, due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        closed = mark // HOUR_MS
        pieces = self._pieces()
        due = sorted((piece for piece in pieces if piece[1] < closed), key=lambda piece: piece[1])
        pieces = [piece for piece in pieces if piece[1] >= closed]
        keys, starts = self._started()
        held: list[Rows] = []
        for i, (number, _, _) in enumerate(due, 1):
            batch = pa.ipc.read_record_batch(pa.py_buffer(self.pieces.getValue((number,))[0]), self.filed)
            held.append((batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()))
            self.pieces.removeKey((number,))
            if i < len(due) and sum(len(us) for _, us, _ in held) < SORTED:
                continue
            # all rows of the hours before the next piece are here
            before = due[i][1] if i < len(due) else closed
            rows = _joined(held)
            now = rows[1] < before * HOUR_US
            held = [_chosen(rows, ~now)]
            found, keys, starts = self._read(_chosen(rows, now), keys, starts)
            if len(found):
                yield found
        if due:
            if len(held[0][1]):
                self._file(held[0], pieces)
            self._wait(pieces, None)
        # a later row is of an hour that is not closed
        alive = starts.max(axis=1, initial=NEVER) >= closed * HOUR_US - self.span_us
        keys, starts = keys.filter(pa.array(alive)), starts[alive]
        if len(keys):
            self.starts.update((self._bytes(self.left, keys, *starts.T),))
            self.handle.registerTimer(((int(starts.max()) + self.span_us) // HOUR_US + 1) * HOUR_MS)
        elif self.starts.exists():
            self.starts.clear()

    def _read(self, rows: Rows, known: pa.Array, starts: np.ndarray) -> tuple[pd.DataFrame, pa.Array, np.ndarray]:
        """Completed sequences of whole hours' rows; keys and their starts go on."""
        n_known = len(known)
        coded = pa.concat_arrays([known, rows[0]]).dictionary_encode()
        names, code = coded.dictionary, coded.indices.to_numpy()[n_known:]
        came = np.full((len(names), self.width), NEVER)
        came[:n_known] = starts  # known keys differ, so they are the first names
        gone = came.copy()
        order = np.lexsort((rows[1], code))
        code, us, stage = code[order], rows[1][order], rows[2][order]
        at = np.arange(len(us))
        new_key = np.diff(code, prepend=-1) != 0
        new_time = new_key | (np.diff(us, prepend=0) != 0)
        of_key, of_time = (np.maximum.accumulate(np.where(new, at, 0)) for new in (new_key, new_time))
        last = np.flatnonzero(np.append(new_key[1:], True)) if len(us) else at
        start, here = us, stage == 0
        for reached in range(self.n_stages):
            if reached:
                # rows of one instant do not follow each other
                earlier = np.where(of_time > of_key, latest[of_time - 1], -1)
                start = np.where(earlier >= of_key, start[earlier], came[code, reached - 1])
                here = (stage == reached) & (start >= us - self.span_us)
            if reached < self.n_stages - 1:
                latest = np.maximum.accumulate(np.where(here, at, -1))
                ends = last[latest[last] >= of_key[last]]
                gone[code[ends], reached] = start[latest[ends]]
        done = np.flatnonzero(here)
        done = done[np.diff(of_time[done], prepend=-1) != 0]
        found = {"key": names.take(pa.array(code[done])).to_pandas(), "first_us": start[done], "last_us": us[done]}
        return pd.DataFrame(found), names, gone

    def _file(self, rows: Rows, pieces: list[tuple[int, int, int]]) -> None:
        """Rows as new pieces, each of whole hours."""
        rows = _chosen(rows, np.argsort(rows[1], kind="stable"))
        hours = rows[1] // HOUR_US
        number = max((number for number, _, _ in pieces), default=-1)
        begin = 0
        while begin < len(hours):
            end = int(np.searchsorted(hours, hours[min(begin + PIECE, len(hours)) - 1], "right"))
            number += 1
            self.pieces.updateValue((number,), (self._bytes(self.filed, *_chosen(rows, np.arange(begin, end))),))
            pieces.append((number, int(hours[begin]), int(hours[end - 1])))
            begin = end

    def _wait(self, pieces: list[tuple[int, int, int]], due: int | None) -> None:
        """Keep the list of pieces; a timer for its first hour, unless there is one for the hour ``due`` or before."""
        if not pieces:
            self.waiting.clear()
            return
        self.waiting.update((np.array(pieces, np.int64).tobytes(),))
        first = min(first for _, first, _ in pieces)
        if due is None or first < due:
            self.handle.registerTimer((first + 1) * HOUR_MS)

    def _pieces(self) -> list[tuple[int, int, int]]:
        kept = self.waiting.get()
        return [tuple(piece) for piece in np.frombuffer(kept[0], np.int64).reshape(-1, 3).tolist()] if kept else []

    def _started(self) -> tuple[pa.Array, np.ndarray]:
        kept = self.starts.get()
        if not kept:
            return pa.array([], self.left.field("key").type), np.empty((0, self.width), np.int64)
        batch = pa.ipc.read_record_batch(pa.py_buffer(kept[0]), self.left)
        return batch.column(0), np.stack([column.to_numpy() for column in batch.columns[1:]], axis=1)

    @staticmethod
    def _bytes(schema: pa.Schema, *columns) -> bytes:
        arrays = [pa.array(c, field.type) if isinstance(c, np.ndarray) else c for c, field in zip(columns, schema)]
        return pa.record_batch(arrays, schema=schema).serialize().to_pybytes()

    def close(self) -> None:
        pass


def sequences(rows: DataFrame, n_stages: int, span_us: int, delay: str) -> DataFrame:
    """(key, first_us, last_us) of instants that complete all stages in order, within ``span_us`` of the first.

    The start is the latest that leads to the instant. Results of an hour come once the watermark has passed it.
    Needs a state store with named states (``run.STATE_STORE``).
    """
    kind = rows.schema["key"].dataType
    result = T.StructType([T.StructField("key", kind), T.StructField("first_us", T.LongType()), T.StructField("last_us", T.LongType())])
    fractions = isinstance(kind, (T.FloatType, T.DoubleType))
    if fractions:
        rows = rows.withColumn("key", F.col("key") + F.lit(0).cast(kind))  # -0.0 is 0.0
    # pandas has times without a zone
    key_type = pa.timestamp("us") if isinstance(kind, T.TimestampType) else to_arrow_type(kind)
    # the closing row, which alone has no key, stays by itself, so columns of numbers have no nulls
    bucket = F.when(F.col("stage") < 0, -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    grouped = rows.withWatermark("ts", delay).withColumn("bucket", bucket).groupBy("bucket")
    found = grouped.transformWithStateInPandas(_Sequences(n_stages, span_us, key_type), result, "Append", "EventTime")
    # on its way from pandas NaN becomes a null, which is no key
    return found.withColumn("key", F.coalesce("key", F.lit("NaN").cast(kind))) if fractions else found
