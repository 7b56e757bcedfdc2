"""The parabolic stop: a state machine over each series, and the one indicator that no window expresses.

Bars come to a task as a stream of Arrow batches in the order of symbol and date (Spark sorts, and spills what does not
fit). The task keeps one symbol's state from batch to batch: a few numbers, however long the series is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass
class Stop:
    """Falling series are rising ones upside down, so that one rule serves both directions."""

    step: float
    limit: float
    sign: int = 1
    gain: float = 0.0
    stop: float = 0.0
    extreme: float = 0.0
    recent: list[tuple[float, float]] = field(default_factory=list)  # (high, low) of the last two bars

    def next(self, high: float, low: float) -> float | None:
        if not self.recent:
            self.gain, self.stop, self.extreme = self.step, low, high
            self.recent.append((high, low))
            return None
        near, far = (low, high) if self.sign > 0 else (high, low)
        stop = self.stop + self.gain * (self.extreme - self.stop)
        stop = self.sign * min(self.sign * stop, *(self.sign * bar[self.sign > 0] for bar in self.recent))
        if self.sign * near < self.sign * stop:
            stop, self.gain, self.sign, self.extreme = self.extreme, self.step, -self.sign, near
        elif self.sign * far > self.sign * self.extreme:
            self.extreme, self.gain = far, min(self.gain + self.step, self.limit)
        self.stop = stop
        self.recent = [*self.recent[-1:], (high, low)]
        return stop


def stops(high: list[float], low: list[float], step: float, limit: float) -> list[float | None]:
    """The stops of one series."""
    state = Stop(step, limit)
    return [state.next(h, l) for h, l in zip(high, low, strict=True)]


def _stream(step: float, limit: float, symbol: int, high: int, low: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = Stop(step, limit), None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(symbol).dictionary_encode()
            code = keys.indices.fill_null(-1).to_numpy()
            edges = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), batch.num_rows]
            highs, lows = (batch.column(k).to_numpy(zero_copy_only=False).tolist() for k in (high, low))
            out: list[float | None] = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = (batch.column(symbol)[a].as_py(),)
                if own != last:
                    state, last = Stop(step, limit), own
                out.extend(state.next(h, l) for h, l in zip(highs[a:b], lows[a:b], strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64(), from_pandas=True)], names)

    return run


def parabolic_sar(df: DataFrame, step: float = 0.02, max_step: float = 0.2) -> DataFrame:
    """Bars with ``psar``. A series is one task's, which holds one batch of it at a time."""
    if step <= 0 or max_step <= 0:
        raise ValueError("step and max_step must be greater than zero")
    base = df.drop("psar")
    schema = T.StructType([*base.schema.fields, T.StructField("psar", T.DoubleType())])
    at = [base.columns.index(c) for c in ("symbol", "high", "low")]
    ordered = base.repartition("symbol").sortWithinPartitions("symbol", "date")
    return ordered.mapInArrow(_stream(step, max_step, *at, schema.names), schema)
