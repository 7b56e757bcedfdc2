"""Pairs of units are counted in large lots, and lots of any size give the same counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from barline.llm import class_model


def test_pairs_are_counted_in_lots(monkeypatch):
    texts = ["the cat sat on the mat " * 30_000, "a dog and a cat " * 40_000, "", None, "mat"]  # several slices
    units = class_model.Units(np.zeros(0, np.uint64), np.zeros(0, np.int64), 16)
    lots = []
    count = np.bincount
    monkeypatch.setattr(class_model.np, "bincount", lambda x, *a, **k: lots.append(len(x)) or count(x, *a, **k))

    def run():
        batches = iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])
        (found,) = class_model._count_pairs(units)(batches)
        return found.to_pydict()

    whole = run()
    assert lots == [30_000 * 6 + 40_000 * 5 + 1 + len(texts)] and sum(whole["n"]) == lots[0]
    monkeypatch.setattr(class_model, "_WAITING", 1)
    assert run() == whole and len(lots) > 2
