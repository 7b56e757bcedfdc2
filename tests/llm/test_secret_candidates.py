"""Candidates against a brute-force search, and texts with very many of them."""

from __future__ import annotations

import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from barline.llm import _session, secret_scan


def slow_candidates(text):
    out, last = [], 0
    for m in regex.finditer(secret_scan.CANDIDATE, text or "", regex.ASCII | regex.V1):
        a, b = m.span()
        out.append((m.group(), text[max(a - 40, 0) : a], text[b : b + 40], a - last, a))
        last = b
    return out


def texts():
    rng = random.Random(2)

    def piece():
        kind = rng.randrange(8)
        if kind < 2:
            return f"t{rng.randrange(9)}{rng.getrandbits(40):010x}abcd1"
        return [f"password=x{rng.randrange(99)}", f'api_key: "é 1 {rng.randrange(9)}"', f"AKIA{rng.getrandbits(40):016d}", "word", "😀", "=\n"][kind - 2]

    out = [None, "", "secret=", "x" * 50]
    out += [rng.choice(["", " ", "\n", ", "]).join(piece() for _ in range(n)) for n in (1, 2, 3, 40, 64, 65, 128, 129, 200, 1000, 3000) for _ in range(3)]
    return out


def test_candidates_equal_a_plain_search(spark):
    rows = texts()
    table = spark.createDataFrame(list(enumerate(rows)), "k int, text string")
    got = {r["k"]: [tuple(c) for c in r["c"]] for r in table.select("k", secret_scan.candidates(F.col("text")).alias("c")).collect()}
    for k, text in enumerate(rows):
        assert got[k] == slow_candidates(text), text
    scanner = secret_scan.Scanner("", "CASE WHEN f.size > 14 THEN 1D ELSE 0D END")
    clean = {r["k"]: r["text"] for r in secret_scan.redact(table, scanner).collect()}
    for k, text in enumerate(rows):
        want, last = "", 0
        for value, _, _, _, a in slow_candidates(text):
            want += text[last:a] + ("[SECRET]" if len(value) > 14 else value)
            last = a + len(value)
        assert clean[k] == (None if text is None else want + text[last:])


def test_many_candidates_in_one_text(spark):
    rng = random.Random(3)
    table = spark.createDataFrame([(" ".join(f"k{rng.getrandbits(44):011x}3z" for _ in range(200_000)),)], "text string")
    began = time.time()
    assert table.select(F.size(secret_scan.candidates(F.col("text")))).first()[0] == 200_000
    assert time.time() - began < 60


def test_a_cluster_names_its_shared_folder():
    class Context:
        master = "spark://far:7077"
        getConf = dict
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    class Far:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="share"):
        _session.shared_folder(Far())
