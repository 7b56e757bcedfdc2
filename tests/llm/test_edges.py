"""Empty tables, columns that have the names of results, very long texts, and verdicts of the quality rules."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import byte_bpe, importance_sampling, language_id, repetition, superkmers

from test_llm import WORD, lowered, table


def clashing(spark, names):
    """The small table, with text in columns that have the names of results."""
    return table(spark).withColumns({name: F.lit("mine") for name in names})


def same(one, other):
    return sorted(map(str, (r.asDict() for r in one.collect()))) == sorted(map(str, (r.asDict() for r in other.select(*one.columns).collect())))


def test_columns_with_the_names_of_results_are_replaced(spark):
    rules = repetition.repetition_rules
    assert same(rules(table(spark)), rules(clashing(spark, ["n_words", "kept", "repeat_share"])))
    assert same(superkmers.dedup_substrings(table(spark)), superkmers.dedup_substrings(clashing(spark, ["n_words", "kept_text"])))
    assert same(byte_bpe.decode(byte_bpe.encode(table(spark))), byte_bpe.decode(byte_bpe.encode(clashing(spark, ["ids", "decoded"]))))
    ratio = np.zeros(importance_sampling.SIZE)
    ratio[::3] = 1
    assert same(importance_sampling.resample(table(spark), ratio, 0.5), importance_sampling.resample(clashing(spark, ["log_weight", "sampling_key", "kept"]), ratio, 0.5))


def test_empty_tables(spark):
    none = table(spark).where("false")
    assert repetition.repetition_rules(none).count() == 0
    assert superkmers.dedup_substrings(none).count() == 0
    assert byte_bpe.decode(byte_bpe.encode(none)).count() == 0
    assert language_id.identify(none, None).count() == 0


def test_verdict_is_that_of_all_repeated_substrings(spark):
    def brute(text):
        w = WORD.findall(text or "")
        inside, longest = set(), 0
        for i in range(len(w)):
            most = 0
            for j in range(len(w)):
                k = 0
                while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                    k += 1
                most = max(most, k)
            longest = max(longest, most)
            if most >= 4:
                inside.update(range(i, i + most))
        return len(inside) / max(len(w), 1), longest

    rng = random.Random(11)
    rows = []
    for i in range(80):
        words = [f"{rng.choice('abcdef')}{rng.randrange(12)}" for _ in range(rng.randint(0, 70))]
        for _ in range(rng.randrange(3)):
            at, size = rng.randrange(len(words) + 1), rng.randint(2, 12)
            words[at:at] = words[:size]
        rows.append((i, " ".join(words)))
    rows += [(None, "a b c d e " * 5), (None, "a b c d e " * 5)]
    got = repetition.repetition_rules(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        share, longest = brute(r["text"])
        assert r["repeat_share"] == pytest.approx(share) and r["longest_repeat"] == longest
        assert r["kept"] == (not r["base_failed"] and share <= 0.25 and longest <= 150)
    assert {r["kept"] for r in got} == {True, False}


def test_very_long_texts(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300_000))
    r = repetition.repetition_rules(table(spark, [(1, long), (2, "a b")])).where("doc_id = 1").first()
    assert r["n_words"] == 300_000 and r["word_chars"] == len(long) - 299_999 and r["kept"]
    ratio = np.arange(importance_sampling.SIZE) / importance_sampling.SIZE
    whole = importance_sampling.resample(table(spark, [(1, long), (2, lowered(long))]), ratio, 1.0).collect()
    assert len({x["log_weight"] for x in whole}) == 1 and all(x["kept"] for x in whole)
