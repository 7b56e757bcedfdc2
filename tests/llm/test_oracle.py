"""The SQL of operators on planted copies, which the smallest given tables hold few of."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest

from barline.llm import embedding_dedup, jaccard_join, oracle, superkmers


def documents():
    rng = random.Random(12)
    body = [f"w{k}" for k in range(80)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x y"), (5, "X  y\n"), (6, "a b c d e"), (7, "A b c d E"), (8, "a " * 40), (9, "a " * 30), (10, "É é x y z w v")]
    for i in range(120):
        words = list(body)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(80)] = f"q{rng.randrange(4)}"
        rows.append((100 + i, rng.choice([" ", "\n", "  "]).join(words[rng.randint(0, 10) : 80 - rng.randint(0, 10)])))
    return rows


def vectors():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((5, 16))
    rows = [(i, (centres[i % 5] + rng.standard_normal(16) * 0.03).tolist()) for i in range(100)]
    return rows + [(200, None), (201, []), (202, [0.0] * 16), (203, [1.0] * 15 + [None]), (204, [float("nan")] * 16), (205, rows[0][1]), (206, rows[0][1][:8])]


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_sql_on_planted_copies(spark, tmp_path, name):
    kind, rows, schema = ("embeddings", vectors(), "vec_id long, embedding array<double>") if "embedding" in name else ("documents", documents(), "doc_id long, text string")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{kind}.parquet"))
    query = {q.__name__: q for q in (superkmers.op2_substring_dedup, jaccard_join.op4_jaccard_join, embedding_dedup.op7_embedding_near_dedup)}[name]
    got = query(spark, str(tmp_path)).toPandas()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW {kind} AS SELECT * FROM read_parquet('{tmp_path}/{kind}.parquet/*.parquet')")
        want = db.execute(oracle.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(rows)
    key = got.columns[0]
    got, want = (x[sorted(want.columns)].sort_values(key).reset_index(drop=True) for x in (got, want))
    assert got.astype(object).equals(want.astype(object))
    links = {"op2_substring_dedup": "n_removed", "op7_embedding_near_dedup": "n_links"}.get(name)
    assert (got[links] > 0).sum() > 50 if links else (got["component_id"] != got[key]).sum() > 50
