"""Whitening, fingerprints and periodic runs against brute-force versions on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from barline.llm import fingerprints, periodic_runs, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Whitening


def matrix(kind, size, rng):
    q = np.linalg.qr(rng.standard_normal((size, size)))[0]
    values = {
        "spread": rng.random(size) * 100,
        "triples": np.repeat(rng.random(size // 3 + 1) * 10, 3)[:size],
        "low rank": np.where(np.arange(size) < size // 2, 5.0, 0.0),
        "falling": 10.0 ** -np.arange(size),
    }[kind]
    v = (q * values) @ q.T
    return (v + v.T) / 2, values


@pytest.mark.parametrize("kind", ["spread", "triples", "low rank", "falling"])
@pytest.mark.parametrize("size", [1, 2, 7, 40])
def test_counts_and_eigenvalues(kind, size):
    v, values = matrix(kind, size, np.random.default_rng(size))
    for shift in (0.5, 3.0, 50.0):
        assert whitening.inertia(v - shift * np.eye(size)) == ((values > shift).sum(), (values < shift).sum())
    got, vectors = whitening.leading(v, 16)
    expected = np.sort(np.linalg.eigvalsh(v))[::-1][: len(got)]
    assert len(got) == min(16, (values > 1e-12 * np.abs(v).sum(1).max()).sum())
    if len(got):
        assert np.allclose(got, expected, rtol=1e-9, atol=1e-13 * expected[0])
        assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-10
        assert np.abs(v @ vectors - vectors * got).max() < 1e-11 * expected[0]


def test_inertia_needs_pivots():
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == (1, 1)
    assert whitening.inertia(np.zeros((3, 3))) == (0, 0)
    rng = np.random.default_rng(1)
    for size in range(1, 30):
        a = rng.integers(-2, 3, (size, size)).astype(float)
        a += a.T
        values = np.linalg.eigvalsh(a)
        if np.abs(values).min() > 1e-9:
            assert whitening.inertia(a) == ((values > 0).sum(), (values < 0).sum())


def vectors_table(spark, rows):
    return spark.createDataFrame([(d, v, 7) for d, v in rows], "vec_id long, embedding array<float>, n int").repartition(3)


def test_whitening(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((120, 6)).astype(np.float32)
    base[100:] = base[:20]  # repeated vectors count once
    rows = [(k if k % 50 else None, v.tolist()) for k, v in enumerate(base)]
    wrong = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [float("nan")] * 6), (904, [1.0] * 5), (905, [float("inf")] + [0.0] * 5)]
    got = whitening.whitened(vectors_table(spark, rows + wrong), components=4).toPandas()
    x = np.floor(64 * base.astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    c = fit - total / n
    v = c.T @ c / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    expected = (x - total / n) @ axes / np.sqrt(values)
    assert len(got) == 120 * 4 and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    by_row = {int(k): g.set_index("component") for k, g in got.dropna(subset=["vec_id"]).groupby("vec_id")}
    known = [k for k in range(120) if k % 50]
    w = np.array([by_row[k]["whitened"].loc[[1, 2, 3, 4]].to_numpy() for k in known])
    assert np.abs(w * np.sign((w * expected[known]).sum(0)) - expected[known]).max() < 1e-9
    assert np.allclose(by_row[1]["explained"].loc[[1, 2, 3, 4]], values / np.trace(v))
    for k in known:
        assert set(by_row[k]["deviation"]) == {sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[k], total, strict=True))}


def test_whitening_of_little(spark):
    assert whitening.whitened(vectors_table(spark, [(1, [1.0, 2.0])]).where("false")).count() == 0
    assert whitening.whitened(vectors_table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whitening.whitened(vectors_table(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(5)])).toPandas()
    assert set(line["component"]) == {1} and np.allclose(sorted(line["whitened"]), np.array([-2, -1, 0, 1, 2]) / 2**0.5)
    assert whitening._exact_square(np.array([[1 << 40]]), 1 << 20, [5]) == [None]
    assert whitening._exact_square(np.array([[3, 4], [1, 1]]), 10, [20, 20]) == [(30 - 20) ** 2 + (40 - 20) ** 2, 200]


# Fingerprints


def distance(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def slow_print(text):
    """SimHash term by term."""
    w = WORD.findall(text or "")
    h = fingerprints.words(pa.array([text or ""])).hashes()
    counts = {}
    for x in h.tolist():
        counts[x] = counts.get(x, 0) + 1
    terms = {x: min(n.bit_length(), 4) for x, n in counts.items()}
    k = min(5, len(w))
    shingles = {s ^ 5 for s in fingerprints.sequence_hashes(h, k).tolist()} if w else set()
    votes = np.zeros(128)
    for x, weight in [*terms.items(), *((s, 1) for s in shingles)]:
        lanes = [int(fingerprints.mix(np.array([(x + j * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0]).to_bytes(8, "little") for j in (1, 2)]
        votes += weight * (np.unpackbits(np.frombuffer(b"".join(lanes), np.uint8)) * 2.0 - 1)
    return np.packbits(votes > 0).tobytes().hex()


def texts(n=120, seed=5):
    rng = random.Random(seed)
    out = [None, "", "  \n", "one", "one two three", "x " * 3000, "äöü " * 7 + "日本語"]
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    for k in range(n):
        w = list(base) if k % 2 else [f"v{rng.randrange(300)}" for _ in range(rng.randint(1, 60))]
        w[rng.randrange(len(w))] = f"z{k % 5}"
        out.append(" ".join(w))
    return out


def test_fingerprints(spark):
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts())]
    table = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fingerprint string").repartition(3)
    got = fingerprints.fingerprints(table).collect()
    assert sorted((str(r.doc_id), str(r.text), r.fingerprint) for r in got) == sorted((str(d), str(t), slow_print(t)) for d, t in rows)
    assert slow_print("") == slow_print(None) == "0" * 32
    assert fingerprints.fingerprints(table.where("false")).count() == 0
    long = " ".join(f"w{k}" for k in range(60000))
    assert fingerprints._hexed(fingerprints.simhash(pa.array([long, "a", long]), most=1000)).to_pylist() == [fingerprints._hexed(fingerprints.simhash(pa.array([t]))).to_pylist()[0] for t in (long, "a", long)]


@pytest.mark.parametrize("classes", [100, 10**12])
@pytest.mark.parametrize("radius", [0, 3, 6])
def test_search_finds_all(spark, monkeypatch, radius, classes):
    rng = random.Random(radius)
    centre = rng.getrandbits(128)
    prints = ["0" * 32, "f" * 32, None]
    for _ in range(400):
        x = centre if rng.random() < 0.7 else rng.getrandbits(128)
        for _ in range(rng.randrange(10)):
            x ^= 1 << rng.randrange(128)
        prints.append(f"{x:032x}")
    prints += prints[:30]
    table = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
    plan = fingerprints.blocks
    monkeypatch.setattr(fingerprints, "blocks", lambda _, r: plan(classes, r))
    asked = prints[::10]
    got = fingerprints.near_fingerprints(table, spark.createDataFrame([(p,) for p in asked], "fingerprint string"), radius, hot=50).collect()
    known = [p for p in prints if p]
    for r in got:
        d = [distance(r.fingerprint, p) for p in known]
        near = [x for x in d if 0 < x <= radius]
        assert (r.n_equal, r.n_near, r.nearest) == (d.count(0), len(near), min(near, default=None))
    assert len(got) == len({p for p in asked if p})


def test_blocks():
    assert len(fingerprints.blocks(1000, 6)) == 7
    assert len(fingerprints.blocks(10**9, 6)) == 28
    with pytest.raises(ValueError):
        fingerprints.blocks(10, -1)


def test_edited_fingerprints(spark):
    rows = [(k * 3 if k % 11 else None, t) for k, t in enumerate(texts(60))] + [(9, "repeated"), (9, "repeated")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fingerprints.edited_fingerprints(table).collect()
    assert len(got) == len(rows)
    known = [(d, t or "") for d, t in rows if d is not None and d != 9]
    by_id = {r.doc_id: r for r in got}
    ordered = sorted(known)
    for (d, t), (e, f) in zip(ordered, ordered[1:], strict=False):
        if e - d > 6 or 9 in range(d, e):
            continue  # rows without doc_id and repeated ones are ordered by hash
        edited = t[: len(t) - len(t) // 2] + f[: len(t) // 2]
        r = by_id[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (slow_print(t), slow_print(edited))
        assert r.near_edited == 1 - distance(r.fingerprint, r.edited_fingerprint) / 128
        assert r.near_next == 1 - distance(r.fingerprint, slow_print(f)) / 128
    one = fingerprints.edited_fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one[0].near_next == 1
    assert fingerprints.edited_fingerprints(table.where("false")).count() == 0


def test_last_meets_first(spark):
    rows = [(k, f"{k} " * 10) for k in range(100)]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    for k, t in rows:
        f = rows[(k + 1) % 100][1]
        assert got[k].edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 2] + f[: len(t) // 2]).encode()).hexdigest()


# Periodic runs


def slow_runs(w, least=6, times=4):
    ids = {}
    a = np.array([ids.setdefault(x, len(ids)) for x in w], int)
    seen = {}
    for q in range(1, len(w) // times + 1):
        edge = np.diff(np.concatenate([[0], (a[:-q] == a[q:]).astype(np.int8), [0]]))
        for x, y in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), strict=True):
            if y - x + q >= max(least, times * q):
                seen.setdefault((x, y + q), q)
    return sorted((s, q, e - s) for (s, e), q in seen.items())


def periodic_rows(n=150, seed=1):
    rng = random.Random(seed)
    rows = [(None, None), (1, ""), (2, "a " * 40), (3, "a b " * 40 + "c" + " a b" * 9), (4, "x"), (None, "p q r " * 5), (None, "p q r " * 5)]
    rows.append((5, " ".join(f"u{k % 1700}" for k in range(9000)) + " x y" * 700 + " z" * 5000))
    for k in range(n):
        words = rng.choice([1, 2, 3, 5, 40])
        w = [f"{rng.choice('abc')}{rng.randrange(words)}" for _ in range(rng.randint(1, 400))]
        for _ in range(rng.randint(0, 3)):
            p, at = rng.randint(1, 30), rng.randrange(len(w) + 1)
            w[at:at] = (w[:p] * rng.randint(2, 9))[: -rng.randrange(p) or None]
        rows.append((10 + k, rng.choice([" ", "\t", " \n"]).join(w)))
    return rows


@pytest.mark.parametrize(("least", "times"), [(6, 4), (1, 3), (30, 5)])
def test_periodic_runs(spark, monkeypatch, least, times):
    monkeypatch.setattr(periodic_runs, "TILE_BYTES", 3000)
    rows = periodic_rows()
    table = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, n_words string").repartition(3)
    got = periodic_runs.periodic_runs(table, least, times).collect()
    found = sorted((str(r.doc_id), str(r.text), [(x.start, x.period, x.length) for x in r.runs]) for r in got)
    assert found == sorted((str(d), str(t), slow_runs(WORD.findall(t or ""), least, times)) for d, t in rows)
    for r in got:
        w = WORD.findall(r.text or "")
        cut = {k for x in r.runs for k in range(x.start + x.period, x.start + x.length)}
        assert r.n_words == len(w) and r.collapsed_text == " ".join(x for k, x in enumerate(w) if k not in cut)
    assert periodic_runs.periodic_runs(table.where("false")).count() == 0


def test_fragments_are_those_of_the_tile():
    rng = random.Random(3)
    for _ in range(2000):
        p = rng.choice([1, 2, 4, 8])
        tile = [rng.randrange(2) for _ in range(rng.randint(1, 6 * p))]
        if rng.random() < 0.5:
            root = tile[: rng.randint(1, 2 * p)]
            tile = (root * 99)[: len(tile)]
        left = rng.randint(0, min(2 * p, len(tile) - 1))
        expected = []
        for q in range(p, 2 * p):
            r = next((k for k in range(len(tile)) if left + q + k >= len(tile) or tile[left + k] != tile[left + q + k]), 0)
            l = next((k for k in range(left + 1) if k == left or left - 1 - k + q >= len(tile) or tile[left - 1 - k] != tile[left - 1 - k + q]), 0)  # noqa: E741
            whole = tile[left - l : left + q + r]
            if left + q <= len(tile) and r + l >= q and not any(all(whole[i] == whole[i + s] for i in range(len(whole) - s)) for s in range(1, q)):
                expected.append((l, q + r, q))
        assert periodic_runs.fragments(tile, left, p) == expected


def test_planted_tails_and_digests(spark, tmp_path):
    rows = [(k, t) for k, (_, t) in enumerate(periodic_rows(120, seed=9))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in periodic_runs.op13_periodic_runs(spark, str(tmp_path)).collect()}
    for d, t in rows:
        w = WORD.findall(t or "")
        n, h = len(w), zlib.crc32(str(d).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = slow_runs(w)
        cut = {k for s, q, length in runs for k in range(s + q, s + length)}
        best = max(runs, key=lambda r: (r[2], -r[0], -r[1]), default=None)
        r = got[d]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, q, length in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in cut).encode()).hexdigest()
