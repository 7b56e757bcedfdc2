"""Operators against brute-force versions on small tables: nulls, empty and long texts, ties, repeated rows, no rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barline.llm import byte_bpe, class_model, components, embedding_dedup, importance_sampling, jaccard_join, language_id, packing, repetition, secret_scan, superkmers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = [(None, "b c d e f g"), (1, None), (2, ""), (3, "x y " * 20), (3, "x y " * 20), (4, "Y X " * 9 + "q"), (4, "x  y\n" * 20), (5, "a " * 30), (6, "a " * 14), (7, "long " + " ".join(f"w{i % 700}" for i in range(20000))), (None, "x y " * 20)]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(d, t, "kept") for d, t in rows], "doc_id long, text string, score string")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def near_copies(seed=3, n=200):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{k}" for k in range(60)]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"q{rng.randrange(5)}"
        rows.append((100 + i, " ".join(words[rng.randint(0, 8) : 60 - rng.randint(0, 8)])))
    return rows


def test_substring_dedup(spark):
    def brute(rows, k=13):
        least, words = {}, [WORD.findall(t or "") for _, t in rows]
        for (d, _), w in zip(rows, words, strict=True):
            for i in range(len(w) - k + 1) if d is not None else ():
                x = tuple(w[i : i + k])
                least[x] = min(least.get(x, d), d)
        out = []
        for (d, _), w in zip(rows, words, strict=True):
            cut = set()
            for i in range(len(w) - k + 1) if d is not None else ():
                if least[tuple(w[i : i + k])] < d:
                    cut.update(range(i, i + k))
            out.append((d, len(w), len(cut), " ".join(x for i, x in enumerate(w) if i not in cut), "kept"))
        return ordered(out)

    rows = ROWS + near_copies()
    got = superkmers.dedup_substrings(table(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_text", "score")
    assert ordered(got.collect()) == brute(rows)
    assert superkmers.dedup_substrings(table(spark).where("false")).count() == 0


def test_hot_minimisers_are_split(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    h = superkmers.sequence_hashes(superkmers.words(pa.array([" ".join(words)])).hashes(), 2)
    pair = words[int(h.argmin()) :][:2]  # the smallest hash of all: the minimiser wherever it stands
    texts = [" ".join([*(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(11)), *pair, *(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(11))]) for _ in range(300)]
    rows = [(i, texts[i % 250]) for i in range(300)]
    slots = 64 * 16

    def fullest(hot):
        batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array([t for _, t in rows]), pa.array([0] * 300, pa.int32())], ["doc_id", "text", "key"])
        out = next(superkmers._send(13, 64, hot)(iter([batch])))
        return max(int(superkmers._thawed(p)[3].sum()) for b, p in zip(*map(pa.Array.to_pylist, out.columns), strict=True) if b >= 0)

    assert fullest(np.zeros(slots, bool)) > 1500 and fullest(np.ones(slots, bool)) < 150
    want, got = (superkmers.dedup_substrings(table(spark, rows), most=most).collect() for most in (superkmers.MOST, 5))
    assert ordered(got) == ordered(want) and sum(r["n_removed"] for r in got) == 50 * 24


def test_repetition(spark):
    def brute(text):
        words, seen, lines = WORD.findall(text or ""), set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line):
                lines += line in seen
                seen.add(line)
        counts = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {j for i in range(len(words) - 7) if counts[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
        longest = 0
        while any(c > 1 for c in Counter(tuple(words[i : i + longest + 1]) for i in range(len(words) - longest)).values()):
            longest += 1
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), lines, len(inside), longest, failed

    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["a", "b", "ab ", " ", "\n", " a", "|", "é ", "b\n"]) for _ in range(rng.randint(0, 150)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "\n"), (903, "a " * 200), (904, "a\n\na\n a\na")]
    got = {r["doc_id"]: r for r in repetition.repetition_rules(table(spark, rows)).collect()}
    for d, text in rows:
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["longest_repeat"], r["base_failed"]) == brute(text)
        assert not (r["base_failed"] and r["kept"])


def test_jaccard_join(spark):
    def brute(rows):
        sets, parent, owners = [], {}, defaultdict(list)
        for d, t in rows:
            w = WORD.findall(lowered(t))
            sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
            if d is not None and sets[-1]:
                owners[sets[-1]].append(d)

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        def link(x, y):
            a, b = root(x), root(y)
            parent[max(a, b)] = min(a, b)

        own = list(owners)
        for i, s in enumerate(own):
            for d in owners[s]:
                link(owners[s][0], d)
            for t in own[:i]:
                if 100 * len(s & t) >= 80 * len(s | t):
                    link(owners[s][0], owners[t][0])
        return ordered((d, len(s), root(d) if d is not None and s else d) for (d, _), s in zip(rows, sets, strict=True))

    rows = ROWS + near_copies() + [(8, "x y"), (9, "X  y\n"), (10, "x y z")]
    assert ordered(jaccard_join.similar_components(table(spark, rows)).collect()) == brute(rows)
    assert jaccard_join.similar_components(table(spark).where("false")).count() == 0


def test_shingles_of_many_documents(spark, monkeypatch):
    texts = pa.array([f"one two three four five w{i} x{i} y{i} z{i} u{i} v{i}" for i in range(400)] + ["one two three four five"])
    out = list(jaccard_join._send_shingles(5, 7)(iter([pa.RecordBatch.from_arrays([texts], ["text"])])))
    parts = [jaccard_join._thawed(p) for batch in out for b, p in zip(*(c.to_pylist() for c in batch.columns), strict=True) if b >= 0]
    assert sum(len(p[3]) for p in parts) == 1  # what all share is one entry of the chunk
    assert sum(len(p[0]) for p in parts) == 400 * 6
    counts = [jaccard_join._thawed(p) for batch in out for b, p in zip(*(c.to_pylist() for c in batch.columns), strict=True) if b < 0]
    assert len(counts) == 1 and counts[0][1].tolist() == [1] * 401
    # one chunk for each row, with more fragments than partitions: what is shared is met across chunks only
    monkeypatch.setattr(jaccard_join, "FRAGMENT_SHINGLES", 50)
    monkeypatch.setattr(jaccard_join, "chunks", lambda batches, most: (b.slice(i, 1) for b in batches for i in range(b.num_rows)))
    apart = ordered(jaccard_join.similar_components(table(spark, near_copies())).collect())
    monkeypatch.undo()
    assert apart == ordered(jaccard_join.similar_components(table(spark, near_copies())).collect())
    assert any(r[0] != r[2] for r in apart)


def test_pivots_with_many_pairs_are_split(spark):
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2) if k % 3 else np.arange(1, 60, dtype=np.uint64) << np.uint64(57)) for k in range(20)]
    held = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(sets)], "id long, members binary")
    pairs = spark.createDataFrame([(0, k) for k in range(1, 20)] + [(3, 6), (1, 2)], "a long, b long")
    want = {(a, b, len(np.intersect1d(sets[a], sets[b]))) for a, b in pairs.collect()}
    for star in (4096, 4):
        got = [tuple(r) for r in jaccard_join.overlaps(pairs, held, star).collect()]
        assert len(got) == len(set(got)) and {x for x in got if x[2]} == {x for x in want if x[2]} and set(got) <= want


def test_byte_bpe(spark):
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    parts = ["a", "b", "the", " ", "  ", "\n", "\t", "\xa0", "\x1c", "\x85", " ", "é", "漢", "😀", "1", "'s", "!", "<|endoftext|>", "\r", "\x00", "word,"]
    rows = ROWS + [(50 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, rows), offsets="offsets")).select("text", "ids", "decoded", "offsets", "score").collect()
    assert len(coded) == len(rows)
    for r in coded:
        text = r["text"] or ""
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert ids == encoding.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
        assert all(encoding.decode_single_token_bytes(i) in text[o["begin"] : o["end"]].encode() for i, o in zip(ids[:200], r["offsets"], strict=False))


def test_ids_of_packing_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(byte_bpe.default_paths()[0])
    rng = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "\t", "\xa0", "\u3000", "\x1c", "\x85", "é", "漢", "'s", "!", "word,", "<|endoftext|>", "x. ", "q.", ".\n"]
    rows = ROWS + [(50 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    got = defaultdict(bytes)
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    for r in sorted(packing.cut_pieces(docs).collect(), key=lambda r: (r["doc_id"], r["piece"])):
        assert r["length"] * 4 == len(r["ids"]) and r["start"] * 4 == len(got[r["doc_id"]]) and (r["piece"] == 0 or r["length"] == 1024)
        got[r["doc_id"]] += bytes(r["ids"])
    for i, (_, t) in enumerate(rows):
        assert np.frombuffer(got[i], "<u4").tolist() == plain.encode(t or "", add_special_tokens=False).ids + [2]


def test_encoder_forgets_old_cuts(monkeypatch):
    monkeypatch.setattr(byte_bpe, "_KEEP", 50)
    codec = byte_bpe.Codec(byte_bpe.default_paths()[0])
    fresh = byte_bpe.Codec(byte_bpe.default_paths()[0])
    rng = random.Random(3)
    for _ in range(30):
        texts = pa.array([" ".join(f"w{rng.randrange(80)}{rng.choice(['', ',', '.'])}" for _ in range(rng.randrange(12))) for _ in range(4)])
        ids, places = codec.encode(texts)
        assert [ids[a:b].tobytes() for a, b in zip(places[:-1], places[1:], strict=True)] == fresh._whole(texts.to_pylist())


def test_class_model_counts(spark):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = [WORD.findall(lowered(t)) + ["\n"] for _, t in ROWS]
    counts = Counter(w for (d, _), ts in zip(ROWS, tokens, strict=True) if not held(d) for w in ts)
    n, v = sum(counts.values()), len(counts)
    want = ordered((d, len(ts), sum(w in counts for w in ts), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ts), 6)) for (d, _), ts in zip(ROWS, tokens, strict=True))
    docs = table(spark).withColumn("held_out", class_model.held_out(F.col("doc_id")))
    got = class_model.score(docs, class_model.fit(docs.where("not held_out"), frequent=300, groups=16, classes=8, passes=3)).collect()
    assert ordered((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    empty = docs.where("false")
    assert class_model.score(empty, class_model.fit(empty)).count() == 0


def test_class_model_scores(spark):
    docs = table(spark, ROWS[:8])
    model = class_model.fit(docs.where("doc_id < 5"), frequent=4, groups=8, classes=6, passes=2)
    h, n, of = class_model._table([r["packed"] for r in model.words.collect()])
    known = {int(x): (int(c), int(k)) for x, c, k in zip(h, n, of, strict=True)}

    def brute(text):
        total, last = 0.0, 6
        hashes, group, _, _ = class_model._tokens(pa.array([text], pa.string()), 8)
        for x, g in zip(hashes.tolist(), group.tolist(), strict=True):
            count, c = known.get(x, (0, int(model.default[g])))
            total += model.transition[last, c] - model.below[c] + math.log10(count + 1)
            last = c
        return total

    assert {k for _, k in known.values()} <= set(range(7)) and known[int(class_model.END)][1] == 6
    for r in class_model.score(docs.withColumn("text2", F.col("text")), model).collect():
        assert r["score"] == pytest.approx(brute(r["text2"]), abs=1e-6)
    # probabilities after each class, and of the words of each class, sum to one
    assert (10.0**model.transition).sum(1) == pytest.approx(np.ones(7))
    size = np.bincount(of, n + 1.0, 7)
    assert size + 1 == pytest.approx(10.0**model.below)


def test_no_bucket_holds_a_row_for_every_document():
    texts = pa.array([f"a{i} b{i}" for i in range(1000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), texts], ["key", "text"])
    out = pa.Table.from_batches(class_model._encode(16, np.zeros(17, np.uint8), 200)(iter([batch])))
    asked = [len(class_model._thawed(p)[0]) for b, p in zip(out["bucket"].to_pylist(), out["packed"].to_pylist(), strict=True) if b >= 0]
    assert sum(asked) == 2001 and max(asked) < 40


def test_counts_are_summed_while_they_come():
    rng, sums, want = np.random.default_rng(2), class_model._Sum(), Counter()
    sums.bound = 100
    for _ in range(200):
        key, count = np.unique(rng.integers(0, 300, 50), return_counts=True)
        sums.add(key, count)
        want.update(dict(zip(key.tolist(), count.tolist(), strict=True)))
        assert sums.size <= (1 << 20)
    key, count = sums.total()
    assert dict(zip(key.tolist(), count.tolist(), strict=True)) == want and (np.diff(key) > 0).all()


def test_equal_texts_have_equal_scores(spark):
    rows = [(i, "same words in all of them") for i in range(40)] + [(None, "same words in all of them")] * 2 + [(7, "another text"), (50, None), (51, "")]
    docs = table(spark, rows)
    got = class_model.score(docs, class_model.fit(docs, frequent=4, groups=4, classes=3, passes=1)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in rows)
    assert len({(r["n_tokens"], r["n_known"], round(r["score"], 9)) for r in got}) == 3


def test_rare_words_have_classes_of_their_own(spark):
    rng = random.Random(6)
    nouns, verbs = ([f"{c}{k}xyz" for k in range(40)] for c in "nv")  # one group by their last bytes
    rows = [(i, " ".join(f"the {rng.choice(nouns)} will {rng.choice(verbs)}" for _ in range(20))) for i in range(60)]
    model = class_model.fit(table(spark, rows), frequent=2, groups=4, classes=6, passes=3, word_passes=8)
    h, _, of = class_model._table([r["packed"] for r in model.words.collect()])
    place = lambda words: set(of[np.searchsorted(h, class_model._tokens(pa.array([" ".join(words)]), 4)[0][:-1])].tolist())
    assert not place(nouns) & place(verbs)


def test_best_class_is_that_of_the_largest_likelihood():
    rng = np.random.default_rng(3)
    tokens, of = rng.integers(0, 30, 4000), np.append(rng.integers(0, 4, 30), 4)
    tokens[::50] = 30

    def likelihood(of):
        pairs = np.zeros((5, 5))
        np.add.at(pairs, (of[tokens[:-1]], of[tokens[1:]]), 1)
        return sum(class_model._xlogx(x).sum() * f for x, f in ((pairs, 1), (pairs.sum(0), -1), (pairs.sum(1), -1))), pairs

    left, right, own = np.zeros((31, 5)), np.zeros((31, 5)), np.zeros(31)
    np.add.at(left, (tokens[1:], of[tokens[:-1]]), 1)
    np.add.at(right, (tokens[:-1], of[tokens[1:]]), 1)
    np.add.at(own, tokens[1:][tokens[1:] == tokens[:-1]], 1)
    got = class_model.best_classes(likelihood(of)[1], of[:30], left[:30], right[:30], own[:30], np.arange(30))
    for w in range(30):
        all_ = [likelihood(np.where(np.arange(31) == w, c, of))[0] for c in range(4)]
        assert all_[got[w]] == pytest.approx(max(all_), abs=1e-6)


def test_embedding_links(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 16))
    rows = [(i, (centres[i % 6] + rng.standard_normal(16) * 0.18).tolist()) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(5)] + [(500, None), (501, []), (502, [0.0] * 16), (503, [1.0] * 15 + [None]), (504, [float("nan")] * 16), (505, [float("inf")] + [1.0] * 15), (None, rows[0][1])]
    good = [(d, np.array(v)) for d, v in rows[:305]]
    x = np.stack([v for _, v in good])
    near = x @ x.T / np.outer(*[np.sqrt((x * x).sum(1))] * 2) >= 0.9
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("embedding", F.col("embedding").cast("array<double>")), block=40).collect()}
    assert len(got) == len(rows)
    links = sum(got[d]["n_links"] for d, _ in good)
    x = np.stack([np.array(v, np.float32).astype(float) for _, v in good])
    near = x @ x.T / np.outer(*[np.sqrt((x * x).sum(1))] * 2) >= 0.9
    np.fill_diagonal(near, False)
    assert 0.95 * near.sum() <= links <= near.sum()
    assert {got[400 + i]["component_id"] for i in range(5)} == {got[0]["component_id"]}
    for d in (500, 501, 502, 503, 504, 505):
        assert got[d]["n_links"] == 0 and got[d]["component_id"] == d and got[d]["kept"]
    assert got[None]["n_links"] == 0


def test_embedding_recall_in_small_buckets(spark):
    """Pairs about the threshold among 70,000 vectors, where a bucket number has 11 bits."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((70_000, 40))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((2000, 40))
    side -= (side * x[:2000]).sum(1, keepdims=True) * x[:2000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = rng.uniform(0.88, 0.93, (2000, 1))
    x[2000:4000] = near * x[:2000] + np.sqrt(1 - near**2) * side
    x = x.astype(np.float32)
    y = x.astype(float)
    cosine = (y[:2000] * y[2000:4000]).sum(1) / np.sqrt((y[:2000] ** 2).sum(1) * (y[2000:4000] ** 2).sum(1))
    assert embedding_dedup.plan(len(x), 0.9)[0] == 11
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    got = embedding_dedup.near_duplicates(df).where("n_links > 0").toPandas().set_index("vec_id")
    found = [i for i in range(2000) if i in got.index and got["n_links"][i] == got["n_links"].get(2000 + i) == 1 and got["component_id"][2000 + i] == i]
    assert (cosine[found] >= 0.9).all() and len(got) == 2 * len(found)
    assert len(found) >= 0.98 * (cosine >= 0.9).sum() > 1000


def test_embeddings_of_equal_bytes(spark):
    rng = np.random.default_rng(7)
    long = rng.standard_normal(8)
    short = np.frombuffer(long.tobytes(), np.float32).astype(float)
    assert np.isfinite(short).all()
    rows = [(1, long.tolist()), (2, short.tolist()), (3, (2 * long).tolist()), (4, (long / 3).tolist())]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 2, 2: 0, 3: 2, 4: 2}


def test_norms_out_of_range_and_other_columns(spark):
    rows = [(1, [1e200, 2e200]), (2, [1e200, 2e200]), (3, [1e-200, 2e-200]), (4, [1e-200, 2.01e-200]), (5, [1e200, -1e200]), (5, [1e200, -1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("x"))
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert got[1]["n_links"] >= 1 and got[2]["component_id"] == 1 and got[3]["n_links"] >= 1 and got[5]["n_links"] == 0
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (200, 200), (None, 5)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(61)) and got[102] == got[101] == 100 and got[200] == 200


def test_packing(spark):
    pieces = packing.cut_pieces(table(spark))
    lengths = {(r["doc_id"], r["piece"], len(r["ids"])) for r in pieces.collect()}
    assert all(n % 4 == 0 and n <= 4096 for _, _, n in lengths) and (1, 0, 4) in lengths
    rng = random.Random(8)
    items = spark.createDataFrame([(i, rng.randint(1, 1024)) for i in range(3000)], "k long, length long").repartition(7)
    got = packing.pack(items).toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(got["k"]) == list(range(3000))
    ends = got.groupby("sequence_id")["length"].cumsum()
    assert (ends - got["length"] == got["offset"]).all() and ends.max() <= 1024
    assert got["sequence_id"].nunique() <= 1.05 * got["length"].sum() / 1024
    assert packing.packed(table(spark).where("false")).count() == 0


def test_language_id(spark):
    rng = random.Random(7)
    syllables = {"aa": ["the", "ing", "tion"], "bb": ["sch", "ung", "ö"], "cc": ["ción", "que", "los"]}
    text = lambda lang: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(40))
    rows = [(i, text(lang), lang, "x") for i in range(150) for lang in [("aa", "bb", "cc")[i % 3]]]
    rows += [(900, None, "aa", "x"), (901, "12 !?", "aa", "x"), (902, "", None, "x"), (903, text("bb"), None, "x"), (None, text("cc"), "cc", "x"), (904, "l" * 100_000, "aa", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    net = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))), steps=120)
    got = {r["doc_id"]: r for r in language_id.identify(docs, net).collect()}
    held = [r for r in rows[:150] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.95 * len(held)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == got[902]["lang_pred"] == "und" and got[903]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.fit(docs.where("false")) is None
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}


def test_every_language_has_training_spans(spark):
    hot = [f"{a}{b}{c}" for a in "bdfgk" for b in "aei" for c in "mnprt"]
    rows = [(i, " ".join(hot), "aa") for i in range(40)] + [(100 + i, f"öü{i}ßä", "bb") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs, language_id.fit(docs, most_spans=60, least_spans=20, steps=60)).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)


def test_languages_without_a_limit(spark):
    rows = [(i, chr(0x4E00 + i) * 40, f"l{i:03}") for i in range(300)]
    net = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_spans=300, least_spans=1, steps=1)
    assert len(net.languages) == 300


def test_labels_are_those_of_a_loop_over_bytes():
    net = language_id.fresh(["a", "b", "c"], 5, 2)
    texts = ["l" * 100_000, "漢字かな交じり文" * 60, "", "a b. 1", "x" * language_id.BLOCK, "y" * (language_id.BLOCK + 1)]
    data, places = language_id.utf8(pa.array(texts))
    got = language_id.label(net, data, places)

    def states(k, symbols):
        h, out, size = np.zeros(5), [], 5
        for c in symbols:
            g, u = net.table[k][c].astype(float), net.recurrent[k].astype(float) @ h
            z, r = np.clip(g[:size] + u[:size], 0, 1), np.clip(g[size : 2 * size] + u[size : 2 * size], 0, 1)
            new = g[2 * size :] + r * u[2 * size :]
            new = new / (1 + np.abs(new))
            h = z * h + (1 - z) * new
            out.append(h)
        return out

    known = {}
    for i, text in enumerate(texts):
        raw, c = list(text.encode()), language_id.CONTEXT
        padded = [256] * c + raw + [256] * (c + language_id.BLOCK)
        want = np.zeros(3)
        for first in range(0, len(raw), language_id.BLOCK):
            read = tuple(padded[first : first + language_id.BLOCK + 2 * c])
            n = min(language_id.BLOCK, len(raw) - first)
            if (read, n) not in known:
                forwards, backwards = states(0, read[:-c])[c:], states(1, read[:c - 1 : -1])[c:][::-1]
                total = np.zeros(3)
                for f, b in list(zip(forwards, backwards, strict=True))[:n]:
                    x = net.out[0] @ f + net.out[1] @ b + net.bias
                    total += np.exp(x) / np.exp(x).sum()
                known[read, n] = total
            want += known[read, n]
        assert got[i] == pytest.approx(want, rel=1e-4)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = language_id.fresh(["a", "b"], 3, 1)
    x = rng.integers(97, 110, (4, 5 + 2 * language_id.CONTEXT))
    x[:2, : language_id.CONTEXT] = language_id.OUTSIDE
    target = np.eye(2, dtype=np.float32)[[0, 1, 0, 1]]

    def loss():
        p = language_id._probabilities(net, language_id._both(net, x)).astype(float)
        return -(np.log(p) * target.T).sum() / (5 * 4)

    for p, g in zip(net.parameters(), language_id._gradients(net, x, target), strict=True):
        assert p.shape == g.shape
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 0.01
        up = loss()
        p[at] = old - 0.01
        down = loss()
        p[at] = old
        assert g[at] == pytest.approx((up - down) / 0.02, rel=0.05, abs=1e-4)


def test_importance_sampling(spark):
    rows = [(i, ("good fine words here " if i % 2 else "bad%%% junk!! ") * 30, bool(i % 2)) for i in range(200)] + [(None, None, None), (900, "", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, target boolean")
    def grams(text):
        w = re.findall("[a-z]+|[%!]+", text or "")
        return w + list(zip(w, w[1:]))

    got = importance_sampling.resample(docs, importance_sampling.fit(docs), 0.5).collect()
    assert len(got) == len(rows)
    assert all(r["kept"] for r in got if r["target"]) and not any(r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] < 200 and not r["target"])
    counts = {flag: Counter(g for _, t, f in rows if f or not flag for g in grams(t)) for flag in (True, False)}
    sizes = {flag: sum(c.values()) + importance_sampling.SIZE for flag, c in counts.items()}
    for r, (d, t, _) in zip(sorted(got, key=lambda r: str(r["doc_id"])), sorted(rows, key=lambda r: str(r[0])), strict=True):
        want = sum(math.log((counts[True][g] + 1) / sizes[True]) - math.log((counts[False][g] + 1) / sizes[False]) for g in grams(t))
        assert r["doc_id"] == d and r["log_weight"] == pytest.approx(want, abs=1e-6)
    for texts in ([None], ["", None]):  # a slice without n-grams
        bare = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, target boolean")
        assert [r["log_weight"] for r in importance_sampling.resample(bare, importance_sampling.fit(bare), 0.5).collect()] == [0.0] * len(texts)
    assert importance_sampling.resample(docs.where("false"), np.zeros(importance_sampling.SIZE), 0.5).count() == 0
    values = spark.createDataFrame([(float(i % 977),) for i in range(5000)], "v double")
    for k in (1, 777, 4999, 6000):
        want = sorted((float(i % 977) for i in range(5000)), reverse=True)[min(k, 5000) - 1]
        assert importance_sampling.kth_largest(values, "v", k, few=50) == want


def test_targets_are_all_marked_or_a_bounded_sample(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.lit(False).alias("target"))
    docs = docs.union(docs.where("doc_id < 2")).union(spark.createDataFrame([(None, None, None)], "doc_id long, text string, target boolean"))
    targets = spark.range(0, 4000, 2).select(F.col("id").alias("doc_id"))
    marked = importance_sampling.mark_targets(docs, targets, 2000)
    assert marked.count() == 4003 and marked.where("target").count() == 2001 and marked.where("target and doc_id % 2 = 1").count() == 0
    assert 350 < importance_sampling.mark_targets(docs, targets, 2000, most=500).where("target").count() < 650
    assert importance_sampling.mark_targets(docs, targets.where("false"), 0).where("target").count() == 0


def test_secret_scan(spark):
    rng = random.Random(9)
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    word = lambda: "".join(rng.choice(["the", "ing", "er"]) for _ in range(3))
    rows = [(i, " ".join(word() for _ in range(10)) + f" {key()} " + f"password={rng.getrandbits(72):018x} " + str(rng.randrange(10**15, 10**16)) + " end") for i in range(120)]
    docs = spark.createDataFrame([(d, t, "kept") for d, t in [*rows, (900, None), (901, ""), (902, "nothing")]], "doc_id long, text string, findings string")
    scanner = secret_scan.fit(docs)
    found = secret_scan.found(docs, scanner).collect()
    texts = dict(rows)
    assert all(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]] == r["value"] for r in found)
    assert all((r["probability"] >= 0.5) != r["value"].isdigit() for r in found) and len(found) == 360
    counts = {(r["label"], r["is_secret"]): r["n"] for r in secret_scan.quality(secret_scan.candidate_rows(docs), scanner).collect()}
    assert set(counts) == {(0.0, False), (1.0, True)} and 30 < sum(counts.values()) < 110  # about a fifth of 360
    twice = secret_scan.found(docs.union(docs.where("doc_id = 3")), scanner).where("doc_id = 3")
    assert twice.count() == 6 and twice.distinct().count() == 3
    assert ordered(secret_scan.fit_and_redact(docs).collect()) == ordered(secret_scan.redact(docs, scanner).collect())
    clean = {r["doc_id"]: r for r in secret_scan.redact(docs, scanner).collect()}
    assert all("AKIA" not in clean[d]["text"] and re.search(r"\d{16} end$", clean[d]["text"]) for d in texts)
    assert clean[900]["text"] is None and clean[901]["text"] == "" and clean[902]["text"] == "nothing" and clean[902]["findings"] == "kept"
    assert secret_scan.found(docs.where("false"), secret_scan.fit(docs.where("false"))).count() == 0


def test_values_behind_names_are_candidates(spark):
    texts = {"password=hunter2 x": ["hunter2"], "a password=Tr0ub4dor&3.": ["Tr0ub4dor&3"], "secret = CorrectHorseBatteryStaple, b": ["CorrectHorseBatteryStaple"]}
    texts |= {"OAUTH2_CLIENT_SECRET=ab1": ["OAUTH2_CLIENT_SECRET", "ab1"], 'OAUTH2_CLIENT_SECRET="x y1" z': ["OAUTH2_CLIENT_SECRET", "x y1"], "OAUTH2_CLIENT_SECRET= ab1\n": ["OAUTH2_CLIENT_SECRET", "ab1"]}
    texts |= {"é QUJDREVGR0hJSg== c": ["QUJDREVGR0hJSg=="], "a secret of hers: none": [], "token: tokens": ["tokens"], "{'api_key': 'é 1'}": ["é 1"]}
    docs = table(spark, list(enumerate(texts)))
    rows = docs.select("text", F.explode(secret_scan.candidates(F.col("text"))).alias("c")).select("text", "c.*").collect()
    got = defaultdict(list)
    for r in rows:
        got[r["text"]].append(r["value"])
        assert r["before"] + r["value"] + r["after"] == r["text"]
    assert {t: got[t] for t in texts} == texts
    labels = {r["value"]: r["label"] for r in secret_scan.labelled(docs).collect()}
    assert [labels[v] for v in ("hunter2", "Tr0ub4dor&3", "ab1", "tokens")] == [1, 1, 1, 0]
    clean = {r["text"] for r in secret_scan.redact(docs, secret_scan.Scanner("", "1D")).collect()}
    assert {"password=[SECRET] x", "a password=[SECRET].", '[SECRET]="[SECRET]" z'} <= clean


def test_dictionary_counts_all_documents(spark):
    letters = lambda i: "w" + "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [(i, f"{letters(i)} copied") for i in range(2500)]
    assert set(secret_scan.dictionary_pattern(table(spark, rows), words=5000).split("|")) == {"copied", *(letters(i) for i in range(2500))}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    text = lambda: " ".join("".join(rng.choice(["the", "ing", "er", "on"]) for _ in range(rng.randint(1, 4))) for _ in range(80))
    passage, body = text(), text()
    rows = [(i, text(), "en") for i in range(40)] + [(50, body, "en"), (51, body, "en"), (60, f"{text()} {passage}", "en"), (61, f"{passage} {text()}", "en"), (70, None, "en"), (71, "12 34", "en")]
    rows += [(80 + i, " ".join(rng.choice(["und", "der", "sch", "ö"]) for _ in range(60)), "de") for i in range(20)]
    spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    assert {50, 60, 61} <= ids and not ids & {51, 70, 71} and set(range(40)) <= ids
    place = defaultdict(int)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == place[r["sequence_id"]]
        place[r["sequence_id"]] += r["length"]
    assert max(place.values()) <= 1024
    length = {d: sum(r["length"] for r in got if r["doc_id"] == d) for d in (60, 61)}
    assert length[61] < 0.75 * length[60]


def test_near_copies_leave_one_row(spark):
    import corpus_pipeline

    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i"), (4, "j k l"), (4, "m n o"), (5, None), (None, "x"), (None, "x"), (None, "y")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.join_near_copies(spark, docs, "").collect()]
    assert sorted(d for d, _ in got if d is not None) == [1, 3, 4, 5] and (1, "a b c d e f") in got
    assert sorted(t for d, t in got if d is None) == ["x", "y"]


def test_digest_of_kept_words(spark):
    row = superkmers.dedup_substrings(table(spark, [(1, "a  b\nc")])).select(F.sha2("kept_text", 256)).first()
    assert row[0] == hashlib.sha256(b"a b c").hexdigest()
