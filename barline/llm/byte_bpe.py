"""Byte-level BPE: encoding and decoding with the tokenizers library over Arrow batches (operator 5).

The pattern that splits a text before the merges never lets a piece run from a visible character into white
space, nor from an ASCII letter into a mark that stands alone behind it. So a text can be cut in front of every run of
white space and of such marks, and each cut has the ids it would have inside the text. A batch finds its distinct cuts
by 64-bit hashes of their bytes, the library encodes those that the worker has not met, and ids are strung together
by one gather. Texts with white space beyond ASCII are encoded whole.

Null texts are empty texts: no ids. Texts of any length are read whole. Repeated rows give repeated rows. An empty table
gives no rows. Other columns of the input are kept; those that have the name of a new one are replaced.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._session import bounded_batches
from ._words import SPACE, released, slices, spans, strings, utf8

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Marks that are a piece of their own between an ASCII letter and white space.
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
#: White space of the pattern (Unicode White_Space) beyond ASCII.
_WIDE = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Cuts whose ids a worker remembers at most (about 40 bytes each), and bytes of text that are encoded together.
_KEEP, _TOGETHER = 1 << 19, 1 << 20


def default_paths() -> tuple[str, str]:
    """The vocabulary for the tokenizers library, and the same one as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in table)
    return table | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Codec:
    """Encodes texts with a vocabulary of the tokenizers library and decodes ids by the reversed byte table."""

    def __init__(self, path: str, ranks: str | None = None, special: bool = False):
        """``special``: the vocabulary's special tokens stand for themselves where a text holds them."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        back = {c: b for b, c in byte_characters().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        pieces: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            pieces[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        if ranks:
            with open(ranks, "rb") as lines:
                wanted = {int(k): base64.b64decode(b) for b, k in (line.split() for line in lines if line.strip())}
            wrong = [k for k, b in wanted.items() if k >= len(pieces) or pieces[k] != b]
            if wrong:
                raise ValueError(f"{path} and {ranks} differ in {len(wrong)} ids")
        self.pieces = pieces
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.place = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.merges = Tokenizer(self.tokenizer.model)  # without the pattern: lines are pieces
        self.merges.pre_tokenizer = CharDelimiterSplit("\n")
        self.shown = byte_characters() | {10: "\n"}
        # what is known of cuts: sorted hashes, where their ids begin and how many they are, when they were last met
        self.hashes, self.begin, self.count, self.met = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.now = np.zeros(0, np.uint32), 0

    def _cut_ids(self, texts: list[str], ids: np.ndarray) -> list[bytes]:
        """Ids of joined texts, dealt back: ids cover whole texts, so byte lengths tell where each text's end."""
        ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(t.encode()) for t in texts])) + 1
        raw, at, out = ids.tobytes(), 0, []
        for end in (4 * ends).tolist():
            out.append(raw[at:end])
            at = end
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of strings that are one piece of the pattern each (no line feed in them): merges only."""
        out = []
        for first in range(0, len(pieces), 4096):
            part = pieces[first : first + 4096]
            line = "\n".join(part).encode().decode("latin-1").translate(self.shown)
            out += self._cut_ids(part, np.array(self.merges.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4"))
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, cuts: list[str]) -> list[bytes]:
        """The ids of cuts. Letters, after a space or not, are one piece; cuts that begin with white space and end
        with a visible character don't touch their neighbours, so that many are encoded as one text."""
        out: list[bytes] = [b""] * len(cuts)
        letters, joined, alone = [], [], []
        for k, c in enumerate(cuts):
            (letters if (c[1:] if c[0] == " " else c).isalpha() else joined if c[0] in " \t\n\v\f\r" and c[-1] not in " \t\n\v\f\r" else alone).append(k)
        for k, found in zip(letters, self._pieces([cuts[k] for k in letters]), strict=True):
            out[k] = found
        for k, found in zip(alone, self._whole([cuts[k] for k in alone]), strict=True):
            out[k] = found
        for first in range(0, len(joined), 512):
            part = joined[first : first + 512]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(cuts[k] for k in part)], add_special_tokens=False)[0].ids, "<u4")
            for k, found in zip(part, self._cut_ids([cuts[k] for k in part], ids), strict=True):
                out[k] = found
        return out

    def _remember(self, hashes: np.ndarray, found: list[bytes]) -> None:
        if len(self.hashes) + len(hashes) > _KEEP:  # the half that was met longest ago goes
            use = np.flatnonzero(self.met > np.median(self.met))
            count = self.count[use]
            begin = np.cumsum(count) - count
            self.ids = self.ids[np.arange(count.sum()) + np.repeat(self.begin[use] - begin, count)]
            self.hashes, self.begin, self.count, self.met = self.hashes[use], begin, count, self.met[use]
        count = np.fromiter(map(len, found), np.int32, len(found)) // 4
        begin = np.cumsum(count) - count + len(self.ids)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")])
        order = np.argsort(h := np.concatenate([self.hashes, hashes]))
        self.hashes = h[order]
        self.begin, self.count = np.concatenate([self.begin, begin])[order], np.concatenate([self.count, count])[order]
        self.met = np.concatenate([self.met, np.full(len(hashes), self.now, np.int32)])[order]

    def _encode_cuts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, places = utf8(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(places), np.int64)
        space, edge = SPACE[data], np.zeros(len(data) + 1, bool)
        edge[places] = True
        ends = np.append(space[1:], True) | edge[1:]  # white space or the text's end comes next
        start = edge[:-1].copy()
        start[1:] |= (space[1:] & ~space[:-1]) | (_MARK[data[1:]] & _LETTER[data[:-1]] & ends[1:])
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(data))
        u, at, which = np.unique(spans(data, begin, end), return_index=True, return_inverse=True)
        self.now += 1
        place = np.searchsorted(self.hashes, u)
        new = np.ones(len(u), bool)
        inside = np.flatnonzero(place < len(self.hashes))
        new[inside] = self.hashes[place[inside]] != u[inside]
        if new.any():
            self.met[place[~new]] = self.now
            raw = data.tobytes()
            self._remember(u[new], self._learn([raw[a:b].decode() for a, b in zip(begin[at[new]].tolist(), end[at[new]].tolist(), strict=True)]))
            place = np.searchsorted(self.hashes, u)
        self.met[place] = self.now
        of = place[which]
        count = self.count[of].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.begin[of] - total[:-1], count)]
        return ids, total[np.searchsorted(begin, places)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column (null: none), and the n + 1 places where texts begin and end."""
        column = column.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(column, _WIDE)
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(column, token))
        if not pc.any(odd).as_py():
            return self._encode_cuts(column)
        odd = odd.to_numpy(zero_copy_only=False)
        ids, places = self._encode_cuts(pc.if_else(pa.array(odd), "", column))
        whole = self._whole([column[i].as_py() for i in np.flatnonzero(odd).tolist()])
        count = np.diff(places)
        parts = np.split(ids, places[np.flatnonzero(odd)])  # the ids of the others up to each of these
        out = [x for pair in zip(parts, [np.frombuffer(w, "<u4") for w in whole]) for x in pair] + [parts[-1]]
        count[odd] = [len(w) // 4 for w in whole]
        return np.concatenate(out).astype(np.uint32), np.concatenate([[0], np.cumsum(count)])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: a gather over the vocabulary's bytes. A character split over ids comes back whole."""
        ids = np.asarray(ids, np.int64)
        size = self.size[ids]
        ends = np.cumsum(size)
        if len(ids) == 0:
            return b""
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.place[ids] - ends + size, size)].tobytes()

    def offsets(self, text: str, ids: np.ndarray) -> list[tuple[int, int]]:
        """Where each id's characters begin and end in ``text``. An id that holds part of a character spans all of it."""
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        ends = np.cumsum(self.size[np.asarray(ids, np.int64)])
        begins = ends - self.size[np.asarray(ids, np.int64)]
        return [(int(char[b]), int(char[e - 1]) + 1) for b, e in zip(begins, ends, strict=True)]


@functools.lru_cache(maxsize=2)
def codec(path: str, ranks: str | None = None, special: bool = False) -> Codec:
    return Codec(path, ranks, special)


def encode(docs: DataFrame, text: str = "text", path: str | None = None, ranks: str | None = None, ids: str = "ids", offsets: str | None = None) -> DataFrame:
    """``docs`` with the column ``ids`` (binary, little-endian unsigned 32-bit) and, if named, ``offsets``.

    A column that has one of these names already is replaced. ``offsets`` is an array of (begin, end) in
    characters of the text.
    """
    bounded_batches(docs.sparkSession)
    own = default_paths()
    path, ranks = path or own[0], ranks or (own[1] if path is None else None)
    made = [ids, *([offsets] if offsets else [])]
    base = docs.drop(*made)
    schema = T.StructType([*base.schema.fields, T.StructField(ids, T.BinaryType())])
    if offsets:
        schema = schema.add(offsets, T.ArrayType(T.StructType().add("begin", T.IntegerType()).add("end", T.IntegerType())))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, ranks)
        for whole in batches:
            for batch in slices(whole, text, _TOGETHER):
                column = batch.column(batch.schema.get_field_index(text))
                found, places = use.encode(column)
                columns = [*batch.columns, strings(found.view(np.uint8), 4 * places).cast(pa.binary())]
                if offsets:
                    texts = [t or "" for t in column.to_pylist()]
                    shown = [[{"begin": x, "end": y} for x, y in use.offsets(t, found[a:b])] for t, a, b in zip(texts, places[:-1], places[1:], strict=True)]
                    columns.append(pa.array(shown, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *made])

    return base.mapInArrow(run, schema)


def decode(tokens: DataFrame, ids: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes that its ids stand for (binary). Null ids give null, no ids give no bytes."""
    path = path or default_paths()[0]
    base = tokens.drop(out)
    schema = T.StructType([*base.schema.fields, T.StructField(out, T.BinaryType())])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path)
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            found = [None if r is None else use.decode(np.frombuffer(r, "<u4")) for r in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, out])

    return base.mapInArrow(run, schema)


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded again, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = decode(encode(docs).drop("text"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
