"""SentencePiece encoding with byte spans of the original text, and decoding.

The text is normalised by the model's compiled character map (a double array of
keys, of which the longest prefix is replaced, then the strings replacing them),
blanks are escaped and the dummy prefix is put in front as the model says; beside
each normalised byte stands the original byte that it begins at. The pieces then
part the normalised text, and their bounds are looked up there: piece i stands
for the bytes [offsets[i], offsets[i + 1]) of the UTF-8 text. A character spelt
by byte pieces belongs to the last of them; the others' spans are empty.

Segmentation is the library's, with a copy of the model that doesn't normalise.
Texts are cut before runs of characters that the map turns into one blank. As no
key of the map holds such a character beside others and no piece has a blank
after another character (else whole texts are normalised and segmented), such
chunks are normalised, aligned and segmented once and remembered.

The model is read on the driver and sent to the workers.

Defined cases: a null text gives nulls; an empty one gives no pieces and offsets
[0]. Long texts are encoded whole. Repeated rows are encoded alike. An empty
table gives no rows. Other columns are neither read nor returned. ``round_trip``
tells whether the decoded pieces are the text again; texts that hold the escape
character itself, or that the character map changes, decode to their normal form.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Words remembered by a worker.
REMEMBERED = 400_000
_BLANK = "▁"


def _varint(b: bytes, i: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        x = b[i]
        i += 1
        value |= (x & 127) << shift
        shift += 7
        if x < 128:
            return value, i


def _fields(b: bytes):
    """(number, wire type, value, raw bytes) of each field of a message."""
    i = 0
    while i < len(b):
        at = i
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            n = {1: 8, 5: 4}.get(kind)
            if n is None:
                n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        yield tag >> 3, kind, value, b[at:i]


def _message(number: int, payload: bytes) -> bytes:
    n, size = len(payload), b""
    while n > 127:
        size, n = size + bytes([n & 127 | 128]), n >> 7
    return bytes([number << 3 | 2]) + size + bytes([n]) + payload


class CharsMap:
    """The compiled character map: longest prefix of the input and what replaces it."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.strings = b""
        if blob:
            n = struct.unpack_from("<I", blob)[0]
            self.units = list(struct.unpack_from(f"<{n // 4}I", blob, 4))
            self.strings = blob[4 + n :]

    def prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        """(replacement, bytes consumed) at a place of the input."""
        best = None
        units, k = self.units, at
        if units:
            node = self._child_base(0)
            while k < len(data):
                c = data[k]
                node ^= c
                if node >= len(units) or units[node] & 0x800000FF != c:
                    break
                unit = units[node]
                k += 1
                node ^= (unit >> 10) << ((unit & 512) >> 6)
                if unit >> 8 & 1:
                    best = (units[node] & 0x7FFFFFFF, k)
        if best:
            end = self.strings.find(b"\0", best[0])
            return self.strings[best[0] : end], best[1] - at
        lead = data[at]
        n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + n], n

    def keys(self) -> list[bytes]:
        """All keys, by walking the double array."""
        out, todo = [], [(self._child_base(0), b"")] if self.units else []
        while todo:
            base, key = todo.pop()
            for c in range(256):
                node = base ^ c
                if c and node < len(self.units) and self.units[node] & 0x800000FF == c:
                    unit, longer = self.units[node], key + bytes([c])
                    if unit >> 8 & 1:
                        out.append(longer)
                    todo.append((node ^ ((unit >> 10) << ((unit & 512) >> 6)), longer))
        return out

    def _child_base(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 512) >> 6))


class Codec:
    def __init__(self, path_or_proto: str | bytes = MODEL):
        import sentencepiece

        proto = path_or_proto if isinstance(path_or_proto, bytes) else open(path_or_proto, "rb").read()
        self.pieces: list[bytes] = []
        kinds: list[int] = []
        blob, rest = b"", []
        self.dummy, self.squeeze, self.escape = True, True, True
        for number, _, value, raw in _fields(proto):
            if number == 1:
                own = {f: v for f, _, v, _ in _fields(value)}
                self.pieces.append(own.get(1, b""))
                kinds.append(own.get(3, 1))
            if number == 3:
                own = {f: v for f, _, v, _ in _fields(value)}
                blob = own.get(2, b"")
                self.dummy, self.squeeze, self.escape = bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
            elif number != 5:
                rest.append(raw)
        self.map = CharsMap(blob)
        plain = _message(1, b"identity") + bytes([3 << 3, 0, 4 << 3, 0, 5 << 3, 0])
        self.inner = sentencepiece.SentencePieceProcessor()
        self.inner.LoadFromSerializedProto(b"".join(rest) + _message(3, plain))
        self.unknown = kinds.index(2) if 2 in kinds else -1
        blank = _BLANK.encode()
        self.whole = not self.escape or any(blank in p.lstrip(blank) for p, k in zip(self.pieces, kinds) if k in (1, 4))
        self.byte = {i: int(p[3:5], 16) for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == 6}
        self.no_byte = frozenset(self.byte).isdisjoint
        self.surface = [bytes([self.byte[i]]) if i in self.byte else b"" if kinds[i] == 3 else p.replace(blank, b" ") if self.escape else p for i, p in enumerate(self.pieces)]
        if self.unknown >= 0:
            self.surface[self.unknown] = " ⁇ ".encode()
        self.lengths = [len(p) for p in self.pieces]
        self.memory: dict[str, tuple[bytes, bytes, int]] = {}
        keys = {k: self.map.prefix(k, 0)[0] for k in self.map.keys()}
        first = {k.decode("utf-8", "replace")[:1] for k in keys} - {" "}
        self.touched = re.compile(f"[{re.escape(''.join(sorted(first)))}]" if first else r"(?!)")
        alone = {k.decode("utf-8", "replace") for k, v in keys.items() if v == b" "} | {" "}
        self.blanks = {c for c in alone if len(c) == 1 and (c != " " or keys.get(b" ", b" ") == b" ")}
        held = re.compile(f"[{re.escape(''.join(sorted(self.blanks)))}]") if self.blanks else None
        self.whole = self.whole or held is None or any(len(k) > 1 and len(t := k.decode("utf-8", "replace")) > 1 and held.search(t) for k in keys)
        if not self.whole:
            own = re.escape("".join(sorted(self.blanks)))
            self.chunk, self.lead = re.compile(f"[{own}]*[^{own}]+|[{own}]+"), re.compile(f"[{own}]+")

    def expand(self, text: str, squeeze: bool) -> tuple[bytearray, list[int], int]:
        """The mapped bytes with blanks escaped, the original byte of each, and the original size; nothing is put in front or cut off."""
        data, out, origin = text.encode("utf-8", "replace"), bytearray(), []
        blank, at, after = _BLANK.encode() if self.escape else b" ", 0, False
        while at < len(data):
            sp, n = self.map.prefix(data, at)
            while after and sp[:1] == b" ":
                sp = sp[1:]
            if sp:
                for c in sp:
                    put = blank if c == 32 else bytes([c])
                    out += put
                    origin += [at] * len(put)
                after = squeeze and sp[-1:] == b" "
            at += n
        return out, origin, at

    def normalise(self, text: str) -> tuple[bytes, list[int]]:
        """The normalised bytes, and for each of them, and the end, the original byte."""
        data, out, origin = text.encode("utf-8", "replace"), bytearray(), []
        blank, at = _BLANK.encode() if self.escape else b" ", 0
        if self.squeeze:
            while at < len(data):
                sp, n = self.map.prefix(data, at)
                if sp != b" ":
                    break
                at += n
        if at == len(data):
            return b"", [at] if data else [0]
        if self.dummy:
            out += blank
            origin += [at] * len(blank)
        after = self.squeeze
        while at < len(data):
            sp, n = self.map.prefix(data, at)
            while after and sp[:1] == b" ":
                sp = sp[1:]
            if sp:
                for c in sp:
                    put = blank if c == 32 else bytes([c])
                    out += put
                    origin += [at] * len(put)
                after = self.squeeze and sp[-1:] == b" "
            at += n
        if self.squeeze:
            while out.endswith(blank):
                del out[-len(blank) :]
                at = origin[len(out)]
                del origin[len(out) :]
        return bytes(out), origin + [at]

    def _sizes(self, ids: list[int], chunk: str) -> list[int]:
        """Normalised bytes of each piece; of a spelt character all are the last one's."""
        if self.unknown in ids:
            names = self.inner.encode(chunk, out_type=str)
            return [len(self.pieces[i]) if i != self.unknown else len(s.encode()) for i, s in zip(ids, names)]
        if self.no_byte(ids):
            return [self.lengths[i] for i in ids]
        sizes, left = [], 0
        for i in ids:
            if i not in self.byte:
                sizes.append(self.lengths[i])
                continue
            if not left:
                b = self.byte[i]
                left = whole = 1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            left -= 1
            sizes.append(0 if left else whole)
        return sizes

    def _learn(self, chunks: list[str]) -> None:
        """Remember each chunk's ids, the original bytes that its pieces begin at, and its size; one that its neighbours may change at its edges has size -1."""
        blank = _BLANK.encode()
        plain = [self._plain(c) for c in chunks]
        mapped = [None if n else self.expand(c, self.squeeze) for n, c in zip(plain, chunks)]
        norms = [n or m[0].decode("utf-8", "replace") for n, m in zip(plain, mapped)]
        for chunk, norm, easy, there, ids in zip(chunks, norms, plain, mapped, self.inner.encode(norms, out_type=int, num_threads=1)):
            starts = list(accumulate(self._sizes(ids, norm)[:-1], initial=0)) if ids else []
            if easy:  # the one escaped blank in front has three bytes for the original's one
                self.memory[chunk] = (array("i", ids).tobytes(), array("i", [k and k - 2 for k in starts]).tobytes(), len(chunk.encode()))
                continue
            out, origin, end = there
            odd = not out or out.endswith(blank) and (self.squeeze or not self.lead.fullmatch(chunk)) or self.squeeze and not self.lead.match(chunk) and out.startswith(blank)
            self.memory[chunk] = (array("i", ids).tobytes(), array("i", [origin[k] for k in starts]).tobytes(), -1 if odd else end)

    def _plain(self, chunk: str) -> str | None:
        """The normalised form of a blank and a word that hold nothing else to map."""
        if chunk[0] == " " and len(chunk) > 1 and self.escape and not self.touched.search(chunk) and chunk.rfind(" ") == 0 and _BLANK not in chunk:
            return _BLANK + chunk[1:]
        return None

    def _chunks(self, text: str) -> tuple[list[str], int]:
        """The text's chunks, the dummy prefix put in front, and how many bytes come before them."""
        front = 0
        if self.squeeze:
            m = self.lead.match(text)
            if m:
                front, text = len(m[0].encode()), text[m.end() :]
            text = text.rstrip("".join(self.blanks))
        return self.chunk.findall(" " + text if self.dummy and text else text), front

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """(ids, offsets) of each text."""
        out: list = [None] * len(texts)
        parts: dict[int, tuple[list[str], int]] = {}
        for i, t in enumerate(texts):
            if t is None:
                continue
            if not t:
                out[i] = (np.zeros(0, np.int32), np.zeros(1, np.int32))
            elif self.whole:
                out[i] = self.slow(t)
            else:
                parts[i] = self._chunks(t)
        missing = list({c for p in parts.values() for c in p[0]}.difference(self.memory))
        held: dict = {}
        if missing:
            if len(self.memory) + len(missing) > REMEMBERED:
                held, self.memory = self.memory, {}
            self._learn(missing)
        known = self.memory
        for i, (chunks, front) in parts.items():
            got = [known.get(c) or held[c] for c in chunks] if held else [known[c] for c in chunks]
            ends = np.array([g[2] for g in got], np.int64)
            if not chunks or ends.min() < 0:
                out[i] = self.slow(texts[i])
                continue
            ids = np.frombuffer(b"".join([g[0] for g in got]), np.int32)
            begins = np.cumsum(ends) - ends
            offsets = np.empty(len(ids) + 1, np.int32)
            offsets[:-1] = np.frombuffer(b"".join([g[1] for g in got]), np.int32) + np.repeat(begins, [len(g[0]) // 4 for g in got])
            offsets[-1] = ends.sum()
            if self.dummy:  # which isn't there
                offsets = np.maximum(offsets - 1, 0)
            out[i] = (ids, offsets + np.int32(front))
        return out

    def slow(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The same by the whole normalised text and its alignment."""
        data, origin = self.normalise(text)
        norm = data.decode("utf-8", "replace")
        ids = self.inner.encode(norm, out_type=int)
        ends = np.cumsum([0, *self._sizes(ids, norm)])
        return np.array(ids, np.int32), np.array(origin, np.int32)[ends]

    def decode(self, ids: list[int]) -> str:
        surface = self.surface
        data = b"".join([surface[i] for i in ids])
        if self.dummy and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


_codecs: dict[bytes, Codec] = {}


def codec(model: str | bytes = MODEL) -> Codec:
    """The codec of a path or a serialised model, made once in each process."""
    proto = model if isinstance(model, bytes) else open(model, "rb").read()
    mark = hashlib.sha256(proto).digest()
    if mark not in _codecs:
        _codecs[mark] = Codec(proto)
    return _codecs[mark]


def _lists(parts: list, kind: pa.DataType) -> pa.Array:
    bounds = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([0 if p is None else len(p) for p in parts], out=bounds[1:])
    some = [p for p in parts if p is not None]
    values = pa.array(np.concatenate(some) if some else np.zeros(0, np.int32), kind)
    none = pa.array([p is None for p in parts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(bounds), values, mask=none)


def _sent(spark: SparkSession, model: str | bytes):
    return spark.sparkContext.broadcast(model if isinstance(model, bytes) else open(model, "rb").read())


def encode(docs: DataFrame, model: str | bytes = MODEL) -> DataFrame:
    """(doc_id, ids, offsets, n_pieces, round_trip) of each row."""
    sent = _sent(docs.sparkSession, model)

    def run(batches):
        own = codec(sent.value)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = part.column("text").to_pylist()
                got = own.encode(texts)
                ids, offsets = [g and g[0] for g in got], [g and g[1] for g in got]
                back = [None if g is None else own.decode(g[0].tolist()) == t for g, t in zip(got, texts)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(ids, pa.int32()), _lists(offsets, pa.int32()), pa.array([None if g is None else len(g[0]) for g in got], pa.int32()), pa.array(back, pa.bool_())], ["doc_id", "ids", "offsets", "n_pieces", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, offsets array<int>, n_pieces int, round_trip boolean")


def decode(encoded: DataFrame, model: str | bytes = MODEL) -> DataFrame:
    """(doc_id, text) of rows with ids; null ids give a null text."""
    sent = _sent(encoded.sparkSession, model)

    def run(batches):
        own = codec(sent.value)
        for batch in batches:
            texts = [None if i is None else own.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and byte spans of every document."""
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"op9_sentencepiece_spans": op9}
SQL: dict[str, str] = {}
