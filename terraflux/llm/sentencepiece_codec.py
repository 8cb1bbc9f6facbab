"""SentencePiece BPE encoding and decoding that keeps byte offsets.

A text is normalised by longest prefix through the model's compiled character
map (a double-array trie over UTF-8 bytes, followed by the replacements), and
for each normalised byte the source byte is recorded, so that every piece can be
projected to a span of the original bytes. Merging follows the model's scores,
the leftmost pair first among equals; characters without a piece become byte
pieces.

No piece of the usual vocabularies has a space mark after another character.
Where that holds (checked on loading), no merge crosses the start of a run of
space marks, so a text falls apart into chunks, and a worker encodes each chunk
of characters once and keeps it in a table of bounded size. Elsewhere the whole
text is one chunk.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from pathlib import Path
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, map_rows, table, texts

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_LINE_CHUNK = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
#: Chunks that a worker keeps, about 230 bytes each.
_CACHE = 500_000


def _fields(data: bytes):
    """(number, value) of a protobuf message: int for varints, bytes for the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + n]
            at += n


class CharacterMap:
    """Longest-prefix replacement by a compiled character map; an empty one changes nothing."""

    def __init__(self, blob: bytes = b""):
        size = int.from_bytes(blob[:4], "little") if len(blob) > 4 else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at``, and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.pool.index(b"\0", found[1])
        return found[0], self.pool[found[1] : end]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


def _char_length(first: int) -> int:
    return 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


@dataclass
class Codec:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    chars: CharacterMap
    dummy_prefix: bool = True
    squeeze: bool = True
    byte_fallback: bool = False
    splits: bool = False
    cut: re.Pattern = _CHUNK
    merges: dict[str, float] = field(default_factory=dict)
    ids: dict[str, int] = field(default_factory=dict)

    @classmethod
    def load(cls, model: bytes) -> Codec:
        pieces, scores, kinds, norm, trainer = [], [], [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                x = dict(_fields(value))
                pieces.append(x[1].decode())
                scores.append(float(np.frombuffer(x.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(x.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("only BPE models are read")
        if trainer.get(24, 0) or not norm.get(5, 1) or USER_DEFINED in kinds or UNUSED in kinds:
            raise ValueError("suffix space marks, unescaped spaces, user-defined and unused pieces aren't supported")
        c = cls(pieces, scores, kinds, CharacterMap(norm.get(2, b"")), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(trainer.get(35, 0)))
        c.ids = {p: i for i, p in enumerate(pieces) if kinds[i] == NORMAL}
        c.merges = {p: scores[i] for p, i in c.ids.items()}
        c.unknown = kinds.index(UNKNOWN)
        c.begin, c.end = pieces.index("<s>"), pieces.index("</s>")
        c.byte_ids = [pieces.index(f"<0x{b:02X}>") for b in range(256)] if c.byte_fallback else []
        c.splits = not any(MARK in p.lstrip(MARK) for p in c.ids)
        # a line's end that no longer piece holds stands alone, where it can't join other unknown characters
        c.cut = _LINE_CHUNK if c.byte_fallback and not any("\n" in p and len(p) > 1 for p in c.ids) else _CHUNK
        return c

    # normalisation

    def aligned(self, text: str) -> tuple[str, list[int]]:
        """The normalised text, and for each of its characters the byte of the source where its
        own began; one more entry holds the end."""
        norm, origin = self.aligned_array(text)
        return norm, origin.tolist()

    def aligned_array(self, text: str) -> tuple[str, np.ndarray]:
        """``aligned`` with the bytes as an array."""
        data = text.encode("utf-8", "surrogatepass")
        if not self.chars.units and not self.squeeze and b"\xed" not in data:  # each character stands for itself; ED starts any surrogate
            starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80).astype(np.int64)
            prefix = self.dummy_prefix and bool(text)
            return (MARK if prefix else "") + text.replace(" ", MARK), np.concatenate([starts[:1] if prefix else starts[:0], starts, [len(data)]])
        out: list[str] = []
        origin: list[int] = []
        at, space = 0, self.squeeze  # leading spaces go
        while at < len(data):
            got = self.chars.longest(data, at)
            n = got[0] if got else _char_length(data[at])
            to = (got[1] if got else data[at : at + n]).decode("utf-8", "replace")
            for ch in to:
                ch = MARK if ch == " " else ch
                if self.squeeze and ch == MARK and space:
                    continue
                space = ch == MARK
                out.append(ch)
                origin.append(at)
            at += n
        end = at
        while self.squeeze and out and out[-1] == MARK:
            out.pop()
            end = origin.pop()
        if self.dummy_prefix and out:
            out.insert(0, MARK)
            origin.insert(0, origin[0])
        return "".join(out), np.array([*origin, end], np.int64)

    # merging

    def _merge(self, chunk: str) -> list[str]:
        merges = self.merges
        s = list(chunk)
        if len(s) <= 32:
            none = float("-inf")
            found = [merges.get(a + b, none) for a, b in zip(s, s[1:])]  # of each pair
            while found and (best := max(found)) > none:
                i = found.index(best)
                s[i : i + 2] = [s[i] + s[i + 1]]
                del found[i]
                if i:
                    found[i - 1] = merges.get(s[i - 1] + s[i], none)
                if i < len(found):
                    found[i] = merges.get(s[i] + s[i + 1], none)
            return s
        left, right = list(range(-1, len(s) - 1)), [*range(1, len(s)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (score := merges.get(s[i] + s[j])) is not None:
                heap.append((-score, i, j, s[i] + s[j])) if not ready else heapq.heappush(heap, (-score, i, j, s[i] + s[j]))

        ready = False
        for i in range(len(s)):
            offer(i)
        heapq.heapify(heap)
        ready = True
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if not s[i] or right[i] != j or s[i] + s[j] != joined:
                continue
            s[i], s[j] = joined, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [x for x in s if x]

    def chunks(self, normalised: str) -> list[str]:
        return self.cut.findall(normalised) if self.splits else [normalised] if normalised else []

    def chunk_pieces(self, chunk: str) -> list[tuple[int, int]]:
        """(id, characters) of a chunk; of a character's byte pieces the last counts its character."""
        out: list[tuple[int, int]] = []
        for piece in self._merge(chunk):
            if (i := self.ids.get(piece)) is not None:
                out.append((i, len(piece)))
            elif self.byte_fallback:
                b = piece.encode("utf-8", "surrogatepass")
                out += [(self.byte_ids[x], 0) for x in b[:-1]] + [(self.byte_ids[b[-1]], 1)]
            elif out and out[-1][0] == self.unknown:
                out[-1] = (self.unknown, out[-1][1] + len(piece))
            else:
                out.append((self.unknown, len(piece)))
        return out

    def encode(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first byte, end byte) of every piece, without begin and end ids. Of a character's
        byte pieces the last has its span, those before it an empty one."""
        norm, origin = self.aligned(text)
        out, at = [], 0
        for chunk in self.chunks(norm):
            for i, n in self.chunk_pieces(chunk):
                out.append((i, origin[at], origin[at + n]))
                at += n
        return out

    # decoding

    def _decode(self, ids: list[int]) -> bytes:
        out, raw = [], bytearray()
        for i in ids:
            if self.kinds[i] == BYTE:
                raw.append(int(self.pieces[i][3:5], 16))
                continue
            if raw:
                out.append(_lossy(bytes(raw)))
                raw.clear()
            if self.kinds[i] == UNKNOWN:
                out.append(" ⁇ ".encode())
            elif self.kinds[i] != CONTROL:
                out.append(self.pieces[i].replace(MARK, " ").encode("utf-8", "surrogatepass"))
        if raw:
            out.append(_lossy(bytes(raw)))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return self._trim(self._decode(ids)).decode("utf-8", "surrogatepass")

    def _trim(self, data: bytes) -> bytes:
        """Without the space of the dummy prefix."""
        return data[1:] if (self.dummy_prefix or self.squeeze) and data[:1] == b" " else data


def _lossy(raw: bytes) -> bytes:
    """Byte pieces as text: each byte that is no part of a character becomes U+FFFD."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        n = _char_length(raw[at])
        try:
            raw[at : at + n].decode()
        except UnicodeDecodeError:
            out.append("�".encode())
            at += 1
            continue
        out.append(raw[at : at + n])
        at += n
    return b"".join(out)


class _Chunks(dict):
    """chunk -> its pieces as little-endian 64-bit integers: the id, and above it the number of characters."""

    def __init__(self, codec: Codec):
        self.codec = codec
        plain = [k not in (BYTE, UNKNOWN, CONTROL) for k in codec.kinds]
        self.special = ~np.array(plain, bool)
        self.texts = [p.replace(MARK, " ").encode("utf-8", "surrogatepass") for p in codec.pieces]

    def __missing__(self, chunk: str) -> bytes:
        pieces = self.codec.chunk_pieces(chunk)
        got = pack(f"<{len(pieces)}Q", *[i | n << 32 for i, n in pieces])
        if len(chunk) < 64:
            if len(self) >= _CACHE:  # those that came first are mostly frequent
                kept = list(islice(self.items(), _CACHE // 4))
                self.clear()
                self.update(kept)
            self[chunk] = got
        return got

    def pieces(self, norm: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of characters of a normalised text's pieces."""
        both = np.frombuffer(b"".join(map(self.__getitem__, self.codec.chunks(norm))), "<u8")
        return (both & np.uint64(0xFFFFFFFF)).astype(np.int32), (both >> np.uint64(32)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: runs of ordinary pieces by table, others by the codec."""
        special, plain = self.special[ids], ids.tolist()
        if special.any():
            cuts = [0, *(np.flatnonzero(special[1:] != special[:-1]) + 1).tolist(), len(plain)]
            data = b"".join(self.codec._decode(plain[a:b]) if special[a] else b"".join(map(self.texts.__getitem__, plain[a:b])) for a, b in zip(cuts, cuts[1:]))
        else:
            data = b"".join(map(self.texts.__getitem__, plain))
        return self.codec._trim(data).decode("utf-8", "surrogatepass")


_WORKER: dict[bytes, _Chunks] = {}


def _worker_chunks(model: bytes) -> _Chunks:
    """The table of the last model, which a worker process keeps from task to task."""
    key = hashlib.sha256(model).digest()
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = _Chunks(Codec.load(model))
    return _WORKER[key]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, *, model_path: str | None = None) -> DataFrame:
    """Pieces and spans of every row of docs (doc_id, text).

    Returns doc_id, ids, begins, ends (arrays; byte offsets into the text's UTF-8)
    and decoded. Begin and end ids are included, with empty spans at the text's
    ends. A null or empty text has only those two and decodes to "". Repeated
    rows are each returned, an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    model = Path(model_path or default_model()).read_bytes()

    def make():
        known = _worker_chunks(model)
        codec = known.codec

        def step(cols: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": cols["doc_id"], "ids": [], "begins": [], "ends": [], "decoded": []}
            for t in cols["text"]:
                norm, origin = codec.aligned_array(t or "")
                ids, sizes = known.pieces(norm)
                span = origin[np.append(0, np.cumsum(sizes))].astype(np.int32)  # by characters before each piece
                size = np.int32(len((t or "").encode("utf-8", "surrogatepass")))
                out["ids"].append(np.concatenate([[np.int32(codec.begin)], ids, [np.int32(codec.end)]]))
                out["begins"].append(np.concatenate([[np.int32(0)], span[:-1], [size]]))
                out["ends"].append(np.concatenate([[np.int32(0)], span[1:], [size]]))
                out["decoded"].append(known.decode(ids))
            return out

        return step

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), f"doc_id {id_type}, ids array<int>, begins array<int>, ends array<int>, decoded string", make)


def digests(docs: DataFrame, *, model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``encode``'s output. Null
    and empty texts, repeated rows and empty tables as there."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            cut, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
            hashed = [hashlib.sha256(flat[x:y].tobytes()).hexdigest() for x, y in zip(cut[:-1], cut[1:], strict=True)]
            decoded = [hashlib.sha256(x).hexdigest() for x in b.column("decoded").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(cut), pa.int64()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(docs, model_path=model_path).mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(texts(table(spark, sf_dir, "documents")))
