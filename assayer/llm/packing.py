"""Packing of documents into token windows by the sum-of-squares rule.

Every partition packs its documents as they come.  A level array counts the partly filled windows at each
fill.  A document goes to the fill level whose choice leaves the smallest sum of squared counts: moving a
window from fill h to h + s changes the sum by 2 * (N[h + s] - N[h] + 1) (nothing is counted at a full
window), and opening one at s changes it by 2 * N[s] + 1.  Ties take the fullest window, then the one that
was opened first.  Documents longer than a window fill whole windows first; their rest is placed by the rule.

When a partition ends, windows that are still partly filled are closed by the same rule.  The emptiest is dissolved
and its pieces are placed anew among the others, where a piece may also be cut: completing a window of fill h changes
the sum by 1 - 2 * N[h], and what is left of the piece is placed next.  No window is opened while another is open, so
every round leaves one window less and a partition pads one window at most.

Tokens: the text's ids, then the end id.  Null texts count as empty.  No column but id and text is read (ids keep their
type), repeated rows are packed each by itself, and an empty table gives an empty result.  A text's ids are those of
the tokenizer over the whole text.  Tokenizers that lower-case, split at blanks and drop them, as ``KNOWN`` describes,
never join across blanks: there, parts between blanks are encoded once per worker and kept in bounded tables, which
are let go when a worker has packed nothing for a while.  Any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import ctypes
import gc
import json
import re
import threading
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, END = 4096, 2
#: Entries of each of two generations of a worker's tables: runs between blanks, and words, which cost more to encode.
CHUNKS, PARTS = 320_000, 320_000
#: Seconds after a partition's end until an idle worker's tables go; other stages' tasks run in the same workers.
IDLE = 5.0

COLUMNS = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def pieces_schema(id_type: T.DataType) -> T.StructType:
    kinds = {"doc_id": id_type, "ids": T.BinaryType()}
    return T.StructType([T.StructField(name, kinds.get(name, T.LongType())) for name in COLUMNS])


#: Settings, from a tokenizer's file, under which parts between blanks may be encoded by themselves (fixed values).
KNOWN = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

#: Letters whose lower case and normal form are plain: ASCII and Latin letters up to U+017F but for U+0130.
_PLAIN = re.compile("[\\x21-\\x7eÀ-įı-ſ]+")
#: Fixed pattern of this vocabulary's pre-tokenizer, for plain characters.
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|[^\sa-z0-9ß-öø-ſ]+")


def byte_letters() -> dict[int, str]:
    """Byte to printable letter, as byte-level vocabularies have it: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Table(dict):
    """Encoded parts by text.  A full table becomes the old one; what is used again moves back from there."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, text: str) -> bytes:
        found = self.old.get(text)
        if found is None:
            found = self.encode(text)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[text] = found
        return found


class Encoder:
    """Little-endian 32-bit ids of whole texts; by parts between blanks where the tokenizer's settings are ``KNOWN``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        settings = json.loads(Path(path).read_text(encoding="utf-8"))
        model = settings.get("model") or {}
        plain = all(not settings.get(x) for x in ("truncation", "padding")) and model.get("type") == "BPE" and not model.get("dropout")
        added = all(t.get("special") and not t.get("lstrip") and not t.get("rstrip") and "<|" in t["content"] for t in settings.get("added_tokens") or [])
        self.by_parts = plain and added and all(settings.get(k) == v for k, v in KNOWN.items())
        self.tokenizer, self.letters = Tokenizer.from_file(path), byte_letters()
        self.split = self.tokenizer.model.tokenize
        self.bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.chunks, self.parts = _Table(self.chunk, CHUNKS), _Table(self.part, PARTS)

    def part(self, text: str) -> bytes:
        raw, ids = text if text.isascii() else "".join(map(self.letters.__getitem__, text.encode())), self.bytes
        return b"".join([ids[x.id] for x in self.split(raw)])

    def chunk(self, text: str) -> bytes:
        if text.isascii() and text.isalpha():
            return self.parts[text.lower()]
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.parts.__getitem__, _PART.findall(text.lower())))
        return self.whole(text)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_parts:
            return self.whole(text)
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


_encoders: dict[str, Encoder] = {}
_leaving: list[threading.Timer] = []


def encoder(path: str) -> Encoder:
    while _leaving:
        _leaving.pop().cancel()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _release() -> None:
    """Drops the worker's encoders and gives their memory back to the system where the C library can."""
    _encoders.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def release_later(seconds: float) -> None:
    timer = threading.Timer(seconds, _release)
    timer.daemon = True
    _leaving.append(timer)
    timer.start()


class Packer:
    """Sum-of-squares packing of one partition; ``add`` and ``close`` yield finished windows as lists of pieces."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.level = np.zeros(window + 1, np.int64)
        self.open: list[deque[list]] = [deque() for _ in range(window)]

    def choose(self, size: int) -> int:
        """The fill to put ``size`` more on; 0 opens a window."""
        best, rise = self.fitting(size)
        new = 2 * self.level[size] + 1 if size < self.window else 0
        return best if rise <= new else 0

    def fitting(self, size: int) -> tuple[int, int]:
        """The best fill of an open window that has room for ``size`` more, and by how much the sum rises."""
        last = self.window - size
        at = np.flatnonzero(self.level[1 : last + 1])
        if not len(at):
            return 0, 1 << 40
        rise = 2 * (self.level[at + 1 + size] - self.level[at + 1] + 1)
        if at[-1] + 1 == last:
            rise[-1] -= 1
        best = len(rise) - 1 - int(np.argmin(rise[::-1]))
        return int(at[best]) + 1, int(rise[best])

    def cutting(self, size: int) -> tuple[int, int]:
        """The best fill of an open window that a part of ``size`` completes, the fullest first, and the sum's rise."""
        low = self.window - size + 1
        at = np.flatnonzero(self.level[low:-1])
        if not len(at):
            return 0, 1 << 40
        rise = 1 - 2 * self.level[at + low]
        best = len(rise) - 1 - int(np.argmin(rise[::-1]))
        return int(at[best]) + low, int(rise[best])

    def put(self, fill: int, piece: tuple, size: int) -> Iterator[list]:
        """Puts ``size`` of ``piece`` into the window of that fill opened first, or into a new one."""
        window = self.open[fill].popleft() if fill else []
        if fill:
            self.level[fill] -= 1
        window.append((piece, size))
        if fill + size == self.window:
            yield window
        else:
            self.open[fill + size].append(window)
            self.level[fill + size] += 1

    def add(self, piece: tuple, size: int) -> Iterator[list]:
        yield from self.put(self.choose(size), piece, size)

    def close(self) -> Iterator[list]:
        lowest = 1
        while self.level.sum() > 1:
            lowest = int(np.flatnonzero(self.level)[0])
            window = self.open[lowest].popleft()
            self.level[lowest] -= 1
            for piece, size in window:
                while size:
                    (whole, rise), (part, less) = self.fitting(size), self.cutting(size)
                    cut = self.window - part if part and (less < rise or not whole) else size
                    yield from self.put(part if cut < size else whole, piece, cut)
                    piece, size = (piece[0], piece[1] + cut, *piece[2:]), size - cut
        for left in self.open:
            yield from left


def pack(df: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """Pieces (``COLUMNS``) of all documents; ``ids`` holds little-endian 32-bit ids.

    One pass without a shuffle.  ``sequence_id`` is the task's partition times 2**40 plus a running number.
    """
    schema = pieces_schema(df.schema[id_column].dataType)
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, packer, docs = encoder(tokenizer), Packer(window), {}
        number = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        held, id_kind = 0, pa.null()

        def emit(done: list) -> None:
            nonlocal number, held
            offset = 0
            for (key, start), size in done:
                doc_id, ids, left = docs[key]
                cut = ids[4 * start : 4 * (start + size)]
                rows.append((doc_id, start, size, cut, len(ids) // 4, number, offset))
                held += len(cut)
                offset += size
                if left == size:
                    del docs[key]
                else:
                    docs[key][2] = left - size
            number += 1

        def flush() -> pa.RecordBatch:
            nonlocal held
            columns = zip(*rows) if rows else [[] for _ in COLUMNS]
            kinds = {"doc_id": id_kind, "ids": pa.binary()}
            out = pa.RecordBatch.from_arrays([pa.array(list(c), kinds.get(n, pa.int64())) for n, c in zip(COLUMNS, columns)], COLUMNS)
            rows.clear()
            held = 0
            return out

        key = 0
        for batch in batches:
            id_kind = batch.schema.field(0).type
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = code.encode(value.as_py() or "") + last
                total = len(ids) // 4
                docs[key] = [doc_id, ids, total]
                whole = total - total % window
                for start in range(0, whole, window):
                    emit([((key, start), window)])
                if total > whole:
                    for done in packer.add((key, whole), total - whole):
                        emit(done)
                key += 1
                if held > 1 << 21:
                    yield flush()
        for done in packer.close():
            emit(done)
            if held > 1 << 21:
                yield flush()
        if rows:
            yield flush()
        release_later(IDLE)

    return df.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def digest(pieces: DataFrame) -> DataFrame:
    """The query's columns: the ids' checksum in place of the ids."""
    return pieces.select(F.col("doc_id").cast("long").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
