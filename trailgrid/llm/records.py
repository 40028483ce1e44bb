"""Token-id output: length-delimited binary records with masked checksums and an offset index.

A shard file is a run of frames ``u64 length, u32 masked crc of the length,
payload, u32 masked crc of the payload`` (little-endian, CRC-32).  A payload
is ``i64 doc_id, u8 flags, u32 number of ids, ids`` with ids of two bytes (or
four, flag 1), compressed by zstd under flag 2; flag 4 marks a null doc_id.
Beside each shard lies an index of 32-byte entries ``i64 doc_id, u64 offset,
u64 first id, u32 number of ids, u32 frame length``, so single records can be
read in any order.

Texts are dealt to tasks by ranges of id (and of the text's hash, so that rows
of one id can be split), sorted, encoded and written in one pass; a task writes
as many shards as its rows fill.  There is no bound on their number.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, held, materialize

WIDE, PACKED, NULL_ID = 1, 2, 4
HEAD, BODY, INDEX = struct.Struct("<QI"), struct.Struct("<qBI"), struct.Struct("<qQQII")
MASK_DELTA = 0xA282EAD8
#: Documents, and bytes, of a shard at most (a longer document has a shard of its own); documents of a task, about.
SHARD_DOCS, SHARD_BYTES, TASK_DOCS = 8192, 256_000_000, 8192
#: Tasks at most; with more documents each writes more shards.
TASKS = 100_000
#: Pieces whose ids an executor's Python process remembers at most, and their longest.
MEMO, MEMO_CHARS = 400_000, 40

#: White space of more than one byte, beside what is tested first.
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_NARROW_SPACE = ("  ", "\n\n", " \n", "\n ", "\0", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
_MARKS = ".,;:!?$#%&*"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def plain(text: str) -> bool:
    """Whether all white space is single spaces and single newlines between other characters."""
    if any(x in text for x in _NARROW_SPACE) or text[0] in " \n" or text[-1] in " \n":
        return False
    return text.isascii() or not _WIDE_SPACE.search(text)


class _Pieces(dict):
    """Piece -> ids as little-endian bytes, worked out by the library when first met."""

    def __init__(self, tokenizer, code: str) -> None:
        super().__init__()
        self.tokenizer, self.code = tokenizer, code
        self.words: dict[str, bytes] = {}
        # byte-level BPE writes each byte as a printable character: itself, or one from U+0100 on
        self.letters = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        self.letters |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in self.letters)}

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            tokens = self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
            ids = array(self.code, [t.id for t in tokens]).tobytes()
            if len(word) <= MEMO_CHARS:
                self.words[word] = ids
        return ids

    def __missing__(self, piece: str) -> bytes:
        word = piece.rstrip(_MARKS)
        if (word[1:] if word[:1] == " " else word).isalpha():  # the pre-tokenizer cuts letters from marks
            ids = self._word(word) + (self._word(piece[len(word) :]) if len(word) < len(piece) else b"")
        else:
            ids = array(self.code, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        if len(piece) <= MEMO_CHARS:
            self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts by the tokenizers library, as little-endian bytes.

    Byte-level BPE never joins across a white-space character between two
    others, so a text is cut before each single space and around each single
    newline.  The library encodes every different piece once; one of letters
    and end marks goes straight to its BPE model.  Any other tokenizer than
    byte-level BPE, and texts with other white space, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.pieces = _Pieces(self.tokenizer, self.code)
        kind = json.loads(self.tokenizer.to_str())
        self.cuts = kind["model"]["type"] == "BPE" and (kind["pre_tokenizer"] or {}).get("type") == "ByteLevel" and not kind["pre_tokenizer"].get("add_prefix_space") and not kind["normalizer"]

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.pieces) > MEMO:
            self.pieces.clear()
            self.pieces.words.clear()
        get = self.pieces.__getitem__
        return [
            b"" if not t
            else b"".join(map(get, t.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0"))) if self.cuts and plain(t)
            else self.pack(self.tokenizer.encode(t, add_special_tokens=False).ids)
            for t in texts
        ]


def encoder(path: str) -> Encoder:
    return held(("records", path), lambda: Encoder(path))


def frame(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    flags = WIDE * wide | NULL_ID * (doc_id is None)
    n, small = len(ids) // (4 if wide else 2), zstandard.compress(ids, 1)
    if len(small) < len(ids):
        flags, ids = flags | PACKED, small
    payload = BODY.pack(doc_id or 0, flags, n) + ids
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def unframe(data: bytes | memoryview, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """doc_id, ids (uint32) and the offset of the next frame; ValueError if a checksum or length is wrong."""
    if len(data) - at < HEAD.size:
        raise ValueError(f"truncated record at {at}")
    length, check = HEAD.unpack_from(data, at)
    if masked(bytes(data[at : at + 8])) != check or at + HEAD.size + length + 4 > len(data):
        raise ValueError(f"broken length at {at}")
    payload = bytes(data[at + HEAD.size : at + HEAD.size + length])
    end = at + HEAD.size + length
    if masked(payload) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError(f"broken record at {at}")
    doc_id, flags, n = BODY.unpack_from(payload)
    width = 4 if flags & WIDE else 2
    body = payload[BODY.size :]
    if flags & PACKED:
        body = zstandard.decompress(body, max_output_size=n * width)
    return None if flags & NULL_ID else doc_id, np.frombuffer(body, f"<u{width}", n).astype("<u4"), end + 4


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class _Shard:
    """One shard of a task: its files appear under their names when they are whole, so a task may run twice."""

    def __init__(self, folder: str, part: int, seq: int) -> None:
        self.fs, root = _open(folder)
        self.fs.create_dir(root, recursive=True)
        self.part, self.seq, self.final = part, seq, f"{root}/{shard_name(part, seq)}"
        self.temp = f"{root}/.{shard_name(part, seq)}-{uuid.uuid4().hex}"
        self.out, self.index = self.fs.open_output_stream(f"{self.temp}.rec", buffer_size=1 << 20), []
        self.at = self.ids = 0

    def add(self, doc_id: int | None, n: int, data: bytes) -> None:
        self.out.write(data)
        self.index.append(INDEX.pack(doc_id or 0, self.at, self.ids, n, len(data)))
        self.at, self.ids = self.at + len(data), self.ids + n

    def close(self) -> pa.RecordBatch:
        self.out.close()
        with self.fs.open_output_stream(f"{self.temp}.idx") as out:
            out.write(b"".join(self.index))
        for kind in ("rec", "idx"):
            self.fs.move(f"{self.temp}.{kind}", f"{self.final}.{kind}")
        return pa.RecordBatch.from_pylist([{"part": self.part, "seq": self.seq, "n_docs": len(self.index), "n_ids": self.ids, "n_bytes": self.at}], _MANIFEST)


_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])


def shard_name(part: int, seq: int) -> str:
    return f"shard-{part:06d}-{seq:06d}"


def write_records(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, task_docs: int = TASK_DOCS) -> DataFrame:
    """Encode every whole text and write the shards to ``folder``, which all executors share.

    Returns the manifest ``part, seq, n_docs, n_ids, n_bytes, first_id``: one
    row a shard, shards in ascending doc_id order by part and seq, ``first_id``
    the ids of all shards before.  ``end_id`` is appended to each document.  A
    null or empty text is an empty sequence (plus the end id); a very long one
    is encoded whole.  A null doc_id comes first; rows of one doc_id follow
    each other in the order of their texts' hashes, repeated rows too.  An
    empty table gives no shard; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tasks = max(1, min(TASKS, -(-docs.count() // task_docs)))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("text").asc_nulls_first()]
    dealt = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(tasks, *order[:2]).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq, now = encoder(tokenizer), TaskContext.get().partitionId(), 0, None
        tail = b"" if end_id is None else enc.pack([end_id])
        width = array(enc.code).itemsize
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc(batch.column(1).to_pylist()), strict=True):
                if now is not None and (len(now.index) >= shard_docs or now.at >= SHARD_BYTES):
                    yield now.close()
                    now, seq = None, seq + 1
                now = now or _Shard(folder, part, seq)
                ids += tail
                now.add(doc_id, len(ids) // width, frame(doc_id, ids, width == 4))
        if now is not None:
            yield now.close()

    written = arrow_map(dealt.select("doc_id", "text"), write, "part int, seq int, n_docs long, n_ids long, n_bytes long", ("records", tokenizer))
    shards = materialize(written, "manifest")
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("own"))  # a row a task, TASKS at most
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    placed = shards.withColumn("inside", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).join(F.broadcast(parts), F.col("part") == F.col("p"))
    return placed.select(*shards.columns, (F.col("ahead") + F.col("inside")).alias("first_id"))


def read_shard(folder: str, part: int, seq: int, first_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """All records of one shard in order, 2000 at a time."""
    fs, root = _open(folder)
    name = f"{root}/{shard_name(part, seq)}"
    with fs.open_input_stream(f"{name}.idx") as file:
        index = file.read()
    with fs.open_input_stream(f"{name}.rec", buffer_size=1 << 20) as file:
        for at in range(0, len(index), INDEX.size * 2000):
            cols: list[list] = [[], [], [], [], []]
            for e in range(at, min(at + INDEX.size * 2000, len(index)), INDEX.size):
                _, _, first, n, size = INDEX.unpack_from(index, e)
                doc_id, ids, _ = unframe(file.read(size))
                if len(ids) != n:
                    raise ValueError(f"{name}: the index disagrees at {e}")
                for c, v in zip(cols, (doc_id, first_id + first, n, zlib.crc32(ids.tobytes()), ids if with_ids else None), strict=True):
                    c.append(v)
            arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + ([pa.array(cols[4], pa.list_(pa.int64()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])


def read_records(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of every record, read and checked against both checksums."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from read_shard(folder, row["part"], row["seq"], row["first_id"], with_ids)

    n = max(1, min(TASKS, manifest.count()))
    dealt = manifest.repartitionByRange(n, "part", "seq")  # neighbouring shards, one a task
    return arrow_map(dealt, read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def read_at(folder: str, part: int, seq: int, position: int) -> tuple[int | None, np.ndarray]:
    """One record by its position in the shard, through the offset index alone."""
    fs, root = _open(folder)
    with fs.open_input_file(f"{root}/{shard_name(part, seq)}.idx") as file:
        file.seek(position * INDEX.size)
        _, offset, _, _, size = INDEX.unpack(file.read(INDEX.size))
    with fs.open_input_file(f"{root}/{shard_name(part, seq)}.rec") as file:
        file.seek(offset)
        doc_id, ids, _ = unframe(file.read(size))
    return doc_id, ids
