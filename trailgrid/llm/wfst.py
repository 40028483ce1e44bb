"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file is compiled into three machines: the normaliser (white space, and
the file's table of character rewritings, a trie), the lexicon (a trie of
pieces whose arcs carry weights) and the byte fallback of characters that have
no piece.  Composed with a normalised text they give a lattice; the output is
its path of least weight in the tropical semiring (weights add along a path,
the least of all paths wins).

Unigram models: a state is a position, an arc weighs minus its piece's score.

BPE models: a state is a position and the piece that ends there, each arc
weighs 1, and the arc of piece v leaves a state of piece u only if merging
u + v alone gives u, v again (its weight is infinite otherwise).  Such a path
is what merging gives: take the first merge of the whole text whose result
lies across a border of the path; everything merged before it lies inside the
pieces on both sides, so those two pieces alone would merge there as well, and
the arc between them would not exist.  The lattice thus has one path of finite
weight; the tests list all of them for short texts.  Runs of the word mark, in
which equal merges overlap, are merged to see which pieces stand side by side.

Where no piece holds a word mark after another character, texts are composed
word by word, and results for words are remembered.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, held, typed

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words of each of two generations, and pairs of pieces, that a Python process remembers; longer words are not kept.
MEMO, PAIRS, MEMO_CHARS = 200_000, 300_000, 40
#: Fixed values of the unigram model: the unknown character's weight beyond the rarest piece's, the bonus of user pieces.
UNKNOWN_PENALTY, USER_BONUS = 10.0, 0.1
_UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i : i + size], i + size
        yield key >> 3, value


class Charsmap:
    """Rewriting of the longest known beginning: a double-array trie over UTF-8 bytes whose leaves point to texts."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0]
        self.cells = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.texts = blob[4 + size :]

    @staticmethod
    def _base(cell: int) -> int:
        return (cell >> 10) << ((cell & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, str] | None:
        """Number of bytes and their rewriting for the longest key that begins at ``at``."""
        cells, found = self.cells, None
        node = self._base(cells[0])
        for end in range(at, len(data)):
            node ^= data[end]
            if node >= len(cells) or cells[node] & 0x800000FF != data[end]:
                break
            cell = cells[node]
            node ^= self._base(cell)
            if cell & 256:  # a key ends here; its value lies at the node's base
                found = end + 1 - at, cells[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.texts[start : self.texts.index(b"\0", start)].decode()

    def rewrite(self, text: str) -> str:
        """The text with every longest key replaced, from left to right."""
        data, out, at = text.encode("utf-8", "surrogatepass"), [], 0
        while at < len(data):
            hit = self.longest(data, at)
            if hit is None:
                n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                hit = n, data[at : at + n].decode("utf-8", "replace")
            out.append(hit[1])
            at += hit[0]
        return "".join(out)


class _Memo(dict):
    """Word -> packed ids in two generations: a full one becomes the older, and what is met again there moves on."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, unit: str) -> bytes:
        found = self.older.get(unit)
        if found is None:
            found = self.make(unit)
        if len(unit) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[unit] = found
        return found


@dataclass
class Transducer:
    """Compiled from the bytes of a .model file."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model: int
    byte_fallback: bool
    prefix: bool
    trim: bool
    unknown: int = 0
    charsmap: Charsmap | None = None
    escape: bool = True
    suffix: bool = False
    ids: dict[str, int] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> "Transducer":
        with open(path, "rb") as file:
            return cls.parse(file.read())

    @classmethod
    def parse(cls, data: bytes) -> "Transducer":
        pieces, scores, kinds, train, norm = [], [], [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own.get(1, b"").decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                train = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        rules = Charsmap(norm[2]) if norm.get(2) else None
        made = cls(pieces, scores, kinds, train.get(3, UNIGRAM), bool(train.get(35, 0)), bool(norm.get(3, 1)), bool(norm.get(4, 1)), train.get(40, 0), rules, bool(norm.get(5, 1)), bool(train.get(24, 0)))
        made._compile()
        return made

    def _compile(self) -> None:
        kinds = self.kinds
        self.bytes_ = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == BYTE}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k in (NORMAL, USER, UNUSED)}
        user = sorted((p for p, i in self.ids.items() if kinds[i] == USER), key=len, reverse=True)
        self.user = re.compile("|".join(map(re.escape, user))) if user else None
        # words are composed one by one if no piece lies across their borders
        self.cuts = not user and self.escape and not any(re.search(f"[^{MARK}]{MARK}", p) or "\n" in p and p != "\n" for p in self.ids)
        self.text = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        known = [s for s, k in zip(self.scores, kinds, strict=True) if k == NORMAL] or [0.0]
        best, self.unknown_weight = max(known), 1.0 if self.model == BPE else UNKNOWN_PENALTY - min(known)
        self.weights = [1.0 if self.model == BPE else USER_BONUS - len(p) * best if k == USER else -s for p, s, k in zip(self.pieces, self.scores, kinds, strict=True)]
        self.memo = _Memo(lambda unit: array(self.code, self.shortest(unit)).tobytes())
        self.side: dict[int, bool] = {}
        if self.model == BPE:
            self._compile_merges()
            self.live = {p: i for p, i in self.ids.items() if kinds[i] != USER and (len(p) == 1 or i in self.halves)}
        else:
            self.live = {p: i for p, i in self.ids.items() if kinds[i] != UNUSED}
        self.known = {p[:i]: -1 for p in self.live for i in range(1, len(p) + 1)} | self.live  # the lexicon's trie: every beginning of a piece
        self.marked = {i for p, i in self.live.items() if MARK in p}

    def _compile_merges(self) -> None:
        """The order of merges, the last merge of every piece, and the rank of each pair that merges."""
        self.score = {p: self.scores[i] for p, i in self.ids.items() if self.kinds[i] != USER}
        order = sorted((p for p in self.score if len(p) > 1), key=lambda p: (-self.score[p], self.ids[p]))
        self.rank: dict[int, int] = {self.ids[p]: r for r, p in enumerate(order)}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merge: dict[int, int] = {}  # of the pair (u, v) of ids, as u << 32 | v
        for p in order:
            done, last = self._merge(list(p))
            if done == [p]:
                self.halves[self.ids[p]] = self.ids[last[0]], self.ids[last[1]]
            for i in range(1, len(p)):
                u, v = self.ids.get(p[:i]), self.ids.get(p[i:])
                if u is not None and v is not None:
                    self.merge[u << 32 | v] = self.rank[self.ids[p]]

    def _merge(self, parts: list[str]) -> tuple[list[str], tuple[str, str] | None]:
        """Merge the neighbours of best score, leftmost first, until none is left; the last merge."""
        last = None
        while len(parts) > 1:
            best = max(((self.score.get(a + b, -math.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=None)
            if best[0] == -math.inf:
                break
            i = -best[1]
            last = parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, last

    def beside(self, u: int, v: int) -> bool:
        """Whether the arc of piece v leaves a state of piece u; worked out and remembered."""
        if len(self.side) > PAIRS:
            self.side.clear()
        if u in self.marked and v in self.marked and MARK * 2 in self.pieces[u] + self.pieces[v]:
            known = self._merge([*self.pieces[u], *self.pieces[v]])[0] == [self.pieces[u], self.pieces[v]]
        else:
            known = self._apart(u, v)
        self.side[u << 32 | v] = known
        return known

    def _apart(self, u: int, v: int) -> bool:
        """Undo the merges of u and v from the latest on; no merge across their border may come before the one undone."""
        rank, limit = self.rank, len(self.rank) + 1
        while True:
            if self.merge.get(u << 32 | v, limit) < limit:
                return False
            a, b = rank.get(u, -1), rank.get(v, -1)
            if a > b:
                limit, u = a, self.halves[u][1]
            elif b < 0:
                return True
            else:
                limit, v = b + 1, self.halves[v][0]

    def arcs(self, text: str, i: int) -> list[tuple[int, int, float]]:
        """End, piece and weight of the arcs that begin at position i; piece -1 stands for a character without one."""
        found = []
        for j in range(i + 1, len(text) + 1):
            piece = self.known.get(text[i:j])
            if piece is None:
                break
            if piece >= 0:
                found.append((j, piece, self.weights[piece]))
        if not found or found[0][0] > i + 1:
            found.append((i + 1, -1, self.unknown_weight))
        return found

    def shortest(self, text: str) -> list[int]:
        """The ids on the path of least weight through the lattice of a normalised text; of equal paths the one that begins with shorter arcs."""
        if self.model == BPE and self.user and (cuts := [0, *(x for m in self.user.finditer(text) for x in m.span()), len(text)])[1:-1]:
            # user pieces neither merge nor are cut: what lies between them is composed by itself
            return [x for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) for x in ([self.ids[text[a:b]]] if k % 2 else self._least(text[a:b]))]
        return self._least(text)

    def _least(self, text: str) -> list[int]:
        """One state a position is kept: in a BPE model no other has a path of finite weight to it."""
        n, known, bpe, side, weights = len(text), self.known, self.model == BPE, self.side, self.weights
        cost, last, back = [0.0] + [math.inf] * n, [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            sofar, before, alone = cost[i], last[i], True
            for j in range(i + 1, n + 1):
                piece = known.get(text[i:j])
                if piece is None:
                    break
                if piece >= 0:
                    alone = alone and j > i + 1
                    if sofar + weights[piece] < cost[j]:
                        if bpe and before >= 0:
                            pair = before << 32 | piece
                            if not (side[pair] if pair in side else self.beside(before, piece)):
                                continue
                        cost[j], last[j], back[j] = sofar + weights[piece], piece, i
            if alone and sofar + self.unknown_weight < cost[i + 1]:  # a character without a piece
                cost[i + 1], last[i + 1], back[i + 1] = sofar + self.unknown_weight, -1, i
        out, at = [], n
        while at:
            out.append(self._emitted(last[at]) if last[at] >= 0 else self._fallback(text[back[at]]))
            at = back[at]
        return [x for ids in reversed(out) for x in ids]

    def _emitted(self, piece: int) -> list[int]:
        """The piece; in a BPE model an unused one falls apart again into what it was merged from."""
        if self.model == BPE and self.kinds[piece] == UNUSED and piece in self.halves:
            return [x for half in self.halves[piece] for x in self._emitted(half)]
        return [piece]

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes_[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_fallback else [self.unknown]

    def normalise(self, text: str) -> str:
        """The text that is composed with the lexicon."""
        if self.charsmap:
            if self.user:  # user pieces are left as they are
                cuts = [0, *(x for m in self.user.finditer(text) for x in m.span()), len(text)]
                text = "".join(text[a:b] if k % 2 else self.charsmap.rewrite(text[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
            else:
                text = self.charsmap.rewrite(text)
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        if self.prefix:
            text = text + " " if self.suffix else " " + text
        return text.replace(" ", MARK) if self.escape else text

    def units(self, text: str) -> list[str]:
        """The normalised text, cut where no piece can lie across."""
        if not self.cuts:
            return [u] if (u := self.normalise(text)) else []
        if self.charsmap or self.trim or self.suffix or MARK in text or "\0" in text or "  " in text or text[:1] == " ":
            return _UNIT.findall(self.normalise(text))
        head = MARK if self.prefix else ""
        return [u for u in (head + text.replace(" ", "\0" + MARK).replace("\n", "\0\n\0")).split("\0") if u] if text else []

    def encode(self, text: str | None) -> bytes:
        """Ids of the text, little-endian, two bytes each (four if there are over 65,536 pieces)."""
        out = b"".join(map(self.memo.__getitem__, self.units(text or "")))
        if not self.byte_fallback and len(out):  # a run of unknown characters is one unknown piece
            x = np.frombuffer(out, f"<u{array(self.code).itemsize}")
            out = x[~np.r_[False, (x[1:] == self.unknown) & (x[:-1] == self.unknown)]].tobytes()
        return out

    @property
    def code(self) -> str:
        return "H" if len(self.pieces) <= 1 << 16 else "I"

    def ids_of(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, "<u2" if self.code == "H" else "<u4")

    def decode(self, ids) -> str:
        """The text of the ids: the inverse transducer, with the added word mark dropped."""
        data = b"".join(map(self.text.__getitem__, ids))
        if self.prefix and self.suffix:
            data = data.removesuffix(b" ")
        elif self.prefix:
            data = data.removeprefix(b" ")
        return data.decode("utf-8", "replace")


def transducer(path: str) -> Transducer:
    """The compiled model, once a process."""
    return held(("wfst", path), lambda: Transducer.load(path))


def _encoded(batch: pa.RecordBatch, text_at: int, keep: list[int], model: str, ids: bool) -> Iterator[pa.RecordBatch]:
    t = transducer(model)
    fallback = np.array([k == BYTE for k in t.kinds])
    cols: list[list] = [[], [], [], [], []]
    for text in batch.column(text_at).to_pylist():
        x = t.ids_of(t.encode(text))
        decoded = t.decode(x.tolist())
        for c, v in zip(cols, (len(x), int(fallback[x].sum()), zlib.crc32(x.astype("<u4").tobytes()), decoded == (text or ""), x.astype(np.int32) if ids else None), strict=True):
            c.append(v)
    arrays = [batch.column(i) for i in keep] + [pa.array(c, k) for c, k in zip(cols[:4], (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]
    names = [batch.schema.names[i] for i in keep] + ["n_pieces", "n_bytes", "ids_crc32", "round_trip"]
    if ids:
        offsets = np.cumsum([0] + [len(x) for x in cols[4]]).astype(np.int32)
        arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(cols[4]) if cols[4] else np.empty(0, np.int32))))
        names.append("pieces")
    yield pa.RecordBatch.from_arrays(arrays, names)


def encode_documents(docs: DataFrame, model: str, keep: bool = False, ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` (or all columns if ``keep``) and ``n_pieces, n_bytes, ids_crc32, round_trip[, pieces]`` of every row.

    ``n_bytes`` counts the pieces from byte fallback; ``round_trip`` tells
    whether decoding gives the text again (a word mark U+2581 in a text
    becomes a space).  A null or empty text has no pieces and an empty text; a
    very long one is composed whole, word by word.  Repeated rows give
    repeated rows, an empty table an empty result; input columns of these
    names are replaced, others don't matter.
    """
    own = ("n_pieces", "n_bytes", "ids_crc32", "round_trip", "pieces")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own]) if keep else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    text_at = docs.columns.index(text_col if keep else "text")
    kept = list(range(len(docs.columns))) if keep else [0]
    schema = typed(docs if keep else docs.select("doc_id")) + ", n_pieces long, n_bytes long, ids_crc32 long, round_trip boolean" + ", pieces array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _encoded(batch, text_at, kept, model, ids)

    return arrow_map(docs, run, schema, ("wfst", model))
