"""Substring dedup by sliding sentence spans.

A text is cut into units: sentences (up to and with their end marks or line
breaks), and sentences of over ``UNIT_WORDS`` words after words that their own
hash chooses, one in four, with four words in a piece or more and twice
``UNIT_WORDS`` at most; so a passage is cut alike wherever it begins.  A run
is the fewest consecutive units, two or more, that have ``PAIR_WORDS`` words
in all, or three or more that have ``SPAN_WORDS``.  Every run is hashed (lower
case, words joined by single spaces) and the hashes meet in one global join.
A unit goes if a run that covers it occurs in a document of smaller id, or
earlier in its own.  Passages of over 50 words hold whole runs, even if they
begin and end inside sentences: what they cut off of the units at their ends
leaves two whole units with 20 words or more.  A text too short for any run is
one run as a whole, which meets only other such texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, fresh, map_batches, materialize, typed

UNIT_WORDS, SPAN_WORDS, PAIR_WORDS = 16, 12, 20
_PIECE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
_WORD = re.compile(r"\s*\S+\s*")


def sentences(text: str | None) -> int:
    """Number of sentences with words."""
    return sum(1 for piece in _PIECE.findall(text or "") if not piece.isspace())


def units(text: str | None) -> list[tuple[str, str, int]]:
    """The pieces of a text, which join to the text again: piece, its normal form, its number of words."""
    out = []
    for piece in _PIECE.findall(text or ""):
        words = piece.lower().split()
        if len(words) <= UNIT_WORDS:
            out.append((piece, " ".join(words), len(words)))
        else:
            parts, at = _WORD.findall(piece), 0
            for i, word in enumerate(words, 1):
                if i == len(words) or i - at == 2 * UNIT_WORDS or i - at >= 4 and zlib.crc32(word.encode("utf-8", "surrogatepass")) % 4 == 0:
                    out.append(("".join(parts[at:i]), " ".join(words[at:i]), i - at))
                    at = i
    return out


def _fits(units: int, words: int) -> bool:
    return units > 1 and words >= PAIR_WORDS or units > 2 and words >= SPAN_WORDS


def runs(pieces: list[tuple[str, str, int]]) -> list[tuple[int, list[int]]]:
    """Signed hash and the pieces' positions of every run; pieces without words are passed over.

    A run has the fewest pieces that fit from its first one on, or the fewest
    up to its last one, so that runs inside a passage reach from its first
    piece to its last.
    """
    at = [i for i, (_, _, n) in enumerate(pieces) if n]
    total = [0, *accumulate(pieces[i][2] for i in at)]
    spans = []
    first, seen = 0, 0  # the run up to ``last`` begins at ``first``; runs from the pieces before ``seen`` on are in
    for last in range(2, len(at) + 1):
        while _fits(last - seen, total[last] - total[seen]):
            spans.append((seen, last))
            seen += 1
        if seen:
            while _fits(last - first - 1, total[last] - total[first + 1]):
                first += 1
            if spans[-1] != (first, last):
                spans.append((first, last))
    whole = [] if spans or not at else [(0, len(at))]
    out = []
    for k, end in spans or whole:
        span = at[k:end]
        h = xxhash.xxh3_64_intdigest("\n".join(pieces[i][1] for i in span).encode("utf-8", "surrogatepass"), 1 if whole else 0)
        out.append((h - (1 << 64) if h >> 63 else h, span))
    return out


def without_repeats(text: str | None, taken: set[int]) -> tuple[str | None, int, int]:
    """The text without its repeated units, its number of units with words, and how many went.

    ``taken``: the hashes of runs that a smaller document has.
    """
    pieces = units(text)
    gone: set[int] = set()
    seen: set[int] = set()
    for h, span in runs(pieces):
        if h in taken or h in seen:
            gone.update(span)
        seen.add(h)
    total = sum(1 for _, _, n in pieces if n)
    return ("".join(p for i, (p, _, _) in enumerate(pieces) if i not in gone) if gone else text), total, len(gone)


def _hashes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    hashes, ids = [], []
    for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        found = {h for h, _ in runs(units(text))}
        hashes += found
        ids += [d] * len(found)
    yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(ids, pa.int64())], ["h", "d"])


def document_key(id_col: Column, text: Column) -> Column:
    """The id; of a row without one a number above 2^62 that its text makes, so such rows come last and differ as their texts do."""
    return F.coalesce(id_col.cast("long"), F.lit(1 << 62).bitwiseOR(F.shiftrightunsigned(F.xxhash64(text), 2)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text cleaned, and ``n_sentences, n_units, n_removed`` (units with words, and those that went).

    Rows that share an id are one document to each other: only repeats within
    each row and of smaller documents go.  Rows without an id come after all
    others, in an order that their texts decide; equal texts without an id are
    one document.  A null text stays null; an empty one has no units; a text
    that loses all its units becomes empty; a very long text is taken whole.
    An empty table gives an empty result.  Input columns of the new names are
    replaced, other columns may have any name; no row is dropped.
    """
    own = ("n_sentences", "n_units", "n_removed")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own])
    text = F.col(f"`{text_col}`").cast("string")
    key = document_key(F.col(f"`{id_col}`"), F.coalesce(text, F.lit("")))
    spans = materialize(map_batches(docs.select(key.alias("d"), text.alias("t")), _hashes, "h long, d long"), "spans")
    first = spans.groupBy("h").agg(F.min("d").alias("d0"), F.max("d").alias("d1")).where("d0 < d1").select(F.col("h").alias("rh"), "d0")
    first = materialize(first, "spans-first")  # a stored side: the rows of a very common passage can be split between tasks
    mine, taken = fresh(docs, "key", "taken")
    later = spans.join(first, F.col("h") == F.col("rh")).where("d > d0").groupBy("d").agg(F.collect_set("h").alias(taken))
    later = materialize(later, "spans-taken")
    discard(spans, first)  # before the texts are dealt, which take the most disk
    other, = fresh(docs.withColumn(mine, F.lit(0)).withColumn(taken, F.lit(0)), "other")
    both = docs.withColumn(mine, key).join(later.withColumnRenamed("d", other), F.col(mine) == F.col(other), "left").drop(mine, other)
    names = docs.columns
    at = names.index(text_col)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
            done = [without_repeats(t, set(h or ())) for t, h in zip(texts, found, strict=True)]
            cols = [pa.array([d[0] for d in done], batch.column(at).type) if i == at else batch.column(i) for i in range(len(names))]
            counts = [pa.array(c, pa.int64()) for c in ([sentences(t) for t in texts], [d[1] for d in done], [d[2] for d in done])]
            yield pa.RecordBatch.from_arrays([*cols, *counts], [*names, *own])

    return arrow_map(both, rebuild, f"{typed(docs)}, n_sentences long, n_units long, n_removed long")
