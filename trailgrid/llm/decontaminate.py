"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows.

Texts are lower-cased (A-Z) and every other ASCII character that is not a
letter or digit becomes a space; characters beyond ASCII belong to words.  A
window is ``width`` consecutive words of an item, or the whole item if it has
fewer.  The automaton holds each window between single spaces, so one scan of
a document, its words joined by single spaces, finds every occurrence; the
word numbers are then mapped to offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, fresh, held, materialize, typed

#: A word of the original text, whose letters A-Z are not lower-cased yet.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of item text in one automaton; a larger benchmark is scanned for in several passes.
AUTOMATON_BYTES = 4_000_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def build(items: list[tuple[str, bytes | None]], width: int) -> ahocorasick.Automaton | None:
    """The automaton; each value is the window's number of words and the items that have it."""
    windows: dict[bytes, tuple[int, set[str]]] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(min(1, len(w)), len(w) - width + 1)):
            run = w[i : i + width]
            windows.setdefault(b" ".join(run), (len(run), set()))[1].add(item)
    automaton = ahocorasick.Automaton()
    for key, value in windows.items():
        automaton.add_word(f" {key.decode('latin-1')} ", value)
    if not windows:
        return None
    automaton.make_automaton()
    return automaton


def scan(text: bytes | None, automaton: ahocorasick.Automaton | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged word ranges [start, end) that are hit, and the items that occur."""
    w = words(text)
    found = list(automaton.iter(f" {b' '.join(w).decode('latin-1')} ")) if w and automaton is not None else []
    if not found:
        return len(w), [], set()
    ends = np.cumsum([len(x) + 1 for x in w])
    last = np.searchsorted(ends, [at for at, _ in found]) + 1
    spans: list[tuple[int, int]] = []
    for start, end in sorted((int(e) - n, int(e)) for e, (_, (n, _)) in zip(last, found, strict=True)):
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], end))
        else:
            spans.append((start, end))
    return len(w), spans, set().union(*(items for _, (_, items) in found))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets [start, end) in the original text of ranges of words."""
    if not spans:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[s][0], at[e - 1][1]) for s, e in spans]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, bytes | None]]]:
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").cast("binary").alias("t")).where("i is not null")
    size = rows.agg(F.sum(F.length("t") + F.length("i") + 16)).first()[0] or 0
    n = -(-size // most) or 1
    for b in range(n):
        yield [(r["i"], r["t"]) for r in rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == b).collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, keep: bool = False, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """Per row of ``docs``: ``n_words, n_hit, items, spans`` beside its id, or beside all its columns if ``keep``.

    ``n_hit`` counts the words inside any occurrence of a window, ``items``
    lists the item ids as sorted strings, ``spans`` the character ranges in
    the original text.  A null or empty text has no words and no hits, a very
    long one is scanned whole, an empty table gives an empty result; a null
    item text has no windows, rows without an item id are left out, repeated
    items count once.  Repeated documents are judged row by row.  Input
    columns of these names are replaced, others may have any name.  The automaton is broadcast; the
    benchmark's size is measured first, and one beyond ``automaton_bytes`` is
    cut into blocks with one pass over the documents each.
    """
    spark = docs.sparkSession
    own = ["n_words", "n_hit", "items", "spans"]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own]) if keep else docs.select(id_col, text_col)
    ranges_col, = fresh(docs, "ranges")  # the hit words, for the passes over a large benchmark
    kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), ranges_col: pa.list_(pa.int32())}
    schema = f"{typed(docs)}, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>, {ranges_col} array<int>"
    kept, text_at = docs.columns, docs.columns.index(text_col)
    for number, block in enumerate(_blocks(benchmark, id_col=item_col, text_col="text", most=automaton_bytes)):
        sent = spark.sparkContext.broadcast(block)  # AUTOMATON_BYTES of texts at most
        key = ("decontaminate", width, hashlib.sha256(repr(block).encode()).hexdigest())

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=key, number=number) -> Iterator[pa.RecordBatch]:
            automaton = held(key, lambda: build(sent.value, width))  # built once a process, not once a task
            for batch in batches:
                texts = as_bytes(batch.column(text_at))
                before = [batch.column(len(kept) + k).to_pylist() for k in (2, 4)] if number else None
                cols: dict[str, list] = {k: [] for k in kinds}
                for i, text in enumerate(texts):
                    n, ranges, items = scan(text, automaton)
                    if before is not None:
                        flat = before[1][i]
                        ranges, items = merged([*ranges, *zip(flat[::2], flat[1::2], strict=True)]), items | set(before[0][i])
                    found = n, sum(e - s for s, e in ranges), sorted(items), [{"start": s, "end": e} for s, e in offsets(text.decode(), ranges)] if ranges else [], [x for r in ranges for x in r]
                    for c, v in zip(cols.values(), found, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), *(pa.array(cols[k], kind) for k, kind in kinds.items())], [*kept, *kinds])

        docs = arrow_map(materialize(docs, "decontaminate") if number else docs, run, schema, key)
    return docs.drop(ranges_col) if keep else docs.select(F.col(id_col).alias("doc_id"), *own)


def is_contaminated():
    """The rule: some words are hit, and they are a twentieth of all words at least."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
