"""Stupid-backoff language-model scores, computed from n-gram count tables.

The corpus itself is the training text.  The plan is relational: n-grams are
exploded, counted in a table that is partitioned by their hash, joined with
their counts and summed per document.  ``score_rows`` states it with a row for
each n-gram.  ``score_documents`` packs the rows that one block of documents
has for one slice of the hash range into one row of sorted hashes and counts:
an n-gram then costs a block one entry however often it occurs, so frequent
ones do not pile up in a task, and what is shuffled shrinks to about a fourth.
Each slice of the count table adds up what the blocks have counted and
answers every block; the answers meet the block's words again.

The score of a word w after the context h is count(h w) / count(h) if the
n-gram occurs ``least`` times or more in the corpus, else ``BACKOFF`` times the
score after a context shorter by a word; a single word scores count(w) / N.
A document's first words have shorter contexts from the start.
Words are runs of other characters than ASCII white space, A-Z lower-cased;
n-grams do not cross documents and are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, materialize, tidy

ORDER, LEAST, BACKOFF = 3, 2, 0.4
#: Words of a block.
BLOCK_WORDS = 2_000_000
#: Bytes of text for each slice of the count table, about, while there are fewer than ``SLICES``; and most bytes from there on.
SLICE_BYTES, SLICES, SLICE_MOST = 8_000_000, 4096, 64_000_000
SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("logprob", pa.float64())])
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SPACES = "\t\n\v\f\r"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes | None) -> np.ndarray:
    words = (text or b"").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the hash of the n-gram that ends at each word; 0 where a document is too short for it."""
    out = [_mix(words * _A + np.uint64(1))]
    since = np.arange(len(words)) - np.repeat(starts, np.diff(np.r_[starts, len(words)]))
    for n in range(2, order + 1):
        longer = np.zeros_like(words)
        longer[1:] = _mix(out[-1][:-1] * _A + words[1:] * _B + np.uint64(n))
        longer[since < n - 1] = 0
        out.append(longer)
    return out


def _planes(values: np.ndarray, width: int) -> bytes:
    """The numbers byte by byte, lowest bytes first: the high bytes are few and compress."""
    return zstandard.compress(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def _numbers(data: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def _pack(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences."""
    return _planes(np.diff(hashes, prepend=np.uint64(0)), 8)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data, 8), dtype=np.uint64)


def _shrink(counts: np.ndarray) -> bytes:
    return _planes(counts, 4)


def _grow(data: bytes) -> np.ndarray:
    return _numbers(data, 4)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, list, np.ndarray, np.ndarray]]:
    """Name, document keys, word hashes and starts of documents, for each block of a partition."""
    part, number = TaskContext.get().partitionId(), 0
    keys, held, size = [], [], 0

    def block() -> tuple[str, list, np.ndarray, np.ndarray]:
        return f"{part}.{number}", keys, np.concatenate(held), np.cumsum([0] + [len(x) for x in held[:-1]])

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            h = word_hashes(text)
            keys.append(key)
            held.append(h)
            size += len(h)
            if size >= most:
                yield block()
                keys, held, size, number = [], [], 0, number + 1
    if keys:
        yield block()


def _different(words: np.ndarray, starts: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The n-grams of each order, and the block's sorted different hashes (without 0) with their counts."""
    orders = gram_hashes(words, starts, order)
    found, counts = np.unique(np.concatenate(orders), return_counts=True)
    return orders, found[found > 0], counts[found > 0]


def _find(found: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted hash, or 0, stands among the sorted ones: its high bits lead near the place, then step by step."""
    shift = np.uint64(64 - max(1, int(len(found)).bit_length()))
    slots = np.arange((1 << (64 - int(shift))) + 1)
    first = np.searchsorted((found >> shift).astype(np.int64), slots)
    at = first[(wanted >> shift).astype(np.int64)]
    todo = np.flatnonzero(wanted)
    while len(todo := todo[found[at[todo]] < wanted[todo]]):
        at[todo] += 1
    return np.minimum(at, max(0, len(found) - 1))


def _edges(slices: int) -> np.ndarray:
    return (np.arange(1, slices, dtype=object) * ((1 << 64) // slices)).astype(np.uint64)


def ask(batches: Iterator[pa.RecordBatch], order: int, slices: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows ``slice, block, words, grams, counts``: what each block has of each slice of the hash range, and its words in all."""
    for name, _, words, starts in _blocks(batches, most):
        _, found, counts = _different(words, starts, order)
        cut = [0, *np.searchsorted(found, _edges(slices)).tolist(), len(found)]
        spans = list(zip(cut, cut[1:], strict=False))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(slices), pa.int32()), pa.array([name] * slices, pa.string()), pa.array([len(words)] * slices, pa.int64()), pa.array([_pack(found[a:b]) for a, b in spans], pa.binary()), pa.array([_shrink(counts[a:b]) for a, b in spans], pa.binary())],
            ["slice", "block", "words", "grams", "counts"],
        )


def tally(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """One slice of the count table: different hashes, their totals, and the totals of each list in its order."""
    table, index = np.unique(np.concatenate(hashes), return_inverse=True)
    totals = np.bincount(index, np.concatenate(counts), len(table)).astype(np.int64)
    ends = np.cumsum([len(h) for h in hashes])
    return table, totals, [totals[index[e - len(h) : e]] for h, e in zip(hashes, ends, strict=True)]


def _rows_by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    now, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            if row[0] != now and held:
                yield now, held
                held = []
            now = row[0]
            held.append(row)
    if held:
        yield now, held


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``block, slice, words, digest, payload`` for sorted rows of ``ask``: words of the corpus, sum of the asked hashes, totals."""
    for number, rows in _rows_by_slice(batches):
        hashes = [_unpack(r[3]) for r in rows]
        _, _, each = tally(hashes, [_grow(r[4]) for r in rows])
        words = sum(r[2] for r in rows)
        totals = [_shrink(np.minimum(x, 0xFFFFFFFF)) for x in each]
        digest = [int(h.sum(dtype=np.uint64).view(np.int64)) for h in hashes]
        yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows]), pa.array([number] * len(rows), pa.int32()), pa.array([words] * len(rows), pa.int64()), pa.array(digest, pa.int64()), pa.array(totals, pa.binary())], ["block", "slice", "words", "digest", "payload"])


def state(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows ``block, keys, lengths, different, index``: a block's documents, its different words from frequent to rare, and which stands where."""
    for name, keys, words, starts in _blocks(batches, most):
        kinds, index, counts = np.unique(words, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        lengths = np.diff(np.r_[starts, len(words)])
        cells = [_shrink(lengths), kinds[order].astype("<u8").tobytes(), _shrink(rank[index])]
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([keys], pa.list_(pa.int64())), *(pa.array([c], pa.binary()) for c in cells)], ["block", "keys", "lengths", "different", "index"])


def score_block(row: dict, got: list[dict], order: int, least: int, backoff: float) -> pa.RecordBatch:
    """``doc_id, n_words, logprob`` of a block's documents from its state and the answers of all slices in order."""
    lengths, kinds = _grow(row["lengths"]).astype(np.int64), np.frombuffer(row["different"], "<u8").astype(np.uint64)
    words = kinds[_grow(row["index"])] if lengths.sum() else np.empty(0, np.uint64)
    starts, ends, n = np.cumsum(lengths) - lengths, np.cumsum(lengths), len(words)
    orders, found, _ = _different(words, starts, order)
    total = np.concatenate([_grow(g["payload"]) for g in got]).astype(float)
    if len(total) != len(found) or sum(g["digest"] for g in got) % (1 << 64) != int(found.sum(dtype=np.uint64)):
        raise ValueError("a block held other documents when it was read again; pass stored=False")
    counts = [np.where(g > 0, total[_find(found, g)], 0) if len(found) else g.astype(float) for g in orders]
    score, done = np.zeros(n), np.zeros(n, bool)
    for k in range(order, 0, -1):
        before = np.r_[1.0, counts[k - 2][:-1]] if k > 1 else np.full(n, float(max(1, got[0]["words"])))
        use = ~done & ((counts[k - 1] >= least) if k > 1 else True)
        score[use] += np.log(counts[k - 1][use] / before[use])
        done |= use
        score[~done & (orders[k - 1] != 0)] += math.log(backoff)
    exact = np.array([score[s:e].sum() for s, e in zip(starts, ends, strict=True)], float)
    return pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.int64()), pa.array(lengths), pa.array(exact)], SCORED.names)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _slices(texts: DataFrame) -> int:
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, min(SLICES, -(-size // SLICE_BYTES)), -(-size // SLICE_MOST))


def _asked(texts: DataFrame, order: int, slices: int, most: int) -> DataFrame:
    asked = arrow_map(texts, lambda it: ask(it, order, slices, most), "slice int, block string, words long, grams binary, counts binary")
    return asked.repartition("slice").sortWithinPartitions("slice")


def count_table(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``gram, n``: the corpus counts of all n-grams of up to ``order`` words by their hash, dealt by hash range."""
    texts = _texts(docs, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _rows_by_slice(batches):
            table, totals, _ = tally([_unpack(r[3]) for r in rows], [_grow(r[4]) for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array(table.view(np.int64)), pa.array(totals)], ["gram", "n"])

    return arrow_map(_asked(texts, order, _slices(texts), BLOCK_WORDS), count, "gram long, n long")


def score_documents(docs: DataFrame, order: int = ORDER, least: int = LEAST, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS, stored: bool = False) -> DataFrame:
    """``doc_id, n_words, logprob`` of every row: the natural log of the product of its words' scores.

    A null or empty text has no words and a logprob of 0; a null id is kept.
    Repeated rows give repeated rows and are counted as often; very long texts
    make a block of their own; other columns are ignored; an empty table gives
    an empty result.  The texts are read twice, so they are written to the
    shared folder first unless ``stored`` says that ``docs`` is read from files
    as it is; a change between the reads raises an error.
    """
    texts = _texts(docs, id_col, text_col)
    texts = texts if stored else materialize(texts, "lm-texts")
    answers = arrow_map(_asked(texts, order, _slices(texts), block_words), answer, "block string, slice int, words long, digest long, payload binary")
    states = arrow_map(texts, lambda it: state(it, block_words), "block string, keys array<long>, lengths binary, different binary, index binary")

    def finish(mine: pa.Table, got: pa.Table) -> pa.Table:
        answers = sorted(got.to_pylist(), key=lambda g: g["slice"])
        done = [score_block(row, answers, order, least, backoff) for row in mine.to_pylist()]
        tidy()
        return pa.Table.from_batches(done, SCORED)

    return states.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, "doc_id long, n_words long, logprob double")


def score_rows(docs: DataFrame, order: int = ORDER, least: int = LEAST, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score_documents`` with a row for each n-gram and DataFrame functions only; for tables of some million words."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _SPACES, "abcdefghijklmnopqrstuvwxyz" + " " * len(_SPACES))
    words = F.array_remove(F.split(F.coalesce(low, F.lit("")), " "), "")
    rows = materialize(_texts(docs, id_col, text_col).select("doc_id", words.alias("w"), F.monotonically_increasing_id().alias("row")), "lm-rows")
    placed = rows.select("row", "w", F.posexplode("w").alias("at", "_"))

    def gram(n: int, back: int):
        """The n-gram that ends ``back`` words before; null where the document is too short."""
        return F.when(F.col("at") >= n + back - 1, F.concat_ws(" ", F.slice("w", F.col("at") - (n + back - 2), n)))

    grams = placed.select("row", "at", F.inline(F.array(*[F.struct(F.lit(n).alias("n"), gram(n, 0).alias("g"), (gram(n - 1, 1) if n > 1 else F.lit(None).cast("string")).alias("h")) for n in range(1, order + 1)]))).where("g is not null")
    counts = grams.groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    total = grams.where("n = 1").agg(F.count(F.lit(1)).alias("total"))  # one row
    met = grams.join(counts, "g").join(counts.select(F.col("g").alias("h"), F.col("c").alias("d")), "h", "left").crossJoin(F.broadcast(total))
    best = met.where((F.col("n") == 1) | (F.col("c") >= least)).groupBy("row", "at").agg(F.max_by(F.ln(F.col("c") / F.coalesce("d", "total")), "n").alias("s"), F.max("n").alias("used"))
    longest = F.least(F.col("at") + 1, F.lit(order))
    score = best.groupBy("row").agg(F.sum(F.col("s") + (longest - F.col("used")) * math.log(backoff)).alias("s"))
    return rows.join(score, "row", "left").select("doc_id", F.size("w").cast("long").alias("n_words"), F.coalesce("s", F.lit(0.0)).alias("logprob"))
