"""Language identification by interpolated Kneser-Ney character models.

One model of order ``ORDER`` per language, all kept in common sorted arrays of
64-bit n-gram hashes: for each order the hashes of every n-gram seen in any
language, with a row of log-probabilities (one a language), and likewise the
contexts with their back-off weights.  A text goes to the language of lowest
cross-entropy per character; one that fits worse than nearly all training
texts of that language is marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bounded_sample, different

ORDER = 4
#: Training texts of each language at most.
SAMPLE = 1500
#: Characters for which entropy differences count at most in the score.
SCORE_CHARS = 200
CHUNK = 1_000_000
_GAP = re.compile(r"[\W\d_]+")
_SEP = "\n" * (ORDER - 1)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str | None) -> str:
    """Lower case, every run of other characters than letters one space; empty if no letter remains."""
    norm = _GAP.sub(" ", (text or "").lower()).strip()
    return norm if any(map(str.isalpha, norm)) else ""


def grams(joined: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Code points, and for n = 1..ORDER the hash of the n-gram that ends at each of them."""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    one = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    one ^= one >> np.uint64(29)
    found = [one]
    for _ in range(1, ORDER):
        longer = found[-1].copy()  # the n-gram's hash from the one without its last character
        longer[1:] = (found[-1][:-1] * _MULT + one[1:]) * np.uint64(0xBF58476D1CE4E5B9)
        longer[1:] ^= longer[1:] >> np.uint64(31)
        found.append(longer)
    return codes, found


def lay_out(texts: list[str]) -> tuple[str, np.ndarray]:
    """The texts with boundaries between them, and where each starts."""
    starts = np.cumsum([ORDER - 1] + [len(t) + ORDER - 1 for t in texts[:-1]]) if texts else np.empty(0, int)
    return _SEP + _SEP.join(texts) + _SEP, starts


@dataclass
class Model:
    langs: list[str]
    keys: list[np.ndarray]  # by order: sorted hashes
    logp: list[np.ndarray]  # by order: a row of log2-probabilities for each hash
    gamma: list[np.ndarray]  # by order of the context: a row of log2 back-off weights for each hash
    floor: np.ndarray  # log2 of an unseen character's probability in each language
    limits: dict[str, float] | None = None  # cross-entropy beyond which a text is rejected

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per character, a row a text and a column a language; the texts are normal and not empty."""
        out, at = np.empty((len(texts), len(self.langs))), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            joined, starts = lay_out(texts[at:end])
            codes, found = grams(joined)
            ends = starts + [len(t) for t in texts[at:end]]
            total = np.zeros((len(codes), len(self.langs)), np.float32)
            inside = np.flatnonzero(codes != 10)
            todo, extra = inside, np.zeros((len(inside), len(self.langs)), np.float32)
            for n in range(ORDER, 0, -1):
                where, hit = _find(self.keys[n - 1], found[n - 1][todo])
                total[todo[hit]] = self.logp[n - 1][where[hit]] + extra[hit]
                todo, extra = todo[~hit], extra[~hit]
                if n > 1 and len(todo):
                    where, hit = _find(self.keys[n - 2], found[n - 2][todo - 1])
                    extra[hit] += self.gamma[n - 2][where[hit]]
            total[todo] = self.floor + extra  # a character that no language has seen
            sums = np.add.reduceat(total, np.stack([starts, ends], 1).ravel(), axis=0, dtype=np.float64)[::2]
            out[at:end] = -sums / (ends - starts)[:, None]
            at = end
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    where = np.searchsorted(keys, wanted)
    where[where == len(keys)] = 0
    return where, keys[where] == wanted if len(keys) else np.zeros(len(wanted), bool)


def count_grams(sample: DataFrame) -> DataFrame:
    """``lang, n, h, prefix, suffix, c`` of the n-grams of every text of ``sample`` (columns lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                norm = [x for x in (normalise(texts[i]) for i in np.flatnonzero(langs == lang)) if x]
                if norm:
                    yield from _counted(lang, norm)

    flat = arrow_map(sample, run, "lang string, n int, h long, prefix long, suffix long, c long")
    return flat.groupBy("lang", "n", "h").agg(F.min("prefix").alias("prefix"), F.min("suffix").alias("suffix"), F.sum("c").alias("c"))


def _counted(lang: str, texts: list[str]) -> Iterator[pa.RecordBatch]:
    codes, found = grams(lay_out(texts)[0])
    inside = np.flatnonzero(codes != 10)
    # contexts that end in a boundary have no row of their own as the text's characters do
    edge = np.flatnonzero((codes == 10) & (np.arange(len(codes)) >= ORDER - 2) & np.r_[codes[1:] != 10, False])
    for n in range(1, ORDER + 1):
        at = inside
        h, first, counts = np.unique(found[n - 1][at], return_index=True, return_counts=True)
        at = at[first]
        prefix = found[n - 2][at - 1] if n > 1 else np.zeros(len(at), np.uint64)
        # the suffix drops the first character: it is the (n-1)-gram that ends at the same place
        suffix = found[n - 2][at] if n > 1 else np.zeros(len(at), np.uint64)
        if n < ORDER:
            more = different(found[n - 1][edge])
            h, prefix, suffix = (np.r_[x, y] for x, y in ((h, more), (prefix, np.zeros(len(more), np.uint64)), (suffix, np.zeros(len(more), np.uint64))))
            counts = np.r_[counts, np.zeros(len(more), np.int64)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(h)), pa.array(np.full(len(h), n, np.int32)), *(pa.array(x.view(np.int64)) for x in (h, prefix, suffix)), pa.array(counts)],
            ["lang", "n", "h", "prefix", "suffix", "c"],
        )


def train(sample: DataFrame) -> Model:
    """Fit the models; what comes to the driver is bounded by the sample's size."""
    table = count_grams(sample).toArrow()
    cols = {c: table.column(c).to_numpy() for c in ("n", "h", "prefix", "suffix", "c")}
    names = table.column("lang").to_pylist()
    langs = sorted(set(names))
    lang = np.searchsorted(langs, names) if names else np.empty(0, int)
    rows = []
    for n in range(1, ORDER + 1):
        own = cols["n"] == n
        keys, index = np.unique(cols["h"][own].view(np.uint64), return_inverse=True)
        counts = np.zeros((len(keys), len(langs)))
        counts[index, lang[own]] = cols["c"][own]
        link = np.zeros((2, len(keys)), np.uint64)
        seen = cols["c"][own] > 0
        for k, c in enumerate(("prefix", "suffix")):
            link[k, index[seen]] = cols[c][own][seen].view(np.uint64)
        rows.append((keys, counts, link))
    alphabet = int((rows[0][1].sum(1) > 0).sum()) + 1  # the characters that occur, and one for all others
    lower, logp, gammas = np.full((1, len(langs)), 1 / alphabet), [], []
    for n in range(1, ORDER + 1):
        keys, counts, link = rows[n - 1]
        if n < ORDER:  # how many characters come before the n-gram
            longer_keys, longer, longer_link = rows[n]
            use = counts * 0
            np.add.at(use, np.searchsorted(keys, longer_link[1][longer.sum(1) > 0]), longer[longer.sum(1) > 0] > 0)
            use = np.where(counts > 0, np.maximum(use, 1), 0)
        else:
            use = counts
        ones, twos = (use == 1).sum(0), (use == 2).sum(0)
        discount = np.where(ones > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5)
        if n == 1:
            context, below, k = np.zeros(len(keys), int), np.zeros(len(keys), int), 1
        else:
            live = counts.sum(1) > 0
            context, below = (np.where(live, np.searchsorted(rows[n - 2][0], x), 0) for x in link)
            k = len(rows[n - 2][0])
        total, kinds = np.zeros((k, len(langs))), np.zeros((k, len(langs)))
        np.add.at(total, context, use)
        np.add.at(kinds, context, use > 0)
        gamma = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        prob = np.maximum(use - discount, 0) / np.maximum(total, 1)[context] + gamma[context] * lower[below]
        gammas.append(np.log2(np.maximum(gamma, 1e-12)).astype(np.float32))
        logp.append(np.log2(np.maximum(prob, 1e-30)).astype(np.float32))
        lower = prob
    # boundary contexts are no n-grams to predict: they keep their place for the back-off weights only
    return Model(langs, [r[0] for r in rows], logp, gammas[1:], np.log2(1 / alphabet) + gammas[0][0])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, entropy, rejected`` for every row, from its whole text.

    ``score`` is the posterior of the chosen language under equal priors, at
    ``SCORE_CHARS`` characters' evidence at most, halved if the text is
    rejected.  A text that is null or has no letter, or any text if no
    language was learned, is ``und`` with score 0, a null entropy and
    ``rejected``.  Ties go to the first language in alphabetical order; a very
    long text is taken whole.  Repeated rows give repeated rows, an empty table
    an empty result; a null id is kept; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        limits = np.array([(known.limits or {}).get(x, np.inf) for x in known.langs])
        for batch in batches:
            norm = [normalise(t) for t in batch.column(1).to_pylist()]
            full = [i for i, t in enumerate(norm) if t] if known.langs else []
            langs, score, entropy, out = ["und"] * len(norm), np.zeros(len(norm)), np.full(len(norm), np.nan), np.ones(len(norm), bool)
            if full:
                h = known.entropies([norm[i] for i in full])
                best = h.argmin(1)
                least = h[np.arange(len(full)), best]
                weight = np.minimum([len(norm[i]) for i in full], SCORE_CHARS)[:, None]
                posterior = 1 / np.exp2(-np.minimum((h - least[:, None]) * weight, 1000)).sum(1)
                entropy[full], out[full] = least, least > limits[best]
                score[full] = np.where(out[full], posterior / 2, posterior)
                for i, b in zip(full, best, strict=True):
                    langs[i] = known.langs[b]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(score), pa.array(entropy, mask=np.isnan(entropy)), pa.array(out)], ["doc_id", "lang_pred", "score", "entropy", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, lang_pred string, score double, entropy double, rejected boolean")


def calibrate(model: Model, sample: DataFrame, share: float = 0.999, margin: float = 1.05) -> Model:
    """Set each language's rejection limit to ``margin`` times the ``share`` quantile of its training texts' entropy."""
    rows = identify(sample, model, id_col="lang_no").where("entropy is not null")
    got = rows.groupBy("lang_pred").agg(F.percentile_approx("entropy", share, 10000).alias("q")).collect()  # a row a language
    model.limits = {r["lang_pred"]: r["q"] * margin for r in got}
    return model


def fit(labelled: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train and calibrate on about ``most`` texts of each language; rows without language or text are left out."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    sample = bounded_sample(rows, "id", "lang", most).select("lang", "text").persist()
    model = calibrate(train(sample), sample.select(F.lit(0).alias("lang_no"), "text"))
    sample.unpersist()
    return model
