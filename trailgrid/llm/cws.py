"""Document fingerprints by consistent weighted sampling; DataFrame functions only.

A text is the weighted set of its words, each weighing its number of
occurrences.  For each of ``SAMPLES`` samples a word draws r and c from
Gamma(2, 1) and b from the uniform distribution, all from its hash; with its
weight w it gets t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1).  The
word of least a, with its t, is the sample.  Two texts share a sample with
the probability of their generalised Jaccard similarity, the sum of the lesser
weights over the sum of the greater ones.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SAMPLES = 32
#: Samples that one row works out; more make a method too long for the JVM's compiler.
CHUNK = 4
#: Documents of a run of neighbouring ids, about, while there are no more than ``RUNS`` runs, whose bounds the driver holds; then runs grow.
RUN_DOCS, RUNS = 500, 40_000
_BREAK = "[^a-z0-9\\x80-\\x{10FFFF}]+"


def words(text: Column) -> Column:
    """The words of a text in lower case; one empty word if it has none."""
    found = F.array_remove(F.split(F.lower(text), _BREAK), "")
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def _draw(k: int) -> list[dict[str, str]]:
    """SQL of the draws of a chunk's k-th sample for the salted word hash ``word``, in four layers.

    G from Gamma(4, 1) and an independent B from Beta(2, 2), the median of
    three uniforms, give r = G B and c = G (1 - B), which are independent and
    each from Gamma(2, 1), with one logarithm less than two draws.
    """

    def part(h: str, at: int) -> str:
        return f"((shiftrightunsigned({h}, {at}) & 65535) + 0.5D) * {2.0**-16}D"

    salt = random.Random(k).getrandbits(63)
    u, v, w = (f"({part(f'g{k}', 16 * i)})" for i in range(3))
    return [
        {f"h{k}": f"xxhash64(word ^ {salt}L)"},
        {f"g{k}": f"xxhash64(h{k})"},
        {f"s{k}": f"-ln({' * '.join(part(f'h{k}', 16 * i) for i in range(4))})", f"m{k}": f"greatest(least({u}, {v}), least(greatest({u}, {v}), {w}))", f"b{k}": part(f"g{k}", 48)},
        {f"r{k}": f"s{k} * m{k}", f"c{k}": f"ln(s{k} * (1D - m{k}))"},
    ]


def _sample(k: int, weight: str) -> str:
    """SQL of one long whose least value over the words is the sample: ln a above, word and t below."""
    t = f"floor({weight} / r{k} + b{k})"
    rank = f"cast(greatest(0D, least(127D, c{k} - r{k} * ({t} - b{k} + 1D) + 64D)) * 16777216D as bigint)"
    name = f"((h{k} ^ ({t} * 40503)) & 4294967295)"
    return f"min(shiftleft({rank}, 32) | {name})"


def signatures(terms: DataFrame, keys: list[str], weights: list[str], samples: int = SAMPLES) -> DataFrame:
    """For every ``keys`` an array of 32-bit samples for each weight column (named as it, with ``_fp``).

    ``terms``: keys, ``term`` (a long) and the weights, which are 0 where a
    set lacks the term.  Words of one hash count as one.  ``samples`` is a
    multiple of ``CHUNK``.
    """
    chunks = samples // CHUNK
    logs = terms.select(*keys, "term", *[F.when(F.col(w) > 0, F.ln(F.col(w).cast("double"))).alias(w) for w in weights])
    rows = logs.select(*keys, "term", *weights, F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    keys_and = [*keys, "chunk"]
    drawn = rows.select(*keys_and, *weights, F.xxhash64("term", "chunk").alias("word"))
    layers = [{n: e for k in range(CHUNK) for n, e in _draw(k)[i].items()} for i in range(4)]
    for new, kept in zip(layers, ([], ["h"], ["h"], ["h", "b"]), strict=True):
        old = [F.col(f"{n}{k}") for n in kept for k in range(CHUNK)]
        first = ["word"] if new is layers[0] else []
        drawn = drawn.select(*keys_and, *weights, *first, *old, *[F.expr(e).alias(n) for n, e in new.items()])
    least = drawn.groupBy(*keys_and).agg(*[F.expr(_sample(k, w)).alias(f"{w}{k}") for w in weights for k in range(CHUNK)])
    packed = least.select(*keys, F.struct("chunk", *[F.transform(F.array(*[f"{w}{k}" for k in range(CHUNK)]), lambda x: x.bitwiseAND(F.lit(4294967295))).alias(w) for w in weights]).alias("c"))
    lists = packed.groupBy(*keys).agg(F.array_sort(F.collect_list("c")).alias("c"))  # one entry a chunk
    return lists.select(*keys, *[F.flatten(F.col("c").getField(w)).alias(f"{w}_fp") for w in weights])


def likeness(a: Column, b: Column) -> Column:
    """The share of samples that two fingerprints have in common."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def hexadecimal(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def run_of(key: Column, tie: Column, cuts: list[int]) -> Column:
    """Number of the run of a row, for sorted bounds; found in two steps, among blocks of bounds and in a block.

    A key that takes up several bounds has as many runs, among which ``tie``
    (a hash) deals its rows in its order.
    """
    bounds = sorted(set(cuts))
    first = {b: cuts.index(b) for b in bounds}
    size = max(1, round(len(bounds) ** 0.5))
    blocks = [bounds[i : i + size] for i in range(0, len(bounds), size)]

    def below(values: list[int]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, values)).cast("array<bigint>"), lambda b: b < key))

    # the number of bounds, repeats counted, that lie below the key
    before = F.lit(len(cuts))
    if bounds:
        inside = F.array(*[F.array(*[F.struct(F.lit(b).cast("long").alias("b"), F.lit(first[b]).alias("n")) for b in block]) for block in blocks])
        block = F.get(inside, below([b[-1] for b in blocks]))
        before = F.coalesce(F.get(F.filter(block, lambda s: s["b"] >= key), F.lit(0))["n"], F.lit(len(cuts)))
    hot = {b: k for b in bounds if (k := cuts.count(b)) > 1}
    if not hot:
        return before.cast("int")
    share = F.shiftrightunsigned(tie.bitwiseXOR(F.lit(-(1 << 63))), 1) / F.lit(float(1 << 63))
    kinds = F.coalesce(F.try_element_at(F.map_from_arrays(F.array(*map(F.lit, hot)).cast("array<bigint>"), F.array(*map(F.lit, hot.values()))), key), F.lit(1))
    return (before + F.least(F.floor(share * kinds), kinds - 1)).cast("int")


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``run, n, doc_id, text, next_text``: each row with the text of the next one in ascending doc_id order.

    The last row's next is the first.  Null ids come first, rows of one id in
    the order of their texts' hashes; a null text is empty.  Rows are dealt by
    runs of neighbouring ids, whose bounds are approximate quantiles; each
    run's last row takes the first text of the run after it from a table of
    one row a run.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("tie"))
    runs = max(1, min(RUNS, -(-docs.count() // RUN_DOCS)))
    cuts = rows.agg(F.percentile_approx("key", [i / runs for i in range(1, runs)], 20 * runs)).first()[0] if runs > 1 else None
    order = Window.partitionBy("run").orderBy("key", "tie", "text")
    placed = rows.withColumn("run", run_of(F.col("key"), F.col("tie"), sorted(cuts or []))).select("run", "doc_id", "text", F.row_number().over(order).alias("n"), F.lead("text").over(order).alias("after"))
    heads = placed.where("n = 1").select("run", "text")
    around = Window.orderBy("run")  # one row a run
    heads = heads.select(F.col("run").alias("r"), F.coalesce(F.lead("text").over(around), F.first("text").over(around)).alias("head"))
    return placed.join(heads, F.col("run") == F.col("r"), "left").select("run", "n", "doc_id", "text", F.coalesce("after", "head").alias("next_text"))


def edited_text() -> tuple[Column, Column, Column]:
    """What stays of ``text``, the edited text, and the number of code points."""
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    head = F.substring(F.col("text"), F.lit(1), n - q)
    return head, F.concat(head, F.substring(F.col("next_text"), F.lit(1), q)), n


def compare_edited(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, as ``doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next``.

    The edited text is the text with its last quarter replaced by as many
    first characters of the next document.  A null or empty text has the
    fingerprint of the empty word.  Repeated rows give repeated rows; other
    columns are ignored.  Words in which both texts agree are counted once.
    """
    rows = neighbours(docs, id_col, text_col)
    head, edited, n_chars = edited_text()
    both = rows.select("run", "n", words(F.col("text")).alias("a"), words(edited).alias("e"), (F.size(words(head)) - 1).alias("m"))
    both = both.select("run", "n", "m", F.size("a").alias("s"), F.posexplode(F.concat("a", F.slice("e", F.col("m") + 1, F.size("e")))).alias("pos", "word"))
    terms = both.select("run", "n", F.xxhash64("word").alias("term"), (F.col("pos") < F.col("s")).cast("int").alias("own"), ((F.col("pos") < F.col("m")) | (F.col("pos") >= F.col("s"))).cast("int").alias("new"))
    counted = terms.groupBy("run", "n", "term").agg(F.sum("own").alias("own"), F.sum("new").alias("new"))
    found = materialize(signatures(counted, ["run", "n"], ["own", "new"], samples), "fingerprints")
    named = rows.select("run", "n", "doc_id", n_chars.cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"))
    order = Window.partitionBy("run").orderBy("n")
    around = Window.orderBy("run")
    heads = found.where("n = 1").select(F.col("run").alias("r"), F.coalesce(F.lead("own_fp").over(around), F.first("own_fp").over(around)).alias("head"))
    ahead = found.withColumn("after", F.lead("own_fp").over(order)).join(heads, F.col("run") == F.col("r"), "left").select("run", "n", "own_fp", "new_fp", F.coalesce("after", "head").alias("next_fp"))
    joined = named.join(ahead, ["run", "n"])
    return joined.select("doc_id", "n_chars", "edited_sha256", F.col("own_fp").alias("fp"), F.col("new_fp").alias("edited_fp"), likeness(F.col("own_fp"), F.col("new_fp")).alias("near_edited"), likeness(F.col("own_fp"), F.col("next_fp")).alias("near_next"))
