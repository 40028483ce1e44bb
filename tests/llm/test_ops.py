"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats and odd columns."""

import collections
import hashlib
import itertools
import math
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from trailgrid.llm import components, cws, decontaminate, langid, lm, quality, records, simhash, simhash_wide, substring, urls, wfst
from trailgrid.llm.queries import URL_RULES, tokenizer
from trailgrid.plans import store

BPE, PIECES = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
DOCS = "doc_id long, text string, score string, fp string, items string, n_pieces string"
ODD = [None, "", "  \n ", "Word", "a b c", "A  B\tc", "naïve café 東京", "x" * 300, "one two three. " * 2000, "a b c"]


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "own", "own", "own", "own") for i, t in zip(ids if ids is not None else range(len(texts)), texts, strict=True)], DOCS)


def words_of(t):
    return (t or "").encode().lower().split()


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(7)
    vocab = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocab, rng.integers(20, 200))) for _ in range(60)]
    texts += texts[:10] + [t.replace(t.split()[5], "zz", 1) for t in texts[:10]]
    return texts


# --- 1


def brute_lm(texts, order, least, backoff):
    toks = [words_of(t) for t in texts]
    count = collections.Counter(tuple(w[i : i + n]) for w in toks for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, toks))

    def s(gram):
        if len(gram) == 1:
            return math.log(count[gram] / total)
        return math.log(count[gram] / count[gram[:-1]]) if count[gram] >= least else math.log(backoff) + s(gram[1:])

    return [(len(w), sum(s(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w)))) for w in toks]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(spark, corpus, order):
    texts = corpus + ODD
    got = sorted(tuple(r) for r in lm.score_documents(docs(spark, texts).repartition(3), order, 2, 0.4, block_words=500).collect())
    want = brute_lm(texts, order, 2, 0.4)
    assert [g[:2] for g in got] == [(i, w[0]) for i, w in enumerate(want)]
    assert [g[2] for g in got] == pytest.approx([w[1] for w in want], abs=1e-6)
    assert lm.score_documents(docs(spark, [])).count() == 0
    rows = sorted(tuple(r) for r in lm.score_rows(docs(spark, texts).repartition(3), order, 2, 0.4).collect())
    assert [g[:2] for g in rows] == [g[:2] for g in got] and [g[2] for g in rows] == pytest.approx([g[2] for g in got], abs=1e-6)
    nulls = sorted(r["n_words"] for r in lm.score_documents(docs(spark, ["a b", "a b", None], [None, None, 1]), order).collect())
    assert nulls == [0, 2, 2]


def test_lm_count_table(spark, corpus):
    n = sum(max(0, len(words_of(t)) - k) for t in corpus for k in range(3))
    assert lm.count_table(docs(spark, corpus)).agg(F.sum("n")).first()[0] == n


def test_lm_notices_a_changed_table():
    words, starts = np.arange(1, 9, dtype=np.uint64) * np.uint64(1 << 40), np.array([0, 5])
    _, found, counts = lm._different(words, starts, 2)
    got = [{"payload": lm._shrink(counts), "digest": int(found[:-1].sum(dtype=np.uint64)), "words": 8}]
    row = {"keys": [1, 2], "lengths": lm._shrink(np.array([5, 3])), "different": words.astype("<u8").tobytes(), "index": lm._shrink(np.arange(8))}
    with pytest.raises(ValueError):
        lm.score_block(row, got, 2, 2, 0.4)


def test_lm_find_equals_search():
    found = np.unique(np.random.default_rng(2).integers(1, 1 << 63, 5000, np.uint64) * np.uint64(2))
    assert (lm._find(found, found[::-1]) == np.arange(len(found))[::-1]).all()


def test_lm_packing():
    h = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000, np.uint64) * np.uint64(2))
    assert (lm._unpack(lm._pack(h)) == h).all() and (lm._grow(lm._shrink(np.arange(70000))) == np.arange(70000)).all()


# --- 2


def test_language_models(spark):
    rng = np.random.default_rng(1)
    make = {"aa": list("abcde  "), "bb": list("vwxyz  ")}
    rows = [(int(i), "".join(rng.choice(make[lang], 200)), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    rows += [(100, None, "aa"), (101, "text", None), (None, "x", "bb")]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(train)
    got = {r["doc_id"]: r for r in langid.identify(docs(spark, ["bad decade", "wxyz vyz", None, "12 !?", "", "½"]), model).collect()}
    assert [got[i]["lang_pred"] for i in range(6)] == ["aa", "bb", "und", "und", "und", "und"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[2]["rejected"]
    odd = langid.identify(docs(spark, ["äöü ñññ ßßß"]), model).first()
    assert odd["rejected"] and odd["lang_pred"] in ("aa", "bb")
    assert langid.identify(docs(spark, ["abc"]), langid.fit(train.where("false"))).first()["lang_pred"] == "und"


def brute_kneser_ney(texts, order):
    """P(character | context) by the textbook's sums, for one language."""
    pad = "\n" * (order - 1)
    seen = collections.Counter(x[i - n + 1 : i + 1] for t in texts for x in [pad + t] for i in range(order - 1, len(x)) for n in range(1, order + 1))
    use = {g: c if len(g) == order else max(1, sum(1 for h in seen if len(h) == len(g) + 1 and h[1:] == g)) for g, c in seen.items()}
    discount = {}
    for n in range(1, order + 1):
        ones, twos = (sum(1 for g, c in use.items() if len(g) == n and c == k) for k in (1, 2))
        discount[n] = ones / (ones + 2 * twos) if ones else 0.5
    alphabet = sum(1 for g in seen if len(g) == 1) + 1

    def p(c, context):
        n = len(context) + 1
        lower = p(c, context[1:]) if context else 1 / alphabet
        after = [k for g, k in use.items() if len(g) == n and g[:-1] == context]
        if not after:
            return lower
        return max(use.get(context + c, 0) - discount[n], 0) / sum(after) + discount[n] * len(after) / sum(after) * lower

    return p


def test_language_model_against_the_textbook(spark):
    texts = ["abracadabra", "banana band", "cab", "a cab ran"]
    model = langid.fit(spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "doc_id long, text string, lang string"))
    p = brute_kneser_ney(texts, langid.ORDER)
    for t in ("ban a cab", "zabra", "rrrr", "nd"):
        padded = "\n" * (langid.ORDER - 1) + t
        want = -sum(math.log2(p(padded[i], padded[i - langid.ORDER + 1 : i])) for i in range(langid.ORDER - 1, len(padded))) / len(t)
        assert model.entropies([t])[0, 0] == pytest.approx(want, abs=1e-4)
    letters = sorted(set("".join(texts))) + ["z"]  # all others are like z
    assert sum(p(c, "ban") for c in letters) == pytest.approx(1) and sum(p(c, "zzz") for c in letters) == pytest.approx(1)


def test_language_odd_tables(spark):
    model = langid.fit(spark.createDataFrame([(i, t, "l") for i, t in enumerate(["abc def", "fed cba"])], "doc_id long, text string, lang string"))
    assert langid.identify(docs(spark, []), model).count() == 0
    got = langid.identify(docs(spark, ["abc", "abc", "abc " * 50000, None], [None, 1, 2, 3]), model).collect()
    assert len(got) == 4 and sum(r["lang_pred"] == "l" for r in got) == 3 and len({r["entropy"] for r in got if r["doc_id"] != 2}) == 2
    two = langid.fit(spark.createDataFrame([(i, "same words", lang) for i, lang in enumerate("ba")], "doc_id long, text string, lang string"))
    assert langid.identify(docs(spark, ["same"]), two).first()["lang_pred"] == "a"


# --- 3


def brute_fingerprint(t, width=3):
    w = words_of(t)
    runs = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(n, near):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if near(i, j):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("radius,tile", [(2, 4096), (2, 4), (5, 4096)])
def test_simhash_components(spark, corpus, radius, tile):
    texts = corpus + ODD + ["a b c d"] * 3
    fps = [brute_fingerprint(t) for t in texts]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, texts), radius=radius, tile_rows=tile).collect()}
    assert [got[i]["fp"] % (1 << 64) for i in range(len(texts))] == fps
    assert [got[i]["component_id"] for i in range(len(texts))] == brute_components(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= radius)


def test_simhash_links_of_close_numbers(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, np.int64)
    fps = np.unique(np.concatenate([base, base ^ (1 << rng.integers(0, 63, 40)), base ^ (1 << rng.integers(0, 63, 40)) ^ (1 << rng.integers(0, 63, 40))]))
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long"), 2, tile_rows=3)
    roots = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    want = brute_components(len(fps), lambda i, j: int(fps[i] ^ fps[j]).bit_count() <= 2)
    assert [roots.get(int(f), int(f)) for f in fps] == [int(fps[r]) for r in want]


def test_simhash_odd_rows(spark):
    found = simhash.near_duplicates(docs(spark, ["a b", "a b", "c d"], [None, 5, 5]))
    assert {(r["doc_id"], r["component_id"]) for r in found.collect()} >= {(None, 5), (5, 5)}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(50)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_wide_simhash_finds_near_copies(spark):
    rng = np.random.default_rng(3)
    vocab = ["".join(rng.choice(list("abcdefghijklm"), 6)) for _ in range(3000)]
    base = [list(rng.choice(vocab, 240)) for _ in range(80)]
    near = [list(b) for b in base[:30]]
    for b in near:
        for k in rng.choice(240, 3, replace=False):
            b[k] = "edited"
    texts = [" ".join(x) for x in base + near + base[:5]] + [None, "", "short one"]
    got = {r["doc_id"]: r["component_id"] for r in simhash_wide.near_copies(docs(spark, texts)).collect()}
    assert sum(got[80 + i] == i for i in range(30)) >= 29
    assert all(got[110 + i] == i for i in range(5)) and all(got[i] == i for i in range(80)) and got[116] == got[115] == 115


def test_nearest_before_equals_search():
    assert [simhash_wide.plan(n, 0.8) for n in (10, 10**8, 1 << 30)] == [(14, 51), (15, 60), (18, 100)]
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (700, simhash_wide.PART), np.uint64)
    base[350:] = base[:350] ^ (np.uint64(1) << rng.integers(0, 60, (350, simhash_wide.PART), np.uint64))
    u, v = simhash_wide.nearest_before(np.arange(700), base, 8)
    assert {frozenset(p) for p in zip(u.tolist(), v.tolist(), strict=True)} == {frozenset((i, i + 350)) for i in range(350)}


@pytest.mark.parametrize("n", [5, 60])
def test_wide_links_join_a_star(n):
    """Copies that come before their base, like it but not like one another: all are linked to it, not the nearest alone."""
    rng = np.random.default_rng(5)
    ones = np.ones((n + 1, 64 * simhash_wide.PART), np.uint8)
    for row in ones[:n]:
        row[rng.choice(ones.shape[1], 40, replace=False)] = 0
    fps = np.packbits(ones, axis=1).view("<u8")
    apart = np.bitwise_count(fps[:n, None] ^ fps[None, :n]).sum(2)[np.triu_indices(n, 1)]
    assert apart.min() > 45
    batch = pa.RecordBatch.from_arrays([pa.array([0] * (n + 1), pa.int64()), pa.array(range(n + 1)), *(pa.array(x) for x in fps.view(np.int64).T)], ["g", "id", *(f"f{w}" for w in range(fps.shape[1]))])
    links = [(u, v) for b in simhash_wide._compare(iter([batch]), 45) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    reached, size = {n}, 0
    while len(reached) > size:
        size = len(reached)
        reached |= {x for link in links if reached & set(link) for x in link}
    assert reached == set(range(n + 1)) and len(links) == n


def test_wide_links_have_the_asked_similarity(spark):
    """Pairs somewhat below 0.8, of like fingerprints, stay apart; pairs at 0.8 and above are found."""
    base = [[f"t{p}w{i}" for i in range(236)] for p in range(80)]  # 232 shingles, and k edits far apart change 5 k of them
    edited = [[f"e{i}" if i % 18 == 9 and i // 18 < (6 if p < 40 else 5) else w for i, w in enumerate(b)] for p, b in enumerate(base)]
    sets = [simhash_wide.shingle_set(" ".join(x).encode()) for x in base + edited]
    jaccard = [len(np.intersect1d(sets[p], sets[p + 80])) / len(np.union1d(sets[p], sets[p + 80])) for p in range(80)]
    assert max(jaccard[:40]) < 0.78 and min(jaccard[40:]) > 0.8
    got = {r["doc_id"]: r["component_id"] for r in simhash_wide.near_copies(docs(spark, [" ".join(x) for x in base + edited])).collect()}
    assert all(got[p + 80] == p + 80 for p in range(40)) and sum(got[p + 80] == p for p in range(40, 80)) >= 38
    labels = simhash_wide.similar([np.arange(a, b, dtype=np.uint64) for a, b in ((0, 10), (2, 10), (0, 8), (3, 10), (50, 60))], 0.8)
    assert labels[0] == labels[1] == labels[2] == labels[3] != labels[4]


def test_wide_large_families_are_cut(spark, monkeypatch):
    """Tiles of few texts and few shingles give the same groups."""
    texts = [" ".join(f"t{d}w{i}" if i % 40 or k == 0 else f"e{k}x{i}" for i in range(120)) for d in range(6) for k in range(5)]
    ids = np.random.default_rng(1).permutation(len(texts)).tolist()
    found = []
    for rows, shingles in ((4096, 500_000), (3, 300)):
        monkeypatch.setattr(simhash_wide, "TILE_ROWS", rows)
        monkeypatch.setattr(simhash_wide, "TILE_SHINGLES", shingles)
        found.append(sorted((r["doc_id"], r["component_id"]) for r in simhash_wide.near_copies(docs(spark, texts, ids)).collect()))
    sets = [simhash_wide.shingle_set(t.encode()) for t in texts]
    want = brute_components(len(texts), lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])))
    groups = {r: min(ids[i] for i in range(len(texts)) if want[i] == r) for r in want}
    assert found[0] == found[1] == sorted((ids[i], groups[want[i]]) for i in range(len(texts))) and len(groups) < len(texts)


def test_links_stay_in_their_class():
    """Sets of different sizes in any order: every link joins two similar sets, and all similar sets are joined."""
    rng = np.random.default_rng(15)
    for _ in range(50):
        bases = [rng.integers(0, 1 << 62, rng.integers(5, 60)).astype(np.uint64) for _ in range(6)]
        sets = [np.unique(np.r_[b, rng.integers(0, 1 << 62, rng.integers(0, 1 + len(b) // 10)).astype(np.uint64)]) for b in bases for _ in range(rng.integers(1, 4))]
        sets = [sets[i] for i in rng.permutation(len(sets))]
        ids = rng.permutation(1000)[: len(sets)].astype(np.int64)
        root = brute_components(len(sets), lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])))
        least = {r: min(ids[i] for i in range(len(sets)) if root[i] == r) for r in root}
        u, v = simhash_wide.forest(ids, simhash_wide.similar(sets, 0.8))
        assert sorted(zip(u.tolist(), v.tolist(), strict=True)) == sorted((int(ids[i]), int(least[root[i]])) for i in range(len(sets)) if ids[i] != least[root[i]])


def test_wide_links_of_a_repeated_line(spark):
    """Texts whose shingles are mostly one line, over and over, and which share nothing else, stay apart."""
    line = "one line that stands on every page of the site "
    texts = [line * 60 + " ".join(f"d{d}w{i}" for i in range(60)) for d in range(3)]
    assert [r["component_id"] for r in simhash_wide.near_copies(docs(spark, texts)).orderBy("doc_id").collect()] == [0, 1, 2]


# --- 4


def test_records_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    texts = ODD + ["don't we're", "a\u00a0b", "x\n y", "tail ", "<|endoftext|> z", "3.14, ok... \"q\""]
    ids = [7, 3, None, 12, 1, 9, 2, 30, 21, 3, 40, 41, 42, 43, 44, 45]
    out = str(tmp_path / "rec")
    manifest = records.write_records(docs(spark, texts, ids), BPE, out, end_id=2, shard_docs=2, task_docs=5)
    assert manifest.count() > 1
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], tuple(r["ids"])) for r in records.read_records(manifest, out, with_ids=True).collect()), key=lambda x: x[0])
    want = {}
    for i, t in zip(ids, texts, strict=True):
        want.setdefault(i, []).append(tuple(tok.encode(t or "", add_special_tokens=False).ids + [2]))
    at = 0
    assert [g[1] for g in got] == sorted(ids, key=lambda i: -1 if i is None else i)
    for start, doc_id, n, crc, seq in got:
        assert start == at and n == len(seq) and crc == zlib.crc32(np.array(seq, "<u4").tobytes()) and seq in want[doc_id]
        at += n
    assert records.read_at(out, 0, 0, 0)[0] is None
    empty = str(tmp_path / "none")
    assert records.read_records(records.write_records(docs(spark, []), BPE, empty), empty).count() == 0


def test_records_of_one_id_are_split(spark, tmp_path):
    texts = [f"text {i}" for i in range(40)]
    out = str(tmp_path / "hot")
    manifest = records.write_records(docs(spark, texts, [None] * 20 + [7] * 20), BPE, out, shard_docs=4, task_docs=5)
    assert manifest.select("part").distinct().count() >= 6 and manifest.agg(F.max("n_docs"), F.sum("n_docs")).first()[:] == (4, 40)
    got = sorted(tuple(r) for r in records.read_records(manifest, out).select("start", "doc_id", "n_tokens").collect())
    assert [g[1] for g in got] == [None] * 20 + [7] * 20 and [g[0] for g in got] == np.cumsum([0] + [g[2] for g in got])[:-1].tolist()


def test_records_notice_damage():
    data = records.frame(5, np.arange(9, dtype="<u2").tobytes(), False)
    doc_id, ids, end = records.unframe(data)
    assert (doc_id, ids.tolist(), end) == (5, list(range(9)), len(data))
    for at in (0, 9, 20, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(broken))
    with pytest.raises(ValueError):
        records.unframe(data[:-3])


# --- 5


def brute_contamination(text, items, width):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "")
    w, hit, names = pattern.findall(low(text)), set(), set()
    for name, t in items:
        iw = pattern.findall(low(t))
        for k in range(max(min(1, len(iw)), len(iw) - width + 1)):
            run = iw[k : k + width]
            for i in range(len(w) - len(run) + 1):
                if w[i : i + len(run)] == run:
                    hit.update(range(i, i + len(run)))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("bound", [10**6, 60])
def test_contamination(spark, bound):
    items = [(1, "The quick, brown fox jumps"), (2, "Fox jumps over É the lazy dog again and again"), (10, "tiny"), (3, None), (4, "!!"), (1, "The quick, brown fox jumps"), (None, "ghost")]
    texts = ODD + ["A QUICK BROWN FOX JUMPS over é the lazy", "the quick brown fox, jumps over É the lazy dog again and again", "Tiny-tiny TINY", "fox jumps over é the"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs(spark, texts), bench, 4, automaton_bytes=bound).collect()}
    known = [x for x in items if x[0] is not None]
    for i, t in enumerate(texts):
        n, hit, names = brute_contamination(t, known, 4)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (n, hit, names), t
    assert [texts[12][s["start"] : s["end"]] for s in got[12]["spans"]] == ["Tiny-tiny TINY"]
    span = got[10]["spans"][0]
    assert texts[10][span["start"] : span["end"]].startswith("QUICK")
    assert decontaminate.contamination(docs(spark, texts), bench.where("false")).agg(F.sum("n_hit")).first()[0] == 0
    odd = docs(spark, texts).withColumns({"_w": F.lit("own"), "ranges": F.lit("own")})
    kept = decontaminate.contamination(odd, bench, 4, keep=True, automaton_bytes=bound)
    assert set(odd.columns) <= set(kept.columns) and {r["doc_id"]: r["n_hit"] for r in kept.collect()} == {i: r["n_hit"] for i, r in got.items()}
    assert kept.where("_w = 'own' and ranges = 'own'").count() == len(texts)


# --- 6


def test_units_join_to_the_text(corpus):
    for t in [*corpus, *filter(None, ODD), "A. b!? c\n\nd e", ".", "w " * 100]:
        assert "".join(p for p, _, _ in substring.units(t)) == t
        assert all(n <= 2 * substring.UNIT_WORDS for _, _, n in substring.units(t))


def test_repeated_passages_stay_once(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    sentence = lambda: " ".join(word() for _ in range(9)) + ". "
    passage = "".join(sentence() for _ in range(6))
    own = ["".join(sentence() for _ in range(4)) for _ in range(6)]
    texts = [own[0], own[1] + passage, passage.upper() + own[2], own[3] + passage + own[4] + passage, passage, None, "", own[5]]
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs(spark, texts)).collect()}
    bare = lambda t: t if t is None else " ".join(t.split())  # noqa: E731  a sentence's leading space goes with it
    assert [bare(got[i]["text"]) for i in range(8)] == list(map(bare, [own[0], own[1] + passage, own[2], own[3] + own[4], "", None, "", own[5]]))
    assert got[4]["n_removed"] == got[4]["n_units"] == 6 and got[0]["score"] == "own"
    long_line = " ".join(word() for _ in range(60))
    line = {r["doc_id"]: r["text"] for r in substring.remove_repeats(docs(spark, [long_line, "Start here. \n" + long_line])).collect()}
    assert line == {0: long_line, 1: "Start here. \n"} or line[1].strip() == "Start here."
    inside = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(docs(spark, [f"{word()} {word()} {long_line}", f"{word()} {long_line} {word()} {word()}"])).collect()}
    assert inside[0] == 0 and inside[1] >= 3
    assert substring.remove_repeats(docs(spark, [])).count() == 0
    odd = substring.remove_repeats(docs(spark, [passage, passage, passage], [None, 4, 4])).collect()
    assert sorted((r["doc_id"] is None, len(r["text"].strip())) for r in odd) == [(False, len(passage) - 1), (False, len(passage) - 1), (True, 0)]


def brute_repeats(texts):
    """Units that go from each text, for texts whose sentences have 16 words at most; every run of every length is tried."""
    cut = [[" ".join(x.lower().split()) for x in re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", t) if x.split()] for t in texts]

    def fits(x):
        n = sum(len(u.split()) for u in x)
        return len(x) > 1 and n >= 20 or len(x) > 2 and n >= 12

    def spans(x):
        return [(a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1) if fits(x[a:b])] or [(0, len(x))] * bool(x)

    gone = []
    for d, x in enumerate(cut):
        out = set()
        for a, b in spans(x):
            for e, y in enumerate(cut[: d + 1]):
                alike = [(p, q) for p, q in spans(y) if y[p:q] == x[a:b] and (e < d or p < a) and (fits(x[a:b]) or not any(map(fits, (x, y))))]
                if alike:
                    out.update(range(a, b))
        gone.append(len(out))
    return gone


def test_repeats_against_a_search(spark):
    rng = np.random.default_rng(11)
    pool = [" ".join(rng.choice(list("abcdefghijklmnop"), rng.integers(1, 12))) for _ in range(25)]
    texts = ["".join(rng.choice(pool) + rng.choice([". ", "\n", "! "]) for _ in range(rng.integers(0, 12))) for _ in range(40)]
    for a, b in ((0, 30), (3, 31), (5, 5)):  # shared passages
        texts[b] += texts[a]
    got = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(docs(spark, texts)).collect()}
    assert [got[i] for i in range(40)] == brute_repeats(texts) and sum(got.values()) > 10


def test_repeats_leave_little_on_disk(spark):
    """Neither the runs' hashes nor the files of their shuffles are there when the texts are dealt."""
    passage = " ".join(f"w{i}" for i in range(60)) + ". "
    files = lambda: set(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(";").split(";"))
    before, made = files(), set(store._made)
    got = substring.remove_repeats(docs(spark, [passage, passage + "Own words.", "Others."]))
    for _ in range(50):  # the executors delete them on their own time
        if not (left := {f for f in files() - before if "shuffle_" in f}):
            break
        time.sleep(0.1)
    assert not left
    assert [p.rpartition("/")[2].rpartition("-")[0] for p in store._made if p not in made] == ["spans-taken"]
    assert [r["n_removed"] > 0 for r in got.orderBy("doc_id").collect()] == [False, True, False]


def test_repeats_odd_rows(spark):
    p = "One sentence that has quite a number of words in it. Another one that follows it at once, and is long. The third of them."
    rows = docs(spark, [p, "Other words here. " + p, p.upper(), "Two words.", "Two words.", "long " * 3000 + "."], [None, None, 3, 4, 5, 6]).withColumns({c: F.lit("own") for c in ("_d", "_key", "_taken", "key", "taken", "other", "h")})
    got = substring.remove_repeats(rows).collect()
    assert all(r["_taken"] == r["taken"] == r["h"] == "own" for r in got) and len(got) == 6
    left = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"], r["n_sentences"]) for r in got)
    assert [x[:3] for x in left[:3]] == [(False, 3, 0), (False, 4, 0), (False, 5, 1)] and left[0][3] == 3
    assert [x[2] for x in left[4:]] == [3, 3]  # rows without an id come after all others


@pytest.mark.parametrize("most", [1, 2, 3])
def test_passages_of_short_sentences_go(spark, most):
    rng = np.random.default_rng(most)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    sentence = lambda: " ".join(word() for _ in range(rng.integers(1, most + 1))) + rng.choice([". ", "\n", "! "])
    passage = ""
    while len(passage.split()) < 60:
        passage += sentence()
    own = ["Words that stand in one document alone, the first. ", "Others are in the second document and nowhere else. "]
    got = {r["doc_id"]: r["text"] for r in substring.remove_repeats(docs(spark, [own[0] + passage, own[1] + passage, passage + own[1]])).collect()}
    assert got[0] == own[0] + passage and [got[1].split(), got[2].split()] == [own[1].split()] * 2
    for _ in range(200):  # against a search: the least runs from each piece on and up to each piece
        sizes = rng.integers(1, most + 5, rng.integers(0, 30)).tolist()
        fits = {(a, b) for b in range(len(sizes) + 1) for a in range(b) if b - a > 1 and sum(sizes[a:b]) >= substring.PAIR_WORDS or b - a > 2 and sum(sizes[a:b]) >= substring.SPAN_WORDS}
        least = {(a, b) for a, b in fits if (a, b - 1) not in fits or (a + 1, b) not in fits} or {(0, len(sizes))} - {(0, 0)}
        found = [(s[0], s[-1] + 1) for _, s in substring.runs([("", f"{i}", n) for i, n in enumerate(sizes)])]
        assert len(found) == len(set(found)) and set(found) == least
    lone = [(r["doc_id"], r["n_removed"]) for r in substring.remove_repeats(docs(spark, ["a. b. c. d.", "a. b. c. d.", "a. b. c. d. e."])).collect()]
    assert sorted(lone) == [(0, 0), (1, 4), (2, 0)]  # texts too short for a run are one run as a whole


# --- 7


def test_transducer_equals_the_library(spark, corpus):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    t = wfst.transducer(PIECES)
    rng = np.random.default_rng(6)
    made = ["".join(rng.choice(list("ab ▁\n é日thein,.0 "), rng.integers(1, 50))) for _ in range(400)]
    for x in [*corpus[:20], *[o for o in ODD if o is not None], *made, "  lead", "trail  ", "a\x00b", "😀 ok", "don't"]:
        ids = t.ids_of(t.encode(x)).tolist()
        assert ids == sp.encode(x), x
        if "▁" not in x:
            assert t.decode(ids) == x
    got = {r["doc_id"]: r for r in wfst.encode_documents(docs(spark, ODD), PIECES).collect()}
    assert all(r["round_trip"] for r in got.values()) and got[0]["n_pieces"] == 0 and got[3]["pieces"] == sp.encode("Word")
    assert wfst.encode_documents(docs(spark, []), PIECES).count() == 0


def all_paths(t, text):
    """Ids and weight of every path through the lattice, by trying all arcs."""
    def go(i, before):
        if i == len(text):
            yield [], 0.0
            return
        for j, piece, weight in t.arcs(text, i):
            if t.model == wfst.BPE and before >= 0 and piece >= 0 and not t.beside(before, piece):
                continue
            for ids, rest in go(j, piece):
                yield [*([piece] if piece >= 0 else t._fallback(text[i])), *ids], weight + rest
    return list(go(0, -1))


def test_bpe_lattice_has_one_path():
    t = wfst.transducer(PIECES)
    rng = np.random.default_rng(12)
    for x in [*("".join(rng.choice(list("abeinrst,▁é1日"), rng.integers(1, 11))) for _ in range(150)), "▁internation", "▁▁▁▁▁a", "unhappiness"]:
        paths = all_paths(t, x)
        assert len(paths) == 1 and paths[0][0] == t.shortest(x), x


def test_unigram_lattice_takes_the_best_path():
    t = wfst.Transducer(["<unk>", "a", "b", "ab", "▁", "▁a", "aba", "[X]"], [0, -1.0, -1.2, -1.5, -1.0, -2.5, -3.6, 0.0], [wfst.UNKNOWN, 1, 1, 1, 1, 1, 1, wfst.USER], wfst.UNIGRAM, False, True, False)
    t._compile()
    assert [t.pieces[i] for i in t.ids_of(t.encode("ab"))] == ["▁", "ab"]
    assert [t.pieces[i] for i in t.ids_of(t.encode("aqqb"))] == ["▁", "a", "<unk>", "b"]
    assert [t.pieces[i] for i in t.ids_of(t.encode("a[X]b"))] == ["▁", "a", "[X]", "b"]
    rng = np.random.default_rng(13)
    for _ in range(100):
        x = "▁" + "".join(rng.choice(list("abq"), rng.integers(1, 9)))
        paths = sorted((w, ids) for ids, w in all_paths(t, x))
        weight = sum(t.weights[i] if i else t.unknown_weight for i in t.shortest(x))
        assert weight == pytest.approx(paths[0][0])


def test_user_pieces_of_a_merging_model():
    t = wfst.Transducer(["<unk>", "a", "b", "ab", "▁", "<t>", "abab"], [0, -3.0, -4.0, -1.0, -5.0, 0.0, -2.0], [wfst.UNKNOWN, 1, 1, 1, 1, wfst.USER, wfst.UNUSED], wfst.BPE, False, False, False)
    t._compile()
    assert [t.pieces[i] for i in t.ids_of(t.encode("ab<t>abab"))] == ["ab", "<t>", "ab", "ab"]


def test_charsmap_equals_the_library():
    import sentencepiece

    for rule in ("nmt_nfkc", "nfkc_cf"):
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        rules = dict(wfst._fields(dict(wfst._fields(library.serialized_model_proto()))[3]))[2]
        t = wfst.Transducer(["<unk>"], [0.0], [wfst.UNKNOWN], wfst.UNIGRAM, False, True, True, charsmap=wfst.Charsmap(rules))
        t._compile()
        for x in ("Ｆｕｌｌ ｗｉｄｔｈ①", "e\u0301 ﬁne  x\u00a0y\tz", "한국어 가", "  ½ Å ", "plain", "A\u200bB", "ｶﾞ"):
            assert t.normalise(x) == library.normalize(x), (rule, x)


def test_transducer_odd_rows(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = np.random.default_rng(14)
    long = " ".join("".join(rng.choice(list("abcdefé日"), rng.integers(1, 12))) for _ in range(20000))
    rows = docs(spark, [long, "same", "same", None], [None, 1, 1, 2])
    got = wfst.encode_documents(rows, PIECES, keep=True).collect()
    assert {r["fp"] for r in got} == {"own"} and all(r["round_trip"] for r in got)
    by = {(r["text"] or "")[:5]: r["pieces"] for r in got}
    assert by[long[:5]] == sp.encode(long) and by["same"] == sp.encode("same") and by[""] == []


def test_sentencepiece_query_gives_the_pieces(spark, tables):
    import sentencepiece
    import zlib

    from trailgrid.llm import queries

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, tables, "documents").collect()}
    rows = queries.op7_sentencepiece(spark, tables).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["pieces"] == sp.encode(texts[r["doc_id"]]) and r["n_pieces"] == len(r["pieces"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["pieces"], "<u4").tobytes())


# --- 8


def test_quality_model(spark):
    rng = np.random.default_rng(8)
    vocab = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(200)]
    good = [" ".join(rng.choice(vocab, 40)) + "." for _ in range(120)]
    bad = [" ".join(w + "###" for w in rng.choice(vocab, 40)) for _ in range(60)]
    texts = good + bad
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(180) if i % 3] + [(9999, 1), (None, 0), (5, None)], "doc_id long, quality int")
    model = quality.fit(docs(spark, texts), labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs(spark, texts + ODD), model).collect()}
    held = [i for i in range(180) if i % 3 == 0]
    assert np.mean([(got[i] >= 0.5) == (i < 120) for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[180] == got[181]
    assert quality.score(docs(spark, texts), model, keep=True, least=0.5).count() < 180
    nothing = quality.fit(docs(spark, texts), labels.where("false"))
    assert quality.score(docs(spark, ["a"]), nothing).first()["score"] == 0.5


def test_training_equals_plain_updates():
    rng = np.random.default_rng(21)
    rows = [(int(k % 3 > 0), np.sort(rng.choice(50, 5, replace=False)), rng.random(5)) for k in range(40)]
    w, bias = quality.ftrl(rows, 3)
    z, n, ones = collections.defaultdict(float), collections.defaultdict(float), sum(y for y, _, _ in rows)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    turn = np.random.default_rng(8)
    for _ in range(3):
        for k in turn.permutation(len(rows)):
            y, index, value = rows[k]
            x = dict(zip(index.tolist(), value.tolist(), strict=True)) | {"bias": 1.0}
            p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * len(rows) / (2 * (ones if y else len(rows) - ones)) * v
                old = weight(i)
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * old
                n[i] += g * g
    assert bias == pytest.approx(weight("bias")) and all(w[i] == pytest.approx(weight(i)) for i in range(50))


def test_quality_odd_labels(spark):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (1, 1), (2, 0), (3, -1), (4, 7), (None, 1)], "doc_id long, quality int")
    texts = ["noise", "good words", "bad words", "minus", "seven", "good words"]
    model = quality.fit(docs(spark, texts), labels)
    same = quality.fit(docs(spark, texts), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert all(np.array_equal(a, b) for a, b in zip(model, same, strict=True)) and len(model[0])
    assert quality.score(docs(spark, []), model).count() == 0
    got = quality.score(docs(spark, ["good words", "good words", "good " * 50000, None], [1, 1, None, 2]), model, keep=True).collect()
    assert len(got) == 4 and all(r["items"] == "own" for r in got) and len({r["score"] for r in got if r["doc_id"] == 1}) == 1


# --- 9


def brute_signature(weights, words, samples):
    """For each sample the word of least value and its step, by the same draws in plain arithmetic; ``words``: hashes of term and chunk."""
    import random

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def mix(x):  # Spark's xxhash64 of a long, seed 42
        return xxhash.xxh64_intdigest((x % (1 << 64)).to_bytes(8, "little"), 42)

    out = []
    for s in range(samples):
        chunk, k = divmod(s, cws.CHUNK)
        salt, best = random.Random(k).getrandbits(63), None
        for term, w in weights.items():
            h = mix(words[term, chunk] ^ salt)
            g = mix(h)
            u = [((h >> 16 * i & 65535) + 0.5) / 65536 for i in range(4)]
            v = [((g >> 16 * i & 65535) + 0.5) / 65536 for i in range(4)]
            total, middle = -math.log(math.prod(u)), sorted(v[:3])[1]
            r, c = total * middle, math.log(total * (1 - middle))
            t = math.floor(math.log(w) / r + v[3])
            value = c - r * (t - v[3] + 1)
            if best is None or value < best[0]:
                best = value, (signed(h) ^ (t * 40503)) & 0xFFFFFFFF
        out.append(best[1])
    return out


def test_sampling_estimates_jaccard(spark, corpus):
    texts = ["" if t is None else t for t in corpus + ODD]
    got = {r["doc_id"]: r for r in cws.compare_edited(docs(spark, corpus + ODD), samples=16).collect()}
    split = lambda x: collections.Counter(w for w in re.split(r"[^a-z0-9\x80-\U0010ffff]+", x.lower()) if w)
    errors = []
    for i, t in enumerate(texts):
        q = len(t) // 4
        edited = t[: len(t) - q] + texts[(i + 1) % len(texts)][:q]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for other, est in ((edited, got[i]["near_edited"]), (texts[(i + 1) % len(texts)], got[i]["near_next"])):
            a, b = split(t), split(other)
            if a and b:
                errors.append(est - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(errors)) < 0.03 and np.mean(np.abs(errors)) < 0.12
    assert got[0]["fp"] == got[60]["fp"]


def test_signatures_against_plain_arithmetic(spark):
    sets = {i: {int(k): int(w) for k, w in zip(np.random.default_rng(i).choice(40, 12, replace=False), np.random.default_rng(i).integers(1, 6, 12), strict=True)} for i in range(5)}
    terms = spark.createDataFrame([(i, k, w) for i, s in sets.items() for k, w in s.items()], "id long, term long, w int")
    got = {r["id"]: r["w_fp"] for r in cws.signatures(terms, ["id"], ["w"], 8).collect()}
    hashed = spark.range(40).select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("c")).select("t", "c", F.xxhash64("t", "c").alias("h"))
    words = {(r["t"], r["c"]): r["h"] for r in hashed.collect()}
    assert all(got[i] == brute_signature(s, words, 8) for i, s in sets.items())


@pytest.mark.parametrize("ids", [list(range(300)), [None] * 100 + [5] * 150 + list(range(50))])
def test_neighbours_over_many_runs(spark, monkeypatch, ids):
    monkeypatch.setattr(cws, "RUN_DOCS", 10)
    texts = [f"text number {i}" for i in range(300)]
    got = cws.neighbours(docs(spark, texts, ids)).collect()
    tie = {r["text"]: r["h"] for r in docs(spark, texts).select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, tie[x[1]]))
    after = {t: order[(k + 1) % 300][1] for k, (_, t) in enumerate(order)}
    assert {r["text"]: r["next_text"] for r in got} == after
    assert max(collections.Counter(r["run"] for r in got).values()) <= 40


def test_sampling_odd_tables(spark):
    assert cws.compare_edited(docs(spark, []), 4).count() == 0
    one = cws.compare_edited(docs(spark, ["abcd efgh"]), 4).first()
    assert one["near_next"] == 1 and one["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest()
    rows = cws.compare_edited(docs(spark, ["b", "a", None], [None, 3, 3]), 4).collect()
    assert len(rows) == 3 and all(0 <= r["near_edited"] <= 1 for r in rows)
    plan = cws.compare_edited(docs(spark, ["a b"]), 4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 10


def test_url_rules(spark):
    cases = {
        "http://www.Example.COM/en/7x?q": ("www.example.com", "/en/7x", "example.com/en/7", "allow"), "https://example.com/en/": ("example.com", "/en/", "com/en/", "block"), "http://notcom/en/": ("notcom", "/en/", None, "allow"),
        "http://a.example.net/de/8#f": ("a.example.net", "/de/8", "example.net/de/8", "block"), "http://b.net/de/8": ("b.net", "/de/8", "net/de/", "allow"), "http://x.org#/es/": ("x.org", "", None, "allow"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "x://h/p://q": ("h", "/p://q", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(cases)], "page_id long, url string, rule string")
    none = urls.mine(spark.createDataFrame([], "url string, blocked boolean"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, none, URL_RULES).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert urls.judge(pages.where("false"), none, URL_RULES).count() == 0


def test_mined_rules_against_a_search(spark):
    rng = np.random.default_rng(9)
    hosts = ["cheap-pills.biz", "news.org", "casino.biz", "blog.net"]
    rows = [(f"http://{h}/{p}/{i}.html", bool("biz" in h and p == "win" or rng.random() < 0.1)) for i, (h, p) in enumerate((rng.choice(hosts), rng.choice(["win", "en"])) for _ in range(400))]
    mined = urls.mine(spark.createDataFrame(rows + [(None, True), ("http://x/", None)], "url string, blocked boolean"), 0.02, 10, 0.8, 1.0, 0.0)
    tokens = {r["url"]: frozenset(r["t"]) for r in spark.createDataFrame(rows, "url string, blocked boolean").select("url", urls.tokens(F.col("url")).alias("t")).collect()}
    for rule in mined.collect():
        hit = [b for u, b in rows if set(rule["tokens"]) <= tokens[u]]
        assert sum(hit) >= 10 and sum(hit) / len(hit) == pytest.approx(rule["confidence"]) and rule["confidence"] >= 0.8
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, mined, []).collect()}
    rules = [set(r["tokens"]) for r in mined.collect()]
    # complete: every set of tokens that passes is a rule, or one of its subsets is a rule of no less confidence
    every, found = sorted({t for x in tokens.values() for t in x}), {frozenset(r["tokens"]): r["confidence"] for r in mined.collect()}
    for size in (1, 2, 3):
        for combo in itertools.combinations(every, size):
            hit = [b for u, b in rows if set(combo) <= tokens[u]]
            if sum(hit) >= 10 and sum(hit) >= 0.8 * len(hit):
                assert any(r <= set(combo) and c >= sum(hit) / len(hit) for r, c in found.items()), combo
    assert rules and [got[i] for i in range(len(rows))] == ["block" if any(r <= tokens[u] for r in rules) else "allow" for u, _ in rows]


def test_rules_by_lift(spark):
    rows = [(f"http://{'odd' if i % 10 == 0 else 'usual'}.org/{i}", i % 20 == 0 or i % 7 == 0) for i in range(700)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    base = sum(b for _, b in rows) / 700
    found = urls.mine(labelled, lift=1.5).collect()
    assert found and all(r["confidence"] >= 1.5 * base and {"h:odd", "w:odd"} & set(r["tokens"]) for r in found)
    assert urls.mine(labelled, lift=9.0).count() == 0 and urls.mine(labelled.where("not blocked")).count() == 0


def test_urls_odd_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c"), (None, "http://x.org/es/"), (2, "http://h/" + "p/" * 20000)], "page_id long, url string").withColumns({c: F.lit("own") for c in ("host", "verdict", "_u", "confidence")})
    mined = urls.mine(spark.createDataFrame([("http://a.b/c", True)] * 12 + [("http://q.r/s", False)] * 30, "url string, blocked boolean"))
    got = urls.judge(pages, mined, URL_RULES).collect()
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in got) == [(0, "block"), (1, "block"), (1, "block"), (2, "allow")]


def test_mined_rules_fire_on_the_tables(spark, tables):
    from trailgrid.llm import queries

    found = queries.op10_url_filter(spark, tables.replace("sf0.001", "sf0.1"))
    assert found.where("rule is null and verdict = 'block' and confidence is not null").count() > 0


# --- pipeline


def test_pipeline_stages(spark, tables):
    import corpus_pipeline as c

    before = c.table(spark, tables, "documents")
    for k, (name, stage) in enumerate(c.STAGES):
        after = stage(spark, before, tables).persist()
        ids = {r[0] for r in after.select("doc_id").collect()}
        assert ids <= {r[0] for r in before.select("doc_id").collect()} and ids, name
        assert after.columns == before.columns if k < 4 else after.columns[:5] == before.columns
        before = after
    assert before.where("not round_trip").count() == 0


def test_near_dedup_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline as c

    t = " ".join(f"w{i}" for i in range(60))
    rows = [(3, t, "en", "s", 1), (1, t, "en", "s", 1), (1, t, "en", "s", 1), (7, "other words here", None, None, None), (None, t, None, None, None), (9, None, None, None, None)]
    out = c.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [1, 7, 9]  # a row without an id comes after the others of its group


def test_near_dedup_keeps_different_texts_of_one_id(spark):
    import corpus_pipeline as c

    a, b, other = (" ".join(f"{k}{i}" for i in range(60)) for k in "abo")
    rows = [(1, a), (2, a + " end"), (2, other), (5, b), (5, b), (5, None), (5, b + " end"), (4, "short text")]
    rows = [(i, t, "en", "s", 1) for i, t in rows]
    out = c.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted((r["doc_id"], r["text"] or "") for r in out.collect()) == [(1, a), (2, other), (4, "short text"), (5, ""), (5, b)]


def test_stages_take_odd_rows(spark, tables):
    import corpus_pipeline as c

    odd = ["score", "n_words", "items", "n_removed", "pieces", "g_id", "row", "key"]
    text = " ".join(f"w{i} of." for i in range(40))
    rows = [(1, text), (1, text), (2, None), (None, None), (None, "short"), (3, ""), (4, "x " * 30000), (None, text)]
    table = spark.createDataFrame([(*r, *odd) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in odd))
    for name, stage in c.STAGES:
        out = stage(spark, table, tables)
        same = [n for n in table.columns if n not in ("pieces",)]
        got = out.select(same).collect()
        assert len(got) <= len(rows) and all(r["key"] == "key" and r["row"] == "row" for r in got), name
        assert stage(spark, table.where("false"), tables).count() == 0, name
    near = sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in c.near_dedup_stage(spark, table, tables).collect())
    assert near == [(0, 5), (1, len(text)), (2, 0), (4, 60000)]


def test_pipeline_against_brute_force(spark, tmp_path, tables):
    """Planted cases go, all else stays, and the pieces are the library's."""
    import corpus_pipeline as c
    import sentencepiece

    rng = np.random.default_rng(31)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(2000)]
    sentence = lambda: " ".join(rng.choice(vocab, rng.integers(6, 13))) + ". "
    good = {i: "".join(sentence() for _ in range(12)) for i in range(60)}
    junk = {100 + i: " ".join(["###", "$$$", "!!!"] * 30) + f" {i}" for i in range(30)}
    item = " ".join(rng.choice(vocab, 30))
    passage = "".join(sentence() for _ in range(7))
    texts = good | junk | {200: good[3], 201: good[4].replace(good[4].split()[9], "edited", 1), 202: good[5] + passage, 203: good[6][: len(good[6]) // 2] + passage, 204: item + " " + "".join(sentence() for _ in range(3))}
    texts[202], texts[203] = "".join(sentence() for _ in range(9)) + passage, "".join(sentence() for _ in range(9)) + passage
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*good, *junk]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in c.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(good) | {202, 203}
    assert all(got[i]["text"] == texts[i] for i in [*good, 202]) and got[203]["text"].split() == texts[203][: -len(passage)].split() and got[203]["n_chars"] == len(got[203]["text"])
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert all(r["pieces"] == sp.encode(r["text"]) for r in got.values())


def test_document_queries_match_sql(spark, tables):
    import duckdb

    from trailgrid.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tables}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        ours = queries.QUERIES[name](spark, tables).toPandas()
        theirs = con.execute(sql).df()[list(ours.columns)]
        both = [sorted(map(repr, df.astype(object).values.tolist())) for df in (ours, theirs)]
        assert both[0] == both[1], name
