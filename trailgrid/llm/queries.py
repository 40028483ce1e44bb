"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cws, decontaminate, langid, lm, quality, records, simhash, substring, urls, wfst
from .common import crc_mod, shared_path



def tokenizer(name: str) -> str:
    """The path of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score_documents(table(spark, sf_dir, "documents"), order=3, least=2, backoff=0.4, stored=True)
    return found.select("doc_id", "n_words", F.round("logprob", 4).alias("logprob"), F.round(F.col("logprob") / F.greatest("n_words", F.lit(1)), 6).alias("per_word"))


OP1_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), tokens AS (
    SELECT doc_id, unnest(w) AS w, unnest(list_concat([NULL], w[:-2])) AS h, unnest(list_concat([NULL, NULL], w[:-3])[:len(w)]) AS g FROM words WHERE len(w) > 0
), one AS (SELECT w, count(*) AS c FROM tokens GROUP BY w),
two AS (SELECT h, w, count(*) AS c FROM tokens WHERE h IS NOT NULL GROUP BY h, w),
three AS (SELECT g, h, w, count(*) AS c FROM tokens WHERE g IS NOT NULL GROUP BY g, h, w),
total AS (SELECT count(*) AS n FROM tokens),
scored AS (
    SELECT t.doc_id, CASE WHEN three.c >= 2 THEN ln(three.c / long_context.c)
        WHEN two.c >= 2 THEN ln(two.c / context.c) + CASE WHEN t.g IS NULL THEN 0 ELSE ln(0.4) END
        ELSE ln(one.c / total.n) + CASE WHEN t.h IS NULL THEN 0 WHEN t.g IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END END AS s
    FROM tokens t CROSS JOIN total JOIN one ON one.w = t.w LEFT JOIN two ON two.h = t.h AND two.w = t.w LEFT JOIN one AS context ON context.w = t.h
    LEFT JOIN three ON three.g = t.g AND three.h = t.h AND three.w = t.w LEFT JOIN two AS long_context ON long_context.h = t.g AND long_context.w = t.h
), sums AS (SELECT doc_id, sum(s) AS s FROM scored GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(coalesce(s, 0), 4) AS logprob, round(coalesce(s, 0) / greatest(len(d.w), 1), 6) AS per_word
FROM words d LEFT JOIN sums ON sums.doc_id = d.doc_id
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_mod("doc_id", 4) != 2))
    found = langid.identify(docs, model)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "records")
    manifest = records.write_records(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), folder, end_id=2)
    return records.read_records(manifest, folder)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=13)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"),
    )


OP5_SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
b1 AS (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM b1),
d1 AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
d2 AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM d1),
hits AS (SELECT r, n, i, item FROM d2 JOIN windows USING (n, k)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, n, i FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated
FROM w LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return clean.select(
        "doc_id", "n_sentences", "n_units", "n_removed", (F.col("n_removed") > 0).alias("changed"),
        F.length("text").cast("long").alias("n_chars_left"), F.sha2(F.col("text").cast("binary"), 256).alias("clean_sha256"),
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every text beside their digest."""
    return wfst.encode_documents(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def quality_model(docs: DataFrame, labels: DataFrame):
    """Learned from the labelled rows of ``docs`` that are not held out."""
    labels = labels.where(crc_mod("doc_id", 5) != 0).select("doc_id", "quality")
    return quality.fit(docs, labels)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cws.compare_edited(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", cws.hexadecimal(F.col("fp")).alias("fingerprint"), cws.hexadecimal(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")


#: Verdict, host and path of the contract's rules.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def labels_by_number(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url, blocked``: a page's label is that of the document of its number: of low quality or toxic."""
    return pages.join(labels, F.col("page_id") == F.col("doc_id")).select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))


def op10_url_filter(spark: SparkSession, sf_dir: str, labelled=labels_by_number) -> DataFrame:
    """Verdicts of the explicit rules, else of rules mined from the urls that ``labelled(pages, labels)`` gives."""
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    return urls.judge(pages, urls.mine(labelled(pages, labels)), URL_RULES)


QUERIES = {
    f.__name__: f
    for f in (op1_lm_score, op2_language_id, op3_simhash, op4_token_records, op5_decontaminate, op6_substring_dedup, op7_sentencepiece, op8_quality, op9_fingerprints, op10_url_filter)
}
ORACLES: dict[str, str] = {"op1_lm_score": OP1_SQL, "op5_decontaminate": OP5_SQL}
