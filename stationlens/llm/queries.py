"""The queries this subpackage registers, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlens.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stationlens.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target are the documents labelled as good quality."""
    from stationlens.llm.lm_scoring import cross_entropy_difference

    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stationlens.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), max_tokens=1024, end_id=2)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stationlens.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stationlens.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op6_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stationlens.llm.fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


#: The session setting that names the key of the surrogates, and the key of tests and registered queries where it is unset.
PII_KEY_SETTING, PII_TEST_KEY = "spark.stationlens.piiKey", "for tests only"


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get(PII_KEY_SETTING, PII_TEST_KEY)


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stationlens.llm.pii import replace_entities

    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


#: The rules of the URL query: (verdict, host and path).
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op8_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose id is the number in its path; it is bad if that document is of low quality."""
    from stationlens.llm.url_filter import judge_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    shown = pages.select("page_id", F.expr(r"try_cast(regexp_extract(url, '://[^/?#]*/[^/?#]*/([0-9]+)', 1) as bigint)").alias("doc_id"))
    known = table(spark, sf_dir, "labels").filter("quality IN (0, 1)").groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("bad"))
    labels = shown.join(known, "doc_id").groupBy("page_id").agg(F.max("bad").alias("bad"))
    return judge_urls(pages, labels, URL_RULES)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stationlens.llm.token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stationlens.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality": op4_quality,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_imatch_fingerprints": op6_imatch_fingerprints,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_url_templates": op8_url_templates,
    "op9_token_counts": op9_token_counts,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op5_ngram_jaccard": """WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
members AS (SELECT doc_id, unnest(s) AS x FROM sets), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM members a JOIN members b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT o.a, o.b FROM shared o JOIN sets p ON p.doc_id = o.a JOIN sets q ON q.doc_id = o.b WHERE 100 * o.o >= 90 * (len(p.s) + len(q.s) - o.o)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach(id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.c AS component_id FROM sets s JOIN (SELECT id, min(other) AS c FROM reach GROUP BY 1) r ON r.id = s.doc_id""",
}
