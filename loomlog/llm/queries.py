"""One query for each operator of this subpackage, and the SQL that checks it where SQL can."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import decontamination, exact_dedup, html_text, mixing, quality_classifier, simhash_dedup, suffix_dedup, token_counts, url_filters, warc
from loomlog.llm.common import table

#: Shares of tokens that the mix aims at, by language.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}
ACCEPT = 0.3
#: (rule, verdict) of the URL filter.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def held_out(doc_id):
    """The labelled documents that no model learns from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates that bring the documents to TARGETS: doc_id, n_tokens, domain, the posteriors, rate, copies."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = docs.select("doc_id", "lang").join(labels.select("doc_id"), "doc_id", "left_semi")
    mixed = mixing.mix(docs, known, TARGETS, carry=False)
    return mixed.select("doc_id", "n_tokens", "domain", F.transform("posterior", lambda p: F.round(p, 6)).alias("posterior"), F.round("rate", 6).alias("rate"), "copies")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that repeated strings of 200 bytes cover, by document."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of encoded lengths with its suffix sums."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of each page's url."""
    return url_filters.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule string, verdict string"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of each document."""
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    found = html_text.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back."""
    back = warc.convert_pages(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold: doc_id, item_id, similarity, first_word, n_words."""
    found = decontamination.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 6))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of each document; the largest doc_id stays."""
    return exact_dedup.assign_groups(table(spark, sf_dir, "documents"), keep="largest")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of each document."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality_classifier.train(docs, labels, exclude=held_out)
    scored = quality_classifier.feature_scores(docs, model, ("doc_id",))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_suffix_dedup, op3_token_counts, op4_url_filters, op5_simhash_dedup, op6_html_text, op7_warc, op8_decontamination, op9_exact_dedup, op10_quality)}

ORACLE_SQL = {
    "op4_url_filters": r"""
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r(rule, rhost, rpath, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'block'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
        m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
        SELECT p.page_id, host, path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id""",
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY text)
        SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, sha256(d.text) AS text_sha256 FROM d JOIN g ON d.text = g.text""",
}
