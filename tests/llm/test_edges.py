"""Long, broken and skewed input, and the registered queries against brute force on their whole small tables."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlog.llm import exact_dedup, html_text, mixing, queries, suffix_dedup, token_counts, url_filters, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("piece", ["<a", "<div>", '<a x="', "<a x='", "<b><p>", "</a", "<!--", "<script>", "</script", "<", "&amp", "<p a=b c=\"d'>", "</p>"])
def test_html_takes_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    begin = time.time()
    html_text.blocks(page)
    assert time.time() - begin < 5


def test_html_names_inside_an_article():
    page = "<article><h1>T</h1><p id='related-work'>one</p><p class='share-price'>two</p><section class='comments-on-law'>three</section><section id='comments'>four</section></article>"
    assert [x[0] for x in html_text.blocks(page)] == ["T", "one", "two", "three"]
    assert [x[0] for x in html_text.blocks("<div class='left-sidebar'>a</div><div id='siteFooter'>b</div><p class='share-price'>c</p>")] == ["c"]


def test_suffix_arrays_count_shared_runs():
    rng = np.random.default_rng(3)
    streams = [rng.integers(0, 4, rng.integers(0, 60)).astype(np.uint64) for _ in range(40)]
    for depth, least in ((3, 2), (5, 4), (8, 1)):
        want = Counter(run for s in streams for run in {tuple(s[i : i + depth].tolist()) for i in range(len(s) - depth + 1)})
        hashes, pages = html_text.shared_runs(streams, depth, least)
        assert sorted(pages.tolist()) == sorted(n for n in want.values() if n >= least)
        ours = {int(html_text.run_hashes(np.array(run, np.uint64), depth)[0]): n for run, n in want.items() if n >= least}
        assert dict(zip(hashes.tolist(), pages.tolist())) == ours


def test_html_boilerplate_inside_articles(spark):
    """Marked or not: what most pages of a host carry goes, in however many suffix arrays the host is dealt; copied articles stay."""
    rng = random.Random(1)
    say = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    notice = "this long notice is on nearly all of the pages here"
    own = [say(rng.randint(15, 60)) for _ in range(60)]
    pages = [(i, "http://a.org/", f"<article><p>{own[i]}</p><p>{notice}</p></article>" if i % 2 else f"<div>{own[i]}</div><div>{notice}</div>") for i in range(60)]
    copied = say(40)
    pages += [(100 + i, "http://b.org/", f"<article><p>{copied}</p></article>") for i in range(30)] + [(200 + i, "http://b.org/", f"<article><p>{say(20)}</p></article>") for i in range(3)]
    for block_pages in (256, 7):
        got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string"), block_pages=block_pages).collect()}
        assert [got[i] for i in range(60)] == own
        assert {got[100 + i] for i in range(30)} == {copied}


def test_html_query_on_its_table(spark):
    """The article of each page, also of a table whose pages do not mark it."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.QUERIES["op6_html_text"](spark, SF).collect()}
    import html

    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article.replace("<b>", "").replace("</b>", ""))]
        assert got[r.page_id].text == "\n\n".join(x for x in want if x) and got[r.page_id].n_chars == len(got[r.page_id].text)
    bare = spark.createDataFrame([(r.page_id, r.url, r.html.replace("<article>", "").replace("</article>", "")) for r in rows], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.main_text(bare).collect()} == {k: r.text for k, r in got.items()}


def test_tokens_of_long_runs():
    encode = token_counts.encoder()
    for ch in " \na\t":
        assert len(encode(ch * 2_000_000)) > 0
    short = re.compile("[\\t-\\r \\x85\\xa0]{3,}+")
    before, token_counts.LONG_SPACE = token_counts.LONG_SPACE, re.compile("(?!)")
    texts = ["a   b", "a \n\n  b", "   ", "a    ", "\n\n\n'x", "   1 !", "x \t \t it's", "", "a" + " " * 50 + "é" + "\n" * 40]
    try:
        plain = [encode(t) for t in texts]
        token_counts.LONG_SPACE = short
        assert [encode(t) for t in texts] == plain
    finally:
        token_counts.LONG_SPACE = before


def test_token_query_against_plain_lengths(spark):
    encode = token_counts.encoder()
    n = Counter(len(encode(r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert {r.n_tokens: r.docs for r in queries.QUERIES["op3_token_counts"](spark, SF).collect()} == n


def test_exact_rows_with_maps_and_ties(spark):
    rows = [(1, "a", {"k": 1}), (1, "a", {"k": 2}), (2, "a", None), (None, "a", None), (None, "b", {"x": 1}), (3, "c", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string, int>")
    assert sorted((r.doc_id or 0, r.text) for r in exact_dedup.keep_rows(docs).collect()) == [(0, "b"), (1, "a"), (3, "c")]
    assert sorted((r.doc_id or 0, r.text) for r in exact_dedup.keep_rows(docs, keep="largest").collect()) == [(0, "b"), (2, "a"), (3, "c")]
    assert exact_dedup.keep_rows(docs.limit(0)).count() == 0


def test_mixing_many_domains_and_rare_ones(spark):
    rows = [(i, f"{'common' if i % 50 else 'rare'} " * 20 + f"w{i % 7}", "common" if i % 50 else "rare") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = mixing.mix(docs, docs.select("doc_id", "lang"), {"rare": 0.6, "common": 0.4}).collect()
    total = sum(r.n_tokens for r in out)
    assert abs(sum(r.rate * r.n_tokens for r in out) / total - 1) < 1e-3
    assert abs(sum(r.rate * r.n_tokens * r.posterior[1] for r in out) / total - 0.6) < 1e-3
    many = spark.createDataFrame([(i, f"d{i % 18} " * 10, f"d{i % 18}") for i in range(360)], "doc_id long, text string, lang string")
    got = mixing.mix(many, many.select("doc_id", "lang"), {f"d{k}": 1 + k for k in range(18)})
    shares = {r.domain: r.share for r in mixing.expected_shares(got, sorted(f"d{k}" for k in range(18))).collect()}
    assert all(abs(shares[f"d{k}"] - (1 + k) / 171) < 1e-4 for k in range(18))


def test_rates_against_brute_force():
    """The fold over gradient steps is the projected gradient of least squares over fifty documents."""
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3] * 3, 50)
    n = rng.integers(1, 100, 50).astype(float)
    targets = np.array([0.5, 0.3, 0.2]) * n.sum()
    a, r = (p * n[:, None]).T, np.ones(50)
    mass = a.sum(1)
    scale = 1 / (p @ mass)
    curvature = max(a @ scale)
    for _ in range(400):
        r = np.maximum(0, r + scale * (p @ (targets - a @ r)) / curvature)
    assert np.abs(a @ r - targets).max() < 1e-4 * n.sum() and r.min() >= 0


def test_archives_in_linear_time(spark):
    begin = time.time()
    pages = spark.range(20_000).select((2 * F.col("id") + 1).alias("page_id"), F.lit("u").alias("url"), F.lit("").alias("html")).coalesce(1)
    back = warc.convert_pages(pages)
    assert back.where("record_type = 'response'").count() == 1 and time.time() - begin < 120


def test_rules_of_one_host_by_bisection():
    rng = random.Random(5)
    paths = {"/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 6))) for _ in range(200)}
    rules = url_filters.HostRules([(p, f"h{p}", "block") for p in sorted(paths, key=lambda _: rng.random())])
    for _ in range(500):
        url = "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 9)))
        fit = [p for p in paths if url.startswith(p)]
        assert rules.longest(url) == ((f"h{max(fit, key=len)}", "block") if fit else None)


def test_long_hosts_and_hot_urls(spark):
    long = "a" * 400 + ".example.com"
    rows = [(None, f"http://{long}/en/1")] * 50 + [(7, "http://com/en/")] * 300
    rules = spark.createDataFrame([(f"{long}/en/", "allow"), ("com/en/", "block")], "rule string, verdict string")
    got = Counter((r.rule, r.verdict) for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect())
    assert got == {(f"{long}/en/", "allow"): 50, ("com/en/", "block"): 300}


def test_suffix_ids_at_the_edge(spark):
    text = "".join(random.Random(2).choice("abcdef") for _ in range(500))
    docs = spark.createDataFrame([(-(2**63), text), (None, text), (0, "x" + text)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == [(str(-(2**63)), 500), ("0", 500), ("None", 500)]


def test_warc_query_against_its_contract(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    first = defaultdict(lambda: 1 << 60)
    for r in rows:
        first[r.html or ""] = min(first[r.html or ""], r.page_id)
    got = {r.page_id: r for r in queries.QUERIES["op7_warc"](spark, SF).collect()}
    for r in rows:
        raw, low = (r.html or "").encode(), first[r.html or ""]
        x = got[r.page_id]
        assert (x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) == (len(raw), warc.digest(raw), "response" if r.page_id == low else "revisit", None if r.page_id == low else low)


def test_suffix_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = suffix_dedup.brute_force([(r.text or "").encode() for r in rows], 200)
    got = {r.doc_id: r for r in queries.QUERIES["op2_suffix_dedup"](spark, SF).collect()}
    for r, spans in zip(rows, want):
        raw = (r.text or "").encode()
        edges = [0, *(x for s in spans for x in s), len(raw)]
        kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
        assert (got[r.doc_id].n_removed, got[r.doc_id].n_spans, got[r.doc_id].kept_sha256) == (len(raw) - len(kept), len(spans), suffix_dedup.sha256_hex(kept))
