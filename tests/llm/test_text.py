"""Token counts, url rules, page texts, archives, decontamination, quality and mixing."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlog.llm import decontamination, html_text, mixing, quality_classifier, token_counts, url_filters, warc
from loomlog.llm.queries import RULES

SF = "/root/testdata/sf0.001"


def test_token_histogram(spark):
    texts = ["hello world", "", None, "a b c d e", "hello world", "Ünï 漢字 " * 300, "<|endoftext|>"]
    lengths = {r.doc_id: r.n_tokens for r in token_counts.encoded_lengths(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert lengths[0] == 2 and lengths[1] == lengths[2] == 0 and lengths[5] > 1000 and lengths[6] > 1
    sums = token_counts.token_counts(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int"))
    n = list(lengths.values())
    for r in sums.collect():
        assert r.docs == n.count(r.n_tokens) and r.docs_at_least == sum(x >= r.n_tokens for x in n) and r.tokens_at_least == sum(x for x in n if x >= r.n_tokens)
        assert r.tokens_if_cut == sum(min(x, r.n_tokens) for x in n) and r.docs_up_to == sum(x <= r.n_tokens for x in n)
    got = {(r.kind, r.at): r.value for r in token_counts.answer(sums, [1, 3, 10**6], [0.5, 1.0]).collect()}
    assert [got["cut", x] for x in (1.0, 3.0, 1e6)] == [sum(min(v, k) for v in n) for k in (1, 3, 10**6)]
    assert got["length", 0.5] == sorted(n)[(len(n) - 1) // 2] and got["length", 1.0] == max(n)
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def slow_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = []
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fit.append((-len(rule), rule, verdict))
    return host, path, *(min(fit)[1:] if fit else (None, "allow"))


def test_url_rules(spark):
    rng = random.Random(2)
    hosts = ["com", "example.com", "EXAMPLE.com", "a.example.com", "xexample.com", "example.net", "www.example.net", "example.org", "com.", "a..com", "example.com:80"]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/71?x=/de/", "/de/8#a", "/es/1", "?q=://x/en/", "#/en/"]
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)] + [None, "", "no scheme", "://", "a://b://com/en/", "x://com\n/en/"] + ["http://example.com/en/7"] * 200
    pages = spark.createDataFrame([(i, u, "host") for i, u in enumerate(urls)] + [(None, "http://com/en/", "h")], "page_id long, url string, host string")
    more = [*RULES, ("example.com/", "block"), ("a.example.com/en/", "allow")]
    for rules in (RULES, more):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, spark.createDataFrame(rules, "rule string, verdict string")).collect()}
        assert len(got) == len(urls) + 1
        for i, u in enumerate(urls):
            assert got[i] == slow_verdict(u, rules), u
    none = spark.createDataFrame([], "rule string, verdict string")
    assert {r.verdict for r in url_filters.judge(pages, none).collect()} == {"allow"}
    assert url_filters.judge(pages.limit(0), none).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<!-- ad --><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>One<br>two   three<p>Four &lt;x&gt;</p><aside>side</aside><form>f</form><div class="comments">bad</div><ul><li>L1<li>L2</ul></article>
<div id="cookie-notice">cookies</div><footer>&copy; me</footer></body></html>"""


def test_html_blocks(spark):
    rows = [(0, "http://h/a", PAGE, "x"), (1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<article>open <b>end", "x"), (4, "u", "plain text &eacute;", "x")]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got == {0: "Head & line\n\nOne two three\n\nFour <x>\n\nL1\n\nL2", 1: "", 2: "", 3: "open end", 4: "plain text é"}
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_host_boilerplate(spark):
    shell = "<div>you are reading the daily site of record since nineteen ten</div><p>{}</p>"
    words = ["alpha beta gamma delta epsilon zeta eta theta iota", "one two three four five six seven eight nine", "red green blue pink black white grey brown cyan"]
    pages = [(i, f"http://site.org/{i}", shell.format(w)) for i, w in enumerate(words)] + [(9, "http://else.org/", shell.format(words[0]))]
    marked = [(20 + i, f"http://site.org/m{i}", f"<article><p>{words[0]}</p></article>") for i in range(3)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages + marked, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(3)] == words
    assert got[9].startswith("you are reading") and got[20] == got[22] == words[0]


def test_html_keeps_what_is_unique(spark):
    """Of unmarked pages only runs go that many pages of the host carry; the rest of their blocks, short headings, links and copied articles stay."""
    shell, article = "these eight words stand on each page here", "a copied article of ten words that two pages carry"
    pages = [(i, f"http://a.org/{i}", f"<div>{shell} own{i} text{i} here{i}</div><h2>Introduction</h2><p><a href='/x'>a link {i}</a></p>") for i in range(4)]
    pages += [(10 + i, f"http://b.org/{i}", f"<div>{article}</div>") for i in range(2)] + [(20 + i, f"http://c.org/{i}", f"<div>{article}</div>") for i in range(4)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(4)] == [f"own{i} text{i} here{i}\n\nIntroduction\n\na link {i}" for i in range(4)]
    assert {got[i] for i in (10, 11, 20, 21, 22, 23)} == {article}


def test_archives_round_trip(spark):
    html = ["<p>é</p>", "", None, "<p>é</p>", "x\r\n\r\nWARC/1.1\r\nfiledesc://", "<p>é</p>", "", "y" * 5000]
    urls = ["http://a/ü x", None, "", "http://b", "http://c\n", "http://a", "u", "v"]
    rows = [(i, u, h, 1) for i, (u, h) in enumerate(zip(urls, html))] + [(7, "v", "y" * 5000, 1), (None, "w", "<p>é</p>", 1)]
    got = warc.convert_pages(spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int"), archive_bytes=600).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    for i, h in enumerate(html):
        raw = (h or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(raw), warc.digest(raw))
    assert [by[i].record_type for i in range(8)] == ["response", "response", "revisit", "revisit", "response", "revisit", "revisit", "response"]
    assert [by[i].refers_to for i in range(8)] == [None, None, 1, 0, None, 0, 1, None]
    assert by[None].record_type == "revisit" and by[None].refers_to == 0
    assert by[0].url == "http://a/ü x" and by[1].url is None
    assert warc.convert_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archive_versions():
    for version in (1, 2):
        data = warc.arc_start(version, "n") + warc.arc_record(version, "n", 9, "http://x", 5, b"a\nb") + warc.arc_record(version, "n", 9, None, None, b"")
        found = list(warc.parse_arc(data))
        assert [warc.http_split(b)[1] for _, b in found] == [b"a\nb", b""]
        assert list(found[0][0]) == warc.FIELDS[version]
        with pytest.raises(ValueError):
            list(warc.parse_arc(data[:-3]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://x 0 0 text/html 3\nabc"))


def slow_matches(text, items):
    """The best similarity of each item over all windows of its size."""
    out = {}
    t = decontamination.words(text or "")
    shingles = [tuple(t[i : i + 5]) for i in range(len(t) - 4)]
    for item_id, item in items:
        w = decontamination.words(item or "")
        mine = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        n = sum(mine.values())
        if not n or not shingles:
            continue
        best = max(decontamination.weighted_similarity(Counter(shingles[i : i + n]), mine) for i in range(max(len(shingles) - n, 0) + 1))
        if best >= 0.8:
            out[item_id] = round(best, 9)
    return out


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["w%d" % i for i in range(500)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(20, 60)))) for i in range(12)] + [(20, "too short here"), (21, None), (22, ""), (23, " ".join(["la"] * 30))]
    texts = []
    for k in range(60):
        w = say(rng.randint(0, 80))
        passage = items[k % 12][1].upper().split(" ")
        if k % 4 == 1:
            passage[0] = "changed"
        if k % 4 == 2:
            passage[len(passage) // 2] = "changed"
        if k % 4 != 3:
            at = rng.randint(0, len(w))
            w = w[:at] + [f"{x}," for x in passage] + w[at:]
        texts.append(" ".join(w))
    texts += [None, "", " ".join(["la"] * 200), " ".join(w for _, t in items[:12] for w in t.split(" "))]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, similarity double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, k): s for i, t in enumerate(texts) for k, s in slow_matches(t, items).items()}
    for sieve_bits in (1 << 27, 1 << 15):
        got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontamination.find_matches(docs, bench, sieve_bits=sieve_bits).collect()}
        assert got == want
    clean = decontamination.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {i for i, _ in want}
    assert decontamination.find_matches(docs, bench.limit(0)).count() == 0 and decontamination.find_matches(docs.limit(0), bench).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    from loomlog.llm.queries import held_out

    model = quality_classifier.train(docs, labels, exclude=held_out)
    rows = quality_classifier.score(docs, model).join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("score", "quality").collect()
    right = np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows])
    assert len(rows) > 40 and right > 0.93


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "word " * 50_000, "x")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.score(docs, quality_classifier.train(docs, none)).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (77, 0)], "doc_id long, quality int")
    scores = [r.score for r in quality_classifier.score(docs, quality_classifier.train(docs, labels)).collect()]
    assert len(scores) == 4 and all(0.5 < s < 1 for s in scores)
    assert quality_classifier.score(docs.limit(0), quality_classifier.train(docs, labels)).count() == 0
    model = quality_classifier.train(docs, labels)
    clash = docs.withColumn("Score", F.lit("mine")).withColumn("big", F.when(F.col("doc_id") == 1, F.lit(2**53 + 1)))
    assert dict(quality_classifier.score(clash, model).dtypes)["score"] == "double"
    kept = quality_classifier.accept(clash, model, 0.0)
    assert kept.columns == clash.columns and sorted(map(str, kept.collect())) == sorted(map(str, clash.collect()))
    assert quality_classifier.accept(clash, model, 1.1).count() == 0
    x = np.random.default_rng(0).normal(size=(3000, len(quality_classifier.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only a pair can tell
    assert np.mean((quality_classifier.fit(x, y).score(x) > 0.5) == y) > 0.9


def test_mixing(spark):
    sf = "/root/testdata/sf0.01"  # some hundred labelled documents, where sf0.001 has some eighty
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = docs.select("doc_id", "lang").join(labels.select("doc_id"), "doc_id", "left_semi")
    weights = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}
    mixed = mixing.mix(docs, known, weights, carry=False).collect()
    langs = sorted(weights)
    total = sum(r.n_tokens for r in mixed)
    for k, lang in enumerate(langs):
        assert abs(sum(r.rate * r.n_tokens * r.posterior[k] for r in mixed) / total - weights[lang]) < 1e-3
    assert all(r.rate >= 0 and r.rate - 1 < r.copies < r.rate + 1 for r in mixed)
    truth = {r.doc_id: r.lang for r in docs.where("length(text) > 100").collect()}
    assert np.mean([truth[r.doc_id] == r.domain for r in mixed if r.doc_id in truth]) > 0.97
    up = mixing.mix(docs, known, weights, never_below=True, lowest=1.0).collect()
    assert min(r.copies for r in up) >= 1 and len(up) == docs.count()


def test_mixing_never_below_meets_its_shares(spark):
    """The pipeline's mix: every rate is at least 1, and the expected shares are those of TARGETS."""
    import corpus_pipeline
    from loomlog.llm.queries import TARGETS

    sf = "/root/testdata/sf0.01"
    rows = corpus_pipeline.mix(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()
    got = [sum(r.rate * r.n_tokens * r.posterior[k] for r in rows) for k in range(len(TARGETS))]
    assert min(r.rate for r in rows) >= 1
    for k, lang in enumerate(sorted(TARGETS)):
        assert abs(got[k] / sum(got) - TARGETS[lang]) < 1e-5


def test_mixing_of_whole_rows_is_that_of_ids(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known, weights = docs.select("doc_id", "lang"), {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}
    whole, ids = (mixing.mix(docs, known, weights, passes=5, carry=carry) for carry in (True, False))
    assert set(docs.columns) < set(whole.columns)
    assert sorted(whole.select(ids.columns).collect()) == sorted(ids.collect())


def test_mixing_reports_the_gap_left(spark):
    members = spark.createDataFrame([(10, [0.9, 0.1]), (10, [0.2, 0.8])], "n_tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="miss the targets"):
        gaps = mixing.fit_rates(members, [100.0, 1.0], lowest=1.0)[2]
    assert gaps[0] > 0 > gaps[1]
    steps, mass, gaps = mixing.fit_rates(members, [11.0, 11.0], 1.0, raising=True)
    assert max(map(abs, gaps)) < 1e-4 and min(min(s) for s in steps) >= 0 and round(sum(mass), 6) == 20


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "a b", "en"), (2, "a b", "en"), (None, "c", None)], "doc_id long, text string, lang string")
    out = mixing.mix(docs, docs.select("doc_id", "lang"), {"en": 1.0}).collect()
    assert sorted(r.n_tokens for r in out) == [0, 1, 2, 2]
    assert mixing.mix(docs.limit(0), docs.limit(0), {"en": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, docs, {"xx": 1.0})
    clash = docs.withColumns({"N_Tokens": F.lit(-1), "rate": F.lit("x"), "__mix_chance": F.lit(7)})
    out = mixing.mix(clash, docs.select("doc_id", "lang"), {"en": 1.0})
    assert sorted(r.N_Tokens if "N_Tokens" in out.columns else r.n_tokens for r in out.collect()) == [0, 1, 2, 2]
    assert {r["__mix_chance"] for r in out.collect()} == {7} and dict(out.dtypes)["rate"] == "double"
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumnRenamed("text", "rate"), docs, {"en": 1.0}, text_col="rate")


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = pipeline.run(spark, SF)
    assert set(docs.columns) <= set(out.columns)
    kept = {r.doc_id: r for r in out.collect()}
    assert len(kept) == out.count() and all(r.copies >= 1 for r in kept.values())
    texts = [r.text for r in kept.values()]
    assert len(texts) == len(set(texts))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(slow_matches(t, items) for t in texts[:40])
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_queries_match_their_sql(spark):
    import duckdb

    from loomlog.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        cursor = con.execute(sql)
        at = [[d[0] for d in cursor.description].index(c) for c in columns]
        assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in cursor.fetchall())
