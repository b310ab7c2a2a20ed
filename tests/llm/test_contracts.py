"""Results that the contracts fix, on small made tables."""

import random
from collections import Counter

import pytest

from loomlog.llm import queries, simhash_dedup

#: url, host, path, rule, verdict
URLS = [
    ("http://a.net/de/1?x", "a.net", "/de/1", "net/de/", "allow"),
    ("http://EXAMPLE.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
    ("http://www.example.net/de/7", "www.example.net", "/de/7", "net/de/", "allow"),
    ("http://a.com/en/1", "a.com", "/en/1", "com/en/", "block"),
    ("http://b.example.com/en/71", "b.example.com", "/en/71", "example.com/en/7", "allow"),
    ("http://x.org/es/", "x.org", "/es/", "org/es/", "block"),
    ("http://x.org/de/", "x.org", "/de/", None, "allow"),
    (None, "", "", None, "allow"),
]


@pytest.fixture
def tables(spark, tmp_path):
    """Writes rows as a table of a folder and returns the folder."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/{name}.parquet")
        return f"file://{tmp_path}"

    return write


def test_url_filter_rules(spark, tables):
    d = tables("pages", [(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.QUERIES["op4_url_filters"](spark, d).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS)}


def test_common_shingles_are_counted_over_all_texts(spark):
    """Shingles that just reach the number of texts and just miss it, ones repeated within a text, and an empty bucket list."""
    rng = random.Random(4)
    passages = {n: " ".join(f"p{n}w{k}" for k in range(7)) for n in (63, 64, 65, 130)}
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(30)) + "".join(f" {p} {p}" for n, p in passages.items() if i < n) for i in range(300)] + [None, "", "one two"]
    count = Counter(int(s) for t in texts for s in simhash_dedup._shingle_set(t or "", 5))
    signed = {s: s - (1 << 64) if s >> 63 else s for s in count}
    want = sorted((s for s, n in count.items() if n >= 64), key=lambda s: (-count[s], signed[s]))[::-1]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    assert simhash_dedup._common(rows, 5).tolist() == want and len(want) > 20
    assert simhash_dedup._common(rows, 5, most=3).tolist() == want[-3:]
    assert len(simhash_dedup._common(rows, 5, share=2)) == 0 and len(simhash_dedup._common(rows.limit(0), 5)) == 0
