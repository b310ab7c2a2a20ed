"""Exact, suffix and near dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlog.llm import components, exact_dedup, simhash_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, text_sha256 string"


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "clash") for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def test_exact_groups(spark):
    texts = ["a", "b", "a", None, "", "a", "B"]
    rows = {r.doc_id: r for r in exact_dedup.assign_groups(docs_of(spark, texts), keep="largest").collect()}
    assert [rows[i].keep_id for i in range(7)] == [5, 1, 5, 4, 4, 5, 6]
    assert [rows[i].group_size for i in range(7)] == [3, 1, 3, 2, 2, 3, 1]
    assert {i for i, r in rows.items() if r.kept} == {1, 4, 5, 6}
    assert rows[0].text_sha256 == hashlib.sha256(b"a").hexdigest()
    low = {r.doc_id: r.keep_id for r in exact_dedup.assign_groups(docs_of(spark, texts)).collect()}
    assert [low[i] for i in range(7)] == [0, 1, 0, 3, 3, 0, 6]


def test_exact_edges(spark):
    assert exact_dedup.assign_groups(docs_of(spark, [])).count() == 0
    twice = exact_dedup.assign_groups(docs_of(spark, ["a", "a", "x"], [7, 7, None])).collect()
    assert sorted((r.doc_id is None, r.group_size, r.kept) for r in twice) == [(False, 2, True), (False, 2, True), (True, 1, True)]
    kept = exact_dedup.keep_rows(docs_of(spark, ["a", "a", "x", None], [7, 7, 3, 9]), keep="largest")
    assert kept.columns == ["doc_id", "text", "lang", "text_sha256"]
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, "x"), (7, "a"), (9, None)]
    with pytest.raises(ValueError):
        exact_dedup.assign_groups(docs_of(spark, ["a"]), keep="any")


def made_up(seed, n=40):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab é") for _ in range(rng.randint(0, 200))) for _ in range(8)]
    out = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            i = rng.randint(0, len(b))
            t += b[i : i + rng.randint(0, 90)]
        out.append(t)
    return out + ["ab" * 60, "x" * 100, "x" * 100, None, ""]


@pytest.mark.parametrize("group", [2048, 2])
def test_suffix_matches_brute_force(spark, group):
    """group=2 sends every bucket of three and more the way of the very large ones."""
    texts = made_up(group)
    want = suffix_dedup.brute_force([(t or "").encode() for t in texts], 24)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs_of(spark, texts), length=24, q=8, group=group).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert [(s.start, s.stop) for s in got[i].spans] == want[i], i
        edges = [0, *(x for s in want[i] for x in s), len(raw)]
        assert bytes(got[i].kept) == b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def test_suffix_repeated_ids_and_long_text(spark):
    long = "".join(random.Random(5).choice("abcdefgh ") for _ in range(30_000))
    texts = [long + "x" * 300, "other " * 50, "q" + long[:400], "short", "short"]
    got = suffix_dedup.remove_repeats(docs_of(spark, texts, [1, 1, 2, None, 3])).collect()
    want = dict(zip(texts, suffix_dedup.brute_force([t.encode() for t in texts], 200)))
    assert sorted(r.n_removed for r in got) == sorted(sum(b - a for a, b in want[t]) for t in texts)
    assert sum(r.doc_id is None for r in got) == 1
    assert suffix_dedup.remove_repeats(docs_of(spark, [])).count() == 0


def slow_fingerprint(text):
    import xxhash

    w = [x for x in __import__("re").split(rb"[\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())) if x]
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    for i in range(60):
        w = texts[i].split(" ")
        w[len(w) // 2] = "Ünew\tX"
        texts.append(" ".join(w))
    texts += [None, "", " \n", "One", "one", "É É", "a b c a b c a b c"]
    fps = [slow_fingerprint(t or "") for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    for group in (1024, 2):
        got = {r.doc_id: r for r in simhash_dedup.near_duplicates(docs_of(spark, texts), group=group).collect()}
        assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
        assert [got[i].component_id for i in range(len(texts))] == [root(i) for i in range(len(texts))]
    assert simhash_dedup.near_duplicates(docs_of(spark, [])).count() == 0


def test_keep_one_of_each_group(spark):
    """Rows that repeat an id are judged each; columns may be named like those in use."""
    same, other = "a b c d e f", "quite another text of seven words here"
    texts, ids = [same, same, same, other, other, None, ""], [5, 3, 3, 3, None, None, None]
    docs = docs_of(spark, texts, ids).withColumns({"fp": F.lit("x"), "n": F.lit(1), "row": F.lit(2), "id": F.lit(3)})
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(-1, ""), (3, same), (3, other)]
    assert simhash_dedup.keep_one(docs.limit(0)).count() == 0


def near_by_brute_force(texts):
    """The places of the rows that stay: the first of each component of pairs with a five-word Jaccard similarity of 0.8."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        size = min(5, len(w))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)})
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return {i for i, r in enumerate(root) if r == i}


def test_keep_one_matches_brute_force(spark):
    """Near copies of similarity around 0.8, chains of them, a crowd around one text and a passage that many share."""
    rng = random.Random(8)
    say = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    texts, passage = [], say(60)
    for _ in range(40):
        w = say(rng.randint(5, 150))
        texts.append(" ".join(w))
        for _ in range(rng.randint(0, 4)):
            for _ in range(max(len(w) // 50, 1)):
                w[rng.randint(0, len(w) - 1)] = f"new{rng.randint(0, 9)}"
            texts.append(" ".join(w).upper())
    crowd = say(120)
    for i in range(60):
        w = list(crowd)
        w[rng.randint(0, 119)] = w[rng.randint(0, 119)] = f"c{i}"
        texts.append(" ".join(w))
    texts += [" ".join(passage + say(rng.randint(5, 60))) for _ in range(40)] + [None, "", "One", "one", "a b c d"]
    rng.shuffle(texts)
    want = near_by_brute_force(texts)
    assert 100 < len(want) < len(texts) - 60
    assert {r.doc_id for r in simhash_dedup.keep_one(docs_of(spark, texts)).collect()} == want
    cut = simhash_dedup.keep_one(docs_of(spark, texts), group=8, weight=500)
    assert {r.doc_id for r in cut.collect()} == want


def test_overlaps():
    """Rare shingles, shingles of all sets, more of them than a block, and sets that share none."""
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 63, 5000)
    sets = [np.unique(np.concatenate([rng.choice(common, 3000), rng.integers(0, 300, rng.integers(0, 40))])) for _ in range(40)]
    sets += [np.array([7]), np.array([-9]), np.array([-9])]
    got = simhash_dedup.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(x, y)) for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j)


def test_pipeline_stage_leaves_no_near_copy(spark):
    import corpus_pipeline

    base = " ".join(f"w{i}" for i in range(100)).split(" ")
    texts = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in (10, 50, 90)] + [" ".join(base), "another text of some words"]
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs_of(spark, texts), "").collect()} == {0, 4}


def test_crowded_fingerprints(spark):
    """A crowd around one point, all of it in the same blocks, goes through the finer levels."""
    rng = random.Random(1)
    fps = sorted({0x5555 ^ (1 << rng.randint(0, 63)) ^ (1 << rng.randint(0, 63)) ^ (1 << rng.randint(0, 63)) for _ in range(150)} | {0xFFFF_0000_FFFF_0000})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash_dedup.hamming_links(spark.createDataFrame([(x,) for x in signed], "fp long"), group=8)
    got = {r.node: r.root for r in components.components(links).collect()}
    groups = {}
    for x in signed:
        groups.setdefault(got.get(x, x), set()).add(x % (1 << 64))
    want, left = [], set(fps)
    while left:
        todo, piece = [left.pop()], set()
        while todo:
            x = todo.pop()
            piece.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 3}
            left -= near
            todo += near
        want.append(piece)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 201), (202, 201)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 51)) and got[101] == 100 and got[201] == got[202] == 200
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert F is not None
