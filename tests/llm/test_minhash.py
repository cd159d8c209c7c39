"""The near-copy stage against brute force at its similarity."""

import random

import corpus_pipeline

from annulus.llm import minhash

from .helpers import documents, prose


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows, least=0.8):
    sets, parent = [shingle_set(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for b in range(len(rows)):
        for a in range(b):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}


def edited(text, edits, r):
    words = text.split()
    for at in r.sample(range(len(words)), edits):
        words[at] = f"edit{r.randrange(10**6)}"
    return " ".join(words)


def test_stage_keeps_what_brute_force_keeps(spark):
    """Pairs on both sides of 0.8, short and blank texts, and one group much larger than a block."""
    r, texts = random.Random(5), ["", " \n", None, "x", "X", "one two three", "One  two three", "one two four"]
    for i in range(90):
        base = prose(r.randint(60, 300), 900 + i)
        texts += [base, edited(base, max(1, len(base.split()) * r.choice([1, 2, 3]) // 100), r)]
    base = prose(120, 7)
    texts += [base, *(edited(base, r.randint(1, 4), r) for _ in range(300))]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    want = brute(rows)
    assert 90 < len(want) < len(rows) - 50  # both kinds are there
    docs = documents(spark, rows)
    assert {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == want
    small = minhash.content_groups(docs, 5, block=16)  # many blocks
    assert small.select("component").distinct().count() == len(want)


def test_recall_of_bands_at_the_threshold():
    """Bands alone retrieve pairs that are just similar enough."""
    r, seeds, near, met = random.Random(6), minhash._seeds(42), 0, 0
    while near < 300:
        base = prose(150, r.randrange(10**9))
        a, b = (minhash.shingles(t, 5) for t in (base, edited(base, 3, r)))
        shared = len(set(a.tolist()) & set(b.tolist()))
        if 0.8 <= shared / (len(a) + len(b) - shared) < 0.85:
            near += 1
            met += bool((minhash.bands(a, seeds) == minhash.bands(b, seeds)).any())
    assert met == near


def test_chains_of_buckets_compare_within_buckets_only(spark):
    """Texts whose templates overlap are connected by buckets, though most pairs of them share none."""
    from collections import defaultdict

    from annulus.llm.common import cut

    parts = [prose(20, 5000 + i) for i in range(308)]
    texts = [" ".join(parts[i : i + 8]) for i in range(300)]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    docs, seeds = documents(spark, rows), minhash._seeds(42)
    seen, met = [], minhash._met

    def kept(open_, sets, block):
        seen.append(cut(met(open_, sets, block)))
        return seen[-1]

    minhash._met = kept
    try:
        groups = minhash.content_groups(docs, 5, block=4)
        assert groups.select("component").distinct().count() == len(brute(rows))
    finally:
        minhash._met = met
    buckets = defaultdict(set)
    for i, t in enumerate(texts):
        for key in minhash.bands(minhash.shingles(t, 5), seeds).tolist():
            buckets[key].add(i)
    sharing = {(a, b) for held in buckets.values() for a in held for b in held if a < b}
    held = seen[0].toPandas()
    assert not held["whole"].all()  # chained buckets are cells of their own
    pairs = []
    for (*_, whole, cell), part in held.groupby(["large", "deal", "i", "j", "whole", "cell"]):
        left, right, asked = minhash.compared(part, None if whole else cell)
        names = part["content"].tolist()
        pairs += [tuple(sorted((names[left[x]], names[right[y]]))) for x, y in zip(*asked.nonzero())]
    assert 0 < len(pairs) == len(set(pairs)) <= len(sharing) < 300 * 299 // 2 // 10


def test_fingerprints_retrieve(spark, monkeypatch):
    """Without any band, the stage still links what fingerprints within two bits retrieve and similarity confirms."""
    from annulus.llm import neardup

    r, texts = random.Random(8), ["", " ", None, "x y", "X  Y"]
    for i in range(30):
        base = prose(700, 7000 + i)
        texts += [base, edited(base, 1 + i % 2, r)]
    prints = [neardup.simhash(t, 5) for t in texts]
    for t, p in zip(texts, prints, strict=True):
        assert minhash.fingerprint(minhash.hashed(t, 5)) % (1 << 64) == p
    near = [i for i in range(5, len(texts), 2) if (prints[i] ^ prints[i + 1]).bit_count() <= 2]
    assert 3 < len(near) < 30  # both kinds are there
    docs = documents(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])
    bands = minhash._by_bands
    monkeypatch.setattr(minhash, "_by_bands", lambda texts: bands(texts).where("false"))
    kept = {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == set(range(len(texts))) - {1, 2, 4} - {i + 1 for i in near}


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Edges that are stars are written once and looked at once; a chain still takes its rounds."""
    from annulus.llm import graph

    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(df.columns) or cut(df))
    stars = [(u, u - u % 10) for u in range(200) if u % 10]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(stars, "u long, v long")).collect()}
    assert got == {u: u - u % 10 for u in range(200)} and len(written) == 2
    got = {r.node: r.component for r in graph.components(spark.createDataFrame([(u, u + 1) for u in range(9)], "u long, v long")).collect()}
    assert got == dict.fromkeys(range(10), 0) and len(written) > 4


def test_merged_components(spark):
    """Links between components connect them, also those of single nodes; the others stay."""
    from annulus.llm import graph

    linked = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "node long, component long")
    links = spark.createDataFrame([(5, 1), (5, 3), (1, 5)], "u long, v long")
    got = sorted(map(tuple, graph.merged(linked, links).collect()))
    assert got == [(1, 1), (2, 1), (3, 1), (5, 1), (6, 1), (8, 8), (9, 8)]
    assert sorted(map(tuple, graph.merged(linked, links.where("false")).collect())) == sorted(map(tuple, linked.collect()))


def test_groups_are_connected_once(spark, monkeypatch):
    """Once texts are connected by candidates, later steps connect groups: no step is given all links again."""
    from annulus.llm import graph

    r, base = random.Random(9), prose(120, 11)
    texts = [base, *(edited(base, r.randint(1, 5), r) for _ in range(120)), *(prose(100, 8000 + i) for i in range(20))]
    given, found = [], graph.components

    def kept(edges):
        given.append([tuple(x) for x in edges.where("u <> v").collect()])
        return found(edges)

    monkeypatch.setattr(graph, "components", kept)
    monkeypatch.setattr(minhash, "components", kept)
    docs = documents(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])
    groups = minhash.content_groups(docs, 5)
    assert groups.select("component").distinct().count() == len(brute(list(enumerate(texts))))
    first = {tuple(sorted(x)) for x in given[0]}
    assert len(given) > 1 and len(first) > 50
    for later in (given[1], given[-1]):
        assert len(later) < len(first) and not first & {tuple(sorted(x)) for x in later}
