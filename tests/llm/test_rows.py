"""Results that belong to their row, whatever its size, order, alphabet and columns."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus.llm import licenses, mixing, neardup, quality, queries, secrets, topk, urls

from .helpers import SCHEMA, documents, edge_rows, prose, rows_of

ODD = ("a.b", "first_id", "first_content", "rest", "nth", "dirty_blob", "starts", "ends", "new_text", "own", "copy", "at_end", "`x`")


def test_odd_columns_pass_through_stages(spark):
    docs = documents(spark).toDF("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.select("*", *(F.lit(f"own {c}").alias(c) for c in ODD))
    made = {
        "dedup": neardup.deduplicated(docs),
        "redacted": secrets.redacted(docs, secrets.update(docs)),
        "joined": secrets.redacted(docs, secrets.update(docs), most=-1),
        "mixed": mixing.mixed_documents(docs),
    }
    for df in made.values():
        assert df.columns == docs.columns
        assert all(r[c] == f"own {c}" for r in df.collect() for c in ODD)


# ---- mixing


def test_mix_where_the_rest_ends_among_repeated_rows(spark):
    """A third of a source is one row, and rows without an id share no place."""
    rows = [(7, "same words here", "en", "a", 15)] * 40 + [(None, prose(3, i), "en", "a", 9) for i in range(60)] + [(i, prose(9, i), "en", "b", 9) for i in range(100, 120)]
    docs = documents(spark, rows).repartition(5)
    for seed in range(4):
        got = mixing.mix(docs, seed=seed).collect()
        assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
        for s in "ab":
            mine = [r for r in got if r.source == s]
            assert abs(sum(r.taken for r in mine) - mine[0].target) < 1
        words = sum(len(r.text.split()) for r in mixing.mixed_documents(docs, seed=seed).collect())
        assert words == sum(r.taken for r in got)


# ---- top-k


@pytest.mark.parametrize("size", [3e5, 1e6, 1e9, 3e12])
def test_scores_of_large_components(spark, size):
    r = np.random.default_rng(int(size))
    rows = r.normal(size=(160, 5)) * np.where(r.random((160, 1)) < 0.5, size, 1)
    if size < 1e9:  # scores must stay longs
        rows[:3] = [[size, 0, 0, 0, 0], [size, 0, 0, 0, 0], [size * 0.3, 0, 0, 0, 0]]
    else:
        rows[:, 1:] /= size
        rows[:, 0] = np.where(np.arange(160) % 2, 2.0**-9, rows[:, 0] / size * 1e4)
    exact = [[math.floor(256 * float(x)) for x in row] for row in rows]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
    for block in (23, 1000):
        got = topk.search(df, F.col("vec_id") % 50 == 0, 5, block=block).collect()
        for i in range(0, 160, 50):
            best = sorted((-sum(a * b for a, b in zip(exact[i], exact[j], strict=True)), j) for j in range(160) if j != i)[:5]
            assert [(-x["score"], x["vec_id"]) for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == i] == best


def test_python_integers_and_scores_that_are_no_longs():
    rows = np.array([[1e300, 1.0], [0.0, 3.0], [0.0, 2.0], [-1e300, 5.0]])
    queries_, held = topk._matched(topk._matrix(list_of([[0.0, 1.0]]), 256.0), topk._matrix(list_of(rows.tolist()), 256.0))
    ids, scores = topk.SortedLists(np.arange(4), held).search(queries_[0], -1, 3)
    assert ids.tolist() == [3, 1, 2] and [int(s) for s in scores] == [256 * 1280, 256 * 768, 256 * 512]
    with pytest.raises(OverflowError):
        topk._long(1 << 63)


def list_of(rows):
    import pandas as pd

    return pd.Series([np.array(x) for x in rows])


def test_a_floor_ends_a_block_at_once():
    rows = np.random.default_rng(1).normal(size=(500, 4))
    lists = topk.SortedLists(np.arange(500), rows)
    ids, _ = lists.search(rows[0], 0, 5, floor=10**6)
    assert not len(ids) and lists.read == 0


# ---- urls


def splits(piece):
    for mask in range(1 << max(0, len(piece) - 1)):
        cuts = [0, *(i + 1 for i in range(len(piece) - 1) if mask >> i & 1), len(piece)]
        yield [piece[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def score(words, counts, total):
    return sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10) for w in words)


def test_viterbi_is_the_best_of_all_splits():
    r = random.Random(1)
    for _ in range(150):
        counts = {"".join(r.choices("abé", k=r.randint(1, 6))): r.randint(1, 50) for _ in range(r.randint(0, 12))}
        piece, total = "".join(r.choices("abé", k=r.randint(1, 11))), sum(counts.values()) or 1
        best = max(score(w, counts, total) for w in splits(piece))
        assert abs(score(urls.viterbi(piece, counts, total), counts, total) - best) < 1e-9
    long = "electroencephalographs"
    assert urls.viterbi("my" + long + "news", {long: 3, "my": 9, "news": 9}, 21) == ["my", long, "news"]
    many = ["news", "paper"] * 40  # 360 letters
    assert urls.viterbi("".join(many), {"news": 5, "paper": 5}, 10) == many
    assert urls.viterbi("q" * 90, {"a": 1}, 1000) == ["q" * 90]


def test_long_pieces_are_split_over_their_seams(spark):
    r = random.Random(8)
    counts = {"cheap": 9, "pills": 7, "news": 20, "paper": 12, "newspaper": 6, "köln": 3, "новости": 5, "w" * 300: 2}
    pieces = ["", "a", "news", "w" * 300, "q" * 700, "".join(r.choices(list(counts), k=400)), "newspaper" * 8000]
    pieces += ["x" * n + "newspaper" + "y" * 5 for n in range(urls._PART - 10, urls._PART + 2)]  # at a seam
    frame = spark.createDataFrame([(p,) for p in pieces], "piece string")
    got = {x.piece: x.words for x in urls.segmented(frame, spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == {p: urls.viterbi(p, counts, sum(counts.values())) for p in pieces}


def test_verdicts_brute_force(spark):
    """Segmentation, tokens and log-odds of every page against a plain version."""
    import re

    r = random.Random(4)
    words = ["cheap", "pills", "köln", "news", "новости", "paper", "buy", "read", "electroencephalographs"]
    pages = []
    for i in range(80):
        host = "".join(r.choices(words, k=r.randint(1, 3))) + r.choice([".bad.com", ".good.com", ".org", str(i % 7) + ".net"])
        path = "/" + "".join(r.choices(words, k=r.randint(0, 3))) + r.choice(["", "/12", "/1234/x"])
        pages.append((i, f"http://{host}{path}", " ".join(r.choices(words, k=5)) + "<b>markup</b>"))
    pages += [(100, None, None), (101, "http://", "")]
    rules = [urls.Rule("block", "bad.com/"), urls.Rule("allow", "good.com/")]
    got = {x.page_id: x for x in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}

    letters = re.compile(r"[^\W\d_]+")
    counts = Counter(w for *_, h in pages for w in letters.findall(re.sub("<[^>]*>", " ", h or "").lower()))
    total = sum(counts.values())

    def tokens(part):
        return [w for p in letters.findall(part.lower()) for w in urls.viterbi(p, counts, total)] + [f"#{len(n)}" for n in re.findall(r"\d+", part)]

    seen = {"block": Counter(), "allow": Counter()}
    share = Counter()
    for x in got.values():
        if x.rule:
            share[x.verdict] += 1
            seen[x.verdict].update(tokens(x.host) + tokens(x.path))
    vocabulary = set(seen["block"]) | set(seen["allow"])
    size = {v: sum(seen[v].values()) + len(vocabulary) + 1 for v in seen}
    for x in got.values():
        if not x.rule:
            odds = math.log(share["block"] / share["allow"]) + sum(math.log((seen["block"][t] + 1) / size["block"]) - math.log((seen["allow"][t] + 1) / size["allow"]) for t in tokens(x.host) + tokens(x.path))
            assert abs(odds - x.block_odds) < 1e-6 and x.verdict == ("block" if x.block_odds > 0 else "allow")
    assert sum(x.rule is None for x in got.values()) > 20


# ---- quality


def test_training_does_not_depend_on_the_order_of_rows(spark):
    r = random.Random(2)
    rows = [(i, prose(50, i) if i % 2 else "SPAM!! " * 30 + str(i), "en", "a", 0) for i in range(120)]
    rows += [(i, "SPAM!! " * r.randint(1, 40) if r.random() < 0.5 else prose(40, 500 + i), "en", "b", 0) for i in range(0, 120, 3)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    found = []
    for order in (rows, rows[::-1], r.sample(rows, len(rows))):
        docs = documents(spark, order)
        found.append(rows_of(quality.scored(docs, quality.train(docs, labels))))
    assert found[0] == found[1] == found[2]


def test_letters_beyond_the_basic_plane_are_letters():
    gothic = quality.statistics("\U00010330\U00010331 \U0001f600")
    at = quality.FEATURES.index
    assert gothic[at("letters")] == 0.5 and gothic[at("other")] == 0.25


# ---- near copies and secrets


def test_of_repeated_rows_the_same_one_stays(spark):
    rows = [(1, "one two three four five six", "de", "z", 5), (1, "one two three four five six", "en", "a", 5), (1, "one two three four five six", None, "b", 5), (2, "one two three four five six", "en", "c", 5)]
    kept = {rows_of(neardup.deduplicated(spark.createDataFrame(order, SCHEMA)))[0] for order in (rows, rows[::-1], rows[2:] + rows[:2])}
    assert len(kept) == 1 and next(iter(kept))[0] == 1


def test_blobs_by_join_and_a_pair_that_is_there_twice(spark):
    docs = documents(spark, edge_rows() + [(20, "token = abcdefgh", "en", "a", 0), (21, "token = abcdefgh", "en", "a", 0)])
    usual, joined = secrets.scan(docs), secrets.scan(docs, most=-1)
    assert rows_of(usual) == rows_of(joined)
    twice = usual.unionByName(usual)
    assert rows_of(secrets.report(docs, twice)) == rows_of(secrets.report(docs, usual))
    assert rows_of(secrets.redacted(docs, twice, most=-1)) == rows_of(secrets.redacted(docs, usual))


# ---- licenses


def test_rows_of_one_id_match_their_own_text(spark):
    mit, cc = "see: Released under the MIT License. ok", "Licensed under CC BY-SA 4.0."
    rows = [(1, mit, "en", "a", 0), (1, "plain words without any notice", "en", "a", 0), (None, cc, "en", "a", 0), (None, "nothing to see in this text", "en", "a", 0), (None, None, "en", "a", 0), (0, mit, "en", "a", 0)]
    got = rows_of(licenses.report(documents(spark, rows), licenses.templates(spark)).select("doc_id", "licenses"))
    assert got == sorted([(1, "mit"), (1, ""), (None, "cc-by-sa-4.0"), (None, ""), (None, ""), (0, "mit")], key=repr)


def test_windows_find_changed_texts(spark):
    """Whole texts with words changed: all that exact containment accepts, wherever they begin."""
    import re

    r, rows = random.Random(9), []
    long = {k: v for k, v in licenses.TEMPLATES.items() if len(v.split()) > 21}
    for i in range(150):
        notice = r.choice([*long.values()]).split()
        for _ in range(r.randint(0, max(1, len(notice) // 40))):
            notice[r.randrange(len(notice))] = "changed"
        notice = notice[r.randint(0, 2) :]
        rows.append((i, f"{prose(r.randint(0, 30), i)} {' '.join(notice)} {prose(r.randint(0, 30), 500 + i)}", "en", "a", 0))

    def shingles(text):
        words = re.findall(r"[^\W_]+", text.lower())
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    known = {k: shingles(v) for k, v in licenses.TEMPLATES.items() if k != "all-rights-reserved"}
    want = {(i, k) for i, t, *_ in rows for k, v in known.items() if len(v & shingles(t)) / len(v) >= 0.8}
    got = {(x.doc_id, x.template_id) for x in licenses.scan(documents(spark, rows), licenses.templates(spark)).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 100
    assert licenses.meets(11 / 21) > 0.99 and licenses.meets(1.0) == 1


def test_versions_in_turn_scan_each_pair_once(spark, tmp_path):
    first = [(i, f"text {i % 7} password = abcdefgh{i % 7} " + "ghp_" + "a" * 36) for i in range(30)]
    second = [(i, t if i % 2 else t + " changed") for i, t in first] + [(99, None), (100, "")]
    blobs = [{t or "" for _, t in rows} for rows in (first, second)]
    for most in (100_000, 1, -1):  # texts stay, the blobs to scan are sent, texts are shuffled
        path = str(tmp_path / f"ledger{most}")
        for nth, rows in enumerate((first, second)):
            docs = spark.createDataFrame(rows, "doc_id long, text string")
            for version in (secrets.BASE, secrets.EXTRA):
                known = spark.read.parquet(path) if nth or version == secrets.EXTRA else None
                pairs = secrets.scan(docs, known, (version,), most)
                # of the second version of the corpus, new texts only
                assert pairs.count() == len(blobs[nth] - (blobs[0] if nth else set())), (most, nth, version)
                secrets.update(docs, path, (version,))
        ledger = spark.read.parquet(path)
        assert ledger.count() == 2 * len(blobs[0] | blobs[1])
        assert rows_of(secrets.report(docs, ledger)) == rows_of(secrets.report(docs, secrets.update(docs)))
    docs = spark.createDataFrame(first, "doc_id long, text string")
    assert rows_of(secrets.report(docs, secrets.in_turn(docs, str(tmp_path / "turn")))) == rows_of(secrets.report(docs, secrets.update(docs)))
