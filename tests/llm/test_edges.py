"""Each operator on edge cases: no crash, one defined result, other columns left alone, empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from annulus.llm import bpe, fingerprint, licenses, mixing, neardup, quality, queries, repeats, secrets, topk, urls

from .helpers import CLASHING, documents, edge_rows, rows_of

FOREST = None


def forest():
    import numpy as np

    return quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))


OPERATORS = {
    "mixing": lambda d: mixing.mix(d),
    "fingerprint": lambda d: fingerprint.fingerprints(d),
    "quality": lambda d: quality.scored(d, forest()),
    "bpe": lambda d: bpe.encode(d, queries.vocabulary_path()),
    "repeats": lambda d: repeats.deduplicated(d),
    "neardup": lambda d: neardup.near_duplicates(d),
    "secrets": lambda d: secrets.report(d, secrets.update(d)),
    "licenses": lambda d: licenses.report(d, licenses.templates(d.sparkSession)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(spark, name):
    plain = rows_of(OPERATORS[name](documents(spark)))
    ids = sorted((r[0] for r in edge_rows()), key=repr)
    assert sorted((r[0] for r in plain), key=repr) == ids
    assert rows_of(OPERATORS[name](documents(spark, clashing=True))) == plain
    assert OPERATORS[name](documents(spark, [])).collect() == []


def test_stage_forms_keep_columns(spark):
    docs = documents(spark, clashing=True)
    for made in (neardup.deduplicated(docs), secrets.redacted(docs, secrets.update(docs)), mixing.mixed_documents(docs), quality.accepted(docs, forest())):
        assert made.columns == docs.columns
        assert all(r["size"] == "own size" and r["fp"] == "own fp" for r in made.collect())
    empty = documents(spark, [])
    for made in (neardup.deduplicated(empty), secrets.redacted(empty, secrets.update(empty)), mixing.mixed_documents(empty), quality.accepted(empty, forest())):
        assert made.columns == empty.columns and made.count() == 0


def test_vectors_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, None]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, None), (5, [0.5, 0.5]), (6, [0.5, 0.5]), (6, [0.5, 0.5]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [0.9, 0.0]), (50, [-1.0, 0.25]), (100, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("own") for c in CLASHING})
    for block in (2, 1000):
        got = topk.search(df, F.col("vec_id") % 50 == 0, 3, block=block).collect()
        found = {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 50, 100)}
        assert found[0] == [(None, 256 * 230), (5, 256 * 128), (6, 256 * 128)]
        assert found[100] == [(0, 0), (5, 0), (6, 0)]  # all scores tie at 0
        assert len(found[50]) == 3
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_urls_edges(spark):
    rows = [(1, "https://A.Example.COM/en/7x?q"), (2, None), (3, "no scheme"), (4, "http://"), (5, "ftp://net/de/"), (5, "ftp://net/de/"), (None, "http://x.net?/de/"), (6, "http://notnet/de/1"), (7, "http://" + "a" * 200 + ".com/zz"), (8, "http://h\n.org/es/\n1")]
    pages = spark.createDataFrame([(i, u, "<p>some words</p>" if i else None) for i, u in rows], "page_id long, url string, html string").withColumns({c: F.lit("own") for c in CLASHING})
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in urls.judge(pages, queries.URL_RULES).collect()}
    assert got[1, "a.example.com", "/en/7x"] == ("example.com/en/7", "allow")
    assert got[2, "", ""][0] is None and got[3, "", ""][0] is None and got[4, "", ""][0] is None
    assert got[5, "net", "/de/"] == ("net/de/", "allow")
    assert got[None, "x.net", ""][0] is None and got[6, "notnet", "/de/1"][0] is None
    assert got[8, "h\n.org", "/es/\n1"] == ("org/es/", "block")
    assert urls.judge(pages.limit(0), queries.URL_RULES).collect() == []
    assert urls.judge(pages, []).where("rule IS NOT NULL").count() == 0


def test_null_text_counts_as_empty(spark):
    got = {r.doc_id: r for r in bpe.encode(documents(spark), queries.vocabulary_path()).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[3].n_tokens == 0 and got[3].ids_sha256 == empty and got[4].decoded_sha256 == empty
