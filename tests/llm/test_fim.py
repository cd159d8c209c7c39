"""Fill-in-middle against a text at a time, and rebuilt texts."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from annulus.llm import fim


def one(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_equals_brute_force(spark):
    r = np.random.default_rng(1)
    alphabet = list("abcXYZ  <PSM>\n\r\t\x00é日😀\x7f\xff. ")
    rows = [(i, "".join(r.choice(alphabet, r.integers(0, 60)))) for i in range(600)]
    rows += [(None, "no id"), (None, None), (5, "twice"), (5, "twice"), (-3, "below zero"), (2**62, "x<" * 30), (700, ""), (701, None), (702, "<P>"), (703, "letters" * 300_000), (704, "日 " * 200_000), (705, "ends with <"), (706, "<S")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("n"), F.lit(2).alias("h1"), F.lit(3).alias("form"))
    made = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(x[:6]) for x in made), key=str) == sorted((one(*x) for x in rows), key=str)
    assert sorted(((x.doc_id, x.back) for x in made), key=str) == sorted(((d, t or "") for d, t in rows), key=str)
    assert {x.form for x in made} == {"plain", "psm", "spm"}


def test_no_rows(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
