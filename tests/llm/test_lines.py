"""Line dedup against sets and dictionaries of whole lines."""

import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from annulus.llm import lines
from annulus.sources.scratch import scratch_path

SPACE = " \t\n\x0b\x0c\r"
LONG = "This line is surely long enough to count as one"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, least_docs=5, least_chars=40):
    holders = defaultdict(list)
    for doc_id, text in rows:
        for key in {key_of(x) for x in (text or "").split("\n")}:
            holders[key].append(-1 if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        every = (text or "").split("\n")
        kept = [x for x in every if not (len(key_of(x)) >= least_chars and len(holders[key_of(x)]) >= least_docs and max(holders[key_of(x)]) != (-1 if doc_id is None else doc_id))]
        out.append((doc_id, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def made(n, seed):
    r = np.random.default_rng(seed)
    pool = [f"{LONG}, number {i}, with É and 日本" for i in range(25)] + ["short", "", "   ", "x" * 39, "y" * 40]
    rows = []
    for i in range(n):
        picked = [pool[j] for j in r.integers(0, len(pool), r.integers(0, 9))]
        rows.append((int(i), "\n".join((" " * int(r.integers(3)) + (x.upper() if r.random() < 0.2 and x.isascii() else x) + "\r" * int(r.integers(2))) for x in picked)))
    return rows


ROWS = made(120, 1) + [(None, LONG), (None, LONG + "\n" + LONG), (7, made(8, 1)[7][1]), (7, LONG), (8, LONG), (9, LONG), (500, None), (501, ""), (502, "\n\n"), (503, LONG + " longer" * 50_000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=str)


def test_equals_brute_force(spark):
    for few in (lines.FEW, 0):  # keys in the tasks, and by joins
        for batches in (1, 4):
            assert found(lines.deduplicated(frame(spark, ROWS), batches=batches, few=few)) == brute(ROWS)


def test_only_null_ids(spark):
    rows = [(None, LONG + f"\n{i}") for i in range(6)]
    assert found(lines.deduplicated(frame(spark, rows))) == brute(rows)


def test_no_rows_and_clashing_names(spark):
    assert found(lines.deduplicated(frame(spark, []))) == []
    docs = frame(spark, ROWS[:60]).select("*", F.lit(1).alias("a"), F.lit(2).alias("n_lines"), F.lit("x").alias("marks"), F.lit(3).alias("own_id"), F.lit(4).alias("b.c"))
    for few in (lines.FEW, 0):
        kept = lines.deduplicated(docs, few=few)
        assert found(kept) == brute(ROWS[:60]) and kept.columns == ["doc_id", "a", "marks", "own_id", "b.c", "text", "n_lines", "n_dropped"]
        assert kept.select("a", "marks", "own_id", "`b.c`").distinct().collect() == [(1, "x", 3, 4)]


def test_runs_are_levelled_and_found_again(spark):
    path = scratch_path(spark, "runs")
    runs = lines.LineRuns(spark, path, buckets=4)
    rows = made(90, 5)
    for at in range(0, 90, 9):
        runs.add(lines.counted(lines.keys_of(frame(spark, rows[at : at + 9]))))
    assert sorted(level for _, level, _ in runs.runs) == [1, 3]  # of 10 batches 8 were merged three times, and 2 once
    again = lines.LineRuns(spark, path)
    assert again.runs == runs.runs and again.buckets == 4
    whole = lines.counted(lines.keys_of(frame(spark, rows)))
    order = ["a", "b", "docs", "last"]
    assert sorted(again.merged().select(order).collect()) == sorted(whole.select(order).collect())
    assert again.unseen(whole).count() == 0
    plan = again.merged()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan, plan


def test_update_keeps_what_is_new(spark):
    runs = lines.LineRuns(spark, scratch_path(spark, "runs"), fanout=2, buckets=4)
    seen = defaultdict(int)
    for batch in ([(1, LONG), (2, LONG)], [(3, LONG), (4, LONG)], [(5, LONG + "\nown"), (6, LONG)], [(i, LONG + f" {n}") for i in range(7, 12) for n in (1,)]):
        kept = found(lines.update(runs, frame(spark, batch)))
        own = defaultdict(list)
        for doc_id, text in batch:
            for key in {key_of(x) for x in text.split("\n")}:
                own[key].append(doc_id)
        want = []
        for doc_id, text in batch:
            stays = []
            for x in text.split("\n"):
                k = key_of(x)
                common = len(k) >= 40 and seen[k] + len(own[k]) >= 5
                if not common or not seen[k] and max(own[k]) == doc_id:
                    stays.append(x)
            n = len(text.split("\n"))
            want.append((doc_id, n, n - len(stays), "\n".join(stays)))
        assert kept == sorted(want, key=str)
        for k, holders in own.items():
            seen[k] += len(holders)


def test_digest_of_the_query(spark, tmp_path):
    from annulus.llm.queries import op12_lines

    frame(spark, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op12_lines(spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)
    assert got == sorted(((d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in brute(ROWS)), key=str)
