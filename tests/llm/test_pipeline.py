"""The pipeline against a brute-force version on a small corpus."""

import hashlib
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import pytest

from annulus.llm import quality, queries, secrets

from .helpers import SCHEMA, documents, edge_rows, prose
from .test_minhash import brute as minhash_brute

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root, r, rows = tmp_path_factory.mktemp("corpus"), random.Random(3), []
    for i in range(160):
        text = "BUY!! " * r.randint(20, 60) + str(i) if i % 8 == 0 else prose(r.randint(30, 90), i)
        if i % 10 == 3:
            text += f" token = {hashlib.sha256(str(i).encode()).hexdigest()}"
        if i % 20 == 7:
            text = rows[-2][1]
        rows.append((i, text, "en", ["a", "b", "c", None][i % 7 % 4], len(text)))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 != 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), rows


def brute(rows):
    from tokenizers import Tokenizer
    import numpy as np

    known = [(i, t) for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    forest = quality.fit(np.array([quality.statistics(t) for _, t in known]), np.array([float(i % 8 != 0) for i, _ in known]))
    kept = [r for r in rows if forest.score(np.array([quality.statistics(r[1])]))[0] >= 0.5]
    alike = minhash_brute([r[:2] for r in kept])
    kept = [r for r in kept if r[0] in alike]
    masked = [(i, secrets._masked(t, sorted((a, b) for a, b, _ in secrets.base_spans(t) + secrets.extra_spans(t)), "[SECRET]"), s) for i, t, _, s, _ in kept]
    size = {i: len(WORD.findall(t)) for i, t, _ in masked}
    order = sorted({s for *_, s in masked}, key=lambda s: (s is None, s))
    total = {s: sum(size[i] for i, _, o in masked if o == s) for s in order}
    weight, held = {s: 1 + k % 3 for k, s in enumerate(order)}, set()
    while True:
        level = (sum(total.values()) - sum(3 * total[s] for s in held)) / max(1, sum(weight[s] for s in order if s not in held))
        more = {s for s in order if weight[s] * level > 3 * total[s]}
        if more <= held:
            break
        held |= more
    out, tokenizer = [], Tokenizer.from_file(queries.vocabulary_path())
    for s in order:
        target = 3 * total[s] if s in held else weight[s] * level
        whole = int(target // total[s])
        left = round(target - whole * total[s])
        for i, t, _ in sorted((m for m in masked if m[2] == s), key=lambda m: hashlib.md5(f"0:{m[0]}:{hashlib.md5(m[1].encode()).hexdigest()}".encode()).hexdigest()):
            extra = max(0, min(left, size[i]))
            left -= size[i]
            for text in [t] * whole + ([t if extra == size[i] else " ".join(WORD.findall(t)[:extra])] if extra else []):
                ids = tokenizer.encode(text, add_special_tokens=False).ids
                out.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_run_equals_brute_force(spark, corpus):
    root, rows = corpus
    assert sorted(map(tuple, corpus_pipeline.run(spark, root).collect())) == sorted(brute(rows))


def test_stages(spark, corpus):
    root, _ = corpus
    docs = first = spark.read.parquet(f"{root}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, root)
        assert docs.columns == first.columns
    assert docs.where("text RLIKE '[0-9a-f]{64}'").count() == 0


LABELS = "doc_id long, quality int, toxic int"


def _sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_run_on_edge_rows(spark, tmp_path):
    """Nulls, blanks, repeated rows and ids, a very long text and clashing names, through all stages."""
    secret = "token = abcdefgh12345678 x"
    rows = [*edge_rows(), (10, secret, "en", None, len(secret)), (11, secret, None, "b", None)]
    documents(spark, rows, clashing=True).write.parquet(f"{tmp_path}/documents.parquet")
    # labels of one kind: all are accepted
    spark.createDataFrame([(i, 1, 0) for i in range(12)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    text = {r[0]: r[1] for r in rows}
    # of the copies 1, 2 and 2 the first stays, of the blank ones 3, of the long ones 6, of the secrets 10
    thrice = [(3, None), (9, "x"), (9, "another text under the same id"), (None, "no id here at all, only words in a row"), (8, text[8]), (10, "[SECRET] x")]
    want = Counter((i, _sha(t)) for i, t in thrice for _ in range(3))
    # the other sources stop at three times their words; what is left of the budget is source a's
    total = 30_007 + 7 + 10 + 6 + 2
    left = total - 3 * (7 + 10 + 6 + 2)
    for i in sorted((1, 6), key=lambda i: hashlib.md5(f"0:{i}:{hashlib.md5(text[i].encode()).hexdigest()}".encode()).hexdigest()):
        words = WORD.findall(text[i])
        if left:
            want[i, _sha(text[i] if left >= len(words) else " ".join(words[:left]))] += 1
        left = max(0, left - len(words))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in got) == want
    assert all((r.n_tokens == 0) == (r.doc_id == 3) for r in got)


def test_run_without_labels_or_rows(spark, tmp_path):
    """No label fits: all documents stay. No document: no row."""
    spark.createDataFrame([(99, 0, 0), (98, None, None)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark)
    assert corpus_pipeline.keep_quality(spark, docs, str(tmp_path)).count() == len(edge_rows())
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
