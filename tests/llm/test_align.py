"""Alignment against merging one document's tokens with Python lists, through the tokenizers' own libraries."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from annulus.llm import align

TEXTS = ["", None, "a", " ", "plain words, twice. plain words", "\n\n\ttabs\r\n", "日本語のテキスト 😀😀 é", "<|endoftext|> and <s> </s> <unk>", "x\x00y", "longwordwithoutanyspaces" * 40, "the end of the line " * 400, "ﬁ ½ Ⅷ é", "▁already▁marked", "  two  spaces  "]


@pytest.fixture(scope="module")
def tokenizers():
    return align.Tokenizers(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


def brute(rows):
    byte_level = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    byte_level.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    found, count = [], Counter()
    for doc_id, text in rows:
        a = byte_level.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        of_a = [bytes(to_byte[c] for c in byte_level.id_to_token(t)) for t in a]
        of_b = [bytes([t - 3]) if model.is_byte(t) else model.id_to_piece(t).replace("▁", " ").encode() for t in b]
        whole = b" " + text.encode() if text else b""
        if b"".join(of_a) != whole or b"".join(of_b) != whole:
            a, b, of_a, of_b = [], [], [], []
        spans = []
        for tokens in (of_a, of_b):
            ends = np.cumsum([len(t) for t in tokens]).tolist()
            spans.append([(e - len(t), e) for t, e in zip(tokens, ends)])
        linked = [(x, y) for x, (s, e) in enumerate(spans[0]) for y, (t, f) in enumerate(spans[1]) if s < f and t < e]
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for end in common:
            groups.append(",".join(str(t) for t, (s, e) in zip(a, spans[0]) if low <= s and e <= end) + "|" + ",".join(str(t) for t, (s, e) in zip(b, spans[1]) if low <= s and e <= end))
            low = end
        pairs = [(a[x], b[y]) for x, y in linked]
        count.update(pairs)
        found.append((doc_id, len(a), len(b), len(common), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return sorted(((d, na, nb, g, len(p), sum(count[x] == most[x[1]] for x in p), sum(count[x] for x in p), h) for d, na, nb, g, p, h in found), key=str)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def reported(spark, rows, tokenizers, **kw):
    found = align.report(align.tokenized(rows_of(spark, rows), tokenizers), tokenizers, **kw)
    return sorted((tuple(r) for r in found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_report_equals_brute_force(spark, tokenizers, monkeypatch):
    r = np.random.default_rng(2)
    alphabet = list("abcdefgh    .,\n'é日\t😀0123AZ")
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "".join(r.choice(alphabet, r.integers(1, 300)))) for i in range(60)]
    rows += [(None, "no id"), (3, " "), (3, " "), (4, "same id, other text")]
    want = brute(rows)
    assert reported(spark, rows, tokenizers) == want
    assert reported(spark, rows, tokenizers, most=97) == want  # counts in many slices


def test_lanes_change_nothing(tokenizers):
    r = np.random.default_rng(3)
    for trial in range(30):
        na, nb, ends_a, ends_b, at = [], [], [], [], 0
        for _ in range(r.integers(1, 6)):
            size = int(r.integers(1, 400)) if trial % 3 else int(r.integers(1, 4))
            x, y = (np.union1d(r.integers(1, size + 1, size), [size]) for _ in range(2))
            na.append(len(x)), nb.append(len(y)), ends_a.append(at + x), ends_b.append(at + y)
            at += size
            if r.random() < 0.3:
                na.append(0), nb.append(0)
        na, nb, ends_a, ends_b = np.array(na), np.array(nb), np.concatenate(ends_a), np.concatenate(ends_b)
        starts_a, starts_b = np.r_[0, ends_a[:-1]], np.r_[0, ends_b[:-1]]
        want = [(i, j, ends_a[i] == ends_b[j]) for i in range(len(ends_a)) for j in range(len(ends_b)) if starts_a[i] < ends_b[j] and starts_b[j] < ends_a[i]]
        for length in (1, 7, 10_000):
            i, j, cut = align.lockstep(ends_a, ends_b, *align.lanes(ends_a, ends_b, na, nb, length))
            assert list(zip(i.tolist(), j.tolist(), cut.tolist())) == want


def test_links_of_rows(spark, tokenizers):
    rows = [(1, "hello worldly"), (2, None), (3, "日本")]
    tokens = align.tokenized(rows_of(spark, rows), tokenizers)
    ids = {r.doc_id: [np.frombuffer(x, kind).tolist() for x, kind in zip((r.a, r.b), tokenizers.kinds)] for r in tokens.collect()}
    for r in align.links(tokens, tokenizers).collect():
        a, b = ids[r.doc_id]
        assert len(r.i) == len(r.j) == len(r.ends_group)
        if a:
            assert set(r.i) == set(range(len(a))) and set(r.j) == set(range(len(b))) and r.ends_group[-1]
        else:
            assert r.i == []


def test_no_rows_and_clashing_names(spark, tokenizers):
    assert reported(spark, [], tokenizers) == []
    docs = spark.createDataFrame([(1, "one two", 5, 6, "n")], "doc_id long, text string, row int, a int, links string")
    assert align.report(align.tokenized(docs, tokenizers), tokenizers).first().n_a == 2
