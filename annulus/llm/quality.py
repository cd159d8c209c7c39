"""Quality classifier: histogram gradient-boosted trees over document statistics.

Tasks turn each whole text into a row of statistics. The trees are fitted on a bounded sample of the
labelled rows: at most ``most`` of them, those with the smallest hash of the id, as many at every
size of the input. Only their statistics reach the driver, one row for each id, so ``most`` bounds its
memory. Of documents that share a sampled id, the text with the smallest hash is learned. A tree is a
full binary tree of fixed depth, and the forest is three flat arrays, so a batch of rows goes down
one level of all trees by indexing.

Edge cases: null and empty texts have statistics of zero and get a score like any other; a null id
hashes as the empty string; ids labelled more than once take the mean of their labels, and those at
one half are left out, as are null labels. With no labelled row, or none of one kind, the score is
the share of label 1 that was seen, one half if nothing was. Repeated rows get the same score. Only
doc_id and text are read, so other columns can have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_back, id_text

#: Of each text; see statistics().
FEATURES = ("chars", "words", "mean_word", "long_words", "letters", "upper", "digits", "spaces", "marks", "symbols", "bars", "exclaims", "other", "distinct", "top_word", "repeats", "distinct_pairs", "lines", "distinct_lines", "top_char", "entropy", "marked_words", "upper_words", "sentence", "sd_word", "distinct_tail")
_LETTER, _UPPER, _DIGIT, _SPACE, _MARK, _SYMBOL, _BAR, _EXCLAIM, _OTHER = range(9)


# Characters of classes of their own.
_OWN = {_MARK: ".,;:'\"()-?", _SYMBOL: "#$%&*@^~+=<>/\\_{}[]", _BAR: "|", _EXCLAIM: "!"}


def _class(c: str) -> int:
    own = next((k for k, chars in _OWN.items() if c in chars), None)
    if own is not None:
        return own
    if c.isalpha():
        return _UPPER if c.isupper() else _LETTER
    return _DIGIT if c.isdigit() else _SPACE if c.isspace() else _OTHER


_KIND = np.array([_class(chr(i)) for i in range(0x10000)], np.uint8)  # rarer characters are classified as they come
_CHUNK = 1 << 20


def statistics(text: str | None) -> list[float]:
    """One number for each of FEATURES, over the whole text."""
    if not text:
        return [0.0] * len(FEATURES)
    kinds, chars = np.zeros(9, np.int64), np.zeros(256, np.int64)
    for at in range(0, len(text), _CHUNK):
        codes = np.frombuffer(text[at : at + _CHUNK].encode("utf-32-le", "surrogatepass"), "<u4")
        kinds += np.bincount(_KIND[codes[codes <= 0xFFFF]], minlength=9)
        for c, times in zip(*(x.tolist() for x in np.unique(codes[codes > 0xFFFF], return_counts=True)), strict=True):
            kinds[_class(chr(c))] += times
        chars += np.bincount(codes & 0xFF, minlength=256)
    n, words, lines = len(text), text.split(), text.splitlines()
    counts, m = Counter(words), max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    share = chars[chars > 0] / n
    pairs = set(zip(words, words[1:], strict=False))
    marked = sum(k for w, k in counts.items() if w[-1] in "#$%&*!|")
    shouted = sum(k for w, k in counts.items() if w.isupper())
    ends = sum(k for w, k in counts.items() if w[-1] in ".!?")
    tail = words[len(words) // 2 :]
    return [
        np.log1p(n), np.log1p(len(words)), lengths.mean(), (lengths > 14).mean(),
        *(kinds / n),
        len(counts) / m, max(counts.values(), default=0) / m,
        sum(map(str.__eq__, words, words[1:])) / m, len(pairs) / m,
        np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)),
        share.max(), float(-(share * np.log(share)).sum()),
        marked / m, shouted / m, m / (1 + ends), lengths.std(), len(set(tail)) / max(1, len(tail)),
    ]


@dataclass
class Forest:
    """``depth`` levels of inner nodes a tree, in heap order: children of node i are 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # go right above it
    leaf: np.ndarray  # trees x leaves
    base: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        feature, threshold, leaf = self.feature.ravel(), self.threshold.ravel(), self.leaf.ravel()
        node = np.zeros((len(rows), trees), np.int64)
        first, each = np.arange(trees) * inner, np.arange(len(rows))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            at = first + node
            node = 2 * node + 1 + (rows[each, feature[at]] > threshold[at])
        total = self.base + leaf[np.arange(trees) * (inner + 1) + node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.12, least: float = 4.0, ridge: float = 1.0) -> Forest:
    """Logistic gradient boosting; splits are searched over histograms of at most ``bins`` quantile bins."""
    inner = 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if len(rows) == 0 or labels.min() == labels.max():
        p = labels.mean() if len(labels) else 0.5
        return Forest(feature, threshold, leaf, float(np.clip(np.log(max(p, 1e-9) / max(1 - p, 1e-9)), -30, 30)))
    edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(e, rows[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    columns, p = rows.shape[1], labels.mean()
    base = float(np.log(p / (1 - p)))
    total, offset = np.full(len(rows), base), np.arange(columns) * bins
    for t in range(trees):
        prob = 1 / (1 + np.exp(-total))
        slope, bend = labels - prob, prob * (1 - prob)
        node = np.zeros(len(rows), np.int64)  # within its level
        for level in range(depth):
            width = 2**level
            at = (node[:, None] * columns * bins + offset + binned).ravel()
            g, h = (np.bincount(at, np.repeat(x, columns), width * columns * bins).reshape(width, columns, bins) for x in (slope, bend))
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            for j, e in enumerate(edges):  # a bin without an edge above it
                gain[:, j, len(e) :] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            j, b = best // bins, best % bins
            split = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            slots = width - 1 + np.arange(width)
            feature[t, slots] = np.where(split, j, 0)
            threshold[t, slots] = [edges[x][y] if ok else np.inf for x, y, ok in zip(j, b, split, strict=True)]
            node = 2 * node + (rows[np.arange(len(rows)), feature[t, slots[node]]] > threshold[t, slots[node]])
        g, h = np.bincount(node, slope, inner + 1), np.bincount(node, bend, inner + 1)
        leaf[t] = rate * g / (h + ridge)
        total += leaf[t][node]
    return Forest(feature, threshold, leaf, base)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _measured(batch: pd.DataFrame) -> np.ndarray:
    return np.array([statistics(t) for t in batch["text"]], np.float64).reshape(len(batch), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, **how) -> Forest:
    """Fits on labelled rows that aren't held out, ``most`` of them at most."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("label")).where("label <> 0.5")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sample = known.select("doc_id", F.round("label").cast("int").alias("label")).orderBy(order).limit(most)
    held = docs.select("doc_id", "text", F.xxhash64("text").alias("content")).join(F.broadcast(sample), "doc_id")  # bounded by ``most``
    # one text for each id, whatever the order of the rows; combined before the shuffle
    chosen = cut(held.groupBy("doc_id").agg(F.min("content").alias("content")))
    texts = held.join(F.broadcast(chosen), ["doc_id", "content"])  # bounded by ``most``

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "stats": list(_measured(batch))})

    measured = texts.select("doc_id", "text", "label").mapInPandas(run, "doc_id long, label int, stats array<double>")
    # rows that repeat have equal statistics
    seen = measured.groupBy("doc_id").agg(F.first("label").alias("label"), F.first("stats").alias("stats")).toPandas().sort_values("doc_id")
    rows = np.array(list(seen["stats"]), np.float64).reshape(len(seen), len(FEATURES))
    return fit(rows, seen["label"].to_numpy(np.float64), **how)


def scored(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["score"] = forest.score(_measured(batch))
            yield batch[["doc_id", "held_out", "score"]]

    made = id_back(docs.select(id_text(), "text", held_out(F.col("doc_id")).alias("held_out")).mapInPandas(run, "doc_id string, held_out boolean, score double"))
    return made.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, forest: Forest, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more; no shuffle."""

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            yield pd.Series(forest.score(_measured(pd.DataFrame({"text": text}))))

    score.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}  # names, not strings
    return docs.where(F.pandas_udf(score, "double")("text") >= F.lit(least))
