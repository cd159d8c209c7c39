"""URL filters: path rules first, then word segmentation and naive Bayes for the urls without a rule.

A host's and a path's runs of letters, often words written together, are split by a unigram Viterbi
over the word counts of the pages' own text. Counts are not gathered anywhere: each distinct run is
joined by its substrings to the words it may hold, so a task needs the few counts of one run at a
time. Only lengths that some word has are tried, and none is too long: an unknown word may be as long
as its run. Long runs are cut into parts, which overlap by the longest word less a letter; their substrings carry
the run's digest, 128 bits, and not the run. The words of host and path, and a token for each number's count of digits, are the tokens
of a multinomial naive Bayes, fitted on the urls that rules judge.

Distinct hosts and paths, and not pages, are split and scored, and counts per host or path and class
come before any token, so a host that a third of the pages have is one row in these joins.

Edge cases: a null url, or one without ``://``, has an empty host and path and no rule. With no rule
of one kind anywhere, the shares of blocked and allowed are even; ties and urls without any token go
to allow if blocking isn't the likelier class. Repeated rows get the same verdict each; null ids
stay. Letters of every alphabet count, with the marks that go with them; a run in an alphabet that no
page's text has is one unknown word. An empty table gives an empty result. Only page_id, url and
html are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

_NO_LETTERS = r"[^\p{L}\p{M}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules are one expression; more are joined.
INLINE_RULES = 64
_PART = 256  # letters of a run at which the words of a part start


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str  # host and path, like example.com/en/

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), r"\A([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))


def judged(urls: DataFrame, rules: list[Rule], inline: int = INLINE_RULES) -> DataFrame:
    """``urls`` (host, path, ...) with rule and verdict of the longest rule that fits, else null."""
    if len(rules) <= inline:
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # a later, longer one overrules
            fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
            rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
        return urls.withColumns({"rule": rule, "verdict": verdict})
    table = urls.sparkSession.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in rules], "rule_host string, rule_path string, rule string, verdict string")
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = urls.select("host", "path").distinct().withColumn("rule_host", F.explode(suffix))
    fit = each.join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = fit.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "verdict")).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): words of all texts, which are runs of letters, markup left out, lower case. ``texts`` has ``text``."""
    plain = F.lower(F.regexp_replace("text", "<[^>]*>", " "))
    words = texts.select(F.explode_outer(F.split(plain, _NO_LETTERS)).alias("word"))
    return words.where(F.col("word") != "").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def viterbi(piece: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest split into words; an unknown word of n letters has probability 10 / (total * 10 ** n).

    The best unknown word up to each place begins where score plus log 10 times the place is largest,
    so only known words are tried one by one.
    """
    score, back = [0.0] + [-math.inf] * len(piece), [0] * (len(piece) + 1)
    ten, log_total = math.log(10), math.log(max(total, 1))
    sizes = sorted({len(w) for w in counts}, reverse=True)
    begin, best = 0, 0.0
    for end in range(1, len(piece) + 1):
        score[end], back[end] = best + ten * (1 - end) - log_total, begin
        for size in sizes:
            if size <= end and (n := counts.get(piece[end - size : end])):
                p = score[end - size] + math.log(n) - log_total
                if p > score[end]:
                    score[end], back[end] = p, end - size
        if score[end] + ten * end > best:
            begin, best = end, score[end] + ten * end
    words, end = [], len(piece)
    while end:
        words.append(piece[back[end] : end])
        end = back[end]
    return words[::-1]


def segmented(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """(piece, words) for the distinct ``piece``; ``counts`` has word and n."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    longest = pieces.agg(F.coalesce(F.max(F.length("piece")), F.lit(0))).first()[0]
    size = F.length("word")
    # lengths of words that fit into some piece: no more than the longest piece has letters
    sizes = sorted(r[0] for r in counts.where(size <= longest).select(size).distinct().collect())
    # a piece goes by its digest: its substrings would each carry all of it
    held = pieces.select(F.unhex(F.md5(F.col("piece").cast("binary"))).alias("id"), "piece")
    pieces_known = held.select("piece", F.lit(None).cast("array<struct<word: string, n: bigint>>").alias("known"))
    if sizes:
        # a part has _PART letters at which words start, and as many more as a word from the last of them can reach
        nth = F.explode(F.sequence(F.lit(0), F.floor((F.length("piece") - 1) / _PART).cast("int")))
        parts = held.where(F.length("piece") > 0).select("id", "piece", nth.alias("nth"))
        parts = parts.select("id", F.col("piece").substr(F.col("nth") * _PART + 1, F.lit(_PART + sizes[-1] - 1)).alias("part"))
        start = parts.select("id", "part", F.explode(F.sequence(F.lit(1), F.least(F.lit(_PART), F.length("part")))).alias("start"))
        fitting = F.filter(F.array(*map(F.lit, sizes)), lambda s: s <= F.length("part") - F.col("start") + 1)
        inside = start.select("id", "part", "start", F.explode(fitting).alias("size"))
        words = inside.select("id", F.col("part").substr(F.col("start"), F.col("size")).alias("word")).distinct()
        known = words.join(counts, "word").groupBy("id").agg(F.collect_list(F.struct("word", "n")).alias("known"))  # substrings of one piece
        pieces_known = held.join(known, "id", "left").select("piece", "known")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            split = [viterbi(p, {k["word"]: k["n"] for k in (known if known is not None else ())}, total) for p, known in zip(batch["piece"], batch["known"], strict=True)]
            yield pd.DataFrame({"piece": batch["piece"], "words": split})

    return pieces_known.mapInPandas(run, "piece string, words array<string>")


def tokens_of(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """(part, token): the words of every distinct ``part``, a host or a path, and # with the count of digits for a number."""
    lower = F.lower("part")
    pieces = parts.select("part", F.explode(F.split(lower, _NO_LETTERS)).alias("piece")).where("piece <> ''")
    words = segmented(pieces.select("piece").distinct(), counts)
    numbers = parts.select("part", F.explode(F.split(lower, r"\P{Nd}+")).alias("number")).where("number <> ''")
    return pieces.join(words, "piece").select("part", F.explode("words").alias("token")).unionByName(numbers.select("part", F.concat(F.lit("#"), F.length("number").cast("string")).alias("token")))


def weights(tokens: DataFrame, shares: tuple[int, int]) -> tuple[DataFrame, float, float]:
    """(token, weight), the prior and the weight of a token never seen, from (token, block, allow) counts.

    A weight is the log of the token's share among blocked tokens over that among allowed ones, one
    added to every count; one more token stands for all unseen ones.
    """
    size = tokens.agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum("block"), F.lit(0)).alias("block"), F.coalesce(F.sum("allow"), F.lit(0)).alias("allow")).first()
    prior = math.log(shares[0] / shares[1]) if all(shares) else 0.0
    unseen = math.log((size.allow + size.words + 1) / (size.block + size.words + 1))
    return tokens.select("token", (F.log((F.col("block") + 1) / (F.col("allow") + 1)) + unseen).alias("weight")), prior, unseen


def classified(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """``urls`` (host, path, verdict, ...) with block_odds, the log-odds of block by naive Bayes; null where a verdict was given.

    ``urls`` is read several times: hand in a written table.
    """
    both = [F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in ("block", "allow")]
    # distinct hosts and paths, with their judged pages
    parts = cut(urls.groupBy(F.col("host").alias("part")).agg(*both).unionByName(urls.groupBy(F.col("path").alias("part")).agg(*both)))
    found = cut(tokens_of(parts.select("part").distinct(), counts).groupBy("part", "token").agg(F.count(F.lit(1)).alias("times")))
    tokens = found.join(parts, "part").groupBy("token").agg(*(F.sum(F.col("times") * F.col(v)).alias(v) for v in ("block", "allow"))).where("block + allow > 0")
    share = urls.agg(*both).first()
    weighed, prior, unseen = weights(cut(tokens), (share.block, share.allow))
    odds = found.join(weighed, "token", "left").groupBy("part").agg(F.sum(F.col("times") * F.coalesce("weight", F.lit(unseen))).alias("odds"))
    odds = cut(odds)
    total = F.lit(prior) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0))
    scored = urls.join(odds.toDF("host", "host_odds"), "host", "left").join(odds.toDF("path", "path_odds"), "path", "left")
    return scored.select(*urls.columns, F.when(F.col("verdict").isNull(), F.round(total, 9)).alias("block_odds"))


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, block_odds of every page."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = cut(judged(urls, rules))
    counts = cut(word_counts(pages.select(F.col("html").alias("text"))))
    found = classified(urls, counts)
    return found.withColumn("verdict", F.coalesce("verdict", F.when(F.col("block_odds") > 0, "block").otherwise("allow")))
