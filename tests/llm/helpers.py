"""Small tables for the operators' tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; documents may have them as well.
CLASHING = ("size", "key", "fp", "blob", "component", "component_id", "ordinal", "h", "__at", "content", "group", "place", "score", "label", "word", "rank", "weight", "block", "shard", "version", "found", "target", "__nth", "held_out", "term", "band", "piece", "n", "u", "v")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "ly", "ed", "ing", "s"]) for _ in range(n))


def edge_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows and ids, other alphabets, a very long text."""
    long = prose(30_000, 1)
    return [
        (1, "one two three four five six seven", "en", "a", 33),
        (2, "one two three four five six seven", "en", "a", 33),
        (2, "one two three four five six seven", "en", "a", 33),
        (3, None, "en", "b", None),
        (4, "", None, None, 0),
        (5, " \n\t ", "en", None, 4),
        (None, "no id here at all, only words in a row", "en", "c", 38),
        (None, None, None, None, None),
        (6, long, "en", "a", len(long)),
        (7, long + " tail", "en", "é", len(long) + 5),
        (8, "日本語 のテキスト émigré 😀 <|endoftext|> x", "ja", "日", 36),
        (9, "x", "en", "b", 1),
        (9, "another text under the same id", "en", "b", 30),
    ]


def documents(spark, rows=None, clashing=False):
    df = spark.createDataFrame(edge_rows() if rows is None else rows, SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    return df


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
