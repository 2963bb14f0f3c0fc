"""Small document tables with every odd case: nulls, blanks, long runs, ties, copies, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "size long, words long, score double, ids string, label string, node long, value string, part int, kept string, bucket int"


def odd_rows():
    rng = random.Random(3)
    words = "the of and house water river stone light garden people never again".split()
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 90))) + "." for _ in range(12)]
    texts = [None, "", "  \n\t ", "one", "one two", "\x1cx\x85y z", "héllo wörld 中文 😀 naïve", "a" * 30_000, "x " * 9_000, " " * 20_000 + "end"]
    texts += prose + prose[:3] + [prose[0] + " stone"] + ["same line\n" * 40, "| a | b |\n" * 30]
    rows = [(k, t, ("en", "de", None, "xx")[k % 4], (None, "s1", "s2", "")[k % 4], None if t is None else len(t)) for k, t in enumerate(texts)]
    return [*rows, rows[12], rows[12]]  # repeated rows


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def clashing(docs):
    """The documents with further columns whose names operators might use for themselves."""
    from pyspark.sql import functions as F

    for item in CLASHES.split(", "):
        name, kind = item.split(" ")
        docs = docs.withColumn(name, F.lit(None).cast(kind))
    return docs


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))
