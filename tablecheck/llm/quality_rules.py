"""Quality rules in column expressions: repetition counts, and how far a document's histograms lie from those of its language.

Base rules count words, symbols, repeated lines and words in repeated five-word windows. The divergence rule makes two histograms of each
document, one over character classes and one over common words of four languages, and measures the Jensen-Shannon distance of each to
the reference of the document's language. A reference is the mean histogram over all documents of the language that pass the base
rules and the length guards, so long documents weigh no more than short ones. A document that is too short for a histogram to mean
anything is not judged by it.

One pass over the texts makes one narrow row for each document; these rows are checkpointed, so the references and the verdicts read
the texts only once. There is one reference for each known language and one for all others: a handful of rows, whatever the data.

Windows are compared by a 64-bit hash of their five words. Two unequal windows of one document share a hash about once in 10^13
documents of a thousand words.

Results: null texts have no words and fail; a null or unknown language uses the reference of all such documents; where no document
makes a reference, the divergence is null and nothing is rejected by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.llm.common import bind, checkpointed, words_of

# Very common words of the languages that have a reference of their own.
COMMON_WORDS = {
    "en": "the of and to in a is that for with was are".split(),
    "de": "der die und das von mit den ist im auf nicht eine".split(),
    "fr": "le la les et des du une dans que est pour qui".split(),
    "es": "el los las y del por con no se su como más".split(),
}
WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
# Character classes that are counted; blanks are what is in no word, plain letters are the rest.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "symbol": SYMBOLS, "mark": r"[!\"'(),\-./:;?@\[\\\]^_`{}~+=]", "beyond_ascii": r"[^\x00-\x7F]"}

MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: Length guards: below these a histogram is not judged.
GUARD_CHARS = 400
GUARD_WORDS = 100
#: Largest Jensen-Shannon distances to the language's reference.
MAX_CLASS_DISTANCE = 0.22
MAX_WORD_DISTANCE = 0.25


def measure(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, language, counts, two histograms): one row for each document."""
    known = [w for words in COMMON_WORDS.values() for w in words]
    text = F.coalesce(F.col("text"), F.lit(""))
    by_word = bind(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
            bind(F.filter(w, lambda x: x.isin(known)), lambda f: F.array(*[F.size(f) - F.size(F.array_remove(f, x)) for x in known])).alias("common"),
        ),
    )
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    classes = F.array(F.char_length(text), *[F.regexp_count(text, F.lit(p)) for p in CLASSES.values()])
    language = F.when(F.col("lang").isin(list(COMMON_WORDS)), F.col("lang")).otherwise(F.lit("other"))
    rows = docs.select(
        "doc_id",
        *carry,
        language.alias("language"),
        by_word.alias("by_word"),
        classes.alias("classes"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    symbol = 1 + list(CLASSES).index("symbol")
    counts = rows.select(
        "doc_id", *carry, "language", "by_word.*", "n_dup_lines", F.col("classes")[symbol].cast("long").alias("n_symbols"), F.col("classes")[0].alias("chars"), "classes"
    )
    blanks = F.col("chars") - F.col("word_chars")
    counted = F.slice("classes", 2, len(CLASSES))
    plain = F.col("word_chars") - F.aggregate(counted, F.lit(0), lambda a, x: a + x)
    common = F.aggregate("common", F.lit(0), lambda a, x: a + x)
    return counts.select(
        "doc_id", *carry, "language", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars",
        _shares(F.concat(counted.cast("array<long>"), F.array(blanks, plain)), F.col("chars")).alias("class_shares"),
        _shares(F.concat(F.col("common").cast("array<long>"), F.array(F.col("n_words") - common)), F.col("n_words")).alias("word_shares"),
    )


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: c / F.greatest(total, F.lit(1)))


def _repeated_words(words: Column) -> Column:
    """Words in five-word windows that the text has twice or more, the first included."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = bind(placed, lambda s: F.filter(s, lambda x, j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == x["h"])) | ((j < F.size(s) - 1) & (s[F.least(j + 1, F.size(s) - 1)]["h"] == x["h"]))))
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        # Each window adds the words up to the next repeated window, five at most.
        added = bind(starts, lambda p: F.transform(p, lambda x, j: F.when(j < F.size(p) - 1, F.least(p[F.least(j + 1, F.size(p) - 1)] - x, F.lit(WINDOW))).otherwise(WINDOW)))
        return F.aggregate(added, F.lit(0), lambda a, x: a + x)

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[words[i + k] for k in range(WINDOW)]))
    found = bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(found)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms of shares."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    total = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def judge(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, counts, base_failed, class_distance, word_distance, kept) of every document."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    rows = checkpointed(measure(docs, carry).withColumn("base_failed", failed))
    long_enough = {"class_shares": F.col("chars") >= GUARD_CHARS, "word_shares": F.col("n_words") >= GUARD_WORDS}
    sizes = {"class_shares": len(CLASSES) + 2, "word_shares": 1 + sum(map(len, COMMON_WORDS.values()))}
    references = rows.filter(~F.col("base_failed")).groupBy("language").agg(
        *[F.array(*[F.coalesce(F.avg(F.when(guard, F.col(c)[i])), F.lit(0.0)) for i in range(sizes[c])]).alias(f"reference_{c}") for c, guard in long_enough.items()]
    )
    judged = rows.join(F.broadcast(references), "language", "left")
    for short, column, guard in (("class", "class_shares", GUARD_CHARS), ("word", "word_shares", GUARD_WORDS)):
        judged = judged.withColumn(f"{short}_distance", F.when(long_enough[column], distance(F.col(column), F.col(f"reference_{column}"))))
    far = F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE, F.lit(False)) | F.coalesce(F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False))
    return judged.select(
        "doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance",
        (~F.col("base_failed") & ~far).alias("kept"),
    )
