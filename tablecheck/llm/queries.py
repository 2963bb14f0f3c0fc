"""The registered queries of the operators and their SQL twins, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.llm import bpe, merkle, mixing, near_duplicates, nearest, periodic_runs, pii, quality_model, quality_rules, repeated_passages, sharding, toxicity, tree_bpe
from tablecheck.llm.common import bind, load, words_of


def rank_file() -> tuple[str, str]:
    """The public rank file of the BPE query and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(load(spark, sf_dir, "documents"), *rank_file()))


def op2_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages.remove_repeats(load(spark, sf_dir, "documents"), length=50)


def op3_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(load(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_histogram_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(load(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_bottom_k_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(load(spark, sf_dir, "documents"), shingle=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(load(spark, sf_dir, "documents"))


def op10_disguised_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_personal_data(load(spark, sf_dir, "documents")))


def op11_slot_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows is checked with a tampered text; rows without a doc_id are checked as they are."""
    docs = load(spark, sf_dir, "documents")
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf(*[folded if c == "text" else F.col(c) for c in merkle.FIELDS]))
    found = merkle.manifest(docs.withColumn("tampered", tampered), carried=("tampered",))
    back = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root")
    rows = found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), back)
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tree_bpe.digests(tree_bpe.round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def planted_period(text: Column, doc_id: Column) -> Column:
    """The text, which for one document in ten goes on from some word with a period; texts without words and rows without a doc_id stay."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / F.lit(10))

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")

        def from_place(a: Column) -> Column:
            def with_period(p: Column) -> Column:
                return F.concat_ws(" ", F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))))

            return bind(F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)), with_period)

        return F.when(n > 0, bind(g % F.greatest(n, F.lit(1)), from_place)).otherwise(text)

    return F.when(h % 10 == 0, bind(words_of(text), repeated)).otherwise(text)


def op13_diagonal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", planted_period(F.col("text"), F.col("doc_id")).alias("text"))
    return run_digests(periodic_runs.find_runs(docs))


def run_digests(found: DataFrame) -> DataFrame:
    """The number of runs, the one with the greatest exponent (ties: smallest start, then period), and digests of all runs and of the text left."""

    def better(best: Column, run: Column) -> Column:
        # Runs come by start, then period; a later one must be greater. Lengths and periods are below 2^31, so the products are exact.
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    kind = found.schema["runs"].dataType.elementType
    best = found.withColumn("best", F.aggregate("runs", F.lit(None).cast(kind), better))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {q.__name__: q for q in (pipeline, op1_byte_bpe, op2_radix_repeats, op3_recurrent_toxicity, op4_stratified_shards, op5_cross_polytope, op6_histogram_rules, op7_bottom_k_near_duplicates, op8_site_quality, op9_flow_mix, op10_disguised_pii, op11_slot_merkle, op12_tree_bpe, op13_diagonal_runs)}

# Checksums come from a table of 256 entries, made by the polynomial's rule; the hash is that of common.seeded_hash.
_OP4 = """
WITH crc_table AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
  FROM range(256) t(i)
), measured AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS stratum, coalesce(text, '') AS body,
         CAST('0x' || substr(md5('shard:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS drawn
  FROM documents
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY drawn, doc_id, md5(body)) - 1
             + CAST('0x' || substr(md5('shard:' || stratum), 1, 15) AS BIGINT) / 1152921504606846976.0)
            / count(*) OVER (PARTITION BY stratum) AS fraction
  FROM measured
), placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, source NULLS LAST, drawn, doc_id, md5(body)) - 1 AS position, count(*) OVER () AS n FROM ranked
)
SELECT doc_id, CAST(octet_length(encode(body)) + 8 AS BIGINT) AS size,
       xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
                       lambda c, b: xor(c >> 8, steps[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) AS text_crc32,
       'rows' AS law, CAST(position * 24 // n AS INTEGER) AS shard,
       position - (position * 24 // n * n + 23) // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed, crc_table
"""


# Levels by recursion; siblings left and right of each row on each level, first within the tree of its language and then above.
_OP11 = """
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
  FROM range(256) t(i)
), marked AS (
  SELECT doc_id, lang, text,
         {field_doc_id} || {field_source} || {field_lang} || {field_n_chars} AS head,
         xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
                         lambda c, b: xor(c >> 8, steps[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) AS crc
  FROM documents, crc_table
), hashed AS (
  SELECT row_number() OVER () AS r, doc_id, lang, sha256(head || {field_text}) AS leaf,
         CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed, head
  FROM marked
), trees AS (
  SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, n FROM (SELECT lang, count(*) AS n FROM hashed GROUP BY lang)
), placed AS (
  SELECT r, doc_id, leaf, sha256(head || {field_changed}) AS tampered, tree, n,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM hashed h JOIN trees t ON h.lang IS NOT DISTINCT FROM t.lang
), nodes AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 8, n
), subroots AS (
  SELECT tree, digest AS subroot FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, tree AS pos, count(*) OVER () AS n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level, pos // 8, n
), siblings AS (
  SELECT p.r, x.level, coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos < p.pos // power), '') AS l,
         coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos > p.pos // power), '') AS g
  FROM placed p JOIN (SELECT *, CAST(8 ** level AS BIGINT) AS power FROM nodes WHERE n > 1) x ON x.tree = p.tree AND x.pos // 8 = p.pos // power // 8
  GROUP BY p.r, x.level
  UNION ALL
  SELECT p.r, 1000 + x.level, coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos < p.tree // power), ''),
         coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos > p.tree // power), '')
  FROM placed p JOIN (SELECT *, CAST(8 ** level AS BIGINT) AS power FROM upper WHERE n > 1) x ON x.pos // 8 = p.tree // power // 8
  GROUP BY p.r, x.level
), steps AS (
  SELECT r, row_number() OVER (PARTITION BY r ORDER BY level) AS step, l, g FROM siblings
), folded AS (
  SELECT r, 0 AS step, tampered AS digest FROM placed
  UNION ALL
  SELECT f.r, f.step + 1, sha256(s.l || f.digest || s.g) FROM folded f JOIN steps s ON s.r = f.r AND s.step = f.step + 1
), ended AS (
  SELECT r, arg_max(digest, step) AS folded_root FROM folded GROUP BY r
), proofs AS (
  SELECT r, string_agg(l || g, '' ORDER BY step) AS path FROM steps GROUP BY r
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(path, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots USING (tree) JOIN ended USING (r) LEFT JOIN proofs USING (r), (SELECT digest AS root FROM upper WHERE n = 1)
""".format(**{f"field_{c}": f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", "text", "changed")})


def _histogram_rules_sql() -> str:
    """The rules with windows as text instead of hashes, and one row for each component of a histogram."""
    q = quality_rules
    known = [w for words in q.COMMON_WORDS.values() for w in words]
    listed = ", ".join(f"'{w}'" for w in known)
    classes = ", ".join(f"length(regexp_replace(body, '{_all_but(p)}', '', 'g'))" for p in q.CLASSES.values())
    languages = ", ".join(f"'{x}'" for x in q.COMMON_WORDS)
    js = "sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {a} + {b})) / 2, 0))"
    part = "CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"

    def distance(p: str, r: str) -> str:
        x, y = f"{p}[i]", f"{r}[i]"
        return js.format(p=p, a=part.format(x=x, y=y), b=part.format(x=y, y=x))

    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS body, CASE WHEN lang IN ({languages}) THEN lang ELSE 'other' END AS language FROM documents
), split AS (
  SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines, [{classes}] AS classes FROM texts
), win AS (
  SELECT d, i, array_to_string(words[i:i + 4], ' ') AS key FROM split, unnest(range(1, greatest(len(words) - 3, 1))) t(i)
), again AS (
  SELECT d, i FROM win QUALIFY count(*) OVER (PARTITION BY d, key) > 1
), covered AS (
  SELECT d, count(DISTINCT i + k) AS n FROM again, range(5) t(k) GROUP BY d
), counted AS (
  SELECT d, doc_id, language, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, classes[3] AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, length(body) AS chars, classes, list_transform([{listed}], lambda w: len(list_filter(words, lambda x: x = w))) AS common
  FROM split LEFT JOIN covered USING (d)
), shares AS (
  SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEATED_PERCENT} * n_words AS base_failed,
         list_transform(list_concat(classes, [chars - word_chars, word_chars - list_sum(classes)]), lambda c: c / greatest(chars, 1)) AS class_shares,
         list_transform(list_concat(common, [n_words - list_sum(common)]), lambda c: c / greatest(n_words, 1)) AS word_shares
  FROM counted
), class_means AS (
  SELECT language, list(m ORDER BY i) AS ref FROM (
    SELECT language, i, coalesce(avg(class_shares[i]) FILTER (chars >= {q.GUARD_CHARS}), 0) AS m FROM shares, range(1, {len(q.CLASSES) + 3}) t(i) WHERE NOT base_failed GROUP BY ALL) GROUP BY 1
), word_means AS (
  SELECT language, list(m ORDER BY i) AS ref FROM (
    SELECT language, i, coalesce(avg(word_shares[i]) FILTER (n_words >= {q.GUARD_WORDS}), 0) AS m FROM shares, range(1, {len(known) + 2}) t(i) WHERE NOT base_failed GROUP BY ALL) GROUP BY 1
), judged AS (
  SELECT s.*, CASE WHEN chars >= {q.GUARD_CHARS} THEN {distance("class_shares", "c.ref")} END AS far_class, CASE WHEN n_words >= {q.GUARD_WORDS} THEN {distance("word_shares", "w.ref")} END AS far_words
  FROM shares s LEFT JOIN class_means c USING (language) LEFT JOIN word_means w USING (language)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(far_class > {q.MAX_CLASS_DISTANCE}, false) AND NOT coalesce(far_words > {q.MAX_WORD_DISTANCE}, false) AS kept
FROM judged
"""


def _all_but(characters: str) -> str:
    """A class of characters turned into all others, quoted for SQL."""
    inner = characters[1:-1].removeprefix("^")
    return (f"[{inner}]" if characters[1] == "^" else f"[^{inner}]").replace("'", "''")


ORACLES = {"op4_stratified_shards": _OP4, "op6_histogram_rules": _histogram_rules_sql(), "op11_slot_merkle": _OP11}
