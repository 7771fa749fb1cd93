"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, jaccard, language, mixing, packing, pq, quality_fm, repetition, sharding, toxicity
from .common import fold

SHARDS, TOXIC_AT, QUALITY_AT = 40, 0.5, 0.3
TOKENIZER = "word_bpe_49k.json"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; labels of fold 0 of 5 are never learned from."""
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    out = toxicity.with_toxicity(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; fold 2 of 4 is never learned from."""
    docs = _read(spark, sf_dir, "documents")
    out = language.with_language(docs.select("doc_id", "text"), language.fit(docs))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "language.lang_pred", "language.score")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and component."""
    return jaccard.jaccard_components(spark, _read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, and its place."""
    pieces = packing.pack(spark, _read(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot; shard counts differ by one at most."""
    out = sharding.shard_rows(spark, _read(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = html_extract.with_main_text(pages)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's repetition statistics and verdict."""
    out = repetition.with_repetition(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select("doc_id", *[f"repetition.{c}" for c in names])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; labels of fold 0 of 5 are never learned from."""
    docs = _read(spark, sf_dir, "documents")
    model = quality_fm.fit(docs, _read(spark, sf_dir, "labels"))
    out = quality_fm.with_quality(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_AT).cast("int").alias("predicted"))


#: The mix: the share of all tokens that is kept, and weights of nodes; every other sibling weighs 1.
MIX_FRACTION = 0.5
MIX_PATH = ("domain", "lang", "source")
MIX_WEIGHTS = {("domain0",): 2.0, ("domain1", "en"): 3.0}


def domain() -> Column:
    """The tables have no domain, so sources are dealt to four by checksum."""
    return F.concat(F.lit("domain"), F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % 4)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that the mix takes, once for each epoch."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", domain().alias("domain"), "lang", "source", "text")
    out = mixing.mix(spark, docs, MIX_PATH, MIX_FRACTION, MIX_WEIGHTS, max_epochs=2)
    return out.select("doc_id", "domain", "lang", "source", mixing.n_tokens(F.col("text")).alias("n_tokens"), "epoch")


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component."""
    return pq.near_duplicates(spark, _read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_language": op2_language,
        "op3_jaccard": op3_jaccard,
        "op4_packing": op4_packing,
        "op5_sharding": op5_sharding,
        "op6_html": op6_html,
        "op7_repetition": op7_repetition,
        "op8_quality": op8_quality,
        "op9_mixing": op9_mixing,
        "op10_near_vectors": op10_near_vectors,
        "pipeline": pipeline,
    }


_WORD = "[^\\x20\\x09-\\x0D]+"

#: All pairs that share a shingle, and reachability by recursion.
_JACCARD_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) g FROM w),
n AS (SELECT doc_id, len(g) n FROM s),
u AS (SELECT doc_id, unnest(g) x FROM s),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id i, doc_id c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.i)
SELECT n.doc_id doc_id, n.n n_shingles, min(r.c) component_id FROM n JOIN r ON r.i = n.doc_id GROUP BY 1, 2
"""


def _repetition_sql() -> str:
    """Every rule on strings: windows, the words that they cover, and the lines."""
    parts = [f"w AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{_WORD}') ws FROM documents)"]
    parts.append("k AS (SELECT doc_id, unnest(ws) word, unnest(range(1, len(ws) + 1)) pos FROM w)")
    for n in repetition.GRAM_LIMITS:
        span = f"range(1, len(ws) - {n - 2})"
        parts.append(f"g{n} AS (SELECT doc_id, unnest(list_transform({span}, lambda i: array_to_string(ws[i:i+{n - 1}], ' '))) x, unnest({span}) pos FROM w WHERE len(ws) >= {n})")
        parts.append(f"h{n} AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, x) c FROM g{n})")
        parts.append(f"c{n} AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {n})) pos FROM h{n} WHERE c > 1)")
        parts.append(f"r{n} AS (SELECT doc_id, count(*) words, sum(length(word)) chars FROM c{n} JOIN k USING (doc_id, pos) GROUP BY 1)")
    parts.append("ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) line, unnest(range(len(string_split(t, chr(10))))) nr FROM w)")
    parts.append(f"lw AS (SELECT doc_id, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY nr) nth FROM ln WHERE regexp_matches(line, '{_WORD}'))")
    parts.append("ll AS (SELECT doc_id, count(*) lines, count(*) FILTER (nth > 1) dup, coalesce(sum(chars) FILTER (nth > 1), 0) dup_chars FROM lw GROUP BY 1)")
    parts.append("b AS (SELECT doc_id, len(ws) n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols FROM w)")
    joins = " ".join(f"LEFT JOIN r{n} USING (doc_id)" for n in repetition.GRAM_LIMITS)
    grams = " AND ".join(f"coalesce(r{n}.chars, 0) / greatest(word_chars, 1) <= {limit}" for n, limit in repetition.GRAM_LIMITS.items())
    failed = "(n_words < 10 OR 100 * coalesce(r5.words, 0) > 20 * n_words)"
    lines = f"coalesce(dup, 0) / greatest(coalesce(lines, 0), 1) <= {repetition.LINE_LIMIT} AND coalesce(dup_chars, 0) / greatest(word_chars, 1) <= {repetition.LINE_CHAR_LIMIT}"
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, CAST(n_words AS BIGINT) n_words, CAST(word_chars AS BIGINT) word_chars, CAST(n_symbols AS BIGINT) n_symbols, "
        f"CAST(coalesce(dup, 0) AS BIGINT) n_dup_lines, CAST(coalesce(r5.words, 0) AS BIGINT) n_repeat_words, {failed} base_failed, (NOT {failed} AND {lines} AND {grams}) kept "
        f"FROM b LEFT JOIN ll USING (doc_id) {joins}"
    )


#: All pairs of one label, and reachability by recursion.
_VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) x FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
q AS (SELECT *, sqrt(list_dot_product(x, x)) n FROM v),
e AS (SELECT a.vec_id a, b.vec_id b FROM q a JOIN q b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.98),
r AS (SELECT vec_id i, vec_id c FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.i),
m AS (SELECT i, min(c) c FROM r GROUP BY 1),
k AS (SELECT a, count(*) n FROM e GROUP BY 1)
SELECT vec_id, coalesce(k.n, 0) n_links, m.c component_id, vec_id = m.c kept FROM embeddings JOIN m ON m.i = vec_id LEFT JOIN k ON k.a = vec_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the exact operators; the others are trained, seeded by another hash, or search, and tested by brute force."""
    return {"op3_jaccard": _JACCARD_SQL, "op7_repetition": _repetition_sql(), "op10_near_vectors": _VECTORS_SQL}
