"""A training corpus from documents: quality rules, toxicity, near-duplicates, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and read again as
the next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coordframe.llm import jaccard, mixing, packing, repetition, toxicity
from coordframe.llm.common import Workspace
from coordframe.llm.queries import MIX_PATH, MIX_WEIGHTS, TOXIC_AT, domain, tokenizer_path

#: The mix keeps this share of the tokens that reach it, so that no clean leaf but the largest shrinks.
KEEP_TOKENS = 0.9
MAX_BROADCAST_IDS = 1_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep.

    Null, empty and blank texts have no words and go.  Each row is judged by its text alone, so ids, ties and repeated rows
    decide nothing; no rows give no rows, and no column is added or replaced, whatever its name.
    """
    return docs.where(repetition.repetition(F.col("text")).getField("kept"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; trained on the labelled documents of the corpus.

    Null and empty texts hold no word and stay.  Each row is judged by its text alone, so ids, ties and repeated rows
    decide nothing; no rows give no rows, and no column is added or replaced.  Without labels of both classes, all stay.
    """
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = toxicity.scorer(model)(F.col("text"))
    return docs.where(score < TOXIC_AT)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that with the smallest id; null ids come last.

    Rows are told apart by a key of their own, written once, so repeated and null ids decide nothing:
    unlike texts under one id all stay.  Rows without words link with nothing and stay.  No rows give no rows;
    other columns stay as they are, whatever their names.
    """
    ws = Workspace(spark, "groups")
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row"))
    keyed = ws.table("rows", keyed)
    found = jaccard.jaccard_components(spark, keyed.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")))
    found = found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    shared = found.where(F.col("group") != F.col("row")).select("group").distinct()  # groups of several rows
    found = found.join(shared, "group", "left_semi")
    order = F.struct(F.col("doc.doc_id").isNull().alias("null"), F.col("doc.doc_id").alias("id"), F.xxhash64("doc").alias("hash"), F.col("row").alias("row"))  # ties of ids go by content
    first = found.join(keyed.select("row", order.alias("o")), "row").groupBy("group").agg(F.min("o").getField("row").alias("row"))
    gone = ws.table("gone", found.select("row").join(first.select("row"), "row", "left_anti"))
    few = gone.count() <= MAX_BROADCAST_IDS  # keys only: at most some 16 MB; beyond it, both sides are shuffled
    return keyed.join(F.broadcast(gone) if few else gone, "row", "left_anti").select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their leaf's budget of the domain, language and source tree, in one epoch.

    Null languages and sources are groups of their own; rows of one id (null is one) are taken together or not at all, and
    rows without words go with their hash.  No rows give no rows; other columns stay as they are, an ``epoch`` too.
    """
    whole = docs.select(F.struct(*docs.columns).alias("doc"), *[F.col(c) for c in ("doc_id", "text", "lang", "source")])
    out = mixing.mix(spark, whole, MIX_PATH, KEEP_TOKENS, MIX_WEIGHTS, max_epochs=1, groups={"domain": domain()})
    return out.select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the remaining documents, its place and checksum.

    Null and empty texts are one token, the separator.  Null and repeated ids are packed as any others; no rows give no rows; other columns are not
    looked at.
    """
    return packing.pack(spark, docs, tokenizer_path(), keep_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", drop_toxic),
    ("near-duplicates", one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.table(str(k), stage(spark, docs, sf_dir))
        if k:
            ws.drop(str(k - 1))
    return docs


#: Toxicity is a trained model, so SQL cannot give run()'s rows; tests hold stages against brute force.
ORACLE_SQL = None
