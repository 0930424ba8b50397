"""From raw documents to packed training sequences.

Five stages, each a function of (spark, docs, sf_dir) over all that the one before it kept. A
stage's result is written as Parquet and read again, so a lost executor repeats one stage at
most. All but the last stage return the columns they were given. Rows are told
apart by all their columns, so ids may be missing or repeated.
"""

from pyspark.sql import functions as F

from chatterlake.llm import decontaminate, language_id, ngram_join, packing, suffix_dedup
from chatterlake.sources.storage import write_table

NEAR_WORDS, NEAR_PERCENT, NEAR_LOW = 5, 80, 0.3
# Passages of just over 50 words repeat; 51 short words have more bytes than this.
PASSAGE_BYTES, PASSAGE_PERIOD = 200, 31


def _named(name):
    return F.col("`" + name.replace("`", "``") + "`")


def language(spark, docs, sf_dir):
    """Drop documents without a language: no text, no letter, or no language clearly ahead (share under one half).

    The model learns from the documents' own labels; a missing label is filled with the prediction.
    """
    model = language_id.fit(docs)
    rows = docs.select(F.struct(*[_named(c) for c in docs.columns]).alias("row"), F.col("text"))
    found = language_id.predict_language(rows, model, id_col="row")
    kept = found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= 0.5))
    row = F.col("row")
    return kept.select(*[F.coalesce(row[c], F.col("lang_pred")).alias(c) if c == "lang" else row[c].alias(c) for c in docs.columns])


def near_duplicates(spark, docs, sf_dir):
    """Keep one document, the smallest id, of each group of near copies; of repeated rows one as well.

    A row goes along whole, as one value, so its columns may have any names and types.
    """
    row = F.struct(*[_named(c) for c in docs.columns])
    # Rows are told apart by their id and a hash of them as JSON, which takes maps as well.
    keyed = docs.select(row.alias("row"), F.col("text").alias("text"), F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64(F.to_json(row)).alias("h")).alias("id"))
    groups = ngram_join.ngram_components(keyed, "id", "text", NEAR_WORDS, NEAR_PERCENT, NEAR_LOW)
    first = groups.filter(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("kept")).distinct()
    kept = keyed.select("row", "id").join(first, F.col("id").eqNullSafe(F.col("kept")), "left_semi").dropDuplicates(["id"])
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def repeated_passages(spark, docs, sf_dir):
    """Cut every passage of `PASSAGE_BYTES` that stands elsewhere; documents of which nothing is left go."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[_named(c) for c in others]).alias("row"), F.col("text"))
    cut = suffix_dedup.remove_repeats(rows, id_col="row", length=PASSAGE_BYTES, period=PASSAGE_PERIOD)
    cut = cut.filter((F.col("n_removed") == 0) | (F.trim("kept") != ""))
    row, changed = F.col("row"), F.col("n_removed") > 0
    columns = {"text": F.col("kept"), **{c: row[c] for c in others}}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(row["n_chars"])
    return cut.select(*[columns[c].alias(c) for c in docs.columns])


def benchmark_leaks(spark, docs, sf_dir):
    """Drop documents that hold a test item of `benchmark`."""
    return decontaminate.without_contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark, docs, sf_dir):
    """Place all that is left into sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("packing", pack),
]

# No SQL: context trees, suffix order and tokenizers are beyond it; see the tests.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
