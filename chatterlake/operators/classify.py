"""Text classification: fit by counting, score by joining, hook for other models.

A multinomial naive Bayes model is a table with one row per feature (a character
3-gram for languages, a word for sentiment) and one count column per class. Both
fitting and scoring are explode, join and hash aggregation inside the JVM.
"""

from contextlib import contextmanager
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_values import MODEL_BATCH, NEUTRAL_LABEL, NEUTRAL_SCORE, UNKNOWN_LANGUAGE
from ..functions.text import chunks, fill_blank, is_language_text, words
from ..sources.storage import delete_path, write_table

# A model is broadcast only while its estimated size stays below this many bytes.
BROADCAST_LIMIT = 256 * 1024 * 1024
_ROW_OVERHEAD = 96
# Features are listed for so many characters at a time, however long a text is.
CHUNK = 100_000
# Characters whose features a task counts by text, where the model is not broadcast.
LETTERS_PER_TASK = 1_000_000
# Characters whose features a task of that join has.
LETTERS_PER_JOIN_TASK = 4_000_000
# An encoding with four bytes for every character, and the bits that a character needs.
CODE_POINTS = "UTF-32"
POINT_BITS = 21
# Bytes of code points that a task counts 3-grams of at a time.
COUNTED_BYTES = 1 << 22


@dataclass
class Model:
    """A fitted model: the feature table and a few numbers per class."""

    table: DataFrame
    classes: list
    log_priors: list
    log_denominators: list
    rows: int
    features: str
    path: str

    @property
    def estimated_bytes(self):
        return self.rows * (_ROW_OVERHEAD + 16 * len(self.classes))

    def remove(self):
        """Delete the model's files."""
        delete_path(self.table.sparkSession, self.path)


def _overlap(kind):
    return 2 if kind == "char_grams" else 0


def _coded(kind, feature):
    """A feature as the joins and counts compare it: a 3-gram as its code points of four bytes each."""
    return F.encode(feature, CODE_POINTS) if kind == "char_grams" else feature


def _content(kind, chunk):
    """What the features of a chunk are taken from: all its code points, or the list of its words."""
    return _coded(kind, chunk) if kind == "char_grams" else words(chunk, 1)


def _size(kind, content):
    """Number of features in `_content`."""
    if kind == "char_grams":
        return F.greatest((F.octet_length(content) / 4).cast("int") - 2, F.lit(0))
    return F.size(content)


def _exploded(df, kind, *columns, explode=F.explode):
    """`columns` with one `_feature`, as coded, of the column `_content` a row.

    A 3-gram is cut out by its place, which is the same work for every place of the code points; no list
    of all 3-grams is made.
    """
    if kind == "char_grams":
        places = F.when(F.octet_length("_content") >= 12, F.sequence(F.lit(1), F.octet_length("_content") - 11, F.lit(4)))
        found = df.select(*columns, "_content", explode(places).alias("_at"))
        return found.select(*columns, F.substring(F.col("_content"), F.col("_at"), F.lit(12)).alias("_feature"))
    return df.select(*columns, explode("_content").alias("_feature"))


def _in_chunks(df, kind, text, chunk):
    """Texts in chunks whose `_content` together has the features of the whole, beside the columns of `df`."""
    found = df.select("*", F.explode(chunks(text, chunk, _overlap(kind))).alias("_chunk"))
    return found.withColumn("_content", _content(kind, F.col("_chunk"))).drop("_chunk")


@contextmanager
def _batch_bytes(spark, limit):
    """Batches of about `limit` bytes for what is written inside the block."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(limit))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _gram_counts(listed, classes):
    """`_feature`, `_class` and `_n` for the 3-grams of `_content`, counted a batch at a time.

    A missing label has the number after the last class, so its features are rows without a count.
    """
    number, mask = {c: i for i, c in enumerate(classes)}, (1 << POINT_BITS) - 1

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = np.array([number.get(c, len(classes)) for c in batch.column("_label").to_pylist()], np.int64)
            order = np.argsort(labels, kind="stable")
            labels, content = labels[order], batch.column("_content").cast(pa.binary()).take(pa.array(order))
            offsets = np.frombuffer(content.buffers()[1], np.int32)[: len(content) + 1].astype(np.int64) // 4
            points = np.frombuffer(content.buffers()[2], ">u4", offsets[-1]).astype(np.int64)
            rows = np.repeat(np.arange(len(labels)), np.diff(offsets))
            inside = rows[:-2] == rows[2:]
            grams = (points[:-2] << 2 * POINT_BITS | points[1:-1] << POINT_BITS | points[2:])[inside]
            present, first = np.unique(labels, return_index=True)
            edges = np.append(np.searchsorted(rows[:-2][inside], first), len(grams))
            for label, start, end in zip(present.tolist(), edges[:-1], edges[1:]):
                found, n = np.unique(grams[start:end], return_counts=True)
                coded = np.stack([found >> 2 * POINT_BITS, found >> POINT_BITS & mask, found & mask], 1).astype(">u4")
                ends = np.arange(0, 12 * len(found) + 1, 12, dtype=np.int32)
                features = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(coded.tobytes())])
                yield pa.RecordBatch.from_arrays([features, pa.array(np.full(len(found), label)), pa.array(n)], names=["_feature", "_class", "_n"])

    whole = listed.filter(F.octet_length("_content") >= 12).select("_label", "_content")
    return whole.mapInArrow(run, "_feature binary, _class long, _n long")


def fit(df, text_col, label_col, features="char_grams", chunk=CHUNK):
    """Fit a model on labelled texts.

    Documents per class come from the label column alone. Features are counted in a
    single shuffle on the feature, after counting per task (3-grams by batch, with no row
    for each place), with one count column per class. The table is written to the working folder, since its totals and every
    scoring read it again. Only per-class numbers reach the driver.
    """
    label = F.col(label_col).cast("string").alias("_label")
    documents = df.select(label).dropna().groupBy("_label").count().orderBy("_label").collect()
    if not documents:
        raise ValueError("No labelled rows to fit on")
    classes = [row["_label"] for row in documents]
    total = sum(row["count"] for row in documents)

    listed = _in_chunks(df.select(label, F.col(text_col).alias("_text")), features, "_text", chunk)
    if features == "char_grams":
        found, feature = _gram_counts(listed, classes), F.decode("_feature", CODE_POINTS)
        counts = [F.coalesce(F.sum(F.when(F.col("_class") == i, F.col("_n"))), F.lit(0)) for i in range(len(classes))]
    else:
        found, feature = _exploded(listed, features, "_label"), F.col("_feature")
        counts = [F.count_if(F.col("_label") == c) for c in classes]
    counted = found.groupBy("_feature").agg(*[n.alias(f"n_{i}") for i, n in enumerate(counts)])
    with _batch_bytes(df.sparkSession, COUNTED_BYTES):
        table, path = write_table(counted.select(feature.alias("feature"), *[f"n_{i}" for i in range(len(classes))]), "model")
    sums = table.agg(
        F.count("*").alias("rows"),
        *[F.coalesce(F.sum(f"n_{i}"), F.lit(0)).alias(f"n_{i}") for i in range(len(classes))],
    ).first()
    return Model(
        table=table,
        classes=classes,
        log_priors=[log(row["count"] / total) for row in documents],
        log_denominators=[log(max(sums[f"n_{i}"] + sums["rows"], 1)) for i in range(len(classes))],
        rows=sums["rows"],
        features=features,
        path=path,
    )


def _feature_sums(df, key_col, text, model, broadcast_limit, chunk):
    """One row per text: number of features `_k` and summed log weights `_s0`, `_s1`, …

    The join key is a 64-bit hash of the feature, which Spark looks up much faster than
    a string; the feature itself is compared afterwards, so a collision adds nothing.
    """
    n = range(len(model.classes))
    kind = model.features
    weights = model.table.select(_coded(kind, F.col("feature")).alias("_known"), *[F.log1p(f"n_{i}").alias(f"_w{i}") for i in n])
    weights = weights.select(F.xxhash64("_known").alias("_hash"), "*")
    whole = df.select(F.col(key_col).alias("_key"), text.alias("_text"))
    if model.estimated_bytes > broadcast_limit:
        # Features of a text are counted where it is listed; what a task holds then follows the
        # characters it has, not the size of the input.
        letters = whole.agg(F.coalesce(F.sum(F.char_length("_text")), F.lit(0))).first()[0]
        parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-letters // LETTERS_PER_TASK))
        whole = whole.repartition(parts, "_key")
    # Only a text of several chunks is gone through twice, for its number of features.
    pieces = chunks("_text", chunk, _overlap(kind))
    many = F.aggregate(pieces, F.lit(0), lambda found, c: found + _size(kind, _content(kind, c)))
    counted = whole.select("_key", "_text", F.when(F.char_length("_text") > chunk, many).alias("_many"))
    listed = _in_chunks(counted, kind, "_text", chunk)
    # Counted before the explode, so that the list itself is not carried along with each of its items.
    sized = listed.select("_key", F.coalesce("_many", _size(kind, F.col("_content")), F.lit(0)).alias("_k"), "_content")
    exploded = _exploded(sized, kind, "_key", "_k", explode=F.explode_outer)
    known = F.col("_feature") == F.col("_known")
    if model.estimated_bytes <= broadcast_limit:
        hashed = exploded.withColumn("_hash", F.xxhash64("_feature"))
        joined = hashed.join(F.broadcast(weights), "_hash", "left")
        weighted = [F.when(known, F.col(f"_w{i}")) for i in n]
    else:
        # Too large to broadcast: repeated features of a text are counted first, so the
        # shuffle carries each once. A feature common to most texts is a hot join key;
        # adaptive execution splits it where the session's number of tasks is enough, as the
        # model side has a single row for it; it has no more rows than there are texts.
        counted = exploded.groupBy("_key", "_k", "_feature").agg(F.count("*").alias("_times"))
        hashed = counted.withColumn("_hash", F.xxhash64("_feature"))
        # More tasks than the session gives a shuffle where these would hold too much of a large input.
        join_parts = -(-letters // LETTERS_PER_JOIN_TASK)
        if join_parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            hashed, weights = hashed.repartition(join_parts, "_hash"), weights.repartition(join_parts, "_hash")
        joined = hashed.join(weights.hint("merge"), "_hash", "left")
        weighted = [F.when(known, F.col("_times") * F.col(f"_w{i}")) for i in n]
    return joined.groupBy("_key").agg(
        F.max("_k").alias("_k"),
        *[F.coalesce(F.sum(w), F.lit(0.0)).alias(f"_s{i}") for i, w in enumerate(weighted)],
    )


def score(df, key_col, text_col, model, label_col="label", score_col="score",
          broadcast_limit=BROADCAST_LIMIT, without_features=None, chunk=CHUNK):
    """Best class and its probability per text: (`key_col`, `label_col`, `score_col`).

    `key_col` must be unique. All features of a text are exploded in one task, a chunk at
    a time, and summed there, so the shuffle carries one row of numbers per text and no text.
    `without_features` is the (label, score) of texts that have no feature at all.
    """
    sums = _feature_sums(df, key_col, F.col(text_col), model, broadcast_limit, chunk)
    log_scores = F.array(
        *[
            F.lit(model.log_priors[i]) - F.col("_k") * F.lit(model.log_denominators[i]) + F.col(f"_s{i}")
            for i in range(len(model.classes))
        ]
    )
    best = F.array_max("_lp")
    softmax = 1.0 / F.aggregate("_lp", F.lit(0.0), lambda total, lp: total + F.exp(lp - best))
    label = F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.array_position("_lp", best).cast("int"))
    if without_features:
        empty = F.col("_k") == 0
        label = F.when(empty, without_features[0]).otherwise(label)
        softmax = F.when(empty, without_features[1]).otherwise(softmax)
    return sums.select("_key", "_k", log_scores.alias("_lp")).select(
        F.col("_key").alias(key_col), label.alias(label_col), softmax.alias(score_col)
    )


def score_languages(df, key_col, text_col, model, broadcast_limit=BROADCAST_LIMIT):
    """Language and confidence per text; shorter than five characters is `und` with 0.

    `model` is a fitted one or a loader for `score_with`. A gated text is scored as
    missing, so it has no 3-gram; every other text has some.
    """
    known = is_language_text(text_col)
    if callable(model):
        found = score_with(df.select(key_col, text_col), text_col, model, "language", "language_confidence")
        return found.select(
            key_col,
            F.when(known, F.col("language")).otherwise(UNKNOWN_LANGUAGE).alias("language"),
            F.when(known, F.col("language_confidence")).otherwise(0.0).alias("language_confidence"),
        )
    gated = df.select(key_col, F.when(known, F.col(text_col)).alias(text_col))
    return score(gated, key_col, text_col, model, "language", "language_confidence",
                 broadcast_limit, without_features=(UNKNOWN_LANGUAGE, 0.0))


def score_sentiment(df, key_col, text_col, model, label_col="sentiment_label", score_col="sentiment_score",
                    broadcast_limit=BROADCAST_LIMIT, batch_size=MODEL_BATCH):
    """Sentiment and its probability per text; blank text is scored as a fixed word.

    `model` is a fitted one or a loader for `score_with`, whose failed batches are neutral.
    """
    filled = df.select(key_col, fill_blank(text_col).alias(text_col))
    if callable(model):
        scored = score_with(filled, text_col, model, label_col, score_col, batch_size, on_error="default")
        return scored.select(key_col, label_col, score_col)
    return score(filled, key_col, text_col, model, label_col, score_col, broadcast_limit)


def distinct_texts(df, text_col, key_col="_text_key"):
    """Each distinct text once, under its hash: for tables without a key of their own.

    Copies are folded per task before the shuffle. Missing text counts as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.sha2(text, 256).alias(key_col), text.alias(text_col)).distinct()


def join_text_scores(df, text_col, scores, key_col="_text_key"):
    """Add scores of distinct texts to all rows; rows without a score are left out.

    Read `scores` from a written table: both sides are then plain shuffles, so
    adaptive execution can split the key of a text that makes up much of `df`.
    """
    keyed = df.withColumn(key_col, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    return keyed.join(scores, key_col).drop(key_col)


def without_language_model(df):
    """Language columns when there is no model: NULL and 0."""
    return df.withColumn("language", F.lit(None).cast("string")).withColumn("language_confidence", F.lit(0.0))


def with_neutral_sentiment(df, label_col="sentiment_label", score_col="sentiment_score"):
    """Neutral defaults where the sentiment is missing, or everywhere without a model."""
    for name, default in ((label_col, NEUTRAL_LABEL), (score_col, NEUTRAL_SCORE)):
        value = F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)
        df = df.withColumn(name, value)
    return df


def score_with(df, text_col, load_model, label_col="label", score_col="score", batch_size=MODEL_BATCH,
               failed=(NEUTRAL_LABEL, NEUTRAL_SCORE), on_error=None):
    """Hook for any other model: adds a label and a score to every row.

    `load_model()` runs once per task and returns a function from a list of texts
    to a list of (label, score). It is called with `batch_size` texts at a time. With
    `on_error="default"`, a batch whose call raises gets `failed` instead.
    """
    others = [f for f in df.schema.fields if f.name not in (label_col, score_col)]
    schema = T.StructType(
        others + [T.StructField(label_col, T.StringType()), T.StructField(score_col, T.DoubleType())]
    )

    def run(batches):
        model = load_model()
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            found = []
            for start in range(0, len(texts), batch_size):
                part = texts[start:start + batch_size]
                try:
                    found.extend(model(part))
                except Exception:
                    if on_error != "default":
                        raise
                    found.extend([failed] * len(part))
            columns = {f.name: batch.column(f.name) for f in others}
            columns[label_col] = pa.array([f[0] for f in found], pa.string())
            columns[score_col] = pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, schema)
