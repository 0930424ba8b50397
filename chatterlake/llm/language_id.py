"""Language identification by prediction with partial matching.

Every language has a context tree over the bytes of lower-cased text: for each context of 0
to `ORDER` bytes, the counts of the bytes that followed it. The statistics are frozen after
fitting. A byte costs -log2 of c/(T+d) in the longest known context that has seen it; every
longer known context costs an escape, d/(T+d) (T: bytes seen there, d: different ones).
The language with the shortest code for the whole text wins. Fitting counts on Spark over a
bounded sample per language; scoring is one pass without a shuffle.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from .common import arrow_schema, chunks, column_of, record, small_batches, sums, text_bytes

ORDER = 4
# Labelled rows per language that a model is fitted on.
ROWS_PER_LANGUAGE = 1500
CACHED_KEYS = 1_000_000
UNKNOWN = "und"


def _keys(data, offsets, order=ORDER):
    """Each byte with the `order` bytes before it, newest lowest; zero before a text's start."""
    keys = data.astype(np.uint64)
    back = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order + 1):
        shifted = np.zeros(len(data), np.uint64)
        shifted[k:] = data[:-k] if k < len(data) else 0
        shifted[back < k] = 0
        keys |= shifted << np.uint64(8 * k)
    return keys


@dataclass
class Model:
    """Languages and, per order, sorted keys with a column per language.

    `cost[o]` holds the bits of a byte in its context (NaN: not seen there), `escape[o]` the bits
    of leaving a context (0: context not known, so nothing is left).
    """

    languages: list
    grams: list
    cost: list
    contexts: list
    escape: list

    def bits(self, keys):
        """Code length of each key in each language."""
        total = np.zeros((len(keys), len(self.languages)))
        open_ = np.ones(total.shape, bool)
        for order in range(ORDER, -1, -1):
            part = keys & np.uint64((1 << (8 * (order + 1))) - 1)
            cost = _rows(self.grams[order], self.cost[order], part, np.nan)
            escape = _rows(self.contexts[order], self.escape[order], part >> np.uint64(8), 0.0)
            here = open_ & ~np.isnan(cost)
            total += np.where(here, cost, np.where(open_, escape, 0.0))
            open_ &= ~here
        return total + 8.0 * open_


def _rows(sorted_keys, values, wanted, default):
    if not len(sorted_keys):
        return np.full((len(wanted), values.shape[1]), default)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return np.where((sorted_keys[at] == wanted)[:, None], values[at], default)


def fit(labelled, text_col="text", lang_col="lang", key_col="doc_id", rows_per_language=ROWS_PER_LANGUAGE):
    """Fit on about `rows_per_language` rows of each language, chosen by a hash of the key.

    Rows without text or language are left out. Counting is done in the tasks and summed by
    Spark; the collected trees keep every node of the sample, which bounds them.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(lang_col).alias("lang"), F.lower(text_col).alias("text"), F.xxhash64(key_col).alias("h"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], [np.zeros(0, np.uint64)] * (ORDER + 1), [np.zeros((0, 0))] * (ORDER + 1),
                     [np.zeros(0, np.uint64)] * (ORDER + 1), [np.zeros((0, 0))] * (ORDER + 1))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, rows_per_language / sizes[lang]))])
    sample = rows.filter(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "text")
    columns = "lang int, key long, n long"
    schema = arrow_schema(columns)

    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches):
        totals = {}
        for batch in chunks(batches, "text"):
            names = [number[lang] for lang in column_of(batch, "lang").to_pylist()]
            data, offsets = text_bytes(column_of(batch, "text"))
            keys, names = _keys(data, offsets), np.repeat(names, np.diff(offsets))
            for lang in np.unique(names).tolist():
                found, n = np.unique(keys[names == lang], return_counts=True)
                old = totals.get(lang)
                part = pd.Series(n, index=found)
                totals[lang] = part if old is None else old.add(part, fill_value=0)
        for lang, counted in totals.items():
            yield record(schema, lang=[lang] * len(counted), key=counted.index.to_numpy().astype(np.int64), n=counted.to_numpy().astype(np.int64))

    counted = sample.mapInArrow(count, columns).groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    return _trees(counted, languages)


def _trees(counted, languages):
    lang, key, n = (counted[c].to_numpy().astype(kind) for c, kind in (("lang", np.int64), ("key", np.uint64), ("n", np.int64)))
    model = Model(languages, [], [], [], [])
    for order in range(ORDER + 1):
        part = key & np.uint64((1 << (8 * (order + 1))) - 1)
        table = pd.DataFrame({"key": part, "lang": lang, "n": n}).groupby(["key", "lang"], as_index=False)["n"].sum()
        grams, at = np.unique(table["key"].to_numpy(), return_inverse=True)
        contexts, up = np.unique(grams >> np.uint64(8), return_inverse=True)
        counts = np.zeros((len(grams), len(languages)))
        counts[at, table["lang"].to_numpy()] = table["n"].to_numpy()
        totals, kinds = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
        np.add.at(totals, up, counts)
        np.add.at(kinds, up, counts > 0)
        whole = totals + kinds
        with np.errstate(divide="ignore", invalid="ignore"):
            cost = -np.log2(counts / whole[up])
            escape = -np.log2(kinds / whole)
        cost[counts == 0] = np.nan
        escape[totals == 0] = 0.0
        model.grams.append(grams)
        model.cost.append(cost)
        model.contexts.append(contexts)
        model.escape.append(escape)
    return model


def predict_language(docs, model, id_col="doc_id", text_col="text"):
    """`lang_pred` and `score` for every row, with the code length in bits.

    Texts that are missing or have no letter are `und` with score 0; so is everything when
    the model knows no language. `score` is the winner's posterior share under equal priors.
    Equal code lengths go to the language that sorts first. Repeated rows are scored each.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    columns = "lang_pred string, score double, bits double"
    schema = arrow_schema(columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    prepared = docs.select(F.col(id_col), F.lower(text_col).alias("_text"), lettered.alias("_lettered"))

    def run(batches):
        trees = shared.value
        names = np.array([*trees.languages, UNKNOWN], object)
        known, costs = np.zeros(0, np.uint64), np.zeros((0, len(trees.languages)))
        for batch in chunks(batches, "_text"):
            lettered = column_of(batch, "_lettered").to_numpy(zero_copy_only=False)
            if not trees.languages or not lettered.any():
                rows = record(schema, lang_pred=[UNKNOWN] * batch.num_rows, score=np.zeros(batch.num_rows), bits=np.zeros(batch.num_rows))
            else:
                data, offsets = text_bytes(column_of(batch, "_text"))
                codes, found = pd.factorize(_keys(data, offsets).view(np.int64))
                found = found.view(np.uint64)
                at = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
                new = found if not len(known) else found[known[at] != found]
                if len(new):
                    if len(known) + len(new) > CACHED_KEYS:
                        known, costs, new = known[:0], costs[:0], found
                    known, costs = np.concatenate([known, new]), np.concatenate([costs, trees.bits(new)])
                    order = np.argsort(known)
                    known, costs = known[order], costs[order]
                own = costs[np.searchsorted(known, found)]
                lengths = np.column_stack([sums(own[codes, k], offsets) for k in range(len(trees.languages))])
                best = lengths.argmin(1)
                least = lengths[np.arange(len(best)), best]
                score = 1.0 / np.exp2(np.maximum(least[:, None] - lengths, -1000.0)).sum(1)
                best = np.where(lettered, best, len(trees.languages))
                rows = record(schema, lang_pred=names[best], score=np.where(lettered, score, 0.0), bits=np.where(lettered, least, 0.0))
            yield pa.RecordBatch.from_arrays([column_of(batch, id_col), *rows.columns], names=[id_col, *schema.names])

    return prepared.mapInArrow(run, f"`{id_col}` {kind}, {columns}")
