"""Suffix-array dedup by a distributed difference cover.

Every byte covered by a string of `length` bytes that also starts elsewhere is removed. The
strings that start at all places are suffixes cut to `length` bytes; equal ones have to be
brought next to each other.

1. Screen. Places are fixed by content: of the window hashes in reach of a start, the least one
   is its anchor, the same for equal strings. Starts with one anchor form an interval. Starts
   whose anchor's window stands nowhere else cannot repeat. Where the whole text of an
   interval, up to its last string's end, stands elsewhere, all its starts repeat, and one such
   place stays as partner where another interval of that anchor has need of it. What is left is a small part of the text.
2. Sort sampled triples. In what is left, positions in a difference cover modulo `period` are
   sampled: any two equal strings have a sampled position at the same distance below
   `period`. A sampled position has a letter, the `period` bytes from it on; the triples of the
   letters at p, p + period and p + 2 period are sorted in ranges and equal neighbours get one
   name. Positions with a name of their own drop out.
3. Recurse on names. While three names side by side still fit into the string less one
   period, triples of names are sorted and named in turn.
4. Merge remaining suffixes. Every start within a period before a named position joins; its
   prefix of `length` bytes is one fingerprint.
5. Compare adjacent prefixes. Fingerprints are dealt out in ranges, sorted, and equal neighbours
   mark their starts, which return to their texts as covered runs.

Fingerprints have 64 bits and are those of whole byte ranges, so repeats are never found by a
prefix alone. No text goes through the driver; a text is moved twice, and only if it holds
repeats.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..sources.storage import delete_path, write_table
from .common import Hasher, arrow_schema, chunks, column_of, mix, record, shuffles_removed, signed, small_batches, text_bytes

LENGTH = 400
PERIOD = 91
# Passages of just over 50 words have this many bytes, unless their words are very short.
PASSAGE_LENGTH = 200
PASSAGE_PERIOD = 31
# A perfect difference set; each distance modulo 91 is a difference of two.
COVER = [0, 1, 3, 9, 27, 49, 56, 61, 77, 81]
# Covers by their period; a string has four periods less one byte at least.
COVERS = {PERIOD: COVER, 31: [1, 5, 11, 24, 25, 27]}
STARTS_PER_SLICE = 1 << 20
# Bytes of an anchor: the fewer, the fewer anchors a text has, and the more repeat by chance.
WINDOW = 64


def anchors(data, offsets, length):
    """Intervals of starts with one anchor: (text, first start, end, anchor hash, whole hash).

    Starts count from their text's beginning. The anchor is the leftmost least hash of the
    windows of `WINDOW` bytes (half a shorter string) that begin up to the string's length less a window after the start.
    """
    window = min(WINDOW, length // 2)
    reach = length - window + 1
    size = len(data) - length + 1
    if size <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    hasher = Hasher(data)
    places = np.arange(len(data) - window + 1)
    hashes = hasher(places, places + window)
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)
    step = 1
    while 2 * step <= reach:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if reach > step:
        least = np.minimum(least[: size], least[reach - step :][: size])
    anchor = (least[:size] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(size)
    text = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + length <= offsets[text + 1]
    starts, text, anchor = starts[inside], text[inside], anchor[inside]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    ends = starts[np.append(first[1:], len(starts)) - 1] + 1
    begin, text = starts[first], text[first]
    return text, begin - offsets[text], ends - offsets[text], hashes[anchor[first]], hasher(begin, ends - 1 + length)


def merged(starts, ends):
    """Union of ranges as maximal runs (starts, ends), sorted."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(starts, kind="stable")
    starts, ends = np.asarray(starts)[order], np.maximum.accumulate(np.asarray(ends)[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return starts[new], ends[np.append(new[1:], len(starts)) - 1]


def expand(starts, ends):
    """All numbers in the given ranges."""
    sizes = ends - starts
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def _pack(values):
    """Ascending numbers as four planes of the bytes of their steps, which compress well."""
    return np.ascontiguousarray(np.diff(values, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(raw):
    planes = np.frombuffer(raw, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))


def staged(df, name, paths=None):
    """`df` as a table in the shared folder; its path is added to `paths`."""
    with shuffles_removed(df.sparkSession):
        table, path = write_table(df, name)
    if paths is not None:
        paths.append(path)
    return table


def _screen(texts, length, paths):
    """(key, a, b, certain, stays): intervals of starts whose anchor window repeats.

    `certain`: all starts of the interval repeat; `stays`: it is the place that stays for others,
    which only intervals with the same anchor that are not certain have need of. The tables
    at `paths` are needed until the result is written.
    """
    schema = arrow_schema("place int, a long, b long, h long, whole long")

    def run(batches):
        for batch in chunks(batches, "text"):
            text, a, b, h, whole = anchors(*text_bytes(column_of(batch, "text")), length)
            if len(text):
                rows = record(schema, place=text.astype(np.int32), a=a, b=b, h=signed(h), whole=signed(whole))
                yield pa.RecordBatch.from_arrays([column_of(batch, "key").take(pa.array(text)), *rows.columns[1:]], names=["key", "a", "b", "h", "whole"])

    # Written, so that texts are read and hashed once; gone as soon as the repeated ones are found.
    found = staged(texts.mapInArrow(run, "key long, a long, b long, h long, whole long"), "intervals", first := [])
    # Counts are summed per task before they are dealt out and written, so that rows meet them in
    # joins of plain exchanges, which adaptive execution splits where one anchor holds a
    # large part of all rows.
    windows = staged(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "windows", paths)
    repeated = staged(found.join(windows, "h"), "anchors", paths)
    delete_path(texts.sparkSession, *first)
    wholes = staged(repeated.groupBy("h", "whole").agg(F.count("*").alias("n"), F.min(F.struct("key", "a")).alias("stay")), "wholes", paths)
    # A single interval is the one that may look for partners; without any, none has to stay.
    open_anchors = staged(wholes.groupBy("h").agg(F.min("n").alias("least")).filter("least = 1").select("h", F.lit(True).alias("open")), "open", paths)
    marked = repeated.join(wholes.join(open_anchors, "h", "left"), ["h", "whole"])
    certain = F.col("n") > 1
    return marked.select("key", "a", "b", certain.alias("certain"), (F.col("open").isNotNull() & (F.struct("key", "a") == F.col("stay"))).alias("stays"))


def _sampled(parts, period):
    """Letters' triples at the sampled positions of all fragments: (name, key, start, p)."""
    schema = arrow_schema("name long, start long, p long")
    cover = np.zeros(period, bool)
    cover[COVERS[period]] = True
    span = 3 * period

    def run(batches):
        for batch in chunks(batches, "bytes"):
            data, offsets = text_bytes(column_of(batch, "bytes"))
            origin = column_of(batch, "start").to_numpy()
            if len(data) < span:
                continue
            at = np.arange(len(data) - span + 1)
            row = np.searchsorted(offsets, at, "right") - 1
            p = at - offsets[row] + origin[row]
            use = cover[p % period] & (at + span <= offsets[row + 1])
            at, row, p = at[use], row[use], p[use]
            hasher = Hasher(data)
            first, second, third = (hasher(at + k * period, at + (k + 1) * period) for k in range(3))
            rows = record(schema, name=signed(mix(mix(first * np.uint64(3) + second) * np.uint64(5) + third)), start=origin[row], p=p)
            yield pa.RecordBatch.from_arrays([rows.column(0), column_of(batch, "key").take(pa.array(row)), *rows.columns[1:]], names=["name", "key", "start", "p"])

    return parts.mapInArrow(run, "name long, key long, start long, p long")


def _named(triples):
    """Sort in ranges and keep the positions whose name an adjacent one has as well."""
    return _neighbours(triples.repartitionByRange("name").sortWithinPartitions("name"))


def _neighbours(ordered):
    """Rows that have the name of the row before or after them, in ranges sorted by name."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            names = table["name"].to_numpy()
            same = np.zeros(len(names) + 1, bool)
            same[1:-1] = names[1:] == names[:-1]
            keep = same[1:] | same[:-1]
            # The last name goes on in the next batch; of a long run only two rows are held back.
            last = int(np.searchsorted(names, names[-1]))
            held = table.slice(max(last, len(names) - 2))
            keep[max(last, len(names) - 2) :] = False
            if last < len(names) - 2:
                keep[last : len(names) - 2] = True
            yield from table.filter(pa.array(keep)).to_batches()
        if held is not None and held.num_rows > 1:
            yield from held.to_batches()

    return ordered.mapInArrow(run, "name long, key long, start long, p long")


def _deeper(named, covered):
    """Triples of names side by side: the positions `covered` and 2 `covered` on have names as well."""
    later = [named.select("key", "start", (F.col("p") - k * covered).alias("p"), F.col("name").alias(f"name{k}")) for k in (1, 2)]
    joined = named.join(later[0], ["key", "start", "p"]).join(later[1], ["key", "start", "p"])
    return joined.select(F.xxhash64("name", "name1", "name2").alias("name"), "key", "start", "p")


def repeated_runs(texts, length=LENGTH, period=PERIOD):
    """Covered byte runs per text: (key, starts, ends), a row for each text that has some.

    Also returns the staged texts with a repeated anchor, with what else `texts.one` tells of them.
    """
    marks = _screen(texts.all, length, screen := []).groupBy("key").agg(F.collect_set(F.struct("a", "b", "certain", "stays")).alias("m"))
    marks = marks.select("key", *[F.col(f"m.{c}").alias(c) for c in ("a", "b", "certain", "stays")])
    touched = staged(texts.one(marks), "touched")
    for path in screen:
        delete_path(touched.sparkSession, path)

    part_schema = arrow_schema("start long, a array<long>, b array<long>")

    def fragments(batches):
        """Ranges of starts to look at, each joined with its neighbours, and their bytes."""
        for batch in chunks(batches, "text"):
            data, offsets = text_bytes(column_of(batch, "text"))
            keys, out = column_of(batch, "key"), {"start": [], "a": [], "b": []}
            rows, pieces = [], []
            for i in range(batch.num_rows):
                a, b, certain, stays = (np.asarray(column_of(batch, c)[i].values) for c in ("a", "b", "certain", "stays"))
                look = ~certain.astype(bool) | stays.astype(bool)
                a, b = merged(a[look], b[look])
                if not len(a):
                    continue
                whole_a, whole_b = merged(a, b + length - 1)
                for x, y in zip(whole_a.tolist(), whole_b.tolist()):
                    own = (a >= x) & (a < y)
                    out["start"].append(x)
                    out["a"].append(a[own].tolist())
                    out["b"].append(b[own].tolist())
                    rows.append(i)
                    pieces.append(data[offsets[i] + x : offsets[i] + y].tobytes())
            if rows:
                extra = record(part_schema, **out)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array(pieces, pa.binary()), *extra.columns], names=["key", "bytes", *part_schema.names])

    columns = "key long, bytes binary, start long, a array<long>, b array<long>"
    parts = staged(touched.filter(F.exists(F.arrays_zip("certain", "stays"), lambda x: ~x["certain"] | x["stays"])).select("key", "text", "a", "b", "certain", "stays").mapInArrow(fragments, columns), "fragments")

    covered = 3 * period
    if covered > length - period + 1:
        raise ValueError(f"length must be at least {4 * period - 1}")
    named = _named(_sampled(parts, period))
    while 3 * covered <= length - period + 1:
        named = _named(_deeper(staged(named, "names"), covered))
        covered *= 3
    named = named.groupBy("key", "start").agg(F.collect_list("p").alias("p"))
    # Written, so that both passes below see the same rows in the same chunks.
    joined = staged(parts.join(named, ["key", "start"]), "suffixes")
    size = joined.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0)).alias("n")).first()["n"]
    slices = int(size // STARTS_PER_SLICE) + 8

    def starts_of(batch):
        """(row, start in its text, place of the start in the chunk's bytes) of all suffixes to compare."""
        data, offsets = text_bytes(column_of(batch, "bytes"))
        origin = column_of(batch, "start").to_numpy()
        rows, starts = [], []
        for i in range(batch.num_rows):
            p = np.sort(np.asarray(column_of(batch, "p")[i].values))
            a, b = np.asarray(column_of(batch, "a")[i].values), np.asarray(column_of(batch, "b")[i].values)
            x, y = merged(np.maximum(p - period + 1, a[0]), np.minimum(p + 1, b[-1]))
            use = x < y
            x, y = merged(x[use], y[use])
            near, own = expand(x, y), np.zeros(0, np.int64)
            if len(near):
                k = np.searchsorted(a, near, "right") - 1
                own = near[(k >= 0) & (near < b[k])]
            rows.append(np.full(len(own), i))
            starts.append(own)
        rows, starts = np.concatenate(rows), np.concatenate(starts)
        return data, rows, starts, offsets[rows] + starts - origin[rows]

    schema = arrow_schema("slice int, chunk long, hashes binary, places binary")

    def numbered(batches):
        """Chunks with a number of their own; the same in every pass over the staged table."""
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(chunks(batches, "bytes")):
            yield first + k, batch

    def deal(batches):
        for number, batch in numbered(batches):
            data, rows, starts, at = starts_of(batch)
            prints = Hasher(data)(at, at + length)
            where = (prints >> np.uint64(40)).astype(np.int64) * slices >> 24
            order = np.argsort(where, kind="stable")
            edges = np.searchsorted(where[order], np.arange(slices + 1))
            used = np.flatnonzero(np.diff(edges))
            own = [order[edges[k] : edges[k + 1]] for k in used]
            yield record(schema, slice=used, chunk=np.full(len(used), number), hashes=[prints[o].tobytes() for o in own], places=[_pack(o) for o in own])

    def compare(table):
        hashes = [np.frombuffer(x, "<u8") for x in table["hashes"].to_pylist()]
        ends = np.cumsum([len(x) for x in hashes])
        hashes = np.concatenate(hashes)
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        same = ordered[1:] == ordered[:-1]
        again = np.zeros(len(hashes), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        chunk, places = table["chunk"].to_pylist(), table["places"].to_pylist()
        out = {"chunk": [], "places": []}
        for k, end in enumerate(ends.tolist()):
            own = _unpack(places[k])
            hit = own[again[end - len(own) : end]]
            if len(hit):
                out["chunk"].append(chunk[k])
                out["places"].append(_pack(hit))
        return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "places": pa.array(out["places"], pa.binary())})

    dealt = joined.mapInArrow(deal, "slice int, chunk long, hashes binary, places binary")
    answers = dealt.groupBy("slice").applyInArrow(compare, "chunk long, places binary")

    # The chunks' own suffix lists, as compact ranges, meet the answers.
    def lists(batches):
        for number, batch in numbered(batches):
            _, rows, starts, _ = starts_of(batch)
            if len(rows):
                edge = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(rows) != 0)]))
                keys = column_of(batch, "key").to_numpy()[rows[edge]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([keys.tolist()], pa.list_(pa.int64())), pa.array([starts[edge].tolist()], pa.list_(pa.int64())),
                     pa.array([np.append(edge, len(rows)).tolist()], pa.list_(pa.int64()))], names=["chunk", "keys", "starts", "edges"])

    listed = joined.mapInArrow(lists, "chunk long, keys array<long>, starts array<long>, edges array<long>")

    def resolve(chunk_key, own, found):
        keys, begins, ends = [], [], []
        if own.num_rows and found.num_rows:
            run_keys, run_starts, edges = (np.asarray(own[c][0].values) for c in ("keys", "starts", "edges"))
            hit = np.sort(np.concatenate([_unpack(x) for x in found["places"].to_pylist()]))
            run = np.searchsorted(edges, hit, "right") - 1
            start = run_starts[run] + hit - edges[run]
            key = run_keys[run]
            order = np.lexsort((start, key))
            key, start = key[order], start[order]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(start) > length)]))
            keys, begins = key[new], start[new]
            ends = start[np.append(new[1:], len(start)) - 1] + length
        return pa.table({"key": pa.array(keys, pa.int64()), "a": pa.array(begins, pa.int64()), "e": pa.array(ends, pa.int64())})

    found = listed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(resolve, "key long, a long, e long")
    sure = touched.select("key", F.explode(F.arrays_zip("a", "b", "certain")).alias("x")).filter("x.certain").select("key", F.col("x.a").alias("a"), (F.col("x.b") + (length - 1)).alias("e"))
    runs = found.union(sure).groupBy("key").agg(F.collect_list("a").alias("starts"), F.collect_list("e").alias("ends"))
    return runs, touched.drop("a", "b", "certain", "stays")


class _Texts:
    """Different texts of a table: `all` rows as (key, text), `one(marks)` a row per marked key with its text and number of rows."""

    def __init__(self, docs, id_col, text_col):
        plain = dict(docs.dtypes)[id_col].split("<")[0] not in ("struct", "array", "map", "variant")
        # Ids that may hold maps have no order; a hash of them as JSON stands for them.
        own = F.col(id_col) if plain else F.xxhash64(F.to_json(F.struct(F.col(id_col))))
        self._rows = docs.select(own.alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
        self.all = self._rows.select("key", "text")
        self.stands = self._rows.select("id", "key").groupBy("key").agg(F.min("id").alias("stand"), F.count("*").alias("copies"))

    def one(self, marks):
        wanted = marks.join(self.stands, "key").withColumnRenamed("key", "own")
        return self._rows.join(wanted, (F.col("key") == F.col("own")) & F.col("id").eqNullSafe(F.col("stand"))).select("key", "text", "copies", "a", "b", "certain", "stays").dropDuplicates(["key"])


class _Pieces:
    """Passages of `length` bytes and more as texts of their own, told apart by text and start.

    A text of several rows has its passages in `all` twice, which is enough to make them repeats.
    """

    def __init__(self, passages, length):
        schema = arrow_schema("start long")

        def pieces(batches):
            for batch in chunks(batches, "text"):
                data, offsets = text_bytes(column_of(batch, "text"))
                rows, starts, parts = [], [], []
                for i in range(batch.num_rows):
                    for a, e in zip(column_of(batch, "starts")[i].as_py(), column_of(batch, "ends")[i].as_py()):
                        if e - a >= length:
                            rows.append(i)
                            starts.append(a)
                            parts.append(data[offsets[i] + a : offsets[i] + e].tobytes())
                if rows:
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [column_of(batch, "key").take(at), column_of(batch, "copies").take(at), record(schema, start=starts).column(0), pa.array(parts, pa.binary())],
                        names=["own", "copies", "start", "text"])

        found = passages.mapInArrow(pieces, "own long, copies long, start long, text binary")
        self._rows = staged(found.withColumn("key", F.xxhash64("own", "start")), "pieces")
        twice = F.explode(F.array_repeat("key", F.least("copies", F.lit(2)).cast("int")))
        self.all = self._rows.select(twice.alias("key"), "text")

    def one(self, marks):
        return self._rows.join(marks, "key").select("key", "text", "a", "b", "certain", "stays")

    def in_texts(self, runs):
        """Runs of pieces as runs of the texts they are from."""
        here = [F.flatten(F.collect_list(F.transform(c, lambda x: x + F.col("start")))).alias(c) for c in ("starts", "ends")]
        return runs.join(self._rows.select("key", "own", "start"), "key").groupBy(F.col("own").alias("key")).agg(*here)


def _without(raw, starts, ends):
    """The bytes outside of the given maximal runs."""
    edges = [0, *np.column_stack([starts, ends]).ravel().tolist(), None]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(docs, id_col="doc_id", text_col="text", length=LENGTH, period=PERIOD):
    """For every row: `n_bytes`, `n_removed`, `n_spans`, `kept_sha256` and `kept`.

    `kept` is the remaining text (NULL for a missing one); bytes of a character that is cut
    inside are left out of it but count in `kept_sha256`, which is over exactly the
    remaining bytes. A missing or empty text has no bytes. Repeated rows of `length` bytes and more
    are removed whole. `length` is at least four periods less one; `period` is one of `COVERS`. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    runs, touched = repeated_runs(_Texts(docs, id_col, text_col), length, period)
    schema = arrow_schema("n_removed long, n_spans long, kept_sha256 string, kept string")

    def cut(batches):
        for batch in chunks(batches, "text"):
            data, offsets = text_bytes(column_of(batch, "text"))
            out = {name: [] for name in schema.names}
            for i in range(batch.num_rows):
                starts, ends = merged(np.asarray(column_of(batch, "starts")[i].values), np.asarray(column_of(batch, "ends")[i].values))
                left = _without(data[offsets[i] : offsets[i + 1]].tobytes(), starts, ends)
                out["n_removed"].append(int((ends - starts).sum()))
                out["n_spans"].append(len(starts))
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["kept"].append(left.decode(errors="ignore"))
            rest = record(schema, **out)
            yield pa.RecordBatch.from_arrays([column_of(batch, "key"), *rest.columns], names=["key", *schema.names])

    results = touched.join(runs, "key").mapInArrow(cut, "key long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return _results(docs, id_col, text_col, results, ["n_removed", "n_spans"], ["kept"])


def _results(docs, id_col, text_col, results, counts, texts):
    """`results` by text for every row; rows without any have counts of 0 and their own text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("_sha"), F.col(text_col).alias("_text"))
    return own.join(results, "key", "left").select(
        F.col("_id").alias(id_col), "n_bytes", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.coalesce("kept_sha256", "_sha").alias("kept_sha256"), *[F.coalesce(c, "_text").alias(c) for c in texts])


def remove_repeats_and_passages(docs, id_col="doc_id", text_col="text", length=LENGTH, period=PERIOD, passage_length=PASSAGE_LENGTH, passage_period=PASSAGE_PERIOD):
    """The columns of `remove_repeats`, and the same by a shorter length: `n_passages`, `n_passage_bytes` and `kept_outside_passages`.

    A passage is a maximal run of bytes covered by strings of `passage_length` bytes that also start
    elsewhere; `kept_outside_passages` is the text that remains without them. A string of `length` bytes
    that repeats lies inside a passage, as all its parts repeat, so those are looked for in
    passages only.
    """
    small_batches(docs.sparkSession)
    columns = "key long, text string, copies long, starts array<long>, ends array<long>"
    schema = arrow_schema(columns)

    def maximal(batches):
        for batch in batches:
            ranges = [merged(np.asarray(a.values), np.asarray(e.values)) for a, e in zip(column_of(batch, "starts"), column_of(batch, "ends"))]
            yield record(schema, starts=[a for a, _ in ranges], ends=[e for _, e in ranges], **{c: column_of(batch, c) for c in ("key", "text", "copies")})

    runs, touched = repeated_runs(_Texts(docs, id_col, text_col), passage_length, passage_period)
    passages = staged(touched.join(runs, "key").select("key", "text", "copies", "starts", "ends").mapInArrow(maximal, columns), "passages")
    pieces = _Pieces(passages, length)
    longer = pieces.in_texts(repeated_runs(pieces, length, period)[0]).select("key", F.col("starts").alias("a"), F.col("ends").alias("e"))
    none = F.array().cast("array<long>")
    marked = passages.join(longer, "key", "left").select("key", "text", "starts", "ends", F.coalesce("a", none).alias("a"), F.coalesce("e", none).alias("e"))
    found = "n_removed long, n_spans long, n_passages long, n_passage_bytes long, kept_sha256 string, kept string, kept_outside_passages string"
    out_schema = arrow_schema(found)

    def cut(batches):
        for batch in chunks(batches, "text"):
            data, offsets = text_bytes(column_of(batch, "text"))
            out = {name: [] for name in out_schema.names}
            for i in range(batch.num_rows):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                a, e = merged(np.asarray(column_of(batch, "a")[i].values), np.asarray(column_of(batch, "e")[i].values))
                starts, ends = np.asarray(column_of(batch, "starts")[i].values), np.asarray(column_of(batch, "ends")[i].values)
                left = _without(raw, a, e)
                out["n_removed"].append(int((e - a).sum()))
                out["n_spans"].append(len(a))
                out["n_passages"].append(len(starts))
                out["n_passage_bytes"].append(int((ends - starts).sum()))
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["kept"].append(left.decode(errors="ignore"))
                out["kept_outside_passages"].append(_without(raw, starts, ends).decode(errors="ignore"))
            rest = record(out_schema, **out)
            yield pa.RecordBatch.from_arrays([column_of(batch, "key"), *rest.columns], names=["key", *out_schema.names])

    results = marked.mapInArrow(cut, f"key long, {found}")
    return _results(docs, id_col, text_col, results, ["n_removed", "n_spans", "n_passages", "n_passage_bytes"], ["kept", "kept_outside_passages"])
