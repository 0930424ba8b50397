"""Delimited records that may span lines, cut by many tasks.

Whether a place of a file is inside quotes depends on all quotes before it. Every split of a
file is first read for what it does to that: where it ends if it starts outside quotes, and where if
inside. These answers, one small row per split, are put one after the other, which gives every
split's start. Then all splits are cut into records at once; what a split begins or ends with of a
record that reaches over its edge is put together afterwards.

Records follow the rules of comma-separated files: a quote opens a field only at its start, two
quotes inside stand for one, text behind a closing quote belongs to the field, and a line
break (LF, CRLF or CR) outside quotes ends the record. Inside quotes every character is kept.
"""

import csv
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

FILE, RAW = "_record_file", "_raw_record"
_PIECE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")
_INSIDE = re.compile(r'(?:[^"]|"")*+')
# Tells an empty field (missing) from a quoted one without characters, where Python can.
_QUOTING = getattr(csv, "QUOTE_NOTNULL", csv.QUOTE_MINIMAL)
# A field may be as long as memory allows.
_LONGEST_FIELD = (1 << 31) - 1


@lru_cache(maxsize=16)
def _open_end(delimiter):
    """Pattern of a line that starts outside quotes and ends inside."""
    mark = rf"(?:{re.escape(delimiter)}|\r)"
    bare = rf"(?:(?!{mark}).)*+"
    return re.compile(rf'(?:(?:"(?:[^"]|"")*+"(?!"){bare}|(?!"){bare}){mark})*+"(?:[^"]|"")*+', re.S)


def ends_inside(line, inside, delimiter):
    """Whether the text is inside quotes after a line (without its line feed)."""
    if '"' not in line:
        return inside
    if inside:
        close = _INSIDE.match(line).end()
        if close == len(line):
            return True
        # Behind the closing quote the field goes on to its end.
        rest = re.compile(rf"{re.escape(delimiter)}|\r").search(line, close + 1)
        if rest is None:
            return False
        line = line[rest.end():]
    return _open_end(delimiter).fullmatch(line) is not None


def parse(text, delimiter):
    """(fields, raw record) of every record of a text that begins and ends outside quotes."""
    taken = []

    def pieces():
        for piece in _PIECE.findall(text):
            taken.append(piece)
            yield piece

    csv.field_size_limit(_LONGEST_FIELD)
    for fields in csv.reader(pieces(), delimiter=delimiter, quoting=_QUOTING):
        raw = "".join(taken)
        taken.clear()
        if fields:
            yield fields, raw


def _runs(batches):
    """Lines of each split: (path, block, lines, whether these are its first)."""
    last = None
    for batch in batches:
        table = batch.to_pydict()
        start, n = 0, batch.num_rows
        while start < n:
            key = table["path"][start], table["block"][start]
            stop = start + 1
            while stop < n and (table["path"][stop], table["block"][stop]) == key:
                stop += 1
            yield *key, table["value"][start:stop], key != last
            last, start = key, stop


def strict_line(delimiter):
    """Pattern, for Java and Python, of a line that by itself is whole fields, free of quotes or quoted from end to end."""
    mark = re.escape(delimiter)
    field = rf'(?:"(?:[^"\r]|"")*+"|(?:(?!{mark})[^"\r])*+)'
    return rf"^{field}(?:{mark}{field})*+\r?$"


class _Split:
    """What is known of a split after some of its lines."""

    def __init__(self, path, block, delimiter):
        self.key, self._delimiter, self._strict = (path, block), delimiter, re.compile(strict_line(delimiter))
        self.ends, self.strict = (False, True), True
        self.header, self._head, self._head_open = None, "", block == 0

    def add(self, line):
        if self._head_open:
            self._add_to_head(line)
        if '"' in line or "\r" in line:
            self.strict = self.strict and self._strict.match(line) is not None
            if self.ends[0] == self.ends[1]:
                self.ends = (ends_inside(line, self.ends[0], self._delimiter),) * 2
            else:
                self.ends = tuple(ends_inside(line, e, self._delimiter) for e in self.ends)

    def _add_to_head(self, line):
        self._head += line + "\n"
        text = self._head.removeprefix("\ufeff")
        inside = False
        for own in text.split("\n"):
            inside = ends_inside(own, inside, self._delimiter)
        if not inside and text.strip("\r\n"):
            self.header, self._head_open = [name or "" for name in next(parse(text, self._delimiter))[0]], False

    def row(self):
        values = [*self.key, *self.ends, self.strict, self.header]
        types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["path", "block", "outside", "inside", "strict", "header"])


def _effects(lines, delimiter):
    """A row per split: whether it ends inside quotes, by how it starts; whether all its lines are strict; a file's header."""
    def run(batches):
        split = None
        for path, block, own, first in _runs(batches):
            if first:
                if split:
                    yield split.row()
                split = _Split(path, block, delimiter)
            for line in own:
                split.add(line)
        if split:
            yield split.row()

    return lines.mapInArrow(run, "path string, block long, outside boolean, inside boolean, strict boolean, header array<string>")


def file_states(lines, delimiter):
    """A row per file: its splits' first bytes (`blocks`), whether these start and end inside quotes, `strict` and `header`.

    A split that ends alike however it starts settles the state; the others after it keep or turn
    it. Nothing is known of a file without a byte, which has no row.
    """
    effects = _effects(lines, delimiter)
    so_far = Window.partitionBy("path").orderBy("block")
    settles = F.col("outside") == F.col("inside")
    turns = effects.withColumn("_turn", (~settles & F.col("outside")).cast("int"))
    turns = turns.withColumn("_group", F.sum(settles.cast("int")).over(so_far))
    group = Window.partitionBy("path", "_group").orderBy("block")
    # A file begins outside quotes.
    base = F.first(F.when(settles, F.col("outside")).otherwise(F.lit(False))).over(group).cast("int")
    turned = F.sum("_turn").over(group)
    states = turns.withColumn("_end", ((base + turned) % 2).cast("boolean"))
    states = states.withColumn("_start", F.coalesce(F.lag("_end").over(so_far), F.lit(False)))
    whole = F.array_sort(F.collect_list(F.struct("block", "_start", "_end")))
    files = states.groupBy("path").agg(whole.alias("s"), F.bool_and("strict").alias("strict"), F.max("header").alias("header"))
    return files.select("path", F.col("s.block").alias("blocks"), F.col("s._start").alias("starts"), F.col("s._end").alias("ends"), "strict", "header")


def read_lines(reader, path):
    """Lines with their file and the first byte of their split; only a line feed ends a line."""
    return reader.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


class UnclosedQuote(ValueError):
    """A file ends inside quotes."""


def read_spanning(lines, names, header, delimiter, files=None):
    """Records of files whose records may span lines: `names` as strings, `FILE`, and `RAW` where there are too many fields.

    The first record of every file must be `header` and is left out. A file that ends inside quotes is
    an error, as the quote may have swallowed records. Splits are cut as in the pass that found
    their states (`files`, rows of `file_states`); should they come out otherwise later on, the read
    fails and has to be started again.
    """
    spark = lines.sparkSession
    states, crossing = {}, False
    for r in files if files is not None else file_states(lines, delimiter).toLocalIterator():
        if r["ends"][-1]:
            raise UnclosedQuote(f"{r['path']} ends inside quotes")
        states[r["path"]] = dict(zip(r["blocks"], r["starts"]))
        crossing = crossing or any(r["starts"])
    shared = spark.sparkContext.broadcast(states)
    width = len(names)
    columns = [*names, FILE, RAW]
    schema = pa.schema([(c, pa.string()) for c in columns])
    ddl = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)

    def batch_of(found, path):
        rows = [[*fields[:width], *[None] * (width - len(fields)), path, raw if len(fields) > width else None] for fields, raw in found]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)

    def without_header(text, path, delimiter):
        found = parse(text.removeprefix("\ufeff"), delimiter)
        first = next(found, None)
        if first is not None and [f or "" for f in first[0]] != header:
            raise ValueError(f"{path} has the header {first[0]}, not {header}")
        return found

    def start_of(path, block):
        try:
            return shared.value[path][block]
        except KeyError:
            raise RuntimeError(f"{path} is split otherwise than when its quotes were counted; read it again") from None

    def records(batches):
        """Whole records of each split."""
        for path, block, lines_, first in _runs(batches):
            if first:
                inside = begun_inside = start_of(path, block)
                headed, held = block == 0, []
            held_now = []
            for line in lines_:
                held.append(line)
                inside = ends_inside(line, inside, delimiter)
                if not inside:
                    if begun_inside:
                        # The end of a record of an earlier split.
                        begun_inside = False
                    else:
                        held_now += held
                    held = []
            if held_now:
                text = "\n".join(held_now) + "\n"
                found = list(without_header(text, path, delimiter) if headed else parse(text, delimiter))
                headed = False
                if found:
                    yield batch_of(found, path)

    def edges(batches):
        """What each split holds of records that reach over its edges: (path, block, begins, text)."""
        held, key, inside, begun_inside = [], None, False, False

        def rows(end):
            if begun_inside:
                return [(*key, False, end)]
            return [(*key, True, end)] if end else []

        out = []
        for path, block, lines_, first in _runs(batches):
            if first:
                out += rows("".join(held)) if key and (held or begun_inside) else []
                key, held = (path, block), []
                inside = begun_inside = start_of(path, block)
            for line in lines_:
                held.append(line + "\n")
                inside = ends_inside(line, inside, delimiter)
                if not inside:
                    if begun_inside:
                        out += rows("".join(held))
                        begun_inside = False
                    held = []
        out += rows("".join(held)) if key and (held or begun_inside) else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["path", "block", "begins", "text"])

    whole = lines.mapInArrow(records, ddl)
    if not crossing:
        return whole
    parts = lines.mapInArrow(edges, "path string, block long, begins boolean, text string")
    # A record begins at the end of one split and has all the following ones' parts up to the next that begins.
    begun = Window.partitionBy("path").orderBy("block", "begins")
    numbered = parts.withColumn("_record", F.sum(F.col("begins").cast("int")).over(begun))
    joined = numbered.groupBy("path", "_record").agg(F.array_sort(F.collect_list(F.struct("block", "begins", "text"))).alias("t"), F.min("block").alias("block"))
    texts = joined.select("path", "block", F.array_join("t.text", "").alias("text"))

    def spanning(batches):
        for batch in batches:
            for path, block, text in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "text"))):
                found = list(parse(text, delimiter))
                if found:
                    yield batch_of(found, path)

    return whole.union(texts.mapInArrow(spanning, ddl))
