"""Token ids of whole texts by a public tokenizer file, a word at a time.

For tokenizers that drop white space and never join characters across it, the ids of a
text are those of its words in order, and white space before a word changes nothing. Words
also part where an ASCII letter meets an ASCII mark (but `'`, which opens contractions, and `<|>`, which stand in special tokens), since such
tokenizers split there as well. Every different word is encoded once per worker, many words in
one call with a mark between them, and its ids are looked up after that.
"""

from functools import lru_cache

import numpy as np
import pandas as pd

from .common import SPACED, Hasher, row_bounds, signed

CACHED_WORDS = 2_000_000
# Bytes of text tokenised at a time.
TOKEN_BYTES = 1 << 20
# Words encoded in one call, and the mark between them, which is one id by itself.
CALL_WORDS = 4096
BETWEEN = "\x01"

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
MARK = np.zeros(256, bool)
MARK[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = True


def default_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class UnitSlots:
    """Numbers of units by their hashes, in the order they were added.

    Hashes lie in a few indexes of falling size; a new one is joined with those before it that
    are not much larger, so that adding costs little however many there are.
    """

    def __init__(self):
        self._indexes = []

    def __len__(self):
        return sum(map(len, self._indexes))

    def add(self, hashes):
        self._indexes.append(pd.Index(hashes))
        while len(self._indexes) > 1 and len(self._indexes[-2]) < 2 * len(self._indexes[-1]):
            last = self._indexes.pop()
            self._indexes[-1] = self._indexes[-1].append(last)

    def slots(self, hashes):
        """The number of each hash, or -1."""
        out, base = np.full(len(hashes), -1, np.int64), 0
        for index in self._indexes:
            open_ = np.flatnonzero(out < 0)
            found = index.get_indexer(hashes[open_])
            out[open_[found >= 0]] = found[found >= 0] + base
            base += len(index)
        return out


class WordTokens:
    """Ids of texts by `path`'s tokenizer; `end_id` is put after each text."""

    def __init__(self, path, end_id=1):
        from tokenizers import Tokenizer

        self._tokenizer, self._end = Tokenizer.from_file(path), end_id
        probe = ["Ab's c,d e(f) 12#x", "a-b<|endoftext|>c"]
        for text in probe:
            words = [self._tokenizer.encode(w, add_special_tokens=False).ids for w in text.split()]
            if self._tokenizer.encode(text, add_special_tokens=False).ids != sum(words, []):
                raise ValueError(f"{path} does not drop white space between words")
        [self._between] = self._tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self._clear()

    def _clear(self):
        self._known, self._ids = UnitSlots(), np.zeros(1 << 16, np.uint32)
        self._from, self._many, self._used = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _add(self, hashes, words):
        n = len(self._known)
        if n + len(words) > len(self._from):
            size = max(2 * len(self._from), n + len(words))
            self._from, self._many = (np.resize(x, size) for x in (self._from, self._many))
        ids, many = zip(*(self._encode(words[k : k + CALL_WORDS]) for k in range(0, len(words), CALL_WORDS)))
        ids, many = np.concatenate(ids), np.concatenate(many)
        total = int(many.sum())
        if self._used + total > len(self._ids):
            self._ids = np.resize(self._ids, max(2 * len(self._ids), self._used + total))
        self._ids[self._used : self._used + total] = ids
        self._from[n : n + len(words)] = self._used + np.cumsum(many) - many
        self._many[n : n + len(words)] = many
        self._known.add(hashes)
        self._used += total

    def _encode(self, words):
        """Ids of a block of words after each other, and how many each word has."""
        if any(BETWEEN in w for w in map(bytes.decode, words)):
            found = [e.ids for e in self._tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
            return np.concatenate([np.array(x, np.uint32) for x in found]), np.array([len(x) for x in found])
        text = f" {BETWEEN} ".join(map(bytes.decode, words))
        ids = np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        marks = np.flatnonzero(ids == self._between)
        return np.delete(ids, marks), np.diff(marks, prepend=-1, append=len(ids)) - 1

    def _cuts(self, data):
        """Marks the first byte of every unit: white space with the word after it, or a part of a word."""
        space, letter, mark = ~SPACED[data], LETTER[data], MARK[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = (space[1:] & ~space[:-1]) | (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
        return cut

    def __call__(self, data, offsets):
        """Ids of all texts after each other, and the offsets of the texts in them."""
        cut = self._cuts(data)
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        codes, different = pd.factorize(signed(Hasher(data)(starts, ends)))
        if len(self._known) + len(different) > CACHED_WORDS:
            self._clear()
        new = np.flatnonzero(self._known.slots(different) < 0)
        if len(new):
            # Codes are numbered as they come, so a unit stands first where the largest one grows.
            first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))[new]
            raw = data.tobytes()
            self._add(different[new], [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
        slots = self._known.slots(different)[codes]
        # The end id of every text is one more word after its last one.
        bounds = row_bounds(starts, offsets)
        many, begin = self._many[slots], self._from[slots]
        many, begin = np.insert(many, bounds[1:], 1), np.insert(begin, bounds[1:], -1)
        place = np.cumsum(many) - many
        at = np.repeat(begin - place, many) + np.arange(int(many.sum()))
        last = np.repeat(begin < 0, many)
        ids = np.where(last, np.uint32(self._end), self._ids[np.where(last, 0, at)])
        row_ends = np.cumsum(many)[bounds[1:] + np.arange(len(offsets) - 1)] if len(offsets) > 1 else np.zeros(0, np.int64)
        return ids, np.concatenate([[0], row_ends])


@lru_cache(maxsize=2)
def word_tokens(path, end_id):
    """One `WordTokens` per worker process, kept from task to task."""
    return WordTokens(path, end_id)


def pieces(row_offsets, longest):
    """Cut every text into runs of at most `longest` ids: (row, first id in its row, length)."""
    sizes = np.diff(row_offsets)
    parts = -(-sizes // longest)
    rows = np.repeat(np.arange(len(sizes)), parts)
    number = np.arange(len(rows)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = number * longest
    return rows, start, np.minimum(sizes[rows] - start, longest)
