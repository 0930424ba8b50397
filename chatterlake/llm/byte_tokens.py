"""Token ids of whole texts by a public byte-level BPE file, a unit at a time.

Such a tokenizer keeps white space: a run of it goes with, or stands before, the word after
it, and nothing it does reaches back over the start of a run that follows a plain character.
Texts are cut there, and between ASCII letters and marks as in `tokens`, and the ids of a
text are those of its units in order. Every different unit is encoded once per worker.
"""

from functools import lru_cache

import numpy as np

from .common import SPACED
from .tokens import LETTER, MARK, WordTokens

# Last bytes of characters that are surely no white space: printable ASCII, and U+00C0 to U+00FF by their first byte.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_LATIN = 0xC3

_PROBES = ["Two  words,\n\nthree lines\r\n\tand  a   café à la  carte 12 34's end \n ", " <|endoftext|> x<|endoftext|>y", "", "\n"]


def default_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteTokens(WordTokens):
    """Ids of texts by `path`'s byte-level tokenizer; `end_id` is put after each text."""

    def __init__(self, path, end_id=0):
        from tokenizers import Tokenizer

        self._tokenizer, self._end = Tokenizer.from_file(path), end_id
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        # One character of a token stands for one byte of the text.
        self._size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self._size[number] = len(token)
        self._clear()
        raw = [p.encode() for p in _PROBES]
        ids, offsets = self(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        whole = [e.ids + [end_id] for e in self._tokenizer.encode_batch(_PROBES, add_special_tokens=False)]
        if [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] != whole:
            raise ValueError(f"{path} is not a byte-level tokenizer that starts anew at white space")

    def _cuts(self, data):
        space, letter, mark = ~SPACED[data], LETTER[data], MARK[data]
        plain = _PLAIN[data]
        plain[1:] |= data[:-1] == _LATIN
        cut = np.zeros(len(data), bool)
        cut[1:] = (space[1:] & plain[:-1]) | (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
        return cut

    def _encode(self, words):
        """Ids of a block of units after each other, and how many each unit has."""
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(words), np.uint8)
        # Units that start with white space and end plainly keep their ids side by side.
        last = ends - 1
        joined = ~SPACED[data[ends - sizes]] & (_PLAIN[data[last]] | ((sizes > 1) & (data[last - 1] == _LATIN)))
        alone, together = np.flatnonzero(~joined), np.flatnonzero(joined)
        found = [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast([words[k].decode() for k in alone.tolist()], add_special_tokens=False)]
        many = np.zeros(len(words), np.int64)
        many[alone] = [len(x) for x in found]
        if len(together):
            text = b"".join([words[k] for k in together.tolist()]).decode()
            ids = np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            edges, reach = np.cumsum(sizes[together]), np.cumsum(self._size[ids])
            cuts = np.searchsorted(reach, edges) + 1
            if (reach[cuts - 1] != edges).any():
                raise ValueError("A token reaches from one unit into the next")
            many[together] = np.diff(cuts, prepend=0)
            found.append(ids)
        # Ids lie in the order alone, together; back to that of the units.
        order = np.concatenate([alone, together])
        begin = np.empty(len(words), np.int64)
        begin[order] = np.cumsum(many[order]) - many[order]
        at = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return np.concatenate(found)[at] if found else np.zeros(0, np.uint32), many


@lru_cache(maxsize=2)
def byte_tokens(path, end_id):
    """One `ByteTokens` per worker process, kept from task to task."""
    return ByteTokens(path, end_id)
