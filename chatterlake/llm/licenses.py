"""License scans: template markup compiled to automata over words.

A template is a line of words with `<<optional>> … <</optional>>` regions, which may be
left out, and `<<words name min max>>` regions, which stand for any `min` to `max` words.
All other wording is mandatory and has to match word by word. A text is accepted by a
template if some run of its words is. Each template becomes one automaton; a text is
tried only where a word stands that can open one. One pass, no shuffle.
"""

import re

from .common import LOWER, arrow_schema, column_of, record, small_batches

# Phrases that count as license wording by themselves.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# License texts, headers and notices with their labels.
TEMPLATES = {
    "agpl-header": "free software you can redistribute it and or modify it under the terms of the gnu affero general public license "
                   "<<optional>>version <<words version 1 2>><</optional>> as published by the free software foundation",
    "apache": "licensed under the apache license <<optional>>version <<words version 1 3>><</optional>>",
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
                     "you may obtain a copy of the license at <<words address 1 10>> unless required by applicable law or agreed to in writing "
                     "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
                     "either express or implied see the license for the specific language governing permissions and limitations under the license",
    "as-is": "software is provided as is",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-2-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
                    "<<words bullet 0 1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
                    "<<words bullet 0 1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
                    "in the documentation and or other materials provided with the distribution",
    "bsd-3-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
                    "<<words bullet 0 1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
                    "<<words bullet 0 1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
                    "in the documentation and or other materials provided with the distribution "
                    "<<words bullet 0 1>> neither the name of <<words holder 1 12>> may be used to endorse or promote products derived from this software "
                    "without specific prior written permission",
    "bsd-warranty": "software is provided by <<words holder 1 12>> as is and any express or implied warranties including but not limited to "
                    "the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "cc-by-nc": "licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> cc by nc <<words version 0 2>>",
    "cc-by-sa": "licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> cc by sa <<words version 0 2>>",
    "copyright": "copyright <<optional>>c<</optional>> <<words holder 1 8>> all rights reserved",
    "gnu-gpl": "licensed under the <<optional>>terms of the<</optional>> gnu general public license "
               "<<optional>>as published by the free software foundation<</optional>> <<optional>>version <<words version 1 1>><</optional>>",
    "gpl-header": "free software you can redistribute it and or modify it under the terms of the gnu general public license "
                  "<<optional>>version <<words version 1 2>><</optional>> as published by the free software foundation",
    "isc": "permission to use copy modify and <<optional>>or<</optional>> distribute this software for any purpose with or without fee is hereby granted "
           "provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl-header": "free software you can redistribute it and or modify it under the terms of the gnu lesser general public license "
                   "<<optional>>version <<words version 1 2>><</optional>> as published by the free software foundation",
    "lgpl-2-header": "free software you can redistribute it and or modify it under the terms of the gnu library general public license "
                     "<<optional>>version <<words version 1 2>><</optional>> as published by the free software foundation",
    "mit": "<<optional>>released<</optional>> under the <<optional>>terms of the<</optional>> mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
                "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
                "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
                "the above copyright notice and this permission notice <<optional>>including the next paragraph<</optional>> "
                "shall be included in all copies or substantial portions of the software",
    "mit-warranty": "software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
                    "fitness for a particular purpose and noninfringement",
    "mpl-header": "source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
                  "you can obtain one at <<words protocol 0 1>> <<optional>>www<</optional>> mozilla org mpl 2 0",
    "spdx": "spdx license identifier <<words expression 1 3>>",
}

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"(<<optional>>|<</optional>>|<<words \w+ \d+ \d+>>)")
ANY = None
_COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_TO_SPACE = bytes(LOWER[b] if _WORD.match(bytes([LOWER[b]])) else 32 for b in range(256))


def words_of(text):
    """Lower-cased words of letters, digits and non-ASCII characters, as bytes."""
    return (text or "").encode().translate(_TO_SPACE).split()


class Automaton:
    """States 0 … end over words: `steps[s]` maps a word to states, `free[s]` are states reached by any word."""

    def __init__(self, markup):
        self.steps, self.free, self.skips = [{}], [set()], [set()]
        state, opened = 0, []
        for part in _MARK.split(markup):
            if part == "<<optional>>":
                opened.append(state)
            elif part == "<</optional>>":
                self.skips[opened.pop()].add(state)
            elif part.startswith("<<words"):
                least, most = map(int, part[2:-2].split()[2:])
                ways = [state]
                for _ in range(most):
                    ways.append(self._new())
                    self.free[ways[-2]].add(ways[-1])
                state = ways[-1]
                for early in ways[least:-1]:
                    self.skips[early].add(state)
            else:
                for word in words_of(part):
                    after = self._new()
                    self.steps[state].setdefault(word, set()).add(after)
                    state = after
        self.end = state

    def _new(self):
        self.steps.append({})
        self.free.append(set())
        self.skips.append(set())
        return len(self.steps) - 1

    def close(self, states):
        """All states reachable without reading a word."""
        todo, found = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()] - found:
                found.add(s)
                todo.append(s)
        return found

    def openers(self):
        """Words that can come first; templates do not open with a free word."""
        first = self.close({0})
        if any(self.free[s] for s in first):
            raise ValueError("A template must open with fixed words")
        return {w for s in first for w in self.steps[s]}

    def match(self, words, at):
        """End of the shortest accepted run that starts at word `at`, or None."""
        states = self.close({0})
        while self.end not in states:
            if at == len(words) or not states:
                return None
            word = words[at]
            states = self.close({t for s in states for t in (*self.steps[s].get(word, ()), *self.free[s])})
            at += 1
        return at


def compile_templates(templates, phrases):
    """Opening word -> automata and phrases to try there."""
    table = {}
    for label, markup in templates.items():
        automaton = Automaton(markup)
        for word in automaton.openers():
            table.setdefault(word, ([], []))[0].append((label, automaton))
    for phrase, label in phrases.items():
        words = words_of(phrase)
        table.setdefault(words[0], ([], []))[1].append((label, words))
    return table


def scan(words, table):
    """Base places [(start, label)] and accepted spans [(start, end, label)] of one text."""
    base, spans = [], []
    for at, word in enumerate(words):
        if word in table:
            automata, phrases = table[word]
            base.extend((at, label) for label, phrase in phrases if words[at : at + len(phrase)] == phrase)
            spans.extend((at, end, label) for label, a in automata if (end := a.match(words, at)) is not None)
    return base, spans


def license_scan(docs, id_col="doc_id", text_col="text", templates=None, phrases=None):
    """Phrases and accepted license templates of every row.

    `score` is 1 if a template accepts some run of words, 0.5 if only a base phrase stands
    there, else 0. `spans` lists accepted runs as `label:start-end` in words. A missing or
    empty text has no words, no labels (empty text) and score 0. Repeated rows are scanned
    each; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    columns = _COLUMNS + ", spans array<string>"
    schema = arrow_schema(columns)
    table = compile_templates(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)

    def run(batches):
        for batch in batches:
            out = {name: [] for name in schema.names}
            for text in column_of(batch, text_col):
                words = words_of(text.as_py())
                base, spans = scan(words, table)
                places, own = [b[0] for b in base], {b[1] for b in base}
                out["n_words"].append(len(words))
                out["n_base"].append(len(base))
                out["first_word"].append(min(places, default=None))
                out["last_word"].append(max(places, default=None))
                out["base_labels"].append(",".join(sorted(own)))
                out["labels"].append(",".join(sorted(own | {s[2] for s in spans})))
                out["score"].append(1.0 if spans else 0.5 if base else 0.0)
                out["spans"].append([f"{label}:{a}-{b}" for a, b, label in spans])
            rows = record(schema, **out)
            yield type(rows).from_arrays([column_of(batch, id_col), *rows.columns], names=[id_col, *schema.names])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {columns}")
