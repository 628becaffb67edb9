"""License scans by template markup: token automata accept texts whose mandatory wording matches exactly.

A template is words with markup: ``[...]`` is an optional region, ``{n}`` stands for one to n words of any
kind, ``(a|b)`` for one of several wordings. Each template is compiled once into an automaton over words; it runs
from every place of its first word in texts that hold its rarest word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch, documents, utf8

# The base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Label, a word that every match holds, wording.
TEMPLATES = (
    ("apache-2.0", "apache", "licensed under the apache license [version] 2 0"),
    ("cc-by-nc-4.0", "nc", "licensed under [a] [the] (cc|creative commons) (by|attribution) (nc|noncommercial) 4 0 [international] [license]"),
    ("gpl-3.0", "gnu", "licensed under the gnu general public license [as published by the free software foundation] [either] version 3 [of the license] [or at your option any later version]"),
    ("mit-notice", "mit", "(released|licensed|distributed) under the [terms of the] mit license"),
    ("mit-text", "sublicense", "permission is hereby granted free of charge to any person obtaining a copy of this {8} and associated documentation files [the {4}] "
     "to deal in the {4} without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "fee", "permission to use copy modify and [or] distribute this {4} for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
)

#: Every ASCII byte that belongs to no word, after A-Z became a-z.
SPACES = bytes(c if chr(c).isdigit() or "a" <= chr(c) <= "z" or c > 127 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(SPACES).split()


@dataclass
class Automaton:
    """States are numbers; ``on[s]`` maps a word to following states, ``any[s]`` follows on any word,
    ``free[s]`` on none."""

    label: str
    rare: bytes
    on: list[dict[bytes, list[int]]] = field(default_factory=list)
    any: list[list[int]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    end: int = 0

    def state(self) -> int:
        self.on.append({})
        self.any.append([])
        self.free.append([])
        return len(self.on) - 1

    def reach(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def match(self, words: list[bytes], at: int) -> int | None:
        """Where the longest match that starts at a word ends, or None."""
        now, best = self.reach({0}), None
        for i in range(at, len(words)):
            after: set[int] = set()
            for s in now:
                after.update(self.on[s].get(words[i], ()))
                after.update(self.any[s])
            if not after:
                break
            now = self.reach(after)
            if self.end in now:
                best = i + 1
        return best

    def first_words(self) -> set[bytes]:
        return {w for s in self.reach({0}) for w in self.on[s]}


def compile_template(label: str, rare: str, template: str) -> Automaton:
    """The automaton of one template. Regions may be nested."""
    parts = re.findall(r"\{\d+\}|[\[\]()|]|[^\s\[\](){}|]+", template)
    a = Automaton(label, rare.encode())
    start = a.state()

    def sequence(i: int, s: int) -> tuple[int, int]:
        while i < len(parts) and parts[i] not in ("]", ")", "|"):
            p = parts[i]
            if p == "[":
                i, e = sequence(i + 1, s)
                i, out = i + 1, a.state()
                a.free[s].append(out)
                a.free[e].append(out)
                s = out
            elif p == "(":
                out, begin = a.state(), s
                while parts[i] in ("(", "|"):
                    branch = a.state()
                    a.free[begin].append(branch)
                    i, e = sequence(i + 1, branch)
                    a.free[e].append(out)
                i, s = i + 1, out
            elif p[0] == "{":
                out = a.state()
                for _ in range(int(p[1:-1])):
                    n = a.state()
                    a.any[s].append(n)
                    a.free[n].append(out)
                    s = n
                i, s = i + 1, out
            else:
                n = a.state()
                a.on[s].setdefault(p.encode(), []).append(n)
                i, s = i + 1, n
        return i, s
    _, a.end = sequence(0, start)
    return a


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) wherever a base phrase's words stand one after another."""
    found = []
    for phrase, label in PHRASES:
        own = phrase.encode().split()
        i = -1
        while True:
            try:
                i = words.index(own[0], i + 1)
            except ValueError:
                break
            if words[i:i + len(own)] == own:
                found.append((i, label))
    return sorted(found)


def template_places(words: list[bytes], automata: list[Automaton]) -> list[tuple[int, int, str]]:
    """(first word, end, label) of the matches of all templates, each the longest from its place."""
    present, found = set(words), []
    for a in automata:
        if a.rare not in present:
            continue
        for first in a.first_words() & present:
            i = -1
            while True:
                try:
                    i = words.index(first, i + 1)
                except ValueError:
                    break
                end = a.match(words, i)
                if end is not None:
                    found.append((i, end, a.label))
    return sorted(found)


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, places array<struct<first:long,end:long,label:string>>")


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``
    and ``places``, the template matches in words.

    ``score`` is 1 if a template's mandatory wording is there, 0.5 for a base phrase alone, else 0. Null and
    empty texts have no words, no labels ('') and null places of words; repeated rows and null ids stay.
    """
    def build():
        automata = [compile_template(*t) for t in templates]
        rare = [a.rare for a in automata]

        def run(batch):
            rows = []
            for text in utf8(batch):
                low = text.lower().translate(SPACES)
                words = low.split()
                base = base_places(words) if b"license" in low else []
                places = template_places(words, automata) if any(r in low for r in rare) else []
                own = sorted({x for _, x in base})
                every = sorted({*own, *(x for _, _, x in places)})
                rows.append((len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                             ",".join(own), ",".join(every), 1.0 if places else 0.5 if base else 0.0,
                             [{"first": f, "end": e, "label": x} for f, e, x in places]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct(
                [("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))]
            return pa.record_batch([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))],
                                   ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
                                    "score", "places"])
        return run
    return by_batch(documents(docs), build, SCHEMA)
