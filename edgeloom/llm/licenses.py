"""Licences in texts: templates with optional and replaceable regions as token automata, and phrases that name a licence.

A text is lower-cased (A-Z only) and cut into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Each template (see
license_templates.py) becomes an automaton over words: a mandatory word is one edge, an optional region can be passed by,
a replaceable one is a chain of edges for any word, or one path for each of its wordings. From each word that can begin a
template its automaton runs until no state is left; the longest stretch that ends in the accepting state is a match, so
the mandatory wording is there exactly, in order, with nothing else between. Matches of one template do not overlap, the
leftmost counts. A template's length and states are fixed, so the time grows with the length of the text.

`score` is the share of a text's words that lie in a match or a base phrase: 1 for a text that is a licence, little for
one that names it.

Every text is read whole, in the task that scans it; nothing is shuffled. Edge cases: a null, empty or wordless text has
no words, no labels and score 0; rows that repeat are rows of their own; a null doc_id is kept; an empty table gives an
empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .license_templates import TEMPLATES
from .store import id_text, small_batches

#: Words of base phrases, with their labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MARKUP = re.compile(r"\[\[|\]\]|<<(.*?)>>", re.S)
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER))


class Automaton:
    """Edges of each state by word (or None, any word), with free moves taken in advance; state 0 begins."""

    def __init__(self, label: str, template: str):
        self.label = label
        self._edges: list[list[tuple[str | None, int]]] = [[]]
        self._free: list[list[int]] = [[]]
        at, opened, done = 0, [], 0
        for mark in [*MARKUP.finditer(template), None]:
            at = self._path(at, words_of(template[done : mark.start() if mark else len(template)]))
            if mark is None:
                break
            done = mark.end()
            if mark[0] == "[[":
                opened.append(at)
            elif mark[0] == "]]":
                if not opened:
                    raise ValueError(f"{label}: an optional region ends that does not begin")
                end = self._state()
                self._free[at].append(end)
                self._free[opened.pop()].append(end)
                at = end
            else:
                at = self._region(at, mark[1])
        if opened:
            raise ValueError(f"{label}: an optional region does not end")
        closed = [self._reached(k) for k in range(len(self._edges))]
        self.last = at
        self.steps = [{w: frozenset().union(*(closed[t] for s in reach for v, t in self._edges[s] if v == w or v is None)) for w in {v for s in reach for v, _ in self._edges[s]}} for reach in closed]
        self.first = set(self.steps[0])
        if None in self.first or at in closed[0]:
            raise ValueError(f"{label}: a template begins with a mandatory word")

    def _state(self) -> int:
        self._edges.append([])
        self._free.append([])
        return len(self._edges) - 1

    def _path(self, at: int, words: Iterable[str | None]) -> int:
        for w in words:
            new = self._state()
            self._edges[at].append((w, new))
            at = new
        return at

    def _region(self, at: int, content: str) -> int:
        end = self._state()
        if content.isdigit():
            for _ in range(int(content)):
                self._free[at].append(end)
                at = self._path(at, [None])
            self._free[at].append(end)
        else:
            for wording in content.split("|"):
                self._free[self._path(at, words_of(wording))].append(end)
        return end

    def _reached(self, state: int) -> set[int]:
        seen, todo = {state}, [state]
        while todo:
            new = [t for t in self._free[todo.pop()] if t not in seen]
            seen.update(new)
            todo += new
        return seen

    def longest(self, words: list[str], start: int) -> int:
        """Where the longest match from `start` ends; `start` if there is none."""
        states, end = {0}, start
        for k in range(start, len(words)):
            states = set().union(*(self.steps[s].get(words[k]) or self.steps[s].get(None, ()) for s in states))
            if not states:
                break
            if self.last in states:
                end = k + 1
        return end


@cache
def compiled(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[Automaton, ...]:
    return tuple(Automaton(*t) for t in templates)


@cache
def _beginnings(templates: tuple[tuple[str, str], ...]) -> tuple[dict[str, list[Automaton]], set[str]]:
    """The automata by the words that they begin with, and all words that a template or a base phrase begins with."""
    by: dict[str, list[Automaton]] = {}
    for a in compiled(templates):
        for w in a.first:
            by.setdefault(w, []).append(a)
    return by, by.keys() | {p[0] for p in PHRASES}


def scan(text: str, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[int, list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The number of words, and (label, start, end) in words of the base phrases and of the templates' matches."""
    by, first = _beginnings(templates)
    words, base, matches, done = words_of(text), [], [], {}
    for k in [k for k, w in enumerate(words) if w in first]:
        base += [(label, k, k + len(p)) for p, label in PHRASES.items() if tuple(words[k : k + len(p)]) == p]
        for a in by.get(words[k], ()):
            if k >= done.get(a, 0) and (end := a.longest(words, k)) > k:
                done[a] = end
                matches.append((a.label, k, end))
    return len(words), base, matches


def covered(spans: Iterable[tuple[str, int, int]]) -> int:
    """The words in at least one span."""
    total = at = 0
    for _, a, b in sorted(spans, key=lambda x: x[1:]):
        total += max(0, b - max(a, at))
        at = max(at, b)
    return total


_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SPAN = "struct<label: string, start: long, end: long>"


def found(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, base and matches (label, start, end in words), score."""
    compiled(templates)  # an error in a template is raised here, not in a task

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t.as_py(), templates) for t in batch.column(1)]
            spans = [pa.array([[dict(zip(("label", "start", "end"), s)) for s in r[k]] for r in rows], pa.list_(_SPAN)) for k in (1, 2)]
            score = pa.array([covered(r[1] + r[2]) / r[0] if r[0] else 0.0 for r in rows], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), *spans, score], ["doc_id", "n_words", "base", "matches", "score"])

    small_batches(docs.sparkSession)
    return id_text(docs).mapInArrow(scanned, f"doc_id long, n_words long, base array<{SPAN}>, matches array<{SPAN}>, score double")
