"""An index of the vocabulary: which terms a record may support, and which words its entries contain.

All terms are looked up at once, by one automaton over each text, so the cost follows the texts and the hits and not the
number of terms. Names that lie within a term are looked up the other way round and remembered per task. The index tells
which terms have a trace in a record and at which places; the evidence expressions judge it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import accumulate, chain
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names whose terms a task remembers.
REMEMBERED = 200_000
#: Characters of a name that is remembered with the terms it contains.
SHORT = 64
#: Records that are Python objects at a time, however many a batch has.
_ROWS = 256
#: The texts of a prepared record in which a term leaves a trace, in the order of the marks.
TEXTS = ("career_lc", "summary_lc", "headline_lc", "title_lc")
#: Marks of a term by the place of its trace. A mark shifted by ``UNKNOWN`` says that this cannot be told: the place is missing.
IN_CAREER, IN_SUMMARY, IN_HEADLINE, IN_TITLE, IN_CERTIFICATIONS, WITHIN = (1 << i for i in range(6))
UNKNOWN = 8


class Lookup:
    """Terms by the texts that contain them. Repeated terms are found under each of their places."""

    def __init__(self, terms: Sequence[str]):
        self.terms = list(terms)
        self.always = [i for i, t in enumerate(self.terms) if not t]
        places: dict[str, list[int]] = {}
        for i, t in enumerate(self.terms):
            places.setdefault(t, []).append(i)
        places.pop("", None)
        self.automaton = ahocorasick.Automaton()
        for term, found in places.items():
            self.automaton.add_word(term, tuple(found))
        if places:
            self.automaton.make_automaton()
        self.filled = bool(places)
        self._joined = "\n".join(self.terms)
        self._starts = list(accumulate((len(t) + 1 for t in self.terms), initial=0))[:-1]
        self._within: dict[str, list[int]] = {}
        self._inside: dict[str, tuple[int, ...]] = {}

    def in_text(self, text: str | None) -> set[int]:
        """Places of the terms that the text contains."""
        out = set(self.always) if text is not None else set()
        if text and self.filled:
            for found in {v for _, v in self.automaton.iter(text)}:
                out.update(found)
        return out

    def in_name(self, name: str | None) -> Iterable[int]:
        """``in_text`` for short texts that many records share; they are remembered."""
        if name is None or len(name) > SHORT:
            return self.in_text(name)
        known = self._inside.get(name)
        if known is None:
            if len(self._inside) >= REMEMBERED:
                self._inside.clear()
            known = self._inside[name] = tuple(self.in_text(name))
        return known

    def around(self, name: str | None) -> list[int]:
        """Places of the terms that contain the name."""
        if name is None:
            return []
        known = self._within.get(name)
        if known is None:
            if len(self._within) >= REMEMBERED:
                self._within.clear()
            known = self._within[name] = self._search(name)
        return known

    def _search(self, name: str) -> list[int]:
        if not name:
            return list(range(len(self.terms)))
        if "\n" in name:
            return [i for i, t in enumerate(self.terms) if name in t]
        out, at = [], self._joined.find(name)
        while at >= 0:
            term = bisect_right(self._starts, at) - 1
            out.append(term)
            if term + 1 == len(self._starts):
                break
            at = self._joined.find(name, self._starts[term + 1])
        return out


def _places(by_term: Lookup, names: Sequence[str | None] | None) -> dict[int, list[int]]:
    """Per term, the ascending places of the texts of a list that contain it."""
    out: dict[int, list[int]] = {}
    for place, name in enumerate(names or ()):
        for term in by_term.in_name(name):
            out.setdefault(term, []).append(place)
    return out


def _traces(by_term: Lookup, row: Mapping[str, Any]) -> list[tuple[int, int, int | None, Sequence[int], Sequence[int]]]:
    """Of every term with a trace in the record: id, marks, place of the first skill, places of the tests and of the jobs."""
    marks: dict[int, int] = {}
    missing = 0
    for bit, name in zip((IN_CAREER, IN_SUMMARY, IN_HEADLINE, IN_TITLE), TEXTS, strict=True):
        if row[name] is None:
            missing |= bit << UNKNOWN
        for term in by_term.in_text(row[name]):
            marks[term] = marks.get(term, 0) | bit
    for bit, name, find in ((IN_CERTIFICATIONS, "certs_lc", by_term.in_name), (WITHIN, "skills", by_term.around)):
        texts = row[name]
        if texts is None or None in texts:
            missing |= bit << UNKNOWN
        for text in set(texts or ()):
            for term in find(text):
                marks[term] = marks.get(term, 0) | bit
    skills, tests, jobs = (_places(by_term, row[name]) for name in ("skills", "tests", "descriptions_lc"))
    out = []
    for term in sorted(marks.keys() | skills.keys() | tests.keys()):
        mine = marks.get(term, 0)
        out.append((term, mine | missing & ~(mine << UNKNOWN), skills[term][0] if term in skills else None, tests.get(term, ()),
                    jobs.get(term, ()) if mine & IN_CAREER else ()))
    return out


_TRACE = pa.struct([("id", pa.int32()), ("marks", pa.int32()), ("skill", pa.int32()), ("tested", pa.list_(pa.int32())),
                    ("jobs", pa.list_(pa.int32()))])


def _trace_lists(rows: Sequence[Sequence[tuple]]) -> pa.ListArray:
    flat = list(zip(*chain.from_iterable(rows), strict=True)) or [()] * len(_TRACE)
    inner = pa.StructArray.from_arrays([pa.array(values, field.type) for values, field in zip(flat, _TRACE, strict=True)],
                                       fields=list(_TRACE))
    return pa.ListArray.from_arrays(pa.array(accumulate((len(r) for r in rows), initial=0), pa.int32()), inner)


def lookups(terms: Sequence[str], words: Sequence[str]) -> Column:
    """Struct ``traces`` (the terms with a trace, by ascending id, and where it is) and ``entries`` (per career entry, the mask of
    the words it contains, as longs of 64 words each; NULL without a list of entries). Reads the columns of ``features.prepare``."""
    chunks = max(1, -(-len(words) // 64))
    terms, words = list(terms), list(words)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        by_term, by_word = Lookup(terms), Lookup(words)
        nothing = (0,) * chunks

        def mask(text: str | None) -> tuple[int, ...]:
            found = by_word.in_text(text)
            if not found:
                return nothing
            bits = [0] * chunks
            for i in found:
                bits[i >> 6] |= 1 << (i & 63)
            return tuple(np.array(bits, dtype=np.uint64).view(np.int64).tolist())

        def part(batch: pa.StructArray) -> pa.StructArray:
            column = {name: values.to_pylist() for name, values in zip(batch.type.names, batch.flatten(), strict=True)}
            rows = (dict(zip(column, values, strict=True)) for values in zip(*column.values(), strict=True))
            traces = _trace_lists([_traces(by_term, row) for row in rows])
            entries = [None if texts is None else [mask(t) for t in texts] for texts in column["entries_lc"]]
            return pa.StructArray.from_arrays([traces, pa.array(entries, pa.list_(pa.list_(pa.int64())))], names=["traces", "entries"])

        for batch in batches:
            yield pa.concat_arrays([part(batch.slice(at, _ROWS)) for at in range(0, max(1, len(batch)), _ROWS)])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = F.arrow_udf(run, "traces array<struct<id int, marks int, skill int, tested array<int>, jobs array<int>>>, "
                             "entries array<array<bigint>>")
    names = lambda facts: F.transform(facts, lambda x: x["name_lc"])
    return found(F.struct(*TEXTS, "certs_lc", "descriptions_lc", "entries_lc", names("skill_facts").alias("skills"),
                          names("assessments").alias("tests")))
