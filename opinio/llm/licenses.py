"""Licence scans by template markup.

A template is a licence's wording with marked regions: optional ones, which a text may
leave out, and replaceable ones, where a text has one of some wordings or any few words.
Each template is compiled to an automaton over words. A text holds the licence where the
automaton accepts: every mandatory word is there, in order, with nothing between but what
the regions allow.

The automata run over all places of a text at once. Threads in one state have the same
future but for the words that a free region may still take, so a state keeps one thread,
the one with most left: time is linear in the text, whatever it repeats.

Markup::

    <<optional>> ... <</optional>>      may be missing; may hold further regions
    <<var;match="(a b|c)">>             one of these wordings
    <<var;match=".{0,20}">>             any 0 to 20 words
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import query, table

# Phrases that name a licence, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# The wording of notices and licences, as published, with marked regions.
TEMPLATES = {
    "apache-2.0": 'licensed under <<optional>>the<</optional>> apache license <<optional>>version<</optional>> 2 0',
    "apache-2.0-notice": """licensed under the apache license version 2 0 the license
        you may not use this file except in compliance with the license
        you may obtain a copy of the license at <<var;match=".{0,12}">>
        unless required by applicable law or agreed to in writing software distributed under the license
        is distributed on an as is basis without warranties or conditions of any kind either express or implied""",
    "bsd": """redistribution and use in source and binary forms with or without modification are permitted
        provided that the following conditions are met
        <<optional>><<var;match="(1|a)">><</optional>> redistributions of source code must retain the above copyright notice
        this list of conditions and the following disclaimer
        <<optional>><<var;match="(2|b)">><</optional>> redistributions in binary form must reproduce the above copyright notice
        this list of conditions and the following disclaimer in the documentation and or other materials
        provided with the distribution
        <<optional>><<var;match="(3|c)">> neither the name of <<var;match=".{1,20}">> may be used to endorse or promote
        products derived from this software without specific prior written permission<</optional>>
        this software is provided by <<var;match=".{1,20}">> as is and any express or implied warranties""",
    "gpl-2.0": """<<var;match="(licensed|released|distributed)">> under the <<optional>>terms of the<</optional>> <<optional>>gnu<</optional>>
        general public license <<var;match="(version 2|v2|2)">> <<optional>>0<</optional>>""",
    "gpl-3.0": """<<var;match="(licensed|released|distributed)">> under the <<optional>>terms of the<</optional>> <<optional>>gnu<</optional>>
        general public license <<var;match="(version 3|v3|3)">> <<optional>>0<</optional>>""",
    "gpl-notice": """this program is free software you can redistribute it and or modify it under the terms of the
        gnu general public license as published by the free software foundation either version <<var;match="(1|2|3)">>
        of the license or at your option any later version""",
    "isc": """permission to use copy modify and or distribute this software for any purpose with or without fee
        is hereby granted provided that the above copyright notice and this permission notice appear in all copies
        <<optional>>the software is provided as is and <<var;match=".{1,12}">> disclaims all warranties<</optional>>""",
    "mit": '<<var;match="(licensed|released|distributed)">> under the <<optional>>terms of the<</optional>> mit license',
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of
        <<var;match="(this software|the software)">> and associated documentation files the software to deal in
        the software without restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the software is
        furnished to do so subject to the following conditions the above copyright notice and this permission notice
        <<optional>>including the next paragraph<</optional>> shall be included in all copies or substantial portions
        of the software""",
    "mpl-2.0": """this source code form is subject to the terms of the mozilla public license v 2 0
        if a copy of the mpl was not distributed with this file you can obtain one at <<var;match=".{1,8}">>""",
    "unlicense": """this is free and unencumbered software released into the public domain""",
    **{
        f"cc-{kind}-{major}.0": f"""<<var;match="(licensed|released|distributed)">> under <<var;match="(a|the|)">>
            <<var;match="(cc|creative commons)">> {kind.replace("-", " ")} {major} 0"""
        for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
        for major in (3, 4)
    },
}

#: What is no word: ASCII other than digits and a-z becomes a blank, A-Z become a-z.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

MARK = re.compile(r'<<(/?optional|var;match="(?:\.\{(\d+),(\d+)\}|\(([^()]*)\))")>>')


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


@dataclass
class Automaton:
    """Nodes with edges by one word, by any word and free ones, and regions of any words."""

    words: list[dict[bytes, list[int]]] = field(default_factory=list)
    any_word: list[list[int]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    #: Node -> words that a thread may skip while it stays there.
    region: dict[int, int] = field(default_factory=dict)
    accept: int = -1

    def node(self) -> int:
        self.words.append({})
        self.any_word.append([])
        self.free.append([])
        return len(self.words) - 1

    def sequence(self, at: int, words: list[bytes]) -> int:
        for word in words:
            after = self.node()
            self.words[at].setdefault(word, []).append(after)
            at = after
        return at

    def closure(self, node: int) -> list[int]:
        """``node`` and all that free edges reach from it."""
        seen, queue = [node], [node]
        while queue:
            for after in self.free[queue.pop()]:
                if after not in seen:
                    seen.append(after)
                    queue.append(after)
        return seen

    def _open(self, nodes: list[int]) -> bool:
        return any(n == self.accept or n in self.region or self.any_word[n] for n in nodes)

    def openings(self) -> set[bytes]:
        """The first two words of what is accepted, or the first alone where any may follow."""
        out = set()
        start = self.closure(0)
        if self._open(start):
            raise ValueError("a template begins with a word of its own")
        for node in start:
            for first, afters in self.words[node].items():
                for reached in map(self.closure, afters):
                    if self._open(reached):
                        out.add(first)
                    out.update(first + b" " + second for n in reached for second in self.words[n])
        return out

    def matches(self, words: list[bytes], seeds: list[int]) -> dict[int, int]:
        """Start -> longest end of what is accepted, for threads that begin at ``seeds``.

        Where several starts reach one end, the latest of those that their states keep.
        """
        reach = [[(n, self.region.get(n, 0)) for n in self.closure(node)] for node in range(len(self.words))]
        found: dict[int, int] = {}
        threads: dict[int, tuple[int, int]] = {}
        ahead = iter([*seeds, len(words)])
        seed = next(ahead)
        i = seed
        while i < len(words):
            if i == seed:
                for n, left in reach[0]:
                    threads[n] = max(threads.get(n, (-1, -1)), (left, i))
                seed = next(ahead)
            word, after = words[i], {}
            for node, (left, start) in threads.items():
                steps = self.words[node].get(word, ())
                for to in (*steps, *self.any_word[node]):
                    for n, budget in reach[to]:
                        after[n] = max(after.get(n, (-1, -1)), (budget, start))
                if left > 0:
                    for n, budget in reach[node]:
                        after[n] = max(after.get(n, (-1, -1)), (left - 1 if n == node else budget, start))
            threads = after
            i += 1
            if self.accept in threads:
                found[threads[self.accept][1]] = i
            if not threads:
                i = max(i, seed)
        return found


def _parts(markup: str):
    """Words and marks of a template in order."""
    end = 0
    for mark in MARK.finditer(markup):
        yield words_of(markup[end : mark.start()]), mark.groups()
        end = mark.end()
    yield words_of(markup[end:]), None


def compile_template(markup: str) -> Automaton:
    """The automaton of a template; its wording is taken apart like a text."""
    made = Automaton()
    at, optional = made.node(), []
    for words, mark in _parts(markup):
        at = made.sequence(at, words)
        if mark is None:
            break
        kind, least, most, choices = mark
        after = made.node()
        if kind == "optional":
            optional.append(at)
            made.free[at].append(after)
        elif kind == "/optional":
            if not optional:
                raise ValueError(f"closes an optional region that is not open: {markup!r}")
            made.free[optional.pop()].append(after)
            made.free[at].append(after)
        elif choices is not None:
            for choice in choices.split("|"):
                made.free[made.sequence(at, words_of(choice))].append(after)
        else:
            for _ in range(int(least)):
                one = made.node()
                made.any_word[at].append(one)
                at = one
            region = made.node()
            made.region[region] = int(most) - int(least)
            made.free[at].append(region)
            made.free[region].append(after)
        at = after
    if optional:
        raise ValueError(f"an optional region is not closed: {markup!r}")
    made.accept = at
    return made


def _places(line: bytes, blanks: np.ndarray, phrase: bytes) -> list[int]:
    """Words of ``line`` at which a phrase begins, overlaps included."""
    sought, out = b" " + phrase + b" ", []
    at = line.find(sought)
    while at >= 0:
        out.append(int(np.searchsorted(blanks, at)))
        at = line.find(sought, at + 1)
    return out


class Scanner:
    """All templates and phrases over one text at a time."""

    def __init__(self, templates: Mapping[str, str], phrases: Mapping[str, str]):
        self.automata = {label: compile_template(markup) for label, markup in templates.items()}
        self.begins = {label: made.openings() for label, made in self.automata.items()}
        self.openings = sorted(set().union(*self.begins.values()))
        self.phrases = [(b" ".join(words_of(p)), label) for p, label in phrases.items()]

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, bool, int, int]]]:
        """Number of words, and ``(label, base, start, end)`` of each place found."""
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        sought = [*self.openings, *(p for p, _ in self.phrases)]
        met = [p for p in sought if b" " + p + b" " in line]
        if not met:
            return len(words), []
        blanks = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
        at = {p: _places(line, blanks, p) for p in met}
        out = [
            (label, True, i, i + phrase.count(b" ") + 1) for phrase, label in self.phrases for i in at.get(phrase, ())
        ]
        for label, made in self.automata.items():
            seeds = sorted({i for p in self.begins[label] for i in at.get(p, ())})
            if seeds:
                out.extend((label, False, a, b) for a, b in made.matches(words, seeds).items())
        return len(words), out


PLACES = "array<struct<label:string,base:boolean,start:bigint,end:bigint>>"


def scan(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES
) -> DataFrame:
    """``(doc_id, n_words, places)`` per row of ``docs`` (``doc_id``, ``text``).

    ``places`` holds ``(label, base, start, end)``: where a phrase stands (``base``) and where a
    template is accepted, in words from 0, ends exclusive. Of a template's places that
    begin at one word the longest is given.

    A-Z count as a-z; a word is a run of digits, letters a-z and anything beyond ASCII. A
    null or empty text has no words. Rows keep their ids, null or repeated; other columns
    are not looked at; an empty table gives no rows.
    """
    places = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column(1)]
            rows = [[dict(zip(("label", "base", "start", "end"), p)) for p in ps] for _, ps in found]
            columns = [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array(rows, pa.list_(places))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "places"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, places {PLACES}")


def _labels(places: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")


def summary(scanned: DataFrame) -> DataFrame:
    """One line per row of :func:`scan`: counts, first and last phrase, labels and a score.

    The score is 1 where a template is accepted, one half where a phrase alone names a
    licence, else 0.
    """
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    accepted = F.exists("places", lambda p: ~p["base"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _labels(base).alias("base_labels"),
        _labels(F.col("places")).alias("labels"),
        F.when(accepted, 1.0).when(F.size("places") > 0, 0.5).otherwise(0.0).alias("score"),
    )


def pattern_of(markup: str) -> str:
    """A template as a regular expression over words that each end in a blank."""
    out = ""
    spelled = lambda words: "".join(w.decode() + " " for w in words)
    for words, mark in _parts(markup):
        out += spelled(words)
        if mark is None:
            break
        kind, least, most, choices = mark
        if kind == "optional":
            out += "(?:"
        elif kind == "/optional":
            out += ")?"
        elif choices is not None:
            out += "(?:" + "|".join(spelled(words_of(c)) for c in choices.split("|")) + ")"
        else:
            out += f"(?:[^ ]+ ){{{least},{most}}}"
    return out


def sql_twin(templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES) -> str:
    """The same result in SQL, templates as regular expressions over the line of words."""
    found = ", ".join(f"case when regexp_matches(line, ' {pattern_of(t)}') then '{label}' end" for label, t in templates.items())
    at = " || ".join(
        f"list_transform(list_filter(range(len(w)), lambda i: w[i + 1 : i + {len(p.split())}] = {p.split()}), "
        f"lambda i: {{'at': i, 'label': '{label}'}})"
        for p, label in phrases.items()
    )
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    join = lambda c: f"array_to_string(list_sort(list_distinct({c})), ',')"
    return rf"""with taken as (
      select doc_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
    placed as (select doc_id, len(w) as n_words, {at} as base, ' ' || array_to_string(w, ' ') || ' ' as line from taken),
    named as (select *, list_transform(base, lambda b: b.label) as told, list_filter([{found}], lambda l: l is not null) as more from placed)
    select doc_id, n_words, cast(len(base) as bigint) as n_base, list_min(list_transform(base, lambda b: b.at)) as first_word,
      list_max(list_transform(base, lambda b: b.at)) as last_word, {join("told")} as base_labels,
      {join("told || more")} as labels, cast(case when len(more) > 0 then 1 when len(base) > 0 then 0.5 else 0 end as double) as score
    from named"""


@query("op12_licenses", sql_twin())
def op12_licenses(spark, sf_dir):
    return summary(scan(table(spark, sf_dir, "documents")))
