"""License scans by conditional compression.

The lines of a text are read as one run, comment marks stripped and words that a line end parts joined again. Around each
word that speaks of a license a part of the run is compressed alone and with each template as a raw zstandard dictionary,
which says what it saves; the words decide: a template's words must stand there in order, and the words that tell
versions apart must be the same. Every confirmed notice is found unless another one's match contains it. A candidate block
(a line, or of a very long line the parts around candidate words) that no confirmed notice touches gets its best guess.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import only, table

#: Notices by license name. Fixed wording.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
}
CANDIDATE = re.compile(r"(?i)licen[sc]|copyright|public domain|permission is hereby granted|redistribution and use")
#: Share of a template's words that must stand in the block in order, and templates that are tried for a best guess at most.
WORDS_KEPT, TRIES = 0.9, len(TEMPLATES)
#: What a text without any candidate, be it split over lines, does not have.
HINT = re.compile(r"(?i)lic|cop|pub|perm|redis|[a-z]-[^\S\n]*\r?\n")
#: Comment marks at the start and end of a line.
OPENS, CLOSES = re.compile(r"\s*(?:(?:/\*+|\*+/?|//[/!]*|#+|--+|;+|%+|<!--|>+|\|+|(?:dnl|rem|REM)\s)\s*)*"), re.compile(r"\s*(?:\*+/|-->|[*#|]+)?\s*$")
WORD = re.compile(r"[a-z0-9.]*[a-z0-9](?:-[a-z]+)*")
#: Characters of a line up to which it is one block; of a longer line, those kept on either side of each candidate word.
LONG, AROUND = 800, 300
SCHEMA = "doc_id bigint, line bigint, at bigint, license string, confirmed boolean, saved double, n_missing bigint, n_extra bigint"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def joined(text: str) -> tuple[str, list[int], list[tuple[int, int]]]:
    """The lines as one run, where each line begins in it, and (line, offset) of each of those beginnings."""
    out, starts, places, size, glue = [], [], [], 0, True
    for k, line in enumerate(text.split("\n")):
        a = OPENS.match(line).end()
        b = max(a, CLOSES.search(line, a).start())
        if a == b:
            continue
        part = line[a:b]
        if not glue and part[0].islower() and len(out[-1]) > 1 and out[-1][-1] == "-" and out[-1][-2].isalpha():
            # A word that the line end parts: its hyphen goes.
            out[-1], size = out[-1][:-1], size - 1
        elif not glue and not (out[-1][-1] == "-" and len(out[-1]) > 1 and out[-1][-2].isalnum()):
            out.append(" ")
            size += 1
        glue = False
        starts.append(size)
        places.append((k, a))
        out.append(part)
        size += len(part)
    return "".join(out), starts, places


def around(run: str) -> Iterator[tuple[int, int]]:
    """The parts of a run that hold AROUND characters on either side of each candidate word."""
    a = b = -1
    for m in CANDIDATE.finditer(run):
        # Words close together share a part as long as it stays within LONG.
        if b < 0 or m.end() + AROUND - a > LONG:
            if b >= 0:
                yield a, b
            a = max(0, m.start() - AROUND)
        b = min(len(run), m.end() + AROUND)
    if b >= 0:
        yield a, b


def blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """(line, offset in the line, block) of every candidate block of a text."""
    for k, line in enumerate(text.split("\n")):
        if len(line) <= LONG:
            if CANDIDATE.search(line):
                yield k, 0, line
            continue
        for a, b in around(line):
            yield k, a, line[a:b]


class Scanner:
    """Compressors and words of each template, made once a task."""

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.dicts = {n: zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for n, t in templates.items()}
        self.words = {n: words(t) for n, t in templates.items()}

    def best(self, block: str) -> tuple[str, bool, float, int, int]:
        """(license, confirmed, share of bytes saved, template words missing, block words beside it)."""
        raw = block.lower().encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(raw))
        ranked = sorted(((1 - len(c.compress(raw)) / alone, n) for n, c in self.dicts.items()), key=lambda x: (-x[0], x[1]))
        own = words(block)
        tries = [(gain, n, *self.differences(n, own)) for gain, n in ranked[:TRIES] if gain > 0]
        sure = [t for t in tries if t[4]]
        # Of confirmed templates the one with the fewest words left over, then the greater saving.
        gain, name, missing, extra, ok = min(sure, key=lambda t: (t[2] + t[3], -t[0], t[1])) if sure else (tries or [(ranked[0][0], ranked[0][1], *self.differences(ranked[0][1], own))])[0]
        return name, ok, float(gain), missing, extra

    def differences(self, name: str, own: list[str]) -> tuple[int, int, bool]:
        found = self.matched(name, own)
        want = self.words[name]
        return len(want) - sum(b.size for b in found), len(own) - sum(b.size for b in found), self.enough(want, found)

    def matched(self, name: str, own: list[str]) -> list:
        """The runs of words that a template and a block share in order; words far off the longest run are other text."""
        want = self.words[name]
        same = [b for b in SequenceMatcher(None, want, own, autojunk=False).get_matching_blocks() if b.size]
        if not same:
            return same
        top = max(same, key=lambda b: b.size)
        return [b for b in same if abs((b.b - b.a) - (top.b - top.a)) <= len(want) // 2 + 2]

    def enough(self, want: list[str], found: list) -> bool:
        kept = {i for b in found for i in range(b.a, b.a + b.size)}
        # A word with a digit, or a short license mark, tells licenses apart: none of them may be missing.
        exact = not any(re.search(r"\d", w) or "-" in w or w in ("mit", "apache", "lesser", "gnu", "mozilla", "cc", "by") for i, w in enumerate(want) if i not in kept)
        return exact and len(kept) >= WORDS_KEPT * len(want)

    def confirmed(self, run: str) -> list[tuple[int, int, str, float, int, int]]:
        """(start, end, license, share of bytes saved, template words missing, block words beside it) of each notice of a run, those left out that another's match contains."""
        hits = {}
        for a, b in around(run):
            # A part begins and ends between words.
            while a and not run[a - 1].isspace():
                a -= 1
            while b < len(run) and not run[b].isspace():
                b += 1
            block = run[a:b]
            low = block.lower()
            if len(low) != len(block):
                # Few letters change their length; places must stay.
                low = "".join(c.lower() if len(c.lower()) == 1 else c for c in block)
            at = [(m.start(), m.end()) for m in WORD.finditer(low)]
            own = [low[x:y] for x, y in at]
            alone = None
            for name, want in self.words.items():
                left, need = list(own), Counter(want)
                # Cheap and lossless: too few of the template's words, in any order, can't be confirmed.
                while sum((need & Counter(left)).values()) >= WORDS_KEPT * len(want):
                    found = self.matched(name, left)
                    if not found:
                        break
                    lo, hi = min(m.b for m in found), max(m.b + m.size for m in found)
                    if self.enough(want, found):
                        alone = alone or len(self.plain.compress(low.encode("utf-8", "surrogatepass")))
                        gain = 1 - len(self.dicts[name].compress(low.encode("utf-8", "surrogatepass"))) / alone
                        kept = sum(m.size for m in found)
                        hits.setdefault((a + at[lo][0], a + at[hi - 1][1], name), (float(gain), len(want) - kept, len(own) - kept, kept))
                    # The longest run is used up, and with it this notice; another one may stand beside it.
                    top = max(found, key=lambda m: m.size)
                    for i in range(lo, hi) if self.enough(want, found) else range(top.b, top.b + top.size):
                        left[i] = ""
        # The more words a match has in its span the better; the fewer it misses, the better of two with the same.
        ranked = sorted(hits.items(), key=lambda h: (h[0][0] - h[0][1], -h[1][3], h[1][1], h[0]))
        out: list = []
        for (a, b, name), (gain, missing, extra, _) in ranked:
            if not any(x <= a and b <= y for x, y, *_ in out):
                out.append((a, b, name, gain, missing, extra))
        return sorted(out)

    def rows(self, text: str) -> list[tuple]:
        """(line, offset, license, confirmed, saved, n_missing, n_extra) of a text: each confirmed notice where it begins, and the best guess of each candidate block that none touches."""
        run, starts, places = joined(text)

        def place(at: int) -> tuple[int, int]:
            i = bisect_right(starts, at) - 1
            return places[i][0], places[i][1] + at - starts[i]

        out, spans = [], []
        for a, b, name, gain, missing, extra in self.confirmed(run):
            out.append((*place(a), name, True, gain, missing, extra))
            spans.append((place(a), place(b - 1)))
        for k, at, block in blocks(text):
            if not any(x <= (k, at + len(block)) and (k, at) <= y for x, y in spans):
                name, _, gain, missing, extra = self.best(block)
                out.append((k, at, name, False, gain, missing, extra))
        return sorted(out)


def scan(docs: DataFrame) -> DataFrame:
    """A row for each confirmed notice of each document, and one with the best guess for each candidate block without any.

    Null and empty texts have no lines; repeated rows are scanned each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.float64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                if text and HINT.search(text):
                    rows += [(doc, *r) for r in scanner.rows(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return only(docs, doc_id="bigint", text="string").mapInArrow(run, SCHEMA)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
