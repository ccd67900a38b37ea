"""License scan by conditional compression.

The words around each cue are cut into blocks of bounded length, which overlap by more than a
notice.  A block is compressed with each template as a raw zstandard dictionary, which ranks the
templates by the share of their own saving that they reach.  Those that reach enough are the
candidates; a notice of a candidate is confirmed by the exact words in which template and nearest
stretch of the block differ, whatever stands around it.  Without a confirmed one the ranking gives
an unconfirmed candidate.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from pairloom.session import durable

#: Notices to look for (fixed values: public wordings).  # stands for a number or a version.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted"),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Words around which blocks are cut.  Line breaks and comment marks may stand between them.
_GAP = r"(?:[\W_]|\b(?:rem|dnl)\b)+"
CUES = ("(?i)licen[sc]|copyright|permission is hereby|permission to use|redistribution and use|free software"
        .replace(" ", _GAP))
#: An unconfirmed candidate saves at least this share of what it saves on its own wording.
LEAST_SAVING = 0.3
#: A template is a candidate, and only then compared word by word, if the block saves at least this
#: share of what its own wording saves.  Text around a notice makes its letters cheaper, so that a whole
#: notice in a long block saves about half.
CANDIDATE = 0.25
#: A notice is confirmed if at most this share of the template's words is missing or changed.
MOST_CHANGED = 0.2
LEVEL = 9
#: Names that tell licenses apart: one that is missing or in between makes it another license.  So do versions.
NAMES = frozenset((
    "gnu lgpl agpl fdl lesser affero apache mozilla eclipse mit cc nc sa nd noncommercial sharealike noderivatives "
    "noderivs documentation modified clause").split())
#: What such a difference counts: more than any share of a template allows.
OTHER = 1000

_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


#: Comment marks that are words themselves.
_MARK = re.compile(r"(?im)^[^\w\n]*(?:rem|dnl)\b")


def words_of(text: str) -> list[str]:
    """Words in lower case; dots and dashes inside a word are part of it."""
    return _WORD.findall(text.lower())


_VERSION = re.compile(r"\d{1,2}(?:\.\d+)*")


def compared(word: str) -> list[str]:
    """A word as it is compared: v3 is version 3, 2.0 is 2, and cc-by is cc by."""
    if word[0] == "v" and (word in ("v", "ver") or _VERSION.fullmatch(word[1:])):
        return ["version", *compared(word[1:])] if word[1:2].isdigit() else ["version"]
    if word[:3] in ("cc-", "by-"):
        return [y for x in word.split("-") if x for y in compared(x)]
    return [re.sub(r"(?:\.0+)+$", "", word)] if _VERSION.fullmatch(word) else [word]


def marks_of(word: str) -> set[str]:
    """What in a word tells licenses apart: names and versions."""
    return {compared(x)[0] for x in word.split("-") if x in NAMES or _VERSION.fullmatch(x)}


def costs_of(words: list[str]) -> list[int]:
    """What it counts if a word of a template is missing; a name or version once is enough."""
    seen, costs = set(), []
    for i, word in enumerate(words):
        new = (marks_of(word) | ({"by"} if word == "by" and words[i - 1:i] == ["cc"] else set())) - seen
        costs.append(OTHER if new else 1)
        seen |= new
    return costs


class Scanner:
    """Compressors with each template as dictionary, and the templates' words."""

    def __init__(self, templates: Mapping[str, str]):
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self.by_name, self.raw, self.gain = {}, {}, {}
        for name, text in sorted(templates.items()):
            words = [y for w in words_of(text) for y in compared(w)]
            whole = " ".join(words).encode("utf-8", "surrogatepass")
            packer = zstandard.ZstdCompressor(
                level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False,
                dict_data=zstandard.ZstdCompressionDict(whole, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            self.by_name[name], self.raw[name] = (packer, words), words_of(text)
            self.gain[name] = max(1, len(self.plain.compress(whole)) - len(packer.compress(whole)))
        #: Words that a confirmed notice spans at most.
        self.reach = max((int(len(w) * (1 + MOST_CHANGED)) for _, w in self.by_name.values()), default=0) + 4
        self.missing = {name: costs_of(w) for name, (_, w) in self.by_name.items()}
        self.marks = {name: set().union(*map(marks_of, w)) for name, (_, w) in self.by_name.items()}

    def ranked(self, words: list[str], cues: list[int]) -> list[tuple[float, str]]:
        """Templates by the share of their own saving that they reach at any of the cues, best first.

        Compressed are the words around the cue, as far on both sides as a notice of the template
        can reach, and the whole block: long text makes letters cheap and so hides a short notice,
        while a short block may be too small to be compressed at all.
        """
        own: dict[tuple[int, int], tuple[bytes, int]] = {}
        best = []
        for name, (packer, wanted) in self.by_name.items():
            reach, most = int(len(wanted) * (1 + MOST_CHANGED)), 0.0
            around = {(max(0, cue - reach), min(len(words), cue + reach + 1)) for cue in cues}
            for at in around | {(0, len(words))}:
                if at not in own:
                    block = " ".join(words[at[0]:at[1]]).encode("utf-8", "surrogatepass")
                    own[at] = block, len(self.plain.compress(block))
                block, size = own[at]
                most = max(most, (size - len(packer.compress(block))) / self.gain[name])
            best.append((most, name))
        return sorted(best)[::-1]

    def differences(self, name: str, words: list[str]) -> list[str]:
        """Template words that the block lacks, and words it has inside the matched stretch instead."""
        wanted = self.raw[name]
        blocks = [m for m in difflib.SequenceMatcher(None, wanted, words, autojunk=False).get_matching_blocks() if m.size]
        if not blocks:
            return [f"-{w}" for w in wanted]
        kept = {i for m in blocks for i in range(m.a, m.a + m.size)}
        used = {i for m in blocks for i in range(m.b, m.b + m.size)}
        first, last = blocks[0].b, blocks[-1].b + blocks[-1].size
        return ([f"-{w}" for i, w in enumerate(wanted) if i not in kept]
                + [f"+{words[i]}" for i in range(first, last) if i not in used])

    def stretches(self, name: str, words: list[str]) -> list[tuple[int, int]]:
        """Stretches of the block, from and to, that the words confirm; the nearest first, none overlap.

        Missing and added words are counted over all alignments of the whole template with a
        stretch, so words outside of it never count.  A name or version among them makes it
        another license.
        """
        wanted = self.by_name[name][1]
        most = MOST_CHANGED * len(wanted)
        if sum((Counter(wanted) - Counter(words)).values()) > most:
            return []
        missing, marks = self.missing[name], self.marks[name]
        column = [(0, 0)]
        for cost in missing:
            column.append((column[-1][0] + cost, 0))
        found = []
        for j, word in enumerate(words):
            added = 1 if marks_of(word) <= marks else OTHER
            new = [(0, -(j + 1))]
            for i, w in enumerate(wanted):
                new.append(min((new[i][0] + missing[i], new[i][1]), (column[i + 1][0] + added, column[i + 1][1]),
                               *([column[i]] if w == word else [])))
            column = new
            if column[-1][0] <= most:
                found.append((column[-1][0], -column[-1][1], j + 1))
        kept: list[tuple[int, int]] = []
        for _, a, b in sorted(found):
            if all(b <= x or y <= a for x, y in kept):
                kept.append((a, b))
        return kept

    def notices(self, text: str) -> list[tuple[int, str, float, list[str], bool]]:
        """Line, license, saving, differences and whether they confirm it, of each notice of a text.

        A confirmed notice within a longer one is part of it.  A block without a confirmed one
        gives the candidate with the fewest differences within a tenth of the best saving.
        """
        places = list(_WORD.finditer(_MARK.sub(lambda m: " " * len(m[0]), text)))
        raw = [m[0].lower() for m in places]
        words, at = [], []  # as compared, and the place of each
        for i, word in enumerate(raw):
            for x in compared("lesser" if word == "library" and raw[i + 1:i + 3] == ["general", "public"] else word):
                words.append(x)
                at.append(i)
        starts = [0]
        for word in words:
            starts.append(starts[-1] + len(word) + 1)
        cues = sorted({bisect(starts, m.start()) - 1 for m in re.finditer(CUES, " ".join(words))})
        breaks = [i for i, c in enumerate(text) if c == "\n"]
        line = lambda i: bisect(breaks, places[at[i]].start())
        ranges: list[list[int]] = []
        for i in cues:
            a, b = max(0, i - self.reach), min(len(words), i + self.reach + 1)
            if ranges and a <= ranges[-1][1]:
                ranges[-1][1] = b
            else:
                ranges.append([a, b])
        sure, weak = {}, []
        for low, high in ranges:
            for a in range(low, max(low + 1, high - self.reach), 2 * self.reach):
                b = min(high, a + 3 * self.reach)
                order = self.ranked(words[a:b], [i - a for i in cues if a <= i < b])
                near = [(x, name) for x, name in order if x >= LEAST_SAVING]
                spans = [(a + c, a + d, name, x) for x, name in order if x >= CANDIDATE
                         for c, d in self.stretches(name, words[a:b])]
                sure.update({(c, d, name): x for c, d, name, x in spans})
                if near and not spans:
                    here = raw[at[a]:at[b - 1] + 1]
                    close = [(x, name, self.differences(name, here)) for x, name in near if x >= near[0][0] - 0.1]
                    x, name, changed = min(close, key=lambda c: (len(c[2]), -c[0], -len(self.raw[c[1]]), c[1]))
                    weak.append((line(next(i for i in cues if i >= a)), name, x, changed, False))
        # Blocks overlap: of one template's stretches that do, the longest stays.
        kept: list[tuple[int, int, str]] = []
        for c, d, name in sorted(sure, key=lambda k: (k[0] - k[1], k)):
            if not any((x < d and c < y) if n == name else (x <= c and d <= y) for x, y, n in kept):
                kept.append((c, d, name))
        return [(line(c), name, sure[c, d, name], self.differences(name, raw[at[c]:at[d - 1] + 1]), True)
                for c, d, name in sorted(kept)] + weak


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Confirmed and unconfirmed notices, one row each.

    Columns: _row, doc_id, line (from 0, where it begins), license, saving, differences,
    confirmed.  Null and empty texts have no cue.  Repeated rows are found again.  Without
    templates nothing is found.
    """
    found = docs.where(F.col(text).rlike(CUES)).select(
        "_row", F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = [(r, i, *n) for r, i, t in zip(*(batch.column(c).to_pylist() for c in ("_row", "_id", "_text")))
                    for n in scanner.notices(t)]
            row, id_, line, name, saving, changed, sure = zip(*rows) if rows else ([],) * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, pa.int64()), pa.array(id_, pa.int64()), pa.array(line, pa.int32()), pa.array(name, pa.string()),
                 pa.array(saving, pa.float64()), pa.array(changed, pa.list_(pa.string())), pa.array(sure, pa.bool_())],
                names=["_row", "doc_id", "line", "license", "saving", "differences", "confirmed"])

    return found.mapInArrow(judge, "_row long, doc_id long, line int, license string, saving double, "
                                   "differences array<string>, confirmed boolean")


def document_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, text: str = "text",
                      doc_id: str = "doc_id") -> DataFrame:
    """Confirmed licenses of every row of ``docs``.

    Columns: doc_id, n_notices (confirmed ones), licenses (sorted, comma-joined, "" without
    any), exact (all confirmed notices have the template's very words; null without any).

    One row for each row of ``docs``: repeated rows and null or repeated ids keep rows of their
    own.  Null and empty texts have no notice; an empty table gives an empty one, and without
    templates nothing is found.  Whole texts are read, of any length.  Of candidates with equal
    shares the later name is ranked first, which decides nothing: all candidates are compared.
    Columns other than text and id are not read, so their names cannot clash.
    """
    rows = durable(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).cast("long").alias("_id"),
                               F.when(F.col(text).rlike(CUES), F.col(text)).alias("_text")))
    found = scan(rows, templates, "_text", "_id").where("confirmed").groupBy("_row").agg(
        F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
        F.bool_and(F.size("differences") == 0).alias("exact"))
    return (rows.select("_row", "_id").join(found, "_row", "left")
            .select(F.col("_id").alias("doc_id"), F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"),
                    F.coalesce("licenses", F.lit("")).alias("licenses"), "exact"))
