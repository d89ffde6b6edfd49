"""Licence scan by the Dice coefficient over word bigrams.

Text is normalised (A-Z to lower case, every other ASCII character than letters and digits separates words) and cut
into units: each line, each paragraph (a run of lines that aren't blank) and the whole text. A unit matches a template
when twice the number of bigrams they share is at least `threshold` times the sum of their numbers of distinct bigrams.
Size bounds prune templates first: a unit of a bigrams can only match templates of a*t/(2-t) to a*(2-t)/t. Units that
share no bigram with any template, nearly all of them, are never built. A notice inside a longer unit is found by windows
of words between bigrams of a template, with as many bigrams as the bounds allow; windows that overlap a unit or a better
window of the same licence are left out, and the others count as units.

Defined cases: null and empty texts, and units of fewer than two words, match nothing; equal units count once each time
they occur; a paragraph of one line and a text of one paragraph are the same unit and count once; repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexframe.llm.kit import U64, WORDS, raw_texts, shingle_names, slices, texts

#: Notices by which works are commonly placed under public licences.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "cc-by-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "cc-by-sa-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "cc-by-nc-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
}

_CLEAN = bytes(c if chr(c).isascii() and chr(c).isalnum() or c >= 0x80 else 0x0A if c == 0x0A else 0x20 for c in bytes(range(256)).lower())


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of a text and the number of line ends before each."""
    data = np.frombuffer(raw.translate(_CLEAN), dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = data > 0x20
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    names, at = np.empty(len(start), dtype=U64), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + (1 << 20), side="right")))
        base = int(start[at])
        names[at:to] = WORDS.names(WORDS.prefix(data[base : int(end[to - 1])]), start[at:to] - base, end[at:to] - base)
        at = to
    return names, np.searchsorted(np.flatnonzero(data == 0x0A), start)


def _bigrams(words: np.ndarray) -> np.ndarray:
    return shingle_names(words, 2) if len(words) > 1 else words[:0]


def windows(grams: np.ndarray, hits: np.ndarray, variants: list[np.ndarray], threshold: float) -> list[tuple[float, int, int]]:
    """(Dice coefficient, first word, word after the last) of the runs of words that match a template, best first. For
    each bigram of a template, the best run that starts there and ends with another one, of a length within the bounds."""
    out, distinct = [], len(np.unique(grams[hits]))
    for x in variants:
        if distinct < len(x) * threshold / (2 - threshold) - 1e-9:
            continue
        own = hits[np.isin(grams[hits], x)]
        least, most = len(x) * threshold / (2 - threshold) - 1e-9, len(x) * (2 - threshold) / threshold + 1e-9
        if len(np.unique(grams[own])) < least:
            continue
        to = np.searchsorted(own, own + (most - 1), side="right")
        for i in np.flatnonzero(to - np.arange(len(own)) >= least).tolist():
            start, at, best, end = int(own[i]), int(own[i]), 0.0, 0
            seen: set[int] = set()
            shared: set[int] = set()
            for stop in own[i : to[i]].tolist():
                seen.update(grams[at : stop + 1].tolist())
                shared.add(int(grams[stop]))
                at = stop + 1
                dice = 2 * len(shared) / (len(seen) + len(x))
                if at - start >= least and dice > best:
                    best, end = dice, at + 1
            if best >= threshold:
                out.append((best, start, end))
    return sorted(out, key=lambda w: (-w[0], w[1], w[2]))


def match(raw: bytes, templates: dict[str, list[np.ndarray]], vocabulary: np.ndarray, threshold: float) -> list[tuple[str, int, float]]:
    """(licence, units, best Dice coefficient) for each licence found in a text."""
    words, line = _words(raw)
    grams = _bigrams(words)
    at = np.searchsorted(vocabulary, grams)
    hits = np.flatnonzero(vocabulary[np.minimum(at, len(vocabulary) - 1)] == grams)
    if not len(hits):
        return []
    # Blank lines end paragraphs; a line of separators alone is not blank.
    blank = np.array([i for i, x in enumerate(raw.split(b"\n")) if not x.strip(b" \t\r\v\f")], dtype=np.int64)
    paragraph = np.searchsorted(blank, line)
    units: set[tuple[int, int]] = {(0, len(words))}
    for key in (line, paragraph):
        k = np.unique(key[hits])
        units.update(zip(np.searchsorted(key, k).tolist(), np.searchsorted(key, k, side="right").tolist(), strict=True))
    found: dict[str, tuple[int, float]] = {}
    taken: dict[str, list[tuple[int, int]]] = {}
    for a, b in units:
        if b - a < 2:
            continue
        own = np.unique(grams[a : b - 1])
        for name, variants in templates.items():
            best = 0.0
            for x in variants:
                if 2 * min(len(own), len(x)) < threshold * (len(own) + len(x)):
                    continue
                dice = 2 * len(np.intersect1d(own, x, assume_unique=True)) / (len(own) + len(x))
                best = max(best, dice)
            if best >= threshold:
                n, top = found.get(name, (0, 0.0))
                found[name] = (n + 1, max(top, best))
                taken.setdefault(name, []).append((a, b))
    # Notices that share their unit with other words; one that overlaps a unit of its licence is that unit again.
    for name, variants in templates.items():
        there = taken.setdefault(name, [])
        for dice, a, b in windows(grams, hits, variants, threshold):
            if not any(x < b and a < y for x, y in there):
                there.append((a, b))
                n, top = found.get(name, (0, 0.0))
                found[name] = (n + 1, max(top, dice))
    return sorted((k, n, d) for k, (n, d) in found.items())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None, threshold: float = 0.8) -> DataFrame:
    """(doc_id, license, n_units, dice): the licences found in each document, the number of units that match and the
    best coefficient. Nothing is shuffled; the templates are few and travel with the function."""
    ready = {k: [np.unique(_bigrams(_words(x.encode())[0])) for x in v] for k, v in (templates or TEMPLATES).items()}
    vocabulary = np.unique(np.concatenate([x for v in ready.values() for x in v]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = [(i, *m) for i, raw in zip(part.column("doc_id").to_pylist(), raw_texts(part.column("text")), strict=True) for m in match(raw, ready, vocabulary, threshold)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.float64()))], ["doc_id", "license", "n_units", "dice"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, license string, n_units long, dice double")


def oracle_sql(table: str = "documents", threshold: str = "0.8") -> str:
    """The scan in SQL, over all units of all texts."""
    quoted = [(k, x.replace("'", "''")) for k, v in TEMPLATES.items() for x in v]
    words = r"list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return rf"""
with t as (select license, {grams} as g from (select license, {words.format("body")} as w from (values {", ".join(f"('{k}', '{x}')" for k, x in quoted)}) v(license, body))),
lines as (select doc_id, text, unnest(string_split(text, chr(10))) as body, unnest(range(len(string_split(text, chr(10))))) as n from {table}),
marked as (select doc_id, n, body, {words.format("body")} as lw, sum(case when regexp_full_match(body, '[ \t\r\v\f]*') then 1 else 0 end) over (partition by doc_id order by n) as par from lines),
wide as (select doc_id, n, par, lw, sum(len(lw)) over (partition by doc_id order by n) as upto from marked),
units as (
  select doc_id, upto - len(lw) as a, upto as b, lw as w from wide
  union all select doc_id, min(upto - len(lw)), max(upto), flatten(list(lw order by n)) from wide group by doc_id, par
  union all select doc_id, 0, max(upto), flatten(list(lw order by n)) from wide group by doc_id),
once as (select distinct doc_id, a, b, w from units where len(w) > 1),
g as (select doc_id, a, b, {grams} as g from once),
scored as (select doc_id, a, b, license, max(2.0::double * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g))) as dice from g, t where 2 * least(len(g.g), len(t.g)) >= {threshold} * (len(g.g) + len(t.g)) group by all)
select doc_id, license, count(*) as n_units, max(dice) as dice from scored where dice >= {threshold} group by doc_id, license
"""
