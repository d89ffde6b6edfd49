"""The licence scan against sets in plain Python."""

import re

from lexframe.llm import licenses

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.translate(UPPER)) if w]


def brute(text, threshold=0.8):
    lines, at, units, paragraph = (text or "").split("\n"), 0, set(), []
    whole = []
    for line in [*lines, ""]:
        own = words(line)
        blank = not line.strip(" \t\r\v\f")
        if blank and paragraph:
            units.add((paragraph[0][0], at, tuple(w for _, ws in paragraph for w in ws)))
            paragraph = []
        if own:
            units.add((at, at + len(own), tuple(own)))
        if not blank:
            paragraph.append((at, own))
        whole += own
        at += len(own)
    units.add((0, at, tuple(whole)))
    out = {}
    for _, _, own in units:
        grams = set(zip(own, own[1:], strict=False))
        for name, variants in licenses.TEMPLATES.items():
            best = 0.0
            for v in variants:
                w = words(v)
                other = set(zip(w, w[1:], strict=False))
                best = max(best, 2 * len(grams & other) / max(1, len(grams) + len(other)))
            if best >= threshold:
                n, top = out.get(name, (0, 0.0))
                out[name] = (n + 1, max(top, best))
    return sorted((k, n, round(d, 9)) for k, (n, d) in out.items())


TEXTS = [
    "Released under the MIT License.",
    "words before\nReleased under the MIT License!\nLicensed under CC BY-NC 4.0.\n\nmore words here",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation\nfiles (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,\nmerge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:",
    "the license", "", None, "one", "éé ñ\n\n\n", "This work is licensed under the GNU General Public License, version 2.",
]


def test_equals_sets(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x")], "doc_id long, text string, license string")
    got = sorted((r.doc_id, r.license, r.n_units, round(r.dice, 9)) for r in licenses.scan(docs).collect())
    want = sorted([(i, *m) for i, t in enumerate(TEXTS) for m in brute(t)] + [(0, *m) for m in brute(TEXTS[0])])
    assert got == want and len({n for _, n, *_ in got}) >= 3
    assert licenses.scan(docs.limit(0)).count() == 0


def test_notices_inside_units(spark):
    mit = licenses.TEMPLATES["mit"]
    gpl = licenses.TEMPLATES["gpl-3.0"]
    wrapped = lambda t, n: [" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n)]
    middle = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    block = lambda parts: "/*\n" + "\n *\n".join("\n".join(" * " + x for x in wrapped(t, 9)) for t in parts) + "\n */\nint main() {"
    texts = [
        "Copyright (c) 2020 Example Corp. Licensed under the MIT License.",
        block([gpl[1], middle, gpl[2]]),
        block(["Copyright (c) 2020 Example Corp", mit[2], mit[3], "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, express or implied, " + middle]),
        "words licensed under the terms of the public library license",
        "a" + " licensed under the mit license and words" * 3,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.license, r.n_units, r.dice) for r in licenses.scan(docs).collect())
    assert got == [(0, "mit", 1, 1.0), (1, "gpl-3.0", 2, 1.0), (2, "mit", 2, 1.0), (4, "mit", 3, 1.0)]
    assert not any(brute(t) for t in texts)
