"""Column helpers for text: everything here stays inside the JVM and needs no shuffle."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexframe.functions import lexicon as lx


def jre(pattern: str, flags: str = "") -> str:
    """A pattern for Java with Unicode classes and \\n as the only line end."""
    return "(?" + "".join({"i": "iu"}.get(f, f) for f in flags) + "dU)" + pattern


#: The characters that \s stands for in patterns with Unicode classes.
_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at either end, line ends included."""
    return F.btrim(c, F.lit(_SPACE))


def any_of(c: Column, phrases: Sequence[str]) -> Column:
    """Whether any of the phrases occurs."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(c, F.lit(p))
    return out


def hits(c: Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases occur. A filter over a constant array keeps the generated code small where there are
    many phrases."""
    return F.size(F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(c, p)))


def title(c: Column) -> Column:
    """A name with underscores as words with initials."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def _marked(text: Column, pattern: str, new: str) -> Column:
    """The text with \\1 and \\2 put in at the matches. In ASCII the flags u and U change no match, and cost most."""
    flags = re.match(r"\(\?(\w+)\)", pattern)
    plain = (f"(?{kept})" if (kept := flags[1].replace("u", "").replace("U", "")) else "") + pattern[flags.end() :]
    return F.when(F.octet_length(text) == F.char_length(text), F.regexp_replace(text, plain, new)).otherwise(F.regexp_replace(text, pattern, new))


def spans(text: Column, pattern: str, groups: int = 0) -> Column:
    """array<struct<start, end, text, g1, ...>> of all matches, offsets in code points. The pattern begins with flags.

    There is no function for offsets, but the pieces between matches and the matches themselves add up to the text: one
    fold over both gives the positions. Both come from one pass of the pattern that puts two control characters in; a
    text that has one of these already is matched once for each piece.
    """
    names = ["start", "end", "text", *[f"g{k}" for k in range(1, groups + 1)]]
    once = F.transform(F.split(_marked(text, pattern, "\2$0" + "".join(f"\2${k}" for k in range(1, groups + 1)) + "\1"), "\1", -1), lambda x: F.split(x, "\2", -1))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), *[F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(f"m{k}") for k in range(groups + 1)])
    apart = F.transform(zipped, lambda x: F.array(x["gap"], *[x[f"m{k}"] for k in range(groups + 1)]))
    pieces = F.when(F.contains(text, F.lit("\1")) | F.contains(text, F.lit("\2")), apart).otherwise(once)
    kind = ", ".join(["start: int", "end: int", "text: string", *[f"g{k}: string" for k in range(1, groups + 1)]])
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<{kind}>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(F.get(x, F.lit(0)))
        end = start + F.length(F.get(x, F.lit(1)))
        row = F.struct(*[c.alias(n) for n, c in zip(names, [start, end, *[F.get(x, F.lit(k)) for k in range(1, groups + 2)]], strict=True)])
        return F.when(F.get(x, F.lit(1)).isNull(), acc).otherwise(F.struct(end.alias("at"), F.array_append(acc["out"], row).alias("out")))

    return F.aggregate(pieces, zero, step, lambda acc: acc["out"])


def sections(text: Column) -> Column:
    """array<struct<start, end, text>>: from each heading to the next where there are two or more; else runs between
    blank lines, short ones joined to the next until 100 characters are reached."""
    head = jre(lx.HEADING, "m")
    once = F.split(_marked(text, head, "\1$0"), "\1", -1)
    rest = F.split(text, head, -1)
    apart = F.concat(F.slice(rest, 1, 1), F.transform(F.arrays_zip(F.regexp_extract_all(text, F.lit(head), F.lit(0)).alias("head"), F.slice(rest, 2, 1 << 30).alias("rest")), lambda x: F.concat(x["head"], x["rest"])))
    pieces = F.when(F.contains(text, F.lit("\1")), apart).otherwise(once)
    kind = "array<struct<start: int, end: int, text: string>>"

    def step(acc: Column, body: Column) -> Column:
        end = acc["at"] + F.length(body)
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(acc["at"].alias("start"), end.alias("end"), body.alias("text"))).alias("out"))

    # What precedes the first heading is a piece too, which the fold takes for its first row: dropped at the end.
    whole = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])
    some = F.transform(F.array(whole), lambda w: F.when(F.size(w) >= 3, F.slice(w, 2, 1 << 30)).otherwise(_paragraphs(text)))
    return F.get(some, F.lit(0))


def _paragraphs(text: Column) -> Column:
    parts = spans(text, r"(?s)(?:(?!\n\n).)+")
    last = F.element_at(F.regexp_extract_all(text, F.lit(r"(?s)(?:(?!\n\n).)+"), F.lit(0)), -1)
    kind = "array<struct<start: int, end: int, text: string>>"
    zero = F.struct(F.lit(-1).alias("start"), F.lit("").alias("text"), F.array().cast(kind).alias("out"), last.alias("last"))

    def step(acc: Column, x: Column) -> Column:
        fresh = acc["start"] < 0
        start = F.when(fresh, x["start"]).otherwise(acc["start"])
        body = F.when(fresh, x["text"]).otherwise(F.concat(acc["text"], F.lit("\n\n"), x["text"]))
        done = (F.length(body) >= 100) | (x["text"] == acc["last"])
        whole = F.array_append(acc["out"], F.struct(start.alias("start"), x["end"].alias("end"), body.alias("text")))
        return F.struct(F.when(done, F.lit(-1)).otherwise(start).alias("start"), F.when(done, F.lit("")).otherwise(body).alias("text"), F.when(done, whole).otherwise(acc["out"]).alias("out"), acc["last"].alias("last"))

    merged = F.aggregate(parts, zero, step, lambda acc: acc["out"])
    alone = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("text")))
    return F.when(F.length(text) == 0, alone).otherwise(merged)


def ocr_fixed(c: Column) -> Column:
    """Traces of scanning removed by five rules in order."""
    for pattern, new in lx.OCR:
        c = F.regexp_replace(c, "(?U)" + pattern, new.replace("\\", "$"))
    return c


def abbreviations_expanded(c: Column) -> Column:
    """Legal abbreviations written out, rule after rule."""
    for pattern, new in lx.ABBREVIATIONS:
        c = F.regexp_replace(c, "(?iuU)" + pattern, new)
    return c


def clean(c: Column, fix_ocr: bool = True, expand: bool = False, normalise: bool = True) -> Column:
    """Plain quotes and dashes, no traces of scanning, single blanks, stripped lines. Text that isn't ASCII should be in
    composed form already (`operators.text.composed` does that)."""
    if normalise:
        for old, new in (("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("–", "-"), ("—", "--"), ("…", "..."), ("\xa0", " ")):
            c = F.replace(c, F.lit(old), F.lit(new))
    if fix_ocr:
        c = ocr_fixed(c)
    if expand:
        c = abbreviations_expanded(c)
    c = F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]+", " ")
    return strip(F.array_join(F.transform(F.split(c, "\n", -1), strip), "\n"))


def sentences(c: Column) -> Column:
    """Sentences of cleaned text: cut at . ! ? before a capital, quote or bracket, but not after abbreviations,
    initials and digits; a short fragment without a capital is joined to the sentence before it."""
    flat = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    cut = "(?U)(?<=[.!?])" + "".join(f"(?<!{x})" for x in lx.NOT_AFTER) + r'\s+(?=[A-Z("])'
    parts = F.filter(F.transform(F.split(flat, cut, -1), strip), lambda s: s != "")

    def step(acc: Column, s: Column) -> Column:
        joins = (F.length(s) < 15) & (F.size(acc) > 0) & ~F.rlike(s, F.lit(r"(?U)^\p{Lu}"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), s)))).otherwise(F.array_append(acc, s))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters, hyphens and apostrophes."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?U)\b[a-zA-Z'-]+\b"), F.lit(0)), F.lower)


def word_tokens(c: Column) -> Column:
    """Lower-cased words that begin and end with a letter, single letters included."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?U)\b[a-zA-Z][a-zA-Z'-]*[a-zA-Z]\b|\b[a-zA-Z]\b"), F.lit(0)), F.lower)


def diff_tokens(c: Column) -> Column:
    """Distinct tokens of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b[a-z'-]+\b"), F.lit(0)))


def summary_tokens(c: Column) -> Column:
    """Runs of a-z longer than two of the lower-cased text that aren't stop words."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*lx.SUMMARY_STOP_WORDS))


def summary_sentences(c: Column) -> Column:
    """Pieces of at least 15 characters between . ! ? and a capital or quote."""
    return F.filter(F.transform(F.split(c, r'(?U)(?<=[.!?])\s+(?=[A-Z"“])', -1), strip), lambda s: F.length(s) >= 15)


def terms(c: Column) -> Column:
    """Tokens of three letters and more that aren't stop words."""
    return F.filter(tokens(c), lambda w: (F.length(w) >= 3) & ~w.isin(*lx.STOP_WORDS))


def ngrams(words: Column, low: int, high: int) -> Column:
    """All runs of low to high words, joined by underscores, shorter runs first."""
    parts = []
    for n in range(low, high + 1):
        if n == 1:
            parts.append(words)
            continue
        shifted = F.arrays_zip(*[F.slice(words, k + 1, F.greatest(F.size(words) - n + 1, F.lit(0))).alias(f"w{k}") for k in range(n)])
        parts.append(_joined(shifted, n))
    return F.concat(*parts)


def _joined(shifted: Column, n: int) -> Column:
    return F.transform(shifted, lambda x: F.concat_ws("_", *[x[f"w{k}"] for k in range(n)]))


def syllables(word: Column) -> Column:
    """An estimate of the syllables of a word from its groups of vowels and its end."""
    w = F.lower(strip(word))
    short = F.when(F.endswith(w, F.lit("e")) & ~F.endswith(w, F.lit("le")), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    n = F.regexp_count(short, F.lit("[aeiouy]+"))
    before = F.substring(short, F.length(short) - 2, F.lit(1))
    long = F.length(short) > 3
    n = F.when(F.endswith(short, F.lit("ed")) & long & ~before.isin("t", "d"), F.greatest(F.lit(1), n - 1)).otherwise(n)
    pair = F.substring(short, F.length(short) - 3, F.lit(2))
    spoken = before.isin("s", "z") | pair.isin("sh", "ch", "th")
    n = F.when(F.endswith(short, F.lit("es")) & long & ~spoken, F.greatest(F.lit(1), n - 1)).otherwise(n)
    n = n + F.rlike(short, F.lit("[^aeiou]ious$|[^aeiou]eous$")).cast("int")
    return F.when(F.length(w) == 0, 0).when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), n))


def word_count(c: Column) -> Column:
    """Number of words between white space."""
    return F.size(F.filter(F.split(c, r"(?U)\s+", -1), lambda x: x != ""))
