"""The queries of the registry in SQL, composed of common table expressions, to hold their results against."""

from __future__ import annotations

from lexframe.functions import lexicon as lx
from lexframe.sources.contracts import contracts_sql


def q(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("'", "''") + "'"


def listed(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def isin(c: str, xs) -> str:
    return f"{c} in ({', '.join(q(x) for x in xs)})"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def contains_any(c: str, phrases) -> str:
    return "(" + " or ".join(f"contains({c}, {q(p)})" for p in phrases) + ")"


def n_hits(c: str, phrases) -> str:
    return "(" + " + ".join(f"contains({c}, {q(p)})::int" for p in phrases) + ")"


def title(c: str) -> str:
    return f"array_to_string(list_transform(string_split(replace({c}, '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def with_(final: str, **tables: str) -> str:
    return ("with " + ",\n".join(f"{k} as ({v})" for k, v in tables.items()) + "\n" if tables else "") + final


def span_rows(source: str, pattern: str, flags: str = "", groups: int = 0, where: str = "") -> str:
    """(doc_id, i, start_char, end_char, m, g1, ...) of all matches in source(doc_id, text)."""
    p = q(f"(?{flags})" + pattern if flags else pattern)
    extra = "".join(f", regexp_extract_all(text, {p}, {k}) as l{k}" for k in range(1, groups + 1))
    return f"""select doc_id, i - 1 as i, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::int as start_char,
      (list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))))::int as end_char, ms[i] as m{"".join(f", l{k}[i] as g{k}" for k in range(1, groups + 1))}
      from (select *, unnest(range(1, len(ms) + 1)) as i from (select doc_id, regexp_extract_all(text, {p}) as ms, string_split_regex(text, {p}) as g{extra} from {source} {where}))"""


CONTRACTS = {"c": contracts_sql()}

_HEAD = q("(?m)" + lx.HEADING)


def sections(source: str = "c") -> dict[str, str]:
    return {
        "hd": f"select doc_id, regexp_extract_all(text, {_HEAD}) as ms, string_split_regex(text, {_HEAD}) as g from {source}",
        "sec0": "select doc_id, i - 1 as section, ms[i] || g[i + 1] as body, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::int as start_char from (select *, unnest(range(1, len(ms) + 1)) as i from hd)",
        "sec": "select *, start_char + length(body) as end_char from sec0",
    }


def scores() -> dict[str, str]:
    out = {"lined": f"select *, lower(body) as low, lower(string_split({strip('body')}, chr(10))[1]) as fl from sec where length({strip('body')}) >= 20"}
    hit = ", ".join(f"{n_hits('low', p.keywords)} as n_{p.name}" for p in lx.CLAUSES)
    out["hit"] = f"select *, {hit} from lined"
    score = ", ".join(
        f"(case when regexp_matches(fl, {q('(?i)' + '|'.join(p.headings))}) then 0.5::double else 0 end) + (case when n_{p.name} >= {p.hits} then 0.3::double + n_{p.name}::double / {len(p.keywords)} * 0.3::double else 0 end) + (case when n_{p.name} >= {p.hits + 2} then 0.1::double else 0 end) as score_{p.name}"
        for p in lx.CLAUSES
    )
    out["scored"] = f"select doc_id, section, body, start_char, end_char, {score} from hit"
    return out


def clauses(source: str = "c", prefix: str = "") -> dict[str, str]:
    """Table `cl` (or with a prefix) and what it needs."""
    when = " ".join(f"when score_{p.name} > 0 then {q(p.name)}" for p in lx.CLAUSES)
    value = " ".join(f"when score_{p.name} > 0 then score_{p.name}" for p in lx.CLAUSES)
    tables = sections(source) | scores()
    tables["cl"] = f"select doc_id, section as seq, case {when} end as clause_type, {strip('body')} as text, least(case {value} end, 1.0::double) as confidence, start_char, end_char from scored where case {when} end is not null"
    if not prefix:
        return tables
    import re

    names = "|".join(tables)
    return {prefix + k: re.sub(rf"\bfrom ({names})\b", lambda m: f"from {prefix}{m[1]}", v) for k, v in tables.items()}


def entity_rows(kind: str, source: str = "c") -> str:
    """(doc_id, type_ord, pattern_ord, entity_type, text, normalized, confidence, start_char, end_char)."""
    order = list(lx.ENTITY_PATTERNS).index(kind)
    parts = []
    for k, p in enumerate(lx.ENTITY_PATTERNS[kind]):
        groups = {"party": 2, "duration": 2, "obligation": 1}.get(kind, 0)
        rows = span_rows(source, p.pattern, p.flags, groups)
        if kind == "party":
            for part in (1, 2):
                name = f"rtrim({strip(f'g{part}')}, ',. ')"
                parts.append(f"select doc_id, {k} as pattern_ord, start_char, {part} as part, end_char, {name} as text, null::varchar as normalized, {name} as key from ({rows}) where length(g{part}) > 2 and length({name}) > 2")
        else:
            text, norm, key, cond = strip("m"), "null::varchar", strip("m"), ""
            if kind == "duration":
                norm = "g1 || ' ' || lower(g2)"
            if kind == "obligation":
                norm = key = strip("g1")
                cond = f"where length({key}) > 15"
            parts.append(f"select doc_id, {k} as pattern_ord, start_char, 0 as part, end_char, {text} as text, {norm} as normalized, {key} as key from ({rows}) {cond}")
    return f"select doc_id, {order} as type_ord, pattern_ord, {q(kind)} as entity_type, text, normalized, {lx.ENTITY_CONFIDENCE[kind]}::double as confidence, start_char, end_char from (select *, row_number() over (partition by doc_id, key order by pattern_ord, start_char, part) as rn from ({' union all '.join(parts)})) where rn = 1"


def entities(source: str = "c") -> dict[str, str]:
    return {"ent": " union all ".join(entity_rows(k, source) for k in lx.ENTITY_PATTERNS)}


def named(kinds, source: str = "c") -> dict[str, str]:
    """Tables `raw` of all matches and `fold` of each document's kept spans by type; `kept` without overlaps."""
    parts = []
    i = 0
    for t in kinds:
        for p in lx.NAMED_PATTERNS[t]:
            pattern, lead, tail = p.pattern, "''", "0"
            groups = 0
            if p.before or p.after:
                pattern = f"({'^|[^' + p.before + ']' if p.before else ''})({p.pattern})({p.after + '|$' if p.after else ''})"
                # one capture before, one for the entity; inner groups shift
                groups = 2
            rows = span_rows(source, pattern, p.flags, groups)
            text, start = (strip("g2"), "start_char + length(g1)") if groups else (strip("m"), "start_char")
            parts.append(f"select doc_id, {list(lx.NAMED_PATTERNS).index(t)} as type_ord, {i} as pattern_ord, {q(t)} as entity_type, {text} as text, ({start})::int as start_char, (({start}) + length({text}))::int as end_char, {p.confidence}::double as confidence from ({rows}) where length({text}) > 0")
            i += 1
    return {"raw": " union all ".join(parts)}


def greedy(source: str, out: str, partition: str) -> dict[str, str]:
    """Tables by which the spans of each partition that don't overlap an earlier one are kept, by recursion over ranks."""
    return {
        f"{out}_n": f"select *, row_number() over (partition by {partition} order by start_char, start_char - end_char, type_ord, pattern_ord) as rn from {source}",
        f"{out}_r": f"select {partition}, rn, end_char as upto, true as keep from {out}_n where rn = 1 union all select {', '.join('n.' + x.strip() for x in partition.split(','))}, n.rn, case when n.start_char >= r.upto then n.end_char else r.upto end, n.start_char >= r.upto from {out}_r r join {out}_n n on {' and '.join(f'r.{x.strip()} = n.{x.strip()}' for x in partition.split(','))} and n.rn = r.rn + 1",
        out: f"select n.* exclude (rn) from {out}_n n join {out}_r r using ({partition}, rn) where r.keep",
    }


def risk_rows(source: str = "c", clause_table: str = "cl") -> dict[str, str]:
    """Table `rk` with the columns of the operator."""
    sev = {"high": 0, "medium": 1, "low": 2}
    row = lambda rule, level, cat, desc, sug, seq="null::int", part="0": f"{rule} as rule_ord, {sev[level]} as severity, {q(level)} as level, {q(cat)} as category, {desc} as description, {sug} as suggestion, {seq} as clause_seq, {part} as part"
    parts = []
    for rule, level, names, desc, sug in (
        (1, "high", lx.ESSENTIAL, f"'Missing essential clause: ' || {title('name')} || '. This clause is typically required in commercial contracts.'", "'Add a ' || replace(name, '_', ' ') || ' clause to the agreement.'"),
        (2, "low", lx.RECOMMENDED, f"'Missing recommended clause: ' || {title('name')} || '.'", "'Consider adding a ' || replace(name, '_', ' ') || ' clause.'"),
    ):
        parts.append(f"select doc_id, {row(rule, level, 'missing_clause', desc, sug, part='part')} from (select s.doc_id, n.name, n.part from {source} s, (select unnest({listed(names)}) as name, unnest(range({len(names)}))::int as part) n where not exists (select 1 from {clause_table} x where x.doc_id = s.doc_id and x.clause_type = n.name))")
    for rule, level, kind, limits, cat, desc, sug in (
        (3, "high", "liability", lx.LIABILITY_CAPS, "unlimited_liability", "Liability clause found but no cap or limit is specified.", "Add a specific liability cap (e.g., 'not to exceed the total fees paid')."),
        (4, "medium", "indemnification", lx.MUTUAL, "one_sided_indemnity", "Indemnification appears to be one-sided rather than mutual.", "Consider negotiating mutual indemnification provisions."),
        (8, "high", "non_compete", lx.NON_COMPETE_LIMITS, "broad_non_compete", "Non-compete clause may lack geographic or temporal boundaries.", "Ensure non-compete has reasonable geographic scope and time limitation."),
    ):
        parts.append(f"select doc_id, {row(rule, level, cat, q(desc), q(sug), 'seq::int')} from {clause_table} where clause_type = {q(kind)} and not {contains_any('lower(text)', limits)}")
    for rule, level, test, cat, desc, sug in (
        (5, "medium", f"regexp_matches(lower(text), {q('|'.join(lx.AUTO_RENEWAL))})", "auto_renewal", "Contract contains automatic renewal provisions.", "Ensure adequate notice period for non-renewal and clear opt-out mechanism."),
        (6, "medium", f"regexp_matches(lower(text), {q(lx.UNILATERAL)})", "unilateral_termination", "One party may terminate without cause or for convenience.", "Ensure termination for convenience is mutual or negotiate adequate notice period."),
        (7, "high", f"{contains_any('lower(text)', lx.BROAD_IP)} and not {contains_any('lower(text)', lx.IP_LIMITS)}", "broad_ip_assignment", "Broad IP assignment without clear scope limitation.", "Limit IP assignment to work product created specifically under this agreement."),
    ):
        parts.append(f"select doc_id, {row(rule, level, cat, q(desc), q(sug))} from {source} where {test}")
    n = n_hits("lower(text)", lx.AMBIGUOUS)
    said = f"'Document contains ' || {n} || ' potentially ambiguous phrases (e.g., ''reasonable efforts'', ''best efforts'').'"
    parts.append(f"select doc_id, {row(9, 'low', 'ambiguous_language', said, q('Consider defining ambiguous terms or replacing with specific criteria.'))} from {source} where {n} >= 2")
    return {"rk": " union all ".join(parts)}


RISK_ORDER = "row_number() over (partition by doc_id order by severity, rule_ord, coalesce(clause_seq, -1), part)"

#: Runs of word characters with a letter outside ASCII become one underscore: Java's Unicode boundaries then fall where RE2's do.
_OTHER = r"[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2C1}\x{300}-\x{1FFF}\x{2C00}-\x{2DFF}\x{3040}-\x{D7FF}]"
PLAIN = rf"regexp_replace(coalesce(text, ''), '\w*{_OTHER}(?:\w|{_OTHER})*', '_', 'g')"
TOKENS = rf"list_transform(regexp_extract_all({PLAIN}, '\b[a-zA-Z''-]+\b'), lambda x: lower(x))"
WORD_TOKENS = rf"list_transform(regexp_extract_all({PLAIN}, '\b[a-zA-Z][a-zA-Z''-]*[a-zA-Z]\b|\b[a-zA-Z]\b'), lambda x: lower(x))"
TERMS = f"list_filter({TOKENS}, lambda w: length(w) >= 3 and not list_contains({listed(lx.STOP_WORDS)}, w))"


def syllables(c: str) -> str:
    """The estimate for a lower-case word column."""
    s = f"(case when {c} like '%e' and {c} not like '%le' then {c}[1:-2] else {c} end)"
    n0 = f"len(regexp_extract_all({s}, '[aeiouy]+'))"
    n1 = f"(case when {s} like '%ed' and length({s}) > 3 and {s}[-3:-3] not in ('t', 'd') then greatest(1, {n0} - 1) else {n0} end)"
    n2 = f"(case when {s} like '%es' and length({s}) > 3 and not ({s}[-3:-3] in ('s', 'z') or {s}[-4:-3] in ('sh', 'ch', 'th')) then greatest(1, {n1} - 1) else {n1} end)"
    return f"(case when length({c}) = 0 then 0 when length({c}) <= 3 then 1 else greatest(1, {n2} + regexp_matches({s}, '[^aeiou]ious$|[^aeiou]eous$')::int) end)"


def ocr(c: str) -> str:
    for pattern, new in lx.OCR:
        c = f"regexp_replace({c}, {q(pattern)}, {q(new)}, 'g')"
    return c


def clean(c: str) -> str:
    c = f"nfc_normalize(coalesce({c}, ''))"
    for old, new in (("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("–", "-"), ("—", "--"), ("…", "..."), ("\xa0", " ")):
        c = f"replace({c}, {q(old)}, {q(new)})"
    c = rf"regexp_replace(regexp_replace({ocr(c)}, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')"
    return strip(f"array_to_string(list_transform(string_split({c}, chr(10)), lambda l: {strip('l')}), chr(10))")


def sentences(c: str) -> str:
    """Cut sentences of a cleaned text as a list, short fragments not yet joined: guarded ends are hidden first."""
    flat = strip(rf"regexp_replace({c}, '\s+', ' ', 'g')")
    guards = "|".join(p.removesuffix(r"\.").removesuffix(".") if p.endswith(r"\.") else p for p in lx.NOT_AFTER)
    hidden = rf"""regexp_replace({flat}, {q("((?:" + guards + r")\.)\s+([A-Z(" + '"' + "])")}, '\1' || chr(2) || '\2', 'g')"""
    return rf"""list_filter(list_transform(string_split(regexp_replace({hidden}, '([.!?])\s+([A-Z("])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: {strip("replace(s, chr(2), ' ')")}), lambda s: s <> '')"""


SUMMARY_SENTENCES = rf"""list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+([A-Z"“])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: {strip("s")}), lambda s: length(s) >= 15)"""
SUMMARY_WORDS = f"list_filter(regexp_extract_all(lower(s), '[a-z]+'), lambda w: length(w) > 2 and not list_contains({listed(lx.SUMMARY_STOP_WORDS)}, w))"


def summary_tables(source: str) -> dict[str, str]:
    """Tables `ss` of sentences and `tf`, `doc` of weights for source(doc_id, text)."""
    return {
        "ss0": f"select doc_id, {SUMMARY_SENTENCES} as l from {source}",
        "ss1": "select doc_id, unnest(range(len(l)))::int as position, unnest(l) as s from ss0",
        "ss": f"select *, {SUMMARY_WORDS} as w, count(*) over (partition by doc_id) as sents from ss1",
        "tf": "select doc_id, position, term, count(*) as n, min(i) as i from (select doc_id, position, unnest(w) as term, unnest(range(len(w))) as i from ss) group by doc_id, position, term",
        "bt": "select doc_id, term, count(*) as df, sum(n) as n, min(position::bigint * 1000000000 + i) as first from tf group by doc_id, term",
        "idf": "select bt.*, ln((1 + sents)::double / (1 + df)) + 1 as idf from bt join (select distinct doc_id, sents from ss) using (doc_id)",
        "doc": "select *, n::double / max(n) over (partition by doc_id) * idf as weight from idf",
        "st": "select tf.doc_id, position, tf.term, tf.n::double / max(tf.n) over (partition by tf.doc_id, position) * idf as weight, weight as dw from tf join doc using (doc_id, term)",
        "base": "select doc_id, position, sum(st.weight * dw) / (sqrt(sum(st.weight * st.weight)) * any_value(dn)) as cosine from st join (select doc_id, sqrt(sum(weight * weight)) as dn from doc group by doc_id) using (doc_id) group by doc_id, position",
        "sc": f"select ss.doc_id, ss.position, s as text, case when len(w) > 0 then cosine + (case when {contains_any('lower(s)', lx.BOOST)} then 0.2::double else 0 end) + (case when ss.position / greatest(sents - 1, 1) <= 0.15 or ss.position / greatest(sents - 1, 1) >= 0.85 then 0.1::double else 0 end) else 0 end as score from ss left join base using (doc_id, position)",
    }
