"""Typed parameter extraction from names, and what is done with parameters.

Patterns are data: a labelled or bare number with a unit, or a mark. Each is searched in one pass over the name; the
parameters of a name are one array, exploded once."""

from __future__ import annotations

from ..functions import dictionaries as D
from .dialect import plan, quoted
from .text import names


#: Signs that a pattern reads beside its match; RE2 has no look-arounds.
EDGES = r"^[\s,]+|[^\p{L}\p{N}_)]+$"


def forms() -> list[tuple]:
    """(name, pattern, type, default unit, priority, groups of the value, group of the unit) of every pattern."""
    out = [(n, D.measure_pattern(labels, units), kind, unit, priority, (1,), 2) for n, labels, units, kind, unit, priority in D.MEASURES]
    return out + [(n, p, kind, "", priority, (1,), 0) for n, p, kind, priority in D.MARKS] + list(D.FORMS)


def found(d) -> str:
    """(id, ord, name, type, priority, value, unit, m, text): every match of every pattern, in pattern order; m is the whole match."""
    parts = []
    for k, (n, p, kind, unit, priority, groups, unit_group) in enumerate(forms()):
        value = d.extract("m", p, groups[0])
        for g in groups[1:]:
            more = d.extract("m", p, g)
            value += f" || CASE WHEN {more} <> '' THEN {quoted('-' if kind == 'characteristic' else 'x')} || {more} ELSE '' END"
        units = f"coalesce({d.extract('m', p, unit_group)}, '')" if unit_group else "''"
        fields = {"ord": str(k), "pname": quoted(n), "ptype": quoted(kind), "priority": str(priority), "value": value, "unit": units, "default_unit": quoted(unit), "m": d.replace("m", EDGES, "")}
        parts.append(f"SELECT id, {', '.join(f'{x} AS {c}' for c, x in fields.items())}, text FROM (SELECT id, lower(name) AS text, {d.explode(d.extract_all('lower(name)', p, 0))} AS m FROM {names(d)})")
    return " UNION ALL ".join(parts)


def false_positive(d) -> str:
    """Whether a match is false, by what stands within 30 signs of it and by its number; a value of one sign always is."""
    at = "position(m IN text)"
    context = f"substr(text, greatest(1, {at} - 30), length(m) + 30 + least(30, greatest(0, {at} - 1)))"
    cases = [f"(ptype = {quoted(t)} AND {d.matches(context, p)})" for t, p in D.FALSE_CONTEXT.items()]
    cases += [f"(ptype = {quoted(t)} AND ({c}))" for t, c in D.FALSE_NUMBER]
    cases += [
        f"(pname = 'power' AND {d.matches(context, r'[0-9]+k(?:[^\p{L}\p{N}_]|$)')})",
        f"(ptype = 'capacity' AND NOT {d.matches(context, D.BATTERY)})",
        f"(pname = 'temperature' AND (abs(number) > 1000 OR {d.matches(context, r'[a-z][0-9]+[a-z]|elt-[0-9]+|[0-9]+-[0-9]+')}))",
        f"(ptype IN ('voltage', 'current') AND length(replace(replace(value, '.', ''), ',', '')) >= 6)",
        f"(ptype = 'material' AND (length(trim(value)) < 3 OR ({d.matches(context, 'автомат|трансформатор|выключатель')} AND length(trim(value)) < 8)))",
        "length(trim(value)) < 2",
    ]
    return "coalesce(" + " OR ".join(cases) + ", FALSE)"


def params(d) -> str:
    """CTEs f (found, with a number where the value is one) and p (less false matches, with a confidence)."""
    number = d.number("replace(value, ',', '.')")
    c = "0.7e0 + CASE WHEN length(m) > 5 THEN 0.1e0 ELSE 0 END + CASE WHEN unit <> '' THEN 0.1e0 ELSE 0 END + 0.05e0 * priority - CASE WHEN length(m) < 3 THEN 0.2e0 ELSE 0 END"
    sure = f"CASE WHEN pname LIKE '%from_combined' THEN 0.8e0 ELSE round(least(1.0e0, greatest(0.0e0, {c})), 6) END"
    return f"f0 AS ({found(d)}), f AS (SELECT *, {number} AS number, {sure} AS confidence FROM f0), p AS (SELECT * FROM f WHERE NOT {false_positive(d)})"


def deduped(d) -> str:
    """CTE q: of parameters equal in type, value and unit the most confident one, then of those equal in name and type."""
    return f"""{params(d)}, q1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, ptype, value, unit ORDER BY confidence DESC, ord) AS r FROM p) WHERE r = 1),
q AS (SELECT id, ord, pname, ptype, value, unit, number, confidence FROM (SELECT id, ord, pname, ptype, value, unit, number, confidence, row_number() OVER (PARTITION BY id, pname, ptype ORDER BY confidence DESC, ord, value, unit DESC) AS r FROM q1) WHERE r = 1)"""


def realistic() -> str:
    return "CASE " + " ".join(f"WHEN ptype = {quoted(t)} THEN number IS NULL OR number BETWEEN {a!r} AND {b!r}" for t, (a, b) in D.REALISTIC.items()) + " ELSE TRUE END"


OUT = "id, pname, ptype, value, unit"


@plan("extract_params")
def _(d):
    return f"WITH {deduped(d)} SELECT {OUT}, number, confidence FROM q WHERE {realistic()}"


@plan("param_explode")
def _(d):
    return f"WITH {params(d)} SELECT {OUT}, confidence FROM p"


@plan("param_dedupe")
def _(d):
    return f"WITH {deduped(d)} SELECT {OUT}, confidence FROM q"


@plan("param_confidence")
def _(d):
    return f"WITH {params(d)} SELECT ptype, confidence, count(*) AS n FROM p GROUP BY ptype, confidence"


@plan("param_filter_type")
def _(d):
    return f"WITH {deduped(d)} SELECT {OUT} FROM q WHERE ptype IN ('voltage', 'current', 'dimension')"


@plan("param_filter_confidence")
def _(d):
    return f"WITH {deduped(d)} SELECT {OUT} FROM q WHERE confidence >= 0.5e0"


@plan("param_filter_range")
def _(d):
    return f"WITH {deduped(d)} SELECT {OUT} FROM q WHERE number IS NULL OR number BETWEEN 2 AND 100"


@plan("param_realistic")
def _(d):
    return f"WITH {deduped(d)} SELECT {OUT}, {realistic()} AS realistic FROM q"


@plan("param_valid")
def _(d):
    return f"WITH {deduped(d)} SELECT {OUT} FROM q WHERE value <> '' AND coalesce(number, 1) <> 0 AND length(value) <= 100 AND {realistic()}"


@plan("param_index")
def _(d):
    return f"WITH {deduped(d)} SELECT pname, value, count(DISTINCT id) AS n_items, min(id) AS first_item FROM q GROUP BY pname, value"


@plan("index_param_search")
def _(d):
    return f"WITH {deduped(d)} SELECT DISTINCT id FROM q WHERE (pname, value) IN (SELECT 'power', value FROM q WHERE pname = 'power_kw' UNION ALL SELECT 'gost', 'гост 7798-70') OR (pname = 'quantity_pieces' AND number >= 10)"


@plan("unit_convert")
def _(d):
    rows = ", ".join(f"({quoted(u)}, {quoted(b)}, {f!r}e0)" for u, (b, f) in D.UNIT_FACTORS.items())
    return f"WITH {deduped(d)} SELECT {OUT}, base_unit, round(number * factor, 6) AS base_value FROM q JOIN {d.values(rows, 'from_unit, base_unit, factor')} ON from_unit = unit"


@plan("keyword_entities")
def _(d):
    # the first keyword of each material and function that the name holds, and every known brand
    out = []
    for kind, table, c in (("material", D.MATERIAL_WORDS, 0.8), ("function", D.FUNCTION_WORDS, 0.7)):
        for value, words in table.items():
            first = " ".join(f"WHEN {d.contains('lower(name)', quoted(w))} THEN {quoted(w)}" for w in words)
            out.append(f"SELECT id, {quoted(kind)} AS kind, {quoted(value)} AS value, CASE {first} END AS word, {c}e0 AS confidence FROM n")
    brands = d.where(d.array(*map(quoted, D.KNOWN_BRANDS)), d.contains("t", "x"))
    out.append(f"SELECT id, 'brand', word, word, 0.9e0 FROM (SELECT id, {d.explode(brands)} AS word FROM (SELECT id, lower(name) AS t FROM n))")
    return f"WITH n AS (SELECT * FROM {names(d)}) SELECT * FROM ({' UNION ALL '.join(out)}) WHERE word IS NOT NULL"


@plan("param_summary")
def _(d):
    return f"WITH {deduped(d)} SELECT id, count(*) AS n, {d.count_if('confidence >= 0.8e0')} AS high, {d.count_if('confidence >= 0.6e0 AND confidence < 0.8e0')} AS medium, count(DISTINCT ptype) AS n_types FROM q GROUP BY id"


#: Two extractors: confident matches, raised by .05, and measured ones.
SIDES = "a AS (SELECT *, least(1.0e0, confidence + 0.05e0) AS c FROM q WHERE confidence >= 0.85e0), b AS (SELECT *, confidence AS c FROM q WHERE number IS NOT NULL)"


@plan("param_combine")
def _(d):
    return f"WITH {deduped(d)}, {SIDES} SELECT a.id, a.pname, a.ptype, a.value, round(greatest(a.c, b.c), 6) AS confidence FROM a JOIN b ON a.id = b.id AND a.pname = b.pname AND a.ptype = b.ptype"


@plan("param_union")
def _(d):
    return f"WITH {deduped(d)}, {SIDES}, u AS (SELECT *, 1 AS side FROM a UNION ALL SELECT *, 2 FROM b) SELECT id, pname, ptype, value, round(c, 6) AS confidence, side FROM (SELECT *, row_number() OVER (PARTITION BY id, pname, ptype, ord ORDER BY side) AS r FROM u) WHERE r = 1"


@plan("param_priority")
def _(d):
    return f"WITH {deduped(d)}, {SIDES} SELECT id, pname, ptype, value, round(c, 6) AS confidence FROM a UNION ALL SELECT id, pname, ptype, value, round(c, 6) FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.id = b.id AND a.pname = b.pname AND a.ptype = b.ptype)"


@plan("param_post_filter")
def _(d):
    return f"WITH {deduped(d)} SELECT {OUT} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, ord, value) AS r FROM q WHERE confidence >= 0.5e0) WHERE r <= 50"


@plan("param_by_type")
def _(d):
    return f"WITH {deduped(d)} SELECT id, ptype, {d.join(d.sort(d.collect('value')), ',')} AS found_values, round(avg(confidence), 6) AS mean_confidence FROM q GROUP BY id, ptype"


@plan("param_format")
def _(d):
    return f"WITH {deduped(d)} SELECT id, {d.join(d.sort(d.collect(chr(34).join(['pname || ', '']).replace(chr(34), '') + quoted(': ') + ' || value || CASE WHEN unit <> ' + quoted('') + ' THEN ' + quoted(' ') + ' || unit ELSE ' + quoted('') + ' END')), '; ')} AS formatted FROM q GROUP BY id"


@plan("param_analysis")
def _(d):
    return f"WITH {deduped(d)}, n AS (SELECT count(*) AS total FROM {names(d)}) SELECT ptype, count(*) AS n, min(confidence) AS least, max(confidence) AS most, round(avg(confidence), 6) AS mean, round(100.0e0 * count(DISTINCT id) / max(total), 4) AS coverage FROM q CROSS JOIN n GROUP BY ptype"


@plan("param_compare")
def _(d):
    # names with equal sets of types are one class, so the join is of sets, not of names
    return f"""WITH {deduped(d)}, t AS (SELECT id, {d.join(d.sort(d.distinct(d.collect('ptype'))), ',')} AS types FROM q GROUP BY id), s AS (SELECT types, min(id) AS first_id, count(*) AS n_items FROM t GROUP BY types),
x AS (SELECT types, first_id, {d.explode("split(types, ',')")} AS ptype FROM s), c AS (SELECT first_id, count(*) AS n FROM x GROUP BY first_id)
SELECT a.first_id AS a, b.first_id AS b, round(CAST(count(*) AS DOUBLE) / (max(ca.n) + max(cb.n) - count(*)), 6) AS jaccard FROM x a JOIN x b ON a.ptype = b.ptype AND a.first_id < b.first_id JOIN c ca ON ca.first_id = a.first_id JOIN c cb ON cb.first_id = b.first_id GROUP BY a.first_id, b.first_id"""


@plan("param_flags")
def _(d):
    flags = ", ".join(f"max(CASE WHEN ptype = {quoted(t)} THEN 1 ELSE 0 END) AS has_{t}" for t in sorted(D.REALISTIC))
    return f"WITH {deduped(d)} SELECT id, count(*) AS n, {flags} FROM q GROUP BY id"


@plan("ml_token_features")
def _(d):
    return f"""WITH t AS (SELECT id, {d.explode(d.range("1", d.size("ws")))} AS pos, ws FROM (SELECT id, {d.words("name")} AS ws FROM {names(d)})), w AS (SELECT id, CAST(pos AS BIGINT) AS pos, {d.at("ws", "CAST(pos AS INT)")} AS token FROM t)
SELECT id, pos, token, lag(token) OVER (PARTITION BY id ORDER BY pos) AS previous, lead(token) OVER (PARTITION BY id ORDER BY pos) AS following, {d.matches("token", "^[0-9]+$")} AS is_number, CAST(length(token) AS BIGINT) AS n_chars FROM w"""


@plan("param_false_pos")
def _(d):
    return f"WITH {params(d)} SELECT id, pname, value, unit, {false_positive(d)} AS is_false, count(*) AS n FROM f GROUP BY id, pname, value, unit, {false_positive(d)}"


@plan("units_compound")
def _(d):
    p = r"([0-9]+(?:[.,][0-9]+)?)\s*(м³/ч|м3/ч|об/мин|л/мин|км/ч|м/с|кг/м³|кг/м3|л/с|об/с|кг/ч|т/ч)"
    return f"SELECT id, {d.number(f'replace({d.extract("m", p, 1)}, {quoted(",")}, {quoted(".")})')} AS value, {d.extract('m', p, 2)} AS unit FROM (SELECT id, {d.explode(d.extract_all('lower(name)', p, 0))} AS m FROM {names(d)})"


@plan("inches_decimal")
def _(d):
    p = r'([0-9]+(?:[.,][0-9]+)?)\s*(?:"|дюйм|inch)'
    return f"SELECT id, x AS inches, round(x * 25.4e0, 2) AS millimetres FROM (SELECT id, {d.number(f'replace({d.extract("name", p, 1)}, {quoted(",")}, {quoted(".")})')} AS x FROM {names(d)}) WHERE x IS NOT NULL"


@plan("tech_term_stats")
def _(d):
    rows = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in {**{v: k for k, vs in D.TERM_FORMS.items() for v in vs}, **D.TERM_ABBREVIATIONS}.items())
    return f"SELECT base, count(*) AS n, count(DISTINCT id) AS n_items FROM (SELECT id, {d.explode(d.words('name'))} AS w FROM {names(d)}) JOIN {d.values(rows, 'form, base')} ON form = w GROUP BY base"


@plan("param_label")
def _(d):
    # a value of 0 or over 100000 is labelled false
    return f"WITH {deduped(d)} SELECT id, pname, value, CASE WHEN number IS NOT NULL AND (number > 100000 OR number = 0) THEN 0 ELSE 1 END AS label FROM q"
