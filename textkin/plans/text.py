"""Cleaning, normalising and tokenising plans, over documents, pages and short names."""

from __future__ import annotations

from ..functions import dictionaries as D
from .dialect import plan, quoted

#: Text as pieces that join back to it: words, runs of signs, runs of white space.
PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+|\s+"


def between(p: str) -> str:
    """A pattern between other signs than those of words; its groups come second, the signs first and last."""
    return rf"(^|[^\p{{L}}\p{{N}}_]){p}([^\p{{L}}\p{{N}}_]|$)"


def names(d) -> str:
    """(id, name): part's names, and the fixed names with negative ids."""
    rows = ", ".join(f"({-i}, {quoted(n)})" for i, n in enumerate(D.NAMES, 1))
    return f"(SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS name FROM part UNION ALL SELECT CAST(id AS BIGINT), name FROM {d.values(rows, 'id, name')})"


def mapped(d, x: str, table: dict[str, tuple[str, ...]]) -> str:
    """Text x with each word that is in a table's values replaced by its key; other pieces stay."""
    cases = " ".join(f"WHEN lower(x) IN ({', '.join(map(quoted, v))}) THEN {quoted(k)}" for k, v in table.items())
    return d.join(d.each(d.extract_all(x, PIECE), f"CASE {cases} ELSE x END"), "")


def spaces(d, x: str) -> str:
    return f"trim({d.replace(x, r'[ \t\n\r\f\x0B]+', ' ')})"


def no_html(d, x: str) -> str:
    return d.replace(d.replace(x, r"<[^>]+>", " "), r"&[a-zA-Z0-9#]+;", " ")


def no_signs(d, x: str) -> str:
    return d.replace(d.replace(x, r"[|]{2,}|_{3,}|\.{4,}|—{2,}", " "), r"[^\p{L}\p{N}_\s\-.,()\[\]]", " ")


def cleaned(d, x: str) -> str:
    return spaces(d, no_signs(d, no_html(d, x)))


@plan("html_strip")
def _(d):
    return f"SELECT page_id, {spaces(d, no_html(d, 'html'))} AS text FROM pages"


@plan("special_chars")
def _(d):
    return f"SELECT doc_id, {no_signs(d, 'text')} AS text FROM documents"


@plan("clean_text")
def _(d):
    return f"SELECT id, name AS raw, {no_html(d, 'name')} AS html_cleaned, {no_signs(d, no_html(d, 'name'))} AS special_cleaned, {cleaned(d, 'name')} AS normalized FROM {names(d)}"


@plan("cleaning_stats")
def _(d):
    return f"SELECT doc_id, n AS length_before, m AS length_after, n - m AS removed, round(100.0e0 * (n - m) / nullif(n, 0), 2) AS removed_percent FROM (SELECT doc_id, CAST(length(text) AS BIGINT) AS n, CAST(length({cleaned(d, 'text')}) AS BIGINT) AS m FROM documents)"


@plan("protect_tokens")
def _(d):
    # protected tokens come back in their fixed case
    table = {t: (t.lower(),) for t in D.PROTECTED if t.isalpha()}
    return f"SELECT id, {spaces(d, mapped(d, no_html(d, 'name'), table))} AS name FROM {names(d)}"


@plan("unit_names")
def _(d):
    return f"SELECT id, {mapped(d, 'name', D.UNIT_NAMES)} AS name FROM {names(d)}"


@plan("abbrev_expand")
def _(d):
    return f"SELECT id, {mapped(d, 'name', D.ABBREVIATIONS)} AS name FROM {names(d)}"


def reverse_synonyms(extra: dict[str, tuple[str, ...]] | None = None) -> dict[str, str]:
    """synonym -> canonical form; of two that name a synonym the later wins. `extra` adds a caller's own."""
    return {v: k for k, vs in (D.SYNONYMS | (extra or {})).items() for v in vs}


def canonical(d, x: str, extra: dict[str, tuple[str, ...]] | None = None) -> str:
    """Text x with synonyms as their canonical forms, a capital kept: phrases first, by regular expressions, then words, by a lookup."""
    table = reverse_synonyms(extra)
    for phrase in sorted((k for k in table if " " in k), key=lambda k: (-len(k), k)):
        for form, by in ((phrase, table[phrase]), (phrase.capitalize(), table[phrase].capitalize())):
            x = d.replace(x, between(f"({form})"), d.ref(1) + by + d.ref(3))
    words = {k: v for k, v in table.items() if " " not in k}
    low = " ".join(f"WHEN x = {quoted(k)} THEN {quoted(v)}" for k, v in words.items())
    high = " ".join(f"WHEN x = {quoted(k.capitalize())} THEN {quoted(v.capitalize())}" for k, v in words.items())
    return d.join(d.each(d.extract_all(x, PIECE), f"CASE {low} {high} ELSE x END"), "")


@plan("synonyms")
def _(d):
    return f"SELECT id, {canonical(d, 'name')} AS name FROM {names(d)}"


@plan("term_unify")
def _(d):
    x = "name"
    for by, variants in D.TERM_VARIANTS.items():
        for v in variants:
            if v != by:
                x = d.replace(x, between(f"({v}|{v.capitalize()})"), d.ref(1) + by + d.ref(3))
    return f"SELECT id, {x} AS name FROM {names(d)}"


@plan("canonical_lookup")
def _(d):
    # the canonical form of each word that has one; with a synonym that the caller added
    table = reverse_synonyms({"смартфон": ("телефон", "трубка")})
    rows = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in table.items() if " " not in k)
    return f"SELECT id, word, form FROM (SELECT id, {d.explode(d.distinct(d.words('name')))} AS word FROM {names(d)}) JOIN {d.values(rows, 'synonym, form')} ON synonym = word"


@plan("num_mask")
def _(d):
    return f"SELECT id, {d.replace(d.replace('name', r'[0-9]+(?:[.,][0-9]+)?\s*[-–—]\s*[0-9]+(?:[.,][0-9]+)?', '<NUM>-<NUM>'), r'(^|\s)[0-9]+(?:[.,][0-9]+)?', d.ref(1) + '<NUM>')} AS name FROM {names(d)}"


@plan("normalize_text")
def _(d):
    return f"SELECT id, {spaces(d, mapped(d, mapped(d, 'name', D.UNIT_NAMES), D.ABBREVIATIONS))} AS name FROM {names(d)}"


@plan("preprocess")
def _(d):
    return f"SELECT id, {canonical(d, mapped(d, mapped(d, cleaned(d, 'name'), D.UNIT_NAMES), D.ABBREVIATIONS))} AS name FROM {names(d)}"


@plan("tech_specs")
def _(d):
    return f"SELECT id, {d.join(d.extract_all('name', r'\(([^)]+)\)', 1), '; ')} AS bracketed, {d.join(d.extract_all('name', r'[0-9]+(?:[.,][0-9]+)?\s*[-–—]\s*[0-9]+(?:[.,][0-9]+)?'), '; ')} AS ranges FROM {names(d)}"


#: A colour with a word that changes its shade before or after it, and a colour alone, between other signs.
SHADED = rf"((?:{'|'.join(sorted(D.COLOUR_MODIFIERS, key=len, reverse=True))})[-\s](?:{'|'.join(sorted(D.COLOUR_WORDS, key=len, reverse=True))})|(?:{'|'.join(sorted(D.COLOUR_WORDS, key=len, reverse=True))})[-\s](?:{'|'.join(sorted(D.COLOUR_MODIFIERS, key=len, reverse=True))}))"
PLAIN = rf"({'|'.join(sorted(D.COLOUR_WORDS, key=len, reverse=True))})"


def colours(d, x: str) -> str:
    """The colour phrases of text x, shaded ones first: in lower case, a hyphen as a space."""
    rest = d.replace(f"lower({x})", between(SHADED), d.ref(1) + " " + d.ref(3))
    shaded = d.each(d.extract_all(f"lower({x})", between(SHADED), 2), "replace(x, '-', ' ')")
    return d.concat(shaded, d.extract_all(rest, between(PLAIN), 2))


@plan("colors")
def _(d):
    marked = d.replace(d.replace("lower(name)", between(SHADED), d.ref(1) + "<COLOR>" + d.ref(3)), between(PLAIN), d.ref(1) + "<COLOR>" + d.ref(3))
    one = d.replace(marked, r"<COLOR>(\s*<COLOR>)+", "<COLOR>")
    return f"SELECT id, trim({one}) AS name, {d.join(d.sort(d.distinct(colours(d, 'name'))), ',')} AS colors_found, {d.size(colours(d, 'name'))} AS colors_count, {d.size(colours(d, 'name'))} > 0 AS has_colors FROM {names(d)}"


@plan("color_stats")
def _(d):
    return f"SELECT color, count(*) AS n FROM (SELECT {d.explode(colours(d, 'name'))} AS color FROM {names(d)}) GROUP BY color"


@plan("inches")
def _(d):
    g = [d.number(d.extract("name", r'([0-9]+)-([0-9]+)/([1-9][0-9]*)"', k)) for k in (1, 2, 3)]
    return f"SELECT id, round({g[0]} + {g[1]} / {g[2]}, 4) AS inches, round(({g[0]} + {g[1]} / {g[2]}) * 25.4e0, 2) AS millimetres FROM {names(d)}"


@plan("dimensions")
def _(d):
    return f"SELECT id, {d.replace('name', r'([0-9]+)\s*[хx×]\s*([0-9]+)\s*(мм|см|м)?', f'dims=[{d.ref(1)},{d.ref(2)}]')} AS name FROM {names(d)}"


@plan("measurements")
def _(d):
    p = r"([0-9]+(?:[.,][0-9]+)?)\s*(мм|см|кг|мл|кВт|Вт|шт|бар|Гц|м|г|т|л|В|А)"
    return f"SELECT id, {d.join(d.extract_all('name', p, 1), ';')} AS amounts, {d.join(d.extract_all('name', p, 2), ';')} AS units FROM {names(d)}"


@plan("ranges")
def _(d):
    return f"SELECT id, {d.replace('name', r'([0-9]+)\s*[-–]\s*([0-9]+)\s*°C', f'range_{d.ref(1)}-{d.ref(2)}-c')} AS name FROM {names(d)}"


@plan("ratios")
def _(d):
    a, b = (d.number(d.extract("name", r"([0-9]+):([0-9]+)", k)) for k in (1, 2))
    return f"SELECT id, {a} / nullif({b}, 0) AS ratio, {d.replace('name', r'([0-9]+):([0-9]+)', f'ratio_{d.ref(1)}-{d.ref(2)}')} AS name FROM {names(d)}"


@plan("fractions")
def _(d):
    a, b = (d.number(d.extract("name", r"([0-9]+)/([0-9]+)", k)) for k in (1, 2))
    return f"SELECT id, {a} / nullif({b}, 0) AS fraction, {d.replace('name', r'([0-9]+)/([0-9]+)', f'frac_{d.ref(1)}-{d.ref(2)}')} AS name FROM {names(d)}"


@plan("standards")
def _(d):
    p = r"(?:ГОСТ|гост)\s*([РP]?)\s*([0-9]+)(?:\.([0-9]+))?(?:-([0-9]+))?"
    return f"SELECT id, {', '.join(f'nullif({d.extract('name', p, k)}, {quoted('')}) AS {n}' for k, n in ((1, 'category'), (2, 'number'), (3, 'part'), (4, 'year')))} FROM {names(d)} WHERE {d.matches('name', p)}"


@plan("articles")
def _(d):
    p = r"[A-Za-zА-Яа-я0-9]+(?:[-/][A-Za-zА-Яа-я0-9]+)+"
    return f"SELECT id, {d.explode(d.where(d.extract_all('name', p), d.matches('x', '[0-9]')))} AS article FROM {names(d)}"


@plan("code_validate")
def _(d):
    return f"SELECT id, {d.matches('name', r'ГОСТ\s+[0-9]+(-[0-9]{2,4})?$')} AS is_gost, {d.matches('name', r'^ТУ\s+[0-9.\-]+$')} AS is_tu, {d.matches('name', r'(DN|PN)[0-9]+')} AS has_nominal FROM {names(d)}"


@plan("lemma_fallback")
def _(d):
    return f"SELECT doc_id, {d.explode(d.words('text'))} AS lemma FROM documents"


@plan("stopword_filter")
def _(d):
    kept = d.where(d.words("text"), f"length(x) >= 2 AND x NOT IN ({', '.join(map(quoted, D.STOP_WORDS))})")
    return f"SELECT doc_id, {d.size(kept)} AS n_kept, {d.size(d.words('text'))} AS n_all FROM documents"


@plan("tokenize_simple")
def _(d):
    return f"SELECT doc_id, {d.size(d.extract_all('text', r'\S+'))} AS n_tokens, {d.join(d.slice(d.extract_all('text', r'\S+'), 5), '|')} AS first_five FROM documents"


TECHNICAL = r"[МM][0-9]+[хx][0-9]+|(?:ГОСТ|гост)\s*[0-9]+(?:-[0-9]+)?|[0-9]+(?:[.,][0-9]+)?\s*(?:мм|кг|кВт|Вт|шт|бар|В|А)|IP[0-9]{2}|DN[0-9]+|PN[0-9]+"


@plan("tokenize_regex")
def _(d):
    rest = d.extract_all(d.replace("name", TECHNICAL, " "), r"[\p{L}\p{N}_]+")
    return f"SELECT id, {d.join(d.sort(d.distinct(d.extract_all('name', TECHNICAL))), '|')} AS technical, {d.join(rest, '|')} AS words FROM {names(d)}"


@plan("tokenize_technical")
def _(d):
    t = d.extract_all("name", TECHNICAL)
    return f"SELECT id, {d.join(d.where(t, d.matches('x', '^(ГОСТ|гост|DN|PN|IP)')), '|')} AS codes, {d.join(d.where(t, d.matches('x', '^[0-9]')), '|')} AS properties, {d.join(d.where(t, d.matches('x', '^[МM][0-9]')), '|')} AS threads FROM {names(d)}"


@plan("token_stats")
def _(d):
    return f"SELECT count(*) AS n, sum(n) AS total, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT {d.size(d.words('text'))} AS n FROM documents)"


@plan("token_classify")
def _(d):
    product = sorted({w for v in D.CATEGORY_KEYWORDS.values() for w in v})
    return f"""SELECT token, CASE WHEN token IN ({', '.join(map(quoted, product))}) THEN 'product' WHEN token IN ({', '.join(map(quoted, D.STOP_WORDS))}) THEN 'stop'
WHEN {d.matches('token', '^[0-9]+$')} THEN 'number' WHEN {d.matches('token', '[0-9]')} THEN 'article' ELSE 'word' END AS class, count(*) AS n FROM (SELECT {d.explode(d.words('name'))} AS token FROM {names(d)}) GROUP BY 1, 2"""


@plan("split_complex_token")
def _(d):
    return f"SELECT id, {d.explode(d.extract_all('name', r'[^\s,.()\[\]/+\-]+'))} AS piece FROM {names(d)}"


@plan("name_decompose")
def _(d):
    w = d.words("name")
    return f"SELECT id, {d.at(w, '1')} AS product, {d.join(d.where(w, d.matches('x', '[0-9]')), ' ')} AS parameters, {d.size(w)} AS n_tokens FROM {names(d)}"


@plan("numeric_values")
def _(d):
    return f"SELECT id, {d.explode(d.extract_all('name', r'[0-9]+(?:[.,][0-9]+)?'))} AS number FROM {names(d)}"


@plan("search_query_build")
def _(d):
    w = d.words("name")
    return f"SELECT id, {d.join(d.distinct(d.slice(w, 1)))} AS kind, {d.join(d.slice(d.where(w, d.matches('x', '[0-9]')), 3))} AS parameters FROM {names(d)}"


@plan("final_name")
def _(d):
    x = d.replace(d.replace("name", r"(?:ГОСТ|гост|ТУ)\s*[0-9][0-9.\-]*", " "), r"[0-9]+(?:[.,хx][0-9]+)*\s*(?:мм|см|кг|кВт|Вт|шт|бар|В|А|K)?", " ")
    return f"SELECT id, CASE WHEN length({spaces(d, x)}) >= 3 THEN {spaces(d, x)} ELSE name END AS final_name FROM {names(d)}"


@plan("brand_extract")
def _(d):
    # the first known brand that the name holds, in the list's order
    first = " ".join(f"WHEN {d.contains('lower(name)', quoted(b))} THEN {quoted(b)}" for b in D.KNOWN_BRANDS)
    return f"SELECT id, CASE {first} END AS brand FROM {names(d)}"


@plan("norm_fast")
def _(d):
    w = d.where(d.extract_all(d.replace("lower(text)", r"[^\p{L}\p{N}_]", " "), r"\S+"), "length(x) > 2")
    return f"SELECT doc_id, {d.join(w)} AS text FROM documents"


@plan("norm_dbscan")
def _(d):
    w = d.where(d.words(no_html(d, "text")), f"length(x) > 2 AND NOT {d.matches('x', '[0-9]')}")
    return f"SELECT doc_id, {d.join(w)} AS text FROM documents"


@plan("simple_clean")
def _(d):
    return f"SELECT doc_id, {spaces(d, 'lower(text)')} AS text FROM documents"


@plan("snake_case")
def _(d):
    return f"SELECT p_type, lower({d.replace(d.replace('p_type', r'(.)([A-Z][a-z]+)', d.ref(1) + '_' + d.ref(2)), '([a-z0-9])([A-Z])', d.ref(1) + '_' + d.ref(2))}) AS snake FROM part GROUP BY p_type"


def first_group(x: str, groups: dict[str, tuple[str, ...]], other: str, d) -> str:
    return "CASE " + " ".join(f"WHEN {d.matches(f'lower({x})', '|'.join(v))} THEN {quoted(k)}" for k, v in groups.items()) + f" ELSE {quoted(other)} END"


@plan("functional_group")
def _(d):
    return f"SELECT id, {first_group('name', D.FUNCTIONAL_GROUPS, D.OTHER_GROUP, d)} AS functional_group FROM {names(d)}"


@plan("semantic_category")
def _(d):
    return f"SELECT id, {first_group('name', D.SEMANTIC_CLASSES, 'other', d)} AS category FROM {names(d)}"


@plan("complexity")
def _(d):
    s = f"0.5e0 * {d.size(d.extract_all('name', TECHNICAL))} + {d.size(d.where(d.words('name'), d.matches('x', '^(гост|ip|dn|pn)')))} + 0.3e0 * {d.size(d.extract_all('name', r'[0-9]+[.,][0-9]+'))}"
    return f"SELECT id, round({s}, 6) AS score, CASE WHEN {s} >= 5 THEN 'high' WHEN {s} >= 2 THEN 'medium' ELSE 'low' END AS level FROM {names(d)}"


@plan("rule_mining")
def _(d):
    return f"""WITH w AS (SELECT p_type, {d.explode(d.words("p_name"))} AS word FROM part), c AS (SELECT p_type, word, count(*) AS n FROM w GROUP BY p_type, word)
SELECT p_type, word, n FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, word) AS r FROM c) WHERE r <= 10"""


@plan("category_mapping")
def _(d):
    hits = " UNION ALL ".join(f"SELECT p_type, {quoted(k)} AS category, CASE WHEN {d.matches('lower(p_name)', '|'.join(v))} THEN 1 ELSE 0 END AS hit FROM part" for k, v in D.CATEGORY_KEYWORDS.items())
    return f"""WITH s AS ({hits}), t AS (SELECT p_type, category, sum(hit) AS hits, count(*) AS n FROM s GROUP BY p_type, category)
SELECT p_type, category, round(CAST(hits AS DOUBLE) / n, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY hits DESC, category) AS r FROM t) WHERE r = 1"""


@plan("text_profile")
def _(d):
    return f"SELECT round(avg(CASE WHEN {d.matches('text', '[а-яА-Я]')} THEN 1.0e0 ELSE 0.0e0 END), 6) AS cyrillic, round(avg(CASE WHEN {d.matches('text', '[0-9]')} THEN 1.0e0 ELSE 0.0e0 END), 6) AS digits, round(avg({d.size(d.extract_all('text', r'\S+'))}), 6) AS mean_words FROM documents"


@plan("name_merge")
def _(d):
    extra = d.where(d.extract_all("b", r"\S+"), f"NOT {d.has(d.extract_all('a', r'\S+'), 'x')}")
    return f"SELECT id, a || CASE WHEN {d.size(extra)} > 0 THEN ' ' || {d.join(extra)} ELSE '' END AS name FROM (SELECT p_partkey AS id, p_name AS a, p_type AS b FROM part)"


@plan("name_equality")
def _(d):
    return f"SELECT {d.count_if('a = b')} AS equal_raw, {d.count_if('lower(trim(a)) = lower(trim(b))')} AS equal_normalized, count(*) AS n FROM (SELECT p_name AS a, p_type AS b FROM part)"
