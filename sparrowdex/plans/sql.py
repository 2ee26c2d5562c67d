"""The SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

import re

from ..functions import text as T
from ..operators import chunking, parsing
from ..operators import wording as W
from . import default_rules as D

PIECE = T.PIECE
WHITE = r"^\s+|\s+$"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '{WHITE}', '', 'g')"


def pieces(c: str) -> str:
    return f"regexp_extract_all({c}, {quoted(PIECE)})"


def tokens(c: str) -> str:
    return f"len({pieces(c)})::INT"


def truncated(c: str, n: str) -> str:
    return f"CASE WHEN len({pieces(c)}) <= {n} THEN {c} ELSE {strip(f'''array_to_string({pieces(c)}[1:{n}], '')''')} END"


def distinct(c: str) -> str:
    """A list without repeats, in order; ``c`` is a column."""
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


def strings(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]::VARCHAR[]"


def low_signal(content: str) -> str:
    lines = f"string_split_regex({content}, '\\r\\n|[\\n\\r]')"
    return f"(len(list_filter({lines}, lambda x: trim(x) <> '' AND NOT regexp_matches(x, {quoted(chunking.WRAPPER)}))) = 0 OR ({tokens(content)} < 12 AND len(regexp_extract_all({content}, '[A-Za-z]{{3,}}')) < 4))"


def rule_test(what: str, how: str, values) -> str:
    if how.startswith("not "):
        return f"NOT {rule_test(what, how[4:], values)}"
    values = list(values) if isinstance(values, list | tuple | set) else [values]
    text = f"lower(coalesce({what}, ''))"
    if how in ("under", "over"):
        return f"coalesce({what} {'<' if how == 'under' else '>'} {values[0]}, false)"
    each = {"contains": lambda v: f"contains({text}, {quoted(v)})", "starts": lambda v: f"starts_with({text}, {quoted(v)})", "ends": lambda v: f"ends_with({text}, {quoted(v)})", "is": lambda v: f"coalesce({what} = {quoted(v)}, false)", "matches": lambda v: f"coalesce(regexp_matches({text}, {quoted(v)}), false)", "has": lambda v: f"list_contains({what}, {quoted(v)})"}
    if how == "has all":
        return "(" + " AND ".join(map(each["has"], values)) + ")"
    if how == "lacks":
        return "NOT (" + " OR ".join(map(each["has"], values)) + ")"
    return "(" + " OR ".join(map(each[how], values)) + ")"


def rule_holds(rule: dict) -> str:
    return " AND ".join(rule_test(*t) for t in rule["when"]) or "true"


def rule_total(rules: list[dict]) -> str:
    groups: dict = {}
    for n, r in enumerate(rules):
        groups.setdefault(r.get("group", n), []).append(r)
    return " + ".join(["0.0::DOUBLE", *("(CASE " + " ".join(f"WHEN {rule_holds(r)} THEN {float(r['add'])}::DOUBLE" for r in members) + " ELSE 0.0 END)" for members in groups.values())])


def rule_first(rules: list[dict], otherwise: str) -> str:
    return "(CASE " + " ".join(f"WHEN {rule_holds(r)} THEN {quoted(r['label'])}" for r in rules) + f" ELSE {quoted(otherwise)} END)"


def rule_labels(rules: list[dict]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {rule_holds(r)} THEN {quoted(r['label'])} END" for r in rules) + "], lambda x: x IS NOT NULL)"


def source_name(path: str, name: str, kind: str) -> str:
    p = f"lower(replace({path}, '\\', '/'))"
    of = lambda x: f"(starts_with({p}, '{x}/') OR contains({p}, '/{x}/'))"
    return f"CASE WHEN {of('design_system')} THEN 'design_system' WHEN {of('user_docs')} THEN 'user_docs' WHEN coalesce({name}, '') <> '' THEN {name} WHEN {kind} IS NULL OR {kind} = 'repo_markdown' THEN 'devdocs_repo' END"


def canonical(path: str) -> str:
    return rf"regexp_replace(regexp_replace({strip(path)}, '^[./]+', ''), '^versioned_docs/version-[^/]+/(.)', '\1')"


def said(sentence: str, **values: str) -> str:
    """A sentence with expressions in its places; null if one of them is."""
    parts = re.split(r"\{(\w+)\}", sentence)
    return "(" + " || ".join(quoted(x) if i % 2 == 0 else f"({values[x]})::VARCHAR" for i, x in enumerate(parts) if x or i == 0) + ")"


def slug(c: str) -> str:
    s = f"regexp_replace(regexp_replace(lower({strip(c)}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"CASE WHEN coalesce({s}, '') = '' THEN 'page' ELSE {s} END"


# ------------------------------------------------------------- shared relations



def folded(name: str, sections: str, most: int, overlap: int) -> str:
    """Relation ``name`` (sid, chunk_order, content, start_offset, end_offset): the chunks of ``sections`` (sid, prefix, content).

    A step of the recursion takes one part of every section: it joins the open chunk or closes it.
    """
    p = lambda x: f"{name}_{x}"
    room = f"greatest({most} - {tokens('prefix')} - {overlap} - 1, 1)"
    piece = lambda i: f"(({i}) * n // k)"
    left, right = r"regexp_replace({}, '^\s+', '')", r"regexp_replace({}, '\s+$', '')"
    text = f"CASE WHEN i = 0 THEN {left.format('raw')} ELSE raw END"
    body = lambda held: f"prefix || CASE WHEN overlap = '' THEN {held} ELSE overlap || chr(10) || chr(10) || {held} END"
    rest = "CASE WHEN starts_with(out, prefix) THEN out[length(prefix) + 1:] ELSE out END"
    tail = strip(f"array_to_string({pieces(rest)}[greatest(len({pieces(rest)}) - {overlap} + 1, 1):], '')") if overlap else "''"
    return f"""
{p('in')} AS (SELECT sid, CASE WHEN {tokens('prefix')} >= {most} THEN '' ELSE prefix END AS prefix, content FROM {sections}),
{p('blocks')} AS (SELECT sid, prefix, unnest(b) AS block, unnest(generate_series(1, len(b))) AS bn FROM (SELECT sid, prefix, string_split(content, chr(10) || chr(10)) AS b FROM {p('in')})),
{p('placed')} AS (SELECT *, coalesce(sum(length(block) + 2) OVER (PARTITION BY sid ORDER BY bn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS place FROM {p('blocks')}),
{p('cut')} AS (SELECT sid, bn, place, w, len(w) AS n, greatest(ceil(len(w) / {room})::INT, 1) AS k FROM (SELECT *, {pieces('block')} AS w FROM {p('placed')} WHERE {strip('block')} <> '')),
{p('raw')} AS (SELECT sid, bn, k, i, array_to_string(w[{piece('i')} + 1:{piece('i + 1')}], '') AS raw, place + length(array_to_string(w[1:{piece('i')}], '')) AS s FROM (SELECT *, unnest(generate_series(0, k - 1)) AS i FROM {p('cut')})),
{p('parts')} AS MATERIALIZED (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY bn, i) AS no, CASE WHEN i = k - 1 THEN {right.format(text)} ELSE {text} END AS text, i > 0 AS more, s, s + length(raw) AS e FROM {p('raw')}),
{p('n')} AS MATERIALIZED (SELECT sid, any_value(prefix) AS prefix, count(no) AS n FROM {p('in')} LEFT JOIN {p('parts')} USING (sid) GROUP BY sid),
{p('steps')} AS (SELECT sid, 0::BIGINT AS i, NULL::VARCHAR AS texts, NULL::INT AS s, NULL::INT AS e, ''::VARCHAR AS overlap, 0::INT AS ord, NULL::VARCHAR AS c, NULL::INT AS c_ord, NULL::INT AS c_s, NULL::INT AS c_e FROM {p('n')}
 UNION ALL SELECT sid, i + 1, CASE WHEN fits THEN held WHEN ended THEN NULL ELSE nullif(fresh, '') END, CASE WHEN fits THEN coalesce(s, ps) WHEN fresh <> '' THEN ps END, CASE WHEN fits OR fresh <> '' THEN pe END,
 CASE WHEN fits OR out IS NULL THEN overlap WHEN low THEN '' ELSE {tail} END, CASE WHEN fits OR out IS NULL OR low THEN ord ELSE ord + 1 END, CASE WHEN NOT (fits OR low) THEN out END, ord, s, e
 FROM (SELECT *, CASE WHEN out IS NOT NULL THEN {low_signal('out')} END AS low FROM (SELECT *, CASE WHEN NOT fits AND texts IS NOT NULL THEN {strip(body('texts'))} END AS out, CASE WHEN NOT fits THEN {left.format('ptext')} END AS fresh
 FROM (SELECT *, NOT ended AND {tokens(body('held'))} <= {most} AS fits FROM (SELECT r.*, m.prefix, p.text AS ptext, p.s AS ps, p.e AS pe, p.no IS NULL AS ended, CASE WHEN r.texts IS NULL THEN p.text WHEN p.more THEN r.texts || p.text ELSE r.texts || chr(10) || chr(10) || p.text END AS held
 FROM {p('steps')} r JOIN {p('n')} m USING (sid) LEFT JOIN {p('parts')} p ON p.sid = r.sid AND p.no = r.i + 1 WHERE r.i <= m.n))))),
{name} AS MATERIALIZED (SELECT sid, c_ord AS chunk_order, c AS content, c_s AS start_offset, c_e AS end_offset FROM {p('steps')} WHERE c IS NOT NULL)"""


CHUNKS = f"""
docs AS (SELECT doc_id, source, 'docs/' || coalesce(source, 'none') || '/' || doc_id || '.md' AS source_path, sha1('document::docs/' || coalesce(source, 'none') || '/' || doc_id || '.md') AS document_id, {strip("coalesce(text, '')")} AS body FROM documents WHERE doc_id IS NOT NULL),
secs AS (SELECT *, sha1('section::' || document_id || '::0::__root__') AS section_id FROM docs WHERE body <> ''),
asec AS (SELECT section_id AS sid, '' AS prefix, body AS content FROM secs),
{folded("cut", "asec", 400, 60).strip()},
chunks AS MATERIALIZED (SELECT sha1('chunk::' || section_id || '::' || chunk_order || '::' || content) AS id, section_id, document_id, doc_id, source, source_path, 'Document ' || doc_id AS title, chunk_order, start_offset, end_offset, content, {tokens('content')} AS token_count FROM secs JOIN cut ON sid = section_id)"""

PROFILES = f"""
asked AS (SELECT 'b' || item_id AS qid, coalesce(text, '') AS raw_query, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM benchmark WHERE item_id IS NOT NULL),
asked2 AS (SELECT qid, raw_query, w, list_filter(w, lambda x: NOT list_contains({strings(D.STOPWORDS)}, x)) AS k FROM asked),
asked3 AS (SELECT qid, raw_query, CASE WHEN len(k) > 0 THEN k ELSE w END AS k FROM asked2),
asked4 AS (SELECT qid, raw_query, {distinct('k')} AS tokens FROM asked3),
asked5 AS (SELECT *, flatten(list_transform(tokens, lambda t: list_concat(list_concat([t], CASE WHEN ends_with(t, 's') AND length(t) > 3 THEN [t[1:-2]] ELSE []::VARCHAR[] END), coalesce({"map {" + ", ".join(f"{quoted(k)}: {strings(v)}" for k, v in D.ALIASES.items()) + "}"}[t], []::VARCHAR[])))) AS e,
 list_concat(list_transform(generate_series(1, len(tokens) - 2), lambda i: array_to_string(tokens[i:i + 2], ' ')), list_transform(generate_series(1, len(tokens) - 1), lambda i: array_to_string(tokens[i:i + 1], ' '))) AS ph FROM asked4),
asked6 AS (SELECT qid, raw_query, tokens, CASE WHEN len(tokens) > 0 THEN array_to_string(tokens, ' ') ELSE {strip('raw_query')} END AS normalized, {distinct('e')} AS expanded, {distinct('ph')} AS phrases,
 regexp_extract_all(raw_query, {quoted(T.FILE_ANCHOR)}, 1) AS fh FROM asked5),
profiles AS (SELECT qid, raw_query, tokens, normalized, expanded, phrases, {distinct('fh')} AS file_hints, {rule_first(D.CONCEPTUAL, 'keyword')} AS intent, {rule_labels(D.FAMILIES)} AS families, {rule_first(D.TASK, 'general')} AS task FROM asked6)"""


def terms(c: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({c})), '[\\p{{L}}\\p{{N}}]+')"


SCORED = f"""
fields AS (SELECT id AS chunk_id, [{{'field': 0, 'terms': {terms('content')}}}, {{'field': 1, 'terms': {terms('source_path')}}}, {{'field': 2, 'terms': {terms('title')}}}, {{'field': 3, 'terms': []::VARCHAR[]}}] AS f FROM chunks),
lengths AS (SELECT chunk_id, list_sum(list_transform(f, lambda x: len(x.terms))) AS dl FROM fields),
one AS (SELECT chunk_id, unnest(f) AS x FROM fields),
occ AS (SELECT chunk_id, x.field AS field, unnest(x.terms) AS term, unnest(generate_series(1, len(x.terms))) AS pos FROM one),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
passes AS (SELECT qid, 1 AS pass, unnest(tokens) AS phrase, len(tokens) AS needed FROM profiles WHERE len(tokens) > 0 UNION ALL SELECT qid, 1, normalized, 1 FROM profiles WHERE len(tokens) = 0
 UNION ALL SELECT qid, 2, normalized, 1 FROM profiles WHERE len(tokens) > 1 UNION ALL SELECT qid, 3, unnest(expanded), 1 FROM profiles WHERE len(tokens) > 1),
planned AS (SELECT qid, pass, needed, {terms('phrase')} AS words FROM passes),
wanted AS (SELECT DISTINCT words FROM planned WHERE len(words) > 0),
wanted_terms AS (SELECT words, unnest(words) AS term, unnest(generate_series(1, len(words))) AS nth FROM wanted),
places AS (SELECT words, chunk_id, field, pos - nth AS start FROM occ JOIN wanted_terms USING (term) GROUP BY ALL HAVING count(*) = len(words)),
hits AS (SELECT words, chunk_id, count(*) AS tf FROM places GROUP BY ALL),
dfs AS (SELECT words, count(*) AS df FROM hits GROUP BY ALL),
parts AS (SELECT words, chunk_id, (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS part FROM hits JOIN dfs USING (words) JOIN lengths USING (chunk_id), corpus),
scored AS (SELECT qid, pass, chunk_id, round(-sum(part), 9) AS score FROM planned JOIN parts USING (words) GROUP BY qid, pass, needed, chunk_id HAVING count(*) >= needed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, pass ORDER BY score, chunk_id) AS r FROM scored),
candidates AS (SELECT qid, chunk_id, pass, score FROM ranked WHERE r <= 50 QUALIFY row_number() OVER (PARTITION BY qid, chunk_id ORDER BY pass) = 1)"""


def overlap(field: str, needles: str) -> str:
    return f"len(list_filter({needles}, lambda t: contains({field}, t)))::INT"


def _signals() -> str:
    fields = ("title", "section", "heading", "path")
    inside = f"""CASE WHEN normalized <> '' AND contains((SELECT CASE WHEN len(k) > 0 THEN array_to_string({distinct('k')}, ' ') ELSE {strip('document_title')} END FROM (SELECT list_filter(list_transform(regexp_extract_all(document_title, '[A-Za-z0-9_]+'), lambda x: lower(x)), lambda x: NOT list_contains({strings(D.STOPWORDS)}, x)) AS k)), normalized) THEN 1 ELSE 0 END"""
    low = ", ".join([*(f"{overlap(f + '_text', 'expanded')} AS {f}_overlap" for f in fields), *(f"{overlap(f + '_text', 'phrases')} AS {f}_phrase_hits" for f in fields)])
    totals = {"subsystem_bonus": D.SUBSYSTEM, "concept_page_bonus": D.CONCEPT_PAGE, "plugin_type_penalty": D.PLUGIN_TYPE, "family_bonus": D.FAMILY_BONUS, "section_focus_bonus": D.SECTION_FOCUS, "incidental_penalty": D.INCIDENTAL, "example_penalty": D.EXAMPLE, "quality_adjustment": D.QUALITY, "generic_penalty": D.GENERIC}
    order = ["canonical_bonus", *totals, "anchor_bonus"]
    return f"""
joined AS (SELECT c.qid, c.chunk_id, c.pass, c.score, h.source_path, {source_name('h.source_path', 'h.source', "'repo_markdown'")} AS source_name, h.title AS document_title, h.content, h.token_count, p.* EXCLUDE (qid),
 lower(h.title) AS title_text, '' AS section_text, '' AS heading_text, lower(h.source_path) AS path_text, NULL::VARCHAR AS section_title FROM candidates c JOIN chunks h ON h.id = c.chunk_id JOIN profiles p USING (qid)),
sig1 AS (SELECT *, greatest(0.0, -score) AS lexical_score, {low} FROM joined),
sig2 AS (SELECT *, len(list_filter(expanded, lambda t: contains(path_text, t) OR contains(title_text, t)))::INT AS context_hits, CASE WHEN normalized = '' THEN 0 ELSE 0 END AS exact_heading_phrase, {inside} AS exact_title_phrase, section_overlap + heading_overlap AS focus,
 section_phrase_hits + heading_phrase_hits AS phrase_focus, heading_overlap + section_phrase_hits + heading_phrase_hits AS flow_focus, len(families) AS n_families, length(path_text) - length(replace(path_text, '/', '')) AS path_depth FROM sig1),
sig3 AS (SELECT *, focus - title_overlap AS focus_lead FROM sig2),
sig4 AS (SELECT *, {D.CANONICAL[0]}::DOUBLE AS canonical_bonus, {', '.join(f'{rule_total(r)} AS {n}' for n, r in totals.items())}, 0.0::DOUBLE AS anchor_bonus FROM sig3),
signals AS (SELECT *, lexical_score + {' + '.join(f'{c} * {float(w)}::DOUBLE' for c, w in D.WEIGHTS.items())} + {' + '.join(order)} AS weighted_score FROM sig4),
single AS (SELECT * FROM signals QUALIFY row_number() OVER (PARTITION BY qid, source_path ORDER BY weighted_score DESC, score, token_count, chunk_id) = 1),
results AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY weighted_score DESC, score, token_count, chunk_id) AS rank FROM single QUALIFY rank <= 5)"""


SIGNALS = _signals()
_SHOWN = ("title_overlap", "section_overlap", "heading_overlap", "path_overlap", "title_phrase_hits", "section_phrase_hits", "heading_phrase_hits", "path_phrase_hits", "context_hits", "exact_heading_phrase", "exact_title_phrase", "intent", "canonical_bonus", "subsystem_bonus", "concept_page_bonus", "plugin_type_penalty", "family_bonus", "section_focus_bonus", "incidental_penalty", "example_penalty", "quality_adjustment", "generic_penalty", "anchor_bonus")

GRADED = f"""
cases AS (SELECT 'b' || item_id AS id, item_id, text AS query, CASE WHEN item_id % 5 > 0 THEN 'bucket' || (item_id % 5) END AS bucket, CASE WHEN item_id % 2 = 0 THEN 'even' END AS query_style, 'c' || (item_id % 3) AS concept_id,
 CASE WHEN item_id % 3 = 0 THEN ['src' || (item_id % 20), 'src0'] ELSE []::VARCHAR[] END AS psn, CASE WHEN item_id % 3 = 1 THEN ['src' || ((item_id + 1) % 20), 'src' || ((item_id + 2) % 20), 'src0'] ELSE []::VARCHAR[] END AS asn,
 CASE WHEN item_id % 3 = 2 THEN ['docs/src1'] ELSE []::VARCHAR[] END AS pdp, CASE WHEN item_id % 3 = 2 THEN ['7.md'] ELSE []::VARCHAR[] END AS adp, CASE WHEN item_id % 7 = 0 THEN ['docs/src3/'] ELSE []::VARCHAR[] END AS ddp FROM benchmark WHERE item_id IS NOT NULL),
g1 AS (SELECT r.qid, r.rank, r.source_path, r.source_name, r.content, c.*, list_filter(ddp, lambda x: contains(lower(source_path), lower(x))) AS bad, list_filter(psn, lambda x: lower(x) = lower(source_name)) AS ps, list_filter(asn, lambda x: lower(x) = lower(source_name)) AS as_,
 list_filter(pdp, lambda x: contains(lower(source_path), lower(x))) AS pp, list_filter(adp, lambda x: contains(lower(source_path), lower(x))) AS ap FROM results r JOIN cases c ON c.id = r.qid),
graded AS (SELECT *, CASE WHEN len(bad) > 0 THEN 'MISS' WHEN (len(ps) > 0 OR len(pp) > 0) AND NOT (len(psn) > 0 AND len(ps) = 0) THEN 'STRONG PASS' WHEN (len(as_) > 0 OR len(ap) > 0) AND NOT (len(asn) > 0 AND len(as_) = 0) THEN 'WEAK PASS' ELSE 'MISS' END AS grade FROM g1),
hit AS (SELECT qid, rank AS hit_rank, source_path AS hit_path, source_name AS hit_source, grade AS hit_grade, CASE grade WHEN 'STRONG PASS' THEN CASE WHEN len(ps) > 0 AND len(pp) > 0 THEN 'preferred_source+target' WHEN len(ps) > 0 THEN 'preferred_source' ELSE 'preferred_path' END
 ELSE CASE WHEN len(as_) > 0 AND len(ap) > 0 THEN 'acceptable_source+target' WHEN len(as_) > 0 THEN 'acceptable_source' ELSE 'acceptable_path' END END AS rule,
 CASE grade WHEN 'STRONG PASS' THEN list_concat(list_transform(ps, lambda x: 'preferred_source:' || x), list_transform(pp, lambda x: 'preferred_path:' || x)) ELSE list_concat(list_transform(as_, lambda x: 'acceptable_source:' || x), list_transform(ap, lambda x: 'acceptable_path:' || x)) END AS matched_on
 FROM graded WHERE grade <> 'MISS' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) = 1),
tops AS (SELECT qid, count(*) AS n, arg_min(source_path, rank) AS top_path, arg_min(source_name, rank) AS top_source, arg_min(content, rank) AS top_content, min(CASE WHEN list_contains(psn, source_name) THEN rank END) AS psr FROM graded GROUP BY qid),
outcomes AS (SELECT c.id AS case_id, c.bucket, c.query_style, c.concept_id, coalesce(psn[1], asn[1]) AS expected_source_name, asn, coalesce(hit_grade, 'MISS') AS grade, hit_rank, hit_path, hit_source, rule, matched_on, psr,
 CASE WHEN hit_grade IS NULL THEN CASE WHEN coalesce(n, 0) = 0 THEN {said(W.FAILURES['nothing'])} WHEN len(psn) > 0 AND top_source IS NOT NULL AND NOT list_contains(psn, top_source) THEN {said(W.FAILURES['source'], source='top_source')}
  WHEN starts_with(top_path, 'versioned_docs/') THEN {said(W.FAILURES['versioned'], path='top_path')} WHEN contains(top_content, 'import ') OR (contains(top_content, '<') AND contains(top_content, '/>')) THEN {said(W.FAILURES['wrapper'], path='top_path')}
  WHEN len(list_filter(ddp, lambda x: contains(lower(top_path), lower(x)))) > 0 THEN {said(W.FAILURES['disallowed'], path='top_path')}
  WHEN len(pdp) + len(adp) > 0 THEN {said(W.FAILURES['paths'], n='n')} ELSE {said(W.FAILURES['weak'])} END END AS failure_summary,
 CASE WHEN len(psn) > 0 AND n > 0 AND NOT coalesce(list_contains(psn, top_source), false) AND psr IS NOT NULL THEN {said(W.RANKINGS['source_later'], source='psn[1]', rank='psr', top="coalesce(top_source, 'None')")}
  WHEN len(psn) > 0 AND n > 0 AND NOT coalesce(list_contains(psn, top_source), false) THEN {said(W.RANKINGS['source_absent'], source='psn[1]', top="coalesce(top_source, 'None')")}
  WHEN hit_grade = 'STRONG PASS' AND hit_rank > 1 THEN {said(W.RANKINGS['preferred_later'], rank='hit_rank')} WHEN hit_grade IS NULL AND n > 0 THEN {said(W.RANKINGS['no_match'])}
  WHEN hit_grade IS NULL THEN {said(W.RANKINGS['no_candidates'])} WHEN hit_rank > 1 THEN {said(W.RANKINGS['later'], rank='hit_rank')} END AS ranking_diagnostic
 FROM cases c LEFT JOIN tops t ON t.qid = c.id LEFT JOIN hit h ON h.qid = c.id)"""

REPORT = """
groups AS (SELECT 'overall' AS dimension, 'all' AS label, * FROM outcomes UNION ALL SELECT 'bucket', coalesce(bucket, 'uncategorized'), * FROM outcomes UNION ALL SELECT 'expected_source', expected_source_name, * FROM outcomes WHERE expected_source_name IS NOT NULL
 UNION ALL SELECT 'query_style', query_style, * FROM outcomes WHERE query_style IS NOT NULL UNION ALL SELECT 'concept', concept_id, * FROM outcomes WHERE concept_id IS NOT NULL)"""


def _html() -> str:
    out = "html"
    for p in ("(?is)<!--.*?-->", *(rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "nav", "footer", "head", "noscript"))):
        out = f"regexp_replace({out}, {quoted(p)}, ' ', 'g')"
    out = rf"regexp_replace({out}, '(?i)<(h[1-6])\b[^>]*>', chr(1) || '\1' || chr(2), 'g')"
    return rf"regexp_replace({out}, '(?i)</h[1-6]\s*>|</?(p|div|article|section|main|body|html|ul|ol|li|table|tr|td|th|blockquote|pre|header|aside)\b[^>]*>|<hr\b[^>]*>', chr(1), 'g')"


def html_text(c: str) -> str:
    out = rf"regexp_replace(regexp_replace({c}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')"
    for name, sign in parsing.ENTITIES:
        out = f"replace({out}, {quoted(name)}, {quoted(sign)})"
    return f"trim({out}, ' ')"


TITLE = rf"nullif({html_text(r'''regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)''')}, '')"
HTML = f"""
pg AS (SELECT 'site/' || {slug(r"regexp_replace(url, '^[a-zA-Z]+://', '')")} || '.html' AS source_path, coalesce({TITLE}, url) AS page, string_split({_html()}, chr(1)) AS parts FROM pages WHERE html IS NOT NULL AND url IS NOT NULL),
bl AS (SELECT source_path, page, unnest(parts) AS x, unnest(generate_series(1, len(parts))) AS n FROM pg),
bl2 AS (SELECT source_path, page, n, CASE WHEN regexp_matches(x, '(?i)^h[1-6]' || chr(2)) THEN x[2:2]::INT END AS level, {html_text("regexp_replace(x, '(?i)^h[1-6]' || chr(2), '')")} AS text FROM bl),
bl3 AS (SELECT *, count(level) OVER (PARTITION BY source_path ORDER BY n) AS part FROM bl2 WHERE text <> ''),
pt AS (SELECT source_path, page, part, max(level) AS level, max(CASE WHEN level IS NOT NULL THEN text END) AS heading, coalesce(string_agg(CASE WHEN level IS NULL THEN text END, chr(10) || chr(10) ORDER BY n), '') AS content FROM bl3 GROUP BY ALL),
pt2 AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY part) - 1 AS section_order FROM pt),
up AS (SELECT a.source_path, a.part, string_agg(b.heading, ' > ' ORDER BY b.part) AS above FROM pt a JOIN pt b ON a.source_path = b.source_path AND b.level IS NOT NULL AND b.part <= a.part
 AND (b.part = a.part OR NOT EXISTS (SELECT 1 FROM pt c WHERE c.source_path = a.source_path AND c.level IS NOT NULL AND c.part > b.part AND c.part <= a.part AND c.level <= b.level)) GROUP BY ALL)"""


def _clean(text: str) -> str:
    """Content of a section's lines, for texts without fenced code."""
    t = strip("x")
    signs = f"regexp_replace(translate({t}, {quoted(parsing.SIGNS)}, ''), '\\s', '', 'g') = ''"
    module = f"list_contains({strings(parsing.MODULE_WORDS)}, string_split_regex({t}, '\\s')[1]) AND regexp_matches({t}, '\\s')"
    tag = f"regexp_matches(x, {quoted(T.COMPONENT_LINE)}) OR regexp_matches(lower({t}), '^<[/]?({'|'.join(parsing.FOLDING_TAGS)})\\b[^>]*>$')"
    bad = f"(starts_with({t}, '<!--') AND ends_with({t}, '-->')) OR ({module}) OR {tag} OR {signs}"
    lines = f"list_transform(list_filter(string_split({text}, chr(10)), lambda x: trim(x) = '' OR NOT ({bad})), lambda x: rtrim(x))"
    return strip(rf"regexp_replace(array_to_string({lines}, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')")


TURNS = f"""
tn AS (SELECT conv_id, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations WHERE conv_id IS NOT NULL),
cs AS (SELECT 'conversations/' || conv_id || '.md' AS source_path, sha1('document::conversations/' || conv_id || '.md') AS document_id, 'Conversation ' || conv_id AS title, k, role, {_clean('text')} AS content FROM tn),
csec AS (SELECT *, sha1('section::' || document_id || '::' || k || '::' || title || '/' || role) AS section_id FROM cs WHERE content <> '')"""


def _wiki(c: str) -> str:
    for p, by in parsing.WIKI_MARKS:
        c = f"regexp_replace({c}, {quoted(p)}, {quoted(by.replace('$1', chr(92) + '1'))}, 'g')"
    return strip(c)


def with_(relations: str, select: str) -> str:
    return f"WITH RECURSIVE {relations.strip()}\n{select}"


def twins() -> dict[str, str]:
    out = {}
    text = "coalesce(text, '')"
    tail = strip(f"array_to_string({pieces(text)}[greatest(len({pieces(text)}) - 19, 1):], '')")
    out["token_counts"] = f"SELECT doc_id, {tokens(text)} AS n_tokens, array_to_string({pieces(text)}, '') = {text} AS lossless, length({truncated(text, '100')})::INT AS n_head, length({tail})::INT AS n_tail FROM documents"
    out["ids_and_paths"] = f"""SELECT page_id, sha1('document::' || url) AS document_id, {slug('url')} AS slug, 'user_docs/' || {slug('url')} || '.wiki' AS wiki_path, 'design_system/guides-more/' || {slug('url')} || '-' || page_id || '.site' AS site_path,
 {canonical("'versioned_docs/version-4.1/' || url")} AS canonical, false AS is_canonical, 'user_docs' AS source_name, 'repo_markdown' AS source_type FROM pages"""
    out["html_titles"] = f"""SELECT page_id, {TITLE} AS title, regexp_extract(html, '<html\\s+lang="([^"]*)"', 1) AS lang FROM pages"""
    out["html_sections"] = with_(HTML, "SELECT p.source_path, section_order::INT AS section_order, coalesce(heading, page) AS section_title, coalesce(level, 0)::INT AS heading_level, page || coalesce(' > ' || above, '') AS heading_path, sha1(content) AS content_hash FROM pt2 p LEFT JOIN up u ON u.source_path = p.source_path AND u.part = p.part WHERE content <> ''")
    out["markdown_sections"] = with_(TURNS, "SELECT source_path, title, section_id, k::INT AS section_order, role AS section_title, 2 AS heading_level, title || ' > ' || role AS heading_path, sha1(content) AS content_hash FROM csec")
    body = _wiki("'''''''' || text || ''''''' [[File:x.png]]' || chr(10)")
    out["wikitext_sections"] = with_(
        f"tn AS (SELECT conv_id, role, {body} AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations), ct AS (SELECT * FROM tn WHERE content <> '' UNION ALL SELECT DISTINCT conv_id, NULL, 'Lead', 0 FROM conversations)",
        "SELECT 'user_docs/conversation-' || conv_id || '.wiki' AS source_path, 'https://wiki.example.org/Conversation_' || conv_id AS source_url, (row_number() OVER (PARTITION BY conv_id ORDER BY k) - 1)::INT AS section_order, coalesce(role, 'Conversation ' || conv_id) AS section_title, CASE WHEN role IS NULL THEN 0 ELSE 2 END AS heading_level, 'Conversation ' || conv_id || coalesce(' > ' || role, '') AS heading_path, sha1(content) AS content_hash FROM ct",
    )
    out["event_properties"] = "SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS k_sum, count(*) FILTER (WHERE (props->>'$.k') IS NULL) AS without_k FROM events GROUP BY event_type"
    out["chunk_rows"] = with_(CHUNKS, "SELECT id, section_id, chunk_order, token_count, start_offset, end_offset, lag(id) OVER w AS prev_chunk_id, lead(id) OVER w AS next_chunk_id, source_path, sha1(content) AS content_hash FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY chunk_order)")
    out["chunk_links"] = with_(
        f"{TURNS}, tsec AS (SELECT section_id AS sid, 'Heading: ' || title || ' > ' || role || chr(10) || chr(10) AS prefix, content FROM csec), {folded('tcut', 'tsec', 400, 60).strip()}, ck AS (SELECT source_path, k, chunk_order, sha1('chunk::' || sid || '::' || chunk_order || '::' || t.content) AS id, {tokens('t.content')} AS token_count FROM tcut t JOIN csec ON sid = section_id)",
        "SELECT source_path, id, chunk_order, lag(id) OVER w AS prev_chunk_id, lead(id) OVER w AS next_chunk_id, token_count FROM ck WINDOW w AS (PARTITION BY source_path ORDER BY k, chunk_order)",
    )
    out["page_chunks"] = with_(
        f"{HTML}, hs AS (SELECT p.source_path, p.section_order, p.content, page || coalesce(' > ' || above, '') AS heading_path, sha1('section::' || sha1('document::' || p.source_path) || '::' || p.section_order || '::' || replace(page || coalesce(' > ' || above, ''), ' > ', '/')) AS section_id FROM pt2 p LEFT JOIN up u ON u.source_path = p.source_path AND u.part = p.part WHERE p.content <> ''),"
        f" hsec AS (SELECT section_id AS sid, 'Heading: ' || heading_path || chr(10) || chr(10) AS prefix, content FROM hs), {folded('hcut', 'hsec', 120, 20).strip()}, hk AS (SELECT source_path, section_order, chunk_order, sha1('chunk::' || sid || '::' || chunk_order || '::' || t.content) AS id, t.content, start_offset, end_offset, {tokens('t.content')} AS token_count FROM hcut t JOIN hs ON sid = section_id)",
        "SELECT source_path, id, chunk_order, token_count, start_offset, end_offset, lag(id) OVER w AS prev_chunk_id, lead(id) OVER w AS next_chunk_id, content FROM hk WINDOW w AS (PARTITION BY source_path ORDER BY section_order, chunk_order)",
    )
    out["stats_overview"] = with_(CHUNKS, "SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM secs) AS sections, count(*) AS chunks, coalesce(avg(token_count), 0.0) AS avg_chunk_tokens FROM chunks")
    out["stats_chunks_per_document"] = with_(CHUNKS, "SELECT d.source_path, 'Document ' || d.doc_id AS title, count(c.id) AS chunk_count FROM docs d LEFT JOIN chunks c USING (section_id) GROUP BY ALL ORDER BY chunk_count DESC, source_path LIMIT 25".replace("USING (section_id)", "ON c.document_id = d.document_id"))
    out["stats_largest_chunks"] = with_(CHUNKS, "SELECT id AS chunk_id, source_path, '' AS heading_path, token_count FROM chunks ORDER BY token_count DESC, id LIMIT 25")
    out["stats_small_chunks"] = with_(CHUNKS, "SELECT id AS chunk_id, source_path, '' AS heading_path, token_count FROM chunks WHERE token_count <= 30 ORDER BY token_count, id LIMIT 25")
    out["stats_duplicate_chunks"] = with_(CHUNKS, "SELECT count(*) AS duplicate_count, min(id) AS sample_chunk_id, min(source_path) AS sample_source_path FROM chunks GROUP BY content HAVING count(*) > 1 ORDER BY duplicate_count DESC, sample_chunk_id LIMIT 25")
    out["stats_sources"] = with_(CHUNKS, "SELECT 'repo_markdown' AS source_type, coalesce(d.source, '') AS source_name, count(DISTINCT d.document_id) AS document_count, count(DISTINCT s.section_id) AS section_count, count(c.id) AS chunk_count FROM docs d LEFT JOIN secs s ON s.document_id = d.document_id LEFT JOIN chunks c ON c.section_id = s.section_id GROUP BY ALL")
    out["inspect_document"] = with_(CHUNKS, "SELECT d.document_id AS id, d.source_path, 'Document ' || d.doc_id AS title, count(c.id) AS chunk_count, coalesce(sum(c.token_count), 0)::BIGINT AS token_count, 1 AS n_sections FROM docs d LEFT JOIN chunks c ON c.document_id = d.document_id WHERE d.source_path = 'docs/src0/0.md' GROUP BY ALL")
    out["inspect_chunks"] = with_(CHUNKS, "SELECT id AS chunk_id, chunk_order, token_count, title, source_path, 'repo_markdown' AS source_type, source AS source_name, 0 AS section_order, 0 AS heading_level, 0 AS depth, sha1(content) AS content_hash FROM chunks WHERE source_path = 'docs/src0/0.md' AND chunk_order < 2 ORDER BY chunk_order DESC LIMIT 1")
    bar = lambda c: f"array_to_string({c}, '|') AS {c}"
    out["query_profiles"] = with_(PROFILES, f"SELECT qid, normalized, {bar('tokens')}, {bar('expanded')}, {bar('phrases')}, intent, task, {bar('families')}, {bar('file_hints')} FROM profiles")
    base = f"{CHUNKS}, {PROFILES}, {SCORED}"
    out["index_postings"] = with_(base, "SELECT term, field, count(DISTINCT chunk_id) AS n_chunks, count(*) AS tf, sum(first)::BIGINT AS first_positions FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY term, field, chunk_id ORDER BY pos) = 1 THEN pos - 1 ELSE 0 END AS first FROM occ) GROUP BY term, field")
    out["bm25_passes"] = with_(base, "SELECT qid, pass, count(*) AS n, round(sum(score), 3) AS total, round(min(score), 5) AS best FROM scored GROUP BY qid, pass")
    out["candidate_cascade"] = with_(base, "SELECT qid, chunk_id, pass, score FROM candidates")
    full = f"{base}, {SIGNALS}"
    out["rerank_signals"] = with_(full, f"SELECT qid, chunk_id, {', '.join(_SHOWN)}, round(weighted_score, 3) AS weighted_score FROM signals")
    out["search_results"] = with_(full, "SELECT qid, rank, chunk_id, source_path, source_name, document_title, round(weighted_score, 3) AS rerank_score, token_count FROM results")
    graded = f"{full}, {GRADED}"
    flag = lambda g, k: f"coalesce(grade = '{g}' AND hit_rank <= {k}, false)"
    S, W = "STRONG PASS", "WEAK PASS"
    out["evaluation_outcomes"] = with_(graded, f"SELECT case_id, bucket, expected_source_name, grade, {flag(S, 1)} AS strong_pass_top_1, {flag(S, 3)} AS strong_pass_top_3, {flag(S, 5)} AS strong_pass_top_5, {flag(W, 1)} AS weak_pass_top_1, {flag(W, 5)} AS weak_pass_top_5, hit_rank::INT AS matched_result_rank, hit_path AS matched_result_path, rule AS matched_rule_type, array_to_string(matched_on, '|') AS matched_on, psr::INT AS preferred_source_rank, failure_summary, ranking_diagnostic FROM outcomes")
    n = lambda g, k: f"count(*) FILTER (WHERE {flag(g, k)})"
    out["evaluation_report"] = with_(f"{graded}, {REPORT}", f"SELECT dimension, label, count(*) AS total_queries, count(*) FILTER (WHERE grade = '{S}') AS strong_passes, count(*) FILTER (WHERE grade = '{W}') AS weak_passes, count(*) FILTER (WHERE grade = 'MISS') AS misses, {n(S, 1)} AS top_1_strong_passes, {n(S, 3)} AS top_3_strong_passes, {n(S, 5)} / count(*) AS top_5_strong_pass_rate, {n(W, 5)} / count(*) AS top_5_weak_pass_rate, string_agg(case_id, '|' ORDER BY case_id) AS case_ids FROM groups GROUP BY dimension, label")
    out["evaluation_confusions"] = with_(graded, "SELECT case_id, expected_source_name, hit_source AS matched_result_source_name, grade FROM outcomes WHERE expected_source_name IS NOT NULL AND NOT coalesce(list_contains(list_concat([expected_source_name], asn), hit_source), false)")
    out["store_upsert"] = with_(
        base,
        "SELECT 'documents' AS name, count(*) AS n_rows, count(DISTINCT document_id) AS n_ids, min(document_id) AS least, max(document_id) AS most, count(DISTINCT source_path) AS n_keys FROM docs UNION ALL SELECT 'sections', count(*), count(DISTINCT section_id), min(section_id), max(section_id), count(DISTINCT document_id) FROM secs"
        " UNION ALL SELECT 'chunks', count(*), count(DISTINCT id), min(id), max(id), count(DISTINCT section_id) FROM chunks UNION ALL SELECT 'terms', sum(df)::BIGINT, count(*), min(term), NULL, count(DISTINCT df) FROM (SELECT term, count(DISTINCT chunk_id) AS df FROM occ GROUP BY term)",
    )
    from . import sql_results

    return out | sql_results.twins(base) | sql_results.structured()
