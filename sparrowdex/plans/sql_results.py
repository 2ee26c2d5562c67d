"""SQL twins of what is made of results: snippets, bundles, contracts, and what their grading comes to."""

from __future__ import annotations

from ..functions import text as T
from ..operators import wording as W
from . import default_rules as D
from . import sql as S

BLANK = "chr(10) || chr(10)"
PLAIN = "trim(array_to_string(list_filter(list_transform(string_split_regex({}, '\\r\\n|[\\n\\r]'), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, 'Heading: ')), ' '))"


def points(text: str) -> str:
    """The points of a text, as a list; RE2 looks neither ahead nor behind, so sentences are marked off first."""
    parts = f"string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    plain = f"list_filter(list_transform({parts}, lambda x: trim(regexp_replace(trim(x), '^[- ]+|[- ]+$', '', 'g'))), lambda x: length(x) >= 20)"
    return f"list_filter({plain}, lambda x, i: list_position({plain}, x) = i)[1:4]"


def bundled(budget: int, around: bool) -> str:
    """Relation ``bundle`` (qid, rank, match, match_tokens, cut, before, after): results with the chunks around them, nearest first."""
    base = f"""
matched AS (SELECT r.*, c.section_id, c.chunk_order, CASE WHEN r.token_count > {budget} THEN {S.truncated('r.content', str(budget))} ELSE r.content END AS match FROM results r JOIN chunks c ON c.id = r.chunk_id),
fitted AS MATERIALIZED (SELECT *, token_count > {budget} AS cut, CASE WHEN token_count > {budget} THEN {S.tokens('match')} ELSE token_count END AS match_tokens FROM matched)"""
    if not around:
        return f"{base},\nbundle AS MATERIALIZED (SELECT *, []::VARCHAR[] AS before, []::VARCHAR[] AS after FROM fitted)"
    return f"""{base},
small AS MATERIALIZED (SELECT id, section_id, chunk_order, {S.strip('content')} AS content, {S.tokens(S.strip('content'))} AS n FROM chunks WHERE section_id IN (SELECT section_id FROM fitted)),
grown AS (SELECT qid, rank, section_id, chunk_order, 0 AS away, match_tokens AS total, []::VARCHAR[] AS before, []::VARCHAR[] AS after, match_tokens < {budget} AS more FROM fitted
 UNION ALL SELECT qid, rank, section_id, chunk_order, away + 1, total + CASE WHEN a THEN pn ELSE 0 END + CASE WHEN b THEN nn ELSE 0 END, CASE WHEN a THEN list_append(before, pid) ELSE before END, CASE WHEN b THEN list_append(after, nid) ELSE after END, a OR b
 FROM (SELECT *, coalesce(total + CASE WHEN a THEN pn ELSE 0 END + nn <= {budget}, false) AS b FROM (SELECT g.*, p.id AS pid, p.n AS pn, n.id AS nid, n.n AS nn, coalesce(total + p.n <= {budget}, false) AS a
 FROM grown g LEFT JOIN small p ON p.section_id = g.section_id AND p.chunk_order = g.chunk_order - g.away - 1 LEFT JOIN small n ON n.section_id = g.section_id AND n.chunk_order = g.chunk_order + g.away + 1 WHERE g.more))),
bundle AS MATERIALIZED (SELECT f.*, g.before, g.after FROM fitted f JOIN (SELECT qid, rank, arg_max(before, away) AS before, arg_max(after, away) AS after FROM grown GROUP BY qid, rank) g USING (qid, rank))"""


PARTS = """
placed AS (SELECT qid, rank, unnest(list_concat(list_concat(list_reverse(before), [chunk_id]), after)) AS id, unnest(generate_series(1, len(before) + 1 + len(after))) AS place, len(before) + 1 AS own FROM bundle),
pieces AS MATERIALIZED (SELECT p.qid, p.rank, p.place, p.id, CASE WHEN place < own THEN 'previous' WHEN place = own THEN 'match' ELSE 'next' END AS role, CASE WHEN place = own THEN b.match ELSE s.content END AS content, CASE WHEN place = own THEN b.match_tokens ELSE s.n END AS n
 FROM placed p JOIN bundle b USING (qid, rank) JOIN small s ON s.id = p.id)"""


def _contract() -> str:
    """Envelopes without support, from ``bundle`` and ``pieces``."""
    none = "NULL::VARCHAR"
    section = f"{{'id': id, 'role': role, 'document_title': document_title, 'source_path': source_path, 'source_url': {none}, 'canonical_url': {none}, 'section_title': {none}, 'heading_path': []::VARCHAR[], 'token_count': n, 'content': content}}"
    leads = points(PLAIN.format("p.content"))
    named = S.said(W.CONTRACT["title"], title="document_title", place="document_title")
    lead = S.said(W.CONTRACT["summary"], title="document_title", place="document_title", point="leads[1]")
    ranking = S.said(W.CONTRACT["ranking"], rank="rank", source="coalesce(source_name, 'unknown-source')", place="document_title")
    return f"""
told AS (SELECT p.*, b.document_title, b.source_path, b.source_name, {leads} AS leads FROM pieces p JOIN bundle b USING (qid, rank)),
made AS (SELECT qid, rank, any_value(document_title) AS document_title, any_value(source_path) AS source_path, any_value(source_name) AS source_name, list({section} ORDER BY place) AS sections, arg_min(leads, place) AS leads, flatten(list(leads ORDER BY place)) AS every, sum(n)::INT AS total, count(*) AS n_parts FROM told GROUP BY qid, rank),
each_one AS (SELECT m.qid, m.rank, {{'id': sha1(trim(m.source_path) || '||||')[1:16], 'type': 'knowledge_bundle', 'rank': m.rank::INT, 'confidence': CASE WHEN m.rank = 1 THEN 'high' WHEN m.rank <= 3 THEN 'medium' ELSE 'low' END,
 'source': {{'name': source_name, 'type': 'repo_markdown', 'url': {none}, 'canonical_url': {none}, 'path': source_path, 'document_title': document_title, 'section_title': {none}, 'heading_path': []::VARCHAR[]}},
 'content': {{'summary': CASE WHEN len(leads) > 0 THEN {lead} ELSE {named} END, 'sections': sections, 'file_anchors': []::VARCHAR[], 'key_points': list_filter(every, lambda x, i: list_position(every, x) = i)[1:4]}},
 'diagnostics': {{'ranking_explanation': {ranking}, 'support_reason': {none}, 'token_count': total, 'selection_strategy': CASE WHEN n_parts > 1 THEN 'section_window' WHEN cut THEN 'truncated_match' ELSE 'match_only' END}}}} AS result
 FROM made m JOIN (SELECT qid, rank, cut FROM bundle) USING (qid, rank))"""


def snippets() -> str:
    size = 20
    folded = f"array_to_string({S.terms('x')}, ' ')"
    return f"""
cutup AS (SELECT r.qid, r.rank, p.tokens AS asked, regexp_extract_all(r.content, '[^\\s]+') AS w FROM results r JOIN profiles p USING (qid)),
marked AS (SELECT qid, rank, w, list_transform(w, lambda x: len(list_filter({S.terms('x')}, lambda t: list_contains(asked, t))) > 0) AS hit, list_transform(w, lambda x: {folded}) AS f FROM cutup),
shown AS (SELECT *, list_transform(generate_series(1, len(w)), lambda i: CASE WHEN hit[i] THEN f[i] END) AS h FROM marked),
starts AS (SELECT qid, rank, w, hit, i, len(list_distinct(list_filter(h[i + 1:i + {size}], lambda x: x IS NOT NULL))) AS n FROM (SELECT *, unnest(generate_series(0, greatest(len(w) - {size}, 0))) AS i FROM shown)),
best AS (SELECT * FROM starts QUALIFY row_number() OVER (PARTITION BY qid, rank ORDER BY n DESC, i) = 1)"""


def report(with_bundles: bool = False) -> str:
    """Relation ``report`` of ``outcomes`` with the columns that comparisons look at."""
    flag = lambda g, k: f"coalesce(grade = '{g}' AND hit_rank <= {k}, false)"
    of = lambda g: f"count(*) FILTER (WHERE bundle_grade = '{g}')" if with_bundles else "0"
    return f"""report AS (SELECT dimension, label, count(*) AS n, count(*) FILTER (WHERE grade = 'STRONG PASS') AS strong_passes, count(*) FILTER (WHERE grade = 'WEAK PASS') AS weak_passes, count(*) FILTER (WHERE grade = 'MISS') AS misses,
 {', '.join(f"count(*) FILTER (WHERE {flag('STRONG PASS', k)}) / count(*) AS top_{k}_strong_pass_rate" for k in (1, 3, 5))}, {of('PARTIAL')} AS partial, {of('INSUFFICIENT')} AS insufficient FROM groups GROUP BY dimension, label)"""


def graded_bundles() -> str:
    """Relation ``bundle_grades`` of the first results, which are bundles of one part here."""
    said = lambda key, **v: S.said(W.BUNDLES[key], **v)
    comma = lambda c: f"array_to_string({c}, ', ')"
    low = "lower(source_path)"
    return f"""
firsts AS (SELECT o.case_id, o.grade, c.psn, c.asn, CASE WHEN len(c.pdp) > 0 THEN c.pdp ELSE c.adp END AS paths, r.source_path, r.source_name, r.token_count AS n, CASE WHEN coalesce(r.source_name, '') <> '' THEN [r.source_name] ELSE []::VARCHAR[] END AS names FROM outcomes o JOIN cases c ON c.id = o.case_id JOIN results r ON r.qid = o.case_id AND r.rank = 1),
weighed AS (SELECT *, list_filter(paths, lambda p: contains({low}, lower(p))) AS mp, list_filter(names, lambda x: list_contains(psn, x)) AS mw, list_filter(names, lambda x: list_contains(asn, x)) AS ma, n < 40 AS thin FROM firsts),
bundle_grades AS (SELECT case_id, grade, n, source_path, CASE WHEN grade = 'MISS' OR (len(psn) > 0 AND len(mw) = 0 AND len(ma) = 0) THEN 'INSUFFICIENT' WHEN (len(paths) > 0 AND len(mp) = 0) OR (len(psn) > 0 AND len(mw) = 0) OR thin THEN 'PARTIAL' ELSE 'COMPLETE' END AS bundle_grade, len(mp) > 0 AS matched,
 array_to_string(list_filter([CASE WHEN len(mp) > 0 THEN {said('path')} WHEN len(paths) > 0 THEN {said('no_path')} END, {said('primary', source='source_name')},
 CASE WHEN len(psn) > 0 AND len(mw) > 0 THEN {said('preferred', sources=comma('mw'))} WHEN len(psn) > 0 THEN {said('not_preferred')} WHEN len(asn) > 0 AND len(ma) > 0 THEN {said('acceptable', sources=comma('ma'))} END,
 CASE WHEN thin THEN {said('small')} END], lambda x: x IS NOT NULL), '; ') AS said FROM weighed)"""


RETRIEVAL = ("strong_passes", "weak_passes", "misses", "top_1_strong_pass_rate", "top_3_strong_pass_rate", "top_5_strong_pass_rate")


def compared(base: str, graded: str) -> str:
    """The comparison of a run with the run on all sources but one."""
    other = base.replace("chunks AS MATERIALIZED (", "whole AS MATERIALIZED (").replace("\n\nasked", "\nasked")
    at = other.index("asked AS (")
    other = f"{other[:at].rstrip().rstrip(',')}, chunks AS (SELECT * FROM whole WHERE source IS DISTINCT FROM 'src0'), {other[at:]}"
    run = lambda b: f"(WITH RECURSIVE {b.strip()}, {S.SIGNALS}, {graded}, {S.REPORT}, {report()} SELECT * FROM report)"
    better = lambda m: (f"a.{m} > b.{m}", f"a.{m} < b.{m}") if m == "strong_passes" or m.startswith("top") else (f"a.{m} < b.{m}", f"a.{m} > b.{m}")
    shown = lambda m: "true" if m in RETRIEVAL[:4] else "a.dimension = 'overall'"
    union = " UNION ALL ".join(f"SELECT a.dimension, a.label, '{m}' AS metric, a.{m}::DOUBLE - b.{m}::DOUBLE AS delta, {better(m)[0]} AS better, {better(m)[1]} AS worse FROM now a JOIN base b ON a.dimension = b.dimension AND a.label = b.label WHERE {shown(m)}" for m in RETRIEVAL)
    status = "CASE WHEN bool_or(better) AND bool_or(worse) THEN 'mixed' WHEN bool_or(worse) THEN 'regressed' WHEN bool_or(better) THEN 'improved' ELSE 'unchanged' END"
    return f"""WITH now AS MATERIALIZED {run(base)}, base AS MATERIALIZED {run(other)}, deltas AS ({union}), rated AS (SELECT dimension, label, {status} AS status FROM deltas GROUP BY dimension, label)
SELECT dimension, label, 'retrieval' AS metric_family, status FROM rated
UNION ALL SELECT dimension, label, 'retrieval', 'added' FROM now WHERE (dimension, label) NOT IN (SELECT (dimension, label) FROM base)
UNION ALL SELECT dimension, label, 'retrieval', 'removed' FROM base WHERE (dimension, label) NOT IN (SELECT (dimension, label) FROM now)
UNION ALL SELECT dimension, label, 'all', status FROM rated WHERE dimension = 'overall'
UNION ALL SELECT dimension, label, 'retrieval', metric || '=' || (CASE WHEN round(delta, 6) = trunc(round(delta, 6)) THEN round(delta, 6)::BIGINT || '.0' ELSE round(delta, 6)::VARCHAR END) FROM deltas WHERE delta <> 0"""


def changed(base: str, graded: str) -> str:
    other = base.replace("chunks AS MATERIALIZED (", "whole AS MATERIALIZED (")
    at = other.index("asked AS (")
    other = f"{other[:at].rstrip().rstrip(',')}, chunks AS (SELECT * FROM whole WHERE source IS DISTINCT FROM 'src0'), {other[at:]}"
    run = lambda b: f"(WITH RECURSIVE {b.strip()}, {S.SIGNALS}, {graded} SELECT case_id, grade FROM outcomes)"
    return f"WITH now AS MATERIALIZED {run(base)}, base AS MATERIALIZED {run(other)} SELECT case_id, base.grade AS retrieval_from, now.grade AS retrieval_to FROM now JOIN base USING (case_id) WHERE now.grade <> base.grade"


def twins(base: str) -> dict[str, str]:
    """``base``: the relations up to candidates."""
    out = {}
    full = f"{base}, {S.SIGNALS}"
    graded = f"{full}, {S.GRADED}"
    plain = PLAIN.format("content")
    out["contract_parts"] = S.with_(
        f"{full}, pl AS (SELECT *, {plain} AS plain FROM results), pts AS (SELECT *, {points('plain')} AS pt FROM pl)",
        f"SELECT qid, rank, sha1(trim(source_path) || '||||')[1:16] AS contract_id, CASE WHEN rank = 1 THEN 'high' WHEN rank <= 3 THEN 'medium' ELSE 'low' END AS confidence, sha1(plain) AS text_hash,"
        f" sha1(CASE WHEN len(pt) > 0 THEN {S.said(W.CONTRACT['summary'], title='document_title', place='document_title', point='pt[1]')} ELSE {S.said(W.CONTRACT['title'], title='document_title', place='document_title')} END) AS summary_hash, array_to_string(pt, '|') AS key_points FROM pts",
    )
    out["search_snippets"] = S.with_(
        f"{full}, {snippets()}",
        "SELECT qid, rank, CASE WHEN i > 0 THEN '...' ELSE '' END || array_to_string(list_transform(generate_series(i + 1, least(i + 20, len(w))), lambda k: CASE WHEN hit[k] THEN '[' || w[k] || ']' ELSE w[k] END), ' ') || CASE WHEN i + 20 < len(w) THEN '...' ELSE '' END AS snippet FROM best",
    )
    out["context_bundles"] = S.with_(
        f"{full}, {bundled(900, True)}, {PARTS}, plain AS (SELECT *, trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) AS p FROM pieces), summed AS (SELECT qid, rank, sum(n)::INT AS total, count(*)::INT AS n_chunks, (count(*) - count(DISTINCT p))::INT AS repeats, sha1(arg_min(content, place)) AS first_hash FROM plain GROUP BY qid, rank)",
        "SELECT qid, rank, total AS bundle_token_count, CASE WHEN n_chunks > 1 THEN 'section_window' WHEN cut THEN 'truncated_match' ELSE 'match_only' END AS selection_strategy, n_chunks, total <= 900 AS within_budget, n_chunks = 1 AND cut AS truncated, repeats AS duplicate_chunk_count, first_hash FROM summed JOIN bundle USING (qid, rank)",
    )
    out["runtime_contracts"] = S.with_(
        f"{full}, {bundled(600, True)}, {PARTS}, {_contract()}, lists AS (SELECT qid, list(result ORDER BY rank) AS results FROM each_one GROUP BY qid)",
        "SELECT qid, to_json({'tool': 'sparrowdex', 'version': 'v1', 'query': raw_query, 'normalized_query': normalized, 'intent': {'query_intent': intent, 'task_intent': task, 'concept_families': families}, 'results': results})::VARCHAR AS json FROM profiles JOIN lists USING (qid)",
    )
    damaged = "n = 1 OR n = 2 OR n = 3"
    out["contract_violations"] = S.with_(
        f"{full}, asked_n AS (SELECT qid, qid[2:]::INT % 8 AS n FROM (SELECT DISTINCT qid FROM results))",
        f"SELECT qid, 'schema' AS \"check\", 'keys or types are not those of the schema' AS problem FROM asked_n WHERE {damaged} UNION ALL SELECT qid, 'schema', 'tool is null' FROM asked_n WHERE n = 0 UNION ALL SELECT qid, 'schema', 'result.confidence is null' FROM asked_n WHERE n = 1"
        " UNION ALL SELECT qid, 'schema', 'result.rank is null' FROM asked_n WHERE n = 2 UNION ALL SELECT qid, 'rules', unnest(['ranks aren''t gapless', 'confidence is unknown']) FROM asked_n WHERE n = 4",
    )
    out["evaluation_bundles"] = S.with_(
        f"{graded}, {graded_bundles()}",
        "SELECT case_id, grade, bundle_grade, n AS bundle_token_count, 1 AS bundle_chunk_count, 'match_only' AS bundle_selection_strategy, true AS bundle_within_budget, matched AS bundle_matched_path, true AS bundle_source_coherent, said AS bundle_diagnostic FROM bundle_grades",
    )
    out["evaluation_verdict"] = S.with_(
        f"{graded}, {graded_bundles()}, t AS (SELECT count(*) FILTER (WHERE grade = 'MISS') AS misses, count(*) FILTER (WHERE grade = 'WEAK PASS') AS weak_passes, count(*) FILTER (WHERE bundle_grade = 'PARTIAL') AS partial, count(*) FILTER (WHERE bundle_grade = 'INSUFFICIENT') AS insufficient FROM bundle_grades)",
        "SELECT CASE WHEN misses > 0 OR insufficient > 0 THEN 'NON_GREEN' WHEN weak_passes > 0 OR partial > 0 THEN 'GREEN_WITH_WARNINGS' ELSE 'GREEN' END AS status, 'not_compared' AS baseline_status, misses, weak_passes, partial, insufficient FROM t",
    )
    out["evaluation_baseline"] = compared(base, S.GRADED)
    out["evaluation_changes"] = changed(base, S.GRADED)
    return out


def structured() -> dict[str, str]:
    """Twins of the queries whose texts are made up: what must come of each part is written out."""
    out = {}
    talk = "conv_id || '.md'"
    out["front_matter"] = f"""WITH c AS (SELECT DISTINCT conv_id, conv_id % 4 AS v FROM conversations WHERE conv_id IS NOT NULL), n AS (SELECT *, CASE v WHEN 0 THEN 'Talk ' || conv_id || ': one' WHEN 1 THEN 'Talk ' || conv_id END AS named FROM c), s AS (
 SELECT *, 0 AS section_order, named AS section_title, 0 AS heading_level, coalesce(named, '') AS heading_path, CASE WHEN v = 3 THEN 'title: never closed' || chr(10) ELSE '' END || 'Lead of the talk.' AS content FROM n
 UNION ALL SELECT *, 1, 'Under lined', 1, 'Under lined', 'Text.' || {BLANK} || '```' || chr(10) || '# no heading' || chr(10) || '```' FROM n
 UNION ALL SELECT *, 2, 'Deep', 3, 'Under lined > Deep', 'End of ' || conv_id || '.' FROM n)
SELECT 'talks/' || {talk} AS source_path, coalesce(named, 'Under lined') AS title, section_order, section_title, heading_level, heading_path, content FROM s"""
    proper = "array_to_string(list_transform(string_split(lower(r_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ')"
    out["wiki_tables"] = f"""WITH r AS (SELECT {proper} AS name, r_name, r_regionkey FROM region WHERE r_regionkey % 3 <> 1), c AS (SELECT n_regionkey, string_agg('|-' || chr(10) || n_name || chr(10) || '| ' || n_nationkey || chr(10), '' ORDER BY n_nationkey) AS cells FROM nation GROUP BY n_regionkey),
s AS (SELECT name, 0 AS section_order, 'Region ' || name AS section_title, 0 AS heading_level, r_name || ' is a region of Nations.' AS content FROM r
 UNION ALL SELECT name, 1, 'Nations', 2, 'Name' || chr(10) || cells || ' See the site  end.' FROM r JOIN c ON n_regionkey = r_regionkey UNION ALL SELECT name, 2, 'Last', 2, 'done' FROM r)
SELECT 'user_docs/region-' || replace(lower(name), ' ', '-') || '.wiki' AS source_path, 'https://wiki.example.org/Region_' || replace(name, ' ', '_') AS source_url, section_order, section_title, heading_level, 'Region ' || name || CASE WHEN section_order > 0 THEN ' > ' || section_title ELSE '' END AS heading_path, content FROM s"""
    out["rich_text_pages"] = f"""WITH r AS (SELECT {proper} AS name, r_name, r_regionkey AS k FROM region), n AS (SELECT n_regionkey, string_agg('- ' || n_name, chr(10) ORDER BY n_nationkey) AS bullets, string_agg(i || '. No ' || n_nationkey, chr(10) ORDER BY n_nationkey) AS numbers, string_agg(n_name || ' | ' || n_nationkey, chr(10) ORDER BY n_nationkey) AS cells
 FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) GROUP BY n_regionkey),
m AS (SELECT *, '> quoted' || chr(10) || '> ' || r_name || {BLANK} || '```' || chr(10) || 'x = 1' || chr(10) || '```' || {BLANK} || 'Image: a picture' || {BLANK} || 'Tokens: a.b, c' || {BLANK} || 'T - L' || chr(10) || 'D' || {BLANK} || 'in' || {BLANK} || 'out' AS more FROM r JOIN n ON n_regionkey = k),
s AS (SELECT *, 0 AS section_order, name AS section_title, 0 AS heading_level, name AS heading_path, 'About `' || r_name || '`' || chr(10) || 'site (https://e.org)' AS content FROM m
 UNION ALL SELECT *, 1, 'Nations', 2, name || ' > Nations', bullets || {BLANK} || numbers FROM m WHERE k % 2 = 0 UNION ALL SELECT *, 2, 'Table', 3, name || ' > Nations > Table', cells FROM m WHERE k % 2 = 0
 UNION ALL SELECT *, 3, 'More', 0, name || ' > More', more FROM m WHERE k % 2 = 0 UNION ALL SELECT *, 1, name, 0, name, more FROM m WHERE k % 2 = 1)
SELECT 'design_system/world/' || replace(lower(name), ' ', '-') || '-u' || k || '.site' AS source_path, 'https://d.example/share/p/u' || k AS source_url, name AS title, section_order, section_title, heading_level, heading_path, content FROM s"""
    base = lambda a: f"string_split(lower({a}), '/')[-1]"
    generic = f"NOT contains(a, '/') AND regexp_matches(lower(a), {S.quoted(D.GENERIC_ANCHOR)})"
    out["file_anchors"] = f"""WITH t AS (SELECT doc_id AS n, ['See lib/part' || doc_id % 5 || '/setup.php, sample' || doc_id % 2 || '.php and a' || doc_id % 3 || '.js; also lib/part' || doc_id % 4 || '/styles.scss (see a0.jsx).', 'example' || doc_id % 7 || '.yml'] AS texts, ['sample.php, other' || doc_id || '.js'] AS alone,
 CASE doc_id % 3 WHEN 0 THEN ['setup.php'] WHEN 1 THEN ['A1.js'] ELSE []::VARCHAR[] END AS files, CASE WHEN doc_id % 4 = 0 THEN ['lib/part0'] ELSE []::VARCHAR[] END AS trees FROM documents WHERE doc_id IS NOT NULL),
e AS (SELECT DISTINCT n, kind, files, trees, unnest(regexp_extract_all(x, {S.quoted(T.FILE_ANCHOR)}, 1)) AS a FROM (SELECT n, files, trees, 1 AS kind, unnest(texts) AS x FROM t UNION ALL SELECT n, files, trees, 2, unnest(alone) FROM t)),
w AS (SELECT *, contains(a, '/') AS path, {generic} AS generic, 10 * len(list_filter(files, lambda h: lower(h) = lower(a) OR {base('h')} = {base('a')})) + 6 * len(list_filter(trees, lambda h: contains(lower(a), h))) + 3 * contains(a, '/')::INT + (NOT ({generic}))::INT AS worth FROM e),
k AS (SELECT * FROM w QUALIFY NOT (generic AND bool_or(path) OVER (PARTITION BY n, kind))), l AS (SELECT n, kind, string_agg(a, '|' ORDER BY worth DESC, length(a) DESC, a DESC) AS anchors FROM k GROUP BY n, kind)
SELECT n AS doc_id, max(anchors) FILTER (WHERE kind = 1) AS anchors, max(anchors) FILTER (WHERE kind = 2) AS without_paths FROM l GROUP BY n"""
    return out
