"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from loomdoc.functions import signals as S
from loomdoc.functions.text import KEYWORD_STOPS
from loomdoc.operators import conversation as C


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _re(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')".format
_WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda x: x <> '')".format
_TOKENS = "CASE WHEN length({0}) = 0 THEN 0 ELSE greatest(1, length({0}) // 4) END".format
_LINES = "l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT * FROM l WHERE trim(line) <> '')"
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_PACK_ACC = "{'done': []::VARCHAR[], 'buf': [x]::VARCHAR[], 'n': 0::BIGINT, 't': " + _TOKENS("x") + "::BIGINT}"
_PACKED = f"""s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents),
e AS (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS x FROM s),
t AS (SELECT doc_id, i, x, {_TOKENS('x')} AS t FROM e),
r AS (SELECT doc_id, list_prepend({{'g': 0::BIGINT, 'n': 0::BIGINT, 'gs': []::BIGINT[]}}, list(struct_pack(g := 0::BIGINT, n := t::BIGINT, gs := []::BIGINT[]) ORDER BY i)) AS a FROM t GROUP BY doc_id),
f AS (SELECT doc_id, list_reduce(a, lambda p, q: {{'g': (CASE WHEN p.n > 0 AND p.n + q.n > 300 THEN p.g + 1 ELSE p.g END), 'n': (CASE WHEN p.n > 0 AND p.n + q.n > 300 THEN q.n ELSE p.n + q.n END), 'gs': list_append(p.gs, CASE WHEN p.n > 0 AND p.n + q.n > 300 THEN p.g + 1 ELSE p.g END)}}).gs AS gs FROM r),
g AS (SELECT doc_id, generate_subscripts(gs, 1) AS i, unnest(gs) AS g FROM f),
c AS (SELECT doc_id, g AS seq, string_agg(x, ' ' ORDER BY i) AS text FROM t JOIN g USING (doc_id, i) GROUP BY doc_id, g),
k AS (SELECT *, {_TOKENS('text')} AS tokens, len({_WORDS('text')}) AS w FROM c),
v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(substr(text, 1, 200)) ORDER BY seq) AS dup FROM k WHERE tokens BETWEEN 20 AND 800 AND w >= 5 AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]')),
z AS (SELECT *, (CASE WHEN tokens BETWEEN 80 AND 400 THEN 2.0 WHEN tokens > 400 THEN 1.0 ELSE 0.5 END + 0.5 + CASE WHEN contains(text, ':') THEN 0.5 ELSE 0.0 END - CASE WHEN w < 6 THEN 1.5 ELSE 0.0 END)::DOUBLE AS score FROM v WHERE dup = 1)"""

_BARE = lambda x: f"regexp_replace(coalesce({x}, ''), {_re(S.EDGES)}, '', 'g')"
_ACTS = lambda f: f"{f} IN ({_list(S.ACTIONS)})"
_DIRECTS = lambda f, g: f"({f} IN ({_list(S.DIRECTIVES)}) OR trim({f} || ' ' || {g}) IN ({_list(S.DIRECTIVES)}))"


def _signals(source: str) -> str:
    """CTEs a, b, sig over a relation with doc_id, pos, line."""
    w = _WORDS
    return f"""a AS (SELECT *, {_STRIP('line')} AS t FROM {source}),
b AS (SELECT *, {w('t')} AS w, regexp_extract(t, {_re(S.LABEL)}, 1) AS lab0, regexp_extract(t, {_re(S.LABEL)}, 2) AS bod0 FROM a),
b2 AS (SELECT *, len(w) AS nw, {_BARE('w[1]')} AS f0, lower({_BARE('w[1]')}) AS f, lower({_BARE('w[2]')}) AS g, {_STRIP('lab0')} AS lab, {_STRIP('bod0')} AS bod FROM b),
b3 AS (SELECT *, {w('lab')} AS lw, {w('bod')} AS bw, (nw > 0 AND (regexp_matches(t, '[.!?]$') OR f IN ({_list(S.STARTERS)}) OR (regexp_matches(f0, '^\\p{{Lu}}') AND nw >= 4))) AS sent,
  regexp_matches(t, {_re(S.FLAG)}) AS hf, regexp_matches(t, {_re(S.PATH)}) AS hp, regexp_matches(t, {_re(S.ASSIGNMENT)}) AS ha FROM b2),
b4 AS (SELECT *, lower({_BARE('lw[1]')}) AS lf, lower({_BARE('bw[1]')}) AS bf, lower({_BARE('bw[2]')}) AS bg FROM b3),
sig AS (SELECT *, (nw >= 2 AND nw <= 12 AND NOT sent AND f0 <> '' AND f NOT IN ({_list(S.STARTERS)}) AND (regexp_matches(t, '^[$>#] ') OR hf OR hp OR ha OR (regexp_matches(f0, {_re(S.EXECUTABLE)}) AND len(list_filter(w[1:3], lambda x: lower({_BARE('x')}) IN ({_list(S.STARTERS)}))) = 0))) AS is_command_like,
  {_ACTS('f')} AS starts_with_action, (lab <> '' AND bod <> '' AND len(lw) <= 6 AND ({_ACTS('lf')} OR {_ACTS('bf')} OR {_DIRECTS('bf', 'bg')})) AS is_labeled_action, {_DIRECTS('f', 'g')} AS is_directive,
  hf AS has_flags, regexp_matches(t, {_re(S.KEY_VALUE)}) AS is_key_value, hp AS has_path, ha AS has_assignment, regexp_matches(t, {_re(S.CONFLICT)}) AS has_merge_conflict_marker, nw <= 8 AS is_short, nw >= 40 AS is_long,
  regexp_matches(t, '\\p{{Nd}}') AS has_numbers, regexp_matches(t, {_re(S.SYMBOLS)}) AS has_symbols, sent AS sentence_like FROM b4)"""


_KEYED = "(is_key_value OR has_assignment)"
_CLASSIFIED = f"""{_LINES}, m AS (SELECT doc_id, pos, CASE WHEN pos % 5 = 4 THEN 'code' WHEN pos % 3 = 1 THEN 'list' ELSE 'text' END AS type, CASE WHEN pos % 4 = 2 THEN 'Run: check ' || line WHEN pos % 5 = 4 THEN 'x = ' || line ELSE line END AS line FROM n),
{_signals('m')},
fc AS (SELECT doc_id, pos, type, t, is_command_like, has_flags, has_symbols, is_labeled_action, CASE WHEN t = '' THEN 'mixed/0.0' WHEN has_merge_conflict_marker THEN 'warning/0.95' WHEN is_labeled_action THEN 'instruction/0.88' WHEN is_directive THEN 'instruction/0.84'
 WHEN type = 'code' THEN CASE WHEN has_flags OR is_command_like THEN 'instruction/0.88' WHEN {_KEYED} THEN 'configuration/0.86' WHEN has_path OR has_symbols THEN 'example/0.78' ELSE 'example/0.7' END
 WHEN type = 'list' THEN CASE WHEN pos % 2 = 0 AND starts_with_action THEN 'instruction/0.9' WHEN pos % 2 = 0 AND is_command_like THEN 'instruction/0.88' WHEN starts_with_action THEN 'instruction/0.85' WHEN is_command_like THEN 'instruction/0.8' WHEN pos % 2 = 0 AND NOT sentence_like THEN 'instruction/0.72' WHEN has_flags THEN 'reference/0.85' WHEN {_KEYED} THEN 'reference/0.76' WHEN has_path THEN 'reference/0.7' WHEN sentence_like THEN 'explanation/0.65' WHEN is_short THEN 'reference/0.6' ELSE 'mixed/0.55' END
 ELSE CASE WHEN is_command_like AND NOT sentence_like THEN 'instruction/0.78' WHEN starts_with_action THEN 'explanation/0.68' WHEN has_flags THEN 'reference/0.75' WHEN {_KEYED} THEN 'reference/0.72' WHEN has_path THEN 'reference/0.65' WHEN is_long OR sentence_like THEN 'explanation/0.7' WHEN is_short THEN 'mixed/0.55' ELSE 'explanation/0.6' END END AS fn FROM sig),
fcl AS (SELECT *, split_part(fn, '/', 1) AS function, split_part(fn, '/', 2)::DOUBLE AS confidence FROM fc)"""


def _bm25(docs: str, queries: str) -> str:
    """CTEs d to kr: query_id, doc_id, score, scaled and rank over relations (doc_id, text) and (query_id, text); every document counts, those without a shared term with 0."""
    return f"""d AS (SELECT doc_id, {_WORDS('lower(text)')} AS w FROM ({docs})), c AS (SELECT doc_id, w, len(w) AS dl FROM d WHERE len(w) > 0), g AS (SELECT count(*) AS n, avg(dl) AS m FROM c),
p AS (SELECT doc_id, dl, unnest(w) AS term FROM c), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i0 AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM df, g), fl AS (SELECT 0.25 * avg(idf) AS fl FROM i0), i AS (SELECT term, CASE WHEN idf < 0 THEN fl ELSE idf END AS idf FROM i0, fl),
q AS (SELECT query_id, unnest({_WORDS('lower(text)')}) AS term FROM ({queries})), qt AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY ALL),
s0 AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / m))) AS score FROM qt JOIN tf USING (term) JOIN i USING (term), g GROUP BY query_id, doc_id),
s AS (SELECT query_id, doc_id, coalesce(score, 0) AS score FROM (SELECT DISTINCT query_id FROM q) CROSS JOIN (SELECT doc_id FROM c) LEFT JOIN s0 USING (query_id, doc_id)),
kb AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM s WINDOW w AS (PARTITION BY query_id)),
kr AS (SELECT query_id, doc_id, score, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS scaled, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM kb)"""


_NEAREST = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT query_id, vec_id, list_cosine_similarity(q.v, e.v) AS score FROM q, e), k AS (SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 12)"""

_TWO = f"""{_LINES}, ll AS (SELECT doc_id AS query_id, line || '#' || pos AS text, pos, CASE WHEN pos % 3 = 0 THEN 'command' WHEN pos % 3 = 1 THEN 'flag' ELSE 'text' END AS type, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank FROM n),
v AS (SELECT query_id, text, type, 1.0::DOUBLE / (pos + 1) AS score, rank FROM ll WHERE pos % 2 = 0), kw AS (SELECT query_id, text, type, 1.0::DOUBLE / (pos + 2) AS score, rank FROM ll WHERE pos % 2 = 1 OR pos % 4 = 0),
cm AS (SELECT query_id, count(*) FILTER (type = 'command') >= 2 AS c FROM v WHERE rank <= 5 GROUP BY query_id), k2 AS (SELECT kw.* FROM kw LEFT JOIN cm USING (query_id) WHERE NOT coalesce(c, false) OR type = 'command'),
u AS (SELECT *, 0 AS side, score AS s FROM v UNION ALL SELECT *, 1, 0.2 * score FROM k2),
fz AS (SELECT query_id, text, arg_min(type, side) AS type, sum(s ORDER BY side) AS score, min(side * 1000000 + rank) AS o FROM u GROUP BY query_id, text)"""

# The reranker's lists, written out for the SQL.
_CORE, _MAIN = "'dev', 'build', 'start'", "'main', 'core', 'basic', 'primary'"
_BEHAVIOUR = "'alias', 'default', 'without', 'before', 'after', 'warning', 'recommended', 'optional', 'required', 'good', 'know', 'what happens'"
_LISTING, _COMMANDS, _FLAG_WORDS = "'list', 'available', 'all commands', 'all options', 'provide commands'", "'command', 'cli'", "'flag', 'option', 'parameter'"
_PHRASES = "'without a command', 'good to know', 'default port', 'alias for', 'before', 'after'"
_STOPS = "'what', 'is', 'the', 'when', 'you', 'run', 'a', 'an', 'to', 'do', 'does', 'of', 'and', 'in', 'for', 'on', 'with', 'without', 'are'"
_TROUBLE = "'error', 'fail', 'issue', 'debug'"


def _reranked(source: str) -> str:
    """CTEs rw to rr over a relation with the reranker's columns, query_id, score and rank: boost, new score and new rank."""
    has = lambda c, some: f"len(list_filter([{some}], lambda p: contains({c}, p))) > 0"
    when = lambda c, v: f"CASE WHEN {c} THEN {v} ELSE 0 END"
    tok = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9_.-]+')"
    shared = lambda t, w: f"{w} * 0.12 * len(list_filter(words, lambda w: list_contains({t}, w)))"
    notes = "sub IN ('note', 'config', 'concept')"
    terms = [
        when("q <> '' AND contains(blob, q)", "1.0"),
        f"0.35 * len(list_filter([{_PHRASES}], lambda p: contains(blob, p)))",
        shared("t1", 1.2), shared("t2", 0.8), shared("t3", 1.0), shared("t4", 1.0),
        "CASE WHEN cmds THEN CASE kind WHEN 'command' THEN 0.65 WHEN 'flag' THEN -0.25 ELSE 0 END WHEN flgs THEN CASE kind WHEN 'flag' THEN 0.75 WHEN 'command' THEN -0.15 ELSE 0 END ELSE CASE kind WHEN 'command' THEN 0.12 WHEN 'flag' THEN 0.05 ELSE 0 END END",
        f"CASE WHEN {has('q', _LISTING)} THEN CASE WHEN role = 'commands_table' OR kind = 'command_list' THEN 0.9 WHEN kind = 'command' THEN 0.35 ELSE 0 END ELSE 0 END",
        when(f"beh AND {notes}", "0.85"),
        when("beh AND kind IN ('command_list', 'command_options', 'command_examples')", "0.45"),
        when("beh AND kind = 'command'", "-0.15"),
        when("beh AND kind = 'flag'", "-0.10"),
        f"CASE WHEN cmds AND cmd <> '' THEN CASE WHEN cmd IN ({_CORE}) THEN 0.35 WHEN {has('q', _MAIN)} THEN -0.35 ELSE 0 END ELSE 0 END",
        when("list_contains(entities, 'command') AND kind = 'command'", "0.18"),
        when("list_contains(entities, 'flag') AND kind = 'flag'", "0.18"),
        when("list_contains(entities, 'port') AND contains(blob, 'port')", "0.22"),
        "0.08 * len(list_filter(coalesce(vocab_expansions, []::VARCHAR[]), lambda v: trim(v) <> '' AND contains(blob, lower(trim(v)))))",
        when("intent = 'action' AND kind IN ('procedure', 'command_examples', 'command_options')", "0.25"),
        when(f"intent = 'definition' AND {notes}", "0.25"),
        when("intent = 'definition' AND kind IN ('command_list', 'command_options')", "0.18"),
        when(f"intent = 'explanation' AND {notes}", "0.22"),
        when(f"debug AND {has('blob', _TROUBLE)}", "0.35"),
        when("priority AND kind = 'command'", "0.20"),
        when("priority AND role = 'commands_table'", "0.15"),
        when("len(words) >= 3 AND len(list_filter(words, lambda w: list_contains(t1, w) OR list_contains(t2, w) OR list_contains(t3, w) OR list_contains(t4, w))) * 0.12 < 0.12", "-0.25"),
        when(f"len({_WORDS('blob')}) > 180 AND NOT {notes}", "-0.05"),
    ]
    return f"""rw AS (SELECT *, trim(lower(query)) AS q, lower(coalesce(type, '')) AS kind, lower(coalesce(subtype, '')) AS sub, lower(coalesce(content_role, '')) AS role, trim(lower(coalesce(command, ''))) AS cmd,
  trim(lower(coalesce(heading, '') || ' ' || coalesce(context, '') || ' ' || text || ' ' || coalesce(command_context, ''))) AS blob, {tok('heading')} AS t1, {tok('context')} AS t2, {tok('text')} AS t3, {tok('command_context')} AS t4,
  list_filter({tok('trim(query)')}, lambda w: w NOT IN ({_STOPS})) AS words FROM {source}),
rx AS (SELECT *, {has('q', _COMMANDS)} AS cmds, {has('q', _FLAG_WORDS)} AS flgs, {has('q', _BEHAVIOUR)} AS beh FROM rw),
ry AS (SELECT *, ({' + '.join(f'({t})' for t in terms)})::DOUBLE AS boost FROM rx),
rr AS (SELECT * EXCLUDE (score, rank), score + boost AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score + boost, 9) DESC, rank) AS rank FROM ry)"""


# Markdown made of documents: lines x with their place i, group g = i // 7 (a section) and kind k = i % 7.
_MD = r"""l0 AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, trim(regexp_replace(unnest(string_split(text, chr(10))), '[^\p{L}\p{N}.!?:,]+', ' ', 'g')) AS x FROM documents),
l1 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, CASE WHEN regexp_matches(x, '^\p{L}') AND NOT regexp_matches(x, '^(import|export) ') THEN x ELSE 'Text ' || x END AS x FROM l0 WHERE x <> ''),
ml AS (SELECT doc_id, i, i // 7 AS g, i % 7 AS k, x, trim(substr(x, 1, 30)) AS h, trim(substr(x, 1, 10)) AS t FROM l1)"""
# Their blocks in order, of sections with content; paragraphs of fewer than three characters are in no section.
_BLOCKS = rf"""{_MD},
e0 AS (SELECT doc_id, g, i, 0 AS sub, 'paragraph' AS kind, x AS text, x AS part FROM ml WHERE k IN (0, 1, 6) AND length(x) >= 3
 UNION ALL SELECT doc_id, g, i, 1, 'paragraph', x, x FROM ml WHERE k = 5 AND length(x) >= 3
 UNION ALL SELECT doc_id, g, i, 0, 'list', 'Run ' || x, '- Run ' || x FROM ml WHERE k = 2 UNION ALL SELECT doc_id, g, i, 1, 'list', x, '- ' || x FROM ml WHERE k = 2 AND length(x) >= 2
 UNION ALL SELECT doc_id, g, i, 0, 'code', 'npm run --flag ' || x, 'npm run --flag ' || x FROM ml WHERE k = 3
 UNION ALL SELECT doc_id, g, i, 0, 'table', 'name: a | value: ' || x, 'a | ' || x FROM ml WHERE k = 4
 UNION ALL SELECT doc_id, g, i, 0, 'component', 'Component: Card (href=a/b; title=' || t || ')', NULL FROM ml WHERE k = 5),
hd AS (SELECT doc_id, g, h, lag(h) OVER (PARTITION BY doc_id ORDER BY g) AS above FROM ml WHERE k = 0),
se AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS o FROM (SELECT DISTINCT doc_id, g FROM e0)),
sx AS (SELECT doc_id, g, o, h AS heading, CASE WHEN g % 2 = 1 THEN above END AS above, CASE WHEN g % 2 = 1 AND lower(above) <> 'root' THEN above ELSE h END AS context, 's' || o || '_' || coalesce(nullif(regexp_replace(regexp_replace(lower(h), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'section') AS section_id FROM se JOIN hd USING (doc_id, g))"""
_KEYWORDS = rf"list_filter(regexp_extract_all(regexp_replace(lower({{}}), '[^\x00-\x7F]', 'A', 'g'), '\b([a-z][a-z0-9._-]{{{{3,}}}})\b', 1), lambda x: x NOT IN ({_list(KEYWORD_STOPS)}))"
_SIX = "len(" + _WORDS("{0}") + ") <= 6"
_STEPS = "regexp_matches(lower(heading || '|' || context), 'step|procedure|workflow')"
_OUTPUT = "(lower(heading) IN ('output', 'report', 'result', 'results', 'summary') OR lower(context) IN ('output', 'report', 'result', 'results', 'summary'))"
_OVERVIEW = "(lower(heading) = 'overview' OR lower(context) = 'overview')"
# Every block with its signals, function and links.
_LINKED = f"""{_BLOCKS},
bl AS (SELECT e0.doc_id, g AS section_index, section_id, heading, context, CASE kind WHEN 'paragraph' THEN 'text' ELSE kind END AS type, row_number() OVER (PARTITION BY e0.doc_id, g ORDER BY i, sub) - 1 AS pos, text AS line FROM e0 JOIN sx USING (doc_id, g)),
{_signals('bl')},
fc AS (SELECT *, CASE WHEN t = '' THEN 'mixed/0.0' WHEN has_merge_conflict_marker THEN 'warning/0.95' WHEN is_labeled_action THEN 'instruction/0.88' WHEN is_directive THEN 'instruction/0.84'
 WHEN type = 'table' THEN CASE WHEN starts_with_action AND {_STEPS} THEN 'instruction/0.72' ELSE 'reference/0.84' END
 WHEN type = 'code' THEN CASE WHEN has_flags OR is_command_like THEN 'instruction/0.88' WHEN {_KEYED} THEN 'configuration/0.86' WHEN has_path OR has_symbols THEN 'example/0.78' ELSE 'example/0.7' END
 WHEN type = 'list' THEN CASE WHEN starts_with_action THEN 'instruction/0.85' WHEN is_command_like THEN 'instruction/0.8' WHEN has_flags THEN 'reference/0.85' WHEN {_KEYED} THEN 'reference/0.76' WHEN has_path THEN 'reference/0.7' WHEN sentence_like THEN 'explanation/0.65' WHEN is_short THEN 'reference/0.6' ELSE 'mixed/0.55' END
 WHEN type = 'component' THEN CASE WHEN starts_with_action AND {_STEPS} THEN 'instruction/0.75' WHEN is_command_like THEN 'instruction/0.75' WHEN has_flags OR is_key_value THEN 'reference/0.75' WHEN sentence_like THEN 'explanation/0.65' ELSE 'mixed/0.55' END
 ELSE CASE WHEN is_command_like AND NOT sentence_like THEN 'instruction/0.78' WHEN starts_with_action AND {_STEPS} THEN 'instruction/0.78' WHEN starts_with_action AND {_OUTPUT} THEN 'instruction/0.72' WHEN starts_with_action AND {_OVERVIEW} THEN 'explanation/0.68' WHEN has_flags THEN 'reference/0.75' WHEN {_KEYED} THEN 'reference/0.72' WHEN has_path THEN 'reference/0.65' WHEN is_long OR sentence_like THEN 'explanation/0.7' WHEN is_short THEN 'mixed/0.55' ELSE 'explanation/0.6' END END AS fn FROM sig),
fw AS (SELECT *, split_part(fn, '/', 1) AS function, doc_id || ':' || section_id || ':b' || pos AS id, type = 'code' AS code FROM fc),
fs AS (SELECT *, code AND (is_command_like OR has_flags) AS cmd, NOT code AND function = 'instruction' AS ins, NOT code AND function IN ('instruction', 'explanation', 'reference', 'configuration', 'mixed') AS ctx FROM fw),
ft AS (SELECT *, code AND (function IN ('example', 'configuration') OR (has_symbols AND NOT cmd)) AS exa, ins AND len(string_split_regex(t, '\\s+')) <= 16 AND (t LIKE '%:' OR is_labeled_action) AS short FROM fs),
lk AS (SELECT id, type, function, code, lag(id) OVER w AS follows, CASE WHEN cmd THEN last_value(CASE WHEN ins THEN id END IGNORE NULLS) OVER b END AS command, CASE WHEN code THEN lag(CASE WHEN short THEN id END) OVER w END AS label, CASE WHEN exa THEN last_value(CASE WHEN ctx THEN id END IGNORE NULLS) OVER b END AS example
 FROM ft WINDOW w AS (PARTITION BY doc_id, section_index ORDER BY pos), b AS (PARTITION BY doc_id, section_index ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

# The chunks of those sections: pieces of every block, below their parent heading, cut at their limit, then valid ones with score and rank.
_CHUNKED = f"""{_BLOCKS},
pt AS (SELECT doc_id, g, i, 0 AS o, x AS text, 'low' AS d FROM ml WHERE k IN (0, 1, 5, 6) AND length(x) >= 3 UNION ALL SELECT doc_id, g, i, 1, 'name: a | value: ' || x, 'high' FROM ml WHERE k = 4),
p1 AS (SELECT *, {_TOKENS('text')} AS n FROM pt),
s AS (SELECT doc_id, g, i, o, d, {_SENTENCES} AS s FROM p1 WHERE n > 300), e AS (SELECT doc_id, g, i, o, d, generate_subscripts(s, 1) AS j, unnest(s) AS x FROM s), t AS (SELECT *, {_TOKENS('x')} AS t FROM e),
r AS (SELECT doc_id, g, i, o, list_prepend({{'g': 0::BIGINT, 'n': 0::BIGINT, 'gs': []::BIGINT[]}}, list(struct_pack(g := 0::BIGINT, n := t::BIGINT, gs := []::BIGINT[]) ORDER BY j)) AS a FROM t GROUP BY doc_id, g, i, o),
f AS (SELECT doc_id, g, i, o, list_reduce(a, lambda p, q: {{'g': (CASE WHEN p.n > 0 AND p.n + q.n > 300 THEN p.g + 1 ELSE p.g END), 'n': (CASE WHEN p.n > 0 AND p.n + q.n > 300 THEN q.n ELSE p.n + q.n END), 'gs': list_append(p.gs, CASE WHEN p.n > 0 AND p.n + q.n > 300 THEN p.g + 1 ELSE p.g END)}}).gs AS gs FROM r),
gg AS (SELECT doc_id, g, i, o, generate_subscripts(gs, 1) AS j, unnest(gs) AS part FROM f),
ck AS (SELECT doc_id, g, i, o, 0 AS part, text, CASE WHEN n <= 120 THEN 'text_atom' ELSE 'text_block' END AS subtype, d FROM p1 WHERE n BETWEEN 1 AND 300
 UNION ALL SELECT doc_id, g, i, o, part, string_agg(x, ' ' ORDER BY j), 'text_split', d FROM t JOIN gg USING (doc_id, g, i, o, j) GROUP BY doc_id, g, i, o, part, d
 UNION ALL SELECT doc_id, g, i, 0, s, CASE s WHEN 0 THEN 'Run ' || x ELSE x END, CASE WHEN length('Run ' || x) // 4 <= 180 THEN 'procedure_step' ELSE 'list_group' END, 'medium' FROM ml, range(2) AS w(s) WHERE k = 2
 UNION ALL SELECT doc_id, g, i, 0, 0, 'name: a | value: ' || x, 'table_row', 'high' FROM ml WHERE k = 4 UNION ALL SELECT doc_id, g, i, 0, 0, 'npm run --flag ' || x, 'code_block', 'high' FROM ml WHERE k = 3),
an AS (SELECT ck.*, heading, CASE WHEN subtype <> 'code_block' THEN nullif(above, '') END AS anchor FROM ck JOIN sx USING (doc_id, g)),
ab AS (SELECT *, CASE WHEN anchor IS NULL THEN text ELSE anchor || chr(10) || chr(10) || CASE WHEN starts_with(lower(text), lower(anchor)) THEN {_STRIP("substr(text, length(anchor) + 1)")} ELSE text END END AS body FROM an),
ac AS (SELECT * RENAME (text AS bare, body AS text) FROM ab),
lm AS (SELECT *, {_SENTENCES} AS ss, (subtype = 'list_group' AND {_TOKENS('text')} > 400) OR (subtype = 'text_split' AND {_TOKENS('text')} > CASE d WHEN 'high' THEN 400 ELSE 600 END) AS large FROM ac),
lp AS (SELECT doc_id, g, i, o, part, heading, subtype, d, large, CASE WHEN NOT large THEN [text] WHEN anchor IS NOT NULL THEN [anchor || chr(10) || chr(10), text] WHEN subtype = 'list_group' AND len(list_filter(ss, lambda x: length(x) // 4 > 400)) = 0 THEN ss ELSE [text] END AS ps FROM lm),
lq AS (SELECT * EXCLUDE (ps), generate_subscripts(ps, 1) AS again, unnest(ps) AS text FROM lp),
sq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g, i, o, part, again) - 1 AS seq, {_TOKENS('text')} AS tokens, md5(doc_id || '|' || heading || '||' || substr(text, 1, 120)) AS chunk_id FROM lq),
vs AS (SELECT * EXCLUDE (text), {_STRIP('text')} AS text FROM sq WHERE tokens >= CASE WHEN subtype IN ('code_block', 'table_row') THEN 10 ELSE 20 END AND tokens <= 800),
vw AS (SELECT *, len({_WORDS('text')}) AS w FROM vs),
vf AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(substr(text, 1, 200)) ORDER BY seq) AS dup FROM vw WHERE subtype IN ('code_block', 'table_row') OR (w >= 5 AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]'))),
vz AS (SELECT *, (CASE WHEN tokens BETWEEN 80 AND 400 THEN 2.0 WHEN tokens > 400 THEN 1.0 ELSE 0.5 END + CASE WHEN subtype IN ('code_block', 'table_row') THEN 2.5 ELSE 0 END + CASE d WHEN 'high' THEN 2.0 WHEN 'medium' THEN 1.2 ELSE 0.5 END + CASE WHEN contains(text, chr(10) || chr(10)) THEN 0.5 ELSE 0 END + CASE WHEN contains(text, ':') THEN 0.5 ELSE 0 END - CASE WHEN w < 6 THEN 1.5 ELSE 0 END)::DOUBLE AS score FROM vf WHERE dup = 1),
vr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, seq) AS rank FROM vz)"""

SQL: dict[str, str] = {
    "clean_text": r"""WITH a AS (SELECT doc_id, '![i](u) see [docs](x) <b>ok</b>' || chr(10) || '**Applies to:** all' || chr(10) || '  ' || text || repeat(chr(10), 4) || ' end ' AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '!\[.*?\]\(.*?\)', '', 'g'), '\[(.*?)\]\(.*?\)', '\1', 'g'), '<[^>]+>', '', 'g') AS t FROM a),
c AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: NOT starts_with(x, '**Applies to:**')), chr(10)) AS t FROM b)
SELECT doc_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM c""",
    "strip_html_pages": r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages""",
    "keywords": rf"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(regexp_replace(lower(text), '[^\x00-\x7F]', 'A', 'g'), '\b([a-z][a-z0-9._-]{{3,}})\b', 1), lambda x: x NOT IN ({_list(KEYWORD_STOPS)})) AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS k, generate_subscripts(w, 1) AS i FROM w), f AS (SELECT doc_id, k, min(i) AS i FROM e GROUP BY doc_id, k), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)
SELECT d.doc_id, coalesce(string_agg(k, ',' ORDER BY i) FILTER (n <= 12), '') AS keywords FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id""",
    "token_estimate": f"SELECT doc_id, ({_TOKENS('text')})::BIGINT AS tokens FROM documents",
    "sentence_split": f"WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents) SELECT doc_id, (generate_subscripts(s, 1) - 1)::BIGINT AS pos, unnest(s) AS sentence FROM s",
    "chunk_ids": "SELECT doc_id, md5(coalesce(source, '') || '|Overview||' || substr(text, 1, 120)) AS chunk_id FROM documents",
    "point_uuid": "WITH h AS (SELECT doc_id, sha1(coalesce(source, '') || '|Overview||text_block||' || substr(text, 1, 200)) AS h FROM documents) SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id FROM h",
    "chunk_score_rank": f"WITH {_PACKED} SELECT doc_id, seq, tokens::BIGINT AS tokens, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, seq) AS rank FROM z",
    "drop_report": f"WITH {_PACKED} SELECT (SELECT count(*) FROM k) AS before, (SELECT count(*) FROM z) AS after, (SELECT count(*) FROM k) - (SELECT count(*) FROM z) AS removed, round(100.0 * ((SELECT count(*) FROM k) - (SELECT count(*) FROM z)) / (SELECT count(*) FROM k), 2)::DOUBLE AS percent",
    "dedupe_first200": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(substr(text, 1, 200))",
    "noise_filter": f"WITH {_LINES}, x AS (SELECT doc_id, pos, {_STRIP('line')} AS t FROM n) SELECT doc_id, pos::BIGINT AS pos, (len({_WORDS('t')}) < 5 OR NOT regexp_matches(t, '[\\p{{L}}\\p{{N}}]')) AS noise, ({_TOKENS('t')}) BETWEEN 20 AND 800 AS right_size FROM x",
    "signal_flags": f"WITH {_LINES}, {_signals('n')} SELECT doc_id, pos::BIGINT AS pos, {', '.join(S.FLAGS)} FROM sig",
    "function_class": f"WITH {_CLASSIFIED} SELECT type, function, confidence, count(*) AS n FROM fcl GROUP BY ALL",
    "follows_edges": f"WITH {_LINES}, p AS (SELECT doc_id, pos::BIGINT AS pos, (lag(pos) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS follows FROM n) SELECT * FROM p WHERE follows IS NOT NULL",
    "nearest_instruction": f"""WITH {_CLASSIFIED}, w AS (SELECT *, 'b' || pos AS id, type = 'code' AS code, type = 'code' AND (is_command_like OR has_flags) AS cmd, type <> 'code' AND function = 'instruction' AS ins, type <> 'code' AND function IN ('instruction', 'explanation', 'reference', 'configuration', 'mixed') AS ctx FROM fcl),
s AS (SELECT *, code AND (function IN ('example', 'configuration') OR (has_symbols AND NOT cmd)) AS exa, ins AND len(string_split_regex(t, '\\s+')) <= 16 AND (t LIKE '%:' OR is_labeled_action) AS short FROM w),
lk AS (SELECT *, last_value(CASE WHEN ins THEN id END IGNORE NULLS) OVER b AS li, last_value(CASE WHEN ctx THEN id END IGNORE NULLS) OVER b AS lc, lag(CASE WHEN short THEN id END) OVER (PARTITION BY doc_id ORDER BY pos) AS lb FROM s WINDOW b AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, pos::BIGINT AS pos, CASE WHEN cmd THEN li END AS command, lb AS label, CASE WHEN exa THEN lc END AS example FROM lk WHERE code""",
    "heading_stack": f"""WITH {_LINES}, h AS (SELECT doc_id, pos, (pos * 7 % 3 + length(line) % 3 + 1)::INT AS level, line AS text FROM n),
p AS (SELECT a.doc_id, a.pos, b.level, b.pos AS bpos, b.text, a.level AS own FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.pos < a.pos AND b.level < a.level),
k AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM h c WHERE c.doc_id = p.doc_id AND c.pos > p.bpos AND c.pos < p.pos AND c.level <= p.level))
SELECT h.doc_id, h.pos::BIGINT AS pos, coalesce(string_agg(k.text, ' > ' ORDER BY k.level), '') AS path FROM h LEFT JOIN k ON h.doc_id = k.doc_id AND h.pos = k.pos GROUP BY h.doc_id, h.pos""",
    "table_profile": """WITH x AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS x FROM documents),
r AS (SELECT doc_id, i, string_split_regex(trim(x), ' +') AS c FROM x), k AS (SELECT doc_id, i, len(c) AS w, len(list_filter(c, lambda y: y <> '')) AS f, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM r WHERE len(list_filter(c, lambda y: y <> '')) > 0 AND NOT len(list_filter(c, lambda y: NOT regexp_matches(y, '^[-: ]*$'))) = 0),
m AS (SELECT doc_id, w AS t FROM (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, w DESC) AS o FROM k GROUP BY doc_id, w) WHERE o = 1)
SELECT doc_id, t AS target_cols, min(w) AS min_cols, max(w) AS max_cols, count(*) - 1 AS row_count, t AS column_count, coalesce(sum(least(f, t)) FILTER (n > 1), 0)::BIGINT AS filled_cell_count, count(*) FILTER (n > 1 AND w <> t) AS anomaly_count,
CASE WHEN count(*) > 1 THEN round(coalesce(sum(least(f, t)) FILTER (n > 1), 0) / ((count(*) - 1) * t), 4) ELSE 0.0 END::DOUBLE AS cell_density FROM k JOIN m USING (doc_id) GROUP BY doc_id, t""",
    "table_row_text": "SELECT c_custkey, 'name: ' || trim(regexp_replace(c_name, '\\s+', ' ', 'g')) || ' | market segment: ' || trim(c_mktsegment) || ' | name 2: ' || c_custkey AS row_text FROM customer",
    "bm25_topk": f"WITH {_bm25('SELECT doc_id, text FROM documents', 'SELECT item_id AS query_id, text FROM benchmark')} SELECT query_id, doc_id, round(score, 6) AS score, round(scaled, 5) AS scaled, rank FROM kr WHERE rank <= 12",
    "keyword_search": f"""WITH ch AS (SELECT doc_id, trim(source || ' ' || 'guide' || ' ' || source || ' ' || coalesce(text, '')) AS text, CASE WHEN doc_id % 3 = 0 THEN 'command' WHEN doc_id % 3 = 1 THEN 'flag' ELSE 'text' END AS type FROM documents),
aq AS (SELECT item_id AS query_id, CASE WHEN item_id % 10 < 5 THEN 'Command ' ELSE 'guide ' END || text AS text FROM benchmark),
{_bm25('SELECT doc_id, text FROM ch', 'SELECT query_id, text FROM aq')}
SELECT kr.query_id, doc_id, type, round(scaled + CASE WHEN regexp_matches(lower(aq.text), 'command|cli') THEN CASE type WHEN 'command' THEN 0.8 WHEN 'flag' THEN -0.3 ELSE 0 END ELSE CASE type WHEN 'command' THEN 0.4 WHEN 'flag' THEN 0.1 ELSE 0 END END, 5)::DOUBLE AS score, rank FROM kr JOIN ch USING (doc_id) JOIN aq USING (query_id) WHERE rank <= 10""",
    "vector_search": f"WITH {_NEAREST}, k1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s), m AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM k1 WHERE r <= 12 WINDOW w AS (PARTITION BY query_id)) SELECT 'v' || query_id AS query_id, 'v' || vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'command' WHEN vec_id % 3 = 1 THEN 'flag' ELSE 'text' END AS type, round(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END + CASE WHEN vec_id % 3 = 0 THEN 0.10 WHEN vec_id % 3 = 1 THEN 0.15 ELSE 0 END, 4)::DOUBLE AS score FROM m",
    "cosine_topk": f"WITH {_NEAREST} SELECT query_id, vec_id, score FROM k",
    "minmax_normalise": f"WITH {_NEAREST} SELECT query_id, vec_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 4) AS scaled FROM k WINDOW w AS (PARTITION BY query_id)",
    "weighted_fusion": f"WITH {_TWO} SELECT query_id, text, type, round(score, 6) AS score FROM fz",
    "rerank_boost": f"""WITH {_LINES}, src AS (SELECT doc_id AS query_id, ['list the options in that before', 'What is the default port', 'main command for the build', 'alias'][doc_id % 4 + 1] AS query, line AS text, ['Overview', 'Default port'][pos % 2 + 1] AS heading, ['root', 'Build errors', ''][pos % 3 + 1] AS context,
 ['command', 'flag', 'command_list', 'procedure', 'text'][pos % 5 + 1] AS type, ['note', 'text', 'config'][pos % 3 + 1] AS subtype, ['commands_table', 'text', 'list', 'code'][pos % 4 + 1] AS content_role, ['npm run build', ''][pos % 2 + 1] AS command_context, ['build', 'serve', ''][pos % 3 + 1] AS command,
 ['action', 'definition', 'explanation', '', NULL][doc_id % 5 + 1] AS intent, doc_id % 3 = 0 AS debug, doc_id % 2 = 0 AS priority, CASE WHEN doc_id % 7 < 3 THEN ['command', 'port'] WHEN doc_id % 7 < 5 THEN ['flag'] END AS entities, CASE WHEN doc_id % 3 = 1 THEN [' Build ', 'port', ''] END AS vocab_expansions, 0.5::DOUBLE AS score, pos AS rank FROM n),
{_reranked('src')} SELECT query_id, round(boost, 6) AS boost, round(score, 6) AS score, rank FROM rr""",
    "retrieve_plan": f"""WITH {_TWO}, f1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, o, text) AS rank FROM fz), src AS (SELECT f1.query_id, 'which options of ' || source || ' run before' AS query, f1.text, f1.type, f1.score, f1.rank, NULL::VARCHAR AS heading, NULL::VARCHAR AS context, NULL::VARCHAR AS subtype, NULL::VARCHAR AS content_role, NULL::VARCHAR AS command_context, NULL::VARCHAR AS command, NULL::VARCHAR AS intent, NULL::BOOLEAN AS debug, NULL::BOOLEAN AS priority, NULL::VARCHAR[] AS entities, NULL::VARCHAR[] AS vocab_expansions FROM f1 JOIN documents d ON d.doc_id = f1.query_id WHERE rank <= 6),
{_reranked('src')}, rz AS (SELECT *, max(score) OVER (PARTITION BY query_id) < 0.25 AS fallback FROM rr) SELECT query_id, text, round(score, 6) AS score, rank, fallback FROM rz WHERE rank <= 5""",
    "memory_window": "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4",
    "long_term_trigger": "WITH h AS (SELECT conv_id, turn, role, least(row_number() OVER (PARTITION BY conv_id ORDER BY turn), 8)::BIGINT AS held FROM conversations) SELECT conv_id, turn, held, role = 'assistant' AND held >= 4 AND held % 4 = 0 AS due FROM h",
    "conversation_state": f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations), u AS (SELECT conv_id, lower(trim(coalesce(arg_max(text, turn) FILTER (role = 'user'), ''))) AS q FROM m WHERE n <= 8 GROUP BY conv_id)
SELECT conv_id, CASE WHEN len(list_filter([{_list(C.DEBUG)}], lambda p: contains(q, p))) > 0 THEN 'debug' WHEN len(list_filter([{_list(C.FOLLOWUP)}], lambda p: contains(q, p))) > 0 THEN 'followup' WHEN len(list_filter([{_list(C.EXPLANATORY)}], lambda p: contains(q, p))) > 0 THEN 'explanatory' ELSE 'normal' END AS state FROM u""",
    "last_answer": "SELECT conv_id, arg_max(text, turn) FILTER (role = 'assistant') AS answer FROM conversations GROUP BY conv_id",
    "format_history": "WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, 'RECENT CONVERSATION:' || chr(10) || string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || coalesce(text, ''), chr(10) ORDER BY turn) AS history FROM m WHERE n <= 8 GROUP BY conv_id",
    "enrich_query": """WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations), q AS (SELECT conv_id, arg_max(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id),
o AS (SELECT m.conv_id, arg_max(m.text, m.turn) AS other FROM m JOIN q USING (conv_id) WHERE n <= 8 AND role = 'user' AND m.text <> query GROUP BY m.conv_id)
SELECT conv_id, query || CASE WHEN coalesce(other, '') <> '' THEN ' ' || other ELSE '' END AS enriched FROM q LEFT JOIN o USING (conv_id)""",
    "context_blocks": f"""WITH {_LINES}, r AS (SELECT doc_id AS query_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, line FROM n)
SELECT query_id, string_agg('[Source ' || k || ']' || chr(10) || 'Type: text' || chr(10) || 'Heading: Overview' || chr(10) || 'Context: root' || chr(10) || 'Score: ' || (0.5::DOUBLE + pos / 4)::VARCHAR || chr(10) || chr(10) || 'Content:' || chr(10) || regexp_replace(line, '\\s+$', ''), chr(10) || chr(10) ORDER BY k) AS context FROM r GROUP BY query_id""",
    "vector_validity": "WITH v AS (SELECT vec_id, len(embedding) AS n FROM embeddings WHERE len(embedding) BETWEEN 10 AND 4096 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0) SELECT vec_id FROM v WHERE n = (SELECT arg_min(n, vec_id) FROM v)",
    "token_stats": f"WITH t AS (SELECT source, {_TOKENS('text')} AS t FROM documents) SELECT source, count(*) AS n, floor(avg(t))::BIGINT AS avg, floor(median(t))::BIGINT AS median, min(t)::BIGINT AS min, max(t)::BIGINT AS max FROM t GROUP BY source",
    "subtype_counts": f"""WITH {_LINES}, c0 AS (SELECT doc_id, pos, trim(regexp_replace({_STRIP('line')}, '\\s+', ' ', 'g')) AS text FROM n), c1 AS (SELECT *, {_TOKENS('text')} AS n FROM c0),
s AS (SELECT doc_id, pos, {_SENTENCES} AS s FROM c1 WHERE n > 300), e AS (SELECT doc_id, pos, generate_subscripts(s, 1) AS i, unnest(s) AS x FROM s), t AS (SELECT *, {_TOKENS('x')} AS t FROM e),
r AS (SELECT doc_id, pos, list_prepend({{'g': 0::BIGINT, 'n': 0::BIGINT}}, list(struct_pack(g := 0::BIGINT, n := t::BIGINT) ORDER BY i)) AS a FROM t GROUP BY doc_id, pos),
f AS (SELECT list_reduce(a, lambda p, q: {{'g': (CASE WHEN p.n > 0 AND p.n + q.n > 300 THEN p.g + 1 ELSE p.g END), 'n': (CASE WHEN p.n > 0 AND p.n + q.n > 300 THEN q.n ELSE p.n + q.n END)}}).g + 1 AS packs FROM r)
SELECT 'text_atom' AS subtype, count(*) AS n FROM c1 WHERE n BETWEEN 1 AND 120 HAVING count(*) > 0 UNION ALL SELECT 'text_block', count(*) FROM c1 WHERE n BETWEEN 121 AND 300 HAVING count(*) > 0 UNION ALL SELECT 'text_split', sum(packs)::BIGINT FROM f HAVING count(*) > 0""",
    "mdx_normalise": rf"""WITH {_MD}, p AS (SELECT doc_id, i, CASE k WHEN 0 THEN (CASE WHEN g % 2 = 0 THEN '## ' ELSE '### ' END) || h || chr(10) || chr(10) || x WHEN 2 THEN '- Run ' || x || chr(10) || '- ' || x WHEN 3 THEN '```sh' || chr(10) || 'npm run --flag ' || x || chr(10) || '```' WHEN 4 THEN '| Name | Value |' || chr(10) || '|---|---|' || chr(10) || '| a | ' || x || ' |'
 WHEN 5 THEN chr(10) || chr(10) || '::mdx-component-self name="Card" title="' || t || '" href="a/b"' || repeat(chr(10), 4) || x ELSE x END AS md FROM ml),
m AS (SELECT doc_id, regexp_replace(regexp_replace(string_agg(md, chr(10) || chr(10) ORDER BY i), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10) AS md FROM p GROUP BY doc_id)
SELECT doc_id, md5(coalesce(md, '')) AS digest FROM documents LEFT JOIN m USING (doc_id)""",
    "element_counts": f"WITH {_MD}, e AS (SELECT unnest(CASE k WHEN 0 THEN ['heading', 'paragraph'] WHEN 2 THEN ['list'] WHEN 3 THEN ['code'] WHEN 4 THEN ['table'] WHEN 5 THEN ['component_self', 'paragraph'] ELSE ['paragraph'] END) AS type FROM ml) SELECT type, count(*) AS n FROM e GROUP BY type",
    "section_metadata": f"""WITH {_BLOCKS}, tx AS (SELECT doc_id, g, coalesce(string_agg(part, chr(10) || chr(10) ORDER BY i, sub), '') AS text, max(i % 7) AS k, count(DISTINCT i * 2 + CASE WHEN kind = 'list' THEN 0 ELSE sub END) AS block_count FROM e0 GROUP BY doc_id, g),
kw AS (SELECT doc_id, g, {_KEYWORDS.format('text')} AS w FROM tx), ke AS (SELECT doc_id, g, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM kw), kf AS (SELECT doc_id, g, w, min(i) AS i FROM ke GROUP BY doc_id, g, w),
kr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS r FROM kf), ks AS (SELECT doc_id, g, string_agg(w, ',' ORDER BY i) AS keywords FROM kr WHERE r <= 12 GROUP BY doc_id, g)
SELECT doc_id, section_id, heading, context, CASE WHEN k >= 4 THEN 'structured' WHEN k = 3 THEN 'code' WHEN k = 2 THEN 'list' ELSE 'text' END AS section_type, CASE WHEN k >= 4 THEN 'table' WHEN k = 3 THEN 'code' WHEN k = 2 THEN 'list' ELSE 'text' END AS content_role,
 CASE WHEN {_SIX.format('heading')} THEN heading WHEN {_SIX.format('above')} THEN above END AS command_context, coalesce(keywords, '') AS keywords, md5(text) AS digest, block_count FROM tx JOIN sx USING (doc_id, g) LEFT JOIN ks USING (doc_id, g)""",
    "block_relations": f"""WITH {_LINKED}, r AS (SELECT id AS src, follows AS dst, 'follows' AS type, 0.55::DOUBLE AS confidence, 'sequential_neighbor_in_section' AS reason FROM lk UNION ALL SELECT id, command, 'implements', 0.88, 'command_like_code_after_instruction' FROM lk UNION ALL SELECT id, label, 'implements', 0.92, 'code_immediately_after_instruction_label' FROM lk UNION ALL SELECT id, example, 'supports', 0.72, 'example_like_code_after_context' FROM lk)
SELECT * FROM r WHERE dst IS NOT NULL AND dst <> src""",
    "block_functions": f"WITH {_LINKED} SELECT type, function, count(*) AS n FROM lk GROUP BY type, function",
    "orphan_code": f"WITH {_LINKED} SELECT count(*) AS codes, count(*) FILTER (command IS NULL AND label IS NULL) AS orphans FROM lk WHERE code",
    "chunk_documents": f"WITH {_CHUNKED} SELECT doc_id, seq, chunk_id, subtype, tokens::BIGINT AS tokens, score, rank, md5(text) AS digest FROM vr",
    "chunk_overlap": f"""WITH {_CHUNKED}, o0 AS (SELECT *, lag(text) OVER w AS prev, lag(subtype) OVER w AS psub, CASE lag(d) OVER w WHEN 'high' THEN 80 WHEN 'medium' THEN 120 ELSE 200 END AS most FROM vr WINDOW w AS (PARTITION BY doc_id ORDER BY rank)),
o1 AS (SELECT *, coalesce(list_filter(list_transform(string_split(prev, chr(10) || chr(10)), lambda x: {_STRIP('x')}), lambda x: x <> '')[-1], '') AS lastp FROM o0), o2 AS (SELECT * EXCLUDE (text), text AS own, lastp AS text FROM o1), o3 AS (SELECT *, {_SENTENCES} AS ss FROM o2),
o4 AS (SELECT *, CASE WHEN len(ss) >= 2 THEN ss[-2] || ' ' || ss[-1] ELSE lastp END AS t FROM o3), o5 AS (SELECT *, CASE WHEN t LIKE '%.' THEN t ELSE t || '.' END AS ended FROM o4), o6 AS (SELECT *, CASE WHEN length(ended) > most THEN right(ended, most) ELSE ended END AS c FROM o5),
o7 AS (SELECT *, CASE WHEN len({_WORDS('t')}) < 6 OR t LIKE '%:' OR starts_with(lower(c), 'root') OR contains(lower(c), 'last updated') THEN '' ELSE c END AS ov FROM o6),
o8 AS (SELECT *, prev IS NOT NULL AND subtype NOT IN ('code_block', 'table_row') AND psub NOT IN ('code_block', 'table_row') AND tokens >= 80 AND ov <> '' AND NOT contains(lower(substr(own, 1, length(ov) + 20)), lower(ov)) AS overlap FROM o7),
o9 AS (SELECT doc_id, rank, coalesce(overlap, false) AS overlap, CASE WHEN overlap THEN ov || chr(10) || chr(10) || own ELSE own END AS text FROM o8)
SELECT doc_id, rank, overlap, ({_TOKENS('text')})::BIGINT AS tokens, md5(text) AS digest FROM o9""",
    "chunk_points": f"""WITH {_CHUNKED}, c AS (SELECT vr.*, 'docs/' || doc_id || '.md' AS src, CASE WHEN large THEN again - 1 WHEN subtype = 'text_split' THEN part ELSE 0 END AS sp FROM vr), h AS (SELECT *, sha1(src || '|' || heading || '||' || subtype || '|' || CASE WHEN sp <> 0 THEN sp::VARCHAR ELSE '' END || '|' || substr(text, 1, 200)) AS h FROM c)
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id, doc_id || '.md' AS file_name, tokens::BIGINT AS tokens, subtype, md5(text) AS digest FROM h""",
    "chunk_passages": f"WITH {_CHUNKED} SELECT doc_id, seq, md5(heading || CASE WHEN coalesce(above, '') <> '' THEN chr(10) || above ELSE '' END || chr(10) || text) AS digest FROM vr JOIN (SELECT doc_id, g, above FROM sx) USING (doc_id, g)",
    "section_profile": f"""WITH {_BLOCKS}, tx AS (SELECT doc_id, g, coalesce(string_agg(part, chr(10) || chr(10) ORDER BY i, sub), '') AS text, count(*) FILTER (kind = 'paragraph') AS paragraphs, count(DISTINCT i) FILTER (kind = 'list') AS lists, count(*) FILTER (kind = 'table') AS tables, count(*) FILTER (kind = 'code') AS codes FROM e0 GROUP BY doc_id, g)
SELECT doc_id, section_id, paragraphs, lists, tables, codes, len({_WORDS('text')}) AS words, CASE WHEN (lists > 0)::INT + (tables > 0)::INT + (codes > 0)::INT > 1 THEN 'mixed' WHEN tables > 0 THEN 'table' WHEN codes > 0 THEN 'code' WHEN lists > 0 THEN 'list' ELSE 'text' END AS role FROM tx JOIN sx USING (doc_id, g)""",
    "document_texts": f"WITH {_BLOCKS} SELECT doc_id, md5(string_agg(part, chr(10) || chr(10) ORDER BY i, sub)) AS digest FROM e0 GROUP BY doc_id",
    "list_blocks": rf"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS x FROM documents), a AS (SELECT doc_id, i, {_STRIP("CASE WHEN doc_id % 2 = 0 THEN (i % 9 + 1)::VARCHAR || '. ' || x ELSE x END")} AS x FROM l),
d AS (SELECT DISTINCT doc_id, x FROM a WHERE length(x) >= 2), v AS (SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(x, '^\s*\p{{Nd}}[.)](.|\n)')) AS votes FROM d GROUP BY doc_id),
e AS (SELECT doc_id, count(*) FILTER (x <> '') AS n, count(*) FILTER (regexp_matches(x, '^\s*\p{{Nd}}[.)](.|\n)')) AS votes FROM a GROUP BY doc_id)
SELECT t.doc_id, coalesce(v.n, 0) AS items, coalesce(v.votes >= greatest(1, v.n // 2), false) AS ordered, coalesce(e.n, 0) AS kept, coalesce(e.n > 0 AND e.votes >= greatest(1, e.n // 2), false) AS kept_ordered FROM documents t LEFT JOIN v USING (doc_id) LEFT JOIN e USING (doc_id)""",
    "text_helpers": rf"""WITH p AS (SELECT doc_id, source, coalesce(text, '') AS text, {_STRIP("replace(coalesce(text, ''), chr(10), ' ')")} AS t FROM documents)
SELECT doc_id, md5(CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '...' ELSE t END) AS preview, CASE WHEN trim(coalesce(source, '')) = '' THEN 'Guide' WHEN contains(lower(trim(source)), 'guide') THEN trim(source) ELSE trim(source) || ' - Guide' END AS prefix, ceil(length(text) / 2400)::BIGINT AS pieces,
 md5(coalesce(array_to_string(list_transform(range(0, ceil(length(text) / 2400)::BIGINT), lambda i: substr(text, i * 2400 + 1, 2400)), '|'), '')) AS cut, CASE doc_id % 3 WHEN 0 THEN 'markdown' WHEN 1 THEN 'mdx' ELSE 'unknown' END AS doc_type, source || CASE doc_id % 3 WHEN 0 THEN '.MD' WHEN 1 THEN '.mdx' ELSE '.txt' END AS file_name FROM p""",
}
SQL["conversation_prompts"] = f"""WITH st AS ({SQL['conversation_state']}), hi AS ({SQL['format_history']}), la AS ({SQL['last_answer']}), qu AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS query FROM conversations GROUP BY conv_id),
j AS (SELECT *, nullif(CASE state WHEN 'followup' THEN 'Continue: ' WHEN 'debug' THEN 'Help fix: ' WHEN 'explanatory' THEN 'Explain: ' ELSE '' END || query, '') AS asked FROM st JOIN hi USING (conv_id) JOIN la USING (conv_id) JOIN qu USING (conv_id))
SELECT conv_id, md5('Answer from the sources only. ' || CASE state WHEN 'debug' THEN 'Look for the cause and say how to mend it.' WHEN 'followup' THEN 'Go on from the answer before.' WHEN 'explanatory' THEN 'Explain step by step.' ELSE 'Answer directly.' END
 || chr(10) || chr(10) || 'History:' || chr(10) || history || CASE WHEN coalesce(answer, '') <> '' THEN chr(10) || chr(10) || 'Sources:' || chr(10) || answer ELSE '' END || coalesce(chr(10) || chr(10) || 'Question:' || chr(10) || asked, '')) AS prompt,
 len({_WORDS("coalesce(query, '')")}) < 6 AS rewrite, trim(lower(query)) IN ('are you sure', 'you sure', 'really', 'sure?', 'is that correct', 'confirm that') AS confirms,
 CASE length(query) % 4 WHEN 0 THEN 'That is outside what these documents cover.' WHEN 1 THEN 'The question is not clear; please say more.' WHEN 2 THEN 'This is an assistant for the indexed documents.' END AS guard FROM j"""
