"""SQL for DuckDB with the same results as the queries, written without looking at their plans: common tables first."""

COMMERCE = """
cust AS (SELECT 'c' || c_custkey AS id, c_name AS name, 'nation/n' || c_nationkey || '.py' AS file, 'function' AS kind, c_custkey AS line, c_custkey + floor(abs(c_acctbal) / 100)::BIGINT AS line_end FROM customer),
supp AS (SELECT 's' || s_suppkey AS id, s_name AS name, 'nation/n' || s_nationkey || '.py' AS file, 'method' AS kind, s_suppkey AS line, s_suppkey + floor(abs(s_acctbal) / 100)::BIGINT AS line_end FROM supplier),
prt AS (SELECT 'p' || p_partkey AS id, p_name AS name, 'brand/' || replace(p_brand, '#', '') || '.py' AS file, 'class' AS kind, p_partkey AS line, p_partkey + p_size AS line_end FROM part),
sym AS (SELECT * FROM cust UNION ALL SELECT * FROM supp UNION ALL SELECT * FROM prt),
li AS (SELECT 'c' || o_custkey AS c, 's' || l_suppkey AS s, 'p' || l_partkey AS p, l_linenumber::BIGINT AS line, l_returnflag AS flag, l_quantity AS qty, o_orderpriority AS prio FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
first_part AS (SELECT *, min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS base FROM part),
edge AS (
  SELECT DISTINCT 'CALLS' AS kind, c AS src, s AS dst, line FROM li UNION ALL
  SELECT DISTINCT 'CALLS_HEURISTIC', c, s, line FROM li WHERE flag = 'R' UNION ALL
  SELECT DISTINCT 'REFERENCES', c, p, line FROM li WHERE qty > 45 UNION ALL
  SELECT DISTINCT 'TESTED_BY', s, c, line FROM li WHERE prio = '1-URGENT' UNION ALL
  SELECT 'EXTENDS', 'p' || p_partkey, 'p' || base, -1 FROM first_part WHERE p_partkey <> base UNION ALL
  SELECT 'IMPLEMENTS', 'p' || p_partkey, 'p' || base, -1 FROM first_part WHERE p_partkey <> base AND p_size > 25)"""

EVENTS = """
err AS (SELECT event_id, ts, user_id, lead(user_id) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS nxt FROM events WHERE event_type = 'error'),
usr AS (SELECT DISTINCT user_id AS k, 'u' || user_id AS id, 'user_' || user_id AS name, 'team/t' || (user_id % 10) || '.py' AS file FROM events),
call AS (SELECT DISTINCT 'user_' || user_id AS a, 'user_' || nxt AS b, hour(ts)::BIGINT AS line FROM err WHERE nxt IS NOT NULL AND nxt <> user_id)"""

COMMITS = """
cm AS (SELECT DISTINCT 'o' || o_orderkey AS sha, o_orderdate AS ts, CASE o_orderpriority WHEN '1-URGENT' THEN 'fix crash in part' WHEN '2-HIGH' THEN 'prefix fixture' ELSE 'add feature' END AS subject,
  o_orderstatus = 'P' AS is_merge, 'part/' || l_partkey || '.py' AS path FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""

DOCS = """
doc AS (SELECT doc_id, source || '/d' || doc_id || '.txt' AS path, coalesce(text, '') AS text, lang, source FROM documents)"""

LINKS = """
lk AS (SELECT DISTINCT regexp_extract(url, '//([^/]*?)\\.example', 1) AS src, lower(x) AS dst, starts_with(url, 'http:') AS re_export
  FROM (SELECT url, unnest(regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1)) AS x FROM pages))"""

_CALLERS = """(SELECT t.name AS target, t.file AS target_file, f.name AS caller, f.file AS caller_file, f.line, e.line AS call_site_line,
  CASE e.kind WHEN 'CALLS' THEN 'call' ELSE 'reference' END AS kind, d.n AS defs
  FROM edge e JOIN sym f ON f.id = e.src JOIN sym t ON t.id = e.dst JOIN (SELECT name, count(DISTINCT file) AS n FROM sym GROUP BY name) d ON d.name = t.name
  WHERE e.kind IN ('CALLS', 'REFERENCES'))"""

_DEGREES = """
signed AS (
  SELECT dst AS id, sum(CASE kind WHEN 'CALLS_HEURISTIC' THEN -1 ELSE 1 END) AS i, 0 AS o FROM edge WHERE kind <> 'TESTED_BY' GROUP BY dst UNION ALL
  SELECT src, 0, sum(CASE kind WHEN 'CALLS_HEURISTIC' THEN -1 ELSE 1 END) FROM edge WHERE kind <> 'TESTED_BY' GROUP BY src),
deg AS (SELECT name, file, greatest(sum(i), 0)::BIGINT AS in_degree, greatest(sum(o), 0)::BIGINT AS out_degree, (greatest(sum(i), 0) + greatest(sum(o), 0))::BIGINT AS total
  FROM signed JOIN sym USING (id) GROUP BY name, file HAVING greatest(sum(i), 0) + greatest(sum(o), 0) > 0)"""

_REACH = """
nb AS (SELECT b AS at, a AS name, 1 AS caller FROM call UNION SELECT a, b, 0 FROM call),
w AS (SELECT name AS seed, name, 0 AS depth, 2 AS how FROM usr
  UNION ALL SELECT w.seed, nb.name, w.depth + 1, nb.caller FROM (SELECT DISTINCT seed, name, depth FROM w WHERE depth < {depth}) w JOIN nb ON nb.at = w.name),
hit AS (SELECT seed, name, depth, max(how) AS how FROM w WHERE (seed, name, depth) IN (SELECT seed, name, min(depth) FROM w GROUP BY seed, name) GROUP BY seed, name, depth),
reached AS (SELECT seed, name, depth, CASE how WHEN 2 THEN 'seed' WHEN 1 THEN 'caller' ELSE 'callee' END AS reason FROM hit)"""

_LIVE = """
used AS (SELECT DISTINCT name, file FROM edge JOIN sym ON id = dst WHERE edge.kind IN ('CALLS', 'REFERENCES')),
dead AS (SELECT sym.* FROM sym LEFT JOIN used u ON u.name = sym.name AND u.file = sym.file WHERE u.name IS NULL)"""


def _with(*parts: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(p.strip() for p in parts)}\n{body.strip()}"


ORACLES = {
    "hubs_topn": _with(COMMERCE, _DEGREES, body="SELECT * FROM deg ORDER BY total DESC, in_degree DESC, file, name LIMIT 10"),
    "degree_default_minus_heuristic": _with(COMMERCE, _DEGREES, body="SELECT * FROM deg"),
    "hubs_rank_of_target": _with(COMMERCE, _DEGREES, body="""
SELECT name, file, total, rank FROM (SELECT *, row_number() OVER (ORDER BY total DESC, in_degree DESC, file, name) AS rank FROM deg) WHERE name = 'small ring'"""),
    "callers": _with(COMMERCE, body=f"SELECT target, target_file, caller, caller_file, line, call_site_line, 1.0 AS confidence, kind FROM {_CALLERS} WHERE defs <= 1"),
    "callers_polymorphic": _with(COMMERCE, body=f"""
SELECT target, target_file, caller, caller_file, line, call_site_line, CASE WHEN target_file = 'brand/Brand2.py' THEN 1.0 ELSE 0.6 END AS confidence, kind
FROM {_CALLERS} WHERE target = 'small ring' AND defs > 1"""),
    "callees": _with(COMMERCE, body="""
SELECT f.name AS source, f.file AS source_file, t.name AS callee, t.file AS callee_file, e.line AS call_site_line, false AS external, 1.0 AS confidence,
  CASE e.kind WHEN 'CALLS' THEN 'call' ELSE 'reference' END AS kind
FROM edge e JOIN sym f ON f.id = e.src JOIN sym t ON t.id = e.dst WHERE e.kind IN ('CALLS', 'REFERENCES')"""),
    "callers_compact": _with(COMMERCE, body=f"""
SELECT target, caller, caller_file, kind, array_to_string(list_sort(list(DISTINCT call_site_line)), ',') AS call_sites, count(*) AS count, 1.0 AS confidence
FROM {_CALLERS} WHERE defs <= 1 GROUP BY target, caller, caller_file, kind"""),
    "ambiguity_candidates": _with(COMMERCE, body="""
SELECT name, file || '::' || name AS candidate, file, line, kind
FROM (SELECT *, row_number() OVER (PARTITION BY name, file ORDER BY line, kind) AS r, count(*) OVER (PARTITION BY name) AS c FROM sym)
WHERE r = 1 AND name IN (SELECT name FROM sym GROUP BY name HAVING count(DISTINCT file) > 1)"""),
    "suggest_similar": _with(EVENTS, body="""
SELECT wanted, rank, name FROM (
  SELECT wanted, name, row_number() OVER (PARTITION BY wanted ORDER BY levenshtein(name, wanted), name) AS rank
  FROM usr, (SELECT unnest(['usr_7', 'user_999', 'usre_42']) AS wanted) q) WHERE rank <= 3"""),
    "symbols_exact": _with(COMMERCE, body="""
SELECT name, file, kind, line, round(least(1 + 0.05 * coalesce(n, 0), 2.0), 6) AS score
FROM sym LEFT JOIN (SELECT t.name AS cn, t.file AS cf, count(*) AS n FROM edge e JOIN sym t ON t.id = e.dst WHERE e.kind = 'CALLS' GROUP BY ALL) ON cn = name AND cf = file
WHERE name = 'small ring' ORDER BY score DESC, file, line LIMIT 10"""),
    "symbols_fuzzy": _with(COMMERCE, """
scored AS (SELECT *, CASE WHEN starts_with(lower(name), 'small rin') THEN 0.5 WHEN contains(lower(name), 'small rin') THEN 0.3 ELSE 0.0 END AS bonus, levenshtein(name, 'small rin') AS d FROM sym),
scale AS (SELECT greatest(d, 1) AS s FROM scored ORDER BY bonus, d DESC LIMIT 1)""", body="""
SELECT name, file, kind, line, round(least(greatest(bonus + 0.5 - 0.5 * d / s, 0), 1), 6)::DOUBLE AS score FROM scored, scale ORDER BY bonus DESC, d, name, file, line LIMIT 10"""),
    "symbols_contains": _with(COMMERCE, body="""
SELECT name, file, kind, line, CASE WHEN starts_with(lower(name), 'ring') THEN 2.0 ELSE 1.0 END AS score FROM sym WHERE contains(lower(name), 'ring')
ORDER BY score DESC, lower(name), file, line LIMIT 50"""),
    "file_summary": _with(COMMERCE, body="""
SELECT file, count(*) AS n_symbols, string_agg(name, ',' ORDER BY line, name) AS symbols, '' AS imports FROM sym GROUP BY file"""),
    "large_functions": _with(COMMERCE, body="""
SELECT name, file, kind, line, line_end - line + 1 AS span FROM sym WHERE line_end - line + 1 >= 50 ORDER BY span DESC, file, name, line LIMIT 50"""),
    "paginate": _with(COMMERCE, body="SELECT name, file, line FROM sym ORDER BY file, line, name, id LIMIT 50 OFFSET 100"),
    "dup_suffix": _with(COMMERCE, body="""
SELECT id, CASE WHEN k > 0 THEN file || '::' || name || '#dup' || k ELSE file || '::' || name END AS unique_name
FROM (SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY line, id) - 1 AS k FROM sym)"""),
    "break_points": _with(COMMERCE, body="""
SELECT t.name AS target, f.file AS file, e.line, string_agg(DISTINCT f.name, ',' ORDER BY f.name) AS callers
FROM edge e JOIN sym f ON f.id = e.src JOIN sym t ON t.id = e.dst WHERE e.kind IN ('CALLS', 'REFERENCES') GROUP BY ALL"""),
    "importers_depth3": _with(LINKS, """
im AS (SELECT src, dst, bool_or(re_export) AS re FROM lk WHERE src <> dst GROUP BY src, dst),
h1 AS (SELECT dst AS target, src AS path, '' AS via, 1 AS depth, re FROM im),
h2 AS (SELECT a.target, b.src AS path, min(a.path) AS via, 2 AS depth, bool_or(b.re) AS re FROM h1 a JOIN im b ON b.dst = a.path WHERE a.re AND b.src <> a.target GROUP BY a.target, b.src),
h3 AS (SELECT a.target, b.src AS path, min(a.via) AS via, 3 AS depth, bool_or(b.re) AS re FROM h2 a JOIN im b ON b.dst = a.path WHERE a.re AND b.src <> a.target GROUP BY a.target, b.src)""", body="""
SELECT target, path, via, depth, re AS re_export FROM (SELECT *, row_number() OVER (PARTITION BY target, path ORDER BY depth) AS r FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3)) WHERE r = 1"""),
    "dead_code": _with(COMMERCE, _LIVE, body="SELECT name AS symbol, file, kind, line, 0.85 AS confidence FROM dead"),
    "dead_code_override_closure": _with(COMMERCE, _LIVE, """
over AS (SELECT src AS child, dst AS parent FROM edge WHERE kind = 'EXTENDS'),
rescued AS (SELECT child FROM over WHERE child IN (SELECT id FROM dead) AND parent NOT IN (SELECT id FROM dead) UNION SELECT over.child FROM over JOIN rescued r ON over.parent = r.child WHERE over.child IN (SELECT id FROM dead))""", body="SELECT child AS id FROM rescued", recursive=True),
    "dead_code_override_chains": """
WITH c AS (SELECT conv_id // 10 AS chain, row_number() OVER (PARTITION BY conv_id // 10 ORDER BY conv_id, turn) AS k FROM conversations)
SELECT chain || ':' || k AS id FROM c WHERE chain % 2 = 0 AND k > 1""",
    "override_chain_depth": """
WITH RECURSIVE t AS (SELECT conv_id, turn, conv_id || ':' || turn AS id FROM conversations),
up AS (SELECT id, conv_id, turn, 0 AS depth FROM t UNION ALL SELECT up.id, t.conv_id, t.turn, depth + 1 FROM up JOIN t ON t.conv_id = up.conv_id AND t.turn = up.turn - 1 WHERE depth < 10)
SELECT id, max(depth) AS depth FROM up GROUP BY id HAVING max(depth) > 0""",
    "bfs_impact": _with(EVENTS, _REACH.format(depth=2), body="SELECT * FROM reached", recursive=True),
    "bfs_impact_capped": _with(EVENTS, _REACH.format(depth=2), body="""
SELECT seed, name, depth, reason FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, reason = 'callee', name) AS r FROM reached) WHERE r <= 20""", recursive=True),
    "impacted_files": _with(EVENTS, _REACH.format(depth=1), body="""
SELECT seed, file AS path, depth, reason FROM (SELECT seed, file, depth, reason, row_number() OVER (PARTITION BY seed, file ORDER BY depth, CASE reason WHEN 'seed' THEN 0 WHEN 'caller' THEN 1 ELSE 2 END) AS r
FROM reached JOIN usr USING (name)) WHERE r = 1""", recursive=True),
    "impact_merged": _with(EVENTS, _REACH.format(depth=1), body="""
SELECT path, min(depth) AS depth, min(reason) FILTER (depth = m) AS reason, count(DISTINCT seed) AS seeds FROM (
  SELECT *, min(depth) OVER (PARTITION BY path) AS m FROM (
    SELECT seed, file AS path, depth, reason, row_number() OVER (PARTITION BY seed, file ORDER BY depth, CASE reason WHEN 'seed' THEN 0 WHEN 'caller' THEN 1 ELSE 2 END) AS r FROM reached JOIN usr USING (name)) WHERE r = 1)
GROUP BY path""", recursive=True),
}

_FILES1 = """
f1 AS (SELECT seed, path, depth, reason FROM (SELECT seed, file AS path, depth, reason, row_number() OVER (PARTITION BY seed, file ORDER BY depth, CASE reason WHEN 'seed' THEN 0 WHEN 'caller' THEN 1 ELSE 2 END) AS r
  FROM reached JOIN usr USING (name)) WHERE r = 1)"""

_SECTIONS = """
br AS (SELECT t.name AS seed, count(DISTINCT f.file || '|' || e.line) AS breaks, count(DISTINCT f.file) AS files, max(e.line) AS deepest FROM edge e JOIN sym f ON f.id = e.src JOIN supp t ON t.id = e.dst WHERE e.kind = 'CALLS' GROUP BY 1),
ts AS (SELECT t.name AS seed, count(DISTINCT e.line) AS tests FROM edge e JOIN supp t ON t.id = e.src WHERE e.kind = 'TESTED_BY' GROUP BY 1),
gs AS (SELECT t.name AS seed, count(*) AS guessed FROM edge e JOIN supp t ON t.id = e.dst WHERE e.kind = 'CALLS_HEURISTIC' GROUP BY 1),
sec AS (SELECT supp.name AS seed, coalesce(breaks, 0) AS breaks, coalesce(files, 0) AS files, coalesce(deepest, 0) AS deepest, coalesce(tests, 0) AS tests, coalesce(guessed, 0) AS guessed
  FROM supp LEFT JOIN br ON br.seed = supp.name LEFT JOIN ts ON ts.seed = supp.name LEFT JOIN gs ON gs.seed = supp.name)"""
_LEVEL = "CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS level"

_CO = """
cc AS (SELECT * FROM cm WHERE NOT is_merge),
mine AS (SELECT sha, path AS target FROM cc QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, sha DESC) <= 200),
pair AS (SELECT target, o.path, count(*) AS commits FROM mine JOIN cc o ON o.sha = mine.sha AND o.path <> mine.target
  WHERE o.sha IN (SELECT sha FROM cc GROUP BY sha HAVING count(*) <= 50) GROUP BY ALL)"""

_FREQ = """fr AS (SELECT path, count(DISTINCT sha) AS commits FROM cm WHERE NOT is_merge GROUP BY path),
md AS (SELECT list_sort(list(commits))[(count(*) // 2 + 1)::BIGINT] AS median FROM fr)"""

_PARTS = """
ps AS (SELECT 'p' || p_partkey AS id, p_name AS name, 'brand/' || replace(p_brand, '#', '') || '/' || lower(p_type) || '.py' AS file, 'brand/' || replace(p_brand, '#', '') AS brand,
  CASE WHEN p_size > 25 THEN 'interface' ELSE 'class' END AS kind, p_partkey AS seq, p_size % 2 = 0 AS is_override FROM part),
own AS (SELECT file, name, arg_min(id, seq) AS id, min(seq) AS seq FROM ps GROUP BY file, name),
fl AS (SELECT DISTINCT file, brand FROM ps),
im AS (SELECT DISTINCT ON (a.file, n.name) a.file, n.name AS local, b.file AS target_file, n.name AS original
  FROM fl a JOIN fl b ON a.brand = b.brand AND a.file <> b.file JOIN (SELECT file, min(name) AS name FROM ps GROUP BY file) n ON n.file = b.file ORDER BY a.file, n.name, b.file),
pend AS (SELECT a.file, a.name AS caller, CASE WHEN l_linenumber = 7 THEN 'supplier ' || l_suppkey ELSE b.name END AS callee, l_linenumber::BIGINT AS line
  FROM lineitem JOIN ps a ON a.seq = l_partkey JOIN ps b ON b.seq = l_suppkey),
wanted AS (SELECT DISTINCT file, callee AS name FROM pend),
near AS (SELECT file, name, id FROM (SELECT w.file, w.name, o.id, row_number() OVER (PARTITION BY w.file, w.name
    ORDER BY CASE WHEN w.file = o.file THEN 3 WHEN split_part(w.file, '/', 2) = split_part(o.file, '/', 2) THEN 2 ELSE 1 END DESC, o.seq) AS r FROM wanted w JOIN own o ON o.name = w.name) WHERE r = 1)"""

ORACLES |= {
    "explain_confidence": _with(EVENTS, _REACH.format(depth=2), _FILES1, body="""
SELECT seed, path, depth, reason,
  CASE WHEN reason = 'seed' THEN 'changed_directly' WHEN depth = 1 AND reason = 'caller' THEN 'called_by_seed_directly' WHEN depth = 1 THEN 'calls_seed_directly'
       WHEN depth = 2 AND reason = 'callee' THEN 'sibling_in_same_class' ELSE 'shared_dependency' END AS relation,
  CASE WHEN depth < 2 THEN 1.0 WHEN depth = 2 AND reason = 'callee' THEN 0.7 ELSE 0.4 END AS confidence FROM f1""", recursive=True),
    "impact_text_filter": _with(EVENTS, _REACH.format(depth=1), _FILES1, body="SELECT seed, path, depth, reason FROM f1", recursive=True),
    "impact_capped": _with(EVENTS, _REACH.format(depth=1), _FILES1, body="""
SELECT seed, path, depth, total_available, total_available > 5 AS truncated FROM (
  SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, path) AS r, count(*) OVER (PARTITION BY seed) AS total_available FROM f1) WHERE r <= 5""", recursive=True),
    "affected_tests": _with(EVENTS, """
u AS (SELECT name, CASE WHEN k % 10 < 3 THEN 'tests/test_' || (k % 10) || '_t' || (3 + k % 7) || '.py' ELSE 'team/t' || (k % 10) || '.py' END AS file, k % 10 < 3 AS test FROM usr),
hop AS (SELECT name AS seed, name AS node, 0 AS n FROM u UNION SELECT seed, b, n + 1 FROM hop JOIN call ON a = hop.node WHERE n < 3),
edge_ AS (SELECT DISTINCT seed, x.file AS path FROM (SELECT DISTINCT seed, node FROM hop) h JOIN u prod ON prod.name = h.node AND NOT prod.test JOIN call ON call.b = h.node JOIN u x ON x.name = call.a AND x.test
  UNION SELECT name, file FROM u WHERE test),
said AS (SELECT u.name AS seed, f.file AS path FROM u, (SELECT DISTINCT file FROM u WHERE test) f WHERE contains(f.file, u.name) OR contains(f.file, regexp_replace(parse_filename(u.file), '[.]py$', '')))""", body="""
SELECT seed, path, CASE WHEN bool_or(e) THEN 'edge' ELSE 'convention' END AS reason FROM (SELECT *, true AS e FROM edge_ UNION ALL SELECT *, false FROM said) GROUP BY seed, path""", recursive=True),
    "impact_risk": _with(COMMERCE, _SECTIONS, body=f"""
SELECT seed, score, {_LEVEL} FROM (SELECT seed, round(least(0.4::DOUBLE * (CASE WHEN breaks = 0 THEN 0 ELSE greatest(least(1 - tests / breaks, 1), 0) END) + 0.3::DOUBLE * least(files / 20.0::DOUBLE, 1) + 0.15::DOUBLE * least(deepest / 7, 1)
  + 0.15::DOUBLE * ((CASE WHEN guessed % 2 > 0 THEN 0.5::DOUBLE ELSE 0 END) + (CASE WHEN guessed % 3 > 0 THEN 0.5::DOUBLE ELSE 0 END)), 1), 6) AS score FROM sec)"""),
    "risk_composite": _with(COMMERCE, _SECTIONS, body=f"""
SELECT seed, score, {_LEVEL} FROM (SELECT seed, round(CASE WHEN files = 0 AND breaks = 0 AND guessed = 0 THEN 0 ELSE least(0.4::DOUBLE * (CASE WHEN breaks = 0 THEN 0.5::DOUBLE ELSE greatest(least(1 - tests / breaks, 1), 0) END)
  + 0.3::DOUBLE * least(files / 20.0::DOUBLE, 1) + 0.15::DOUBLE * least(guessed / 20.0::DOUBLE, 1) + 0.15::DOUBLE * (CASE WHEN guessed > 0 THEN (guessed // 2) / guessed ELSE 0 END), 1) END, 6) AS score FROM sec)"""),
    "rename_sites": _with(COMMERCE, body="""
SELECT file, line, kind, max(confidence) AS confidence, symbol FROM (
  SELECT file, line, 'definition' AS kind, 1.0 AS confidence, name AS symbol FROM prt WHERE name = 'small ring' AND file = 'brand/Brand2.py'
  UNION ALL SELECT f.file, e.line, 'reference', CASE WHEN t.file = 'brand/Brand2.py' THEN 0.7 ELSE 0.6 END, f.name FROM edge e JOIN sym f ON f.id = e.src JOIN prt t ON t.id = e.dst WHERE e.kind = 'REFERENCES' AND t.name = 'small ring')
GROUP BY file, line, kind, symbol"""),
    "rename_blockers": """
WITH ln AS (SELECT 'p' || page_id AS path, string_split(regexp_replace(html, chr(10) || '$', ''), chr(10)) AS ls FROM pages),
l AS (SELECT path, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM ln)
SELECT path, line_no::INT AS line_no FROM l WHERE len(list_filter(regexp_extract_all(line, '("(?:[^"\\\\]|\\\\.)*"|''(?:[^''\\\\]|\\\\.)*''|`(?:[^`\\\\]|\\\\.)*`)'), lambda x: regexp_matches(x, '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)'))) > 0""",
    "architecture_modules": _with(COMMERCE, body="SELECT parse_filename(file) AS module, file AS root, 1 AS files, count(*) AS symbol_count FROM sym GROUP BY file"),
    "architecture_modules_capped": _with(COMMERCE, body="SELECT parse_filename(file) AS module, file AS root, 1 AS files, count(*) AS symbol_count FROM sym GROUP BY file ORDER BY symbol_count DESC, module LIMIT 7"),
    "architecture_edges": _with(COMMERCE, body="""
SELECT parse_filename(f.file) AS from_module, parse_filename(t.file) AS to_module, CASE e.kind WHEN 'EXTENDS' THEN 'extends' ELSE 'calls' END AS kind, count(*) AS weight
FROM edge e JOIN sym f ON f.id = e.src JOIN sym t ON t.id = e.dst WHERE e.kind IN ('CALLS', 'REFERENCES', 'EXTENDS') AND f.file <> t.file GROUP BY ALL"""),
    "module_longest_prefix": """
WITH pg AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '', 'g') AS path FROM pages),
root AS (SELECT split_part(path, '/', 1) AS root FROM pg UNION SELECT split_part(path, '/', 1) || '/en' FROM pg UNION SELECT regexp_replace(split_part(path, '/', 1), '^.*\\.(example\\.[a-z]+)$', '\\1') FROM pg)
SELECT path, root FROM (SELECT pg.path, root.root, row_number() OVER (PARTITION BY pg.path ORDER BY length(root.root) DESC) AS r FROM pg JOIN root ON pg.path = root.root OR starts_with(pg.path, root.root || '/')) WHERE r = 1""",
    "co_change": _with(COMMITS, _CO, body="SELECT * FROM pair"),
    "co_change_ranked": _with(COMMITS, _CO, body="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY commits DESC, path) AS rank FROM pair) WHERE rank <= 5"),
    "co_change_importers": _with(COMMITS, _CO, """
pp AS (SELECT 'part/' || p_partkey || '.py' AS path, p_brand, p_type FROM part),
imp AS (SELECT path AS src, min(path) OVER (PARTITION BY p_brand, p_type) AS dst FROM pp)""", body="SELECT pair.* FROM pair JOIN imp ON imp.src = pair.path AND imp.dst = pair.target"),
    "commit_frequency_median": _with(COMMITS, _FREQ, body="SELECT median FROM md"),
    "hub_penalty": _with(COMMITS, _FREQ, body="SELECT path, commits, round(CASE WHEN commits / greatest(median, 1) <= 3 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / (1 + (commits / greatest(median, 1) - 3) / 3) END, 6) AS multiplier FROM fr, md"),
    "churn_bug": _with(COMMITS, body="""
SELECT path, count(*) AS commits, count(*) FILTER (subject = 'fix crash in part') AS bugs, round(least(count(*) / 20, 1), 6) AS churn, round(count(*) FILTER (subject = 'fix crash in part') / count(*), 6) AS bug_share
FROM cm WHERE NOT is_merge AND ts >= (SELECT max(ts) FROM cm WHERE NOT is_merge) - INTERVAL 90 DAY GROUP BY path"""),
    "import_map": _with(_PARTS, body="SELECT file, local, target_file, original FROM im"),
    "scope_proximal_resolution": _with(_PARTS, body="SELECT file, name, id FROM near"),
    "resolve_calls_tiers": _with(_PARTS, body="""
SELECT c.id AS src, coalesce(o.id, i.id, n.id, '__external__::' || callee) AS dst, p.line, min(CASE WHEN o.id IS NOT NULL THEN 1 WHEN i.id IS NOT NULL THEN 2 WHEN n.id IS NOT NULL THEN 3 ELSE 4 END) AS tier
FROM (SELECT DISTINCT * FROM pend) p JOIN own c ON c.file = p.file AND c.name = p.caller LEFT JOIN own o ON o.file = p.file AND o.name = callee
LEFT JOIN im ON im.file = p.file AND im.local = callee LEFT JOIN own i ON i.file = im.target_file AND i.name = im.original LEFT JOIN near n ON n.file = p.file AND n.name = callee GROUP BY ALL"""),
    "implements_subset": _with(_PARTS, """
head AS (SELECT name, arg_min(id, seq) AS id, arg_min(kind, seq) AS kind FROM ps GROUP BY name),
ext AS (SELECT DISTINCT o.id AS src, h.id AS dst, h.kind AS k FROM ps a JOIN ps b ON b.seq = a.seq + 1 JOIN own o ON o.file = a.file AND o.name = a.name JOIN head h ON h.name = b.name WHERE o.id <> h.id)""", body="""
SELECT 'EXTENDS' AS kind, src, dst FROM ext UNION ALL SELECT 'IMPLEMENTS', src, dst FROM ext WHERE k = 'interface'"""),
    "contains_members": _with(_PARTS, """
cls AS (SELECT file, arg_min(id, seq) AS cls FROM ps GROUP BY file)""", body="SELECT cls AS src, id AS dst FROM ps JOIN cls USING (file) WHERE id <> cls"),
    "overrides": _with(_PARTS, """
cls AS (SELECT file, any_value(brand) AS brand, arg_min(id, seq) AS cls FROM ps GROUP BY file),
two AS (SELECT brand, cls AS parent, row_number() OVER (PARTITION BY brand ORDER BY file) AS r FROM cls QUALIFY r <= 2),
par AS (SELECT c.cls AS child, arg_max(t.parent, t.r) AS parent FROM cls c JOIN two t ON t.brand = c.brand AND t.parent <> c.cls GROUP BY c.cls),
mem AS (SELECT cls, id, name, is_override, seq FROM ps JOIN cls USING (file) WHERE id <> cls)""", body="""
SELECT DISTINCT m.id AS src, arg_min(q.id, q.seq) AS dst FROM mem m JOIN par ON par.child = m.cls AND par.parent <> m.cls JOIN mem q ON q.cls = par.parent AND q.name = m.name WHERE m.is_override GROUP BY m.id"""),
    "decorates_resolution": _with(_PARTS, body="SELECT DISTINCT o.id AS src, ps.id AS dst, '' AS decorator_args FROM ps JOIN own o ON o.file = ps.file AND o.name = ps.name WHERE o.id <> ps.id"),
    "tested_by": """
SELECT n.conv_id || ':' || n.turn AS src, u.conv_id || ':' || u.turn AS dst FROM conversations u JOIN conversations n ON n.conv_id = u.conv_id AND n.turn = u.turn + 1 WHERE u.role = 'user' AND n.role <> 'user'""",
    "change_set": _with(DOCS, body="""
SELECT path, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'deleted' WHEN length(text) < 500 THEN 'modified' ELSE 'unchanged' END AS status FROM doc
UNION ALL SELECT 'bench/' || item_id, 'added' FROM benchmark"""),
    "health_summary": _with(COMMERCE, body="""
SELECT (SELECT count(*) FROM (SELECT id FROM (SELECT src AS id FROM edge WHERE kind IN ('CALLS', 'CALLS_HEURISTIC') UNION ALL SELECT dst FROM edge WHERE kind IN ('CALLS', 'CALLS_HEURISTIC')) GROUP BY id HAVING count(*) >= 10)) AS loose_hubs,
  (SELECT count(*) FROM sym WHERE NOT EXISTS (SELECT 1 FROM edge WHERE dst = id AND edge.kind IN ('CALLS', 'REFERENCES'))) AS loose_dead,
  (SELECT count(DISTINCT src) FROM edge WHERE kind = 'TESTED_BY') AS tested"""),
    "index_counts": _with(COMMERCE, body="""
SELECT 'file' AS what, 'python' AS kind, count(DISTINCT file) AS n FROM sym UNION ALL SELECT 'symbol', kind, count(*) FROM sym GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edge GROUP BY kind"""),
    "ego_graph": _with(COMMERCE, body="SELECT id, name, file, kind FROM sym WHERE id = 's7' OR id IN (SELECT src FROM edge WHERE dst = 's7' UNION SELECT dst FROM edge WHERE src = 's7') ORDER BY id <> 's7', id LIMIT 5000"),
    "file_facts": _with(DOCS, body="SELECT path, strlen(text)::BIGINT AS size, (length(text) - length(replace(text, chr(10), '')))::BIGINT AS loc, sha256(text) AS hash FROM doc"),
    "path_predicates": """
SELECT page_id, (page_id % 8) IN (0, 1, 2, 3) AS is_test, (page_id % 8) = 4 AS is_vendored, (page_id % 8) IN (5, 6) AS is_routed, (page_id % 8) = 7 AS is_generated FROM pages""",
    "diff_paths": """
SELECT l_orderkey AS key, 'part/' || l_partkey || '.py' AS path, (min(3 * (r - 1)))::INT AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem)) GROUP BY l_orderkey, l_partkey""",
    "route_extract": """
SELECT 'site/' || page_id || '/urls.py' AS path, 'ANY' AS method, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS route, 'show_3' AS handler FROM pages WHERE page_id % 7 = 3""",
    "config_mentions": _with(DOCS, """
ln AS (SELECT replace(path, '.txt', '.yaml') AS path, string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)) AS ls FROM doc WHERE contains(text, 'token')),
l AS (SELECT path, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM ln)""", body="""
SELECT path, line_no::INT AS line_no, trim(line, ' ') AS text FROM l WHERE regexp_matches(line, '(^|[^A-Za-z0-9_])token([^A-Za-z0-9_]|$)')"""),
    "string_literals": """
SELECT page_id, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::BIGINT AS n, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))), ',') AS targets FROM pages""",
    "line_snippet": _with(DOCS, body="""
SELECT path, (doc_id % 5 + 1)::BIGINT AS line, coalesce(array_to_string(list_slice(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)), doc_id % 5 + 1, doc_id % 5 + 3), chr(10)), '') AS snippet FROM doc"""),
    "token_estimate": _with(DOCS, body="SELECT doc_id, length(text) // 4 AS snippet_tokens, (strlen(text) + 3) // 4 AS file_tokens FROM doc"),
    "bm25_topk": _with(DOCS, """
wd AS (SELECT path, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]{2,}')) AS w FROM doc),
tk AS (SELECT path, lower(w) AS term FROM wd UNION ALL SELECT path, lower(x) FROM (SELECT path, unnest(string_split(w, '_')) AS x FROM wd WHERE contains(w, '_')) WHERE length(x) >= 2),
dl AS (SELECT doc.path, count(term) AS dl FROM doc LEFT JOIN tk ON tk.path = doc.path GROUP BY doc.path),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT path, term, count(*) AS f FROM tk WHERE term IN ('token', 'password', 'the_secret', 'the', 'secret') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)""", body="""
SELECT path, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * f * 2.5 / (f + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
FROM tf JOIN df USING (term) JOIN dl USING (path), st GROUP BY path ORDER BY score DESC, path LIMIT 50"""),
    "prf_scores": _with(DOCS, """
j AS (SELECT source AS task, count(*) FILTER (quality = 1 AND length(text) < 3000) AS tp, count(*) FILTER (quality <> 1 AND length(text) < 3000) AS fp, count(*) FILTER (quality = 1 AND length(text) >= 3000) AS fn
  FROM doc JOIN labels USING (doc_id) GROUP BY source)""", body="""
SELECT task, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN tp + fp + fn = 0 THEN 1 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f FROM j"""),
    "mrr": _with(DOCS, """
r AS (SELECT source AS task, quality, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS k FROM doc JOIN labels USING (doc_id))""", body="""
SELECT task, round(coalesce(1 / min(k) FILTER (quality = 0), 0), 6) AS rr FROM r GROUP BY task"""),
    "token_cost_prefix": _with(DOCS, """
r AS (SELECT source AS task, quality, sum(length(text) // 4) OVER w AS spent, sum((quality = 0)::INT) OVER w AS hits, sum((quality = 0)::INT) OVER (PARTITION BY source) AS want
  FROM doc JOIN labels USING (doc_id) WINDOW w AS (PARTITION BY source ORDER BY length(text) DESC, doc_id))""", body="""
SELECT task, min(spent) FILTER (2 * hits >= want)::BIGINT AS tokens_50, min(spent) FILTER (hits >= want)::BIGINT AS tokens_100 FROM r WHERE want > 0 GROUP BY task"""),
    "spearman_rank": """
WITH v AS (SELECT p_size AS x, round(p_retailprice % 97, 2) AS y FROM part),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM v)
SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r""",
    "threshold_sweep": _with(DOCS, """
s AS (SELECT least(length(text) / 4000, 1) AS score, quality = 0 AS pos FROM doc JOIN labels USING (doc_id)),
c AS (SELECT th::DOUBLE AS threshold, count(*) FILTER (score >= th AND pos) AS tp, count(*) FILTER (score >= th AND NOT pos) AS fp, count(*) FILTER (score < th AND pos) AS fn FROM s, (SELECT unnest([0.1, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS th) GROUP BY th)""", body="""
SELECT threshold, tp, fp, fn, round(coalesce(2 * tp / nullif(2 * tp + fn + fp, 0), 0), 6) AS f1, round(coalesce(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 0), 6) AS f2 FROM c"""),
    "impact_composite": _with(COMMERCE, _SECTIONS, body="""
SELECT seed, round(0.4::DOUBLE * tests / 7 + 0.3::DOUBLE * least(files / 25, 1) + 0.15::DOUBLE * (CASE WHEN breaks = 0 THEN 0 ELSE least(deepest / 7, 1) END) + 0.15::DOUBLE * files / greatest(breaks, 1), 6) AS score FROM sec"""),
    "score_summary": """
SELECT event_type, count(*) AS n, round(avg(value / 100), 6) AS mean, round(quantile_disc(value / 100, 0.95), 6) AS p95, round(avg((value / 100 >= 0.5)::INT), 6) AS pass_rate FROM events GROUP BY event_type""",
    "debounce_sessions": """
WITH g AS (SELECT event_type, ts, coalesce(ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) >= INTERVAL 15 MINUTE, true)::INT AS opens FROM events),
s AS (SELECT event_type, ts, sum(opens) OVER (PARTITION BY event_type ORDER BY ts) AS k FROM g)
SELECT event_type, max(ts) + INTERVAL 15 MINUTE AS fired_at, min(ts) AS started_at, least(count(*), 10) AS n, count(*) > 10 AS dirty FROM s GROUP BY event_type, k""",
    "lang_stats_threshold": _with(DOCS, body="""
SELECT lang, count(*) AS files, count(*) FILTER (quality <> 1) AS failed, round(count(*) FILTER (quality <> 1) / count(*), 6) AS share, count(*) FILTER (quality <> 1) / count(*) > 0.15 AS alert
FROM doc JOIN labels USING (doc_id) GROUP BY lang"""),
}

_WALKS = ", ".join(f"w{k} AS (SELECT s, t, sum(p)::DOUBLE AS p FROM (SELECT w.s, n.b AS t, w.p FROM w{k - 1} w JOIN nb n ON n.a = w.t) WHERE (s, t) NOT IN (SELECT s, t FROM d{k - 1}) GROUP BY s, t), d{k} AS (SELECT s, t, d, p FROM d{k - 1} UNION ALL SELECT s, t, {k}, p FROM w{k})" for k in range(1, 9))
_BETWEEN = f"""
nb AS (SELECT a, b FROM call UNION SELECT b, a FROM call),
nodes AS (SELECT DISTINCT a AS v FROM nb), w0 AS (SELECT v AS s, v AS t, 1.0::DOUBLE AS p FROM nodes), d0 AS (SELECT s, t, 0 AS d, p FROM w0), {_WALKS},
bc AS (SELECT x.t AS v, sum(x.p * y.p / z.p) AS b FROM d8 x JOIN d8 y ON y.s = x.t JOIN d8 z ON z.s = x.s AND z.t = y.t AND z.d = x.d + y.d WHERE x.s <> x.t AND y.s <> y.t GROUP BY x.t),
res AS (SELECT usr.name, file, round(coalesce(b, 0) / 2 / ((SELECT count(*) - 1 FROM nodes) * (SELECT count(*) - 2 FROM nodes)), 6)::DOUBLE AS betweenness FROM nodes JOIN usr ON usr.name = nodes.v LEFT JOIN bc ON bc.v = nodes.v)"""
ORACLES |= {
    "betweenness": _with(EVENTS, _BETWEEN, body="SELECT * FROM res"),
    "bridges_topn": _with(EVENTS, _BETWEEN, body="SELECT * FROM res WHERE betweenness > 0 ORDER BY betweenness DESC, file, name LIMIT 10"),
}

ORACLES["budget_fold"] = """
WITH RECURSIVE it AS (
  SELECT conv_id AS key, section, turn, length(text) // 4 AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY section, turn) AS k
  FROM (SELECT *, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS section FROM conversations)),
f AS (
  SELECT DISTINCT key, 0::BIGINT AS k, 0::BIGINT AS used, -1 AS closed, '' AS taken FROM it
  UNION ALL
  SELECT f.key, it.k, CASE WHEN closed = section OR used + tokens > 300 THEN used ELSE used + tokens END,
    CASE WHEN closed <> section AND used + tokens > 300 THEN section ELSE closed END,
    CASE WHEN closed = section OR used + tokens > 300 THEN taken WHEN taken = '' THEN turn::VARCHAR ELSE taken || ',' || turn END
  FROM f JOIN it ON it.key = f.key AND it.k = f.k + 1)
SELECT key, used, taken FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY k DESC) = 1"""
