"""SQL for the queries of queries_tables: tries by prefixes of strings, and what follows from them, without the engine."""

from __future__ import annotations

from automill.oracles import _NAMES, _digits
from automill.oracles import ORACLES as _ENGINE

# The automaton of the parts: patterns, prefixes, states s, edges e and their bytes y.
_P = "p AS (SELECT DISTINCT p_name AS code, lower(p_name) AS t, 2 AS st, false AS rep FROM part UNION SELECT DISTINCT p_type, lower(p_type), 1, true FROM part)"
_S = (
    f"{_P}, pre AS (SELECT st, k::INT AS depth, substr(t, 1, k) AS pre, bool_or(k = len(t)) AS is_report, bool_or(rep AND k = len(t)) AS rep, min(code) FILTER (k = len(t)) AS report_code "
    "FROM p, range(1, len(t) + 1) r(k) GROUP BY st, k, substr(t, 1, k)), "
    "s AS (SELECT (row_number() OVER (ORDER BY st, depth, md5(concat(st, ':', pre))) - 1)::INT AS state_id, md5(concat(st, ':', pre)) AS str_id, "
    "CASE WHEN depth = 1 THEN st ELSE 0 END AS start_kind, * FROM pre)"
)
_E = (
    "e AS (SELECT a.state_id AS src, b.state_id AS dst FROM s a JOIN s b ON a.st = b.st AND b.depth = a.depth + 1 AND a.pre = substr(b.pre, 1, a.depth) "
    "UNION SELECT state_id, state_id FROM s WHERE right(pre, 1) = ' ' "
    "UNION SELECT b.state_id, a.state_id FROM s b JOIN s a ON a.st = b.st AND a.depth = 1 AND a.pre = substr(b.pre, 1, 1) WHERE b.rep)"
)
_B = "y AS (SELECT state_id, str_id, b::INT AS b FROM s, range(256) r(b) WHERE right(pre, 1) = ' ' OR b IN (ascii(right(pre, 1)), ascii(upper(right(pre, 1)))))"
_R = "g AS (SELECT *, b - row_number() OVER (PARTITION BY state_id ORDER BY b) AS island FROM y)"
_D = "d AS (SELECT state_id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM s LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY dst) i ON dst = state_id LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) o ON src = state_id)"
_C = (
    "c AS (SELECT state_id, (dense_rank() OVER (ORDER BY root) - 1)::INT AS cc_id FROM (SELECT s.state_id, r.state_id AS root FROM s JOIN s r ON r.st = s.st AND r.depth = 1 AND r.pre = substr(s.pre, 1, 1)))"
)
_COMPLETE = (
    "m AS (SELECT state_id, count(*) AS n_symbols, count(DISTINCT island) AS n_ranges, min(b) AS lo, max(b) AS hi FROM g GROUP BY state_id), "
    "k AS (SELECT *, n_ranges = 1 AS complete, n_ranges - 1 + (lo > 0)::INT + (hi < 255)::INT = 1 AS complement FROM m)"
)
#: Shortest ways between states; strong components, named by their least state; longest ways between these; breadth-first layers.
_WALK = (
    "w(a, b, d) AS (SELECT src, dst, 1 FROM e UNION SELECT w.a, e.dst, w.d + 1 FROM w JOIN e ON w.b = e.src WHERE w.d < 24), "
    "r AS (SELECT a, b, min(d) AS d FROM w GROUP BY a, b), "
    "q AS (SELECT s.state_id, coalesce(min(x.b), s.state_id) AS root FROM s LEFT JOIN "
    "(SELECT x.a, least(x.a, x.b) AS b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a) x ON s.state_id = x.a GROUP BY s.state_id), "
    "f AS (SELECT DISTINCT a.root AS a, b.root AS b FROM e JOIN q a ON e.src = a.state_id JOIN q b ON e.dst = b.state_id WHERE a.root <> b.root), "
    "l(root, d) AS (SELECT DISTINCT root, 0 FROM q UNION SELECT f.b, l.d + 1 FROM l JOIN f ON l.root = f.a), "
    "t AS (SELECT root, max(d) AS topo_order FROM l GROUP BY root), "
    "o AS (SELECT state_id FROM s WHERE state_id NOT IN (SELECT b FROM r WHERE a < b)), "
    "h AS (SELECT s.state_id, coalesce(z.d, 0)::INT AS bfs_layer FROM s LEFT JOIN (SELECT r.b, arg_min(r.d, r.a) AS d FROM r JOIN o ON r.a = o.state_id GROUP BY r.b) z ON z.b = s.state_id), "
    "n AS (SELECT state_id, cc_id, (row_number() OVER (PARTITION BY cc_id ORDER BY state_id) - 1)::INT AS cc_local_id, topo_order, bfs_layer, root AS scc_root "
    "FROM c JOIN q USING (state_id) JOIN t USING (root) JOIN h USING (state_id)), "
    "u AS (SELECT state_id, row_number() OVER (ORDER BY k, cc_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY cc_id ORDER BY bfs_layer, state_id) AS k FROM n) WHERE k <= 2), "
    "j AS (SELECT n.*, CASE WHEN place <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hot_degree FROM n LEFT JOIN u USING (state_id))"
)
_MATCH = (
    "x AS (SELECT state_id, string_agg(CASE WHEN y.b IS NULL THEN '0' ELSE '1' END, '' ORDER BY v.b DESC) AS matchset "
    "FROM (SELECT s.state_id, b FROM s, range(256) r(b)) v LEFT JOIN y USING (state_id, b) GROUP BY state_id)"
)
_TEXT = "(CASE WHEN right(pre, 1) = ' ' THEN '*' ELSE printf('[\\x%02x\\x%02x]', ascii(upper(right(pre, 1))), ascii(right(pre, 1))) END)"
_ORDER_BY = {
    "NONE": "", "REPORT": "is_report DESC, ", "TOPO_ORDER": "topo_order, ", "OUTDEGREE": "out_degree DESC, ", "BFS_LAYER": "bfs_layer, ",
    "COMPLETE": "complete DESC, ", "COMPLETE_AND_TOP": "complete DESC, topo_order, ", "COMPLETE_AND_BFS": "complete DESC, bfs_layer, ", "HOT_DEGREE": "hot_degree DESC, ",
}
_SUMMARY = (
    "count(*) AS states, count(*) FILTER (start_kind > 0) AS starts, count(*) FILTER (start_kind = 2) AS always_active, count(*) FILTER (is_report) AS reporting, "
    "(SELECT count(*) FROM z) AS components, (SELECT count(*) FILTER (n > 256) FROM z) AS components_over_256, (SELECT max(n) FROM z) AS max_component, (SELECT avg(n) FROM z) AS avg_component"
)
_Z = "z AS (SELECT cc_id, count(*) AS n FROM c GROUP BY cc_id)"

# Three automata: patterns by automaton, and the bytes that occur.
_P3 = (
    "p3 AS (SELECT 'names' AS nfa_id, lower(p_name) AS t, p_name AS code, 2 AS st, false AS rep FROM part UNION SELECT 'types', lower(p_type), p_type, 1, true FROM part "
    "UNION SELECT 'brands', lower(p_brand), p_brand, 2, false FROM part)"
)
_S3 = (
    f"{_P3}, pre3 AS (SELECT nfa_id, st, k::INT AS depth, substr(t, 1, k) AS pre, bool_or(k = len(t)) AS is_report, bool_or(rep AND k = len(t)) AS rep, min(code) FILTER (k = len(t)) AS report_code "
    "FROM p3, range(1, len(t) + 1) r(k) GROUP BY nfa_id, st, k, substr(t, 1, k)), "
    "s3 AS (SELECT (row_number() OVER (PARTITION BY nfa_id ORDER BY st, depth, md5(concat(st, ':', pre))) - 1)::INT AS state_id, md5(concat(st, ':', pre)) AS str_id, * FROM pre3)"
)
_LAST = "right(pre, 1)"
_IS_LETTER = f"{_LAST} BETWEEN 'a' AND 'z'"
_B3 = f"y3 AS (SELECT nfa_id, state_id, b::INT AS byte, {_LAST} = ' ' AS wild FROM s3, range(256) r(b) WHERE {_LAST} = ' ' OR b = ascii({_LAST}) OR b = ascii(upper({_LAST})))"


def _words(source: str, nfa: str, text: str, tail: str = "") -> str:
    """Tries of words, as CTEs v (states) of automata without gaps."""
    return (
        f"p AS (SELECT DISTINCT {nfa} AS nfa_id, unnest(regexp_extract_all(lower({text}), '[a-z]+')) AS t FROM {source}), "
        "v AS (SELECT *, (row_number() OVER (PARTITION BY nfa_id ORDER BY depth, str_id) - 1)::INT AS state_id FROM "
        "(SELECT nfa_id, k::INT AS depth, substr(t, 1, k) AS pre, md5(concat('2:', substr(t, 1, k))) AS str_id, bool_or(k = len(t)) AS is_report "
        f"FROM p, range(1, len(t) + 1) r(k) GROUP BY nfa_id, k, substr(t, 1, k)){tail})"
    )


def _grouped(order: str, size: str, capacity: int) -> str:
    """Components in an order into groups of at most so much."""
    return (
        f"o AS (SELECT cc_id, {size} AS n, row_number() OVER (ORDER BY {order}) AS k FROM a), "
        f"g(k, cc_id, grp, room) AS (SELECT k, cc_id, 0, {capacity} - n FROM o WHERE k = 1 UNION ALL "
        f"SELECT o.k, o.cc_id, g.grp + (o.n > g.room)::INT, CASE WHEN o.n > g.room THEN {capacity} - o.n ELSE g.room - o.n END FROM g JOIN o ON o.k = g.k + 1)"
    )


def _group_way(way: str, order: str, size: str, capacity: int) -> str:
    return f"SELECT '{way}' AS way, grp::INT AS group_id, cc_id FROM (WITH RECURSIVE {_grouped(order, size, capacity)} SELECT * FROM g)"


#: Where a part's name has a pattern of the automaton: a whole word, or two with something between them.
_FOUND = (
    "n AS (SELECT p_partkey::VARCHAR AS stream_id, lower(p_name) AS x FROM part), "
    "h AS (SELECT stream_id, x, code, t, st, split_part(t, ' ', 1) AS one, split_part(t, ' ', 2) AS two FROM n, p), "
    "f AS (SELECT stream_id, code, q + len(two) - 1 AS \"offset\" FROM (SELECT *, unnest(range(len(x))) AS q FROM h WHERE st = 2 AND two <> '') "
    "WHERE substr(x, q + 1, len(two)) = two AND contains(substr(x, 1, greatest(q - 1, 0)), one) "
    "UNION ALL SELECT stream_id, code, q + len(t) - 1 FROM (SELECT *, unnest(range(len(x))) AS q FROM h WHERE st = 2 AND two = '') WHERE substr(x, q + 1, len(t)) = t "
    "UNION ALL SELECT stream_id, code, len(t) - 1 FROM h WHERE st = 1 AND starts_with(x, t))"
)

_RUNS = (
    "v AS (SELECT 'user ' || (user_id % 10) AS app, CASE WHEN user_id % 2 = 0 THEN 'x' ELSE 'y' END AS config, "
    "CASE WHEN event_type = 'error' THEN -1.0::DOUBLE ELSE regexp_extract(props, '[0-9]+')::DOUBLE END AS value FROM events)"
)
_GRID = (
    "SELECT app, 'k=' || k AS config, r::INT AS repetition, CASE WHEN n > 0 THEN n::DOUBLE ELSE -1.0::DOUBLE END AS value FROM "
    "(SELECT app, k, (SELECT count(*) FROM events WHERE event_type = app AND user_id % k = 0) AS n FROM (VALUES ('click'), ('view'), ('nothing')) a(app), (VALUES (1), (2)) b(k)), range(2) c(r)"
)
_CLASS = (
    "t AS (SELECT DISTINCT event_type AS t, least(left(event_type, 1), right(event_type, 1)) AS a, greatest(left(event_type, 1), right(event_type, 1)) AS z FROM events), "
    "k AS (SELECT '[' || t || ']' AS class, b, contains(t, chr(b::INT)) AS has FROM t, range(1, 256) r(b) UNION SELECT '[^' || t || ']', b, b > 127 OR NOT contains(t, chr(b::INT)) FROM t, range(1, 256) r(b) "
    "UNION SELECT '[' || a || '-' || z || ']', b, b BETWEEN ascii(a) AND ascii(z) FROM t, range(1, 256) r(b) UNION SELECT '[^' || t || ']', 0, true FROM t)"
)

ORACLES: dict[str, str] = {
    "dictionary_states": f"WITH {_words('documents', chr(39) + 'words' + chr(39), 'text')} SELECT state_id, str_id, "
    "repeat('0', 2 * (ascii(right(pre, 1)) // 8)) || printf('%02X', (1 << (ascii(right(pre, 1)) % 8))::INT) || repeat('0', 62 - 2 * (ascii(right(pre, 1)) // 8)) AS bits, "
    "CASE WHEN depth = 1 THEN 2 ELSE 0 END AS start_kind, is_report, CASE WHEN is_report THEN pre END AS report_code FROM v",
    "dictionary_edges": f"WITH {_words('benchmark', 'item_id::VARCHAR', 'text')} SELECT a.nfa_id, a.state_id AS src, b.state_id AS dst FROM v a JOIN v b "
    "ON a.nfa_id = b.nfa_id AND b.depth = a.depth + 1 AND a.pre = left(b.pre, a.depth)",
    "dictionary_failures": f"WITH {_words('benchmark', 'item_id::VARCHAR', 'text')}, w AS (SELECT a.nfa_id, a.state_id, arg_max(b.state_id, b.depth) AS failure "
    "FROM (SELECT *, unnest(range(1, depth)) AS k FROM v) a JOIN v b ON a.nfa_id = b.nfa_id AND b.pre = right(a.pre, k) GROUP BY a.nfa_id, a.state_id) "
    "SELECT v.nfa_id, v.state_id, failure FROM v LEFT JOIN w USING (nfa_id, state_id)",
    "match_dictionary": "WITH w AS (SELECT DISTINCT t FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM benchmark) WHERE len(t) >= 8), "
    "z AS (SELECT DISTINCT len(t) AS n FROM w), c AS (SELECT lower(text) AS x, unnest(range(len(text))) AS q FROM conversations) "
    "SELECT w.t AS report_code, count(*) AS n FROM c, z JOIN w ON w.t = substr(x, q + 1, z.n) WHERE len(w.t) = z.n GROUP BY w.t",
    "match_indexed": " UNION ALL ".join(
        f"SELECT doc_id::VARCHAR AS stream_id, (strlen(left(text, q)) + {len(w) - 1})::BIGINT AS \"offset\", '{k}' AS report_code FROM "
        f"(SELECT doc_id, text, unnest(range(len(text))) AS q FROM documents WHERE contains(text, '{w}')) WHERE substr(text, q + 1, {len(w)}) = '{w}'"
        for k, w in enumerate(("Apache License", "Released under"))
    ),
    "match_folded": _ENGINE["match_multi_keyword_events"],
    "nfa_summary": f"WITH {_S}, {_C}, {_Z} SELECT 'names' AS nfa_id, {_SUMMARY} FROM s",
    "nfa_extended_summary": f"WITH {_S}, {_E}, {_B}, {_R}, {_COMPLETE}, {_D}, {_C}, {_Z} SELECT 'names' AS nfa_id, {_SUMMARY}, (SELECT min(n) FROM z) AS min_component, "
    "(SELECT count(*) FILTER (n > 512) FROM z) AS components_over_512, (SELECT count(*) FROM e) AS edges, (SELECT max(in_degree) FROM d) AS max_in_degree, "
    "(SELECT max(out_degree) FROM d) AS max_out_degree, (SELECT avg(in_degree) FROM d) AS avg_in_degree, (SELECT avg(out_degree) FROM d) AS avg_out_degree, "
    "(SELECT count(*) FILTER (complete) FROM k) AS complete, (SELECT count(*) FILTER (complement) FROM k) AS complement, "
    "(SELECT count(*) FROM e)::DOUBLE / (count(*) * count(*)) AS density FROM s",
    "nfa_degree_hist": f"WITH {_S}, {_E}, {_D}, u AS (SELECT 'in' AS kind, in_degree AS degree FROM d UNION ALL SELECT 'out', out_degree FROM d) "
    "SELECT 'names' AS nfa_id, kind, degree, count(*) AS n FROM u GROUP BY kind, degree",
    "nfa_in_degree_hist": f"WITH {_S}, {_E}, {_D} SELECT 'names' AS nfa_id, least(in_degree, 5) AS bucket, count(*) AS n FROM d GROUP BY 2",
    "nfa_log_degree_hist": f"WITH {_S}, {_E}, {_D} SELECT 'names' AS nfa_id, CASE WHEN out_degree = 0 THEN 0 ELSE floor(log2(out_degree))::INT + 1 END AS bucket, count(*) AS n FROM d GROUP BY 2",
    "nfa_components": f"WITH {_S}, {_C} SELECT 'names' AS nfa_id, state_id, cc_id, (row_number() OVER (PARTITION BY cc_id ORDER BY state_id) - 1)::INT AS cc_local_id FROM c",
    "nfa_counts": f"WITH {_S}, {_E} SELECT 'names' AS nfa_id, (SELECT count(*) FROM s) AS states, (SELECT count(*) FROM e) AS transitions, (SELECT count(*) FROM s WHERE right(pre, 1) = ' ') AS wide_loops",
    "nfa_layers": f"WITH RECURSIVE {_S}, {_E}, {_C}, {_WALK} SELECT 'names' AS nfa_id, state_id, cc_id, cc_local_id, scc_root, topo_order, bfs_layer FROM n",
    "nfa_alphabet": f"WITH {_S}, {_B} SELECT DISTINCT 'names' AS nfa_id, b AS byte FROM y JOIN s USING (state_id) WHERE right(pre, 1) <> ' '",
    "alphabets": f"WITH {_S3}, {_B3} SELECT DISTINCT 'any' AS kind, nfa_id, byte FROM y3 UNION SELECT 'no_wildcard', nfa_id, byte FROM y3 WHERE NOT wild",
    "dag_classes": "SELECT 'types' AS nfa_id, 0 AS dag_class FROM part HAVING count(p_type) > 0 UNION ALL SELECT 'names', CASE WHEN bool_or(contains(p_name, ' ')) THEN 1 ELSE 2 END FROM part "
    "UNION ALL SELECT 'brands', CASE WHEN bool_or(contains(p_brand, ' ')) THEN 1 ELSE 2 END FROM part",
    "strong_components_orders": "WITH RECURSIVE x AS (SELECT (o_custkey * 2)::INT AS c, (l_suppkey * 2 + 1)::INT AS s, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey), "
    "e AS (SELECT c AS src, s AS dst FROM x WHERE l_returnflag IS DISTINCT FROM 'R' UNION SELECT s, c FROM x WHERE l_returnflag = 'R'), "
    "v AS (SELECT src AS state_id FROM e UNION SELECT dst FROM e), w(a, b) AS (SELECT src, dst FROM e UNION SELECT w.a, e.dst FROM w JOIN e ON w.b = e.src) "
    "SELECT state_id, least(state_id, coalesce((SELECT min(x.b) FROM w x JOIN w y ON x.a = y.b AND x.b = y.a WHERE x.a = state_id), state_id)) AS scc_root FROM v",
    "incompatible_pairs": f"WITH RECURSIVE {_S}, {_E}, {_B}, rch AS (SELECT src, dst FROM e UNION SELECT state_id, state_id FROM s WHERE start_kind = 2), "
    "sh AS (SELECT DISTINCT a.state_id AS a, b.state_id AS b FROM y a JOIN y b USING (b)), "
    "z(x, y) AS (SELECT least(a.state_id, b.state_id), greatest(a.state_id, b.state_id) FROM s a, s b WHERE a.start_kind > 0 OR a.is_report OR a.state_id = b.state_id "
    "UNION SELECT least(p.dst, q.dst), greatest(p.dst, q.dst) FROM z JOIN rch p ON p.src = z.x JOIN rch q ON q.src = z.y JOIN sh ON sh.a = p.dst AND sh.b = q.dst) SELECT x, y FROM z",
    "start_states": f"WITH {_S} SELECT 'names' AS nfa_id, state_id, start_kind = 2 AS always_active FROM s WHERE start_kind > 0",
    "neighbours": f"WITH {_S}, {_E}, f AS (SELECT state_id FROM s WHERE st = 2 AND pre = 's') SELECT true AS outgoing, dst AS neighbour FROM e JOIN f ON src = state_id UNION ALL SELECT false, src FROM e JOIN f ON dst = state_id",
    "hot_by_layer": f"WITH RECURSIVE {_S}, {_E}, {_C}, {_WALK} SELECT cc_id, state_id, hot_degree FROM j",
    "memo_length_hist": f"WITH {_S}, z AS (SELECT sum(CASE WHEN substr(pre, 1, 1) = ' ' OR right(pre, 1) = ' ' THEN NULL ELSE 4 END)::BIGINT AS n FROM s WHERE st = 2 AND depth = 2) "
    "SELECT 0 AS g, 1 AS n_states, n AS grams FROM z UNION ALL SELECT 0, 0, 65536 - n FROM z",
    "memo_cutoff": f"WITH {_S} SELECT 0 AS g, 1.0::DOUBLE AS mean_length, 1.0::DOUBLE AS median_length, (4 * count(*) + 4 * count(*) FILTER (is_report))::BIGINT AS ids, "
    "(16 * count(*) + 16 * count(*) FILTER (is_report))::BIGINT AS bytes FROM s WHERE st = 2 AND depth = 2",
    "symbolset_ranges": f"WITH {_S}, {_B}, {_R} SELECT str_id, min(b) AS lo, max(b) + 1 AS hi FROM g GROUP BY str_id, island",
    "symbolset_cardinality": f"WITH {_S}, {_B} SELECT str_id, count(*)::INT AS n FROM y GROUP BY str_id",
    "symbolset_parse": f"WITH {_CLASS} SELECT class, sum(n)::INT AS n, string_agg(printf('%02X', v), '' ORDER BY q) AS bits FROM (SELECT class, b // 8 AS q, "
    "sum(CASE WHEN has THEN 1 << (b % 8)::INT ELSE 0 END)::INT AS v, count(*) FILTER (has) AS n FROM k GROUP BY class, b // 8) GROUP BY class",
    "symbolset_kinds": f"WITH {_S}, {_B} SELECT str_id, count(*) = 256 AS wildcard, count(*) = 1 AS single FROM y GROUP BY str_id",
    "symbolset_remap": f"WITH {_S}, {_B} SELECT DISTINCT str_id, (CASE WHEN b BETWEEN 65 AND 90 THEN b + 32 ELSE b END)::INT AS byte FROM y",
    "symbolset_completeness": f"WITH {_S}, {_B}, {_R}, {_COMPLETE} SELECT state_id, n_symbols, n_ranges, complete, complement FROM k",
    "limited_out_degree": f"WITH {_S}, {_FOUND} SELECT DISTINCT stream_id, \"offset\", code AS report_code FROM f",
    "split_to_complete": f"WITH {_S}, x AS (SELECT sum(CASE WHEN right(pre, 1) = ' ' THEN 1 ELSE 2 END)::BIGINT AS states FROM s) SELECT 'names' AS nfa_id, states, states AS complete, 0::BIGINT AS complement, "
    "states AS either, true AS all_complete FROM x",
    "renumbered": f"WITH {_S} SELECT (row_number() OVER (ORDER BY is_report DESC, state_id) - 1)::INT AS state_id, str_id FROM s",
    "renumber_policies": f"WITH RECURSIVE {_S}, {_E}, {_C}, {_WALK}, {_B}, {_R}, {_COMPLETE}, {_D}, z AS (SELECT state_id, str_id, is_report, out_degree, complete, topo_order, bfs_layer, hot_degree "
    "FROM s JOIN d USING (state_id) JOIN k USING (state_id) JOIN j USING (state_id)) "
    + " UNION ALL ".join(f"SELECT '{n}' AS policy, (row_number() OVER (ORDER BY {o}state_id) - 1)::INT AS state_id, str_id FROM z" for n, o in _ORDER_BY.items()),
    "merged": f"WITH {_S}, {_E} SELECT 'both' AS nfa_id, src, dst FROM e",
    "induced_subgraph": f"WITH {_S}, {_E} SELECT 'names' AS nfa_id, src, dst FROM e WHERE src IN (SELECT state_id FROM s WHERE NOT is_report) AND dst IN (SELECT state_id FROM s WHERE NOT is_report)",
    "cut_by_depth": f"WITH RECURSIVE {_S}, {_E}, {_C}, {_WALK} SELECT state_id, str_id FROM n JOIN (SELECT cc_id, max(topo_order) + 1 AS deep FROM n GROUP BY cc_id) USING (cc_id) JOIN s USING (state_id) "
    "WHERE topo_order / deep::DOUBLE < 0.5",
    "edited": f"WITH {_S}, {_E}, o AS (SELECT * FROM s WHERE left(str_id, 1) <> '7'), a AS (SELECT src, dst FROM e WHERE src IN (SELECT state_id FROM o) AND dst IN (SELECT state_id FROM o)) "
    "SELECT src, dst, str_id FROM (SELECT * FROM a UNION SELECT state_id, state_id FROM o WHERE state_id % 7 = 0) f JOIN o ON src = state_id "
    "WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.src = f.src AND a.dst = f.dst AND a.dst % 5 = 0)",
    "split_parts": f"WITH {_S}, {_E}, {_C}, v AS (SELECT cc_id, count(*) AS edges FROM e JOIN c ON src = state_id GROUP BY cc_id) "
    "SELECT 'names#' || cc_id AS nfa_id, count(*) AS states, coalesce(any_value(edges), 0) AS edges FROM c LEFT JOIN v USING (cc_id) GROUP BY cc_id",
    "component_groups": f"WITH {_S}, {_C}, a AS (SELECT cc_id, count(*) AS n, count(*) FILTER (start_kind > 0 OR state_id % 3 = 0) AS hot, count(*) FILTER (is_report) AS reports FROM s JOIN c USING (state_id) GROUP BY cc_id) "
    "SELECT 'count' AS way, (ceil((cc_id + 1) / ((SELECT count(*) FROM a) / 4::DOUBLE)) - 1)::INT AS group_id, cc_id FROM a UNION ALL "
    + " UNION ALL ".join((_group_way("size", "n, cc_id", "n", 100), _group_way("hot", "cc_id", "hot", 40), _group_way("compatible", "cc_id", "reports", 24))),
    "component_order": f"WITH {_S}, {_C}, a AS (SELECT cc_id, count(*) AS n, count(*) FILTER (is_report) / 100::DOUBLE AS ratio FROM s JOIN c USING (state_id) GROUP BY cc_id) "
    "SELECT policy, cc_id, (row_number() OVER (PARTITION BY policy ORDER BY k DESC, cc_id) - 1)::INT AS place, (cc_id % 2)::INT AS turn, (cc_id // 2)::INT AS pair FROM "
    "(SELECT 0 AS policy, 0::DOUBLE AS k, cc_id FROM a UNION ALL SELECT 2, ratio, cc_id FROM a UNION ALL SELECT 3, ratio / n, cc_id FROM a)",
    "small_components": f"WITH {_S}, {_C}, {_Z} SELECT 'at most 12' AS kind, state_id FROM c JOIN z USING (cc_id) WHERE n <= 12 UNION ALL SELECT 'with state 4', state_id FROM c WHERE cc_id = (SELECT cc_id FROM c WHERE state_id = 4)",
    "gr_output": f"WITH {_S}, {_E} SELECT concat('p sp ', (SELECT count(*) FROM s), ' ', (SELECT count(*) FROM e)) AS value UNION ALL SELECT concat('a ', src + 1, ' ', dst + 1, ' 1') FROM e",
    "node_output": f"WITH RECURSIVE {_S}, {_E}, {_C}, {_WALK}, {_B}, {_R}, {_COMPLETE}, {_D}, {_MATCH} SELECT 'names' AS nfa_id, state_id, str_id, matchset, complete::INT AS complete, "
    "complement::INT AS complement, bfs_layer, (start_kind > 0)::INT AS start, (start_kind = 2)::INT AS alway_enabled, is_report::INT AS report, in_degree, out_degree "
    "FROM (SELECT state_id, str_id, start_kind, is_report FROM s) JOIN x USING (state_id) JOIN (SELECT state_id, complete, complement FROM k) USING (state_id) JOIN d USING (state_id) JOIN (SELECT state_id, bfs_layer FROM n) USING (state_id)",
    "edge_output": f"WITH {_S}, {_E}, {_B}, {_R}, {_COMPLETE}, {_MATCH} SELECT 'names' AS nfa_id, src, dst, a.str_id AS edge_from, b.str_id AS edge_to, complete::INT AS complete, "
    "complement::INT AS complement, matchset FROM e JOIN s a ON src = a.state_id JOIN s b ON dst = b.state_id JOIN x ON dst = x.state_id JOIN k ON dst = k.state_id",
    "written_edges": f"WITH {_S}, {_E} SELECT a.str_id AS edge_from, b.str_id AS edge_to FROM e JOIN s a ON src = a.state_id JOIN s b ON dst = b.state_id",
    "dot_output": f"WITH {_S}, {_E}, i AS (SELECT 0 AS a, 0 AS b, 0 AS c, 'digraph G {{' AS value UNION ALL SELECT 1, state_id, 0, concat(state_id, ' [label=\"', str_id, ' intid ', state_id, ' ', replace({_TEXT}, '\\', '\\\\'), ' ', "
    "CASE WHEN right(pre, 1) = ' ' THEN 256 ELSE 2 END, '\"]', CASE WHEN is_report THEN ' [shape=doubleoctagon]' ELSE '' END, CASE start_kind WHEN 2 THEN ' [color=orange]' WHEN 1 THEN ' [color=yellow]' ELSE '' END, ';') FROM s "
    "UNION ALL SELECT 2, src, dst, concat(src, ' -> ', dst, ';') FROM e UNION ALL SELECT 3, 0, 0, '}') SELECT (row_number() OVER (ORDER BY a, b, c) - 1)::INT AS place, value FROM i",
    "anml_states": f"WITH {_S3} SELECT nfa_id, state_id, str_id, CASE WHEN {_LAST} = ' ' THEN '*' WHEN {_IS_LETTER} THEN printf('[\\x%02x\\x%02x]', ascii(upper({_LAST})), ascii({_LAST})) "
    f"ELSE printf('[\\x%02x]', ascii({_LAST})) END AS symbol_set_str, CASE WHEN depth = 1 THEN st ELSE 0 END AS start_kind, is_report, report_code FROM s3",
    "anml_edges": f"WITH {_S3} SELECT nfa_id, src, dst FROM (SELECT a.nfa_id, a.state_id AS src, b.state_id AS dst FROM s3 a JOIN s3 b ON a.nfa_id = b.nfa_id AND b.depth = a.depth + 1 AND a.pre = left(b.pre, a.depth) "
    f"UNION SELECT nfa_id, state_id, state_id FROM s3 WHERE {_LAST} = ' ' UNION SELECT b.nfa_id, b.state_id, a.state_id FROM s3 b JOIN s3 a ON a.nfa_id = b.nfa_id AND a.depth = 1 AND a.pre = left(b.pre, 1) WHERE b.rep)",
    "match_files": " UNION ALL ".join(f"SELECT '{w}' AS report_code, sum((len(text) - len(replace(text, '{w}', ''))) // {len(w)})::BIGINT AS n FROM conversations HAVING sum(len(text) - len(replace(text, '{w}', ''))) > 0" for w in ("the", "tion", "an")),
    "match_by_options": "WITH c AS (SELECT max(strlen(c_name)) - 3 AS w FROM customer) SELECT stream_id, \"offset\", report_code FROM (" + _digits(_NAMES) + ") d, c WHERE \"offset\" // w = (\"offset\" - 1) // w",
    "hot_by_file": f"WITH {_S}, h AS (SELECT state_id, str_id, CASE WHEN state_id < 20 THEN 0.5::DOUBLE ELSE (state_id % 7) / 10::DOUBLE END AS hot_degree FROM s) "
    "SELECT str_id, hot_degree, (SELECT min(state_id) FROM h WHERE hot_degree <= 0.1::DOUBLE) AS boundary, (SELECT count(*) FROM h WHERE hot_degree > 0.1::DOUBLE) AS hot, (SELECT count(*) FROM h WHERE hot_degree <= 0.1::DOUBLE) AS cold FROM h",
    "merged_results": "SELECT event_type AS app, " + ", ".join(f"nullif(count(*) FILTER (user_id % 3 = {k}), 0)::DOUBLE AS k{k}" for k in range(3)) + " FROM events GROUP BY event_type",
    "bench_table": f"WITH {_RUNS}, t AS (SELECT app, config, count(*) FILTER (value >= 0) AS n, coalesce(avg(value) FILTER (value >= 0), max(value)) AS mean, coalesce(stddev_pop(value) FILTER (value >= 0), 0) AS std FROM v GROUP BY app, config) "
    "SELECT t.app, t.config, t.n, round(t.mean, 6) AS mean, round(t.std, 6) AS std, round(CASE WHEN t.mean > 0 THEN t.mean / x.mean END, 6) AS ratio FROM t LEFT JOIN t x ON t.app = x.app AND x.config = 'x' AND x.mean > 0",
    "bench_logs": "WITH l AS (SELECT user_id::VARCHAR AS path, event_id AS pos, event_type, regexp_extract(props, '[0-9]+')::DOUBLE AS k FROM events), f AS (SELECT path, arg_min(CASE WHEN event_type = 'click' THEN k ELSE -3.0::DOUBLE END, pos) "
    "FILTER (event_type IN ('click', 'signup')) AS value, bool_or(event_type = 'error') AS timed FROM l GROUP BY path) SELECT path, coalesce(value, CASE WHEN timed THEN -2.0::DOUBLE ELSE -1.0::DOUBLE END) AS value FROM f",
    "bench_grid": _GRID,
    "bench_wide": f"WITH v AS ({_GRID}), t AS (SELECT app, config, CASE WHEN min(value) < 0 THEN 'W' ELSE printf('%.1f', avg(value)) END AS x FROM v GROUP BY app, config) "
    "SELECT CASE app WHEN 'nothing' THEN 'None' WHEN 'click' THEN 'Clicks' ELSE 'Views' END AS app, any_value(x) FILTER (config = 'k=1') AS one, any_value(x) FILTER (config = 'k=2') AS two FROM t GROUP BY app",
    "bench_geomean": f"WITH {_RUNS} SELECT config, round(exp(avg(ln(value / 50))), 6) AS geomean FROM v WHERE value > 0 GROUP BY config",
}
