"""SQL that says what the engine's queries compute, written without the engine: plain string and set logic."""

from __future__ import annotations


def _stream(table: str, key: str, column: str) -> str:
    return f"SELECT CAST({key} AS VARCHAR) AS stream_id, hex(encode({column})) AS hx FROM {table} WHERE {column} IS NOT NULL"


def _byte(at: str) -> str:
    return f"substr(hx, 2 * ({at}) + 1, 2)"


def _positions(source: str, k: int = 1) -> str:
    return f"(SELECT stream_id, hx, len(hx) // 2 AS n, unnest(range(0, greatest(len(hx) // 2 - {k - 1}, 0))) AS p FROM ({source}) s)"


def _keywords(source: str, words: tuple[str, ...]) -> str:
    parts = []
    for k, w in enumerate(words):
        data = w.encode()
        parts.append(
            f"SELECT stream_id, p + {len(data) - 1} AS \"offset\", 'k{k}_{len(data) - 1}' AS original_id, '{k}' AS report_code, {k} AS word "
            f"FROM {_positions(source, len(data))} WHERE substr(hx, 2 * p + 1, {2 * len(data)}) = '{data.hex().upper()}'"
        )
    return " UNION ALL ".join(parts)


_SHORT = 'stream_id, "offset", original_id, report_code'


def _split(table: str, key: str, column: str, words: tuple[str, ...]) -> str:
    """Occurrences of words that do not overlap themselves: what lies between them, summed up in bytes."""
    parts = []
    for k, w in enumerate(words):
        n = len(w.encode())
        parts.append(
            f"SELECT CAST(k AS VARCHAR) AS stream_id, CAST(sum(strlen(piece)) OVER (PARTITION BY k ORDER BY j) + j * {n} - 1 AS BIGINT) AS \"offset\", "
            f"'k{k}_{n - 1}' AS original_id, '{k}' AS report_code, {k} AS word FROM (SELECT {key} AS k, unnest(string_split({column}, '{w}')) AS piece, "
            f"generate_subscripts(string_split({column}, '{w}'), 1) AS j, len(string_split({column}, '{w}')) AS n FROM {table}) WHERE j < n"
        )
    return " UNION ALL ".join(parts)


_DOCS = _split("documents", "doc_id", "text", ("the", "and", "tion", "ch", "é"))
_DIGIT = "BETWEEN '30' AND '39'"


def _digits(source: str, more: str = "true") -> str:
    return (
        f"SELECT stream_id, p + 1 AS \"offset\", 'd2' AS original_id, 'two' AS report_code FROM {_positions(source, 2)} "
        f"WHERE {_byte('p')} {_DIGIT} AND {_byte('p + 1')} {_DIGIT} AND {more}"
    )


_NAMES = _stream("customer", "c_custkey", "c_name")
_PROPS = _stream("events", "event_id", "props")
_TYPES = _stream("events", "event_id", "event_type")
_NATIONS = _stream("nation", "n_nationkey", "n_name")
_FIRST_C = "(instr(t, 'c') > 0 AND instr(t, 'c') - 1 < p)"
_CHARS = "(SELECT CAST(event_id AS VARCHAR) AS stream_id, event_type AS t, unnest(range(0, len(event_type))) AS p FROM events WHERE event_type IS NOT NULL)"
_GAP = f"SELECT stream_id, p AS \"offset\", 'b' AS original_id, 'gap' AS report_code FROM {_CHARS} WHERE substr(t, p + 1, 1) = 'k' AND {_FIRST_C}"
_VOWEL = "IN ('41', '45', '49', '4F', '55')"
_DOT = f"FROM {_positions(_NATIONS, 3)} WHERE {_byte('p')} {_VOWEL} AND {_byte('p + 2')} {_VOWEL} AND {_byte('p + 1')} <> '0A'"
_BRANDS = "SELECT CAST(p_partkey AS VARCHAR) AS stream_id, p_brand AS t FROM part WHERE starts_with(p_brand, 'Brand#1')"
_PART = "'k0_6' AS original_id, '0' AS report_code"


def _count_of(word: str, column: str) -> str:
    return f"(len({column}) - len(replace({column}, '{word}', ''))) // {len(word)}"


ORACLES = {
    "match_keyword_documents": f"SELECT {_SHORT} FROM ({_DOCS})",
    "match_multi_keyword_events": f"SELECT {_SHORT} FROM ({_keywords(_TYPES, ('click', 'view', 'purchase', 'i'))})",
    "match_class_digits_props": _digits(_PROPS),
    "match_start_of_data_part": f'SELECT stream_id, 6::BIGINT AS "offset", {_PART} FROM ({_BRANDS})',
    "match_gap_selfloop_events": _GAP,
    "match_arrow": _GAP,
    "match_cyclic_by_joins": _GAP,
    "match_ranges": _digits(_NAMES),
    "match_two_hops": f"SELECT {_SHORT} FROM ({_keywords(_TYPES, ('click',))})",
    "match_hot_cold": f"SELECT {_SHORT} FROM ({_keywords(_TYPES, ('click', 'view', 'purchase', 'i'))})",
    "match_hot_starts": f"SELECT {_SHORT} FROM ({_keywords(_TYPES, ('click', 'view', 'purchase', 'i'))})",
    "match_wildcard_dot": f"SELECT stream_id, p + 2 AS \"offset\", 'v2' AS original_id, 'vv' AS report_code {_DOT}",
    "nfa_match_sql": f"SELECT CAST(stream_id AS INTEGER) AS n_nationkey, p + 2 AS pos, 'v2' AS original_id {_DOT}",
    "match_count_only": "SELECT CAST(sum(" + " + ".join(_count_of(w, "text") for w in ("the", "and", "tion", "ch", "é")) + ") AS BIGINT) AS n FROM documents",
    "match_report_codes": f"SELECT report_code, count(*) AS n, count(DISTINCT stream_id) AS streams FROM ({_DOCS}) GROUP BY report_code",
    "match_segment_reset": _digits(_NAMES, "p // 4 = (p + 1) // 4"),
    "match_segment_exact": _digits(_NAMES),
    "match_tail_dropped": _digits(_PROPS, "p // 4 = (p + 1) // 4 AND p + 1 < n // 4 * 4"),
    "match_duplicated": f'SELECT stream_id, r * len(t) + 6 AS "offset", {_PART} FROM ({_BRANDS}), range(3) x(r)',
    "match_relational_dag": _digits(_NAMES),
    "match_memo_k1": _digits(_NAMES),
    "match_memo_k2": _digits(_NAMES),
    "match_memo_k3": _digits(_NAMES),
    "match_grouped": f"SELECT CASE WHEN word < 2 THEN 0 ELSE 1 END AS group_id, word AS cc_id, count(*) AS n FROM ({_DOCS}) GROUP BY word",
    "match_one_component": f"SELECT {_SHORT} FROM ({_DOCS}) WHERE word = 2",
    "match_slice": _digits("SELECT CAST(c_custkey AS VARCHAR) AS stream_id, hex(encode(substr(c_name, 10, 5))) AS hx FROM customer"),
    "match_padded": f"SELECT stream_id, p + 1 AS \"offset\", 'z' AS original_id, 'after' AS report_code FROM {_positions(_NAMES, 2)} WHERE {_byte('p')} {_DIGIT}",
    "match_conversation_turns": f"SELECT {_SHORT} FROM ("
    + _keywords("SELECT concat(conv_id, '-', turn) AS stream_id, hex(encode(role)) AS hx FROM conversations WHERE role IS NOT NULL", ("assistant", "user", "s"))
    + ")",
    "match_page_tags": " UNION ALL ".join(
        f"SELECT '{k}' AS report_code, CAST(sum({_count_of(w, 'html')}) AS BIGINT) AS n FROM pages HAVING sum({_count_of(w, 'html')}) > 0"
        for k, w in enumerate(("<p>", "<li>", "</a>", "&amp;"))
    ),
    "reports_by_quality": "SELECT quality, CAST(sum(" + " + ".join(_count_of(w, "text") for w in ("the", "and", "tion", "ch", "é"))
    + ") AS BIGINT) AS n FROM documents JOIN labels USING (doc_id) GROUP BY quality",
    "stream_alphabet": "SELECT stream_id, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS bytes FROM (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS stream_id, "
    "ascii(unnest(string_split(p_name, ''))) AS b FROM part) GROUP BY stream_id",
    "stream_slice": "SELECT CAST(c_custkey AS VARCHAR) AS stream_id, hex(encode(substr(c_name, 5, 100))) AS data FROM customer",
    "stream_chunk": "SELECT CAST(c_custkey AS VARCHAR) AS stream_id, k::INT AS seg_id, 7 * k AS base, hex(encode(substr(c_name, 7 * k + 1, 7))) AS data "
    "FROM customer, range(len(c_name) // 7) r(k)",
    "stream_chunk_replicated": "SELECT CAST(n_nationkey AS VARCHAR) AS stream_id, k::INT AS seg_id, 5 * k AS base, hex(encode(substr(repeat(n_name, 3), 5 * k + 1, 5))) AS data "
    "FROM nation, range((3 * len(n_name) + 4) // 5) r(k)",
    "stream_pad": "SELECT CAST(n_nationkey AS VARCHAR) AS stream_id, len(n_name)::INT AS length, rpad(hex(encode(n_name)), (2 * 16 * ((len(n_name) + 15) // 16))::INT, '0') AS data FROM nation",
    "stream_kgrams": "SELECT CAST(n_nationkey AS VARCHAR) AS stream_id, p::INT AS pos, ascii(substr(n_name, p + 1, 1)) * 65536 + ascii(substr(n_name, p + 2, 1)) * 256 "
    "+ ascii(substr(n_name, p + 3, 1)) AS gram FROM nation, range(len(n_name) - 2) r(p)",
    "stream_point_edit": "SELECT CAST(r_regionkey AS VARCHAR) AS stream_id, ascii(r_name) AS first, hex(encode(concat(r_name[1], '*', substr(r_name, 3), '!'))) AS data, "
    "(len(r_name) + 1)::INT AS n FROM region",
    "state_activation_profile": f"SELECT 'digits' AS nfa_id, 0 AS state_id, 'd1' AS original_id, count(*) AS activations FROM {_positions(_NAMES)} WHERE {_byte('p')} {_DIGIT} "
    f"UNION ALL SELECT 'digits', 1, 'd2', count(*) FROM ({_digits(_NAMES)})",
    "frontier_profile": f"SELECT 'gap' AS nfa_id, 0 AS group_id, size, count(*) AS positions FROM (SELECT (substr(t, p + 1, 1) = 'c')::INT + {_FIRST_C}::INT "
    f"+ (substr(t, p + 1, 1) = 'k' AND {_FIRST_C})::INT AS size FROM {_CHARS}) GROUP BY size",
    "report_exceptall_validate": f"SELECT stream_id, \"offset\", 'a' AS side FROM ({_digits(_NAMES, 'p // 4 <> (p + 1) // 4')})",
    "report_counts": f"SELECT count(*) AS n, count(*) AS n_distinct FROM ({_DOCS})",
    "report_packed": f'SELECT stream_id, (1::BIGINT << 32) + "offset" AS word FROM ({_digits(_NAMES)})',
    "report_top_order": f'SELECT stream_id, "offset", 1 AS state_id FROM ({_digits(_NAMES)}) ORDER BY stream_id, "offset" LIMIT 40',
}
