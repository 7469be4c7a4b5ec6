"""SQL for the queries of queries_surface, written without the engine."""

from __future__ import annotations

from automill.oracles import ORACLES as _ENGINE
from automill.oracles import _NAMES, _NATIONS, _PROPS, _TYPES, _VOWEL, _byte, _digits, _positions


def _values(columns: str, *rows: tuple) -> str:
    say = lambda v: "NULL" if v is None else repr(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)}) v({columns})"


_PAIR = (
    f"SELECT stream_id, p, CASE WHEN {_byte('p + 1')} IN ('69', '63', '65', '75', '70') THEN 'x' || decode(unhex({_byte('p + 1')})) ELSE 'y' END AS original_id "
    f"FROM {_positions(_TYPES, 2)} WHERE {_byte('p')} BETWEEN '61' AND '7A' AND {_byte('p + 1')} IN ('69', '63', '65', '75', '70', '6E', '6F', '72', '73', '74')"
)


def _transformed(names: tuple[str, ...], where: str) -> str:
    ways = _values("transform", *[(n,) for n in names])
    return f'SELECT transform, stream_id, p + 1 AS "offset", original_id FROM ({_PAIR}) f, ({ways}) t WHERE {where}'


ORACLES: dict[str, str] = {
    "transforms_keep_reports": _transformed(("clone starts", "limit out-degree", "reorder", "split and merge", "split sets"), "true"),
    "transforms_move_reports": _transformed(("move starts", "one start"), "p >= 1"),
    "transforms_cut_loops": f"SELECT 'no loops' AS transform, stream_id, p AS \"offset\", 'b' AS original_id FROM {_positions(_TYPES)} "
    f"WHERE {_byte('p')} = '6B' AND (p >= 1 AND {_byte('p - 1')} = '63' OR p >= 2 AND {_byte('p - 2')} = '63')",
    "written_reports": _digits(_NAMES),
    "written_frontier": _ENGINE["frontier_profile"],
    "sorted_reports": f"SELECT 0 AS wrong, count(*) AS n FROM ({_digits(_NAMES)})",
    "report_first_differences": f"SELECT stream_id, \"offset\", original_id, 'a' AS side, 1::BIGINT AS n FROM ({_digits(_NAMES, 'p // 4 <> (p + 1) // 4')}) ORDER BY stream_id, \"offset\" LIMIT 40",
    "report_equal_sets": f"SELECT count(*) AS n, true AS equal FROM ({_digits(_PROPS)})",
    "match_carried": f"SELECT stream_id, p + 2 AS \"offset\", 'x' AS original_id FROM {_positions(_NATIONS, 3)} "
    f"WHERE {_byte('p')} {_VOWEL} AND NOT {_byte('p + 1')} {_VOWEL} AND {_byte('p + 2')} {_VOWEL}",
}
