"""The rules once more, in DuckDB SQL over square numbers and text: what the kernels' results
are held against. Each function gives common table expressions, to be joined by commas."""

from __future__ import annotations

TYPES = ".KkPNBRQpnbrq"

STEPS = """
around AS (SELECT r.i AS dr, f.i AS df FROM range(-2, 3) r(i), range(-2, 3) f(i)),
steps AS (
    SELECT 'N' AS kind, dr, df, 1 AS far FROM around WHERE abs(dr * df) = 2
    UNION ALL SELECT 'K', dr, df, 1 FROM around WHERE greatest(abs(dr), abs(df)) = 1
    UNION ALL SELECT k, dr, df, 4 FROM around, (VALUES ('R'), ('Q')) v(k) WHERE abs(dr) + abs(df) = 1
    UNION ALL SELECT k, dr, df, 4 FROM around, (VALUES ('B'), ('Q')) v(k) WHERE abs(dr) = 1 AND abs(df) = 1),
reach AS (
    SELECT kind, s.i AS f, s.i + d.i * (dr * 4 + df) AS t, list_transform(range(1, d.i), lambda k: s.i + k * (dr * 4 + df)) AS way
    FROM steps, range(20) s(i), range(1, 5) d(i)
    WHERE d.i <= far AND s.i // 4 + d.i * dr BETWEEN 0 AND 4 AND s.i % 4 + d.i * df BETWEEN 0 AND 3),
pawns AS (
    SELECT w AS white, s.i AS f, s.i + CASE WHEN w THEN 4 ELSE -4 END + x AS t, x <> 0 AS takes
    FROM range(20) s(i), (VALUES (true), (false)) c(w), (VALUES (-1), (0), (1)) d(x)
    WHERE s.i % 4 + x BETWEEN 0 AND 3 AND s.i + CASE WHEN w THEN 4 ELSE -4 END BETWEEN 0 AND 19),
strikes AS (
    SELECT t AS sq, w AS by_white, f, CASE WHEN w THEN kind ELSE lower(kind) END AS piece, way FROM reach, (VALUES (true), (false)) c(w)
    UNION ALL SELECT t, white, f, CASE WHEN white THEN 'P' ELSE 'p' END, []::BIGINT[] FROM pawns WHERE takes)
"""


def unrank(name: str, keys: str, bounds: str = "bounds", counts: str = "counts") -> str:
    """``name`` (key, board) of the distinct keys (key, class_id) of a table, square by square."""
    return f"""
{name}_walk AS (
    SELECT key, 0 AS sq, key // 8 - base AS r, placements AS ways, [18 - w.size - b.size, 1, 1, w.p, w.n, w.b, w.r, w.q, b.p, b.n, b.b, b.r, b.q]::BIGINT[] AS left_, '' AS board
    FROM (SELECT DISTINCT key, class_id FROM {keys}) JOIN {bounds} USING (class_id) JOIN (SELECT *, p + n + b + r + q AS size FROM {counts}) w ON w.i = wi JOIN (SELECT *, p + n + b + r + q AS size FROM {counts}) b ON b.i = bi
    UNION ALL
    SELECT key, sq + 1, r - CASE WHEN t = 1 THEN 0 ELSE ends[t - 1] END, blocks[t], list_transform(range(1, 14), lambda i: left_[i] - CASE WHEN i = t THEN 1 ELSE 0 END), board || substr('{TYPES}', t, 1)
    FROM (SELECT *, CAST(len(list_filter(ends, lambda e: e <= r)) + 1 AS BIGINT) AS t
          FROM (SELECT *, list_transform(range(1, 14), lambda i: CAST(list_sum(blocks[1:i]) AS BIGINT)) AS ends
                FROM (SELECT *, list_transform(left_, lambda n: ways * n // (20 - sq)) AS blocks FROM {name}_walk WHERE sq < 20)))),
{name} AS (SELECT key, board FROM {name}_walk WHERE sq = 20)"""


def rank(name: str, rows: str, bounds: str = "bounds", counts: str = "counts") -> str:
    """``name`` (id, rank) of the rows (id, board, class_id) of a table."""
    return f"""
{name}_walk AS (
    SELECT id, board, 0 AS sq, CAST(0 AS BIGINT) AS rank_, placements AS ways, [18 - w.size - b.size, 1, 1, w.p, w.n, w.b, w.r, w.q, b.p, b.n, b.b, b.r, b.q]::BIGINT[] AS left_
    FROM {rows} JOIN {bounds} USING (class_id) JOIN (SELECT *, p + n + b + r + q AS size FROM {counts}) w ON w.i = wi JOIN (SELECT *, p + n + b + r + q AS size FROM {counts}) b ON b.i = bi
    UNION ALL
    SELECT id, board, sq + 1, rank_ + ways * CASE WHEN t = 1 THEN 0 ELSE CAST(list_sum(left_[1:t - 1]) AS BIGINT) END // (20 - sq), ways * left_[t] // (20 - sq),
           list_transform(range(1, 14), lambda i: left_[i] - CASE WHEN i = t THEN 1 ELSE 0 END)
    FROM (SELECT *, CAST(instr('{TYPES}', substr(board, sq + 1, 1)) AS BIGINT) AS t FROM {name}_walk WHERE sq < 20)),
{name} AS (SELECT id, rank_ FROM {name}_walk WHERE sq = 20)"""


def _clear(way: str, board: str) -> str:
    return f"len(list_filter({way}, lambda s: substr({board}, CAST(s + 1 AS BIGINT), 1) <> '.')) = 0"


def checks(name: str, rows: str) -> str:
    """``name`` (id): the rows (id, board, sq, by_white) whose square a side strikes."""
    return f"""
{name} AS (SELECT DISTINCT x.id FROM {rows} x JOIN strikes s ON s.sq = x.sq AND s.by_white = x.by_white
    WHERE substr(x.board, CAST(s.f + 1 AS BIGINT), 1) = s.piece AND {_clear("s.way", "x.board")})"""


def moves(name: str, rows: str) -> str:
    """``name`` (id, uci, piece, captured, promo, board, wtm, castling): the legal moves of the
    rows (id, board, wtm, castling)."""
    kings = "CASE WHEN wtm THEN 'K' ELSE 'k' END"
    return f"""
{name}_own AS (
    SELECT id, board, wtm, castling, s.i AS f, substr(board, CAST(s.i + 1 AS BIGINT), 1) AS piece
    FROM {rows}, range(20) s(i) WHERE CASE WHEN wtm THEN contains('KPNBRQ', substr(board, CAST(s.i + 1 AS BIGINT), 1)) ELSE contains('kpnbrq', substr(board, CAST(s.i + 1 AS BIGINT), 1)) END),
{name}_home AS (
    SELECT id || '/' || (base + k.i) AS id, id AS of_, board, base + k.i AS sq, NOT wtm AS by_white, base, wtm
    FROM (SELECT *, CASE WHEN wtm THEN 0 ELSE 16 END AS base FROM {rows}), range(3) k(i)
    WHERE substr(board, CAST(base + 1 AS BIGINT), 4) = CASE WHEN wtm THEN 'K..R' ELSE 'k..r' END AND castling & CASE WHEN wtm THEN 1 ELSE 2 END <> 0),
{checks(f"{name}_struck", f"{name}_home")},
{name}_castle AS (SELECT of_, base FROM {name}_home h LEFT JOIN {name}_struck s USING (id) GROUP BY of_, base HAVING count(s.id) = 0),
{name}_to AS (
    SELECT o.*, r.t, substr(board, CAST(r.t + 1 AS BIGINT), 1) AS captured, '' AS promo
    FROM {name}_own o JOIN reach r ON r.f = o.f AND r.kind = upper(o.piece) WHERE {_clear("r.way", "board")}
    UNION ALL
    SELECT o.*, p.t, substr(board, CAST(p.t + 1 AS BIGINT), 1) AS captured, CASE WHEN wtm THEN q ELSE lower(q) END AS promo
    FROM {name}_own o JOIN pawns p ON p.f = o.f AND p.white = o.wtm AND upper(o.piece) = 'P', (VALUES ('Q'), ('R'), ('B'), ('N'), ('')) v(q)
    WHERE (p.t // 4 IN (0, 4)) = (q <> '') AND p.takes = (substr(board, CAST(p.t + 1 AS BIGINT), 1) <> '.')),
{name}_made AS (
    SELECT id, piece, captured, promo, wtm, f, t, board AS was,
           CASE WHEN f < t THEN substr(board, 1, f) || '.' || substr(board, f + 2, t - f - 1) || put || substr(board, t + 2) ELSE substr(board, 1, t) || put || substr(board, t + 2, f - t - 1) || '.' || substr(board, f + 2) END AS board,
           castling & ~(CASE WHEN piece = 'K' OR f IN (0, 3) OR t = 3 THEN 1 ELSE 0 END | CASE WHEN piece = 'k' OR f IN (16, 19) OR t = 19 THEN 2 ELSE 0 END) AS castling
    FROM (SELECT *, CASE WHEN promo = '' THEN piece ELSE promo END AS put FROM {name}_to WHERE captured = '.' OR (captured = upper(captured)) <> wtm)
    UNION ALL
    SELECT id, CASE WHEN wtm THEN 'K' ELSE 'k' END, '.', '', wtm, base, base + 2, board, substr(board, 1, base) || CASE WHEN wtm THEN '.RK.' ELSE '.rk.' END || substr(board, base + 5), castling & CASE WHEN wtm THEN 2 ELSE 1 END
    FROM {rows} JOIN {name}_castle ON of_ = id),
{name}_after AS (SELECT row_number() OVER () AS n, * FROM {name}_made WHERE instr(board, {kings}) > 0),
{name}_king AS (SELECT n AS id, board, instr(board, {kings}) - 1 AS sq, NOT wtm AS by_white FROM {name}_after),
{checks(f"{name}_bad", f"{name}_king")},
{name} AS (
    SELECT a.id, substr('abcd', CAST(f % 4 + 1 AS BIGINT), 1) || (f // 4 + 1) || substr('abcd', CAST(t % 4 + 1 AS BIGINT), 1) || (t // 4 + 1) || lower(promo) AS uci, piece, captured, promo, board, NOT wtm AS wtm, CAST(castling AS INT) AS castling
    FROM {name}_after a ANTI JOIN {name}_bad b ON b.id = a.n)"""


def mirror(board: str) -> str:
    """A board with its ranks flipped and its colours swapped."""
    flipped = " || ".join(f"substr({board}, {17 - 4 * k}, 4)" for k in range(5))
    return f"translate({flipped}, 'PNBRQKpnbrqk', 'pnbrqkPNBRQK')"


def fixed_point(edges: str, settled: str) -> str:
    """``settled_values`` (node, value, round) of an AND/OR graph: edges (parent, child), settled
    (node, value)."""
    return f"""
degrees AS (SELECT parent, count(*) AS degree FROM {edges} GROUP BY parent),
settled_values(node, value, round) USING KEY (node) AS (
    SELECT node, value, 0 FROM {settled}
    UNION
    SELECT g.parent, CASE WHEN win THEN 'WIN' ELSE 'LOSS' END, r + 1
    FROM (SELECT e.parent, bool_or(v.value = 'LOSS') AS win, count(*) FILTER (v.value = 'WIN') AS wins FROM {edges} e JOIN recurring.settled_values v ON v.node = e.child
          WHERE NOT EXISTS (SELECT 1 FROM recurring.settled_values y WHERE y.node = e.parent) GROUP BY e.parent) g
    JOIN degrees d ON d.parent = g.parent, (SELECT max(round) AS r FROM recurring.settled_values) m
    WHERE win OR wins = degree)"""
