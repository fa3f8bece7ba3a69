"""Kernels over batches of positions: a batch is an array of piece codes (rows by 20
squares, the codes in the order of ``TYPES``), sides to move and castling rights.

Move generation, attack tests and ranks touch a board many times, so they run on whole
Arrow batches at once; sets of squares are masks of 20 bits in 32-bit numbers.
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from .classes import COUNTED, SIDES, canonical_sides, side_pieces
from .geometry import BISHOP, FILES, ROOK, SQUARES, move_lines, once, ray_mask, reach_mask

#: Fixed value: order of the piece types in a rank, which are also the codes here.
TYPES = ".KkPNBRQpnbrq"
CODE = {c: i for i, c in enumerate(TYPES)}
_LETTERS = np.frombuffer(TYPES.encode(), np.uint8)
_WHITE = np.array([c.isupper() for c in TYPES])
_BLACK = np.array([c.islower() for c in TYPES])
#: By side (1 is white): which codes are its own.
OWN = np.stack([_BLACK, _WHITE])


# -- Arrow in and out ---------------------------------------------------------------

def codes_of(board: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of boards, and which rows are boards: 20 characters, all of them known."""
    if isinstance(board, pa.ChunkedArray):
        board = board.combine_chunks()
    n = len(board)
    good = np.zeros(n, bool)
    out = np.zeros((n, SQUARES), np.uint8)
    if not n:
        return out, good
    wide = pa.types.is_large_string(board.type)
    offsets = np.frombuffer(board.buffers()[1], np.int64 if wide else np.int32)[board.offset: board.offset + n + 1]
    size = np.diff(offsets)
    good = (size == SQUARES) & board.is_valid().to_numpy(zero_copy_only=False)
    if good.any():
        raw = np.frombuffer(board.buffers()[2], np.uint8)
        found = raw[offsets[:-1][good][:, None] + np.arange(SQUARES)]
        kind = np.full(256, 255, np.uint8)
        kind[_LETTERS] = range(len(TYPES))
        found = kind[found]
        known = (found < len(TYPES)).all(axis=1)
        good[np.flatnonzero(good)[~known]] = False
        out[good] = found[known]
    return out, good


def boards_of(codes: np.ndarray, good: np.ndarray | None = None) -> pa.Array:
    n = len(codes)
    letters = np.ascontiguousarray(_LETTERS[codes])
    offsets = np.arange(n + 1, dtype=np.int32) * SQUARES
    out = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(letters.reshape(-1)))
    return out if good is None else pa.compute.if_else(pa.array(good), out, pa.scalar(None, pa.string()))


def masks(inside: np.ndarray) -> np.ndarray:
    """Rows of 20 booleans as masks."""
    packed = np.packbits(inside, axis=1, bitorder="little").astype(np.int32)
    return packed[:, 0] | packed[:, 1] << 8 | packed[:, 2] << 16


# -- attacks ------------------------------------------------------------------------

@once
def _attack_tables():
    leap = {k: np.array([reach_mask(k, sq) for sq in range(SQUARES)], np.int32) for k in "NK"}
    pawn = np.zeros((2, SQUARES), np.int32)  # by side that attacks
    for sq in range(SQUARES):
        rank, file = divmod(sq, FILES)
        for white, back in ((1, -1), (0, 1)):
            for df in (-1, 1):
                if 0 <= file + df < FILES and 0 <= rank + back < SQUARES // FILES:
                    pawn[white, sq] |= 1 << ((rank + back) * FILES + file + df)
    rays = {step: np.array([ray_mask(sq, step) for sq in range(SQUARES)], np.int32) for step in ROOK + BISHOP}
    return leap, pawn, rays


def _highest(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16):
        x = x | x >> s
    return x ^ (x >> 1)


@once
def _attackers() -> np.ndarray:
    """By square, side and code: the square's bit in the masks of what attacks, three of 20 bits in a number:
    knights, kings and pawns of the side; its bishops or queens, its rooks or queens, any piece."""
    upper = np.array([0, 6, 6, 1, 2, 3, 4, 5, 1, 2, 3, 4, 5])
    kind = np.where(OWN, upper, 0)
    bits = [[np.isin(kind, k) for k in ([2], [6], [1])], [np.isin(kind, [3, 5]), np.isin(kind, [4, 5]), np.broadcast_to(np.array(list(TYPES)) != ".", kind.shape)]]
    words = np.stack([sum(x.astype(np.int64) << SQUARES * i for i, x in enumerate(own)) for own in bits])
    return words.reshape(2, -1)[None] << np.arange(SQUARES)[:, None, None]


def attacked(codes: np.ndarray, sq: np.ndarray, by_white: np.ndarray) -> np.ndarray:
    """Whether a side attacks a square."""
    leap, pawn, rays = _attack_tables()
    side, mask = by_white.astype(np.int64), (1 << SQUARES) - 1
    near, far = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    for at, table in enumerate(_attackers()):
        of = codes[:, at] + len(TYPES) * side
        near |= table[0][of]
        far |= table[1][of]
    hit = (leap["N"][sq] & near) | (leap["K"][sq] & near >> SQUARES) | (pawn[side, sq] & near >> 2 * SQUARES)
    occ = (far >> 2 * SQUARES).astype(np.int32)
    along = {True: (far >> SQUARES & mask).astype(np.int32), False: (far & mask).astype(np.int32)}
    hit = (hit & mask).astype(np.int32)
    for step, table in rays.items():
        line = table[sq] & occ
        first = line & -line if step[0] * FILES + step[1] > 0 else _highest(line)
        hit |= first & along[step in ROOK]
    return hit != 0


def king_squares(codes: np.ndarray, white: np.ndarray) -> np.ndarray:
    """The square of a side's king, -1 without one."""
    at = codes == np.where(white, CODE["K"], CODE["k"])[:, None]
    return np.where(at.any(axis=1), at.argmax(axis=1), -1)


def checked(codes: np.ndarray, white: np.ndarray) -> np.ndarray:
    """Whether a side's king is attacked; false without a king."""
    at = king_squares(codes, white)
    return (at >= 0) & attacked(codes, np.maximum(at, 0), ~white)


# -- moves --------------------------------------------------------------------------

@once
def lines() -> dict[str, np.ndarray]:
    """The lines of ``geometry.move_lines`` as columns, sorted by piece and square, with the
    first line and the number of lines of each (piece, square)."""
    rows = sorted(move_lines(), key=lambda x: (CODE[x[0]], x[1], x[7]))
    piece, start, to, between, mode, promo, castle, order = zip(*rows)
    of = np.array([CODE[p] * SQUARES + s for p, s in zip(piece, start)])
    count = np.bincount(of, minlength=len(TYPES) * SQUARES)
    name = lambda s: "abcd"[s % FILES] + str(s // FILES + 1)
    return {
        "piece": np.array([CODE[p] for p in piece], np.uint8), "from": np.array(start), "to": np.array(to), "between": np.array(between, np.int32),
        "quiet": np.array([m == "m" for m in mode]), "takes": np.array([m == "c" for m in mode]), "castle": np.array(castle),
        "promo": np.array([CODE[p] if p else 0 for p in promo], np.uint8), "order": np.array(order, np.int32), "count": count, "first": np.cumsum(count) - count,
        "uci": np.array([name(s) + name(t) + p.lower() for s, t, p in zip(start, to, promo)]),
    }


def moves(codes: np.ndarray, white: np.ndarray, castling: np.ndarray, legal: bool = True) -> dict[str, np.ndarray]:
    """Moves of each position: row, line, captured (code) and the position after it: codes,
    castling. ``legal`` leaves out those after which the mover's king is attacked or missing."""
    table = lines()
    row, sq = np.nonzero(OWN[white.astype(np.int64)[:, None], codes])
    slot = codes[row, sq].astype(np.int64) * SQUARES + sq
    count = table["count"][slot]
    line = np.repeat(table["first"][slot] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    row = np.repeat(row, count)
    occ = masks(codes > 0)
    taken = codes[row, table["to"][line]]
    free = (table["between"][line] & occ[row]) == 0
    free &= ~OWN[white[row].astype(np.int64), taken] & ~(table["quiet"][line] & (taken > 0)) & ~(table["takes"][line] & (taken == 0))
    row, line, taken = row[free], line[free], taken[free]
    castle = table["castle"][line]
    if castle.any():
        ok = np.ones(len(row), bool)
        for which, (home, rook) in enumerate(((0, "R"), (SQUARES - FILES, "r")), 1):
            at = np.flatnonzero(castle == which)
            r = row[at]
            fine = ((castling[r] & which) != 0) & (codes[r, home + FILES - 1] == CODE[rook])
            for step in range(3):
                fine &= ~attacked(codes[r], np.full(len(r), home + step), ~white[r])
            ok[at] = fine
        row, line, taken = row[ok], line[ok], taken[ok]
    n = np.arange(len(row))
    start, to, promo, castle = table["from"][line], table["to"][line], table["promo"][line], table["castle"][line]
    piece = table["piece"][line]
    after = codes[row]
    after[n, start] = 0
    after[n, to] = np.where(promo > 0, promo, piece)
    for which, (home, rook) in enumerate(((0, "R"), (SQUARES - FILES, "r")), 1):
        at = np.flatnonzero(castle == which)
        after[at, home + FILES - 1] = 0
        after[at, home + 1] = CODE[rook]
    lost = np.zeros(len(row), castling.dtype)
    for which, (king, home) in enumerate((("K", 0), ("k", SQUARES - FILES)), 1):
        corner = home + FILES - 1
        lost |= np.where((piece == CODE[king]) | (start == home) | (start == corner) | (to == corner), which, 0).astype(castling.dtype)
    out = {"row": row, "line": line, "captured": taken, "codes": after, "castling": castling[row] & ~lost}
    if legal:
        at = king_squares(after, white[row])
        keep = np.flatnonzero((at >= 0) & ~attacked(after, np.maximum(at, 0), ~white[row]))
        out = {k: v[keep] for k, v in out.items()}
    return out


# -- classes and keys -----------------------------------------------------------------

@once
def class_arrays() -> dict[str, np.ndarray]:
    """By class: pieces (white P, N, B, R, Q, then black), placements, base, canonical."""
    sides = [side_pieces(i) for i in range(SIDES)]
    fine = canonical_sides()
    pieces = np.array([[*sides[i // SIDES], *sides[i % SIDES]] for i in range(SIDES * SIDES)], np.int64)
    ways = []
    for row in pieces.tolist():
        w = factorial(SQUARES) // factorial(SQUARES - 2 - sum(row))
        for c in row:
            w //= factorial(c)
        ways.append(w)
    placements = np.array(ways, np.int64)
    canonical = np.array([i // SIDES in fine and i % SIDES in fine for i in range(SIDES * SIDES)])
    # the side of a count of P, N, B, R, Q, by its digits to base 4
    of = np.full(4 ** len(COUNTED), -1, np.int64)
    for i in fine:
        of[int(np.dot(sides[i], 4 ** np.arange(len(COUNTED))))] = i
    return {"pieces": pieces, "placements": placements, "base": np.cumsum(placements) - placements, "canonical": canonical, "side_of": of}


@once
def _packed() -> dict[str, np.ndarray]:
    """Counts of types packed into numbers. ``before``: a class's pieces before each type but the first, 5
    bits each; ``left``: its pieces of each type, 5 bits for empty squares and 2 for others (no class
    has over 3 of one). By type: where it stands in both, and what one piece of it takes off."""
    n = len(TYPES)
    pieces = _pieces(np.arange(SIDES * SIDES))
    # nothing stands before the first type: its place is above all others and stays 0
    before_at = np.array([5 * (n - 1), *range(0, 5 * (n - 1), 5)])
    left_at = np.array([0, *range(5, 5 + 2 * (n - 1), 2)])
    before = np.concatenate([np.zeros((len(pieces), 1), np.int64), np.cumsum(pieces, axis=1)[:, :-1]], axis=1)
    return {
        "before": (before << before_at).sum(axis=1), "left": (pieces << left_at).sum(axis=1), "before_at": before_at, "left_at": left_at, "left_mask": np.array([31] + [3] * (n - 1)),
        "before_less": np.array([sum(1 << int(x) for x in before_at[t + 1:]) for t in range(n)]), "left_less": np.int64(1) << left_at, "one": np.array([0, *(1 << 5 * np.arange(n - 1))]),
    }


def class_ids(codes: np.ndarray) -> np.ndarray:
    """The class of each board, -1 where it has none."""
    one, counted = _packed()["one"], len(COUNTED)
    n = np.zeros(len(codes), np.int64)  # K, k and the counted types of both sides, 5 bits each
    for sq in range(SQUARES):
        n += one[codes[:, sq]]
    good = ((n & 1023) == 33) & ((n & sum(28 << 5 * t for t in range(2, 2 + 2 * counted))) == 0)
    side = []
    for first in (2, 2 + counted):
        digits = sum(((n >> 5 * (first + i)) & 3) << 2 * i for i in range(counted))
        side.append(class_arrays()["side_of"][digits])
        good &= side[-1] >= 0
    return np.where(good, side[0] * SIDES + side[1], -1)


def ranks(codes: np.ndarray, class_id: np.ndarray) -> np.ndarray:
    """Rank of each board among the placements of its pieces."""
    p = _packed()
    before, left, ways, rank = p["before"][class_id], p["left"][class_id], class_arrays()["placements"][class_id], np.zeros(len(codes), np.int64)
    for sq in range(SQUARES):
        t = codes[:, sq]
        rank += ways * ((before >> p["before_at"][t]) & 31) // (SQUARES - sq)
        ways = ways * ((left >> p["left_at"][t]) & p["left_mask"][t]) // (SQUARES - sq)
        before -= p["before_less"][t]
        left -= p["left_less"][t]
    return rank


def placements(rank: np.ndarray, class_id: np.ndarray) -> np.ndarray:
    """The board (codes) of each rank within its class."""
    n = len(rank)
    left, ways, rank = _pieces(class_id), class_arrays()["placements"][class_id], rank.copy()
    rows, out = np.arange(n), np.zeros((n, SQUARES), np.uint8)
    for sq in range(SQUARES):
        block = ways[:, None] * left // (SQUARES - sq)
        ends = np.cumsum(block, axis=1)
        t = np.minimum((ends <= rank[:, None]).sum(axis=1), len(TYPES) - 1)
        rank -= ends[rows, t] - block[rows, t]
        ways = block[rows, t]
        left[rows, t] -= 1
        out[:, sq] = t
    return out


def _pieces(class_id: np.ndarray) -> np.ndarray:
    """Number of each type (empty squares first) in a class."""
    p = class_arrays()["pieces"][class_id]
    return np.concatenate([SQUARES - 2 - p.sum(axis=1, keepdims=True), np.ones((len(p), 2), np.int64), p], axis=1)


def keys_of(codes: np.ndarray, white: np.ndarray, castling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and class of each position, -1 where no class fits."""
    class_id = class_ids(codes)
    at = np.flatnonzero(class_id >= 0)
    key = np.full(len(codes), -1, np.int64)
    key[at] = (class_arrays()["base"][class_id[at]] + ranks(codes[at], class_id[at])) * 8 + castling[at] * 2 + ~white[at]
    return key, class_id


def classes_of_keys(key: np.ndarray) -> np.ndarray:
    """The class whose range holds each key, by binary search; -1 outside of all."""
    a, q = class_arrays(), key >> 3
    end = a["base"][-1] + a["placements"][-1]
    return np.where((q >= 0) & (q < end), np.searchsorted(a["base"], q, "right") - 1, -1)


def positions_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which keys are positions, and their codes, side (white) and castling."""
    class_id = classes_of_keys(key)
    good = (class_id >= 0) & class_arrays()["canonical"][class_id]
    at = np.flatnonzero(good)
    codes = np.zeros((len(key), SQUARES), np.uint8)
    codes[at] = placements((key[at] >> 3) - class_arrays()["base"][class_id[at]], class_id[at])
    return good, codes, (key & 1) == 0, ((key & 7) >> 1).astype(np.int32)


def mirror(codes: np.ndarray, white: np.ndarray, castling: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Colours swapped, ranks flipped, side and rights swapped."""
    other = np.array([TYPES.index(t.swapcase()) for t in TYPES], np.uint8)
    flipped = codes.reshape(-1, SQUARES // FILES, FILES)[:, ::-1].reshape(-1, SQUARES)
    return other[flipped], ~white, (castling & 1) * 2 + (castling >> 1)


def least_keys(codes: np.ndarray, white: np.ndarray, castling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smaller of a position's key and its mirror image's, and how many of the two differ (1 or
    2); -1 where no class fits."""
    own, _ = keys_of(codes, white, castling)
    image, _ = keys_of(*mirror(codes, white, castling))
    return np.minimum(own, image), 1 + (own != image)
