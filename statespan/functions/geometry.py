"""The 4 by 5 board: squares 0 (a1) to 19 (d5), and lines between them, from rules."""

from __future__ import annotations

from collections.abc import Callable

FILES, RANKS = 4, 5
SQUARES = FILES * RANKS
# Offsets (rank, file) from rules: a knight's have lengths 1 and 2, a king's at most 1.
_AROUND = [(r, f) for r in range(-2, 3) for f in range(-2, 3)]
KNIGHT = [s for s in _AROUND if {abs(s[0]), abs(s[1])} == {1, 2}]
ROOK = [s for s in _AROUND if abs(s[0]) + abs(s[1]) == 1]
BISHOP = [s for s in _AROUND if abs(s[0]) == abs(s[1]) == 1]
KING = sorted(ROOK + BISHOP)
PROMOTIONS = "QRBN"


def once(make: Callable) -> Callable:
    """A function without arguments that works its result out once. It travels to tasks by value,
    which ``functools.cache`` would not."""
    held: list = []

    def get():
        if not held:
            held.append(make())
        return held[0]

    get.__doc__ = make.__doc__
    return get


def square(rank: int, file: int) -> int | None:
    return rank * FILES + file if 0 <= rank < RANKS and 0 <= file < FILES else None


def _ray(start: int, step: tuple[int, int]) -> list[tuple[int, int]]:
    """(square, mask of the squares strictly between) along a direction."""
    out, mask = [], 0
    rank, file = divmod(start, FILES)
    while (to := square(rank := rank + step[0], file := file + step[1])) is not None:
        out.append((to, mask))
        mask |= 1 << to
    return out


def _reach(kind: str, start: int) -> list[tuple[int, int]]:
    if kind in "NK":
        rank, file = divmod(start, FILES)
        steps = KNIGHT if kind == "N" else KING
        return [(to, 0) for dr, df in steps if (to := square(rank + dr, file + df)) is not None]
    steps = {"B": BISHOP, "R": ROOK, "Q": BISHOP + ROOK}[kind]
    return [x for step in steps for x in _ray(start, step)]


@once
def move_lines() -> list[tuple]:
    """(piece, from_sq, to_sq, between, mode, promo, castle, ord): mode m needs an empty
    target, c an enemy on it, b either; castling has castle 1 or 2."""
    out = []
    for white in (True, False):
        name = str.upper if white else str.lower
        for start in range(SQUARES):
            rank, file = divmod(start, FILES)
            ahead = 1 if white else -1
            targets = [(square(rank + ahead, file), "m"), *((square(rank + ahead, file + df), "c") for df in (-1, 1))]
            order = 0
            for to, mode in targets:
                if to is None:
                    continue
                last = to // FILES in (0, RANKS - 1)
                for promo in PROMOTIONS if last else [""]:
                    out.append((name("P"), start, to, 0, mode, name(promo), 0, start * 64 + order))
                    order += 1
            for kind in "NKBRQ":
                out += [(name(kind), start, to, mask, "b", "", 0, start * 64 + k) for k, (to, mask) in enumerate(_reach(kind, start))]
    home = SQUARES - FILES
    out.append(("K", 0, 2, 0b0110, "m", "", 1, SQUARES * 64))
    out.append(("k", home, home + 2, 0b0110 << home, "m", "", 2, SQUARES * 64))
    return out


def ray_mask(start: int, step: tuple[int, int]) -> int:
    """Mask of the squares along a direction."""
    return sum(1 << to for to, _ in _ray(start, step))


def reach_mask(kind: str, start: int) -> int:
    """Mask of the squares that a piece reaches on an empty board."""
    return sum(1 << to for to, _ in _reach(kind, start))
