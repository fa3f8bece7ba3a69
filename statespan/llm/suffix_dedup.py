"""Suffix-array deduplication with a distributed difference-cover sort.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts
earlier (in a document of smaller id, or earlier in the same document).

1. Dealing. Each window of LENGTH bytes is given to the smallest hash among its
   GRAM-byte substrings (its anchor, leftmost on ties). The anchor depends only
   on the window's bytes, so equal windows have equal anchors and meet in one
   block. An anchor stands for one run of windows and their joint bytes, its
   context. Contexts whose anchor no other context has are unique and are done with;
   of those equal byte for byte within a task only the earliest goes on, and the others
   are repeats throughout. An anchor of more than HEAVY contexts is dealt again window
   by window, by a hash of the whole window, so a passage that very many documents
   share is spread over all blocks.
2. Sorting. What is left, some per cent of the text, is dealt by anchor with its bytes.
   Of contexts of different tasks that a hash takes for equal only the earliest goes
   with its bytes and the others with a keyed 128-bit digest of theirs, which has to be
   the same; should one not be, all contexts of its anchor go with their bytes. Each
   block gets the suffix array of the different contexts by difference cover: sort the triples at
   positions 1 and 2 modulo 3, recurse on their names, sort the remaining
   suffixes by a symbol and the rank behind it, and merge. Names that already
   reach LENGTH symbols deep are not told apart any further. Adjacent suffixes are
   compared over LENGTH bytes; in a run of equal ones all but the earliest repeat.
3. Removal. Repeated windows are gathered by document and cut out.

Plain hashes only decide what meets what: nothing is removed unless its bytes, or keyed
128-bit digests of them, were compared.

Defined cases: a null text is empty; a text under LENGTH bytes keeps all; a long text
goes piece by piece; ids are compared as numbers, a null id comes after all others;
equal rows are one document, and rows that share an id but not the text are different
documents, in order of a hash of the text; an empty table gives no rows; extra columns
of any name are ignored, and kept by ``remove_repeats``.

A block holds all contexts of its anchors, 32 bytes each, and the bytes (at most 168)
of those whose anchor is shared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, SpanHash, document_key, merged, n_blocks_of, others, restored, saved, small_batches, sub_batches, table, text_slices

LENGTH = 100
GRAM = 32
#: An anchor of more contexts, some 350 MB while a block sorts them, is dealt window by window.
HEAVY = 40_000
#: Input bytes that a block is due.
BLOCK_BYTES = 4 << 20
_PIECE = 1 << 20
_FLUSH = 1 << 19
#: Key of the digests.
_KEY = b"statespan contexts"
_CONTEXT = np.dtype([("g", "<u8"), ("c", "<u8"), ("d", "<i8"), ("h", "<i8"), ("lo", "<i4"), ("hi", "<i4")])
_RUN = "kind string, g bigint, d bigint, h bigint, lo int, hi int"
_FOUND = "wrong boolean, g bigint, d bigint, h bigint, lo int, hi int"
_SPANS = "array<struct<start:bigint,end:bigint>>"
_PACKED = "block int, packed binary"


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1: n])


def _contexts(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of every window with their runs of windows (lo to hi, in the document) and a
    hash of each context, and where it starts in the data."""
    nothing = np.zeros(0, _CONTEXT), np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return nothing
    span = SpanHash(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = span(at, at + GRAM)
    low = np.uint64((1 << 21) - 1)
    anchor = (_sliding_min((grams & ~low) | at.astype(np.uint64), LENGTH - GRAM + 1) & low).astype(np.int64)
    start = np.arange(len(anchor))
    row = np.repeat(np.arange(len(ids)), np.diff(offsets))[: len(anchor)]
    fits = start + LENGTH <= offsets[row + 1]
    start, anchor, row = start[fits], anchor[fits], row[fits]
    if not len(start):
        return nothing
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    cuts = np.flatnonzero(new)
    lo, hi, row = start[cuts], start[np.append(cuts[1:], len(start)) - 1], row[cuts]
    out = np.empty(len(cuts), _CONTEXT)
    out["g"], out["c"], out["d"], out["h"] = grams[anchor[cuts]], span(lo, hi + LENGTH), ids[row], marks[row]
    out["lo"], out["hi"] = lo - offsets[row], hi - offsets[row]
    return out, lo


def _numbers(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False)


def _pieces(batch: pa.RecordBatch):
    """(contexts, starts, data) slice by slice; a longer text goes piece by piece."""
    ids, marks = _numbers(batch, "d"), _numbers(batch, "h")
    for first, end, data, offsets in text_slices(batch.column("text"), _PIECE):
        if len(data) <= _PIECE:
            yield *_contexts(data, offsets, ids[first:end], marks[first:end]), data
            continue
        for base in range(0, len(data), _PIECE):
            part = data[base: base + _PIECE + LENGTH - 1]
            found, start = _contexts(part, np.array([0, len(part)]), ids[first:end], marks[first:end])
            found["lo"] += base
            found["hi"] += base
            yield found, start, part


def _windows(batch: pa.RecordBatch):
    """The same for the windows of given runs, each a context of its own and its own anchor."""
    ids, marks, todo = _numbers(batch, "d"), _numbers(batch, "h"), batch.column("todo").to_pylist()
    for first, end, data, offsets in text_slices(batch.column("text"), _PIECE):
        at = [np.arange(t["lo"], t["hi"] + 1) for r in range(first, end) for t in todo[r]]
        row = np.repeat([r for r in range(first, end) for _ in todo[r]], [len(x) for x in at]).astype(np.int64)
        lo = np.concatenate(at) if at else np.zeros(0, np.int64)
        start = lo + offsets[row - first]
        out = np.empty(len(lo), _CONTEXT)
        out["g"], out["d"], out["h"], out["lo"], out["hi"] = SpanHash(data)(start, start + LENGTH), ids[row], marks[row], lo, lo
        out["c"] = out["g"]
        yield out, start, data


def _collapsed(rows: np.ndarray, at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of the contexts of equal bytes, and the others but for equal rows of one
    document. Contexts of equal hash and unequal bytes are different."""
    size = rows["hi"].astype(np.int64) - rows["lo"] + LENGTH
    order = np.lexsort((rows["lo"], rows["h"], rows["d"], size, rows["c"], rows["g"]))
    rows, at, size = rows[order], at[order], size[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows["g"][1:] != rows["g"][:-1]) | (rows["c"][1:] != rows["c"][:-1]) | (size[1:] != size[:-1])
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = np.flatnonzero(~first)
    equal = np.zeros(len(rows), bool)
    for a in range(0, len(later), 1 << 13):
        x = later[a: a + (1 << 13)]
        reach = np.arange(int(size[x].max()))
        within = reach < size[x][:, None]
        there = lambda i: data[np.minimum(at[i][:, None] + reach, len(data) - 1)]
        equal[x] = ((there(x) == there(lead[x])) | ~within).all(axis=1)
    same = (rows["d"] == rows["d"][lead]) & (rows["h"] == rows["h"][lead]) & (rows["lo"] == rows["lo"][lead])
    return rows[~equal], rows[equal & ~same]


def _joined(rows: np.ndarray) -> np.ndarray:
    """Runs of windows that touch in one document as one run each."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows["lo"], rows["h"], rows["d"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["d"][1:] != rows["d"][:-1]) | (rows["h"][1:] != rows["h"][:-1]) | (rows["lo"][1:] > rows["hi"][:-1] + 1)
    cuts = np.flatnonzero(new)
    out = rows[cuts]
    out["hi"] = rows["hi"][np.append(cuts[1:], len(rows)) - 1]
    out["g"] = out["c"] = 0
    return out


def _packed(rows: np.ndarray) -> bytes:
    """Contexts byte by byte in columns, which compress better than rows."""
    return np.ascontiguousarray(rows).view(np.uint8).reshape(-1, _CONTEXT.itemsize).T.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(_CONTEXT.itemsize, -1).T).view(_CONTEXT).ravel()


def _deal(n_blocks: int, contexts=_pieces):
    """Contexts packed by block of anchors; repeats found here go to blocks past those."""
    def flush(parts, count):
        shift = np.cumsum([0, *(len(data) for _, _, data in parts)])
        keep, again = _collapsed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + s for p, s in zip(parts, shift)]), np.concatenate([p[2] for p in parts]))
        again = _joined(again)
        block = (keep["g"] % np.uint64(n_blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        keep, block = keep[order], block[order]
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        blocks, pieces = block[cuts].tolist(), [_packed(keep[a:b]) for a, b in zip(cuts, [*cuts[1:], len(keep)])]
        if len(again):
            blocks.append(n_blocks + (int(again["d"][0]) + count) % n_blocks)
            pieces.append(_packed(again))
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(pieces, pa.binary())], names=["block", "packed"])

    def run(batches):
        parts, size, count = [], 0, 0
        for batch in batches:
            for part in contexts(batch):
                parts.append(part)
                size += len(part[0])
                if size >= _FLUSH:
                    yield flush(parts, count)
                    parts, size, count = [], 0, count + 1
        if size:
            yield flush(parts, count)
    return run


def _runs(kind: np.ndarray | str, rows: np.ndarray) -> pa.Table:
    plain = {c: np.ascontiguousarray(rows[c]) for c in ("g", "d", "h", "lo", "hi")}
    plain["g"] = plain["g"].view(np.int64)
    return pa.table({"kind": pa.array(np.full(len(rows), kind) if isinstance(kind, str) else kind, pa.string()), **plain})


def _shared(n_blocks: int, heavy: int):
    """Runs of repeated windows (again), and those whose anchor is shared: by very many contexts
    (heavy), by others of a different hash (sort, the earliest of its hash), or by such as the
    hash takes for equal alone (the earliest: lead; the others: claim)."""
    def run(key, group):
        rows = np.concatenate([_unpacked(x) for x in group.column("packed").to_pylist()])
        if key[0].as_py() >= n_blocks:
            return _runs("again", rows)
        rows = rows[np.lexsort((rows["lo"], rows["h"], rows["d"], rows["c"], rows["g"]))]
        new_g = np.ones(len(rows), bool)
        new_g[1:] = rows["g"][1:] != rows["g"][:-1]
        new = new_g.copy()
        new[1:] |= rows["c"][1:] != rows["c"][:-1]
        of = np.cumsum(new_g) - 1
        count, kinds = np.bincount(of)[of], np.bincount(of, weights=new)[of]
        kind = np.where(count > heavy, "heavy", np.where(~new, "claim", np.where(kinds > 1, "sort", "lead"))).astype(object)
        return _runs(kind[count > 1], rows[count > 1])
    return run


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16, key=_KEY).digest()


def _cut_contexts(n_blocks: int):
    """Fetch the bytes of the runs to sort, and digests of those of the others, packed by block of anchors."""
    def run(batches):
        for whole in batches:
            for batch in sub_batches(whole):
                todo = batch.column("todo")
                flat = todo.flatten()
                g, lo, hi, with_bytes = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("g", "lo", "hi", "whole"))
                row = np.repeat(np.arange(batch.num_rows), todo.value_lengths().to_numpy(zero_copy_only=False))
                (_, _, data, offsets), = text_slices(batch.column("text"), 1 << 62)
                start = lo + offsets[row]
                size = np.minimum(hi + LENGTH, offsets[row + 1] - offsets[row]) - lo
                heads = np.stack([_numbers(batch, "d")[row], _numbers(batch, "h")[row], lo.astype(np.int64), size, g, with_bytes])
                block = (g.view(np.uint64) % np.uint64(n_blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
                raw, first, texts = data.tobytes(), [], []
                for a, b in zip(cuts, [*cuts[1:], len(order)]):
                    x = order[a:b]
                    first.append(np.ascontiguousarray(heads[:, x]).tobytes())
                    texts.append(b"".join([raw[i: i + n] if w else _digest(raw[i: i + n]) for i, n, w in zip(start[x].tolist(), size[x].tolist(), with_bytes[x].tolist())]))
                yield pa.RecordBatch.from_arrays([pa.array(block[order[cuts]], pa.int32()), pa.array(first, pa.binary()), pa.array(texts, pa.binary())], names=["block", "heads", "texts"])
    return run


def _triples(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the triples at some positions of s, and whether each starts a new name."""
    a, b, c = s[at], s[at + 1], s[at + 2]
    if s.max(initial=0) < 1 << 21:
        key = (a << 42) | (b << 21) | c
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        return order, new
    order = np.lexsort((c, b, a))
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0) | (np.diff(c[order]) != 0)
    return order, new


def suffix_order(s: np.ndarray, reach: int | None = None, depth: int = 3) -> np.ndarray:
    """Suffix array of positive integers by difference cover modulo 3.

    With ``reach``, suffixes that agree in so many symbols may come in any order.
    """
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    padded = np.concatenate([s, np.zeros(4, s.dtype)]).astype(np.int64)
    ones = np.arange(1, n + (n % 3 == 1), 3)
    cover = np.concatenate([ones, np.arange(2, n, 3)])
    order, new = _triples(padded, cover)
    names = np.empty(len(cover), np.int64)
    names[order] = np.cumsum(new)
    if not new.all() and (reach is None or depth < reach + 2):
        order = suffix_order(names, reach, depth * 3)
        names[order] = np.arange(1, len(cover) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[cover] = names
    sampled = cover[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    width = np.int64(len(cover) + 2)
    by_rest = padded[rest] * width + rank[rest + 1]
    rest = rest[np.argsort(by_rest)]
    # merge: a remaining suffix against those at 1 mod 3 by a symbol and a rank, against those at 2 mod 3 by two symbols and a rank
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    key_rest, key_first = padded[rest] * width + rank[rest + 1], padded[first] * width + rank[first + 1]
    kinds = int(padded.max()) + 1
    pairs = padded[:-1] * kinds + padded[1:]
    if kinds * kinds * int(width) >= 1 << 63:
        pairs = np.unique(pairs, return_inverse=True)[1]
    key_rest2, key_second = pairs[rest] * width + rank[rest + 2], pairs[second] * width + rank[second + 2]
    place = np.empty(n, np.int64)
    place[rest] = np.arange(len(rest)) + np.searchsorted(key_first, key_rest, "left") + np.searchsorted(key_second, key_rest2, "left")
    within = np.arange(len(sampled))
    is_first = sampled % 3 == 1
    place[first] = within[is_first] + np.searchsorted(key_rest, key_first, "right")
    place[second] = within[~is_first] + np.searchsorted(key_rest2, key_second, "right")
    if reach is not None:  # suffixes that agree that far may claim one place
        return np.argsort(place, kind="stable")
    out = np.empty(n, np.int64)
    out[place] = np.arange(n)
    return out


def _sort_block(_, group):
    """Runs of repeated windows in a block: of contexts of equal digest all but the earliest, of
    the others what their suffix array shows. An anchor with a context that is neither there
    with its bytes nor equal to one that is (nor its anchor's only one) is wrong."""
    heads = np.concatenate([np.frombuffer(x, np.int64).reshape(6, -1) for x in group.column("heads").to_pylist()], axis=1).T
    raw = b"".join(group.column("texts").to_pylist())
    whole = heads[:, 5] > 0
    ends = np.cumsum(np.where(whole, heads[:, 3], 16))
    texts = [raw[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]
    digests = [_digest(t) if w else t for t, w in zip(texts, whole.tolist())]
    order = np.lexsort((heads[:, 2], heads[:, 1], heads[:, 0]))
    first: dict[tuple, int] = {}
    lead = np.array([first.setdefault((digests[i], g), i) for i, g in zip(order.tolist(), heads[order, 4].tolist())], np.int64)
    # the first of each digest: sorted if its anchor has several, and then it has to have its bytes
    one = np.array(list(first.values()), np.int64)
    _, of, count = np.unique(heads[one, 4], return_inverse=True, return_counts=True)
    mixed = one[count[of] > 1]
    wrong = np.unique(heads[mixed[~whole[mixed]], 4])
    fine = ~np.isin(heads[:, 4], wrong)
    again = order[(lead != order) & (heads[order, :3] != heads[lead, :3]).any(axis=1) & fine[order]]
    runs = np.zeros(len(again), _CONTEXT)
    runs["d"], runs["h"], runs["lo"] = heads[again, 0], heads[again, 1], heads[again, 2]
    runs["hi"] = heads[again, 2] + heads[again, 3] - LENGTH
    runs = _joined(runs)
    mixed = mixed[fine[mixed]]
    heads, joint = heads[mixed], b"".join([texts[i] for i in mixed.tolist()])
    del raw, texts, digests, first, order, lead, again
    late = _sorted_repeats(heads, np.frombuffer(joint, np.uint8))
    out = pa.concat_tables([pa.table({c: np.ascontiguousarray(runs[c]) for c in ("d", "h", "lo", "hi")}), late])
    none = np.zeros(len(wrong), np.int32)
    out = pa.concat_tables([out, pa.table({"d": none.astype(np.int64), "h": none.astype(np.int64), "lo": none, "hi": none})])
    n = len(out) - len(wrong)
    return out.add_column(0, "g", pa.array(np.concatenate([np.zeros(n, np.int64), wrong]))).add_column(0, "wrong", pa.array(np.arange(len(out)) >= n))


def _sorted_repeats(heads: np.ndarray, raw: np.ndarray) -> pa.Table:
    """Runs (d, h, lo, hi) of windows that stand earlier in different contexts (d, h, lo, size)."""
    keys, document = np.unique(heads[:, :2], axis=0, return_inverse=True)  # in order of d, then h
    document = document.ravel()
    sizes = heads[:, 3]
    # one separator before each context: symbols 2 to 257 are bytes, 1 separates
    begin = np.cumsum(sizes + 1) - sizes
    text = np.ones(len(raw) + len(heads), np.int64)
    is_text = np.ones(len(text), bool)
    is_text[begin - 1] = False
    text[is_text] = raw.astype(np.int64) + 2
    owner = np.repeat(np.arange(len(heads)), sizes + 1)
    order = suffix_order(text, LENGTH)
    order = order[is_text[order] & (order + LENGTH <= (begin + sizes)[owner[order]])]
    small = text.astype(np.int16)
    equal = np.zeros(len(order), bool)
    reach = np.arange(LENGTH)
    for a in range(1, len(order), 1 << 15):
        x = order[a - 1: a + (1 << 15)]
        rows = small[x[:, None] + reach]
        equal[a: a + len(x) - 1] = (rows[1:] == rows[:-1]).all(axis=1)
    kind = np.cumsum(~equal)
    d, at = document[owner[order]], heads[owner[order], 2] + order - begin[owner[order]]
    again = equal.copy()
    again[:-1] |= equal[1:]
    kind, d, at = kind[again], d[again], at[again]
    rank = np.lexsort((at, d, kind))
    kind, d, at = kind[rank], d[rank], at[rank]
    first = np.ones(len(kind), bool)
    first[1:] = kind[1:] != kind[:-1]
    lead = np.cumsum(first) - 1
    late = (d != d[first][lead]) | (at != at[first][lead]) if len(kind) else first
    d, at = d[late], at[late]
    rank = np.lexsort((at, d))
    d, at = d[rank], at[rank]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (at[1:] > at[:-1] + 1)
    cuts = np.flatnonzero(new)
    last = np.append(cuts[1:], len(d)) - 1
    return pa.table({"d": keys[d[cuts], 0], "h": keys[d[cuts], 1], "lo": at[cuts].astype(np.int32), "hi": at[last].astype(np.int32) if len(cuts) else np.zeros(0, np.int32)})


def _repeats(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Runs (d, h, lo, hi) of window starts that repeat an earlier window; texts has d, h and text."""
    n_blocks = n_blocks_of(texts, BLOCK_BYTES)
    dealt = texts.where(F.octet_length("text") >= LENGTH).mapInArrow(_deal(n_blocks), _PACKED)
    runs = scratch.saved(dealt.groupBy("block").applyInArrow(_shared(n_blocks, HEAVY), _RUN), "runs")
    heavy = runs.where("kind = 'heavy'")
    if not heavy.isEmpty():
        todo = heavy.groupBy("d", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("todo"))
        fine = texts.join(todo, ["d", "h"]).mapInArrow(_deal(n_blocks, _windows), _PACKED)
        runs = runs.unionByName(scratch.saved(fine.groupBy("block").applyInArrow(_shared(n_blocks, 1 << 62), _RUN), "windows"))
    def sorted_(some: DataFrame, whole) -> DataFrame:
        todo = some.groupBy("d", "h").agg(F.collect_list(F.struct("g", "lo", "hi", whole.alias("whole"))).alias("todo"))
        cut = texts.join(todo, ["d", "h"]).mapInArrow(_cut_contexts(n_blocks), "block int, heads binary, texts binary")
        return scratch.saved(cut.groupBy("block").applyInArrow(_sort_block, _FOUND), "found")

    shared = runs.where("kind in ('sort', 'lead', 'claim')")
    found = sorted_(shared, F.col("kind") == "sort")
    wrong = found.where("wrong").select("g").distinct()
    out = runs.where("kind = 'again'").select("d", "h", "lo", "hi").unionByName(found.where("not wrong").select("d", "h", "lo", "hi"))
    if not wrong.isEmpty():
        out = out.unionByName(sorted_(shared.join(wrong, "g", "left_semi"), F.lit(True)).select("d", "h", "lo", "hi"))
    return out


def _with_runs(docs: DataFrame, row) -> DataFrame:
    """row, text and the runs of repeated windows of each document."""
    small_batches(docs.sparkSession)
    key, scratch = document_key(docs), Scratch()
    runs = _repeats(docs.select(*key, "text"), scratch).groupBy("d", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    runs = saved(runs, "repeats")
    scratch.clear()
    return docs.select(*key, row.alias("row"), "text").join(runs, ["d", "h"], "left").select("row", "text", "runs")


def _removed(size: int, runs) -> tuple[np.ndarray, np.ndarray]:
    if not runs:
        none = np.zeros(0, np.int64)
        return none, none
    lo = np.array([r["lo"] for r in runs], np.int64)
    hi = np.array([r["hi"] for r in runs], np.int64) + LENGTH
    start, end = merged(np.minimum(lo, size), np.minimum(hi, size))
    return start[end > start], end[end > start]


def _kept(raw: bytes, start, end) -> list[bytes]:
    edges = [0, *np.stack([start, end], axis=1).ravel().tolist(), len(raw)]
    return [raw[edges[i]: edges[i + 1]] for i in range(0, len(edges), 2)]


def _spans(batches):
    for batch in batches:
        out = []
        for text, runs in zip(batch.column("text"), batch.column("runs")):
            raw = (text.as_py() or "").encode()
            start, end = _removed(len(raw), runs.as_py())
            digest = hashlib.sha256(b"".join(_kept(raw, start, end))).hexdigest()
            out.append((len(raw), int((end - start).sum()), [{"start": int(a), "end": int(b)} for a, b in zip(start, end)], digest))
        n, removed, spans, digests = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, spans (bytes to remove), kept_sha256."""
    rows = _with_runs(docs, F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(_spans, f"doc_id bigint, n_bytes bigint, n_removed bigint, spans {_SPANS}, kept_sha256 string")


def _cut_texts(batches):
    for batch in batches:
        out = []
        for text, runs in zip(batch.column("text"), batch.column("runs")):
            value, found = text.as_py(), runs.as_py()
            if found:
                raw = value.encode()
                start, end = _removed(len(raw), found)
                ahead = lambda i: next((k for k in range(i, len(raw)) if raw[k] & 0xC0 != 0x80), len(raw))
                back = lambda i: i if i >= len(raw) else next(k for k in range(i, -1, -1) if raw[k] & 0xC0 != 0x80)
                start, end = np.array([ahead(int(i)) for i in start], np.int64), np.array([back(int(i)) for i in end], np.int64)
                value = b"".join(_kept(raw, start[start < end], end[start < end])).decode()
            out.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated strings cut out of ``text`` (characters of which
    every byte goes) and ``n_chars`` recounted, columns as they came."""
    rows = _with_runs(docs, others(docs))
    out = rows.mapInArrow(_cut_texts, rows.select("row", F.col("text").alias("kept")).schema)
    return restored(out, docs, text=F.col("kept"), n_chars=F.length("kept").cast("bigint"))


def op1(spark, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")
