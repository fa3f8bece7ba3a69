"""SentencePiece encoding and decoding with N-best segmentation.

The pieces of a public model form a lattice over each text; the score of a
segmentation is the sum of its pieces' scores. A forward Viterbi pass gives the
best score up to every position, and these are exact heuristics for a backward
A* search, which therefore yields segmentations in order of score and expands
no more than it must.

No piece holds a space after a non-space, so the lattice of a text is a chain of
lattices of its chunks (spaces and the word behind them). Chunks are solved once
per task: all new chunks of a slice share one vectorised Viterbi pass
forward and backward, which gives the best path and the gap to the second. Of a
text's chunks only the n - 1 with the smallest gaps can take part in its n best
segmentations; those go through the A* search, and the search over their
combinations is again best first.

A character without a piece of its own is spelled in byte pieces, at a score
below all pieces. A literal U+2581 is such a character, so decoding gives back
the very text.

A row gives the best segmentation as tokens and the others as edits of it: which
tokens give way to which, chunk by chunk; ``segmentations`` spells them out.

Defined cases: a null text gives null tokens, an empty text no tokens and one
segmentation of score 0; equal scores prefer longer last pieces; rows are never
merged or dropped; an empty table gives no rows; very long texts are segmented
whole; extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches, sub_batches, table

MODEL = "piece_bpe_32k.model"
N_BEST = 4
#: Solved chunks that a task keeps; when a slice would exceed that, those met only once go, or else all.
KEEP_CHUNKS = 200_000
#: Chunks longer than this are solved one by one.
_LONG = 64
_CHUNK = re.compile(r" +[^ ]*")
_B = np.uint64(0x9E3779B97F4A7C15)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def load_pieces(path: str) -> dict:
    """{"pieces": {text: (id, score)}, "bytes": 256 ids, "unknown": score, "raw": bytes by id}."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, raw = {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(text[3:5], 16)] = i
            raw.append(bytes([int(text[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            raw.append(b"")
        else:
            spaced = text.replace("▁", " ")
            raw.append(spaced.encode())
            if " " in spaced.lstrip(" "):
                raise ValueError(f"piece {text!r} crosses a word")
            pieces[spaced] = (i, float(model.get_score(i)))
    lowest = min(s for _, s in pieces.values() if s > -1e8)
    return {"pieces": pieces, "bytes": byte_ids, "unknown": lowest - 10.0, "raw": raw, **_tables(pieces)}


def _tables(pieces: dict) -> dict:
    """Hashes of all pieces and of their beginnings, sorted, with the id and score of pieces."""
    marks: dict[int, tuple[int, float]] = {}
    for text, (i, s) in pieces.items():
        h = 0
        for k, c in enumerate(text):
            h = (h * int(_B) + ord(c) + 1) & ((1 << 64) - 1)
            if k + 1 < len(text):
                marks.setdefault(h, (-1, 0.0))
        marks[h] = (i, s)
    hashes = np.array(sorted(marks), np.uint64)
    return {"hashes": hashes, "piece_of": np.array([marks[int(h)][0] for h in hashes], np.int64), "score_of": np.array([marks[int(h)][1] for h in hashes])}


class Segmenter:
    def __init__(self, model: dict):
        self.pieces, self.byte_ids, self.unknown, self.raw = model["pieces"], model["bytes"], model["unknown"], model["raw"]
        self.hashes, self.piece_of, self.score_of = model["hashes"], model["piece_of"], model["score_of"]
        self.near = np.zeros(1 << 22, bool)
        self.near[self.hashes >> np.uint64(42)] = True
        self.longest = max(map(len, self.pieces))
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score, self.gap, self.met = np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        self.known: dict[tuple[str, int], list] = {}

    # -- the lattice of one chunk ------------------------------------------------

    def edges(self, chunk: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end position the edges (start, score, ids) into it, longest first."""
        n = len(chunk)
        into: list[list] = [[] for _ in range(n + 1)]
        get = self.pieces.get
        for a in range(n):
            for b in range(a + 1, min(n, a + self.longest) + 1):
                found = get(chunk[a:b])
                if found:
                    into[b].append((a, found[1], (found[0],)))
                elif b == a + 1:
                    into[b].append((a, self.unknown, tuple(self.byte_ids[x] for x in chunk[a].encode())))
        return into

    def nbest(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations (score, ids): backward A* from the end of the chunk."""
        into = self.edges(chunk)
        ahead = [0.0] + [0.0] * len(chunk)
        for b in range(1, len(chunk) + 1):
            ahead[b] = max(ahead[a] + s for a, s, _ in into[b])
        order = count()
        heap = [(-ahead[-1], next(order), len(chunk), 0.0, None)]
        # at a position only the n best ways to the end can be part of the n best segmentations
        ways: list[list[float]] = [[] for _ in ahead]
        out = []
        while heap and len(out) < n:
            _, _, b, done, path = heapq.heappop(heap)
            if b == 0:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((done, tuple(ids)))
                continue
            for a, s, ids_ in into[b]:
                known, new = ways[a], done + s
                if len(known) < n:
                    heapq.heappush(known, new)
                elif new > known[0]:
                    heapq.heapreplace(known, new)
                else:
                    continue
                heapq.heappush(heap, (-(new + ahead[a]), next(order), a, new, (ids_, path)))
        return out

    # -- many chunks at once -------------------------------------------------------

    def learn(self, chunks: list[str]) -> None:
        """Solve new chunks: best ids, score and gap to the second best."""
        sizes = np.array([len(c) for c in chunks], np.int64)
        size, score, gap = np.zeros(len(chunks), np.int64), np.zeros(len(chunks)), np.zeros(len(chunks))
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # chunks, and their ids one after another
        low = 0
        for high in (8, 12, 16, 24, 32, 48, _LONG):
            some = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(some):
                score[some], gap[some], size[some], flat = self._solve([chunks[i] for i in some], sizes[some])
                parts.append((some, flat))
            low = high
        for i in np.flatnonzero(sizes > _LONG).tolist():
            two = self.nbest(chunks[i], 2)
            parts.append((np.array([i]), np.array(two[0][1], np.int32)))
            size[i], score[i], gap[i] = len(two[0][1]), two[0][0], two[0][0] - two[1][0] if len(two) > 1 else np.inf
        new = len(self.place)
        self.place.update(zip(chunks, range(new, new + len(chunks))))
        begin = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.int32)
        for some, ids in parts:
            n = size[some]
            flat[np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        self.begin, self.size = np.append(self.begin, len(self.flat) + begin), np.append(self.size, size)
        self.flat = np.concatenate([self.flat, flat])
        self.score, self.gap, self.met = np.append(self.score, score), np.append(self.gap, gap), np.append(self.met, np.zeros(len(chunks), np.int64))

    def forget(self) -> None:
        """Drop the chunks that were met only once; all, if that leaves over half of what may be kept."""
        stay = np.flatnonzero(self.met > 1)
        if len(stay) > KEEP_CHUNKS // 2:
            return self.clear()
        size = self.size[stay]
        ends = np.cumsum(size)
        self.flat = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[stay] - (ends - size), size)]
        names = list(self.place)
        self.place = {names[i]: k for k, i in enumerate(stay.tolist())}
        self.begin, self.size, self.score, self.gap, self.met = ends - size, size, self.score[stay], self.gap[stay], np.ones(len(stay), np.int64)
        self.known = {k: v for k, v in self.known.items() if k[0] in self.place}

    def _solve(self, chunks: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Viterbi over chunks of similar length side by side: ``into[w, t, k - 1]`` is the
        score of the edge of k characters that ends at t in chunk w. Gives scores, gaps, numbers
        of ids and the ids of all chunks."""
        n_chunks, n = len(chunks), int(size.max())
        code = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).astype(np.uint64)
        word = np.repeat(np.arange(n_chunks), size)
        place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        left = size[word] - place
        at, h = np.arange(len(code)), np.zeros(len(code), np.uint64)
        found = []
        with np.errstate(over="ignore"):
            for k in range(1, self.longest + 1):
                h = h * _B + code[at + k - 1] + np.uint64(1)
                near = self.near[h >> np.uint64(42)]
                x = np.searchsorted(self.hashes, h[near])
                x[x == len(self.hashes)] = 0
                here = self.hashes[x] == h[near]
                alive, hit, kept = at[near][here], x[here], h[near][here]
                is_piece = self.piece_of[hit] >= 0
                found.append((k, alive[is_piece], self.piece_of[hit][is_piece], self.score_of[hit][is_piece]))
                if k == 1:
                    bare = np.ones(len(code), bool)
                    bare[alive[is_piece]] = False
                    lone = np.flatnonzero(bare)
                    found.append((1, lone, np.full(len(lone), -1), np.full(len(lone), self.unknown)))
                more = left[alive] > k
                at, h = alive[more], kept[more]
                if not len(at):
                    break
        most = max(k for k, *_ in found)
        into = np.full((n_chunks, n + 1, most), -np.inf)
        out_of = np.full((n_chunks, n + 1, most), -np.inf)
        piece = np.full((n_chunks, n + 1, most), -1, np.int32)
        for k, start, p, s in found:
            w, a = word[start], place[start]
            into[w, a + k, k - 1], out_of[w, a, k - 1], piece[w, a + k, k - 1] = s, s, p
        rows = np.arange(n_chunks)
        ahead, behind = np.full((n_chunks, n + 1), -np.inf), np.full((n_chunks, n + 1 + most), -np.inf)
        ahead[:, 0], behind[rows, size] = 0.0, 0.0
        via = np.zeros((n_chunks, n + 1), np.int64)
        for t in range(1, n + 1):
            m = min(most, t)
            into[:, t, :m] += ahead[:, t - m: t][:, ::-1]
            via[:, t] = m - into[:, t, :m][:, ::-1].argmax(axis=1)  # the longest of equals
            ahead[:, t] = into[rows, t, via[:, t] - 1]
        for t in range(n - 1, -1, -1):
            behind[:, t] = np.maximum(behind[:, t], (out_of[:, t, :] + behind[:, t + 1: t + 1 + most]).max(axis=1))
        steps, node, live = [], size.copy(), rows
        best = ahead[rows, size]
        while len(live):
            k = via[live, node]
            steps.append((live, piece[live, node, k - 1], node - 1))
            into[live, node, k - 1] = -np.inf
            node = node - k
            live, node = live[node > 0], node[node > 0]
        second = (into + behind[:, : n + 1, None]).max(axis=(1, 2))
        owner, got, last = (np.concatenate(x) for x in zip(*steps))
        order = np.argsort(owner[::-1], kind="stable")
        owner, got, last = owner[::-1][order], got[::-1][order].astype(np.int32), last[::-1][order]
        # a character without a piece gives way to the pieces of its bytes
        bare = np.flatnonzero(got < 0)
        spelled = [[self.byte_ids[x] for x in chunks[w][i].encode()] for w, i in zip(owner[bare].tolist(), last[bare].tolist())]
        times = np.ones(len(got), np.int64)
        times[bare] = [len(x) for x in spelled]
        flat = np.repeat(got, times)
        flat[flat < 0] = np.array(list(chain.from_iterable(spelled)), np.int32)
        return best, best - second, np.bincount(np.repeat(owner, times), minlength=n_chunks), flat

    # -- texts -----------------------------------------------------------------------

    def split(self, texts: list[str | None]):
        """Yield (row, chunks, places of the chunks, ids) with every chunk solved."""
        split = [_CHUNK.findall(" " + t) if t else [] for t in texts]
        all_ = set().union(*split)
        new = all_.difference(self.place)
        if len(self.place) + len(new) > KEEP_CHUNKS:
            self.forget()
            new = all_.difference(self.place)
        if new:
            self.learn(sorted(new))
        n_chunks = np.array([len(c) for c in split])
        places = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64, int(n_chunks.sum()))
        self.met += np.bincount(places, minlength=len(self.met))
        size = self.size[places]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.begin[places] - ends[:-1], size)]
        stop = np.cumsum(n_chunks)
        for k, chunks in enumerate(split):
            a, b = int(stop[k] - n_chunks[k]), int(stop[k])
            yield k, chunks, places[a:b], ids[ends[a]: ends[b]]

    def text_nbest(self, chunks: list[str], places: np.ndarray, n: int) -> list[tuple[float, dict[int, tuple[int, ...]]]]:
        """The n best segmentations of a text: score, and the ids of the chunks that differ from the best."""
        total = float(self.score[places].sum())
        gaps = self.gap[places]
        near = np.argsort(gaps, kind="stable")[: n - 1] if len(gaps) <= n else np.argpartition(gaps, n - 2)[: n - 1]
        near = [int(i) for i in sorted(near) if np.isfinite(gaps[i])]
        options = [self._nbest_known(chunks[i], int(places[i]), n) for i in near]
        heap = [(-0.0, (0,) * len(near))]
        seen, out = {heap[0][1]}, []
        while heap and len(out) < n:
            loss, pick = heapq.heappop(heap)
            out.append((total - loss, {i: o[p][1] for i, o, p in zip(near, options, pick) if p}))
            for k, o in enumerate(options):
                if pick[k] + 1 < len(o):
                    new = (*pick[:k], pick[k] + 1, *pick[k + 1:])
                    if new not in seen:
                        seen.add(new)
                        heapq.heappush(heap, (sum(x[0][0] - x[p][0] for x, p in zip(options, new)), new))
        return out

    def _nbest_known(self, chunk: str, place: int, n: int) -> list:
        """The n best of a chunk; of equal scores the one that the chunk was solved with comes first."""
        if (chunk, n) not in self.known:
            best = tuple(self.flat[self.begin[place]: self.begin[place] + self.size[place]].tolist())
            found = self.nbest(chunk, n)
            self.known[chunk, n] = [(found[0][0], best), *[x for x in found if x[1] != best]][:n]
        return self.known[chunk, n]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text else text


def segmentations(tokens: list[int], others: list) -> list[list[int]]:
    """The ids of all n best segmentations of a row of ``encode``, best first."""
    out = [list(tokens)]
    for edits in others:
        ids = list(tokens)
        for start, end, new in sorted(edits, reverse=True):
            ids[start:end] = new
        out.append(ids)
    return out


def _edits(rows: list) -> pa.Array:
    """Rows of lists of lists of (start, end, ids) as an Arrow column; None is null."""
    row_at, list_at, ids_at = [0], [0], [0]
    start, end, ids = [], [], []
    for row in rows:
        for edits in row or ():
            for a, b, new in edits:
                start.append(a)
                end.append(b)
                ids += new
                ids_at.append(len(ids))
            list_at.append(len(start))
        row_at.append(len(list_at) - 1)
    number = lambda x: pa.array(x, pa.int32())
    edit = pa.StructArray.from_arrays([number(start), number(end), pa.ListArray.from_arrays(number(ids_at), number(ids))], names=["start", "end", "ids"])
    lists = pa.ListArray.from_arrays(number(list_at), edit)
    return pa.ListArray.from_arrays(number(row_at), lists, mask=pa.array([r is None for r in rows], pa.bool_()))


def _encode(shared, n: int, with_ids: bool):
    def run(batches):
        tool = Segmenter(shared.value)
        for batch in chain.from_iterable(map(sub_batches, batches)):
            texts = batch.column("text").to_pylist()
            size, digest, scores, back, tokens, others = [], [], [], [], [], []
            for r, chunks, places, ids in tool.split(texts):
                if texts[r] is None:
                    for x in (size, digest, scores, back, tokens, others):
                        x.append(None)
                    continue
                size.append(len(ids))
                digest.append(hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
                best = tool.text_nbest(chunks, places, n)
                scores.append([s for s, _ in best])
                if with_ids:
                    ends = np.cumsum(tool.size[places])
                    others.append([[(int(ends[i] - tool.size[places[i]]), int(ends[i]), new) for i, new in changed.items()] for _, changed in best[1:]])
                back.append(tool.decode(ids.tolist()) == texts[r])
                tokens.append(ids if with_ids else None)
            columns = [batch.column("row"), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(scores, pa.list_(pa.float64())), pa.array(back, pa.bool_())]
            names = ["row", "n_tokens", "tokens_sha256", "scores", "round_trip"]
            if with_ids:
                columns += [pa.array(tokens, pa.list_(pa.int32())), _edits(others)]
                names += ["tokens", "others"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def encode(docs: DataFrame, model: str | None = None, n: int = N_BEST, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, tokens_sha256 (of the ids as 32-bit little-endian numbers), scores
    (of the n best segmentations), round_trip (decoding gives back the text), tokens of the best
    and, for each of the others, the edits (start, end, ids) that make it of those tokens."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(model or default_model()))
    schema = "row bigint, n_tokens bigint, tokens_sha256 string, scores array<double>, round_trip boolean" + (", tokens array<int>, others array<array<struct<start:int,end:int,ids:array<int>>>>" if with_ids else "")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("row"), "text")
    return rows.mapInArrow(_encode(shared, n, with_ids), schema).withColumnRenamed("row", "doc_id")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of rows (doc_id, tokens)."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_pieces(model or default_model()))

    def run(batches):
        tool = Segmenter(shared.value)
        for batch in batches:
            texts = [None if t is None else tool.decode(t) for t in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "tokens").mapInArrow(run, "doc_id bigint, text string")


def op8(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
