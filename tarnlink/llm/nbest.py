"""SentencePiece encoding and decoding: the N best segmentations by summed log probabilities of pieces.

The model file ranks pieces by the order of its merges and has no probabilities. A piece of rank r counts as having a
probability in proportion to 1 / (r + OFFSET), a Zipf-Mandelbrot law: fixed by the model, the same for every corpus. The best
segmentation under it needs slightly fewer pieces than the model's own encoder (which applies merges greedily, without
looking at the whole word) and equals that encoder's for most words; the tests hold both figures. Ids are the model's.

Forward Viterbi scores of every lattice node are exact heuristics for a backward A* search from the end of the text:
whatever it pops first is best. No piece of the vocabulary holds a space mark after another character, so a text's
lattice falls into one lattice a word (space marks and what follows up to the next mark). Words are scored once each
with numpy, all words of a length side by side: forward and backward scores give the best path and, as the best
sum over an edge off that path, the runner-up. Only the N - 1 words of a text whose runners-up cost least can differ
from their best in its N best segmentations; A* lists the alternatives of just those, and their sums are merged together
with the words' choices, from which the ids of all N segmentations are put together.

Characters without a piece are one lattice edge (score UNKNOWN below the least piece) and come out as byte pieces.
Text is otherwise taken as it is: a mark is put before it, and spaces become marks. Pieces and words are found by hash and
compared character by character, so equal hashes of different ones change nothing.

Defined cases: null and empty texts have no pieces and one segmentation of score 0; where sums tie, the shorter last
piece wins; text that holds the mark itself decodes to a space there; equal texts and repeated rows give equal results; an
empty table gives no rows; other columns do not take part, and a kept column of the name of a result leaves that result
an underscore before its name. A model with a piece that has a mark after another character is refused (ValueError).
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, results, text_batches
from .wordhash import U, mix, powers, raw, slabs

MARK = "▁"
UNKNOWN = 10.0
#: Of the law that makes ranks probabilities.
OFFSET = 100.0
#: Code points worked on at once; words remembered between slabs, after which those that the last two slabs didn't hold go.
SLAB, KNOWN = 1 << 19, 150_000
#: Code points of a word up to which words are scored side by side.
WIDE = 128
_P, _Q = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9)
_models: dict = {}


def load(path: str) -> Vocabulary:
    if path not in _models:
        _models[path] = Vocabulary(path)
    return _models[path]


def log_probabilities(scores: list[float]) -> list[float]:
    """Of pieces whose scores are minus their ranks."""
    p = 1 / (OFFSET - np.array(scores, float))
    return np.log(p / p.sum()).tolist()


class Vocabulary:
    """Pieces of a model file, by text and, for numpy, by hash within each length."""

    def __init__(self, path: str):
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.byte = {i: int(p[1:-1], 16) for i, p in enumerate(self.pieces) if m.is_byte(i)}
        self.of_byte = {b: i for i, b in self.byte.items()}
        self.unknown = m.unk_id()
        plain = [i for i, p in enumerate(self.pieces) if p and not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.score = dict(zip([self.pieces[i] for i in plain], zip(log_probabilities([m.get_score(i) for i in plain]), plain, strict=True), strict=True))
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece goes over a word's edge")
        self.low = min((s for s, _ in self.score.values() if s > -1e8), default=0.0) - UNKNOWN
        self.longest = max(map(len, self.score), default=1)
        self.tables = {}
        for n in range(1, self.longest + 1):
            own = [p for p in self.score if len(p) == n]
            h = np.zeros(len(own), U)
            cp = np.array([[ord(c) for c in p] for p in own], U).reshape(len(own), n)
            for i in range(n):
                h = h * _P + cp[:, i] + U(1)
            order = np.argsort(h)
            if len(np.unique(h)) < len(h):
                raise ValueError("two pieces of one length have the same hash")
            bits = np.zeros(1 << 18, bool)
            bits[(h * _Q >> U(46)).astype(np.int64)] = True
            self.tables[n] = (h[order], np.array([self.score[p][0] for p in own])[order], np.array([self.score[p][1] for p in own], np.int64)[order], bits, cp[order])
        self.segmentations = lru_cache(maxsize=10_000)(self._segmentations)

    def edges(self, word: str, end: int) -> Iterator[tuple[int, float]]:
        """(start, score) of the lattice edges that end at end; shorter ones first."""
        for n in range(1, min(self.longest, end) + 1):
            got = self.score.get(word[end - n : end])
            if got:
                yield end - n, got[0]
            elif n == 1:
                yield end - 1, self.low

    def _alternatives(self, word: str, k: int) -> tuple[tuple[float, tuple[int, ...]], ...]:
        """The k best segmentations of word: (score, cut positions), by A* from the end."""
        best, held = [0.0] + [-np.inf] * len(word), {}
        for j in range(1, len(word) + 1):
            into = tuple(self.edges(word, j))
            best[j] = max([best[i] + s for i, s in into])
            if j <= 1 << 12:  # of longer words edges are found again, not kept
                held[j] = into
        # f, then the nearer to the beginning: where very many segmentations tie, the first are finished first
        heap, serial, out = [(round(-best[-1], 6), len(word), 0, 0.0, None)], 1, []
        while heap and len(out) < k:
            _, j, _, g, tail = heapq.heappop(heap)
            if j == 0:
                cuts, at = [0], tail
                while at:
                    cuts.append(at[0])
                    at = at[1]
                out.append((g, tuple(cuts)))
                continue
            for i, s in held.get(j) or self.edges(word, j):
                heapq.heappush(heap, (round(-(best[i] + s + g), 6), i, serial, s + g, (j, tail)))
                serial += 1
        return tuple(out)

    def _segmentations(self, word: str, k: int, best: bytes) -> tuple[tuple[float, np.ndarray], ...]:
        """The k best segmentations of word as (score, ids); first the one with the ids that best holds, whatever
        ties with it."""
        found = []
        for score, cuts in self._alternatives(word, k):
            found.append((score, np.array([x for i, j in zip(cuts, cuts[1:]) for x in self.ids(word[i:j])], np.int32)))
        at = next((i for i, (_, ids) in enumerate(found) if ids.tobytes() == best), len(found) - 1)
        first = found[at] if found[at][1].tobytes() == best else (found[0][0], np.frombuffer(best, np.int32))
        return (first, *found[:at], *found[at + 1 :])

    def ids(self, piece: str) -> list[int]:
        got = self.score.get(piece)
        return [got[1]] if got else [self.of_byte.get(b, self.unknown) for b in piece.encode()]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the mark that encoding puts before it."""
        out, held = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte:
                held.append(self.byte[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i >= 0:
                out.append(self.pieces[i])
        return "".join(out).replace(MARK, " ")[1:]

    def found(self, cp: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each size of pieces the pieces in the words cp: (size, word, position, number in the size's table)."""
        n, width = cp.shape
        h = np.zeros((n, width + 1), U)
        for size in range(1, min(self.longest, width) + 1):
            h = h[:, : width - size + 1] * _P + cp[:, size - 1 :] + U(1)
            keys, _, _, bits, chars = self.tables[size]
            if not len(keys):
                yield size, *[np.zeros(0, np.int64)] * 3
                continue
            flat = h.ravel()
            maybe = np.flatnonzero(bits[(flat * _Q >> U(46)).astype(np.int64)])
            at = np.minimum(np.searchsorted(keys, flat[maybe]), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == flat[maybe])
            row, col = np.divmod(maybe[hit], h.shape[1])
            same = (cp[row[:, None], col[:, None] + np.arange(size)] == chars[at[hit]]).all(1)
            yield size, row[same], col[same], at[hit][same]

    def viterbi(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words of one length (rows of code points): best score, runner-up's score, and for each position
        the id (-1: unknown character) of the best path's piece that begins there, or -2."""
        n, width = cp.shape
        s, ids, some = {}, {}, {}  # by size: scores and ids, a row for each position, and whether any word has a piece there
        for size, row, col, at in self.found(cp):
            shape = width - size + 1, n
            s[size] = np.full(shape, self.low if size == 1 else -np.inf)
            ids[size] = np.full(shape, -1, np.int32)
            s[size][col, row], ids[size][col, row] = self.tables[size][1][at], self.tables[size][2][at]
            some[size] = np.bincount(col, minlength=shape[0]) > 0
            if size == 1:
                some[size][:] = True
        fore, aft = np.full((width + 1, n), -np.inf), np.full((width + 1, n), -np.inf)
        fore[0], aft[width], back = 0, 0, np.zeros((width + 1, n), np.int8 if self.longest < 128 else np.int64)
        c, better = np.empty(n), np.empty(n, bool)
        for j in range(1, width + 1):
            for size in range(1, min(self.longest, j) + 1):
                if some[size][j - size]:
                    np.add(fore[j - size], s[size][j - size], out=c)
                    np.greater(c, fore[j], out=better)
                    np.copyto(fore[j], c, where=better)
                    np.copyto(back[j], size, where=better)
        for i in range(width - 1, -1, -1):
            for size in range(1, min(self.longest, width - i) + 1):
                if some[size][i]:
                    np.add(s[size][i], aft[i + size], out=c)
                    np.maximum(aft[i], c, out=aft[i])
        path, begin, rows = np.full((width, n), -2, np.int64), np.zeros((width, n), np.int64), np.arange(n)
        at = np.full(n, width)
        while (live := at > 0).any():
            size = np.where(live, back[at, rows], 0)
            at = at - size
            begin[at[live], rows[live]] = size[live]
        second = np.full(n, -np.inf)
        for size, own in s.items():
            for i in np.flatnonzero(some[size]).tolist():
                on = begin[i] == size
                np.copyto(path[i], ids[size][i], where=on)
                np.add(fore[i], own[i], out=c)
                np.add(c, aft[i + size], out=c)
                np.copyto(c, -np.inf, where=on)
                np.maximum(second, c, out=second)
        return fore[width], second, path.T, begin.T

    def long(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What viterbi() gives, for one long word: it is cut where no piece goes over the edge, so that the parts' lattices are
        independent, and the parts are worked on side by side as far as they are short."""
        width = cp.shape[1]
        over = np.zeros(width + 1, np.int64)
        for size, _, col, _ in self.found(cp):
            np.add.at(over, col + 1, 1)
            np.add.at(over, col + size, -1)
        free = np.flatnonzero(np.cumsum(over)[1:width] == 0) + 1
        edges, at = [0], 0
        for e in [*free.tolist(), width]:  # parts of up to WIDE code points, if there are edges for that
            if e - edges[-1] > WIDE and at > edges[-1]:
                edges.append(at)
            at = e
        edges = np.array([*edges, width])
        sizes = np.diff(edges)
        best, gap = 0.0, np.inf
        path, begin = np.full((1, width), -2, np.int64), np.zeros((1, width), np.int64)
        for w in np.unique(sizes).tolist():
            starts = edges[:-1][sizes == w]
            step = max(1, (1 << 15) // w) if w <= WIDE else 1
            for k in range(0, len(starts), step):
                cells = starts[k : k + step, None] + np.arange(w)
                first, second, own, begun = self.viterbi(cp[0][cells]) if w <= WIDE else self.walk(cp[0][cells])
                best, gap = best + float(first.sum()), min(gap, float((first - second).min()))
                path[0, cells], begin[0, cells] = own, begun
        return np.array([best]), np.array([best - gap]), path, begin

    def walk(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What viterbi() gives, for one long word, position by position: a run of characters that pieces chain together."""
        word = "".join(map(chr, cp[0].tolist()))
        width = len(word)
        first, start, score = array("q", [0]), array("q"), array("d")  # the edges that end at j: from first[j - 1] to first[j]
        fore, back, aft = [0.0] + [-np.inf] * width, [0] * (width + 1), [-np.inf] * width + [0.0]
        for j in range(1, width + 1):
            for i, s in self.edges(word, j):
                start.append(i)
                score.append(s)
                if fore[i] + s > fore[j]:
                    fore[j], back[j] = fore[i] + s, j - i
            first.append(len(start))
        for j in range(width, 0, -1):
            for e in range(first[j - 1], first[j]):
                aft[start[e]] = max(aft[start[e]], score[e] + aft[j])
        path, begin, at = np.full((1, width), -2, np.int64), np.zeros((1, width), np.int64), width
        while at:
            size = back[at]
            at -= size
            begin[0, at] = size
            got = self.score.get(word[at : at + size])
            path[0, at] = got[1] if got else -1
        second = max((fore[start[e]] + score[e] + aft[j] for j in range(1, width + 1) for e in range(first[j - 1], first[j]) if begin[0, start[e]] != j - start[e]), default=-np.inf)
        return np.array([fore[width]]), np.array([second]), path, begin


class Encoder:
    """Encodes batches of texts, remembering words."""

    def __init__(self, v: Vocabulary):
        self.v, self.salt, self.slab = v, 0, 0
        self.forget()

    def forget(self) -> None:
        self.hash = np.zeros(0, U)
        self.best, self.second, self.count, self.first = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.chars, self.char, self.size, self.last = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def trim(self) -> None:
        """Forgets the words that the last two slabs didn't hold."""
        keep = self.last >= self.slab - 2
        for name in ("hash", "best", "second", "count", "first", "char", "size", "last"):
            setattr(self, name, getattr(self, name)[keep])
        for flat, first, count in (("flat", "first", "count"), ("chars", "char", "size")):
            begin, n = getattr(self, first), getattr(self, count)
            new = np.cumsum(n) - n
            setattr(self, flat, getattr(self, flat)[np.repeat(begin - new, n) + np.arange(n.sum())])
            setattr(self, first, new)

    def learn(self, hashes: np.ndarray, cp: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Scores the words (code points from starts on) under these hashes."""
        best, second, count = np.zeros(len(hashes)), np.zeros(len(hashes)), np.zeros(len(hashes), np.int64)
        pieces: list[tuple[np.ndarray, np.ndarray]] = []
        for width in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == width)
            step = max(1, (1 << 15) // width) if width <= WIDE else 1
            for k in range(0, len(own), step):
                rows = own[k : k + step]
                words = cp[starts[rows][:, None] + np.arange(width)].astype(U)
                best[rows], second[rows], path, begin = self.v.viterbi(words) if width <= WIDE else self.v.long(words)
                i, j = np.nonzero(begin)
                ids = path[i, j]
                lost = ids == -1
                if lost.any():  # one id a byte
                    made = [self.v.ids(chr(int(c))) for c in words[i[lost], j[lost]]]
                    times = np.ones(len(ids), np.int64)
                    times[lost] = [len(x) for x in made]
                    i, ids, lost = np.repeat(i, times), np.repeat(ids, times), np.repeat(lost, times)
                    ids[lost] = [y for x in made for y in x]
                count[rows] = np.bincount(i, minlength=len(rows))
                pieces.append((np.repeat(rows, count[rows]), ids))
        who = np.concatenate([p[0] for p in pieces])
        flat = np.concatenate([p[1] for p in pieces])[np.argsort(who, kind="stable")].astype(np.int32)
        first = np.cumsum(count) - count + len(self.flat)
        self.flat = np.concatenate((self.flat, flat))
        hashes = np.concatenate((self.hash, hashes))
        order = np.argsort(hashes)
        self.hash = hashes[order]
        char = np.cumsum(sizes) - sizes
        own = cp[np.repeat(starts - char, sizes) + np.arange(sizes.sum())]
        char, self.chars = char + len(self.chars), np.concatenate((self.chars, own))
        for name, new in (("best", best), ("second", second), ("count", count), ("first", first), ("char", char), ("size", sizes), ("last", np.full(len(sizes), self.slab))):
            setattr(self, name, np.concatenate((getattr(self, name), new))[order])

    def encode(self, texts: list[str], n: int) -> Iterator[tuple[list[np.ndarray], list[float]]]:
        """(ids, scores) of the n best segmentations of each text."""
        i = 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars + len(texts[j]) < SLAB):
                chars += len(texts[j]) + 1
                j += 1
            yield from self._slab(texts[i:j], n)
            i = j

    def _slab(self, texts: list[str], n: int) -> Iterator[tuple[list[np.ndarray], list[float]]]:
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        whole = "".join(marked)
        cp = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
        sizes = np.array([len(t) for t in marked], np.int64)
        edge = np.concatenate(([0], np.cumsum(sizes)))
        mark = cp == ord(MARK)
        head = mark.copy()
        head[1:] &= ~mark[:-1]
        head[edge[:-1][sizes > 0]] = True
        starts = np.flatnonzero(head)
        lengths = np.diff(np.concatenate((starts, [len(cp)])))
        if not len(starts):
            yield from (([np.zeros(0, np.int32)], [0.0]) for _ in texts)
            return
        rel = np.arange(len(cp)) - np.repeat(starts, lengths)
        while True:
            value = mix(cp.astype(U) + U(self.salt)) if self.salt else cp.astype(U) + U(1)
            h = mix(np.add.reduceat(value * powers(int(lengths.max()) + 1)[rel], starts) + lengths.astype(U))
            known, at, inverse = np.unique(h, return_index=True, return_inverse=True)
            if len(self.hash) > KNOWN:
                self.trim()
            new = ~np.isin(known, self.hash)
            if new.any():
                self.learn(known[new], cp, starts[at[new]], lengths[at[new]])
            own = np.searchsorted(self.hash, known)
            self.last[own] = self.slab
            word = own[inverse]
            if (self.size[word] == lengths).all() and (self.chars[np.repeat(self.char[word], lengths) + rel] == cp).all():
                break
            self.forget()  # two words of one hash: all again under other hashes
            self.salt += 1
        self.slab += 1
        gap = self.best[word] - self.second[word]
        firsts = np.searchsorted(starts, edge)
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            own = word[a:b]
            count = self.count[own]
            begin = np.cumsum(count) - count
            ids = self.flat[np.repeat(self.first[own] - begin, count) + np.arange(count.sum())]
            total = float(self.best[own].sum())
            close = gap[a:b]
            if b - a > n - 1 > 0:
                pick = np.argpartition(close, n - 2)[: n - 1]
            else:
                pick = np.arange(b - a)
            merged: list[tuple[float, tuple]] = [(0.0, ())]  # loss, and (first id, end, ids instead) of each word that differs
            for x in sorted(pick.tolist()) if n > 1 else ():
                if np.isfinite(close[x]):
                    s, f, e = starts[a + x], int(begin[x]), int(begin[x] + count[x])
                    found = self.v.segmentations(whole[s : s + lengths[a + x]], n, ids[f:e].tobytes())
                    sums = ((max(p, p + found[0][0] - q), (*c, (f, e, new)) if k else c) for p, c in merged for k, (q, new) in enumerate(found))
                    merged = heapq.nsmallest(n, sums, key=itemgetter(0))
            yield [_changed(ids, c) for _, c in merged], [total - p for p, _ in merged]


def _changed(ids: np.ndarray, changes: tuple) -> np.ndarray:
    """ids with the stretches (first, end, new) replaced, which stand in order."""
    parts, at = [], 0
    for first, end, new in changes:
        parts += [ids[at:first], new]
        at = end
    return np.concatenate([*parts, ids[at:]]) if changes else ids


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def encode(docs: DataFrame, path: str, keep: list[str], text_col: str = "text", n: int = 5, digest: bool = False) -> DataFrame:
    """keep, ids (of the best segmentation; with digest: ids_sha256 of them as 32-bit little-endian, instead), n_pieces,
    scores (of the n best, descending), other_ids (of ranks 2 to n; with digest: other_ids_sha256, one a rank, instead),
    round_trip (whether decoding each of the n gives the text back)."""
    text_batches(docs.sparkSession)
    names = results(keep, "ids_sha256" if digest else "ids", "n_pieces", "scores", "other_ids_sha256" if digest else "other_ids", "round_trip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(path)
        encoder = Encoder(v)
        texts_of = np.array([v.pieces[i].encode() if i not in v.byte else bytes([v.byte[i]]) for i in range(len(v.pieces))], object)
        for whole in batches:
            for i, j in slabs(raw(whole.column(len(keep)))[1], SLAB):  # small batches out, whatever comes in
                batch = whole.slice(i, j - i)
                texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
                best, others, counts, scores, same = [], [], [], [], []
                for t, (found, s) in zip(texts, encoder.encode(texts, n), strict=True):
                    counts.append(len(found[0]))
                    scores.append(s)
                    plain = t.replace(MARK, " ")
                    same.append(all(b"".join(texts_of[ids].tolist()).decode("utf-8", "replace").replace(MARK, " ")[1:] == plain for ids in found))
                    if digest:
                        found = [hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest() for ids in found]
                    best.append(found[0])
                    others.append(found[1:])
                if digest:
                    col, rest = pa.array(best, pa.string()), pa.array(others, pa.list_(pa.string()))
                else:
                    col, ends = _lists(best), np.cumsum([0, *map(len, others)]).astype(np.int32)
                    rest = pa.ListArray.from_arrays(pa.array(ends), _lists([ids for o in others for ids in o]))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(keep)], col, pa.array(counts, pa.int32()), pa.array(scores, pa.list_(pa.float64())), rest, pa.array(same, pa.bool_())],
                    names=[*keep, *names],
                )

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    kinds = ("string" if digest else "array<int>", "int", "array<double>", "array<string>" if digest else "array<array<int>>", "boolean")
    made = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text")).mapInArrow(lean(run), schema + made)


def decode(rows: DataFrame, path: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """keep and text, the text that ids stand for; null ids give null."""
    text_batches(rows.sparkSession)
    (name,) = results(keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(path)
        for batch in batches:
            out = [None if ids is None else v.decode(ids) for ids in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.string())], names=[*keep, name])

    schema = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids_col}`").alias("_ids")).mapInArrow(lean(run), f"{schema}`{name}` string")
