"""Blocks of names against blocks of names, in numpy: the best right names of each left one by Indel ratio or by cosine.

Right names come in the order in which ties are broken. Results are exact: bounds only leave out pairs that cannot count, and no
more pairs are held at once than a tile has. The number of pairs compared by bounds still grows with the square of a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.similarity import lcs_length

#: Left and right names in a tile; letters with a bound of their own, buckets for the others, copies of a letter told apart;
#: words of 64 bits up to which the longest common subsequences of many pairs are computed side by side.
ROWS, COLS = 256, 8192
OWN, SHARED, COPIES = 64, 32, 8
WORDS = 16
BATCH = 1 << 16
#: Left vectors and their terms that are looked up together; pairs that are met, terms of right vectors that are added up
#: together; the first bound, and its steps.
QUERIES, ITEMS, PAIRS, ADDED = 256, 8192, 1 << 17, 1 << 20
FIRST, FALL = 0.8, 0.8


def rising(ids: pa.ChunkedArray) -> np.ndarray:
    """The order of ids, as Spark sorts them (nulls first); structs by their fields."""

    def flat(column: pa.ChunkedArray) -> list[pa.ChunkedArray]:
        if not pa.types.is_struct(column.type):
            return [column]
        return [pc.is_valid(column), *(x for c in column.flatten() for x in flat(c))]

    columns = flat(ids)
    table = pa.table(columns, names=[str(i) for i in range(len(columns))])
    return pc.sort_indices(table, sort_keys=[(n, "ascending") for n in table.column_names], null_placement="at_start").to_numpy()


def firsts(row: np.ndarray, col: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Which of (row, col, score) are the first n of their row by falling score and rising col."""
    order = np.lexsort((col, -score, row))
    of = row[order]
    new = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
    place = np.arange(len(of)) - np.repeat(new, np.diff(np.append(new, len(of))))
    return order[place < n]


class _Texts:
    """Names as runs of letters by number, with their letter counts in unary (up to COPIES, the rest as a sum)."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, bucket: np.ndarray):
        self.codes, self.sizes = codes, sizes
        self.starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        width = OWN + SHARED
        counts = np.zeros((len(sizes), width), np.int32)
        np.add.at(counts, (np.repeat(np.arange(len(sizes)), sizes), bucket[codes]), 1)
        self.unary = np.concatenate([counts > k for k in range(COPIES)], 1)
        self.over = np.maximum(counts - COPIES, 0).sum(1).astype(np.float32)


def _texts(left: list[str], right: list[str]) -> tuple[_Texts, _Texts, int]:
    both = [np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.uint32) for x in (left, right)]
    alphabet, codes, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    place = np.empty(len(alphabet), np.int64)
    place[np.argsort(-times, kind="stable")] = np.arange(len(alphabet))
    bucket = np.where(place < OWN, place, OWN + place % SHARED)
    sizes = [np.array([len(t) for t in x], np.int64) for x in (left, right)]
    cut = len(both[0])
    return _Texts(codes[:cut], sizes[0], bucket), _Texts(codes[cut:], sizes[1], bucket), len(alphabet)


def _lcs(a: _Texts, b: _Texts, letters: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs (i, j), bit-parallel, of left names of up to 64 * WORDS letters (few
    different ones: each has a mask for every letter)."""
    rows, words = np.unique(i), -(-int(a.sizes[i].max()) // 64)
    masks = np.zeros((words, len(rows), letters), np.uint64)
    sizes = a.sizes[rows]
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    codes = a.codes[np.repeat(a.starts[rows], sizes) + at]
    np.bitwise_or.at(masks, (at // 64, np.repeat(np.arange(len(rows)), sizes), codes), np.uint64(1) << (at % 64).astype(np.uint64))
    masks = masks.reshape(words, -1)
    out = np.empty(len(i), np.int64)
    falling = np.argsort(-b.sizes[j], kind="stable")
    for begin in range(0, len(i), BATCH):
        take = falling[begin : begin + BATCH]
        row, start, size = np.searchsorted(rows, i[take]) * letters, b.starts[j[take]], b.sizes[j[take]]
        state = np.full((words, len(take)), np.iinfo(np.uint64).max, np.uint64)
        for k in range(int(size[0])):
            live = int(np.searchsorted(-size, -k, "left"))  # sizes fall
            at = row[:live] + b.codes[start[:live] + k]
            carry = None
            for w in range(words):
                s, m = state[w, :live], masks[w][at]
                total = s + (s & m)
                if w + 1 < words:
                    over = total < s
                if carry is not None:
                    total = total + carry
                    if w + 1 < words:
                        over |= total < carry
                if w + 1 < words:
                    carry = over.astype(np.uint64)
                state[w, :live] = total | (s & ~m)
        left = a.sizes[i[take]]
        found = np.zeros(len(take), np.int64)
        for w in range(words):
            used = np.clip(left - 64 * w, 0, 64).astype(np.uint64)
            low = np.where(used == 64, np.iinfo(np.uint64).max, (np.uint64(1) << (used % np.uint64(64))) - np.uint64(1))
            found += np.bitwise_count(~state[w] & low).astype(np.int64)
        out[take] = found
    return out


def best_ratios(left: list[str], right: list[str], threshold: float, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, score) of the n best right names of each left name, by place; equal scores by place. Two names have no more
    letters in common, one below the other, than they have at all, which is a product of matrices."""
    if not left or not right:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b, letters = _texts(left, right)
    used = a.unary.any(0) & b.unary.any(0)
    x, y = a.unary[:, used].astype(np.float32), b.unary[:, used].astype(np.float32)
    # what two names must have in common, a little less for rounding
    need = [(t.sizes * (threshold / 200 * (1 - 1e-6)) - 0.01).astype(np.float32) for t in (a, b)]
    over = bool(a.over.any() and b.over.any())
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for first in range(0, len(left), ROWS):
        rows = slice(first, first + ROWS)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for second in range(0, len(right), COLS):
            cols = slice(second, second + COLS)
            common = x[rows] @ y[cols].T
            if over:
                common += np.minimum(a.over[rows][:, None], b.over[cols][None, :])
            common -= need[1][cols]
            i, j = np.nonzero(common >= need[0][rows][:, None])
            if not len(i):
                continue
            i, j = i + first, j + second
            lcs, short = np.empty(len(i), np.int64), a.sizes[i] <= 64 * WORDS
            if short.any():
                lcs[short] = _lcs(a, b, letters, i[short], j[short])
            for k in np.flatnonzero(~short):
                lcs[k] = lcs_length(left[i[k]], right[j[k]])
            score = 200.0 * lcs / (a.sizes[i] + b.sizes[j])
            ok = score >= threshold
            best = tuple(np.concatenate(p) for p in zip(best, (i[ok], j[ok], score[ok]), strict=True))
            keep = firsts(*best, n)
            best = tuple(p[keep] for p in best)
        kept.append(best)
    return tuple(np.concatenate(p) for p in zip(*kept, strict=True))


def _lists(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All items end to end, and where each list begins (one more entry: the end)."""
    sizes = pc.list_value_length(column).to_numpy().astype(np.int64)
    return pc.list_flatten(column).to_numpy().astype(kind), np.concatenate(([0], np.cumsum(sizes)))


class _Postings:
    """Right vectors by term; those of a term by falling length of what is left of them from that term on."""

    def __init__(self, right: pa.Table):
        terms, self.begins = _lists(right["terms"], "int64")
        self.weights = _lists(right["weights"], "float64")[0]
        self.sizes, self.total = np.diff(self.begins), len(self.begins) - 1
        self.known, self.terms = np.unique(terms, return_inverse=True)
        rest, after = _rests(self.weights, self.begins)
        order = np.lexsort((-rest, self.terms))
        self.row, self.weight, self.after = np.repeat(np.arange(self.total), self.sizes)[order], self.weights[order], after[order]
        self.longest = float(rest.max()) if len(rest) else 1.0
        self.key = self.terms[order] + 0.5 - 0.5 / self.longest * rest[order]
        self.start = np.searchsorted(self.terms[order], np.arange(len(self.known) + 1))

    def reach(self, terms: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each term the end of its postings with least or more left (a few more, for rounding)."""
        at = np.searchsorted(self.key, terms + 0.5 - 0.5 / self.longest * np.minimum(least, 2 * self.longest) + 1e-9, "right")
        return np.clip(at, self.start[terms], self.start[terms + 1])


def _rests(weights: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item of a vector the length of the vector from it on, and behind it: never less than it is."""
    sums = np.concatenate(([0.0], np.cumsum(weights * weights)))
    whole = np.repeat(sums[begins[1:]], np.diff(begins))
    return np.sqrt(np.maximum(whole - sums[:-1], 0) + 1e-9), np.sqrt(np.maximum(whole - sums[1:], 0) + 1e-9)


def best_cosines(left: pa.Table, right: pa.Table, threshold: float, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, score) of the n best right vectors of each left one, by place, from threshold on (rounded to six digits);
    equal scores by place. Vectors have unit length at most: `terms` by rising frequency and `weights`.

    Two vectors are worth no more than the product of what is left of both from the first term that they share: right vectors
    are scored where that product reaches a bound, which falls by steps until it is the threshold or the n-th best so far."""
    (lt, la), lw = _lists(left["terms"], "int64"), _lists(left["weights"], "float64")[0]
    posts = _Postings(right)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(posts.known) and len(lt):
        place = np.minimum(np.searchsorted(posts.known, lt), len(posts.known) - 1)
        there = posts.known[place] == lt
        row, terms, lw = np.repeat(np.arange(len(la) - 1), np.diff(la))[there], place[there], lw[there]
        la = np.searchsorted(row, np.arange(len(la)))
        first = 0
        while first < len(la) - 1:
            last = min(first + QUERIES, max(first + 1, int(np.searchsorted(la, la[first] + ITEMS, "right")) - 1), len(la) - 1)
            here = slice(la[first], la[last])
            if la[last] > la[first]:
                i, j, score = _nearest(la[first : last + 1] - la[first], terms[here], lw[here], posts, threshold - 1e-6, n)
                kept.append((i + first, j, score))
            first = last
    return tuple(np.concatenate(p) for p in zip(*kept, strict=True))


def _nearest(begins: np.ndarray, terms: np.ndarray, weights: np.ndarray, posts: _Postings, least: float, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """best_cosines of a few left vectors."""
    count = len(begins) - 1
    row = np.repeat(np.arange(count), np.diff(begins))
    rest, after = _rests(weights, begins)
    own, column = np.unique(terms, return_inverse=True)
    width = len(own) + 1
    query = np.zeros((count, width))
    query[row, column + 1] = weights
    query = query.ravel()
    columns = np.zeros(len(posts.known), np.int64)
    columns[own] = np.arange(1, width)
    bound, done = np.full(count, least), posts.start[terms]
    i, j, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    open_, level = np.bincount(row, minlength=count) > 0, FIRST

    def scored(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        sizes = posts.sizes[c]
        ends = np.cumsum(sizes)
        items = np.repeat(posts.begins[c] - ends + sizes, sizes) + np.arange(ends[-1])
        return np.add.reduceat(query[np.repeat(r * width, sizes) + columns[posts.terms[items]]] * posts.weights[items], ends - sizes)

    while open_.any():
        wanted = np.maximum(bound, level if level > max(least, 0.01) else least)
        items = np.flatnonzero(open_[row])
        ends = np.maximum(posts.reach(terms[items], wanted[row[items]] / rest[items]), done[items])
        counts = ends - done[items]
        upto = np.cumsum(counts)
        found = [(i, j, score)]
        for begin in range(0, int(upto[-1]), PAIRS):
            at = np.arange(begin, min(begin + PAIRS, int(upto[-1])))
            of = np.searchsorted(upto, at, "right")
            item, post = items[of], ends[of] - upto[of] + at
            worth = weights[item] * posts.weight[post] + after[item] * posts.after[post]
            good = worth >= bound[row[item]]
            r, c = row[item[good]], posts.row[post[good]]
            if not len(r):
                continue
            for part in np.split(np.arange(len(r)), np.flatnonzero(np.diff(np.cumsum(posts.sizes[c]) // ADDED)) + 1):
                value = scored(r[part], c[part])
                part, value = part[value >= bound[r[part]]], value[value >= bound[r[part]]]
                found.append((r[part], c[part], value))
        done[items] = ends
        i, j, score = (np.concatenate(p) for p in zip(*found, strict=True))
        once = np.unique(i * posts.total + j, return_index=True)[1]  # found by every term that they share
        once = once[firsts(i[once], j[once], np.floor(score[once] * 1e6 + 0.5), n)]
        i, j, score = i[once], j[once], score[once]
        full = np.flatnonzero(np.bincount(i, minlength=count) >= n)
        lowest = np.full(count, np.inf)
        np.minimum.at(lowest, i, score)
        bound[full] = np.maximum(bound[full], lowest[full] - 2e-6)
        open_ &= wanted > bound
        level *= FALL
    return i, j, score
