"""Exact nearest rows of a block of queries, in the Python workers.

One product of single-precision matrices says, within a bound on its error, which rows can be among a query's nearest;
the distances of these are then summed in double precision in the order in which ``vectors.distance`` sums them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Products held at a time, and pairs whose exact distances are taken at a time.
TILE, PAIRS = 4 << 20, 1 << 19


def matrix(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(lengths, values, starts) of an array of lists; the length is -1 where a list or one of its elements is null."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values, starts = column.flatten(), np.cumsum(lengths) - lengths
    known = ~column.is_null().to_numpy(zero_copy_only=False)
    if values.null_count:
        holes = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
        known &= holes[starts + lengths] == holes[starts]
    return np.where(known, lengths, -1), values, starts


def rows_of(values: pa.Array, starts: np.ndarray, length: int) -> np.ndarray:
    """The lists that begin at ``starts``, all of one length, as a matrix."""
    flat = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat[starts[:, None] + np.arange(length)]


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of matching rows, summed from the first place on."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def places(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of the ids, equal for equal ids."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


class Nearest:
    """The k nearest rows so far of each of some queries of one length; by distance, then by id, unknown distances last."""

    def __init__(self, queries: np.ndarray, k: np.ndarray, space: str, threshold: float | None, length: int, codes: np.ndarray | None = None):
        self.queries, self.k, self.space, self.threshold, self.length, self.codes = queries, k, space, threshold, length, codes
        self.most = int(k.max(initial=0))
        with np.errstate(over="ignore", invalid="ignore"):
            self.norms = np.sqrt(dots(queries, queries))
        self.bound = np.full(len(queries), np.inf if threshold is None else threshold)  # no further row can count
        self.full = np.zeros(len(queries), bool)
        self.q, self.d, self.ids, self.unknown = np.zeros(0, np.int64), np.zeros(0), None, None

    def add(self, ids: pa.Array, lengths: np.ndarray, values: pa.Array, starts: np.ndarray, codes: np.ndarray | None = None) -> None:
        known = lengths == self.length
        at = np.flatnonzero(known)
        v = rows_of(values, starts[at], self.length) if self.length >= 0 else np.zeros((0, 0))
        with np.errstate(all="ignore"):
            norms = np.sqrt(dots(v, v))
            if self.space == "cosine":  # no angle with a zero vector
                known[at[norms == 0]] = False
                at, v, norms = at[norms != 0], v[norms != 0], norms[norms != 0]
            if self.threshold is None and not known.all():
                self._keep_unknown(ids.take(pa.array(np.flatnonzero(~known))))
            if len(at) and self.most > 0:
                self._near(ids.take(pa.array(at)), v, norms, None if codes is None else codes[at])

    def _keep_unknown(self, ids: pa.Array) -> None:
        ids = ids if self.unknown is None else pa.concat_arrays([self.unknown, ids])
        self.unknown = ids.take(pa.array(np.argsort(places(ids), kind="stable")[: self.most]))

    def _near(self, ids: pa.Array, v: np.ndarray, norms: np.ndarray, codes: np.ndarray | None) -> None:
        """Products s grow as distances d fall: s = (shift - d) * scale of a query, with vectors of at most length 1 (l2: the root of 2)."""
        odd = np.flatnonzero(~np.isfinite(norms))  # always looked at
        top = float(norms[np.isfinite(norms)].max(initial=0.0)) or 1.0
        length = np.where(self.norms == 0, 1.0, self.norms)
        if self.space == "cosine":
            right, left, shift, scale = v / norms[:, None], self.queries / length[:, None], np.ones(len(length)), np.ones(len(length))
        elif self.space == "ip":
            right, left, shift, scale = v / top, self.queries / length[:, None], np.ones(len(length)), 1 / (length * top)
        else:
            wide = np.sqrt(self.norms**2 + 0.25 * top * top)
            right = np.column_stack([v / top, (norms / top) ** 2])
            left = np.column_stack([self.queries, np.full(len(length), -0.5 * top)]) / wide[:, None]
            shift, scale = self.norms**2, 1 / (2 * top * wide)
        right[odd] = 0
        right, left = np.ascontiguousarray(right.T, np.float32), left.astype(np.float32)
        slack = (self.length + 5) * 1.5 * 2.0**-23
        many = len(ids)
        step = max(1, TILE // many)
        found = []
        for begin in range(0, len(length), step):
            part = slice(begin, begin + step)
            s = left[part] @ right
            s[:, odd] = -np.inf
            loose = slack + 1e-14 * (np.abs(shift[part]) + np.abs(np.where(np.isfinite(self.bound[part]), self.bound[part], 0.0))) * scale[part]
            least = (shift[part] - self.bound[part]) * scale[part] - loose
            open_ = np.flatnonzero(~self.full[part])
            if len(open_) and many > self.most:  # at most k rows of this batch count
                t = s[open_]
                if codes is not None:
                    t = np.where(_meet(self.codes[part][open_][:, None], codes[None]), t, -np.inf)
                kth = np.partition(t, many - self.most, axis=1)[:, many - self.most] - 2 * slack
                least[open_] = np.fmax(least[open_], kth)
            near = ~(s < least[:, None])  # what can't be compared is looked at
            near[:, odd] = True
            hit = np.flatnonzero(near)
            for k in range(0, len(hit), PAIRS):
                qi, vi = np.divmod(hit[k : k + PAIRS], many)
                qi += begin
                if codes is not None:
                    meet = _meet(self.codes[qi], codes[vi])
                    qi, vi = qi[meet], vi[meet]
                d = self._distances(qi, vi, v, norms)
                keep = d <= self.threshold if self.threshold is not None else np.ones(len(d), bool)
                keep &= ~(d > self.bound[qi])
                found.append((qi[keep], d[keep], vi[keep]))
        if any(len(x[0]) for x in found):
            q, d, vi = (np.concatenate(x) for x in zip(*found))
            self._merge(q, d, ids.take(pa.array(vi)))

    def _distances(self, qi: np.ndarray, vi: np.ndarray, v: np.ndarray, norms: np.ndarray) -> np.ndarray:
        out = np.zeros(len(qi))
        for d in range(self.length):
            x, y = v[vi, d], self.queries[qi, d]
            out += (x - y) * (x - y) if self.space == "l2" else x * y
        return out if self.space == "l2" else 1 - out if self.space == "ip" else 1 - out / (norms[vi] * self.norms[qi])

    def _merge(self, q: np.ndarray, d: np.ndarray, ids: pa.Array) -> None:
        if self.ids is not None:
            q, d, ids = np.concatenate([self.q, q]), np.concatenate([self.d, d]), pa.concat_arrays([self.ids, ids])
        order = np.lexsort((places(ids), d, q))
        begin = np.searchsorted(q[order], np.arange(len(self.k)))
        order = order[np.arange(len(order)) - begin[q[order]] < self.k[q[order]]]
        self.q, self.d, self.ids = q[order], d[order], ids.take(pa.array(order))
        count = np.bincount(self.q, minlength=len(self.k))
        self.full = count >= self.k
        last = np.cumsum(count) - 1
        some = self.full & (self.k > 0)
        self.bound[some] = self.d[last[some]]
        self.bound[self.k <= 0] = -np.inf

    def found(self) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(number of the query, id, distance)"""
        q, d, ids = self.q, pa.array(self.d), self.ids
        if self.unknown is not None:
            lack = np.clip(self.k - np.bincount(self.q, minlength=len(self.k)), 0, len(self.unknown))
            more = np.repeat(np.arange(len(self.k)), lack)
            place = np.arange(len(more)) - np.repeat(np.cumsum(lack) - lack, lack)
            rest = self.unknown.take(pa.array(place))
            ids = rest if ids is None else pa.concat_arrays([ids, rest])
            q, d = np.concatenate([q, more]), pa.concat_arrays([d, pa.nulls(len(more), pa.float64())])
        return q, ids, d


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two rows have one of their codes, by place, in common."""
    out = a[..., 0] == b[..., 0]
    for k in range(1, a.shape[-1]):
        out |= a[..., k] == b[..., k]
    return out


def searches(queries: pa.Table, space: str, threshold: float | None) -> list[tuple[np.ndarray, Nearest]]:
    """Of queries (query_id, q, k and maybe h: codes): for each length of vectors the numbers of the queries, and their search."""
    lengths, values, starts = matrix(queries.column("q").combine_chunks())
    k = queries.column("k").fill_null(0).to_numpy().astype(np.int64)
    codes = stacked(queries.column("h").combine_chunks()) if "h" in queries.column_names else None
    zero = lengths >= 0
    if space == "cosine":  # a zero vector has no angle with any
        zero = np.array([n > 0 and bool(np.any(rows_of(values, starts[i : i + 1], n))) for i, n in enumerate(lengths)], bool)
    lengths = np.where(zero, lengths, -1)
    out = []
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        v = rows_of(values, starts[at], int(n)) if n >= 0 else np.zeros((len(at), 0))
        out.append((at, Nearest(v, k[at], space, threshold, int(n), None if codes is None else codes[at])))
    return out


def stacked(column: pa.Array) -> np.ndarray:
    """Lists of one length and without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scan(batches: Iterator[pa.RecordBatch], queries: pa.Table, space: str, threshold: float | None) -> Iterator[pa.RecordBatch]:
    """Rows (id, v and maybe h) to the nearest of them: (query_id, id, distance, k)."""
    parts = searches(queries, space, threshold)
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths, values, starts = matrix(batch.column("v"))
        codes = stacked(batch.column("h")) if "h" in queries.column_names else None
        for _, part in parts:
            part.add(batch.column("id"), lengths, values, starts, codes)
    for at, part in parts:
        q, ids, d = part.found()
        if len(q):
            of = queries.take(pa.array(at[q]))
            chosen = pa.table({"query_id": of.column("query_id"), "id": ids, "distance": d, "k": of.column("k")})
            yield from chosen.to_batches(max_chunksize=10_000)
