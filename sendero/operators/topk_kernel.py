"""Best k items of each query of one group by cosine, in numpy.

Similarities are first taken in float32, in tiles that stay in a core's cache.
Their error has a bound, so whatever may be among the k best is known from
them; only that is computed again in float64, and ranked by it.

Of a tile the largest values of columns that lie far apart are taken (a fold);
the k-th of those and of the best so far is a bar that at least k items reach,
and only folds above it are looked into.
"""

from __future__ import annotations

import numpy as np

TILE_ROWS, TILE_COLUMNS = 256, 2048
# Candidates of a chunk of queries that are held before they are ranked.
_HELD = 400_000
# Pairs whose vectors are gathered at a time, so that they stay in the cache.
_GATHERED = 1024
# A share of the pairs of some queries and items from which all of them are
# computed instead: it takes a fourth of the time of a gathered pair.
_DENSE = 0.3
_NONE = np.float32(-np.inf)


def _select_topk(S: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best k columns per row of S ordered by (value desc, column asc)."""
    n_rows, n_cols = S.shape
    k = min(k, n_cols)
    if k == n_cols:
        chosen = np.broadcast_to(np.arange(n_cols), (n_rows, n_cols))
    else:
        # The best k + 1, in any order; where the last two of them are equal,
        # the first columns among the equal ones are taken instead.
        best = np.argpartition(S, n_cols - k - 1, axis=1)[:, n_cols - k - 1:]
        values = np.take_along_axis(S, best, 1)
        chosen = np.take_along_axis(best, np.argsort(-values, axis=1, kind="stable"), 1)
        kth = np.take_along_axis(S, chosen[:, k - 1:], 1)
        tied = np.flatnonzero(kth[:, 0] == kth[:, 1])
        chosen = np.sort(chosen[:, :k], axis=1)
        if len(tied):
            T, bar = S[tied], kth[tied, :1]
            above, equal = T > bar, T == bar
            free = k - above.sum(axis=1, keepdims=True)
            chosen[tied] = np.nonzero(above | (equal & (equal.cumsum(axis=1) <= free)))[1].reshape(len(tied), k)
    values = np.take_along_axis(S, chosen, 1)
    order = np.argsort(-values, axis=1, kind="stable")
    return np.take_along_axis(chosen, order, 1), np.take_along_axis(values, order, 1)


class Side:
    """Rows of one side: as given, their norms and float32 unit rows.  Zero
    vectors, and those with other than finite cells, have no direction."""

    def __init__(self, rows: np.ndarray):
        self.rows = np.ascontiguousarray(rows)
        self.norm = np.empty(len(rows))
        self.unit = np.empty(rows.shape, np.float32)
        for lo in range(0, len(rows), 8192):
            x = self.rows[lo:lo + 8192].astype(np.float64)
            with np.errstate(invalid="ignore", over="ignore"):
                norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            norm[~np.isfinite(norm)] = 0.0
            self.norm[lo:lo + 8192] = norm
            x[norm == 0] = 0.0
            self.unit[lo:lo + 8192] = x / np.where(norm > 0, norm, 1.0)[:, None]

    def __len__(self) -> int:
        return len(self.rows)


def error(dim: int) -> float:
    """More than rounding in float32 takes from a similarity of unit rows or
    adds to it: two roundings of the cells and ``dim`` of the sum, doubled."""
    return (dim + 8) * 2.0 ** -23


def _fold(S: np.ndarray, k: int, space: np.ndarray) -> tuple[np.ndarray, int]:
    """(M, g): M[:, j] is the largest of S[:, j], S[:, j + w], ... of which
    there are g.  S is padded to whole folds by its maker; ``space`` has room
    for half of it."""
    g, w = folds(S.shape[1], k), S.shape[1]
    if g == 1:
        return S, 1
    M = np.maximum(S[:, :w // 2], S[:, w // 2:], out=space[:len(S) * (w // 2)].reshape(len(S), w // 2))
    w //= 2
    while w > S.shape[1] // g:
        w //= 2
        np.maximum(M[:, :w], M[:, w:2 * w], out=M[:, :w])
    return M[:, :w], g


def folds(columns: int, k: int) -> int:
    """How many columns share a fold: a power of two of at most 32, with four
    folds for each of the k."""
    g = 32
    while g > 1 and (columns % g or columns // g < 4 * k):
        g //= 2
    return g


class _Chunk:
    """The search of some queries: what they have found so far."""

    def __init__(self, Q: Side, lo: int, hi: int, items: Side, order: np.ndarray, k: int, kth: np.ndarray | None):
        self.Q, self.lo, self.items, self.order, self.k = Q, lo, items, order, k
        self.unit = Q.unit[lo:hi]
        n = hi - lo
        self.slack = np.float32(2 * error(Q.rows.shape[1]))
        self.best = np.full((n, k), _NONE)
        self.bar = np.full(n, _NONE) if kth is None else (kth[lo:hi] - error(Q.rows.shape[1])).astype(np.float32)
        # A query without a direction finds nothing.
        self.bar[Q.norm[lo:hi] == 0] = np.inf
        self.held, self.n_held = [], 0
        self.done = None

    def take(self, rows: np.ndarray, S: np.ndarray, column: int, space: np.ndarray) -> None:
        """Candidates among the similarities S of the chunk's rows with the
        items from ``column`` on; -inf is none."""
        M, g = _fold(S, self.k, space)
        hit = np.flatnonzero((M >= (self.bar[rows] - self.slack)[:, None]).any(axis=1) & (self.bar[rows] < np.inf))
        if not len(hit):
            return
        some = rows[hit]
        M = M[hit]
        self.best[some] = best = np.partition(np.concatenate([self.best[some], M], axis=1), M.shape[1], axis=1)[:, M.shape[1]:]
        self.bar[some] = bar = np.maximum(self.bar[some], best.min(axis=1))
        low = bar - self.slack
        at, j = np.nonzero(M >= np.where(np.isfinite(low), low, np.finfo(np.float32).min)[:, None])
        cells = S.reshape(len(rows), g, -1)[hit[at], :, j]
        pair, m = np.nonzero(cells >= np.where(np.isfinite(low), low, np.finfo(np.float32).min)[at, None])
        at = at[pair]
        found = column + j[pair] + m * (S.shape[1] // g)
        self.held.append((some[at], found, cells[pair, m]))
        self.n_held += len(at)
        if self.n_held > _HELD:
            self._rank()

    def _similar(self, row: np.ndarray, item: np.ndarray) -> np.ndarray:
        out = np.empty(len(row))
        Q, P = self.Q, self.items
        for a in range(0, len(row), _GATHERED):
            r, c = row[a:a + _GATHERED] + self.lo, item[a:a + _GATHERED]
            dot = np.einsum("ij,ij->i", Q.rows[r].astype(np.float64), P.rows[c].astype(np.float64))
            out[a:a + _GATHERED] = dot / (Q.norm[r] * P.norm[c])
        return out

    def _nearest_of(self, row: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs and their similarities; where many queries share many items
        (equal ones, say), the k best of each query."""
        rows, items = (np.flatnonzero(np.bincount(x)) for x in (row, item))
        if len(row) < _DENSE * len(rows) * len(items) or len(items) <= self.k:
            return row, item, self._similar(row, item)
        items = items[np.argsort(self.order[items])]
        column = np.empty(len(self.items), np.int64)
        column[items] = np.arange(len(items))
        Q, P = self.Q, self.items
        # Sums the cells in the order in which pairs alone do.
        S = np.einsum("ij,kj->ik", Q.rows[rows + self.lo].astype(np.float64), P.rows[items].astype(np.float64))
        S /= Q.norm[rows + self.lo, None] * P.norm[None, items]
        given = np.zeros(S.shape, bool)
        given[np.searchsorted(rows, row), column[item]] = True
        S[~given] = -np.inf
        at, sim = _select_topk(S, self.k)
        r, j = np.nonzero(sim > -np.inf)
        return rows[r], items[at[r, j]], sim[r, j]

    def _keep(self, row: np.ndarray, item: np.ndarray, sim: np.ndarray) -> None:
        """The k best of these and of those kept before."""
        if self.done is not None:
            row, item, sim = (np.concatenate(both) for both in zip(self.done, (row, item, sim)))
        by = np.lexsort((self.order[item], -sim, row))
        row = row[by]
        first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.empty(0, bool)
        rank = np.arange(len(row)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(row) else np.empty(0, np.int64)
        near = rank < self.k
        self.done, self.rank = (row[near], item[by][near], sim[by][near]), rank[near] + 1

    def _rank(self) -> None:
        row, item, value = (np.concatenate(x) for x in zip(*self.held))
        near = value >= self.bar[row] - self.slack
        row, item = row[near], item[near]
        if len(row):
            self._keep(*self._nearest_of(row, item))
        self.held, self.n_held = [], 0

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, similarity, rank), by query and rank."""
        if self.held:
            self._rank()
        if self.done is None:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int32)
        row, item, sim = self.done
        return row + self.lo, item, sim, self.rank.astype(np.int32)


class _Masked:
    """Excluded pairs by chunk and column."""

    def __init__(self, ex_q: np.ndarray, ex_i: np.ndarray, step: int):
        chunk = ex_q // step
        by = np.lexsort((ex_i, chunk))
        self.q, self.i, self.chunk = ex_q[by], ex_i[by], chunk[by]
        self.step = step

    def of(self, lo: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.chunk, [lo // self.step, lo // self.step + 1])
        return self.q[a:b] - lo, self.i[a:b]


def _tiles(ends: np.ndarray) -> list[tuple[int, int]]:
    """Runs of pieces, each of at most TILE_COLUMNS columns in all."""
    out, first, start = [], 0, 0
    for piece, end in enumerate(ends):
        if end - start > TILE_COLUMNS and piece > first:
            out.append((first, piece))
            first, start = piece, int(ends[piece - 1])
    return [*out, (first, len(ends))] if len(ends) else out


def nearest(Q: Side, items: Side, order: np.ndarray, k: int, ex_q: np.ndarray, ex_i: np.ndarray, *,
            sizes: np.ndarray | None = None, bounds=None, kth: np.ndarray | None = None,
            rounds: tuple[int, ...] = (), wide: float = 1.0):
    """For chunks of queries (query, item, similarity, rank, pairs compared).

    ``order`` ranks items whose similarities are equal; pairs (ex_q, ex_i) are
    no candidates.  With ``bounds`` the items are blocks of ``sizes`` rows one
    after another, and ``bounds(lo, hi)`` gives what a member of each block can
    have at most with the queries lo to hi: first each query visits the blocks
    of highest bound (the first of ``rounds``; later rounds for those queries
    that have at most the share ``wide`` of the items before them), then all
    blocks that its k-th similarity doesn't beat.  ``kth`` is what a query has
    elsewhere already."""
    n = len(items)
    if sizes is None:
        sizes = np.array([n])
    # Blocks longer than a tile are visited in pieces.
    pieces = -(-sizes // TILE_COLUMNS)
    of = np.repeat(np.arange(len(sizes)), pieces)
    width = np.full(len(of), TILE_COLUMNS)
    last = np.cumsum(pieces) - 1
    width[last] = sizes - (pieces - 1) * TILE_COLUMNS
    ends = np.cumsum(width)
    starts = ends - width
    tiles = _tiles(ends)
    step = min(max(TILE_ROWS, TILE_ROWS * TILE_COLUMNS // max(n, 1)), 4096)
    most = max((int(ends[b - 1] - starts[a]) for a, b in tiles), default=0) + 31
    space, half = np.empty(step * most, np.float32), np.empty(step * (most // 2 + 1), np.float32)
    masked = _Masked(ex_q, ex_i, step)
    nowhere = np.flatnonzero(items.norm == 0)
    for lo in range(0, len(Q), step):
        hi = min(lo + step, len(Q))
        chunk = _Chunk(Q, lo, hi, items, order, k, kth)
        mq, mi = masked.of(lo)
        bound = None if bounds is None else bounds(lo, hi)[:, of] + error(Q.rows.shape[1])
        seen = np.zeros((hi - lo, len(of)), bool)

        def visit(tile: tuple[int, int], open_: np.ndarray) -> None:
            first, end = tile
            rows = np.flatnonzero(open_.any(axis=1))
            if not len(rows):
                return
            a, b = int(starts[first]), int(ends[end - 1])
            padded = b - a if b - a < 64 else -(-(b - a) // 32) * 32
            S = space[:len(rows) * padded].reshape(len(rows), padded)
            S[:, b - a:] = _NONE
            whole = len(rows) == hi - lo
            unit = chunk.unit if whole else chunk.unit[rows]
            mine, before = open_[rows], seen[rows, first:end]
            if mine.mean() > 0.5:
                np.matmul(unit, items.unit[a:b].T, out=S[:, :b - a])
                for p in np.flatnonzero(before.any(axis=0)):
                    S[before[:, p], starts[first + p] - a:ends[first + p] - a] = _NONE
                seen[rows, first:end] = True
            else:
                S[:, :b - a] = _NONE
                for p in np.flatnonzero(mine.any(axis=0)):
                    x, y, here = int(starts[first + p]), int(ends[first + p]), np.flatnonzero(mine[:, p])
                    S[here, x - a:y - a] = unit[here] @ items.unit[x:y].T
                seen[rows, first:end] |= mine
            if len(nowhere):
                S[:, nowhere[slice(*np.searchsorted(nowhere, [a, b]))] - a] = _NONE
            if len(mi):
                out = slice(*np.searchsorted(mi, [a, b]))
                q, i = mq[out], mi[out] - a
                if not whole and len(q):
                    place = np.full(hi - lo, -1)
                    place[rows] = np.arange(len(rows))
                    q, i = place[q][place[q] >= 0], i[place[q] >= 0]
                S[q, i] = _NONE
            chunk.take(rows, S, a, half)

        if bound is None:
            for tile in tiles:
                visit(tile, np.ones((hi - lo, tile[1] - tile[0]), bool))
        else:
            for turn, upto in enumerate(rounds):
                if upto >= len(of):
                    break
                near = np.argpartition(-bound, upto - 1, axis=1)[:, :upto]
                want = np.zeros_like(seen)
                np.put_along_axis(want, near, True, axis=1)
                want &= ~seen & (bound >= (chunk.bar - chunk.slack)[:, None])
                if turn:
                    left = ((bound >= (chunk.bar - chunk.slack)[:, None]) & ~seen) @ width
                    want[left > wide * n] = False
                for tile in tiles:
                    visit(tile, want[:, tile[0]:tile[1]])
            highest = [bound[:, a:b].max() for a, b in tiles]
            for t in np.argsort(-np.array(highest), kind="stable"):
                a, b = tiles[t]
                visit(tiles[t], (bound[:, a:b] >= (chunk.bar - chunk.slack)[:, None]) & ~seen[:, a:b])
        yield (*chunk.result(), int((seen @ width).sum()))
