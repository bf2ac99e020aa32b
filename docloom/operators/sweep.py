"""What stands next in the way of many boxes of a page, by a sweep line: n log n steps for n boxes and obstacles.

Boxes and obstacles are stretches [low, high] across the direction of the sweep, in whole cells; obstacles reach from
`near` to `far` along it. The sweep keeps a ridge: for every place across, the greatest value of the obstacles passed.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NOTHING = -(2**62)
FREE = 2**31 - 1
#: Pairs of a page's boxes and obstacles up to which they are looked at all at once.
MATRIX = 1 << 14
#: Pairs of such pages that are looked at in one go.
PAIRS = 1 << 18


class Ridge:
    """Greatest values over places 0 to n - 1, raised and asked by ranges, in a tree whose nodes cover halves."""

    def __init__(self, n: int):
        self.n = max(n, 1)
        self.whole = [NOTHING] * (2 * self.n)  # what was raised over all of a node
        self.best = [NOTHING] * (2 * self.n)  # the greatest within a node

    def _nodes(self, low: int, high: int):
        left, right = low + self.n, high + self.n + 1
        while left < right:
            if left & 1:
                yield left
                left += 1
            if right & 1:
                right -= 1
                yield right
            left, right = left >> 1, right >> 1

    def lift(self, low: int, high: int, value: int) -> None:
        for node in self._nodes(low, high):
            self.whole[node], self.best[node] = max(self.whole[node], value), max(self.best[node], value)
        for node in (low + self.n, high + self.n):
            while node > 1:
                node >>= 1
                self.best[node] = max(self.whole[node], self.best[2 * node], self.best[2 * node + 1])

    def top(self, low: int, high: int) -> int:
        found = max((self.best[node] for node in self._nodes(low, high)), default=NOTHING)
        for node in (low + self.n, high + self.n):
            while node > 1:
                node >>= 1
                found = max(found, self.whole[node])
        return found


def first_ahead(asked: list[tuple[int, int, int]], obstacles: list[tuple[int, int, int, int]]) -> list[int | None]:
    """asked (low, high, start), obstacles (low, high, near, far) -> the first cell from start on that is taken beside each.

    An obstacle is beside if its low is at most `high` and its high at least `low`; that also holds for the few asked
    stretches whose low is beyond their high, which are looked up one by one.
    """
    out: list[int | None] = [None] * len(asked)
    plain = [k for k, (low, high, _) in enumerate(asked) if low <= high]
    for k in set(range(len(asked))) - set(plain):
        low, high, start = asked[k]
        out[k] = min((max(near, start) for a, b, near, far in obstacles if a <= high and b >= low and far >= start), default=None)
    obstacles = [o for o in obstacles if o[0] <= o[1]]
    places = sorted({c for k in plain for c in asked[k][:2]} | {c for o in obstacles for c in o[:2]})
    across = lambda low, high: (bisect_left(places, low), bisect_right(places, high) - 1)
    taken, ahead = Ridge(len(places)), Ridge(len(places))
    at, order = 0, sorted(obstacles, key=lambda o: o[2])
    for k in sorted(plain, key=lambda k: asked[k][2]):  # those that stand over the start
        low, high, start = asked[k]
        while at < len(order) and order[at][2] <= start:
            taken.lift(*across(*order[at][:2]), order[at][3])
            at += 1
        if taken.top(*across(low, high)) >= start:
            out[k] = start
    at = len(order) - 1
    for k in sorted(plain, key=lambda k: -asked[k][2]):  # those that begin after it
        low, high, start = asked[k]
        while at >= 0 and order[at][2] > start:
            ahead.lift(*across(*order[at][:2]), -order[at][2])
            at -= 1
        if out[k] is None and (top := ahead.top(*across(low, high))) > NOTHING:
            out[k] = -top
    return out


def few_ahead(low: np.ndarray, high: np.ndarray, start: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """The same for a page whose pairs of boxes and obstacles are few: all of them at once; FREE where nothing is ahead."""
    return pages_ahead(low, high, start, np.zeros(len(low), int), taken, np.zeros(taken.shape[1], int))


def pages_ahead(low: np.ndarray, high: np.ndarray, start: np.ndarray, page: np.ndarray, taken: np.ndarray, of: np.ndarray) -> np.ndarray:
    """few_ahead of many pages at once. page and of: the page of each box and of each obstacle, both in order."""
    first, last = np.searchsorted(of, page), np.searchsorted(of, page, "right")
    many = last - first
    out = np.full(len(low), FREE, np.int64)
    some = np.flatnonzero(many)
    for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(many[some]) // PAIRS)) + 1):
        if not len(part):
            continue
        ends = np.cumsum(many[part])
        box = np.repeat(part, many[part])
        a, b, near, far = taken[:, np.arange(ends[-1]) + np.repeat(first[part] - ends + many[part], many[part])]
        beside = (a <= high[box]) & (b >= low[box]) & (far >= start[box])
        out[part] = np.minimum.reduceat(np.where(beside, np.maximum(near, start[box]), FREE), ends - many[part])
    return out


def with_cells(page: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by page, boxes (asked, low, high, start) and obstacles (low, high, start: where they begin, far) -> the
    boxes, with `cell` in place of asked and far. A page may go on over several batches."""

    def ahead(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        asked, low, high, start, far = (rows.column(c).to_numpy() for c in ("asked", "low", "high", "start", "far"))
        cells = np.full(len(asked), FREE, np.int64)
        page = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(asked))))
        few = (np.bincount(page[asked], minlength=len(starts)) * np.bincount(page[~asked], minlength=len(starts)) <= MATRIX)[page]
        boxes, taken = np.flatnonzero(asked & few), np.flatnonzero(~asked & few)
        cells[boxes] = pages_ahead(low[boxes], high[boxes], start[boxes], page[boxes], np.stack([low[taken], high[taken], start[taken], far[taken]]), page[taken])
        for a in np.unique(page[~few]):
            rest = np.flatnonzero(page == a)
            boxes, taken = rest[asked[rest]], rest[~asked[rest]]
            found = first_ahead(list(zip(low[boxes].tolist(), high[boxes].tolist(), start[boxes].tolist(), strict=True)), list(zip(*(x[taken].tolist() for x in (low, high, start, far)), strict=True)))
            cells[boxes] = [FREE if c is None else c for c in found]
        out = rows.drop_columns(["asked", "far"]).append_column("cell", pa.array(cells.astype(np.int32), mask=cells == FREE))
        return out.filter(pa.array(asked)).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = (rows if rest is None else pa.concat_tables([rest, rows])).combine_chunks()
            new = np.zeros(rows.num_rows, bool)
            new[0] = True
            for c in page:
                column = rows.column(c)
                changed = pc.not_equal(column.slice(1), column.slice(0, rows.num_rows - 1))
                new[1:] |= changed.to_numpy() if not changed.null_count else pc.fill_null(changed, True).to_numpy()
            starts = np.flatnonzero(new)
            if len(starts) > 1:
                yield from ahead(rows.slice(0, starts[-1]), starts[:-1]).to_batches()
            rest = rows.slice(starts[-1])
        if rest is not None:
            yield from ahead(rest, np.zeros(1, np.int64)).to_batches()

    return run
