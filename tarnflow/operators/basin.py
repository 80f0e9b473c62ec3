"""The sequential parts, on one independent basin held in arrays.

A basin is a connected part of the saturated spill graph: its traps, the outside catchments they pour
into, and all cells of both. Water never passes from one basin into another, so basins run in parallel.

Flow bookkeeping is incremental and self-consistent: every full trap remembers what it currently
sends along its edge; whatever changes its inflow or capacity puts it on a worklist, and only the
difference travels on. A cell passes on max(runoff, 0), so a difference d entering it leaves as
max(runoff + d, 0) - max(runoff, 0). Times of change come from a heap with lazy invalidation.
"""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
import pandas as pd

#: Rates and volumes closer to zero than this count as zero (rounding of repeated differences).
EPS = 1e-9
INF = float("inf")
#: Traps in the chains that a basin keeps at most.
CHAIN_ROWS = 8_000_000
OUT = -1
NONE = -2


def level_table(z: np.ndarray, top: float, floor: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Water level against stored volume over cells of heights z: (levels, volumes), ascending and
    without repeats, up to the spill level ``top``. Cells below ``floor`` (the children's spill level)
    count as being at it."""
    if floor is not None:
        z = np.maximum(z, floor)
    levels = np.append(np.sort(z), top)
    volumes = levels * np.arange(1, len(levels) + 1) - np.cumsum(levels)
    keep = np.append(levels[1:] > levels[:-1], True)
    return levels[keep], volumes[keep]


def first_above(at: np.ndarray, z: np.ndarray, parent: np.ndarray, elevation: np.ndarray, strict: bool) -> np.ndarray:
    """From trap ``at`` upwards the first one whose elevation is above z (unless ``strict``, or at it);
    their number for none. Elevations never fall on the way up; strides are halved."""
    m = len(parent)
    hop = np.append(np.where(parent >= 0, parent, m), m)
    top = np.append(elevation, np.inf)
    dry = (lambda t, h: top[t] <= h) if strict else (lambda t, h: top[t] < h)
    at = np.array(at, dtype=int)
    go = np.flatnonzero(dry(at, z))
    hops = [hop]
    while (hops[-1] < m).any():
        hops.append(hops[-1][hops[-1]])
    t, h = at[go], z[go]
    for up in reversed(hops):
        far = up[t]
        t = np.where((far < m) & dry(far, h), far, t)
    at[go] = hop[t]
    return at


def tree_volumes(region: np.ndarray, z: np.ndarray, trap: np.ndarray, parent: np.ndarray, elevation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(volume, subvolume) of traps (ascending numbers, children before parents, parents by place) over the
    cells of their regions. Every cell is counted where it is first under water, and a trap adds to its
    children's volumes the water over them, so the work does not grow with the depth of the nesting."""
    m = len(trap)
    first = first_above(np.searchsorted(trap, region), z, parent, elevation, strict=True)
    wet = first < m
    first = first[wet]
    count = np.bincount(first, minlength=m).tolist()
    volume = np.bincount(first, weights=elevation[first] - z[wet], minlength=m).tolist()
    sub = [0.0] * m
    level = elevation.tolist()
    for t, p in enumerate(parent.tolist()):
        if p >= 0:
            sub[p] += volume[t]
            volume[p] += volume[t]
            if count[t] and level[p] > level[t]:
                volume[p] += count[t] * (level[p] - level[t])
            count[p] += count[t]
    return np.array(volume, dtype=float), np.array(sub, dtype=float)


class Basin:
    """Arrays of one basin and the computations over it."""

    def __init__(self, cells: pd.DataFrame, traps: pd.DataFrame):
        if not cells["cell_id"].is_monotonic_increasing:
            cells = cells.sort_values("cell_id", ignore_index=True)
        self.cell_id = cells["cell_id"].to_numpy()
        self.z = cells["z"].to_numpy(dtype=float)
        self.region = cells["region"].to_numpy()
        self.dir = cells["dir"].to_numpy()
        n = len(cells)
        target = cells["target"].to_numpy()
        at = np.minimum(np.searchsorted(self.cell_id, target), max(n - 1, 0))
        own = np.arange(n)
        known = self.cell_id[at] == target if n else np.zeros(0, bool)
        self.next = np.where(known & (at != own), at, -1)
        self.waves = self._waves()

        traps = traps.sort_values("trap", ignore_index=True)
        self.trap = traps["trap"].to_numpy()
        self.index = {int(t): k for k, t in enumerate(self.trap)}
        m = len(traps)
        up = traps["parent"].to_numpy(dtype=float)
        self.parent = np.array([self.index[int(p)] if p == p else -1 for p in up], dtype=int)
        self._up = self.parent.tolist()
        self.children: list[list[int]] = [[] for _ in range(m)]
        for k, p in enumerate(self.parent):
            if p >= 0:
                self.children[p].append(k)
        self.elevation = traps["elevation"].to_numpy(dtype=float)
        self.volume = traps["volume"].to_numpy(dtype=float)
        self.own = self.volume - traps["subvolume"].to_numpy(dtype=float)
        self.down = traps["downstream_region"].to_numpy()
        start = traps["downstream_region_cell"].to_numpy()
        edge = (start == traps["current_region_cell"].to_numpy()) | (self.down == 0)
        pos = np.minimum(np.searchsorted(self.cell_id, start), max(n - 1, 0))
        self.start = np.where(edge, -1, pos) if n else np.full(m, -1)
        self.pour = np.where((start > 0) & (self.cell_id[pos] == start), pos, -1) if n else np.full(m, -1)
        self.level = traps["level"].to_numpy()
        self.leaf_of = {int(self.trap[k]): int(k) for k in np.flatnonzero(self.level == 0)}
        self._order_leaves()

    def _order_leaves(self) -> None:
        """Regions by the nesting of their traps, so that the cells of any trap lie side by side and
        nothing has to be kept for each pair of a trap and a region or cell in it."""
        m = len(self.trap)
        up = self.parent.tolist()
        down = sorted(range(m), key=self.level.tolist().__getitem__, reverse=True)
        count = (self.level == 0).astype(int).tolist()
        for t in reversed(down):
            if up[t] >= 0:
                count[up[t]] += count[t]
        first, free = [0] * m, 0
        for t in down:
            if up[t] < 0:
                first[t], free = free, free + count[t]
            at = first[t]
            for c in self.children[t]:
                first[c], at = at, at + count[c]
        self.first_leaf, self.leaves = np.array(first, dtype=int), np.array(count, dtype=int)
        low = np.flatnonzero(self.level == 0)
        self.leaf_region = np.zeros(len(low), self.trap.dtype)
        self.leaf_region[self.first_leaf[low]] = self.trap[low]
        place = np.full(len(self.region), len(low))
        if len(low):
            k = np.minimum(np.searchsorted(self.trap, self.region), m - 1)
            inner = (self.trap[k] == self.region) & (self.level[k] == 0)
            place[inner] = self.first_leaf[k[inner]]
        self._by_leaf = np.argsort(place, kind="stable")
        self._leaf_start = np.searchsorted(place[self._by_leaf], np.arange(len(low) + 1))

    def members(self, t: int) -> np.ndarray:
        """The regions of a trap."""
        return self.leaf_region[self.first_leaf[t] : self.first_leaf[t] + self.leaves[t]]

    def _cells(self, t: int) -> np.ndarray:
        a = self.first_leaf[t]
        return self._by_leaf[self._leaf_start[a] : self._leaf_start[a + self.leaves[t]]]

    def footprint(self, t: int) -> np.ndarray:
        """Cells of a trap's regions at or below its spill level."""
        c = self._cells(t)
        return c[self.z[c] <= self.elevation[t]]

    def chain(self, region: int) -> list[int]:
        """The traps that hold a region, the innermost first."""
        path, c, up = [], self.leaf_of.get(int(region), -1), self._up
        while c >= 0:
            path.append(c)
            c = up[c]
        return path

    def _bands(self) -> tuple[list[np.ndarray], np.ndarray]:
        """(the cells of every trap's footprint that are in none of its children's, by height; the number
        of those that are). Every cell is in one band at most."""
        m = len(self.trap)
        at = np.full(len(self.region), m)
        if m:
            k = np.minimum(np.searchsorted(self.trap, self.region), m - 1)
            inner = (self.trap[k] == self.region) & (self.level[k] == 0)
            at[inner] = first_above(k[inner], self.z[inner], self.parent, self.elevation, strict=False)
        order = np.lexsort((self.z, at))
        cuts = np.searchsorted(at[order], np.arange(m + 1))
        bands = [order[cuts[t] : cuts[t + 1]] for t in range(m)]
        held = np.diff(cuts).tolist()
        below = [0] * m
        for t in sorted(range(m), key=self.level.tolist().__getitem__):
            p = int(self.parent[t])
            if p >= 0:
                below[p] += below[t] + held[t]
        self.band_of = at
        return bands, np.array(below, dtype=int)

    def _waves(self) -> list[np.ndarray]:
        """Cells by distance from the ridge: every cell comes after all that flow into it."""
        n = len(self.next)
        inner = self.next >= 0
        degree = np.bincount(self.next[inner], minlength=n)
        ready, out = np.flatnonzero(degree == 0), []
        while len(ready):
            out.append(ready)
            to = self.next[ready]
            to = to[to >= 0]
            np.subtract.at(degree, to, 1)
            to = np.unique(to)
            ready = to[degree[to] == 0]
        return out

    def accumulate(self, runoff: np.ndarray) -> tuple[np.ndarray, dict[int, float], float]:
        """Runoff with everything from upstream added (negative values are unused infiltration capacity
        and pass nothing on), the inflow of every catchment with a trap, and what leaves the domain."""
        r = runoff.astype(float).copy()
        for wave in self.waves:
            to = self.next[wave]
            go = to >= 0
            np.add.at(r, to[go], np.maximum(r[wave[go]], 0.0))
        end = np.flatnonzero(self.next < 0)
        got = np.maximum(r[end], 0.0)
        inner = self.region[end] > 0
        accum = {reg: 0.0 for reg in self.leaf_of}
        for reg, x in zip(self.region[end][inner], got[inner], strict=True):
            accum[int(reg)] = accum.get(int(reg), 0.0) + float(x)
        return r, accum, float(got[~inner].sum())

    # ------------------------------------------------------------------ steady state

    def watercourses(self, precip: np.ndarray, infil: np.ndarray, full: set[int]) -> tuple[np.ndarray, dict[int, float], float, float]:
        """(runoff, inflow of catchments, off-region runoff, infiltration used) with the traps in ``full``
        (trap numbers) spilling over. Traps of a loop that spill into each other keep their inflow."""
        runoff, accum, off = self.accumulate(precip - infil)
        on = np.array([int(t) in full for t in self.trap], dtype=bool)
        top = [k for k in range(len(on)) if on[k] and not (self.parent[k] >= 0 and on[self.parent[k]])]
        top_of = {int(r): t for t in reversed(top) for r in self.members(t)}  # the innermost last
        to = {t: top_of.get(int(self.down[t]), -1) if self.down[t] > 0 else -1 for t in top}
        loop: set[int] = set()
        seen: set[int] = set()
        for t in top:
            path: dict[int, None] = {}
            c = t
            while c in to and c not in path and c not in seen:
                path[c] = None
                c = to[c]
            if c in path:
                steps = list(path)
                loop |= set(steps[steps.index(c) :])
            seen.update(path)  # in place; |= with the view of a dict copies all that was seen
        free = [t for t in top if t not in loop]
        waiting = dict.fromkeys(free, 0)
        for t in free:
            if to[t] in waiting:
                waiting[to[t]] += 1
        ready = deque(t for t in free if not waiting[t])
        while ready:
            t = ready.popleft()
            off += self._overflow(t, runoff, accum)
            d = to[t]
            if d in waiting:
                waiting[d] -= 1
                if not waiting[d]:
                    ready.append(d)
        unused = np.maximum(-runoff, 0.0)
        for t in top:
            unused[self.footprint(t)] = 0.0
        return runoff, accum, off, float((infil - unused).sum())

    def _overflow(self, t: int, runoff: np.ndarray, accum: dict[int, float]) -> float:
        """Empties the inflow of a full trap over its spill point; returns what leaves the domain."""
        held = self.members(t).tolist()
        a = sum(accum.get(r, 0.0) for r in held) - float(np.maximum(-runoff[self.footprint(t)], 0.0).sum())
        a = max(a, 0.0)
        for r in held:
            accum[r] = 0.0
        c = int(self.start[t])
        while c >= 0 and a > 0:
            before = runoff[c]
            runoff[c] = before + a
            a = max(before + a, 0.0) - max(before, 0.0)
            if self.next[c] < 0:
                r = int(self.region[c])
                if r > 0:
                    accum[r] = accum.get(r, 0.0) + a
                    return 0.0
                break
            c = int(self.next[c])
        return a

    # ------------------------------------------------------------------ drawing

    def _along(self, traps: np.ndarray) -> np.ndarray:
        """Whether each cell is on the way from the spill point of one of these traps to where its water rests."""
        on = np.zeros(len(self.cell_id), bool)
        c = np.unique(self.pour[traps])
        c = c[c >= 0]
        while len(c):
            on[c] = True
            c = self.next[c]
            c = np.unique(c[c >= 0])
            c = c[~on[c]]
        return on

    def _under(self, traps: np.ndarray) -> np.ndarray:
        """Whether each cell is at or below the spill level of the outermost of these traps (a mask) over it."""
        m = len(self.trap)
        top = [-1] * (m + 1)
        on = traps.tolist()
        for t in sorted(range(m), key=self.level.tolist().__getitem__, reverse=True):
            p = self._up[t]
            top[t] = top[p] if p >= 0 and top[p] >= 0 else t if on[t] else -1
        over = np.array(top, dtype=int)[self.lowest]
        return (over >= 0) & (self.z <= np.append(self.elevation, -INF)[over])

    def water_level(self, t: int, amount: float) -> float | None:
        """The level of a trap that holds some water of its own, from its level table."""
        tiny = float(np.sqrt(np.finfo(float).eps))
        v = self.own[t] - (self.own[t] - amount) * (1 - tiny)
        levels, volumes, _ = self._table(t)
        k = int(np.searchsorted(volumes, v, side="right")) - 1
        if not amount > tiny or not np.isfinite(v) or k < 0 or k >= len(levels) - 1:
            return None
        return float(levels[k] + (v - volumes[k]) * (levels[k + 1] - levels[k]) / (volumes[k + 1] - volumes[k]))

    def colors(self, filled: np.ndarray, amount: np.ndarray, filled_color: int, trap_color: int, river_color: int) -> np.ndarray:
        """Colors of all cells for a state of the traps, see ``dynamics.interpolate_timeseries``. Every cell is
        looked at once, however many traps lie over it."""
        m, n = len(self.trap), len(self.cell_id)
        if not hasattr(self, "lowest"):
            k = np.minimum(np.searchsorted(self.trap, self.region), max(m - 1, 0))
            self.lowest = np.where((self.trap[k] == self.region) & (self.level[k] == 0), k, m) if m else np.zeros(n, dtype=int)
            self.bands, self.below = self._bands()
            self._tables = {}
        held = self.volume > 0
        out = np.zeros(n, dtype=np.int64)
        if trap_color:
            out[self._under(held) | self._along(np.flatnonzero(held))] = trap_color
        full = filled & held
        if river_color:
            out[self._along(np.flatnonzero(full))] = river_color
        out[self._under(full)] = filled_color
        shut = np.bincount(self.parent[(self.parent >= 0) & ~filled], minlength=m) == 0
        for t in np.flatnonzero(~filled & shut & (amount > 0)).tolist():
            level = self.water_level(t, float(amount[t]))
            if level is not None:
                c = self._cells(t)
                out[c[(self.z[c] < level) & (self.z[c] <= self.elevation[t])]] = filled_color
        return out

    # ------------------------------------------------------------------ dynamics

    def begin(self, infil: np.ndarray, t0: float) -> None:
        """State before the first weather: traps without volume are full, all others empty."""
        m = len(self.trap)
        self.infil = infil
        self.wet = bool((infil != 0).any())
        self.filled = self.volume == 0.0
        self.amount = np.zeros(m)
        self.time = np.full(m, t0)
        self.touched_parts: list = []
        self.changed_parts: list = []
        self.is_touched = np.zeros(m, bool)
        self.is_changed = np.zeros(m, bool)
        self.stamp = np.zeros(m, dtype=np.int64)
        # the only two children of every trap, where each has two or none
        self.pairs = all(len(c) in (0, 2) for c in self.children)
        self.twins = np.full((m, 2), -1)
        self.sibling = np.full(m, -1)
        if self.pairs and m:
            both = [(t, *c) for t, c in enumerate(self.children) if c]
            if both:
                t, c, e = np.array(both).T
                self.twins[t, 0], self.twins[t, 1], self.sibling[c], self.sibling[e] = c, e, e, c
        self.rising = all(p < 0 or p > t for t, p in enumerate(self._up))
        self.nothing = np.zeros(0, dtype=int)
        self._chains: dict[int, np.ndarray] = {}
        self._held = 0
        self._tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        if self.wet:  # a constant rate needs no levels
            self.bands, self.below = self._bands()

    def _table(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(levels, volumes, cells of the own band up to each level) of a trap, made when first asked for."""
        got = self._tables.get(t)
        if got is None:
            f, n = self.bands[t], int(self.below[t])
            z = self.z[f]
            if self.children[t]:
                z, n = np.append(self.elevation[self.children[t][0]], z), n - 1
            levels = np.append(z, self.elevation[t])
            sums = np.cumsum(levels) + (n * levels[0] if self.children[t] else 0.0)
            count = np.arange(1, len(levels) + 1) + (n if self.children[t] else 0)
            keep = np.append(levels[1:] > levels[:-1], True)
            got = levels[keep], (levels * count - sums)[keep], np.searchsorted(self.z[f], levels[keep], side="right")
            self._tables[t] = got
        return got

    def edge(self, t: int) -> int:
        """Where a full trap spills: its parent once all siblings are full, else the catchment below."""
        p = int(self.parent[t])
        if p >= 0 and (self.filled[p] or not self.open_children[p]):
            return p
        return self.index.get(int(self.down[t]), OUT) if self.down[t] > 0 else OUT

    def set_rain(self, rain: np.ndarray) -> None:
        """Rates of all traps and cells for a rain rate and the present fill state."""
        self.runoff, accum, _ = self.accumulate(rain - self.infil)
        m = len(self.trap)
        up = self.parent[(self.parent >= 0) & ~self.filled]
        self.open_children = np.bincount(up, minlength=m) if m else np.zeros(0, dtype=int)
        self.inflow = np.zeros(m)
        for r, k in self.leaf_of.items():
            self.inflow[k] = accum.get(r, 0.0)
        self.smax = np.zeros(m)
        self.smin = np.zeros(m)
        self.spare = np.zeros(m)
        if self.wet:
            dry = self.band_of[self.runoff < 0]
            for t in np.unique(dry[dry < m]).tolist():
                self.spare[t] = self._unused(t)
            low, high, spare = self.smin.tolist(), self.smax.tolist(), self.spare.tolist()
            for t in np.argsort(self.level, kind="stable").tolist():
                low[t] = sum(high[c] for c in self.children[t])
                high[t] = low[t] + spare[t]
            self.smin, self.smax = np.array(low, dtype=float), np.array(high, dtype=float)
        self.sent = np.zeros(m)
        self.to = np.full(m, NONE)
        self.now = None
        self._forget_event()
        self.work: deque[int | np.ndarray] = deque()
        # the same memory as the arrays, which gives and takes single numbers faster
        self._runoff, self._sent, self._inflow, self._smax = (memoryview(x) for x in (self.runoff, self.sent, self.inflow, self.smax))
        self._to = memoryview(self.to)
        for t in np.flatnonzero(self.filled).tolist():
            self.to[t] = self.edge(t)
            self.work.append(t)
        self._settle_work()
        self._forget_event(changed=False)

    def _forget_event(self, changed: bool = True) -> None:
        """Nothing is touched any more, and nothing changed."""
        for part in self.touched_parts:
            self.is_touched[part] = False
        self.touched_parts = []
        if changed:
            for part in self.changed_parts:
                self.is_changed[part] = False
            self.changed_parts = []
        self.new_runoff: set[int] = set()

    @staticmethod
    def _joined(parts: list) -> np.ndarray:
        """Trap numbers held one by one and in arrays."""
        return np.concatenate([[x for x in parts if type(x) is int], *[x for x in parts if type(x) is not int]]).astype(int)

    def touched(self) -> np.ndarray:
        """The traps touched by the event, ascending."""
        return np.sort(self._joined(self.touched_parts))

    def _unused(self, t: int) -> float:
        return float(np.maximum(-self.runoff[self.bands[t]], 0.0).sum())

    def _capacity(self, t: int) -> None:
        """Unused infiltration under a trap: its own band and, in smin, what lies under its children."""
        self.spare[t] = self._unused(t)
        self.smax[t] = self.smin[t] + self.spare[t]

    def _outflow(self, t: int) -> float:
        to = self._to[t]
        if to == NONE:
            return 0.0
        f = self._inflow[t] - self._smax[t]
        return f if to == self._up[t] and to >= 0 else max(f, 0.0)

    def _touch(self, t: int) -> None:
        """Before a rate of t changes within an event: bring its amount up to now under the old rates."""
        if not self.is_touched[t]:
            self.is_touched[t] = True
            self.touched_parts.append(t)
            if self.now is not None:
                self.amount[t] = self.fill_at(t, self.now)
                self.time[t] = self.now

    def _touch_all(self, traps: np.ndarray) -> None:
        traps = traps[~self.is_touched[traps]]
        if len(traps):
            self.is_touched[traps] = True
            self.touched_parts.append(traps)
            if self.now is not None:
                self.amount[traps] = self.fills(traps, self.now)
                self.time[traps] = self.now

    def _change(self, t: int) -> None:
        if not self.is_changed[t]:
            self.is_changed[t] = True
            self.changed_parts.append(t)

    def _settle_work(self) -> None:
        while self.work:
            t = self.work.popleft()
            if type(t) is int:
                self._settle(t)
                continue
            at, step = 0, 16
            while at < len(t):  # in order, but those that send nothing new are passed over together
                part = t[at : at + step]
                to, f = self.to[part], self.inflow[part] - self.smax[part]
                f = np.where((to == self.parent[part]) & (to >= 0), f, np.maximum(f, 0.0))
                d = np.where(to == NONE, 0.0, f) - self.sent[part]
                k = np.flatnonzero(np.abs(d) > EPS * 1e-3)
                if len(k):
                    at, step = at + int(k[0]) + 1, 16
                    self._settle(int(part[k[0]]))
                else:
                    at, step = at + step, step * 8

    def _settle(self, t: int) -> None:
        d = self._outflow(t) - self._sent[t]
        if abs(d) > EPS * 1e-3:
            self._sent[t] += d
            self._send(t, self._to[t], d)

    def _add_inflow(self, t: int, d: float) -> None:
        self._touch(t)
        self._change(t)
        self._inflow[t] += d
        if self._to[t] != NONE:
            self.work.append(t)

    def _send(self, t: int, to: int, d: float) -> None:
        """A difference d of what t sends along its edge."""
        if to >= 0 and to == self._up[t]:
            self._add_inflow(to, d)
            return
        c = int(self.start[t])
        if c < 0:
            return
        # the whole path lies in one catchment; with infiltration its traps settle before it changes
        chain = self._chain(int(self.region[c])) if self.wet else self.nothing
        if len(chain):
            self._touch_all(chain)
        bands: set[int] = set()
        runoff, seen, steepest, follow = self._runoff, self.new_runoff, self.dir, self.next
        while True:
            before = runoff[c]
            runoff[c] = before + d
            seen.add(c)
            if self.wet and (before < 0 or before + d < 0):
                bands.add(int(self.band_of[c]))
            d = max(before + d, 0.0) - max(before, 0.0)
            if d == 0.0 or steepest[c] == -1:
                break
            n = int(follow[c])
            if n < 0:
                c = -1
                break
            c = n
            if steepest[c] == -3:
                break
        if len(chain):
            if bands:
                self._refit(chain, bands)
            fresh = chain[~self.is_changed[chain]]
            if len(fresh):
                self.is_changed[fresh] = True
                self.changed_parts.append(fresh)
            full = chain[self.to[chain] != NONE]
            if len(full):
                self.work.append(full)
        r = int(self.region[c]) if c >= 0 else 0
        if r <= 0:
            return
        if d != 0.0 and self.dir[c] == -1:
            self._add_inflow(self.index[r], d)

    def _chain(self, region: int) -> np.ndarray:
        """``chain`` as an array, kept as long as all that are kept are not too many."""
        got = self._chains.get(region)
        if got is None:
            got = np.array(self.chain(region), dtype=int)
            self._held += len(got) + 16
            if self._held > CHAIN_ROWS:
                self._chains.clear()
                self._held = len(got) + 16
            self._chains[region] = got
        return got

    def _refit(self, chain: np.ndarray, bands: set[int]) -> None:
        """smin and smax of a region's traps (the innermost first) after runoff changed in some bands."""
        if self.rising:
            found = np.array(sorted(bands), dtype=int)
            k = np.minimum(np.searchsorted(chain, found), len(chain) - 1)
            at = k[chain[k] == found].tolist()
        else:
            at = [int(k) for b in bands for k in np.flatnonzero(chain == b)]
        if not at:
            return
        if not self.pairs:
            for t in chain.tolist():
                if self.children[t]:
                    self.smin[t] = sum(self.smax[k] for k in self.children[t])
                if t in bands:
                    self._capacity(t)
                else:
                    self.smax[t] = self.smin[t] + self.spare[t]
            return
        for k in at:
            t = int(chain[k])
            self.spare[t] = self._unused(t)
        # smin is smax of both children, smax adds the own band: one running sum from the first change upwards
        part = chain[min(at) :]
        sums = np.empty(2 * len(part) - 1)
        sums[0] = self.smin[part[0]] + self.spare[part[0]]
        sums[1::2], sums[2::2] = self.smax[self.sibling[part[:-1]]], self.spare[part[1:]]
        sums = np.cumsum(sums)
        self.smax[part], self.smin[part[1:]] = sums[0::2], sums[1::2]

    def _rate(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(volumes, net rate from each volume up to the next) of a trap; the rate is constant between
        the levels of its cells. The last entry holds at the full volume."""
        if not self.wet:
            return np.array([0.0, self.own[t]]), np.full(2, self.inflow[t])
        # what lies under the children takes smin at every level
        cap = np.maximum(-self.runoff[self.bands[t]], 0.0)
        _, volumes, upto = self._table(t)
        return volumes, self.inflow[t] - np.append(0.0, np.cumsum(cap))[upto]

    def integrate(self, t: int, v: float, start: float, horizon: float) -> tuple[float, float | None]:
        """Water in trap t at ``horizon``, from v at ``start``, and when it became full or empty (None if
        it did not). Exact: volume changes at a constant rate between the levels of the table."""
        full = self.own[t]
        if not self.wet or self.smax[t] == self.smin[t]:
            r = float(self.inflow[t])
            if abs(r) <= EPS:
                return v, None
            end = start + ((full - v) / r if r > 0 else v / -r)
            if end <= horizon:
                return (full if r > 0 else 0.0), end
            return v + (horizon - start) * r, None
        volumes, rates = self._rate(t)
        k = int(np.clip(np.searchsorted(volumes, v + EPS, side="right") - 1, 0, len(volumes) - 1))
        at_top = v >= full - EPS
        r = float(rates[-1] if at_top else rates[k])
        if (v <= EPS and r <= EPS) or (at_top and r >= -EPS):
            return (full if at_top else 0.0), start
        if abs(r) <= EPS:
            return v, None
        clock = start
        if r > 0:
            while k < len(volumes) - 1:
                r = float(rates[k])
                if r <= EPS:
                    return v, None
                goal = min(float(volumes[k + 1]), full)
                step = (goal - v) / r
                if clock + step > horizon:
                    return v + (horizon - clock) * r, None
                clock, v = clock + step, goal
                k += 1
            return full, clock
        if at_top or v <= volumes[k] + EPS:
            k = len(volumes) - 2 if at_top else k - 1
        while k >= 0:
            r = float(rates[k])
            if r >= -EPS:
                return v, None
            goal = float(volumes[k])
            step = (goal - v) / r
            if clock + step > horizon:
                return v + (horizon - clock) * r, None
            clock, v = clock + step, goal
            k -= 1
        return 0.0, clock

    def fill_at(self, t: int, when: float) -> float:
        """Water of trap t itself (without its children) at a time not before its last amount."""
        if self.filled[t]:
            return float(self.own[t])
        if self.open_children[t]:
            return 0.0
        return self.integrate(t, float(self.amount[t]), float(self.time[t]), when)[0]

    def fills(self, traps: np.ndarray, when: float) -> np.ndarray:
        """``fill_at`` of many traps."""
        full = self.filled[traps]
        out = np.where(full, self.own[traps], 0.0)
        for k in np.flatnonzero(~full & (self.open_children[traps] == 0)).tolist():
            t = int(traps[k])
            out[k] = self.integrate(t, float(self.amount[t]), float(self.time[t]), when)[0]
        return out

    def change_time(self, t: int, now: float) -> float:
        """When trap t changes between full and not full if no rate changes before."""
        least = self.inflow[t] - (self.smax[t] - self.smin[t])
        if self.filled[t]:
            if least >= -EPS:
                return INF
            p = int(self.parent[t])
            if p < 0:
                return now
            if self.filled[p] or self.inflow[p] > EPS:
                return INF
            if self.amount[p] <= EPS:
                return max(now, float(self.time[p]))
            v, end = self.integrate(p, float(self.amount[p]), float(self.time[p]), INF)
            return end if end is not None and v == 0.0 else INF
        if least < -EPS or self.open_children[t]:
            return INF
        if self.amount[t] >= self.own[t] - EPS and self.own[t] <= EPS:
            return max(now, float(self.time[t]))
        v, end = self.integrate(t, float(self.amount[t]), float(self.time[t]), INF)
        return end if end is not None and v > 0.0 else INF

    def _queue(self, ts: np.ndarray, now: float) -> None:
        self.stamp[ts] += 1
        if len(ts) > 16:  # most change no more at these rates, see change_time
            least, p, full = self.inflow[ts] - (self.smax[ts] - self.smin[ts]), self.parent[ts], self.filled[ts]
            drains = full & (least < -EPS) & ((p < 0) | (~self.filled[p] & (self.inflow[p] <= EPS)))
            ts = ts[drains | (~full & (least >= -EPS) & (self.open_children[ts] == 0))]
        for t in ts.tolist():
            c = self.change_time(t, now)
            if c < INF:
                heapq.heappush(self.heap, (max(c, now), t, int(self.stamp[t])))

    def run(self, start: float, end: float, before=None):
        """Events until ``end``: yields (time, changed traps) with the state already up to date.
        ``before(time)`` is called ahead of every event, with the state still as it was."""
        self.heap: list = []
        self.stamp[:] = 0
        self.still = np.zeros(len(self.trap), bool)
        self._queue(np.arange(len(self.trap)), start)
        while self.heap:
            now = self.heap[0][0]
            if now >= end:
                break
            flips = []
            while self.heap and self.heap[0][0] == now:
                _, t, s = heapq.heappop(self.heap)
                if s == self.stamp[t]:
                    flips.append(t)
            if not flips:
                continue
            if before is not None:
                before(now)
            self._forget_event()
            self.now = now
            # amounts under the old rates, before any flag or flow changes
            for t in flips:
                self._touch(t)
            for t in flips:
                self.filled[t] = ~self.filled[t]
                if self.parent[t] >= 0:
                    self.open_children[self.parent[t]] += -1 if self.filled[t] else 1
                # water of a trap that filled or starts to empty is its whole own volume
                self.amount[t], self.time[t] = self.own[t], now
            near = set(flips)
            for t in flips:
                p = int(self.parent[t])
                if p >= 0 and not self.filled[t] and not self.filled[p]:
                    # the pond above is gone once one of its parts falls below its rim
                    if not self.is_touched[p]:
                        self.is_touched[p] = True
                        self.touched_parts.append(p)
                    self.amount[p], self.time[p] = 0.0, now
                if self.parent[t] >= 0:
                    near |= set(self.children[self.parent[t]])
            moved = []
            for t in near:
                want = self.edge(t) if self.filled[t] else NONE
                if want != self.to[t]:
                    moved.append((t, int(self.to[t]), want))
            # all withdrawals come before all additions
            for t, old, _ in moved:
                if old != NONE and self.sent[t] != 0.0:
                    d, self.sent[t] = -self.sent[t], 0.0
                    self._send(t, old, d)
                self.to[t] = NONE
            for t, _, want in moved:
                self.to[t] = want
                if want != NONE:
                    self.work.append(t)
            self._settle_work()
            self.now = None
            # a trap that flipped changes again only if its rates have changed as well
            if not self.wet:  # few traps change at once, none of them in arrays
                few = set(self.changed_parts)
                more = few | (near - set(flips))
                for t in few | set(flips):
                    more.update(c for c in self.children[t] if self.filled[c])
                    if self._up[t] >= 0:
                        more.add(self._up[t])
                more.difference_update(t for t in flips if t not in few)
                self._queue(np.array(list(more), dtype=int), now)
            else:
                changed, on = self._joined(self.changed_parts), np.array(flips)
                base = np.concatenate([changed, on])
                if self.pairs:
                    kids = self.twins[base].ravel()
                    kids = kids[kids >= 0]
                else:
                    kids = np.array([c for t in base.tolist() for c in self.children[t]], dtype=int)
                kids = kids[self.filled[kids]]  # one that is not full depends on nothing above it
                again = np.unique(np.concatenate([changed, list(near), kids, self.parent[base]])).astype(int)
                self.still[on] = ~self.is_changed[on]
                again = again[(again >= 0) & ~self.still[again]]
                self.still[on] = False
                self._queue(again, now)
            yield now, flips

    def finish(self, end: float) -> None:
        """Brings all amounts to the end of a weather interval."""
        if end < INF:
            self.amount = self.fills(np.arange(len(self.trap)), end)
            self.time = np.full(len(self.trap), end)
