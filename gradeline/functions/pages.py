"""Matching inside one page, in numpy. Spark spreads the pages; nothing here sees two of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Fixed value: cost added to a pair of unlike types.
TYPE_PENALTY = 0.25


@dataclass
class Boxes:
    """Boxes of one side of a page as columns; a box without an area has ``valid`` off."""

    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    h: np.ndarray
    kind: np.ndarray
    valid: np.ndarray

    def __len__(self) -> int:
        return len(self.x)

    def take(self, rows) -> Boxes:
        return Boxes(*(getattr(self, n)[rows] for n in ("x", "y", "w", "h", "kind", "valid")))


def boxes(blocks) -> Boxes:
    """From a sequence of dict-like blocks with bbox, kind."""
    n = len(blocks)
    out = np.zeros((4, n))
    kind, valid = np.empty(n, dtype=object), np.zeros(n, dtype=bool)
    for i, b in enumerate(blocks):
        kind[i] = b["kind"]
        if b["bbox"] is not None:
            r = b["bbox"]
            out[:, i] = r["x"], r["y"], r["w"], r["h"]
            valid[i] = True
    return Boxes(*out, kind, valid)


def iou_grid(a: Boxes, b: Boxes) -> np.ndarray:
    ax, ay, aw, ah = (v[:, None] for v in (a.x, a.y, a.w, a.h))
    iw = np.minimum(ax + aw, b.x + b.w) - np.maximum(ax, b.x)
    ih = np.minimum(ay + ah, b.y + b.h) - np.maximum(ay, b.y)
    inter = np.clip(iw, 0, None) * np.clip(ih, 0, None)
    area_a = np.clip(aw, 0, None) * np.clip(ah, 0, None)
    area_b = np.clip(b.w, 0, None) * np.clip(b.h, 0, None)
    union = area_a + area_b - inter
    ok = (union > 0) & a.valid[:, None] & b.valid
    return np.where(ok, inter / np.where(union > 0, union, 1.0), 0.0)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment of every row or column of the shorter side.

    Rows enter one at a time along a cheapest alternating path over reduced costs.
    """
    if cost.shape[0] > cost.shape[1]:
        return [(r, c) for c, r in assign(cost.T)]
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        reach = np.full(m, np.inf)
        came = np.full(m, -1)
        closed = np.zeros(m, dtype=bool)
        row, base, tail = start, 0.0, -1
        while True:
            step = base + cost[row] - row_price[row] - col_price
            better = ~closed & (step < reach)
            reach[better] = step[better]
            came[better] = tail
            col = int(np.argmin(np.where(closed, np.inf, reach)))
            base = reach[col]
            closed[col] = True
            if owner[col] < 0:
                break
            row, tail = owner[col], col
        row_price[start] += base
        done = closed & (np.arange(m) != col)
        gain = base - reach[done]
        row_price[owner[done]] += gain
        col_price[done] -= gain
        while col >= 0:
            before = came[col]
            owner[col] = start if before < 0 else owner[before]
            col = before
    return [(int(owner[c]), c) for c in range(m) if owner[c] >= 0]


def match(p: Boxes, g: Boxes, threshold: float, typed: bool):
    """Kept pairs of the optimal one-to-one assignment, and the IoU matrix.

    Where no box overlaps two others and the threshold is at least one half, every pair that clears
    it belongs to each optimum (giving one up costs more than two type penalties return), so the
    assignment is read off.
    """
    if not len(p) or not len(g):
        return [], np.zeros((len(p), len(g)))
    overlap = iou_grid(p, g)
    touch = overlap > 0
    if threshold >= 0.5 and touch.sum(0).max() <= 1 and touch.sum(1).max() <= 1:
        pairs = zip(*np.nonzero(overlap >= threshold))
        return sorted((int(i), int(j)) for i, j in pairs), overlap
    return assigned(p, g, overlap, threshold, typed), overlap


def assigned(p: Boxes, g: Boxes, overlap: np.ndarray, threshold: float, typed: bool) -> list[tuple[int, int]]:
    """Pairs of the optimal assignment that clear the threshold."""
    cost = 1.0 - overlap
    if typed:
        cost = cost + TYPE_PENALTY * (p.kind[:, None] != g.kind)
    kept = [(i, j) for i, j in assign(cost) if overlap[i, j] >= threshold
            and p.valid[i] and g.valid[j]]
    return sorted(kept)


def neighbours(b: Boxes, i: int, others: np.ndarray, reach: float) -> np.ndarray:
    """Which of ``others`` are adjacent to box ``i`` and of its kind."""
    x, y, w, h = b.x[others], b.y[others], b.w[others], b.h[others]
    gap_x = np.maximum(0, np.maximum(x - (b.x[i] + b.w[i]), b.x[i] - (x + w)))
    gap_y = np.maximum(0, np.maximum(y - (b.y[i] + b.h[i]), b.y[i] - (y + h)))
    meet_x = (b.x[i] + b.w[i] >= x) & (x + w >= b.x[i])
    meet_y = (b.y[i] + b.h[i] >= y) & (y + h >= b.y[i])
    near = (meet_x & (gap_y < reach)) | (meet_y & (gap_x < reach))
    return near & (b.kind[others] == b.kind[i]) & b.valid[others]


def adjacent_groups(b: Boxes, members: list[int], reach: float) -> list[list[int]]:
    """Connected groups under adjacency, in order of their smallest member."""
    left, groups = list(members), []
    while left:
        group, frontier = [left.pop(0)], None
        frontier = [group[0]]
        while frontier and left:
            rest = np.array(left)
            near = rest[neighbours(b, frontier.pop(), rest, reach)].tolist()
            group += near
            frontier += near
            left = [k for k in left if k not in near]
        groups.append(sorted(group))
    return groups


def union_of(b: Boxes, rows: list[int]) -> tuple[float, float, float, float]:
    x0, y0 = b.x[rows].min(), b.y[rows].min()
    return x0, y0, (b.x[rows] + b.w[rows]).max() - x0, (b.y[rows] + b.h[rows]).max() - y0


def recover(parts: Boxes, wholes: Boxes, free_parts, free_wholes, overlap, threshold, reach):
    """Let each free whole, in order, take its best group of adjacent free parts.

    ``overlap`` is indexed [part, whole]. A group needs two parts, must clear the threshold and
    must beat the best single part. Its kind is not compared with the whole's.
    """
    free = [i for i in free_parts if parts.valid[i]]
    records = []
    for t in free_wholes:
        if not wholes.valid[t]:
            continue
        near = [i for i in free if overlap[i, t] > 0]
        if len(near) < 2:
            continue
        single = max(overlap[i, t] for i in near)
        best = None
        for group in adjacent_groups(parts, near, reach):
            if len(group) < 2:
                continue
            x, y, w, h = union_of(parts, group)
            one = Boxes(*(np.array([v]) for v in (x, y, w, h)), np.array([None]), np.array([True]))
            got = iou_grid(one, wholes.take([t]))[0, 0]
            if got >= threshold and got > single and (best is None or got > best[1]):
                best = (group, got, (x, y, w, h))
        if best:
            group, got, (x, y, w, h) = best
            free = [i for i in free if i not in group]
            records.append(
                {
                    "sources": [int(i) for i in group], "target": int(t),
                    "before": float(single), "after": float(got),
                    "bbox": {"x": int(x), "y": int(y), "w": int(w), "h": int(h)},
                }
            )
    return records


def match_with_recovery(p: Boxes, g: Boxes, threshold: float, reach: float, typed: bool):
    """One-to-one pairs, then predictions merged for missed truths, then truths for predictions."""
    pairs, overlap = match(p, g, threshold, typed)
    return pairs, *recover_both(p, g, pairs, overlap, threshold, reach)


def recover_both(p: Boxes, g: Boxes, pairs, overlap: np.ndarray, threshold: float, reach: float):
    """Records of predictions merged for missed truths, then of truths merged for predictions."""
    used_p, used_g = {i for i, _ in pairs}, {j for _, j in pairs}
    free_p = [i for i in range(len(p)) if i not in used_p]
    free_g = [j for j in range(len(g)) if j not in used_g]
    splits = recover(p, g, free_p, free_g, overlap, threshold, reach)
    for r in splits:
        used_p.update(r["sources"])
        used_g.add(r["target"])
    free_p = [i for i in free_p if i not in used_p]
    free_g = [j for j in free_g if j not in used_g]
    merges = recover(g, p, free_g, free_p, overlap.T, threshold, reach)
    return splits, merges


def greedy_hits(p: Boxes, g: Boxes, confidence: np.ndarray, thresholds) -> np.ndarray:
    """Hit flags [threshold, prediction]: by falling confidence, each takes its best free truth."""
    if not len(p) or not len(g):
        return np.zeros((len(thresholds), len(p)), dtype=bool)
    return greedy_rows(iou_grid(p, g) * (p.kind[:, None] == g.kind), confidence, thresholds)


def greedy_rows(overlap: np.ndarray, confidence: np.ndarray, thresholds) -> np.ndarray:
    """Hit flags [threshold, row] of a matrix of overlaps within a kind."""
    n_pred, n_gt = overlap.shape
    hits = np.zeros((len(thresholds), n_pred), dtype=bool)
    if not n_gt:
        return hits
    order = np.argsort(-confidence, kind="stable")
    for t, limit in enumerate(thresholds):
        free = np.ones(n_gt, dtype=bool)
        for i in order:
            row = np.where(free, overlap[i], 0.0)
            j = int(np.argmax(row))
            if row[j] > 0 and row[j] >= limit:
                free[j] = False
                hits[t, i] = True
    return hits


#: Gain that a pair must have over its rivals to be taken without an assignment.
SLACK = 1e-9


@dataclass
class Merges:
    """Merges of parts for a whole as columns: the key (page, or page and kind) of each, the whole, its
    parts (rows filled up with -1), overlaps before and after, union box. ``fast`` marks those whose
    numbers count through all keys, not within their own."""

    key: np.ndarray
    target: np.ndarray
    sources: np.ndarray
    before: np.ndarray
    after: np.ndarray
    box: np.ndarray
    fast: np.ndarray

    @property
    def n_sources(self) -> np.ndarray:
        return (self.sources >= 0).sum(1)

    def with_lists(self, records: list[tuple[int, dict]]) -> Merges:
        """These and records of :func:`recover` with their keys, in order of key and target."""
        if records:
            width = max(self.sources.shape[1], *(len(r["sources"]) for _, r in records))
            filled = [r["sources"] + [-1] * (width - len(r["sources"])) for _, r in records]
            own = np.pad(self.sources, ((0, 0), (0, width - self.sources.shape[1])), constant_values=-1)
            add = lambda mine, more: np.concatenate([mine, np.array(more, dtype=mine.dtype)])
            self = Merges(
                add(self.key, [k for k, _ in records]), add(self.target, [r["target"] for _, r in records]), add(own, filled),
                *(add(getattr(self, c), [r[c] for _, r in records]) for c in ("before", "after")),
                add(self.box, [[r["bbox"][c] for c in "xywh"] for _, r in records]), add(self.fast, [False] * len(records)),
            )
        order = np.lexsort((self.target, self.key))
        return Merges(*(getattr(self, f)[order] for f in ("key", "target", "sources", "before", "after", "box", "fast")))

    def listed(self, n: int) -> list[list[dict]]:
        """The records of :func:`recover`, by key."""
        out = [[] for _ in range(n)]
        for k, t, s, before, after, box in zip(self.key, self.target, self.sources, self.before, self.after, self.box):
            out[k].append({
                "sources": s[s >= 0].tolist(), "target": int(t), "before": float(before), "after": float(after),
                "bbox": dict(zip("xywh", map(int, box))),
            })
        return out


def merged_pairs(parts: Boxes, wholes: Boxes, part, whole, single, key, threshold: float, reach) -> Merges:
    """:func:`recover` for wholes that have two free parts each, all at once."""
    a, b, t = parts.take(part[:, 0]), parts.take(part[:, 1]), wholes.take(whole)
    gap_x = np.maximum(b.x - (a.x + a.w), a.x - (b.x + b.w))
    gap_y = np.maximum(b.y - (a.y + a.h), a.y - (b.y + b.h))
    limit = reach[key]
    near = ((gap_x <= 0) & (np.maximum(gap_y, 0) < limit)) | ((gap_y <= 0) & (np.maximum(gap_x, 0) < limit))
    x, y = np.minimum(a.x, b.x), np.minimum(a.y, b.y)
    w, h = np.maximum(a.x + a.w, b.x + b.w) - x, np.maximum(a.y + a.h, b.y + b.h) - y
    inter = (np.minimum(x + w, t.x + t.w) - np.maximum(x, t.x)) * (np.minimum(y + h, t.y + t.h) - np.maximum(y, t.y))
    after = inter / (w * h + t.w * t.h - inter)
    kept = near & (a.kind == b.kind) & (after >= threshold) & (after > single)
    box = np.stack([x, y, w, h], axis=1)
    return Merges(key[kept], whole[kept], part[kept], single[kept], after[kept], box[kept], np.ones(kept.sum(), dtype=bool))


#: Pairs of boxes whose overlap is computed at once.
AT_ONCE = 1 << 20


@dataclass
class Side:
    """Boxes of many pages, one page after another; page r owns the rows from starts[r] to starts[r + 1]."""

    starts: np.ndarray
    boxes: Boxes

    @property
    def page(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def of(self, r: int) -> Boxes:
        return self.boxes.take(slice(self.starts[r], self.starts[r + 1]))


class Batch:
    """Two sides of many pages. Overlaps of all pages are found together; only pages that this
    leaves open (a box with several likely partners) are looked at one by one."""

    def __init__(self, p: Side, g: Side):
        self.p, self.g = p, g
        self.n_pages = len(p.starts) - 1
        self.page_p, self.page_g = p.page, g.page
        found = [self._touching(a, b) for a, b in self._slices()]
        self.i, self.j, self.v = (np.concatenate([f[k] for f in found] or [np.zeros(0, int)]) for k in range(3))
        self.page = self.page_p[self.i]
        self.same = p.boxes.kind[self.i] == g.boxes.kind[self.j]

    def _slices(self):
        """Ranges of predictions with a bounded number of pairs each."""
        pairs = np.cumsum(np.diff(self.g.starts)[self.page_p])
        a = 0
        while a < len(pairs):
            done = pairs[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(pairs, done + AT_ONCE, "right")))
            yield a, b
            a = b

    def _touching(self, a: int, b: int):
        page = self.page_p[a:b]
        per = np.diff(self.g.starts)[page]
        i = np.repeat(np.arange(a, b), per)
        step = np.arange(len(i)) - np.repeat(np.cumsum(per) - per, per)
        j = np.repeat(self.g.starts[page], per) + step
        p, g = self.p.boxes, self.g.boxes
        w = np.minimum(p.x[i] + p.w[i], g.x[j] + g.w[j]) - np.maximum(p.x[i], g.x[j])
        h = np.minimum(p.y[i] + p.h[i], g.y[j] + g.h[j]) - np.maximum(p.y[i], g.y[j])
        met = np.flatnonzero((w > 0) & (h > 0) & p.valid[i] & g.valid[j])
        i, j, inter = i[met], j[met], w[met] * h[met]
        union = p.w[i] * p.h[i] + g.w[j] * g.h[j] - inter
        return i, j, inter / union

    def overlap(self, r: int, same: bool = False) -> np.ndarray:
        """IoU matrix of one page; of boxes of one kind only if ``same``."""
        a, b = np.searchsorted(self.page, [r, r + 1])
        i0, j0 = self.p.starts[r], self.g.starts[r]
        out = np.zeros((self.p.starts[r + 1] - i0, self.g.starts[r + 1] - j0))
        out[self.i[a:b] - i0, self.j[a:b] - j0] = np.where(self.same[a:b], self.v[a:b], 0) if same else self.v[a:b]
        return out

    def _crowded(self, among: np.ndarray, keys_p: np.ndarray, keys_g: np.ndarray, n: int) -> np.ndarray:
        """Which of ``n`` keys have a box that touches two others, counting the touches ``among`` only."""
        out = np.zeros(n, dtype=bool)
        out[keys_p[np.bincount(self.i[among], minlength=len(self.page_p)) > 1]] = True
        out[keys_g[np.bincount(self.j[among], minlength=len(self.page_g)) > 1]] = True
        return out

    def _sure(self, among: np.ndarray, threshold: float, typed: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of all touches: those that every optimum over the touches ``among`` holds, and those that
        clear the threshold and stay open.

        An optimum without a pair gains its overlap by taking it up, and loses at most the other
        overlaps of its two boxes; the penalties of the two pairs that change add up to at most two
        for a pair of unlike kinds, and to none for one of equal kinds.
        """
        i, j, v = self.i[among], self.j[among], self.v[among]
        many_p, many_g = (np.bincount(k, minlength=n) for k, n in ((i, len(self.page_p)), (j, len(self.page_g))))
        sum_p, sum_g = (np.bincount(k, v, n) for k, n in ((i, len(self.page_p)), (j, len(self.page_g))))
        penalty = np.where(self.same[among] | (not typed), 0.0, 2 * TYPE_PENALTY)
        lone = (many_p[i] == 1) & (many_g[j] == 1)
        sure = np.where(lone, v >= penalty, v > sum_p[i] + sum_g[j] - 2 * v + penalty + SLACK)
        taken_p, taken_g = np.zeros(len(many_p), bool), np.zeros(len(many_g), bool)
        taken_p[i[sure]], taken_g[j[sure]] = True, True
        left = (v >= threshold) & ~taken_p[i] & ~taken_g[j] if threshold > 0 else np.ones(len(v), bool)
        out = np.zeros((2, len(self.i)), dtype=bool)
        out[0, among], out[1, among] = sure, left
        return out[0], out[1]

    def pairs(self, threshold: float, typed: bool) -> tuple[np.ndarray, np.ndarray]:
        """Kept pairs of all pages as rows of the two sides, in order."""
        sure, left = self._sure(np.ones(len(self.i), dtype=bool), threshold, typed)
        crowded = np.zeros(self.n_pages, dtype=bool)
        crowded[self.page[left]] = True
        quiet = sure & ~crowded[self.page] & (self.v >= threshold)
        i, j = [self.i[quiet]], [self.j[quiet]]
        for r in np.flatnonzero(crowded):
            kept = assigned(self.p.of(r), self.g.of(r), self.overlap(r), threshold, typed)
            i.append(np.array([a for a, _ in kept], dtype=int) + self.p.starts[r])
            j.append(np.array([b for _, b in kept], dtype=int) + self.g.starts[r])
        i, j = np.concatenate(i), np.concatenate(j)
        order = np.argsort(i, kind="stable")
        return i[order], j[order]

    def records(self, i: np.ndarray, j: np.ndarray, threshold: float, reach: np.ndarray) -> tuple[list, list]:
        """Per page the merges of predictions and of truths that the pairs ``i``, ``j`` leave to be made."""
        return tuple(merged.listed(self.n_pages) for merged in self.merges(i, j, threshold, reach))

    def merges(self, i: np.ndarray, j: np.ndarray, threshold: float, reach: np.ndarray) -> tuple[Merges, Merges]:
        """:meth:`records` as columns, in order of page and target."""
        starts = np.searchsorted(self.page_p[i], np.arange(self.n_pages + 1))

        def one_by_one(r: int):
            a, b = starts[r], starts[r + 1]
            pairs = list(zip(i[a:b] - self.p.starts[r], j[a:b] - self.g.starts[r]))
            return recover_both(self.p.of(r), self.g.of(r), pairs, self.overlap(r), threshold, reach[r])

        splits, merges = self._recovered(self._free(i, j), self.page_p, self.page_g, self.n_pages, threshold, reach, one_by_one)
        for found, parts, wholes in ((splits, self.p, self.g), (merges, self.g, self.p)):
            near = found.fast
            found.target[near] -= wholes.starts[found.key[near]]
            found.sources[near] -= parts.starts[found.key[near], None]
        return splits, merges

    def _recovered(self, among, keys_p, keys_g, n, threshold, reach, one_by_one) -> tuple[Merges, Merges]:
        """Merges of the free touches ``among`` within each of ``n`` keys, as rows of the sides.

        Two parts that touch nothing but one whole are looked at together for all keys; a key with
        any other box of several touches goes to ``one_by_one``, whose numbers count within the key.
        """
        i, j, v = self.i[among], self.j[among], self.v[among]
        n_p, n_g = np.bincount(i, minlength=len(keys_p)), np.bincount(j, minlength=len(keys_g))
        alone_p, alone_g = n_p[i] == 1, n_g[j] == 1
        pair_g = (n_g == 2) & (np.bincount(j[alone_p], minlength=len(keys_g)) == 2)
        pair_p = (n_p == 2) & (np.bincount(i[alone_g], minlength=len(keys_p)) == 2)
        slow = np.zeros(n, dtype=bool)
        slow[keys_p[i[~(alone_p & alone_g) & ~pair_g[j] & ~pair_p[i]]]] = True
        out = []
        quick = ~slow[keys_p[i]]
        for parts, wholes, part, whole, pick, keys in (
            (self.p.boxes, self.g.boxes, i, j, pair_g[j] & quick, keys_g),
            (self.g.boxes, self.p.boxes, j, i, pair_p[i] & quick, keys_p),
        ):
            order = np.lexsort((part[pick], whole[pick]))
            part, whole, overlap = part[pick][order].reshape(-1, 2), whole[pick][order][::2], v[pick][order].reshape(-1, 2)
            out.append(merged_pairs(parts, wholes, part, whole, overlap.max(1, initial=0), keys[whole], threshold, reach))
        singles = [(k, *one_by_one(k)) for k in np.flatnonzero(slow)]
        return tuple(
            found.with_lists([(k, r) for k, *both in singles for r in both[side]]) for side, found in enumerate(out)
        )

    def _free(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Touches between boxes outside the pairs ``i``, ``j``."""
        used_p, used_g = np.zeros(len(self.page_p), bool), np.zeros(len(self.page_g), bool)
        used_p[i], used_g[j] = True, True
        return ~used_p[self.i] & ~used_g[self.j]

    def by_class(self, threshold: float, reach: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Per (page, kind) the counts of a matching within that kind: ``page``, ``kind``, ``tp``,
        ``n_pred``, ``n_gt`` and, if ``reach`` is given, of merges and the boxes they take."""
        kinds = int(max(self.p.boxes.kind.max(initial=0), self.g.boxes.kind.max(initial=0))) + 1
        key_p, key_g = self.page_p * kinds + self.p.boxes.kind, self.page_g * kinds + self.g.boxes.kind
        keys, place = np.unique(np.concatenate([key_p, key_g]), return_inverse=True)
        at_p, at_g, n = place[: len(key_p)], place[len(key_p) :], len(keys)
        sure, left = self._sure(self.same, threshold, False)
        crowded = np.zeros(n, dtype=bool)
        crowded[at_p[self.i[left]]] = True
        quiet = sure & ~crowded[at_p[self.i]] & (self.v >= threshold)
        i, j = [self.i[quiet]], [self.j[quiet]]
        grids: dict[int, np.ndarray] = {}

        def part(k: int):
            """Rows of one (page, kind) on both sides, and their overlaps."""
            r = keys[k] // kinds
            if r not in grids:
                grids.clear()
                grids[r] = self.overlap(r, same=True)
            p0, g0 = self.p.starts[r], self.g.starts[r]
            rows = np.flatnonzero(at_p[p0 : self.p.starts[r + 1]] == k)
            cols = np.flatnonzero(at_g[g0 : self.g.starts[r + 1]] == k)
            return rows + p0, cols + g0, grids[r][np.ix_(rows, cols)]

        for k in np.flatnonzero(crowded):
            rows, cols, overlap = part(k)
            kept = assigned(self.p.boxes.take(rows), self.g.boxes.take(cols), overlap, threshold, False)
            i.append(rows[[a for a, _ in kept]])
            j.append(cols[[b for _, b in kept]])
        i, j = np.concatenate(i), np.concatenate(j)
        out = {
            "page": keys // kinds, "kind": keys % kinds, "tp": np.bincount(at_p[i], minlength=n),
            "n_pred": np.bincount(at_p, minlength=n), "n_gt": np.bincount(at_g, minlength=n),
        }
        if reach is not None:
            mate = np.full(len(at_p), -1)
            mate[i] = j

            def one_by_one(k: int):
                rows, cols, overlap = part(k)
                where = {c: y for y, c in enumerate(cols)}
                pairs = [(x, where[mate[r]]) for x, r in enumerate(rows) if mate[r] >= 0]
                return recover_both(self.p.boxes.take(rows), self.g.boxes.take(cols), pairs, overlap, threshold, reach[keys[k] // kinds])

            both = self._recovered(self._free(i, j) & self.same, at_p, at_g, n, threshold, reach[keys // kinds], one_by_one)
            for name, found in zip(("split", "merge"), both):
                out[f"{name}s"] = np.bincount(found.key, minlength=n)
                out[f"{name}_sources"] = np.bincount(found.key, found.n_sources, n).astype(int)
        return out

    def hits(self, confidence: np.ndarray, thresholds: list[float]) -> np.ndarray:
        """Hit flags [prediction, threshold] of greedy matching by falling confidence within a kind.

        Where a prediction has one truth to take, the first to clear a limit gets it; pages on which
        one has several are walked one by one.
        """
        crowded = np.zeros(self.n_pages, dtype=bool)
        crowded[self.page_p[np.bincount(self.i[self.same], minlength=len(self.page_p)) > 1]] = True
        out = np.zeros((len(self.page_p), len(thresholds)), dtype=bool)
        quiet = np.flatnonzero(self.same & ~crowded[self.page])
        quiet = quiet[np.lexsort((self.i[quiet], -confidence[self.i[quiet]], self.j[quiet]))]
        clears = self.v[quiet, None] >= np.array(thresholds)
        seen = np.cumsum(clears, axis=0) - clears
        truth = self.j[quiet]
        first = np.searchsorted(truth, truth)
        out[self.i[quiet]] = clears & (seen == seen[first])
        for r in np.flatnonzero(crowded):
            a, b = self.p.starts[r], self.p.starts[r + 1]
            out[a:b] = greedy_rows(self.overlap(r, same=True), confidence[a:b], thresholds).T
        return out
