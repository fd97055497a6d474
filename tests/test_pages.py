"""Page kernels against exhaustive search on small pages, and the recovery rules by hand."""

import itertools
import random

import numpy as np
import pytest

from gradeline.functions import pages as pg


def make(*rows):
    return pg.boxes([
        {"kind": k, "bbox": None if b is None else dict(zip("xywh", b))} for k, b in rows
    ])


def best_total(cost):
    n, m = cost.shape
    if n > m:
        return best_total(cost.T)
    return min(sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n))


def test_assignment_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(200):
        cost = rng.random((rng.integers(1, 6), rng.integers(1, 7)))
        pairs = pg.assign(cost)
        assert len(pairs) == min(cost.shape)
        assert len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs})
        assert sum(cost[i, j] for i, j in pairs) == pytest.approx(best_total(cost))


def test_shortcut_agrees_with_full_assignment():
    rng = random.Random(5)
    for _ in range(300):
        rows = lambda n: make(*[
            (rng.choice("ab"), (rng.randrange(4) * 40, rng.randrange(4) * 40, rng.randint(20, 39),
                                rng.randint(20, 39))) for _ in range(n)])
        p, g = rows(rng.randint(1, 5)), rows(rng.randint(1, 5))
        overlap = pg.iou_grid(p, g)
        cost = 1 - overlap + 0.25 * (p.kind[:, None] != g.kind)
        kept, _ = pg.match(p, g, 0.55, True)
        full = sorted((i, j) for i, j in pg.assign(cost) if overlap[i, j] >= 0.55)
        assert sum(overlap[i, j] for i, j in kept) == pytest.approx(
            sum(overlap[i, j] for i, j in full))


def test_low_overlap_and_missing_boxes_do_not_match():
    assert pg.match(make(("t", (0, 0, 100, 100))), make(("t", (80, 80, 100, 100))), 0.5, True)[0] == []
    assert pg.match(make(("t", None)), make(("t", (0, 0, 9, 9))), 0.5, True)[0] == []
    assert pg.match(make(), make(("t", (0, 0, 9, 9))), 0.5, True)[0] == []


def test_split_is_recovered_and_type_of_the_group_is_free():
    p = make(("text", (0, 0, 100, 45)), ("text", (0, 50, 100, 45)))
    g = make(("table", (0, 0, 100, 100)))
    pairs, splits, merges = pg.match_with_recovery(p, g, 0.5, 20, True)
    assert pairs == [] and merges == []
    assert splits[0]["sources"] == [0, 1] and splits[0]["target"] == 0
    assert splits[0]["after"] > splits[0]["before"]


def test_merge_is_recovered_the_other_way():
    g = make(("text", (0, 0, 100, 45)), ("text", (0, 50, 100, 45)))
    p = make(("text", (0, 0, 100, 100)))
    pairs, splits, merges = pg.match_with_recovery(p, g, 0.5, 20, True)
    assert (pairs, splits) == ([], []) and merges[0]["sources"] == [0, 1]


def test_far_or_mixed_parts_do_not_merge():
    far = make(("text", (0, 0, 100, 30)), ("text", (0, 70, 100, 30)))
    g = make(("text", (0, 0, 100, 100)))
    assert pg.match_with_recovery(far, g, 0.5, 20, True)[1] == []
    mixed = make(("text", (0, 0, 100, 45)), ("table", (0, 50, 100, 45)))
    assert pg.match_with_recovery(mixed, g, 0.5, 20, True)[1] == []


def test_groups_are_transitive():
    b = make(*[("t", (0, 30 * i, 10, 20)) for i in range(4)], ("t", (500, 0, 10, 20)))
    assert pg.adjacent_groups(b, [0, 1, 2, 3, 4], 15) == [[0, 1, 2, 3], [4]]


def test_greedy_takes_best_free_truth_by_confidence():
    p = make(("t", (0, 0, 10, 10)), ("t", (0, 0, 10, 9)))
    g = make(("t", (0, 0, 10, 10)))
    hits = pg.greedy_hits(p, g, np.array([0.2, 0.9]), [0.5, 0.95])
    assert hits.tolist() == [[False, True], [True, False]]
