"""Vector codes against plain averaging rounds, and the bounds against exact distances."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from bidloom.llm import vector_codes


def plain(rows, parts, k, rounds, scale=1024):
    """vec_id -> (code, error), summed errors by label and the checksum, by comparing everything with everything."""
    usable = [r for r in rows if r[1] and len(r[1]) % parts == 0 and all(v is not None and math.isfinite(v) for v in r[1])]
    usable.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in usable if len(r[1]) == len(usable[0][1])]
    width = len(kept[0][1]) // parts
    x = [[tuple(math.floor(scale * v) for v in r[1][p * width : (p + 1) * width]) for p in range(parts)] for r in kept]
    books = [[v[p] for v in x[:k]] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in x:
                groups.setdefault(nearest(p, v[p])[1], []).append(v[p])
            books[p] = [tuple(sum(c) // len(groups[e]) for c in zip(*groups[e])) if e in groups else old for e, old in enumerate(books[p])]
    out, by_label = [], {}
    for r, v in zip(kept, x):
        found = [nearest(p, v[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        out.append((r[0], "".join(f"{e:02x}" for _, e in found), error, r[2]))
        by_label[r[2]] = by_label.get(r[2], 0) + error
    digest = hashlib.sha256(",".join(str(n) for p in books for c in p for n in c).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=str)


def drawn(n, dim, seed, grain=1 / 64):
    """Clustered vectors on a coarse grid, so that distances tie, with copies."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(dim)] for _ in range(12)]
    rows = []
    for i in range(n):
        v = [math.floor((c + rng.gauss(0, 0.08)) / grain) * grain for c in rng.choice(centres)]
        rows.append((i * 3 % n, v if i % 7 else rows[i // 2][1] if i else v, rng.choice((None, 1, 2, 2, 2))))
    return rows


@pytest.mark.parametrize("k,near,rounds,seed", [(40, 4, 4, 1), (40, 16, 6, 2), (256, 8, 4, 3), (3, 16, 5, 4), (1, 16, 2, 5), (40, 16, 0, 6)])
def test_codes(spark, k, near, rounds, seed):
    rows = drawn(300, 8, seed)
    bad = [(900, None, 1), (901, [0.5, None] * 4, 1), (902, [math.nan] * 8, 1), (903, [math.inf] + [0.0] * 7, 2), (904, [], 1), (905, [0.1] * 12, 1), (906, [0.2] * 7, 1)]
    odd = [(None, rows[3][1], 2), (None, rows[4][1], None), (rows[5][0], rows[5][1], 1), (rows[6][0], rows[7][1], 1)]
    rows = rows + bad + odd
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS x", "2 AS near", "3 AS part", "4 AS error")
    got = vector_codes.encode_with_errors(frame.repartition(4), entries=k, rounds=rounds, near=near)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 4, k, rounds)


def test_bounds_under_moves():
    """Many rounds of random moves, small and large: assignments stay the nearest entries, ties to the lower index."""
    rng = np.random.default_rng(3)
    x = rng.integers(-60, 60, (800, 3))
    entries = rng.integers(-60, 60, (50, 3))
    bounds, kept, used = vector_codes.search_all(x, entries, 6), 6, set()
    for r in range(40):
        moves = rng.integers(-2, 3, entries.shape) * (rng.random((50, 1)) < rng.choice((0.1, 0.9))) * (1 if r % 9 else 12)
        after = entries + moves
        moved = np.nextafter(np.sqrt((moves * moves).sum(axis=1).astype(float)), np.inf) * moves.any(axis=1)
        near, both = vector_codes._packed([bounds])
        [bounds] = vector_codes._unpacked(near, both, [kept])  # through the stored form
        bounds, needed = vector_codes.reassign(x, after, moved, bounds)
        exact = vector_codes.exact_distances(x, after)
        assert (bounds.near[:, 0] == exact.argmin(axis=1)).all(), r
        used |= {int(needed.min()), int(needed.max())}
        entries, kept = after, int(rng.choice((4, 6, 9)))
        bounds = vector_codes.resized(bounds, kept)
        beyond = exact.astype(float).copy()
        np.put_along_axis(beyond, bounds.near, np.inf, axis=1)
        assert (bounds.lower[:, -1] <= np.sqrt(beyond.min(axis=1)) + 1e-9).all()
    assert 1 in used and max(used) > 6


def test_large_components_are_held(spark):
    rows = [(i, [s * 3e38, 1.0, -1.0, 0.0], None) for i, s in enumerate((1, -1, 1))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    codes, entries = vector_codes.encode(frame, entries=2)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in codes.collect()} == {0: ("00000000", 0), 1: ("01000000", 0), 2: ("00000000", 0)}
    assert abs(entries).max() == vector_codes.largest(4)


def test_no_vectors(spark):
    frame = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    for none in (frame, frame.filter("false")):
        got = vector_codes.encode_with_errors(none)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 0


def test_bounds_save_work():
    """When little moves, few parts need more than their own entry."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-900, 900, (64, 8))
    x = centres[rng.integers(0, 64, 2000)] + rng.integers(-20, 20, (2000, 8))
    bounds = vector_codes.search_all(x, centres, 8)
    moves = rng.integers(-1, 2, centres.shape)
    moved = np.nextafter(np.sqrt((moves * moves).sum(axis=1).astype(float)), np.inf)
    _, needed = vector_codes.reassign(x, centres + moves, moved, bounds)
    assert (needed == 1).mean() > 0.9
