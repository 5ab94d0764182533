"""Centroids, vector codes and source mixes against brute force: nulls, repeats, ties, other lengths, huge numbers, empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from quillspark.llm import centroids, codes, mixing, vectors

LONGEST = (1 << 63) - 1
VECTORS = "vec_id long, embedding array<double>, label int, v string, cluster string, n int, source string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", 1, "s") for i, v, label in rows], VECTORS)


def usable(rows, dims):
    return [(i, v, label) for i, v, label in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]


def whole(v, scale):
    return tuple(max(-vectors.LIMIT, min(vectors.LIMIT, math.floor(scale * x))) for x in v)


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def means(members, old):
    return tuple(sum(c) // len(members) for c in zip(*members, strict=True)) if members else old


def odd_rows(dims, seed, n=300):
    rng = random.Random(seed)
    grid = lambda: [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5]) for _ in range(dims)]  # noqa: E731  many ties
    some = [grid() for _ in range(40)]
    rows = [(rng.randrange(1000), rng.choice(some) if rng.random() < 0.6 else [rng.gauss(0, 0.3) for _ in range(dims)], rng.choice([None, 1, 2])) for _ in range(n)]
    bad = [None, [], [0.1] * (dims - 1), [0.1] * (dims + 1), [None] + [0.1] * (dims - 1), [float("nan")] * dims, [float("inf")] * dims]
    return rows + [(2000 + i, v, 1) for i, v in enumerate(bad)] + [(None, grid(), None), (5, [1e30] * dims, 2), (6, [-1e300] * dims, 2), (7, [30000.0] * dims, None)] + [(9, some[0], 3)] * 50


def clusters(rows, dims, scale, k, rounds):
    kept = [(i, whole(v, scale)) for i, v, _ in usable(rows, dims)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    now = [v for _, v in order[:k]]
    for turn in range(rounds + 1):
        at = [min(range(len(now)), key=lambda c: (apart(v, now[c]), c)) for _, v in kept]
        if turn < rounds:
            now = [means([v for (_, v), c in zip(kept, at, strict=True) if c == j], now[j]) for j in range(len(now))]
    inertia = defaultdict(int)
    for (_, v), c in zip(kept, at, strict=True):
        inertia[c] += apart(v, now[c])
    fits = lambda n: min(n, LONGEST)
    return [(i, c, apart(v, now[c]), fits(inertia[c]), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for (i, v), c in zip(kept, at, strict=True)]


@pytest.mark.parametrize(("dims", "k", "rounds"), [(8, 16, 5), (3, 40, 4), (8, 1, 2), (64, 500, 2)])
def test_clusters_equal_brute_force(spark, dims, k, rounds):
    rows = odd_rows(dims, dims + k)
    got = centroids.cluster_vectors(table(spark, rows), dims=dims, k=k, rounds=rounds)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, clusters(rows, dims, 64, k, rounds)))


def test_bounds_certify_and_shrink():
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(2000, 6)) * 100).astype(np.int64)
    now = v[:32].copy()
    bounds = centroids.compared_with_all(v, now, 8)
    for size in (8, 5, 2, 1):
        new = now + rng.integers(-9, 10, now.shape)
        drift = np.sqrt(vectors.squared(new, now)) * (1 + centroids.EPS)
        now, bounds = new, centroids.moved(v, bounds.shortened(size), new, drift)
        exact = vectors.squared_all(v, now)
        order = np.argsort(exact, axis=1, kind="stable")
        assert (bounds.cluster == order[:, 0]).all()
        assert (bounds.upper >= np.sqrt(exact[np.arange(2000), bounds.cluster])).all()
        listed = np.take_along_axis(exact, bounds.near, 1)
        assert (bounds.lower[:, :size] <= np.sqrt(listed)).all()
        others = np.ones(exact.shape, bool)
        np.put_along_axis(others, np.concatenate([bounds.cluster[:, None], bounds.near], 1), False, 1)
        assert (bounds.lower[:, size] <= np.sqrt(np.where(others, exact, np.iinfo(np.int64).max).min(1))).all()
        assert (bounds.depth == 0).mean() > 0.3


def coded(rows, dims, scale, parts, entries, rounds):
    kept = [(i, whole(v, scale), label) for i, v, label in usable(rows, dims)]
    w = dims // parts
    cut = lambda v: [v[p * w : p * w + w] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    for turn in range(rounds + 1):
        at = [[min(range(len(books[p])), key=lambda e: (apart(x, books[p][e]), e)) for p, x in enumerate(cut(v))] for _, v, _ in kept]
        if turn < rounds:
            books = [[means([cut(v)[p] for (_, v, _), a in zip(kept, at, strict=True) if a[p] == e], books[p][e]) for e in range(len(books[p]))] for p in range(parts)]
    error = [sum(apart(x, books[p][a[p]]) for p, x in enumerate(cut(v))) for (_, v, _), a in zip(kept, at, strict=True)]
    return [(i, label, bytes(a).hex(), e) for (i, _, label), a, e in zip(kept, at, error, strict=True)], books


@pytest.mark.parametrize(("dims", "parts", "entries", "rounds"), [(8, 4, 16, 6), (6, 1, 30, 3), (4, 4, 250, 2)])
def test_codes_equal_brute_force(spark, dims, parts, entries, rounds):
    rows = [r for r in odd_rows(dims, dims + parts) if r[1] is None or 1e30 not in r[1]]
    got, books = codes.compress_vectors(table(spark, rows), dims=dims, parts=parts, entries=entries, rounds=rounds)
    want, expected = coded(rows, dims, 4096, parts, entries, rounds)
    assert books.tolist() == [[list(e) for e in b] for b in expected]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_label_errors_with_a_hot_and_a_null_label(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(64)], None if i % 3 else i % 7) for i in range(200)]
    got = codes.digest(table(spark, rows)).collect()
    want, books = coded(rows, 64, 4096, 8, 16, 6)
    total = defaultdict(int)
    for _, label, _, e in want:
        total[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert sorted(map(tuple, got)) == sorted((i, c, e, total[label], digest) for i, label, c, e in want)


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1), (2, [0.5], None)]):
        assert centroids.cluster_vectors(table(spark, rows)).collect() == [] == codes.digest(table(spark, rows)).collect()


# ---- mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes, weights, share, repeat):
    """Exact targets by resharing the excess round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), Fraction(share) * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > repeat * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: Fraction(repeat * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def mixed(rows, weights=(3, 1, 2), share=1.5, repeat=2):
    sizes, order, out = defaultdict(int), defaultdict(list), []
    for i, text, source in rows:
        size = len(WORD.findall(text or ""))
        sizes[source] += size
        order[source].append((hashlib.md5(f"{'' if i is None else i}:{text or ''}".encode()).hexdigest(), i, size))
    target = shares(sizes, weights, share, repeat)
    for source, members in order.items():
        budget, before = math.floor(target[source]), 0
        for _, i, size in sorted(members, key=lambda m: m[0]):
            whole_times, left = divmod(budget, sizes[source]) if sizes[source] else (0, 0)
            out.append((i, size, sizes[source], round(float(target[source]), 6), whole_times * size + max(0, min(left - before, size))))
            before += size
    return out


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, "z") for i, t, s in rows], "doc_id long, text string, source string, size int, row int, key string")


@pytest.mark.parametrize("seed", range(3))
def test_mix_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    names = ["a", "B", "é", "z", "", None, "𝒳", "￿"]
    text = lambda: rng.choice([None, "", " \t", "one", " ".join(["w"] * rng.randrange(400)), "ä\x1cb c\x0bd"])
    rows = [(rng.randrange(200), text(), "a" if rng.random() < 0.4 else rng.choice(names)) for _ in range(400)]
    rows += [(i, None, "empty") for i in range(5)] + [(None, "left over text", None)] * 30 + [(7, "again and again", "a")] * 20
    got = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix_documents(corpus(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, mixed(rows)))
    assert all(r[4] <= 2 * r[1] for r in got)


def test_mix_is_whole_at_every_number_of_ranges(spark):
    rows = [(i, "w " * (i % 50), f"s{i % 3}" if i % 3 else "hot") for i in range(3000)]
    docs = corpus(spark, rows)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("1", "3", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(tuple, mixing.mix_documents(docs.repartition(5)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert seen[0] == seen[1] == seen[2]
    taken, target = defaultdict(int), {}
    for i, _, _, t, n in seen[0]:
        taken[rows[i][2]] += n
        target[rows[i][2]] = t
    assert all(taken[s] == math.floor(target[s]) for s in taken)


def test_mix_of_nothing(spark):
    assert mixing.mix_documents(corpus(spark, [])).collect() == []
    got = mixing.mix_documents(corpus(spark, [(1, None, None), (2, " ", "a")])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
