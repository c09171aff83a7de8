"""Exact and near deduplication against brute force."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import near_dedup as N
from lamella.llm.exact_dedup import exact_dedup

ROWS = [(1, "Same text", "x"), (2, "sAME tEXT", "y"), (3, None, "z"), (4, "", None), (5, "É", "a"), (6, "é", "b"), (7, "other", None),
        (7, "other", None), (None, "other", "c"), (None, "lonely", "d"), (9, "a" * 200_000, "e"), (8, "A" * 200_000, "e")]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def frame(spark, rows=ROWS):
    # columns named like the operators' own
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id string").withColumn("digest", F.lit(1)).withColumn("id", F.lit(2)).repartition(3)


@pytest.mark.parametrize("digest", [None, lambda n: F.length(n).cast("string")])
def test_exact_dedup(spark, digest):
    out = exact_dedup(frame(spark), **({"digest": digest} if digest else {})).collect()
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(lower(t), []).append(i)
    want = sorted(((i, max((x for x in groups[lower(t)] if x is not None), default=None), len(groups[lower(t)])) for i, t, _ in ROWS), key=repr)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in out), key=repr) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out)
    if not digest:
        assert {r.digest for r in out} == {hashlib.sha256(t.encode()).hexdigest() for t in groups}


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(frame(spark).where("false")).collect() == []


def shingles(t, k=5):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, percent):
    sets = {}
    for i, t in rows:
        if shingles(t):
            sets.setdefault(shingles(t), []).append(i)
    keys = list(sets)
    root = {s: s for s in keys}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for a in range(len(keys)):
        for b in range(a):
            x = len(keys[a] & keys[b])
            if 100 * x >= percent * (len(keys[a]) + len(keys[b]) - x):
                root[find(keys[a])] = find(keys[b])
    least = {}
    for s, ids in sets.items():
        for i in ids:
            if i is not None:
                r = id(find(s))
                least[r] = min(least.get(r, i), i)
    return sorted(((i, len(shingles(t)), None if i is None else least[id(find(shingles(t)))] if shingles(t) else i) for i, t in rows), key=repr)


def edited(words, rng, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(w)


def near_rows():
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE two"), (None, "one two"), (6, "a b c d e"), (6, "a b c d e"), (7, "x " * 30_000), (8, "x " * 20_000)]
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows += [(100 + i, edited(base, rng, rng.randrange(14))) for i in range(150)]       # similarities on both sides of the threshold
    chain = [f"c{i}" for i in range(400)]
    rows += [(1000 - i, " ".join(chain[5 * i:5 * i + 200])) for i in range(30)]         # neighbours linked, ends far apart
    rows += [(2000 + i, " ".join(f"u{rng.randrange(10 ** 5)}" for _ in range(rng.randrange(1, 60)))) for i in range(100)]
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup_equals_brute_force(spark, percent):
    rows = near_rows()
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("comp", F.lit(1)).repartition(4)
    out = N.near_dedup(d, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == brute(rows, percent)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out)


def test_near_dedup_without_links_or_rows(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert [r.component_id for r in N.near_dedup(d).orderBy("doc_id").collect()] == [1, 2]
    assert N.near_dedup(d.where("false")).collect() == []


def test_small_blocks_lose_no_link(spark, monkeypatch):
    """Buckets of more than one block: every two blocks still meet."""
    dealt = N.dealt
    monkeypatch.setattr(N, "dealt", lambda rest, block=1024: dealt(rest, 8))
    rows = near_rows()
    out = N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == brute(rows, 85)


def test_registers_are_mergeable_and_locality_sensitive():
    rng = np.random.default_rng(1)
    spec = N.SketchSpec(bands=200, rows=10)
    with np.errstate(over="ignore"):
        for jaccard in (0.3, 0.6, 0.85):
            n = 2000
            common = int(n * 2 * jaccard / (1 + jaccard))
            x = N.mixed(rng.integers(0, 1 << 62, 2 * n - common).astype(np.uint64))
            a, b = x[:n], x[n - common:]
            ra, rb = N.registers(a, spec), N.registers(b, spec)
            assert (N.merge(ra, rb) == N.registers(np.union1d(a, b), spec)).all()
            assert abs((ra == rb).mean() - jaccard) < 5 * (jaccard * (1 - jaccard) / spec.m) ** 0.5
            size = np.array([n])
            slope = lambda j: N.likelihood_slope(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), spec.m, size, size, j, spec.base)[0]
            assert slope(jaccard - 0.06) > 0 > slope(min(0.99, jaccard + 0.06))


def test_components(spark):
    from lamella.llm.graph import components
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
