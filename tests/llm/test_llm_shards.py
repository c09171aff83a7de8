"""Shards of equal bytes, spelling variants and vector codes against brute force."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import metric_tree as M, sharding, spelling as S, vector_codes as V


def cut(rows, shards, overhead=16):
    rows = sorted(((i is not None, i, len((t or "").encode()) + overhead, zlib.crc32((t or "").encode())) for i, t in rows), key=lambda r: (r[0], r[1] or 0, *r[2:]))
    total, before, slots, out = sum(r[2] for r in rows), 0, Counter(), []
    for _, i, size, crc in rows:
        shard = min((2 * before + size) * shards // (2 * total), shards - 1)
        out.append((i, size, crc, "bytes", shard, slots[shard], None))
        slots[shard] += 1
        before += size
    return out


def test_shards_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PER_RANGE", 50)
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", "é" * rng.randrange(300), "\U0001F600 text " * rng.randrange(9)])) for i in range(300)]
    rows += [(7, "same")] * 150 + [(None, None)] * 20 + [(None, "x")] * 30 + [(400, "long " * 40_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash")).withColumn("_range", F.lit(0)).repartition(5)
    for shards in (40, 1, 7):
        got = [tuple(r) for r in sharding.byte_shards(d, shards=shards).collect()]
        assert sorted(got, key=repr) == sorted(cut(rows, shards), key=repr)
    even = [(i, "w" * rng.randrange(100)) for i in range(4000)]
    sizes = Counter()
    for r in sharding.byte_shards(spark.createDataFrame(even, "doc_id long, text string")).collect():
        sizes[r.shard] += r["size"]
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) < 2 * 116
    assert sharding.byte_shards(d.where("false")).collect() == []


def variants(rows, least=6, times=5, ratio=5, every=199):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= times}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:p] + b[p + 1:] == a for p in range(len(b)))

    out = {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= ratio * n[w] else None
        out[w] = [w, form, w, n[w], len(close), n[form] if form else None]
    for w, row in out.items():
        while out[row[2]][1]:
            row[2] = out[row[2]][1]
    return sorted(map(tuple, out.values()))


def spelled():
    rng = random.Random(2)
    letters = "abÀßÿ÷"
    base = ["".join(rng.choices(letters, k=rng.randrange(6, 9))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "q" * 70, "q" * 71, "q" * 70 + "r", "Straße", "straßen", "STRASSE"]
    rows = []
    for i in range(400):
        w = [rng.choice(base[: 1 + i % len(base)]) for _ in range(12)]
        rows.append((i, rng.choice([" ", ", ", "1", "Ā", "\U0001F600"]).join(w)))
    long = "z" * 3000
    rows += [(700, "kettel " * 5 + "kettele " * 26 + "ketteler " * 135)]
    return rows + [(None, "aaaaaa straße"), (None, None), (5, ""), (5, "straße " * 200), (5, "straße " * 200), (900, f"{long} " * 5 + f"y{long} " * 30)]


def test_spelling_variants_equal_brute_force(spark):
    rows = spelled()
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(0)).repartition(3)
    for every in (199, 3):
        got = sorted(tuple(r) for r in S.spelling_variants(d, typo_every=every).collect())
        want = variants(rows, every=every)
        assert got == want and any(r[1] for r in want)
        assert every == 3 or any(r[2] != r[1] for r in want if r[1])
    assert S.spelling_variants(d.where("false")).collect() == []


def test_no_pair_is_lost_when_the_filters_are_full(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAST_BLOCKS", 1)
    rows = spelled()
    d = spark.createDataFrame(rows, "doc_id long, text string")
    tables = {}
    whole = S.filters
    monkeypatch.setattr(S, "filters", lambda v, mb: tables.setdefault("t", whole(v, 0)))
    got = sorted(tuple(r) for r in S.spelling_variants(d).collect())
    assert got == variants(rows) and all(len(t) == 1 for t in tables["t"].values())


def test_a_ratio_that_chains_in_circles_is_refused(spark):
    with pytest.raises(ValueError):
        S.spelling_variants(spark.createDataFrame([], "doc_id long, text string"), ratio=1)


def test_trees_assign_as_brute_force():
    rng = np.random.default_rng(3)
    for n, spread in ((1, 50), (500, 3), (3000, 4000), (900, 1), (2000, 1 << 26)):
        x = rng.integers(-spread, spread, (n, 8))
        if n == 900:
            x[:400] = 5
        t = M.build(x)
        assert sorted(t.row.tolist()) == list(range(n)) and (t.points == x[t.row]).all()
        for entries in (x[rng.integers(0, n, 16)], rng.integers(-spread, spread + 1, (16, 8)), np.zeros((3, 8), np.int64), np.array([[0] * 8, [1] + [0] * 7])):
            best = ((t.points[:, None] - entries[None]) ** 2).sum(-1).argmin(1)
            ball, owner, point, entry = M.assign(t, entries)
            got = np.full(n, -1)
            got[point] = entry
            for b, o in zip(ball, owner):
                assert (got[t.lo[b]:t.hi[b]] == -1).all()
                got[t.lo[b]:t.hi[b]] = o
                assert (t.total[b] == t.points[t.lo[b]:t.hi[b]].sum(0)).all()
            assert (got == best).all()


def test_trees_spare_work():
    """With far groups of points, balls are owned whole."""
    rng = np.random.default_rng(4)
    centre = rng.integers(-40_000, 40_000, (16, 8))
    x = centre[rng.integers(0, 16, 4000)] + rng.integers(-100, 100, (4000, 8))
    ball, _, point, _ = M.assign(M.build(x), centre)
    assert len(point) == 0 and len(ball) < 200


def fitted(rows, parts=8, entries=16, rounds=6):
    whole = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))
    dim = next(len(r[1]) for r in whole if len(r[1]))
    whole = [r for r in whole if len(r[1]) == dim]
    v = np.array([[int(np.floor(4096 * float(x))) for x in r[1]] for r in whole], object).reshape(len(whole), parts, dim // parts)
    books = [[v[i, p].copy() for i in range(min(entries, len(v)))] for p in range(parts)]

    def nearest(p):
        d = [[sum((a - b) ** 2) for b in books[p]] for a in v[:, p]]
        return [row.index(min(row)) for row in d], [min(row) for row in d]

    for _ in range(rounds):
        for p in range(parts):
            best, _ = nearest(p)
            for e in range(len(books[p])):
                own = [v[i, p] for i in range(len(v)) if best[i] == e]
                if own:
                    books[p][e] = sum(own) // len(own)
    best, square = zip(*[nearest(p) for p in range(parts)])
    import hashlib
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(s[i] for s in square) for i in range(len(v))]
    label = Counter()
    for r, e in zip(whole, error):
        label[r[2]] += e
    return [(r[0], "".join(f"{b[i]:02x}" for b in best), error[i], label[r[2]], digest) for i, r in enumerate(whole)]


def test_vector_codes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).tolist(), i % 4 if i % 5 else None) for i in range(200)]
    rows += [(i, [1.0] * 16, 1) for i in range(300, 360)] + [(3, [0.25] * 16, 0)] * 3 + [(None, [0.5] * 16, None)] * 2
    bad = [(-1, None, 0), (-2, [None] * 16, 0), (-3, [float("nan")] * 16, 0), (-4, [float("inf")] + [0.0] * 15, 0), (-5, [], 0), (500, [1.0] * 8, 0)]
    d = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("clash")).withColumn("id", F.lit(0)).repartition(3)
    for chunk in (4096, 50):
        got = [tuple(r) for r in V.vector_codes(d, chunk=chunk).collect()]
        assert sorted(got, key=repr) == sorted(fitted(rows + bad), key=repr)
    few = d.where("vec_id IN (1, 2, 3)")
    assert sorted(map(tuple, V.vector_codes(few).collect()), key=repr) == sorted(fitted([r for r in rows if r[0] in (1, 2, 3)]), key=repr)
    for none in (d.where("false"), d.where("vec_id < 0"), spark.createDataFrame([(1, [1.0] * 9, 0)], "vec_id long, embedding array<double>, label int")):
        assert V.vector_codes(none).collect() == []
    with pytest.raises(Exception, match="component out of range"):
        V.vector_codes(spark.createDataFrame([(1, [1e9] * 8, 0)], "vec_id long, embedding array<double>, label int")).collect()


def test_session_settings_come_back(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(k) for k in keys]
    V.vector_codes(spark.createDataFrame([(1, [1.0] * 8, 0)], "vec_id long, embedding array<double>, label int")).collect()
    S.spelling_variants(spark.createDataFrame([(1, "straße " * 9)], "doc_id long, text string")).collect()
    assert [spark.conf.get(k) for k in keys] == before
