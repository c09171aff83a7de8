"""The pipeline's stages on the smallest tables, each against what its operator's contract says of its own input."""
from collections import Counter

import corpus_pipeline as C
from lamella.llm import queries
from lamella.llm.common import written
from lamella.llm.quality_rules import Rules, judge

SMALL = "/root/testdata/sf0.001"


def words(t):
    return (t or "").encode().lower().split()


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    steps = {}
    assert [n for n, _ in C.STAGES] == ["quality_rules", "exact_dedup", "minhash_near_dedup", "mixing", "best_fit_packing"]
    for name, stage in C.STAGES:
        before = docs
        docs = written(stage(spark, docs, SMALL))
        if name != C.STAGES[-1][0]:
            assert docs.columns == C.DOCUMENT
        steps[name] = ([tuple(r) for r in before.select(*C.DOCUMENT).collect()], docs.collect())
    given, out = steps["quality_rules"]
    want = {d[0]: j[10] for d in given if (j := judge(d[1], Rules()))[6]}
    assert {r.doc_id: r.text for r in out} == want
    given, out = steps["exact_dedup"]
    best = {}
    for d in given:
        best[bytes(d[1].encode()).lower()] = max(best.get(bytes(d[1].encode()).lower(), -1), d[0])
    assert sorted(r.doc_id for r in out) == sorted(best.values())
    given, out = steps["minhash_near_dedup"]
    sets = {d[0]: {tuple(words(d[1])[i:i + 5]) for i in range(max(1, len(words(d[1])) - 4))} for d in given}
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in out) == sorted(i for i in root if root[i] == i)
    given, out = steps["mixing"]
    size = Counter()
    for d in given:
        size[d[0]] += len(words(d[1]))
    took = Counter()
    for r in out:
        took[r.doc_id] += len(words(r.text))
    assert all(took[i] <= 2 * size[i] for i in took) and set(took) <= set(size)
    assert abs(sum(took.values()) - 1.5 * sum(size.values())) < 64 * 21
    given, out = steps["best_fit_packing"]
    fill = Counter()
    for r in out:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= 1.02 * -(-sum(fill.values()) // 2048) + 1


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) < set(queries.QUERIES)


def test_dedup_stages_with_null_and_repeated_ids(spark):
    a, b, c = ("".join(f"{x}{i} " for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (9, a), (7, c), (7, c), (None, c), (None, "n"), (None, "n"), (3, b.upper())]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], ", ".join(f"{n} {k}" for n, k in zip(C.DOCUMENT, ("long", "string", "string", "string", "long"))))
    left = lambda d: sorted(((r.doc_id, r.text.lower()) for r in d.collect()), key=repr)
    assert left(C.exact(spark, docs, SMALL)) == sorted([(5, b), (9, a), (7, c), (None, "n")], key=repr)
    near = [(5, a), (5, b), (9, a + "tail"), (7, c), (7, c), (None, c + "tail"), (None, "n " * 9), (None, "n " * 9)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in near], docs.schema)
    assert left(C.near(spark, docs, SMALL)) == sorted([(5, a), (5, b), (7, c), (None, "n " * 9)], key=repr)
    assert C.near(spark, docs.where("false"), SMALL).collect() == [] == C.exact(spark, docs.where("false"), SMALL).collect()
