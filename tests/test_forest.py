"""Distributed forests against trees grown one by one."""
import numpy as np

from lamella.operators import forest as R


def data(n=40, p=7, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(p, n)).round(1)
    x[3, 5] = np.nan
    x[-1] = 2.0
    y = (x[0] + 0.3 * rng.normal(size=n) > 0).astype(int)
    return x, y


def grow(x, y, names, train, seed, run, tree, mtry):
    """One tree, node by node, numbered level by level as the operator does; splits by node and class by leaf."""
    n = len(y)
    w = R.bootstrap(seed, run, tree, train, n)
    filled = [np.where(np.isnan(v), np.nanmean(v[train]), v) for v in x]
    level, fresh, splits, leaves = [(0, np.arange(n), 0)], 1, {}, {}
    while level:
        found = {}
        for node, own, tried in level:
            bag = np.repeat(own, w[own])
            k = y[bag].sum()
            if k in (0, len(bag)) or tried > 1:
                leaves[node] = int(2 * k >= len(bag))
                continue
            best = None
            for j in sorted(range(len(x)), key=lambda j: names[j]):
                if not tried and not R.mixed(seed, run, tree, node, R.feature_number(*names[j])) < np.uint64(int(mtry / len(x) * (2 ** 64 - 1))):
                    continue
                values = np.unique(filled[j][train])
                for cut in (values[1:] + values[:-1]) / 2:
                    sides = [bag[filled[j][bag] <= cut], bag[filled[j][bag] > cut]]
                    if min(map(len, sides)):
                        g = round(sum((y[s].sum() ** 2 + (1 - y[s]).sum() ** 2) / len(s) for s in sides) - (k ** 2 + (len(bag) - k) ** 2) / len(bag), 9)
                        if g > 0 and (best is None or g > best[0]):
                            best = (g, j, cut)
            found[node] = best, own, tried
        level = []
        for node in sorted(found):
            best, own, tried = found[node]
            if best is None:
                level.append((node, own, tried + 1))
                continue
            _, j, cut = best
            splits[node] = (j, cut, fresh)
            level += [(fresh, own[filled[j][own] <= cut], 0), (fresh + 1, own[filled[j][own] > cut], 0)]
            fresh += 2
    return w, filled, splits, leaves


def walk(splits, leaves, value):
    node = 0
    while node in splits:
        j, cut, left = splits[node]
        node = left if value(j) <= cut else left + 1
    return leaves[node]


def test_forest_equals_trees_grown_one_by_one(spark):
    x, y = data()
    names = [("a", f"f{j}") for j in range(4)] + [("b", f"f{j}") for j in range(3)]
    vecs = spark.createDataFrame([(*n, v.tolist()) for n, v in zip(names, x)], "layer string, feature string, vec array<double>").repartition(3)
    runs, trees, mtry = [(1, np.arange(0, 28)), (2, np.arange(10, 40))], 12, 2
    prob, scores = R.forest(vecs, runs, y, trees, seed=5)
    got = {(r.run, r.layer, r.feature): r.score for r in scores.collect()}
    assert len(got) == 14
    for run, train in runs:
        falls, vote = np.zeros((trees, len(x))), np.zeros((trees, len(y)))
        for t in range(trees):
            w, filled, splits, leaves = grow(x, y, names, train, 5, run, t, mtry)
            vote[t] = [walk(splits, leaves, lambda j: filled[j][i]) for i in range(len(y))]
            bag = train[w[train] == 0]
            right = (vote[t][bag] == y[bag]).sum()
            for j in {s[0] for s in splits.values()}:
                order = bag[np.argsort(R.mixed(5, run, t, R.feature_number(*names[j]), bag), kind="stable")]
                new = [walk(splits, leaves, lambda q: filled[q][o if q == j else i]) for i, o in zip(bag, order)]
                falls[t, j] = (right - (new == y[bag]).sum()) / len(bag)
        assert np.allclose(prob[run], vote.mean(0))
        m, se = falls.mean(0), np.sqrt(np.maximum((falls ** 2).mean(0) - falls.mean(0) ** 2, 0) / trees)
        want = np.where(se < 1e-15, m, m / np.where(se > 0, se, 1))
        assert np.allclose([got[(run, *n)] for n in names], want, atol=1e-9)
        assert max(got, key=got.get)[1:] == ("a", "f0") and got[(run, "b", "f2")] == 0


def test_small_forest_separates():
    x, y = data(200, 5, seed=3)
    x = np.nan_to_num(x).T
    prob, fall = R.small_forest(x[:150], y[:150], x[150:], trees=40)
    assert ((prob > 0.5) == y[150:]).mean() > 0.85 and fall.argmax() == 0
    only = R.small_forest(x[:20], np.ones(20), x[20:25], trees=3)
    assert only[0].tolist() == [1.0] * 5 and not only[1].any()
