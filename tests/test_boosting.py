"""Boosted trees against a plain version that holds all rows in arrays."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import boosting
from ledgerloom.plans.boosting import Boosting

LIST = Boosting(rounds=2, leaves=5, learning_rate=0.3, min_rows=4, l2=1.0, columns=1.0, bins=12)


@pytest.fixture(scope="module")
def lists(spark):
    rng = np.random.default_rng(11)
    rows = []
    for c in range(120):
        x = rng.normal(size=(8, 3)).round(2)
        best = int(np.argmax(x[:, 0] + 0.6 * np.sin(3 * x[:, 1]) + 0.2 * rng.normal(size=8)))
        rows += [(f"c{c:03d}", k, float(k == best), float(x[k, 0]), None if rng.random() < 0.1 else float(x[k, 1]), float(x[k, 2])) for k in range(8)]
    return spark.createDataFrame(rows, "client_id string, family_index int, label double, a double, b double, c double").repartition(3).cache()


def arrays(df, columns=("a", "b", "c")):
    rows = sorted(df.collect(), key=lambda r: (r["client_id"], r["family_index"]))
    x = np.array([[math.nan if r[c] is None else r[c] for c in columns] for r in rows])
    return [r["client_id"] for r in rows][::8], x, np.array([r["label"] for r in rows]).reshape(-1, 8)


def plain_cuts(x, bins):
    out = []
    for col in x.T:
        v = np.sort(col[~np.isnan(col)])
        out.append(sorted({v[k * len(v) // bins] for k in range(1, bins)}))
    return out


def plain_lambdas(scores, labels):
    """Pair by pair, as the definition reads."""
    g, h = np.zeros(8), np.zeros(8)
    rank = {i: r for r, i in enumerate(sorted(range(8), key=lambda i: (-scores[i], i)))}
    disc = [1 / math.log2(2 + rank[i]) for i in range(8)]
    best, total = sum((2**x - 1) / math.log2(2 + r) for r, x in enumerate(sorted(labels, reverse=True))), 0.0
    for i in range(8):
        for j in range(8):
            if labels[i] > labels[j]:
                w = abs(2 ** labels[i] - 2 ** labels[j]) * abs(disc[i] - disc[j]) / best
                if max(scores) != min(scores):
                    w /= 0.01 + abs(scores[i] - scores[j])
                p = 1 / (1 + math.exp(scores[i] - scores[j]))
                g[i] -= w * p
                g[j] += w * p
                h[i] += w * p * (1 - p)
                h[j] += w * p * (1 - p)
                total += 2 * w * p
    k = math.log2(1 + total) / total if total > 0 else 1
    return g * k, h * k


def plain_tree(bins, g, h, s):
    """Best split first over whole arrays; gradients as whole numbers of units."""

    def best(rows):
        found = None
        for f in range(bins.shape[1]):
            for b in sorted(set(bins[rows, f])):
                left = rows[bins[rows, f] <= b]
                right = rows[bins[rows, f] > b]
                gl, hl, gr, hr = (v[r].sum() / boosting.UNIT for r in (left, right) for v in (g, h))
                if min(len(left), len(right)) >= s.min_rows and min(hl, hr) >= s.min_hessian:
                    gain = gl**2 / (hl + s.l2) + gr**2 / (hr + s.l2) - (gl + gr) ** 2 / (hl + hr + s.l2)
                    if gain > 0 and (found is None or gain > found[0] + 1e-12):
                        found = (gain, f, b, left, right)
        return found

    nodes, splits = {1: np.arange(len(bins))}, {}
    open_ = {1: best(nodes[1])}
    while len(splits) + 1 < s.leaves and any(open_.values()):
        n = max((k for k in open_ if open_[k]), key=lambda k: open_[k][0])
        _, f, b, left, right = open_.pop(n)
        splits[n] = (f, b)
        del nodes[n]
        for k, rows in ((2 * n, left), (2 * n + 1, right)):
            nodes[k] = rows
            open_[k] = best(rows) if s.depth is None or k.bit_length() <= s.depth else None
    return splits, {k: -g[r].sum() / boosting.UNIT / (h[r].sum() / boosting.UNIT + s.l2) * s.learning_rate for k, r in nodes.items()}


def plain_fit(df, s, gradient):
    keys, x, labels = arrays(df)
    cuts = plain_cuts(x, s.bins)
    bins = np.stack([np.where(np.isnan(x[:, f]), 0, 1 + np.array([sum(c < v for c in cuts[f]) for v in x[:, f]])) for f in range(x.shape[1])], axis=1)
    scores, trees = np.zeros(len(x)), []
    for k in range(s.rounds):
        g, h = (np.rint(v * boosting.UNIT).astype(np.int64) for v in gradient(scores.reshape(-1, 8), labels, keys, k))
        splits, values = plain_tree(bins, g.ravel(), h.ravel(), s)
        trees.append((splits, values))
        node = boosting.nodes_of(bins, splits)
        scores = scores + np.array([values[int(n)] for n in node])
    return cuts, trees, scores


def by_definition(scores, labels, keys, k):
    g, h = zip(*(plain_lambdas(a, b) for a, b in zip(scores, labels)))
    return np.array(g), np.array(h)


def same_trees(model, trees):
    for t, (splits, values) in zip(model.trees, trees, strict=True):
        assert t.splits == splits
        assert t.values.keys() == values.keys() and all(abs(t.values[k][0] - v) < 1e-9 for k, v in values.items())


def test_listwise_trees_equal_a_plain_version(lists):
    model = boosting.fit(lists, ["a", "b", "c"], "label", ["client_id"], "family_index", LIST)
    cuts, trees, scores = plain_fit(lists, LIST, by_definition)
    assert model.cuts == cuts and len(trees[0][0]) == 4
    same_trees(model, trees)
    got = {(r["client_id"], r["family_index"]): r["scores"][0] for r in boosting.predict(model, lists, ["client_id", "family_index"]).collect()}
    assert np.allclose([v for _, v in sorted(got.items())], scores, atol=1e-9)
    again = boosting.Model.from_json(model.to_json())
    assert again == model and set(model.gains) <= {"a", "b", "c"} and max(model.gains, key=model.gains.get) == "a"


def test_trees_do_not_depend_on_partitions_or_stored_scores(lists, monkeypatch):
    fit = lambda df: boosting.fit(df, ["a", "b", "c"], "label", ["client_id"], "family_index", LIST)
    one = fit(lists.coalesce(1))
    monkeypatch.setattr(boosting, "PENDING", 1)
    assert fit(lists.repartition(7, "c")).trees == one.trees


def plain_pairs(scores, labels, keys, k, pairs=4):
    """Partner by partner with plain whole numbers."""
    import hashlib

    m = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m
        return x ^ x >> 31

    g, h = np.zeros(scores.shape), np.zeros(scores.shape)
    for r, key in enumerate(keys):
        base = mixed(int(hashlib.md5(key.encode()).hexdigest()[:15], 16) + k * 0x9E3779B97F4A7C15 & m)
        for i in range(8):
            others = [j for j in range(8) if labels[r, j] != labels[r, i]]
            for n in range(pairs):
                if others:
                    j = others[mixed(base + i * pairs + n + 1 & m) % len(others)]
                    up, down = (i, j) if labels[r, i] > labels[r, j] else (j, i)
                    p = 1 / (1 + math.exp(scores[r, down] - scores[r, up]))
                    g[r, up] += (p - 1) / pairs
                    g[r, down] -= (p - 1) / pairs
                    h[r, [i, j]] += 2 * p * (1 - p) / pairs
    return g, h


def test_pairwise_trees_equal_a_plain_version(lists):
    s = Boosting("pairwise", rounds=2, leaves=16, depth=3, learning_rate=0.3, min_rows=1, min_hessian=5.0, l2=10.0, columns=1.0, bins=10)
    model = boosting.fit(lists, ["a", "b", "c"], "label", ["client_id"], "family_index", s)
    cuts, trees, _ = plain_fit(lists, s, plain_pairs)
    assert model.cuts == cuts and max(k.bit_length() for k in trees[0][1]) <= 4
    same_trees(model, trees)


def accuracy(df, scored):
    best = scored.groupBy("client_id").agg(F.max_by("family_index", F.struct("score", -F.col("family_index"))).alias("k"))
    return df.where("label = 1").join(best, "client_id").agg(F.avg((F.col("k") == F.col("family_index")).cast("double"))).first()[0]


def test_lists_rank_better_than_points_on_held_out_clients(lists):
    """Candidates that only compare within a client: the client's level hides them from a pointwise model."""
    from ledgerloom.plans import learning

    level = (F.conv(F.substring(F.md5("client_id"), 1, 4), 16, 10).cast("double") % 50) - 25
    x = lists.select("client_id", "family_index", F.col("family_index").cast("string").alias("family"), "label", (F.col("a") + level).alias("a"), (F.col("a") * 0.5 + F.col("b").isNull().cast("int")).alias("b"))
    train, test = x.where("client_id < 'c080'"), x.where("client_id >= 'c080'")
    s = Boosting(rounds=12, leaves=8, learning_rate=0.2, min_rows=10, l2=1.0, columns=1.0)
    model = boosting.fit(train, ["a", "b"], "label", ["client_id"], "family_index", s)
    listwise = accuracy(test, boosting.predict(model, test, ["client_id", "family_index"]).withColumn("score", F.get("scores", F.lit(0))))
    points = learning.fit_ranker(train.drop("family_index"), iterations=12, depth=3)
    pointwise = accuracy(test, learning.rank_scores(points, test.na.fill(0)).withColumn("family_index", F.col("family").cast("int")))
    assert listwise >= pointwise and listwise > 0.4


def test_rows_are_drawn_by_group_and_columns_by_round(lists):
    s = replace(LIST, rows=0.5, columns=0.34)
    model = boosting.fit(lists, ["a", "b", "c"], "label", ["client_id"], "family_index", s)
    assert all(len({f for f, _ in t.splits.values()}) <= 1 for t in model.trees)
    rows = boosting.unscored(boosting.training_rows(lists, ["a"], [[0.0]], "label", ["client_id"], "family_index"), s)
    n = boosting.histogram(rows, s, 1, {}, [1], [], 0).agg(F.sum("n")).first()[0]
    assert 0 < n < 960 and n % 8 == 0


def test_refusals_and_odd_input(spark, lists):
    from ledgerloom.sources.ledger import ContractError

    with pytest.raises(ContractError):
        boosting.fit(lists.where("NOT (client_id = 'c001' AND family_index = 3)"), ["a"], "label", ["client_id"], "family_index", LIST)
    with pytest.raises(ContractError):
        boosting.fit(lists.withColumn("label", F.lit(None).cast("double")), ["a"], "label", ["client_id"], "family_index", LIST)
    flat = lists.withColumn("a", F.lit(1.0)).withColumn("b", F.lit(None).cast("double"))
    model = boosting.fit(flat, ["a", "b"], "label", ["client_id"], "family_index", replace(LIST, rounds=1))
    assert model.trees[0].splits == {} and abs(model.trees[0].values[1][0]) < 1e-6  # gradients are whole units
    assert {r["scores"][0] for r in boosting.predict(model, flat.drop("b"), ["client_id"]).collect()} == {model.trees[0].values[1][0]}


# --- classes


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        color, u = ["red", "green", "blue", None][int(rng.integers(4))], float(rng.normal())
        y = 2 if color == "red" and rng.random() < 0.9 else int(u > 0)
        rows.append((f"r{k:03d}", color, u, float(rng.normal()), y))
    return spark.createDataFrame(rows, "id string, color string, u double, v double, y int").repartition(4).cache()


def test_target_statistics_see_earlier_rows_only(classes):
    made = boosting.target_statistics(classes, "color", "y", 3, ["id"], seed=9, rows=60)
    import hashlib

    draw = lambda i: int(hashlib.md5(f"{i}|9".encode()).hexdigest()[:8], 16)
    seen, want = {}, {}
    for r in sorted(classes.collect(), key=lambda r: (draw(r["id"]), r["id"])):
        counts = seen.setdefault(r["color"], [0, 0, 0])
        want[r["id"]] = [(c + 1 / 3) / (sum(counts) + 1) for c in counts]
        counts[r["y"]] += 1
    got = {r["id"]: [r[f"color_ts_{k}"] for k in range(3)] for r in made.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    table = boosting.category_table(classes, "color", "y", 3)
    known = boosting.encoded(classes.withColumn("color", F.when(F.col("id") == "r000", "new").otherwise(F.col("color"))), table, "color", 3)
    assert known.count() == 400 and abs(known.where("id = 'r000'").first()["color_ts_0"] - 1 / 3) < 1e-12


def test_symmetric_trees_and_their_expression(classes):
    x = boosting.target_statistics(classes, "color", "y", 3, ["id"])
    columns = ["u", "v", "color_ts_0", "color_ts_1", "color_ts_2"]
    s = replace(boosting.SYMMETRIC, rounds=3, depth=3, learning_rate=0.8, classes=3, bins=16)
    model = boosting.fit(x.withColumn("place", F.lit(0)), columns, "y", ["id"], "place", s)
    for t in model.trees:
        for level in range(1, 4):
            assert len({t.splits[k] for k in t.splits if k.bit_length() == level}) <= 1
    scored = boosting.predict(model, x, ["id", "y"])
    by_rows = {r["id"]: r["scores"] for r in scored.collect()}
    by_expression = {r["id"]: r["s"] for r in x.select("id", boosting.symmetric_scores(model).alias("s")).collect()}
    assert all(np.allclose(by_rows[k], by_expression[k], atol=1e-12) for k in by_rows)
    hit = np.mean([int(np.argmax(r["scores"])) == r["y"] for r in scored.collect()])
    assert hit > 0.85
    plan = x.select(boosting.symmetric_scores(model))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_first_symmetric_split_has_the_most_summed_gain(classes):
    s = replace(boosting.SYMMETRIC, rounds=1, depth=1, classes=3, bins=16)
    model = boosting.fit(classes.withColumn("place", F.lit(0)), ["u", "v"], "y", ["id"], "place", s)
    rows = classes.collect()
    y = np.array([r["y"] for r in rows])
    g = np.full((len(y), 3), 1 / 3) - (y[:, None] == np.arange(3))
    best = None
    for f, c in enumerate("uv"):
        v = np.array([r[c] for r in rows])
        for b, cut in enumerate(model.cuts[f]):
            left = v <= cut
            part = lambda m: (g[m].sum(axis=0) ** 2 / (m.sum() * 2 / 9 + s.l2)).sum()
            gain = part(left) + part(~left)
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, b + 1)
    assert model.trees[0].splits == {1: best[1:]}
