"""Pruning rules, leaves of a holdout and rules for missing values against plain walks over rows."""

import copy
import random

import numpy as np
import pytest

from millrace.operators import histogram, pruning, trees

CLASSES = list("xyz")


@pytest.fixture(scope="module")
def data(spark):
    draw = random.Random(8)
    rows = [(k, draw.choice([None, *map(float, range(20))]), draw.choice([None, "a", "b", "c"]), float(draw.randrange(6)), draw.choice("xxyz")) for k in range(500)]
    rows = [(k, v, c, u, "y" if v is not None and v > 12 and draw.random() < 0.7 else y) for k, v, c, u, y in rows]
    df = spark.createDataFrame(rows, "k int, v double, c string, u double, y string").repartition(4)
    return rows[:250], rows[250:], df.where("k < 250").cache(), df.where("k >= 250").cache()


def ends(tree, row, k=1, share=1.0, missing="shares"):
    """(node, share) of where a row (v, c, u) ends."""
    n = tree.nodes[k]
    if n.feature is None:
        return [(k, share)]
    x = row[{"v": 0, "c": 1, "u": 2}[n.feature]]
    if x is None:
        to = {"shares": (n.p_left, 1 - n.p_left), "both": (1, 1), "drop": (0, 0)}[missing]
        return [e for j, p in enumerate(to) if p for e in ends(tree, row, 2 * k + j, share * p, missing)]
    return ends(tree, row, 2 * k + (x > n.threshold if n.category is None else x != n.category), share, missing)


def said(tree, row, k=1, missing="shares"):
    p = np.zeros(3)
    for node, share in ends(tree, row, k, 1.0, missing):
        p += share * np.array(tree.nodes[node].values())
    return int(np.round(p, 12).argmax())


def reach(tree, rows, k, missing):
    """(row, class, share) of rows that come to node k."""
    path = [k >> j for j in range(k.bit_length() - 1, -1, -1)]
    out = []
    for r in rows:
        share = 1.0
        for a, b in zip(path, path[1:], strict=False):
            n = copy.copy(tree.nodes[a])
            step = trees.Tree({1: n, 2: trees.Node([1, 0, 0], 1), 3: trees.Node([1, 0, 0], 1)})
            share *= dict(ends(step, r[1:4], 1, 1.0, missing)).get(2 + b % 2, 0.0)
        if share:
            out.append((r[1:4], CLASSES.index(r[4]), share))
    return out


def shape(tree, k=1):
    n = tree.nodes[k]
    return (n.label(),) if tree.leaf(k) else (n.feature, n.threshold, n.category, shape(tree, 2 * k), shape(tree, 2 * k + 1))


def plain(tree, rows, rule, alpha, leaf, missing):
    tree = copy.deepcopy(tree)

    def table(k, start):
        t = np.zeros((3, 3))
        for x, y, s in reach(tree, rows, k, missing):
            t[y, said(tree, x, start, missing)] += s
        return t

    for k in sorted((k for k in tree.nodes if not tree.leaf(k)), reverse=True):
        n, left, right = tree.nodes[k], tree.nodes[2 * k], tree.nodes[2 * k + 1]
        if rule == "twig" and not (tree.leaf(2 * k) and tree.leaf(2 * k + 1)):
            continue
        tables = [table(k, j) for j in (k, 2 * k, 2 * k + 1)]
        real, new = tables[0].sum(axis=1), copy.copy(n)
        if leaf == "validation" and real.sum():
            new.stats = list(real)
        elif leaf == "larger":
            new.stats = (left if left.weight >= right.weight else right).stats
        new.feature = None
        hits = [np.trace(tables[0]), real[new.label()], np.trace(tables[1]), np.trace(tables[2])]
        if rule == "four":
            take = int(np.argmax(np.round(hits, 9)))
            if take > 1:
                pruning._moved(tree, 2 * k + take - 2, k)
                continue
        elif rule == "both":
            before, flat = table(1, 1), np.zeros((3, 3))
            flat[:, new.label()] = real
            after = before - tables[0] + flat
            take = int(round(np.trace(after) - np.trace(before), 9) >= 0 and round(pruning._macro_f1(after) - pruning._macro_f1(before), 12) >= 0)
        else:
            take = int(round(hits[1] + alpha - hits[0], 9) >= 0)
        if take:
            tree.nodes[k] = new
    return tree


@pytest.mark.parametrize(("rule", "alpha", "leaf", "missing"), [("error", 0, "train", "shares"), ("error", 0, "validation", "drop"), ("alpha", 3.0, "larger", "both"), ("twig", 0, "train", "shares"), ("four", 0, "train", "shares"), ("four", 0, "validation", "drop"), ("both", 0, "train", "drop")])
def test_rules(data, rule, alpha, leaf, missing):
    _, held, fit, out = data
    tree = trees.grow(fit, "y", ["v", "u"], ["c"], CLASSES, depth=3)
    got = pruning.pruned(tree, out, "y", ["v", "u"], ["c"], CLASSES, rule, alpha, leaf, missing)
    assert shape(got) == shape(plain(tree, held, rule, alpha, leaf, missing)) and tree.shape()["nodes"] >= got.shape()["nodes"]


def test_leaves_of_a_holdout(data):
    _, held, fit, out = data
    tree = trees.grow(fit, "y", ["v", "u"], ["c"], CLASSES, depth=3)
    got = pruning.reestimated(tree, out, "y", ["v", "u"], ["c"], CLASSES)
    want = {}
    for r in held:
        for node, share in ends(tree, r[1:4]):
            want.setdefault(node, np.zeros(3))[CLASSES.index(r[4])] += share
    assert all(np.allclose(got.nodes[k].stats, want[k]) for k in want) and all(got.nodes[k].stats == tree.nodes[k].stats for k in tree.nodes if k not in want)


def test_best_alpha_is_judged_on_the_holdout(data):
    _, held, fit, out = data
    tree = trees.grow(fit, "y", ["v", "u"], ["c"], CLASSES, depth=3)
    best, path = pruning.best_alpha(tree, out, "y", ["v", "u"], ["c"], CLASSES)
    assert path[0][:2] == (0.0, tree.shape()["leaves"]) and path[-1][1] == 1 and [p[1] for p in path] == sorted((p[1] for p in path), reverse=True)
    hits = sum(said(best, r[1:4]) == CLASSES.index(r[4]) for r in held) / len(held)
    assert hits == pytest.approx(max(p[2] for p in path)) and best.shape()["leaves"] == [p[1] for p in path if round(p[2], 12) == round(hits, 12)][-1]


@pytest.mark.parametrize("missing", ["drop", "both", "larger"])
def test_rows_with_missing_values_go_where_the_rule_says(data, missing):
    rows, _, fit, _ = data
    tree = histogram.grow_binned(fit, "y", ["v", "u"], ["c"], CLASSES, depth=3, missing=missing)
    for k, n in tree.nodes.items():
        want = np.zeros(3)
        for _, y, s in reach(tree, rows, k, {"larger": "shares"}.get(missing, missing)):
            want[y] += s
        assert np.allclose(n.stats, want) and n.weight == pytest.approx(want.sum())


def test_all_ways_read_the_rows_once(data, monkeypatch):
    _, held, fit, out = data
    tree = trees.grow(fit, "y", ["v", "u"], ["c"], CLASSES, depth=3)
    asked, binned = [], pruning.binned
    monkeypatch.setattr(pruning, "binned", lambda *a, **k: asked.append(1) or binned(*a, **k))
    ways = [("error", 0.0, "train"), ("both", 0.0, "validation"), ("twig", 0.0, "larger"), ("four", 0.0, "train"), ("alpha", 3.0, "train")]
    got = pruning.pruned_ways(tree, out, "y", ["v", "u"], ["c"], CLASSES, ways)
    assert [shape(t) for t in got] == [shape(plain(tree, held, *way, "shares")) for way in ways] and asked == [1]
    assert [shape(t) for t in pruning.pruned_ways(tree, out.limit(0), "y", ["v", "u"], ["c"], CLASSES, ways)] == [shape(plain(tree, [], *way, "shares")) for way in ways]
