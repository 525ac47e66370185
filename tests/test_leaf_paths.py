"""Paths of leaves by pointer jumping against a walk from the root."""

import random

import numpy as np
import pytest

from terrafold.operators import explain

NODES = "tree int, node int, left int, right int, feature_index int, threshold double, rows long, value double, weight double"


def grown(tree, leaves, chain, seed):
    """A tree grown by splitting leaves at random, or always the last one."""
    draw = random.Random(seed)
    nodes, open_leaves = {0: [tree, 0, -1, -1, -1, None, 10**6, draw.random(), 0.5]}, [0]
    while len(open_leaves) < leaves:
        at = open_leaves.pop() if chain else open_leaves.pop(draw.randrange(len(open_leaves)))
        left, right = len(nodes), len(nodes) + 1
        part = max(1, nodes[at][6] // draw.randint(2, 4))
        nodes[left] = [tree, left, -1, -1, -1, None, part, draw.random(), 0.5]
        nodes[right] = [tree, right, -1, -1, -1, None, max(1, nodes[at][6] - part), draw.random(), 0.5]
        nodes[at][2:6] = left, right, draw.randrange(5), draw.choice([-1.5, 0.0, 2.25, 7.0])
        open_leaves += [left, right]
    return list(nodes.values())


def walked(rows):
    """(tree, node): value, features in order of their first split, and interval and cover of each."""
    by = {(r[0], r[1]): r for r in rows}
    out = {}
    for start in [r for r in rows if r[1] == 0]:
        pending = [(start, {})]
        while pending:
            n, path = pending.pop()
            if n[2] < 0:
                out[n[0], n[1]] = (n[7] * n[8], list(path), *([list(x) for x in zip(*path.values())] or [[], [], []]))
                continue
            low, high, share = path.get(n[4], (-np.inf, np.inf, 1.0))
            left, right = by[n[0], n[2]], by[n[0], n[3]]
            pending.append((left, path | {n[4]: (low, min(high, n[5]), share * (left[6] / n[6]))}))
            pending.append((right, path | {n[4]: (max(low, n[5]), high, share * (right[6] / n[6]))}))
    return out


@pytest.mark.parametrize("shape", ["bushy", "chain", "lone"])
def test_same_as_a_walk(spark, shape):
    if shape == "bushy":
        rows = grown(0, 5000, False, 1) + grown(1, 3, False, 2)
    elif shape == "chain":
        rows = grown(4, 90, True, 3) + grown(2, 1, False, 4)
    else:
        rows = grown(0, 1, False, 5)
    nodes = spark.createDataFrame([tuple(r) for r in rows], NODES)
    found = {
        (r["tree"], r["node"]): (r["value"], r["feature_index"], r["above"], r["upto"], r["cover"])
        for r in explain.paths_of_nodes(nodes).collect()
    }
    assert found == walked(rows)


def test_blocks_hold_every_leaf_once(spark):
    rows = grown(0, 700, False, 6)
    paths = explain.paths_of_nodes(spark.createDataFrame([tuple(r) for r in rows], NODES))
    files, base = explain.stored_paths(paths, 64)
    blocks = [explain.path_block(f) for f in files]
    assert len(files) >= 700 // 64 and all(sum(len(b[0]) for b in block) <= 64 for block in blocks)
    assert sum(len(b[0]) for block in blocks for b in block) == 700
    assert base == pytest.approx(sum(v * np.prod(cover) for v, _, _, _, cover in walked(rows).values()))


def test_no_task_collects_a_tree(spark):
    nodes = spark.createDataFrame([tuple(r) for r in grown(0, 20, False, 7)], NODES)
    plan = explain.paths_of_nodes(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "Groups" not in plan and "Python" not in plan
