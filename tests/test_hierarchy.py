import random

from symloom.operators import hierarchy

SCHEMA = "start_id string, end_id string, child_order long, node string, path string"


def solve(spark, links, path=False):
    df = spark.createDataFrame([(a, b, o, "n", "p") for a, b, o in links], SCHEMA)
    return hierarchy.resolve(hierarchy.parent_links(df, "start_id", "end_id", "child_order"), path)


def brute(links):
    best = {}
    nodes = set()
    for a, b, o in links:
        nodes |= {x for x in (a, b) if x is not None}
        if a is not None and b is not None:
            key = (2**62 if o is None else o, a)
            best[b] = min(best.get(b, key), key)
    out = {}
    for n in nodes:
        way, seen = [n], {n}
        while way[-1] in best:
            up = best[way[-1]][1]
            if up in seen:
                way = None
                break
            seen.add(up)
            way.append(up)
        out[n] = (way[-1], len(way) - 1) if way else ("", -1)
    return out


def test_random_forests_with_circles(spark):
    rng = random.Random(4)
    links = []
    for i in range(1, 400):
        links.append((f"n{rng.randrange(max(0, i - 9), i)}", f"n{i}", rng.choice([None, 0, 1])))
    links += [(f"c{i}", f"c{(i + 1) % 7}", 0) for i in range(7)] + [("c3", "d0", 1), ("d0", "d1", 1), ("s", "s", 0)]
    links += [(None, "n0", 0), (None, "lone", 0), ("only", None, 0), (None, None, 0)] + links[:40]
    got = {r.node_id: (r.root_id, r.depth) for r in solve(spark, links).collect()}
    assert got == brute(links)


def test_chain_of_a_thousand(spark):
    got = {r.node_id: r for r in solve(spark, [(f"n{i}", f"n{i + 1}", 0) for i in range(1000)], True).collect()}
    assert got["n1000"].depth == 1000 and got["n1000"].root_id == "n0" and list(got["n1000"].path) == [f"n{i}" for i in range(1001)]


def test_several_parents_take_the_first_by_order_then_id(spark):
    got = {r.node_id: r.root_id for r in solve(spark, [("b", "x", 2), ("a", "x", 2), ("c", "x", None), ("z", "y", None), ("q", "y", 0)]).collect()}
    assert got["x"] == "a" and got["y"] == "q"


def test_descendants_and_sizes(spark):
    links = [("r", "a", 0), ("r", "b", 1), ("a", "c", 0), ("c", "d", 0), ("x", "y", 0), ("y", "x", 0)]
    df = spark.createDataFrame([(a, b, o, "n", "p") for a, b, o in links], SCHEMA)
    parents = hierarchy.parent_links(df, "start_id", "end_id", "child_order")
    done = hierarchy.resolve(parents, True)
    below = {(r.node_id, r.descendant_id, r.distance) for r in hierarchy.descendants(parents, done).collect()}
    assert below == {("r", "a", 1), ("r", "b", 1), ("r", "c", 2), ("r", "d", 3), ("a", "c", 1), ("a", "d", 2), ("c", "d", 1)}
    sizes = {r.node_id: (r.n_descendants, r.height) for r in hierarchy.subtree_sizes(done).collect()}
    assert sizes == {"r": (4, 3), "a": (2, 2), "b": (0, 0), "c": (1, 1), "d": (0, 0)}


def test_empty(spark):
    assert solve(spark, []).count() == 0 and solve(spark, [(None, None, None)], True).count() == 0
