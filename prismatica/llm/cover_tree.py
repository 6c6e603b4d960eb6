"""Near-duplicate embeddings by dual traversal of cover trees.

1. Equal vectors with equal labels form a class, which costs one row from there on.
2. The upper levels of the tree are made by Spark: a node with more vectors than a task should hold
   takes some of them as pivots, and every vector goes to the nearest one, until all leaves are small. A
   label with a third of all rows is thus cut like any other node.
3. Pairs of leaves come from a traversal of the upper levels: a pair of nodes goes on only if their
   covering balls come within reach of a link.
4. A pair of leaves is one task: each leaf becomes a cover tree with nested levels of halving radii, and
   both are traversed together. Node pairs out of reach are dropped, node pairs that lie within
   reach as a whole are linked as a whole, the rest is compared exactly. Pairs are never rows: a task
   returns for each vector its number of links and one link that joins it to the others.
5. Components come from alternating large-star and small-star.

Distances are chords between unit vectors, ``|x - y|^2 = 2 - 2 cos``, so the triangle inequality holds.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from prismatica.llm.common import ship, stored, vector_rows
from prismatica.llm.components import components

ship(sys.modules[__name__])

#: Rounding of a chord; bounds give way by it, and exact comparison decides.
SLACK = 1e-6
#: Entries of a distance matrix that are held in one go.
CELLS = 1 << 21
#: Pairs of children that are looked at in one go.
NODES = 1 << 17
#: Pairs of nodes that are looked at in one go, and children of two nodes from which on a matrix is used.
PAIRS, WIDE = 1 << 14, 1024


def chords(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def paired_chords(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(1))


def units(raw: np.ndarray) -> np.ndarray:
    """Rows of length one; they are first scaled by a power of two, so no square overflows."""
    scaled = np.ldexp(raw, -np.frexp(np.abs(raw).max(1, initial=0))[1][:, None])
    return scaled / np.sqrt((scaled * scaled).sum(1))[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows that were scaled by powers of two."""
    return (x @ y.T) / np.outer(np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1)))


def paired_cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of row i of the one with row i of the other."""
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


# --- trees and traversal inside a task ---------------------------------------------------

def net(x: np.ndarray, members: np.ndarray, radius: float) -> list[np.ndarray]:
    """``members`` dealt to centres that lie more than ``radius`` apart, none further than that from its
    centre. Each group starts with its centre; the first member is one, so levels nest."""
    groups = []
    while len(members):
        some = members[:max(1, min(256, CELLS // len(members)))]
        apart, free, chosen = chords(x[some], x[some]), np.ones(len(some), bool), []
        for i in range(len(some)):
            if free[i]:
                chosen.append(some[i])
                free &= apart[i] > radius
        far = chords(x[chosen], x[members])
        nearest, taken = far.argmin(0), far.min(0) <= radius
        order = np.argsort(nearest[taken], kind="stable")
        edges = np.cumsum(np.bincount(nearest[taken], minlength=len(chosen)))[:-1]
        for centre, part in zip(chosen, np.split(members[taken][order], edges)):
            groups.append(np.concatenate(([centre], part[part != centre])))
        members = members[~taken]
    return groups


@dataclass
class Tree:
    """Nodes by number: centre, covering radius, members as a run of ``order``, children as a run of nodes."""

    centre: np.ndarray
    radius: np.ndarray
    members: list[np.ndarray]
    child: np.ndarray
    children: np.ndarray

    def __post_init__(self):
        self.size = np.array(list(map(len, self.members)))
        #: For the traversal a leaf is its own and only child.
        self.first, self.fan = np.where(self.children > 0, self.child, np.arange(len(self.child))), np.maximum(self.children, 1)

    @classmethod
    def over(cls, x: np.ndarray, least: float) -> Tree:
        """Levels halve the radius from 2, the largest chord, on; nodes no larger than ``least`` are leaves."""
        members, child, children, radii, level = [np.arange(len(x))], [0], [0], [], {0: 2.0}
        at = 0
        while at < len(members):
            own = members[at]
            actual = float(chords(x[own[:1]], x[own]).max()) if len(own) > 1 else 0.0
            radii.append(actual)
            if actual > least:
                limit = level[at]
                while limit >= actual and limit > least:  # levels that would hold one node only
                    limit /= 2
                parts = net(x, own, limit)
                if len(parts) > 1:
                    child[at], children[at] = len(members), len(parts)
                    for part in parts:
                        level[len(members)] = limit / 2
                        members.append(part), child.append(0), children.append(0)
            level.pop(at, None)
            at += 1
        return cls(np.array([m[0] for m in members]), np.array(radii), members, np.array(child), np.array(children))


class Links:
    """Links between vectors of a leaf pair: how many each has, weighed by copies, and what they join."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.n, self.root = weights, np.zeros(len(weights), np.int64), np.arange(len(weights))

    def _find(self, nodes: np.ndarray) -> np.ndarray:
        up = self.root[nodes]
        while True:
            further = self.root[up]
            if (further == up).all():
                self.root[nodes] = up
                return up
            up = further

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self._find(a), self._find(b)
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))

    def all_of(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """Every member of ``a`` with every one of ``b``; with ``same`` both are one node."""
        self.n[a] += self.weights[b].sum()
        if same:
            self.n[a] -= self.weights[a]
        else:
            self.n[b] += self.weights[a].sum()
        self.join(np.concatenate((a, np.repeat(a[:1], len(b)))), np.concatenate((np.repeat(a[:1], len(a)), b)))

    def some_of(self, a: np.ndarray, b: np.ndarray, linked: np.ndarray, same: bool) -> None:
        """The marked ones; with ``same`` the matrix is symmetric and its diagonal unmarked."""
        self.n[a] += linked @ self.weights[b]
        if not same:
            self.n[b] += self.weights[a] @ linked
        i, j = np.nonzero(linked)
        self.join(a[i], b[j])

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """Vector i of the one with vector i of the other."""
        np.add.at(self.n, a, self.weights[b])
        np.add.at(self.n, b, self.weights[a])
        self.join(a, b)


Pairs = Iterator[tuple[np.ndarray, np.ndarray]]


def _below(x: np.ndarray, tree: Tree, a: int, y: np.ndarray, other: Tree, b: int, reach: float, mirrored: bool) -> Pairs:
    """Pairs of children of two nodes that come within reach, some at a time."""
    mine, its = tree.first[a] + np.arange(tree.fan[a]), other.first[b] + np.arange(other.fan[b])
    step = max(1, NODES // len(its))
    for low in range(0, len(mine), step):
        part = mine[low:low + step]
        near = chords(x[tree.centre[part]], y[other.centre[its]]) <= tree.radius[part][:, None] + other.radius[its] + reach
        if mirrored:
            near &= part[:, None] <= its
        i, j = np.nonzero(near)
        yield part[i], its[j]


def _below_each(x: np.ndarray, tree: Tree, a: np.ndarray, y: np.ndarray, other: Tree, b: np.ndarray, reach: float, same: bool) -> Pairs:
    """The same for many pairs of nodes with few children each."""
    every = tree.fan[a] * other.fan[b]
    edges = np.flatnonzero(np.diff(np.cumsum(every) // PAIRS)) + 1
    for a, b, n in zip(np.split(a, edges), np.split(b, edges), np.split(every, edges)):
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        up, down = np.repeat(a, n), np.repeat(b, n)
        i, j = tree.first[up] + at // other.fan[down], other.first[down] + at % other.fan[down]
        far = paired_chords(x[tree.centre[i]], y[other.centre[j]])
        near = far <= tree.radius[i] + other.radius[j] + reach
        if same:
            near &= (up != down) | (i <= j)
        yield i[near], j[near]


def traverse(x: np.ndarray, tree: Tree, y: np.ndarray, other: Tree, shift: int, links: Links, raw: np.ndarray, least_cosine: float) -> None:
    """Dual traversal of ``tree`` over ``x`` and ``other`` over ``y`` (the same object for links inside a
    leaf); the vectors of ``other`` are number ``shift`` on in ``raw`` and ``links``. Depth first, so the
    pairs that wait are few."""
    same, reach = tree is other, np.sqrt(2 - 2 * least_cosine)
    waiting: list[Pairs] = [iter([(np.zeros(1, int), np.zeros(1, int))])]
    while waiting:
        found = next(waiting[-1], None)
        if found is None:
            waiting.pop()
            continue
        if len(found[0]) > PAIRS:
            waiting.append(iter([(found[0][low:low + PAIRS], found[1][low:low + PAIRS]) for low in range(0, len(found[0]), PAIRS)]))
            continue
        a, b = found
        single = (tree.size[a] == 1) & (other.size[b] == 1)
        one, two = tree.centre[a[single]], other.centre[b[single]] + shift
        linked = (one != two) & (paired_cosines(raw[one], raw[two]) >= least_cosine)
        links.pairs(one[linked], two[linked])
        a, b = a[~single], b[~single]
        far = paired_chords(x[tree.centre[a]], y[other.centre[b]])
        far[same & (a == b)] = 0.0
        whole = far + tree.radius[a] + other.radius[b] < reach - SLACK
        leaves = ~whole & (tree.children[a] == 0) & (other.children[b] == 0)
        for i, j in zip(a[whole], b[whole]):
            links.all_of(tree.members[i], other.members[j] + shift, same and i == j)
        for i, j in zip(a[leaves], b[leaves]):
            one, two, mirrored = tree.members[i], other.members[j] + shift, same and i == j
            step = max(1, CELLS // len(two))
            for low in range(0, len(one), step):
                part = one[low:low + step]
                linked = cosines(raw[part], raw[two]) >= least_cosine
                if mirrored:
                    linked[np.arange(len(part)), low + np.arange(len(part))] = False
                links.some_of(part, two, linked, mirrored)
        a, b = a[~whole & ~leaves], b[~whole & ~leaves]
        wide = tree.fan[a] * other.fan[b] > WIDE
        for i, j in zip(a[wide], b[wide]):
            waiting.append(_below(x, tree, i, y, other, j, reach + SLACK, same and i == j))
        if not wide.all():
            waiting.append(_below_each(x, tree, a[~wide], y, other, b[~wide], reach + SLACK, same))


# --- rows, nodes and pairs of leaves --------------------------------------------------------

def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, space, raw): vectors that can link have a key of label and entries, and a space of label and length."""
    for batch in batches:
        rows, length, values = vector_rows(batch.column(2))
        edges = np.concatenate(([0], np.cumsum(length)))
        labels = batch.column(1).to_pylist()
        made = [[None] * batch.num_rows for _ in range(3)]
        for row, a, b in zip(rows.tolist(), edges, edges[1:]):
            if labels[row] is None or not values[a:b].any():
                continue
            raw, space = values[a:b], f"{b - a}:{labels[row]}"
            raw = np.ldexp(raw, -np.frexp(np.abs(raw).max())[1])
            single = raw.astype(np.float32)
            kept = single.tobytes() if (single == raw).all() else raw.tobytes()
            for column, entry in zip(made, (xxhash.xxh3_128_digest(kept + space.encode()), space, kept)):
                column[row] = entry
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made[0], pa.binary()), pa.array(made[1], pa.string()), pa.array(made[2], pa.binary())],
                                         names=["id", "key", "space", "raw"])


def _matrix(raw, space: str) -> np.ndarray:
    """Vectors as rows of doubles; float32 was kept where it holds them exactly."""
    size = int(space.split(":", 1)[0])
    rows = [np.frombuffer(r.as_buffer(), np.float32 if len(r.as_buffer()) == 4 * size else np.float64) for r in raw]
    return np.array([r.astype(np.float64) for r in rows])


def _nearest(members: pa.Table, pivots: pa.Table) -> pa.Table:
    """Members with the path of their nearest pivot; of equally near ones the key chooses, so equal
    directions are dealt out too."""
    if not members.num_rows or not pivots.num_rows:
        return members.select(["key", "space", "path", "raw", "rows"])
    space = members.column("space")[0].as_py()
    x, p = units(_matrix(members.column("raw"), space)), units(_matrix(pivots.column("direction"), space))
    far = chords(x, p)
    near = far <= far.min(1, keepdims=True) + SLACK
    turn = np.array([int.from_bytes(k.as_py()[:7], "little") for k in members.column("key")]) % near.sum(1)
    which = (near.cumsum(1) > turn[:, None]).argmax(1)
    names = [k.as_py().hex() for k in pivots.column("pivot")]
    path = [f"{old.as_py()}/{names[k]}" for old, k in zip(members.column("path"), which)]
    return pa.table([members.column("key"), members.column("space"), pa.array(path), members.column("raw"), members.column("rows")],
                    names=["key", "space", "path", "raw", "rows"])


def _ball(members: pa.Table) -> pa.Table:
    """Centre, one of the vectors, and covering radius of a leaf."""
    space = members.column("space")[0].as_py()
    x = units(_matrix(members.column("raw"), space))
    centre = x[int((x @ x.mean(0)).argmax())]
    return pa.table({"path": members.column("path")[:1], "centre": pa.array([centre.tobytes()], pa.binary()),
                     "radius": [float(chords(centre[None], x).max())]})


def _bounds(balls: pa.Table) -> pa.Table:
    """The ball around those of the leaves below a node."""
    x = np.array([np.frombuffer(c.as_buffer()) for c in balls.column("centre")])
    centre = x[int((x @ x.mean(0)).argmax())]
    return pa.table({"node": balls.column("node")[:1], "parent": balls.column("parent")[:1], "centre": pa.array([centre.tobytes()], pa.binary()),
                     "radius": [float((chords(centre[None], x)[0] + balls.column("radius").to_numpy()).max())]})


def _within(reach: float):
    """Pairs of nodes (a, x, r, b, y, s) whose balls come within reach of a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(c.as_buffer()) for c in batch.column(i)] for i in (1, 4))
            far = np.array([float(np.sqrt(((u - v) ** 2).sum())) for u, v in zip(x, y)])
            keep = far <= batch.column(2).to_numpy() + batch.column(5).to_numpy() + reach + SLACK
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _linked(least: float):
    """(key, n_links, root) of the vectors of a pair of leaves that have links."""
    reach = np.sqrt(2 - 2 * least)

    def run(members: pa.Table) -> pa.Table:
        side = members.column("side").to_numpy()
        members = members.take(pa.array(np.argsort(side, kind="stable")))
        first, space = int((side == 0).sum()), members.column("space")[0].as_py()
        raw = _matrix(members.column("raw"), space)
        x, keys = units(raw), [k.as_py() for k in members.column("key")]
        links = Links(members.column("rows").to_numpy())
        tree = Tree.over(x[:first], reach / 8)
        if first == len(x):
            traverse(x, tree, x, tree, 0, links, raw, least)
        else:
            traverse(x[:first], tree, x[first:], Tree.over(x[first:], reach / 8), first, links, raw, least)
        found = np.flatnonzero(links.n)
        root = links._find(found)
        return pa.table({"key": pa.array([keys[i] for i in found], pa.binary()), "n_links": pa.array(links.n[found]),
                         "root": pa.array([keys[i] for i in root], pa.binary())})
    return run


def _leaves(classes: DataFrame, leaf_bytes: int) -> DataFrame:
    """The classes with the path of their leaf: nodes are split by pivots until they fit."""
    members, depth = classes.select("key", "space", F.md5("space").alias("path"), "raw", "rows"), 0
    limit = F.lit(leaf_bytes) / (F.substring_index("space", ":", 1).cast("int") * 8)
    while True:
        sizes = members.groupBy("path", "space").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / limit))
        large = stored(sizes.filter("parts > 1").select("path", "n", "parts"))
        if large.isEmpty():
            return members
        depth += 1
        spread = F.pmod(F.xxhash64("key", F.lit(depth)), F.col("n"))
        pivots = (members.join(large, "path").filter(spread < F.least(F.col("parts") * 4, F.lit(64)))
                  .select(F.col("path").alias("node"), F.col("key").alias("pivot"), F.col("raw").alias("direction"),
                          F.explode(F.expr("sequence(0L, parts - 1)")).alias("share")))
        rest = (members.join(large.select("path", "parts"), "path")
                .select("key", "space", "path", "raw", "rows", F.pmod(F.xxhash64("key"), F.col("parts")).alias("salt")))
        split = rest.groupBy("path", "salt").cogroup(pivots.groupBy("node", "share")).applyInArrow(
            _nearest, "key binary, space string, path string, raw binary, rows long")
        members = stored(members.join(large.select("path"), "path", "left_anti").select(split.columns).unionByName(split))


def _leaf_pairs(leaves: DataFrame, least: float) -> DataFrame:
    """(a, b) of leaf paths, ``a <= b``, whose balls come within reach: node pairs are followed from the
    spaces down, level by level."""
    balls = stored(leaves.groupBy("path").applyInArrow(_ball, "path string, centre binary, radius double"))
    depth = balls.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 1
    pairs = None
    for level in range(1, depth + 1):
        below = balls.select(F.substring_index("path", "/", level).alias("node"), F.substring_index("path", "/", level - 1).alias("parent"),
                             "centre", "radius")
        if pairs is None:
            pairs = stored(below.select(F.col("node").alias("a"), F.col("node").alias("b")).distinct())
            continue
        nodes = stored(below.groupBy("node", "parent").applyInArrow(
            _bounds, "node string, parent string, centre binary, radius double"))
        one = nodes.select(F.col("parent").alias("a"), F.col("node").alias("c"), F.col("centre").alias("x"), F.col("radius").alias("r"))
        two = nodes.select(F.col("parent").alias("b"), F.col("node").alias("d"), F.col("centre").alias("y"), F.col("radius").alias("s"))
        met = pairs.join(one, "a").join(two, "b").filter((F.col("a") != F.col("b")) | (F.col("c") <= F.col("d")))
        pairs = stored(met.select("c", "x", "r", "d", "y", "s").mapInArrow(_within(float(np.sqrt(2 - 2 * least))), "a string, b string"))
    return pairs


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93,
                 leaf_bytes: int = 8 << 20) -> DataFrame:
    """(key, n_links, component_id) for each row of ``vectors``.

    Rows are linked if their labels are equal and not null, their vectors are equally long, and their
    cosine is ``least`` or more. n_links is the number of other rows that a row is linked with, copies
    counted one by one; component_id is the smallest key reachable by links, its own included. Vectors that
    are null, empty, zero or hold null or non-finite entries, and rows without label, link with nothing. Repeated
    keys are rows of their own; null keys link like others but are no component_id, so rows that reach no
    key have null. ``leaf_bytes`` is the size, in doubles, of the largest leaf a task holds (it holds two).
    Extra columns are not read; an empty table gives an empty one.
    """
    kind = dict(vectors.dtypes)[key]
    keyed = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("string").alias("label"),
                           F.col(f"`{vector}`").alias("vector")).mapInArrow(_keyed, f"id {kind}, key binary, space string, raw binary")
    classes = stored(keyed.filter("key is not null").groupBy("key").agg(
        F.min("id").alias("least"), F.count("*").alias("rows"), F.first("space").alias("space"), F.first("raw").alias("raw")))
    leaves = _leaves(classes, leaf_bytes)
    pairs = _leaf_pairs(leaves, least)
    sides = leaves.join(pairs.withColumnRenamed("a", "path"), "path").select(
        F.col("path").alias("a"), "b", F.lit(0).alias("side"), "key", "space", "raw", "rows")
    sides = sides.unionByName(leaves.join(pairs.filter("a <> b").withColumnRenamed("b", "path"), "path").select(
        "a", F.col("path").alias("b"), F.lit(1).alias("side"), "key", "space", "raw", "rows"))
    found = stored(sides.groupBy("a", "b").applyInArrow(_linked(least), "key binary, n_links long, root binary"))
    numbers = found.groupBy("key").agg(F.sum("n_links").alias("linked"))
    joined = components(found.filter(F.col("key") != F.col("root")), "key", "root")
    named = (classes.select("key", "least", "rows").join(numbers, "key", "left")
             .join(joined.select(F.col("node").alias("key"), "component"), "key", "left")
             .withColumn("component", F.coalesce("component", "key")))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    told = named.join(smallest, "component").select(
        "key", (F.coalesce("linked", F.lit(0)) + F.col("rows") - 1).alias("n_links"), "component_id")
    alone = F.col("key").isNull()
    return keyed.select("id", "key").join(told, "key", "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
