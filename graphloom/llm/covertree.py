"""Embedding near-duplicates by dual traversal of cover trees: every row's class and number of links, exactly.

Two rows are linked when their distance is at most the threshold; classes are the connected components.

A tree's levels are nested: the centres of a level stay centres on the next, whose radius is half as large, and
every point lies within the radius of its centre. Each node also knows its true covering radius. Two trees are
walked together. A pair of nodes whose centres are further apart than the threshold plus both covering radii holds
no link and is dropped with all below it; one whose centres are nearer than the threshold less both radii is
linked throughout and only its sizes are added up, so a group of copies costs its size and not its pairs. A level that
hardly gathers points (vectors without structure) is not opened further; such leaves are compared in dense tiles.

The uppermost level is spread over the cluster by two bounded sets of centres, fitted on a sample. Rows within half the threshold of
a heavy centre (one with many sample rows that near) are all linked to each other and are held as one node, so a group of
near copies may hold any share of the rows; other rows compare themselves with that node by its centre and radius, and
with its members only where the bounds leave it open. All other rows fall to cells around pivots; a row goes to
another cell only if it lies within the threshold of the plane between the pivots and of the cell's covering
ball. Cells and nodes larger than a block are split by hash. Each pair of cells that is left is one task. The
work grows in proportion where cells are apart, and towards the square of the table where vectors have no structure.

Defined cases: rows without id, without vector, or with a null, NaN or infinite element are left out; vectors of
different length are never linked; identical rows count once; several vectors of one id are rows of their own; a
distance equal to the threshold is within it; an empty table gives an empty table; extra columns are neither
read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import components, cut, joined_roots
from graphloom.llm.vectors import Pivots, by_dim, row_hash, sample_of, squares, to_matrix, valid_vectors

#: Euclidean distance; on unit vectors a cosine of 0.955.
EPSILON = 0.3
BLOCK = 16384
LEAF = 32
#: Sample rows within half the threshold of a heavy centre.
HEAVY = 8
#: A level's points are left together once PROBE centres in a row have covered fewer than FLAT points each.
PROBE, FLAT = 32, 4
_TILE = 1 << 20


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(squares(a, b))


class Node:
    __slots__ = ("centre", "radius", "members", "children", "centres", "radii")

    def __init__(self, centre: int, radius: float, members: np.ndarray):
        self.centre, self.radius, self.members = centre, radius, members
        self.children: list[Node] | None = None


class CoverTree:
    """Nodes are opened down to LEAF members, to points that coincide, or to levels that gather nothing."""

    def __init__(self, points: np.ndarray):
        self.points = points
        members = np.arange(len(points))
        gaps = np.sqrt(np.square(points - points[:1]).sum(axis=1))
        top = float(gaps.max()) if len(points) else 0.0
        self.root = Node(0, top, members)
        waiting = [(self.root, gaps, top / 2)]
        while waiting:
            node, gaps, reach = waiting.pop()
            if gaps is None or len(node.members) <= LEAF or node.radius <= 1e-12:
                continue
            parts = self._split(node, gaps, reach)
            if parts is None:
                continue
            node.children = [child for child, _ in parts]
            waiting += [(child, g, min(reach, child.radius) / 2) for child, g in parts if g is not None]
            node.centres = points[[c.centre for c in node.children]]
            node.radii = np.array([c.radius for c in node.children])

    def _split(self, node: Node, gaps: np.ndarray, reach: float) -> list[tuple[Node, np.ndarray | None]] | None:
        """The members shared out among centres ``reach`` apart or more, the node's own first.

        Where centres hardly gather points any more, what is left becomes one child that stays unopened; none if all is left.
        """
        left, at, out, to_centre, idle = node.members, node.centre, [], gaps, 0
        while True:
            inside = gaps <= reach
            inside |= left == at
            own = gaps[inside]
            out.append((Node(at, float(own.max()), left[inside]), own))
            idle = 0 if len(own) >= FLAT else idle + 1
            left, to_centre = left[~inside], to_centre[~inside]
            if not len(left):
                return out
            if idle == PROBE:
                if len(out) == PROBE:
                    return None
                return [*out, (Node(node.centre, float(to_centre.max()), left), None)]
            at = int(left[0])
            gaps = np.sqrt(np.square(self.points[left] - self.points[at]).sum(axis=1))


class Links:
    """Numbers of links and roots of components of the points of two sets (or one), numbered x first."""

    def __init__(self, x: int, y: int):
        self.count = np.zeros(x + y, dtype=np.int64)
        self.root = np.arange(x + y)

    def all(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every point of ``a`` with every one of ``b``."""
        self.count[a] += len(b)
        self.count[b] += len(a)
        both = np.concatenate([a, b])
        self.root = joined_roots(self.root, both, np.full(len(both), both[0]))

    def within(self, a: np.ndarray) -> None:
        self.count[a] += len(a) - 1
        self.root = joined_roots(self.root, a, np.full(len(a), a[0]))

    def some(self, a: np.ndarray, b: np.ndarray) -> None:
        self.count += np.bincount(a, minlength=len(self.count)) + np.bincount(b, minlength=len(self.count))
        self.root = joined_roots(self.root, a, b)


def _tile(links: Links, px: np.ndarray, py: np.ndarray, a: np.ndarray, b: np.ndarray, shift: int, epsilon: float, same: bool) -> None:
    """Members ``a`` of x against members ``b`` of y, densely; of one set each pair once."""
    x, y = px[a], py[b]
    nx, ny = np.square(x).sum(axis=1), np.square(y).sum(axis=1)
    most = float(max(nx.max(), ny.max()))
    kind = np.float32 if most < 1e12 else np.float64
    slack = (2e-6 if kind is np.float32 else 1e-12) * (4 * most + 1e-30) * max(1.0, x.shape[1] / 64)
    square, one = epsilon * epsilon, np.ones((1, 1))
    # one product gives squared distances: (x, |x|^2, 1) by (-2y, 1, |y|^2)
    left = np.concatenate([x, nx[:, None], np.broadcast_to(one, (len(x), 1))], axis=1).astype(kind)
    right = np.concatenate([-2 * y, np.broadcast_to(one, (len(y), 1)), ny[:, None]], axis=1).astype(kind).T.copy()
    step = max(16, _TILE // max(1, len(b)))
    for at in range(0, len(a), step):
        first = at if same else 0
        gap = left[at : at + step] @ right[:, first:]
        if not same and gap.min() > square + slack:
            continue
        i, j = np.nonzero(~(gap > square + slack))  # what is no number is looked at, too
        near = gap[i, j] < square - slack
        i, j = i + at, j + first
        if same:
            keep = i < j
            i, j, near = i[keep], j[keep], near[keep]
        if not len(i):
            continue
        open_ = np.flatnonzero(~near)
        for s in range(0, len(open_), 1 << 16):
            o = open_[s : s + (1 << 16)]
            near[o] = np.sqrt(np.square(x[i[o]] - y[j[o]]).sum(axis=1)) <= epsilon
        links.some(a[i[near]], b[j[near]] + shift)


def count_links(x: np.ndarray, y: np.ndarray | None, epsilon: float) -> Links:
    """Links of all points of x with all of y, or inside x if y is none."""
    same = y is None
    links = Links(len(x), 0 if same else len(y))
    if not len(x) or not same and not len(y):
        return links
    one = CoverTree(x)
    two = one if same else CoverTree(y)
    shift = 0 if same else len(x)
    waiting = [(one.root, two.root)]
    while waiting:
        a, b = waiting.pop()
        if same and a is b and 2 * a.radius <= epsilon * (1 - 1e-9):
            links.within(a.members)
            continue
        if a.children is None and b.children is None:
            _tile(links, one.points, two.points, a.members, b.members, shift, epsilon, same and a is b)
            continue
        left, cl, rl = ([a], one.points[[a.centre]], np.array([a.radius])) if a.children is None else (a.children, a.centres, a.radii)
        right, cr, rr = ([b], two.points[[b.centre]], np.array([b.radius])) if b.children is None else (b.children, b.centres, b.radii)
        step = max(1, _TILE // len(right))
        for at in range(0, len(left), step):
            apart, reach = _distances(cl[at : at + step], cr), rl[at : at + step, None] + rr[None]
            loose = 1e-6 * (1 + apart)
            i, j = np.nonzero(~(apart > epsilon + reach + loose))
            if same and a is b:
                i, j = i[i + at <= j], j[i + at <= j]
            sure = apart[i, j] + reach[i, j] + loose[i, j] <= epsilon
            for p, q, s in zip(i.tolist(), j.tolist(), sure.tolist()):
                if s and left[at + p] is not right[q]:
                    links.all(left[at + p].members, right[q].members + shift)
                else:
                    waiting.append((left[at + p], right[q]))
    return links


def heavy_centres(sample: np.ndarray, reach: float, least: int = HEAVY) -> np.ndarray:
    """Rows of the sample that together cover, within ``reach``, every row with ``least`` rows that near."""
    lean = sample.astype(np.float32)

    def near(at: np.ndarray) -> np.ndarray:
        return squares(lean[at], lean) <= reach * reach

    size = np.concatenate([near(np.arange(s, min(s + 512, len(sample)))).sum(axis=1) for s in range(0, len(sample), 512)])
    found, covered = [], np.zeros(len(sample), dtype=bool)
    for i in np.lexsort((np.arange(len(sample)), -size)):
        if size[i] < least:
            break
        if not covered[i]:
            found.append(i)
            covered |= near(np.array([i]))[0]
    return sample[np.array(found, dtype=np.int64)]


class Level:
    """The uppermost level for vectors of one length: heavy centres and pivots; later their sizes and radii."""

    def __init__(self, sample: np.ndarray, cells: int, epsilon: float):
        self.epsilon = epsilon
        self.heavy = heavy_centres(sample, epsilon / 2)
        self.pivots = Pivots(sample, cells)
        self.n, self.radius = np.zeros(len(self.heavy), np.int64), np.zeros(len(self.heavy))
        self.cell_n, self.cell_radius = np.zeros(len(self.pivots.centres), np.int64), np.zeros(len(self.pivots.centres))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distances from heavy centres; the heavy centre each row belongs to or -1; squared distances from pivots; the cell."""
        far = _distances(x, self.heavy)
        own = np.full(len(x), -1)
        if far.shape[1]:
            best = far.argmin(axis=1)
            exact = np.sqrt(np.square(x - self.heavy[best]).sum(axis=1))
            own = np.where(exact <= self.epsilon / 2 * (1 - 1e-9), best, -1)
            far[np.arange(len(x)), best] = exact
        gaps = self.pivots.gaps(x)
        return far, own, gaps, gaps.argmin(axis=1)


_SIZES = pa.schema([("dim", pa.int32()), ("heavy", pa.bool_()), ("at", pa.int32()), ("n", pa.int64()), ("radius", pa.float64())])
_SIZES_DDL = "dim int, heavy boolean, at int, n long, radius double"


def _sizes(levels: dict[int, Level]):
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool, int], list[float]] = {}
        for batch in batches:
            for dim, rows in by_dim(batch) if batch.num_rows else ():
                if dim not in levels:
                    held.setdefault((dim, False, -1), [0, 0.0])[0] += rows.num_rows
                    continue
                far, own, gaps, home = levels[dim].place(to_matrix(rows))
                for heavy, at, reach in ((True, own, far), (False, np.where(own < 0, home, -1), np.sqrt(gaps))):
                    which = np.flatnonzero(at >= 0)
                    most = np.zeros(reach.shape[1])
                    np.maximum.at(most, at[which], reach[which, at[which]])
                    for k, n in enumerate(np.bincount(at[which], minlength=reach.shape[1]).tolist()):
                        if n:
                            s = held.setdefault((dim, heavy, k), [0, 0.0])
                            s[0], s[1] = s[0] + n, max(s[1], float(most[k]))
        if held:
            yield pa.RecordBatch.from_pylist([dict(dim=d, heavy=h, at=k, n=n, radius=r) for (d, h, k), (n, r) in held.items()], schema=_SIZES)

    return sizes


_PLACED = pa.schema([("key", pa.int64()), ("v", pa.int64()), ("vec_id", pa.int64()), ("vec", pa.list_(pa.float64())), ("dim", pa.int32()), ("heavy", pa.int32()), ("sub", pa.int64()), ("sure", pa.int64()), ("linked", pa.list_(pa.int32())), ("asks", pa.list_(pa.int32())), ("near", pa.list_(pa.int64()))])
_PLACED_DDL = "key long, v long, vec_id long, vec array<double>, dim int, heavy int, sub long, sure long, linked array<int>, asks array<int>, near array<long>"


def _lists(marks: np.ndarray, names: np.ndarray) -> pa.Array:
    """For each row the names of its marked columns."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, marks.sum(axis=1).cumsum()].astype(np.int32)), pa.array(names[np.nonzero(marks)[1]]))


def _parts(n: np.ndarray, block: int) -> np.ndarray:
    """Parts of at most about ``block`` rows into which cells of ``n`` rows are split."""
    return np.maximum(1, -(-n // block))


def _place(levels: dict[int, Level], first: dict[int, tuple[int, int]], others: dict[int, int], block: int):
    """Rows with their node or part of a cell, and where their links are to be looked for.

    ``first`` numbers the nodes and cells of a length; ``others`` counts the rows of lengths that the sample lacks, each one cell.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows in by_dim(batch) if batch.num_rows else ():
                n, key, x = rows.num_rows, rows.column("key").to_numpy(zero_copy_only=False), to_matrix(rows)
                level = levels.get(dim)
                if level is None:
                    own, home, base = np.full(n, -1), np.zeros(n, np.int64), (0, 0)
                    inside = asked = np.zeros((n, 0), dtype=bool)
                    near, sizes, parts = np.ones((n, 1), dtype=bool), np.zeros(0, np.int64), _parts(np.array([others[dim]]), block)
                else:
                    far, own, gaps, home = level.place(x)
                    sizes, parts, base = level.n, _parts(level.cell_n, block), first[dim]
                    norm = 1e-7 * np.sqrt(np.square(x).sum(axis=1))[:, None]
                    loose = 1e-6 * (1 + far) + norm
                    inside = (far + level.radius[None] + loose <= level.epsilon) & (sizes > 0)[None]
                    asked = ~inside & ~(far > level.epsilon + level.radius[None] + loose) & (sizes > 0)[None]
                    mine = np.flatnonzero(own >= 0)
                    inside[mine, own[mine]] = asked[mine, own[mine]] = False
                    reach = level.cell_radius[None] + level.epsilon + 1e-6 * (1 + level.cell_radius[None]) + norm
                    near = (level.pivots.margins(gaps, home, norm) <= level.epsilon) & (np.sqrt(gaps) <= reach) & (level.cell_n > 0)[None]
                    near[np.arange(n), home] = True
                    near[mine] = False
                heavy = np.where(own >= 0, own + base[0], -1)
                sure = inside @ sizes if inside.shape[1] else np.zeros(n, np.int64)
                sure = sure + np.where(own >= 0, sizes[own] - 1, 0) if len(sizes) else sure
                cell = np.repeat(np.arange(len(parts)), parts)
                names = ((cell + base[1]) << 32) + np.arange(len(cell)) - np.repeat(np.cumsum(parts) - parts, parts)
                nodes = np.arange(len(sizes), dtype=np.int32) + np.int32(base[0])
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("key"), pa.array(np.where(own >= 0, -1 - heavy, key)), rows.column("vec_id"), rows.column("vec"), rows.column("dim"), pa.array(heavy.astype(np.int32)),
                        pa.array(((home + base[1]) << 32) + key % parts[home]), pa.array(sure.astype(np.int64)), _lists(inside, nodes), _lists(asked, nodes), _lists(near[:, cell], names),
                    ],
                    schema=_PLACED,
                )

    return place


_FOUND = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("v", pa.int64()), ("root", pa.int64())])


def _compare(epsilon: float):
    """Links between the two sides of a task, or inside its only one; where members are asked, those of light rows count for both."""

    def compare(rows: pa.Table) -> pa.Table:
        side, asks = rows.column("side").to_numpy(), rows.column("asks").to_numpy()
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        key, v, vec = rows.column("key").to_numpy(), rows.column("v").to_numpy(), to_matrix(rows)
        alone = not rows.column("pair")[0].as_py()
        groups = [(x, None)] if alone else [(x, y)]
        if not alone and asks.any():  # members that are asked by members of other nodes don't count those again
            groups = [(x, y[asks[y] == 1]), (x, y[asks[y] == 2])]
        out = []
        for one, two in groups:
            links = count_links(vec[one], None if two is None else vec[two], epsilon)
            at = one if two is None else np.concatenate([one, two])
            count, root = links.count, links.root
            if two is not None and len(two) and asks[two[0]] == 2:
                count[: len(one)] = 0
            hit = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
            least = np.full(len(at), np.iinfo(np.int64).max)
            np.minimum.at(least, root, v[at])
            out.append((key[at[hit]], count[hit], v[at[hit]], least[root[hit]]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], schema=_FOUND)

    return compare


def near_classes(table: DataFrame, epsilon: float = EPSILON, block: int = BLOCK) -> DataFrame:
    """vec_id, class_id (the least vec_id of its class), n_links (other rows within ``epsilon``) of every distinct row."""
    rows = cut(valid_vectors(table).withColumn("h", row_hash()).withColumn("key", F.monotonically_increasing_id()))
    counted = rows.agg(F.count("*"), F.max("dim")).first()
    cells = max(1, -(-counted[0] // block))
    levels = {d: Level(m, cells, epsilon) for d, (_, m, _) in sample_of(rows, counted[1] or 1).items()}
    lean = rows.select("key", F.col("vec_id").cast("long").alias("vec_id"), "vec", "dim")
    others: dict[int, int] = {}
    for r in lean.mapInArrow(_sizes(levels), _SIZES_DDL).groupBy("dim", "heavy", "at").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect():  # a row for each centre, and for each length that the sample lacks
        if r["at"] < 0:
            others[r["dim"]] = r["n"]
            continue
        level = levels[r["dim"]]
        n, radius = (level.n, level.radius) if r["heavy"] else (level.cell_n, level.cell_radius)
        n[r["at"]], radius[r["at"]] = r["n"], r["radius"]
    first, nodes, places = {}, 0, 0
    for d, level in sorted(levels.items()):
        first[d] = (nodes, places)
        nodes, places = nodes + len(level.n), places + len(level.cell_n)
    placed = cut(lean.mapInArrow(_place(levels, first, others, block), _PLACED_DDL))

    # light rows: a task for each pair of parts of cells
    own = placed.filter("heavy < 0").withColumn("other", F.explode("near"))
    pair = lambda c: F.struct(F.col(c).alias("cell"), F.lit(0).alias("chunk"))
    pairs = own.select("dim", F.least(pair("sub"), pair("other")).alias("lo"), F.greatest(pair("sub"), pair("other")).alias("hi"), (F.col("sub") > F.col("other")).cast("int").alias("side"), (F.col("sub") != F.col("other")).alias("pair"), F.lit(0).alias("asks"), "key", "v", "vec")

    # rows that have to ask a node's members: a task for each part of the node and each chunk of those who ask
    asking = placed.filter("size(asks) > 0").select("dim", F.explode("asks").alias("cell"), "key", "v", "vec", F.when(F.col("heavy") < 0, 1).otherwise(2).alias("asks"))
    chunks = asking.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))
    sizes = F.broadcast(placed.filter("heavy >= 0").groupBy(F.col("heavy").alias("cell")).agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).join(chunks, "cell"))
    of = lambda n: F.pmod("key", F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = [F.struct((-1 - F.col("cell")).cast("long").alias("cell"), F.col(x).alias("chunk")).alias(y) for x, y in (("p", "lo"), ("c", "hi"))]
    members = placed.filter("heavy >= 0").select("dim", F.col("heavy").alias("cell"), "key", "v", "vec", F.lit(0).alias("asks")).join(sizes, "cell").withColumn("p", of("parts")).withColumn("c", every("chunks"))
    asking = asking.join(sizes, "cell").withColumn("c", of("chunks")).withColumn("p", every("parts"))
    members, asking = (x.select("dim", *at, F.lit(n).alias("side"), F.lit(True).alias("pair"), "asks", "key", "v", "vec") for n, x in enumerate((members, asking)))
    tasks = pairs.unionByName(members).unionByName(asking)
    found = cut(tasks.groupBy("dim", "lo", "hi").applyInArrow(_compare(epsilon), "key long, n long, v long, root long"))

    # classes over light rows and nodes
    linked = placed.filter("size(linked) > 0").select("v", F.explode("linked").alias("to"))
    links = found.select(F.col("v").alias("a"), F.col("root").alias("b")).unionByName(linked.select(F.col("v").alias("a"), (-1 - F.col("to")).cast("long").alias("b")).distinct())
    roots = components(links.filter("a <> b"))
    least = placed.groupBy("v").agg(F.min("vec_id").alias("least"))
    named = least.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("v", "class_id")
    more = linked.filter("v >= 0").groupBy(F.col("to").alias("heavy")).agg(F.count("*").alias("more"))
    heavy = F.broadcast(named.filter("v < 0").select((-1 - F.col("v")).cast("int").alias("heavy"), "class_id").join(more, "heavy", "left"))
    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    total = lambda *c: sum((F.coalesce(x, F.lit(0)) for x in c[1:]), F.coalesce(c[0], F.lit(0))).cast("long").alias("n_links")
    base = placed.select("key", "v", "vec_id", "heavy", "sure").join(counts, "key", "left")
    dense = base.filter("heavy >= 0").join(heavy, "heavy").select("vec_id", "class_id", total("sure", "n", "more"))
    return base.filter("heavy < 0").join(named.filter("v >= 0"), "v").select("vec_id", "class_id", total("sure", "n")).unionByName(dense)


def near_classes_sql(epsilon: float = EPSILON) -> str:
    """The same by DuckDB."""
    return f"""
WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY vec_id, e) AS k, vec_id, e FROM (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0)),
p AS (SELECT a.k AS a, b.k AS b FROM v a JOIN v b ON a.k <> b.k AND len(a.e) = len(b.e) WHERE list_distance(a.e, b.e) <= {epsilon}),
reach AS (SELECT k AS a, k AS b FROM v UNION SELECT r.a, p.b FROM reach r JOIN p ON p.a = r.b),
class AS (SELECT r.a AS k, min(v.vec_id) AS class_id FROM reach r JOIN v ON v.k = r.b GROUP BY r.a),
n AS (SELECT a AS k, count(*) AS n_links FROM p GROUP BY a)
SELECT v.vec_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM v JOIN class USING (k) LEFT JOIN n USING (k)
"""


ORACLE = near_classes_sql()
