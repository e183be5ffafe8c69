"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchstrata.core import collect_bounded, stored
from matchstrata.llm.base import query, table
from matchstrata.llm.components import components, forest

SIMILARITY = 0.95
#: Vectors of a block at most, and bytes of one; a block is what one task holds of either side.
BLOCK, BLOCK_BYTES = 8192, 4 << 20
#: Sampled vectors that route the others to cells, for each dimension; cells are split into blocks, so the bound doesn't limit sizes.
PIVOTS = 256
#: Dimensions that one table may mix.
DIMENSIONS = 1000
#: Members below which a node isn't split, pairs of members below which they are compared outright, and cells of a matrix at once.
LEAF, DIRECT, CELLS = 32, 1 << 16, 1 << 20
#: Radius below which a node isn't split, as single precision can't tell its members apart.
FINEST = 4e-3


def error(dim: int) -> float:
    """What single precision may be off by in the squared distance of two unit vectors: two roundings of each component and one of each step."""
    return 2 * (dim + 4) * 2.0**-23


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite component, not all zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(raw: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, whatever their size."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


class CoverTree:
    """Nested levels of centres with halving radii over unit vectors.

    A node is a run of ``order`` with a centre, the distance of its farthest member, and children that cover it with half the radius and
    have centres farther apart than that. Levels that would not split a node are left out.
    """

    def __init__(self, x: np.ndarray):
        self.x, self.error = x.astype(np.float32), error(x.shape[1])
        order, centre, radius, begin, stop, kids = [], [], [], [], [], []

        def node(members: np.ndarray, c: int, far: float, level: float) -> int:
            me = len(centre)
            centre.append(c)
            radius.append(far)
            begin.append(0)
            stop.append(0)
            kids.append([])
            todo.append((me, members, level))
            return me

        todo: list = []
        if len(x):
            node(np.arange(len(x)), 0, self._far(float((self.x @ self.x[0]).min())), 2.0)
        # Depth first, so that the members of a node stand together.
        stack = [todo.pop()] if todo else []
        while stack:
            me, members, level = stack.pop()
            if members is None:
                stop[me] = len(order)
                continue
            begin[me] = len(order)
            groups = [members]
            while len(members) > LEAF and radius[me] > FINEST and level > FINEST and len(groups) == 1:
                level /= 2
                groups = self._cover(members, level) if radius[me] > level else [members]
            if len(groups) == 1:
                order.extend(members.tolist())
                stop[me] = len(order)
                continue
            stack.append((me, None, 0))
            for some, c, far in reversed(groups):
                kids[me].append(node(some, c, far, level))
                stack.append(todo.pop())
            kids[me].reverse()
        self.order = np.asarray(order, dtype=np.int64)
        self.centre, self.radius = np.asarray(centre, dtype=np.int64), np.asarray(radius, dtype=np.float32)
        self.begin, self.stop = np.asarray(begin, dtype=np.int64), np.asarray(stop, dtype=np.int64)
        self.kid_at = np.concatenate(([0], np.cumsum([len(k) for k in kids]))).astype(np.int64)
        self.kids = np.asarray([k for ks in kids for k in ks], dtype=np.int64)

    def _far(self, dot: float) -> float:
        """The largest distance that a product of two of the vectors allows."""
        return float(np.sqrt(max(0.0, 2 - 2 * dot) + self.error))

    def _cover(self, members: np.ndarray, level: float) -> list:
        """Members in groups around centres farther apart than ``level``: (group, centre, farthest), the first member first."""
        out, rest, least = [], members, 1 - level * level / 2
        while len(rest):
            some = rest[:256]
            dot = self.x[some] @ self.x[rest].T
            free = np.ones(len(rest), dtype=bool)
            for i in range(len(some)):
                if free[i]:
                    near = free & (dot[i] >= least)
                    near[i] = True
                    free ^= near
                    group = rest[near]
                    far = self._far(float(dot[i][near].min())) if len(group) > 1 else 0.0
                    out.append((group, int(some[i]), far))
            rest = rest[free]
        return out if len(out) > 1 else [members]

    def members(self, u: int) -> np.ndarray:
        return self.order[self.begin[u] : self.stop[u]]

    def split(self, u: int) -> bool:
        return self.kid_at[u + 1] > self.kid_at[u]

    def children(self, u: int) -> np.ndarray:
        kids = self.kids[self.kid_at[u] : self.kid_at[u + 1]]
        return kids if len(kids) else np.asarray([u])

    FIELDS = ("order", "centre", "radius", "begin", "stop", "kid_at", "kids")

    @classmethod
    def restored(cls, x: np.ndarray, fields: dict) -> CoverTree:
        tree = cls.__new__(cls)
        tree.x, tree.error = x.astype(np.float32), error(x.shape[1])
        for f in cls.FIELDS:
            setattr(tree, f, fields[f])
        return tree


class Joined:
    """Links between the vectors of two trees, or of one with itself: how many each has, and edges that join what all links join."""

    def __init__(self, x: np.ndarray, y: np.ndarray, similarity: float, same: bool):
        self.x, self.y, self.similarity, self.same = x, y, similarity, same
        self.reach = float(np.sqrt(max(0.0, 2 - 2 * similarity)))
        self.n = np.zeros(len(x), dtype=np.int64)
        self.m = self.n if same else np.zeros(len(y), dtype=np.int64)
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def _edges(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links of positions a of x with b of y; many are replaced by a forest."""
        b = b if self.same else b + len(self.x)
        if len(a) > 4096:
            nodes, back = np.unique(np.concatenate((a, b)), return_inverse=True)
            root = forest(len(nodes), back[: len(a)], back[len(a) :])
            a, b = nodes, nodes[root]
        self.a.append(a)
        self.b.append(b)

    def whole(self, p: np.ndarray, q: np.ndarray) -> None:
        """Every member of p links to every one of q."""
        self.n[p] += len(q)
        self.m[q] += len(p)
        self._edges(p, np.full(len(p), q[0]))
        self._edges(np.full(len(q), p[0]), q)

    def direct(self, p: np.ndarray, q: np.ndarray, one: bool) -> None:
        """The double-precision test of every pair; ``one``: p and q are the same members."""
        step = max(1, CELLS // max(1, len(q)))
        for at in range(0, len(p), step):
            some = p[at : at + step]
            hit = self.x[some] @ self.y[q].T >= self.similarity
            if one:
                hit[np.arange(len(some)), np.arange(at, at + len(some))] = False
            if hit.any():
                self.n[some] += hit.sum(axis=1)
                if not one:
                    self.m[q] += hit.sum(axis=0)
                i, j = np.nonzero(hit)
                self._edges(some[i], q[j])

    def traverse(self, s: CoverTree, t: CoverTree) -> None:
        if not len(s.order) or not len(t.order):
            return
        todo = [(0, 0)]
        while todo:
            u, v = todo.pop()
            one = self.same and u == v
            p, q = s.members(u), t.members(v)
            # The first pair, and a node with itself, come without a bound.
            if one:
                every = 2 * s.radius[u] < self.reach
            else:
                apart = np.sqrt(max(0.0, 2 - 2 * float(s.x[s.centre[u]] @ t.x[t.centre[v]])) + s.error)
                every = apart + s.radius[u] + t.radius[v] < self.reach
            if len(p) * len(q) <= DIRECT:
                self.direct(p, q, one)
            elif every:
                self.all(p) if one else self.whole(p, q)
            elif not (s.split(u) or t.split(v)):
                self.direct(p, q, one)
            else:
                self._descend(s, u, t, v, one, todo)

    def all(self, p: np.ndarray) -> None:
        """Every two of p link."""
        self.n[p] += len(p) - 1
        self._edges(p, np.full(len(p), p[0]))

    def _descend(self, s: CoverTree, u: int, t: CoverTree, v: int, one: bool, todo: list) -> None:
        """Goes on with the pairs of children that may hold a link."""
        for a, b, every in self._close(s, self._items(s, u), t, self._items(t, v), one):
            if self.same and a == b:
                todo.append((a, b))
            elif every:
                self.whole(s.members(a), t.members(b))
            else:
                todo.append((a, b))

    @staticmethod
    def _items(tree: CoverTree, u: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centres, radii and numbers of a node's children; small wide ones as their members, points of radius 0 with number -1."""
        nodes = tree.children(u)
        size = tree.stop[nodes] - tree.begin[nodes]
        apart = (size == 1) | ((size <= LEAF) & (tree.radius[nodes] > 0.05))
        points = np.concatenate([np.empty(0, dtype=np.int64), *(tree.members(n) for n in nodes[apart].tolist())])
        whole = nodes[~apart]
        none = np.zeros(len(points))
        return np.concatenate((points, tree.centre[whole])), np.concatenate((none, tree.radius[whole])).astype(np.float32), np.concatenate((none - 1, whole)).astype(np.int64)

    def _close(self, s: CoverTree, left: tuple, t: CoverTree, right: tuple, one: bool) -> Iterator[tuple[int, int, bool]]:
        """Pairs that may hold a link: two points are decided here, others come out with whether all their members link to each other.

        Items of like radii are taken together, so that one bound on the product of unit vectors throws out most pairs at once. With
        ``one`` (children of one node with themselves) each pair of different items comes once, and each node with itself.
        """
        for mine in self._alike(left[1]):
            for other in self._alike(right[1]):
                farthest = self.reach + float(left[1][mine].max()) + float(right[1][other].max())
                least = 1 - farthest * farthest / 2 - s.error if farthest < 2 else -2.0
                x, y = s.x[left[0][mine]], t.x[right[0][other]].T
                step = max(1, CELLS // len(other))
                for at in range(0, len(mine), step):
                    dot = x[at : at + step] @ y
                    i, j = np.nonzero(dot >= least)
                    square = 2 - 2 * dot[i, j].astype(np.float64)
                    i, j = mine[i + at], other[j]
                    bounds = left[1][i] + right[1][j]
                    near = np.sqrt(np.maximum(square - s.error, 0)) - bounds <= self.reach
                    points = (left[2][i] < 0) & (right[2][j] < 0)
                    if one:
                        near &= (i < j) | ((i == j) & ~points)
                    both = near & points
                    self._points(left[0][i[both]], right[0][j[both]])
                    near &= ~points
                    inside = (np.sqrt(np.maximum(square, 0) + s.error) + bounds)[near] < self.reach
                    for a, b, k, l, every in zip(left[2][i[near]].tolist(), right[2][j[near]].tolist(), left[0][i[near]].tolist(), right[0][j[near]].tolist(), inside.tolist()):
                        if a >= 0 and b >= 0:
                            yield a, b, every
                        else:  # a point with a node
                            p = s.members(a) if a >= 0 else np.asarray([k])
                            q = t.members(b) if b >= 0 else np.asarray([l])
                            (self.whole if every else self.direct)(p, q, *([] if every else [False]))

    def _points(self, p: np.ndarray, q: np.ndarray) -> None:
        """The double-precision test of single pairs."""
        for at in range(0, len(p), 1 << 16):
            a, b = p[at : at + (1 << 16)], q[at : at + (1 << 16)]
            hit = np.einsum("ij,ij->i", self.x[a], self.y[b]) >= self.similarity
            a, b = a[hit], b[hit]
            if len(a):
                np.add.at(self.n, a, 1)
                np.add.at(self.m, b, 1)
                self._edges(a, b)

    @staticmethod
    def _alike(radius: np.ndarray) -> Iterator[np.ndarray]:
        """Positions of items in classes of radius: points, tight nodes, wide ones."""
        kind = np.digitize(radius, (1e-9, 0.05, 0.3))
        for k in range(4):
            if len(some := np.flatnonzero(kind == k)):
                yield some

    def roots(self) -> np.ndarray:
        """For every position of x, then of y, the smallest position that links reach."""
        n = len(self.x) + (0 if self.same else len(self.y))
        none = np.empty(0, dtype=np.int64)
        return forest(n, np.concatenate([none, *self.a]), np.concatenate([none, *self.b]))


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as held:
        return {k: held[k] for k in held.files}


def _matrix(column: pa.ChunkedArray | pa.Array, dtype: str) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), dtype=dtype).reshape(len(data), -1)


def linked(vectors: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """n and root of every vector that links to another: rows (vec_id, vk, n, root), to be summed by (vec_id, vk).

    ``vectors`` has vec_id, vk (a hash of the vector) and embedding, usable ones only. Vectors go to the cell of their nearest pivot;
    cells are cut into blocks by a hash; cells that lie farther apart than their radii allow are never paired.
    """
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    dtype = "<f4" if single else "<f8"
    sized = vectors.withColumn("dim", F.size("embedding"))
    dims = {r.dim: r.n for r in collect_bounded(sized.groupBy("dim").agg(F.count("*").alias("n")), DIMENSIONS, "dimensions")}
    pivots: dict[int, np.ndarray] = {}
    room = {d: max(64, min(block, BLOCK_BYTES // (8 * d))) for d in dims}
    for d, n in dims.items():
        some = sized.where(F.col("dim") == d).orderBy(F.xxhash64("vk"), "vec_id").limit(min(PIVOTS, -(-n // room[d]))).select("embedding").collect()
        pivots[d] = units(np.asarray([r.embedding for r in some]))
    first, upto = {}, 0
    for d in sorted(dims):
        first[d] = upto
        upto += len(pivots[d])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, dim = batch.column("embedding"), batch.column("dim").to_numpy()
            flat, at = lists.flatten().to_numpy().astype(dtype), np.concatenate(([0], np.cumsum(dim)))
            cell, far, data = np.empty(len(dim), dtype=np.int32), np.empty(len(dim)), [b""] * len(dim)
            for d in np.unique(dim):
                rows = np.flatnonzero(dim == d)
                raw = flat[at[rows][:, None] + np.arange(d)]
                away = distances(units(raw), pivots[int(d)])
                near = away.argmin(axis=1)
                cell[rows], far[rows] = first[int(d)] + near, away[np.arange(len(rows)), near]
                for r, x in zip(rows.tolist(), raw):
                    data[r] = x.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vk"), pa.array(cell), pa.array(far), pa.array(data, pa.binary())], names=["vec_id", "vk", "cell", "far", "data"])

    routed = sized.select("vec_id", "vk", "embedding", "dim").mapInArrow(route, "vec_id long, vk long, cell int, far double, data binary")
    routed = stored(routed)
    cells = {r.cell: (r.n, r.far) for r in routed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # at most a row per pivot
    reach = float(np.sqrt(max(0.0, 2 - 2 * similarity))) + 1e-6  # cells are measured in double precision
    cuts, near = {}, {}
    for d in dims:
        mine = [c for c in range(first[d], first[d] + len(pivots[d])) if c in cells]
        apart = distances(pivots[d], pivots[d])
        for c in mine:
            cuts[c] = -(-cells[c][0] // room[d])
            near[c] = [o for o in mine if apart[c - first[d], o - first[d]] - cells[c][1] - cells[o][1] <= reach]
    if not cells:
        return spark.createDataFrame([], "vec_id long, vk long, n long, root long")
    base = dict(zip(sorted(cuts), np.concatenate(([0], np.cumsum([cuts[c] for c in sorted(cuts)])))[:-1].tolist()))
    shared = spark.sparkContext.broadcast((cuts, near, base))  # a few numbers per pivot

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, _, base = shared.value
        for batch in batches:
            cell, h = batch.column("cell").to_pylist(), batch.column("h").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([base[c] + x % cuts[c] for c, x in zip(cell, h)], pa.int32()), *batch.columns[:4]], names=["block", "vec_id", "vk", "cell", "data"])

    def grow(group: pa.Table) -> pa.Table:
        raw = _matrix(group.column("data"), dtype)
        tree = CoverTree(units(raw))
        payload = _packed(ids=group.column("vec_id").to_numpy(), vk=group.column("vk").to_numpy(), raw=raw, **{f: getattr(tree, f) for f in CoverTree.FIELDS})
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "cell": pa.array([group.column("cell")[0].as_py()], pa.int32()), "tree": pa.array([payload], pa.binary())})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, near, base = shared.value
        for batch in batches:
            for me, cell, tree in zip(*(batch.column(c) for c in ("block", "cell", "tree"))):
                me = me.as_py()
                for other in near[cell.as_py()]:
                    for o in range(base[other], base[other] + cuts[other]):
                        yield pa.RecordBatch.from_arrays([pa.array([min(me, o)], pa.int32()), pa.array([max(me, o)], pa.int32()), pa.array([int(me > o)], pa.int32()), pa.array([tree.as_py()], pa.binary())], names=["lo", "hi", "side", "tree"])

    def meet(group: pa.Table) -> pa.Table:
        sides = dict(zip(group.column("side").to_pylist(), group.column("tree").to_pylist()))
        same = group.column("lo")[0].as_py() == group.column("hi")[0].as_py()
        if not same and len(sides) < 2:  # a block that got no vector
            return pa.table({c: pa.array([], pa.int64()) for c in ("vec_id", "vk", "n", "root")})
        left = _unpacked(sides[0])
        right = left if same else _unpacked(sides[1])
        x = units(left["raw"])
        y = x if same else units(right["raw"])
        found = Joined(x, y, similarity, same)
        s = CoverTree.restored(x, left)
        found.traverse(s, s if same else CoverTree.restored(y, right))
        ids = left["ids"] if same else np.concatenate((left["ids"], right["ids"]))
        vk = left["vk"] if same else np.concatenate((left["vk"], right["vk"]))
        n = found.n if same else np.concatenate((found.n, found.m))
        rows = np.flatnonzero(n)
        return pa.table({"vec_id": pa.array(ids[rows]), "vk": pa.array(vk[rows]), "n": pa.array(n[rows]), "root": pa.array(ids[found.roots()[rows]])})

    blocks = (
        routed.select("vec_id", "vk", "cell", "data", F.pmod(F.xxhash64("vec_id", "vk"), F.lit(1 << 40)).alias("h"))
        .mapInArrow(number, "block int, vec_id long, vk long, cell int, data binary")
        .groupBy("block")
        .applyInArrow(grow, "block int, cell int, tree binary")
    )
    dealt = stored(blocks).mapInArrow(deal, "lo int, hi int, side int, tree binary")
    return dealt.groupBy("lo", "hi").applyInArrow(meet, "vec_id long, vk long, n long, root long")


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding).

    Vectors of one length whose cosine is at least ``similarity`` (above 0) link. A null vector, one with a null or non-finite
    component and an all-zero or empty one link with nothing, nor does a row without vec_id, whose component is null and which isn't
    kept. Each repeated row counts as a vector of its own, and rows of one vec_id are in one component. No rows give no rows.
    """
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("vk", F.xxhash64("embedding"))
    found = stored(linked(kept.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))), similarity, block))
    whole = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    # Repeated rows have one vk, and each has all their links.
    repeats = kept.groupBy("vec_id", "vk").agg(F.count("*").alias("rows"))
    links = found.groupBy("vec_id", "vk").agg(F.sum("n").alias("n")).join(repeats, ["vec_id", "vk"]).select("vec_id", "vk", (F.col("n") / F.col("rows")).cast("long").alias("n_links"))
    out = kept.join(links, ["vec_id", "vk"], "left").join(whole.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


@query(
    "op10_cover_tree_duplicates",
    f"""
    WITH RECURSIVE v AS (
      SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS w FROM embeddings
      WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), l AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.w) = len(b.w)
      WHERE list_cosine_similarity(a.w, b.w) >= {SIMILARITY}
    ), r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
    SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.c, vec_id) AS component_id, vec_id = coalesce(c.c, vec_id) AS kept
    FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
