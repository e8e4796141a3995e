"""Exact top-k by inner product over a paged M-tree.

Vectors of whole numbers get one more component, which brings them all to the length of the longest; then the inner
product with a query falls exactly as the Euclidean distance to it grows, and a metric tree finds the highest products.
The root page holds a bounded number of routing objects with covering radii; below each stand one or more
subtrees, written as a table with one row for each page: centre, radius, distance to the parent's centre, and entries
with their distances to the page's own centre. A best-first search opens pages by their least possible distance and
leaves out entries, without computing their distance, by the triangle inequality over the stored ones.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.plans.shared import cut, cut_and_sum

#: What a component is multiplied by before it is rounded down.
UNITS = 1024
#: Entries of a page; rows for each routing object of the root that are aimed at; routing objects and numbers that the root may hold.
PAGE, ROUTED, ROOT, ROOT_NUMBERS = 64, 512, 4096, 1 << 20
#: Rows of a subtree at most: two routing objects' worth where they are few, and never more than SUBTREE.
SUBTREE = 65_536
#: Queries that meet a subtree in one task.
BLOCK = 8192
#: Sums of squares below this are exact as doubles, so products are taken as doubles.
EXACT = float(1 << 52)
#: Distances are compared with this slack, as a share of the longest vector; it covers their rounding.
SLACK = 1e-5


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>): components times UNITS, rounded down; without null vectors and those that hold null, NaN or infinity."""
    scaled = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * UNITS).cast("double"))
    good = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < 1e15))
    wide = F.col(vector).isNotNull() & F.exists(vector, lambda x: (F.abs(x.cast("double")) >= 1e15) & (F.abs(x.cast("double")) < float("inf")))
    checked = F.when(F.coalesce(wide, F.lit(False)), F.raise_error(F.lit("a component of 1e15 or more: products do not fit a long"))).otherwise(good)
    return rows.where(checked).select(F.col(vec_id).cast("long").alias("vec_id"), scaled.alias("v"))


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """(n, dim) doubles of a list array; shorter vectors are filled with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Space:
    """Distances of the lifted vectors: top is the largest sum of squares of all vectors."""

    def __init__(self, dim: int, top: float):
        self.dim, self.top = dim, top
        self.slack = SLACK * np.sqrt(top)

    def lifted(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(self.top - np.einsum("ij,ij->i", v, v), 0))])

    @staticmethod
    def apart(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """Distances of lifted points from a lifted centre."""
        d = points - centre
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def products(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Inner products of v with q: exact, as doubles where they fit, else as longs."""
        return v @ q if self.top < EXACT else v.astype(np.int64) @ q.astype(np.int64)

    def distance(self, own: float, products: np.ndarray) -> np.ndarray:
        """Distances of a query, whose sum of squares is own, from lifted vectors by their products with it."""
        return np.sqrt(np.maximum(own + self.top - 2.0 * products.astype(np.float64), 0))


def _seeds(points: np.ndarray, n: int) -> np.ndarray:
    """n places, evenly through the order of distance from the first point."""
    order = np.argsort(Space.apart(points, points[0]), kind="stable")
    return order[np.linspace(0, len(points) - 1, n).astype(int)]


def build_pages(v: np.ndarray, space: Space) -> list[dict]:
    """Pages of an M-tree over the rows of v, the root first; page numbers are places in the list.

    A page: leaf, centre (place of a row of v), radius (all rows below lie within it), parent distance (between its
    centre and that of the page above), entries (rows of v in a leaf, else pages) and their distances to its centre.
    Loaded in bulk: rows go to the nearest of PAGE seeds, part by part, until a part fits a leaf; parts that no seed
    divides, as of equal rows, are halved.
    """
    points = space.lifted(v)
    pages: list[dict] = []

    def make(rows: np.ndarray, above: int | None) -> int:
        own = points[rows]
        centre = int(rows[np.argmin(Space.apart(own, own.mean(axis=0)))])
        far = Space.apart(own, points[centre])
        page = {"leaf": len(rows) <= PAGE, "centre": centre, "radius": float(far.max()), "up": float(Space.apart(points[[centre]], points[above])[0]) if above is not None else 0.0}
        number = len(pages)
        pages.append(page)
        if page["leaf"]:
            page |= {"entries": rows, "away": far}
            return number
        n = min(PAGE, -(-len(rows) // (PAGE // 2)))
        seeds = points[rows[_seeds(own, n)]]
        near = np.argmin(np.einsum("ij,ij->i", seeds, seeds)[None, :] - 2 * own @ seeds.T, axis=1)
        parts = [rows[near == k] for k in range(n)]
        parts = [p for p in parts if len(p)]
        if len(parts) == 1:
            parts = np.array_split(rows, 2)
        below = [make(p, centre) for p in parts]
        page |= {"entries": np.array(below), "away": np.array([pages[p]["up"] for p in below])}
        return number

    make(np.arange(len(v)), None)
    return pages


class Tree:
    """A subtree as read from its pages."""

    def __init__(self, table: pa.Table, space: Space):
        rows = table.sort_by("page").to_pydict()
        self.space, self.leaf, self.radius, self.away = space, rows["leaf"], np.array(rows["radius"]), [np.array(x) for x in rows["away"]]
        self.centre = matrix(table.sort_by("page").column("centre"), space.dim)
        self.entries = [np.array(x, np.int64) if x is not None else None for x in rows["entries"]]
        self.v = [np.frombuffer(x, np.float64).reshape(-1, space.dim) if x else None for x in rows["vectors"]]
        self.uid = [np.array(x, np.int64) if x is not None else None for x in rows["uids"]]
        nulls = [[y is None for y in x] if x is not None else None for x in rows["vec_ids"]]
        self.unnamed = [np.array(x, bool) if x is not None else None for x in nulls]
        self.vec_id = [np.array([0 if y is None else y for y in x], np.int64) if x is not None else None for x in rows["vec_ids"]]
        self.computed = 0  # distances, for tests

    def search(self, q: np.ndarray, own_uid: int, k: int, least: float) -> list[tuple]:
        """The k best (product, unnamed, vec_id, row) beyond the query's own row, of products of at least `least`."""
        space, own = self.space, float(q @ q)
        best: list[tuple] = []  # ascending by (-product, unnamed, vec_id)
        limit = float(space.distance(own, np.array([least]))[0]) if least > -np.inf else np.inf
        first = space.distance(own, space.products(q, self.centre[:1]))[0]
        self.computed += 1
        heap = [(max(first - self.radius[0], 0.0), 0, first)]
        while heap:
            bound, page, here = heapq.heappop(heap)
            if bound > limit + space.slack:
                break
            if not self.leaf[page]:
                below = self.entries[page]
                below = below[np.abs(here - self.away[page]) - self.radius[below] <= limit + space.slack]
                if len(below):
                    d = space.distance(own, space.products(q, self.centre[below]))
                    self.computed += len(below)
                    for at, p, x in zip(np.maximum(d - self.radius[below], 0).tolist(), below.tolist(), d.tolist(), strict=True):
                        if at <= limit + space.slack:
                            heapq.heappush(heap, (at, p, x))
                continue
            can = np.flatnonzero((np.abs(here - self.away[page]) <= limit + space.slack) & (self.uid[page] != own_uid))
            if not len(can):
                continue
            s = space.products(q, self.v[page][can])
            self.computed += len(can)
            floor = best[-1][0] if len(best) == k else least
            good = s >= floor
            if good.any():
                can, s = can[good], s[good]
                some = zip((-s).tolist(), self.unnamed[page][can].tolist(), self.vec_id[page][can].tolist(), strict=True)
                best = sorted([*((-b[0], *b[1:]) for b in best), *some])[:k]
                best = [(-b[0], *b[1:]) for b in best]
                if len(best) == k:
                    limit = min(limit, float(space.distance(own, np.array([best[-1][0]]))[0]))
        return best


def _rooted(vectors: DataFrame, pivots: np.ndarray, space: Space) -> DataFrame:
    """vectors with the nearest routing object and the distance to it."""
    lifted = space.lifted(pivots)
    squares = np.einsum("ij,ij->i", lifted, lifted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = space.lifted(matrix(b.column("v"), space.dim))
            near = np.concatenate([np.argmin(squares[None, :] - 2 * points[i : i + 2048] @ lifted.T, axis=1) for i in range(0, len(points), 2048)] or [np.empty(0, np.int64)])
            d = points - lifted[near]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(np.sqrt(np.einsum("ij,ij->i", d, d)))], [*b.schema.names, "pivot", "far"])

    return vectors.mapInArrow(run, "uid long, vec_id long, v array<double>, pivot int, far double")


PAGES = "tree long, page int, leaf boolean, centre array<double>, radius double, up double, entries array<int>, away array<double>, uids array<long>, vec_ids array<long>, vectors binary"


def _pages_of(space: Space):
    def of(key: tuple, table: pa.Table) -> pa.Table:
        v = matrix(table.column("v"), space.dim)
        uids, names = table.column("uid").to_numpy(), table.column("vec_id").combine_chunks()
        pages = build_pages(v, space)
        inner = lambda p, x: None if p["leaf"] else x
        outer = lambda p, x: x if p["leaf"] else None
        return pa.table({
            "tree": pa.array([key[0].as_py()] * len(pages), pa.int64()), "page": pa.array(range(len(pages)), pa.int32()), "leaf": pa.array([p["leaf"] for p in pages]),
            "centre": pa.array([v[p["centre"]] for p in pages], pa.list_(pa.float64())), "radius": pa.array([p["radius"] for p in pages]), "up": pa.array([p["up"] for p in pages]),
            "entries": pa.array([inner(p, p["entries"]) for p in pages], pa.list_(pa.int32())), "away": pa.array([p["away"] for p in pages], pa.list_(pa.float64())),
            "uids": pa.array([outer(p, uids[p["entries"]] if p["leaf"] else None) for p in pages], pa.list_(pa.int64())),
            "vec_ids": pa.array([names.take(pa.array(p["entries"])).to_pylist() if p["leaf"] else None for p in pages], pa.list_(pa.int64())),
            "vectors": pa.array([v[p["entries"]].tobytes() if p["leaf"] else None for p in pages], pa.binary()),
        })

    return of


class Index:
    """A written M-tree: the root's routing objects with covering radii, and the table of pages below them."""

    def __init__(self, space: Space, pivots: np.ndarray, radius: np.ndarray, chunks: np.ndarray, pages: DataFrame, vectors: DataFrame):
        self.space, self.pivots, self.radius, self.chunks, self.pages, self.vectors = space, pivots, radius, chunks, pages, vectors


def build(vectors: DataFrame) -> Index | None:
    """The M-tree of (vec_id, v) rows; None if there is none.

    Routing objects are those rows whose numbers hash least: one for ROUTED rows, at most ROOT, and so many that they hold at most
    ROOT_NUMBERS components; the rows of one that has more than its share are dealt over several subtrees by number,
    so no vector, however often it is repeated, fills one task.
    """
    numbered = vectors.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "v")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows, seen = cut_and_sum(numbered, "vectors", n=F.count("*"), dim=F.max(F.size("v")), top=F.max(squares))
    n, dim = seen["n"], max(seen["dim"] or 0, 1)
    if not n:
        return None
    if seen["top"] >= float(1 << 62):
        raise ArithmeticError("inner products of these vectors do not fit a long")
    space = Space(dim, max(seen["top"], 1.0))
    wanted = max(1, min(-(-n // ROUTED), ROOT, ROOT_NUMBERS // dim))
    drawn = rows.orderBy(F.xxhash64("uid"), "uid").limit(wanted).select("v").toArrow()
    pivots = np.unique(matrix(drawn.column("v"), dim), axis=0)
    rooted = cut(_rooted(rows, pivots, space), "rooted")
    most = min(SUBTREE, max(2 * ROUTED, 2 * n // len(pivots)))
    sizes = rooted.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # a row for each routing object
    chunks, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in sizes:
        chunks[r["pivot"]], radius[r["pivot"]] = -(-r["n"] // most), r["radius"]
    tree = tree_of(F.col("pivot"), F.pmod(F.xxhash64("uid"), F.get(F.lit(chunks.tolist()), F.col("pivot"))))
    pages = cut(rooted.withColumn("tree", tree).groupBy("tree").applyInArrow(_pages_of(space), PAGES), "mtree")
    return Index(space, pivots, radius, chunks, pages, rooted)


def tree_of(pivot: Column, chunk: Column) -> Column:
    return (pivot.cast("long") * (1 << 32) + chunk).alias("tree")


def _routed(index: Index, again: bool):
    """For mapInArrow over (quid, query_id, v, least): each query with the subtrees that it has to see.

    At first (again = False) one subtree of the nearest routing object; again: all others that its bound does not rule out.
    """
    space, pivots, radius, chunks = index.space, index.pivots, index.radius, index.chunks
    filled = np.flatnonzero(chunks > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = matrix(b.column("v"), space.dim)
            least = np.asarray(b.column("least").to_numpy(zero_copy_only=False), np.float64)
            own, trees = [], []
            for i in range(len(q)):
                squares = float(q[i] @ q[i])
                d = space.distance(squares, space.products(q[i], pivots))
                home = int(filled[np.argmin(d[filled])])
                if not again:
                    picked = np.array([home << 32])
                else:
                    limit = float(space.distance(squares, least[i : i + 1])[0]) if least[i] > -np.inf else np.inf
                    near = filled[(d - radius)[filled] <= limit + space.slack]
                    picked = np.concatenate([(p << 32) + np.arange(int(p == home), chunks[p]) for p in near] or [np.empty(0, np.int64)])
                own.append(np.full(len(picked), i))
                trees.append(picked)
            at = pa.array(np.concatenate(own or [np.empty(0, np.int64)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(trees or [np.empty(0, np.int64)]).astype(np.int64)), *[c.take(at) for c in b.columns]], ["tree", *b.schema.names])

    return run


FOUND = "quid long, query_id long, vec_id long, score long"


def _search(index: Index, routed: DataFrame, blocks: int, k: int) -> DataFrame:
    """(quid, query_id, vec_id, score): the k best of each query in each of its subtrees, block of queries by block."""
    space = index.space

    def of(_: tuple, pages: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if pages.num_rows and queries.num_rows:
            tree = Tree(pages, space)
            q = matrix(queries.column("v"), space.dim)
            for i, (quid, query_id, least) in enumerate(zip(*(queries.column(c).to_pylist() for c in ("quid", "query_id", "least")), strict=True)):
                for score, unnamed, vec_id in tree.search(q[i], quid, k, least):
                    for column, x in zip(out, (quid, query_id, None if unnamed else vec_id, int(score)), strict=True):
                        column.append(x)
        return pa.table({name: pa.array(column, pa.int64()) for name, column in zip(("quid", "query_id", "vec_id", "score"), out, strict=True)})

    block = F.pmod(F.xxhash64("quid"), F.lit(blocks)).cast("int").alias("block")
    pages = index.pages.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return pages.groupBy("tree", "block").cogroup(routed.select("*", block).groupBy("tree", "block")).applyInArrow(of, FOUND)


def top_k(rows: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank int, vec_id, score long): of each row that is_query holds for, the k rows of highest integer inner
    product, its own row left out; ties go to the smaller vec_id, those without one last. is_query reads vec_id.

    Components are floor(UNITS * x). Rows whose vector is null, or holds null or a non-finite number, take no part.
    Shorter vectors count as filled with zeros, an empty one has product 0 with all. Rows that repeat a vec_id or a vector are rows of
    their own: each is found, and each is a query. Products are exact while they fit a long; vectors for which they may
    not raise. An empty table gives no rows; other columns are not read.

    Two searches: each query in one subtree of its nearest routing object, which bounds its k-th product from below,
    then in all that this bound does not rule out. Queries meet subtrees in blocks of BLOCK, so no task holds more than a
    block and a subtree, and the result of each is at most k rows a query.
    """
    index = build(whole_vectors(rows, vec_id, vector))
    if index is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries, seen = cut_and_sum(index.vectors.where(is_query).select(F.col("uid").alias("quid"), F.col("vec_id").alias("query_id"), "v", F.lit(float("-inf")).alias("least")), "queries", n=F.count("*"))
    blocks = max(1, -(-seen["n"] // BLOCK))
    routed = "tree long, quid long, query_id long, v array<double>, least double"
    first = cut(_search(index, queries.mapInArrow(_routed(index, False), routed), blocks, k), "first")
    bound = first.groupBy("quid").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("low")).where(F.col("n") >= k)
    known = cut(queries.drop("least").join(bound, "quid", "left").select("quid", "query_id", "v", F.coalesce("low", F.lit(float("-inf"))).alias("least")), "bounds")
    rest = _search(index, known.mapInArrow(_routed(index, True), routed), blocks, k)
    from pyspark.sql import Window

    order = Window.partitionBy("quid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
