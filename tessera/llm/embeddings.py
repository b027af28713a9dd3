"""Embedding near duplicates: PCA-ordered, tiled, exact comparison by cosine.

Unit vectors are rotated to their principal axes.  Two unit vectors of cosine
``t`` or more lie at most ``sqrt(2 - 2t)`` apart, so a grid of cells of ``CELL`` of that
width along the first ``GRID_AXES`` axes needs comparing only between cells whose
vectors' bounding boxes come that near; other pairs of cells are passed over before any
vector is copied.  Where that spares no
copies, fewer axes or none are used.  A cell is cut into tiles of at most about ``TILE``
vectors by hash,
and each pair of tiles of near cells is one task.  It accumulates products dimension
block by dimension block, leading ones first: what is summed so far plus the product of
both suffix norms bounds the cosine, pairs below the threshold are dropped at each block,
and a stripe of the tile with no pair left is done.  Equal vectors are compared once and
counted with their number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, written
from .simhash import _join

#: Vectors of a tile, and their components, at most.
TILE, TILE_COMPONENTS = 8192, 1 << 22
#: Vectors of a tile that are compared with the other tile at once.
BLOCK = 512
#: Where blocks of dimensions end, as parts of all.
BLOCK_ENDS = (0.25, 0.5, 0.75, 1.0)
#: One pair in so many left is few.
FEW = 64
#: Axes of the grid of cells, and a cell's width as a part of the farthest that a link reaches.
GRID_AXES, CELL = 3, 0.75
#: At most so many cells a side: two unit lengths, in widths.
SIDE = 64
#: Pairs whose components are gathered at once.
GATHER = 1 << 16
#: Room for rounding in bounds; pairs as near as that to the threshold are computed again from the given components.
SLACK = 1e-9


def _gram(dim: int):
    def run(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            x = _matrix(b.column(0), dim)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": list(range(dim)), "row": list(total)}, schema=pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))]))

    return run


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    # scaled by the largest component first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Columns: axes of falling variance about zero of all unit vectors; ``dim * dim`` sums reach the driver."""
    parts = vectors.select("v").mapInArrow(_gram(dim), "i int, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    gram = np.zeros((dim, dim))
    for r in sums:
        gram[r["i"], r["j"]] = r["x"]
    return np.linalg.eigh(gram)[1][:, ::-1].copy()


def _grid(axes: np.ndarray, width: float):
    """Each vector with its cell and its place along the first axes."""
    dim, first = len(axes), axes[:, :GRID_AXES]

    def run(batches):
        for b in batches:
            at = _matrix(b.column("v"), dim) @ first
            steps = np.clip(np.floor((at + 1) / width), 0, SIDE - 1).astype(np.int64)
            cell = steps @ SIDE ** np.arange(at.shape[1])
            places = [pa.array(np.ascontiguousarray(at[:, k]) if k < at.shape[1] else np.zeros(len(at))) for k in range(GRID_AXES)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), *places], names=[*b.schema.names, "cell", *_places()])

    return run


def _places() -> list[str]:
    return [f"p{k}" for k in range(GRID_AXES)]


def near_cells(boxes: list[tuple[np.ndarray, np.ndarray]], reach: float) -> list[tuple[int, int]]:
    """Index pairs ``i <= j`` of boxes ``(lowest, highest)`` that come within ``reach`` of each other."""
    low, high = (np.array([b[k] for b in boxes]) for k in (0, 1))
    out = []
    for i in range(len(boxes)):
        gap = np.maximum(0, np.maximum(low[i:] - high[i], low[i] - high[i:]))
        out += [(i, i + int(j)) for j in np.flatnonzero((gap**2).sum(1) <= reach**2)]
    return out


def best_grid(boxes: dict[int, tuple[int, np.ndarray, np.ndarray]], reach: float, tile: int):
    """By how many axes to tell cells apart so that the fewest copies of vectors are made; ``boxes``: number, lowest and highest of each cell.

    Fewer axes are better where boxes are near anyway.  Returns that number, the tiles of
    each cell, and ``(cell, near cell, its tiles)``.
    """
    best = None
    for used in range(GRID_AXES + 1):
        merged: dict[int, tuple] = {}
        for cell, (n, low, high) in boxes.items():
            m, lo, hi = merged.get(cell % SIDE**used, (0, low, high))
            merged[cell % SIDE**used] = (m + n, np.minimum(lo, low), np.maximum(hi, high))
        names = sorted(merged)
        tiles = {c: math.ceil(merged[c][0] / tile) for c in names}
        near = near_cells([merged[c][1:] for c in names], reach)
        partners = [(names[i], names[j], tiles[names[j]]) for a, b in near for i, j in {(a, b), (b, a)}]
        copies = sum(merged[c][0] * t for c, _, t in partners)
        if best is None or copies < best[0]:
            best = copies, used, tiles, partners
    return best[1:]


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float, ends: list[int]):
    """Blocks of index pairs ``(i, j)`` and their cosine, for unit rows in PCA order; ``ends``: where blocks of dimensions end."""
    parts_x, parts_y = _parts(x, ends), _parts(y, ends, -1.0)
    for lo in range(0, len(x), BLOCK):
        bound, i = None, None
        for n, (e, px, py) in enumerate(zip(ends, parts_x, parts_y)):
            if i is None:
                more = px[lo : lo + BLOCK] @ py.T
                bound = more if bound is None else np.add(bound, more, out=bound)
                near = bound >= threshold - SLACK
                left = np.count_nonzero(near)
                if not left:
                    break
                if left * FEW <= near.size or e == ends[-1]:  # few: from here on pair by pair
                    i, j = np.nonzero(near)
                    total, i = bound[i, j], i + lo
            else:
                for k in range(0, len(i), GATHER):
                    s = slice(k, k + GATHER)
                    total[s] += np.einsum("ij,ij->i", px[i[s]], py[j[s]])
                near = total >= threshold - SLACK
                i, j, total = i[near], j[near], total[near]
                if not len(i):
                    break
        if i is not None and len(i):
            yield i, j, total


def _parts(a: np.ndarray, ends: list[int], sign: float = 1.0) -> list[np.ndarray]:
    """Blocks of dimensions, each with the norm of what follows it and of what followed the one before, the latter by ``sign``.

    Products of such rows of unlike signs, summed up to a block, are the products so far plus that of
    both norms of the rest: a bound of the cosine, and after the last block the cosine.
    """
    out, begin, before = [], 0, None
    for e in ends:
        rest = np.linalg.norm(a[:, e:], axis=1, keepdims=True) if e < a.shape[1] else np.zeros((len(a), 1))
        out.append([a[:, begin:e], rest] + ([] if before is None else [sign * before]))
        begin, before = e, rest
    return [np.hstack(x) for x in out]


def _compare(axes: np.ndarray, threshold: float):
    dim = len(axes)
    ends = sorted({max(1, math.ceil(dim * part)) for part in BLOCK_ENDS})
    empty = pa.table({k: pa.array([], pa.int64()) for k in ("id", "links", "up")})

    def run(table: pa.Table) -> pa.Table:
        sides = {}
        if table.num_rows == 1 and table.column("a")[0] != table.column("b")[0]:
            return empty  # the other tile got no vector
        for k in range(table.num_rows):  # one or two tiles
            members = table.column("members")[k].values
            raw = members.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            unit = _matrix(members.field("v"), dim)
            sides[table.column("own")[k].as_py()] = (raw, unit @ axes, members.field("id").to_numpy(), members.field("n").to_numpy())
        tiles = [sides[k] for k in sorted(sides)]
        (raw_x, x, ids_x, n_x), (raw_y, y, ids_y, n_y) = tiles[0], tiles[-1]
        same = len(tiles) == 1
        ids = ids_x if same else np.r_[ids_x, ids_y]
        off = 0 if same else len(ids_x)
        count, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, j, cos in close_pairs(x, y, threshold, ends):
            if same:
                i, j, cos = i[i < j], j[i < j], cos[i < j]
            edge = np.abs(cos - threshold) <= SLACK
            if edge.any():
                cos[edge] = [exact_cosine(raw_x[a], raw_y[b]) for a, b in zip(i[edge], j[edge])]
                i, j = i[cos >= threshold], j[cos >= threshold]
            if len(i):
                np.add.at(count, i, n_y[j])
                np.add.at(count, j + off, n_x[i])
                labels = _join(labels, i, j + off)
        found = np.flatnonzero(count)
        return pa.table({"id": ids[found], "links": count[found], "up": ids[labels[found]]})

    return run


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine of the given components; only where squares would overflow or vanish they are scaled, by powers of two."""
    high = max(np.abs(a).max(), np.abs(b).max())
    low = min(np.abs(a).max(), np.abs(b).max())
    if not 1e-100 < low <= high < 1e100:
        a, b = (np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) for v in (a, b))
    return float(np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b)))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", tile: int | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors``.

    All pairs of one dimension are held against the threshold, whatever their
    other columns say.  Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, and vectors of different dimensions
    don't link with each other.  Repeated rows count as further vectors equal to
    the first; different vectors under one id pool their links.  Rows without an
    id take no part and get ``n_links`` 0 and a null component.
    An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    sound = F.col("id").isNotNull() & F.coalesce(F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False))
    marked = rows.withColumn("sound", sound)
    # equal vectors once: the smallest id stands for them (0 + x makes -0.0 equal to 0.0)
    keyed = marked.filter("sound").select("id", F.transform("v", lambda x: x + F.lit(0).cast("float")).alias("v") if dict(rows.dtypes)["v"] == "array<float>" else F.transform("v", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    classes = written(keyed.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")), "vectors")
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    width = max(reach * CELL, 2 / SIDE)
    kind, found, used = dict(classes.dtypes)["v"], [], []
    for dim in [r[0] for r in classes.select(F.size("v")).distinct().collect()]:  # one, as a rule
        own = classes.filter(F.size("v") == dim)
        axes = principal_axes(own, dim)
        where = ", ".join(f"{p} double" for p in _places())
        celled = own.select("id", "n", "v").mapInArrow(_grid(axes, width), f"id long, n long, v {kind}, cell long, {where}")
        celled = written(celled, "cells")
        ends = [f(p).alias(f"{name}_{p}") for name, f in (("low", F.min), ("high", F.max)) for p in _places()]
        # a row a cell that has vectors: at most (2 / width + 1) ** GRID_AXES of them, whatever the table
        cells = celled.groupBy("cell").agg(F.count("*").alias("held"), *ends).collect()
        boxes = {r["cell"]: (r["held"], *(np.array([r[f"{name}_{p}"] for p in _places()]) for name in ("low", "high"))) for r in cells}
        axes_used, tiles, partners = best_grid(boxes, reach, tile or min(TILE, max(1, TILE_COMPONENTS // dim)))
        spark = vectors.sparkSession
        partners = F.broadcast(spark.createDataFrame(partners, "cell long, far long, far_tiles int"))
        mine = spark.createDataFrame(list(tiles.items()), "of long, parts int")
        split = celled.withColumn("cell", F.pmod("cell", F.lit(SIDE**axes_used))).join(F.broadcast(mine), F.col("cell") == F.col("of"))
        tiled = split.select("id", "n", "v", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("k"))
        blobs = tiled.groupBy("cell", "k").agg(F.collect_list(F.struct("id", "n", "v")).alias("members"))
        paired = blobs.join(partners, "cell").withColumn("far_k", F.explode(F.sequence(F.lit(0), F.col("far_tiles") - 1)))
        own_, other = F.struct("cell", "k"), F.struct(F.col("far").alias("cell"), F.col("far_k").alias("k"))
        name = F.concat_ws(":", F.lpad(F.col("cell").cast("string"), 8, "0"), F.lpad(F.col("k").cast("string"), 10, "0"))
        paired = paired.select(F.least(own_, other).alias("a"), F.greatest(own_, other).alias("b"), name.alias("own"), "members")
        found.append(paired.groupBy("a", "b").applyInArrow(_compare(axes, threshold), "id long, links long, up long"))
        used.append(celled)
    if not found:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    every = written(every, "near")
    discard(*used)
    roots = written(components(every.select(F.col("id").alias("a"), F.col("up").alias("b"))), "roots")
    counts = every.groupBy("id").agg(F.sum("links").alias("links"))
    judged = classes.join(counts, "id", "left").join(roots, classes.id == roots.node, "left")
    judged = judged.select(F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    judged = written(judged, "judged")
    linked = keyed.join(judged, F.col("v") == F.col("w")).select("id", "n_links", "component_id")
    alone = marked.filter(~F.col("sound")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = linked.union(alone)
    return both.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
