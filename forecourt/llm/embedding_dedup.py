"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within them."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from forecourt.llm.components import components
from forecourt.llm.text import slices
from forecourt.workspace import stored

COSINE = 0.95
#: The cells are fitted to a bounded sample: about this many vectors, or 16 for each centroid.
SAMPLE = 20_000
MAX_CELLS = 4096
#: Vectors of a cell that one task compares with as many others twice over.
HOME_ROWS, QUERY_ROWS = 1024, 2048
#: What rounding may add to a difference of likenesses.
ROUNDING = 1e-6


def valid(vector: Column) -> Column:
    """True for vectors with finite components that are not all zero; never NULL."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def cell_count(vectors: int) -> int:
    """Cells grow with the square root of the vectors, so assigning and comparing stay in balance."""
    return max(1, min(MAX_CELLS, round(math.sqrt(vectors) / 2)))


def margins(centroids: np.ndarray, cosine: float) -> np.ndarray:
    """How much less than its own cell (row) a vector may prefer another (column) and still visit it.

    Two linked vectors differ by a chord of ``sqrt(2 - 2 * cosine)`` at most.  What each
    prefers its own cell over the other's by adds up to the chord times the distance of the
    two centroids at most, so for one of them it is no more than half of that: in every
    dimension, one of the two visits the cell of the other.
    """
    apart = centroids @ centroids.T
    np.clip(2 - 2 * apart, 0, None, out=apart)
    np.sqrt(apart, out=apart)
    apart *= 0.5 * math.sqrt(max(0.0, 2 - 2 * cosine))
    apart += ROUNDING
    return apart


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow or underflow on the way."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def spherical_kmeans(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids; an empty cell takes the vector that fits its own cell worst."""
    points = unit(sample)
    centroids = points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(int)]
    for _ in range(rounds):
        likeness = points @ centroids.T
        nearest, best = likeness.argmax(1), likeness.max(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        empty = np.flatnonzero(np.linalg.norm(sums, axis=1) < 1e-12)
        sums[empty] = points[np.argsort(best)[: len(empty)]]
        centroids = unit(sums)
    return centroids


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def assigned(nodes: DataFrame, centroids: np.ndarray, cosine: float) -> DataFrame:
    """``nodes`` (``node``, ``copies``, ``vector``) with ``cells``: the nearest, then those visited.

    Vectors of other dimensions than the centroids' share one cell per dimension.
    """
    dims = centroids.shape[1]
    sent = nodes.sparkSession.sparkContext.broadcast(centroids)
    schema = nodes.select("*", F.array().cast("array<int>").alias("cells")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = None
        for batch in slices(batches, 1024):
            vectors = batch.column(batch.schema.get_field_index("vector"))
            sizes = np.asarray(vectors.value_lengths())
            cells: list[list[int]] = [[-int(n)] for n in sizes]
            fits = np.flatnonzero(sizes == dims)
            if len(fits):
                if near is None:
                    near = margins(sent.value, cosine)
                likeness = unit(_matrix(vectors.take(pa.array(fits)))) @ sent.value.T
                best = likeness.max(axis=1, keepdims=True)
                home = likeness.argmax(axis=1)
                for row, h, mine in zip(fits.tolist(), home.tolist(), best - likeness <= near[home]):
                    cells[row] = [h, *(c for c in np.flatnonzero(mine).tolist() if c != h)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return nodes.mapInArrow(run, schema)


def _compared(cosine: float):
    """What links the members of one block of homes have with one block of queries.

    One row per vector with a link: its links (rows), and a member of its component here.
    """

    def run(table: pa.Table) -> pa.Table:
        role = table.column("home").to_numpy()
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        cells = table.column("cells").to_pylist()
        points = unit(_matrix(table.column("vector").combine_chunks()))
        homes, queries = np.flatnonzero(role), np.flatnonzero(~role)
        if not len(homes) or not len(queries):
            return _NOTHING
        h, q = np.nonzero(points[homes] @ points[queries].T >= cosine)
        h, q = homes[h], queries[q]
        other = node[h] != node[q]
        h, q = h[other], q[other]
        if not len(h):
            return _NOTHING
        # The pair is seen again, with the roles changed, in the query's own cell if the home
        # member goes there (and so if that is this cell); then each counts its own side.
        first = np.array([c[0] for c in cells])
        alone = np.fromiter((first[b] not in cells[a] for a, b in zip(h.tolist(), q.tolist())), bool, len(h))
        places = np.concatenate([h, q[alone]])
        links = np.bincount(places, weights=np.concatenate([copies[q], copies[h[alone]]]), minlength=len(node)).astype(np.int64)
        label = node.copy()
        while True:
            low = np.minimum(label[h], label[q])
            before = label.copy()
            np.minimum.at(label, h, low)
            np.minimum.at(label, q, low)
            if (label == before).all():
                break
        seen = np.unique(np.concatenate([h, q]))
        return pa.table({"node": pa.array(node[seen]), "links": pa.array(links[seen]), "label": pa.array(label[seen])})

    return run


_NOTHING = pa.table({n: pa.array([], pa.int64()) for n in ("node", "links", "label")})


def links(nodes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``node``, ``links``, ``label`` for vectors with links, in parts to be summed up.

    ``nodes`` is a stored table of distinct valid vectors.  Every vector is compared with
    all of its own cell and of the cells it visits.  A cell is cut into blocks, so a task
    holds ``HOME_ROWS`` + ``QUERY_ROWS`` vectors however large the cell; pairs are counted
    and joined up there and never written out.
    """
    total = nodes.count()
    cells = cell_count(total)
    size = max(SAMPLE, 16 * cells)
    # The dimension that most vectors have; the sample is drawn by hash.
    common = nodes.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if common is None:
        return nodes.sparkSession.createDataFrame([], "node bigint, links bigint, label bigint")
    fitting = nodes.filter(F.size("vector") == common["dims"])
    if common["count"] > size:
        # About ``size`` of them, by hash: each task picks its own, and none sorts for all.
        draw = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 40))
        fitting = fitting.filter(draw < int((1 << 40) * size / common["count"]))
    drawn = fitting.select("node", "vector").toArrow().sort_by("node")
    points = _matrix(drawn.column("vector").combine_chunks())
    table = stored(assigned(nodes, spherical_kmeans(points, cells), cosine), "cells")
    member = table.select("node", "copies", "vector", "cells", F.posexplode("cells").alias("visit", "cell"))
    counts = (
        table.select(F.posexplode("cells").alias("visit", "cell"))
        .groupBy("cell")
        .agg(F.count("*").alias("queries"), F.count(F.when(F.col("visit") == 0, 1)).alias("homes"))
        .filter("homes > 0 AND queries > 1")
        .select(
            "cell",
            F.ceil(F.col("homes") / HOME_ROWS).cast("int").alias("home_blocks"),
            F.ceil(F.col("queries") / QUERY_ROWS).cast("int").alias("query_blocks"),
        )
    )
    # One row per cell: MAX_CELLS at most, and one per odd dimension.
    blocked = member.join(counts, "cell")
    block = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    columns = ["cell", "node", "copies", "vector", "cells"]
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    homes = blocked.filter("visit = 0").select(*columns, block(2, "home_blocks").alias("hb"), upto("query_blocks").alias("qb"), F.lit(True).alias("home"))
    queries = blocked.select(*columns, upto("home_blocks").alias("hb"), block(3, "query_blocks").alias("qb"), F.lit(False).alias("home"))
    both = homes.unionByName(queries)
    return both.groupBy("cell", "hb", "qb").applyInArrow(_compared(cosine), "node bigint, links bigint, label bigint")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row of ``vectors``.

    Links are pairs of rows at ``cosine`` or more, in double precision.  Equal vectors are
    compared as one and counted as often as they occur.  ``component_id`` is the smallest
    number reachable by links, itself included, and the row that has it is kept.  Vectors
    that are NULL, empty, zero or hold NULL or non-finite components link with nothing, and
    neither do vectors of different dimensions.  Rows with a NULL number link as others do;
    they are kept only where their component has no number.  Repeated rows each get a row;
    other columns are not read; an empty table gives no rows.
    """
    # Floats travel as they are, in half the bytes; tasks compute with doubles.
    kind = vectors.select(vector).schema[0].dataType
    number = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    read = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast(f"array<{number}>").alias("vector"))
    ok = valid(F.col("vector"))
    # Minus zero is zero, so that equal vectors have equal hashes.
    plain = F.transform("vector", lambda x: F.when(x == 0, F.lit(0).cast(number)).otherwise(x))
    rows = stored(read.select("vec_id", F.when(ok, plain).alias("vector")).withColumn("node", F.xxhash64("vector")), "vectors")
    nodes = rows.filter("vector IS NOT NULL").groupBy("node").agg(
        F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("first")
    )
    nodes = stored(nodes, "nodes")
    parts = stored(links(nodes.select("node", "copies", "vector"), cosine), "links")
    counts = parts.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(parts.select(F.col("node").alias("a"), F.col("label").alias("b")))
    placed = nodes.select("node", "copies", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    found = stored(
        placed.join(counts, "node", "left")
        .join(smallest, "root")
        .select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"),
        "linked",
    )
    valid_rows = rows.filter("vector IS NOT NULL").select("vec_id", "node").join(found, "node")
    kept = F.col("vec_id").eqNullSafe(F.col("component_id"))
    alone = rows.filter("vector IS NULL").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    return valid_rows.select("vec_id", "n_links", "component_id", kept.alias("kept")).unionByName(alone)
