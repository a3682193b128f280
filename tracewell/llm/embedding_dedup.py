"""Near-duplicate embeddings: spherical k-means cells and blocked cosine products inside cells.

Equal vectors are one representative with a multiplicity.  Vectors of each length are a space of
their own, with cells of its own.  Each representative lives in the cell of its nearest centroid,
and visits another cell if it may have a partner there: two unit vectors of cosine t are
sqrt(2 - 2t) apart, so a vector visits a cell if the plane between that cell's centroid and its own
is no farther.  This makes the join exact; k-means only steers its cost.  The home vectors of a cell
are split into blocks of bounded size, its visitors into parts of bounded size.  A task holds a
block, streams a part past it, and reports each vector's number of links and a spanning forest of
the links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, materialize, sized

COSINE = 0.9
#: Representatives of a cell, on average; a length with no more of them is one cell.
CELL_ROWS = 8_192
#: Most cells of one length, as their centroids are broadcast; beyond it cells grow and have more blocks.
MOST_CELLS = 4_096
#: Home vectors of a block and visitors of a part, on average, and rows that are multiplied at a time.
BLOCK, PART, CHUNK = 8_192, 16_384, 256
#: Bounded sample on which k-means is fitted; every vector is assigned and compared.
FIT_ROWS = 16_384
FIT_ROUNDS = 8
SEED = 11


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, unit): the float64 unit vector as bytes; null where a vector can't have links."""

    def normalize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                v = np.array([np.nan if c is None else c for c in x.as_py()] if x.values is not None and x.values.null_count else (x.values.to_numpy() if x.is_valid else []), dtype=np.float64)
                n = np.sqrt(np.dot(v, v)) if len(v) and np.isfinite(v).all() else 0.0
                if len(v) and np.isfinite(v).all() and not (np.isfinite(n) and n > 1e-100):
                    top = np.abs(v).max()  # beyond double's range for squares
                    v = v / top if top > 0 else v
                    n = np.sqrt(np.dot(v, v))
                out.append((v / n).tobytes() if n > 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "unit"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(normalize, "vec_id long, unit binary")


def fit_cells(units: DataFrame, n: int) -> np.ndarray:
    """Unit centroids by spherical k-means on at most FIT_ROWS rows, chosen by hash."""
    k = int(min(max(n // CELL_ROWS, 1), MOST_CELLS))
    rows = units.orderBy(F.xxhash64("rep"), "rep").limit(FIT_ROWS).select("unit").toArrow().column(0)
    x = np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in rows])
    rng = np.random.Generator(np.random.PCG64(SEED))
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(FIT_ROUNDS):
        near = np.argmax(x @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centers)
    return centers


def forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the components of a link list, root the least node, for nodes that aren't roots."""
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    x, y = at[: len(i)], at[len(i) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def placed_vectors(reps: DataFrame) -> DataFrame:
    """reps (unit, rep, copies) with home, the cell of each vector, and visits, the other cells it has to see.

    Of two cells that a pair's vectors live in, the lower one is visited.  Cells of vectors of a rare
    length are named by that length, below zero.
    """
    centers, first = {}, 0
    lengths = reps.groupBy(F.octet_length("unit").alias("n")).count().where(F.col("count") > CELL_ROWS).orderBy("n").collect()
    for length in lengths:
        fitted = fit_cells(reps.where(F.octet_length("unit") == length["n"]), length["count"])
        centers[length["n"]] = (fitted, first)
        first += len(fitted)
    shared = reps.sparkSession.sparkContext.broadcast(centers)
    reach = np.sqrt(2 - 2 * COSINE) + 1e-9

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            units = batch.column(0)
            sizes = pc.binary_length(units).to_numpy()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                for lo in range(0, len(rows), CHUNK):
                    part = batch.take(pa.array(rows[lo : lo + CHUNK]))
                    n = part.num_rows
                    if size not in known:
                        home, cells, ends = np.full(n, -(size // 8)), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
                    else:
                        c, base = known[size]
                        s = matrix(part.column(0)) @ c.T
                        home = np.argmax(s, axis=1)
                        between = np.sqrt(np.maximum(2 - 2 * (c[home] @ c.T), 0))
                        go = s[np.arange(n), home][:, None] - s <= reach * between + 1e-12
                        go &= np.arange(len(c))[None, :] < home[:, None]
                        ends = np.r_[0, np.cumsum(go.sum(axis=1))]
                        home, cells = home + base, np.nonzero(go)[1] + base
                    visits = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(cells.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home.astype(np.int32)), visits], ["unit", "rep", "copies", "home", "visits"])

    return reps.select("unit", "rep", "copies").mapInArrow(place, "unit binary, rep long, copies long, home int, visits array<int>")


def matrix(units: pa.Array) -> np.ndarray:
    """Unit vectors of one length as rows."""
    return np.frombuffer(b"".join(units.to_pylist()), np.float64).reshape(len(units), -1)


def dealt_vectors(placed: DataFrame) -> DataFrame:
    """A row (cell, block, part, visitor, rep, copies, unit) for each block of a cell that a vector meets, sorted by place.

    A home vector goes to every part of its block.  A visitor, or a home vector of another block of
    higher number, goes to one part of each block.
    """
    homes = placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("rows"))
    guests = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("guests"))
    sizes = homes.join(guests, "cell", "left").select("cell", "rows", F.coalesce("guests", F.lit(0)).alias("guests"))
    sizes = sizes.select("cell", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"), "rows", "guests")
    passing = F.col("guests") + F.when(F.col("blocks") > 1, F.col("rows")).otherwise(0)
    sizes = materialize(sizes.select("cell", "blocks", F.greatest(F.ceil(passing / PART), F.lit(1)).cast("int").alias("parts")), "embedding-sizes")
    met = placed.select("rep", "copies", "unit", "home", F.explode(F.concat(F.array("home"), "visits")).alias("cell")).join(sized(sizes, 16), "cell")
    own = F.when(F.col("cell") == F.col("home"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int"))
    met = met.withColumn("own", own).withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("own", F.col("blocks") - 1))))
    visitor = F.coalesce(F.col("block") != F.col("own"), F.lit(True))
    one = F.pmod(F.xxhash64("rep", F.lit(2)), F.col("parts")).cast("int")
    parts = F.when(visitor, F.array(one)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    met = met.select("cell", "block", F.explode(parts).alias("part"), visitor.alias("visitor"), "rep", "copies", "unit")
    return met.repartition("cell", "block", "part").sortWithinPartitions("cell", "block", "part", "visitor")


def chunk_links(a: np.ndarray, b: np.ndarray, above: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of pairs at or over the cosine; above: a begins at this row of b, each pair counts once."""
    hit = a @ b.T >= COSINE
    if above is not None:
        hit &= np.arange(len(b))[None, :] > above + np.arange(len(a))[:, None]
    return np.nonzero(hit)


def block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (cell, block, part, visitor, rep, copies, unit) that come by place, homes before visitors.

    Gives (rep, links, null) for every vector with links and (node, 0, root) for a forest of them.
    Memory holds a block and one chunk of visitors.
    """
    key, parts, home = None, [], None

    def report(ra: np.ndarray, ca: np.ndarray, i: np.ndarray, rb: np.ndarray, cb: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(i):
            ids, at = np.unique(np.concatenate([ra[i], rb[j]]), return_inverse=True)
            times = np.bincount(at, np.concatenate([cb[j], ca[i]])).astype(np.int64)
            node, root = forest(ra[i], rb[j])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(times), pa.nulls(len(ids), pa.int64())], ["rep", "links", "root"])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.zeros(len(node), np.int64)), pa.array(root)], ["rep", "links", "root"])

    def whole() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate([p[k] for p in parts]) for k in range(3))

    def among(block: tuple) -> Iterator[pa.RecordBatch]:
        rep, copies, x = block
        for lo in range(0, len(x), CHUNK):
            i, j = chunk_links(x[lo : lo + CHUNK], x, lo)
            yield from report(rep[lo:], copies[lo:], i, rep, copies, j)

    for batch in batches:
        places = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1)
        cuts = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]).any(axis=1)]) if len(places) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(places)], strict=True):
            cell, block, part, visitor = places[lo].tolist()
            rows = batch.slice(lo, hi - lo)
            piece = (rows.column(4).to_numpy(), rows.column(5).to_numpy(), matrix(rows.column(6)))
            if (cell, block, part) != key:
                if parts and key[2] == 0:
                    yield from among(home or whole())
                key, parts, home = (cell, block, part), [], None
            if not visitor:
                parts.append(piece)
                continue
            if not parts:
                continue  # a cell's block that no vector lives in
            home = home or whole()
            rep, copies, x = piece
            for at in range(0, len(x), CHUNK):
                i, j = chunk_links(x[at : at + CHUNK], home[2])
                yield from report(rep[at:], copies[at:], i, home[0], home[1], j)
    if parts and key[2] == 0:
        yield from among(home or whole())


def linked_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors.

    Null or zero vectors and those with null or non-finite components have no links; vectors of
    different lengths have none with each other; rows without a vec_id have none.  Rows that repeat a
    vec_id and its vector are one vector; different vectors of one vec_id are vectors of their own.
    Other columns are ignored; no rows give no rows.
    """
    units = materialize(unit_vectors(vectors), "embedding-units")
    usable = units.where("unit is not null and vec_id is not null")
    reps = materialize(usable.groupBy("unit").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies")), "embedding-reps")
    # Within a space a rep has one vector; a vec_id that has several is told apart by a number.
    reps = materialize(reps.withColumn("name", F.monotonically_increasing_id()), "embedding-named")
    named = reps.select("unit", F.col("name").alias("rep"), "copies")
    placed = materialize(placed_vectors(named), "embedding-cells")
    found = materialize(dealt_vectors(placed).mapInArrow(block_links, "rep long, links long, root long"), "embedding-links")
    degree = found.where("root is null").groupBy(F.col("rep").alias("name")).agg(F.sum("links").alias("links"))
    # Links of vectors are links of their vec_ids.
    ids = reps.select("name", "rep")
    edges = found.where("root is not null").select(F.col("rep").alias("x"), F.col("root").alias("y"))
    edges = edges.join(ids.withColumnRenamed("name", "x").withColumnRenamed("rep", "a"), "x").join(ids.withColumnRenamed("name", "y").withColumnRenamed("rep", "b"), "y")
    parts = connected_components(edges.select("a", "b"))
    per_rep = reps.join(degree, "name", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("unit").alias("_unit"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    joined = units.join(per_rep, units["unit"] == per_rep["_unit"], "left")
    component = F.when(F.col("vec_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "vec_id"))
    links = F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0)))
    return joined.select(
        "vec_id", links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )
