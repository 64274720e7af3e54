"""Near-duplicate vectors: cells of a spherical k-means, blocked cosine products in each, one representative a group.

Cells lose no pair.  If two unit vectors are at most ``r`` apart, each is at most ``r`` from the border between their
cells, so a vector is also a guest in every cell of lower number whose border with its own cell is that near; a pair is
then met exactly once, in the lower of its two cells.  A cell with many vectors is split into blocks, and pairs of
blocks are compared, each in a group of its own; only sums of links and one local root a vector leave such a group.
Equal vectors count as one that has weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, prepared
from loomgraph.llm.components import connected_components

BLOCK = 256
#: Rows that are held against all centroids at once: 16 MB for as many as 16,384 of them.
ROWS = 128


def spherical_k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """``k`` unit centroids of the unit rows ``x``; a centroid without rows starts anew at the row that fits worst."""
    draw = np.random.default_rng(seed)
    centroids = x[draw.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own, best = np.empty(len(x), np.int64), np.empty(len(x))
        for at in range(0, len(x), ROWS):
            fit = x[at : at + ROWS] @ centroids.T
            own[at : at + ROWS] = fit.argmax(axis=1)
            best[at : at + ROWS] = fit.max(axis=1)
        order = np.argsort(own, kind="stable")
        cells, first = np.unique(own[order], return_index=True)
        sums = np.zeros_like(centroids)
        sums[cells] = np.add.reduceat(x[order], first, axis=0)
        worst = iter(np.argsort(best, kind="stable"))
        for empty in np.setdiff1d(np.arange(k), cells):
            sums[empty] = x[next(worst)]
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def usable(embedding: Column) -> Column:
    """Whether a vector can have links: not null, of finite components that aren't all 0."""
    finite = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(embedding, lambda c: c != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.linalg.norm(x / (scale := np.abs(x).max(axis=1, keepdims=True)), axis=1, keepdims=True) / scale


def compared(table: pa.Table, threshold: float) -> pa.Table:
    """Links of one pair of blocks: ``id, links`` (summed weights of the others) and ``root`` (smallest id in local reach)."""
    side = table.column("side").to_numpy()
    ids, weight, x = table.column("id").to_numpy(), table.column("n").to_numpy(), _matrix(table.column("v"))
    if (side == 2).any():  # a block with itself
        met = x @ x.T >= threshold
        np.fill_diagonal(met, False)
    else:
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        met = np.zeros((len(ids), len(ids)), bool)
        if len(a) and len(b):
            met[np.ix_(a, b)] = x[a] @ x[b].T >= threshold
            met |= met.T
    links, some = met @ weight, met.any(axis=1)
    root = ids.copy()
    met, root = met[np.ix_(some, some)], root[some]
    np.fill_diagonal(met, True)
    while len(root):
        lower = np.where(met, root[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (lower == root).all():
            break
        root = lower
    return pa.table({"id": pa.array(ids[some], pa.int64()), "links": pa.array(links[some], pa.int64()), "root": pa.array(root, pa.int64())})


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, cell_rows: int = 1000, sample_rows: int = 20_000, seed: int = 11) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors`` (``vec_id, embedding, label``).

    Only rows of one label and one length are compared.  Rows whose label, id or vector is null, and vectors that are
    zero or hold null or non-finite components, have no links and are their own component.  A repeated row counts as
    a vector of its own.  Centroids are fitted on ``sample_rows`` rows drawn by a hash; every row is assigned.  Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = prepared(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    rows = rows.withColumn("ok", usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.withColumn("key", F.when(F.col("ok"), F.concat_ws(":", F.size("v"), F.xxhash64(F.lit(1), "label", "v"), F.xxhash64(F.lit(2), "label", "v"))))
    classes = rows.where("ok").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v"), F.first("label").alias("label"))
    classes = cut(classes.withColumn("dim", F.size("v")))

    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n"), F.max("dim")).first()
    if largest[0] is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    total = classes.count()
    dims = [r.dim for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(16).collect()]
    cells = int(max(1, min(-(-largest[0] // cell_rows), (32 << 20) // (8 * largest[1]), 16384)))
    drawn = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < min(1.0, sample_rows / total) * (1 << 30)
    centroids = {}
    for dim in dims:  # vectors of a rarer length are all in one cell
        sample = classes.where((F.col("dim") == dim) & drawn).select("id", "v").limit(2 * sample_rows).toArrow().sort_by("id")
        if len(sample):
            x = _matrix(sample.column("v"))
            centroids[dim] = spherical_k_means(x, min(cells, len(x)), 8, seed)
    shared = spark.sparkContext.broadcast(centroids)
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-9

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim)) if (dims != dim).any() else batch
                c = shared.value.get(int(dim), np.zeros((1, int(dim))))
                x, rows_, cells_, guests = _matrix(pa.chunked_array([part.column(1)])), [], [], []
                for at in range(0, len(x), ROWS):
                    fit = x[at : at + ROWS] @ c.T
                    own = fit.argmax(axis=1)
                    # borders between the cells of these rows and all others, not between all cells
                    homes, home = np.unique(own, return_inverse=True)
                    apart = np.sqrt(np.maximum(0, 2 - 2 * c[homes] @ c.T)) + 1e-9
                    near = fit[np.arange(len(own)), own][:, None] - fit <= reach * apart[home]
                    near &= np.arange(len(c))[None, :] <= own[:, None]
                    row, cell = np.nonzero(near)
                    rows_.append(row + at)
                    cells_.append(cell)
                    guests.append(cell != own[row])
                row, cell, guest = map(np.concatenate, (rows_, cells_, guests))
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell, pa.int32()), pa.array(guest)], names=["id", "v", "dim", "n", "label", "cell", "guest"])

    places = cut(classes.select("id", "v", "dim", "n", "label").mapInArrow(assign, "id long, v array<double>, dim int, n long, label string, cell int, guest boolean"))
    where = ["label", "dim", "cell"]
    # written before it is joined, so that its size is known and a very common cell's rows can be split
    blocks = cut(places.groupBy(*where).agg((F.floor(F.count_if(~F.col("guest")) / BLOCK) + 1).cast("int").alias("h"), F.ceil(F.count_if("guest") / BLOCK).cast("int").alias("g")))
    block = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.when(F.col("guest"), F.greatest("g", F.lit(1))).otherwise(F.col("h"))).cast("int")
    placed = places.join(blocks, where).withColumn("block", block)
    # home block i meets home blocks j >= i, and guest blocks h + g
    home = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"), F.when(j == F.col("block"), F.lit(2)).when(j > F.col("block"), F.lit(0)).otherwise(F.lit(1)).alias("side"))),
        F.transform(F.filter(F.sequence(F.lit(0), F.col("g")), lambda j: j < F.col("g")), lambda j: F.struct(F.col("block").alias("i"), (F.col("h") + j).alias("j"), F.lit(0).alias("side"))),
    )
    guest = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda i: F.struct(i.alias("i"), (F.col("h") + F.col("block")).alias("j"), F.lit(1).alias("side")))
    dealt = placed.select(*where, "id", "n", "v", F.explode(F.when(F.col("guest"), guest).otherwise(home)).alias("to")).select(*where, "id", "n", "v", "to.i", "to.j", "to.side")
    met = cut(dealt.groupBy(*where, "i", "j").applyInArrow(lambda t: compared(t, threshold), "id long, links long, root long"))
    components = connected_components(met.select(F.col("id").alias("a"), F.col("root").alias("b")))
    linked = met.groupBy("id").agg(F.sum("links").alias("links")).join(components, "id", "left")
    found = classes.select("key", "id", "n").join(linked, "id", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    n_links, component = F.coalesce("links", F.lit(0)).cast("long"), F.coalesce("component", "vec_id")
    return rows.select("vec_id", "key").join(found, "key", "left").select("vec_id", n_links.alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
