"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative per group.

Equal vectors are put in one class first. Several k-means models are fitted on a bounded sample; every class goes to
its nearest cells of each model. Cells are dealt into blocks of bounded size and each pair of blocks of a cell is one
task's product in double precision, so a cell of any size is compared whole. A pair of classes counts in the first
cell that both share. What leaves a product are counts of links and the edges of a spanning forest, never all pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, local_roots, save

SIMILARITY = 0.95
#: Fitting sample (rows), models, cells that a vector joins in each, rows a cell should have, cells of one k-means, and rows of a block.
SAMPLE, MODELS, JOINED, CELL_ROWS, BRANCH, BLOCK = 16_384, 4, 2, 192, 2_048, 1_024
#: Rows from which on a cell is split, sample and cells of such a split, and rows that one task assigns.
LARGE, SPLIT_SAMPLE, SPLIT, DEAL = 8_192, 4_096, 64, 4_096
#: Cosine from which on two centroids are one cell.
CLOSE = 0.9
_NONE = np.iinfo(np.int64).max


def spherical_kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 6) -> np.ndarray:
    """k unit centroids of unit rows x. Empty cells take the rows that fit their own cells worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        sim = np.concatenate([(part @ c.T) for part in np.array_split(x, max(1, len(x) // 2048))])
        own = sim.argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        empty = np.flatnonzero(size < 1e-9)
        c = total / np.maximum(size, 1e-9)[:, None]
        if len(empty):
            c[empty] = x[np.argsort(sim.max(axis=1), kind="stable")[: len(empty)]]
    return c


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows over their lengths in double precision, scaled first so that no square overflows."""
    v = v.astype(np.float64)
    top = np.abs(v).max(axis=1, keepdims=True)
    v = v / np.where(top > 0, top, 1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _stack(column) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1)


def cells_of(x: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, the cell of each): close centroids share the number of the first."""
    c = spherical_kmeans(x, k, seed)
    i, j = np.nonzero(c @ c.T >= CLOSE)
    return c, local_roots(len(c), i, j)


def nearest(u: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The cells of the JOINED nearest centroids of each unit row."""
    near = min(JOINED, len(model[0]))
    return model[1][np.argpartition(-(u @ model[0].T), near - 1, axis=1)[:, :near]]


def _fit(kinds: DataFrame, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The models, from SAMPLE classes chosen by a hash of their vectors."""
    got = kinds.orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).select("vec").toArrow()
    x = _unit(_stack(got["vec"]))
    k = int(min(BRANCH, max(1, n // CELL_ROWS), len(x)))
    return [cells_of(x, k, seed) for seed in range(MODELS)]


def _vec(kinds: DataFrame) -> str:
    return f"array<{kinds.schema['vec'].dataType.elementType.simpleString()}>"


def _assign(kinds: DataFrame, models: list) -> DataFrame:
    """cells: numbers of the cells that a class joins, rising, model by model; as many for each, the rest being _NONE."""
    import pyarrow as pa

    held = kinds.sparkSession.sparkContext.broadcast(models)  # MODELS * BRANCH centroids at most

    def run(batches):
        for batch in batches:
            u = _unit(_stack(batch.column("vec")))
            cols = [nearest(u, m) + k * BRANCH for k, m in enumerate(held.value)]
            cells = np.sort(np.concatenate(cols, axis=1).astype(np.int64), axis=1)
            cells[:, 1:][cells[:, 1:] == cells[:, :-1]] = _NONE  # both nearest centroids may be of one cell
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(np.sort(cells, axis=1)), pa.list_(pa.int64()))], names=["cls", "many", "vec", "cells"])

    return kinds.select("cls", "many", "vec").mapInArrow(run, f"cls bigint, many bigint, vec {_vec(kinds)}, cells array<bigint>")


def _split_fit(key, rows):
    """Centroids of one cell from its sample (an Arrow table)."""
    import pyarrow as pa

    x = _unit(_stack(rows["vec"]))
    c, cell = cells_of(x, min(SPLIT, len(x)), 0)
    return pa.table({"cell": [key[0].as_py()], "c": [c.tobytes()], "own": [cell.astype(np.int64).tobytes()]})


def _split_assign(key, rows, model):
    """New cells of some rows of one cell: (cell + 1) * 65536 + a number of its own."""
    import pyarrow as pa

    cls = rows["cls"].to_numpy()
    if not model.num_rows:  # a cell of which the sample is empty stays whole
        return pa.table({"cls": cls, "cell": rows["cell"]})
    own = np.frombuffer(model["own"][0].as_py(), np.int64)
    c = np.frombuffer(model["c"][0].as_py(), np.float64).reshape(len(own), -1)
    new = np.sort(nearest(_unit(_stack(rows["vec"])), (c, own)), axis=1)
    once = np.ones(new.shape, bool)
    once[:, 1:] = new[:, 1:] != new[:, :-1]
    return pa.table({"cls": np.repeat(cls, once.sum(1)), "cell": (key[0].as_py() + 1) * 65_536 + new[once]})


def _refined(placed: DataFrame) -> DataFrame:
    """placed with the cells of more than LARGE rows split. One whose vectors are all close to each other stays whole: its pairs are links."""
    for _ in range(3):  # each turn divides a cell's rows by up to SPLIT; ids stay below 2**63
        long = placed.select("cls", "vec", F.explode("cells").alias("cell")).where(F.col("cell") < _NONE)
        sizes = long.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > LARGE)
        big = save(sizes)
        if big.isEmpty():
            forget(big)
            break
        rows = long.join(big, "cell")
        sample = rows.where(F.pmod(F.xxhash64("vec", "cell"), F.lit(1 << 30)) < F.lit(SPLIT_SAMPLE << 30) / F.col("n"))
        models = save(sample.groupBy("cell").applyInArrow(_split_fit, "cell bigint, c binary, own binary"))
        deal = F.ceil(F.col("n") / DEAL).cast("int")
        dealt = rows.withColumn("deal", F.pmod(F.xxhash64("cls"), deal).cast("int")).select("cls", "vec", "cell", "deal")
        sent = big.join(models, "cell").select("cell", F.explode(F.sequence(F.lit(0), deal - 1)).alias("deal"), "c", "own")
        new = dealt.groupBy("cell", "deal").cogroup(sent.groupBy("cell", "deal")).applyInArrow(_split_assign, "cls bigint, cell bigint")
        kept = long.join(big.select("cell"), "cell", "left_anti").select("cls", "cell")
        cells = new.unionByName(kept).groupBy("cls").agg(F.array_sort(F.collect_set("cell")).alias("cells"))
        out = save(placed.drop("cells").join(cells, "cls").select("cls", "many", "vec", "cells"))
        forget(big, models, placed)
        placed = out
    return placed


def _padded(column) -> np.ndarray:
    """A list column as a matrix, shorter lists filled with _NONE."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    size = flat.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(size), size.max()), _NONE)
    out[np.arange(out.shape[1]) < size[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


def _product(similarity: float):
    """A task over one pair of blocks: rows ('n', class, links to others) and spanning edges ('e', class, class)."""
    import pyarrow as pa

    def run(key, rows):
        cell, x, y = (k.as_py() for k in key)
        cls, many, block = rows["cls"].to_numpy(), rows["many"].to_numpy(), rows["block"].to_numpy()
        u, cells = _unit(_stack(rows["vec"])), _padded(rows["cells"])
        order = np.argsort(cls, kind="stable")
        cls, many, block, u, cells = cls[order], many[order], block[order], u[order], cells[order]
        a, b = np.flatnonzero(block == x), np.flatnonzero(block == y)
        links = np.zeros(len(cls), np.int64)
        ei, ej = [], []
        for part in np.array_split(a, max(1, len(a) // 512)):
            hit = u[part] @ u[b].T >= similarity
            i, j = np.nonzero(hit)
            i, j = part[i], b[j]
            keep = i < j if x == y else i != j
            i, j = i[keep], j[keep]
            # the pair counts in the first cell that both have: cells of a row rise
            first = np.full(len(i), _NONE)
            for p in range(cells.shape[1] - 1, -1, -1):
                ci = cells[i, p]
                both = (cells[j] == ci[:, None]).any(axis=1)
                first = np.where(both, ci, first)
            keep = first == cell
            i, j = i[keep], j[keep]
            np.add.at(links, i, many[j])
            np.add.at(links, j, many[i])
            ei.append(i)
            ej.append(j)
        i, j = np.concatenate(ei), np.concatenate(ej)
        root = local_roots(len(cls), i, j)
        child = np.flatnonzero(root != np.arange(len(cls)))
        linked = np.flatnonzero(links)
        return pa.table({"a": np.concatenate([cls[linked], cls[child]]), "b": np.concatenate([cls[linked], cls[root[child]]]), "links": np.concatenate([links[linked], np.zeros(len(child), np.int64)])})

    return run


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", similarity: float = SIMILARITY) -> DataFrame:
    """A row per row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id of the group), kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are kept, as are
    vectors of different lengths towards each other. Repeated rows count as links of each other; a null vec_id
    makes component_id the smallest other id of its group, null where there is none. An empty table gives no rows. Other
    columns are left out, so none can clash.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    kinds = rows.where("fine").groupBy("vec").agg(F.count("*").alias("many"), F.min("vec_id").alias("least"))
    kinds = save(kinds.withColumn("cls", F.monotonically_increasing_id()).withColumn("size", F.size("vec")))
    found = []
    for (size,) in kinds.select("size").distinct().collect():  # one length as a rule; each is compared for itself
        part = kinds.where(F.col("size") == size)
        found.append(_compare(part, part.count(), similarity))
    if found:
        got = found[0]
        for more in found[1:]:
            got = got.unionByName(more)
        got = save(got)
        label = components(got.where("a <> b").select("a", "b"))
        links = got.where("links > 0").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
        group = kinds.drop("size").join(label.withColumnRenamed("node", "cls"), "cls", "left").join(links, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        head = group.groupBy("component").agg(F.min("least").alias("head"))
        member = save(group.join(head, "component").select("vec", "head", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links")))
        forget(got, label)
    else:
        member = kinds.select("vec", F.col("least").alias("head"), F.lit(0).cast("long").alias("n_links"))
    good = rows.where("fine").join(member, "vec").select("vec_id", "n_links", F.col("head").alias("component_id"))
    rest = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _compare(kinds: DataFrame, n: int, similarity: float) -> DataFrame:
    placed = _refined(save(_assign(kinds, _fit(kinds, n))))
    long = placed.select("*", F.explode("cells").alias("cell")).where(F.col("cell") < _NONE)
    blocks = long.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    long = long.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("cls", "cell"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))
    dealt = long.select("cls", "many", "vec", "cells", "cell", "block", F.explode(pair).alias("pair")).select("*", "pair.x", "pair.y").drop("pair")
    return dealt.groupBy("cell", "x", "y").applyInArrow(_product(similarity), "a bigint, b bigint, links bigint")
