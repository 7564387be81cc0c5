"""Hard-negative mining: for anchors and their nearest rows of the same label, the best rows of other labels in a window of scores.

Vectors are whole numbers and scores their exact inner products. All vectors are turned by one orthogonal matrix, the
principal axes of a sample, so that leading components carry most of a product. A task holds a block of anchors and a
block of rows: it adds up partial products of leading components slice by slice, bounds what is left by the lengths of
the remaining components plus a slack for rounding, lets go of pairs whose bounds can't reach what their anchor has
already, and computes the integer products of those that stay. The matrix only decides how early pairs go; the result
is exact whatever it is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, save

#: Rows of the sample that the axes come from, anchors and rows in a block at most, and blocks of rows at least.
SAMPLE, BLOCK, BLOCKS = 16_384, 65_536, 64
#: Anchors and rows whose products are in memory together, components of a slice, and pairs verified at once.
ANCHORS, ROWS, SLICE, PAIRS = 128, 4_096, 16, 65_536
_LOW = np.iinfo(np.int64).min
_FIELDS = "block_a int, block_b int, id bigint, label bigint, v array<bigint>"


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def prepared(vectors: DataFrame, vec_id: str, embedding: str, label: Column, scale: int) -> DataFrame:
    """id, label, v of the rows that take part; one row an id, the least of those that share it."""
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), label.cast("long").alias("label"), F.col(f"`{embedding}`").alias("e"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    # a score must fit a long: |components| below 2^28 over 64 components, fewer bits for longer vectors
    top = F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size("e"), F.lit(64)))
    rows = rows.where(F.forall("e", lambda x: F.abs(x.cast("double") * scale) < top - 1))
    least = rows.select("id", F.struct("label", whole(F.col("e"), scale).alias("v")).alias("r")).groupBy("id").agg(F.min("r").alias("r"))
    return least.select("id", "r.label", "r.v")


def axes(sample: np.ndarray) -> np.ndarray:
    """Orthogonal matrix whose columns are the principal axes of the rows, the strongest first."""
    _, turn = np.linalg.eigh(sample.T @ sample)
    return np.ascontiguousarray(turn[:, ::-1])


def _matrix(column, width: int) -> np.ndarray:
    """A list column as a whole-number matrix, shorter lists filled with zeros."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    size = flat.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


class _Turned:
    """Rows with their rotated components and, for each slice's end, the length of the components behind it."""

    def __init__(self, rows, turn: np.ndarray):
        self.id, self.label = rows["id"].to_numpy(), rows["label"].to_numpy()
        self.v = _matrix(rows["v"], len(turn))
        self.t = self.v @ turn
        square = np.cumsum((self.t**2)[:, ::-1], axis=1)[:, ::-1]
        self.ends = [*range(SLICE, len(turn), SLICE), len(turn)]
        self.left = np.sqrt(np.stack([square[:, e] if e < len(turn) else np.zeros(len(self.v)) for e in self.ends], axis=1))
        self.size = np.sqrt(square[:, 0]) if len(turn) else np.zeros(len(self.v))


def survivors(a: _Turned, x: slice, b: _Turned, y: slice, least: np.ndarray, most: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of a[x] and b[y]) among open_ whose score may lie in [least, most] of their anchor, by bounds of partial products."""
    slack = 16 * max(1, a.t.shape[1]) * np.finfo(np.float64).eps * a.size[x, None] * b.size[None, y] + 0.25
    part, begin = np.zeros(open_.shape), 0
    for k, end in enumerate(a.ends):
        part += a.t[x, begin:end] @ b.t[y, begin:end].T
        reach = a.left[x, k, None] * b.left[None, y, k] + slack
        open_ = open_ & (part + reach >= least[:, None]) & (part - reach <= most[:, None])
        begin = end
        if not open_.any():
            break
    return np.nonzero(open_)


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer products of the pairs (i, j), some thousand at a time."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), PAIRS):
        to = slice(at, at + PAIRS)
        out[to] = np.einsum("ij,ij->i", a[i[to]], b[j[to]])
    return out


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, many: int) -> np.ndarray:
    """Places of each group's `many` highest scores, ties by smaller id, ordered by group and rank."""
    order = np.lexsort((ids, -score, group))
    group = group[order]
    first = np.flatnonzero(np.diff(group, prepend=-1)) if len(group) else np.empty(0, np.int64)
    rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
    return order[rank < many]


def _positives(turn: np.ndarray, many: int):
    """A task over a block pair: each anchor's `many` best rows of its label there."""
    import pyarrow as pa

    def run(anchors, rows):
        if not anchors.num_rows or not rows.num_rows:
            return pa.table({"anchor_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        a, b = _Turned(anchors, turn), _Turned(rows, turn)
        found = [], [], []
        for lo in range(0, len(a.id), ANCHORS):
            x = slice(lo, lo + ANCHORS)
            n = len(a.id[x])
            held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)  # anchor, row, score
            least = np.full(n, -np.inf)
            for at in range(0, len(b.id), ROWS):
                y = slice(at, at + ROWS)
                open_ = (a.label[x, None] == b.label[None, y]) & (a.id[x, None] != b.id[None, y])
                i, j = survivors(a, x, b, y, least, np.full(n, np.inf), open_)
                i, j, s = (np.concatenate(z) for z in zip(held, (i, j + at, _products(a.v[x], b.v, i, j + at)), strict=True))
                keep = _best(i, s, b.id[j], many)
                held = i, j, s = i[keep], j[keep], s[keep]
                size = np.bincount(i, minlength=n)
                full = size == many
                least[full] = s[np.cumsum(size)[full] - 1]  # of equal scores a smaller id may come
            for kept, got in zip(found, (a.id[x][held[0]], b.id[held[1]], held[2]), strict=True):
                kept.append(got)
        return pa.table({k: np.concatenate(v) for k, v in zip(("anchor_id", "id", "score"), found, strict=True)})

    return run


def _negatives(turn: np.ndarray, many: int, low: int, high: int, whole_: int):
    """A task over a block pair: for each anchor and positive, the `many` best rows there of other labels in the window."""
    import pyarrow as pa

    names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")

    def run(anchors, rows):
        if not anchors.num_rows or not rows.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in names})
        a, b = _Turned(anchors, turn), _Turned(rows, turn)
        pid, pscore = anchors["positive_id"].to_pylist(), anchors["positive_score"].to_pylist()
        found = tuple([] for _ in names)
        for lo in range(0, len(a.id), ANCHORS):
            x = slice(lo, lo + ANCHORS)
            n = len(a.id[x])
            owner = np.repeat(np.arange(n), [len(p) for p in pid[x]])  # an entry for each anchor and positive
            score = np.array([s for p in pscore[x] for s in p], np.int64)
            ids = np.array([i for p in pid[x] for i in p], np.int64)
            floor, top = -((-low * score) // whole_), (high * score) // whole_  # whole numbers within the window
            held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)  # entry, row, score
            need = floor.copy()
            for at in range(0, len(b.id), ROWS):
                y = slice(at, at + ROWS)
                least, most = np.full(n, np.inf), np.full(n, -np.inf)
                some = need <= top
                np.minimum.at(least, owner[some], need[some])
                np.maximum.at(most, owner[some], top[some])
                i, j = survivors(a, x, b, y, least, most, a.label[x, None] != b.label[None, y])
                s = _products(a.v[x], b.v, i, j + at)
                e, p = _entries(owner, i)  # each surviving pair against each of its anchor's windows
                fits = (s[p] >= need[e]) & (s[p] <= top[e])
                e, p = e[fits], p[fits]
                e, j, s = (np.concatenate(z) for z in zip(held, (e, j[p] + at, s[p]), strict=True))
                keep = _best(e, s, b.id[j], many)
                held = e, j, s = e[keep], j[keep], s[keep]
                size = np.bincount(e, minlength=len(owner))
                full = size == many
                need[full] = s[np.cumsum(size)[full] - 1]
            e, j, s = held
            for kept, got in zip(found, (a.id[x][owner[e]], ids[e], score[e], b.id[j], s), strict=True):
                kept.append(got)
        return pa.table({k: np.concatenate(v) for k, v in zip(names, found, strict=True)})

    return run


def _entries(owner: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, place in i) for each entry that belongs to the anchor at that place; owner rises."""
    n = int(max(owner.max(initial=-1), i.max(initial=-1))) + 1
    size = np.bincount(owner, minlength=n)
    first = np.cumsum(size) - size
    place = np.repeat(np.arange(len(i)), size[i])
    within = np.arange(len(place)) - np.repeat(np.cumsum(size[i]) - size[i], size[i])
    return first[i[place]] + within, place


def _top(found: DataFrame, key: list[str], score: str, tie: str, many: int) -> DataFrame:
    """The first `many` of each key's rows of all tasks, with their rank."""
    from pyspark.sql import Window

    order = Window.partitionBy(*key).orderBy(F.col(score).desc(), F.col(tie))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= many)


def mine(
    vectors: DataFrame, anchors: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: Column | str = "label",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, whole_: int = 100, scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (and the anchor's label).

    Scores are inner products of floor(scale * x). An anchor is a row for which the condition `anchors` (over the
    column id) holds; its positives are its best other rows of the same label, its negatives for each positive the best
    rows of other labels with low * positive_score <= whole_ * negative_score <= high * positive_score; higher scores
    first, ties by smaller id. A positive without a row in its window gives none.

    Rows with a null id, label or vector, or a null or non-finite component, take no part, nor do such whose scores
    needn't fit a long (components of 2^28 and more at 64 components). Shorter vectors are read as ending in zeros, an
    empty one as zeros. Of rows that share an id the least (by label, then vector) takes part. Other columns are left
    out. An empty table gives no rows. A label of any size is dealt over all blocks: they are cut by a digest of ids.
    """
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = save(prepared(vectors, vec_id, embedding, label, scale))
    n, width, asked = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.sum(anchors.cast("int")), F.lit(0))).first()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    turn = axes(_matrix(sample["v"], width).astype(np.float64)) if n else np.zeros((0, 0))
    blocks, sides = max(BLOCKS, -(-n // BLOCK)), max(1, -(-asked // BLOCK))

    def dealt(df: DataFrame, own: str, mine: int, other: str, theirs: int) -> DataFrame:
        """A copy of each row for each block of the other side."""
        return df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(mine)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(theirs - 1))))

    sent = dealt(rows, "block_b", blocks, "block_a", sides)

    def compare(asking: DataFrame, run, schema: str) -> DataFrame:
        left = dealt(asking, "block_a", sides, "block_b", blocks)
        return left.groupBy("block_a", "block_b").cogroup(sent.groupBy("block_a", "block_b")).applyInArrow(run, schema)

    near = compare(rows.where(anchors), _positives(turn, positives), "anchor_id bigint, id bigint, score bigint")
    best = _top(near, ["anchor_id"], "score", "id", positives).groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    asking = save(rows.join(best.withColumnRenamed("anchor_id", "id"), "id").select("id", "label", "v", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score")))
    kinds = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    found = _top(compare(asking, _negatives(turn, negatives, low, high, whole_), kinds), ["anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", negatives)
    out = save(found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    forget(rows, asking)
    return out


#: SQL of the contract over a small table: all anchors against all rows.
SQL = """WITH f AS (SELECT vec_id AS id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
  p AS MATERIALIZED (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM f a JOIN f b ON a.id % 100 = 0 AND a.id <> b.id),
  g AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
  SELECT g.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, p.id AS negative_id, positive_score, p.score AS negative_score FROM g JOIN p ON g.anchor_id = p.anchor_id AND NOT p.same
    AND 30 * positive_score <= 100 * p.score AND 100 * p.score <= 90 * positive_score WINDOW w AS (PARTITION BY g.anchor_id, positive_id ORDER BY p.score DESC, p.id) QUALIFY row_number() OVER w <= 10"""
