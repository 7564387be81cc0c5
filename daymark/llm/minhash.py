"""MinHash near-dedup: BagMinHash signatures of five-word shingle multisets, banded, verified by exact overlap.

A shingle that occurs w times stands for the interval (0, w]. The line of weights is split into dyadic blocks (0, 1],
(1, 2], (2, 4], (4, 8] ...; in each block every shingle has its own Poisson process, drawn from hashes, whose points
carry a time, a signature place and a weight inside the block. A place keeps the earliest point whose weight is at
most w. Points are drawn in rising time only as far as the latest place of the signature needs, so a text costs its
shingles plus about m log m points. Two signatures agree in a place with the probability of the weighted Jaccard
similarity of the multisets.

Texts that are equal, and those with equal multisets, are first put in one class. Bands pair classes; each pair is
verified by the exact overlap of the multisets. A class is first compared with a few centres of its buckets. Buckets
whose classes are in several components after that are compared whole, in pairs of blocks, one task each; what leaves
a task is a spanning forest. No bucket is capped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, components, forget, local_roots, map_texts, mix, save, word_hashes

SHINGLE = 5
BANDS, ROWS = 48, 7
PLACES = BANDS * ROWS
SIMILARITY = 0.8
#: One-bit checks compared before an exact verification; 256 bits, of which similar texts differ in 26 on average.
CHECKS, MOST_DIFFERENT = 4, 56
#: Centres that a class is compared with first, and the size of blocks in which what is left of a bucket is compared.
STARS, BLOCK_ROWS, BLOCK_ELEMENTS = 3, 2_048, 1_000_000
U = np.uint64


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order of text, their counts, and the number of shingles per text.

    A text of fewer than five words, but one at least, is a single shingle.
    """
    h, text = word_hashes(texts)
    words = np.bincount(text, minlength=len(texts))
    n = np.where(words > 0, np.maximum(words - SHINGLE + 1, 1), 0)
    first = np.cumsum(words) - words
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner]
    last = (first + words)[owner]
    s = np.full(len(owner), MIX[2])
    with np.errstate(over="ignore"):
        for j in range(SHINGLE):
            ok = at + j < last
            s = np.where(ok, mix(s * U(3) + h[np.minimum(at + j, max(len(h) - 1, 0))]) if len(h) else s, s)
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    counts = np.diff(np.append(start, len(s)))
    return s[start], counts, np.bincount(owner[start], minlength=len(texts))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((mix(x) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(hashes: np.ndarray, counts: np.ndarray, sizes: np.ndarray, places: int = PLACES) -> np.ndarray:
    """A signature (texts, places) of 64-bit values per text; texts without shingles get zeros."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    total = np.bincount(owner, weights=counts, minlength=n)
    best = np.full((n, places), np.inf)
    value = np.zeros((n, places), U)
    # a process per shingle and block: block 0 is (0, 1], block j is (2^(j-1), 2^j]
    seeds, who, low, width = [hashes], [owner], [np.zeros(len(hashes))], [np.ones(len(hashes))]
    j = 1
    while (more := np.flatnonzero(counts > 2 ** (j - 1))).size:
        with np.errstate(over="ignore"):
            seeds.append(mix(hashes[more] + U(j) * MIX[1]))
        who.append(owner[more])
        low.append(np.full(len(more), 2.0 ** (j - 1)))
        width.append(np.full(len(more), 2.0 ** (j - 1)))
        j += 1
    most = np.concatenate([counts] + [counts[counts > 2 ** (k - 1)] for k in range(1, j)]).astype(np.float64)
    flow = [*map(np.concatenate, (seeds, who, low, width)), most]
    with np.errstate(over="ignore", divide="ignore"):
        flow += [-np.log(_uniform(flow[0] ^ MIX[0])) / flow[3], np.zeros(len(flow[0]), U)]
        # a text's last place is filled at about (log m + c) * m / total
        limit, asleep = (np.log(places) + 3.0) * places / np.maximum(total, 1), []
        while True:
            live = flow[5] <= limit[flow[1]]
            if not live.all():
                asleep.append([x[~live] for x in flow])
                flow = [x[live] for x in flow]
            if not len(flow[0]):
                # beyond the limit a place may still get an earlier point from a process that sleeps
                lacking = (best > limit[:, None]).any(axis=1) & (total > 0)
                if not lacking.any():
                    return value
                limit = np.where(lacking, limit * 2, -1.0)
                flow, asleep = [np.concatenate(x) for x in zip(*asleep, strict=True)], []
                rest = ~lacking[flow[1]]
                best[~lacking] = -1.0  # settled
                flow = [x[~rest] for x in flow]
                continue
            seed, who, low, width, most, time, step = flow
            steps = step[:, None] + np.arange(1, max(2, min(65, 1 + 30_000 // len(seed))), dtype=U)
            points = mix(seed[:, None] + steps * MIX[2])
            waits = -np.log(_uniform(points ^ MIX[0])) / width[:, None]
            times = np.cumsum(np.concatenate([time[:, None], waits], axis=1), axis=1)
            # a point at place p holds for weights from its own on
            flat = (who * places)[:, None] + (mix(points ^ MIX[1]) % U(places)).astype(np.int64)
            ok = (low[:, None] + np.floor(_uniform(points) * width[:, None]) + 1 <= most[:, None]) & (times[:, :-1] < best.reshape(-1)[flat])
            at, t, v = flat[ok], times[:, :-1][ok], points[ok]
            np.minimum.at(best.reshape(-1), at, t)
            won = t == best.reshape(-1)[at]
            value.reshape(-1)[at[won]] = v[won]
            flow = [seed, who, low, width, most, times[:, -1], steps[:, -1]]


def elements(hashes: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Each text's multiset as a set: a 64-bit number for every shingle and occurrence."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        e = mix(np.repeat(hashes, counts) ^ mix(nth.astype(U) * MIX[2] + U(1))).view(np.int64)
    cuts = np.cumsum(np.bincount(np.repeat(owner, counts), minlength=len(sizes)))
    return np.split(e, cuts[:-1])


def _describe(texts: list[str]) -> list[list]:
    """Per text: number of shingles, a digest of the multiset, band keys and check bits. Equal texts are described once."""
    places = {t: k for k, t in enumerate(dict.fromkeys(texts))}
    if len(places) < len(texts):
        at = [places[t] for t in texts]
        return [[column[k] for k in at] for column in _describe(list(places))]
    h, c, n = shingles(texts)
    sig = signatures(h, c, n)
    owner = np.repeat(np.arange(len(texts)), n)
    weight = np.bincount(owner, weights=c, minlength=len(texts)).astype(np.int64)
    with np.errstate(over="ignore"):
        each = mix(h + c.astype(U) * MIX[0])
        digest, other = np.zeros(len(texts), U), np.zeros(len(texts), U)
        np.add.at(digest, owner, each)
        np.add.at(other, owner, mix(each ^ MIX[2]))
        keys = np.full((len(texts), BANDS), MIX[1])
        for r in range(ROWS):
            keys = mix(keys * U(5) + sig[:, r::ROWS][:, :BANDS])
        keys = mix(keys + np.arange(BANDS, dtype=U) * MIX[2])
    bits = (mix(sig[:, : 64 * CHECKS]) & U(1)).astype(np.uint8).reshape(len(texts), CHECKS, 64)
    checks = np.packbits(bits, axis=2, bitorder="little").view("<u8").reshape(len(texts), CHECKS).view(np.int64)
    keys = keys.view(np.int64)
    some = weight > 0
    return [weight.tolist(), digest.view(np.int64).tolist(), other.view(np.int64).tolist(), [k if x else [] for k, x in zip(keys.tolist(), some, strict=True)], checks.tolist()]


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose multisets overlap by SIMILARITY at least."""
    left = pairs.join(sets.select(F.col("cls").alias("a"), F.col("elements").alias("ea")), "a")
    both = left.join(sets.select(F.col("cls").alias("b"), F.col("elements").alias("eb")), "b")
    common = F.size(F.array_intersect("ea", "eb"))
    return both.where(common >= SIMILARITY * (F.size("ea") + F.size("eb") - common) - 1e-9).select("a", "b")


def _alike(x: str, y: str):
    """Whether two rows can be similar at all: by number of shingles (exact) and by their check bits."""
    differ = sum((F.bit_count(F.col(f"{x}c{i}").bitwiseXOR(F.col(f"{y}c{i}"))) for i in range(CHECKS)), F.lit(0))
    return (F.least(f"{x}w", f"{y}w") >= SIMILARITY * F.greatest(f"{x}w", f"{y}w") - 1e-9) & (differ <= MOST_DIFFERENT)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row: doc_id, component_id, kept, and hashes of the text (t1, t2).

    component_id is the smallest doc_id of the near-duplicate group (null for a group of null ids alone); one document of a
    group is kept, that with this id. Null texts count as empty; texts without words are equal to each other only if
    the same. Of a doc_id that occurs with several texts, that of the smallest hash is kept; repeated rows share their verdict.
    Texts of any length are described whole; an empty table gives no rows; other columns are left out, so none can clash.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(77), "text"))
    # texts stay where they are; copies that lie together are described once, and only descriptions are shuffled
    found = save(map_texts(rows, "w bigint, d1 bigint, d2 bigint, keys array<bigint>, checks array<bigint>", _describe))
    # classes by multiset; texts without words by their own hash
    empty = F.col("w") == 0
    found = found.withColumns({"d1": F.when(empty, F.col("t1")).otherwise(F.col("d1")), "d2": F.when(empty, F.col("t2")).otherwise(F.col("d2"))})
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "t1", "t2"))
    kinds = found.groupBy("d1", "d2").agg(best.alias("least"), F.min("w").alias("w"), F.first("keys").alias("keys"), F.first("checks").alias("checks"))
    kinds = save(kinds.withColumn("cls", F.monotonically_increasing_id()))
    light = kinds.select("cls", "w", *(F.get("checks", F.lit(i)).alias(f"c{i}") for i in range(CHECKS)))
    bucket = save(_buckets(kinds))
    edges = _link(rows, kinds, light, bucket)
    group = kinds.select("cls", "d1", "d2", "least").join(edges.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    head = group.groupBy("component").agg(F.min("least").alias("head"))
    member = save(group.join(head, "component").select("d1", "d2", "head"))
    forget(bucket, edges)
    out = found.select("doc_id", "t1", "t2", "d1", "d2").join(member, ["d1", "d2"])
    kept = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("t1") == F.col("head.t1")) & (F.col("t2") == F.col("head.t2"))
    return out.select("doc_id", F.col("head.doc_id").alias("component_id"), kept.alias("kept"), "t1", "t2")


def _buckets(kinds: DataFrame) -> DataFrame:
    """(key, cls, n) of buckets with two classes at least, n being their number."""
    long = kinds.select("cls", F.explode("keys").alias("key"))
    many = long.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return long.join(many, "key")


def _stars(bucket: DataFrame) -> DataFrame:
    """Pairs of classes that share a bucket, few for each class: the best of its buckets' centres, by STARS orders.

    In the first order a class is the better, the more classes its buckets hold: the text that most of a group derive
    from meets the most of them. In the others a hash decides. So pairs grow as classes do, however large a bucket is.
    """
    degree = bucket.groupBy("cls").agg(F.sum("n").alias("degree"))
    rows = bucket.select("key", "cls").join(degree, "cls")

    def order(j):
        return F.struct((F.lit(0) if j else -F.col("degree")).cast("long").alias("d"), F.xxhash64("cls", F.lit(j)).alias("h"), F.col("cls").alias("m"))

    centres = rows.groupBy("key").agg(*(F.min(order(j)).alias(f"m{j}") for j in range(STARS)))
    near = bucket.select("key", "cls").join(centres, "key").groupBy("cls").agg(*(F.min(F.when(F.col(f"m{j}.m") != F.col("cls"), F.col(f"m{j}"))).alias(f"m{j}") for j in range(STARS)))
    pairs = near.select("cls", F.explode(F.array(*(F.col(f"m{j}.m") for j in range(STARS)))).alias("m")).where("m IS NOT NULL")
    return pairs.select(F.least("cls", "m").alias("a"), F.greatest("cls", "m").alias("b")).distinct()


def _compare_blocks(key, rows):
    """All pairs of one pair of blocks of a bucket whose components differ: edges between components that a similar pair joins.

    Check bits and sizes come first, exact overlaps for those that pass; only a spanning forest leaves the task.
    """
    import pyarrow as pa

    x, y = key[1].as_py(), key[2].as_py()
    rows = rows.combine_chunks()
    block, comp, w = (rows[c].to_numpy() for c in ("block", "component", "w"))
    checks = np.column_stack([rows[f"c{i}"].to_numpy() for i in range(CHECKS)]).view(U)
    lists = rows["elements"].chunk(0) if rows["elements"].num_chunks else rows["elements"].combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ids = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1]
    start = np.cumsum(size) - size
    names, node = np.unique(comp, return_inverse=True)
    a, b = np.flatnonzero(block == x), np.flatnonzero(block == y)
    mine = np.zeros(len(ids) and ids.max() + 1, bool)
    ei, ej = [], []
    for part in np.array_split(a, max(1, len(a) // 128)):
        differ = sum(np.bitwise_count(checks[part, None, i] ^ checks[None, b, i]).astype(np.int16) for i in range(CHECKS))
        low, high = np.minimum(w[part, None], w[None, b]), np.maximum(w[part, None], w[None, b])
        near = (differ <= MOST_DIFFERENT) & (low >= SIMILARITY * high - 1e-9) & (node[part, None] != node[None, b])
        for k in np.flatnonzero(near.any(axis=1)):
            i, js = part[k], b[near[k]]
            own = ids[start[i] : start[i] + size[i]]
            mine[own] = True
            n = size[js]
            flat = np.arange(n.sum()) + np.repeat(start[js] - (np.cumsum(n) - n), n)
            common = np.add.reduceat(mine[ids[flat]].astype(np.int64), np.cumsum(n) - n)
            mine[own] = False
            js = js[common >= SIMILARITY * (size[i] + n - common) - 1e-9]
            ei.append(np.full(len(js), node[i]))
            ej.append(node[js])
    root = local_roots(len(names), np.concatenate(ei), np.concatenate(ej)) if ei else np.arange(len(names))
    child = np.flatnonzero(root != np.arange(len(names)))
    return pa.table({"a": names[root[child]], "b": names[child]})


def _link(spark_docs: DataFrame, kinds: DataFrame, light: DataFrame, bucket: DataFrame) -> DataFrame:
    """Components of classes (node, component) from verified pairs: stars first, then all pairs of buckets that are still in several components."""
    side = lambda p: light.select(F.col("cls").alias(p), F.col("w").alias(f"{p}w"), *(F.col(f"c{i}").alias(f"{p}c{i}") for i in range(CHECKS)))
    # multisets of the classes that are in any bucket, from one text each
    some = bucket.select("cls").distinct()
    heads = kinds.join(some, "cls").select("cls", F.col("least.doc_id").alias("h"), F.col("least.t1").alias("h1"), F.col("least.t2").alias("h2"))
    texts = spark_docs.join(heads, spark_docs["doc_id"].eqNullSafe(heads["h"]) & (spark_docs["t1"] == heads["h1"]) & (spark_docs["t2"] == heads["h2"])).select("cls", "text")
    sets = save(map_texts(texts, "elements array<bigint>", lambda t: [elements(*shingles(t))]).dropDuplicates(["cls"]))
    pairs = save(_stars(bucket).join(side("a"), "a").join(side("b"), "b").where(_alike("a", "b")).select("a", "b"))
    links = save(_verified(pairs, sets))
    label = components(links)
    at = save(bucket.select("key", "cls").join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    blocks = F.greatest(F.ceil(F.sum("w") / BLOCK_ELEMENTS), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int")
    per = at.join(light.select("cls", "w"), "cls").groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), blocks.alias("blocks")).where("lo <> hi")
    part = at.join(per.select("key", "blocks"), "key").withColumn("block", F.pmod(F.xxhash64("cls", "key"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))
    part = part.join(light, "cls").join(sets, "cls").select("key", "component", "w", *(f"c{i}" for i in range(CHECKS)), "elements", "block", F.explode(pair).alias("pair")).select("*", "pair.x", "pair.y").drop("pair")
    more = save(part.groupBy("key", "x", "y").applyInArrow(_compare_blocks, "a bigint, b bigint"))
    out = components(links.unionByName(more))
    forget(sets, pairs, label, at, more)
    return out


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each near-duplicate group, with the columns it came with; of repeated rows one stays."""
    key = classes(docs, doc_id, text).where("kept").groupBy(F.col("doc_id").alias("_k"), F.col("t1").alias("_k1"), F.col("t2").alias("_k2")).agg(F.count("*").alias("_n"))
    key = save(key)
    t = F.coalesce(docs[text].cast("string"), F.lit(""))

    def of(keys):
        return docs.join(keys, docs[doc_id].eqNullSafe(keys["_k"]) & (F.xxhash64(t) == keys["_k1"]) & (F.xxhash64(F.lit(77), t) == keys["_k2"]), "left_semi")

    repeated = key.where("_n > 1")
    if repeated.isEmpty():  # as a rule: then texts are moved once only
        return of(key)
    return of(key.where("_n = 1")).unionByName(of(repeated).dropDuplicates([doc_id, text]))
