"""Document fingerprints: content-defined chunks, and the containment of one document's chunks in another's.

A gear hash rolls over the bytes of a text; places where its top bits are zero end a chunk, by a harder mask before
the normal length and an easier one behind it, so lengths gather around it. The hash sees the last 32 bytes only: text
put in or taken out moves the boundaries near it and no others, and the chunks around it stay the same. A fingerprint
is the set of a document's chunk digests, each with its chunk's length as weight.
"""

from __future__ import annotations

import base64
import math
from bisect import bisect_left
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, map_rows, map_texts, mix, trimmed

#: Bytes of the shortest, the normal and the longest chunk, and zero bits asked for before and behind the normal length.
LEAST, NORMAL, MOST, HARD, EASY = 12, 32, 128, 6, 4
#: Rows of a range of the ring of documents, and ranges at most.
RANGE_ROWS, RANGES = 256, 65_536
#: Bytes whose hashes are in memory at once.
BLOCK = 1 << 20
_GEAR = (mix(np.arange(256, dtype=np.uint64) + MIX[1]) >> np.uint64(32)).astype(np.uint32)


def _rolled(data: np.ndarray) -> np.ndarray:
    """Gear hash (uint32) behind each byte: h = 2 h + gear(byte), by doubling the span that a sum covers."""
    h = _GEAR[data]
    for span in (1, 2, 4, 8, 16):
        h[span:] += h[:-span] << np.uint32(span)
    return h


def boundaries(raw: bytes) -> list[int]:
    """Rising ends of the chunks of raw, the last being its length; none for no bytes."""
    data = np.frombuffer(raw, np.uint8)
    hard, easy = [], []
    for at in range(0, len(data), BLOCK):
        before = min(at, 31)
        h = _rolled(data[at - before : at + BLOCK])[before:]
        good = np.flatnonzero(h < (1 << (32 - EASY)))
        easy.extend((good + (at + 1)).tolist())
        hard.extend((good[h[good] < (1 << (32 - HARD))] + (at + 1)).tolist())
    ends, start, n = [], 0, len(data)
    while n - start > LEAST:
        i = bisect_left(hard, start + LEAST)
        end = hard[i] if i < len(hard) else n
        if end > start + NORMAL:
            i = bisect_left(easy, start + NORMAL + 1)
            end = min(easy[i] if i < len(easy) else n, start + MOST, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunk_set(text: str) -> np.ndarray:
    """The distinct chunks of a text, rising: five bytes of each chunk's digest, then its length in bytes, as uint64."""
    raw = text.encode("utf-8", "surrogatepass")
    keys, start = set(), 0
    for end in boundaries(raw):
        keys.add(int.from_bytes(blake2b(raw[start:end], digest_size=5).digest(), "big") << 8 | (end - start))
        start = end
    out = np.fromiter(keys, np.uint64, len(keys))
    out.sort()
    return out


def written(chunks: np.ndarray) -> str:
    """A fingerprint: the set's six-byte members in order, in base 64 (eight characters each)."""
    return base64.b64encode(chunks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    six = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    eight = np.zeros((len(six), 8), np.uint8)
    eight[:, 2:] = six
    return eight.view(">u8").ravel().astype(np.uint64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Bytes of common chunks over those of the lighter set, 0 to 1: how much of the smaller document the other holds.

    Equal sets, two empty ones among them, have 1; an empty one and another have 0.
    """
    if len(a) == len(b) and (a == b).all():
        return 1.0
    weight = [int((x & np.uint64(255)).sum()) for x in (a, b, np.intersect1d(a, b, assume_unique=True))]
    return weight[2] / min(weight[:2]) if min(weight[:2]) else 0.0


def add(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs and the fingerprint of the column `text` as a column `name` (which docs must not have). Null texts are read as empty; an empty text's fingerprint is empty."""
    if name in docs.columns:
        raise ValueError(f"the rows have a column {name} already")
    return map_texts(docs, f"`{name}` string", lambda texts: [[written(chunk_set(t)) for t in texts]], text=text, keep_text=True)


def likeness(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Of rows with two fingerprints: left, right, containment. A null fingerprint is read as an empty text's."""
    both = pairs.select(F.coalesce(F.col(f"`{left}`"), F.lit("")).alias("left"), F.coalesce(F.col(f"`{right}`"), F.lit("")).alias("right"))
    run = lambda rows: [rows["left"], rows["right"], [containment(read(a), read(b)) for a, b in zip(rows["left"], rows["right"], strict=True)]]
    return map_rows(both, "left string, right string, containment double", run, text="left")


def edited(text: str, follower: str) -> str:
    """text with its last half replaced by as many first characters of its follower."""
    half = len(text) // 2
    return text[: len(text) - half] + follower[:half]


def ring(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents by falling id, each task holding whole ranges of ids: part, last, doc_id, text, sorted by these.

    A range ends in a copy of the document that follows it (last = 1): the first of the next range, and behind the
    last range the first of all, so each row's follower is the row behind it. Rows travel once. Rows of one id are
    in the order of their texts, null ids behind all others; null texts are empty. Rows of one id meet in one range.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))).alias("place")  # a null before all others
    ids = rows.select("doc_id", place)
    ranges = min(RANGES, math.ceil(ids.count() / RANGE_ROWS))
    cuts = sorted(set(ids.where("doc_id IS NOT NULL").approxQuantile("place", [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    split = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="place", outputCol="part") if cuts else None
    parted = lambda df: split.transform(df) if split else df.withColumn("part", F.lit(0.0))
    heads = parted(ids).groupBy("part").agg(F.max("doc_id").alias("head")).collect()  # a row a range: RANGES at most
    heads = sorted(heads, key=lambda r: r["part"])
    before = [(r["part"], r["head"], heads[(i + 1) % len(heads)]["part"]) for i, r in enumerate(heads)]
    opens = F.broadcast(spark.createDataFrame(before, "p double, head bigint, before double"))
    placed = parted(rows.withColumn("place", place))
    told = placed.join(opens, (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("head")), "left")
    copies = F.when(F.col("p").isNull(), F.array(F.struct(F.col("part"), F.lit(0).alias("last")))).otherwise(
        F.array(F.struct(F.col("part"), F.lit(0).alias("last")), F.struct(F.col("before").alias("part"), F.lit(1).alias("last")))
    )
    dealt = told.select("doc_id", "text", F.explode(copies).alias("c")).select("c.part", "c.last", "doc_id", "text")
    return dealt.repartition("part").sortWithinPartitions("part", "last", F.col("doc_id").desc_nulls_last(), "text")


def _walk(batches):
    """Rows of compare_edited() from rows of ring(): one document is held while its follower is read."""
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    held, out, size = None, [], 0
    for batch in batches:
        for part, last, key, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            own = chunk_set(text)
            if held and held[0] == part:
                changed = edited(held[2], text)
                other = chunk_set(changed)
                out.append((held[1], len(held[2]), changed, written(held[3]), written(other), containment(held[3], other), containment(held[3], own)))
                size += len(changed)
            held = None if last else (part, key, text, own)
            if size > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row: doc_id, n_chars (code points), edited (the text with its last half replaced by the beginning of the document that follows
    by falling id), fingerprint, edited_fingerprint, near_edited and near_next (containment towards both texts).

    Null texts are read as empty: an empty text's fingerprint is empty, and near to empty ones only. Equal texts have
    equal fingerprints. The order of rows of one id or without one is ring()'s. A lone row follows itself. Texts of
    any length are hashed whole; other columns are left out, so none can clash. An empty table gives no rows.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return ring(docs, doc_id, text).mapInArrow(trimmed(_walk), "doc_id bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
