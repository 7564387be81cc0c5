"""Best-fit packing: documents into sequences of bounded length, each partition's count certified by lower bounds.

Pieces are dealt to partitions of bounded size. Each partition packs by best-fit decreasing over counts of lengths
and compares its number of sequences with dual-feasible-function lower bounds. A partition whose count meets its
bound is certified: no packing of it does better. Others keep their full sequences and give up the pieces of the
rest, which are dealt anew among fewer partitions of the same kind and packed again, for a fixed number of rounds.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, slabs, trimmed
from .tokens import encoder

CAPACITY = 1024
END_ID = 2
#: Pieces that a partition packs at once.
GROUP = 40_000


def pieces(n_ids: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only one longer than capacity is cut, and its first piece may be shorter."""
    first = n_ids % capacity or capacity
    return [(0, min(first, n_ids))] + [(s, capacity) for s in range(first, n_ids, capacity)]


def tokenize(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32. Every document ends with END_ID; null text is empty."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    id_type = to_arrow_type(rows.schema["doc_id"].dataType)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        bpe = encoder(tokenizer)
        for batch in batches:
            at, out, i = [], [], 0
            for texts in slabs(batch.column(1).to_pylist()):
                for ids in bpe.encode(texts, added=True):
                    ids += end
                    for k, (s, n) in enumerate(pieces(len(ids) // 4, capacity)):
                        at.append(i)
                        out.append((k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])))
                    i += 1
            if out:
                k, s, n, c = zip(*out, strict=True)
                cols = [batch.column(0).cast(id_type).take(pa.array(at)), pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(trimmed(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of every piece, and the number of sequences: longest first, each to the fullest place with room.

    Sequences are kept by the room they have left, so that a piece costs a search over at most `capacity` rooms.
    """
    order = np.argsort(-lengths, kind="stable")
    seq, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[int] = []  # rooms that some sequence has, sorted
    having: dict[int, list[int]] = {}
    n = 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        k = bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            s = having[room].pop()
            if not having[room]:
                del having[room], rooms[k]
        else:
            s, room = n, capacity
            n += 1
        seq[i], offset[i] = s, capacity - room
        left = room - size
        if left:
            if left not in having:
                having[left] = []
                insort(rooms, left)
            having[left].append(s)
    return seq, offset, n


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest of a family of dual-feasible-function bounds on the number of sequences.

    With threshold e, pieces above capacity - e count whole, those from e to capacity - e by length, shorter ones not
    at all; and the rounding functions that count floor((k + 1) * length / capacity) / k for k up to 20.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    mass, many = np.cumsum(count * size), np.cumsum(count)
    for e in range(1, capacity // 2 + 1):
        whole = int(many[-1] - many[capacity - e])
        middle = int(mass[capacity - e] - mass[e - 1])
        best = max(best, whole + -(-middle // capacity))
    for k in range(1, 21):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # over k * capacity
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def _packer(round_no: int, capacity: int):
    return lambda rows: _group(rows, round_no, capacity)


def _group(rows, round_no: int, capacity: int):
    """Pack one group (an Arrow table). Certified: all its sequences stand. Otherwise only full ones do; the rest goes on."""
    import pyarrow as pa

    lengths = rows["length"].to_numpy()
    seq, offset, n = best_fit_decreasing(lengths, capacity)
    full = np.bincount(seq, weights=lengths, minlength=n).astype(np.int64) == capacity
    certified = n <= lower_bound(lengths, capacity)
    done = np.ones(len(seq), bool) if certified else full[seq]
    base = (round_no << 56) | (rows["part"][0].as_py() << 24)
    rows = rows.drop_columns(["part"])
    for name, values in (("sequence_id", base + seq), ("offset", offset), ("certified", full[seq] | certified), ("done", done)):
        rows = rows.append_column(name, pa.array(values))
    return rows


def pack(found: DataFrame, rounds: int = 3, capacity: int = CAPACITY) -> DataFrame:
    """Rows of tokenize() with sequence_id, offset and certified. Pieces of a whole sequence's length need no partner.

    certified: the sequence is full, or its partition's count of sequences is a proven minimum. The last round's packings stand whether certified or not. Pieces are dealt by a hash of all their columns and
    a running number, so that equal rows spread as well.
    """
    kind = found.schema["doc_id"].dataType.simpleString()
    out_type = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, certified boolean, done boolean"
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified"]
    found = save(found)
    whole = found.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumns({"offset": F.lit(0).cast("long"), "certified": F.lit(True)})
    open_, settled = found.where(F.col("length") < capacity), [whole.select(columns)]
    for r in range(rounds):
        n = open_.count()
        if not n:
            break
        parts = -(-n // GROUP)
        dealt = open_.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "length", F.monotonically_increasing_id(), F.lit(r)), F.lit(parts)))
        last = r == rounds - 1
        got = save(dealt.groupBy("part").applyInArrow(_packer(r, capacity), out_type))
        settled.append((got if last else got.where("done")).select(columns))
        if last or parts == 1:
            if not last:
                settled.append(got.where("NOT done").select(columns))
            break
        open_ = got.where("NOT done").select("doc_id", "piece", "start", "length", "ids_crc32")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, rounds: int = 3, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified (as in pack()).

    Null and empty texts are the end id alone; an empty table gives no rows; repeated rows and null ids are packed
    each for itself; other columns are left aside. Of pieces of one length any may come first: which sequence a piece lies
    in isn't defined, only how full sequences are.
    """
    return pack(tokenize(docs, tokenizer, doc_id, text, capacity), rounds, capacity)
