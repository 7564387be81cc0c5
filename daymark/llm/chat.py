"""Chat formatting: conversations as a prefix tree whose shared turns are emitted once, depth first.

A node is a distinct sequence of leading turns. Its tokens are those of its last turn: head, body and foot, encoded
apart, so that the loss covers a body's tokens exactly. Nodes are laid out in the order of a depth-first walk, which
is the order of the conversations sorted by their turn keys: a node stands at the first conversation that has it and
its subtree ends with the last one. A token at place q may attend to a token at place k of another node exactly if k's
node is an ancestor, which is start(k) <= q < subtree_end(k): every node carries that interval, and the position id
of its first token (the number of its ancestors' tokens).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, save
from .tokens import encoder

LEARNED = "assistant"
#: Strings that mark turns here or in other templates, and what stands for them in texts.
CONTROL = {"\\": "\\\\", "<|": "\\l", "|>": "\\r", "</s>": "\\z", "<s>": "\\s", "[INST]": "\\i", "[/INST]": "\\j"}
_ESCAPE = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_BACK = {v: k for k, v in CONTROL.items()}
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
FOOT = "<|end|>\n"


def escape(text: str) -> str:
    """text without any control string; unescape() restores it."""
    return _ESCAPE.sub(lambda m: CONTROL[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _BACK[m[0]], text)


def head(role: str) -> str:
    return f"<|{escape(role)}|>\n"


_PATH_TYPE = "key string, parent string, idx int, role string, ids array<int>, n_head int, n_body int, position bigint, path array<string>"


def _turns(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Sorted rows of whole conversations to their turns' nodes, and a last row (idx -1) with each conversation's keys.

    Conversations stream through: a state of one conversation is kept, its keys and hashes.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([rows.schema["conv_id"], *StructType.fromDDL(_PATH_TYPE)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        bpe = encoder(tokenizer)
        now, path, position, idx = object(), [], 0, 0

        def closing(out):
            if path:
                out.append((now, path[-1], None, -1, None, None, None, None, None, list(path)))

        for batch in batches:
            conv, _, role, text = (c.to_pylist() for c in batch.columns)
            heads = [head(r or "") for r in role]
            bodies = [escape(t or "") for t in text]
            head_ids, body_ids, foot = bpe.encode(heads), bpe.encode(bodies), bpe.encode([FOOT])[0]
            out: list[tuple] = []
            for c, r, t, h, b in zip(conv, role, text, head_ids, body_ids, strict=True):
                if c != now:
                    closing(out)
                    now, path, position, idx = c, [], 0, 0
                parent = path[-1] if path else None
                key = hashlib.blake2b(f"{parent}\n{len(r or '')}:{r or ''}\n{t or ''}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
                ids = np.frombuffer(h + b + foot, "<i4")
                out.append((c, key, parent, idx, r or "", ids, len(h) // 4, len(b) // 4, position, None))
                path.append(key)
                position, idx = position + len(ids), idx + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        out = []
        closing(out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


def tree(conversations: DataFrame, tokenizer: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, members): the token tree, and for each conversation its nodes in order.

    nodes: key, parent (null at a first turn), idx (turns before), role, ids, start and subtree_end (places in the walk),
    position (position id of the first token), loss_start and loss_end (within ids; equal without loss).
    members: conv_id, idx, key.
    Turns go by turn, then role and text; null turns come first, null roles and texts are empty, repeated rows are
    turns of their own, and a null conv_id is one conversation. An empty table gives empty ones. A conversation's
    keys (32 characters a turn) meet in one row; its texts don't, so a conversation of a million turns is a row of 32 MB.
    """
    rows = conversations.select(*(F.col(f"`{c}`").alias(n) for c, n in ((conv_id, "conv_id"), (turn, "turn"), (role, "role"), (text, "text"))))
    rows = rows.withColumns({"role": F.col("role").cast("string"), "text": F.col("text").cast("string")})
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    turns = save(_turns(rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"), tokenizer))
    ranks = save(turns.where("idx = -1").select("conv_id", "path").orderBy("path", "conv_id").select("conv_id", F.monotonically_increasing_id().alias("rank")))
    steps = turns.where("idx >= 0")
    ranked = steps.join(ranks.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    node = F.struct("parent", "idx", "role", "ids", "n_head", "n_body", "position")
    nodes = ranked.groupBy("key").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.any_value(node).alias("node"))
    nodes = save(nodes.select("key", "first", "last", "node.*"))
    # where each conversation's own nodes begin and end in the walk: running sums inside the sort's partitions, then over these
    own = nodes.groupBy(F.col("first").alias("rank")).agg(F.sum(F.size("ids")).alias("more"), F.min("position").alias("least"))
    conv = ranks.select("rank", F.shiftright("rank", 33).alias("part")).join(own, "rank", "left").withColumn("more", F.coalesce("more", F.lit(0)))
    conv = conv.withColumn("end", F.sum("more").over(Window.partitionBy("part").orderBy("rank")))
    parts = conv.groupBy("part").agg(F.sum("more").alias("sum"))
    parts = parts.withColumn("base", F.sum("sum").over(Window.orderBy("part")) - F.col("sum"))  # a row for each partition
    conv = save(conv.join(parts, "part").select("rank", "least", (F.col("base") + F.col("end")).alias("end"), (F.col("base") + F.col("end") - F.col("more")).alias("begin")))
    a = conv.select(F.col("rank").alias("first"), "begin", "least")
    b = conv.select(F.col("rank").alias("last"), F.col("end").alias("subtree_end"))
    body = F.when(F.col("role") == LEARNED, F.col("n_body")).otherwise(0)
    nodes_out = nodes.join(a, "first").join(b, "last").select(
        "key", "parent", "idx", "role", "ids", (F.col("begin") + F.col("position") - F.col("least")).alias("start"), "subtree_end", "position",
        F.col("n_head").alias("loss_start"), (F.col("n_head") + body).alias("loss_end"),
    )
    out = save(nodes_out)
    forget(nodes, conv, ranks)
    return out, steps.select("conv_id", "idx", "key")


def read_back(nodes: DataFrame, members: DataFrame, tokenizer: str) -> DataFrame:
    """Conversations as the tree's tokens give them: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = members.join(nodes.select("key", "ids", "loss_start", "loss_end"), "key").select("conv_id", "idx", "ids", "loss_start", "loss_end")
    schema = StructType([rows.schema["conv_id"], *StructType.fromDDL("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")])
    arrow = to_arrow_schema(schema)
    turn = re.compile(r"<\|(.*?)\|>\n(.*)<\|end\|>\n", re.DOTALL)

    def run(batches):
        bpe = encoder(tokenizer).bpe
        now, state = object(), None

        def closed():
            return [] if state is None else [(now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])]

        for batch in batches:
            out: list[tuple] = []
            conv = batch.column(0).to_pylist()
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            size = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            for c, lo, hi, a, b in zip(conv, ends - size, ends, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if state is None or c != now:
                    out += closed()
                    now, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = flat[lo:hi].tolist()
                segment = bpe.decode_bytes(ids).decode("utf-8")
                m = turn.fullmatch(segment)
                state[0] += 1
                state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                if b > a:
                    learned = unescape(bpe.decode_bytes(ids[a:b]).decode("utf-8"))
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(segment)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        if out := closed():
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "idx").mapInArrow(run, schema)
