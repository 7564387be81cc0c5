"""SentencePiece encoding and decoding of whole texts by a max-plus scan over piece paths.

The model merges by rank (BPE). A sequence of pieces is what merging gives exactly if every two neighbours fit: merging
the text of the two alone gives the two back. So a step from a piece to its neighbour scores 0 if they fit and minus
infinity if not, and the ids of a text are its one path of score 0.

A giant text is cut into chunks at fixed places. The state at a cut is the piece that holds the character before it, or
ends there. Each chunk yields the matrix of best scores from every state at its left cut to every state at its right
one; the matrices of a text are combined in pairs (the max-plus product is associative), which settles the state at every
cut; then each chunk traces its own path between its two states, apart from the others. Chunks are rows, so any task may
take any of them; a run without blanks is cut like any other text.

No piece has a blank behind another character (checked when the model is loaded), so every path passes such a place, and
the words between them are solved once and kept.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache
from operator import add

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import map_texts, save, trimmed

#: Characters of a chunk.
CHUNK = 8_192
#: Words whose ids a worker keeps, their most characters, and pairs of pieces whose fit it keeps.
WORDS, WORD, PAIRS = 300_000, 64, 600_000
BLANK = "▁"  # how pieces write a blank
_UNITS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_CUT = re.compile(f"(?<=[^{BLANK}]){BLANK}")


def written(text: str) -> str:
    """A text as pieces spell it: blanks shown, and one more in front; an empty text has none."""
    return BLANK + text.replace(" ", BLANK) if text else ""


class Pieces:
    """A BPE model with byte fallback: which pieces fit side by side, and paths of fitting pieces."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(model.get_piece_size())
        if any(map(model.is_unused, n)) or sum(map(model.is_byte, n)) != 256:
            raise ValueError("pieces out of use, or no bytes for characters without a piece")
        if model.decode(model.encode("ﬁ²　x  y")) != "ﬁ²　x  y":
            raise ValueError("this model changes texts before it encodes them")
        plain = [i for i in n if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.id = {model.id_to_piece(i): i for i in plain}
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(BLANK in p.lstrip(BLANK) for p in self.id):
            raise ValueError("a piece of this model reaches across blanks; texts can't be cut there")
        self.begins = dict.fromkeys((p[:k] for p in self.id for k in range(1, len(p))), False) | dict.fromkeys(self.id, True)
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.id))
        self.spelt = [b""] * len(n)
        for p, i in self.id.items():
            self.spelt[i] = p.replace(BLANK, " ").encode()
        for b, i in enumerate(self.byte):
            self.spelt[i] = bytes([b])
        self.matches = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.matches.add_word(p, (len(p), i))
        self.matches.make_automaton()
        self.piece = {i: p for p, i in self.id.items()}
        self.other = re.compile("[^" + re.escape("".join(sorted({p for p in self.id if len(p) == 1}))) + "]")
        if any(map(self.other.search, self.id)):
            raise ValueError("a piece of this model holds a character that isn't a piece")
        self.joined = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self.follows: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces by merging the best-scored neighbours first, the leftmost of equal ones."""
        parts, score = list(text), self.score.get
        while len(parts) > 1:
            best, at = None, -1
            for k, s in enumerate([score(a + b) for a, b in zip(parts, parts[1:], strict=False)]):
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str | None, b: str) -> bool:
        """Whether b may follow a; without a, whether b is a piece that merging gives at all."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merged((a or "") + b) == ([a, b] if a else [b])
        return got

    def walk(self, s: str, lo: int, hi: int, prev: str | None = None, then: str | None = None) -> list[str] | None:
        """The pieces of s[lo:hi] on a path of score 0 between prev and then, or None."""
        out, at, last, dead, begins, pairs = [], lo, prev, set(), self.begins.get, self.pairs.get

        def options() -> list[str]:
            got, k = [s[at : at + 1]] if at < hi else [], at + 2
            while k <= hi and (whole := begins(s[at:k])) is not None:
                if whole:
                    got.append(s[at:k])
                k += 1
            return got

        left = [options()]
        while True:
            if at == hi and (then is None or self.fits(last, then)):
                return out
            ways = left[-1]
            while ways:  # the longest first
                p = ways.pop()
                if not dead or (at + len(p), p) not in dead:
                    ok = pairs((last, p))
                    if ok or ok is None and self.fits(last, p):
                        out.append(p)
                        at, last = at + len(p), p
                        left.append(options())
                        break
            else:  # no way on from here
                if not out:
                    return None
                left.pop()
                p = out.pop()
                dead.add((at, p))
                at, last = at - len(p), out[-1] if out else prev

    def ids(self, pieces: list[str]) -> bytes:
        """Ids as little-endian signed 32-bit numbers; a character without a piece is its bytes."""
        out: list[int] = []
        for p in pieces:
            if p in self.id:
                out.append(self.id[p])
            else:
                out += [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
        return np.array(out, "<i4").tobytes()

    def _follows(self, key: int) -> bool:
        """fits() of two ids, first << 16 | second; of the second alone where the first is 65535."""
        if len(self.follows) >= PAIRS:
            self.follows.clear()
        a, b = self.piece.get(key >> 16), self.piece[key & 65535]
        got = self.follows[key] = self.merged((a or "") + b) == ([a, b] if a else [b])
        return got

    def _path(self, unit: str) -> list[int]:
        """Ids of a text of known characters: the last piece of the path of score 0 to every place, forward, then back.

        There is one such path to each place, the pieces of the text up to there; matches that end at a place come longest first.
        """
        last, size, follows = [65535] + [-1] * len(unit), [0] * (len(unit) + 1), self.follows.get
        for end, (n, i) in self.matches.iter(unit):
            end += 1
            if last[end] < 0:
                key = last[end - n] << 16 | i
                ok = follows(key)
                if ok or ok is None and self._follows(key):
                    last[end], size[end] = i, n
        out, at = [], len(unit)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _part(self, part: str) -> bytes:
        """Ids of a text of characters that stand side by side in pieces, or of one without a piece."""
        got = self.before.get(part)
        if got is None:
            ids = [self.byte[b] for b in part.encode("utf-8", "surrogatepass")] if self.other.search(part) else self._path(part)
            got = array("i", ids).tobytes()
        return self._keep(part, got)

    def _keep(self, unit: str, ids: bytes) -> bytes:
        if len(unit) <= WORD:
            if len(self.known) >= WORDS // 2:  # what is still asked for comes over from the older half
                self.before, self.known = self.known, {}
            self.known[unit] = ids
        return ids

    def _unit(self, unit: str) -> bytes:
        """No merge joins two characters that stand side by side in no piece: the unit is cut there, and its parts are solved once for all units."""
        if (got := self.before.get(unit)) is not None:
            return self._keep(unit, got)
        joined, known, at, parts = self.joined, self.known, 0, []
        for k, pair in enumerate(map(add, unit, unit[1:]), 1):
            if pair not in joined:
                part = unit[at:k]
                parts.append(known.get(part) or self._part(part))
                at = k
        part = unit[at:]
        parts.append(known.get(part) or self._part(part))
        return self._keep(unit, b"".join(parts)) if at else parts[0]

    def units(self, s: str) -> bytes:
        """Ids of a written text that begins and ends where every path passes: its words' ids."""
        known = self.known.get
        return b"".join([known(unit) or self._unit(unit) for unit in _UNITS.findall(s)])

    # chunks: a window is the chunk with up to `longest` characters of the text on either side

    def states(self, window: str, at: int) -> list[tuple[int, int]]:
        """States at a cut, as begin and end of the piece relative to it; the ends of a text have one state."""
        if at in (0, len(window)):
            return [(0, 0)]
        ends = [(a, b) for a in range(max(0, at - self.longest), at) for b in range(at, min(len(window), a + self.longest) + 1)]
        return [(a - at, b - at) for a, b in ends if b - a == 1 or window[a:b] in self.id]

    def matrix(self, window: str, lo: int, hi: int) -> np.ndarray:
        """Which states at hi are reached from which states at lo with score 0 (true) rather than minus infinity."""
        left, right = self.states(window, lo), self.states(window, hi)
        cuts = [m.start() for m in (_CUT.search(window, max(lo, 1)),) if m and m.start() < hi]
        if cuts:  # every path passes the first and the last cut
            cuts.append(next(k for k in range(hi - 1, cuts[0] - 1, -1) if window[k] == BLANK and window[k - 1] != BLANK))
            into = [self.walk(window, lo + b, cuts[0], window[lo + a : lo + b] or None) is not None for a, b in left]
            out = [self.walk(window, cuts[1], hi + a, None, window[hi + a : hi + b] or None) is not None for a, b in right]
            return np.outer(into, out)
        reach: dict[int, dict[str | None, int]] = {}  # place -> last piece -> bits of the states it is reached from
        for k, (a, b) in enumerate(left):
            at = reach.setdefault(lo + b, {})
            at[window[lo + a : lo + b] or None] = at.get(window[lo + a : lo + b] or None, 0) | 1 << k
        column = {s: j for j, s in enumerate(right)}
        out = np.zeros((len(left), len(right)), bool)
        bits = lambda m: [m >> k & 1 == 1 for k in range(len(left))]
        for k, (a, b) in enumerate(left):  # a piece that reaches over the whole chunk is a state of both cuts
            if (lo + a - hi, lo + b - hi) in column and a < 0:
                out[k, column[lo + a - hi, lo + b - hi]] = True
        for at in range(lo, hi):
            before = reach.pop(at, None)
            if not before:
                continue
            for k in range(1, min(self.longest, len(window) - at) + 1):
                p = window[at : at + k]
                if k > 1 and p not in self.id:
                    continue
                mask = 0
                for q, m in before.items():
                    if self.fits(q, p):
                        mask |= m
                if mask and at + k < hi:
                    to = reach.setdefault(at + k, {})
                    to[p] = to.get(p, 0) | mask
                elif mask and hi < len(window):
                    out[:, column[at - hi, at + k - hi]] |= bits(mask)
                elif mask and at + k == hi:
                    out[:, 0] |= bits(mask)
        if hi == len(window):  # states whose piece is the text's last
            for m in reach.get(hi, {}).values():
                out[:, 0] |= bits(m)
        return out

    def trace(self, window: str, lo: int, hi: int, left: tuple[int, int], right: tuple[int, int]) -> bytes:
        """Ids of the pieces behind the left state's up to the right state's, which begin in the chunk."""
        begin, end = lo + left[1], hi + right[0]
        prev, then = window[lo + left[0] : begin] or None, window[end : hi + right[1]] or None
        if begin > end:  # one piece over the whole chunk, or the left state's own
            return b""
        m = _CUT.search(window, max(lo, 1))
        if m and m.start() < hi:
            first = m.start()
            last = next(k for k in range(hi - 1, first - 1, -1) if window[k] == BLANK and window[k - 1] != BLANK)
            return self.ids(self.walk(window, begin, first, prev)) + self.units(window[first:last]) + self.ids([*self.walk(window, last, end, None, then), *([then] if then else [])])
        return self.ids([*self.walk(window, begin, end, prev, then), *([then] if then else [])])

    def decode(self, ids: np.ndarray, first: bool = True) -> str:
        """The text of ids; that of a text's first ids has no blank in front."""
        raw = b"".join(map(self.spelt.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return raw[1:] if first else raw


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def products(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of the first, the first two, ... of all matrices, in pairs of pairs: a parallel prefix scan."""
    if len(matrices) == 1:
        return matrices
    pairs = products([a @ b for a, b in zip(matrices[::2], matrices[1::2], strict=False)])
    return [matrices[0], *(pairs[k // 2] if k % 2 else pairs[k // 2 - 1] @ matrices[k] for k in range(1, len(matrices)))]


def settled(matrices: list[np.ndarray]) -> list[int]:
    """The state at every cut on the one path of score 0, the text's begin and end among them."""
    before, now, out = products(matrices), 0, [0]
    for k in range(len(matrices) - 1, 0, -1):
        (now,) = np.flatnonzero(before[k - 1][0] & matrices[k][:, now])
        out.append(int(now))
    return [0, *out[::-1]]


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def _small(rows: DataFrame) -> DataFrame:
    return rows.where(F.length("text") <= 2 * CHUNK)


def _windows(rows: DataFrame, model: str) -> DataFrame:
    """Rows (row, doc_id, chunk, n_chunks, window, lo, hi, matrix, left) of giant texts, dealt evenly; left: states at the left cut."""
    import pyarrow as pa

    kind = rows.schema["doc_id"].dataType
    giant = rows.where(F.length("text") > 2 * CHUNK)

    def cut(batches):
        margin = pieces(model).longest
        for batch in batches:
            for i, text in enumerate(batch.column(2).to_pylist()):
                s = written(text)
                starts = range(0, len(s), CHUNK)
                for lo in range(0, len(starts), 256):
                    part = range(lo, min(len(starts), lo + 256))
                    a = [max(0, k * CHUNK - margin) for k in part]
                    windows = [s[x : (k + 1) * CHUNK + margin] for x, k in zip(a, part, strict=True)]
                    at = pa.array([i] * len(part), pa.int64())
                    rest = [pa.array(part, pa.int32()), pa.array([len(starts)] * len(part), pa.int32()), pa.array(windows, pa.string()), pa.array([k * CHUNK - x for x, k in zip(a, part, strict=True)], pa.int32()), pa.array([min(len(s), (k + 1) * CHUNK) - x for x, k in zip(a, part, strict=True)], pa.int32())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *rest], names=["row", "doc_id", "chunk", "n_chunks", "window", "lo", "hi"])

    fields = [StructField("row", rows.schema["row"].dataType), StructField("doc_id", kind), *StructType.fromDDL("chunk int, n_chunks int, window string, lo int, hi int")]
    dealt = giant.mapInArrow(trimmed(cut), StructType(fields)).repartition(F.col("row"), F.col("chunk"))

    def yields(batches):
        sp = pieces(model)
        for batch in batches:
            got = [sp.matrix(w, a, b) for w, a, b in zip(*(batch.column(c).to_pylist() for c in (4, 5, 6)), strict=True)]
            more = [pa.array([np.packbits(m).tobytes() for m in got], pa.binary()), pa.array([m.shape[0] for m in got], pa.int32()), pa.array([m.shape[1] for m in got], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "matrix", "n_left", "n_right"])

    return save(dealt.mapInArrow(trimmed(yields), StructType([*fields, *StructType.fromDDL("matrix binary, n_left int, n_right int")])))


def _settle(rows):
    """The chunks of one text (an Arrow table) with the numbers of the states at their cuts."""
    import pyarrow as pa

    rows = rows.sort_by("chunk")
    shape = list(zip(rows["n_left"].to_pylist(), rows["n_right"].to_pylist(), strict=True))
    matrices = [np.unpackbits(np.frombuffer(m, np.uint8), count=a * b).astype(bool).reshape(a, b) for m, (a, b) in zip(rows["matrix"].to_pylist(), shape, strict=True)]
    at = settled(matrices)
    return pa.table({"row": rows["row"], "chunk": rows["chunk"], "at_left": pa.array(at[:-1], pa.int32()), "at_right": pa.array(at[1:], pa.int32())})


def _traced(windows: DataFrame, model: str) -> DataFrame:
    """Rows (row, doc_id, chunk, n_chunks, raw) of giant texts: the chunks' ids as bytes."""
    import pyarrow as pa

    at = windows.select("row", "chunk", "matrix", "n_left", "n_right").groupBy("row").applyInArrow(_settle, "row bigint, chunk int, at_left int, at_right int")
    both = windows.select("row", "doc_id", "chunk", "n_chunks", "window", "lo", "hi").join(at, ["row", "chunk"]).select("row", "doc_id", "chunk", "n_chunks", "window", "lo", "hi", "at_left", "at_right")

    def run(batches):
        sp = pieces(model)
        for batch in batches:
            raw = []
            for w, lo, hi, a, b in zip(*(batch.column(c).to_pylist() for c in range(4, 9)), strict=True):
                raw.append(sp.trace(w, lo, hi, sp.states(w, lo)[a], sp.states(w, hi)[b]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(raw, pa.binary())], names=["row", "doc_id", "chunk", "n_chunks", "raw"])

    return both.mapInArrow(trimmed(run), StructType([*both.schema.fields[:4], *StructType.fromDDL("raw binary")]))


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per chunk: row (a number of the document's row), doc_id, chunk, n_chunks, ids array<int>.

    Null texts are empty, and an empty text is one chunk without ids. Repeated rows and null ids have rows of their
    own; other columns are left aside; an empty table gives no rows. Chunks are dealt evenly, whatever document they are
    of. Only a text's matrices (some hundred bytes a chunk) meet in one task.
    """
    rows = _rows(docs, doc_id, text)
    small = _small(rows).withColumns({"chunk": F.lit(0), "n_chunks": F.lit(1)})
    one = map_texts(small, "raw binary", lambda sp, texts: [[sp.units(written(t)) for t in texts]], setup=lambda: pieces(model))
    giant = _traced(_windows(rows, model), model)
    cols = ["row", "doc_id", "chunk", "n_chunks", "raw"]
    return map_texts(one.select(cols).unionByName(giant.select(cols)), "ids array<int>", lambda raw: [[np.frombuffer(b or b"", "<i4") for b in raw]], text="raw")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded with `text`: the chunk's text from its ids. A document's texts in order of their chunks are its own."""
    import pyarrow as pa

    names = encoded.columns

    def run(batches):
        sp = pieces(model)
        for batch in batches:
            column, chunk = batch.column(names.index("ids")).to_pylist(), batch.column(names.index("chunk")).to_pylist()
            text = [sp.decode(np.array(ids, np.int64), k == 0) for ids, k in zip(column, chunk, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*names, "text"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("text", StringType())]))


_DIGEST = "n_chunks int, n_tokens bigint, ids_crc32 bigint, text_sha256 string"


def round_trip(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, n_chunks, n_tokens, ids_crc32 (of all ids as little-endian 32-bit numbers), text_sha256 (of the decoded text).

    Null and empty texts have no ids; repeated rows and null ids each give a row; an empty table gives none. Documents of
    one chunk are summed up where they are encoded; the ids of giant ones stream through a task chunk by chunk.
    """
    import hashlib

    import pyarrow as pa

    def digest(sp, texts):
        raw = [sp.units(written(t)) for t in texts]
        back = [hashlib.sha256(sp.decode(np.frombuffer(x, "<i4")).encode()).hexdigest() for x in raw]
        return [[1] * len(raw), [len(x) // 4 for x in raw], [zlib.crc32(x) for x in raw], back]

    rows = _rows(docs, doc_id, text)
    small = map_texts(_small(rows), _DIGEST, digest, setup=lambda: pieces(model))
    traced = _traced(_windows(rows, model), model).repartition("row").sortWithinPartitions("row", "chunk")
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL(_DIGEST)])

    def stream(batches):
        sp, out = pieces(model), []
        for batch in batches:
            for row, k, n, raw in zip(*(batch.column(c).to_pylist() for c in range(1, 5)), strict=True):
                if k == 0:
                    tokens, crc, sha = 0, 0, hashlib.sha256()
                tokens, crc = tokens + len(raw) // 4, zlib.crc32(raw, crc)
                sha.update(sp.decode(np.frombuffer(raw, "<i4"), k == 0).encode())
                if k == n - 1:
                    out.append((row, n, tokens, crc, sha.hexdigest()))
            if out:
                kinds = (batch.column(1).type, pa.int32(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)
                out = []

    return small.select(schema.names).unionByName(traced.mapInArrow(trimmed(stream), schema))
