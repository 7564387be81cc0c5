"""Counters folded in the order of arrival: revisions before times, restarts by epoch, corrections that may lower a total.

The fold isn't commutative: whether an arrival replaces the value held, is passed over as older, or is joined by the
greater of both depends on what is held. It is made of segments all the same. A segment of arrivals is summed up by its
*stops*: the arrivals that may be the first not to be passed over, each with the cell that the rest of the segment makes
of it. What is held when a segment begins goes on as the outcome of its first stop, or unchanged. Two summaries make
that of both segments, in any grouping, so a key of very many rows is folded in pieces that are combined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .daily import DAY


@dataclass(frozen=True)
class Cell:
    """A counter's value and where it comes from; at: a number, revision: anything, epoch: text; each may be missing."""

    total: float
    at: float | None = None
    revision: str | None = None
    epoch: str | None = None


@dataclass(frozen=True)
class Stop:
    """An arrival, and what the rest of its segment makes of it; `joins`: the outcome's total is at least that of the cell held."""

    arrival: Cell
    outcome: Cell
    joins: bool


#: A segment: its stops, and the outcome where nothing is held yet.
Segment = tuple[tuple[Stop, ...], Cell | None]
EMPTY: Segment = ((), None)


def _compared(new: str, old: str) -> int:
    """Numbers by size, otherwise as texts."""
    try:
        a, b = float(new), float(old)
    except ValueError:
        a, b = new, old
    return (a > b) - (a < b)


def _age(held: Cell, new: Cell) -> int:
    """1: new is newer than what is held, -1: older, 0: it can't be told. The revision decides where both have one, else the time."""
    if held.revision is not None and new.revision is not None:
        return _compared(new.revision, held.revision)
    if held.at is not None and new.at is not None:
        return (new.at > held.at) - (new.at < held.at)
    return 0


def _restarts(held: Cell, new: Cell) -> bool:
    return new.epoch is not None and held.epoch != new.epoch


def step(held: Cell | None, new: Cell) -> Cell:
    """The fold by one arrival."""
    if held is None or _restarts(held, new) or _age(held, new) > 0:
        return new
    return held if _age(held, new) < 0 else replace(new, total=max(held.total, new.total))


def _passes(held: Cell, new: Cell) -> bool:
    return not _restarts(held, new) and _age(held, new) < 0


def entered(segment: Segment, held: Cell | None) -> Cell | None:
    """What is held behind a segment."""
    stops, start = segment
    if held is None:
        return start
    for s in stops:
        if not _passes(held, s.arrival):
            joined = s.joins and not _restarts(held, s.arrival) and _age(held, s.arrival) == 0
            return replace(s.outcome, total=max(s.outcome.total, held.total)) if joined else s.outcome
    return held


def _number(text: str | None) -> float | None:
    try:
        return None if text is None else float(text)
    except ValueError:
        return None


def _covers(a: Cell, b: Cell) -> bool:
    """Whether a cell that isn't passed over by b can't be passed over by a either (sure only for numbers)."""
    if a.epoch != b.epoch and b.epoch is not None or a.epoch is not None and b.epoch is None:
        return False
    if (a.revision is None) != (b.revision is None) or (a.at is None) != (b.at is None):
        return False
    if a.revision is not None:
        x, y = _number(a.revision), _number(b.revision)
        if x is None or y is None or not x >= y:
            return a.revision == b.revision and (a.at is None or a.at >= b.at)
    return a.at is None or a.at >= b.at


def _pruned(stops: Iterable[Stop]) -> tuple[Stop, ...]:
    """The stops without those that change nothing: a segment of rising or of falling arrivals keeps one."""
    kept: list[Stop] = []
    for s in stops:  # whatever stops here has stopped at an earlier one
        if not any(_covers(k.arrival, s.arrival) for k in kept):
            kept.append(s)
    out: list[Stop] = []
    for s in reversed(kept):  # whatever stops here would stop at the next one and come out the same
        if out and not s.joins and not out[0].joins and s.outcome == out[0].outcome and _covers(out[0].arrival, s.arrival):
            continue
        out.insert(0, s)
    return tuple(out)


def _on(stop: Stop, segment: Segment) -> Stop:
    """A stop with a segment more behind it."""
    after = entered(segment, stop.outcome)
    joins = False
    if stop.joins:  # the joined total lives on where the outcome is passed through, or joined again
        raised = entered(segment, replace(stop.outcome, total=float("inf")))
        joins = raised.total == float("inf")
    return Stop(stop.arrival, after, joins)


def single(arrival: Cell) -> Segment:
    return (Stop(arrival, arrival, True),), arrival


def joined(first: Segment, second: Segment) -> Segment:
    """The summary of one segment behind another."""
    if first == EMPTY:
        return second
    if second == EMPTY:
        return first
    stops = [_on(s, second) for s in first[0]] + list(second[0])
    return _pruned(stops), entered(second, first[1])


def summed_up(arrivals: Iterable[Cell]) -> Segment:
    """The summary of arrivals in their order."""
    parts = [single(a) for a in arrivals]
    while len(parts) > 1:  # pairs of neighbours, so that long segments stay cheap
        parts = [joined(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else EMPTY


_CELL = "struct<total:double,at:double,revision:string,epoch:string>"
_SEGMENT = f"stops array<struct<arrival:{_CELL},outcome:{_CELL},joins:boolean>>, start {_CELL}"


def _cell(row: dict | None) -> Cell | None:
    return None if row is None else Cell(row["total"], row["at"], row["revision"], row["epoch"])


def _runs(batches: Iterator, keys: int) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of sorted batches, key by key (the first columns); a key's rows are handed over in pieces, batch by batch."""
    from itertools import groupby

    for batch in batches:
        names = batch.schema.names
        for key, rows in groupby(batch.to_pylist(), key=lambda r: tuple(r[c] for c in names[:keys])):
            yield key, list(rows)


def arrival_fold(facts: DataFrame, arrival: Sequence[str], segment: Column, value: str = "value", at: Column | None = None, revision: Column | None = None, epoch: Column | None = None, keys: Sequence[str] = DAY) -> DataFrame:
    """keys, total, at, revision, epoch: each counter folded by arrival, a null value being none.

    segment: rises with arrival (a day or an hour of it, say). The rows of a key are sorted and summed up segment by
    segment; only summaries meet by key.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    none = F.lit(None)
    rows = facts.where(F.col(value).isNotNull()).select(
        *keys, segment.alias("_segment"), *(F.col(a).alias(f"_o{i}") for i, a in enumerate(arrival)),
        F.col(value).cast("double").alias("total"), (at if at is not None else none).cast("double").alias("at"), (revision if revision is not None else none).cast("string").alias("revision"), (epoch if epoch is not None else none).cast("string").alias("epoch"),
    )
    order = [f"_o{i}" for i in range(len(arrival))]
    kinds = {f.name: f.dataType for f in rows.schema}
    key_ddl = ", ".join(f"`{k}` {kinds[k].simpleString()}" for k in keys)
    summary = f"{key_ddl}, _segment {kinds['_segment'].simpleString()}, _piece bigint, {_SEGMENT}"
    n, result = len(keys), f"{key_ddl}, total double, at double, revision string, epoch string"
    parted, folded = (to_arrow_schema(StructType.fromDDL(x)) for x in (summary, result))

    def tables(schema, found):
        return pa.Table.from_pylist(found, schema=schema).to_batches()

    def sum_up(batches):
        piece = 0
        for batch in batches:
            found = []
            for key, part in _runs([batch], n + 1):
                stops, start = summed_up(_cell(r) for r in part)
                piece += 1  # a segment that several batches hold is summed up in pieces
                shown = [{"arrival": vars(s.arrival), "outcome": vars(s.outcome), "joins": s.joins} for s in stops]
                found.append(dict(zip(parted.names, (*key, piece, shown, vars(start)), strict=True)))
            yield from tables(parted, found)

    def combine(batches):
        now, held = None, None
        for batch in batches:
            found = []
            for key, part in _runs([batch], n):
                if key != now:
                    if now is not None:
                        found.append(dict(zip(keys, now, strict=True)) | vars(held))
                    now, held = key, None
                for r in part:
                    stops = tuple(Stop(_cell(s["arrival"]), _cell(s["outcome"]), s["joins"]) for s in r["stops"])
                    held = entered((stops, _cell(r["start"])), held)
            yield from tables(folded, found)
        if now is not None:
            yield from tables(folded, [dict(zip(keys, now, strict=True)) | vars(held)])

    by = [*keys, "_segment"]
    parts = rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(sum_up, summary)
    return parts.repartition(*keys).sortWithinPartitions(*by, "_piece").mapInArrow(combine, result)
