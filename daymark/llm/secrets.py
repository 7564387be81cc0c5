"""Secret scans: spans of all rules from the tables of combined automata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton
from .common import map_texts


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `pattern` gives leftmost longest spans; one that isn't a match of `strict` (lengths) too is dropped."""

    kind: str
    pattern: str
    strict: str = ""
    ignore_case: bool = False
    base: bool = True


# The base rules' patterns are fixed by the contract; their strict forms have its lengths.
RULES = (
    # letters of the keywords match in either case; group 2's class has both cases anyhow
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""", True),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]{20,}", base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}", base=False),
    Rule("pem", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----", base=False),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.automaton = Automaton([(r.pattern, r.strict or r.pattern, r.ignore_case) for r in rules])

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text: (start, end, rule number) in code points, by start, then rule."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        last = (-1, 0, 0)  # text, byte and code point reached
        for i, a, b, k in sorted(self.automaton.spans(raw)) if texts else []:
            byte, point = (last[1], last[2]) if last[0] == i else (0, 0)
            point += len(raw[i][byte:a].decode("utf-8", "surrogatepass"))
            last = (i, a, point)
            out[i].append((point, point + len(raw[i][a:b].decode("utf-8", "surrogatepass")), k))
        for spans in out:
            spans.sort(key=lambda s: (s[0], s[2]))
        return out


def scan_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row per document: doc_id, spans array<struct<kind, start, end, base>> in code points, end exclusive.

    Null and empty texts have no spans; repeated rows and null ids each give their own row. The automaton is built
    once here and sent with the task; a text is scanned whole, at any length. An empty table gives no rows.
    """
    scanner = Scanner(rules)
    kinds = [(r.kind, r.base) for r in rules]

    def run(texts):
        return [[[{"kind": kinds[k][0], "start": a, "end": b, "base": kinds[k][1]} for a, b, k in spans] for spans in scanner.spans(texts)]]

    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return map_texts(base, SPANS, run)


def digest(found: DataFrame, listed: tuple[str, ...], counted: tuple[str, ...]) -> DataFrame:
    """Counts per counted kind and the digest, both of base spans, and all spans as text. Built-in functions only."""
    rank = F.create_map(*(x for n, k in enumerate(listed) for x in (F.lit(k), F.lit(n))))
    ordered = F.array_sort(
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("r"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")))
    )
    base = F.filter("spans", lambda s: s["base"])

    def shown(a):
        return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    rows = found.withColumn("spans", ordered)
    return rows.select("doc_id", *map(number, counted), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


SPANS = "spans array<struct<kind:string,start:bigint,`end`:bigint,base:boolean>>"


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The query's columns: counts and digest of the base kinds, and all spans."""
    return digest(scan_spans(docs, rules=rules), tuple(r.kind for r in rules), tuple(r.kind for r in rules if r.base))
