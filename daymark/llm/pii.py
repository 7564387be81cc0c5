"""PII: exact base rules, and a character BiLSTM with CRF transitions trained in numpy that adds spans.

The model's labels are begin/inside tags of four kinds. Whatever is accepted as one (see plausible()) holds an anchor: an
e-mail address `@`, a phone or card number a digit, an IPv6 address a digit or a colon between letters a-f or colons.
So windows are laid over anchors, the whole runs without blanks that hold an `@`, and what stands near them; all of a text is searched for anchors. Overlapping windows give each character averaged
label scores, and one Viterbi pass over each joined region settles the spans. The last window of a region ends where it ends, so that a text's end looks like any other place; a text shorter than a window is
filled up with line ends, which training has too.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from ipaddress import IPv6Address

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .secrets import SPANS, digest

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
WINDOW, STRIDE = 64, 32
SYMBOLS = 48

# The contract's base rules.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# the look-behind changes no match and keeps long digit runs from being tried from every digit
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]|(?<=[A-Fa-f:]):(?=[A-Fa-f:])")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping e-mail spans; each run of name characters is tried once, and only where @ follows it."""
    at, done = text.find("@"), 0
    while at >= 0:
        a = at
        while a > done and (c := text[a - 1]) and (c.isascii() and (c.isalnum() or c in "._%+-")):
            a -= 1
        m = EMAIL.match(text, a) if a < at else None
        if m:
            yield m.start(), m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the base rules by start, then kind: leftmost non-overlapping per kind, failing matches dropped."""
    out = [(a, b, 0) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in IP.finditer(text) if "." in text else ():
            if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    out.sort(key=lambda s: (s[0], s[2]))
    return [(a, b, KINDS[k]) for a, b, k in out]


def symbols(text: str) -> np.ndarray:
    """A class for each character: letters by case and hash, digits as one, punctuation by itself, others as one."""
    return _TABLE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def _symbol_table() -> np.ndarray:
    t = np.full(129, 1, np.int8)
    for c in range(128):
        x = chr(c)
        t[c] = 2 if x.isdigit() else 3 + (c - 97) % 6 if x.islower() else 9 if x.isupper() else 10 if x in " \t" else 11 if x in "\r\n" else 12 + (c * 7) % 35
    for i, x in enumerate("@.-+()/:,_%"):
        t[ord(x)] = SYMBOLS - 1 - i
    return t


_TABLE = _symbol_table()


def labelled(rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n windows of synthetic text with labelled spans: personal data of each kind among prose, dates, sums and codes."""
    digit = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda x: x[rng.integers(len(x))]
    plain = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))

    def word() -> str:
        """Small letters, now and then some that aren't ASCII."""
        w = plain()
        if rng.random() < 0.15:
            at = int(rng.integers(len(w)))
            w = w[:at] + pick("äöüßéèñçøłő") + w[at + 1 :]
        return w

    def card() -> str:
        body = digit(15)
        body += next(str(d) for d in range(10) if luhn(body + str(d)))
        return pick((body, *(by.join(body[i : i + 4] for i in range(0, 16, 4)) for by in (" ", "-", ".", "\xa0"))))

    def ip() -> str:
        if rng.random() < 0.5:
            return ".".join(str(x) for x in rng.integers(0, 256, 4))
        groups = [f"{x:x}" for x in rng.integers(0, 65536, 8)]
        a, b = sorted(rng.integers(1, 8, 2))
        return pick((":".join(groups), f"{':'.join(groups[:a])}::{':'.join(groups[b:])}"))

    def item() -> tuple[str, int]:
        k = int(rng.integers(-5, 4))
        if k == 0:
            return f"{word()}{pick(('.', '_', ''))}{pick((word(), digit(2)))}@{word()}{pick(('', digit(1)))}.{pick(('example.com', 'org', 'net', 'co.uk'))}", 0
        if k == 1:
            return ip(), 1
        if k == 2:
            return card(), 2
        if k == 3:
            a, b, c = digit(3), digit(3), digit(4)
            return pick((f"+{digit(1)} ({a}) {b}-{c}", f"+{digit(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}")), 3
        year = 1900 + int(rng.integers(0, 130))
        return pick((
            digit(int(rng.integers(1, 6))), f"{year}", f"{year}-0{1 + rng.integers(9)}-1{rng.integers(10)}", f"{digit(1)}.{digit(1)}.{digit(1)}", f"{digit(2)}:{digit(2)}", f"{digit(1)},{digit(3)}.{digit(2)}",
            f"id {digit(8)}", f"password={word()}{digit(3)}{word()}{digit(4)}", f"@{word()}", f"{digit(2)} @ {digit(1)}", f"{digit(int(rng.integers(11, 24)))}", f"{word()}{digit(9)}", f"({digit(2)})", f"{year}-{year + 1}", f"v{digit(1)}.{digit(2)}",
        )), -1

    x, y = np.zeros((n, WINDOW), np.int8), np.zeros((n, WINDOW), np.int8)
    for i in range(n):
        text, tags = "", []
        while len(text) < WINDOW + 16:
            piece, k = item() if rng.random() < 0.45 else (word(), -1)
            piece_tags = [0] * len(piece) if k < 0 else [1 + 2 * k] + [2 + 2 * k] * (len(piece) - 1)
            tail = pick((" ", " ", " ", ", ", ". ", "\n"))
            text, tags = text + piece + tail, tags + piece_tags + [0] * len(tail)
        cut = int(rng.integers(0, 16))
        tags = tags[cut : cut + WINDOW]
        if tags[0] and tags[0] % 2 == 0:  # a span cut at the window's start still begins there
            tags[0] -= 1
        x[i], y[i] = symbols(text[cut : cut + WINDOW]), tags
        if rng.random() < 0.25:  # a short text: it ends behind a piece, and line ends fill the window
            ends = [t for t in range(8, WINDOW) if y[i][t] == 0]
            if ends:
                x[i][ends[rng.integers(len(ends))] :] = 11
                y[i][int(np.flatnonzero(x[i] != 11)[-1]) + 1 :] = 0
    return x, y


def _allowed() -> np.ndarray:
    """Inside may only follow begin or inside of its kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for to in range(2, TAGS, 2):
        ok[:, to] = False
        ok[to - 1, to] = ok[to, to] = True
    return ok


_OK = _allowed()


def _outer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over time and batch of the outer products of two arrays (time, batch, width)."""
    return a.reshape(-1, a.shape[2]).T @ b.reshape(-1, b.shape[2])


class Tagger:
    """Embedding, one LSTM each way, a linear layer to label scores, and transition scores between labels."""

    def __init__(self, hidden: int = 16, width: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.h = hidden
        self.p = {"emb": r(SYMBOLS, width) * 2, "out": r(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"wx{d}": r(width, 4 * hidden), f"wh{d}": r(hidden, 4 * hidden), f"b{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"b{d}"][hidden : 2 * hidden] = 1

    def _run(self, e: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """LSTM over e (time, batch, width); keep gets what the backward pass needs."""
        H, p = self.h, self.p
        xs = e @ p[f"wx{d}"] + p[f"b{d}"]
        h = c = np.zeros((e.shape[1], H), np.float32)
        out = np.empty((*e.shape[:2], H), np.float32)
        for t in range(len(e)):
            z = xs[t] + h @ p[f"wh{d}"]
            s = 1 / (1 + np.exp(-z[:, : 3 * H]))
            g = np.tanh(z[:, 3 * H :])
            prev_h, prev_c = h, c
            c = s[:, H : 2 * H] * c + s[:, :H] * g
            tc = np.tanh(c)
            h = s[:, 2 * H :] * tc
            out[t] = h
            if keep is not None:
                keep.append((s, g, prev_h, prev_c, tc))
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Label scores (batch, time, labels) of windows x (batch, time)."""
        e = self.p["emb"][x.T]
        h = np.concatenate([self._run(e, "f"), self._run(e[::-1], "b")[::-1]], axis=2)
        return (h @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2)

    def _crf(self, u: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, and its gradients by label scores u (time, batch, labels) and by transitions."""
        T, N, _ = u.shape
        trans = np.where(_OK, self.p["trans"], -1e4)
        step, top = np.exp(trans), u.max(axis=2, keepdims=True)
        eu = np.exp(u - top)
        eu[0, :, 2::2] = 0  # nothing begins inside
        a, b, c = np.empty((T, N, TAGS)), np.ones((T, N, TAGS)), np.empty((T, N, 1))
        for t in range(T):  # each place's sums are scaled to 1; the scales' logarithms make up the total
            a[t] = (a[t - 1] @ step if t else 1) * eu[t]
            c[t] = a[t].sum(axis=1, keepdims=True)
            a[t] /= c[t]
        z = (np.log(c) + top).sum(axis=(0, 2))
        dtrans = np.zeros((TAGS, TAGS))
        for t in range(T - 1, 0, -1):
            on = b[t] * eu[t] / c[t]
            dtrans += step * (a[t - 1].T @ on)
            b[t - 1] = on @ step.T
        du = a * b
        tt, nn = np.meshgrid(np.arange(T), np.arange(N), indexing="ij")
        gold = (u[tt, nn, y].sum(0) + trans[y[:-1], y[1:]].sum(0)).sum()
        du[tt, nn, y] -= 1
        np.subtract.at(dtrans, (y[:-1], y[1:]), 1)
        return float((z.sum() - gold) / N), (du / N).astype(np.float32), (dtrans / N * _OK).astype(np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 9, batch: int = 64, rate: float = 0.02) -> list[float]:
        """Adam over shuffled batches; the same windows give the same model. Returns the mean loss of each epoch."""
        p, H, rng = self.p, self.h, np.random.default_rng(3)
        m, v, n, said = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0, []
        for epoch in range(epochs):
            order, total = rng.permutation(len(x)), []
            for lo in range(0, len(x), batch):
                bx, by = x[order[lo : lo + batch]].T.astype(np.int64), y[order[lo : lo + batch]].T.astype(np.int64)
                e, kf, kb = p["emb"][bx], [], []
                h = np.concatenate([self._run(e, "f", kf), self._run(e[::-1], "b", kb)[::-1]], axis=2)
                loss, du, dtrans = self._crf((h @ p["out"] + p["bias"]).astype(np.float64), by)
                total.append(loss)
                g = {"trans": dtrans, "bias": du.sum((0, 1)), "out": _outer(h, du)}
                dh, de = du @ p["out"].T, np.zeros_like(e)
                for d, kept, up, src in (("f", kf, dh[:, :, :H], e), ("b", kb, dh[::-1, :, H:], e[::-1])):
                    dz = np.empty((*up.shape[:2], 4 * H), np.float32)
                    nh = nc = np.zeros_like(up[0])
                    for t in range(len(up) - 1, -1, -1):
                        s, gg, _, pc, tc = kept[t]
                        now = up[t] + nh
                        dc = now * s[:, 2 * H :] * (1 - tc * tc) + nc
                        ds = np.concatenate([dc * gg, dc * pc, now * tc], axis=1) * s * (1 - s)
                        dz[t] = np.concatenate([ds, dc * s[:, :H] * (1 - gg * gg)], axis=1)
                        nc = dc * s[:, H : 2 * H]
                        nh = dz[t] @ p[f"wh{d}"].T
                    ph = np.stack([k[2] for k in kept])
                    g |= {f"wh{d}": _outer(ph, dz), f"wx{d}": _outer(src, dz), f"b{d}": dz.sum((0, 1))}
                    back = dz @ p[f"wx{d}"].T
                    de += back if d == "f" else back[::-1]
                g["emb"] = np.zeros_like(p["emb"])
                np.add.at(g["emb"], bx, de)
                n += 1
                lr = rate * 0.4 ** (epoch // 3)
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    p[k] = (p[k] - lr * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-6)).astype(np.float32)
            said.append(float(np.mean(total)))
        return said

    def viterbi(self, u: np.ndarray) -> np.ndarray:
        """Best labels of one region's scores (time, labels)."""
        trans = np.where(_OK, self.p["trans"], -1e4)
        score = u[0].astype(np.float64)
        score[2::2] = -1e4
        back = np.empty(u.shape, np.int8)
        for t in range(1, len(u)):
            ways = score[:, None] + trans
            back[t] = ways.argmax(0)
            score = ways.max(0) + u[t]
        out = np.empty(len(u), np.int8)
        out[-1] = score.argmax()
        for t in range(len(u) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Model spans of each text. Windows of all texts run together, a bounded number at a time."""
        weight = (np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1.0).astype(np.float32)[:, None]
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        jobs = []  # (text, region start, region end)
        for i, text in enumerate(texts):
            region = None
            for m in _ANCHOR.finditer(text):
                a, b = m.start(), m.end()
                if m[0] == "@":  # a name or a host may be long
                    a, b = _run(text, a)
                a, b = max(0, a - STRIDE) // STRIDE * STRIDE, b + STRIDE
                if region and a <= region[1]:
                    region[1] = b
                else:
                    if region:
                        jobs.append((i, region[0], min(len(text), region[1])))
                    region = [a, b]
            if region:
                jobs.append((i, region[0], min(len(text), region[1])))
        # a region is a window long at least, where its text is
        jobs = [(i, max(0, min(a, b - WINDOW)), min(len(texts[i]), max(b, max(0, min(a, b - WINDOW)) + WINDOW))) for i, a, b in jobs]
        queue, held = [], 0
        for job in [*jobs, None]:
            if job:
                queue.append(job)
                held += job[2] - job[1]
            if queue and (job is None or held >= 200_000):
                self._decode(texts, queue, weight, out)
                queue, held = [], 0
        return out

    def _decode(self, texts, jobs, weight, out) -> None:
        wins, at = [], []
        for k, (i, a, b) in enumerate(jobs):
            sym = symbols(texts[i][a:b])
            last = max(0, len(sym) - WINDOW)
            for lo in [*range(0, last, STRIDE), last]:
                part = sym[lo : lo + WINDOW]
                wins.append(np.pad(part, (0, WINDOW - len(part)), constant_values=11))
                at.append((k, lo, len(part)))
        e = np.concatenate([self.emissions(np.array(wins[lo : lo + 2048], np.int64)) for lo in range(0, len(wins), 2048)])
        total = [np.zeros((b - a, TAGS), np.float32) for _, a, b in jobs]
        mass = [np.zeros((b - a, 1), np.float32) for _, a, b in jobs]
        for (k, lo, n), u in zip(at, e, strict=True):
            total[k][lo : lo + n] += u[:n] * weight[:n]
            mass[k][lo : lo + n] += weight[:n]
        for (i, a, b), u, w in zip(jobs, total, mass, strict=True):
            tags = self.viterbi(u / w)
            begin = np.flatnonzero(tags % 2 == 1)
            for s in begin:
                t = s + 1
                while t < len(tags) and tags[t] == tags[s] + 1:
                    t += 1
                out[i].append((a + int(s), a + int(t), KINDS[(int(tags[s]) - 1) // 2]))


_BLANK = re.compile(r"\s")


def _run(text: str, at: int) -> tuple[int, int]:
    """The run of characters without blanks around a place."""
    end = _BLANK.search(text, at)
    a = at
    while a > 0 and not text[a - 1].isspace():
        a -= 1
    return a, end.start() if end else len(text)


@lru_cache(maxsize=2)
def trained(windows: int = 8000, seed: int = 11) -> Tagger:
    """The tagger after training on `windows` synthetic windows."""
    model = Tagger()
    model.train(*labelled(np.random.default_rng(seed), windows))
    return model


def plausible(piece: str, kind: str) -> bool:
    """Whether a model span looks like its kind: shapes that the base rules miss, and nothing looser."""
    digits = len(_NOT_DIGIT.sub("", piece))
    if kind == "email":
        name, _, host = piece.partition("@")
        return bool(name) and "." in host.strip(".") and " " not in piece
    if kind == "phone":
        return 10 <= digits <= 15 and re.fullmatch(r"\+?[0-9(][0-9() .-]*[0-9]", piece) is not None and re.search(r"[ .)-]", piece) is not None and len(re.findall(r"[0-9]+", piece)) >= 3 and max(map(len, re.findall(r"[0-9]+", piece))) <= 4
    if kind == "card":  # groups parted by what the base rule doesn't take
        return re.fullmatch(r"[0-9]{4}([^\w\r\n])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}|[0-9]{6}\1[0-9]{4,5})", piece) is not None and luhn(_NOT_DIGIT.sub("", piece))
    if piece.count(":") < 2 or len(re.findall("[0-9A-Fa-f]+", piece)) < 3:
        return False
    try:
        return bool(IPv6Address(piece))
    except ValueError:
        return False


def marked_spans(model: Tagger, texts: list[str]) -> list[list[tuple[int, int, str, bool]]]:
    """Base spans (true), and plausible model spans (false) that touch none of them or reach further than all of their kind that they touch, by start, then kind."""
    out = []
    for text, base, more in zip(texts, map(base_spans, texts), model.spans(texts), strict=True):
        ends = np.maximum.accumulate([b for _, b, _ in base]) if base else []
        starts = [a for a, _, _ in base]
        spans = [(*s, True) for s in base]
        for a, b, kind in more:
            before = bisect_left(starts, b)  # base spans that begin before this one ends
            if plausible(text[a:b], kind) and not (before and ends[before - 1] > a and not _outgrown(base, before, a, b, kind)):
                spans.append((a, b, kind, False))
        out.append(sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))
    return out


def _outgrown(base: list[tuple[int, int, str]], before: int, a: int, b: int, kind: str) -> bool:
    """Whether a span holds every base span that it touches, all of its kind, and is none of them: an address of which the rule takes the ASCII end."""
    touched = []
    for s in reversed(base[:before]):
        if s[1] > a:
            touched.append(s)
        elif s[1] < a - WINDOW:  # spans are short beside this, but for a run of digits, which no address holds
            break
    return all(a <= s[0] and s[1] <= b and s[2] == kind and s[:2] != (a, b) for s in touched)


def all_spans(model: Tagger, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """marked_spans() without the marks."""
    return [[s[:3] for s in spans] for spans in marked_spans(model, texts)]


def scan_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Tagger | None = None) -> DataFrame:
    """A row per document: doc_id, spans array<struct<kind, start, end, base>>, code points, end exclusive.

    Null and empty texts have none; whole texts of any length are searched; repeated rows and null ids each give
    their own row. An empty table gives no rows. The model (about 10,000 numbers) goes with the task.
    """
    model = model or trained()

    def run(texts):
        return [[[{"kind": k, "start": a, "end": b, "base": base} for a, b, k, base in spans] for spans in marked_spans(model, texts)]]

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return map_texts(rows, SPANS, run)


def find(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """The query's columns, a row per document; an empty table gives none. Counts and the digest are of the base spans; `spans` has those that the model adds as well."""
    return digest(scan_spans(docs, model=model), KINDS, KINDS)


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span (overlapping ones joined, named by the first) replaced by its kind in brackets."""
    out, done = [], 0
    last = None
    for a, b, kind in spans:
        if last and a < last[1]:
            last = (last[0], max(last[1], b), last[2])
            continue
        if last:
            out += [text[done : last[0]], f"[{last[2].upper()}]"]
            done = last[1]
        last = (a, b, kind)
    if last:
        out += [text[done : last[0]], f"[{last[2].upper()}]"]
        done = last[1]
    return "".join(out) + text[done:]


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", model: Tagger | None = None) -> DataFrame:
    """The documents, same columns and rows, with personal data masked and n_chars renewed where such a column is."""
    model = model or trained()
    taken = "_daymark_text"
    while {taken, taken + "null"} & set(docs.columns):
        taken += "_"

    def run(texts):
        return [[mask(t, s) for t, s in zip(texts, all_spans(model, texts), strict=True)]]

    null = F.col(f"`{text}`").isNull()
    out = map_texts(docs.withColumn(taken + "null", null), f"{taken} string", run, text)
    cols = [F.when(~F.col(taken + "null"), F.col(taken)).alias(c) if c == text else F.length(taken).cast(docs.schema[c].dataType).alias(c) if c == n_chars else F.col(f"`{c}`") for c in docs.columns]
    return out.select(cols)
