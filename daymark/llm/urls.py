"""URL filters: longest matching rule, else logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, mix

# The contract's rules, as (verdict, host/path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: Words that unwanted hosts are made of, and words of ordinary ones, written down without looking at any table of urls.
UNWANTED = (
    "casino poker slots roulette jackpot betting bets gamble lottery viagra cialis pills pharma meds diet porn xxx sex adult cams escort hookup singles nude spam mailer phishing malware virus trojan warez crack cracked "
    "keygen serials torrent replica fake cheap discount payday loan loans doubler ads adserver adclick banner popup popunder tracker tracking pixel clicks clickbait affiliate linkfarm linkseo prize winner freemoney scam hack"
).split()
ORDINARY = (
    "news paper daily press journal review library archive museum gallery university college school kindergarten academy course lesson math physics chemistry biology history science astronomy geology language grammar poetry "
    "novel story book books reading writing music orchestra theatre concert cinema film dance painting photo garden forest river mountain lake ocean weather climate travel trail hiking cycling running swimming football "
    "chess kitchen recipe recipes bakery bread cooking health doctor hospital nurse dentist therapy city town village council parliament government court justice bridge railway station airport harbour market shop store "
    "furniture carpenter tailor pottery weaving knitting farmers orchard vineyard honey birds animals insects flowers trees software compiler database network protocol manual guide docs wiki forum blog community family "
    "parents children together another whether northern southern weathering gathering leather feather heather nothing something everyone neighbour stories studies notes letters thoughts the this that there other entire nation inter"
).split()
ENDINGS = (".test", ".example", "-online.test", ".site.test", ".invalid")
FOLDERS = ("", "en/", "fr/", "es/", "de/", "article/", "item/", "page/", "a/b/")


def invented(n: int = 1500, seed: int = 1, unwanted=UNWANTED, ordinary=ORDINARY) -> tuple[tuple[str, int], ...]:
    """n labelled urls by rule, every fourth unwanted: an unwanted word, alone or with one of either kind, or one to three ordinary words; paths say nothing."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    out = []
    for i in range(n):
        bad = i % 4 == 0
        words = [pick(unwanted), *([pick((unwanted, ordinary)[int(rng.integers(2))])] if rng.random() < 0.7 else [])] if bad else [pick(ordinary) for _ in range(1 + int(rng.integers(3)))]
        rng.shuffle(words)
        host = pick(("", "", "www.", "m.", "blog.")) + pick(("-", "-", "")).join(words) + pick(ENDINGS)
        path = pick(FOLDERS) + pick(("", str(rng.integers(1, 9999)), f"{rng.integers(1, 9999)}.html", f"{rng.integers(1, 99)}/"))
        out.append((f"{pick(('http', 'https'))}://{host}/{path}{pick(('', '', '?page=2', '?utm_source=feed', '#top'))}", int(bad)))
    return tuple(out)


BUCKETS = 1 << 14


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without a url or `://`."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1])
    return host, m[2]


def features(hosts: list[str], paths: list[str], sizes=(3, 4)) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of hosts and paths, each kind hashed apart, and the row of each, rows rising.

    The bytes of all rows are hashed together; short strings give few or none.
    """
    found, owner = [], []
    with np.errstate(over="ignore"):
        for tag, texts in enumerate(([f"^{h}$" for h in hosts], [f"{p}$" for p in paths])):
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
            row = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
            for n in sizes:
                if len(data) < n:
                    continue
                h = np.full(len(data) - n + 1, tag * 8 + n, np.uint64)
                for i in range(n):
                    h = h * np.uint64(257) + data[i : len(data) - n + 1 + i]
                whole = row[: len(h)] == row[n - 1 :]  # not across two rows
                found.append((mix(h)[whole] % np.uint64(BUCKETS)).astype(np.int64))
                owner.append(row[: len(h)][whole])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return found[order], owner[order]


def train(labelled: tuple[tuple[str, int], ...], epochs: int = 120, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent, a url at a time; the same table gives the same model."""
    hosts, paths = zip(*(split_url(u) for u, _ in labelled), strict=True)
    found, owner = features(list(hosts), list(paths))
    edges = np.searchsorted(owner, np.arange(len(labelled) + 1))
    w, bias = np.zeros(BUCKETS), 0.0
    for _ in range(epochs):
        for k, (_, y) in enumerate(labelled):
            f = found[edges[k] : edges[k + 1]]
            scale = 1 / np.sqrt(max(1, len(f)))
            g = 1 / (1 + np.exp(-(w[f].sum() * scale + bias))) - y
            np.add.at(w, f, -rate * g * scale)
            bias -= 0.05 * rate * g
        w *= 1 - decay
    return w, bias


@lru_cache(maxsize=2)
def _trained(labelled: tuple[tuple[str, int], ...]) -> tuple[np.ndarray, float]:
    return train(labelled)


class Filter:
    """Rules by host and path: the longest one that fits wins; of the same host/path given twice, the first holds."""

    def __init__(self, rules=RULES, labelled=None, threshold: float = 0.5):
        self.rules: dict[str, dict[str, str]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.rules.setdefault(host, {}).setdefault(slash + path, verdict)
        self.lengths = sorted({len(p) for by in self.rules.values() for p in by}, reverse=True)
        self.weights, self.bias = _trained(invented() if labelled is None else tuple(labelled))
        self.threshold = threshold

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, verdict = None, None
        suffix = host
        while suffix:
            by = self.rules.get(suffix)
            for n in self.lengths if by else ():
                if n <= len(path) and (v := by.get(path[:n])) and (best is None or len(suffix) + n > len(best)):
                    best, verdict = suffix + path[:n], v
            suffix = suffix.partition(".")[2]
        return best, verdict

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probabilities that urls are unwanted; 0 without a host and path."""
        found, owner = features(hosts, paths)
        total, many = np.bincount(owner, self.weights[found], len(hosts)), np.bincount(owner, minlength=len(hosts))
        p = 1 / (1 + np.exp(-(total / np.sqrt(np.maximum(1, many)) + self.bias)))
        return np.where([bool(h or x) for h, x in zip(hosts, paths, strict=True)], p, 0.0)

    def score(self, host: str, path: str) -> float:
        return float(self.scores([host], [path])[0])


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, labelled=None) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict, score (null where a rule decided).

    Null urls and those without `://` have an empty host and path, fit no rule and are allowed; a very long url is read
    whole; an empty table gives no rows. Repeated rows and null ids each give their own row. Rules and labelled urls are parameters held by every task: meant for up to
    some 100,000 of them; each url costs a lookup per host label and rule length, whatever their number.
    """
    model = Filter(rules, labelled)

    def run(urls):
        hosts, paths = zip(*(split_url(u) for u in urls), strict=True)
        ruled = [model.rule(h, p) for h, p in zip(hosts, paths, strict=True)]
        score = model.scores(list(hosts), list(paths))
        said = [v or ("block" if s >= model.threshold else "allow") for (_, v), s in zip(ruled, score, strict=True)]
        return [list(hosts), list(paths), [r for r, _ in ruled], said, [None if r is not None else float(s) for (r, _), s in zip(ruled, score, strict=True)]]

    base = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"))
    return map_texts(base, "host string, path string, rule string, verdict string, score double", run, "url")
