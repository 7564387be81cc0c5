"""Every registered query over the driver's smallest tables, against plain versions of what it must return."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from daymark.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def docs():
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert len({i for i, _ in rows}) == len(rows)
    return {i: t or "" for i, t in rows}


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def shown(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()


def spans_of(text, rules):
    found = [(m.start(), m.end(), k, n) for n, (k, p, flags, ok) in enumerate(rules) for m in re.finditer(p, text, flags) if ok(m)]
    return [s[:3] for s in sorted(found, key=lambda s: (s[0], s[3]))]


def digits(m):
    return re.sub("[^0-9]", "", m[0])


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0, lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", 0, lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0, lambda m: 10 <= len(digits(m)) <= 15),
)
SECRETS = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
)


@pytest.mark.parametrize(("name", "rules"), [("op3_pii", PERSONAL), ("op10_secret_scans", SECRETS)])
def test_spans(spark, docs, name, rules):
    got = {r.doc_id: r for r in run(spark, name)}
    assert set(got) == set(docs)
    for i, text in docs.items():
        base = spans_of(text, rules)
        assert got[i].base_sha256 == shown(base)
        assert all(got[i][f"n_{k}"] == sum(s[2] == k for s in base) for k, *_ in rules)
        assert {f"{k}:{a}:{b}" for a, b, k in base} <= set(got[i].spans.split(","))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    with duckdb.connect() as c:
        for t in ("documents", "embeddings", "pages"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = c.sql(queries.ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert sorted(map(str, want.select(", ".join(df.columns)).fetchall())) == sorted(str(tuple(r)) for r in df.collect())


def test_packing(spark, docs):
    rows = run(spark, "op2_best_fit_packing")
    first = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, {})[r.piece] = r
    assert set(pieces) == set(docs)
    for i, text in docs.items():
        ids = np.array([*first.encode(text, add_special_tokens=False).ids, 2], "<u4")
        own = [pieces[i][k] for k in range(len(pieces[i]))]
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1]) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 1024 for r in own[1:]) and own[0].length <= 1024
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own]
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0] + [n for _, n in own])[:-1]) and sum(n for _, n in own) <= 1024
    # no fewer sequences hold them: every two of the least filled ones are too much for one
    assert len(places) <= 1.05 * sum(r.length for r in rows) / 1024 + 2


def test_pieces(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in run(spark, "op5_sentencepiece")}
    assert set(got) == set(docs)
    for i, text in docs.items():
        ids = sp.encode(text)
        assert (got[i].n_tokens, got[i].ids_crc32, got[i].text_sha256) == (len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_urls(spark):
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    pages = duckdb.sql(f"SELECT page_id, url FROM '{SF}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in run(spark, "op4_url_filters")}
    assert len(got) == len(pages)
    for i, url in pages:
        tail = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host, path = re.split("[/?#]", tail, maxsplit=1)[0], re.split("[?#]", tail, maxsplit=1)[0]
        path = path[len(host) :] if path.startswith(host) else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(r, v) for v, r in rules if (host + "/").endswith(("." if host != r.split("/")[0] else "") + r.split("/")[0] + "/") and path.startswith("/" + r.split("/", 1)[1])]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and got[i].verdict == (verdict or got[i].verdict) and got[i].verdict in ("allow", "block")


def test_toxicity(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op6_toxicity")}
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall()
    held = [(got[i].predicted, y) for i, y in labels if i in got and got[i].held_out and y is not None]
    assert not held or np.mean([p == y for p, y in held]) > 0.7
    # scores tell toxic documents from others, which "never toxic" doesn't
    scores = {y: [got[i].score for i, label in labels if i in got and label == y] for y in (0, 1)}
    if min(map(len, scores.values())) >= 5:
        assert np.mean([[a > b for b in scores[0]] for a in scores[1]]) > 0.75


def test_near_duplicates(spark, docs):
    def multiset(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None

    got = {r.doc_id: r for r in run(spark, "op7_minhash")}
    sets, root = {i: multiset(t) for i, t in docs.items()}, {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if docs[i] == docs[j] or a and b and min(a.total(), b.total()) >= 0.8 * max(a.total(), b.total()) and (a & b).total() >= 0.8 * (a | b).total():
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert {i: find(i) for i in ids} == {i: got[i].component_id for i in ids}
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)


def test_chats(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet' ORDER BY ALL").fetchall()
    odd = "</s>[INST] ok [/INST]"
    told = {-1: [("user", odd), ("assistant", odd)]}
    for c, _, role, text in rows:
        told.setdefault(c, []).append((role or "", text or ""))
    got = {r.conv_id: r for r in run(spark, "op8_chat_formatting")}
    assert set(got) == set(told)
    for c, turns in told.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        all_ = "".join(f"{r}\n{t}\n" for r, t in turns)
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(all_.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r.formatted_chars >= len(all_)
