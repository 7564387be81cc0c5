"""Fill-in-middle, fingerprints and hard negatives against plain versions, and their edge cases."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from daymark.llm import fim, fingerprints, negatives, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- fill-in-middle


def test_token_ends_are_those_of_the_pattern(monkeypatch):
    texts = ["", "a", "\n", "Grüße, 😀\r\nab12ć \x00x", "ab" * 90 + "1" + "c" * 200 + "é" * 70, " " * 300 + "z" * 64, "x" * 500]
    for window in (7, 64, 65_536):
        monkeypatch.setattr(fim, "WINDOW", window)
        for text in texts:
            assert fim.token_ends(text).tolist() == [m.end() for m in re.finditer(fim.TOKEN, text)]


def plain_fim(doc_id, text):
    text = text or ""
    h = [int(x, 16) for x in re.findall("." * 8, sha("1:" + ("" if doc_id is None else str(doc_id))))[:4]]
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(prefix), len(middle), "<S>" + suffix + "<P>" + prefix + "<M>" + middle
    return doc_id, len(units), "psm", len(prefix), len(middle), "<P>" + prefix + "<S>" + suffix + "<M>" + middle


def test_fill_in_middle_equals_a_plain_version(spark):
    rng = random.Random(3)
    odd = ["", None, "<P>", "a <M> b", "<<S", "P><", "x<", "<P x", "ab\r\ncd\n", "😀é́", "wort " * 30_000, "a"]
    rows = [(i, rng.choice(odd) if i % 2 else "".join(rng.choice("ab <>PSM1é\n") for _ in range(rng.randint(0, 60)))) for i in range(-20, 150)]
    rows += [(5, rows[0][1]), rows[3], rows[3], (None, "no id at all"), (2**40, "big id"), *((1000 + i, t) for i, t in enumerate(odd))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit(1)).withColumn("form", F.lit("x")).withColumn("a", F.lit(2))
    got = fim.transform(docs).withColumn("again", fim.restored(F.col("form"), F.col("output"))).collect()
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got))) == sorted(repr(plain_fim(*r)) for r in rows)
    assert sorted(r.again for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).collect() == []


# ---- fingerprints


def plain_boundaries(raw):
    ends, start, h = [], 0, 0
    for i, byte in enumerate(raw):
        h = (h * 2 + int(fingerprints._GEAR[byte])) & 0xFFFFFFFF
        size, bits = i + 1 - start, 0
        if fingerprints.LEAST <= size < fingerprints.MOST:
            bits = fingerprints.HARD if size <= fingerprints.NORMAL else fingerprints.EASY
        if size == fingerprints.MOST or (bits and h >> (32 - bits) == 0) or i + 1 == len(raw):
            ends.append(i + 1)
            start = i + 1
    return ends


def test_boundaries_equal_a_byte_by_byte_hash(monkeypatch):
    rng = random.Random(1)
    texts = [b"", b"a", b"a" * 1000, bytes(rng.randrange(256) for _ in range(20_000)), " ".join(rng.choice(["eins", "zwei", "größe", "vier"]) for _ in range(3000)).encode()]
    for block in (50, 1 << 20):
        monkeypatch.setattr(fingerprints, "BLOCK", block)
        for raw in texts:
            for n in {len(raw), len(raw) // 3, min(len(raw), 13)}:
                assert fingerprints.boundaries(raw[:n]) == plain_boundaries(raw[:n])
    sizes = np.diff(fingerprints.boundaries(texts[3]))
    assert sizes.min() >= fingerprints.LEAST and sizes.max() <= fingerprints.MOST and 25 < sizes.mean() < 60


def test_chunks_resist_shifts_and_measure_containment():
    rng = random.Random(2)
    words = ["w%d" % rng.randrange(5000) for _ in range(4000)]
    text = " ".join(words)
    own = fingerprints.chunk_set(text)
    assert (fingerprints.read(fingerprints.written(own)) == own).all() and len(fingerprints.written(own)) == 8 * len(own)
    assert fingerprints.containment(own, fingerprints.chunk_set("put in front " + text)) > 0.99
    assert fingerprints.containment(own, fingerprints.chunk_set(text[:9000] + "a few words more" + text[9000:])) > 0.98
    part = fingerprints.chunk_set(text[5000:12_000])
    assert fingerprints.containment(part, own) > 0.95
    assert fingerprints.containment(own, fingerprints.chunk_set(" ".join("v%d" % rng.randrange(5000) for _ in range(4000)))) < 0.01
    none = fingerprints.chunk_set("")
    assert fingerprints.written(none) == "" and fingerprints.containment(none, none) == 1 and fingerprints.containment(none, own) == 0
    common = {int(x) for x in own} & {int(x) for x in part}
    assert fingerprints.containment(own, part) == sum(x & 255 for x in common) / min(sum(int(x) & 255 for x in s) for s in (own, part))


@pytest.mark.parametrize("rows_a_range", [1, 3, 1000])
def test_edited_documents_equal_a_plain_version(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", rows_a_range)
    rng = random.Random(4)
    rows = [(rng.randrange(-10**9, 10**15), rng.choice([None, "", "kurz", "é😀" * 40, " ".join("w%d" % rng.randrange(50) for _ in range(200)), "lang " * 20_000])) for _ in range(40)]
    rows += [(7, "b"), (7, "a"), (7, "a"), (None, "z"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("edited", F.lit(0)).withColumn("part", F.lit("x")).repartition(3)
    got = fingerprints.compare_edited(docs).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, text) in enumerate(order):
        other = order[(k + 1) % len(order)][1]
        changed = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        a, b, c = (fingerprints.chunk_set(t) for t in (text, changed, other))
        want.append((i, len(text), changed, fingerprints.written(a), fingerprints.written(b), fingerprints.containment(a, b), fingerprints.containment(a, c)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_fingerprints_of_single_rows_and_tables(spark):
    one = spark.createDataFrame([(1, "ein Text, der sich selbst folgt")], "doc_id bigint, text string")
    row = fingerprints.compare_edited(one).first()
    assert row.edited == "ein Text, der si" + "ein Text, der s" and row.near_next == 1.0
    assert fingerprints.compare_edited(one.limit(0)).collect() == []
    held = fingerprints.add(one, name="f")
    assert held.columns == ["doc_id", "text", "f"] and held.first().f == row.fingerprint
    with pytest.raises(ValueError):
        fingerprints.add(one, name="doc_id")
    pairs = spark.createDataFrame([(row.fingerprint, row.fingerprint), (None, row.fingerprint), (None, None)], "l string, r string")
    assert [r.containment for r in fingerprints.likeness(pairs, "l", "r").collect()] == [1.0, 0.0, 1.0]


def test_fingerprint_query_equals_a_plain_version(spark):
    import duckdb

    SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables aren't here")
    got = {r.doc_id: r for r in queries.op13_fingerprints(spark, SF).collect()}
    order = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY doc_id DESC").fetchall()
    assert len(got) == len(order)
    for k, (i, text) in enumerate(order):
        other = order[(k + 1) % len(order)][1]
        changed = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), sha(changed), fingerprints.written(fingerprints.chunk_set(text)), fingerprints.written(fingerprints.chunk_set(changed)))
        assert r.near_edited >= 0.25 or len(text) < 400
    assert np.mean([r.near_next for r in got.values()]) < 0.05


# ---- hard negatives


def plain_mine(rows, asked, positives=5, negatives=10):
    rows = [(i, label, [int(np.floor(256.0 * float(x))) for x in e]) for i, label, e in rows if None not in (i, label, e) and all(x is not None and np.isfinite(x) for x in e)]
    rows = [min(r for r in rows if r[0] == i) for i in sorted({r[0] for r in rows})]
    out = []
    for i, label, v in rows:
        if asked(i):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in rows if j != i)  # noqa: B905
            for s, j, _ in [x for x in scored if x[2] == label][:positives]:
                fit = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
                out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(65_536, 64, 128, 4_096), (7, 5, 3, 11)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK", "BLOCKS", "ANCHORS", "ROWS"), sizes, strict=True):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(160):  # coarse components make many equal scores; a third of all rows has one label, and a third one vector
        e = (rng.integers(-3, 4, 20) / 8 + (0.4 if i % 3 else 0)).tolist() if i % 3 else [0.5] * 20
        rows.append((i, 0 if i % 3 == 1 else int(rng.integers(0, 4)), e))
    odd = [None, [], [0.1, None], [float("nan")] * 20, [float("inf")] * 20, [0.3] * 7, [-0.5] * 20, [0.0] * 20]
    rows += [(200 + k, 1, e) for k, e in enumerate(odd)] + [(None, 1, [0.5] * 20), (230, None, [0.5] * 20), (10, 3, [0.25] * 20), rows[20], rows[20]]
    rows += [(240, 9, [0.4] * 20), (250, 8, [1e-3] * 20), (251, 8, [-1e-3] * 20)]
    table = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1)).repartition(4)
    got = negatives.mine(table, F.col("id") % 10 == 0)
    exact = [(i, label, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for i, label, e in rows]
    assert sorted(map(tuple, got.collect())) == plain_mine(exact, lambda i: i % 10 == 0)
    assert negatives.mine(table.limit(0), F.col("id") % 10 == 0).collect() == []
    assert negatives.mine(table, F.lit(False)).collect() == []


def test_bounds_let_pairs_go_early_and_keep_every_fit():
    rng = np.random.default_rng(6)
    import pyarrow as pa

    v = np.floor(256 * rng.normal(size=(300, 40)) * np.geomspace(1, 0.01, 40)).astype(np.int64) @ np.eye(40, dtype=np.int64)
    rows = pa.table({"id": np.arange(300), "label": np.zeros(300, np.int64), "v": v.tolist()})
    turn = negatives.axes(v.astype(float))
    assert np.allclose(turn.T @ turn, np.eye(40))
    t = negatives._Turned(rows, turn)
    exact = v @ v.T
    least = np.quantile(exact, 0.98, axis=1).astype(np.int64)
    i, j = negatives.survivors(t, slice(0, 300), t, slice(0, 300), least, np.full(300, np.inf), np.ones((300, 300), bool))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(exact >= least[:, None])), strict=True))
