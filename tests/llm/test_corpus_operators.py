"""Quality rules, toxicity, near-duplicates of texts and vectors, and the pipeline, against brute force on small tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from daymark.llm import minhash, quality, queries, toxicity, vectors
from daymark.llm.common import components

WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "se", "ra") for b in ("n", "rt", "ve", "sol", "pid", "gan", "mor", "x")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, q_kept string, _tox_score int, keys string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", 1, "y") for i, t, lang, s in rows], DOCS)


def plain_statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(w, w[1:], w[2:]))  # noqa: B905
    marked = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked)


def test_statistics_and_robust_outliers(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(60, 300)), "en", "a" if i % 3 else None) for i in range(300)]
    odd = [(1000 + i, " ".join(rng.choice("#*|$") * 3 + rng.choice(WORDS) for _ in range(120)), "en", "a") for i in range(12)]
    edge = [(2000, None, "en", "a"), (2001, "", None, None), (2002, "a b c " * 400, "en", "a"), (2003, "\n\n x\n x\n\t\x0b\n", "en", "a"), (None, prose(rng, 80), "en", "a"), (5, rows[5][1], "en", "a"), (2004, prose(rng, 60_000), "en", "a"), (2005, prose(rng, 70), "xx", "lone")]
    got = quality.verdicts(frame(spark, rows + odd + edge)).collect()
    assert len(got) == len(rows + odd + edge)
    texts = {i: t for i, t, *_ in rows + odd + edge}
    for r in got:
        want = plain_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[i] for i, *_ in odd) and not any(kept[i] for i in (2000, 2001, 2002, 2003)) and kept[2005] and kept[None]
    assert sum(kept[i] for i, *_ in rows) == len(rows)
    left = quality.filter_documents(frame(spark, rows + odd + edge))
    assert left.columns == [c.split()[0] for c in DOCS.split(", ")] and left.count() == sum(r.kept for r in got)
    assert quality.filter_documents(frame(spark, [])).count() == 0 and quality.verdicts(frame(spark, [])).count() == 0


def plain_search(x):
    """Mean and covariance of least determinant, by the same starts and steps in numpy."""
    floors = np.array(quality.FLOORS)
    low, centre, high = np.quantile(x, (0.25, 0.5, 0.75), axis=0)
    width = (high - low) / 1.349 + floors
    z = (x - centre) / width
    unit = z / np.sqrt(np.maximum((z * z).sum(1), 1e-6))[:, None]
    starts = [(centre, np.diag(width**2)), (x.mean(0), np.cov(x.T, bias=True) + np.diag(floors**2)), (centre, 4 * (unit.T @ unit / len(x)) * np.outer(width, width) + np.diag(floors**2))]

    def step(mean, cov):
        d = (np.linalg.solve(np.linalg.cholesky(cov), (x - mean).T) ** 2).sum(0)
        bins = np.floor(32 * np.log2(1 + d))
        near = x[bins <= np.quantile(bins, quality.KEEP)]
        return near.mean(0), quality.CONSISTENCY * np.cov(near.T, bias=True) + np.diag(floors**2)

    found = []
    for mean, cov in starts:
        for _ in range(quality.FIRST_STEPS):
            mean, cov = step(mean, cov)
        found.append((np.linalg.slogdet(cov)[1], mean, cov))
    best = min(found, key=lambda f: f[0])
    while (new := step(*best[1:])) and np.linalg.slogdet(new[1])[1] < best[0] - 1e-12:
        best = (np.linalg.slogdet(new[1])[1], *new)
    return best[1:]


def test_the_least_determinant_is_found_and_shrunk(spark):
    """Estimates of (lang, source), language and all equal the same search in numpy; the model is their weighted sum."""
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(60, 200)), "en", "a" if i % 3 else "b") for i in range(200)] + [(500 + i, "#" * rng.randint(1, 9) + prose(rng, 60), "en", "a") for i in range(20)] + [(600 + i, prose(rng, 90), "de", "a") for i in range(30)]
    measured = quality.measure(frame(spark, rows).select("text", F.col("lang").alias("q_lang"), F.col("source").alias("q_source")))
    points = [((r.q_lang, r.q_source), [r[f"q_{f}"] for f in quality.FEATURES]) for r in measured.where("NOT q_base_failed").collect()]
    matrix = lambda r: np.array([[r[f"p_c{max(i, j)}_{min(i, j)}"] for j in range(4)] for i in range(4)])
    mean = lambda r: np.array([r[f"p_m{i}"] for i in range(4)])
    found = {(r.level, r.q_lang, r.q_source): r for r in quality._searched(quality._levels(measured)).collect()}
    assert set(found) == {(0, "en", "a"), (0, "en", "b"), (0, "de", "a"), (1, "en", None), (1, "de", None), (2, None, None)}
    for (_, lang, source), r in found.items():
        x = np.array([v for k, v in points if lang in (None, k[0]) and source in (None, k[1])]) / quality.SCALE
        centre, cov = plain_search(x)
        assert np.allclose(mean(r), centre) and np.allclose(matrix(r), cov) and quality.KEEP * len(x) - 1 <= r.n <= len(x)
    for r in quality.fit(measured).collect():
        got = [(mean(found[2, None, None]), matrix(found[2, None, None]))]
        for key in ((1, r.q_lang, None), (0, r.q_lang, r.q_source)):
            w = found[key].n / (found[key].n + quality.PRIOR)
            got.append((w * mean(found[key]) + (1 - w) * got[-1][0], w * matrix(found[key]) + (1 - w) * got[-1][1]))
        low = np.array([[r[f"p_l{i}_{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
        assert np.allclose(mean(r), got[-1][0]) and np.allclose(low @ low.T, got[-1][1])


def test_sql_gives_the_same_rows(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randint(40, 300)) + rng.choice(["", "\nx y\nx y", " # $", " é\u00a0z"]), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i in range(120)]
    rows += [(500 + i, " ".join(rng.choice("#*|$") * 3 + rng.choice(WORDS) for _ in range(120)), "en", "a") for i in range(6)] + [(600, None, "en", "a"), (601, "", None, None), (602, "a b c " * 90, "xx", "a"), (None, prose(rng, 80), "en", "a"), (5, rows[5][1], "en", "a")]
    import duckdb

    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op9_quality_rules"](spark, str(tmp_path))
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = c.sql(queries.ORACLE_SQL["op9_quality_rules"])
        assert sorted(want.columns) == sorted(got.columns)
        assert sorted(map(str, want.select(", ".join(got.columns)).fetchall())) == sorted(str(tuple(r)) for r in got.collect())


def test_small_groups_are_judged_by_coarser_models(spark):
    """Every source has 5 documents; one language has 75, one 4, and one is null: junk goes in each of them."""
    rng = random.Random(8)
    junk = lambda: " ".join(rng.choice("#*|$") * 3 + rng.choice(WORDS) for _ in range(120))
    rows = [(i, prose(rng, rng.randint(60, 300)), "en" if i < 75 else "de" if i < 78 else None, f"s{i // 5}") for i in range(80)]
    odd = [(1000, junk(), "en", "s0"), (1001, junk(), "en", "only"), (1002, junk(), "de", "s15"), (1003, junk(), None, None)]
    got = {r.doc_id: r for r in quality.verdicts(frame(spark, rows + odd)).collect()}
    assert len(got) == 84 and not any(r.base_failed or r.distance is None for r in got.values())
    assert not any(got[i].kept for i, *_ in odd) and all(got[i].kept for i, *_ in rows)
    assert {r.doc_id for r in quality.filter_documents(frame(spark, rows + odd)).collect()} == {i for i, *_ in rows}
    one = quality.verdicts(frame(spark, rows[:1])).collect()
    assert one[0].kept and one[0].distance is not None


def test_repetition_and_duplicate_lines_alone_can_reject(spark):
    """49 % of words repeated and 48 of 50 lines duplicates, which pass the base rules; words as long as the others'."""
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(60, 300)), "en", "a") for i in range(100)]
    odd = (1000, "\n".join([prose(rng, 51), *["kasol"] * 49]), "en", "a")
    got = {r.doc_id: r for r in quality.verdicts(frame(spark, [*rows, odd])).collect()}
    assert (got[1000].n_words, got[1000].n_repeat_words, got[1000].n_dup_lines) == (100, 49, 48) and not got[1000].base_failed
    assert not got[1000].kept and all(got[i].kept for i, *_ in rows)
    assert math.isclose(math.exp(-quality.CUT / 2) * (1 + quality.CUT / 2), 1e-7, rel_tol=1e-4)


def test_toxicity_is_learnt_and_held_out(spark):
    rng = random.Random(3)
    bad = ["vilewort", "scumly", "grothead"]
    rows, marks = [], []
    for i in range(900):
        toxic = i % 4 == 0
        text = prose(rng, rng.randint(5, 120))
        rows.append((i, text + " " + rng.choice(bad) if toxic else text, ("en", "de", None)[i % 3], "a"))
        marks.append((i, int(toxic)))
    docs = frame(spark, rows + [(5000, None, "en", "a"), (5001, "", "en", "a"), (None, prose(rng, 30_000), "en", "a"), (1, rows[1][1], "en", "a")])
    labels = spark.createDataFrame([*marks, (None, 1), (7777, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 904 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = dict(marks)
    held = [r for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in truth]
    assert held and all(r.held_out for r in held) and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    left = toxicity.filter_documents(docs, labels)
    assert left.columns == docs.columns and 600 < left.count() < 700
    empty = labels.limit(0)
    assert {r.predicted for r in toxicity.score(docs.limit(20), toxicity.fit(docs, empty)).collect()} == {0}
    assert toxicity.filter_documents(docs.limit(0), labels).count() == 0


def groups(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert got == groups(ids, [(a, b) for a, b in links if a != b])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(5)
    errors = []
    for k in range(60):
        base = [rng.choice("ab") for _ in range(rng.randint(20, 300))]
        other = list(base)
        for _ in range(rng.randint(0, 8)):
            other[rng.randrange(len(other))] = f"z{k}"
        a, b = bag(" ".join(base)), bag(" ".join(other))
        true = sum((a & b).values()) / sum((a | b).values())
        s = minhash.signatures(*minhash.shingles([" ".join(base), "", " ".join(other)]))
        errors.append((s[0] == s[2]).mean() - true)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(30, 200))) for i in range(60)]
    passage = prose(rng, 60)
    rows += [(100 + i, passage + " " + prose(rng, 30)) for i in range(25)]  # alike, but not enough
    base = prose(rng, 150).split(" ")
    for i in range(40):  # near copies of one text
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((200 + i, " ".join(words)))
    rows += [(300, rows[3][1]), (301, rows[3][1].replace(" ", "  ")), (302, ""), (303, None), (304, " "), (305, "one two"), (306, "one two"), (307, "one"), (3, rows[3][1])]
    return rows


def plain_groups(rows):
    bags = [(i, t or "", bag(t)) for i, t in rows]
    links = []
    for k, (i, t, a) in enumerate(bags):
        for j, u, b in bags[:k]:
            common = sum((a & b).values())
            if t == u or (a and b and common >= 0.8 * (sum(a.values()) + sum(b.values()) - common)):
                links.append((i, j))
    return groups([i for i, _ in rows], links)


def test_near_duplicates_equal_brute_force(spark, copies):
    docs = frame(spark, [(i, t, "en", "a") for i, t in copies])
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.classes(docs).collect()}
    want = plain_groups(copies)
    assert {i: c for i, (c, _) in got.items()} == want
    assert {i for i, (c, k) in got.items() if k} == set(want.values())
    left = minhash.keep_one(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))
    assert minhash.keep_one(docs.limit(0)).count() == 0
    lone = frame(spark, [(None, "x y z", "en", "a"), (None, "x y z", "en", "a"), (None, "q", "en", "a"), (9, "x y z", "en", "a")])
    assert sorted(((r.doc_id, r.text) for r in minhash.keep_one(lone).collect()), key=str) == [(9, "x y z"), (None, "q")]


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "CELL_ROWS", 20)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((200, 16))
    near = [x[0] + rng.standard_normal(16) * 0.05 for _ in range(60)] + [x[1] + rng.standard_normal(16) * s for s in np.linspace(0.02, 0.3, 30)]
    all_ = [v.astype(np.float32).tolist() for v in [*x, *near]] + [x[2].astype(np.float32).tolist()] * 3 + [(x[3] * 5).astype(np.float32).tolist()]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0]]
    rows = [(i, v, 0, "e") for i, v in enumerate(all_ + odd)] + [(None, [3.0, -1.0, 7.0], 0, "e")]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, cells int, cls string")).collect()}
    assert len(got) == len(rows)
    u = np.array(all_)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    want = groups(range(len(all_)), list(zip(*map(list, np.nonzero(s)), strict=True)))
    found = np.array([got[i].n_links for i in range(len(all_))])
    assert (found <= s.sum(1)).all() and found.sum() >= 0.99 * s.sum()
    assert np.mean([got[i].component_id == want[i] for i in want]) > 0.99
    for i in [*range(len(all_), len(all_) + len(odd)), None]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_cells_that_are_split_lose_no_link(spark, monkeypatch):
    """Few cells of one k-means, so that they are split, twice; crowds of distinct near vectors among scattered ones."""
    for name, value in (("BLOCK", 64), ("CELL_ROWS", 20), ("BRANCH", 4), ("LARGE", 60), ("SPLIT_SAMPLE", 60), ("SPLIT", 6), ("DEAL", 32)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(11)
    far = rng.standard_normal((500, 32))
    crowd = np.concatenate([far[k] + rng.standard_normal((n, 32)) * 0.1 for k, n in ((0, 150), (1, 40), (2, 5))])
    x = np.concatenate([far, crowd]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert s.sum() > 10_000 and (found <= s.sum(1)).all() and found.sum() >= 0.999 * s.sum()
    want = groups(range(len(x)), list(zip(*map(list, np.nonzero(s)), strict=True)))
    assert np.mean([got[i].component_id == want[i] for i in want]) > 0.995


def test_links_equal_their_sql(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(12)
    x = rng.standard_normal((60, 8))
    near = [x[k % 7] + rng.standard_normal(8) * 0.06 for k in range(40)]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate([*x, *near])] + [(200, None), (201, []), (202, [0.0] * 8), (203, [float("nan")] * 8), (204, [None] + [1.0] * 7), (205, [1.0, 2.0]), (206, x[0].astype(np.float32).tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op1_embedding_dedup"](spark, str(tmp_path))
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = c.sql(queries.ORACLE_SQL["op1_embedding_dedup"]).select(", ".join(got.columns)).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in got.collect()) and sum(r[1] for r in want) > 50


def test_pipeline_runs_its_stages(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(60, 200)) + (" grothead" if i % 5 == 0 else "") + (" a.b@c.org" if i % 7 == 0 else ""), "en", "a") for i in range(200)]
    rows += [(900, rows[1][1], "en", "a"), (901, None, None, None), (902, "# * |" * 80, "en", "a")]
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    left = {r.doc_id: r for r in docs.collect()}
    assert not {900, 901, 902} & set(left) and sum(i % 5 == 0 for i in left) <= 3 and len(left) > 145
    assert "[EMAIL]" in left[7].text and "@" not in left[7].text and left[7].n_chars == len(left[7].text)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(left)


def test_pipeline_on_empty_tables_and_clashing_names(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, prose(rng, 80), "en", "a", 0, "x", 1.5) for i in range(30)] + [(5, None, None, None, None, None, None), (6, "", "en", "a", 0, "", 0.0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, _tox_score double"
    docs, labels = spark.createDataFrame(rows, schema), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, table in (("empty", docs.limit(0)), ("odd", docs)):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
    left = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, f"{tmp_path}/odd")
        assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == list(range(30))
