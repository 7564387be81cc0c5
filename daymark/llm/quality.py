"""Quality rules: word statistics per document and robust multivariate outliers, in DataFrame functions only.

A document's four features are compared with minimum-covariance-determinant estimates. For each (lang, source), each
language and all documents, three starts (quartile spreads, the plain covariance, the covariance of signs) take two
concentration steps each; the one with the least determinant goes on until its nearest KEEP documents no longer change.
A group's estimate is then shrunk towards its language's, and that towards the one of all documents, by the number of
documents that it rests on, so that groups of any size are judged by one formula. Distances are cut on a fine
logarithmic scale, so that every step is a partial aggregation and no group is sorted in one task. Features are whole
numbers (1/1024 steps) and so sums do not depend on order, and a step that changes no document ends the search exactly.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, save

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ("f_len", "f_sym", "f_rep", "f_dup")
#: Spread below which a feature's variation counts as none, in bits (log2): keeps covariances regular. Those of repetition and
#: duplicate lines let the two together pass CUT: (log2(51) / 1.2)^2 + (log2(101) / 1.2)^2 = 53.
FLOORS = (0.12, 1.0, 1.2, 1.2)
SCALE = 1024
KEEP = 0.75
#: Consistency of the covariance of the nearest 75 % for four dimensions: 0.75 / P(chi2_6 <= chi2_4 quantile 0.75).
CONSISTENCY = 1.48
#: Squared distance beyond which a document goes: the 1 - 1e-7 quantile of chi2 with four degrees of freedom.
CUT = 38.2396
#: Documents that an estimate's parent counts for when the two are put together.
PRIOR = 200
#: Concentration steps that every start takes; the best one goes on till it gets no less.
FIRST_STEPS = 2
#: Documents whose features one task reads in a step.
TASK_ROWS = 20_000
STARTS = ("spread", "plain", "sign")
_P = range(len(FEATURES))
_PAIRS = [(i, j) for i in _P for j in range(i + 1)]
_KEY = ("level", "q_lang", "q_source")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(sorted_windows, same) -> Column:
    """Words in windows that are the same as a neighbour of theirs among all windows, sorted; x.i is a window's first word."""
    hit = F.filter(sorted_windows, lambda x, k: same(x, k - 1) | same(x, k + 1))
    return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice.

    Windows are compared by a hash of their words; where two unequal ones share it, by their text.
    """

    def positions(w):
        return F.sequence(F.lit(0), F.size(w) - 3)

    def by_text(w):
        pairs = F.sort_array(F.transform(positions(w), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))))
        return _let(pairs, lambda s: _covered(s, lambda x, k: F.coalesce(F.get(s, k)["g"] == x["g"], F.lit(False))))

    def by_hash(w, hashes):
        def equal(i, j):
            return (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

        def count(s):
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            mixed = F.exists(F.transform(s, lambda x, k: same(x, k + 1) & ~F.coalesce(equal(x["i"], F.get(s, k + 1)["i"]), F.lit(True))), lambda x: x)
            return F.when(mixed, by_text(w)).otherwise(_covered(s, same))

        return _let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), count)

    def count(w):
        hashes = F.transform(positions(w), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return _let(hashes, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(by_hash(w, g)))

    return _let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(count(w)))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df and its text's statistics and features as columns q_*, names that df must not have itself. A null text has no words."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    df = df.select(
        "*", _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("r"))).alias("q_w"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("q_l"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("q_word_chars"), (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("q_n_symbols"),
    )
    df = df.select(
        "*", F.col("q_w.n").alias("q_n_words"), F.col("q_w.r").alias("q_n_repeat_words"), F.col("q_l.n").alias("q_n_lines"), F.col("q_l.d").alias("q_n_dup_lines"),
    ).drop("q_w", "q_l")
    ratio = lambda a, b, k: F.round(SCALE * (F.ln(1 + k * F.col(a) / F.greatest(F.col(b), F.lit(1))) / F.ln(F.lit(2.0)))).cast("long")
    return df.select(
        "*",
        ((F.col("q_n_words") < 50) | (100 * F.col("q_n_repeat_words") > 50 * F.col("q_n_words"))).alias("q_base_failed"),
        ratio("q_word_chars", "q_n_words", 1).alias("q_f_len"), ratio("q_n_symbols", "q_word_chars", 1000).alias("q_f_sym"),
        ratio("q_n_repeat_words", "q_n_words", 100).alias("q_f_rep"), ratio("q_n_dup_lines", "q_n_lines", 100).alias("q_f_dup"),
    )


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution through the Cholesky factor in columns p_l{i}_{j}."""
    ys: list[Column] = []
    for i, f in enumerate(FEATURES):
        rest = reduce(lambda a, b: a - b, [F.col(f"p_l{i}_{j}") * y for j, y in enumerate(ys)], F.col(f"q_{f}") / SCALE - F.col(f"p_m{i}"))
        ys.append(rest / F.col(f"p_l{i}_{i}"))
    return reduce(lambda a, b: a + b, [y * y for y in ys])


def _on(rows: DataFrame, other: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """rows joined with the rows of other that have the same keys, null ones being equal."""
    renamed = other.withColumnsRenamed({k: f"o_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(renamed[f"o_{k}"]) for k in keys])
    return rows.join(renamed, on, how).drop(*(f"o_{k}" for k in keys))


def _factored(df: DataFrame) -> DataFrame:
    """df with the Cholesky factor p_l of the covariance p_c, and p_det, the logarithm of its determinant."""
    for i, j in _PAIRS:
        less = reduce(lambda a, b: a - b, [F.col(f"p_l{i}_{k}") * F.col(f"p_l{j}_{k}") for k in range(j)], F.col(f"p_c{i}_{j}"))
        df = df.withColumn(f"p_l{i}_{j}", F.sqrt(F.greatest(less, F.lit(FLOORS[i] ** 2 / 4))) if i == j else less / F.col(f"p_l{j}_{j}"))
    return df.withColumn("p_det", reduce(lambda a, b: a + b, [2 * F.ln(f"p_l{i}_{i}") for i in _P]))


def _sums(prefix: str = "") -> list[Column]:
    x = [F.col(f"q_{f}") for f in FEATURES]
    return [F.count("*").alias(f"{prefix}n"), *(F.sum(x[i]).alias(f"{prefix}s{i}") for i in _P), *(F.sum(x[i] * x[j]).alias(f"{prefix}s{i}_{j}") for i, j in _PAIRS)]


def _estimate(df: DataFrame, consistency: float) -> DataFrame:
    """Mean and covariance columns from those of _sums(); the floors are added to the variances."""
    df = df.withColumns({f"p_m{i}": F.col(f"s{i}") / F.col("n") / SCALE for i in _P})
    cov = {
        f"p_c{i}_{j}": consistency * (F.col(f"s{i}_{j}") / F.col("n") / SCALE**2 - F.col(f"p_m{i}") * F.col(f"p_m{j}")) + (FLOORS[i] ** 2 if i == j else 0.0)
        for i, j in _PAIRS
    }
    return df.withColumns(cov)


_MODEL = ["n", *(f"p_m{i}" for i in _P), *(f"p_c{i}_{j}" for i, j in _PAIRS), *(f"p_l{i}_{j}" for i, j in _PAIRS), "p_det"]


def _starts(rows: DataFrame) -> DataFrame:
    """Per group the three starts: medians with quartile spreads, mean with covariance, medians with the covariance of signs.

    Quartiles are exact, from counts of the features' whole-number values. A sign is a document's direction from the
    medians, in units of the spreads; the mean of its products, times the spreads, is the covariance up to a factor.
    """
    values = rows.select(*_KEY, F.posexplode(F.array(*(F.col(f"q_{f}") for f in FEATURES))).alias("k", "v"))
    counts = values.groupBy(*_KEY, "k", "v").count()
    quartiles = counts.groupBy(*_KEY, "k").agg(F.expr("percentile(v, array(0.25, 0.5, 0.75), count)").alias("q"))
    pick = lambda i, at: F.max(F.when(F.col("k") == i, F.get("q", F.lit(at))))
    spread = quartiles.groupBy(*_KEY).agg(
        *(x for i, floor in enumerate(FLOORS) for x in ((pick(i, 1) / SCALE).alias(f"m{i}"), ((pick(i, 2) - pick(i, 0)) / SCALE / 1.349 + floor).alias(f"w{i}")))
    )
    spread = save(spread)
    z = [(F.col(f"q_{f}") / SCALE - F.col(f"m{i}")) / F.col(f"w{i}") for i, f in enumerate(FEATURES)]
    norm = F.greatest(reduce(lambda a, b: a + b, [a * a for a in z]), F.lit(1e-6))
    signs = [F.sum(F.round(z[i] * z[j] / norm * 2**20).cast("long")).alias(f"z{i}_{j}") for i, j in _PAIRS]
    got = save(_on(_on(rows, spread, _KEY).groupBy(*_KEY).agg(*_sums(), *signs), spread, _KEY))
    mean = {f"p_m{i}": F.col(f"m{i}") for i in _P}
    of_spread = got.withColumns(mean | {f"p_c{i}_{j}": F.col(f"w{i}") * F.col(f"w{i}") if i == j else F.lit(0.0) for i, j in _PAIRS})
    sign = {
        f"p_c{i}_{j}": len(FEATURES) * (F.col(f"z{i}_{j}") / F.col("n") / 2**20) * F.col(f"w{i}") * F.col(f"w{j}") + (FLOORS[i] ** 2 if i == j else 0.0) for i, j in _PAIRS
    }
    kinds = (of_spread, _estimate(got, 1.0), got.withColumns(mean | sign))
    parts = [_factored(x).select(*_KEY, F.lit(k).alias("start"), *_MODEL) for k, x in enumerate(kinds)]
    out = save(reduce(DataFrame.unionByName, parts))
    forget(spread, got)
    return out


def _step(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One concentration step: the nearest KEEP of each group and start give its next mean and covariance."""
    key = (*_KEY, "start")
    near = _on(rows, model, _KEY).withColumn("bin", F.floor(32 * (F.ln(1 + _distance()) / F.ln(F.lit(2.0)))).cast("int")).select(*key, "bin", *(f"q_{f}" for f in FEATURES))
    edge = near.groupBy(*key, "bin").count().groupBy(*key).agg(F.expr(f"percentile(bin, {KEEP}, count)").alias("edge"))
    got = _on(near, edge, key).where("bin <= edge").groupBy(*key).agg(*_sums())
    return save(_factored(_estimate(got, CONSISTENCY)).select(*key, *_MODEL))


def _least(models: DataFrame) -> DataFrame:
    """Of the estimates of each group the one of least determinant, an earlier start's or step's where they are equal."""
    cols = [c for c in models.columns if c not in _KEY]
    best = models.groupBy(*_KEY).agg(F.min_by(F.struct(*cols), F.struct("p_det", "start")).alias("x"))
    return save(best.select(*_KEY, "x.*"))


def _searched(rows: DataFrame) -> DataFrame:
    """Per group the estimate of least determinant: all starts take FIRST_STEPS, the best one goes on while any group's gets less.

    A group's determinants fall and it has finitely many sets of nearest documents, so the search ends by itself.
    """
    model = _starts(rows)
    for _ in range(FIRST_STEPS):
        new = _step(rows, model)
        forget(model)
        model = new
    best = _least(model)
    forget(model)
    for k in count():
        new = _step(rows, best)
        less = _least(best.unionByName(new.withColumn("start", F.lit(len(STARTS) + k))))
        settled = less.where(F.col("start") == len(STARTS) + k).isEmpty()
        forget(best, new)
        best = less
        if settled:
            break
    return best


_SHARED = [*(f"p_m{i}" for i in _P), *(f"p_c{i}_{j}" for i, j in _PAIRS)]


def _shrunk(own: DataFrame, above: dict[str, Column]) -> DataFrame:
    """Estimates put together with their parents', columns of own too: a mean weighted by the documents of the one and PRIOR."""
    w = F.col("n") / (F.col("n") + PRIOR)
    return own.select("q_lang", "q_source", *((w * F.col(c) + (1 - w) * above[c]).alias(c) for c in _SHARED))


def _levels(measured: DataFrame) -> DataFrame:
    """Features of every document that passes the base rules, once for its (lang, source), its language and all documents."""
    base = measured.where(~F.col("q_base_failed"))
    features = [f"q_{f}" for f in FEATURES]

    def level(k, *own):
        keys = (F.col(c) if c in own else F.lit(None).cast(base.schema[c].dataType) for c in _KEY[1:])
        return F.struct(F.lit(k).alias("level"), *(x.alias(c) for x, c in zip(keys, _KEY[1:], strict=True)))

    groups = F.array(level(0, "q_lang", "q_source"), level(1, "q_lang"), level(2))
    return base.select(F.explode(groups).alias("g"), *features).select("g.*", *features)


def fit(measured: DataFrame) -> DataFrame:
    """The model: a row per (q_lang, q_source) of measured with a document that passes the base rules; an empty one of an empty table."""
    features = measured.select("q_lang", "q_source", "q_base_failed", *(f"q_{f}" for f in FEATURES))
    # each step reads these few columns again: from few files, as many as a task should read rows
    features = save(features.coalesce(max(1, measured.count() // TASK_ROWS)))
    found = _searched(_levels(features))
    at = lambda k: found.where(F.col("level") == k)
    top = at(2).first()  # one row
    languages = _shrunk(at(1), {c: F.lit(top[c] if top else 0.0) for c in _SHARED})
    named = languages.select("q_lang", *(F.col(c).alias(f"a_{c}") for c in _SHARED))
    out = save(_factored(_shrunk(_on(at(0), named, ("q_lang",)), {c: F.col(f"a_{c}") for c in _SHARED})))
    forget(found, features)
    return out


def judge(measured: DataFrame, model: DataFrame) -> DataFrame:
    """measured with q_distance (null where its group has no document that passes the base rules) and q_kept."""
    out = _on(measured, model, ("q_lang", "q_source"), "left").withColumn("q_distance", _distance())
    out = out.drop(*(c for c in model.columns if c.startswith("p_")))
    return out.withColumn("q_kept", F.coalesce(~F.col("q_base_failed") & (F.col("q_distance") <= CUT), F.lit(False)))


def _measured(docs: DataFrame, kept: Column, text: str, lang: str, source: str) -> DataFrame:
    """Every text measured once, into the shared folder: kept as `row`, language, source, statistics."""
    rows = docs.select(kept.alias("row"), F.col(f"`{lang}`").alias("q_lang"), F.col(f"`{source}`").alias("q_source"), F.col(f"`{text}`").alias("q_text"))
    return save(measure(rows, "q_text").drop("q_text"))


def filter_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that the rules keep, with the columns they came with.

    Null or empty text fails the base rules; null languages and sources are groups of their own; an empty table
    gives an empty one; repeated rows each get the verdict of their text; columns may have any names and types.
    """
    measured = _measured(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)), text, lang, source)
    return judge(measured, fit(measured)).where("q_kept").select("row.*")


def verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """A row per document: doc_id, statistics, base_failed, kept, and the squared distance.

    Null or empty text has no words and fails the base rules; a very long one is measured whole; null languages and
    sources are groups of their own; an empty table gives an empty one; repeated rows and null ids each give a row;
    columns may have any other names. The distance is null for groups of which no document passes the base rules.
    """
    stats = _measured(docs, F.col(f"`{doc_id}`"), text, lang, source)
    return judge(stats, fit(stats)).select(
        F.col("row").alias("doc_id"), *(F.col(f"q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"), F.col("q_distance").alias("distance"),
    )
