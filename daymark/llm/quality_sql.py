"""The quality rules in DuckDB's SQL, written out from the same constants as the DataFrame plan.

The plan stops where no group's estimate gets less; a step more then changes nothing, so the SQL takes all steps.
"""

from __future__ import annotations

from .quality import CONSISTENCY, CUT, FIRST_STEPS, FLOORS, KEEP, PRIOR, SCALE, STARTS

#: Steps that the statement writes out behind the first ones: more than the tables that the driver compares need to settle (a test says so).
WRITTEN_STEPS = 12

_P = range(len(FLOORS))
_PAIRS = [(i, j) for i in _P for j in range(i + 1)]
_X = ", ".join(f"x{i}" for i in _P)
_M = ", ".join(f"m{i}" for i in _P)
_C = ", ".join(f"c{i}_{j}" for i, j in _PAIRS)
_L = ", ".join(f"l{i}_{j}" for i, j in _PAIRS)
_MODEL = f"lv, la, so, st, n, {_M}, {_C}, {_L}, det"


def _same(a: str, b: str, *keys: str) -> str:
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)


def _distance() -> str:
    """Columns y0.. (each may use those before it) and the sum of their squares."""
    ys = [f"(x{i} / {SCALE}.0 - m{i}{''.join(f' - l{i}_{j} * y{j}' for j in range(i))}) / l{i}_{i} AS y{i}" for i in _P]
    return ", ".join(ys) + ", " + " + ".join(f"y{i} * y{i}" for i in _P) + " AS d2"


def _factor() -> str:
    cols = []
    for i, j in _PAIRS:
        less = f"c{i}_{j}" + "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
        cols.append(f"sqrt(greatest({less}, {FLOORS[i] ** 2 / 4!r}::DOUBLE)) AS l{i}_{j}" if i == j else f"({less}) / l{j}_{j} AS l{i}_{j}")
    return ", ".join(cols) + ", " + " + ".join(f"2 * ln(l{i}_{i})" for i in _P) + " AS det"


def _estimate(consistency: float) -> str:
    """Mean and covariance columns from sums s*; n is their number."""
    means = [f"s{i} / n / {SCALE} AS m{i}" for i in _P]
    covs = [f"{consistency!r}::DOUBLE * (s{i}_{j} / n / {SCALE**2} - m{i} * m{j}) + {FLOORS[i] ** 2 if i == j else 0.0!r}::DOUBLE AS c{i}_{j}" for i, j in _PAIRS]
    return ", ".join(means + covs)


_SUMS = ", ".join(["count(*)::DOUBLE AS n", *(f"sum(x{i})::DOUBLE AS s{i}" for i in _P), *(f"sum(x{i} * x{j})::DOUBLE AS s{i}_{j}" for i, j in _PAIRS)])


def _step(k: int, rows: str, model: str) -> list[str]:
    near = f"near{k} AS MATERIALIZED (SELECT lv, la, so, st, {_X}, floor(32 * (ln(1 + d2) / ln(2.0::DOUBLE))) AS bin FROM (SELECT r.*, m.st, {_distance()} FROM {rows} r JOIN {model} m ON {_same('r', 'm', 'lv', 'la', 'so')}))"
    edge = f"edge{k} AS (SELECT lv, la, so, st, quantile_cont(bin::DOUBLE, {KEEP}) AS edge FROM near{k} GROUP BY ALL)"
    sums = f"sums{k} AS (SELECT r.lv, r.la, r.so, r.st, {_SUMS} FROM near{k} r JOIN edge{k} e ON {_same('r', 'e', 'lv', 'la', 'so', 'st')} WHERE bin <= edge GROUP BY ALL)"
    new = f"new{k} AS MATERIALIZED (SELECT {_MODEL} FROM (SELECT *, {_factor()} FROM (SELECT *, {_estimate(CONSISTENCY)} FROM sums{k})))"
    return [near, edge, sums, new]


def _least(name: str, source: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT {_MODEL} FROM ({source}) QUALIFY row_number() OVER (PARTITION BY lv, la, so ORDER BY det, st) = 1)"


def _mixed(own: str, above) -> str:
    w = f"({own}.n / ({own}.n + {PRIOR}))"
    return ", ".join(f"{w} * {own}.{c} + (1 - {w}) * {above(c)} AS {c}" for c in (_M + ", " + _C).split(", "))


def sql() -> str:
    blanks, symbols = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)", "'#*$%&|<>'"
    feature = lambda a, b, k: f"round({SCALE} * (ln(1 + {k} * {a} / greatest({b}, 1)) / ln(2.0::DOUBLE)))::BIGINT"
    z = [f"(x{i} / {SCALE}.0 - q.m{i}) / q.w{i} AS z{i}" for i in _P]
    signs = ", ".join(f"sum(round(z{i} * z{j} / nz * 1048576)::BIGINT)::DOUBLE AS z{i}_{j}" for i, j in _PAIRS)
    spread_c = ", ".join(f"w{i} * w{i} AS c{i}_{j}" if i == j else f"0.0::DOUBLE AS c{i}_{j}" for i, j in _PAIRS)
    sign_c = ", ".join(f"{len(FLOORS)} * (z{i}_{j} / n / 1048576) * w{i} * w{j} + {FLOORS[i] ** 2 if i == j else 0.0!r}::DOUBLE AS c{i}_{j}" for i, j in _PAIRS)
    kinds = [(f"{_M}, {spread_c}", "sp"), (_estimate(1.0), "pl"), (f"{_M}, {sign_c}", "si")]
    sums_only = ", ".join(["lv, la, so, n", *(f"s{i}" for i in _P), *(f"s{i}_{j}" for i, j in _PAIRS)])
    ctes = [
        "d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents)",
        r"w AS MATERIALIZED (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d)",
        "g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3))",
        "hit AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1)",
        "rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY r)",
        f"ln_ AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT x) AS d FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE translate(x, {blanks}, '') <> '' GROUP BY r)",
        f"""s AS MATERIALIZED (SELECT *, {feature("word_chars", "n_words", 1)} AS x0, {feature("n_symbols", "word_chars", 1000)} AS x1, {feature("n_repeat_words", "n_words", 100)} AS x2, {feature("n_dup_lines", "n_lines", 100)} AS x3,
            n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
            SELECT d.r, doc_id, lang AS la, source AS so, len(w.w)::BIGINT AS n_words, length(translate(t, {blanks}, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, {symbols}, '')))::BIGINT AS n_symbols,
            coalesce(ln_.n, 0)::BIGINT AS n_lines, coalesce(ln_.d, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN ln_ USING (r)))""",
        f"x AS MATERIALIZED (SELECT 0 AS lv, la, so, {_X} FROM s WHERE NOT base_failed UNION ALL SELECT 1, la, NULL, {_X} FROM s WHERE NOT base_failed UNION ALL SELECT 2, NULL, NULL, {_X} FROM s WHERE NOT base_failed)",
        "q AS MATERIALIZED (SELECT lv, la, so, " + ", ".join(f"quantile_cont(x{i}::DOUBLE, 0.5) / {SCALE} AS m{i}, (quantile_cont(x{i}::DOUBLE, 0.75) - quantile_cont(x{i}::DOUBLE, 0.25)) / {SCALE} / 1.349::DOUBLE + {f!r}::DOUBLE AS w{i}" for i, f in enumerate(FLOORS)) + " FROM x GROUP BY ALL)",
        f"zs AS (SELECT x.lv, x.la, x.so, {_X}, {', '.join(z)}, greatest({' + '.join(f'z{i} * z{i}' for i in _P)}, 1e-6::DOUBLE) AS nz FROM x JOIN q ON {_same('x', 'q', 'lv', 'la', 'so')})",
        f"t0 AS MATERIALIZED (SELECT lv, la, so, {_SUMS}, {signs} FROM zs GROUP BY ALL)",
        f"t1 AS MATERIALIZED (SELECT t0.*, {', '.join(f'q.m{i}, q.w{i}' for i in _P)} FROM t0 JOIN q ON {_same('t0', 'q', 'lv', 'la', 'so')})",
        "start AS MATERIALIZED ("
        + " UNION ALL ".join(f"SELECT {_MODEL} FROM (SELECT *, {k} AS st, {_factor()} FROM (SELECT lv, la, so, n, {cols} FROM {f'(SELECT {sums_only} FROM t1)' if tag == 'pl' else 't1'}))" for k, (cols, tag) in enumerate(kinds))
        + ")",
    ]
    model = "start"
    for k in range(FIRST_STEPS):
        ctes += _step(k, "x", model)
        model = f"new{k}"
    ctes.append(_least("best0", f"SELECT * FROM {model}"))
    for k in range(WRITTEN_STEPS):
        ctes += _step(FIRST_STEPS + k, "x", f"best{k}")
        ctes.append(_least(f"best{k + 1}", f"SELECT * FROM best{k} UNION ALL SELECT * REPLACE ({len(STARTS) + k} AS st) FROM new{FIRST_STEPS + k}"))
    best = f"best{WRITTEN_STEPS}"
    ctes += [
        f"languages AS (SELECT o.la, {_mixed('o', lambda c: f'a.{c}')} FROM {best} o JOIN {best} a ON a.lv = 2 WHERE o.lv = 1)",
        f"model AS MATERIALIZED (SELECT *, {_factor()} FROM (SELECT o.la, o.so, {_mixed('o', lambda c: f'a.{c}')} FROM {best} o JOIN languages a ON {_same('o', 'a', 'la')} WHERE o.lv = 0))",
        f"judged AS (SELECT s.*, {_distance()} FROM s LEFT JOIN model m ON {_same('s', 'm', 'la', 'so')})",
    ]
    return f"WITH {', '.join(ctes)} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(NOT base_failed AND d2 <= {CUT}, false) AS kept FROM judged"
