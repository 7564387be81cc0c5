"""Fill-in-middle transformation: texts cut at two drawn places of a token sequence and put in the order that trains infilling.

Tokens are the matches of TOKEN. The tokenizers library's Split pre-tokenizer, isolating each match, gives their
code-point offsets without any training: the length of the offset array is n, and the offsets at the two drawn ranks
bound prefix, middle and suffix. The draws are digits of a digest of the document's id, so a lost task repeats them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

TOKEN = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Of 100 documents so many are transformed, and of 100 of these so many have their suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Characters that are pre-tokenized at once: offsets of longer texts are gathered window by window.
WINDOW = 65_536
_OTHER = re.compile("[^A-Za-z]")


@cache
def _encode():
    """The pre-tokenizer behind an empty vocabulary: of an encoding only offsets are used, and only those asked for become Python's."""
    from tokenizers import Regex, Tokenizer, models
    from tokenizers.pre_tokenizers import Split

    bare = Tokenizer(models.WordLevel({"any": 0}, unk_token="any"))
    bare.pre_tokenizer = Split(Regex(TOKEN), "isolated")
    return lambda text: bare.encode(text, add_special_tokens=False)


def _windows(text: str):
    """(begin, end) of pieces of a text that are pre-tokenized by themselves.

    A text longer than WINDOW is cut behind a character that is no letter, where a token ends whatever follows; a run
    of letters longer than that stays whole.
    """
    at = 0
    while at < len(text):
        to = at + WINDOW
        if to < len(text):
            back = next((i for i in range(to, at, -1) if _OTHER.match(text[i - 1])), None)
            ahead = None if back else _OTHER.search(text, to)
            to = back or (ahead.end() if ahead else len(text))
        yield at, min(to, len(text))
        at = to


def token_ends(text: str) -> np.ndarray:
    """Code-point offset at which each token ends, rising; empty for an empty text."""
    parts = [np.array([end for _, end in _encode()(text[a:b]).offsets], np.int64) + a for a, b in _windows(text)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _cut(text: str, a: int, b: int) -> tuple[int, int, int]:
    """(n, code points before the middle, code points before the suffix) for the drawn numbers a and b.

    Of a text of several windows only their numbers of tokens are kept, and the windows of the two places are asked again.
    """
    spans, upto, last = [], [0], None
    for span in _windows(text):
        last = _encode()(text[span[0] : span[1]])
        spans.append(span)
        upto.append(upto[-1] + len(last))
    n = upto[-1]

    def end(rank: int) -> int:
        if rank == 0:
            return 0
        k = bisect_left(upto, rank) - 1
        held = last if k == len(spans) - 1 else _encode()(text[spans[k][0] : spans[k][1]])
        return spans[k][0] + held.token_to_chars(rank - upto[k] - 1)[1]

    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    return n, end(lo), end(hi)


def draws(doc_id: Column, salt: str) -> list[Column]:
    """Four numbers (long) from the digest of the salt and the id; a null id is read as no digits."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salt: str = "1:", rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """A row per row: doc_id, n (tokens), form (plain, psm, spm), prefix_chars, middle_chars, output.

    A null text is read as empty. Empty texts, texts that hold a mark, and 100 - rate of 100 others are plain: output
    is the text, and the two lengths are null. Texts of any length are cut whole. Rows with the same id and text get
    the same output, as all rows of one id have the same draws; a null id draws like an id without digits. Other
    columns are left out, so none can clash. An empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), salt)
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    drawn = rows.select("doc_id", "text", form.alias("form"), h1.alias("a"), h2.alias("b"))
    return map_rows(drawn, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string", _transformed)


def _transformed(rows: dict) -> list:
    out = []
    for key, text, form, a, b in zip(rows["doc_id"], rows["text"], rows["form"], rows["a"], rows["b"], strict=True):
        n, lo, hi = _cut(text, a, b)
        prefix, middle, suffix = text[:lo], text[lo:hi], text[hi:]
        if form == "plain":
            out.append((key, n, form, None, None, text))
        elif form == "psm":
            out.append((key, n, form, lo, hi - lo, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"))
        else:
            out.append((key, n, form, lo, hi - lo, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"))
    return list(zip(*out, strict=True))


def restored(form: Column, output: Column) -> Column:
    """The text that a row of transform() was made of.

    Slices hold no mark and no mark begins as another ends, so the first of each mark behind the opening one is its own.
    """

    def parts(inner: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
        first = F.substring_index(body, inner, 1)
        rest = F.substring(body, F.length(first) + len(inner) + 1, F.length(body))
        second = F.substring_index(rest, MIDDLE, 1)
        return first, second, F.substring(rest, F.length(second) + len(MIDDLE) + 1, F.length(rest))

    prefix, suffix, middle = parts(SUFFIX)
    suffix_, prefix_, middle_ = parts(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)


#: SQL of the contract's columns: tokens, draws and slices by lists and digests.
SQL = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
  w AS MATERIALIZED (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN [0, 1, 2, 3]] AS d FROM t),
  c AS (SELECT *, len(u)::BIGINT AS n, least(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS lo, greatest(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 90 THEN 'plain' WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM w),
  s AS (SELECT *, array_to_string(u[1:lo], '') AS prefix, array_to_string(u[lo + 1:hi], '') AS middle, array_to_string(u[hi + 1:], '') AS suffix FROM c)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(prefix || middle || suffix) AS restored_sha256 FROM s"""
