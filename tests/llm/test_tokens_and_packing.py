"""Token ids against the libraries, piece cutting, packing and its certificates, chat trees."""

import hashlib
import json
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from daymark.llm import chat, packing, sentences, tokens

BYTE_BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
BITS = ["a", "the", "'s", "don't", " ", " ", "\n", "\t", ".", ",", "é", "1", "23", "<|endoftext|>", "漢字", "🙂", " ", "--", "​", '"', "▁", "²", "\x1c", " "]


def mixed(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BYTE_BPE)
    t.encode_special_tokens = True
    return t


def test_byte_ids_are_the_library_s(library):
    texts = mixed(3000) + ["word, word. the end" * 500, ""]
    enc = tokens.Encoder(BYTE_BPE)
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(texts) == want


def test_long_runs_are_one_piece(library):
    n = tokens.LONG_RUN
    texts = ["a" + " " * n + "b", " " * 1_000_000, "x\n" + "\n" * n + "\ty", "\u3000" * n + " z" + " " * (n + 5), "ab" * n, " " * (n - 1) + "c", "\n" * n + " " + "d", "#" * n + " " * n]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tokens.Encoder(BYTE_BPE).encode(texts) == want


def test_added_tokens_are_the_library_s_by_default(tmp_path):
    texts = ["foo <|endoftext|> bar", "<|endoftext|>", "", "<|endoftext|><|endoftext|>\n a", "<<|endoftext|>>  <|endoftext|", *mixed(3000, 9)]
    plain = tokens.Encoder(BYTE_BPE)
    got = plain.encode(texts, added=True)
    assert got == [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(BYTE_BPE).encode_batch(texts, add_special_tokens=False)]
    assert np.frombuffer(got[0], "<u4").tolist() == [21943, 220, 50256, 2318]
    file = json.loads(Path(BYTE_BPE).read_text())
    kind = file["added_tokens"][0]
    for more in ([], [kind, kind | {"id": 50257, "content": "<|endoftext|>--"}], [kind | {"lstrip": True}]):
        (tmp_path / "t.json").write_text(json.dumps(file | {"added_tokens": more}))
        want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(str(tmp_path / "t.json")).encode_batch(texts, add_special_tokens=False)]
        assert tokens.Encoder(str(tmp_path / "t.json")).encode(texts, added=True) == want


def test_packing_counts_an_added_token_once(spark):
    texts = {1: "foo <|endoftext|> bar", 2: "<|endoftext|>" * 1500, 3: "x"}
    rows = packing.pack_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), BYTE_BPE).collect()
    first = Tokenizer.from_file(BYTE_BPE)
    for i, t in texts.items():
        ids = np.array([*first.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i) == [(s, n, zlib.crc32(ids[s : s + n].tobytes())) for s, n in packing.pieces(len(ids))]


def in_chunks(own, text, size):
    """Ids by matrices of chunks, their scan, and a trace in each chunk."""
    s, margin = sentences.written(text), own.longest
    windows = [(s[max(0, lo - margin) : lo + size + margin], min(lo, margin), min(len(s), lo + size) - max(0, lo - margin)) for lo in range(0, len(s), size)]
    at = sentences.settled([own.matrix(*w) for w in windows])
    return b"".join(own.trace(w, lo, hi, own.states(w, lo)[a], own.states(w, hi)[b]) for (w, lo, hi), a, b in zip(windows, at[:-1], at[1:], strict=True))


def test_paths_and_chunks_give_the_library_s_ids():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    own = sentences.Pieces(PIECES)
    more = ["ing", "represent", "ation", "  ", "\x00", "नमस्ते", "x" * 40, "=" * 20]
    rng = random.Random(1)
    texts = [*mixed(1000, 1), *("".join(rng.choice(BITS + more) for _ in range(30)) for _ in range(1000)), "one  two   three " * 300, " ".join(mixed(300, 2)), "x" * 3000, " " * 500 + "a"]
    for k, text in enumerate(texts):
        want = np.array(sp.encode(text), "<i4").tobytes()
        assert own.units(sentences.written(text)) == want, text[:60]
        if text:
            assert in_chunks(own, text, (2, 7, 40)[k % 3]) == want, text[:60]
            assert own.decode(np.frombuffer(want, "<i4")) == sp.decode(sp.encode(text))


def test_products_are_those_of_the_first_matrices():
    rng = np.random.default_rng(3)
    matrices = [rng.random((1 if k == 0 else 4, 4)) < 0.4 for k in range(11)]
    now = matrices[0]
    for k, got in enumerate(sentences.products(matrices)):
        now = now if k == 0 else now @ matrices[k]
        assert (got == now).all()


def test_round_trip_query(spark):
    long, run = "lorem ipsum dolor " * 3000, "abcdeégh" * 5000
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "a b"), (4, run)]
    got = sentences.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), PIECES).collect()
    assert len(got) == 6
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in got:
        text = {1: "", 2: "", 3: long, None: "a b", 4: run}[r.doc_id]
        ids = sp.encode(text)
        assert (r.n_tokens, r.ids_crc32, r.text_sha256) == (len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()), hashlib.sha256(text.encode()).hexdigest())
        assert (r.n_chunks > 1) == (r.doc_id in (3, 4))
    coded = sentences.encode(spark.createDataFrame(rows[:3], "doc_id long, text string"), PIECES)
    back = {}
    for r in sentences.decode(coded, PIECES).orderBy("row", "chunk").collect():
        back.setdefault(r.doc_id, []).append(r.text)
    assert {k: "".join(v) for k, v in back.items()} == {1: "", 2: "", 3: long}
    assert sentences.round_trip(spark.createDataFrame([], "doc_id long, text string"), PIECES).count() == 0


def test_pieces_cut_only_long_documents():
    assert packing.pieces(1024) == [(0, 1024)] and packing.pieces(5) == [(0, 5)]
    assert packing.pieces(1025) == [(0, 1), (1, 1024)] and packing.pieces(2048) == [(0, 1024), (1024, 1024)]


def exact_bins(lengths, capacity):
    best = [len(lengths)]
    lengths = sorted(lengths, reverse=True)

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + lengths[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


def test_bounds_never_exceed_the_best_packing():
    rng = random.Random(5)
    for _ in range(150):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        bound, best = packing.lower_bound(np.array(lengths), 30), exact_bins(lengths, 30)
        seq, offset, n = packing.best_fit_decreasing(np.array(lengths), 30)
        assert bound <= best <= n
        for s in range(n):
            own = sorted((o, x) for o, x, q in zip(offset, lengths, seq, strict=True) if q == s)
            assert [o for o, _ in own] == list(np.cumsum([0] + [x for _, x in own])[:-1]) and sum(x for _, x in own) <= 30


def test_packing_query(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "x"]) for _ in range(rng.randint(0, 900)))) for i in range(150)] + [(150, None), (None, ""), (7, "same"), (7, "same"), (151, "giant " * 5000)]
    rows = packing.pack_documents(spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, piece int, start string"), BYTE_BPE).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0] + [n for _, n in own])[:-1]) and sum(n for _, n in own) <= 1024
    for i, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        want = [(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.pieces(len(ids)))]
        assert own == sorted(want * (2 if texts.count((i, t)) == 2 else 1)) or i == 7
    bound = packing.lower_bound(np.array([r.length for r in rows]))
    assert bound <= len(by) <= 1.05 * bound + 2
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), BYTE_BPE).count() == 0


def test_partitions_with_a_gap_exchange_pieces(spark):
    """More pieces than a partition holds, of lengths that leave gaps: no piece is lost, and no sequence won."""
    rows = spark.range(90_000, numPartitions=4).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (150 + F.pmod(F.xxhash64("id"), F.lit(290))).alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    counts = {}
    for rounds in (1, 3):
        got = packing.pack(rows, rounds).toPandas()
        assert sorted(got["doc_id"]) == list(range(90_000))
        seq, offset, length = (got.sort_values(["sequence_id", "offset"])[c].to_numpy() for c in ("sequence_id", "offset", "length"))
        same = seq[1:] == seq[:-1]
        assert offset[0] == 0 and (offset[1:][~same] == 0).all() and (offset[1:][same] == (offset + length)[:-1][same]).all()
        assert set(seq >> 56) == {0, 1}.intersection(range(rounds))  # the second round packed what the first gave up
        assert (got.groupby("sequence_id")["length"].sum() <= packing.CAPACITY).all()
        counts[rounds] = got["sequence_id"].nunique()
        assert not got["certified"].all()
        full = got.groupby("sequence_id")["length"].sum() == packing.CAPACITY
        assert got.groupby("sequence_id")["certified"].all()[full].all()
    bound = packing.lower_bound(got["length"].to_numpy())
    assert bound <= counts[3] <= counts[1]


def test_escapes_are_reversible_and_leave_no_control_string():
    rng = random.Random(7)
    bits = ["<|", "|>", "\\", "</s>", "[INST]", "[/INST]", "<s>", "<", "|", ">", "l", "é", "\n", "<|end|>"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        out = chat.escape(text)
        assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL if c != "\\")


def digest(turns):
    learned = "".join(t or "" for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_chat_tree(spark):
    shared = [("user", "hello </s>[INST] ok"), ("assistant", "hi <|end|>\n")]
    told = {1: shared + [("user", "a")], 2: shared + [("user", "b"), ("assistant", "c\\l")], 3: shared + [("user", "a")], 4: [("system", None), ("user", "")], 5: [("user", "hello </s>[INST] ok")], None: [("assistant", "n")], 6: [(None, "x")]}
    rows = [(c, k, r, t, "z") for c, turns in told.items() for k, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string").repartition(5)
    nodes, members = chat.tree(df, BYTE_BPE)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(nodes, members, BYTE_BPE).collect()}
    assert got == {c: digest(t) for c, t in told.items()}
    own = nodes.collect()
    assert len(own) == len({tuple(t[: k + 1]) for t in told.values() for k in range(len(t))})  # shared turns once
    at = {n.key: n for n in own}
    order = sorted(own, key=lambda n: n.start)
    assert [n.start for n in order] == list(np.cumsum([0] + [len(n.ids) for n in order])[:-1])  # gapless
    for n in own:
        chain, p = [], n.parent
        while p:
            chain.append(p)
            p = at[p].parent
        assert n.position == sum(len(at[k].ids) for k in chain)
        assert {k.key for k in own if k.start <= n.start < k.subtree_end} == {*chain, n.key}  # ancestors and itself
    assert chat.read_back(*chat.tree(df.limit(0), BYTE_BPE), BYTE_BPE).count() == 0


def test_units_are_cut_where_no_piece_reaches_and_kept_in_two_halves(monkeypatch):
    from daymark.llm.queries import tokenizer_file

    path = tokenizer_file("piece_bpe_32k.model")
    sp, library = sentences.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(sentences, "WORDS", 40)
    rng = random.Random(3)
    words = ["house", "tree.", "ñandú", "www.a-b.com", "12,50%", "a\nb", "x\n\n", "…", "ﬁ²", "\U0001f600!", "it's", "&&&", "(no)", "..."]
    texts = [rng.choice(("", " ", "  ")).join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(sp.units(sentences.written(t)), "<i4").tolist() == library.encode(t), t
        assert len(sp.known) <= 20 and len(sp.before) <= 20
    fresh = sentences.Pieces(path)
    monkeypatch.setattr(sentences, "WORDS", 300_000)
    fresh.units(sentences.written("tree\nhouse"))
    assert {"▁tree", "\n", "house"} <= set(fresh.known)  # parts, for other units to use
