"""Token ids of whole texts by a byte-level BPE tokenizer.

The merges run in a second library over the vocabulary of the same file, which takes a fraction of the first one's time;
tests hold the ids against the first. Texts can be cut at the contents of the file's added tokens, each being one id, as
the first library does unless told otherwise.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np

#: Fixed values of byte-level BPE: how it splits texts, and the characters that stand for bytes in its file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: White space in a row from which on it is cut out of a text: the splitting pattern fails on runs of a million.
LONG_RUN = 50_000
_RUN = re.compile(f"[{_WHITE}]{{{LONG_RUN},}}")


class Encoder:
    """path: the tokenizer's JSON file. encode(texts) gives each text's ids as little-endian unsigned 32-bit numbers.

    With added, contents of the file's added tokens are one id each; without, they are text like any other.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        rest = (256 + n for n in range(256))
        byte_of = {chr(b): b for b in _SHOWN} | {chr(next(rest)): b for b in range(256) if b not in _SHOWN}
        ranks = {bytes(byte_of[c] for c in w): i for w, i in model["vocab"].items() if all(c in byte_of for c in w)}
        merged = len(model["merges"]) + 256
        self.bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={w: i for w, i in ranks.items() if i < merged}, special_tokens={})
        tokens = file.get("added_tokens") or []
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in tokens}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        # those that take blanks with them, or are sought in whole words or in changed text, are left to the first library
        self.first = path if any(t["lstrip"] or t["rstrip"] or t["single_word"] or (t["normalized"] and file["normalizer"]) for t in tokens) else None

    def _around(self, texts: list[str]) -> list[bytes]:
        """Ids of texts with each added token as one id."""
        if self.first:
            from tokenizers import Tokenizer

            return [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(self.first).encode_batch(texts, add_special_tokens=False)]
        parts = [self.cuts.split(t) for t in texts]  # text and token by turns
        ids = iter(self.encode([x for p in parts for x in p[::2]]))
        return [b"".join(self.added[x] if k % 2 else next(ids) for k, x in enumerate(p)) for p in parts]

    def encode(self, texts: list[str], added: bool = False) -> list[bytes]:
        if added and self.added:
            return self._around(texts)
        run = self.bpe.encode_ordinary
        return [array("I", run(t)).tobytes() if len(t) < LONG_RUN else self._long(t) for t in texts]

    def _long(self, text: str) -> bytes:
        """A long text's ids; a run of white space is one piece but for its last character, which goes with what follows."""
        out, done = array("I"), 0
        for m in _RUN.finditer(text):
            end = m.end() - (m.end() < len(text))
            out.extend(self.bpe.encode_ordinary(text[done : m.start()]))
            out.extend(self.bpe._encode_single_piece(text[m.start() : end].encode()))
            done = end
        out.extend(self.bpe.encode_ordinary(text[done:]))
        return out.tobytes()


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """A worker's encoder, kept between tasks."""
    return Encoder(path)
