"""Token ids of whole texts as little-endian unsigned 32-bit bytes, for a byte-level BPE vocabulary of the tokenizers library.

A byte-level BPE never merges across a blank that starts a pre-token, so a text is cut at its blanks and each piece is
looked up in a cache; a new piece is encoded by the same ranks in tiktoken: one of letters, or of letters and a mark at
their end, is one or two pre-tokens and needs no pattern. Texts for which a cut at a blank isn't
surely a pre-token border (runs of white space) or that spell a special token go to the tokenizers library whole, and
so does everything if the two libraries don't agree on the vocabulary's probes.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cached pieces a process; beyond it new pieces are encoded each time.
CACHE = 300_000
MARKS = ".,;:!?"
SPACE = r"[\t\n\x0b\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PROBES = ["", " ", "a", "Hello  world\n\n \tx", "don't we'll 'tis '' 's", " naïve café 12345 № ½ Ω漢字​!", "…—“x” a b", "\x00\x01 ퟿\U0001f600\U0001f600", "ſ'S _x_ #!?.. \r\n end \n", "thinntoush éauxçelle größe"]
_encoders: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str | None = None) -> "Encoder":
    """The process's encoder of that vocabulary file."""
    path = path or default_path()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        special = [x["content"] for x in described.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.unsure = "|".join([f"{SPACE} {SPACE}", f"{SPACE} $", *map(re.escape, special)])
        self.cache: dict[str, bytes] = {}
        self.fast = self._ranks(described)
        if self.fast:
            self.single = self.fast.__self__._core_bpe.encode_single_piece
            self.marks = {x: _bytes(self.single(x.encode())) for x in MARKS}

    def _ranks(self, described: dict):
        import tiktoken

        alphabet = _byte_alphabet()
        try:
            ranks = {bytes(alphabet[c] for c in k): v for k, v in described["model"]["vocab"].items() if not (self.special and self.special.fullmatch(k))}
            fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            same = all(fast.encode_ordinary(x) == self.whole.encode(x, add_special_tokens=False).ids for x in PROBES)
        except (KeyError, ValueError):
            return None
        return fast.encode_ordinary if same else None

    def _slow(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, column: pa.Array) -> list[bytes]:
        """The ids of each text; null is empty. A word of the batch is looked up once, and the ids are put together by number."""
        column = column.cast(pa.string()).fill_null("")
        whole = pc.match_substring_regex(column, self.unsure).to_numpy(zero_copy_only=False).astype(bool) if self.fast else np.ones(len(column), bool)
        out = [b""] * len(column)
        for i in np.flatnonzero(whole).tolist():
            out[i] = self._slow(column[i].as_py())
        sure = np.flatnonzero(~whole & (pc.binary_length(column).to_numpy() > 0))
        if not len(sure):
            return out
        pieces = pc.split_pattern(column.take(pa.array(sure)), " ")
        ends = pieces.offsets.to_numpy().astype(np.int64)
        words = pieces.values.dictionary_encode()
        known, cache = words.dictionary.to_numpy(zero_copy_only=False).tolist(), self.cache
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = [known[i] for i in codes[ends[:-1]].tolist()]  # no blank before it
        codes[ends[:-1]] = np.arange(len(known), len(known) + len(first))
        found = [cache.get(x) for x in known]
        entries = [*(self._piece(x) if y is None else y for x, y in zip(known, found, strict=True)), *(_bytes(self.fast(x)) for x in first)]
        sizes = np.array([len(x) >> 2 for x in entries], np.int64)
        starts = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join(entries), "<u4")
        n = sizes[codes]
        done = np.concatenate(([0], np.cumsum(n)))
        ids = ids[np.repeat(starts[codes] - done[:-1], n) + np.arange(done[-1])]
        borders = done[ends].tolist()
        for i, a, z in zip(sure.tolist(), borders, borders[1:], strict=False):
            out[i] = ids[a:z].tobytes()
        return out

    def _piece(self, word: str) -> bytes:
        """The ids of a blank and the word."""
        cache = self.cache
        if word.isalpha():
            out = _bytes(self.single(b" " + word.encode()))
        elif word and word[-1] in self.marks and word[:-1].isalpha():
            out = (cache.get(word[:-1]) or self._piece(word[:-1])) + self.marks[word[-1]]
        else:
            out = _bytes(self.fast(" " + word))
        if len(cache) < CACHE:
            cache[word] = out
        return out
