"""BPE encoding and decoding by dynamic programming over the prefixes of a word."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizers' files; a parameter of everything that reads one.
TOKENIZERS = "/opt/tokenizers"
FILE = "word_bpe_49k.json"
#: Distinct words that a worker remembers before it starts anew.
REMEMBERED = 300_000

_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"  # as a class of a pattern has it
# Fixed values of the tokenizers library: it has the letters and digits of Unicode 16; these code points became letters or digits later.
_NEWER = """
    558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7
    10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6
    187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81
    1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e
    2cea2-2cead 323b0-33479 3d000-3fc3f
"""
# Small letters that it knows and Python's tables don't.
_SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_END = "\ue000"  # stands for the end of a word inside this module


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [chars[b] for b in range(256)]


class WordBPE:
    """Ids and token strings of texts under a vocabulary whose ids follow the order of its merges.

    For each prefix of a word the one token is kept that ends the prefix's encoding. It is found among the vocabulary's
    tokens that end there (an automaton of the vocabulary, whose suffix links list them) as the one that the kept token
    of the prefix before it can stand beside; the encoding is then read off backwards. No merge is ever carried out.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        own = lambda s: s[: -len(suffix)] + _END if s.endswith(suffix) else s
        self.ids = {own(s): i for s, i in model["vocab"].items()}
        self.text = {i: s for s, i in model["vocab"].items()}
        self.bases = len(model["vocab"]) - len(model["merges"])
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            token, halves = model["vocab"][left + right], (model["vocab"][left], model["vocab"][right])
            if token != self.bases + rank:
                raise ValueError("ids don't follow the order of the merges")
            self.halves[token] = halves
            self.merged[halves] = token
        self.ending = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.ending.add_word(s, (len(s), i))
        self.ending.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text |= {i: s for s, i in self.special.items()}
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.byte_chars = _byte_chars()
        parts = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+"
        newer = "".join("-".join(f"\\U{int(c, 16):08x}" for c in r.split("-")) for r in _NEWER.split())
        self.parts = regex.compile(parts)
        self.newer = regex.compile(f"[{newer}]")
        old = lambda kind: rf"(?:(?![{newer}])\p{{{kind}}})"
        self.parts_newer = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{old('L')}+|{old('N')}|(?:(?!{old('L')}|{old('N')})[^{_SPACE}])+")
        self.words = re.compile(f"[^{_SPACE}]+")
        self.compatible: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.seen: dict[str, tuple[bytes, str]] = {}

    def beside(self, left: int, right: int) -> bool:
        """Whether the tokens can stand side by side: no merge over the seam comes before those that made them."""
        key, before = (left, right), len(self.text)
        if (found := self.compatible.get(key)) is not None:
            return found
        ok = True
        while True:
            over = self.merged.get((left, right))
            if over is not None and over < before:
                ok = False
                break
            if left > right:  # the later merge is undone first
                if left < self.bases:
                    break
                before, left = left, self.halves[left][1]
            else:
                if right < self.bases:
                    break
                before, right = right + 1, self.halves[right][0]
        self.compatible[key] = ok
        return ok

    def encode_part(self, part: str) -> tuple[int, ...]:
        """Ids of one pre-token. Every single byte is a token, so every prefix has an encoding."""
        if (found := self.known.get(part)) is not None:
            return found
        word = "".join([self.byte_chars[b] for b in part.encode()]) + _END
        last = [(0, -1)] * (len(word) + 1)  # of each prefix: where its last token starts, and that token
        at = -1
        for end, (length, token) in self.ending.iter(word):  # longer tokens of an end come first
            if end == at:
                continue
            start = end + 1 - length
            if start == 0 or (last[start][1] >= 0 and self.beside(last[start][1], token)):
                last[end + 1] = (start, token)
                at = end
        out, end = [], len(word)
        while end:
            end, token = last[end]
            out.append(token)
        found = tuple(reversed(out))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[part] = found
        return found

    def encode_word(self, word: str) -> tuple[bytes, str]:
        """Of a run without white space: its ids, four bytes each, and its tokens' strings joined by a space."""
        clean, parts = word.lower(), self.parts
        if not word.isascii():
            clean = unicodedata.normalize("NFC", word).replace("Σ", "σ").translate(_SMALL).lower()
            parts = self.parts_newer if self.newer.search(clean) else parts
        ids = [i for part in parts.findall(clean) for i in self.encode_part(part)]
        found = np.array(ids, dtype="<u4").tobytes(), " ".join([self.text[i] for i in ids])
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        if len(word) < 200:
            self.seen[word] = found
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """Of a text: its ids, four bytes each in little-endian order, and the decoded text."""
        if "<|" in text and self.split_special and self.split_special.search(text):
            pieces, at = [], 0
            for m in self.split_special.finditer(text):
                pieces += [self._encode_plain(text[at : m.start()]), (np.array([self.special[m[0]]], "<u4").tobytes(), m[0])]
                at = m.end()
            pieces.append(self._encode_plain(text[at:]))
            return b"".join([p[0] for p in pieces]), " ".join([p[1] for p in pieces if p[0]])
        return self._encode_plain(text)

    def _encode_plain(self, text: str) -> tuple[bytes, str]:
        words = self.words.findall(text) if not text.isascii() or any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        seen, found = self.seen.get, []
        for w in words:
            found.append(seen(w) or self.encode_word(w))
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[0]])

    def decode(self, ids: bytes) -> str:
        """The vocabulary has no decoder, so the tokens' strings are joined by a space."""
        return " ".join([self.text[i] for i in np.frombuffer(ids, "<u4").tolist()])


@cache
def load(path: str) -> WordBPE:
    return WordBPE(path)


def encode_documents(docs: DataFrame, path: str = f"{TOKENIZERS}/{FILE}", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and with with_ids also ids (array of int) and decoded.

    One row a row of docs. A null or blank text has no token: n_tokens 0 and the hashes of nothing. Texts are encoded
    whole; no rows are shuffled. The vocabulary file must be at `path` on every machine.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                rows = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array([len(i) // 4 for i, _ in rows], pa.int64()), pa.array([sha(i) for i, _ in rows], pa.string()), pa.array([sha(d.encode()) for _, d in rows], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array([np.frombuffer(i, "<i4") for i, _ in rows], pa.list_(pa.int32())), pa.array([d for _, d in rows], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op8(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
