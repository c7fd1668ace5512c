"""BPE encoding and decoding with a public vocabulary.

Words are encoded by a priority queue of merge ranks over a doubly linked list of symbols; entries that a merge has made
stale are skipped. Decoding joins vocabulary strings. Words repeat, so each worker keeps a bounded table of them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, in_arrow

#: White space of str.split() that \s of the normalizer does not hold.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """The letter for each byte: printable ones stand for themselves, the rest follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Encodes and decodes as the vocabulary file at `path` says (word ends, lower case, white space dropped)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.suffix = model["end_of_word_suffix"] or ""
        self.strings = {i: s for s, i in self.ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        pre = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(pre)
        self.letters = _byte_letters()
        self.pieces = Memo(self._piece, lasting=True)
        self.spaced = Memo(self._spaced, lasting=True)
        self.decoded = Memo(self._decoded, lasting=True)
        self.packed = Memo(lambda ids: np.array(ids.split(" "), np.int32).tobytes(), lasting=True)

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge the pair of lowest rank, leftmost first, until no pair has a rank."""
        n = len(symbols)
        if n < 2:
            return symbols
        symbols, before, after = list(symbols), [*range(-1, n - 1)], [*range(1, n), -1]
        ranks = self.ranks
        queue = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # stale: a merge has taken either symbol
            symbols[i], symbols[j] = left + right, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(queue, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(queue, (r, h, symbols[h], symbols[i]))
        return [s for s in symbols if s]

    def _piece(self, word: str) -> str:
        letters = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        letters[-1] += self.suffix
        return " ".join([str(self.ids[s]) for s in self.merge(letters) if s in self.ids])

    def _spaced(self, chunk: str) -> str:
        return " ".join([self.pieces[w] for w in self.word.findall(chunk)])

    def _decoded(self, ids: str) -> str:
        return " ".join([self.strings[int(i)] for i in ids.split(" ")]) if ids else ""

    def chunks(self, text: str) -> list[str]:
        """Decimal ids, joined by a space, of each white-space-free chunk of the text in order; none is empty."""
        if "<|" in text and len(parts := self.split_added.split(text)) > 1:
            return [c for i, p in enumerate(parts) for c in ([str(self.added[p])] if i % 2 else self.chunks(p))]
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("\u03a3", "\u03c3")  # lower-cased by character: no final form
        text = text.lower()
        if _ODD_SPACE.search(text):
            return [p for w in self.word.findall(text) if (p := self.pieces[w])]
        spaced = self.spaced
        return [p for c in text.split() if (p := spaced[c])]

    def encode(self, text: str) -> list[int]:
        return [int(i) for c in self.chunks(text) for i in c.split(" ")]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids])


_open: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = "word_bpe_49k.json") -> DataFrame:
    """id_col, n_tokens long, ids array<int>, decoded string of each row; null texts encode as the empty text: no ids, "".

    Other columns are dropped; repeated rows stay; null ids stay. No rows: none.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(vocabulary(vocab))
        for batch in batches:
            ids, decoded = [], []
            for text in batch.column(1).to_pylist():
                found = enc.chunks(text)
                ids.append(b"".join([enc.packed[c] for c in found]))
                decoded.append(" ".join([enc.decoded[c] for c in found]))
            n = np.array([len(x) // 4 for x in ids], np.int64)
            held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), held, pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids", "decoded"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return in_arrow(rows, run, f"id {kind}, n_tokens long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digest_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = "word_bpe_49k.json") -> DataFrame:
    """As encode_table, but with the SHA-256 of ids and decoded text in their place, taken where they are made."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(vocabulary(vocab))
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1).to_pylist():
                found = enc.chunks(text)
                ids = " ".join(found)
                n.append(ids.count(" ") + 1 if ids else 0)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                b.append(hashlib.sha256(" ".join([enc.decoded[c] for c in found]).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return in_arrow(rows, run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
