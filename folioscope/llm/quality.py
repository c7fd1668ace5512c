"""Quality by nearest labelled neighbours in a latent-semantic space of words and of word shapes.

A document is two bags: its words, hashed, and the shapes of its white-space-parted tokens, in pieces where they are
long (upper, lower, digits, signs as they are, runs collapsed), with its repeated tokens and its share of different
ones. Both are TF-IDF weighted with counts over all documents and projected by the leading singular vectors of a bounded
labelled sample; the two latent vectors stand side by side, each with its share of the cosine. Every document is
compared with every vector of the sample by exact cosine in blocks.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, cut, in_arrow, largest, lists
from .labelled import joined, remainder, sampled

#: Hashed shapes and words, latent dimensions of each, share of the cosine that shapes have.
SHAPES, WORDS, LATENT, SHARE = 512, 1 << 15, 32, 0.8
#: Labelled rows at most, neighbours, and the power of the cosine that weighs a vote.
SAMPLE, NEIGHBOURS, POWER = 4096, 31, 8
THRESHOLD, MOD, HELD_OUT = 0.7, 4, 2
#: Rows scored at once, and the piece of a token that has a shape.
_BLOCK, PIECE = 512, 64

_RUN = re.compile(r"(.)\1+", re.DOTALL)
_WORD = re.compile(r"\w+")
_CLASS = {**{chr(c): "U" for c in range(65, 91)}, **{chr(c): "l" for c in range(97, 123)}, **{chr(c): "9" for c in range(48, 58)}}


def _slot(name: str, slots: int = SHAPES) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % slots


def _shape(token: str) -> int:
    signs = [_CLASS.get(c) or ("U" if c.isupper() else "l" if c.isalpha() else "9" if c.isdigit() else c) for c in token]
    return _slot("shape " + _RUN.sub(r"\1", "".join(signs)))


def _code(token: str) -> int:
    """The slot of a token's shape and, above it, that of the first run of letters and digits in it (0: it has none)."""
    word = _WORD.search(token)
    return _shape(token) | ((1 + _slot(word[0].lower(), WORDS)) * SHAPES if word else 0)


_codes = Memo(_code, lasting=True)


def pieces(text: str) -> list[str]:
    """Tokens parted by white space, long ones cut into consecutive pieces, so that every character counts."""
    tokens = text.split()
    if max(map(len, tokens), default=0) > PIECE:
        return [t[i : i + PIECE] for t in tokens for i in range(0, len(t), PIECE)]
    return tokens


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers, shapes before words, and their counts; every text has a length feature, the empty one too."""
    tokens = pieces(text)
    n = len(tokens)
    codes = np.fromiter(map(_codes.__getitem__, tokens), np.int64, n)
    shapes = np.bincount(codes % SHAPES, minlength=SHAPES)
    shapes[_slot("repeated")] += sum(map(str.__eq__, tokens, tokens[1:]))
    shapes[_slot(f"different {10 * len(set(tokens)) // max(1, n)}")] += max(1, n // 4)
    shapes[_slot(f"length {n.bit_length()}")] += 1
    at = np.flatnonzero(shapes)
    words, times = np.unique(codes // SHAPES, return_counts=True)
    some = int(len(words) > 0 and words[0] == 0)  # tokens without a word
    return np.concatenate([at, words[some:] + (SHAPES - 1)]), np.concatenate([shapes[at], times[some:]])


def feature_table(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns to keep of docs, then idx array<int>, n array<int>, written to the shared folder; null texts are empty."""
    place, held = docs.columns.index(text_col), [docs.columns.index(c) for c in keep]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("idx", "n")])

    def run(batches):
        for batch in batches:
            found = [features(t or "") for t in batch.column(place).to_pylist()]
            ends = np.cumsum([len(a) for a, _ in found])
            flat = [np.concatenate([f[i] for f in found]).astype(np.int32) if found else np.zeros(0, np.int32) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in held), *(lists(x, ends) for x in flat)], names=schema.names)

    return cut(in_arrow(docs, run, schema), "quality")


@dataclass
class Bags:
    """Documents as sparse rows: where each starts, feature numbers and counts."""

    starts: np.ndarray
    idx: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, idx: pa.ListArray, n: pa.ListArray) -> Bags:
        starts = idx.offsets.to_numpy().astype(np.int64)
        return cls(starts - starts[0], idx.flatten().to_numpy(), n.flatten().to_numpy())

    def __len__(self) -> int:
        return len(self.starts) - 1

    def parts(self, entries: int = 1 << 16):
        """(first row, rows) in pieces of about so many entries, one row at least."""
        at = 0
        while at < len(self):
            end = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + entries, "right")) - 1)
            lo, hi = self.starts[at], self.starts[end]
            yield at, Bags(self.starts[at : end + 1] - lo, self.idx[lo:hi], self.n[lo:hi])
            at = end


@dataclass
class Model:
    """idf, projections of shapes and words (features x latent), unit vectors of the labelled rows and their labels."""

    idf: np.ndarray
    projections: list[np.ndarray]
    vectors: np.ndarray
    labels: np.ndarray

    def weighed(self, bags: Bags, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, weight) of the entries of one part, 0 shapes or 1 words, each row of unit length."""
        row = np.repeat(np.arange(len(bags)), np.diff(bags.starts))
        mine = (bags.idx >= SHAPES) == bool(part)
        row, at = row[mine], bags.idx[mine]
        w = np.log1p(bags.n[mine]) * self.idf[at]
        size = np.sqrt(np.bincount(row, w * w, len(bags)))
        return row, at - SHAPES * part, w / np.maximum(size, 1e-12)[row]

    def latent(self, bags: Bags) -> np.ndarray:
        """The two latent vectors of each row side by side, as one of unit length or less."""
        out = np.zeros((len(bags), 2 * LATENT))
        for first, some in bags.parts():
            for part, share in ((0, SHARE), (1, 1 - SHARE)):
                row, at, w = self.weighed(some, part)
                z = _sums(row, self.projections[part][at] * w[:, None], len(some))
                size = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
                out[first : first + len(some), part * LATENT : (part + 1) * LATENT] = z / size * np.sqrt(share)
        return out

    def score(self, bags: Bags) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled rows; 1.0 for all where nothing is labelled."""
        if not len(self.labels):
            return np.ones(len(bags))
        cos = self.latent(bags) @ self.vectors.T
        k = min(NEIGHBOURS, cos.shape[1])
        # Equal cosines: the earlier row. Rounded, as blocks of other sizes may add in another order.
        near = largest(np.round(cos, 9), k)
        w = np.maximum(np.take_along_axis(cos, near, 1), 1e-6) ** POWER
        return np.clip((w * self.labels[near]).sum(1) / w.sum(1), 0.0, 1.0)


def _sums(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the values (in order of row) of each row."""
    out = np.zeros((rows, values.shape[1]))
    if len(row):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _projection(row: np.ndarray, at: np.ndarray, w: np.ndarray, rows: int, features: int) -> np.ndarray:
    """The leading right singular vectors (features x LATENT) of a sparse matrix, by subspace iteration from a fixed start."""
    # A column at a time, so that memory is that of the entries.
    forth = lambda q: np.stack([np.bincount(row, q[at, j] * w, rows) for j in range(q.shape[1])], 1)
    back = lambda q: np.stack([np.bincount(at, q[row, j] * w, features) for j in range(q.shape[1])], 1)
    q = np.random.default_rng(5).standard_normal((features, LATENT + 8))
    for _ in range(6):
        q, _ = np.linalg.qr(back(forth(q)))
    _, _, turn = np.linalg.svd(forth(q), full_matrices=False)
    return (q @ turn.T)[:, :LATENT]


def fit(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", mod: int = MOD, held_out: int = HELD_OUT, rows: int = SAMPLE) -> Model:
    """A model of the feature table: document counts over all rows, latent space and neighbours from `rows` labelled ones."""
    df = np.zeros(SHAPES + WORDS)
    for r in table.select(F.explode("idx").alias("f")).groupBy("f").count().collect():  # SHAPES + WORDS rows at most
        df[r[0]] = r[1]
    idf = np.log((1 + table.count()) / (1 + df)) + 0.5
    own = table.select(F.col(id_col).alias("id"), "idx", "n")
    found = joined(own, sampled(labels, label, mod, held_out, rows, id_col), "idx", "n").orderBy("id").toArrow().combine_chunks()  # `rows` at most
    model = Model(idf, [np.zeros((SHAPES, LATENT)), np.zeros((WORDS, LATENT))], np.zeros((0, 2 * LATENT)), found["label"].to_numpy().astype(np.float64))
    if len(found):
        bags = Bags.of(*(found[c].combine_chunks() for c in ("idx", "n")))
        model.projections = [_projection(*model.weighed(bags, part), len(bags), (SHAPES, WORDS)[part]) for part in (0, 1)]
        model.vectors = model.latent(bags)
    return model


def _scored(table: DataFrame, model: Model, select, schema) -> DataFrame:
    """select(batch, scores) of every batch of the feature table, whose last columns are idx and n."""
    sent = table.sparkSession.sparkContext.broadcast(model)  # (SHAPES + WORDS + 2 x SAMPLE) x LATENT numbers

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, _BLOCK) for i in range(0, batch.num_rows, _BLOCK)):
                yield select(part, sent.value.score(Bags.of(*part.columns[-2:])))

    return in_arrow(table, run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out boolean, score double, predicted int for every row of docs.

    Null and empty texts have a score too. Repeated rows and null ids stay. No documents: no rows; no labels: score 1.
    Label rows with a null id or label are left out; of repeated ones the largest label counts, and where rows of a
    labelled id differ, the one of the smallest features teaches. Extra columns are ignored, and labels, lang, source
    and ids are no inputs.
    """
    table = feature_table(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", ["id"])
    model = fit(table, labels.withColumnRenamed(id_col, "id"), "id")
    kind = table.schema["id"].dataType.simpleString()
    scored = _scored(table, model, lambda part, s: pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["id", "score"]), f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), (remainder("id", MOD) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, with a score of at least the threshold. Cases: see classify()."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no clash with idx and n
    table = feature_table(docs.withColumnsRenamed(names), names[text_col], [*names.values()])
    model = fit(table, labels.withColumnRenamed(id_col, names[id_col]), names[id_col])
    width = len(docs.columns)
    kept = _scored(table, model, lambda part, s: part.select([*range(width)]).filter(pa.array(s >= threshold)), docs.withColumnsRenamed(names).schema)
    return kept.withColumnsRenamed({v: k for k, v in names.items()})
