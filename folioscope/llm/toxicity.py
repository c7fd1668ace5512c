"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all words, hashed, and markers: words, beginnings of words, and either of them met twice or three times, that
a bounded labelled sample ties to the label (enough positive documents, and three times as frequent there). Markers weigh
more, so that a few of them in a long text are not lost among its other words. Document counts come from all documents.
Labelled examples are sparse rows and stand in blocks. The sum of query weights times a block's largest weights bounds
the cosines of a block; blocks that cannot reach the nearest found in the most promising one are skipped, so the
neighbours are exactly those that a full comparison finds.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow, largest, lists, numbered, words_of
from .labelled import joined, remainder, sampled

#: Labelled rows at most, neighbours, power of the cosine that weighs a vote, least positive documents of a marker.
SAMPLE, NEIGHBOURS, POWER, SUPPORT = 4096, 15, 4, 5
#: Slots of hashed words, and the weight of a word beside that of a marker.
WORDS, PLAIN = 1 << 15, 0.1
THRESHOLD, MOD, HELD_OUT, BLOCK = 0.5, 5, 0, 64
#: Labelled documents a batch of counts; rows and entries of the queries compared at once.
_FLUSH, _ROWS, _ENTRIES = 256, 128, 1 << 15
#: Words whose numbers a worker keeps between batches; queries of an exact comparison, and postings or entries at once.
_HELD, _EXACT, _PAIRED = 100_000, 64, 1 << 18
#: Terms in more than one of so many examples are compared as dense columns, the others by postings.
_OFTEN = 32


def _begins(word: bytes) -> tuple[str, ...]:
    w = word.decode("utf-8", "replace")
    return (w, *("^" + w[:k] for k in range(3, 9) if len(w) > k))


def terms_of(text: str, of=_begins) -> dict[str, int]:
    """Terms and counts; "#2" and "#3" of a term mark that it comes at least so often."""
    out: Counter = Counter()
    for w, n in Counter(words_of(text)).items():
        for t in of(w):
            out[t] += n
    for t, n in [*out.items()]:
        if n >= 2:
            out[f"{t}#2"] = 1
            if n >= 3:
                out[f"{t}#3"] = 1
    return out


def vocabulary(chosen: DataFrame) -> list[str]:
    """The markers, by name, that the labelled texts (columns text, label) give; the sample bounds them."""

    def run(batches):
        held, n = (Counter(), Counter()), 0
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[y].update(terms_of(text).keys())
                n += 1
                if n % _FLUSH == 0:
                    yield _counts(held)
                    held = (Counter(), Counter())
        yield _counts(held)

    chosen = chosen.select("text", F.when(F.col("label") > 0, 1).otherwise(0).alias("y"))
    totals = chosen.agg(F.sum("y"), F.count(F.lit(1))).first()
    n1, n0 = totals[0] or 0, totals[1] - (totals[0] or 0)
    if not n1 or not n0:
        return []
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    found = in_arrow(chosen, run, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return sorted(r["term"] for r in found.filter((F.col("a") >= SUPPORT) & (a / n1 > 3 * b / n0)).collect())


def _counts(held: tuple[Counter, Counter]) -> pa.RecordBatch:
    terms = [*(held[0].keys() | held[1].keys())]
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([held[1][t] for t in terms], pa.int64()), pa.array([held[0][t] for t in terms], pa.int64())], names=["term", "a", "b"])


class _Terms(dict):
    """Numbers of words; what each stands for is kept beside as arrays, so that texts are counted without a loop over words."""

    def __init__(self, known: dict[str, int], roots: dict[str, int], first: int):
        super().__init__()
        self.roots, self.first = roots, first
        self.slots, self.sizes, self.found = [], [], []
        # The places of a root and of its being met twice and three times, -1 where it is no marker.
        self.places = np.array([[known.get(t + end, -1) for end in ("", "#2", "#3")] for t in roots], np.int64).reshape(-1, 3)

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        mine = [self.roots[t] for t in _begins(word) if t in self.roots]
        self.slots.append(self.first + zlib.crc32(word) % WORDS)
        self.sizes.append(len(mine))
        self.found.extend(mine)
        return i

    def entries(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place and count of all terms of the texts, in order of row and place."""
        words = [numbered(t, self.__getitem__) for t in texts]
        key, n = np.unique(np.repeat(np.arange(len(texts)), [len(w) for w in words]) * len(self) + np.concatenate([np.zeros(0, np.int64), *words]), return_counts=True)
        row, word = np.divmod(key, max(1, len(self)))
        slots, sizes, found = (np.array(x, np.int64) for x in (self.slots, self.sizes, self.found))
        size = sizes[word]
        at = np.arange(size.sum()) + np.repeat(np.cumsum(sizes)[word] - size - (np.cumsum(size) - size), size)
        mark, c = _summed(np.repeat(row, size) * len(self.places) + found[at], np.repeat(n, size))
        owner, root = np.divmod(mark, max(1, len(self.places)))
        rows, places, counts = [row], [slots[word]], [n]
        for k in range(3):
            place = self.places[root, k]
            some = (place >= 0) & (c > k)
            rows, places, counts = [*rows, owner[some]], [*places, place[some]], [*counts, c[some] if k == 0 else np.ones(some.sum(), np.int64)]
        width = self.first + WORDS
        key, n = _summed(np.concatenate(rows) * width + np.concatenate(places), np.concatenate(counts))
        return key // width, key % width, n


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order, each once, and the sum of its counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]


def vector_table(docs: DataFrame, markers: list[str]) -> DataFrame:
    """id, idx array<int>, n array<int> of every row, written to the shared folder: markers by place, then words by slot."""
    known = {t: i for i, t in enumerate(markers)}
    roots = {t: i for i, t in enumerate(sorted({t.split("#")[0] for t in markers}))}
    first = len(markers)

    def run(batches):
        held = _Terms(known, roots, first)
        for batch in (b.slice(i, 4 * _ROWS) for b in batches for i in range(0, b.num_rows, 4 * _ROWS)):
            if len(held) > _HELD:
                held = _Terms(known, roots, first)
            row, idx, n = held.entries(batch.column(1).to_pylist())
            ends = np.cumsum(np.bincount(row, minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(lists(x, ends, pa.int32()) for x in (idx, n))], names=["id", "idx", "n"])

    kind = docs.schema["id"].dataType.simpleString()
    return cut(in_arrow(docs.select("id", "text"), run, f"id {kind}, idx array<int>, n array<int>"), "toxicity")


@dataclass
class Rows:
    """Sparse rows: where each starts, and places in order and values of all entries."""

    starts: np.ndarray
    at: np.ndarray
    values: np.ndarray
    width: int

    def __len__(self) -> int:
        return len(self.starts) - 1

    @classmethod
    def of(cls, dense: np.ndarray) -> Rows:
        r, at = np.nonzero(dense)
        return cls(np.searchsorted(r, np.arange(len(dense) + 1)), at, dense[r, at], dense.shape[1])

    @classmethod
    def weighed(cls, idx: pa.ListArray, n: pa.ListArray, weights: np.ndarray) -> Rows:
        """Unit rows of term numbers and their counts."""
        starts = idx.offsets.to_numpy().astype(np.int64)
        at = idx.flatten().to_numpy()
        out = cls(starts - starts[0], at, (1 + np.log(n.flatten().to_numpy())) * weights[at], len(weights))
        out.values /= np.maximum(np.sqrt(np.bincount(out.row(), out.values**2, len(out))), 1e-12)[out.row()]
        return out

    def size(self) -> np.ndarray:
        return np.diff(self.starts)

    def row(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self)), self.size())

    def take(self, rows: np.ndarray) -> Rows:
        size = self.size()[rows]
        ends = np.concatenate([[0], np.cumsum(size)])
        i = np.arange(ends[-1]) - np.repeat(ends[:-1] - self.starts[rows], size)
        return Rows(ends, self.at[i], self.values[i], self.width)

    def parts(self):
        """(row numbers, rows) in pieces of bounded rows and entries, one row at least."""
        at = 0
        while at < len(self):
            end = int(np.searchsorted(self.starts, self.starts[at] + _ENTRIES, "right")) - 1
            rows = np.arange(at, max(at + 1, min(end, at + _ROWS, len(self))))
            yield rows, self.take(rows)
            at = int(rows[-1]) + 1

    def largest(self) -> np.ndarray:
        """The place of the largest value of each row, of equal ones the first; 0 of empty rows."""
        order = np.lexsort((self.at, -self.values, self.row()))
        some = self.size() > 0
        out = np.zeros(len(self), np.int64)
        out[some] = self.at[order[self.starts[:-1][some]]]
        return out

    def dense(self, columns: np.ndarray | None = None) -> np.ndarray:
        """All columns, or those given, in order."""
        columns = np.arange(self.width) if columns is None else columns
        place = np.full(self.width, -1)
        place[columns] = np.arange(len(columns))
        out = np.zeros((len(self), len(columns)))
        mine = place[self.at] >= 0
        out[self.row()[mine], place[self.at[mine]]] = self.values[mine]
        return out


@dataclass
class Index:
    """Postings by term, in order of example, with the largest weight of each block, and dense columns of frequent terms."""

    weights: np.ndarray
    rows: Rows | np.ndarray
    labels: np.ndarray
    ids: np.ndarray

    def __post_init__(self):
        if isinstance(self.rows, np.ndarray):
            self.rows = Rows.of(self.rows)
        order = np.lexsort((self.ids, self.rows.largest()))
        self.rows, self.labels, self.ids = self.rows.take(order), self.labels[order], self.ids[order]
        n, d, t = len(self.rows), self.rows.row(), self.rows.at
        self.blocks = -(-n // BLOCK)
        often = np.bincount(t, minlength=self.rows.width) * _OFTEN > n
        self.often = np.flatnonzero(often)
        self.columns = self.rows.dense(self.often).astype(np.float32)
        by = np.lexsort((d, t))
        by = by[~often[t[by]]]
        self.docs, self.posted = d[by].astype(np.int32), self.rows.values[by]
        self.starts = np.searchsorted(t[by], np.arange(self.rows.width + 1))
        padded = np.concatenate([self.columns, np.zeros((self.blocks * BLOCK - n, len(self.often)), np.float32)])
        self.most = padded.reshape(self.blocks, BLOCK, len(self.often)).max(1)  # the largest weight of each frequent term in each block
        # Sums of products in single precision of unit rows are off by no more than this.
        self.slack = (len(self.often) + 8) * 2.0**-23
        whose: dict[bytes, int] = {}
        cut_at = zip(self.rows.starts[:-1].tolist(), self.rows.starts[1:].tolist(), strict=True)
        self.twin = np.array([whose.setdefault(self.rows.at[i:j].tobytes() + self.rows.values[i:j].tobytes(), e) for e, (i, j) in enumerate(cut_at)], np.int64)
        self.slope, self.offset, self.calibrated = 1.0, 0.0, False

    @property
    def dense(self) -> np.ndarray:
        return self.rows.dense()

    def _rare(self, queries: Rows) -> np.ndarray:
        """What the terms of the postings add to each cosine (queries x examples)."""
        n, out, lo = len(self.rows), np.zeros((len(queries), len(self.rows))), 0
        count = np.diff(self.starts)[queries.at]
        before = np.concatenate([[0], np.cumsum(count)])[queries.starts]  # postings of the queries before
        while lo < len(queries):
            hi = max(lo + 1, int(np.searchsorted(before, before[lo] + _PAIRED, "right")) - 1)
            some = slice(queries.starts[lo], queries.starts[hi])
            first, size = self.starts[queries.at[some]], count[some]
            post = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
            at = np.repeat(np.repeat(np.arange(hi - lo) * n, queries.size()[lo:hi]), size) + self.docs[post]
            out[lo:hi] = np.bincount(at, np.repeat(queries.values[some], size) * self.posted[post], (hi - lo) * n).reshape(hi - lo, n)
            lo = hi
        return out

    def bounds(self, rare: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """No cosine of a query with an example of a block is larger (queries x blocks)."""
        padded = np.zeros((len(rare), self.blocks * BLOCK))
        padded[:, : rare.shape[1]] = rare
        return padded.reshape(len(rare), self.blocks, BLOCK).max(2) + dense @ self.most.T + self.slack

    def _cosines(self, rare: np.ndarray, dense: np.ndarray, alive: np.ndarray, out: np.ndarray) -> None:
        """Writes the cosines, off by no more than the slack, of the examples of each query's blocks that are alive."""
        for b in np.flatnonzero(alive.any(0)).tolist():
            q, part = np.flatnonzero(alive[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
            out[q, part] = dense[q] @ self.columns[part].T + rare[q, part]

    def _exact(self, queries: Rows, near: np.ndarray) -> np.ndarray:
        """The cosines in double precision of the pairs that are marked (queries x examples), -1 elsewhere."""
        q, e = np.nonzero(near)
        out = np.full(near.shape, -1.0)
        pairs, back = np.unique(q * len(self.rows) + self.twin[e], return_inverse=True)
        who, example = np.divmod(pairs, max(1, len(self.rows)))
        ends = np.concatenate([[0], np.cumsum(self.rows.size()[example])])
        cos, wide, at = np.zeros(len(pairs)), np.zeros((min(_EXACT, len(queries)), queries.width)), 0
        while at < len(pairs):
            lo = who[at]
            end = max(at + 1, min(int(np.searchsorted(ends, ends[at] + _PAIRED, "right")) - 1, int(np.searchsorted(who, lo + _EXACT))))
            some = slice(queries.starts[lo], queries.starts[min(lo + _EXACT, len(queries))])
            row = np.repeat(np.arange(len(queries.size()[lo : lo + _EXACT])), queries.size()[lo : lo + _EXACT])
            wide[row, queries.at[some]] = queries.values[some]
            mine = self.rows.take(example[at:end])
            pair = mine.row()
            cos[at:end] = np.bincount(pair, wide[(who[at:end] - lo)[pair], mine.at] * mine.values, end - at)
            wide[row, queries.at[some]] = 0
            at = end
        out[q, e] = cos[back]
        return out

    def nearest(self, queries: Rows | np.ndarray, k: int = NEIGHBOURS, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and examples of the k nearest of each unit query; ties go to the earlier example. leave: one not to take.

        Comparisons in single precision choose every example that can be among the k; their cosines in double decide.
        """
        queries = Rows.of(queries) if isinstance(queries, np.ndarray) else queries
        k = min(k, max(1, len(self.rows)))
        best, who = np.full((len(queries), k), -1.0), np.full((len(queries), k), -1)
        for rows, part in queries.parts() if len(self.rows) else ():
            rare, dense = self._rare(part), part.dense(self.often).astype(np.float32)
            bound = self.bounds(rare, dense)
            cos = np.full((len(part), len(self.rows)), -1.0)
            alive = np.zeros(bound.shape, bool)
            alive[np.arange(len(part)), bound.argmax(1)] = True
            self._cosines(rare, dense, alive, cos)
            if leave is not None:
                cos[np.arange(len(part)), leave[rows]] = -1.0
            edge = -np.partition(-cos, k - 1, axis=1)[:, k - 1]  # the k-th nearest so far
            alive = ~alive & (bound >= np.maximum(edge - 2 * self.slack, 0)[:, None])
            self._cosines(rare, dense, alive, cos)
            if leave is not None:
                cos[np.arange(len(part)), leave[rows]] = -1.0
            edge = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k]
            cos = self._exact(part, (cos > 0) & (cos >= edge - 2 * self.slack))
            cos = np.where(cos > 1e-12, np.round(cos, 12), -1.0)
            near = largest(cos, k)
            got = np.take_along_axis(cos, near, 1)
            order = np.argsort(-got, axis=1, kind="stable")
            best[rows], who[rows] = np.take_along_axis(got, order, 1), np.take_along_axis(near, order, 1)
        who[best <= 0] = -1
        return best, who

    def votes(self, best: np.ndarray, who: np.ndarray) -> np.ndarray:
        w = np.where(who >= 0, np.maximum(best, 0), 0.0) ** POWER
        y = np.where(who >= 0, self.labels[who], 0.0) if len(self.labels) else np.zeros_like(w)
        return (w * y).sum(1) / np.maximum(w.sum(1), 1e-300)

    def calibrate(self) -> None:
        """A logistic curve of the votes that the examples get from the others."""
        some = np.flatnonzero(self.rows.size() > 0)
        y = self.labels[some]
        if len(y) and 0 < y.sum() < len(y):
            v = self.votes(*self.nearest(self.rows.take(some), leave=some))
            x, b = np.stack([v, np.ones_like(v)], 1), np.zeros(2)
            for _ in range(50):
                p = 1 / (1 + np.exp(-x @ b))
                g, h = x.T @ (y - p) - 0.05 * b, (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
                b += np.linalg.solve(h, g)
            self.slope, self.offset, self.calibrated = float(b[0]), float(b[1]), b[0] > 0

    def score(self, best: np.ndarray, who: np.ndarray) -> np.ndarray:
        """The calibrated vote; without any neighbour that of no vote for label 1."""
        v = self.votes(best, who)
        return 1 / (1 + np.exp(-(self.slope * v + self.offset))) if self.calibrated else v


def fit(docs: DataFrame, labels: DataFrame, id_col: str, rows: int = SAMPLE) -> tuple[DataFrame, Index]:
    """The vector table of docs (columns id, text) and the index over at most `rows` labelled examples."""
    sample = cut(sampled(labels, "toxic", MOD, HELD_OUT, rows, id_col), "toxicity-sample")
    chosen = cut(joined(docs, sample, "text"), "toxicity-examples")
    markers = vocabulary(chosen)
    table = vector_table(docs, markers)
    df = np.zeros(len(markers) + WORDS)
    for r in table.select(F.explode("idx").alias("t")).groupBy("t").count().collect():  # a row for each term at most
        df[r[0]] = r[1]
    weights = np.log((1 + table.count()) / (1 + df))
    weights[: len(markers)] += 1
    weights[len(markers) :] *= PLAIN
    found = joined(table, sample, "idx", "n").orderBy("id").toArrow().combine_chunks()  # `rows` at most
    if len(found):
        examples = Rows.weighed(found["idx"].combine_chunks(), found["n"].combine_chunks(), weights)
    else:
        examples = Rows(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), len(weights))
    index = Index(weights, examples, (found["label"].to_numpy() > 0).astype(np.float64), found["id"].to_numpy(zero_copy_only=False))
    index.calibrate()
    return table, index


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out boolean, score double, predicted int, evidence array<struct<id,label,cosine>> of every row of docs.

    Texts without a word that any example holds (null and empty ones too) have no evidence and get the score of no vote
    for label 1. Repeated rows and null ids stay. No documents: no rows; no labels: score 0. Label rows with a null id
    or label are left out; of repeated ones the largest label counts, and where rows of a labelled id differ, the one of
    the smallest text teaches. Extra columns are ignored, and labels, lang, source and ids are no inputs.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table, index = fit(rows, labels.withColumnRenamed(id_col, "id"), "id")
    sent = docs.sparkSession.sparkContext.broadcast(index)  # the entries of SAMPLE sparse rows, and terms x blocks of bounds
    kind = table.schema["id"].dataType.simpleString()

    def run(batches):
        ix = sent.value
        for batch in batches:
            for part in (batch.slice(i, _ROWS) for i in range(0, batch.num_rows, _ROWS)):
                best, who = near = ix.nearest(Rows.weighed(part.column(1), part.column(2), ix.weights))
                some = who >= 0
                flat = who[some]
                fields = [pa.array(ix.ids[flat], part.schema.field(0).type), pa.array(ix.labels[flat].astype(np.int32)), pa.array(best[some])]
                evidence = lists(pa.StructArray.from_arrays(fields, names=["id", "label", "cosine"]), np.cumsum(some.sum(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ix.score(*near), pa.float64()), evidence], names=["id", "score", "evidence"])

    scored = in_arrow(table, run, f"id {kind}, score double, evidence array<struct<id:{kind},label:int,cosine:double>>")
    return scored.select(F.col("id").alias(id_col), (remainder("id", MOD) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
