"""Removal of long repeated byte strings by sorted suffixes at content-chosen anchors.

Every window of `length` bytes holds one anchor: the place of its smallest hashed gram. Equal windows have equal anchors
at the same offset, so two windows can only be equal if their anchors have equal grams, and the windows of a document fall
into runs that share an anchor. Anchors whose gram comes nowhere else are dropped before any text moves. For the
others the bytes around the anchor go to the task of their gram, where the suffixes that start at the anchors, and the
reversed prefixes that end there, are ordered by deep-shallow sorting: a multikey quicksort over eight-byte words to a
shallow depth, then a blind trie for each group that is still equal there. Common prefixes of neighbours then tell,
for each offset, which windows are equal. Hashes only choose and route; equality is always that of bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, Tables, cut, in_arrow, numbered
from .near_dedup import mix

LENGTH, GRAM, PASSAGE = 400, 64, 50
#: Bytes sorted by quicksort, bytes of text that one pass of the rolling hash takes, contexts sorted at once.
SHALLOW, PASS, AT_ONCE = 96, 1 << 18, 16_384
#: Anchors of one gram above which its windows are dealt by slices of SLICE offsets and the bytes that a slice shares.
HOT, SLICE = 4096, 48

#: Low bits of a gram's hash that give way to its place.
_BITS = 20
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PASS + 2 * LENGTH)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Runs of windows that share an anchor, as rows (anchor, first window, last window, gram hash) of int64.

    data: the symbols of texts one after another, each from its place in starts (which ends with the size of data). Equal
    windows have the same anchor in any data, as places are told apart by the same number of hash bits everywhere.
    """
    n = len(data)
    if n >= 1 << _BITS:
        raise ValueError(f"one pass takes fewer than {1 << _BITS} symbols")
    if n < length:
        return np.zeros((0, 4), np.int64)
    power, inverse = _tables(n + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n])])
    h = mix((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    low = np.uint64((1 << _BITS) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, reach = length - gram + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    at = (least & low).astype(np.int64)  # the anchor of each window
    ends = starts[np.searchsorted(starts, np.arange(len(at)), "right")]
    ok = np.arange(len(at)) + length <= ends
    text = np.searchsorted(starts, np.arange(len(at)), "right")
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (ok[1:] != ok[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    keep = ok[first]
    first, last = first[keep], last[keep]
    return np.stack([at[first], first, last, h[at[first]].view(np.int64)], 1)


def _passes(texts: list[np.ndarray], length: int):
    """(data, [(text number, offset of its first symbol)]) of about PASS symbols; long texts overlap by a window."""
    held, of, n = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), PASS):
            part = t[at : at + PASS + length - 1]
            held.append(part)
            of.append((i, at))
            n += len(part)
            if n >= PASS:
                yield held, of
                held, of, n = [], [], 0
    if held:
        yield held, of


def anchor_rows(texts: list[np.ndarray], length: int = LENGTH, gram: int = GRAM):
    """(text number, anchor, first, last, gram hash) arrays over all texts, offsets within each text."""
    for parts, of in _passes(texts, length):
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        rows = anchors(np.concatenate(parts), starts, length, gram)
        part = np.searchsorted(starts, rows[:, 0], "right") - 1
        # An anchor of a window lies within it, so in the same part.
        shift = np.array([a for _, a in of], np.int64)[part] - starts[part]
        yield np.array([i for i, _ in of], np.int64)[part], rows[:, 0] + shift, rows[:, 1] + shift, rows[:, 2] + shift, rows[:, 3]


# --- deep-shallow sorting -------------------------------------------------------------------------------------------


class _Node:
    """A branch of a blind trie: where its strings first differ, and what follows by the byte there (-1: the end)."""

    __slots__ = ("at", "next")

    def __init__(self, at: int):
        self.at, self.next = at, {}


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Places of the strings in order; a string before those that it begins, equal ones in the order given.

    A string goes down by the bytes at the branches alone, meets some leaf, is compared with it once, and is put in
    where the two first differ.
    """
    same: dict[bytes, list[int]] = {}
    for i, s in enumerate(strings):
        same.setdefault(s, []).append(i)
    if len(same) == 1:
        return [*range(len(strings))]
    root: _Node | bytes | None = None
    for s in same:
        if root is None:
            root = s
            continue
        node = root
        while isinstance(node, _Node):
            c = s[node.at] if node.at < len(s) else -1
            follow = node.next.get(c)
            node = follow if follow is not None else next(iter(node.next.values()))
        m = min(len(s), len(node))
        a, b = int.from_bytes(s[:m], "big"), int.from_bytes(node[:m], "big")
        d = m if a == b else m - ((a ^ b).bit_length() + 7) // 8
        mine, other = (x[d] if d < len(x) else -1 for x in (s, node))
        above, node = None, root
        while isinstance(node, _Node) and node.at < d:
            above, node = node, node.next[s[node.at] if node.at < len(s) else -1]
        if isinstance(node, _Node) and node.at == d:
            node.next[mine] = s
            continue
        fresh = _Node(d)
        fresh.next = {other: node, mine: s}
        if above is None:
            root = fresh
        else:
            above.next[s[above.at] if above.at < len(s) else -1] = fresh
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Node):
            stack += [node.next[c] for c in sorted(node.next, reverse=True)]
        else:
            out += same[node]
    return out


def deep_shallow_order(group: np.ndarray, padded: np.ndarray, size: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """The order of the byte strings (rows of padded, cut at size) by group and then bytes.

    The quicksort goes word by word over all groups at once and only on with those that still hold several strings.
    """
    order = np.argsort(group, kind="stable")
    words = padded[:, : shallow // 8 * 8].copy().view(">u8").astype(np.uint64)
    edge = np.ones(len(order) + 1, bool)  # where a group of equal strings starts in the order
    edge[1:-1] = group[order][1:] != group[order][:-1]
    for depth in range(words.shape[1]):
        head = np.cumsum(edge[:-1]) - 1
        several = np.flatnonzero(~(edge[:-1] & edge[1:]))
        if not len(several):
            break
        rows = order[several]
        by = np.lexsort((words[rows, depth], head[several]))
        order[several] = rows = rows[by]
        w, g = words[rows, depth], head[several][by]
        cutting = np.flatnonzero((w[1:] != w[:-1]) & (g[1:] == g[:-1])) + 1
        edge[several[cutting]] = True
    begin = np.flatnonzero(edge)
    for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if hi - lo > 1:
            rows = order[lo:hi]
            deep = blind_trie_order([padded[r, : size[r]].tobytes() for r in rows.tolist()])
            order[lo:hi] = rows[deep]
    return order


def common_prefixes(order: np.ndarray, group: np.ndarray, padded: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes that each string in order shares with the one before it; -1 at the start of a group."""
    out = np.full(len(order), -1, np.int64)
    for lo in range(1, len(order), 4096):
        a, b = order[lo - 1 : lo + 4095], order[lo : lo + 4096]
        a = a[: len(b)]
        differ = np.concatenate([padded[a] != padded[b], np.ones((len(b), 1), bool)], 1).argmax(1)
        n = np.minimum(differ, np.minimum(size[a], size[b]))
        out[lo : lo + len(b)] = np.where(group[a] == group[b], n, -1)
    return out


def repeated(
    group: np.ndarray, right: np.ndarray, right_size: np.ndarray, left: np.ndarray, left_size: np.ndarray, low: np.ndarray, high: np.ndarray, length: int = LENGTH, unit: int = 1, source: np.ndarray | None = None
) -> np.ndarray:
    """repeated[i, s]: whether the window that starts s symbols before anchor i equals that of another anchor of its group.

    right: bytes from the anchor on; left: bytes before it, last first; unit: bytes of a symbol. low, high: the offsets
    that an anchor has. source: where given, the other anchor must be of another source.
    """
    n = len(group)
    source = np.arange(n) if source is None else source
    sides = []
    for padded, size in ((right, right_size), (left, left_size)):
        order = deep_shallow_order(group, padded, size)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        sides.append((common_prefixes(order, group, padded, size), rank))
    (r_common, r_rank), (l_common, l_rank) = sides
    out = np.zeros((n, int(high.max()) + 1 if n else 0), bool)
    for s in range(out.shape[1]):
        on = np.flatnonzero((low <= s) & (s <= high))
        if len(on) < 2:
            continue
        r = np.cumsum(r_common < (length - s) * unit)[r_rank[on]]
        key = r * (n + 1) + np.cumsum(l_common < s * unit)[l_rank[on]]
        by = np.argsort(key, kind="stable")
        k, of = key[by], source[on[by]]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        several = np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first)
        hit = np.repeat(several, np.diff(np.append(first, len(k))))
        out[on[by[hit]], s] = True
    return out


# --- plans ----------------------------------------------------------------------------------------------------------


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


_word = Memo(xxhash.xxh32_intdigest, lasting=True)


def _words(text: str) -> np.ndarray:
    """Four bytes for each word, as a passage of words is the same whatever stands between them."""
    return numbered(text, _word.__getitem__).astype(np.uint32)


def _anchor_table(docs: DataFrame, length: int, gram: int, symbols) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                keys = part.column(0)
                texts = [symbols(t) for t in part.column(1).to_pylist()]
                for i, a, lo, hi, g in anchor_rows(texts, length, gram):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(i)), pa.array(g), pa.array(a), pa.array(lo), pa.array(hi)], names=["h", "gram", "a", "lo", "hi"])

    return in_arrow(docs.select("h", "text"), run, "h binary, gram long, a long, lo long, hi long")


def _contexts(marked: DataFrame, length: int, symbols) -> DataFrame:
    """A row for each anchor (hot: for each slice of its windows) with the bytes of the symbols that its windows cover."""

    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    step = min(SLICE, max(1, length // 8))

    def sent(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "h", "a", "lo", "hi", "bytes"])

    def run(batches):
        # Few documents at a time, and their marks as columns: a batch of many marks as objects would fill a worker.
        for batch in (b.slice(i, 128) for b in batches for i in range(0, b.num_rows, 128)):
            flat = batch.column(2).flatten()
            columns = [flat.field(name).to_pylist() for name in ("a", "lo", "hi", "gram", "hot")]
            ends = np.concatenate([[0], np.cumsum(np.diff(batch.column(2).offsets.to_numpy()))]).tolist()
            rows = []
            for d, (h, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                data = symbols(text)
                u, data = data.itemsize, data.tobytes()
                for a, lo, hi, gram, hot in zip(*(c[ends[d] : ends[d + 1]] for c in columns), strict=True):
                    if not hot:
                        rows.append((gram, h, a, lo, hi, data[lo * u : (hi + length) * u]))
                    for s in range((a - hi) // step * step, a - lo + 1, step) if hot else ():
                        # Windows s to s + step - 1 before the anchor all cover these symbols, so the text has them all.
                        first, last = max(lo, a - s - step + 1), min(hi, a - s)
                        core = data[(a - s) * u : (a - s - step + 1 + length) * u]
                        key = int.from_bytes(hashlib.blake2b(s.to_bytes(4, "little") + core, digest_size=8, key=gram.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)
                        rows.append((key, h, a, first, last, data[first * u : (last + length) * u]))
                    if len(rows) >= 2048:
                        yield sent(rows)
                        rows = []
            if rows:
                yield sent(rows)

    return in_arrow(marked.select("h", "text", "marks"), run, "key long, h binary, a long, lo long, hi long, bytes binary")


def _groups(batches):
    """Tables of whole groups, in order of key, of AT_ONCE rows or more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        while n >= AT_ONCE:
            whole = pa.Table.from_batches(held)
            keys = whole.column(0).to_numpy()
            end = int(np.searchsorted(keys, keys[-1], "left"))
            if end == 0:
                break
            yield whole.slice(0, end)
            held, n = whole.slice(end).to_batches(), len(keys) - end
    if n:
        yield pa.Table.from_batches(held)


def _repeats(contexts: DataFrame, length: int, unit: int, across: bool) -> DataFrame:
    """h, start, end: maximal runs of symbols under repeated windows of one anchor. Groups are streamed in order of key."""

    def run(batches):
        for t in _groups(batches):
            key, a, lo, hi = (t.column(i).to_numpy() for i in (0, 2, 3, 4))
            single = np.ones(len(key), bool)
            single[1:] &= key[1:] != key[:-1]
            single[:-1] &= key[1:] != key[:-1]
            if single.all():
                continue
            t, key, a, lo, hi = t.filter(pa.array(~single)), key[~single], a[~single], lo[~single], hi[~single]
            n = len(key)
            width = (length + 8 // unit) * unit
            right, left = np.zeros((n, width), np.uint8), np.zeros((n, width), np.uint8)
            for i, b in enumerate(t.column(5).to_pylist()):
                d = np.frombuffer(b, np.uint8)
                c = (a[i] - lo[i]) * unit
                right[i, : len(d) - c] = d[c:]
                left[i, :c] = d[:c][::-1]
            source = t.column(1).combine_chunks().dictionary_encode().indices.to_numpy() if across else None
            again = repeated(key, right, (hi - a + length) * unit, left, (a - lo) * unit, a - hi, a - lo, length, unit, source)
            steps = np.diff(np.pad(again.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, s0 = np.nonzero(steps == 1)
            _, s1 = np.nonzero(steps == -1)
            if len(row):
                yield pa.RecordBatch.from_arrays([t.column(1).combine_chunks().take(pa.array(row)), pa.array(a[row] - s1 + 1), pa.array(a[row] - s0 + length)], names=["h", "start", "end"])

    sent = contexts.repartition("key").sortWithinPartitions("key")
    return in_arrow(sent, run, "h binary, start long, end long")


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes under the spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _released(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of what is written; without it they stay until the driver is short of memory."""
    spark.sparkContext._jvm.System.gc()


def _found(rows: DataFrame, copies: DataFrame, length: int, gram: int, symbols, unit: int, across: bool, tables: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The anchors, the texts (h, text, copies) of which one repeats, and h, spans of them; all written.

    rows: id, h, text; copies: h, copies, first. across: only what another text holds too.
    """
    anchors_ = tables.cut(_anchor_table(rows, length, gram, symbols), "anchors")
    # Copies of a text have the same anchors at the same places, so those alone do not count.
    place = F.xxhash64("h") if across else F.xxhash64("h", "a")
    shared = anchors_.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("p"), F.max(place).alias("q")).filter("p != q")
    # Written, so that the join on a very common gram can be split.
    shared = tables.cut(shared.select("gram", (F.col("n") > HOT).alias("hot")), "grams")
    marks = anchors_.join(shared, "gram").groupBy("h").agg(F.collect_set(F.struct("a", "lo", "hi", "gram", "hot")).alias("marks"))
    # One row of each text: that of its smallest id, so that copies of a text are spread over tasks.
    wanted = tables.cut(marks.join(copies, "h"), "marks")
    _released(rows.sparkSession)
    held = rows.join(wanted.select("h", "marks", "copies", F.col("first").alias("id_first")), (rows["h"] == wanted["h"]) & rows["id"].eqNullSafe(F.col("id_first")))
    held = tables.cut(held.select(rows["h"], "text", "marks", "copies"), "marked")
    _released(rows.sparkSession)
    spans = _repeats(_contexts(held, length, symbols), length, unit, across).groupBy("h").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return anchors_, held, tables.cut(spans, "spans")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, passage: int = PASSAGE) -> DataFrame:
    """id_col, n_bytes long, spans array<struct<start,end>> (maximal runs to remove), kept_sha256, n_passages of every row.

    A byte is removed if a string of `length` bytes that covers it starts anywhere else too, in any row, the same one
    included; strings do not cross rows and are judged on the input. n_passages long counts the maximal runs of `passage`
    words or more that stand in another row too, whatever parts the words; they are not removed. Null texts are empty;
    texts shorter than `length` keep all. Repeated rows are copies of each other, so they lose all bytes if long enough.
    No documents: no rows. Extra columns are ignored.
    """
    tables = Tables(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.unhex(F.sha2("text", 256)).alias("sha"))
    rows = rows.select("id", "text", "sha", F.substring("sha", 1, 16).alias("h"))  # half of it names a text in what is shuffled
    short = rows.select("id", "h", "sha", F.octet_length("text").cast("long").alias("n_bytes"))
    copies = cut(short.groupBy("h").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first")), "copies")
    _, held, spans = _found(rows, copies, length, gram, _bytes, 1, False, tables)

    def remove(batches):
        one = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out, sums = [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, at, rest = text.encode("utf-8", "surrogatepass"), 0, hashlib.sha256()
                runs = union([(s["start"], s["end"]) for s in found])
                for a, b in runs:
                    rest.update(data[at:a])
                    at = b
                rest.update(data[at:])
                out.append([{"start": a, "end": b} for a, b in runs])
                sums.append(rest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, one), pa.array(sums, pa.string())], names=["h", "spans", "kept"])

    once = in_arrow(held.filter("copies = 1").select("h", "text").join(spans, "h"), remove, "h binary, spans array<struct<start:bigint,end:bigint>>, kept string")
    once = cut(once, "removed")
    tables.drop()
    _released(docs.sparkSession)

    def count(batches):
        for batch in batches:
            n = [len(union([(s["start"], s["end"]) for s in found])) for found in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["h", "n_passages"])

    anchors_, _, spans = _found(rows, copies, passage, max(1, passage // 6), _words, 4, True, tables)
    passages = cut(anchors_.groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(in_arrow(spans, count, "h binary, n_passages long"), "h", "left").select("h", "n_passages"), "passages")
    tables.drop()
    _released(docs.sparkSession)
    by_text = copies.join(once, "h", "left").join(passages.withColumn("long", F.lit(True)), "h", "left").select("h", "copies", "spans", "kept", "n_passages", "long")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    whole = F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))
    return short.join(by_text, "h").select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(gone, F.array(whole)).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))).alias("spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when((F.col("copies") > 1) & F.col("long"), F.lit(1).cast("long")).otherwise(F.coalesce("n_passages", F.lit(0).cast("long"))).alias("n_passages"),
    )
