"""Near-duplicates by ProbMinHash over five-word shingles of equal weight, banding, and exact verification.

Each shingle throws points of a Poisson process at the registers of a signature; a register keeps the shingle of its
earliest point. A shingle stops once its next point comes later than every register's, so most shingles throw few. The
weight of a shingle, its rate, is 1 however often it repeats, since links are defined by sets: registers then agree with
the set similarity itself, and two documents of similarity 0.8 share no band with probability (1 - 0.8^5)^32 = 3e-6.
Documents that share a band are candidates, and candidates with a Jaccard similarity of shingle sets of at least 0.8
are linked. Documents of the same words are one node from the start.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Memo, Tables, cut, in_arrow, numbered
from .components import components

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 32, 5
REGISTERS = BANDS * ROWS
_BATCH = 256
#: Rows of a bucket up to which members of different components are compared with each other.
_SMALL = 16
#: About so many pairs of one pivot are compared in one place.
_PART = 64
#: Rounds of comparisons with a further pivot go on while they bring the rows outside main components below this share.
_SHRINK = 0.8

_word_hash = Memo(lambda w: xxhash.xxh3_64_intdigest(w) >> 1, lasting=True)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Different shingle hashes in order, their counts, and a digest of the words.

    A text of fewer words than a shingle is one shingle of them all; a text without words has none.
    """
    w = numbered(text, _word_hash.__getitem__).astype(np.uint64)
    digest = hashlib.blake2b(w.tobytes(), digest_size=16).digest()
    if not len(w):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), digest
    k, n = min(SHINGLE, len(w)), max(1, len(w) - SHINGLE + 1)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n])
    return *np.unique(h, return_counts=True), digest


def signatures(sets: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """The shingle in each register (documents x REGISTERS) of non-empty documents."""
    docs, m = len(sets), REGISTERS
    x, wait = np.concatenate(sets), 1 / np.concatenate(weights)
    doc = np.repeat(np.arange(docs), [len(s) for s in sets])
    first, kept = np.full(docs * m, np.inf), np.zeros(docs * m, np.uint64)
    latest = np.full(docs, np.inf)
    alone = np.array([len(s) == 1 for s in sets])
    kept.reshape(docs, m)[alone] = np.array([s[0] for s in sets], np.uint64)[alone, None]  # its points fill every register
    go = np.flatnonzero(~alone[doc])
    time, step = np.zeros(len(x)), 0
    while len(go):
        step += 1
        r = mix(x[go] + np.uint64((step * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        # 40 bits give the waiting time, the others the register.
        time[go] -= np.log(((r >> np.uint64(24)) + np.uint64(1)).astype(np.float64) / float(1 << 40)) * wait[go]
        at = doc[go] * m + ((r & np.uint64(0xFFFFFF)) * np.uint64(m) >> np.uint64(24)).astype(np.int64)
        now = np.flatnonzero(time[go] < first[at])
        # Later points are written first, so that the earliest stays.
        now = now[np.lexsort((x[go[now]], -time[go[now]]))]
        first[at[now]], kept[at[now]] = time[go[now]], x[go[now]]
        touched = np.unique(doc[go])
        latest[touched] = first.reshape(docs, m)[touched].max(1)
        go = go[time[go] < latest[doc[go]]]
    return kept.reshape(docs, m)


def bands(signature: np.ndarray) -> np.ndarray:
    """A key for each band (documents x BANDS)."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return h.view(np.int64)


def _key(id_col: str, text_col: str) -> Column:
    """16 bytes that name a row by its id and text, null as empty."""
    own = F.concat(F.when(F.col(id_col).isNull(), "n").otherwise("i"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\0"), F.coalesce(F.col(text_col), F.lit("")))
    return F.substring(F.unhex(F.sha2(own, 256)), 1, 16)


def _held(docs: DataFrame, id_col: str, text_col: str, tables: Tables) -> tuple[DataFrame, str, str]:
    """docs bucketed by `key`, with their columns named by place, so that no later join moves a text; names of id and text."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    keyed = docs.withColumnsRenamed(names).withColumn("key", _key(names[id_col], names[text_col]))
    return tables.bucketed(keyed, "near_docs", "key"), names[id_col], names[text_col]


def sign(held: DataFrame, id_col: str, text_col: str, tables: Tables) -> DataFrame:
    """id, key, digest (of the words), bands array<long> (empty without words) of each row, as a written table."""
    kind = held.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, _BATCH) for i in range(0, batch.num_rows, _BATCH)):
                found = [shingles(t) for t in part.column(2).to_pylist()]
                some = [i for i, f in enumerate(found) if len(f[0])]
                keys = bands(signatures([found[i][0] for i in some], [np.ones(len(found[i][0])) for i in some])) if some else np.zeros((0, BANDS), np.int64)
                sizes = np.zeros(part.num_rows + 1, np.int32)
                sizes[[i + 1 for i in some]] = BANDS
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([f[2] for f in found], pa.binary()), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(keys.ravel()))],
                    names=["id", "key", "digest", "bands"],
                )

    rows = held.select(F.col(id_col).alias("id"), "key", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return tables.cut(in_arrow(rows, run, f"id {kind}, key binary, digest binary, bands array<long>"), "near-signed")


def _sets(held: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """node, size, set (shingle hashes, little-endian) of the wanted nodes (columns key, node), read from the row of that key."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, _BATCH) for i in range(0, batch.num_rows, _BATCH)):
                found = [shingles(t)[0] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], names=["node", "size", "set"])

    rows = held.select("key", F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(wanted.hint("merge"), "key").select("node", "text")
    return in_arrow(rows, run, "node long, size long, set binary")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (x, y) as links (a, b) whose sets have at least that Jaccard similarity; not written, so read it once.

    The sets are bucketed by node, so only those of the pairs move: each y's to a part of its x, and each x's to its parts.
    """

    def run(batches):
        for batch in batches:
            hold = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                lo, hi = sorted((len(s), len(t)))
                ok = lo >= similarity * hi
                if ok:
                    both = np.sort(np.concatenate([s, t]), kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    ok = shared >= similarity * (lo + hi - shared) - 1e-9
                hold.append(ok)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(hold, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    one = pairs.select("x", "part").distinct().hint("merge").join(sets, F.col("x") == sets["node"]).select("x", "part", F.col("set").alias("set_x"))
    other = pairs.hint("merge").join(sets, F.col("y") == sets["node"]).select("x", "y", "part", F.col("set").alias("set_y"))
    return in_arrow(other.join(one.hint("merge"), ["x", "part"]).select("x", "y", "set_x", "set_y"), run, "a long, b long")


def _pairs(pairs: DataFrame, tested: DataFrame | None, tables: Tables) -> DataFrame:
    """x, y, part of the pairs (x, y, n), each once whatever the side, that are not among the tested ones.

    n: size of the group that a pair comes from; the pairs of one x are dealt into parts by it.
    """
    p = pairs.select("x", "n", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).groupBy("a", "b").agg(F.max("x").alias("x"), F.max("n").alias("n"))
    if tested is not None:
        p = p.join(tested.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).hint("merge"), ["a", "b"], "left_anti")
    p = p.select("x", F.when(F.col("x") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("y"), "n")
    return tables.cut(p.select("x", "y", F.pmod(F.xxhash64("y"), F.ceil(F.col("n") / _PART)).alias("part")), "near-pairs")


def _prefixes(sets: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """node, comp, rest, shingle: the rarest shingles of each of the nodes (columns node, comp, rest, least).

    Two sets with an overlap of o have a common one among the size - o + 1 rarest of either, in any order of shingles
    that is the same for both. o is what similarity to the smallest possible partner needs: at least `least` shingles.
    Shingles that no other of the nodes has take their places but are left out, as they match nothing.
    """

    def run(batches):
        for batch in batches:
            flat = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
            size = [len(x) for x in flat]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(size)), size))), pa.array(np.concatenate(flat))], names=["node", "shingle"])

    held = sets.join(nodes.hint("merge"), "node")
    rows = in_arrow(held.select("node", "set"), run, "node long, shingle long")
    common = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = rows.join(common.hint("merge"), "shingle").withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("df", "shingle")))
    own = ranked.groupBy("node").agg(F.max("rank").alias("known"))
    overlap = F.ceil(similarity / (1 + similarity) * (F.col("size") + F.greatest(F.col("least"), F.ceil(similarity * F.col("size") - 1e-6))) - 1e-6)
    places = held.join(own.hint("merge"), "node").select("node", "comp", "rest", (F.col("known") - overlap + 1).alias("places"))
    return ranked.join(places.hint("merge"), "node").filter("rank <= places").select("node", "comp", "rest", "shingle")


def linked(held: DataFrame, signed: DataFrame, nodes: DataFrame, text_col: str, similarity: float, tables: Tables) -> DataFrame:
    """node, component of every node that has a verified link: components of all nodes that share bands and are similar enough.

    A bucket's members are compared with one pivot, the one that shares most bands with others, not with each other.
    Members outside a bucket's largest component are compared with the most central of them, round after round while
    that brings components together. Members of different components that are left are compared with each other in
    small buckets, and in large ones where their rarest shingles meet, which they must if they are similar. So no link
    that would join two components is left out, and no bucket is gathered in one place.

    Each round's links are added to the components so far. Joins are by merging: a table that happens to be small
    would else be built in the driver, at some megabytes of heap each, and there are dozens of joins.
    """
    rows = nodes.select("node", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = F.sum("n").over(Window.partitionBy("node"))  # over at most BANDS rows
    members = tables.cut(rows.join(shared.hint("merge"), "band").withColumn("met", met), "near-members")
    pivots = members.groupBy("band").agg(F.max(F.struct("met", "node")).alias("p")).select("band", F.col("p.node").alias("pivot"))
    sets = _sets(held, nodes.join(members.select("node").distinct().hint("merge"), "node").select("node", "key"), text_col)
    if _repeated(signed).limit(1).count():  # rows that repeat must not repeat sets
        sets = sets.dropDuplicates(["node"])
    sets = tables.bucketed(sets, "near_sets", "node")
    tested = _pairs(members.join(pivots.hint("merge"), "band").filter("node != pivot").select(F.col("pivot").alias("x"), F.col("node").alias("y"), "n"), None, tables)
    at = components(_verified(tested, sets, similarity), tables=tables)
    members, before = members.select("band", "node", "met", "n"), None
    while True:
        placed = members.join(at.hint("merge"), "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        main = placed.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("band").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("c", "comp")).alias("m")).filter("comps > 1")
        members = tables.cut(placed.join(main.select("band", F.col("m.comp").alias("main")).hint("merge"), "band").withColumn("rest", F.col("comp") != F.col("main")), "near-open")
        some, left = members.agg(F.count(F.lit(1)), F.count_if(F.expr(f"rest AND n > {_SMALL}"))).first()
        if not some:
            return at
        if before is not None and left > _SHRINK * before or before == 0:
            break
        rest = members.filter("rest")
        pivots = rest.filter(F.col("n") > _SMALL).groupBy("band").agg(F.max(F.struct("met", "node")).alias("p")).select("band", F.col("p.node").alias("pivot"))
        new = rest.join(pivots.hint("merge"), "band").filter("node != pivot").select(F.col("pivot").alias("x"), F.col("node").alias("y"), "n")
        if before is None:
            few = members.filter(F.col("n") <= _SMALL)
            other = few.select("band", F.col("node").alias("y"), F.col("comp").alias("comp_y"), F.col("rest").alias("rest_y"))
            new = new.unionByName(few.filter("rest").join(other.hint("merge"), "band").filter("comp != comp_y AND (NOT rest_y OR node < y)").select(F.col("node").alias("x"), "y", "n"))
        new = _pairs(new, tested, tables)
        at, tested = _added(at, _verified(new, sets, similarity), tables), tested.unionByName(new)
        before, members = left, members.select("band", "node", "met", "n")
        if not left:
            return at
    large = members.filter(F.col("n") > _SMALL)
    least = large.join(sets.select("node", "size").hint("merge"), "node").groupBy("band").agg(F.min("size").alias("least"))
    last = tables.cut(large.join(least.hint("merge"), "band").groupBy("node").agg(F.first("comp").alias("comp"), F.max("rest").alias("rest"), F.min("least").alias("least")), "near-last")
    rare = tables.cut(_prefixes(sets, last, similarity), "near-rare")
    mixed = rare.groupBy("shingle").agg(F.min("comp").alias("p"), F.max("comp").alias("q")).filter("p != q").select("shingle")
    rare = rare.join(mixed.hint("merge"), "shingle")
    other = rare.select("shingle", F.col("node").alias("y"), F.col("comp").alias("comp_y"), F.col("rest").alias("rest_y"))
    new = rare.filter("rest").join(other.hint("merge"), "shingle").filter("comp != comp_y AND (NOT rest_y OR node < y)").select(F.col("node").alias("x"), "y", F.lit(1).alias("n"))
    return _added(at, _verified(_pairs(new, tested, tables), sets, similarity), tables)


def _added(at: DataFrame, links: DataFrame, tables: Tables) -> DataFrame:
    """The components at (node, component) with further links (a, b)."""
    return components(at.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links), tables=tables)


def _repeated(signed: DataFrame) -> DataFrame:
    """The keys of rows that come several times, with words."""
    return signed.filter(F.size("bands") > 0).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")


def _classes(held: DataFrame, id_col: str, text_col: str, similarity: float, tables: Tables) -> DataFrame:
    """id, key, comp, class_id of every row, written; comp and class_id are null without words."""
    signed = sign(held, id_col, text_col, tables)
    some = signed.filter(F.size("bands") > 0)
    # Numbered once and written, so that pairs, links and components are of numbers.
    nodes = some.groupBy("digest").agg(F.min("id").alias("least"), F.min(F.struct("key", "bands")).alias("r"))
    nodes = tables.cut(nodes.select("digest", F.monotonically_increasing_id().alias("node"), "least", "r.key", "r.bands"), "near-nodes")
    at = linked(held, signed, nodes, text_col, similarity, tables)
    placed = tables.cut(nodes.join(at.hint("merge"), "node", "left").select("digest", "least", F.coalesce("component", "node").alias("comp")), "near-placed")
    # Written, so that the join on a class of very many nodes can be split.
    least = tables.cut(placed.groupBy("comp").agg(F.min("least").alias("class_id")), "near-least")
    rows = signed.select("id", "key", "digest", (F.size("bands") > 0).alias("some"))
    by = placed.join(least.hint("merge"), "comp").select("digest", "comp", "class_id")
    words = rows.filter("some").join(by.hint("merge"), "digest").select("id", "key", "comp", "class_id")
    none = rows.filter("NOT some").select("id", "key", F.lit(None).cast("long").alias("comp"), F.lit(None).cast(signed.schema["id"].dataType).alias("class_id"))
    return cut(words.unionByName(none), "near-rows")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """id_col, class_id of every row: the smallest id of the documents that it is linked to, over any path.

    Null texts and texts without words are in no class but their own; of texts shorter than a shingle only those of
    the same words are alike. Repeated rows stay and share a class; null ids stay (a class of nulls alone has a null
    id). No documents: no rows. Extra columns are ignored.
    """
    tables = Tables(docs.sparkSession)
    held, i, t = _held(docs.select(id_col, text_col), id_col, text_col, tables)
    rows = _classes(held, i, t, similarity, tables)
    tables.drop()
    return rows.select(F.col("id").alias(id_col), F.when(F.col("comp").isNotNull(), F.col("class_id")).otherwise(F.col("id")).alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs, all columns as it is, of each class: that of the smallest id, then of the smallest key of id and text.

    Rows are told apart by id and text, so unlike texts that share an id both stay, and of rows that repeat both one
    stays. Null ids come after all others; null texts and texts without words stay, as they are in no class.
    """
    tables = Tables(docs.sparkSession)
    held, i, t = _held(docs, id_col, text_col, Tables(docs.sparkSession))  # read by the result, so it stays
    rows = _classes(held, i, t, similarity, tables).filter("comp IS NOT NULL")
    keeper = tables.cut(rows.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("k")).select("comp", F.col("k.key").alias("kept")), "near-kept")
    gone = cut(rows.join(keeper.hint("merge"), "comp").filter("key != kept").select("key").distinct(), "near-gone")
    again = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "near-again")
    tables.drop()
    kept = held.join(gone, "key", "left_anti")
    if again.limit(1).count():
        once = kept.join(again, "key", "left_semi").dropDuplicates(["key"])
        kept = kept.join(again, "key", "left_anti").unionByName(once)
    return kept.select(*(F.col(f"c{n}").alias(c) for n, c in enumerate(docs.columns)))
