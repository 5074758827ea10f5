"""Near-duplicate classes by BagMinHash.

A document is the multiset of its five-word shingles. Each shingle has a Poisson process over its weight axis, cut
into [0, 1), [1, 2), [2, 4), [4, 8) ... A signature component is the first point below the weight that falls to it, so
two components agree with the probability of the weighted Jaccard similarity, without bias. Points are found from coarse
to fine: an interval gives its first point, is then split into halves, and each half goes on by itself; halves above the weight
are never looked at. Drawing stops when no point can be the first any more. Bands of components propose
pairs, whole signatures rule most of the unlike ones out, and the multisets themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize
from . import arrow
from .components import components

U64 = np.uint64
#: The bound of what _likely() broadcasts: so many rows of a word number and 64 bits.
WORDS = 1 << 18
#: Pairs with one leader that share a copy of its text.
PAIRS = 256


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count) of the multisets.

    A document of fewer than ``size`` words has its words as its one shingle; one without words has none.
    """
    start, end, first = arrow.words(data, offsets)
    words = arrow.word_hashes(data, start, end, 5)
    lo, hi = first[:-1], first[1:]
    at, hashes = arrow.windows(words, first, size)
    doc = np.searchsorted(first, at, "right") - 1
    short = np.flatnonzero((hi - lo < size) & (hi > lo))
    whole = arrow.mix(arrow.range_hash(arrow.prefix_sums(words), lo[short], hi[short]) + (hi - lo)[short].astype(U64))
    doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, whole])
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    where = np.flatnonzero(new)
    return d[where], h[where], np.diff(np.append(where, len(d)))


def digests(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """128 bits of BLAKE2 of each text's words, one space between them."""
    text = data.tobytes()
    return [blake2b(b" ".join(text[a:b].split()), digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, m: int) -> np.ndarray:
    """The ids of the first points, m for each of n documents; documents without shingles have zeros."""
    level = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1  # intervals that the weight reaches
    owner = np.repeat(np.arange(len(count)), level)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(level) - level, level)
    low = np.where(step == 0, 0, 1 << np.maximum(step - 1, 0))
    width = np.where(step == 0, 1, 1 << np.maximum(step - 1, 0))
    seed = arrow.mix(shingle[owner] + step.astype(U64) * U64(0x9E3779B97F4A7C15))
    doc, weight = doc[owner], count[owner]
    first = np.full(n * m, np.inf)
    ids = np.zeros(n * m, U64)
    time, drawn = np.zeros(len(seed)), np.zeros(len(seed), U64)
    points = 1
    while len(seed):
        # unit intervals are not split: they give several points in a turn
        draw = arrow.mix(seed[:, None] + (drawn[:, None] + np.arange(1, points + 1, dtype=U64)[None, :]) * U64(0xD1B54A32D192ED03))
        uniform = ((draw >> U64(11)).astype(float) + 0.5) * 2.0**-53
        times = time[:, None] + np.cumsum(-np.log(uniform) / (width * float(m))[:, None], axis=1)
        mark = arrow.mix(draw ^ U64(0xA0761D6478BD642F))
        place = low[:, None] + width[:, None] * ((mark >> U64(32)).astype(float) * 2.0**-32)
        slot = doc[:, None] * m + ((mark & U64(0xFFFFFFFF)) % U64(m)).astype(np.int64)
        ok = (place < weight[:, None]) & (times < first[slot])
        wide = width > 1
        ok[wide, 1:] = False
        t, s, i = times[ok], slot[ok], draw[ok]
        np.minimum.at(first, s, t)
        best = first[s] == t
        ids[s[best]] = i[best]
        time = np.where(wide, times[:, 0], times[:, -1])
        live = time <= first.reshape(n, m).max(1)[doc]
        one, two = live & ~wide, live & wide
        half = width[two] // 2
        upper = low[two] + half < weight[two]
        join = lambda x, lower, higher: np.concatenate([x[one], lower, higher[upper]])
        left, right = (arrow.mix(seed[two] ^ U64(k)) for k in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))
        zero = np.zeros(len(half), U64)
        drawn = join(drawn + U64(points), zero, zero)
        low, width = join(low, low[two], low[two] + half), join(width, half, half)
        seed, doc, weight, time = join(seed, left, right), join(doc, doc[two], doc[two]), join(weight, weight[two], weight[two]), join(time, time[two], time[two])
        points = min(2 * points, 16)
    return ids.reshape(n, m)


def similarities(data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Weighted Jaccard of the shingles of texts 0 and 1, 2 and 3, and so on; two texts without words are alike."""
    doc, h, c = shingles(data, offsets, size)
    pairs = len(offsets) // 2
    pair = doc >> 1
    total = np.bincount(pair, c, pairs)
    order = np.lexsort((h, pair))
    p, h, c = pair[order], h[order], c[order]
    same = (p[1:] == p[:-1]) & (h[1:] == h[:-1])
    both = np.bincount(p[1:][same], np.minimum(c[1:], c[:-1])[same], pairs)
    return np.where(total > 0, both / np.maximum(total - both, 1), 1.0)


def _sketch(docs: DataFrame, id_col: str, text_at: int | None, size: int, bands: int, rows: int, carried: Column) -> DataFrame:
    """(row, id, print, total, bands, marks, carried): ``row`` numbers the rows, ``print`` is the digest of the words, ``total`` the
    shingles, ``marks`` a byte of each component.

    ``carried`` is the text, or a struct whose field ``text_at`` is the text.
    """
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 33, 0
        salt = np.arange(bands, dtype=U64) * U64(0xE7037ED1A0B428DB)
        for b in batches:
            texts = b.column(1) if text_at is None else b.column(1).field(text_at)
            for i, j, data, offsets in arrow.spans(texts, 1 << 18):
                k = j - i
                doc, h, c = shingles(data, offsets, size)
                total = np.bincount(doc, c, k).astype(np.int64)
                sig = signatures(doc, h, c, k, m)
                mixed = np.broadcast_to(salt[None, :] + U64(1), (k, bands)).copy()
                for r in range(rows):
                    mixed = arrow.mix(mixed ^ sig.reshape(k, bands, rows)[:, :, r]) * U64(0x9FB21C651E98DF25)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * bands), pa.array(mixed.ravel().view(np.int64)))
                marks = [x.tobytes() for x in (arrow.mix(sig) >> U64(56)).astype(np.uint8)]
                cols = [pa.array(np.arange(base + n, base + n + k)), b.column(0).slice(i, k), pa.array(digests(data, offsets), pa.binary()), pa.array(total), listed, pa.array(marks, pa.binary()), b.column(1).slice(i, k)]
                n += k
                yield pa.RecordBatch.from_arrays(cols, ["row", "id", "print", "total", "bands", "marks", "carried"])

    rows_in = docs.select(F.col(id_col).alias("id"), carried.alias("carried"))
    fields = [T.StructField("row", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("print", T.BinaryType()), T.StructField("total", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("marks", T.BinaryType()), rows_in.schema["carried"]]
    return rows_in.mapInArrow(arrow.trimmed(run), T.StructType(fields))


def least_agreement(m: int, similar: float, miss: float = 1e-6) -> int:
    """The agreeing components of m that a pair of this similarity falls short of with at most the chance ``miss``."""
    below, k = 0.0, 0
    while k < m:
        below += comb(m, k) * similar**k * (1 - similar) ** (m - k)
        if below > miss:
            break
        k += 1
    return k


def _likely(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows without most of those whose key is not among ``wanted``; an exact join must follow.

    A filter of bits with at most WORDS rows is broadcast, whatever the size of ``wanted``. The more there is, the fewer rows it holds back;
    it never holds back a wanted one.
    """
    hashed = F.xxhash64(key)
    word, bit = F.pmod(hashed, F.lit(WORDS)).cast("int"), F.pmod(F.shiftrightunsigned(hashed, 32), F.lit(64)).cast("int")
    bits = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    bits = materialize(bits, "bits")
    held = rows.select("*", word.alias("_at"), bit.alias("_bit"))
    return held.join(F.broadcast(bits), F.col("_at") == F.col("_word")).filter(F.expr("(shiftrightunsigned(_bits, _bit) & 1L) = 1L")).select(*rows.columns)


def _promising(pairs: DataFrame, marks: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in ``least`` components or more, by a byte of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b.column(n).to_pylist()), np.uint8).reshape(len(b), -1) for n in "xy")
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    side = lambda k, t: marks.select(F.col("node").alias(k), F.col("marks").alias(t))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(arrow.trimmed(run), "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose multisets reach ``least``, written. A leader of more than PAIRS pairs is dealt over several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # each pair's texts one after the other, in runs of whole pairs
            sizes = b.column("sizes").flatten().to_numpy().astype(np.int64)
            both = np.concatenate([[0], np.cumsum(sizes)])[::2]
            x, y = (b.column(n).to_pylist() for n in "xy")
            good, i = [], 0
            while i < len(b):
                j = min(len(b), max(i + 1, int(np.searchsorted(both, both[i] + (1 << 20), "right")) - 1))
                data = np.frombuffer(b"".join(t for k in range(i, j) for t in (x[k], y[k])), np.uint8)
                good.append(similarities(data, np.concatenate([[0], np.cumsum(sizes[2 * i : 2 * j])]), size) >= least)
                i = j
            if good:
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(np.concatenate(good)))

    busy = pairs.groupBy(F.col("b").alias("_b")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PAIRS)
    busy = materialize(busy.select("_b", F.ceil(F.col("n") / PAIRS).cast("int").alias("salts")), "busy")
    salted = pairs.join(busy, F.col("b") == F.col("_b"), "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    leaders = texts.join(pairs.select(F.col("b").alias("node")).distinct(), "node", "left_semi").join(busy, F.col("node") == F.col("_b"), "left")
    leaders = leaders.select(F.col("node").alias("b"), F.col("text").alias("y"), F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    leaders = materialize(leaders, "leaders")
    both = salted.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(leaders, ["b", "salt"])
    both = both.select("a", "b", "x", "y", F.array(F.octet_length("x"), F.octet_length("y")).alias("sizes"))
    with arrow.batches_of(pairs.sparkSession, 1000):
        return materialize(both.mapInArrow(arrow.trimmed(run), "a bigint, b bigint"), "verified")


def links_within(
    data: np.ndarray, offsets: np.ndarray, group: np.ndarray, block: np.ndarray, part: np.ndarray, size: int, least: float,
) -> list[tuple[int, int]]:
    """Links (i, j) between parts, for texts sorted by group: enough of them to connect all parts that any link connects.

    Texts of one group are compared with each other, or, if they are of two blocks, with those of the other block. Overlaps
    come from products of the matrix of texts and shared shingles, so no pair has a row of its own.
    """
    doc, h, c = shingles(data, offsets, size)
    n = len(group)
    total = np.bincount(doc, c, n)
    copy = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
    doc, key = np.repeat(doc, c), arrow.mix(np.repeat(h, c) + copy.astype(U64) * U64(0x9E3779B97F4A7C15))
    owner = group[doc]
    order = np.lexsort((key, owner))
    doc, key, owner = doc[order], key[order], owner[order]
    new = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))[: len(key)]
    column = np.cumsum(new) - 1
    shared = np.bincount(column, minlength=1)[column] > 1  # a shingle of one text only overlaps with nothing
    doc, column, owner = doc[shared], column[shared], owner[shared]
    found: list[tuple[int, int]] = []
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    for lo, hi in zip(starts, np.append(starts[1:], n), strict=True):
        a, b = np.searchsorted(owner, [group[lo], group[lo] + 1])
        d, col = doc[a:b] - lo, column[a:b]
        if not len(d):
            continue
        col = np.cumsum(np.append(0, col[1:] != col[:-1]))
        t, p, blk = total[lo:hi], part[lo:hi], block[lo:hi]
        crossed = blk.min() != blk.max()
        root = {}

        def find(x, root=root):
            while root.get(x, x) != x:
                x = root[x]
            return x

        for s in range(0, hi - lo, 512):
            e = min(s + 512, hi - lo)
            overlap = np.zeros((e - s, hi - lo), np.float32)
            for k in range(0, int(col[-1]) + 1, 1024):
                x, y = np.searchsorted(col, [k, k + 1024])
                grid = np.zeros((hi - lo, min(1024, int(col[-1]) + 1 - k)), np.float32)
                grid[d[x:y], col[x:y] - k] = 1
                overlap += grid[s:e] @ grid.T
            both = overlap.astype(float)  # float32 counts are whole, but their ratios would be rounded; as in similarities()
            near = both / np.maximum(t[s:e, None] + t[None, :] - both, 1) >= least
            near &= p[s:e, None] != p[None, :]
            if crossed:
                near &= blk[s:e, None] != blk[None, :]
            i, j = np.nonzero(near)
            if len(i):
                _, one = np.unique(np.stack([p[s + i], p[j]], 1), axis=0, return_index=True)
                for q in one:
                    x, y = find(p[s + i[q]]), find(p[j[q]])
                    if x != y:
                        root[x] = y
                        found.append((int(lo + s + i[q]), int(lo + j[q])))
    return found


def _settle(cells: DataFrame, member: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """Links that the stars miss: documents that meet in a cell are compared if the cell holds more than one class.

    A cell's documents are a group. Cells of many documents that share some are one group, so that a text
    that meets the same ones in many cells is compared once. Groups are cut into blocks of bounded size, and
    each two blocks meet in a task.
    """
    here = cells.join(member, "node", "left").select("cell", "node", "total", F.coalesce("component", "node").alias("part"))
    span = here.groupBy("cell").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high").select("cell", "n")
    here = materialize(here.join(span, "cell"), "open")
    large = here.filter("n > 256")
    joint = components(large.select(F.concat(F.lit("c"), "cell").alias("a"), F.concat(F.lit("n"), "node").alias("b")))
    joined = large.select("node", "total", "part").distinct().join(joint.select(F.substr("node", F.lit(2)).cast("bigint").alias("node"), F.col("component").alias("grp")), "node")
    small = here.filter("n <= 256").select(F.concat(F.lit("c"), "cell").alias("grp"), "node", "total", "part")
    members = materialize(small.unionByName(joined.select("grp", "node", "total", "part")), "groups")
    blocks = members.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / 2048), F.ceil(F.sum("total") / (1 << 20)), F.lit(1)).cast("int").alias("blocks"))
    dealt = members.join(blocks, "grp").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("grp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "part")
    dealt = dealt.join(texts.select("node", F.col("text").cast("binary").alias("text")), "node").repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(t: pa.Table, group: np.ndarray) -> pa.RecordBatch:
            texts = t.column("text").to_pylist()
            _, part = np.unique(np.array(t.column("part").to_pylist()), return_inverse=True)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
            got = links_within(np.frombuffer(b"".join(texts), np.uint8), offsets, group, t.column("own").to_numpy(), part, size, least)
            node = t.column("node").to_pylist()
            return pa.RecordBatch.from_arrays([pa.array([node[i] for i, _ in got], pa.int64()), pa.array([node[j] for _, j in got], pa.int64())], ["a", "b"])

        def groups(t: pa.Table) -> np.ndarray:
            keys = list(zip(*[t.column(c).to_pylist() for c in ("grp", "lo", "hi")], strict=True))
            return np.cumsum([0] + [x != y for x, y in zip(keys[1:], keys[:-1], strict=True)]) if keys else np.zeros(0, np.int64)

        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            g = groups(t)
            size_of = np.cumsum([0] + [len(x.as_py()) for x in t.column("text")])
            i = 0
            last = int(np.searchsorted(g, g[-1])) if len(g) else 0  # the last group may go on in the next batch
            while i < last:
                j = int(np.searchsorted(size_of, size_of[i] + (1 << 20)))
                j = last if j >= last else max(int(np.searchsorted(g, g[j])), int(np.searchsorted(g, g[i], "right")))
                yield links(t.slice(i, j - i), g[i:j])
                i = j
            held = t.slice(last)
        if held is not None and len(held):
            yield links(held, groups(held))

    with arrow.batches_of(cells.sparkSession, 1000):
        return materialize(dealt.mapInArrow(arrow.trimmed(run), "a bigint, b bigint"), "settled")


def classes(docs: DataFrame, similar: float = 0.8, size: int = 5, bands: int = 30, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (id, class_id, copies).

    ``class_id`` is the least id of the connected class of documents whose shingle multisets have a
    weighted Jaccard similarity of at least ``similar``; ``copies`` counts the rows of the same words, by a digest of 128 bits. Rows of the
    same words are
    one node from the start, so copies never meet each other. A pair of the least similarity shares no band
    with the chance (1 - similar ** rows) ** bands, 7e-6 as set here, and its signatures agree too little with a chance of 1e-6; every other
    pair that shares a band is
    decided by its multisets, unless its documents are in one class already. First each document is compared with
    one leader of each of its cells; then the cells that still hold more than one class are compared in blocks.

    A null text has no words and is one class with other texts without words; a class of rows without ids
    has a null class_id; repeated rows are copies; an empty table gives no rows; other columns are not read.
    """
    sketch, found = _classes(docs, similar, size, bands, rows, id_col, F.coalesce(F.col(text_col), F.lit("")))
    return sketch.select("id", "print").join(found, "print").select(F.col("id").alias(id_col), F.col("least.id").alias("class_id"), "copies")


def _classes(
    docs: DataFrame, similar: float, size: int, bands: int, rows: int, id_col: str, carried: Column, text_col: str | None = None,
    text_at: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The sketch of docs, and (print, least, copies): ``least`` is the first row (no id last; id; row) of the class."""
    with arrow.batches_of(docs.sparkSession, 1000):
        sketch = materialize(_sketch(docs, id_col, text_at, size, bands, rows, carried), "sketch")
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    nodes = sketch.groupBy("print").agg(F.min("row").alias("node"), F.min(place).alias("least"), F.count(F.lit(1)).alias("copies"), F.max("total").alias("total"))
    nodes = materialize(nodes, "nodes")
    # a node goes by the number of its first row
    every = sketch.select(F.col("row").alias("node"), "total", "bands")
    reps = every.join(nodes.filter("total > 0").select("node"), "node", "left_semi")
    cells = reps.select("node", "total", F.explode("bands").alias("cell"))
    met = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader"), F.min_by("total", "node").alias("leader_total")).filter("n > 1")
    cells = materialize(cells.join(met, "cell"), "cells")  # only cells where documents meet
    wanted = materialize(cells.select("node").distinct(), "wanted")
    text = F.col("carried") if text_col is None else F.coalesce(F.col("carried")[text_col], F.lit(""))
    texts = _likely(sketch.select(F.col("row").alias("node"), text.cast("binary").alias("text")), "node", wanted)
    texts = materialize(texts.join(wanted, "node", "left_semi"), "texts")  # of the documents that meet others, for all that follows
    near = F.least("total", "leader_total") >= F.greatest("total", "leader_total") * F.lit(similar) - F.lit(1e-9)
    pairs = cells.filter(near & (F.col("node") != F.col("leader"))).select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    pairs = materialize(_promising(materialize(pairs, "met"), _likely(sketch.select(F.col("row").alias("node"), "marks"), "node", wanted), least_agreement(bands * rows, similar)), "pairs")
    links = _verified(pairs, texts, size, similar)
    member = materialize(components(links), "members")

    more = _settle(cells, member, texts, size, similar)
    if not more.isEmpty():
        member = materialize(components(links.unionByName(more)), "members")

    parts = nodes.join(member, "node", "left").withColumn("part", F.coalesce("component", "node"))
    heads = parts.groupBy("part").agg(F.min("least").alias("least"))
    return sketch, parts.select("print", "part", "copies").join(heads, "part").select("print", "least", "copies")


def keep_one(docs: DataFrame, similar: float = 0.8, size: int = 5, bands: int = 30, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of classes(), with all of its columns whatever those are called.

    The row of the least id stays, and among equal ids the first in the table; rows without an id come after all others. Rows without words,
    null texts among them, are one class, too;
    repeated rows are copies; an empty table gives an empty one.
    """
    sketch, found = _classes(docs, similar, size, bands, rows, id_col, F.struct(*docs.columns), text_col, docs.columns.index(text_col))
    kept = found.select(F.col("least.row").alias("row")).distinct()
    return sketch.join(kept, "row", "left_semi").select("carried.*")
