"""Op 5. Jaccard join on word n-grams with Bayesian pruning of MinHash candidates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import (WordHashes, chunks, flat, may_contain, mix, shuffle_partitions,
                                 whole_rows, window_hashes)
from newsloom.llm.components import components
from newsloom.session import materialize

WORDS, THRESHOLD = 5, 0.8
# A pair at the threshold shares a band with probability 1 - (1 - 0.8^7)^58 = 1 - 1.2e-6.
BANDS, ROWS = 58, 7
COMPARED, STEP = 128, 16  # MinHash values compared with each other, so many at a time
TOLERANCE = 1e-6


def shingle_hashes(values: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``size`` words and where each text's begin (one more).

    A text of fewer words, but not none, has one run: all its words.
    """
    counts = np.diff(starts)
    whole = window_hashes(values, size)
    each = np.maximum(counts - size + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < size))
    each[short] = 1
    out_starts = np.append(0, np.cumsum(each))
    out = np.empty(out_starts[-1], np.uint64)
    long_ones = np.flatnonzero(counts >= size)
    if len(long_ones):
        n = each[long_ones]
        ends = np.cumsum(n)
        steps = np.arange(ends[-1]) - np.repeat(ends - n, n)
        out[np.repeat(out_starts[long_ones], n) + steps] = whole[
            np.repeat(starts[long_ones], n) + steps]
    for k in short.tolist():
        run = values[starts[k]:starts[k + 1]]
        out[out_starts[k]] = mix(window_hashes(run, len(run)))[0]
    return out, out_starts


def signatures(hashes: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """``count`` MinHash values (32 bits) for each text that has shingles; a row each."""
    some = np.flatnonzero(np.diff(starts))
    out = np.zeros((len(starts) - 1, count), np.uint32)
    if not len(some):
        return out
    small = (hashes >> np.uint64(32)).astype(np.uint32)
    at = starts[:-1][some]
    factors = np.random.default_rng(20_240_501).integers(1 << 31, 1 << 32, count, np.uint32) | 1
    for k, factor in enumerate(factors):
        scaled = small * factor
        out[some, k] = np.minimum.reduceat(scaled ^ (scaled >> np.uint32(15)), at)
    return out


def least_matches(threshold: float, tolerance: float, compared: int = COMPARED,
                  step: int = STEP) -> np.ndarray:
    """For 1, 2, ... steps, the fewest matches with P(similarity >= threshold) >= tolerance.

    After m matches of n the similarity has the density of Beta(m + 1, n - m + 1): the
    probability of at least t is that of at most m successes in n + 1 draws with chance t.
    """
    out = []
    for n in range(step, compared + 1, step):
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return np.array(out)


def _documents(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(doc_id, copy, node, n, bands): ``node`` is a hash of the text's words (null: it has none),
    ``n`` the size of its set of runs of words, ``bands`` the hashes of its MinHash bands."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("copy", T.LongType()),
        T.StructField("node", T.BinaryType()), T.StructField("n", T.LongType()),
        T.StructField("bands", T.BinaryType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, kind = WordHashes(), None

        def typed():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("doc_id").type
                yield batch

        for ids, copies, texts in chunks(typed(), ["doc_id", "copy", "text"], "text", 4 << 20):
            values, starts = flat(texts, True, words)
            runs, at = shingle_hashes(values, starts, size)
            found = signatures(runs, at, BANDS * ROWS).astype(np.uint64)
            bands = np.stack([window_hashes(found[:, k * ROWS:(k + 1) * ROWS].ravel(), ROWS)[::ROWS]
                              + np.uint64(k) for k in range(BANDS)], axis=1)
            nodes = [xxhash.xxh3_128_digest(values[a:b].tobytes()) if b > a else None
                     for a, b in zip(starts[:-1], starts[1:])]
            sizes = [len(np.unique(runs[a:b])) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, kind), pa.array(copies, pa.int64()), pa.array(nodes, pa.binary()),
                pa.array(sizes, pa.int64()), pa.array([row.tobytes() for row in bands], pa.binary())],
                schema.fieldNames())

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("copy"),
                       F.col(text).alias("text"))
    return rows.mapInArrow(hashed, schema)


def _band_stars(nodes: DataFrame) -> DataFrame:
    """(u, v): a node that shares a band with others, and the least of them.

    Bands travel as packed numbers, a bucket of them to each group; a band of any number of nodes
    gives one edge for each node but one. Nodes are the first 64 bits of their hashes here: a
    collision would only put two components of candidates together.
    """
    buckets = 4 * shuffle_partitions(nodes.sparkSession, nodes, 16 << 20)
    sent = T.StructType([T.StructField("bucket", T.IntegerType()),
                         T.StructField("payload", T.BinaryType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">i8")[::2].astype(np.int64)
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, BANDS)
            pairs = np.stack((keys.ravel(), np.repeat(names, BANDS).view(np.uint64)), axis=1)
            place = (mix(pairs[:, 0].copy()) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(place, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
                if len(part):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([place[part[0]]], pa.int32()),
                         pa.array([pairs[part].tobytes()], pa.binary())], ["bucket", "payload"])

    def meet(table: pa.Table) -> pa.Table:
        pairs = np.frombuffer(b"".join(table.column("payload").to_pylist()), "<u8").reshape(-1, 2)
        names = pairs[:, 1].copy().view(np.int64)
        order = np.lexsort((names, pairs[:, 0]))
        keys, names = pairs[order, 0], names[order]
        first = np.append(True, keys[1:] != keys[:-1])
        least = names[first][np.cumsum(first) - 1]
        late = names != least
        edges = np.unique(np.stack((names[late], least[late]), axis=1), axis=0)
        return pa.table({"u": edges[:, 0], "v": edges[:, 1]})

    return nodes.select("node", "bands").mapInArrow(deal, sent).groupBy("bucket").applyInArrow(
        meet, "u long, v long")


def block_pairs(nodes: DataFrame, size: int, threshold: float) -> DataFrame:
    """Each node once for every block pair it belongs to: its columns, ``pair`` and ``side``.

    ``nodes`` has a ``root`` (component of candidates), a ``node`` and its size ``n``. A component is cut into classes of
    sizes, of which only neighbours can hold similar texts, and a class by a hash into blocks of
    about ``size`` nodes. ``side`` is null for a block with itself, else 0 or 1.
    """
    counts = nodes.groupBy("root").agg(F.count("*").alias("total"))
    classed = nodes.join(counts, "root").withColumn("class", F.when(
        F.col("total") <= size, 0).otherwise(
        F.floor(F.log("n") / -math.log(threshold) + 1e-9)).cast("long")).drop("total")
    parts = materialize(classed.groupBy("root", "class").agg(
        F.ceil(F.count("*") / size).cast("int").alias("blocks")), "near-classes")
    for name, step in (("blocks", 0), ("above", 1), ("below", -1)):
        near = parts.select(F.col("root").alias("r"), (F.col("class") - step).alias("c"),
                            F.col("blocks").alias(name))
        classed = classed.join(near, (F.col("root") == F.col("r")) & (F.col("class") == F.col("c")),
                               "left").drop("r", "c")
    own = F.pmod(F.xxhash64(F.col("node"), F.lit(7)), F.col("blocks")).cast("int")

    def pairs(count, make):
        many = F.coalesce(F.col(count), F.lit(0))
        return F.when(many > 0, F.transform(F.sequence(F.lit(0), many - 1), make)).otherwise(
            F.array().cast("array<struct<class:bigint,a:int,b:int,up:boolean,side:int>>"))

    def entry(cls, a, b, up, side):
        return F.struct(cls.alias("class"), a.alias("a"), b.alias("b"), F.lit(up).alias("up"),
                        side.cast("int").alias("side"))

    same = pairs("blocks", lambda j: entry(
        F.col("class"), F.least(own, j), F.greatest(own, j), False,
        F.when(own == j, None).when(own < j, 0).otherwise(1)))
    above = pairs("above", lambda j: entry(F.col("class"), own, j, True, F.lit(0)))
    below = pairs("below", lambda j: entry(F.col("class") - 1, j, own, True, F.lit(1)))
    out = classed.withColumn("p", F.explode(F.concat(same, above, below)))
    return out.select(
        F.xxhash64("root", "p.class", "p.a", "p.b", "p.up").alias("pair"),
        F.col("p.side").alias("side"), *[c for c in nodes.columns if c not in ("root", "n")])


def _links(rows: DataFrame, size: int, threshold: float, tolerance: float) -> DataFrame:
    """(node, links, parent): links of a node in a block pair, and an edge of a spanning forest.

    All pairs of a block pair are compared by their MinHash values, some at a time; the posterior
    probability of reaching the threshold drops them. The rest are verified by their sets.
    """
    least = least_matches(threshold, tolerance)
    schema = "node binary, links long, parent binary"

    def verify(table: pa.Table) -> pa.Table:
        words = WordHashes()
        nodes = table.column("node").to_pylist()
        copies = np.array(table.column("copies").to_pylist(), np.int64)
        sides = np.array([-1 if s is None else s for s in table.column("side").to_pylist()])
        values, starts = flat(table.column("text").to_pylist(), True, words)
        runs, at = shingle_hashes(values, starts, size)
        marks = signatures(runs, at, COMPARED)
        sets = [np.unique(runs[a:b]) for a, b in zip(at[:-1], at[1:])]
        names, local = np.unique(np.concatenate(sets), return_inverse=True)
        sizes = np.array([len(s) for s in sets])
        ends = np.cumsum(sizes)
        member = np.zeros(len(names), bool)
        links = np.zeros(len(nodes), np.int64)
        parent = np.arange(len(nodes))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i in range(len(nodes)):
            other = np.arange(i + 1, len(nodes)) if sides[i] < 0 else (
                np.flatnonzero(sides == 1) if sides[i] == 0 else np.empty(0, np.int64))
            small, large = np.minimum(sizes[other], sizes[i]), np.maximum(sizes[other], sizes[i])
            other = other[small >= threshold * large]
            matched = np.zeros(len(other), np.int64)
            for k, needed in enumerate(least):
                part = slice(k * STEP, (k + 1) * STEP)
                matched += (marks[other, part] == marks[i, part]).sum(axis=1)
                keep = matched >= needed
                other, matched = other[keep], matched[keep]
            if not len(other):
                continue
            own = local[ends[i] - sizes[i]:ends[i]]
            member[own] = True
            if len(other) * 4 > len(nodes):
                common = np.add.reduceat(member[local].astype(np.int64), ends - sizes)[other]
            else:
                common = np.array([member[local[ends[j] - sizes[j]:ends[j]]].sum() for j in other])
            member[own] = False
            linked = other[common >= threshold * (sizes[other] + sizes[i] - common) - 1e-9]
            links[i] += copies[linked].sum()
            links[linked] += copies[i]
            for j in linked.tolist():
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        some = np.flatnonzero(links)
        return pa.table({"node": pa.array([nodes[i] for i in some], pa.binary()),
                         "links": pa.array(links[some]),
                         "parent": pa.array([nodes[root(i)] for i in some], pa.binary())})

    return rows.groupBy("pair").applyInArrow(verify, schema)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    words: int = WORDS, threshold: float = THRESHOLD,
                    tolerance: float = TOLERANCE, block: int = 256) -> DataFrame:
    """(doc_id, copy, class_id, copy_of, n_links, keep) of each document.

    Documents are linked if the Jaccard similarity of their sets of ``words``-word runs is at least
    ``threshold``; words are those of ``folded_words``, and a text of fewer words has one run of
    them all. ``n_links`` counts the other documents a document is linked to, ``class_id`` is the
    least id of its connected component, ``copy_of`` that of the documents with the same words,
    and ``keep`` marks one document of each class, the least by (id, hash of the text). ``copy`` is
    that hash.

    Equal texts are one node. MinHash bands give candidates: nodes of one band get one edge each,
    and a component of those edges holds all pairs that share a band. Its nodes meet in block
    pairs of bounded size, where Bayesian pruning and exact verification leave counts and a
    spanning forest, never pairs. A link is missed if its texts share no band: a chance of
    (1 - s^7)^58, 1.2e-6 at similarity 0.8; or if pruning drops it: ``tolerance`` at most.

    A null or empty text, or one without words, has no links and a class of its own. Null ids
    stay and count as least; a class has the null id only if all of its ids are null. A row that
    is repeated is linked to its copies, and all its copies carry ``keep`` if one does. Other
    columns are not read. An empty table gives no rows.
    """
    rows = materialize(_documents(docs, doc_id, text, words), "near-documents")
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "copy")
    nodes = materialize(rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.min(order).alias("first"), F.min("doc_id").alias("least"), F.count("*").alias("copies"),
        F.first("n").alias("n"), F.first("bands").alias("bands")), "near-nodes")
    short = F.conv(F.substring(F.hex("node"), 1, 16), 16, -10).cast("long")
    found = components(_band_stars(nodes))
    grouped = nodes.drop("bands").withColumn("short", short).join(
        found, F.col("short") == found["node"]).select(
        nodes["node"], "root", "n", "copies", F.col("first.doc_id").alias("doc_id"),
        F.col("first.copy").alias("copy"))
    grouped = materialize(grouped, "near-grouped")
    texts = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("copy"),
                        F.col(text).alias("text"))
    texts = may_contain(texts, "copy", grouped).filter("__may").select(
        "d", F.col("copy").alias("c"), "text")
    # Copies of one row would meet twice in a block: one of them is enough.
    involved = grouped.join(texts, grouped["doc_id"].eqNullSafe(texts["d"])
                            & (grouped["copy"] == texts["c"])).groupBy(
        "node", "root", "n", "copies", "doc_id", "copy").agg(F.first("text").alias("text"))
    involved = materialize(involved, "near-texts")
    paired = block_pairs(involved.select("node", "root", "n", "copies"), block, threshold)
    links = materialize(_links(paired.join(involved.select("node", "text"), "node"), words,
                               threshold, tolerance), "near-links")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    forest = components(links.select(F.col("node").alias("u"), F.col("parent").alias("v")))
    named = nodes.drop("bands").join(counts, "node", "left").join(forest, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    classes = named.groupBy("root").agg(F.min("least").alias("class_id"), F.min("first").alias("lead"))
    named = named.join(classes, "root").select(
        "node", "class_id", F.col("least").alias("copy_of"), "lead",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.drop("bands", "n").join(named, "node", "left")
    return out.select(
        "doc_id", "copy", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(
            F.col("class_id")).alias("class_id"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("node").isNull() | (F.col("lead.doc_id").eqNullSafe(F.col("doc_id"))
                                   & (F.col("lead.copy") == F.col("copy")))).alias("keep"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, that ``near_duplicates`` keeps: one of each class.

    Rows of one id (or of none) with one text are one document and stay or go together. Null and
    empty texts have no words and stay. Other columns may have any names. An empty table gives no
    rows.
    """
    kept = near_duplicates(docs, doc_id, text).filter("keep").select(
        F.col("doc_id").alias("d"), F.col("copy").alias("c")).distinct()
    rows = docs.select(whole_rows(docs), F.col(doc_id).alias("id"), F.xxhash64(text).alias("copy"))
    return rows.join(kept, rows["id"].eqNullSafe(kept["d"]) & (rows["copy"] == kept["c"]),
                     "left_semi").select("row.*")
