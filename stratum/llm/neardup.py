"""Near-duplicates by shingles of five words: candidates from bit-sliced SimHash, links by exact similarity.

Documents with the same set of shingles collapse to one first, so exact copies, and texts that differ in repeats alone, cost no
pairs. Fingerprints are taken of the set, without repeats. Documents that share a band of min-hashes are dealt into blocks; in a block,
fingerprints are compared bit-sliced and those within RADIUS bits are candidates. At a similarity of 0.8, bands miss 2 in 10,000 pairs, and
fingerprints, which differ in some 10 of 64 bits then (12 with a handful of shingles), 1 in 100,000 (7 in 10,000).
Candidates make clusters, kept as chains, so no block emits its pairs. In each
cluster the Jaccard similarity of every pair is computed exactly from the shingle sets and pairs from
SIMILARITY on are links.

A cluster beyond CLUSTER documents is first compared with a few pivots out of it, for which each text is sent once. Let d be the
Jaccard distance, which obeys the triangle inequality, and r(c) the least distance from pivot c to a document that c does not
link with. A document m with d(c, m) + 0.2 < r(c) is settled: whatever it links with, c links with too, so the
link to c stands for all of its links, and it leaves the cluster, as the pivot does. So a group of close copies is settled by comparing
each with a few, and only what is left, after ROUNDS at most, is dealt in tiles, each pair of parts in one task of bounded
size. A block beyond its bound is dealt in tiles, too.

Cases: documents without words have one empty set and are copies of each other; a null id is never
removed and represents nothing; rows with the same id and text stay or go together; an empty table gives
an empty result; other columns are kept as they are, whatever their names; bytes that are not UTF-8 count as U+FFFD.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .bitslice import chain_edges, link
from .common import Steps, cut, free_names, sound
from .components import components
from .simhash import fingerprint, shingle_hashes

WORDS = 5
SIMILARITY = 0.8
RADIUS = 22
BANDS, ROWS = 16, 4
#: Rows of a block, and documents of a cluster, that are compared in one task.
BLOCK, CLUSTER = 4096, 768
#: Pivots of a large cluster in a round, and rounds at most.
PIVOTS, ROUNDS = 8, 3

#: Two similarities this near are the same.
_EQUAL = 1e-9
_RNG = np.random.default_rng(20)
_FLIP = _RNG.integers(0, 2**63, (BANDS * ROWS, 1)).astype(np.uint64)
_ODD = _RNG.integers(0, 2**62, (BANDS * ROWS, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> list[int]:
    """A hash of each band of min-hashes, signed."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        low = np.minimum(low, ((hashes[None, at : at + 2048] ^ _FLIP) * _ODD).min(axis=1))
    raw = low.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(raw[b].tobytes(), b) - (1 << 63) for b in range(BANDS)]


def _signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, fp, s, bands): text hash, fingerprint, hash of the shingle set, bands."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, s, b = [], [], []
            for x in batch.column(2):
                h = np.unique(shingle_hashes(x.as_py(), WORDS))
                fp.append(fingerprint(h))
                s.append(xxhash.xxh64_intdigest(h.tobytes(), 9) - (1 << 63))
                b.append(bands(h) if len(h) else [])
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(v, k) for v, k in zip((fp, s, b), kinds, strict=True))], names=["id", "t", "fp", "s", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), sound(text_col).alias("text"))
    return rows.mapInArrow(each, "id long, t long, fp long, s long, bands array<long>")


def _tiled(rows: DataFrame, counted: DataFrame, keys: list[str], most: int) -> DataFrame:
    """rows with a tile number: groups of up to most rows are one tile; larger ones are dealt into parts by a hash of
    the id and every two parts meet in one tile. The groups are counted in a table with the same keys."""
    sizes = cut(counted.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > most))
    parts = F.ceil(F.col("__n") / (most // 2)).cast("long")
    mine = F.pmod(F.xxhash64("id", F.lit("tile")), parts)
    other = F.sequence(F.lit(0).cast("long"), parts - 1)
    tile = F.transform(other, lambda j: F.least(mine, j) * parts + F.greatest(mine, j))
    return rows.join(sizes, keys, "left").withColumn("tile", F.explode(F.when(F.col("__n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(tile))).drop("__n")


def candidate_clusters(nodes: DataFrame) -> DataFrame:
    """(node, root) of the nodes (id, fp, bands) that have a candidate."""
    keyed = nodes.select("id", "fp", F.posexplode("bands").alias("band", "key")).select("band", "key", "id", "fp")
    keys = ["band", "key", "tile"]
    dealt = _tiled(keyed, keyed, ["band", "key"], BLOCK).select(*keys, "id", "fp").repartition(*keys).sortWithinPartitions(*keys)
    return components(dealt.mapInPandas(lambda batches: link(batches, RADIUS, keys), "a long, b long"))


def jaccard(sets: list[np.ndarray], first: int | None = None) -> np.ndarray:
    """Exact Jaccard similarity of the first sets (or of all) with all."""
    n = len(sets)
    first = n if first is None else first
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    pick = shared[col]
    owner, col = owner[pick], place[col[pick]]
    both = np.zeros((first, n), np.float32)
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    width = max(1, min(4096, int(shared.sum())))
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(col, [at, at + width])
        part = np.zeros((n, width), np.float32)
        part[owner[a:b], col[a:b] - at] = 1
        both += part[:first] @ part.T
    both[np.arange(first), np.arange(first)] = sizes[:first]
    return both.astype(np.float64) / np.maximum(1, sizes[:first, None] + sizes[None, :] - both)


def similar_labels(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Component label of each set over links of Jaccard similarity from the bound on, all pairs compared exactly."""
    n = len(sets)
    linked = jaccard(sets) >= similarity - _EQUAL
    label = np.arange(n)
    while True:
        low = np.where(linked, label[None, :], n).min(axis=1)
        low = np.minimum(low, label)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chains of linked ids of rows (root, tile, id, text) sorted by root and tile."""
    held: list = []
    key = None

    def settle() -> pd.DataFrame:
        return chain_edges(similar_labels([s for _, s in held]), np.array([i for i, _ in held], dtype=np.int64))

    for pdf in batches:
        for root, tile, i, text in zip(pdf["root"], pdf["tile"], pdf["id"], pdf["text"], strict=True):
            if (root, tile) != key:
                if len(held) > 1:
                    yield settle()
                held, key = [], (root, tile)
            held.append((i, np.unique(shingle_hashes(text, WORDS))))
    if len(held) > 1:
        yield settle()


def _to_pivots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(pivot, id, d) of each row and pivot of rows (root, chunk, pivot, id, text) sorted by root and chunk, the pivots of a
    chunk before its other rows; d is the distance, and only those up to twice that of a link are given."""
    most = 2 * (1 - SIMILARITY) + _EQUAL
    key, pivots = None, []

    def settle(rows: list) -> pd.DataFrame:
        d = 1 - jaccard([*(p for _, p in pivots), *(r for _, r in rows)], len(pivots))[:, len(pivots) :]
        a, b = np.nonzero(d <= most)
        return pd.DataFrame({"pivot": np.array([i for i, _ in pivots], dtype=np.int64)[a], "id": np.array([i for i, _ in rows], dtype=np.int64)[b], "d": d[a, b]})

    rows: list = []
    for pdf in batches:
        for root, chunk, is_pivot, i, text in zip(pdf["root"], pdf["chunk"], pdf["pivot"], pdf["id"], pdf["text"], strict=True):
            if (root, chunk) != key:
                if rows and pivots:
                    yield settle(rows)
                key, pivots, rows = (root, chunk), [], []
            made = (i, np.unique(shingle_hashes(text, WORDS)))
            (pivots if is_pivot else rows).append(made)
            if len(rows) >= 256:
                yield settle(rows)
                rows = []
    if rows and pivots:
        yield settle(rows)


def settled(sets: DataFrame, steps: Steps) -> tuple[DataFrame, list[DataFrame]]:
    """(what is left of clusters (root, id, text), edges (a, b) of what was settled): see the module."""
    edges: list[DataFrame] = []
    for turn in range(ROUNDS):
        sizes = steps.cut(sets.groupBy(F.col("root").alias("b_root")).agg(F.count("*").alias("n")).where(F.col("n") > CLUSTER))
        if sizes.isEmpty():
            break
        big = sets.join(sizes, F.col("root") == F.col("b_root")).drop("b_root")
        order = W.partitionBy("root").orderBy(F.xxhash64("id", F.lit(turn)), "id")
        names = steps.cut(big.select("root", "id").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= PIVOTS).select(F.col("id").alias("p_id")))
        chunks = F.ceil(F.col("n") / CLUSTER)
        pivots = big.join(names, F.col("id") == F.col("p_id")).select("root", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"), F.lit(True).alias("pivot"), "id", "text")
        dealt = pivots.unionByName(big.select("root", F.pmod(F.xxhash64("id", F.lit("chunk")), chunks).alias("chunk"), F.lit(False).alias("pivot"), "id", "text"))
        dealt = dealt.repartition("root", "chunk").sortWithinPartitions("root", "chunk", F.col("pivot").desc())
        met = steps.cut(dealt.mapInPandas(_to_pivots, "pivot long, id long, d double"))
        link = F.col("d") <= 1 - SIMILARITY + _EQUAL
        edges.append(met.where(link).select(F.col("pivot").alias("a"), F.col("id").alias("b")))
        bound = met.where(~link).groupBy(F.col("pivot").alias("r_pivot")).agg(F.min("d").alias("r"))
        # Distances beyond those given are more than twice a link's, so r is that at least.
        near = met.join(steps.cut(bound), F.col("pivot") == F.col("r_pivot"), "left")
        gone = near.where((F.col("id") == F.col("pivot")) | (F.col("d") + (1 - SIMILARITY) < F.coalesce("r", F.lit(2 * (1 - SIMILARITY))) - 2 * _EQUAL))
        gone = steps.cut(gone.select(F.col("id").alias("g_id")).distinct())
        sets = steps.cut(sets.join(gone, F.col("id") == F.col("g_id"), "left_anti"))
    return sets, edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, component) of every row of docs; component is the smallest id reachable over links."""
    signed = cut(_signatures(docs, id_col, text_col))
    nodes = cut(signed.groupBy("s").agg(F.min("id").alias("id"), F.min_by(F.struct("fp", "bands", "t"), "id").alias("x")))
    known = nodes.where("id IS NOT NULL").select("id", F.col("x.fp").alias("fp"), F.col("x.bands").alias("bands"), F.col("x.t").alias("t"))
    clusters = cut(candidate_clusters(known))
    wanted = cut(known.join(clusters, known["id"] == clusters["node"]).select(F.col("id").alias("w_id"), F.col("t").alias("w_t"), "root"))
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), sound(text_col).alias("text"))
    # Rows that repeat an id and a text stand for one.
    steps = Steps()
    sets = steps.cut(text.join(wanted.hint("merge"), (F.col("id") == F.col("w_id")) & (F.col("t") == F.col("w_t"))).select("root", "id", "text").dropDuplicates(["id"]))
    left, edges = settled(sets, steps)
    dealt = _tiled(left, left, ["root"], CLUSTER).repartition("root", "tile").sortWithinPartitions("root", "tile")
    edges.append(dealt.select("root", "tile", "id", "text").mapInPandas(_verify, "a long, b long"))
    links = components(reduce(DataFrame.unionByName, edges))
    steps.drop()
    named = cut(nodes.join(links, nodes["id"] == links["node"], "left").select(F.col("s").alias("n_s"), F.coalesce("root", "id").alias("component")))
    return signed.join(named, F.col("s") == F.col("n_s")).select("id", "t", "component")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id, with all its columns."""
    found = near_duplicates(docs, id_col, text_col)
    c_id, c_t = free_names(docs, "__c_id", "__c_t")
    copies = cut(found.where("id IS NOT NULL AND id <> component").select(F.col("id").alias(c_id), F.col("t").alias(c_t)).distinct())
    return docs.join(copies.hint("merge"), (docs[id_col].cast("long") == F.col(c_id)) & (F.xxhash64(docs[text_col]) == F.col(c_t)), "left_anti")
