"""SimHash near-dedup by bit-sliced comparison.

Cases: a null or empty text has no words and the fingerprint zero; fewer words than a shingle give one
shingle of all of them; a document with a null id is fingerprinted but is no representative, so it carries
the component of a document with the same fingerprint, or null; repeated rows are rows of their own in the
result; an empty table gives an empty result; columns other than the id and the text are not looked at; bytes that are not UTF-8 count as U+FFFD.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitslice import link
from .common import cut, hex64, sound, table
from .components import components

#: A group of more rows than this is dealt further: by more key bits, or in tiles.
HOT = 4096
SEED = 42


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of the text, A-Z lower-cased, as uint64."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    pairs = zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), dtype=np.uint64, count=len(tokens) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """As a signed 64-bit integer; a bit is set if over half the hashes have it."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):  # in pieces, so that a very long text takes little memory
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, fp long), one row per document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(shingle_hashes(t.as_py(), words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    cols = docs.select(F.col(id_col).cast("long").alias("id"), sound(text_col).alias("text"))
    return cols.mapInArrow(each, "id long, fp long")


def _pick(fp, blocks: tuple[int, ...], width: int):
    """The named blocks of width bits of fp, as one number."""
    out = F.lit(0).cast("long")
    for b in blocks:
        part = F.shiftrightunsigned(fp, b * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        out = F.shiftleft(out, width).bitwiseOR(part)
    return out


def radius_links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) that connect the ids of nodes (id long, fp long, each fp once) just as all pairs of
    fingerprints within the radius would.

    The bits are cut into radius + 2 blocks of which such a pair shares two at least, so that rows are grouped
    by every choice of two blocks; a group beyond HOT is dealt again by blocks of the bits that are left,
    which is as exact. Each group is compared bit-sliced.
    """
    if radius != 2:
        raise ValueError("the blocks are laid out for a radius of 2")
    pairs = list(combinations(range(4), 2))
    keyed = [F.struct(F.lit(i).alias("t"), _pick(F.col("fp"), p, 16).alias("key")) for i, p in enumerate(pairs)]
    rows = nodes.select("id", "fp", F.explode(F.array(*keyed)).alias("k")).select("id", "fp", "k.t", "k.key")
    hot = rows.groupBy("t", "key").count().where(F.col("count") > HOT).select("t", "key", F.lit(True).alias("hot"))
    rest = F.lit(0).cast("long")  # the 32 bits outside the key, as four blocks of 8
    for i, p in enumerate(pairs):
        left = tuple(b for b in range(4) if b not in p)
        rest = F.when(F.col("t") == i, _pick(F.col("fp"), left, 16)).otherwise(rest)
    deeper = F.array(*[F.shiftleft(_pick(rest, p, 8), 3).bitwiseOR(F.lit(i + 1).cast("long")) for i, p in enumerate(pairs)])
    dealt = rows.join(cut(hot), ["t", "key"], "left").select(
        "t", "key", "id", "fp", F.explode(F.when(F.col("hot"), deeper).otherwise(F.array(F.lit(0).cast("long")))).alias("sub")
    )
    return _compare(dealt, radius, ["t", "key", "sub"])


def _compare(dealt: DataFrame, radius: int, keys: list[str]) -> DataFrame:
    ordered = dealt.select(*keys, "id", "fp").repartition(*keys).sortWithinPartitions(*keys, "fp")
    return ordered.mapInPandas(lambda batches: link(batches, radius, keys), "a long, b long")


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component) for every row of docs: component is the smallest id reachable over links of fingerprints
    that differ in at most radius bits."""
    fps = cut(fingerprints(docs, words, id_col, text_col))
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("id")))
    found = components(radius_links(nodes.where("id IS NOT NULL"), radius))
    named = cut(
        nodes.join(found, nodes["id"] == found["node"], "left").select(
            F.col("fp").alias("node_fp"), F.coalesce("root", "id").alias("component")
        )
    )
    return fps.join(named, F.col("fp") == F.col("node_fp")).select("id", "fp", "component")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), hex64("fp").alias("fingerprint"), F.col("component").alias("component_id"))
