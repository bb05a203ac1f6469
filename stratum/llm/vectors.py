"""Embedding near-dedup on a robust-pruned flat graph.

Equal vectors collapse to a node. Centres fitted on a bounded sample cut space into cells, and every node goes to its
nearest ones, so that shards overlap. A shard beyond LARGE nodes is cut again by centres of its own, fitted on a bounded
sample of it on the executors; one that is still beyond BLOCK is dealt into parts by a hash. Each part builds a graph: near
neighbours, robust-pruned to DEGREE edges. The lists that a node got in its shards are united to one flat graph, whose table holds
every node once, with its edges and its shards.

The search walks that graph. Every node is a query in its shards: from the medoids on, the best of a beam are expanded, and
so is everything within the range, along the united edges. A node met within the DOOR range whose shards are not the query's is a door:
the query goes on in those shards, in rounds, until no door is new. A shard's parts meet two by two, each pair once, so a node
is sent once for every part of its shard. What is found is verified by cosine in double precision, on the vectors as
they were given.

Links are counted where they are found and never listed: a link that several tasks find counts in one, the least shard
in which the two could first meet, as both nodes' shards and doors are known in each. For the components, a task gives a
forest of what it found, at most as many edges as nodes. So a dense group of n nodes costs n^2 comparisons, but rows in
proportion to n for every part.

Recall is measured always: the vectors whose id is divisible by EVERY are compared with all nodes, in blocks of bounded size that
go to every task. The same pass tells which share of their links lies within common cells for each overlap, so that the least overlap
with TARGET of them is taken before anything is searched. After the search the links found of these queries, as a share of
theirs, are the recall in the result; below LEAST everything is compared with everything, in tiles.

Cases: a vector that is null, empty, zero or holds a null or non-finite component links with nothing and is its
own component; vectors of different length never link; a vector with a null id links like others, but a component is named by its least
id that is not null, so it is kept only if none of its component has one; rows that repeat an id are vectors of their own that
share a component; an empty table gives an empty result; without audited links recall is null; labels and other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, cut, table
from .components import components

COSINE, DOOR = 0.9, 0.8
#: Nodes that a cell is meant to hold; nodes of a part at most, two of which meet in a task.
SHARD, BLOCK = 256, 2048
#: Nearest cells of a node: at least, and at most.
OVERLAP, MORE = 2, 8
#: Vectors that centres are fitted on, and centres, at most (with 64 numbers each, a quarter of a megabyte is sent to every task).
#: A centre is the mean of several vectors, so that those of one dense group lie together and become one.
SAMPLE, CENTRES = 8192, 1024
#: A shard of more nodes is cut again; its nodes meet its centres in chunks of about so many.
LARGE, CHUNK = 4096, 32768
#: Centres with a higher cosine are one.
APART = 0.97
DEGREE, NEAR, SLACK = 16, 48, 1.2
BEAM = 24
#: Ids divisible by this are audited, so many in a block; the share of links wanted within common cells, and the recall below which all is compared.
EVERY, ASKED, TARGET, LEAST = 50, 16384, 0.985, 0.9
#: Entries of an array that a task works on at once: scores, edges that are followed, components of the vectors of pairs.
HELD = 1 << 20


def usable(v) -> bool:
    """Whether a vector can link."""
    if v is None or not len(v):
        return False
    x = np.array([np.nan if c is None else c for c in v], dtype=np.float64) if not isinstance(v, np.ndarray) or v.dtype == object else v
    return bool(np.isfinite(x).all() and x.any())


def unit(v) -> np.ndarray | None:
    """The vector at length 1 in double precision, or null if it can't link."""
    return units(np.array([v], dtype=np.float64))[0] if usable(v) else None


def units(x: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision, scaled first so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _packed(rows: DataFrame) -> DataFrame:
    """(id, x binary, dim) of rows (id, v): x is the vector's bytes as given, null if it can't link."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = [np.asarray(v, dtype=kind) if usable(v) else None for v in pdf["v"]]
            yield pd.DataFrame({"id": pdf["id"], "x": [None if u is None else u.tobytes() for u in x], "dim": [0 if u is None else len(u) for u in x]})

    kind = numbers(rows)
    named = rows.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "v")  # pandas would make numbers with nulls lose digits
    return named.mapInPandas(each, "id string, x binary, dim int").withColumn("id", F.when(F.col("id") != "", F.col("id").cast("long")))


def numbers(rows: DataFrame) -> str:
    """The kind of number that vectors are kept as: four bytes if they were given so."""
    return "f4" if rows.schema["v"].dataType.simpleString() == "array<float>" else "f8"


def _matrix(column, kind: str) -> np.ndarray:
    """Unit rows of packed vectors of one length."""
    return units(np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), -1))


def fit_centres(sample: np.ndarray, count: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Spherical k-means; fewer centres than asked for if the sample is small."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[: max(1, min(count, len(sample)))]].astype(np.float32)
    points = sample.astype(np.float32)
    for _ in range(rounds):
        near = np.concatenate([(points[a : a + 2048] @ centres.T).argmax(axis=1) for a in range(0, len(points), 2048)])
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.maximum(size, 1e-12), centres)
    kept: list[int] = []
    for i in range(len(centres)):  # several centres in one dense group would part its members
        if not kept or (centres[kept] @ centres[i]).max() < APART:
            kept.append(i)
    return centres[kept]


def nearest(x: np.ndarray, centres: np.ndarray, most: int) -> np.ndarray:
    """(n, most) centres by falling cosine, found in slices of bounded memory."""
    k = min(most, len(centres))
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        score = x[at : at + 1024].astype(np.float32) @ centres.T
        top = np.argpartition(-score, k - 1, axis=1)[:, :k]
        out[at : at + 1024] = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, axis=1), axis=1, kind="stable"), axis=1)
    return out


def _assigned(nodes: DataFrame, centres: dict[int, np.ndarray], kind: str) -> DataFrame:
    """(id, near array<int>) of each node: its MORE nearest centres."""
    sent = nodes.sparkSession.sparkContext.broadcast(centres)
    more = MORE

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                yield pd.DataFrame({"id": part["id"], "near": list(nearest(_matrix(part["x"], kind), sent.value[int(dim)], more).astype(np.int32))})

    return nodes.select("id", "x", "dim").mapInPandas(each, "id long, near array<int>")


def _divided(cells: DataFrame, nodes: DataFrame, overlap: int, kind: str) -> DataFrame:
    """(dim, shard, id), shards beyond LARGE nodes cut again; the new ones are numbered from CENTRES on.

    The nodes of a shard are dealt to its centres in chunks, so a shard with a third of all rows is no single task.
    """
    target, large, chunk, sample, centres = 2 * SHARD, LARGE, CHUNK, SAMPLE, CENTRES
    sizes = cut(cells.groupBy(F.col("dim").alias("s_dim"), F.col("shard").alias("s_shard")).agg(F.count("*").alias("n")).where(F.col("n") > large))
    if sizes.isEmpty():
        return cells
    here = (F.col("dim") == F.col("s_dim")) & (F.col("shard") == F.col("s_shard"))
    big = cut(cells.join(sizes, here).drop("s_dim", "s_shard").join(nodes.select(F.col("id").alias("n_id"), "x"), F.col("id") == F.col("n_id")).select("dim", "shard", "id", "x", "n"))
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        count = min(-(-2 * int(pdf["n"].iloc[0]) // target), centres, max(1, len(pdf) // 8))
        found = fit_centres(_matrix(pdf["x"], kind), count)
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "shard": pdf["shard"].iloc[:1], "n": pdf["n"].iloc[:1], "centres": [found.tobytes()]})

    fitted = cut(big.where(draw * F.col("n") < sample).groupBy("dim", "shard").applyInPandas(fit, "dim int, shard int, n long, centres binary"))
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    members = big.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit("chunk")), chunks.cast("long")).cast("int"))
    told = fitted.select("dim", "shard", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "centres")

    def deal(own: pd.DataFrame, its: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"dim": [], "shard": [], "id": []}).astype({"dim": "int32", "shard": "int32", "id": "int64"})
        x, dim = _matrix(own["x"], kind), int(own["dim"].iloc[0])
        near = nearest(x, np.frombuffer(its["centres"].iloc[0], np.float32).reshape(-1, dim), overlap)
        base = (int(own["shard"].iloc[0]) + 1) * centres
        return pd.concat([pd.DataFrame({"dim": own["dim"], "shard": base + near[:, nth], "id": own["id"]}) for nth in range(near.shape[1])])

    keys = ["dim", "shard", "chunk"]
    again = members.select(*keys, "id", "x").groupBy(*keys).cogroup(told.groupBy(*keys)).applyInPandas(deal, "dim int, shard int, id long")
    return cells.join(sizes, here, "left_anti").unionByName(again)


def robust_prune(x: np.ndarray, similar: np.ndarray, order: np.ndarray, degree: int = DEGREE, slack: float = SLACK) -> np.ndarray:
    """(n, degree) neighbours of each vector, -1 where there are fewer: the nearest candidate is taken and those
    that lie slack times nearer to it than to the vector are dropped, until the degree is reached."""
    n, width = order.shape
    away = 1 - np.take_along_axis(similar, order, axis=1)  # half the squared distance
    alive = np.ones((n, width), bool)
    out = np.full((n, degree), -1, np.int64)
    rows = np.arange(n)
    for slot in range(min(degree, width)):
        some = alive.any(axis=1)
        if not some.any():
            break
        pick = alive.argmax(axis=1)
        chosen = order[rows, pick]
        out[some, slot] = chosen[some]
        alive[rows, pick] = False
        between = 1 - similar[chosen[:, None], order]
        alive &= ~(slack * slack * between <= away)
    return out


def build(x: np.ndarray) -> np.ndarray:
    """Adjacency of a block, with the reverse edges added while there is room."""
    n = len(x)
    if n == 1:
        return np.full((1, 1), -1, np.int64)
    similar = x.astype(np.float32) @ x.T.astype(np.float32)
    np.fill_diagonal(similar, -2)
    near = min(NEAR, n - 1)
    order = np.argpartition(-similar, near - 1, axis=1)[:, :near]
    order = np.take_along_axis(order, np.argsort(-np.take_along_axis(similar, order, axis=1), axis=1, kind="stable"), axis=1)
    graph = robust_prune(x, similar, order)
    full = np.concatenate([graph, np.full((n, DEGREE), -1, np.int64)], axis=1)
    used = (full >= 0).sum(axis=1)
    for a, b in zip(*np.nonzero(graph >= 0), strict=True):
        to = graph[a, b]
        if used[to] < full.shape[1] and a not in full[to, : used[to]]:
            full[to, used[to]] = a
            used[to] += 1
    return full


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def range_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, least: float, beam: int = BEAM) -> np.ndarray:
    """(queries, n) similarities of what was reached, -2 elsewhere. From the starts on, the best of the beam that are
    not yet expanded are, and so is everything within the range."""
    q32, x32 = queries.astype(np.float32), x.astype(np.float32)
    m, n = len(queries), len(x)
    score = np.full((m, n), -2, np.float32)
    todo = np.zeros((m, n), bool)
    score[:, starts] = q32 @ x32[starts].T
    todo[:, starts] = True
    width = min(beam, n)
    edge = np.float32(least - 1e-4)
    lists, pairs = max(1, HELD // graph.shape[1]), max(1, HELD // x.shape[1])
    while True:
        bar = np.partition(score, n - width, axis=1)[:, n - width] if width < n else np.full(m, -2, np.float32)
        a, b = np.nonzero(todo & (score >= np.minimum(bar, edge)[:, None]))
        if not len(a):
            return score
        todo[a, b] = False
        for first in range(0, len(a), lists):  # in a dense group all is expanded: the lists of so many at once
            to = graph[b[first : first + lists]]
            row, to = np.repeat(a[first : first + lists], to.shape[1]), to.ravel()
            keep = to >= 0
            row, to = row[keep], to[keep]
            fresh = score[row, to] == -2
            flat = np.unique(row[fresh] * n + to[fresh])
            row, to = flat // n, flat % n
            for at in range(0, len(row), pairs):
                r, t = row[at : at + pairs], to[at : at + pairs]
                score[r, t] = np.maximum(np.einsum("ij,ij->i", q32[r], x32[t]), -1.5)
            todo[row, to] = True


def _parts(rows: DataFrame) -> DataFrame:
    """rows (dim, shard, id, ...) with the parts of their shard (parts) and the row's own (part)."""
    sizes = cut(rows.groupBy(F.col("dim").alias("s_dim"), F.col("shard").alias("s_shard")).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts")))
    met = rows.join(sizes, (F.col("dim") == F.col("s_dim")) & (F.col("shard") == F.col("s_shard"))).drop("s_dim", "s_shard")
    return met.withColumn("part", F.pmod(F.xxhash64("id", "shard"), F.col("parts").cast("long")).cast("int"))


def flat_graph(nodes: DataFrame, cells: DataFrame, kind: str, steps: Steps) -> DataFrame:
    """(id, x, dim, copies, shards, near) of every node: its shards in order, and the lists that it got in them, united."""

    def listed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids = pdf["id"].to_numpy()
        graph = build(_matrix(pdf["x"], kind))
        return pd.DataFrame({"id": ids, "near": pd.Series([ids[g[g >= 0]].tolist() for g in graph], dtype=object)})

    shards = cells.groupBy(F.col("id").alias("h_id")).agg(F.sort_array(F.collect_set("shard")).alias("shards"))
    placed = steps.cut(nodes.join(shards, F.col("id") == F.col("h_id")).drop("h_id"))
    dealt = _parts(placed.select("dim", F.explode("shards").alias("shard"), "id", "x"))
    near = dealt.groupBy("dim", "shard", "part").applyInPandas(listed, "id long, near array<long>")
    united = near.groupBy(F.col("id").alias("u_id")).agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    return steps.cut(placed.join(united, F.col("id") == F.col("u_id")).drop("u_id"))


def _padded(lists) -> np.ndarray:
    out = np.full((len(lists), max([1, *(len(x) for x in lists)])), -1, np.int64)
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def _least_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row the least number that stands in both arrays (-1 is none), or a huge one."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    for i in range(a.shape[1]):
        for j in range(b.shape[1]):
            out = np.where((a[:, i] == b[:, j]) & (a[:, i] >= 0), np.minimum(out, a[:, i]), out)
    return out


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect n rows as the pairs do, one a row at most."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    pick = np.nonzero(label != np.arange(n))[0]
    return pick, label[pick]


def _linked(x: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows are links, in double precision."""
    step = max(1, HELD // x.shape[1])
    out = np.zeros(len(row), bool)
    for at in range(0, len(row), step):
        r, c = row[at : at + step], col[at : at + step]
        out[at : at + step] = (np.einsum("ij,ij->i", x[r], x[c]) >= COSINE) & (r != c)
    return out


_FOUND = "id long, others long, to long, doors array<int>"


def searched(kind: str, exact: bool):
    """The task of a tile: rows of two parts of a shard, or of one, and queries from other shards.

    role is 0 for a member and 1 for a query from elsewhere; shards, past and now are a row's shards, the doors of earlier
    rounds and those of this one. Queries go by slices, so that a tile where all is linked takes no more memory than the scores
    of a slice and a byte for each pair of members. Gives a row (id, others, ...) for every count, (id, to) for every edge of the forest and
    (id, doors) for every query that has new ones."""

    cosine, door, held = COSINE, DOOR, HELD

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["role", "id"])
        own = int((pdf["role"] == 0).sum())
        ids, part, shard = pdf["id"].to_numpy(), pdf["part"].to_numpy(), int(pdf["shard"].iloc[0])
        copies = pdf["copies"].to_numpy()
        x = _matrix(pdf["x"], kind)
        home, past, now = (_padded(list(pdf[c])) for c in ("shards", "past", "now"))
        asking = np.arange(own) if own == len(ids) else np.arange(own, len(ids))
        if not own:
            return pd.DataFrame({"id": [], "others": [], "to": [], "doors": []}).astype({"id": "int64", "others": "int64", "to": "Int64", "doors": object})
        if not exact:
            place = {int(i): k for k, i in enumerate(ids[:own])}
            graph = _padded([[place[int(t)] for t in near if int(t) in place] for near in pdf["near"].iloc[:own]])
            starts = np.array([np.nonzero(part[:own] == p)[0][medoid(x[:own][part[:own] == p])] for p in np.unique(part[:own])])
        among, single = own == len(ids), len(np.unique(part)) == 1
        met = np.zeros((own, own), bool) if among else None
        others = np.zeros(len(ids))
        a = b = np.zeros(0, np.int64)
        doors = []
        step, pairs = max(1, held // own), max(1, held // max(m.shape[1] for m in (home, past, now)))

        def count(row: np.ndarray, col: np.ndarray) -> None:
            for at in range(0, len(row), pairs):
                r, c = row[at : at + pairs], col[at : at + pairs]
                if among:  # of the two parts where there are two
                    across = (part[r] != part[c]) | single
                    r, c = r[across], c[across]
                    first = _least_common(home[r], home[c])
                else:
                    new = (_least_common(home[r], home[c]) > 1 << 40) & (_least_common(past[r], home[c]) > 1 << 40) & (_least_common(home[r], past[c]) > 1 << 40)
                    r, c = r[new], c[new]
                    first = np.minimum(_least_common(now[r], home[c]), _least_common(home[r], now[c]))
                r, c = r[first == shard], c[first == shard]
                others[:] += np.bincount(r, copies[c], len(ids)) + np.bincount(c, copies[r], len(ids))

        for at in range(0, len(asking), step):
            mine = asking[at : at + step]
            score = x[mine].astype(np.float32) @ x[:own].T.astype(np.float32) if exact else range_search(x[:own], graph, starts, x[mine], cosine)
            row, col = np.nonzero(score >= cosine - 1e-4)
            row = mine[row]
            right = _linked(x, row, col)
            row, col = row[right], col[right]
            a, b = _forest(np.r_[a, row], np.r_[b, col], len(ids))
            if among:
                met[row, col] = True
            else:
                count(row, col)
            if not exact:
                for k, q in enumerate(mine):
                    near = np.nonzero(score[k] >= door)[0]
                    if len(near) > 1 or (len(near) and near[0] != q):
                        new = np.setdiff1d(home[near].ravel(), np.r_[-1, shard, home[q], past[q], now[q]])
                        if len(new):
                            doors.append((ids[q], new.tolist()))
        if among:  # a link is one of the two rows, whichever of them found it
            met |= met.T
            for at in range(0, own, step):
                row, col = np.nonzero(np.triu(met[at : at + step], at + 1))
                count(row + at, col)
        pick = np.nonzero(others)[0]
        out = [pd.DataFrame({"id": ids[a], "others": 0, "to": ids[b]}), pd.DataFrame({"id": ids[pick], "others": others[pick].astype(np.int64), "to": None})]
        out.append(pd.DataFrame({"id": [i for i, _ in doors], "others": 0, "to": None, "doors": [d for _, d in doors]}))
        return pd.concat([pd.DataFrame({c: o[c] if c in o else pd.Series([None] * len(o), dtype=object) for c in ("id", "others", "to", "doors")}).astype({"id": "int64", "others": "int64", "to": "Int64"}) for o in out])

    return task


def links(graph: DataFrame, kind: str, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(counts (id, others), edges (a, b)) of the links found on the flat graph; exact compares all rows of a shard."""
    plain = graph.withColumn("past", F.array().cast("array<int>"))
    now = None
    counts, edges = [], []
    tile = ["dim", "shard", "tile"]
    columns = [*tile, "part", "role", "id", "x", "copies", "shards", "past", "now", "near"]
    while True:
        known = plain.withColumn("now", F.array().cast("array<int>")) if now is None else cut(plain.join(now, F.col("id") == F.col("w_id"), "left").drop("w_id").withColumn("now", F.coalesce("now", F.array().cast("array<int>"))))
        dealt = _parts(known.select("*", F.explode("shards").alias("shard"))).withColumn("role", F.lit(0))
        parts = F.sequence(F.lit(0), F.col("parts") - 1)
        if now is None:
            pair = F.transform(parts, lambda j: F.least("part", j) * F.col("parts") + F.greatest("part", j))
            rows = dealt.withColumn("tile", F.explode(pair)).select(*columns)
        else:
            # Queries from elsewhere come in chunks, as any number of them may have a door to one shard.
            asked = known.where(F.size("now") > 0).select("*", F.explode("now").alias("shard"))
            chunks = asked.groupBy(F.col("dim").alias("k_dim"), F.col("shard").alias("k_shard")).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("chunks"))
            wide = dealt.select(F.col("dim").alias("p_dim"), F.col("shard").alias("p_shard"), "parts").distinct()
            told = cut(chunks.join(wide, (F.col("k_dim") == F.col("p_dim")) & (F.col("k_shard") == F.col("p_shard"))).select("k_dim", "k_shard", "chunks", F.col("parts").alias("k_parts")))
            here = (F.col("dim") == F.col("k_dim")) & (F.col("shard") == F.col("k_shard"))
            chunk = F.pmod(F.xxhash64("id", F.lit("chunk")), F.col("chunks").cast("long")).cast("int")
            met = F.transform(F.sequence(F.lit(0), F.col("k_parts") - 1), lambda p: p * F.col("chunks") + chunk)
            asked = asked.join(told, here).withColumn("part", F.lit(-1)).withColumn("role", F.lit(1)).withColumn("tile", F.explode(met)).select(*columns)
            met = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.col("part") * F.col("chunks") + c)
            members = dealt.join(told, here).withColumn("tile", F.explode(met)).select(*columns)
            rows = members.unionByName(asked)
        found = cut(rows.groupBy(*tile).applyInPandas(searched(kind, exact), _FOUND))
        counts.append(found.where("others > 0").select("id", "others"))
        edges.append(found.where("to IS NOT NULL").select(F.col("id").alias("a"), F.col("to").alias("b")))
        doors = found.where("doors IS NOT NULL").select(F.col("id").alias("w_id"), F.explode("doors").alias("d")).groupBy("w_id").agg(F.sort_array(F.collect_set("d")).alias("now"))
        now = cut(doors)
        if now.isEmpty():
            break
        plain = known.withColumn("past", F.concat("past", "now")).drop("now")
        now = cut(now.join(plain.select(F.col("id").alias("p_id"), "past"), F.col("w_id") == F.col("p_id")).select("w_id", F.array_except("now", "past").alias("now")).where(F.size("now") > 0))
        if now.isEmpty():
            break
    return reduce(DataFrame.unionByName, counts).groupBy("id").agg(F.sum("others").alias("others")), reduce(DataFrame.unionByName, edges)


def _audited(names: np.ndarray, q: np.ndarray, cells: np.ndarray, ids: np.ndarray, x: np.ndarray, copies: np.ndarray, theirs: np.ndarray, more: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each audited node: its links among the rows x, and how many of them share a cell for each overlap. Summed
    here, in slices, as a dense group has far more links than vectors."""
    step, pairs, wide = max(1, HELD // len(x)), max(1, HELD // more), min(cells.shape[1], theirs.shape[1])
    links, within = np.zeros(len(names), np.int64), np.zeros((len(names), more), np.int64)
    for at in range(0, len(names), step):
        row, col = np.nonzero(q[at : at + step] @ x.T >= COSINE)
        row = row + at
        other = names[row] != ids[col]
        row, col = row[other], col[other]
        for first in range(0, len(row), pairs):
            r, c = row[first : first + pairs], col[first : first + pairs]
            np.add.at(links, r, copies[c])
            seen = np.zeros(len(r), bool)
            for k in range(more):  # links that share a cell among the first k + 1 of each
                if k < wide:
                    seen |= (cells[r, : k + 1] == theirs[c, k][:, None]).any(axis=1) | (theirs[c, : k + 1] == cells[r, k][:, None]).any(axis=1)
                np.add.at(within[:, k], r, seen * copies[c])
    return links, within


def audit(nodes: DataFrame, near: DataFrame, kind: str) -> DataFrame:
    """(id, links, within array<long>) of the audited nodes: their links with other nodes, copies counted, among all,
    and how many of them share a cell for each overlap up to MORE."""
    cells = cut(nodes.join(near.withColumnRenamed("id", "c_id"), F.col("id") == F.col("c_id")).drop("c_id"))
    asked = cut(cells.where("audited"))
    total = asked.count()
    blocks = max(1, -(-total // ASKED))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit("audit")), F.lit(blocks)))
    more = MORE
    out = []
    for block in range(blocks if total else 0):
        mine = asked.where(F.col("block") == block).select("id", "x", "dim", "near").collect()
        by_dim = {}
        for r in mine:
            by_dim.setdefault(r["dim"], []).append(r)
        held = {d: (np.array([r["id"] for r in rs]), _matrix([r["x"] for r in rs], kind), _padded([r["near"] for r in rs])) for d, rs in by_dim.items()}
        sent = nodes.sparkSession.sparkContext.broadcast(held)

        def each(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for dim, part in pdf.groupby("dim"):
                    if int(dim) not in sent.value:
                        continue
                    names, q, cells = sent.value[int(dim)]
                    ids, x, copies, theirs = part["id"].to_numpy(), _matrix(part["x"], kind), part["copies"].to_numpy(), _padded(list(part["near"]))
                    links, within = _audited(names, q, cells, ids, x, copies, theirs, more)
                    pick = np.nonzero(links)[0]
                    if len(pick):
                        yield pd.DataFrame({"id": names[pick], "links": links[pick], "within": list(within[pick])})

        sums = [F.sum(F.col("within")[k]) for k in range(MORE)]
        out.append(cut(cells.select("id", "x", "dim", "copies", "near").mapInPandas(each, "id long, links long, within array<long>").groupBy("id").agg(F.sum("links").alias("links"), F.array(*sums).alias("within"))))
        sent.destroy()
    if not out:
        return nodes.sparkSession.createDataFrame([], "id long, links long, within array<long>")
    return reduce(DataFrame.unionByName, out)


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component, kept, recall, audited_links) of every row; see the module."""
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    kind = numbers(named)
    packed = cut(_packed(named))
    audited = F.max(F.coalesce(F.col("id") % EVERY == 0, F.lit(False))).alias("audited")
    nodes = packed.where("x IS NOT NULL").groupBy("x", "dim").agg(F.min("id").alias("doc"), F.count("*").alias("copies"), audited)
    # Rows that repeat an id with another vector have nodes of their own: a node is named by its place among them.
    nodes = cut(nodes.withColumn("id", F.monotonically_increasing_id()))
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    centres = {}
    for dim, n in sizes.items():
        sample = nodes.where(F.col("dim") == dim).orderBy(F.xxhash64("x")).limit(SAMPLE).select("x").collect()
        centres[dim] = fit_centres(_matrix([r["x"] for r in sample], kind), min(CENTRES, -(-n // SHARD)))
    near = cut(_assigned(nodes, centres, kind))
    truth = cut(audit(nodes, near, kind))
    sums = truth.agg(F.sum("links"), *[F.sum(F.col("within")[k]) for k in range(MORE)]).first()
    true = sums[0] or 0
    overlap = next((k for k in range(OVERLAP, MORE) if (sums[k] or 0) >= TARGET * true), MORE)
    keep = ["id", "x", "dim", "copies"]
    cells = nodes.select("id", "dim").join(near.withColumnRenamed("id", "c_id"), F.col("id") == F.col("c_id")).select("dim", F.explode(F.slice("near", 1, overlap)).alias("shard"), "id")
    steps = Steps()
    graph = flat_graph(nodes.select(*keep), steps.cut(_divided(steps.cut(cells), nodes, overlap, kind)), kind, steps)
    counts, edges = map(cut, links(graph, kind))
    steps.drop()

    def recall() -> float | None:
        got = truth.join(counts.withColumnRenamed("id", "f_id"), F.col("id") == F.col("f_id")).agg(F.sum(F.least("links", "others"))).first()[0] or 0
        return got / true if true else None

    share = recall()
    if true and share < LEAST:
        whole = nodes.select(*keep).withColumn("shards", F.array(F.lit(0))).withColumn("near", F.array().cast("array<long>"))
        counts, edges = map(cut, links(cut(whole), kind, exact=True))
        share = recall()
    roots = components(edges)
    linked = counts.withColumnRenamed("id", "l_id")
    labelled = nodes.join(linked, F.col("id") == F.col("l_id"), "left").join(roots, F.col("id") == F.col("node"), "left")
    labelled = cut(labelled.select("x", "doc", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("root")))
    lowest = cut(labelled.groupBy("root").agg(F.min("doc").alias("component")).withColumnRenamed("root", "r"))
    full = cut(labelled.join(lowest, F.col("root") == F.col("r")).select(F.col("x").alias("n_x"), "n_links", "component"))
    out = packed.join(full, F.col("x") == F.col("n_x"), "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))
    return out.select("*", F.coalesce(F.col("id") == F.col("component"), F.col("component").isNull()).alias("kept"), F.lit(share).cast("double").alias("recall"), F.lit(true).cast("long").alias("audited_links"))


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_vectors(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept", "recall", "audited_links")
