"""SimHash, near-duplicates, components and embeddings against brute force."""

from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest
import xxhash

from stratum.llm import bitslice, neardup, simhash, vectors
from stratum.llm.common import Steps
from stratum.llm.components import components

DATA = "/root/testdata/sf0.001"


def closure(ids, linked):
    """Smallest id reachable, by brute force."""
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def plain_fingerprint(text, words=3):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in h) * 2 > len(h))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(400, 400 + i) for i in range(1, 40)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 3), (5, 5)], "a long, b long")).collect()}
    want = closure({x for e in edges for x in e}, edges)
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 5, 18])
def test_bit_sliced_forest(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 6).astype(np.uint64)
    values = base[rng.integers(0, 6, 150)]
    for _ in range(6):
        values = values ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    group = np.sort(rng.integers(0, 3, 150))
    label = bitslice.forest(group, values, radius)
    linked = [(i, j) for i in range(150) for j in range(i) if group[i] == group[j] and int(values[i] ^ values[j]).bit_count() <= radius]
    want = closure(range(150), linked)
    assert len({(label[i], want[i]) for i in range(150)}) == len(set(label.tolist())) == len(set(want.values()))


def test_simhash_matches_brute_force(spark, monkeypatch):
    out = simhash.op4_simhash(spark, DATA).collect()
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    want = closure(fps, [(a, b) for a in fps for b in fps if a > b and (fps[a] ^ fps[b]).bit_count() <= 2])
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in out} == {(i, f"{f:016x}", want[i]) for i, f in fps.items()}


def test_hot_fingerprint_groups_are_dealt_exactly(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 8)
    rng = np.random.default_rng(4)
    fps = sorted({int(b) ^ (1 << int(rng.integers(0, 16))) ^ (1 << int(rng.integers(0, 30))) for b in rng.integers(0, 2**20, 40) for _ in range(5)})
    nodes = spark.createDataFrame(list(enumerate(fps)), "id long, fp long")
    got = {r.node: r.root for r in components(simhash.radius_links(nodes)).collect()}
    want = closure(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    assert {i: got.get(i, i) for i in range(len(fps))} == want


def test_simhash_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (None, "one two"), (None, "alone here"), (6, "x " * 60_000), (6, "x " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS fp", "1 AS component")
    got = sorted(((r.id, r.fp, r.component) for r in simhash.simhash_components(df).collect()), key=str)
    assert len(got) == len(rows)
    by = {}
    for i, f, c in got:
        by.setdefault(i, []).append((f, c))
    assert by[1] == by[2] == by[3] == [(0, 1)]
    assert by[4][0][1] == by[5][0][1] == 4 and {c for _, c in by[None]} == {4, None} and [c for _, c in by[6]] == [6, 6]
    assert simhash.simhash_components(df.limit(0)).count() == 0


def jaccard_components(texts):
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    ids = list(sets)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (not sets[a] and not sets[b]) or (sets[a] | sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    return closure(ids, linked)


@pytest.mark.parametrize(("block", "cluster", "pivots"), [(4096, 768, 8), (6, 8, 2)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block, cluster, pivots):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "CLUSTER", cluster)
    monkeypatch.setattr(neardup, "PIVOTS", pivots)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts, bases = {}, [[word() for _ in range(rng.randint(60, 200))] for _ in range(8)]
    for i in range(120):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = word()
        texts[i] = " ".join(w)
    texts |= {200: "", 201: "  ", 202: "tiny text", 203: "Tiny text", 204: "another one"}
    passage = " ".join(bases[0][:25])  # the same shingles, some of them many times: one document
    texts[300], texts[301] = f"{texts[0]} {passage} {passage}", f"{texts[0]} {passage} {passage}" + f" {passage}" * 20
    df = spark.createDataFrame([*texts.items(), (None, texts[0])], "doc_id long, text string").selectExpr("*", "7 AS root", "8 AS __c_id")
    got = {r.id: r.component for r in neardup.near_duplicates(df).collect() if r.id is not None}
    want = jaccard_components(texts)
    assert got == want
    kept = neardup.keep_representatives(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(want.values()))
    assert kept.where("doc_id IS NULL").count() == 1


def test_close_groups_are_settled_by_pivots(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CLUSTER", 10)
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    sets = []
    for i in range(60):  # close copies, some farther ones, and what only shares a third
        w = list(base)
        for _ in range(rng.choice([0, 1, 2]) if i < 45 else rng.choice([4, 6, 8]) if i < 55 else 90):
            w[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        sets.append((1, i, " ".join(w)))
    df = spark.createDataFrame(sets, "root long, id long, text string")
    left, edges = neardup.settled(df, Steps())
    rest = {r.id for r in left.collect()}
    linked = [(r.a, r.b) for e in edges for r in e.collect()]
    texts = {i: t for _, i, t in sets}
    after = neardup.similar_labels([np.unique(simhash.shingle_hashes(texts[i], 5)) for i in sorted(rest)])
    linked += [(sorted(rest)[k], sorted(rest)[int(v)]) for k, v in enumerate(after)]
    assert len(rest) < 45 and closure(texts, linked) == jaccard_components(texts)


def test_loss_of_fingerprints_and_bands():
    """Pairs of sets with a similarity of 0.8: how many the radius and the bands lose."""
    rng = np.random.default_rng(11)
    lost_bits = lost_bands = 0
    for _ in range(2000):
        n = int(rng.integers(5, 200)) * 9
        h = rng.integers(0, 2**63, n + n // 9 * 2, dtype=np.int64).view(np.uint64)
        a, b = h[: 9 * (n // 9)], np.r_[h[: 8 * (n // 9)], h[n : n + n // 9]]
        assert len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist())) == 0.8
        lost_bits += int(np.int64(simhash.fingerprint(a) ^ simhash.fingerprint(b)).view(np.uint64)).bit_count() > neardup.RADIUS
        lost_bands += not set(enumerate(neardup.bands(a))) & set(enumerate(neardup.bands(b)))
    assert lost_bits <= 1 and lost_bands <= 3


def brute_links(rows):
    units = {i: u for i, v in rows if (u := vectors.unit(v)) is not None}
    linked = [(a, b) for a in units for b in units if a != b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.9]
    low = closure([i for i, _ in rows], linked)
    return {i: (sum(a == i for a, _ in linked), low[i]) for i, _ in rows}


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 32)
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 16))
    rows = [(k, [float(x) for x in base[k % 60] + rng.normal(size=16) * rng.choice([0, 0.15])]) for k in range(400)]
    rows += [(1000 + k, [float(x) for x in base[0] + rng.normal(size=16) * 0.05]) for k in range(150)]  # a dense group over several parts
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0, 2.0]), (5004, [2.0, 4.0]), (5005, []), (5006, [1.0, None]), (5007, [1e300, 2e300])]
    df = spark.createDataFrame([*rows, *odd, (None, rows[7][1]), (None, [0.0] + [9.0] * 15), (5003, [2.0, 4.0])], "vec_id long, embedding array<double>").selectExpr("*", "3 AS id", "'x' AS label", "1 AS x", "2 AS near")
    out = vectors.near_vectors(df).collect()
    assert len(out) == len(rows) + len(odd) + 3
    want = brute_links([*rows, *odd, (-1, rows[7][1]), (-2, [0.0] + [9.0] * 15), (-3, [2.0, 4.0])])
    named = [r for r in out if r.id is not None]
    got = {r.id: (r.n_links, r.component) for r in named}
    true, found = sum(n for n, _ in want.values()), sum(r.n_links for r in out)
    assert 0.95 * true <= found <= true and all(got[i][0] <= want[i][0] for i in got)
    assert got[5003] == (3, 5003) and got[5007] == (3, 5003) and got[5002] == (0, 5002) and sum(r.id == 5003 for r in out) == 2
    nameless = sorted((r.n_links, r.component, r.kept) for r in out if r.id is None)
    assert nameless[0] == (0, None, True) and nameless[1][0] == got[7][0] and nameless[1][1:] == (got[7][1], False)
    assert all(r.kept == (r.id == r.component) for r in named)
    assert out[0].recall >= 0.95 and out[0].audited_links > 0
    assert vectors.near_vectors(df.limit(0)).count() == 0


def components_of(out):
    return {frozenset(r.id for r in out if r.component == c) for c in {r.component for r in out}}


def test_embeddings_that_graphs_miss_are_all_compared(spark, monkeypatch):
    """Pairs at the border of the range among vectors in all directions, with two cells each at most: recall falls below the least."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=(600, 24))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9005 * a + np.sqrt(1 - 0.9005**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([a, b]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name, value in (("SHARD", 16), ("OVERLAP", 1), ("MORE", 1), ("BLOCK", 256), ("EVERY", 5), ("BEAM", 2)):
        monkeypatch.setattr(vectors, name, value)
    out = vectors.near_vectors(df).collect()
    assert out[0].recall == 1.0 and [r.n_links for r in out] == [1] * 1200 and components_of(out) == {frozenset({k, k + 600}) for k in range(600)}
    monkeypatch.setattr(vectors, "MORE", 8)
    monkeypatch.setattr(vectors, "LEAST", 0.0)
    out = vectors.near_vectors(df).collect()
    assert out[0].recall >= 0.9 and abs(np.mean([r.n_links for r in out]) - out[0].recall) < 0.05


def test_links_across_shards_are_reached_by_doors(spark, monkeypatch):
    """With one cell each, a group that cells part is linked again by queries that go on, and no link counts twice."""
    for name, value in (("SHARD", 24), ("OVERLAP", 2), ("MORE", 2), ("BLOCK", 16), ("TARGET", 0.0), ("LEAST", 0.0), ("EVERY", 1), ("ASKED", 100)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 12))
    rows = [(k, [float(x) for x in base[k % 6] + rng.normal(size=12) * 0.28]) for k in range(300)]
    rounds = []
    task = vectors.searched
    monkeypatch.setattr(vectors, "searched", lambda *a: rounds.append(1) or task(*a))
    out = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()
    want = brute_links([(k, np.array(v, np.float32)) for k, v in rows])
    assert len(rounds) > 1 and all(r.n_links <= want[r.id][0] for r in out)
    assert sum(r.n_links for r in out) >= 0.95 * sum(n for n, _ in want.values()) and abs(out[0].recall - sum(r.n_links for r in out) / sum(n for n, _ in want.values())) < 1e-9


def test_large_shards_of_embeddings_are_cut_again(spark, monkeypatch):
    for name, value in (("SHARD", 16), ("CENTRES", 4), ("LARGE", 48), ("CHUNK", 40), ("BLOCK", 32)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(50, 16))
    rows = [(k, [float(x) for x in base[k % 50] + rng.normal(size=16) * 0.12]) for k in range(500)]
    rows += [(600 + k, [float(x) for x in base[0] + rng.normal(size=16) * 0.2]) for k in range(120)]  # one dense group
    rows += [(900, [1.0, 2.0]), (901, [2.0, 4.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.id: (r.n_links, r.component) for r in vectors.near_vectors(df).collect()}
    want = brute_links(rows)
    assert all(got[i][0] <= want[i][0] for i in want) and got[900] == (1, 900)
    assert sum(got[i][0] for i in want) >= 0.9 * sum(n for n, _ in want.values())


def test_graph_search_recall():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 32))[rng.integers(0, 20, 400)] + 0.25 * rng.normal(size=(400, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = vectors.range_search(x, vectors.build(x), np.array([vectors.medoid(x)]), x, 0.9) >= 0.9
    true = x @ x.T >= 0.9
    assert found.sum() >= 0.9 * true.sum() and not (found & (x @ x.T < 0.8999)).any()


@pytest.mark.parametrize("exact", [False, True])
def test_a_tile_where_all_is_linked_takes_bounded_memory(exact):
    """1,200 vectors that are all linked: 1.4 million pairs, whose vectors would take 1.4 GB at once."""
    n, rng = 1200, np.random.default_rng(8)
    x = (rng.normal(size=64) + 0.1 * rng.normal(size=(n, 64))).astype(np.float32)
    none, copies = [np.array([], np.int32)] * n, 1 + np.arange(n) % 3
    near = [g[g >= 0].tolist() for g in vectors.build(vectors.units(x))]
    rows = pd.DataFrame({"dim": 64, "shard": 3, "tile": 0, "part": 0, "role": 0, "id": np.arange(n), "x": [v.tobytes() for v in x], "copies": copies})
    rows = rows.assign(shards=[np.array([3, 7 + k % 2]) for k in range(n)], past=none, now=none, near=near)
    tracemalloc.start()
    out = vectors.searched("f4", exact)(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    assert (out.groupby("id")["others"].sum().to_numpy() == copies.sum() - copies).all()
    assert out["to"].dropna().eq(0).all() and out["to"].notna().sum() == n - 1


def test_audit_sums_the_links_of_a_dense_group_in_bounded_memory():
    n, rng = 2400, np.random.default_rng(9)
    x = vectors.units(rng.normal(size=64) + 0.1 * rng.normal(size=(n, 64)))
    ids, copies, cells = np.arange(n), 1 + np.arange(n) % 3, np.stack([np.arange(n) % 2, 2 + np.arange(n) % 3], axis=1)
    tracemalloc.start()
    links, within = vectors._audited(ids[::2], x[::2], cells[::2], ids, x, copies, cells, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    assert (links == copies.sum() - copies[::2]).all()
    first = copies[::2].sum() - copies[::2]  # the first cell is that of the even ids
    either = np.array([copies[(cells == cells[i]).any(axis=1)].sum() - copies[i] for i in ids[::2]])
    assert (within == np.stack([first, either, either, either], axis=1)).all()
