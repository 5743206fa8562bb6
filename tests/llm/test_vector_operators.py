"""Nearest vectors, groups, packing against brute force on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlens.llm.nearest import near_pairs, neighbours
from adlens.llm import packing
from adlens.llm.packing import TOKENIZER, fill_rates, hilbert_key, measured, pack_along, packed
from adlens.llm import simcluster
from adlens.llm.simcluster import described, linked, sparse_links, spectral_labels
from adlens.llm.vectors import FIRST, SECOND, OneBitCodes, indexed, unit, usable

EMB = "vec_id long, provider string, model string, req_dim int, text string, dim int, vec array<float>"


def table(spark, seed=0, groups=12, per=9, singles=40, dim=24):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for m in ("one", "two"):
        for _ in range(groups):
            centre = rng.standard_normal(dim)
            for _ in range(per):
                n += 1
                rows.append((n, "p", m, 0, f"t{n}", dim, (centre + 0.22 * rng.standard_normal(dim)).astype("f4").tolist()))
        for _ in range(singles):
            n += 1
            rows.append((n, "p", m, 0, f"t{n}", dim, rng.standard_normal(dim).astype("f4").tolist()))
    v = rows[0][6]
    rows += [(n + 1, "p", "one", 0, "copy", dim, v), (n + 2, "p", "one", 0, "copy", dim, v), (n + 3, "p", "one", 0, None, dim, [2 * x for x in v])]
    rows += [(n + 4, "p", "one", 0, "null", dim, None), (n + 5, "p", "one", 0, "short", dim, v[:5]), (n + 6, "p", "one", 0, "nan", dim, [float("nan")] + v[1:]), (n + 7, "p", "one", 0, "zero", dim, [0.0] * dim), (n + 8, None, None, None, "alone", dim, v), (n + 9, "p", "one", 0, "no dim", None, v)]
    rows += [(n + 20 + i, "q", "hot", 0, "hot", dim, v) for i in range(60)]
    return spark.createDataFrame(rows, EMB).withColumn("key", F.lit("clash")).withColumn("space", F.lit(1)).withColumn("label", F.lit(2)), rows


def spaces(rows):
    out = {}
    for vec_id, p, m, r, _, dim, v in rows:
        if v is not None and dim == len(v) and not np.isnan(v).any() and np.any(v):
            out.setdefault((p, m, r), []).append((vec_id, v))
    for own in out.values():
        own.sort()
        x = unit([v for _, v in own])
        yield [i for i, _ in own], x @ x.T


def test_nearest_equal_brute_force(spark):
    df, rows = table(spark)
    want = set()
    for ids, s in spaces(rows):
        for i, row in enumerate(s):
            others = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(row[j], 6), ids[j]))[:5]
            want |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in others if row[j] >= 0.8}
    got = {tuple(r) for r in near_pairs(df).collect()}
    assert len(want & got) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)
    ranks = neighbours(df).groupBy("vec_id").agg(F.max("rank").alias("r"), F.count("*").alias("n")).collect()
    assert all(r["r"] == r["n"] <= 5 for r in ranks)
    assert near_pairs(df.limit(0)).count() == 0


def test_groups_equal_brute_force(spark):
    df, rows = table(spark, seed=1)
    want = set()
    for ids, s in spaces(rows):
        root = list(range(len(ids)))
        changed = True
        while changed:
            changed = False
            for i in range(len(ids)):
                low = min(root[j] for j in range(len(ids)) if s[i, j] >= 0.9)
                if low < root[i]:
                    root[i], changed = low, True
        want |= {(ids[r], ids[i]) for i, r in enumerate(root) if r != i}
    assert {tuple(r) for r in linked(df).collect()} == want
    sizes = {}
    for r, _ in want:
        sizes[r] = sizes.get(r, 1) + 1
    out = {r["root_id"]: r for r in described(df).collect()}
    assert {k: r["size"] for k, r in out.items()} == sizes and all(len(r["typical"]) <= 5 for r in out.values())
    assert linked(df.limit(0)).count() == 0


def pairs(spark, links):
    both = [(a, b, w) for x, y, w in links for a, b in ((x, y), (y, x))]
    return spark.createDataFrame(both, "a long, b long, weight double")


def parts(labels):
    out = {}
    for r in labels.collect():
        out.setdefault(r["label"], set()).add(r["key"])
    return sorted(map(sorted, out.values()))


def test_spectral_groups_of_links(spark, monkeypatch):
    """A clique, a chain and a pair that share one embedding cell stay apart; the chain holds together."""
    clique = [(i, j, 0.95) for i in range(6) for j in range(i)]
    chain = [(100 + i, 101 + i, 0.9) for i in range(40)]
    links = pairs(spark, [*clique, *chain, (500, 501, 0.99)])
    want = [list(range(6)), list(range(100, 141)), [500, 501]]
    assert parts(spectral_labels(links)) == want
    assert parts(spectral_labels(links, tolerance=10.0)) == want
    assert spectral_labels(links.limit(0)).count() == 0
    # An embedding that tells every vector apart from every other holds nothing together.
    monkeypatch.setattr(simcluster, "kmeans", lambda values, tolerance: values.select("key", F.col("key").alias("cluster")))
    with pytest.raises(RuntimeError):
        spectral_labels(links, levels=2)


def test_sparse_links_keep_what_is_connected():
    rng = np.random.default_rng(5)
    for n, p in ((40, 0.03), (60, 0.3), (30, 1.0)):
        i, j = np.nonzero(np.triu(rng.random((n, n)) < p, 1))
        s = rng.random(len(i))
        keep = sparse_links(n, i, j, s)
        assert (simcluster._connected(n, i, j) == simcluster._connected(n, i[keep], j[keep])).all()
        assert keep.sum() <= 4 * n


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = unit(rng.standard_normal((300, 96))).astype(np.float32)
    codes = OneBitCodes(x)
    low, high = codes.bounds(0, 300)
    exact = x @ x.T
    inside = (low <= exact + 1e-4) & (exact <= high + 1e-4)
    assert inside[~np.eye(300, dtype=bool)].mean() > 0.99


def test_hilbert_curve_is_continuous():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        key = hilbert_key(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_pack_along_keeps_everything():
    rng = np.random.default_rng(0)
    items = [(i, int(n)) for i, n in enumerate(rng.integers(0, 250, 500))]
    for capacity in (1, 100, 300):
        held, filled = {}, {}
        for box, doc, start, size in pack_along(items, capacity, 16):
            held.setdefault(doc, []).append((start, size))
            filled[box] = filled.get(box, 0) + size
        assert max(filled.values()) <= capacity
        for doc, size in items:
            pieces = sorted(held[doc])
            assert sum(n for _, n in pieces) == size and (len(pieces) == 1) == (size <= capacity)
            assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:]))
    assert list(pack_along([], 5)) == []


def test_packing(spark, monkeypatch):
    texts = [(i, f"word {i} " * (i % 37)) for i in range(400)] + [(900, None), (901, ""), (902, "long text " * 5000), (903, "word 1 "), (904, "word 1 ")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("v0", F.lit(1))
    boxes = spark.createDataFrame([("s", 128), ("w", 4096)], "container_kind string, capacity_tokens int").withColumn("tokens", F.lit(1))
    sizes = {r["doc_id"]: r["n_tokens"] for r in measured(docs).collect()}
    assert 900 not in sizes and sizes[901] == 0 and sizes[902] > 5000
    out = packed(docs, boxes)
    for kind, capacity in (("s", 128), ("w", 4096)):
        own = out.filter(F.col("container_kind") == kind)
        assert {r["doc_id"]: r["n"] for r in own.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()} == sizes
        assert own.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.max("n")).first()[0] <= capacity
    assert {r["container_kind"]: r["filled"] > 0.9 for r in fill_rates(out, boxes).collect()}["s"]
    assert packed(docs.limit(0), boxes).count() == 0
    many = spark.createDataFrame([(f"k{i}", 200 + i) for i in range(5)], "container_kind string, capacity_tokens int")
    monkeypatch.setattr(packing, "KINDS", 2)
    monkeypatch.setattr(packing, "RANGE_ROWS", 50)
    assert {r["container_kind"]: r["n"] for r in packed(docs, many.unionByName(many)).groupBy("container_kind").agg(F.sum("n_tokens").alias("n")).collect()} == {f"k{i}": sum(sizes.values()) for i in range(5)}
    assert packed(docs, boxes.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packed(docs, spark.createDataFrame([("x", 0)], "container_kind string, capacity_tokens int"))


def test_token_counts_are_the_tokenizers(spark):
    import tiktoken  # noqa: F401

    from adlens.llm.packing import PATTERN, tokenizer

    text = "Zażółć gęślą jaźń 123!\n\n  x"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert measured(docs).first()["n_tokens"] == len(tokenizer(TOKENIZER, PATTERN).encode_ordinary(text))


def test_cells_follow_the_table(spark):
    """With a sample far smaller than the table, cells are divided and stay small, and nearly all neighbours are found."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((400, 24))
    x = (centres[rng.integers(0, 400, 6000)] + 0.4 * rng.standard_normal((6000, 24))).astype("f4")
    rows = [(i, "p", "m", 0, "t", 24, v) for i, v in enumerate(x.tolist())]
    emb = spark.createDataFrame([*rows, *[(10_000 + i, "p", "m", 0, "hot", 24, rows[0][6]) for i in range(3000)]], EMB)
    keys = usable(emb).select("space", "key")
    sizes = {s: [r["count"] for r in indexed(usable(emb), keys, 3, home=16, sample=s).dropDuplicates(["cell", "key"]).groupBy("cell").count().collect()] for s in (150, 32_000)}
    assert max(sizes[150]) <= 4 * FIRST * SECOND * 16 and len(sizes[150]) >= 6000 / 64  # each row is in FIRST * SECOND cells
    s = unit(x) @ unit(x).T
    np.fill_diagonal(s, -2)
    want = {(min(i, int(j)), max(i, int(j))) for i in range(0, 6000, 10) for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= 0.8}
    found = neighbours(emb.filter("vec_id < 6000"), sample=150)
    got = {(min(r["vec_id"], r["other_id"]), max(r["vec_id"], r["other_id"])) for r in found.collect()}
    assert len(want & got) >= 0.97 * len(want)


def test_scores_that_rounding_could_decide(spark):
    """Neighbours closer together than the codes' rounding are put in order by the stored vectors."""
    base = np.zeros(8)
    base[0] = 1.0
    rows = [(0, "p", "m", 0, "t", 8, base.tolist())]
    for i in range(1, 8):  # as many as are kept
        v = base.copy()
        v[1] = 0.1 + i * 1e-6
        rows.append((i, "p", "m", 0, "t", 8, v.tolist()))
    edge = [1.0, 0.75 - 1e-6, *[0.0] * 6]
    rows.append((20, "p", "two", 0, "t", 8, base.tolist()))
    rows.append((21, "p", "two", 0, "t", 8, edge))
    rows.append((22, "p", "two", 0, "t", 8, [1.0, 0.0, 0.75 + 1e-6, *[0.0] * 5]))
    emb = spark.createDataFrame(rows, EMB.replace("array<float>", "array<double>"))
    got = {(r["vec_id"], r["other_id"]) for r in neighbours(emb, k=5).collect()}
    assert {o for v, o in got if v == 0} == {1, 2, 3, 4, 5}
    assert (20, 21) in got and (20, 22) not in got
