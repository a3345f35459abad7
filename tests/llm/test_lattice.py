import itertools

import numpy as np
from pyspark.sql import functions as F

from lamplight.llm import lattice as la


def brute(rows, cosine=0.93):
    n = len(rows)
    ok = [r.embedding is not None and len(r.embedding) > 0 and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding) and r.label is not None and r.vec_id is not None for r in rows]
    unit = [np.array(r.embedding, float) / np.sqrt((np.array(r.embedding, float) ** 2).sum()) if k else None for r, k in zip(rows, ok, strict=True)]
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(n), 2):
        linked = ok[i] and ok[j] and rows[i].label == rows[j].label and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine
        if linked:
            links[i] += 1
            links[j] += 1
        if linked or (rows[i].vec_id is not None and rows[i].vec_id == rows[j].vec_id and ok[i] and ok[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for i in range(n):
        if ok[i]:
            best[find(i)] = min(best.get(find(i), 1 << 60), rows[i].vec_id)
    out = []
    for i, r in enumerate(rows):
        c = best[find(i)] if ok[i] else r.vec_id
        out.append((r.vec_id, links[i], c, r.vec_id == c))
    return sorted(out, key=repr)


def vectors(spark, seed=3, groups=40, dims=64):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    order = rng.permutation(5000).tolist()
    for g in range(groups):
        base = rng.normal(size=dims)
        base /= np.linalg.norm(base)
        for _ in range(int(rng.integers(1, 9))):
            noise = rng.normal(size=dims) / np.sqrt(dims)
            rows.append((order[k], [float(np.float32(x)) for x in base + rng.choice([0.05, 0.2, 0.3]) * noise], g % 4))
            k += 1
    rows += [(order[k], rows[0][1], rows[0][2]), (order[k + 1], rows[0][1], rows[0][2]), rows[5], rows[5]]
    rows += [(6000, None, 1), (6001, [], 1), (6002, [0.0] * dims, 1), (6003, [None] + [1.0] * (dims - 1), 1), (6004, [float("nan")] * dims, 1), (6005, [float("inf")] * dims, 1), (6006, rows[0][1], None), (None, rows[0][1], rows[0][2]), (6007, [1.0, 2.0], 1), (6008, [2.0, 4.0], 1), (6009, [x * 1e30 for x in rows[1][1]], rows[1][2])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("own") for c in ("cell", "rep", "digest", "n_links", "vec", "dims")})


def test_equals_brute_force(spark):
    df = vectors(spark)
    want = brute(df.collect())
    assert sorted(map(tuple, la.link_embeddings(df).collect()), key=repr) == want
    assert sum(x[1] for x in want) > 50


def test_blocks_give_the_same(spark):
    df = vectors(spark, seed=4, groups=12)
    want = brute(df.collect())
    assert sorted(map(tuple, la.link_embeddings(df, block=2).collect()), key=repr) == want


def test_empty(spark):
    assert la.link_embeddings(vectors(spark).limit(0)).count() == 0


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(2)
    y = rng.normal(size=(300, 8)) * 2
    p = la.nearest(y)
    d = ((y - p) ** 2).sum(axis=1)
    assert (d <= 1 + 1e-9).all()  # covering radius
    for u in la.shortest():
        assert (d <= ((y - p - u) ** 2).sum(axis=1) + 1e-9).all()
    assert (np.abs(np.rint(p * 2) - p * 2) < 1e-9).all() and (np.rint(p.sum(axis=1)) % 2 == 0).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(8)
    v = rng.normal(size=(3000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    w = rng.normal(size=(3000, 64))
    w -= (w * v).sum(axis=1)[:, None] * v
    w /= np.linalg.norm(w, axis=1)[:, None]
    a, b = la.cells(v), la.cells(0.93 * v + np.sqrt(1 - 0.93**2) * w)
    met = (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean()
    assert met > 0.998


def test_components(spark, monkeypatch):
    from lamplight.llm import common

    rng = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(50)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(pairs, "a long, b long")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    want = sorted((x, find(x)) for x in list(root))
    assert sorted(map(tuple, common.components(df).collect())) == want
    monkeypatch.setattr(common, "CONTRACTED", 40)
    assert sorted(map(tuple, common.components(df).collect())) == want
    assert common.components(df.limit(0)).count() == 0


def test_ids_of_other_types(spark):
    df = vectors(spark, seed=5, groups=12)
    name = lambda x: None if x is None else f"v{x:05d}"
    want = sorted(((name(i), n, name(c), k) for i, n, c, k in brute(df.collect())), key=repr)
    assert sorted(map(tuple, la.link_embeddings(df.withColumn("vec_id", F.when(F.col("vec_id").isNotNull(), F.format_string("v%05d", "vec_id")))).collect()), key=repr) == want
