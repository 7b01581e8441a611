"""Vector and clustering operators against brute force (NumPy) on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from themescope.functions import vector as vx
from themescope.operators import cluster as cl
from themescope.operators import kmeans as km
from themescope.operators import neighbours as nn


def blobs(spark, n_per=20, k=3, d=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = np.eye(d)[:k] * 10
    rows = []
    for c in range(k):
        for i in range(n_per):
            v = centres[c] + rng.normal(0, 0.3, d)
            rows.append((f"{c}-{i:03d}", [float(x) for x in v], c))
    return spark.createDataFrame(rows, "id STRING, embedding ARRAY<FLOAT>, label INT"), rows


def brute_silhouette(X, labels):
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    s = []
    for i in range(len(X)):
        own = labels == labels[i]
        if own.sum() <= 1:
            s.append(0.0)
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, labels == c].mean() for c in set(labels) if c != labels[i])
        s.append(0.0 if max(a, b) == 0 else (b - a) / max(a, b))
    return float(np.mean(s))


def test_zero_vector_and_cosine(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    r = df.select(vx.l2_normalize("a").alias("n"), vx.cosine("a", "b").alias("c")).collect()
    assert r[0].n == [0.0, 0.0] and r[0].c == 0.0
    assert r[1].n == [0.6, 0.8] and abs(r[1].c - 1.0) < 1e-12


def test_assign_ties_go_to_lowest_id(spark):
    df = spark.createDataFrame([("p", [1.0, 0.0])], "id STRING, embedding ARRAY<DOUBLE>")
    centres = cl.centres_literal([{"cluster": 4, "center": [0.0, 1.0]}, {"cluster": 2, "center": [0.0, -1.0]}])
    assert cl.assign_nearest(df, centres).first().cluster == 2


def test_silhouette_exact_vs_brute_force(spark):
    df, rows = blobs(spark, n_per=15)
    X = np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows])
    labels[0] = 2                                           # make the clusters less perfect
    df = df.withColumn("label", F.when(F.col("id") == rows[0][0], 2).otherwise(F.col("label")))
    got = cl.silhouette_exact(df, cluster_col="label", block_rows=8).first()
    assert got.n == len(rows)
    assert abs(got.silhouette - brute_silhouette(X, labels)) < 1e-9


def test_silhouette_singleton_is_zero(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], 0), ("b", [0.0, 1.0], 1), ("c", [0.1, 1.0], 1)],
                               "id STRING, embedding ARRAY<DOUBLE>, label INT")
    pts = {r.id: r.silhouette for r in cl.silhouette_points(df, cluster_col="label").collect()}
    assert pts["a"] == 0.0 and -1 <= pts["b"] <= 1


def test_silhouette_squared_equals_spark_evaluator(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector
    df, _ = blobs(spark, n_per=10)
    ours = cl.silhouette_squared(df, cluster_col="label").first().silhouette
    feats = df.select(array_to_vector(vx.l2_normalize("embedding")).alias("features"),
                      F.col("label").cast("double").alias("prediction"))
    theirs = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(feats)
    assert abs(ours - theirs) < 1e-9


def test_knn_vs_brute_force(spark):
    df, rows = blobs(spark, n_per=12, d=6, seed=3)
    X = np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
    ids = [r[0] for r in rows]
    got = nn.knn_graph(df, k=5, block_rows=7).collect()
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    want = {ids[i]: [ids[j] for j in np.argsort(D[i], kind="stable")[:5]] for i in range(len(ids))}
    have = {}
    for r in sorted(got, key=lambda r: (r.id, r.rank)):
        have.setdefault(r.id, []).append(r.nbr)
    assert have == want


def test_fuzzy_weights_sum_to_log2k(spark):
    df, _ = blobs(spark, n_per=10, d=5)
    g = nn.knn_graph(df, k=6, block_rows=16)
    mass = nn.neighbour_mass(g, k=6).collect()
    assert all(abs(r.mass - math.log2(6)) < 1e-6 for r in mass)
    e = nn.fuzzy_edges(g, k=6)
    w = {(r.src, r.dst): r.weight for r in e.collect()}
    assert all(abs(w[(a, b)] - w[(b, a)]) < 1e-12 for (a, b) in w)         # symmetric
    assert all(0 <= x <= 1 for x in w.values())


def test_kmeans_recovers_blobs_and_is_reproducible(spark):
    df, rows = blobs(spark, n_per=20, k=3)
    model, cost = km.kmeans_fit(df, 3, n_init=3)
    labels = {r.id: r.cluster for r in km.kmeans_labels(df, model).collect()}
    groups = {}
    for rid, _, true in rows:
        groups.setdefault(true, set()).add(labels[rid])
    assert all(len(v) == 1 for v in groups.values()) and len({next(iter(v)) for v in groups.values()}) == 3
    model2, cost2 = km.kmeans_fit(df, 3, n_init=3)
    labels2 = {r.id: r.cluster for r in km.kmeans_labels(df, model2).collect()}
    assert labels2 == labels                                 # same seed, same clustering
    assert abs(cost - cost2) <= 1e-12 * max(1.0, cost)       # cost up to summation order


def test_lloyd_inertia_does_not_increase(spark):
    df, _ = blobs(spark, n_per=10, k=3)
    start = cl.centroids_from_labels(df.withColumn("g", (F.col("label") + F.length("id")) % 3), "g")
    rows0 = start.collect()
    i0 = cl.inertia(cl.assign_nearest(df, cl.centres_literal(rows0))).first().inertia
    rows1 = cl.lloyd_steps(df, start, 1)
    i1 = cl.inertia(cl.assign_nearest(df, cl.centres_literal(rows1))).first().inertia
    assert i1 <= i0 + 1e-12


def test_small_results_are_size_checked(spark):
    with pytest.raises(ValueError):
        cl.collect_small(spark.range(5), 4)
    with pytest.raises(ValueError):
        cl.centres_literal([{"cluster": 0, "center": [0.0] * (cl.MAX_CENTRE_CELLS + 1)}])


def test_elbow_helper():
    assert cl.elbow_k([(2, 10.0), (3, 4.0), (4, 3.5), (5, 3.2)]) == 3


def test_project_2d_centred(spark):
    df, _ = blobs(spark, n_per=10)
    p = nn.project_2d(df)
    m = p.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.variance("x").alias("vx"),
              F.variance("y").alias("vy")).first()
    assert abs(m.mx) < 1e-9 and abs(m.my) < 1e-9 and m.vx >= m.vy > 0


def test_layout_epochs_keep_blobs_apart(spark):
    from themescope.operators import layout as lo
    df, rows = blobs(spark, n_per=12, k=3, d=6, seed=5)
    g = nn.knn_graph(df, k=5, block_rows=16)
    edges = nn.fuzzy_edges(g, k=5)
    out = {r.id: (r.x, r.y) for r in lo.layout_epochs(edges, nn.project_2d(df), epochs=15).collect()}
    assert len(out) == len(rows) and all(np.isfinite(v).all() for v in out.values())
    P = np.array([out[r[0]] for r in rows])
    lab = np.array([r[2] for r in rows])
    D = np.sqrt(((P[:, None] - P[None]) ** 2).sum(-1))
    same = D[lab[:, None] == lab[None]].mean()
    diff = D[lab[:, None] != lab[None]].mean()
    assert same < diff


def test_fit_ab_matches_curve():
    from themescope.operators import layout as lo
    a, b = lo.fit_ab(0.1, 1.0)
    x = np.linspace(0.2, 2.5, 20)
    assert np.abs(1 / (1 + a * x ** (2 * b)) - np.exp(-(x - 0.1))).max() < 0.1


def test_elbow_takes_the_best_start_of_each_k(spark):
    df, _ = blobs(spark, n_per=10, k=3, seed=11)
    a = km.elbow_curve(df, max_k=4, n_init=2)
    assert [k for k, _ in a] == [2, 3, 4]
    for k, cost in a:
        best = km.kmeans_fit(df, k, n_init=2)[1]
        assert abs(cost - best) <= 1e-9 * max(1.0, best)
    assert a[1][1] <= a[0][1] + 1e-9                          # k=3 no worse than k=2 here


def test_similar_pairs_and_bands_match_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(0, 1, (6, 5))
    X = np.vstack([base, base[:3] + rng.normal(0, 0.05, (3, 5)), np.zeros((1, 5)), rng.normal(0, 1, (8, 5))])
    rows = [(f"p{i}", [float(x) for x in v], i) for i, v in enumerate(X)]
    df = spark.createDataFrame(rows, "id STRING, embedding ARRAY<DOUBLE>, ord BIGINT")
    norms = np.linalg.norm(X, axis=1)
    U = np.divide(X, norms[:, None], out=np.zeros_like(X), where=norms[:, None] > 0)
    S = U @ U.T
    iu = np.triu_indices(len(X), 1)
    want = {(f"p{i}", f"p{j}"): S[i, j] for i, j in zip(*iu) if S[i, j] > 0.3}
    for block_rows in (3, 1000):
        got = {(r.id_a, r.id_b): r.sim for r in nn.similar_pairs(df, 0.3, block_rows=block_rows).collect()}
        assert set(got) == set(want)
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
        bands = {r.band: r.n_pairs for r in nn.similarity_band_counts(df, block_rows=block_rows).collect()}
        s = S[iu]
        assert bands.get("very similar", 0) == int((s > 0.6).sum())
        assert bands.get("loosely related", 0) == int(((s > 0.3) & (s <= 0.6)).sum())
        assert sum(bands.values()) == len(s)


def test_pair_operators_on_empty_and_single_row(spark):
    empty = spark.createDataFrame([], "id STRING, embedding ARRAY<DOUBLE>, ord BIGINT")
    assert nn.similar_pairs(empty, 0.3).count() == 0
    assert nn.similarity_band_counts(empty).count() == 0
    one = spark.createDataFrame([("a", [1.0, 0.0], 0)], "id STRING, embedding ARRAY<DOUBLE>, ord BIGINT")
    assert nn.similar_pairs(one, -1.0).count() == 0
    assert nn.similarity_band_counts(one).count() == 0


def test_knn_ties_go_to_the_lowest_ids(spark):
    """300 equal vectors: the three lowest other ids, whatever the block size."""
    from themescope.operators.neighbours import knn_graph
    df = spark.createDataFrame([(f"{i:03d}", [1.0, 2.0]) for i in range(300)], "id string, embedding array<double>")
    for rows in (32, 300):
        got = {}
        for r in knn_graph(df, 3, block_rows=rows).collect():
            got.setdefault(r.id, []).append((r["rank"], r.nbr))
        for i, nbrs in got.items():
            assert [n for _, n in sorted(nbrs)] == [x for x in ("000", "001", "002", "003") if x != i][:3]
        assert len(got) == 300


def plain_kmeans(ids, X, k, seed, tol=1e-4, max_iter=300):
    """One start in plain NumPy: the same draws, distances as sums of squared differences."""
    import hashlib
    h = np.array([int(hashlib.md5(i.encode()).hexdigest()[:15], 16) for i in ids], np.uint64)
    centres = []
    for step in range(k):
        w = np.ones(len(X)) if not centres else np.min([((X - c) ** 2).sum(1) for c in centres], axis=0)
        with np.errstate(divide="ignore"):
            centres.append(X[np.argmin(-np.log(km.uniform(h, seed, step)) / np.where(w < 1e-12, 0.0, w))])
    C = np.array(centres)
    for _ in range(max_iter):
        near = ((X[:, None] - C[None]) ** 2).sum(-1).argmin(1)
        new = np.array([X[near == c].mean(0) if (near == c).any() else C[c] for c in range(k)])
        moved, C = ((new - C) ** 2).sum(), new
        if moved <= tol * X.var(0).mean():
            break
    D = ((X[:, None] - C[None]) ** 2).sum(-1)
    return D.min(1).sum(), D.argmin(1)


def test_kmeans_and_elbow_equal_plain_numpy_on_the_whole_table(spark):
    """Every start of kmeans_fit (k = 5) and of elbow_curve (k = 2..10) over all vectors of sf0.001."""
    from themescope import fixtures as fx
    v = fx.vectors(spark, "/root/testdata/sf0.001")
    rows = v.select("id", "embedding").collect()
    ids, X = [r.id for r in rows], np.array([r.embedding for r in rows])
    X = X / np.linalg.norm(X, axis=1, keepdims=True)
    plain = {(k, s): plain_kmeans(ids, X, k, s) for k in range(2, 11) for s in range(42, 52)}
    for k, cost in km.elbow_curve(v):
        assert abs(cost - min(plain[k, s][0] for s in range(42, 52))) < 1e-9
    model, cost = km.kmeans_fit(v, 5)
    want = min(((round(plain[5, s][0], 9), s) for s in range(42, 52)))
    assert (round(cost, 9), model.seed) == want
    groups = {}
    for r in km.kmeans_labels(v, model).select("id", "cluster").collect():
        groups.setdefault(r.cluster, set()).add(r.id)
    near = plain[5, model.seed][1]
    sets = [{i for i, c in zip(ids, near) if c == x} for x in range(5)]
    sets.sort(key=lambda s: (-len(s), min(s)))
    assert [groups[c] for c in range(5)] == sets


def test_kmeans_reads_the_vectors_once_a_pass(spark, monkeypatch):
    df, _ = blobs(spark, n_per=10, k=3)
    passes = []
    real = km._pass
    monkeypatch.setattr(km, "_pass", lambda v, sets: passes.append(len(sets)) or real(v, sets))
    km.elbow_curve(df, max_k=5, n_init=4)
    assert passes[0] == 16 and passes[-1] == 16               # all starts in one pass, and for the final cost
    assert sorted(passes[:-1], reverse=True) == passes[:-1]   # converged starts leave


def test_kmeans_of_awkward_tables(spark):
    schema = "id STRING, embedding ARRAY<DOUBLE>"
    two = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 2.0]), ("c", [0.0, 2.0]), (None, [0.0, 1.0]), ("n", None)], schema)
    model, cost = km.kmeans_fit(two, 4, n_init=2)
    assert len(model.centres) == 2 and cost < 1e-12            # fewer different vectors than k
    got = {(r.id, r.cluster) for r in km.kmeans_labels(two, model).collect()}
    assert got == {("c", 0), (None, 0), ("a", 1), ("b", 1), ("n", None)}
    with pytest.raises(ValueError):
        km.kmeans_fit(two.limit(0), 2)


def brute_knn(ids, X, k):
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    D[np.array(ids)[:, None] == np.array(ids)[None]] = np.inf
    return {i: [ids[j] for j in sorted(range(len(ids)), key=lambda j: (d[j], ids[j]))[:k] if np.isfinite(d[j])] for i, d in zip(ids, D)}


@pytest.mark.parametrize("spread", [0.05, 10.0])
def test_knn_cells_lose_nothing(spark, spread):
    """Clustered rows meet few blocks, unclustered ones nearly all; neighbours are exact in both."""
    from themescope.operators import knn
    rng = np.random.default_rng(2)
    C = rng.normal(0, 1, (12, 6))
    X = np.concatenate((C[rng.integers(0, 12, 400)] + rng.normal(0, spread, (400, 6)), np.zeros((5, 6)), C[:1].repeat(60, 0)))
    ids = [f"{i:04d}" for i in rng.permutation(len(X))]
    df = spark.createDataFrame([*((i, x.tolist(), "c") for i, x in zip(ids, X)), ("null", None, "c")], "id string, embedding array<double>, block string")
    _, _, meets, n = knn.knn_blocks(df, 4, block_rows=25)
    pairs = meets.select("block", "meets").distinct().count()
    assert n > 15 and (pairs < 0.5 * n * (n - 1) if spread < 1 else pairs <= n * (n - 1))
    got = {}
    for r in sorted(nn.knn_graph(df, 4, block_rows=25).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.id, []).append(r.nbr)
    assert got == brute_knn(ids, X, 4)


def test_knn_of_awkward_tables(spark):
    df = spark.createDataFrame([("a", [0.0]), ("a", [1.0]), ("b", [1.0]), ("c", None), (None, [5.0])], "id string, embedding array<double>")
    got = {(r.id, r.nbr, r["rank"], r.dist) for r in nn.knn_graph(df.where("id is not null"), 3).collect()}
    assert got == {("a", "b", 1, 0.0), ("a", "b", 2, 1.0), ("b", "a", 1, 0.0), ("b", "a", 2, 1.0)}
    assert nn.knn_graph(df.limit(0), 3).collect() == []
    assert nn.knn_graph(df.where("id = 'b'"), 3).collect() == []


def plain_layout(ids, edges, init, epochs, total, negatives=5, seed=42):
    """Epochs in plain Python loops over edges and nodes."""
    import hashlib
    from themescope.operators import layout as lo
    a, b = lo.fit_ab()
    h = {i: np.array([int(hashlib.md5(i.encode()).hexdigest()[:15], 16)], np.int64) for i in ids}
    at = {i: np.array(init[i]) * lo.INIT_EXTENT / max(abs(v) for xy in init.values() for v in xy) for i in ids}
    top = max(w for _, _, w in edges)
    rate = {i: sum(w for s, _, w in edges if s == i) / top for i in ids}
    for epoch in range(epochs):
        grad = {i: np.zeros(2) for i in ids}
        for s, d, w in edges:
            diff = at[s] - at[d]
            d2 = float(diff @ diff)
            if d2 > 0:
                grad[s] += w * np.clip(-2 * a * b * d2 ** (b - 1) / (1 + a * d2 ** b) * diff, -4, 4)
        u = {i: lo.uniform(h[i], seed, epoch)[0] for i in ids}
        pool = sorted((i for i in ids if u[i] < lo.POOL / len(ids)), key=lambda i: (u[i], h[i][0]))
        for i in ids:
            for s in range(negatives if pool else 0):
                j = pool[int(lo.uniform(h[i], seed + 1 + s, epoch)[0] * len(pool))]
                if j != i:
                    diff = at[i] - at[j]
                    d2 = float(diff @ diff)
                    grad[i] += rate[i] * np.clip(2 * b / ((lo.REPULSION_EPS + d2) * (1 + a * d2 ** b)) * diff, -4, 4)
        at = {i: at[i] + (1 - epoch / total) * grad[i] for i in ids}
    return at


@pytest.mark.parametrize("parts", [1, 3])
def test_layout_equals_plain_epochs(spark, monkeypatch, parts):
    from themescope.operators import layout as lo
    monkeypatch.setattr(lo, "POOL", 20)
    monkeypatch.setattr(lo, "CHECKPOINT_EPOCHS", 2)
    df, _ = blobs(spark, n_per=12, k=3, d=6, seed=5)
    edges = nn.fuzzy_edges(nn.knn_graph(df, k=5, block_rows=16), k=5)
    e, p = [tuple(r) for r in edges.collect()], {r.id: (r.x, r.y) for r in nn.project_2d(df).collect()}
    init = spark.createDataFrame([(i, *xy) for i, xy in p.items()], "id string, x double, y double")
    got = {r.id: (r.x, r.y) for r in lo.layout_epochs(spark.createDataFrame(e, "src string, dst string, weight double"), init, epochs=3, parts=parts).collect()}
    want = plain_layout(list(p), e, p, 3, 3)
    assert got.keys() == want.keys()
    assert max(abs(np.array(got[i]) - want[i]).max() for i in want) < 1e-9
    assert lo.layout_epochs(edges.limit(0), init.limit(0)).collect() == []
    assert len(lo.layout_epochs(edges.limit(0), init, epochs=2, parts=parts).collect()) == len(p)
