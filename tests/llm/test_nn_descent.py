"""The descent answers by itself on the tables, its blocks keep what they must, and a missed recall ends in exact links."""

import numpy as np
import pytest

from landlens.llm import embeddings as E


def brute(rows):
    """vec_id to (n_links, component) by all pairs of a label."""
    ids, x, lab = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float), np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = (x @ x.T >= E.THRESHOLD) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(hit, False)
    roots, _ = E._forest(hit)
    first = {r: ids[roots == r].min() for r in set(roots.tolist())}
    return {int(i): (int(n), int(first[r])) for i, n, r in zip(ids, hit.sum(axis=1), roots)}


def planted(seed, n=1500, d=24):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d)) + 2  # off centre
    near = base[: n // 5] + 0.12 * np.linalg.norm(base[: n // 5], axis=1, keepdims=True) * rng.standard_normal((n // 5, d)) / d**0.5
    hub = base[3] + 0.05 * rng.standard_normal((700, d))
    x = np.vstack([base, near, hub, base[:40]])
    return [(3 * i + 7, v.tolist(), i % 2 if i < n else int(i % 2)) for i, v in enumerate(x)]


@pytest.fixture
def no_all_pairs(monkeypatch):
    def fail(nodes):
        raise AssertionError("all pairs were compared")

    monkeypatch.setattr(E, "exact_links", fail)


def test_descent_answers_on_the_table(spark, no_all_pairs):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding, r.label) for r in vectors.collect()])
    got = E.near_vectors(vectors).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


def test_descent_answers_on_near_copies(spark, no_all_pairs):
    rows = planted(4)
    got = E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = brute(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and sum(n > 0 for n, _ in want.values()) > 700


def test_missed_recall_ends_in_exact_links(spark, monkeypatch):
    rows, calls, exact = planted(6, n=200), [], E.exact_links
    monkeypatch.setattr(E, "WANTED_PROBES", 1.1)
    monkeypatch.setattr(E, "MAX_EXTRA_ROUNDS", 0)
    monkeypatch.setattr(E, "exact_links", lambda nodes: calls.append(1) or exact(nodes))
    got = E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows) and calls == [1]


def test_probes_measure_what_the_links_hold(spark):
    nodes = spark.createDataFrame([(g, 1000 + g, "0/3", [1.0, float(g), 2.0]) for g in range(400)], "gid long, node long, grp string, raw array<double>")
    vecs = E.search_vectors(nodes).cache()
    made = {r.gid: np.frombuffer(r.v, "<f2").astype(float) for r in vecs.collect()}
    probes = [g for g in made if g < 0]
    assert 0 < len(probes) < 40 and all(abs(made[g] @ made[-1 - g] - E.PROBE_COSINE) < E.MARGIN for g in probes)
    comp = spark.createDataFrame([], "node long, component long")
    half = spark.createDataFrame([(g, -1 - g, 0.983) for g in probes[::2]] + [(g, (-g) % 400, 0.99) for g in probes[1::2]], "a long, b long, cos double")
    assert E.probe_recall(vecs, half, nodes, comp) == pytest.approx(len(probes[::2]) / len(probes))
    assert E.probe_recall(vecs.where("gid >= 0"), half, nodes, comp) is None


def test_blocks_keep_forests_undecided_pairs_and_nearest():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.standard_normal((6, 32)), 10, axis=0) + 0.06 * rng.standard_normal((60, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f2").astype(np.float32)
    ids = np.arange(60) * 5
    i, j, cos, link = E.block_pairs(ids, np.ones(60, bool), np.full(60, -2.0), x)
    got = np.zeros((60, 60), bool)
    got[i[link], j[link]] = True
    exact = x.astype(float) @ x.astype(float).T >= E.THRESHOLD
    np.fill_diagonal(exact, False)
    assert (E._forest((got | got.T) & exact)[0] == E._forest(exact)[0]).all()
    pairs = set(zip(i.tolist(), j.tolist()))
    full = x @ x.T - 3 * np.eye(60)
    for a in range(60):
        for b in np.argsort(-full[a])[: E.NEIGHBOURS - 1]:
            assert (min(a, b), max(a, b)) in pairs
    old = E.block_pairs(ids, np.zeros(60, bool), np.full(60, -2.0), x)
    assert len(old[0]) == 0  # nothing new, nothing to tell


def test_estimated_sizes_do_not_multiply_from_round_to_round(spark, monkeypatch):
    rows, sizes, recall = planted(5, n=100), [], E.probe_recall

    def asked(*tables):
        sizes.extend(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables)
        return recall(*tables)

    monkeypatch.setattr(E, "probe_recall", asked)
    got = E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)
    assert len(sizes) >= 4 and max(sizes[1], sizes[3]) < 10**8  # links and components; a product has hundreds of digits
