"""Near-duplicate vectors by NN-descent.

Vectors of one label are compared. Exact copies are folded first, so the graph has one node for each different
vector. A neighbour graph starts from the leaves of random-projection trees around each label's mean and is refined
by joins with the neighbours of neighbours, of which one at least is new, until few list entries change; where all
neighbours of a node are over the threshold its list is enlarged. Recall is measured twice: planted probes,
which are nodes turned by a known angle and stand in no result, must reach the component of their origin, and the links
of one vec_id in fifty must stand as brute force has them. The edges over the threshold are kept.

Only ids and half-precision unit vectors are shuffled by the search; a pair that half precision cannot decide is
decided by the double-precision vectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stable import checkpoint, measured
from .common import components, join_skewed, release

#: Parameters. Neighbours in a list and in the list of a node with all of them over the threshold, trees, planes a
#: tree at most, vectors in a leaf, neighbours of one centre and vectors of a label compared together, refining rounds
#: at most and share of changed list entries that ends them, one vec_id in how many is audited, wanted recall.
THRESHOLD = 0.98
NEIGHBOURS, ENLARGED = 12, 32
TREES = 8
PLANES = 24
LEAF = 128
CENTRE_PART = 64
LABEL_PART = 1024
MAX_ROUNDS = 8
FEW_CHANGES = 0.002
AUDIT_EVERY = 50
AUDIT_SLICE = 5000
WANTED_RECALL = 0.999
MAX_EXTRA_ROUNDS = 2
#: One node in how many is planted again as a probe, the probe's cosine with its origin, and the wanted share found.
PROBE_EVERY, PROBE_COSINE, WANTED_PROBES = 50, 0.983, 0.99
#: Half precision moves a unit vector by less than 2^-11 of its length, hence a cosine by less than this.
MARGIN = 0.0011


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """One row per vec_id with a label and a non-zero, finite vector: ``vec_id, grp, raw``; grp is label and length."""
    comps = F.col(vector_col).cast("array<double>")
    sound = F.size(comps) > 0
    sound = sound & F.forall(comps, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(comps, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(sound)
    grp = F.concat_ws("/", F.col(label_col).cast("string"), F.size(comps).cast("string"))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), grp.alias("grp"), comps.alias("raw")).groupBy("vec_id").agg(F.max(F.struct("grp", "raw")).alias("v")).select("vec_id", "v.grp", "v.raw")


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """Nodes of the graph: ``node`` (smallest vec_id), ``mult`` (vec_ids with this vector), ``grp``, ``raw``."""
    return rows.groupBy("grp", "raw").agg(F.min("vec_id").alias("node"), F.count("*").alias("mult")).select("node", "mult", "grp", "raw")


def _unit(rows) -> np.ndarray:
    """Unit vectors of an Arrow array of lists of one length, or of rows."""
    x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) if hasattr(rows, "flatten") else np.array(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def search_vectors(nodes: DataFrame) -> DataFrame:
    """``gid, grp, v``: the half-precision unit vector of each of ``nodes(gid, node, grp, raw)``, and of the probes.

    A probe has the id -1 - gid of its origin. Which nodes get one, and the direction it is turned in, follow from the
    node alone."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            gids, grps, out = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for gid, grp, raw, planted in zip(gids, grps, b.column(2), b.column(3).to_pylist()):
                x = _unit([raw.values.to_numpy(zero_copy_only=False)])[0]
                out.append((gid, grp, x))
                if planted:
                    side = np.random.default_rng(gid).standard_normal(len(x))
                    side -= (side @ x) * x
                    length = np.linalg.norm(side)
                    out.append((-1 - gid, grp, PROBE_COSINE * x + (1 - PROBE_COSINE**2) ** 0.5 * side / length if length > 1e-9 else x))
            ids, grps, vs = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grps, pa.string()), pa.array([v.astype("<f2").tobytes() for v in vs], pa.binary())], names=["gid", "grp", "v"])

    return nodes.select("gid", "grp", "raw", F.pmod(F.xxhash64("node"), F.lit(PROBE_EVERY)) == 0).mapInArrow(run, "gid long, grp string, v binary")


def _matrix(binaries) -> np.ndarray:
    """Single-precision matrix of an Arrow array of half-precision vectors of one length."""
    return np.frombuffer(b"".join(binaries.to_pylist()), "<f2").reshape(len(binaries), -1).astype(np.float32)


def label_means(vecs: DataFrame) -> DataFrame:
    """``grp, n, mean``: size and mean vector of each label; sums are built per batch before anything is shuffled."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            groups = np.array(b.column(0).to_pylist(), dtype=object)
            names, sums, sizes = sorted(set(groups.tolist())), [], []
            for g in names:
                x = _matrix(b.column(1).take(pa.array(np.flatnonzero(groups == g))))
                sums.append(x.sum(axis=0, dtype=np.float64).tolist())
                sizes.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], names=["grp", "n", "sums"])

    part = vecs.select("grp", "v").mapInArrow(run, "grp string, n long, sums array<double>")
    cells = part.select("grp", "n", F.posexplode("sums").alias("pos", "s")).groupBy("grp", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    cells = cells.groupBy("grp").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("cells"))
    return cells.select("grp", "n", F.transform("cells", lambda c: c["s"] / F.col("n")).alias("mean"))


_made: dict[tuple[int, int], np.ndarray] = {}


def _planes(dims: int, seed: int) -> np.ndarray:
    if (dims, seed) not in _made:
        _made[dims, seed] = np.random.default_rng((seed, dims)).standard_normal((TREES * PLANES, dims))
    return _made[dims, seed]


def tree_blocks(vecs: DataFrame, means: DataFrame, seed: int) -> DataFrame:
    """Leaves of the trees as blocks of ``items``. A label of n vectors uses log2(n/LEAF) planes through its mean; a leaf
    over twice LEAF is dealt into parts at random, other ones in each tree, and what they miss is left to the rounds."""
    depth = F.least(F.lit(PLANES), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(LEAF))))).cast("int")

    def run(batches):
        import pyarrow as pa

        weights = 1 << np.arange(PLANES - 1, -1, -1)
        for b in batches:
            codes = []
            for v, mean, d in zip(b.column(2).to_pylist(), b.column(3), b.column(4).to_pylist()):
                x = np.frombuffer(v, "<f2").astype(np.float64) - mean.values.to_numpy(zero_copy_only=False)
                bits = (_planes(len(x), seed) @ x).reshape(TREES, PLANES) > 0
                codes.append(((bits @ weights) >> (PLANES - d)).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.list_(pa.int64()))], names=["gid", "grp", "codes"])

    placed = vecs.join(means, "grp").select("gid", "grp", "v", "mean", depth.alias("depth")).mapInArrow(run, "gid long, grp string, codes array<long>")
    placed = checkpoint(placed.select("gid", "grp", F.posexplode("codes").alias("tree", "leaf")))
    large = placed.groupBy("grp", "tree", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * LEAF)
    parts = F.coalesce(F.ceil(F.col("n") / LEAF), F.lit(1))
    placed = placed.join(checkpoint(large), ["grp", "tree", "leaf"], "left").withColumn("part", F.pmod(F.xxhash64("gid", "tree", F.lit(seed)), parts))
    rows = placed.select("gid", "grp", "tree", "leaf", "part").join(vecs.select("gid", "v"), "gid")
    item = F.struct("gid", F.lit(True).alias("fresh"), F.lit(-2.0).alias("bound"), "v")
    return rows.groupBy("grp", "tree", "leaf", "part").agg(F.collect_list(item).alias("items")).select("items")


def _forest(hit: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Root of each row of a symmetric matrix of links, and the links of a spanning forest."""
    root, kept = np.full(len(hit), -1), []
    for s in range(len(hit)):
        if root[s] < 0:
            root[s], todo = s, [s]
            while todo:
                u = todo.pop()
                more = np.flatnonzero(hit[u] & (root < 0))
                root[more] = s
                kept += [(u, w) for w in more.tolist()]
                todo += more.tolist()
    return root, kept


def block_pairs(ids: np.ndarray, fresh: np.ndarray, bound: np.ndarray, x: np.ndarray):
    """Pairs worth keeping of one block, as index arrays ``i, j``, cosines and whether a pair is (or may be) a link.

    A pair with a new member counts if it enters the list of either member, whose worst entry is ``bound``. Of links
    between nodes a spanning forest is kept, with all undecided pairs between its trees; of a probe's, one a tree."""
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    new = fresh[:, None] | fresh[None, :]
    wanted = np.where(new & (cos > bound[:, None]), cos, -2)
    k = min(NEIGHBOURS, len(ids) - 1)
    near = np.argpartition(-wanted, k - 1, axis=1)[:, :k]
    keep = np.zeros(cos.shape, bool)
    np.put_along_axis(keep, near, True, axis=1)
    keep &= wanted > -2
    link = np.zeros(cos.shape, bool)
    if (cos >= THRESHOLD - MARGIN).any():
        real = ids >= 0
        both = real[:, None] & real[None, :]
        sure = (cos >= THRESHOLD + MARGIN) & both
        root, forest = _forest(sure)
        for i, j in forest:
            link[i, j] = True
        link |= (cos >= THRESHOLD - MARGIN) & (cos < THRESHOLD + MARGIN) & both & (root[:, None] != root[None, :])
        link &= new
        for i in np.flatnonzero(~real):
            at = np.flatnonzero((cos[i] >= THRESHOLD + MARGIN) & real)
            link[i, at[np.unique(root[at], return_index=True)[1]]] = True
    link |= link.T
    i, j = np.nonzero(np.triu(keep | keep.T | link))
    return i, j, cos[i, j], link[i, j]


def compare(blocks: DataFrame) -> DataFrame:
    """``a, b, cos, link`` (a < b) found in blocks of ``items(gid, fresh, bound, v)``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, b, c, l = [], [], [], []
            for items in batch.column(0):
                v = items.values
                ids = v.field("gid").to_numpy()
                i, j, cos, link = block_pairs(ids, v.field("fresh").to_numpy(zero_copy_only=False), v.field("bound").to_numpy(), _matrix(v.field("v")))
                a.append(np.minimum(ids[i], ids[j]))
                b.append(np.maximum(ids[i], ids[j]))
                c.append(cos.astype(np.float64))
                l.append(link)
            cols = [np.concatenate(z) if z else np.array([], t) for z, t in ((a, "int64"), (b, "int64"), (c, "float64"), (l, "bool"))]
            yield pa.RecordBatch.from_arrays([pa.array(z) for z in cols], names=["a", "b", "cos", "link"])

    found = blocks.where(F.size("items") > 1).select("items").mapInArrow(run, "a long, b long, cos double, link boolean")
    return found.groupBy("a", "b").agg(F.max("cos").alias("cos"), F.max("link").alias("link"))


def neighbour_lists(pairs: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``node, nbr, cos, fresh``: the NEIGHBOURS nearest of each node, and up to ENLARGED where all those are over the
    threshold, from new pairs and the lists before them."""
    a, b, new = F.col("a"), F.col("b"), F.lit(True).alias("fresh")
    both = pairs.select(F.explode(F.array(F.struct(a.alias("node"), b.alias("nbr")), F.struct(b.alias("node"), a.alias("nbr")))).alias("e"), "cos").select("e.*", "cos", new)
    if before is not None:
        both = both.unionByName(before.withColumn("fresh", F.lit(False))).groupBy("node", "nbr").agg(F.max("cos").alias("cos"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("cos"), "nbr"))
    most = F.when(F.col("cos") >= THRESHOLD, ENLARGED).otherwise(NEIGHBOURS)
    return both.withColumn("rank", rank).where(F.col("rank") <= ENLARGED).where(F.col("rank") <= most).drop("rank")


def refine_blocks(lists: DataFrame, vecs: DataFrame, turn: int) -> DataFrame:
    """Neighbours of neighbours: what stands in the lists around one centre, both ways, as blocks of ``items``.

    Centres without a new neighbour are done. A centre in very many lists has its neighbours dealt into parts at
    random, other ones each turn."""
    around = lists.select(F.col("node").alias("centre"), F.col("nbr").alias("gid"), "fresh").unionByName(lists.select(F.col("nbr").alias("centre"), F.col("node").alias("gid"), "fresh"))
    around = around.groupBy("centre", "gid").agg(F.max("fresh").alias("fresh"))
    sizes = around.groupBy("centre").agg(F.count("*").alias("n"), F.max("fresh").alias("new")).where("new and n > 1")
    part = F.pmod(F.xxhash64("gid", F.lit(turn)), F.ceil(F.col("n") / CENTRE_PART))
    around = join_skewed(around, sizes, ["centre"]).select("centre", "gid", "fresh", part.alias("part"))
    worst, n = F.min("cos"), F.count("*")
    bound = F.when(n < NEIGHBOURS, -2.0).when(n >= ENLARGED, worst).otherwise(F.least(worst, F.lit(THRESHOLD)))
    known = vecs.select("gid", "v").join(lists.groupBy(F.col("node").alias("gid")).agg(bound.alias("bound")), "gid", "left")
    rows = around.join(known, "gid").withColumn("bound", F.coalesce("bound", F.lit(-2.0)))
    blocks = rows.groupBy("centre", "part").agg(F.collect_list(F.struct("gid", "fresh", "bound", "v")).alias("items"))
    return blocks.where(F.exists("items", lambda x: x["fresh"])).select("items")


def descend(pairs: DataFrame, links: DataFrame, before: DataFrame | None, vecs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Lists and links after refining ``pairs`` until few list entries change."""
    lists, links = measured(neighbour_lists(pairs, before)), links.unionByName(pairs.where("link").drop("link"))
    for turn in range(MAX_ROUNDS):
        pairs = checkpoint(compare(refine_blocks(lists, vecs, seed * MAX_ROUNDS + turn)))
        lists, links = measured(neighbour_lists(pairs, lists)), links.unionByName(pairs.where("link").drop("link"))
        changes = lists.agg(F.count_if("fresh").alias("new"), F.count("*").alias("n")).first()
        release(vecs.sparkSession)
        if changes.new <= FEW_CHANGES * changes.n:
            break
    return lists, measured(links.groupBy("a", "b").agg(F.max("cos").alias("cos")))


def decided(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b`` of the links between nodes; those within the margin are decided by the double-precision vectors."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            near = [float(_unit([p])[0] @ _unit([q])[0]) >= THRESHOLD for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    real = links.where("a >= 0 and b >= 0")
    open_ = real.where(F.col("cos") < THRESHOLD + MARGIN).join(nodes.select(F.col("gid").alias("a"), F.col("raw").alias("p")), "a").join(nodes.select(F.col("gid").alias("b"), F.col("raw").alias("q")), "b")
    return real.where(F.col("cos") >= THRESHOLD + MARGIN).select("a", "b").unionByName(open_.select("a", "b", "p", "q").mapInArrow(run, "a long, b long"))


def named_components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, component``: components of links between gids, named by their smallest vec_id; nodes without links have none."""
    held = checkpoint(nodes.select("gid", "node").join(components(links).select(F.col("node").alias("gid"), "component"), "gid"))
    tops = held.groupBy("component").agg(F.min("node").alias("top"))
    named = measured(join_skewed(held, tops, ["component"]).select("node", F.col("top").alias("component")))
    release(nodes.sparkSession)
    return named


def probe_recall(vecs: DataFrame, links: DataFrame, nodes: DataFrame, comp: DataFrame) -> float | None:
    """Share of the probes linked to their origin or to a node of its component; None without probes."""
    homes = nodes.select("gid", "node").join(comp, "node", "left").select("gid", F.coalesce("component", "node").alias("home"))
    met = links.where("a < 0 and b >= 0").select(F.col("a").alias("probe"), F.col("b").alias("gid")).join(homes, "gid").select("probe", F.col("home").alias("reached"))
    planted = vecs.where("gid < 0").select(F.col("gid").alias("probe"), (-1 - F.col("gid")).alias("gid")).join(homes, "gid")
    found = planted.join(met, "probe", "left").groupBy("probe").agg(F.max(F.coalesce(F.col("home") == F.col("reached"), F.lit(False))).alias("ok"))
    return found.agg(F.avg(F.col("ok").cast("int"))).first()[0]


def exact_links(nodes: DataFrame) -> DataFrame:
    """``a, b`` (gids): all pairs of each label compared in blocks; a spanning forest of each block's links."""
    sizes = nodes.groupBy("grp").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / F.least(F.lit(LABEL_PART), F.ceil(4 * F.sqrt("n") + 16))).cast("int")
    dealt = nodes.join(sizes, "grp").select("grp", "gid", "raw", parts.alias("parts")).withColumn("own", F.pmod(F.xxhash64("gid"), F.col("parts")).cast("int"))
    dealt = dealt.select("grp", "gid", "raw", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    blocks = dealt.groupBy("grp", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")).agg(F.collect_list(F.struct("gid", "raw")).alias("items"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [(0, 0)][:0]
            for items in batch.column(0):
                ids, x = items.values.field("gid").to_pylist(), _unit(items.values.field("raw"))
                hit = x @ x.T >= THRESHOLD
                np.fill_diagonal(hit, False)
                out += [(ids[i], ids[j]) for i, j in _forest(hit)[1]]
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return blocks.where(F.size("items") > 1).select("items").mapInArrow(run, "a long, b long")


def count_links(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """``node, n``: vectors over the threshold within the node's component, copies counted.

    A saturated list is enlarged to its whole component: all products inside a component are computed in blocks of
    parts, and every block returns one count for each of its vectors, not the pairs."""
    rows = nodes.join(comp, "node")
    sizes = rows.groupBy("component").agg(F.count("*").alias("m"))
    parts = F.ceil(F.col("m") / F.ceil(4 * F.sqrt("m") + 16)).cast("int")
    rows = rows.join(sizes, "component").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.select("component", "node", "mult", "raw", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    blocks = rows.groupBy("component", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")).agg(F.collect_list(F.struct("node", "mult", "own", "raw")).alias("items"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out, n = [], []
            for same, items in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = items.values
                x, own = _unit(v.field("raw")), np.array(v.field("own"))
                hit = x @ x.T >= THRESHOLD
                np.fill_diagonal(hit, False)
                if not same:
                    hit &= own[:, None] != own[None, :]
                out += v.field("node").to_pylist()
                n += (hit @ np.array(v.field("mult"), dtype=np.int64)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(n, pa.int64())], names=["node", "n"])

    return blocks.select((F.col("p") == F.col("q")).alias("same"), "items").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def audit(nodes: DataFrame, comp: DataFrame) -> float | None:
    """Mean recall of the links of each node with vec_id % AUDIT_EVERY = 0 against brute force over all nodes of its
    label; None if none of them has a link."""
    asked = checkpoint(nodes.join(comp, "node", "left").select("node", "grp", "raw", F.coalesce("component", "node").alias("component")))
    queries = asked.where(F.pmod("node", F.lit(AUDIT_EVERY)) == 0)
    slices = -(-queries.count() // AUDIT_SLICE)
    total, linked = 0.0, 0
    for i in range(slices):
        rows = queries.where(F.pmod(F.xxhash64("node"), F.lit(slices)) == i).collect()  # about AUDIT_SLICE rows
        held = nodes.sparkSession.sparkContext.broadcast([(q.node, q.grp, list(q.raw), q.component) for q in rows])
        got = asked.mapInArrow(_asked_links(held), "node long, true long, found long").groupBy("node").agg(F.sum("true").alias("t"), F.sum("found").alias("f"))
        got = got.agg(F.sum(F.col("f") / F.col("t")).alias("r"), F.count("*").alias("n")).first()
        total, linked = total + (got.r or 0.0), linked + got.n
        held.destroy()
    return total / linked if linked else None


def _asked_links(held):
    def run(batches):
        import pyarrow as pa

        by = {}
        for node, grp, raw, c in held.value:
            by.setdefault(grp, []).append((node, raw, c))
        for b in batches:
            groups = np.array(b.column(1).to_pylist(), dtype=object)
            for grp, asked in by.items():
                rows = np.flatnonzero(groups == grp)
                if not len(rows):
                    continue
                x = _unit(b.column(2).take(pa.array(rows)))
                ids, comps = np.array(b.column(0))[rows], np.array(b.column(3))[rows]
                for at in range(0, len(asked), 500):
                    q, raws, c = zip(*asked[at : at + 500])
                    hit = (x @ _unit(raws).T >= THRESHOLD) & (ids[:, None] != np.array(q)[None, :])
                    true, found = hit.sum(axis=0), (hit & (comps[:, None] == np.array(c)[None, :])).sum(axis=0)
                    some = true > 0
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(q)[some]), pa.array(true[some]), pa.array(found[some])], names=["node", "true", "found"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row ``vec_id, n_links, component_id, kept``.

    Links are pairs of vec_ids of one (non-null) label and length with cosine >= 0.98 in double precision. Null vectors,
    zero vectors and those with null or non-finite components link with nothing and are their own component. Rows with a
    null vec_id have 0 links, no component and are not kept; repeated rows of a vec_id count once and give the same result
    (of differing vectors of one id the greatest counts); an empty table gives none.

    Leaves, centres and component blocks are of bounded size, so hot labels and groups of copies spread over many tasks;
    copies are folded before the first comparison. If too few probes or audited links are found, more trees and rounds
    follow, and after MAX_EXTRA_ROUNDS of them the comparison of all pairs of each label. An audit none of whose
    vectors has a link finds nothing missing.
    """
    rows = checkpoint(usable(vectors, id_col, vector_col, label_col))
    nodes = checkpoint(checkpoint(distinct_vectors(rows)).withColumn("gid", F.monotonically_increasing_id()))
    vecs = checkpoint(search_vectors(nodes))
    means = checkpoint(label_means(vecs))
    lists, links = None, nodes.sparkSession.createDataFrame([], "a long, b long, cos double")
    for extra in range(1 + MAX_EXTRA_ROUNDS):
        lists, links = descend(checkpoint(compare(tree_blocks(vecs, means, seed=11 + extra))), links, lists, vecs, seed=extra)
        comp = named_components(decided(links, nodes), nodes)
        probes, recall = probe_recall(vecs, links, nodes, comp), audit(nodes, comp)
        if whole := (probes is None or probes >= WANTED_PROBES) and (recall is None or recall >= WANTED_RECALL):
            break
    if not whole:
        comp = named_components(exact_links(nodes), nodes)
    counts = count_links(nodes, comp)
    graph = nodes.join(comp, "node", "left").join(counts, "node", "left")
    graph = graph.select("grp", "raw", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    known = rows.join(graph, ["grp", "raw"]).select("vec_id", "n_links", "component_id")
    ids = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    out = ids.join(known, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
