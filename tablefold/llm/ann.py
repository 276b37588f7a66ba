"""Embedding near-duplicates on a robust-pruned flat graph.

Only vectors of equal label are compared. Equal vectors are one node with a count.

1. Centres are fitted by spherical k-means on at most ``SAMPLE`` vectors; every vector joins the
   shards of its ``overlap`` nearest centres. A shard of more than ``SHARD_MOST`` vectors is split
   by a hash, and its queries visit every part, so no task holds an unbounded shard.
2. In each shard, candidates of a vector (nearest ones and a few random ones) are pruned robustly: a
   candidate is dropped if a kept one is nearer to it, by factor ``ALPHA``, than the vector itself.
   Vectors that the medoid does not reach get an edge from the nearest one it does.
3. Adjacency lists of a vector from its shards are united.
4. Every vector searches its own shard from the medoid, greedily with a beam, and then expands all
   that it found in range (and a margin below) until nothing new is in range.
5. Found pairs are verified by cosine in double precision. An audit compares a sample with all
   vectors of its group by brute force.
6. After them a group is counted exactly, in pairs of blocks, if the audit finds less than ``RECALL`` of its links, or if a
   vector has ``SHARD`` links or more, as shards may have cut a dense place; a group of which nothing was
   sampled goes by the recall over all groups.
   Centres and radii of two blocks show whether no pair or every pair links; other pairs of blocks are
   multiplied out. So a group counted exactly costs up to all pairs of its vectors.

Links inside a shard are counted and united in its task, so a dense group costs a row for each
vector, not for each pair; only links that cross shards are rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefold.llm import common as C

COSINE = 0.93
SAMPLE = 20_000               # vectors that centres are fitted on
SHARD = 600                   # vectors a centre aims at
CENTRES = 4096                # at most, over all labels: what is broadcast
SHARD_MOST = 4000
OVERLAP = 3
CANDIDATES, DEGREE, ALPHA = 48, 24, 1.2
BEAM, MARGIN = 32, 0.08
AUDIT, RECALL = 500, 0.95
SLACK = 1e-6                  # of an angle, for rounding
NODE = "rep long, n long, grp string, vec array<double>"


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def matrix(col) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in col])


# ---------------------------------------------------------------------------
# one shard in numpy
# ---------------------------------------------------------------------------
def build(v: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Out-neighbours of each of the unit vectors ``v``."""
    n = len(v)
    if n == 1:
        return [np.zeros(0, np.int64)]
    k = min(CANDIDATES, n - 1)
    out: list[np.ndarray] = []
    for lo in range(0, n, 512):
        hi = min(n, lo + 512)
        sim = v[lo:hi] @ v.T
        sim[np.arange(hi - lo), np.arange(lo, hi)] = -2
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (hi - lo, 1))
        cand = np.concatenate([near, rng.integers(0, n, (hi - lo, 4))], axis=1)
        s = np.take_along_axis(sim, cand, 1)
        alive = s > -2
        kept = np.full((hi - lo, DEGREE), -1, np.int64)
        for d in range(DEGREE):
            best = np.argmax(np.where(alive, s, -3), axis=1)
            ok = alive[np.arange(hi - lo), best]
            if not ok.any():
                break
            node = cand[np.arange(hi - lo), best]
            kept[ok, d] = node[ok]
            between = np.einsum("qd,qcd->qc", v[node], v[cand])
            alive &= ~(ALPHA * (1 - between) <= (1 - s))
            alive[np.arange(hi - lo), best] = False
        out += [np.unique(row[row >= 0]) for row in kept]
    return out


def as_table(adj: list[np.ndarray], n: int) -> np.ndarray:
    width = max([1, *map(len, adj)])
    table = np.full((n, width), -1, np.int64)
    for i, a in enumerate(adj):
        table[i, :len(a)] = a
    return table


def connect(v: np.ndarray, adj: list[np.ndarray], start: int) -> np.ndarray:
    """Adjacency table in which every vector can be reached from ``start``."""
    n = len(v)
    table = as_table(adj, n)
    seen = np.zeros(n, bool)
    front = np.array([start])
    while True:
        seen[front] = True
        while len(front):
            nxt = np.unique(table[front])
            nxt = nxt[nxt >= 0]
            front = nxt[~seen[nxt]]
            seen[front] = True
        if seen.all():
            return table
        lost, inside = np.flatnonzero(~seen)[:256], np.flatnonzero(seen)
        near = inside[np.argmax(v[lost] @ v[inside].T, axis=1)]
        for a, b in zip(near.tolist(), lost.tolist()):
            adj[a] = np.append(adj[a], b)
        table = as_table(adj, n)
        front = lost


def search(v: np.ndarray, table: np.ndarray, start: int, queries: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, index) of at least ``cosine`` that range-expanding greedy search finds."""
    n, q = len(v), len(queries)
    sim = np.full((q, n), -2.0)

    def look(who: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nxt = table[node]
        w = np.repeat(who, nxt.shape[1])
        x = nxt.ravel()
        ok = x >= 0
        flat = np.unique(w[ok] * n + x[ok])
        w, x = flat // n, flat % n
        new = sim[w, x] < -1.5
        w, x = w[new], x[new]
        sim[w, x] = np.einsum("ij,ij->i", queries[w], v[x])
        return w, x

    sim[:, start] = queries @ v[start]
    done = np.zeros((q, n), bool)
    active = np.arange(q)
    beam = min(BEAM, n)
    while len(active):                              # greedy: expand the best of the beam that isn't yet
        s = sim[active]
        floor = np.partition(s, n - beam, axis=1)[:, n - beam]
        s = np.where(done[active], -3, s)
        best = np.argmax(s, axis=1)
        top = s[np.arange(len(active)), best]
        go = (top > -1.5) & (top >= floor)
        active, best = active[go], best[go]
        done[active, best] = True
        if len(active):
            look(active, best)
    while True:                                     # range: expand all in range, or nearly, that isn't yet
        w, x = np.nonzero((sim >= cosine - MARGIN) & ~done)
        if not len(w):
            break
        done[w, x] = True
        for lo in range(0, len(w), 20_000):
            look(w[lo:lo + 20_000], x[lo:lo + 20_000])
    return np.nonzero(sim >= cosine)


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index for links a-b among n."""
    comp = np.arange(n)
    while True:
        before = comp.copy()
        np.minimum.at(comp, a, before[b])
        np.minimum.at(comp, b, before[a])
        comp = comp[comp]
        if (comp == before).all():
            return comp


# ---------------------------------------------------------------------------
# the operator
# ---------------------------------------------------------------------------
def sampled(nodes: DataFrame, seed: int, most: int) -> pd.DataFrame:
    """At most ``most`` nodes in the order of a hash; only ids are ordered, and so many broadcast."""
    ids = nodes.select("rep").orderBy(F.xxhash64("rep", F.lit(seed)), "rep").limit(most)
    return nodes.join(F.broadcast(ids), "rep").select("rep", "grp", "vec").toPandas()


def fit_centres(nodes: DataFrame) -> dict[str, np.ndarray]:
    """Unit centres for each group, from a bounded sample in the order of a hash."""
    sample = sampled(nodes, 0, SAMPLE).sort_values("rep", kind="stable")
    sizes = {r["grp"]: r["count"] for r in nodes.groupBy("grp").count().where(F.col("grp").isin(sample["grp"].unique().tolist())).collect()} \
        if len(sample) else {}
    out, total = {}, max(1, sum(sizes.values()))
    for grp, part in sample.groupby("grp"):
        v = unit(matrix(part["vec"]))
        k = int(min(-(-sizes[grp] // SHARD), max(1, CENTRES * sizes[grp] // total), len(v)))
        c = v[:k]
        for _ in range(6 if k > 1 else 0):
            own = np.argmax(v @ c.T, axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, own, v)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
        out[str(grp)] = c
    return out


def shards(nodes: DataFrame, centres: dict[str, np.ndarray], overlap: int) -> DataFrame:
    """Node rows with (shard, own): one row for each shard a vector joins; ``own`` marks the nearest centre's."""
    def assign(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            parts = []
            for grp, part in pdf.groupby("grp"):
                c = centres.get(grp)                          # a group that the sample missed is one shard
                if c is None:
                    parts.append(part.assign(shard=0, own=True))
                    continue
                k = min(overlap, len(c))
                sim = unit(matrix(part["vec"])) @ c.T
                near = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                for j in range(k):
                    parts.append(part.assign(shard=near[:, j], own=j == 0))
            if parts:
                out = pd.concat(parts)[["rep", "n", "grp", "vec", "shard", "own"]].astype({"shard": "int32", "own": "bool"})
                yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return nodes.mapInArrow(assign, NODE + ", shard int, own boolean")


def search_links(nodes: DataFrame, centres: dict, overlap: int, cosine: float) -> DataFrame:
    """(a, b, na, nb, found): rows with b = a hold the count of links inside a's shard; rows found=0
    with b <> a tie a to its part's smallest member; other rows are links across shards, a < b."""
    rows = C.written(shards(nodes, centres, overlap), "ann-shards")
    sizes = rows.groupBy("grp", "shard").count()
    rows = rows.join(sizes, ["grp", "shard"]).withColumn("parts", F.ceil(F.col("count") / SHARD_MOST).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    names = ["grp", "shard", "part"]

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep").drop_duplicates("rep")
        rep = pdf["rep"].to_numpy()
        adj = build(unit(matrix(pdf["vec"])), np.random.default_rng(int(rep[0]) & 0xFFFF))
        return pd.DataFrame({"rep": rep, "out": [rep[a] for a in adj]})

    edges = rows.groupBy(*names).applyInPandas(graph, "rep long, out array<long>")
    edges = edges.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("out"))).alias("out"))      # at most overlap * DEGREE
    rows = rows.join(edges, "rep")
    visits = rows.withColumn("at", F.explode(F.when(F.col("own") & (F.col("parts") > 1), F.sequence(F.lit(0), F.col("parts") - 1))
                                             .otherwise(F.array("part"))))
    visits = visits.withColumn("index", F.col("at") == F.col("part")).drop("part").withColumnRenamed("at", "part")

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep").reset_index(drop=True)
        index, asks = pdf[pdf["index"]].reset_index(drop=True), pdf[pdf["own"]].reset_index(drop=True)
        if not len(index) or not len(asks):
            return pd.DataFrame({"a": [], "b": [], "na": [], "nb": [], "found": []}, dtype="int64")
        rep, n = index["rep"].to_numpy(), index["n"].to_numpy()
        v = unit(matrix(index["vec"]))
        place = {r: i for i, r in enumerate(rep.tolist())}
        adj = [np.array([place[x] for x in out if x in place], np.int64) for out in index["out"]]
        start = int(np.argmax(v @ v.mean(axis=0)))
        table = connect(v, adj, start)
        q = unit(matrix(asks["vec"]))
        found = [search(v, table, start, q[lo:lo + 512], cosine) for lo in range(0, len(q), 512)]
        w = np.concatenate([f[0] + 512 * i for i, f in enumerate(found)])
        x = np.concatenate([f[1] for f in found])
        qr, qn = asks["rep"].to_numpy()[w], asks["n"].to_numpy()[w]
        other = qr != rep[x]
        w, x, qr, qn = w[other], x[other], qr[other], qn[other]
        at = np.array([place.get(r, -1) for r in qr.tolist()], np.int64)
        own = index["own"].to_numpy()
        here = (at >= 0) & own[x]
        i, j = at[here], x[here]
        flat = np.unique(np.concatenate([i * len(rep) + j, j * len(rep) + i]))          # both ways, once
        i, j = flat // len(rep), flat % len(rep)
        count = np.bincount(i, n[j], len(rep)).astype(np.int64)
        comp = united(len(rep), i, j)
        mine = np.flatnonzero(count)
        tie = np.flatnonzero(comp != np.arange(len(rep)))
        away = ~here
        lo, hi = np.minimum(qr, rep[x])[away], np.maximum(qr, rep[x])[away]
        nlo = np.where(qr <= rep[x], qn, n[x])[away]
        nhi = np.where(qr <= rep[x], n[x], qn)[away]
        return pd.DataFrame({"a": np.concatenate([rep[mine], rep[tie], lo]), "b": np.concatenate([rep[mine], rep[comp[tie]], hi]),
                             "na": np.concatenate([0 * mine, 0 * tie, nlo]), "nb": np.concatenate([count[mine], 0 * tie, nhi]),
                             "found": np.concatenate([0 * mine, 0 * tie, 0 * nlo + 1])})

    return visits.groupBy(*names).applyInPandas(find, "a long, b long, na long, nb long, found long")


def exact_links(nodes: DataFrame, centres: dict[str, np.ndarray], cosine: float) -> DataFrame:
    """As ``search_links``, but all links: (a, b, links), rows with b = a hold a part of a's links, others tie a to b."""
    coarse = {grp: c[:max(1, len(c) * SHARD // SHARD_MOST)] for grp, c in centres.items()}          # fewer and larger blocks than shards
    homes = C.written(shards(nodes, coarse, 1).select("rep", "n", "grp", "vec", "shard"), "ann-homes")
    sizes = homes.groupBy("grp", "shard").count()
    homes = homes.join(sizes, ["grp", "shard"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("count") / SHARD_MOST)).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        v = unit(matrix(pdf["vec"]))
        mean = v.mean(axis=0)
        mean = mean / np.linalg.norm(mean) if np.linalg.norm(mean) > 1e-9 else v[0]
        rep, n = pdf["rep"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        radius = float(np.arccos(np.clip((v @ mean).min(), -1, 1)))
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "block": [int(rep[0])], "centre": [mean.tolist()], "radius": [radius], "total": [int(n.sum())],
                             "reps": [rep.tobytes()], "ns": [n.tobytes()], "vecs": [v.tobytes()]})

    # a block is named by its smallest member
    blocks = C.written(homes.groupBy("grp", "shard", "part").applyInPandas(
        pack, "grp string, block long, centre array<double>, radius double, total long, reps binary, ns binary, vecs binary"), "ann-blocks")
    bounds = blocks.select("grp", "block", "centre", "radius", "total")
    side = lambda df, x: df.select("grp", *[F.col(c).alias(c + x) for c in df.columns if c != "grp"])
    pairs = side(bounds, "1").join(side(bounds, "2"), "grp").where("block1 <= block2")
    dot = F.aggregate(F.zip_with("centre1", "centre2", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    between = F.when(F.col("block1") == F.col("block2"), 0.0).otherwise(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot))))
    reach, most = F.col("radius1") + F.col("radius2"), float(np.arccos(cosine))
    pairs = pairs.withColumn("between", between).where(F.col("between") - reach <= most + SLACK)
    pairs = C.written(pairs.select("block1", "block2", "total1", "total2", (F.col("between") + reach <= most - SLACK).alias("sure")), "ann-pairs")

    # every pair of the two blocks links: members have the other block's total, and one component
    sure = pairs.where("sure")
    sure = sure.select(F.col("block1").alias("block"), F.col("block2").alias("other"), F.col("total2").alias("links")).union(
        sure.where("block1 <> block2").select("block2", "block1", "total1"))
    sure = sure.groupBy("block").agg(F.sum("links").alias("links"), F.max(F.col("block") == F.col("other")).alias("own"), F.min("other").alias("other"))

    def members(batches):
        for batch in batches:
            for links, own, other, reps, ns in zip(*[batch.column(c).to_pylist() for c in ("links", "own", "other", "reps", "ns")]):
                rep, n = np.frombuffer(reps, np.int64), np.frombuffer(ns, np.int64)
                yield rows(rep, links - (n if own else 0 * n), np.full(len(rep), other))

    def rows(rep: np.ndarray, links: np.ndarray, tie: np.ndarray):
        some, tied = links > 0, tie != rep
        columns = np.concatenate([rep[some], rep[tied]]), np.concatenate([rep[some], tie[tied]]), np.concatenate([links[some], 0 * rep[tied]])
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["a", "b", "links"])

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, na, nb = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("reps1", "reps2", "ns1", "ns2"))
                va, vb = (np.frombuffer(batch.column(c)[i].as_py(), np.float64).reshape(len(r), -1) for c, r in (("vecs1", a), ("vecs2", b)))
                same = a[0] == b[0]
                ca, cb, comp = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), np.arange(len(a) + len(b))
                for lo in range(0, len(a), 512):
                    hit = va[lo:lo + 512] @ vb.T >= cosine
                    if same:
                        hit[np.arange(len(hit)), np.arange(lo, lo + len(hit))] = False
                    ca[lo:lo + 512] += hit @ nb
                    cb += na[lo:lo + 512] @ hit
                    x, y = np.nonzero(hit)
                    if len(x):                                      # what is tied so far, and the new links
                        ties = np.flatnonzero(comp != np.arange(len(comp)))
                        comp = united(len(comp), np.concatenate([ties, x + lo]), np.concatenate([comp[ties], y + (0 if same else len(a))]))
                both = np.concatenate([a, b])
                yield rows(a, ca, both[comp[:len(a)]])
                if not same:
                    yield rows(b, cb, both[comp[len(a):]])

    data = blocks.select("block", "reps", "ns", "vecs")
    unsure = pairs.where("NOT sure").select("block1", "block2")
    unsure = unsure.join(data.select(*[F.col(c).alias(c + "1") for c in data.columns]), "block1").join(data.select(*[F.col(c).alias(c + "2") for c in data.columns]), "block2")
    schema = "a long, b long, links long"
    own = blocks.select("block", "reps", "ns").join(sure, "block").mapInArrow(members, schema)
    across = pairs.where("sure AND block1 <> block2").select(F.col("block1").alias("a"), F.col("block2").alias("b"), F.lit(0).cast("long").alias("links"))
    return own.union(unsure.mapInArrow(compare, schema)).union(across)


def unsettled(nodes: DataFrame, counts: DataFrame, cosine: float, most: int = AUDIT) -> list[str]:
    """Groups of ``nodes`` that must be counted exactly; ``counts`` are the links that the graph search found.

    A bounded sample of nodes is compared with all nodes of its group, in blocks.
    """
    sample = sampled(nodes, 1, most)
    asks = {g: (p["rep"].to_numpy(), unit(matrix(p["vec"]))) for g, p in sample.groupby("grp")}

    def brute(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            for grp, part in pdf.groupby("grp"):
                if grp not in asks:
                    continue
                rep, q = asks[grp]
                hit = (q @ unit(matrix(part["vec"])).T >= cosine) & (rep[:, None] != part["rep"].to_numpy()[None, :])
                yield pa.RecordBatch.from_arrays([pa.array([grp]), pa.array([int((hit * part["n"].to_numpy()).sum())])], ["grp", "n"])

    true = {r["grp"]: r["n"] for r in nodes.mapInArrow(brute, "grp string, n long").groupBy("grp").agg(F.sum("n").alias("n")).collect()}
    ids = [int(x) for x in sample["rep"]]
    named = nodes.select("rep", "grp").join(counts, "rep", "left")
    got = named.groupBy("grp").agg(F.sum(F.when(F.col("rep").isin(ids), F.col("links"))).alias("found"), F.max("links").alias("top")).collect()
    poor = sum(r["found"] or 0 for r in got if r["grp"] in asks) < RECALL * sum(true.values())
    return [r["grp"] for r in got if (r["top"] or 0) >= SHARD or (r["found"] or 0) < RECALL * true.get(r["grp"], 0) or (poor and r["grp"] not in asks)]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, overlap: int = OVERLAP) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label, ...).

    A vector that is null, all zero, or holds a null or non-finite component, one whose label is null
    and one without a vec_id link with nothing; vectors of different length don't either.
    ``component_id`` is the smallest vec_id reachable (null for a null vec_id); ``kept`` marks it.
    Rows that repeat a vec_id are counted as different vectors. Other columns are ignored; an empty
    table gives an empty result.
    """
    C.prepared(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(good & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    valid = rows.where("ok").select("vec_id", "vec", F.concat_ws("/", F.col("label").cast("string"), F.size("vec")).alias("grp"))
    nodes = C.written(valid.groupBy("grp", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).select("rep", "n", "grp", "vec"), "ann-nodes")
    centres = fit_centres(nodes)
    raw = C.written(search_links(nodes, centres, overlap, cosine), "ann-links")
    across = raw.where("found = 1").select("a", "b", "na", "nb").distinct()
    each = raw.where("a = b").select(F.col("a").alias("rep"), F.col("nb").alias("links"))
    each = each.union(across.select("a", "nb")).union(across.select("b", "na")).groupBy("rep").agg(F.sum("links").alias("links"))
    each = C.written(each, "ann-counts")
    poor = unsettled(nodes, each, cosine)
    raw = raw.select("a", "b")
    if poor:
        again = F.col("grp").isin(poor)
        sure = C.written(exact_links(nodes.where(again), centres, cosine), "ann-exact")
        each = each.join(nodes.where(~again).select("rep"), "rep", "left_semi").union(sure.where("a = b").groupBy("a").agg(F.sum("links")))
        raw = raw.union(sure.select("a", "b"))                          # a link that the search found stays true
    comp = C.components(raw.where("a <> b").select("a", "b"), "ann-components")
    named = nodes.join(each, "rep", "left").join(comp, nodes["rep"] == comp["node"], "left")
    named = named.select("grp", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = valid.join(named, ["grp", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
