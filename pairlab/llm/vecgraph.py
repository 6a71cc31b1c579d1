"""Embedding near-duplicates on a robust-pruned flat graph.

Equal vectors are one class with its smallest id and its size; classes are unit vectors in
double precision.

1. Shards: centroids are fitted on a bounded sample; every class goes to the ``OVERLAP`` nearest
   ones.  A cluster is dealt by a hash into blocks of about ``BLOCK_ROWS``, so that a cluster
   with a third of all rows is never in one task.
2. Graph: in every block each class gets its ``CANDIDATES`` nearest others, robustly pruned to
   ``DEGREE`` (a candidate goes when one kept is ``ALPHA`` times nearer to it than the class is).
3. The adjacency lists that a class got in its shards are united.
4. Search: the classes of a cluster, in blocks, are the queries of each of its blocks: a greedy
   search from the block's medoids with a beam, then the range is expanded: neighbours of all
   that are alike enough, until no more are found.  Every link is verified by its cosine, and
   counted in the lowest cluster that both ends share.  A task returns counts, and stars of the
   components it has seen, never pairs.
5. Audit: for at most ``AUDIT`` vectors (by a hash of their ids) the links are counted exactly
   against all rows; while the found ones are under ``recall`` of them, overlap and beam are
   doubled and the search is repeated, three times at most, then it raises an error.
6. Components by alternating large-star and small-star.

The work of step 4 grows with the square of the number of blocks of one cluster, as links
have to be counted for every vector; it is spread over as many tasks.

Edge cases: null, zero and non-finite vectors, and vectors of another length than most, link
with nothing; rows with a null id come out with a null component, kept, without links; an id on
several rows is one vector, the greatest of them by its text form; an empty table gives an empty
one; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm.components import connected_components
from pairlab.session import scratch_path

SAMPLE, SAMPLE_BYTES = 16_384, 16 << 20
MAX_CENTROIDS, SHARD_ROWS = 2048, 800
OVERLAP, BLOCK_ROWS = 3, 2500
CANDIDATES, DEGREE, ALPHA = 48, 24, 1.2
BEAM, MEDOIDS = 32, 24
AUDIT, RECALL = 512, 0.9


def units(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit vectors of a column of lists, and which rows have one (a finite direction and
    ``dim`` components)."""
    n = len(col)
    length = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(col.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    x, ok = np.zeros((n, dim)), length == dim
    x[ok] = flat[begin[ok][:, None] + np.arange(dim)] if dim else 0
    ok &= np.isfinite(x).all(axis=1) & x.any(axis=1)
    x[~ok] = 1.0
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)), ok


def matrix(col) -> np.ndarray:
    """The vectors of a column of packed doubles."""
    cells = list(col)
    return np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), -1)


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means, seeded with evenly spread rows of the sample."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = (sample @ c.T).argmax(axis=1)
        for j in range(k):
            s = sample[at == j].sum(axis=0)
            if s.any():
                c[j] = s / np.sqrt(s @ s)
    return c


def robust_prune(x: np.ndarray) -> list[np.ndarray]:
    """The adjacency of a block of unit vectors: nearest candidates, robustly pruned."""
    n, out = len(x), []
    k = min(CANDIDATES, n - 1)
    if k < 1:
        return [np.empty(0, np.int64) for _ in range(n)]
    for lo in range(0, n, 256):
        s = x[lo:lo + 256] @ x.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -2
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        d = 1 - np.take_along_axis(s, near, axis=1)
        order = np.argsort(d, axis=1, kind="stable")
        near, d = np.take_along_axis(near, order, axis=1), np.take_along_axis(d, order, axis=1)
        v = x[near]
        between = 1 - np.matmul(v, v.transpose(0, 2, 1))
        open_, kept = np.ones(near.shape, bool), np.zeros(near.shape, bool)
        rows = np.arange(len(near))
        for _ in range(min(DEGREE, k)):
            first = open_.argmax(axis=1)
            some = open_[rows, first]
            kept[rows[some], first[some]] = True
            open_ &= ~((ALPHA * between[rows, first] <= d) & some[:, None])
            open_[rows[some], first[some]] = False
            if not open_.any():
                break
        out += [near[i][kept[i]] for i in range(len(near))]
    return out


class Searcher:
    """Range-expanding greedy search in one block."""

    def __init__(self, x: np.ndarray, adjacency: list[np.ndarray], beam: int):
        self.x, self.beam = x, beam
        both: list[set] = [set(a.tolist()) for a in adjacency]
        for i, a in enumerate(adjacency):
            for j in a.tolist():
                both[j].add(i)
        self.next = [np.fromiter(sorted(b), np.int64, len(b)) for b in both]
        mean = x.mean(axis=0)
        self.medoids = np.unique(np.concatenate(
            [[int((x @ mean).argmax())], np.linspace(0, len(x) - 1, min(MEDOIDS, len(x))).astype(int)]))

    def within(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the vectors found with a cosine of at least ``least``."""
        x, sim = self.x, {}
        s = x[self.medoids] @ q
        for i, v in zip(self.medoids.tolist(), s.tolist()):
            sim[i] = v
        todo = [(-v, i) for i, v in sim.items()]
        heapq.heapify(todo)
        best = sorted(sim.values())[-self.beam:]
        heapq.heapify(best)
        seen = np.zeros(len(x), bool)
        seen[self.medoids] = True
        while todo:
            v, i = heapq.heappop(todo)
            if len(best) >= self.beam and -v < best[0]:
                break
            new = self.next[i][~seen[self.next[i]]]
            if not len(new):
                continue
            seen[new] = True
            for j, u in zip(new.tolist(), (x[new] @ q).tolist()):
                sim[j] = u
                if len(best) < self.beam:
                    heapq.heappush(best, u)
                elif u > best[0]:
                    heapq.heapreplace(best, u)
                else:
                    continue
                heapq.heappush(todo, (-u, j))
        found = np.fromiter((i for i, v in sim.items() if v >= least), np.int64)
        front = found
        while len(front):
            new = np.unique(np.concatenate([self.next[i] for i in front.tolist()]))
            new = new[~seen[new]]
            seen[new] = True
            front = new[x[new] @ q >= least] if len(new) else new
            found = np.concatenate([found, front])
        # the graph has named the candidates; their cosines are taken anew
        cos = x[found] @ q if len(found) else np.empty(0)
        ok = cos >= least
        return found[ok], cos[ok]


def _classes(vectors: DataFrame, id_col: str, vec_col: str, path: str) -> tuple[DataFrame, DataFrame, int]:
    """(id, v) of every id, (rep, size, v) of every class of equal vectors, and their length."""
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("e"))
    sizes = src.where("id is not null and size(e) > 0").groupBy(F.size("e").alias("d")).count()
    most = sizes.orderBy(F.desc("count"), "d").first()
    dim = most["d"] if most else 1

    def run(batches):
        for b in batches:
            x, ok = units(b.column(1), dim)
            cells = [x[i].tobytes() if ok[i] else None for i in range(len(x))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells, pa.binary())], ["id", "v"])

    src.mapInArrow(run, "id long, v binary").write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    own = rows.where("id is not null").groupBy("id").agg(F.max("v").alias("v"))
    (own.where("v is not null").groupBy(F.sha2("v", 256).alias("digest"))
     .agg(F.min("id").alias("rep"), F.count("id").alias("size"), F.first("v").alias("v"))
     .write.parquet(f"{path}/classes"))
    return rows, own, dim


def _assign(classes: DataFrame, dim: int, overlap: int) -> DataFrame:
    """(rep, size, v, clusters): the nearest clusters of every class, nearest first."""
    n = classes.count()
    rows = min(SAMPLE, SAMPLE_BYTES // (8 * dim))
    sample = (classes.orderBy(F.md5(F.col("rep").cast("string").cast("binary")), "rep").limit(rows)
              .select("v").toArrow())
    k = int(min(MAX_CENTROIDS, max(1, n // SHARD_ROWS), max(1, sample.num_rows)))
    c = centroids(matrix(sample["v"].to_pylist()), k) if sample.num_rows else np.ones((1, dim))
    m = min(overlap, k)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            s = matrix(b.column(2).to_pylist()) @ c.T
            near = np.argsort(-s, axis=1, kind="stable")[:, :m].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(near), pa.list_(pa.int32()))],
                                             ["rep", "size", "v", "clusters"])

    return classes.select("rep", "size", "v").mapInArrow(run, "rep long, size long, v binary, clusters array<int>")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    reps = pdf["rep"].to_numpy()
    return pd.DataFrame({"rep": reps, "next": [reps[a].tolist() for a in robust_prune(matrix(pdf["v"]))]})


class _Sets:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _searcher(least: float, beam: int):
    """For a block of nodes and a block of queries of one cluster: (a, n, b) rows with the links n
    of query a counted here, and a's component b as far as it is seen here."""

    def run(key, nodes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes) or not len(queries):
            return pd.DataFrame({"a": [], "n": [], "b": []})
        cluster, reps, size = key[0], nodes["rep"].to_numpy(), nodes["size"].to_numpy()
        place = {r: i for i, r in enumerate(reps.tolist())}
        adjacency = [np.array([place[j] for j in a if j in place], np.int64) for a in nodes["next"]]
        search = Searcher(matrix(nodes["v"]), adjacency, beam)
        homes = np.stack(nodes["clusters"].to_list())
        sets, counts = _Sets(set(reps.tolist()) | set(queries["rep"].tolist())), []
        for rep, q, own in zip(queries["rep"].tolist(), matrix(queries["v"]), queries["clusters"]):
            found, _ = search.within(q, least)
            found = found[reps[found] != rep]
            # a pair is counted in the lowest of the clusters that both ends are in
            both = (homes[found][:, :, None] == np.asarray(own)[None, None, :]).any(axis=1)
            shared = np.where(both, np.asarray(own)[None, :], np.iinfo(np.int32).max).min(axis=1)
            counts.append(int(size[found[shared == cluster]].sum()))
            for r in reps[found].tolist():
                sets.join(rep, r)
        a = queries["rep"].tolist()
        rest = [r for r in reps.tolist() if r not in set(a) and sets.root(r) != r]
        return pd.DataFrame({"a": a + rest, "n": counts + [0] * len(rest), "b": [sets.root(r) for r in a + rest]})

    return run


def _search(spark: SparkSession, path: str, least: float, beam: int) -> DataFrame:
    """(a, n, b) rows of all blocks of the classes assigned in ``path``."""
    assigned = spark.read.parquet(f"{path}/assigned")
    sizes = {r["c"]: r["count"] for r in
             assigned.select(F.explode("clusters").alias("c")).groupBy("c").count().collect()}
    blocks = {c: max(1, -(-n // BLOCK_ROWS)) for c, n in sizes.items()}
    n_blocks = F.element_at(F.array([F.lit(blocks.get(c, 1)) for c in range(max(blocks, default=0) + 1)]),
                            F.col("cluster") + 1)
    dealt, again = ((spark.read.parquet(f"{path}/assigned").withColumn("cluster", F.explode("clusters"))
                     .withColumn("block", F.pmod(F.crc32(F.col("rep").cast("string").cast("binary")), n_blocks)))
                    for _ in range(2))
    graph = dealt.groupBy("cluster", "block").applyInPandas(_build, "rep long, next array<long>")
    graph = graph.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))
    graph.write.parquet(f"{path}/graph")
    graph = spark.read.parquet(f"{path}/graph")
    each = F.explode(F.sequence(F.lit(0).cast("long"), n_blocks.cast("long") - 1))
    nodes = dealt.join(graph, "rep").withColumn("asked", each)
    queries = again.select("rep", "v", "clusters", "cluster", F.col("block").alias("asked")).withColumn("block", each)
    keys = ["cluster", "block", "asked"]
    return (nodes.groupBy(*keys).cogroup(queries.groupBy(*keys))
            .applyInPandas(_searcher(least, beam), "a long, n long, b long"))


def audited_recall(classes: DataFrame, counts: DataFrame, least: float, audit: int = AUDIT) -> float:
    """Found links by exact links of a bounded number of classes, all rows compared."""
    chosen = (classes.orderBy(F.md5(F.concat(F.lit("audit"), F.col("rep").cast("string")).cast("binary")), "rep")
              .limit(audit).select("rep", "v").toArrow())
    if not chosen.num_rows:
        return 1.0
    reps, q = chosen["rep"].to_numpy(), matrix(chosen["v"].to_pylist())

    def run(batches):
        total = np.zeros(len(reps), np.int64)
        for b in batches:
            if b.num_rows:
                hit = matrix(b.column(2).to_pylist()) @ q.T >= least
                hit &= b.column(0).to_numpy()[:, None] != reps[None, :]
                total += (hit * b.column(1).to_numpy()[:, None]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(total)], ["a", "n"])

    exact = classes.select("rep", "size", "v").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    exact = {r["a"]: r["n"] for r in exact.collect()}
    found = {r["a"]: r["n"] for r in counts.where(F.col("a").isin([int(r) for r in reps])).collect()}
    every = sum(exact.values())
    return sum(min(found.get(a, 0), n) for a, n in exact.items()) / every if every else 1.0


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9,
                    overlap: int = OVERLAP, beam: int = BEAM, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for every vector."""
    spark, path = vectors.sparkSession, scratch_path(vectors.sparkSession, "vecgraph")
    rows, own, dim = _classes(vectors, id_col, vec_col, path)
    classes = spark.read.parquet(f"{path}/classes")
    for attempt in range(4):
        _assign(classes, dim, overlap).write.parquet(f"{path}/{attempt}/assigned")
        _search(spark, f"{path}/{attempt}", least, beam).write.parquet(f"{path}/{attempt}/found")
        found = spark.read.parquet(f"{path}/{attempt}/found")
        counts = found.groupBy("a").agg(F.sum("n").alias("n"))
        if (got := audited_recall(classes, counts, least)) >= recall:
            break
        overlap, beam = overlap * 2, beam * 2
    else:
        raise RuntimeError(f"only {got:.3f} of the audited links were found")
    parts = connected_components(found.where("a <> b").select("a", "b"))
    whole = (classes.select("digest", "rep", "size").join(counts, F.col("rep") == F.col("a"), "left")
             .join(parts, F.col("rep") == F.col("id"), "left")
             .select("digest", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")).checkpoint())
    done = (own.select("id", F.sha2("v", 256).alias("digest")).join(whole, "digest", "left")
            .select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id")))
    done = done.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    return done.union(rows.where("id is null").select(
        "id", F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(True)))
