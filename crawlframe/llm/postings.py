"""Approximate nearest neighbours by inner product over balanced posting lists.

Inner products become distances by one more coordinate that gives all vectors
the same length. Centroids are fitted on a bounded sample by halving it again
and again at the median of its main direction, so that lists are balanced. A
vector is posted to its nearest list and, if it lies near a boundary, to further
ones whose centroids are almost as near and not hidden behind a chosen one.
Vectors and queries find their centroids by best-first search in a neighbour graph that every task
holds. A query visits the lists whose centroids are at most `ratio` times as far as its nearest
one, and further ones while these could hold fewer than k others; the search goes on until it has passed
that distance, without a cap. The ratio is measured: a
bounded sample of queries is answered exactly by one pass over all vectors, and the ratio
is the smallest that finds `RECALL` of their neighbours. A query's nearest lists are
searched first; from the others only vectors that beat its k-th find so far come back.

Equal vectors are one entry with their k + 1 smallest ids, which is all that a
result of k can use. Lists are cut into pages and their queries into parts of
bounded size, so no list is ever whole in a task; all pages are visited. Scores
are inner products in double precision, summed from the first component on; a matrix
product picks the pairs that are summed so.

Defined cases: null, zero, non-finite vectors, null ids and vectors of another
dimension than most take no part; ties go to the smaller id; with fewer
candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlframe.llm.common import query, table
from crawlframe.session import cut_lineage, ship_package

#: Rows the centroids are fitted on at most, and the most centroids.
SAMPLE, CENTROIDS = 20_000, 4_096
#: The number of lists is about this part of the root of the number of distinct vectors.
LISTS = 0.6
#: Most lists of a vector, and how much farther than its nearest one they may be.
REPLICAS, NEAR = 4, 1.12
#: Sampled queries that the ratio is measured on at most, and the part of their neighbours it must reach.
MEASURED, RECALL = 256, 0.95
#: Lists of a query that are searched first.
FIRST = 2
#: Graph: neighbours of a centroid, and the beam of a search.
DEGREE, BEAM = 24, 96
PAGE = 4_096


def fit_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Means of `lists` equal parts (a power of two) of the sample."""
    parts = [np.arange(len(x))]
    rng = np.random.default_rng(7)
    while len(parts) < lists:
        halves = []
        for p in parts:
            y = x[p] - x[p].mean(axis=0)
            d = rng.standard_normal(x.shape[1])
            for _ in range(8):  # power steps to the main direction
                d = y.T @ (y @ d)
                d /= np.linalg.norm(d) or 1.0
            order = np.argsort(y @ d, kind="stable")
            halves += [p[order[:len(p) // 2]], p[order[len(p) // 2:]]]
        parts = halves
    c = np.array([x[p].mean(axis=0) for p in parts if len(p)])
    for _ in range(4):  # a few plain steps round the cells off; a penalty keeps them even
        load = np.zeros(len(c))
        for _ in range(2):
            near = np.argmin(((c * c).sum(1) - 2 * x @ c.T) + load, axis=1)
            share = np.bincount(near, minlength=len(c)) * len(c) / len(x)
            load += 0.05 * np.maximum(share - 1.5, 0)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


class Graph:
    """Neighbour graph of the centroids with best-first search for many points at once."""

    def __init__(self, c: np.ndarray):
        self.c, self.sq = c, (c * c).sum(1)
        k = min(DEGREE, len(c) - 1)
        self.next = np.zeros((len(c), 0), np.int64)
        if k > 0:
            near, far = [], []
            rng = np.random.default_rng(3)
            for i in range(0, len(c), 1024):
                d = self.sq - 2 * c[i:i + 1024] @ c.T
                d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
                near.append(np.argpartition(d, k - 1, axis=1)[:, :k])
                far.append(rng.integers(0, len(c), (len(d), 4)))  # long links join separate regions
            self.next = np.concatenate([np.concatenate(near), np.concatenate(far)], axis=1)
        self.entry = np.unique(np.linspace(0, len(c) - 1, min(len(c), 16)).astype(np.int64))

    def distances(self, x, ids):
        return np.maximum((x * x).sum(1)[:, None] + self.sq[ids] - 2 * np.einsum("bd,bkd->bk", x, self.c[ids]), 0)

    def search(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of about the nearest `want` centroids of each point, nearest first."""
        n, m = len(x), len(self.c)
        beam = min(max(BEAM, want), m)
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, m), bool)
        ids = np.broadcast_to(self.entry, (n, len(self.entry))).copy()
        seen[rows, ids] = True
        dist = self.distances(x, ids)
        done = np.zeros(ids.shape, bool)
        while True:
            wait = np.where(done, np.inf, dist)
            pick = np.argpartition(wait, min(3, wait.shape[1] - 1), axis=1)[:, :4]
            open_ = np.isfinite(np.take_along_axis(wait, pick, 1))
            if not open_.any():
                break
            done[rows, pick] = True
            new = self.next[np.take_along_axis(ids, pick, 1)].reshape(n, -1)
            fresh = ~seen[rows, new] & np.repeat(open_, self.next.shape[1], axis=1)
            # Of a node met twice in one step, only the first counts.
            order = np.argsort(new, axis=1, kind="stable")
            run = np.take_along_axis(new, order, 1)
            again = np.zeros(new.shape, bool)
            np.put_along_axis(again, order[:, 1:], run[:, 1:] == run[:, :-1], 1)
            fresh &= ~again
            seen[np.nonzero(fresh)[0], new[fresh]] = True
            d = np.where(fresh, self.distances(x, new), np.inf)
            ids = np.concatenate([ids, new], axis=1)
            dist = np.concatenate([dist, d], axis=1)
            done = np.concatenate([done, ~fresh], axis=1)
            if ids.shape[1] > beam:
                keep = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                ids, dist, done = (np.take_along_axis(a, keep, 1) for a in (ids, dist, done))
        order = np.lexsort((ids, dist), axis=1)[:, :want]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


    def within(self, x: np.ndarray, ratio: float, least: int, sizes: np.ndarray, enough: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per point, the centroids (ids, distances) at most `ratio` times as far as its nearest.

        There are at least `least` of them, and so many that their lists (`sizes`) hold `enough` postings.
        """
        want, out = max(2 * least, 16), [None] * len(x)
        open_ = np.arange(len(x))
        while len(open_):
            want = min(want, len(self.c))
            ids, dist = self.search(x[open_], want)
            reach = ratio * ratio * dist[:, 0] + 1e-12
            held = np.cumsum(sizes[ids], axis=1)
            done = ((dist[:, -1] > reach) & (held[:, -1] >= enough)) | (want == len(self.c))
            for i in np.flatnonzero(done):
                n = max(least, int((dist[i] <= reach[i]).sum()), int(np.searchsorted(held[i], enough)) + 1)
                out[open_[i]] = (ids[i, :n], dist[i, :n])
            open_, want = open_[~done], 2 * want
        return out

    def postings(self, x: np.ndarray) -> list[list[int]]:
        """The lists of each vector: its nearest, and near ones that no chosen one hides."""
        ids, dist = self.search(x, min(4 * REPLICAS, len(self.c)))
        out = []
        for i in range(len(x)):
            chosen = [ids[i, 0]]
            for j, d in zip(ids[i, 1:], dist[i, 1:]):
                if len(chosen) == REPLICAS or d > NEAR * NEAR * dist[i, 0]:
                    break
                if (((self.c[chosen] - self.c[j]) ** 2).sum(1) > d).all():
                    chosen.append(j)
            out.append(chosen)
        return out


def _lifted(x: np.ndarray, bound: float, is_query: bool) -> np.ndarray:
    """One more coordinate: vectors get length `bound`, queries get that length and a zero."""
    sq = (x * x).sum(1)
    if is_query:
        return np.column_stack([x * (bound / np.sqrt(sq))[:, None], np.zeros(len(x))])
    return np.column_stack([x, np.sqrt(np.maximum(bound * bound - sq, 0))])


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1) if len(values) else np.zeros((0, 1))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products in double precision, component by component, so equal vectors score equally."""
    out = np.zeros((len(q), len(v)))
    for k in range(q.shape[1]):
        out += q[:, k, None] * v[None, :, k]
    return out


def _smallest(k: int):
    """Per task and vector, its k + 1 smallest ids."""
    def run(batches: Iterator) -> Iterator:
        import heapq

        import pyarrow as pa

        def out(seen, kind):
            return pa.RecordBatch.from_arrays([
                pa.array([np.frombuffer(v, kind.value_type.to_pandas_dtype()) for v in seen], kind),
                pa.array(list(seen.values()), pa.list_(pa.int64()))], ["vec", "ids"])

        seen: dict[bytes, list[int]] = {}
        kind = None
        for b in batches:
            kind = b.column(1).type
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else []
            for i, row in zip(b.column(0).to_pylist(), x):
                ids = seen.setdefault((row + 0).tobytes(), [])
                ids.append(i)
                if len(ids) > 4 * (k + 1):
                    ids[:] = heapq.nsmallest(k + 1, ids)
            if len(seen) > 50_000:
                yield out(seen, kind)
                seen.clear()
        if seen:
            yield out(seen, kind)
    return run


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("vec"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", finite)
                & F.exists("vec", lambda x: x != 0))
    sizes = v.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.where(F.size("vec") == (sizes["d"] if sizes else 0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id",
            embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row with `is_query` (of vec_id and vec)."""
    spark = vectors.sparkSession
    ship_package(spark)
    clean = usable(vectors, vec_id, embedding)
    kind = clean.schema["vec"].dataType.simpleString()
    entries = clean.mapInArrow(_smallest(k), f"vec {kind}, ids array<bigint>").groupBy("vec").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    entries = cut_lineage(entries.withColumn("gid", F.monotonically_increasing_id()))
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, top = entries.agg(F.count(F.lit(1)), F.max(square)).first()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    bound = math.sqrt(top)
    picked = entries.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1, 0.97 * SAMPLE / n)))
    rows = picked.select("vec").limit(SAMPLE).collect()
    sample = _lifted(np.array([r["vec"] for r in rows] or [entries.first()["vec"]], np.float64), bound, False)
    lists = min(CENTROIDS, 1 << max(0, round(math.log2(LISTS * math.sqrt(n)))), 1 << int(math.log2(len(sample))))
    # All points lie on one sphere; means are drawn back to it, so that distances between centroids
    # compare with those between a vector and its centroid.
    c = fit_centroids(sample, lists)
    norm = np.linalg.norm(c, axis=1, keepdims=True)
    graph = Graph(np.where(norm > 0, c * bound / np.where(norm > 0, norm, 1), c))
    sent = spark.sparkContext.broadcast(graph)  # at most CENTROIDS rows

    def post(batches: Iterator) -> Iterator:
        import pyarrow as pa

        g = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                c = b.slice(at, 512)
                x = _lifted(_matrix(c.column(1)), bound, False)
                found = g.postings(x)
                row = [i for i, f in enumerate(found) for _ in f]
                to = [j for f in found for j in f]
                t = c.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), t.column(0), t.column(1), t.column(2)],
                                                 ["list", "gid", "vec", "least"])

    slim = entries.select("gid", "vec", F.col("ids")[0].alias("least"))
    posted = cut_lineage(slim.mapInArrow(post, f"list int, gid bigint, vec {kind}, least bigint"))
    count = np.zeros(len(graph.c), np.int64)
    for r in posted.groupBy("list").count().collect():  # at most CENTROIDS rows
        count[r["list"]] = r["count"]
    sizes = spark.sparkContext.broadcast(count)
    asked = cut_lineage(clean.where(is_query).join(entries.select("vec", "gid"), "vec").select("vec_id", "gid"))
    points = cut_lineage(slim.join(asked.select("gid").distinct(), "gid", "left_semi").select("gid", "vec"))
    ratio = measured_ratio(points, slim, graph, bound, k)
    enough = REPLICAS * (k + 1)  # a vector is in at most REPLICAS lists, so these postings are k + 1 vectors

    def ask(batches: Iterator) -> Iterator:
        import pyarrow as pa

        g = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                c = b.slice(at, 512)
                found = g.within(_lifted(_matrix(c.column(1)), bound, True), ratio, FIRST, sizes.value, enough)
                row = [i for i, f in enumerate(found) for _ in f[0]]
                place = [p for f in found for p in range(len(f[0]))]
                t = c.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([f[0] for f in found]).astype(np.int32)), pa.array(place, pa.int32()), t.column(0),
                    t.column(1)], ["list", "place", "qid", "qvec"])

    probes = cut_lineage(points.mapInArrow(ask, f"list int, place int, qid bigint, qvec {kind}"))
    near = _met(probes.where(F.col("place") < FIRST).withColumn("least_score", F.lit(float("-inf"))), posted, k)
    near = cut_lineage(near.dropDuplicates(["qid", "gid"]))
    # What a query has found already bounds what the other lists need to give.
    by_score = W.partitionBy("qid").orderBy(F.desc("score"), "least")
    bounds = near.withColumn("r", F.row_number().over(by_score)).where(F.col("r") == k + 1).select("qid", F.col("score").alias("least_score"))
    rest = probes.where(F.col("place") >= FIRST).join(bounds, "qid", "left").withColumn(
        "least_score", F.coalesce("least_score", F.lit(float("-inf"))))
    met = near.unionByName(_met(rest, posted, k)).dropDuplicates(["qid", "gid"])  # a vector may be in several of a query's lists
    groups = met.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= k + 1)
    ids = groups.join(entries.select("gid", "ids"), "gid").select("qid", "score", F.explode("ids").alias("id"))
    order = W.partitionBy("qid").orderBy(F.desc("score"), "id")
    ids = ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    found = ids.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("all"))
    hits = asked.join(found, asked["gid"] == found["qid"]).select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(
        F.filter("all", lambda h: h["id"] != F.col("vec_id")), 1, k)).alias("p", "h"))
    return hits.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("h.id").alias("vec_id"), F.col("h.score").alias("score"))


def measured_ratio(points: DataFrame, vectors: DataFrame, graph: Graph, bound: float, k: int) -> float:
    """The smallest ratio that reaches RECALL of the neighbours of at most MEASURED sampled queries."""
    n = points.count()
    few = points.where(F.pmod(F.xxhash64("gid"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1, 0.8 * MEASURED / max(n, 1)))).limit(MEASURED)
    rows = few.collect() or points.limit(1).collect()
    if not rows:
        return 1.0
    gid = np.array([r["gid"] for r in rows])
    q = np.array([r["vec"] for r in rows], np.float64)

    def best(batches: Iterator) -> Iterator:
        import pyarrow as pa

        top = [np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)]
        kept = {}
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column(0).to_numpy()
            s = np.where(gid[:, None] == own[None], -np.inf, q @ _matrix(b.column(1)).T)
            s, at = np.concatenate([top[0], s], 1), np.concatenate([top[1], np.broadcast_to(own, s.shape)], 1)
            pick = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
            top = [np.take_along_axis(s, pick, 1), np.take_along_axis(at, pick, 1)]
            wanted = set(top[1].ravel().tolist())
            kept = {g: v for g, v in kept.items() if g in wanted} | {
                int(g): b.column(1)[i].as_py() for i, g in enumerate(own) if int(g) in wanted}
        who = np.repeat(np.arange(len(q)), top[0].shape[1])
        real = np.isfinite(top[0].ravel())
        ids = top[1].ravel()[real]
        yield pa.RecordBatch.from_arrays([
            pa.array(who[real], pa.int32()), pa.array(ids, pa.int64()), pa.array(top[0].ravel()[real], pa.float64()),
            pa.array([kept[int(g)] for g in ids], pa.list_(pa.float64()))], ["q", "gid", "score", "vec"])

    found = vectors.select("gid", "vec").mapInArrow(best, "q int, gid bigint, score double, vec array<double>")
    by = W.partitionBy("q").orderBy(F.desc("score"), "gid")
    hits = found.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).select("q", "vec").collect()  # MEASURED * k rows
    if not hits:
        return 1.0
    x, v = _lifted(q, bound, True), _lifted(np.array([h["vec"] for h in hits]), bound, False)
    dist = np.maximum((x * x).sum(1)[:, None] + graph.sq - 2 * x @ graph.c.T, 0)
    least = np.sqrt(np.maximum(dist.min(axis=1), 1e-300))
    need = np.sort([np.sqrt(dist[h["q"], lists].min()) / least[h["q"]] for h, lists in zip(hits, graph.postings(v))])
    return float(need[min(len(need) - 1, math.ceil(RECALL * len(need)) - 1)]) + 1e-9


def _met(probes: DataFrame, posted: DataFrame, k: int) -> DataFrame:
    """(qid, gid, least, score): of each list of a query, the k + 1 best vectors that reach `least_score`."""
    # Both sizes are per list, so at most CENTROIDS rows are broadcast.
    pages = posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PAGE).cast("int").alias("pages")).join(
        probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PAGE).cast("int").alias("parts")), "list")
    pages = F.broadcast(cut_lineage(pages))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col(c) - 1).cast("bigint")))
    left = probes.join(pages, "list").select("list", "qid", "qvec", "least_score", F.pmod(F.xxhash64("qid"), F.col("parts")).alias(
        "part"), upto("pages").alias("page"))
    right = posted.join(pages, "list").select("list", "gid", "vec", "least", F.pmod(F.xxhash64("gid"), F.col("pages")).alias(
        "page"), upto("parts").alias("part"))

    def meet(l, r):  # noqa: E741
        import pyarrow as pa

        names = ["qid", "gid", "least", "score"]
        if not l.num_rows or not r.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(),) * 3 + (pa.float64(),))})
        q, v = _matrix(l["qvec"]), _matrix(r["vec"])
        qid, gid, least = l["qid"].to_numpy(), r["gid"].to_numpy(), r["least"].to_numpy()
        limit, out = l["least_score"].to_numpy(), []
        for at in range(0, len(q), 256):
            s = q[at:at + 256] @ v.T
            # The product rounds otherwise than the sum of record, so its choice has a margin.
            slack = 1e-9 * (1 + np.abs(s).max(axis=1, keepdims=True))
            kth = -np.partition(-s, min(k, s.shape[1] - 1), axis=1)[:, min(k, s.shape[1] - 1)][:, None]
            row, col = np.nonzero(s >= np.maximum(kth, limit[at:at + 256, None]) - slack)
            score = np.zeros(len(row))
            for d in range(q.shape[1]):
                score += q[at + row, d] * v[col, d]
            order = np.lexsort((least[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            keep = (place <= k) & (score >= limit[at + row])
            row, col = row[keep], col[keep]
            out.append((qid[at + row], gid[col], least[col], score[keep]))
        return pa.table({n: np.concatenate([o[i] for o in out]) for i, n in enumerate(names)})

    keys = ["list", "page", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        meet, "qid bigint, gid bigint, least bigint, score double")


@query("op6_postings")
def op6(spark, d) -> DataFrame:
    return nearest(table(spark, d, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
