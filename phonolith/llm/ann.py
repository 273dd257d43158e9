"""Operator 12: approximate nearest neighbours by learned partitions.

The measure is the inner product. Fitting uses a bounded sample (about
``sample`` distinct vectors, those of the smallest hashes; some of them are held
back). Tasks compute the sample's neighbour graph; it is cut into equally large
partitions by recursive bisection (the second eigenvector's median, then
exchanges of nodes that lower the cut); and a small network with one hidden layer
learns where a vector's neighbours lie. The number of partitions that a query
probes is the smallest at which the held-back vectors find ``target`` of their
neighbours in the sample.

Every vector is indexed under the network's most probable partition, and every
query goes to its most probable ones, where it meets all their vectors in double
precision. A partition of more rows than its share is cut into shards, and its
queries into chunks; a task searches one shard for one chunk. Equal vectors are
one row with their ``k + 1`` smallest ids, as no more can be in an answer, and
equal queries are searched once. A query that finds too few rows in its
partitions searches all. Tables below two partitions' size have one, so their
search is exact.

Ties: scores are computed again for the best rows, always in the same order of
entries, so equal vectors have equal scores; equal scores are ranked by id.

Defined results: vectors that are null, empty, zero or hold null or non-finite
entries take no part; nor do those of another length than most distinct vectors
have (the longer of equally common ones); a row of the query's id counts as the
query's own once, further ones are candidates; a null id is no query and comes
last among ties; repeated query rows have answers each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phonolith.llm.common import staged, table
from phonolith.llm.vectors import coded, commonest_dim

K = 20
QUERY_STEP = 20
#: About so many distinct vectors are the sample; HELD of them in a thousand are held back.
SAMPLE = 16_384
HELD = 80
#: Distinct vectors in a partition, at least; partitions, at most.
PER_PART = 1024
MAX_PARTS = 256
#: Share of the held-back vectors' neighbours in the probed partitions.
TARGET = 0.94
#: Bytes of vectors in a block of a search, about; scores computed together.
BLOCK_BYTES = 8_000_000
SCORES = 1_000_000
HIDDEN, EPOCHS, BATCH, RATE = 128, 15, 256, 3e-3
SEED = 42
NO_ID = (1 << 63) - 1
NEAR = "array<struct<minus:double,id:bigint>>"
_NEAR = pa.struct([("minus", pa.float64()), ("id", pa.int64())])
RESULT = "query_id long, rank int, vec_id long, score double"


# --- vectors -------------------------------------------------------------------------


def _encoded(x: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The places of vectors that are not zero, and their doubles as bytes, or floats where these are the same."""
    kept = np.flatnonzero(x.any(axis=1))
    x = x[kept] + 0.0
    with np.errstate(over="ignore"):
        small = x.astype("<f4")
    narrow = (small == x).all(axis=1)
    codes = [small[i].tobytes() if narrow[i] else x[i].astype("<f8").tobytes() for i in range(len(x))]
    return kept, codes


def decoded(codes: list[bytes], dim: int) -> np.ndarray:
    x = np.empty((len(codes), dim))
    narrow = np.array([len(c) == 4 * dim for c in codes], bool)
    for rows, kind in ((np.flatnonzero(narrow), "<f4"), (np.flatnonzero(~narrow), "<f8")):
        x[rows] = np.frombuffer(b"".join([codes[i] for i in rows]), kind).reshape(len(rows), dim)
    return x


def directions(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


# --- the neighbour graph and its partitions -----------------------------------------------


def neighbours(spark: SparkSession, x: np.ndarray, k: int) -> np.ndarray:
    """Of each row of the sample the k others of the largest inner product; -1 if there are fewer."""
    shipped = spark.sparkContext.broadcast(x)  # the sample, bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everyone = shipped.value
        step = max(1, SCORES // len(everyone))
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for at in range(0, len(nodes), step):
                own = nodes[at : at + step]
                score = everyone[own] @ everyone.T
                score[np.arange(len(own)), own] = -np.inf
                best = np.argpartition(-score, min(k, len(everyone) - 1) - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(list(best.astype(np.int32)), pa.list_(pa.int32()))], names=["node", "near"])

    out = np.full((len(x), k), -1, np.int64)
    tasks = max(1, min(len(x) // 512, 64))
    rows = spark.range(0, len(x), 1, tasks).mapInArrow(run, "node long, near array<int>").toArrow()  # the sample's size
    near = rows.column("near").combine_chunks()
    width = min(k, len(x) - 1)
    if width > 0:
        out[rows.column("node").to_numpy(), :width] = near.values.to_numpy().reshape(-1, width)
    return out


def bisected(n: int, u: np.ndarray, v: np.ndarray, random: np.random.Generator, rounds: int = 60, exchanges: int = 12) -> np.ndarray:
    """Two halves (False, True) of n nodes with few edges (u, v; each both ways) between them."""
    degree = np.bincount(u, minlength=n).astype(float) + 1e-3
    scale = 1 / np.sqrt(degree)
    weights = scale[u] * scale[v]
    flat = np.sqrt(degree) / np.linalg.norm(np.sqrt(degree))
    x = random.standard_normal(n)
    for _ in range(rounds):
        x -= flat * (flat @ x)
        x = x + np.bincount(u, weights * x[v], minlength=n)
        x /= np.linalg.norm(x) or 1.0
    side = np.zeros(n, bool)
    side[np.argsort(x * scale, kind="stable")[n // 2 :]] = True
    for _ in range(exchanges):
        # What each node would gain on the other side; the best of both sides change places.
        across = side[u] != side[v]
        gain = np.bincount(u, np.where(across, 1.0, -1.0), minlength=n)
        low, high = np.flatnonzero(~side), np.flatnonzero(side)
        low, high = low[np.argsort(-gain[low], kind="stable")], high[np.argsort(-gain[high], kind="stable")]
        pairs = min(len(low), len(high))
        better = int((gain[low[:pairs]] + gain[high[:pairs]] > 2).sum())
        if not better:
            break
        # Half of them, as neighbours that change together gain nothing.
        better = (better + 1) // 2
        side[low[:better]], side[high[:better]] = True, False
    return side


def partitioned(near: np.ndarray, parts: int, random: np.random.Generator) -> np.ndarray:
    """The number of the partition of each node, parts (a power of two) of the same size; near: neighbours, -1 for none."""
    n, k = near.shape
    u, v = np.repeat(np.arange(n), k), near.ravel()
    u, v = u[v >= 0], v[v >= 0]
    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    part = np.zeros(n, np.int64)
    while parts > 1:
        finer = np.zeros(n, np.int64)
        for p in range(int(part.max()) + 1):
            nodes = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[nodes] = np.arange(len(nodes))
            inside = (part[u] == p) & (part[v] == p)
            side = bisected(len(nodes), place[u[inside]], place[v[inside]], random)
            finer[nodes] = 2 * p + side
        part = finer
        parts //= 2
    return part


# --- the classifier ----------------------------------------------------------------------


@dataclass(frozen=True)
class Router:
    """x -> scores of the partitions: one hidden layer; without weights there is one partition."""

    weights: tuple[np.ndarray, ...]
    parts: int
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.zeros((len(x), 1), np.float32)
        a, b, c, d = self.weights
        return np.maximum(directions(x) @ a + b, 0) @ c + d


def trained(x: np.ndarray, wanted: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, ...]:
    """Weights that bring the network's probabilities near the wanted ones (rows sum to 1), by Adam."""
    dim, parts = x.shape[1], wanted.shape[1]
    w = [random.standard_normal((dim, HIDDEN)) * np.sqrt(2), np.zeros(HIDDEN), random.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
    w = [m.astype(np.float32) for m in w]
    first, second, step = [np.zeros_like(m) for m in w], [np.zeros_like(m) for m in w], 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = random.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            hidden = np.maximum(x[rows] @ w[0] + w[1], 0)
            logits = hidden @ w[2] + w[3]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            off = (p / p.sum(axis=1, keepdims=True) - wanted[rows]) / len(rows)
            back = (off @ w[2].T) * (hidden > 0)
            grads = [x[rows].T @ back, back.sum(axis=0), hidden.T @ off, off.sum(axis=0)]
            step += 1
            for i, g in enumerate(grads):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                w[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(w)


def fitted(spark: SparkSession, x: np.ndarray, parts: int, k: int, target: float) -> Router:
    """The router for a sample x of distinct vectors."""
    if parts == 1 or len(x) < 2 * parts:
        return Router((), 1, 1)
    random = np.random.default_rng(SEED)
    near = neighbours(spark, x, k)
    held = random.random(len(x)) < HELD / 1000
    held[: 2 * parts] = False
    place = np.where(held, -1, np.cumsum(~held) - 1)
    inner = np.where(near >= 0, place[near], -1)[~held]
    part = partitioned(inner, parts, random)
    wanted = np.zeros((len(part), parts), np.float32)
    wanted[np.arange(len(part)), part] = 1
    for c in range(inner.shape[1]):
        there = np.flatnonzero(inner[:, c] >= 0)
        wanted[there, part[inner[there, c]]] += 1
    wanted /= wanted.sum(axis=1, keepdims=True)
    router = Router(trained(directions(x[~held]), wanted, random), parts, parts)
    scores = router.scores(x)
    own = scores.argmax(axis=1)
    places = np.argsort(np.argsort(-scores[held], axis=1, kind="stable"), axis=1)
    found = near[held]
    ranks = np.take_along_axis(places, own[found], axis=1)[found >= 0]
    probes = next((p for p in range(1, parts) if len(ranks) and (ranks < p).mean() >= target), parts)
    return Router(router.weights, parts, probes)


# --- the search -----------------------------------------------------------------------------


def best_rows(x: np.ndarray, ids: list[list[int]], q: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each row of q the (scores, ids) of its most nearest rows of x, where row i has the ids ids[i]."""
    counts = np.array([len(i) for i in ids])
    starts, flat = np.cumsum(counts) - counts, np.array([j for i in ids for j in i], np.int64)
    longest = np.abs(x).sum(axis=1).max()
    step = max(1, SCORES // len(x))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        scores = part @ x.T
        # What rounding may hide: rows so near the last place are computed again.
        slack = 8 * np.finfo(float).eps * x.shape[1] * np.abs(part).max(axis=1) * longest
        last = np.partition(scores, len(x) - most, axis=1)[:, len(x) - most] if len(x) > most else np.full(len(part), -np.inf)
        for i, own in enumerate(part):
            rows = np.flatnonzero(~(scores[i] < last[i] - slack[i]))
            exact = (x[rows] * own).sum(axis=1)
            many = counts[rows]
            places = np.repeat(starts[rows] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            found, score = flat[places], np.repeat(exact, many)
            order = np.lexsort((found, -score))[:most]
            yield score[order], found[order]


def searched(index: DataFrame, queries: DataFrame, dim: int, most: int, parts: int) -> DataFrame:
    """(q, near): of each query the most best rows as (minus score, id), best first. index (part, ids, code), queries (q, code, parts)."""
    wanted = queries.select("q", "code", F.explode("parts").alias("part"))
    # One row for each partition.
    sizes = dict(index.groupBy("part").agg(F.count("*")).collect())
    asked = dict(wanted.groupBy("part").agg(F.count("*")).collect())
    rows = max(1024, BLOCK_BYTES // (8 * dim))
    # A partition of more than its share is cut, so that none is a much longer task.
    share = lambda n, of: [max(1, -(-of.get(p, 0) // max(1024, min(rows, 3 * n // (2 * parts))))) for p in range(parts)]
    shards, chunks = share(sum(sizes.values()), sizes), share(sum(asked.values()), asked)
    of = lambda numbers: F.element_at(F.array(*map(F.lit, numbers)), F.col("part") + 1)
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    data = index.withColumn("shard", F.pmod(F.xxhash64("code"), of(shards)).cast("int")).withColumn("chunk", upto(of(chunks)))
    asking = wanted.withColumn("chunk", F.pmod(F.xxhash64("q"), of(chunks)).cast("int")).withColumn("shard", upto(of(shards)))
    columns = ["part", "shard", "chunk", "q", "ids", "code"]
    both = data.withColumn("q", F.lit(None).cast("long")).select(columns).unionByName(asking.withColumn("ids", F.lit(None).cast("array<bigint>")).select(columns))

    def run(block: pa.Table) -> pa.Table:
        inside = block.filter(block.column("q").is_null())
        asks = block.filter(block.column("q").is_valid())
        names, near = asks.column("q"), []
        if len(inside) and len(asks):
            x, q = (decoded(t.column("code").to_pylist(), dim) for t in (inside, asks))
            near = [pa.StructArray.from_arrays([pa.array(0.0 - score), pa.array(ids)], fields=list(_NEAR)) for score, ids in best_rows(x, inside.column("ids").to_pylist(), q, most)]
        offsets = np.cumsum([0, *map(len, near)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(near) if near else pa.array([], _NEAR))
        return pa.table({"q": names.slice(0, len(near)), "part": pa.array([block.column("part")[0].as_py()] * len(near), pa.int32()), "near": lists})

    found = both.groupBy("part", "shard", "chunk").applyInArrow(run, f"q long, part int, near {NEAR}")
    best = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, most).alias("near")
    if max(shards) > 1:
        # One list for each partition first, so that no query's lists grow with the table.
        found = found.groupBy("q", "part").agg(best)
    return found.groupBy("q").agg(best)


def routed(rows: DataFrame, router: Router, dim: int, most: int) -> DataFrame:
    """rows (.., code) with parts, the router's most probable partitions."""
    shipped = rows.sparkSession.sparkContext.broadcast(router)  # some 100 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                own = batch.slice(at, 4096)
                scores = shipped.value.scores(decoded(own.column(own.schema.get_field_index("code")).to_pylist(), dim))
                best = np.argsort(-scores, axis=1, kind="stable")[:, :most].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(list(best), pa.list_(pa.int32()))], names=[*own.schema.names, "parts"])

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", parts array<int>")


def nearest(rows: DataFrame, *, k: int = K, step: int = QUERY_STEP, sample: int = SAMPLE, per_part: int = PER_PART, target: float = TARGET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id is divisible by step."""
    spark = rows.sparkSession
    most = k + 1  # one of them may be the query itself
    own = staged(coded(rows.withColumn(id_col, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))), _encoded, id_col, vector_col), "codes")
    nth = F.row_number().over(Window.partitionBy("dim", "code").orderBy("id"))
    classes = own.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("dim", "code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = staged(classes, "classes")
    dim = commonest_dim(classes)
    if dim is None:
        return spark.createDataFrame([], RESULT)
    classes = classes.where(F.col("dim") == dim).select("ids", "code")
    total = classes.count()
    parts = min(MAX_PARTS, 1 << max(0, (total // per_part).bit_length() - 1))
    router = Router((), 1, 1)
    if parts > 1:
        drawn = classes.where(F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "code"), 11) < F.lit(int(min(1.0, sample / total) * (1 << 53))))
        router = fitted(spark, decoded(drawn.select("code").toArrow().column("code").to_pylist(), dim), parts, k, target)
    index = staged(routed(classes, router, dim, 1).select(F.element_at("parts", 1).alias("part"), "ids", "code"), "index")
    asking = own.where((F.col("dim") == dim) & (F.col("id") % step == 0) & (F.col("id") != NO_ID)).select("id", "code")
    # Numbers of the distinct queries; written, so they stay.
    distinct = staged(asking.select("code").distinct().withColumn("q", F.monotonically_increasing_id()), "distinct")
    queries = staged(routed(distinct, router, dim, router.probes), "queries")
    found = staged(searched(index, queries, dim, most, router.parts), "found")
    if router.parts > 1:
        few = queries.join(found.where(F.size("near") == most).select("q"), "q", "left_anti")
        if few.head(1):
            everywhere = few.withColumn("parts", F.sequence(F.lit(0), F.lit(router.parts - 1)))
            whole = searched(index, everywhere, dim, most, router.parts)
            found = staged(found.join(few.select("q"), "q", "left_anti").unionByName(whole), "found")
    named = asking.join(distinct, "code").select(F.col("id").alias("query_id"), "q").join(found, "q")
    place = F.array_position(F.col("near.id"), F.col("query_id"))
    others = F.slice(F.filter("near", lambda x, i: i + 1 != place), 1, k)
    out = named.select("query_id", F.posexplode(others).alias("at", "near"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.nullif(F.col("near.id"), F.lit(NO_ID)).alias("vec_id"), (F.lit(0.0) - F.col("near.minus")).alias("score"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_nearest_neighbours": op12_nearest_neighbours}
ORACLE: dict = {}
