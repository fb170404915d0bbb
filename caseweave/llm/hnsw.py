"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Vectors of one label are dealt to shards of bounded size; each shard builds a graph.  Every vector
then searches every shard of its label.  A beam search keeps the best ``ef`` members seen; an audit
compares some searches with a scan of the shard and widens the beam until nothing is missed, and a
search whose beam is filled by links is widened by itself, up to a scan.  Hits are verified by
cosine in double precision.  Each task sums the links of its vectors and reduces them to a spanning
forest, so a dense group costs as many rows as it has members; the forests are joined on Spark.

Equal vectors of one label are one class that enters the graphs once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, store
from .components import Forest, components

SIMILAR = 0.98
# Searches grow with the logarithm of a shard, and their number with the shards of a label.
SHARD = 32_768
LINKS = 16
BUILD_EF, SEARCH_EF = 64, 48
BATCH = 256
AUDITED = 48
# Single precision steers the search; what comes this close is verified in double precision.
MARGIN = 1e-4


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest part first, so that squares stay finite."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _diverse(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, m: int) -> np.ndarray:
    """For each node at most ``m`` candidates: those closer to it than to any one chosen before, then the nearest."""
    near = np.einsum("vd,vcd->vc", x[nodes], x[candidates])
    near[candidates < 0] = -np.inf
    near[candidates == nodes[:, None]] = -np.inf
    order = np.argsort(-near, axis=1, kind="stable")
    candidates, near = np.take_along_axis(candidates, order, 1), np.take_along_axis(near, order, 1)
    vectors = x[candidates]
    between = np.einsum("vcd,ved->vce", vectors, vectors)
    usable = np.isfinite(near)
    # A candidate listed twice counts once.
    usable[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    chosen = np.zeros(usable.shape, bool)
    for c in range(candidates.shape[1]):
        blocked = (chosen[:, :c] & (between[:, :c, c] >= near[:, c, None])).any(1)
        chosen[:, c] = usable[:, c] & ~blocked & (chosen.sum(1) < m)
    rank = np.where(chosen, 0, np.where(usable, 1, 2)) * candidates.shape[1] + np.arange(candidates.shape[1])
    first = np.argsort(rank, axis=1)[:, :m]
    out = np.take_along_axis(candidates, first, 1)
    out[~np.take_along_axis(usable, first, 1)] = -1
    return out


def _search(x: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, entries: np.ndarray, ef: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The best ``ef`` members seen from ``entries`` (-1: none) for each query, best first: members and similarities."""
    q, rows = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((q, len(x) + 1), bool)
    ids, near = np.full((q, ef), -1), np.full((q, ef), -np.inf, np.float32)
    open_ = np.zeros((q, ef), bool)
    new = entries
    while True:
        fresh = (new >= 0) & ~seen[rows, new]
        # The same member may be reached twice in one step.
        order = np.argsort(new, axis=1, kind="stable")
        in_order = np.take_along_axis(new, order, 1)
        again = np.zeros(new.shape, bool)
        np.put_along_axis(again, order[:, 1:], in_order[:, 1:] == in_order[:, :-1], 1)
        fresh &= ~again
        seen[rows, np.where(fresh, new, -1)] = True
        seen[:, -1] = False
        sims = np.where(fresh, np.einsum("qd,qcd->qc", queries, x[new]), -np.inf).astype(np.float32)
        ids, near, open_ = np.concatenate([ids, new], 1), np.concatenate([near, sims], 1), np.concatenate([open_, fresh], 1)
        best = np.argsort(-near, axis=1, kind="stable")[:, :ef]
        ids, near, open_ = (np.take_along_axis(a, best, 1) for a in (ids, near, open_))
        if not open_.any():
            return np.where(np.isfinite(near), ids, -1), near
        pick = np.argsort(~open_, axis=1, kind="stable")[:, :expand]
        picked = np.where(np.take_along_axis(open_, pick, 1), np.take_along_axis(ids, pick, 1), -1)
        np.put_along_axis(open_, pick, False, 1)
        new = np.where(picked[:, :, None] >= 0, neighbours[picked], -1).reshape(q, -1)


class Graph:
    """A hierarchical small-world graph over the rows of ``vectors`` (unit length)."""

    def __init__(self, vectors: np.ndarray, seed: int = 0):
        self.exact = vectors
        self.x = vectors.astype(np.float32)
        n = len(vectors)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 8)
        if n:
            self.level[0] = self.level.max()
        self.layers = [np.full((n, LINKS * (2 if layer == 0 else 1)), -1) for layer in range(self.level.max(initial=0) + 1)]
        for at in range(0, n, BATCH):
            self._insert(np.arange(at, min(n, at + BATCH)))

    def _insert(self, nodes: np.ndarray) -> None:
        queries, entries = self.x[nodes], np.full((len(nodes), 1), 0 if nodes[0] else -1)
        for layer in range(len(self.layers) - 1, -1, -1):
            neighbours = self.layers[layer]
            found = np.full((len(nodes), 1), -1)
            if nodes[0]:
                found, _ = _search(self.x, neighbours, queries, entries, BUILD_EF if layer == 0 else 16)
                entries = found[:, :8]
            here = self.level[nodes] >= layer
            if not here.any():
                continue
            own = nodes[here]
            inner = self.x[own] @ self.x[own].T
            np.fill_diagonal(inner, -np.inf)
            width = min(len(own), BUILD_EF)
            together = own[np.argsort(-inner, axis=1, kind="stable")[:, :width]]
            m = neighbours.shape[1]
            chosen = _diverse(self.x, own, np.concatenate([found[here], together], 1), min(m, LINKS))
            neighbours[own, : chosen.shape[1]] = chosen
            self._link_back(neighbours, own, chosen)

    def _link_back(self, neighbours: np.ndarray, own: np.ndarray, chosen: np.ndarray) -> None:
        to, source = chosen.ravel(), np.repeat(own, chosen.shape[1])
        to, source = to[to >= 0], source[to >= 0]
        order = np.lexsort((-np.einsum("nd,nd->n", self.x[to], self.x[source]), to))
        to, source = to[order], source[order]
        targets, first, count = np.unique(to, return_index=True, return_counts=True)
        # Of many new links to one member the nearest are looked at.
        width = min(int(count.max(initial=1)), 2 * LINKS)
        place = first[:, None] + np.arange(width)
        offered = np.where(np.arange(width) < count[:, None], source[np.minimum(place, len(source) - 1)], -1)
        m = neighbours.shape[1]
        for i in range(0, len(targets), 512):
            part = targets[i : i + 512]
            neighbours[part] = _padded(_diverse(self.x, part, np.concatenate([neighbours[part], offered[i : i + 512]], 1), m), m)

    def search(self, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        entries = np.zeros((len(queries), 1), int)
        for layer in range(len(self.layers) - 1, 0, -1):
            entries = _search(self.x, self.layers[layer], queries, entries, 8)[0]
        return _search(self.x, self.layers[0], queries, entries, ef)


def _padded(a: np.ndarray, width: int) -> np.ndarray:
    return np.concatenate([a, np.full((len(a), width - a.shape[1]), -1)], 1) if a.shape[1] < width else a


def _close(graph: Graph, queries: np.ndarray, members: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """The (query, member) places whose cosine in double precision is at least ``similar``."""
    q, c = np.nonzero(members >= 0)
    m = members[q, c]
    good = np.einsum("nd,nd->n", queries[q], graph.exact[m]) >= similar
    return q[good], m[good]


def _scan(graph: Graph, queries: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    q, m = np.nonzero(queries.astype(np.float32) @ graph.x.T >= similar - MARGIN)
    good = np.einsum("nd,nd->n", queries[q], graph.exact[m]) >= similar
    return q[good], m[good]


def _audit(graph: Graph, queries: np.ndarray, ef: int, similar: float) -> bool:
    """Whether searches find all links and, for nearly all queries, the two nearest members."""
    sample = queries[:: max(1, len(queries) // AUDITED)][:AUDITED]
    found, _ = graph.search(sample.astype(np.float32), ef)
    near = sample.astype(np.float32) @ graph.x.T
    nearest = np.argsort(-near, axis=1, kind="stable")[:, :2]
    hit = (found[:, :, None] == nearest[:, None, :]).any(1).mean()
    linked = near >= similar - MARGIN
    reached = np.zeros((len(sample), len(graph.x) + 1), bool)
    reached[np.arange(len(sample))[:, None], found] = True
    missed = linked & ~reached[:, :-1]
    # A full beam is widened query by query; here only others count.
    return hit >= 0.98 and not missed[linked.sum(1) < ef // 2].any()


def hits(graph: Graph, queries: np.ndarray, similar: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of (query, member) places that link."""
    n, ef = len(graph.x), SEARCH_EF
    while ef < n // 4 and not _audit(graph, queries, ef, similar):
        ef *= 2
    for at in range(0, len(queries), BATCH):
        part, places = queries[at : at + BATCH], np.arange(at, min(len(queries), at + BATCH))
        width = ef
        while len(part):
            if width >= n // 4:
                q, m = _scan(graph, part, similar)
                yield places[q], m
                break
            found, near = graph.search(part.astype(np.float32), width)
            full = (near >= similar - MARGIN).sum(1) >= width // 2
            found[near < similar - MARGIN] = -1
            q, m = _close(graph, part[~full], found[~full], similar)
            yield places[~full][q], m
            part, places, width = part[full], places[full], width * 4


def usable(label: Column, embedding: Column) -> Column:
    """Whether a vector can link: a label, no missing or non-finite part, not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(label.isNotNull() & embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _unpacked(blob: bytes, dim: int, kind: type) -> np.ndarray:
    return np.frombuffer(blob, kind).reshape(-1, dim)


def near_vectors(vectors: DataFrame, *, similar: float = SIMILAR, shard: int = SHARD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``vectors``.

    Links hold between rows of equal label and length; NULL labels and vectors that are NULL, empty,
    zero or not finite link with nothing and stand alone.  Missing ids come after all others.
    """
    none = 2**63 - 1
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = rows.withColumn("usable", usable(F.col("label"), F.col("embedding")))
    key = F.coalesce("vec_id", F.lit(none))
    classes = rows.where("usable").groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first"))
    classes = store(classes.select(F.xxhash64("label", "embedding").alias("id"), "label", F.size("embedding").alias("dim"), "embedding", "copies", "first"))
    shards = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    dealt = classes.join(shards, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    dealt = dealt.withColumn("owner", F.xxhash64("label", "dim", "shard"))

    def build(key: tuple, members: pa.Table) -> pa.Table:
        order = np.argsort(members.column("id").to_numpy(), kind="stable")
        ids = members.column("id").to_numpy()[order]
        copies = members.column("copies").to_numpy()[order]
        flat = members.column("embedding").combine_chunks().flatten().to_numpy()
        x = unit(flat.reshape(len(ids), -1)[order])
        graph = Graph(x)
        sizes = np.array([len(x), x.shape[1], *(layer.shape[1] for layer in graph.layers)], np.int64)
        packed = {"owner": key[0].as_py() if hasattr(key[0], "as_py") else key[0], "sizes": sizes, "ids": ids, "copies": copies, "x": x, "links": np.concatenate([layer.astype(np.int32).ravel() for layer in graph.layers])}
        return pa.table({k: pa.array([v if k == "owner" else v.tobytes()], pa.int64() if k == "owner" else pa.binary()) for k, v in packed.items()})

    blob = "owner long, sizes binary, ids binary, copies binary, x binary, links binary"
    graphs = store(dealt.select("owner", "id", "copies", "embedding").groupBy("owner").applyInArrow(build, blob))
    index = store(dealt.select("label", "dim", "owner").distinct())
    pairs = index.join(index.select("label", "dim", F.col("owner").alias("asking")), ["label", "dim"]).select("owner", "asking")
    asked = pairs.join(graphs, "owner").join(graphs.select(F.col("owner").alias("asking"), F.col("ids").alias("own_ids"), F.col("copies").alias("own_copies"), F.col("x").alias("own_x")), "asking")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                sizes = np.frombuffer(row["sizes"], np.int64)
                graph = Graph.__new__(Graph)
                graph.exact = _unpacked(row["x"], int(sizes[1]), float)
                graph.x = graph.exact.astype(np.float32)
                flat, graph.layers = np.frombuffer(row["links"], np.int32).astype(int), []
                for width in sizes[2:].tolist():
                    graph.layers.append(flat[: sizes[0] * width].reshape(-1, width))
                    flat = flat[sizes[0] * width :]
                ids, copies = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["copies"], np.int64)
                own, own_copies = np.frombuffer(row["own_ids"], np.int64), np.frombuffer(row["own_copies"], np.int64)
                same = row["owner"] == row["asking"]
                n_links, forest = np.zeros(len(own), np.int64), Forest(len(ids) + (0 if same else len(own)))
                for q, m in hits(graph, _unpacked(row["own_x"], int(sizes[1]), float), similar):
                    other = ids[m] != own[q]
                    q, m = q[other], m[other]
                    np.add.at(n_links, q, copies[m])
                    forest.add(m, q if same else q + len(ids))
                if same:
                    n_links += own_copies - 1
                names = ids if same else np.concatenate([ids, own])
                child = np.flatnonzero(forest.root != np.arange(len(names)))
                yield _answers(own, n_links)
                yield pa.RecordBatch.from_arrays([pa.array(names[child]), pa.array(names[forest.root[child]]), pa.nulls(len(child), pa.int64())], ANSWER)

    answers = store(map_batches(asked, ask, "a long, b long, n long"))
    counts = answers.where("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
    joined = components(answers.where("n is null").select("a", "b")).withColumnsRenamed({"node": "id", "component": "root"})
    table = classes.select("id", "label", "embedding", "first").join(counts, "id").join(joined, "id", "left").withColumn("root", F.coalesce("root", "id"))
    heads = table.groupBy("root").agg(F.min("first").alias("head"))
    table = table.join(heads, "root").select("label", "embedding", "n_links", "head")
    linked = rows.where("usable").join(table, ["label", "embedding"]).select("vec_id", "n_links", F.when(F.col("head") != none, F.col("head")).alias("component_id"))
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ANSWER = ["a", "b", "n"]


def _answers(own: np.ndarray, n_links: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(own), pa.nulls(len(own), pa.int64()), pa.array(n_links)], ANSWER)
