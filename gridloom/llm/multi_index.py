"""Near-duplicate vectors through an inverted multi-index.

Unit vectors are cut in halves, each half has a codebook of its own, and the pairs of codewords form a grid of cells.
Every vector is stored in its own cell and looks into other cells in the order of their distance (multi-sequence
traversal of the two sorted codeword lists) up to a radius at which the wanted share of all links is found. What it
finds there is verified with exact cosines.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import BUCKETS
from gridloom.llm.components import connected_components
from gridloom.operators.lookup import fits_broadcast
from gridloom.session import cut_lineage

COSINE = 0.93
RECALL = 0.998
FIT_VECTORS = 8192
PROBE_VECTORS = 256
CHUNK = 2048
CELL_TARGET = 64
MOST_WORDS = 8192
PER_WORD = 8
SLACK = 0.04  # added to the measured radius, in squared distance


@dataclass
class Index:
    first: np.ndarray  # codewords of the first halves
    second: np.ndarray
    radius: float  # how much farther (squared) than the own cell a visited cell may be

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _squares(x[:, :half], self.first), _squares(x[:, half:], self.second)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The cell number of each vector."""
        a, b = self.distances(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def visits(self, x: np.ndarray) -> list[list[int]]:
        """The cells each vector looks into, nearest first."""
        a, b = self.distances(x)
        a, b = a - a.min(1, keepdims=True), b - b.min(1, keepdims=True)
        order_a, order_b = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        return [list(_traverse(a[i], b[i], order_a[i], order_b[i], self.radius)) for i in range(len(x))]


def _squares(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1), 0)


def _traverse(a: np.ndarray, b: np.ndarray, order_a: np.ndarray, order_b: np.ndarray, radius: float) -> Iterator[int]:
    """Cells by growing summed distance, until it passes ``radius``: the multi-sequence algorithm with a heap."""
    heap = [(a[order_a[0]] + b[order_b[0]], 0, 0)]
    while heap:
        distance, i, j = heapq.heappop(heap)
        if distance > radius:
            return
        yield int(order_a[i]) * len(b) + int(order_b[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (a[order_a[i]] + b[order_b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[order_a[i + 1]] + b[order_b[0]], i + 1, 0))


def codebook(x: np.ndarray, size: int, rounds: int = 15, seed: int = 3) -> np.ndarray:
    """Lloyd's algorithm from rows drawn without replacement; an empty codeword takes the farthest row."""
    rng = np.random.default_rng(seed)
    size = max(1, min(size, len(x)))
    words = x[rng.choice(len(x), size, replace=False)].copy()
    for _ in range(rounds):
        d = _squares(x, words)
        nearest = d.argmin(1)
        sums = np.zeros_like(words)
        np.add.at(sums, nearest, x)
        counts = np.bincount(nearest, minlength=size)
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
        for k in np.flatnonzero(counts == 0):
            words[k] = x[d.min(1).argmax()]
    return words


def unit_rows(vectors: list) -> np.ndarray:
    """Rows of length one; divided by their largest component first, so that no square leaves the range of a double."""
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, rows: int = FIT_VECTORS, probes: int = PROBE_VECTORS) -> Index | None:
    """Learn codebooks and the radius from distinct ``vectors`` (id, label, v).

    About ``rows`` vectors drawn by hash, and ``PER_WORD`` for each codeword at least, train the codebooks on the driver. Codebooks grow with
    the root of the table up to ``MOST_WORDS``, which keep cells at ``CELL_TARGET`` vectors up to about four billion vectors. The radius is
    measured: about 16 times ``probes`` vectors drawn by hash are compared with all vectors of their label by brute force, in parallel, and the
    radius is half as much again as the smallest that reaches the cells of the share ``recall`` of the links found. Vectors
    without links say nothing about it; without any link the radius is that of a cosine.
    """
    n = vectors.count()
    if not n:
        return None
    bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS))
    size = int(2 ** np.clip(np.round(np.log2(max(1.0, np.sqrt(n / CELL_TARGET)))), 0, np.log2(MOST_WORDS)))
    rows = max(rows, PER_WORD * size)
    drawn = vectors.where(bucket < int(BUCKETS * min(1.0, rows / n)) + 1).select("id", "v").orderBy("id").collect()
    x = unit_rows([r["v"] for r in drawn])
    half = max(1, x.shape[1] // 2)
    index = Index(codebook(x[:, :half], size), codebook(x[:, half:], size), 0.0)
    farthest = 2 * (1 - cosine)  # squared distance of unit vectors at the least cosine
    many = vectors.where(F.pmod(F.xxhash64("id", F.lit("probe")), F.lit(BUCKETS)) < int(BUCKETS * min(1.0, 16 * probes / n)) + 1).select("id", "label", "v").orderBy("id").collect()
    sent = vectors.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in many]), np.array([r["label"] for r in many]), unit_rows([r["v"] for r in many]) if many else None))

    def gaps(batches):
        ids, labels, probes_x = sent.value
        for frame in batches:
            out = []
            if probes_x is not None and len(frame):
                own = unit_rows(frame["v"].tolist())
                a, b = index.distances(own)
                home_a, home_b = a.argmin(1), b.argmin(1)
                pa_, pb_ = index.distances(probes_x)
                for lo in range(0, len(own), 1024):
                    near = (own[lo : lo + 1024] @ probes_x.T >= cosine) & (frame["label"].to_numpy()[lo : lo + 1024, None] == labels) & (frame["id"].to_numpy()[lo : lo + 1024, None] != ids)
                    for i, j in zip(*np.nonzero(near), strict=True):
                        out.append(pa_[j, home_a[lo + i]] - pa_[j].min() + pb_[j, home_b[lo + i]] - pb_[j].min())
            yield pd.DataFrame({"gap": np.ceil(np.array(out, dtype=float) * 1000) / 1000, "n": np.ones(len(out), dtype=np.int64)}).groupby("gap", as_index=False)["n"].sum()

    found = vectors.select("id", "label", "v").mapInPandas(gaps, "gap double, n long").groupBy("gap").agg(F.sum("n").alias("n")).orderBy("gap").collect()
    total = sum(r["n"] for r in found)
    seen, index.radius = 0, farthest
    for r in found:
        seen += r["n"]
        if seen >= recall * total:
            # Half as much again: links that the probes did not meet lie a little farther out.
            index.radius = min(1.5 * r["gap"] + SLACK, 4.0)
            break
    return index


def links(vectors: DataFrame, index: Index, cosine: float = COSINE, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """What the index finds between distinct ``vectors`` (id, label, v, copies).

    Returned: (id, n) with the copies of all linked vectors, and (a, b) edges that connect what is linked. A cell of a label
    with more than ``chunk`` stored vectors or visitors is cut into blocks, and every block of one meets every block of the
    other in a task of its own, so no task gets an unbounded group. Pairs exist only as a matrix of two blocks; what leaves
    a task is a count per visitor and at most one edge per vector and block.
    """

    def place(batches):
        for frame in batches:
            if not len(frame):
                continue
            x = unit_rows(frame["v"].tolist())
            home, visits = index.home(x), index.visits(x)
            counts = [len(v) for v in visits]
            rows = np.repeat(np.arange(len(frame)), counts)
            cells = np.array([c for v in visits for c in v], dtype=np.int64)
            yield pd.DataFrame({"id": frame["id"].to_numpy()[rows], "label": frame["label"].to_numpy()[rows], "cell": cells, "stored": cells == home[rows]})

    placed = cut_lineage(vectors.select("id", "label", "v").mapInPandas(place, "id long, label long, cell long, stored boolean"))
    sizes = placed.groupBy("label", "cell").agg(F.count_if("stored").alias("s"), F.count(F.lit(1)).alias("q")).where("s > 0")
    # A cell that only its one vector visits has nothing to compare.
    sizes = sizes.where("q > 1").select("label", "cell", F.ceil(F.col("s") / chunk).cast("int").alias("sb"), F.ceil(F.col("q") / chunk).cast("int").alias("qb"))
    met = placed.join(sizes, ["label", "cell"])
    draw = F.xxhash64("id")
    visitors = met.select("id", "label", "cell", F.pmod(draw, "qb").alias("qc"), F.explode(F.sequence(F.lit(0), F.col("sb") - 1)).alias("sc"), F.lit(False).alias("stored"))
    stored = met.where("stored").select("id", "label", "cell", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("qc"), F.pmod(draw, "sb").alias("sc"), F.lit(True).alias("stored"))
    tasks = visitors.withColumn("qc", F.col("qc").cast("int")).unionByName(stored.withColumn("sc", F.col("sc").cast("int")))
    # The vectors are joined by id only now, so placements are small; hot cells are already cut into blocks.
    whole = vectors.select(F.col("id"), "v", "copies")
    rows = tasks.join(F.broadcast(whole) if fits_broadcast(whole, 20_000) else whole, "id")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        s, q = frame[frame["stored"]], frame[~frame["stored"]]
        if not len(s) or not len(q):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        xs, ids, copies, own = unit_rows(s["v"].tolist()), s["id"].to_numpy(), s["copies"].to_numpy(), q["id"].to_numpy()
        near = np.concatenate([unit_rows(q["v"].iloc[lo : lo + 256].tolist()) @ xs.T >= cosine for lo in range(0, len(q), 256)])
        near &= own[:, None] != ids
        counts = near @ copies
        low_q, low_s = _block_roots(near, own, ids)
        hit_q, hit_s = counts > 0, near.any(0)
        # A count for each visitor, and for everything linked here an edge to the smallest of what it is connected with.
        return pd.DataFrame({
            "a": np.concatenate([own[hit_q], ids[hit_s]]), "b": np.concatenate([low_q[hit_q], low_s[hit_s]]),
            "n": np.concatenate([counts[hit_q], np.zeros(int(hit_s.sum()), dtype=np.int64)]),
        }).astype("int64")

    found = cut_lineage(rows.groupBy("label", "cell", "qc", "sc").applyInPandas(compare, "a long, b long, n long"))
    return found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n")), found.select("a", "b").where("a <> b").distinct()


def _block_roots(near: np.ndarray, own: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id each row and column of a block is connected with through the block's links."""
    top = np.iinfo(np.int64).max
    rows, columns = own.copy(), ids.copy()
    while True:
        before = rows.copy(), columns.copy()
        for lo in range(0, len(rows), 256):
            part = near[lo : lo + 256]
            rows[lo : lo + 256] = np.minimum(rows[lo : lo + 256], np.where(part, columns, top).min(1))
            columns = np.minimum(columns, np.where(part, rows[lo : lo + 256, None], top).min(0))
        if (rows == before[0]).all() and (columns == before[1]).all():
            return rows, columns


def near_duplicates(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, recall: float = RECALL
) -> DataFrame:
    """(key, n_links, component_id, kept) for every row: vectors of equal labels with a cosine of at least ``cosine`` are linked.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest key reachable, the row's own
    included, ``kept`` marks the row of that key. Equal vectors are put together first and count as often as they
    occur, so copies cost nothing. Vectors of different lengths never link; each length has its links, with one index for all lengths between
    two powers of two (the shorter filled up with zeros). Null or zero vectors, those with null or non-finite components, and
    rows with a null label link with nothing. Null keys take part in links and
    counts and are a component id only where there is no other. An empty table gives an empty result; other columns are
    not read.
    """
    rows = table.select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    # A 64-bit hash of label and vector names a distinct vector.
    named = rows.withColumn("ok", usable).withColumn("v", F.when(F.col("ok"), F.transform("v", lambda x: x + F.lit(0.0))))
    good = named.where("ok")
    distinct = good.groupBy("label", "v").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("copies"))
    distinct = distinct.withColumn("id", F.xxhash64("label", "v"))
    whole = cut_lineage(distinct.withColumn("family", F.ceil(F.log2(F.size("v"))).cast("int")))
    alone = F.col("copies") - 1
    counts = edges = None
    # At most 32 families of lengths, one in almost every table.
    for family in whole.groupBy("family").agg(F.max(F.size("v")).alias("width")).orderBy("family").collect():
        filled = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(family["width"]) - F.size("v")))
        # A label and a length together: rows of another length are those of another label.
        fitting = whole.where(F.col("family") == family["family"]).select("id", F.xxhash64("label", F.size("v")).alias("label"), filled.alias("v"), "copies")
        index = fit(fitting, cosine, recall)
        found = links(fitting, index, cosine)
        counts, edges = found if counts is None else (counts.union(found[0]), edges.union(found[1]))
    if counts is None:
        classes = whole.select("id", "copies", "low", alone.alias("n_links"), F.col("low").alias("component_id"))
    else:
        counts, roots = cut_lineage(counts), connected_components(edges)
        joined = whole.join(counts, "id", "left").join(roots, whole["id"] == roots["node"], "left")
        rooted = joined.select("id", "low", (alone + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("root"))
        lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
        classes = rooted.join(lows, "root").select("id", "n_links", "component_id")
    linked = good.select("key", F.xxhash64("label", "v").alias("id")).join(classes.select("id", "n_links", "component_id"), "id")
    lonely = named.where(~F.col("ok")).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    result = linked.select("key", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(lonely)
    return result.withColumn("kept", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False))).withColumnRenamed("key", key)
