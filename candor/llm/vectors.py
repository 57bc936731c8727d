"""Embedding near duplicates by product quantisation: inverted lists, residual codes, table-lookup distances, exact rerank.

Unit vectors go to the nearest of the coarse centroids, what remains of them to the nearest centroid of the next level,
and so on: each level multiplies the lists by up to `fan`, and there are as many levels as give `per_list` vectors a
list, however large the table. What remains at last is coded by one centroid in each subspace. A vector looks into its
own list and into every later list whose bisecting planes with its own are near enough that a partner could lie behind
them (`reach` standard deviations of a step of the threshold's length in a random direction): that many probes are
sufficient, be they few or many. In a list, distances to the codes are sums of table entries; by the triangle
inequality a partner's is at most the threshold's distance plus the error of its own code, so this filter loses
nothing. The pairs left are compared by exact cosine in double precision.

Centroids are fitted on about `sample_rows` vectors of a length, chosen by hash (the documented bound); every vector is
indexed. Vectors of a length with fewer than `few` of them are one list and all compared. Equal vectors are one class
and are searched once; a class has a number of its own, whatever ids its rows have. A list with many vectors or many
queries is dealt out in blocks, so that no task grows with a hot list; a block gives counts and a spanning forest of
its links, never all its pairs.

Null vectors, zero ones, empty ones, and ones with null or non-finite components link with nothing, nor do vectors of
different lengths with each other. Repeated ids are rows of their own; a null id is the smallest of its component only
if all are null. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candor.llm.common import met, saved, share
from candor.llm.components import components

BLOCK, QUERIES = 2048, 4096


def _means(points: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centroids by Lloyd's rounds; an empty one stays where it is."""
    centers = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmin((centers**2).sum(1) - 2 * points[a : a + 4096] @ centers.T, axis=1) for a in range(0, len(points), 4096)])
        sizes = np.bincount(own, minlength=len(centers))
        order = np.argsort(own, kind="stable")
        used = np.flatnonzero(sizes)
        centers[used] = np.add.reduceat(points[order], (np.cumsum(sizes) - sizes)[used], axis=0) / sizes[used, None]
    return centers


class Level:
    """The centroids of one level, and twice the distances between them."""

    def __init__(self, centers: np.ndarray):
        self.centers, self.norms = centers, (centers**2).sum(1)
        self.apart = 2 * np.sqrt(np.maximum(self.norms[:, None] + self.norms[None] - 2 * centers @ centers.T, 0))

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids, less what is the same for all."""
        return self.norms - 2 * points @ self.centers.T


class Quantiser:
    """Levels of coarse centroids, and codes of what remains in subspaces of about four dimensions."""

    def __init__(self, sample: np.ndarray, sizes: list[int], codes: int = 64, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.levels, rest = [], sample
        for size in sizes:
            level = Level(_means(rest, size, 6, rng))
            self.levels.append(level)
            own = np.concatenate([level.distances(rest[a : a + 4096]).argmin(axis=1) for a in range(0, len(rest), 4096)])
            rest = rest - level.centers[own]
        self.cuts = np.array_split(np.arange(sample.shape[1]), max(1, sample.shape[1] // 4))
        self.codes = [_means(rest[:, c], codes, 6, rng) for c in self.cuts]

    def place(self, points: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each point's own list, and (point, list) pairs of the later lists that it must look into."""
        row, rest, lists = np.arange(len(points)), points, np.zeros(len(points), np.int64)
        home = np.ones(len(points), bool)  # whether this path is the point's own so far
        for level in self.levels:
            parts = []
            for a in range(0, len(row), 4096):
                d = level.distances(rest[a : a + 4096])
                best = d.argmin(axis=1)
                near = (d - d[np.arange(len(d)), best][:, None]) <= slack * level.apart[best]
                near[np.arange(len(d)), best] = True
                i, c = np.nonzero(near)
                parts.append((row[a + i], rest[a + i] - level.centers[c], lists[a + i] * len(level.centers) + c, home[a + i] & (c == best[i])))
            row, rest, lists, home = (np.concatenate(x) for x in zip(*parts, strict=True))
        own = np.empty(len(points), np.int64)
        own[row[home]] = lists[home]
        later = lists > own[row]
        return own, row[later], lists[later]

    def center(self, number: int) -> np.ndarray:
        total = 0.0
        for level in reversed(self.levels):
            number, c = divmod(number, len(level.centers))
            total = total + level.centers[c]
        return total

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and the length of what they miss."""
        found, miss = [], np.zeros(len(rest))
        for cut, centers in zip(self.cuts, self.codes, strict=True):
            d = (centers**2).sum(1) - 2 * rest[:, cut] @ centers.T
            best = d.argmin(axis=1)
            found.append(best)
            miss += np.maximum(d[np.arange(len(rest)), best] + (rest[:, cut] ** 2).sum(1), 0)
        return np.stack(found, 1).astype(np.uint8), np.sqrt(miss)

    def lookups(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances from residuals (rows) to codes (columns), summed from each row's tables."""
        total = np.zeros((len(rest), len(codes)), np.float32)
        for s, (cut, centers) in enumerate(zip(self.cuts, self.codes, strict=True)):
            table = ((rest[:, None, cut] - centers[None]) ** 2).sum(2).astype(np.float32)
            total += table[:, codes[:, s]]
        return total


def level_sizes(lists: int, fan: int) -> list[int]:
    """Level sizes of at most `fan` whose product is about the number of lists."""
    levels = 1
    while fan**levels < lists:
        levels += 1
    return [max(1, round(lists ** (1 / levels)))] * levels


def _scaled(vectors: list) -> np.ndarray:
    """Rows times a power of two each, which is exact, so that no square overflows or vanishes."""
    points = np.array(vectors, np.float64)
    _, exponent = np.frexp(np.abs(points).max(axis=1))
    return np.ldexp(points, -exponent[:, None])


def _units(vectors: list) -> np.ndarray:
    points = _scaled(vectors)
    return points / np.sqrt((points**2).sum(1, keepdims=True))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node each node reaches over the pairs."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def quantisers(reps: DataFrame, sample_rows: int, per_list: int, fan: int, few: int) -> dict[int, Quantiser]:
    """A quantiser for each length of vectors that occurs in `few` classes or more."""
    sizes = {r.d: r["count"] for r in reps.groupBy(F.size("embedding").alias("d")).count().where(F.col("count") >= few).collect()}
    made = {}
    for d, total in sizes.items():
        sample = reps.where((F.size("embedding") == d) & share(total, sample_rows, "rep")).select("embedding").toPandas()
        made[d] = Quantiser(_units(sample["embedding"].tolist()), level_sizes(max(1, total // per_list), fan))
    return made


def links(reps: DataFrame, least: float = 0.95, sample_rows: int = 16_384, per_list: int = 64, fan: int = 1024, few: int = 512, reach: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(rep long, n long, embedding) of different vectors to (rep, links: weighted number of partners) and edges (a, b)."""
    session = reps.sparkSession
    model = session.sparkContext.broadcast(quantisers(reps, sample_rows, per_list, fan, few))
    radius = float(np.sqrt(2 - 2 * least))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                vectors = part.column(2).to_pylist()
                lengths = np.array([len(v) for v in vectors])
                own, probes = np.zeros(len(vectors), np.int64), [[] for _ in vectors]
                for d in np.unique(lengths):
                    q = model.value.get(int(d))
                    if q is None:
                        continue
                    at = np.flatnonzero(lengths == d)
                    own[at], rows, lists = q.place(_units([vectors[i] for i in at]), radius * min(1.0, reach / np.sqrt(d)))
                    for i, c in zip(at[rows].tolist(), lists.tolist(), strict=True):
                        probes[i].append(c)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(lengths.astype(np.int32)), pa.array(own), pa.array(probes, pa.list_(pa.int64()))], ["rep", "n", "embedding", "d", "own", "probes"])

    kind = reps.schema["embedding"].dataType.simpleString()
    placed = saved(reps.select("rep", "n", "embedding").mapInArrow(assign, f"rep long, n long, embedding {kind}, d int, own long, probes array<long>"))
    held = placed.groupBy("d", F.col("own").alias("list")).agg(F.count("*").alias("base"))
    asked = placed.select("d", F.explode(F.concat(F.array("own"), "probes")).alias("list")).groupBy("d", "list").agg(F.count("*").alias("asked"))
    large = held.join(asked, ["d", "list"]).where((F.col("base") > BLOCK) | (F.col("asked") > QUERIES))
    large = saved(large.select(F.col("d").alias("of_d"), F.col("list").alias("of_list"), F.ceil(F.col("base") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("asked") / QUERIES).cast("int").alias("nq")))
    blocks = (F.col("d") == F.col("of_d")) & (F.col("list") == F.col("of_list"))
    nb, nq = F.coalesce("nb", F.lit(1)), F.coalesce("nq", F.lit(1))
    base = placed.select("d", F.col("own").alias("list"), "rep", "n", "embedding").join(large, blocks, "left").select(
        "d", "list", F.pmod(F.xxhash64("rep"), nb).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), nq - 1)).alias("q"), F.lit(0).alias("role"), "rep", "n", "embedding"
    )
    asks = placed.select("d", F.explode(F.concat(F.array("own"), "probes")).alias("list"), "own", "rep", "n", "embedding").join(large, blocks, "left")
    query = asks.select(
        "d", "list", F.explode(F.sequence(F.lit(0), nb - 1)).alias("b"), F.pmod(F.xxhash64("rep"), nq).cast("int").alias("q"), F.when(F.col("list") == F.col("own"), 1).otherwise(2).alias("role"), "rep", "n", "embedding"
    )

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        mine, asking = block[block["role"] == 0], block[block["role"] > 0]
        empty = pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
        if mine.empty or asking.empty:
            return empty
        q = model.value.get(int(block["d"].iloc[0]))
        raw_b, raw_q = _scaled(mine["embedding"].tolist()), _scaled(asking["embedding"].tolist())
        norm_b, norm_q = np.sqrt((raw_b**2).sum(1)), np.sqrt((raw_q**2).sum(1))
        if q:
            center = q.center(int(block["list"].iloc[0]))
            codes, miss = q.encode(raw_b / norm_b[:, None] - center)
            bound = ((radius + miss + 1e-4) ** 2).astype(np.float32)
        ids_b, ids_q, own = mine["rep"].to_numpy(), asking["rep"].to_numpy(), asking["role"].to_numpy() == 1
        left, right = [], []
        for a in range(0, len(asking), 256):
            near = q.lookups(raw_q[a : a + 256] / norm_q[a : a + 256, None] - center, codes) <= bound if q else np.ones((len(raw_q[a : a + 256]), len(raw_b)), bool)
            near &= ~own[a : a + 256, None] | (ids_q[a : a + 256, None] < ids_b[None])
            i, j = np.nonzero(near)
            i += a
            keep = np.concatenate([(raw_q[i[s : s + 65536]] * raw_b[j[s : s + 65536]]).sum(1) / (norm_q[i[s : s + 65536]] * norm_b[j[s : s + 65536]]) >= least for s in range(0, len(i), 65536)] or [np.zeros(0, bool)])
            left.append(i[keep])
            right.append(j[keep])
        i, j = np.concatenate(left), np.concatenate(right)
        if not len(i):
            return empty
        nodes, at = np.unique(np.concatenate([ids_q[i], ids_b[j]]), return_inverse=True)
        weights = np.concatenate([mine["n"].to_numpy()[j], asking["n"].to_numpy()[i]])
        count = np.bincount(at, weights, minlength=len(nodes)).astype("int64")
        return pd.DataFrame({"rep": nodes, "links": count, "root": nodes[_forest(at[: len(i)], at[len(i) :], len(nodes))]})

    found = saved(base.unionByName(query).groupBy("d", "list", "b", "q").applyInPandas(compare, "rep long, links long, root long"))
    return found.groupBy("rep").agg(F.sum("links").alias("links")), found.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct()


def near_duplicates(table: DataFrame, least: float = 0.95, **index) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector; `index` goes to `links`."""
    given = table.select("vec_id", "embedding")
    if not isinstance(table.schema["embedding"].dataType.elementType, (T.FloatType, T.DoubleType)):
        given = given.withColumn("embedding", F.col("embedding").cast("array<double>"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.coalesce(F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good, rest = given.where(fine), given.where(~fine)
    classes = saved(good.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("rep", F.monotonically_increasing_id()))
    total = classes.agg(F.sum("n")).first()[0] or 0
    counts, edges = links(classes, least, **index)
    tree = components(edges)
    facts = classes.join(counts.withColumnRenamed("rep", "counted"), F.col("rep") == F.col("counted"), "left").join(tree, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep"))
    roots = facts.groupBy(F.col("root").alias("of_root")).agg(F.min("least").alias("component_id"))
    facts = saved(facts.join(roots, F.col("root") == F.col("of_root")).select(F.col("embedding").alias("same"), "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "component_id"))
    named = met(good, facts, "embedding", "same", "n", total).select("vec_id", "n_links", "component_id")
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
