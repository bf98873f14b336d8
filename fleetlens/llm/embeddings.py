"""Near-duplicate vectors by randomised-rotation binary codes with correction factors (operator 1)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm._components import components
from fleetlens.llm._scratch import stored

#: Aimed at rows of a cell, and most rows of one side of a tile.
CELL_ROWS, TILE_ROWS = 512, 1024
_OPEN = ["label", "width", "band", "cell", "low", "high", "part", "node", "code"]


def rotation(dim: int, number: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated vectors, signs, correction factors): a factor is the inner product of a rotated unit vector with its code."""
    rotated = unit @ rotation(unit.shape[1], 0, seed).T
    signs = np.where(rotated >= 0, 1.0, -1.0)
    return rotated, signs, np.abs(rotated).sum(axis=1) / math.sqrt(unit.shape[1])


def estimate(rotated: np.ndarray, signs: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of all rotated rows with the rows that signs and factor stand for."""
    return rotated @ (signs / (math.sqrt(signs.shape[1]) * factor[:, None])).T


def packed_codes(unit: np.ndarray, seed: int) -> list[bytes]:
    """What is stored of each vector: a byte a dimension, with the sign and 127 levels of its rotated coordinate, and three
    numbers: the levels' unit, the correction factor, and the most that an estimate can be off by the levels, times the other's factor.
    """
    rotated, signs, factor = encode(unit, seed)
    scale = np.abs(rotated).max(axis=1) / 127
    codes = (signs * np.maximum(1, np.rint(np.abs(rotated) / scale[:, None]))).astype(np.int8)
    off = np.abs(rotated - codes * scale[:, None]).sum(axis=1) / math.sqrt(unit.shape[1])
    return [c.tobytes() + f.tobytes() for c, f in zip(codes, np.stack([scale, factor, off], axis=1), strict=True)]


def open_pairs(code: list[bytes], left: np.ndarray, right: np.ndarray, threshold: float, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, one of left and one of right, that the bounds of their estimates do not exclude."""
    raw = np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1)
    codes, numbers = raw[:, :-24].view(np.int8).astype(np.float64), np.ascontiguousarray(raw[:, -24:]).view(np.float64)
    scale, factor, off = numbers.T
    signs = np.where(codes >= 0, 1.0, -1.0)
    upper = estimate(codes[left] * scale[left, None], signs[right], factor[right]) + off[left, None] / factor[right]
    a, b = np.nonzero(upper >= least_estimate(factor[right], codes.shape[1], threshold, epsilon) - 1e-9)
    return left[a], right[b]


def least_estimate(factor: np.ndarray, dim: int, threshold: float, epsilon: float) -> np.ndarray:
    """A pair at the threshold has an estimate of this at least.

    With inner product c the estimate is c + sqrt(1 - c * c) * sqrt(1 - f * f) / f * t, where t is the product of two unit
    vectors of dim - 1 dimensions that a random rotation makes independent: |t| <= epsilon / sqrt(dim - 1) with a confidence
    that grows as 1 - 2 exp(-epsilon**2 / 2), and |t| <= 1 for certain. Above the threshold the lower end only rises.
    """
    t = min(1.0, epsilon / math.sqrt(max(1, dim - 1)))
    return threshold - math.sqrt(1 - threshold * threshold) * np.sqrt(np.maximum(0, 1 - factor * factor)) / factor * t - 1e-9


def plan(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits a band, bands) for a label of n vectors: cells of about CELL_ROWS, and a pair at the threshold missed by all bands with a probability of miss."""
    bits = max(0, math.ceil(math.log2(max(1, n) / CELL_ROWS)))
    if bits == 0:
        return 0, 1
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of nodes 0 to n - 1 thinned to one link from each node to the least of its component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        new = np.minimum(new, new[root])
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, epsilon: float = 8.0, miss: float = 1e-9, seed: int = 7) -> DataFrame:
    """(id, n_links, component_id, kept) for each row: links within a label at a cosine of threshold or more.

    Cosines that decide are of double precision. n_links counts the other vectors linked directly, component_id is the
    smallest id reachable by links, itself included, and kept tells whether that is the row's own id.

    Method. Equal vectors of a label are one weighted row. Each is encoded once: a byte for each dimension of its randomly rotated
    unit vector, the sign of which is its binary code, and three numbers, of which one is the correction factor. A label's
    rows are dealt to cells by the signs of rotated coordinates, in several bands of such signs (plan()), more for larger labels,
    so a cell stays near CELL_ROWS while work grows almost in proportion to the rows. A cell that holds more, as groups of near
    copies make it, is cut into parts of TILE_ROWS and each two parts are a tile, so no task gets an unbounded group. What is
    dealt is codes and factors, not vectors: in a tile they give unbiased estimates of all inner products, and a row whose
    confidence bounds exclude all pairs is done with. Vectors are joined to the others only, and the pairs that the bounds
    leave open are computed exactly. With the default epsilon the bound holds for certain up to 65 dimensions. A pair that meets in
    several bands counts in the first. A tile gives out sums of links and a forest of its links, never pairs.

    Null, empty or zero vectors, vectors with null or non-finite components, and rows with a null label or id link with
    nothing: n_links 0, component_id their own id. Rows that share an id are one vertex for component_id, but each vector has its own n_links. Vectors of different
    length never link. Empty tables give no rows; columns besides the three are not read.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([(np.array(x) + 0.0).tobytes() for x in b.column("v").to_pylist()], pa.binary())], names=["id", "label", "v"])

    packed = stored(base.where(F.coalesce(sound, F.lit(False))).mapInArrow(pack, "id long, label string, v binary"), "vectors")
    nodes = packed.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("weight"))
    sizes = nodes.groupBy("label", F.octet_length("v").alias("width")).agg(F.count("*").alias("n"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")  # numbers hold as they are written once
    placed = nodes.withColumn("width", F.octet_length("v")).join(sizes, ["label", "width"])

    def unit(raw: list[bytes]) -> np.ndarray:
        x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def band_cells(u: np.ndarray, n: int) -> np.ndarray:
        bits, bands = plan(n, threshold, miss)
        dim = u.shape[1]
        turns = [u @ rotation(dim, 1 + i, seed).T >= 0 for i in range(-(-bits * bands // dim))]
        sign = np.concatenate(turns, axis=1)[:, : bits * bands].reshape(len(u), bands, bits) if bits else np.zeros((len(u), 1, 0), bool)
        return (sign.astype(np.int64) << np.arange(bits)).sum(axis=2)

    def deal(batches):
        for b in batches:
            label, width, n = (np.array(b.column(c).to_pylist(), object) for c in ("label", "width", "n"))
            raw = b.column("v").to_pylist()
            for w, m in sorted(set(zip(width, n, strict=True))):
                at = np.flatnonzero((width == w) & (n == m))
                x = unit([raw[i] for i in at])
                cells, coded = band_cells(x, m), pa.array(packed_codes(x, seed), pa.binary())
                rows, own = pa.array(np.repeat(at, cells.shape[1])), pa.array(np.repeat(np.arange(len(at)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([
                    b.column("label").take(rows), b.column("width").take(rows), pa.array(np.tile(np.arange(cells.shape[1], dtype=np.int32), len(at))), pa.array(cells.reshape(-1)),
                    b.column("node").take(rows), coded.take(own),
                ], names=["label", "width", "band", "cell", "node", "code"])

    cells = placed.select("label", "width", "n", "node", "v").mapInArrow(deal, "label string, width int, band int, cell long, node long, code binary")
    key = ["label", "width", "band", "cell"]
    cells = stored(cells, "codes")
    counts = cells.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")
    parts = F.ceil(F.col("rows") / TILE_ROWS).cast("int")
    tiled = cells.join(counts, key).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node", "band"), F.col("parts")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiled = tiled.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))

    def near(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows, one of each part of the tile, that the bounds leave open."""
        part = np.array(table["part"].to_pylist())
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        a, b = open_pairs(table["code"].to_pylist(), np.flatnonzero(part == low), np.flatnonzero(part == high), threshold, epsilon)
        return (a[a < b], b[a < b]) if low == high else (a, b)

    def left_open(table: pa.Table) -> pa.Table:
        rows = np.unique(np.concatenate(near(table)))
        return table.take(pa.array(rows)).select(_OPEN)

    def tile(table: pa.Table) -> pa.Table:
        band, m = table["band"][0].as_py(), table["n"][0].as_py()
        x = unit(table["v"].to_pylist())
        node, weight = np.array(table["node"].to_pylist()), np.array(table["weight"].to_pylist())
        a, b = near(table)
        exact = np.concatenate([[], *(np.einsum("ij,ij->i", x[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536))]) >= threshold
        a, b = a[exact], b[exact]
        own = band_cells(x, m)[:, :band]
        new = np.concatenate([np.zeros(0, bool), *(~(own[a[i : i + 65536]] == own[b[i : i + 65536]]).any(axis=1) for i in range(0, len(a), 65536))])
        a, b = a[new], b[new]
        links = np.bincount(a, weight[b], len(x)) + np.bincount(b, weight[a], len(x))
        i, j = _forest(a, b, len(x))
        full = np.flatnonzero(links)
        return pa.table({
            "a": pa.array(np.concatenate([node[full], node[i]])), "b": pa.array(np.concatenate([node[full], node[j]])),
            "links": pa.array(np.concatenate([links[full].astype(np.int64), np.zeros(len(i), np.int64)])),
        })

    ties = stored(tiled.groupBy(*key, "low", "high").applyInArrow(left_open, "label string, width int, band int, cell long, low int, high int, part int, node long, code binary"), "open-rows")
    exact = ties.join(placed.select("node", "n", "v", "weight"), "node")
    found = stored(exact.groupBy(*key, "low", "high").applyInArrow(tile, "a long, b long, links long"), "tiles")
    degree = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    copies = packed.join(nodes, ["label", "v"]).select("id", "least", "node", "weight")
    own = stored(copies.join(degree, "node", "left").select("id", "least", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.xxhash64("id").alias("h")), "degrees")
    ids = nodes.select("node", "least")
    links = found.where("a <> b").select("a", "b").join(ids.select(F.col("node").alias("a"), F.col("least").alias("i")), "a").join(ids.select(F.col("node").alias("b"), F.col("least").alias("j")), "b")
    joined = components(links.select(F.col("i").alias("a"), F.col("j").alias("b")).unionByName(own.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))))
    linked = own.select("id", "n_links").unionByName(base.where(~F.coalesce(sound, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links")))
    out = linked.join(joined, linked["id"] == joined["node"], "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as norm from v),
p as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r(node, component) as (select vec_id, vec_id from embeddings union select p.b, r.component from r join p on p.a = r.node),
c as (select node, min(component) as component_id from r group by 1),
d as (select a, count(*) as n from p group by 1)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from embeddings left join c on c.node = vec_id left join d on d.a = vec_id
"""
