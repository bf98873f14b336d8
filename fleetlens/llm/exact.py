"""Exact duplicates by composable polynomial fingerprints and a chunkwise comparison (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm._bytes import texts
from fleetlens.llm._scratch import stored

#: Primes below 2**31 and a base of each: fixed values, any others serve as well.
PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.int64)
BASES = np.array([1103515245, 1812433253, 1664525003, 1566083941], np.int64)
WIDTH = 256
CHUNK_BYTES = 1 << 16
SPREAD_BYTES = 1 << 20
FILTER_SLOTS = 1 << 20
GROUP_BYTES = 1 << 20


def _power(exponent: np.ndarray, lanes: int) -> np.ndarray:
    """BASES to each exponent modulo PRIMES, as (exponents, lanes)."""
    p, square = PRIMES[:lanes], BASES[:lanes].copy()
    left, out = np.asarray(exponent, np.int64).copy(), np.ones((len(exponent), lanes), np.int64)
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] = out[odd] * square % p
        square = square * square % p
        left >>= 1
    return out


def combine(left: np.ndarray, right: np.ndarray, right_bytes: np.ndarray) -> np.ndarray:
    """Fingerprints of texts put together out of those of their parts: the left one is shifted by the right one's length."""
    lanes = left.shape[1]
    return (left * _power(right_bytes, lanes) + right) % PRIMES[:lanes]


def chunk_hashes(data: np.ndarray, off: np.ndarray, lanes: int = len(PRIMES)) -> np.ndarray:
    """For each value the sum of (byte + 1) times its base to the number of bytes behind it, modulo each prime.

    Values are laid out in lines of WIDTH bytes, with zeros before the first byte. A line is one exact product of floating point
    numbers (8 by 31 bits, summed over 256, stay below 2**53); lines of a value are put together as chunks are.
    """
    size = np.diff(off)
    lines = -(-size // WIDTH)
    last = np.cumsum(lines)
    grid = np.zeros(int(last[-1]) * WIDTH if len(last) else 0, np.float32)
    if len(data):
        shift = np.repeat(last * WIDTH - off[1:], size)
        grid[np.arange(len(data)) + shift] = data.astype(np.float32) + 1
    p = PRIMES[:lanes]
    weight = _power(np.arange(WIDTH - 1, -1, -1), lanes).astype(np.float64)
    line = (grid.reshape(-1, WIDTH).astype(np.float64) @ weight).astype(np.int64) % p
    behind = np.repeat(last, lines) - 1 - np.arange(len(line))
    step = _power(np.array([WIDTH]), lanes)[0]
    moved = line * _steps(behind, step, p) % p
    out = np.zeros((len(size), lanes), np.int64)
    full = np.flatnonzero(lines)
    if len(full):
        out[full] = np.add.reduceat(moved, (last - lines)[full], axis=0) % p
    return out


def _steps(k: np.ndarray, step: np.ndarray, p: np.ndarray) -> np.ndarray:
    """step to the power of each of k."""
    table = np.ones((int(k.max()) + 1 if len(k) else 1, len(p)), np.int64)
    for i in range(1, len(table)):
        table[i] = table[i - 1] * step % p
    return table[k]


def _fingerprints(column, chunk_bytes: int, lanes: int) -> np.ndarray:
    """Of each value of a column: its chunks' hashes, put together."""
    data, off = texts(column)
    size = np.diff(off)
    out = np.zeros((len(size), lanes), np.int64)
    long = size > chunk_bytes
    group = np.cumsum(np.where(long, 0, size)) // GROUP_BYTES
    edge = np.append(0, np.flatnonzero((group[1:] != group[:-1]) | long[1:] | long[:-1]) + 1) if len(size) else []
    for a, b in zip(edge, [*edge[1:], len(size)], strict=True):
        if long[a]:
            for at in range(int(off[a]), int(off[b]), chunk_bytes):
                part = data[at : min(at + chunk_bytes, int(off[b]))]
                out[a] = combine(out[a : a + 1], chunk_hashes(part, np.array([0, len(part)]), lanes), np.array([len(part)]))[0]
        else:
            out[a:b] = chunk_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a], lanes)
    return out


def _packed(prints: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in prints.astype(">u4")], pa.binary())


def fingerprinted(texts_: DataFrame, chunk_bytes: int, lanes: int) -> DataFrame:
    """The rows with a column print: the fingerprint of body (binary), 16 bytes with four lanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            yield from table.append_column("print", _packed(_fingerprints(table["body"], chunk_bytes, lanes))).to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts_.schema)
    return texts_.mapInArrow(run, f"{schema}, print binary")


def _pieces(chunk_bytes: int):
    """Chunks of body, as an array of (no, body); an empty one has one chunk."""
    last = F.floor((F.greatest(F.octet_length("body"), F.lit(1)) - 1) / chunk_bytes)
    return F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.struct(i.alias("no"), F.substring("body", i * chunk_bytes + 1, F.lit(chunk_bytes)).alias("body")))


def _spread(long: DataFrame, chunk_bytes: int, lanes: int) -> DataFrame:
    """(id, n_bytes, sha, print) of long texts, whose chunks are hashed by many tasks.

    The chunks are written first, so that a text's number is the same whenever they are read.
    """
    numbered = long.withColumn("row", F.monotonically_increasing_id())
    chunks = stored(numbered.select("id", "row", F.octet_length("body").alias("n_bytes"), F.sha2("body", 256).alias("sha"), F.explode(_pieces(chunk_bytes)).alias("chunk")).select("id", "row", "n_bytes", "sha", "chunk.*"), "chunks")
    hashed = fingerprinted(chunks.repartition("row", "no"), chunk_bytes, lanes).drop("body")

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        n, out = table["n_bytes"][0].as_py(), np.zeros((1, lanes), np.int64)
        behind = np.maximum(n - (table["no"].to_numpy().astype(np.int64) + 1) * chunk_bytes, 0)
        each = np.frombuffer(b"".join(table["print"].to_pylist()), ">u4").reshape(-1, lanes).astype(np.int64)
        out = (each * _power(behind, lanes) % PRIMES[:lanes]).sum(axis=0, keepdims=True) % PRIMES[:lanes]
        return table.slice(0, 1).select(["id", "n_bytes", "sha"]).append_column("print", _packed(out))

    kind = long.schema["id"].dataType.simpleString()
    return hashed.groupBy("row").applyInArrow(fold, f"id {kind}, n_bytes int, sha string, print binary")


def _same(sizes: DataFrame, body: DataFrame, chunk_bytes: int, lanes: int, slots: int) -> DataFrame:
    """(n_bytes, print) of classes that hold different texts; texts of classes of one row are mostly not looked at.

    Texts of classes of several rows meet chunk by chunk: a chunk's bytes are part of the key of a distinct, so equal ones are
    one row in each task before they are shuffled, and a class is of one text if each chunk number is left with one row. What
    selects the texts is a table of slots of the fingerprints' hashes, at most so many rows, so it can be broadcast at any size
    of the corpus; a text that shares its slot by chance is compared for nothing.
    """
    slot = F.pmod(F.xxhash64("n_bytes", "print"), F.lit(slots))
    several = sizes.groupBy("n_bytes", "print").agg(F.sum("n").alias("n")).where("n > 1").select(slot.alias("slot")).distinct()
    read = fingerprinted(body.select("body", F.octet_length("body").alias("n_bytes")), chunk_bytes, lanes)
    chosen = read.withColumn("slot", slot).join(F.broadcast(several), "slot", "left_semi")  # at most `slots` numbers
    distinct = chosen.select("n_bytes", "print", F.explode(_pieces(chunk_bytes)).alias("chunk")).select("n_bytes", "print", "chunk.*").distinct()
    return distinct.groupBy("n_bytes", "print", "no").agg(F.count("*").alias("c")).where("c > 1").select("n_bytes", "print").distinct()


def exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, spread_bytes: int = SPREAD_BYTES, lanes: int = len(PRIMES), slots: int = FILTER_SLOTS
) -> DataFrame:
    """A row (id_col, keep_id, group_size, kept, text_sha256, n_bytes, print) for each row of docs: its group of equal texts.

    Texts are equal when all their bytes are. Of a group the row with the largest id stays, keep_id. Null text is empty text. A
    null id comes before all others: its row stays only if no row of the group has an id, and keep_id is null then. Of rows that
    share that id one stays (they are alike in all columns of the result). Empty texts are equal to each other. An empty table
    gives an empty result. Other columns of docs are not looked at, whatever their names.

    Method. A text's fingerprint is a polynomial in each of `lanes` primes, computed chunk by chunk; chunks of texts over
    spread_bytes are hashed by many tasks and put together by their lengths. Rows with equal length and fingerprint are a class.
    Texts of classes of several rows are then compared chunk by chunk (see _same()). A class that turns out to hold different
    texts, which is all but impossible with four lanes, is grouped by the texts' bytes. Copies are combined before each shuffle
    but for the last one, where rows are told their groups of several: the groups are written first, so both sides of that join
    are plain shuffles and Spark can split what a large group brings to one task.
    """
    body = docs.select(F.col(id_col).alias("id"), F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b"")).alias("body"))
    long = F.octet_length("body") > spread_bytes
    here = fingerprinted(body.where(~long).withColumns({"n_bytes": F.octet_length("body"), "sha": F.sha2("body", 256)}), chunk_bytes, lanes).drop("body")
    there = _spread(body.where(long), chunk_bytes, lanes)
    known = stored(here.unionByName(there), "prints")
    sizes = known.groupBy("n_bytes", "print", "id", "sha").agg(F.count("*").alias("n"))
    mixed = stored(_same(known.groupBy("n_bytes", "print").agg(F.count("*").alias("n")), body, chunk_bytes, lanes, slots), "mixed")
    if mixed.isEmpty():
        key = ["n_bytes", "print"]
        rows = sizes
    else:  # classes of several texts: the text itself is the key there
        key = ["n_bytes", "print", "text"]
        read = fingerprinted(body.select("id", "body", F.octet_length("body").alias("n_bytes")), chunk_bytes, lanes)
        apart = read.join(mixed, ["n_bytes", "print"], "left_semi").groupBy("n_bytes", "print", "id", F.col("body").alias("text")).agg(F.count("*").alias("n")).withColumn("sha", F.sha2("text", 256))
        rows = sizes.join(mixed, ["n_bytes", "print"], "left_anti").withColumn("text", F.lit(b"")).unionByName(apart)
    groups = rows.groupBy(*key).agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size")).where("group_size > 1")
    groups = stored(groups.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("keep_id").alias("_keep"), "group_size"), "groups")
    told = rows.join(groups, [F.col(k) == F.col(f"_{k}") for k in key], "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    told = told.withColumns({"keep_id": F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("_keep")), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)
    return told.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"), "n_bytes", "print")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows equal in id and text the least by its other columns as JSON."""
    stay = exact_copies(docs, id_col, text_col, **options).where("kept").select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha"))
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    digest = F.sha2(F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b"")), 256)
    row = F.struct(F.lit(0).alias("c"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), digest.alias("_sha"), row.alias("_row"))
    here = marked.join(stay, marked["_id"].eqNullSafe(stay["_id"]) & (marked["_sha"] == stay["_sha"]), "left_semi")
    least = here.groupBy("_id", "_sha").agg(F.min_by(F.struct("_text", "_row"), F.to_json("_row")).alias("_least"))
    value = {id_col: F.col("_id"), text_col: F.col("_least._text")} | {c: F.col(f"_least._row.c{i}") for i, c in enumerate(others)}
    return least.select(*(value[c].alias(c) for c in docs.columns))


def exact_copies_digest(docs: DataFrame) -> DataFrame:
    return exact_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
