"""Which 64-bit keys occur more than once in a corpus, without a row for each key.

Texts are dealt to blocks of bounded size by a hash. Each block sends its distinct keys, sorted, as one packed value for each
range of keys (a bucket); a bucket counts them over all blocks and sends back one byte for each key, in the order in which it
got them. A block derives the same keys in the same order again and so needs no keys back. A key that one block holds many
times is sent once, with its count, so that groups of copies do not meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm._bytes import planes, unplanes

BLOCK_BYTES = 2 << 20
#: Set in a code where the block is the first of those that hold the key.
FIRST = 0x80
CODES = "block int, phase int, bucket int, codes binary"


def blocked(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(block, id, body): all rows, dealt by a hash of id and text to blocks of about block_bytes; and the number of blocks."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = int(max(16, -(-total // block_bytes)))
    block = F.pmod(F.xxhash64(id_col, text_col), F.lit(n)).cast("int")
    return docs.select(block.alias("block"), F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("body")), n


def in_order(table: pa.Table) -> pa.Table:
    """The rows of a block in an order that does not depend on how they arrived."""
    return table.sort_by([("id", "ascending"), ("body", "ascending")]) if table.num_rows > 1 else table


def emit(keys: np.ndarray, block: int, phase: int, n_buckets: int) -> pa.Table:
    """Rows (bucket, block, phase, keys, counts) for the distinct keys, one row a bucket that gets any."""
    u, counts = np.unique(keys, return_counts=True)
    edge = np.searchsorted(_bucket(u, n_buckets), np.arange(n_buckets + 1))
    few = np.minimum(counts, 255).astype(np.uint8)
    at = np.flatnonzero(edge[1:] > edge[:-1])
    return pa.table({
        "bucket": pa.array(at, pa.int32()), "block": pa.array(np.full(len(at), block), pa.int32()), "phase": pa.array(np.full(len(at), phase), pa.int32()),
        "keys": pa.array([planes(u[edge[i] : edge[i + 1]]) for i in at], pa.binary()), "counts": pa.array([few[edge[i] : edge[i + 1]].tobytes() for i in at], pa.binary()),
    })


def _bucket(u: np.ndarray, n: int) -> np.ndarray:
    """Ranges of equal width; rises with the key."""
    return ((u >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def counted(sent: DataFrame) -> DataFrame:
    """CODES: for each value of emit() a byte a key, the bit length of the key's count over all blocks (1: it is unique), and FIRST."""

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        parts = [unplanes(x) for x in table["keys"].to_pylist()]
        keys = np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        first = np.append(True, ranked[1:] != ranked[:-1])
        each = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint8).astype(np.int64)
        total = np.add.reduceat(each[order], np.flatnonzero(first))
        code = np.frexp(total.astype(np.float64))[1].astype(np.uint8)
        out = np.empty(len(keys), np.uint8)
        out[order] = code[np.cumsum(first) - 1] | first * np.uint8(FIRST)
        cut = np.cumsum([len(p) for p in parts])[:-1]
        return pa.table({"block": table["block"], "phase": table["phase"], "bucket": table["bucket"], "codes": pa.array([x.tobytes() for x in np.split(out, cut)], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(count, CODES)


SENT = "bucket int, block int, phase int, keys binary, counts binary"


def buckets(n_blocks: int) -> int:
    """Buckets for so many blocks."""
    return max(16, n_blocks // 4)


def codes_of(table: pa.Table, phase: int, keys: np.ndarray) -> np.ndarray:
    """For each of keys (any order, repeats allowed) its code, without FIRST, out of what counted() sent back to this block."""
    return marks_of(table, phase, keys) & ~np.uint8(FIRST)


def marks_of(table: pa.Table, phase: int, keys: np.ndarray) -> np.ndarray:
    """As codes_of(), with FIRST."""
    u, inverse = np.unique(keys, return_inverse=True)
    rows = sorted((b, c) for p, b, c in zip(table["phase"].to_pylist(), table["bucket"].to_pylist(), table["codes"].to_pylist(), strict=True) if p == phase)
    code = np.frombuffer(b"".join(c for _, c in rows), np.uint8)
    if len(code) != len(u):
        raise ValueError("a block's keys differ from those that it sent")
    return code[inverse]


def with_codes(blocks: DataFrame, codes: DataFrame, use: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """use(rows of a block, its codes) for each block that has rows."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return use(in_order(left), right)

    return blocks.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(both, schema)
