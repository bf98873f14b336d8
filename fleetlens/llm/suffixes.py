"""Removal of long repeated byte strings: a difference-cover sample, and suffixes sorted one bucket at a time (operator 4)."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm._blocks import BLOCK_BYTES, FIRST, SENT, blocked, buckets, codes_of, counted, emit, in_order, marks_of, with_codes
from fleetlens.llm._bytes import Rolling, mix, texts
from fleetlens.llm._scratch import stored

#: Perfect difference sets, so any difference modulo v is that of two members (v = q * q + q + 1 for q of 2, 4, 8, 11; 1 is all positions).
COVERS = {
    1: (0,),
    7: (0, 1, 3),
    21: (0, 1, 4, 14, 16),
    73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
}

#: Bytes of the strings of which the least hash is a suffix's anchor.
GRAM = 16


def is_cover(v: int, members: tuple[int, ...]) -> bool:
    return {(a - b) % v for a in members for b in members} == set(range(v))


@functools.cache
def meeting(v: int) -> np.ndarray:
    """For two residues the least distance at which both are in the cover."""
    member = np.zeros(v, bool)
    member[list(COVERS[v])] = True
    out = np.full((v, v), -1, np.int64)
    for d in range(v - 1, -1, -1):
        there = np.flatnonzero(np.roll(member, -d))
        out[np.ix_(there, there)] = d
    return out


def _leading(data: np.ndarray) -> np.ndarray:
    """Of each position the eight bytes from there as one number in the order of bytes; zeros follow the end."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data) + 1, np.uint64)
    for i in range(8):
        out |= wide[i : i + len(out)] << np.uint64(56 - 8 * i)
    return out


def _eight(leading: np.ndarray, at: np.ndarray, left: np.ndarray | int) -> np.ndarray:
    """The eight bytes from each place, or as many as are left (at least one)."""
    return leading[at] >> (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64) if isinstance(left, np.ndarray) else np.uint64(64 - 8 * min(left, 8)))


def _refined(order: np.ndarray, head: np.ndarray, some: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """order and head (where groups begin) when the groups at places `some` of the order are sorted by key each."""
    group = np.cumsum(head)[some]
    by = np.lexsort((key, group))
    order, head = order.copy(), head.copy()
    order[some] = order[some][by]
    key = key[by]
    head[some] |= np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))[: len(some)]
    return order, head


def _open(head: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
    """Places of the order in groups of more than one."""
    alone = head & np.append(head[1:], True)
    return np.flatnonzero(~alone if among is None else ~alone & among)


def prefix_ranks(leading: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each of the suffixes at `at` by its first depth bytes; equal ones tie."""
    order, head = np.arange(len(at)), np.zeros(len(at), bool)
    head[:1] = True
    for k in range(0, depth, 8):
        some = _open(head)
        if not len(some):
            break
        order, head = _refined(order, head, some, _eight(leading, at[order[some]] + k, depth - k))
    rank = np.empty(len(at), np.int64)
    rank[order] = np.cumsum(head)
    return rank


def suffix_classes(data: np.ndarray, off: np.ndarray, residue: np.ndarray, min_bytes: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, classes): where strings of min_bytes start in the slices of one bucket; the class is the rank by those bytes.

    residue is that of each slice's start in its text, modulo v. First the bucket's cover sample is ranked at depth
    min_bytes - v + 1. Then all suffixes are sorted by their eight leading bytes, and what ties, however long, by three-way
    partitions around a pivot: two suffixes are compared by the bytes before the distance at which both are in the cover, by
    the ranks of the sample there, and by the bytes after those that the ranks stand for. Memory is that of the bucket.
    """
    depth, size = min_bytes - v + 1, np.diff(off)
    inside = np.arange(len(data)) - np.repeat(off[:-1], size)
    left = np.repeat(size, size) - inside
    at_residue = (inside + np.repeat(residue, size)) % v
    leading = _leading(data)
    member = np.zeros(v, bool)
    member[list(COVERS[v])] = True
    cover = np.flatnonzero(member[at_residue] & (left >= depth))
    rank = np.zeros(len(data), np.int64)
    rank[cover] = prefix_ranks(leading, cover, depth)
    place = np.flatnonzero(left >= min_bytes)
    distance = meeting(v)

    def compared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair of places that tie in eight bytes."""
        d = distance[at_residue[a], at_residue[b]]
        out, even = np.zeros(len(a), np.int8), np.flatnonzero(a != b)

        def differ(at: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
            nonlocal even
            out[at] = (x > y).astype(np.int8) - (x < y).astype(np.int8)
            even = even[out[even] == 0]

        for k in range(8, v, 8):
            at = even[d[even] > k]
            if not len(at):
                break
            differ(at, _eight(leading, a[at] + k, min_bytes - k), _eight(leading, b[at] + k, min_bytes - k))
        differ(even, rank[a[even] + d[even]], rank[b[even] + d[even]])
        for k in range(0, v - 1, 8):
            skip = d[even] + depth + k
            at, skip = even[skip < min_bytes], skip[skip < min_bytes]
            if not len(at):
                break
            differ(at, _eight(leading, a[at] + skip, min_bytes - skip), _eight(leading, b[at] + skip, min_bytes - skip))
        return out

    order, head = np.arange(len(place)), np.zeros(len(place), bool)
    head[:1] = True
    order, head = _refined(order, head, np.arange(len(place)), _eight(leading, place, min_bytes))
    todo = np.ones(len(place), bool)
    while len(some := _open(head, todo)):
        first = np.flatnonzero(head[some])  # open groups lie side by side
        n = np.diff(np.append(first, len(some)))
        pivot = np.repeat(order[some][first + (mix(first.astype(np.uint64)) % n.astype(np.uint64)).astype(np.int64)], n)
        sign = compared(place[order[some]], place[pivot])
        group = np.repeat(np.arange(len(n)), n)
        todo[some] = sign[np.lexsort((sign, group))] != 0
        order, head = _refined(order, head, some, sign)
    kind = np.empty(len(place), np.int64)
    kind[order] = np.cumsum(head) - 1
    return place, kind


#: A slice: strings of one text that start side by side, tie in the sample and share an anchor. No digest: the whole text repeats.
SLICE = "block int, text int, start long, n int, anchor long, residue int, digest binary, body binary"


#: A part of a slice: strings that start side by side in it, from `at` on, and share a finer key.
PART = "parent binary, at int, digest binary, copies long, n int, key long, residue int, body binary"
_PARTS = pa.schema([("parent", pa.binary()), ("at", pa.int32()), ("digest", pa.binary()), ("copies", pa.int64()), ("n", pa.int32()), ("key", pa.int64()), ("residue", pa.int32()), ("body", pa.binary())])


def window_hashes(table: pa.Table, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the bodies of slices where a string of min_bytes starts, the slice that each is of, and a hash of each string."""
    data, off = texts(table["body"])
    place = np.flatnonzero(np.arange(len(data)) + min_bytes <= np.repeat(off[1:], np.diff(off)))
    return place - off[np.searchsorted(off, place, "right") - 1], np.searchsorted(off, place, "right") - 1, Rolling(data).hash(place, place + min_bytes)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 400, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = 1 << 20) -> DataFrame:
    """(id, n_bytes, spans, kept, text): each text's bytes without those covered by a min_bytes string that starts anywhere else too.

    Texts are UTF-8 bytes, strings do not cross texts, overlaps count, and all strings are judged on the input. spans are the
    maximal removed runs as (start, end) byte offsets; kept is the rest, in order, and text has the characters of which no byte
    is removed. One row for each input row.

    Method. Positions whose offset modulo v is in a difference cover are the sample: two suffixes that agree for min_bytes have,
    for any two offsets, a sample position of both at one same distance below v, and agree there for min_bytes - v + 1 bytes. So
    sample prefixes of that depth are counted over the corpus (by a hash; a collision only lets more in), and a suffix enters the
    sort only if one of its next v positions is a sample position that ties. Suffixes are dealt to buckets by an anchor, the
    least hash of the GRAM byte strings in their first min_bytes, which equal ones share and neighbours mostly share too: a run
    of them goes as one slice of text. Equal slices are put together by a partial aggregation. A passage in many texts still
    brings a slice for each context that it stands in. An anchor with more than bucket_bytes of different slices is cut to the
    runs of strings that are there more than once, which are counted as the samples are; its contexts go, and what is left of
    the passage is equal in all texts and put together again. What then is still more is dealt string by string, so no
    bucket holds all contexts. Each bucket is sorted on its own, long ties by the ranks of its cover sample (see
    suffix_classes()), and no hash decides: strings of one class have equal bytes. Of equal texts (128 bits) one takes part, as a
    text with a copy loses all or nothing. Memory is that of one block of texts or of one bucket.

    Null text is an empty one, with no spans. Texts under min_bytes, and empty tables, lose nothing. Rows that repeat (same id
    and text too) are texts of their own, so each loses all its bytes if long enough. Null ids are kept as they are; other
    columns are not read.
    """
    blocks, n_blocks = blocked(docs, id_col, text_col, block_bytes)
    v = max(x for x in COVERS if x * 3 <= min_bytes or x == 1)
    depth, gram = min_bytes - v + 1, min(GRAM, min_bytes)
    n_buckets = buckets(n_blocks)

    def whole(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        found = [hashlib.blake2b(x.as_buffer() or b"", digest_size=16).digest() for x in table["body"].combine_chunks()]
        both = np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()

    def whole_keys(table: pa.Table) -> pa.Table:
        table = in_order(table)
        a, b = whole(table)
        block = table["block"][0].as_py()
        return pa.concat_tables([emit(a, block, 2, n_buckets), emit(b, block, 3, n_buckets)])

    def copies(table: pa.Table, codes: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Which texts have a copy somewhere, and which stand for all their copies in the sorts."""
        a, b = whole(table)
        mark = marks_of(codes, 2, a)
        twice = ((mark & ~np.uint8(FIRST)) > 1) & (codes_of(codes, 3, b) > 1)
        new = np.zeros(len(a), bool)
        new[np.unique(a, return_index=True)[1]] = True
        return twice, ~twice | (new & (mark >= FIRST))

    def sample(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Rolling, np.ndarray, np.ndarray]:
        """The texts' bytes and offsets, each byte's offset and its text's end; and the cover sample with its hashes."""
        data, off = texts(table["body"])
        size = np.diff(off)
        inside, end = np.arange(len(data)) - np.repeat(off[:-1], size), np.repeat(off[1:], size)
        member = np.zeros(v, bool)
        member[list(COVERS[v])] = True
        at = np.flatnonzero(member[inside % v])
        at = at[at + depth <= end[at]]
        rolling = Rolling(data)
        return data, off, inside, end, rolling, at, rolling.hash(at, at + depth)

    def sample_keys(table: pa.Table, codes: pa.Table) -> pa.Table:
        return emit(sample(table.filter(pa.array(copies(table, codes)[1])))[6], table["block"][0].as_py(), 0, n_buckets)

    def slices(table: pa.Table, codes: pa.Table) -> pa.Table:
        twice, stands = copies(table, codes)
        size = np.diff(texts(table["body"])[1])
        repeated = np.flatnonzero(twice & (size >= min_bytes))
        data, off, inside, end, rolling, at, key = sample(table.filter(pa.array(stands)))
        ties = np.zeros(len(data) + v + 1, np.int32)
        ties[at[codes_of(codes, 0, key) > 1] + 1] = 1
        np.cumsum(ties, out=ties)
        place = np.flatnonzero(np.arange(len(data)) + min_bytes <= end)
        place = place[ties[place + v] > ties[place]]
        at = np.arange(max(0, len(data) - gram + 1))
        least, width, over = rolling.hash(at, at + gram), 1, min_bytes - gram + 1
        while 2 * width <= over:
            least, width = np.minimum(least[: len(least) - width], least[width:]), 2 * width
        anchor = np.minimum(least[place], least[place + over - width])
        cut = np.flatnonzero(np.append(True, (np.diff(place) != 1) | (anchor[1:] != anchor[:-1]))[: len(place)])
        start, n = place[cut], np.diff(np.append(cut, len(place)))
        body = [data[a : a + k - 1 + min_bytes].tobytes() for a, k in zip(start.tolist(), n.tolist(), strict=True)]
        no = len(repeated)
        text = np.concatenate([repeated, np.flatnonzero(stands)[np.searchsorted(off, start, "right") - 1]])
        return pa.table({
            "block": pa.array(np.full(len(text), table["block"][0].as_py()), pa.int32()), "text": pa.array(text, pa.int32()),
            "start": pa.array(np.concatenate([np.zeros(no, np.int64), inside[start]])), "n": pa.array(np.concatenate([np.zeros(no, np.int64), n]), pa.int32()),
            "anchor": pa.array(np.concatenate([np.zeros(no, np.int64), anchor[cut].view(np.int64)])), "residue": pa.array(np.concatenate([np.zeros(no, np.int64), inside[start] % v]), pa.int32()),
            "digest": pa.array([None] * no + [hashlib.blake2b(x, digest_size=16).digest() for x in body], pa.binary()), "body": pa.array([None] * no + body, pa.binary()),
        })

    def sort(table: pa.Table) -> pa.Table:
        data, off = texts(table["body"])
        place, kind = suffix_classes(data, off, np.array(table["residue"].to_pylist(), np.int64), min_bytes, v)
        owner = np.searchsorted(off, place, "right") - 1
        again = np.bincount(kind, np.array(table["copies"].to_pylist(), np.int64)[owner])[kind] > 1
        part = np.split(again, np.cumsum(np.diff(off)[:-1] - min_bytes + 1))
        return pa.table({"digest": table["digest"], "again": pa.array([np.packbits(x).tobytes() if x.any() else None for x in part], pa.binary())})

    def cut(table: pa.Table, marks: pa.Table) -> pa.Table:
        data, off = texts(table["body"])
        cover, gone = np.zeros(len(data) + 1, np.int32), np.zeros(len(data), bool)
        for text, start, n, again in zip(*(marks[c].to_pylist() for c in ("text", "start", "n", "again")), strict=True):
            if again is None:
                gone[off[text] : off[text + 1]] = True
            else:
                at = off[text] + start + np.flatnonzero(np.unpackbits(np.frombuffer(again, np.uint8), count=n))
                cover[at] += 1
                cover[at + min_bytes] -= 1
        gone |= np.cumsum(cover[:-1]) > 0
        left = np.concatenate([[0], np.cumsum(~gone)])[off]
        edge, last = gone.copy(), gone.copy()
        edge[1:] &= ~gone[:-1]
        inner = off[:-1][off[:-1] < len(data)]
        edge[inner] = gone[inner]
        last[:-1] &= ~gone[1:]
        tail = off[1:][off[1:] > 0] - 1
        last[tail] = gone[tail]
        a, b = np.flatnonzero(edge), np.flatnonzero(last) + 1
        doc = np.searchsorted(off, a, "right") - 1
        spans = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(doc, np.arange(len(off))), pa.int32()),
            pa.StructArray.from_arrays([pa.array(a - off[doc], pa.int64()), pa.array(b - off[doc], pa.int64())], ["start", "end"]),
        )
        rest = pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
        char = np.cumsum((data & 0xC0) != 0x80)
        part = np.bincount(char, gone)[char] > 0 if len(data) else gone
        left = np.concatenate([[0], np.cumsum(~part)])[off]
        text = pa.Array.from_buffers(pa.string(), len(off) - 1, [None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[~part]))])
        return pa.table({"id": table["id"], "n_bytes": pa.array(np.diff(off), pa.int64()), "spans": spans, "kept": rest, "text": text})

    def twice_or_once(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        table = table.sort_by("digest")
        return table, *window_hashes(table, min_bytes)

    def window_keys(table: pa.Table) -> pa.Table:
        table, _, owner, key = twice_or_once(table)
        again = np.array(table["copies"].to_pylist(), np.int64)[owner] > 1
        return emit(np.concatenate([key, key[again]]), table["block"][0].as_py(), 0, n_buckets)

    def parts_of(table: pa.Table, codes: pa.Table) -> pa.Table:
        """Runs of strings that the same number of slices have (by its length in bits), more than one."""
        table, inside, owner, key = twice_or_once(table)
        code = codes_of(codes, 0, key)
        edge = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (np.diff(code.astype(np.int16)) != 0))[: len(code)])
        rows, columns = [], [table[c].to_pylist() for c in ("digest", "copies", "key", "residue", "body")]
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(code)], strict=True):
            if code[a] > 1:
                parent, copies, anchor, residue, body = (c[owner[a]] for c in columns)
                at, n = int(inside[a]), b - a
                part = body[at : at + n - 1 + min_bytes]
                rows.append({"parent": parent, "at": at, "digest": hashlib.blake2b(part, digest_size=16).digest(), "copies": copies, "n": n, "key": anchor, "residue": (residue + at) % v, "body": part})
        return pa.Table.from_pylist(rows, _PARTS)

    def one_by_one(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                table = pa.Table.from_batches([batch.slice(i, 1)])
                inside, _, key = window_hashes(table, min_bytes)
                parent, copies, residue, body = (table[c][0].as_py() for c in ("digest", "copies", "residue", "body"))
                bodies = [body[a : a + min_bytes] for a in inside.tolist()]
                yield pa.RecordBatch.from_pydict({
                    "parent": [parent] * len(bodies), "at": inside, "digest": [hashlib.blake2b(x, digest_size=16).digest() for x in bodies], "copies": [copies] * len(bodies), "n": [1] * len(bodies),
                    "key": key.view(np.int64), "residue": (residue + inside) % v, "body": bodies,
                }, _PARTS)

    def split(hot: DataFrame, level: int) -> DataFrame:
        """Slices cut up: at first into runs of strings that are there more than once, then, should that not do, string by string."""
        if level:
            return hot.mapInArrow(one_by_one, PART)
        total = hot.agg(F.sum(F.octet_length("body"))).first()[0] or 0
        dealt = hot.withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(max(16, -(-total // block_bytes)))).cast("int"))
        codes = counted(dealt.groupBy("block").applyInArrow(window_keys, SENT))
        return dealt.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(parts_of, PART)

    def together(table: pa.Table) -> pa.Table:
        """The bits of a slice out of those of its parts; what no part has is there once."""
        again = np.zeros(table["total"][0].as_py(), np.uint8)
        for at, n, bits in zip(*(table[c].to_pylist() for c in ("at", "n", "again")), strict=True):
            again[at : at + n] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
        return pa.table({"digest": table["parent"].slice(0, 1), "again": pa.array([np.packbits(again).tobytes()], pa.binary())})

    def repeated(slices: DataFrame, level: int = 0) -> DataFrame:
        """(digest, again): which strings of each slice are there more than once. slices: (digest, copies, n, key, residue, body)."""
        heavy = stored(slices.groupBy("key").agg(F.sum(F.octet_length("body")).alias("bytes")).where(F.col("bytes") > bucket_bytes).select("key"), "heavy-keys") if level < 2 else None
        split_up = heavy is not None and not heavy.isEmpty()
        whole = slices.join(heavy, "key", "left_anti") if split_up else slices
        total = whole.agg(F.sum(F.octet_length("body"))).first()[0] or 0
        bucket = F.pmod(F.xxhash64("key"), F.lit(max(16, -(-total // bucket_bytes)))).cast("int")
        out = whole.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(sort, "digest binary, again binary").where("again is not null")
        if split_up:
            hot = slices.join(heavy, "key", "left_semi")
            parts = stored(split(hot, level), "slice-parts")
            again = repeated(distinct(parts), level + 1)
            marked = parts.select("parent", "at", F.col("n"), "digest").join(again, "digest").drop("digest").join(hot.select(F.col("digest").alias("parent"), F.col("n").alias("total")), "parent")
            out = out.unionByName(marked.groupBy("parent").applyInArrow(together, "digest binary, again binary"))
        return stored(out, "repeats")

    def distinct(slices: DataFrame) -> DataFrame:
        return stored(slices.groupBy("digest").agg(F.sum("copies").alias("copies"), *(F.first(c).alias(c) for c in ("n", "key", "residue", "body"))), "distinct-slices")

    codes = counted(blocks.groupBy("block").applyInArrow(whole_keys, SENT))
    codes = codes.unionByName(counted(with_codes(blocks, codes, sample_keys, SENT)))
    found = stored(with_codes(blocks, codes, slices, SLICE), "slices")
    sorted_ = repeated(distinct(found.where("digest is not null").withColumns({"copies": F.lit(1).cast("long"), "key": F.col("anchor")})))
    marks = found.select("block", "text", "start", "n", "digest").join(sorted_, "digest", "left").where("digest is null or again is not null").drop("digest")
    kind = docs.schema[id_col].dataType.simpleString()
    out = with_codes(blocks, marks, cut, f"id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary, text string")
    return out.withColumnRenamed("id", id_col)


def suffix_dedup_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text of suffix_dedup()."""
    return suffix_dedup(docs, **options).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "text"
    )


ORACLE = """
with t as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
p as (select r, i, md5(array_slice(b, i, i + 399)) as h from t, unnest(range(1, octet_length(b) - 398)) u(i)),
w as (select r, i, count(*) over (partition by h) > 1 as hit from p),
y as (select r, i, hex(array_slice(b, i, i)) as x from t, unnest(range(1, octet_length(b) + 1)) u(i) where r in (select r from w where hit)),
g as (select y.*, max(coalesce(hit, false)) over (partition by y.r order by y.i rows between 399 preceding and current row) as gone, sum(case when x between '80' and 'BF' then 0 else 1 end) over (partition by y.r order by y.i) as c from y left join w on w.r = y.r and w.i = y.i),
k as (select *, max(gone) over (partition by r, c) as char_gone, gone and not coalesce(lag(gone) over (partition by r order by i), false) as first from g),
s as (select r, sum(gone::int) as n_removed, sum(first::int) as n_spans, unhex(coalesce(string_agg(x, '' order by i) filter (not gone), '')) as kept, decode(unhex(coalesce(string_agg(x, '' order by i) filter (not char_gone), ''))) as text from k group by r)
select doc_id, octet_length(b) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(coalesce(kept, b)) as kept_sha256, coalesce(text, decode(b)) as text from t left join s on s.r = t.r
"""
