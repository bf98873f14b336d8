"""Importance resampling towards a target distribution with bit-sliced bucket counts (operator 11)."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import _tokens
from fleetlens.llm._scratch import new_path, stored
from fleetlens.operators.frames import ranked

BUCKETS = 10000
#: Bytes of words: letters, digits and all that is not ASCII (A-Z are lower-cased before).
WORD = np.ones(256, bool)
WORD[:0x30] = WORD[0x3A:0x61] = WORD[0x7B:0x80] = False
LONGEST = 64
ROWS = 256


def _zero_shifts() -> np.ndarray:
    """[n, lane, byte]: what n zero bytes behind it make of a crc's byte; n up to LONGEST."""
    table = np.array([zlib.crc32(bytes([i])) for i in range(256)], np.uint32)
    table = table ^ table[0]  # of a state, without what zlib puts before and after
    lanes = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    out = [np.array(lanes)]
    for _ in range(LONGEST):
        out.append(table[out[-1] & np.uint32(255)] ^ (out[-1] >> np.uint32(8)))
    return np.array(out)


SHIFTS = _zero_shifts()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """crc of a string, as it counts with n more bytes behind: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""
    while len(n) and n.max() > LONGEST:
        far = n > LONGEST
        crc, n = crc.copy(), n - LONGEST * far
        crc[far] = _shift(crc[far], np.full(int(far.sum()), LONGEST))
    return _shift(crc, n)


def _shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    x = SHIFTS[n, 0, crc & np.uint32(255)]
    for k in (1, 2, 3):
        x = x ^ SHIFTS[n, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return x


def features(column, most: int = 3, window: int = _tokens.WINDOW_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each word, row of each feature, bucket of each feature), window by window; features are runs of 1 to `most` words."""
    tail = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))
    for w in _tokens.words(column, WORD, window=window, rows=ROWS):
        coded = w.strings().dictionary_encode()
        crc = np.array([zlib.crc32(x) for x in coded.dictionary.to_pylist()], np.uint32)[coded.indices.to_numpy()]
        k = len(tail[0])
        row, size, crc = (np.concatenate(x) for x in zip(tail, (w.row, w.size.astype(np.int64), crc), strict=True))
        keep = max(0, len(row) - most + 1)
        tail = (row[keep:], size[keep:], crc[keep:])
        spaced = shifted(np.full(len(size), zlib.crc32(b" "), np.uint32), size) ^ crc
        rows, found, run = [row[k:]], [crc[k:]], crc
        for n in range(2, most + 1):  # runs of n words that end at each word
            run = shifted(run[:-1], size[n - 1 :] + 1) ^ spaced[n - 1 :] if len(run) else run
            whole = (row[n - 1 :] == row[: max(0, len(row) - n + 1)]) & (np.arange(n - 1, len(row)) >= k)
            rows.append(row[n - 1 :][whole])
            found.append(run[whole])
        yield w.row, np.concatenate(rows), np.concatenate(found) % np.uint32(BUCKETS)


def bucket_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n): features of all texts by bucket; a task sends one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, bucket in features(batch.column("body")):
                total += np.bincount(bucket, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    return docs.select(F.col(text_col).alias("body")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _vector(counts: DataFrame) -> list[int]:
    out = [0] * BUCKETS
    for bucket, n in counts.collect():  # at most BUCKETS rows
        out[bucket] = n
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """A bucket's gain: thousandths of the log of its share in the target by its share in the corpus, both with one more each."""
    s_all, t_all = float(sum(corpus) + BUCKETS), float(sum(target) + BUCKETS)
    return np.array([math.floor(1000 * math.log(float(t + 1) * s_all / (float(s + 1) * t_all))) for s, t in zip(corpus, target, strict=True)], np.int64)


def _plane(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def gain_planes(gain: np.ndarray) -> np.ndarray:
    """Bit planes of signed numbers; the last one is that of the sign and counts negative."""
    n = int(np.abs(gain).max()).bit_length() + 1
    return np.concatenate([_plane(((gain >> j) & 1).astype(np.uint8)[None]) for j in range(n)])


def weigh(counts: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Sums of counts times gains of each row, bit by bit: bits that both have are counted and count by their powers of two."""
    out = np.zeros(len(counts), np.int64)
    at = np.flatnonzero(counts)
    value = counts.ravel()[at]
    for i in range(int(value.max()).bit_length() if len(at) else 0):
        bits = np.zeros(counts.shape, np.uint8)
        bits.ravel()[at[(value >> i) & 1 == 1]] = 1
        own = _plane(bits)
        for j, plane in enumerate(planes):
            both = np.bitwise_count(own & plane).sum(axis=1, dtype=np.int64) << (i + j)
            out += -both if j == len(planes) - 1 else both
    return out


def weighed(column, planes: np.ndarray, window: int = _tokens.WINDOW_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, features and weight of each row of a column. A window has at most ROWS rows, so counts are held for so many."""
    n = len(column)
    n_words, n_features, weight = (np.zeros(n, np.int64) for _ in range(3))
    open_row, open_counts = -1, None
    for words, rows, bucket in features(column, window=window):
        first, last = int(words[0]), int(words[-1])
        counts = np.bincount((rows - first) * BUCKETS + bucket, minlength=(last - first + 1) * BUCKETS).reshape(-1, BUCKETS)
        np.add.at(n_words, words, 1)
        if open_row == first:
            counts[0] += open_counts
        elif open_row >= 0:
            n_features[open_row], weight[open_row] = open_counts.sum(), weigh(open_counts[None], planes)[0]
        n_features[first:last], weight[first:last] = counts[:-1].sum(axis=1), weigh(counts[:-1], planes)
        open_row, open_counts = last, counts[-1].copy()  # it may go on
    if open_row >= 0:
        n_features[open_row], weight[open_row] = open_counts.sum(), weigh(open_counts[None], planes)[0]
    return n_words, n_features, weight


def importance_sample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """A row (id_col, n_words, n_features, weight, score, rank) for each row of docs; rank is null for those that are not drawn.

    Features are the runs of one to three words of a text, its weight the sum of its features' gains (see gains()). The score
    adds a Gumbel number that depends on seed and id, so the percent highest scores of the texts with at least min_words words
    are a draw without replacement by the weights; ties go to the smaller id, null last. A draw does not change when it is run
    again. Null text has no words, weight 0. Rows that repeat are drawn each for themselves, next to each other as they tie. A
    null id draws as the word null. An empty target, or no documents, is nothing special. Other columns are not looked at.

    Method. Each row's counts by bucket become planes of 10,000 bits, a bit of the count each; these meet the planes of the
    gains' bits, and the bits that both have are counted (see weigh()). The corpus is read twice: once for the counts of all
    buckets, of which each task sends one row a bucket, and once for the weights. Ranks are given by ranges of the score, over
    those that a quantile of the scores does not exclude for certain.
    """
    spark = docs.sparkSession
    planes = gain_planes(gains(_vector(bucket_counts(docs, text_col)), _vector(bucket_counts(target, target_col))))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("draw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = weighed(batch.column("body"), planes)
            score = [w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for w, h in zip(weight.tolist(), batch.column("draw").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, (n_words, n_features, weight)), pa.array(score, pa.int64())], ["id", "n_words", "n_features", "weight", "score"])

    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    scored = stored(read.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long, score long"), "scored")
    able = scored.where(F.col("n_words") >= min_words)
    n = able.count()
    wanted = percent * n // 100
    # a score that is not above the cut: the quantile is off by a ten-thousandth of the rows at most
    cut = able.approxQuantile("score", [max(0.0, 1 - (wanted + 1) / n - 0.001)], 0.0001)[0] if n else 0.0
    if n and able.where(F.col("score") >= cut).count() < wanted:
        cut = -math.inf
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    place = ranked(able.where(F.col("score") >= cut), order, "rank", new_path(spark, "ranked"))
    drawn = place.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = scored.where((F.col("n_words") < min_words) | (F.col("score") < cut)).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).withColumnRenamed("id", id_col)


def importance_sample_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return importance_sample(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


#: The checksum is computed byte by byte from its table of 256 values, once for each distinct feature.
ORACLE = """
with recursive bits as (select i as b, i::bigint as c, 0 as k from range(256) t(i)
  union all select b, case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end, k + 1 from bits where k < 8),
crc_table as materialized (select list(c order by b) as t from bits where k = 8),
texts as (select row_number() over () as row_no, * from (select 'd' as part, doc_id, text from documents union all select 'b', null, text from benchmark)),
w as materialized (select part, row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from texts),
g as materialized (select part, row_no, g, count(*) as c from (select part, row_no, unnest(w) as g from w
  union all select part, row_no, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w
  union all select part, row_no, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from w) group by all),
u as materialized (select g, hex(encode(g)) as x from (select distinct g from g)),
h as (select g, xor(list_reduce(list_transform(range(1, len(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::bigint), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) % 10000 as bucket from u, crc_table),
f as materialized (select part, row_no, bucket, c from g join h using (g)),
n as (select bucket, coalesce(sum(c) filter (part = 'd'), 0) as s, coalesce(sum(c) filter (part = 'b'), 0) as t, sum(s) over () as s_all, sum(t) over () as t_all from f group by bucket),
gain as (select bucket, floor(1000 * ln((t + 1)::double * (s_all + 10000)::double / ((s + 1)::double * (t_all + 10000)::double)))::bigint as gain from n),
d as (select row_no, sum(c)::bigint as n_features, sum(c * gain)::bigint as weight from f join gain using (bucket) where part = 'd' group by row_no),
scored as (select doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  ('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint as h from w left join d using (row_no) where part = 'd'),
ranked as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from scored),
placed as (select *, case when n_words >= 20 then row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last) end as place, count(*) filter (n_words >= 20) over () as n from ranked)
select doc_id, n_features, weight, score, case when place <= 5 * n // 100 then place end as rank from placed
"""
