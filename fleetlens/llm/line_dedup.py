"""Removal of repeated runs of lines, found by winnowing (operator 10)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm._bytes import SPACE, Rolling, lines, texts, words
from fleetlens.llm._scratch import stored

CHUNK_BYTES = 1 << 20
#: Words in a gram, of which the least hash of a window of words is its fingerprint.
GRAM = 16
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _full_lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, line number) of each line with a word; white space at its ends does not count."""
    start, end, doc = lines(data, off)
    number = np.arange(len(start)) - np.searchsorted(doc, doc)
    solid = np.concatenate([np.flatnonzero(~SPACE[data]), [len(data)]])
    a = solid[np.searchsorted(solid, start)]
    b = solid[np.searchsorted(solid, end) - 1] + 1
    full = a < end
    return Rolling(data).hash(a[full], b[full]), doc[full], number[full]


def winnow(keys: np.ndarray, doc: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of run lines of one text: its first line, and the line of its least key (the last such)."""
    n = len(keys) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(doc[run - 1 :] == doc[:n])
    best = first.copy()
    for i in range(run):
        best = np.where(keys[first + i] <= keys[best], first + i, best)
    return first, best


def _around(keys: np.ndarray, start: np.ndarray, end: np.ndarray, step: int) -> pa.Array:
    """Lists of the keys from start to end, from the end backwards if step is -1."""
    n = end - start
    edge = np.concatenate([[0], np.cumsum(n)])
    i = np.arange(edge[-1]) - np.repeat(edge[:-1], n)
    at = np.repeat(start, n) + i if step > 0 else np.repeat(end, n) - 1 - i
    return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(keys[at].view(np.int64)))


def passages(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of size words of one text, those with one fingerprint behind each other put together.

    For each such group: fingerprint, text number, first word of its first window, number of windows; and the hashes of all windows.
    """
    start, end, doc = words(data, off)
    n = len(start) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    order = Rolling(Rolling(data).hash(start, end))
    gram = min(GRAM, size)
    at = np.arange(len(start) - gram + 1)
    least, width, over = order.hash(at, at + gram), 1, size - gram + 1
    while 2 * width <= over:
        least, width = np.minimum(least[: len(least) - width], least[width:]), 2 * width
    first = np.flatnonzero(doc[size - 1 :] == doc[:n])
    least = np.minimum(least[first], least[first + over - width])
    cut = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (np.diff(first) != 1)])) if len(first) else np.zeros(0, np.int64)
    count = np.diff(np.append(cut, len(first)))
    return least[cut], doc[first[cut]], first[cut] - np.searchsorted(doc, doc[first[cut]]), count, order.hash(first, first + size)


def _chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded bytes (or single rows)."""
    size = np.diff(texts(batch.column(column))[1])
    part = np.cumsum(size) // CHUNK_BYTES
    edge = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(edge, edge[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3, passage_words: int | None = None) -> DataFrame:
    """All columns of docs with the text less its repeated runs of lines, and n_lines, n_removed (lines before; lines removed).

    A run is min_lines lines that follow each other in a text; lines without a word are passed over, and white space at a
    line's ends does not count. A run that equals one of an earlier place (by id, then by the text's hash, then by line) is
    removed, with the lines passed over inside it; longer repeats are removed whole as all their runs are. The first place of
    each run stays, so nothing disappears from the corpus.

    Method. Each window of min_lines line hashes gives its least one as a fingerprint, so any repeat of that length shares one at
    the same place of the window. Fingerprints that occur once are left out. The positions of the others are joined by
    fingerprint, and a match is extended line by line to both sides, over as many lines before and after it as a window that
    leans on it has: these lines are the rest of the join's key, and its partner is the earliest place that has them all. Extended
    matches that touch make the maximal run that goes. The earliest places are found by a partial aggregation and the joins are
    between two shuffles, which Spark can split where a fingerprint is hot; a line in a third of all texts makes no pairs.

    With passage_words a repeat of so many words goes too, however its words are dealt to lines: on one line, inside a longer one or
    over several. Windows of that many words are found and compared as runs of lines are, by a fingerprint of GRAM words; groups
    of windows that are equal as wholes are settled as one. What stays of a line keeps its bytes; a line of which no word stays is
    removed and counted, and so are lines without a word inside a passage. n_passage_words then gives the words that passages took.

    Rows that repeat with the same id and text are one text and keep or lose the same lines. Null text stays null with zero
    lines; a null id sorts first. Texts with fewer than min_lines full lines, and empty tables, lose nothing. Columns named
    n_lines or n_removed in docs are replaced.
    """
    key = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body_hash"), F.col(text_col).alias("body"))
    kind = docs.schema[id_col].dataType.simpleString()

    def fingerprints(batches):
        for whole in batches:
            for b in _chunks(whole, "body"):
                h, doc, _ = _full_lines(*texts(b.column("body")))
                first, best = winnow(h, doc, min_lines)
                order = np.lexsort((first, best))
                at, start, count = np.unique(best[order], return_index=True, return_counts=True)
                base = np.searchsorted(doc, doc[at])
                lead = (best - first)[order]
                most = np.maximum.reduceat(lead, start) if len(at) else lead
                least = np.minimum.reduceat(lead, start) if len(at) else lead
                owner = pa.array(doc[at])
                yield pa.RecordBatch.from_arrays([
                    pa.array(h[at].view(np.int64)), b.column("id").take(owner), b.column("body_hash").take(owner), pa.array((at - base).astype(np.int32)),
                    _around(h, at - most, at, -1), _around(h, at + 1, at + min_lines - least, 1),
                    pa.ListArray.from_arrays(pa.array(np.append(start, len(lead)), pa.int32()), pa.array(lead.astype(np.int32))),
                ], names=["print", "id", "body_hash", "line", "before", "after", "leads"])

    found = stored(key.mapInArrow(fingerprints, f"print long, id {kind}, body_hash long, line int, before array<long>, after array<long>, leads array<int>"), "fingerprints")
    again = stored(found.groupBy("print").agg(F.count("*").alias("c")).where("c > 1").select("print"), "repeated-prints")
    found = found.join(again, "print", "left_semi").select("*", F.explode("leads").alias("lead"))
    extension = F.xxhash64("lead", F.slice("before", F.lit(1), F.col("lead")), F.slice("after", F.lit(1), F.lit(min_lines - 1) - F.col("lead")))
    runs = found.select("print", extension.alias("extension"), F.struct("id", "body_hash", (F.col("line") - F.col("lead")).alias("start")).alias("place"))
    first = runs.groupBy("print", "extension").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").select("print", "extension", "first")
    later = runs.join(stored(first, "first-places"), ["print", "extension"]).where("place > first").groupBy("place.id", "place.body_hash").agg(F.collect_set("place.start").alias("starts"))
    if passage_words is None:
        later = later.withColumn("spans", F.lit(None).cast("array<struct<start:int,n:int>>"))
    else:
        later = later.join(_later_passages(key, kind, passage_words).withColumnRenamed("id", "_i").withColumnRenamed("body_hash", "_b"), F.col("id").eqNullSafe(F.col("_i")) & (F.col("body_hash") == F.col("_b")), "full")
        later = later.select(F.coalesce("id", "_i").alias("id"), F.coalesce("body_hash", "_b").alias("body_hash"), "starts", "spans")
    later = stored(later, "later-runs").select(F.col("id").alias("_id"), F.col("body_hash").alias("_hash"), F.col("starts").alias("_starts"), F.col("spans").alias("_spans"))

    def drop(batches):
        for b in batches:
            kept, n_lines, gone, taken = [], [], [], []
            for text, starts, spans in zip(b.column("_text").to_pylist(), b.column("_starts").to_pylist(), b.column("_spans").to_pylist(), strict=True):
                n_lines.append(0 if text is None else text.count("\n") + 1)
                gone.append(0)
                taken.append(0)
                if starts or spans:
                    all_lines = text.split("\n")
                    out = _removed(all_lines, starts, min_lines) if starts else [False] * len(all_lines)
                    if spans:
                        all_lines, out, taken[-1] = _less_passages(all_lines, out, [(x["start"], x["start"] + x["n"] + passage_words - 1) for x in spans])
                    text = "\n".join(x for x, o in zip(all_lines, out, strict=True) if not o)
                    gone[-1] = sum(out)
                kept.append(text)
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(taken, pa.int64())], names=["_row", "_text", "_n_lines", "_n_removed", "_n_passage_words"])

    added = ["n_lines", "n_removed"] + (["n_passage_words"] if passage_words is not None else [])
    others = [c for c in docs.columns if c not in (text_col, *added)]
    rows = docs.select(F.struct(*others).alias("_row"), F.col(id_col).alias("_key"), F.xxhash64(text_col).alias("_body_hash"), F.col(text_col).alias("_text"))
    joined = rows.join(later.hint("merge"), rows["_key"].eqNullSafe(later["_id"]) & (rows["_body_hash"] == later["_hash"]), "left").select("_row", "_text", "_starts", "_spans")
    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, _text string, _n_lines long, _n_removed long, _n_passage_words long"
    out = joined.mapInArrow(drop, schema)
    columns: list[Column] = [F.col("_text").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns if c not in added]
    return out.select(*columns, *(F.col(f"_{c}").alias(c) for c in added))


def _later_passages(key: DataFrame, kind: str, size: int) -> DataFrame:
    """(id, body_hash, spans): in each text the windows of size words that stand at an earlier place too, as (first window, number)."""

    def groups(batches):
        for whole in batches:
            for b in _chunks(whole, "body"):
                least, doc, start, count, run = passages(*texts(b.column("body")), size)
                edge = np.concatenate([[0], np.cumsum(count)])
                every = Rolling(run).hash(edge[:-1], edge[1:])
                owner = pa.array(doc)
                # windows are compared within a fingerprint of 64 bits; 32 more tell them apart
                short = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array((run >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least.view(np.int64)), pa.array(every.view(np.int64)), b.column("id").take(owner), b.column("body_hash").take(owner), pa.array(start.astype(np.int32)), short],
                    names=["print", "all", "id", "body_hash", "start", "runs"],
                )

    found = stored(key.mapInArrow(groups, f"print long, all long, id {kind}, body_hash long, start int, runs array<int>"), "passages")
    again = stored(found.groupBy("print").agg(F.count("*").alias("c")).where("c > 1").select("print"), "repeated-passages")
    place = F.struct("id", "body_hash", "start")
    found = found.join(again, "print", "left_semi").select("print", "all", place.alias("place"), "runs")
    alike = stored(found.groupBy("print", "all").agg(F.min(F.struct("place", "runs")).alias("least")).select("print", "all", "least.place", "least.runs"), "passage-groups")
    # all but the first of groups that are equal as wholes
    first = alike.select("print", "all", F.col("place").alias("first"))
    whole = found.join(first, ["print", "all"]).where("place > first").select("place.id", "place.body_hash", F.struct(F.col("place.start").alias("start"), F.size("runs").alias("n")).alias("span"))
    # windows of the first ones that stand in other groups too
    mixed = stored(alike.groupBy("print").agg(F.count("*").alias("c")).where("c > 1").select("print"), "mixed-passages")
    runs = alike.join(mixed, "print", "left_semi").select("print", "place", F.posexplode("runs").alias("i", "run"))
    runs = runs.select("print", "run", F.struct("place.id", "place.body_hash", (F.col("place.start") + F.col("i")).alias("start")).alias("place"))
    earliest = runs.groupBy("print", "run").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").select("print", "run", "first")
    part = runs.join(stored(earliest, "first-passages"), ["print", "run"]).where("place > first").select("place.id", "place.body_hash", F.struct(F.col("place.start").alias("start"), F.lit(1).alias("n")).alias("span"))
    return whole.unionByName(part).groupBy("id", "body_hash").agg(F.collect_set("span").alias("spans"))


def _less_passages(all_lines: list[str], out: list[bool], spans: list[tuple[int, int]]) -> tuple[list[str], list[bool], int]:
    """The lines less the words of spans (first word, word after the last), which lines go, and how many words the spans took."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    left, gone, taken, at, k = [], [], 0, 0, 0
    for line, whole in zip(all_lines, out, strict=True):
        found = [m.span() for m in _WORD.finditer(line)]
        while k < len(merged) and merged[k][1] <= at:
            k += 1
        if whole or not found:
            gone.append(whole or (k < len(merged) and merged[k][0] < at))
            left.append(line)
            at += len(found)
            continue
        hit, j = [False] * len(found), k
        while j < len(merged) and merged[j][0] < at + len(found):
            a, b = max(merged[j][0] - at, 0), min(merged[j][1] - at, len(found))
            hit[a:b] = [True] * (b - a)
            j += 1
        n = sum(hit)
        taken += n
        gone.append(n == len(found))
        if 0 < n < len(found):
            parts, since = [], 0
            for i, h in enumerate(hit):
                if h and not (i and hit[i - 1]):
                    parts.append(line[since : found[i][0]])
                if h and i + 1 < len(hit) and not hit[i + 1]:
                    since = found[i + 1][0]
            line = "".join(parts).rstrip(" \t\r\x0b\x0c") if hit[-1] else "".join(parts) + line[since:]
        left.append(line)
        at += len(found)
    return left, gone, taken


def _removed(all_lines: list[str], starts: list[int], run: int) -> list[bool]:
    """Which lines go, given the first full line of each run that goes."""
    full = [i for i, x in enumerate(all_lines) if x.strip(" \t\n\x0b\x0c\r")]
    out = [False] * len(all_lines)
    done = -1
    for s in sorted(starts):
        for i in range(max(full[s], done + 1), full[s + run - 1] + 1):
            out[i] = True
        done = max(done, full[s + run - 1])
    return out


def dedup_lines_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 (of the text that stays, null as empty)."""
    return dedup_lines(docs.select("doc_id", "text"), **options).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
with t as (select doc_id, coalesce(text, '') as text, text is null as missing from documents),
x as (select doc_id, i, string_split(text, chr(10))[i] as line from t, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(i)),
f as (select doc_id, i, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as line from x where regexp_matches(line, '[^\x20\x09-\x0D]')),
g as (
  select doc_id, i, lead(i, 2) over w as last, line as a, lead(line, 1) over w as b, lead(line, 2) over w as c from f window w as (partition by doc_id order by i)),
k as (select *, row_number() over (partition by a, b, c order by doc_id, i) as n from g where last is not null),
gone as (select distinct x.doc_id, x.i from x join k on k.doc_id = x.doc_id and k.n > 1 and x.i between k.i and k.last),
kept as (select x.doc_id, string_agg(x.line, chr(10) order by x.i) as text from x left join gone on gone.doc_id = x.doc_id and gone.i = x.i where gone.i is null group by 1)
select t.doc_id, case when missing then 0 else len(string_split(t.text, chr(10))) end as n_lines, coalesce((select count(*) from gone where gone.doc_id = t.doc_id), 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from t left join kept on kept.doc_id = t.doc_id
"""
