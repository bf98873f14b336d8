"""The corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import functools
import gzip
import hashlib
import html
import re
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import embeddings, html_text, jaccard, line_dedup, mixing, pieces, quality, suffixes, urls, warc
from fleetlens.llm._bytes import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(3)


def words(n, vocabulary=400):
    return [f"w{x}" for x in RNG.integers(0, vocabulary, n)]


@functools.cache
def corpus():
    """(doc_id, text): near and exact copies, shared passages and lines, empty and odd texts."""
    base = words(120, 5000)
    out = [(0, " ".join(base)), (1, " ".join(base)), (2, " ".join([*base[:60], "x", *base[60:]])), (3, " ".join(base).upper())]
    for i in range(4, 12):
        b = list(base)
        for _ in range(i - 3):
            b[int(RNG.integers(0, 120))] = f"z{RNG.integers(0, 10**6)}"
        out.append((i, " ".join(b)))
    passage = "\n".join(" ".join(words(12)) for _ in range(4))
    for i in range(12, 20):
        out.append((i, " ".join(words(30)) + "\n" + passage + "\n" + " ".join(words(30))))
    out += [(20, ""), (21, None), (22, " \t\n"), (23, "one two"), (24, "one two"), (25, "é" * 500), (26, "é" * 500), (27, "ab" * 700), (28, "line a\nline b\n\nline c\nline a\nline b\nline c"), (29, " ".join(words(4000, 50))), (30, "a\tb\x0bc  d\n!! #$ ... Été")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    return df.withColumns({"source": F.when(F.col("doc_id") % 3 == 0, "s1").when(F.col("doc_id") % 3 == 1, "s2"), "kept": F.lit("clash"), "n_lines": F.lit("clash"), "block": F.lit(1), "size": F.lit("x"), "rest": F.lit(1), "words": F.lit(1), "passes": F.lit(1)}).repartition(3)


def empty(docs):
    return docs.where("false")


def union(edges, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(docs):
    sets = {i: brute_shingles(t) for i, t in corpus()}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = union(edges, sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}
    assert jaccard.near_duplicates(empty(docs)).count() == 0


def test_near_duplicates_null_and_repeated_rows(spark):
    t = " ".join(words(30, 9999))
    df = spark.createDataFrame([(5, t), (5, t), (7, t), (None, t)], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in jaccard.near_duplicates(df).collect()) == [("5", "5"), ("5", "5"), ("7", "5"), ("None", "None")]


def test_near_duplicates_of_ids_with_several_texts(spark):
    a, b, c = (words(40, 99999) for _ in range(3))
    rows = [(5, a), (5, b), (7, [*a, "x"]), (8, [*b, "y"]), (9, c), (9, [*b, "y"]), (11, [*c, "z"]), (12, words(40, 99999)), (5, a)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(4)
    assert {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(df, block_bytes=300).collect()} == {(5, 5), (7, 5), (8, 5), (9, 5), (11, 5), (12, 12)}


def test_prefixes_of_similar_sets_meet():
    for _ in range(60):
        n = int(RNG.integers(5, 80))
        a = np.unique(RNG.integers(0, 2**63, n, dtype=np.int64).view(np.uint64))
        b = np.unique(np.concatenate([a[int(RNG.integers(0, 3)) :], RNG.integers(0, 2**63, int(RNG.integers(0, 4)), dtype=np.int64).view(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        code = lambda s: (mix(s) % np.uint64(4) + np.uint64(1)).astype(np.uint8)
        (ta, la, ka), (tb, lb, kb) = jaccard.prefix(a, code(a), 80), jaccard.prefix(b, code(b), 80)
        k = min(ka, kb)
        assert len(set(ta[la <= k].tolist()) & set(tb[lb <= k].tolist())) >= k


@pytest.mark.parametrize("length", [400, 40])
def test_suffix_dedup(docs, length):
    texts = [(i, (t or "").encode()) for i, t in corpus()]
    count = collections.Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    want = {}
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        want[i] = (len(b), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    got = {r.doc_id: (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffixes.suffix_dedup(docs, min_bytes=length, block_bytes=4000).collect()}
    assert got == want
    assert suffixes.suffix_dedup(empty(docs)).count() == 0


@pytest.mark.parametrize(("length", "v"), [(40, 7), (400, 133), (64, 21), (5, 1)])
def test_suffixes_of_a_bucket_are_in_the_order_of_their_bytes(length, v):
    rng = np.random.default_rng(1)
    base = bytes(rng.integers(97, 100, 2000).astype(np.uint8))
    parts, residue = [b"ab" * (length + 20), b"ab" * (length + 20) + b"c", b"a" * length], [0, v // 2, 0]
    for _ in range(40):
        a, n = int(rng.integers(0, 1200)), int(rng.integers(length, length + 300))
        b = bytearray(base[a : a + n])
        if rng.random() < 0.3:
            b[int(rng.integers(0, len(b)))] = 120
        parts.append(bytes(b))
        residue.append(int(rng.integers(0, v)))
    off = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    data = np.frombuffer(b"".join(parts), np.uint8)
    place, kind = suffixes.suffix_classes(data, off, np.array(residue), length, v)
    strings = [data.tobytes()[p : p + length] for p in place]
    rank = {x: i for i, x in enumerate(sorted(set(strings)))}
    assert len(place) == sum(len(x) - length + 1 for x in parts) and [rank[x] for x in strings] == kind.tolist()


def test_hash_collisions_remove_nothing(spark, monkeypatch):
    """Where all samples, anchors and slices meet, bytes still decide."""
    monkeypatch.setattr(suffixes.Rolling, "hash", lambda self, start, end: np.zeros(len(start), np.uint64))
    data, off = np.frombuffer(b"abcdefghij" * 9 + b"klmnopqrst" * 9, np.uint8), np.array([0, 90, 180])
    place, kind = suffixes.suffix_classes(data, off, np.array([0, 3]), 40, 7)
    assert len(set(kind[:51].tolist()) & set(kind[51:].tolist())) == 0 and len(place) == 102


def test_suffix_dedup_keeps_whole_characters(spark):
    p = "é" * 10 + "x" * 30
    df = spark.createDataFrame([(1, "aĩ" + p[1:]), (2, "b" + p), (None, None), (3, p[:20]), (3, p[:20])], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed, r.text) for r in suffixes.suffix_dedup_digest(df, min_bytes=20, block_bytes=64).collect())
    assert got == [("1", 49, "a"), ("2", 50, "b"), ("3", 30, ""), ("3", 30, ""), ("None", 0, "")]  # one byte of the second character stays


def test_covers():
    assert all(suffixes.is_cover(v, c) for v, c in suffixes.COVERS.items())


def test_line_dedup(docs):
    seen, want = set(), {}
    for i, t in corpus():
        lines = (t or "").split("\n")
        full = [j for j, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for a in range(len(full) - 2):
            k = tuple(lines[j].strip(" \t\n\x0b\x0c\r") for j in full[a : a + 3])
            gone |= set(range(full[a], full[a + 2] + 1)) if k in seen else set()
            seen.add(k)
        want[i] = (None if t is None else "\n".join(x for j, x in enumerate(lines) if j not in gone), 0 if t is None else len(lines), len(gone))
    out = line_dedup.dedup_lines(docs)
    assert set(out.columns) == {*docs.columns, "n_removed"}
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in out.collect()} == want
    assert line_dedup.dedup_lines(empty(docs)).count() == 0


def test_line_dedup_repeated_rows(spark):
    t = "\n".join(f"line {i}" for i in range(5))
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, "a\nb")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in line_dedup.dedup_lines(df).collect()) == [("1", 0), ("1", 0), ("2", 5), ("None", 0)]


def test_line_dedup_of_passages(spark):
    p = [f"p{i}" for i in range(60)]
    rows = [
        (1, "alpha beta\n" + " ".join(p) + "\nomega"),
        (2, "own one\n" + " ".join(p) + "\nown two"),  # on a line
        (3, "before it " + "  ".join(p) + " after it"),  # inside a line
        (4, "x " + " ".join(p[:30]) + "\n \n" + " ".join(p[30:]) + "\ny"),  # over two lines
        (5, " ".join(p[5:54])),  # 49 words stay
        (6, "z " + " ".join(p[4:56]) + " z"),  # 52 words
        (7, None),
        (8, " ".join(f"q{i}" for i in range(51)) + " r " + " ".join(f"q{i}" for i in range(51))),
        (2, "own one\n" + " ".join(p) + "\nown two"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_passage_words", F.lit("clash")).repartition(3)
    got = {r.doc_id: (r.text, r.n_removed, r.n_passage_words) for r in line_dedup.dedup_lines(df, passage_words=51).collect()}
    want = {1: (rows[0][1], 0, 0), 2: ("own one\nown two", 1, 60), 3: ("before it after it", 0, 60), 4: ("x\ny", 2, 60), 5: (rows[4][1], 0, 0), 6: ("z z", 0, 52), 7: (None, 0, 0), 8: (rows[7][1][: rows[7][1].index(" r ")] + " r", 0, 51)}
    assert got == want
    assert line_dedup.dedup_lines(df.where("false"), passage_words=51).count() == 0


def test_passages_against_brute_force(spark):
    rng = np.random.default_rng(9)
    pool = [[f"v{x}" for x in rng.integers(0, 3000, rng.integers(15, 60))] for _ in range(8)]
    texts = []
    for i in range(60):
        parts = [w for _ in range(4) for w in ([f"u{x}" for x in rng.integers(0, 9000, 9)] if rng.random() < 0.5 else pool[rng.integers(0, 8)])]
        texts.append((i, "".join(w + (" " if rng.random() < 0.9 else "\n") for w in parts)))
    seen, want = set(), {}
    for i, t in texts:
        w = WORD.findall(t)
        gone = set()
        for a in range(len(w) - 19):
            gone |= set(range(a, a + 20)) if tuple(w[a : a + 20]) in seen else set()
            seen.add(tuple(w[a : a + 20]))
        want[i] = ([x for j, x in enumerate(w) if j not in gone], len(gone))
    got = line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string"), min_lines=10**6, passage_words=20).collect()
    assert {r.doc_id: (WORD.findall(r.text), r.n_passage_words) for r in got} == want


def test_the_pipeline_removes_passages(spark):
    import corpus_pipeline

    p = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, p + "\nfirst", 0), (2, "own " + p + " text", 0), (3, p, 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_stage(spark, df, "").collect()}
    assert got == {1: (p + "\nfirst", 0), 2: ("own text", 8)}


def test_quality(docs):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for i, t in corpus():
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        grams = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        covered = {p for j in range(len(w) - 7) if grams[tuple(w[j : j + 8])] > 1 for p in range(j, j + 8)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)), i
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert r.kept == (not r.base_failed and not r.failed)
    assert quality.quality_rules(empty(docs)).count() == 0


def test_quality_is_one_projection(docs):
    plan = quality.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("Exchange RoundRobin", "") and "Python" not in plan


def test_mixing(spark, docs):
    rows = mixing.mix_sources(docs).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in corpus()} and len(rows) == len(corpus())
    total = sum(len(WORD.findall(t or "")) for _, t in corpus())
    targets = {r.source: (r.target, r.source_size) for r in rows}
    assert abs(sum(t for t, _ in targets.values()) - 1.5 * total) < 1e-6
    for source, (target, size) in targets.items():
        taken = sum(r.taken for r in rows if r.source == source)
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= max(0.05 * target, max(r.size for r in rows if r.source == source)), source
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    assert all(len(r.shards) == len(r.places) == r.copies for r in rows)
    again = {r.doc_id: (r.taken, r.shards, r.places) for r in mixing.mix_sources(docs.repartition(5)).collect()}
    assert again == {r.doc_id: (r.taken, r.shards, r.places) for r in rows}
    assert mixing.mix_sources(empty(docs)).count() == 0


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 100), ("d", 100), (None, 100)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    left, weights, bound = 1.5 * 410, {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, {"a": 20, "b": 200, "c": 200, "d": 200, None: 200}
    want = {}
    while True:
        rest = {s: w for s, w in weights.items() if s not in want}
        level = (left - sum(want.values())) / sum(rest.values())
        full = [s for s, w in rest.items() if level * w > bound[s]]
        if not full:
            want |= {s: level * w for s, w in rest.items()}
            break
        want |= {s: float(bound[s]) for s in full}
    assert {s: round(t, 9) for s, t in got.items()} == {s: round(t, 9) for s, t in want.items()}


@pytest.mark.parametrize("share", [1.5, 2.0, 0.7])
def test_quotas_of_shards_are_even(spark, share):
    """Shards differ by one given block of a source at most, and copies of a document lie in different halves of the tree."""
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 7 + 1).cast("int"))).alias("text"), F.element_at(F.array(*map(F.lit, "abcc")), (F.col("id") % 4 + 1).cast("int")).alias("source"))
    rows = mixing.mix_sources(df, share=share).collect()
    given = collections.defaultdict(set)
    for r in rows:
        for copy, (shard, place) in enumerate(zip(r.shards, r.places, strict=True)):
            given[r.source, shard].add((place[:2], copy))
        assert len(r.shards) < 2 or r.shards[0] // 8 != r.shards[1] // 8
    for source in "abc":
        n = [len(given[source, shard]) for shard in range(16)]
        assert max(n) - min(n) <= 1, (source, n)
    n = [sum(len(given[source, shard]) for source in "abc") for shard in range(16)]
    assert max(n) - min(n) <= 3
    words_of = collections.Counter()
    for r in rows:
        for shard in r.shards:
            words_of[shard] += r.size
    assert max(words_of.values()) < 1.5 * min(words_of.values())


def test_blocks_and_shards_follow_the_words(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("s").alias("source"))
    rows = mixing.mix_sources(df, block_words=1, shard_words=40).collect()
    assert {len(p.split("-")[0]) for r in rows for p in r.places} == {3} and 50 < len({x for r in rows for x in r.shards}) <= 128
    assert sum(r.taken for r in rows) == 3000


def test_mixing_repeated_ids_equal_sizes_and_shards_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(i % 40, "one two three", "s" if i % 2 else None) for i in range(80)] + [(None, "x y z", None)], "doc_id long, text string, source string").withColumn("shard", F.lit("clash"))
    mixed = mixing.mix_sources(df)
    rows = mixed.collect()
    by = {}
    assert all(by.setdefault((r.doc_id, r.source), (r.taken, r.shards)) == (r.taken, r.shards) for r in rows) and len(rows) == 81
    mixing.write_shards(mixed.drop("shard"), str(tmp_path / "mix"))
    assert spark.read.parquet(str(tmp_path / "mix")).count() == sum(r.copies for r in rows)


@pytest.mark.parametrize("share", [1.5, 1.1, 0.4])
def test_mixing_rows_that_share_an_id_meet_the_target(spark, share):
    """A source of equal rows, one of one id with many texts, one with a null id: each within a row of its target, none lost."""
    data = [(1, "x x x x x x x x x x", "a", i) for i in range(900)] + [(2, " ".join(["y"] * (5 + i % 9)) + f" {i}", "b", i) for i in range(600)] + [(None, "z z", "c", i % 2) for i in range(700)] + [(i, f"q {i}", None, i) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, other long").repartition(5)
    rows = mixing.mix_sources(df, share=share).collect()
    assert sorted((r.doc_id or 0, r.text, r.source or "", r.other) for r in rows) == sorted((i or 0, t, s or "", o) for i, t, s, o in data)
    taken, target = collections.Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size and len(r.shards) == r.copies == len(r.places)
    assert all(abs(taken[s] - target[s]) <= 10 for s in target), (taken, target)
    again = collections.Counter((r.doc_id, r.text, r.source, r.other, r.taken, tuple(r.shards)) for r in mixing.mix_sources(df.repartition(3), share=share).collect())
    assert again == collections.Counter((r.doc_id, r.text, r.source, r.other, r.taken, tuple(r.shards)) for r in rows)


def test_suffix_dedup_of_a_passage_in_many_contexts(spark, monkeypatch):
    """No bucket holds the contexts of a hot passage, and the result is that of counting strings."""
    rng = np.random.default_rng(4)
    noise = lambda n: " ".join(f"{x:x}" for x in rng.integers(0, 16**3, n))
    passage, shared = noise(110)[:420], noise(40)
    data = [(i, noise(20) + (shared if i % 3 == 0 else "") + passage + noise(20)) for i in range(600)] + [(700, noise(60000)), (701, noise(3000) + passage)]
    want = {}
    count = collections.Counter()
    for _, t in data:
        count.update({t[i : i + 60]: t.count(t[i : i + 60]) for i in range(len(t) - 59)} if len(t) < 5000 else collections.Counter(t[i : i + 60] for i in range(len(t) - 59)))
    for i, t in data:
        gone = np.zeros(len(t) + 1, int)
        for p in range(len(t) - 59):
            if count[t[p : p + 60]] > 1:
                gone[p] += 1
                gone[p + 60] -= 1
        want[i] = "".join(x for x, g in zip(t, np.cumsum(gone), strict=False) if not g)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    most = spark.sparkContext.accumulator(0)
    plain = suffixes.suffix_classes

    def counted(data, off, *rest):
        most.add(0 if len(data) < 60000 else 1)  # a bucket of over twice bucket_bytes
        return plain(data, off, *rest)

    monkeypatch.setattr(suffixes, "suffix_classes", counted)
    got = {r.doc_id: r.text for r in suffixes.suffix_dedup(df, min_bytes=60, block_bytes=20000, bucket_bytes=30000).collect()}
    assert got == want and most.value == 0
    got = {r.doc_id: r.text for r in suffixes.suffix_dedup(df, min_bytes=60, block_bytes=20000, bucket_bytes=600).collect()}  # down to single strings
    assert got == want


def test_alignment_takes_little_memory_and_gives_a_longest_sequence():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = ([chr(97 + x) for x in rng.integers(0, 5, rng.integers(0, 25))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        got, it = html_text.common_lines(a, b), iter(b)
        assert len(got) == table[-1, -1] and all(a[i] in it for i in sorted(got))
    n = 20000
    a, b = [f"{i % 17}" if i % 4 == 0 else f"l{i}" for i in range(n)], [f"{i % 17}" if i % 4 == 0 else f"l{i}" if i % 3 else f"m{i}" for i in range(n)]
    tracemalloc.start()
    assert len(html_text.common_lines(a, b)) >= n // 2
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("kept", ['<pre><span class="hljs-comment">c</span></pre>', '<code><span class="token comment">c</span></code>', '<div class="market-share">c</div>', '<section class="file-menu">c</section>', '<p class="release-notice">c</p>', '<em id="ad">c</em>'])
def test_names_do_not_take_what_an_article_is_about(kept):
    assert ("c", True) in html_text.page_lines(f"<html><body><nav>menu</nav><article><p>text</p>{kept}</article></body></html>")


@pytest.mark.parametrize("gone", ['<div class="ad">c</div>', '<section id="comments">c</section>', '<div class="post-comments">c</div>', '<ul class="share-buttons"><li>c</li></ul>', '<div class="related-posts">c</div>', "<aside>c</aside>", '<div class="cookie-notice">c</div>'])
def test_furniture_in_an_article_goes(gone):
    assert html_text.page_lines(f"<html><body><article><p>text</p>{gone}</article></body></html>") == [("text", True)]


def test_urls_stay_what_they_are_in_archives(spark, tmp_path):
    urls_ = ["http://x.com/a%20b~c?q=é&r=1+2#f", "http://x.com/a b\tc\n", "", None, "http://x.com/[1]|{2}"]
    warc.write_warc(spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls_)], "page_id long, url string, html string"), str(tmp_path / "w"))
    got = {r.record_id: r.target_uri for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert got == {f"urn:page:{i}": (u or "").replace(" ", "%20").replace("\t", "%09").replace("\n", "%0A") for i, u in enumerate(urls_)}


def vectors():
    x = RNG.standard_normal((40, 16))
    x[10:20] = x[0] + 0.08 * RNG.standard_normal((10, 16))
    x[20] = 3 * x[1]
    x[21] = x[2]
    out = [(i, [float(np.float32(v)) for v in x[i]], int(i % 2 == 1 and i < 10) if i < 30 else 7) for i in range(40)]
    out += [(50, None, 0), (51, [0.0] * 16, 0), (52, [float("nan")] * 16, 0), (53, [None] * 16, 0), (54, out[0][1], None), (55, [], 0), (56, [1.0], 0), (57, [2.0], 0), (58, [float("inf")] * 16, 0)]
    return out


def test_near_vectors(spark, monkeypatch):
    data = vectors()
    sound = {i: (l, np.array(v, float)) for i, v, l in data if l is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    edges = [(i, j) for i in sound for j in sound if i < j and sound[i][0] == sound[j][0] and len(sound[i][1]) == len(sound[j][1]) and cos(sound[i][1], sound[j][1]) >= 0.98]
    degree, root = collections.Counter(x for e in edges for x in e), union(edges, [i for i, _, _ in data])
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect()}
    assert got == {i: (degree[i], root[i], root[i] == i) for i, _, _ in data}
    assert embeddings.near_vectors(df.where("false")).count() == 0


def test_near_vectors_over_cells_bands_and_tiles(spark, monkeypatch):
    """A label of many small cells with repeats over bands, groups of near copies larger than a tile, and ids that repeat."""
    monkeypatch.setattr(embeddings, "CELL_ROWS", 16)
    monkeypatch.setattr(embeddings, "TILE_ROWS", 24)
    rng = np.random.default_rng(11)
    x = rng.standard_normal((900, 24))
    x[300:360] = x[0] + 0.1 * rng.standard_normal((60, 24))
    for i in range(400, 700, 3):
        x[i + 1] = x[i] + 0.13 * rng.standard_normal(24)
        x[i + 2] = x[i + 1] + 0.13 * rng.standard_normal(24)
    ids = np.arange(900)
    ids[[850, 851]] = [0, 401]  # second vectors of these ids
    x[851] = x[10] * 2
    label = np.where(np.arange(900) < 800, 0, 1)
    label[850:852] = 0
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(900, dtype=bool)
    edges = [(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(near), strict=True)]
    root = union(edges, {int(i) for i in ids})
    df = spark.createDataFrame([(int(i), [float(c) for c in v], int(k)) for i, v, k in zip(ids, x, label, strict=True)], "vec_id long, embedding array<double>, label int").repartition(3)
    got = collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect())
    want = collections.Counter((int(i), int(near[k].sum()), root[int(i)], root[int(i)] == i) for k, i in enumerate(ids))
    assert near.sum() > 1000
    found, due = (sum(n * c for (_, n, _, _), c in x.items()) for x in (got, want))
    assert found / due > 0.999  # recall of link ends
    assert got == want


def test_codes_bound_the_products():
    x = RNG.standard_normal((300, 64))
    x[150:] = x[:150] + 0.1 * RNG.standard_normal((150, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rotated, signs, factor = embeddings.encode(x, 7)
    est, exact = embeddings.estimate(rotated, signs, factor), x @ x.T
    assert (est >= embeddings.least_estimate(factor, 64, 0.98, 8.0))[exact >= 0.98].all()
    assert abs((est - exact)[np.abs(exact) < 0.5].mean()) < 0.01


@pytest.mark.parametrize("dim", [1, 2, 64])
def test_stored_codes_leave_every_link_open_and_few_others(dim):
    x = RNG.standard_normal((400, dim))
    x[200:] = x[:200] + (0.1 if dim > 2 else 0.02) * RNG.standard_normal((200, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code = embeddings.packed_codes(x, 7)
    left, right = np.arange(0, 400, 2), np.arange(1, 400, 2)
    a, b = embeddings.open_pairs(code, left, right, 0.98, 8.0)
    links = {(i, j) for i in left.tolist() for j in right.tolist() if x[i] @ x[j] >= 0.98}
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    assert links <= found and (dim < 64 or len(found) < len(links) + 400) and all(len(c) == dim + 24 for c in code)


def test_pieces_are_exact_draws_without_replacement():
    vocab = pieces.vocabulary(pieces.DEFAULT_MODEL, 1.0)
    text, n = b"then a", 6000
    found = collections.defaultdict(list)
    probability = {}
    shared = pieces.Shared(vocab)
    estimate = collections.Counter()
    for d, _, ids, log, value, score in pieces.sample_chunk(shared, [text] * n, mix(np.arange(n, dtype=np.uint64)), 3):
        t = tuple(ids.tolist())
        found[d].append((t, value))
        probability[t] = np.exp(log)
        estimate[t] += np.exp(log) / score / n
    assert all(len({t for t, _ in x}) == len(x) == 3 and sorted((v for _, v in x), reverse=True) == [v for _, v in x] for x in found.values())
    first = collections.Counter(x[0][0] for x in found.values())
    for t, c in first.most_common(4):
        assert abs(c / n - probability[t]) < 0.025
        assert abs(estimate[t] - probability[t]) < 0.03


def test_pieces_round_trip(spark, docs):
    odd = spark.createDataFrame([(100, " lead  two   spaces "), (101, "▁ literal"), (102, "日本語 \U0001f600 x\x00y"), (103, "a" * 3000), (None, "null id")], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(odd).withColumn("rank", F.lit("clash"))
    got = pieces.decode_pieces(pieces.sample_pieces(df, k=2)).collect()
    text = {r.doc_id: r.text or "" for r in df.collect()}
    assert all(r.round_trip and r.text == text[r.doc_id] for r in got)
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add(tuple(r.ids))
    assert all(len(by[i]) == (2 if len(t) > 1 else len(by[i])) for i, t in text.items() if t.strip())
    again = {(r.doc_id, r.rank): tuple(r.ids) for r in pieces.sample_pieces(df.repartition(7), k=2).collect()}
    assert again == {(r.doc_id, r.rank): tuple(r.ids) for r in got}
    assert pieces.sample_pieces(empty(docs)).count() == 0


def test_pieces_of_repeated_rows_are_the_same(spark):
    t = " ".join(words(12, 9999))
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t), (None, t), (3, None), (4, "")], "doc_id long, text string").repartition(3)
    got = collections.defaultdict(list)
    for r in pieces.sample_pieces(df, k=3).collect():
        got[r.doc_id, r.rank].append(tuple(r.ids))
    assert all(len(set(x)) == 1 for x in got.values()) and len(got[1, 0]) == len(got[None, 0]) == 2 and got[3, 0] == got[4, 0] == [()]
    assert [got[1, i] for i in range(3)] != [got[2, i] for i in range(3)]


def test_very_long_urls(spark):
    data = [(1, "http://" + "a." * 50_000 + "net/de/8" + "/x" * 100_000), (2, "http://example.net" + "/" * 300_000), (3, "x" * 500_000), (4, "http://x.com/en/" + "é" * 200_000)]
    got = {r.page_id: (r.rule, r.verdict, len(r.path)) for r in urls.url_rules(spark.createDataFrame(data, "page_id long, url string"), urls.contract_rules(spark)).collect()}
    assert got == {1: ("net/de/", "allow", 200_005), 2: (None, "allow", 300_000), 3: (None, "allow", 0), 4: ("com/en/", "block", 200_004)}


def test_quality_of_null_ids_and_repeated_rows(spark):
    good = " ".join(["the", *words(40, 99999)])
    df = spark.createDataFrame([(None, good), (None, good), (1, good), (1, good), (None, None), (2, "")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.kept, r.n_words) for r in quality.quality_digest(df).collect()) == [("1", True, 41), ("1", True, 41), ("2", False, 0), ("None", False, 0), ("None", True, 41), ("None", True, 41)]


def test_url_rules(spark):
    data = ["https://a.example.com/en/71?x", "http://example.com/en/", "ftp://X.NET/de/1#y", "http://net/de/8", "http://b.example.net/de/81", "http://notexample.net/de/8", "org/es/", "http://x.org/es", "http://x.org/es/a//b", None, "", "a://b://c.org/es/?", "http://x.org:80/es/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(data)] + [(0, data[0])], "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = urls.contract_rules(spark)

    def judge(u):
        m = re.search(r"(?s)://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        return host, path, best[0] + best[1] if best else None, best[2] if best else "allow"

    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.url_rules(df, rules).collect()]
    assert sorted(got, key=str) == sorted([(i, *judge(u)) for i, u in enumerate(data)] + [(0, *judge(data[0]))], key=str)
    assert urls.url_rules(df.where("false"), rules).count() == 0
    assert {r.verdict for r in urls.url_rules(df, rules.where("false")).collect()} == {"allow"}


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><article>";</script></head><body><header>top</header><nav><ul><li>menu</li></ul></nav>
<div class="cookie-notice">we use</div><article><h1>Head &amp; more</h1><p><b>One
two.<br><p>Three <i>four</i>&#233;<form>no</form><div class="share-box">tweet</div><ul><li>x<li>y</ul><!-- gone <p>no --></article><section id="comments"><p>first!</p></section><aside>side</aside><footer>foot</footer>"""


def test_page_text():
    assert html_text.main_text(html_text.page_lines(PAGE), None) == "Head & more\n\nOne two.\n\nThree fouré\n\nx\n\ny"
    assert html_text.page_lines("") == [] and html_text.page_lines("a < b & c") == [("a < b & c", False)]
    assert html_text.page_lines("<p>open <script>never ends") == [("open", False)]


def test_common_lines():
    for _ in range(300):
        a, b = (["abcd"[x] for x in RNG.integers(0, 4, RNG.integers(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got, it = html_text.common_lines(a, b), iter(b)
        assert len(got) == best[-1][-1] and all(x in it for x in [a[i] for i in sorted(got)])


def test_extract_text(spark):
    plain = "<div>site name</div><p>own {}</p><div>all rights</div>"
    data = [(1, "http://h/a/1", PAGE), (2, "http://h/a/2", plain.format(2)), (3, "http://h/a/3", plain.format(3)), (4, "http://other/x", plain.format(4)), (5, None, None), (6, "bad", ""), (7, "http://h/a/1", PAGE)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    for size in (8 << 20, 60):
        got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_text(df, group_bytes=size).collect()}
        assert got[1] == got[7] and got[1][0].startswith("Head & more") and got[5] == got[6] == ("", 0) and len(got) == 7
        assert got[4][0] == "site name\n\nown 4\n\nall rights"
    got = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    assert got[3] == "own 3"
    assert html_text.extract_text(df.where("false")).count() == 0


def test_furniture_names_are_whole_or_last_parts():
    body = "<p>" + "word " * 30 + "</p><div class='widget'>side</div>"
    for name in ("container has-sidebar", "with-sidebar", "no-sidebar", "has-header", "article-comments-off", "content ad-free", "page widget-page", "social-science", "page--sidebar"):
        assert html_text.page_lines(f"<div class='{name}'><p>little</p></div>{body}")[0] == ("little", False), name
    for name in ("ad", "main-nav", "share-box", "related-posts", "ad-slot-3", "site_footer", "header--dark", "sidebar-left"):
        assert [x for x, _ in html_text.page_lines(f"<div class='{name}'><p>little</p></div>{body}")] == [("word " * 30).strip()], name


def test_furniture_never_takes_an_article_or_most_of_a_page():
    assert html_text.page_lines("<div class='sidebar'><div class='ad'>buy</div><article>body</article></div><p>" + "long " * 30) == [("body", True), (("long " * 30).strip(), False)]
    assert html_text.page_lines("<form id=f><p>the whole of the text</p><div class='menu'>a b</div></form><p>rest</p>") == [("the whole of the text", False), ("rest", False)]
    assert html_text.page_lines("<aside><article>teaser</article></aside><p>own</p>") == [("own", False)]


def test_neighbours_do_not_depend_on_group_bytes_or_copies(spark):
    page = "<div>site name</div><p>own {}</p><div>all rights</div>"
    data = [(i, f"http://h/en/{i:02}", page.format(i)) for i in range(12)]
    data += [(20, "http://h/fr/1", page.format(20)), (3, "http://h/en/03", page.format(3)), (31, "http://h/en/03/print", page.format(3)), (40, "http://h/en/05x", ""), (41, "http://h/en/05x", None), (50, "http://alone/", page.format(50)), (51, "http://alone/b", page.format(50))]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    for size in (8 << 20, 1000, 60):
        got = sorted((r.page_id, r.text) for r in html_text.extract_text(df, group_bytes=size).collect())
        want = [(i, f"own {3 if i == 31 else i}") for i, _, h in data if h and i < 50] + [(i, "") for i in (40, 41)] + [(i, "site name\n\nown 50\n\nall rights") for i in (50, 51)]
        assert got == sorted(want), size


def test_neighbours_of_many_slices_and_runs_of_copies(spark):
    """Hosts that end in a slice, span many, or are all copies: neighbours are those of a plain search."""
    rng = np.random.default_rng(4)
    data = []
    for i in range(120):
        host, body = "abc"[int(rng.integers(0, 3))], int(rng.integers(0, 3)) if rng.random() < 0.8 else i
        data.append((i, f"http://{host}/{'x' if rng.random() < 0.5 else 'y'}/{int(rng.integers(0, 60)):02}", f"<div>site</div><p>own {body}</p><div>{'even' if i % 2 else 'odd'}</div>"))
    data += [(200 + i, f"http://copies/{i}", "<p>same</p>") for i in range(20)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    keys = {(r.page_id): (r.url.split("/")[2], "/" + r.url.split("/", 3)[3], r.tie) for r in df.withColumn("tie", F.xxhash64("page_id", "html")).collect()}
    order = sorted(data, key=lambda r: (keys[r[0]][0].encode(), keys[r[0]][1].encode(), keys[r[0]][2]))
    want = {}
    for i, (page, _, body) in enumerate(order):
        host, path, _ = keys[page]
        near = [next((r for r in side if keys[r[0]][0] == host and r[2] != body), None) for side in (order[:i][::-1], order[i + 1 :])]
        best = max((r for r in near if r), key=lambda r: html_text._likeness(path, keys[r[0]][1]), default=None)
        want[page] = html_text.main_text(html_text.page_lines(body), best and html_text.page_lines(best[2]))
    for size in (8 << 20, 700, 30):
        assert {r.page_id: r.text for r in html_text.extract_text(df, group_bytes=size).collect()} == want, size


def test_a_neighbour_changes_the_result(spark):
    page = "<div>site name</div><header>top</header><p>own {0}</p><ul><li>one<li>two</ul><div>all rights</div>"
    rows = [(i, f"http://h/{i}", page.format(i)) for i in (1, 2)]
    get = lambda x: {r.page_id: (r.text, r.n_shared) for r in html_text.extract_text(spark.createDataFrame(x, "page_id long, url string, html string")).collect()}
    assert get(rows) == {1: ("own 1", 5), 2: ("own 2", 5)}
    assert get(rows[:1]) == {1: ("site name\n\nown 1\n\none\n\ntwo\n\nall rights", 0)}
    assert get([rows[0], (3, "http://h/3", rows[0][2])])[1] == get(rows[:1])[1]  # a copy is no neighbour


@pytest.mark.parametrize("piece", ["<a ", '<a ="', "<a ='", "<!", "<!--", "<", "</", "<a b=\"x\" ", "<div></span>", "<div>", "<b></i>", "<p><b>", "&#" + "9" * 30, "<script>", "<a>'", "class=", "<li><div><b>", '<a class="ad" ', "&", "<form><article>"])
def test_pages_are_parsed_in_linear_time(piece):
    start = time.monotonic()
    html_text.all_lines(piece * (1_000_000 // len(piece)))
    assert time.monotonic() - start < 20


def test_odd_markup():
    plain = lambda x: [t for t, _ in html_text.page_lines(x)]
    assert plain("<p>a<p title=\"x > y\">b<p don't>c") == ["a", "b", "c"]
    assert plain("<p>a &#" + "9" * 6000 + "; &#" + "0" * 6000 + "65; &#x" + "f" * 6000 + ";") == ["a \ufffd A \ufffd"]
    assert plain("text <b unclosed") == ["text"]
    assert plain("<li><b>x<div><i><li>y</li></i></div>") == ["x", "y"]


def test_differencing_decides_outside_of_articles():
    page = "<div>site name</div><div>body {0}</div><div>more {0}</div><article>teaser {0}</article><div>all rights</div>"
    lines = [html_text.page_lines(page.format(i)) for i in (1, 2)]
    assert html_text.main_text(lines[0], lines[1]) == "body 1\n\nmore 1\n\nteaser 1"
    assert html_text.main_text(lines[0], None) == "site name\n\nbody 1\n\nmore 1\n\nteaser 1\n\nall rights"


def test_warc(spark, tmp_path):
    long = "<p>" + "x" * 1200 + "é"
    fake = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nrest"
    data = [(1, "http://a/ b\r\nX: y", long), (2, "http://a/2", long), (3, None, long), (4, "u", fake), (5, "u", None), (6, "u", ""), (7, "u", "small"), (8, "u", "small"), (None, "u", long)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit(0)).repartition(2)
    path = str(tmp_path / "w")
    got = {r.record_id: r for r in warc.archived(df, path, with_payload=True).collect()}
    assert len(got) == len(data) and all(r.digest_ok for r in got.values())
    for i, _, h in data:
        r, body = got[f"urn:page:{'null' if i is None else i}"], (h or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        revisit = h == long and i != 3
        assert (r.type, r.refers_to) == (("revisit", "urn:page:3") if revisit else ("response", None))
        assert bytes(r.payload) == (b"" if revisit else body)
    assert warc.archived_digest(df.where("false")).count() == 0


def test_chains_skip_what_payloads_hold():
    inner = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    record = lambda p: b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(p), p)
    data = record(b"a" + inner) + record(inner) + record(b"")
    found = warc.candidates(data)
    on = warc.reachable(np.array([f[0] for f in found]), np.array([f[1] for f in found]))
    assert len(found) == 5 and on.sum() == 3
    assert gzip.decompress(gzip.compress(data)) == data and html.unescape("&lt;") == "<"


def hostile_pages():
    head = "\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\nX-Payload-Length: {}\r\nContent-Length: {}\r\n\r\nab\r\n\r\n"
    bodies = [head.format("abc", 2), head.format("7", "²"), head.format("7", "9" * 5000), head.format("9" * 5000, 2), head.format("²", 2) * 2, "WARC/1.1\r\n" * 90_000, "WARC/1.1\r\nA: b\r\n" * 60_000, "X: WARC/1.1\r\n" * 70_000 + "\r\n"]
    return bodies + ["\r\n\r\n", "z" * 1_000_000, head.format(1, 2) * 9000]


def test_warc_survives_what_pages_hold(spark):
    data = [(i, "http://a/WARC/1.1", h) for i, h in enumerate(hostile_pages())] + [(100, "http://a/" + "u" * 200_000, "x")]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    start = time.monotonic()
    got = {r.page_id: r for r in warc.archived_digest(df).collect()}
    assert {i: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for i, r in got.items()} == {i: (len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "response", None) for i, _, h in data}
    assert time.monotonic() - start < 60


def test_warc_files_are_bounded_by_bytes(spark, tmp_path):
    data = [(i, "u", f"{i} " + "y" * (400_000 if i % 3 == 0 else 50)) for i in range(30)]
    warc.write_warc(spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"), records_a_file=64, file_bytes=1 << 20)
    sizes = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "w").rglob("*.gz")]
    assert max(sizes) < 1.1 * (1 << 20) and len(warc.read_warc(spark, str(tmp_path / "w")).collect()) == 30


def test_a_broken_chain_ends_and_odd_lengths_count_as_none(spark, tmp_path):
    record = lambda p, extra="": f"WARC/1.1\r\nWARC-Type: revisit\r\nX-Payload-Length: {extra}\r\nContent-Length: {len(p)}\r\n\r\n{p}\r\n\r\n".encode()
    (tmp_path / "x.warc").write_bytes(record("", "abc") + record("", "²") + record("ab", "12") + record("lost")[:-3])
    assert sorted(r.payload_bytes for r in warc.read_warc(spark, str(tmp_path)).collect()) == [0, 0, 12]


def test_components(spark):
    from fleetlens.llm._components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    want = union([(a, b) for a, b in edges if a is not None and a != b], {x for e in edges for x in e if x is not None})
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_below_the_threshold_make_few_pairs(spark, monkeypatch):
    """Changed copies that just miss a group of near copies are not paired with all of its members; links stay those of brute force."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]

    def changed(n):
        w = list(base)
        for i in 1 + rng.choice(58, n, replace=False):
            w[5 * int(i) + 2] = f"x{rng.integers(0, 10**9)}"
        return " ".join(w)

    texts = [changed(n) for n in [*[3] * 60, *[6] * 20]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = []
    verified = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *a: asked.append(pairs) or verified(pairs, *a))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()}
    sets = {i: brute_shingles(t) for i, t in enumerate(texts)}
    assert got == union([(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], sets)
    assert asked[1].count() <= 100


def test_a_second_segmentation_draws_only_what_is_new(monkeypatch):
    drawn, cut = [], pieces.cut_gumbel
    monkeypatch.setattr(pieces, "cut_gumbel", lambda location, *a: drawn.append(len(location)) or cut(location, *a))
    bodies = [f"the quick brown fox number {i} jumps over the lazy dog and runs home again".encode() for i in range(20)]
    found = list(pieces.sample_chunk(pieces.Shared(pieces.vocabulary(pieces.DEFAULT_MODEL, 1.0)), bodies, np.arange(1, 21, dtype=np.uint64), 2))
    assert len(found) == 40 and sum(drawn) < sum(len(x[2]) for x in found)
