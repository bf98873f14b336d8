"""Importance resampling, exact copies and collocations against brute force on small tables with odd rows."""

import collections
import functools
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import _tokens, exact, importance, phrases

RNG = np.random.default_rng(11)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@functools.cache
def rows():
    """(doc_id, text, lang): copies, near copies, empty and null texts, repeated and null ids, very long texts and words."""
    vocabulary = [f"w{i}" for i in range(12)] + ["Été", "ß", "日本", "x" * 90]
    some = lambda n: " ".join(RNG.choice(vocabulary, n))
    long = some(9000)
    out = [(i, some(int(RNG.integers(1, 90))).replace("w3 ", "w3, ").replace("w7 ", "w7\n"), ("de", "en", None)[i % 3]) for i in range(40)]
    out += [(40, long, "en"), (41, long, "en"), (42, long[:-1] + "!", "en"), (43, "", "de"), (44, None, None), (45, " \t\n", "fr"), (46, "one two", "fr"), (46, "one two", "fr"), (46, "one three", "fr"), (None, "one two", "fr"), (None, "alone", "x\ny"), (None, "alone", "x\ny")]
    out += [(50 + i, "New York is New York. new york IS, new york is big", "en") for i in range(7)] + [(60, "y" * 5000, "de"), (61, "y" * 5000 + "z", "de"), (62, "A-B c\x00d\x7fe", "de")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("clash") for c in ("id", "body", "print", "sha", "n", "n_bytes", "kept", "rank", "score", "range", "total", "_", "row", "slot", "c")}).repartition(3)


def rounded(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


# exact copies


def brute_copies():
    groups = collections.defaultdict(list)
    for i, t, _ in rows():
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        stays = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and stays, hashlib.sha256(t.encode()).hexdigest()))
            stays = stays and i != keep
    return sorted(out, key=str)


COPY = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 300, "spread_bytes": 700}, {"chunk_bytes": 300, "slots": 1}])
def test_exact_copies(docs, options):
    assert rounded(exact.exact_copies(docs, **options), *COPY) == brute_copies()


def test_exact_copies_of_an_empty_table(docs):
    assert exact.exact_copies(docs.where("false")).count() == 0
    assert exact.without_copies(docs.where("false")).columns == docs.columns


def test_what_stays_has_all_columns(docs):
    got = exact.without_copies(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=str) == sorted(((i, t or "") for i, t in {(k, t or "") for k, t, _ in rows() if k == max((i for i, u, _ in rows() if (u or "") == (t or "") and i is not None), default=None)}), key=str)


def test_fingerprints_are_the_polynomial_and_compose():
    values = [bytes(RNG.integers(0, 256, int(n), dtype=np.uint8)) for n in (0, 1, 255, 256, 257, 5000, 70000)]
    off = np.cumsum([0, *map(len, values)])
    got = exact.chunk_hashes(np.frombuffer(b"".join(values), np.uint8), off)
    for v, h in zip(values, got, strict=True):
        for p, b, x in zip(exact.PRIMES.tolist(), exact.BASES.tolist(), h.tolist(), strict=True):
            want = 0
            for byte in v:
                want = (want * b + byte + 1) % p
            assert x == want
    whole = exact._fingerprints(pa.array(values, pa.binary()), 300, 4)
    assert (whole == got).all()
    left, right = exact.chunk_hashes(np.frombuffer(values[5], np.uint8), np.array([0, 1234, 5000]))[:, None]
    assert (exact.combine(left, right, np.array([5000 - 1234])) == got[5]).all()


def test_texts_that_share_a_fingerprint_stay_apart(spark):
    """Texts of one lane that collide, found by trying many."""
    raw = RNG.integers(97, 123, (400000, 9), dtype=np.uint8)
    prints = exact.chunk_hashes(raw.ravel(), np.arange(len(raw) + 1) * 9, 1)[:, 0]
    order = np.argsort(prints, kind="stable")
    same = np.flatnonzero(np.diff(prints[order]) == 0)
    pairs = [(raw[order[i]].tobytes().decode(), raw[order[i + 1]].tobytes().decode()) for i in same]
    pairs = [p for p in pairs if p[0] != p[1]][:3]
    assert pairs
    data = [(i, t) for i, t in enumerate([*(x for p in pairs for x in p), pairs[0][0], pairs[0][0], "other"])]
    got = exact.exact_copies(spark.createDataFrame(data, "doc_id long, text string"), lanes=1, chunk_bytes=4)
    last = {t: i for i, t in data}
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got.collect()) == sorted((i, last[t], sum(u == t for _, u in data)) for i, t in data)


def test_a_group_of_a_third_of_all_rows(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = exact.exact_copies(df)
    assert got.where("kept").count() == 2001 and got.where("group_size = 1000 and keep_id = 2997").count() == 1000


# importance resampling

FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(t):
    w = FEATURE.findall(lower(t))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_scores(data, target, percent, min_words):
    s, t = collections.Counter(), collections.Counter()
    for _, x, _ in data:
        s.update(brute_features(x)[1])
    for x in target:
        t.update(brute_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for i, x, _ in data:
        n, f = brute_features(x)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = place
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize(("percent", "min_words"), [(5, 20), (60, 1), (100, 0)])
def test_importance_sample(spark, docs, percent, min_words):
    target = ["New York is big", None, "", "w1 w2 w3 w4 été ß"]
    bench = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got = importance.importance_sample(docs, bench, percent=percent, min_words=min_words)
    assert rounded(got, *got.columns) == brute_scores(rows(), target, percent, min_words)
    assert importance.importance_sample(docs.where("false"), bench).count() == 0
    assert importance.importance_sample(docs, bench.where("false")).count() == len(rows())


def test_features_in_any_windows():
    texts = [t for _, t, _ in rows()] + ["a b c"] * 600
    want = [collections.Counter(brute_features(t)[1]) for t in texts]
    planes = importance.gain_planes(np.arange(-5000, 5000))
    for window in (7, 100, 1 << 20):
        got = [collections.Counter() for _ in texts]
        for _, at, bucket in importance.features(pa.array(texts), window=window):
            for r, b in zip(at.tolist(), bucket.tolist(), strict=True):
                got[r][b] += 1
        assert got == want
    for window in (100, 1 << 20):
        n, f, w = importance.weighed(pa.array(texts), planes, window)
        assert f.tolist() == [sum(c.values()) for c in want] and w.tolist() == [sum((b - 5000) * k for b, k in c.items()) for c in want]
        assert n.tolist() == [brute_features(t)[0] for t in texts]


def test_a_window_does_not_end_before_a_capital():
    """A window ends between two words, and capitals in a word are of it: over 1 MB a word was cut before one."""
    texts = ["fooBar ABC aB-Cd éÉE " * 5, "X" * 50, None, "iPhone McDonald"]
    planes = importance.gain_planes(np.arange(-5000, 5000))
    for window in range(1, 40):
        n, f, w = importance.weighed(pa.array(texts), planes, window)
        assert [(a, b, c) for a, b, c in zip(n.tolist(), f.tolist(), w.tolist(), strict=True)] == [(k, len(found), sum(b - 5000 for b in found)) for k, found in map(brute_features, texts)]
    long = "x" * ((1 << 20) - 3) + " aaBBcc dd"
    n, f, _ = importance.weighed(pa.array([long]), planes)
    assert n.tolist() == [3] and f.tolist() == [6]


def test_bit_planes_give_the_sums():
    counts = RNG.integers(0, 1 << 20, (7, 10000)) * (RNG.random((7, 10000)) < 0.1)
    gain = RNG.integers(-12000, 9000, 10000)
    assert (importance.weigh(counts, importance.gain_planes(gain)) == counts @ gain).all()
    assert (importance.weigh(counts, importance.gain_planes(np.zeros(10000, np.int64))) == 0).all()
    assert importance.weigh(counts[:0], importance.gain_planes(gain)).tolist() == []


# collocations


def brute_phrases(data, most=3, least=10, share=50, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, t, lang in data:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, most + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = collections.Counter()
        for p, a in cand.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        found = []
        for p, a in cand.items():
            if p in inside and 100 * inside[p] >= share * a:
                continue
            cuts = [(1000000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"least": 3, "top": 50, "range_bytes": 40, "shard_words": 500}, {"most": 4, "least": 4, "shard_words": 3000}, {"most": 2, "least": 2, "share": 90}])
def test_collocations(docs, options):
    settings = {k: v for k, v in options.items() if k in ("most", "least", "share", "top")}
    assert sorted(tuple(r) for r in phrases.collocations(docs, **options).collect()) == brute_phrases(rows(), **settings)


def test_collocations_of_nothing(docs):
    assert phrases.collocations(docs.where("false")).count() == 0
    assert phrases.collocations(docs.where("text is null")).count() == 0


def test_counts_beyond_64_bits():
    """Products of counts pass 64 bits; scores stay exact."""
    a, l, r = 3_000_000_007, 3_000_000_011, 3_000_000_019
    words = pa.array([b"p", b"q"], pa.large_binary())
    zero = np.zeros(0, np.int64)
    known, _ = phrases.paths(words, [([np.array([0])], np.array([l])), ([np.array([1])], np.array([r]))], 2)
    own, _ = phrases.paths(words, [([np.array([0]), np.array([1])], np.array([a]))], 2)
    none = phrases.Automaton(pa.array([], pa.large_binary()), [(zero, zero, zero)] * 2)
    (row,) = phrases.scored(own, known, none, 50)
    assert row["score"].tolist() == [1000000 * a * a // (l * r)] and row["phrase"].to_pylist() == ["p q"]


def test_automata_unite_and_compose():
    streams = [RNG.integers(0, 6, int(n)) for n in (0, 1, 500, 900)]
    want, parts = collections.Counter(), []
    for s in streams:
        words = [b"w%d" % x for x in s]
        want.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
        whole = phrases.built(pa.array(words, pa.large_binary()), np.arange(len(s)) == 0, 3, len(s))
        cut = [phrases.Automaton.of(p.columns()) for _, p in phrases.dealt(whole, "en", 7)]
        assert sum(int(p.levels[0][2].sum()) for p in cut) == len(s)
        parts += cut
    one = phrases.union(parts)

    def listed(a):
        names = a.words.to_pylist()
        return {tuple(names[c[i]] for c in a.symbols_at(k)): int(w) for k, (_, _, ws) in enumerate(a.levels) for i, w in enumerate(ws) if w}

    assert listed(one) == dict(want)
    assert listed(phrases.pruned(one, 30)) == {p: n for p, n in want.items() if n >= 30}
    asked, state = phrases.paths(pa.array([b"w1", b"zz", b"w2"], pa.large_binary()), [([np.array([0, 1, 2]), np.array([2, 0, 2])], np.ones(3, np.int64))], 3)
    found = phrases.composed(asked, one)[1][state[0]]
    assert found.tolist() == [want[b"w1", b"w2"], 0, want[b"w2", b"w2"]]


def test_words_come_the_same_in_any_windows():
    texts = [t for _, t, _ in rows()]
    want = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09.,;:!?\n\x0b\x0c\r]+", lower(t))]
    for window in (1, 64, 1 << 20):
        got = [(r, x.decode()) for part in _tokens.words(pa.array(texts), phrases.WORD, phrases.BREAK, window) for r, x in zip(part.row.tolist(), part.strings().to_pylist(), strict=True)]
        assert got == want
