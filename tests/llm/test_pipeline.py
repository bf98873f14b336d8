"""The pipeline's stages against brute force, each on what the stage before kept, and on odd tables."""

import collections
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlens.llm import pieces, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = np.random.default_rng(8)
    word = lambda n: ["the", *(f"w{x}" for x in rng.integers(0, 9000, n))]
    line = lambda n=9: " ".join(word(n))
    shared, passage = "\n".join(line() for _ in range(4)), line(70)
    texts = []
    for i in range(12):
        texts.append("\n".join(line() for _ in range(6)) + "\n" + (shared + "\n" if i % 3 == 0 else "") + line())
    texts += [line(30) + " " + passage + " " + line(30) for _ in range(4)] + [line(60), "too short", "", None, "# * $ " * 30, ("again and again the same words here " * 9)]
    base = word(200)
    for n in (0, 1, 2, 60):
        b = list(base)
        for j in range(n):
            b[3 + 3 * j] = f"z{j}"
        texts.append("\n".join(" ".join(b[j : j + 8]) for j in range(0, len(b), 8)))
    rows = [(i, t, "en", ("a", "b", None)[i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    n = len(rows)
    rows += [(2, rows[2][1], "en", "b", 5), (2, line(80), "en", "a", 7), (n, rows[1][1], "en", "b", 9), (None, line(50), None, None, None), (None, texts[1], "x", "a", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def kept(spark, docs, tmp_path_factory):
    """What each stage returns, written and read again."""
    at, out, df = tmp_path_factory.mktemp("stages"), [docs], docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, "").write.parquet(str(at / str(i)))
        df = spark.read.parquet(str(at / str(i)))
        out.append(df)
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_quality_stage(kept):
    con = duckdb.connect()
    frame = kept[0].toPandas().assign(row=range(kept[0].count()))  # noqa: F841  DuckDB reads it by name
    con.execute("create view documents as select row as doc_id, text from frame")
    good = {r[0] for r in con.execute(f"select doc_id from ({quality.ORACLE}) where kept").fetchall()}
    want = [r for r in frame[["doc_id", "text", "lang", "source", "n_chars"]].astype(object).where(frame.notna(), None).itertuples(index=True, name=None) if r[0] in good]
    assert [(None if r[0] is None else int(r[0]), r[1]) for r in sorted(((x[1], x[2]) for x in want), key=str)] == sorted(((r.doc_id, r.text) for r in kept[1].collect()), key=str)
    assert 15 < len(good) < len(frame) and kept[1].columns == kept[0].columns


def test_line_stage(spark, kept):
    before = [(r.doc_id, r.text, r.h) for r in kept[1].withColumn("h", F.xxhash64("text")).collect()]
    seen_runs, seen_words, left = set(), set(), {}
    for i, text, _ in sorted(set(before), key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        lines = text.split("\n")
        full = [j for j, x in enumerate(lines) if WORD.search(x)]
        at = np.cumsum([0, *(len(WORD.findall(x)) for x in lines)])
        words, gone = WORD.findall(text), set()
        for a in range(len(full) - 2):
            key = tuple(lines[j].strip(" \t\n\x0b\x0c\r") for j in full[a : a + 3])
            if key in seen_runs:
                gone |= {w for j in range(full[a], full[a + 2] + 1) for w in range(at[j], at[j + 1])}
            seen_runs.add(key)
        for a in range(len(words) - 50):
            key = tuple(words[a : a + 51])
            if key in seen_words:
                gone |= set(range(a, a + 51))
            seen_words.add(key)
        left[i, text] = [w for j, w in enumerate(words) if j not in gone]
    want = sorted((str(i), " ".join(left[i, t])) for i, t, _ in before if left[i, t])
    got = kept[2].collect()
    assert sorted((str(r.doc_id), " ".join(WORD.findall(r.text))) for r in got) == want
    assert all(r.n_chars == len(r.text) or (r.doc_id, r.text, r.n_chars) in {(x.doc_id, x.text, x.n_chars) for x in kept[1].collect()} for r in got)
    assert kept[2].columns == kept[0].columns and len(got) < len(before)


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_kept(data):
    """Rows that stay: of each class of ids linked by near-equal texts the smallest id, each of its texts once; null ids all."""
    ids = sorted({r[0] for r in data if r[0] is not None})
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(r[0], shingles(r[1])) for r in data if r[0] is not None]
    for i, a in sets:
        for j, b in sets:
            if a and b and i < j and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted({(r[0], r[1]) for r in data if r[0] is not None and find(r[0]) == r[0]}, key=str) + sorted(((r[0], r[1]) for r in data if r[0] is None), key=str)


def test_near_duplicate_stage(kept):
    before = [(r.doc_id, r.text) for r in kept[2].collect()]
    got = [(r.doc_id, r.text) for r in kept[3].collect()]
    assert sorted(got, key=str) == sorted(near_kept(before), key=str) and len(got) < len(before)
    assert kept[3].columns == kept[0].columns


def test_near_duplicate_stage_keeps_the_texts_of_an_id(spark):
    t = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    data = [(5, t[0], "en", "s", 1), (5, t[1], "en", "s", 1), (5, t[1], "de", "s", 2), (6, t[1] + " x", "en", "s", 1), (7, t[2], "en", None, None), (None, t[2], "en", "s", 3), (None, t[2], "en", "s", 3), (8, None, None, None, None), (9, "", "en", "s", 0)]
    df = spark.createDataFrame(data, SCHEMA)
    out = [rows(corpus_pipeline.near_duplicate_stage(spark, df.repartition(n), "")) for n in (1, 4)]
    assert out[0] == out[1] == sorted([data[0], data[2], data[4], data[5], data[6], data[7], data[8]], key=str)


def test_mixing_stage(kept):
    size = lambda r: len(WORD.findall(r.text or ""))
    before, after = kept[3].collect(), collections.Counter(tuple(r) for r in kept[4].collect())
    single = collections.Counter(tuple(r) for r in before)
    assert set(after) <= set(single) and all(n <= 2 * single[r] for r, n in after.items())
    assert kept[4].columns == kept[0].columns
    total, sizes = sum(map(size, before)), collections.Counter()
    for r in before:
        sizes[r.source] += size(r)
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), (5, 2, 1), strict=False))
    target, left, todo = {}, 1.5 * total, set(sizes)
    while todo:
        level = left / sum(weights[s] for s in todo)
        over = {s for s in todo if weights[s] * level > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} or {s: weights[s] * level for s in todo}
        left -= sum(2.0 * sizes[s] for s in over)
        todo = todo - over if over else set()
    taken = collections.Counter()
    for r in kept[4].collect():
        taken[r.source] += size(r)
    assert all(abs(taken[s] - t) <= max(0.05 * t, max(map(size, before))) for s, t in target.items())


def test_pieces_stage(spark, kept):
    mixed = collections.Counter(r.doc_id for r in kept[4].collect())
    got = kept[5].collect()
    assert all(r.round_trip for r in got) and collections.Counter(r.doc_id for r in got) == {i: 2 * n for i, n in mixed.items()}
    texts = collections.defaultdict(set)
    for r in kept[4].collect():
        texts[r.doc_id].add(r.text)
    for r in pieces.decode_pieces(kept[5]).collect():
        assert r.text in texts[r.doc_id]


def test_run_gives_the_stages_rows_again(spark, docs, kept, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    show = lambda df: sorted((str(r.doc_id), r.rank, tuple(r.ids)) for r in df.collect())
    assert show(corpus_pipeline.run(spark, str(tmp_path))) == show(kept[5])


def test_stages_of_an_empty_table_and_of_clashing_columns(spark, docs):
    added = {c: F.lit("clash") for c in ("kept", "failed", "n_words", "n_lines", "n_removed", "n_passage_words", "component_id", "n_shingles", "size", "copies", "shards", "places", "taken", "rank", "ids", "block")}
    odd = docs.withColumns(added).withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), "").count() == 0, name
        out = stage(spark, odd, "")
        assert out.count() > 0 and (name == "SentencePiece encoding" or out.columns == odd.columns), name


def test_stages_keep_columns_that_operators_use_for_themselves(spark, docs):
    """Columns named like the operators' own, and _, come out as they went in."""
    names = ["_", "_row", "_own1", "kept", "n_lines", "n_removed", "size", "copies", "shards", "component_id", "n_words", "c0"]
    clash = docs.withColumns({n: F.concat(F.lit(n), F.col("n_chars").cast("string")) for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, "")
        assert out.columns == clash.columns
        bad = [f"not `{n}` <=> concat('{n}', cast(n_chars as string))" for n in names]
        assert out.count() and (stage is corpus_pipeline.line_stage or out.where(" or ".join(bad)).count() == 0)
