"""Phrase collocations by weighted acyclic automata of sorted n-grams (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm import _tokens
from fleetlens.llm._bytes import Rolling, mix, texts
from fleetlens.llm._scratch import stored

WORD = np.ones(256, bool)
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
WORD[[0x20, 0x09]] = False
WORD &= ~BREAK
SHARD_WORDS = 1 << 20
RANGE_BYTES = 8 << 20
RANGES = 64
AUTOMATON = "words binary, sizes binary, parents array<binary>, symbols array<binary>, weights array<binary>"


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on, in a byte each where few are larger than that, else in as many as the largest needs."""
    large = x[x >= 255]
    if 16 * len(large) <= len(x):
        return b"\0" + len(x).to_bytes(8, "little") + np.minimum(x, 255).astype(np.uint8).tobytes() + large.astype(np.uint64).tobytes()
    kind = np.min_scalar_type(int(x.max()))
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    if b[0]:
        return np.frombuffer(b, f"u{b[0]}", offset=1).astype(np.int64)
    n = int.from_bytes(b[1:9], "little")
    x = np.frombuffer(b, np.uint8, n, 9).astype(np.int64)
    x[x == 255] = np.frombuffer(b, np.uint64, offset=9 + n).astype(np.int64)
    return x


class Automaton:
    """Phrases and their weights as the paths of an acyclic automaton.

    words are the symbols. Level k has the states that are reached by k + 1 words: the state before, the last word and the
    weight of the phrase that ends there (0: none does). The states of a level are in order of (state before, last word), so the
    automaton is the sorted list of its phrases with what each shares with the one before it left out.
    """

    def __init__(self, words: pa.Array, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.words, self.levels = words, levels

    def columns(self) -> dict[str, object]:
        body, off = texts(self.words)
        steps = [np.diff(p, prepend=0) for p, _, _ in self.levels]  # parents are in order
        return {"words": body.tobytes(), "sizes": packed(np.diff(off)), "parents": [packed(p) for p in steps], "symbols": [packed(s) for _, s, _ in self.levels], "weights": [packed(w) for _, _, w in self.levels]}

    @staticmethod
    def of(row: dict[str, object]) -> Automaton:
        words = _tokens.joined(np.frombuffer(row["words"], np.uint8), unpacked(row["sizes"]))
        return Automaton(words, [(np.cumsum(unpacked(p)), unpacked(s), unpacked(w)) for p, s, w in zip(row["parents"], row["symbols"], row["weights"], strict=True)])

    def symbols_at(self, level: int) -> list[np.ndarray]:
        """Words of the phrases of a level, a column a place."""
        out, state = [], np.arange(len(self.levels[level][0]))
        for k in range(level, -1, -1):
            parent, symbol, _ = self.levels[k]
            out.append(symbol[state])
            state = parent[state]
        return out[::-1]


def _merged(key: np.ndarray, weight: np.ndarray, largest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sum (or largest) of the weights of each, and where each of key went."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = np.append(True, ranked[1:] != ranked[:-1]) if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    went = np.empty(len(key), np.int64)
    went[order] = np.cumsum(first) - 1
    return ranked[at], (np.maximum if largest else np.add).reduceat(weight[order], at) if len(at) else weight[:0], went


def built(words: pa.Array, opens: np.ndarray, most: int, counted: int) -> Automaton:
    """The automaton of all phrases of up to most words that begin at the first `counted` words of a stream and stay in a piece."""
    coded = words.dictionary_encode()
    symbol = coded.indices.to_numpy().astype(np.int64)
    piece = np.cumsum(opens)
    state, start, levels = np.zeros(len(symbol), np.int64), np.arange(counted), []
    for k in range(most):
        start = start[start + k < len(symbol)]
        start = start[piece[start + k] == piece[start]]
        key = (state[start] << 32) | symbol[start + k]
        keys, weight, went = _merged(key, np.ones(len(key), np.int64), False)
        levels.append((keys >> 32, keys & 0xFFFFFFFF, weight))
        state[start] = went
    return Automaton(coded.dictionary, levels)


def union(parts: list[Automaton], largest: bool = False) -> Automaton:
    """All phrases of the parts, with the sum (or largest) of their weights. Level by level: states that are reached from the same state by the same word are one."""
    coded = pa.chunked_array([p.words for p in parts]).combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    index = coded.indices.to_numpy().astype(np.int64)
    cut = np.cumsum([0, *(len(p.words) for p in parts)])
    went, levels = [np.zeros(1, np.int64) for _ in parts], []
    for k in range(max(len(p.levels) for p in parts)):
        have = [p.levels[k] for p in parts]
        key = np.concatenate([(went[i][parent] << 32) | index[cut[i] + symbol] for i, (parent, symbol, _) in enumerate(have)])
        keys, weight, to = _merged(key, np.concatenate([w for _, _, w in have]), largest)
        levels.append((keys >> 32, keys & 0xFFFFFFFF, weight))
        went = np.split(to, np.cumsum([len(p) for p, _, _ in have])[:-1])
    return Automaton(coded.dictionary, levels)


def pruned(a: Automaton, least: int) -> Automaton:
    """Phrases with at least that weight, and the states on their paths."""
    keep = [w >= least for _, _, w in a.levels]
    for k in range(len(keep) - 1, 0, -1):
        keep[k - 1][a.levels[k][0][keep[k]]] = True
    return _restricted(a, keep, [np.where(w >= least, w, 0) for _, _, w in a.levels])


def _restricted(a: Automaton, keep: list[np.ndarray], weights: list[np.ndarray]) -> Automaton:
    used = np.zeros(len(a.words), bool)
    for (_, s, _), m in zip(a.levels, keep, strict=True):
        used[s[m]] = True
    number, levels, before = np.cumsum(used) - 1, [], np.zeros(1, np.int64)
    for (p, s, _), m, w in zip(a.levels, keep, weights, strict=True):
        levels.append((before[p[m]], number[s[m]], w[m]))
        before = np.cumsum(m) - 1
    return Automaton(a.words.filter(pa.array(used)), levels)


def _word_hashes(words: pa.Array, lang: str) -> np.ndarray:
    data, off = texts(words)
    raw = lang.encode()
    own = Rolling(np.frombuffer(raw, np.uint8)).hash(np.zeros(1, np.int64), np.array([len(raw)]))
    return mix(Rolling(data).hash(off[:-1], off[1:]) + own)


def ranges(a: Automaton, lang: str, n: int) -> list[np.ndarray]:
    """The range, of n, of each state: that of the hash of its first two words (one, for phrases of one word)."""
    h = _word_hashes(a.words, lang)
    slot = lambda x: (((x >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)
    out = [slot(h[a.levels[0][1]])]
    for k, (parent, symbol, _) in enumerate(a.levels[1:], 1):
        out.append(slot(mix(h[a.levels[0][1]][parent] * np.uint64(0xD6E8FEB86659FD93) + h[symbol])) if k == 1 else out[-1][parent])
    return out


def dealt(a: Automaton, lang: str, n: int) -> Iterator[tuple[int, Automaton]]:
    """The automaton cut at prefixes: for each range that has a phrase, the automaton of its phrases."""
    of = ranges(a, lang, n)
    order = [np.argsort(r, kind="stable") for r in of]
    edge = [np.searchsorted(r[o], np.arange(n + 1)) for r, o in zip(of, order, strict=True)]
    for i in np.flatnonzero(sum(e[1:] - e[:-1] for e in edge)):
        own = [o[e[i] : e[i + 1]] for o, e in zip(order, edge, strict=True)]  # states of this range, in order
        weights = [a.levels[k][2][x] for k, x in enumerate(own)]
        if len(own) > 1 and len(own[1]):  # states that its phrases of two words come from
            all_first = np.union1d(own[0], a.levels[1][0][own[1]])
            weights[0] = np.where(np.isin(all_first, own[0], assume_unique=True), a.levels[0][2][all_first], 0)
            own[0] = all_first
        symbols = [a.levels[k][1][x] for k, x in enumerate(own)]
        used, flat = np.unique(np.concatenate(symbols), return_inverse=True)
        symbols = np.split(flat, np.cumsum([len(s) for s in symbols])[:-1])
        parents = [np.zeros(len(own[0]), np.int64)] + [np.searchsorted(own[k - 1], a.levels[k][0][own[k]]) for k in range(1, len(own))]
        yield int(i), Automaton(a.words.take(pa.array(used)), list(zip(parents, symbols, weights, strict=True)))


def composed(asked: Automaton, known: Automaton) -> list[np.ndarray]:
    """The weight in known of each phrase of asked, level by level; both run over the same words, and 0 is no such phrase."""
    index = pc.index_in(asked.words, known.words)
    word = pc.fill_null(index, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    at, out = np.zeros(1, np.int64), []
    for (parent, symbol, _), (p, s, w) in zip(asked.levels, known.levels, strict=True):
        state, next_word = at[parent] if len(parent) else parent, word[symbol]
        keys = (p << 32) | s
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        want = (state << 32) | next_word
        place = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
        hit = (state >= 0) & (next_word >= 0) & (keys[place] == want if len(keys) else False)
        found = np.where(hit, order[place] if len(keys) else -1, -1)
        out.append(np.where(found >= 0, w[found] if len(w) else 0, 0))
        at = found
    return out


def paths(words: pa.Array, phrases: list[tuple[list[np.ndarray], np.ndarray]], depth: int) -> tuple[Automaton, list[np.ndarray]]:
    """The automaton of phrases, given as columns of symbols with weights (the largest counts), and the state that each ends in."""
    state, levels = [np.zeros(len(w), np.int64) for _, w in phrases], []
    for k in range(depth):
        on = [i for i, (c, _) in enumerate(phrases) if len(c) > k]
        key = np.concatenate([np.zeros(0, np.int64), *((state[i] << 32) | phrases[i][0][k] for i in on)])
        weight = np.concatenate([np.zeros(0, np.int64), *(phrases[i][1] * (len(phrases[i][0]) == k + 1) for i in on)])
        keys, weight, to = _merged(key, weight, True)
        levels.append((keys >> 32, keys & 0xFFFFFFFF, weight))
        for i, part in zip(on, np.split(to, np.cumsum([len(state[i]) for i in on])[:-1]) if on else [], strict=True):
            state[i] = part
    return Automaton(words, levels), state


def candidates(a: Automaton) -> list[np.ndarray]:
    """States of the phrases of two words and more, level by level (none at the first)."""
    return [np.flatnonzero((w > 0) & (k > 0)) for k, (_, _, w) in enumerate(a.levels)]


def parts(a: Automaton) -> tuple[Automaton, dict[tuple[int, int, int], np.ndarray]]:
    """The automaton of the parts of all candidates that do not begin with their first word, and of first words, each with the
    largest count of a candidate that it is part of; and for (level, from, to) the states of these parts of a level's candidates.
    """
    keys, phrases = [], []
    for k, own in enumerate(candidates(a)):
        columns = [c[own] for c in a.symbols_at(k)] if k else []
        for i in range(k + 1 if k else 0):
            for j in range(i + 1, k + 2) if i else [1]:
                keys.append((k, i, j))
                phrases.append((columns[i:j], a.levels[k][2][own]))
    asked, state = paths(a.words, phrases, len(a.levels))
    return asked, dict(zip(keys, state, strict=True))


def longest_inside(a: Automaton, others: Automaton) -> list[np.ndarray]:
    """Of each state the largest count of a longer candidate that holds its phrase: as a prefix, by a, or elsewhere, by others."""
    out = composed(a, others)
    for k in range(len(a.levels) - 1, 0, -1):
        parent, _, weight = a.levels[k]
        within = np.zeros(len(a.levels[k - 1][0]), np.int64)
        np.maximum.at(within, parent, np.maximum(weight, prefix) if k < len(a.levels) - 1 else weight)
        prefix = within
        out[k - 1] = np.maximum(out[k - 1], within)
    return out


def scored(a: Automaton, known: Automaton, others: Automaton, share: int) -> Iterator[dict[str, object]]:
    """(phrase, a, l, r, score) for the candidates of a that no longer one makes needless; known has the counts of their parts."""
    asked, state = parts(a)
    count = composed(asked, known)
    longer = longest_inside(a, others)
    text = a.words.cast(pa.large_string())
    for k, own in enumerate(candidates(a)):
        n = a.levels[k][2][own]
        best: list[np.ndarray] = []
        for cut in range(1, k + 1):
            first = own
            for up in range(k, cut - 1, -1):
                first = a.levels[up][0][first]
            left = a.levels[cut - 1][2][first] if cut > 1 else count[0][state[k, 0, 1]]
            right = count[k - cut][state[k, cut, k + 1]]
            score = 1000000 * n.astype(object) ** 2 // (left.astype(object) * right.astype(object))
            now = [left, right, score]
            best = [np.where(score < best[2], x, y) for x, y in zip(now, best, strict=True)] if best else now
        if best:
            stays = np.flatnonzero(100 * longer[k][own] < share * n)
            columns = [text.take(pa.array(c[own[stays]])) for c in a.symbols_at(k)]
            yield {"phrase": pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string())).cast(pa.string()), "a": n[stays]} | {x: y[stays].astype(np.int64) for x, y in zip(("l", "r", "score"), best, strict=True)}


def _rows(rows: Iterator[dict], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about so many bytes of words."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row["words"])
        if size >= most or len(held) >= 1000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_BINARIES = pa.list_(pa.binary())
_AUTOMATON = [("words", pa.binary()), ("sizes", pa.binary()), ("parents", _BINARIES), ("symbols", _BINARIES), ("weights", _BINARIES)]
_SENT = pa.schema([("range", pa.int32()), ("lang", pa.string()), *_AUTOMATON])
_KNOWN = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("total", pa.int64()), *_AUTOMATON])
_ASKED = pa.schema([("range", pa.int32()), ("source", pa.int32()), ("lang", pa.string()), *_AUTOMATON])
_TOLD = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("longer", pa.bool_()), *_AUTOMATON])


def _shards(batches: Iterator[pa.RecordBatch], most: int, n: int, shard_words: int) -> Iterator[dict]:
    """Automata of runs of about shard_words words, cut by range. The last words of a run come again with the next one, where their phrases end."""
    held: list[tuple[np.ndarray, ...]] = []
    names: dict[str, int] = {}

    def flush(final: bool) -> Iterator[dict]:
        body, size, opens, lang = (np.concatenate(x) for x in zip(*held, strict=True))
        counted = len(size) if final else max(0, len(size) - most + 1)
        words = _tokens.joined(body, size)
        for name, code in names.items():
            at = np.flatnonzero(lang == code)
            if len(at):
                a = built(words.take(pa.array(at)), opens[at], most, int(np.searchsorted(at, counted)))
                yield from ({"range": i, "lang": name} | part.columns() for i, part in dealt(a, name, n))
        rest = len(size) - counted
        held[:] = [(body[len(body) - int(size[counted:].sum()) :], size[counted:], opens[counted:], lang[counted:])] if rest else []
        for name in [x for x, code in names.items() if not rest or code not in lang[counted:]]:
            del names[name]

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for w in _tokens.words(batch.column("body"), WORD, BREAK):
            code = np.array([names.setdefault(x, max(names.values(), default=-1) + 1) for x in langs[w.row[0] : w.row[-1] + 1]])[w.row - w.row[0]]
            held.append((w.body, w.size.astype(np.int32), w.opens, code.astype(np.int32)))
            if sum(len(x[1]) for x in held) >= shard_words:
                yield from flush(False)
    if held:
        yield from flush(True)


def _by_lang(table: pa.Table) -> Iterator[tuple[str, list[dict]]]:
    found: dict[str, list[dict]] = {}
    for row in table.to_pylist():
        found.setdefault(row["lang"], []).append(row)
    yield from sorted(found.items())


def collocations(
    docs: DataFrame, most: int = 3, least: int = 10, share: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang", range_bytes: int = RANGE_BYTES, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of 2 to `most` words of each language.

    Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line ends, and pieces into words at spaces and tabs. Counts
    are those of all contiguous occurrences inside pieces of a language, which is `und` where it is null; n counts its words. A
    candidate comes a >= least times; its score is floor(1,000,000 a * a / (l * r)) for the cut into two parts that come l and r
    times that makes it lowest (of equal ones the first), in whole numbers of any size. Candidates that lie inside a longer
    candidate that has share percent of their count or more are left out. Order: score and a from high to low, then the phrase
    by its bytes. Null and empty texts have no words. Repeated rows count each. Empty tables, and languages without a candidate,
    give no row. Other columns of docs are not looked at.

    Method. A task turns runs of words (shards) into automata of their phrases: the n-grams in order, each stored as what it does
    not share with the one before it, with its count. Automata are cut by ranges of the hash of the first two words, so a word
    that begins a large part of all phrases is dealt to many ranges, and a common phrase is one weight of each shard. A range
    unites its automata and adds up their weights, exactly, on the words themselves. Then the parts of its candidates, again as an automaton,
    are sent to the ranges that count them and composed with these; what they give comes back to the candidates, as does the
    largest count of the candidates that hold a phrase. A range gets about range_bytes of text's phrases.
    """
    x = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("body"))
    total = x.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = int(max(RANGES, -(-total // range_bytes)))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(_shards(batches, most, n, shard_words), _SENT)

    def unite(table: pa.Table) -> pa.Table:
        out = []
        for lang, rows in _by_lang(table):
            a = union([Automaton.of(r) for r in rows])
            out.append({"range": rows[0]["range"], "lang": lang, "total": int(a.levels[0][2].sum())} | pruned(a, least).columns())
        return pa.Table.from_pylist(out, _KNOWN)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for r in batch.to_pylist():
                    yield from ({"range": i, "source": r["range"], "lang": r["lang"]} | p.columns() for i, p in dealt(parts(Automaton.of(r))[0], r["lang"], n))

        yield from _rows(rows(), _ASKED)

    def answer(known: pa.Table, asked: pa.Table) -> pa.Table:
        have = {r["lang"]: Automaton.of(r) for r in known.to_pylist()}
        out = []
        for lang, rows in _by_lang(asked):
            wanted = [Automaton.of(r) for r in rows]
            for r, a in zip(rows, wanted, strict=True):
                found = Automaton(a.words, [(p, s, w) for (p, s, _), w in zip(a.levels, composed(a, have[lang]), strict=False)])
                out.append({"range": r["source"], "lang": lang, "longer": False} | found.columns())
            out.append({"range": rows[0]["range"], "lang": lang, "longer": True} | union(wanted, largest=True).columns())
        return pa.Table.from_pylist(out, _TOLD)

    def score(known: pa.Table, told: pa.Table) -> pa.Table:
        answers = dict(_by_lang(told))
        none = Automaton(pa.array([], pa.large_binary()), [(np.zeros(0, np.int64),) * 3] * most)
        out = []
        for r in known.to_pylist():
            mine = answers.get(r["lang"], [])
            one = lambda longer: union([none, *(Automaton.of(x) for x in mine if x["longer"] == longer)], largest=True)  # noqa: B023, E731
            for part in scored(Automaton.of(r), one(False), one(True), share):
                out.append(pa.table({"lang": pa.array([r["lang"]] * len(part["a"]), pa.string())} | part))
        empty = pa.table({"lang": pa.array([], pa.string()), "phrase": pa.array([], pa.string())} | {c: pa.array([], pa.int64()) for c in ("a", "l", "r", "score")})
        return pa.concat_tables([empty, *out]).select(empty.column_names)

    known = stored(x.mapInArrow(shards, f"range int, lang string, {AUTOMATON}").groupBy("range").applyInArrow(unite, f"range int, lang string, total long, {AUTOMATON}"), "phrases")
    told = known.groupBy("range").cogroup(known.mapInArrow(ask, f"range int, source int, lang string, {AUTOMATON}").groupBy("range")).applyInArrow(answer, f"range int, lang string, longer boolean, {AUTOMATON}")
    found = known.groupBy("range").cogroup(told.groupBy("range")).applyInArrow(score, "lang string, phrase string, a long, l long, r long, score long")
    found = stored(found, "scored")
    # below (score, a) of what comes at place `top` nothing is needed, so a language's candidates never meet in one task
    each = found.groupBy("lang", "score", "a").agg(F.count("*").alias("c"))
    ahead = F.sum("c").over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())) - F.col("c")
    cut = each.withColumn("ahead", ahead).where(F.col("ahead") < top).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("cut"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    best = found.join(stored(cut, "cuts"), "lang").where(F.struct("score", "a") >= F.col("cut")).withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    words = known.groupBy("lang").agg(F.sum("total").alias("n"))
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_digest(docs: DataFrame) -> DataFrame:
    return collocations(docs)


ORACLE = """
with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents),
p as (select lang, unnest(regexp_split_to_array(body, '[.,;:!?\\x0A-\\x0D]')) as piece from t),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p),
total as (select lang, sum(len(w))::bigint as n from w group by lang having sum(len(w)) > 0),
g as (select lang, unnest(w) as phrase, 1 as k from w
  union all select lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 from w
  union all select lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 from w),
f as (select lang, phrase, k, count(*) as a from g group by all having count(*) >= 10),
c as (select *, string_split(phrase, ' ') as v from f where k > 1),
cuts as (select lang, phrase, k, a, 1 as cut, v[1] as first, array_to_string(v[2:], ' ') as rest from c
  union all select lang, phrase, k, a, 2, v[1] || ' ' || v[2], v[3] from c where k = 3),
s as (select cuts.lang, cuts.phrase, cuts.k, cuts.a, cut, x.a as l, y.a as r, (1000000::hugeint * cuts.a * cuts.a // (x.a::hugeint * y.a))::bigint as score
  from cuts join f x on x.lang = cuts.lang and x.phrase = first join f y on y.lang = cuts.lang and y.phrase = rest),
b as (select lang, phrase, k, a, arg_min(l, (score, cut)) as l, arg_min(r, (score, cut)) as r, min(score) as score from s group by lang, phrase, k, a),
i as (select lang, part, max(a) as most from (select lang, a, unnest([v[1] || ' ' || v[2], v[2] || ' ' || v[3]]) as part from c where k = 3) group by all),
d as (select b.* from b left join i on i.lang = b.lang and i.part = b.phrase where i.most is null or 100 * i.most < 50 * b.a),
o as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from d)
select o.lang, rank, phrase, a, l, r, n, score from o join total on total.lang = o.lang where rank <= 2000
"""
