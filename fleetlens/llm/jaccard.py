"""Near-duplicate texts by a set-similarity join with adaptive multi-match prefixes (operator 2)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm._blocks import BLOCK_BYTES, SENT, blocked, buckets, codes_of, counted, emit, in_order, with_codes
from fleetlens.llm._bytes import shingles, texts
from fleetlens.llm._components import components
from fleetlens.llm._scratch import stored

#: Longest multi-match: a prefix needs this many shared tokens at most before a pair is verified.
MOST_MATCHES = 8
#: 64-bit words of a node's signature: which of 64 * WORDS classes of hashes its set has.
WORDS = 8


def _needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with any partner."""
    return -(-n * percent // 100)


def prefix(tokens: np.ndarray, codes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(tokens, level of each, matches required) of a set's prefix.

    Tokens are ordered by how often they occur in the corpus (the bit length of the count), then by hash. With l matches
    required the prefix has n - needed + l tokens: two similar sets share l tokens at least there. A token's level is the least
    l whose prefix holds it. l is the one with the least estimated cost: each other text that a prefix token leads to is
    counted once as a posting read, and once more as a verification of about n / 8, divided by l as a candidate must show up
    in l postings.
    """
    n = len(tokens)
    need = _needed(n, percent)
    base = n - need + 1
    longest = min(MOST_MATCHES, need)
    order = np.lexsort((tokens, codes))[: base + longest - 1]
    postings = np.cumsum((1 << (codes[order].astype(np.int64) - 1)) - 1)
    wanted = np.arange(1, longest + 1)
    found = postings[base + wanted - 2]
    take = int(wanted[np.argmin(found * (1 + n / 8 / wanted))])
    keep = order[: base + take - 1]
    level = np.maximum(1, np.arange(len(keep)) - base + 2)
    return tokens[keep], level, take


def signature(tokens: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * WORDS classes of hashes: set if a token is of the class. Given known tokens only, as no other is shared."""
    bits = np.zeros(64 * WORDS, np.uint8)
    bits[(tokens & np.uint64(64 * WORDS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_shingles, component_id): the class of each text under links of Jaccard similarity of percent or more.

    A text's set holds its distinct k-word shingles, A-Z lower-cased, words being runs without white space; a text of fewer
    words is one shingle, one without words (or null) has an empty set and links with nothing. Two texts link when
    100 * |intersection| >= percent * |union|. component_id is the smallest id reachable by links, itself included.

    Equal sets are one node, so groups of exact copies cost a row each. A node's prefix tokens (see prefix()) that occur nowhere
    else are never sent. Of the rest, each token first proposes two nodes as partners of all others: its smallest, and the one whose
    tokens are the most frequent on the whole (of a group of near copies, the one nearest to the original). When these pairs are verified and joined to components, only tokens that still touch more than one component go on to propose
    pairs between components, those outside of a token's largest component with all others. So a group of near copies makes pairs in proportion to its size, and no link that could join two
    components is left out. Tokens that no other text has, and classes of hashes that one set's other tokens have and the other's have not, bound a
    pair's overlap from above, which drops most pairs of changed copies unseen. Pairs are verified on the whole sets.

    One row for each input row; rows that share an id count as one document with several texts, whose class holds them all: a
    node stands for a set, and only the links that were found are put in terms of ids. A
    null id has component_id null and links with nothing. Empty tables give no rows; columns besides the two are not read.
    """
    blocks, n_blocks = blocked(docs, id_col, text_col, block_bytes)

    def sets(table: pa.Table) -> list[np.ndarray]:
        return shingles(*texts(table["body"]), k)

    def digest(s: np.ndarray) -> bytes:
        return hashlib.blake2b(s.tobytes(), digest_size=16).digest()

    def send(table: pa.Table) -> pa.Table:
        table = in_order(table)
        once = {digest(s): s for s in sets(table)}
        keys = np.concatenate([*once.values(), np.zeros(0, np.uint64)])
        return emit(keys, table["block"][0].as_py(), 0, buckets(n_blocks))

    def nodes(table: pa.Table, codes: pa.Table) -> pa.Table:
        found = sets(table)
        names = [digest(s) for s in found]
        once = dict(zip(names, found, strict=True))
        sizes = np.cumsum([0, *(len(s) for s in once.values())])
        code = codes_of(codes, 0, np.concatenate([*once.values(), np.zeros(0, np.uint64)]))
        rows: dict[bytes, tuple] = {}
        for i, (name, s) in enumerate(once.items()):
            if len(s):
                t, _, take = prefix(s, code[sizes[i] : sizes[i + 1]], percent)
                shared = code[sizes[i] : sizes[i + 1]][np.searchsorted(s, t)] > 1
                own = code[sizes[i] : sizes[i + 1]]
                rows[name] = (_signed(t[shared]), np.flatnonzero(shared), take, int(np.count_nonzero(own > 1)), float(own.mean()), signature(s[own > 1]))
        ids, first = table["id"].to_pylist(), set()
        out = {c: [] for c in ("id", "n", "name", "take", "tokens", "places", "known", "common", "signature", "body")}
        for i, name, s in zip(ids, names, found, strict=True):
            new = name not in first and i is not None and name in rows and len(rows[name][0]) > 0
            if new:
                first.add(name)
            t, place, take, known, common, bits = rows[name] if new else (None,) * 6
            for c, x in zip(out, (i, len(s), name, take, t, place, known, common, bits, s.tobytes() if new else None), strict=True):
                out[c].append(x)
        kinds = dict(id=table["id"].type, n=pa.int64(), name=pa.binary(), take=pa.int32(), tokens=pa.list_(pa.int64()), places=pa.list_(pa.int32()), known=pa.int64(), common=pa.float64(), signature=pa.list_(pa.int64()), body=pa.binary())
        return pa.table({c: pa.array(x, kinds[c]) for c, x in out.items()})

    codes = counted(blocks.groupBy("block").applyInArrow(send, SENT))
    kind = docs.schema[id_col].dataType.simpleString()
    found = stored(with_codes(blocks, codes, nodes, f"id {kind}, n long, name binary, take int, tokens array<long>, places array<int>, known long, common double, signature array<long>, body binary"), "shingles")

    # one node for each set; least is the smallest id that has it
    full = found.where("n > 0 and id is not null")
    named = stored(full.groupBy("name").agg(F.min("id").alias("least")), "names")
    same = full.select("id", "name").join(named, "name").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
    same = stored(same, "copies")
    bodies = found.where("tokens is not null").select("name", "n", "known", "common", "signature", "take", "tokens", "places", "body").dropDuplicates(["name"]).join(named, "name").drop("name")
    bodies = stored(bodies.withColumn("node", F.monotonically_increasing_id()), "sets")  # numbers hold as they are written once
    sets_of = bodies.select("node", "n", "known", "body")
    postings = bodies.select("node", "n", "known", "common", "take", F.explode(F.arrays_zip("tokens", "places")).alias("x")).select("node", "n", "known", "common", "take", F.col("x.tokens").alias("token"), F.col("x.places").alias("place"))
    hubs = postings.groupBy("token").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.max(F.struct("common", "node")).alias("best")).where("least <> most").select("token", "least", F.col("best.node").alias("best"))
    postings = stored(postings.join(hubs, "token"), "postings")

    starred = postings.where("node <> least").select("node", F.col("least").alias("other")).unionByName(postings.where("node <> best").select("node", F.col("best").alias("other")))
    first = stored(_verified(starred.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), sets_of, percent), "stars")
    joined = components(first)

    postings = postings.drop("least", "best", "common").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = postings.groupBy("token", "component").agg(F.count("*").alias("rows")).groupBy("token").agg(F.count("*").alias("components"), F.max(F.struct("rows", "component")).alias("x")).where("components > 1").select("token", F.col("x.component").alias("main"))
    postings = postings.join(mixed, "token").join(bodies.select("node", "signature"), "node")
    left, right = postings.where("component <> main").alias("l"), postings.alias("r")
    apart = "l.token = r.token and l.component <> r.component and (l.component < r.component or r.component = r.main)"
    close = f"{apart} and {_may_link('l.n', 'l.known', 'r.n', 'r.known', percent)} and {_in_prefixes('l', 'r', percent)} and {_signatures_allow(percent)}"
    take = F.least("l.take", "r.take")
    pairs = left.join(right, F.expr(close)).select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b"), take.alias("take"))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("matches"), F.min("take").alias("take")).where("matches >= take").select("a", "b")
    rest = _verified(pairs, sets_of, percent)
    ids = bodies.select("node", "least")
    links = first.unionByName(rest).join(ids.select(F.col("node").alias("a"), F.col("least").alias("i")), "a").join(ids.select(F.col("node").alias("b"), F.col("least").alias("j")), "b")
    classes = components(links.select(F.col("i").alias("a"), F.col("j").alias("b")).unionByName(same))
    all_rows = found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"))
    return all_rows.join(classes, all_rows[id_col] == classes["node"], "left").select(id_col, "n_shingles", F.coalesce("component", id_col).alias("component_id"))


def _may_link(n_a: str, known_a: str, n_b: str, known_b: str, percent: int) -> str:
    """SQL: sizes are close enough, and so are the numbers of tokens that some other text has too, which bound the overlap."""
    return f"{n_a} * 100 >= {n_b} * {percent} and {n_b} * 100 >= {n_a} * {percent} and least({known_a}, {known_b}) * {100 + percent} >= ({n_a} + {n_b}) * {percent}"


def _in_prefixes(a: str, b: str, percent: int) -> str:
    """SQL: the token is in both sets' prefixes for the overlap that this pair needs, which may be more than the least of any partner, with the lesser of their required matches. place: how many tokens of a set come before it."""
    need = f"((({a}.n + {b}.n) * {percent} + {99 + percent}) div {100 + percent})"
    return " and ".join(f"{x}.place < {x}.n - {need} + least({a}.take, {b}.take)" for x in (a, b))


def _signatures_allow(percent: int) -> str:
    """SQL: the overlap is large enough even if each class of one set's known tokens that the other lacks stands for one token only."""
    lacks = lambda a, b: " - ".join([f"{a}.known", *(f"bit_count({a}.signature[{i}] & ~{b}.signature[{i}])" for i in range(WORDS))])
    return f"least({lacks('l', 'r')}, {lacks('r', 'l')}) * {100 + percent} >= (l.n + r.n) * {percent}"


def _verified(pairs: DataFrame, sets_of: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets are similar."""

    def check(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = _overlap(s, t)
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets_of.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("known").alias("known_a"), F.col("body").alias("x"))
    right = sets_of.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("known").alias("known_b"), F.col("body").alias("y"))
    sizes = pairs.join(left.select("a", "n_a", "known_a"), "a").join(right.select("b", "n_b", "known_b"), "b").where(_may_link("n_a", "known_a", "n_b", "known_b", percent)).select("a", "b")
    kind = pairs.schema["a"].dataType.simpleString()
    return sizes.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, f"a {kind}, b {kind}")


def _overlap(s: np.ndarray, t: np.ndarray) -> int:
    """Common members of two sorted sets."""
    if len(s) > len(t):
        s, t = t, s
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    return int(np.count_nonzero(t[at] == s)) if len(t) else 0


ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
s as (
  select distinct doc_id, unnest(case when len(words) >= 5 then list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) when len(words) > 0 then [array_to_string(words, ' ')] else [] end) as shingle from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(node, component) as (select doc_id, doc_id from documents union select e.b, r.component from r join e on e.a = r.node),
c as (select node, min(component) as component_id from r group by 1)
select documents.doc_id, coalesce(n, 0) as n_shingles, component_id from documents left join n on n.doc_id = documents.doc_id left join c on c.node = documents.doc_id
"""
