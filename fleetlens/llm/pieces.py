"""Sampled subword segmentations without replacement, and decoding (operator 3)."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm._bytes import Rolling, mix, order_of, texts

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_BYTES = 1 << 20
FILTER_BITS = 18
#: Edges of a task's shared lattice, at about 40 bytes each.
MOST_EDGES = 2_000_000
GOLD = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces of a model file, with white space marks as spaces and weights for sampling.

    A piece's weight is (1 + rank) ** -alpha, its rank being the model's (minus its score) or, without one, the last. Bytes
    stand for characters that are no piece; each weighs as the last rank does.
    """

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.raw: list[bytes] = [b""] * n
        self.byte_ids = np.zeros(256, np.int32)
        by_length: dict[int, list[tuple[bytes, int, float]]] = {}
        known = set()
        for i in range(n):
            piece, score = sp.id_to_piece(i), sp.get_score(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.raw[i] = b = piece.replace("▁", " ").encode()
                rank = -score if -score < n else n
                by_length.setdefault(len(b), []).append((b, i, -alpha * np.log1p(rank)))
                known |= set(b)
        if any(b" " in p.lstrip(b" ") for x in by_length.values() for p, _, _ in x):
            raise ValueError("a piece has white space inside; such models are not supported")
        self.byte_weight = -alpha * np.log1p(n)
        self.weights = np.zeros(n)
        for x in by_length.values():
            for _, i, w in x:
                self.weights[i] = w
        self.alone = np.array([c < 128 and c not in known for c in range(256)])
        self.by_length = {}
        for size, x in sorted(by_length.items()):
            buf = np.frombuffer(b"".join(p for p, _, _ in x), np.uint8)
            h = Rolling(buf).raw(np.arange(len(x)) * size, np.arange(1, len(x) + 1) * size)
            order = np.argsort(h)
            likely = np.zeros(1 << FILTER_BITS, bool)
            likely[h >> np.uint64(64 - FILTER_BITS)] = True
            self.by_length[size] = h[order], np.array([i for _, i, _ in x], np.int32)[order], likely
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.sizes = np.array([len(b) for b in self.raw], np.int32)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids' pieces behind each other."""
        size = self.sizes[ids]
        end = np.cumsum(size)
        return self.bytes[np.repeat(self.starts[ids] - end + size, size) + np.arange(end[-1] if len(end) else 0)]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


class Lattice:
    """All segmentations of the distinct pieces of text (segments) that white space parts texts into.

    A state is a byte position of a segment. Edge arrays are ordered by state; prob is the chance of an edge among all
    segmentations that pass its state, from backward sums of weights; so a walk from the start draws a segmentation with its
    probability, and a state's remaining mass is known exactly: this is the search's bound. What is kept of a segment does not
    depend on the others, to the last bit.
    """

    FIELDS = ("edge_from", "edge_count", "place", "left", "piece", "source", "length", "target", "prob", "within", "data", "base", "hashes")

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.edge_from, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.edge_count, self.left, self.piece, self.source, self.length, self.target = (np.zeros(0, np.int32) for _ in range(6))
        self.room: dict[str, np.ndarray] = {}
        self.prob, self.within, self.data, self.base, self.hashes = np.zeros(0), np.zeros(0), np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def covering(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[Lattice, np.ndarray]:
        """A lattice that has these segments too, and the first state of each; hashes tell segments apart."""
        u, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, u), max(0, len(self.hashes) - 1))
        new = np.flatnonzero(self.hashes[at] != u) if len(self.hashes) else np.arange(len(u))
        both = self if not len(new) else self._joined(Lattice(self.vocab)._built(data, start[sample[new]], end[sample[new]], u[new]))
        return both, both.base[np.searchsorted(both.hashes, u)][which]

    def _joined(self, part: Lattice) -> Lattice:
        """Both behind each other. Arrays grow in place where their buffers have room, so of two lattices joined to one the later holds."""
        out = Lattice(self.vocab)
        states, edges, size = len(self.place), len(self.piece), len(self.data)
        shift = {"edge_from": edges, "place": size, "source": states, "target": states, "base": states}
        out.room = self.room
        for f in self.FIELDS:
            a, b = getattr(self, f), getattr(part, f)
            if f in ("base", "hashes"):
                setattr(out, f, np.concatenate([a, b + np.array(shift.get(f, 0), b.dtype)]))
                continue
            n = len(a) + len(b)
            if len(self.room.get(f, ())) < n:
                self.room[f] = np.empty(n + n // 4, b.dtype)
                self.room[f][: len(a)] = a
            both = self.room[f][:n]
            np.add(b, np.array(shift.get(f, 0), b.dtype), out=both[len(a) :])
            setattr(out, f, both)
        order = np.argsort(out.hashes)
        out.hashes, out.base = out.hashes[order], out.base[order]
        return out

    def _built(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> Lattice:
        """This lattice, filled with distinct segments."""
        vocab = self.vocab
        size = end - start
        stop = np.cumsum(size)
        self.data = data = data[np.repeat(start - (stop - size), size) + np.arange(stop[-1])]
        start, self.hashes = stop - size, hashes
        self.base = np.cumsum(size + 1) - (size + 1)
        n = int((size + 1).sum())
        place = np.repeat(start - self.base, size + 1) + np.arange(n)  # byte of each state
        left = (np.repeat(stop, size + 1) - place).astype(np.int32)  # bytes from here to the segment's end
        self.place, self.left = place, left
        rolling = Rolling(data)
        states = np.flatnonzero(left > 0)
        states = states[(data[place[states]] & 0xC0) != 0x80]
        first = data[place[states]]
        width = np.minimum(np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4))), left[states]).astype(np.int32)
        room, at_byte = left[states], place[states]
        bare = np.ones(len(states), bool)
        found = []
        wide_enough = np.arange(len(states), dtype=np.int32)
        for size_, (h, ids, likely) in vocab.by_length.items():
            enough = room >= size_
            if not enough.all():
                wide_enough, room, at_byte = wide_enough[enough], room[enough], at_byte[enough]
            key = rolling.raw(at_byte, at_byte + size_)
            maybe = np.flatnonzero(likely[key >> np.uint64(64 - FILTER_BITS)])
            at, key = wide_enough[maybe], key[maybe]
            i = np.minimum(np.searchsorted(h, key), len(h) - 1)
            hit = h[i] == key
            at = at[hit]
            bare[at[width[at] == size_]] = False
            found.append((states[at], ids[i[hit]]))
        found.reverse()  # long pieces first: a walk looks at the first edges first
        found.append((states[bare], np.full(bare.sum(), -1, np.int32)))
        count = np.zeros(n, np.int32)
        for at, _ in found:
            count[at] += 1  # a state has one edge of a length at most
        slot = np.cumsum(count, dtype=np.int64) - count
        self.edge_from, self.edge_count = slot.copy(), count
        self.piece = np.empty(int(count.sum()), np.int32)
        while found:
            at, ids = found.pop(0)
            self.piece[slot[at]] = ids
            slot[at] += 1
        self.source = np.repeat(np.arange(n, dtype=np.int32), count)
        self.length = vocab.sizes[self.piece]
        weight = vocab.weights[self.piece]
        none = np.flatnonzero(self.piece < 0)
        wide = np.zeros(n, np.int32)
        wide[states] = width
        self.length[none] = wide[self.source[none]]
        weight[none] = vocab.byte_weight * self.length[none]
        self.target = self.source + self.length
        rest = self._backward(weight, n)
        weight += rest[self.target]
        weight -= rest[self.source]
        self.prob = np.exp(weight, out=weight)
        self.within = self.prob.copy()
        more = np.flatnonzero(count > 1)
        for rank in range(1, int(count.max())):  # running sums inside a state, the same whatever else there is
            more = more[count[more] > rank]
            e = self.edge_from[more] + rank
            self.within[e] += self.within[e - 1]
        full = np.flatnonzero(count)
        self.within[self.edge_from[full] + count[full] - 1] = 2.0
        self.prob[self.edge_from[full[count[full] == 1]]] = 1.0
        return self

    def log_prob(self, edges: np.ndarray) -> np.ndarray:
        return np.log(self.prob[edges])

    def log_other(self, edges: np.ndarray) -> np.ndarray:
        """Of what the other edges of the same state have."""
        with np.errstate(divide="ignore"):
            return np.log(np.maximum(0.0, 1.0 - self.prob[edges]))

    def _backward(self, weight: np.ndarray, n: int) -> np.ndarray:
        """Log of the summed weights from each state to its segment's end; all states at one distance are done at once."""
        rest = np.full(n, -np.inf)
        rest[self.left == 0] = 0.0
        full = np.flatnonzero(self.edge_count)
        full = full[order_of(self.left[full], int(self.left.max()).bit_length() if n else 1)]
        count = self.edge_count[full]
        end = np.cumsum(count)
        edges = np.arange(end[-1] if len(end) else 0) + np.repeat(self.edge_from[full] - (end - count), count)
        weight, target = weight[edges], self.target[edges]
        far = self.left[full]
        cut = np.append(np.flatnonzero(np.append(True, far[1:] != far[:-1])), len(full)) if len(full) else np.zeros(1, np.int64)
        for a, b in zip(cut, cut[1:], strict=False):
            lo = end[a] - count[a]
            value = weight[lo : end[b - 1]] + rest[target[lo : end[b - 1]]]
            new = end[a:b] - count[a:b] - lo
            top = np.maximum.reduceat(value, new)
            top[~np.isfinite(top)] = 0.0
            value -= np.repeat(top, count[a:b])
            with np.errstate(divide="ignore"):
                rest[full[a:b]] = top + np.log(np.add.reduceat(np.exp(value), new))
        return rest

    def walk(self, state: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws a path from each state to its segment's end: (edges, all paths behind each other; edges of each path)."""
        stop = state + self.left[state]
        at, cur = np.flatnonzero(state < stop), state[state < stop]
        rounds, count = [], np.zeros(len(state), np.int64)
        while len(at):
            e = self.edge_from[cur]
            u = uniform(key[at] + _step(len(rounds)))
            on = np.flatnonzero(u >= self.within[e])
            while len(on):
                e[on] += 1
                on = on[u[on] >= self.within[e[on]]]
            rounds.append((at, e))
            count[at] += 1
            cur = self.target[e]
            on = cur < stop[at]
            at, cur = at[on], cur[on]
        out = np.empty(int(count.sum()), np.int64)
        begin = np.cumsum(count) - count
        for i, (a, e) in enumerate(rounds):
            out[begin[a] + i] = e
        return out, count

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """The ids that edges stand for; a character without a piece gives its bytes' ids."""
        piece = self.piece[edges]
        none = np.flatnonzero(piece < 0)
        if not len(none):
            return piece
        if (self.length[edges[none]] == 1).all():
            piece[none] = self.vocab.byte_ids[self.data[self.place[self.source[edges[none]]]]]
            return piece
        count = np.where(piece < 0, self.length[edges], 1)
        end = np.cumsum(count)
        out = np.repeat(piece, count)
        inside = np.arange(end[-1]) - np.repeat(end - count, count)
        bare = out < 0
        out[bare] = self.vocab.byte_ids[self.data[(np.repeat(self.place[self.source[edges]], count) + inside)[bare]]]
        return out


def _step(n: int) -> np.uint64:
    return np.uint64(n * int(GOLD) & (1 << 64) - 1)


def uniform(key: np.ndarray) -> np.ndarray:
    """Numbers within (0, 1) that depend on the key alone."""
    x = mix(key + GOLD)
    x >>= np.uint64(12)
    u = x.astype(np.float64)
    u += 0.5
    u *= 2.0**-52
    return u


def cut_gumbel(location: np.ndarray, bound: float, u: np.ndarray) -> np.ndarray:
    """Gumbel values at location, given that they are below bound."""
    x = np.log(u)
    np.negative(x, out=x)
    np.log(x, out=x)
    x -= location
    np.logaddexp(-bound, x, out=x)
    return np.negative(x, out=x)


class Search:
    """Best-first search of one text's segmentations by perturbed log-probability.

    A node is a prefix of a segmentation; its bound is the largest perturbed value among all ways to go on, which a Gumbel
    variable at the log of the node's mass gives. A popped node's value belongs to one of its children, drawn by mass, and so
    down to a full segmentation; at each step down the other children together get a value below it. These wait in alternatives,
    and the greatest is popped next. So segmentations come in the order of their perturbed values, each once.
    """

    def __init__(self, lattice: Lattice, key: np.uint64):
        self.lattice, self.key = lattice, key
        self.paths: list[dict] = []
        self.draws = 0

    def add(self, edges: np.ndarray, value: float, since: int, parent: int = 0) -> None:
        """A full segmentation whose steps from since on are new; those before since - 1 are the parent's."""
        lat = self.lattice
        same = max(0, since - 1)
        logs = lat.log_prob(edges[same:])
        if same:
            p = self.paths[parent]
            done = np.cumsum(np.append(p["done"][same - 1], logs))[1:]
            before = np.concatenate([p["before"][:same], done - logs])
            done = np.concatenate([p["done"][:same], done])
        else:
            done = np.cumsum(logs)
            before = done - logs
        self.draws += 1
        u = uniform(self._seed() + np.arange(since, len(edges), dtype=np.uint64) * GOLD)
        others = np.full(len(edges), -np.inf)
        if since < len(edges):
            others[since:] = cut_gumbel(before[since:] + lat.log_other(edges[since:]), value, u)
        self.paths.append({"edges": edges, "value": value, "log": float(done[-1]) if len(edges) else 0.0, "others": others, "done": done, "before": before, "taken": {}})

    def _seed(self) -> np.ndarray:
        return mix(np.array([self.key], np.uint64) + _step(self.draws))

    def best(self) -> tuple[float, int, int]:
        """(value, path, step) of the alternative to pop next."""
        found = (-np.inf, -1, -1)
        for i, p in enumerate(self.paths):
            if len(p["others"]):
                t = int(np.argmax(p["others"]))
                found = max(found, (float(p["others"][t]), i, t))
        return found

    def branch(self, value: float, i: int, t: int) -> np.ndarray:
        """Pops it: the steps up to and with the child that has the value; what is left there stays behind."""
        p, lat = self.paths[i], self.lattice
        state = lat.source[p["edges"][t]]
        a = int(lat.edge_from[state])
        b = a + int(lat.edge_count[state])
        taken = p["taken"].setdefault(t, {int(p["edges"][t])})
        free = np.array([e for e in range(a, b) if e not in taken])
        self.draws += 1
        u = uniform(self._seed() + np.arange(2, dtype=np.uint64) * GOLD)
        mass = np.cumsum(lat.prob[free])
        e = int(free[min(int(np.searchsorted(mass, u[0] * mass[-1], "right")), len(free) - 1)])
        taken.add(e)
        left = free[free != e]
        rest = lat.prob[left].sum()
        p["others"][t] = cut_gumbel(np.array([p["before"][t] + np.log(rest)]), value, u[1:])[0] if len(left) and rest > 0 else -np.inf
        return np.append(p["edges"][:t], e)


def _cuts(vocab: Vocabulary, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where segments start: at each text, at a space after something else, and around bytes that no piece holds."""
    start = np.zeros(len(data), bool)
    start[off[:-1][off[:-1] < off[1:]]] = True
    space, alone = data == 0x20, vocab.alone[data]
    start[1:] |= space[1:] & ~space[:-1]
    start |= alone
    start[1:] |= alone[:-1]
    return np.flatnonzero(start)


class Shared:
    """The lattice of one task: it keeps the segments of its first chunks, up to MOST_EDGES edges, for the later ones."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.lattice = vocab, Lattice(vocab)

    def covering(self, *segments: np.ndarray) -> tuple[Lattice, np.ndarray]:
        found, state = self.lattice.covering(*segments)
        if len(found.piece) <= MOST_EDGES:
            self.lattice = found
        return found, state


def sample_chunk(shared: Shared, bodies: list[bytes], keys: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
    """(text number, rank, ids, log-probability, perturbed value, inclusion score) for each text, up to k each."""
    marked = [b" " + b if b else b"" for b in bodies]
    data = np.frombuffer(b"".join(marked), np.uint8)
    off = np.cumsum([0, *map(len, marked)])
    start = _cuts(shared.vocab, data, off)
    end = np.append(start[1:], len(data))
    lat, state = shared.covering(data, start, end, Rolling(data).hash(start, end)) if len(data) else (None, None)
    doc = np.searchsorted(off, start, "right") - 1
    edge = np.searchsorted(doc, np.arange(len(bodies) + 1))
    inside = (start - off[doc]).astype(np.uint64)
    searches = []
    if lat is not None:
        path, count = lat.walk(state, mix(keys[doc]) + inside)
        cut = np.concatenate([[0], np.cumsum(count)])
        for d in range(len(bodies)):
            s = Search(lat, keys[d])
            s.add(path[cut[edge[d]] : cut[edge[d + 1]]], float(-np.log(-np.log(uniform(np.array([keys[d]]))[0]))), 0)
            searches.append(s)
    for r in range(1, k):
        pending = []
        for d, s in enumerate(searches):
            value, i, t = s.best()
            if value > -np.inf:
                pending.append((d, value, s.branch(value, i, t), i, t))
        if not pending:
            break
        # the rest of the segment in which each one branched, then all later segments of its text, in one walk
        states, seeds, sizes = [], [], []
        for d, _, head, _, _ in pending:
            passed = np.cumsum(lat.length[head])[-1]
            here = edge[d] + int(np.searchsorted(start[edge[d] : edge[d + 1]] - off[d], passed, "right")) - 1 if passed < off[d + 1] - off[d] else edge[d + 1] - 1
            inner = passed - (start[here] - off[d])
            states.append(np.append(state[here] + inner, state[here + 1 : edge[d + 1]]))
            seeds.append(mix(mix(keys[d : d + 1]) + np.uint64(r)) + inside[here : edge[d + 1]])
            sizes.append(edge[d + 1] - here)
        path, count = lat.walk(np.concatenate(states), np.concatenate(seeds))
        cut = np.concatenate([[0], np.cumsum(count)])[np.cumsum([0, *sizes])]
        for j, (d, value, head, i, t) in enumerate(pending):
            searches[d].add(np.concatenate([head, path[cut[j] : cut[j + 1]]]), value, t + 1, i)
    for d in range(len(bodies)):
        if not bodies[d]:
            yield d, 0, np.zeros(0, np.int32), 0.0, 0.0, 1.0
            continue
        floor = searches[d].best()[0]
        for rank, p in enumerate(searches[d].paths):
            score = 1.0 if floor == -np.inf else float(-np.expm1(-np.exp(min(50.0, p["log"] - floor))))
            yield d, rank, lat.ids(p["edges"]), p["log"], p["value"], score


def sample_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, alpha: float = 1.0, seed: int = 0, model: str = DEFAULT_MODEL, packed: bool = False) -> DataFrame:
    """(id, rank, ids, n_pieces, log_prob, perturbed, inclusion, round_trip): up to k different segmentations of each whole text.

    They are a sample without replacement of the model's lattice, in which a segmentation's probability is the product of its
    pieces' weights (Vocabulary) over the sum of all: rank 0 is a plain draw, and the set is what the k largest of the
    Gumbel-perturbed log-probabilities of all segmentations would be. inclusion is the chance of a segmentation to exceed the
    first value that was left out; log_prob less its logarithm weighs it in an estimate. Draws depend on the id and seed
    alone, so reruns agree wherever a row is processed. A text with fewer segmentations gives them all.

    A space is put before a text, and characters that are no piece become bytes, so decode_pieces() gives every text back;
    round_trip says that it did in the task itself. The piece weights make white space part segments, and equal segments of a
    chunk share one lattice. Memory is bounded by chunks of 1 MB, or one text. model is a path that all executors have.

    Null and empty texts have one segmentation, of no pieces. Rows that repeat an id and text repeat the sample; a null id
    counts as one more id. Empty tables give no rows; other columns are not read. ids are array<int>, or with packed a binary
    of 32-bit little-endian numbers.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("key"), F.encode(F.col(text_col), "UTF-8").alias("body"))
    kind = docs.schema[id_col].dataType.simpleString()

    def draw(batches):
        vocab = vocabulary(model, alpha)
        shared = Shared(vocab)
        for batch in batches:
            size = np.diff(texts(batch.column("body"))[1])
            part = np.cumsum(size) // CHUNK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b == a:
                    continue
                chunk = batch.slice(a, b - a)
                bodies = [x or b"" for x in chunk.column("body").to_pylist()]
                keys = np.array(chunk.column("key").to_pylist(), np.int64).view(np.uint64)
                found = list(sample_chunk(shared, bodies, keys, k))
                ids = np.concatenate([x[2] for x in found])
                n = np.array([len(x[2]) for x in found])
                back = vocab.decode(ids).tobytes()
                edge = np.concatenate([[0], np.cumsum(vocab.sizes[ids])])[np.concatenate([[0], np.cumsum(n)])]
                same = [back[edge[i] : edge[i + 1]][1:] == bodies[x[0]] for i, x in enumerate(found)]
                cut = np.concatenate([[0], np.cumsum(n)])
                values = pa.array([ids[cut[i] : cut[i + 1]].astype("<i4").tobytes() for i in range(len(n))], pa.binary()) if packed else pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([
                    chunk.column("id").take(pa.array([x[0] for x in found])), pa.array([x[1] for x in found], pa.int32()), values, pa.array(n, pa.int64()),
                    pa.array([x[3] for x in found], pa.float64()), pa.array([x[4] for x in found], pa.float64()), pa.array([x[5] for x in found], pa.float64()), pa.array(same, pa.bool_()),
                ], names=["id", "rank", "ids", "n_pieces", "log_prob", "perturbed", "inclusion", "round_trip"])

    out = rows.mapInArrow(draw, f"id {kind}, rank int, ids {'binary' if packed else 'array<int>'}, n_pieces long, log_prob double, perturbed double, inclusion double, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode_pieces(samples: DataFrame, ids_col: str = "ids", to: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """samples with the text that array<int> ids stand for, as column to; null ids give null. Ids out of range fail."""
    schema = samples.withColumn(to, F.lit(None).cast("string")).schema

    def back(batches):
        vocab = vocabulary(model, 1.0)
        for b in batches:
            out = [None if x is None else vocab.decode(np.array(x, np.int64)).tobytes()[1:].decode() for x in b.column(ids_col).to_pylist()]
            columns = {n: b.column(n) for n in b.schema.names} | {to: pa.array(out, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], names=schema.names)

    return samples.mapInArrow(back, schema)


def sample_pieces_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, rank, n_pieces, ids_sha256 (of 32-bit little-endian ids), log_prob, inclusion and round_trip."""
    return sample_pieces(docs, packed=True, **options).select("doc_id", "rank", "n_pieces", F.sha2("ids", 256).alias("ids_sha256"), F.round("log_prob", 6).alias("log_prob"), F.round("inclusion", 9).alias("inclusion"), "round_trip")
