"""SentencePiece sampling: distinct segmentations of a text by Gumbel top-k without replacement.

All segmentations of a text into pieces of a SentencePiece vocabulary form a lattice. A piece weighs 1 / (rank + RANK),
its rank being its place by score in the vocabulary; characters without a piece fall back to their UTF-8 bytes. A
backward pass gives each edge its probability given its node, so a path is drawn edge by edge.

The search is A* over sets of paths with perturbed log-probabilities: the set of all paths has a Gumbel value; the
path drawn from a set takes the set's value, and at each of its nodes the other edges make up a new set, whose value is
a Gumbel value of its mass, held below the value of the path. The set of the largest value is opened next. The paths
come out as by sorting all segmentations by log-probability plus Gumbel noise: a sample without replacement in order.
The next set's value is the threshold of the sample, and 1 - exp(-exp(log-probability - threshold)) is the inclusion
score of a path: sums over the sample weighted with its inverse are unbiased.

Pieces don't reach across the start of a run of spaces, so the lattice is built for the distinct words of a batch, whose
equal ends share their nodes, and WALKED words are walked at once. Random numbers are hashes of the row's key, the round, the word and the step:
a row gives the same sample in any batch or partition. A word of more than LONG characters, as in scripts without spaces,
has its lattice built along the word and its walks finished alone, at a few microseconds a character. Sets that lie beyond a node whose paths have less than
exp(cutoff) of all probability are never opened: at CUTOFF they have together less than the rounding of a double, and a
cutoff of minus infinity opens all.

Defined cases: a null or empty text has one segmentation, without pieces. A text with fewer segmentations than k gives
all of them, each with score 1. A null key counts as 0. The character that stands for a space decodes as a space. Equal
Gumbel values, which 53 random bits hardly ever give, are opened in the order in which their sets were made. Repeated rows
of a key get equal samples. Other columns aren't read, so their names may be any. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cache
from math import exp
from math import log as ln

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidy

SAMPLES = 3
RANK = 10
SPACE = "▁"
CUTOFF = -40.0
#: Characters of the texts whose lattices are held at a time; a longer text is held alone.
CHUNK_CHARS = 12_000_000
#: A word of so many characters has its lattice built along the word, not with other words of its length; and so many
#: of its places at a time.
LONG = 192
PLACES = 1 << 15
#: Words of texts whose paths are drawn together, so that their arrays stay in a core's cache; a longer text is drawn alone.
WALKED = 1 << 15
#: Walks that so few words still need are finished one by one.
FEW = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """A number inside (0, 1) for each number."""
    u = (mixed(x) >> np.uint64(11)).astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    return u


class Vocabulary:
    """Pieces by the hash of their characters."""

    def __init__(self, file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        normal.sort(key=lambda i: (-model.get_score(i), i))
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece reaches across the start of a word")
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.single = np.array(self.bytes, np.int32)
        weights = 1 / (np.arange(len(normal)) + RANK)
        self.byte_log = float(np.log(weights[-1] / weights.sum()))
        keys = np.array([self.key(self.pieces[i]) for i in normal], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids, self.logs = keys[order], np.array(normal, np.int32)[order], np.log(weights / weights.sum())[order]
        # two direct tables of places in keys, by different bits of a hash; the second has what the first can't hold
        self.slots = np.zeros((2, 1 << 20), np.int32)
        place = np.arange(len(keys), dtype=np.int32)
        for self.spread in mixed(np.arange(1, 1000, dtype=np.uint64)) | np.uint64(1):
            first, second = self._places(self.keys)
            self.slots[0, first] = place
            left = place[self.slots[0, first] != place]
            self.slots[1, second[left]] = left
            if (self.find(self.keys)[0] == place).all():
                break
        self.longest = max(len(self.pieces[i]) for i in normal)
        self.starts = np.zeros(1 << 20, bool)
        self.starts[self._places(np.array([self.key(p) for p in {self.pieces[i][:k] for i in normal for k in range(1, len(self.pieces[i]))}], np.uint64))[0]] = True
        self.powers = np.array([pow(int(_BASE), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spread = hashes * self.spread
        return spread >> np.uint64(44), spread >> np.uint64(24) & np.uint64(0xFFFFF)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of hashes in keys, and whether they are there."""
        first, second = self._places(hashes)
        at = self.slots[0, first]
        at = np.where(self.keys[at] == hashes, at, self.slots[1, second])
        return at, self.keys[at] == hashes

    def begins(self, hashes: np.ndarray) -> np.ndarray:
        """Whether longer pieces may start with what has a hash; never false when one does."""
        return self.starts[self._places(hashes)[0]]

    @staticmethod
    def key(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c)) % (1 << 64)
        return h

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation."""
        raw = bytearray()
        single = {p: b for b, p in enumerate(self.bytes)}
        for i in ids:
            raw += bytes([single[i]]) if i in single else self.pieces[i].encode()
        return raw.decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ")


class Lattice:
    """The lattices of distinct words (a space mark is put before each). A node is an end of words, from one of their
    characters on: what can follow there depends on that end alone, so words with equal ends share its nodes, and node 0
    is the empty end. Edges are in order of nodes; the likeliest edge of a node comes first.

    An edge has a piece (or -1 - c for the bytes of character c, if there are several), the node it leads to, its log-probability at its
    node, and the sum of the probabilities up to it (2 for the last); a node has a first edge."""

    def __init__(self, words: list[str], vocabulary: Vocabulary) -> None:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.start = np.zeros(len(words), np.int32)
        long = np.flatnonzero(sizes > LONG).tolist()
        short = np.flatnonzero(sizes <= LONG)
        after, codes, levels = self._ends(words if not long else [words[i] for i in short.tolist()], sizes[short], short)
        n = len(after)
        # a long word has nodes of its own, in order along it
        bases = (n + np.cumsum(sizes[long]) - sizes[long]).tolist()
        degree = np.zeros(n + int(sizes[long].sum()), np.int64)
        parts = self._pieces(after, codes, levels, vocabulary, degree)
        own = []
        for i, base in zip(long, bases, strict=True):
            self.start[i] = base
            for node, rank, piece, width, log, total in self._long_edges(words[i], base, vocabulary, degree):
                to = node + width
                own.append((node, rank, piece, np.where(to == base + sizes[i], 0, to), log, total))
        self.long_ends = np.array([base + int(sizes[i]) for i, base in zip(long, bases, strict=True)], np.int64)
        self.first = np.concatenate([[0], np.cumsum(degree)]).astype(np.int32)
        self._shared_edges(parts, levels, degree[:n])
        if own:
            size = int(self.first[-1])
            for name in ("node", "piece", "to", "log", "total"):
                held = getattr(self, name)
                setattr(self, name, np.concatenate([held, np.empty(size - len(held), held.dtype)]))
            for node, rank, piece, to, log, total in own:
                at = self.first[node] + rank
                self.node[at], self.piece[at], self.to[at], self.log[at], self.total[at] = node, piece, to, log, total
        self.total[self.first[1:][degree > 0] - 1] = 2.0

    def _ends(self, words: list[str], sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """The ends of words as nodes: the node after each one's first character, that character, and the first node of each
        length. An end is known by its first character and the end after it."""
        order = np.argsort(-sizes, kind="stable")
        text = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) if words else np.empty(0, np.int64)
        behind, sizes, numbers = np.cumsum(sizes)[order], sizes[order], numbers[order]
        held = len(sizes) - np.cumsum(np.bincount(sizes, minlength=1)) if len(sizes) else np.zeros(1, np.int64)  # words longer than each length
        node = np.zeros(len(sizes), np.int64)
        after, codes, levels = [np.zeros(1, np.int32)], [np.zeros(1, np.uint64)], [0, 1]
        for d in range(1, len(held)):
            n = int(held[d - 1])
            node = node[:n]
            found = pa.array(node << 21 | text[behind[:n] - d]).dictionary_encode()
            ends = found.dictionary.to_numpy()
            after.append((ends >> 21).astype(np.int32))
            codes.append((ends & 0x1FFFFF).astype(np.uint64))
            node = found.indices.to_numpy().astype(np.int64) + levels[-1]
            done = int(held[d])
            self.start[numbers[done:n]] = node[done:]
            levels.append(levels[-1] + len(ends))
        return np.concatenate(after), np.concatenate(codes), levels

    @staticmethod
    def _pieces(after: np.ndarray, codes: np.ndarray, levels: list[int], v: Vocabulary, degree: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """(node, rank, piece, node after it, logarithm of its weight) of the pieces that start at each node, a part for each width."""
        node = at = np.arange(1, len(after), dtype=np.int32)
        hashes = np.zeros(len(node), np.uint64)
        out = []
        for k in range(1, min(v.longest, len(levels) - 2) + 1):
            if k > 1:  # ends that are long enough, and start like a piece
                low = int(np.searchsorted(node, levels[k]))
                keep = np.flatnonzero(v.begins(hashes[low:])) + low
                node, at, hashes = node[keep], at[keep], hashes[keep]
            c = codes[at]
            hashes = hashes * _BASE + c
            at = after[at]
            place, on = v.find(hashes)
            if k == 1:
                piece, log = v.ids[place], v.logs[place]
                lost = np.flatnonzero(~on)  # no piece for the character
                c = c[lost].astype(np.int64)
                piece[lost] = np.where(c < 0x80, v.single[np.minimum(c, 0x7F)], -1 - c)
                log[lost] = v.byte_log * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
                out.append((node, np.zeros(len(node), np.int32), piece, at, log))
                degree[1 : len(after)] = 1
                continue
            on = np.flatnonzero(on)
            own, place = node[on], place[on]
            out.append((own, degree[own], v.ids[place], at[on], v.logs[place]))
            degree[own] += 1
        return out

    def _shared_edges(self, parts: list[tuple[np.ndarray, ...]], levels: list[int], degree: np.ndarray) -> None:
        """The edges of the shared nodes: masses from short ends to long ones, then the likeliest edge of a node before the others by width."""
        first = self.first[: len(degree) + 1].astype(np.int64)
        n = int(first[-1])
        piece, to = (np.empty(n, np.int32) for _ in range(2))
        log = np.empty(n)
        for own, rank, p, ahead, weight in parts:
            at = first[own] + rank
            piece[at], to[at], log[at] = p, ahead, weight
        beta, odds = np.zeros(len(degree)), np.empty(n)
        for low, high in zip(levels[1:-1], levels[2:], strict=True):
            edges = slice(int(first[low]), int(first[high]))
            starts, counts = first[low:high] - first[low], degree[low:high]
            mass = log[edges] + beta[to[edges]]
            shift = mass[starts]  # of the edge of one character, which is always there
            e = np.exp(mass - np.repeat(shift, counts))
            whole = np.add.reduceat(e, starts)
            beta[low:high] = own = shift + np.log(whole)
            odds[edges], log[edges] = e / np.repeat(whole, counts), mass - np.repeat(own, counts)
        self.node = np.repeat(np.arange(len(degree), dtype=np.int32), degree)
        best = first[:-1].copy()
        if n:
            top = np.flatnonzero(odds == np.repeat(np.maximum.reduceat(odds, first[1:-1]), degree[1:]))[::-1]
            best[self.node[top]] = top  # the first of equal ones is written last
        places = np.arange(n)
        places += places < best[self.node]
        places[best[1:]] = first[1:-1]
        self.piece, self.to = (np.empty(n, np.int32) for _ in range(2))
        self.log, self.total = (np.empty(n) for _ in range(2))
        self.piece[places], self.to[places], self.log[places], self.total[places] = piece, to, log, odds
        at = first[:-1][degree > 1]
        counts = degree[degree > 1]
        for k in range(1, int(degree.max(initial=0))):
            if k > 1:
                at, counts = at[counts > k], counts[counts > k]
            self.total[at + k] += self.total[at + k - 1]

    @staticmethod
    def _ranked(log: np.ndarray, on: np.ndarray, piece: np.ndarray, node: np.ndarray, degree: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """The mass behind each node (a row of its edges by width, with the mass behind them), and its edges' columns."""
        shift = log[:, :1].copy()  # of the edge of one character, which is always there
        e = np.exp(log - shift)
        totals = np.cumsum(e, 1)
        whole = totals[:, -1:]
        beta = (shift + np.log(whole))[:, 0]
        # the likeliest edge comes first, so most draws end there; the others follow by width
        best = e.argmax(1)
        e_best = e[np.arange(len(e)), best][:, None]
        ahead = np.arange(log.shape[1])[None] < best[:, None]
        totals = np.where(ahead, totals + e_best, totals)
        totals[np.arange(len(e)), best] = e_best[:, 0]
        totals /= whole
        rows, width = np.nonzero(on)
        held = on.sum(1)
        degree[node] = held
        rank = (np.arange(len(rows)) - (np.cumsum(held) - held)[rows]).astype(np.int32) + ahead[on]
        rank[width == best[rows]] = 0
        return beta, (node[rows], rank, piece[on], (width + 1).astype(np.int32), log[on] - beta[rows], totals[on])

    @staticmethod
    def _long_edges(word: str, start: int, v: Vocabulary, degree: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """The edges of one long word: all look-ups of PLACES nodes at once, and one number after another only for the masses."""
        size, base, mask = len(word) + 1, int(_BASE), (1 << 64) - 1
        codes, sums = [ord(SPACE), *map(ord, word)], [0]
        for c in codes:
            sums.append((sums[-1] * base + c) & mask)
        prefix, codes = np.array(sums, np.uint64), np.array(codes, np.int64)
        beta = [0.0] * (size + 1)
        out = []
        for low in reversed(range(0, size, PLACES)):
            high = min(size, low + PLACES)
            log = np.full((high - low, v.longest), -np.inf)
            piece = np.zeros((high - low, v.longest), np.int32)
            on = np.zeros((high - low, v.longest), bool)
            for k in range(1, v.longest + 1):
                last = min(high, size - k + 1)
                if last <= low:
                    break
                at, found = v.find(prefix[low + k : last + k] - prefix[low:last] * v.powers[k])
                n = last - low
                on[:n, k - 1], piece[:n, k - 1], log[:n, k - 1] = found, v.ids[at], np.where(found, v.logs[at], -np.inf)
            lost = np.flatnonzero(~on[:, 0])
            c = codes[low + lost]
            piece[lost, 0] = np.where(c < 0x80, v.single[np.minimum(c, 0x7F)], -1 - c)
            log[lost, 0] = v.byte_log * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
            on[lost, 0] = True
            rows, width = np.nonzero(on)
            ends, weights, steps = np.searchsorted(rows, np.arange(1, high - low + 1)).tolist(), log[on].tolist(), (width + 1).tolist()
            at = len(weights)
            for i in range(high - low - 1, -1, -1):
                first = ends[i - 1] if i else 0
                place = low + i
                shift = weights[first] + beta[place + 1]
                total = 1.0
                for e in range(first + 1, at):
                    total += exp(weights[e] + beta[place + steps[e]] - shift)
                beta[place] = shift + ln(total)
                at = first
            behind = np.array(beta[low : high + v.longest + 1] + [0.0] * v.longest)
            log += behind[np.arange(high - low)[:, None] + np.arange(1, v.longest + 1)[None]]
            out.append(Lattice._ranked(log, on, piece, np.arange(start + low, start + high, dtype=np.int32), degree)[1])
        return out

    def walk(self, node: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Paths from nodes to the ends of their words: all their edges, and the number of edges of each."""
        counts = np.zeros(len(node), np.int64)
        steps = []
        at = np.flatnonzero(node)
        here, seeds = node[at], seeds[at]
        step = 0
        while len(at):
            if step >= LONG and len(at) <= FEW:
                break
            u = uniform(seeds + np.uint64(step))
            e = self.first[here]
            more = np.flatnonzero(u > self.total[e])
            while len(more):
                e[more] += 1
                more = more[u[more] > self.total[e[more]]]
            steps.append((at, e))
            here = self.to[e]
            counts[at] = step + 1
            on = np.flatnonzero(here)
            at, here, seeds = at[on], here[on], seeds[on]
            step += 1
        rest = {}
        for i, here, seed in zip(at.tolist(), here.tolist(), seeds, strict=True):
            rest[i] = self._finish(here, seed, step)
            counts[i] = step + len(rest[i])
        offset = np.cumsum(counts) - counts
        edges = np.empty(int(counts.sum()), np.int32)
        for k, (at, e) in enumerate(steps):
            edges[offset[at] + k] = e
        for i, found in rest.items():
            edges[offset[i] + step : offset[i] + counts[i]] = found
        return edges, counts

    def _finish(self, here: int, seed: np.uint64, step: int) -> list[int]:
        """The rest of one walk along a long word: its edges from a node to the end."""
        found = []
        end = int(self.long_ends[np.searchsorted(self.long_ends, here, side="right")])
        while here:
            low, stop = here, min(end, here + PLACES)
            draws = uniform(seed + np.arange(step, step + stop - here, dtype=np.uint64)).tolist()
            base = int(self.first[here])
            first = (self.first[here : stop + 1] - base).tolist()
            total, to = (x[base : base + first[-1]].tolist() for x in (self.total, self.to))
            k = 0
            while 0 < here < stop:
                u, e = draws[k], first[here - low]
                while u > total[e]:
                    e += 1
                found.append(base + e)
                here = to[e]
                k += 1
            step += k
        return found


class Search:
    """The A* search of one text: the sets still closed, and the paths drawn."""

    def __init__(self, seed: int, words: np.ndarray, cutoff: float = CUTOFF) -> None:
        self.seed, self.words, self.cutoff = np.uint64(seed), words, cutoff
        self.paths: list[tuple[np.ndarray, np.ndarray, float]] = []  # edges, edges of each word, log-probability
        self.closed: list[tuple[float, int, int, int, float, tuple[int, ...]]] = []
        self.made = 0

    def add(self, edges: np.ndarray, counts: np.ndarray, logs: np.ndarray, value: float, fresh: int, before: float, k: int) -> None:
        """Keep a drawn path and the sets at its nodes from the edge number fresh on; logs: log-probabilities of those edges, before: up to them."""
        self.paths.append((edges, counts, before + float(logs.sum())))
        n = 128
        while True:
            ahead = before + np.concatenate([[0.0], np.cumsum(logs[:n])])
            if len(ahead) <= n or ahead[-1] < self.cutoff:
                break
            n *= 4
        at = np.flatnonzero((ahead[:-1] > self.cutoff) & (logs[:n] < -1e-15))
        if len(at):
            mass = ahead[at] + np.log(-np.expm1(logs[at]))
            noise = np.log(-np.log(uniform(self.seed + np.uint64(self.made + 1 << 20) + at.astype(np.uint64))))
            values = mass - np.logaddexp(mass - value, noise)
            top = np.argpartition(values, len(values) - k - 1)[len(values) - k - 1 :] if len(values) > k + 1 else np.arange(len(values))
            for j in top.tolist():
                p = int(at[j])
                heapq.heappush(self.closed, (-float(values[j]), len(self.paths) - 1, fresh + p, self.made, float(ahead[p]), (int(edges[fresh + p]),)))
        self.made += 1

    def open(self, lattice: Lattice) -> tuple | None:
        """Draw an edge from the set of the largest value: (value, path, place, edge, log-probability up to and with it)."""
        if not self.closed:
            return None
        value, path, place, _, before, drawn = heapq.heappop(self.closed)
        value = -value
        node = lattice.node[drawn[0]]
        low, high = int(lattice.first[node]), int(lattice.first[node + 1])
        edges = [e for e in range(low, high) if e not in drawn]
        logs = lattice.log[low:high].tolist()
        odds = [exp(logs[e - low]) for e in edges]
        self.made += 1
        u, u2 = uniform(self.seed + np.uint64(self.made << 20) + np.arange(2, dtype=np.uint64)).tolist()
        left, j = u * sum(odds), 0
        while j < len(odds) - 1 and left > odds[j]:
            left -= odds[j]
            j += 1
        rest = sum(odds[:j]) + sum(odds[j + 1 :])
        if rest > 0:
            mass = before + ln(rest)
            other = mass - np.logaddexp(mass - value, ln(-ln(u2)))
            heapq.heappush(self.closed, (-float(other), path, place, self.made, before, (*drawn, edges[j])))
        return value, path, place, edges[j], before + logs[edges[j] - low]


def sample(keys: list[int | None], texts: list[str | None], vocabulary: Vocabulary, k: int = SAMPLES, cutoff: float = CUTOFF) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text its samples in order: (ids, log-probability, inclusion score)."""
    return list(samples(keys, texts, vocabulary, k, cutoff))


def samples(keys: list[int | None], texts: list[str | None], vocabulary: Vocabulary, k: int = SAMPLES, cutoff: float = CUTOFF) -> Iterator[list[tuple[np.ndarray, float, float]]]:
    """What sample returns, one text after another: all texts share a lattice, and few words are walked at a time."""
    plain = [(t or "").replace(SPACE, " ") for t in texts]
    runs = {i: [w[1:] for w in _RUNS.findall((SPACE + t.replace(" ", SPACE)))] for i, t in enumerate(plain) if t[:1] == " " or "  " in t}
    lists = pc.split_pattern(pa.array([None if i in runs or not t else t for i, t in enumerate(plain)], pa.large_string()), " ")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    extra = [w for words in runs.values() for w in words]
    coded = pa.concat_arrays([lists.flatten(), pa.array(extra, pa.large_string())]).dictionary_encode()
    lattice = Lattice(coded.dictionary.to_pylist(), vocabulary)
    numbers, ends = coded.indices.to_numpy(), np.cumsum(sizes)
    at, where = int(ends[-1]) if len(ends) else 0, {}
    for i, words in runs.items():
        where[i] = (at, at + len(words))
        at += len(words)
    del plain, runs, lists, extra, coded
    seeds = mixed(np.array([(x or 0) % (1 << 64) for x in keys], np.uint64) * _BASE + np.uint64(1)).tolist()
    held: list[Search] = []
    words = 0
    for i, (seed, n, end) in enumerate(zip(seeds, sizes.tolist(), ends.tolist(), strict=True)):
        one = Search(seed, numbers[slice(*where.get(i, (end - n, end)))], cutoff)
        if held and words + len(one.words) > WALKED:
            yield from _drawn(held, lattice, vocabulary, k)
            held, words = [], 0
        held.append(one)
        words += len(one.words)
    yield from _drawn(held, lattice, vocabulary, k)


def _drawn(searches: list[Search], lattice: Lattice, vocabulary: Vocabulary, k: int) -> Iterator[list[tuple[np.ndarray, float, float]]]:
    """The samples of some texts; their words are walked together."""
    active = [s for s in searches if len(s.words)]
    opened: list[tuple | None] = [None] * len(active)
    for turn in range(k):
        if turn:
            opened = [s.open(lattice) for s in active]
            active, opened = [s for s, o in zip(active, opened, strict=True) if o], [o for o in opened if o]
        if not active:
            break
        nodes, hashes, sizes, froms = [], [], [], []
        for s, o in zip(active, opened, strict=True):
            first = 0
            if o:  # the word of the place where the path parts from that of the set
                first = int(np.searchsorted(np.cumsum(s.paths[o[1]][1][: o[2] + 1]), o[2], side="right"))
            node = lattice.start[s.words[first:]]
            if o:
                node[0] = lattice.to[o[3]]
            nodes.append(node)
            hashes.append(s.seed + (np.arange(first, len(s.words), dtype=np.uint64) * np.uint64(64) + np.uint64(turn + 1 << 50)))
            sizes.append(len(node))
            froms.append(first)
        edges, counts = lattice.walk(np.concatenate(nodes), mixed(np.concatenate(hashes)))
        logs = lattice.log[edges]
        ends_of = np.concatenate([[0], np.cumsum(counts)])
        at = 0
        for s, o, n, first in zip(active, opened, sizes, froms, strict=True):
            low, high = ends_of[at], ends_of[at + n]
            tail, own, fresh = edges[low:high], counts[at : at + n], logs[low:high]
            at += n
            if o is None:
                g = -np.log(-np.log(uniform(np.array([s.seed], np.uint64))[0]))
                s.add(tail, own, fresh, float(g), 0, 0.0, k)
            else:
                value, path, place, edge, before = o
                old, old_counts, _ = s.paths[path]
                own = own.copy()
                own[0] += 1 + place - int(old_counts[:first].sum())
                s.add(np.concatenate([old[:place], np.array([edge], np.int32), tail]), np.concatenate([old_counts[:first], own]), fresh, value, place + 1, before, k)
    for s in searches:
        yield _results(s, lattice, vocabulary)


def _results(s: Search, lattice: Lattice, vocabulary: Vocabulary) -> list[tuple[np.ndarray, float, float]]:
    if not len(s.words):
        return [(np.empty(0, "<u4"), 0.0, 1.0)]
    threshold = -s.closed[0][0] if s.closed else -np.inf
    out = []
    for edges, _, log in s.paths:
        ids = lattice.piece[edges]
        if (ids < 0).any():
            raw = [vocabulary.bytes[b] if i < 0 else i for i in ids.tolist() for b in (chr(-1 - i).encode("utf-8", "surrogatepass") if i < 0 else (0,))]
            ids = np.array(raw)
        with np.errstate(over="ignore"):
            out.append((ids.astype("<u4"), log, float(-np.expm1(-np.exp(log - threshold)))))
    return out


@cache
def vocabulary(file: str) -> Vocabulary:
    """One vocabulary for each file in a Python worker."""
    return Vocabulary(file)


def segmentations(docs: DataFrame, file: str, key: str = "doc_id", text: str = "text", k: int = SAMPLES, with_ids: bool = False, cutoff: float = CUTOFF) -> DataFrame:
    """A row for each sample: key, sample (from 1), n_pieces, log_prob, inclusion, ids_crc32, and ids if wanted. No shuffle."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(file)
        keys: list[int | None] = []
        texts: list[str | None] = []
        chars = 0

        def drawn() -> pa.RecordBatch:
            found = samples(keys, texts, v, k, cutoff)
            rows = [(d, i + 1, len(ids), log, share, zlib.crc32(ids), ids if with_ids else None) for d, own in zip(keys, found, strict=True) for i, (ids, log, share) in enumerate(own)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int32()))
            names = ["key", "sample", "n_pieces", "log_prob", "inclusion", "ids_crc32", "ids"][: 6 + with_ids]
            columns = zip(names, zip(*rows, strict=True), kinds, strict=False)
            return pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32) for x in c] if n == "ids" else c, t) for n, c, t in columns], names)

        for batch in batches:
            for d, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if keys and chars + len(text or "") > CHUNK_CHARS:
                    yield drawn()
                    keys.clear()
                    texts.clear()
                    chars = 0
                keys.append(d)
                texts.append(text)
                chars += len(text or "")
        if keys:
            yield drawn()

    schema = "key long, sample int, n_pieces long, log_prob double, inclusion double, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(tidy(run), schema).withColumnRenamed("key", key)
