"""N-gram Jaccard join with signature trees.

Documents are sets of k-word shingles; two link when their sets' Jaccard similarity reaches a threshold. The result is
exact up to collisions of the 64-bit shingle hashes.

1. Copies collapse: documents with equal sets (size and a 128-bit digest) become one node.
2. Candidate lists. By the prefix principle, two linked sets share one of the first n - ceil(t n) + 1 shingles of
   each, in any order of shingles that all sets use. The order is by hash, but shingles that more than ``HOT`` nodes
   have among the shingles written out go to its end, so that passages many documents share make no candidates. The
   nodes of each prefix shingle are a list; equal lists are one. A node stays in a list only if another one fits it in
   size and both have enough shingles left from this one on; all that linked sets share comes from the first shingle in
   common on, so their first list keeps both. Nodes of a shingle that more than ``BLOCK`` of them have are told apart
   by size bands (linked sets are in the same band or in neighbouring ones) and never gathered.
3. First look: each node in its largest list only (long lists in blocks). A signature tree (leaves hold documents in
   order of size; a node holds the OR of its documents' bitmaps and their size range) is traversed against itself,
   which prunes pairs that sizes or the bits both have rule out; what it can't rule out is compared by the whole sets.
   This connects most of what links connect, so that most lists now lie in one component and are done with.
4. Every list that still holds several components goes through such a tree again. It makes no pairs: it tells which
   documents have any partner in another component that can't be ruled out, and a local group for each of them, so
   that all such pairs lie within one group. Groups that share documents join into one. All sets of a group, each sent
   once, are compared exactly in one task. Groups of more than ``GROUP_ROWS`` documents or ``GROUP_SHINGLES`` shingles
   are first cut into blocks by size band; then documents outside the largest component of a band meet all others of
   it in pairs of blocks.
5. Connected components of the links; every document gets its node's component.

So the rows made are in proportion to the nodes and their prefixes, never to the pairs; a group whose documents are all
near each other, but below the threshold, costs time with the square of its size, in numpy within its blocks.

Null or empty text, or one without words: empty set, linked with nothing, component_id = doc_id. Fewer than k words:
the whole sequence is the one shingle. Rows that share a doc_id are one document, in one component, whatever their
texts. Null doc_id: the row gets the component of equal texts (null if they have none) and makes no other links. Ties:
the smallest doc_id names a component. Extra columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.components import components
from plenum.llm.key_filter import key_filter
from plenum.llm.scratch import Scratch, materialise
from plenum.llm.textbytes import buffers, groups, mix, shingles, trimmed, words

#: Nodes that share a shingle before it counts as hot, and the most shingles that do (else only the more frequent ones
#: do); nodes of a block; children of a tree node.
HOT, HOT_KEYS, BLOCK, FANOUT = 64, 1 << 21, 512, 8
#: Most documents, and shingles of them together, that are compared in one task.
GROUP_ROWS, GROUP_SHINGLES = 4096, 1 << 20
LEAST_BITS, MOST_BITS, MOST_WORDS = 256, 1 << 17, 1 << 19
HEADS = "doc_id long, n int, d1 long, d2 long, pre array<long>, sig binary"
#: A node's name: its smallest doc_id and half of its set's digest, which tells apart the sets of rows with one doc_id.
NODE = ["rep", "d1"]
#: A set's name: its size and its whole digest.
SET = ["n", "d1", "d2"]
PREFIXES = "h long, rep long, d1 long, n int, rest int"


def prefix_length(n, num: int, den: int):
    """For a set of n shingles at the threshold num / den."""
    return n - (num * n + den - 1) // den + 1


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    raw, at = buffers(column)
    for low, high in groups(at):
        word, first = words(raw[at[low] : at[high]], at[low : high + 1] - at[low])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            yield np.unique(shingles(word[a:b], k).view(np.int64))


def _digest(own: np.ndarray) -> tuple[int, int]:
    bits = own.view(np.uint64)
    return int(mix(bits).sum().view(np.int64)), int(mix(bits + np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64))


def signature(own: np.ndarray) -> bytes:
    """A bitmap of two to four bits for each shingle, packed; its width is a power of two."""
    width = LEAST_BITS
    while width < 2 * len(own) and width < MOST_BITS:
        width *= 2
    flags = np.zeros(width, np.uint8)
    flags[own.view(np.uint64) & np.uint64(width - 1)] = 1
    return np.packbits(flags).tobytes()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def shingle_heads(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """For each row n, the digest, the first shingles (its prefix and a reserve for hot ones in it), the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, len(whole), 1000):
                batch = whole.slice(low, 1000)
                n, d1, d2, pre, sig = [], [], [], [], []
                for own in _sets(batch.column(1), k):
                    a, b = _digest(own)
                    size = prefix_length(len(own), num, den)
                    n.append(len(own))
                    d1.append(a)
                    d2.append(b)
                    pre.append(own[: size + size // 6 + 6] if len(own) else own)
                    sig.append(signature(own))
                ends = pa.array(np.cumsum([0, *map(len, pre)]), pa.int32())
                heads = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *pre]), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), heads, pa.array(sig, pa.binary())], ["doc_id", "n", "d1", "d2", "pre", "sig"])

    return _rows(docs).mapInArrow(trimmed(run), HEADS)


def whole_sets(docs: DataFrame, nodes: DataFrame, k: int, work: Scratch) -> DataFrame:
    """(rep, d1, n, own) of the given nodes (rep, d1): their sets as packed 64-bit numbers, made again from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, len(whole), 500):
                batch = whole.slice(low, 500)
                own = list(_sets(batch.column(1), k))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_digest(x)[0] for x in own], pa.int64()), pa.array([len(x) for x in own], pa.int32()), pa.array([x.tobytes() for x in own], pa.binary())], ["rep", "d1", "n", "own"])

    nodes = work.keep(nodes.select(*NODE).distinct(), "wanted")
    texts = key_filter(nodes, "rep").maybe(_rows(docs), "doc_id").select("doc_id", "text")
    found = texts.mapInArrow(trimmed(run), "rep long, d1 long, n int, own binary")
    return found.groupBy(*NODE).agg(F.first("n").alias("n"), F.first("own").alias("own")).join(nodes, NODE, "left_semi")


def folded(signatures: list[bytes]) -> np.ndarray:
    """The signatures as rows of 64-bit words, all as wide as the narrowest."""
    width = min(map(len, signatures))
    if width == max(map(len, signatures)):
        return np.frombuffer(b"".join(signatures), np.uint64).reshape(len(signatures), -1)
    out = np.zeros((len(signatures), width // 8), np.uint64)
    for i, sig in enumerate(signatures):
        # A shingle's bit is its hash modulo the width, so the parts of a wider bitmap fold onto each other.
        out[i] = np.bitwise_or.reduce(np.frombuffer(sig, np.uint64).reshape(-1, width // 8), axis=0)
    return out


def uniform(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For stretches of documents that begin at ``first`` the label that all of a stretch have, or -1."""
    low = np.minimum.reduceat(label, first)
    return np.where(low == np.maximum.reduceat(label, first), low, -1)


class SignatureTree:
    """Over documents in order of size. A level is (bitmaps, least size, greatest size, greatest excess of a set's
    size over its bits, first document) of each node."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.levels = [(bits, sizes, sizes, sizes - np.bitwise_count(bits).sum(1, dtype=np.int64), np.arange(len(sizes)))]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, excess, first = self.levels[-1]
            cut = np.arange(0, len(bits), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(excess, cut), first[cut]))

    def pairs(self, num: int, den: int, settled: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Lots of pairs of documents that sizes and bits don't rule out, by dual traversal, those with a first
        document together. settled(first, x, y): which pairs of nodes (stretches that begin at ``first``) need no
        look; it is asked anew at each step, so what is learnt from one lot spares later ones."""
        step = max(FANOUT * FANOUT, (1 << 19) // self.levels[0][0].shape[1])
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        child = np.arange(FANOUT)
        while todo:
            level, x, y = todo.pop()
            if len(x) > step:
                todo += [(level, x[step:], y[step:]), (level, x[:step], y[:step])]
                continue
            bits, low, high, excess, first = self.levels[level]
            open_ = ~settled(first, x, y)
            x, y = x[open_], y[open_]
            can = np.minimum(high[x], np.minimum(high[y], np.bitwise_count(bits[x] & bits[y]).sum(1, dtype=np.int64) + np.minimum(excess[x], excess[y])))
            keep = (den * high[x] >= num * low[y]) & (can * (num + den) >= num * (low[x] + low[y]))  # x <= y, and sizes ascend
            x, y = x[keep], y[keep]
            if not len(x):
                continue
            if level == 0:
                yield x, y
                continue
            i = np.broadcast_to(x[:, None, None] * FANOUT + child[:, None], (len(x), FANOUT, FANOUT)).ravel()
            j = np.broadcast_to(y[:, None, None] * FANOUT + child, (len(x), FANOUT, FANOUT)).ravel()
            fits = (j < len(self.levels[level - 1][0])) & (i < j if level == 1 else i <= j)
            todo.append((level - 1, i[fits], j[fits]))


def chains(sizes: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Stretches of ascending sizes between which no link is possible."""
    cut = [0, *(np.flatnonzero(den * sizes[:-1] < num * sizes[1:]) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cut, cut[1:]) if b - a > 1]


def _in_order(sizes: list[int], known: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by size, sizes and small numbers for ``known`` in it."""
    size, known = np.array(sizes, np.int64), np.unique(np.array(known, np.int64), return_inverse=True)[1]
    order = np.lexsort((known, size))
    return order, size[order], known[order]


def local_groups(sizes: list[int], signatures: list[bytes], known: list[int], num: int, den: int) -> np.ndarray:
    """A group's number for each document of a list, -1 for none: documents of different components (``known``) that
    sizes and signatures don't rule out as linked are in one group."""
    order, size, known = _in_order(sizes, known)
    out = np.full(len(sizes), -1)
    for low, high in chains(size, num, den):
        group, own, met = np.arange(high - low), known[low:high], np.zeros(high - low, bool)
        if own.min() == own.max():
            continue

        def settled(first: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            a, b = uniform(own, first), uniform(group, first)
            return (a[x] == a[y]) & (a[x] >= 0) | (b[x] == b[y]) & (b[x] >= 0)

        for x, y in SignatureTree(size[low:high], folded([signatures[i] for i in order[low:high]])).pairs(num, den, settled):
            met[x] = met[y] = True
            for a, b in zip(x.tolist(), y.tolist()):
                if group[a] != group[b]:
                    group[group == group[b]] = group[a]
        out[order[low:high][met]] = order[low + group[met]]
    return out


class Overlaps:
    """How many shingles a set has in common with each of the sets, by the lists of sets that have a shingle."""

    def __init__(self, own: list[np.ndarray]):
        self.sets, self.edge = len(own), np.cumsum([0, *map(len, own)])
        flat = np.concatenate(own)
        order = np.argsort(flat, kind="stable")
        new = np.concatenate([[True], flat[order[1:]] != flat[order[:-1]]])
        self.token = np.empty(len(flat), np.int64)
        self.token[order] = np.cumsum(new) - 1
        self.start = np.append(np.flatnonzero(new), len(flat))
        self.owner = np.repeat(np.arange(len(own)), np.diff(self.edge))[order]

    def of(self, i: int) -> np.ndarray:
        token = self.token[self.edge[i] : self.edge[i + 1]]
        length = self.start[token + 1] - self.start[token]
        place = np.repeat(self.start[token] - np.cumsum(length) + length, length) + np.arange(length.sum())
        return np.bincount(self.owner[place], minlength=self.sets)


def linked(sets: list[np.ndarray], known: list[int], num: int, den: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links between the sets (numbers in the list) that connect what ``known`` (a component for each) doesn't: as
    many as it takes to connect all that linked sets connect. And a number for each set, the same for connected ones."""
    order, size, known = _in_order([len(x) for x in sets], known)
    label, found = known.copy(), []
    for low, high in chains(size, num, den):
        own = [sets[i] for i in order[low:high]]
        count, done, overlaps = size[low:high], np.zeros(high - low, np.int64), None

        def settled(first: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            a, b = uniform(label[low:high], first), uniform(done, first)
            return (a[x] == a[y]) & (a[x] >= 0) | (b[x] == 1) | (b[y] == 1)

        for x, y in SignatureTree(count, folded([signature(s) for s in own])).pairs(num, den, settled):
            for a in np.unique(x).tolist():
                b = y[x == a] + low
                if done[a] or not ((label[b] != label[low + a]) & (done[b - low] == 0)).any():
                    continue
                # One look at the set tells all its links, so it need not be met again.
                overlaps = overlaps or Overlaps(own)
                common, done[a] = overlaps.of(a), 1
                for b in np.flatnonzero(den * common >= num * (count[a] + count - common)).tolist():
                    if label[low + b] != label[low + a]:
                        label[label == label[low + b]] = label[low + a]
                        found.append((int(order[low + a]), int(order[low + b])))
    return found, label[np.argsort(order)]


def _by_list(rows: DataFrame, columns: list[str], schema: str, work: Callable) -> DataFrame:
    """work(rows of the list) for every list of several rows; it returns columns of the result or None. A list is
    bounded, and a task holds one at a time."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def done() -> Iterator[pa.RecordBatch]:
            found = work(held) if len(held) > 1 else None
            if found:
                yield pa.RecordBatch.from_arrays(found, names)

        for batch in batches:
            for lid, *row in zip(*(batch.column(c).to_pylist() for c in range(len(columns) + 1))):
                if lid != now:
                    yield from done()
                    held, now = [], lid
                held.append(row)
        yield from done()

    return rows.select("lid", *columns).repartition("lid").sortWithinPartitions("lid").mapInArrow(trimmed(run), schema)


def near_members(lists: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(rep, d1, comp, n, grep, gd1): of the lists (lid, rep, d1, comp) the members that signature trees can't rule out
    as linked with a member of another component, each with the first member (grep, gd1) of its local group."""

    def work(held: list) -> list[pa.Array] | None:
        group = local_groups([x[3] for x in held], [x[4] for x in held], [x[2] for x in held], num, den)
        kept = np.flatnonzero(group >= 0).tolist()
        if not kept:
            return None
        own = [pa.array([held[i][c] for i in kept], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32()))]
        return own + [pa.array([held[group[i]][c] for i in kept], pa.int64()) for c in (0, 1)]

    rows = lists.join(nodes.select(*NODE, "n", "sig"), NODE)
    return _by_list(rows, [*NODE, "comp", "n", "sig"], "rep long, d1 long, comp long, n int, grep long, gd1 long", work)


def verify(lists: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) inside the lists (lid, rep, d1, comp), as many as connect what links connect."""

    def work(held: list) -> list[pa.Array] | None:
        found, _ = linked([np.frombuffer(x[2], np.int64) for x in held], [x[1] for x in held], num, den)
        return [pa.array([held[i][0] for i, _ in found], pa.int64()), pa.array([held[j][0] for _, j in found], pa.int64())] if found else None

    return _by_list(lists.join(sets.select(*NODE, "own"), NODE), ["rep", "comp", "own"], "a long, b long", work)


def connected(lists: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(rep, d1, comp) of members of the lists (lid, rep, d1) with a link to another one; no node is in two lists."""

    def work(held: list) -> list[pa.Array] | None:
        found, label = linked([np.frombuffer(x[2], np.int64) for x in held], list(range(len(held))), num, den)
        least: dict[int, int] = {}
        for x, own in zip(held, label.tolist()):
            least[own] = min(x[0], least.get(own, x[0]))
        kept = sorted({i for pair in found for i in pair})
        return [pa.array([held[i][c] for i in kept], pa.int64()) for c in (0, 1)] + [pa.array([least[label[i]] for i in kept], pa.int64())] if kept else None

    return _by_list(lists.join(sets.select(*NODE, "own"), NODE), [*NODE, "own"], "rep long, d1 long, comp long", work)


def _bits(keys: DataFrame) -> np.ndarray:
    """A bit filter of shingle hashes (column h) as 64-bit words, of at most ``MOST_WORDS``. It never loses a hash."""
    n, size = keys.count(), 1 << 10
    while size < MOST_WORDS and size < n:
        size *= 2
    word = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(size - 1).cast("long"))
    rows = keys.groupBy(word.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(size, np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("v").to_numpy().view(np.uint64)
    return out


def _in_bits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h.view(np.uint64)
    return (bits[((h >> np.uint64(6)) & np.uint64(len(bits) - 1)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1


def _prefix(own: np.ndarray, n: int, hot: np.ndarray, num: int, den: int) -> np.ndarray | None:
    """The prefix of a set of n shingles of which ``own`` are the first by hash: those that are not hot come before
    those that are. None if ``own`` holds too few that are not."""
    size, is_hot = prefix_length(n, num, den), _in_bits(hot, own)
    cold = own[~is_hot][:size]
    if len(cold) < size and len(own) == n:
        return np.concatenate([cold, own[is_hot][: size - len(cold)]])
    return cold if len(cold) == size else None


def _rows_of(found: list[tuple[int, int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of (rep, d1, n, places, shingles)."""
    sizes = [len(x) for *_, x in found]
    reps, tags, n = (np.repeat(np.array([x[c] for x in found], np.int64), sizes) for c in range(3))
    places, h = (np.concatenate([np.zeros(0, np.int64), *(x[c] for x in found)]) for c in (3, 4))
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(reps), pa.array(tags), pa.array(n.astype(np.int32)), pa.array((n - places).astype(np.int32))], ["h", *NODE, "n", "rest"])


def _hot(shared: DataFrame) -> DataFrame:
    """The rows (h, count) of frequent shingles: over ``HOT``, or over the power of two that leaves ``HOT_KEYS``."""
    classes = shared.where(F.col("count") > HOT).groupBy(F.floor(F.log2("count")).alias("c")).agg(F.count("*").alias("keys"))
    bound, keys = HOT, 0
    for c, more in sorted(((r["c"], r["keys"]) for r in classes.collect()), reverse=True):  # one row for each power of two
        keys += more
        if keys > HOT_KEYS:
            bound = max(HOT, 2 ** (c + 1) - 1)
            break
    return shared.where(F.col("count") > bound)


def _prefixes(docs: DataFrame, nodes: DataFrame, k: int, num: int, den: int, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """(h, rep, d1, n, rest): each node's prefix shingles, of those that other nodes may share, with the size of its
    set and how many of the set, in the order, begin with this one; and (h) of all shingles that more than ``BLOCK``
    nodes have in their prefixes, possibly with others.

    What is hot is decided by one bit filter of the shingles that are frequent among the heads, for all nodes alike;
    which they are matters for speed only, so its false hits do no harm."""
    context = docs.sparkSession.sparkContext
    rows = nodes.select(F.explode("pre").alias("h"))
    shared = work.keep(rows.groupBy("h").agg(F.count("*").alias("count")).where("count > 1"), "shared")
    hot = context.broadcast(_bits(_hot(shared)))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_pylist()
            keep = [_prefix(own, n[i], hot.value, num, den) is None for i, own in enumerate(_lists(batch.column(3)))]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in (0, 1)], NODE)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, d1 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)]
            own = [_prefix(x, len(x), hot.value, num, den) for x in sets]
            yield _rows_of([(rep[i], d1[i], len(sets[i]), np.arange(len(x)), x) for i, x in enumerate(own)])

    # Sets with more hot shingles than the reserve: their prefix is taken from the whole set.
    rest = nodes.select(*NODE, "n", "pre").mapInArrow(short, "rep long, d1 long")
    full = work.keep(whole_sets(docs, rest, k, work).select(*NODE, "own").mapInArrow(trimmed(whole), PREFIXES), "full")
    kept = context.broadcast(_bits(shared.select("h").unionByName(full.select("h"))))

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, d1, n = (batch.column(i).to_pylist() for i in range(3))
            found = []
            for i, own in enumerate(_lists(batch.column(3))):
                x = _prefix(own, n[i], hot.value, num, den)
                if x is not None:
                    places = np.flatnonzero(_in_bits(kept.value, x))
                    found.append((rep[i], d1[i], n[i], places, x[places]))
            yield _rows_of(found)

    # A shingle with at most BLOCK nodes in either table has at most twice as many in both.
    large = shared.where(F.col("count") > BLOCK).select("h").unionByName(full.groupBy("h").agg(F.count("*").alias("count")).where(F.col("count") > BLOCK).select("h"))
    return nodes.select(*NODE, "n", "pre").mapInArrow(enough, PREFIXES).unionByName(full), large.distinct()


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *map(len, column)])
    yield from (flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()))


def candidate_lists(prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """(lid, members): the distinct lists of several nodes that share a prefix shingle, without those that can't be
    linked with any other node of the list if this is the first shingle that both have: then all that they share is
    among the ``rest`` of each. Linked nodes meet in the list of their first shingle in common, so none is lost."""
    lists = prefixes.groupBy("h").agg(F.collect_list(F.struct(*NODE, F.col("n").cast("long").alias("n"), F.col("rest").cast("long").alias("rest"))).alias("found")).where(F.size("found") > 1)
    near = f"{den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n) and {num + den} * least(x.rest, y.rest) >= {num} * (x.n + y.n)"
    kept = F.expr(f"filter(found, x -> exists(found, y -> {near} and (x.rep <> y.rep or x.d1 <> y.d1)))")
    lists = lists.select(kept.alias("kept")).where(F.size("kept") > 1)
    return lists.select(F.array_sort(F.expr("transform(kept, x -> struct(x.rep, x.d1))")).alias("members")).distinct().withColumn("lid", F.xxhash64("members"))


def _band(num: int, den: int) -> Column:
    """The size band of n: linked sets are in the same or in neighbouring ones."""
    return F.floor(F.log("n") / F.lit(max(1.0001 * math.log(den / num), 1e-6))).cast("long")


def _several(rows: DataFrame, key: str, *more: Column) -> DataFrame:
    """``rows`` of those keys that have several components, with ``more`` aggregates of each key."""
    keys = rows.groupBy(key).agg(F.min("comp").alias("x"), F.max("comp").alias("y"), *more).where("x <> y").drop("x", "y")
    return rows.join(keys, key)


def _known(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the component of each node among those found so far (node, component)."""
    known = found.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    return rows.drop("comp").join(known, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def _block_pairs(rows: DataFrame, links: DataFrame, num: int, den: int) -> DataFrame:
    """(lid, rep, d1, comp): lists in which every two members of a large group (cid, rep, d1, n) meet that are of
    different components and near in size. Within a size band's group the largest component is not met with itself."""
    band = _band(num, den)
    rows = _known(rows, components(links)).withColumn("band", F.explode(F.array(band, band + 1)))
    rows = _several(rows.withColumn("key", F.xxhash64("cid", "band")), "key")
    counts = rows.groupBy("key", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    main = counts.groupBy("key").agg(F.max(F.struct("rows", "comp")).alias("main"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"))
    of_main = counts.join(main.select("key", F.col("main.comp").alias("comp")), ["key", "comp"]).select("key", F.col("comp").alias("main"), F.col("rows").alias("m_rows"), F.col("shingles").alias("m_shingles"))
    parts = main.select("key", "rows", "shingles").join(of_main, "key").select("key", "main", _parts("rows - m_rows", "shingles - m_shingles").alias("minor"), _parts("m_rows", "m_shingles").alias("major"))
    rows = rows.join(parts, "key").withColumn("part", F.when(F.col("comp") == F.col("main"), F.col("minor") + F.pmod(F.xxhash64(*NODE), "major")).otherwise(F.pmod(F.xxhash64(*NODE), "minor")))
    # Parts below ``minor`` meet all parts, those above meet only them.
    last = F.when(F.col("part") < F.col("minor"), F.col("minor") + F.col("major") - 1).otherwise(F.col("minor") - 1)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last))).where("other <> part")
    return rows.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("lid"), *NODE, "comp")


def _parts(rows: str, shingles: str) -> Column:
    """Into how many parts (half a task's bounds each) a group is cut."""
    return F.expr(f"greatest(1L, cast(ceil(({rows}) / {GROUP_ROWS / 2}) as long), cast(ceil(({shingles}) / {GROUP_SHINGLES / 2}) as long))")


def _first_components(docs: DataFrame, nodes: DataFrame, small: DataFrame, large: DataFrame, k: int, num: int, den: int, work: Scratch) -> DataFrame:
    """(rep, d1, comp): nodes that have a link in their largest list (of a large one a block), and their components by
    such links."""
    sizes = large.groupBy("lid").agg(F.count("*").alias("size"))
    blocks = large.join(sizes, "lid").select(*NODE, "size", F.xxhash64("lid", F.pmod(F.xxhash64(*NODE), F.ceil(F.col("size") / BLOCK))).alias("lid"))
    best = small.select(*NODE, "size", "lid").unionByName(blocks).groupBy(*NODE).agg(F.max(F.struct("size", "lid")).alias("best"))
    lists = best.select(F.col("best.lid").alias("lid"), *NODE, F.xxhash64(*NODE).alias("comp"))
    near = near_members(lists, nodes, num, den)
    near = work.keep(near.select(*NODE, "grep", "gd1").distinct(), "first")
    lists = near.select(F.xxhash64("grep", "gd1").alias("lid"), *NODE)
    return work.keep(connected(lists, whole_sets(docs, near, k, work), num, den), "known")


def _other_links(docs: DataFrame, nodes: DataFrame, small: DataFrame, large: DataFrame, known: DataFrame, k: int, num: int, den: int, work: Scratch) -> DataFrame:
    """Links (a, b) that connect what the components of ``known`` (rep, d1, comp) don't."""

    def named(rows: DataFrame) -> DataFrame:
        return rows.join(known, NODE, "left").withColumn("comp", F.coalesce("comp", "rep"))

    found = near_members(_several(named(small), "lid"), nodes, num, den)
    found = found.select(*NODE, "comp", "n", F.xxhash64(*NODE).alias("a"), F.xxhash64("grep", "gd1").alias("b"))
    # The members of a long list are linked with the least of them, not with the list: most lists of near copies have
    # the same least one, so these links are mostly repeated ones, and go.
    hubs = _several(named(large).withColumn("a", F.xxhash64(*NODE)), "lid", F.min("a").alias("b")).select(*NODE, "comp", "n", "a", "b")
    near = work.keep(found.unionByName(hubs).distinct(), "near")
    cids = components(near.select("a", "b")).select(F.col("node").alias("a"), F.col("component").alias("cid"))
    rows = near.select(*NODE, "comp", "n", "a").distinct().join(cids, "a").select("cid", *NODE, "comp", "n")
    sizes = rows.groupBy("cid").agg(_parts("count(1) / 2", "sum(n) / 2").alias("parts"))
    rows = work.keep(rows.join(sizes, "cid"), "groups")
    band = F.when(F.col("parts") > 1, _band(num, den))
    part = F.pmod(F.xxhash64(*NODE), F.col("parts"))
    lists = rows.select(F.xxhash64("cid", band, part).alias("lid"), *NODE, "comp")
    more = work.keep(verify(lists, whole_sets(docs, rows, k, work), num, den), "links")
    wide = rows.where("parts > 1").select("cid", *NODE, "n")
    if wide.isEmpty():
        return more
    lists = work.keep(_block_pairs(wide, _stars(known).unionByName(more), num, den), "blocks")
    return more.unionByName(work.keep(verify(lists, whole_sets(docs, lists, k, work), num, den), "links"))


def _stars(known: DataFrame) -> DataFrame:
    return known.select(F.col("rep").alias("a"), F.col("comp").alias("b"))


def distinct_sets(heads: DataFrame, work: Scratch) -> DataFrame:
    """(n, d1, d2, rep, pre, sig): a node for each distinct set that is not empty. Only rows that a filter can't clear
    of having copies are shuffled."""
    some = heads.where("n > 0 and doc_id is not null")
    copied = work.keep(some.groupBy(*SET).agg(F.count("*").alias("count")).where("count > 1").select(*SET), "copied")
    flagged = key_filter(copied, *SET).flagged(some, SET, "copied")
    single = flagged.where("not copied").select(*SET, F.col("doc_id").alias("rep"), "pre", "sig")
    several = flagged.where("copied").groupBy(*SET).agg(F.min("doc_id").alias("rep"), F.first("pre").alias("pre"), F.first("sig").alias("sig"))
    return work.keep(single.unionByName(several), "nodes")


def _node_components(docs: DataFrame, named: DataFrame, nodes: DataFrame, k: int, num: int, den: int, work: Scratch) -> DataFrame:
    """(n, d1, d2, component) of every distinct set that is not empty."""
    some = named.where("n > 0 and doc_id is not null")
    prefixes, much = _prefixes(docs, nodes, k, num, den, work)
    flagged = key_filter(much, "h").flagged(prefixes, ["h"], "much")
    flagged = work.keep(flagged, "prefixes")
    lists = work.keep(candidate_lists(flagged.where("not much"), num, den), "lists")
    small = lists.select("lid", F.size("members").cast("long").alias("size"), F.inline("members"))
    band = _band(num, den)
    large = flagged.where("much").withColumn("band", F.explode(F.array(band, band + 1)))
    large = work.keep(large.select(F.xxhash64("h", "band").alias("lid"), *NODE, "n"), "large")
    work.drop(flagged)
    known = _first_components(docs, nodes, small, large, k, num, den, work)
    links = _stars(known).unionByName(_other_links(docs, nodes, small, large, known, k, num, den, work))
    # Rows that share a doc_id are one document: the other doc_ids that their sets go by are linked with it.
    several = some.groupBy("doc_id").agg(F.min(F.struct("n", "d1", "d2")).alias("x"), F.max(F.struct("n", "d1", "d2")).alias("y")).where("x <> y").select("doc_id")
    same = some.select("doc_id", "n", "d1", "d2").join(several, "doc_id", "left_semi").distinct().join(nodes.select("n", "d1", "d2", "rep"), ["n", "d1", "d2"])
    links = links.unionByName(same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    return work.keep(_known(nodes.select("n", "d1", "d2", "rep"), components(links)).select("n", "d1", "d2", F.col("comp").alias("component")), "components")


def join(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs`` (doc_id, text)."""
    work = Scratch(docs.sparkSession, "jaccard")
    heads = work.keep(shingle_heads(docs, k, num, den), "heads")
    named = work.keep(heads.select("doc_id", *SET), "named")
    nodes = distinct_sets(heads, work)
    work.drop(heads)
    found = _node_components(docs, named, nodes, k, num, den, work)
    empty = named.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component"))
    # Both sides are written tables, so Spark can split the key of a large group of copies.
    rest = named.where("n > 0").join(found, ["n", "d1", "d2"], "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    work.drop_others(named, found)
    return rest.unionByName(empty).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id. Of rows that share that doc_id
    the least by text stays. Rows without a doc_id stay."""
    named = materialise(join(docs.select("doc_id", "text"), k, num, den), "named")
    gone = named.where("component_id <> doc_id").select("doc_id").distinct().select(F.col("doc_id").alias("id"), F.lit(True).alias("gone"))
    again = named.where("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("count")).where("count > 1").select(F.col("doc_id").alias("id"), F.lit(False).alias("gone"))
    touched = materialise(gone.unionByName(again), "touched")
    # Only rows that a filter can't clear of being a copy or repeated are shuffled. The row is one struct, so that no
    # column of it can clash with ours.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("words"), F.struct("*").alias("row"))
    flagged = key_filter(touched, "id").flagged(rows, ["id"], "met")
    asked = flagged.where("met").join(touched, "id", "left").where("gone is null or not gone")
    few = asked.where("gone is not null").groupBy("id").agg(F.min_by("row", F.struct("words", F.to_json("row"))).alias("row"))
    kept = flagged.where("not met").select("row").unionByName(asked.where("gone is null").select("row")).unionByName(few.select("row"))
    return kept.select("row.*")

#: DuckDB: the links by brute force over shared shingles, and their closure (k = 4, threshold 85 / 100).
JOIN_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM words),
rows AS (SELECT doc_id, unnest(g) AS h FROM sets),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM rows x JOIN rows y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * c >= 85 * (len(x.g) + len(y.g) - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS node, doc_id AS c FROM sets UNION SELECT l.b, r.c FROM reached r JOIN both_ways l ON l.a = r.node),
least AS (SELECT node, min(c) AS component_id FROM reached GROUP BY node)
SELECT doc_id, len(g) AS n_shingles, component_id FROM sets JOIN least ON node = doc_id
"""
