"""SimHash fingerprints, and near duplicates among them by bit-sliced comparison.

Fingerprints of 64 bits that are at most ``radius`` bits apart share at least
two of ``radius + 2`` bit blocks, so all links are found among
fingerprints that agree on one of the pairs of blocks (for 4 bits: 15 pairs of 6
blocks).  Longer fingerprints, whose radius is too wide for that, are compared if
they agree on one of ``BANDS`` fixed choices of ``BAND_BITS`` bits.  Equal
fingerprints count once.

What agrees lies side by side in a sorted run whose bits are stored as vertical
planes; shifting the planes by ``s`` compares every fingerprint of the run with its
``s``-th successor at once, in bit-sliced counters that a carry-save chain of AND
and XOR updates plane by plane.  Words of 64 comparisons that all exceed the radius
are abandoned at once.  Choices on which more than ``HOT`` fingerprints agree are cut
into tiles by hash, and each pair of tiles is a run of its own, so no task gets an
unbounded group; a run reports a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, fresh, written
from .shingles import SEED, distinct_hashes, shingle_hashes, texts_of

WORD = 64
#: Choices of bits for longer fingerprints.  A pair of which a part p of all bits differs
#: is missed with probability (1 - (1 - p) ** BAND_BITS) ** BANDS: 0.0008 at a similarity of 0.8, 5e-8 at 0.9.
BANDS, BAND_BITS = 96, 16
#: Standard deviations of the estimate by which a pair at the threshold may differ more and still be a candidate.
DEVIATIONS = 3
#: Rows that share a combination before it is cut into tiles of half as many.
HOT = 1024
#: Rows of whole runs that are compared at once.
CHUNK = 1 << 16
#: Members of sets that a tile holds, about, where it is filled sooner by them than by rows.
TILE_MEMBERS = 1 << 20
#: In runs of so many candidates, so many first nodes are compared with all others before the rest.
MANY, HUBS = 64, 4
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _more_bits(h: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th further word of each hash: multiply and shift, as a mixer of 64-bit integers does."""
    x = h + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(data: memoryview | bytes, words: int = 4, bits: int = 64, distinct: bool = False) -> np.ndarray:
    """The words of the fingerprint of one text in UTF-8; see :func:`fingerprints`."""
    parts = shingle_hashes(data, words)
    return _votes([distinct_hashes(parts)] if distinct else parts, bits)


def _votes(parts: Iterable[np.ndarray], bits: int) -> np.ndarray:
    counts, n = np.zeros(bits, np.int64), 0
    for h in parts:
        n += len(h)
        for lo in range(0, len(h), 1 << 15):
            part = h[lo : lo + (1 << 15)]
            wide = np.stack([part, *(_more_bits(part, k) for k in range(1, bits // WORD))], axis=1)
            votes = np.unpackbits(wide.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
            counts += votes.sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)


def _columns(bits: int) -> list[str]:
    return [f"fp{k}" for k in range(bits // WORD)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 64, distinct: bool = False) -> DataFrame:
    """``(doc_id, fp0, ...)``: the fingerprint's 64-bit words as signed longs.

    A-Z are lower-cased, words are runs of anything but ASCII white space, and
    each shingle of ``words`` words votes with its XXH64 (seed 42), and with numbers
    mixed from it where ``bits`` is a larger multiple of 64; repeated shingles vote
    each, or once if ``distinct``.  Fewer words make one shingle.  A bit is set if over
    half the votes have it.  Null, empty and blank texts get 0.  Whole texts are read.
    """
    names = _columns(bits)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words, bits, distinct) for t in texts_of(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), *_word_columns(fps, names)], names=["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def _word_columns(fps: np.ndarray, names: list[str]) -> list[pa.Array]:
    fps = fps.reshape(-1, len(names)).view(np.int64)
    return [pa.array(np.ascontiguousarray(fps[:, k])) for k in range(len(names))]


def radius_of(similarity: float, bits: int, deviations: float = 1) -> int:
    """Bits that may differ for sets of shingles of that Jaccard similarity, as SimHash estimates it.

    Sets of about equal size and Jaccard similarity s have cosine 2s / (1 + s), and a
    bit differs with the angle's share of a half turn.  ``deviations`` standard deviations
    are added: one finds five sixths of the pairs at the very threshold, three 99.9 %.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def block_masks(radius: int) -> list[int]:
    """Bit masks such that any two words at most ``radius`` bits apart agree on one of them."""
    blocks = radius + 2
    cuts = [round(i * WORD / blocks) for i in range(blocks + 1)]
    spans = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(spans, 2)]


def _choices(bits: int, radius: int) -> list[tuple[int, ...]]:
    """Masks, a number for each word of the fingerprint."""
    if bits == WORD:
        return [(m,) for m in block_masks(radius)]
    r, out = random.Random(SEED), []
    for _ in range(BANDS):
        mask = sum(1 << k for k in r.sample(range(bits), BAND_BITS))
        out.append(tuple(mask >> WORD * k & (1 << WORD) - 1 for k in range(bits // WORD)))
    return out


def _planes(fps: np.ndarray) -> np.ndarray:
    """A row a bit; bit ``i`` of row ``j``'s words is bit ``j`` of fingerprint ``i``.  Two spare words follow."""
    words = len(fps) // 64 + 3
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    out = np.zeros((bits.shape[1], words * 8), np.uint8)
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def close_at(planes: np.ndarray, wanted: np.ndarray, shift: int, radius: int) -> np.ndarray:
    """Positions ``i`` set in ``wanted`` whose fingerprint is within ``radius`` bits of that at ``i + shift``."""
    n = len(wanted)
    mask = np.zeros((planes.shape[1] - 2) * 8, np.uint8)
    packed = np.packbits(wanted, bitorder="little")
    mask[: len(packed)] = packed
    mask = mask.view(np.uint64)
    live = np.flatnonzero(mask)
    width = int(radius + 1).bit_length()
    preset = (1 << width) - (radius + 1)  # the counters overflow at radius + 1
    counters = [np.full(len(live), _FULL if preset >> k & 1 else np.uint64(0)) for k in range(width)]
    over = ~mask[live]
    q, r = divmod(shift, 64)
    lo, hi = np.uint64(r), np.uint64(64 - r)
    for j in range(0, len(planes), 8):
        if not len(live):
            return np.empty(0, np.int64)
        group = planes[j : j + 8]
        later = group[:, np.minimum(live + q, planes.shape[1] - 1)]
        if r:
            later = (later >> lo) | (group[:, np.minimum(live + q + 1, planes.shape[1] - 1)] << hi)
        differs = group[:, live] ^ later
        for carry in differs:
            for k in range(width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
        keep = over != _FULL
        if not keep.all():
            live, over, counters = live[keep], over[keep], [c[keep] for c in counters]
    good = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(good.reshape(len(live), 64))
    at = live[row] * 64 + bit
    return at[at < n]


def _join(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the sets of ``i`` and ``j``; ``labels`` points to each set's first member."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            next_ = labels[labels]
            if (next_ == labels).all():
                break
            labels = next_


def linked(fps: np.ndarray, nodes: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest, as pairs of nodes, of the links inside each run.  ``run``: the run of each fingerprint, ascending."""
    n = len(fps)
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[starts, n])
    alone = np.repeat(sizes == 1, sizes)
    fps, nodes = fps[~alone], nodes[~alone]
    n, sizes = len(fps), sizes[sizes > 1]
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    end = np.repeat(np.cumsum(sizes), sizes)
    at, labels, planes = np.arange(n), np.arange(n), _planes(fps)
    for shift in range(1, int(sizes.max())):
        i = close_at(planes, at + shift < end, shift, radius)
        if len(i):
            labels = _join(labels, i, i + shift)
    child = np.flatnonzero(labels != at)
    return nodes[child], nodes[labels[child]]


def _linked(keys: np.ndarray, run: np.ndarray, cols: list[np.ndarray], radius: int):
    a, b = linked(np.stack(cols[1:], axis=1).view(np.uint64), cols[0], run, radius)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _compare(radius: int, each):
    """``each`` over whole runs; the first column tells runs apart."""

    def whole(cols):
        keys = cols[0]
        run = np.cumsum(np.r_[0, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        return each(keys, run, cols[1:], radius)

    def run(batches):
        held = None
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in batch.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if len(held[0]) >= CHUNK:
                cut = int(np.flatnonzero(held[0] != held[0][-1]).max(initial=-1)) + 1  # the last run may go on
                if cut:
                    yield from whole([h[:cut] for h in held])
                    held = [h[cut:] for h in held]
        if held is not None:
            yield from whole(held)

    return run


def _runs(distinct: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """``(run, node, fp0, ...)``, a run after the other: what agrees on a choice, or two tiles of it.

    ``run`` is a hash of the choice and what it takes (and the tiles); should two be
    equal, more is compared, and nothing else.  The other frame is to be discarded afterwards.
    """
    rest = [c for c in distinct.columns if c != "node"]
    names = [c for c in rest if c.startswith("fp")]
    signed = lambda m: m - (1 << WORD) if m >> WORD - 1 else m
    keys = []
    for k, choice in enumerate(_choices(WORD * len(names), radius)):
        masked = [F.col(n).bitwiseAND(F.lit(signed(m)).cast("long")) for n, m in zip(names, choice) if m]
        keys.append(F.xxhash64(F.lit(k), *masked))
    keyed = distinct.select(F.explode(F.array(*keys)).alias("run"), "node", *rest)
    hot = written(keyed.groupBy("run").agg(F.count("*").alias("n")).filter(F.col("n") > HOT), "hot")
    cold = keyed.join(hot, "run", "left_anti").select("run", "node", *rest)
    tiles = F.ceil(F.col("n") * 2 / HOT).cast("int")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    tiled = keyed.join(hot, "run").select("run", "node", *rest, tiles.alias("tiles"), own.alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    pairs = tiled.select("run", "node", *rest, "own", other)
    pairs = pairs.select(F.xxhash64("run", F.least("own", "other"), F.greatest("own", "other")).alias("run"), "node", *rest)
    return cold.union(pairs).repartition("run").sortWithinPartitions("run", "node"), hot


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Links ``(a, b)`` of nodes that connect what chains of fingerprints within ``radius`` bits connect.

    ``distinct(node, fp0, ...)`` holds each fingerprint once.
    """
    return _runs(distinct, radius)[0].mapInArrow(_compare(radius, _linked), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, bits: int = 64, distinct: bool = False) -> DataFrame:
    """``(doc_id, fp0, ..., component_id)`` for each row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` that chains of links reach, the
    row's own included.  Fingerprints at most ``radius`` bits apart link, 0
    included; of 64 bits all links are found, of more those of :data:`BANDS`.
    Repeated rows get a row each.  Rows whose id is null get one too; their
    ``component_id`` is null if no row with an id is reached.  An empty table gives
    an empty result; other columns are not looked at.
    """
    names = _columns(bits)
    prints = written(fingerprints(docs, id_col, text_col, words, bits, distinct), "fingerprints")
    node = F.col("fp0") if bits == WORD else F.xxhash64(*names)
    classes = written(prints.groupBy(*names).agg(F.min("doc_id").alias("least")).withColumn("node", node), "classes")
    runs, hot = _runs(classes.select("node", *names), radius)
    roots = components(runs.mapInArrow(_compare(radius, _linked), "a long, b long"))
    rooted = classes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "rooted")
    least = rooted.groupBy(F.col("root").alias("top")).agg(F.min("least").alias("component_id"))
    named = rooted.join(least, F.col("root") == F.col("top")).select(F.col("node").alias("own"), "component_id")
    named = written(named, "named")
    discard(hot, classes, roots, rooted)
    return prints.withColumn("node", node).join(named, F.col("node") == F.col("own")).select("doc_id", *names, "component_id")


def _shingle_sets(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """``(doc_id, hash, node, size, fp0, ...)`` of ``(doc_id, hash, text)``.

    ``node`` stands for the set of shingles, ``size`` is its size.
    """
    names = _columns(bits)

    def run(batches):
        for b in batches:
            nodes, sizes, fps = [], [], []
            for t in texts_of(b.column(2)):
                h = distinct_hashes(shingle_hashes(t, words))
                nodes.append(_node(h))
                sizes.append(len(h))
                fps.append(_votes([h], bits))
            own = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64())]
            columns = [b.column(0), b.column(1), *own, *_word_columns(np.array(fps, np.uint64), names)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "hash", "node", "size", *names])

    kind = "doc_id long, hash long, node long, size long, " + ", ".join(f"{n} long" for n in names)
    return docs.mapInArrow(run, kind)


def _node(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64))


def _hook(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Merge the sets of ``i`` and ``j``; of these pairs, those that did it."""
    used = []
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels, used
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        high, first = np.unique(np.maximum(a, b), return_index=True)
        used.append((i[first], j[first]))
        labels[high] = np.minimum(a, b)[first]
        while True:
            next_ = labels[labels]
            if (next_ == labels).all():
                break
            labels = next_


def _candidates(similarity: float):
    """Pairs within the radius whose sizes allow ``similarity``, of a spanning forest of each run.

    Columns after the run's: node, size, fingerprint.
    """

    def each(keys, run, cols, radius):
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        sizes = np.diff(np.r_[starts, len(run)])
        alone = np.repeat(sizes == 1, sizes)
        keys, cols, sizes = keys[~alone], [c[~alone] for c in cols], sizes[sizes > 1]
        n = len(keys)
        if not n:
            return
        nodes, held = cols[0], cols[1]
        fps = np.stack(cols[2:], axis=1).view(np.uint64)
        end = np.repeat(np.cumsum(sizes), sizes)
        at, labels, planes, used = np.arange(n), np.arange(n), _planes(fps), []
        possible = lambda i, j: np.minimum(held[i], held[j]) >= similarity * np.maximum(held[i], held[j]) - 1e-6
        # runs of many near copies: their first nodes are the hubs in each run, so that few different pairs come out
        for lo, size in zip(np.cumsum(sizes) - sizes, sizes):
            for hub in range(lo, lo + HUBS) if size >= MANY else ():
                j = np.arange(hub + 1, lo + size)
                j = j[(np.bitwise_count(fps[j] ^ fps[hub]).sum(1) <= radius) & possible(j, hub)]
                labels, more = _hook(labels, np.full(len(j), hub), j)
                used += more
        for shift in range(1, int(sizes.max())):
            i = close_at(planes, at + shift < end, shift, radius)
            i = i[possible(i, i + shift)]
            if len(i):
                labels, more = _hook(labels, i, i + shift)
                used += more
        if used:
            i, j = (np.concatenate(x) for x in zip(*used))
            x, y = nodes[i], nodes[j]
            found = (keys[i], nodes[labels[i]], np.minimum(x, y), np.maximum(x, y))
            yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["run", "first", "a", "b"])

    return each


def _sets(nodes: DataFrame, texts: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """``(node, members)``: the set of shingles of each of ``nodes``, from its class's row of ``texts(doc_id, hash, text)``."""

    def run(batches):
        for b in batches:
            found = [distinct_hashes(shingle_hashes(t, words)) for t in texts_of(b.column(0))]
            made = [pa.array([_node(h) for h in found], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["node", "members"])

    rows = classes.join(nodes, "node").select(F.col("row.doc_id").alias("of_id"), F.col("row.hash").alias("of_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash"))
    found = texts.join(rows.distinct(), same).select("text").mapInArrow(run, "node long, members binary")
    return found.dropDuplicates(["node"])


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(a, b, good)``: whether the exact Jaccard similarity of the sets of nodes ``a`` and ``b`` reaches ``similarity``."""

    def check(batches):
        for b in batches:
            good = []
            for p, q in zip(b.column(2), b.column(3)):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(good, pa.bool_())], names=["a", "b", "good"])

    side = lambda n, m: sets.select(F.col("node").alias(n), F.col("members").alias(m))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(check, "a long, b long, good boolean")


def _tile_links(slices: list[pa.RecordBatch], similarity: float, radius: int) -> pa.RecordBatch:
    """Links between unlike labels inside a tile, or between two tiles: one for each pair of labels that it joins.

    Columns: run, own, label, node, size, members, fingerprint.
    """
    whole = lambda k: np.concatenate([s.column(k).to_numpy(zero_copy_only=False) for s in slices])
    own, node, size = whole(1), whole(3), whole(4)
    of = np.unique(whole(2), return_inverse=True)[1]
    fps = np.stack([whole(k) for k in range(6, slices[0].num_columns)], axis=1).view(np.uint64)
    sets = [np.frombuffer(v.as_buffer(), np.uint64) for s in slices for v in s.column(5)]
    member = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.r_[0, np.cumsum(size)]
    top, marked = np.arange(of.max() + 1), np.zeros(member.max(initial=-1) + 1, bool)
    one = (own == own[0]).all()
    found = []
    for x in range(len(node)):
        y = np.arange(x + 1, len(node))
        y = y[(one | (own[y] != own[x])) & (top[of[y]] != top[of[x]])]
        y = y[(np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-6) & (size[y] > 0)]
        y = y[np.bitwise_count(fps[y] ^ fps[x]).sum(1) <= radius]
        if not len(y):
            continue
        mine = member[starts[x] : starts[x + 1]]
        marked[mine] = True
        # the members of all candidates one after the other, and how many of them are of x, for each
        begins = np.cumsum(size[y]) - size[y]
        theirs = member[np.arange(size[y].sum()) + np.repeat(starts[y] - begins, size[y])]
        both = np.add.reduceat(marked[theirs], begins, dtype=np.int64)
        marked[mine] = False
        y = y[both >= similarity * (size[x] + size[y] - both) - 1e-9]
        for t, first in zip(*np.unique(top[of[y]], return_index=True)):
            found.append((node[x], node[y[first]]))
            top[top == t] = top[of[x]]
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _tiles(similarity: float, radius: int):
    """:func:`_tile_links` of each run, whose rows lie together; one run at a time is held."""

    def run(batches):
        held, open_run = [], None
        for b in batches:
            keys = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else ()
            for lo, hi in zip(cuts, [*cuts[1:], len(keys)]):
                if held and keys[lo] != open_run:
                    yield _tile_links(held, similarity, radius)
                    held = []
                held.append(b.slice(lo, hi - lo))
                open_run = keys[lo]
        if held:
            yield _tile_links(held, similarity, radius)

    return run


def _rest(members: DataFrame, sets: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Links ``(a, b)`` between nodes of one group and unlike labels that reach ``similarity``.

    ``members(group, label, node, size, fp0, ...)``.  A group is cut into tiles by hash, by
    its nodes and by the size of their sets, and each pair of tiles is a run of its own.
    """
    names = [c for c in members.columns if c.startswith("fp")]
    sums = members.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("held"), F.countDistinct("label").alias("labels"))
    tiles = F.greatest(F.ceil(F.col("n") * 2 / HOT), F.ceil(F.col("held") / TILE_MEMBERS)).cast("int")
    wanted = sums.filter("labels > 1").select("group", tiles.alias("tiles"))
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("own")
    tiled = members.join(wanted, "group").select("group", "label", "node", "size", *names, own, "tiles")
    paired = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    run = F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("run")
    paired = paired.select(run, "own", "label", "node", "size", *names)
    full = paired.join(sets, "node").select("run", "own", "label", "node", "size", "members", *names)
    return full.repartition("run").sortWithinPartitions("run", "node").mapInArrow(_tiles(similarity, radius), "a long, b long")


def similar(classes: DataFrame, texts: DataFrame, words: int, similarity: float, radius: int) -> DataFrame:
    """``(node, root)``, as :func:`components` gives, of the candidates whose exact similarity is ``similarity`` or more.

    ``classes(node, size, row, fp0, ...)`` holds each set once.  A spanning forest of each run's
    candidates is checked first.  Where all of a tree's pairs pass, the rest of its pairs can't connect
    more.  The trees with a pair that fails are put together where they share nodes, and all candidates
    of such a group that are still apart are checked, tile by tile.
    """
    names = [c for c in classes.columns if c.startswith("fp")]
    runs, hot = _runs(classes.select("node", "size", *names), radius)
    forest = runs.mapInArrow(_compare(radius, _candidates(similarity)), "run long, first long, a long, b long")
    forest = written(forest.select(F.xxhash64("run", "first").alias("tree"), "a", "b"), "forest")
    pairs = written(forest.select("a", "b").distinct(), "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = written(_sets(nodes, texts, classes, words), "sets")
    once = written(_checked(pairs, sets, similarity), "checked")
    good = once.filter("good").select("a", "b")
    roots = written(components(good), "labels")
    bad = forest.join(once.filter("NOT good"), ["a", "b"]).select("tree").distinct()
    torn = written(forest.join(bad, "tree").select("a", "b").distinct(), "torn")
    groups = written(components(torn).select("node", F.col("root").alias("group")), "groups")
    members = torn.select(F.col("a").alias("node")).union(torn.select("b")).distinct()
    members = members.join(groups, "node", "left").join(roots, "node", "left").join(classes.select("node", "size", *names), "node")
    members = members.select(F.coalesce("group", "node").alias("group"), F.coalesce("root", "node").alias("label"), "node", "size", *names)
    members = written(members, "members")
    out = components(good.union(_rest(members, sets, similarity, radius)))
    discard(hot, forest, pairs, sets, once, roots, torn, groups, members)
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bits: int = 256) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id.

    Documents link at a Jaccard similarity of ``similarity`` or more of their sets of
    ``words``-word shingles.  Fingerprints of ``bits`` bits give the candidates, and the sets
    themselves decide.  Rows that repeat an id and its text count as one document, of which one
    row stays; unlike texts under one id are documents of their own.  Rows without an id can't
    be named and all stay.
    """
    names = _columns(bits)
    hash_ = F.xxhash64(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), hash_.alias("hash"), F.col(text_col).alias("text"))
    prints = written(_shingle_sets(texts, words, bits), "fingerprints")
    named = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "hash"))).alias("least")
    of_set = prints.groupBy("node", "size", *names).agg(named, F.min(F.struct("doc_id", "hash")).alias("row"))
    classes = written(of_set, "classes")
    roots = similar(classes, texts, words, similarity, radius_of(similarity, bits, DEVIATIONS))
    rooted = classes.join(roots, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).filter(F.col("least").isNotNull())
    kept_id, kept_hash = fresh(docs, "kept_id", "kept_hash")
    kept = written(kept.select(F.col("least.doc_id").alias(kept_id), F.col("least.hash").alias(kept_hash)), "kept")
    discard(prints, classes, roots)
    same = (docs[id_col].cast("long") == kept[kept_id]) & (F.xxhash64(docs[text_col]) == kept[kept_hash])
    # the join's own columns, so that what it has put together needn't move again
    found = docs.join(kept, same).dropDuplicates([kept_id, kept_hash]).drop(kept_id, kept_hash)
    return found.unionByName(docs.filter(F.col(id_col).isNull()))
