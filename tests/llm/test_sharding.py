import bisect
import heapq
import math
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from tessera.llm import sharding

SMALLEST, LARGEST = -(1 << 63), (1 << 63) - 1


def hashed(*values):
    """XXH64 of longs and texts, each seeded by the hash before; a one-element tuple is a 32-bit integer, nulls change nothing."""
    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else (v % (1 << 64)).to_bytes(8, "little") if isinstance(v, int) else v[0].to_bytes(4, "little")
            h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


def plain(rows, shards, ranges, samples):
    """The rows of assign_shards, by lists and loops."""
    docs = [(d, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode()), hashed(t)) for d, t in rows]
    mean = max(1, sum(size for _, size, _, _ in docs) / (shards * ranges))

    draw = lambda d, key: (hashed(d, key, (1,)) % (1 << 52) + 0.5) / (1 << 52)
    drawn = sorted((-math.log(draw(d, key)) / size, key) for d, size, _, key in docs)[: shards * ranges * samples]
    keys = sorted(key for _, key in drawn)
    quantiles = Counter(keys[len(keys) * i // (shards * ranges)] for i in range(1, shards * ranges)) if keys else Counter()
    splits = sorted({*quantiles, *(k + 1 for k, n in quantiles.items() if n > 1 and k < LARGEST)})
    bounds = list(zip([SMALLEST, *splits], [*splits, LARGEST]))

    members = defaultdict(list)
    for doc in docs:
        members[bisect.bisect_right(splits, doc[3])].append(doc)
    units = []
    for k, (lo, hi) in enumerate(bounds):
        held, single = sum(size for _, size, _, _ in members[k]), hi - lo <= 1
        whole = held * shards <= sum(size for _, size, _, _ in docs) if single else held <= sharding.OVERFULL * mean
        n = 1 if whole else math.ceil(held / mean)
        cut = [[] for _ in range(n)]
        for doc in members[k]:
            along = math.floor((float(doc[3]) - float(lo)) / (float(hi) - float(lo)) * n) if n > 1 and not single else 0
            cut[hashed(doc[0], (2,)) % n if n > 1 and single else min(max(along, 0), n - 1)].append(doc)
        units += cut

    load, shard_of = [(0, s) for s in range(shards)], {}
    weight = lambda u: sum(size for _, size, _, _ in units[u])
    for u in sorted((u for u in range(len(units)) if units[u]), key=lambda u: (-weight(u), u)):
        held, s = heapq.heappop(load)
        shard_of[u] = s
        heapq.heappush(load, (held + weight(u), s))

    group, slots, out = max(1, min(sharding.SLOT_ROWS, math.ceil(len(docs) / len(units)))), Counter(), []
    for u in sorted(shard_of):
        subs = math.ceil(len(units[u]) / group)
        first = lambda x: (x is not None, x or 0)
        for d, size, crc, key in sorted(units[u], key=lambda x: (hashed(x[0], x[3], (3,)) % subs, x[3], first(x[0]))):
            out.append((d, size, crc, sharding.LAW, shard_of[u], slots[shard_of[u]], None))
            slots[shard_of[u]] += 1
    return out


def check(rows, got, shards):
    want = Counter((d, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for d, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


@pytest.mark.parametrize("shards, ranges, samples", [(8, 64, 8), (4, 4, 2), (3, 1, 1)])
def test_against_plain_version(make_docs, words, shards, ranges, samples):
    odd = [(None, "ü"), (1, None), (1, None), (None, None), (2, ""), (9000, words(3000, 3)), (-5, "a")]
    spread = [(i, words(20 + i % 90, i % 700)) for i in range(900)]
    copies = [(5000 + i, words(100, 77)) for i in range(300)]  # a third of all bytes and more
    for rows in (spread + odd, spread + odd + copies, copies, odd, []):
        got = sharding.assign_shards(make_docs(rows), shards, ranges=ranges, samples=samples).collect()
        assert Counter(map(tuple, got)) == Counter(plain(rows, shards, ranges, samples))


def test_sizes_near_equal_and_copies_together(make_docs, words):
    rows = [(i, words(20 + i % 90, i % 1500)) for i in range(2500)] + [(5000 + i, words(100, 77)) for i in range(60)] + [(9000, words(3000, 3)), (None, "ü"), (1, None), (1, None), (2, "")]
    got = sharding.assign_shards(make_docs(rows)).collect()
    check(rows, got, 8)
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    assert max(load.values()) < 1.03 * min(load.values())
    where = defaultdict(set)
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id, r["size"], r.text_crc32].add(r.shard)
        where[r["size"], r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_text_too_big_for_a_shard_is_spread(make_docs, words):
    rows = [(i, "same text again") for i in range(2000)] + [(5000 + i, words(5, i)) for i in range(100)]
    got = sharding.assign_shards(make_docs(rows), shards=4).collect()
    check(rows, got, 4)
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    assert max(load.values()) < 1.1 * min(load.values())


def test_repeats_ties_and_empty(make_docs):
    assert sharding.assign_shards(make_docs([])).collect() == []
    rows = [(1, "a")] * 7 + [(None, None)] * 3
    check(rows, sharding.assign_shards(make_docs(rows)).collect(), 8)


def test_no_python_in_the_plan(make_docs, words):
    plan = sharding.assign_shards(make_docs([(i, words(9, i)) for i in range(50)]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
