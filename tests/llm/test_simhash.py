import random
import re

import numpy as np
import xxhash

from tessera.llm import simhash
from tessera.llm.components import components


def plain(text, words=4, bits=64, distinct=False):
    """The fingerprint as one number."""
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    s = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in (sorted(set(s)) if distinct else s)]
    h = [sum(mixed(x, k) << 64 * k for k in range(bits // 64)) for x in h]
    return sum(1 << b for b in range(bits) if sum(x >> b & 1 for x in h) * 2 > len(h))


def mixed(x, k):
    if not k:
        return x
    m = (1 << 64) - 1
    x = x + 0x9E3779B97F4A7C15 * k & m
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return x ^ x >> 31


def number(words):
    return sum(int(w) << 64 * k for k, w in enumerate(words))


def groups(ids_fps, radius=4):
    root = {f: f for _, f in ids_fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = list(root)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if bin(a ^ b).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for d, f in ids_fps:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return sorted(((d, f, least.get(find(f))) for d, f in ids_fps), key=str)


def test_fingerprint_matches_plain_version(words):
    for t in [None, "", "  \n\t", "One", "one two three", "A b\x0bC d e f É é", words(50, 1), words(40_000, 2)]:
        assert number(simhash.fingerprint((t or '').encode())) == plain(t)
        if t is None or len(t) < 1000:
            assert number(simhash.fingerprint((t or '').encode(), 5, 256, True)) == plain(t, 5, 256, True)


def test_seed_is_sparks(spark):
    assert spark.sql("select xxhash64('ab cd')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"ab cd", 42)


def test_block_masks_meet_every_pair():
    r = random.Random(3)
    for radius in (0, 1, 4, 6):
        masks = simhash.block_masks(radius)
        for _ in range(300):
            a = r.getrandbits(64)
            b = a
            for k in r.sample(range(64), radius):
                b ^= 1 << k
            assert any(a & m == b & m for m in masks)


def test_bit_sliced_comparison():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 40, np.uint64)
    fps = base[r.integers(0, 40, 700)]
    for _ in range(3):
        fps = fps ^ (np.uint64(1) << r.integers(0, 64, 700, np.uint64))
    planes = simhash._planes(fps.reshape(-1, 1))
    for radius in (0, 3, 4, 7):
        for shift in (1, 5, 63, 64, 65, 130, 699):
            got = simhash.close_at(planes, np.arange(700) + shift < 700, shift, radius)
            want = [i for i in range(700 - shift) if bin(int(fps[i] ^ fps[i + shift])).count("1") <= radius]
            assert got.tolist() == want


def test_hot_combinations_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 16)
    r = random.Random(5)
    fps = {(0xABCD << 40) ^ sum(1 << r.randrange(30) for _ in range(4)) for _ in range(300)}
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(f, f) for f in fps], "node long, fp0 long"))).collect()}
    want = groups([(f, f) for f in fps])
    assert {(f, got.get(f, f)) for f in fps} == {(f, c) for f, _, c in want}


def test_near_duplicates(spark, make_docs, words):
    long = words(600, 9)
    edited = long.split()
    edited[100] = "changed"
    rows = [(5, long), (3, " ".join(edited)), (9, long), (9, long), (None, long), (8, words(300, 10)), (1, None), (2, ""), (4, " \n"), (7, "one"), (6, "ONE"), (None, "alone in the world")]
    docs = make_docs(rows)
    got = sorted(((r.doc_id, r.fp0 % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == groups([(d, plain(t)) for d, t in rows])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    named = [d for d, _, c in groups([(d, plain(t, 5, 256, True)) for d, t in rows], 44) if d is not None and d == c]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*set(named), None, None], key=str)


def test_empty_table(spark, make_docs):
    docs = make_docs([])
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.drop_near_duplicates(docs).collect() == []


def test_components_of_chains_and_hubs(spark):
    r = random.Random(2)
    order = r.sample(range(-500, 500), 300)
    links = [*zip(order, order[1:]), *((1000, 2000 + k) for k in range(200)), (7000, 7000), (None, 3), (9001, 9000), (9001, 9000)]
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {n: min(order) for n in order if n != min(order)} | {2000 + k: 1000 for k in range(200)} | {9001: 9000}
    assert got == want


def test_similar_documents_are_found(spark, make_docs, words):
    """Copies with every 60th word changed (similarity 0.85) link; those with every 12th (0.4) and others don't."""
    rows = []
    for i in range(60):
        base = words(360, i).split()
        for k, step in enumerate((0, 60, 12)):
            rows.append((10 * i + k, " ".join(f"x{i}{k}{n}" if step and n % step == step // 2 else w for n, w in enumerate(base))))
    kept = {r.doc_id for r in simhash.drop_near_duplicates(make_docs(rows)).collect()}
    assert kept >= {10 * i for i in range(60)} | {10 * i + 2 for i in range(60)}
    assert len(kept) <= 120 + 2
    assert simhash.radius_of(0.8, 256) == 44


def test_bit_sliced_comparison_of_long_fingerprints():
    r = np.random.default_rng(2)
    fps = r.integers(0, 1 << 63, (200, 4), np.uint64)
    fps[100:] = fps[:100] ^ (r.integers(0, 1 << 63, (100, 4), np.uint64) & r.integers(0, 1 << 63, (100, 4), np.uint64) & r.integers(0, 1 << 63, (100, 4), np.uint64))
    got = simhash.close_at(simhash._planes(fps), np.arange(200) < 100, 100, 30).tolist()
    assert 0 < len(got) < 100 and got == [i for i in range(100) if bin(number(fps[i]) ^ number(fps[i + 100])).count("1") <= 30]


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_only_exact_similarity_links(spark, make_docs, words):
    """Copies with every 40th word changed (similarity 0.78) are often within the radius, but all stay."""
    rows, near = [], 0
    for i in range(60):
        base = words(360, 100 + i).split()
        text = " ".join(f"x{i}{n}" if n % 40 == 20 else w for n, w in enumerate(base))
        assert 0.7 < jaccard(" ".join(base), text) < 0.8
        near += bin(plain(" ".join(base), 5, 256, True) ^ plain(text, 5, 256, True)).count("1") <= 44
        rows += [(2 * i, " ".join(base)), (2 * i + 1, text)]
    assert near >= 10
    assert simhash.drop_near_duplicates(make_docs(rows)).count() == 120


def test_torn_trees_keep_what_is_similar(spark, make_docs, words):
    """First and last of three texts are at 0.798 and the middle at 0.89 of both: whichever pairs are checked first, all link."""
    rows = []
    for i in range(40):
        base = words(360, 300 + i).split()
        for k in range(3):
            changed = {20 + 40 * m for m in range(4 * k)}
            rows.append((3 * i + k, " ".join(f"x{i}{n}" if n in changed else w for n, w in enumerate(base))))
        assert jaccard(rows[-3][1], rows[-1][1]) < 0.8 < 0.88 < min(jaccard(rows[-3][1], rows[-2][1]), jaccard(rows[-2][1], rows[-1][1]))
    assert {r.doc_id for r in simhash.drop_near_duplicates(make_docs(rows)).collect()} == {3 * i for i in range(40)}


def test_similar_documents_near_the_threshold_are_found(spark, make_docs, words):
    """Copies with seven words changed (similarity 0.82) differ in more than one standard deviation now and then; all link."""
    rows, far = [], 0
    for i in range(80):
        base = words(360, 500 + i).split()
        text = " ".join(f"x{i}{n}" if n % 51 == 20 else w for n, w in enumerate(base))
        assert 0.8 <= jaccard(" ".join(base), text) < 0.83
        far += bin(plain(" ".join(base), 5, 256, True) ^ plain(text, 5, 256, True)).count("1") > 44
        rows += [(2 * i, " ".join(base)), (2 * i + 1, text)]
    assert far
    assert {r.doc_id for r in simhash.drop_near_duplicates(make_docs(rows)).collect()} == {2 * i for i in range(80)}


def test_other_texts_under_one_id_stay(spark, make_docs, words):
    """Of an id with a copy of another document and a text of its own, the latter stays; two unlike texts both stay."""
    rows = []
    for i in range(0, 200, 10):
        rows += [(i + 3, words(90, i)), (i + 5, words(90, i)), (i + 5, words(80, i + 1)), (i + 7, words(70, i + 2)), (i + 7, words(60, i + 3)), (i + 7, words(60, i + 3))]
    got = sorted((r.doc_id, r.text) for r in simhash.drop_near_duplicates(make_docs(rows)).collect())
    assert got == sorted(x for i in range(0, 200, 10) for x in [(i + 3, words(90, i)), (i + 5, words(80, i + 1)), (i + 7, words(70, i + 2)), (i + 7, words(60, i + 3))])


def test_pieces_give_the_same_hashes(monkeypatch, words):
    from tessera.llm import shingles

    texts = ["", " ", "one", "a b c d e f g h", words(400, 3), "x" * 300 + " y " + "z" * 90, " lead and  trail \n"]
    want = [np.concatenate([np.empty(0, np.uint64), *shingles.shingle_hashes(t.encode(), 4)]) for t in texts]
    for size in (1, 3, 17, 64):
        monkeypatch.setattr(shingles, "PIECE", size)
        for t, w in zip(texts, want):
            got = np.concatenate([np.empty(0, np.uint64), *shingles.shingle_hashes(memoryview(t.encode()), 4)])
            assert (got == w).all() and len(got) == len(w)
            assert (shingles.distinct_hashes(shingles.shingle_hashes(t.encode(), 4)) == np.unique(w)).all()


LONG = """
import resource, sys
sys.path.insert(0, {root!r})
import numpy as np, pyarrow as pa
from tessera.llm import simhash
from tessera.llm.shingles import texts_of
column = pa.array([("lorem ipsum dolor sit amet consectetur adipiscing elit sed do " * 1_700_000)])
simhash.fingerprint(b"warm up of all that is loaded once")
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
print([simhash.fingerprint(t) for t in texts_of(column)])
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""


def test_a_text_of_100_mb_takes_bounded_memory():
    """The text is held once, by Arrow; its fingerprint takes less than 64 MB more."""
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", LONG.format(root=root)], capture_output=True, text=True, timeout=280)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) < 64 * 1024


def test_torn_groups_are_cut_into_tiles(spark, make_docs, words, monkeypatch):
    """A large group of copies, some similar and some not, gives the same whatever the size of tiles."""
    base = words(200, 77).split()
    rows = []
    for i in range(120):
        r = random.Random(i)
        changed = set(r.sample(range(200), r.choice((1, 3, 5, 8))))
        rows.append((i, " ".join(f"y{i}{n}" if n in changed else w for n, w in enumerate(base))))
    root = list(range(120))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(120):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = sorted({find(i) for i in range(120)})
    assert 5 < len(want) < 100
    monkeypatch.setattr(simhash, "MANY", 8)
    for hot, room in ((1024, 1 << 20), (16, 1 << 20), (1024, 2000)):
        monkeypatch.setattr(simhash, "HOT", hot)
        monkeypatch.setattr(simhash, "TILE_MEMBERS", room)
        got = sorted(r.doc_id for r in simhash.drop_near_duplicates(make_docs(rows)).collect())
        assert got == want
