import random

import numpy as np
import tiktoken

from tessera.llm import packing


def test_best_fit_decreasing_matches_plain_version():
    r = random.Random(1)
    for length in (1, 2, 7, 64, 100):
        for _ in range(30):
            lengths = [r.randint(0, 3 * length) for _ in range(r.randint(0, 60))]
            rows = packing.pack(lengths, length)
            seen = sorted(s for row in rows for s in row)
            for d, n in enumerate(lengths):
                parts = [(a, b) for k, a, b in seen if k == d]
                assert [x for a, b in parts for x in range(a, b)] == list(range(n))
            assert all(0 < sum(b - a for _, a, b in row) <= length for row in rows)
            # plain: scan all open rows for the least room that suffices
            rest = sorted((n % length for n in lengths if n % length), reverse=True)
            free = []
            for n in rest:
                fits = [f for f in free if f >= n]
                if fits:
                    free.remove(min(fits))
                    free.append(min(fits) - n)
                else:
                    free.append(length - n)
            used = [length - f for f in free] + [length] * sum(n // length for n in lengths)
            assert sorted(used) == sorted(sum(b - a for _, a, b in row) for row in rows)


def test_all_tokens_come_back(spark, make_docs, words):
    import public_tokenizers

    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=packing.read_ranks(packing.TOKENIZER), special_tokens={})
    rows = [(1, None), (2, ""), (3, "one"), (4, words(3000, 1)), (5, words(80, 2)), (7, "  a\n\n b  " * 500), (8, "x" * 9000), (6, words(20_000, 3)), *((10 + i, words(i % 200, i)) for i in range(300))]
    got = packing.pack_documents(make_docs(rows), length=256, window=5000).collect()
    parts = {}
    for r in got:
        ids, positions = (np.frombuffer(r[c], "<u2") for c in ("input_ids", "position_ids"))
        assert len(ids) == len(positions) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 256
        assert len(r.doc_ids) == len(r.starts) == len(r.cu_seqlens) - 1
        assert (ids[r.n_tokens :] == packing.END).all()
        for d, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            parts.setdefault(d, []).append((start, ids[a:b].tolist()))
    for d, t in rows:
        ids = [x for _, p in sorted(parts[d]) for x in p]
        assert ids == encoding.encode_ordinary(t or "") + [packing.END]


def test_repeats_and_empty(make_docs):
    assert packing.pack_documents(make_docs([])).collect() == []
    got = packing.pack_documents(make_docs([(1, "a b")] * 3 + [(None, "c")])).collect()
    assert sorted(str(d) for r in got for d in r.doc_ids) == ["1", "1", "1", "None"]


def test_long_runs_of_white_space(make_docs):
    import public_tokenizers

    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=packing.read_ranks(packing.TOKENIZER), special_tokens={})
    encoder = packing.Encoder(packing.read_ranks(packing.TOKENIZER), public_tokenizers.PATTERN)
    n = packing.PART
    runs = [" " * n, "\n" * (n - 1), " \n\u3000\xa0\t" * n, " " * n + "\x1c" * n + " " * n]
    for text in [f"{a}{run}{b}" for run in runs for a in ("", "x", "\x1c", "it's 1") for b in ("", "y", "'s", "\x1cz", "<|endoftext|>")]:
        assert encoder.ids(text).tolist() == plain.encode_ordinary(text) + [packing.END]
    # beyond what the pattern's own search takes
    rows = [(k, f"{a}{run * 1_500_000}b c") for k, (a, run) in enumerate((("", " "), ("a", "\n"), ("a b\x1c", " \t")))]
    parts = {}
    for r in packing.pack_documents(make_docs(rows)).collect():
        ids = np.frombuffer(r.input_ids, "<u2")
        for d, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            parts.setdefault(d, []).append((start, ids[a:b].tolist()))
    for d, text in rows:
        *ids, end = [x for _, p in sorted(parts[d]) for x in p]
        assert end == packing.END and plain.decode(ids) == text
