import zlib

import pytest

from tessera.llm import sentencepiece as sp


@pytest.fixture(scope="module")
def codec():
    return sp.Codec(sp.read_vocabulary())


def best_score(codec, vocabulary, unit):
    """The highest score of any segmentation, piece by piece."""
    special = vocabulary["special"] | set(vocabulary["bytes"].values())
    score = {p: s for i, (p, s) in enumerate(zip(vocabulary["pieces"], vocabulary["scores"])) if i not in special}
    best = [0.0] + [float("-inf")] * len(unit)
    for end in range(1, len(unit) + 1):
        for start in range(end):
            if unit[start:end] in score:
                best[end] = max(best[end], best[start] + score[unit[start:end]])
        if unit[end - 1] not in score:
            best[end] = max(best[end], best[end - 1] + codec.unknown_score)
    return best[-1]


TEXTS = ["Hello world", " lead", "trail ", "two  spaces   three", "", "a", "\n\nlines\n x", "naïve 漢字 \U0001f600\U0001f600 x\x00y", "x" * 500, "under_score <s> </s> <unk> <0x41>", "tab\tbed", "     "]


def test_best_segmentation(codec):
    v = sp.read_vocabulary()
    bytes_ = set(v["bytes"].values())
    for text in TEXTS:
        if not text:
            continue
        unit = sp.SPACE + text.replace(" ", sp.SPACE)
        ids = list(memoryview(codec.encode(text)).cast("i"))
        total, raw = 0.0, []
        for i in ids:
            if i in bytes_:
                raw.append(codec.raw[i][0])
                if len(bytes(raw).decode("utf-8", "ignore")) == 1:
                    total, raw = total + codec.unknown_score, []
            else:
                total += v["scores"][i]
        assert total == pytest.approx(best_score(codec, v, unit), rel=1e-12)
        assert codec.encode(text) == codec.segment(unit)


def test_round_trip(codec, words):
    for text in [*TEXTS, words(3000, 1), "x y " * 20_000]:
        assert codec.decode(memoryview(codec.encode(text)).cast("i")) == text
    assert codec.encode(None) == b""


def test_no_worse_than_the_library_on_a_unigram_model(codec):
    """The library's own segmentation, over the same pieces and scores, never scores higher."""
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2", exc_type=ImportError)
    import sentencepiece

    model = proto.ModelProto()
    with open(sp.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    theirs = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    for text in ["Hello world", "the quick brown foxes, jumping", "naïve idea"]:
        score = lambda ids: sum(model.pieces[i].score for i in ids)
        assert score(memoryview(codec.encode(text)).cast("i")) >= score(theirs.encode(text))


def test_documents(spark, make_docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (1, "again"), (1, "again"), (77, None)]
    docs = make_docs(rows)
    got = sp.encode_documents(docs).collect()
    assert sorted(str((r.doc_id, r.decoded_crc32)) for r in got) == sorted(str((d, zlib.crc32((t or "").encode()))) for d, t in rows)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    back = sp.decode_documents(sp.encode_documents(docs)).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in back))) == sorted(map(str, ((d, t or "") for d, t in rows)))
    assert sp.encode_documents(make_docs([])).collect() == []


def test_cuts_change_nothing(codec, words, monkeypatch):
    """Parts and open spans of any size give the same ids; runs of spaces and marks at the cuts included."""
    r = __import__("random").Random(3)
    texts = [*TEXTS, words(300, 2), "".join(r.choice("abcdefgh漢字x😀") for _ in range(3000)), "a  b   c " * 50, " " * 70 + "x" + " " * 70, f"{sp.SPACE} a{sp.SPACE}b " * 30, "the" * 900]
    want = [codec.encode(t) for t in texts]
    for part, span in ((1, 1), (5, 40), (64, 200)):
        monkeypatch.setattr(sp, "PART", part)
        monkeypatch.setattr(sp, "SPAN", span)
        codec.known.clear()
        assert [codec.encode(t) for t in texts] == want


UNBROKEN = """
import resource, sys
sys.path.insert(0, {root!r})
from tessera.llm import sentencepiece as sp
codec = sp.Codec(sp.read_vocabulary())
text = "thequickbrownfoxjumps" * 238_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
ids = codec.encode(text)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before, len(ids) // 4)
"""


def test_a_long_unbroken_text_takes_bounded_memory():
    """Five million characters without a space: the ids, their copies and the text with its mark take less than 64 MB."""
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", UNBROKEN.format(root=root)], capture_output=True, text=True, timeout=280)
    assert done.returncode == 0, done.stderr
    kb, n = map(int, done.stdout.split()[-2:])
    assert kb < 64 * 1024 and n > 500_000


def test_long_runs_of_one_character(codec, make_docs, monkeypatch):
    """Segmentations of such runs may have nothing in common; the work must stay in proportion to their length."""
    texts = [c * 300_000 for c in (" ", "=", "a", "\n", "漢", "ab", "= ")] + ["x" + " " * 300_000 + "y", "a" * 100_000 + " " * 100_000 + "=" * 100_000]
    got = [codec.encode(t) for t in texts]
    monkeypatch.setattr(sp, "SPAN", 1 << 30)  # at once
    assert got == [codec.encode(t) for t in texts]
    rows = sp.encode_documents(make_docs(list(enumerate(texts)))).collect()
    assert all(r.round_trip and r.n_tokens == len(got[r.doc_id]) // 4 for r in rows)
