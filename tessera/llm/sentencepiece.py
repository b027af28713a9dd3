"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over all pieces reads a text once; for each piece that
ends at a position, those along the output links included, the best score there
is relaxed (Viterbi).  A character that no piece covers on its own may also be
passed at a penalty and becomes its UTF-8 bytes.  No piece has the space mark
after another character, so the best segmentation of a text is that of its units,
runs of marks and what follows them; a unit is segmented once and its ids are
remembered, up to ``REMEMBER`` units a worker.
"""

from __future__ import annotations

import re
import zlib
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The space mark and the penalty of an uncovered character, fixed values of the format.
SPACE, UNKNOWN_PENALTY = "▁", 10.0
REMEMBER = 300_000
#: Characters of a unit that is worth remembering.
SHORT = 64
#: Characters of a text that are cut into units at once, and of a unit that are open at once.
PART, SPAN = 1 << 20, 1 << 16
#: Tokens of an output batch.
BATCH_TOKENS = 1 << 20
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def read_vocabulary(path: str = MODEL) -> dict:
    """Pieces, scores and kinds of a model file, as plain values.  Its size bounds what is sent to executors."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in every]
    return {
        "pieces": pieces,
        "scores": [model.get_score(i) for i in every],
        "bytes": {int(pieces[i][3:5], 16): i for i in every if model.is_byte(i)},
        "special": {i for i in every if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)},
        "unknown": model.unk_id(),
    }


class Codec:
    """Encodes and decodes with the piece scores of a vocabulary.

    Text is taken as it is, with a space put before it (as the format's dummy
    prefix) and spaces written as marks; with all 256 byte pieces decoding gives
    back every text, but for space marks in it, which come back as spaces.
    """

    def __init__(self, vocabulary: dict):
        pieces, scores, self.bytes, self.unknown = (vocabulary[k] for k in ("pieces", "scores", "bytes", "unknown"))
        self.known: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        special = vocabulary["special"] | set(self.bytes.values())
        plain = [i for i in range(len(pieces)) if i not in special]
        for i in plain:
            self.automaton.add_word(pieces[i], (len(pieces[i]), scores[i], i))
        self.automaton.make_automaton()
        self.longest = max((len(pieces[i]) for i in plain), default=1)
        self.unknown_score = min((scores[i] for i in plain), default=0.0) - UNKNOWN_PENALTY
        # units are cut before a run of marks; that is exact only if no piece crosses such a place
        self.by_units = not any(SPACE in pieces[i].lstrip(SPACE) for i in plain)
        of = {i: b for b, i in self.bytes.items()}
        self.raw = [bytes([of[i]]) if i in of else b"" if i in special else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]

    def segment(self, unit: str) -> bytes:
        """Ids of the best segmentation of ``unit``, as 32-bit integers.

        Of equal scores, the first found wins: the longer last piece.
        """
        if len(unit) > SPAN:
            return self._segment_long(unit)
        n, bad = len(unit), self.unknown_score
        best, back, ids, passed = [0.0] + [float("-inf")] * n, [0] * (n + 1), [-1] * (n + 1), [True] + [False] * n
        at = 1

        def settle(to: int, at: int) -> None:
            for k in range(at, to):
                if not passed[k]:
                    score = best[k - 1] + bad
                    if score > best[k]:
                        best[k], back[k], ids[k] = score, 1, -1

        for end, (length, score, i) in self.automaton.iter(unit):
            end += 1
            if at < end:
                settle(end, at)
                at = end
            if length == 1:
                passed[end] = True
            score += best[end - length]
            if score > best[end]:
                best[end], back[end], ids[end] = score, length, i
        settle(n + 1, at)
        return self._read(unit, 0, n, back, ids)

    def _segment_long(self, unit: str) -> bytes:
        """:meth:`segment` for a unit of any length.

        Every ``SPAN`` positions, what all segmentations still open have in common is
        settled and forgotten, so the unit takes little more than its ids.  In a run of one
        character they may have nothing in common up to its end: what is looked through doubles
        each time, so the work stays in proportion, and a position takes 17 bytes.
        """
        bad, longest = self.unknown_score, self.longest
        # of each position from ``base`` on: the best score, the length and id of its last piece, and whether it can do without a penalty
        low, base, done = float("-inf"), 0, bytearray()
        room = min(len(unit) + 1, SPAN + longest + 1)
        best, back, ids, passed = array("d", [low]) * room, array("i", bytes(4 * room)), array("i", [-1]) * room, bytearray(room)
        best[0], passed[0] = 0.0, 1
        at, limit = 1, SPAN + longest  # positions before ``at`` are final
        for end, found in self._ends(unit):
            end -= base
            if end >= len(best):
                more = min(len(unit) + 1 - base, max(end + longest, 2 * len(best))) - len(best)
                best.extend(array("d", [low]) * more)
                back.extend(array("i", bytes(4 * more)))
                ids.extend(array("i", [-1]) * more)
                passed.extend(bytes(more))
            for k in range(at, end if found else end + 1):
                if not passed[k]:
                    score = best[k - 1] + bad
                    if score > best[k]:
                        best[k], back[k], ids[k] = score, 1, -1
            at = max(at, end if found else end + 1)
            if found:
                length, score, i = found
                if length == 1:
                    passed[end] = 1
                score += best[end - length]
                if score > best[end]:
                    best[end], back[end], ids[end] = score, length, i
            if at > limit:
                common = self._common(back, at - longest - 1, at - 1)
                if common:
                    done += self._read(unit, base, common, back, ids)
                    for x in (best, back, ids, passed):
                        del x[:common]
                    base, at = base + common, at - common
                limit = max(SPAN + longest, 2 * at)
        return bytes(done + self._read(unit, base, len(unit) - base, back, ids))

    def _ends(self, unit: str):
        """``(end, piece)`` of the pieces in ``unit``, and at last its own end."""
        for end, found in self.automaton.iter(unit):
            yield end + 1, found
        yield len(unit), None

    @staticmethod
    def _common(back: array, lo: int, hi: int) -> int:
        """The last position that the best ways to all of ``lo`` to ``hi`` have passed."""
        open_ = set(range(max(lo, 0), hi + 1))
        while len(open_) > 1:
            k = max(open_)
            if not back[k]:
                return 0
            open_.remove(k)
            open_.add(k - back[k])
        return open_.pop()

    def _read(self, unit: str, base: int, end: int, back, ids) -> bytes:
        out = array("i")
        while end:
            start = end - back[end]
            if ids[end] >= 0:
                out.append(ids[end])
            else:
                out.extend(self.bytes.get(b, self.unknown) for b in reversed(unit[base + start : base + end].encode("utf-8", "replace")))
            end = start
        out.reverse()
        return out.tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of ``text`` as 32-bit integers; none for null and empty."""
        if not text:
            return b""
        if not self.by_units:
            return self.segment(SPACE + text.replace(" ", SPACE))
        known, get, out, at = self.known, self.known.get, bytearray(), 0
        while at < len(text):
            # a part ends before a run of spaces; the first begins with the space put before it, the others with their own
            end = at + PART
            end = len(text) if end >= len(text) else text.find(" ", end)
            while end > 0 and text[end - 1] == " ":
                end -= 1
            end = len(text) if end <= at else end
            part, at = text[at:end] if at else " " + text[:end], end
            if "  " in part or SPACE in part:
                words = [u[1:] for u in re.findall(f"{SPACE}+[^{SPACE}]*", part.replace(" ", SPACE))]
            else:
                words = part[1:].split(" ")
            for w in words:
                ids = get(w)
                if ids is None:
                    ids = self.segment(SPACE + w)
                    if len(w) <= SHORT:
                        if len(known) >= REMEMBER:
                            known.clear()
                        known[w] = ids
                out += ids
        return bytes(out)

    def decode(self, ids) -> str:
        """The text of ``ids``; the space put before it goes."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _run(shared):
    kind = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32())), ("decoded_crc32", pa.int64()), ("round_trip", pa.bool_())])

    def out(rows) -> pa.RecordBatch:
        counts = np.array([len(r[1]) // 4 for r in rows], np.int32)
        ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(np.frombuffer(b"".join(r[1] for r in rows), np.int32)))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(counts), ids, pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.bool_())], schema=kind)

    def run(batches):
        codec, rows, held = Codec(shared.value), [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1))):
                ids = codec.encode(text)
                back = codec.decode(memoryview(ids).cast("i"))
                rows.append((key, ids, zlib.crc32(back.encode()), back == (text or "")))
                held += len(ids) // 4
                if held >= BATCH_TOKENS:
                    yield out(rows)
                    rows, held = [], 0
        yield out(rows)

    return run


def encode_documents(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded_crc32, round_trip)`` for each row of ``docs``.

    ``decoded_crc32`` is that of the text decoded from ``ids`` again, in UTF-8, and
    ``round_trip`` says whether it is the text.  Null and empty texts have no ids.
    Repeated rows get a row each, ids may be null, an empty table gives an empty
    result, and other columns are not looked at.  The vocabulary is read on the
    driver, so executors don't need the file.  Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_run(shared), "doc_id long, n_tokens int, ids array<int>, decoded_crc32 long, round_trip boolean")


def decode_documents(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` of ``ids``; null and empty ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(model))

    def run(batches):
        codec = Codec(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
