"""Benchmark decontamination by pigeonhole edit matching.

A test item may stand in a document with up to ``e`` edits, ``e`` being
``ERROR_RATE`` of its length.  Cut into ``e + 1`` pieces, one of them must stand
there unchanged; an Aho-Corasick automaton over all pieces finds every such hit
in one pass over the whole text.  Around each hit Myers' bit-parallel algorithm
computes the least edit distance of the item to any part of the window.
Documents are never shuffled, and a long text is searched piece by piece.  Items come
in blocks of ``BLOCK_CHARS`` characters, each block one pass, so that what goes to an
executor is bounded; a worker makes a block's automaton once for all its tasks.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

ERROR_RATE = 0.05
#: Shorter items, by characters after folding, must stand there exactly, as whole words.
MIN_ITEM_CHARS = 30
#: About 65 bytes of a worker's memory a character.
BLOCK_CHARS = 2_000_000
#: Characters of a text that are folded and searched at once.
PIECE = 1 << 20
#: Items whose bit vectors a worker holds at once.
PATTERNS = 4096


def fold(text: str | None) -> str:
    """Lower case, runs of white space as one space, none at the ends."""
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of about equal length with their offsets."""
    n, k = len(item), budget + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """An item ready for Myers' algorithm; Python's integers are its bit vectors."""

    def __init__(self, item: str):
        self.m, self.peq = len(item), {}
        for i, c in enumerate(item):
            self.peq[c] = self.peq.get(c, 0) | 1 << i
        self.mask, self.top = (1 << self.m) - 1, 1 << self.m - 1

    def best(self, text: str) -> tuple[int, int]:
        """The least distance to any part of ``text``, and where the first such part ends."""
        peq, mask, top = self.peq, self.mask, self.top
        up, down, score = mask, 0, self.m
        best, at = score, 0
        for k, c in enumerate(text):
            eq = peq.get(c, 0)
            x = eq | down
            d0 = ((((x & up) + up) ^ up) | x) & mask
            right_up, right_down = (down | ~(d0 | up)) & mask, up & d0
            if right_up & top:
                score += 1
            elif right_down & top:
                score -= 1
                if score < best:
                    best, at = score, k + 1
            right_up, right_down = right_up << 1 & mask, right_down << 1 & mask
            up, down = (right_down | ~(d0 | right_up)) & mask, right_up & d0
        return best, at


def _inside(left: str, right: str) -> bool:
    """Whether two characters side by side belong to one word."""
    return left.isalnum() and right.isalnum()


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], rate: float, min_chars: int = 0):
        self.items, self.short = items, [len(t) < min_chars for _, t in items]
        self.budgets = [0 if short else int(rate * len(t)) for short, (_, t) in zip(self.short, items)]
        #: What a piece of a text takes over from the one before: no match is longer.
        self.overlap = max((len(t) + 2 * e for (_, t), e in zip(items, self.budgets)), default=0)
        self.pattern = lru_cache(PATTERNS)(lambda k: Pattern(items[k][1]))
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(items):
            for offset, piece in pieces(t, self.budgets[k]):
                where.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int]]:
        """``(item, distance)`` of each item that stands in ``text`` within its budget, with its least distance."""
        best: dict[int, int] = {}
        if not self.items:
            return []
        for before, folded in folded_pieces(text, self.overlap):
            self._search(before, folded, best)
        return sorted(((self.items[k][0], d) for k, d in best.items()), key=lambda x: (x[0] is None, x))

    def _search(self, before: str, folded: str, best: dict[int, int]) -> None:
        """Lower ``best`` by what stands in a piece; ``before``: the character in front of it."""
        windows: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.automaton.iter(folded):
            for k, offset in places:
                if best.get(k) == 0:
                    continue
                start, item = end + 1 - length - offset, self.items[k][1]
                if self.short[k]:
                    left = folded[start - 1] if start else before
                    if not _inside(left, folded[start]) and not _inside(folded[end], folded[end + 1 : end + 2]):
                        best[k] = 0
                    continue
                if not offset and folded.startswith(item, start):
                    best[k] = 0
                    continue
                e, held = self.budgets[k], windows.setdefault(k, [])
                lo, hi = max(0, start - e), min(len(folded), start + len(item) + e)
                if held and held[-1][0] <= lo <= held[-1][1]:  # hits of a piece come in order: their windows grow together
                    held[-1][1] = max(hi, held[-1][1])
                else:
                    held.append([lo, hi])
        for k, spans in windows.items():
            if best.get(k) == 0:
                continue
            spans.sort()
            merged = [spans[0]]
            for lo, hi in spans[1:]:
                if lo <= merged[-1][1]:
                    merged[-1][1] = max(hi, merged[-1][1])
                else:
                    merged.append([lo, hi])
            pattern = self.pattern(k)
            d = min(pattern.best(folded[lo:hi])[0] for lo, hi in merged)
            if d <= self.budgets[k]:
                best[k] = min(d, best.get(k, d))


def folded_pieces(text: str | None, overlap: int):
    """``(character before, piece)`` of the folded text, each with ``overlap`` characters of the one before in front."""
    text = text or ""
    if len(text) <= PIECE:
        folded = fold(text)
        if folded:
            yield "", folded
        return
    kept, before, at = "", "", 0
    while at < len(text):
        end = at + PIECE
        # a cut before white space, so that no word is cut; a longer word is searched whole
        while end < len(text) and not text[end].isspace():
            end += 1
        more = fold(text[at:end])
        at = end
        if not more:
            continue
        whole = f"{kept} {more}" if kept else more
        yield before, whole
        cut = max(0, len(whole) - overlap)
        before = whole[cut - 1] if cut else before
        kept = whole[cut:]


_matchers: dict = {}


def _matcher(shared, rate: float, min_chars: int) -> Matcher:
    """The block's matcher, which the worker keeps until it gets another block."""
    key = (shared.value[0], rate, min_chars)
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(shared.value[1], rate, min_chars)
    return _matchers[key]


def _items(benchmark: DataFrame, id_col: str, text_col: str, nameless: bool):
    """Blocks of distinct folded items ``(smallest id, text)``, in the order of ids; with ``nameless`` those without an id too."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fold(t) for t in b.column(1).to_pylist()], pa.string())], names=["id", "folded"])

    folded = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, folded string")
    known = folded.filter((F.col("id").isNotNull() | F.lit(nameless)) & (F.col("folded") != ""))
    once = written(known.groupBy("folded").agg(F.min("id").alias("id")), "items")
    block, held = [], 0
    for r in once.orderBy("id").toLocalIterator():
        block.append((r["id"], r["folded"]))
        held += len(r["folded"])
        if held >= BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


def _matched(shared, rate: float, min_chars: int):
    def run(batches):
        matcher = _matcher(shared, rate, min_chars)
        for b in batches:
            rows = [(key.as_py(), *m) for key, text in zip(b.column(0), b.column(1)) for m in matcher.matches(text.as_py())]
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())], names=["doc_id", "item_id", "distance"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE, min_chars: int = MIN_ITEM_CHARS) -> DataFrame:
    """``(doc_id, item_id, distance)``: each item that stands in a document, with its least edit distance.

    Case and white space don't count.  Items whose folded texts are equal count as
    one, under the smallest id.  Items shorter than ``min_chars`` must
    stand there exactly, as whole words.  Items that are null, empty or without an id match
    nothing, and nothing stands in null or empty texts.  Whole
    texts are searched.  Repeated rows of documents give repeated rows.  Without
    documents or items the result is empty.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind, out = "doc_id long, item_id long, distance int", None
    for block in _items(benchmark, item_col, item_text, False):
        found = rows.mapInArrow(_matched(spark.sparkContext.broadcast((uuid.uuid4().hex, block)), rate, min_chars), kind)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], kind) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE, min_chars: int = MIN_ITEM_CHARS) -> DataFrame:
    """``docs`` without those in which an item of ``benchmark`` stands, one without an id included; see :func:`contaminated`."""
    out = docs
    for block in _items(benchmark, item_col, item_text, True):

        def run(batches, shared=docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block))):
            matcher = _matcher(shared, rate, min_chars)
            for b in batches:
                clean = np.array([not matcher.matches(t.as_py()) for t in b.column(text_col)], bool)
                yield b.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
