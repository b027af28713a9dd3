"""Token ids of documents, packed into fixed-length rows.

Documents are encoded where they are read and packed in windows of ``WINDOW``
tokens of a partition, so nothing is shuffled and memory is bounded.  In a window,
documents longer than a row are cut into full rows and a remainder, and the
segments are placed best fit first, longest first: a segment tree over free
capacities finds the row with the least room that suffices.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
#: Tokens packed together.
WINDOW = 1 << 21
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The id after the vocabulary ends each document.
END = 50256
#: Characters that the tokenizer gets at once.  Long texts are cut before white space, where its pattern cuts them too.
PART = 1 << 16
#: White space as the tokenizer's pattern has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of it that goes on for a part or more.  The pattern searches for a run's end on a stack that overflows beyond a million.
LONG_SPACE = re.compile(rf"(?<![{SPACE}])[{SPACE}]{{{PART},}}")


class BestFit:
    """How many open rows have exactly ``c`` free places, in a segment tree over ``c``."""

    def __init__(self, length: int):
        self.size = 1 << (length + 1).bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, free: int, row: int) -> None:
        self.rows.setdefault(free, []).append(row)
        self._count(free, 1)

    def _count(self, free: int, by: int) -> None:
        k = free + self.size
        while k:
            self.tree[k] += by
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least free places of at least ``need``, taken out: ``(free, row)``."""
        k, tree = need + self.size, self.tree
        while not tree[k]:
            while k & 1:  # a right child: nothing further right below this parent
                k >>= 1
                if k <= 1:
                    return None
            k += 1
        while k < self.size:
            k = 2 * k if tree[2 * k] else 2 * k + 1
        free = k - self.size
        row = self.rows[free].pop()
        self._count(free, -1)
        return free, row


def pack(lengths: list[int], length: int) -> list[list[tuple[int, int, int]]]:
    """Rows of segments ``(document, start, end)`` by best-fit decreasing; all tokens, each once."""
    full, rest = [], []
    for d, n in enumerate(lengths):
        at = 0
        while n - at >= length:
            full.append([(d, at, at + length)])
            at += length
        if n > at:
            rest.append((n - at, d, at))
    rest.sort(key=lambda x: (-x[0], x[1]))
    fit, rows = BestFit(length), []
    for n, d, at in rest:
        free, row = fit.take(n) or (length, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append((d, at, at + n))
        if free > n:
            fit.add(free - n, row)
    return full + rows


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": END})

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of ``text`` and END."""
        text, parts, at = text or "", [], 0
        for space in LONG_SPACE.finditer(text) if len(text) >= PART else ():
            # the last white space goes with what follows, as in the pattern
            end = space.end() - (space.end() < len(text))
            parts += self._parts(text, at, space.start())
            parts.append(np.array(self.encoding._encode_single_piece(text[space.start() : end]), np.uint16))
            at = end
        return np.concatenate([*parts, *self._parts(text, at, len(text)), np.array([END], np.uint16)])

    def _parts(self, text: str, at: int, end: int):
        """Ids of ``text[at:end]``, a part at a time."""
        while at < end:
            cut = self._cut(text, at + PART) if end - at > PART else end
            cut = end if cut < 0 else min(cut, end)
            yield self._encoded(text[at:cut])
            at = cut

    def _encoded(self, part: str) -> np.ndarray:
        # as an array from the start: a list of Python's integers would take ten times the room
        return self.encoding.encode_to_numpy(part, disallowed_special=()).astype(np.uint16)

    @staticmethod
    def _cut(text: str, at: int) -> int:
        """The next place where the pattern cuts for sure: a single space between other characters; -1 if there is none."""
        while (at := text.find(" ", at)) >= 0:
            if at + 1 < len(text) and not text[at - 1].isspace() and not text[at + 1].isspace():
                return at
            at += 1
        return -1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


KIND = pa.schema(
    [
        ("input_ids", pa.binary()),
        ("n_tokens", pa.int32()),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("position_ids", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())),
        ("starts", pa.list_(pa.int64())),
    ]
)


def _rows(keys: list, docs: list[np.ndarray], length: int):
    """The packed window, in batches of 1,024 rows."""
    packed = pack([len(d) for d in docs], length)
    for lo in range(0, len(packed), 1024):
        columns: list[list] = [[] for _ in KIND]
        for row in packed[lo : lo + 1024]:
            ids = np.concatenate([docs[d][a:b] for d, a, b in row])
            sizes = [b - a for _, a, b in row]
            positions = np.concatenate([np.arange(n, dtype=np.uint16) for n in sizes])
            values = (np.pad(ids, (0, length - len(ids)), constant_values=END).astype("<u2").tobytes(), len(ids), np.r_[0, np.cumsum(sizes)].tolist(), np.pad(positions, (0, length - len(ids))).astype("<u2").tobytes(), [keys[d] for d, _, _ in row], [a for _, a, _ in row])
            for c, v in zip(columns, values):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, KIND)], schema=KIND)


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows of ``length`` tokens: the id matrix and what tells its segments apart.

    ``input_ids`` and ``position_ids`` are ``length`` little-endian 16-bit integers;
    positions start at 0 in each segment.  ``cu_seqlens`` are the cumulative segment
    lengths, 0 first, ``n_tokens`` their last; padding (END, position 0) follows.
    ``doc_ids`` and ``starts`` say of which document a segment is and at which of
    its tokens it starts, so that all token sequences can be put together again.
    Every document ends with END, so null and empty texts have one token.  Repeated
    rows are packed each, ids may be null, an empty table gives no rows, and other
    columns are not looked at.  How documents meet in rows depends on how the table
    is split into partitions.  ``length`` is at most 65,536.
    """
    import public_tokenizers

    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(tokenizer), public_tokenizers.PATTERN))

    def run(batches):
        encoder, keys, held, tokens = Encoder(*shared.value), [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1))):
                ids = encoder.ids(text)
                keys.append(key)
                held.append(ids)
                tokens += len(ids)
                if tokens >= window:
                    yield from _rows(keys, held, length)
                    keys, held, tokens = [], [], 0
        yield from _rows(keys, held, length)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "input_ids binary, n_tokens int, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>")


def write_packed(packed: DataFrame, path: str, rows_per_file: int = 1 << 16) -> None:
    """The packed rows as Parquet files of at most ``rows_per_file`` rows.

    Of each file, the ``input_ids`` column, read as one buffer, is a row-major
    matrix of 16-bit ids.
    """
    packed.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
