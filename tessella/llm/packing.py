"""Sequence packing by Karmarkar-Karp multiway differencing.

Documents are tokenized and cut where they lie, so nothing is shuffled: whole sequences are cut off
long documents, and the remaining pieces gather in groups. In a group the differencing method keeps
partial partitions in a heap by their imbalance and merges the two most imbalanced ones so that
their imbalances oppose each other. That gives windows of near-equal totals; while the largest
exceeds the capacity, the number of windows rises and the group is partitioned anew.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessella.llm.common import id_and_text

CAPACITY = 1024
MAX_PIECE = 128
GROUP_WINDOWS = 256
LONG_SPACE = 20_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

# A space goes with the run of other characters behind it, as in the tokenizer's own pattern, so that
# every chunk can be tokenized for itself. Unicode White_Space, which is not Python's \s.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_SPACES = re.compile(f"[{_WS}]{{{LONG_SPACE}}}")


def added_tokens(path: str | None = None) -> dict[str, int]:
    """Ids of the added tokens of ``byte_bpe_50k.json``, all of which are matched as they stand."""
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    assert not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in found)
    return {t["content"]: t["id"] for t in found}


class WordTokenizer:
    """Byte-level BPE ids of whole texts.

    Texts are first split at the added tokens of ``byte_bpe_50k.json``, which have ids of their own. The ranks
    are the vocabulary of that file; a test holds the ids against its tokenizer. Very long runs of white space,
    which the library's pattern can't match in its stack, are cut off and encoded as the one chunk they are.
    """

    def __init__(self, path: str, added: dict[str, int] | None = None):
        import tiktoken

        added = added_tokens() if added is None else added
        self.added = {t: array("I", [i]).tobytes() for t, i in added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        coding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode, self.encode_chunk = coding.encode_ordinary, coding._encode_single_piece

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.split is None or not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(self.added[part] if k % 2 else self._plain(part) for k, part in enumerate(self.split(text)))

    def _plain(self, text: str) -> bytes:
        if len(text) < LONG_SPACE or not _SPACES.search(text):
            return array("I", self.encode(text)).tobytes()
        whole, one = self.encode, self.encode_chunk
        return b"".join(array("I", one(c) if len(c) >= LONG_SPACE and _SPACES.match(c) else whole(c)).tobytes() for c in _CHUNK.findall(text))


@lru_cache(maxsize=1)
def shared_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python process, which outlives a task."""
    return WordTokenizer(path)


def differencing(sizes: list[int], windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each item and total of each window, by multiway differencing.

    A partial partition is a descending array of normalised totals and, beside it, the tree of the
    items in each. Windows that it does not use yet are left out, as their totals are zero.
    """
    n = len(sizes)
    left, right = [-1] * n, [-1] * n
    heap = [(-s, i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    stamp = n
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heapq.heappop(heap)
        both = len(a) + len(b) - windows
        if both > 0:  # the smallest of one meet the largest of the other
            cut = len(a) - both
            shared = np.arange(len(left), len(left) + both)
            met, with_ = ta[cut:], tb[::-1][:both]
            left += met.tolist()
            right += with_.tolist()
            total = np.concatenate((a[:cut], a[cut:] + b[::-1][:both], b[::-1][both:]))
            tree = np.concatenate((ta[:cut], shared, tb[::-1][both:]))
        else:
            total, tree = np.concatenate((a, b)), np.concatenate((ta, tb))
        order = np.argsort(-total, kind="stable")
        total, tree = total[order], tree[order]
        low = int(total[-1]) if len(total) == windows else 0
        heapq.heappush(heap, (low - int(total[0]), stamp, total - low, tree))
        stamp += 1
    window, sums = np.zeros(n, np.int64), np.zeros(windows, np.int64)
    for w, top in enumerate(heap[0][3].tolist() if heap else []):
        todo = [top]
        while todo:
            x = todo.pop()
            if x < n:
                window[x] = w
                sums[w] += sizes[x]
            else:
                todo += (left[x], right[x])
    return window, sums


def pack(sizes: list[int], capacity: int) -> np.ndarray:
    """Window of each item; the number of windows rises while one exceeds the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        window, sums = differencing(sizes, windows)
        if sums.max(initial=0) <= capacity:
            return window
        windows += max(1, windows // 256)


def _cut(n: int, capacity: int, max_piece: int) -> tuple[list[int], list[int]]:
    """Starts of the whole sequences in a document of ``n`` ids, and bounds of the pieces of its rest."""
    whole = n // capacity
    rest = n - whole * capacity
    pieces = -(-rest // max_piece)
    return [i * capacity for i in range(whole)], [whole * capacity + rest * i // pieces for i in range(pieces)] + [n] if pieces else []


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    max_piece: int = MAX_PIECE,
    group_windows: int = GROUP_WINDOWS,
    ranks_path: str | None = None,
    end_id: int = 0,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers. A null or empty text is
    a document of the end id alone; a null id is kept; repeated rows are documents of their own; very
    long texts become whole sequences and one rest; an empty table gives an empty one. Sequence ids
    are unique in the result and made of the task's number and a count. Other columns are not read.
    """
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared_tokenizer(path)
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        held: list[tuple] = []  # doc_id, start, end, ids, doc_tokens
        amount, out = 0, []

        def flush() -> None:
            nonlocal sequence, amount
            if not held:
                return
            window = pack([h[2] - h[1] for h in held], capacity)
            at: dict[int, int] = {}
            joined: list[list] = []
            for i in np.lexsort((np.arange(len(held)), window)).tolist():
                doc, start, end, ids, total = held[i]
                w = int(window[i])
                prev = joined[-1] if joined else None
                offset = at.get(w, 0)
                at[w] = offset + end - start
                if offset and prev[7] is ids and prev[1] + prev[2] == start:  # goes on where the last piece ended
                    prev[2] += end - start
                else:
                    joined.append([doc, start, end - start, None, total, sequence + w, offset, ids])
            for j in joined:
                j[3] = j[7][4 * j[1] : 4 * (j[1] + j[2])]
                out.append(tuple(j[:7]))
            sequence += int(window.max()) + 1
            held.clear()
            amount = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokenizer.ids(text.as_py()) + tail
                n = len(ids) // 4
                whole, bounds = _cut(n, capacity, max_piece)
                for start in whole:
                    out.append((doc, start, capacity, ids[4 * start : 4 * (start + capacity)], n, sequence, 0))
                    sequence += 1
                held += [(doc, s, e, ids, n) for s, e in zip(bounds, bounds[1:])]
                amount += bounds[-1] - bounds[0] if bounds else 0
                if amount >= group_windows * capacity:
                    flush()
                if len(out) >= 4096:
                    yield batch_of(out)
                    out.clear()
        flush()
        if out:
            yield batch_of(out)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
