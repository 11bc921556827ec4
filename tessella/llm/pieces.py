"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For every prefix of a string the last token of its encoding is unique. The table is filled from left
to right: an automaton gives the pieces that end at a position, and of these the one that is
compatible with the last token of the prefix before it is the entry. Two tokens are compatible if
merging their characters by priority gives back these two. The ids are then read off backwards.

No piece of the model has its word mark behind another character, so merges never cross from a word
into the next one's mark. Nor has a piece a letter beside another character, so words are cut there too.
The table is filled for each distinct part, in a bounded memo that a Python worker shares between its tasks.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from tessella.llm.common import id_and_text

MARK = "▁"
MEMO_ENTRIES = 600_000
PAIR_ENTRIES = 1_000_000
_LETTER = re.compile(r"[^\W\d_]")


class Memo:
    """A bounded memo in two generations: what was asked for since the last turn outlives the next one."""

    def __init__(self, entries: int):
        self.half = entries // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> bytes:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value


class PieceCodec:
    """Encodes and decodes as the library does with the same model, without sampling."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = [i for i in range(sp.vocab_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id_of = {sp.id_to_piece(i): i for i in ordinary}
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece has the word mark inside; words can't be encoded one by one")
        self.score = {p: sp.get_score(i) for p, i in self.id_of.items()}
        self.bytes_of = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.singles = {p for p in self.id_of if len(p) == 1}
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (sp.bos_id(), sp.eos_id()))
        self.automaton = ahocorasick.Automaton()
        for p in self.id_of:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.split = self._parts_pattern().findall
        self.memo = Memo(MEMO_ENTRIES)
        self.after: dict[str, dict[str, bool]] = defaultdict(dict)
        self.n_pairs = 0

    def _parts_pattern(self) -> re.Pattern:
        """Runs of letters and of other characters, each with the marks before it; no merge crosses their borders.

        A letter that stands beside another character in some piece counts as such a character.
        """
        beside = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)} - {MARK}
        bound: set[str] = set()
        is_letter = lambda c: bool(_LETTER.fullmatch(c)) and c not in bound
        while True:
            mixed = {c for b in beside if b[0] != MARK and is_letter(b[0]) != is_letter(b[1]) for c in b if is_letter(c)}
            if not mixed:
                break
            bound |= mixed
        others = re.escape("".join(sorted(bound)))
        return re.compile(rf"{MARK}*(?:[^\W\d_{others}]+|(?:[\W\d_{others}](?<!{MARK}))+)|{MARK}+")

    def merge(self, text: str, border: int = 0) -> list[str]:
        """Tokens by merging: best score first, leftmost among equals. Nothing once a merge crosses ``border``."""
        symbols, score = list(text), self.score.get
        scores = [score(a + b) for a, b in zip(symbols, symbols[1:])]
        while True:
            best, at = None, -1
            for i, s in enumerate(scores):
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return symbols
            if border and sum(map(len, symbols[: at + 1])) == border:
                return []
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            scores[at : at + 1] = []
            if at:
                scores[at - 1] = score(symbols[at - 1] + symbols[at])
            if at < len(scores):
                scores[at] = score(symbols[at] + symbols[at + 1])

    def compatible(self, left: str, right: str) -> bool:
        """Whether ``left`` and ``right`` stay two tokens side by side; an empty ``left`` asks for ``right`` alone."""
        known = self.after[left].get(right)
        if known is None:
            if self.n_pairs >= PAIR_ENTRIES:
                for row in self.after.values():
                    row.clear()
                self.n_pairs = 0
            self.n_pairs += 1
            known = self.after[left][right] = self.merge(left + right, len(left)) == ([left, right] if left else [right])
        return known

    def tokens(self, word: str) -> list[str]:
        """The tokens of one word from its prefix table."""
        n = len(word)
        last = [""] * (n + 1)
        if self.singles.issuperset(word):
            after = self.after
            rows = [after[""]] * (n + 1)  # what is known to the right of each prefix's last token
            for at, piece in self.automaton.iter(word):  # by end, the longest first
                at += 1
                if not last[at]:
                    start = at - len(piece)
                    ok = rows[start].get(piece)
                    if self.compatible(last[start], piece) if ok is None else ok:
                        last[at] = piece
                        rows[at] = after[piece]
        else:
            ending: list[list[str]] = [[] for _ in range(n + 1)]
            for at, piece in self.automaton.iter(word):
                ending[at + 1].append(piece)
            for i in range(1, n + 1):  # a character that is no piece stands for its bytes
                last[i] = next(p for p in [*ending[i], word[i - 1]] if self.compatible(last[i - len(p)], p))
        out, i = [], n
        while i:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def part_ids(self, part: str) -> bytes:
        ids: list[int] = []
        for t in self.tokens(part):
            i = self.id_of.get(t)
            ids += [i] if i is not None else [self.bytes_of[b] for b in t.encode()]
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids with begin and end."""
        parts = self.split(MARK + text.replace(" ", MARK)) if text else []
        out = list(map(self.memo.young.get, parts))
        if None in out:
            for k, v in enumerate(out):
                if v is None:
                    out[k] = self.memo.get(parts[k]) or self.memo.put(parts[k], self.part_ids(parts[k]))
        return b"".join([self.begin, *out, self.end])

    def decode(self, ids: bytes) -> str:
        return self.model.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=1)
def shared_codec(path: str) -> PieceCodec:
    """The codec of this Python process; its memos are bounded and outlive a task."""
    return PieceCodec(path)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """``(doc_id, ids, decoded)``: ids as little-endian unsigned 32-bit integers, and their decoded text.

    A null or empty text gives begin and end alone; a null id is kept; repeated rows come out once
    each; very long texts are encoded whole, as time and memory follow their length; an empty table
    gives an empty one. Other columns are not read.
    """
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(path)
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                ids = [codec.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([codec.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded string")
