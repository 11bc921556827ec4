"""Byte-level BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens, and accepts a sequence exactly if it is what the merges make of its bytes.
It is compiled from the merges in order, one gadget each. At first one state loops on every byte. For
the merge of u and v, let q be the state that u leads to and r the one that v leads to: a copy of q
without its arc for v takes over all arcs for u, and every state with an arc for u gains one for the
new token, to r. Where u and v never meet, nothing changes. So all arcs with one label lead to one state, and a copy is kept as its original and
the arc it lost; whether a state has an arc follows from these two and from the age of the label.

Arcs that were asked for are kept in a bounded table, from state and token to state. A word, as the
vocabulary's own pattern splits texts, is encoded by taking the arcs whose labels fit its bytes; its
ids are kept in a bounded memo. Decoding writes the labels of the arcs one after another.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from tessella.llm.common import id_and_text
from tessella.llm.pieces import Memo

MAX_ARCS = 400_000
MEMO_ENTRIES = 400_000
MEMO_CHARS = 200


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: its own if printable, else the next from 256 on."""
    printable = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    spare = iter(range(256, 512))
    return {chr(b if b in printable else next(spare)): b for b in range(256)}


class TokenAutomaton:
    """The automaton over tokens: ``target[token]`` is the state behind it, ``has(state, token)`` tells its arcs."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        n = max(labels) + 1
        self.left, self.born, self.target = [-1] * n, [0] * n, [0] * n
        self.parent, self.lost, self.since = [-1], [-1], [0]
        known = {i for i, b in labels.items() if len(b) == 1}
        self.arcs: dict[int, dict[int, int]] = {}
        self.n_arcs = 0
        for k, (u, v, w) in enumerate(merges, 1):
            if u not in known or v not in known or w in known:
                raise ValueError("a merge uses a token before it is made, or makes one again")
            known.add(w)
            q, r = self.target[u], self.target[v]
            self.born[w], self.target[w] = k, r
            if self._follow(q, v):
                self.left[w] = u
                self.parent.append(q)
                self.lost.append(v)
                self.since.append(k)
                self.target[u] = len(self.parent) - 1
        self._number_copies()

    def _follow(self, state: int, token: int) -> bool:
        """``has`` while the automaton is being compiled, from copy to original."""
        parent, lost, since, born, left = self.parent, self.lost, self.since, self.born, self.left
        while state:
            if token < 0:
                return False
            if born[token] >= since[state]:
                token = left[token]  # the arc came with the one for the label's first part
            elif lost[state] == token:
                return False
            else:
                state = parent[state]
        while born[token]:
            token = left[token]
            if token < 0:
                return False
        return True

    def _number_copies(self) -> None:
        """Copies form a tree: with places in its preorder, whether a state inherits from another is one comparison."""
        n = len(self.parent)
        size = [1] * n
        for s in range(n - 1, 0, -1):  # a copy has a larger number than its original
            size[self.parent[s]] += size[s]
        self.place, free = [0] * n, [1] * n
        for s in range(1, n):
            p = self.parent[s]
            self.place[s] = free[p]
            free[p] += size[s]
            free[s] = self.place[s] + 1
        gone: dict[int, list] = defaultdict(list)
        for s in range(1, n):
            gone[self.lost[s]].append((self.place[s], self.place[s] + size[s], self.since[s]))
        self.gone = {token: list(zip(*sorted(rows))) for token, rows in gone.items()}  # disjoint: what is lost stays lost

    def has(self, state: int, token: int) -> bool:
        """Whether the state has an arc with this label.

        An arc is there if no original from which the state inherits lost it, and if, when its label
        was made, the arc for the label's first part was there.
        """
        place, when, found = self.place[state], 1 << 40, True
        while True:
            if token < 0:
                found = False
                break
            rows = self.gone.get(token)
            if rows:
                i = bisect_right(rows[0], place) - 1
                if i >= 0 and place < rows[1][i] and rows[2][i] <= when:
                    found = False
                    break
            if not self.born[token]:
                break
            when, token = min(when, self.born[token]), self.left[token]
        return found

    def arc(self, state: int, token: int) -> int:
        """The state that the arc leads to, or -1; the table of arcs is filled as they are asked for."""
        if self.n_arcs >= MAX_ARCS:
            for row in self.arcs.values():
                row.clear()
            self.n_arcs = 0
        self.n_arcs += 1
        goal = self.arcs.setdefault(state, {})[token] = self.target[token] if self.has(state, token) else -1
        return goal


class BpeCodec:
    """Encodes and decodes as the ``tokenizers`` library does with the same file, without special tokens added."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        added = whole["added_tokens"]
        if odd or whole["normalizer"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"not a plain byte-level vocabulary: {odd}")
        letters = byte_letters()
        spelled = {token: bytes(letters[c] for c in token) for token in model["vocab"]}
        self.labels = {i: spelled[token] for token, i in model["vocab"].items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = TokenAutomaton(self.labels, [(model["vocab"][a], model["vocab"][b], model["vocab"][a + b]) for a, b in pairs])
        self.spelled = ahocorasick.Automaton()
        for i, label in self.labels.items():
            self.spelled.add_word(label.decode("latin-1"), (i, len(label)))
        self.spelled.make_automaton()
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        self.label_list = [self.labels.get(i, b"") for i in range(max([*self.labels, *(t["id"] for t in added)]) + 1)]
        for t in added:
            self.label_list[t["id"]] = t["content"].encode()
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if added else None
        self._word_patterns(path)
        self.memo = Memo(MEMO_ENTRIES)

    def _word_patterns(self, path: str) -> None:
        """The published pattern; and the same without letters and digits that the library's older Unicode tables lack."""
        import regex
        from tokenizers import Tokenizer

        split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        unassigned = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn")
        newer = [c for c in regex.findall(r"[\p{L}\p{N}]", unassigned) if len(split(("a" if regex.match(r"\p{L}", c) else "1") + c)) > 1]
        self.newer = frozenset(newer)
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.older_words = self.words
        if newer:
            out = "[" + "".join(f"\\U{ord(c):08x}" for c in newer) + "]"
            adapted = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|{out})")
            for kind in (r"\p{L}+", r"\p{N}+"):
                adapted = adapted.replace(f" ?{kind}", f" ?(?:(?!{out}){kind[:-1]})+")
            self.older_words = regex.compile(adapted).findall

    def word_ids(self, word: bytes) -> bytes:
        """Take the arcs that fit the bytes, from left to right; one of those that end at a byte is open.

        Every prefix has one tokenization, so the tokens are read off from the last one back.
        """
        n, arcs, none = len(word), self.automaton.arcs, {}
        state, ended = [0] * (n + 1), [-1] * (n + 1)
        rows = [arcs.get(0, none)] * (n + 1)
        for end, (token, length) in self.spelled.iter(word.decode("latin-1")):
            end += 1
            if ended[end] < 0:
                start = end - length
                goal = rows[start].get(token)
                if goal is None:
                    goal = self.automaton.arc(state[start], token)
                if goal >= 0:
                    ended[end], state[end], rows[end] = token, goal, arcs.get(goal, none)
        out, labels = [], self.labels
        while n:
            token = ended[n]
            out.append(token)
            n -= len(labels[token])
        return array("I", out[::-1]).tobytes()

    def _plain(self, text: str) -> bytes:
        words = self.words(text) if text.isascii() or self.newer.isdisjoint(text) else self.older_words(text)
        out = list(map(self.memo.young.get, words))
        if None in out:
            for k, v in enumerate(out):
                if v is None:
                    word = words[k]
                    if len(word) > MEMO_CHARS:
                        out[k] = self.word_ids(word.encode())
                    else:
                        out[k] = self.memo.get(word) or self.memo.put(word, self.word_ids(word.encode()))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.cut is None or not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(self.added[part] if k % 2 else self._plain(part) for k, part in enumerate(self.cut(text)))

    def decode(self, ids: bytes) -> str:
        labels = self.label_list
        return b"".join([labels[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def shared_codec(path: str) -> BpeCodec:
    """The codec of this Python process; its tables and memo are bounded and outlive a task."""
    return BpeCodec(path)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """``(doc_id, ids, decoded)``: ids as little-endian unsigned 32-bit integers, and their decoded text.

    A null or empty text has no ids; a null id is kept; repeated rows come out once each; very long
    texts are encoded whole, as time and memory follow their length; an empty table gives an empty
    one. Other columns, whatever their names, are not read.
    """
    path = model_path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(path)
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                ids = [codec.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([codec.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded string")
