"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. Tokens that hold a digit or an at sign are the nodes of a linear chain per
document; tokens that repeat, share their digits or the last seven of them, or the part before the at sign,
are joined by skip edges to the first of their like. Node, chain and skip weights are learnt together by
pseudo-likelihood on a bounded sample of documents, with a prior that like tokens agree. There the tokens in base spans bear the labels, and half
of all tokens are learnt without the features of their own form, so that context, neighbours and likes must
carry the label; a token outside the patterns whose like is inside is left out, as its label is unknown.
In use, tokens in base spans keep their label as evidence, and loopy sum-product messages along chain and
skip edges, until they settle, make like tokens agree throughout the document. Tokens outside base spans that
are surely of a kind, and have a like of that kind, become further spans: a phone number without its prefix,
an address without its domain. Base spans always stay.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import id_and_text

KINDS = ["email", "ip", "card", "phone"]
FEATURES = 1 << 14
MAX_SAMPLE = 4000  # bound of the documents that the field is fitted on
MAX_SAMPLE_CHARS = 20_000  # longer documents are no examples for the fit; they are searched like any other
ROUNDS, SETTLED = 200, 1e-7  # messages are passed until none changes by more
EVIDENCE = 30.0
AGREEMENT = 4.0  # prior log potential of two like tokens of one kind, which a corpus without repeated mentions keeps
SURE = 0.9

# The stated patterns; possessive digits and the look-behind only spare futile retries inside a run.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MARKED = re.compile(r"[0-9@]")
_EDGE = "()[]{}<>\"'.,;:!?|"
_SPACE = re.compile(r"\s")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As a leftmost search would give them, in linear time: the local part is the whole run before the sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, found.end()
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by kind as listed, then start."""
    out = [("email", s, e) for s, e in _emails(text)]
    if not _MARKED.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the white-space tokens that hold a digit or an at sign, without punctuation around them."""
    out, end = [], 0
    for m in _MARKED.finditer(text):
        at = m.start()
        if at < end:
            continue
        start = at
        while start > end and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, at)
        end = stop.start() if stop else len(text)
        token = text[start:end]
        lead = len(token) - len(token.lstrip(_EDGE))
        out.append((start + lead, start + lead + len(token.strip(_EDGE))))
    return out


def _shape(token: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[^\W\d_a-zA-Z]", "u", re.sub(r"[0-9]", "9", token)))))


def _features(text: str, spans: list[tuple[int, int]]) -> list[tuple[list[int], list[int]]]:
    """Hashed features of each token: of its own form, and of the words beside it and its neighbours' shapes."""
    shapes = [_shape(text[s:e]) for s, e in spans]
    hashed = lambda named: [zlib.crc32(f.encode("utf-8", "replace")) % FEATURES for f in named]
    out = []
    for i, (s, e) in enumerate(spans):
        token = text[s:e]
        around = text[max(0, s - 24) : s].split(" ")[-2:], text[e : e + 24].split(" ")[:2]
        context = ["bias", f"p{around[0][:1]}", f"n{around[1][-1:]}"]
        if i and s - spans[i - 1][1] <= 3:
            context.append(f"l{shapes[i - 1]}")
        if i + 1 < len(spans) and spans[i + 1][0] - e <= 3:
            context.append(f"r{shapes[i + 1]}")
        own = [f"s{shapes[i]}", f"d{min(20, sum(map(str.isdigit, token)))}", "@" * ("@" in token) or "-", "." * (token.count(".") == 3) or "_"]
        out.append((hashed(own), hashed(context)))
    return out


def _gold(spans: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> list[int]:
    """0 for none, else 1 + the kind of the base span that covers most of the token."""
    out = []
    for s, e in spans:
        over = max(((min(e, be) - max(s, bs), KINDS.index(k) + 1) for k, bs, be in base if bs < e and s < be), default=(0, 0))
        out.append(over[1])
    return out


def _likes(token: str) -> set[str]:
    """What a token shares with those like it."""
    token = token.lower()
    digits = _NOT_DIGIT.sub("", token)
    out = {"t" + token} if len(token) >= 6 else set()
    if len(digits) >= 7:
        out |= {"d" + digits, "e" + digits[-7:]}
    local = token.partition("@")[0] if "@" in token else ""
    return out | ({"l" + local} if len(local) >= 4 else set())


def _skips(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Skip edges: each token with the first one like it, so that two steps span the document."""
    first: dict[str, int] = {}
    out = set()
    for i, (s, e) in enumerate(spans):
        for key in _likes(text[s:e]):
            j = first.setdefault(key, i)
            if j != i:
                out.add((j, i))
    return sorted(out)


@dataclass
class SkipChainField:
    weights: np.ndarray  # features x labels
    chain: np.ndarray  # log potentials of neighbouring labels
    skip: np.ndarray  # log potentials of labels joined by a skip edge

    @classmethod
    def fit(cls, features: list[list[int]], labels: np.ndarray, links: list[tuple[int, int, bool]], learnt: np.ndarray, epochs: int = 80) -> SkipChainField:
        """Weights of all three kinds at once, by AdaGrad on the pseudo-likelihood of the nodes in ``learnt``."""
        n, k = len(labels), len(KINDS) + 1
        w, chain, prior = np.zeros((FEATURES, k)), np.zeros((k, k)), np.diag([0.0] + [AGREEMENT] * (k - 1))
        skip = prior.copy()
        if not learnt.any():
            return cls(w, chain, skip)
        y = np.eye(k)[labels]
        left, right, far = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
        for a, b, is_far in links:
            if is_far:
                far[a] += y[b]
                far[b] += y[a]
            else:
                left[b] += y[a]
                right[a] += y[b]
        rows, cols = np.repeat(np.arange(n), [len(f) for f in features]), np.fromiter((c for f in features for c in f), np.int64)
        squares = [np.full(x.shape, 1e-6) for x in (w, chain, skip)]
        for _ in range(epochs):
            z = left @ chain + right @ chain.T + far @ skip
            np.add.at(z, rows, w[cols])
            p = np.exp(z - z.max(axis=1, keepdims=True))
            off = (p / p.sum(axis=1, keepdims=True) - y) * learnt[:, None] / learnt.sum()
            by_feature = np.zeros_like(w)
            np.add.at(by_feature, cols, off[rows])
            far_off = far.T @ off
            for x, middle, grad, square in zip((w, chain, skip), (0.0, 0.0, prior), (by_feature, left.T @ off + off.T @ right, far_off + far_off.T), squares):
                grad = grad + 1e-5 * (x - middle)
                square += grad**2
                x -= 0.3 * grad / np.sqrt(square)
        return cls(w, chain, skip)

    def marginals(self, features: list[list[int]], links: list[tuple[int, int, bool]], evidence: list[int] | None = None, rounds: int = ROUNDS) -> np.ndarray:
        """Label beliefs once damped sum-product messages along all edges, both ways at once, have settled.

        ``evidence`` holds the known label of a node, 0 where it is unknown.
        """
        node = np.array([self.weights[f].sum(axis=0) for f in features])
        for i, label in enumerate(evidence or []):
            if label:
                node[i] = 0.0
                node[i, label] = EVIDENCE
        if links:
            a, b, far = (np.array(x) for x in zip(*links))
            pair = np.where(far[:, None, None], self.skip, self.chain)
            source, target = np.concatenate((a, b)), np.concatenate((b, a))
            pair = np.concatenate((pair, pair.transpose(0, 2, 1)))
            back = np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
            m = np.zeros((len(source), node.shape[1]))
            for _ in range(rounds):
                belief = node.copy()
                np.add.at(belief, target, m)
                x = (belief[source] - m[back])[:, :, None] + pair
                top = x.max(axis=1)
                new = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
                new = 0.5 * m + 0.5 * (new - new.max(axis=1, keepdims=True))
                change, m = np.abs(new - m).max(), new
                if change < SETTLED:
                    break
            np.add.at(node, target, m)
        p = np.exp(node - node.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _links(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, bool]]:
    near = [(i, i + 1, False) for i in range(len(spans) - 1) if spans[i + 1][0] - spans[i][1] <= 40]
    return near + [(a, b, True) for a, b in _skips(text, spans)]


def _example(text: str) -> tuple[list[list[int]], list[int], list[bool], list[tuple[int, int, bool]]]:
    """Features, labels, which nodes are learnt, and links of one document for the fit."""
    spans = tokens(text)
    labels, links = _gold(spans, base_spans(text)), _links(text, spans)
    features = [context if zlib.crc32(f"{i} {text[s:e]}".encode("utf-8", "replace")) % 2 else own + context for i, ((s, e), (own, context)) in enumerate(zip(spans, _features(text, spans)))]
    of_kind: dict[str, bool] = {}
    for (s, e), y in zip(spans, labels):
        for key in _likes(text[s:e]):
            of_kind[key] = of_kind.get(key, False) or y > 0
    learnt = [y > 0 or not any(of_kind[key] for key in _likes(text[s:e])) for (s, e), y in zip(spans, labels)]
    return features, labels, learnt, links


def fit(docs: DataFrame, text_col: str = "text", max_sample: int = MAX_SAMPLE, max_chars: int = MAX_SAMPLE_CHARS) -> SkipChainField:
    """The field, learnt from the base spans of at most ``max_sample`` whole documents of at most ``max_chars`` characters.

    They are chosen by a hash of their text; nulls, empty texts and repeats teach nothing.
    """
    seen = F.coalesce(F.col(text_col), F.lit(""))
    sample = docs.select(seen.alias("text")).where(F.col("text").rlike("[0-9@]") & (F.char_length("text") <= max_chars)).select("text", F.xxhash64("text").alias("h"))
    chosen = sample.select("h").distinct().orderBy("h").limit(max_sample)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_example(t) for t in batch.column(0).to_pylist()]
            flat = [[x for link in f[3] for x in map(int, link)] for f in found]
            kinds = (pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(([f[0] for f in found], [f[1] for f in found], [f[2] for f in found], flat), kinds)], ["features", "labels", "learnt", "links"])

    rows = sample.join(F.broadcast(chosen), "h").dropDuplicates(["h"]).orderBy("h").select("text").mapInArrow(learn, "features array<array<int>>, labels array<int>, learnt array<boolean>, links array<int>").collect()
    features, labels, learnt, links = [], [], [], []
    for r in rows:
        flat = np.array(r["links"], np.int64).reshape(-1, 3) + [len(labels), len(labels), 0]
        links += [(a, b, bool(far)) for a, b, far in flat.tolist()]
        features += r["features"]
        labels += r["labels"]
        learnt += r["learnt"]
    return SkipChainField.fit(features, np.array(labels, np.int64), links, np.array(learnt, bool))


def spans_of(text: str, field: SkipChainField) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    found = tokens(text) if base else []  # without a base span no token has a like of a kind
    links = _links(text, found)
    if not any(far for *_, far in links):
        return base, base
    known = _gold(found, base)
    p = field.marginals([own + context for own, context in _features(text, found)], links, known)
    label, sure = p.argmax(axis=1).tolist(), (p.max(axis=1) >= SURE).tolist()
    root = list(range(len(found)))

    def like(i: int) -> int:
        """One token of all those that skip edges join to this one."""
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a, b, far in links:
        if far:
            root[like(b)] = like(a)
    backed = {(like(i), k) for i, k in enumerate(known) if k}
    taken = sorted((s, e) for _, s, e in base)
    added: list[tuple[str, int, int]] = []
    run: list[int] = []
    at = 0

    def close() -> None:
        if any((like(i), label[i]) in backed for i in run):
            added.append((KINDS[label[run[0]] - 1], found[run[0]][0], found[run[-1]][1]))
        run.clear()

    for i, (s, e) in enumerate(found):
        while at < len(taken) and taken[at][1] <= s and (at + 1 == len(taken) or taken[at + 1][0] <= s):
            at += 1
        clear = not any(bs < e and s < be for bs, be in taken[max(0, at - 4) : at + 4])
        if run and not (label[i] == label[run[0]] and sure[i] and clear and s - found[run[-1]][1] <= 3):
            close()
        if label[i] and sure[i] and clear and e > s and not known[i]:
            run.append(i)
    if run:
        close()
    return base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def find_personal_data(docs: DataFrame, field: SkipChainField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, spans)``: arrays of ``struct(kind, start, end)`` in code points for every row.

    Null and empty texts have no spans; a null id is kept; repeated rows come out once each; texts are
    read whole; an empty table gives an empty one. Other columns are not read.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        for batch in batches:
            both = [spans_of(t, field) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([as_rows(b) for b, _ in both], kind), pa.array([as_rows(a) for _, a in both], kind)], ["doc_id", "base", "spans"])

    span = "array<struct<kind:string,start:long,end:long>>"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, base {span}, spans {span}")


def redact(docs: DataFrame, field: SkipChainField, text_col: str = "text", only: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """``docs`` with every found span of its text replaced by its kind in angle brackets; all else unchanged."""

    return docs.withColumn(text_col, _redactor(field, only)(F.col(text_col)))


def _redactor(field: SkipChainField, only: tuple[str, ...]):
    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else mask(t, [x for x in spans_of(t, field)[1] if x[0] in only]))

    return masked


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with the spans replaced; where spans overlap, the earliest and longest gives the name."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{k}>"]
        at = max(at, e)
    return "".join(out) + text[at:]
