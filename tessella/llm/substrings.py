"""Repeated-substring removal by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if it lies in a string of ``least`` bytes that also starts in a document with a smaller
id. Documents are dealt into groups by id and text, and put in order there by both, as Spark hands the
rows of a group over in any order and a group is read twice. Every window of ``least`` bytes is named by
the least hash of the k-mers in it, so equal windows have equal names wherever they occur:

1. Each group sends the distinct names of its windows, as sorted binary blocks, to name buckets; a
   name that two documents share goes back to the groups that have it. All other windows are unique.
2. Each group cuts its shared windows into maximal runs of one name and sends the distinct
   strings of these runs, with the smallest id of each, to buckets of that name.
3. A bucket keeps each distinct string once. It sorts the suffixes of a bounded amount of them at a time
   (strings of one name stay together; a name with more is cut anew by names of longer k-mers, at last by
   the windows themselves) and starts from the interval of the empty string.
   Breadth-first backward extension splits the intervals of c + w by those of w, which yields the
   common-prefix boundaries in increasing order; it stops at ``least``. Windows left together in an
   interval are equal, and the smallest id in the interval is sent back for each.
4. Each group marks the bytes of windows whose smallest id is below the document's own.

Copies within a group collapse before every shuffle, so a passage that very many documents share
costs one entry per group, which a bucket keeps as two numbers. Blocks of bytes, not rows per position,
are shuffled.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches, fresh_path, parts_for, trim_memory, write_and_forget

LEAST = 50
NAME_K = 20
FINER_K = {20: 36, 36: LEAST}  # names of a share of the strings that is too large to sort at once
GROUP_BYTES = 8_000_000  # of text in a group of documents
NAME_BYTES, ROUTE_BYTES = 4_000_000, 6_000_000  # of text whose names, or strings, share a bucket
BUFFER = 1 << 17
CHUNK = 700_000  # bytes of strings that are sorted together
LEADING, PACKED = 5, 21  # bytes of the first sort key; bits of a rank or place in a packed one
NO_ID = np.iinfo(np.int64).max  # a null id counts as larger than any other
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _kmer_hash(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-mer (k >= 8), from its bytes alone."""
    n = len(data) - k + 1
    words = np.ascontiguousarray(np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,)))
    h = words[:n] * _MIX[0]
    for i, at in enumerate(sorted({*range(8, k - 7, 8), k - 8} - {0})):
        h ^= h >> np.uint64(31)
        h += words[at : at + n]
        h *= _MIX[1 + i % 2]
    h ^= h >> np.uint64(32)
    h *= _MIX[3]
    h ^= h >> np.uint64(29)
    return h


def window_names(data: np.ndarray, k: int, least: int = LEAST) -> np.ndarray:
    """The least k-mer hash in each window of ``least`` bytes, times an odd number, as least hashes are small."""
    m, size, width = _kmer_hash(data, k), 1, least - k + 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return (np.minimum(m[: len(m) - (width - size)], m[width - size :]) if size < width else m) * _MIX[2]


def _buffers(texts: list[bytes], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined bytes of about ``BUFFER``, and of each window inside one document: place, document, start.

    A very long document is cut into overlapping parts, so no window is lost.
    """
    held, size = [], 0

    def joined():
        data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        lengths = np.array([len(p) for _, _, p in held])
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        windows = lengths - least + 1
        within = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        return data, np.repeat(first, windows) + within, np.repeat(np.array([d for d, _, _ in held]), windows), np.repeat(np.array([s for _, s, _ in held]), windows) + within

    for d, text in enumerate(texts):
        for s in range(0, max(0, len(text) - least + 1), BUFFER):
            part = text[s : s + BUFFER + least - 1]
            held.append((d, s, part))
            size += len(part)
            if size >= BUFFER:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _packed(data: bytes) -> bytes:
    """Compressed, behind the length."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _breaks(*columns: np.ndarray) -> np.ndarray:
    """First place of each run of equal entries in all columns."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    change = np.zeros(len(columns[0]), bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _leading(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The first ``LEADING`` bytes of each suffix as a number, zeros behind the string's end."""
    out = np.zeros(len(text), np.int64)
    for i in range(LEADING):
        out <<= 8
        if i < len(text):
            out[: len(text) - i] |= np.where(left[: len(text) - i] > i, text[i:], 0)
    return out


def _ranked(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by (high, low), and dense ranks with one more at the end; rank 0 is (0, 0).

    Up to ``PACKED`` bits a part, key and place share one word, which sorts several times faster.
    """
    n = len(high)
    if n < 1 << PACKED and not low.any():  # the leading bytes alone
        both = np.sort(high << PACKED | np.arange(n))
        order, key = both & (1 << PACKED) - 1, both >> PACKED
    elif n < 1 << PACKED:
        both = np.sort(high << 2 * PACKED | low << PACKED | np.arange(n))
        order, key = both & (1 << PACKED) - 1, both >> PACKED
    else:
        order = np.lexsort((low, high))
        key = np.stack((high[order], low[order]), axis=1)
    new = (key[1:] != key[:-1]) if key.ndim == 1 else (key[1:] != key[:-1]).any(axis=1)
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.cumsum(np.concatenate(([bool(key[0].any())], new)))
    return order, rank


def shared_prefixes(strings: list[bytes], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of equal windows: string, offset and class of each window of ``least`` bytes, by class.

    Bytes behind a string's end count as an endless row of zeros at one common place, whose row comes
    first; only windows inside their strings are returned, so that never joins different windows.
    """
    lengths = np.array([len(s) for s in strings], np.int64)
    text = np.frombuffer(b"".join(strings), np.uint8)
    n = len(text)
    ends = np.repeat(np.cumsum(lengths), lengths)
    left = ends - np.arange(n)  # bytes up to the string's end
    end = n  # this place stands for everything behind an end
    place = np.arange(n)
    order, rank = _ranked(_leading(text, left), np.zeros(n, np.int64))
    span = LEADING
    while span < least:
        after = rank[np.where(left > span, place + span, end)]
        order, rank = _ranked(rank[:n], after)
        span *= 2
    order = np.concatenate(([end], order)).astype(np.int32)  # suffix array
    row = np.empty(n + 1, np.int32)
    row[order] = np.arange(n + 1, dtype=np.int32)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    extends = np.ones(n + 1, bool)  # whether a byte stands before the suffix
    extends[starts], extends[end] = False, False
    symbol = np.append(text, 0)[order]
    before = np.where(extends[order], np.append(0, text)[order], 0).astype(np.uint8)  # the transform
    can = extends[order]
    backward = row[order - 1]  # the row of the suffix that is one byte longer
    last = left == 1  # these are extended from the row behind the ends
    # level 1: intervals of single bytes
    cut = np.zeros(n + 2, bool)
    cut[[0, n + 1]] = True
    fresh = np.flatnonzero(np.concatenate(([False], symbol[1:] != symbol[:-1])))
    tails = np.flatnonzero(last)
    for level in range(1, least):
        if not len(fresh):
            break
        bounds = np.flatnonzero(cut)
        parent = np.searchsorted(bounds, fresh, side="right") - 1
        parent = parent[_breaks(parent)]
        lo, hi = bounds[parent], bounds[parent + 1]
        cut[fresh] = True
        size = hi - lo
        rows = np.repeat((lo - np.cumsum(size) + size).astype(np.int32), size)  # of all intervals just split
        rows += np.arange(len(rows), dtype=np.int32)
        family = np.repeat(np.arange(len(lo), dtype=np.int32), size)
        child = np.cumsum(cut[rows], dtype=np.int32)
        keep = can[rows]
        if lo[0] == 0 and len(tails):  # the row behind the ends stands before every string's last byte
            rows, family, child = (np.concatenate(x) for x in ((np.full(len(tails), -1, np.int32), rows[keep]), (np.zeros(len(tails), np.int32), family[keep]), (np.full(len(tails), child[0]), child[keep])))
            letter, image = np.concatenate((text[tails], before[rows[len(tails) :]])), np.concatenate((row[tails], backward[rows[len(tails) :]]))
        else:
            rows, family, child = rows[keep], family[keep], child[keep]
            letter, image = before[rows], backward[rows]
        by = np.argsort(letter, kind="stable")
        letter, family, child, image = letter[by], family[by], child[by], image[by]
        run = _breaks(letter, family, child)
        lowest = np.minimum.reduceat(image, run).astype(np.int64) if len(run) else np.empty(0, np.int64)
        letter, family = letter[run], family[run]
        fresh = lowest[1:][(letter[1:] == letter[:-1]) & (family[1:] == family[:-1])]
        fresh = np.sort(fresh[~cut[fresh]])
    cut[fresh] = True
    group = np.cumsum(cut[: n + 1])
    at = order[1:].astype(np.int64)
    ok = left[at] >= least
    at, group = at[ok], group[1:][ok]
    string = np.searchsorted(np.cumsum(lengths), at, side="right")
    return string, at - starts[string], group


def smallest_ids(strings: list[bytes], ids: np.ndarray, least: int = LEAST) -> list[np.ndarray]:
    """For each string, the smallest id over all equal windows, for each of its windows."""
    string, offset, group = shared_prefixes(strings, least)
    first = _breaks(group)
    low = np.minimum.reduceat(ids[string], first) if len(first) else np.empty(0, np.int64)
    windows = np.array([len(s) - least + 1 for s in strings])
    begin = np.concatenate(([0], np.cumsum(windows)))
    out = np.empty(begin[-1], np.int64)
    out[begin[string] + offset] = np.repeat(low, np.diff(np.append(first, len(group))))
    return np.split(out, begin[1:-1])


def runs_of(texts: list[bytes], k: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """Per buffer, of the runs of windows of one text that share a name: name, text, start, place and number of windows; and the buffer's bytes."""
    for data, place, doc, start in _buffers(texts, least):
        name = window_names(data, k, least)[place] >> np.uint64(1)
        run = _breaks(name, doc)
        count = np.diff(np.append(run, len(name)))
        more = -(-count // 64)  # a name may stay for long in text that repeats itself
        run = np.repeat(run, more) + 64 * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more))
        yield name[run], doc[run], start[run], place[run], np.diff(np.append(run, len(name))), data.tobytes()


def bounded_smallest_ids(strings: list[bytes], ids: np.ndarray, names: np.ndarray, least: int = LEAST, k: int = NAME_K, chunk: int = CHUNK) -> list[np.ndarray]:
    """``smallest_ids`` of distinct strings, sorted about ``chunk`` bytes at a time; equal windows must have equal names."""
    answer: list = [None] * len(strings)
    order = np.argsort(names, kind="stable")
    first = _breaks(names[order])
    amount = np.add.reduceat(np.array([len(strings[i]) for i in order.tolist()], np.int64), first) if len(first) else np.empty(0, np.int64)
    part: list[np.ndarray] = []
    size = 0

    def solve(chosen: np.ndarray) -> None:
        for i, v in zip(chosen.tolist(), smallest_ids([strings[i] for i in chosen.tolist()], ids[chosen], least)):
            answer[i] = v

    for members, n in zip(np.split(order, first[1:]), amount.tolist()):
        if n > 2 * chunk and len(members) > 1 and k < least:  # one name with too much: cut anew
            for i, v in zip(members.tolist(), _cut_anew([strings[i] for i in members.tolist()], ids[members], least, min(FINER_K[k], least), chunk)):
                answer[i] = v
            continue
        part.append(members)
        size += n
        if size >= chunk:
            solve(np.concatenate(part))
            part, size = [], 0
    if part:
        solve(np.concatenate(part))
    return answer


def _cut_anew(strings: list[bytes], ids: np.ndarray, least: int, k: int, chunk: int) -> list[np.ndarray]:
    number: dict[bytes, int] = {}
    names, low, at = [], [], []
    for name, doc, start, place, count, raw in runs_of(strings, k, least):
        for r, d, s, p, c in zip(name.tolist(), doc.tolist(), start.tolist(), place.tolist(), count.tolist()):
            x = raw[p : p + c + least - 1]
            i = number.setdefault(x, len(number))
            if i == len(names):
                names.append(r)
                low.append(ids[d])
            elif ids[d] < low[i]:
                low[i] = ids[d]
            at.append((d, s, i))
    found = bounded_smallest_ids(list(number), np.array(low, np.int64), np.array(names, np.uint64), least, k, chunk)
    out = [np.empty(len(x) - least + 1, np.int64) for x in strings]
    for d, s, i in at:
        out[d][s : s + len(found[i])] = found[i]
    return out


def in_order(table: pa.Table) -> tuple[pa.Table, np.ndarray, list[bytes]]:
    """A group's rows by id (nulls last) and text, whatever order they came in; rows equal in both are interchangeable."""
    ids = [NO_ID if i is None else i for i in table.column("doc_id").to_pylist()]
    texts = [t.encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return table.take(pa.array(order, pa.int64())), np.array([ids[i] for i in order], np.int64), [texts[i] for i in order]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_bytes, kept, spans)``: remaining bytes, and the removed runs as ``struct(start, end)``.

    Null and empty texts have no bytes; texts below ``least`` bytes stay; rows with equal ids never
    remove each other's bytes; a null id counts as larger than any other; an empty table gives an empty
    one; very long texts are worked on in overlapping parts. Of the other columns only those named in
    ``carry`` are read, and returned beside the rest.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(f"carried_{c}") for c in carry))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    groups = parts_for(total, GROUP_BYTES, 8)
    name_buckets, buckets = parts_for(total, NAME_BYTES, 8), parts_for(total, ROUTE_BYTES, 8)
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("gid"), "*").repartition(groups, "gid")

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        seen = 0
        for batch in batches:
            gid = batch.column(0).to_numpy()
            for g in np.unique(gid).tolist():
                texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).filter(pa.array(gid == g)).to_pylist()]
                for data, place, doc, _ in _buffers(texts, least):
                    name = window_names(data, NAME_K, least)[place]
                    first = _breaks(name, doc)
                    held.setdefault(g, []).append((name[first], (doc[first] + seen).astype(np.uint32)))
                seen += len(texts)
                del texts
        for g in list(held):
            name, doc = (np.concatenate(x) for x in zip(*held.pop(g)))
            name >>= np.uint64(1)
            order = np.argsort(name, kind="stable")
            name, doc = name[order], doc[order]
            first = _breaks(name)
            several = np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)
            sent = name[first] << np.uint64(1) | several.astype(np.uint64)
            bucket = ((sent >> np.uint64(32)) * np.uint64(name_buckets) >> np.uint64(32)).astype(np.int32)  # rises with the name
            edge = _breaks(bucket)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edge]), pa.array([g] * len(edge), pa.int32()), pa.array([b.tobytes() for b in np.split(sent, edge[1:])[: len(edge)]], pa.binary())], ["bucket", "gid", "block"])
        trim_memory()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for b, g, block in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(b, []).append((g, np.frombuffer(block, np.uint64)))
        for b in list(held):
            parts = held.pop(b)
            name = np.concatenate([x for _, x in parts])
            group = np.repeat([g for g, _ in parts], [len(x) for _, x in parts])
            order = np.argsort(name, kind="stable")
            name, group = name[order], group[order]
            bare = name >> np.uint64(1)
            first = _breaks(bare)
            size = np.diff(np.append(first, len(bare)))
            twice = (size > 1) | (np.maximum.reduceat(name, first) & np.uint64(1)).astype(bool) if len(first) else np.empty(0, bool)
            hit = np.repeat(twice, size)
            bare, group = bare[hit], group[hit]
            out = [(g, np.unique(bare[group == g]).tobytes()) for g in np.unique(group).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["gid", "block"])

    def strings(left: pa.Table, right: pa.Table) -> pa.Table:
        """Row per bucket: strings, their lengths, route names and smallest ids; and one row of the group's own occurrences."""
        if not left.num_rows or not right.num_rows:
            return pa.table({k: pa.array([], t) for k, t in _MESSAGE.items()})
        gid = left.column("gid")[0].as_py()
        _, ids, texts = in_order(left)
        known = np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in right.column("block").to_pylist()]))
        number: dict[bytes, int] = {}
        route, low, occurrences = [], [], array("q")
        for name, doc, start, place, count, raw in runs_of(texts, NAME_K, least):
            hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, name), len(known) - 1)] == name)
            for p, c, r, d, s in zip(*(x[hit].tolist() for x in (place, count, name, doc, start))):
                x = raw[p : p + c + least - 1]
                k = number.get(x)
                if k is None:
                    k = number[x] = len(route)
                    route.append(r)
                    low.append(ids[d])
                elif ids[d] < low[k]:
                    low[k] = ids[d]
                occurrences.extend((d, s, k))
        ways, lows, all_strings = np.array(route, np.uint64), np.array(low, np.int64), list(number)
        bucket = (ways % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((ways, bucket))
        new = np.empty(len(order), np.int64)
        new[order] = np.arange(len(order))
        first = _breaks(bucket[order])
        out = {k: [] for k in _MESSAGE}
        for b, part in zip(bucket[order][first].tolist(), np.split(order, first[1:])):
            chosen = [all_strings[i] for i in part.tolist()]
            for k, v in zip(_MESSAGE, (b, gid, _packed(b"".join(chosen)), np.array([len(c) for c in chosen], np.uint16).tobytes(), (ways[part] >> np.uint64(31)).astype(np.uint32).tobytes(), _packed(lows[part].tobytes()))):
                out[k].append(v)
        o = np.array(occurrences, np.int64).reshape(-1, 3)
        o[:, 2] = new[o[:, 2]]
        sizes = np.array([len(all_strings[i]) for i in order.tolist()], np.uint16)
        for k, v in zip(_MESSAGE, (-1, gid, _packed(o.tobytes()), sizes.tobytes(), np.unique(bucket).tobytes(), np.array([(bucket == b).sum() for b in np.unique(bucket)], np.int64).tobytes())):
            out[k].append(v)
        trim_memory()
        return pa.table({k: pa.array(v, _MESSAGE[k]) for k, v in out.items()})

    blocks = dealt.mapInArrow(names, "bucket int, gid int, block binary").repartition(name_buckets, "bucket")
    again = blocks.mapInArrow(shared, "gid int, block binary")
    sent = dealt.groupBy("gid").cogroup(again.groupBy("gid")).applyInArrow(strings, "bucket int, gid int, strings binary, lengths binary, ways binary, ids binary")
    messages = write_and_forget(sent, fresh_path(spark, "strings"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[dict, array, array, list]] = {}  # by bucket: strings, names, smallest ids, groups with their strings' numbers
        for batch in batches:
            for b, g, packed, sizes, ways, lows in zip(*(c.to_pylist() for c in batch.columns)):
                number, names, low, asked = held.setdefault(b, ({}, array("I"), array("q"), []))
                raw, end = _unpacked(packed), np.cumsum(np.frombuffer(sizes, np.uint16), dtype=np.int64)
                which = array("I")
                start = 0
                for stop, r, i in zip(end.tolist(), np.frombuffer(ways, np.uint32).tolist(), np.frombuffer(_unpacked(lows), np.int64).tolist()):
                    x = raw[start:stop]
                    start = stop
                    k = number.setdefault(x, len(number))
                    if k == len(names):
                        names.append(r)
                        low.append(i)
                    elif i < low[k]:
                        low[k] = i
                    which.append(k)
                asked.append((g, which))
        for b in list(held):
            number, names, low, asked = held.pop(b)
            answer = bounded_smallest_ids(list(number), np.array(low, np.int64), np.array(names, np.uint64), least, NAME_K)
            del number
            for g, which in asked:
                found = np.concatenate([answer[i] for i in which])
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([g], pa.int32()), pa.array([_packed(found.tobytes())], pa.binary())], ["bucket", "gid", "block"])
        trim_memory()

    replies = messages.where("bucket >= 0").repartition(buckets, "bucket").mapInArrow(expand, "bucket int, gid int, block binary")
    own = messages.where("bucket < 0").select("bucket", "gid", F.col("strings").alias("block"), "lengths")
    answers = replies.withColumn("lengths", F.lit(None).cast("binary")).unionByName(own)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        left, ids, texts = in_order(left)
        removed: dict[int, list] = {}
        parts = sorted((r for r in right.to_pylist()), key=lambda r: r["bucket"])
        if parts:
            o = np.frombuffer(_unpacked(parts[0]["block"]), np.int64).reshape(-1, 3)
            windows = np.frombuffer(parts[0]["lengths"], np.uint16).astype(np.int64) - least + 1
            low = np.concatenate([np.frombuffer(_unpacked(p["block"]), np.int64) for p in parts[1:]])
            begin = np.cumsum(windows) - windows
            n = windows[o[:, 2]]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            doc = np.repeat(o[:, 0], n)
            gone = low[np.repeat(begin[o[:, 2]], n) + within] < ids[doc]
            doc, start = doc[gone], (np.repeat(o[:, 1], n) + within)[gone]
            order = np.lexsort((start, doc))
            doc, start = doc[order], start[order]
            new = _breaks_far(doc, start, least)
            stop = np.append(new[1:], len(doc)) - 1
            for d, s, e in zip(doc[new].tolist(), start[new].tolist(), start[stop].tolist() if len(doc) else []):
                removed.setdefault(d, []).append((s, e + least))
        out: dict[str, list] = {"doc_id": left.column("doc_id").to_pylist(), "n_bytes": [len(t) for t in texts], "kept": [], "spans": []}
        for d, text in enumerate(texts):
            spans = removed.get(d, [])
            edges = [0, *(x for s in spans for x in s), len(text)]
            out["kept"].append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if spans else text)
            out["spans"].append([{"start": s, "end": e} for s, e in spans])
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)} | {c: left.column(f"carried_{c}") for c in carry})

    carried = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return dealt.groupBy("gid").cogroup(answers.groupBy("gid")).applyInArrow(apply, f"doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>{carried}")


_MESSAGE = {"bucket": pa.int32(), "gid": pa.int32(), "strings": pa.binary(), "lengths": pa.binary(), "ways": pa.binary(), "ids": pa.binary()}


def _breaks_far(doc: np.ndarray, start: np.ndarray, least: int) -> np.ndarray:
    """First window of each run of removed bytes: windows further than their length apart leave a gap."""
    if not len(doc):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + least))))
