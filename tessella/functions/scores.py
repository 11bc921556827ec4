"""Arithmetic over the options of a batch of responses, as matrices with a row per response; runs inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def options(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (NaN where there is none) and whether each is there, as wide as the longest list; stored by option, which are few."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column)
    values, there = flat.to_numpy(zero_copy_only=False).astype(float), flat.is_valid().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if len(flat) == len(sizes) * width:
        return np.asfortranarray(values.reshape(len(sizes), width)), np.asfortranarray(there.reshape(len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, known = np.full((len(sizes), width), np.nan, order="F"), np.zeros((len(sizes), width), bool, order="F")
    out[row, place], known[row, place] = values, there
    return out, known


def as_wide(*pairs: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Values and masks of several columns, brought to one width."""
    width = max(v.shape[1] for v, _ in pairs)
    pad = lambda a, fill: np.pad(a, ((0, 0), (0, width - a.shape[1])), constant_values=fill)
    return [pad(a, fill) for v, t in pairs for a, fill in ((v, np.nan), (t, False))]


def numbers(column: pa.Array) -> np.ndarray:
    """As doubles, NaN where missing."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def pick(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The entry ``at`` of each row, NaN outside."""
    inside = (at >= 0) & (at < values.shape[1])
    out = np.full(len(values), np.nan)
    out[inside] = values[inside, at[inside].astype(np.int64)]
    return out


def failures(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows x predicates of ``items.REASONS``, and which options are real."""
    l, has_l, h, has_h = as_wide(options(batch.column("loglik")), options(batch.column("char_lens")))  # noqa: E741
    with np.errstate(invalid="ignore"):
        real = has_h & np.isfinite(h) & (h > 0)
    gold, n = numbers(batch.column("gold")), real.sum(1)
    whole = np.isfinite(gold) & (gold == np.floor(gold)) & (gold >= 0)
    inside = whole & (pick(real.astype(float), np.where(whole, gold, -1)) == 1)
    fails = np.stack([(has_h & ~real).any(1), (~has_h & has_l).any(1), (real & ~np.isfinite(l)).any(1), ~inside, n < 2, numbers(batch.column("n_options")) != n], 1)
    absent = batch.column("loglik").is_null().to_numpy(zero_copy_only=False) | batch.column("char_lens").is_null().to_numpy(zero_copy_only=False)
    fails[absent] = True
    return fails, real


def entropy(p: np.ndarray) -> np.ndarray:
    return -(p * np.log(np.where(p > 0, p, 1.0))).sum(1)


def observed(batch: pa.RecordBatch, real: np.ndarray, values: list[str]) -> dict[str, np.ndarray]:
    """The columns ``values`` of ``items.valid_observations`` for valid responses, no others; padding is no option."""
    l, _, h, _ = as_wide(options(batch.column("loglik")), options(batch.column("char_lens")))  # noqa: E741
    real = np.asfortranarray(real[:, : l.shape[1]])
    u = np.full(l.shape, -np.inf, order="F")
    np.divide(l, h, out=u, where=real)
    rows, k, gold = np.arange(len(u)), real.sum(1), numbers(batch.column("gold")).astype(np.int64)
    place = np.arange(u.shape[1])
    ug, top, want = u[rows, gold], u.max(1), set(values)

    def scaled(v: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = np.exp(v - top[:, None])
        return raw, raw.sum(1)

    def but(v: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = v.copy(order="F")
        out[rows, at] = -np.inf
        return out

    out = {"z": top - ug}
    if want & {"c", "nll", "brier", "h", "margin"}:
        raw, size = scaled(u, top)
        p = raw / size[:, None]
        out["c"], out["nll"] = p.max(1), top + np.log(size) - ug
    if want & {"y", "e", "hn", "margin"}:
        win = np.full(len(u), -1)
        for j in range(u.shape[1] - 1, -1, -1):
            win[u[:, j] == top] = j  # the first of the best
        out["y"] = win == gold
        out["e"] = np.where(out["y"], 0.0, 1.0)
    if "ell" in want:
        rest = but(u, gold)
        rest_top = rest.max(1)
        out["ell"] = ug - (rest_top + np.log(scaled(rest, rest_top)[1]))
    if "depth" in want:
        out["depth"] = (((u > ug[:, None]) | ((u == ug[:, None]) & (place < gold[:, None]))) & real).sum(1) / (k - 1)
    if "hn" in want:
        rest = but(u, win)
        lost, lost_size = scaled(rest, rest.max(1))
        out["hn"] = np.where(k > 2, entropy(lost / lost_size[:, None]) / np.log(np.where(k > 2, k - 1, 2).astype(float)), 0.0)
    if "brier" in want:
        miss = p - (place == gold[:, None])
        out["brier"] = (miss * miss).sum(1)
    if "h" in want:
        out["h"] = entropy(p) / np.log(k.astype(float))
    if "margin" in want:
        out["margin"] = out["c"] - but(p, win).max(1)
    return {c: out[c] for c in values}


def cell_scores(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gold score, correctness and top probability of any response; NaN where a score that is needed is missing."""
    l, has_l, h, _ = as_wide(options(batch.column("loglik")), options(batch.column("char_lens")))  # noqa: E741
    gold = numbers(batch.column("gold"))
    u = l / np.fmax(h, 1.0)
    if not u.shape[1]:
        return np.full(len(u), np.nan), np.zeros(len(u)), np.full(len(u), np.nan)
    order = np.where(np.isnan(u), np.where(has_l, np.inf, -np.inf), u)  # a NaN score is above all, a missing one below
    with np.errstate(invalid="ignore"):
        raw = np.exp(u - u.max(1)[:, None])
        c = (raw / raw.sum(1)[:, None]).max(1)
    gold = np.trunc(np.where(np.isfinite(gold), gold, -1))
    return pick(l, gold), np.where(order.argmax(1) == gold, 1.0, 0.0), c
