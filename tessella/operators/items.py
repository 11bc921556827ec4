"""Projections of single responses: validity, observations, item-level error measures, cells.

Options are matrices of a batch inside tasks: as nested array functions, each column would work the scores out anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import scores
from tessella.functions.arrays import finite, gold_log_odds

REASONS = ["bad_char_length", "padding_has_loglik", "incomplete_real_loglik", "invalid_gold", "fewer_than_two_options", "n_options_disagrees"]


def validity(responses: DataFrame) -> DataFrame:
    """Adds ``reasons`` (every predicate that fails, in order) and ``valid``; a null option is padding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fails, _ = scores.failures(batch)
            ends = np.concatenate(([0], np.cumsum(fails.sum(1)))).astype(np.int32)
            named = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(REASONS, object)[np.nonzero(fails)[1]], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, named, pa.array(~fails.any(1))], [*batch.schema.names, "reasons", "valid"])

    schema = T.StructType([*responses.schema.fields, T.StructField("reasons", T.ArrayType(T.StringType())), T.StructField("valid", T.BooleanType())])
    return responses.mapInArrow(run, schema)


def reason_counts(judged: DataFrame) -> DataFrame:
    """How many rows fail each predicate; a row may fail several."""
    return judged.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


VALUES = ["ell", "c", "y", "e", "z", "nll", "depth", "hn", "brier", "h", "margin"]


def valid_observations(responses: DataFrame, values: list[str] | None = None, keep: tuple[str, ...] = (), prepare: Callable | None = None) -> DataFrame:
    """Scores per character of the valid responses and what follows from them, in one pass over batches.

    ``c`` top probability, ``y`` whether the first best option is gold, ``ell`` gold against the rest,
    ``z`` top score minus gold score, ``nll`` log-sum-exp minus gold score, ``depth`` share of options
    before gold in rank, ``hn`` normalised entropy of the options that did not win, ``brier, h, margin``.
    ``values``: those that are asked for, else all; what is not asked for is not worked out. ``keep``: columns to keep beside the keys.
    ``prepare`` makes responses of the batches inside the tasks: keys are strings then, and what is kept are flags.
    """
    keys, values = ["model_id", "org_id", "item_id", *keep], VALUES if values is None else values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if prepare is None else prepare(batches):
            fails, real = scores.failures(batch)
            good = ~fails.any(1)
            if good.any():
                valid = batch.filter(pa.array(good))
                found = scores.observed(valid, real[good], values) if values else {}
                yield pa.RecordBatch.from_arrays([*(valid.column(k) for k in keys), *(pa.array(found[c]) for c in values)], [*keys, *values])

    kinds = dict(responses.dtypes) if prepare is None else {k: "boolean" if k in keep else "string" for k in keys}
    ddl = [f"{c} {'boolean' if c == 'y' else 'double'}" for c in values]
    narrow = responses.select(*keys, "loglik", "char_lens", "gold", "n_options") if prepare is None else responses
    return narrow.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), *ddl]))


def nonfinite_loglik(responses: DataFrame) -> Column:
    """Whether one of the first ``n_options`` scores is missing or not finite."""
    return F.exists(F.slice("loglik", 1, F.col("n_options")), lambda x: ~finite(x))


def cells(responses: DataFrame) -> DataFrame:
    """Matrix cells: rounded mean and sum of the gold score, correctness and confidence, as floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gold, right, c = (pa.array(v, from_pandas=True) for v in scores.cell_scores(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("model_id", "item_id", "n_tokens")), gold, right, c], ["model_id", "item_id", "n_tokens", "gold", "bin", "conf"])

    kinds = dict(responses.dtypes)
    scored = responses.select("model_id", "item_id", "n_tokens", "loglik", "char_lens", "gold").mapInArrow(run, f"model_id {kinds['model_id']}, item_id {kinds['item_id']}, n_tokens {kinds['n_tokens']}, gold double, bin double, conf double")
    return scored.select(
        "model_id", "item_id",
        F.round(F.col("gold") / F.greatest("n_tokens", F.lit(1.0)), 6).alias("lp_mean"),
        F.round("gold", 4).alias("lp_sum"),
        "bin",
        F.round("conf", 6).alias("conf"),
    )


def response_inputs(cell_rows: DataFrame) -> DataFrame:
    """Clipped response probability and the length that the two scores imply."""
    return with_response_inputs(cell_rows).select("model_id", "item_id", "resp", "tok_len")


def with_response_inputs(cell_rows: DataFrame) -> DataFrame:
    """The same beside the cells."""
    low = 1e-6
    resp = F.least(F.greatest(F.exp("lp_mean"), F.lit(low)), F.lit(1 - low))
    return cell_rows.withColumn("resp", resp).withColumn("tok_len", F.try_divide("lp_sum", "lp_mean"))


def slope_inputs(responses: DataFrame) -> DataFrame:
    """Gold against the rest on raw scores, as the slope analysis reads it."""
    return responses.select("model_id", "item_id", gold_log_odds(F.col("loglik"), F.col("gold").cast("int")).alias("ell_raw"))
