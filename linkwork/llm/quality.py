"""Quality scores from compression (operator 5).

Two zstandard dictionaries are trained, one on blocks of texts labelled good and one on blocks of
texts labelled bad.  A text is compressed block by block with each; what the bad dictionary needs
more than the good one, per byte, says which class it resembles.  Platt scaling on labelled texts
that no dictionary has seen turns that normalised difference, together with the good
size per byte (repetition compresses with any dictionary), into a calibrated probability.

Bounds: dictionaries learn from at most ``dictionary_rows`` labelled rows of each class and
``blocks`` blocks of them, the scaling from at most ``scaling_rows`` rows; each is the sample
with the smallest hashes of ids.  Every text is scored whole.

Defined cases: a null text counts as empty and gets the score of an empty text; rows without a label or
with a null one are never learnt from; a null id is an ordinary row, in no fold; repeated rows are scored
alike; with no good or no bad label all scores are 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwork.llm.common import arrow_pass, utf8

#: Bytes of a block: short, so that the dictionary matters for all of a long text.
BLOCK = 2048
LEVEL = 3


@dataclass
class Model:
    """Dictionaries for good and bad text, and the scaling's weights and offset."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)


def _blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)] or [b""]


def _compressor(dictionary: bytes):
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False
    ).compress


class Sizer:
    """Normalised compressed sizes of a text under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = _compressor(good), _compressor(bad)

    def __call__(self, text: bytes) -> tuple[float, float]:
        parts = _blocks(text)
        good = sum(len(self.good(p)) for p in parts)
        bad = sum(len(self.bad(p)) for p in parts)
        return (bad - good) / (len(text) + 16), good / (len(text) + 16)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their own bytes serve
        return b"".join(samples)[-size:] or b"\n" * 8


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method, lightly penalised."""
    x = np.column_stack([x * 20, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w)), x.T @ (p - y) + 0.01 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _sample(labels: DataFrame, rows: int, skip: DataFrame | None = None) -> DataFrame:
    if skip is not None:
        labels = labels.join(F.broadcast(skip.select("doc_id")), "doc_id", "left_anti")
    return labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    dictionary_rows: int = 1500,
    blocks: int = 8000,
    scaling_rows: int = 6000,
    dictionary_bytes: int = 112640,
) -> Model:
    """Train on ``labels`` (``doc_id, quality``); only bounded samples reach the driver."""
    labels = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality").distinct()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [p for t in utf8(batch.column(0)) for p in _blocks(t) if p]
        return pa.record_batch([pa.array(parts, pa.binary())], names=["block"])

    dictionaries, used = {}, None
    for quality in (1, 0):
        chosen = _sample(labels.where(F.col("quality") == quality), dictionary_rows)
        used = chosen if used is None else used.union(chosen)
        texts = docs.join(F.broadcast(chosen), "doc_id").select("text")
        parts = arrow_pass(texts, "block binary", cut).orderBy(F.xxhash64("block"), "block").limit(blocks)
        samples = [r[0] for r in parts.collect()]
        if not samples:
            return Model(b"\n" * 8, b"\n" * 8)
        dictionaries[quality] = _dictionary([bytes(s) for s in samples], dictionary_bytes)
    good, bad = dictionaries[1], dictionaries[0]

    def sizes(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizer = Sizer(good, bad)
        got = [sizer(t) for t in utf8(batch.column(0))]
        columns = [pa.array([g[i] for g in got]) for i in (0, 1)]
        return pa.record_batch([*columns, batch.column(1)], names=["difference", "size", "quality"])

    for skip in (used, None):  # tiny tables may have no labelled row beyond the dictionaries'
        scaling = docs.join(F.broadcast(_sample(labels, scaling_rows, skip)), "doc_id")
        scaling = scaling.select("text", F.col("quality").cast("int").alias("quality"))
        rows = arrow_pass(scaling, "difference double, size double, quality int", sizes).collect()
        if len({r[2] for r in rows}) == 2:
            break
    x = np.array([[r[0], r[1]] for r in rows])
    return Model(good, bad, _platt(x, np.array([r[2] for r in rows])))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with a ``score`` from 0 to 1: the probability of good quality.

    It stands in place of the text; with ``keep_text`` the text stays, as a string ``_text``.
    """
    rest = [c for c in docs.columns if c not in (text_col, "score")]
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), *rest)
    out, first = (["_text", *rest], 0) if keep_text else (rest, 1)
    schema = rows.select(*out, F.lit(0.0).alias("score")).schema
    good, bad, weights = model.good, model.bad, model.weights

    def run(batches):
        sizer = Sizer(good, bad)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.array([sizer(t) for t in utf8(part.column(0))])
                z = 20 * (x[:, 0] * weights[0] + x[:, 1] * weights[1]) + weights[2]
                values = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.record_batch([*part.columns[first:], pa.array(values)], names=[*out, "score"])

    return rows.mapInArrow(run, schema)


def held_out(column: str = "doc_id") -> Column:
    """The fold that is never learnt from: ``crc32`` of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = fit(docs, labels.where(~held_out()))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
