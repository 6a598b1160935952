"""Implausible readings in OHLCV series: a hidden Markov model per source, with hard bounds.

Each series is a chain of four hidden states: normal, spike, stuck and out of range.  A reading is told by
its move against both neighbours in the source's own normal moves (the exact median move of its ticker), by
whether it repeats a neighbour, and by hard bounds.  The transitions of each source are trained: one pass of
Baum-Welch over all its series, from common ones.  Forward-backward then gives each position's probability of
every state; a position that is more probably than not abnormal is flagged with its likeliest state.  Where
the data contract has exact rules for a kind, these confirm the flags and name it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwether.operators.quantile import exact_median
from bellwether.session import join_counted

FIELDS = ("open", "high", "low", "close", "volume")
STATES = ("normal", "spike", "stuck", "impossible")
#: A run of at least this many equal closes or volumes is stuck.
STUCK_RUN = 6
#: A spike moves more than this many normal moves from both neighbours.
SPIKE_MOVES = 8.0
#: Common transitions, from normal, spike, stuck, impossible; the training of a source begins with them, they
#: count as so many of its transitions, and none becomes less probable than LEAST.
TRANSITIONS = np.array([[0.97, 0.01, 0.01, 0.01], [0.88, 0.10, 0.01, 0.01], [0.10, 0.01, 0.88, 0.01], [0.78, 0.01, 0.01, 0.20]])
PRIOR, LEAST = 200.0, 0.005
#: Emissions.  A normal reading moves against both neighbours with a chance that halves with each normal move;
#: a spike by any number of normal moves from SPIKE_LEAST on, twice as far half as often.
SPIKE_LEAST, SPIKE_NONE = 4.0, 1e-3
#: The chance that one more reading repeats its neighbour's close or volume, if normal, and that a reading of a
#: stuck series does.  A reading is told by the whole run it lies in.
REPEATS_NORMAL, REPEATS_STUCK = 0.03, 0.98
#: The chance that a reading within the hard bounds is out of range, and that one outside them is not.
OUTSIDE = 1e-9

SCHEMA = "record_id bigint, series string, pos bigint, state string, kind string, p_abnormal double"


def runs(x: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Length of the run of equal valid values each position lies in; rows are series."""
    n, t = x.shape
    same = np.zeros((n, t), bool)
    same[:, 1:] = (x[:, 1:] == x[:, :-1]) & ok[:, 1:] & ok[:, :-1]
    left = np.zeros((n, t), np.int64)
    right = np.zeros((n, t), np.int64)
    for j in range(1, t):
        left[:, j] = np.where(same[:, j], left[:, j - 1] + 1, 0)
    for j in range(t - 2, -1, -1):
        right[:, j] = np.where(same[:, j + 1], right[:, j + 1] + 1, 0)
    return (left + right + 1) * ok


def moves(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The smaller of a reading's two moves to its neighbours, in normal moves, where it lies to the
    same side of both and both are positive; else 0.  A scale of 0 makes any such move infinite."""
    z = np.zeros_like(x)
    if x.shape[1] < 3:
        return z
    prev, here, nxt = x[:, :-2], x[:, 1:-1], x[:, 2:]
    with np.errstate(all="ignore"):
        near = ((here > prev) & (here > nxt)) | ((here < prev) & (here < nxt))
        ok = near & (prev > 0) & (nxt > 0)
        least = np.minimum(np.abs(here / prev - 1), np.abs(here / nxt - 1))
        inner = np.where(ok, np.where(scale[:, None] > 0, least / scale[:, None], np.where(least > 0, np.inf, 0.0)), 0.0)
    z[:, 1:-1] = np.where(np.isnan(scale)[:, None], 0.0, inner)
    return z


def posterior(score: np.ndarray, valid: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward with each series' own transitions (series × 4 × 4): (probabilities of the states,
    expected number of each transition in each series)."""
    n, t, s = score.shape
    score = np.where(valid[:, :, None], score, 1.0)
    forward = np.empty_like(score)
    f = transitions[:, 0] * score[:, 0]
    forward[:, 0] = f / f.sum(1, keepdims=True)
    for j in range(1, t):
        f = np.einsum("ni,nij->nj", forward[:, j - 1], transitions) * score[:, j]
        forward[:, j] = f / f.sum(1, keepdims=True)
    b = np.ones((n, s))
    out = np.empty_like(score)
    out[:, -1] = forward[:, -1]
    steps = np.zeros((n, s, s))
    for j in range(t - 2, -1, -1):
        step = forward[:, j, :, None] * transitions * (score[:, j + 1] * b)[:, None, :]
        steps += step / step.sum((1, 2), keepdims=True)
        b = np.einsum("nij,nj->ni", transitions, score[:, j + 1] * b)
        b /= b.sum(1, keepdims=True)
        p = forward[:, j] * b
        out[:, j] = p / p.sum(1, keepdims=True)
    return out, steps


class Readings:
    """Series of one length: what the model and the rules see of them.  NaN is a missing reading."""

    def __init__(self, x: dict[str, np.ndarray], scale: np.ndarray):
        o, h, lo, c, v = (x[f] for f in FIELDS)
        with np.errstate(invalid="ignore"):
            self.bad = (o <= 0) | (h <= 0) | (lo <= 0) | (c <= 0) | (v < 0) | (h < lo) | (o > h) | (o < lo) | (c > h) | (c < lo)
        self.run = np.maximum(runs(c, ~np.isnan(c)), runs(v, ~np.isnan(v)))
        self.z = np.max([moves(x[f], scale) for f in FIELDS[:4]], axis=0)
        self.valid = ~np.all([np.isnan(x[f]) for f in FIELDS], axis=0)

    def scores(self) -> np.ndarray:
        """The chance of each reading in each state."""
        z = np.clip(self.z, 0, 40)
        score = np.empty((*z.shape, 4))
        score[:, :, 0] = 2 * np.log(2) * np.exp2(-2 * z)
        score[:, :, 1] = np.where(z > SPIKE_LEAST, SPIKE_LEAST / np.maximum(z, SPIKE_LEAST) ** 2, SPIKE_NONE)
        score[:, :, 2] = score[:, :, 0]
        score[:, :, 3] = 1.0
        run = np.clip(self.run, 1, 20)
        by_chance = np.where(run > 1, REPEATS_NORMAL ** (run - 1.0), 1 - REPEATS_NORMAL)
        stuck = np.where(run > 1, REPEATS_STUCK, 1 - REPEATS_STUCK)
        score *= np.stack([by_chance, by_chance, stuck, by_chance], 2)
        return score * np.where(self.bad[:, :, None], [OUTSIDE, OUTSIDE, OUTSIDE, 1.0], [1.0, 1.0, 1.0, OUTSIDE])

    def ruled(self) -> np.ndarray:
        """The kind the exact rules name, or 0."""
        return np.where(self.bad, 3, np.where(self.run >= STUCK_RUN, 2, np.where(self.z > SPIKE_MOVES, 1, 0)))


def padded(lists: list, width: int) -> np.ndarray:
    out = np.full((len(lists), width), np.nan)
    for i, values in enumerate(lists):
        if values:
            out[i, : len(values)] = [np.nan if y is None else y for y in values]
    return out


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Readings]]:
    """(rows of the batch, their readings); series of like length together, so that a long one costs no others."""
    scales = batch.column("scale").to_pylist()
    lists = {f: batch.column(f).to_pylist() for f in FIELDS}
    width = np.array([max(len(lists[f][i] or ()) for f in FIELDS) for i in range(len(scales))], dtype=int)
    for size in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == size)
        x = {f: padded([lists[f][i] for i in rows], int(size)) for f in FIELDS}
        yield rows, Readings(x, np.array([np.nan if scales[i] is None else scales[i] for i in rows]))


_STEPS = [f"t{i}{j}" for i in range(4) for j in range(4)]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column("ticker")
        for rows, readings in _by_length(batch):
            _, steps = posterior(readings.scores(), readings.valid, np.broadcast_to(TRANSITIONS, (len(rows), 4, 4)))
            flat = steps.reshape(len(rows), 16)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(rows)), *(pa.array(flat[:, k]) for k in range(16))], names=["ticker", *_STEPS])


def _flag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, names = batch.column("record_id"), batch.column("series")
        trained = batch.column("transitions").to_pylist()
        for rows, readings in _by_length(batch):
            own = np.array([TRANSITIONS.ravel() if trained[i] is None else trained[i] for i in rows]).reshape(len(rows), 4, 4)
            p, _ = posterior(readings.scores(), readings.valid, own)
            abnormal = 1 - p[:, :, 0]
            r, pos = np.nonzero((abnormal >= 0.5) & readings.valid)
            if len(r):
                state, kind = p[r, pos, 1:].argmax(1) + 1, readings.ruled()[r, pos]
                at = pa.array(rows[r])
                arrays = [ids.take(at), names.take(at), pa.array(pos, pa.int64()), pa.array([STATES[k] for k in state]), pa.array([STATES[k] if k else None for k in kind], pa.string()), pa.array(abnormal[r, pos])]
                yield pa.RecordBatch.from_arrays(arrays, names=["record_id", "series", "pos", "state", "kind", "p_abnormal"])


def long_series(docs: DataFrame, series: tuple[str, ...] = ("stock_data", "future_stock_data")) -> DataFrame:
    """One row per (record, series) with its five arrays."""
    each = [F.struct(F.lit(s).alias("series"), *(F.col(s)[f].alias(f) for f in FIELDS)) for s in series]
    return docs.select("record_id", "ticker", F.explode(F.array(*each)).alias("s")).select("record_id", "ticker", "s.*")


def normal_moves(long: DataFrame) -> DataFrame:
    """(ticker, scale): the exact median of |close[i] / close[i-1] − 1| over all series of a ticker."""
    pairs = F.expr("transform(filter(sequence(1, size(close) - 1), i -> close[i - 1] <> 0), i -> abs(close[i] / close[i - 1] - 1))")
    m = long.where("size(close) > 1").select("ticker", F.explode(pairs).alias("move")).where("not isnan(move)")
    return exact_median(m, "ticker", "move", "scale")


def trained_transitions(scaled: DataFrame) -> DataFrame:
    """(ticker, transitions): the chances of each source's transitions, 16 numbers by row, after one pass of
    Baum-Welch over all its series.  Counts are summed by series and task before the shuffle."""
    counts = scaled.where("ticker is not null").select("ticker", "scale", *FIELDS).mapInArrow(_count_batches, "ticker string, " + ", ".join(f"{c} double" for c in _STEPS))
    sums = counts.groupBy("ticker").agg(*(F.sum(c).alias(c) for c in _STEPS))
    rows = []
    for i in range(4):
        each = [F.col(f"t{i}{j}") + float(PRIOR * TRANSITIONS[i, j]) for j in range(4)]
        # No more digits than the order of the sums leaves certain.
        rows += [F.greatest(F.lit(LEAST), F.round(e / (each[0] + each[1] + each[2] + each[3]), 6)) for e in each]
    return sums.select("ticker", F.array(*rows).alias("transitions"))


def flag_readings(docs: DataFrame, series: tuple[str, ...] = ("stock_data", "future_stock_data")) -> DataFrame:
    """Flagged readings: (record_id, series, pos, state, kind, p_abnormal), one row per position that is more
    probably abnormal than normal.  ``state`` is the model's; ``kind`` what the exact rules name, null where
    only the model flags.

    ``docs`` needs record_id, ticker and the series structs; other columns are ignored.  Null structs,
    null or empty arrays give no rows; arrays of unequal length are read up to the longest, missing
    readings are unknown and break runs.  A null ticker, or one without a move, has no normal move and
    hence no spikes, and the common transitions.  Repeated records are judged each on its own."""
    long = long_series(docs, series)
    scaled = join_counted(long, normal_moves(long), "ticker", "left")
    own = join_counted(scaled, trained_transitions(scaled), "ticker", "left")
    return own.select("record_id", "series", "scale", "transitions", *FIELDS).mapInArrow(_flag_batches, SCHEMA)
