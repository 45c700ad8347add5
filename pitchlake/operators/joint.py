"""Joint score models: weighted Poisson rates, a tilt that calibrates event cells, and a projection onto given marginals.

Fits are Newton steps. The rates' sums over all rows are added up over the tasks of one stage (``training.together``), the
tilt's are an aggregate a step; scores are grids of ``GOALS`` x ``GOALS`` chances, made for an Arrow batch at a time and never
kept: what leaves a task are four cell masses or a few market probabilities a row.

Cells: 0 neither over 2.5 goals nor both teams scoring, 1 both score only, 2 over only, 3 both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.operators.training import AllSum, task_number, together
from pitchlake.session import checkpointed

# The grid, penalties, half life, bounds, and where the projection stops.
GOALS = 41
RIDGE, HALF_LIFE = 0.3, 365.0
LEAST_RATE, MOST_RATE = 0.05, 8.0
SHRINK, MOST_TILT = 0.01, 2.0
CLOSE, STEPS, ACCEPTED = 1e-11, 1000, 1e-8
#: Rows whose grids exist at a time.
GRID_ROWS = 512

SCORES = np.arange(GOALS)
TOTAL = SCORES[:, None] + SCORES[None, :]
CELL = 2 * (TOTAL >= 3) + ((SCORES[:, None] > 0) & (SCORES[None, :] > 0))


def score_grids(rates: np.ndarray) -> np.ndarray:
    """(row, home goals, away goals): chances of two independent Poisson counts, cut off at the grid and normalised."""
    if not (np.isfinite(rates).all() and (rates > 0).all() and (rates <= MOST_RATE).all()):
        raise ValueError(f"rates must be above 0 and at most {MOST_RATE}")
    terms = np.empty((*rates.shape, GOALS))
    terms[..., 0] = np.exp(-rates)
    for k in range(1, GOALS):
        terms[..., k] = terms[..., k - 1] * rates / k
    terms /= terms.sum(axis=2, keepdims=True)
    return terms[:, 0, :, None] * terms[:, 1, None, :]


def cell_masses(grids: np.ndarray) -> np.ndarray:
    return np.stack([grids[:, CELL == i].sum(axis=1) for i in range(4)], axis=1)


def reweighted(grids: np.ndarray, masses: np.ndarray) -> np.ndarray:
    """Grids with these cell masses; chances inside a cell keep their proportions."""
    out = grids * (masses / np.maximum(cell_masses(grids), 1e-300))[:, CELL]
    return out / out.sum(axis=(1, 2), keepdims=True)


def markets(grids: np.ndarray) -> dict[str, np.ndarray]:
    over = lambda n: grids[:, TOTAL >= n].sum(axis=1)
    mean = lambda goals: (grids * goals).sum(axis=(1, 2))
    return {"over_25": over(3), "over_35": over(4), "btts": cell_masses(grids)[:, [1, 3]].sum(axis=1), "goals": mean(TOTAL), "home_rate": mean(SCORES[None, :, None]), "away_rate": mean(SCORES[None, None, :])}


def projected(masses: np.ndarray, over: np.ndarray, btts: np.ndarray) -> np.ndarray:
    """Cell masses with these two marginals and the odds ratio of ``masses``, by scaling rows and columns in turn."""
    q = masses.reshape(-1, 2, 2).copy()
    a, b = np.clip(over, 1e-8, 1 - 1e-8), np.clip(btts, 1e-8, 1 - 1e-8)
    off = lambda: np.abs(q[:, 1, :].sum(axis=1) - a)
    for _ in range(STEPS):
        q *= np.stack([1 - a, a], axis=1)[:, :, None] / q.sum(axis=2)[:, :, None]
        q *= np.stack([1 - b, b], axis=1)[:, None, :] / q.sum(axis=1)[:, None, :]
        if not len(q) or off().max() < CLOSE:
            break
    if len(q) and off().max() > ACCEPTED:
        raise ValueError("the projection did not converge")
    return q.reshape(-1, 4)


def _fit_rates(held: dict[str, np.ndarray], names: list[str], add: AllSum, first: bool, ridge: float, last_day: float) -> Iterator[tuple]:
    x, y = held["x"], held["y"]
    missing = ~np.isfinite(x)
    counts = add(np.array([len(x), *(~missing).sum(axis=0)], dtype=float))
    n, present = max(counts[0], 1), counts[1:]
    mean = add(np.where(missing, 0.0, x).sum(axis=0)) / np.maximum(present, 1)
    flagged = present < counts[0]
    full = lambda values, gaps: np.hstack([np.where(gaps, mean, values), gaps[:, flagged].astype(float)])
    wide = full(np.where(missing, 0.0, x), missing)
    centre = add(wide.sum(axis=0)) / n
    scale = np.sqrt(add(((wide - centre) ** 2).sum(axis=0)) / n)
    scale = np.where(scale < 1e-12, 1.0, scale)
    z = np.hstack([(wide - centre) / scale, np.ones((len(x), 1))])
    weight = 2.0 ** (-(last_day - held["day"]) / HALF_LIFE) if len(x) else np.zeros(0)
    mass = float(add(np.array([weight.sum()]))[0])
    if not mass:
        return
    penalty = np.append(np.full(z.shape[1] - 1, ridge), 0.0)
    betas = []
    for side in range(2):
        goals = y[:, side]
        value = lambda b: float(add(np.array([(weight * (np.exp(z @ b) - goals * (z @ b))).sum()]))[0]) / mass + (penalty * b * b).sum() / 2  # noqa: B023, E731
        beta = np.zeros(z.shape[1])
        beta[-1] = np.log(max(float(add(np.array([weight @ goals]))[0]) / mass, 1e-9))
        now = value(beta)
        for _ in range(50):
            rate = weight * np.exp(z @ beta)
            sums = add(np.vstack([(z * rate[:, None]).T @ z, z.T @ (rate - weight * goals)])) / mass
            gradient = sums[-1] + penalty * beta
            if np.abs(gradient).max() < 1e-11:
                break
            move = np.linalg.solve(sums[:-1] + np.diag(penalty + 1e-12), gradient)
            step = 1.0
            while (new := value(beta - step * move)) > now + 1e-15 and step > 1e-6:
                step /= 2
            beta, now = beta - step * move, new
        betas.append(beta)
    columns = [*names, *[f"missing {c}" for c, is_so in zip(names, flagged) if is_so], "intercept"]
    if first:
        for side, beta in zip(("home", "away"), betas):
            for name, b, c, s in zip(columns, beta, [*centre, 0.0], [*scale, 1.0]):
                yield side, name, None, [float(b), float(c), float(s)]
    rates = np.clip(np.exp(z @ np.stack(betas, axis=1)), LEAST_RATE, MOST_RATE)
    for key, row in zip(held["id"], rates):
        yield None, None, int(key), row.tolist()


RATES = pa.schema([("side", pa.string()), ("term", pa.string()), ("id", pa.int64()), ("values", pa.list_(pa.float64()))])


def fit_rates(rows: DataFrame, names: list[str], ridge: float = RIDGE, tasks: int | None = None) -> DataFrame:
    """Goals of both sides by Poisson regressions with rows weighted by 2^(-age / ``HALF_LIFE``): (side, term, id, values).

    ``rows``: id, x (inputs, nulls allowed), y (home and away goals), day (number). Inputs are filled by their mean, flagged where
    some are missing, and standardised. A term's values are its weight, centre and scale; a row with ``id`` has its two rates.
    """
    total, last = rows.agg(F.count("*"), F.max("day")).first()
    rows = rows.select("id", "x", F.transform("y", lambda v: v.cast("double")).alias("y"), F.col("day").cast("double").alias("day"))
    last_day = float(last or 0)
    return together(rows, lambda held, add, first: _fit_rates(held, names, add, first, ridge, last_day), RATES, tasks or task_number(rows, total), "id")


def _batched(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """(slice, columns as arrays) of at most ``GRID_ROWS`` rows."""
    for begin in range(0, batch.num_rows, GRID_ROWS):
        part = batch.slice(begin, GRID_ROWS)
        yield part, *(part.column(c).to_numpy(zero_copy_only=False) for c in columns)


def masses(rates: DataFrame) -> DataFrame:
    """(id, cells): the four cell masses of each row of (id, home_rate, away_rate)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h, a in (x for b in batches for x in _batched(b, "home_rate", "away_rate")):
            yield pa.record_batch([part.column("id"), pa.array(cell_masses(score_grids(np.stack([h, a], axis=1))).tolist())], ["id", "cells"])

    return rates.select("id", "home_rate", "away_rate").mapInArrow(work, "id long, cells array<double>")


def _tilt_sums(rows: DataFrame, theta: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, and the summed gradient and second derivatives of their cost at ``theta``."""
    over, both = F.lit(float(theta[0])), F.lit(float(theta[1]))
    c = [F.col("cells")[i] for i in range(4)]
    raised = [c[0], c[1] * F.exp(both), c[2] * F.exp(over), c[3] * F.exp(over + both)]
    total = sum(raised[1:], raised[0])
    p = rows.select("cell", *[(x / total).alias(f"p{i}") for i, x in enumerate(raised)])
    p = p.select("p3", (F.col("p2") + F.col("p3")).alias("o"), (F.col("p1") + F.col("p3")).alias("b"), (F.col("cell") >= 2).cast("double").alias("yo"), (F.col("cell") % 2).alias("yb"))
    o, b = F.col("o"), F.col("b")
    n, *sums = p.agg(F.count("*"), F.sum(o - F.col("yo")), F.sum(b - F.col("yb")), F.sum(o * (1 - o)), F.sum(F.col("p3") - o * b), F.sum(b * (1 - b))).first()
    go, gb, oo, ob, bb = (x or 0.0 for x in sums)
    return n, np.array([go, gb]), np.array([[oo, ob], [ob, bb]])


def fit_tilt(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row (over, both, n): how much the log odds of over 2.5 and of both scoring are tilted, for (id, cells, cell): the
    penalised likelihood of the cells that happened. A Newton step is one aggregate over all rows; no task keeps any."""
    rows = rows.select("cells", F.col("cell").cast("double").alias("cell"))
    rows = checkpointed(rows.repartition(tasks) if tasks else rows)
    theta, total = np.zeros(2), 0
    for _ in range(100):
        total, gradient, hessian = _tilt_sums(rows, theta)
        n = max(total, 1)
        gradient, hessian = gradient / n + 2 * SHRINK * theta, hessian / n + 2 * SHRINK * np.eye(2)
        free = ~((np.abs(theta) >= MOST_TILT) & (np.sign(theta) == -np.sign(gradient)))  # held at a bound
        if not free.any() or np.abs(gradient[free]).max() < 1e-12:
            break
        move = np.zeros(2)
        move[free] = np.linalg.solve(hessian[np.ix_(free, free)], gradient[free])
        theta = np.clip(theta - move, -MOST_TILT, MOST_TILT)
        if np.abs(move).max() < 1e-9:  # the next one would be lost in the sums' rounding
            break
    return rows.sparkSession.createDataFrame([(float(theta[0]), float(theta[1]), total)], "over double, both double, n long")


def tilted(cells: DataFrame, tilt: DataFrame) -> DataFrame:
    """(id, cells) with the one row of ``tilt`` applied."""
    c = [F.col("cells")[i] for i in range(4)]
    raised = [c[0], c[1] * F.exp("both"), c[2] * F.exp("over"), c[3] * F.exp(F.col("over") + F.col("both"))]
    total = sum(raised[1:], raised[0])
    return cells.crossJoin(F.broadcast(tilt.select("over", "both"))).select("id", F.array(*[x / total for x in raised]).alias("cells"))


def project(rows: DataFrame) -> DataFrame:
    """(id, cells, over_25, over_35, btts, goals, home_rate, away_rate) of the score distribution that has the marginals
    ``over`` and ``both`` of each row of (id, home_rate, away_rate, over, both) and else follows its rates."""
    names = ["over_25", "over_35", "btts", "goals", "home_rate", "away_rate"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h, a, over, both in (x for b in batches for x in _batched(b, "home_rate", "away_rate", "over", "both")):
            grids = score_grids(np.stack([h, a], axis=1))
            cells = projected(cell_masses(grids), over, both)
            made = markets(reweighted(grids, cells))
            yield pa.record_batch([part.column("id"), pa.array(cells.tolist()), *[pa.array(made[c]) for c in names]], ["id", "cells", *names])

    return rows.select("id", "home_rate", "away_rate", "over", "both").mapInArrow(work, "id long, cells array<double>, " + ", ".join(f"{c} double" for c in names))
