"""Whitening of vectors by shifted CholeskyQR.

The centred rows X are never gathered. A pass over the table sums the Gram matrix of X times an inverse triangle; its
Cholesky factor, shifted in the first pass so that it exists whatever the condition, orthogonalises the rows of the next
pass through a triangular solve. The factors compose to R of X = Q R, and the singular values of R are those of X, found
without squaring the condition number.

Entries are whole numbers, so that counts, sums and n x - S are exact, and rows are centred before they are multiplied.
Every matrix travels as blocks of rows, summed in two steps, so that no task receives more than a share of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import pick
from tidewell.llm.common import kind as type_of

SCALE, LIFT = 1024, 100_000
LARGEST = 1 << 40  # entries beyond this do not fit the exact sums
MAX_WIDTH = 4096  # a matrix of this width is what the driver holds and sends
ROWS = 4096  # vectors multiplied at a time, fewer if they are wide
BLOCK_BYTES = 1 << 20
SPREAD = 16  # first-step groups of a block
PASSES = 12
ROUND = np.finfo("f8").eps / 2
RANK = 1e-12  # singular values below this share of the largest count as zero


@dataclass(frozen=True)
class Whitening:
    """What the vectors of one width share."""

    n: int
    sums: np.ndarray  # exact, per dimension
    components: np.ndarray  # unit eigenvectors as columns, by falling eigenvalue
    variances: np.ndarray  # their eigenvalues, positive
    explained: np.ndarray
    passes: int
    identity_error: float = 0.0


def whole_entries(flat: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 as int64."""
    scaled = np.floor(SCALE * flat.astype("f8"))
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"an entry is too large for exact sums: 1024 c must not exceed {LARGEST}")
    return scaled.astype("i8") + LIFT


def _usable(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, rows of the batch, their whole entries) without null, broken and empty vectors, a slice at a time."""
    column = batch.column(batch.schema.get_field_index("vector"))
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for width in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == width)
        if width > MAX_WIDTH:
            raise ValueError(f"a vector has {width} entries, more than {MAX_WIDTH}")
        step = max(1, min(ROWS, (8 << 20) // (8 * width)))
        for start in range(0, len(rows), step):
            here = rows[start : start + step]
            values = column.take(pa.array(here)).flatten()
            flat = values.to_numpy(zero_copy_only=False).astype("f8").reshape(-1, width)  # null entries become NaN
            good = np.isfinite(flat).all(axis=1)
            if good.any():
                yield width, here[good], whole_entries(flat[good])


def _summed(vectors: DataFrame, height: Callable[[int], int], add: Callable[[np.ndarray, int], np.ndarray], kind: str):
    """{width: sum of add(entries, width) over all vectors}; each sum is a matrix of ``height(width)`` rows."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, _, entries in _usable(batch):
                more = add(entries, width)
                totals[width] = totals[width] + more if width in totals else more
        task = TaskContext.get().partitionId()
        for width, total in totals.items():
            rows = max(1, BLOCK_BYTES // max(1, total[0].nbytes))
            for start in range(0, len(total), rows):
                part = np.ascontiguousarray(total[start : start + rows]).tobytes()
                yield _block(width, start, task % SPREAD, part)

    def merge(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(part.as_buffer(), kind) for part in table.column("part"))
        one = table.slice(0, 1).to_pylist()[0]
        return pa.Table.from_batches([_block(one["width"], one["start"], one["task"], np.asarray(total).tobytes())])

    types = "width int, start int, task int, part binary"
    parts = vectors.select("vector").mapInArrow(partial, types)
    parts = parts.groupBy("width", "start", "task").applyInArrow(merge, types)
    parts = parts.groupBy("width", "start").applyInArrow(merge, types)
    found: dict[int, list] = {}
    for row in parts.collect():  # one matrix for each width
        found.setdefault(row["width"], []).append((row["start"], np.frombuffer(bytes(row["part"]), kind)))
    return {
        width: np.concatenate([part for _, part in sorted(blocks, key=lambda b: b[0])]).reshape(height(width), -1)
        for width, blocks in found.items()
    }


def _block(width: int, start: int, task: int, part: bytes) -> pa.RecordBatch:
    columns = [pa.array([v], pa.int32()) for v in (width, start, task)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([part], pa.binary())], "width start task part".split())


def _centred(entries: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n with one rounding, as n x - S is exact."""
    return (n * entries - sums) / n


def _solve_rows(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """rows times the inverse of an upper triangle, column by column."""
    out = np.empty_like(rows)
    for j in range(upper.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def _next_factor(gram: np.ndarray, n: int, first: bool) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix, shifted as far as it needs to exist."""
    width = len(gram)
    shift = 11 * (n * width + width * (width + 1)) * ROUND * np.trace(gram) if first else 0.0
    shift = min(shift, 1e-4 * np.trace(gram) / width) if first else shift
    floor = width * ROUND * max(float(np.trace(gram)), 1e-300)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(width)).T
        except np.linalg.LinAlgError:
            shift = max(floor, 10 * shift)


def _orthogonal(gram: np.ndarray) -> bool:
    """Whether rows are orthonormal to double precision in every direction that they use."""
    values = np.linalg.eigvalsh(gram)
    used = values > 0.5
    return bool((np.abs(values[used] - 1) < 1e-11).all() and (values[~used] < 1e-20).all())


def _root(gram: np.ndarray) -> np.ndarray:
    """W of gram = W' W for a Gram matrix that need not have full rank."""
    values, axes = np.linalg.eigh(gram)
    return np.sqrt(np.clip(values, 0, None))[:, None] * axes.T


def fit(rows: DataFrame, vector_column: str = "embedding", components: int = 8) -> dict[int, Whitening]:
    """The whitening of each width of vectors: one pass for the sums, one for each factor, one for the error.

    Three factors suffice for vectors of full rank. Directions without variance keep shrinking instead of becoming
    orthonormal; passes then end at a fixed number, and the root of the last Gram matrix takes the place of its factor.
    """
    vectors = pick(rows, vector=vector_column)
    counted = _summed(vectors, lambda w: 2, _count_and_sum, "i8")
    base = {w: (int(m[0, 0]), m[1].copy()) for w, m in counted.items()}
    factors: dict[int, list[np.ndarray]] = {w: [] for w in base}
    last: dict[int, np.ndarray] = {}
    open_widths = set(base)
    for step in range(PASSES):
        if not open_widths:
            break
        doing = {w: (*base[w], list(factors[w])) for w in open_widths}

        def gram(entries: np.ndarray, width: int, doing=doing) -> np.ndarray:
            if width not in doing:
                return np.zeros((width, width))
            n, sums, uppers = doing[width]
            part = _centred(entries, n, sums)
            for upper in uppers:
                part = _solve_rows(part, upper)
            return part.T @ part

        found = _summed(vectors, lambda w: w, gram, "f8")
        for width in sorted(open_widths):
            matrix = (found[width] + found[width].T) / 2
            last[width] = matrix
            flat = not np.any(matrix)
            if flat or (step >= 2 and _orthogonal(matrix)):
                open_widths.discard(width)
            elif step < PASSES - 1:
                factors[width].append(_next_factor(matrix, base[width][0], step == 0))
    models = {}
    for width, (n, sums) in base.items():
        composed = _root(last[width])
        for upper in reversed(factors[width]):
            composed = composed @ upper
        _, singular, axes = np.linalg.svd(composed)
        rank = int((singular > RANK * max(singular[0], 1e-300)).sum()) if singular[0] > 0 else 0
        variances = singular**2 / n
        total = variances.sum()
        kept = min(components, rank)
        share = variances[:kept] / total if total else variances[:kept]
        models[width] = Whitening(n, sums, axes[:kept].T.copy(), variances[:kept], share, len(factors[width]) + 1)
    return _with_errors(vectors, models)


def _count_and_sum(entries: np.ndarray, width: int) -> np.ndarray:
    return np.stack([np.full(width, len(entries), "i8"), entries.sum(axis=0)])


def _whiten(entries: np.ndarray, model: Whitening) -> np.ndarray:
    return _centred(entries, model.n, model.sums) @ model.components / np.sqrt(model.variances)


def _with_errors(vectors: DataFrame, models: dict[int, Whitening]) -> dict[int, Whitening]:
    """Models with the largest entry by which the covariance of the whitened rows departs from the identity.

    Whitened rows are centred by construction; their mean is summed beside the products and taken off all the same.
    """

    def products(entries: np.ndarray, width: int) -> np.ndarray:
        white = _whiten(entries, models[width])
        return np.vstack([white.sum(axis=0), white.T @ white])

    wide = {w for w, m in models.items() if m.components.shape[1]}
    if not wide:
        return models

    def add(entries: np.ndarray, width: int) -> np.ndarray:
        return products(entries, width) if width in wide else np.zeros((1, 1))

    found = _summed(vectors, lambda w: models[w].components.shape[1] + 1, add, "f8")
    out = {}
    for width, model in models.items():
        if width in wide:
            mean = found[width][0] / model.n
            error = np.abs(found[width][1:] / model.n - np.outer(mean, mean) - np.eye(len(mean))).max()
            model = Whitening(**{**vars(model), "identity_error": float(error)})
        out[width] = model
    return out


def _deviations(entries: np.ndarray, model: Whitening) -> list[int]:
    """Exact sums of (n x - S)^2."""
    off = model.n * entries - model.sums
    if off.size and int(np.abs(off).max()) ** 2 * off.shape[1] < 1 << 63:
        return (off * off).sum(axis=1).tolist()
    return (off.astype(object) ** 2).sum(axis=1).tolist()


def whiten_vectors(
    rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 8
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    Vectors that are null or hold null or non-finite entries are dropped; so are empty ones, which have no component. Each
    width of vectors is a fit list of its own. Components are numbered from 1 by falling variance; directions without
    variance cannot be whitened and give no row, so that a single vector, or equal ones, give none. Of equal variances
    any basis is as good, and the sign is free, but the same for all rows. Null and repeated ids and repeated vectors are
    kept as they are; an empty table gives an empty result; other columns are not carried. ``deviation`` is null where the
    exact sum does not fit a long; an entry beyond 2^30 is an error.
    """
    models = fit(rows, vector_column, components)
    vectors = pick(rows, id=id_column, vector=vector_column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, places, entries in _usable(batch):
                model = models[width]
                kept = len(model.variances)
                if not kept:
                    continue
                white = _whiten(entries, model)
                count = len(places)
                deviation = [d if d < 1 << 63 else None for d in _deviations(entries, model)]
                columns = [
                    batch.column(0).take(pa.array(np.repeat(places, kept))),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype="i4"), count)),
                    pa.array(np.full(count * kept, model.n, "i8")),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(count), kept))),
                    pa.array(white.ravel()),
                    pa.array(np.tile(model.explained, count)),
                    pa.array(np.full(count * kept, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, WHITENED)

    return vectors.mapInArrow(
        run,
        f"id {type_of(rows, id_column)}, component int, n bigint, deviation bigint, whitened double,"
        " explained double, identity_error double",
    )


WHITENED = "id component n deviation whitened explained identity_error".split()
