"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are documents labelled 1; the unlabelled set is every document outside the held-out fold. Labels 0
are never read. The model is a sum of weights: one per bin of each statistic of the text, one per bucket of
its hashed words and of its hashed three-byte grams. It minimises
prior * E_P[loss(f)] + max(0, E_U[loss(-f)] - prior * E_P[loss(-f)]) for the logistic loss. The minimum is that of
prior * E_P[loss(f)] + part * (E_U[loss(-f)] - prior * E_P[loss(-f)]) for the part in [0, 1] at which the estimated
risk of negatives is not below zero, and this is convex in the weights.

The prior is estimated from positives and unlabelled documents alone: a first model separates the two, and the prior is the
least ratio of their shares above a score, with the confidence of that ratio taken into account (best bin
estimation). The non-negative risk leaves scores too high wherever it is clamped, so the intercept is set at last, again from
positives, all documents and the prior: where a document is as likely positive as the threshold says, its score is the
threshold. Scores further away are ranks on a probability's scale, not calibrated odds.

Labelled rows are bounded by ``SAMPLE_ROWS``. The risk, its gradient, the clamped part, bin edges, the prior and the threshold's
place are taken over all documents. A bounded sample of these gives first weights, a first part and a first curvature;
each step is halved until the risk over all documents falls, and the part is searched until the risk of negatives over all of
them is zero, so that a sample that misleads costs passes and changes nothing.
"""

from __future__ import annotations

import re
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, slices

FOLDS, THRESHOLD = 5, 0.3
#: At most so many positives are read, the first by digest, and so many documents for first weights and curvature.
SAMPLE_ROWS = 6000
BINS, BUCKETS, SHRINK = 12, 128, 0.01
#: Steps over all documents for one part at most, the change at which they end, halvings of a step or in the search of the clamped part of a sample,
#: parts tried over all documents at most, and how near to zero the clamped risk of negatives must come.
PASSES, SMALL, HALVINGS, PARTS, NEAR_ZERO = 20, 2e-3, 7, 12, 1e-3
#: Weight of the hashed buckets beside the bins, whose values are 0 and 1.
BUCKET_SCALE = 3.0
#: Bits of a feature's mantissa that its histogram drops (1,024 cells an octave are left), and cells of the
#: histogram of sums of weights, in which one is the unit and 30 the end. Both are of bounded size.
DROPPED_BITS, SUM_CELLS, SUM_END = 42, 1024, 30
FEATURES = (
    "log_words", "word_length", "long_words", "upper", "digits", "marks", "pipes", "bangs", "signs", "other_marks",
    "upper_words", "distinct_words", "top_word", "repeats", "lines", "distinct_lines", "line_words", "non_ascii",
)
WORD = re.compile(r"[^\s]+")
CLASS = np.zeros(128, np.int8)  # of an ASCII character: 1 upper, 2 digit, 3 pipe, 4 bang, 5 sign, 6 other mark, 7 space
CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
CLASS[[ord(c) for c in "0123456789"]] = 2
CLASS[ord("|")] = 3
CLASS[[ord(c) for c in "!?"]] = 4
CLASS[[ord(c) for c in "$%&#*@^~+=<>{}[]\\_/"]] = 5
CLASS[[ord(c) for c in ".,;:'\"()-`"]] = 6
CLASS[[9, 10, 11, 12, 13, 32]] = 7


def features(text: str | None) -> np.ndarray:
    """The features of one text, in the order of ``FEATURES``; a null or empty text gives zeros."""
    if not text:
        return np.zeros(len(FEATURES))
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ascii_only = points[points < 128]
    counts = np.bincount(CLASS[ascii_only], minlength=8) / len(points)
    words = text.split()
    n = max(1, len(words))
    lengths = np.array([*map(len, words)] or [0])
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x]
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return np.array([
        np.log1p(len(words)), lengths.mean(), (lengths > 14).mean(), counts[1], counts[2], counts[3:7].sum(), counts[3], counts[4], counts[5],
        counts[6], sum(map(str.isupper, words)) / n, len(seen) / n, max(seen.values(), default=0) / n, repeats / n, np.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), 1 - len(ascii_only) / len(points),
    ])


def buckets(text: str | None) -> bytes:
    """Square roots of the shares of hashed words and of hashed three-byte grams, a byte each."""
    out = np.zeros(2 * BUCKETS)
    seen: dict[str, int] = {}
    for w in (text or "").lower().split():
        seen[w] = seen.get(w, 0) + 1
    if seen:
        place = np.fromiter((zlib.crc32(w.encode()) for w in seen), np.int64, len(seen)) % BUCKETS
        out[:BUCKETS] = np.bincount(place, np.fromiter(seen.values(), float, len(seen)), BUCKETS) / sum(seen.values())
    raw = np.frombuffer((text or "").lower().encode(), np.uint8).astype(np.uint32)
    if len(raw) > 2:
        grams = (raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA77) + raw[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(25)
        out[BUCKETS:] = np.bincount(grams, minlength=BUCKETS) / len(grams)
    return np.round(np.sqrt(out) * 255).astype(np.uint8).tobytes()


def quantiles(cells: np.ndarray, counts: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The cells in which these parts of the counted rows are reached."""
    order = np.argsort(cells)
    reached = np.cumsum(counts[order])
    return cells[order][np.minimum(np.searchsorted(reached, parts * reached[-1]), len(order) - 1)]


def tallied(found: DataFrame, cells_of) -> tuple[np.ndarray, ...]:
    """Number of rows by column and cell, over all of ``found``; ``cells_of`` makes a matrix of cells from a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = cells_of(batch)
            for k in range(cells.shape[1]):
                cell, n = np.unique(cells[:, k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k, np.int32)), pa.array(cell), pa.array(n)], names=["k", "cell", "n"])

    counts = found.select("row", "grams").mapInArrow(run, "k int, cell long, n long").groupBy("k", "cell").agg(F.sum("n").alias("n")).toArrow()
    return tuple(counts.column(c).to_numpy() for c in ("k", "cell", "n"))


def edges_of(found: DataFrame) -> np.ndarray:
    """Bin edges of every feature: quantiles over all of ``found``, to a thousandth."""
    k, cell, n = tallied(found, lambda batch: (matrix(batch.column("row")) + 0.0).view(np.int64) >> DROPPED_BITS)  # features are not negative
    parts = np.linspace(0, 1, BINS + 1)[1:-1]
    return np.stack([(quantiles(cell[k == j], n[k == j], parts) << DROPPED_BITS).view(np.float64) for j in range(len(FEATURES))])


def sums_tally(found: DataFrame, edges: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weights over all of ``found``, to a thousandth, in ascending order, and the number of rows with each."""

    def cells(batch: pa.RecordBatch) -> np.ndarray:
        return np.floor(np.clip(design(batch, edges) @ weights, -SUM_END, SUM_END) * SUM_CELLS).astype(np.int64)[:, None]

    _, cell, n = tallied(found, cells)
    order = np.argsort(cell)
    return cell[order] / SUM_CELLS, n[order]


def binned(rows: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Index of each feature's bin, with an offset for the feature."""
    return np.stack([np.searchsorted(e, rows[:, j], side="right") + j * BINS for j, e in enumerate(edges)], axis=1)


def design(batch: pa.RecordBatch | pa.Table, edges: np.ndarray) -> np.ndarray:
    """The model's inputs, one row a document: bins, buckets and a one."""
    out = np.ones((batch.num_rows, len(FEATURES) * BINS + 2 * BUCKETS + 1))
    out[:, : len(FEATURES) * BINS] = 0
    np.put_along_axis(out, binned(matrix(batch.column("row")), edges), 1.0, 1)
    raw = np.frombuffer(b"".join(batch.column("grams").to_pylist()), np.uint8).reshape(batch.num_rows, 2 * BUCKETS)
    out[:, len(FEATURES) * BINS : -1] = raw * (BUCKET_SCALE / 255)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def negative_risk(positive: np.ndarray, unlabelled: np.ndarray, weights: np.ndarray, prior: float) -> float:
    return float(np.logaddexp(0, unlabelled @ weights).mean() - prior * np.logaddexp(0, positive @ weights).mean())


def risk(positive: np.ndarray, unlabelled: np.ndarray, weights: np.ndarray, prior: float, part: float) -> float:
    """prior * E_P[loss(f)] + part * (E_U[loss(-f)] - prior * E_P[loss(-f)]) and the shrinkage."""
    return prior * float(np.logaddexp(0, -(positive @ weights)).mean()) + part * negative_risk(positive, unlabelled, weights, prior) + SHRINK / 2 * float((weights[:-1] ** 2).sum())


def slope(positive: np.ndarray, mean_unlabelled: np.ndarray, weights: np.ndarray, prior: float, part: float) -> np.ndarray:
    """The gradient of :func:`risk`, from the mean over the unlabelled set of sigmoid(f) * inputs."""
    at_p = sigmoid(positive @ weights)
    of_positives = positive.T @ ((1 - part) * at_p - 1) / len(positive)  # loss'(f) = sigmoid(f) - 1, less part * loss'(-f)
    return part * mean_unlabelled + prior * of_positives + SHRINK * np.append(weights[:-1], 0)


def curvature(positive: np.ndarray, unlabelled: np.ndarray, weights: np.ndarray, prior: float, part: float) -> np.ndarray:
    of = lambda rows: (rows * (sigmoid(rows @ weights) * sigmoid(-(rows @ weights)))[:, None]).T @ rows / len(rows)
    return part * of(unlabelled) + prior * (1 - part) * of(positive) + np.diag(np.append(np.full(len(weights) - 1, SHRINK), 0) + 1e-6)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, part: float, weights: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the intercept) that minimise :func:`risk`, by Newton steps with halving; deterministic."""
    weights = np.zeros(positive.shape[1]) if weights is None else weights
    now = risk(positive, unlabelled, weights, prior, part)
    for _ in range(20):
        mean = unlabelled.T @ sigmoid(unlabelled @ weights) / len(unlabelled)
        step = np.linalg.solve(curvature(positive, unlabelled, weights, prior, part), slope(positive, mean, weights, prior, part))
        length = 1.0
        while length > 1e-4 and (new := risk(positive, unlabelled, weights - length * step, prior, part)) > now:
            length /= 2
        if length <= 1e-4:
            break
        weights, now = weights - length * step, new
        if np.abs(step).max() < 1e-4:
            break
    return weights


def fit_clamped(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights that minimise the non-negative risk and the part at which they do: 1 where the risk of negatives is not clamped."""
    weights = fit(positive, unlabelled, prior, 1.0)
    if negative_risk(positive, unlabelled, weights, prior) >= 0:
        return weights, 1.0
    low, high, found = 0.0, 1.0, weights
    for _ in range(HALVINGS):
        part = (low + high) / 2
        weights = fit(positive, unlabelled, prior, part, weights)
        if negative_risk(positive, unlabelled, weights, prior) >= 0:
            low, found = part, weights
        else:
            high = part
    return (found, low) if low else (weights, part)


def prior_of(positive: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> float:
    """The share of positives among unlabelled documents, from scores of positives that the model has not seen and a tally of all documents' scores."""
    total = counts.sum()
    above = np.cumsum(counts[::-1])[::-1] / total  # share of documents at or above each score
    positives_above = 1 - np.searchsorted(np.sort(positive), sums) / len(positive)
    some = positives_above > 0
    doubt = np.sqrt(np.log(40) / (2 * total)) + np.sqrt(np.log(40) / (2 * len(positive)))
    best = np.argmin((above[some] + 1.01 * doubt) / positives_above[some])
    return float(np.clip(above[some][best] / positives_above[some][best], 0.01, 0.99))


def decision(positive: np.ndarray, sums: np.ndarray, counts: np.ndarray, prior: float) -> float:
    """The sum of weights above which a document is likelier positive than ``THRESHOLD``.

    There the estimated cost is least, if a positive below costs 1 - THRESHOLD and a negative above THRESHOLD:
    both shares follow from those of positives and of all documents above a sum, and the prior.
    """
    above = np.cumsum(counts[::-1])[::-1] / counts.sum()
    positives_above = 1 - np.searchsorted(np.sort(positive), sums) / len(positive)
    return float(sums[np.argmax(prior * positives_above - THRESHOLD * above)])


def means_over(found: DataFrame, edges: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Means of sigmoid(f) * inputs and of loss(-f) over all of ``found``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(weights) + 2)
        for batch in batches:
            rows = design(batch, edges)
            f = rows @ weights
            total[:-2] += rows.T @ sigmoid(f)
            total[-2:] += np.logaddexp(0, f).sum(), len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["k", "total"])

    sums = found.select("row", "grams").mapInArrow(run, "k int, total double").groupBy("k").agg(F.sum("total").alias("total")).toArrow()
    total = np.zeros(len(weights) + 2)
    total[sums.column("k").to_numpy()] = sums.column("total").to_numpy()
    return total[:-2] / total[-1], float(total[-2] / total[-1])


class Everyone:
    """The risk over positives and all unlabelled documents, whose means come from ``over`` (weights to means)."""

    def __init__(self, positive: np.ndarray, sample: np.ndarray, prior: float, over) -> None:
        self.positive, self.sample, self.prior, self.over = positive, sample, prior, over

    def negative(self, weights: np.ndarray, loss: float) -> float:
        return loss - self.prior * float(np.logaddexp(0, self.positive @ weights).mean())

    def risk(self, weights: np.ndarray, part: float, loss: float) -> float:
        own = self.prior * float(np.logaddexp(0, -(self.positive @ weights)).mean())
        return own + part * self.negative(weights, loss) + SHRINK / 2 * float((weights[:-1] ** 2).sum())

    def settled(self, weights: np.ndarray, part: float) -> tuple[np.ndarray, float]:
        """Weights that minimise the risk for this part, and the risk of negatives there.

        Quasi-Newton steps: the first curvature is the sample's, and each step corrects it by how the slope over all documents has changed.
        """
        mean, loss = self.over(weights)
        inverse = np.linalg.inv(curvature(self.positive, self.sample, weights, self.prior, part))
        grad, now = slope(self.positive, mean, weights, self.prior, part), self.risk(weights, part, loss)
        for _ in range(PASSES):
            step = inverse @ grad
            if np.abs(step).max() < SMALL:
                break
            for _ in range(HALVINGS):
                new_mean, new_loss = self.over(weights - step)
                new = self.risk(weights - step, part, new_loss)
                if new <= now:
                    break
                step = step / 2
            else:
                break  # no step this way is small enough to help: as near as numbers get
            weights, loss, now = weights - step, new_loss, new
            before, grad = grad, slope(self.positive, new_mean, weights, self.prior, part)
            change, along = grad - before, -step
            turn = change @ along
            if turn > 1e-12:
                left = np.eye(len(weights)) - np.outer(along, change) / turn
                inverse = left @ inverse @ left.T + np.outer(along, along) / turn
        else:
            warnings.warn(f"the classifier's weights still moved by {np.abs(step).max():.2g} after {PASSES} steps", stacklevel=2)
        return weights, self.negative(weights, loss)

    def clamped(self, weights: np.ndarray, part: float) -> tuple[np.ndarray, float]:
        """Weights that minimise the non-negative risk, and their part, from first ones.

        The larger the part, the smaller the risk of negatives at the minimum: the part is 1 if that is not below zero there, else
        where it is zero, found by false position within what is known of either side.
        """
        low, high = (0.0, None), (1.0, None)
        for _ in range(PARTS):
            weights, negative = self.settled(weights, part)
            if abs(negative) <= NEAR_ZERO or (negative >= 0 and part == 1.0):
                break
            if negative > 0:
                low = (part, negative)
            else:
                high = (part, negative)
            if None not in (low[1], high[1]):
                part = low[0] + (high[0] - low[0]) * min(0.9, max(0.1, low[1] / (low[1] - high[1])))
            else:  # one side is not known yet: a step towards it, at last to its end
                near, end = (low, 1.0) if high[1] is None else (high, 0.0)
                part = end if abs(end - near[0]) < 0.05 else near[0] + (end - near[0]) / 4
        return weights, part


def fold():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def inputs(texts: list[str | None]) -> tuple[pa.Array, pa.Array]:
    return pa.array([features(t) for t in texts], pa.list_(pa.float64())), pa.array([buckets(t) for t in texts], pa.binary())


def described(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the model's inputs ``row`` and ``grams`` of every document, as a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *inputs(texts)], names=["doc_id", "held_out", "row", "grams"])

    rows = docs.select("doc_id", (fold() == 0).alias("held_out"), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, row array<double>, grams binary"
    return Scratch(docs.sparkSession).keep(rows.mapInArrow(run, schema))


def sampled(found: DataFrame, ids: DataFrame) -> pa.Table:
    """Inputs of the documents with these ids, at most SAMPLE_ROWS, on the driver; one row an id."""
    chosen = found.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("row", "grams")).alias("x"))
    return chosen.select("x.*").toArrow().sort_by("grams")  # the fit doesn't depend on the order in which tasks end


def train(found: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Bin edges and weights from described documents; None where there is no trusted positive or no document to learn from.

    Only labels outside fold 0 are read. Ids whose labels disagree are left out.
    """
    trusted = labels.where("doc_id is not null and quality is not null").where(fold() != 0)
    trusted = trusted.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")  # no label says 0
    chosen = trusted.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    known = found.where("doc_id is not null and not held_out")
    at_large = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(SAMPLE_ROWS)
    positives, some = sampled(found, chosen), sampled(found, at_large)
    if not positives.num_rows or not some.num_rows:
        return None
    edges = edges_of(known)
    positive, unlabelled = design(positives, edges), design(some, edges)
    even = np.arange(len(positive)) % 2 == 0
    first = fit(positive[even], unlabelled, 0.5, 1.0)
    prior = prior_of(positive[~even] @ first if (~even).any() else positive @ first, *sums_tally(known, edges, first))
    weights, _ = Everyone(positive, unlabelled, prior, lambda w: means_over(known, edges, w)).clamped(*fit_clamped(positive, unlabelled, prior))
    weights[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - decision(positive @ weights, *sums_tally(known, edges, weights), prior)
    return edges, weights


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; one row per input row.

    ``score`` is higher where label 1 is likelier and ``predicted`` is 1 from ``THRESHOLD`` on. Null and empty texts are scored by their (zero) inputs; a very
    long text has as many inputs as a short one. Repeated rows get equal scores; an empty table gives an
    empty result; further columns are not read. Without any trusted positive every score is 0.5.
    """
    rows = described(docs)
    model = train(rows, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.full(batch.num_rows, 0.5)
            if model and batch.num_rows:
                edges, weights = model
                found = sigmoid(design(batch, edges) @ weights)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns, repeated rows included.

    Null and empty texts are judged by their (zero) inputs; without any trusted positive nothing is rejected.
    """
    model = train(described(docs.where(fold() != 0)), labels)
    if model is None:
        return docs
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, weights = model
        for batch in slices(batches):
            rows = pa.RecordBatch.from_arrays(list(inputs(batch.column(names.index("text")).to_pylist())), names=["row", "grams"])
            yield batch.filter(pa.array(sigmoid(design(rows, edges) @ weights) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
