"""Quality classifier by co-training.

One view is the text itself (shares of character classes, word statistics, repetition, and the shares
of the words that set the classes of the labelled sample apart most), the other the page's metadata
(language, source, stated length). Both start from labelled documents. In each
round either view labels all unlabelled documents it is sure of, weighed towards the proportion of
the classes, for the other view to learn from. On labelled documents held back from training each
view is calibrated, and the two calibrated log-odds are combined. Only a bounded sample of labelled
rows (``labelled``) comes to the driver. Features are made once where the documents are and kept in
short rows; means, spreads and every Newton step come from sums over all of them, so the driver sees
sums only, of a fixed size for each of at most ``PARTS`` tasks (or as many as there are cores).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, gathered, materialize, set_apart, small_batches
from .pii import fit_logistic
from .textkernel import utf8_chunks, word_hashes, words

LABELLED, ROUNDS, SURE, HASHED = 20_000, 4, 0.95, 32
#: Shape features of a text; words that get a feature each, and in how many labelled documents such a word must stand.
TEXT_FEATURES, WORDS, FEWEST = 13, 48, 8
#: A pseudo-label weighs half a label; the tasks of a pass over the features; a distributed Newton fit ends at this step.
WEIGHT, PARTS, SMALL_STEP = 0.5, 64, 1e-4
NO_WORDS = np.zeros(0, np.uint64)
_CLASSES = np.zeros((6, 256), np.int32)
_CLASSES[0, 65:91] = 1  # upper case
_CLASSES[1, 97:123] = 1  # lower case
_CLASSES[2, 48:58] = 1  # digits
_CLASSES[3, [ord(c) for c in ".,;:'\"?-()"]] = 1  # ordinary punctuation
_CLASSES[4, [ord(c) for c in "!#$%&*+/<=>@[]^_`{|}~\\"]] = 1  # symbols
_CLASSES[5, 128:] = 1  # beyond ASCII


def text_features(column: pa.Array, vocabulary: np.ndarray = NO_WORDS) -> np.ndarray:
    """Rows x (TEXT_FEATURES + the share of each word of the sorted vocabulary of hashes) over whole texts; a text without words
    is all zeros."""
    out = np.zeros((len(column), TEXT_FEATURES + len(vocabulary)), np.float64)
    for at_row, data, off in utf8_chunks(column):
        starts, ends, first = words(data, off)
        n, size = np.diff(first), np.maximum(np.diff(off), 1)
        f = out[at_row : at_row + len(n)]
        for j, c in enumerate(_CLASSES):
            total = np.concatenate([[0], np.cumsum(c[data], dtype=np.int64)])
            f[:, j] = (total[off[1:]] - total[off[:-1]]) / size
        h = word_hashes(data, starts, ends)
        m = np.maximum(n, 1)
        again = np.zeros(len(h), np.int64)
        again[1:] = h[1:] == h[:-1]
        lone = (ends - starts == 1).astype(np.int64)
        length = ends - starts
        for j, v in ((6, again), (7, lone), (8, length), (9, (length > 25).astype(np.int64))):
            total = np.concatenate([[0], np.cumsum(v)])
            f[:, j] = (total[first[1:]] - total[first[:-1]]) / m
        f[:, 8] /= 10
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        f[:, 10] = (lines[off[1:]] - lines[off[:-1]]) / m
        f[:, 11] = [len(np.unique(h[a:b])) / max(b - a, 1) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        f[:, 12] = np.log1p(n) / 10
        if len(vocabulary):
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            hit = np.flatnonzero(vocabulary[at] == h)
            row = np.searchsorted(first, hit, "right") - 1
            seen = np.bincount(row * len(vocabulary) + at[hit], minlength=len(n) * len(vocabulary)).reshape(len(n), -1)
            f[:, TEXT_FEATURES:] = seen / m[:, None]
        f[n == 0] = 0
    return out


def meta_codes(lang: pa.Array, source: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed language and source."""
    return tuple(np.array([zlib.crc32((x if x is not None else "\x00none").encode()) % HASHED for x in column.to_pylist()], np.int32) for column in (lang, source))


def meta_matrix(lang: np.ndarray, source: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Rows of metadata features from hashed language and source and the stated length (-1 if missing)."""
    out = np.zeros((len(chars), 2 * HASHED + 2))
    rows = np.arange(len(chars))
    out[rows, lang] = 1
    out[rows, HASHED + source] = 1
    out[:, -2] = np.log1p(np.maximum(chars, 0)) / 10
    out[:, -1] = chars < 0
    return out


def meta_features(lang: pa.Array, source: pa.Array, chars: pa.Array) -> np.ndarray:
    """Hashed language and source, stated length and whether it is missing."""
    return meta_matrix(*meta_codes(lang, source), np.asarray(chars.cast(pa.float64()).fill_null(-1.0)))


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


@dataclass
class Model:
    """Weights of the views on standardised features, their calibrations (slope, constant) and the combination."""

    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    text_scale: tuple = ()
    meta_scale: tuple = ()
    text_cal: np.ndarray | None = None
    meta_cal: np.ndarray | None = None
    both: np.ndarray | None = None
    words: np.ndarray = field(default_factory=lambda: NO_WORDS)

    def views(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = _logit((xt - self.text_scale[0]) / self.text_scale[1], self.text)
        b = _logit((xm - self.meta_scale[0]) / self.meta_scale[1], self.meta)
        return a * self.text_cal[0] + self.text_cal[1], b * self.meta_cal[0] + self.meta_cal[1]

    def score(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) by the text, by the metadata and by both; 0.5 throughout if nothing could be learnt."""
        if self.text is None:
            half = np.full(len(xt), 0.5)
            return half, half, half
        a, b = self.views(xt, xm)
        c = _logit(np.stack([a, b], 1), self.both)
        return tuple(1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (a, b, c))


def pseudo_labels(x: np.ndarray, history: list[np.ndarray], sure: float) -> np.ndarray:
    """What one view gives the other: per row the label of the first round whose weights are sure of it, NaN if none is."""
    given = np.full(len(x), np.nan)
    for w in history:
        p = 1 / (1 + np.exp(-_logit(x, w)))
        open_rows = np.isnan(given)
        given[open_rows & (p >= sure)] = 1.0
        given[open_rows & (1 - p >= sure)] = 0.0
    return given


def class_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows for class 0 and 1: count, loss, gradient and Hessian of the rows of x with that label (NaN: none)."""
    k = len(w)
    out = np.zeros((2, 2 + k + k * k))
    for c in (0, 1):
        z = np.hstack([x[y == c], np.ones((int((y == c).sum()), 1))])
        t = np.clip(z @ w, -30, 30)
        p = 1 / (1 + np.exp(-t))
        out[c, :2] = len(z), np.log1p(np.exp(-t if c else t)).sum()
        out[c, 2 : 2 + k] = z.T @ (c - p)
        out[c, 2 + k :] = ((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z).reshape(-1)
    return out


class _Newton:
    """Ridge logistic regression whose sums are given at ``w`` from outside; a step that raises the loss is halved."""

    def __init__(self, w: np.ndarray, ridge: float = 1.0):
        self.w, self.ridge, self.done = w, ridge, False
        self.best, self.least = w, np.inf

    def take(self, sums: np.ndarray) -> None:
        """Move on by loss, gradient and Hessian at ``w``."""
        k, w = len(self.w), self.w
        loss = sums[1] + self.ridge * (w @ w) / 2
        if loss > self.least * (1 + 1e-9) + 1e-9:
            self.w = (w + self.best) / 2
            self.done = bool(np.abs(self.w - self.best).max() < SMALL_STEP)
            return
        self.best, self.least = w, loss
        step = np.linalg.solve(sums[2 + k :].reshape(k, k) + self.ridge * np.eye(k), sums[2 : 2 + k] - self.ridge * w)
        self.w = w + step
        self.done = bool(np.abs(step).max() < SMALL_STEP)


def cotrain(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, scales: Callable[[], tuple], sums: Callable[..., dict[str, np.ndarray]], held: np.ndarray, rounds: int = ROUNDS, sure: float = SURE) -> Model:
    """The model from labelled rows (xt, xm, y) and from all unlabelled ones through their sums; rows ``held`` back only calibrate.

    ``scales()`` gives means and spreads of both views over all rows, ``sums(scales, histories, at, sure)`` the ``class_sums``
    over all unlabelled rows with the pseudo-labels of the histories for each view, at its weights.
    """
    if len(y) < 20 or len(np.unique(y)) < 2:
        return Model()
    ts, ms = scales()
    a, b = (xt - ts[0]) / ts[1], (xm - ms[0]) / ms[1]
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    train, cal = ~held, held if held.any() else ~held
    share = float(y[train].mean())
    own = {"text": a[train], "meta": b[train]}
    w = {view: fit_logistic(x, y[train], np.ones(int(train.sum()))) for view, x in own.items()}
    history: dict[str, list[np.ndarray]] = {"text": [], "meta": []}
    for _ in range(rounds):
        for view in history:
            history[view].append(w[view])
        fits = {view: _Newton(w[view]) for view in w}
        for _ in range(30):
            given = sums((ts, ms), history, {view: f.w for view, f in fits.items()}, sure)
            for view, f in fits.items():
                if f.done:
                    continue
                total = class_sums(own[view], y[train], f.w).sum(0)
                n = given[view][:, 0]
                for c, part in ((0, 1 - share), (1, share)):
                    # the class that has more than its share is weighed down to it
                    total += WEIGHT * min(1.0, part * n.sum() / max(n[c], 1)) * given[view][c]
                f.take(total)
            if all(f.done for f in fits.values()):
                break
        w = {view: f.w for view, f in fits.items()}
    m = Model(w["text"], w["meta"], ts, ms)
    one = np.ones(int(cal.sum()))
    m.text_cal = fit_logistic(_logit(a[cal], w["text"])[:, None], y[cal], one)
    m.meta_cal = fit_logistic(_logit(b[cal], w["meta"])[:, None], y[cal], one)
    va, vb = m.views(xt[cal], xm[cal])
    m.both = fit_logistic(np.stack([va, vb], 1), y[cal], one)
    return m


def _prepared(docs: DataFrame) -> DataFrame:
    def has(c: str, kind: str):
        return F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), has("lang", "string").alias("lang"), has("source", "string").alias("source"), has("n_chars", "long").alias("n_chars"))


def _unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Text and metadata features of the columns t, lang, source, chars."""
    xt = np.frombuffer(b"".join(b.column("t").to_pylist()), "<f4").reshape(b.num_rows, -1).astype(float)
    return xt, meta_matrix(*(np.asarray(b.column(c)) for c in ("lang", "source", "chars")))


def _vocabulary(docs: DataFrame, truth: DataFrame, most: int = WORDS) -> np.ndarray:
    """Sorted hashes of the ``most`` words whose document shares differ most between the classes of truth(d, y), by chi-square.

    truth has at most the bound of labelled rows; documents are counted where they are, and the driver gets the words chosen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = np.asarray(b.column(1))
            for row, data, off in utf8_chunks(b.column(0)):
                starts, ends, first = words(data, off)
                h = word_hashes(data, starts, ends)
                each = [np.unique(h[x:z]) for x, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                good = np.repeat(y[row : row + len(each)], [len(e) for e in each])
                for c in (0, 1):
                    w, n = np.unique(np.concatenate([NO_WORDS, *each])[good == c], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n if c else 0 * n), pa.array(0 * n if c else n)], names=["w", "yes", "no"])

    sums = truth.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    if not sums[0] or not sums[1]:
        return NO_WORDS
    labelled = docs.join(F.broadcast(truth), F.col("doc_id") == F.col("d")).select("text", "y")
    seen = labelled.mapInArrow(run, "w long, yes long, no long").groupBy("w").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).where(F.col("yes") + F.col("no") >= FEWEST)
    p = (F.col("yes") + F.col("no")) / (sums[0] + sums[1])
    gap = F.pow(F.col("yes") / sums[0] - F.col("no") / sums[1], 2) / (p * F.greatest(1 - p, F.lit(1e-3)))
    return np.sort(np.array([r["w"] for r in seen.orderBy(F.desc(gap), "w").limit(most).collect()], np.int64).view(np.uint64))


def _summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum of ``part`` over all batches of feature rows, one vector a task; None if there is no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in gathered(batches, 8192):
            if b.num_rows:
                v = part(b)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["v"])

    found = [np.frombuffer(r["v"], "<f8") for r in rows.mapInArrow(run, "v binary").collect()]
    return np.sum(found, axis=0) if found else None


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, seed: int = 5) -> Model:
    """Learn from labels(doc_id, quality) and all of docs; at most about ``labelled`` labelled rows, drawn by a hash of the row.

    Labels that contradict each other count by their mean; null labels and labels of missing documents are left out. A
    labelled row that repeats counts once. All rows of docs give means and spreads; all without a label, those of null doc_id
    among them, are scored in each round. Null and empty texts are texts without words; a long text is taken whole. Fewer than
    20 labelled rows, or labels of one class only, as in an empty table, give the model that scores 0.5 throughout.
    """
    spark = docs.sparkSession
    small_batches(spark)
    truth = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("d")).agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    truth = materialize(truth)
    work = _prepared(docs)
    id_lots = int((1 << 20) * min(1.0, labelled / max(truth.count(), 1)))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "d"), F.lit(1 << 20)) < F.lit(id_lots)
    held_back = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(5)) == 4
    vocabulary = _vocabulary(work.where(~held_back), truth.where(drawn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.array([r.tobytes() for r in text_features(b.column(1), vocabulary).astype("<f4")], pa.binary())
            lang, source = meta_codes(b.column(2), b.column(3))
            chars = b.column(4).cast(pa.float64()).fill_null(-1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), t, pa.array(lang, pa.int32()), pa.array(source, pa.int32()), chars], names=["doc_id", "t", "lang", "source", "chars"])

    made = materialize(work.mapInArrow(run, "doc_id long, t binary, lang int, source int, chars double"))
    # rows without an id have no label and need not meet in one task
    known = made.where("doc_id is not null").join(truth, F.col("doc_id") == F.col("d"), "left").drop("d")
    x = materialize(known.unionByName(made.where("doc_id is null").withColumn("y", F.lit(None).cast("double"))))
    yes = x.where("y is not null").withColumn("held", held_back).distinct().withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "t", "lang", "source", "chars"))
    lots = int((1 << 20) * min(1.0, labelled / max(yes.count(), 1)))
    yes = yes.where(F.pmod("h", F.lit(1 << 20)) < F.lit(lots)).toPandas().sort_values(["h", "doc_id"])
    none = np.zeros((0, TEXT_FEATURES + len(vocabulary))), np.zeros((0, 2 * HASHED + 2))
    xt, xm = _unpacked(pa.RecordBatch.from_pandas(yes[["t", "lang", "source", "chars"]], preserve_index=False)) if len(yes) else none
    rows = x.select("t", "lang", "source", "chars", "y").coalesce(max(PARTS, spark.sparkContext.defaultParallelism))
    unlabelled = rows.where("y is null")

    def scales() -> tuple:
        def part(b: pa.RecordBatch) -> np.ndarray:
            z = np.hstack(_unpacked(b))
            return np.concatenate([[len(z)], z.sum(0), (z * z).sum(0)])

        v = _summed(rows, part)
        mean, square = v[1:].reshape(2, -1) / v[0]
        spread = np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-3
        return tuple((mean[cut], spread[cut]) for cut in (slice(0, xt.shape[1]), slice(xt.shape[1], None)))

    def sums(scale: tuple, history: dict[str, list[np.ndarray]], at: dict[str, np.ndarray], sure: float) -> dict[str, np.ndarray]:
        def part(b: pa.RecordBatch) -> np.ndarray:
            a, m = ((z - s[0]) / s[1] for z, s in zip(_unpacked(b), scale, strict=True))
            text = class_sums(a, pseudo_labels(m, history["meta"], sure), at["text"])
            meta = class_sums(m, pseudo_labels(a, history["text"], sure), at["meta"])
            return np.concatenate([text.reshape(-1), meta.reshape(-1)])

        sizes = [2 * (2 + len(at[view]) + len(at[view]) ** 2) for view in ("text", "meta")]
        v = _summed(unlabelled, part)
        v = np.zeros(sum(sizes)) if v is None else v
        return {"text": v[: sizes[0]].reshape(2, -1), "meta": v[sizes[0] :].reshape(2, -1)}

    model = cotrain(xt, xm, yes["y"].to_numpy(float), scales, sums, yes["held"].to_numpy(bool))
    model.words = vocabulary
    discard(made, x, truth)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of docs with _p_text, _p_meta and _score, each P(good).

    Null, empty and wordless texts have score 0. Missing metadata columns count as null. Repeated rows get the same score, a
    very long text is scored whole, an empty table gives an empty one. Input columns of these three names give way to them.
    """
    small_batches(docs.sparkSession)
    made, read = ("_p_text", "_p_meta", "_score"), ("text", "lang", "source", "n_chars")
    docs, columns = set_apart(docs, ("doc_id", *read), tuple(f"_in_{c}" for c in read), made)
    names = docs.columns
    work = docs.select(*(F.col(f"`{c}`") for c in names), F.coalesce("text", F.lit("")).alias("_in_text"), *(F.lit(None).cast(k).alias(f"_in_{c}") if c not in names else F.col(c).cast(k).alias(f"_in_{c}") for c, k in (("lang", "string"), ("source", "string"), ("n_chars", "long"))))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(names)
        for b in batches:
            xt = text_features(b.column(k), model.words)
            a, m, s = model.score(xt, meta_features(b.column(k + 1), b.column(k + 2), b.column(k + 3)))
            s = np.where((xt != 0).any(1), s, 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(a), pa.array(m), pa.array(s)], names=[*names, *made])

    return work.mapInArrow(run, schema).select(*columns, *made)
