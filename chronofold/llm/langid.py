"""Language identification with averaged hashed subword embeddings.

A text's vector is the mean of the embeddings of its subwords, which are runs
of three and of five bytes after lower-casing A-Z and turning ASCII marks,
digits and white space into blanks; runs are hashed into a fixed number of
buckets.  A linear softmax on that vector gives the languages.  Both layers are
trained together by stochastic gradient descent in numpy, on the driver, on a
bounded sample of labelled rows.  Two more parts are fitted on rows of the
sample that training leaves out: a temperature, so that scores can be read as
probabilities, and the score below which a prediction is rejected, set so that
at most a given share of right predictions is lost (split-conformal).

For scoring the two layers fold into one table of per-bucket logits, and a
whole text costs a lookup for each run of bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import slices, text_bytes

_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Settings:
    """Bounds and rates of training.

    At most ``sample`` labelled rows are drawn, shared evenly among at most
    ``languages`` labels (the most frequent ones), none longer than
    ``longest`` characters.  This bounds what reaches the driver.
    """

    sample: int = 3000
    languages: int = 128
    longest: int = 60_000
    buckets: int = 1 << 15
    width: int = 8
    #: Passes over the sample, and steps that are taken at least.
    epochs: int = 3
    steps: int = 500
    rate: float = 60.0
    batch: int = 32
    calibration: float = 0.25
    #: Share of right predictions that rejection may lose.
    rejected: float = 0.002
    seed: int = 7


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages, logits of one run
    bias: np.ndarray
    temperature: float
    least: float  # scores below are rejected


def runs(raw: np.ndarray, offsets: np.ndarray, buckets: int):
    """Bucket of each run of three and five bytes, with the offsets of rows; runs never cross rows."""
    n = len(raw)
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    b = _FOLD[raw].astype(np.uint64)
    for width, factor in ((3, 0x9E3779B97F4A7C15), (5, 0xC2B2AE3D27D4EB4F)):
        m = max(0, n - width + 1)
        code = np.zeros(m, np.uint64)
        for k in range(width):
            code = code << np.uint64(8) | b[k : k + m]
        h = (code * np.uint64(factor) >> shift).astype(np.int64)
        # runs that would cross the end of a row are those of its last width - 1 bytes
        ok = np.ones(m, bool)
        for e in range(1, width):
            at = offsets[1:] - e
            at = at[(at >= 0) & (at < m)]
            ok[at] = False
        places = np.flatnonzero(ok)
        yield h[places], np.searchsorted(places, offsets)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Row sums of consecutive ranges; empty ranges are zero."""
    out = np.zeros((len(bounds) - 1, values.shape[1]), np.float64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0)
    return out


def logits(model: Model, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of each row and its number of runs."""
    total = np.zeros((len(offsets) - 1, len(model.languages)))
    count = np.zeros(len(offsets) - 1, np.int64)
    for h, bounds in runs(raw, offsets, len(model.table)):
        total += _sums(model.table[h], bounds)
        count += np.diff(bounds)
    return total / np.maximum(count, 1)[:, None] + model.bias, count


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], settings: Settings = Settings()) -> Model:
    """Train on (text, label) pairs, in the order given; the same pairs give the same model.

    No pairs give a model without languages; texts without any run of bytes
    are pairs like others.
    """
    s = settings
    languages = sorted(set(labels))
    n, c = len(texts), len(languages)
    rng = np.random.default_rng(s.seed)
    if c == 0:
        return Model([], np.zeros((s.buckets, 0), np.float32), np.zeros(0), 1.0, 0.0)
    target = np.array([languages.index(x) for x in labels])
    rows = []  # distinct buckets of a row and their shares
    for lo in range(0, n, 32):
        raw, offsets = text_bytes(pa.array(texts[lo : lo + 32], pa.large_string()))
        both = list(runs(raw, offsets, s.buckets))
        for i in range(len(offsets) - 1):
            h = np.concatenate([h[b[i] : b[i + 1]] for h, b in both])
            u, k = np.unique(h, return_counts=True)
            rows.append((u.astype(np.int32), (k / max(len(h), 1)).astype(np.float32)))
    order = rng.permutation(n)
    held = max(1, int(n * s.calibration)) if n > 3 else 0
    tune, train = order[:held], order[held:]
    table = rng.normal(0, 1 / s.width, (s.buckets, s.width))
    out = np.zeros((s.width, c))
    bias = np.zeros(c)

    def forward(part):
        idx = np.concatenate([rows[i][0] for i in part])
        share = np.concatenate([rows[i][1] for i in part])
        bounds = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in part])])
        x = _sums(table[idx] * share[:, None], bounds)
        return idx, share, bounds, x, x @ out + bias

    each = max(1, -(-len(train) // s.batch))
    epochs = max(s.epochs, -(-s.steps // each))
    steps, total = 0, epochs * each
    for _ in range(epochs):
        for part in np.split(mixed := rng.permutation(train), range(s.batch, len(mixed), s.batch)):
            if not len(part):
                continue
            idx, share, bounds, x, z = forward(part)
            g = _softmax(z)
            g[np.arange(len(part)), target[part]] -= 1
            g /= len(part)
            rate = s.rate * (1 - steps / total)
            # a step is never longer than what the curvature of the loss bears: short texts have long vectors
            own = _sums((share * share)[:, None], bounds)[:, 0]
            scale = np.minimum(1.0, 1.0 / np.maximum(rate * own * (out * out).sum(), 1e-30))
            back = np.repeat((g * scale[:, None]) @ out.T, np.diff(bounds), axis=0) * share[:, None]
            out -= min(rate, 1.0 / max(float((x * x).sum(axis=1).max()), 1e-30)) * (x.T @ g)
            bias -= min(0.01 * rate, 1.0) * g.sum(axis=0)
            for d in range(s.width):
                table[:, d] -= rate * np.bincount(idx, back[:, d], s.buckets)
            steps += 1
    if not (np.isfinite(table).all() and np.isfinite(out).all() and np.isfinite(bias).all()):
        raise FloatingPointError("training has diverged")
    temperature, least = 1.0, 0.0
    if held:
        z = np.concatenate([forward(tune[i : i + 64])[4] for i in range(0, held, 64)])
        grid = np.geomspace(0.05, 20, 60)
        loss = [-np.log(_softmax(z / t)[np.arange(held), target[tune]] + 1e-12).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(z / temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == target[tune]])
        k = int(s.rejected * (len(right) + 1))
        least = float(right[k - 1]) if k else 0.0
    return Model(languages, (table @ out).astype(np.float32), bias, temperature, least)


def training_rows(docs: DataFrame, settings: Settings = Settings(), *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> list[tuple[str, str]]:
    """The bounded sample, drawn by a hash of the id so that any layout of the rows gives the same one."""
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), F.col(lang_column).cast("string").alias("_lang"))
    rows = rows.where("_lang IS NOT NULL AND _text IS NOT NULL").where(F.length("_text") <= settings.longest)
    counts = {r[0]: r[1] for r in rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(settings.languages).collect()}
    if not counts:
        return []
    each = max(1, settings.sample // len(counts))
    u = F.pmod(F.xxhash64(F.col("_id"), F.lit(settings.seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))]), F.col("_lang"))
    drawn = rows.where(F.col("_lang").isin(list(counts))).withColumn("_u", u).where(F.col("_u") < share)
    # the draw is a little more or less than asked for; the limit only guards the driver
    table = drawn.orderBy("_u", "_id", "_text").limit(2 * settings.sample).select("_text", "_lang").toArrow()
    return list(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))


def has_letter(batch_text: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; null has none."""
    ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    seen = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(ch.isalpha() for ch in batch_text[int(i)].as_py() or "")
    return out


PREDICTED = "lang_pred string, score double, lang_rejected boolean"


def predict(docs: DataFrame, model: Model, *, text_column: str = "text") -> DataFrame:
    """Add lang_pred, score and lang_rejected (columns of those names are replaced); whole texts are read.

    A null text, or one without any letter, is ``und`` with score 0 and is
    rejected, as is everything where no language was learned.  Ties go to the
    first language by name.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "lang_rejected")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [PREDICTED])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in slices(batches, text_column, 1 << 18):
            text = batch.column(kept.index(text_column))
            raw, offsets = text_bytes(text)
            if m.languages:
                z, _ = logits(m, raw, offsets)
                p = _softmax(z / m.temperature)
                best = p.argmax(axis=1)
                score = p[np.arange(len(best)), best]
                ok = has_letter(text, raw, offsets)
            else:
                best, score, ok = (np.zeros(batch.num_rows, int), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool))
            lang = [m.languages[b] if o else "und" for b, o in zip(best, ok, strict=True)]
            score = np.where(ok, score, 0.0)
            extra = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(~ok | (score < m.least), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*kept, "lang_pred", "score", "lang_rejected"])

    return rows.mapInArrow(run, schema)


def held_out(column: str = "doc_id"):
    """Rows that must not be learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))
