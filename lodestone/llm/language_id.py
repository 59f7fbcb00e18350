"""Language of whole texts: averaged hashed subword embeddings under a linear softmax.

Subwords are runs of 1 to 4 bytes of the text, letters lowered and all ASCII that isn't a letter made one
boundary sign. Each is hashed to a row of an embedding table; a text is the mean of its rows. Table and
softmax are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows. A
temperature fitted on a part of the sample that training didn't see makes the score a probability, and
a text whose probability is low is rejected, as one of a language that isn't learnt mostly is.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.stored import read, small_batches, spread
from lodestone.llm.text_arrays import slices

#: Labelled rows that training takes at most, over all languages.
SAMPLE = 1_200
MOST_LANGUAGES = 1_000
BUCKET_BITS = 17
DIMENSIONS = 16
EPOCHS = 8
RATE = 40.0
LONGEST = 4
#: One in so many sampled rows calibrates.
CALIBRATES = 4
#: A text goes unless its language is right with this chance by its calibrated score; of calibrating rows no more than this share goes.
LEAST_SURE, MOST_REJECTED = 0.7, 0.002
#: Labels that calibration takes to be drawn at random, so that a part without errors doesn't make every score 1.
DOUBT = 0.01
UNKNOWN = "und"

_SIGN = np.arange(256, dtype=np.uint32)
_SIGN[65:91] += 32
_SIGN[:65] = _SIGN[91:97] = _SIGN[123:128] = 32


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # for each bucket its embedding times the softmax's weights
    bias: np.ndarray
    temperature: float
    reject_below: float


def _buckets(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each length of subword the bucket at each place where one begins."""
    sign = _SIGN[data]
    rolled = np.zeros(len(sign), np.uint32)
    for n in range(1, LONGEST + 1):
        rolled = rolled[: len(sign) - n + 1] * np.uint32(257) + sign[n - 1 :] + np.uint32(n)
        yield n, ((rolled * np.uint32(2654435761)) ^ (rolled >> np.uint32(7)) * np.uint32(2246822519)) >> np.uint32(32 - BUCKET_BITS)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, sums = [], []
        for _, data, offsets in slices(batch.column("text"), 1):
            counts = np.zeros(1 << BUCKET_BITS, np.int64)
            for _, b in _buckets(data):
                counts += np.bincount(b, minlength=len(counts))
            found.append(np.flatnonzero(counts).astype(np.int32))
            sums.append(counts[found[-1]].astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("lang"), pa.array(found, pa.list_(pa.int32())), pa.array(sums, pa.list_(pa.int32()))], ["order", "lang", "buckets", "counts"])


def _fit(languages: list[str], rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """rows: (buckets, counts, index of the language) in a fixed order."""
    rng = np.random.default_rng(7)
    weights = np.linalg.qr(rng.normal(size=(max(DIMENSIONS, len(languages)), len(languages))))[0].T.astype(np.float32)
    table, bias = np.zeros((1 << BUCKET_BITS, weights.shape[1]), np.float32), np.zeros(len(languages), np.float32)
    rows = [(b, (c / c.sum()).astype(np.float32), y) for b, c, y in rows if len(b)]
    held = [r for k, r in enumerate(rows) if k % CALIBRATES == 0]
    kept = [r for k, r in enumerate(rows) if k % CALIBRATES] or rows
    step, steps = 0, max(1, EPOCHS * len(kept))
    for _ in range(EPOCHS):
        for k in rng.permutation(len(kept)):
            b, share, y = kept[k]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = share @ table[b]
            z = weights @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            table[b] -= (rate * share)[:, None] * (p @ weights)[None, :]
            weights -= 0.01 * rate / RATE * p[:, None] * hidden[None, :]
            bias -= 0.01 * rate / RATE * p
    table = table @ weights.T
    z = np.array([share @ table[b] + bias for b, share, _ in held or kept])
    y = np.array([y for *_, y in held or kept])

    def probabilities(t: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.05, 20, 60)
    loss = []
    for t in grid:
        logs = np.log(probabilities(t) + 1e-12)
        loss.append(-((1 - DOUBT) * logs[np.arange(len(y)), y] + DOUBT * logs.mean(axis=1)).mean())
    temperature = float(grid[int(np.argmin(loss))])
    surest = probabilities(temperature).max(axis=1)
    return Model(languages, table.astype(np.float32), bias, temperature, float(min(LEAST_SURE, np.quantile(surest, MOST_REJECTED))))


def train(docs: DataFrame, may_learn: Column, sample: int = SAMPLE) -> Model | None:
    """A model from at most `sample` rows of docs (text, lang) that may be learnt from; None if there is none.

    Of each language, as many different texts are taken in the order of a hash of their text, if it has them;
    copies are one text. Null or letterless texts and null languages teach nothing. A model holds at most
    MOST_LANGUAGES languages, those of the most different texts; a warning says if there are more.
    """
    rows = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    hashed = rows.withColumn("order", F.xxhash64("text", F.lit(11)))
    keys = hashed.select("order", "lang").distinct()
    counted = keys.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(counted) > MOST_LANGUAGES:
        warnings.warn(f"only the {MOST_LANGUAGES} languages of the most texts are learnt", stacklevel=2)
    totals = {r["lang"]: r["n"] for r in counted[:MOST_LANGUAGES]}
    if not totals:
        return None
    languages = sorted(totals)
    each = max(1, sample // len(languages))
    shares = keys.sparkSession.createDataFrame([(lang, min(1.0, (2 * each + 20) / n)) for lang, n in totals.items()], "lang string, part double")
    # more hashes than needed of each language, so that its window is small; then the first ones of each
    few = keys.join(F.broadcast(shares), "lang").where((F.col("part") >= 1) | (F.col("order") < (F.col("part") - 0.5) * float(1 << 64)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    first = few.withColumn("rank", rank).where(F.col("rank") <= each).select("order", "lang")
    chosen = hashed.join(F.broadcast(first), ["order", "lang"]).groupBy("order", "lang").agg(F.max("text").alias("text"))
    found = chosen.mapInArrow(_features, "order long, lang string, buckets array<int>, counts array<int>").toArrow().combine_chunks().sort_by([("order", "ascending"), ("lang", "ascending")])
    if not found.num_rows:
        return None
    return _fit(languages, [(b, c, languages.index(lang)) for b, c, lang in zip(_arrays(found["buckets"]), _arrays(found["counts"]), found["lang"].to_pylist(), strict=True)])


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    one = pa.concat_arrays(column.chunks)
    at, values = one.offsets.to_numpy(), one.values.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _predict(model, with_text: bool):
    left_out = ("letters",) if with_text else ("text", "letters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            best, surest = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for row, data, offsets in slices(batch.column("text")):
                z, n = np.zeros((len(offsets) - 1, len(m.languages))), np.zeros(len(offsets) - 1)
                for length, b in _buckets(data) if len(data) else ():
                    starts = offsets[:-1]
                    ends = np.maximum(starts, offsets[1:] - length + 1)
                    full = np.flatnonzero(ends > starts)
                    if len(full):
                        values = np.concatenate([m.table[b], np.zeros((1, z.shape[1]), np.float32)])
                        z[full] += np.add.reduceat(values, np.stack([starts[full], ends[full]], 1).ravel(), axis=0, dtype=np.float64)[::2]
                        n[full] += ends[full] - starts[full]
                z = (z / np.maximum(n, 1)[:, None] + m.bias) / m.temperature
                e = np.exp(z - z.max(axis=1, keepdims=True))
                e /= e.sum(axis=1, keepdims=True)
                best[row : row + len(e)], surest[row : row + len(e)] = e.argmax(axis=1), e.max(axis=1)
            known = np.array(batch.column("letters").fill_null(False).to_numpy(zero_copy_only=False), bool)
            lang = np.where(known, np.array([*m.languages], object)[best], UNKNOWN)
            score = np.where(known, surest, 0.0)
            names = [c for c in batch.schema.names if c not in left_out]
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score), pa.array(known & (score >= m.reject_below))], [*names, "lang_pred", "score", "accepted"])

    return run


def identify(docs: DataFrame, model: Model | None, keep: dict[str, str], with_text: bool = False) -> DataFrame:
    """The columns of `keep` (name: type) of each row, and the text if asked for, with lang_pred, score (0 to 1) and accepted.

    A null text, an empty one and one without letters is `und` with score 0 and isn't accepted; so is
    every text without a model. Texts are read whole; repeated rows get equal answers.
    """
    small_batches(docs.sparkSession)
    text = docs.select(*[F.col(c).cast(t) for c, t in keep.items()], F.col("text").cast("string"), F.col("text").rlike(r"\p{L}").alias("letters"))
    if model is None:
        return text.select(*keep, *["text"] * with_text, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"{c} {t}" for c, t in keep.items()), *["text string"] * with_text])
    return text.mapInArrow(_predict(sent, with_text), schema + ", lang_pred string, score double, accepted boolean")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents"))
    model = train(docs, ~held_out())
    return identify(docs.withColumn("held_out", held_out()), model, {"doc_id": "long", "held_out": "boolean"})


def accepted_only(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is identified; a row's own lang isn't an input of its prediction.

    Every row is judged: those without text or letters and those under the calibrated score go.
    """
    model = train(docs, ~held_out())
    names = {f"kept_{k}": (c, t) for k, (c, t) in enumerate(docs.dtypes) if c != "text"}
    carried = docs.select(*[F.col(f"`{c}`").alias(name) for name, (c, _) in names.items()], F.col("text").cast("string"))
    judged = identify(carried, model, {name: t for name, (_, t) in names.items()}, with_text=True)
    back = {c: name for name, (c, _) in names.items()}
    return judged.where("accepted").select(*[F.col(back.get(c, "text")).cast(t).alias(c) for c, t in docs.dtypes])
