"""Quality by lines: a linear-chain conditional random field marks content or boilerplate.

Each line with a word has a few measures; Viterbi decoding finds a text's best sequence of labels, and the
share of words in content lines decides whether it stays. Counts of words, symbols and repetition (the
base) are taken over the whole text and reject on their own. The field is trained here in numpy on
a bounded sample of documents labelled by quality: lines of bad documents are boilerplate, those of good
ones content unless the text repeats them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.stored import read, small_batches, spread
from lodestone.llm.text_arrays import SPACE, mix, slices, windows, word_hashes, word_spans

#: Labelled documents that training takes at most, half of either quality if there are so many.
SAMPLE = 1_600
#: Lines of a training sequence; a longer document is several sequences. Training takes so many lines of a document at most.
SEQUENCE, MOST_LINES = 200, 1_000
ITERATIONS, RATE, RIDGE = 150, 0.3, 1e-3
#: The ridge of the transitions: a document's label on all its lines overstates how rarely lines change.
MOVE_RIDGE = 0.2
#: A text stays from this share of its words in content lines on.
CONTENT_SHARE = 0.5
#: A line of a good document is boilerplate to training from this share of words in repeated windows on.
REPEATED = 0.8
LEAST_WORDS = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_BYTE = np.arange(256)
_CLASSES = np.stack([_SYMBOL, _BYTE == ord("|"), _BYTE == ord("!"), (_BYTE >= 65) & (_BYTE <= 90), ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128), (_BYTE >= 48) & (_BYTE <= 57), (_BYTE & 0xC0) != 0x80], 1)
_ENDS = np.zeros(256, bool)
_ENDS[np.frombuffer(b".!?:;\"')", np.uint8)] = True
MEASURES = 12
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass
class Field:
    weights: np.ndarray  # (MEASURES, 2): label 1 is content
    moves: np.ndarray  # (2, 2): from, to
    start: np.ndarray  # (2,)


#: What holds without labels: every line is content.
ALL_CONTENT = Field(np.zeros((MEASURES, 2)), np.array([[0.0, 1.0], [0.0, 1.0]]), np.array([-1.0, 1.0]))


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])


def measured(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice of texts: base counts of each text, measures and words of each line with a word, and the index of each text's first such line."""
    starts, ends, first = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends, lower=False)
    base = np.zeros((len(offsets) - 1, len(BASE)), np.int64)
    base[:, 0] = np.diff(first)
    base[:, 1] = _sums(~SPACE[data] & ((data & 0xC0) != 0x80), offsets)
    base[:, 2] = _sums(_SYMBOL[data], offsets)

    rolled, at = windows(hashes, first, 3)
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(at))
    again = _repeated(rolled, text_of)
    place = np.arange(len(rolled)) + (first[:-1] - at[:-1])[text_of]
    covered = np.zeros(len(hashes), bool)
    for j in range(3):
        covered[place[again] + j] = True
    base[:, 4] = _sums(covered, first)

    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:] |= np.concatenate([data[:-1] == 10, [True]]) if len(data) else True
    line_at = np.flatnonzero(edge)
    words_in = np.searchsorted(starts, line_at)
    full = np.flatnonzero(np.diff(words_in))
    begin, stop = line_at[full], line_at[full + 1]
    cut = stop - (data[stop - 1] == 10)
    line_text = np.searchsorted(offsets, begin, "right") - 1
    whole = word_hashes(data, begin, cut, lower=False)
    repeat = _later(whole, line_text)
    first_line = np.searchsorted(line_text, np.arange(len(offsets)))
    base[:, 3] = np.diff(np.concatenate([[0], np.cumsum(repeat)])[first_line])

    words = np.diff(words_in)[full].astype(float)
    counts = np.stack([np.diff(np.concatenate([[0], np.cumsum(flags[data], dtype=np.int64)])[line_at])[full] for flags in _CLASSES.T], 1).astype(float) if len(full) else np.zeros((0, 7))
    letters = np.maximum(1, counts[:, 3] + counts[:, 4])
    last = data[ends[words_in[full + 1] - 1] - 1] if len(full) else np.zeros(0, np.uint8)
    repeated_words = np.diff(np.concatenate([[0], np.cumsum(covered)])[words_in])[full]
    lines = np.stack(
        [
            np.ones(len(full)),
            np.minimum(1, counts[:, 0] / words),
            np.minimum(1, counts[:, 1] / words * 2),
            np.minimum(1, counts[:, 2] / words),
            counts[:, 3] / letters,
            np.minimum(1, counts[:, 5] / np.maximum(1, counts[:, 6]) * 3),
            words < 3,
            _ENDS[last],
            np.minimum(3, counts[:, 6] / words / 8),
            repeat,
            np.minimum(1, np.log2(1 + words) / 6) * np.maximum(0, 1 - np.maximum.reduce([2 * counts[:, 0] / words, 4 * counts[:, 1] / words, 2 * counts[:, 2] / words, 2 * counts[:, 3] / letters])),
            repeated_words / words,
        ],
        1,
    )
    return base, lines, words, first_line


def _ranked(keys: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts equal keys of a text together, and where a new group begins in it."""
    own = keys ^ mix(text_of.astype(np.uint64))
    order = np.argsort(own, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = own[order][1:] != own[order][:-1]
    return order, new


def _repeated(keys: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    order, new = _ranked(keys, text_of)
    alone = new.copy()
    alone[:-1] &= new[1:]
    out = np.zeros(len(keys), bool)
    out[order] = ~alone
    return out


def _later(keys: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    order, new = _ranked(keys, text_of)
    out = np.zeros(len(keys), bool)
    out[order] = ~new
    return out


def _padded(first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Step by step: (step, sequences that have that line, its index), all sequences at once."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    reach = len(order) - np.searchsorted(lengths[order][::-1], np.arange(1, lengths.max(initial=0) + 1))
    for t, n in enumerate(reach):
        live = order[:n]
        yield t, live, first[:-1][live] + t


def viterbi(field: Field, lines: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best label of each line; first: index of each sequence's first line, and the end."""
    emit = lines @ field.weights
    score = np.zeros((len(first) - 1, 2))
    back = np.zeros((len(lines), 2), np.int8)
    steps = list(_padded(first))
    for t, live, at in steps:
        if t == 0:
            score[live] = field.start + emit[at]
            continue
        paths = score[live][:, :, None] + field.moves
        back[at] = paths.argmax(axis=1)
        score[live] = paths.max(axis=1) + emit[at]
    label = np.zeros(len(lines), np.int8)
    now = score.argmax(axis=1).astype(np.int8)
    lengths = np.diff(first)
    for t, live, at in reversed(steps):
        label[at] = now[live]
        now[live] = back[at, now[live]]
    return label


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def fit(lines: np.ndarray, first: np.ndarray, labels: np.ndarray) -> Field:
    """Maximises the conditional likelihood of the lines' labels by full gradient steps (forward-backward)."""
    field = Field(np.zeros((MEASURES, 2)), np.zeros((2, 2)), np.zeros(2))
    steps = list(_padded(first))
    lengths = np.diff(first)
    gold = np.eye(2)[labels]
    pairs = np.zeros((2, 2))
    inner = np.ones(len(lines), bool)
    inner[first[:-1][lengths > 0]] = False
    later = np.flatnonzero(inner)
    np.add.at(pairs, (labels[later - 1], labels[later]), 1)
    begins = gold[first[:-1][lengths > 0]].sum(axis=0)
    speed = [np.zeros_like(x) for x in (field.weights, field.moves, field.start)]
    for _ in range(ITERATIONS):
        emit = lines @ field.weights
        ahead, behind = np.zeros((len(lines), 2)), np.zeros((len(lines), 2))
        for t, _, at in steps:
            ahead[at] = emit[at] + (field.start if t == 0 else _log_sum(ahead[at - 1][:, :, None] + field.moves, 1))
        for t, live, at in reversed(steps):
            on = at[lengths[live] > t + 1]
            behind[on] = _log_sum(field.moves + (emit[on + 1] + behind[on + 1])[:, None, :], 2)
        whole = ahead + behind
        marginal = np.exp(whole - _log_sum(whole, 1)[:, None])
        joint = ahead[later - 1][:, :, None] + field.moves + (emit[later] + behind[later])[:, None, :]
        joint = np.exp(joint - _log_sum(joint.reshape(len(later), 4), 1)[:, None, None]).sum(axis=0) if len(later) else np.zeros((2, 2))
        grads = [lines.T @ (gold - marginal), pairs - joint, begins - marginal[first[:-1][lengths > 0]].sum(axis=0)]
        for k, x in enumerate((field.weights, field.moves, field.start)):
            speed[k] = 0.9 * speed[k] + grads[k] / max(1, len(lines)) - (MOVE_RIDGE if k == 1 else RIDGE) * x
            x += RATE * speed[k]
    return field


def _sample_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, counts = [], []
        for _, data, offsets in slices(batch.column("text")):
            _, lines, _, first = measured(data, offsets)
            keep = np.arange(len(lines)) - np.repeat(first[:-1], np.diff(first)) < MOST_LINES
            lines, first = lines[keep], np.concatenate([[0], np.cumsum(np.minimum(np.diff(first), MOST_LINES))])
            values.append(lines.astype(np.float32).ravel())
            counts.append(np.diff(first))
        at = np.concatenate([[0], np.cumsum(np.concatenate(counts)) * MEASURES]) if counts else np.zeros(1, int)
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.float32)))
        yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("quality"), lists], ["order", "quality", "lines"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """A field from at most `sample` documents (doc_id, text) with a quality of 0 or 1 in labels (doc_id, quality).

    Documents are taken in the order of a hash of their doc_id; of a doc_id that repeats, the smallest text.
    Of a document the first MOST_LINES lines with a word are learnt from. A doc_id with both qualities teaches
    nothing. Without labels of both kinds every line is content.
    """
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"), F.min("quality").cast("int").alias("least")).where("quality = least").drop("least")
    totals = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return ALL_CONTENT
    hashed = known.withColumn("order", F.xxhash64("doc_id", F.lit(5)))
    share = F.when(F.col("quality") == 1, min(1.0, sample / 2 / totals[1])).otherwise(min(1.0, sample / 2 / totals[0]))
    chosen = hashed.where(F.col("order") < (share - 0.5) * float(1 << 64)).orderBy("order", "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "order", "quality").agg(F.min("text").alias("text"))
    found = texts.mapInArrow(_sample_lines, "order long, quality int, lines array<float>").toArrow()
    values = pa.concat_arrays(found["lines"].chunks) if found.num_rows else pa.array([], pa.list_(pa.float32()))
    at, flat = values.offsets.to_numpy(), values.values.to_numpy()
    rows = sorted(zip(found["order"].to_pylist(), found["quality"].to_pylist(), at[:-1], at[1:], strict=True), key=lambda r: (r[0], r[3] - r[2]))
    lines, first, marks = [np.zeros((0, MEASURES))], [0], [np.zeros(0, np.int64)]
    for _, quality, begin, end in rows:
        own = flat[begin:end].reshape(-1, MEASURES).astype(float)
        for k in range(0, len(own), SEQUENCE):
            lines.append(own[k : k + SEQUENCE])
            first.append(first[-1] + len(lines[-1]))
            marks.append(quality * (lines[-1][:, -1] < REPEATED).astype(np.int64))
    return fit(np.concatenate(lines), np.array(first), np.concatenate(marks))


def _judge(field: Field, content_share: float, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, content = np.zeros((batch.num_rows, len(BASE)), np.int64), np.zeros(batch.num_rows)
            for row, data, offsets in slices(batch.column("text")):
                own, lines, words, first = measured(data, offsets)
                base[row : row + len(own)] = own
                label = viterbi(field, lines, first) if len(lines) else np.zeros(0, np.int8)
                content[row : row + len(own)] = np.diff(np.concatenate([[0.0], np.cumsum(words * label)])[first])
            n = base[:, 0]
            failed = (n < LEAST_WORDS) | (100 * base[:, 4] > 50 * n)
            share = content / np.maximum(1, n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *(pa.array(base[:, k]) for k in range(len(BASE))), pa.array(failed), pa.array(share), pa.array(~failed & (share >= content_share))], [*carried, *BASE, "base_failed", "content_share", "kept"])

    return run


def judged(docs: DataFrame, field: Field, carry: dict[str, str], content_share: float = CONTENT_SHARE) -> DataFrame:
    """The columns of `carry` (name: type) of each row with BASE, base_failed, content_share and kept.

    A null or empty text has no words, fails the base and isn't kept. Lines without a word have no
    label and count nowhere. Texts are read whole; repeated rows get equal answers.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.col(c).cast(t) for c, t in carry.items()], *[] if "text" in carry else [F.col("text").cast("string")])
    schema = ", ".join([*(f"`{c}` {t}" for c, t in carry.items()), *(f"{c} long" for c in BASE), "base_failed boolean, content_share double, kept boolean"])
    return rows.mapInArrow(_judge(field, content_share, list(carry)), schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents"))
    return judged(docs, train(docs, read(spark, sf_dir, "labels")), {"doc_id": "long"})


def kept_only(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their own columns; every row is judged."""
    names = {f"kept_{k}": (c, t) for k, (c, t) in enumerate(docs.dtypes) if c != "text"}
    carried = docs.select(*[F.col(f"`{c}`").alias(name) for name, (c, _) in names.items()], F.col("text").cast("string"))
    rows = judged(carried, train(docs, labels), {name: t for name, (_, t) in names.items()} | {"text": "string"})
    back = {c: name for name, (c, _) in names.items()}
    return rows.where("kept").select(*[F.col(back.get(c, "text")).cast(t).alias(c) for c, t in docs.dtypes])
