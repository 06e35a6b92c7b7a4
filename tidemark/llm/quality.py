"""Quality rules: fixed base rules, and a logistic regression on hashed word and character n-grams.

The regression has two heads, one for good quality and one for toxic text, each trained on the label
rows, probability-calibrated on rows held out, and scored in Arrow batches against a fixed threshold.
A feature is the presence of a lower-case word, of five lower-case bytes in a row, or of three bytes
in a row, named by a 64-bit hash. Only features whose share differs clearly between the classes get a
weight, so a long text's many common features don't add up to a verdict.

The labelled texts stay in the executors. They are gone through three times: for tallies of hash buckets,
which say where clear features can be; for the counts of the features in those buckets; and for the
chosen features of each text. The driver gets the chosen features' numbers only, and fits the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import packed, picked, unpacked
from .scratch import small_batches, stored
from .words import ALNUM_WORDS, LOWER, SPACE_WORDS, Words, mix, pieces, windows

#: Labelled rows that training reads at most (those whose ids hash lowest), features with a weight in a head.
TRAIN_ROWS, FEATURES = 8000, 1500
#: Features are looked for in this many times FEATURES buckets of a head; standard errors that make a difference clear.
_OPEN, _SURE = 4, 4.0
#: A document is kept with P(good) of at least the first and P(toxic) under the second.
GOOD, TOXIC = 0.5, 0.5
_BUCKETS, _SLICE = 1 << 21, 1 << 15
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def base_columns(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    w = Words(texts, SPACE_WORDS)
    inside = SPACE_WORDS[w.data]

    def total(x: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(x, dtype=np.int64)][np.minimum(w.doc_starts, len(x))])

    grams = windows(w.hashes(), 5)
    dup, again = [], []
    for i, (a, b) in enumerate(zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True)):
        seen, n = set(), 0
        for line in w.data[w.doc_starts[i] : w.doc_starts[i + 1] - 1].tobytes().split(b"\n"):
            n += line in seen and bool(line.strip())
            seen.add(line)
        dup.append(n)
        n = 0
        if b - a > 5:
            _, which, count = np.unique(grams[a : b - 4], return_inverse=True, return_counts=True)
            at = np.flatnonzero(count[which] > 1)
            if len(at):
                n = 5 + int(np.minimum(np.diff(at), 5).sum())
        again.append(n)
    return {"n_words": w.counts.astype(np.int64), "word_chars": total(inside & ((w.data & 0xC0) != 0x80)), "n_symbols": total(_SYMBOLS[w.data]), "n_dup_lines": np.array(dup, np.int64), "n_repeat_words": np.array(again, np.int64)}


def base_failed(x: dict[str, np.ndarray], least_words: int = 10, most_repeat_percent: int = 20) -> np.ndarray:
    return (x["n_words"] < least_words) | (100 * x["n_repeat_words"] > most_repeat_percent * x["n_words"])


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    x = np.zeros(max(len(data) - n + 1, 0), np.uint64)
    for j in range(n):
        x = (x << np.uint64(8)) | data[j : len(data) - n + 1 + j]
    return mix(x, 1000 + n)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all n-grams in some texts, repeats included."""
    w = Words(texts, ALNUM_WORDS, lower=True)
    raw = Words(texts, ALNUM_WORDS).data
    starts = w.doc_starts[:-1]

    def own(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(starts, at, "right") - 1

    out = [(mix(w.hashes(), 1001), own(w.starts))]
    for data, n in ((LOWER[raw], 5), (raw, 3)):
        at = np.arange(1, max(len(data) - n + 1, 1))
        doc = own(at)
        fits = at + n <= (w.doc_starts[1:] - 1)[doc]
        out.append((_grams(data, n)[1:][fits], doc[fits]))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


class Head(NamedTuple):
    """Sorted feature hashes with weights, the bias, and the calibration: p = sigmoid(a * score + b)."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    a: float
    b: float


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logistic(row: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, size: int, l2: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights of `size` features and bias by full-batch Adam; deterministic. The features' values are given by row and column."""
    w, m, v = (np.zeros(size + 1, np.float64) for _ in range(3))
    if not len(y):
        return w[:-1], 0.0
    for t in range(1, steps + 1):
        e = _sigmoid(np.bincount(row, w[column] * value, len(y)) + w[-1]) - y
        g = np.r_[np.bincount(column, e[row] * value, size) / len(y) + l2 * w[:-1], e.mean()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _clear(k1: np.ndarray, k0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How clearly (in standard errors) the shares k1 / n1 and k0 / n0 differ; 0 for what fewer than four texts have."""
    p = (k1 + k0) / (n1 + n0)
    return np.where(k1 + k0 >= 4, np.abs(k1 / n1 - k0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12), 0)


def _bucket(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(_BUCKETS - 1)).astype(np.int64)


def _distinct(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The distinct features of each text."""
    h, doc = features(b.column("text"))
    order = np.argsort(doc, kind="stable")
    for x in np.split(h[order], np.searchsorted(doc[order], np.arange(1, len(b)))):
        yield np.unique(x)


_HEADS = ("quality", "toxic")


def _labels(b: pa.RecordBatch) -> np.ndarray:
    return np.array([b.column(c).to_numpy() for c in _HEADS], np.int64)


def _open_buckets(fit: DataFrame, n: np.ndarray, most: int) -> list[np.ndarray]:
    """For each head, the buckets, `most` at most, whose shares differ most clearly between its classes. n: texts by head and class."""

    def tally(batches):
        total = np.zeros((2, 2, _BUCKETS), np.int32)
        for b in batches:
            for p in pieces(iter([b]), most=1 << 18):
                for x, y in zip(_distinct(p), _labels(p).T.tolist(), strict=True):
                    k = np.unique(_bucket(x))
                    for head, label in enumerate(y):
                        total[head, label][k] += 1
        for at in range(0, _BUCKETS, _SLICE):
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total[:, :, at : at + _SLICE].tobytes()], pa.binary())], ["at", "counts"])

    def clear(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.int32).reshape(2, 2, _SLICE) for x in table.column("counts").to_pylist()], axis=0)
        z = np.array([_clear(k[1], k[0], *n[head, ::-1]) for head, k in enumerate(total)])
        head, bucket = np.nonzero(z > _SURE)
        return pa.table({"head": pa.array(head.astype(np.int32)), "bucket": pa.array(bucket + table.column("at")[0].as_py()), "z": pa.array(z[head, bucket])})

    found = stored(fit.mapInArrow(tally, "at long, counts binary").groupBy("at").applyInArrow(clear, "head int, bucket long, z double"))
    return [np.array([r.bucket for r in found.where(F.col("head") == i).orderBy(F.desc("z"), "bucket").limit(most).collect()], np.int64) for i in range(2)]


def _chosen(fit: DataFrame, n: np.ndarray, most: int) -> list[np.ndarray]:
    """For each head, the sorted hashes of the features, `most` at most, whose shares differ most clearly between its classes."""
    may = np.zeros((2, _BUCKETS), bool)
    for row, own in zip(may, _open_buckets(fit, n, _OPEN * most), strict=True):
        row[own] = True
    sent = fit.sparkSession.sparkContext.broadcast(np.packbits(may, axis=1))

    def count(batches):
        may = np.unpackbits(sent.value, axis=1).astype(bool)
        for b in pieces(batches, most=1 << 18):
            texts, y = list(_distinct(b)), _labels(b)
            for head in range(2):
                own = [x[may[head][_bucket(x)]] for x in texts]
                f, which = np.unique(np.concatenate(own), return_inverse=True)
                of = np.repeat(y[head], [len(x) for x in own])
                k1, k = (np.bincount(which, w, len(f)).astype(np.int64) for w in (of, None))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), head, np.int32)), pa.array(f.view(np.int64)), pa.array(k1), pa.array(k - k1)], ["head", "f", "k1", "k0"])

    found = stored(fit.mapInArrow(count, "head int, f long, k1 long, k0 long").groupBy("head", "f").agg(F.sum("k1").alias("k1"), F.sum("k0").alias("k0")))
    out = []
    for i in range(2):
        n0, n1 = (float(x) for x in n[i])
        share = (F.col("k1") + F.col("k0")) / F.lit(n0 + n1)
        z = F.abs(F.col("k1") / F.lit(n1) - F.col("k0") / F.lit(n0)) / F.sqrt(share * (1 - share) * F.lit(1 / n1 + 1 / n0) + F.lit(1e-12))
        best = found.where((F.col("head") == i) & (F.col("k1") + F.col("k0") >= 4)).select("f", z.alias("z")).where(F.col("z") > _SURE).orderBy(F.desc("z"), "f").limit(most)
        out.append(np.sort(np.array([r.f for r in best.collect()], np.int64).view(np.uint64)))
    return out


def _found(hashes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of the sorted hashes are among the features x."""
    at = np.minimum(np.searchsorted(hashes, x), max(len(hashes) - 1, 0))
    return at[hashes[at] == x] if len(hashes) else at[:0]


def _head(hashes: np.ndarray, found: list[np.ndarray], y: np.ndarray, held: np.ndarray) -> Head:
    """found: which of the hashes each text has. held: rows for calibration only."""
    row, column = np.repeat(np.arange(len(y)), [len(x) for x in found]), np.concatenate([np.empty(0, np.int64), *found])
    of_fit = ~held[row]
    weights, bias = _logistic((np.cumsum(~held) - 1)[row[of_fit]], column[of_fit], np.ones(int(of_fit.sum())), y[~held], len(hashes))
    score = (np.bincount(row, weights[column], len(y)) + bias)[held]
    a, b = 1.0, 0.0
    if held.any() and 0 < y[held].mean() < 1:
        (a,), b = _logistic(np.arange(len(score)), np.zeros(len(score), np.int64), score, y[held], 1)
    return Head(hashes, weights, bias, float(a), float(b))


class Model(NamedTuple):
    good: Head
    toxic: Head


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, most: int = FEATURES) -> Model:
    """Both heads, from at most `rows` labelled rows (those whose ids hash lowest); a fifth is held out for calibration.

    most: features with a weight in a head. Rows with a null id, text or label are not used, nor labels
    that name no document. Label rows that say the same of an id count once, others each; of documents
    that repeat an id the text that hashes lowest counts. Without labels both heads are without weights
    and say 1/2, or what the only class there is says.
    """
    small_batches(docs.sparkSession)
    some = picked(labels, id="doc_id", quality="quality", toxic="toxic").dropna().distinct()
    some = some.withColumn("h", F.xxhash64("id")).orderBy("h", "quality", "toxic").limit(rows)
    texts = picked(docs, id=id_col, text=text_col).where("text is not null and id is not null")
    got = texts.join(F.broadcast(some), "id").groupBy("h", "quality", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = got.select("h", F.col("quality").cast("int"), F.col("toxic").cast("int"), "text", (F.pmod(F.xxhash64("h", F.lit(5)), F.lit(5)) == 0).alias("held"))
    got = stored(got.repartition(8, "h"))
    fit = got.where("not held").select(*_HEADS, "text")
    n = np.zeros((2, 2), np.int64)
    for r in fit.groupBy(*_HEADS).count().collect():
        n[0, r.quality] += r["count"]
        n[1, r.toxic] += r["count"]
    hashes = _chosen(fit, np.maximum(n, 1), most)
    sent = docs.sparkSession.sparkContext.broadcast(hashes)

    def found(batches):
        for b in pieces(batches, most=1 << 18):
            own = [[_found(x, f).astype("<u2").tobytes() for x in sent.value] for f in _distinct(b)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("h", *_HEADS, "held")), *(pa.array([x[i] for x in own], pa.binary()) for i in range(2))], ["h", *_HEADS, "held", "good", "bad"])

    rows_ = got.mapInArrow(found, "h long, quality int, toxic int, held boolean, good binary, bad binary").toArrow()
    rows_ = rows_.sort_by([(c, "ascending") for c in ("h", *_HEADS)])
    held = rows_.column("held").to_numpy().astype(bool)
    heads = []
    for i, (label, column) in enumerate(zip(_HEADS, ("good", "bad"), strict=True)):
        which = [np.frombuffer(x, "<u2").astype(np.int64) for x in rows_.column(column).to_pylist()]
        heads.append(_head(hashes[i], which, rows_.column(label).to_numpy().astype(np.int64), held))
    return Model(*heads)


def _scores(head: Head, bits: np.ndarray, h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Calibrated probabilities of n texts with the n-grams (h, doc). bits: the head's hashes modulo its length."""
    score = np.full(n, head.bias)
    if len(head.hashes):
        may = np.flatnonzero(bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(head.hashes, h[may]), len(head.hashes) - 1)
        real = head.hashes[at] == h[may]
        pair = np.unique(doc[may][real] * len(head.hashes) + at[real])
        np.add.at(score, pair // len(head.hashes), head.weights[pair % len(head.hashes)])
    return _sigmoid(head.a * score + head.b)


def judged(docs: DataFrame, model: Model, *, text_col: str = "text", good: float = GOOD, toxic: float = TOXIC, text: bool = True) -> DataFrame:
    """docs with struct `rules`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, p_good, p_toxic, kept.

    Words are runs of bytes other than ASCII white space. base_failed: under 10 words, or over 20 % of
    words in 5-word windows that the text has more than once. kept: not base_failed, p_good >= good and
    p_toxic < toxic. Null and empty texts have no words, so they fail. All rows and columns come back as
    they are, whatever their names, and the struct after them; if a column is named rules, in upper or
    lower case, the struct's name has a number after it. text=False leaves the text out.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        heads = []
        for head in sent.value:
            bits = np.zeros(1 << 20, bool)
            bits[(head.hashes & np.uint64(len(bits) - 1)).astype(np.int64)] = True
            heads.append((head, bits))
        for b in pieces(batches, most=1 << 18):
            x = base_columns(b.column("text"))
            failed = base_failed(x)
            h, doc = features(b.column("text"))
            p_good, p_toxic = (_scores(head, bits, h, doc, len(b)) for head, bits in heads)
            cols = [*(pa.array(x[c]) for c in names), pa.array(failed), pa.array(p_good), pa.array(p_toxic), pa.array(~failed & (p_good >= good) & (p_toxic < toxic))]
            verdict = pa.StructArray.from_arrays(cols, [*names, "base_failed", "p_good", "p_toxic", "kept"])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in back), verdict], [*back, "rules"])

    wide, back = packed(docs, text_col), ["row", *["text"] * text]
    rules = "struct<" + ", ".join(f"{c}: bigint" for c in names) + ", base_failed: boolean, p_good: double, p_toxic: double, kept: boolean>"
    out = wide.mapInArrow(run, T.StructType([*wide.select(*back).schema.fields, *T.StructType.fromDDL(f"rules {rules}").fields]))
    return unpacked(out, docs, text_col, "rules", text=text)
