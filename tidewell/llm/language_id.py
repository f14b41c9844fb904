"""Language identification with string kernels.

The kernel of two texts is the blended spectrum of presence n-grams: how many byte n-grams of
each length up to `longest` they share, over the root of what each has. A bounded sample of
labelled texts gives Nystroem landmarks and one-versus-rest kernel ridge regression on their
features. Scoring keeps the n-grams of the landmarks alone (no other can be shared with one);
a batch's kernel values are one product of its presence matrix with the landmarks', and its
scores one more product.

Defined results: a null text, or one without a letter, is `und` with score 0; without any
labelled text to learn from all rows are `und`; rows that repeat a doc_id are scored each;
an empty table gives no rows; other columns are not read for a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
BATCH = 256


def spectrum(text: str, longest: int) -> np.ndarray:
    """The distinct byte n-grams, n = 1..longest, of the lower-cased text; n is in the top byte."""
    raw = np.frombuffer(" ".join(text.lower().split()).encode(), np.uint8).astype(np.uint64)
    out, code = [], np.zeros(len(raw), np.uint64)
    for n in range(1, longest + 1):
        if len(raw) < n:
            break
        code = (code[: len(raw) - n + 1] << np.uint64(8)) | raw[n - 1 :]
        if n <= 2:
            seen = np.flatnonzero(np.bincount(code.astype(np.int64), minlength=1)).astype(np.uint64)
        else:
            seen = np.unique(code)
        out.append(seen | np.uint64(n << 56))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class KernelModel:
    """Landmarks' n-grams and the ridge's weights."""

    def __init__(self, grams: np.ndarray, presence: np.ndarray, norms: np.ndarray, weights: np.ndarray, labels: list[str], longest: int):
        self.grams, self.presence, self.norms, self.weights, self.labels, self.longest = grams, presence, norms, weights, labels, longest

    def kernel(self, spectra: list[np.ndarray]) -> np.ndarray:
        """Kernel values of a batch against the landmarks (sparse presence rows times the landmarks' matrix)."""
        out = np.zeros((len(spectra), len(self.norms)), np.float32)
        for i, s in enumerate(spectra):
            at = np.searchsorted(self.grams, s)
            at[at == len(self.grams)] = 0
            at = at[self.grams[at] == s]
            out[i] = np.add.reduce(self.presence[at], axis=0, dtype=np.int32) / max(1.0, np.sqrt(len(s)))
        return out / self.norms

    def scores(self, texts: list[str]) -> np.ndarray:
        k = self.kernel([spectrum(t, self.longest) for t in texts])
        return np.c_[k, np.ones(len(k), np.float32)] @ self.weights


def fit(texts: list[str], labels: list[str], landmarks: int, ridge: float, longest: int) -> KernelModel:
    """Nystroem kernel ridge regression, one column of targets for each label.

    The first `landmarks` texts, dealt over the labels in turn, are the landmarks.
    """
    names = sorted(set(labels))
    by = {c: [i for i, x in enumerate(labels) if x == c] for c in names}
    turn = [by[c][k] for k in range(max(map(len, by.values()))) for c in names if k < len(by[c])]
    spectra = [spectrum(t, longest) for t in texts]
    chosen = [spectra[i] for i in turn[: max(landmarks, len(names))]]
    grams = np.unique(np.concatenate(chosen))
    presence = np.zeros((len(grams), len(chosen)), np.uint8)
    for j, s in enumerate(chosen):
        presence[np.searchsorted(grams, s), j] = 1
    norms = np.sqrt(np.maximum(1, [len(s) for s in chosen])).astype(np.float32)
    model = KernelModel(grams, presence, norms, np.zeros((len(chosen) + 1, len(names)), np.float32), names, longest)
    k_nm, k_mm = model.kernel(spectra).astype(float), model.kernel(chosen).astype(float)
    # Nystroem features are k_nm @ k_mm^(-1/2); the ridge's weights fold that product in
    value, vector = np.linalg.eigh((k_mm + k_mm.T) / 2)
    good = value > 1e-6 * value.max()
    half = vector[:, good] / np.sqrt(value[good])
    z = np.c_[k_nm @ half, np.ones(len(k_nm))]
    y = np.array([[1.0 if x == c else -1.0 for c in names] for x in labels])
    share = np.array([len(names) and len(labels) / (len(names) * len(by[x])) for x in labels])[:, None]  # each label weighs alike
    beta = np.linalg.solve(z.T @ (share * z) + ridge * np.eye(z.shape[1]), z.T @ (share * y))
    model.weights = np.r_[half @ beta[:-1], beta[-1:]].astype(np.float32)
    return model


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, per_label: int, most: int) -> list[tuple[str, str]]:
    """(text, label) of at most per_label learnable rows of every label, by hash order; fewer of each where labels are many.

    At most `most` rows come to the driver, or one for each label if that is more.

    Rows of a label are dealt to salts first and only each salt's first rows meet, so that no
    task ranks a whole label.
    """
    from pyspark.sql import Window as W

    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.trim("text") != ""))
    labels = known.select("lang").distinct().count()
    per_label = min(per_label, max(1, most // max(1, labels)))
    slim = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    first = W.partitionBy("lang", "salt").orderBy("h", "doc_id")
    part = slim.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(256))).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= per_label)
    last = W.partitionBy("lang").orderBy("h", "doc_id")
    chosen = part.withColumn("r", F.row_number().over(last)).filter(F.col("r") <= per_label).select("doc_id", "lang")
    some = known.join(F.broadcast(chosen.distinct()), ["doc_id", "lang"], "left_semi")
    rows = some.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()  # at most `most` rows, also where rows are repeated
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]


def identify(docs: DataFrame, per_label: int = 250, landmarks: int = 96, ridge: float = 0.1, longest: int = 3, most: int = 16_000) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    per_label bounds a label's rows that the model is fitted on, `most` all of them; every label
    is learned, with one landmark or more, and every row is scored.
    """
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    sample = labelled_sample(src, per_label, most)
    model = fit([t for t, _ in sample], [x for _, x in sample], landmarks, ridge, longest) if sample else None
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the landmarks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                texts = part.column("text").to_pylist()
                good = [i for i, t in enumerate(texts) if m and has_letter(t)]
                pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if good:
                    s = m.scores([texts[i] for i in good])
                    e = np.exp(4 * (s - s.max(axis=1, keepdims=True)))
                    p = e / e.sum(axis=1, keepdims=True)
                    for i, k, v in zip(good, s.argmax(axis=1), p.max(axis=1)):
                        pred[i], score[i] = m.labels[k], float(min(1.0, v))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return src.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
