"""Language identification by string kernels: n-gram presence, Nyström landmarks, kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractscope.llm.frames import lean
from contractscope.llm.vectors import sample_edge

#: Hash table sizes for byte n-grams of 1, 2, 3 and 4.
SIZES = (256, 4096, 8192, 8192)
_FROM = np.concatenate([[0], np.cumsum(SIZES)])
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint32)
_PRIME = np.uint32(2654435761)


def presence(texts: list[bytes]) -> np.ndarray:
    """One row per text: for each n the hashed n-grams it has, scaled so that equal texts have kernel 1."""
    out = np.zeros((len(texts), _FROM[-1]), np.float32)
    for row, data in zip(out, texts, strict=True):
        code = _FOLD[np.frombuffer(b" " + data + b" ", np.uint8)]
        gram = code
        row[code] = 1
        for n in range(1, len(SIZES)):
            gram = gram[:-1] * np.uint32(257) + code[n:] if n < 4 and len(gram) > 1 else gram[:0]
            shift = np.uint32(32 - SIZES[n].bit_length() + 1)
            row[_FROM[n] + ((gram * _PRIME) >> shift).astype(np.int64)] = 1
    for a, b in zip(_FROM, _FROM[1:], strict=False):
        part = out[:, a:b]
        part /= np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1) * len(SIZES))
    return out


@dataclass
class Model:
    """Landmarks and the weights that turn kernels with them into one score per language."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """One-versus-rest scores, from about -1 (not) to 1 (it is), by two matrix products."""
        return presence(texts) @ self.landmarks.T @ self.weights


def fit(rows: np.ndarray, languages: list[str], n_landmarks: int = 96, ridge: float = 1e-3, seed: int = 5) -> Model:
    """Kernel ridge regression on Nyström features; landmarks are drawn evenly from the languages."""
    names = sorted(set(languages))
    label = np.array([names.index(x) for x in languages])
    rng = np.random.default_rng(seed)
    each = max(1, n_landmarks // len(names))
    marks = np.concatenate([rng.permutation(np.flatnonzero(label == i))[:each] for i in range(len(names))])
    lm = rows[marks]
    value, vector = np.linalg.eigh((lm @ lm.T).astype(float))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    z = (rows @ lm.T).astype(float) @ root
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    size = np.bincount(label, minlength=len(names))
    weight = (len(label) / (len(names) * size))[label][:, None]
    solved = np.linalg.solve(z.T @ (weight * z) + ridge * len(z) * np.eye(z.shape[1]), z.T @ (weight * target))
    return Model(names, lm, (root @ solved).astype(np.float32))


def train(docs: DataFrame, use: Column, per_language: int = 300) -> Model | None:
    """Fit on at most per_language texts of each language, chosen by a hash of doc_id (of the text, without one) among the rows of `use`.

    Only doc_id and lang are read to count the languages. None without any labelled row.
    """
    rows = docs.select("doc_id", "lang", F.encode("text", "UTF-8").alias("text"), F.col("text").rlike(r"\p{L}").alias("ok")).filter(use & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in docs.filter(use & F.col("lang").isNotNull()).groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, sample_edge(1.3 * per_language, n))])
    chosen = rows.filter((F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text")), F.lit(11)), F.lit(1 << 62)) < share[F.col("lang")]) & F.col("ok"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.packbits(presence(batch.column(2).to_pylist()) > 0, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b.tobytes() for b in bits], pa.binary())], names=["doc_id", "lang", "bits"])

    found = sorted(((r["lang"], r["doc_id"], r["bits"]) for r in chosen.select("doc_id", "lang", "text").mapInArrow(lean(grams), "doc_id long, lang string, bits binary").collect()), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2]))
    seen: dict[str, int] = {}
    kept = [x for x in found if seen.setdefault(x[0], 0) < per_language and not seen.update({x[0]: seen[x[0]] + 1})]
    if not kept:
        return None
    rows_ = np.stack([np.unpackbits(np.frombuffer(x[2], np.uint8))[: _FROM[-1]] for x in kept]).astype(np.float32)
    for a, b in zip(_FROM, _FROM[1:], strict=False):
        rows_[:, a:b] /= np.sqrt(np.maximum(rows_[:, a:b].sum(axis=1, keepdims=True), 1) * len(SIZES))
    return fit(rows_, [x[0] for x in kept])


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score (0 to 1) from each whole text; other columns in `keep` pass through.

    A null text, or one without letters, is `und` with score 0; so is everything without a model. Input columns named
    lang_pred or score are replaced. Repeated rows are all kept; an empty table gives an empty result. Narrow: no shuffle.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in ("lang_pred", "score")]
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.encode("text", "UTF-8").alias("_bytes"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_ok"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.schema.fields[:-2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ok = batch.column(len(keep)), np.array(batch.column(len(keep) + 1).to_pylist(), bool)
            names, best = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            rows = np.flatnonzero(ok) if model else []
            for a in range(0, len(rows), 128):
                some = rows[a : a + 128]
                s = model.scores([data[int(i)].as_py() for i in some])
                top = s.argmax(axis=1)
                names[some] = np.array(model.languages, object)[top]
                best[some] = np.clip((s[np.arange(len(some)), top] + 1) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(best, pa.float64())], names=[*keep, "lang_pred", "score"])

    return slim.mapInArrow(lean(run), f"{fields}lang_pred string, score double")


def learnable() -> Column:
    """Rows that may be learnt from: those whose crc32 of doc_id, as text, leaves no 2 when divided by 4, or without doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.lit(True))
