"""Language identification by string kernels.

The kernel of two texts counts the n-grams (N bytes of lower-cased letters, other bytes as one blank) that both
hold, over the root of the product of what each holds: a blended-spectrum presence kernel, over hashed n-grams.
Nyström landmarks turn it into features, one-versus-rest ridge regression over these gives a weight for each
landmark and language, and texts are scored in batches: presence matrix x landmarks x weights.

Fitting uses at most per_class labelled rows of each language (those of least row hash), and of these at most
per_class_landmarks of a language as landmarks, in the order of a hash of what they hold, max_landmarks in all or one a
language; all else covers all rows. Whole texts are scored, however long. Texts that are null or hold no letter are
`und` with score 0, as are all texts where there is nothing to learn from. Repeated rows count once in fitting and get equal
predictions; of languages that tie, the first by name wins. No rows give no rows. A caller's columns `lang_pred`, `score` or `_text` are not to be kept under these
names; rename them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LETTER, LOWER, extended, read, slices

N = (1, 2, 3)
DIM_BITS = 14
ROWS = 64
_FOLD = np.where(LETTER, LOWER, 32).astype(np.uint32)
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def presence(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """First row and 0/1 matrix of hashed n-grams, ROWS texts at a time."""
    dim = 1 << DIM_BITS
    for a in range(0, len(off) - 1, ROWS):
        b = min(a + ROWS, len(off) - 1)
        c = _FOLD[buf[off[a] : off[b]]]
        row = np.repeat(np.arange(b - a, dtype=np.int64) << DIM_BITS, np.diff(off[a : b + 1]))
        x = np.zeros((b - a) * dim, np.float32)
        for n in N:
            m = len(c) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n * 0x165667B1 & 0xFFFFFFFF, np.uint32)
            for j in range(n):
                h += c[j : j + m] * _MULT[j]
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x2C1B3C6D)
            same = row[:m] == row[n - 1 :]
            x[(row[:m] + (h >> np.uint32(32 - DIM_BITS)))[same]] = 1
        yield a, x.reshape(b - a, dim)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for s in slices(batches, "_text"):
        for a, x in presence(s.buf, s.off):
            bits = [r.tobytes() for r in np.packbits(x.astype(bool), axis=1)]
            yield pa.RecordBatch.from_arrays([s.column("_lang").slice(a, len(bits)), pa.array(bits, pa.binary())], names=["lang", "bits"])


def fit(rows: list[tuple[str, bytes]], per_class_landmarks: int = 32, max_landmarks: int = 128, ridge: float = 1e-2) -> dict | None:
    """Landmarks and weights from (language, packed presence); the order given does not matter."""
    rows = sorted((r for r in rows if np.frombuffer(r[1], np.uint8).any()), key=lambda r: (r[0], hashlib.blake2b(r[1]).digest()))
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    x = np.unpackbits(np.stack([np.frombuffer(r[1], np.uint8) for r in rows]), axis=1).astype(np.float32)
    x /= np.sqrt(x.sum(1, keepdims=True))
    y = np.array([langs.index(r[0]) for r in rows])
    each = max(1, min(per_class_landmarks, max(max_landmarks, len(langs)) // len(langs)))
    marks = x[np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(langs))])]
    value, vector = np.linalg.eigh((marks @ marks.T).astype(float))
    ok = value > 1e-6 * value[-1]
    whiten = vector[:, ok] / np.sqrt(value[ok])
    z = (x @ marks.T) @ whiten
    z1 = np.hstack([z, np.ones((len(z), 1))])
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    weight = 1 / np.bincount(y)[y][:, None]  # each language counts alike
    beta = np.linalg.solve(z1.T @ (z1 * weight) + ridge / len(langs) * np.eye(z1.shape[1]), z1.T @ (target * weight))
    return {"langs": langs, "marks": np.ascontiguousarray(marks.T), "w": (whiten @ beta[:-1]).astype(np.float32), "b": beta[-1].astype(np.float32)}


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for s in slices(batches, "_text"):
            langs, scores = np.full(s.n, "und", object), np.zeros(s.n)
            lettered = np.zeros(len(s.buf) + 1, np.int64)
            np.cumsum((s.buf >= 128) | LETTER[s.buf], out=lettered[1:])
            some = lettered[s.off[1:]] > lettered[s.off[:-1]]
            for i in np.flatnonzero(some):  # letters of other alphabets, by what Unicode says; most texts have ASCII letters
                t = s.buf[s.off[i] : s.off[i + 1]]
                head = t[:64]
                if not (LETTER[head] & (head < 128)).any() and not (LETTER[t] & (t < 128)).any():
                    some[i] = any(c.isalpha() for c in t.tobytes().decode("utf-8", "replace"))
            if model:
                for a, x in presence(s.buf, s.off):
                    held = np.maximum(x.sum(1, keepdims=True), 1)
                    f = (x @ model["marks"]) / np.sqrt(held) @ model["w"] + model["b"]
                    p = np.clip((f + 1) / 2, 1e-6, 1)
                    top = f.argmax(1)
                    ok = some[a : a + len(x)]
                    langs[a : a + len(x)][ok] = np.array(model["langs"], object)[top][ok]
                    scores[a : a + len(x)][ok] = (p[np.arange(len(x)), top] / p.sum(1))[ok]
            names = [n for n in s.batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(s.column(n) for n in names), pa.array(langs, pa.string()), pa.array(np.minimum(scores, 1.0), pa.float64())], names=[*names, "lang_pred", "score"])

    return score


def learn(labelled: DataFrame, lang: str, text: str, order: Column, per_class: int = 400):
    """Fits on at most per_class rows of each language, those first by order.

    Rows are chosen by order alone, in 64 parts of each language, then in 4, then among these parts' first, so that no task
    gets more than 16 * per_class short rows; their texts follow by a join with the chosen rows.
    """
    src = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), order.alias("_o"))
    top = src.select("_lang", "_o")
    for parts in (64, 4, 1):
        part = Window.partitionBy("_lang", F.pmod(F.xxhash64("_o"), F.lit(parts))).orderBy("_o")
        top = top.withColumn("_k", F.row_number().over(part)).where(F.col("_k") <= per_class)
    chosen = top.select("_lang", "_o").distinct()  # per_class rows a language
    rows = src.join(F.broadcast(chosen), ["_lang", "_o"], "left_semi").dropDuplicates(["_lang", "_o"])
    got = rows.select("_lang", "_text").mapInArrow(_packed, "lang string, bits binary").collect()
    return fit([(r["lang"], bytes(r["bits"])) for r in got])


def predict(docs: DataFrame, model: dict | None, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*keep, F.col(text).alias("_text"))
    return src.mapInArrow(_scorer(shared), extended(src, "lang_pred string, score double"))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    model = learn(docs.where(~held), "lang", "text", F.struct(F.xxhash64("doc_id"), F.xxhash64("text")))
    return predict(docs, model, keep=("doc_id", held))


QUERIES = {"op1_langid": op1_langid}
ORACLE_SQL: dict[str, str] = {}
