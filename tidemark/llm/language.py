"""Language identification with string kernels.

The kernel of two texts is the mean, over lengths of 2, 3 and 4 bytes, of the cosine of their n-gram presence
vectors (each n-gram hashed to one of ``SLOTS`` places; letters in lower case, other ASCII characters as one
space). Landmark texts give the Nyström features; one-versus-rest kernel ridge regression is solved on them.
A text's score is linear in its presence vectors, so landmarks and coefficients are folded into one weight
matrix, and a batch of whole texts is scored by a matrix product for each n-gram length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_slices

LENGTHS, SLOTS = (2, 3, 4), 1 << 15
LANDMARKS, SAMPLE = 64, 400  # of each language at most: landmarks, and rows that the regression is fitted on
LANGUAGES, ROWS = 128, 6_000  # languages that are learned, the most frequent, and rows of all of them
CHUNK = 1 << 19  # bytes whose n-grams are worked out at once
RIDGE = 0.1
NONE = "und"
_SPACED = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_MULTIPLY = np.uint32(0x9E3779B1)


def _has_letter(text: str, spaced: bytes) -> bool:
    return any(97 <= c <= 122 for c in spaced[:64]) or any(map(str.isalpha, text))


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each text and n-gram length the places that occur (bytes 0 and 1), and whether it has a letter."""
    raw = [b" " + (t or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED) + b" " for t in texts]
    letters = np.array([_has_letter(t or "", r) for t, r in zip(texts, raw, strict=True)], bool)
    ends = np.cumsum([len(r) for r in raw])
    whole = np.frombuffer(b"".join(raw) + b"\0" * max(LENGTHS), np.uint8)
    bits = np.zeros((len(raw), len(LENGTHS), SLOTS), np.uint8)
    for at in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):  # bytes behind a chunk end its last n-grams
        to = min(at + CHUNK, int(ends[-1]))
        b = whole[at : to + max(LENGTHS)].astype(np.uint32)
        row = np.searchsorted(ends, np.arange(at, to), "right")
        left, total, code = ends[row] - np.arange(at, to), to - at, b[: to - at].copy()
        for n in range(1, max(LENGTHS)):
            code = code << np.uint32(8) | b[n : n + total]
            if n + 1 in LENGTHS:
                k, ok = LENGTHS.index(n + 1), left > n
                place = (code * _MULTIPLY) >> np.uint32(32 - SLOTS.bit_length() + 1)
                bits[row[ok], k, place[ok]] = 1
    return bits, letters


def _scaled(bits: np.ndarray) -> np.ndarray:
    """Presence vectors of unit length, one block for each n-gram length, so that a dot product is the kernel."""
    norm = np.sqrt(np.maximum(bits.sum(2, dtype=np.int64), 1) * len(LENGTHS)).astype(np.float32)
    return (bits / norm[:, :, None]).reshape(len(bits), -1)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # places of all n-gram lengths by languages


def fit(rows: list[tuple[str, bytes]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """One-versus-rest kernel ridge regression on rows of a language and packed presence vectors; the first
    ``landmarks`` rows of each language are the Nyström landmarks."""
    names = sorted({lang for lang, _ in rows})
    if not names:
        return Model([], np.zeros((len(LENGTHS) * SLOTS, 0), np.float32))

    def vectors(part):
        return _scaled(np.unpackbits(np.frombuffer(b"".join(b for _, b in part), np.uint8)).reshape(-1, len(LENGTHS), SLOTS))

    y = np.array([[1.0 if lang == name else 0.0 for name in names] for lang, _ in rows])
    marks = vectors([rows[i] for k in range(len(names)) for i in np.flatnonzero(y[:, k])[:landmarks]])
    k_mm = (marks @ marks.T).astype(np.float64)
    k_nm = np.concatenate([vectors(rows[i : i + 64]) @ marks.T for i in range(0, len(rows), 64)]).astype(np.float64)
    weight = (y / y.sum(0)).sum(1)[:, None] * len(y) / len(names)  # each language weighs the same
    dual = np.linalg.solve(k_nm.T @ (weight * k_nm) + ridge * k_mm + 1e-6 * np.eye(len(marks)), k_nm.T @ (weight * y))
    return Model(names, marks.T @ dual.astype(np.float32))


def score(model: Model, texts: list[str | None], batch: int = 64) -> tuple[list[str], list[float]]:
    """The best language of each text, and its share of the scores above zero."""
    names, shares = [], []
    for at in range(0, len(texts), batch):
        bits, letters = presence(texts[at : at + batch])
        if not model.languages:
            names += [NONE] * len(letters)
            shares += [0.0] * len(letters)
            continue
        s = np.maximum(_scaled(bits) @ model.weights, 1e-9)
        best = s.argmax(1)
        share = s[np.arange(len(s)), best] / s.sum(1)
        names += [model.languages[k] if ok else NONE for k, ok in zip(best.tolist(), letters, strict=True)]
        shares += [float(v) if ok else 0.0 for v, ok in zip(share, letters, strict=True)]
    return names, shares


def _presence_rows(batches):
    for b in batches:
        for at in range(0, len(b), 64):
            part = b.slice(at, 64)
            bits, letters = presence(part.column(1).to_pylist())
            rows = np.flatnonzero(letters)
            packed = [np.packbits(bits[i].reshape(-1)).tobytes() for i in rows]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(packed, pa.binary())], names=["lang", "bits"])


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def train(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on at most ``sample`` rows of each of the ``LANGUAGES`` most frequent languages (then by name), and on about ``ROWS`` of all:
    those of the smallest hash of doc_id and text, with a lang that isn't null and outside the held-out fold (a
    null doc_id isn't held out). The languages are counted without reading texts; a bound on the hash leaves about
    twice the sample, of which each partition passes on at most ``sample`` rows of a language. Only packed presence
    vectors of the sample reach the driver."""
    open_rows = docs.filter(F.col("lang").isNotNull() & F.coalesce(~held_out(F.col("doc_id")), F.lit(True)))
    counts = {r["lang"]: r["count"] for r in open_rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return fit([], landmarks, ridge)
    sample = min(sample, max(1, ROWS // len(counts)))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_000)) / 1e9
    bound = F.element_at(F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 2 * sample / n)))), F.col("lang"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    chosen = open_rows.filter(place < bound).select("lang", "text", "doc_id", place.alias("place")).withColumn("first", first).filter(F.col("first") <= sample)
    rows = chosen.select("lang", "text").mapInArrow(_presence_rows, "lang string, bits binary")
    return fit(sorted((r["lang"], bytes(r["bits"])) for r in rows.collect()), landmarks, ridge)


def _predict(model):
    def run(batches):
        for b in batches:
            for a, z in text_slices(b.column(1)):
                part = b.slice(a, z - a)
                names, shares = score(model.value, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(shares, pa.float64())], names=["doc_id", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, lang_pred, score`` of each whole text.

    A null text, one without letters, and any text if nothing could be learned, is ``und`` with score 0. Lang,
    source and doc_id don't enter a prediction. Repeated rows and null doc_ids stay; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs) if model is None else model)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_predict(model), f"doc_id {id_type}, lang_pred string, score double")


def _label(model, text_at: int, lang_at: int, least: float):
    def run(batches):
        for b in batches:
            for a, z in text_slices(b.column(text_at)):
                part = b.slice(a, z - a)
                names, shares = score(model.value, part.column(text_at).to_pylist())
                keep = pa.array([n != NONE and s >= least for n, s in zip(names, shares, strict=True)], pa.bool_())
                columns = [pa.array(names, pa.string()) if i == lang_at else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names).filter(keep)
    return run


def keep_identified(docs: DataFrame, least: float = 0.0, model: Model | None = None) -> DataFrame:
    """``docs`` without the documents that are ``und`` or score less than ``least``; ``lang`` becomes what was
    predicted. The columns stay as they are."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs) if model is None else model)
    return docs.mapInArrow(_label(model, docs.columns.index("text"), docs.columns.index("lang"), least), docs.schema)


def op2_language(spark, sf_dir: str) -> DataFrame:
    """Each document's predicted language and score; learned from rows outside the held-out fold."""
    found = identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
