"""Operator 7, language identification by string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the number of n-grams, of 1 to ``orders``
characters, that both hold, divided by the geometric mean of the numbers each holds. N-grams are those of the
lower-cased text, where every run of characters that are not letters is one blank; they are hashed to
``buckets`` slots, and presence is that of slots. Nyström landmarks, some documents of each language, give
every text a short feature vector, and one-versus-rest kernel ridge regression is solved on these.

Fitting uses a bounded sample: of each language the ``per_lang`` labelled documents with the smallest hash of
their id, fewer if there are more than ``sample // per_lang`` languages; beyond ``sample // 4`` languages only
those with the most labelled rows are learned. Whole texts count, in the sample as
in prediction; only slot bitmaps of the sample come to the driver. Prediction goes over batches: a presence
matrix times the landmarks' matrix, its rows scaled, times the weights. It needs no shuffle.

Defined results. Null text, or a text without a letter: ``und`` with score 0. Rows with a null or repeated
doc_id are predicted like any other, and of those that repeat an id one is learned from. A text of any length is read in pieces that overlap by an n-gram. Rows
with a null lang, or doc_id, are never learned from. Without anything to learn from, all are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.llm.common import free_name, lean

BUCKETS, ORDERS, PIECE = 1 << 15, 4, 1 << 20
NONE = "und"
_LETTER = np.zeros(0, dtype=bool)


def _letters() -> np.ndarray:
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)
    return _LETTER


def slots(text: str, buckets: int = BUCKETS, orders: int = ORDERS) -> np.ndarray | None:
    """A presence flag for every slot, or None for a text without letters."""
    present, known, some = np.zeros(buckets, dtype=bool), _letters(), False
    shift = np.uint32(33 - buckets.bit_length())
    carry = np.array([32], dtype=np.uint32)
    for at in range(0, len(text), PIECE):
        code = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = known[code]
        some = some or bool(letter.any())
        code = np.concatenate([carry, np.where(letter, code, np.uint32(32))])
        blank = code == 32
        keep = np.ones(len(code), dtype=bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        code = code[keep]
        rolled = np.zeros(len(code), dtype=np.uint32)
        for n in range(min(orders, len(code))):
            rolled = (rolled[: len(code) - n] + np.uint32(n + 1)) * np.uint32(0x9E3779B1) ^ code[n:]
            mixed = rolled * np.uint32(0x85EBCA6B)
            present[(mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> shift] = True
        carry = code[-(orders - 1) :]
    return present if some else None


@dataclass
class Model:
    """Landmarks' slots (buckets x landmarks), weights (landmarks x languages) and languages."""

    landmarks: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    languages: list[str]

    def scores(self, presence: np.ndarray) -> np.ndarray:
        kernel = presence @ self.landmarks
        kernel /= np.sqrt(np.maximum(1, presence.sum(axis=1)))[:, None] * self.scale
        return kernel @ self.weights


def fit(docs: DataFrame, per_lang: int = 200, landmarks: int = 24, ridge: float = 0.1, sample: int = 8000) -> Model | None:
    """``docs`` holds the rows that may be learned from: doc_id, text, lang."""
    lean(docs.sparkSession)
    rows = docs.filter("doc_id is not null and lang is not null")
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample // 4)
    langs = {r["lang"]: r["n"] for r in most.collect()}
    if not langs:
        return None
    per_lang = max(4, min(per_lang, sample // len(langs)))
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))

    def lowest(share: dict[str, float]) -> DataFrame:
        bound = docs.sparkSession.createDataFrame(list(share.items()), "lang string, share double")
        return rows.select("doc_id", "lang").join(F.broadcast(bound), "lang").filter(low < F.col("share") * (1 << 30)).select("doc_id", "lang").distinct()

    # only hashes low enough to be among the smallest, eight times over, go to a language's sort; where rows repeat
    # ids so often that too few are left, all of the language go
    share = {k: min(1.0, 8 * per_lang / n) for k, n in langs.items()}
    left = {r["lang"]: r["count"] for r in lowest(share).groupBy("lang").count().collect()}
    share = {k: 1.0 if left.get(k, 0) < per_lang else v for k, v in share.items()}
    order = F.row_number().over(W.partitionBy("lang").orderBy(low, "doc_id"))
    chosen = lowest(share).withColumn("place", order).filter(F.col("place") <= per_lang)
    # rows that repeat an id count once, with the smallest of their texts
    texts = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang", "place").agg(F.min("text").alias("text"))

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t in enumerate(batch.column(3).to_pylist()):
                p = slots(t or "")
                out.append(None if p is None else np.packbits(p).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["doc_id", "lang", "place", "bits"])

    got = texts.mapInArrow(bitmaps, "doc_id long, lang string, place int, bits binary").filter("bits is not null").collect()
    got = sorted(got, key=lambda r: (r["lang"], r["place"], r["bits"]))
    if not got:
        return None
    langs = sorted({r["lang"] for r in got})
    presence = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in got), dtype=np.uint8)).reshape(len(got), BUCKETS).astype(np.float32)
    at = np.array([langs.index(r["lang"]) for r in got])
    landmarks = max(2, min(landmarks, 768 // len(langs)))
    picked = np.concatenate([np.flatnonzero(at == k)[:landmarks] for k in range(len(langs))])
    size = presence.sum(axis=1)
    held = presence[picked]
    kernel = (presence @ held.T) / np.sqrt(size[:, None] * size[picked])
    values, vectors = np.linalg.eigh(kernel[picked].astype(np.float64))
    root = (vectors / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    features = kernel @ root
    target = np.where(at[:, None] == np.arange(len(langs)), 1.0, -1.0)
    weight = np.sqrt(len(got) / (len(langs) * np.bincount(at, minlength=len(langs))[at]))[:, None]  # every language counts alike
    x = features * weight
    solved = np.linalg.solve(x.T @ x + ridge * np.eye(len(picked)), x.T @ (target * weight))
    return Model(np.ascontiguousarray(held.T), np.sqrt(size[picked]), (root @ solved).astype(np.float32), langs)


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None, into: tuple[str, str] = ("lang_pred", "score"), batch_rows: int = 64) -> DataFrame:
    """``keep`` (or all) of the columns of ``docs``, and lang_pred and score (0 to 1), which replace columns of these names."""
    spark = docs.sparkSession
    lean(spark)
    sent = spark.sparkContext.broadcast(model)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in into]
    schema = docs.select(*kept).schema.add(into[0], "string").add(into[1], "double")
    given = docs.select(*kept, F.col("text").cast("string").alias(free_name("read", kept)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        presence = np.zeros((batch_rows, BUCKETS), dtype=np.float32)
        for batch in batches:
            *columns, texts = batch.columns
            lang, score = [NONE] * len(texts), np.zeros(len(texts))
            for first in range(0, len(texts) if model else 0, batch_rows):
                n, rows = 0, []
                for i in range(first, min(len(texts), first + batch_rows)):
                    text = texts[i].as_py()
                    held = slots(text) if text else None
                    if held is not None:
                        presence[n] = held
                        rows.append(i)
                        n += 1
                if n:
                    got = model.scores(presence[:n])
                    best = got.argmax(axis=1)
                    score[rows] = np.clip((got[np.arange(n), best] + 1) / 2, 0, 1)
                    for i, b in zip(rows, best.tolist(), strict=True):
                        lang[i] = model.languages[b]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*kept, *into])

    return given.mapInArrow(run, schema)


def accept(docs: DataFrame, model: Model | None, least_score: float = 0.5, least_letters: int = 40) -> DataFrame:
    """The rows in a language that the model knows, all columns as they are.

    Rejected: null texts and texts without a letter; and texts of ``least_letters`` or more that no language's
    classifier claims, that is, whose best score stays below ``least_score`` (0.5 is a decision value of 0).
    Shorter texts hold too few n-grams to be judged, and stay. Without a model only letters decide.
    """
    columns = docs.columns
    lang, score = free_name("lang_pred", columns), free_name("lang_score", columns)
    got = predict(docs, model, into=(lang, score))
    letters = F.regexp_count(F.col("text").cast("string"), F.lit(r"\p{L}"))
    if model is None:
        return docs.filter(letters > 0)
    return got.filter((F.col(lang) != NONE) & ((F.col(score) >= least_score) | (letters < least_letters))).select(*columns)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).filter(~held_out())
