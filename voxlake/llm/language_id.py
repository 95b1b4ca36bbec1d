"""Language identification with string kernels.

The kernel of two texts is the number of n-grams (two to four bytes, a blended spectrum) that both hold, each counted
once, over the root of the product of their own numbers. Nyström landmarks give it a finite form, and one ridge
regression for each language (one against the rest) is fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keyed_texts, map_arrow, slices, table

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: Slots of the presence vector: pairs as they are, runs of three and four bytes by hash.
_HASHED = 1 << 17
SLOTS = (1 << 16) + 2 * _HASHED
#: Texts whose presence vectors are multiplied at once.
AT_ONCE = 32

_KEEP = np.full(256, 32, np.uint8)
for _b in [*range(97, 123), *range(128, 256)]:
    _KEEP[_b] = _b


def presence(text: str, mark: np.ndarray) -> int:
    """Set mark (a cleared array of SLOTS flags) where the text has an n-gram; return how many slots are set."""
    b = _KEEP[np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)]
    b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))].astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    mark[two] = True
    three = (two[:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)
    mark[(1 << 16) + (three >> np.uint32(15))] = True
    if len(b) > 3:
        four = (two[:-2] << np.uint32(16) | two[2:]) * np.uint32(0x85EBCA6B)
        four ^= four >> np.uint32(15)
        mark[(1 << 16) + _HASHED + ((four * np.uint32(0xC2B2AE35)) >> np.uint32(15))] = True
    return int(np.count_nonzero(mark))


@dataclass
class Model:
    langs: list[str]
    vocabulary: np.ndarray  # slots that a landmark holds
    weights: np.ndarray  # vocabulary by languages

    def scores(self, texts: list[str]) -> np.ndarray:
        """Texts by languages. The batch's presence matrix is multiplied with (landmarks' presence, transposed, times
        the regression's weights), a product formed once: the same sum as kernel rows times weights."""
        out, mark = np.zeros((len(texts), self.weights.shape[1]), np.float32), np.zeros(SLOTS, bool)
        rows = np.zeros((min(AT_ONCE, len(texts)), len(self.vocabulary)), np.float32)
        for lo in range(0, len(texts), AT_ONCE):
            part = texts[lo : lo + AT_ONCE]
            norm = np.ones(len(part), np.float32)
            for k, t in enumerate(part):
                mark[:] = False
                norm[k] = max(1, presence(t, mark)) ** 0.5
                rows[k] = mark[self.vocabulary]
            out[lo : lo + AT_ONCE] = rows[: len(part)] @ self.weights / norm[:, None]
        return out


def _sample(labelled: DataFrame, per_lang: dict[str, int], seed: int) -> DataFrame:
    """At most so many rows a language, those with the least hash; rows are thinned by hash before the window."""
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return labelled.limit(0).withColumn("rank", F.lit(0))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, (4 * per_lang.get(k, 0) + 50) / n)))])
    h = F.xxhash64("doc_id", "text", F.lit(seed))
    thin = labelled.withColumn("_h", h).where((F.pmod("_h", F.lit(1 << 30)) / float(1 << 30)) <= share[F.col("lang")])
    ranked = thin.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("_h", "doc_id")))
    limit = F.create_map(*[x for k in counts for x in (F.lit(k), F.lit(per_lang.get(k, 0)))])
    return ranked.where(F.col("rank") <= limit[F.col("lang")])


def fit(labelled: DataFrame, landmarks: int = 160, sample: int = 3000, ridge: float = 1e-3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows with a language and a letter: `landmarks` and `sample` bound the rows used, shared evenly among
    the languages. Features are computed on the executors; the driver gets presence bits of the landmarks and one
    kernel row for each sampled text. No labelled row gives a model without languages."""
    rows = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    spark = labelled.sparkSession
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not langs:
        return Model([], np.empty(0, np.int64), np.empty((0, 0), np.float32))
    each = {k: max(4, sample // len(langs)) for k in langs}
    first = max(2, landmarks // len(langs))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(SLOTS, bool)
        for batch in batches:
            out = []
            for t in batch["text"].to_pylist():
                mark[:] = False
                presence(t, mark)
                out.append(np.packbits(mark).tobytes())
            yield pa.record_batch([batch["lang"], batch["rank"], pa.array(out, pa.binary())], ["lang", "rank", "bits"])

    chosen = _sample(rows, each, seed).select("doc_id", "text", "lang", "rank")
    marks = map_arrow(chosen.where(F.col("rank") <= first).select("text", "lang", "rank"), bits, "lang string, rank int, bits binary").orderBy("lang", "rank").collect()
    held = np.stack([np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in marks]).astype(bool)
    vocabulary = np.flatnonzero(held.any(0))
    base = (held[:, vocabulary] / np.sqrt(held.sum(1, keepdims=True))).astype(np.float32)  # landmarks by vocabulary
    sent = spark.sparkContext.broadcast((vocabulary, base))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model([], sent.value[0], np.ascontiguousarray(sent.value[1].T))
        for batch in slices(batches, "text"):
            k = model.scores(batch["text"].to_pylist())
            yield pa.record_batch([batch["lang"], batch["rank"], pa.array(list(k.astype(float)), pa.list_(pa.float64()))], ["lang", "rank", "k"])

    got = map_arrow(chosen.select("text", "lang", "rank"), kernel, "lang string, rank int, k array<double>").orderBy("lang", "rank").collect()
    k_nm, k_mm = np.array([r.k for r in got]), (base @ base.T).astype(float)
    vals, vecs = np.linalg.eigh(k_mm)
    root = vecs / np.sqrt(np.maximum(vals, 1e-6)) @ vecs.T
    phi = k_nm @ root
    y = np.where(np.array([r.lang for r in got])[:, None] == np.array(langs), 1.0, -1.0)
    alpha = root @ np.linalg.solve(phi.T @ phi + ridge * len(got) * np.eye(phi.shape[1]), phi.T @ y)
    return Model(langs, vocabulary, (base.T @ alpha).astype(np.float32))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, margin of every whole text; score is the winning regression's value moved from -1..1 to
    0..1, margin what it exceeds the next one's by (-1 if there is none).

    Null texts, texts without a letter, and any text if the model has no language give `und` and 0 twice. Ties go to the
    first language in alphabetical order. Repeated rows and null ids are kept; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches, "text"):
            texts = batch["text"].to_pylist()
            lang, score, margin = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            some = [k for k, t in enumerate(texts) if m.langs and t and _LETTER.search(t)]
            if some:
                s = m.scores([texts[k] for k in some])
                best = s.argmax(1)
                by_value = np.sort(np.hstack([s, np.full((len(some), 1), -1.0)]) if s.shape[1] == 1 else s, axis=1)
                apart = (by_value[:, -1] - by_value[:, -2]).tolist()
                for k, b, v, a in zip(some, best.tolist(), s[np.arange(len(some)), best].tolist(), apart, strict=True):
                    lang[k], score[k], margin[k] = m.langs[b], (min(1.0, max(-1.0, v)) + 1) / 2, a
            yield pa.record_batch([batch["doc_id"], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], ["doc_id", "lang_pred", "score", "margin"])

    return map_arrow(keyed_texts(docs, id_col, text_col), run, "doc_id long, lang_pred string, score double, margin double")


def held_out(id_col: str = "doc_id"):
    """Rows that are never learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs.where(~held_out() & F.col("lang").isNotNull())))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
