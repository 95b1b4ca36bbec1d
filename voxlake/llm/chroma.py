"""Media columns: chroma fingerprints of audio and the alignment of recordings.

A recording (WAV bytes, 16-bit PCM) becomes frames of energy in twelve pitch classes. On the integral image of these
frames, sixteen filters compare sums of rectangles; each answer is put into one of four classes, and the classes make a
packed 32-bit integer for every frame. Two recordings are aligned where many equal integers share one offset, and told
the same by the share of bits that differ there.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices, table

#: Samples a second to which a recording is brought, samples of a frame and from one frame to the next.
RATE, FRAME, HOP = 4000, 512, 125
#: Pitches that count, in Hz.
LOW, HIGH = 110.0, 1760.0
#: Frames that a filter looks at together.
WIDTH = 8
#: Codes of a block of queries or recordings in a task, and equal pairs that it holds at once.
BLOCK, HITS = 1 << 20, 1 << 22


@lru_cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Bins of a frame's spectrum that count, and the pitch class (0..11, from A) of each."""
    f = np.arange(FRAME // 2 + 1) * RATE / FRAME
    use = np.flatnonzero((f >= LOW) & (f <= HIGH))
    return use, np.round(12 * np.log2(f[use] / 440.0)).astype(int) % 12


def samples(wav: bytes | None) -> np.ndarray:
    """Mean of the channels as floats at RATE; empty for null, empty or unreadable bytes."""
    if not wav:
        return np.empty(0)
    try:
        with wave.open(io.BytesIO(wav)) as w:
            rate, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
            raw = w.readframes(w.getnframes())
    except (wave.Error, EOFError, struct.error):
        return np.empty(0)
    if width != 2 or not rate:
        return np.empty(0)
    x = np.frombuffer(raw[: len(raw) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels).mean(1) / 32768.0
    if rate != RATE and len(x):
        x = np.interp(np.arange(0, len(x) - 1, rate / RATE), np.arange(len(x)), x)
    return x


def chroma(x: np.ndarray) -> np.ndarray:
    """Frames by twelve pitch classes, each frame of unit length (silent frames: zeros)."""
    if len(x) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * np.hanning(FRAME)
    use, pitch = _classes()
    energy = np.abs(np.fft.rfft(frames, axis=1)[:, use]) ** 2
    out = energy @ (pitch[:, None] == np.arange(12))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 1e-6, out / np.maximum(norm, 1e-12), 0.0)


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, classes, frames): kind 0 sums, 1 splits in time, 2 splits in pitch, 3 crosses both."""
    return [(k % 4, (5 * k) % 9, 2 + k % 3 if k % 4 < 2 else 2 + 2 * (k % 2), WIDTH if k % 2 else WIDTH // 2) for k in range(16)]


def codes(wav: bytes | None) -> np.ndarray:
    """Packed integers of a recording, one for each frame that has WIDTH frames from there on (signed 32-bit)."""
    c = chroma(samples(wav))
    n = len(c) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.int32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(0).cumsum(1)
    t = np.arange(n)
    box = lambda t0, t1, p0, p1: image[t + t1, p1] - image[t + t0, p1] - image[t + t1, p0] + image[t + t0, p0]
    out = np.zeros(n, np.uint32)
    for kind, p, h, w in _filters():
        half, mid = w // 2, p + h // 2
        if kind == 0:
            v = box(0, w, p, p + h) / w - h / 12
        elif kind == 1:
            v = (box(0, half, p, p + h) - box(half, w, p, p + h)) / half
        elif kind == 2:
            v = (box(0, w, p, mid) - box(0, w, mid, p + h)) / w
        else:
            v = (box(0, half, p, mid) + box(half, w, mid, p + h) - box(half, w, p, mid) - box(0, half, mid, p + h)) / half
        level = (v > -0.15).astype(np.uint32) + (v > 0.0) + (v > 0.15)
        out = out << np.uint32(2) | (level ^ (level >> np.uint32(1)))  # Gray code: neighbours differ in one bit
    return out.view(np.int32)


def fingerprints(media: DataFrame, id_col: str, audio_col: str) -> DataFrame:
    """id, codes of each recording. Null, unreadable or too short audio gives no code; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "audio"):
            yield pa.record_batch([batch["id"], pa.array([codes(a) for a in batch["audio"].to_pylist()], pa.list_(pa.int32()))], ["id", "codes"])

    return map_arrow(media.select(F.col(id_col).cast("long").alias("id"), F.col(audio_col).alias("audio")), run, "id long, codes array<int>")


class _Codes:
    """Recordings of a block laid end to end: ids, codes, where each begins (one more at the end)."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, at: np.ndarray):
        self.ids, self.codes, self.at = ids, codes, at
        owner = np.repeat(np.arange(len(ids)), np.diff(at))
        first = np.append(True, (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1]))[: len(codes)]
        use = np.flatnonzero(first)
        by_code = np.argsort(codes[use], kind="stable")
        order = use[by_code]
        self.sorted, self.owner, self.pos = codes[order], owner[order], order - at[owner[order]]
        self.run = np.diff(np.append(use, len(codes)))[by_code]  # equal integers in a row from here on

    @classmethod
    def of(cls, t: pa.Table, id_col: str) -> _Codes:
        lists = t["codes"].combine_chunks()
        size = np.asarray(lists.value_lengths().fill_null(0), np.int64) if len(lists) else np.empty(0, np.int64)
        return cls(np.asarray(t[id_col]), np.asarray(lists.flatten(), np.int32), np.append(0, np.cumsum(size)))


def _votes(q: _Codes, m: _Codes, qr: tuple[int, int], mr: tuple[int, int]) -> Iterator[tuple[np.ndarray, ...]]:
    """Query, recording, offset and number of equal integers there, for the given ranges; halved while hits are too many.
    Where runs of equal integers begin together, they count as long as the shorter one."""
    a, b = ((x.owner >= r[0]) & (x.owner < r[1]) for x, r in ((q, qr), (m, mr)))
    code, own, pos = q.sorted[a], q.owner[a], q.pos[a]
    lo = np.searchsorted(code, m.sorted[b], "left")
    n = np.searchsorted(code, m.sorted[b], "right") - lo
    wide_q, wide_m = qr[1] - qr[0], mr[1] - mr[0]
    if n.sum() > HITS and max(wide_q, wide_m) > 1:
        for half in range(2):
            cut = lambda r: (r[0], (r[0] + r[1]) // 2) if half == 0 else ((r[0] + r[1]) // 2, r[1])  # noqa: B023, E731
            yield from _votes(q, m, *((cut(qr), mr) if wide_q > wide_m else (qr, cut(mr))))
        return
    hit = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    key = (own[hit] * len(m.ids) + np.repeat(m.owner[b], n)) << 32 | np.repeat(m.pos[b], n) - pos[hit] + (1 << 31)
    key, which = np.unique(key, return_inverse=True)
    shared = np.minimum(q.run[a][hit], np.repeat(m.run[b], n))
    count = np.bincount(which, shared, len(key)).astype(np.int64)
    yield (key >> 32) // len(m.ids), (key >> 32) % len(m.ids), (key & 0xFFFFFFFF) - (1 << 31), count


def block_matches(q: _Codes, m: _Codes, min_votes: int, max_bit_error: float) -> tuple[np.ndarray, ...]:
    """Matches between two blocks: query, recording, votes, offset and share of differing bits.

    The best offset of a pair has most votes, then is nearest to zero, then is the larger one.
    """
    out: list[tuple] = []
    for i, j, offset, votes in _votes(q, m, (0, len(q.ids)), (0, len(m.ids))) if len(q.ids) and len(m.ids) else ():
        use = (votes >= min_votes) & (q.ids[i] != m.ids[j])
        i, j, offset, votes = i[use], j[use], offset[use], votes[use]
        order = np.lexsort((-offset, np.abs(offset), -votes, j, i))
        best = order[np.append(True, (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0))[: len(order)]]
        for a, b, o, v in zip(i[best].tolist(), j[best].tolist(), offset[best].tolist(), votes[best].tolist(), strict=True):
            x, y = q.codes[q.at[a] : q.at[a + 1]], m.codes[m.at[b] : m.at[b + 1]]
            x, y = x[max(0, -o) : len(y) - o], y[max(0, o) :]
            n = min(len(x), len(y))
            error = int(np.bitwise_count(x[:n].view(np.uint32) ^ y[:n].view(np.uint32)).sum()) / (32.0 * n)
            if error <= max_bit_error:
                out.append((int(q.ids[a]), int(m.ids[b]), v, o, error))
    cols = list(zip(*out, strict=True)) if out else [()] * 5
    return tuple(np.array(c, np.float64 if k == 4 else np.int64) for k, c in enumerate(cols))


def align(prints: DataFrame, is_query, min_votes: int = 5, max_bit_error: float = 0.3) -> DataFrame:
    """One row for each recording: id, class_id (least id of equal fingerprints), n_copies, n_codes, and for queries
    (rows where is_query holds) n_matches and the best match: match_id, offset, votes, bit_error (else null).

    Recordings of one class are compared once. Only the first of equal integers in a row is looked up, so held notes
    and silence don't multiply, and votes for all that both rows share. A match has min_votes equal integers at its best offset and at most max_bit_error of
    the bits differing over the frames that overlap there. Recordings without a code are one class and match
    nothing, nor do those with no id but null.

    Queries and recordings meet in blocks of about BLOCK codes each: a task holds one block of either, so offset
    histograms are counted where they arise and only matches are shuffled.
    """
    keyed = prints.withColumn("key", F.sha2(F.array_join("codes", ",").cast("binary"), 256)).withColumn("asks", F.coalesce(is_query, F.lit(False)))
    kinds = keyed.groupBy("key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"), F.max("asks").alias("asks"), F.first("codes").alias("codes"))
    some = kinds.where((F.size("codes") > 0) & F.col("class_id").isNotNull())
    total = some.agg(F.sum(F.size("codes")).alias("all"), F.sum(F.when(F.col("asks"), F.size("codes"))).alias("ask")).first()
    q_blocks, m_blocks = (max(1, -(-(n or 0) // BLOCK)) for n in (total.ask, total.all))
    place = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = some.where("asks").select(place(q_blocks).alias("qb"), F.col("class_id").alias("q"), "codes", every(m_blocks).alias("mb"))
    theirs = some.select(place(m_blocks).alias("mb"), F.col("class_id").alias("m"), "codes", every(q_blocks).alias("qb"))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("q", "m", "votes", "offset", "bit_error"), block_matches(_Codes.of(a, "q"), _Codes.of(b, "m"), min_votes, max_bit_error), strict=True)))

    pairs = mine.groupBy("qb", "mb").cogroup(theirs.groupBy("qb", "mb")).applyInArrow(compare, "q long, m long, votes long, offset long, bit_error double")
    top = pairs.groupBy("q").agg(F.count(F.lit(1)).alias("n_matches"), F.min(F.struct("bit_error", -F.col("votes"), "m", "offset", "votes")).alias("t"))
    named = kinds.select("key", "class_id", "n_copies", F.size("codes").cast("long").alias("n_codes")).join(top, F.col("class_id") == F.col("q"), "left")
    out = keyed.select("id", "key", "asks").join(named, "key")
    mark = lambda c: F.when(F.col("asks"), c)
    return out.select("id", "class_id", "n_copies", "n_codes", mark(F.coalesce("n_matches", F.lit(0))).alias("n_matches"), mark(F.col("t.m")).alias("match_id"), mark(F.col("t.offset")).alias("offset"), mark(F.col("t.votes")).alias("votes"), mark(F.round("t.bit_error", 6)).alias("bit_error"))


def melody_wav(values: list[float] | None) -> bytes | None:
    """A recording of one sixteenth of a second for each value, read as a pitch (two octaves; 0.125 is four semitones)."""
    if not values:
        return None
    v = np.nan_to_num(np.array(values, float))
    note = np.clip(np.round(v * 32), -12, 12) - 3
    hz = np.repeat(440.0 * 2 ** (note / 12), RATE // 16)
    x = 0.6 * np.sin(2 * np.pi * np.cumsum(hz) / RATE)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((x * 32767).astype("<i2").tobytes())
    return out.getvalue()


def melodies(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, audio: the supplied tables hold no recordings, so each vector is played as a melody."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.record_batch([batch["id"], pa.array([melody_wav(v) for v in batch["v"].to_pylist()], pa.binary())], ["id", "audio"])

    return map_arrow(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")), run, "id long, audio binary")


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import materialise

    prints = materialise(fingerprints(melodies(table(spark, sf_dir, "embeddings")), "id", "audio"), "chroma")
    return align(prints, F.col("id") % 20 == 0).withColumnRenamed("id", "vec_id")
