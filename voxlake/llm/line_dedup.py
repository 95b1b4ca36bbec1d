"""Line dedup by a sharded minimal perfect hash: documents probe arrays instead of joining lines.

Lines are known by two independent 64-bit halves of a 128-bit hash of their key. Hashes of lines found in enough
documents are dealt to shards; each shard gets a minimal perfect hash, whose slots point into an array of 64-bit
fingerprints and one of counts. A line that is in no shard is told by its fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_texts, map_arrow, materialise, slices, table

#: The ASCII blanks that are stripped from a key.
BLANKS = b" \t\n\x0b\x0c\r"
KEYS_A_SHARD = 1 << 15
#: Bytes of hashes that a salted group gets, about.
GROUP = 16 << 20


def line_hashes(text: str | None) -> tuple[list[bytes], np.ndarray]:
    """Lines of a text as bytes, and for each its 16-byte hash as two unsigned 64-bit values (zero, zero: empty key)."""
    lines = (text or "").encode().split(b"\n")
    digest = xxhash.xxh3_128_digest
    keys = [k.strip(BLANKS).lower() for k in lines]
    raw = b"".join([digest(k) if k else bytes(16) for k in keys])
    return lines, np.frombuffer(raw, "<u8").reshape(-1, 2)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (fixed values)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys by hash and displace: four keys a bucket on average.

    seeds holds one number a bucket: from 0 a displacement, below 0 the slot itself (buckets of one key, placed last).
    """

    def __init__(self, seeds: np.ndarray, n: int):
        self.seeds, self.n = seeds, n

    @staticmethod
    def _bucket(keys: np.ndarray, m: int) -> np.ndarray:
        return (_mix(keys ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(m)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        n = len(keys)
        m = max(1, n // 4)
        which = cls._bucket(keys, m)
        order = np.argsort(which, kind="stable")
        sizes = np.bincount(which, minlength=m)
        ends = np.cumsum(sizes)
        taken, seeds = np.zeros(n, bool), np.zeros(m, np.int64)
        one = []
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] == 0:
                break
            mine = keys[order[ends[b] - sizes[b] : ends[b]]]
            if sizes[b] == 1:
                one.append(b)
                continue
            base = 0
            while True:
                tries = np.arange(base, base + 64, dtype=np.uint64)
                at = (_mix(mine[None, :] + (tries[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)
                s = np.sort(at, 1)
                good = ~taken[at].any(1) & (s[:, 1:] != s[:, :-1]).all(1)
                if good.any():
                    k = int(np.argmax(good))
                    seeds[b], taken[at[k]] = base + k, True
                    break
                base += 64
        seeds[one] = -1 - np.flatnonzero(~taken)[: len(one)]
        return cls(seeds, n)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        d = self.seeds[self._bucket(keys, len(self.seeds))]
        at = (_mix(keys + (np.maximum(d, 0).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)
        return np.where(d < 0, -1 - d, at)


INDEX = "shard long, n long, turn long, seeds binary, fingerprints binary, counts binary"


def _keys(h1: np.ndarray, h2: np.ndarray, turn: int) -> np.ndarray:
    """Keys of the perfect hash: the first half of a line's hash, and from turn 1 on mixed with the second one."""
    return h1 + np.uint64(turn) * _mix(h2) if turn else h1


class Shard:
    def __init__(self, n: int, turn: int, seeds: bytes, fingerprints: bytes, counts: bytes):
        self.hash, self.turn = PerfectHash(np.frombuffer(seeds, "<i8"), n), turn
        self.fingerprints, self.counts = np.frombuffer(fingerprints, "<u8"), np.frombuffer(counts, "<u4")

    def count(self, h: np.ndarray) -> np.ndarray:
        """How many documents hold each line of h (n by 2), 0 if the shard doesn't know it."""
        at = self.hash.slots(_keys(h[:, 0], h[:, 1], self.turn))
        return np.where(self.fingerprints[at] == h[:, 1], self.counts[at], 0)


def line_counts(docs: DataFrame, min_docs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """h1, h2, n: hashes of the keys in at least min_docs documents, and in how many."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            both = np.concatenate(parts).astype("<u8").tobytes()
            u, n = np.unique(np.frombuffer(both, "V16").view([("a", "<u8"), ("b", "<u8")]), return_counts=True)
            return pa.record_batch([pa.array(u["a"].view("<i8")), pa.array(u["b"].view("<i8")), pa.array(n.astype(np.int64))], ["h1", "h2", "n"])

        for batch in slices(batches, "text"):
            for t in batch["text"].to_pylist():
                h = line_hashes(t)[1]
                h = np.unique(h[h.any(1)], axis=0) if len(h) > 1 else h[h.any(1)]
                if len(h):
                    parts.append(h)
                    size += len(h)
            if size >= 400_000:
                yield flush()
                parts, size = [], 0
        if size:
            yield flush()

    found = map_arrow(keyed_texts(docs, id_col, text_col).select("text"), tally, "h1 long, h2 long, n long")
    return found.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)


def build_index(counts: DataFrame, n_keys: int) -> DataFrame:
    """One row for each shard: the seeds of its perfect hash, its fingerprints and counts, in slot order."""
    bits = max(0, (max(1, n_keys) // KEYS_A_SHARD).bit_length())

    def build(group: pa.Table) -> pa.Table:
        h1, h2 = (np.asarray(group[c]).astype("<i8").view("<u8") for c in ("h1", "h2"))
        n = np.asarray(group["n"])
        turn = 0
        while len(np.unique(keys := _keys(h1, h2, turn))) < len(h1):  # lines that share the first half
            turn += 1
        hashed = PerfectHash.build(keys)
        at = hashed.slots(keys)
        fingerprints, counts = np.zeros(len(h1), "<u8"), np.zeros(len(h1), "<u4")
        fingerprints[at], counts[at] = h2, np.minimum(n, 0xFFFFFFFF)
        return pa.table({"shard": group["shard"][:1], "n": [len(h1)], "turn": [turn], "seeds": [hashed.seeds.astype("<i8").tobytes()], "fingerprints": [fingerprints.tobytes()], "counts": [counts.tobytes()]}, pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("turn", pa.int64()), ("seeds", pa.binary()), ("fingerprints", pa.binary()), ("counts", pa.binary())]))

    sharded = counts.withColumn("shard", F.shiftrightunsigned("h1", 64 - bits) if bits else F.lit(0).cast("long"))
    return sharded.groupBy("shard").applyInArrow(build, INDEX)


def _shard_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h[:, 0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _without(lines: list[bytes], drop: np.ndarray) -> str:
    return b"\n".join([x for x, d in zip(lines, drop, strict=True) if not d]).decode()


KEPT = "doc_id long, text string, n_lines long, n_dropped long"


def drop_common_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text", max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, text without the lines whose key is in at least min_docs documents, n_lines before, n_dropped.

    A key is the line with ASCII blanks stripped at both ends and A-Z in lower case; empty keys always stay. Each
    row counts as a document, repeated rows too. Null or empty text is one empty line and gives an empty text; an
    empty table gives no row; a null id is kept. Other columns are not read.

    Where the index is within max_broadcast_bytes every task gets it and no text is shuffled. Beyond that, hashes
    of lines are sent to their shard in salted groups and only the hits come back.
    """
    spark = docs.sparkSession
    counts = materialise(line_counts(docs, min_docs, id_col, text_col), "line-counts")
    n_keys = counts.count()
    bits = max(0, (max(1, n_keys) // KEYS_A_SHARD).bit_length())
    index = materialise(build_index(counts, n_keys), "line-index")
    texts = keyed_texts(docs, id_col, text_col)
    if n_keys * 24 <= max_broadcast_bytes:
        sent = spark.sparkContext.broadcast({r.shard: (r.n, r.turn, bytes(r.seeds), bytes(r.fingerprints), bytes(r.counts)) for r in index.collect()})

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shards = {k: Shard(*v) for k, v in sent.value.items()}
            for batch in slices(batches, "text"):
                out = []
                for doc_id, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    lines, h = line_hashes(t)
                    drop = np.zeros(len(lines), bool)
                    where = _shard_of(h, bits)
                    for s in np.unique(where):
                        if int(s) in shards:
                            at = where == s
                            drop[at] = shards[int(s)].count(h[at]) >= min_docs
                    drop &= h.any(1)
                    out.append((doc_id, _without(lines, drop) if drop.any() else t or "", len(lines), int(drop.sum())))
                yield _kept(out)

        return map_arrow(texts, probe, KEPT)

    # lines are hashes of 16 bytes, dealt to shards evenly
    n_lines = texts.agg(F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)).first()[0] or 0
    salts = max(1, -(-n_lines * 16 // (GROUP << bits)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for doc_id, mark, t in zip(batch["doc_id"].to_pylist(), batch["mark"].to_pylist(), batch["text"].to_pylist(), strict=True):
                h = line_hashes(t)[1]
                h = np.unique(h[h.any(1)], axis=0)
                where = _shard_of(h, bits)
                out += [(int(s), mark % salts, doc_id, mark, h[where == s].tobytes()) for s in np.unique(where)]
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["shard", "salt", "doc_id", "mark", "hashes"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, marks, hits = [], [], []
        if left.num_rows and right.num_rows:
            shard = Shard(*(right[c][0].as_py() for c in ("n", "turn", "seeds", "fingerprints", "counts")))
            for doc_id, mark, raw in zip(left["doc_id"].to_pylist(), left["mark"].to_pylist(), left["hashes"].to_pylist(), strict=True):
                h = np.frombuffer(raw, "<u8").reshape(-1, 2)
                h = h[shard.count(h) >= min_docs]
                if len(h):
                    ids.append(doc_id)
                    marks.append(mark)
                    hits.append(h.tobytes())
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "mark": pa.array(marks, pa.int64()), "hits": pa.array(hits, pa.binary())})

    def drop_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for doc_id, t, hits in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["hits"].to_pylist(), strict=True):
                lines, h = line_hashes(t)
                bad = {x[i : i + 16] for x in hits or () for i in range(0, len(x), 16)}
                drop = np.array([r.tobytes() in bad for r in h], bool)
                out.append((doc_id, _without(lines, drop) if drop.any() else t or "", len(lines), int(drop.sum())))
            yield _kept(out)

    marked = texts.withColumn("mark", F.xxhash64("doc_id", "text"))
    probes = map_arrow(marked, send, "shard long, salt long, doc_id long, mark long, hashes binary")
    salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    hits = probes.groupBy("shard", "salt").cogroup(salted.groupBy("shard", "salt")).applyInArrow(answer, "doc_id long, mark long, hits binary")
    # rows that are equal in id and text share a mark and have equal hits
    gathered = hits.groupBy("doc_id", "mark").agg(F.collect_set("hits").alias("hits"))
    joined = marked.alias("a").join(gathered.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.mark") == F.col("b.mark")), "left")
    return map_arrow(joined.select("a.doc_id", "a.text", "b.hits"), drop_hits, KEPT)


def _kept(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_common_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = """
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), common AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT l.*, c.k IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
