"""SimHash near-dedup: fingerprints of word shingles, compared as vertical bit planes with carry-save counters.

Exact similarities of shingle sets are in similar.py."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_texts, map_arrow, materialise, slices, table
from .components import connected_components

#: Fingerprints that a task compares with each other at once; larger groups are cut into tiles.
TILE = 1 << 14
#: Hashes whose bits are counted at once.
UNPACKED = 1 << 13


def shingle_hashes(text: str | None, size: int) -> list[int]:
    """XXH64 (seed 42) of each run of `size` words joined by one blank, repeats included; A-Z count as a-z."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined, n = b" ".join(words), len(words)
    h = xxhash.xxh64_intdigest
    if n <= size:
        return [h(joined, 42)]
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[: n - size])]
    return [h(joined[s:e], 42) for s, e in zip(starts, ends[size - 1 :], strict=True)]


def _bit_sums(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in the hashes of each text, which end at the given places. Bits are unpacked
    for some hashes at a time, as they take eight times the hashes' bytes."""
    sums, first = np.zeros((len(ends), 64), np.int64), np.append(0, ends[:-1])
    for lo in range(0, len(h), UNPACKED):
        part = h[lo : lo + UNPACKED]
        a, b = np.searchsorted(ends, [lo, lo + len(part) - 1], side="right")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums[a : b + 1] += np.add.reduceat(bits, np.maximum(first[a : b + 1] - lo, 0), axis=0, dtype=np.int32)
    return sums


def fingerprints(texts: list[str | None], size: int, words: int = 1) -> np.ndarray:
    """Fingerprints of 64 bits times `words` as rows of unsigned words (texts without a word: all zero).

    A bit is 1 if it is set in over half the hashes; words beyond the first come from the hashes mixed anew.
    """
    lists = [shingle_hashes(t, size) for t in texts]
    out = np.zeros((len(lists), words), "<u8")
    some = [k for k, x in enumerate(lists) if x]
    if some:
        h = np.array([x for k in some for x in lists[k]], "<u8")
        n = np.array([len(lists[k]) for k in some])
        ends = np.cumsum(n)
        for w in range(words):
            if w:
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
                h ^= h >> np.uint64(28)
            sums = _bit_sums(h, ends)
            out[some, w] = np.packbits(sums * 2 > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprint_table(docs: DataFrame, size: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (8 bytes a word, little-endian), node (signed 64-bit: the fingerprint itself, or a hash of a longer one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            f = fingerprints(batch["text"].to_pylist(), size, words)
            raw = [x.tobytes() for x in f]
            node = f[:, 0].view("<i8") if words == 1 else np.array([xxhash.xxh3_64_intdigest(x) for x in raw], "<u8").view("<i8")
            yield pa.record_batch([batch["doc_id"], pa.array(raw, pa.binary()), pa.array(node)], ["doc_id", "fp", "node"])

    return map_arrow(keyed_texts(docs, id_col, text_col), run, "doc_id long, fp binary, node long")


def planes(fp: np.ndarray) -> np.ndarray:
    """One row for each bit; a row packs that bit of all fingerprints into 64-bit words, one word of zeros at the end."""
    bits = np.unpackbits(np.ascontiguousarray(fp, "<u8").view(np.uint8), axis=1, bitorder="little").T
    words = (len(fp) + 63) // 64 + 1
    wide = np.zeros((len(bits), words * 64), np.uint8)
    wide[:, : len(fp)] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def within(p: np.ndarray, n: int, lag: int, radius: int, alive: np.ndarray | None = None) -> np.ndarray:
    """Places i where fingerprints i and i + lag differ in at most `radius` bits.

    Planes are taken eight at a time. Differences of a plane are added to vertical counters with carries kept in
    bitwise words; `over` holds the pairs beyond the radius, and blocks of words that are all over are left out.
    """
    width = p.shape[1] - 1
    bits = max(1, radius.bit_length() + 1)
    q, r = divmod(lag, 64)
    use = np.arange(max(0, (n - lag + 63) // 64))
    if alive is not None:
        use = use[alive[use] != 0]
    counters = np.zeros((bits, len(use)), np.uint64)
    over = np.zeros(len(use), np.uint64)
    if alive is not None:
        over |= ~alive[use]
    for b in range(len(p)):
        here = p[b, use]
        there = p[b, np.minimum(use + q, width)]
        if r:
            there = (there >> np.uint64(r)) | (p[b, np.minimum(use + q + 1, width)] << np.uint64(64 - r))
        carry = here ^ there
        for k in range(bits):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry  # a counter that runs over stays over
        if b % 8 == 7:
            over |= _above(counters, radius)
            open_ = over != ~np.uint64(0)
            if not open_.all():
                use, counters, over = use[open_], counters[:, open_], over[open_]
                if not len(use):
                    return np.empty(0, np.int64)
    ok = np.unpackbits((~(over | _above(counters, radius))).astype("<u8").view(np.uint8).reshape(len(use), 8), axis=1, bitorder="little")
    w, bit = np.nonzero(ok)
    at = use[w] * 64 + bit
    return at[at < n - lag]


def _above(counters: np.ndarray, radius: int) -> np.ndarray:
    """Where the vertical counters hold more than the radius, compared from the highest bit down."""
    more, same = np.zeros(counters.shape[1], np.uint64), np.full(counters.shape[1], ~np.uint64(0))
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same &= counters[k]
        else:
            more |= same & counters[k]
            same &= ~counters[k]
    return more


class _Groups:
    """Joins linked fingerprints of one batch, so that a large group yields a tree of links and not all pairs."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def join(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        new = self.up[i] != self.up[j]
        out = []
        for a, b in zip(i[new].tolist(), j[new].tolist(), strict=True):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                out.append((a, b))
        if out:
            while not np.array_equal(self.up, nxt := self.up[self.up]):
                self.up = nxt
        return out


def links_of_sorted(key: np.ndarray, fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (as places) among rows whose keys are equal; rows come sorted by key. The links join all that are near."""
    n = len(key)
    if n < 2:
        return []
    change = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(change, n))
    run_end = np.repeat(change + size, size)
    groups, out = _Groups(n), []
    long = size > 256
    for lo, m in zip(change[long].tolist(), size[long].tolist(), strict=True):  # each long run by itself
        p = planes(fp[lo : lo + m])
        for lag in range(1, m):
            at = within(p, m, lag, radius)
            out += groups.join(lo + at, lo + at + lag)
    p = planes(fp)
    short = ~np.repeat(long, size)
    for lag in range(1, int(size[~long].max(initial=1))):
        live = short & (np.arange(n) + lag < run_end)
        at = within(p, n, lag, radius, planes_of(live))
        out += groups.join(at, at + lag)
    return out


def planes_of(flags: np.ndarray) -> np.ndarray:
    wide = np.zeros(((len(flags) + 63) // 64) * 64, np.uint8)
    wide[: len(flags)] = flags
    return np.packbits(wide, bitorder="little").view("<u8")


def block_choices(bits: int, radius: int, blocks: int, agree: int) -> list[list[int]]:
    """Bits of each choice of `agree` of the blocks. With blocks - radius of them, near fingerprints agree on one choice
    at least, so none is missed; fewer and wider radii are found with a probability that the number of blocks sets."""
    edges = [round(bits * k / blocks) for k in range(blocks + 1)]
    parts = [list(range(lo, hi)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(c, []) for c in combinations(parts, agree)]


def near_links(distinct: DataFrame, words: int, radius: int, blocks: int, agree: int) -> DataFrame:
    """a, b: links between nodes that join all fingerprints within the radius that share a choice of blocks.

    Every distinct fingerprint is dealt once for each choice of blocks, so the work grows with their number and the
    size of the groups that agree on a choice. Groups beyond TILE are dealt as pairs of tiles, each pair a group of its
    own, so no task holds more than two tiles' rows.
    """
    choices = block_choices(64 * words, radius, blocks, agree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.zeros((len(choices), 64 * words), np.uint8)
        for k, c in enumerate(choices):
            masks[k, c] = 1
        masks = np.packbits(masks, axis=1, bitorder="little").view("<u8")
        for batch in slices(batches):
            fp = np.frombuffer(b"".join(batch["fp"].to_pylist()), "<u8").reshape(-1, words)
            key = np.zeros((len(choices), len(fp)), np.uint64)
            for k, m in enumerate(masks):
                for w in range(words):
                    if m[w]:
                        key[k] = (key[k] ^ (fp[:, w] & m[w])) * np.uint64(0x9E3779B97F4A7C15)
                        key[k] ^= key[k] >> np.uint64(29)
                key[k] = (key[k] + np.uint64(k + 1)) * np.uint64(0xBF58476D1CE4E5B9)
            n = len(choices)
            again = pa.array(np.tile(np.arange(len(fp)), n))
            yield pa.record_batch([pa.array(key.ravel().view("<i8")), batch["node"].take(again), batch["fp"].take(again)], ["k", "node", "fp"])

    dealt = map_arrow(distinct.select("node", "fp"), deal, "k long, node long, fp binary")
    big = dealt.groupBy("k").count().where(F.col("count") > TILE).select("k", F.ceil(F.col("count") * 2 / TILE).cast("int").alias("tiles"))
    tiled = dealt.join(big, "k", "left").withColumn("mine", F.pmod(F.xxhash64("node"), F.coalesce("tiles", F.lit(1))).cast("int"))
    pairs = tiled.select("fp", "node", "k", "mine", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)).alias("other"))
    rows = pairs.select("fp", "node", F.xxhash64("k", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, fp = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, words), np.uint64)

        def links(k: np.ndarray, v: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            at = np.array(links_of_sorted(k, f, radius), np.int64).reshape(-1, 2)
            return pa.record_batch([pa.array(v[at[:, 0]]), pa.array(v[at[:, 1]])], ["a", "b"])

        for batch in batches:
            key, node = np.append(key, np.asarray(batch["g"])), np.append(node, np.asarray(batch["node"]))
            fp = np.concatenate([fp, np.frombuffer(b"".join(batch["fp"].to_pylist()), "<u8").reshape(-1, words)])
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on in the next batch
            if whole >= 1 << 15:
                yield links(key[:whole], node[:whole], fp[:whole])
                key, node, fp = key[whole:], node[whole:], fp[whole:]
        if len(key):
            yield links(key, node, fp)

    return map_arrow(rows.repartition("g").sortWithinPartitions("g"), run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 3, words: int = 1, radius: int = 3, blocks: int = 6, agree: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node, fp, component_id: the smallest doc_id that is reachable over fingerprints within the radius.

    The defaults (64 bits, radius 3, any three of six blocks equal) miss no pair. Texts without a word have fingerprint
    zero and link like others; texts with fewer words than a shingle count as one shingle. Repeated rows are in one
    component; a null id is kept and never the smallest (null only if its component has no other id). An empty table
    gives no row. Only fingerprints and ids are shuffled, never texts; other columns are not read.
    """
    fps = materialise(fingerprint_table(docs, size, words, id_col, text_col), "fingerprints")
    distinct = fps.groupBy("node", "fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(near_links(distinct, words, radius, blocks, agree), "a", "b").withColumnRenamed("node", "n")
    named = distinct.join(roots, F.col("node") == F.col("n"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    named = materialise(named, "fingerprint-roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(named.select("node", "root").join(least, "root").drop("root"), "node").select("doc_id", "node", "fp", "component_id")


def similar_documents(docs: DataFrame, similarity: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """similar.similar_documents(): links by exact similarity."""
    from .similar import similar_documents as exact

    return exact(docs, similarity, size, id_col, text_col)


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")
