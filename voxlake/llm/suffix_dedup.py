"""Removal of long repeated byte strings with suffix arrays.

Every string of LENGTH bytes holds SEEDS runs of SEED bytes; the least hash among them depends on the string alone. A
text is thus cut into regions, the longest stretches whose strings share their least hash, and equal strings lie in
regions of equal hash. Hashes that occur once need no further look. Equal regions count as one with a multiplicity.
What is left is dealt by hash to shards of bounded size; a shard is sorted by Larsson-Sadakane refinement, common
prefixes follow in Kasai's manner, and where the regions of one hash fill several shards, each shard's strings are
looked up in the sorted order of the others by binary search. A hash whose regions exceed what a task should hold is
dealt once more, by the strings themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_texts, map_arrow, materialise, table

SEED = 128
#: Bytes of text that a task looks at together, of a shard, of a task's shards, and of the largest group of one hash.
SLICE, SHARD, BUCKET, GROUP = 1 << 20, 1 << 20, 4 << 20, 4 << 20
#: Never part of UTF-8: parts the regions of a shard.
END = 0xFF

_CODE = np.random.default_rng(2).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = 0xD6E8FEB86659FD93
_INVERSE = pow(_STEP, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k bytes: differences of a running sum of byte codes times powers, modulo 2**64."""
    n = len(b)
    if not _powers or len(_powers[0]) < n:
        size = 1 << n.bit_length()
        _powers[:] = [np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, s, np.uint64))) for s in (_STEP, _INVERSE)]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[b] * _powers[0][:n], out=total[1:])
    return _mixed((total[k:] - total[:-k]) * _powers[1][: n - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours: running minima from both ends of blocks of w."""
    n = len(x)
    padded = np.full((n + w - 1) // w * w, ~np.uint64(0))
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def regions(datas: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """For texts: owner, first and last string start, least hash, and whether that hash may occur twice in the text."""
    k = min(SEED, length)
    long = [i for i, d in enumerate(datas) if len(d) >= length]
    if not long:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64), np.empty(0, bool))
    b = np.frombuffer(b"".join(datas[i] for i in long), np.uint8)
    sizes = np.array([len(datas[i]) for i in long])
    heads = np.cumsum(sizes) - sizes
    h = gram_hashes(b, k)
    least = sliding_min(h, length - k + 1)
    counts = sizes - length + 1
    starts = np.repeat(heads - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    owner = np.repeat(np.arange(len(long)), counts)
    m = least[starts]
    new = np.append(True, (m[1:] != m[:-1]) | (owner[1:] != owner[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(m)) - 1
    # hashes low enough to be chosen, found twice in one text
    low = np.flatnonzero(h <= m.max())
    who = np.searchsorted(heads, low, side="right") - 1
    order = np.lexsort((h[low], who))
    a, o = h[low][order], who[order]
    twice = (a[1:] == a[:-1]) & (o[1:] == o[:-1])
    again = set(zip(o[1:][twice].tolist(), a[1:][twice].tolist(), strict=True))
    own, hh = owner[first], m[first]
    may = np.fromiter(((x, y) in again for x, y in zip(own.tolist(), hh.tolist(), strict=True)), bool, len(own)) if again else np.zeros(len(own), bool)
    at = heads[own]
    return np.array(long)[own], starts[first] - at, starts[last] - at, hh, may


# --- within a shard -------------------------------------------------------------------------------------------------


def suffix_order(b: np.ndarray) -> np.ndarray:
    """Order of all suffixes, where each END counts as a sign of its own (earlier ones first).

    Larsson and Sadakane's refinement: suffixes are first told apart by eight bytes, then groups that are still equal
    are sorted by the rank of what follows, doubling the bytes compared each time; settled groups are left alone.
    b must end with eight bytes END.
    """
    n = len(b)
    wide = np.append(b, np.full(8, END, np.uint8)).astype(np.uint64)
    word, ended = np.zeros(n, np.uint64), np.zeros(n, bool)
    for i in range(8):  # what follows an END doesn't count
        ended |= wide[i : i + n] == END
        word = word << np.uint64(8) | np.where(ended, np.uint64(END), wide[i : i + n])
    order = np.argsort(word, kind="stable")
    w = word[order]
    group = np.append(True, w[1:] != w[:-1]) | ended[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(group, np.arange(n), 0))  # a group's rank is the place of its first
    done = 8
    while True:
        size = np.diff(np.append(np.flatnonzero(group), n))
        open_ = np.flatnonzero(np.repeat(size > 1, size))  # places in the order that aren't settled
        if not len(open_):
            return order
        at = order[open_]
        key = rank[at] * n + rank[at + done]
        by = np.argsort(key, kind="stable")
        key = key[by]
        order[open_] = at[by]
        change = np.append(True, key[1:] != key[:-1])
        group[open_] |= change
        rank[order[open_]] = open_[np.maximum.accumulate(np.where(change, np.arange(len(key)), 0))]
        done *= 2


def common_prefixes(b: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix, the bytes before the next END that it has in common with the suffix before it in the order.

    Kasai's relation: where the bytes before both suffixes agree, the prefix is that of the suffix one byte earlier,
    less one. So prefixes are counted only where these bytes differ, eight bytes at a time, and handed on from there.
    """
    n = len(b)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    here = np.arange(n)
    at = np.flatnonzero((before <= 0) | (here == 0) | (b[here - 1] != b[before - 1]) | (b[here - 1] == END))
    got = np.zeros(len(at), np.int64)
    words = np.lib.stride_tricks.sliding_window_view(np.append(b, np.full(8, END, np.uint8)), 8)
    live, step = np.flatnonzero(before[at] >= 0), 0
    while len(live):
        x, y = words[at[live] + step], words[before[at[live]] + step]
        differ = (x != y) | (x == END)
        stop = differ.any(1)
        got[live[stop]] = step + differ[stop].argmax(1)
        live = live[~stop]
        step += 8
    base = np.zeros(n, np.int64)
    base[at] = at
    base = np.maximum.accumulate(base)
    known = np.zeros(n, np.int64)
    known[at] = got
    return known[base] - (here - base)


class Shard:
    """Regions of at most SHARD bytes (or one longer region), sorted."""

    def __init__(self, datas: list[bytes], length: int):
        self.length = length
        self.sizes = np.array([len(d) for d in datas])
        self.heads = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        self.b = np.frombuffer(b"".join(d + b"\xff" for d in datas) + b"\xff" * 8, np.uint8)
        counts = self.sizes - length + 1
        self.region = np.repeat(np.arange(len(datas)), counts)
        self.starts = np.repeat(self.heads - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        order = suffix_order(self.b)
        prefix = common_prefixes(self.b, order)
        twice = np.zeros(len(self.b), bool)
        linked = prefix[order] >= length  # with the one before
        twice[order] = linked | np.append(linked[1:], False)
        self.repeated = twice[self.starts]
        valid = np.zeros(len(self.b), bool)
        valid[self.starts] = True
        self.order = order[valid[order]]

    def holds(self, other: "Shard", queries: np.ndarray) -> np.ndarray:
        """Which of the other shard's strings (starts) this shard has too, by binary search in the sorted order."""
        mine = np.lib.stride_tricks.sliding_window_view(self.b, 8)
        theirs = np.lib.stride_tricks.sliding_window_view(other.b, 8)
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(self.order))
        found = np.zeros(len(queries), bool)
        todo = np.arange(len(queries))
        while len(todo):
            mid = (lo[todo] + hi[todo]) // 2
            p, q = self.order[mid], queries[todo]
            sign, live = np.zeros(len(todo), np.int64), np.arange(len(todo))
            for step in range(0, self.length, 8):
                use = min(8, self.length - step)
                x, y = mine[p[live] + step, :use].astype(np.int16), theirs[q[live] + step, :use].astype(np.int16)
                differ = x != y
                any_ = differ.any(1)
                k = differ[any_].argmax(1)
                rows = np.flatnonzero(any_)
                sign[live[any_]] = np.sign(x[rows, k] - y[rows, k])
                live = live[~any_]
                if not len(live):
                    break
            found[todo[sign == 0]] = True
            lo[todo[sign < 0]] = mid[sign < 0] + 1
            hi[todo[sign > 0]] = mid[sign > 0]
            todo = todo[(sign != 0) & (lo[todo] < hi[todo])]
        return found


def repeated_starts(keys: np.ndarray, datas: list[bytes], length: int, shard_bytes: int = SHARD) -> list[np.ndarray]:
    """For each region, the starts of its strings that occur again among the regions. Regions come sorted by key."""
    cuts, size = [0], 0
    for i, d in enumerate(datas):
        if size and size + len(d) > shard_bytes:
            cuts.append(i)
            size = 0
        size += len(d)
    cuts.append(len(datas))
    shards = [(lo, hi, Shard(datas[lo:hi], length)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if hi > lo]
    for x, (lo, hi, s) in enumerate(shards):
        for y, (lo2, hi2, t) in enumerate(shards):
            shared = np.intersect1d(keys[lo:hi], keys[lo2:hi2]) if x != y else ()
            if len(shared):
                ask = np.flatnonzero(~s.repeated & np.isin(keys[lo + s.region], shared))
                s.repeated[ask[t.holds(s, s.starts[ask])]] = True
    out: list[np.ndarray] = []
    for lo, hi, s in shards:
        for i in range(hi - lo):
            mine = s.region == i
            out.append((s.starts[mine] - s.heads[i])[s.repeated[mine]])
    return out


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Joined (start, end) of strings of that length."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.append(True, starts[1:] > starts[:-1] + length))
    last = np.append(cut[1:], len(starts)) - 1
    return list(zip(starts[cut].tolist(), (starts[last] + length).tolist(), strict=True))


# --- over the corpus ------------------------------------------------------------------------------------------------

REGION = "doc_id long, mark long, a long, b long, h long, c1 long, c2 long, may boolean"
SPAN = "doc_id long, mark long, s long, e long"


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """ids, marks and text bytes, about SLICE bytes at once."""
    ids, marks, datas, size = [], [], [], 0
    for batch in batches:
        for d, m, t in zip(batch["doc_id"].to_pylist(), batch["mark"].to_pylist(), batch["text"], strict=True):
            data = t.as_buffer().to_pybytes() if t.is_valid else b""
            ids.append(d)
            marks.append(m)
            datas.append(data)
            size += len(data)
            if size >= SLICE:
                yield ids, marks, datas
                ids, marks, datas, size = [], [], [], 0
    if ids:
        yield ids, marks, datas


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text left, n_bytes, n_removed, n_spans and the removed spans, for every row.

    A byte is removed if it lies in a string of `length` bytes that also starts anywhere else, in the same text or
    another one; strings are judged on the input. Spans are maximal, in bytes of the UTF-8 text. Bytes left may be cut
    within a character, so they are returned as binary. Null text counts as empty; repeated rows are copies of each
    other; null ids are kept; an empty table gives no row; other columns are not read.
    """
    marked = keyed_texts(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for ids, marks, datas in _small(batches):
            owner, a, b, h, may = regions(datas, length)
            raw = b"".join([digest(memoryview(datas[o])[i : j + length]) for o, i, j in zip(owner.tolist(), a.tolist(), b.tolist(), strict=True)])
            c = np.frombuffer(raw, "<i8").reshape(-1, 2)
            own_ids = pa.array(ids, pa.int64()).take(pa.array(owner, pa.int64()))
            own_marks = pa.array(marks, pa.int64()).take(pa.array(owner, pa.int64()))
            for lo in range(0, len(owner), 10_000):
                part = slice(lo, lo + 10_000)
                yield pa.record_batch([own_ids[part], own_marks[part], *(pa.array(np.ascontiguousarray(x[part])) for x in (a, b, h.view(np.int64), c[:, 0], c[:, 1], may))], [f.split()[0] for f in REGION.split(", ")])

    found = materialise(map_arrow(marked, cut, REGION), "regions")
    kinds = found.groupBy("h", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "mark", "a", "b")).alias("one"), F.max("may").alias("may"))
    size = (F.col("one.b") - F.col("one.a") + length).cast("long")
    hashes = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"), F.max("may").alias("may"), F.sum(size).alias("bytes"))
    # a hash needs sorting if it has a region met once that may share strings with another one or with itself
    sorted_ = hashes.where((F.col("least") == 1) & ((F.col("kinds") > 1) | F.col("may"))).select("h", "bytes")
    needed = materialise(kinds.join(sorted_, "h").select("h", "n", "one.*", "bytes"), "needed")
    whole = kinds.where("n > 1").select("h", "c1", "c2")
    copies = found.join(whole, ["h", "c1", "c2"]).select("doc_id", "mark", F.col("a").alias("s"), (F.col("b") + length).alias("e"))

    total = needed.agg(F.sum(F.col("b") - F.col("a") + length).alias("x")).first().x or 0
    buckets = max(1, -(-int(total) // BUCKET))
    lists = needed.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("h", "n", "a", "b", (F.col("bytes") > GROUP).alias("hot"))).alias("parts"))
    same = lambda l, r: F.col(f"{l}.doc_id").eqNullSafe(F.col(f"{r}.doc_id")) & F.col(f"{l}.mark").eqNullSafe(F.col(f"{r}.mark"))
    texts = marked.alias("t").join(lists.alias("l"), same("t", "l")).select("t.doc_id", "t.mark", "t.text", "l.parts")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for d, m, t, parts in zip(batch["doc_id"].to_pylist(), batch["mark"].to_pylist(), batch["text"], batch["parts"], strict=True):
                data = t.as_buffer().to_pybytes()
                for p in parts.as_py():
                    rows.append((p["h"], p["n"], p["hot"], d, m, p["a"], data[p["a"] : p["b"] + length]))
                    held += p["b"] - p["a"] + length
                    if held >= SLICE:
                        yield _record(rows, PART)
                        rows, held = [], 0
            if rows:
                yield _record(rows, PART)

    PART = "h long, n long, hot boolean, doc_id long, mark long, a long, data binary"
    parts = materialise(map_arrow(texts, fetch, PART).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets))), "parts")

    def sort(group: pa.Table) -> pa.Table:
        group = group.sort_by([("h", "ascending")])
        datas = [x.as_buffer().to_pybytes() for x in group["data"]]
        rows = []
        for d, m, a, n, starts in zip(group["doc_id"].to_pylist(), group["mark"].to_pylist(), group["a"].to_pylist(), group["n"].to_pylist(), repeated_starts(np.asarray(group["h"]), datas, length), strict=True):
            if n == 1:
                rows += [(d, m, a + s, a + e) for s, e in _runs(starts, length)]
        return pa.Table.from_batches([_record(rows, SPAN)])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, m, a, n, x in zip(batch["doc_id"].to_pylist(), batch["mark"].to_pylist(), batch["a"].to_pylist(), batch["n"].to_pylist(), batch["data"], strict=True):
                data = memoryview(x.as_buffer().to_pybytes())
                raw = b"".join([xxhash.xxh3_128_digest(data[i : i + length]) for i in range(len(data) - length + 1)])
                c = np.frombuffer(raw, "<i8").reshape(-1, 2)
                k = len(c)
                yield pa.record_batch([pa.array(np.ascontiguousarray(c[:, 0])), pa.array(np.ascontiguousarray(c[:, 1])), pa.array([d] * k, pa.int64()), pa.array([m] * k, pa.int64()), pa.array(np.arange(k) + a), pa.array(np.full(k, n))], ["d1", "d2", "doc_id", "mark", "s", "n"])

    cold = parts.where("NOT hot").groupBy("bucket").applyInArrow(sort, SPAN)
    each = map_arrow(parts.where("hot").repartition("doc_id", "a"), strings, "d1 long, d2 long, doc_id long, mark long, s long, n long")
    twice = each.groupBy("d1", "d2").agg(F.sum("n").alias("n")).where("n > 1").select("d1", "d2")
    hot = each.where("n = 1").join(twice, ["d1", "d2"]).select("doc_id", "mark", "s", (F.col("s") + length).alias("e"))

    spans = copies.union(cold).union(hot).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    joined = marked.alias("t").join(spans.alias("l"), same("t", "l"), "left").select("t.doc_id", "t.text", "l.spans")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for d, t, spans in zip(batch["doc_id"].to_pylist(), batch["text"], batch["spans"], strict=True):
                data = t.as_buffer().to_pybytes() if t.is_valid else b""
                out: list[list[int]] = []
                for s, e in sorted((x["s"], x["e"]) for x in spans.as_py() or ()):
                    if out and s <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], e)
                    else:
                        out.append([s, e])
                left = b"".join(data[i:j] for i, j in zip([0, *(e for _, e in out)], [*(s for s, _ in out), len(data)], strict=True))
                rows.append((d, left, len(data), len(data) - len(left), len(out), ",".join(f"{s}:{e}" for s, e in out)))
                held += len(left)
                if held >= SLICE:
                    yield _record(rows, KEPT)
                    rows, held = [], 0
            if rows:
                yield _record(rows, KEPT)

    return map_arrow(joined, drop, KEPT)


KEPT = "doc_id long, left binary, n_bytes long, n_removed long, n_spans long, removed string"


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("left", 256).alias("kept_sha256"))
