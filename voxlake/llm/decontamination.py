"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of words. A TF-IDF matrix of the benchmark's passages, with document frequencies counted over the
whole corpus, is factorised by a distributed randomised SVD. Every window of every document is projected onto the
factors; windows whose cosine with an item is high enough become candidates, and a candidate counts if the longest
common subsequence with the item is long and the item's answer terms are there, so that paraphrases with changed, left
out or added words are found too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_texts, map_arrow, materialise, slices, table

#: Hashed terms.
TERMS = 1 << 17
#: Words of half a window; windows are two halves long and move on by one.
HALF = 16
#: Words of the parts of an item that windows are compared with: a window's share of a longer text's norm would be small.
PART = 4 * HALF
#: Windows whose cosines a task holds at once (fewer if there are over PARTS columns), and benchmark items of one block:
#: they bound the matrix and the broadcast.
WINDOWS, PARTS, ITEMS = 1 << 13, 1 << 9, 1 << 8
#: Half-windows that are added up at once: what is added stays in a core's cache.
AT_ONCE = 1 << 9
#: The least share of its norm that each passage of the benchmark keeps in the latent space.
KEPT = 0.9

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CODE = np.random.default_rng(4).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15
_INVERSE = pow(_STEP, -1, 1 << 64)
_powers: list[np.ndarray] = []


def word_terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers of all words (runs of letters and digits, case folded in any script), and where each text's words begin (one more at the end)."""
    data = [(t or "").casefold().encode() for t in texts]
    b = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    n = len(b)
    if not _powers or len(_powers[0]) < n:
        size = 1 << n.bit_length()
        _powers[:] = [np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, s, np.uint64))) for s in (_STEP, _INVERSE)]
    w = np.concatenate([[False], _WORD_BYTE[b], [False]])
    edge = np.flatnonzero(w[1:] != w[:-1])
    first, last = edge[::2], edge[1::2]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[b] * _powers[0][:n], out=total[1:])
    h = (total[last] - total[first]) * _powers[1][first]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    text_at = np.cumsum([0, *(len(d) + 1 for d in data)])
    return (h >> np.uint64(47)).astype(np.int64), np.searchsorted(first, text_at)


def document_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each hashed term stands, over all rows, and the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(TERMS, np.int64), 0
        for batch in slices(batches, "text"):
            terms, at = word_terms(batch["text"].to_pylist())
            rows += batch.num_rows
            key = np.repeat(np.arange(batch.num_rows), np.diff(at)) * TERMS + terms
            df += np.bincount(np.unique(key) % TERMS, minlength=TERMS)
        some = np.flatnonzero(df)
        if rows:
            yield pa.record_batch([pa.array(np.append(some, -1)), pa.array(np.append(df[some], rows))], ["term", "n"])

    found = map_arrow(keyed_texts(docs, id_col, text_col).select("text"), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(TERMS)
    for r in found:
        if r.term >= 0:
            df[r.term] = r.n
    return df, next((r.n for r in found if r.term < 0), 0)


@dataclass
class Index:
    """What tasks need: idf of all terms, what each term that items use adds to each part's cosine, and the items."""

    idf: np.ndarray
    row: np.ndarray  # term to its row in product, -1 where no item uses it
    product: np.ndarray  # terms by parts: the factors times the items' parts, each row already times its idf
    owner: np.ndarray  # the item of each part
    kept: np.ndarray  # share of its norm that each passage keeps in the latent space
    item_ids: list
    words: list[np.ndarray]  # terms of each item in order
    answers: list[np.ndarray]  # the terms that an answer check asks for


def _block_sum(parts: DataFrame, rank: int, terms: int) -> np.ndarray:
    """Add up partial term rows (term, vector) by blocks of terms on the executors; the result has `terms` rows."""

    def add(group: pa.Table) -> pa.Table:
        t = np.asarray(group["term"])
        v = np.concatenate([np.frombuffer(x, "<f8") for x in group["v"].to_pylist()]).reshape(-1, rank)
        u, inv = np.unique(t, return_inverse=True)
        s = np.zeros((len(u), rank))
        np.add.at(s, inv, v)
        return pa.table({"term": u, "v": [x.tobytes() for x in s]})

    out = np.zeros((terms, rank))
    for r in parts.groupBy((F.col("term") / 64).cast("int").alias("b")).applyInArrow(add, "term long, v binary").collect():
        out[r.term] = np.frombuffer(r.v, "<f8")
    return out


def randomised_svd(passages: DataFrame, terms: int, rank: int, rounds: int = 2, seed: int = 1) -> np.ndarray:
    """Leading right singular vectors (terms by rank) of the sparse matrix whose rows are (array of terms, of weights).

    Halko, Martinsson and Tropp's range finder on the row space: the executors multiply their rows with the current
    basis and back, the driver only orthogonalises a terms-by-rank matrix.
    """
    basis = np.random.default_rng(seed).standard_normal((terms, rank))
    spark = passages.sparkSession
    for _ in range(rounds + 1):
        sent = spark.sparkContext.broadcast(basis)

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b, acc = sent.value, {}
            for batch in batches:
                for t, w in zip(batch["terms"].to_pylist(), batch["weights"].to_pylist(), strict=True):
                    w = np.array(w)
                    y = w @ b[t]
                    for i, x in zip(t, w, strict=True):
                        acc[i] = acc.get(i, 0.0) + x * y
            yield pa.record_batch([pa.array(list(acc), pa.int64()), pa.array([v.tobytes() for v in acc.values()], pa.binary())], ["term", "v"])

        basis, _ = np.linalg.qr(_block_sum(map_arrow(passages, multiply, "term long, v binary"), rank, terms))
    return basis


def build_index(benchmark: DataFrame, df: np.ndarray, n_docs: int, rank: int = 64, weights: tuple[float, float] = (1.0, 3.0), id_col: str = "item_id", text_col: str = "text", answer_col: str | None = None) -> Index:
    """Fit the latent space on the benchmark's passages. The benchmark is small by nature: its items go to every task.

    `rank` is the least number of factors. Factors are added until each passage keeps a share KEPT of its norm, or there
    are as many as passages, which keep all of it.

    Weights are inverse document frequencies within the given bounds: a passage that a third of all documents hold makes
    its own words frequent, and must still be told from the words around it. The answer check asks for the words of
    answer_col if given, else for the quarter of an item's words that are rarest in the corpus. Items without a word
    are left out.
    """
    spark = benchmark.sparkSession
    idf = np.clip(np.log((1.0 + n_docs) / (1.0 + df)), *weights)
    cols = [F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"), (F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")).alias("answer")]
    got = benchmark.select(*cols).distinct().orderBy("item", "text").collect()
    ids, words, answers = [], [], []
    for r in got:
        t, _ = word_terms([r.text])
        if not len(t):
            continue
        ids.append(r.item)
        words.append(t)
        a, _ = word_terms([r.answer])
        answers.append(np.unique(a) if len(a) else np.unique(t)[np.argsort(-idf[np.unique(t)], kind="stable")[: max(1, len(t) // 4)]])
    used = np.unique(np.concatenate(words)) if words else np.empty(0, np.int64)
    row = np.full(TERMS, -1, np.int64)
    row[used] = np.arange(len(used))
    if not len(used):
        return Index(idf.astype(np.float32), row, np.zeros((0, 0), np.float32), np.empty(0, np.int64), np.empty(0), ids, words, answers)

    def weighed(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, n = np.unique(t[row[t] >= 0], return_counts=True)
        w = n * idf[u]
        return row[u], w / max(1e-12, np.linalg.norm(w))

    def tf_idf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights = [], []
        for batch in batches:
            for text in batch["text"].to_pylist():
                for t in _passages(word_terms([text])[0]):
                    u, w = weighed(t)
                    if len(u):
                        terms.append(u)
                        weights.append(w)
        yield pa.record_batch([pa.array(terms, pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.float64()))], ["terms", "weights"])

    passages = materialise(map_arrow(benchmark.select(F.col(text_col).cast("string").alias("text")), tf_idf, "terms array<long>, weights array<double>"), "passages")
    own = [weighed(t) for w in words for t in _passages(w)]
    most = min(len(own), len(used))
    rank = min(most, max(rank, 3 * len(ids) // 2))
    while True:
        v = randomised_svd(passages, len(used), rank)
        kept = np.array([np.linalg.norm(w @ v[u]) for u, w in own])
        if kept.min() >= KEPT or rank == most:
            break
        rank = min(most, 2 * rank)
    parts = [(k, t[lo : lo + PART]) for k, t in enumerate(words) for lo in range(0, len(t), PART)]
    latent = np.stack([w @ v[u] for u, w in (weighed(t) for _, t in parts)])
    product = (v * idf[used][:, None]).astype(np.float32) @ latent.T.astype(np.float32)
    return Index(idf.astype(np.float32), row, product, np.array([k for k, _ in parts]), kept, ids, words, answers)


def _passages(t: np.ndarray) -> list[np.ndarray]:
    """An item's windows and its parts."""
    return [t[lo : lo + 2 * HALF] for lo in range(0, max(1, len(t) - HALF), HALF)] + [t[lo : lo + PART] for lo in range(0, len(t), PART)]


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, one machine operation a word of b (Hyyrö's bit vectors)."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


FOUND = "doc_id long, item_id long, word_at long, cosine double, lcs double, answer double"


def contaminated(docs: DataFrame, index: Index, cosine: float = 0.3, lcs_share: float = 0.6, answer_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and item it holds: the best window's first word, cosine, share of the item's words in
    the longest common subsequence, share of the answer terms present.

    All windows of the whole text are scored. Null and empty texts hold nothing; an empty table or an empty benchmark
    gives no row; repeated rows give repeated rows; null ids are kept; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Index = sent.value
        weight, at_once = x.idf**2, max(64, WINDOWS * PARTS // max(PARTS, len(x.owner)))
        words = [w.tolist() for w in x.words]
        product = np.concatenate([x.product, np.zeros((1, len(x.owner)), np.float32)])  # the last row: no word of an item
        buffer = np.empty((AT_ONCE, len(x.owner)), np.float32)
        owners, held = x.owner.tolist(), np.zeros(TERMS, bool)
        for batch in slices(batches, "text"):
            ids, out = batch["doc_id"].to_pylist(), []
            terms, at = word_terms(batch["text"].to_pylist())
            count = np.diff(at)
            halves = (count + HALF - 1) // HALF
            base = np.cumsum(halves) - halves  # first half-window of each document
            place = np.arange(len(terms)) - np.repeat(at[:-1], count)
            half = np.repeat(base, count) + place // HALF
            n = int(halves.sum())
            use = np.flatnonzero(x.row[terms] >= 0)
            if not len(use) or not len(x.item_ids):
                continue
            h, used = half[use], x.row[terms[use]]
            norm = np.append(np.bincount(half, weight[terms], minlength=n), 0.0)
            owner = np.repeat(np.arange(len(ids)), halves)
            joins = np.append(owner[1:] == owner[:-1], False)  # the next half belongs to the same document
            best: dict[tuple[int, int], tuple] = {}
            for first_window in range(0, n, at_once):
                part = slice(first_window, min(n, first_window + at_once))
                after = slice(part.start + 1, part.stop + 1)
                lo_, hi_ = np.searchsorted(h, [part.start, part.stop + 1])
                if lo_ == hi_:
                    continue
                # words of a half side by side, so that halves are added up word by word, all at once
                slots = np.full((HALF, part.stop - part.start + 1), len(product) - 1)
                slots[place[use[lo_:hi_]] % HALF, h[lo_:hi_] - part.start] = used[lo_:hi_]
                z = np.empty((slots.shape[1], len(x.owner)), np.float32)
                for lo in range(0, len(z), AT_ONCE):
                    sums, more = z[lo : lo + AT_ONCE], buffer[: len(z) - lo]
                    for k, slot in enumerate(slots[:, lo : lo + AT_ONCE]):
                        product.take(slot, axis=0, out=more if k else sums, mode="clip")
                        if k:
                            sums += more
                norm2 = norm[part] + norm[after] * joins[part]
                near = (z[:-1] + z[1:] * joins[part, None]) / np.sqrt(np.maximum(norm2, 1e-12))[:, None]
                for w, c in zip(*(v.tolist() for v in np.nonzero(near >= cosine)), strict=True):
                    i, d = owners[c], int(owner[part.start + w])
                    item, lo = x.words[i], (part.start + w - int(base[d])) * HALF
                    from_, to = max(0, lo - len(item)), min(int(count[d]), lo + 2 * HALF + len(item))
                    region = terms[at[d] + from_ : at[d] + to]
                    held[region] = True
                    # no subsequence is longer than the number of the item's words that are there
                    enough = np.count_nonzero(held[item]) >= lcs_share * len(item)
                    there = np.count_nonzero(held[x.answers[i]]) / len(x.answers[i]) if enough else 0.0
                    held[region] = False
                    if not enough or there < answer_share:
                        continue
                    share = lcs(words[i], region.tolist()) / len(item)
                    if share >= lcs_share:
                        now = (share, float(near[w, c]), -lo, there)
                        best[d, i] = max(best.get((d, i), now), now)
            for (d, i), (share, c, lo, there) in sorted(best.items()):
                out.append((ids[d], x.item_ids[i], -lo, min(1.0, c), share, there))
            if out:
                yield pa.record_batch([pa.array(c, pa.float64() if k > 2 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], names=[c.split()[0] for c in FOUND.split(", ")])

    return map_arrow(keyed_texts(docs, id_col, text_col), run, FOUND)


def find_leaks(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """contaminated() for a benchmark of any size: in blocks of about `items` items, each with its own latent space."""
    df, n = document_frequencies(docs)
    blocks = max(1, -(-benchmark.count() // items))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = [contaminated(docs, build_index(benchmark.where(block == k) if blocks > 1 else benchmark, df, n)) for k in range(blocks)]
    return reduce(DataFrame.union, found)


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
