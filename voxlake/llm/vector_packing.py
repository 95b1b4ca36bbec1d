"""Vector bin packing of token pieces: the dot-product heuristic under limits on tokens, segments and loss tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices, table
from .token_ids import default_tokenizer, encoder


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold. loss_tokens counts tokens that bear loss, segments counts pieces."""

    tokens: int = 2048
    segments: int = 512
    loss_tokens: int = 2048


#: Documents in a sequence of the registered query: attention masks by segment stay small, also where texts are a few words.
SEGMENTS = 64


@dataclass
class Piece:
    doc: int  # place in the caller's list of documents
    start: int
    length: int


class Packer:
    """Packs a stream of documents with bounded memory: at most `window` pieces wait for a place.

    A sequence is filled by always taking the waiting piece whose demand (tokens, one segment, loss tokens), each
    weighted by its mean over the window, has the largest dot product with what is left of the limits. Where no
    whole piece fits, or one segment is left, a piece is cut so that the sequence becomes full. What remains at
    the end is cut into sequences whose lengths are powers of two, which need no padding.
    """

    def __init__(self, limits: Limits, window: int = 1024):
        self.limits, self.window = limits, window
        self.doc = np.empty(0, np.int64)
        self.start = np.empty(0, np.int64)
        self.length = np.empty(0, np.int64)
        self.quiet = np.empty(0, np.int64)  # leading tokens of the piece that bear no loss

    def add(self, docs: list[int], lengths: list[int], quiet: list[int]) -> Iterator[list[Piece]]:
        """Take documents in; give sequences while more than the window waits."""
        whole = min(self.limits.tokens, self.limits.loss_tokens)
        d, s, n, q = [], [], [], []
        for doc, length, silent in zip(docs, lengths, quiet, strict=True):
            at = 0
            while length - at >= whole and (self.limits.loss_tokens >= self.limits.tokens or silent <= at):
                yield [Piece(doc, at, whole)]
                at += whole
            while at < length:  # a prompt part may let more than `whole` in, never more than the token limit
                part = min(length - at, self.limits.tokens)
                d.append(doc)
                s.append(at)
                n.append(part)
                q.append(min(part, max(0, silent - at)))
                at += part
        self.doc, self.start = np.append(self.doc, d).astype(np.int64), np.append(self.start, s).astype(np.int64)
        self.length, self.quiet = np.append(self.length, n).astype(np.int64), np.append(self.quiet, q).astype(np.int64)
        while len(self.doc) > self.window:
            yield self._fill()

    def finish(self) -> Iterator[list[Piece]]:
        while len(self.doc):
            pieces = self._fill()
            n = sum(p.length for p in pieces)
            if n == self.limits.tokens:
                yield pieces
                continue
            while pieces:  # cut at powers of two, largest first
                size, part = 1 << (sum(p.length for p in pieces).bit_length() - 1), []
                while size:
                    p = pieces.pop(0)
                    part.append(Piece(p.doc, p.start, min(size, p.length)))
                    if p.length > size:
                        pieces.insert(0, Piece(p.doc, p.start + size, p.length - size))
                    size -= part[-1].length
                yield part

    def _fill(self) -> list[Piece]:
        lim = self.limits
        loss = self.length - self.quiet
        demand = np.stack([self.length, np.ones_like(self.length), loss], 1).astype(float)
        weight = demand.mean(0) / np.array([lim.tokens, lim.segments, max(1, lim.loss_tokens)], float) ** 2
        left = np.array([lim.tokens, lim.segments, lim.loss_tokens], float)
        open_, out = np.ones(len(self.length), bool), []
        while left[0] >= 1 and left[1] >= 1 and open_.any():
            fits = open_ & (demand <= left).all(1)
            worth = demand @ (weight * left)
            if left[1] == 1:  # the last segment: the rest must come from one piece
                fits &= demand[:, 0] == left[0]
            if fits.any():
                i = int(np.argmax(np.where(fits, worth, -1.0)))
                out.append(Piece(int(self.doc[i]), int(self.start[i]), int(self.length[i])))
                left -= demand[i]
                open_[i] = False
                continue
            room = np.minimum(np.minimum(self.length, left[0]), self.quiet + left[2]).astype(np.int64)
            room[~open_] = 0
            i = int(np.argmax(room))
            cut = int(room[i])
            if cut <= 0:
                break
            out.append(Piece(int(self.doc[i]), int(self.start[i]), cut))
            silent = min(cut, int(self.quiet[i]))
            left -= [cut, 1, cut - silent]
            if cut == self.length[i]:
                open_[i] = False
            else:
                self.start[i] += cut
                self.length[i] -= cut
                self.quiet[i] -= silent
                demand[i] = (self.length[i], 1, self.length[i] - self.quiet[i])
        for name in ("doc", "start", "length", "quiet"):
            setattr(self, name, getattr(self, name)[open_])
        return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack_texts(docs: DataFrame, tokenizer: str, end_id: int = 1, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, window: int = 1024) -> DataFrame:
    """Encode whole texts, add end_id and place every id in exactly one piece of one sequence.

    Each input partition packs its own rows as they stream by, so nothing is shuffled and no row waits for
    another task; sequence_id holds the partition in its upper bits. prompt_col names a text that comes before
    the row's text and bears no loss (instruction data). Null or empty texts give one piece with the end id;
    repeated rows are packed each on its own; an empty table gives no row; other columns are not read.
    """
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    cols.append((F.col(prompt_col).cast("string") if prompt_col else F.lit(None).cast("string")).alias("prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer), Packer(limits, window)
        kept: dict[int, tuple] = {}  # documents with ids that wait: id, ids, ids left
        number, sequence = 0, (TaskContext.get().partitionId()) << 40

        def rows(sequences: Iterator[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            out = []
            for pieces in sequences:
                offset = 0
                for p in pieces:
                    doc_id, ids, silent, left = kept[p.doc]
                    loss = p.length - min(p.length, max(0, silent - p.start))
                    out.append((doc_id, p.start, p.length, zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]), len(ids) // 4, sequence, offset, loss))
                    offset += p.length
                    if left == p.length:
                        del kept[p.doc]
                    else:
                        kept[p.doc] = (doc_id, ids, silent, left - p.length)
                sequence += 1
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

        for batch in slices(batches, "text"):
            d = batch.to_pydict()
            ids = enc.encode(d["text"])
            prompts = enc.encode(d["prompt"]) if prompt_col else [ids[0][:0]] * len(ids)
            docs_in, lengths, quiet = [], [], []
            for doc_id, x, p in zip(d["doc_id"], ids, prompts, strict=True):
                data = p.tobytes() + x.tobytes() + end_id.to_bytes(4, "little")
                kept[number] = (doc_id, data, len(p), len(data) // 4)
                docs_in.append(number)
                lengths.append(len(data) // 4)
                quiet.append(len(p))
                number += 1
            yield from rows(packer.add(docs_in, lengths, quiet))
        yield from rows(packer.finish())

    return map_arrow(docs.select(*cols), run, PIECES)


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"), default_tokenizer(), end_id=1, limits=Limits(segments=SEGMENTS))
