"""Encoding with a SentencePiece merge model by a table of last tokens, and decoding.

A merge model joins, again and again, the adjacent symbols whose joined piece has the best score (the leftmost of equals).
Two facts make a table of prefixes enough. Call tokens a, b compatible if merging the text of a and b gives a and b again.
(1) In the encoding of any text all neighbours are compatible, as no merge crosses them, so what happens inside a pair
doesn't depend on the rest. (2) A sequence whose neighbours are all compatible is the encoding of its text: the first merge
across a border would happen in the pair alone, too. So each prefix has exactly one last token: the one among the pieces
that end there, found by an automaton, that is compatible with the last token of the prefix before it. The ids are then
read backwards through the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import keyed_texts, map_arrow, slices, table

#: Chunks in the young half of a worker's store, and the characters up to which a chunk is kept there.
MAX_CHUNKS, MAX_KEPT = 200_000, 40
#: Pairs whose compatibility a worker remembers.
MAX_PAIRS = 1_000_000
SPACE = "▁"

_encoders: dict[str, "PieceEncoder"] = {}


class PieceEncoder:
    """ids of whole texts, as the library gives them for a merge model with byte fallback and normal pieces."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.end_id = lib.vocab_size(), lib.eos_id()
        kinds = (lib.is_control, lib.is_byte, lib.is_unknown, lib.is_unused)
        plain = [i for i in range(self.size) if not any(k(i) for k in kinds)]
        self.piece = {i: lib.id_to_piece(i) for i in plain}
        self.byte_id = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.score = {self.piece[i]: lib.get_score(i) for i in plain}
        ids = {p: i for i, p in self.piece.items()}
        # characters that are no pieces themselves, but part of some, are symbols as well
        for c in sorted({c for p in ids for c in p} - set(ids)):
            self.piece[self.size + len(self.piece)] = c
            ids[c] = self.size + len(self.piece) - 1
        self.ids = ids
        self.automaton = ahocorasick.Automaton()
        for p, i in ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        # places where no piece lies across: two characters that are neighbours in no piece
        signs = sorted({c for p in ids for c in p})
        self.place = np.zeros(0x110000, np.int16)
        self.place[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
        self.bound = np.zeros((len(signs) + 1, len(signs) + 1), bool)
        pairs = sorted({p[i : i + 2] for p in ids for i in range(len(p) - 1)})
        if pairs:
            left, right = ([self.place[ord(p[k])] for p in pairs] for k in (0, 1))
            self.bound[left, right] = True
        self._trees()
        # tested right tokens of each left one; the last is for the start of a chunk
        self.after: list[dict[int, bool]] = [{} for _ in range(max(self.piece) + 2)]
        self.tested = 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, text: str, until: int = 1) -> list[str]:
        """Symbols of a short text after all merges, or when `until` are left, step by step."""
        symbols = list(text)
        while len(symbols) > until:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = self.score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _trees(self) -> None:
        """How each piece comes about: its last merge, and for its outer symbols the scores at which they are used up.

        A piece is even if every merge inside it scores below those that made its parts. Symbols of even pieces then
        appear in the order of scores, so that a border can be judged by its outer symbols alone.
        """
        self.joins: dict[tuple[str, str], float] = {}
        self.even: dict[str, bool] = {}
        parts: dict[str, tuple[str, str] | None] = {}
        for p in sorted(self.ids, key=len):
            parts[p] = None
            self.even[p] = True
            if len(p) > 1:
                if len(last := self.merged(p, 2)) > 2:  # never made by merges
                    self.even[p] = False
                    continue
                left, right = parts[p] = tuple(last)
                s = self.score.get(p, -np.inf)
                self.joins[left, right] = s
                made = [self.score[x] for x in (left, right) if len(x) > 1]
                self.even[p] = self.even.get(left, False) and self.even.get(right, False) and all(s < x for x in made)
        # outer symbols of a piece with the score of the merge that uses them up (none: of the piece itself)
        self.ends: dict[str, list[tuple[str, float]]] = {}
        self.starts: dict[str, list[tuple[str, float]]] = {}
        for edge, k in ((self.starts, 0), (self.ends, 1)):
            for p in self.ids:
                found, x, used = [], p, -np.inf
                while True:
                    found.append((x, used))
                    if not self.even[p] or parts[x] is None:
                        break
                    x, used = parts[x][k], self.score[x]
                edge[p] = found

    def compatible(self, left: int, right: int) -> bool:
        """left: -1 at the start of a chunk, where right must only be the encoding of its own text."""
        known = self.after[left].get(right)
        if known is None:
            if self.tested >= MAX_PAIRS:
                self.after, self.tested = [{} for _ in self.after], 0
            known = self.after[left][right] = self._compatible(self.piece[left] if left >= 0 else "", self.piece[right])
            self.tested += 1
        return known

    def _compatible(self, a: str, b: str) -> bool:
        if not a or not self.even[a] or not self.even[b]:
            return self.merged(a + b) == [x for x in (a, b) if x]
        joins = self.joins
        for u, u_used in self.ends[a]:
            for v, v_used in self.starts[b]:
                s = joins.get((u, v))
                # of equal scores the leftmost merge comes first: a's own before the border's, the border's before b's
                if s is not None and s > u_used and s >= v_used:
                    return self.even[u + v] is False and self.merged(a + b) == [a, b]
        return True

    def last_tokens(self, text: str) -> tuple[list[int], list[int]]:
        """The id and length of the last token of each prefix of a text of known characters."""
        n = len(text)
        ids, lengths = [-1] * (n + 1), [0] * (n + 1)
        test = self.compatible
        for end, (i, m) in self.automaton.iter(text):
            end += 1
            if lengths[end]:
                continue
            before = ids[end - m]
            known = self.after[before].get(i)
            if known or known is None and test(before, i):
                ids[end], lengths[end] = i, m
        return ids, lengths

    def _bytes(self, text: str) -> list[int]:
        return [self.byte_id[b] for b in text.encode()]

    def chunk(self, text: str) -> bytes:
        """ids of a chunk (little-endian unsigned 32-bit): last tokens forwards, then back through the table."""
        if not self.place[ord(text[0])]:  # in no piece: a chunk of its own
            return np.array(self._bytes(text), "<u4").tobytes()
        ids, lengths = self.last_tokens(text)
        out, at = [], len(text)
        while at:
            i = ids[at]
            out.extend(reversed(self._bytes(self.piece[i])) if i >= self.size else (i,))
            at -= lengths[at]
        return np.array(out[::-1], "<u4").tobytes()

    def _known(self, chunk: str) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            got = self.chunk(chunk)
        if len(chunk) <= MAX_KEPT:
            if len(self.young) >= MAX_CHUNKS:
                self.old, self.young = self.young, {}
            self.young[chunk] = got
        return got

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text without an end id (null or empty: none)."""
        out = []
        for t in texts:
            text = self.library.normalize(t) if t else ""
            if not text:
                out.append(np.empty(0, "<u4"))
                continue
            at = self.place[np.frombuffer(text.encode("utf-32-le"), "<u4")]
            cuts = (np.flatnonzero(~self.bound[at[:-1], at[1:]]) + 1).tolist()
            parts = []
            for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True):
                c = text[i:j]
                got = self.young.get(c)
                parts.append(self._known(c) if got is None else got)
            out.append(np.frombuffer(b"".join(parts), "<u4"))
        return out

    def forget(self) -> None:
        """Empty the store and what is known of pairs."""
        self.young, self.old = {}, {}
        self.after, self.tested = [{} for _ in self.after], 0

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> (with the end id) and decoded text of every whole text.

    Null and empty texts have the end id alone and decode to an empty text; repeated rows and null ids keep a row each;
    an empty table gives none; other columns are not read. Rows stay in their partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = piece_encoder(model)
        for batch in slices(batches, "text"):
            ids = [np.append(x, np.uint32(enc.end_id)) for x in enc.encode(batch.column("text").to_pylist())]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate(ids).astype(np.int32))
            yield pa.record_batch([batch.column("doc_id"), lists, pa.array([enc.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return map_arrow(keyed_texts(docs, id_col, text_col), run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text: encode_pieces without moving ids and texts out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = piece_encoder(model)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in slices(batches, "text"):
            n, ids_sha, text_sha = [], [], []
            for x in enc.encode(batch.column("text").to_pylist()):
                ids = [*x.tolist(), enc.end_id]
                n.append(len(ids))
                ids_sha.append(sha(" ".join(map(str, ids))))
                text_sha.append(sha(enc.library.decode(ids)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(keyed_texts(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_pieces())
