"""Whole-text encoding with a public tokenizer file, shared by the record writer and the packer."""

from __future__ import annotations

import os
import re

import numpy as np

#: Chunks in the young half of a Python worker's store. When it is full it becomes the old half; chunks met again move back.
MAX_CHUNKS = 200_000
#: Bytes up to which a chunk is kept there; longer ones hardly come again.
MAX_KEPT = 64
#: Unicode blanks besides ASCII's: texts that hold one are cut by the slower rule.
_RARE_BLANK = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_CUT = re.compile(r"(?<=\S)(?= \S)")

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[10, *(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<|>")]] = True

_rng = np.random.default_rng(20)
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = int(_rng.integers(1, 1 << 62)) * 2 + 1
_STEP_INV = pow(_STEP, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_encoders: dict[tuple[str, bool], "ChunkEncoder"] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash's step and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_STEP, _STEP_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


class ChunkEncoder:
    """ids of whole texts by the tokenizers library, asking it once for each chunk that repeats.

    The byte-level pre-tokenizer always starts a new pre-token at a blank between two non-blank
    characters, at a mark after an ASCII letter, and at an ASCII letter after a line feed that stands
    alone. Texts are cut at these places with array operations, a chunk's ids are looked up or asked for,
    and a text's ids are those of its chunks. Equal chunks of a slice are found by a 64-bit hash.
    """

    def __init__(self, path: str, plain: bool = False):
        """plain: the strings of special tokens are encoded like any other text."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain
        one = lambda t: self.tok.encode(t, add_special_tokens=False)
        lead, self.newline = one(" ").tokens[0], one("\n").ids[0]
        self.opens = np.zeros(self.tok.get_vocab_size(), dtype=bool)
        for token, i in self.tok.get_vocab().items():
            self.opens[i] = token.startswith(lead)
        self.young: dict[bytes, bytes] = {}  # chunk to little-endian unsigned 32-bit ids
        self.old: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _joined(self, chunks: list[bytes], sep: bytes) -> None:
        """Encode chunks fifty at a time, each led by sep (a blank that is part of it, or a line feed that isn't)."""
        for lo in range(0, len(chunks), 20_000):
            part = chunks[lo : lo + 20_000]
            runs = [(sep if sep == b"\n" else b"") + (sep if sep == b"\n" else b"").join(part[i : i + 50]) for i in range(0, len(part), 50)]
            ids = np.array([i for e in self.tok.encode_batch_fast([r.decode() for r in runs], add_special_tokens=False) for i in e.ids], dtype="<u4")
            starts = np.flatnonzero(ids == self.newline if sep == b"\n" else self.opens[ids])
            if len(starts) != len(part):  # the file cuts otherwise than foreseen: one by one
                for c in part:
                    self.young[c] = self._ids(c.decode())
                continue
            data, first = ids.tobytes(), (starts + (sep == b"\n")) * 4
            for c, a, b in zip(part, first.tolist(), [*(starts[1:] * 4).tolist(), len(data)], strict=True):
                self.young[c] = data[a:b]

    def _look_up(self, chunks: list[bytes]) -> list[bytes]:
        """chunks: distinct."""
        if len(self.young) >= MAX_CHUNKS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        got = list(map(young.get, chunks))
        lost = [i for i, g in enumerate(got) if g is None]
        if lost:
            led, bare, rest = [], [], []
            for i in lost:
                c = chunks[i]
                if (g := old.get(c)) is not None:
                    young[c] = g
                    continue
                inner = c[1:].split()
                if len(inner) == 1 and len(inner[0]) == len(c) - 1 and c[:1] == b" ":
                    led.append(c)
                elif len(c.split()) == 1 and not c[:1].isspace() and not c[-1:].isspace():
                    bare.append(c)
                else:
                    rest.append(c)
            self._joined(led, b" ")
            self._joined(bare, b"\n")
            for c, e in zip(rest, self.tok.encode_batch_fast([c.decode() for c in rest], add_special_tokens=False), strict=True):
                young[c] = np.array(e.ids, dtype="<u4").tobytes()
            for i in lost:
                c = chunks[i]
                got[i] = young[c] if len(c) <= MAX_KEPT else young.pop(c)
        return got

    def forget(self) -> None:
        """Empty the store."""
        self.young, self.old = {}, {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text (null: none)."""
        out: list[np.ndarray | None] = [None] * len(texts)
        some, datas = [], []
        for k, t in enumerate(texts):
            if not t:
                out[k] = np.empty(0, "<u4")
            elif not t.isascii() and _RARE_BLANK.search(t) or t.isascii() and any(c in t for c in "\x1c\x1d\x1e\x1f"):
                out[k] = np.frombuffer(self._look_up_all([c.encode() for c in _CUT.split(t)]), "<u4")
            else:
                some.append(k)
                datas.append(t.encode())
        if not some:
            return out
        data = b"".join(datas)
        b = np.frombuffer(data, np.uint8)
        n, heads = len(b), np.cumsum([0, *map(len, datas)])
        blank = _BLANK[b]
        cut = np.zeros(n + 1, bool)
        solid = ~blank
        cut[1 : n - 1] = (b[1:-1] == 32) & solid[:-2] & solid[2:]
        letter = _LETTER[b]
        cut[1:n] |= _MARK[b[1:]] & letter[:-1]
        cut[2:n] |= letter[2:] & (b[1:-1] == 10) & solid[:-2]
        for shift in (-1, 0, 1):  # neighbours in another text don't count
            at = heads[1:-1] + shift
            cut[at[(at > 0) & (at < n)]] = False
        cut[heads] = True
        at = np.flatnonzero(cut)
        up, down = _power(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[b] * up, out=total[1:])
        key = (total[at[1:]] - total[at[:-1]]) * down[at[:-1]]
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        ids = self._look_up([data[i:j] for i, j in zip(at[first].tolist(), at[first + 1].tolist(), strict=True)])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begins, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), "<u4")
        size = sizes[which]
        ends = np.cumsum(size)
        all_ids = flat[np.repeat(begins[which] - (ends - size), size) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])[np.searchsorted(at, heads)]
        for k, i, j in zip(some, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[k] = all_ids[i:j]
        return out

    def _look_up_all(self, chunks: list[bytes]) -> bytes:
        known = dict(zip(u := list(dict.fromkeys(chunks)), self._look_up(u), strict=True))
        return b"".join([known[c] for c in chunks])


def encoder(path: str, plain: bool = False) -> ChunkEncoder:
    if (path, plain) not in _encoders:
        _encoders[path, plain] = ChunkEncoder(path, plain)
    return _encoders[path, plain]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
