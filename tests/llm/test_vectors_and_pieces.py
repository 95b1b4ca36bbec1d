"""Centroids, pieces and aligned tokens against plain versions."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from tests.compare import rows_of, rows_of_sql
from tests.conftest import SF
from tests.llm.conftest import edge_rows


def plain_clusters(rows, k=16, rounds=3, d=64, scale=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, sha(f"1:{r[0]}"), r[1]))[:k]]

    def assign():
        out = []
        for _, v in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)))
        return out

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = assign()
    inertia = Counter()
    for dist, c in found:
        inertia[c] += dist
    return sorted(((i, c, dist, inertia[c], sum(inertia.values()), sha(",".join(map(str, centroids[c])))) for (i, _), (dist, c) in zip(kept, found, strict=True)), key=repr)


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_clusters_of_all_embeddings(spark, duck):
    from voxlake.llm import centroid_clustering as cc

    got = cc.op11_query(spark, SF)
    assert got.columns == COLUMNS
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters(rows)
    assert rows_of(got) == rows_of_sql(duck, cc.OP11_SQL)


def test_clusters_of_odd_vectors(spark):
    from voxlake.llm import centroid_clustering as cc

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=10).tolist()) for i in range(200)]
    rows += [(5, rows[7][1]), (7, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (None, [9e5] * 10)]
    rows += [(900, None), (901, []), (902, [1.0] * 9), (903, [1.0] * 11), (904, [1.0] * 9 + [None]), (905, [float("nan")] * 10), (906, [math.inf] + [0.0] * 9)]
    rows += [(1000 + i, [float(i % 2)] * 10) for i in range(40)]  # ties
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, cluster int, distance double").repartition(5)
    for k, rounds in ((16, 3), (1, 2), (300, 1)):
        got = cc.cluster(df, k=k, rounds=rounds, d=10)
        assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == plain_clusters(rows, k, rounds, 10)
    assert cc.cluster(df.where("false"), d=10).count() == 0 and cc.cluster(df.where("vec_id = 900"), d=10).columns[:6] == COLUMNS
    with pytest.raises(Exception, match="distances are exact below"):
        cc.cluster(spark.createDataFrame([(1, [1e9] * 10)], "vec_id long, embedding array<double>"), d=10)


def test_bounds_never_rule_out_the_nearest():
    from voxlake.llm import centroid_clustering as cc

    rng = np.random.default_rng(4)
    for size in (3, 1000, cc.LIMIT - 1):
        c = rng.integers(-size, size, (20, 21))
        v = np.concatenate([c, c[::-1] + rng.integers(-1, 2, c.shape), rng.integers(-size, size, (300, 21)), np.zeros((1, 21), int)]).astype(np.int64)
        v = np.clip(v, -cc.LIMIT + 1, cc.LIMIT - 1)
        cluster, distance, tried = cc.nearest(v.astype(np.int32), cc.segment_norms(v), c)
        every = ((v[:, None] - c[None]) ** 2).sum(2)
        assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
    near = np.repeat(np.arange(0, 4000, 200), 21).reshape(20, 21)
    assert cc.nearest(near.astype(np.int32), cc.segment_norms(near), near)[2].mean() < 2


def library():
    import sentencepiece

    from voxlake.llm.piece_encoding import default_pieces

    if not hasattr(library, "lib"):
        library.lib = sentencepiece.SentencePieceProcessor(model_file=default_pieces())
    return library.lib


def odd_texts(n):
    rng = np.random.default_rng(6)
    signs = list("ab  e\n▁thein.éß😀本日ゼ\x00▁▁xz0123")
    lib = library()
    pieces = [lib.id_to_piece(i).replace("▁", " ") for i in range(300, lib.vocab_size())]
    texts = ["".join(rng.choice(signs, int(rng.integers(1, 60)))) for _ in range(n)]
    texts += ["".join(rng.choice(pieces, int(rng.integers(1, 12)))) for _ in range(n)]
    texts += [" " * k for k in range(1, 40)] + [" " * k + "the" + " " * (k // 2) for k in range(40)]
    return texts + ["<s>x</s><unk><0x41><|endoftext|>", "z" * 5000, "ab" * 3000, "​", "ﬁ①"]


def test_piece_encoder_gives_the_librarys_ids():
    from voxlake.llm.piece_encoding import default_pieces, piece_encoder

    enc = piece_encoder(default_pieces())
    texts = odd_texts(3000)
    for t, x in zip(texts, enc.encode(texts), strict=True):
        assert x.tolist() == library().encode(t), repr(t)
    # the quick test of a pair says what merging its text says
    tested = [(a, b, known) for a, found in enumerate(enc.after[:-1]) for b, known in found.items()][::10]
    wrong = [1 for a, b, known in tested if known != (enc.merged(enc.piece[a] + enc.piece[b]) == [enc.piece[a], enc.piece[b]])]
    assert len(tested) > 1000
    assert not wrong


def test_pieces_query(spark):
    from voxlake.llm.piece_encoding import op12_query

    got = sorted(map(tuple, op12_query(spark, SF).collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library().encode(r.text or "", add_eos=True)
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library().decode(ids))))
    assert got == sorted(want)


def test_pieces_of_odd_rows(spark, edge, empty):
    from voxlake.llm.piece_encoding import default_pieces, encode_pieces

    rows = encode_pieces(edge, default_pieces()).collect()
    want = [(i, library().encode(t or "", add_eos=True), t or "") for i, t in edge_rows()]
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in rows), key=repr) == sorted(want, key=repr)
    assert encode_pieces(empty, default_pieces()).count() == 0


def plain_alignment(rows):
    """Groups by cutting at shared ends, links by pairing all tokens of each group."""
    from tokenizers import Tokenizer

    from voxlake.llm.token_alignment import byte_alphabet
    from voxlake.llm.token_ids import default_tokenizer

    tok, lib, alphabet = Tokenizer.from_file(default_tokenizer()), library(), byte_alphabet()
    tok.encode_special_tokens = True

    def b_bytes(i):
        p = lib.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace("▁", " ").encode()

    docs = []
    for doc, text in rows:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = lib.encode(text) if text else []
        data = (" " + text).encode() if text else b""
        ab, bb = [bytes(alphabet[c] for c in tok.id_to_token(i)) for i in a], [b_bytes(i) for i in b]
        if b"".join(ab) != data or b"".join(bb) != data:
            a, b, ab, bb = [], [], [], []
        ends = [np.cumsum([len(x) for x in t]).tolist() for t in (ab, bb)]
        both, groups, now = set(ends[0]) & set(ends[1]), [], ([], [])
        marks = sorted([(e, k, i) for k, (ids, end) in enumerate(zip((a, b), ends, strict=True)) for i, e in zip(ids, end, strict=True)], key=lambda x: x[0])
        for at, (e, k, i) in enumerate(marks):
            now[k].append(i)
            if e in both and (at + 1 == len(marks) or marks[at + 1][0] > e):
                groups.append(now)
                now = ([], [])
        found = Counter()
        for ga, gb in groups:
            for x, n in Counter(ga).items():
                for y, m in Counter(gb).items():
                    found[x, y] += n * m
        docs.append((doc, a, b, groups, found))
    held = Counter(p for *_, found in docs for p in found)
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for doc, a, b, groups, found in docs:
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        best, total = sum(n for p, n in found.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in found.items())
        out.append((doc, len(a), len(b), len(groups), sum(found.values()), best, total, hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=repr)


def test_alignment_query(spark):
    from voxlake.llm.token_alignment import op13_query

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, op13_query(spark, SF).collect()), key=repr) == plain_alignment(rows)


def test_alignment_of_odd_texts(spark, edge, empty, monkeypatch):
    from voxlake.llm import token_alignment as ta
    from voxlake.llm.piece_encoding import default_pieces
    from voxlake.llm.token_ids import default_tokenizer

    got = ta.align_tokens(edge, default_tokenizer(), default_pieces())
    assert sorted(map(tuple, got.collect()), key=repr) == plain_alignment(edge_rows())
    assert ta.align_tokens(empty, default_tokenizer(), default_pieces()).count() == 0
    rows = list(enumerate(odd_texts(200)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_alignment(rows)
    assert any(r[1] == 0 for r in want)  # U+2581 comes back as a space
    assert sorted(map(tuple, ta.align_tokens(df, default_tokenizer(), default_pieces()).collect()), key=repr) == want


def test_links_are_spread_out_in_bounded_parts(monkeypatch):
    from voxlake.llm import token_alignment as ta

    rng = np.random.default_rng(8)
    a_group, b_group = np.sort(rng.integers(0, 20, 300)), np.sort(rng.integers(0, 20, 400))
    doc = np.sort(rng.integers(0, 3, 20))
    a, b = rng.integers(0, 30, 300), rng.integers(0, 30, 400)
    whole = ta.links(doc, a, a_group, b, b_group, 100)
    want = Counter((int(doc[g]), int(x) * 100 + int(y)) for x, g in zip(a, a_group, strict=True) for y, h in zip(b, b_group, strict=True) if g == h)
    assert {(d, p): n for d, p, n in zip(*map(np.ndarray.tolist, whole), strict=True)} == want
    monkeypatch.setattr(ta, "SPREAD", 7)
    assert all((x == y).all() for x, y in zip(whole, ta.links(doc, a, a_group, b, b_group, 100), strict=True))
