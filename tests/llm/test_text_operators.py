"""Each operator on nulls, empty and very long texts, repeated rows, clashing columns and empty tables, and against a
brute-force version."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tests.compare import rows_of, rows_of_sql
from tests.conftest import SF
from tests.llm.conftest import edge_rows

DOCS = f"{SF}/documents.parquet"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(DOCS)


def by_id(df, *cols):
    return sorted(([r[c] for c in ("doc_id", *cols)] for r in df.collect()), key=repr)


# --- language ID


def test_language_is_told_from_text_alone(spark, docs):
    from voxlake.llm.language_id import op1_query

    got = {r.doc_id: r for r in op1_query(spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_kernel_product_is_the_kernel(spark):
    from voxlake.llm import language_id as li

    texts = ["the cat sat", "le chat dort ici", "the dog sat down"]
    marks = []
    for t in texts:
        m = np.zeros(li.SLOTS, bool)
        li.presence(t, m)
        marks.append(m)
    vocabulary = np.flatnonzero(marks[0] | marks[1])
    base = np.stack([(m[vocabulary] / np.sqrt(m.sum())) for m in marks[:2]]).astype(np.float32)
    got = li.Model([], vocabulary, base.T.copy()).scores(texts)
    for i, a in enumerate(marks):
        for j, b in enumerate(marks[:2]):
            assert got[i, j] == pytest.approx((a & b).sum() / np.sqrt(a.sum() * b.sum()), abs=1e-5)


def test_language_edges(edge, empty):
    from voxlake.llm.language_id import fit, predict

    model = fit(edge)
    got = by_id(predict(edge, model), "lang_pred", "score")
    assert len(got) == len(edge_rows())
    assert [r[1:] for r in got if r[0] in (1, 2, 3, 6, 11)] == [["und", 0.0]] * 5
    assert predict(empty, model).count() == 0
    assert {r.lang_pred for r in predict(edge, fit(empty)).collect()} == {"und"}


# --- repeated strings


@pytest.mark.parametrize("length", [8, 24, 40])
@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcdefgh"])
def test_shards_against_counting(length, alphabet):
    from voxlake.llm.suffix_dedup import repeated_starts

    rng = np.random.default_rng(length)
    for _ in range(10):
        base = bytes(rng.choice(list(alphabet), length * 4).tolist())
        datas = []
        for _ in range(8):
            i = int(rng.integers(0, length * 2))
            x = bytearray(base[i : i + length + int(rng.integers(0, length * 2))])
            if rng.random() < 0.5:
                x[int(rng.integers(len(x)))] = alphabet[0]
            datas.append(bytes(x))
        seen = Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
        want = [[i for i in range(len(d) - length + 1) if seen[d[i : i + length]] > 1] for d in datas]
        for shard in (1 << 20, length * 3):  # one shard, and many that are merged by binary search
            assert [g.tolist() for g in repeated_starts(np.zeros(8, np.int64), datas, length, shard)] == want


def brute_repeats(rows, length):
    datas = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for (doc, _), d in zip(rows, datas, strict=True):
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone)[: len(d)] > 0
        left = np.frombuffer(d, np.uint8)[~mask].tobytes()
        out.append([doc, len(d), int(mask.sum()), int((np.diff(np.append(0, mask.astype(int))) == 1).sum()), hashlib.sha256(left).hexdigest()])
    return sorted(out, key=repr)


def test_repeats_edges_and_hot_groups(edge, empty, monkeypatch):
    from voxlake.llm import suffix_dedup as sd

    def run(df):
        return by_id(df.selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(left, 256) AS d"), "n_bytes", "n_removed", "n_spans", "d")

    rows = [r for r in edge_rows() if len(r[1] or "") < 100_000]
    small = edge.where("length(text) < 100000 OR text IS NULL")
    assert run(sd.remove_repeats(small)) == brute_repeats(rows, 400)
    monkeypatch.setattr(sd, "GROUP", 0)  # every group of one hash counts as too large
    assert run(sd.remove_repeats(small)) == brute_repeats(rows, 400)
    assert sd.remove_repeats(empty).count() == 0


def test_repeats_over_documents(spark, docs):
    from voxlake.llm.suffix_dedup import op2_query

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert by_id(op2_query(spark, SF), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows, 400)


# --- decontamination


def test_lcs():
    from voxlake.llm.decontamination import lcs

    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 4, 12).tolist(), rng.integers(0, 4, 15).tolist()
        t = np.zeros((13, 16), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert lcs(a, b) == t[-1, -1]


def test_word_terms_agree_with_a_plain_split():
    from voxlake.llm.decontamination import word_terms

    texts = ["The Cat, the cat!", None, "", "  cat\nthe  ", "été 42"]
    terms, at = word_terms(texts)
    per = [terms[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)]
    assert list(map(len, per)) == [4, 0, 0, 2, 2] and per[0][:2] == per[0][2:] == per[3][::-1]


def test_exact_and_reworded_passages_are_found_and_others_kept(spark, docs):
    from voxlake.llm.decontamination import find_leaks

    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench = {r.item_id: r.text for r in items.collect()}
    whole = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    clean = [(i, t) for i, t in rows if not any(whole(b) in whole(t) for b in bench.values())]
    planted, want = [], set()
    for n, (item, text) in enumerate(sorted(bench.items())):
        words, host = text.split(), clean[n][1]
        changed = [w if k % 8 else "altered" for k, w in enumerate(words)] if n % 2 else words
        planted.append((10_000 + n, host[: len(host) // 2] + "\n" + " ".join(changed) + "\n" + host[len(host) // 2 :]))
        want.add((10_000 + n, item))
    df = spark.createDataFrame(clean + planted, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(df, items).collect()}
    assert len(got & want) >= 0.95 * len(want) and not {d for d, _ in got if d < 10_000}


def test_decontamination_in_blocks_of_items(spark):
    from tests.conftest import SF
    from voxlake.llm.decontamination import find_leaks

    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole, parts = ({(r.doc_id, r.item_id) for r in find_leaks(docs, items, k).collect()} for k in (1000, 15))
    assert whole and whole == parts


def test_all_of_a_large_benchmark_is_found_verbatim_and_reworded(spark):
    from voxlake.llm.decontamination import KEPT, build_index, document_frequencies, find_leaks

    items = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    docs = spark.read.parquet(DOCS)
    hosts = [r.text for r in docs.where("length(text) > 400").orderBy("doc_id").limit(50).collect()]
    long_ = (1_000_000, " ".join(f"far{k}" for k in range(700)))
    rows, want = [], set()
    for item, text in [*((r.item_id, r.text) for r in items.collect()), long_]:
        for n, words in enumerate((text.split(), [w if k % 8 else "altered" for k, w in enumerate(text.split())])):
            host = hosts[item % 50]
            rows.append((10 * item + n, host[:200] + "\n" + " ".join(words) + "\n" + host[200:]))
            want.add((10 * item + n, item))
    bench = items.select("item_id", "text").union(spark.createDataFrame([long_], "item_id long, text string"))
    assert len(want) == 402
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")), bench).collect()}
    assert len(want - got) <= 0.01 * len(want), sorted(want - got)
    assert build_index(items, *document_frequencies(docs)).kept.min() >= KEPT


def test_decontamination_edges(spark, edge, empty):
    from voxlake.llm.decontamination import find_leaks

    items = spark.createDataFrame([(1, "jumps over the lazy dog and then runs away from the big bad wolf"), (2, None), (3, ""), (4, "!!")], "item_id long, text string")
    got = [r.doc_id for r in find_leaks(edge, items).collect()]
    assert sorted(got, key=repr) == sorted([0, 5, 5, None], key=repr)
    assert find_leaks(empty, items).count() == 0 and find_leaks(edge, items.where("false")).count() == 0


# --- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for k, p in BASE.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d or "1"), "phone": 9 <= len(d) <= 15}[k]:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return out


def test_personal_spans_against_plain_patterns(spark, docs):
    from voxlake.llm.pii import personal_spans

    rng = np.random.default_rng(1)
    signs = list("aZ09._%+-@ ().é1234567890\n")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + i, "".join(rng.choice(signs, int(rng.integers(0, 120))))) for i in range(1500)]
    got = {r.doc_id: r for r in personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert [f"{s.kind}:{s.start}:{s.end}" for k in BASE for s in got[i][k]] == base_spans(t)


def test_personal_spans_edges(spark, edge, empty):
    from voxlake.llm.pii import personal_spans

    assert personal_spans(edge).count() == len(edge_rows()) and personal_spans(empty).count() == 0
    rows = [(0, "1" * 30_000), (1, "a" * 60_000 + "@"), (2, "+1" + " " * 50_000), (3, "1-" * 30_000), (4, "iban DE89 3704 0044 0532 0130 00 or DE89 3704 0044 0532 0130 01"), (5, "ssn 078-05-1120"), (6, "part 078-05-1120"), (7, 'my token = "' + "0f" * 20 + '"'), (8, "sum " + "0f" * 20), (9, "api key AKIA" + "B2" * 8 + ".")]
    got = {r.doc_id: r for r in personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [s.value for s in got[4].iban] == ["DE89 3704 0044 0532 0130 00"] and got[4].iban[0].score == 1.0
    assert len(got[5].ssn) == 1 and not got[6].ssn and [len(got[i].secret) for i in (0, 7, 8, 9)] == [0, 1, 0, 1] and not any(got[i].card for i in range(4))


# --- line dedup


def test_perfect_hash():
    from voxlake.llm.line_dedup import PerfectHash

    for n in (1, 2, 5, 1000, 20_000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
        assert sorted(PerfectHash.build(keys).slots(keys).tolist()) == list(range(len(keys)))


def test_index_of_lines_that_share_half_their_hash(spark):
    from voxlake.llm.line_dedup import Shard, build_index

    (r,) = build_index(spark.createDataFrame([(7, 1, 10), (7, 2, 11), (9, 1, 12)], "h1 long, h2 long, n long"), 3).collect()
    got = Shard(r.n, r.turn, bytes(r.seeds), bytes(r.fingerprints), bytes(r.counts)).count(np.array([[7, 1], [7, 2], [9, 1], [9, 3]], "<u8"))
    assert r.turn > 0 and got.tolist() == [10, 11, 12, 0]


def test_lines_against_sql(spark, duck):
    from voxlake.llm.line_dedup import OP7_SQL, op7_query

    assert rows_of(op7_query(spark, SF)) == rows_of_sql(duck, OP7_SQL)


def test_lines_edges_and_both_ways(spark, edge, empty, monkeypatch):
    from voxlake.llm import line_dedup
    from voxlake.llm.line_dedup import drop_common_lines

    common = spark.createDataFrame([(100 + i, f" Shared LINE\t\nown {i}\n\nshared line") for i in range(12)], "doc_id long, text string")
    df = edge.select("doc_id", "text", "mark", "shard", "hits").unionByName(common, allowMissingColumns=True)
    one = by_id(drop_common_lines(df), "text", "n_lines", "n_dropped")
    assert one == by_id(drop_common_lines(df, max_broadcast_bytes=0), "text", "n_lines", "n_dropped")
    monkeypatch.setattr(line_dedup, "GROUP", 1 << 10)
    assert one == by_id(drop_common_lines(df, max_broadcast_bytes=0), "text", "n_lines", "n_dropped")
    got = {r[0]: r[1:] for r in one}
    assert got[103] == ["own 3\n", 4, 2] and got[1] == ["", 1, 0] and got[3] == [" \n\t \n", 3, 0] and len(one) == len(edge_rows()) + 12
    assert drop_common_lines(empty).count() == 0


# --- SimHash


def brute_fingerprint(t, size):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius):
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    f = np.array(fps, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= radius) + i + 1:
            a, b = root(i), root(int(j))
            if a != b:
                up[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(ids))]


def test_near_duplicates_against_all_pairs(spark, docs):
    from voxlake.llm.simhash import op10_query

    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    fps = [brute_fingerprint(t, 3) for _, t in rows]
    want = [[i, format(f, "016x"), c] for (i, _), f, c in zip(rows, fps, brute_components([i for i, _ in rows], fps, 3), strict=True)]
    assert by_id(op10_query(spark, SF), "fingerprint", "component_id") == sorted(want, key=repr)


@pytest.mark.parametrize("tile", [1 << 14, 8])
def test_links_join_dense_groups(spark, monkeypatch, tile):
    from voxlake.llm import simhash
    from voxlake.llm.components import connected_components

    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    f = np.unique(np.concatenate([np.bitwise_xor(base[i % 4], np.uint64(1) << rng.integers(0, 64, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, dtype=np.uint64)) for i in range(400)], axis=None))
    df = spark.createDataFrame([(x.tobytes(), int(x.view(np.int64))) for x in f], "fp binary, node long")
    roots = {r.node: r.root for r in connected_components(simhash.near_links(df, 1, 3, 6, 3), "a", "b").collect()}
    nodes = f.view(np.int64).tolist()
    assert [roots.get(n, n) for n in nodes] == brute_components(nodes, f.tolist(), 3)


def test_bit_sliced_distances():
    from voxlake.llm.simhash import planes, within

    rng = np.random.default_rng(3)
    f = rng.integers(0, 1 << 63, (300, 2), dtype=np.uint64)
    f[100:200] = f[:100] ^ (np.uint64(1) << rng.integers(0, 64, (100, 2), dtype=np.uint64))
    p = planes(f)
    for lag in (1, 63, 64, 100, 299):
        for radius in (0, 2, 3, 60):
            want = np.flatnonzero(np.bitwise_count(f[:-lag] ^ f[lag:]).sum(1) <= radius)
            assert within(p, 300, lag, radius).tolist() == want.tolist()


def test_near_duplicates_edges(edge, empty):
    from voxlake.llm.simhash import near_duplicates, similar_documents

    got = by_id(near_duplicates(edge), "component_id")
    comp = {r[0]: r[1] for r in got}
    assert len(got) == len(edge_rows()) and comp[5] == 0 and comp[2] == comp[3] == comp[11] == 1
    assert near_duplicates(empty).count() == 0 and similar_documents(edge).count() == len(edge_rows())


def test_components_of_a_long_chain(spark):
    from voxlake.llm.components import connected_components

    df = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "x long, y long")
    got = {r.node: r.root for r in connected_components(df, "x", "y").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert connected_components(df.where("false"), "x", "y").count() == 0


def test_texts_without_a_letter_have_no_language(spark):
    from voxlake.llm.language_id import fit, predict

    rows = [(i, ("the road and the river " if i % 2 else "der Weg und der Fluss ") * (3 + i % 5), "en" if i % 2 else "de") for i in range(60)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = ["12 ½ ² ①", "Ⅷ ③ 7", "", None, "__ 4", "é", "語"]
    got = predict(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in got] == [True] * 5 + [False] * 2 and all(r.score == 0 for r in got[:5])


def test_leaks_in_other_case_are_found(spark):
    from voxlake.llm.decontamination import find_leaks

    words = [f"{a}é{b}ß" for a in "kvlmnpqr" for b in "aeiouyzx"]
    item = " ".join(words[:40])
    filler = " ".join(f"wort{i % 50}" for i in range(300))
    docs = [(0, f"{filler} {item.upper()} {filler}"), (1, f"{filler} {item.title()}"), (2, filler), (3, item)]
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, filler[::-1][:200])], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(0, 7), (1, 7), (3, 7)}
