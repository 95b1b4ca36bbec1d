import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SF
from tests.llm.conftest import edge_rows

ODD = ["", "a", "a ", "a  b", " a", "  a", "a\n b", "a \nb", "x<|endoftext|> y", "  q 　 r", "it's  we'll \t x\x1c y", "a.\n\nb", "a.\nb c.d,e\n", "\nx", "é.\né x's 't", "<|endoftext|>\nfoo.<|endoftext|>.bar", "a\x00b c", "a.\r\nb \r c", "a<b|c>d <|endoftext|", "don't've  'll x 'sx"]


def plain_ids(text, end):
    from tokenizers import Tokenizer

    from voxlake.llm.token_ids import default_tokenizer

    if not hasattr(plain_ids, "tok"):
        plain_ids.tok = Tokenizer.from_file(default_tokenizer())
    return np.array([*plain_ids.tok.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_encoder_gives_the_librarys_ids():
    from voxlake.llm.token_ids import default_tokenizer, encoder

    rng = np.random.default_rng(5)
    signs = list("aB é.,!'\n\t  <|>1 😀sx-")
    texts = ODD + ["".join(rng.choice(signs, int(rng.integers(1, 60)))) for _ in range(600)]
    got = encoder(default_tokenizer()).encode(texts)
    for t, x in zip(texts, got, strict=True):
        assert np.append(x, 0).tolist() == plain_ids(t, 0).tolist(), repr(t)


def test_crc32c():
    from voxlake.llm.token_records import _T, crc32c

    def slow(p):
        s = 0xFFFFFFFF
        for x in p:
            s = int(_T[(s ^ x) & 255]) ^ (s >> 8)
        return s ^ 0xFFFFFFFF

    parts = [b"123456789", b"", b"abc", b"abcd", *(np.random.default_rng(n).bytes(n) for n in (255, 256, 257, 1000, 5000, 70_000))]
    assert crc32c(parts) == [slow(p) for p in parts] and crc32c(parts[:1]) == [0xE3069283]


def test_records_round_trip(spark, edge, empty, tmp_path):
    from voxlake.llm import token_records as tr
    from voxlake.llm.token_ids import default_tokenizer

    path = str(tmp_path / "r")
    tr.write_records(edge, path, default_tokenizer(), 0, files=4)
    index = tr.build_index(spark, path)
    rows = sorted(tr.with_starts(index).collect(), key=lambda r: r.start)
    want = sorted(edge_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (doc, text) in zip(rows, want, strict=True):
        ids = plain_ids(text, 0)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = {tuple(r.ids) for r in tr.read_shuffled(spark, path, index, 3).collect()}
    assert got == {tuple(plain_ids(t, 0).tolist()) for _, t in want}
    tr.write_records(empty, str(tmp_path / "e"), default_tokenizer(), 0, files=2)
    assert tr.build_index(spark, str(tmp_path / "e")).count() == 0


def test_damage_is_found():
    from voxlake.llm.token_records import frames, read_frames

    data = b"".join(f + b"\n" for f in frames([b"hello", b"world"]))
    assert read_frames(data)[1] == [b"hello", b"world"]
    with pytest.raises(ValueError):
        read_frames(data[:14] + b"X" + data[15:])


def check_pieces(pieces, rows, limits):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.ids_crc32 and p.doc_id, [])
        by_seq.setdefault(p.sequence_id, []).append(p)
    padding = 0
    for ps in by_seq.values():
        ps.sort(key=lambda p: p.offset)
        at = 0
        for p in ps:
            assert p.offset == at
            at += p.length
        assert at <= limits.tokens and len(ps) <= limits.segments and sum(p.loss_tokens for p in ps) <= limits.loss_tokens
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padding


def test_packing_places_every_id_once(spark, edge, empty):
    from voxlake.llm import vector_packing as vp
    from voxlake.llm.token_ids import default_tokenizer

    rows = [r for r in edge_rows() if r[0] not in (5,)]
    pieces = vp.pack_texts(edge.where("doc_id <> 5 OR doc_id IS NULL").coalesce(1), default_tokenizer()).collect()
    for doc, text in rows:
        ids, at = plain_ids(text, 1), 0
        for p in sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert check_pieces(pieces, rows, vp.Limits()) == 0
    assert vp.pack_texts(empty, default_tokenizer()).count() == 0
    assert vp.pack_texts(edge, default_tokenizer()).where("doc_id = 5 AND start = 0").count() == 2


def test_packing_of_instructions_keeps_all_limits(spark):
    from voxlake.llm import vector_packing as vp
    from voxlake.llm.token_ids import default_tokenizer

    rows = [(i, "ask " * (5 + i % 90), "answer " * (3 + (i * 7) % 120)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, prompt string, text string").coalesce(1)
    limits = vp.Limits(tokens=256, segments=4, loss_tokens=150)
    pieces = vp.pack_texts(df, default_tokenizer(), limits=limits, prompt_col="prompt").collect()
    check_pieces(pieces, rows, limits)
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
        want = p.doc_tokens
    assert len(total) == 200 and all(total[p.doc_id] == p.doc_tokens for p in pieces) and want


def test_audio_is_aligned(spark):
    from pyspark.sql import functions as F

    from voxlake.llm import chroma as c

    rng = np.random.default_rng(0)
    v = rng.normal(0, 0.125, 64)
    clips = [v, v[8:], v + rng.normal(0, 0.01, 64), rng.normal(0, 0.125, 64), v]
    rows = [(i, bytearray(c.melody_wav(x.tolist()))) for i, x in enumerate(clips)] + [(5, None), (6, bytearray(b"junk")), (7, bytearray())]
    prints = c.fingerprints(spark.createDataFrame(rows, "vec_id long, audio binary").withColumn("codes", F.lit(1)), "vec_id", "audio")
    got = {r.id: r for r in c.align(prints, F.col("id") % 2 == 0).collect()}
    assert got[0].match_id == 1 and got[0].offset == -16 and got[0].bit_error < 0.01 and got[0].n_copies == 2
    assert got[4].class_id == 0 and got[2].n_matches == 2 and got[3].n_matches is None
    assert got[6].n_codes == 0 and got[6].class_id == 5 and got[6].n_matches == 0 and got[6].n_copies == 3
    assert c.align(prints.where("false"), F.lit(True)).count() == 0
    nameless = c.align(prints.withColumn("id", F.when(F.col("id") != 0, F.col("id"))), F.lit(True)).collect()
    assert len(nameless) == len(rows) and {r.class_id for r in nameless if r.id is None} == {4}
    alone = c.align(prints.where("id = 3").withColumn("id", F.lit(None).cast("long")), F.lit(True)).collect()
    assert [(r.class_id, r.n_copies, r.n_matches, r.match_id) for r in alone] == [(None, 1, 0, None)]


def test_blocks_give_what_counting_pairs_gives(monkeypatch):
    from collections import Counter

    from voxlake.llm import chroma as c

    rng = np.random.default_rng(3)
    lists = [rng.integers(-3, 3, n).astype(np.int32) for n in (0, 40, 25, 60, 1, 33)]
    lists.append(np.concatenate([lists[3][7:], lists[1]]))
    table = pa.table({"id": pa.array(range(10, 17), pa.int64()), "codes": pa.array([x.tolist() for x in lists], pa.list_(pa.int32()))})
    starts = [[k for k in range(len(x)) if k == 0 or x[k] != x[k - 1]] for x in lists]
    want = {}
    for i, x in enumerate(lists):
        for j, y in enumerate(lists):
            seen = Counter(b - a for a in starts[i] for b in starts[j] if x[a] == y[b])
            votes, _, o = max(((v, -abs(o), o) for o, v in seen.items()), default=(0, 0, 0))
            if i == j or votes < 5:
                continue
            pairs = [(int(x[k]) ^ int(y[k + o])) & 0xFFFFFFFF for k in range(len(x)) if 0 <= k + o < len(y)]
            want[10 + i, 10 + j] = (votes, o, sum(map(int.bit_count, pairs)) / (32.0 * len(pairs)))
    for hits in (c.HITS, 50):
        monkeypatch.setattr(c, "HITS", hits)
        block = c._Codes.of(table, "id")
        got = {(int(q), int(m)): (int(v), int(o), float(e)) for q, m, v, o, e in zip(*c.block_matches(block, block, 5, 1.0), strict=True)}
        assert got == want and len(want) > 10


def test_integral_image_filters_equal_plain_sums():
    from voxlake.llm import chroma as c

    x = c.chroma(c.samples(c.melody_wav(np.linspace(-0.3, 0.3, 20).tolist())))
    assert np.allclose(np.linalg.norm(x, axis=1), 1) and len(c.codes(c.melody_wav([0.1] * 20))) == len(x) - c.WIDTH + 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu item, one. Two.</a></li></ul></nav><div class="ad-box">Buy now, it is cheap.</div>
<article><h1>Head &amp; line</h1><p><b>First   paragraph, with some words.<br><p>Second&nbsp;one has <a href="x">a link</a> and more, much more text.
<div id="comments"><p>Nice post, thanks, really.</p></div><form><input name=q>Your mail, please.</form></article>
<aside>Also read, this. And that.</aside><div class="cookie notice">We use cookies, always.</div><footer>&copy; us</footer></body></html>"""


def test_article_is_found():
    from voxlake.llm.html_extract import main_text

    assert main_text(PAGE) == "Head & line\nFirst paragraph, with some words.\nSecond one has a link and more, much more text."


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<script>", "<!--", "<p>" * 3000, "plain words only", "<nav>menu</nav>", "a" * 100_000])
def test_odd_pages(page):
    from voxlake.llm.html_extract import main_text

    assert isinstance(main_text(page), str)


def test_pages_against_their_markup(spark):
    import html
    import re

    from voxlake.llm.html_extract import op8_query

    got = {r.page_id: r for r in op8_query(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = r.html[r.html.index("<article>") :].split("</article>")[0]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", p))).strip() for p in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id].text == "\n".join(p for p in parts if p) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_pages_edges(spark):
    from voxlake.llm.html_extract import extract

    df = spark.createDataFrame([(1, "u", None, 1), (1, "u", None, 1), (None, None, "<p>x, y.</p>", 1)], "page_id long, url string, html string, text int")
    assert sorted((r.text, r.n_chars) for r in extract(df).collect()) == [("", 0), ("", 0), ("x, y.", 5)]
    assert extract(df.where("false")).count() == 0


PROSE = "It was a long day, and the road went on; nobody spoke until evening came, when lamps were lit. " * 5


@pytest.mark.parametrize("name", ["layout has-sidebar", "post no-comments", "article-header", "search-results-off", "content"])
def test_names_never_take_the_main_part_away(name):
    from voxlake.llm.html_extract import main_text

    menu = "<ul><li><a href=1>Home</a></li><li><a href=2>About us</a></li></ul>"
    page = f'<html><body><div class="{name}"><p>{PROSE}</p>{menu}<p>{PROSE}</p></div><div class="sidebar"><p>Other pages.</p></div></body></html>'
    assert main_text(page) == "\n".join([PROSE.strip()] * 2)


def test_names_hold_where_the_page_marks_its_article():
    from voxlake.llm.html_extract import main_text

    page = f'<body><div class="ad">{PROSE}</div><article><h1>Short</h1><p>One line.</p></article></body>'
    assert main_text(page) == "Short\nOne line."
    assert main_text(f'<body><div><p>{PROSE}</p></div><div class="comments"><p>{PROSE * 4}</p></div></body>') == PROSE.strip()


def test_held_notes_vote_for_their_length():
    from voxlake.llm.chroma import _Codes, block_matches

    held = np.repeat([7, 9], [40, 30]).astype(np.int32)  # two runs only
    other = np.concatenate([np.arange(100, 110), held]).astype(np.int32)
    q, m = (_Codes(np.array([i]), c, np.array([0, len(c)])) for i, c in ((1, held), (2, other)))
    a, b, votes, offset, error = (x.tolist() for x in block_matches(q, m, 5, 0.3))
    assert (a, b, votes, offset, error) == ([1], [2], [70], [10], [0.0])


def test_a_worker_keeps_chunks_while_tasks_use_them_and_no_long_ones():
    import time

    from voxlake.llm import common, token_ids

    enc = token_ids.ChunkEncoder(token_ids.default_tokenizer())
    long = "ab9" * 400
    kept = common.Kept(enc.forget, 0.2)
    with kept.used():
        first = [x.tolist() for x in enc.encode([f"some words {long} again", "words"])]
        time.sleep(0.5)
        assert enc.young and max(map(len, enc.young)) <= token_ids.MAX_KEPT
        with kept.used():  # the next task comes before the wait is over
            pass
        time.sleep(0.5)
        assert enc.young
    time.sleep(0.7)
    assert not enc.young and not enc.old
    assert [x.tolist() for x in enc.encode([f"some words {long} again", "words"])] == first
    assert first[0] == enc.tok.encode(f"some words {long} again", add_special_tokens=False).ids
