import pytest

from tests.conftest import SF
from tests.llm.conftest import edge_rows


def test_stages_on_odd_documents(spark, edge, empty):
    import corpus_pipeline as cp

    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    for start in (edge.select(*cols), empty.select(*cols)):
        docs = start
        for name, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == cols, name
        left = {r.doc_id for r in docs.collect()}
        assert cp.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == len(left)
    assert not {1, 2, 3, 6, 11} & left


def test_each_stage_does_what_it_says(spark):
    import corpus_pipeline as cp
    from voxlake.llm.simhash import shingle_hashes

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    kept = cp.keep_languages(spark, docs, SF)
    assert kept.count() == n
    near = cp.drop_near_duplicates(spark, kept, SF)
    texts = {r.doc_id: set(shingle_hashes(r.text, 5)) for r in kept.collect()}
    left = {r.doc_id for r in near.collect()}
    alike = lambda a, b: len(texts[a] & texts[b]) / max(1, len(texts[a] | texts[b]))
    for d in sorted(texts):
        best = max((alike(d, o) for o in texts if o < d), default=0)
        if best >= 0.9:
            assert d not in left
        if best < 0.7:
            assert d in left
    clean = cp.drop_leaks(spark, near, SF)
    assert clean.count() <= len(left)
    assert cp.run(spark, SF).count() > 0


def test_sketches_never_differ_more_than_their_sets():
    import numpy as np

    from voxlake.llm.similar import least_difference, sketch

    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 64, 65, 300, 1000):
        for m in (n, max(0, n - n // 5), n // 3):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[:m], rng.integers(0, 1 << 63, n // 7, dtype=np.uint64)]))
            assert least_difference(sketch(a), sketch(b)) <= len(np.setxor1d(a, b))
    far = [np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64)) for _ in range(2)]
    assert least_difference(*map(sketch, far)) > 200


@pytest.mark.parametrize("tile", [1 << 12, 8])
def test_similar_documents_are_those_of_the_exact_similarity(spark, monkeypatch, tile):
    import numpy as np

    from voxlake.llm import similar

    monkeypatch.setattr(similar, "TILE", tile)
    rng = np.random.default_rng(5)
    rows = []
    for k in range(120):  # pairs of similarity about 0.7 to 0.9
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 319)]
        other = list(words)
        for p in np.linspace(5, 310, 4 + k % 8).astype(int):
            other[p] = f"c{k}"
        rows += [" ".join(words), " ".join(other)]
    base = [f"b{x}" for x in range(150)]  # a dense group, and a passage that many hold
    for k in range(40):
        rows.append(" ".join(w if rng.random() > 0.02 else f"x{k}" for w in base))
        rows.append(" ".join([*base[:25], *[f"y{k}_{x}" for x in range(rng.integers(1, 60))]]))
    sets = [set(similar.shingle_hashes(t, 5)) for t in rows]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                lo, hi = sorted((up[i], up[j]))
                up = [lo if u == hi else u for u in up]
    got = similar.similar_documents(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(up))


def test_steps_of_near_duplicates_write_few_files(spark, monkeypatch):
    from voxlake.llm import common, components, similar

    files = {}

    def counted(df, tag, *more):
        out = common.materialise(df, tag, *more)
        files.setdefault(tag, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(similar, "materialise", counted)
    monkeypatch.setattr(components, "materialise", counted)
    docs = spark.createDataFrame([(k, " ".join(f"w{(k // 2 * 7 + x) % 997}" for x in range(90)) + f" end {k}") for k in range(400)], "doc_id long, text string")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for c, v in zip(kept, ("40", "false"), strict=True):
            spark.conf.set(c, v)
        got = {r.doc_id: r.component_id for r in similar.similar_documents(docs, radius=3).collect()}
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert set(files) >= {"edges", "sets", "pairs", "similar", "near-bits"}
    assert max(x for tag, each in files.items() if tag != "prefixes" for x in each) <= common.files_for(spark, 400) < 40
    assert all(got[k] <= k // 2 * 2 for k in range(400))


def test_texts_in_unlearned_languages_go_and_clean_ones_stay(spark):
    import numpy as np

    import corpus_pipeline as cp

    rng = np.random.default_rng(0)
    drawn = lambda letters: " ".join("".join(rng.choice(list(letters), rng.integers(2, 10))) for _ in range(60))
    foreign = [drawn(x) for x in ("абвгдежзиклмнопрст", "αβγδεζηθικλμ", "的一是不了人我在有他", "abcdefghijklmnopqrstuvwxyz")]
    foreign.append("wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa")
    foreign.append("kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    planted = spark.createDataFrame([(10**9 + k, t, None, "s", len(t)) for k, t in enumerate(foreign)], docs.schema)
    kept = {r.doc_id for r in cp.keep_languages(spark, docs.union(planted), SF).select("doc_id").collect()}
    assert not [k for k in range(len(foreign)) if 10**9 + k in kept]
    assert len(kept) >= 0.998 * docs.count()


def test_rows_that_share_an_id_are_decided_each_on_its_own(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 300 AND lang = 'en'").orderBy("doc_id").limit(24)
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    texts = [r.text for r in docs.collect()]
    rows = [(None if k % 2 else 7, f"first {k}\n{t}" + ("\nsaid in many of them" if k < 20 else ""), "en", "s", 0) for k, t in enumerate(texts)]
    bad = [(None, None, "en", "s", 0), (7, "12345", "en", "s", 0), (None, texts[0] + "\n" + leak, "en", "s", 0), (7, leak, "en", "s", 0)]
    start = spark.createDataFrame(rows + bad, docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    assert sorted(r.text for r in cp.keep_languages(spark, start, SF).collect()) == sorted(r[1] for r in rows + bad[2:])
    clean = spark.createDataFrame(rows, start.schema)
    assert sorted(r.text for r in cp.drop_lines(spark, clean, SF).collect()) == sorted(r[1].replace("\nsaid in many of them", "") for r in rows)
    alone = cp.drop_leaks(spark, start.where("text IS NOT NULL"), SF)
    assert not {r[1] for r in bad[2:]} & {r.text for r in alone.collect()} and alone.where("text LIKE 'first%'").count() >= 20
    near = cp.drop_near_duplicates(spark, clean.union(clean), SF)
    assert near.count() == near.select("text").distinct().count() >= 20


def test_near_duplicates_are_those_of_the_fingerprints_and_those_of_the_sets(spark):
    import numpy as np

    import corpus_pipeline as cp
    from voxlake.llm.simhash import fingerprints, shingle_hashes

    rng = np.random.default_rng(8)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    song = " ".join(words(30)) + " "
    often = [song * 80 + " ".join(words(40)) for _ in range(3)]  # few bits differ, the sets are unlike
    base = words(200)
    changed = [" ".join(f"v{k}" if x in (k, k + 12) else w for x, w in enumerate(base)) for k in (20, 100, 180)]
    link = often[2] + " " + " ".join(words(6))  # as near to the song by its bits as by its set to often[2]
    texts = [*(" ".join(words(60)) for _ in range(12)), *often, *changed, link]
    n = len(texts)
    fp = [int(x) for x in fingerprints(texts, 3)[:, 0]]
    sets = [set(shingle_hashes(t, 5)) for t in texts]
    near = lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3
    alike = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    pairs = [(i, j) for j in range(n) for i in range(j)]
    assert any(near(i, j) and not alike(i, j) for i, j in pairs) and any(alike(i, j) and not near(i, j) for i, j in pairs)
    up = list(range(n))
    for i, j in pairs:
        if near(i, j) or alike(i, j):
            lo, hi = sorted((up[i], up[j]))
            up = [lo if u == hi else u for u in up]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0], (None, texts[0], "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    left = [r.doc_id for r in cp.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(left) == sorted(set(up))


def test_fixture_has_all_cases():
    assert {r[0] for r in edge_rows()} >= {None, 1, 5}
    assert pytest
