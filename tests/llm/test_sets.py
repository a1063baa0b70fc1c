"""Near duplicates, URL trees and the pipeline."""

import os

import duckdb
import numpy as np
import pytest

from vectaria.llm import queries, repetition, setsketch, urltree
from vectaria.llm.textbatch import TextBatch

import pyarrow as pa  # isort: skip

SF = "/root/testdata/sf0.001"


def brute(texts, shingle=2, percent=80):
    sets = {}
    for i, t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        sets[i] = set(zip(*[w[k:] for k in range(shingle)], strict=False)) if len(w) >= shingle else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def rows(df):
    return {r.id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.fixture(scope="module")
def copies():
    """Groups of copies at all similarities round the threshold, one large, and unrelated texts."""
    r = np.random.default_rng(3)
    word = lambda: f"w{r.integers(0, 5000)}"
    out = []
    for size in (120, 8, 8, 5, 2, 2):
        base = [word() for _ in range(int(r.integers(20, 120)))]
        for _ in range(size):
            w = list(base)
            for _ in range(int(r.integers(0, max(2, len(w) // 12)))):
                w[int(r.integers(0, len(w)))] = word()
            out.append(" ".join(w))
    out += [" ".join(word() for _ in range(40)) for _ in range(60)]
    return list(enumerate(out))


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates_equal_brute_force(spark, copies, odd_texts, shingle):
    texts = copies + [(1000 + i, t) for i, t in enumerate(odd_texts)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    assert rows(setsketch.near_duplicates(df, shingle=shingle)) == brute(texts, shingle)


def test_small_blocks_give_the_same(spark, copies, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 16)
    df = spark.createDataFrame(copies, "doc_id bigint, text string")
    assert rows(setsketch.near_duplicates(df)) == brute(copies)


def test_batches_that_cut_blocks_and_shuffled_ids_give_the_same(spark, copies, monkeypatch):
    monkeypatch.setattr(setsketch, "BROADCAST_IDS", -1)
    monkeypatch.setattr(setsketch, "BLOCK", 32)
    monkeypatch.setattr(setsketch, "SET_ROWS", "3")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows(setsketch.near_duplicates(spark.createDataFrame(copies, "doc_id bigint, text string"))) == brute(copies)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_similarities_round_the_threshold(spark):
    r = np.random.default_rng(11)
    texts = []
    for k in range(150):
        n = int(r.integers(30, 200))
        base = [f"x{k}_{j}" for j in range(n)]
        # m new last words: (n - 1 - m) / (n - 1 + m) of 2-word shingles
        m = max(1, round((n - 1) * (1 - (s := 0.78 + 0.04 * r.random())) / (1 + s)))
        texts += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: n - m] + [f"y{k}_{j}" for j in range(m)]))]
    got = rows(setsketch.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string")))
    want = brute(texts)
    assert got == want and 30 < sum(not v[2] for v in want.values()) < 120


def thue_morse(size, letters):
    """Two words that polynomials modulo a power of two can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return ["".join(letters[b ^ flip] for b in bits) for flip in (0, 1)]


@pytest.mark.parametrize("size", [8, 256, 512, 1024, 2048, 4096])
@pytest.mark.parametrize("letters", ["ab", "Md", "aé"])
def test_words_that_simple_hashes_confuse(size, letters):
    words = pa.array(thue_morse(size, letters))
    b = TextBatch(words)
    one, two = b.hasher()(b.beg, b.end)
    assert one != two
    own, h = setsketch.shingle_sets(b, 2)
    assert own.tolist() == [0, 1] and h[0] != h[1]
    both = pa.array(["\n".join([*words.to_pylist(), words[0].as_py()])])
    assert repetition._slice(both, 6, 45, 120)[3].tolist() == [1]


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "A b\tc"), (3, None), (4, "")], "doc_id bigint, text string")
    assert rows(setsketch.near_duplicates(df)) == {1: (2, 1, True), 2: (2, 1, False), 3: (0, 3, True), 4: (0, 4, True)}


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 2**63, 900, dtype=np.uint64), r.integers(0, 2**63, 100, dtype=np.uint64)
    x, y = np.concatenate([a, b[:50]]), np.concatenate([a, b[50:]])
    own = np.repeat([0, 1, 2], [len(x), len(y), 1000])
    k = setsketch.sketches(own, np.concatenate([x, y, a, b]), 3, 4 * setsketch.REGISTERS)
    assert (setsketch.merge(k[0], k[1]) == k[2]).all()
    assert abs((k[0] == k[1]).mean() - 0.9) < 0.06
    assert (setsketch.sketches(np.zeros(0, int), np.zeros(0, np.uint64), 2, 8) == 0).all()


def test_tables_leave_little_behind(spark, copies):
    import glob

    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(glob.glob(f"{base}/near-duplicates-*/*"))
    setsketch.near_duplicates(spark.createDataFrame(copies, "doc_id bigint, text string")).count()
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(f"{base}/near-duplicates-*/*")) - before}
    assert left == {"every", "moved"}


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (7, 9), (20, 21)], "a bigint, b bigint")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 7, 8, 9, 20, 21, 30)], "id bigint")
    assert {r.id: r.component for r in setsketch.components(nodes, links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20, 30: 30}


def test_shingles_of_short_texts():
    own, _ = setsketch.shingle_sets(TextBatch(pa.array(["", "a", "a b", "a b a b", None], pa.string())), 2)
    assert np.bincount(own, minlength=5).tolist() == [0, 1, 1, 2, 0]


def test_url_verdicts(spark):
    urls = [None, "nothing", "http://A.net", "http://a.NET/x", "https://b.example.net/en/1?q#z", "http://b.example.net/fr/2", "http://example.com/de/", "http://notexample.com/de/", "http://c.org/fr/9", "HTTP://c.org?x/fr/", "http://net/", "http://e.com://f/g"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr("*", "'q' AS host", "7 AS __n", "1 AS verdict")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urltree.template_tree(df).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("a.net", "", None, "allow"), 3: ("a.net", "/x", "net/", "block"), 4: ("b.example.net", "/en/1", "example.net/en/", "allow"),
        5: ("b.example.net", "/fr/2", "net/", "block"), 6: ("example.com", "/de/", "example.com/de/", "block"), 7: ("notexample.com", "/de/", None, "allow"), 8: ("c.org", "/fr/9", "org/fr/", "allow"),
        9: ("c.org", "", None, "allow"), 10: ("net", "/", "net/", "block"), 11: ("e.com:", "//f/g", None, "allow"),
    }


def test_templates_reject_by_purity(spark):
    rows = [(k, f"http://h.com/{'bad' if k < 40 else 'good'}/{k}") for k in range(80)] + [(100, "http://h.com/bad/x1"), (101, "http://h.com/good/x1")]
    rules = tuple(("block", f"h.com/bad/{k}") for k in range(10, 40)) + tuple(("allow", f"h.com/good/{k}") for k in range(40, 80))
    got = {r.page_id: r.verdict for r in urltree.template_tree(spark.createDataFrame(rows, "page_id bigint, url string"), rules=rules).collect()}
    assert got[5] == "block" and got[101] == "allow"


@pytest.mark.parametrize("name", ["op2_suffix_repetition", "op6_url_template_tree"])
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        p = f"{SF}/{t}.parquet"
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    theirs = db.sql(queries.ORACLE_SQL[name])
    mine = queries.QUERIES[name](spark, SF).select(*theirs.columns)
    assert sorted(map(repr, map(tuple, mine.collect()))) == sorted(map(repr, theirs.fetchall()))


def test_pipeline_on_tables_of_any_kind(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    good = " ".join(f"word{i} stands here" for i in range(40))
    extra = docs.selectExpr("doc_id", "text", "lang", "source", "'x' AS bpe", "1 AS `a.b`")
    rows = spark.createDataFrame([(None, good), (100, good), (101, good.upper()), (102, good + " mail me@mail.org"), (100, good)], "doc_id bigint, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "'x' AS bpe", "1 AS `a.b`")
    for name, table in (("empty", extra.limit(0)), ("odd", extra.union(rows))):
        d = str(tmp_path / name)
        table.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, None)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
        out = pipeline.run(spark, d)
        assert out.columns == [*table.columns, "n_tokens", "ids", "round_trip"]
        got = out.collect()
        assert sorted(str(r.doc_id) for r in got) == ([] if name == "empty" else ["100", "100", "None"]) and all(r.round_trip and r.bpe == "x" for r in got)


def test_pipeline_against_its_parts(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id: r for r in pipeline.run(spark, SF).collect()}
    clean = sorted(r.doc_id for r in repetition.keep_clean(docs).select("doc_id").collect())
    unique = [i for i, (_, _, kept) in brute([(i, texts[i]) for i in clean], 5).items() if kept]
    assert set(out) <= set(unique) and len(out) > 0.9 * len(unique)
    assert all(r.round_trip and r.n_tokens == len(r.ids) and r.n_chars == len(r.text) for r in out.values())
    assert not any("@mail" in r.text for r in out.values())
