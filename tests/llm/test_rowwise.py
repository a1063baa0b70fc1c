"""Row-wise operators against brute force, and their edge cases."""

import base64
import hashlib
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from vectaria.llm import boosting, bpe, decontaminate, langid, pii, qda, queries, repetition, secrets, tokencount
from vectaria.llm.textbatch import TextBatch, in_slices

MULTI, PLAIN = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"
ALPHABET = "aaeth  \n\t'’s é漢字12٣!?😀'sd'll've\x1c\x85 _ʼª\x0b@.+-#"


def soup(rng, n, most=60, alphabet=ALPHABET):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


def encoding(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


# ---- repetition


def brute_repetition(text, min_repeat, long_repeat):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, reach = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            reach[i] = max(reach[i], k)
    covered = {i + o for i in range(n) if reach[i] >= min_repeat for o in range(reach[i])}
    triple = {i + o for i in range(n) if reach[i] >= 3 for o in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = n < 50 or 100 * len(triple) > 50 * n
    longest = max(reach, default=0)
    longest = longest if longest >= 3 else 0
    return [n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(triple), len(covered), longest, failed, not failed and 100 * len(covered) <= 45 * n and longest < long_repeat]


def test_repetition_equals_brute_force(rng, odd_texts):
    texts = [t for t in odd_texts if len(t or "") < 3000] + [" ".join(rng.choice(["a", "b", "c\n", "d"] + [f"w{k}" for k in range(k0)]) for _ in range(rng.randint(0, 90))) for k0 in (0, 5, 40, 300) for _ in range(30)]
    got = in_slices(pa.array(texts, pa.string()), lambda t: repetition._slice(t, 6, 45, 20))
    for t, *row in zip(texts, *[c.to_pylist() for c in got], strict=True):
        assert row == brute_repetition(t, 6, 20), t


def test_suffix_array_sorts_suffixes(rng):
    x = np.array([rng.randint(0, 3) for _ in range(200)])
    doc = np.repeat([0, 1, 2], [50, 1, 149])
    order, levels = repetition.suffix_array(x, doc)
    stops = {0: 50, 1: 51, 2: 200}
    suffix = lambda i: (doc[i], tuple(x[i : stops[doc[i]]]))
    assert [suffix(i) for i in order] == sorted(suffix(i) for i in range(200))


def test_keep_clean_keeps_columns(docs):
    r = repetition.keep_clean(docs)
    assert r.columns == docs.columns and r.count() == 0
    long = docs.sparkSession.createDataFrame([(1, " ".join(f"w{i}" for i in range(80)))] * 2, "doc_id bigint, text string")
    assert repetition.keep_clean(long).count() == 2


# ---- byte-level BPE and counts


@pytest.mark.parametrize("path", [MULTI, PLAIN])
def test_bpe_equals_library(rng, odd_texts, path):
    texts = [*odd_texts, "a'sx's't 'll ''s d'dd", "ab" * 3000, "th" * 2000, " " * 300, "éé" * 100, *soup(rng, 3000)]
    e = encoding(path)
    n, ids, plain = (c.to_pylist() for c in bpe._texts(pa.array(texts, pa.string()), path, True))
    for t, a, b, c in zip(texts, n, ids, plain, strict=True):
        want = e.encode_ordinary(t or "")
        assert (a, b) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()), t
        assert c == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_ids_round_trip(docs, odd_texts):
    r = bpe.bpe(docs, ranks=MULTI).select("doc_id", "id", "bpe.*").orderBy("doc_id").collect()
    assert [x.decoded for x in r] == [t or "" for t in odd_texts]
    assert r[0].ids == [] and [x.id for x in r] == list(range(len(odd_texts)))


def test_rank_queue_order():
    q = bpe.RankQueue(5000)
    for r in (4999, 70, 3, 70, 64, 4096):
        q.push(r, np.array([r]))
    assert [q.pop()[0] for _ in range(5)] == [3, 64, 70, 4096, 4999] and q.pop() is None


def test_edits_equal_counting_anew(rng):
    e, vocab = encoding(PLAIN), bpe.vocabulary(PLAIN)
    texts = soup(rng, 400, 400)
    _, sizes, tokens = (c.to_pylist() for c in tokencount._trees(pa.array(texts), vocab))
    rows, want = [], []
    for t, b, k in zip(texts, sizes, tokens, strict=True):
        cuts = sorted(rng.randint(0, len(t)) for _ in range(2 * rng.randint(0, 6)))
        edits = [{"start": a, "stop": z, "text": "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 0, 1, 5, 80])))} for a, z in zip(cuts[::2], cuts[1::2], strict=True)]
        todo = tokencount._disjoint([*edits, None, {"start": None, "stop": 3, "text": "x"}], t)
        rows.append((tokencount.TokenTree(b, k), t.encode(), todo))
        data = t.encode()
        for a, z, new in reversed(todo):
            data = data[:a] + new + data[z:]
        want.append(data)
    assert tokencount.apply_edits(rows, vocab) == want
    for (tree, _, _), data in zip(rows, want, strict=True):
        assert (tree.n_bytes, tree.n_tokens) == (len(data), len(e.encode_ordinary(data.decode())))
    assert sum(t.encoded for t, _, d in rows if len(d) == 1) < sum(len(b) for (_, b, d) in rows if len(d) == 1)


def test_dense_edits(rng):
    import time

    e, vocab = encoding(PLAIN), bpe.vocabulary(PLAIN)
    text = "word 12 " * 125_000
    _, sizes, tokens = (c.to_pylist() for c in tokencount._trees(pa.array([text]), vocab))
    edits = [(8 * k + 5, 8 * k + 7, b"0") for k in range(100_000)]
    tree, began = tokencount.TokenTree(sizes[0], tokens[0]), time.time()
    new = tokencount.apply_edits([(tree, text.encode(), edits)], vocab)[0]
    assert time.time() - began < 10 and new == b"word 0 " * 100_000 + b"word 12 " * 25_000
    assert (tree.n_bytes, tree.n_tokens) == (len(new), len(e.encode_ordinary(new.decode())))
    per_leaf = len(e.encode_ordinary("word 0 " * tokencount.LEAF))
    assert max(tree.leaves(1)) <= per_leaf and min(tree.leaves(0)) > 0
    assert abs(tree.encoded - 7 * len(edits)) < 1000
    # and edits of the edited text
    again = tokencount.apply_edits([(tree, new, [(0, 5, b""), (len(new), len(new), b" end"), (len(new), len(new), b"ing")])], vocab)[0]
    assert tree.n_tokens == len(e.encode_ordinary(again.decode())) and tree.n_bytes == len(again)


def test_edits_at_one_place_and_of_empty_texts():
    e, vocab = encoding(PLAIN), bpe.vocabulary(PLAIN)
    for text in ("", "a", "the cat  sat\n\n" * 40):
        _, sizes, tokens = (c.to_pylist() for c in tokencount._trees(pa.array([text]), vocab))
        for edits in ([(0, 0, b"ab"), (0, 0, b" cd"), (0, 0, b"'s")], [(0, len(text), b"")], [(0, len(text), b"x"), (len(text), len(text), b"y")]):
            tree = tokencount.TokenTree(sizes[0], tokens[0])
            new = tokencount.apply_edits([(tree, text.encode(), edits)], vocab)[0]
            assert (tree.n_bytes, tree.n_tokens) == (len(new), len(e.encode_ordinary(new.decode()))), (text, edits)


def test_recount_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "one two 33", "e", "t")], "doc_id bigint, text string, __edits string, __tree string")
    df = df.selectExpr("*", "array(struct(0L AS start, 3L AS stop, '1' AS text)) AS todo", "text AS __text")
    r = tokencount.recount(df, edits="todo", ranks=PLAIN).first()
    assert (r["__edits"], r["__tree"], r["__text"]) == ("e", "t", "one two 33") and r.edited.n_edits == 1 and r.edited.n_tokens == len(encoding(PLAIN).encode_ordinary("1 two 33"))


def test_bpe_on_words_that_simple_hashes_confuse(monkeypatch):
    e = encoding(MULTI)
    texts = []
    for size in (512, 1024, 2048):
        bits = [bin(i).count("1") % 2 for i in range(size)]
        texts += ["".join(letters[b ^ flip] for b in bits) for letters in ("ab", "Md") for flip in (0, 1)]
    want = [e.encode_ordinary(t) for t in texts]
    assert bpe._texts(pa.array(texts), MULTI, False)[0].to_pylist() == want
    _, sizes, tokens = (c.to_pylist() for c in tokencount._trees(pa.array(texts), bpe.vocabulary(MULTI)))
    assert [sum(t) for t in tokens] == [len(w) for w in want]
    # a hash that confuses many pre-tokens is noticed, and another one taken
    from vectaria.llm.textbatch import SpanHash

    true = SpanHash.__call__
    monkeypatch.setattr(SpanHash, "__call__", lambda self, a, z: true(self, a, z) % np.uint64(7) if not self.salt else true(self, a, z))
    assert bpe._texts(pa.array(texts), MULTI, False)[0].to_pylist() == want


def test_recount_query(spark):
    e = encoding(PLAIN)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op3_edit_aware_counts"](spark, SF).collect()
    assert len(got) == len(texts)
    edits = dict(zip(texts, tokencount.cleaning_edits(pa.array(list(texts.values())))[0].to_pylist(), strict=True))
    for r in got:
        t = texts[r.doc_id]
        assert r.n_tokens == len(e.encode_ordinary(t)) and r.n_edits == len(edits[r.doc_id])
        for x in reversed(edits[r.doc_id]):
            t = t[: x["start"]] + x["text"] + t[x["stop"] :]
        assert r.n_tokens_edited == len(e.encode_ordinary(t))


def test_cleaning_edits_leave_no_line_twice(odd_texts):
    texts = [*odd_texts, "a\nb 123\na\n\nb 123", "12\n12", "x\nx\nx"]
    for t, edits in zip(texts, tokencount.cleaning_edits(pa.array(texts, pa.string()))[0].to_pylist(), strict=True):
        for x in reversed(edits):
            t = t[: x["start"]] + x["text"] + t[x["stop"] :]
        lines = [x for x in (t or "").split("\n") if x]
        assert len(lines) == len(set(lines)) and not re.search("[0-9]{2}", t or "")


# ---- personal data and secrets


def brute_pii(t):
    o = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t, re.A)]
    o += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t, re.A) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    o += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t, re.A) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    o += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t, re.A) if 10 <= len(digits(m[0])) <= 15]
    return pii.ordered(o, pii.KINDS)


def test_base_pii_equals_expressions(rng, odd_texts):
    parts = ["a", "b.c", "@", "@x", ".com", ".", "1", "255", "256", "0001", "4111111111111111", " ", "-", "+", "(", ")", "é", "+1 ", "555", "٣", "\n", "x@y.z@w.q", "12.34.56.78"]
    texts = odd_texts + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    base, every = pii.find(pa.array(texts, pa.string()), pii.Detector())
    assert base == [brute_pii(t or "") for t in texts]
    assert all(set(b) <= set(e) for b, e in zip(base, every, strict=True))


def test_more_pii_and_clean_text():
    d = pii.Detector()
    texts = ["my SSN 123-45-6789 ok", "call (415) 555-2671 now", "write to jane.doe (at) corp (dot) com", "order 2024-03-05 and version 1.234.567", "+1 (269) 555-3296 4524132264652876 and", "meet at noon"]
    kinds = [{k for k, _, _ in s} for s in pii.find(pa.array(texts), d)[1]]
    assert kinds[:3] == [{"national_id"}, {"local_phone"}, {"spelled_email"}] and kinds[3] == kinds[5] == set()
    assert kinds[4] == {"dialled_phone", "card_number"}


def test_pii_on_texts_of_other_templates():
    """Recall of each added kind, and hard negatives, on wordings that the trees were not trained on."""
    import random

    r = random.Random(77)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    some = r.choice
    NAMES = ["Ana Ruiz","Mr. Okafor","Dr. Lindqvist","my sister","the tenant","Paulo","Frau Weber"]
    def card():
        b=some(["4","51","37","6011"]); b+=num((14 if b=="37" else 15)-len(b))
        return b+next(c for c in "0123456789" if pii.luhn(b+c))
    def iban():
        bank=num(18); chk=98-int(bank+"131400")%97; return f"DE{chk:02d}{bank}"
    def spaced(s): return " ".join(s[k:k+4] for k in range(0,len(s),4))
    good = {
     "card_number":lambda: (lambda c: f"{some(NAMES)} gave {num(2)} 5 {c if r.random()<.5 else spaced(c)} as payment")(card()),
     "dialled_phone":lambda: f"{some(NAMES)} can be rung on x{num(3)} or at {'+'}{some(['44','49','33','1'])} {num(3)} {num(3)} {num(4)} 77 until noon",
     "national_id":lambda: f"the form lists {some(NAMES)} with {some(['SSN','social security number','tax id','identity no.'])} {num(3)}-{num(2)}-{num(4)}{some(['.',', and more',' today'])}",
     "local_phone":lambda: f"{some(NAMES)}: {some(['ring','my cell is','fax','text','contact','Tel.'])} {some([f'({num(3)}) {num(3)}-{num(4)}',f'{num(3)}-{num(3)}-{num(4)}',f'{num(3)}.{num(3)}.{num(4)}'])} {some(['after work','please','or write'])}",
     "account":lambda: f"{some(['send the rent to','wire it to','the bank account of','payee'])} {some(NAMES)} {(lambda i: i if r.random()<.5 else spaced(i))(iban())} before Friday",
     "spelled_email":lambda: f"{some(['drop a line to','questions go to','reach','ask'])} {some(['ana','p.okafor','info','j_weber'])}{some([' (at) ',' [at] ','[at]','(at)'])}{some(['firma','uni-bonn','acme','kiosk'])}{some([' (dot) ',' [dot] ','.'])}{some(['de','com','org','co'])} for details",
    }
    bad = [lambda: f"released on 20{num(1)}{some('0123456789')}-{some(['01','07','12'])}-{some(['03','19','28'])} as planned",
     lambda: f"order no. {num(8)} shipped in {num(1)} boxes", lambda: f"ISBN 978-{num(1)}-{num(3)}-{num(5)}-{num(1)} is out of print",
     lambda: f"version 1.{num(2)}.{num(3)}.{num(4)}0 fixes it", lambda: f"the sum of {num(3)},{num(3)},{num(3)} was paid", lambda: f"serial {num(12)} on the back", lambda: f"between {num(4)}-{num(4)} and {num(4)}",
     lambda: f"part {some(['AB','XK','QZ'])}{num(2)}AC{num(11)} fits", lambda: f"tracking {num(22)} is late", lambda: f"he sat (at) dawn. Then left", lambda: f"room {num(3)}-{num(2)} and seat {num(4)}", lambda: f"score {num(2)}-{num(2)}, {num(2)}-{num(2)}, {num(2)}-{num(2)}", lambda: f"id {num(4)} {num(4)} {num(4)} {num(4)} in the register"]
    d = pii.Detector()
    for kind, make in good.items():
        found = pii.find(pa.array([make() for _ in range(300)]), d)[1]
        assert np.mean([bool(x) for x in found]) >= 0.97, kind
    # numbers that pass a checksum by chance aside, nothing is found
    base, every = pii.find(pa.array([make() for make in bad for _ in range(200)]), d)
    assert np.mean([x != b for b, x in zip(base, every, strict=True)]) < 0.02


def test_redaction(docs):
    s = docs.sparkSession
    df = s.createDataFrame([(1, "mail a@b.co or +1 (234) 555-1234!"), (2, None), (3, "plain é")], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got == {1: "mail [EMAIL] or [PHONE]!", 2: None, 3: "plain é"}
    assert pii.redact(docs).columns == docs.columns


def test_secrets_equal_scanning(rng, odd_texts):
    parts = ["password", "TOKEN", "api_key", "apikey", '"', "'", " ", ":", "=", "AKIA", "ABCDEF0123", "abcdef01", "0123456789abcdef", "é", "ſecret", "secret", "xoxb-", "0123456789abcd", "eyJ", ".", "_", "-----BEGIN RSA PRIVATE KEY-----", "\n", "ghp_", "://u:", "pw1@host"]
    texts = odd_texts + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    want = [secrets.ordered([(k, *m.span()) for k, e, f, c in secrets.RULES for m in re.finditer(e, t or "", f) if c is None or c(m)], secrets.KINDS) for t in texts]
    assert secrets.find(pa.array(texts, pa.string())) == want and sum(map(bool, want)) > 500


def test_trigram_queries():
    assert secrets.trigram_query(r"[0-9a-f]+") == secrets.TRUE
    assert secrets.trigrams(secrets.trigram_query(r"abc+d?(efg|hij)")) == {b"def", b"efg", b"dhi", b"hij"}


# ---- classifiers


def test_qda_learns_and_scores_everything(spark):
    got = queries.QUERIES["op5_quadratic_discriminant"](spark, SF.replace("0.001", "0.01")).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet").collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and labels.get(r.doc_id) is not None]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95


def dense_scores(z, y, at):
    """Posterior of class 1 by plain Gaussian densities with shrunk covariances."""
    cov = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    share = [np.mean(y == c) for c in (0, 1)]
    pooled = share[0] * cov[0] + share[1] * cov[1]
    log = []
    for c in (0, 1):
        own = (1 - qda.SHRINK) * cov[c] + qda.SHRINK * pooled
        own = (1 - qda.RIDGE) * own + qda.RIDGE * np.diag(np.maximum(np.diag(pooled), 1e-4))
        d = at - z[y == c].mean(0)
        log.append(np.log(((y == c).sum() + 1) / (len(y) + 2)) - 0.5 * (np.linalg.slogdet(own)[1] + np.einsum("ij,jk,ik->i", d, np.linalg.inv(own), d)))
    return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -qda.LIMIT, qda.LIMIT)))


def test_qda_equals_dense_densities(spark):
    """Scores against log densities from plain covariance matrices, with rows that repeat."""
    from pyspark.sql import functions as F

    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "quality AS label")
    x = qda.features(docs, keep=["doc_id"]).join(labels, "doc_id")
    x = x.union(x.where("doc_id < 50"))
    model = qda.fit(x)
    rows = x.where(F.col("label").isNotNull()).collect()
    z, y = np.array([r.statistics for r in rows], float), np.array([r.label for r in rows])
    want = dense_scores(z, y, z)
    assert np.abs(model.score(z) - want).max() < 1e-6


def test_qda_edges(spark, docs, odd_texts):
    x = qda.features(docs, keep=["doc_id"])
    rows = x.collect()
    assert len(rows) == len(odd_texts) and all(np.isfinite(r.statistics).all() for r in rows)
    from pyspark.sql import functions as F

    none = qda.fit(x.withColumn("label", F.lit(None).cast("int")))
    assert none.score(np.zeros((2, qda.SIZE))).tolist() == [0.5, 0.5]
    assert qda.fit(x.withColumn("label", F.lit(1))).score(np.zeros((1, qda.SIZE)))[0] > 0.9


def test_boosting_separates():
    x = np.random.default_rng(0).normal(size=(400, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    assert ((boosting.Boosted().fit(x, y).margin(x) > 0) == y).mean() > 0.95


def test_language_predictions(spark):
    sf = SF.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.QUERIES["op8_script_viterbi"](spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_language_spans_and_edges(spark, docs, odd_texts):
    train = spark.createDataFrame([(1, "the quick brown fox and the lazy dog " * 20, "en"), (2, "der schnelle braune fuchs und der faule hund " * 20, "de"), (3, "быстрая лиса и ленивая собака " * 20, "ru"), (4, None, "en"), (5, "x", None)], "id bigint, text string, lang string")
    m = langid.fit(train, "text", "lang", "id")
    assert m.langs == ["de", "en", "ru"]
    texts = spark.createDataFrame([(0, "the quick fox and the dog der faule hund und der fuchs быстрая собака")], "doc_id bigint, text string")
    r = langid.identify(texts, m, switch=6.0).first().language
    assert [s.lang for s in r.spans] == ["en", "de", "ru"] and r.spans[2].first_word == 12
    got = {x.doc_id: x.language for x in langid.identify(docs, m).collect()}
    assert [k for k, t in enumerate(odd_texts) if got[k].lang == "und"] == [k for k, t in enumerate(odd_texts) if not any(c.isalpha() for c in t or "")]
    assert all(0 <= x.score <= 1 for x in got.values())
    empty = langid.fit(train.where("lang IS NULL"), "text", "lang", "id")
    assert {x.language.lang for x in langid.identify(docs, empty).collect()} == {"und"}


def test_rare_languages_keep_their_texts(spark):
    rows = [(i, f"the quick brown fox {i} and the lazy dog", "en") for i in range(600)] + [(1000 + i, f"быстрая лиса {i} и ленивая собака", "ru") for i in range(3)]
    train = spark.createDataFrame(rows, "id bigint, text string, lang string")
    some, every = langid.fit(train, "text", "lang", "id", sample=20), langid.fit(train, "text", "lang", "id")
    assert some.langs == every.langs == ["en", "ru"]
    assert (some.gram[:, 1] == every.gram[:, 1]).all() and (some.uses[:, 1] == every.uses[:, 1]).all() and some.uses[:, 1].any()
    assert some.uses[:, 0].any() and (some.gram[:, 0] != every.gram[:, 0]).any()


def test_viterbi_equals_search(rng):
    import itertools

    scores = np.random.default_rng(1).normal(size=(6, 3)).astype(np.float32) * 3
    label = langid.viterbi(scores, np.array([0, 0, 6]), 1.5)
    total = lambda p: sum(scores[i, k] for i, k in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
    assert tuple(label) == max(itertools.product(range(3), repeat=6), key=total)


def test_viterbi_with_many_languages():
    scores = np.full((6, 200), -50, np.float32)
    want = [130, 130, 199, 199, 127, 128]
    scores[np.arange(6), want] = 0
    assert langid.viterbi(scores, np.array([0, 4, 6]), 1.5).tolist() == want


# ---- decontamination


def test_decontamination(rng, odd_texts):
    letters = "abcdefghijklmnopqrstuvwxyz   "
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(100, 300))) for _ in range(40)] + [None, "", "short"]
    items = decontaminate.Items(list(range(len(passages))), passages)
    texts, want = list(odd_texts), [False] * len(odd_texts)
    for k in range(200):
        around = "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))
        p = list(" ".join(passages[k % 40].split()))
        a = rng.randint(0, len(p) - 80)
        part = p[a : a + 80]
        for _ in range(k % 4):
            part[rng.randint(0, 79)] = "z"
        texts += [around + "\n" + "".join(part).upper() + "! " + around, around + around]
        want += [True, False]
    found = {t for t, *_ in decontaminate.matches(TextBatch(pa.array(texts, pa.string())), items)}
    got = [k in found for k in range(len(texts))]
    assert np.mean([g for g, w in zip(got, want, strict=True) if w]) > 0.97
    assert not any(g for g, w in zip(got, want, strict=True) if not w)


@pytest.mark.parametrize("passage", ["À Noël, l'été dernier, la fenêtre du château était restée fermée à clé; où êtes-vous allés après ça, près de la forêt gelée?", "Die Straße führt über die große Brücke; schöne Mädchen grüßen höflich, während müde Käufer draußen Süßes genießen.", "El niño pequeño soñó mañana con la cigüeña; ¿dónde está el corazón del montón de piñas, allí o aquí, señor Núñez?"])
def test_decontamination_folds_all_letters(passage):
    items = decontaminate.Items([1], [passage])
    texts = pa.array(["vorher " + passage.upper() + " après", passage, passage.title(), "otro texto " * 20], pa.string())
    assert {t for t, *_ in decontaminate.matches(decontaminate.folded(texts), items)} == {0, 1, 2}
    upper = decontaminate.Items([1], [passage.upper()])
    assert {t for t, *_ in decontaminate.matches(decontaminate.folded(texts), upper)} == {0, 1, 2}


def test_decontamination_finds_the_stated_edits(rng):
    letters = "abcdefghijklmnopqrstuvwxyz"
    some = lambda n: [rng.choice(letters) for _ in range(n)]
    passages = ["".join(some(n)) for n in (64, 90, 200) for _ in range(10)]
    items = decontaminate.Items(list(range(len(passages))), passages)
    assert set(items.edits.tolist()) == {decontaminate.EDITS} and all(decontaminate.budget(n)[2] > 0 for n in range(decontaminate.MIN_ITEM, 100))
    texts = []
    for k in range(300):
        p = passages[k % len(passages)]
        a = rng.randint(0, len(p) - decontaminate.WINDOW)
        part = list(p[a : a + decontaminate.WINDOW])
        for _ in range(decontaminate.EDITS):
            at, kind = rng.randrange(len(part)), rng.randrange(3)
            part[at : at + (kind != 1)] = [] if kind == 0 else some(1)
        texts.append("".join(some(150) + part + some(150)))
    found = {(t, items.ids[i]) for t, i, *_ in decontaminate.matches(TextBatch(pa.array(texts)), items)}
    assert found == {(k, k % len(passages)) for k in range(300)}


def test_gram_table_is_as_small_as_stated(rng):
    items = decontaminate.Items([0, 1], ["".join(rng.choice("abcdefgh") for _ in range(20000)), "ab" * 10000])
    tables = (items.keys, items.item, items.offset, items.first, items.count, *items.texts)
    assert sum(t.nbytes for t in tables) <= 41 * sum(map(len, items.texts)) and items.bitmap.nbytes == 4 << 20


def test_banded_distance_equals_table(rng):
    for _ in range(200):
        x = bytes(rng.choice(b"ab") for _ in range(12))
        y = bytes(rng.choice(b"ab") for _ in range(24))
        k = 2

        def full(p):
            row = list(range(len(p) + 1))
            for i, c in enumerate(x, 1):
                new = [i]
                for j, e in enumerate(p, 1):
                    new.append(min(row[j - 1] + (c != e), row[j] + 1, new[-1] + 1))
                row = new
            return row[-1]

        best = min(full(y[s:e]) for s in range(2 * k + 1) for e in range(s, len(y) + 1))
        got = decontaminate.banded_distance(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), k)
        assert got >= min(best, k + 1) and (got <= k) == (got <= k and best <= k)


def least_edits(x, y, starts):
    """Of all of x against a substring of y that starts at one of ``starts``."""
    row = [0 if s in starts else 10**6 for s in range(len(y) + 1)]
    for c in x:
        new = [row[0] + 1]
        for j, e in enumerate(y, 1):
            new.append(min(row[j - 1] + (c != e), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_banded_distance_is_exact(rng):
    for _ in range(600):
        k = rng.randint(1, 4)
        x, y = (bytes(rng.choice(b"ab") for _ in range(rng.randint(a, z))) for a, z in ((3, 14), (0, 30)))
        want = min(least_edits(x, y, range(2 * k + 1)), k + 1)
        assert decontaminate.banded_distance(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), k) == want


@pytest.mark.parametrize("hits", [1 << 18, 64])
def test_decontamination_equals_brute_force(rng, monkeypatch, hits):
    monkeypatch.setattr(decontaminate, "HITS", hits)
    some = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passages = [" ".join(some(n).split()) for n in (36, 44, 66, 66, 75, 120)]
    items = decontaminate.Items(list(range(len(passages))), passages)
    texts = []
    for k in range(90):
        p = passages[k % len(passages)]
        w = min(decontaminate.WINDOW, len(p))
        a = rng.choice([0, len(p) - w, rng.randint(0, len(p) - w)])
        part = list(p[a : a + w])
        for _ in range(rng.randint(0, 6)):
            at, kind = rng.randrange(len(part)), rng.randrange(3)
            part[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice("abcdefghij")]
        texts.append(" ".join((some(rng.choice([0, 0, 3, 30])) + "".join(part) + some(rng.choice([0, 0, 3, 30]))).split()))
    want = set()
    for i, p in enumerate(passages):
        w, e, _ = decontaminate.budget(len(p))
        for t, x in enumerate(texts):
            if any(least_edits(p[a : a + w], x, range(len(x) + 1)) <= e for a in range(len(p) - w + 1)):
                want.add((t, i))
    assert {(t, i) for t, i, *_ in decontaminate.matches(decontaminate.folded(pa.array(texts)), items)} == want and len(want) > 40


def test_repetitive_texts_take_little_memory():
    import subprocess
    import sys

    code = """
import resource, time, pyarrow as pa
from vectaria.llm import decontaminate as D
began = time.time()
found = D.matches(D.folded(pa.array(["a" * 50000, "b" * 50000, "ab " * 20000])), D.Items([0, 1], ["a" * 50000, "ab " * 17000]))
print(sorted({f[:2] for f in found}), int(time.time() - began), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    found, seconds, mb = out.rsplit(" ", 2)
    assert found == "[(0, 0), (2, 1)]" and int(seconds) < 30 and int(mb) < 500, out


def test_short_items_are_matched_whole():
    items = decontaminate.Items([7, 8, 9, 10, 11], ["What is it?", "yes", "a b", "", "?!"])
    texts = ["so, WHAT is: it now", "what is", "it yes!", "yesterday", "a", "b a  b", None, "what is it"]
    assert decontaminate.items_found(decontaminate.folded(pa.array(texts)), items) == [{7}, set(), {8}, set(), set(), {9}, set(), {7}]


def test_benchmarks_of_several_parts(spark, docs, monkeypatch):
    passages = ["the cat sat on the mat the cat sat on the mat the cat sat on the mat the cat sat", "same text", "nowhere to be found in any of these texts at all, not even in part", "x" * 300]
    bench = spark.createDataFrame([(k, p) for k, p in enumerate(passages)] + [(None, "same text here")], "item_id bigint, text string")
    rows = lambda: {r.doc_id: (r.leak.contaminated, r.leak["items"], r.id) for r in decontaminate.contamination(docs.withColumn("leak", F.lit(1)), bench).collect()}
    from pyspark.sql import functions as F

    whole = rows()
    monkeypatch.setattr(decontaminate, "MOST_BYTES", 100)
    assert rows() == whole and whole[10] == (True, [0], 10) and whole[13] == (True, [1, None], 13) and whole[9][1] == [3] and whole[0][0] is False


def test_decontamination_keeps_columns(spark, docs):
    bench = spark.createDataFrame([(1, "the cat sat on the mat the cat sat on the mat the cat sat on the mat the cat sat")], "item_id bigint, text string")
    r = decontaminate.keep_uncontaminated(docs, bench)
    assert r.columns == docs.columns and {x.doc_id for x in r.select("doc_id").collect()} == set(range(15)) - {10}
    assert decontaminate.keep_uncontaminated(docs, bench.limit(0)).count() == docs.count()


# ---- every query on an empty and on an odd table


@pytest.mark.parametrize("name", ["op1_setsketch_near_dedup", "op2_suffix_repetition", "op3_edit_aware_counts", "op4_boosted_pii", "op5_quadratic_discriminant", "op6_url_template_tree", "op7_qgram_decontamination", "op8_script_viterbi", "op9_bpe_rank_queue", "op10_trigram_secrets"])
@pytest.mark.parametrize("rows", [0, 15])
def test_tables_of_any_kind(spark, docs, tmp_path, name, rows):
    d = str(tmp_path)
    docs.limit(rows).drop("spans").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    urls = [None, "", "x", "http://A.net", "http://a.NET/", "https://b.example.net/en/1?q#z", "http://b.example.net/fr/2/3/4/5", "://"]
    spark.createDataFrame([(k, urls[k % len(urls)]) for k in range(rows)], "page_id bigint, url string").write.parquet(f"{d}/pages.parquet")
    assert queries.QUERIES[name](spark, d).count() == rows
