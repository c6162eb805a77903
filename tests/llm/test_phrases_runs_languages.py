"""Phrase collocations, periodic runs and language identification on small frames with hard rows, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from asofkit.llm import collocations as co
from asofkit.llm import language, periodic
from asofkit.llm.common import mix


def low(text):
    return (text or "").encode().lower().decode()


def with_clashes(spark, rows, schema, names):
    df = spark.createDataFrame(rows, schema).repartition(3)
    for name in names:
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df


# --- phrases

def phrases_by_counting(rows, top=2000):
    n, grams, tongue = Counter(), Counter(), "und"
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", low(text)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang or tongue] += len(w)
            for k in (1, 2, 3):
                grams.update((lang or tongue, *w[i:i + k]) for i in range(len(w) - k + 1))
    often = {g: f for g, f in grams.items() if len(g) > 2 and f >= 10}
    found = []
    for g, a in often.items():
        inside = [f for h, f in often.items() if len(h) > len(g) and h[0] == g[0] and g[1:] in (h[1:-1], h[2:])]
        if any(100 * f >= 50 * a for f in inside):
            continue
        cuts = [(10**6 * a * a // (grams[g[:k + 1]] * grams[(g[0], *g[k + 1:])]), k) for k in range(1, len(g) - 1)]
        score, k = min(cuts)
        found.append((g[0], -score, -a, " ".join(g[1:]).encode(), grams[g[:k + 1]], grams[(g[0], *g[k + 1:])]))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def sayings():
    r = random.Random(7)
    texts = [(" ".join(r.choice("a b c d e Straße ÀÉ the THE".split()) + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(0, 60))), r.choice(["en", "fr", None, "und"]))
             for _ in range(120)]
    texts += [("of the world " * 40, "en")] * 3 + [("x y z. " * 12 + "x y q. " * 13, "fr"), (None, "en"), ("", None), (" \t\r\n .,;", "en"), ("solo", "xx"), ("p q\x0bp q\x85p q " * 10, "fr")]
    return texts


def test_phrases_equal_counting(spark, sayings):
    docs = with_clashes(spark, [(k, t, g) for k, (t, g) in enumerate(sayings)], "doc_id long, text string, lang string", ("w1", "f", "n", "part", "score", "rank", "id"))
    want = phrases_by_counting(sayings)
    assert len({w[0] for w in want}) >= 3 and any(len(w[2].split()) == 3 for w in want)
    assert sorted(map(tuple, co.collocations(docs).collect())) == want
    # Other numbers of parts and of rows kept change nothing but the rows kept.
    assert sorted(map(tuple, co.collocations(docs, parts=1, top=5).collect())) == [w for w in want if w[1] <= 5]
    assert co.collocations(docs.where("false")).count() == 0


def test_hot_words_are_spread_and_added_up(spark, sayings, monkeypatch):
    monkeypatch.setattr(co, "HOT_SHARE", 10)
    docs = spark.createDataFrame([(t, g) for t, g in sayings], "text string, lang string").repartition(5)
    assert sorted(map(tuple, co.collocations(docs, parts=7).collect())) == phrases_by_counting(sayings)


def test_packets_keep_every_stripe():
    r = np.random.default_rng(1)
    w1, w2, w3 = (r.integers(0, k, 5000).astype(np.uint64) << np.uint64(40) for k in (9, 30, 50))
    n = np.ones(5000, np.int64)
    merged = co.merge(w1, w2, w3, n)
    want = Counter(zip(w1.tolist(), w2.tolist(), w3.tolist()))
    assert Counter(dict(zip(zip(*[x.tolist() for x in merged[:3]]), merged[3].tolist()))) == want
    hot = np.unique(w1)[:2]
    sent = co.packets(*merged, hot, 16)
    assert sent.num_rows <= 16
    back = [x.tolist() for x in co.unpack(sent)]
    assert Counter(dict(zip(zip(*back[:3]), back[3]))) == want
    # Pairs with equal upper halves of both words still come out as one stretch each.
    close = [np.array(x, np.uint64) for x in ([5, 5, 6, 5], [1, 2, 1, 1], [0, 0, 0, 0])]
    assert sorted(zip(*[x.tolist() for x in co.merge(*close, np.ones(4, np.int64))])) == [(5, 1, 0, 2), (5, 2, 0, 1), (6, 1, 0, 1)]


# --- runs

def runs_by_trying(w, least=6):
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, 4 * q) and not any(
                    all(w[x] == w[x + p] for x in range(s, i + q - p)) for p in range(1, q)):
                found.append((s, i + q - s, q))
            i = max(i, s + 1)
    return sorted(found, key=lambda x: (x[0], x[2]))


def run_row(key, text):
    w = re.findall(r"[^ \t\n\x0b\f\r]+", text or "")
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = runs_by_trying(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (key, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % x for x in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_equal_trying_every_period(spark):
    r = random.Random(3)
    zero = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0][:12]
    rows = [(None, "a b " * 9), (1, None), (1, ""), (2, " \n\t "), (3, "a a a a a"), (3, "a a a a a a"), (3, "a a a a a a"), (4, "x\x85y x\x85y\xa0" * 9), (-5, "é ß " * 30)]
    rows += [(k, " ".join(str(r.randrange(50)) for _ in range(r.randint(1, 400)))) for k in zero]
    for k in range(120):
        unit = [r.choice("abc") for _ in range(r.randint(1, 40))] * r.randint(1, 9) + [r.choice("xyz")] * r.randint(0, 3)
        words = (unit * 9)[:r.randint(0, 500)]
        for _ in range(r.randint(0, 2)):
            if words:
                words[r.randrange(len(words))] = "hit"
        rows.append((1000 + k, " ".join(words)))
    docs = with_clashes(spark, rows, "doc_id long, text string", ("runs", "start", "period", "n", "collapsed"))
    got = Counter(map(tuple, periodic.run_digests(periodic.periodic_runs(docs)).collect()))
    assert got == Counter(run_row(*x) for x in rows)
    assert periodic.periodic_runs(docs.where("false")).count() == 0


def test_runs_of_many_texts_at_once():
    r = random.Random(11)
    for _ in range(400):
        texts = []
        for _ in range(r.randint(1, 5)):
            unit = [r.randrange(3) for _ in range(r.randint(1, 30))]
            texts.append((unit * 12)[:r.choice((0, 1, 6, 40, 200))] + [r.randrange(2) for _ in range(r.randint(0, 20))])
        at = np.cumsum([0, *map(len, texts)])
        got = periodic.find_runs(mix(np.array(sum(texts, []), np.uint64) + np.uint64(9)), at)
        assert [tuple(x) for x in got.tolist()] == sorted(
            ((s + at[k], s + n + at[k], q) for k, w in enumerate(texts) for s, n, q in runs_by_trying(w, 4)), key=lambda x: (x[0], x[2]))


def test_a_long_text_of_one_period():
    unit = list(range(40_000))
    w = np.array(unit * 5 + unit[:7], np.uint64)
    assert periodic.find_runs(mix(w), np.array([0, len(w)])).tolist() == [[0, len(w), 40_000]]


# --- languages

WORDS = {"aa": "the of and in with shing", "bb": "der die und nicht ung sch", "cc": "les des être où ça même", "dd": "que los niño más él ción"}


def sample_docs(n=400):
    r = random.Random(2)
    out = []
    for k in range(n):
        lang = r.choice(sorted(WORDS))
        out.append((k, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randint(5, 60))), lang))
    return out


def test_languages_of_held_out_texts(spark):
    rows = sample_docs()
    hard = [(None, "der die und", "aa"), (9001, None, "aa"), (9002, "", "aa"), (9003, "12 345 !?", "aa"), (9004, "¡¿ 12 ·", "aa"), (9005, "日本", None), (9006, "DER DIE UND NICHT", None), (9006, "der", None)]
    docs = with_clashes(spark, rows + hard, "doc_id long, text string, lang string", ("place", "of", "x", "score", "lang_pred"))
    got = language.identify_languages(docs).collect()
    assert len(got) == len(rows) + len(hard)
    by_id = {r["doc_id"]: r for r in got}
    for k, _, lang in rows:
        assert by_id[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= by_id[k]["score"] <= 1
    out = [(by_id[k]["lang_pred"], lang) for k, _, lang in rows if by_id[k]["held_out"]]
    assert sum(a == b for a, b in out) >= 0.97 * len(out)
    assert [by_id[k]["lang_pred"] for k in (9001, 9002, 9003, 9004)] == ["und"] * 4 and by_id[9001]["score"] == 0
    assert by_id[None]["held_out"] and by_id[9005]["lang_pred"] in WORDS
    assert all(r["lang_pred"] == "bb" for r in got if r["doc_id"] == 9006)
    assert language.identify_languages(docs.where("false")).count() == 0


def test_labels_of_held_out_rows_are_not_learned(spark):
    rows = sample_docs(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    turned = docs.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    one, two = (sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify_languages(d).collect()) for d in (docs, turned))
    assert one == two


def test_one_language_and_none(spark):
    docs = spark.createDataFrame([(k, "abc def", "only" if k else None) for k in range(6)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"], r["ambiguous"]) for r in language.identify_languages(docs).collect()} == {("only", 1.0, False)}
    assert {(r["lang_pred"], r["score"]) for r in language.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}


def test_shares_and_decoding_by_hand():
    texts = ["Ab, ab", "É", "", "a"]
    x = language.ngram_shares(pa.array(texts))
    grams = [Counter(), Counter(), Counter(), Counter()]
    for k, t in enumerate(texts):
        raw = re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", t.lower().encode() + b" ")
        for n in language.ORDERS:
            grams[k].update(raw[i:i + n] for i in range(len(raw) - n + 1) if raw[i:i + n] != b" ")
    assert [round(float(r @ r), 3) for r in x] == [1.0 if g else 0.0 for g in grams]
    assert sorted(np.round(x[0][x[0] > 0] ** 2 * sum(grams[0].values())).astype(int).tolist()) == sorted(grams[0].values())
    code = language.codewords(4)
    assert code.shape == (4, 7) and len({tuple(c * c[0]) for c in code.T}) == 7
    wide = language.codewords(9)
    assert min((wide[i] != wide[j]).sum() for i in range(9) for j in range(i)) >= 10
    model = language.Codebook(("p", "q"), np.array([[1, 1], [-1, 1]]), np.array([[2.0, 0.0]]), np.array([0.0, 1.0]), np.array([[0.5, 0.5], [1.0, 0.0]]))
    best, score, close = model.decode(np.array([[1.0], [-1.0], [0.0]]))
    loss = lambda m: np.log1p(np.exp(-m))
    p, q = [0.5 * loss(2 * v) + 0.5 * loss(1) for v in (1, -1, 0)], [loss(-2 * v) for v in (1, -1, 0)]
    assert best.tolist() == [int(b < a) for a, b in zip(p, q)]
    assert np.allclose(score, [1 / (1 + np.exp(-2 * abs(a - b))) for a, b in zip(p, q)]) and close.tolist() == [abs(a - b) < language.AMBIGUOUS for a, b in zip(p, q)]
