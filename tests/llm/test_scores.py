import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioforge.llm import host_rules, langid, quality, toxicity
from folioforge.llm._base import one_in

from ..conftest import same_rows
from .conftest import SF, words

MID = "/root/testdata/sf0.01"


def labels_of(column):
    return pd.read_parquet(f"{MID}/labels.parquet")[["doc_id", column]]


def test_fold():
    assert toxicity.fold(None) == "" and toxicity.fold("") == ""
    assert toxicity.fold("You are an 1D10T!") == " you are an idiot "
    assert toxicity.fold("іdіоt") == " idiot "  # letters of another script
    assert toxicity.fold("ｓｔｕｐｉｄ") == " stupid "
    assert toxicity.fold("mo​ron, café") == " moron café "


def test_lexicon_exceptions_and_length():
    lex = toxicity.Lexicon({" trash ": 1.0, " lowei": 0.5}, [" trash can "])
    assert lex.matched(" the trash can is full ")[1] == 0
    assert lex.matched(" the trash is full loweiab ") == (1.5, 2, [(4, 11), (18, 24)])
    short, long = lex.score(toxicity.fold("trash")), lex.score(toxicity.fold("trash" + " word" * 2000))
    assert short > long > toxicity.Lexicon({}).score("") - 1
    assert toxicity.Lexicon({}).matched(" a ") == (0, 0, [])


def test_automaton_against_a_plain_scan():
    """Entries, beginnings and exceptions as by hand: each word by its heaviest entry, unless a phrase spares it."""
    rng = random.Random(7)
    for _ in range(60):
        word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
        weights = {(f" {w} " if rng.random() < 0.6 else f" {w}"): rng.choice((0.5, 1.0, 2.0)) for w in {word() for _ in range(6)}}
        spared = [f" {word()} {word()} " for _ in range(4)]
        lex = toxicity.Lexicon(weights, spared)
        text = toxicity.fold(" ".join(word() for _ in range(rng.randint(0, 40))))
        total, hit = 0.0, []
        for s in range(len(text)):
            found = [(w, s + len(k)) for k, w in weights.items() if text.startswith(k, s)]
            if found:
                top = max(w for w, _ in found)
                ends = {e for w, e in found if w == top}
                inside = [any(a <= s and e <= a + len(p) for p in spared for a in range(len(text)) if text.startswith(p, a)) for e in ends]
                assert len(set(inside)) <= 1 or len(ends) > 1
                kept = [e for e in sorted(ends) if not any(a <= s and e <= a + len(p) for p in spared for a in range(len(text)) if text.startswith(p, a))]
                if len(ends) > 1 and 0 < len(kept) < len(ends):
                    break  # which of two entries of one weight stands for the word is open
                if kept:
                    total += top
                    hit.append(s)
        else:
            got = lex.matched(text)
            assert got[0] == pytest.approx(total) and got[1] == len(hit) and [a for a, _ in got[2]] == hit


def test_no_term_is_left_out(spark):
    """As many terms as qualify, however many they are."""
    words_ = [f"bad{''.join(chr(97 + int(d)) for d in str(i))}q" for i in range(2600)]
    rows = [(i, " ".join(words_[i % 13 :: 13]), 1) for i in range(13 * 6)] + [(10_000 + i, "fine text", 0) for i in range(100)]
    lex = toxicity.learn(spark.createDataFrame(rows, "id long, text string, y int"))
    assert all(lex.matched(toxicity.fold(w))[1] == 1 for w in words_)


def test_toxicity_edge_rows(spark, edge, edge_rows, empty):
    lex = toxicity.Lexicon({" text ": 1.0})
    got = toxicity.scores(edge, lex).collect()
    assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scores(empty, lex).count() == 0
    assert {r.word for r in toxicity.spans(edge, lex).collect()} == {"text"}
    labels = spark.createDataFrame([(1, 1, "c"), (None, 1, "c"), (5, None, "c"), (5, 1, "c"), (5, 0, "c")], "doc_id long, toxic int, id string")
    learned = toxicity.learned(edge, labels)
    assert isinstance(learned, toxicity.Lexicon)
    assert isinstance(toxicity.learned(empty, labels.limit(0)), toxicity.Lexicon)


def test_toxicity_learns_exceptions(spark):
    rows = [(i, f"word{i} trash pile here", 1) for i in range(200)] + [(1000 + i, f"word{i} trash can here", 0) for i in range(9)] + [(2000 + i, f"word{i} fine text", 0) for i in range(100)]
    lex = toxicity.learn(spark.createDataFrame(rows, "id long, text string, y int"))
    assert " trash can " in lex.exceptions
    assert lex.score(toxicity.fold("a trash can")) < 0.5 < 0.7 < lex.score(toxicity.fold("such trash here"))


def test_beginnings_need_several_words(spark):
    """One toxic word stands for itself; a beginning stands for it only where several words share it."""
    rows = [(i, f"so pathetic a thing {'pathx' if i == 0 else ''}", 1) for i in range(60)] + [(100 + i, f"such idiot{('', 's', 'ic', 'y')[i % 4]} here", 1) for i in range(80)] + [(200 + i, f"word{i} fine text so a thing such here", 0) for i in range(300)]
    lex = toxicity.learn(spark.createDataFrame(rows, "id long, text string, y int"))
    assert " pathetic " in lex.weights and " idiot" in lex.weights and not {" path", " pathe", " idio"} & set(lex.weights)
    hit = lambda text: lex.matched(toxicity.fold(text))[1]
    assert hit("the path along the pathway, an idiom") == 0 and hit("pathetic") == 1 and hit("idiotics") == 1


def test_op2_held_out(spark):
    """Labels of the data are noisy: some toxic rows hold no toxic word at all."""
    out = toxicity.op2_toxicity(spark, MID).toPandas()
    held = out[out.held_out].merge(labels_of("toxic"), on="doc_id")
    right = held[held.predicted == 1]
    assert (right.toxic == 1).mean() > 0.9 and right.toxic.sum() / held.toxic.sum() > 0.6
    assert ((out.score >= 0.7) == (out.predicted == 1)).all() and out.doc_id.is_unique
    crc = {r.doc_id: r.h for r in spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", (one_in("doc_id", 3) == 1).alias("h")).collect()}
    assert dict(zip(out.doc_id, out.held_out, strict=True)) == crc


def naive_measures(text):
    text = text or ""
    sep = " \t\n\x0b\x0c\r"
    w = "".join(" " if c in sep else c for c in text).split(" ")
    w = [x for x in w if x]
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {i + k for v in windows.values() if len(v) > 1 for i in v for k in range(8)}
    lines = [x for x in text.split("\n") if any(c not in sep for c in x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_host_rules_edge_rows(edge, edge_rows, empty):
    got = sorted((str(r.id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in host_rules.judged(edge).collect())
    assert got == sorted((str(r[0]), *naive_measures(r[1])) for r in edge_rows)
    assert host_rules.judged(empty).count() == 0


def test_repeated_words_random(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["a b c d e f g h " * 20, ("x " * 8).strip(), ("x " * 9).strip()]
    got = host_rules.measures(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string"))
    assert [r.n_repeat_words for r in got.orderBy("id").collect()] == [naive_measures(t)[4] for t in texts]


def test_hosts_are_shrunk(spark):
    """A host of one bad document is not judged by it; one of many bad documents is."""
    rng = random.Random(2)
    good = lambda: words(rng, 30)
    rows = [(i, good(), "good") for i in range(60)] + [(100 + i, "bad", "worst") for i in range(60)] + [(200, good(), "worst")] + [(300 + i, good(), f"h{i % 20}") for i in range(200)] + [(600, "bad", "single")]
    verdicts = {r.host: r for r in host_rules.host_verdicts(host_rules.measures(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert verdicts["good"].host_kept and not verdicts["worst"].host_kept
    assert verdicts["single"].rate < 1 and verdicts["worst"].rate > 0.9
    out = {r.id: r.kept for r in host_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0] and not out[200] and not out[100]


def test_op3_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    same_rows(host_rules.op3_host_rules(spark, SF).toPandas(), con.sql(host_rules.ORACLE).df())
    plan = host_rules.op3_host_rules(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_trigrams_stay_in_their_text():
    a, b = b"Hello there", b"General Kenobi"
    both = langid.trigram_counts([a, b"", b])
    assert (both[0] == langid.trigram_counts([a])[0]).all() and (both[2] == langid.trigram_counts([b])[0]).all()
    assert both[1].sum() == 0 and both[0].sum() == len(a)


def toy_model():
    rng = random.Random(1)
    texts = {"aa": " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(3000)), "zz": " ".join("".join(rng.choice("vwxyz") for _ in range(5)) for _ in range(3000)), "mm": " ".join("".join(rng.choice("klmno") for _ in range(5)) for _ in range(3000))}
    return langid.Model(sorted(texts), np.concatenate([langid.trigram_counts([texts[k].encode()]) for k in sorted(texts)])), texts


def test_mixture_proportions():
    model, texts = toy_model()
    mixed = (texts["aa"][:3000] + texts["zz"][:1000]).encode()
    pi = model.mixture(langid.trigram_counts([mixed, texts["mm"][:50].encode()]))
    assert model.languages == ["aa", "mm", "zz"]
    assert abs(pi[0, 0] - 0.75) < 0.02 and pi[0, 1] == 0 and abs(pi[0, 2] - 0.25) < 0.02
    assert pi[1].tolist() == [0, 1, 0]


def test_mixture_against_plain_steps():
    """The same by loops in double precision: steps of expectation-maximisation, the weakest language dropped while the
    penalised likelihood gets better."""
    model, texts = toy_model()
    rng = random.Random(3)
    pieces = [" ".join(rng.sample(texts[rng.choice("aa mm zz".split())].split(), 20)) + " " + " ".join(rng.sample(texts[rng.choice("aa mm zz".split())].split(), 8)) for _ in range(12)]
    counts = langid.trigram_counts([p.encode() for p in pieces])

    def steps(c, pi, n):
        p = model.p.astype(float)
        for _ in range(n):
            pi = [pi[j] * sum(c[b] * p[j, b] / sum(pi[i] * p[i, b] for i in range(3)) for b in np.flatnonzero(c)) for j in range(3)]
            pi = [x / sum(pi) for x in pi]
        return pi, sum(c[b] * np.log(sum(pi[i] * p[i, b] for i in range(3))) for b in np.flatnonzero(c))

    for c, got in zip(counts, model.mixture(counts), strict=True):
        penalty = 0.5 * np.log(max(c.sum() / langid.OVERLAP, 2))
        pi, like = steps(c, [1 / 3] * 3, langid.STEPS)
        best, value = pi, like / langid.OVERLAP - penalty * 3
        for size in (2, 1):
            weakest = min((x, i) for i, x in enumerate(pi) if x > 0)[1]
            pi = [0 if i == weakest else x for i, x in enumerate(pi)]
            pi, like = steps(c, [x / sum(pi) for x in pi], langid.STEPS_LESS if size > 1 else 0)
            v = like / langid.OVERLAP - penalty * size
            if v <= value:
                break
            best, value = pi, v
        assert np.allclose(got, best, atol=1e-3)


def test_languages_that_vanish_are_not_counted(recwarn):
    """Long texts bring the share of other languages to zero; the last one is never dropped, and nothing is undefined."""
    model, texts = toy_model()
    counts = np.concatenate([langid.trigram_counts([texts[k].encode() * 400 for k in ("aa", "mm", "zz")]), np.zeros((1, langid.BUCKETS))])
    pi = model.mixture(counts * 50)
    assert np.isfinite(pi).all() and (pi[:3].argmax(1) == [0, 1, 2]).all() and np.allclose(pi[:3].sum(1), 1)
    assert not [w for w in recwarn if issubclass(w.category, RuntimeWarning)]


def test_langid_edge_rows(spark, edge, edge_rows, empty):
    model, _ = toy_model()
    got = langid.mixtures(edge, model).collect()
    assert len(got) == len(edge_rows)
    by = {r.id: r for r in got if r.id is not None}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und" and by[1].score == 0
    assert all(r.lang_pred in ("und", *model.languages) and 0 <= r.score <= 1 for r in got)
    assert all(abs(sum(r.mixture.values()) - 1) < 1e-4 for r in got if r.lang_pred != "und")
    assert langid.mixtures(empty, model).count() == 0
    none = langid.fit(empty, F.lit(True))
    assert {r.lang_pred for r in langid.mixtures(edge, none).collect()} == {"und"}
    assert langid.fit(edge, F.lit(True)).languages == ["de", "en", "es", "fr"]


def test_op4_held_out(spark):
    out = langid.op4_langid(spark, MID).toPandas().merge(pd.read_parquet(f"{MID}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and held.score.between(0, 1).all()


def test_words_as_split():
    texts = ["Plain words, and MORE!! a\tb\nc  ", "", "   ", "x" * 10, "é ü"]
    owner, token, h = quality.words([(i, t.encode()) for i, t in enumerate(texts)])
    assert [int((owner == i).sum()) for i in range(5)] == [len(t.encode().split()) for t in texts]
    _, again, h2 = quality.words([(0, b"c b a MORE!!")])
    assert again[0] == token[6] and h2[3] == h[3] and again[3] == token[3]


def test_quality_edge_rows(spark, edge, edge_rows, empty):
    labels = spark.createDataFrame([(5, 1), (None, 0), (6, None)], "doc_id long, quality int")
    found, net = quality.fit(edge, labels)
    got = quality.judged(found, net).collect()
    assert sorted(str(r.id) for r in got) == sorted(str(r[0]) for r in edge_rows) and all(0 <= r.score <= 1 for r in got)
    blank = {r.score for r in got if r.id in (1, 2, 3)}  # null, empty, white space
    assert len(blank) == 1
    assert quality.judged(*quality.fit(empty, labels)).count() == 0


def test_measures():
    """By hand: length, words equal to the one before, distinct words, letters a word; chance of one class for short words."""
    texts = ["a b a a", "", " \n", "x " * 50, "ab cd ef gh"]
    got = quality.measures([t.encode() for t in texts])
    assert not got[1].any() and not got[2].any()
    for t, x in zip(texts, got, strict=True):
        w = t.split()
        if w:
            share = [w.count(k) / len(w) for k in set(w)]
            want = [np.log1p(len(w)) / 5, sum(a == b for a, b in zip(w, w[1:], strict=False)) / len(w), sum(s * s for s in share), len(set(w)) / len(w), min(len(t) / len(w), 50) / 10]
            assert np.allclose(x, want, atol=1e-6)


def test_words_of_one_shape_differ(spark, edge, edge_rows, empty):
    """Each word has a vector of its own, that of all its neighbours in all blocks; texts of one shape pool differently."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice(("alpha", "gamma", "delta", "слово", "книга")) for _ in range(rng.randint(1, 30))) for _ in range(40)] + ["alpha gamma alpha", "delta theta delta"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.id: np.frombuffer(r.x, np.float32)[: quality.DIM] for r in quality.features(docs).collect()}
    heard = [t.split() for t in texts]
    _, _, h = quality.words([(0, " ".join(sorted({w for t in heard for w in t})).encode())])
    h = dict(zip(sorted({w for t in heard for w in t}), h.tolist(), strict=True))
    index = {w: np.zeros(quality.DIM) for w in h}
    for w in h:
        for place, sign in quality._cells(np.array([h[w]], np.uint64)):
            index[w][place] += sign
    sums = {w: np.zeros(quality.DIM) for w in h}
    for t in heard:
        for a, b in zip(t, t[1:], strict=False):
            sums[a] += index[b]
            sums[b] += np.roll(index[a], 1)
    def vector(x):  # by hand: signs of what is over LEVEL of the root mean square, as a unit vector
        level = quality.LEVEL * np.sqrt(np.mean(x * x))
        signs = np.array([(v > level) * 1 - (v < -level) * 1 for v in x])
        return signs / max(np.linalg.norm(signs), 1e-9)

    for i, t in enumerate(heard):
        want = np.mean([vector(sums[w]) for w in t], axis=0)
        assert np.allclose(got[i], want, atol=1e-5)
    assert np.abs(got[40] - got[41]).max() > 0.1
    found = quality.features(edge).collect()
    assert sorted(str(r.id) for r in found) == sorted(str(r[0]) for r in edge_rows)
    assert quality.features(empty).count() == 0


def test_packed_rows():
    x = np.array([[0] * quality.DIM, [127] * quality.DIM, [-128] * quality.DIM, [-1, 0, 1] * (quality.DIM // 3), [300] * quality.DIM, [1 << 40] * quality.DIM])
    assert (quality._unpacked(quality._packed(x)) == x).all() and len(quality._unpacked(quality._packed(x[:0]))) == 0


def test_three_levels():
    rng = np.random.default_rng(3)
    x = rng.integers(-1, 2, (500, quality.DIM))
    assert (quality._of(quality._trits(x)) == x).all() and len(quality._of(quality._trits(x[:0]))) == 0
    assert (quality.vectors_of(np.array([[4, -4, 1, 0]])) == [[1, -1, 0, 0]]).all() and not quality.vectors_of(np.zeros((2, 5))).any()


def test_contexts_add_up():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 30).astype(np.uint64)[rng.integers(0, 30, 400)]
    owner = np.sort(rng.integers(0, 9, 400))
    found, sums = quality.contexts(owner, h)
    want = {int(k): np.zeros(quality.DIM) for k in quality.keys(h)}
    cells = [(p.tolist(), s.tolist()) for p, s in quality._cells(h)]
    for i in range(399):
        if owner[i] == owner[i + 1]:
            for place, sign in cells:
                want[int(quality.keys(h)[i])][place[i + 1]] += sign[i + 1]
                want[int(quality.keys(h)[i + 1])][(place[i] + 1) % quality.DIM] += sign[i]
    assert len(found) == len(want) and all((sums[i] == want[int(k)]).all() for i, k in enumerate(found))
    turns = [quality.contexts(owner, h, (i << 48) // 3, (i + 1 << 48) // 3) for i in range(3)]
    assert (np.concatenate([f for f, _ in turns]) == found).all() and (np.concatenate([x for _, x in turns]) == sums).all()


def test_network_learns_and_calibrates():
    """A ring in three of the features, which no linear model finds, and labels with noise."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12000, quality.DIM + quality.EXTRA)) * 0.3
    x[:, :3] /= 0.3
    truth = np.abs(x[:, 0] + x[:, 1] - x[:, 2]) > 1
    y = truth ^ (rng.random(12000) < 0.05)
    net = quality.train(x[:10000], y[:10000])
    p = net(x[10000:])
    assert ((p > 0.5) == truth[10000:]).mean() > 0.85
    for low in (0.1, 0.5, 0.8):  # of what scores about so much, about so many are right
        part = (p >= low) & (p < low + 0.2)
        assert abs(p[part].mean() - y[10000:][part].mean()) < 0.2
    assert (quality.train(x[:10000], y[:10000])(x[10000:]) == p).all()


def test_op10_held_out(spark):
    out = quality.op10_quality(spark, MID).toPandas()
    held = out[out.held_out].merge(labels_of("quality"), on="doc_id")
    assert ((held.predicted == 1) == (held.quality == 1)).mean() > 0.93
    assert ((out.score >= 0.3) == (out.predicted == 1)).all() and out.doc_id.is_unique


@pytest.mark.parametrize("parts", [3, 4, 5])
def test_held_out_by_crc(spark, parts):
    import zlib

    got = spark.createDataFrame([(i,) for i in (0, 7, 123456789, None)], "doc_id long").select("doc_id", one_in("doc_id", parts).alias("m")).collect()
    assert all(r.m == zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % parts for r in got)


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 50])
def test_trigrams_in_pieces(piece):
    rng = np.random.default_rng(piece)
    texts = [b"", b"a", b"ab", b"abc", b"ABCD", *(bytes(rng.integers(32, 127, n).tolist()) for n in (piece, piece + 1, piece + 2, 2 * piece, 40, 333)), "Привет".encode()]
    assert (langid.trigram_counts(texts, piece=piece) == langid.trigram_counts(texts)).all()
    for t in (b"12 3", b"12 a", "12 ж".encode(), "½".encode(), "1\U00010400".encode(), b"\xff\xfea", b""):
        assert langid.has_letter(t, piece) == langid.has_letter(t)


def test_memory_of_a_long_text():
    """A text of 32 MB takes a block's memory and a few times a piece, not 38 times its size."""
    import tracemalloc

    text = b"several words of a text in one language " * 800_000
    tracemalloc.start()
    counts, letter = langid.trigram_counts([text]), langid.has_letter(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.sum() == len(text) and letter and peak < 6 * len(text)
