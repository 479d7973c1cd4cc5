"""Quality, toxicity and language: held-out accuracy, the methods' parts, and awkward rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferrowick.llm import language, quality, toxicity
from tests.llm.common import WORDS, docs, rows, sentence

ODD = [(9000, None), (9001, ""), (9002, " \n\t"), (None, "river stone garden"), (9003, "x" * 300_000), (9004, "river stone"), (9004, "river stone")]


def labelled(spark, table):
    return spark.createDataFrame(table, "doc_id long, quality int, toxic int, text int, fw_label int")


# Quality


@pytest.fixture(scope="module")
def graded():
    rng = random.Random(7)
    table, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        text = "\n".join(sentence(rng, 12).capitalize() + "." for _ in range(rng.randint(2, 8)))
        if not good:
            text = rng.choice([lambda t: re.sub(r" ", "%%% ", t), str.upper, lambda t: (t.split("\n")[0] + "\n") * 30])(text)
        table.append((i, text))
        labels.append((i, int(good), 0, 1, 2))
    return table, labels


def test_quality_on_documents_held_out(spark, graded):
    table, labels = graded
    all_docs = docs(spark, table + ODD, extra=True)
    seen = [x for x in labels if x[0] < 400] + [(None, 1, 0, 0, 0), (5000, 1, 0, 0, 0), (3, None, None, 0, 0), (4, labels[4][1], 0, 0, 0)]
    model = quality.fit_quality(all_docs, labelled(spark, seen))
    out = quality.score_quality(all_docs, model)
    assert out.columns == ["doc_id", "score", "quality", "keep"]
    found = [r for r in out.collect()]
    assert len(found) == len(table) + len(ODD) and all(0 <= r.quality <= 1 and np.isfinite(r.score) for r in found)
    truth = {i: bool(y) for i, y, *_ in labels if i >= 400}
    assert np.mean([r.keep == truth[r.doc_id] for r in found if r.doc_id in truth]) > 0.95
    again = [r for r in found if r.doc_id == 9004]
    assert len(again) == 2 and again[0] == again[1]


def test_quality_without_labels_with_one_class_and_on_an_empty_table(spark, graded):
    table = docs(spark, graded[0][:20])
    none = quality.fit_quality(table, labelled(spark, []))
    assert none is None and {(r.quality, r.keep) for r in quality.score_quality(table, none).collect()} == {(None, True)}
    one = quality.fit_quality(table, labelled(spark, [(i, 1, 0, 0, 0) for i in range(9)]))
    assert {(r.quality, r.keep) for r in quality.score_quality(table, one).collect()} == {(1.0, True)}
    assert rows(quality.score_quality(docs(spark, []), one)) == []


def test_statistics_of_a_batch_are_those_of_each_text(graded):
    texts = [t for _, t in graded[0][:30]] + [t for _, t in ODD]
    together = quality.statistics(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert np.allclose(together[i], quality.statistics(pa.array([t], pa.string()))[0])
    named = dict(zip(quality.STATISTICS, quality.statistics(pa.array(["Ab cd. 12 Ab\nAb cd."]))[0], strict=True))
    assert named["log_words"] == np.log1p(6) and named["distinct_words"] == 0.5 and np.isclose(named["digits"], 2 / 19) and named["ended_lines"] == 0.5
    assert not quality.statistics(pa.array([None, ""], pa.string())).any()


def test_random_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(3)
    d, n, width = 5, 20_000, 2.0
    model = quality.QualityModel(np.zeros(d), np.ones(d), rng.normal(0, 1 / width, (d, n)), rng.uniform(0, 2 * np.pi, n))
    x = rng.normal(size=(6, d))
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * width**2))
    assert np.abs(model.features(x) @ model.features(x).T - kernel).max() < 0.05


def test_isotonic_is_the_least_squares_rising_fit():
    rng = np.random.default_rng(4)
    s = rng.permutation(np.repeat(np.arange(15.0), 2))
    y = (rng.random(30) < s / 15).astype(float)
    knots, values = quality.isotonic(s, y)
    assert (np.diff(values) >= -1e-12).all()
    means = np.array([y[s == v].mean() for v in range(15)])
    # the minimax formula of isotonic regression
    expected = [max(min(means[a : b + 1].mean() for b in range(i, 15)) for a in range(i + 1)) for i in range(15)]
    assert np.allclose(np.interp(np.arange(15.0), knots, values), expected)


def described(text):
    """The statistics of a text, one by one."""
    raw = (text or "").encode()
    split = lambda pattern, data: re.findall(pattern, data)
    words, lines = split(rb"[^\t\n\x0b\x0c\r ]+", raw), split(rb"[^\n]+", raw)
    size, n = max(len(raw), 1), max(len(words), 1)
    share = lambda pattern, data=raw, of=size: len(re.findall(pattern, data)) / of
    length = np.array([len(w) for w in words], float)
    mean = length.sum() / n
    spans = [m.span() for m in re.finditer(rb"[^\t\n\x0b\x0c\r ]+", raw)]
    triples = [raw[a[0] : c[1]].lower() for a, _, c in zip(spans, spans[1:], spans[2:])]
    return [
        np.log1p(len(raw)), share(rb"[A-Za-z\x80-\xff]"), share(rb"[0-9]"), share(rb"[A-Z]"), share(rb"[\x80-\xff]"), share(rb"[!-/:-@\[-`{-~]"), share(rb"[#$%&*|!<>{}\[\]\\^~=_@]"), share(rb"[\t\n\x0b\x0c\r ]"),
        np.log1p(len(words)), np.log1p(mean), np.log1p(np.sqrt(max((length**2).sum() / n - mean**2, 0))), sum(w > 14 for w in length) / n, sum(w < 4 for w in length) / n, sum(not re.search(rb"[A-Za-z\x80-\xff]", w) for w in words) / n,
        len({w.lower() for w in words}) / n, 1 - len(set(triples)) / len(triples) if triples else 0, np.log1p(len(lines)), len({x.lower() for x in lines}) / max(len(lines), 1), np.log1p(len(raw) / max(len(lines), 1)),
        sum(x[-1:] in b".!?:;\"')" for x in lines) / max(len(lines), 1), sum(len(re.findall(rb"[A-Z]", w)) > 1 for w in words) / n,
    ]


def test_quality_query_is_the_fit_by_hand(spark, graded, tmp_path):
    """Statistics text by text, ridge by least squares over the stacked features, isotonic fit by its minimax formula."""
    import __spark_entry__
    from ferrowick.llm._session import hash_share

    table, labels = graded[0][:160] + ODD, graded[1][:120] + [(9000, 0, 0, 1, 2), (None, 1, 0, 1, 2), (5, 0, 0, 1, 2)]
    docs(spark, table, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    labelled(spark, labels).write.parquet(f"{tmp_path}/labels.parquet")
    truth = {}
    for i, y, *_ in labels:
        if i is not None:
            truth[i] = max(y, truth.get(i, 0))
    held = {r.i for r in spark.createDataFrame([(i,) for i in truth], "i long").where(hash_share("i", 0.3, 5)).collect()}
    text = dict(table)
    ids = sorted(truth)
    x, y = np.array([described(text[i]) for i in ids]), np.array([truth[i] for i in ids], float)
    aside = np.array([i in held for i in ids])
    rng, n = np.random.default_rng(11), 256
    w, phase = rng.normal(0, 1 / 4.0, (x.shape[1], n)), rng.uniform(0, 2 * np.pi, n)
    features = lambda v: np.sqrt(2 / n) * np.cos((v - x.mean(0)) / np.maximum(x.std(0), 1e-6) @ w + phase)
    z, ridge = features(x[~aside]), 1e-3 * (~aside).sum() / n
    weights = np.linalg.lstsq(np.vstack([z, np.sqrt(ridge) * np.eye(n)]), np.append(y[~aside] - y.mean(), np.zeros(n)), rcond=None)[0]
    score = lambda v: features(v) @ weights + y.mean()
    s, order = score(x[aside]), np.argsort(score(x[aside]))
    s, t = s[order], y[aside][order]
    fit = [max(min(t[a : b + 1].mean() for b in range(i, len(t))) for a in range(i + 1)) for i in range(len(t))]
    found = {r.doc_id: r for r in __spark_entry__.queries()["op1_quality"](spark, str(tmp_path)).collect()}
    assert len(found) == len(dict(table))
    for i, v in text.items():
        expected = score(np.array([described(v)]))[0]
        assert abs(found[i].score - expected) < 1e-6, i
        assert abs(found[i].quality - np.interp(expected, s, fit)) < 1e-4 and found[i].keep == (found[i].quality >= 0.5)


# Bounded samples


def test_a_sample_is_bounded_whatever_ids_repeat(spark):
    from ferrowick.llm import _session

    table = spark.range(100_000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = labelled(spark, [(0, 1, 0, 0, 0), (1, 0, 1, 0, 0), (1, 1, 0, 0, 0)])
    assert rows(_session.labelled(table, labels, "doc_id", "text", "quality", 100)) == [(0, "text 0", 1), (1, "text 1", 1)]
    many = spark.range(5_000).select((F.col("id") % 7).alias("doc_id"), "id")
    assert all(_session.bounded(many, "doc_id", most).count() <= most for most in (1, 10, 100, 4_999))
    assert _session.bounded(many, "id", 1_000).count() > 850


# Toxicity


@pytest.fixture(scope="module")
def moderated():
    rng = random.Random(8)
    table, labels = [], []
    for i in range(800):
        words, bad = sentence(rng, 60).split(), rng.random() < 0.3
        if bad:
            words[rng.randrange(60)] = rng.choice(["blorgish", "snarkful"])
            if rng.random() < 0.7:  # the group is named in toxic texts far more often than in others
                words[rng.randrange(60)] = "muslims"
        elif rng.random() < 0.1:
            words[rng.randrange(60)] = "muslims"
        table.append((i, " ".join(words)))
        labels.append((i, 1, int(bad), 1, 2))
    return table, labels


def test_toxicity_on_documents_held_out(spark, moderated):
    table, labels = moderated
    all_docs = docs(spark, table + ODD, extra=True)
    model = toxicity.fit_toxicity(all_docs, labelled(spark, [x for x in labels if x[0] < 600] + [(None, 1, 1, 0, 0), (5, 1, None, 0, 0)]))
    out = toxicity.score_toxicity(all_docs, model).collect()
    assert len(out) == len(table) + len(ODD)
    truth = {i: bool(t) for i, _, t, *_ in labels if i >= 600}
    flagged = {r.doc_id: r.is_toxic for r in out}
    caught = [flagged[i] for i, t in truth.items() if t]
    assert np.mean([r for r in caught if r is not None]) > 0.95
    assert np.mean([flagged[i] for i, t in truth.items() if not t]) < 0.05
    kept = toxicity.without_toxic(all_docs, model)
    assert kept.columns == all_docs.columns
    assert rows(kept, "doc_id") == sorted(((r.doc_id,) for r in out if not r.is_toxic), key=repr)


def test_the_counterfactual_penalty_makes_neutral_mentions_harmless(spark, moderated):
    table, labels = moderated
    all_docs = docs(spark, table)
    rng = random.Random(9)
    neutral = [sentence(rng, 40) for _ in range(40)]
    named = [t + " muslims " + sentence(rng, 5) for t in neutral]
    shift = {}
    for weight in (0.0, 5.0):
        model = toxicity.fit_toxicity(all_docs, labelled(spark, labels), counterfactual=weight)
        logit = lambda ts, m=model: np.log(m.score(pa.array(ts)) / (1 - m.score(pa.array(ts))))
        swapped = [toxicity.swap_terms(t) for t in named]
        shift[weight] = np.abs(logit(named) - logit(swapped)).mean()
        assert swapped[0] != named[0]
    assert shift[5.0] < 0.5 * shift[0.0]


def test_toxicity_fit_by_hand(spark, moderated):
    """The features of most Pearson statistic, and the descent, over a dense matrix."""
    from ferrowick.llm._session import hash_share

    table, labels = moderated[0][:150], moderated[1][:150]
    model = toxicity.fit_toxicity(docs(spark, table), labelled(spark, labels), max_features=40)
    held = {r.i for r in spark.createDataFrame([(i,) for i, _ in table], "i long").where(hash_share("i", 0.2, 7)).collect()}
    of = lambda text: set(toxicity._features(*toxicity.tx.as_bytes(pa.array([text])))[1].tolist())
    each, y = [of(t) for _, t in table], np.array([x[2] for x in labels])
    n1, n0, n = y.sum(), (1 - y).sum(), len(y)
    chi = {}
    for f in set().union(*each):
        has = np.array([f in x for x in each])
        a, b = (has & (y == 1)).sum(), (has & (y == 0)).sum()
        if a + b >= 5:
            chi[f] = (a * n0 - b * n1) ** 2 * n / (n0 * n1 * (a + b) * (n - a - b + 0.5))
    names = sorted(chi, key=lambda f: (-chi[f], f))[:40]
    dense = lambda text: np.array([f in of(text) for f in names], float)
    own = [k for k, (i, _) in enumerate(table) if i not in held]
    x, t = np.array([dense(table[k][1]) for k in own]), y[own]
    swaps = [(table[k][1], v) for k in own for v in dict.fromkeys(toxicity.swap_terms(table[k][1], step) for step in (1, 2)) if v != table[k][1]]
    change = np.array([dense(a) - dense(b) for a, b in swaps])
    w, bias, m, v = np.zeros(40), np.log(t.mean() / (1 - t.mean())), np.zeros(41), np.zeros(41)
    for step in range(1, 301):
        gap = 1 / (1 + np.exp(-(x @ w + bias))) - t
        g = np.append(x.T @ gap / len(t) + 1e-3 * w + 2 * (change.T @ (change @ w)) / len(change), gap.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) * (1 - step / 301)
        w, bias = w - move[:-1], bias - move[-1]
    w[np.abs(w) < 1e-3] = 0
    assert set(np.flatnonzero(model.weights)) == {f for f, value in zip(names, w, strict=True) if value}
    assert np.allclose(model.weights[names], w, atol=1e-3) and abs(model.bias - bias) < 1e-3
    scores = np.array([1 / (1 + np.exp(-(dense(text) @ w + bias))) for i, text in table if i in held])
    truth = np.array([bool(c) for (i, _), c in zip(table, y, strict=True) if i in held])
    f1 = lambda cut: 2 * ((scores >= cut) & truth).sum() / ((scores >= cut).sum() + truth.sum())
    assert f1(model.threshold) >= max(f1(c) for c in scores) - 1e-9


def test_toxicity_without_labels_with_one_class_and_on_an_empty_table(spark, moderated):
    table = docs(spark, moderated[0][:20] + ODD)
    for labels, flagged in (([], False), ([(i, 1, 0, 0, 0) for i in range(9)], False), ([(i, 1, 1, 0, 0) for i in range(9)], True)):
        out = toxicity.score_toxicity(table, toxicity.fit_toxicity(table, labelled(spark, labels))).collect()
        assert {r.is_toxic for r in out} == {flagged} and len(out) == 20 + len(ODD)
    model = toxicity.fit_toxicity(table, labelled(spark, []))
    assert rows(toxicity.score_toxicity(docs(spark, []), model)) == []


def test_features_are_words_and_their_beginnings():
    texts = ["Stupid stupid words", "", "é a"]
    data, offsets = toxicity.tx.as_bytes(pa.array(texts))
    r, f = toxicity._features(data, offsets)
    # stupid: the word and beginnings of 4, 5, 6; words: the word and beginnings of 4, 5
    assert np.bincount(r, minlength=3).tolist() == [7, 0, 2]
    one = toxicity._features(*toxicity.tx.as_bytes(pa.array(["WORDS stupid"])))[1]
    assert set(one) == set(f[r == 0])


# Language


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(10)
    sounds = {"aa": "kato mir elas tin oru".split(), "bb": "schu wenz gral tupf ech".split(), "cc": "éla çou vré mon tieau".split()}
    table = []
    for i in range(450):
        lang = list(sounds)[i % 3]
        table.append((i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 40))), lang))
    return table


def test_language_on_documents_held_out(spark, spoken):
    taught = docs(spark, [*spoken[:300], (700, None, "aa"), (701, "abc", None), (None, "kato kato", "aa")], extra=True)
    filters = language.fit_languages(taught, min_count=2)
    asked = docs(spark, [*spoken[300:], *ODD, (9010, "123 456"), (9011, "zzzzzqqqqq")], extra=True)
    out = language.identify(asked, filters).collect()
    truth = {i: lang for i, _, lang in spoken[300:]}
    found = {r.doc_id: r.language for r in out}
    assert len(out) == 150 + len(ODD) + 2
    assert np.mean([found[i] == lang for i, lang in truth.items()]) > 0.98
    assert {found[i] for i in (9000, 9001, 9002, 9010, 9011)} == {"und"}
    assert language.identify(docs(spark, []), filters).collect() == []


def grams_by_hand(text):
    out = []
    for word in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode()):
        word = word.lower()
        out.append(("word", word))
        out += [(n, i == 0, word[i : i + n]) for n in language.SIZES for i in range(len(word) - n + 1)]
    return out


def test_language_query_is_a_count_over_sets(spark, spoken, tmp_path):
    """Each language's n-grams as a set; the filters may only add what the correction takes off again."""
    from collections import Counter

    import __spark_entry__

    table = [*spoken, (900, "kato mirelas 12 schuwenz", "aa"), *[(*o, None) for o in ODD]]
    docs(spark, table, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    counts = {lang: Counter() for lang in ("aa", "bb", "cc")}
    for _, text, lang in table:
        if lang:
            counts[lang].update(grams_by_hand(text))
    held = {lang: {g for g, n in c.items() if n >= 3} for lang, c in counts.items()}
    found = __spark_entry__.queries()["op10_language"](spark, str(tmp_path)).collect()
    assert len(found) == len(table)
    text = {i: t for i, t, _ in table}
    for r in found:
        grams = grams_by_hand(text[r.doc_id])
        assert r.n_grams == len(grams)
        shares = {lang: sum(g in own for g in grams) / max(len(grams), 1) for lang, own in held.items()}
        best = max(shares, key=lambda lang: (shares[lang], -ord(lang[0])))
        if not grams or shares[best] < 0.04:
            assert r.language == "und"
        else:
            assert r.language == best and abs(r.score - shares[best]) < 0.03


def test_language_without_teachers(spark, spoken):
    filters = language.fit_languages(docs(spark, []))
    assert {r.language for r in language.identify(docs(spark, spoken[:5]), filters).collect()} == {"und"}


def test_bit_sliced_filters_never_miss_and_hold_more_than_64_languages():
    rng = np.random.default_rng(5)
    profiles = {f"l{i:03d}": rng.integers(0, 1 << 63, 300, dtype=np.uint64) for i in range(70)}
    filters = language.LanguageFilters.of(profiles)
    for i, name in enumerate(filters.languages):
        mask = filters.containing(profiles[name])[:, i // 64] >> np.uint64(i % 64)
        assert (mask & np.uint64(1)).all()
    others = rng.integers(0, 1 << 63, 200_000, dtype=np.uint64)
    rate = np.bitwise_count(filters.containing(others)).sum() / (len(others) * 70)
    assert abs(rate - filters.false_rates().mean()) < 0.3 * rate + 1e-5


def test_n_grams_are_those_of_words():
    data, offsets = language.tx.as_bytes(pa.array(["Abcd x", "abcd", ""]))
    r, g = language.n_grams(data, offsets)
    # abcd: itself, two of three letters, one of four; x: itself
    assert np.bincount(r, minlength=3).tolist() == [5, 4, 0]
    assert set(g[r == 1]) < set(g[r == 0]) and WORDS
