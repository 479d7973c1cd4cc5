"""Line dedup, decontamination, near dedup and substring dedup against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ferrowick.llm import decontaminate, line_dedup, near_dedup, substring_dedup
from tests.llm.common import docs, rows, sentence

# Line dedup


def lines_by_hand(table, most):
    norm = lambda x: re.sub(r"^ | $", "", re.sub(r"[ \t\r\f\x0b]+", " ", x)).lower()
    where = defaultdict(set)
    for i, text in table:
        for line in (text or "").split("\n"):
            if i is not None and norm(line):
                where[norm(line)].add(i)
    out = []
    for i, text in table:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if i is None or not norm(x) or len(where[norm(x)]) <= most or min(where[norm(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def lined():
    rng = random.Random(1)
    shared = [sentence(rng, 5) for _ in range(4)]
    table = []
    for i in range(60):
        lines = [sentence(rng, 4) for _ in range(3)] + [s.upper() if i % 3 else f"  {s}\t" for k, s in enumerate(shared) if i % (k + 1) == 0]
        rng.shuffle(lines)
        table.append((i, "\n".join(lines)))
    table += [(100, None), (101, ""), (102, "\n\n  \n"), (None, shared[0]), (None, None), (103, (shared[0] + "\n") * 5), (104, shared[1]), (104, shared[1]), (105, sentence(rng, 200_000) + "\n" + shared[0])]
    return table


def test_line_dedup_is_what_counting_by_hand_gives(spark, lined):
    assert rows(line_dedup.dedup_lines(docs(spark, lined, extra=True))) == lines_by_hand(lined, 20)
    assert rows(line_dedup.dedup_lines(docs(spark, lined), max_docs=5)) == lines_by_hand(lined, 5)


def test_line_dedup_of_a_stage_keeps_columns_and_drops_documents_left_blank(spark, lined):
    table = docs(spark, lined, extra=True)
    out = line_dedup.with_lines_dropped(table)
    assert out.columns == table.columns
    expected = sorted(((i, t) for i, t, _, dropped in lines_by_hand(lined, 20) if not (dropped and not t.strip())), key=repr)
    assert rows(out, "doc_id", "text") == expected
    assert 104 not in {r.doc_id for r in out.collect()} and 101 in {r.doc_id for r in out.collect()}


def test_line_dedup_of_an_empty_table(spark):
    assert rows(line_dedup.dedup_lines(docs(spark, []))) == []


def test_line_dedup_of_texts_with_very_many_frequent_lines(spark):
    """Time is in proportion to the lines: a text of 100,000 of them, each lost but in the first document."""
    lines = [f"line {i}" for i in range(100_000)]
    table = docs(spark, [(i, "\n".join(lines[: 100_000 if i == 21 else 2_000])) for i in range(22)] + [(22, "\n".join(f"line {i}" for i in range(2_005)))])
    out = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(table).collect()}
    assert out[0] == ("\n".join(lines[:2_000]), 2_000, 0)
    assert out[21] == ("\n".join(lines[2_000:]), 100_000, 2_000) and out[22] == ("\n".join(lines[2_000:2_005]), 2_005, 2_000)


def test_line_dedup_of_texts_that_share_an_id(spark):
    table = [(i, "common line\nown %d" % i) for i in range(30)] + [(5, "first\ncommon line"), (5, "first\ncommon line"), (6, "")]
    assert rows(line_dedup.dedup_lines(docs(spark, table))) == lines_by_hand(table, 20)


# Decontamination


def least_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        diagonal, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (p != t))
    return min(row)


def test_myers_is_the_matrix(spark):
    rng = random.Random(2)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (70, 90))
        assert decontaminate.myers(p, t) == least_distance(p, t)


def edited(rng, text, n):
    for _ in range(n):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + "#" + text[at:], text[:at] + text[at + 1 :], text[:at] + "#" + text[at + 1 :]])
    return text


def test_decontamination_is_all_pairs(spark):
    rng = random.Random(3)
    items = [(k, sentence(rng, 12)) for k in range(6)] + [(6, None), (7, ""), (8, "too short"), (9, None)]
    items[5] = (5, items[4][1])  # two items of one text
    table = [(i, sentence(rng, 30)) for i in range(10)]
    for i in range(10, 40):
        item = items[i % 6][1]
        table.append((i, sentence(rng, 8) + " " + edited(rng, item.upper(), i % 14) + "\n" + sentence(rng, 8)))
    table += [(50, None), (51, ""), (52, "   "), (None, items[0][1]), (53, items[0][1]), (53, items[0][1]), (54, sentence(rng, 50_000) + " " + items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = []
    for i, text in table:
        if text is not None and len(text) > 100_000:
            expected.append((i, 1, 0))
            continue
        for k, item in items:
            if item and text:
                d = least_distance(decontaminate.normalised(item), decontaminate.normalised(text))
                if d <= int(decontaminate.RATE * len(decontaminate.normalised(item))):
                    expected.append((i, k, d))
    found = decontaminate.contaminated(docs(spark, table, extra=True), bench)
    assert rows(found, "doc_id", "item_id", "distance") == sorted(expected, key=repr)
    assert rows(decontaminate.contaminated(docs(spark, table), bench, slice_chars=300), "doc_id", "item_id", "distance") == sorted(expected, key=repr)
    held = {i for i, _, _ in expected}
    kept = decontaminate.without_contaminated(docs(spark, table, extra=True), bench)
    assert rows(kept, "doc_id") == sorted(((i,) for i, _ in table if i not in held), key=repr)


def test_decontamination_of_a_thousand_items_with_one_opening():
    """Only the items themselves are found where all of them have hits; the distances are those of the matrix."""
    rng = random.Random(8)
    opening = sentence(rng, 12)
    items = [(i, f"{opening} {sentence(rng, 12)}") for i in range(1000)]
    matcher = decontaminate.Matcher([(i, decontaminate.normalised(t)) for i, t in items], decontaminate.RATE)
    text = " ".join(f"{opening} {sentence(rng, 14)}" for _ in range(20))
    assert matcher.find(text) == []
    for n in (0, 1, 6, 12):
        near = edited(rng, items[7][1], n)
        found = matcher.find(f"{text} {near} {text}")
        assert [k for k, _ in found] == [7] and found[0][1] <= least_distance(items[7][1], near)


def test_short_items_are_found_at_their_own_budget(spark):
    items = spark.createDataFrame([(1, "a short one"), (2, "of twenty characters"), (3, "x"), (4, " ")], "item_id long, text string")
    table = [(1, "it is A  short\none."), (2, "it is a shorter one"), (3, "of twanty characters, no y"), (4, "of twanti characters, no y"), (5, None), (6, "x")]
    found = decontaminate.contaminated(docs(spark, table), items)
    assert rows(found, "doc_id", "item_id", "distance") == [(1, 1, 0), (3, 2, 1), (6, 3, 0)]


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "an item that is long enough to be sought here")], "item_id long, text string")
    assert rows(decontaminate.contaminated(docs(spark, [(1, "x" * 99)]), none)) == []
    assert rows(decontaminate.contaminated(docs(spark, []), some)) == []
    assert rows(decontaminate.without_contaminated(docs(spark, [(1, "x")]), none), "doc_id") == [(1,)]


# Near dedup


def shingle_set(text):
    words = re.findall(r"[0-9a-zA-Z\x80-￿]+", text.lower())
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def test_near_dedup_finds_the_groups(spark):
    rng = random.Random(4)
    table, group = [], {}
    for g in range(12):
        base = sentence(rng, 120).split()
        for copy in range(1 + g % 5):
            words = list(base)
            for _ in range(copy * 3):  # up to 12 words of 120 changed
                words[rng.randrange(len(words))] = sentence(rng, 1)
            group[len(table)] = g
            table.append((len(table), " ".join(words)))
    for i in range(300, 330):
        table.append((i, sentence(rng, 60)))
    table += [(400, "tiny text"), (401, "TINY  text!"), (500, None), (501, ""), (502, " \n"), (None, table[0][1]), (503, sentence(rng, 60_000)), (504, table[3][1]), (504, table[3][1])]
    table.append((505, table[-3][1] + " end"))
    keep = {}
    for i, g in group.items():
        keep.setdefault(g, i)
    expected = {(i, keep[g]) for i, g in group.items() if i != keep[g]} | {(401, 400), (504, keep[group[3]]), (505, 503)}
    assert rows(near_dedup.near_duplicates(docs(spark, table, extra=True))) == sorted(expected, key=repr)
    left = near_dedup.without_near_duplicates(docs(spark, table))
    gone = {i for i, _ in expected}
    assert rows(left, "doc_id") == sorted(((i,) for i, _ in table if i not in gone), key=repr)


def star(rng, base, copies, changed):
    """Texts that differ from base in as many words, no two of them next to each other, and so resemble each other less."""
    out = []
    for _ in range(copies):
        words = list(base)
        for at in rng.sample(range(0, len(words), 3), changed):
            words[at] = sentence(rng, 1)
        out.append(" ".join(words))
    return out


def groups_of_all_pairs(texts):
    """Least member of each text's group, of all pairs that share a band and agree in enough bins."""
    sig = near_dedup.signatures(pa.array(texts))[0]
    bands = sig[:, : near_dedup.ROWS * near_dedup.BANDS].reshape(len(texts), near_dedup.BANDS, near_dedup.ROWS)
    label = np.arange(len(texts))
    for i in range(len(texts)):
        near = ((sig == sig[i]).sum(1) >= near_dedup.THRESHOLD * near_dedup.BINS) & (bands == bands[i]).all(2).any(1)
        met = np.unique(label[near])
        label[np.isin(label, met)] = met[0]
    return label.tolist()


@pytest.mark.parametrize("block", [None, 16])
def test_near_dedup_of_copies_that_resemble_only_an_original_in_their_middle(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(6)
    base = sentence(rng, 300).split()
    copies = star(rng, base, 300, 20)
    texts = copies[:150] + [" ".join(base)] + copies[150:]
    expected = groups_of_all_pairs(texts)
    assert len(set(expected)) < 4
    found = {r.doc_id: r.keeper_id for r in near_dedup.near_duplicates(docs(spark, list(enumerate(texts)))).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == expected


def test_near_dedup_of_ids_with_several_texts(spark):
    rng = random.Random(7)
    a, x, p, y, z = (sentence(rng, 100) for _ in range(5))
    table = [(3, a), (7, a), (7, x), (8, x + " end"), (30, p), (31, p + " end"), (31, y), (32, y + " end"), (40, z), (40, z), (41, None), (41, None), (None, z)]
    assert rows(near_dedup.near_duplicates(docs(spark, table))) == sorted([(7, 3), (8, 7), (31, 30), (32, 31)], key=repr)
    left = rows(near_dedup.without_near_duplicates(docs(spark, table, extra=True)), "doc_id", "text")
    assert left == sorted([(3, a), (7, x), (30, p), (31, y), (40, z), (41, None), (41, None), (None, z)], key=repr)


def test_signatures_estimate_similarity_and_fill_every_bin():
    rng = random.Random(5)
    base = sentence(rng, 300).split()
    for share in (0.0, 0.1, 0.3):
        other = [w if rng.random() > share else sentence(rng, 1) for w in base]
        one, two = " ".join(base), " ".join(other)
        sig, some = near_dedup.signatures(pa.array([one, two, "a b", ""]))
        a, b = shingle_set(one), shingle_set(two)
        assert abs((sig[0] == sig[1]).mean() - len(a & b) / len(a | b)) < 0.16
        assert some.tolist() == [True, True, True, False] and len(set(sig[2].tolist())) == 1


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    found = {r.id: r.label for r in near_dedup.components(chain).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_near_dedup_of_an_empty_table(spark):
    assert rows(near_dedup.near_duplicates(docs(spark, []))) == []


# Substring dedup


def repeats_by_hand(table, n=substring_dedup.MIN_WORDS):
    split, where = [], defaultdict(set)
    for i, text in table:
        if i is None or text is None:
            continue
        data = text.encode()
        words = [m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", data)]
        tokens = [data[a:z] for a, z in words]
        split.append((i, words, tokens))
        for p in range(len(tokens) - n + 1):
            where[tuple(tokens[p : p + n])].add(i)
    out = set()
    for i, words, tokens in split:
        spans = []
        for p in range(len(tokens) - n + 1):
            if len(where[tuple(tokens[p : p + n])]) > 1:
                a, z = words[p][0], words[p + n - 1][1]
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = z
                else:
                    spans.append([a, z])
        out |= {(i, a, z) for a, z in spans}
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(6)
    shared = [sentence(rng, n) for n in (49, 50, 51, 60, 75, 90, 140, 400)]
    table = [(i, sentence(rng, 20 + 3 * i)) for i in range(10)]
    for i in range(10, 70):
        parts = [sentence(rng, rng.randint(1, 80)) for _ in range(3)]
        parts.insert(rng.randint(0, 3), shared[i % 8])
        if i % 5 == 0:
            parts.insert(rng.randint(0, 3), "é " + shared[(i + 3) % 8])
        table.append((i, "\n".join(parts)))
    once = sentence(rng, 70)
    table += [(100, once + " and " + once), (101, "w " * 300), (102, "w " * 120 + "v"), (103, None), (104, ""), (None, shared[7]), (105, shared[6]), (106, shared[6]), (106, shared[6]), (107, sentence(rng, 5)), (108, sentence(rng, 60_000) + " " + shared[7]), (109, sentence(rng, 90)), (109, sentence(rng, 95))]
    return table


@pytest.mark.parametrize("more", [{}, {"shard_words": 3000}, {"max_classes": 2}, {"max_classes": 0}])
def test_substring_dedup_is_all_runs_by_hand(spark, passages, more):
    found = substring_dedup.repeated_passages(docs(spark, passages, extra=True), **more)
    assert rows(found) == repeats_by_hand(passages)


def test_matching_statistics_are_the_longest_matches():
    rng = np.random.default_rng(1)
    for _ in range(40):
        k, letters = int(rng.integers(2, 7)), int(rng.integers(2, 5))
        windows = [rng.integers(1, letters + 1, int(rng.integers(1, 14))).astype(np.uint64) for _ in range(k)]
        owner = np.where(rng.random(k) < 0.2, -1, rng.integers(0, 3, k))
        which = np.flatnonzero(owner != -1)
        if not len(which):
            continue
        expected = []
        for i in which:
            others = ["," + ",".join(map(str, windows[j])) + "," for j in range(k) if owner[j] != owner[i] or owner[j] == -1]
            w = windows[i]
            expected += [max([0, *(n for n in range(1, len(w) - p + 1) if any("," + ",".join(map(str, w[p : p + n])) + "," in o for o in others))]) for p in range(len(w))]
        got = substring_dedup.FMIndex(windows, owner).matching_statistics(which, np.array([len(windows[i]) for i in which]))
        assert got.tolist() == expected


def test_anchors_lie_in_every_long_run():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 50, 900).astype(np.uint64)
    rows_of = np.repeat(np.arange(3), 300)
    at = substring_dedup.anchors(words, rows_of)
    for first in (0, 300, 600):
        for p in range(first, first + 300 - substring_dedup.MIN_WORDS + 1):
            assert ((at >= p) & (at + substring_dedup.ANCHOR <= p + substring_dedup.MIN_WORDS)).any()


def test_substring_dedup_of_an_empty_table(spark):
    assert rows(substring_dedup.repeated_passages(docs(spark, []))) == []
