import random

import numpy as np
import pytest

from loamgraph.llm.leakage import Items, LeakRules, leaked_items, shared_openings
from loamgraph.llm.letters import GramSet, grams, letter_code, letters, words_of

WORDS = "harbour lantern timber copper valley orchard silver bridge meadow castle thunder winter market garden river stone church school pepper saddle mirror window barrel candle anchor feather hammer kettle ladder needle pocket ribbon".split()


def passage(seed, n=40):
    r = random.Random(seed)
    return [r.choice(WORDS) + r.choice(["", "s", "man", "wick", "ford", "ley"]) for _ in range(n)]


def wrap(words, width=38, seed=0, hyphenate=True):
    r, lines, line = random.Random(seed), [], ""
    for w in words:
        if line and len(line) + len(w) + 1 > width:
            if hyphenate and len(w) > 6 and r.random() < 0.4:
                lines.append(f"{line} {w[:3]}-")
                line = w[3:]
                continue
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*lines, line]


def misread(lines, seed):
    r = random.Random(seed)
    out = []
    for l in lines:
        c = list(l)
        if len(c) > 12 and r.random() < 0.6:
            i = r.randrange(len(c))
            c[i] = {"m": "rn", "d": "cl", "w": "vv"}.get(c[i], "x") if c[i].isalpha() else c[i]
        out.append("".join(c))
    return out


def noise(seed, n):
    return wrap(passage(1000 + seed, n), seed=seed)


def adverts(lines, every=3):
    out = []
    for i, l in enumerate(lines):
        out.append(l)
        if i % every == every - 1:
            out += ["BEST TEAS 10s. 4d. PER DOZ.", "SALE THIS DAY"]
    return out


OPENING = "Read the passage and answer the question below."


@pytest.fixture(scope="module")
def items():
    return [(i, (f"{OPENING} " if i % 2 else "") + " ".join(passage(i, 45)).capitalize() + ".", "en") for i in range(20)]


def docs_and_truth(items):
    docs, truth = [], set()
    for k in range(20):
        words = passage(k, 45)
        docs.append((3 * k, "\n".join([*noise(k, 60), *misread(wrap(["Then", *words[5:35]], seed=k), k), *noise(k + 50, 60)])))
        truth.add((3 * k, k))
        docs.append((3 * k + 1, "\n".join([*noise(k + 100, 40), *adverts(wrap(words[10:34], seed=k + 1)), *noise(k + 150, 30)]).upper()))
        truth.add((3 * k + 1, k))
        docs.append((3 * k + 2, "\n".join([OPENING, *noise(k + 200, 40), *wrap(words[5:19], seed=k), *noise(k + 250, 20), *wrap(words[25:39], seed=k)])))  # too few at a time
    columns = [x for p in zip(wrap(passage(3, 45)[:30], hyphenate=False), noise(900, 40)) for x in p]
    docs.append((500, "\n".join(columns)))
    truth.add((500, 3))
    words = wrap(passage(6, 45)[4:34], hyphenate=False)
    left, right = [*noise(910, 20)[:3], *words[:3]], [*words[3:], *noise(911, 40)]  # the passage goes on at the head of the next column
    docs.append((502, "\n".join(x for p in zip(left, right) for x in p)))
    truth.add((502, 6))
    docs.append((501, " ".join(passage(4, 45))))  # one long line
    truth.add((501, 4))
    return docs, truth


def test_planted_passages(spark, items):
    docs, truth = docs_and_truth(items)
    docs += [(600, None), (601, ""), (None, " ".join(passage(5, 45))), (602, "x " * 200_000), (500, docs[-3][1])]
    d = spark.createDataFrame([(*x, "n") for x in docs], "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame([*items, (77, None, "en"), (None, "a b", "en"), (78, "too short", "en"), items[0]], "item_id bigint, text string, doc_id string")
    got = leaked_items(d, e)
    assert {(r[0], r[1]) for r in got.collect()} == truth and all(r[2] >= 20 for r in got.collect())
    assert {(r[0], r[1]) for r in leaked_items(d, e, block_items=7).collect()} == truth
    assert leaked_items(d.where("false"), e).count() == 0 and leaked_items(d, e.where("false")).count() == 0


def leaks(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    return {(r[0], r[1]) for r in leaked_items(d, spark.createDataFrame(items, "item_id bigint, text string, lang string")).collect()}


def test_column_break_far_up(spark, items):
    words = passage(6, 45)[8:32]  # twelve words at the foot of a long column, twelve at the head of the next
    left = [*noise(920, 400)[:40], *wrap(words[:12], hyphenate=False)]
    right = [*wrap(words[12:], hyphenate=False), *noise(921, 400)[:40]]
    docs = [(1, "\n".join(x for p in zip(left, right) for x in p)), (2, "\n".join([*left, *noise(922, 200), *noise(923, 60)]))]
    assert leaks(spark, docs, items) == {(1, 6)}


def test_any_lines_between(spark, items):
    words = passage(7, 45)[8:32]  # twelve words, a column of adverts, twelve words
    head, foot = wrap(words[:12], hyphenate=False), wrap(words[12:], hyphenate=False)
    docs = [(k, "\n".join([*noise(930, 60), *head, *["", "SALE THIS DAY"] * k, *foot, *noise(931, 60)])) for k in (3, 10, 40, 400)]
    few = wrap(words[:4], hyphenate=False)  # a few words alone, far from the rest
    docs.append((1, "\n".join([*few, *adverts(noise(932, 300), 1), *wrap(words[4:], hyphenate=False)])))
    assert leaks(spark, docs, items) == {(3, 7), (10, 7), (40, 7), (400, 7), (1, 7)}


def test_item_in_a_third_of_the_documents(spark, items):
    words = passage(8, 45)[11:33]  # all its n-grams are frequent, and blocks at its ends have rarer ones
    docs = []
    for k in range(60):
        lines = noise(1000 + k, 100)
        if k % 3 == 0:
            lines += [x for p in zip(wrap(words, 22, hyphenate=False), noise(1100 + k, 100)) for x in p]
        docs.append((k, "\n".join(lines)))
    assert leaks(spark, docs, items) == {(k, 8) for k in range(0, 60, 3)}


def test_openings_are_shared_sentences(items):
    assert shared_openings([t for _, t, _ in items], LeakRules()) == {OPENING}
    its = Items([i for i, _, _ in items], [t for _, t, _ in items], LeakRules())
    assert len(its.ids) == 20 and its.words_in(1, 0, int(its.start[2] - its.start[1])) == 45


def test_letters_drop_what_does_not_matter():
    a, owner, _ = letters(["Straße-\nbau, ÉTÉ 1,200!", "x"])
    b, _, _ = letters(["strassebauete1200", "x"])
    assert len(a) == len(b) and owner.tolist() == [0] * 17 + [1]
    g = grams(a, owner, 4)
    assert (g[-1:] == -1).all() and len(GramSet(g).hits(g)[0]) == (g >= 0).sum()
    assert letters([""])[0].size == 0 and grams(np.zeros(2, np.uint8), np.zeros(2, int), 4).size == 0


def script_words(seed, n, low, high, least=2, most=7):
    r = random.Random(seed)
    letters_ = [c for c in map(chr, range(low, high)) if c.isalpha()]
    return ["".join(r.choice(letters_) for _ in range(r.randint(least, most))) for _ in range(n)]


@pytest.mark.parametrize("low, high", [(0x430, 0x450), (0x3B1, 0x3C9), (0x627, 0x64A), (0x915, 0x939), (0x5D0, 0x5EA), (0x10D0, 0x10F0)], ids=["cyrillic", "greek", "arabic", "devanagari", "hebrew", "georgian"])
def test_passages_of_other_scripts(spark, low, high):
    say = lambda seed, n: script_words(seed, n, low, high)
    items = [(k, " ".join(say(k, 40)) + ".", "xx") for k in range(6)]
    docs = []
    for k in range(6):
        words = items[k][1][:-1].split()
        docs.append((2 * k, "\n".join([*wrap(say(100 + k, 60), seed=k), *adverts(wrap(words[6:32], seed=k)), *wrap(say(200 + k, 40), seed=k)]).upper()))
        docs.append((2 * k + 1, "\n".join([*wrap(say(300 + k, 60), seed=k), *wrap(words[6:18], seed=k), *wrap(say(400 + k, 60), seed=k)])))
    assert leaks(spark, docs, items) == {(2 * k, k) for k in range(6)}


def test_passages_without_blanks(spark):
    r = random.Random(5)
    text = lambda n: "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(n))
    rows = lambda t, w=15: "\n".join(t[i : i + w] for i in range(0, len(t), w))
    items = [(k, text(100) + "。" + text(60), "zh") for k in range(4)] + [(9, "".join(chr(r.randrange(0x20000, 0x2A000)) for _ in range(90)), "zh")]
    docs = [(k, "\n".join([rows(text(120)), rows(items[k][1][20:75]), rows(text(120))])) for k in range(4)]
    docs += [(9, "\n".join([rows(text(60)), rows(items[4][1][10:70]), rows(text(60))])), (7, "\n".join([rows(text(60)), rows(items[0][1][20:45]), rows(text(60))]))]
    assert leaks(spark, docs, items) == {(0, 0), (1, 1), (2, 2), (3, 3), (9, 9)}


def test_long_items_and_blocks_by_letters(spark, monkeypatch):
    long = passage(70, 24_000)  # more than 100,000 letters
    items = [(1, " ".join(long), "en"), *((k, " ".join(passage(k, 45)), "en") for k in range(2, 8))]
    docs = [(1, "\n".join([*noise(940, 40), *wrap(long[23_000:23_030], seed=1), *noise(941, 40)])), (2, "\n".join([*noise(942, 40), *wrap(long[9:40], seed=2)])), (3, "\n".join([*wrap(passage(3, 45)[5:35], seed=3), *noise(943, 40)]))]
    assert leaks(spark, docs, items) == {(1, 1), (2, 1), (3, 3)}
    monkeypatch.setattr("loamgraph.llm.leakage.BLOCK_LETTERS", 900)
    assert leaks(spark, docs, items[1:]) == {(3, 3)}


def test_codes_of_letters():
    code = {c: letter_code(c) for c in "aÀẶ9９ЖжΣσςｱア中가漢 ,。️"}
    assert code["a"] == code["À"] == code["Ặ"] == 0 and code["9"] == code["９"] == 35 and code["Ж"] == code["ж"] >= 36 and code["Σ"] == code["σ"] == code["ς"] and code["ｱ"] == code["ア"]
    assert all(code[c] == 255 for c in " ,。") and 36 <= code["가"] < 64
    assert words_of("It's  — 12 中文字漢 ok。") == ["It's", "12", "中文", "字漢", "ok。"]
