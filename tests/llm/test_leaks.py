import random

import numpy as np
import pytest

from panelforge.llm import leaks
from panelforge.llm.reading import fold, page_words, reading_order

VOCAB = "harbour lantern market baker council quarry steamer bridge orchard tariff vessel meadow copper timber garden window castle forest river mountain painter doctor letter ribbon saddle candle barrel".split()


def passage(seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + r.choice(["", "s", "ed", "ing"]) for _ in range(n))


def page(seed, middle=""):
    return f"{passage(seed + 1000, 60)} {middle} {passage(seed + 2000, 60)}"


def found(spark, pages, items):
    docs = spark.createDataFrame([(i, t, b, "x") for i, (t, b) in enumerate(pages)], "doc_id bigint, text string, line_boxes array<struct<line_no int, x0 int, y0 int, x1 int, y1 int, conf float>>, words string")
    its = spark.createDataFrame(items, "item_id bigint, passage string, seeds string")
    return {(r.doc_id, r.item_id) for r in leaks.leaks(docs, its).collect()}


def test_copies_parts_and_edits(spark):
    p = passage(1)
    w = p.split()
    misread = " ".join(x.replace("e", "c").replace("t", "f") if k % 3 == 0 else x for k, x in enumerate(w))
    inserted = " ".join(w[:15]) + "\nWANTED, a steady lad. Apply within at once.\n" + " ".join(w[15:])
    broken = " ".join(w[:10]) + " " + w[10][:3] + "-\n" + w[10][3:] + " " + " ".join(w[11:])
    pages = [
        page(1, p), page(2, misread), page(3, " ".join(w[5:27])), page(4, " ".join(w[5:13])), page(5), page(6, inserted), page(7, broken), page(8, p.upper().replace(" ", ", ")), p, None, "", " \n ",
    ]
    got = found(spark, [(t, None) for t in pages], [(7, p, "s"), (8, p, "s"), (9, None, "s"), (10, "", "s"), (None, "text", "s")])
    assert got == {(d, i) for d in (0, 1, 2, 5, 6, 7, 8) for i in (7, 8)}


def test_stock_sentences_are_no_cases(spark):
    stock = passage(50, 20)
    items = [(i, f"{stock} {passage(60 + i)}", "s") for i in range(4)]
    assert found(spark, [(page(1, stock), None), (page(2, items[2][1]), None)], items) == {(1, 2)}


def test_a_passage_on_a_third_of_all_pages(spark):
    p = passage(70)
    pages = [(page(k, p if k % 3 == 0 else ""), None) for k in range(60)]
    assert found(spark, pages, [(1, p, "s"), (2, passage(71), "s")]) == {(k, 1) for k in range(0, 60, 3)}


@pytest.mark.parametrize("at", [0, 10, 35])
def test_a_part_of_a_passage_on_a_third_of_all_pages(spark, at):
    p = passage(73, 60)
    part = " ".join(p.split()[at : at + 25])
    misread = " ".join(x[:-1] + "z" if k in (6, 18) else x for k, x in enumerate(part.split()))
    pages = [(page(k, [part, "", misread, "", "", ""][k % 6]), None) for k in range(60)] + [(page(60, p), None)]
    assert found(spark, pages, [(1, p, "s"), (2, passage(71), "s")]) == {(k, 1) for k in range(60) if k % 6 in (0, 2)} | {(60, 1)}


def test_columns_are_read_in_order(spark):
    w = passage(80).split()
    left, right = [" ".join(w[i : i + 5]) for i in range(0, 20, 5)], [" ".join(w[i : i + 5]) for i in range(20, 40, 5)]
    mixed = [x for pair in zip(left, right) for x in pair]
    boxes = [(i, 100 + (i % 2) * 600, 50 * (i // 2), 500, 40, 0.9) for i in range(8)]
    joined = "\n".join(f"{a}        {b}" for a, b in zip(left, right))
    assert found(spark, [("\n".join(mixed), boxes), (joined, None)], [(1, " ".join(w), "s")]) == {(0, 1), (1, 1)}


def test_empty_tables(spark):
    assert found(spark, [], [(1, passage(1), "s")]) == set()
    assert found(spark, [(page(1), None)], []) == set()


def test_a_very_long_page(spark):
    p = passage(90)
    assert found(spark, [(passage(91, 30_000) + " " + p + " " + passage(92, 30_000), None)], [(1, p, "s")]) == {(0, 1)}


def test_folding():
    assert fold("Tbe CURIOUS ſhip") == fold("The curious ship")
    assert fold("Straße") == fold("strasse") and fold("é́") == fold("e")
    assert page_words("con=\ncert\xad\n") == fold("concert")
    assert page_words(None) == [] == page_words(" \n")
    assert reading_order("a\r\nb", [1, 1], [2, 1]) == ["a", "b"]


def test_alignment_pairs_like_words_in_order():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a = [VOCAB[i] for i in rng.integers(0, 6, 12)]
        b = [VOCAB[i] for i in rng.integers(0, 6, 30)]
        known, alike = {}, {}
        x, y = leaks.Shapes(a, known), leaks.Shapes(b, known)
        weight = np.ones(12)
        s = leaks.similarity(x, y, alike)
        where = leaks.align(x, weight, y, alike)
        # every word the alignment finds is alike, in order
        at = where[where >= 0]
        assert (np.diff(at) > 0).all() and all(s[i, j] > 0 for i, j in enumerate(where) if j >= 0)


@pytest.mark.parametrize("a,b,n,want", [("abcd", "abcd", 0, True), ("abcd", "abxd", 1, True), ("abcd", "abd", 1, True), ("abcd", "xbxd", 1, False), ("abcdefghi", "bcdefghij", 2, True)])
def test_edits(a, b, n, want):
    assert leaks.edits(a, b, n) is want is (leaks._distance(a, b) <= n)
