import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import quality as q
from panelforge.llm.reading import fold

COMMON = frozenset("the of and to in a was for by on with as at be were der die und le la et des que".split())
FOLDED = frozenset(f for w in COMMON for f in fold(w) if len(f) >= q.FOLDED_LENGTH)


def stats(text):
    return q.page_stats(text, COMMON, FOLDED, {})


def test_statistics_of_a_text():
    n, mean, symbols, ends, common, digits, read, foreign, flow = stats("The cat, (3) sat.\n\nOn the mat\n")
    assert n == 7 and mean == pytest.approx(22 / 7) and symbols == pytest.approx(4 / 22) and ends == 0.5
    assert common == pytest.approx(3 / 7) and digits == pytest.approx(1 / 7) and foreign == 0 and read == pytest.approx(3 / 7) and flow == pytest.approx(1 / 6)


@pytest.mark.parametrize("text", [None, "", " ", "\n\t   "])
def test_no_words_no_statistics(text):
    assert stats(text) is None


def test_misread_words_are_read():
    assert stats("tbe fhe the")[4] == pytest.approx(1 / 3) and stats("tbe fhe the")[6] == 1.0


PROSE = "The council of the harbour was to be at the market, and the baker was with the captain by the river for a day. "
LIST = "* Oxmarsh, Jessam\n- Tallowby, Orrin\n† Quillane, Ludo\n"
TABLE = "Wool  42.50  7/6  2899\nCoal  24 6  23/6  3109\n"
JUNK = "#=l ¦¬ %~ }[ ;:' <> ■ ■■ /| \n"


def corpus(spark):
    rows = [(i, PROSE * (1 + i % 5), ["en", None, "de"][i % 3]) for i in range(60)]
    rows += [(100 + i, x * 6, ["en", None, "xx"][i % 3]) for i, x in enumerate([LIST, TABLE, JUNK])]
    rows += [(200, None, "en"), (201, "", "en"), (202, "  \n", None), (203, PROSE * 2000, "en"), (100, LIST * 6, "en")]
    return spark.createDataFrame([(*r, 1.0, "z") for r in rows], "doc_id bigint, text string, lang string, score double, g string")


def test_pages_that_are_no_prose(spark):
    words = spark.createDataFrame([("en", w) for w in COMMON] + [(None, None)], "lang string, word string")
    got = sorted(r.doc_id for r in q.found(corpus(spark), words).collect())
    assert set(got) == {100, 101, 102}


def test_scores_equal_brute_force(spark):
    words = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    st = q.statistics(corpus(spark), words).filter("n_words > 0")
    rows = [r.asDict() for r in st.collect()]
    got = q.outlier_scores(st, "lang", q.PLAIN_TAILS, F.col("common_share") >= 0.25).collect()
    assert len(got) == len(rows)

    def score(members, row):
        ref = {tuple(m[c] for c in q.PLAIN_TAILS) + (m["lang"],) for m in members if m["common_share"] >= 0.25}
        total = 0.0
        for i, (c, side) in enumerate(q.PLAIN_TAILS.items()):
            x = np.array([float(m[i]) for m in ref])
            left, right = -np.log(((x <= row[c]).sum() + 1) / (len(x) + 1)), -np.log(((x >= row[c]).sum() + 1) / (len(x) + 1))
            total += {"left": left, "right": right, "both": max(left, right)}[side]
        return len(ref), total / np.log(len(ref) + 1) if ref else None

    for r in got:
        row = r.asDict()
        n, own = score([m for m in rows if m["lang"] == row["lang"]], row)
        every = score(rows, row)[1]
        assert r.score == pytest.approx(((own if n >= q.LEAST_REFERENCE else every) + every) / 2, abs=1e-9)


def test_the_score_alone_parts_prose_from_the_rest(spark):
    words = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    rows = {(r.doc_id, r.score) for r in q.scored(corpus(spark), words).collect()}
    assert min(s for i, s in rows if i in (100, 101, 102)) > max(s for i, s in rows if i not in (100, 101, 102))


def test_no_reference_at_all(spark):
    words = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    docs = spark.createDataFrame([(1, LIST, "en"), (2, TABLE, None)], "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in q.found(docs, words).collect()) == [1, 2]


def test_empty_corpus(spark):
    words = spark.createDataFrame([("en", "the")], "lang string, word string")
    assert q.found(corpus(spark).filter(F.lit(False)), words).count() == 0


@pytest.mark.parametrize("copies", [30, 60])
@pytest.mark.parametrize("text", [LIST, TABLE, JUNK])
def test_a_page_copied_to_a_third_or_half_of_the_corpus(spark, text, copies):
    rows = [(i, PROSE * (1 + i % 5), "en") for i in range(60)] + [(100 + i, text * 4, "en") for i in range(copies)] + [(None, text, "en")]
    words = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in q.found(docs, words).collect()) == list(range(100, 100 + copies))
