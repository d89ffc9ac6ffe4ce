"""Statistics of each page's text, and the pages that are no running prose.

The statistics of every page are ranked exactly inside its language and inside
the corpus (range-partitioned sort with partition offsets), among the reference
pages: those whose words read as running words beyond doubt, each different one
once. The empirical tail probabilities of a page's statistics among these
combine into its outlier score, which decides. As neither pages that are no
prose nor copies are part of the reference, a score does not shrink when pages
of a kind get common.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import exact_ranks
from ..session import materialize
from .reading import fold

#: What parts words, as Unicode has it (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_LINES = re.compile("\r\n|[\n\r]")
_WORDS = re.compile(f"[^{SPACE}]+")
_SYMBOL = re.compile(f"[^\\w{SPACE}]|_")
_DIGIT = re.compile("[0-9]")
_END = re.compile(f"[.!?;:,][\"'\u201d\u201c\u00bb)]*[{SPACE}]*$")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_OPENING = "\"'(\u00ab\u201c\u201e"

#: Statistics that plain SQL has as well, and the tail that tells an outlier: left, right or both.
PLAIN_TAILS = {"n_words": "left", "mean_word_length": "both", "symbol_ratio": "both", "line_end_share": "both", "common_share": "left"}
#: Statistics that tell prose from the rest, also where letters are misread.
PROSE_TAILS = {"readable_share": "left", "line_end_share": "both", "flow_share": "both"}
#: Folded words shorter than this are too easily met by chance.
FOLDED_LENGTH = 3
#: At least this share of the words of a reference page reads as common ones, misread letters folded.
SURE_SHARE = 0.25
#: Reference pages a language needs for ranks of its own; else those in the corpus stand for them.
LEAST_REFERENCE = 30
#: A score is the sum of the tails' logarithms in units of that of a value beyond the whole reference. From NEAR statistics' worth on
#: a page is nominated, from FAR on it is out; in between its own words are looked at.
NEAR, FAR = 1.75, 2.25
#: A page near the cut is prose if at least these shares of its words read as common ones: misread letters folded, and as they stand.
PROSE_SHARE, PLAIN_SHARE = 0.12, 0.03

_OUT = "doc_id long, lang string, n_words long, mean_word_length double, symbol_ratio double, line_end_share double, common_share double, digit_share double, read_share double, foreign_share double, flow_share double"


def page_stats(text: str | None, common: frozenset[str], folded: frozenset[str], known: dict[str, tuple[int, int, int, int]]) -> tuple | None:
    """The statistics of one text; None if it is null, empty or blank.

    n_words counts stretches without white space, mean_word_length their
    characters; symbol_ratio is the share of characters other than white space
    that are neither letters nor digits; line_end_share the share of lines that
    aren't blank that end in punctuation; common_share the share of words that
    are common words of any language, edges other than letters cut off.
    digit_share is the share of words with a digit; read_share that of words
    that are common words when misread letters are folded together;
    foreign_share that of words of letters beyond Latin; flow_share that of
    pairs of neighbouring words neither of which begins with a capital, a figure
    or a mark (opening marks aside).
    """
    if not text:
        return None
    words = _WORDS.findall(text)
    n = len(words)
    if not n:
        return None
    chars = sum(map(len, words))
    hits = digits = read = foreign = flow = 0
    flows = False
    for w in words:
        k = known.get(w)
        if k is None:
            bare = _EDGE.sub("", w.lower())
            f = fold(bare)
            is_common = bare in common
            k = known[w] = (
                is_common,
                _DIGIT.search(w) is not None,
                (is_common and len(bare) > 1) or (len(f) == 1 and len(f[0]) >= FOLDED_LENGTH and f[0] in folded),
                bool(bare) and bare[0].isalpha() and ord(bare[0]) > 0x24F,
                (first := w.lstrip(_OPENING)[:1]).isalpha() and not first.isupper(),
            )
        hits += k[0]
        digits += k[1]
        read += k[2]
        foreign += k[3]
        flow += flows and k[4]
        flows = k[4]
    lines = [x for x in _LINES.split(text) if _WORDS.search(x)]
    ends = sum(_END.search(x) is not None for x in lines)
    return n, chars / n, len(_SYMBOL.findall(text)) / chars, ends / len(lines), hits / n, digits / n, read / n, foreign / n, flow / max(1, n - 1)


def _reader(common: frozenset[str]):
    folded = frozenset(f for w in common for f in fold(w) if len(f) >= FOLDED_LENGTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                rows.append(page_stats(text, common, folded, known) or (0, *[None] * 8))
                if len(known) > 500_000:
                    known.clear()
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(cols[0], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[1:]]], names=[x.split()[0] for x in _OUT.split(", ")])

    return run


def statistics(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """One row per document: its statistics, null (n_words 0) where there is no word.

    ``common_words`` (word) is a fixed list of frequent words, broadcast. Whole
    texts are read, however long; repeated rows stay.
    """
    common = frozenset(r[0].lower() for r in common_words.filter(F.col("word").isNotNull()).select("word").distinct().collect())
    return docs.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(_reader(common), _OUT)


def outlier_scores(stats: DataFrame, group: str, tails: dict[str, str], reference: Column) -> DataFrame:
    """``stats`` with ``score``: how far each row lies outside the reference rows, in its group and among all.

    :param tails: statistics, and whether the ``left`` tail, the ``right`` one
        or the smaller of ``both`` counts.
    :param reference: the rows to rank among. Rows that agree in group and all
        statistics are copies, and count once.

    Of n reference rows a tail holds (those at least as far out + 1) / (n + 1).
    The score is the sum of the tails' negative logarithms over the statistics,
    divided by ln(n + 1), so a value beyond all of the reference counts 1; the
    mean of that in the row's group and in all rows, or the latter alone where
    the group has fewer than LEAST_REFERENCE reference rows. It is null for a
    row that lacks a statistic and where there is no reference at all. Every row
    comes out as often as it came in.
    """
    columns = list(tails)
    own = stats.withColumns({"_row": F.monotonically_increasing_id(), "_ref": F.coalesce(reference, F.lit(False)), "_same": F.xxhash64(F.lower(group), *columns)})
    rows = materialize(own, "page-stats")  # numbered once and for all
    dims = F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("v")) for c in columns])
    groups = F.array(F.concat(F.lit("="), F.coalesce(F.lower(F.col(group)), F.lit(""))), F.lit("*"))
    long = rows.dropna(subset=columns).select("_row", "_ref", "_same", F.explode(groups).alias("grp"), dims.alias("d")).select("_row", "_ref", "_same", "grp", F.inline("d"))
    ranked = exact_ranks(long.withColumn("g", F.concat_ws("|", "stat", "grp")), "g", "v", "_row", "_ref", "_same")
    all_of = F.col("size") + 1
    left, right = -F.ln((F.col("upto") + 1) / all_of), -F.ln((all_of - F.col("below")) / all_of)
    stat = F.substring_index("g", "|", 1)
    side = {"left": left, "right": right, "both": F.greatest(left, right)}
    tail = F.coalesce(*[F.when(stat.isin([c for c in columns if tails[c] == k]), side[k]) for k in side if k in tails.values()])
    sums = ranked.groupBy("id", (F.substring_index("g", "|", -1) == "*").alias("all")).agg(F.sum(tail).alias("s"), F.max("size").alias("n"))
    unit = F.try_divide(F.col("s"), F.ln(F.col("n") + 1))
    mine = F.max(F.when(~F.col("all") & (F.col("n") >= LEAST_REFERENCE), unit))
    every = F.max(F.when(F.col("all"), unit))
    scores = sums.groupBy(F.col("id").alias("_id")).agg(((F.coalesce(mine, every) + every) / 2).alias("score"))
    return rows.join(scores, F.col("_row") == F.col("_id"), "left").drop("_row", "_ref", "_same", "_id")


def readable() -> Column:
    """Whether a page's own words are those of running sentences: a share of common ones, or letters no list is of."""
    read = (F.col("read_share") >= SURE_SHARE) | ((F.col("read_share") >= PROSE_SHARE) & (F.col("common_share") >= PLAIN_SHARE))
    return (F.col("digit_share") <= 0.5) & (read | (F.col("foreign_share") >= 0.5))


def scored(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """The statistics of every page with words, its outlier score and whether it is prose.

    A page in letters beyond Latin, of which no list tells, counts as read.
    Where the corpus has no reference page at all, a page's own words decide.
    """
    stats = statistics(docs, common_words).filter(F.col("n_words") > 0).withColumn("readable_share", F.col("read_share") + F.col("foreign_share"))
    out = outlier_scores(stats, "lang", PROSE_TAILS, F.col("readable_share") >= SURE_SHARE)
    near = F.coalesce(F.col("score") >= NEAR, F.lit(True)) & ~readable()
    return out.withColumn("prose", ~(F.coalesce(F.col("score") >= FAR, F.lit(False)) | near))


def found(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id) of the pages that are mainly list, table or junk, by their outlier scores.

    Null, empty and blank texts are no cases. A page without an id can't be
    named and is left out.
    """
    return scored(docs, common_words).filter(F.col("doc_id").isNotNull() & ~F.col("prose")).select("doc_id")
