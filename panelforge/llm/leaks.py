"""Passages of evaluation items inside a corpus of scanned pages.

Rare n-grams of the items' passages seed the search: a page that holds enough
of one item's seeds near one diagonal is a candidate, and a Smith-Waterman
alignment of words (equal, or alike in their letter pairs) decides how many
consecutive words of the passage the page holds, over inserted lines and
misread words.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .reading import fold, page_words

#: A seed is so many consecutive folded words of a passage.
SEED_WORDS = 3
#: A seed is rare if at most this share of the pages (or so many pages) holds it, or if it is among this share of its item's
#: seeds that are rarest: an item that stands on very many pages keeps seeds. A part of an item that stands on very many pages makes
#: all its seeds about as frequent, a common phrase with other words in it only some: where this share of the seeds of a stretch just
#: long enough for a case is held by at most NEARLY times as many pages as the rarest of them, these are rare too.
RARE_SHARE, RARE_LEAST, RAREST, NEARLY = 0.0005, 8, 0.4, 5
#: Places of a passage hit near one diagonal, and rare seeds among them, that make a candidate; words around it that are aligned.
MIN_HITS, MIN_SEEDS, BAND, MARGIN = 6, 2, 14, 70
#: Words whose shapes a task remembers.
MOST_KNOWN = 300_000
#: Words of the passage that make a case.
CASE_WORDS = 20
#: Letters of a word that may be misread, and the words of an inserted stretch of other matter.
NOISE, INSERTED, INSERTED_MOST = 0.34, 3, 60
#: A sentence of at least five words that more items than this hold is a stock sentence and left out.
STOCK_ITEMS, STOCK_WORDS = 2, 8
#: What words a few letters apart count, against 1 for equal ones.
ALIKE = 0.8
#: Alignment: what a passage word that is not found costs, of its weight and besides; what an inserted stretch on the page costs, once and a word.
LOST, MISS, OPEN, EXTEND = 0.5, 0.1, -1.5, -0.04
#: Items beyond this many would not be broadcast; they are a fixed set of hundreds.
MAX_ITEMS = 100_000


def passages(items: list[tuple[int, str | None]]) -> dict[int, list[str]]:
    """Folded words of each passage, without the runs of words that more than STOCK_ITEMS different passages share."""
    words = {i: fold(p) for i, p in items if p and i is not None}
    different = {tuple(w) for w in words.values()}
    holders: Counter = Counter()
    for w in different:
        holders.update({w[k : k + STOCK_WORDS] for k in range(len(w) - STOCK_WORDS + 1)})
    out = {}
    for i, w in words.items():
        stock = np.zeros(len(w), bool)
        for k in range(len(w) - STOCK_WORDS + 1):
            if holders[tuple(w[k : k + STOCK_WORDS])] > STOCK_ITEMS:
                stock[k : k + STOCK_WORDS] = True
        out[i] = [x for x, s in zip(w, stock, strict=True) if not s]
    return {i: w for i, w in out.items() if w}


def seeds(texts: dict[int, list[str]]) -> dict[tuple, list[tuple[int, int]]]:
    """Each n-gram of the passages and where it stands: (item, position)."""
    out = defaultdict(list)
    for i, w in texts.items():
        n = min(SEED_WORDS, len(w))
        for k in range(len(w) - n + 1):
            out[tuple(w[k : k + n])].append((i, k))
    return dict(out)


class Shapes:
    """Words as numbers: a code equal for equal words, their length, and their letter pairs as bits of two integers."""

    def __init__(self, words: list[str], known: dict):
        shapes = []
        for w in words:
            m = known.get(w)
            if m is None:
                bits, p = 0, f" {w} "
                for x, y in zip(p, p[1:], strict=False):
                    bits |= 1 << ((ord(x) * 31 + ord(y) * 7) % 127)
                m = known[w] = (len(known), len(w), bits & (2**64 - 1), bits >> 64, bits.bit_count())
            shapes.append(m)
        cols = list(zip(*shapes, strict=True)) if shapes else [[]] * 5
        self.words = words
        self.code, self.length, self.pairs = (np.array(cols[i], np.int64) for i in (0, 1, 4))
        self.lo, self.hi = np.array(cols[2], np.uint64), np.array(cols[3], np.uint64)

    def part(self, a: int, z: int) -> Shapes:
        out = object.__new__(Shapes)
        out.words = self.words[a:z]
        out.code, out.length, out.pairs, out.lo, out.hi = (x[a:z] for x in (self.code, self.length, self.pairs, self.lo, self.hi))
        return out


def edits(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` letters were changed, lost or added between two words."""
    if abs(len(a) - len(b)) > most:
        return False
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b) <= most
    return most > 0 and (edits(a[1:], b[1:], most - 1) or edits(a[1:], b, most - 1) or edits(a, b[1:], most - 1))


def similarity(a: Shapes, b: Shapes, alike: dict) -> np.ndarray:
    """Of each word of ``a`` with each of ``b``: 1 if equal, ALIKE if a few letters apart, else 0.

    Words of four letters may be one edit apart, of nine two. Shared letter
    pairs, counted for all pairs of words at once, leave few to compare.
    """
    out = (a.code[:, None] == b.code[None]).astype(np.float64)
    i, j = np.flatnonzero(a.length >= 4), np.flatnonzero(b.length >= 4)
    if len(i) and len(j):
        common = np.bitwise_count(a.lo[i][:, None] & b.lo[j][None]) + np.bitwise_count(a.hi[i][:, None] & b.hi[j][None])
        most = np.where((a.length[i] >= 9)[:, None] & (b.length[j] >= 9)[None], np.int8(4), np.int8(2))  # an edit spoils two letter pairs
        near = np.maximum(a.pairs[i].astype(np.int8)[:, None], b.pairs[j].astype(np.int8)[None]) - common.astype(np.int8) <= most
        for x, y in zip(*(k.tolist() for k in np.nonzero(near)), strict=True):
            x, y = int(i[x]), int(j[y])
            if out[x, y] == 0:
                v, w = a.words[x], b.words[y]
                same = alike.get((v, w))
                if same is None:
                    same = alike[(v, w)] = edits(v, w, 2 if min(len(v), len(w)) >= 9 else 1)
                if same:
                    out[x, y] = ALIKE
    return out


def word_weights(texts: dict[int, list[str]]) -> dict[str, float]:
    """How much a word tells: the logarithm of how few of the different passages hold it. Words of every sentence weigh next to nothing."""
    different = {tuple(w) for w in texts.values()}
    holders = Counter(x for w in different for x in set(w))
    return {x: max(0.05, float(np.log((1 + len(different)) / n))) for x, n in holders.items()}


def align(passage: Shapes, weight: np.ndarray, page: Shapes, alike: dict) -> np.ndarray:
    """Smith-Waterman: for each word of the passage the matching word's position on the page, or -1."""
    s = similarity(passage, page, alike)
    n, m = s.shape
    lost = -LOST * weight - MISS
    gain = np.where(s > 0, weight[:, None] * s, lost[:, None])
    h = np.zeros((n + 1, m + 1))
    ramp = np.arange(m + 1) * EXTEND
    opened = ramp[1:] + OPEN
    reach, cell = np.empty(m + 1), np.empty(m)
    for above, best, row, loss in zip(h[:-1], h[1:], gain, lost.tolist(), strict=True):
        np.maximum(np.add(above, loss, out=best), 0.0, out=best)
        rest = best[1:]
        np.maximum(rest, np.add(above[:-1], row, out=cell), out=rest)
        # a gap on the page (an inserted line) costs OPEN once and EXTEND a word
        np.maximum.accumulate(np.subtract(best, ramp, out=reach), out=reach)
        np.maximum(rest, np.add(reach[:-1], opened, out=cell), out=rest)
    out = np.full(n, -1)
    i, j = np.unravel_index(np.argmax(h), h.shape)
    while i > 0 and h[i, j] > 0:
        v = h[i, j]
        if j > 0 and abs(v - (h[i - 1, j - 1] + gain[i - 1, j - 1])) < 1e-9:
            if s[i - 1, j - 1] > 0:
                out[i - 1] = j - 1
            i, j = i - 1, j - 1
        elif abs(v - (h[i - 1, j] + lost[i - 1])) < 1e-9:
            i -= 1
        else:
            k = np.flatnonzero(np.abs(h[i, :j] - ramp[:j] + ramp[j] + OPEN - v) < 1e-9)
            if not len(k):
                break
            j = int(k[-1])
    return out


def _distance(a: str, b: str) -> int:
    """Letters to change, lose or add between two words."""
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    if not a or not b:
        return len(a) + len(b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _misread(lost: list[str], there: list[str]) -> bool:
    """Whether words of the passage may be these words of the page: misread, run together or torn apart, or dropped if very short."""
    a, b = "".join(lost), "".join(there)
    if len(lost) > 3 or len(there) > 5 or abs(len(a) - len(b)) > max(2, NOISE * len(a)):
        return False
    most = max(2 if not b or len(a) < 4 else 1, NOISE * len(a))
    return max(len(a), len(b)) <= most or _distance(a, b) <= most


def held_words(where: np.ndarray, passage: list[str], page: list[str]) -> int:
    """The longest stretch of consecutive passage words that all stand on the page one after another.

    Words in between may be misread; whole inserted lines may part it, also
    within a broken word. A word replaced by another one ends the stretch. The
    word next to either end counts if the page has it misread in its place.
    """
    found = np.flatnonzero(where >= 0).tolist()
    best = 0
    start = piece = None
    for n, k in enumerate(found):
        go_on = False
        if n:
            prev = found[n - 1]
            lost, there = passage[prev + 1 : k], page[where[prev] + 1 : where[k]]
            if not there and not lost:
                go_on = True
            elif len(there) >= INSERTED and len(lost) <= 1:
                broken = not lost or (there[0][:2] == lost[0][:2] or there[-1][-2:] == lost[0][-2:])
                go_on = broken and len(there) <= INSERTED_MOST and prev - piece + 1 >= INSERTED
                if go_on:
                    piece = k
            else:
                go_on = _misread(lost, there) if lost else len("".join(there)) <= 3
        if not go_on:
            start = piece = k
        size = k - start + 1
        left, right = where[start] - 1, where[k] + 1
        size += start > 0 and left >= 0 and _misread([passage[start - 1]], [page[left]])
        size += k + 1 < len(passage) and right < len(page) and _misread([passage[k + 1]], [page[right]])
        best = max(best, size)
    return best


def needed(passage: list[str]) -> int:
    return min(CASE_WORDS, len(passage))


class Search:
    """What a task needs: passages, and where each seed stands."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.words = passages(items)
        self.seeds = seeds(self.words)
        weights = word_weights(self.words)
        self.weight = {i: np.array([weights[x] for x in w]) for i, w in self.words.items()}
        self.sizes = {len(g) for g in self.seeds}
        self.numbers = {g: n for n, g in enumerate(sorted(self.seeds))}
        self.known: dict[str, tuple] = {}
        self.alike: dict[tuple[str, str], bool] = {}
        self.shape = {i: Shapes(w, self.known) for i, w in self.words.items()}
        self.passage_words = len(self.known)

    def forget(self) -> None:
        """Keep the words of the passages only, once there are very many others."""
        if len(self.known) > MOST_KNOWN:
            self.known = dict(list(self.known.items())[: self.passage_words])

    def hits(self, page: list[str]) -> list[tuple[int, int]]:
        """Seed number and position of every seed on a page."""
        found, numbers = [], self.numbers
        for size in self.sizes:
            grams = zip(*[page[k:] for k in range(size)], strict=False)
            found += [(n, p) for p, g in enumerate(grams) if (n := numbers.get(g)) is not None]
        return found

    def frequent(self, pages: dict[int, int], limit: int) -> set[int]:
        """Numbers of the seeds that are not rare, from how many pages hold each."""
        keep = {n for n in range(len(self.numbers)) if pages.get(n, 0) <= limit}
        for w in self.words.values():
            size = min(SEED_WORDS, len(w))
            numbers = [self.numbers[tuple(w[k : k + size])] for k in range(len(w) - size + 1)]
            keep.update(sorted(numbers, key=lambda n: (pages.get(n, 0), n))[: max(MIN_SEEDS, int(RAREST * len(numbers)))])
            stretch = max(1, needed(w) - size + 1)
            for k in range(len(numbers) - stretch + 1):
                part = numbers[k : k + stretch]
                most = NEARLY * min(pages.get(n, 0) for n in part)
                even = [n for n in part if pages.get(n, 0) <= most]
                if len(even) >= RAREST * len(part):
                    keep.update(even)
        return set(range(len(self.numbers))) - keep

    def candidates(self, hits: list[tuple[int, int]], rare: np.ndarray, by_number: list[tuple]) -> dict[int, list[list[int]]]:
        """Items, and the stretches of the page near whose diagonal MIN_HITS places of the passage, MIN_SEEDS of them rare, are hit."""
        near = defaultdict(list)
        for n, p in hits:
            if rare[n]:
                for item, at in self.seeds[by_number[n]]:
                    near[item].append(p - at)
        points = {}
        for item, diagonals in near.items():
            diagonals.sort()
            least = min(MIN_SEEDS, max(1, len(self.words[item]) - SEED_WORDS + 1))
            if any(z - a <= BAND for a, z in zip(diagonals, diagonals[least - 1 :], strict=False)):
                points[item] = []
        if not points:
            return {}
        for n, p in hits:
            for item, at in self.seeds[by_number[n]]:
                if item in points:
                    points[item].append((p - at, at, rare[n]))
        out = {}
        for item, d in points.items():
            size = len(self.words[item])
            need = min(MIN_HITS, max(1, size - SEED_WORDS + 1))
            if len(d) < need:
                continue
            d.sort()
            places, rares, lo, spans = Counter(), 0, 0, []
            for diagonal, at, is_rare in d:
                places[at] += 1
                rares += is_rare
                while diagonal - d[lo][0] > BAND:
                    places[d[lo][1]] -= 1
                    if not places[d[lo][1]]:
                        del places[d[lo][1]]
                    rares -= d[lo][2]
                    lo += 1
                if len(places) >= need and rares >= min(MIN_SEEDS, need):
                    a, z = max(0, d[lo][0] - MARGIN), diagonal + size + MARGIN
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(z, spans[-1][1])
                    else:
                        spans.append([a, z])
            if spans:
                out[item] = spans
        return out

    def held(self, item: int, page: Shapes, spans: list[list[int]]) -> int:
        """Consecutive words of the item's passage that stand in one of the stretches."""
        best, w = 0, self.words[item]
        for a, z in spans:
            part = page.part(a, z)
            if len(self.alike) > 1_000_000:
                self.alike.clear()
            best = max(best, held_words(align(self.shape[item], self.weight[item], part, self.alike), w, part.words))
        return best


def _reader(items: list[tuple[int, str | None]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items)
        for b in batches:
            ids, words, numbers = [], [], []
            for doc, text, xs, ys in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "xs", "ys")), strict=True):
                page = page_words(text, xs, ys)
                hits = search.hits(page)
                if hits:
                    ids.append(doc)
                    words.append(" ".join(page))
                    numbers.append(sorted({n for n, _ in hits}))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string()), pa.array(numbers, pa.list_(pa.int32()))], names=["doc_id", "words", "seeds"])

    return run


def _aligner(items: list[tuple[int, str | None]], frequent: set[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items)
        by_number = sorted(search.seeds)
        rare = [n not in frequent for n in range(len(by_number))]
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("words").to_pylist(), strict=True):
                words = text.split(" ")
                found = search.candidates(search.hits(words), rare, by_number)
                page = Shapes(words, search.known) if found else None
                done: dict[tuple, int] = {}  # items of one passage are aligned once
                for item, spans in found.items():
                    key = tuple(search.words[item])
                    if key not in done:
                        done[key] = search.held(item, page, spans)
                    out.append((doc, item, done[key], needed(search.words[item])))
                search.forget()
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "held", "needed"])

    return run


def alignments(docs: DataFrame, items: DataFrame, rare_share: float = RARE_SHARE) -> DataFrame:
    """(doc_id, item_id, held, needed) of every candidate: consecutive passage words the page holds, and how many make a case.

    :param docs: (doc_id, text, line_boxes); other columns are ignored.
    :param items: (item_id, passage), a fixed set of evaluation items. They are
        broadcast; more than MAX_ITEMS are refused, not cut.
    :param rare_share: the share of pages up to which a seed is rare. With 1.0
        all seeds are, and every page that hits enough places is aligned.

    Null, empty and blank texts and passages hold nothing. Items of equal
    passages each get their row. Repeated documents are judged one by one. An
    empty table on either side gives no rows. Seed frequencies are counted over
    all pages.
    """
    kept = [(r[0], r[1]) for r in items.select("item_id", "passage").limit(MAX_ITEMS + 1).collect()]
    if len(kept) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} items; search them in parts")
    pages = docs.select(F.col("doc_id").cast("long"), "text", F.col("line_boxes.x0").alias("xs"), F.col("line_boxes.y0").alias("ys"))
    read = materialize(pages.filter(F.length(F.trim("text")) > 0).mapInArrow(_reader(kept), "doc_id long, words string, seeds array<int>"), "pages")
    # one row a seed of the fixed items, so at most items x passage length
    pages_with = {r[0]: r[1] for r in read.select(F.explode("seeds").alias("seed")).groupBy("seed").count().collect()}
    frequent = Search(kept).frequent(pages_with, max(RARE_LEAST, int(rare_share * docs.count())))
    return read.select("doc_id", "words").mapInArrow(_aligner(kept, frequent), "doc_id long, item_id long, held int, needed int")


def leaks(docs: DataFrame, items: DataFrame, rare_share: float = RARE_SHARE) -> DataFrame:
    """(doc_id, item_id) of the pages that hold enough consecutive words of an item's passage."""
    return alignments(docs, items, rare_share).filter(F.col("held") >= F.col("needed")).select("doc_id", "item_id").distinct()
