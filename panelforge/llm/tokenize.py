"""Encoding a whole corpus with a public byte-level BPE tokenizer.

Corpus-level merge replay. The JVM cuts texts into words; tasks code their words
by a dictionary of a block of documents; the distinct words of the corpus are
gathered by hash, so each is encoded once. There an inverted index from token
pair to word positions applies every merge in rank order, touching only the
neighbours of what it merges. The ids go back to the blocks as one row a word
and block, never one a word and document.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

TOKENIZERS = os.environ.get("PANELFORGE_TOKENIZERS", "/opt/tokenizers")
#: How the vocabulary's authors cut text into words (a fixed value), with Unicode classes switched on for Java.
WORD_PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A block of documents is closed at so many documents or words; a longer text is a block of its own.
BLOCK_DOCS, BLOCK_WORDS = 4_000, 2_000_000
#: Distinct words replayed at once; a partition with more is replayed in several goes, each word still once.
REPLAY_WORDS = 400_000

_CODED = "block long, doc_id long, codes array<int>, words array<string>"
_IDS = "block long, code int, ids array<int>"


class Merges:
    """The tokenizer's file: bytes to first ids, and the rank and result of every merge."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
        self.byte_ids = np.array([vocab[names[b]] for b in range(256)], np.int32)
        self.left, self.right, self.made = [], [], []
        self.rank: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            i, j = vocab[a], vocab[b]
            self.left.append(i)
            self.right.append(j)
            self.made.append(vocab[a + b])
            self.rank.setdefault(i << 32 | j, r)
        order = np.argsort(codes := np.fromiter(self.rank, np.int64, len(self.rank)))
        self.sorted_pairs, self.sorted_ranks = codes[order], np.fromiter(self.rank.values(), np.int64, len(self.rank))[order]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words end to end, and how many each word has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        token = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(token)
        if not n:
            return token, lengths
        word = np.repeat(np.arange(len(words)), lengths)
        joined = np.r_[word[1:] == word[:-1], False]  # position i and i + 1 are of one word
        at = np.flatnonzero(joined)
        pair = token[at].astype(np.int64) << 32 | token[at + 1]
        k = np.minimum(np.searchsorted(self.sorted_pairs, pair), len(self.sorted_pairs) - 1)
        known = self.sorted_pairs[k] == pair
        ranks, at = self.sorted_ranks[k[known]], at[known]
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]]) if len(ranks) else np.zeros(0, int)
        index = {int(r): p.tolist() for r, p in zip(ranks[cuts], np.split(at, cuts[1:]), strict=True)} if len(cuts) else {}
        heap = list(index)
        heapq.heapify(heap)

        tok = token.tolist()
        after = np.where(joined, np.arange(1, n + 1), -1).tolist()
        before = np.r_[-1, np.where(joined[:-1], np.arange(n - 1), -1)].tolist()
        left, right, made, rank = self.left, self.right, self.made, self.rank
        while heap:
            r = heapq.heappop(heap)
            a, b, c = left[r], right[r], made[r]
            places = index.pop(r)
            places.sort()
            for p in places:
                q = after[p]
                if q < 0 or tok[p] != a or tok[q] != b:
                    continue  # an earlier merge took one of the two
                tok[p], tok[q] = c, -1
                nxt = after[p] = after[q]
                if nxt >= 0:
                    before[nxt] = p
                    new = rank.get(c << 32 | tok[nxt])
                    if new is not None:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heapq.heappush(heap, new)
                prev = before[p]
                if prev >= 0:
                    new = rank.get(tok[prev] << 32 | c)
                    if new is not None:
                        if new in index:
                            index[new].append(prev)
                        else:
                            index[new] = [prev]
                            heapq.heappush(heap, new)
        final = np.array(tok, np.int32)
        kept = final >= 0
        return final[kept], np.bincount(word[kept], minlength=len(words))


_loaded: dict[str, Merges] = {}


def load(path: str) -> Merges:
    """The merges of a file, read once a Python worker."""
    if path not in _loaded:
        _loaded[path] = Merges(path)
    return _loaded[path]


def _lists(flat: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(flat, pa.int32()))


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as lists of codes into their block's dictionary, and that dictionary."""
    names = ["block", "doc_id", "codes", "words"]
    part, seen = TaskContext.get().partitionId(), 0
    held, docs, size = [], 0, 0

    def block():
        number = part << 32 | seen
        words = pa.chunked_array([b.column("words") for b in held], pa.list_(pa.string())).combine_chunks()
        words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        coded = words.flatten().dictionary_encode()
        codes = _lists(coded.indices.to_numpy(), pc.list_value_length(words).fill_null(0).to_numpy())
        ids = pa.chunked_array([b.column("doc_id") for b in held]).combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        n = len(ids)
        for i in range(0, n, 500):
            m = min(500, n - i)
            yield pa.RecordBatch.from_arrays([pa.array([number] * m, pa.int64()), ids.slice(i, m), codes.slice(i, m), pa.nulls(m, pa.list_(pa.string()))], names=names)
        d = coded.dictionary
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(d)], pa.int32()), d)], names=names)

    for b in batches:
        for i in range(0, b.num_rows, 256):
            s = b.slice(i, 256)
            held.append(s)
            docs += s.num_rows
            size += pc.sum(pc.list_value_length(s.column("words"))).as_py() or 0
            if docs >= BLOCK_DOCS or size >= BLOCK_WORDS:
                yield from block()
                held, docs, size, seen = [], 0, 0, seen + 1
    if docs:
        yield from block()


def _replayer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, held, rows = load(path), [], 0

        def out():
            t = pa.Table.from_batches(held).combine_chunks()
            words = t.column("word").combine_chunks()
            words = (words.chunk(0) if isinstance(words, pa.ChunkedArray) else words).dictionary_encode()
            ids, lengths = merges.replay([w.encode() for w in words.dictionary.to_pylist()])
            spread, n = _take(ids, lengths, words.indices.to_numpy())
            whole = pa.table({"block": t.column("block"), "code": t.column("code"), "ids": _lists(spread, n)})
            return whole.to_batches(max_chunksize=10_000)

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= REPLAY_WORDS:
                yield from out()
                held, rows = [], 0
        if rows:
            yield from out()

    return run


def _take(flat: np.ndarray, lengths: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists number ``pick`` end to end, and their lengths."""
    n = lengths[pick]
    start = np.r_[0, np.cumsum(lengths)][:-1][pick]
    out = np.cumsum(n)
    total = int(out[-1]) if len(out) else 0
    where = np.arange(total) + np.repeat(start - (out - n), n)
    return flat[where], n


def _decode(left: pa.Table, right: pa.Table) -> pa.Table:
    """``left`` the documents of one block, ``right`` the ids of each of its words."""
    names = ["doc_id", "ids"]
    code = right.column("code").to_numpy()
    ids = right.column("ids").combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    lengths = np.zeros(len(code), np.int64)
    lengths[code] = pc.list_value_length(ids).to_numpy()
    order = np.argsort(code)
    flat, _ = _take(ids.flatten().to_numpy(), pc.list_value_length(ids).to_numpy().astype(np.int64), order)
    docs = left.column("codes").combine_chunks()
    docs = docs.chunk(0) if isinstance(docs, pa.ChunkedArray) else docs
    per_doc = pc.list_value_length(docs).to_numpy()
    spread, n = _take(flat, lengths, docs.flatten().to_numpy())
    ends = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(per_doc)]]
    return pa.table([left.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(spread, pa.int32()))], names=names)


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """(``key``, ids): the token ids of every text, without special tokens.

    Null and empty texts give an empty list; marks of special tokens are
    ordinary text; repeated rows and null keys come out as they came in. An
    empty table gives no rows. Whole texts are encoded, however long. Other
    columns are not carried. ``tokenizer`` must be readable on every executor.
    """
    words = docs.select(F.col(key).cast("long").alias("doc_id"), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD_PATTERN), F.lit(0)).alias("words"))
    coded = materialize(words.mapInArrow(_code, _CODED), "coded")
    dictionary = coded.filter(F.col("words").isNotNull()).select("block", F.posexplode("words").alias("code", "word"))
    ids = dictionary.repartition("word").mapInArrow(_replayer(tokenizer), _IDS)
    pages = coded.filter(F.col("words").isNull()).select("block", "doc_id", "codes")
    out = pages.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_decode, "doc_id long, ids array<int>")
    return out.select(F.col("doc_id").alias(key), "ids")
