"""Exact ranks inside groups of any size, without gathering a group in a task.

Values are range-partitioned and sorted by (group, value, key), so a hot group
and even a hot value spread over many partitions. Each partition counts its
groups; the prefix sums of these counts, one row a partition and group, are the
offsets that turn local positions into exact ranks. Equal values that reach over
a partition's edge are mended from the counts at the edges.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

_EDGE = "part int, g string, n array<bigint>, first double, first_once bigint, w_first bigint, n_first array<bigint>, last double, last_once bigint, n_last array<bigint>, s1 double, s2 double, s3 double"
_RANKED = "g string, id bigint, v double, below bigint, upto bigint, size bigint, skew double"
_AMONG = "g string, id bigint, mask bigint, below array<bigint>, upto array<bigint>, size array<bigint>"


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int]]:
    """(group, start, stop) of the stretches of one group in a sorted batch."""
    g = batch.column("g")
    g = (g.combine_chunks() if isinstance(g, pa.ChunkedArray) else g).dictionary_encode()
    g = g.chunk(0) if isinstance(g, pa.ChunkedArray) else g
    codes, names = g.indices.to_numpy(), g.dictionary.to_pylist()
    if len(codes):
        cuts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        for a, z in zip(cuts, [*cuts[1:], len(codes)], strict=True):
            yield names[codes[a]], a, z


def _weights(v: np.ndarray, once: np.ndarray, mask: np.ndarray, bits: int, each: bool, before: tuple | None) -> np.ndarray:
    """What each sorted row counts among the rows of each bit: nothing unless its bit is set, nor where it repeats the row before it (unless ``each`` row counts)."""
    w = (mask[:, None] >> np.arange(bits)) & 1
    if not each:
        w[np.r_[before is not None and (v[0], once[0]) == before, (v[1:] == v[:-1]) & (once[1:] == once[:-1])]] = 0
    return w


def _columns(t) -> tuple[np.ndarray, ...]:
    return tuple(t.column(c).to_numpy() for c in ("v", "once", "mask"))


def _summarizer(bits: int, each: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, dict] = {}
        for b in batches:
            every = _columns(b)
            for g, a, z in _pieces(b):
                v, once, mask = (c[a:z] for c in every)
                s = found.get(g)
                w = _weights(v, once, mask, bits, each, (s["last"], s["last_once"]) if s else None)
                if s is None:
                    none = np.zeros(bits, np.int64)
                    s = found[g] = {"n": none, "first": float(v[0]), "first_once": int(once[0]), "w_first": 0 if each else int(mask[0]), "n_first": none, "last": float(v[0]), "last_once": 0, "n_last": none, "s1": 0.0, "s2": 0.0, "s3": 0.0}
                s["n"] = s["n"] + w.sum(axis=0)
                s["n_first"] = s["n_first"] + w[v == s["first"]].sum(axis=0)
                if v[-1] != s["last"]:
                    s["n_last"] = np.zeros(bits, np.int64)
                s["last"], s["last_once"] = float(v[-1]), int(once[-1])
                s["n_last"] = s["n_last"] + w[v == s["last"]].sum(axis=0)
                for k in (1, 2, 3):
                    s[f"s{k}"] += float((w[:, 0] * v**k).sum())
        if found:
            names = [x.split()[0] for x in _EDGE.split(", ")]
            i, f, many = pa.int64(), pa.float64(), pa.list_(pa.int64())
            kinds = [pa.int32(), pa.string(), many, f, i, i, many, f, i, many, f, f, f]
            cols = [[TaskContext.get().partitionId()] * len(found), list(found), *[[s[c] for s in found.values()] for c in names[2:]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def offsets(edges: list[dict], each: bool = True) -> dict[tuple[int, str], tuple]:
    """Of each (partition, group): what counts before it, ties of its first value before it, ties of its last after it, the group's count (arrays, a cell a bit), its skewness, and whether its first row repeats the last before it."""
    out = {}
    groups = defaultdict(list)
    for e in sorted(edges, key=lambda e: (e["g"], e["part"])):
        groups[e["g"]].append(e | {c: np.array(e[c], np.int64) for c in ("n", "n_first", "n_last")})
    for g, es in groups.items():
        bits = np.arange(len(es[0]["n"]))
        none = np.zeros(len(bits), np.int64)
        repeats = [False]
        for a, b in zip(es, es[1:], strict=False):
            again = not each and (a["last"], a["last_once"]) == (b["first"], b["first_once"])
            repeats.append(again)
            if again:  # counted already
                w = (b["w_first"] >> bits) & 1
                b["n"], b["n_first"], b["n_last"] = b["n"] - w, b["n_first"] - w, b["n_last"] - w * (b["first"] == b["last"])
                for k in (1, 2, 3):
                    b[f"s{k}"] -= w[0] * b["first"] ** k
        n = sum(e["n"] for e in es)
        m1, m2, m3 = (sum(e[f"s{k}"] for e in es) / max(int(n[0]), 1) for k in (1, 2, 3))
        var = m2 - m1 * m1
        skew = (m3 - 3 * m1 * m2 + 2 * m1**3) / var**1.5 if var > 1e-12 * max(m2, 1e-300) else 0.0
        before, earlier, run, value = none, [], none, None
        for e in es:
            earlier.append((before, run if e["first"] == value else none))
            before = before + e["n"]
            run = e["n_last"] + (earlier[-1][1] if e["first"] == e["last"] else 0)  # of the last value up to here
            value = e["last"]
        run, value = none, None
        for e, again, (start, ties) in zip(reversed(es), reversed(repeats), reversed(earlier), strict=True):
            later = run if e["last"] == value else none
            out[(e["part"], g)] = (start, ties, later, n, skew, again)
            run = e["n_first"] + (later if e["first"] == e["last"] else 0)
            value = e["first"]
    return out


def _ranker(known: dict, bits: int, each: bool, among: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()  # one range of the sorted rows, bounded by the partitioning
        every = _columns(t)
        below, upto, size = (np.zeros((t.num_rows, bits), np.int64) for _ in range(3))
        skew = np.zeros(t.num_rows)
        for g, a, z in _pieces(t):
            start, earlier, later, n, s, again = known[(part, g)]
            x, once, mask = (c[a:z] for c in every)
            w = _weights(x, once, mask, bits, each, (x[0], once[0]) if again else None)
            so_far = np.vstack([np.zeros(bits, np.int64), np.cumsum(w, axis=0)])
            below[a:z] = start + so_far[np.searchsorted(x, x, side="left")] - np.where((x == x[0])[:, None], earlier, 0)
            upto[a:z] = start + so_far[np.searchsorted(x, x, side="right")] + np.where((x == x[-1])[:, None], later, 0)
            size[a:z], skew[a:z] = n, s
        if among:
            ends = pa.array(np.arange(t.num_rows + 1, dtype=np.int32) * bits)
            ranks = {k: pa.ListArray.from_arrays(ends, pa.array(c.reshape(-1))) for k, c in (("below", below), ("upto", upto), ("size", size))}
            out = pa.table({"g": t.column("g"), "id": t.column("id"), "mask": t.column("mask")} | ranks)
        else:
            out = pa.table({"g": t.column("g"), "id": t.column("id"), "v": t.column("v"), "below": below[:, 0], "upto": upto[:, 0], "size": size[:, 0], "skew": skew})
        yield from out.to_batches(max_chunksize=20_000)

    return run


def _ranked(values: DataFrame, group: str, value: str, key: str, mask: Column, once: str | None, bits: int, among: bool) -> DataFrame:
    shared_dir(values.sparkSession)
    flat = values.select(
        F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g"), F.col(value).cast("double").alias("v"),
        (F.lit(0) if once is None else F.coalesce(F.col(once), F.lit(0))).cast("long").alias("once"), F.col(key).cast("long").alias("id"), mask.cast("long").alias("mask"),
    )
    order = ["g", "v", "once", "id"]
    placed = flat.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    known = offsets([r.asDict() for r in placed.mapInArrow(_summarizer(bits, once is None), _EDGE).collect()], once is None)
    return placed.mapInArrow(_ranker(known, bits, once is None, among), _AMONG if among else _RANKED)


def exact_ranks(values: DataFrame, group: str, value: str, key: str, counted: str | None = None, once: str | None = None) -> DataFrame:
    """(g, id, v, below, upto, size, skew): of each row how many of its group are smaller, how many not greater, and all; and the group's skewness.

    :param values: ``group`` (text), ``value`` (a number, neither null nor NaN)
        and ``key`` (a long that spreads equal values over partitions).
    :param counted: a boolean column; every row is ranked, but only among the
        rows where it holds (null is false). All by default.
    :param once: a long; of rows of one group that agree in it and in the value
        (and so in ``counted``) only one counts, however many copies there are.

    The sorted rows are checkpointed, which fixes their partitions; the driver
    gets one row a partition and group in it. A null group is the group of the
    empty text. An empty table gives no rows.
    """
    mask = F.lit(1) if counted is None else F.when(F.col(counted), 1).otherwise(0)
    return _ranked(values, group, value, key, mask, once, 1, False)


def exact_ranks_among(values: DataFrame, group: str, value: str, key: str, mask: str, bits: int) -> DataFrame:
    """(g, id, mask, below, upto, size), the latter three arrays: the ranks of each row among the rows of its group that have bit 0, 1, ... of ``mask`` set.

    All of these come from one sort of the group. Else as ``exact_ranks``.
    """
    return _ranked(values, group, value, key, F.col(mask), None, bits, True)
