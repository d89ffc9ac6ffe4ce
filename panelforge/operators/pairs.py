"""Exact rank correlations of every two columns of a wide table, each taken among the rows that have both.

The rows are written once, with a number each. Values are cut into buckets that
never part equal ones, counted, and sent to their bucket as arrays a block of
rows; a bucket ranks them among the rows of every other column, and the ranks
go back to their block as steps, a plane a set of rows that differs. No task
holds more than a bucket or a block, however large the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Values a bucket is to hold, cells of ranks a block is to hold, steps of the sample that places the bucket bounds, values of it a task sends.
BUCKET, BLOCK_CELLS, STRIDE, SENT = 500_000, 1 << 24, 16, 256
ROW = "_row"

_SEEN = "f int, sample array<double>, n bigint, shared array<bigint>"
_COUNTED = "f int, b int, n array<bigint>"
_SENT = "f int, b int, s bigint, block bigint, at binary, values binary"
_RETURNED = "block bigint, f int, b int, at binary, steps binary, raw bigint"
_SUMS = "i int, j int, n bigint, ij double, ii double, jj double"
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], kind: str) -> pa.Table:
    fields = [x.split() for x in kind.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], _ARROW[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _block_rows(m: int) -> int:
    """Rows of a block, a power of two, so that the ranks of all pairs of ``m`` columns fit and a row's place fits 16 bits."""
    return 1 << min(16, max(6, int(math.log2(BLOCK_CELLS / (m * m)))))


def _values(b: pa.RecordBatch, ids: list[str]) -> np.ndarray:
    return np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ids])


def _masks(have: np.ndarray) -> np.ndarray:
    return (have.astype(np.int64) << np.arange(len(have))[:, None]).sum(axis=0)


def _kinds(mask: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The masks that differ as bits, how often each comes, and which one each row has."""
    kinds, at, n = np.unique(mask, return_inverse=True, return_counts=True)
    return (kinds[:, None] >> np.arange(m)) & 1, n, at


def _seer(ids: list[str]):
    """Of each column some values, and how many rows it shares with each two columns."""
    m = len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picked: list[list[np.ndarray]] = [[] for _ in ids]
        shared = np.zeros((m, m, m), np.int64)
        for b in batches:
            x = _values(b, ids)
            have = ~np.isnan(x)
            bits, n, _ = _kinds(_masks(have), m)
            for f in range(m):
                shared[f] += (bits * (bits[:, f] * n)[:, None]).T @ bits
                picked[f].append(x[f][have[f]][::STRIDE])
        rows = []
        for f in range(m):
            if shared[f, f, f]:
                v = np.sort(np.concatenate(picked[f]))
                rows.append((f, v[np.linspace(0, len(v) - 1, min(SENT, len(v))).round().astype(int)].tolist(), int(shared[f, f, f]), shared[f].ravel().tolist()))
        yield from _batch(rows, _SEEN).to_batches()

    return run


def _bounds(samples: list[tuple[list[float], int]]) -> np.ndarray:
    """Bucket bounds of a column from each task's sample and count: they steer balance, never results."""
    n = sum(k for _, k in samples)
    parts = math.ceil(n / BUCKET)
    if parts < 2:
        return np.zeros(0)
    v = np.concatenate([s for s, _ in samples])
    w = np.concatenate([np.full(len(s), k / len(s)) for s, k in samples])
    order = np.argsort(v)
    at = np.searchsorted(np.cumsum(w[order]), n * np.arange(1, parts) / parts)
    return np.unique(v[order][np.minimum(at, len(v) - 1)])


def _bucket(cuts: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Even between two bounds, odd on a bound, so a bucket of a value that is everywhere holds nothing else."""
    return np.searchsorted(cuts, v, side="left") + np.searchsorted(cuts, v, side="right")


def _counter(ids: list[str], cuts: list[np.ndarray]):
    m = len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((2 * len(c) + 1, m), np.int64) for c in cuts]
        for b in batches:
            x = _values(b, ids)
            have = ~np.isnan(x)
            bits, _, kind = _kinds(_masks(have), m)
            for f in range(m):
                at = _bucket(cuts[f], x[f][have[f]]) * len(bits) + kind[have[f]]
                total[f] += np.bincount(at, minlength=len(total[f]) * len(bits)).reshape(-1, len(bits)) @ bits
        yield from _batch([(f, k, n.tolist()) for f, t in enumerate(total) for k, n in enumerate(t) if n.any()], _COUNTED).to_batches()

    return run


def _blocks(batches: Iterator[pa.RecordBatch], ids: list[str], rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, places, values) of the rows as they come, a block at once where its rows lie together."""
    held, block = [], None
    for b in batches:
        row, x = b.column(ROW).to_numpy(), _values(b, ids)
        of = row // rows
        cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
        for a, z in zip(cuts, [*cuts[1:], len(of)], strict=True):
            if held and of[a] != block:
                yield block, np.concatenate([p for p, _ in held]), np.concatenate([v for _, v in held], axis=1)
                held = []
            block = int(of[a])
            held.append((row[a:z] % rows, x[:, a:z]))
    if held:
        yield block, np.concatenate([p for p, _ in held]), np.concatenate([v for _, v in held], axis=1)


def _sender(ids: list[str], cuts: list[np.ndarray], rows: int, word: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, place, x in _blocks(batches, ids, rows):
            have = ~np.isnan(x)
            mask, place, out = _masks(have).astype(word), place.astype(np.uint16), []
            for f in range(len(ids)):
                at = np.flatnonzero(have[f])
                if not len(at):
                    continue
                at = at[np.argsort(x[f][at], kind="stable")]
                v = x[f][at]
                of = _bucket(cuts[f], v)
                edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                for a, z in zip(edges, [*edges[1:], len(of)], strict=True):
                    # the rows of a bucket of one value need not meet
                    out.append((f, int(of[a]), block if of[a] % 2 else 0, block, place[at[a:z]].tobytes(), _bytewise(v[a:z], mask[at[a:z]])))
            yield from _batch(out, _SENT).to_batches()

    return run


def _bytewise(*columns: np.ndarray) -> bytes:
    """Numbers compressed byte by byte of all: of sorted ones the first bytes are much alike."""
    return pa.compress(b"".join(c.view("u1").reshape(len(c), -1).T.tobytes() for c in columns), codec="zstd", asbytes=True)


def _numbers(packed: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    data, at, out = pa.decompress(packed, n * sum(sizes), codec="zstd", asbytes=True), 0, []
    for k, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(np.frombuffer(data, "u1", n * size, at).reshape(size, n).T).view(k).ravel())
        at += n * size
    return out


def _pack(planes: list[np.ndarray]) -> tuple[bytes, int]:
    """Rising whole numbers as compressed steps, each plane in the fewest bytes a step that hold them."""
    raw = b""
    for p in planes:
        steps = np.diff(p, prepend=0)
        kind = np.min_scalar_type(int(steps.max()))
        raw += bytes([kind.itemsize]) + steps.astype(kind).tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True), len(raw)


def _unpack(packed: bytes, raw: int, n: int) -> list[np.ndarray]:
    data, at, planes = pa.decompress(packed, raw, codec="zstd", asbytes=True), 0, []
    while at < raw:
        size = data[at]
        planes.append(np.cumsum(np.frombuffer(data, f"u{size}", n, at + 1), dtype=np.int64))
        at += 1 + size * n
    return planes


def _planes(shared: np.ndarray) -> list[tuple[list[tuple[int, int | None]], dict[int, int]]]:
    """Of each column f: the planes to be sent beside its own, and which one each other column takes.

    A plane counts the rows that have another column; or, if these are fewer,
    those without it among the rows of a plane before, which all its rows are
    in (the column of that plane is the second number). Columns that f shares
    the same rows with share a plane; those that are wherever f is take its own
    (0); those never there take none.
    """
    out = []
    for f, s in enumerate(shared):
        n, planes, of = np.diag(s), [], {f: 0}
        for j in sorted((j for j in range(len(s)) if j != f and n[j]), key=lambda j: -n[j]):
            same = next((k for k in of if s[j, k] == n[j] == n[k]), None)
            if same is not None:
                of[j] = of[same]
                continue
            least = min((k for k in of if s[j, k] == n[j]), key=lambda k: n[k])
            planes.append((j, least if 2 * n[j] > n[least] else None))
            of[j] = len(planes)
        del of[f]
        out.append((planes, of))
    return out


def _ranker(counts: dict[tuple[int, int], np.ndarray], planes: list, word: str):
    """Of each value of a bucket twice its rank there, less one: the values below it and those not above it, of each plane."""

    def one(t: pa.Table) -> pa.Table:
        f, b = t.column("f")[0].as_py(), t.column("b")[0].as_py()
        places = t.column("at").to_pylist()
        v, mask = map(np.concatenate, zip(*(_numbers(x, len(at) // 2, "f8", word) for x, at in zip(t.column("values").to_pylist(), places, strict=True)), strict=True))
        order = np.argsort(v, kind="stable")
        place = np.empty(len(v), np.int64)
        place[order] = np.arange(len(v))
        v, mask = v[order], mask[order]
        first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        tie = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(v)]))
        edges = np.r_[first, len(v)]
        bit = lambda j: (mask >> np.array(j, word)) & np.array(1, word)
        ranks = []
        for j, among in [(f, None), *planes[f][0]]:
            if b % 2:
                n = counts[f, b]
                ranks.append(np.full(len(v), n[j] if among is None else n[among] - n[j]))
                continue
            so_far = np.r_[0, np.cumsum(bit(j) if among is None else bit(among) - bit(j), dtype=np.int64)][edges]
            ranks.append((so_far[:-1] + so_far[1:])[tie])
        out, a = [], 0
        for block, at in zip(t.column("block").to_pylist(), places, strict=True):
            z = a + len(at) // 2
            out.append((block, f, b, at, *_pack([r[place[a:z]] for r in ranks])))
            a = z
        return _batch(out, _RETURNED)

    return one


def _summer(m: int, rows: int, before: dict[tuple[int, int], np.ndarray], planes: list):
    """Sums of products of centred ranks of each two columns, over the rows of a block that have both."""

    def one(t: pa.Table) -> pa.Table:
        ranks, have = np.zeros((m, m, rows)), np.zeros((m, rows), bool)
        for f, b, at, steps, raw in zip(*(t.column(c).to_pylist() for c in ("f", "b", "at", "steps", "raw")), strict=True):
            at = np.frombuffer(at, np.uint16)
            have[f, at] = True
            own, *rest = _unpack(steps, raw, len(at))
            every, of = [own], planes[f][1] | {f: 0}
            for r, (_, among) in zip(rest, planes[f][0], strict=True):
                every.append(r if among is None else every[of[among]] - r)
            for j, k in planes[f][1].items():
                ranks[f, j, at] = every[k] + before[f, b][j]
        out = []
        for i in range(m):
            for j in range(i + 1, m):
                both = np.flatnonzero(have[i] & have[j])
                if len(both):
                    x, y = ranks[i, j][both], ranks[j, i][both]
                    out.append((i, j, len(both), float(x @ y), float(x @ x), float(y @ y)))
        return _batch(out, _SUMS)

    return one


def placed(wide: DataFrame) -> DataFrame:
    """``wide`` written once, each row with its number, which no later reading can change."""
    return materialize(wide.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def rank_sums(table: DataFrame, ids: list[str]) -> DataFrame:
    """(i, j, n, ij, ii, jj) of each two columns of a ``placed`` table, a row a block: rows that have both, and sums of products of their centred ranks (twice each).

    The driver gets, of each task and column, at most SENT values and the rows
    it shares with each two columns; then one row a bucket. Missing is null or NaN.
    """
    m = len(ids)
    rows, word = _block_rows(m), "u2" if m <= 16 else "u4" if m <= 32 else "u8"
    table = table.select(ROW, *[F.col(c).cast("double").alias(c) for c in ids])
    seen = [r.asDict() for r in table.mapInArrow(_seer(ids), _SEEN).collect()]
    shared = np.zeros((m, m, m), np.int64)
    for r in seen:
        shared[r["f"]] += np.array(r["shared"]).reshape(m, m)
    planes, cuts = _planes(shared), [_bounds([(r["sample"], r["n"]) for r in seen if r["f"] == f]) for f in range(m)]
    counted = table.mapInArrow(_counter(ids, cuts), _COUNTED).groupBy("f", "b").agg(*[F.sum(F.col("n")[j]).alias(f"n{j}") for j in range(m)]).collect()
    counts = {(r["f"], r["b"]): np.array(r[2:], np.int64) for r in counted}
    before, so_far = {}, np.zeros((m, m), np.int64)
    for f, b in sorted(counts):
        before[f, b] = 2 * so_far[f] - np.diag(shared[f])
        so_far[f] += counts[f, b]
    sent = table.mapInArrow(_sender(ids, cuts, rows, word), _SENT)
    returned = sent.groupBy("f", "b", "s").applyInArrow(_ranker({k: n for k, n in counts.items() if k[1] % 2}, planes, word), _RETURNED)
    return returned.groupBy("block").applyInArrow(_summer(m, rows, before, planes), _SUMS)
