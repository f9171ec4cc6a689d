"""Problem 1: the k most similar vectors of every vector, by a block matrix join.

Distinct vectors are quantised to int8 and written once, with what the integers miss of each vector. A task owns a block
of about ``block_rows`` rows and meets all other blocks in turn, read from the shared folder: the tile of integer
products gives each cosine with a proven error bound, and only pairs whose upper bound reaches the row's k-th best
similarity so far are computed again from the stored values. A row's best are kept in a heap. The result is exact.

The work is quadratic in the number of distinct vectors, as the task asks for all neighbours of all vectors. Disk is
not: no vector is copied for a tile, so what lies on disk is a few times the rows. Nor is what a task holds: a tile has
2 * block_rows rows whatever the size of the collection, and equal vectors are one row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from closura.plans.staging import Stage

#: Ties are decided on cosines rounded to so many decimals; SLACK covers that rounding and the float32 sums of a tile.
DECIMALS, SLACK, CHUNK = 9, 2e-5, 512
_PACKED = "cid long, single boolean, ids binary, scale float, err float, len float, q binary, v binary"
_LISTS = "cid long, single boolean, nbrs array<long>, sims array<double>"


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, vec): rows whose vector has ``dim`` finite values and a length above 0; of an id's vectors the smallest."""
    v, inf = F.col(vec_col), float("inf")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    rows = df.select(F.col(id_col).alias("id"), v.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") == dim))
    return rows.where(finite & F.exists("vec", lambda x: x != 0)).groupBy("id").agg(F.min("vec").alias("vec"))


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], type=pa.binary())


def _values(column: pa.Array, kind: type) -> np.ndarray:
    """All values of a column of binaries, one after the other, without a copy."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _pack(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            u = _unit(v)
            q = np.rint(u * (127 / np.abs(u).max(1, keepdims=True))).astype(np.int8)
            # the best scale for the integers, what they miss of the vector and their own length, both rounded up
            whole = q.astype(np.float64)
            s = ((u * whole).sum(1) / (whole * whole).sum(1)).astype(np.float32)
            near = s[:, None].astype(np.float64) * whole
            err, length = (np.nextafter(np.linalg.norm(x, axis=1).astype(np.float32), np.float32(9)) for x in (u - near, near))
            ids = pa.array([np.array(x, np.int64).tobytes() for x in b.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("single"), ids, pa.array(s), pa.array(err), pa.array(length), _binary(q), _binary(v)], schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("cid", pa.int64()), ("single", pa.bool_()), ("ids", pa.binary()), ("scale", pa.float32()), ("err", pa.float32()), ("len", pa.float32()), ("q", pa.binary()), ("v", pa.binary())])


class _Rows:
    """Some packed rows inside a task."""

    def __init__(self, t: pa.RecordBatch | pa.Table, dim: int):
        get = lambda name: t.column(name).to_numpy(zero_copy_only=False)
        self.cid, self.err, self.len = get("cid"), get("err"), get("len")
        self.near = _values(t.column("q"), np.int8).reshape(-1, dim).astype(np.float32) * get("scale")[:, None]
        self.v = _values(t.column("v"), np.float32).reshape(-1, dim)
        self.ids = _values(t.column("ids"), np.int64)
        self.n = pa.compute.binary_length(t.column("ids")).to_numpy(zero_copy_only=False) // 8
        self.start = np.cumsum(self.n) - self.n
        self._u = None

    def __len__(self) -> int:
        return len(self.cid)

    @property
    def u(self) -> np.ndarray:
        if self._u is None:
            self._u = _unit(self.v)
        return self._u

    def as_left(self) -> np.ndarray:
        """Times ``as_right`` of other rows: the upper bounds of the cosines less what stands in the last column."""
        return np.column_stack([self.near, self.err, self.len + self.err, np.zeros(len(self), np.float32)])

    def as_right(self) -> np.ndarray:
        return np.ascontiguousarray(np.column_stack([self.near, self.len, self.err, np.full(len(self), -1, np.float32)]).T)


def _exact(a: _Rows, b: _Rows, i: np.ndarray, j: np.ndarray, lo: int, hi: int) -> np.ndarray:
    if len(i) > (hi - lo) * len(b) // 16:  # so many that the whole strip is cheaper; ties may be this dense
        return np.round((a.u[lo:hi] @ b.u.T)[i - lo, j], DECIMALS)
    out = np.empty(len(i))
    for p in range(0, len(i), 65536):
        out[p : p + 65536] = np.einsum("nd,nd->n", a.u[i[p : p + 65536]], b.u[j[p : p + 65536]])
    return np.round(out, DECIMALS)


def _best(row: np.ndarray, nbr: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the k best by (-sim, nbr), sorted by row."""
    order = np.lexsort((nbr, -sim, row))
    row, nbr, sim = row[order], nbr[order], sim[order]
    if not len(row):
        return row, nbr, sim
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    rank = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
    keep = rank < k
    return row[keep], nbr[keep], sim[keep]


class _Block:
    """The rows that a task owns, with the heap of each: its k best (similarity, -id) so far."""

    def __init__(self, rows: _Rows, k: int):
        self.rows, self.k, self.left = rows, k, rows.as_left()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(rows))]
        self.worst, self.last = np.full(len(rows), -9.0), np.full(len(rows), np.iinfo(np.int64).max)

    def meet(self, b: _Rows) -> None:
        """All tiles of the block with the rows ``b``."""
        a, right = self.rows, b.as_right()
        for lo in range(0, len(a), CHUNK):
            hi = min(lo + CHUNK, len(a))
            floor = self.worst[lo:hi]
            if (floor < -1).any() and len(b) >= self.k:  # some heap isn't full: k rows of b have at least the k-th best lower bound
                off = np.outer(a.err[lo:hi], b.len) + np.outer(a.len[lo:hi] + a.err[lo:hi], b.err)
                low = a.near[lo:hi] @ b.near.T - off
                floor = np.maximum(floor, np.partition(low, len(b) - self.k, axis=1)[:, len(b) - self.k] - SLACK)
            self.left[lo:hi, -1] = floor - SLACK
            i, j = np.divmod(np.flatnonzero(self.left[lo:hi] @ right >= 0), len(b))
            if len(i):
                self._take(b, i + lo, j, lo, hi)

    def _take(self, b: _Rows, i: np.ndarray, j: np.ndarray, lo: int, hi: int) -> None:
        sim = _exact(self.rows, b, i, j, lo, hi)
        n = b.n[j]
        if (n > 1).any():  # rows that stand for equal vectors: all their ids
            at = np.repeat(b.start[j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, sim, ids = np.repeat(i, n), np.repeat(sim, n), b.ids[at]
        else:
            ids = b.cid[j]
        better = (sim > self.worst[i]) | ((sim == self.worst[i]) & (ids < self.last[i]))
        for r, x, s in zip(*(c.tolist() for c in _best(i[better], ids[better], sim[better], self.k)), strict=True):
            heap = self.heaps[r]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -x))
            elif (s, -x) > heap[0]:
                heapq.heapreplace(heap, (s, -x))
            else:
                continue
            if len(heap) == self.k:
                self.worst[r], self.last[r] = heap[0][0], -heap[0][1]

    def lists(self, single: pa.Array) -> pa.RecordBatch:
        best = [sorted(h, reverse=True) for h in self.heaps]
        nbrs, sims = pa.array([[-x for _, x in h] for h in best], pa.list_(pa.int64())), pa.array([[s for s, _ in h] for h in best], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(self.rows.cid, pa.int64()), single, nbrs, sims], names=["cid", "single", "nbrs", "sims"])


def _files(base: str) -> tuple[pyarrow.fs.FileSystem, list[str]]:
    """The files of a table in the shared folder. ``base``: its address, with the scheme."""
    if base.startswith("file:"):
        fs, path = pyarrow.fs.LocalFileSystem(), "/" + base[5:].lstrip("/")
    else:
        fs, path = pyarrow.fs.FileSystem.from_uri(base.replace("s3a://", "s3://", 1))
    return fs, sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(path)) if f.base_name.startswith("part-"))


def _sweep(base: str, k: int, dim: int, block_rows: int):
    """Rows (file, first): the lists of the block that begins there, after it has met every block of every file."""

    def batches(fs: pyarrow.fs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:
        with fs.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(block_rows)

    def run(todo: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, files = None, []
        for t in todo:
            for name, first in zip(t.column("file").to_pylist(), t.column("first").to_pylist(), strict=True):
                if fs is None:
                    fs, files = _files(base)
                at = next(n for n, f in enumerate(files) if f.endswith(f"/{name}"))
                with fs.open_input_file(files[at]) as f:
                    own = pq.ParquetFile(f).read().slice(first, block_rows).combine_chunks().to_batches()[0]
                block = _Block(_Rows(own, dim), k)
                for path in files[at:] + files[:at]:
                    for b in batches(fs, path):
                        block.meet(_Rows(b, dim))
                yield block.lists(own.column("single"))

    return run


def similar_vectors(df: DataFrame, id_col: str = "ids", vec_col: str = "embeddings", k: int = 10, dim: int = 64, block_rows: int = 4096) -> DataFrame:
    """(id, nbr, sim, rank): the ``k`` most similar other ids of each id, exact.

    Similarity is the cosine in double precision rounded to 9 decimals; ties go to the smaller id. Rows with a null id,
    or a vector that is null, not of ``dim`` values, not finite or of length 0 take no part; repeated rows count once
    (an id with different vectors keeps the smallest in array order). Fewer than ``k`` other ids give fewer rows; an
    empty table gives none. Other columns are not read. Equal vectors are one row of the matrix; each is represented by
    its k + 1 smallest ids, which is all that a list of k can need.
    """
    stage, top = Stage(df.sparkSession, "vectors", tidy=True), k + 1
    rows = stage.put(usable(df, id_col, vec_col, dim))
    classes = stage.put(rows.groupBy("vec").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("n")))
    members = stage.put(rows.join(classes.where("n > 1").select("vec", "cid"), "vec").select("cid", "id"))  # of equal vectors only
    stage.drop(rows)
    first = Window.partitionBy("cid").orderBy("id")
    heads = members.withColumn("r", F.row_number().over(first)).where(F.col("r") <= top).groupBy("cid").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    single = F.col("n") == 1
    held = classes.join(heads, "cid", "left").select("cid", single.alias("single"), F.coalesce("ids", F.array("cid")).alias("ids"), "vec")
    packed = stage.put(held.mapInArrow(_pack(dim), _PACKED), maxRecordsPerFile=16 * block_rows)
    stage.drop(classes)

    name = F.regexp_extract("_metadata.file_path", "[^/]+$", 0)
    firsts = F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(block_rows))).alias("first")
    blocks, n = stage.counted(packed.groupBy(name.alias("file")).agg(F.count(F.lit(1)).alias("n")).select("file", firsts))
    lists = stage.put(blocks.repartition(max(1, n)).mapInArrow(_sweep(stage.address(packed), top, dim, block_rows), _LISTS))  # a task a block
    stage.drop(blocks)
    stage.drop(packed)

    of_one = lists.where("single").withColumn("id", F.col("cid"))
    of_many = lists.where("not single").join(members, "cid")
    best = of_one.unionByName(of_many).select("id", F.slice(F.filter(F.arrays_zip("nbrs", "sims"), lambda x: x["nbrs"] != F.col("id")), 1, k).alias("best"))
    return best.select("id", F.posexplode("best").alias("p", "x")).select("id", F.col("x.nbrs").alias("nbr"), F.col("x.sims").alias("sim"), (F.col("p") + 1).alias("rank"))


def similar_pairs(df: DataFrame, **kw) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of which at least one is among the k most similar of the other."""
    s = similar_vectors(df, **kw)
    return s.select(F.least("id", "nbr").alias("id_a"), F.greatest("id", "nbr").alias("id_b")).distinct()
