"""Problem 6: held-out evaluation texts inside the corpus, by latent semantic retrieval.

0. Texts are cut into tokens once: a table of 32-bit token hashes, which the passes below read.
1. Document frequencies of hashed tokens over the whole corpus give the weights of TF-IDF passages.
2. A randomised SVD of the passage matrix is computed where the passages are: each task adds its part of A'A X to an
   array of fixed size (subspace iteration), the small factorisations happen on the driver. Its right singular vectors
   map any window of tokens to the latent space.
3. The windows of the evaluation texts (a fixed table) are clustered; every window of every document probes the nearest
   clusters and keeps the evaluation windows whose latent cosine reaches a threshold.
4. Candidates are checked on the tokens by the longest common subsequence around the two windows. For paraphrases the
   item's rarest words (the answer check) decide, for leaked passages the longest common run in these surroundings.

For runs, windows of WINDOW tokens start every ``run - WINDOW + 1`` tokens in documents and at every token in items. A
common run of ``run`` tokens then holds a document window that equals an item window; equal windows have equal latent
vectors (cosine 1) and an item window is listed under every cluster within rounding of its nearest, so none is missed.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closura.llm.gather import summed
from closura.plans.staging import Stage

TOKEN = re.compile(r"[a-z0-9]+")
BUCKETS, RANK, EXTRA, PASSAGE, WINDOW, PIECE = 4096, 64, 8, 40, 8, 16384
#: Characters of evaluation texts that are sent to all tasks at once; more are searched for in several passes.
ITEM_CHARS = 16 << 20


@functools.lru_cache(1 << 18)
def _hash(t: str) -> int:
    return xxhash.xxh32_intdigest(t)


def tokens(text: str) -> np.ndarray:
    found = TOKEN.findall(text.lower())
    return np.fromiter((_hash(t) for t in found), np.uint32, len(found))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint32(BUCKETS - 1)).astype(np.int64)


def spread(df: DataFrame, key: str) -> DataFrame:
    """At least one partition a core; files with few row groups would leave most cores idle in the Python stages."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(2 * want, key)


def token_table(df: DataFrame, stage: Stage) -> DataFrame:
    """(id, h) of (id, text): the hashes of each text's tokens, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [tokens(t) for t in b.column("text").to_pylist()]
            flat = np.concatenate(h).view(np.int32) if h else np.zeros(0, np.int32)
            ends = pa.array(np.cumsum([0, *map(len, h)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["id", "h"])

    return stage.put(df.mapInArrow(run, "id long, h array<int>"))


def _texts(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    h = b.column("h")
    flat, ends = h.flatten().to_numpy(zero_copy_only=False).view(np.uint32), h.offsets.to_numpy() - h.offsets[0].as_py()
    for k, i in enumerate(b.column("id").to_pylist()):
        yield i, flat[ends[k] : ends[k + 1]]


@dataclass
class Latent:
    """weight[b]: inverse document frequency; map[b]: weight times the row of the right singular vectors."""

    weight: np.ndarray
    map: np.ndarray

    def windows(self, h: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """Unit latent vectors of the windows, always added in the same order: equal windows give equal bits."""
        b, z = _bucket(h), np.zeros((len(starts), self.map.shape[1]), np.float32)
        for i in range(length):
            z += self.map[b[starts + i]]
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame) -> Latent:
    """Randomised SVD of the TF-IDF matrix of all passages (PASSAGE tokens each, unit length) of (id, h)."""

    def frequencies(b: pa.RecordBatch, total: np.ndarray) -> None:
        for _, h in _texts(b):
            if len(h):
                total[np.unique(_bucket(h))] += 1
                total[BUCKETS] += 1

    df = summed(docs, frequencies, BUCKETS + 1, "i8")
    weight = np.log1p(df[BUCKETS] / (1.0 + df[:BUCKETS])).astype(np.float32)
    width = RANK + EXTRA

    def product(x: np.ndarray):
        def add(b: pa.RecordBatch, total: np.ndarray) -> None:
            y = total.reshape(BUCKETS, width)
            held, n = [], 0
            for _, h in _texts(b):
                for p in range(0, len(h), PASSAGE):
                    held.append(_bucket(h[p : p + PASSAGE]))
                    n += len(held[-1])
                    if n > PIECE:
                        _passages(held, x, y)
                        held, n = [], 0
            if held:
                _passages(held, x, y)

        return add

    def _passages(held: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> None:
        row = np.repeat(np.arange(len(held)), [len(h) for h in held])
        key, tf = np.unique(row * BUCKETS + np.concatenate(held), return_counts=True)
        row, col = key // BUCKETS, key % BUCKETS
        v = tf * weight[col]
        v /= np.maximum(np.sqrt(np.bincount(row, v * v, len(held)))[row], 1e-12)
        v = v.astype(np.float32)[:, None]
        z = np.add.reduceat(v * x[col], np.flatnonzero(np.r_[True, row[1:] != row[:-1]]), axis=0)  # A x
        back = np.argsort(col, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(col[back]) != 0])
        y[col[back][cut]] += np.add.reduceat((v * z[row])[back], cut, axis=0)  # A' (A x)

    x = np.linalg.qr(np.random.default_rng(20260817).standard_normal((BUCKETS, width)))[0].astype(np.float32)
    x = np.linalg.qr(summed(docs, product(x), BUCKETS * width, "f8").reshape(BUCKETS, width))[0]
    y = summed(docs, product(x.astype(np.float32)), BUCKETS * width, "f8").reshape(BUCKETS, width)
    _, w = np.linalg.eigh((x.T @ y + y.T @ x) / 2)
    v = x @ w[:, ::-1][:, :RANK]
    return Latent(weight, (weight[:, None] * v).astype(np.float32))


class Items:
    """The windows of the evaluation texts in latent space, in clusters."""

    def __init__(self, rows: list[tuple[int, str]], latent: Latent, length: int, stride: int):
        item, start, z, self.h = [], [], [], {}
        for i, text in rows:
            h = tokens(text)
            if len(h) < length:
                continue
            self.h[i] = h
            s = np.unique(np.r_[np.arange(0, len(h) - length + 1, stride), len(h) - length])
            item.append(np.full(len(s), i)), start.append(s), z.append(latent.windows(h, s, length))
        self.item, self.start = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (item, start))
        place = np.cumsum([0, *(len(h) for h in self.h.values())])[:-1]
        self.flat = np.concatenate(list(self.h.values())) if self.h else np.zeros(0, np.uint32)
        at = dict(zip(self.h, place.tolist(), strict=True))
        self.place = np.array([at[i] for i in self.item.tolist()], np.int64) + self.start  # of each window in ``flat``
        self.z = np.concatenate(z) if z else np.zeros((0, RANK), np.float32)
        k = max(1, int(len(self.z) ** 0.5))
        rng = np.random.default_rng(7)
        self.center = self.z[rng.choice(len(self.z), k, replace=False)] if len(self.z) else self.z
        for _ in range(8 if len(self.z) else 0):
            near = (self.z @ self.center.T).argmax(1)
            for c in range(k):
                if (own := self.z[near == c]).size:
                    m = own.sum(0)
                    self.center[c] = m / max(np.linalg.norm(m), 1e-12)
        s = self.z @ self.center.T
        listed = s >= s.max(1, keepdims=True, initial=-2) - 1e-3  # every cluster within rounding of the nearest
        self.lists = [np.flatnonzero(listed[:, c]) for c in range(len(self.center))]

    def search(self, z: np.ndarray, least: float, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of z, window): all listed in the ``probes`` nearest clusters of z with a cosine of ``least`` or more."""
        rows, wins = [], []
        s = z @ self.center.T
        probes = min(probes, s.shape[1])
        near = np.argpartition(-s, probes - 1, axis=1)[:, :probes]
        flat = near.ravel()
        order = np.argsort(flat, kind="stable")
        cut = np.searchsorted(flat[order], np.arange(s.shape[1] + 1))
        for c in range(s.shape[1]):
            who = order[cut[c] : cut[c + 1]] // probes
            if len(who) and len(self.lists[c]):
                r, w = np.nonzero(z[who] @ self.z[self.lists[c]].T >= least)
                rows.append(who[r]), wins.append(self.lists[c][w])
        return (np.concatenate(rows), np.concatenate(wins)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def common_run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common run."""
    same = (a[:, None] == b[None, :]).astype(np.int32)
    best = row = np.zeros(len(b) + 1, np.int32)
    for x in same:
        row = np.r_[0, (row[:-1] + 1) * x].astype(np.int32)
        best = np.maximum(best, row)
    return int(best.max())


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for y in b.tolist():
        u = s & at.get(y, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def _inputs(documents: DataFrame, items: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The token table of the documents, and the items in parts whose texts have at most ITEM_CHARS characters or so."""
    docs = documents.select(F.col("doc_id").alias("id"), "text").where("id is not null and text is not null")
    held = items.select(F.col("item_id").alias("id"), "text").where("id is not null and text is not null").distinct()
    chars = held.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = -(-chars // ITEM_CHARS)
    parts = [held] if n <= 1 else [held.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k) for k in range(n)]
    return token_table(spread(docs, "id"), Stage(documents.sparkSession, "leakage")), parts


def _rows(part: DataFrame) -> list[tuple[int, str]]:
    return [(r["id"], r["text"]) for r in part.collect()]  # bounded by ITEM_CHARS


def leaked_items(documents: DataFrame, items: DataFrame, run: int = 12) -> DataFrame:
    """(doc_id, item_id): documents that share ``run`` or more consecutive tokens with an evaluation text.

    Tokens are the maximal runs of [a-z0-9] of the lower-cased text. Null, blank and shorter texts have no cases; rows
    are distinct, whatever is repeated in either table; texts are read whole; empty tables give no rows.
    """
    docs, parts = _inputs(documents, items)
    latent = fit(docs)
    stride = run - WINDOW + 1

    def piece(lat: Latent, it: Items, ids: list[int], texts: list[np.ndarray], out: set[tuple[int, int]]) -> None:
        """Search the windows of several documents at once."""
        h, ends = np.concatenate(texts), np.cumsum([len(x) for x in texts])
        begins = ends - [len(x) for x in texts]
        starts = np.concatenate([np.arange(lo, hi - WINDOW + 1, stride) for lo, hi in zip(begins, ends, strict=True)])
        for p in range(0, len(starts), PIECE):
            at = starts[p : p + PIECE]
            r, w = it.search(lat.windows(h, at, WINDOW), 0.98, 2)
            d = np.searchsorted(ends, at[r], side="right")
            for x, k, y in zip((at[r] - begins[d]).tolist(), d.tolist(), w.tolist(), strict=True):
                key = ids[k], int(it.item[y])
                if key not in out:
                    mine, theirs = (v[max(0, s - run) : s + WINDOW + run] for v, s in ((texts[k], x), (it.h[key[1]], int(it.start[y]))))
                    if common_subsequence(mine, theirs) >= run and common_run(mine, theirs) >= run:
                        out.add(key)

    def finder(held):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lat, it = held.value
            for b in batches:
                out: set[tuple[int, int]] = set()
                ids, texts, n = [], [], 0
                for i, h in _texts(b) if len(it.z) else ():
                    if len(h) >= run:
                        ids.append(i), texts.append(h)
                        n += len(h)
                    if n > 4 * PIECE:
                        piece(lat, it, ids, texts, out)
                        ids, texts, n = [], [], 0
                if ids:
                    piece(lat, it, ids, texts, out)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["doc_id", "item_id"])

        return find

    found = None
    for part in parts:
        held = docs.sparkSession.sparkContext.broadcast((latent, Items(_rows(part), latent, WINDOW, 1)))  # 4096 rows of the map, and a part of the items
        got = docs.mapInArrow(finder(held), "doc_id long, item_id long")
        found = got if found is None else found.union(got)
    return found.distinct()


def paraphrased_items(documents: DataFrame, items: DataFrame, length: int = 48, cosine: float = 0.8, share: float = 0.6, answers: int = 4) -> DataFrame:
    """(doc_id, item_id, share): documents with a passage that follows a passage of an item without repeating it whole.

    Passages of ``length`` tokens with a latent cosine of ``cosine`` are candidates. Kept are those whose longest common
    subsequence covers ``share`` of the item's passage and that hold at least half of its ``answers`` rarest words.
    ``share`` is the largest over the passages. All clusters are probed, so no pair of passages with that cosine is missed.
    Nulls, short and repeated texts: as in ``leaked_items``.
    """
    docs, parts = _inputs(documents, items)
    latent = fit(docs)

    def find(held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat, it = held.value
        rare = [h[np.argsort(-lat.weight[_bucket(h)], kind="stable")][:answers] for h in (it.h[int(i)][s : s + length] for i, s in zip(it.item, it.start, strict=True))]
        for b in batches:
            best: dict[tuple[int, int], float] = {}
            for i, h in _texts(b):
                if len(h) < length or not len(it.z):
                    continue
                starts = np.unique(np.r_[np.arange(0, len(h) - length + 1, length // 4), len(h) - length])
                for q in range(0, len(starts), 1024):
                    at = starts[q : q + 1024]
                    r, w = it.search(lat.windows(h, at, length), cosine, len(it.center))
                    for x, y in zip(r, w, strict=True):
                        item, mine = int(it.item[y]), h[at[x] : at[x] + length]
                        if np.isin(rare[y], mine).sum() * 2 >= len(rare[y]):
                            got = common_subsequence(it.h[item][it.start[y] : it.start[y] + length], mine) / length
                            if got >= max(share, best.get((i, item), 0.0)):
                                best[i, item] = got
            k = list(best)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in k], pa.int64()), pa.array([x[1] for x in k], pa.int64()), pa.array([best[x] for x in k], pa.float64())], names=["doc_id", "item_id", "share"])

    found = None
    for part in parts:
        held = docs.sparkSession.sparkContext.broadcast((latent, Items(_rows(part), latent, length, length // 4)))
        got = docs.mapInArrow(functools.partial(find, held), "doc_id long, item_id long, share double")
        found = got if found is None else found.union(got)
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
