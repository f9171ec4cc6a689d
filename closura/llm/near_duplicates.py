"""Problem 4: records whose texts differ by small edits, by PartEnum signatures.

Texts are sets of hashed word shingles. Sets whose sizes can belong to similar texts share a size band; in a band a
Jaccard similarity of ``t`` or more means at most k differing shingles. The shingle domain is hashed into n1 groups of n2
cells. If k < n1 * (k2 + 1), some group has at most k2 differing cells, so two similar sets agree on n2 - k2 whole cells
of a group: one signature for every group and choice of cells finds them.

Before that, sets that can't have a partner are set aside: a shingle that occurs in one set only can't be shared, and a
set that is left with fewer than ``t`` of its shingles has no similar set. A bitmap of fixed size tells such shingles
from the others; ROUNDS passes, each over what the one before left, as every set that goes makes more shingles lonely.

A signature is sent only if its cells hold a shingle that at most RARE sets have (by a count sketch of fixed size over all
sets left), so at most RARE sets meet in one signature, whatever the size of the collection. That could lose a pair only
if both of its sets have too few groups with rare shingles in enough cells; this is checked for each set and band, and
sets that fail it also send their prefix elements (rarest first), which finds all similar pairs among them. So no pair is
lost.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations
from math import ceil, comb, floor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closura.llm.gather import Twice, summed
from closura.plans.staging import Stage

WORD = re.compile(r"[A-Za-z0-9_]+")
#: Cells of the count sketch, the most sets that a rare shingle is in, and the passes that set aside sets without partners.
SKETCH, RARE, ROUNDS = 1 << 20, 64, 2
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(27)) * _M1


@functools.lru_cache(1 << 18)
def _word(w: str) -> int:
    return xxhash.xxh3_64_intdigest(w)


def shingles(text: str, words: int, least: int) -> np.ndarray | None:
    """Sorted distinct hashes of the runs of ``words`` tokens; None for texts with fewer than ``least`` tokens."""
    tokens = WORD.findall(text)
    if len(tokens) < max(least, words):
        return None
    h = np.fromiter((_word(t.lower()) for t in tokens), np.uint64, len(tokens))
    out = np.zeros(len(h) - words + 1, np.uint64)
    for i in range(words):
        out = _mix(out * _M1 + h[i : i + len(out)])
    return np.unique(out)


def _sets(words: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, keys, sets = [], [], [], []
            for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if (s := shingles(text, words, least)) is not None:
                    raw = s.tobytes()
                    ids.append(i), sizes.append(len(s)), sets.append(raw), keys.append(hashlib.blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["id", "n", "key", "s"])

    return run


def _joined(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("s").to_pylist()), np.uint64)


class Scheme:
    """Bands and the (n1, n2, k2) of each, for a similarity threshold."""

    def __init__(self, t: float):
        self.t = Fraction(t).limit_denominator(1000)
        self.gap = (1 - self.t) / (1 + self.t)  # differing / (sum of sizes), at most
        self.bands: list[tuple[int, int]] = []

    def band(self, n: int) -> int:
        while not self.bands or self.bands[-1][1] < n:
            low = self.bands[-1][1] + 1 if self.bands else 1
            self.bands.append((low, max(low, floor(low / self.t))))
        return next(i for i, (_, r) in enumerate(self.bands) if n <= r)

    @functools.lru_cache(None)
    def shape(self, i: int) -> tuple[int, int, int]:
        """The fewest signatures that leave 2.5 shingles or more in a projection, else the most shingles."""
        low, high = self.bands[i]
        k, best = floor(2 * high * self.gap), None
        for k2 in range(6):
            for n2 in range(k2 + 1, k2 + 5):
                need = k // (k2 + 1) + 1
                n1 = need + ceil(need / 4)
                sigs, held = n1 * comb(n2, k2), (low + high) / 2 / n1 * (n2 - k2) / n2
                if sigs <= 160:
                    rank = (min(held, 2.5), -sigs)
                    if best is None or rank > best[0]:
                        best = rank, (n1, n2, k2)
        return best[1] if best else (k + 1 + ceil((k + 1) / 4), 1, 0)

    def most_apart(self, n: int, i: int) -> int:
        """Differing shingles of a set of ``n`` and any similar one that shares band i with it."""
        return floor((n + min(self.bands[i][1], floor(n / self.t))) * self.gap)


def _cells(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SKETCH - 1)).astype(np.int64)


def _signatures(t: float, counts):
    """counts: broadcast array of the sketch's cells."""

    def one(scheme: Scheme, i: int, cids: np.ndarray, sizes: np.ndarray, owner: np.ndarray, h: np.ndarray, rare: np.ndarray):
        n1, n2, k2 = scheme.shape(i)
        cells, m = n1 * n2, len(cids)
        flat = owner * cells + ((h >> np.uint64(20)) % np.uint64(cells)).astype(np.int64)
        sums = np.zeros(m * cells, np.uint64)
        np.add.at(sums, flat, h)
        full = np.bincount(flat[rare], minlength=m * cells).reshape(m, n1, n2) > 0
        sums = sums.reshape(m, n1, n2)
        good = (full.sum(2) > k2).sum(1)
        weak = good * (k2 + 1) <= np.array([scheme.most_apart(int(n), i) for n in sizes])
        out, who = [], []
        for c, chosen in enumerate(combinations(range(n2), n2 - k2)):
            sel = list(chosen)
            salt = np.arange(n1, dtype=np.uint64) * np.uint64(1009) + np.uint64(c * 7919 + i * 104729 + 1)
            sig, has = _mix(sums[:, :, sel].sum(2, dtype=np.uint64) * _M1 + salt[None, :]), full[:, :, sel].any(2)
            r, g = np.nonzero(has)
            out.append(sig[r, g]), who.append(r)
        return np.concatenate(out), np.concatenate(who), weak

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, count = Scheme(t), counts.value
        for b in batches:
            for p in range(0, b.num_rows, 512):
                part = b.slice(p, 512)
                cid, n = part.column("cid").to_numpy(zero_copy_only=False), part.column("n").to_numpy(zero_copy_only=False)
                sets = [np.frombuffer(x, np.uint64) for x in part.column("s").to_pylist()]
                own = np.array([scheme.band(int(x)) for x in n])
                scheme.band(int(n.max(initial=1) / t) + 2)
                weak_at = np.zeros(len(cid), bool)
                for i in np.unique(np.r_[own, own + 1]).tolist():
                    here = np.flatnonzero((own == i) | (own == i - 1))
                    h = np.concatenate([sets[x] for x in here])
                    rare = count[_cells(h)] <= RARE
                    sig, who, weak = one(scheme, i, cid[here], n[here], np.repeat(np.arange(len(here)), n[here]), h, rare)
                    weak_at[here] |= weak
                    yield _rows(sig, cid[here][who], n[here][who])
                for x in np.flatnonzero(weak_at).tolist():
                    s = sets[x]
                    order = np.lexsort((s, count[_cells(s)]))
                    head = s[order[: len(s) - ceil(scheme.t * len(s)) + 1]]
                    yield _rows(_mix(head + np.uint64(3)), np.full(len(head), cid[x]), np.full(len(head), n[x]))

    def _rows(sig: np.ndarray, cid: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(cid, pa.int64()), pa.array(n, pa.int32())], names=["sig", "cid", "n"])

    return run


def _verify(t: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = b.column("sa").to_pylist(), b.column("sb").to_pylist()
            both = np.array([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, c, strict=True)], np.int64)
            total = np.array([(len(x) + len(y)) // 8 for x, y in zip(a, c, strict=True)], np.int64) - both
            keep = both * t.denominator >= total * t.numerator
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask), pa.array(both[keep] / total[keep] if keep.any() else np.array([]), pa.float64())], names=["a", "b", "sim"])

    return run


class NearDuplicates:
    """Classes of equal shingle sets (``members``: cid, id) and the similar pairs of classes (``links``: a, b, sim).

    ``df`` has ``id`` (unique) and ``text``. Null texts and texts with fewer than ``least`` tokens take no part. Texts
    are processed whole. Equal sets are one class, named by its smallest id; links are between different classes only.
    """

    def __init__(self, df: DataFrame, words: int = 5, t: float = 0.8, least: int = 1):
        spark = df.sparkSession
        stage = Stage(spark, "near-duplicates")
        sets = stage.put(df.select("id", "text").where("id is not null and text is not null").mapInArrow(_sets(words, least), "id long, n int, key binary, s binary"))
        first = sets.groupBy("key").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("copies"))
        named = sets.select("id", "key").join(first, "key")
        self.members = stage.put(named.select("cid", "id", "copies"))
        one = stage.put(sets.join(self.members.where("cid = id").select("id"), "id", "left_semi").select(F.col("id").alias("cid"), "n", "s"))
        limit = Fraction(t).limit_denominator(1000)
        for _ in range(ROUNDS):
            before, one = one, stage.put(self._with_partners(one, limit))
            stage.drop(before)

        def count(b: pa.RecordBatch, total: np.ndarray) -> None:
            for p in range(0, b.num_rows, 512):
                total += np.bincount(_cells(_joined(b.slice(p, 512))), minlength=SKETCH).astype(np.uint32)

        counts = spark.sparkContext.broadcast(summed(one, count, SKETCH, "u4"))  # 4 MB, whatever the collection
        sigs = one.select("cid", "n", "s").mapInArrow(_signatures(t, counts), "sig long, cid long, n int")
        x, y = sigs.select("sig", F.col("cid").alias("a"), F.col("n").alias("na")), sigs.select("sig", F.col("cid").alias("b"), F.col("n").alias("nb"))
        near = (F.col("na") * limit.denominator >= F.col("nb") * limit.numerator) & (F.col("nb") * limit.denominator >= F.col("na") * limit.numerator)
        pairs = x.join(y, "sig").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
        both = pairs.join(one.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a").join(one.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b")
        self.links = stage.put(both.select("a", "b", "sa", "sb").mapInArrow(_verify(limit), "a long, b long, sim double"))
        self.stage = stage

    @staticmethod
    def _with_partners(one: DataFrame, t: Fraction) -> DataFrame:
        """Rows of ``one`` of whose shingles at least ``t`` may occur in another row as well."""
        twice = Twice(one.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0).fit(one.select("s"), _joined)
        held = one.sparkSession.sparkContext.broadcast(twice)  # at most 16 MB

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = b.column("n").to_numpy(zero_copy_only=False)
                shared = np.add.reduceat(held.value.seen(_joined(b)), np.r_[0, np.cumsum(n)[:-1]], dtype=np.int64) if b.num_rows else n
                yield b.filter(pa.array(shared * t.denominator >= n.astype(np.int64) * t.numerator))

        return one.mapInArrow(run, one.schema)

    def pairs(self) -> DataFrame:
        """(id_a, id_b, sim), id_a < id_b: every similar pair of ids, copies included (as the problem's cases ask)."""
        m = self.members
        l, r = m.select(F.col("cid").alias("a"), F.col("id").alias("x")), m.select(F.col("cid").alias("b"), F.col("id").alias("y"))
        between = self.links.join(l, "a").join(r, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "sim")
        copied = m.where("copies > 1")
        l, r = copied.select("cid", F.col("id").alias("id_a")), copied.select("cid", F.col("id").alias("id_b"))
        return between.union(l.join(r, "cid").where("id_a < id_b").select("id_a", "id_b", F.lit(1.0).alias("sim")))

    def groups(self) -> DataFrame:
        """(id, class_id, group_id, n_links): one row a text; the group is the smallest id linked directly or indirectly."""
        label = self.stage.put(components(self.links.select("a", "b"), self.stage))
        n = self.links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("n_links"))
        out = self.members.join(label.withColumnRenamed("v", "cid"), "cid", "left").join(n, "cid", "left")
        return out.select("id", F.col("cid").alias("class_id"), F.coalesce("label", "cid").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def components(links: DataFrame, stage: Stage) -> DataFrame:
    """(v, label): the smallest node of each node's component, by hooking to the smallest neighbour and pointer jumping."""
    both = stage.put(links.select(F.col("a").alias("v"), F.col("b").alias("w")).union(links.select("b", "a")).distinct())
    label = stage.put(both.groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("label")))
    while True:
        seen = both.join(label.select(F.col("v").alias("w"), F.col("label").alias("lw")), "w").groupBy("v").agg(F.min("lw").alias("lw"))
        new = label.join(seen, "v").select("v", F.least("label", "lw").alias("label"))
        up = new.select(F.col("v").alias("label"), F.col("label").alias("up"))
        nxt = stage.put(new.join(up, "label", "left").select("v", F.least("label", F.coalesce("up", "label")).alias("label")))
        changed = not nxt.join(label, ["v", "label"], "left_anti").isEmpty()
        stage.drop(label)
        label = nxt
        if not changed:
            return label
