"""Problem 7: mixing sources to target weights.

Documents are dealt by hash to blocks of about a sixteenth of a shard, so all planning is done on a table of bounded size:
blocks, their tokens and how often each is used. Where a source has too many blocks or repeats for UNITS units, its blocks
get larger, and a unit is several uses of a block. The largest mix is taken in which no source has to repeat a document
more than ``max_repeats`` times. A source's quota is whole passes over its blocks, then blocks in random order, then a
part of one more block, document by document; so the shares are met within one document a source.

The units are dealt to groups of output shards by a splitting tree: at each node the counts of units per source are divided
between the two halves of the node's groups by a multivariate hypergeometric draw, which gives every group the exact
distribution of a random permutation of all units. Each group then draws its number of units from a permutation of the
source's units (disjoint ranges). A group is one shard unless units are larger than shards; then its documents are dealt to
its shards by a hash. Documents are shuffled within the shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from closura.functions.tokens import VOCABULARY, encoder
from closura.llm.leakage import spread
from closura.plans.staging import Stage

#: Most units of a source (blocks times uses), whatever its size and repeats; the driver plans on them.
UNITS = 16_384


def source_name(c: str) -> Column:
    """Sources are compared after removing surrounding blanks, lower-casing and replacing '-' by '_'."""
    return F.replace(F.lower(F.trim(F.col(c))), F.lit("-"), F.lit("_"))


def token_counts(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, source, n_tokens) of (id, source, text); whole texts, special tokens read as ordinary text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("source"), pa.array(n, pa.int64())], names=["id", "source", "n_tokens"])

    return df.select("id", "source", "text").mapInArrow(run, "id long, source string, n_tokens long")


def split_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """counts[s] blocks of each source -> (shards, sources): blocks of each source in each shard, rows of equal sums (+-1)."""
    out = np.zeros((shards, len(counts)), np.int64)
    todo = [(0, shards, counts.astype(np.int64))]
    while todo:
        lo, hi, held = todo.pop()
        if hi - lo == 1:
            out[lo] = held
            continue
        mid = (lo + hi) // 2
        take = int(held.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(held, take, method="marginals")
        todo += [(lo, mid, left), (mid, hi, held - left)]
    return out


class Mix:
    """The plan for ``documents`` (doc_id, source, text) and ``weights`` (source, weight, max_repeats).

    Left out: documents with a null id, a null or blank text or a source without a positive weight, as they have no
    place in the mix. Weights of sources without documents are divided among the others in proportion. A null
    ``max_repeats`` counts as 1, and of 0 or less as a source that can't be used; of rows that name a source again the
    largest weight counts. Repeated doc ids are separate documents.
    """

    def __init__(self, documents: DataFrame, weights: DataFrame, shard_tokens: int = 1 << 20, vocabulary: str = VOCABULARY, seed: int = 20260817):
        spark, self.seed = documents.sparkSession, seed
        stage = Stage(spark, "mix")
        rows = weights.select(source_name("source").alias("source"), "weight", "max_repeats").where("source is not null and weight > 0").collect()  # a fixed table
        self.weight = {}
        for r in sorted(rows, key=lambda r: r["weight"]):
            self.weight[r["source"]] = (float(r["weight"]), 1 if r["max_repeats"] is None else max(0, int(r["max_repeats"])))
        wanted = F.col("source").isin([s for s, (_, k) in self.weight.items() if k])
        docs = documents.select(F.col("doc_id").alias("id"), source_name("source").alias("source"), "text").where(wanted & F.expr(r"id is not null and text rlike '\\S'"))
        counted = stage.put(token_counts(spread(docs, "id"), vocabulary).where("n_tokens > 0"))
        self.tokens = {r["source"]: r["t"] for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # a row a source of the fixed table
        self.sources = sorted(self.tokens)
        number = {s: max(1, min(-(-16 * self.tokens[s] // shard_tokens), UNITS // min(self.weight[s][1], UNITS))) for s in self.sources}
        blocks = spark.createDataFrame(list(number.items()), "source string, blocks int")
        block = F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")).cast("int").alias("block")
        self.docs = counted.join(F.broadcast(blocks), "source").select("id", "source", "n_tokens", block)  # a row a source
        sizes = self.docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("t")).collect()  # at most UNITS a source
        rng = np.random.default_rng(seed)
        self.blocks: dict[str, list[tuple[int, int]]] = {}
        for r in sorted(sizes, key=lambda r: (r["source"], r["block"])):
            self.blocks.setdefault(r["source"], []).append((r["block"], r["t"]))
        total = sum(self.weight[s][0] for s in self.sources)
        self.target = {s: self.weight[s][0] / total for s in self.sources}
        self.size = min((self.weight[s][1] * self.tokens[s] / self.target[s] for s in self.sources), default=0.0)
        units, cuts = {}, []
        for s in self.sources:
            units[s], rest = self._quota(s, rng)
            if rest:
                cuts.append((s, *rest))
        n = np.array([len(units[s]) for s in self.sources], np.int64)
        shards = max(1, -(-int(self.size) // shard_tokens))
        groups = max(1, min(int(n.sum()), shards))
        self.within = -(-shards // groups)
        self.shards = groups * self.within
        dealt = split_tree(n, groups, rng) if len(n) else np.zeros((1, 0), np.int64)
        plan = []
        for j, s in enumerate(self.sources):
            order = [units[s][i] for i in rng.permutation(len(units[s]))]
            group = np.repeat(np.arange(groups), dealt[:, j]).tolist()
            plan += [(s, *unit, k) for unit, k in zip(order, group, strict=True)]
        self.units = spark.createDataFrame(plan, "source string, block int, copy int, uses int, part int")  # at most 2 * UNITS a source
        self.cuts = spark.createDataFrame(cuts, "source string, block int, copy int, room long")

    def _quota(self, s: str, rng: np.random.Generator) -> tuple[list[tuple[int, int, int]], tuple[int, int, int] | None]:
        """Units (block, first copy, uses) of a source, and the block of which only ``room`` tokens are used."""
        quota = int(round(self.size * self.target[s]))
        passes = min(quota // self.tokens[s], self.weight[s][1])
        step = max(1, -(-passes * len(self.blocks[s]) // UNITS))  # uses a unit
        out = [(b, c, min(step, passes - c)) for c in range(0, passes, step) for b, _ in self.blocks[s]]
        room = quota - passes * self.tokens[s]
        if passes == self.weight[s][1] or not room:
            return out, None
        for i in rng.permutation(len(self.blocks[s])):
            b, t = self.blocks[s][i]
            out.append((b, passes, 1))
            if t >= room:
                return out, (b, passes, room)
            room -= t
        return out, None

    def selection(self) -> DataFrame:
        """(doc_id, source, copy, shard, pos, n_tokens): every use of a document, with its place in its shard."""
        shard = (F.col("part") * self.within + F.pmod(F.xxhash64("id", "copy", F.lit(self.seed + 3)), F.lit(self.within))).cast("int").alias("shard")
        held = self.docs.join(F.broadcast(self.units), ["source", "block"]).select("id", "source", "n_tokens", "block", "part", F.explode(F.sequence("copy", F.col("copy") + F.col("uses") - 1)).alias("copy"))
        held = held.withColumn("shard", shard).join(F.broadcast(self.cuts), ["source", "block", "copy"], "left")
        mixed = F.xxhash64("id", "copy", F.lit(self.seed + 1))
        cut = held.where("room is not null").withColumn("run", F.sum("n_tokens").over(Window.partitionBy("source", "copy").orderBy(mixed, "id").rowsBetween(Window.unboundedPreceding, 0)))
        columns = ["id", "source", "copy", "shard", "n_tokens"]
        used = held.where("room is null").select(*columns).union(cut.where("run <= room").select(*columns))
        place = Window.partitionBy("shard").orderBy(F.xxhash64("id", "copy", F.lit(self.seed + 2)), "id", "copy")
        return used.select(F.col("id").alias("doc_id"), "source", "copy", "shard", F.row_number().over(place).alias("pos"), "n_tokens")

    def shares(self) -> DataFrame:
        """(source, weight, target_share, tokens, share, uses, docs, most_used, max_repeats, available_tokens) by source."""
        used = self.selection().groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n_tokens").alias("t"))
        got = used.groupBy("source").agg(F.sum("t").alias("tokens"), F.sum("k").alias("uses"), F.count(F.lit(1)).alias("docs"), F.max("k").alias("most_used"))
        rows = [(s, w, self.target.get(s, 0.0), r, int(self.tokens.get(s, 0))) for s, (w, r) in self.weight.items()]
        plan = got.sparkSession.createDataFrame(rows, "source string, weight double, target_share double, max_repeats int, available_tokens long")
        all_ = Window.partitionBy(F.lit(0))  # as many rows as sources
        out = plan.join(got, "source", "left").fillna(0, ["tokens", "uses", "docs", "most_used"])
        return out.withColumn("share", F.col("tokens") / F.greatest(F.sum("tokens").over(all_), F.lit(1))).select("source", "weight", "target_share", "tokens", "share", "uses", "docs", "most_used", "max_repeats", "available_tokens")

    def invariants(self) -> DataFrame:
        """(source, n_docs, target_share, max_repeats, in_target, repeats_kept, uses_distinct) of every source of the mix.

        ``in_target``: the tokens are within one document of the target; ``repeats_kept``: no document is used more often than
        allowed; ``uses_distinct``: no use of a document is in two shards or places.
        """
        s = self.selection()
        used = s.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("k"), F.count_distinct("copy").alias("c"), F.sum("n_tokens").alias("t"))
        got = used.groupBy("source").agg(F.sum("t").alias("t"), F.max("k").alias("k"), F.min(F.col("k") == F.col("c")).alias("uses_distinct"))
        held = self.docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_tokens").alias("longest"))
        rows = [(s, float(self.target[s]), self.weight[s][1], float(self.size * self.target[s])) for s in self.sources]
        plan = s.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeats int, wanted double")
        out = plan.join(held, "source").join(got, "source", "left")
        near = F.abs(F.coalesce("t", F.lit(0)) - F.col("wanted")) <= F.col("longest")
        return out.select("source", "n_docs", F.round("target_share", 9).alias("target_share"), "max_repeats", near.alias("in_target"), (F.coalesce("k", F.lit(0)) <= F.col("max_repeats")).alias("repeats_kept"), F.coalesce("uses_distinct", F.lit(True)).alias("uses_distinct"))
