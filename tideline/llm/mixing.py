"""Mixing sources to target weights by sampling fixed-length blocks.

The words of a source, its documents one after another, are packed into blocks of fixed
length. Multinomial draws settle how many blocks of each source go into each output shard. The
k-th slot of a source takes the block that the source's pseudorandom permutation has at k, and
slots meet blocks in a join by index. Targets are met to the word: the last slot of a source
takes only the first words of its block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bucket_of, materialise, n_words, running_offsets


def reshared_targets(sizes: list[int], weights: list[float], share: float, limit: float) -> list[float]:
    """share of all sizes, by weight; a target stops at limit times its size, the excess goes on by weight."""
    targets = [0.0] * len(sizes)
    total_weight = sum(weights)
    if not total_weight:
        return targets
    targets = [share * sum(sizes) * w / total_weight for w in weights]
    while True:
        over = [k for k, t in enumerate(targets) if t > limit * sizes[k]]
        if not over:
            return targets
        excess = sum(targets[k] - limit * sizes[k] for k in over)
        for k in over:
            targets[k] = limit * sizes[k]
        room = [k for k, t in enumerate(targets) if t < limit * sizes[k]]
        weight = sum(weights[k] for k in room)
        if not weight:
            return targets
        for k in room:
            targets[k] += excess * weights[k] / weight


def _mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 6) -> np.ndarray:
    """The place of index in the permutation of range(size) that key names: a Feistel network, walked until in range."""
    index, size, key = (np.asarray(x).astype(np.uint64) for x in np.broadcast_arrays(index, size, key))
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(2, size.astype(np.float64)))) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.copy()
    live = np.arange(len(out))
    while len(live):
        h, m, k = half[live], mask[live], key[live]
        left, right = out[live] >> h, out[live] & m
        for r in range(rounds):
            left, right = right, left ^ (_mix64(right + _mix64(k + np.uint64(r + 1))) & m)
        out[live] = (left << h) | right
        live = live[out[live] >= size[live]]
    return out.astype(np.int64)


@dataclass(frozen=True)
class MixPlan:
    """A few numbers a source, and a cell for each shard and source that has slots there, by shard and source."""

    block: int
    seed: int
    sizes: np.ndarray
    words: np.ndarray
    per_shard: int
    cell_source: np.ndarray
    cell_end: np.ndarray  # slots of all cells up to and with this one
    cell_before: np.ndarray  # slots of the cell's source in earlier shards

    @property
    def slots(self) -> int:
        return int(self.cell_end[-1]) if len(self.cell_end) else 0


def slots_needed(sizes: np.ndarray, words: np.ndarray, block: int) -> np.ndarray:
    size = np.maximum(sizes, 1)
    passes, rest = words // size, words % size
    return np.where(sizes > 0, passes * -(-sizes // block) + -(-rest // block), 0)


def plan_mix(sizes: list[int], targets: list[float], block: int, seed: int, max_shards: int = 4096, min_slots: int = 1024, max_cells: int = 1 << 22) -> MixPlan:
    """Draw the multinomial counts, shard by shard, from what each source still has to give.

    There are at most max_shards shards, and so few that shards times sources stay within max_cells.
    """
    size, words = np.array(sizes, np.int64), np.floor(np.array(targets, np.float64) + 1e-9).astype(np.int64)
    left = slots_needed(size, words, block)
    total = int(left.sum())
    per_shard = max(min_slots, -(-total // max(1, min(max_shards, max_cells // max(1, len(size))))))
    rng = np.random.default_rng(seed)
    source, counts, before = ([np.zeros(0, np.int64)] for _ in range(3))
    given = np.zeros_like(left)
    while (rest := int(left.sum())) > 0:
        got = np.zeros_like(left)
        while (short := min(per_shard, rest) - int(got.sum())) > 0:
            room = left - got
            got = np.minimum(got + rng.multinomial(short, room / room.sum()), left)
        held = np.flatnonzero(got)
        source.append(held)
        counts.append(got[held])
        before.append(given[held])
        given, left = given + got, left - got
    return MixPlan(block, seed, size, words, per_shard, np.concatenate(source), np.cumsum(np.concatenate(counts)), np.concatenate(before))


def draw_slots(plan: MixPlan, slot: np.ndarray) -> dict[str, np.ndarray]:
    """Slot numbers of the whole mix to shard, position, source, round, block and words taken."""
    shard = slot // plan.per_shard
    first = shard * plan.per_shard
    at = first + permute(slot - first, np.minimum(plan.per_shard, plan.slots - first), _mix64(shard.astype(np.uint64) + np.uint64(plan.seed)))
    cell = np.searchsorted(plan.cell_end, at, side="right")
    source = plan.cell_source[cell]
    j = plan.cell_before[cell] + at - np.r_[0, plan.cell_end][cell]
    size = plan.sizes[source]
    full, turn, k = size // plan.block, j // -(-size // plan.block), j % -(-size // plan.block)
    inner = k < full
    key = _mix64(_mix64(source.astype(np.uint64) + np.uint64(plan.seed)) + turn.astype(np.uint64))
    block = np.where(inner, permute(np.where(inner, k, 0), np.maximum(full, 1), key), full)
    length = np.where(block < full, plan.block, size - full * plan.block)
    last = j == slots_needed(size, plan.words[source], plan.block) - 1
    done = turn * size + k * plan.block
    take = np.where(last, np.minimum(length, plan.words[source] - done), length)
    return {"shard": shard, "position": slot - first, "source_no": source, "round": turn, "block": block, "take": take}


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", buckets: int = 1024) -> DataFrame:
    """(doc_id, source, size, text_hash, bucket): written once, so that the text is read once."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), F.xxhash64(text_col).alias("text_hash"))
    return materialise(rows.withColumn("bucket", bucket_of("doc_id", "text_hash", buckets=buckets)), "mix-sizes")


@dataclass(frozen=True)
class Mix:
    sources: DataFrame  # source, source_no, source_size, target
    documents: DataFrame  # doc_id, source, source_no, size, text_hash, row_no, first_word
    spans: DataFrame  # shard, position, round, block, doc_id, source_no, text_hash, row_no, start, n
    n_sources: int


def _small(sources: DataFrame, n: int, most: int = 100_000) -> DataFrame:
    """To be broadcast where the rows, which are counted, are few; else joined as any table."""
    return F.broadcast(sources) if n <= most else sources


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    limit: float = 2.0,
    block: int = 2048,
    seed: int = 11,
    max_shards: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> Mix:
    """Mix docs; sources take the weights in turn, in code point order with null last.

    Sizes are word counts (null text: 0). One row a source comes to the driver; the counts that
    the plan holds beside them are at most 4 million (see plan_mix). A source without words has target 0. Repeated rows count and
    are drawn as rows of their own. An empty table gives empty frames.
    """
    spark = docs.sparkSession
    sized = sized_documents(docs, id_col, text_col, source_col)
    totals = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    totals = sorted(totals, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["n"]) for r in totals]
    targets = reshared_targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))], share, limit)
    plan = plan_mix(sizes, targets, block, seed, max_shards)
    sources = spark.createDataFrame(
        [(r["source"], k, sizes[k], float(targets[k])) for k, r in enumerate(totals)], "source string, source_no int, source_size long, target double"
    )
    numbered = sized.join(_small(sources.select(F.col("source").alias("_s"), "source_no"), len(sizes)), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    order = [F.col("doc_id"), F.col("text_hash")]
    placed = running_offsets(numbered, "source_no", "bucket", order, F.col("size"), "first_word")
    placed = running_offsets(placed, "source_no", "bucket", order, F.lit(1), "row_no")
    placed = materialise(placed, "mix-documents")

    first, last = F.expr(f"first_word div {block}"), F.expr(f"(first_word + size - 1) div {block}")
    segments = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("first_word"), F.col("block") * block)
    end = F.least(F.col("first_word") + F.col("size"), (F.col("block") + 1) * block)
    segments = segments.select(
        "doc_id", "source_no", "text_hash", "row_no", "block", (start - F.col("block") * block).alias("_from"), (end - F.col("block") * block).alias("_to"), (start - F.col("first_word")).alias("start")
    )

    held = spark.sparkContext.broadcast(plan)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame(draw_slots(held.value, f["id"].to_numpy()))

    slots = spark.range(plan.slots).mapInPandas(draw, "shard long, position long, source_no int, round int, block long, take long")
    n = F.least(F.col("_to"), F.col("take")) - F.col("_from")
    spans = slots.join(segments, ["source_no", "block"]).withColumn("n", n).where("n > 0").drop("_from", "_to", "take")
    return Mix(sources, placed, spans, len(sizes))


def taken_words(mix: Mix) -> DataFrame:
    """Per document row: doc_id, size, source_size, target, taken."""
    taken = mix.spans.groupBy("source_no", "row_no").agg(F.sum("n").alias("taken"))
    rows = mix.documents.join(taken, ["source_no", "row_no"], "left").join(_small(mix.sources.drop("source"), mix.n_sources), "source_no")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _cut(text: str, starts: list[int], counts: list[int]) -> str:
    """The spans' words of a text, with the white space inside each span as it was."""
    at = np.fromiter((p for m in re.finditer(r"[^\x20\x09-\x0D]+", text) for p in m.span()), np.int64).reshape(-1, 2)
    return "\n".join(text[at[s, 0] : at[s + n - 1, 1]] for s, n in zip(starts, counts))


def mixed_documents(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The mix as rows of docs: one row per document row and round, its text cut to the words drawn.

    A document drawn whole keeps its text as it is. Columns are those of docs; length_col, where
    there is one, is counted anew.
    """
    columns = docs.columns
    drawn = mix.spans.groupBy("source_no", "row_no", "round", "doc_id", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("start", "n"))).alias("spans"), F.sum("n").alias("n")
    )
    drawn = drawn.join(mix.documents.select("source_no", "row_no", "size"), ["source_no", "row_no"])
    drawn = drawn.select("doc_id", "text_hash", F.when(F.col("n") < F.col("size"), F.col("spans")).alias("spans"))
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    if mix.documents.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        keyed = keyed.dropDuplicates(["id", "hash"])

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else _cut(t, [x["start"] for x in s], [x["n"] for x in s]) for t, s in zip(text, spans)])

    joined = keyed.join(drawn, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")))
    whole = F.col("spans").isNull()
    put = F.when(whole, F.col("text")).otherwise(cut(F.when(~whole, F.col("text")), F.col("spans")))
    out = joined.select("row", put.alias("text"))
    own = lambda c: F.col(f"row.`{c}`")
    length = F.length("text").cast("long")
    return out.select(*[F.col("text").alias(c) if c == text_col else length.alias(c) if c == length_col else own(c).alias(c) for c in columns])
