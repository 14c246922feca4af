"""Exact dedup by a log-structured merge index of text digests.

Every task keeps a memtable (digest -> kept id, copies). A full memtable is flushed as a run
sorted by digest, with a Bloom filter beside it. Compaction merges the sorted runs by digest
range, keeps the smallest (or largest) identifier of each digest, and writes a filter of the
digests that it saw more than once. Rows look their digests up in those filters: what misses is
unique, and only hits are joined with the index and verified on the bytes of their texts;
groups whose bytes differ are split by the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StructField, StructType

from ._shared import materialise, scratch_path, sliced, utf8

RUN_SCHEMA = "memtable string, digest binary, keep_id long, copies long, filter binary"
LEVEL1_SCHEMA = "digest binary, keep_id long, copies long, first binary, filter binary"
_PROBES = 4


def normalise(text: bytes | None) -> bytes:
    """bytes.lower() changes A-Z only, as the texts are UTF-8."""
    return b"" if text is None else text.lower()


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sha) per row; sha is the SHA-256 of the normalised text."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sha = [hashlib.sha256(normalise(x)).digest() for x in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sha, pa.binary())], names=["doc_id", "sha"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(digest, "doc_id long, sha binary")


def filter_bits(digests: list[bytes]) -> bytes:
    """A Bloom filter of 16 to 32 bits an entry, a power of two in all."""
    n = 64
    while n < 16 * len(digests):
        n <<= 1
    bits = np.zeros(n, np.uint8)
    bits[_positions(digests, n).ravel()] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: bytes) -> bytes:
    """The same filter in half the space; it has no false negatives and more false positives."""
    half = len(bits) // 2
    return (np.frombuffer(bits[:half], np.uint8) | np.frombuffer(bits[half:], np.uint8)).tobytes()


def within(filters: list[bytes], most: int) -> list[bytes]:
    """Filters, the largest folded until all take at most `most` bytes (8 bytes each at least)."""
    filters = list(filters)
    while sum(map(len, filters)) > most and max(map(len, filters)) > 8:
        widest = max(map(len, filters))
        filters = [folded(f) if len(f) == widest else f for f in filters]
    return filters


def _positions(digests: list[bytes], n: int) -> np.ndarray:
    words = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, digests)), np.uint64).reshape(-1, 2)
    return ((words[:, :1] + np.arange(_PROBES, dtype=np.uint64) * (words[:, 1:] | np.uint64(1))) & np.uint64(n - 1)).astype(np.int64)


def may_contain(bits: bytes, digests: list[bytes]) -> np.ndarray:
    if not digests:
        return np.zeros(0, bool)
    held = np.frombuffer(bits, np.uint8)
    at = _positions(digests, 8 * len(held))
    return (held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool).all(axis=1)


def in_ranges(firsts: list[bytes], filters: list[bytes], digests: list[bytes]) -> np.ndarray:
    """Whether each digest passes the filter of the range that it falls into."""
    import bisect

    found = np.zeros(len(digests), bool)
    at = np.array([bisect.bisect_right(firsts, d) - 1 for d in digests], np.int64)
    for k in np.unique(at[at >= 0]):
        mine = np.flatnonzero(at == k)
        found[mine] = may_contain(filters[k], [digests[i] for i in mine])
    return found


class DigestIndex:
    """Sorted digest runs in the shared folder; level 0 as flushed, level 1 merged by digest range.

    keep: "smallest" or "largest" identifier of equal digests. A null identifier stays only
    where all are null. filter_bytes bounds what is broadcast of the filters: beyond it they are
    folded, so that more rows pass them, and nothing else changes.
    """

    def __init__(self, spark: SparkSession, keep: str = "smallest", memtable_rows: int = 200_000, filter_bytes: int = 64 << 20):
        if keep not in ("smallest", "largest"):
            raise ValueError(f"keep must be smallest or largest, not {keep!r}")
        self.spark, self.keep, self.memtable_rows, self.filter_bytes = spark, keep, memtable_rows, filter_bytes
        self.runs: list[str] = []
        self.level1: DataFrame | None = None

    def insert(self, entries: DataFrame) -> None:
        """entries: (doc_id, digest). Flushes one set of runs; an earlier compaction is then stale."""
        most, pick = self.memtable_rows, min if self.keep == "smallest" else max

        def memtables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, flushed = TaskContext.get().partitionId(), 0
            table: dict[bytes, tuple[int | None, int]] = {}

            def flush() -> pa.RecordBatch:
                keys = sorted(table)
                rows = [table[k] for k in keys]
                name = f"{part}-{flushed}"
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * (len(keys) + 1), pa.string()),
                        pa.array([*keys, None], pa.binary()),
                        pa.array([*(r[0] for r in rows), None], pa.int64()),
                        pa.array([*(r[1] for r in rows), None], pa.int64()),
                        pa.array([*[None] * len(keys), filter_bits(keys)], pa.binary()),
                    ],
                    names=["memtable", "digest", "keep_id", "copies", "filter"],
                )

            for b in batches:
                for i, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    old = table.get(d)
                    if old is None:
                        table[d] = (i, 1)
                    else:
                        best = old[0] if i is None else i if old[0] is None else pick(i, old[0])
                        table[d] = (best, old[1] + 1)
                if len(table) >= most:
                    yield flush()
                    table.clear()
                    flushed += 1
            if table:
                yield flush()

        path = scratch_path(self.spark, "lsm-run")
        entries.select("doc_id", "digest").mapInArrow(memtables, RUN_SCHEMA).write.parquet(path)
        self.runs.append(path)
        self.level1 = None

    def _level0(self) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(*self.runs)

    def _compacted(self) -> DataFrame:
        if self.level1 is None:
            pick = min if self.keep == "smallest" else max

            def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                digest, best, copies, first, hits = None, None, 0, None, []

                def out(rows: list[tuple]) -> pa.RecordBatch:
                    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in LEVEL1_SCHEMA.split(", ")])

                for b in batches:
                    rows = []
                    for d, i, n in zip(*(b.column(k).to_pylist() for k in range(3))):
                        if d == digest:
                            best = i if best is None else best if i is None else pick(best, i)
                            copies += n
                            continue
                        if digest is not None:
                            rows.append((digest, best, copies, None, None))
                            if copies > 1:
                                hits.append(digest)
                        first = d if first is None else first
                        digest, best, copies = d, i, n
                    yield out(rows)
                if digest is not None:
                    if copies > 1:
                        hits.append(digest)
                    yield out([(digest, best, copies, None, None), (None, None, len(hits), first, filter_bits(hits))])

            runs = self._level0().where("filter is null").select("digest", "keep_id", "copies")
            merged = runs.repartitionByRange("digest").sortWithinPartitions("digest").mapInArrow(merge, LEVEL1_SCHEMA)
            self.level1 = materialise(merged, "lsm-level1")
        return self.level1

    def compact(self) -> DataFrame:
        """(digest, keep_id, copies): the sorted runs merged, range by range; a digest lies in one range."""
        return self._compacted().where("filter is null").select("digest", "keep_id", "copies")

    def hit_filters(self) -> tuple[list[bytes], list[bytes]]:
        """First digest of each range and the filter of its digests that occur more than once."""
        rows = sorted((bytes(r[0]), bytes(r[1])) for r in self._compacted().where("filter is not null").select("first", "filter").toLocalIterator())
        return [r[0] for r in rows], within([r[1] for r in rows], self.filter_bytes)

    def may_repeat(self, rows: DataFrame, column: str = "digest") -> DataFrame:
        """Rows with `hit`: false where the digest occurs once for certain."""
        held = self.spark.sparkContext.broadcast(self.hit_filters())

        def test(digest):
            import pandas as pd

            return pd.Series(in_ranges(*held.value, list(digest)))

        return rows.withColumn("hit", F.pandas_udf(test, "boolean")(F.col(column)))

    def probe(self, digests: DataFrame, column: str = "digest") -> DataFrame:
        """Rows of digests with keep_id and copies of the index, null where it lacks the digest.

        The filters of the flushed runs answer most misses; the rest is joined.
        """
        filters = within([bytes(r[0]) for r in self._level0().where("filter is not null").select("filter").toLocalIterator()], self.filter_bytes)
        held = self.spark.sparkContext.broadcast(filters)

        def test(digest):
            import pandas as pd

            values = list(digest)
            found = np.zeros(len(values), bool)
            for bits in held.value:
                found |= may_contain(bits, values)
            return pd.Series(found)

        level1 = self.compact().withColumnRenamed("digest", "_digest")
        maybe = digests.withColumn("_maybe", F.pandas_udf(test, "boolean")(F.col(column)))
        hits = maybe.where("_maybe").join(level1, F.col(column) == F.col("_digest"), "left")
        misses = maybe.where("not _maybe").withColumns({"keep_id": F.lit(None).cast("long"), "copies": F.lit(None).cast("long")})
        return hits.drop("_digest", "_maybe").unionByName(misses.drop("_maybe"))


def verified_collisions(docs: DataFrame, index: DigestIndex, digest_bytes: int, buffer_bytes: int = 32 << 20) -> DataFrame:
    """(digest): those of at least two rows whose texts are not all the same bytes.

    Only texts that pass the hit filters move. A task compares the texts of a digest as they
    come and passes on one of each; min and max of what is left are the same bytes where all
    texts are.
    """
    held = docs.sparkSession.sparkContext.broadcast(index.hit_filters())

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bytes] = {}
        held_bytes = 0
        for b in sliced(batches):
            texts = [normalise(x) for x in utf8(b.column(0))]
            digests = [hashlib.sha256(x).digest()[:digest_bytes] for x in texts]
            out = []
            for k in np.flatnonzero(in_ranges(*held.value, digests)).tolist():
                d, x = digests[k], texts[k]
                first = seen.get(d)
                if first is None:
                    seen[d] = x
                    held_bytes += len(x)
                elif first == x:
                    continue
                out.append((d, x))
                if held_bytes > buffer_bytes:
                    seen.clear()
                    held_bytes = 0
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], names=["digest", "bytes"])

    ends = docs.select("text").mapInArrow(candidates, "digest binary, bytes binary").groupBy("digest").agg(F.min("bytes").alias("a"), F.max("bytes").alias("b"))
    return ends.where("a != b").select("digest")


def _bytes(text_col: str) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.encode(F.translate(F.coalesce(text_col, F.lit("")), upper, upper.lower()), "UTF-8")


def _indexed(source: DataFrame, keep: str, digest_bytes: int, memtable_rows: int) -> tuple[DataFrame, DigestIndex, DataFrame]:
    """Written (doc_id, sha, digest), their index, and the digests whose texts differ."""
    rows = materialise(text_digests(source).withColumn("digest", F.expr(f"substring(sha, 1, {int(digest_bytes)})")), "lsm-digests")
    index = DigestIndex(source.sparkSession, keep, memtable_rows)
    index.insert(rows)
    return rows, index, materialise(verified_collisions(source, index, digest_bytes), "lsm-collisions")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest_bytes: int = 32, memtable_rows: int = 200_000) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of repeated
    rows (same id and text) exactly one is kept. An empty table gives no rows. digest_bytes
    below 32 shortens the index's digest (collisions are then split on the bytes). Rows that
    miss the index's hit filters are unique; only the others are shuffled.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, index, bad = _indexed(source, keep, digest_bytes, memtable_rows)
    best = F.min("doc_id") if keep == "smallest" else F.max("doc_id")
    flagged = index.may_repeat(rows)
    unique = flagged.where("not hit").select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(1).cast("long").alias("n"))
    counted = flagged.where("hit").groupBy("digest", "sha", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = index.compact().where("copies > 1").join(bad, "digest", "left_anti")
    joined = counted.join(bad, "digest", "left_anti").join(repeated, "digest", "left")
    plain = joined.select("doc_id", "sha", F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("group_size"), "n")
    if bad.limit(1).count():
        exact = source.select("doc_id", _bytes("text").alias("bytes")).withColumn("sha", F.unhex(F.sha2("bytes", 256))).withColumn("digest", F.expr(f"substring(sha, 1, {int(digest_bytes)})")).join(bad, "digest", "left_semi")
        groups = exact.groupBy("digest", "bytes").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        split = exact.groupBy("digest", "bytes", "sha", "doc_id").agg(F.count(F.lit(1)).alias("n")).join(groups, ["digest", "bytes"])
        plain = plain.unionByName(split.select("doc_id", "sha", "keep_id", "group_size", "n"))
    out = plain.unionByName(unique).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def unique_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", memtable_rows: int = 200_000) -> DataFrame:
    """The rows of docs, with all their columns, that exact_dedup keeps: one of each group of equal texts.

    Rows that miss the hit filters pass as they are. Of the others the kept identifiers and
    digests are settled first, on digests alone; rows meet them by identifier and digest, so
    copies of one text are spread, and one of each group of repeated rows stays (any, where
    other columns differ). Columns of docs may have any names. An empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, index, bad = _indexed(source, keep, 32, memtable_rows)
    repeated = index.compact().where("copies > 1").select("digest", F.col("keep_id").alias("id"))
    alone = index.may_repeat(rows).where("hit").join(repeated, "digest", "left_anti").select("digest", F.col("doc_id").alias("id"))
    kept = materialise(repeated.unionByName(alone).join(bad, "digest", "left_anti"), "lsm-kept")
    held = docs.sparkSession.sparkContext.broadcast(index.hit_filters())
    names, at = ["row", "id", "digest", "hit"], docs.columns.index(text_col)

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            digests = [hashlib.sha256(normalise(x)).digest() for x in utf8(b.column(0).field(at))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(in_ranges(*held.value, digests))], names=names)

    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"))
    schema = StructType([whole.schema["row"], whole.schema["id"], StructField("digest", BinaryType()), StructField("hit", BooleanType())])
    flagged = whole.mapInArrow(flag, schema)
    hits = flagged.where("hit").drop("hit")
    k = kept.select(F.col("digest").alias("kept_digest"), F.col("id").alias("kept_id"))
    found = hits.join(k, (F.col("digest") == F.col("kept_digest")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi").dropDuplicates(["digest"])
    out = flagged.where("not hit").select("row").unionByName(found.select("row"))
    if bad.limit(1).count():
        differ = hits.join(bad, "digest", "left_semi").withColumn("bytes", _bytes(f"row.`{text_col}`"))
        best = F.min("id") if keep == "smallest" else F.max("id")
        groups = differ.groupBy("digest", "bytes").agg(best.alias("keep_id"))
        split = differ.join(groups, ["digest", "bytes"]).where(F.col("id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["digest", "bytes"])
        out = out.unionByName(split.select("row"))
    return out.select("row.*")
