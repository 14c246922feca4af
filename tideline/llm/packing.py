"""Best-fit packing of documents into bins under conflicts.

Open bins are ordered by residual room and carry bitmaps of the sources and duplicate clusters
they hold. A piece goes to the tightest compatible bin: the successor search starts at the
smallest residual that has room for it and goes on until a bin has no conflict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bucket_of, materialise, utf8


class Bins:
    """Bins of one group. Sources and clusters are small numbers; bit k of a bitmap is number k."""

    def __init__(self, capacity: int, max_per_source: int):
        self.capacity, self.max_per_source = capacity, max_per_source
        self.room: list[int] = []
        self.sources: list[list[int]] = []  # plane p: sources of which the bin holds more than p
        self.clusters: list[int] = []
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0  # bitmap of the residuals that some bin has

    def _file(self, b: int) -> None:
        self.by_room.setdefault(self.room[b], []).append(b)
        self.rooms |= 1 << self.room[b]

    def compatible(self, b: int, source: int, cluster: int) -> bool:
        return not self.clusters[b] >> cluster & 1 and not self.sources[b][-1] >> source & 1

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, start) for a piece of 1 to capacity words."""
        later = self.rooms >> size
        while later:
            room = size + (later & -later).bit_length() - 1
            for k, b in enumerate(self.by_room[room]):
                if self.compatible(b, source, cluster):
                    del self.by_room[room][k]
                    if not self.by_room[room]:
                        del self.by_room[room]
                        self.rooms &= ~(1 << room)
                    return self._put(b, size, source, cluster)
            later &= later - 1
        self.room.append(self.capacity)
        self.sources.append([0] * self.max_per_source)
        self.clusters.append(0)
        return self._put(len(self.room) - 1, size, source, cluster)

    def _put(self, b: int, size: int, source: int, cluster: int) -> tuple[int, int]:
        start = self.capacity - self.room[b]
        self.room[b] -= size
        planes = self.sources[b]
        p = next(k for k, bits in enumerate(planes) if not bits >> source & 1)
        planes[p] |= 1 << source
        self.clusters[b] |= 1 << cluster
        if self.room[b]:
            self._file(b)
        return b, start


def pieces(docs: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", texts: bool = False) -> DataFrame:
    """(doc_id, source, cluster, piece, n_words): texts cut into runs of at most capacity words.

    The cluster is the XXH64 of the text with A-Z lower-cased. A text without words is one piece
    of 0. texts adds the words of the piece, joined by spaces, as `text`.
    """
    names = ["doc_id", "source", "cluster", "piece", "n_words", *(["text"] if texts else [])]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 512) for at in range(0, whole.num_rows, 512)):
                row, cluster, piece, size, words = [], [], [], [], []
                for k, x in enumerate(utf8(b.column(2))):
                    found = (x or b"").split()
                    code = xxhash.xxh64_intdigest((x or b"").lower())
                    for p in range(max(1, -(-len(found) // capacity))):
                        part = found[p * capacity : (p + 1) * capacity]
                        row.append(k)
                        cluster.append(code)
                        piece.append(p)
                        size.append(len(part))
                        if texts:
                            words.append(b" ".join(part))
                at = pa.array(row, pa.int64())
                cols = [b.column(0).take(at), b.column(1).take(at), pa.array(np.array(cluster, np.uint64).view(np.int64)), pa.array(piece, pa.int64()), pa.array(size, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(words, pa.binary()).cast(pa.string())] if texts else []), names=names)

    schema = "doc_id long, source string, cluster long, piece long, n_words long" + (", text string" if texts else "")
    return docs.select(F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.col(text_col)).mapInArrow(scan, schema)


def _placed(rows: pd.DataFrame, capacity: int, max_per_source: int, base: int) -> pd.DataFrame:
    """Rows of one group, largest first, with bin_id (null without words) and start."""
    rows = rows.sort_values(["n_words", "_no_id", "doc_id", "cluster", "piece"], ascending=[False, False, True, True, True], kind="stable")
    sources = pd.factorize(rows["source"], use_na_sentinel=False)[0].tolist()
    clusters = pd.factorize(rows["cluster"])[0].tolist()
    bins = Bins(capacity, max_per_source)
    found = [bins.place(n, s, c) if n else (None, 0) for n, s, c in zip(rows["n_words"].tolist(), sources, clusters)]
    out = rows.assign(doc_id=rows["doc_id"].astype("Int64").mask(rows["_no_id"]))
    out["bin_id"] = pd.array([None if b is None else base + b for b, _ in found], dtype="Int64")
    out["start"] = np.array([s for _, s in found], np.int64)
    return out


def _dealt(cut: DataFrame, group_rows: int) -> DataFrame:
    """Pieces with a hash group each; the groups are packed apart. Null ids are 0 and marked, as pandas would make all ids floats."""
    groups = max(1, -(-cut.count() // group_rows))
    dealt = cut.withColumn("_group", bucket_of("doc_id", "cluster", "piece", buckets=groups)).withColumn("_no_id", F.col("doc_id").isNull())
    return dealt.withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("long")))


def pack(docs: DataFrame, capacity: int = 2048, group_rows: int = 4096, max_per_source: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per piece: doc_id, source, cluster, piece, n_words, bin_id, start.

    No bin exceeds capacity, holds two pieces of a cluster (equal texts, or the same document),
    or more than max_per_source pieces of a source; null is a source like others. Pieces are
    dealt by hash into groups of about group_rows that are packed apart, largest first, so a hot
    source or cluster is spread over all groups; only the last bins of a group stay loose.
    Pieces without words get no bin (null). An empty table gives no rows.
    """
    cut = materialise(pieces(docs, capacity, id_col, text_col, source_col), "pack-pieces")
    names = ["doc_id", "source", "cluster", "piece", "n_words", "bin_id", "start"]

    def best_fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _placed(rows, capacity, max_per_source, int(key[0]) << 32)[names]

    return _dealt(cut, group_rows).groupBy("_group").applyInPandas(best_fit, "doc_id long, source string, cluster long, piece long, n_words long, bin_id long, start long")


SEQUENCE = "bin_id long, n_words long, doc_ids array<long>, sources array<string>, pieces array<long>, starts array<long>, lengths array<long>, text string"


def packed_sequences(docs: DataFrame, capacity: int = 2048, group_rows: int = 1024, max_per_source: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The bins of `pack` as sequences: one row per bin, with its words as text.

    doc_ids, sources, pieces, starts and lengths list, in order of start, what the bin holds;
    words starts[k] to starts[k] + lengths[k] of text are those of piece pieces[k] of document
    doc_ids[k]. Documents without words are rows of their own with a null bin_id, so that every
    row of docs is found in some row. The texts move once, with their pieces.
    """
    cut = materialise(pieces(docs, capacity, id_col, text_col, source_col, texts=True), "pack-pieces")

    def best_fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        placed = _placed(rows, capacity, max_per_source, int(key[0]) << 32).sort_values(["bin_id", "start"], kind="stable")
        loose = placed["bin_id"].isna()
        number = placed["bin_id"].fillna(-1).astype("int64") if not loose.any() else pd.Series(np.where(loose, -1 - np.arange(len(placed)), placed["bin_id"].fillna(0).astype("int64")), placed.index)
        out = []
        for b, held in placed.groupby(number, sort=True):
            ids = [None if pd.isna(x) else int(x) for x in held["doc_id"]]
            sources = [None if pd.isna(x) else x for x in held["source"]]
            out.append((b if b >= 0 else None, int(held["n_words"].sum()), ids, sources, held["piece"].tolist(), held["start"].tolist(), held["n_words"].tolist(), " ".join(held["text"])))
        got = pd.DataFrame(out, columns=[x.split()[0] for x in SEQUENCE.split(", ")])
        return got.astype({"bin_id": "Int64"})

    return _dealt(cut, group_rows).groupBy("_group").applyInPandas(best_fit, SEQUENCE)
