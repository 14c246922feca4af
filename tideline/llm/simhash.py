"""SimHash near-dedup by the generalised pigeonhole principle (Qin et al., GPH).

Two fingerprints within `max_bits` of each other are, for any grouping of the bits into parts
and any part thresholds t with sum(t + 1) = max_bits + 1, within t of each other in some part.
Correlated bits go into the same part; the thresholds, and the number of parts, are those of
least cost by dynamic programming on candidate counts estimated from all fingerprints. Each
fingerprint is filed under its own key in each part and probes the keys within the threshold;
what meets under a key is verified on all bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ._shared import materialise, sliced, utf8

BITS = 64
#: Cost of one filed or probing row against one verified pair.
ROW_COST, PAIR_COST = 1.0, 0.003


def shingles(text: bytes | None, width: int) -> Iterator[list[bytes]]:
    """Shingles of lower-cased words, repeats included, some thousands at a time; fewer words: the whole sequence."""
    words = text.lower().split() if text else []
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= width:
        yield [joined]
        return
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[: len(words) - width] + 1]
    ends = ends[width - 1 :]
    for k in range(0, len(starts), 8192):
        yield [joined[s:e] for s, e in zip(starts[k : k + 8192].tolist(), ends[k : k + 8192].tolist())]


def _ones(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _packed(majority: np.ndarray) -> int:
    return int(np.packbits(majority, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, width: int) -> int:
    """Majority bits of the XXH64 of all shingles, repeats included."""
    n, ones = 0, np.zeros(BITS, np.int64)
    for part in shingles(text, width):
        h = np.array([xxhash.xxh64_intdigest(s, 42) for s in part], np.uint64)
        n += len(h)
        ones += _ones(h)
    return _packed(ones * 2 > n)


class _WordCodes(dict):
    """XXH64 of words, each hashed once while the table is below its bound."""

    def __init__(self, most: int = 100_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, width: int, codes: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of lower-cased words; fewer words than width are one shingle.

    A shingle's hash mixes its words' hashes by place, so a word is hashed once, not once a shingle.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    codes = _WordCodes() if codes is None else codes
    code = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    used = min(width, len(words))
    h = np.full(len(code) - used + 1, used, np.uint64)
    for k in range(used):
        h = _mix64(h + code[k : len(code) - used + 1 + k])
    return np.unique(h)


def _majority(hashes: np.ndarray) -> int:
    return _packed(sum((_ones(hashes[k : k + 65536]) for k in range(0, len(hashes), 65536)), np.zeros(BITS, np.int64)) * 2 > len(hashes))


def set_fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """Majority bits of a set of shingle hashes, 128 in two words: repeated lines count once."""
    return _majority(hashes), _majority(_mix64(hashes ^ np.uint64(0x9E3779B97F4A7C15)))


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) per row. Null and wordless texts have fingerprint zero."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), _signed([fingerprint(x, width) for x in utf8(b.column(1))])], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(scan, "doc_id long, fp long")


def set_fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, fp2, size, node) per row; size counts distinct shingles, node is the hash of the text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _WordCodes()
        for b in sliced(batches):
            sets = [shingle_set(x, width, codes) for x in utf8(b.column(1))]
            fp = [set_fingerprint(x) for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), _signed([f[0] for f in fp]), _signed([f[1] for f in fp]), pa.array([len(x) for x in sets], pa.int32()), b.column(2)], names=["doc_id", "fp", "fp2", "size", "node"])

    node = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).cast("long"), F.col(text_col), node).mapInArrow(scan, "doc_id long, fp long, fp2 long, size int, node long")


@dataclass(frozen=True)
class Parts:
    bits: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]  # -1: the part is not used


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all of them."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, BITS * BITS), pa.int64()), pa.array([n, *both.ravel().tolist()])], names=["k", "v"])

    got = distinct.select("fp").mapInArrow(partial, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()
    both = np.zeros(BITS * BITS, np.int64)
    n = 0
    for k, v in got:
        if k < 0:
            n = v
        else:
            both[k] = v
    return n, both.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> tuple[tuple[int, ...], ...]:
    """Greedy groups of equal width: each starts from the free bit of least balance and takes its most correlated bits."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    free, out = list(range(BITS)), []
    for g in range(parts):
        width = len(free) // (parts - g)
        own = [min(free, key=lambda b: (abs(p[b] - 0.5), b))]
        free.remove(own[0])
        while len(own) < width:
            own.append(max(free, key=lambda b: (corr[b, own].mean(), -b)))
            free.remove(own[-1])
        out.append(tuple(sorted(own)))
    return tuple(out)


def part_keys(fp: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """The part's bits of each fingerprint, packed."""
    key = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        key |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return key


def distance_counts(distinct: DataFrame, groupings: list[tuple[tuple[int, ...], ...]]) -> dict[tuple[int, int], np.ndarray]:
    """Per grouping and part, how often two fingerprints are d apart in the part.

    Every fingerprint is compared with four others of its batch, so all of them count and the
    work is linear.
    """
    masks = {(g, k): np.uint64(sum(1 << b for b in bits)) for g, grouping in enumerate(groupings) for k, bits in enumerate(grouping)}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {gk: np.zeros(BITS + 1, np.int64) for gk in masks}
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            for step in (1, 7, 61, 509):
                if len(x) > step:
                    diff = x[step:] ^ x[:-step]
                    for gk, m in masks.items():
                        total[gk] += np.bincount(np.bitwise_count(diff & m), minlength=BITS + 1)
        rows = [(g, k, d, int(v)) for (g, k), t in total.items() for d, v in enumerate(t) if v]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(4)], names=["g", "k", "d", "v"])

    out = {gk: np.zeros(BITS + 1) for gk in masks}
    got = distinct.select("fp").mapInArrow(partial, "g long, k long, d long, v long").groupBy("g", "k", "d").agg(F.sum("v").alias("v")).collect()
    for g, k, d, v in got:
        out[g, k][d] = v
    return out


def ball(width: int, t: int) -> int:
    """Keys of a part within t of one key."""
    return sum(comb(width, d) for d in range(t + 1))


def allocate(widths: list[int], shares: list[np.ndarray], n: int, max_bits: int) -> tuple[float, tuple[int, ...]]:
    """Thresholds of least cost with sum(t + 1) = max_bits + 1, by dynamic programming over the parts.

    shares[k][d]: estimated share of pairs that are at most d apart in part k.
    """
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for width, share in zip(widths, shares):
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (cost, taken) in best.items():
            for t in range(-1, min(width, max_bits - used) + 1):
                own = 0.0 if t < 0 else ROW_COST * ball(width, t) + PAIR_COST * n * share[t]
                at = used + t + 1
                if at <= max_bits + 1 and (at not in step or cost + own < step[at][0]):
                    step[at] = (cost + own, (*taken, t))
        best = step
    return best[max_bits + 1]


def choose_parts(distinct: DataFrame, max_bits: int) -> Parts:
    n, both = bit_counts(distinct)
    groupings = [group_bits(n, both, m) for m in range(2, max(3, min(10, max_bits + 2)))]
    counts = distance_counts(distinct, groupings)
    found = []
    for g, grouping in enumerate(groupings):
        shares = []
        for k, bits in enumerate(grouping):
            c = counts[g, k] + np.array([comb(len(bits), d) / 2.0 ** len(bits) for d in range(BITS + 1)])
            shares.append(np.cumsum(c) / c.sum())
        cost, thresholds = allocate([len(b) for b in grouping], shares, n, max_bits)
        found.append((cost, -len(grouping), Parts(grouping, thresholds)))
    return min(found, key=lambda x: x[:2])[2]


def _flips(bits: tuple[int, ...], t: int) -> np.ndarray:
    """Packed keys' differences of 1 to t bits."""
    return np.array([sum(1 << k for k in c) for d in range(1, t + 1) for c in combinations(range(len(bits)), d)], np.uint64)


def _key_of(part: int, key: np.ndarray) -> np.ndarray:
    """Part and key as one number; a part has at most 32 bits."""
    return (key | np.uint64(part) << np.uint64(32)).view(np.int64)


def signatures(rows: DataFrame, parts: Parts) -> DataFrame:
    """rows (fp first) with key and own: each fingerprint under its own key of each part and, own = false, under those it probes."""
    flips = [_flips(b, t) if t > 0 else np.zeros(0, np.uint64) for b, t in zip(parts.bits, parts.thresholds)]
    names = [*rows.columns, "key", "own"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, 400_000 // max(1, sum(len(f) + 1 for f in flips)))
            for b in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                fp = b.column(0).to_numpy().view(np.uint64)
                for part, (bits, t) in enumerate(zip(parts.bits, parts.thresholds)):
                    if t < 0:
                        continue
                    own = part_keys(fp, bits)
                    key = np.concatenate([own, (own[:, None] ^ flips[part][None, :]).ravel()])
                    held = [c.to_numpy() for c in b.columns]
                    held = [pa.array(np.concatenate([c, np.repeat(c, len(flips[part]))])) for c in held]
                    yield pa.RecordBatch.from_arrays([*held, pa.array(_key_of(part, key)), pa.array(np.arange(len(key)) < len(own))], names=names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(emit, f"{schema}, key long, own boolean")


def key_loads(distinct: DataFrame, parts: Parts) -> DataFrame:
    """(key, own, probes): exact numbers of fingerprints filed and probing under each key.

    Fingerprints are counted per own key first; only the counts are spread to the keys that they probe.
    """
    used = [k for k, t in enumerate(parts.thresholds) if t >= 0]
    flips = {k: _flips(parts.bits[k], parts.thresholds[k]) for k in used}

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for k in used:
                yield pa.RecordBatch.from_arrays([pa.array(_key_of(k, part_keys(fp, parts.bits[k])))], names=["key"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                key, n = (whole.column(k).slice(at, 2000).to_numpy() for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(np.zeros(len(n), np.int64))], names=["key", "own", "probes"])
                for k in used:
                    mine = key >> 32 == k
                    near = (key[mine].view(np.uint64)[:, None] ^ flips[k][None, :]).ravel().view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(np.zeros(len(near), np.int64)), pa.array(np.repeat(n[mine], len(flips[k])))], names=["key", "own", "probes"])

    own = distinct.select("fp").mapInArrow(filed, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return own.mapInArrow(spread, "key long, own long, probes long").groupBy("key").agg(F.sum("own").alias("own"), F.sum("probes").alias("probes")).where("own > 0")


@dataclass(frozen=True)
class Link:
    """When two rows of a bucket link. Rows have fp and, for the other two conditions, fp2 and size."""

    max_bits: int
    all_bits: int | None = None  # of both words
    least: float | None = None  # of the smaller size against the larger

    @property
    def columns(self) -> list[str]:
        return ["fp", *(["fp2"] if self.all_bits is not None else []), *(["size"] if self.least is not None else [])]

    def near(self, c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray | int) -> np.ndarray:
        d = np.bitwise_count(c["fp"][i] ^ c["fp"][j]).astype(np.int64)
        ok = d <= self.max_bits
        if self.all_bits is not None:
            ok &= d + np.bitwise_count(c["fp2"][i] ^ c["fp2"][j]) <= self.all_bits
        if self.least is not None:
            n, m = c["size"][i], c["size"][j]
            ok &= np.minimum(n, m) >= self.least * np.maximum(n, m) - 1e-9
        return ok


def _forest(c: dict[str, np.ndarray], rows: np.ndarray, own: np.ndarray, link: Link) -> list[tuple[int, int]]:
    """Edges that join what is linked in one bucket, at most one per row.

    Breadth first: a row is compared only with rows not reached yet, so a dense group costs
    about one comparison a row. Probes are not compared with probes.
    """
    edges = []
    left = rows
    for root in rows[own[rows]]:
        if not (left == root).any():
            continue
        left = left[left != root]
        queue = [root]
        while queue and len(left):
            x = queue.pop()
            near = link.near(c, left, x)
            if not own[x]:
                near &= own[left]
            hit = left[near]
            edges += [(root, h) for h in hit.tolist()]
            queue += hit.tolist()
            left = left[~near]
    return edges


def _bucket_links(bucket: np.ndarray, c: dict[str, np.ndarray], own: np.ndarray, link: Link) -> np.ndarray:
    """Linked pairs of row numbers, 2 x n, among rows sorted by bucket."""
    found = [np.zeros((2, 0), np.int64)]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, len(bucket)])
    small = np.repeat(sizes <= 8, sizes)
    for shift in range(1, min(8, len(bucket))):
        k = np.flatnonzero((bucket[shift:] == bucket[:-shift]) & small[shift:] & (own[shift:] | own[:-shift]))
        k = k[link.near(c, k, k + shift)]
        found.append(np.stack([k, k + shift]))
    for s, n in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist()):
        if own[s : s + n].any():
            found.append(np.array(_forest(c, np.arange(s, s + n), own, link), np.int64).reshape(-1, 2).T)
    return np.concatenate(found, axis=1)


def dealt_rows(rows: DataFrame, loads: DataFrame, block: int, by: str = "fp") -> DataFrame:
    """Rows with the `pair` of blocks that they are compared in; blocks are dealt by the hash of `by`.

    Under a key of more than `block` rows, filed and probing ones are dealt into blocks apart.
    Filed blocks meet each other and every probing block; probes never meet probes.
    """
    cut = lambda n: F.ceil(F.col(n) / (block // 2)).cast("int")
    hot = materialise(loads.where(F.col("own") + F.col("probes") > block).select("key", cut("own").alias("_a"), cut("probes").alias("_b")), "simhash-hot")
    if not hot.limit(1).count():
        return rows.withColumn("pair", F.lit(0).cast("long"))
    a, b, wide = F.coalesce("_a", F.lit(1)), F.coalesce("_b", F.lit(0)), F.lit(1 << 31)
    mine = F.pmod(F.xxhash64(by), F.when(F.col("own"), a).otherwise(F.greatest(b, F.lit(1)))).cast("long")
    filed = F.transform(F.sequence(F.lit(0), a - 1), lambda o: F.least("_mine", o) * wide + F.greatest("_mine", o))
    probed = F.transform(F.sequence(F.lit(1), b), lambda o: F.col("_mine") * wide + a + o - 1)
    met = F.when(F.col("own"), F.concat(filed, F.when(b > 0, probed).otherwise(F.array().cast("array<bigint>")))).otherwise(F.transform(F.sequence(F.lit(0), a - 1), lambda o: o * wide + a + F.col("_mine")))
    placed = rows.join(hot, "key", "left").withColumn("_mine", F.when(F.col("_a").isNotNull(), mine).otherwise(F.lit(0).cast("long")))
    # Keys that are not hot have one pair, number 0.
    return placed.withColumn("pair", F.explode(F.when(F.col("_a").isNull(), F.array(F.lit(0).cast("long"))).otherwise(met))).select(*rows.columns, "pair")


def linked_in_buckets(dealt: DataFrame, link: Link, name: str) -> DataFrame:
    """(a, b): enough linked pairs of `name`, a < b, to connect all that link under one key and pair."""
    columns = ["key", "pair", "own", name, *[c for c in link.columns if c != name]]
    dealt = dealt.select(*columns).repartition("key", "pair").sortWithinPartitions("key", "pair")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []

        def out() -> pa.RecordBatch:
            c = dict(zip(columns, (np.concatenate(x) for x in zip(*kept))))
            new = np.r_[True, (c["key"][1:] != c["key"][:-1]) | (c["pair"][1:] != c["pair"][:-1])]
            words = {k: v.view(np.uint64) if k in ("fp", "fp2") else v for k, v in c.items()}
            a, b = c[name][_bucket_links(np.cumsum(new), words, c["own"], link)]
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

        for rb in batches:
            if not rb.num_rows:
                continue
            cols = [rb.column(k).to_numpy(zero_copy_only=False) for k in range(len(columns))]
            last = len(cols[0]) - 1
            first = int(np.argmax((cols[0] == cols[0][last]) & (cols[1] == cols[1][last])))
            if kept and (kept[-1][0][-1], kept[-1][1][-1]) != (cols[0][0], cols[1][0]):
                yield out()
                kept = []
            if first:
                kept.append([c[:first] for c in cols])
                yield out()
                kept = []
            kept.append([c[first:] for c in cols])
        if kept:
            yield out()

    return dealt.mapInArrow(verify, "a long, b long").where("a != b").distinct()


def links(rows: DataFrame, parts: Parts, link: Link, name: str = "fp", block: int = 8192) -> DataFrame:
    """(a, b) of `name`: enough links to connect all fingerprints that have one.

    No bucket of more than `block` rows, filed and probing together, meets in one task.
    """
    used = rows.select(*link.columns, *([] if name in link.columns else [name]))
    return linked_in_buckets(dealt_rows(signatures(used, parts), key_loads(used, parts), block, name), link, name)


def _gathered(rows: Iterator[tuple], names: list[str], enough: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Batches of rows of (hashes, number, ...), a row for each hash."""
    rows, held, n = iter(rows), [], 0
    while (row := next(rows, None)) is not None or held:
        if row is not None:
            held.append(row)
            n += len(row[0])
        if row is None or n >= enough:
            first = np.concatenate([r[0] for r in held]).view(np.int64)
            size = [len(r[0]) for r in held]
            more = [np.repeat(np.array([r[k] for r in held], np.int64), size) for k in range(1, len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (first, *more)], names=names)
            held, n = [], 0


def level_of(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte: exact to 127, then by eighths of a doubling."""
    n = np.maximum(counts, 1).astype(np.float64)
    return np.where(counts < 128, counts, np.minimum(255, 128 + 8 * np.log2(n / 128))).astype(np.uint8)


def count_of(levels: np.ndarray) -> np.ndarray:
    x = levels.astype(np.float64)
    return np.where(levels < 128, x, 128 * 2 ** ((x - 128) / 8)).astype(np.int64)


def shingle_levels(source: DataFrame, width: int, bits: int, slice_bits: int = 16) -> np.ndarray:
    """For each of 2^bits slots of shingle hashes, how many sets' shingles fall into it, over all texts, as a byte.

    A task counts into slots and passes them on in slices, so what is shuffled and what comes to
    the driver is bounded by the number of slots, not of shingles.
    """
    slices, each = 1 << (bits - slice_bits), 1 << slice_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n, codes = np.zeros(1 << bits, np.uint32), [], 0, _WordCodes()

        def add() -> None:
            slot, times = np.unique(np.concatenate(held) >> np.uint64(64 - bits), return_counts=True)
            total[slot] += times.astype(np.uint32)

        for b in sliced(batches):
            for text in utf8(b.column(0)):
                held.append(shingle_set(text, width, codes))
                n += len(held[-1])
                if n > 500_000:
                    add()
                    held, n = [], 0
        if held:
            add()
        for k in range(slices):
            part = total[k * each : (k + 1) * each]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level_of(part).tobytes()], pa.binary())], names=["slice", "levels"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(each, np.int64)
        for b in batches:
            for x in b.column(1):
                total += count_of(np.frombuffer(x.as_py(), np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([level_of(total).tobytes()], pa.binary())], names=["slice", "levels"])

    found = source.select("text").mapInArrow(count, "slice int, levels binary").groupBy("slice").applyInArrow(merge, "slice int, levels binary")
    out = np.zeros(1 << bits, np.uint8)
    for k, levels in found.toLocalIterator():
        out[k * each : (k + 1) * each] = np.frombuffer(levels, np.uint8)
    return out


def prefix_links(docs: DataFrame, nodes: DataFrame, width: int, least: float, all_bits: int, bits: int = 22, block: int = 8192, text_col: str = "text") -> DataFrame:
    """(a, b) of nodes: enough pairs to connect every two texts whose Jaccard similarity is `least` or more.

    Two such sets of n and m shingles share one of the first n - ceil(least n) + 1 and
    m - ceil(least m) + 1 in any common order (prefix filter). The order here is by the level of
    a shingle's slot, so that common shingles come last, and then by hash; every task has the
    same levels, whose size is fixed, and cuts its prefixes itself. What meets under a shingle
    links where sizes allow the similarity and the 128-bit fingerprints differ in at most
    all_bits. nodes: (node, fp, fp2, size). Wordless texts have no shingle.
    """
    source = docs.select(F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(shingle_levels(source, width, bits))

    def prefix(text: bytes | None, codes: dict) -> np.ndarray:
        own = shingle_set(text, width, codes)
        level = held.value[own >> np.uint64(64 - bits)]
        return own[np.argsort(level, kind="stable")[: len(own) - ceil(least * len(own) - 1e-9) + 1]]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _WordCodes()
        rows = ((prefix(text, codes), node) for b in sliced(batches) for text, node in zip(utf8(b.column(0)), b.column(1).to_pylist()))
        yield from _gathered((r for r in rows if len(r[0])), ["key", "node"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of sorted keys that have several."""
        last = [np.zeros(0, np.int64)] * 2
        for b in batches:
            key, node = (np.concatenate([x, b.column(k).to_numpy()]) for k, x in enumerate(last))
            same = key[1:] == key[:-1]
            # The last row of a batch waits for the next; the first was passed on if its key came before.
            meets = np.r_[False, same] | np.r_[same, False]
            if len(key) and len(last[0]) and sent:
                meets[0] = False
            sent = bool(len(key) > 1 and same[-1])
            upto = len(key) if sent else len(key) - 1
            last = [x[-1:] for x in (key, node)]
            keep = np.flatnonzero(meets[:upto])
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[keep])], names=["key", "node"])

    rows = source.withColumn("node", F.xxhash64(F.coalesce("text", F.lit("")))).mapInArrow(emit, "key long, node long")
    rows = rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(shared, "key long, node long")
    rows = materialise(rows.join(nodes.select("node", "fp", "fp2", "size"), "node").withColumn("own", F.lit(True)), "simhash-prefixes")
    loads = rows.groupBy("key").agg(F.count(F.lit(1)).alias("own")).withColumn("probes", F.lit(0).cast("long"))
    return linked_in_buckets(dealt_rows(rows, loads, block, "node"), Link(BITS, all_bits, least), "node")


def similar_forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges that join rows whose sets have a Jaccard similarity of at least `least`; breadth first, at most one a row."""
    size = np.array([len(x) for x in sets])
    left, edges = np.arange(len(sets)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            at = np.flatnonzero(np.minimum(size[left], size[x]) >= least * np.maximum(size[left], size[x]))
            if not len(at):
                continue
            held = left[at]
            joined = np.concatenate([sets[k] for k in held])
            inside = sets[x][np.minimum(np.searchsorted(sets[x], joined), max(0, len(sets[x]) - 1))] == joined if len(sets[x]) else np.zeros(0, bool)
            ends = np.cumsum(size[held])
            upto = np.r_[0, np.cumsum(inside)]
            both = upto[ends] - upto[ends - size[held]] if len(joined) else np.zeros(len(held), int)
            hit = both >= least * (size[held] + size[x] - both)
            edges += [(x, k) for k in held[hit].tolist()]
            queue += held[hit].tolist()
            left = np.delete(left, at[hit])
    return edges


def compared_blocks(nodes: DataFrame, block: int = 1024) -> DataFrame:
    """Nodes of groups of several, with the `pair` of blocks that they are compared in.

    Groups of more than `block` rows are dealt into blocks; a node has a row for each block
    that its own is compared with. No text is moved for this.
    """
    counts = nodes.groupBy("label").count().where("count > 1").select("label", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = nodes.join(counts, "label").withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("pair", F.least("_mine", "_other").cast("long") * 1_000_000 + F.greatest("_mine", "_other")).drop("_mine", "_other", "blocks")


def verified_links(texts: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b) of nodes: enough similar pairs inside each candidate group to connect all that are.

    texts: (label, pair, node, text); rows of one label and pair are compared.
    """
    dealt = texts.repartition("label", "pair").sortWithinPartitions("label", "pair")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, seen, codes = None, [], set(), _WordCodes()

        def out() -> pa.RecordBatch:
            edges = similar_forest([h[1] for h in held], least)
            return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i, _ in edges], pa.int64()), pa.array([held[j][0] for _, j in edges], pa.int64())], names=["a", "b"])

        for b in batches:
            for label, pair, node, text in ((*x, t) for s in sliced([b]) for *x, t in zip(*(s.column(k).to_pylist() for k in range(3)), utf8(s.column(3)))):
                if (label, pair) != key:
                    if len(held) > 1:
                        yield out()
                    key, held, seen = (label, pair), [], set()
                if node in seen:  # a repeated row
                    continue
                seen.add(node)
                held.append((node, shingle_set(text, width, codes)))
        if len(held) > 1:
            yield out()

    return dealt.mapInArrow(verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (hex), component_id (smallest doc_id reachable).

    Rows link where their fingerprints differ in max_bits or fewer bits; equal texts always do.
    Null and wordless texts share fingerprint zero and link like others. Null ids count only
    where a component has no other: its component_id is then null. An empty table gives no rows.
    """
    rows = materialise(fingerprints(docs, width, id_col, text_col), "simhash-fp")
    reps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    if not reps.limit(1).count():
        return rows.select("doc_id", F.lit("").alias("fingerprint"), F.col("doc_id").alias("component_id"))
    edges = materialise(links(reps, choose_parts(reps, max_bits), Link(max_bits)), "simhash-links")
    labels = components(edges, local_edges=0)
    named = materialise(reps.join(labels, reps["fp"] == labels["node"], "left").select("fp", "rep", F.coalesce("label", "fp").alias("label")), "simhash-labels")
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    ids = materialise(named.join(smallest, "label").select("fp", "component_id"), "simhash-ids")
    return rows.join(ids, "fp").select("doc_id", hexed, "component_id")


def similar_documents(docs: DataFrame, width: int = 5, least: float = 0.8, max_bits: int = 14, all_bits: int = 34, prefix_bits: int = 48, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like near_duplicates, with text_hash, but rows link where the Jaccard similarity of their sets of shingles is `least` or more.

    Fingerprints are of distinct shingles, so lines that one copy repeats do not part them, and
    have 128 bits, so that unrelated texts of a large corpus do not meet by chance. Pairs that
    differ in max_bits of the first word and in all_bits of both are candidates beside those of
    prefix_links, of which prefix_bits of 128 lets all but one similar pair in a million pass.
    The exact similarity alone decides on candidates. Null and wordless texts have equal, empty
    sets and link.
    """
    rows = materialise(set_fingerprints(docs, width, id_col, text_col), "simhash-fp")
    # A node is a distinct text.
    nodes = materialise(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("fp2").alias("fp2"), F.min("size").alias("size"), F.min("doc_id").alias("rep")), "simhash-nodes")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    if not nodes.limit(1).count():
        return rows.select("doc_id", F.lit("").alias("fingerprint"), F.col("doc_id").alias("component_id"), F.col("node").alias("text_hash"))
    near = links(nodes, choose_parts(nodes, max_bits), Link(max_bits, all_bits, least), "node")
    found = materialise(near.unionByName(prefix_links(docs, nodes, width, least, prefix_bits, text_col=text_col)), "simhash-candidates")
    labels = components(found, local_edges=0)
    grouped = materialise(nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label")), "simhash-labels")
    wanted = compared_blocks(grouped).select("label", "pair", "node", "rep")
    source = docs.select(F.col(id_col).cast("long").alias("source_id"), F.col(text_col).alias("text")).withColumn("source_node", F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = wanted.join(source, F.col("rep").eqNullSafe(F.col("source_id")) & (F.col("node") == F.col("source_node"))).select("label", "pair", "node", "text")
    joined = materialise(verified_links(texts, width, least), "simhash-verified")
    final = components(joined, local_edges=0)
    placed = grouped.join(final.withColumnRenamed("label", "group"), "node", "left").select("node", "rep", F.coalesce("group", "node").alias("group"))
    smallest = placed.groupBy("group").agg(F.min("rep").alias("component_id"))
    ids = materialise(placed.join(smallest, "group").select("node", "component_id"), "simhash-ids")
    return rows.join(ids, "node").select("doc_id", hexed, "component_id", F.col("node").alias("text_hash"))


def one_of_each(docs: DataFrame, width: int = 5, least: float = 0.8, max_bits: int = 14, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of the smallest id of each component of similar_documents.

    Rows that repeat id and text all stay. Columns of docs may have any names.
    """
    found = similar_documents(docs, width, least, max_bits, id_col=id_col, text_col=text_col)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_hash").distinct()
    held = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("hash"))
    return held.join(kept, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left_semi").select("row.*")
