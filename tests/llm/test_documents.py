"""Operators on documents against brute force on a small fixture with nulls, ties, repeats and long texts."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import fertility, lsm_dedup, mixing, nbsvm, packing, sharding, simhash, trie_tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, digest string, value string, _n long, bucket string"


def rows() -> list[tuple]:
    rng = random.Random(7)
    vocab = ["alpha", "Beta", "gamma", "délta", "eps", "zeta|", "###", "ünder", "the", "of"]
    out = []
    for i in range(120):
        n = rng.choice([0, 1, 3, 40, 80, 200])
        out.append((i, " ".join(rng.choice(vocab) for _ in range(n)), rng.choice(["en", "de", None, "xx"]), rng.choice(["a", "b", None, "\U0001f600", "z"]), n))
    base = " ".join(rng.choice(vocab) + str(rng.randrange(50)) for _ in range(300))
    out += [(200 + k, base.upper() if k % 2 else base, "en", "hot", 1) for k in range(40)]
    out += [(300 + k, base.replace("alpha", "omega", k), "en", "hot", 1) for k in range(6)]
    out += [(400, None, None, None, None), (401, "", "en", "a", 0), (402, " \n\t ", "en", "a", 3), (403, "word " * 30000, "en", "long", 1), (404, "x" * 50000, "en", "long", 1)]
    out += [(5, out[5][1], "en", "a", 1), (5, out[5][1], "en", "a", 1), (None, "no id", "en", "a", 1), (None, "no id", "en", "a", 1), (405, "line\nline\nother\n\nline", "en", "a", 1)]
    return [(*r, "x", "k", "d", "v", 1, "b") for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize(("keep", "digest_bytes"), [("largest", 32), ("smallest", 32), ("largest", 1)])
def test_exact_dedup(docs, keep, digest_bytes):
    groups: dict[str, list] = {}
    for r in rows():
        groups.setdefault(lower(r[1]), []).append(r[0])
    pick = max if keep == "largest" else min
    want = Counter()
    for text, ids in groups.items():
        best = pick([i for i in ids if i is not None], default=None)
        for i in ids:
            want[i, best, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = lsm_dedup.exact_dedup(docs, keep=keep, digest_bytes=digest_bytes, memtable_rows=10).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_dedup_index_grows(spark, docs):
    keyed = lsm_dedup.text_digests(docs.where("doc_id < 100")).withColumnRenamed("sha", "digest")
    more = lsm_dedup.text_digests(docs.where("doc_id >= 100")).withColumnRenamed("sha", "digest")
    index = lsm_dedup.DigestIndex(spark, "smallest", 16)
    index.insert(keyed)
    level = {bytes(r["digest"]): r["keep_id"] for r in index.compact().collect()}
    for limit in (64 << 20, 16):
        index.filter_bytes = limit
        for r in index.probe(more).collect():
            assert r["keep_id"] == level.get(bytes(r["digest"]))
    index.insert(more)
    assert index.compact().count() == len({lower(r[1]) for r in rows() if r[0] is not None})


def test_hits_come_through_the_filters(spark, docs, monkeypatch):
    keyed = lsm_dedup.text_digests(docs).withColumnRenamed("sha", "digest").cache()
    groups = Counter(lower(r[1]) for r in rows())
    for keep, most in (("smallest", 64 << 20), ("largest", 8)):
        index = lsm_dedup.DigestIndex(spark, keep, 16, most)
        index.insert(keyed)
        hits = index.may_repeat(keyed).where("hit").count()
        repeated = sum(n for n in groups.values() if n > 1)
        assert repeated <= hits and (most < 100 or hits < repeated + 5)
        level = index.compact().collect()
        assert len(level) == len(groups) and {r["copies"] for r in level} == set(groups.values())
    monkeypatch.setattr(lsm_dedup.DigestIndex, "hit_filters", lambda self: ([], []))
    assert lsm_dedup.exact_dedup(docs).where("kept").count() == len(rows())  # filters that hold nothing: every row is unique


def test_unique_rows(spark, docs, empty):
    for keep, pick in (("smallest", min), ("largest", max)):
        want: dict[str, list] = {}
        for r in rows():
            want.setdefault(lower(r[1]), []).append(r[0])
        got = lsm_dedup.unique_rows(docs, keep=keep, memtable_rows=10)
        assert got.columns == docs.columns
        assert Counter((r["doc_id"], lower(r["text"])) for r in got.collect()) == Counter((pick([i for i in ids if i is not None], default=None), t) for t, ids in want.items())
    assert lsm_dedup.unique_rows(empty).count() == 0


def test_unique_rows_with_colliding_digests(spark, monkeypatch):
    bad = spark.createDataFrame([(bytearray(hashlib.sha256(b"same").digest()),)], "digest binary")
    monkeypatch.setattr(lsm_dedup, "verified_collisions", lambda *a: bad)
    df = spark.createDataFrame([(1, "same"), (2, "SAME"), (3, "other"), (3, "other"), (4, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"] or "") for r in lsm_dedup.unique_rows(df, keep="largest").collect()) == [(2, "SAME"), (3, "other"), (4, "")]


def test_bloom_filter_has_no_false_negative():
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(500)]
    bits = lsm_dedup.filter_bits(digests)
    assert lsm_dedup.may_contain(bits, digests).all()
    assert lsm_dedup.may_contain(bits, [hashlib.sha256(b"n%d" % k).digest() for k in range(2000)]).mean() < 0.05
    small = lsm_dedup.within([bits, bits], 300)
    assert sum(map(len, small)) <= 300 and all(lsm_dedup.may_contain(f, digests).all() for f in small)


def brute_fingerprint(text: str | None, width: int) -> int:
    w = words(lower(text))
    parts = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fp: list[int], ids: list, bits: int) -> list:
    label = list(range(len(fp)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least: dict[int, int | None] = {}
    for k, i in enumerate(ids):
        root = find(k)
        old = least.get(root)
        least[root] = i if old is None else old if i is None else min(old, i)
    return [least[find(k)] for k in range(len(fp))]


@pytest.mark.parametrize("bits", [4, 9])
def test_simhash(docs, bits):
    data = rows()
    got = simhash.near_duplicates(docs, 4, bits).collect()
    fp = [brute_fingerprint(r[1], 4) for r in data]
    want = Counter((r[0], f"{f:016x}", c) for r, f, c in zip(data, fp, brute_components(fp, [r[0] for r in data], bits)))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


def test_simhash_random_fingerprints_with_hot_keys(spark):
    rng = random.Random(3)
    centers = [rng.getrandbits(64) for _ in range(40)]
    fp = {c for c in centers}
    for c in centers[:8]:
        for _ in range(60):
            x = c
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fp.add(x)
    fp = sorted(fp)
    signed = [x - (1 << 64) if x >> 63 else x for x in fp]
    frame = spark.createDataFrame([(x, k) for k, x in enumerate(signed)], "fp long, rep long")
    for parts in (simhash.choose_parts(frame, 4), simhash.Parts(simhash.group_bits(0, np.zeros((64, 64)), 3), (1, 1, 0)), simhash.Parts(simhash.group_bits(0, np.zeros((64, 64)), 8), (1, -1, 0, 0, 0, -1, 0, -1))):
        loads = {r["key"]: (r["own"], r["probes"]) for r in simhash.key_loads(frame.select("fp"), parts).collect()}
        emitted = Counter((r["key"], r["own"]) for r in simhash.signatures(frame.select("fp"), parts).collect())
        assert loads == {k: (n, emitted[k, False]) for (k, own), n in emitted.items() if own}
        for block in (8192, 16):
            dealt = simhash.dealt_rows(simhash.signatures(frame.select("fp"), parts), simhash.key_loads(frame.select("fp"), parts), block)
            assert dealt.groupBy("key", "pair").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own")).where("own").agg(F.max("n")).first()[0] <= max(2 * block, 40)
            edges = simhash.links(frame, parts, simhash.Link(4), block=block)
            label = {r["node"]: r["label"] for r in simhash.components(edges, local_edges=0).collect()}
            want = brute_components(fp, signed, 4)
            assert [label.get(x, x) for x in signed] == want


def test_pigeonhole_thresholds_cover_the_budget():
    shares = [np.linspace(0.001, 1, 65) for _ in range(4)]
    _, t = simhash.allocate([16] * 4, shares, 10**6, 7)
    assert sum(x + 1 for x in t) == 8
    rng = np.random.default_rng(1)
    both = rng.integers(0, 50, (64, 64))
    groups = simhash.group_bits(100, both + both.T, 5)
    assert sorted(b for g in groups for b in g) == list(range(64))


def test_near_dedup_protects_short_texts(spark):
    rng = random.Random(1)
    data = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(6))) for k in range(300)]
    got = simhash.similar_documents(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert all(r["doc_id"] == r["component_id"] for r in got)


def plain_shingles(text: str | None, width: int) -> set[tuple]:
    w = words(lower(text))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def pure_jaccard_components(data: list[tuple[int, str]], least: float) -> dict[int, int]:
    sets = [plain_shingles(t, 5) for _, t in data]
    label = {i: i for i, _ in data}
    for x, (i, _) in enumerate(data):
        for y in range(x):
            if len(sets[x] & sets[y]) >= least * len(sets[x] | sets[y]):
                a, b = label[i], label[data[y][0]]
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    return label


def test_near_dedup_finds_copies_with_repeated_lines(spark):
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    data = []
    for times in (1, 5, 10, 20):
        for _ in range(6):
            body, line = " ".join(word() for _ in range(104)), " ".join(word() for _ in range(14))
            data += [(len(data), f"{body} {line}"), (len(data) + 1, f"{body} {line}" + f" {line}" * times)]
    for _ in range(12):  # 100 shingles, of which one substitution takes 5
        w = [word() for _ in range(104)]
        data += [(len(data), " ".join(w)), (len(data) + 1, " ".join("new" if k in (20, 50) else x for k, x in enumerate(w)))]
    want = pure_jaccard_components(data, 0.8)
    assert len(set(want.values())) == len(data) // 2
    docs = spark.createDataFrame([(*d, "en", "a", 1) for d in data], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(want.values())


def test_near_dedup_finds_short_near_copies(spark):
    rng = random.Random(21)
    data = []
    for n in (8, 9, 12, 16, 24):
        for _ in range(12):
            words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n + (n + 3) // 5)]
            data += [(len(data), " ".join(words[:n])), (len(data) + 1, " ".join(words[: n + (n - 4) // 4]))]
    want = pure_jaccard_components(data, 0.8)
    assert len(set(want.values())) <= len(data) // 2
    docs = spark.createDataFrame([(*d, "en", "a", 1) for d in data], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert {r["doc_id"] for r in kept} == set(want.values())


def test_near_dedup_equals_pure_jaccard_on_many_borderline_pairs(spark):
    """Hundreds of pairs at 0.8 to 0.9, where 64 bits alone would lose some."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    data = []
    for k in range(300):
        w = [word() for _ in range(rng.randint(40, 160))]
        other = list(w)
        for at in rng.sample(range(len(w)), max(1, len(w) // rng.choice((45, 50, 60)))):
            other[at] = "new"
        data += [(len(data), " ".join(w)), (len(data) + 1, " ".join(other))]
    sets = [plain_shingles(t, 5) for _, t in data]
    pairs = [k for k in range(0, len(data), 2) if 0.8 <= len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) <= 0.9]
    assert len(pairs) >= 150
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == pure_jaccard_components(data, 0.8)
    fp = [simhash.set_fingerprint(simhash.shingle_set(t.encode(), 5)) for _, t in data]
    wide = lambda k: sum((x ^ y).bit_count() for x, y in zip(fp[k], fp[k + 1]))
    assert max(map(wide, pairs)) <= 48
    near = sum((fp[k][0] ^ fp[k + 1][0]).bit_count() <= 14 and wide(k) <= 34 for k in pairs)
    assert near >= 0.9 * len(pairs)  # the fingerprints find most; the prefix filter adds the rest


def test_shingle_sets_and_set_fingerprints():
    for text in (None, "", "A b", "a B c d e", "a b c d e f a b c d e", "word " * 30000):
        assert len(simhash.shingle_set((text or "").encode(), 5)) == len(plain_shingles(text, 5))
    assert simhash.set_fingerprint(simhash.shingle_set(b"a b c d e f g " * 2, 5)) == simhash.set_fingerprint(simhash.shingle_set(b"a b c d e f g " * 9, 5))
    assert simhash.set_fingerprint(np.zeros(0, np.uint64)) == (0, 0)


def test_block_pairs_of_large_groups(spark):
    nodes = spark.range(6000).select(F.lit(0).alias("label"), F.col("id").alias("node"))
    pairs = simhash.compared_blocks(nodes, 2).where("node < 40").select("pair").distinct()
    assert pairs.agg(F.max("pair")).first()[0] > 2**31


@pytest.mark.parametrize("block", [1024, 7])
def test_near_dedup_verifies_similarity(spark, block, monkeypatch):
    rng = random.Random(9)
    data, k = [], 0
    for c in range(12):
        base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(150)] = "new" + str(rng.randrange(1000))
            data.append((k, " ".join(w)))
            k += 1
    data += [(k, data[0][1]), (k + 1, None), (k + 2, ""), (None, data[3][1]), (k, data[0][1])]
    plain = simhash.compared_blocks
    monkeypatch.setattr(simhash, "compared_blocks", lambda nodes: plain(nodes, block))
    got = simhash.similar_documents(spark.createDataFrame(data, "doc_id long, text string")).collect()
    sets = [plain_shingles(t, 5) for _, t in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(data):
        old = least.get(find(i))
        least[find(i)] = d if old is None else old if d is None else min(d, old)
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((d, least[find(i)]) for i, (d, _) in enumerate(data))


def test_mixing(docs):
    mix = mixing.mix_sources(docs, block=64)
    got = mixing.taken_words(mix).collect()
    data = rows()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in data)
    sizes = Counter()
    for r in data:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, mixing.reshared_targets([sizes[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5, 2.0)))
    assert math.isclose(sum(targets.values()), 1.5 * sum(sizes.values()), rel_tol=1e-9)
    taken = Counter()
    for r in mix.documents.join(mix.spans.groupBy("source_no", "row_no").sum("n").withColumnRenamed("sum(n)", "n"), ["source_no", "row_no"]).collect():
        taken[r["source"]] += r["n"]
    for s in order:
        assert targets[s] <= 2 * sizes[s] + 1e-6 and abs(taken[s] - targets[s]) <= 1, s
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    again = mixing.taken_words(mixing.mix_sources(docs.repartition(5), block=64)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_reshared_targets_water_level():
    t = mixing.reshared_targets([100, 1000, 10, 0], [3, 1, 2, 3], 1.5, 2.0)
    assert t[0] == 200 and t[2] == 20 and t[3] == 0 and math.isclose(sum(t), 1665)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 9))
    assert sorted(got.tolist()) == list(range(n))


def test_slots_take_each_block_as_planned():
    plan = mixing.plan_mix([1000, 130, 64, 5], [1500, 260, 100, 7], 64, 3, max_shards=4, min_slots=3)
    got = mixing.draw_slots(plan, np.arange(plan.slots))
    for s, (size, want) in enumerate(zip((1000, 130, 64, 5), (1500, 260, 100, 7))):
        mine = got["source_no"] == s
        assert got["take"][mine].sum() == want
        seen = Counter(zip(got["round"][mine].tolist(), got["block"][mine].tolist()))
        assert set(seen.values()) == {1} and max(b for _, b in seen) <= (size - 1) // 64
    assert len(set(zip(got["shard"].tolist(), got["position"].tolist()))) == plan.slots


def test_mixed_documents_keep_columns_and_words(docs):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    mix = mixing.mix_sources(unique, block=64)
    out = mixing.mixed_documents(unique, mix)
    assert out.columns == unique.columns
    got = out.collect()
    text = {r["doc_id"]: r["text"] for r in unique.collect()}
    assert sum(len(words(r["text"])) for r in got) == sum(r["taken"] for r in mixing.taken_words(mix).collect())
    for r in got:
        assert r["n_chars"] == len(r["text"]) and (r["text"] == text[r["doc_id"]] or set(words(r["text"])) <= set(words(text[r["doc_id"]])))


def test_sharding(docs):
    def jump(key: int, n: int) -> int:
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
        return b

    got = sharding.shard_rows(docs, ["doc_id"], 40).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows())
    by: dict[int, list] = {}
    for r in got:
        h = 42 if r["doc_id"] is None else xxhash.xxh64_intdigest(r["doc_id"].to_bytes(8, "little", signed=True), 42)
        assert (r["shard"], r["grown_shard"]) == (jump(h, 40), jump(h, 41)) and r["grown_shard"] in (r["shard"], 40)
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_jump_hash_moves_little():
    keys = np.random.default_rng(0).integers(0, 2**63, 20000).astype(np.uint64)
    a, b = sharding.jump_hash(keys, 40), sharding.jump_hash(keys, 41)
    assert set(b[a != b]) == {40} and abs((a != b).mean() - 1 / 41) < 0.006
    assert np.bincount(a).max() < 1.25 * len(keys) / 40


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs.select("doc_id", "text"), ["doc_id"], 5, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and set(r[0] for r in back.select("_shard").distinct().collect()) <= set(range(5))


def test_packing(docs):
    got = packing.pack(docs, capacity=256, group_rows=50, max_per_source=3).collect()
    sizes = Counter()
    bins: dict[int, list] = {}
    for r in got:
        sizes[r["doc_id"]] += r["n_words"]
        assert (r["bin_id"] is None) == (r["n_words"] == 0)
        if r["n_words"]:
            bins.setdefault(r["bin_id"], []).append(r)
    want = Counter()
    for r in rows():
        want[r[0]] += len(words(r[1]))
    assert {k: v for k, v in sizes.items() if v} == {k: v for k, v in want.items() if v}
    for held in bins.values():
        held.sort(key=lambda r: r["start"])
        at = 0
        for r in held:
            assert r["start"] == at
            at += r["n_words"]
        assert at <= 256
        assert len({r["cluster"] for r in held}) == len(held)
        assert max(Counter(r["source"] for r in held).values()) <= 3


def test_packing_keeps_large_ids(spark):
    ids = [None, None, 2**60 + 1, 2**60 + 3, -(2**62) - 1]
    df = spark.createDataFrame([(i, f"some words {k}", "a") for k, i in enumerate(ids)], "doc_id long, text string, source string")
    assert Counter(r["doc_id"] for r in packing.pack(df).collect()) == Counter(ids)
    assert Counter(i for r in packing.packed_sequences(df).collect() for i in r["doc_ids"]) == Counter(ids)


def test_best_fit_is_the_tightest_compatible_bin():
    rng = random.Random(2)
    bins, plain = packing.Bins(100, 2), []
    for _ in range(400):
        size, source, cluster = rng.randint(1, 60), rng.randrange(4), rng.randrange(30)
        fits = [b for b in plain if b["room"] >= size and cluster not in b["clusters"] and b["sources"][source] < 2]
        tight = min((b["room"] for b in fits), default=None)
        b, start = bins.place(size, source, cluster)
        if tight is None:
            assert b == len(plain) and start == 0
            plain.append({"room": 100, "clusters": set(), "sources": Counter()})
        else:
            assert plain[b]["room"] == tight and start == 100 - tight
        plain[b]["room"] -= size
        plain[b]["clusters"].add(cluster)
        plain[b]["sources"][source] += 1


def test_quality_rules(docs):
    got = fertility.quality_rules(docs).collect()

    def base(text: str | None) -> tuple:
        w = words(text)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for x in (text or "").split("\n"):
            if words(x):
                dup += x in seen
                seen.add(x)
        return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)

    want = Counter((r[0], *base(r[1])) for r in rows())
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_fertility_against_plain_counts():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=fertility.VOCABULARIES[0])
    held = fertility.WordTokens(fertility.VOCABULARIES)
    text = "Une phrase simple, puis 漢字 et encore une phrase \U0001f600 simple".encode()
    w = text.split()
    n, per, share, bits = fertility.fertility(held.numbers([w])[0], 50, held)
    ids = [t for x in w for t in model.encode(x.decode())]
    c = Counter(ids)
    assert n == len(ids) and per == 50 / n and math.isclose(share, sum(map(model.is_byte, ids)) / n)
    assert math.isclose(bits, -sum(v / n * math.log2(v / n) for v in c.values()))
    import tiktoken

    with open(fertility.VOCABULARIES[1], "rb") as f:
        ranks = {base64.b64decode(x.split()[0]): int(x.split()[1]) for x in f}
    coder = tiktoken.Encoding("own", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
    names = {v: k for k, v in ranks.items()}
    ids = [t for x in w for t in coder.encode_ordinary(" " + x.decode())]
    c = Counter(ids)
    n, per, share, bits = fertility.fertility(held.numbers([w])[0], 50, held, 1)
    broken = sum(v for t, v in c.items() if "\ufffd" in names[t].decode("utf-8", "replace"))
    assert n == len(ids) and per == 50 / n and math.isclose(share, broken / n)
    assert math.isclose(bits, -sum(v / n * math.log2(v / n) for v in c.values()))


SAMPLES = {
    "cyrillic": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "greek": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
    "arabic": "يولد جميع الناس أحرارًا متساوين في الكرامة والحقوق وقد وهبوا عقلاً وضميرًا",
    "hebrew": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם",
    "indic": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है",
    "han": "人人生而自由 在尊严和权利上一律平等 他们赋有理性和良心 并应以兄弟关系的精神相对待",
    "hangul": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다",
    "thai": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ",
    "latin": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience.",
}


def test_scripts_have_bands_of_their_own(spark):
    for name, text in SAMPLES.items():
        assert fertility.script_of(text.encode()) == name
    assert fertility.script_of(b"123 !") == "other" and fertility.script_of("漢字 ab".encode()) == "han"
    assert fertility.script_of("ab 漢".encode()) == "latin"
    data = [(k, t, None) for k, t in enumerate(SAMPLES.values())] + [(99, "\ue000\ue001 \u0378\u0379 " * 20 + "абв", "xx"), (98, "ааа " * 60, None)]
    got = {r["doc_id"]: r["kept"] for r in fertility.quality_rules(spark.createDataFrame(data, "doc_id long, text string, lang string"), min_words=1).collect()}
    assert all(got[k] for k in range(len(SAMPLES))) and not got[99] and not got[98]


def test_verdict_is_base_rules_and_bands(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rejected = 0
    text = {r["doc_id"]: (r["lang"], r["text"] or "") for r in docs.collect()}
    for r in fertility.quality_rules(docs).collect():
        lang, t = text[r["doc_id"]]
        (a, b, c), (d, e, f) = fertility.BANDS.get(lang) or fertility.BANDS[fertility.script_of(t.encode())]
        inside = r["chars_per_token"] >= a and r["byte_share"] <= b and r["token_entropy"] >= c and r["chars_per_token_bytes"] >= d and r["fragment_share"] <= e and r["token_entropy_bytes"] >= f
        assert r["kept"] == (not r["base_failed"] and inside and r["n_tokens"] > 0)
        rejected += inside is False and not r["base_failed"]
    assert rejected
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [r for r in fertility.quality_rules(docs).collect() if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert good and all(r["kept"] for r in good)


def test_repeated_words_with_many_codes():
    codes = np.array([5, 6, 7, 9, 5, 6, 7, 1 << 40, 2])
    assert fertility.repeated_words(codes) == 6


def test_token_counts(docs):
    pieces, byte = trie_tokens.load_pieces(trie_tokens.VOCABULARY)

    def brute(word: str) -> tuple[int, int]:
        x = trie_tokens.SPACE + word
        best = [(0.0, 0, 0)]
        for i in range(1, len(x) + 1):
            n = len(x[i - 1].encode())
            top = (best[i - 1][0] + n * byte, best[i - 1][1] + n, best[i - 1][2] + n)
            for j in range(max(0, i - 64), i):
                s = pieces.get(x[j:i])
                if s is not None and best[j][0] + s > top[0]:
                    top = (best[j][0] + s, best[j][1] + 1, best[j][2])
            best.append(top)
        return best[-1][1:]

    cache: dict[str, tuple[int, int]] = {}
    want = Counter()
    for r in rows():
        found = [cache.setdefault(w, None) or cache.__setitem__(w, brute(w)) or cache[w] for w in words(r[1])]
        want[r[0], len(found), sum(f[0] for f in found), sum(f[1] for f in found)] += 1
    got = trie_tokens.token_counts(docs, most_held=200).collect()
    assert Counter(map(tuple, got)) == want


def test_trie_scores_shared_prefixes_once():
    pieces, byte = trie_tokens.load_pieces(trie_tokens.VOCABULARY)
    trie = trie_tokens.UnigramTrie(pieces, byte)
    trie.insert([b"readers", b"reading", b"rest"])
    assert trie.nodes_scored == 8 + 3 + 2  # the space mark and "readers"; "ing"; "st"
    long = trie_tokens.UnigramTrie(pieces, byte, depth=8)
    for word in (b"x" * 20000, "caf\u00e9\u6f22".encode() * 3000, b"readers"):
        assert long.tokens(word) == trie_tokens.UnigramTrie(pieces, byte, depth=10**6).tokens(word)
    small = trie_tokens.UnigramTrie(pieces, byte, most_held=100)
    for k in range(2000):
        small.tokens(b"w" * 500 + str(k).encode())
    assert len(small.terminal) <= 20


def test_classifier_learns_and_scores_all(spark, docs):
    rng = random.Random(4)
    good = [(1000 + k, " ".join(rng.choice(["plain", "prose", "reads", "well", "and", "flows"]) + rng.choice(["", "ly", "."]) for _ in range(60))) for k in range(150)]
    bad = [(2000 + k, " ".join(rng.choice(["buy", "now", "win"]) + "$$$" for _ in range(60))) for k in range(60)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = nbsvm.classify(table, labels).collect()
    assert len(got) == 210
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in good + bad if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([(r["predicted"] == 1) == (r["doc_id"] < 2000) for r in held]) > 0.95
    other = nbsvm.classify(docs, labels).collect()
    assert len(other) == len(rows()) and all(0 <= r["score"] <= 1 for r in other)


def test_features_and_ratios_against_plain_counts():
    text = b"Go go 12\tGo"
    shape = re.sub(rb"[A-Z]+", b"A", re.sub(rb"[a-z\x80-\xff]+", b"a", re.sub(rb"[0-9]+", b"0", text))).replace(b"\t", b" ")
    plain = {(n, text[k : k + n]) for n in (1, 2, 3) for k in range(len(text) - n + 1)}
    runs = {shape[k : k + 4] for k in range(len(shape) - 3)}
    assert len(nbsvm.features(text)) == len(plain) + len(runs)  # no doubled word, no collision
    assert len(set(nbsvm.features(text).tolist())) == len(nbsvm.features(text))
    assert [len(nbsvm.features(t)) for t in (None, b"", b" \n")] == [0, 0, 0]
    rows_, y = [np.array([1, 5]), np.array([5]), np.array([7])], np.array([1, 1, -1])
    r = nbsvm.log_count_ratio(rows_, y)
    p, q = np.ones(nbsvm.DIMS), np.ones(nbsvm.DIMS)
    p[1], p[5], q[7] = 2, 3, 2
    assert np.allclose(r, np.log(p / p.sum()) - np.log(q / q.sum()))


def test_held_out_accuracy_and_scores(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in nbsvm.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    known = [(got[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"] and r["quality"] is not None]
    good, bad = [s for s, q in known if q == 1], [s for s, q in known if q == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(good) > 20 and len(bad) > 5 and auc > 0.95
    model = nbsvm.train_classifier(docs, labels)
    for r in docs.limit(50).collect():
        x = nbsvm.features((r["text"] or "").encode())
        z = model.slope * (sum(model.weights[k] for k in x.tolist()) / math.sqrt(max(1, len(x))) + model.bias) + model.offset
        assert math.isclose(got[r["doc_id"]]["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-9)
        assert got[r["doc_id"]]["predicted"] == (got[r["doc_id"]]["score"] >= 0.3)


def test_fit_is_bounded_and_repeats(spark, docs):
    table = docs.where("doc_id < 100").unionByName(docs.where("doc_id < 100").withColumn("text", F.lit("other words")))
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(100)], "doc_id long, quality int, toxic int")
    for bound in ({"max_rows": 30}, {"max_bytes": 9000}):
        a, b = (nbsvm.train_classifier(t, labels, **bound) for t in (table, table.repartition(7, "text")))
        assert np.array_equal(a.weights, b.weights) and (a.bias, a.slope, a.offset) == (b.bias, b.slope, b.offset)


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = [np.array(sorted(rng.choice(12, 4, replace=False))) for _ in range(80)]
    y = np.where([(a < 6).sum() >= 2 for a in x], 1, -1)
    w, b = nbsvm.dual_coordinate_descent(x, np.full(nbsvm.DIMS, 2.0), y, np.ones(80), 300, 1)

    def primal(w, b):
        return 0.5 * (w @ w + b * b) + sum(max(0.0, 1 - t * (w[i].sum() + b)) for i, t in zip(x, y))

    best = primal(w, b)
    for _ in range(300):
        d = rng.normal(0, 0.02, len(w)) * (np.arange(len(w)) < 12)
        assert primal(w + d, b + rng.normal(0, 0.02)) >= best - 0.02


def test_no_labels_gives_the_prior(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = nbsvm.classify(docs, labels).collect()
    assert {r["score"] for r in got} == {0.5} and {r["predicted"] for r in got} == {1}


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for frame in (
        lsm_dedup.exact_dedup(empty), simhash.near_duplicates(empty), mixing.taken_words(mixing.mix_sources(empty)), sharding.shard_rows(empty, ["doc_id"], 4),
        packing.pack(empty), fertility.quality_rules(empty), trie_tokens.token_counts(empty), nbsvm.classify(empty, labels),
    ):
        assert frame.count() == 0
    assert mixing.mixed_documents(empty, mixing.mix_sources(empty)).count() == 0


def test_quality_fit_has_five_folds_at_every_size(monkeypatch):
    sizes = []
    plain = nbsvm.dual_coordinate_descent
    monkeypatch.setattr(nbsvm, "dual_coordinate_descent", lambda rows, *a: sizes.append(len(rows)) or plain(rows, *a))
    nbsvm.fit([np.array([k % 2, 2 + k % 7]) for k in range(3010)], [k % 2 for k in range(3010)], epochs=1)
    assert sizes == [2408] * 5 + [3010]
