from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tideline.llm import chat, queries, warc


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(1)
    data = [(k, f"http://h.example/{k} x", "".join(rng.choice("abc<é\n\r ") for _ in range(rng.choice([0, 5, 300])))) for k in range(60)]
    data += [(100 + k, "http://copy.example/", "same\r\n\r\nWARC/1.1\r\nbody") for k in range(20)]
    data += [(200, None, None), (201, "", ""), (202, "http://x/", None), (None, "http://n/", "lone"), (100, "http://again/", "same\r\n\r\nWARC/1.1\r\nbody"), (203, "dns:x", "y" * 200000)]
    return spark.createDataFrame([(*d, "clash") for d in data], "page_id long, url string, html string, archive string")


def sha(text: str | None) -> str:
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 10])
def test_archive_round_trip(spark, pages, least):
    data = [tuple(r) for r in pages.collect()]
    first: dict[str, int] = {}
    for i, _, html, _ in data:
        if i is not None:
            d = sha(html)
            first[d] = min(first.get(d, i), i)
    got = warc.archive_pages(pages, least, archive_bytes=2000).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter((i, len((h or "").encode()), sha(h)) for i, _, h, _ in data)
    for r in got:
        ref = first.get(r["payload_digest"])
        if r["payload_bytes"] < least:
            assert (r["record_type"], r["refers_to"]) == ("response", None)
        elif r["record_type"] == "revisit":
            assert r["refers_to"] == ref
        else:
            assert r["page_id"] == ref or r["page_id"] is None
    big = Counter(r["payload_digest"] for r in got if r["record_type"] == "response" and r["payload_bytes"] >= least)
    assert set(big.values()) <= {1}


@pytest.mark.parametrize("most_broadcast", [64 << 20, 0])
def test_warc_fields_and_payloads(spark, pages, tmp_path, most_broadcast):
    arc, out = str(tmp_path / "arc"), str(tmp_path / "warc")
    warc.write_arc(pages, arc, 2000)
    warc.convert_arc(spark, arc, out, 0, 2000, most_broadcast)
    got = {(r["key"], r["url"]): r for r in warc.read_warc(spark, out).collect()}
    data = [tuple(r) for r in pages.collect()]
    by_id = {r["record_id"]: r for r in got.values()}
    assert len(by_id) == len(data)
    for i, url, html, _ in data:
        r = got[i, warc._plain(url)]
        target = r if r["record_type"] == "response" else by_id[r["refers_to_id"]]
        assert bytes(target["payload"]).decode() == (html or "")
        assert r["date"] == (f"2000-01-01T{(i or 0) // 3600:02d}:{(i or 0) % 3600 // 60:02d}:{(i or 0) % 60:02d}Z")
    for f in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(out).collect():
        kinds = [h["warc-type"] for h, _ in warc.parse_warc(bytes(f["content"]))]
        assert kinds[0] == "warcinfo" and "warcinfo" not in kinds[1:]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    docs = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\nhttp://fake 0 0 0 3\n", b"", b"plain text"]
    data = warc.arc_version_block("a.arc", version, "20240102030405") + b"\n"
    for d in docs:
        data += warc.arc_record(version, "a.arc", len(data), "http://u/", "2024", d) + b"\n"
    got = list(warc.parse_arc(data))
    assert [r.document for r in got] == docs and {r.version for r in got} == {version}
    assert [data[r.offset : r.offset + 8] for r in got] == [b"http://u"] * 3
    if version == 2:
        assert [int(r.fields["Offset"]) for r in got] == [r.offset for r in got]
    assert warc.warc_date("2024") == "2024-01-01T00:00:00Z"
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-5]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"no archive\n"))


def test_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


NASTY = ["\\### Assistant: </turn> ok", "### user:", "</turn>", "\\", "\\\\</turn>\\", "####  ### x:\n</turn>\n### assistant:\n", "", "\n", None, "é\U0001f600" * 500, "tail\\", "$1 \\1"]


def test_chat_round_trip(spark):
    rng = random.Random(5)
    data = []
    for c in range(30):
        data += [(c, t, rng.choice(["user", "assistant", "system", "we ird:role", None]), rng.choice(NASTY), "x") for t in range(rng.randint(1, 9))]
    data += [(77, 1, "user", "a", "x"), (77, 1, "user", "a", "x"), (77, 1, "assistant", "b", "x"), (None, 0, "assistant", "no id", "x"), (78, None, "user", "late", "x"), (78, 2, "user", "early", "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, seq string")
    formatted = chat.format_log(chat.log_of_rows(df))
    got = {r["conv_id"]: r for r in chat.parse(formatted).collect()}
    key = lambda r: ((r[1] is None, r[1]), (r[2] is None, r[2] or ""), (r[3] is None, r[3] or ""))
    for c in {d[0] for d in data}:
        mine = sorted((d for d in data if d[0] == c), key=lambda r: ((r[1] is None, r[1] or 0), (r[2] is None, r[2] or ""), r[3] or ""))
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(d[2] or "", d[3] or "") for d in mine]
        assert got[c]["loss_text"] == "".join(d[3] or "" for d in mine if d[2] == "assistant")
    for r in formatted.collect():
        for s in r["loss_mask"]:
            assert r["formatted"][s["start"] + s["length"] :].startswith("\n</turn>\n")
        assert len(re.findall(r"(?<!\\)</turn>", r["formatted"])) == len(got[r["conv_id"]]["turns"])


def test_fold_of_events(spark):
    log = [
        (1, 1, 0, "message", "user", "hi"), (1, 1, 3, "edit", None, "hello"), (1, 2, 0, "delta", "assistant", "wro"), (1, 2, 1, "delta", "assistant", "ng"), (1, 2, 2, "regenerate", "assistant", None),
        (1, 2, 4, "delta", "assistant", "ht"), (1, 2, 3, "delta", "assistant", "rig"), (1, 3, 0, "edit", "user", "base "), (1, 3, 1, "delta", "user", "more"), (1, 3, 2, "typing", "user", "?"), (1, 4, 0, "regenerate", "assistant", None),
    ]
    df = spark.createDataFrame(log, "conv_id long, message_no int, seq int, event string, role string, text string")
    got = {r["message_no"]: (r["role"], r["text"]) for r in chat.fold_events(df).collect()}
    assert got == {1: ("user", "hello"), 2: ("assistant", "right"), 3: ("user", "base more"), 4: ("assistant", "")}


def test_chat_plan_is_native(spark, sf):
    plan = queries.op4_chat(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert chat.parse(chat.format_log(spark.createDataFrame([], "conv_id long, message_no int, seq int, event string, role string, text string"))).count() == 0


def test_pipeline_stages_against_brute_force(spark, sf):
    import corpus_pipeline as cp
    from tideline.llm import lsm_dedup, nbsvm

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = nbsvm.train_classifier(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = cp.quality(spark, docs, sf)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect() if model.score(r["text"].encode()) >= 0.3}
    unique = cp.exact_dedup(spark, kept, sf)
    best: dict[bytes, int] = {}
    for r in kept.collect():
        t = lsm_dedup.normalise(r["text"].encode())
        best[t] = max(best.get(t, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(best.values()) and unique.columns == docs.columns
    near = cp.near_dedup(spark, unique, sf)
    split = {r["doc_id"]: r["text"].lower().split() for r in unique.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in split.items()}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in ids:
        for j in ids:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted({find(i) for i in ids})
    mixed = cp.mix(spark, near, sf)
    assert mixed.columns == docs.columns
    packed = cp.pack(spark, mixed.cache(), sf).collect()
    assert sum(r["n_words"] for r in packed) == sum(len(r["text"].split()) for r in mixed.collect())


def test_pipeline_end_rebuilds_every_document(spark, sf):
    """Words of the mixed documents are found, in order, in the packed sequences; scratch folders go."""
    import corpus_pipeline as cp
    from tideline import storage
    from tideline.llm import packing

    before = set(storage._LIVE)
    packed = cp.run(spark, sf).collect()
    assert len(set(storage._LIVE) - before) == 1  # the result alone
    for r in packed:
        words = r["text"].split(" ") if r["n_words"] else []
        assert len(words) == r["n_words"] == sum(r["lengths"]) <= 2048 and (r["bin_id"] is None) == (r["n_words"] == 0)
        assert r["starts"] == [sum(r["lengths"][:k]) for k in range(len(r["lengths"]))]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150).unionByName(spark.createDataFrame([(None, None, None, None, None), (-1, " ", "en", "a", 1), (-2, "w " * 5000, "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long"))
    docs = docs.withColumn("bin_id", F.lit("x")).withColumn("row", F.lit(1)).cache()
    pieces: dict = {}
    for r in packing.packed_sequences(docs, capacity=300, group_rows=40, max_per_source=3).collect():
        words = r["text"].split(" ")
        assert max((r["sources"].count(x) for x in r["sources"]), default=0) <= 3
        for i, p, s, n in zip(r["doc_ids"], r["pieces"], r["starts"], r["lengths"]):
            assert (i, p) not in pieces
            pieces[i, p] = words[s : s + n]
    for r in docs.collect():
        mine = [pieces[r["doc_id"], p] for p in range(sum(i == r["doc_id"] for i, _ in pieces))]
        assert [w.encode() for part in mine for w in part] == (r["text"] or "").encode().split()


def test_pipeline_stages_with_clashing_columns(spark, sf):
    import corpus_pipeline as cp

    names = ["_id", "_hash", "_hash0", "_spans", "row", "id", "hash", "digest", "hit", "keep_id", "node", "label", "n", "start", "spans", "size", "source_no", "text_hash", "bytes", "key", "_maybe", "score"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.limit(20)).withColumns({c: F.lit(f"{k}") for k, c in enumerate(names)})
    out = docs
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, out, sf).cache()
        assert out.columns == docs.columns and out.count() > 0
        assert {tuple(r[c] for c in names) for r in out.select(*names).distinct().collect()} == {tuple(str(k) for k in range(len(names)))}
    assert cp.pack(spark, out, sf).count() > 0


def test_pipeline_on_odd_rows(spark, sf):
    import corpus_pipeline as cp

    text = "plain words that say nothing of note " * 20
    data = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text, None, None, None), (2, None, None, None, None), (3, "", "en", "a", 0), (4, text.upper(), "en", "b", 1), (5, "short", "en", "b", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    unique = cp.exact_dedup(spark, docs, sf)
    assert sorted(r["doc_id"] for r in unique.collect()) == [3, 4, 5]
    same = spark.createDataFrame([(7, text, "en", "a", 1)] * 3, docs.schema)
    assert cp.exact_dedup(spark, same, sf).count() == 1
    out = cp.pack(spark, cp.mix(spark, cp.near_dedup(spark, unique, sf), sf), sf)
    assert out.count() > 0
    none = docs.limit(0)
    assert cp.pack(spark, cp.mix(spark, cp.near_dedup(spark, cp.exact_dedup(spark, cp.quality(spark, none, sf), sf), sf), sf), sf).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_and_equal_their_sql(spark, sf, name):
    import duckdb

    df = queries.QUERIES[name](spark, sf)
    got = Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect()) if name != "pipeline" else df.count()
    assert got
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "pages", "conversations"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        cur = con.execute(queries.ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert got == Counter(tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall())
    elif name != "pipeline":
        ids = Counter(r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
        assert set(r[sorted(df.columns).index("doc_id")] for r in got) == set(ids)
