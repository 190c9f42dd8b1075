import collections
import hashlib
import io
import random
import re
import textwrap
import zlib

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logtide.llm import audio, decontaminate, langid, licenses, line_dedup, mixing, near_duplicates, warc
from logtide.llm.components import components

from tests.llm.conftest import SF, pairs


def check_mix(rows, texts):
    sizes = collections.Counter()
    for source, text in texts:
        sizes[source] += len(brute.words(text))
    want, took = brute.source_targets(sizes), collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        took[r.source] += r.taken
    for s in sizes:
        assert abs(took[s] - want[s]) <= 3, (s, took[s], want[s])


def test_mix(spark, documents):
    texts = [(r.source, r.text) for r in documents.collect()]
    first = mixing.mix(documents).collect()
    check_mix(first, texts)
    again = mixing.query(spark, SF).collect()
    assert {(r.doc_id, r.taken) for r in first} == {(r.doc_id, r.taken) for r in again}


def test_mix_cases(spark, hard, nothing):
    mixed = mixing.mix(hard.drop("size", "target", "taken"))
    check_mix(mixed.collect(), [(r.source, r.text) for r in hard.collect()])
    assert mixed.where("size = 0 and taken > 0").count() == 0
    assert mixing.mix(nothing).count() == 0
    clashing = mixing.mix(hard)
    assert clashing.count() == hard.count() and clashing.select("h", "rank", "lam").distinct().collect() == [("clash", "clash", "clash")]
    out = mixing.copies(mixed).groupBy("doc_id").agg(F.sum(mixing.size_of(F.col("text"))).alias("n"))
    want = mixed.groupBy("doc_id").agg(F.sum("taken").alias("n")).where("n > 0")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "", None, "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\ny", "ünï", "z" * 300_000]
    dice = random.Random(1)
    rows = [(i, f"http://h/{i} a\nb" if i % 3 else None, dice.choice(html)) for i in range(300)] + [(None, "u", "x"), (None, None, "<p>a</p>"), (299, "again", "same"), (299, "again", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    for least in (0, 5):
        path = str(tmp_path / f"w{least}")
        warc.write_archive(pages.repartition(3), path, least, records_per_file=40)
        got = warc.read_archive(spark, path).collect()
        assert len(got) == len(rows)
        top = {}
        for i, _, h in rows:
            if i is not None:
                top[h or ""] = max(top.get(h or "", -1), i)
        for r in got:
            if r.record_type == "response":
                assert zlib and len(r.payload) == r.payload_bytes
        by = collections.defaultdict(list)
        for r in got:
            by[r.page_id].append(r)
        import base64

        for i, url, h in rows:
            data = (h or "").encode()
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            r = next(x for x in by[i] if x.payload_digest == digest)
            original = top.get(h or "") if len(data) >= least else None
            revisit = original is not None and (i is None or i < original)
            assert (r.payload_bytes, r.record_type, r.refers_to) == (len(data), "revisit" if revisit else "response", original if revisit else None)
        ids = {(r.record_type, r.page_id, r.payload_digest, r.url): r.record_id for r in got}
        assert len(set(ids.values())) == len(ids)
        responses = {r.record_id for r in got if r.record_type == "response"}
        assert all(r.refers_to_record in responses for r in got if r.record_type == "revisit")
    empty = str(tmp_path / "none")
    warc.write_archive(pages.limit(0), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_warc_moves_no_payload(spark, tmp_path, monkeypatch):
    """A page of 50 MB is read in a stream; beyond the bound on broadcasts the result is the same."""
    rows = [(i, "u", "ab" * 25_000_000 if i == 3 else f"page {i % 4}") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = []
    for bound in (warc.BROADCAST, 0):
        monkeypatch.setattr(warc, "BROADCAST", bound)
        warc.write_archive(pages, str(tmp_path / f"w{bound}"))
        got.append(sorted(map(tuple, warc.read_archive(spark, str(tmp_path / f"w{bound}"), payloads=False).drop("record_id", "refers_to_record").collect())))
    assert got[0] == got[1] and got[0][3][:2] == (3, 50_000_000) and [r[3] for r in got[0]].count("revisit") == 7
    import gzip

    packed = b"".join(gzip.compress(f"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:{i}>\r\nWARC-Payload-Digest: sha1:X\r\nX-Payload-Length: 0\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode()) for i in range(3))
    assert [r[7] for r in warc.parse(packed)] == ["<urn:0>", "<urn:1>", "<urn:2>"]
    with pytest.raises(ValueError):
        list(warc.parse(packed[:-20]))


def leaks(df):
    return [(r.doc_id, (r.n_words, r.n_hit, r.n_items, r.items_sha256)) for r in df.collect()]


def test_winnowing(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute.contaminated(pairs(documents), [(r.item_id, r.text) for r in items.collect()])
    assert dict(leaks(decontaminate.query(spark, SF))) == want
    assert sum(v[1] > 0 for v in want.values()) > 0


def test_winnowing_cases(spark, hard, nothing):
    docs = pairs(hard)
    texts = dict(docs)
    w = texts[100].split()
    items = [(1, " ".join(w[50:75])), (2, " ".join(w[8990:])), (3, "ONE, two!"), (4, None), (5, "..."), (1, " ".join(w[300:310])), (6, texts[70]), (7, " ".join(w[20:29])), (7, "12 34")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    want = collections.Counter((d, v) for d, t in docs for v in [brute.contaminated([(d, t)], items)[d]])
    assert collections.Counter(leaks(decontaminate.contaminated(hard, table))) == want
    left = decontaminate.clean(hard, table)
    assert left.count() == sum(n for (_, v), n in want.items() if not v[1]) and left.columns == hard.columns
    assert decontaminate.contaminated(nothing, table).count() == 0
    assert decontaminate.contaminated(hard, table.limit(0)).where("contaminated").count() == 0


def test_winnowing_by_shuffles(spark, hard, monkeypatch):
    """Items of all lengths, some with windows in common, with all broadcast and with nothing."""
    w = dict(pairs(hard))[100].split()
    items = [(i, " ".join(w[40 * i : 40 * i + 1 + i % 12])) for i in range(60)] + [(i, " ".join(w[40:55])) for i in range(60, 80)] + [(80, "one two"), (81, "One, two")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = collections.Counter((d, v) for d, t in pairs(hard) for v in [brute.contaminated([(d, t)], items)[d]])
    for bound in (decontaminate.BROADCAST_BYTES, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bound)
        assert collections.Counter(leaks(decontaminate.contaminated(hard, table))) == want


def test_winnowing_is_native(spark, documents):
    df = decontaminate.contaminated(documents, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_line_dedup(spark, documents):
    got = {r.doc_id: r.text for r in line_dedup.query(spark, SF).collect()}
    assert got == brute.dedup_lines(pairs(documents))


def test_line_dedup_edits(spark, hard, nothing):
    dice = random.Random(7)
    lines = [" ".join(f"v{dice.randrange(50)}" for _ in range(dice.randrange(3, 26))) for _ in range(25)]
    docs = []
    for d in range(120):
        out = []
        for _ in range(4):
            w = dice.choice(lines).split()
            for _ in range(dice.randrange(3)):
                i = dice.randrange(len(w))
                w[i : i + dice.randrange(2)] = [f"v{dice.randrange(50)}"] * dice.randrange(2)
            out.append("  ".join(w).upper() if dice.random() < 0.2 else " ".join(w))
        docs.append((d, "\n".join(out)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()} == brute.dedup_lines(docs)
    got = line_dedup.dedup_lines(hard)
    unique = list(dict.fromkeys(x for x in pairs(hard) if x[0] is not None))  # repeated rows count as one
    want = brute.dedup_lines([(-1, next(t for d, t in pairs(hard) if d is None)), *unique])
    assert all(r.text == want[-1 if r.doc_id is None else r.doc_id] for r in got.collect())
    assert got.count() == hard.count() and line_dedup.dedup_lines(nothing).count() == 0


def test_lines_of_every_length_and_their_words(spark):
    docs = [(0, "a\nb c\nposted on may 12 by admin\n"), (1, "A \n x b\nposted on may 13 by admin\nB  c"), (2, "posted on may by admin\nposted by may 12 on admin\nq r s t"), (3, "q r s u\n \n")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == {0: docs[0][1], 1: " x b", 2: "posted by may 12 on admin\nq r s t", 3: docs[3][1]} == brute.dedup_lines(docs)
    longer = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, 2, 20).collect()}
    assert longer == {**dict(docs), 1: "A \n x b\nposted on may 13 by admin"}
    nearer = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, 1, 2).collect()}
    assert nearer[3] == " \n" and nearer[1] == " x b"
    for a, b in (("a b c", "a c"), ("a b c", "A  x C"), ("a b", "a b c")):
        assert line_dedup.one_apart(a, b) and line_dedup.one_apart(b, a)
    for a, b in (("a b c", "a b c"), ("a b c", "b a c"), ("a b c d", "a b")):
        assert not line_dedup.one_apart(a, b)


def test_near(spark, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.query(spark, SF).collect()}
    assert got == brute.near_components(pairs(documents))


def test_near_cases(spark, hard, nothing):
    rows = [x for x in pairs(hard) if x[0] is not None]
    want = brute.near_components(rows)
    got = near_duplicates.near_components(hard).collect()
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None) and len(got) == hard.count()
    assert max(collections.Counter(c for _, c in want.values()).values()) > 20
    kept = sorted(r.doc_id for r in near_duplicates.keep_one(hard).where("doc_id is not null").collect())
    assert kept == sorted(d for d, (_, c) in want.items() if c == d)
    assert near_duplicates.near_components(nothing).count() == 0


def test_near_join_lists_every_link(spark, hard, nothing, monkeypatch):
    for part in (near_duplicates.PART, 4):  # 4: lists of many parts
        monkeypatch.setattr(near_duplicates.Index.__init__, "__defaults__", (part,))
        links, rows = near_duplicates.join(hard)
        class_of = collections.defaultdict(set)
        for r in rows.collect():
            class_of[r.sid].add(r.doc_id)
        texts = dict(x for x in pairs(hard) if x[0] is not None)
        sets = {sid: brute.shingles(texts[next(d for d in ids if d is not None)]) for sid, ids in class_of.items() if ids != {None}}
        want = set()
        for x in sets:
            for y in sets:
                common = len(sets[x] & sets[y])
                if x < y and 100 * common >= 80 * (len(sets[x]) + len(sets[y]) - common):
                    want.add((x, y, len(sets[x]), len(sets[y])))
        got = [tuple(r) for r in links.collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
        rows = near_duplicates.near_components(hard).where("doc_id is not null").collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.near_components(list(texts.items()))
    assert near_duplicates.join(nothing)[0].count() == 0


def test_near_long_documents_below_the_threshold(spark):
    """Of documents that share 85 of 100 words and do not link, few pairs are compared on their texts."""
    dice = random.Random(3)
    common, compared = " ".join(f"c{dice.randrange(10**6)}" for _ in range(2550)), {}
    for n in (60, 120, 240):
        docs = [(i, f"{common} " + " ".join(f"d{dice.randrange(10**9)}" for _ in range(450))) for i in range(n)]
        index = near_duplicates.Index(spark.createDataFrame(docs, "doc_id long, text string"))
        assert index.linked.isEmpty()
        for most in near_duplicates.ROUNDS:
            index.round(spark.createDataFrame([], "node long, root long"), most)
        compared[n] = index.answers.count()
    assert all(v <= n for n, v in compared.items()), compared


def test_near_answers_follow_from_leaders(spark):
    """Two groups of near copies whose leaders do not link: most pairs between them need no text."""
    dice = random.Random(5)
    word = lambda: f"w{dice.randrange(10**6)}"
    one = [word() for _ in range(300)]
    two = one[:255] + [word() for _ in range(45)]
    docs = []
    for i in range(60):
        w = list((one, two)[i % 2])
        w[dice.randrange(250)] = word()
        docs.append((i, " ".join(w)))
    index = near_duplicates.Index(spark.createDataFrame(docs, "doc_id long, text string"))
    ids = [r.sid for r in index.rows.orderBy("doc_id").collect()]
    more = [(min(a, b), max(a, b), 296, 296) for a in ids[::2] for b in ids[1::2]]
    counted, links = near_duplicates.derived(spark.createDataFrame(more, "a long, b long, n_a long, n_b long"), near_duplicates.leaders(index.linked), index.answers, index.texts)
    assert links.isEmpty() and counted.count() < len(more) / 10


def test_components(spark):
    dice = random.Random(9)
    edges = [(dice.randrange(300), dice.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in root}


def test_licenses(spark, hard, nothing):
    known = licenses.known_licenses(spark)
    mit = licenses.LICENSES["MIT"]
    odd = "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,").replace("SUBLICENSE", "sub-license") + "\n(c) me"
    docs = spark.createDataFrame([(1, mit), (2, odd), (3, mit + " and more"), (4, None), (5, "..."), (6, licenses.LICENSES["Zlib"].replace("acknowledgment", "acknowledgement"))], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in licenses.scan(docs, known).collect()} == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: "Zlib"}
    assert licenses.scan(hard, known).count() == hard.count() and licenses.scan(nothing, known).count() == 0
    assert len({r.d for r in known.select(licenses.digest(F.col("text")).alias("d")).collect()}) == len(licenses.LICENSES)


def test_license_files(spark):
    wrap = lambda text, n: "\n".join("\n".join(textwrap.wrap(p, n)) for p in text.split("\n"))
    mit, isc, bsd = (licenses.LICENSES[x] for x in ("MIT", "ISC", "BSD-3-Clause"))
    isc_file = """ISC License

Copyright (c) 2004-2010 by Internet Systems Consortium, Inc. ("ISC")
Copyright 1995 Someone

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

""" + wrap(isc.split("\n\n")[1], 70)
    texts = {
        "ISC": [isc_file, isc_file.replace("\n", "\r\n"), *("Copyright (c) 2020 A\n" + wrap(isc, n) for n in (40, 60, 72, 100))],
        "MIT": [f"{t}\n\nCopyright (c) 2020 Someone\nAll rights reserved.\n\n{wrap(mit, n)}\n" for t in ("MIT License", "The MIT License (MIT)", "SPDX-License-Identifier: MIT") for n in (50, 78)],
        "BSD-3-Clause": [f"{t}\n\nCopyright (c) 2020, The Authors.\nAll rights reserved.\n\n{wrap(bsd, 79)}" for t in ("BSD 3-Clause License", 'The 3-Clause "New" or "Revised" BSD License', "")],
        **{k: ["Copyright The Owners\n" + licenses.LICENSES[k]] for k in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "LGPL-2.1")},
        None: ["MIT License", "All rights reserved.", f"MIT License\n\n{mit}\n\nand more", licenses.LICENSES["GPL-3.0"][:9000]],
    }
    rows = [(i, name, text) for i, (name, text) in enumerate((k, t) for k, v in texts.items() for t in v)]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()}
    assert got == {i: name for i, name, _ in rows}


def license_files():
    """(license_id, text) of files as people write them, and of texts that are none."""
    wrap = lambda text, n: "\n".join("\n".join(textwrap.wrap(p, n)) for p in text.split("\n"))
    mit, bsd3, bsd2, apache = (licenses.LICENSES[x] for x in ("MIT", "BSD-3-Clause", "BSD-2-Clause", "Apache-2.0"))
    owned = bsd3.replace("the copyright holder nor", "Example University nor").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS").replace("THE COPYRIGHT HOLDER OR", "THE REGENTS OR")
    bullets = bsd3.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
    short = apache[: apache.index("END OF TERMS AND CONDITIONS")]
    wrapped = "Copyright (c) 2012-2020 The Example Project, its very many authors,\n  contributors and friends in several countries"
    return [
        ("MIT", f"The MIT License (MIT)\n\n{wrapped}\n\n{wrap(mit, 70)}"), ("MIT", f"example-project\n===============\n\nCopyright (c) 2020 Someone\n\n{wrap(mit, 78)}\n"),
        ("MIT", f"(C) 2011-2020, Foo\n\n{mit.replace(chr(34), chr(8220))}"), ("MIT", f"MIT Licence\n\n{mit}"), ("MIT", f"Example, a small library.\nAll rights reserved.\n\n{mit}"),
        ("BSD-3-Clause", f"Copyright (c) 1990 Example University\nAll rights reserved.\n\n{owned}"), ("BSD-3-Clause", bullets), ("BSD-3-Clause", bsd3.replace("1. ", "a) ").replace("2. ", "b) ").replace("3. ", "c) ")),
        ("BSD-2-Clause", f"{wrapped}\n\n{wrap(bsd2.replace('1. ', '- ').replace('2. ', '- '), 60)}"),
        ("Apache-2.0", apache), ("Apache-2.0", short), ("Apache-2.0", short + "END OF TERMS AND CONDITIONS\n"), ("Apache-2.0", "Copyright 2020 Someone\n" + short.replace("http://", "https://")),
        ("GPL-3.0", licenses.LICENSES["GPL-3.0"].split("END OF TERMS")[0]), ("ISC", "Example\n\n" + licenses.LICENSES["ISC"]),
        (None, mit + "\n\nand one more condition"), (None, bsd3.replace("without specific prior written permission", "at all")), (None, "words " * 41 + mit), (None, wrapped), (None, "see the copyright notice"), (None, ""), (None, None),
    ]


def test_license_files_of_many_kinds(spark):
    """The files are found, and the SQL of the query says the same."""
    files = license_files()
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(files)], "doc_id long, text string")
    rows = licenses.scan(docs, licenses.known_licenses(spark)).collect()
    assert {r.doc_id: r.license_id for r in rows} == {i: name for i, (name, _) in enumerate(files)}
    with duckdb.connect() as c:
        c.execute("create table documents (doc_id bigint, text varchar)")
        c.executemany("insert into documents values (?, ?)", list(enumerate(t for _, t in files)))
        assert sorted(c.execute(licenses.oracle()).fetchall()) == sorted((r.doc_id, r.canonical_sha256, r.license_id) for r in rows)


def test_licenses_are_met_by_their_own_words(spark):
    texts = [licenses.LICENSES[k] for k in licenses.LICENSES]
    plain = [" ".join(re.findall("[a-z]+", t.lower())) for t in texts]
    starts, anchors = licenses.met_by(plain)
    assert all(any(a in t for a in anchors) for t in plain) and all(any(t.startswith(s) for s in starts) for t in plain) and len(anchors) < 5
    assert licenses.met_by(["a short text"])[1] == []
    tiny = spark.createDataFrame([("tiny", "Do as you like.")], "license_id string, text string")
    docs = spark.createDataFrame([(1, "do as you like"), (2, "no")], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in licenses.scan(docs, tiny).collect()} == {1: "tiny", 2: None}
    assert licenses.scan(docs, tiny.limit(0)).where("license_id is null").count() == 2


def test_audio_round_trip(spark, hard, nothing):
    got = {(r.doc_id, r.n_bytes): r for r in audio.media_digests(hard).collect()}
    for d, text in pairs(hard):
        data = (text or "").encode()
        padded = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[d, len(data)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_sha256 == hashlib.sha256(audio.to_wav(padded)).hexdigest() and r.media_bytes == len(audio.to_wav(padded))
    assert audio.media_digests(nothing).count() == 0
    import wave

    with wave.open(io.BytesIO(audio.to_wav(b"abc"))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(9)) == (1, 1, 8000, b"abc")


def test_audio_features():
    t = np.arange(8000) / 8000
    tone = np.where((t > 0.3) & (t < 0.6), np.sin(2 * np.pi * 1000 * t), 0)
    mel, spans = audio.features((128 + 100 * tone).astype(np.uint8).tobytes())
    assert len(spans) == 1 and abs(spans[0][0] * audio.HOP / audio.TARGET - 0.3) < 0.04 and abs(spans[0][1] * audio.HOP / audio.TARGET - 0.6) < 0.04
    centre = 700 * (10 ** (np.linspace(2595 * np.log10(1 + 40 / 700), 2595 * np.log10(1 + 3000 / 700), audio.MELS + 2) / 2595) - 1)[1:-1]
    assert abs(centre[mel[spans[0][0] + 3].argmax()] - 1000) < 150
    x = np.sin(2 * np.pi * 500 * t).astype(np.float32)
    y, want = audio.resample(x), np.sin(2 * np.pi * 500 * (np.arange(6000) / 6000 - (audio.TAPS * audio.UP - 1) / 2 / (8000 * audio.UP)))
    assert np.abs(y[100:-100] - want[100:-100]).max() < 0.05
    short = audio.BLOCK
    try:
        whole = audio.features(bytes(range(256)) * 40)[0]
        audio.BLOCK = 7
        assert np.allclose(audio.features(bytes(range(256)) * 40)[0], whole, atol=1e-3)
    finally:
        audio.BLOCK = short


def test_tensors(spark):
    docs = spark.createDataFrame([(1, "hello " * 400), (2, None), (3, "é" * 200_000)], "doc_id long, text string")
    for r in audio.media_digests(docs).collect():
        table = pa.ipc.open_stream(r.tensors).read_all()
        column = table.column("log_mel").combine_chunks()
        assert column.type == audio.tensor_type()
        frames = int(r.feature.split()[0].removeprefix("frames="))
        values = column.to_numpy_ndarray()
        assert values.shape == (-(-frames // audio.STEP), audio.STEP, audio.MELS)
        text = docs.where(F.col("doc_id") == r.doc_id).first().text
        mel, _ = audio.features(audio.payload_of(text)[1])
        assert np.allclose(values.reshape(-1, audio.MELS)[:frames], mel, atol=1e-3)  # threads may sum in another order
        starts, ends = table.column("start_ms").to_pylist(), table.column("end_ms").to_pylist()
        assert starts == [16.0 * audio.STEP * i for i in range(len(starts))] and all(b - a == 272 for a, b in zip(starts, ends))


def test_resampling_in_blocks_is_the_same(monkeypatch):
    x = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    padded = np.concatenate([np.zeros(audio.TAPS - 1), (x.astype(np.float32) - 128) / 128])
    want = [padded[m * audio.DOWN // audio.UP :][: audio.TAPS] @ audio._phases()[m * audio.DOWN % audio.UP] for m in range(5000 * audio.UP // audio.DOWN)]
    for block in (1, 13, 4096):
        monkeypatch.setattr(audio, "BLOCK", block)
        assert np.allclose(audio.resample(x), want, atol=1e-5)


def test_pipeline(spark, documents):
    """Against the plain versions, stage by stage; language is held against its own prediction."""
    docs = {r.doc_id: r for r in documents.collect()}
    prototypes = langid.train(documents.where(~langid.held_out(F.col("doc_id"))))
    spoken = {r.doc_id for r in langid.predict(documents, prototypes).where("lang_pred <> 'und'").collect()}
    texts = {d: docs[d].text for d in spoken}
    lines = brute.dedup_lines(list(texts.items()))
    texts = {d: t for d, t in lines.items() if t == texts[d] or t.strip()}
    texts = one_each(texts)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = brute.contaminated(list(texts.items()), items)
    texts = {d: t for d, t in texts.items() if not bad[d][1]}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.text for r in got} == texts
    assert all(r.n_chars == len(r.text) for r in got)
    check_mix(got, [(docs[d].source, t) for d, t in texts.items()])


def one_each(texts):
    groups = brute.near_components(list(texts.items()))
    return {d: t for d, t in texts.items() if groups[d][1] == d}


def test_pipeline_cases(spark, hard, nothing, tmp_path):
    from logtide.llm.common import saved

    docs = hard.select(corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), "stage")
        assert docs.columns[:5] == corpus_pipeline.COLUMNS
    assert docs.count() > 10
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), "stage")
    assert docs.count() == 0


def test_long_texts_are_hashed_in_blocks():
    from logtide.llm import shingles

    text = "ab cd " * 400_000 + "x" * 3_000_000 + " yy zz ab cd"
    data, size = text.encode(), shingles.BLOCK
    hashes, starts = shingles.words(data)
    whole, at = shingles._words(np.frombuffer(data, np.uint8))
    assert len(data) > 2 * size and (hashes == whole).all() and (starts == at).all()
    sets = list(shingles.shingle_sets(["a b c d e f", text, None, "a B", "A  b\n"]))
    assert [len(s) for s, _ in sets] == [2, len(shingles.shingle_set(text)), 0, 1, 1] and (sets[3][0] == sets[4][0]).all()
    assert all((s == shingles.shingle_set(d.decode())).all() for s, d in sets)


@pytest.mark.parametrize("n", [5_120, 10_240])
def test_entries_are_dealt_to_asking_parts_only(spark, n):
    """A list with one outsider: rows grow with its entries, not with entries times parts."""
    lists = spark.range(n).selectExpr("7L list", "id sid", "(100L << 32) + id place", "cast(id div 512 as int) part")
    roots = spark.range(n - 1).selectExpr("id node", "0L root")
    rows = near_duplicates.dealt(lists, roots)
    parts = n // 512
    assert rows.where("not asks").count() == n and rows.where("asks").count() == parts
    assert rows.where("not asks").select("mine").distinct().count() == 1


def test_variants_of_a_very_long_line_come_in_batches(spark):
    words = [f"w{i % 977}" for i in range(400_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-7], "other", *words[-6:]])), (3, "short line of its own")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_gone) for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1][1] == 0 and got[2] == ("", 1) and got[3] == ("short line of its own", 0)


def test_windows_of_a_very_long_text(spark):
    dice = random.Random(9)
    vocabulary = [f"w{i}" for i in range(5_000)]
    words = [dice.choice(vocabulary) for _ in range(300_000)]
    items = [("a", " ".join(words[505:525])), ("b", " ".join(words[1020:1030])), ("c", " ".join(words[299_990:])), ("d", " ".join(words[509:514])), ("e", words[77] + " " + words[78])]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "clean words only")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id string, text string")).collect()}
    five, two = words[509:514], words[77:79]
    hit = {*range(505, 525), *range(1020, 1030), *range(299_990, 300_000)}
    hit |= {i + j for i in range(299_996) if words[i] == five[0] and words[i : i + 5] == five for j in range(5)}
    hit |= {i + j for i in range(299_999) if words[i] == two[0] and words[i + 1] == two[1] for j in range(2)}
    assert (got[1].n_words, got[1].n_items, got[1].n_hit) == (300_000, 5, len(hit)) and not got[2].contaminated


def test_archive_files_are_bounded_by_bytes(spark, tmp_path):
    """Many small pages and then large ones in one task: no file holds more than its bytes, unless it is one page."""
    import gzip

    dice = random.Random(3)
    sizes = [100] * 3_000 + [200_000] * 60 + [3_000_000] * 5
    rows = [(i, f"http://example.org/{i}", "".join(dice.choices("abcdefgh ", k=50)) * (n // 50)) for i, n in enumerate(sizes)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = f"file://{tmp_path}/warc"
    warc.write_archive(pages, path, file_bytes=2 << 20)
    inflated = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "warc").glob("*.gz")]
    assert max(inflated) < 3_100_000 and sorted(n for n in inflated if n > 2 << 20) == sorted(n for n in inflated if n > 2_900_000)
    assert warc.read_archive(spark, path, payloads=False).where("record_type = 'response'").count() == len(rows)
