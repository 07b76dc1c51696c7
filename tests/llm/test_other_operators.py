"""Archives, mixing, pieces, images, licences, toxicity and reputations, with their odd cases."""

import base64
import hashlib
import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import licenses, media, mixing, pieces, queries, reputation, toxicity, warc
from quern.llm.pieces import PieceModel, decode_pieces, encode_pieces, piece_digests
from tests_support import agrees


def test_archive_round_trip(spark):
    rows = [(i, f"http://h{i % 7}.example.com/p{i % 11}?q={i}", f"<p>{i % 13}</p>" * (i % 5)) for i in range(300)]
    rows += [(1000, None, None), (1001, "no scheme", ""), (1002, "http://a.b/c d\n", "é😀"), (1003, "http://" + "x" * 5000 + "/", "<p>" * 200000), (None, "http://n.example.com/", "<p>1</p>"), (7, rows[7][1], rows[7][2]), (-5, "http://minus.example.com/", "minus")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    archive = warc.CaptureArchive.write(pages, block_lines=16)
    got = warc.read_back(archive, pages).collect()
    by = {}
    for i, _, h in rows:
        if i is not None:
            by[h or ""] = max(by.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = i is None or by[h or ""] == i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else by[h or ""]))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    keyed = pages.where("page_id = 1002").select(warc.capture_key(F.col("page_id"), F.col("url"), F.sha1(F.col("html"))).alias("key"))
    assert archive.lookup(keyed).first().payload == "é😀".encode()
    assert archive.lookup(spark.createDataFrame([("zz",), ("",), (None,)], "key string")).where("record_type IS NOT NULL").count() == 0
    small = warc.read_back(warc.CaptureArchive.write(pages, min_revisit=10**7), pages)
    assert small.where("record_type = 'revisit'").count() == 0
    none = pages.where("false")
    assert warc.read_back(warc.CaptureArchive.write(none), none).count() == 0


def test_damaged_record_raises():
    good = warc.gzip_member(warc._record("response", "1", "u", "D", 3, None, b"abc"))
    assert warc.parse_record(good)[1] == b"abc"
    for bad in (good[:-9], good[:20]):
        with pytest.raises((ValueError, zlib.error)):
            warc.parse_record(bad)


@pytest.fixture(scope="module")
def sized(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 80))), rng.choice(["a", "a", "a", "a", "b", "c", "d", None])) for i in range(6000)]
    rows += [(6000, None, "e"), (6001, "", "a"), (6002, "x " * 3000, "b"), (5, "again five", "b"), (5, "again five", "b"), (None, "no id", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_equals_sql_and_meets_targets(spark, sized):
    mixed = mixing.mix_sources(sized.withColumn("taken", F.lit("clash"))).select("doc_id", "size", "source_size", "target", "taken")
    agrees({"documents": sized}, mixed, queries.oracle_sql()["op2_mix_sources"])
    by = {r.source_size: (r.target, r.taken) for r in mixed.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()}
    for size, (target, taken) in by.items():
        assert target <= 2 * size + 1e-6 and abs(taken - target) <= max(100, 0.02 * target)
    assert mixed.where("taken > 2 * size").count() == 0
    out = mixing.mixed_corpus(sized.withColumn("size", F.lit("kept")))
    assert out.columns == ["doc_id", "text", "source", "size"] and out.where("size = 'kept'").count() == out.count()
    assert out.count() == mixed.where("size > 0").agg(F.sum(F.col("taken") / F.col("size"))).first()[0]
    null_ids = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("a").alias("source"))
    keys = null_ids.select(mixing.shuffle_key(F.col("doc_id"), F.md5(F.col("text").cast("binary")), 17).alias("k"))
    assert keys.groupBy(F.shiftright("k", mixing.KEY_BITS - 4)).count().agg(F.max("count")).first()[0] < 450  # no bucket holds them all
    sums = spark.range(1000).select((F.col("id") * 7 % 1000).alias("o"), (F.col("id") % 3).alias("s"), F.lit(2).cast("long").alias("n"))
    before = {r.o: r.before for r in mixing._before(sums, [], "o", "n", 10).collect()}
    assert before == {i: 2 * i for i in range(1000)}
    per = mixing._before(sums, ["s"], "o", "n", 10).collect()
    assert all(r.before == sum(x.n for x in per if x.s == r.s and x.o < r.o) for r in per)
    assert mixing.mix_sources(sized.where("false")).count() == 0 and mixing.mix_sources(sized.where("text IS NULL")).first().taken == 0


ODD = ["", " ", "  a", "a  b ", "a b ", "\n\n x", "\x00a", "▁x", "▁", " ▁ ", "a\tb", "日本語 ✓ emoji 😀😀", "   ", "é" * 50, "a" * 3000, "1 2  3   4    5     6", "ab▁ cd", "▁▁ q", "x" * 39 + " " + "y" * 45, "Mixed.Case,Words;here:now\r\nnext"]


def test_pieces_equal_the_library(spark, sf):
    path = queries.piece_model()
    m = PieceModel.open(path)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(9000 + i, t) for i, t in enumerate([*ODD, None, ODD[5]])], "doc_id long, text string"))
    rows = docs.collect()
    coded = {r.id: r.ids for r in encode_pieces(docs, path).collect()}
    back = {r.id: r.text for r in decode_pieces(encode_pieces(docs, path), path).collect()}
    digests = {r.doc_id: r for r in piece_digests(docs, path).collect()}
    for r in rows:
        ids = m.library.encode(r.text or "")
        assert coded[r.doc_id] == ids and back[r.doc_id] == m.library.decode(ids)
        d = digests[r.doc_id]
        assert (d.n_tokens, d.ids_sha256, d.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(m.library.decode(ids).encode()).hexdigest())
    clash = docs.withColumn("ids_sha256", F.lit(1)).withColumn("n_tokens", F.lit("x")).withColumn("id", F.lit(0))
    assert {r.doc_id: r.ids_sha256 for r in piece_digests(clash, path).collect()} == {k: r.ids_sha256 for k, r in digests.items()}
    assert piece_digests(docs.where("false"), path).count() == 0


def test_both_agendas_equal_the_library():
    """Short words by rows of a matrix, long ones by an agenda of their own; unbroken texts of some length."""
    m = PieceModel.open(queries.piece_model())
    rng = random.Random(11)
    letters = "etaoinshrdlu'-.éß日本🙂1"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 90))) for _ in range(3000)] + ["a" * n for n in range(1, 60)]
    symbols, at = m.agendas([m.prefix + w for w in words])
    for w, i, j in zip(words, at, at[1:]):
        alone = m.agenda(m.prefix + w)
        assert symbols[i:j].tolist() == alone.tolist()
        ids, _ = m.to_ids(alone, np.array([0, len(alone)]))
        assert ids.tolist() == m.library.encode(w)
    unbroken = "".join(rng.choice(letters) for _ in range(100_000))
    assert m.encode_batch([unbroken, unbroken + " end"])[0].tolist() == m.library.encode(unbroken)
    assert max(map(len, m.cache)) < pieces.SHORT


def test_images(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 64), (-4, "é" * 300000), (-5, "\0")], "doc_id long, text string"))
    stored = media.store_media(docs.withColumn("media", F.lit(1)))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    blobs = {r.id: bytes(r.media) for r in stored.collect()}
    for r in media.media_features(stored).collect():
        raw = texts[r.id]
        want = raw + bytes(64 - len(raw) if not raw else -len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert (r.media_bytes, r.media_sha256, len(r.feature)) == (len(blobs[r.id]), hashlib.sha256(blobs[r.id]).hexdigest(), 8)
    assert media.media_features(media.store_media(docs.where("false"))).count() == 0


def brute_hash(samples):
    """Block means, the cosine transform by its double sum, and the bits above the median."""
    def mean(i, j):
        rows, cols = (([k * n // 32 for k in (x, x + 1)] if n >= 32 else [x * n // 32, x * n // 32 + 1]) for x, n in ((i, samples.shape[0]), (j, samples.shape[1])))
        return samples[rows[0] : rows[1], cols[0] : cols[1]].astype(float).mean()

    small = np.array([[mean(i, j) for j in range(32)] for i in range(32)])
    wave = lambda k, n: np.cos(np.pi * k * (2 * n + 1) / 64)
    low = [round(sum(small[i, j] * wave(u, i) * wave(v, j) for i in range(32) for j in range(32)), 6) for u in range(8) for v in range(8)]
    return np.packbits(np.array(low) > np.median(low)).tobytes()


def test_features_equal_brute_force(spark, sf):
    """Features of stored texts, of lengths around 32 lines and of repeated rows."""
    texts = ["", "a", "abc " * 500, "é" * 1024, "x" * 64 * 31, "yz" * 32 * 33, "one\ntwo " * 900] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(5).collect()]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:3])), "doc_id long, text string").withColumn("feature", F.lit("clash"))
    got = {r.id: bytes(r.feature) for r in media.media_features(media.store_media(docs)).collect()}
    for i, t in enumerate(texts):
        raw = t.encode()
        lines = np.frombuffer(raw + bytes(64 - len(raw) if not raw else -len(raw) % 64), np.uint8).reshape(-1, 64)
        assert got[i] == brute_hash(lines), t[:20]
    assert [got[i] for i in range(3)] == [got[len(texts) + i] for i in range(3)]


def _png(kinds, lines):
    """A PNG whose lines are filtered as told, by the definition."""
    out, prior = b"", [0] * len(lines[0])
    for kind, line in zip(kinds, lines, strict=True):
        row = []
        for j, v in enumerate(line):
            a, b, c = (line[j - 1] if j else 0), prior[j], (prior[j - 1] if j else 0)
            row.append((v - [0, a, b, (a + b) // 2, media._paeth(a, b, c)][kind]) & 255)
        out += bytes([kind, *row])
        prior = line
    z = zlib.compress(out)
    chunks = [(b"IHDR", struct.pack(">IIBBBBB", len(lines[0]), len(lines), 8, 0, 0, 0, 0)), (b"tEXt", b"a\0b"), (b"IDAT", z[:7]), (b"IDAT", z[7:]), (b"IEND", b"")]
    return media.MAGIC + b"".join(media._chunk(k, b) for k, b in chunks)


def test_all_filters_and_checksums():
    rng = np.random.default_rng(2)
    lines = rng.integers(0, 256, (40, 9)).tolist()
    for kinds in ([k] * 40 for k in range(5)):
        assert media.decode_png(_png(kinds, lines)).tolist() == lines
    png = _png(rng.integers(0, 5, 40).tolist(), lines)
    assert media.decode_png(png).tolist() == lines
    for at in range(8, len(png), 11):
        with pytest.raises((ValueError, zlib.error)):
            media.decode_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    x = rng.integers(0, 256, (200, 64)).astype(np.uint8)
    near = np.clip(x.astype(int) + 1, 0, 255).astype(np.uint8)
    bits = lambda h: np.unpackbits(np.frombuffer(h, np.uint8))
    assert (bits(media.cosine_hash(x)) != bits(media.cosine_hash(near))).sum() <= 6


def test_licenses(spark):
    mit = licenses.LICENSES["MIT"]
    texts = ["Copyright (c) 2020 Somebody\n\n" + mit.upper(), mit.replace("sublicense", "sub-license").replace(" ", "\n  "), mit + " or not", "Text.\nReleased under the MIT Licence!\nLicensed under the Apache License, Version 2.0", "", None, "license", "x" * 200000 + "\nSPDX-License-Identifier: MIT"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("license", F.lit(0))
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan_licenses(df).collect()}
    assert got == {0: ("MIT", ""), 1: ("MIT", ""), 2: (None, ""), 3: (None, "Apache-2.0,MIT"), 4: (None, ""), 5: (None, ""), 6: (None, ""), 7: (None, "MIT")}
    assert licenses.scan_licenses(df.where("false")).count() == 0
    many = ["\n\n" + "copyright foo bar\n" * 30000 + mit, "Copyright A\nCopyright one two three four five six seven eight nine ten\nx", "a\n\ncopyright b c\r\n(c) d\ne", "\n \n" * 20000 + "x"]
    long_ = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")
    rows = licenses.scan_licenses(long_)
    assert rows.where("doc_id = 0").first().license == "MIT"
    agrees({"documents": long_}, rows, queries.oracle_sql()["op6_licenses"])


def test_equal_spellings_and_typographic_marks(spark):
    gpl = licenses.LICENSES["GPL-2.0"]
    pairs = [("wilful", "willful"), ("wilfull act", "willfull act"), ("licence licence licence", "license license license"), ("non-commercial non commercial", "noncommercial noncommercial"), ("copyright holder copyright holder", "copyright owner copyright owner"),
             ("\u201cAS IS\u201d \u2014 it\u2019s\u00a0so\u2026", '"as is" - it\'s so...'), ("sub-licence", "sublicense"), (gpl.replace('"', "\u201d").replace("-", "\u2013"), gpl)]
    df = spark.createDataFrame([(2 * n + i, t) for n, p in enumerate(pairs + pairs[:1]) for i, t in enumerate(p)], "doc_id long, text string").withColumn("notices", F.lit(0))
    rows = licenses.scan_licenses(df.union(df.where("doc_id = 3")))  # a repeated row
    found = [r.canonical_sha256 for r in rows.dropDuplicates().orderBy("doc_id").collect()]
    assert found[::2] == found[1::2] and len(set(found)) == len(pairs)
    agrees({"documents": df.union(df.where("doc_id = 3"))}, rows, queries.oracle_sql()["op6_licenses"])


def test_every_licence_line_is_named(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {x for r in docs.collect() for x in (r.text or "").split("\n") if "license" in x.lower()}
    lines |= {"Licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "Licensed under the GPL v2.", "SPDX-License-Identifier: BSD-2-Clause", 'Licensed under the Apache License, Version 2.0 (the "License");'}
    got = {r.doc_id: r.notices for r in licenses.scan_licenses(spark.createDataFrame([(x, x) for x in sorted(lines)], "doc_id string, text string")).collect()}
    assert set(got) == lines and got["Licensed under CC BY-NC 4.0."] == "CC-BY-NC-4.0" and all(got.values())
    digests = licenses.known_digests(spark, licenses.NOTICES)
    assert digests.count() == digests.select("digest").distinct().count()  # no notice names two licences


def test_licence_files(spark):
    titles = {"MIT": "MIT License", "ISC": "ISC License (ISC)", "Zlib": "The zlib License", "0BSD": "BSD Zero Clause License", "Unlicense": "# The Unlicense", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "The BSD 3-Clause License"}
    files = [(f"{k} {i}", f"{head}{licenses.LICENSES[k]}") for k, t in titles.items() for i, head in enumerate(("", f"{t}\n\nCopyright Jane Doe\n\n", f"{t}\nCopyright Jane Doe\nCopyright by A Company, Inc.\n\n", f"{t}\r\n\r\nCopyright (c) 2021, Jane Doe\r\nAll rights reserved.\r\n\r\n", "Copyright Jane Doe <jane@example.com>\n\n", "\n(c) Jane Doe\n\n"))]
    files += [(f"{k} whole", t) for k, t in licenses.LICENSES.items()]
    df = spark.createDataFrame([*files, ("- 0", "MIT License"), ("- 1", "Copyright Jane Doe"), ("- 2", "a\ncopyright holders b")], "doc_id string, text string")
    rows = licenses.scan_licenses(df)
    assert [r for r in rows.collect() if (r.license or "-") != r.doc_id.split()[0]] == []
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0", "BSL-1.0"} <= set(licenses.LICENSES) and "" not in {r.d for r in df.select(licenses.canonical(F.col("text")).alias("d"), "doc_id").where("doc_id NOT LIKE '- %'").collect()}
    agrees({"documents": df}, rows, queries.oracle_sql()["op6_licenses"])


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 50000), (-4, "you 1d10t, st*pid s c u m and w0rthl3ss tra$h cl0wn m0ron")], "doc_id long, text string")
    odd = odd.union(odd.where("doc_id = -4").withColumn("doc_id", F.lit(-5).cast("long"))).union(odd.where("doc_id = -4").select(F.lit(-6).cast("long"), F.repeat(F.concat("text", F.lit(" x1y2 ")), 5000)))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text").union(odd).withColumn("score", F.lit(1)), labels)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    pos, neg = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.8 and sum(r.predicted for r in rows if not r.toxic) <= 0.03 * len(neg)
    got = {r.doc_id: r for r in scored.where("doc_id < 0").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[-4].score > 0.5 > got[-2].score and got[-5].score == got[-4].score  # repeated texts score alike
    assert toxicity.score_toxicity(docs.limit(3), labels.where("false")).where("score <> 0").count() == 0
    assert toxicity.score_toxicity(docs.where("false"), labels).count() == 0
    shuffled = labels.withColumn("toxic", F.when(toxicity.fold_of(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, shuffled).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in toxicity.score_toxicity(docs, labels).collect())  # held-out labels teach nothing


def brute_restore(chars, token):
    """The likeliest of all words that the token may stand for, each path of the lattice spelt out."""
    paths = [("", 0.0)]
    before, run = "", 0
    for c in token:
        run = run + 1 if c == before else 0
        steps = [(c, 0.0 if c.isalpha() else toxicity.KEEP_ODD)] + [(x, toxicity.REPLACE) for x in toxicity.STANDS_FOR.get(c, "")]
        if c in toxicity.DROPPED:
            steps.append(("", toxicity.DROP))
        elif c == before:
            steps.append(("", toxicity.REPEAT[run > 1]))
        paths = [(w + x, cost + more) for w, cost in paths for x, more in steps]
        before = c
    best = {}
    for w, cost in paths:
        s = f"^^{w}$"
        best[w] = max(best.get(w, -1e99), sum(chars.logp(s[i : i + 3]) for i in range(len(s) - 2)) - cost)
    return best


def test_restoring_equals_brute_force():
    rng = random.Random(12)
    words = ("idiot", "stupid", "scum", "loser", "clown", "moron", "trash", "pathetic")
    chars = toxicity.CharModel({g: rng.randrange(5, 90) for w in words for g in (f"^^{w}$"[i : i + 3] for i in range(len(w) + 1))})
    swaps = {"i": "1!i", "o": "0o", "s": "$5s", "t": "7+t", "a": "@4a", "e": "3e", "u": "vu*"}
    for _ in range(300):
        token = "".join(rng.choice(swaps.get(c, c)) * rng.choice((1, 1, 1, 2, 3)) + rng.choice(("", "", "", ".", "-")) for c in rng.choice(words))[:11]
        likely = brute_restore(chars, token)
        assert likely[chars.restore(token)] >= max(likely.values()) - 1e-9, token


def test_scores_equal_brute_force(spark):
    """The query's scores on the small table, put together anew in plain Python from counts by word."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    texts, told = {r.doc_id: r.text or "" for r in docs.collect()}, {r.doc_id: r.toxic for r in labels.collect()}
    crc = lambda i: zlib.crc32(str(i).encode())
    taught = {i: y for i, y in told.items() if i in texts and y in (0, 1) and crc(i) % 5}
    words = {i: toxicity.plain_words(t.lower()) for i, t in texts.items()}
    grams = {}
    for ws in words.values():
        for w in ws:
            for i in range(len(w) + 1):
                g = f"^^{w}$"[i : i + 3]
                grams[g] = grams.get(g, 0) + 1
    chars = toxicity.CharModel(grams)

    def evidence(ids):
        n = [sum(taught[i] == y for i in ids) for y in (0, 1)]
        count = {}
        for i in ids:
            for w in words[i]:
                count.setdefault(w, [0, 0])[taught[i]] += 1
        out, xl = {}, lambda *xs: sum(x * np.log(x) for x in xs if x)
        for w, (b, a) in count.items():
            c, e = n[1] - a, n[0] - b
            ratio = 2 * (xl(a, b, c, e) - xl(a + b, c + e, a + c, b + e) + xl(sum(n)))
            weight = np.log((a + 0.5) / (n[1] + 1)) - np.log((b + 0.5) / (n[0] + 1))
            if a >= toxicity.LEAST_TEXTS and weight > 0 and ratio >= toxicity.LEAST_RATIO:
                out[w] = weight
        forms = {toxicity.form(w) for w in out}
        clean = {w for w, (b, _) in count.items() if b} | {w for i, ws in words.items() if taught.get(i) == 0 for w in ws}
        return out, forms, {w for w in clean if toxicity.form(w) in forms} - out.keys()

    measured = lambda t, ev: toxicity.Reader(ev[0], chars, ev[2]).evidence(t)
    half = lambda i: crc(i) // 5 % 2
    by_half = [evidence([i for i in taught if half(i) == h]) for h in (0, 1)]
    e = np.array([measured(texts[i], by_half[1 - half(i)]) for i in taught])
    x = np.column_stack([np.ones_like(e), e, np.sqrt(e), [np.log1p(len(texts[i])) for i in taught]])
    fit = toxicity._logistic(x, np.array(list(taught.values()), float))
    whole = evidence(list(taught))
    assert len(whole[0]) > 3
    for sent in (toxicity.SENT_LABELS, 10):
        for r in toxicity.score_toxicity(docs, labels, sent_labels=sent).collect():
            v = measured(texts[r.doc_id], whole)
            assert r.score == pytest.approx(1 / (1 + np.exp(-(np.array([1, v, np.sqrt(v), np.log1p(len(texts[r.doc_id]))]) @ fit))), abs=1e-6) and r.held_out == (crc(r.doc_id) % 5 == 0)


def test_restored_words():
    chars = toxicity.CharModel({g: 50 for w in ("idiot", "stupid", "worthless", "loser", "clown") for g in (f"^^{w}$"[i : i + 3] for i in range(len(w) + 1))})
    for odd, plain in (("1d10t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("l0000ser", "loser"), ("cl0wn", "clown"), ("$tup1d", "stupid")):
        assert chars.restore(odd) == plain


def test_long_tokens_are_read_in_pieces():
    words = ("idiot", "scum", "harmless")
    chars = toxicity.CharModel({g: 50 for w in words for g in (f"^^{w}$"[i : i + 3] for i in range(len(w) + 1))})
    reader = toxicity.Reader({"idiot": 1.0, "scum": 2.0}, chars)
    for before in (0, 300, 500, 700, 5000, 300_000):
        assert reader.evidence("x1" * before + "idiot" + "y2" * 400) == 1, before
    assert reader.evidence("s " + "c " + "u " + "m " + "z " * 3000) == 2 and not reader.telling and max(map(len, reader.seen)) <= toxicity.KEPT


def test_spaced_words_beside_punctuation_and_letters():
    words = ("idiot", "scum", "loser", "scumbag", "ass")
    chars = toxicity.CharModel({g: 50 for w in words for g in (f"^^{w}$"[i : i + 3] for i in range(len(w) + 1))})
    weights = {"idiot": 1.0, "scum": 2.0, "loser": 4.0}
    for text, want in (
        ("you s c u m!", 2), ("you i d i o t.", 1), ("l o s e r, go", 4), ("(s c u m)", 2), ('"s c u m"', 2), ("s - c - u - m", 2), ("s  --  c  --  u  --  m", 2), ("a s c u m", 2), ("s c u m a", 2), ("such a\ns c u m?! i d 1 0 t; x", 3),
        ("don't s.c.u.m!", 2), ("l_o_s_e_r.", 4), ("a b c, and 1 2 3 4.", 0), ("", 0),
    ):
        assert toxicity.Reader(weights, chars).evidence(text) == want, text
    assert toxicity.Reader({"ass": 1.0}, chars).evidence("an a s s!") == 1


def test_disguised_by_letters_alone(spark):
    chars = toxicity.CharModel({g: 50 for w in ("idiot", "stupid", "scum", "loser", "hop", "hoop") for g in (f"^^{w}$"[i : i + 3] for i in range(len(w) + 1))})
    weights = {"idiot": 1.0, "scum": 2.0, "stupid": 4.0, "hop": 8.0}
    learned = spark.createDataFrame([(0, "hoop", 0, 3), (0, "hop", 9, 1), (0, "sccum", 2, 0), (0, "other", 1, 9), (1, "hop", 0, 9)], "kind int, key string, toxic long, clean long")
    known = toxicity._known(learned, weights)
    assert known == {"hoop"} and toxicity._known(learned, {}) == set()
    for text, want in (("an idiiot", 1), ("Sccum!", 2), ("stvpid", 4), ("sttvppid idiott", 5), ("hoop", 0), ("hopp", 8), ("very good", 0), ("scum sccum", 2)):
        assert toxicity.Reader(weights, chars, known).evidence(text) == want, text


def test_model_of_toxicity_is_whole(spark):
    rows = [(0, f"w{i}", 20, 0) for i in range(5000)] + [(1, chr(0x4E00 + i // 300) + chr(0x5E00 + i % 300) + "$", 0, 1 + i % 3) for i in range(70000)]
    learned = spark.createDataFrame(rows, "kind int, key string, toxic long, clean long")
    for part in (toxicity.PART, 9000):
        assert len(toxicity._evidence(learned, 1000, 1000, part)) == 5000
        chars = toxicity.CharModel(toxicity._char_tables(learned, part))
        assert len(chars.tri[0]) == 70000 and all(toxicity._count(chars.tri, int(k)) == r[3] for r, k in zip(rows[5000::97], toxicity.packed([r[1] for r in rows[5000::97]]), strict=True))
        assert chars.total == 1 + sum(r[3] for r in rows[5000:])
    texts = spark.createDataFrame([("ab no", 1, 0, 0), ("ab", 0, 2, 0), ("cd", None, None, None), (None, 1, 0, 1), ("ab", 3, 0, 1)], "text string, toxic long, clean long, half int")
    got = {(r.kind, r.key): (r.toxic, r.clean) for r in toxicity._learned(texts).collect()}
    assert got[0, "ab"] == (1, 2) and got[2, "ab"] == (3, 0) and (0, "cd") not in got and got[1, "cd$"] == (0, 1) and got[1, "^ab"] == (0, 3)
    assert toxicity.CharModel({}).restore("1d") and toxicity.CharModel({"^^a": 2}).total == 3


def test_suffixes_and_registered_domains(spark):
    want = {
        "a.b.example.com": ("example.com", "com"), "news.co.uk": ("news.co.uk", "co.uk"), "www.news.co.uk:80": ("news.co.uk", "co.uk"), "u:p@shop.com.au": ("shop.com.au", "com.au"), "user.github.io": ("user.github.io", "github.io"),
        "x.user.github.io": ("user.github.io", "github.io"), "co.uk": ("co.uk", "co.uk"), "localhost": ("localhost", "localhost"), "": ("", ""), "10.0.0.1:8080": ("10.0.0.1", "10.0.0.1"), "[::1]:80": ("[::1]", "[::1]"),
        "example.org.": ("example.org", "org"), "com.example": ("com.example", "example"), "a.co.example": ("co.example", "example"), "me@x@y.de": ("y.de", "de"), "..": ("", ""),
    }
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(want)], "page_id long, url string")
    host = F.regexp_extract("url", "//(.*)/", 1)
    got = {r.h: (r.d, r.s) for r in pages.select(host.alias("h"), reputation.registered_domain(host).alias("d"), reputation.suffix(host).alias("s")).collect()}
    assert got == want
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(want))], "doc_id long, quality int, toxic int")
    outcomes = pages.join(labels, pages.page_id == labels.doc_id).select(host.alias("host"), (F.col("quality") == 0).alias("bad"))
    agrees({"pages": pages, "labels": labels}, reputation.judge_urls(pages, outcomes).drop("bad_bound"), queries.oracle_sql()["op10_url_reputation"])


def test_reputations(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(2000):
        host = f"bad{rng.randrange(4)}.spam.test" if i % 3 == 0 else f"h{rng.randrange(30)}.good.test"
        rows.append((i, f"https://{host.upper() if i % 2 else host}/x/{i}"))
        if i % 5 == 0:
            marks.append((i, 0 if "spam" in host and rng.random() < 0.9 else 1, 0))
    rows += [(3000, None), (3001, ""), (3002, "no scheme"), (3003, "http://new.spam.test/a"), (3004, "http://NEW.good.test?x"), (3005, "http://a.example.net/en/1#y"), (3006, "http://example.net"), (3007, "x://y://z/p"), (3008, "http://example.com/de/"), (3009, "ftp://org/fr/?a"), (3010, "http://notnet/"), (3011, "http://" + "a." * 2000 + "net/"), (7, rows[7][1])]
    pages, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    outcomes = pages.join(labels, pages.page_id == labels.doc_id).select(reputation.url_host(F.col("url")).alias("host"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    got = reputation.judge_urls(pages.withColumn("host", F.lit(1)), outcomes)
    agrees({"pages": pages, "labels": labels}, got.drop("bad_bound"), queries.oracle_sql()["op10_url_reputation"])
    by = {r.page_id: r for r in got.collect()}
    assert by[3003].verdict == "block" and by[3004].verdict == "allow" and by[0].verdict == "block" and by[1].verdict == "allow"
    assert [(by[k].rule, by[k].verdict) for k in (3005, 3006, 3008, 3009, 3011)] == [("example.net/en/", "allow"), (None, by[3006].verdict), ("example.com/de/", "block"), ("org/fr/", "allow"), ("net/", "block")]
    assert (by[3007].host, by[3007].path, by[3000].host, by[3010].rule) == ("y:", "//z/p", "", None)
    assert reputation.judge_urls(pages, outcomes.where("false")).where("rule IS NULL AND verdict = 'block'").count() == 0
    assert reputation.judge_urls(pages.where("false"), outcomes).count() == 0
