"""The training-data operators against brute force, and on nulls, empty and odd input."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import common, components, host_rules, language_id, licenses, media_archive, mixing, near_dedup, packing, queries, simple8b, substring_dedup, token_output, url_filter

SF = "/root/testdata/sf0.001"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@pytest.fixture(scope="module")
def docs(spark):
    return common.documents(spark, SF)


@pytest.fixture(scope="module")
def table(docs):
    return [r.asDict() for r in docs.orderBy("doc_id").collect()]


def words(text):
    return (text or "").encode().split()


def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows and ids, other alphabets, clashing names."""
    line = " ".join(f"w{i}" for i in range(70))
    given = [
        (0, None, "en", "a", 1, "x"), (1, "", None, None, None, None), (2, " \n\t ", "en", "a", 1, "x"), (3, line, "en", "a", 1, "x"), (3, line, "en", "a", 1, "x"), (4, line + "\nmore", "en", "b", 1, "x"),
        (None, line, "en", "b", 1, "x"), (5, "日本 語 x", "ja", "c", 1, "x"), (6, "12 34 !!", "en", "c", 1, "x"), (7, "The THE the", "en", "b", 1, "x"), (7, "other words here", "en", "b", 1, "x"), (None, None, None, None, None, None),
    ]
    return spark.createDataFrame(given, "doc_id long, text string, lang string, source string, size long, piece string")


def empty(spark):
    return odd(spark).filter("false")


# ------------------------------------------------------------------------------------------ SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df, want = queries.QUERIES[name](spark, SF), c.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(want.select(*columns).fetchall(), key=repr)


# ------------------------------------------------------------------------------------------ mixing


def waterfill(sizes, weights, budget, most=2.0):
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = budget
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if level * weights[i] > most * sizes[i]}
        if not full:
            for i in open_:
                target[i] = level * weights[i]
            break
        for i in full:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ -= full
    return target


def test_mixing(spark, docs, table):
    got = queries.op1_source_mixing(spark, SF).collect()
    sizes = Counter()
    for r in table:
        sizes[r["source"]] += len(words(r["text"]))
    names = sorted(sizes)
    want = dict(zip(names, waterfill([sizes[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values())), strict=True))
    source = {r["doc_id"]: r["source"] for r in table}
    taken = Counter()
    for r in got:
        taken[source[r.doc_id]] += r.taken
        assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6 and 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[n] - want[n]) <= max(5, 0.01 * want[n]) for n in names)
    assert sorted(got) == sorted(queries.op1_source_mixing(spark, SF).collect())


def test_mixing_odd(spark):
    out = mixing.mix_sources(odd(spark).drop("size"))
    assert out.count() == 12 and out.filter("size = 0 and taken > 0").count() == 0
    assert mixing.mix_sources(empty(spark).drop("size")).count() == 0
    one = spark.createDataFrame([(1, "a b c d", "s")], "doc_id long, text string, source string")
    assert mixing.mix_sources(one).first().taken == 6  # one document: one and a half repetitions


# ------------------------------------------------------------------------------------------ substring dedup


def removed(rows, window):
    first = {}
    for k, w in sorted(((k, w) for k, w in rows if k is not None), key=lambda x: x[0]):
        for i in range(len(w) - window + 1):
            first.setdefault(b" ".join(w[i : i + window]), k)
    out = []
    for k, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1 if k is not None else 0):
            if first[b" ".join(w[i : i + window])] < k:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((k, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup(spark, table):
    got = sorted(map(tuple, queries.op2_substring_dedup(spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)
    assert got == removed([(r["doc_id"], words(r["text"])) for r in table], 50)


def test_substring_dedup_small_windows(spark):
    rng = random.Random(5)
    given = [(i * 3 - 40, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(5)
    got = substring_dedup.substring_dedup(df, window=6, report=True).collect()
    assert sorted(map(tuple, got), key=repr) == removed([(k, words(t)) for k, t in given], 6)


def test_substring_dedup_odd(spark):
    df = odd(spark)
    got = substring_dedup.substring_dedup(df, window=3)
    assert got.columns == df.columns and got.count() == 12
    by = defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append(r.text)
    assert by[4] == ["more"] and len(set(by[3])) == 1 and by[1] == [""] and by[0] == [None] and sum(x is not None for x in by[None]) == 1
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0


def test_hash_blobs():
    h = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (substring_dedup.decode(substring_dedup.encode(h)) == h).all()


# ------------------------------------------------------------------------------------------ URL filter


def test_redirects_reach_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    given = [
        (1, "http://A.example.net/x#top", link.format("http://b.com/de/1")), (2, "http://b.com/de/1", ""), (3, "http://x.org/a", link.format("http://b.com/de/1")), (4, "http://c.net/", '<META http-equiv="refresh" content="0; url=/y">'),
        (5, "http://c.net/y", link.format("http://a.example.net/x")), (6, None, None), (7, "nourl", "x"), (8, "http://free.net/z?q#f", ""), (8, "http://free.net/z?q#f", ""), (9, "http://example.org/es/a", ""), (10, "http://m.fr.com/fr/", ""),
    ]
    df = spark.createDataFrame([(*g, "extra") for g in given], "page_id long, url string, html string, verdict0 string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(df).collect()}
    assert {k: v[3] for k, v in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "allow"}
    assert got[1][:3] == ("a.example.net", "/x", None) and got[2][2] == "com/de/" and got[6][:2] == ("", "") and got[9][2] == "example.org/es/"
    assert url_filter.url_filter(df.filter("false")).count() == 0


def test_components_like_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(500, x) for x in range(501, 900)] + [(x, x + 1) for x in range(1000, 1060)] + [(7, 7), (None, 3)]
    parent = {}
    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}


# ------------------------------------------------------------------------------------------ host rules


def test_host_rules_odd(spark):
    out = host_rules.host_rules(odd(spark).drop("size")).collect()
    assert len(out) == 12 and not any(r.kept for r in out if r.n_words < 50)
    assert host_rules.host_rules(empty(spark)).count() == 0


def test_bad_hosts_take_their_documents(spark):
    good = " ".join(f"w{i}" for i in range(60))
    given = [(i, good, "good") for i in range(50)] + [(100 + i, "short" if i % 10 else good, "bad") for i in range(50)]
    out = {r.doc_id: r for r in host_rules.host_rules(spark.createDataFrame(given, "doc_id long, text string, source string")).collect()}
    assert out[0].kept and not out[100].base_failed and not out[100].kept and out[0].shrunk_rate < 0.1


# ------------------------------------------------------------------------------------------ language ID


def test_language_id(spark, table):
    got = {r.doc_id: r for r in queries.op5_language_id(spark, SF).collect()}
    held = [r for r in table if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(got[r["doc_id"]].held_out for r in held) and sum(r.held_out for r in got.values()) == len(held)
    assert sum(got[r["doc_id"]].lang_pred == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_id_odd(spark, docs):
    model = language_id.fit_classifier(docs, F.lit(True), sample=50)
    out = language_id.predict(odd(spark), model).collect()
    assert len(out) == 12 and {r.lang_pred for r in out if r.doc_id in (0, 1, 2, 6)} == {"und"} and all(r.rejected for r in out if r.lang_pred == "und")
    assert language_id.identify(empty(spark)).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_id_rejects_by_length(spark):
    docs = common.documents(spark, "/root/testdata/sf0.01")
    rng = random.Random(3)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(300))
    finnish = "Suomen kieli on uralilaisten kielten itämerensuomalaiseen ryhmään kuuluva kieli, jota puhuvat pääosin suomalaiset. Kielen puhujia on noin viisi miljoonaa, ja se on toinen maan virallisista kielistä ruotsin ohella. Sitä opetetaan kouluissa ja yliopistoissa, ja sillä kirjoitetaan kirjoja ja lehtiä."
    given = [(1, noise), (2, finnish), (3, "Avec."), (5, "A.\nAll rights reserved."), (4, docs.filter("length(text) > 500").orderBy("doc_id").first().text)]
    model = language_id.fit_classifier(docs, F.lit(True))
    out = language_id.predict(spark.createDataFrame(given, "doc_id long, text string"), model).collect()
    assert {r.doc_id for r in out if r.rejected} == {1, 2}


# ------------------------------------------------------------------------------------------ token output


@pytest.mark.parametrize("top", [1, 2, 300, 50_257, 1 << 32, 1 << 60, (1 << 64) - 1])
@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_simple8b_round_trip(n, top):
    x = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64, endpoint=True)
    x[: n // 3] = 0
    raw = simple8b.write_segment(np.arange(3), np.array([1, 2, n]), x)
    ids, counts, back = simple8b.read_segment(raw)
    assert (back == x).all() and ids.tolist() == [0, 1, 2] and counts.tolist() == [1, 2, n]
    w, starts = simple8b.pack(x)
    if len(starts) > 3:  # one block alone
        assert (simple8b.unpack(w, starts[1:3], 1024) == x[1024:2048]).all()


def token_digest(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    out, start = [], 0
    for k, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_output(spark, table):
    got = queries.op6_token_output(spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == token_digest([(r["doc_id"], r["text"]) for r in table])


def test_token_output_odd(spark):
    texts = ["a  b", "a \n b", " x ", "x\t y\n\nz  ", "don't  can't 'll <|endoftext|> <|endoftext|>", "", None, "日本 語 123 45.6 a.b. c, d², ½.", "a\0b c", "\x1c \x1d a", "the end. the end, x."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert [tuple(r) for r in token_output.token_output(df, TOKENIZER).orderBy("doc_id").collect()] == token_digest(list(enumerate(texts)))
    assert token_output.token_output(odd(spark), TOKENIZER).count() == 12
    assert token_output.token_output(empty(spark), TOKENIZER).count() == 0


# ------------------------------------------------------------------------------------------ license scan


def test_license_scan(spark, table):
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit"}
    got = {r.doc_id: r for r in queries.op7_license_scan(spark, SF).collect()}
    for r in table:
        at = r["text"].split("\n")
        assert got[r["doc_id"]].families == ",".join(sorted({lines[x] for x in at if x in lines})) and got[r["doc_id"]].n_paragraphs == sum(bool(x.split()) for x in at)


def test_license_scan_tells_versions(spark, docs):
    gpl = licenses.TEMPLATES["gpl-3.0"][0]
    given = {
        "This work is licensed under the GNU General Public License, version 2.": "gpl-2.0", "Licensed under the Apache License, Version 1.1.": "", "Licensed under CC BY-SA 4.0.": "cc-by-sa-4.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
        "Licensed under the BSD 2-Clause License.": "bsd-2-clause", licenses.TEMPLATES["lgpl-3.0"][0]: "lgpl-3.0", licenses.TEMPLATES["lgpl-2.1"][0]: "lgpl-2.1", gpl: "gpl-3.0", gpl.replace("version 3", "version 2"): "gpl-2.0", licenses.TEMPLATES["agpl-3.0"][0]: "agpl-3.0",
        "All rights reserved.": "", "plain words only here": "",
    }
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(given)], "doc_id long, text string"))
    got = {r.doc_id: r for r in licenses.scan_licenses(df).filter("doc_id >= 10000").collect()}
    assert {t: got[10_000 + i].families for i, t in enumerate(given)} == given
    assert [got[10_000 + i].n_reserved for i in range(len(given))] == [int(t == "All rights reserved.") for t in given]


def test_license_scan_in_long_lines(spark, docs):
    prose = " ".join(docs.filter("length(text) > 3000").orderBy("doc_id").first().text.split())
    notice = "Licensed under the Apache License, Version 2.0."
    wrapped = licenses.TEMPLATES["lgpl-2.1"][0].replace(" GNU ", "\nGNU ").replace(" either ", "\neither ")
    given = [(10_000, f"{prose} {notice} {prose}"), (10_001, f"{notice} {prose} Released under the MIT License."), (10_002, wrapped), (10_003, prose)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(given, "doc_id long, text string"))
    got = {r.doc_id: (r.families, r.n_licenses) for r in licenses.scan_licenses(df).filter("doc_id >= 10000").collect()}
    assert got == {10_000: ("apache-2.0", 1), 10_001: ("apache-2.0,mit", 2), 10_002: ("lgpl-2.1", 1), 10_003: ("", 0)}


def test_license_scan_odd(spark):
    assert all(r.n_licenses == 0 for r in licenses.scan_licenses(odd(spark)).collect())
    assert licenses.scan_licenses(empty(spark)).count() == 0


# ------------------------------------------------------------------------------------------ media


def test_media(spark, table):
    got = {r.doc_id: r for r in queries.op8_media_columns(spark, SF).collect()}
    for r in table:
        raw = r["text"].encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        g = got[r["doc_id"]]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32, g.error) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), None)


def test_media_ranges_and_retries(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat("id", 200)).cast("string").alias("text")).coalesce(2)
    media_archive.write_archives(df, path)
    reader = media_archive.ArchiveReader(path, 700, 1)
    ids = [k for p in reader.partitions() for b in reader.read(p) for k in b.column("doc_id").to_pylist()]
    assert sorted(ids) == list(range(300)) and len(reader.partitions()) > 20
    file = next((tmp_path / "a").glob("*.lma"))
    raw = bytearray(file.read_bytes())
    raw[media_archive.MEMBER.size + 20] ^= 255  # the first member's media
    file.write_bytes(bytes(raw))
    rows = media_archive.media_digest(media_archive.read_archives(spark, path, range_bytes=4096)).collect()
    assert len(rows) == 300 and sum(r.error is not None for r in rows) == 1 and sum(r.payload_bytes is not None for r in rows) == 299


def test_media_error_keeps_the_id(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    media_archive.write_archives(spark.createDataFrame([(77, "some text")], "doc_id long, text string").coalesce(1), path)
    file = next((tmp_path / "a").glob("*.lma"))
    raw = bytearray(file.read_bytes())
    raw[media_archive.MEMBER.size + 5] ^= 255
    file.write_bytes(bytes(raw))
    read = media_archive.read_archives(spark, path, retries=0)
    row = media_archive.media_digest(read).first()
    assert (row.doc_id, row.n_bytes, row.payload_bytes) == (77, 9, None) and row.error
    with pytest.raises(Exception, match="document 77"):
        media_archive.media_digest(read, strict=True).collect()


def test_media_odd(spark):
    rows = media_archive.media_columns(odd(spark)).collect()
    assert len(rows) == 12 and {r.payload_bytes for r in rows if r.n_bytes == 0} == {64}
    assert media_archive.media_columns(empty(spark)).count() == 0


# ------------------------------------------------------------------------------------------ near-dedup


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(rows, percent=85):
    sets, parent = {k: shingles(t) for k, t in rows}, {k: k for k, _ in rows}
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    index = defaultdict(list)
    for a in sorted(sets):
        shared = Counter(b for h in sets[a] for b in index[h])
        for h in sets[a]:
            index[h].append(a)
        for b, n in shared.items():
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((k, len(sets[k]), root(k), root(k) == k) for k in sets)


def near_copies(n, groups):
    rng = random.Random(9)
    out = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randrange(3, 120))]
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
            out.append(" ".join(w))
    rng.shuffle(out)
    return list(enumerate(out))


def test_near_dedup(spark, table):
    got = queries.op9_near_dedup(spark, SF).collect()
    assert sorted(map(tuple, got)) == linked([(r["doc_id"], r["text"]) for r in table])


@pytest.mark.parametrize(("cell", "block"), [(512, 4096), (6, 4096), (6, 7)])
def test_near_dedup_groups_and_blocks(spark, cell, block):
    given = near_copies(25, 8)
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    got = near_dedup.near_dedup(df, cell_nodes=cell, block_nodes=block).collect()
    assert sorted(map(tuple, got)) == linked(given)


def test_links_between_known_clusters():
    """Nodes of one known cluster need no link; a link between clusters is still found."""
    ids, base = np.arange(4), np.arange(100, dtype=np.uint64)
    sets = [base, base + np.uint64(3), base + np.uint64(200), np.concatenate([base[:-5], base[:5] + np.uint64(900)])]
    assert near_dedup.forest(ids, sets, 85, known=[0, 0, 2, 0]) == ([], [])
    u, v = near_dedup.forest(ids, sets, 85, known=[0, 0, 2, 3])
    assert len(u) == 1 and {u[0], v[0]} in ({0, 3}, {1, 3})


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64)) for _ in range(2))
    both, small = np.unique(np.concatenate([a, b[:500]])), a[:1]
    s = near_dedup.sketches(np.array([len(a), len(both), len(small)]), np.concatenate([a, both, small]))
    assert (s != near_dedup._FULL).all()  # even a set of one fills all coordinates
    assert abs((s[0] == s[1]).mean() - len(a) / len(both)) < 0.12


def test_near_dedup_odd(spark):
    got = defaultdict(list)
    for r in near_dedup.near_dedup(odd(spark)).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert got[0] == [(0, 0, True)] and got[2] == [(0, 2, True)] and got[3] == [(66, 3, True)] * 2 and got[4] == [(67, 3, False)]
    assert sum(map(len, got.values())) == 12 and all(c is None and kept for _, c, kept in got[None]) and len(got[7]) == 2
    assert near_dedup.near_dedup(empty(spark)).count() == 0


# ------------------------------------------------------------------------------------------ packing


def plain_best_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [(room, i) for i, (room, ss, cc) in enumerate(bins) if room >= n and (s < 0 or s not in ss) and (c < 0 or c not in cc)]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append([capacity, set(), set()])
        bins[i][0] -= n
        bins[i][1].add(s)
        bins[i][2].add(c)
        out.append(capacity - n if not fits else min(fits)[0] - n)
    return out, len(bins)


def test_best_fit_is_the_tightest():
    rng = random.Random(4)
    for _ in range(20):
        sizes = sorted((rng.randrange(1, 60) for _ in range(80)), reverse=True)
        clusters = [rng.choice([-1, -1, 0, 1, 2]) for _ in sizes]
        got = packing.best_fit(sizes, [-1] * 80, clusters, 100)
        room, rooms = {}, []
        for n, b in zip(sizes, got, strict=True):
            room[b] = room.get(b, 100) - n
            rooms.append(room[b])
        want, _ = plain_best_fit(sizes, [-1] * 80, clusters, 100)
        assert min(room.values()) >= 0 and rooms[0] == want[0]
    # Each choice has the least room of all compatible bins at that time.
    state, sources = [], [rng.randrange(6) for _ in sizes]
    got = packing.best_fit(sizes, sources, clusters, 100)
    for n, s, c, b in zip(sizes, sources, clusters, got, strict=True):
        fits = [r for r, ss, cc in state if r >= n and s not in ss and (c < 0 or c not in cc)]
        if b == len(state):
            assert not fits
            state.append([100, set(), set()])
        else:
            assert state[b][0] == min(fits)
        state[b][0] -= n
        state[b][1].add(s)
        state[b][2] |= {c} - {-1}


def test_packing(spark, table):
    got = queries.op10_packing(spark, SF).collect()
    total, held = Counter(), defaultdict(list)
    for r in got:
        total[r.doc_id] += r.n_words
        held[r.bin_id].append(r)
    assert total == Counter({r["doc_id"]: len(words(r["text"])) for r in table})
    for b, rows in held.items():
        if b is not None:
            assert sum(r.n_words for r in rows) + rows[0].bin_room == 2048 and len({r.cluster for r in rows}) == len(rows)
            spans = sorted((r.start, r.start + r.n_words) for r in rows)
            assert all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0


def test_hot_source_is_kept_apart(spark):
    """One source of most pieces: more than the fewest bins that hold all words."""
    given = [(i, f"w{i} " * 5, "hot" if i % 5 else f"s{i % 3}") for i in range(60)]
    rows = packing.pack_documents(spark.createDataFrame(given, "doc_id long, text string, source string"), capacity=100).collect()
    assert len(rows) == 60 and max(Counter((r.bin_id, r.source) for r in rows).values()) == 1
    assert len({r.bin_id for r in rows}) == 48  # as many as the hot source has pieces


def test_packing_odd(spark):
    rows = packing.pack_documents(odd(spark)).collect()
    assert len(rows) == 12 and all((r.bin_id is None) == (r.n_words == 0) for r in rows)
    assert packing.pack_documents(empty(spark)).count() == 0


# ------------------------------------------------------------------------------------------ pipeline


def test_pipeline_stage_by_stage(spark, docs, table):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = sorted((r.doc_id, r.text) for r in kept.collect())
        kept = common.written(stage(spark, kept, SF), f"test-{name}")
        assert kept.columns == docs.columns
        after = sorted((r.doc_id, r.text) for r in kept.collect())
        if name == "language_id":
            assert len(after) >= len(before) - 2 and set(after) <= set(before)
        elif name == "near_dedup":
            keep = {k for k, _, _, first in linked(before) if first}
            assert after == [x for x in before if x[0] in keep]
        elif name == "substring_dedup":
            want = {k: sha for k, _, _, sha in removed([(k, words(t)) for k, t in before], 50)}
            assert [k for k, _ in after] == [k for k, _ in before] and all(hashlib.sha256(b" ".join(words(t))).hexdigest() == want[k] for k, t in after)
        else:
            n = Counter(k for k, _ in after)
            assert set(after) <= set(before) and max(n.values()) <= 2
            share = sum(len(words(t)) for _, t in after) / sum(len(words(t)) for _, t in before)
            assert 1.2 < share < 1.8
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert packed.agg(F.sum("n_words")).first()[0] == sum(len(words(r.text)) for r in kept.collect())
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_pipeline_drops_near_copies_from_080(spark, docs, table):
    rows = [(r["doc_id"], r["text"]) for r in table]
    keep = {k for k, _, _, first in linked(rows, 80) if first}
    assert keep < {k for k, _, _, first in linked(rows, 85) if first}  # some pairs are in between
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == keep
