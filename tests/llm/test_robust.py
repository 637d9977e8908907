"""The training-data operators on clashing names, very long texts, hot and outlying ids, damaged files and chosen input."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import common, host_rules, language_id, licenses, media_archive, mixing, near_dedup, packing, queries, substring_dedup, token_output, url_filter

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


def thue_morse(n):
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a[:n], a[:n].translate(str.maketrans("ab", "ba"))


# ------------------------------------------------------------------------------------------ shared helpers


def test_word_hashes_of_chosen_words():
    a, b = thue_morse(4096)
    import pyarrow as pa

    h = common.Words(*common.flat(pa.array([f"{a} {b} {a}", "x", f"X{a[:70]} x{a[:70]}"], pa.string()))).hashes(lower=True)
    assert h[0] == h[2] and h[0] != h[1] and h[4] == h[5] and len(set(h.tolist())) == 4


def test_apart_and_beside(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, Size int, size_in int, TEXT int")
    rows, given = common.apart(df, __text="text")
    out = rows.select(*common.beside(given, ["size"], [common.place(given, "text")]), F.col("__text").alias("size"))
    assert out.columns == ["a", "Size_in", "size_in_in", "size"] and tuple(out.first()) == (1, 2, 3, 4)


def test_scratch_folders_go(spark):
    def count():
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(common.shared_folder(spark) + "/leafmill")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return len(fs.listStatus(p)) if fs.exists(p) else 0
    n = count()
    with common.scratch(spark, "outer"):
        common.written(spark.range(2), "a")
        with common.scratch(spark, "inner"):
            common.written(spark.range(2), "b")
        kept = common.written(spark.range(3), "kept", outer=True)
    assert count() == n + 1 and kept.count() == 3
    near_dedup.near_dedup(spark.createDataFrame([(i, "some words of a text " * 3) for i in range(4)], "doc_id long, text string")).collect()
    assert count() == n + 4  # what the result reads: signatures, nodes and links


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *a):
            return None
    class Context:
        master = "spark://host:7077"
        def getConf(self):
            return Conf()
    class Settings:
        def get(self, *a):
            return ""
    class Session:
        sparkContext, conf = Context(), Settings()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session())


# ------------------------------------------------------------------------------------------ clashing names


#: Every name that an operator gives or uses inside, besides the columns of documents.
NAMES = [
    "size", "source_size", "target", "repeats", "taken", "n_words", "n_removed", "kept_sha256", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "shrunk_rate", "host_failed", "kept", "lang_pred", "score", "rejected", "held_out",
    "id", "words", "shard", "piece", "cluster", "component", "component_id", "h", "line", "n", "TEXT2", "__seg", "__id", "__text", "__src", "__cell", "__host", "__of", "__w", "__lines", "__pairs", "__p", "__in0", "__in1", "__word", "__node", "__blocked", "__key", "__says",
]


def clashing(df):
    return df.withColumns({n: F.lit(f"given {n}") for n in NAMES})


def small(spark):
    text = " ".join(f"w{i}" for i in range(60))
    return spark.createDataFrame([(1, text, "en", "a", 9), (2, text + " more", "en", "b", 9), (3, None, None, None, None), (4, "x", "de", "a", 9)], "doc_id long, text string, lang string, source string, n_chars long")


def same_but_extra(plain, wide, results, given):
    """The wide result has the plain one's results, and every extra column, under its name or with _in."""
    assert sorted(map(repr, plain.select(*results).collect())) == sorted(map(repr, wide.select(*results).collect()))
    lower = {c.lower() for c in wide.columns}
    assert len(lower) == len(wide.columns)
    for n in given:
        name = n if n not in results else f"{n}_in"
        assert name.lower() in lower and {r[0] for r in wide.select(F.col(f"`{name}`")).distinct().collect()} == {f"given {n}"}


@pytest.mark.parametrize(("run", "results"), [
    (lambda df: mixing.mix_sources(df), mixing.RESULTS), (lambda df: mixing.mix_sources(df, keep_text=True), mixing.RESULTS), (lambda df: substring_dedup.substring_dedup(df, report=True), substring_dedup.RESULTS),
    (lambda df: host_rules.host_rules(df), host_rules.RESULTS), (lambda df: language_id.predict(df, language_id.fit_classifier(df, F.lit(True))), language_id.RESULTS),
])
def test_clashing_names(spark, run, results):
    df = small(spark)
    same_but_extra(run(df), run(clashing(df)), results, NAMES)


def test_clashing_names_of_pages(spark):
    names = ["host", "path", "rule", "verdict", "component", "__blocked", "__key", "__url", "u", "v", "node"]
    df = spark.createDataFrame([(1, "http://a.net/x", '<link rel=canonical href="http://b.com/de/1">'), (2, "http://c.net/", "")], "page_id long, url string, html string")
    wide = df.withColumns({n: F.lit(f"given {n}") for n in names})
    same_but_extra(url_filter.url_filter(df), url_filter.url_filter(wide), url_filter.RESULTS, names)


@pytest.mark.parametrize("run", [
    lambda df: substring_dedup.substring_dedup(df), lambda df: near_dedup.near_dedup(df), lambda df: packing.pack_documents(df), lambda df: token_output.token_output(df, TOKENIZER), lambda df: licenses.scan_licenses(df),
    lambda df: media_archive.media_columns(df), lambda df: language_id.identify(df),
])
def test_clashing_names_do_not_matter(spark, run):
    df = small(spark)
    plain, wide = run(df), run(clashing(df))
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, wide.select(*plain.columns).collect()))


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_with_clashing_names(spark, docs, name, stage):
    some = docs.filter("length(text) < 2000")
    plain, wide = stage(spark, some, SF), stage(spark, clashing(some), SF)
    if name != "packing":
        assert wide.columns == [*docs.columns, *NAMES]
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, wide.select(*plain.columns).collect()))


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, docs, name, stage):
    """Nulls in every column, empty texts, repeated rows and ids, an empty table."""
    line = " ".join(f"w{i}" for i in range(70))
    given = [(None, line, "en", "a", 1), (None, None, None, None, None), (900_001, "", "en", None, 0), (900_001, "", "en", None, 0), (900_002, line, None, "a", 1), (900_002, line, None, "a", 1), (900_003, line + " x", "en", "b", 1), (900_004, " \n", "en", "b", 2)]
    df = docs.unionByName(spark.createDataFrame(given, docs.schema))
    got = [r for r in stage(spark, df, SF).collect() if r.doc_id is None or r.doc_id > 900_000]
    n = Counter(r.doc_id for r in got)
    want = {
        "near_dedup": {None: 2, 900_001: 2, 900_002: 2, 900_004: 1}, "substring_dedup": {None: 2, 900_001: 2, 900_002: 2, 900_003: 1, 900_004: 1},
        "packing": {None: 2, 900_001: 2, 900_002: 2, 900_003: 1, 900_004: 1},
    }
    if name in want:
        assert n == want[name]
    else:
        assert 900_004 not in n and 900_001 not in n and max(n.values(), default=0) <= 4
    assert stage(spark, df.filter("false"), SF).count() == 0


# ------------------------------------------------------------------------------------------ very long texts


@pytest.fixture(scope="module")
def long_rows(table):
    """Two near copies of 5 MB, and a page of prose that begins one of them."""
    prose = " ".join(r["text"] for r in table if r["lang"] == "en" and len(r["text"]) > 300)
    rng, base = random.Random(1), prose.split()
    out, size = [], 0
    while size < 5_000_000:
        w = rng.choice(base)
        out.append(w + ("\n" if rng.random() < 0.05 else ""))
        size += len(w) + 1
    first = " ".join(out)
    second = " ".join([*out[:-900], *(f"other{i}" for i in range(900))])
    return [(1, " ".join(out[:400]), "en", "a"), (2, first, "en", "a"), (3, second + "\nReleased under the MIT License.", "en", "b"), (4, "short text", "en", "b")]


@pytest.fixture(scope="module")
def long_docs(spark, long_rows):
    return spark.createDataFrame(long_rows, "doc_id long, text string, lang string, source string").repartition(2)


def test_long_sizes_and_pieces(long_docs, long_rows):
    n = {k: len(words(t)) for k, t, *_ in long_rows}
    assert {r.doc_id: r.size for r in mixing.mix_sources(long_docs).collect()} == n
    total = Counter()
    for r in packing.pack_documents(long_docs).collect():
        total[r.doc_id] += r.n_words
        assert r.n_words <= 2048
    assert total == n


def test_long_substrings(long_docs, long_rows):
    first, out = {}, {}
    for k, t, *_ in long_rows:
        w = words(t)
        here = [hash(b" ".join(w[i : i + 50])) for i in range(len(w) - 49)]
        gone = np.zeros(len(w) + 50, bool)
        for i, h in enumerate(here):
            if first.setdefault(h, k) < k:
                gone[i : i + 50] = True
        out[k] = (len(w), int(gone[: len(w)].sum()))
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(long_docs, report=True).collect()} == out
    assert out[2][1] == 400 and out[3][1] > 700_000


def test_long_near_copies(long_docs, long_rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(long_docs).collect()}
    for k, t, *_ in long_rows:
        w = t.encode().translate(LOWER).split()
        assert got[k][0] == (len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else 1)
    assert {k: c for k, (_, c) in got.items()} == {1: 1, 2: 2, 3: 2, 4: 4}


def test_long_rules(long_docs, long_rows):
    got = {r.doc_id: r for r in host_rules.host_rules(long_docs).collect()}
    for k, t, *_ in long_rows:
        w = words(t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + o for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for o in range(3)}
        lines = [x for x in t.split("\n") if x.split()]
        assert (got[k].n_words, got[k].word_chars, got[k].n_repeat_words, got[k].n_dup_lines) == (len(w), sum(len(x.decode()) for x in w), len(hit), len(lines) - len(set(lines)))


def test_long_languages(docs, long_docs):
    model = language_id.fit_classifier(docs, F.lit(True))
    assert {r.doc_id: r.lang_pred for r in language_id.predict(long_docs, model).collect() if r.doc_id < 4} == {1: "en", 2: "en", 3: "en"}


def test_long_tokens(long_docs, long_rows):
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(TOKENIZER), 0
    for r, (k, text, *_) in zip(token_output.token_output(long_docs, TOKENIZER, special=True).orderBy("doc_id").collect(), long_rows, strict=True):
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        assert tuple(r) == (k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_long_notices_and_media(docs, long_docs, long_rows):
    got = {r.doc_id: r.families for r in licenses.scan_licenses(long_docs.select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 100).alias("doc_id"), "text"))).filter("doc_id < 100").collect()}
    assert got == {1: "", 2: "", 3: "mit", 4: ""}
    for r in media_archive.media_columns(long_docs, range_bytes=1 << 20).collect():
        raw = long_rows[r.doc_id - 1][1].encode()
        assert (r.n_bytes, r.payload_sha256) == (len(raw), hashlib.sha256(raw + bytes(-len(raw) % 64)).hexdigest())


# ------------------------------------------------------------------------------------------ substring dedup: ids


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
        out.append((k, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seg", [200, 1500, 1 << 20])
def test_substring_dedup_of_hot_and_outlying_ids(spark, monkeypatch, seg):
    """A third of the rows has one id, some have none, one id is far off; segments are small, so that there are many."""
    rng = random.Random(seg)
    text = lambda: " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60)))
    given = [(i * 3 - 40, text()) for i in range(40)] + [(7, text()) for _ in range(40)] + [(7, "a b c a b c a b")] * 5 + [(None, text()) for _ in range(20)] + [(10**18, text()), (-(10**18), text()), (-(1 << 63), text()), ((1 << 63) - 1, text())]
    rows = spark.createDataFrame(given, "doc_id long, text string").repartition(5)
    real = substring_dedup._segments
    found = []
    def small_segments(df, _, parts):
        found.append(real(df, seg, parts))
        return found[-1]
    monkeypatch.setattr(substring_dedup, "_segments", small_segments)
    got = substring_dedup.substring_dedup(rows, window=6, report=True).collect()
    assert sorted(map(tuple, got), key=repr) == removed([(k, words(t)) for k, t in given], 6)
    low, first, copies = found[0]
    assert (np.diff(low) > 0).all() and (seg > 1500 or (copies.max() > 1 and len(low) > 3))
    kept = substring_dedup.substring_dedup(rows, window=6).collect()
    assert len(kept) == len(given) and sorted(len(words(r.text)) for r in kept) == sorted(n - g for _, n, g, _ in map(tuple, got))


def test_segments_are_even(spark):
    """Outlying ids don't gather the rest in one segment."""
    text = "word " * 400
    rows = spark.createDataFrame([(i, text) for i in range(300)] + [(10**18, text)], f"{substring_dedup.KEY} long, {substring_dedup.TEXT} string")
    low, first, copies = substring_dedup._segments(rows, 20_000, 4)
    held = Counter(np.searchsorted(low, [*range(300), 10**18], "right").tolist())
    assert max(held.values()) <= 20 and len(low) > 25


def test_rows_without_ids_only(spark):
    df = spark.createDataFrame([(None, "a b c d")] * 3 + [(None, None)], "doc_id long, text string")
    assert sorted((r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(df, window=2, report=True).collect()) == [(0, 0), (4, 0), (4, 0), (4, 0)]


# ------------------------------------------------------------------------------------------ host rules: prior


def test_hosts_of_chance_are_pooled(spark):
    """Many hosts of one true rate: none is failed, however few documents each has."""
    rng = random.Random(11)
    given = [(f"one{i}", rng.random() < 0.3) for i in range(3000)] + [(f"five{i}", rng.random() < 0.3) for i in range(400) for _ in range(5)]
    hosts = host_rules.host_verdicts(spark.createDataFrame(given, "source string, base_failed boolean")).collect()
    rate = sum(f for _, f in given) / len(given)
    assert len(hosts) == 3400 and not any(h.host_failed for h in hosts) and all(abs(h.shrunk_rate - rate) < 0.25 for h in hosts)


def test_hosts_that_differ_are_told_apart(spark):
    rng = random.Random(12)
    given = [(f"h{i}", rng.random() < (0.95 if i % 10 == 0 else 0.1)) for i in range(200) for _ in range(30)]
    got = {h["__host"]: h for h in host_rules.host_verdicts(spark.createDataFrame(given, "source string, base_failed boolean")).collect()}
    assert {k for k, h in got.items() if h.host_failed} == {f"h{i}" for i in range(0, 200, 10)}
    raw = Counter(k for k, f in given if f)
    assert all(abs(h.shrunk_rate - raw[k] / 30) < 0.1 for k, h in got.items())


def test_one_host_and_no_host(spark):
    one = host_rules.host_verdicts(spark.createDataFrame([("a", True), ("a", False)], "source string, base_failed boolean")).collect()
    assert [h.shrunk_rate for h in one] == [0.5]
    assert [h.shrunk_rate for h in host_rules.host_verdicts(spark.createDataFrame([(None, True)], "source string, base_failed boolean")).collect()] == [1.0]


# ------------------------------------------------------------------------------------------ language ID


def test_cosines_like_plain_python(spark, docs, table):
    model = language_id.fit_classifier(docs, ~language_id.held_out())
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    def gram_places(text):
        x = bytes(language_id._FOLD[b] for b in text.encode())
        for k, salt in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
            for i in range(len(x) - k + 1):
                yield ((int.from_bytes(x[i : i + k], "big") * salt) % (1 << 32)) >> 20
    for r in table[:60]:
        v = np.zeros(language_id.DIMS)
        for place, n in Counter(gram_places(r["text"])).items():
            v[place] = np.log1p(n) * model.idf[place]
        cos = model.centroids @ (v / (np.linalg.norm(v) or 1))
        assert abs(got[r["doc_id"]].score - min(max(cos.max(), 0), 1)) < 1e-4
        assert got[r["doc_id"]].lang_pred == model.languages[int(cos.argmax())] or np.sort(cos)[-1] - np.sort(cos)[-2] < 1e-4


def test_held_out_labels_are_not_learned(spark, docs):
    changed = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    columns = ("doc_id", "lang_pred", "score")
    assert sorted(language_id.identify(docs).select(*columns).collect()) == sorted(language_id.identify(changed).select(*columns).collect())


def test_language_bounds(spark, docs):
    with pytest.raises(ValueError, match="languages"):
        language_id.fit_classifier(docs, F.lit(True), most_languages=2)
    model = language_id.fit_classifier(docs, F.lit(True), sample_bytes=1)  # a document a language is left
    assert sorted(set(model.languages)) == ["de", "en", "es", "fr"] and len(model.languages) == 4
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("en").alias("lang"))
    assert language_id.predict(many, model).filter("lang_pred = 'und'").count() == 20_000


# ------------------------------------------------------------------------------------------ tokens


@lru_cache
def tokenizer(special):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = not special
    return t


def plain_tokens(texts, special=True):
    t = tokenizer(special)
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def encoded(encoder, texts):
    import pyarrow as pa

    ids, counts = encoder.encode(*common.flat(pa.array(texts, pa.string())))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


def test_plain_calls(spark):
    a, b = thue_morse(4096)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", f"x {a}", f"x {b}", f"{b} {a}", "a  b\t c \n", "　wide　 blanks ", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    start, want = 0, []
    for k, ids in enumerate(plain_tokens(texts)):
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in token_output.token_output(df, TOKENIZER, special=True).orderBy("doc_id").collect()] == want
    assert 50256 in plain_tokens(texts)[0]


@pytest.mark.parametrize("special", [True, False])
def test_encoder_on_random_texts(special):
    rng, encoder = random.Random(special), token_output.Encoder(TOKENIZER, 0, special, most=200)
    parts = ["a", "b", "B", "1", "9", ".", " ", " ", "  ", "\n", "\t", " ", "　", "\xa0", "é", "日", "'s", "<|endoftext|>", "\x1c", "\x85", "​", "᠎", "½", "\0", " x", "word", " word"]
    for _ in range(150):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(0, 8))] + [None]
        assert encoded(encoder, texts) == plain_tokens(texts, special)


def test_encoder_with_colliding_hashes(monkeypatch):
    real = common.Words.hashes
    monkeypatch.setattr(common.Words, "hashes", lambda self, lower=False: real(self, lower) % np.uint64(40))
    rng, encoder = random.Random(5), token_output.Encoder(TOKENIZER, 0, True, most=20)
    for _ in range(60):
        texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 30))) for _ in range(5)]
        assert encoded(encoder, texts) == plain_tokens(texts)


def test_other_kinds_of_tokenizers_encode_whole_texts(tmp_path):
    import json

    with open(TOKENIZER, encoding="utf-8") as f:
        said = json.load(f)
    said["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [said["pre_tokenizer"]]}
    (tmp_path / "t.json").write_text(json.dumps(said))
    encoder = token_output.Encoder(str(tmp_path / "t.json"))
    assert not encoder.by_piece and encoded(encoder, ["some words here", "", "a  b"]) == plain_tokens(["some words here", "", "a  b"])


def test_rows_without_ids_are_spread(spark):
    df = spark.createDataFrame([(None, f"text {i}") for i in range(400)] + [(1, "x")], "doc_id long, text string").repartition(4)
    out = common.fresh_path(spark, "spread")
    token_output.write_tokens(df, out, TOKENIZER)
    files = spark.read.parquet(out).groupBy("file").count().collect()
    rows = token_output.read_tokens(spark, out).orderBy("start").collect()
    assert len(files) > 1 and len(rows) == 401 and rows[-1].doc_id == 1 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


# ------------------------------------------------------------------------------------------ licenses


def test_planted_notices_anywhere(spark, docs, table):
    """Templates in prose, on lines of their own, wrapped with comment marks, with a word left out of long ones."""
    rng = random.Random(13)
    prose = [" ".join(r["text"].split()) for r in table if len(r["text"]) > 400 and "icense" not in r["text"] and "reserved" not in r["text"]]
    given, want = [], {}
    for i in range(150):
        family = rng.choice([f for f in licenses.FAMILIES if f != licenses.RESERVED])
        w = rng.choice(licenses.TEMPLATES[family]).split()
        if len(w) > 25:
            w.pop(rng.randrange(12, len(w) - 8))
        kind = rng.randrange(3)
        notice = " ".join(w) if kind < 2 else "\n".join(" * " + " ".join(w[j : j + 7]) for j in range(0, len(w), 7))
        a, b = (rng.choice(prose)[:300].rsplit(" ", 1)[0] for _ in range(2))
        gap = " " if kind == 0 else "\n"
        given.append((10_000 + i, f"{a}{gap}{notice}{gap}{b}"))
        want[10_000 + i] = family
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(given, "doc_id long, text string"))
    got = {r.doc_id: r.families for r in licenses.scan_licenses(df).filter("doc_id >= 10000").collect()}
    wrong = {k: (want[k], got[k]) for k in want if got[k] != want[k]}
    assert len(wrong) <= 3, wrong


def test_repeated_notices(spark, docs):
    text = "Released under the MIT License.\nplain line\nReleased under the MIT License."
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000, text)] * 2, "doc_id long, text string"))
    assert [(r.families, r.n_licenses, r.n_paragraphs) for r in licenses.scan_licenses(df).filter("doc_id = 10000").collect()] == [("mit", 2, 3)] * 2


# ------------------------------------------------------------------------------------------ media


def test_media_forms_are_recomputed(spark, table):
    got = {r.doc_id: r for r in queries.op8_media_columns(spark, SF).collect()}
    for r in table:
        raw = r["text"].encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        media = media_archive.MEDIA.pack(b"LM8S", media_archive.RATE, len(padded)) + zlib.compress(padded, 1)
        counts = Counter(padded)
        mean = sum(k * n for k, n in counts.items()) / len(padded)
        dev = max(0.0, sum(k * k * n for k, n in counts.items()) / len(padded) - mean * mean) ** 0.5
        cross = sum((a > 101) != (b > 101) for a, b in zip(padded, padded[1:], strict=False))
        top = min(counts, key=lambda k: (-counts[k], k))
        g = got[r["doc_id"]]
        assert (g.media_bytes, g.media_sha256, g.feature) == (len(media), hashlib.sha256(media).hexdigest(), f"mean={mean:.4f};dev={dev:.4f};cross={cross};top={top}")


def rows_of(spark, *ids):
    return spark.createDataFrame([(i, f"text of {i} " * 30) for i in ids], "doc_id long, text string").coalesce(1)


def test_appended_archives_stay(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    media_archive.write_archives(rows_of(spark, 1, 2), path)
    media_archive.write_archives(rows_of(spark, 3), path)
    ids = lambda: sorted(r.doc_id for r in media_archive.read_archives(spark, path).collect())
    assert ids() == [1, 2, 3]
    rows_of(spark, 9).select("doc_id", "text").write.format("leafmill_archive").mode("overwrite").save(path)
    assert ids() == [9] and len(list((tmp_path / "a").glob("*.lma"))) == 1
    with pytest.raises(Exception, match="manifest"):
        media_archive.read_archives(spark, f"file://{tmp_path}/none").collect()


@pytest.mark.parametrize("harm", ["end", "cut", "order"])
def test_members_without_an_index(spark, tmp_path, harm):
    path = f"file://{tmp_path}/a"
    media_archive.write_archives(rows_of(spark, *range(50)), path)
    file = next((tmp_path / "a").glob("*.lma"))
    raw = bytearray(file.read_bytes())
    if harm == "end":
        raw[-1] ^= 255
    elif harm == "cut":
        raw = raw[:-40]
    else:
        raw[-media_archive.END.size - 16 : -media_archive.END.size] = bytes(16)
    raw[media_archive.MEMBER.size + 20] ^= 255  # and the first member's media
    file.write_bytes(bytes(raw))
    got = media_archive.read_archives(spark, path, range_bytes=700).collect()
    assert sorted(r.doc_id for r in got) == list(range(50)) and [r.doc_id for r in got if r.error] == [0]


def test_stores_by_their_names():
    assert media_archive._STORES == {"s3a": "s3", "s3n": "s3", "gcs": "gs"}
    assert media_archive._store("file:///tmp/x")[1] == "/tmp/x" and media_archive._store("/tmp/x")[1] == "/tmp/x"


# ------------------------------------------------------------------------------------------ packing and the pipeline


def test_bins_hold_a_source_once(spark):
    held = defaultdict(list)
    for r in queries.op10_packing(spark, SF).collect():
        if r.bin_id is not None:
            held[r.bin_id].append(r.source)
    assert all(len(set(x)) == len(x) for x in held.values())


def linked(rows, percent):
    sets = {}
    for k, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {k: k for k in sets}
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
    return {k: root(k) for k in sets}


def test_pipeline_stages_from_080(spark, docs):
    """Every stage against brute force on what the one before it kept; near copies from a similarity of 0.8 on."""
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = sorted((r.doc_id, r.text) for r in kept.collect())
        kept = common.written(stage(spark, kept, SF), f"from-080-{name}")
        assert kept.columns == docs.columns
        after = sorted((r.doc_id, r.text) for r in kept.collect())
        if name == "language_id":
            assert len(after) >= len(before) - 2 and set(after) <= set(before)
        elif name == "near_dedup":
            assert after == [x for x in before if linked(before, 80)[x[0]] == x[0]]
        elif name == "substring_dedup":
            want = {k: sha for k, _, _, sha in removed([(k, words(t)) for k, t in before], 50)}
            assert [k for k, _ in after] == [k for k, _ in before] and all(hashlib.sha256(b" ".join(words(t))).hexdigest() == want[k] for k, t in after)
        else:
            assert set(after) <= set(before) and max(Counter(k for k, _ in after).values()) <= 2
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert packed.agg(F.sum("n_words")).first()[0] == sum(len(words(r.text)) for r in kept.collect())
    assert corpus_pipeline.run(spark, SF).count() == packed.count()
