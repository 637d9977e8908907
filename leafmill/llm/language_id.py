"""Language ID by nearest centroid: TF-IDF vectors of hashed byte n-grams, several centroids a language.

Texts become counts of byte 2- and 3-grams of their letters (A-Z folded, bytes that are no letters as one
blank), hashed to `DIMS` places, dampened, weighted by inverse document frequency and normalised.
Each language's documents are clustered by spherical k-means into `clusters` centroids; a text gets
the language of the centroid of the largest cosine. Distance-based rejection: short texts have small cosines, so
each centroid has a floor for every band of lengths (a power of two of letters): the cosine that 90 of 100 windows of
training texts of that length reach with centroids fitted without them. A text is rejected below `reject` times the floor
of its length, interpolated between bands.

The classifier is fitted on at most `sample` documents a language, and `sample_bytes` of their text (one document at least),
the ones of the smallest hash of their ids: the stated bound of training. The driver and each worker hold clusters x DIMS
floats a language (64 KB); more than `most_languages` values of the language column are an error. Predictions are made for whole texts.

Defined results: a null text, or one without a letter, is `und` with score 0 and rejected; ties go
to the language of the smallest code points; without any training document all texts are `und`;
repeated rows get equal results; extra columns pass through, and one that is called like a result column gets `_in`
behind its name; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, beside, flat, place, slices, written

RESULTS = ["lang_pred", "score", "rejected"]

DIMS = 4096
BANDS = 14  # of lengths; the last has no end
ROWS = 256  # at once, however short: a row has DIMS counts
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Classifier:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # a row each, of length 1
    idf: np.ndarray
    floors: np.ndarray  # of each centroid and band of lengths: cosines of texts like those it is made of


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed 2- and 3-grams of some rows."""
    n = len(offsets) - 1
    x = _FOLD[data].astype(np.uint32)
    row = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros(n * DIMS, np.float32)
    for k, salt in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
        if len(x) < k:
            continue
        code = x[: len(x) - k + 1].copy()
        for j in range(1, k):
            code = (code << np.uint32(8)) | x[j : len(x) - k + 1 + j]
        h = ((code * np.uint32(salt)) >> np.uint32(20)).astype(np.int64)
        first, last = row[: len(code)], row[k - 1 :]
        same = first == last
        out += np.bincount(first[same] * DIMS + h[same], minlength=n * DIMS).astype(np.float32)
    return out.reshape(n, DIMS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Dampened, weighted rows of length 1 (or 0)."""
    v = np.log1p(counts) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=v, where=norm > 0)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Does each row have a letter of any script?"""
    ascii_letter = np.concatenate([[0], np.cumsum((_FOLD[data] > 96) & (data < 128))])
    out = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def _kmeans(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread starts: each next start is the row that is least like those before."""
    starts = [0]
    best = v @ v[0]
    while len(starts) < min(k, len(v)):
        starts.append(int(best.argmin()))
        best = np.maximum(best, v @ v[starts[-1]])
    c = v[starts].copy()
    for _ in range(rounds):
        near = (v @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (near == j).any():
                m = v[near == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def log_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log2 of each row's number of letter bytes; band k is from k to k + 1."""
    letters = np.concatenate([[0], np.cumsum(_FOLD[data] != 32)])
    n = letters[offsets[1:]] - letters[offsets[:-1]]
    return np.log2(np.maximum(n, 1))


def _floors(texts: list[np.ndarray], v: np.ndarray, idf: np.ndarray, clusters: int) -> np.ndarray:
    """By band of lengths, the cosine that 90 of 100 windows of the texts reach, each with centroids of the other half of texts.

    A band of fewer than 20 windows takes the one before; 0 without any.
    """
    rng = np.random.default_rng(0)
    found: list[list[float]] = [[] for _ in range(BANDS)]
    half = np.arange(len(v)) % 2
    for side in (0, 1) if len(v) > 1 else ():
        c = _kmeans(v[half == 1 - side], clusters)
        rest = [texts[i] for i in np.flatnonzero(half == side)]
        for k in range(1, BANDS + 1):
            some = rest * -(-200 // max(1, len(rest)))
            n = (2.0**k * 2.0 ** rng.random(len(some))).astype(np.int64)
            cut = [x[(a := rng.integers(0, len(x) - m + 1)) : a + m] for x, m in zip(some, n.tolist(), strict=True) if len(x) >= m]
            for i in range(0, len(cut), 100):
                data, offsets = np.concatenate(cut[i : i + 100]), np.concatenate([[0], np.cumsum([len(x) for x in cut[i : i + 100]])])
                cos = (vectors(term_counts(data, offsets), idf) @ c.T).max(axis=1)
                for band, x, letter in zip(np.minimum(log_letters(data, offsets), BANDS - 1).astype(int).tolist(), cos.tolist(), has_letter(data, offsets).tolist(), strict=True):
                    if letter:
                        found[band].append(x)
    out = np.zeros(BANDS)
    for band, x in enumerate(found):
        out[band] = np.quantile(x, 0.1) if len(x) >= 20 else out[band - 1] if band else 0.0
    return out


def _document_frequency(batches):
    for batch in batches:
        data, offsets = flat(batch.column(0))
        seen = np.zeros(DIMS, np.int64)
        for i, j in slices(offsets, 4 << 20, ROWS):
            seen += (term_counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) > 0).sum(axis=0)
        yield pa.record_batch({"term": pa.array(np.arange(DIMS)), "df": pa.array(seen)})


def _fit(idf: np.ndarray, clusters: int):
    def fit(t: pa.Table) -> pa.Table:
        parts = []
        data, offsets = flat(t["text"])
        for i, j in slices(offsets, 4 << 20, ROWS):
            parts.append(vectors(term_counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), idf))
        v = np.concatenate(parts)
        c = _kmeans(v, clusters)
        floors = _floors([data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], v, idf, clusters)
        return pa.table({"lang": pa.array([t["lang"][0].as_py()] * len(c)), "centroid": pa.array([x.astype("<f4").tobytes() for x in c], pa.binary()), "floors": pa.array([floors.tolist()] * len(c))})

    return fit


def fit_classifier(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 400, clusters: int = 4, sample_bytes: int = 64 << 20, most_languages: int = 2000) -> Classifier:
    """A classifier of the documents for which `learn` holds and that have a text and a language."""
    rows = docs.filter(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(F.lit("language"), id_col).alias("h"), F.col(text_col).alias("text"))
    counts = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    if counts.count() > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    # A share of each language that has twice the sample on average, then the first of them.
    share = F.pmod("h", F.lit(1 << 30)) <= F.least(F.lit(1.0), F.lit(2.0 * sample) / F.col("n")) * (1 << 30)
    first = Window.partitionBy("lang").orderBy("h", "text")
    some = rows.join(F.broadcast(counts), "lang").filter(share)
    some = some.withColumns({"__n": F.row_number().over(first), "__sum": F.sum(F.octet_length("text")).over(first)})
    some = written(some.filter((F.col("__n") == 1) | (F.col("__n") <= sample) & (F.col("__sum") <= sample_bytes)).select("lang", "text"), "language-sample")
    total = some.count()
    df = np.zeros(DIMS)
    for r in some.select("text").mapInArrow(_document_frequency, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    got = some.groupBy("lang").applyInArrow(_fit(idf, clusters), "lang string, centroid binary, floors array<double>").collect()
    got.sort(key=lambda r: r.lang.encode())
    centroids = np.array([np.frombuffer(r.centroid, "<f4") for r in got]).reshape(-1, DIMS)
    return Classifier([r.lang for r in got], centroids, idf, np.array([r.floors for r in got]).reshape(-1, BANDS))


def _predict(known, names: list[str], reject: float):
    def run(batches):
        model: Classifier = known.value
        langs = np.array(model.languages or ["und"], object)
        for batch in batches:
            data, offsets = flat(batch.column(batch.schema.get_field_index("__text")))
            for i, j in slices(offsets, 1 << 20, ROWS):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                pred, score, floor = np.full(j - i, "und", object), np.zeros(j - i), np.zeros(j - i)
                if len(model.languages):
                    cos = vectors(term_counts(part, at), model.idf) @ model.centroids.T
                    letters = has_letter(part, at)
                    pred[letters] = langs[cos.argmax(axis=1)][letters]
                    score[letters] = np.clip(cos.max(axis=1), 0, 1)[letters]
                    place = np.clip(log_letters(part, at) - 0.5, 0, BANDS - 1)
                    low, near = place.astype(int), cos.argmax(axis=1)
                    a, b = model.floors[near, low], model.floors[near, np.minimum(low + 1, BANDS - 1)]
                    floor = a + (b - a) * (place - low)
                rejected = (pred == "und") | (score < reject * floor)
                out = [batch.column(batch.schema.get_field_index(k)).slice(i, j - i) for k in names]
                yield pa.record_batch([*out, pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(rejected)], names=[*names, *RESULTS])

    return run


def predict(docs: DataFrame, model: Classifier, text_col: str = "text", reject: float = 0.4, keep_text: bool = False) -> DataFrame:
    """docs with lang_pred, score and rejected; without the text, unless it is to be kept."""
    rows, given = apart(docs, __text=text_col)
    text = place(given, text_col)
    rows = rows.drop(text)
    names = [k for k in given if k != text] + (["__text"] if keep_text else [])
    fields = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([fields[k] for k in names] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    out = rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), names, reject), schema)
    if keep_text:
        out = out.withColumnRenamed("__text", text)
    return out.select(*beside(given, RESULTS, () if keep_text else [text]), *RESULTS)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that the classifier may not learn from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fit) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), learning from documents that aren't held out."""
    given = apart(docs, doc_id=id_col, text=text_col, lang=lang_col)[0].select("doc_id", "text", "lang")
    model = fit_classifier(given, ~held_out() & F.col("doc_id").isNotNull(), **fit)
    return predict(given.select("doc_id", held_out().alias("held_out"), "text"), model)
