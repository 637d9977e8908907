"""Substring dedup: Rabin-Karp hashes of every window of `window` words, counted in Spark.

Documents are dealt into segments, runs of ascending ids of about `seg_bytes` of text, cut by the running sum of
the texts' bytes over the sorted ids, however the ids lie; an id whose rows have more than that has several segments of one
rank. Each segment sends its distinct window hashes once (pre-aggregated), sorted and delta-coded in blobs by
hash bucket, so that a window costs about six bytes of shuffle and a passage that a third of all
documents share costs one entry a segment. A bucket answers each segment with a bitmap: which of
its hashes also occur in a segment of lower rank. The segment then hashes its texts anew, settles
repeats among its own documents, merges repeated windows into maximal intervals and removes them.
The texts move once: both passes read the same exchange.

Bounds: the driver and each worker hold one id a segment; there are 4 million at most, as segments grow beyond
16 MB once there are 32 TB of text. A bucket has some 250,000 hashes, more only where blobs would
get shorter than 8 hashes: 20 million at 100 TB. Words have random-like 64-bit hashes and windows a polynomial of them
modulo 2**64; a window that occurs nowhere else is removed with a chance of about (number of distinct windows) / 2**64,
though of windows that are words of two kinds in the same Thue-Morse-like order, two meet with a chance of some 2**-38.

Defined results: a null or empty text has no words and stays as it is; texts of fewer than `window`
words lose nothing; rows with a null id neither lose words nor make others lose them; rows of one
id are not earlier than each other; extra columns pass through, whatever they are called (in a report, one
that is called like a result column gets `_in` behind its name); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, apart, beside, flat, partitions, place, rolling_in_rows, slices, written

SEG, BUCKET, KEY, TEXT = "__seg", "__bucket", "__id", "__text"
RESULTS = ["n_words", "n_removed", "kept_sha256"]


def encode(sorted_hashes: np.ndarray) -> bytes:
    """Deltas of sorted 64-bit hashes as eight byte planes; the high planes are zeros."""
    d = np.diff(sorted_hashes, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def decode(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def windows(column, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """Hash, word place and row of every window of a text column; words a row; parts for the texts."""
    data, offsets = flat(column)
    hashes, places, rows, counts, parts, before = [], [], [], [], [], 0
    for i, j in slices(offsets):
        w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        h, at = rolling_in_rows(w.hashes(), w.bounds, window)
        hashes.append(h)
        places.append(at + before)
        rows.append(np.searchsorted(w.bounds, at, "right") - 1 + i)
        counts.append(np.diff(w.bounds))
        parts.append(w)
        before += len(w.starts)
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return cat(hashes, np.uint64), cat(places, np.int64), cat(rows, np.int64), cat(counts, np.int64), parts


def _bounds(seg_bytes: int):
    """Least id and number of segments of each run of about seg_bytes; rows are (id, bytes) in order of id."""

    def run(batches):
        before, last = 0, -1
        for batch in batches:
            ids, size = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            ends = before + np.cumsum(size)
            run_of = (ends - size) // seg_bytes
            big = size > seg_bytes
            new = big | (run_of != np.concatenate([[last], run_of[:-1]]))
            new[1:] |= big[:-1]
            if len(ids):
                before, last = int(ends[-1]), -1 if big[-1] else int(run_of[-1])
            yield pa.record_batch({"low": pa.array(ids[new]), "copies": pa.array(np.where(big, -(-size // seg_bytes), 1)[new].astype(np.int64))})

    return run


def _segments(rows: DataFrame, seg_bytes: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least id, first number and count of the segments of each run of ids."""
    sizes = rows.groupBy(KEY).agg(F.sum(F.coalesce(F.octet_length(TEXT), F.lit(0))).cast("long").alias("size"))
    cut = sizes.repartitionByRange(parts, KEY).sortWithinPartitions(KEY).mapInArrow(_bounds(seg_bytes), "low long, copies long")
    got = sorted((r.low, r.copies) for r in written(cut, "segments").collect())
    low, copies = (np.array([x[i] for x in got], np.int64) for i in (0, 1))
    return low, np.cumsum(copies) - copies, copies


def _dealt(rows: DataFrame, bounds, parts: int) -> DataFrame:
    """rows with the number of their segment."""
    known = rows.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf(T.LongType())
    def seg(ids: pd.Series, pick: pd.Series) -> pd.Series:
        low, first, copies = known.value
        at = np.searchsorted(low, ids.to_numpy(), "right") - 1
        return pd.Series(first[at] + pick.to_numpy() % copies[at])

    # Only an id of several segments needs a hash; with the input partition in it, repeated rows are spread as well.
    pick = F.pmod(F.xxhash64(TEXT, F.spark_partition_id()), F.lit(1 << 30)) if (bounds[2] > 1).any() else F.lit(0).cast("long")
    return rows.withColumn(SEG, seg(F.col(KEY), pick)).repartition(parts, F.col(SEG))


def _send(bits: int, window: int):
    def send(t: pa.Table) -> pa.Table:
        u = np.unique(windows(t[TEXT], window)[0]) if len(t) else np.zeros(0, np.uint64)
        cut = np.searchsorted(u, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        blobs = [(b, encode(x)) for b, x in enumerate(np.split(u, cut)) if len(x)]
        return pa.table({BUCKET: pa.array([b for b, _ in blobs], pa.int64()), SEG: pa.array([t[SEG][0].as_py()] * len(blobs), pa.int64()), "blob": pa.array([x for _, x in blobs], pa.binary())})

    return send


def _answer(known):
    def answer(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t[1].to_numpy(), kind="stable")))
        each = [decode(x.as_buffer()) for x in t[2].combine_chunks()] if len(t) else []
        h = np.concatenate(each) if each else np.zeros(0, np.uint64)
        rank = np.searchsorted(known.value[1], t[1].to_numpy(), "right")  # segments of one id have one rank
        of = np.repeat(rank, [len(x) for x in each]) if each else rank
        by = np.argsort(h, kind="stable")  # equal hashes in the order of their segments
        first = np.flatnonzero(np.append(True, h[by][1:] != h[by][:-1])[: len(h)])
        late = np.zeros(len(h), bool)
        late[by] = of[by] > np.repeat(of[by[first]], np.diff(first, append=len(h)))
        out, at = [], 0
        for x in each:
            out.append(np.packbits(late[at : at + len(x)]).tobytes() if late[at : at + len(x)].any() else None)
            at += len(x)
        bits = pa.table({SEG: t[1], BUCKET: t[0], "late": pa.array(out, pa.binary())})
        return bits.filter(pa.array([x is not None for x in out], pa.bool_()))

    return answer


def removed_words(ids: np.ndarray, column, window: int, bits: int, late: dict[int, bytes]):
    """Mask of removed words, words a row, and the parts of a segment's texts (rows in order of id)."""
    h, place, row, counts, parts = windows(column, window)
    n = int(counts.sum())
    u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    gone = np.zeros(len(u), bool)
    cut = np.searchsorted(u, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    edges = [0, *cut.tolist(), len(u)]
    for b, raw in late.items():
        gone[edges[b] : edges[b + 1]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=edges[b + 1] - edges[b]).astype(bool)
    # np.unique's first index is the smallest place, which is in the row of the smallest id
    hit = gone[inverse] | (ids[row] > ids[row[first]][inverse]) if len(h) else np.zeros(0, bool)
    step = np.zeros(n + window + 1, np.int32)
    step[place[hit]] += 1
    step[place[hit] + window] -= 1
    return np.cumsum(step[:n]) > 0, counts, parts


def _settle(names: list[str], window: int, bits: int, report: bool):
    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table({k: pa.array([], left.schema.field(k).type) for k in names} | {"n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())})
        ids = left[KEY].to_numpy()
        order = np.argsort(ids, kind="stable")
        left, ids = left.take(pa.array(order)), ids[order]
        late = {b.as_py(): x.as_py() for b, x in zip(right[BUCKET], right["late"], strict=True)}
        gone, counts, parts = removed_words(ids, left[TEXT], window, bits, late)
        ends = np.cumsum(counts)
        total = np.concatenate([[0], np.cumsum(gone)])
        lost = total[ends] - total[ends - counts]
        texts, shas, row, at = [], [], 0, 0
        for w in parts:
            for d in range(len(w.bounds) - 1):
                n = int(counts[row])
                raw = w.data[w.offsets[d] : w.offsets[d + 1]].tobytes() if report or lost[row] else b""
                kept = None
                if lost[row]:
                    kept = b" ".join(compress(raw.split(), (~gone[at : at + n]).tolist()))
                elif report:
                    kept = b" ".join(raw.split())
                shas.append(hashlib.sha256(kept).hexdigest() if report else None)
                texts.append(kept if lost[row] else None)
                at += n
                row += 1
        out = left.select(names)
        if not report and lost.any():
            was = left[TEXT].combine_chunks() if isinstance(left[TEXT], pa.ChunkedArray) else left[TEXT]
            now = pa.array([x.decode("utf-8") if x is not None else None for x in texts], was.type)
            out = out.set_column(names.index(TEXT), TEXT, pc.if_else(pa.array(lost > 0), now, was))
        return out.append_column("n_words", pa.array(counts)).append_column("n_removed", pa.array(lost.astype(np.int64))).append_column("kept_sha256", pa.array(shas, pa.string()))

    return settle


def _unremoved(names: list[str]):
    """The report of rows that lose nothing."""

    def run(batches):
        for batch in batches:
            texts = [(x.as_py() or "").encode().split() for x in batch.column(batch.schema.get_field_index(TEXT))]
            given = {k: batch.column(batch.schema.get_field_index(k)) for k in names}
            shas = [hashlib.sha256(b" ".join(x)).hexdigest() for x in texts]
            yield pa.record_batch(given | {"n_words": pa.array([len(x) for x in texts], pa.int64()), "n_removed": pa.array([0] * len(texts), pa.int64()), "kept_sha256": pa.array(shas, pa.string())})

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, report: bool = False) -> DataFrame:
    """The documents without words of repeated windows. A window is repeated if its words also start
    in a document of smaller id.

    Texts that lose words become the kept words joined by a space; others stay as they are. With
    `report`, the columns are those of docs except the text, and n_words, n_removed and kept_sha256;
    else they are the columns of docs.
    """
    spark = docs.sparkSession
    rows, given = apart(docs, **{KEY: id_col, TEXT: text_col})
    text = place(given, text_col)
    rows = rows.drop(text).withColumn(KEY, F.col(KEY).cast("long"))
    size = rows.agg(F.sum(F.octet_length(TEXT))).first()[0] or 0
    seg_bytes = max(min(16 << 20, max(1 << 20, size // 4096)), size >> 21)
    wanted, most = (size // 6) // 250_000, (seg_bytes // 6) // 8
    bits = max(4, min(wanted.bit_length(), most.bit_length()))
    parts = partitions(spark, size)
    names = [k for k in given if k != text] + ([] if report else [TEXT])
    fields = {f.name: f for f in rows.schema.fields}
    out = T.StructType([fields[c] for c in names] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    loose = rows.filter(F.col(KEY).isNull())  # concern nobody, so they aren't moved
    done = loose.mapInArrow(_unremoved(names), out) if report else loose.select(*names)
    some = rows.filter(F.col(KEY).isNotNull())
    bounds = _segments(some, seg_bytes, parts)
    if len(bounds[0]):
        dealt = _dealt(some, bounds, parts)
        # All columns, though only two are used: so both passes have the same exchange, and share it.
        blobs = dealt.groupBy(SEG).applyInArrow(_send(bits, window), f"{BUCKET} long, {SEG} long, blob binary")
        answers = blobs.repartition(parts, F.col(BUCKET)).groupBy(BUCKET).applyInArrow(_answer(spark.sparkContext.broadcast(bounds)), f"{SEG} long, {BUCKET} long, late binary")
        answers = answers.repartition(parts, F.col(SEG))
        settled = dealt.groupBy(SEG).cogroup(answers.groupBy(SEG)).applyInArrow(_settle(names, window, bits, report), out)
        done = settled.select(*done.columns).unionByName(done)
    if report:
        return done.select(*beside({k: v for k, v in given.items() if k != text}, RESULTS), *RESULTS)
    return done.select(*(F.col(TEXT if k == text else k).alias(v) for k, v in given.items()))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i : i + 49], ' ')))) AS h FROM d WHERE len(w) >= 50),
f AS (SELECT h, min(doc_id) AS first FROM p GROUP BY h),
r AS (SELECT DISTINCT doc_id, i + o AS i FROM p JOIN f USING (h), (SELECT unnest(range(0, 50)) AS o) WHERE doc_id > first),
u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM u ANTI JOIN r USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
