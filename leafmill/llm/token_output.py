"""Token-ID output: texts as Simple-8b segments in files of ascending document id, and back.

Documents are range-partitioned by id; each partition is a file of segments of about 1 MB of text.
The files are Parquet with one segment a row, written through Spark, so that they may lie in any
store, and retried or speculative tasks leave no stray segment. A document's place in the whole
stream is the sum of the files before, of the segments before in its file, and of the documents before
in its segment: two small sums, no global sort.

Encoding keeps the ids of distinct pieces in a bounded table of the worker, keyed by the pieces themselves: texts
are cut at blanks between two characters that aren't white space, which a byte-level tokenizer with its usual pattern
never joins over, so the ids of a text are those of its pieces. Texts with a token that the tokenizer takes out first
(`<|endoftext|>`), and all texts of other kinds of tokenizers, are encoded whole.

Defined results: a null or empty text has only the end id; strings of special tokens in a text become those tokens if
`special` (as a plain call of the library does), else they are ordinary text; rows with a null id come first, with the id
null; rows of one id, or of none, keep all their rows, in the order of a hash of their texts; other columns are not
written; an empty table gives empty files and an empty table.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import Words, apart, flat, fresh_path, partitions, slices

_SPACE = np.zeros(256, bool)  # white space of one byte
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_NONE = np.zeros(256, bool)
_NULL_ID = -(1 << 63)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of the blanks between two characters that aren't white space, none at the ends of rows."""
    space = np.concatenate([_SPACE[data], np.ones(3, bool)])
    at = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if len(at):  # white space of two or three bytes
        x = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b, c = x[at], x[at + 1], x[at + 2]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = (a == 0xE1) & ((b == 0x9A) & (c == 0x80) | (b == 0xA0) & (c == 0x8E)) | (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        three |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8B) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        for k in range(3):
            space[at[three] + k] = True
            if k < 2:
                space[at[two] + k] = True
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    found = np.flatnonzero(data == 32)
    found = found[(found > 0) & ~edge[found]]
    return found[~space[found - 1] & ~space[found + 1] & ~edge[found + 1]]


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `size` items at `start`, one behind the other, and their new starts."""
    begin = np.cumsum(size) - size
    return data[np.repeat(start - begin, size) + np.arange(int(size.sum()))], begin


def _byte_level(said: dict) -> bool:
    """Is it a byte-level BPE with the usual pattern and nothing else that changes a text or its ids?"""
    cut, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
    usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    plain = not any(said.get(k) for k in ("normalizer", "truncation", "padding"))
    return bool(usual and plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")))


class Encoder:
    """Ids of texts, with the end id, a batch of rows at once.

    A batch's distinct pieces are found by 64-bit hashes in a sorted table, and their bytes are compared with
    the table's; it points into a pool of ids. Beyond `most` pieces, the half used longest ago goes before the next batch.
    """

    def __init__(self, path: str, end_id: int = 0, special: bool = False, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.by_piece = _byte_level(said)
        self.taken_first = [t["content"].encode() for t in said.get("added_tokens") or () if (special or not t.get("special")) and t["content"]]
        vocabulary = self.tokenizer.get_vocab()
        self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each token: a character of its name is a byte
        for name, i in vocabulary.items():
            self.length[i] = len(name)
        self.end, self.most, self.round = end_id, most, 0
        self.known = np.zeros(0, np.uint64)
        self.start = self.count = self.used = self.text_start = self.text_len = np.zeros(0, np.int64)  # of each known piece
        self.pool, self.size = np.zeros(1 << 20, "<u4"), 0  # `size` ids of it are in use
        self.text = np.zeros(0, np.uint8)  # bytes of the known pieces

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after the other, and their counts."""
        pools, counts = [np.zeros(0, "<u4")], []
        for i in range(0, len(texts), 200):
            for e in self.tokenizer.encode_batch_fast(texts[i : i + 200], add_special_tokens=False):
                pools.append(np.array(e.ids, "<u4"))
                counts.append(len(e))
        return np.concatenate(pools), np.array(counts, np.int64)

    def compute(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """`each` for pieces that may follow each other in a text: many at once, cut by the tokens' lengths."""
        pools, counts = [], []
        parts = [new[i : i + 200] for i in range(0, len(new), 200)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(["".join(x) for x in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.cumsum(self.length[ids])
            want = np.cumsum([len(x.encode()) for x in part])
            cut = np.minimum(np.searchsorted(ends, want), max(0, len(ends) - 1))
            if len(ends) and ends[-1] == want[-1] and (ends[cut] == want).all():
                n = np.diff(cut + 1, prepend=0)
            else:
                ids, n = self.each(part)
            pools.append(ids)
            counts.append(n)
        return np.concatenate(pools), np.concatenate(counts)

    def put(self, ids: np.ndarray) -> int:
        """Writes ids behind those in use and returns their place."""
        end = self.size + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.size], np.zeros(max(end, self.size), "<u4")])
        self.pool[self.size : end] = ids
        return self.size

    def forget(self) -> None:
        """Keeps the pieces used latest, half of them at most."""
        keep = self.used > np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]
        self.pool, self.start = gathered(self.pool, self.start[keep], self.count[keep])
        self.text, self.text_start = gathered(self.text, self.text_start[keep], self.text_len[keep])
        self.size = len(self.pool)
        self.known, self.count, self.used, self.text_len = self.known[keep], self.count[keep], self.used[keep], self.text_len[keep]

    def learn(self, h: np.ndarray, new: list[bytes]) -> None:
        """Adds pieces of new, sorted hashes: those that begin with their blank and end in no white space are encoded together."""
        texts = [x.decode() for x in new]
        joint = np.array([x[0] == " " and not x[-1].isspace() for x in texts])
        start, count = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        for mine, of in ((joint, self.compute), (~joint, self.each)):
            if mine.any():
                ids, n = of([texts[i] for i in np.flatnonzero(mine).tolist()])
                start[mine], count[mine] = self.put(ids) + np.cumsum(n) - n, n
                self.size += len(ids)
        size = np.array([len(x) for x in new], np.int64)
        at = np.searchsorted(self.known, h)
        places = len(self.text) + np.cumsum(size) - size
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(new), np.uint8)])
        self.known = np.insert(self.known, at, h)
        for name, x in (("start", start), ("count", count), ("used", np.full(len(h), self.round)), ("text_start", places), ("text_len", size)):
            setattr(self, name, np.insert(getattr(self, name), at, x))

    def find(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of sorted hashes in the table, which are there, and which have the very bytes."""
        if not len(self.known):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        there = self.known[at] == h
        same = there & (self.text_len[at] == size)
        mine, theirs = gathered(data, start[same], size[same])[0], gathered(self.text, self.text_start[at[same]], size[same])[0]
        wrong = np.flatnonzero(mine != theirs)
        if len(wrong):
            same[np.flatnonzero(same)[np.searchsorted(np.cumsum(size[same]), wrong, "right")]] = False
        return at, there, same

    def pieces(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and count of the ids of each of some distinct pieces."""
        data, offsets = flat(distinct)
        h, start, size = Words(data, offsets, _NONE).hashes(), offsets[:-1], np.diff(offsets)
        order = np.argsort(h, kind="stable")
        h, start, size = h[order], start[order], size[order]
        at, there, same = self.find(h, data, start, size)
        new = np.flatnonzero(~there & np.append(True, h[1:] != h[:-1])[: len(h)])
        if len(new):
            raw = data.tobytes()
            self.learn(h[new], [raw[a : a + n] for a, n in zip(start[new].tolist(), size[new].tolist(), strict=True)])
            at, there, same = self.find(h, data, start, size)
        self.used[at[same]] = self.round
        begin, count = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        begin[order[same]], count[order[same]] = self.start[at[same]], self.count[at[same]]
        other = np.flatnonzero(~same)  # pieces that have another's hash
        if len(other):
            ids, n = self.each([data[start[i] : start[i] + size[i]].tobytes().decode() for i in other.tolist()])
            begin[order[other]], count[order[other]] = self.put(ids) + np.cumsum(n) - n, n
            self.size += len(ids)
        return begin, count

    def whole_rows(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Rows that are encoded whole."""
        out = np.full(len(offsets) - 1, not self.by_piece)
        for token in self.taken_first if self.by_piece else ():
            at = raw.find(token)
            while at >= 0:  # one that reaches over rows marks a row more
                out[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(token, at + 1)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and their counts."""
        self.round += 1
        if len(self.known) > self.most:
            self.forget()
        n, raw = len(offsets) - 1, data.tobytes()
        entire = self.whole_rows(raw, offsets) & (np.diff(offsets) > 0)
        filled = np.flatnonzero((np.diff(offsets) > 0) & ~entire)
        cut = cuts(data, offsets)
        cut_row = np.searchsorted(offsets, cut, "right") - 1
        cut, cut_row = cut[~entire[cut_row]], cut_row[~entire[cut_row]]
        begins, row = np.concatenate([offsets[filled], cut]), np.concatenate([filled, cut_row])
        order = np.argsort(begins, kind="stable")
        begins, row = begins[order], row[order]
        # A piece ends where the next begins, but for those before rows that are encoded whole.
        ends = np.minimum(np.append(begins[1:], len(data)), offsets[row + 1])
        edges = np.append(begins, ends[-1:])
        if entire.any():
            raw = b"".join([raw[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])
            edges = np.concatenate([[0], np.cumsum(ends - begins)])
        begin, many, of = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(begins):
            pieces = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(raw)).dictionary_encode()
            begin, many = self.pieces(pieces.dictionary)
            of = pieces.indices.to_numpy()

        rest = np.flatnonzero(entire)
        text = data.tobytes() if len(rest) else b""
        extra, sizes = self.each([text[offsets[i] : offsets[i + 1]].decode() for i in rest.tolist()])
        base = self.put(np.append(extra, np.array([self.end], "<u4")))  # for this batch only
        # In the order of rows: the pieces or the whole row, then the end id.
        rows = np.concatenate([row, rest, np.arange(n)])
        order = np.argsort(rows, kind="stable")
        start = np.concatenate([begin[of], base + np.cumsum(sizes) - sizes, np.full(n, base + len(extra))])[order]
        count = np.concatenate([many[of], sizes, np.ones(n, np.int64)])[order]
        return gathered(self.pool, start, count)[0], np.bincount(rows[order], weights=count, minlength=n).astype(np.int64)


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(path: str, end_id: int, special: bool) -> Encoder:
    """One for each Python worker."""
    if (path, end_id, special) not in _ENCODERS:
        _ENCODERS[path, end_id, special] = Encoder(path, end_id, special)
    return _ENCODERS[path, end_id, special]


def _segments(path: str, end_id: int, special: bool, seg_bytes: int):
    def run(batches):
        encoder, file, seq = _encoder(path, end_id, special), TaskContext.get().partitionId(), 0

        for batch in batches:
            data, offsets = flat(batch.column(1))
            keys = pc.fill_null(batch.column(0), _NULL_ID).to_numpy(zero_copy_only=False)
            for i, j in slices(offsets, seg_bytes):
                ids, counts = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                raw = simple8b.write_segment(keys[i:j], counts, ids)
                yield pa.record_batch({"file": pa.array([file], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()), "segment": pa.array([raw], pa.binary())})
                seq += 1

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", special: bool = False, seg_bytes: int = 1 << 20) -> None:
    """Writes the token ids of all texts to `out`. Rows of one id, or of none, are dealt on by a hash of their texts."""
    spark = docs.sparkSession
    rows = apart(docs, __id=id_col, __text=text_col)[0].select(F.col("__id").cast("long").alias("__id"), "__text")
    size = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    order = [F.col("__id"), F.xxhash64("__text")]
    dealt = rows.repartitionByRange(partitions(spark, size), *order).sortWithinPartitions(*order, "__text")
    coded = dealt.mapInArrow(_segments(tokenizer, end_id, special, seg_bytes), "file int, seq int, n_ids long, segment binary")
    coded.write.option("compression", "zstd").parquet(out)


def _documents(batches):
    for batch in batches:
        for file, seq, raw in zip(batch["file"].to_pylist(), batch["seq"].to_pylist(), batch["segment"], strict=True):
            doc_ids, counts, ids = simple8b.read_segment(raw.as_buffer())
            flat, ends = ids.astype("<u4"), np.cumsum(counts)
            crc = [zlib.crc32(flat[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            place = [pa.array(np.full(len(doc_ids), x, np.int32)) for x in (file, seq)]
            yield pa.record_batch({"file": place[0], "seq": place[1], "doc_id": pa.array(doc_ids, mask=doc_ids == _NULL_ID), "start": pa.array(ends - counts), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crc, pa.int64())})


def read_tokens(spark, path: str) -> DataFrame:
    """Document id, start in the stream, count and crc32 of the ids of every document of the files."""
    files = spark.read.schema("file int, seq int, n_ids long, segment binary").parquet(path)
    sums = files.groupBy("file").agg(F.sum("n_ids").alias("of_file"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    sums = sums.withColumn("__file_start", F.coalesce(F.sum("of_file").over(before), F.lit(0))).select("file", "__file_start")
    within = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", "seq", "n_ids").withColumn("__seg_start", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    starts = starts.join(sums, "file").select("file", "seq", (F.col("__file_start") + F.col("__seg_start")).alias("__start"))
    # Segments are decoded where they are read; only a narrow row a document meets the starts.
    rows = files.select("file", "seq", "segment").mapInArrow(_documents, "file int, seq int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["file", "seq"]).select("doc_id", (F.col("start") + F.col("__start")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", special: bool = False) -> DataFrame:
    """Writes the documents to the shared folder and reads the files back."""
    out = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, out, tokenizer, end_id, id_col, text_col, special)
    return read_tokens(docs.sparkSession, out)
