"""Best-fit packing of documents into bins of a fixed number of words, under conflicts.

Bins are ordered by what is left in them and carry two bitmaps: the sources and the duplicate clusters they hold. Pieces
come in order of size, largest first. For each, the search starts at the bins with the least room that is
enough and goes on to the next larger room until a bin without a conflict is found, which is the tightest compatible bin; if
there is none, a bin is opened. Two pieces conflict if they are of one duplicate cluster, or of one
source, however many pieces that has: a source with more pieces than the fewest bins that hold all words gets as
many bins as it has pieces.

Documents longer than a bin become pieces of `capacity` words and a rest. Pieces are dealt to shards
of about `shard_pieces` by a hash of id and piece, whatever their source or cluster, so any hot group is
spread evenly, and each shard is packed alone in bounded memory. Only ids, sizes, sources and clusters
move, never texts.

Defined results: documents without words (null or empty text) have one row with size 0 and no bin; a null source
is a source; a null cluster conflicts with nothing; rows of one id are packed one by one, and conflict as
the same cluster does, if they have its value; other columns are not returned, whatever they are called; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, n_words, written


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """Bin of each piece (pieces in the order given); sources and clusters are bits, -1 for none."""
    rooms: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]  # by room, then by source bitmap
    occupied = 0  # bit r: some bin has room r
    held: list[int] = []  # cluster bitmap of each bin
    common = [0] * (capacity + 1)  # by room, the sources that all of its bins hold
    shut: dict[int, int] = {}  # by source bit, bit r: all bins of room r hold it
    out = []

    def hold(room: int, sources: int) -> None:
        changed, common[room] = common[room] ^ sources, sources
        while changed:
            low = changed & -changed
            shut[low] = shut.get(low, 0) ^ (1 << room)
            changed ^= low

    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        found = None
        ahead = (occupied & ~shut.get(s, 0)) >> size
        room = size
        while ahead:
            step = (ahead & -ahead).bit_length() - 1
            room += step
            for bitmap, bins in rooms[room].items():
                if bitmap & s:
                    continue
                for at in range(len(bins) - 1, -1, -1):
                    if not held[bins[at]] & c:
                        found = (room, bitmap, at)
                        break
                if found:
                    break
            if found:
                break
            ahead >>= step + 1
            room += 1
        if found:
            room, bitmap, at = found
            bins = rooms[room][bitmap]
            b = bins[at]
            bins[at] = bins[-1]
            bins.pop()
            if not bins:
                del rooms[room][bitmap]
                if not rooms[room]:
                    occupied &= ~(1 << room)
                both = -1 if rooms[room] else 0
                for other in rooms[room]:
                    both &= other
                    if not both:
                        break
                hold(room, both)
        else:
            b, room, bitmap = len(held), capacity, 0
            held.append(0)
        held[b] |= c
        room -= size
        hold(room, common[room] & (bitmap | s) if rooms[room] else bitmap | s)
        rooms[room].setdefault(bitmap | s, []).append(b)
        occupied |= 1 << room
        out.append(b)
    return out


def _numbered(column: pa.ChunkedArray) -> list[int]:
    """Numbers of the values that occur more than once; -1 for others."""
    if not len(column):
        return []
    d = column.combine_chunks().dictionary_encode()
    at = d.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    n = np.bincount(at[at >= 0], minlength=len(d.dictionary))
    use = n > 1
    number = np.where(use, np.cumsum(use) - 1, -1)
    return [int(number[i]) if i >= 0 else -1 for i in at.tolist()]


def _pack(capacity: int):
    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), ("id", "ascending"), ("piece", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        sizes = t["size"].to_pylist()
        source = t["source"].combine_chunks().fill_null("\0null")
        bins = best_fit(sizes, _numbered(pa.chunked_array([source])), _numbered(t["cluster"]), capacity)
        used: dict[int, int] = {}
        starts = []
        for b, n in zip(bins, sizes, strict=True):
            starts.append(used.get(b, 0))
            used[b] = starts[-1] + n
        shard = t["shard"][0].as_py() if len(t) else 0
        return pa.table({
            "id": t["id"], "piece": t["piece"], "size": t["size"], "source": t["source"], "cluster": t["cluster"],
            "bin_id": pa.array([(shard << 32) + b for b in bins], pa.int64()), "start": pa.array(starts, pa.int64()), "bin_room": pa.array([capacity - used[b] for b in bins], pa.int64()),
        })

    return pack


def pack_documents(
    docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, shard_pieces: int = 20_000,
) -> DataFrame:
    """(doc_id, piece, n_words, source, cluster, bin_id, start, bin_room): a row for each piece.

    `cluster` numbers duplicate clusters; by default, equal texts are a cluster.
    """
    rows = apart(docs.withColumn("__cluster", cluster) if cluster is not None else docs, __id=id_col, __text=text_col, __source=source_col, **({"__cluster": "__cluster"} if cluster is not None else {}))[0]
    cluster = F.xxhash64("__text") if cluster is None else F.col("__cluster")
    sized = rows.select(F.col("__id").cast("long").alias("id"), n_words("__text").alias("words"), F.col("__source").cast("string").alias("source"), cluster.cast("long").alias("cluster"))
    sized = written(sized, "pack-sizes")
    whole = F.floor(F.col("words") / capacity).cast("long")
    n_pieces = whole + F.when(F.col("words") % capacity > 0, 1).otherwise(0)
    pieces = sized.filter("words > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), n_pieces - 1)))
    pieces = pieces.withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("piece") * capacity)).drop("words")
    total = sized.agg(F.sum(n_pieces)).first()[0] or 0
    shards = max(1, -(-total // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.lit("pack"), "id", "piece"), F.lit(shards)).cast("long"))
    out = dealt.groupBy("shard").applyInArrow(_pack(capacity), "id long, piece long, size long, source string, cluster long, bin_id long, start long, bin_room long")
    none = F.lit(None).cast("long")
    empty = sized.filter("words = 0").select("id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("size"), "source", "cluster", none.alias("bin_id"), none.alias("start"), none.alias("bin_room"))
    return out.unionByName(empty).withColumnsRenamed({"id": "doc_id", "size": "n_words"})
