"""SimHash near-duplicate classes by a segment-popcount embedding.

A 64-bit fingerprint is cut into segments and mapped to their bit counts. The Manhattan distance of two such
vectors never exceeds the Hamming distance of the fingerprints, so all links lie among pairs of vectors at most 2
apart. Two integer vectors that near share a grid point within 1 of both: every distinct fingerprint is sent to
its own point and the points one step away (33 of them for 16 segments), and the range join becomes an equality
join on grid points, followed by the exact Hamming test. Exact copies, and any texts of one fingerprint, are one
point before all that.

A grid point with more than ``crowd`` fingerprints is not paired up. Its members are embedded again on a finer grid, of
32 segments: of random fingerprints the central point of 16 segments gathers over 64 from some ten million on, that of 32 not before
10^10. Members of points that are crowded even there get segments of one bit, where the bound is the Hamming
distance itself: members that share a point are linked by definition, there are at most 65 of them, and each is linked to the
least. So no link is lost and no group yields all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import delete, fresh_path, many, map_arrow, quoted, row_key, stash, stash_at, text_of, without
from quern.llm.components import components
from quern.llm.near_copies import near_copies, shingle_hashes, sketches

#: Shingles whose bits are counted at once, so that memory stays bounded on very long texts.
BLOCK = 1 << 16


def fingerprint_of(hashes: np.ndarray) -> int:
    """64-bit fingerprint of shingle hashes, unsigned. Bit i is 1 if it is set in over half of them."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at:at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Fingerprint of a whole text; zero if it has no words."""
    return fingerprint_of(shingle_hashes(text, width, seed))


def _prints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [fingerprint(t.as_py(), width) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.array(got, np.uint64).view(np.int64))], names=["doc_id", "fp"]
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null text counts as empty and has fingerprint zero."""
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return map_arrow(rows, partial(_prints, width=width), "doc_id long, fp long")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _points(batches: Iterator[pa.RecordBatch], segments: int) -> Iterator[pa.RecordBatch]:
    """(key, via, fp): the grid points within one step. via is 0 at the vector itself, else +-(segment + 1)."""
    bits = 64 // segments
    room = 64 // segments  # bits of the key for each segment; a step adds or takes at most one
    assert bits.bit_length() <= room, "the vector doesn't fit a long"
    shift = (np.arange(segments) * bits).astype(np.uint64)
    place = np.int64(1) << (np.arange(segments, dtype=np.int64) * room)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        counts = np.bitwise_count((fp.view(np.uint64)[:, None] >> shift) & np.uint64((1 << bits) - 1)).astype(np.int64)
        at = counts @ place
        keys, vias, owners = [at], [np.zeros(len(fp), np.int8)], [fp]
        for i in range(segments):
            for step, inside in ((1, counts[:, i] < bits), (-1, counts[:, i] > 0)):
                keys.append(at[inside] + step * place[i])
                vias.append(np.full(int(inside.sum()), step * (i + 1), np.int8))
                owners.append(fp[inside])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, vias, owners)], names=["key", "via", "fp"])


def _flips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, point): a fingerprint and all that differ from it in one bit."""
    flips = np.concatenate(([0], np.uint64(1) << np.arange(64, dtype=np.uint64))).astype(np.uint64)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        point = (fp[:, None] ^ flips).ravel().view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, len(flips)).view(np.int64)), pa.array(point)], names=["fp", "point"])


def _met(fps: DataFrame, segments: int) -> tuple[DataFrame, str]:
    """(key, via, fp, n): the grid points of several fingerprints and how many they have, written out, and where.

    Points are counted by an aggregate and joined with the counts, so one that most fingerprints share may be split.
    """
    points = map_arrow(fps.select("fp"), partial(_points, segments=segments), "key long, via byte, fp long")
    counts = points.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    path = fresh_path(fps.sparkSession, "met")
    return stash_at(many(points).join(counts, "key"), path), path


def near_pairs(fps: DataFrame, segments: tuple[int, ...] = (16, 32), crowd: int = 64) -> tuple[DataFrame, list[str]]:
    """Links (a, b) between distinct fingerprints at 2 or fewer differing bits, enough to reach all that are linked.

    fps has one row for each distinct fingerprint. Outside crowded grid points the links are all there are. Also the paths of the
    tables that the links are read from, to be deleted once they have been.
    """
    links, paths = [], []
    for grid in segments:
        met, path = _met(fps, grid)
        paths.append(path)
        x, y = (met.where(F.col("n") <= crowd).select("key", F.col("via").alias(f"via_{s}"), F.col("fp").alias(s)) for s in "ab")
        # A pair at distance 0 meets at its common vector, at distance 1 at the vector of the lesser fingerprint.
        once = (F.col("via_a") == 0) | ((F.col("via_b") != 0) & (F.col("via_a") != F.col("via_b")))
        links.append(many(x).join(y, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2) & once).select("a", "b"))
        fps = met.where(F.col("n") > crowd).select("fp").distinct()
        if fps.isEmpty():
            break
    else:
        points = map_arrow(fps, _flips, "fp long, point long")
        least = points.groupBy("point").agg(F.min("fp").alias("a"))
        links.append(many(points).join(least, "point").where("a <> fp").select("a", F.col("fp").alias("b")))
    return reduce(DataFrame.unionByName, links).distinct(), paths


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Near-duplicate class of every row: doc_id, fingerprint (16 hex digits), component_id.

    A-Z count as a-z. Shingles are ``width`` words, repeats included; a text of fewer words is one shingle, and
    one of none (null, empty, white space) has fingerprint zero, which links like any other. Fingerprints link
    at 2 or fewer differing bits; component_id is the smallest id reachable, null only where no member has an
    id. Repeated rows come back as often as they are there. An empty table gives no rows, other columns are ignored.
    """
    found = classed(stash(fingerprints(docs, id_col, text_col, width), "prints"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def classed(prints: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of stashed fingerprints."""
    spark = prints.sparkSession
    nodes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    pairs, paths = near_pairs(nodes.select("fp"))
    linked = components(pairs).withColumnRenamed("node", "fp")
    for path in paths:
        delete(spark, path)
    roots = linked.join(nodes, "fp").groupBy("root").agg(F.min("least").alias("reach"))
    linked = stash(linked.join(roots, "root").select("fp", "reach"), "linked")
    classes = nodes.join(linked, "fp", "left").select("fp", F.coalesce("reach", "least").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8
) -> DataFrame:
    """The rows without an earlier near copy, all columns.

    Near copies have at least ``similarity`` of their distinct shingles of ``width`` words in common, measured on the
    whole texts. Candidates are the members of a SimHash class of that width and of a MinHash band (``near_copies``). The smallest
    id stays, a row without an id goes before one with an id does, of rows with id and text in common one stays. Null
    text counts as empty, and all texts without words are copies of each other. An empty table gives no rows; columns of
    any name come back as they were.
    """
    rows = docs.select(*[c.alias(k) for k, c in row_key(id_col, text_col).items()], F.col(quoted(id_col)).cast("long").alias("id"), text_of(text_col).alias("text"))
    made = sketches(rows, fingerprint_of, width)
    classes = classed(made.select(F.col("row").alias("doc_id"), "fp")).select(F.col("doc_id").alias("row"), F.xxhash64(F.lit("simhash"), "component_id").alias("bucket"))
    return without(docs, id_col, text_col, stash(near_copies(rows, made, width, similarity, classes), "lost"))
