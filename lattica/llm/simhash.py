"""SimHash near-duplicates through covering locality-sensitive hashing.

A fingerprint is the majority of the XXH64 bits of a text's 4-word shingles. Two fingerprints link
at ``RADIUS`` or fewer differing bits. Bit i gets a nonzero vector m(i) of RADIUS + 1 bits; table v
(any nonzero vector) keeps the bits with <m(i), v> odd. The vectors of at most RADIUS differing
bits span less than the space, so some v is orthogonal to all of them: in that table the two
fingerprints have the same key. All pairs within the radius thus meet, with 31 tables.

Documents with one fingerprint are one class and only classes are compared. A bucket with more than
``HOT_BUCKET`` classes is dealt again by the same construction over the bits its table does not
keep, which bounds it by the number of values of the bits then left (about 2^16). Within a bucket,
a search that removes what it reaches links members without listing pairs. Components of the
resulting links are found by distributed rounds. Labels join back by ``join_groups``, so a component
or a fingerprint with a large share of all rows does not fall to one task.

Null and empty texts have fingerprint 0 and link like any other. Rows with a null ``doc_id`` take
part, but never name a component. Repeated rows have equal fingerprints. Other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.graph import star_components
from lattica.operators.hot import join_groups
from lattica.session import materialize

SHINGLE = 4
SEED = 42
RADIUS = 4
HOT_BUCKET = 4096
CHUNK = 1 << 15


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of lower-cased words."""
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    text = b" ".join(words)
    if len(words) <= shingle:
        return h(text, SEED)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends]
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        upto = min(n, at + CHUNK)
        pairs = zip(starts[at:upto], ends[at + shingle - 1 : upto + shingle - 1])
        hashes = np.fromiter((h(text[a : b - 1], SEED) for a, b in pairs), np.uint64, upto - at)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        out = np.fromiter(
            (fingerprint(t.as_py().lower().split()) if t.is_valid else 0 for t in texts), np.uint64, len(texts)
        )
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out.view(np.int64))], names=["doc_id", "h", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, h, fp)``: a hash of the text, and as a signed long the fingerprint's 64 bits."""
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text.isNull(), text).alias("h"), text)
    return docs.mapInArrow(_fingerprints, "doc_id long, h long, fp long")


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks over ``bits``, as signed longs: any ``radius`` bits miss one of them."""
    space = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, space + 1):
        mask = 0
        for i, bit in enumerate(bits):
            if ((i % space + 1) & v).bit_count() & 1:
                mask |= 1 << bit
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def link_members(members: np.ndarray, radius: int = RADIUS) -> tuple[list[int], list[int]]:
    """(member, root) for each member but the roots, of the components at ``radius``."""
    unseen, nodes, roots = members, [], []
    while len(unseen) > 1:
        root, unseen = unseen[0], unseen[1:]
        front = [root]
        while front and len(unseen):
            near = np.bitwise_count(unseen ^ front.pop()) <= radius
            if near.any():
                got = unseen[near].tolist()
                unseen = unseen[~near]
                front += [np.uint64(x) for x in got]
                nodes += got
                roots += [int(root)] * len(got)
    return nodes, roots


def _bucket_links(radius):
    def run(batches):
        held_key, held = None, []

        def links(parts):
            fps = np.concatenate(parts) if len(parts) > 1 else parts[0]
            if len(fps) == 2:
                a, b = map(int, fps)
                return ([b], [a]) if (a ^ b).bit_count() <= radius else ([], [])
            return link_members(fps, radius)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            fps = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            bounds = [0, *cuts.tolist(), len(fps)]
            nodes, roots = [], []
            for a, b in zip(bounds, bounds[1:]):
                key = keys[:, a].tobytes()
                if key != held_key:
                    if held and sum(map(len, held)) > 1:
                        x, y = links(held)
                        nodes += x
                        roots += y
                    held_key, held = key, []
                held.append(fps[a:b].copy())
            yield _edges(nodes, roots)
        if held and sum(map(len, held)) > 1:
            yield _edges(*links(held))

    return run


def _edges(nodes, roots):
    as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
    return pa.RecordBatch.from_arrays([as_long(nodes), as_long(roots)], names=["u", "v"])


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Distinct ``fps(fp)`` to edges ``(u, v)`` that connect all fingerprints within ``radius``."""
    masks = covering_masks(list(range(64)), radius)
    spare = [covering_masks([b for b in range(64) if not (m >> b) & 1], radius) for m in masks]
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)]))
    rows = fps.select("fp", table.alias("x")).select("x.t", "x.k", "fp")
    shared = rows.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(shared.hint("merge"), ["t", "k"])  # both are taken for as small as ``fps``, of which they are 31 copies
    again = F.array(*[F.array(*[F.lit(m) for m in family]) for family in spare])
    deal = F.when(
        F.col("n") > hot_bucket,
        F.transform(
            F.element_at(again, F.col("t") + 1),
            lambda m, i: F.struct((i + 1).cast("int").alias("s"), F.col("fp").bitwiseAND(m).alias("j")),
        ),
    ).otherwise(F.array(F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("j"))))
    rows = rows.select("t", "k", F.explode(deal).alias("x"), "fp").select("t", "k", "x.s", "x.j", "fp")
    rows = rows.repartition("t", "k", "s", "j").sortWithinPartitions("t", "k", "s", "j", "fp")
    return rows.mapInArrow(_bucket_links(radius), "u long, v long").distinct()


def _components(prints: DataFrame, radius: int, hot_bucket: int) -> DataFrame:
    """``(fp, copies, root, head)`` for each fingerprint: head the first row of its component.

    Rows are in order of doc_id, nulls last, then of the hash of their text.
    """
    row = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "h")
    classes = materialize(prints.groupBy("fp").agg(F.min(row).alias("first"), F.count("*").alias("copies")), "classes")
    links = fingerprint_links(classes.select("fp"), radius, hot_bucket)
    found = star_components(links.select("u", "v"))
    # few bytes a row on disk, so all of these are shuffled however small they look
    rooted = classes.join(found.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select(
        "fp", "first", "copies", F.coalesce("component", "fp").alias("root")
    )
    rooted = materialize(rooted, "rooted")
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"), F.count("*").alias("rows"))
    return join_groups(rooted, heads, ["root"], shuffled=True).select("fp", "copies", "root", "head")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """``(doc_id, fp, component_id)``: component_id is the least doc_id reachable over links."""
    prints = materialize(fingerprints(docs).select("doc_id", "h", "fp"), "fingerprints")
    labels = _components(prints, radius, hot_bucket)
    labels = materialize(labels.select("fp", F.col("head.doc_id").alias("component_id"), F.col("copies").alias("rows")), "labels")
    return join_groups(prints.select("doc_id", "fp"), labels, ["fp"], shuffled=True)


def one_of_each(docs: DataFrame, radius: int = RADIUS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Of each component one row of ``docs``, all columns as they are.

    It is the row with the least doc_id, nulls last; of rows that share it that whose text has the
    least hash, and one of those equal in both. Rows that share a doc_id but not a component stay.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    heads = _components(prints, radius, hot_bucket).select("head").distinct().select("head.*")
    key = lambda doc_id: [doc_id.isNull().alias("n"), F.coalesce(doc_id.cast("long"), F.lit(0).cast("long")).alias("id")]
    heads = materialize(heads.select(*key(F.col("doc_id")), "h"), "heads")
    text = F.col("text").cast("string")
    rows = docs.select(*key(F.col("doc_id")), F.xxhash64(text.isNull(), text).alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(heads.hint("merge"), ["n", "id", "h"], "left_semi").dropDuplicates(["n", "id", "h"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
