"""Removal of repeated passages by Rabin-Karp hashes of every fixed-length word window.

A word goes if a window of ``WINDOW`` consecutive words covers it whose word sequence also starts
earlier: in a document with a smaller id, or before it in the same document. Windows are judged on
the input texts.

1. Each window gets two polynomial hashes over its words' hashes. One picks a bucket, the other is
   sent there, so a false repeat needs both to agree (64 bits and log2 of the number of buckets).
   The number of buckets follows from the size of all texts: a bucket, which one task holds, gets
   about ``BUCKET_WINDOWS[0]`` windows, at the very largest inputs up to ``BUCKET_WINDOWS[1]``.
2. Windows travel packed: one row for a batch of documents and a bucket holds arrays. A window that
   repeats inside its document, or whose sequence has a smaller id in the same batch, is known to
   go and its hash is not sent: a very frequent window costs one entry a batch.
3. A bucket sorts its hashes, and answers with bits per document, again packed, one row for each
   part of the documents.
4. Each document joins its bits, finds the places of the bucket's windows again and merges the
   windows that go into maximal intervals.

A null text has no words. Rows with a null id form one last document id. Rows that share an id,
repeated rows too, are neither earlier nor later than each other; where ids repeat or are null, rows
are told apart by a 64-bit hash of their text as well, and of null ids by two. Texts of fewer than
``WINDOW`` words keep all. Input columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import materialize, release_shuffles

WINDOW = 20
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BUCKET_WINDOWS = (1 << 21, 1 << 24)
MOST_SMALL_BUCKETS = 1 << 12
BATCH_WINDOWS = (1 << 20, 1 << 23)
ROW_WINDOWS = 256
#: Mean length of a word with its blank, by which windows are estimated; there are at most three times as many.
WORD_BYTES = 6
CACHED_WORDS = 1 << 18
NULL_ID = 2**63 - 1


class WordHashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(x: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash mod 2^64 of every ``width`` consecutive entries, by doubling."""
    done, have, power, span, step = None, 0, x, 1, base
    while True:
        if width & span:
            if done is None:
                done = power
            else:
                n = min(len(done), len(power) - have)
                done = done[:n] * np.uint64(step) + power[have : have + n]
            have += span
        if have == width:
            return done
        n = len(power) - span
        power = power[:n] * np.uint64(step) + power[span:]
        step = step * step % 2**64
        span *= 2


def window_buckets(x: np.ndarray, buckets: int, width: int) -> np.ndarray:
    """The bucket of every window of word hashes."""
    b = (rolling(x, width, BASES[1]) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return b.astype(np.uint16 if buckets <= 1 << 16 else np.uint32)  # 16 bits sort faster


def _packed(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max()))).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.uint64)


class Batch:
    """Documents, in order of their ids, whose windows are sent together.

    A document: its place in the order of ids, the key and tag that tell it apart, its word hashes.
    """

    def __init__(self):
        self.docs: list[tuple[int, int, int, np.ndarray]] = []
        self.windows = 0

    def add(self, order: int, key: int, tag: int, x: np.ndarray, width: int) -> None:
        if len(x) >= width:
            self.docs.append((order, key, tag, x))
            self.windows += len(x) - width + 1

    def rows(self, buckets: int, width: int, tagged: bool) -> Iterator[dict]:
        """One row for each bucket that has a window of the batch."""
        self.docs.sort(key=lambda d: d[:3])
        order, key, tag = (np.array([d[k] for d in self.docs], np.int64) for k in range(3))
        sizes = np.array([len(d[3]) for d in self.docs])
        x = np.concatenate([d[3] for d in self.docs])
        begins = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes - width + 1)
        counts = sizes - width + 1
        place = np.arange(len(doc)) + np.repeat(begins - np.cumsum(counts) + counts, counts)
        h, b = rolling(x, width, BASES[0])[place], window_buckets(x, buckets, width)[place]
        by_bucket = np.argsort(b, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(b[by_bucket])) + 1, len(b)]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = by_bucket[lo:hi]
            hashes, at = h[own], doc[own]
            sort = np.argsort(hashes, kind="stable")
            runs, owner = hashes[sort], at[sort]
            new = np.r_[True, runs[1:] != runs[:-1]]
            least = order[owner[np.flatnonzero(new)]][np.cumsum(new) - 1]
            known = np.empty(hi - lo, bool)
            known[sort] = (order[owner] > least) | np.r_[False, (owner[1:] == owner[:-1]) & ~new[1:]]
            heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            held = at[heads]
            keys = key[held].view(np.uint64)
            yield {
                "bucket": int(b[own[0]]),
                "docs": len(heads),
                "orders": _packed(np.diff(order[held].view(np.uint64), prepend=order[held[:1]].view(np.uint64))),
                "least": int(order[held[0]]),
                "keys": keys.tobytes() if tagged else b"",
                "tags": tag[held].tobytes() if tagged else b"",
                "counts": _packed(np.diff(np.r_[heads, hi - lo])),
                "known": np.packbits(known).tobytes(),
                "hashes": hashes[~known].tobytes(),
            }


SENT = pa.schema(
    [("bucket", pa.int32()), ("docs", pa.int32()), ("least", pa.int64())]
    + [(name, pa.binary()) for name in ("orders", "keys", "tags", "counts", "known", "hashes")]
)
SENT_DDL = "bucket int, docs int, least long, orders binary, keys binary, tags binary, counts binary, known binary, hashes binary"
ANSWER = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("docs", pa.int32())] + [(n, pa.binary()) for n in ("keys", "tags", "sizes", "bits")])
ANSWER_DDL = "part int, bucket int, docs int, keys binary, tags binary, sizes binary, bits binary"
GATHERED = pa.schema(
    [("key", pa.int64()), ("tag", pa.int64()), ("answers", pa.list_(pa.struct([("bucket", pa.int32()), ("bits", pa.binary())])))]
)
GATHERED_DDL = "key long, tag long, answers array<struct<bucket:int,bits:binary>>"


def _send(buckets, width, tagged, batch_windows):
    def run(batches):
        hashes, held = WordHashes(), Batch()

        def sent():
            return pa.RecordBatch.from_pylist(list(held.rows(buckets, width, tagged)), SENT)

        for batch in batches:
            texts = batch.column(3).cast(pa.binary())
            for order, key, tag, text in zip(*[batch.column(k).to_pylist() for k in range(3)], texts):
                if text.is_valid:
                    held.add(order, key, tag, hashes.array(text.as_py().split()), width)
                if held.windows >= batch_windows:
                    yield sent()
                    held = Batch()
        if held.docs:
            yield sent()

    return run


def _answer(parts: int):
    """All rows of one bucket to bits for the documents with a window that goes, packed for ``parts`` parts of the documents."""

    def run(table: pa.Table) -> pa.Table:
        rows, hashes, owners = [], [], []
        for r in table.to_pylist():
            n = r["docs"]
            order = (np.uint64(r["least"] % 2**64) + np.cumsum(_unpacked(r["orders"], n), dtype=np.uint64)).view(np.int64)
            counts = _unpacked(r["counts"], n).astype(np.int64)
            known = np.unpackbits(np.frombuffer(r["known"], np.uint8), count=int(counts.sum())).astype(bool)
            key = np.frombuffer(r["keys"], np.int64) if r["keys"] else order
            tag = np.frombuffer(r["tags"], np.int64) if r["tags"] else np.zeros(n, np.int64)
            rows.append((key, tag, counts, known))
            hashes.append(np.frombuffer(r["hashes"], np.uint64))
            owners.append(np.repeat(order, counts)[~known])
        bucket = table.column("bucket")[0].as_py()
        h, own = np.concatenate(hashes), np.concatenate(owners)
        order = np.lexsort((own, h))
        h, own = h[order], own[order]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        later = np.zeros(len(h), bool)
        later[order] = own > np.repeat(own[starts], np.diff(np.r_[starts, len(h)]))
        key, tag, counts, goes = (np.concatenate([r[k] for r in rows]) for k in range(4))
        goes[~goes] = later
        begins = np.cumsum(counts) - counts
        hit = np.flatnonzero(np.add.reduceat(goes, begins, dtype=np.int64))
        hit = hit[np.argsort(_part(key[hit], parts), kind="stable")]
        key, tag, counts, begins = key[hit], tag[hit], counts[hit], begins[hit]
        sizes = (counts + 7) // 8
        ends = np.cumsum(sizes)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        bits = np.zeros(sizes.sum() * 8, bool)
        bits[np.repeat((ends - sizes) * 8, counts) + within] = goes[np.repeat(begins, counts) + within]
        bits, part = np.packbits(bits), _part(key, parts)
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
        out = [
            {
                "part": int(part[lo]),
                "bucket": bucket,
                "docs": int(hi - lo),
                "keys": key[lo:hi].tobytes(),
                "tags": tag[lo:hi].tobytes() if tag[lo:hi].any() else b"",
                "sizes": _packed(sizes[lo:hi]),
                "bits": bits[ends[lo] - sizes[lo] : ends[hi - 1]].tobytes(),
            }
            for lo, hi in zip(cuts[:-1], cuts[1:])
        ]
        return pa.Table.from_pylist(out, ANSWER)

    return run


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key.view(np.uint64) * np.uint64(BASES[0]) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _gather(table: pa.Table) -> pa.Table:
    """All answers for one part of the documents to one row a document."""
    key, tag, bucket, bits = [], [], [], []
    for r in table.to_pylist():
        n = r["docs"]
        key.append(np.frombuffer(r["keys"], np.int64))
        tag.append(np.frombuffer(r["tags"], np.int64) if r["tags"] else np.zeros(n, np.int64))
        bucket.append(np.full(n, r["bucket"], np.int32))
        offsets = np.r_[0, np.cumsum(_unpacked(r["sizes"], n))].astype(np.int32)
        bits.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(r["bits"])]))
    key, tag, bucket = map(np.concatenate, (key, tag, bucket))
    order = np.lexsort((bucket, tag, key))
    key, tag, bucket = key[order], tag[order], bucket[order]
    # rows of equal documents give equal answers: one of each is enough
    new = np.r_[True, (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])]
    once = new | np.r_[True, bucket[1:] != bucket[:-1]]
    heads = np.flatnonzero(new[once])
    answers = pa.StructArray.from_arrays(
        [pa.array(bucket[once]), pa.concat_arrays(bits).take(pa.array(order[once]))], fields=list(GATHERED.field("answers").type.value_type)
    )
    answers = pa.ListArray.from_arrays(pa.array(np.r_[heads, once.sum()].astype(np.int32)), answers)
    return pa.Table.from_arrays([pa.array(key[new]), pa.array(tag[new]), answers.cast(GATHERED.field("answers").type)], schema=GATHERED)


def removal_spans(x: np.ndarray, answers: list[tuple[int, bytes]], buckets: int, width: int) -> list[tuple[int, int]]:
    """Maximal [start, end) intervals of the words with hashes ``x`` that go."""
    bucket = window_buckets(x, buckets, width)
    order = np.argsort(bucket, kind="stable")
    by = bucket[order]
    goes = np.zeros(len(bucket), bool)
    for at, bits in answers:
        lo, hi = np.searchsorted(by, [at, at + 1])
        goes[order[lo:hi]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(hi - lo)).astype(bool)
    edges = np.zeros(len(x) + 1, np.int32)
    starts = np.flatnonzero(goes)
    edges[starts] += 1
    edges[starts + width] -= 1
    covered = np.cumsum(edges[:-1]) > 0
    turns = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


KEPT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("kept_text", pa.string()),
    ]
)


def _keep(buckets, width):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            ids, counts, spans, kept = batch.column(0), [], [], []
            for text, answers in zip(texts, batch.column(2)):
                words = text.as_py().split() if text.is_valid else []
                found = [(a["bucket"], a["bits"]) for a in answers.as_py()] if answers.is_valid else []
                gone = removal_spans(hashes.array(words), found, buckets, width) if found else []
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in gone])
                if gone:
                    pieces, at = [], 0
                    for a, b in gone:
                        pieces += words[at:a]
                        at = b
                    words = pieces + words[at:]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), pa.array(spans, KEPT.field("spans").type), pa.array(kept, pa.binary()).cast(pa.string())],
                schema=KEPT,
            )

    return run


def layout(windows: int) -> tuple[int, int]:
    """(buckets, windows of a batch): buckets grow once there are very many, batches so that rows are worth their cost."""
    size = min(max(BUCKET_WINDOWS[0], windows // MOST_SMALL_BUCKETS), BUCKET_WINDOWS[1])
    buckets = max(1, -(-windows // size))
    return buckets, min(max(BATCH_WINDOWS[0], ROW_WINDOWS * buckets), BATCH_WINDOWS[1])


def remove_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, spans, kept_text)``: the intervals of words removed and the rest, joined by spaces."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets, batch_windows = layout(size // WORD_BYTES)
    # ids that occur once tell documents apart; else their texts have to be hashed
    tagged = not docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").isEmpty()
    order = F.coalesce("doc_id", F.lit(NULL_ID)).alias("order")
    key = F.coalesce("doc_id", F.xxhash64(F.lit("key"), "text")) if tagged else F.col("doc_id")
    tag = F.xxhash64(F.col("doc_id").isNull(), "text") if tagged else F.lit(0).cast("long")
    keyed = docs.select(order, key.alias("key"), tag.alias("tag"), "text", "doc_id")
    sent = keyed.select("order", "key", "tag", "text").mapInArrow(_send(buckets, width, tagged, batch_windows), SENT_DDL)
    answers = materialize(sent.groupBy("bucket").applyInArrow(_answer(buckets), ANSWER_DDL), "repeats")
    release_shuffles(spark)
    gathered = answers.groupBy("part").applyInArrow(_gather, GATHERED_DDL)
    joined = keyed.join(gathered, ["key", "tag"], "left").select("doc_id", "text", "answers")
    return joined.mapInArrow(
        _keep(buckets, width), "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept_text string"
    )
