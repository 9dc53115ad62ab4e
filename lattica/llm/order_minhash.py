"""Order MinHash fingerprints, sensitive to the edit distance of whole texts.

Each run of ``K`` words is a k-mer, numbered by its occurrence, so repeats stay apart. For each of
``SKETCHES`` hash functions the ``TUPLE`` (two) least numbered k-mers are taken, put back in text
order, and hashed as a tuple to 16 bits. The likeness of two fingerprints is the share of equal
tuples: common k-mers in another order do not agree.

Words are runs without ASCII white space. A text of fewer than ``K`` words is one k-mer. A null
text counts as empty; empty texts have the fingerprint of zeros, alike (1) with each other and
unlike (0) any other text. Equal texts have equal fingerprints.

``successors`` gives every row the text that follows by ascending ``doc_id`` with one shuffle: rows
are dealt to ranges of ids, and the first row of each range is dealt to the range before it too,
where it serves only as successor. Nulls come last, equal ids by the hash of their text, and ranges
of that hash split them where they are many; the first row follows the last. Ranges are read as
streams, so their size, which grows beyond ``MOST_RANGES`` of them, bounds no memory. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.substring_dedup import WordHashes, rolling

K = 3
SKETCHES = 64
SEED = 11
COLUMNS = 2048
RANGES_PER_PARTITION = 4
MOST_RANGES = 4096
BASE = 0x9E3779B97F4A7C15
OCCURRENCE = 0xA24BAED4963EE407
MIX = np.uint64(0xD6E8FEB86659FD93)

_rng = np.random.default_rng(SEED)
FACTORS = _rng.integers(0, 2**63, SKETCHES, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 2**63, SKETCHES, dtype=np.uint64)[:, None]
ROWS = np.arange(SKETCHES)
MOST = np.uint64(2**64 - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(32))


def numbered_kmers(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """A hash for each k-mer together with its occurrence number, in text order."""
    x = hashes.array(words)
    x = rolling(x, min(K, len(x)), BASE)
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    if not new.all():
        places = np.arange(len(x))
        occurrence = np.empty(len(x), np.uint64)
        occurrence[order] = places - np.maximum.accumulate(np.where(new, places, 0))
        x = x + occurrence * np.uint64(OCCURRENCE)
    return _mixed(x)


def _two_least(items: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per hash function the places of the two least; ``at``: places, one row or one for each function."""
    values = items[at] * FACTORS + SHIFTS
    a = values.argmin(axis=1)
    values[ROWS, a] = MOST
    b = values.argmin(axis=1)
    if at.shape[0] == 1:
        return np.stack([at[0, a], at[0, b]], axis=1)
    return np.stack([at[ROWS, a], at[ROWS, b]], axis=1)


def sketch(words: list[bytes], hashes: WordHashes) -> np.ndarray | None:
    """``SKETCHES`` numbers of 16 bits; None for no words."""
    if not words:
        return None
    items = numbered_kmers(words, hashes)
    n = len(items)
    if n == 1:
        first = second = np.zeros(SKETCHES, np.int64)
    else:
        cuts = range(0, n, COLUMNS)
        parts = [_two_least(items, np.arange(c, min(n, c + COLUMNS))[None, :]) for c in cuts if min(n, c + COLUMNS) - c > 1]
        if n % COLUMNS == 1 and n > 1:
            parts.append(np.full((SKETCHES, 1), n - 1))
        best = parts[0] if len(parts) == 1 else _two_least(items, np.concatenate(parts, axis=1))
        first, second = best.min(axis=1), best.max(axis=1)
    joint = _mixed(items[first] * FACTORS[:, 0] + _mixed(items[second] + SHIFTS[:, 0]))
    return (joint >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def _hex(x: np.ndarray | None) -> str:
    return "0000" * SKETCHES if x is None else x.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COMPARED_DDL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
COMPARED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def _compared(batches):
    hashes = WordHashes()
    of = lambda text: sketch(text.encode().split(), hashes)
    held = None  # part, id, text and sketch of the row whose successor comes next
    for batch in batches:
        out = []
        for part, ahead, doc_id, text in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            text = text or ""
            same = held is not None and held[0] == part
            if ahead and not same:
                continue
            own = of(text)
            if same:
                _, prior_id, prior, prior_sketch = held
                other = edited(prior, text)
                other_sketch = prior_sketch if other == prior else of(other)
                out.append(
                    {
                        "doc_id": prior_id,
                        "n_chars": len(prior),
                        "edited_sha256": hashlib.sha256(other.encode()).hexdigest(),
                        "fingerprint": _hex(prior_sketch),
                        "edited_fingerprint": _hex(other_sketch),
                        "near_edited": likeness(prior_sketch, other_sketch),
                        "near_next": likeness(prior_sketch, own),
                    }
                )
            held = None if ahead else (part, doc_id, text, own)
        yield pa.RecordBatch.from_pylist(out, COMPARED)


def _range_of(key, bounds: list[int], low: int = 0):
    """Number of ``bounds`` below ``key``, as a balanced tree of comparisons."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(key <= F.lit(bounds[mid]), _range_of(key, bounds[:mid], low)).otherwise(
        _range_of(key, bounds[mid + 1 :], low + mid + 1)
    )


def successors(docs: DataFrame) -> DataFrame:
    """``(part, ahead, doc_id, text)``, sorted in each partition so that a row's successor is the next of its part."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = min(MOST_RANGES, partitions * RANGES_PER_PARTITION)
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    found = docs.agg(
        F.percentile_approx("doc_id", shares, n * 20).alias("bounds"), F.count("*").alias("rows"), F.count("doc_id").alias("with_id")
    ).first()
    times = Counter(found["bounds"] or [])
    bounds = sorted(times)
    # rows of an id that fills several ranges, and rows without id, are dealt by the hash of their text
    pieces = [times[b] if times[b] > 1 else 0 for b in bounds] + [0, max(1, -(-(found["rows"] - found["with_id"]) * n // max(found["rows"], 1)))]
    offsets = list(accumulate([p + 1 for p in pieces], initial=0))
    at = lambda values, kind, place: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), place + 1)
    span = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(_range_of(F.col("doc_id"), bounds))
    rows = docs.select(span.alias("span"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), "doc_id", "text")
    whole = F.col("doc_id").isNull() | (F.col("doc_id") == at([*bounds, None, None], "long", F.col("span")))
    k = at(pieces, "int", F.col("span"))
    piece = F.least(F.floor((F.col("h") / float(1 << 64) + 0.5) * k), k - 1).cast("int") + 1
    part = at(offsets[:-1], "int", F.col("span")) + F.when(whole & (k > 0), piece).otherwise(0)
    rows = rows.select(part.alias("part"), "h", "doc_id", "text")
    heads = rows.groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("head")).orderBy("part").collect()  # one a range
    if not heads:
        return rows.select("part", F.lit(0).alias("ahead"), "doc_id", "text")
    size = offsets[-1]
    ids, hs, before = [None] * size, [None] * size, [None] * size
    for k, r in enumerate(heads):
        ids[r["part"]], hs[r["part"]], before[r["part"]] = r["head"]["doc_id"], r["head"]["h"], heads[k - 1]["part"]
    leads = F.col("doc_id").eqNullSafe(at(ids, "long", F.col("part"))) & (F.col("h") == at(hs, "long", F.col("part")))
    places = F.array_compact(
        F.array(
            F.struct("part", F.lit(0).alias("ahead")),
            F.when(leads, F.struct(at(before, "int", F.col("part")).alias("part"), F.lit(1).alias("ahead"))),
        )
    )
    dealt = rows.select(F.explode(places).alias("x"), "h", "doc_id", "text")
    return (
        dealt.select("x.part", "x.ahead", "h", "doc_id", "text")
        .repartition(partitions, "part")
        .sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_last(), "h")
        .select("part", "ahead", "doc_id", "text")
    )


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with likenesses to it and to the next document."""
    return successors(docs).mapInArrow(_compared, COMPARED_DDL)
