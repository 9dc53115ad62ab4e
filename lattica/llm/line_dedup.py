"""Line deduplication by patience diff of documents that share passages of whole lines.

1. Every line that is not blank gets a hash; a document is its sequence of hashes. Equal sequences
   form one class, whose first documents, those of its least id, stand for it; its later documents
   lose all lines, if these have ``BLOCK_CHARS`` characters together.
2. A document is aligned with every earlier one that is the first to have one of its passages: from
   each line on, and back from each line, the shortest run of lines with ``BLOCK_CHARS`` characters
   (one line, if it is that long). Any block that two documents share is made of such passages, so
   whatever an earlier document has, the first holder of its passages has. There are at most two
   partners a line, however common or rare the passage is and however many documents hold it.
3. Patience diff: equal ends, then lines unique in both sequences, in the longest order that both
   keep, then the same between them. Where no line is unique in both, the common run of most
   characters, if it has ``BLOCK_CHARS``, serves instead. Runs of aligned lines, consecutive in both
   documents, of at least ``BLOCK_CHARS`` characters are deleted from the document with the larger
   id. What is left of it between them is aligned again with the whole earlier document, until
   nothing more is found, so passages that stand in another order, or more often, go as well.

A line thus goes if it is in a run of lines of ``BLOCK_CHARS`` characters that an earlier document
has as well. (What may stay of such runs are under ``BLOCK_CHARS`` characters at an end of a run
that overlaps another one, if the same earlier document is the first with both and has them apart.)

All decisions rest on the input texts. Nulls in ``doc_id`` form one last id; rows with equal ids
are not compared with each other. A null text has no lines and stays null. Other columns are kept
by ``remove_lines`` and ignored otherwise.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.columns import unused
from lattica.session import materialize

BLOCK_CHARS = 50
SALTS = 32
NULL_ID = 2**63 - 1


def _longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting."""
    tops, places, before = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before.append(places[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            places.append(i)
        else:
            tops[k], places[k] = v, i
    out, i = [], places[-1] if places else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def heaviest_run(a: list[int], b: list[int], lengths: list[int]) -> tuple[int, int, int, int]:
    """(characters, i, j, n) of the common run a[i:i+n] == b[j:j+n] of most characters, nearest to b's middle among equals.

    A suffix automaton of ``a`` is walked along ``b``.
    """
    following, link, size, end = [{}], [-1], [0], [-1]
    last = 0
    for i, x in enumerate(a):
        new, p = len(size), last
        following.append({})
        link.append(0)
        size.append(size[last] + 1)
        end.append(i)
        while p >= 0 and x not in following[p]:
            following[p][x] = new
            p = link[p]
        if p >= 0:
            q = following[p][x]
            if size[q] != size[p] + 1:
                copy = len(size)
                following.append(dict(following[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                end.append(end[q])
                while p >= 0 and following[p].get(x) == q:
                    following[p][x] = copy
                    p = link[p]
                link[q] = q = copy
            link[new] = q
        last = new
    total = [0, *accumulate(lengths)]
    best, state, n = (0, 0, 0, 0, 0), 0, 0
    for j, x in enumerate(b):
        while state and x not in following[state]:
            state = link[state]
            n = size[state]
        if x in following[state]:
            state, n = following[state][x], n + 1
            weight = total[j + 1] - total[j + 1 - n]
            if weight >= best[0]:
                best = max(best, (weight, -abs(2 * j - len(b)), end[state] - n + 1, j - n + 1, n))
    weight, _, i, j, n = best
    return weight, i, j, n


def patience(a: list[int], b: list[int], lengths: list[int] | None = None, least: int = BLOCK_CHARS) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], increasing in both.

    ``lengths``, of b's lines, lets runs of ``least`` characters serve where no line is unique in both.
    """
    matched, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {x: i for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and in_b[x] == 1}
        both = [(at[x], j) for j, x in enumerate(b[b0:b1], b0) if x in at]
        anchors = [both[k] for k in _longest_increasing([i for i, _ in both])]
        if not anchors:
            if lengths is None or sum(n for x, n in zip(b[b0:b1], lengths[b0:b1]) if x in in_a) < least:
                continue
            weight, i, j, n = heaviest_run(a[a0:a1], b[b0:b1], lengths[b0:b1])
            if weight < least:
                continue
            anchors = [(a0 + i + k, b0 + j + k) for k in range(n)]
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            todo.append((i + 1, k, j + 1, m))
        matched += anchors
    return sorted(matched)


def common_blocks(a: list[int], b: list[int], lengths: list[int], least: int = BLOCK_CHARS) -> list[int]:
    """Places of b in aligned blocks of at least ``least`` characters; ``lengths``: of b's lines."""
    if a == b:
        return list(range(len(b))) if sum(lengths) >= least else []
    known, out = set(a), []
    todo = [(0, len(b))]
    while todo:
        lo, hi = todo.pop()
        if sum(n for x, n in zip(b[lo:hi], lengths[lo:hi]) if x in known) < least:
            continue
        blocks, block = [], []
        for i, j in [*patience(a, b[lo:hi], lengths[lo:hi], least), (-1, -1)]:
            if block and (i, j) == (block[-1][0] + 1, block[-1][1] + 1):
                block.append((i, j))
                continue
            if sum(lengths[lo + y] for _, y in block) >= least:
                blocks.append((lo + block[0][1], lo + block[-1][1] + 1))
            block = [(i, j)]
        if not blocks:
            weight, _, j, n = heaviest_run(a, b[lo:hi], lengths[lo:hi])
            if weight < least:
                continue
            blocks = [(lo + j, lo + j + n)]
        for x, y in blocks:
            out += range(x, y)
        todo += [(x, y) for (_, x), (y, _) in zip([(0, lo), *blocks], [*blocks, (hi, 0)]) if x < y]
    return sorted(out)


def _aligned(batches):
    for batch in batches:
        found = [common_blocks(a, b, n) for a, b, n in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)])]
        keep = pa.array([bool(x) for x in found], pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["id", "tag", "places"]
        ).filter(keep)


def shortest_runs(doc: np.ndarray, h: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(document, hash)`` of passages: the shortest runs of ``BLOCK_CHARS`` from each line on, and back from each.

    Lines of one document follow each other, each with its hash and characters.
    """
    n = len(h)
    ends = np.r_[0, np.cumsum(chars)]
    after = np.searchsorted(ends, ends[:-1] + BLOCK_CHARS)  # where the run from each line ends
    before = np.searchsorted(ends, ends[1:] - BLOCK_CHARS, "right") - 1  # where the run back from each begins
    first, last = np.r_[np.arange(n), before], np.r_[after, np.arange(1, n + 1)]
    keep = (first >= 0) & (last <= n)
    first, last = first[keep], last[keep]
    keep = doc[first] == doc[last - 1]
    first, last = first[keep], last[keep]
    mixed = (h.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    run = np.zeros(len(first), np.uint64)
    for k in range(int((last - first).max(initial=0))):  # at most BLOCK_CHARS lines, as none is empty
        live = np.flatnonzero(first + k < last)
        run[live] = (run[live] ^ (run[live] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + mixed[first[live] + k]
    run ^= run >> np.uint64(32)
    return doc[first], run.view(np.int64)


def _held(batches):
    """``(id, tag, h)``: each distinct passage of a document."""
    for batch in batches:
        hs, ns = batch.column(2), batch.column(3)
        doc = np.repeat(np.arange(len(batch)), np.diff(hs.offsets.to_numpy()))
        doc, h = shortest_runs(doc, hs.flatten().to_numpy(), ns.flatten().to_numpy().astype(np.int64))
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])][: len(h)])
        at = pa.array(doc[first])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(h[first])], names=["id", "tag", "h"])


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))


def _hashes(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.xxhash64(x))


def _lines() -> Column:
    return F.filter(F.transform(F.split(F.col("text").cast("string"), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def removable_lines(docs: DataFrame) -> DataFrame:
    """``(id, tag, places)``: places, among the lines that are not blank, of the lines to delete.

    ``tag`` is the hash of a document's sequence of line hashes.
    """
    seqs = docs.select(_id().alias("id"), _lines().alias("lines")).filter(F.size("lines") > 0)
    seqs = seqs.select("id", _hashes(F.col("lines")).alias("hs"), F.transform("lines", lambda x: F.length(x)).alias("ns"))
    seqs = seqs.select("id", F.xxhash64("hs").alias("tag"), F.xxhash64(F.lit(1), F.reverse("hs")).alias("tag2"), "hs", "ns")
    seqs = materialize(seqs, "lines")
    classes = seqs.groupBy("tag", "tag2").agg(
        F.min("id").alias("id"), F.max("id").alias("last"), F.any_value("hs").alias("hs"), F.any_value("ns").alias("ns")
    )
    classes = materialize(classes, "line-classes")
    chars = F.aggregate("ns", F.lit(0).cast("long"), lambda n, x: n + x)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")  # rows of one class are many
    several = classes.filter((F.col("last") > F.col("id")) & (chars >= BLOCK_CHARS)).select("tag", "tag2", F.col("id").alias("first"), salts)
    copies = seqs.select("id", "tag", "tag2", F.size("hs").alias("n"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    copies = copies.join(several, ["tag", "tag2", "salt"]).filter("id > first").select("id", "tag", "n").distinct()
    copies = copies.select("id", "tag", F.sequence(F.lit(0), F.col("n") - 1).alias("places"))

    held = classes.select("id", "tag", "hs", "ns").mapInArrow(_held, "id long, tag long, h long")
    known = held.groupBy("h").agg(F.min(F.struct("id", "tag")).alias("holder"), F.count("*").alias("n")).filter("n > 1").select("h", "holder")
    known = materialize(known, "passages")  # read anew, so that a common passage's rows can be split in the join
    pairs = held.join(known, "h").filter(F.col("id") > F.col("holder.id")).select("id", "tag", F.col("holder.id").alias("a_id"), F.col("holder.tag").alias("a_tag"))
    first = classes.select(F.col("id").alias("a_id"), F.col("tag").alias("a_tag"), F.col("hs").alias("a"))
    sides = pairs.distinct().join(first, ["a_id", "a_tag"]).join(classes, ["id", "tag"]).select("id", "tag", "a", "hs", "ns")
    found = sides.mapInArrow(_aligned, "id long, tag long, places array<int>")
    found = found.groupBy("id", "tag").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))
    return found.unionAll(copies)


def _cut(text_at: int, places_at: int):
    def run(batches):
        for batch in batches:
            texts, spans, counts = [], [], []
            for text, places in zip(batch.column(text_at), batch.column(places_at)):
                text = text.as_py()
                lines = text.split("\n") if text is not None else []
                counts.append(len(lines))
                if not places.is_valid:
                    texts.append(text)
                    spans.append([])
                    continue
                full = [i for i, x in enumerate(lines) if x.strip(" ")]
                gone = np.zeros(len(lines) + 2, np.int8)
                gone[[full[p] + 1 for p in places.as_py()]] = 1
                turns = np.flatnonzero(np.diff(gone)).tolist()
                spans.append([{"start": a, "end": b} for a, b in zip(turns[::2], turns[1::2])])
                texts.append("\n".join(x for x, g in zip(lines, gone[1:]) if not g))
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, pa.string())
            columns[places_at] = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            columns = [*columns[: places_at + 1], pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

    return run


def remove_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the deleted lines cut from ``text``, and ``_spans`` (intervals of lines cut), ``_lines`` (before).

    These two names get further underscores in front if ``docs`` has such columns.
    """
    docs = docs.withColumn("text", F.col("text").cast("string"))
    gone = materialize(removable_lines(docs), "cut-lines")
    # columns go by place, so that none can clash with a name used here
    rows = docs.select(_id().alias("id"), F.xxhash64(_hashes(_lines())).alias("tag"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(gone, ["id", "tag"], "left")
    rows = rows.select(*[F.col("row").getField(c).alias(f"c{k}") for k, c in enumerate(docs.columns)], "places")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    added = zip(unused(["_spans", "_lines"], docs.columns), (span, T.LongType()))
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in added]])
    by_place = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(schema.fields)])
    return rows.mapInArrow(_cut(docs.columns.index("text"), len(docs.columns)), by_place).toDF(*schema.names)
