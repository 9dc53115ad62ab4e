"""Benchmark decontamination by BM25 retrieval with block-max WAND.

The test items form an inverted index: for each term a list of postings in item order, its BM25
weight in each item divided by the item's score against itself, so a passage that holds a whole item
scores 1 for it. Items are numbered by ascending length and cut into blocks of ``BLOCK_ITEMS``; a
list keeps for each of its blocks the largest weight there, and the largest from there on.

Every text is cut into passages of two segments, each as long as the longest item, overlapping by
one segment, so any item quoted anywhere lies within one passage. All passages are queries. Each
has a cursor for each of its distinct terms. A step orders the cursors by block; the first block at
which the largest weights from there on sum up to ``LEAST_SCORE`` is the pivot. Cursors behind it
jump there over what lies between; if the maxima of the pivot block itself reach the threshold its
items are scored, and the cursors pass on. All passages of a batch make their steps together.
Every item at ``LEAST_SCORE`` or more is found.

A candidate is verified in its passage: at least ``OVERLAP`` of the item's distinct shingles of
``SHINGLE`` words, and of the distinct words of its answer, must occur. The answer is what follows
an ``Answer:`` mark or else the last sentence, and the whole item if it has but one sentence.

Item count, mean and longest length and document frequencies are those of all items. Items are
dealt to slices of about ``SLICE_BYTES`` of text, of which the driver indexes and shares one at a
time; weights and passages do not depend on the slices, so hits and scores do not either. Beyond
one slice each pass's hits are written before its index is released.

An item without words is never found. Null and empty texts have no hits. Repeated rows of the
documents have equal hits; rows of the benchmark that are equal count once. Other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import discard, materialize

SHINGLE = 5
OVERLAP = 0.8
LEAST_SCORE = 0.5
K1, B = 1.2, 0.75
BLOCK_ITEMS = 16
SLICE_BYTES = 8 << 20
BATCH_WORDS = 1 << 16
#: Sums of weights that differ by less than this are equal.
ROUNDING = 1e-6

WORDS = re.compile(r"\w+").findall
ANSWER_MARK = re.compile(r"\banswer\s*:", re.I)
SENTENCE_END = re.compile(r"(?<=[.?!])\s+")


def words_of(text: str) -> list[str]:
    return WORDS(text.lower())


def answer_of(text: str) -> str:
    marks = list(ANSWER_MARK.finditer(text))
    if marks:
        return text[marks[-1].end() :]
    return SENTENCE_END.split(text.strip())[-1]


def shingles(words: list[int]) -> set[tuple[int, ...]]:
    n = min(SHINGLE, len(words))
    return set(zip(*[words[i:] for i in range(n)]))


class Statistics(NamedTuple):
    """Of all items with a word: their number, mean and longest length, and in how many each term occurs."""

    items: int
    mean: float
    longest: int
    frequency: dict[str, int]

    @classmethod
    def of(cls, texts: list[str]) -> Statistics:
        kept = [w for w in map(words_of, texts) if w]
        lengths = [len(w) for w in kept] or [1]
        return cls(len(kept), sum(lengths) / len(lengths), max(lengths), Counter(t for w in kept for t in set(w)))


class Index:
    """Postings and blocks of a slice's items, weighted by the statistics of all items.

    Lists lie one after the other, by term: ``item`` and ``weight`` of the postings; ``block``,
    ``most`` (largest weight in it), ``rest`` (largest from it on) and ``start`` (first posting) of
    their blocks. Each list of blocks ends with one numbered ``end`` that has no posting.
    """

    def __init__(self, items: list[tuple[int | None, str]], stats: Statistics | None = None):
        stats = stats or Statistics.of([t for _, t in items])
        kept = [(i, w, t) for i, t in items if (w := words_of(t))]
        kept.sort(key=lambda x: (len(x[1]), x[0] is None, x[0] or 0, x[2]))
        self.ids = [i for i, _, _ in kept]
        self.longest = stats.longest
        # terms are numbered in their order, so that sums run alike whatever the slice
        self.terms = {t: k for k, t in enumerate(sorted({t for _, w, _ in kept for t in w}))}
        self.words = [np.array([self.terms[t] for t in w], np.int32) for _, w, _ in kept]
        self.answers = [np.array([self.terms.get(t, -2) for t in words_of(answer_of(x)) or w], np.int32) for _, w, x in kept]
        n = max(len(self.terms), 1)
        pair = [np.unique(k * n + w.astype(np.int64), return_counts=True) for k, w in enumerate(self.words)]
        of_item, tf = (np.concatenate([x[i] for x in pair]) if pair else np.zeros(0, np.int64) for i in (0, 1))
        item, term = of_item // n, of_item % n
        df = np.array([stats.frequency[t] for t in self.terms], np.float64)
        norm = K1 * (1 - B + B * np.array([len(w) for w in self.words], float) / stats.mean)
        weight = np.log1p((stats.items - df[term] + 0.5) / (df[term] + 0.5)) * tf * (K1 + 1) / (tf + norm[item])
        weight /= np.bincount(item, weight, len(kept))[item]
        by_term = np.argsort(term, kind="stable")
        self.item, self.weight, term = item[by_term], weight[by_term], term[by_term]
        self.end = -(-len(kept) // BLOCK_ITEMS)
        width = self.end + 1
        key = term * width + self.item // BLOCK_ITEMS
        firsts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        most = np.maximum.reduceat(self.weight, firsts) if len(key) else np.zeros(0)
        ends = np.arange(len(self.terms)) * width + self.end
        order = np.argsort(np.r_[key[firsts], ends], kind="stable")
        self.key = np.r_[key[firsts], ends][order]
        self.block = self.key % width
        self.most = np.r_[most, np.zeros(len(ends))][order]
        self.start = np.r_[firsts, np.zeros(len(ends), np.int64)][order]
        self.size = np.r_[np.diff(np.r_[firsts, len(key)]), np.zeros(len(ends), np.int64)][order]
        apart = 2.0 * (len(self.terms) - self.key // width)  # weights are at most 1: maxima of one list stay in it
        self.rest = (np.maximum.accumulate((self.most + apart)[::-1])[::-1] - apart).clip(0)
        self.first = np.searchsorted(self.key, np.arange(len(self.terms)) * width)

    def retrieve(self, passage: np.ndarray, term: np.ndarray, least: float | None = None) -> list[tuple[int, int, float]]:
        """(passage, item, score) at ``least`` or more; the queries are distinct pairs in order of passage and term."""
        least = (LEAST_SCORE if least is None else least) - ROUNDING
        found, cursor, changed = [], self.first[term], True
        while len(cursor):
            if changed:
                starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
                each = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(passage)]))
            block = self.block[cursor]
            pivot = self._pivots(block, self.rest[cursor], starts, each, least)
            aim = pivot[each]
            behind = np.flatnonzero(block < aim)
            cursor[behind] = np.searchsorted(self.key, term[behind] * (self.end + 1) + aim[behind])
            block[behind] = self.block[cursor[behind]]
            there = block == aim
            reach = np.add.reduceat(np.where(there, self.most[cursor], 0.0), starts)
            promising = (reach >= least) & (pivot < self.end)
            if promising.any():
                rows = np.flatnonzero(there & promising[each])
                found += self._scored(passage[rows], cursor[rows], least)
            over = aim == self.end
            cursor += there & ~over
            over |= self.block[cursor] == self.end
            if changed := over.sum() * 8 > len(over):
                passage, term, cursor = passage[~over], term[~over], cursor[~over]
        return found

    def _pivots(self, block, rest, starts, each, least) -> np.ndarray:
        """For each passage the first block up to which its cursors' bounds reach the threshold, or ``end``."""
        pivot = np.minimum.reduceat(block, starts)
        reach = np.add.reduceat(np.where(block == pivot[each], rest, 0.0), starts)
        unsure = reach < least
        rows = np.flatnonzero(unsure[each])
        pivot[unsure] = self.end
        if len(rows):
            rows = rows[np.argsort(each[rows] * (self.end + 1) + block[rows], kind="stable")]
            owner, sums = each[rows], np.cumsum(rest[rows])
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            before = np.repeat(np.r_[0.0, sums[heads[1:] - 1]], np.diff(np.r_[heads, len(rows)]))
            hits = np.flatnonzero(sums - before >= least)
            hits = hits[np.r_[True, owner[hits[1:]] != owner[hits[:-1]]][: len(hits)]]
            pivot[owner[hits]] = block[rows[hits]]
        return pivot

    def _scored(self, passage, cursor, least) -> list[tuple[int, int, float]]:
        """Scores of the items of the cursors' blocks, each passage's cursors being in one block."""
        size = self.size[cursor]
        at = np.repeat(self.start[cursor] - np.cumsum(size) + size, size) + np.arange(size.sum())
        new, place = np.unique(passage, return_inverse=True)
        cell, place = np.unique(np.repeat(place, size) * len(self.ids) + self.item[at], return_inverse=True)
        scores = np.bincount(place, self.weight[at])
        keep = np.flatnonzero(scores >= least)
        return [(int(new[c // len(self.ids)]), int(c % len(self.ids)), float(s)) for c, s in zip(cell[keep].tolist(), scores[keep].tolist())]

    def verify(self, words: np.ndarray, item: int) -> float:
        """Share of the item's shingles in ``words``, or 0 if the shingles or the answer overlap too little."""
        want, words = shingles(self.words[item].tolist()), words.tolist()
        n = len(next(iter(want)))
        share = len(want.intersection(zip(*[words[i:] for i in range(n)]))) / len(want)
        answer = set(self.answers[item].tolist())
        if share < OVERLAP or len(answer.intersection(words)) < OVERLAP * len(answer):
            return 0.0
        return share

    def hits(self, texts: list[str | None]) -> list[list[tuple[int | None, float, float]]]:
        """For each text its (item id, best score, best overlap), by item."""
        out = [{} for _ in texts]
        get, group, held = self.terms.get, [], 0
        for at, text in enumerate(texts):
            if text and self.ids and (words := words_of(text)):
                group.append((at, np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))))
                held += len(words)
                if held >= BATCH_WORDS:
                    self._search(group, out)
                    group, held = [], 0
        self._search(group, out)
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0, k)) if any(out) else []
        rank = {k: r for r, k in enumerate(order)}
        return [[(self.ids[k], *found[k]) for k in sorted(found, key=rank.__getitem__)] for found in out]

    def _search(self, group: list[tuple[int, np.ndarray]], out: list[dict]) -> None:
        """Adds the verified hits of ``group``, (place in out, term ids of a text's words or -1), to ``out``."""
        if not group:
            return
        step = self.longest
        counts = [max(1, -(-len(ids) // step) - 1) for _, ids in group]
        base = np.cumsum([0, *counts])
        passages, terms = [], []
        for (_, ids), first, n in zip(group, base.tolist(), counts):
            known = np.flatnonzero(ids >= 0)
            segment, term = known // step, ids[known]
            for back in (0, 1):  # a segment is the first part of one passage and the second of that before
                inside = (segment >= back) & (segment - back < n)
                passages.append(first + segment[inside] - back)
                terms.append(term[inside])
        pair = np.unique(np.concatenate(passages) * len(self.terms) + np.concatenate(terms))
        for p, item, score in self.retrieve(pair // len(self.terms), pair % len(self.terms)):
            k = int(np.searchsorted(base, p, "right")) - 1
            at, ids = group[k]
            lo = (p - int(base[k])) * step
            if overlap := self.verify(ids[lo : lo + 2 * step], item):
                old = out[at].get(item, (0.0, 0.0))
                out[at][item] = (max(old[0], score), max(old[1], overlap))


def _parsed(batches):
    for batch in batches:
        words = [words_of(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))],
            names=["part", "length", "terms"],
        )


class item_slices:
    """(test items, statistics) of slices of about ``SLICE_BYTES``, each collected when the iteration comes to it.

    The statistics are of all items; document frequencies come for a slice's own terms only.
    """

    def __init__(self, benchmark: DataFrame):
        items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL").distinct()
        total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        self.n = max(1, -(-total // SLICE_BYTES))
        self.items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n)))

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[tuple[list[tuple[int | None, str]], Statistics]]:
        parsed = self.items.select("text", "part").mapInArrow(_parsed, "part long, length long, terms array<string>").filter("length > 0")
        parsed = materialize(parsed, "items")
        whole = parsed.agg(F.count("*"), F.sum("length"), F.max("length")).first()
        terms = parsed.select("part", F.explode("terms").alias("term"))
        frequency = materialize(terms.groupBy("term").agg(F.count("*").alias("n")), "terms")
        for k in range(self.n):
            own = frequency.join(terms.filter(F.col("part") == k).select("term"), "term", "left_semi").collect()
            mean = whole[1] / whole[0] if whole[0] else 1.0
            stats = Statistics(whole[0], mean, whole[2] or 1, {r["term"]: r["n"] for r in own})
            yield [(r["item_id"], r["text"]) for r in self.items.filter(F.col("part") == k).collect()], stats


HIT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64())])


def _passes(benchmark: DataFrame, search, label: str) -> list[DataFrame]:
    """``search(shared index, results so far)`` for each slice; of several, each is written before its index is released."""
    slices, out = item_slices(benchmark), []
    for items, stats in slices:
        shared = benchmark.sparkSession.sparkContext.broadcast(Index(items, stats))  # of about SLICE_BYTES of text
        found = search(shared, out)
        if len(slices) > 1:
            found = materialize(found, label)
            shared.destroy()
        out.append(found)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, score, overlap)`` for every verified hit."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def search(shared, _):
        def run(batches):
            index = shared.value
            for batch in batches:
                rows = [
                    (doc_id, item, score, overlap)
                    for doc_id, found in zip(batch.column(0).to_pylist(), index.hits(batch.column(1).to_pylist()))
                    for item, score, overlap in found
                ]
                columns = zip(*rows) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, HIT.types)], schema=HIT)

        return docs.mapInArrow(run, "doc_id long, item_id long, score double, overlap double")

    return reduce(DataFrame.unionAll, _passes(benchmark, search, "hits"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns as they are, without a verified hit."""
    at = docs.columns.index("text")

    def search(shared, before):
        def run(batches):
            index = shared.value
            for batch in batches:
                keep = [not found for found in index.hits(batch.column(at).cast(pa.string()).to_pylist())]
                yield batch.filter(pa.array(keep, pa.bool_()))

        if len(before) > 1:
            discard(before[-2])
        return (before[-1] if before else docs).mapInArrow(run, docs.schema)

    return _passes(benchmark, search, "clean")[-1]
