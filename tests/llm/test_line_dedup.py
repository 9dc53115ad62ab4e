import hashlib
import os
import random
import sys
from collections import Counter, defaultdict

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from helpers import documents  # noqa: E402

from lattica.llm import line_dedup as ld  # noqa: E402
from lattica.llm.catalog import op7_line_dedup  # noqa: E402

SF = "/root/testdata/sf0.01"


def align(a, b, i0=0, j0=0):
    """Patience diff by its recursive definition."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(i0 + k, j0 + k) for k in range(head)] + [(i0 + len(a) - 1 - k, j0 + len(b) - 1 - k) for k in range(tail)]
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    i0, j0 = i0 + head, j0 + head
    unique = [x for x in b if a.count(x) == 1 and b.count(x) == 1]
    places = [a.index(x) for x in unique]
    best = []  # longest increasing subsequence, the one whose last value is least, by table
    for k, p in enumerate(places):
        prior = [best[m] for m in range(k) if places[m] < p]
        best.append(max((x for x in prior), key=len, default=[]) + [k])
    if not best:
        return out
    n = max(map(len, best))
    chosen = ld._longest_increasing(places)
    assert len(chosen) == n
    anchors = [(places[k], b.index(unique[k])) for k in chosen]
    for (i, j), (k, m) in zip([(-1, -1), *anchors], [*anchors, (len(a), len(b))]):
        out += align(a[i + 1 : k], b[j + 1 : m], i0 + i + 1, j0 + j + 1)
    return out + [(i0 + i, j0 + j) for i, j in anchors]


def brute(rows):
    """A line goes if a run of lines of BLOCK_CHARS characters that an earlier document has covers it."""
    kept = {d: [x.strip(" ") for x in (t or "").split("\n")] for d, t in rows}
    first, runs = {}, {}
    for d in sorted(kept):
        full = [k for k, x in enumerate(kept[d]) if x]
        b = [kept[d][k] for k in full]
        runs[d] = []
        for forward in (True, False):
            for k in range(len(b)):
                n = total = 0
                while total < ld.BLOCK_CHARS and 0 <= (at := k + n if forward else k - n) < len(b):
                    total, n = total + len(b[at]), n + 1
                if total >= ld.BLOCK_CHARS:
                    lo = k if forward else k - n + 1
                    first.setdefault(tuple(b[lo : lo + n]), d)
                    runs[d].append((tuple(b[lo : lo + n]), full[lo : lo + n]))
    out = {}
    for d, text in rows:
        gone = {k for run, places in runs[d] if first[run] < d for k in places}
        if text is None:
            out[d] = (0, 0, None)
        else:
            out[d] = (len(kept[d]), len(gone), "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone))
    return out


def blocks_of(pairs, lengths):
    gone, block = set(), []
    for p in [*pairs, (-5, -5)]:
        if block and p == (block[-1][0] + 1, block[-1][1] + 1):
            block.append(p)
            continue
        if sum(lengths[j] for _, j in block) >= ld.BLOCK_CHARS:
            gone |= {j for _, j in block}
        block = [p]
    return gone


def test_patience_on_random_sequences():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randint(0, 12) for _ in range(rng.randint(0, 20))]
        b = [rng.randint(0, 12) for _ in range(rng.randint(0, 20))]
        if rng.random() < 0.5:
            b = a[:5] + b + a[8:]
        assert ld.patience(a, b) == sorted(align(a, b))


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {d: (n, g, hashlib.sha256(k.encode()).hexdigest()) for d, (n, g, k) in brute(rows).items()}
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in op7_line_dedup(spark, SF).collect()}
    assert got == want
    assert sum(g for _, g, _ in got.values()) > 0


def test_no_pair_of_documents_would_delete_more(spark):
    """Patience diffs, by their definition, of all pairs that share lines of BLOCK_CHARS characters."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    seqs = {d: [x.strip(" ") for x in (t or "").split("\n") if x.strip(" ")] for d, t in rows}
    owners = defaultdict(set)
    for d, b in seqs.items():
        for x in b:
            owners[x].add(d)
    shared = defaultdict(Counter)
    for x, ds in owners.items():
        for d in ds:
            for e in ds:
                if e < d:
                    shared[d][e] += len(x) * seqs[d].count(x)
    removed = {r.doc_id: {k for s in r._spans for k in range(s["start"], s["end"])} for r in ld.remove_lines(documents(spark, [t for _, t in rows], ids=[d for d, _ in rows])).collect()}
    total = 0
    for d, text in rows:
        full = [k for k, x in enumerate((text or "").split("\n")) if x.strip(" ")]
        for e, chars in shared[d].items():
            if chars >= ld.BLOCK_CHARS:
                gone = blocks_of(sorted(align(seqs[e], seqs[d])), [len(x) for x in seqs[d]])
                assert {full[j] for j in gone} <= removed[d]
                total += len(gone)
    assert total > 0


def test_edge_cases(spark):
    line = lambda k: f"this is line number {k} of a longer text that repeats"
    rng = random.Random(4)
    base = [line(k) for k in range(12)]
    texts = [None, "", "\n\n", "\n".join(base), "\n".join(base), "Share this page"]
    for k in range(80):
        own = list(base)
        own[rng.randrange(12)] = f"an edited line {k} that nobody else has at all"
        texts.append("\n".join(["Share this page", *own, "", "  " + line(3)]))
    texts += ["Share this page\nsomething new entirely", "\n".join(reversed(base)), "x\n" * 30_000]
    docs = documents(spark, texts).withColumn("id", F.lit(1)).withColumn("hs", F.lit("x")).withColumn("places", F.lit("y"))
    for name in ("_id", "_tag", "_places", "_spans", "_lines", "row", "tag", "c0"):
        docs = docs.withColumn(name, F.lit(name))
    out = ld.remove_lines(docs.repartition(3))
    assert out.columns == [*docs.columns, "__spans", "__lines"]
    rows = out.collect()
    got = {r.doc_id: (r["__lines"], sum(s["end"] - s["start"] for s in r["__spans"]), r.text) for r in rows}
    assert got == brute(list(enumerate(texts)))
    assert all(r[name] == name for r in rows for name in ("_id", "_tag", "_places", "_spans", "_lines", "row", "tag", "c0"))
    assert sorted(r.doc_id for r in ld.remove_lines(docs.unionAll(docs)).collect()) == sorted([*range(len(texts))] * 2)
    assert ld.remove_lines(docs.limit(0)).count() == 0
    same = documents(spark, ["\n".join(base)] * 4, ids=[5, 5, None, None])
    left = sorted((r.doc_id is None, r.text == "") for r in ld.remove_lines(same).collect())
    assert left == [(False, False)] * 2 + [(True, True)] * 2


def test_a_long_line_goes_however_common_it_is(spark):
    long = "a line of well over fifty characters that very many documents have"
    texts = [f"own {k}\n{long}\nlast {k}" for k in range(80)]
    got = {r.doc_id: r.text for r in ld.remove_lines(documents(spark, texts)).collect()}
    assert [k for k in range(80) if long in got[k]] == [0]


def test_a_block_goes_whose_lines_have_other_holders(spark):
    x, y, tail = "thirty letters make this line x", "thirty letters make this line y", "a tail"
    texts = [f"{x}\nfirst", f"{y}\nsecond", f"{tail}\nthird", f"c\n{x}\n{y}\n{tail}\nd", f"e\n{x}\n{y}\n{tail}\nf", f"{y}\n{x}\nlast"]
    got = [r.text for r in ld.remove_lines(documents(spark, texts)).orderBy("doc_id").collect()]
    assert got == [*texts[:4], "e\nf", texts[5]]


def test_shortest_runs_cover_every_block():
    rng = random.Random(6)
    for _ in range(200):
        lines = [rng.choice([3, 20, 30, 49, 50, 70]) for _ in range(rng.randint(1, 9))]
        block = [f"{n}" for n in lines]
        held = []
        for before, after in (("p", "q"), ("r", "s")):
            names = [before, *block, after]
            hs = ld.np.array([hash((k, x)) for k, x in enumerate(names)], ld.np.int64)
            doc, run = ld.shortest_runs(ld.np.zeros(len(names), int), hs, ld.np.array([60, *lines, 60]))
            held.append(set(run.tolist()))
        several = sum(lines) >= 50
        assert bool(held[0] & held[1]) == several


def test_heaviest_run_on_random_sequences():
    rng = random.Random(7)
    for _ in range(400):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(1, 14))] for _ in "ab")
        lengths = [3 * x + 1 for x in b]
        want = max(
            (sum(lengths[j : j + n]) for i in range(len(a)) for j in range(len(b)) for n in range(1, 15) if a[i : i + n] == b[j : j + n]),
            default=0,
        )
        weight, i, j, n = ld.heaviest_run(a, b, lengths)
        assert weight == want == sum(lengths[j : j + n]) and a[i : i + n] == b[j : j + n]


def test_repeated_passages_go(spark):
    rng = random.Random(8)
    for _ in range(200):  # no run of BLOCK_CHARS is left between neighbours of the alignment
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 14))] for _ in "ab")
        lengths = [25] * len(b)
        pairs = ld.patience(a, b, lengths)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:])) and all(a[i] == b[j] for i, j in pairs)
        for (i, j), (k, m) in zip([(-1, -1), *pairs], [*pairs, (len(a), len(b))]):
            assert ld.heaviest_run(a[i + 1 : k], b[j + 1 : m], lengths[j + 1 : m])[0] < 50
    long = "a line of well over fifty characters that one document has"
    texts = [f"a\n{long}\nb", f"c\n{long}\nd\n{long}\ne"]
    texts += ["f\n" + "xyz\n" * 40 + "g", "h\n" + "xyz\n" * 30 + "i"]
    got = [r.text for r in ld.remove_lines(documents(spark, texts)).orderBy("doc_id").collect()]
    assert got == [texts[0], "c\nd\ne", texts[2], "h\ni"]


def test_passages_in_another_order_go():
    rng = random.Random(9)
    for _ in range(300):
        passages = [[rng.randint(0, 40) for _ in range(rng.randint(2, 5))] for _ in range(rng.randint(1, 5))]
        a = [x for p in passages for x in [*p, 100 + rng.randint(0, 3)]]
        rng.shuffle(passages)
        b, want = [], []
        for p in [*passages, rng.choice(passages)]:
            b.append(200 + len(b))
            want += range(len(b), len(b) + len(p))
            b += p
        assert set(want) <= set(ld.common_blocks(a, b, [25] * len(b)))
