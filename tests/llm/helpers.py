"""Fixtures shared by the tests of the llm operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None, langs=None, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [
        (i, t, langs[k] if langs else "en", sources[k] if sources else "s", len(t) if t is not None else None)
        for k, (i, t) in enumerate(zip(ids, texts))
    ]
    return spark.createDataFrame(rows, SCHEMA)


def union_components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]
