"""Components against union by hand, with hubs, chains and repeated edges."""

import random

from vellum.llm import graphs
from vellum.llm.graphs import components


def plain(edges):
    label = {}
    find = lambda x: x if label.setdefault(x, x) == x else find(label[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        label[y] = x
    return {x: find(x) for x in label}


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(2000, 2060)]
    rng.shuffle(chain)
    hub = [(900, x) for x in range(901, 1400)] + [(x, 900) for x in range(901, 950)]
    some = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    edges = chain + hub + some + [(7, 7), (901, 1401)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.label for r in components(df).collect()} == plain(edges)
    assert components(df.limit(0)).count() == 0


def test_rows_of_hubs_stay(spark, monkeypatch):
    """A hub of most edges is a frequent key: its rows are joined with a broadcast table."""
    seen = []
    join = graphs.join_counted

    def counted(rows, table, on, times, total):
        seen.append((on, table.filter(f"{times} * 4096 > {total}").count(), table.count()))
        return join(rows, table, on, times, total)

    monkeypatch.setattr(graphs, "join_counted", counted)
    edges = [(1, x) for x in range(2, 6000)]
    found = components(spark.createDataFrame(edges, "a long, b long")).groupBy("label").count().collect()
    assert [(r["label"], r["count"]) for r in found] == [(1, 5999)]
    assert seen[0] == (["b"], 1, 5999)  # the hub alone
    assert seen[1] == (["label"], 1, 1)
