"""Co-occurrence recommendations and path counts against plain Python."""

import math
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from sendero.operators.cooccurrence import cooccurrence_recommendations, site_pairs
from sendero.operators import path_counts as paths_module
from sendero.operators.path_counts import path_counts

VISITS = {"u1": ["a", "b", "c"], "u2": ["a", "b"], "u3": ["b", "c", "d"], "u4": ["d"], "all": list("abcdefgh"), "u5": ["e", "f", "a"]}


def _consumed(spark):
    return spark.createDataFrame([(u, s) for u, sites in VISITS.items() for s in sites], "id_usuario string, url_sitio string")


@pytest.mark.parametrize("segment", [256, 2])  # 2: lists are cut into many segments
def test_pairs_are_counted_once(spark, segment):
    number = {s: i for i, s in enumerate("abcdefgh")}
    rows = spark.createDataFrame([(u, number[s]) for u, sites in VISITS.items() for s in sites], "u string, i int")
    got = {(r.a, r.b): r.n for r in site_pairs(rows, segment).collect()}
    want = Counter(p for sites in VISITS.values() for p in combinations(sorted(number[s] for s in sites), 2))
    assert got == want


def test_lists_against_plain_python(spark):
    users = Counter(s for sites in VISITS.values() for s in sites)
    shared = Counter(p for sites in VISITS.values() for x in sites for y in sites if x != y for p in [(x, y)])
    near = {}
    for s in users:
        ranked = sorted((-(shared[s, t] / math.sqrt(users[s] * users[t])), t) for t in users if shared[s, t])
        near[s] = [(t, -x) for x, t in ranked[:3]]
    catalog = set("abcdefg")
    want = {}
    for u, sites in VISITS.items():
        score = defaultdict(float)
        for s in sites:
            for t, x in near[s]:
                score[t] += x
        best = sorted((-round(x, 6), t) for t, x in score.items() if t not in sites and t in catalog)[:2]
        want |= {(u, i + 1): (t, -x) for i, (x, t) in enumerate(best)}
    frame = spark.createDataFrame([(s,) for s in sorted(catalog)], "url_sitio string")
    rows = cooccurrence_recommendations(_consumed(spark), frame, 2, neighbours=3, segment=3).collect()
    got = {(r.id_usuario, r["rank"]): (r.url_sitio, r.puntuacion) for r in rows}
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-6 for x in want)
    assert not any(u == "all" for u, _ in got)


def test_paths_are_counted_not_listed(spark):
    edges = [("u1", "s1", "V"), ("u1", "s2", "V"), ("u1", "s2", "V"), ("u2", "s3", "V"), ("s1", "c", "L"), ("s2", "c", "L"), ("s3", "c", "L"),
             ("c", "r", "L"), ("s1", None, "L"), (None, "c", "L")]
    frame = spark.createDataFrame(edges, "origen string, destino string, relacion string")
    starts = spark.createDataFrame([("u1",), ("u2",), ("nobody",)], "inicio string")
    targets = spark.createDataFrame([("u1", "s3"), ("u2", "s1")], "inicio string, nodo string")
    got = {(r.inicio, r.tipo, r.saltos, r.nodo): r.caminos
           for r in path_counts(frame, starts, [("V", "L"), ("V", "L", "L"), ("V", "L", "~L")], targets, (("V", "L", "~L"),)).collect()}
    assert got == {("u1", "V>L", 2, "c"): 2, ("u2", "V>L", 2, "c"): 1, ("u1", "V>L>L", 3, "r"): 2, ("u2", "V>L>L", 3, "r"): 1,
                   ("u1", "V>L>~L", 3, "s3"): 2, ("u2", "V>L>~L", 3, "s1"): 1}
    with pytest.raises(ValueError):
        path_counts(frame, starts, [("V",), ("V", "L")], targets, (("V",),))


def _join_rows(frame):
    """Rows that the joins of an executed frame gave."""
    frame.collect()

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        own = node.metrics().get("numOutputRows").get().value() if "Join" in name else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(frame._jdf.queryExecution().executedPlan())


def test_a_city_of_many_sites_is_not_spread_over_its_visitors(spark, monkeypatch):
    users, sites = 60, 200
    edges = [(f"u{i}", "s0", "V") for i in range(users)] + [(f"s{i}", "c", "L") for i in range(sites)]
    frame = spark.createDataFrame(edges, "origen string, destino string, relacion string")
    starts = spark.createDataFrame([(f"u{i}",) for i in range(users)], "inicio string")
    targets = spark.createDataFrame([(f"u{i}", f"s{i + 1}") for i in range(users)] * 2, "inicio string, nodo string")
    kinds, rows, write = [], [], paths_module.write_once

    def watched(df, name):
        if name == "graph-steps":
            kinds.extend(r.paso for r in df.select("paso").distinct().collect())
        if name == "frontier":
            rows.append(_join_rows(df))
        return write(df, name)

    monkeypatch.setattr(paths_module, "write_once", watched)
    got = path_counts(frame, starts, [("V", "L"), ("V", "L", "~L")], targets, (("V", "L", "~L"),)).collect()
    assert sorted((r.inicio, r.nodo) for r in got if r.tipo == "V>L>~L") == sorted((f"u{i}", f"s{i + 1}") for i in range(users))
    assert all(r.caminos == 1 for r in got) and len(got) == 2 * users
    # Nobody asks for "~V"; the third hop meets a step per target, not per site and user.
    assert sorted(kinds) == ["L", "V", "~L"] and max(rows) <= 4 * users


def test_pairs_are_added_up_in_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from sendero.operators.cooccurrence import _pairs

    rng = np.random.default_rng(1)
    lists = [np.sort(rng.choice(20_000, 256, replace=False)) for _ in range(200)]
    batch = pa.record_batch({"first": pa.array(lists), "second": pa.array(lists), "same": pa.array([True] * 200)})
    tracemalloc.start()
    total = sum(pa.compute.sum(b.column("n")).as_py() for b in _pairs([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 200 * 256 * 255 // 2 and peak < 120 << 20
