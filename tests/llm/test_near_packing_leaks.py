import collections
import random

import numpy as np
import pytest

from tests.llm import brute
from tests.oracle import DATA
from tessera.llm import decontaminate, graph, near, packing


def test_near_pairs_against_brute_force(spark, docs, texts):
    got = {(r[0], r[1]): r[2] for r in near.near_pairs(docs).collect()}
    want = brute.near(texts, near.N, near.THRESHOLD)
    assert set(got) <= set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert len(got) >= near.RECALL * len(want)


def test_near_recall_on_documents(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]
    want = brute.near(rows, near.N, near.THRESHOLD)
    got = {(r[0], r[1]): r[2] for r in near.near_pairs(d).collect()}
    assert set(got) <= set(want) and len(got) >= near.RECALL * len(want) > 0


def test_near_classes_against_brute_force(spark, docs, texts):
    want = brute.classes(texts, near.N, near.THRESHOLD)
    for options in ({}, {"block": 2, "few": 2}):
        rows = near.near_classes(docs, **options).collect()
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows if r["doc_id"] is not None}
        assert got == want and len(rows) == len(want) + sum(i is None for i, _ in texts)
        assert all(r["class_id"] is None and r["n_links"] == 0 for r in rows if r["doc_id"] is None)


def test_prefixes_are_shortened_by_what_probes_meet(spark):
    rng = random.Random(8)
    rows = []
    for k in range(60):
        base = [f"w{k}x{i}" for i in range(120)]
        rows.append((2 * k, " ".join(base)))
        rows.append((2 * k + 1, " ".join(w if rng.random() > 0.1 else f"{w}y" for w in base)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets = near.sketches(d, near.N, near.TREES, near.SEED)
    deep, flat = (near.measured(sets, x, 0.5, 1000, 1) for x in (4, 1))
    assert deep < flat and 0.5 < deep < 1 and flat > 0.99
    assert near.measured(sets.where("id < 0"), 3, 0.5, 1000, 1) == 1.0


def test_one_of_each(spark, docs, texts):
    out = near.one_of_each(docs)
    assert out.columns == docs.columns
    got = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    root = brute.groups(brute.near(texts, near.N, near.THRESHOLD))
    want = collections.Counter({(i, t) for i, t in texts if i is not None and root.get(i, i) == i})
    want.update((i, t) for i, t in texts if i is None)
    assert got == want


def test_near_depth_falls_with_recall():
    assert near.depth(0.5, 24, 0.5) > near.depth(0.5, 24, 0.999)


def test_components_by_joins_agree(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 1), (7, 7), (8, 20), (20, 21), (21, 22)], "a long, b long")
    local, joined = (sorted(map(tuple, graph.components(e, local_edges=n).collect())) for n in (100, 0))
    assert local == joined == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8), (20, 8), (21, 8), (22, 8)]


def test_empty_tables(spark, docs, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert near.near_pairs(none).count() == near.near_classes(none).count() == near.one_of_each(none).count() == packing.pack(none).count() == 0
    assert decontaminate.contaminated(docs, bench).count() == 0
    assert decontaminate.contaminated(none, spark.createDataFrame([(1, "a b c d")], "item_id long, text string")).count() == 0
    assert decontaminate.clean(docs, bench).count() == docs.count()


def test_each_bound_removes_a_pair(spark):
    item = [f"w{k}" for k in range(30)]
    spread = [w for k in range(28) for w in (*item[k : k + 3], *(f"z{k}x{j}" for j in range(40)))]
    docs = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[:6])), (3, " ".join(spread)), (4, " ".join(item[5:29]))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    ordered = decontaminate.ordered_items(docs, bench, 3, 0.6, 10**6)
    got = {r["doc_id"]: (r["long"], r["close"]) for r in decontaminate.candidates(docs, ordered, 3, 10**6).collect()}
    assert got[1] == got[4] == (True, True) and not got.get(2, (False,))[0] and got[3] == (True, False)
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()} == {1, 4}


@pytest.fixture(scope="module")
def items(spark, texts):
    t = texts[1][1].split()
    rows = [(1, " ".join(t[3:18])), (2, "one two"), (3, None), (4, ""), (None, t[0]), (1, "quite other words stand here today"), (5, " ".join(texts[2][1].split()[:9] + ["not", "in", "it"])), (6, "same line here same line here")]
    return rows, spark.createDataFrame([(i, t, 0, "c") for i, t in rows], "item_id long, text string, doc_id int, h string")


def test_contaminated_against_brute_force(spark, docs, texts, items):
    want = brute.contaminated(texts, items[0], decontaminate.N, decontaminate.THETA)
    assert want
    for limit in (10**6, 0):
        rows = decontaminate.contaminated(docs, items[1], broadcast_rows=limit).drop("sig").collect()
        best = {}
        for r in rows:
            row = (round(r["containment"], 9), -r["window_start"], r["item_size"], r["matched"])
            best[r["doc_id"], r["item_id"]] = max(best.get((r["doc_id"], r["item_id"]), row), row)
        assert {(d, i, v[0], v[3], v[2], -v[1]) for (d, i), v in best.items()} == want
    out = decontaminate.clean(docs, items[1])
    assert out.columns == docs.columns
    alone = {(d, t) for d, t in texts if not brute.contaminated([(d, t)], items[0], decontaminate.N, decontaminate.THETA)}
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == alone


def test_contaminated_documents_of_the_benchmark(spark):
    d, b = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"], round(r["containment"], 9), r["matched"], r["item_size"], r["window_start"]) for r in decontaminate.contaminated(d, b).collect()}
    docs = [(r["doc_id"], r["text"]) for r in d.collect()]
    assert got == brute.contaminated(docs, [(r["item_id"], r["text"]) for r in b.collect()], decontaminate.N, decontaminate.THETA)


@pytest.mark.parametrize("capacity", [16, 64, 2048])
def test_packing_against_brute_force(spark, docs, texts, capacity):
    got = [tuple(r[:4]) + tuple(r[5:]) for r in packing.pack(docs, capacity).collect()]
    want = brute.pack([(i, len((t or "").split())) for i, t in texts], capacity, packing.SEED)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    fill = collections.Counter()
    for r in got:
        fill[r[4]] += r[3]
    assert max(v for k, v in fill.items() if k is not None) <= capacity


def test_packing_by_a_length_column_over_several_packers(spark, docs, texts):
    rows = packing.pack(docs, 64, docs_per_packer=10, units="n_chars").collect()
    assert sum(r["units"] for r in rows) == sum(len(t or "") for _, t in texts)
    assert len({r["packer"] for r in rows}) > 1


def test_near_recall_on_documents_that_share_a_passage(spark):
    """Blocks form from the passage, and true partners stand anywhere in them."""
    rng = random.Random(11)
    some = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, rows, want = some(68), [], set()
    for k in range(1000):
        common = passage + some(66)
        rows += [(2 * k, " ".join(common + some(64))), (2 * k + 1, " ".join(common + some(64)))]
        want.add((2 * k, 2 * k + 1))
    sets = [set(brute.grams(t, near.N)) for _, t in rows]
    assert all(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= near.THRESHOLD for a, b in want)
    got = {(r[0], r[1]) for r in near.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_near_cells_agree_with_listed_pairs(spark, docs):
    listed = sorted(map(tuple, near.near_pairs(docs, few=10**6).collect()))
    assert sorted(map(tuple, near.near_pairs(docs, few=1, block=1).collect())) == listed


def test_all_pairs_of_a_prefix_block_are_linked(spark):
    """Partners are neither neighbours nor heads, by id or below the prefix, of one block of 90 documents and one of 9."""
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for key, first, size in ((1, 0, 90), (2, 100, 9)):
        sigs = rng.integers(0, 256, (size, 96), np.uint8)
        for a, b in ((2, 6), (3, size - 2)):
            sigs[b] = sigs[a]
            want.add((first + a, first + b))
        rows += [(first + k, [key], [k], bytes(sig)) for k, sig in enumerate(sigs)]
    sets = spark.createDataFrame(rows, "id long, keys array<long>, deep array<int>, sig binary")
    assert {tuple(r) for r in near.links(sets, 0.347).collect()} == want
    assert {tuple(r) for r in near.links(sets, 0.347, few=2, block=8).collect()} == want
