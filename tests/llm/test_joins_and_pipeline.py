import collections
import hashlib

import pytest

import corpus_pipeline
from tests import oracle
from tests.llm import brute
from tessera.llm import decontaminate, fixity, near, packing, quality, registry, sharding, toxicity, urlfilter


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    assert oracle.ours(registry.QUERIES[name], spark) == oracle.duck(registry.ORACLES[name])


PAGES = "page_id long, url string, html string, node string, bytes int, hashes string, __id int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 0) for r in rows], PAGES)


def merkle(rows):
    """{id, or content of one without: (count, hash)} and the sizes, of (id, url, html)."""
    out = collections.defaultdict(list)
    for r in rows:
        h = hashlib.sha256("".join("N" if x is None else f"{len(x.encode())}:{x}" for x in r[1:]).encode()).hexdigest()
        out[r[0] if r[0] is not None else h].append(h)
    return {i: v[0] if len(v) == 1 else "+".join([str(len(v)), *(str(sum(int(h[15 * k : 15 * k + 15], 16) for h in v)) for k in range(4))]) for i, v in out.items()}


def test_fixity_against_brute_force(spark):
    left = [(k, f"u{k}", "é" * (k % 7)) for k in range(300)] + [(None, "n", "n"), (None, "n", "n"), (None, "o", None), (5, "u5", "second"), (5, "u5", "second"), (7, None, ""), (-3, "neg", "x"), (20_000_000, "over", "z"), (999_999_999_999, "far", "y" * 100_000)]
    right = [r for r in left if r[0] not in (10, 290, 20_000_000)] + [(400, "new", "new"), (None, "p", "p")]
    right[3] = (3, "u3", None)
    right.remove((5, "u5", "second"))
    right.remove((None, "n", "n"))
    rows = fixity.audit(pages(spark, left), pages(spark, right), width=4, fanout=3, leaf_bytes=64).collect()
    a, b = merkle(left), merkle(right)
    status = lambda i: "missing" if i not in b else "extra" if i not in a else "changed"
    want = collections.Counter((None if isinstance(i, str) else i, status(i), a.get(i), b.get(i)) for i in {*a, *b} if a.get(i) != b.get(i))
    assert collections.Counter((r["page_id"], r["status"], r["expected"], r["actual"]) for r in rows) == want
    size = lambda r: sum(len((x or "").encode()) for x in r[1:])
    for r in rows:
        i = r["page_id"]
        if i in (None, 400):  # no offset, and no block of the primary
            assert r["offset_start"] is r["offset_end"] is r["leaf_range"] is None
            continue
        start = sum(size(x) for x in left if x[0] is not None and x[0] < i)
        assert (r["offset_start"], r["offset_end"]) == (start, start + sum(size(x) for x in left if x[0] == i))
        block = [x for x in left if x[0] is not None and x[0] < i // 4 * 4]
        assert r["leaf_range"] == sum(size(x) + fixity.HEADER for x in block) // 64


def test_one_root_whatever_the_ids(spark):
    rows = [(-3, "a", "b"), (5, "c", "d"), (64**4 + 7, "e", "f" * 9_000), (2**50, "g", "h"), (None, "i", "j")]
    some = pages(spark, rows)
    each = fixity.ranged(some, some, "page_id", ["url", "html"], 2, 100)
    bad, levels = fixity.descend(each, 2)
    assert bad.count() == 0 and levels[-1].count() == 2 and len(levels) > 3 and levels[-1].select("hash").distinct().count() == 1
    other = fixity.ranged(some, pages(spark, [*rows[:2], (64**4 + 7, "e", "x"), *rows[3:]]), "page_id", ["url", "html"], 2, 100)
    assert fixity.descend(other, 2)[0].count() == 1


def test_fixity_edges(spark):
    some, none = pages(spark, [(1, "a", None), (None, None, None)]), pages(spark, [])
    assert fixity.audit(some, some).count() == fixity.audit(none, none).count() == 0
    assert [r["status"] for r in fixity.audit(some, none).collect()] == ["missing"] * 2
    assert [r["status"] for r in fixity.audit(none, some).collect()] == ["extra"] * 2
    changed = fixity.audit(some, pages(spark, [(1, "a", ""), (None, None, None)])).collect()
    assert [(r["page_id"], r["status"]) for r in changed] == [(1, "changed")]


def test_shards_match_the_mixture(spark, docs, none, texts):
    rows = sharding.interleave(docs, shards=4).collect()
    assert sorted(r["position"] for r in rows) == list(range(1, len(texts) + 1))
    size = collections.Counter(r["source"] for r in rows)
    each = collections.Counter((r["shard"], r["source"]) for r in rows)
    assert all(abs(n - size[s] / 4) <= 2 for (_, s), n in each.items())
    assert [r["position"] for r in sorted(rows, key=lambda r: (r["fraction"], r["source"] is not None, r["source"] or "", r["source_rank"]))] == list(range(1, len(texts) + 1))
    assert sharding.interleave(none).count() == 0
    many = sharding.interleave(docs, shards=10 * len(texts)).collect()
    assert len({r["shard"] for r in many}) == len(texts) and all(0 <= r["shard"] < 10 * len(texts) for r in many)


def test_url_lists_against_brute_force(spark):
    entries = [("a.com", "spam", "add", 10), ("a.com", "spam", "remove", 20), ("a.com", "spam", "add", 30), ("x.a.com", "adult", "add", 15), ("b.org", "spam", "add", 5), ("b.org", "spam", "add", 5), ("b.org", "spam", "remove", 5), ("c.de", None, "add", 1), (None, "spam", "add", 1), ("d.eu", "spam", "add", None), ("A.COM", "malware", "add", 25), ("com", "all", "add", 28), ("e.fr", "spam", "odd", 1)]
    urls = ["http://a.com/x", "https://u:p@X.A.com:80/?q", "http://y.x.a.com", "http://b.org/", "mailto:none", None, "", "http://nota.com", "http://c.de", "http://d.eu", "http://e.fr#f", "http://a.com./x", "http://[::1]:80/x", "http://" + "y." * 2_000 + "a.com"]
    captures = [(k, u, t, "c") for k, (u, t) in enumerate((u, t) for u in urls for t in (None, 0, 5, 10, 15, 20, 27, 29, 30, 99))]
    e = spark.createDataFrame([(*x, 1) for x in entries], "pattern string, list_name string, action string, at int, host int")
    c = spark.createDataFrame([*captures, captures[0]], "page_id long, url string, fetched_at long, pattern string")
    rows = urlfilter.filter_captures(c, e).collect()
    assert len(rows) == len(captures) + 1
    good = {(p.lower(), n, a, t) for p, n, a, t in entries if None not in (p, n, a, t) and a in ("add", "remove")}
    hosts = {0: "a.com", 1: "x.a.com", 2: "y.x.a.com", 3: "b.org", 7: "nota.com", 8: "c.de", 9: "d.eu", 10: "e.fr", 11: "a.com", 12: "[::1]", 13: "y." * 2_000 + "a.com"}
    for r in rows:
        h, t, live = hosts.get(r["page_id"] // 10), r["fetched_at"], []
        for p, n in {(p, n) for p, n, _, _ in good} if h and t is not None else ():
            steps = [(at, a) for q, m, a, at in good if (q, m) == (p, n) and at <= t]
            if steps and max(steps)[1] == "add" and (h == p or h.endswith("." + p)):
                live.append((-len(p), n, p, max(steps)[0]))
        hit = min(live, default=None)
        assert r["host"] == h and r["blocked"] == (hit is not None)
        assert hit is None and r["pattern"] is None or (r["pattern"], r["list_name"], r["valid_from"]) == (hit[2], hit[1], hit[3])
    assert not any(r["blocked"] for r in urlfilter.filter_captures(c, e.limit(0)).collect())
    assert urlfilter.filter_captures(c.limit(0), e).count() == 0


def test_pipeline_against_brute_force(spark):
    d, lab, bench = (spark.read.parquet(f"{oracle.DATA}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    keep = {r["doc_id"] for r in quality.score(d, quality.fit(d, lab)).collect() if r["keep"]}
    rows = [r for r in rows if r[0] in keep]
    grammar = toxicity.fit(d.where(d["doc_id"].isin([r[0] for r in rows])), lab)
    rows = [r for r in rows if brute.toxic(r[1], grammar) < toxicity.THRESHOLD]
    root = brute.groups(brute.near(rows, near.N, near.THRESHOLD))
    rows = [r for r in rows if root.get(r[0], r[0]) == r[0]]
    bad = {x[0] for x in brute.contaminated(rows, [(r["item_id"], r["text"]) for r in bench.collect()], decontaminate.N, decontaminate.THETA)}
    want = brute.pack([(i, len((t or "").split())) for i, t in rows if i not in bad], packing.CAPACITY, packing.SEED)
    got = [tuple(r[:4]) + tuple(r[5:]) for r in corpus_pipeline.run(spark, oracle.DATA).collect()]
    assert 0 < len(got) and sorted(got, key=repr) == sorted(want, key=repr)


def test_pipeline_stages_take_messy_and_empty_tables(spark, docs, none):
    for start in (docs, none):
        at = start
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, at, oracle.DATA)
            assert name == "packing" or after.columns == start.columns
            after.count()
            at = after


def test_pipeline_without_labels_or_benchmark(spark, docs, texts, tmp_path):
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    at, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        kept.append(at.count())
    assert kept[0] == kept[1] == len(texts) > kept[2] == kept[3]
    assert {r["doc_id"] for r in at.collect()} <= {i for i, _ in texts}
