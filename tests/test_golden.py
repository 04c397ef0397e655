"""Small inputs with results worked out by hand."""

import random
from hashlib import md5

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import paths, render, scalars
from tessera.functions import tokens as tok
from tessera.operators import clones, dist, graph, planner, receipts, resolve, shape, topology
from tessera.plans import catalog, checkpoints
from tessera.sources import bindings
from tests.oracle import DATA


def test_static_shape(spark):
    files = spark.createDataFrame([("src/a.rs", 4), ("src/b.rs", 8), ("tests/README.md", 6), ("docs/design.rs", 10), ("vendor/check_test.rs", 12), ("settings.json", 2), ("asset.bin", 1)], "path string, size long")
    r = shape.static_shape(files).first()
    assert (r.tracked_files, r.tracked_bytes, r.source_file_size_median, r.source_file_size_p90, r.largest_source_file_bytes, r.largest_source_file_path, r.max_path_depth) == (7, 43, 4, 8, 8, "src/b.rs", 2)
    assert (r.largest_source_file_share, r.top_decile_source_byte_share) == (pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert (r.test_to_source_bytes, r.documentation_to_source_bytes, r.generated_or_vendor_byte_share) == (0.5, pytest.approx(5 / 6), pytest.approx(12 / 43))
    assert {x.category: x.files for x in shape.category_mix(files).collect()} == {"source": 2, "test": 1, "documentation": 1, "generated_or_vendor": 1, "configuration": 1, "other": 1}


RAW = "commit string, ts long, path string, line_mass long, is_text boolean, is_binary boolean"


def test_rows_of_one_path_in_a_commit_merge(spark):
    raw = spark.createDataFrame([("c", 978397200, "src/mixed.rs", 5, True, False), ("c", 978397200, "src/mixed.rs", 0, False, True)], RAW)
    r = topology.merged(raw).collect()
    assert len(r) == 1 and (r[0].line_mass, r[0].is_text, r[0].is_binary) == (5, True, True)


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "internal", 1) for a, b in pairs], "source long, target long, class string, line int")


@pytest.mark.parametrize("n, pairs, reachable, possible, fraction, cyclic", [(2, [(0, 1), (0, 1)], 1, 2, 0.5, 0), (1, [(0, 0)], 0, 0, None, 1), (2, [(0, 1), (1, 0)], 2, 2, 1.0, 1)])
def test_smallest_graphs(spark, n, pairs, reachable, possible, fraction, cyclic):
    files = spark.range(n).select("id")
    adj = graph.adjacency(graph.grouped_edges(edges(spark, pairs)))
    reach = graph.closure(adj)
    scc = graph.strong_components(files, reach)
    r = graph.propagation(files, reach, scc, adj).first().asDict()
    assert graph.cycles(scc, adj).count() == cyclic
    assert {reachable, possible} <= set(r.values()) and fraction in r.values()


def test_reachability_of_a_cycle_with_a_tail(spark):
    files = spark.range(5).select("id")
    reach = graph.closure(graph.adjacency(graph.grouped_edges(edges(spark, [(0, 1), (1, 0), (1, 2), (2, 3)]))))
    got = {r.id: sorted(v for k, v in r.asDict().items() if k != "id") for r in graph.reachability(files, reach).collect()}
    assert got == {0: [1, 3], 1: [1, 3], 2: [1, 2], 3: [0, 3], 4: [0, 0]}


def test_probes(spark):
    claims = spark.createDataFrame([("c", 0.5, 1.0, 1.0, 1.0)], "id string, prior_probability double, false_positive_loss double, false_negative_loss double, importance double")
    rows = [("perfect", "c", 1.0, 1.0, 2.0, 4.0, "g"), ("coin", "c", 0.5, 0.5, 1.0, 1.0, "h"), ("inverted", "c", 0.0, 0.0, 1.0, 1.0, "i")]
    probes = spark.createDataFrame(rows, "id string, claim_id string, sensitivity double, specificity double, expected_usd double, expected_seconds double, dependence_group string")
    got = {r.id: (r.information_bits, r.risk_reduction, r.decision_flip_probability) for r in planner.probe_metrics(claims, probes).collect()}
    assert got == {"perfect": (1.0, 0.5, 0.5), "coin": (0.0, 0.0, 0.0), "inverted": (1.0, 0.5, 0.5)}
    with pytest.raises(Exception, match="unknown claim"):
        planner.probe_metrics(claims.where("id = 'x'"), probes).collect()


def test_greedy_plan_has_a_probe_for_every_source(spark):
    labelled = spark.read.parquet(f"{DATA}/labels.parquet").join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "source"), "doc_id")
    want = {f"{r.lang}-{r.source[-1]}" for r in labelled.select("lang", "source").distinct().collect()}
    steps = catalog.QUERIES["greedy_plan"](spark, DATA).orderBy("ordinal").collect()
    assert {x for s in steps for x in s.candidate_frontier} <= want
    assert {r.id for r in bindings.probes(spark, DATA).collect()} == want
    assert any(x[-1] in "56789" for s in steps for x in [s.probe_id or "", *s.candidate_frontier])


def test_distributions(spark):
    one = dist.entropy(spark.createDataFrame([(7,)], "w long"), "w").first()
    assert 1.0 in one.asDict().values()  # effective count of a single weight
    d = spark.createDataFrame([(k,) for k in range(1, 21)], "w long")
    assert dist.top_share(d, "w").first()["top_share"] == pytest.approx(39 / 210)
    lat = receipts.latency(spark.createDataFrame([(1, 0, 100), (1, 1, 3), (1, 2, 4)], "run int, ordinal int, elapsed_ns long")).first()
    assert (lat.first_ns, lat.samples, lat.p50_ns, lat.max_ns, lat.mean_ns) == (100, 2, 3, 4, 3)


def test_touching_ranges_merge(spark):
    d = spark.createDataFrame([("f", 1, 5), ("f", 5, 8), ("f", 10, 12), ("g", 0, 1)], "file string, a long, b long")
    assert {r.file: (r.mass, r.islands) for r in clones.union_mass(d, "file", "a", "b").collect()} == {"f": (9, 2), "g": (1, 1)}


def test_clone_runs_are_maximal(spark):
    text = " ".join(f"t{k}" for k in range(30))
    docs = spark.createDataFrame([("a", "x", text + " p"), ("b", "x", "q " + text), ("c", "x", "none of it")], "file string, language string, text string")
    runs = clones.diagonals(clones.kgrams(docs, 10), 10).collect()
    assert [(r.left_file, r.right_file, r.left_start, r.right_start, r.tokens) for r in runs] == [("a", "b", 1, 2, 30)]


def test_clone_runs_between_any_two_files(spark):
    x, y = ([f"{c}{k}" for k in range(20)] for c in "xy")
    rng = random.Random(4)
    texts = {"a": x, "b": y, "c": x + y, "d": x + y, "e": y + y[:15] + x[3:], "f": ["p"] * 9, "g": ["p"] * 7}
    texts |= {f"r{k}": [rng.choice("uv") for _ in range(30)] for k in range(4)}
    want, k = set(), 5
    for f, s in texts.items():
        for h, t in texts.items():
            for i in range(len(s)):
                for j in range(len(t)):
                    if (f, i) < (h, j) and s[i] == t[j] and (not i or not j or s[i - 1] != t[j - 1]):
                        n = 0
                        while i + n < len(s) and j + n < len(t) and s[i + n] == t[j + n]:
                            n += 1
                        if n >= k:
                            want.add((f, h, i + 1, j + 1, n))
    docs = spark.createDataFrame([(f, "x", " ".join(t)) for f, t in texts.items()], "file string, language string, text string")
    runs = clones.diagonals(clones.kgrams(docs, k), k).collect()
    got = [(r.left_file, r.right_file, r.left_start, r.right_start, r.tokens) for r in runs]
    assert ("c", "d", 1, 1, 40) in got and len(got) == len(set(got)) and set(got) == want


def clone_groups(texts, k, min_lines):
    """{(content, places)} by comparing all pairs of places; a token is (word, line)."""
    pairs = []
    for f, s in texts.items():
        for h, t in texts.items():
            for i in range(len(s)):
                for j in range(len(t)):
                    if (f, i) < (h, j) and s[i][0] == t[j][0] and (not i or not j or s[i - 1][0] != t[j - 1][0]):
                        n = 0
                        while i + n < len(s) and j + n < len(t) and s[i + n][0] == t[j + n][0]:
                            n += 1
                        n = min(n, j - i) if f == h else n
                        tall = all(w[at + n - 1][1] - w[at][1] + 1 >= min_lines for w, at in ((s, i), (t, j))) if n else False
                        if n >= k and tall:
                            pairs.append((tuple(w for w, _ in s[i : i + n]), (f, i), (h, j)))
    by = {}
    for content, a, b in pairs:
        by.setdefault(content, set()).update([a, b])
    kept = []
    for content, places in sorted(by.items(), key=lambda x: -len(x[0])):
        n, some = len(content), []
        for f, i in sorted(places):
            if not any(g == f and i < j + n and j < i + n for g, j in some):
                some.append((f, i))
        if len(some) > 1 and not any(len(c) > n and all(any(f == g and j <= i and i + n <= j + len(c) for g, j in o) for f, i in some) for c, o in kept):
            kept.append((content, some))
    return {(len(c), len(o), len({f for f, _ in o}), o[0][0], o[0][1] + 1) for c, o in kept}


@pytest.mark.parametrize("min_lines", [1, 4])
def test_clone_groups_against_all_pairs(spark, min_lines):
    rng = random.Random(5)
    x, y, z = ([f"{c}{k}" for k in range(20)] for c in "xyz")
    words = {"a": x, "b": y, "c": x + y, "d": x + y, "e": y + y[:15] + x[3:], "f": ["p"] * 29, "g": ["p"] * 17, "h": x + z, "i": x + z, "j": z + z[:9] + x, "k": z + z[:9] + x, "l": ["q"] * 14, "m": ["q"] * 14}
    words |= {f"r{k}": [rng.choice("uv") for _ in range(30)] for k in range(3)}
    joined = {f: " ".join(w + ("\n" if k % 5 == 4 else "") for k, w in enumerate(t)) for f, t in words.items()}
    texts = {f: [(w, n) for n, line in enumerate(t.split("\n")) for w in line.split()] for f, t in joined.items()}
    docs = spark.createDataFrame([(f, "x", t) for f, t in joined.items()] + [("void", "x", None), ("blank", "x", " \n")], "file string, language string, text string")
    got = clones.groups(docs, 6, min_lines)
    assert {(r.tokens, r.occurrences, r.files, r.first_file, r.first_start) for r in got.collect()} == clone_groups(texts, 6, min_lines)
    assert [r.tokens * r.occurrences for r in clones.groups(docs, 6, min_lines, 3).collect()] == sorted((r.tokens * r.occurrences for r in got.collect()), reverse=True)[:3]
    assert clones.groups(docs.where("false"), 6).count() == 0


def random_texts(rng):
    """A few texts of one kind: random of few words, near copies, periodic, or joined of common passages."""
    kind, passages = rng.randrange(4), [[f"w{rng.randrange(6)}" for _ in range(rng.randrange(5, 14))] for _ in range(3)]
    if kind == 0:
        texts = [[rng.choice("uv") for _ in range(rng.randrange(10, 40))] for _ in range(5)]
    elif kind == 1:
        base = [f"x{k}" for k in range(40)]
        texts = [[w if rng.random() > 0.06 else rng.choice("uv") for w in base] for _ in range(7)]
    elif kind == 2:
        texts = [(rng.choice(passages)[: rng.randrange(1, 9)] * rng.randrange(2, 12))[rng.randrange(3) :] + ["z"] * rng.randrange(3) for _ in range(5)]
    else:
        texts = [sum((rng.choice(passages) + [f"y{rng.randrange(3)}"] * rng.randrange(2) for _ in range(4)), []) for _ in range(5)]
    return texts + [rng.choice(texts)]


@pytest.mark.parametrize("min_lines", [1, 3])
def test_clone_groups_of_random_texts(spark, min_lines):
    rng, rows, want = random.Random(7), [], set()
    for n in range(40):
        lined = {}
        for k, t in enumerate(random_texts(rng)):
            layout = random.Random(" ".join(t))  # equal token streams have equal lines
            lined[f"{n:02}-{k}"] = [(w, layout.random() < 0.3) for w in t]
        rows += [(f, f"l{n}", "".join(w + ("\n" if e else " ") for w, e in t)) for f, t in lined.items()]
        texts = {f: [(w, 1 + sum(e for _, e in t[:i])) for i, (w, _) in enumerate(t)] for f, t in lined.items()}
        want |= {(f"l{n}", *g) for g in clone_groups(texts, 5, min_lines)}
    docs = spark.createDataFrame(rows, "file string, language string, text string")
    got = clones.groups(docs, 5, min_lines).collect()
    assert {(r.language, r.tokens, r.occurrences, r.files, r.first_file, r.first_start) for r in got} == want


def test_a_passage_of_many_texts_costs_rows_not_pairs(spark, monkeypatch):
    n, passage, most, cut = 300, " ".join(f"w{k}" for k in range(9)), [], clones.cut

    def counted(df):
        out = cut(df)
        most.append(out.count())
        return out

    monkeypatch.setattr(clones, "cut", counted)
    docs = spark.createDataFrame([(f, "x", f"a{f} {passage} b{f}") for f in range(n)], "file long, language string, text string")
    (r,) = clones.groups(docs, 6).collect()
    assert (r.tokens, r.occurrences, r.files, r.first_file, r.first_start) == (9, n, n, 0, 2)
    assert max(most) <= 4 * n


def test_stems_match_in_the_directory_first(spark):
    src = spark.createDataFrame([("d/x.py", "d", "x"), ("e/x.py", "e", "x"), ("e/y.py", "e", "y")], "path string, directory string, stem string")
    tst = spark.createDataFrame([("d/test_x.py", "d", "x"), ("f/test_x.py", "f", "x"), ("f/test_y.py", "f", "y")], "path string, directory string, stem string")
    assert {r.path: r.source_path for r in resolve.match_stems(src, tst).collect()} == {"d/test_x.py": "d/x.py", "f/test_x.py": None, "f/test_y.py": "e/y.py"}


def test_scalars(spark):
    s = F.col("s")
    d = spark.createDataFrame([("a/b.min.js",), (".env",), ("x.tar.gz",), ("Makefile",), ("e.",)], "s string")
    assert [r[0] for r in d.select(paths.extension(s)).collect()] == ["js", None, "gz", None, None]
    one = spark.range(1)
    v = one.select(scalars.pointer_token(F.lit("a~/b")), scalars.ratio(F.lit(1), F.lit(0)), scalars.choose_two(F.lit(5)), scalars.binary_entropy(F.lit(0.5)), scalars.line_count(F.lit("a\nb")), scalars.requirement_name(F.lit("pkg[x]>=1")), scalars.utc_day(F.lit(-1))).first()
    assert tuple(v) == ("a~0~1b", None, 10, 1.0, 2, "pkg", -1)


def test_shared_windows_lose_none(spark):
    """Windows that occur twice pass, also in periodic and long texts; texts are taken in slices, so a batch of any size is hashed in little memory."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(60)) for _ in range(20)]
    texts += ["p " * 41, texts[3] + " x", "y " + texts[4], " ".join(f"w{k}" for k in range(300)), "a b " * 45, None, ""]
    rows = [(n, "x" if n % 2 else "y", t) for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "file long, language string, text string").coalesce(1)
    for k in (6, 7, 40):
        by = {}
        for f, language, t in rows:
            words = (t or "").split(" ")
            words = [w for w in words if w]
            for i in range(len(words) - k + 1):
                by.setdefault((language, " ".join(words[i : i + k])), []).append((f, i + 1))
        want = {(g, md5(w.encode()).hexdigest(), len(x), len({f for f, _ in x}), *min(x)) for (g, w), x in by.items() if len(x) > 1}
        assert {tuple(r) for r in clones.repeated(docs, k).collect()} == want
        places = {(f, p) for x in by.values() if len(x) > 1 for f, p in x}
        got = [(r.file, r.pos) for r in clones.cloned_windows(docs, k).collect()]
        assert len(got) == len(places) and set(got) == places
    words = spark.createDataFrame([(n, "x", " ".join(f"{n}-{k}" for k in range(20_000))) for n in range(30)], "file long, language string, text string")
    assert clones.kgrams(words, 40, clones.shared(words, 40)).count() == 0
    assert max(hi - lo for lo, hi, *_ in tok.slices(pa.array(["x" * 300_000] * 40))) <= 3


def test_durations_round_by_their_exact_value(spark):
    ns = [999, 1000, 1500500, 1501500, 1500501, 2500, 1000500, 1001500, 999999500, 999999499, 9019766096500001, 9028164388500001, 10**9 + 500000, 2**62]
    got = spark.createDataFrame([(x,) for x in ns], "ns long").select("ns", render.duration(F.col("ns")).alias("t")).collect()
    unit = lambda x: ("%.3fs" % (x / 1e9)) if x >= 10**9 else ("%.3fms" % (x / 1e6)) if x >= 10**6 else ("%.3fµs" % (x / 1e3)) if x >= 1000 else f"{x}ns"
    assert {r.ns: r.t for r in got} == {x: unit(x) for x in ns}


def test_partitions_follow_the_rows(spark, monkeypatch):
    """Joins and groups over lines have more partitions where tasks would hold more rows than allowed; a sum over unmerged changes is that over merged ones."""
    monkeypatch.setattr(bindings, "parts", lambda spark, rows: checkpoints.parts(spark, rows, 500))
    raw = bindings.raw_commit_files(spark, DATA)
    assert raw.rdd.getNumPartitions() == topology.merged(raw).rdd.getNumPartitions() == 6000 // 500 + 1
    assert bindings.graph_edges(spark, DATA).rdd.getNumPartitions() == 18_000 // 500 + 1
    by_path = lambda x: {r.path: r.mass for r in topology.hotspots(x).collect()}
    assert by_path(topology.merged(raw)) == by_path(topology.countable(bindings.raw_commit_files(spark, DATA, last="path")))
    assert checkpoints.parts(spark, 5_000_000) == 11 and checkpoints.parts(spark, 10) == 4


def test_depth_and_nodes_of_a_declared_graph(spark):
    declared = spark.createDataFrame([(1, 2, "internal", 1), (1, 2, "internal", 2), (1, 2, "external", 3), (2, 3, "internal", 1), (1, 3, "internal", 1), (3, -7, "external", 1), (1, -7, "external", 1), (4, -9, "unresolved", 1), (3, 5, "internal", 1), (5, 3, "internal", 1)], "source long, target long, class string, line int")
    files = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 6)], "id long")
    got = {tuple(r) for r in graph.nodes(files, declared, 10).collect()}
    f, e, u = graph.KINDS[1:]
    assert got == {(1, f, 0, 3, 0, 2), (2, f, 1, 1, 1, 1), (3, f, 3, 2, 3, 1), (4, f, 0, 1, 0, 0), (5, f, 1, 1, 1, 1), (6, f, 0, 0, 0, 0), (-7, e, 2, 0, None, None), (-9, u, 1, 0, None, None)}
    adj = graph.adjacency(declared)
    scc = graph.strong_components(files, adj, graph.closure(adj))
    assert {tuple(r) for r in graph.condensation_depth(scc, adj).collect()} == {(1, 0), (2, 1), (3, 2), (4, 0), (6, 0)}
