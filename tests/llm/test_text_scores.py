import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.oracle import DATA
from tessera.llm import ctw, quality, repetition, toxicity

CASES = ["You are an idiot.", "you are not an idiot", "He said you are an idiot", "I will kill you!", "I will kill the process. You may go", "A fine day", "worthless trash; you moron", "no one is stupid\nyou stupid moron", "idiota", "the word idiotically", None, "", "x " * 60_000 + "you idiot"]


def test_clauses_against_transducers_run_side_by_side(spark, frame):
    grammar = toxicity.Grammar({"blarg": 1.5})
    texts = [*CASES, "the blargish man, you blarg!", "never blargs"]
    got = {r["doc_id"]: r for r in toxicity.score(frame(list(enumerate(texts))), grammar).collect()}
    assert [got[k]["score"] for k in range(len(texts))] == [brute.toxic(t, grammar) for t in texts]
    assert [got[k]["toxic"] for k in (0, 1, 3, 4, 5, 10, 11, 12)] == [True, False, True, False, False, False, False, True]
    assert got[0]["score"] > got[2]["score"] > 0


TOXIC = """I will kill you|I'll kill you|We are going to hurt them|He will shoot you|Kill yourself|Go away or I will find and kill you|te voy a matar|te mataré|je vais te tuer|Ich werde dich töten|You're an idiot|You’re an idiot|tu es l'idiot
no, you idiot|gonna destroy you|he is an idiot's friend, you moron|Well, you are scum|I kill you""".replace("\n", "|").split("|")
CIVIL = """I did not kill you|I would never hurt you|He said he will kill you|She wrote that they will shoot him|Antibiotics destroy them|The vaccine can kill people|They destroy them with bleach|Smoking will kill you
You aren't an idiot|You aren’t an idiot|you isn’t an idiot|You are not an idiot|You are never stupid|He called you an idiot|I won't hurt you|no te mataré|I think antibiotics destroy them|Frost must destroy these plants|Don't kill them""".replace("\n", "|").split("|")


def test_sentences_judged_by_hand():
    grammar = toxicity.Grammar({})
    assert [t for t in TOXIC if grammar.document(t)[0] < toxicity.THRESHOLD] == []
    assert [t for t in CIVIL if grammar.document(t)[0] >= toxicity.THRESHOLD] == []
    assert grammar.document("I will kill you")[0] == 5 * grammar.document("I will not kill you")[0] == 2.5 * grammar.document("They said I will kill you")[0] == 2.0


def test_toxicity_on_held_out_labels(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    grammar = toxicity.fit(d, lab.where("doc_id % 2 = 0"))
    held = toxicity.score(d, grammar).withColumnRenamed("toxic", "p").join(lab.where("doc_id % 2 = 1"), "doc_id")
    n = {(r["toxic"], r["p"]): r["count"] for r in held.groupBy("toxic", "p").count().collect()}
    assert n[1, True] / (n[1, True] + n[1, False]) > 0.8 and n[1, True] / (n[1, True] + n[0, True]) > 0.9


def test_toxicity_edges(spark, docs, none, texts):
    lab = spark.createDataFrame([(0, 1, None), (None, 1, 1), (1, None, 0)], "doc_id long, quality int, toxic int")
    g = toxicity.fit(docs, lab)
    assert g.stems == {} and toxicity.score(docs, g).count() == len(texts) and toxicity.score(none, g).count() == 0
    kept = toxicity.accepted(docs, lab)
    assert kept.columns == docs.columns and kept.count() == len(texts)


def test_quality_on_held_out_labels(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(d, lab.where("doc_id % 2 = 0"))
    held = quality.score(d, model).join(lab.where("doc_id % 2 = 1"), "doc_id")
    n = {(r["quality"], r["keep"]): r["count"] for r in held.groupBy("quality", "keep").count().collect()}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.97 and n[0, False] / (n[0, False] + n.get((0, True), 0)) > 0.9
    spread = held.agg(F.abs(F.avg("p_quality") - F.avg("quality"))).first()[0]
    assert spread < 0.1  # calibrated on the whole


def test_quality_against_brute_force(spark, docs, texts):
    lab = spark.createDataFrame([(k, 1) for k in range(8)] + [(71, 0), (72, 0), (40, 0), (41, 0)], "doc_id long, quality int")
    model = quality.fit(docs, lab)
    seen = {}
    for r in quality.score(docs, model).collect():
        seen.setdefault(r["doc_id"], []).append((r["p_quality"], r["keep"]))
    for i in seen:
        want = sorted((brute.quality(t or "", model, quality.THRESHOLD) for j, t in texts if j == i), key=repr)
        for (p, k), (wp, wk) in zip(sorted(seen[i], key=repr), want):
            assert k == wk and (p is wp is None or p == pytest.approx(wp, abs=1e-4)), i


def test_stems_against_brute_force():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(3, 9)))
    toxic = [frozenset([word() for _ in range(6)] + [rng.choice(["blargish", "blargs", "zortly"])]) for _ in range(60)] + [frozenset(["idiot", "blarg"])] * 5
    clean = [frozenset(word() for _ in range(9)) for _ in range(80)]
    assert toxicity.induce(toxic, clean) == brute.stems(toxic, clean)


def test_quality_edges(spark, docs, none, texts):
    lab = spark.createDataFrame([(0, 1), (1, 1), (None, 0), (3, None)], "doc_id long, quality int")
    got = quality.classify(docs, lab).collect()
    assert len(got) == len(texts) and all(r["p_quality"] is None and r["keep"] for r in got)
    both = lab.union(spark.createDataFrame([(71, 0), (72, 0), (2, 1)], lab.schema))
    got = quality.classify(docs, both).collect()
    assert len(got) == len(texts)
    assert all((r["p_quality"] is None) == (not any(not c.isspace() for t in ts for c in t or "")) for r in got if r["doc_id"] not in (None,) for ts in [[t for i, t in texts if i == r["doc_id"]]])
    assert quality.classify(none, both).count() == 0 and quality.accepted(docs, both).columns == docs.columns


def test_repetition_against_brute_force(spark, docs, texts):
    rng = random.Random(1)
    some = [(i, t) for i, t in texts if len(t or "") < 20_000] + [(100 + k, " ".join(rng.choice("aa b ccc É d") for _ in range(k))) for k in range(2, 60)] + [(200, "A b\na B\n\n--\n--\nx"), (201, "éé éé éé  éé")]
    d = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(some)], "doc_id long, text string")
    for r in repetition.measure(d).collect():
        want = brute.coverage(some[r["doc_id"]][1])
        assert {k: round(r[k], 9) for k in want} == {k: round(v, 9) for k, v in want.items()}, some[r["doc_id"]]
        size = len(some[r["doc_id"]][1] or "")
        assert r["keep"] == all(want[k] <= repetition.LIMITS[k] or want[k] <= repetition.SHORT[k] and want[k] * size <= repetition.ALLOWANCE for k in want)


def test_repetition_edges(spark, docs, none, texts):
    rows = repetition.measure(docs).collect()
    assert len(rows) == len(texts) and repetition.measure(none).count() == 0
    keep = {r["doc_id"]: r["keep"] for r in rows}
    assert keep[70] and keep[61] and not keep[71]


@pytest.mark.parametrize("grow,depth", [(0.15, 6), (4, 3)])
def test_context_tree_against_brute_force(spark, grow, depth):
    rng = random.Random(2)
    texts = ["abracadabra", "abracadabra", "äöü ß", "", None, "".join(rng.choice("ab") for _ in range(900)), "\0\0\0", "the cat sat on the mat " * 9]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, deepest = brute.tree_bits(texts, grow=grow)
    assert deepest >= depth
    for limit in (10**6, 0):
        got = {r["doc_id"]: r for r in ctw.context_tree_scores(d, lookup_rows=limit, grow=grow).collect()}
        assert len(got) == len(texts)
        for k, t in enumerate(texts):
            size = len((t or "").encode())
            assert got[k]["n_bytes"] == size
            assert got[k]["bits"] == (pytest.approx(want[k], abs=1e-6) if size else None)
            assert got[k]["bits_per_byte"] == (pytest.approx(want[k] / size, abs=1e-6) if size else None)


def test_contexts_that_are_extended_are_few(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(500)) for _ in range(40)]
    growth, counts = ctw.grown(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), grow=0.5)
    assert len(growth.links) >= 2 and all(len(x) <= 20_000**0.5 / 0.5 for x in growth.links) and len(counts) == len(growth.links) + 1


def test_context_tree_edges(spark, docs, none, texts):
    a, b = (sorted((tuple(r) for r in ctw.context_tree_scores(docs, lookup_rows=n).collect()), key=repr) for n in (10**7, 0))
    assert len(a) == len(b) == len(texts)
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert all(x[2] is y[2] is None if None in (x[2], y[2]) else x[2] == pytest.approx(y[2], rel=1e-9) for x, y in zip(a, b))
    assert ctw.context_tree_scores(none).count() == 0
