"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words map to classes: insult, threat verb, persons (the speaker, the one addressed, others), modal, negation, reporting verb, function word, comma and other.
Five small transducers read the same class string and weight its arcs. Insult carries the lexical weight. Threat needs someone who means it (a
speaker, or another person with a modal, or a verb form that says both), a threat verb and a person it is aimed at, in either order of the last two; an
imperative needs the one addressed. Target strengthens an insult beside a person. Negation and reported speech weaken what follows them, and keep a threat or
insult weakened until its target is met. They are composed into one transducer, and a clause scores the sum of the weights along its path. Only clauses that
hold an insult or threat word are walked, as all others score 0. A document's score is that of its worst clause; it is toxic from :data:`THRESHOLD` on.

Base word lists are fixed; further stems come from at most ``per_class`` labelled documents of each class: word beginnings that explain
toxic documents the lists leave unexplained and that clean ones lack, taken greedily, weighted by their log odds.

Defined cases: null or empty text scores 0; without labels only the base lists count; a clause ends at . ! ? ; : and line ends, at any length;
case is ignored, and a curly apostrophe is a straight one; null ids and repeated rows give a row each; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.llm.tables import filtered, labelled_sample, table

PER_CLASS, THRESHOLD, SUPPORT, FREQUENT, SHORTEST, LONGEST = 2000, 1.0, 3, 20, 4, 12
SCHEMA = "doc_id long, score double, clauses int, toxic boolean"

INSULT = """idiot idiots idiotic stupid moron morons moronic imbecile imbeciles scum scumbag trash worthless pathetic disgusting loser losers clown clowns
dumbass asshole bastard bitch degenerate vermin filth idiota idiotas estúpido estúpida imbécil imbéciles basura asqueroso asquerosa patético patética
payaso escoria inútil idiote idiotes crétin crétins imbécile abruti abrutis ordure minable dégoûtant salaud connard stupide idioten dumm dummkopf
trottel abschaum widerlich erbärmlich wertlos arschloch dreckskerl mistkerl""".split()
THREAT = "kill murder hurt destroy shoot stab strangle beat matar golpear tuer frapper töten umbringen erschlagen erschießen".split()
#: Verb forms of the first person that tell an intent, some with their object.
INTEND = "mataré mataremos golpearé tuerai tuerons frapperai".split()
SPEAKER = "i we yo nosotros nosotras voy vamos je nous ich wir werde".split()
ADDRESSED = "you your yours tú tu usted ustedes vosotros vous du ihr".split()
OBJECT = "yourself yourselves te ti toi dich dir euch".split()
OTHERS = "he she they him her them these those people él ella ellos ellas il ils elle elles er sie".split()
THINGS = "people these those".split()  # persons to insult, but no aim of a threat
MODAL = "will shall gonna going wanna must should 'll vais vas va va werden wird soll sollte muss".split()
NEGATION = "not never nobody nunca jamás ni ne pas jamais nicht nie kein keine keinen niemals".split()
NO = "no non nein".split()
REPORT = "said says wrote writes claimed claims quoted reported called calls dijo dice escribió llamó dit écrit déclara appela sagte sagt schrieb nannte".split()
FUNCTION = "a an the is are was were be been so very really such that and to am do did does would have has had any un una el la los las es son muy tan eres une le les des est es sont très si a à ein eine einen der die das ist bist sind sehr so und zu".split()
OTHER, INS, THR, INT, SPK, YOU, OBJ, THEM, THINGY, MOD, NEG, NOT, REP, FUN, COM = range(15)
PERSONS = (YOU, OBJ, THEM, THINGY)
SYMBOLS = {
    **dict.fromkeys(FUNCTION, FUN), **dict.fromkeys(REPORT, REP), **dict.fromkeys(NEGATION, NEG), **dict.fromkeys(NO, NOT), **dict.fromkeys(MODAL, MOD), **dict.fromkeys(OTHERS, THEM), **dict.fromkeys(THINGS, THINGY),
    **dict.fromkeys(OBJECT, OBJ), **dict.fromkeys(ADDRESSED, YOU), **dict.fromkeys(SPEAKER, SPK), **dict.fromkeys(INTEND, INT), **dict.fromkeys(THREAT, THR), **dict.fromkeys(INSULT, INS), ",": COM,
}
TOKEN = re.compile(r"[^\W\d_]+n't|[^\W\d_]+|'ll\b|,")
STOP = re.compile(r"[.!?;:\n]")


# Each transducer: (state, symbol) -> (state, factor on the lexical weight, weight of its own, factor on all weights of their own).
def insult_fst(state: int, symbol: int):
    return 0, 1.0 if symbol == INS else 0.0, 0.0, 1.0


#: States of the threat transducer. START counts as a person: a verb there is an imperative. AIM: an object was named ahead. MEANT, and MEANING with one other word since:
#: someone means it. MEANT_AIM: and its object was named. DONE, DOING: the verb was said, the object is awaited for two other words. ORDER: an imperative.
START, NONE, PERSON, AIM, MEANT, MEANING, MEANT_AIM, DONE, DOING, ORDER = range(10)


def threat_fst(state: int, symbol: int):
    own = 0.0
    if symbol == INT:  # mataré, te mataré
        own, state = (2.0, NONE) if state in (AIM, MEANT_AIM) else (0.0, DONE)
    elif symbol == THR:
        if state == MEANT_AIM:
            own, state = 2.0, NONE
        else:
            state = DONE if state in (MEANT, MEANING) else ORDER if state == START else NONE
    elif symbol in PERSONS and state in (DONE, DOING) and symbol != THINGY or symbol in (YOU, OBJ) and state == ORDER:
        own, state = 2.0, NONE
    elif symbol == SPK:
        state = MEANT_AIM if state == AIM else MEANT
    elif symbol == MOD:
        state = MEANT if state in (START, PERSON) else state
    elif symbol in PERSONS:
        meant = state in (MEANT, MEANING, MEANT_AIM)
        state = MEANT_AIM if meant and symbol != THINGY else AIM if symbol == OBJ else PERSON
    elif symbol in (OTHER, INS):
        state = {MEANT: MEANING, DONE: DOING, MEANT_AIM: MEANT_AIM}.get(state, NONE)
    return state, 1.0, own, 1.0


def target_fst(state: int, symbol: int):
    """State 1: a person was named, which strengthens an insult; state 2: an insult waits for one."""
    if symbol in PERSONS:
        return 1, 1.0, 0.5 if state == 2 else 0.0, 1.0
    if symbol == INS:
        return (1, 1.5, 0.0, 1.0) if state == 1 else (2, 1.0, 0.0, 1.0)
    return state, 1.0, 0.0, 1.0


def negation_fst(state: int, symbol: int):
    """State 1 holds from a negation on, over function words and persons, to the first word negated; 2: that was an insult or threat, whose target is awaited;
    3: as 1, after a word that is also an answer, which one addressed takes back. A comma ends it."""
    if symbol in (NEG, NOT):
        return (1 if symbol == NEG or state == 1 else 3), 1.0, 0.0, 0.2 if state == 2 else 1.0
    if symbol == INS:
        return (2, 0.2, 0.0, 1.0) if state in (1, 3) else (0, 1.0, 0.0, 1.0)
    if symbol in (THR, INT):
        return 2 if state else 0, 1.0, 0.0, 0.2 if state else 1.0
    if symbol in PERSONS:
        return {1: 1, 3: 0 if symbol == YOU else 1}.get(state, 0), 1.0, 0.0, 0.2 if state == 2 else 1.0
    if symbol == COM or symbol == OTHER and state in (1, 3):
        return 0, 1.0, 0.0, 1.0
    return state, 1.0, 0.0, 1.0


def report_fst(state: int, symbol: int):
    """State 1: within what a reporting verb relates."""
    if symbol == REP:
        return 1, 1.0, 0.0, 1.0
    return state, 0.4 if state else 1.0, 0.0, 0.4 if state else 1.0


PARTS = ((insult_fst, 1), (threat_fst, 10), (target_fst, 3), (negation_fst, 4), (report_fst, 2))


def compose() -> tuple[list[list[int]], list[list[float]], list[list[float]]]:
    """Composition of :data:`PARTS`: next state, factor and own weight by state and symbol. States multiply, and so do factors; weights add up."""
    states = list(product(*(range(n) for _, n in PARTS)))
    number = {s: i for i, s in enumerate(states)}
    go, factor, own = ([[0] * 15 for _ in states] for _ in range(3))
    for i, s in enumerate(states):
        for symbol in range(15):
            steps = [f(q, symbol) for (f, _), q in zip(PARTS, s)]
            go[i][symbol] = number[tuple(t[0] for t in steps)]
            factor[i][symbol] = math.prod(t[1] for t in steps)
            own[i][symbol] = sum(t[2] for t in steps) * math.prod(t[3] for t in steps)
    return go, factor, own


def symbol_of(word: str) -> int:
    return NEG if word.endswith("n't") else SYMBOLS.get(word, OTHER)


GO, FACTOR, OWN = compose()


class Grammar:
    """Lexicon and composed transducer. ``stems``: word beginnings with their weights."""

    def __init__(self, stems: dict[str, float] | None = None):
        self.stems = dict(stems or {})
        self.finder = ahocorasick.Automaton()
        for w in INSULT + THREAT + INTEND:
            self.finder.add_word(w, (len(w), True))
        for w in self.stems:
            if w not in SYMBOLS:
                self.finder.add_word(w, (len(w), False))
        self.finder.make_automaton()

    def weight(self, word: str) -> float:
        """Of an insult; 0 for any other word."""
        if SYMBOLS.get(word) == INS:
            return 1.0
        return max((self.stems[word[:k]] for k in range(SHORTEST, min(len(word), LONGEST) + 1) if word[:k] in self.stems), default=0.0)

    def clause(self, text: str) -> float:
        state, score = 0, 0.0
        for word in TOKEN.findall(text):
            symbol, lexical = symbol_of(word), 0.0
            if symbol in (OTHER, INS):
                lexical = self.weight(word)
                symbol = INS if lexical else symbol
            score += lexical * FACTOR[state][symbol] + OWN[state][symbol]
            state = GO[state][symbol]
        return score

    def document(self, text: str) -> tuple[float, int]:
        """Worst clause score, and the number of clauses that score at all."""
        text, worst, count, done = text.lower().replace("’", "'"), 0.0, 0, -1
        for last, (size, whole) in self.finder.iter(text):
            first = last - size + 1
            if first < done or first and text[first - 1].isalpha() or whole and last + 1 < len(text) and text[last + 1].isalpha():
                continue
            begin = 1 + max(text.rfind(c, max(done, 0), first) for c in ".!?;:\n")
            begin = max(begin, done, 0)
            stop = STOP.search(text, last + 1)
            done = stop.start() if stop else len(text)
            s = self.clause(text[begin:done])
            count += s > 0
            worst = max(worst, s)
        return round(worst, 6), count


class WordSets:
    """The distinct words of some rows of a list column, made row by row each time they are gone through; equal words are one string."""

    def __init__(self, lists: pa.ListArray, rows: np.ndarray):
        coded = lists.flatten().dictionary_encode()
        self.words, self.codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.offs, self.rows = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]), rows

    def __iter__(self):
        for r in self.rows:
            yield frozenset(map(self.words.__getitem__, self.codes[self.offs[r] : self.offs[r + 1]]))


def induce(toxic: Iterable[frozenset[str]], clean: Iterable[frozenset[str]]) -> dict[str, float]:
    """Stems from the distinct words of labelled documents. ``clean`` is gone through twice and never held."""
    known = set(INSULT)
    toxic = [ws for ws in toxic if not ws & known]
    seen: set[str] = set()
    for ws in clean:
        seen |= ws
    where: dict[str, set[int]] = defaultdict(set)
    for i, ws in enumerate(toxic):
        for w in ws - seen:
            for k in range(SHORTEST, min(len(w), LONGEST) + 1):
                where[w[:k]].add(i)
    where = {p: docs for p, docs in where.items() if len(docs) >= SUPPORT}
    wrong: Counter[str] = Counter()
    for ws in clean:
        wrong.update({p for w in ws for k in range(SHORTEST, min(len(w), LONGEST) + 1) if (p := w[:k]) in where})
    left, out = set(range(len(toxic))), {}
    candidates = {p: docs for p, docs in where.items() if wrong[p] <= 0.01 * len(docs) and p not in SYMBOLS}
    while candidates:
        best = max(candidates, key=lambda p: (len(candidates[p] & left), len(p), p))
        if len(candidates[best] & left) < SUPPORT:
            break
        out[best] = round(float(np.clip(np.log2((len(where[best]) + 0.5) / (wrong[best] + 0.5)) / 2, 0, 2)), 6)
        left -= candidates.pop(best)
        candidates = {p: docs for p, docs in candidates.items() if len(docs & left) >= SUPPORT}
    # what often goes with a stem already taken counts too; copies of one document, which share their least word, count once
    least = [min(ws, key=lambda w: zlib.crc32(w.encode()), default="") for ws in toxic]
    apart = {p: len({least[i] for i in docs}) for p, docs in where.items() if not wrong[p] and len(docs) >= FREQUENT and p not in SYMBOLS}
    for p in sorted(apart, key=lambda p: (-apart[p], -len(p), p)):
        if not any(p.startswith(q) or q.startswith(p) for q in out) and apart[p] >= FREQUENT:
            out[max((q for q in apart if q.startswith(p) and apart[q] >= 0.8 * apart[p]), key=lambda q: (len(q), q))] = 1.0
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Grammar:
    sample = labelled_sample(docs, labels, "toxic", per_class)
    found = sample.select("doc_id", "label", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{4,}"), 0)).alias("w")).orderBy("doc_id").toArrow().combine_chunks()
    label = found.column("label").to_numpy()
    lists = found.column("w").combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.string()))
    grammar = Grammar(induce(*(WordSets(lists, np.flatnonzero(label == k)) for k in (1, 0))))
    tk.release()
    return grammar


def judge(stems: dict[str, float], texts) -> list[tuple[float, int]]:
    """Scores and clause counts of a batch of texts."""
    if _held.get("stems") != stems:
        _held.update(stems=stems, grammar=Grammar(stems))
    return [_held["grammar"].document(t.as_py() or "") for t in texts]


_held: dict = {}


def score(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, clauses and toxic of every document."""
    stems = grammar.stems

    def run(batches):
        for batch in batches:
            got = judge(stems, batch.column(1))
            scores = np.array([g[0] for g in got], float)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores), pa.array([g[1] for g in got], pa.int32()), pa.array(scores >= threshold)], names=["doc_id", "score", "clauses", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    stems = fit(docs, labels, per_class).stems
    return filtered(docs, lambda texts: pa.array([g[0] < threshold for g in judge(stems, texts)], pa.bool_()))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
