"""Toxicity by a weighted finite-state pattern grammar.

Tokens get classes: insult (with a weight), threat, agent, target, negation, speech, quote, boundary, other. Six small transducers read
the classes in step and mark what they see:

* insult: a match begins, or goes on in a run of insults ("stupid idiot" is one match, its further words count half);
* threat: a threatening verb within four tokens after an agent or auxiliary ("I will hurt");
* target before: an insult within five tokens after a pronoun of address; target after: such a pronoun within five tokens after an insult
  or two after a threat (what comes before a threat is who threatens);
* negation: three tokens after a negating word;
* reported speech: from a word of speech or of naming to the clause's end, and between quotation marks.

Their composition (``compose``) is one table over product states. A match's score is its lexical weight times the weight of its
marks; a pronoun after the match raises it later. A clause scores the sum of its matches, ``CLAUSE`` at most for each; a document's score is a
logistic function of log(1 + its clauses' total), never of isolated words.

The insult lexicon has a short fixed list and what is learnt: words and word beginnings of four to six letters whose document
frequencies differ between toxic and clean labelled texts by a likelihood-ratio test. At most about ``SAMPLE`` labelled rows
outside the held-out fold are learnt from (this bounds the learnt terms too), together with ``examples``, clauses made by rule that
show what standing does; every text is scored whole.

Null texts are empty; a text without matches has the score of no matches. Rows that repeat are scored each. Without labels
of both classes, only the examples are learnt from. An empty table gives an empty result.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, labelled_texts, logistic, release, stored

SAMPLE = 12_000
#: Learnt terms: the least documents, log odds and likelihood-ratio statistic.
LEAST, ODDS, EVIDENCE = 4, 2.0, 15.0
BEGINNINGS = (4, 5, 6)
#: Tokens whose class a worker remembers; beyond it, it starts anew. No effect on results.
KNOWN = 150_000
#: The most that a clause counts.
CLAUSE = 4.0

#: The word lists of the grammar.
INSULTS = (
    "idiot idiots moron morons stupid clown scum trash loser losers worthless pathetic disgusting filthy vermin imbecile "
    "idiote imbécile ordure connard dummkopf abschaum idiota imbécil basura"
).split()
THREATS = "kill destroy hurt beat murder burn shoot tuer détruire frapper töten vernichten schlagen matar destruir golpear".split()
TARGETS = "you your yours u tu toi vous votre du dich dir euch ihr tú usted ustedes vosotros".split()
NEGATIONS = "not never no isn't aren't don't ne pas jamais nicht kein keine nie niemals nunca jamás".split()
SPEECH = (
    "said says say wrote quoted quote claimed called word words term means meaning dit écrit cité mot signifie sagte schrieb zitierte "
    "wort bedeutet dijo escribió citó palabra significa"
).split()
AGENTS = "i we i'll we'll will gonna going shall must je nous vais allons ich wir werde werden yo voy vamos".split()

OTHER, INSULT, THREAT, AGENT, TARGET, NEGATION, SAID, QUOTE, BOUNDARY = range(9)
KINDS = 9
QUOTES, ENDS = '"\u201c\u201d\u00ab\u00bb', ".!?;\n"
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n\"\u201c\u201d\u00ab\u00bb]")


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``step[state][class]`` is the next state, ``mark[state][class]`` what it says of the token read there."""

    step: tuple[tuple[int, ...], ...]
    mark: tuple[tuple[int, ...], ...]


def machine(states: int, step: Callable[[int, int], int], mark: Callable[[int, int], bool]) -> Transducer:
    cells = lambda f: tuple(tuple(int(f(s, c)) for c in range(KINDS)) for s in range(states))
    return Transducer(cells(step), cells(mark))


def within(span: int, opens: tuple[int, ...], marked: tuple[int, ...]) -> Transducer:
    """Marks tokens of the classes ``marked`` among the ``span`` tokens after one of ``opens``, up to the clause's end."""
    return machine(span + 1, lambda s, c: span if c in opens else 0 if c == BOUNDARY else max(s - 1, 0), lambda s, c: s > 0 and c in marked)


MATCHES = (INSULT, THREAT)
#: A run of insults: state 1 inside; marks the tokens that go on with it.
RUN = machine(2, lambda s, c: c == INSULT, lambda s, c: s == 1 and c == INSULT)
ARMED = within(4, (AGENT,), (THREAT,))
AIMED = within(5, (TARGET,), (INSULT,))
AIMED_AFTER = machine(6, lambda s, c: 5 if c == INSULT else 2 if c == THREAT else 0 if c == BOUNDARY else max(s - 1, 0), lambda s, c: s > 0 and c == TARGET)
DENIED = within(3, (NEGATION,), MATCHES)
#: State 1 to the clause's end; state 2 to the closing quotation mark.
REPORTED = machine(3, lambda s, c: (0 if s == 2 else 2) if c == QUOTE else s if s == 2 else 0 if c == BOUNDARY else 1 if c == SAID else s, lambda s, c: s > 0 and c in MATCHES)


def compose(*parts: Transducer) -> tuple[list, list]:
    """The product: next states and marks (bits, the first part's lowest) by state and class, of the states that can be reached."""
    start = tuple(0 for _ in parts)
    states, at, steps, marks = [start], {start: 0}, [], []
    for state in states:  # grows while it is read
        row = []
        for c in range(KINDS):
            fresh = tuple(p.step[s][c] for p, s in zip(parts, state))
            if fresh not in at:
                at[fresh] = len(states)
                states.append(fresh)
            row.append(at[fresh])
        steps.append(row)
        marks.append([sum(p.mark[s][c] << i for i, (p, s) in enumerate(zip(parts, state))) for c in range(KINDS)])
    return steps, marks


GRAMMAR = (RUN, ARMED, AIMED, AIMED_AFTER, DENIED, REPORTED)
ON, THREATENS, BEFORE, AFTER, NOT, TOLD = (1 << i for i in range(6))
STEP, MARKS = compose(*GRAMMAR)
#: What a match counts: unaimed and aimed; shares of it when it goes on with a run, is denied, is reported, or threatens without an agent.
UNAIMED, AIMS = 0.55, 1.6
SHARES = {ON: 0.5, NOT: 0.1, TOLD: 0.15}
UNARMED = 0.1


def standing(kind: int, marks: int, aimed: bool) -> float:
    """The weight of a match by its marks."""
    out = UNARMED if kind == THREAT and not marks & THREATENS else 1.0
    for bit, share in SHARES.items():
        out *= share if marks & bit else 1.0
    return out * (AIMS if aimed else UNAIMED if kind == INSULT else UNARMED)


#: By kind and marks: the weight as it is read, and the weight if a pronoun follows.
STANDING = {kind: [(standing(kind, m, bool(m & BEFORE)), standing(kind, m, True)) for m in range(1 << len(GRAMMAR))] for kind in MATCHES}


@dataclass
class ToxicGrammar:
    """words, beginnings: lexical weights, up to 1; slope and offset of the logistic function of log(1 + total)."""

    words: dict
    beginnings: dict
    slope: float = 6.0
    offset: float = -3.0
    known: dict = field(default_factory=dict, repr=False)

    def classify(self, token: str) -> tuple[int, float]:
        if token in ENDS:
            return BOUNDARY, 0.0
        if token in QUOTES:
            return QUOTE, 0.0
        for kind, listed in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (SAID, SPEECH), (AGENT, AGENTS)):
            if token in listed:
                return kind, 0.0
        weight = max([self.words.get(token, 0.0), *(self.beginnings.get(token[:n], 0.0) for n in BEGINNINGS if len(token) >= n)])
        if weight > 0:
            return INSULT, weight
        return (THREAT, 1.0) if token in THREATS else (OTHER, 0.0)

    def clauses(self, text: str) -> list[float]:
        """The scores of the clauses with a match."""
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        hits = []
        for i, t in enumerate(TOKEN.findall(text.lower())):
            c = known.get(t)
            if c is None:
                c = self.classify(t)
                known[t] = c = c if c[0] != OTHER else False
            if c:
                hits.append((i, c))
        if not any(c[0] in MATCHES for _, c in hits):
            return []
        out, clause, state, last, gain = [], 0.0, 0, -1, 0.0
        for i, (kind, weight) in hits:
            for _ in range(min(i - last - 1, 6)):  # after six others, every countdown has run out
                state = STEP[state][OTHER]
            last, marks = i, MARKS[state][kind]
            if kind in MATCHES:
                now, later = STANDING[kind][marks]
                clause += weight * now
                gain = weight * (later - now)
            elif marks & AFTER:  # a pronoun after the latest match
                clause += gain
                gain = 0.0
            elif kind == BOUNDARY and clause:
                out.append(min(clause, CLAUSE))
                clause = 0.0
            state = STEP[state][kind]
        return [*out, min(clause, CLAUSE)] if clause else out

    def feature(self, text: str) -> float:
        return log(1 + sum(self.clauses(text)))

    def scores(self, texts: list[str]) -> list[float]:
        x = np.array([self.feature(t) for t in texts], float)
        return (1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -35, 35)))).tolist()

    def calibrated(self, x: np.ndarray, y: np.ndarray) -> ToxicGrammar:
        """With the logistic function of these features and labels and of the examples, which weigh a tenth of them together."""
        own = examples()
        times = max(1, len(x) // (10 * len(own)))
        x = np.concatenate([x, np.repeat([self.feature(t) for t, _ in own], times)])
        y = np.concatenate([y, np.repeat([float(l) for _, l in own], times)])
        slope, offset = logistic(x[:, None], y, penalty=0.1)
        return ToxicGrammar(self.words, self.beginnings, float(slope), float(offset))

    def __getstate__(self):
        return self.__dict__ | {"known": {}}


def examples() -> list[tuple[str, int]]:
    """(clause, toxic) by rule: an aimed insult or threat is toxic; a denied, reported or unaimed one alone is not."""
    toxic = ["you are an {}", "{} , that is what you are", "shut up you {}"]
    clean = ["you are not an {}", "he said you are an {}", "the word {} means a fool", "a {} was there", "the day was long"]
    out = [(t.format(w), l) for w in INSULTS[:10] for texts, l in ((toxic, 1), (clean, 0)) for t in texts]
    for w in THREATS[:7]:
        out += [(f"i will {w} you", 1), (f"they {w} time", 0), (f"she wrote i will {w} you", 0), (f"i will not {w} you", 0)]
    return out


def terms(text: str) -> set[str]:
    """The distinct words of a text, and their beginnings with a dash."""
    words = {w for w in TOKEN.findall(text.lower()) if w not in ENDS + QUOTES}
    return words | {w[:n] + "-" for w in words for n in BEGINNINGS if len(w) >= n}


def weigh(counts: DataFrame, toxic: int, clean: int) -> tuple[dict, dict]:
    """Lexical weights from (term, toxic, clean) document counts: log odds of the terms that pass the test."""
    if not toxic or not clean:
        return {}, {}
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = (a + b) / (toxic + clean)
    odds = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1))
    part = lambda n, m: F.when(n > 0, n * F.log(n / m)).otherwise(0.0)
    evidence = 2 * (part(a, share * toxic) + part(b, share * clean) + part(toxic - a, toxic - share * toxic) + part(clean - b, clean - share * clean))
    kept = (
        counts.where(a >= LEAST).select("term", odds.alias("odds"), evidence.alias("evidence"))
        .where((F.col("odds") >= ODDS) & (F.col("evidence") >= EVIDENCE))
    )
    found = {r["term"]: min(r["odds"], 6.0) / 6 for r in kept.collect()}
    return {t: w for t, w in found.items() if not t.endswith("-")}, {t[:-1]: w for t, w in found.items() if t.endswith("-")}


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample: int = SAMPLE) -> ToxicGrammar:
    """The lexicon from document counts, then the logistic weights from the features of the same labelled texts."""
    chosen = stored(labelled_texts(docs, labels, column, sample), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def flush() -> pa.RecordBatch:
            keys = list(seen[0].keys() | seen[1].keys())
            out = [pa.array(keys, pa.string()), *(pa.array([seen[c][k] for k in keys], pa.int64()) for c in (1, 0))]
            seen[0].clear(), seen[1].clear()
            return pa.RecordBatch.from_arrays(out, ["term", "toxic", "clean"])

        for batch in batches:
            for label, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                seen[1 if label else 0].update(terms(text))
                if len(seen[0]) + len(seen[1]) > 300_000:
                    yield flush()
        yield flush()

    counts = chosen.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sizes = {r["label"]: r["n"] for r in chosen.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    words, beginnings = weigh(counts, sizes.get(1, 0), sizes.get(0, 0))
    grammar = ToxicGrammar({**words, **dict.fromkeys(INSULTS, 1.0)}, beginnings)
    sent = docs.sparkSession.sparkContext.broadcast(grammar)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([sent.value.feature(t) for t in batch.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x)], ["doc_id", "label", "x"])

    rows = chosen.mapInArrow(measure, "doc_id long, label int, x double").toPandas()
    rows = rows.sort_values(["x", "label"])
    release(chosen)
    return grammar.calibrated(rows["x"].to_numpy(float), (rows["label"] > 0).to_numpy(float))


def keep_clean(docs: DataFrame, grammar: ToxicGrammar, threshold: float) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``."""
    sent = docs.sparkSession.sparkContext.broadcast(grammar)
    return keep_rows(docs, lambda texts: [s < threshold for s in sent.value.scores(texts)])
