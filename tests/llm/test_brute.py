"""Whole operators against versions without automata, buckets or tables."""
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from schemaloom.llm import decontam, lmscore, packing, quality, toxicity, urls

draw = random.Random(11)
WORDS = ["".join(draw.choice(["the", "an", "er", "on", "sh", "ti", "ou", "bl", "é"]) for _ in range(draw.randrange(1, 4))) for _ in range(120)]
prose = lambda n, seed: " ".join(random.Random(seed).choices(WORDS, k=n))


def tree(texts):
    """rows: the distribution of every context seen often enough, its own or that of its suffix; emit: the share of each byte."""
    counts, used = defaultdict(Counter), np.zeros(256)
    for t in texts:
        data, found = sequence(t)
        for j in range(4, len(found)):
            for d in range(5):
                counts[found[j - d : j]][found[j]] += 1
            if found[j] != lmscore.END:
                used[data[j]] += 1
        for w in t.encode().lower().split():
            inside = (0, *(int(lmscore.SYMBOL[b]) for b in w), 0)
            for j in range(1, len(inside)):
                for d in range(5, min(j, 7) + 1):
                    counts[inside[j - d : j]][inside[j]] += 1
    rows = {(): np.array([counts[()][k] + 0.5 for k in range(64)]) / (sum(counts[()].values()) + 32)}
    for depth in range(1, 8):
        for context in [c for c in counts if len(c) == depth and sum(counts[c].values()) >= lmscore.SUPPORT]:
            seen, above = np.array([counts[context][k] for k in range(64)], float), rows[context[1:]]
            n = seen.sum()
            gain = sum(x * math.log(x / n / q) for x, q in zip(seen, above) if x)
            mass = 2 * (seen > 0).sum()
            rows[context] = (seen + mass * above) / (n + mass) if gain >= lmscore.DIVERGENCE else above
    used += 0.5
    used[lmscore.SYMBOL == 0], used[32] = 1e-9, 1.0
    return rows, np.log10(used / np.bincount(lmscore.SYMBOL, used, 64)[lmscore.SYMBOL])


def sequence(t):
    words = t.encode().lower().split()
    data = b"    " + (b" ".join(words) + b"  " if words else b" ")
    found = [int(lmscore.SYMBOL[b]) for b in data]
    return data, tuple(found[:-1]) + (lmscore.END,)


def test_tree_score(spark):
    texts = [(i, prose(150, i)) for i in range(60)] + [(100, ""), (101, "zz qq 12 !? é"), (102, prose(5, 999))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows, emit = tree([t for i, t in texts if zlib.crc32(str(i).encode()) % 5 != 1])
    assert max(map(len, rows)) >= 5
    got = {r["doc_id"]: r["score"] for r in lmscore.score_documents(df).collect()}
    for i, t in texts:
        data, found = sequence(t)
        total = 0.0
        for j in range(4, len(found)):
            context = next(found[j - d : j] for d in range(min(7, j), -1, -1) if found[j - d : j] in rows)
            total += math.log10(rows[context][found[j]]) + (0.0 if found[j] == lmscore.END else emit[data[j]])
        assert abs(got[i] - total) < 2e-3, i


def test_decontamination_of_all_pairs(spark):
    """Every item in every document by the whole table of edits."""
    items = [(i, prose(draw.choice([4, 6, 9, 15, 25, 40]), 700 + i)) for i in range(30)]
    docs = []
    for i in range(60):
        words = items[i % 30][1].split()
        for _ in range(draw.randrange(0, len(words) // 4 + 1)):
            at, kind = draw.randrange(len(words)), draw.randrange(3)
            words[at : at + (kind != 1)] = [] if kind == 0 else ["x%d" % draw.randrange(99)]
        docs.append((i, prose(20, 800 + i) + " " + " ".join(words) + " " + prose(15, 900 + i)))

    def least(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        return min(row)

    split = {(k, i): decontam.words_of(t) for k, own in (("d", docs), ("i", items)) for i, t in own}
    true = {(d, i): least(split["i", i], split["d", d]) for d, _ in docs for i, _ in items}
    wanted = {k: e for k, e in true.items() if e <= decontam.edits_allowed(len(split["i", k[1]]))}
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontam.contaminated(df, benchmark).collect()}
    assert set(got) <= set(wanted) and len(got) >= 0.95 * len(wanted) > 20 and all(e >= wanted[k] for k, e in got.items())
    assert {k for k, e in wanted.items() if e == 0} <= set(got)


def test_grammar_without_automata():
    """The clauses' scores by looking around each match."""
    g = toxicity.ToxicGrammar(dict.fromkeys(toxicity.INSULTS, 1.0) | {"zorg": 0.5}, {"blub": 0.3})
    pool = ["idiot", "scum", "zorg", "blubber", "kill", "hurt", "you", "your", "not", "never", "said", "word", "i", "will", ".", "\n", '"', "the", "day", "was", "of", "tree", "a", "b", "c"]

    def plain(tokens):
        out, at = [], 0
        told_open = False
        while at < len(tokens):
            end = next((j for j in range(at, len(tokens)) if tokens[j] in toxicity.ENDS), len(tokens))
            total, said, pending = 0.0, False, None
            for j in range(at, end):
                kind, weight = g.classify(tokens[j])
                near = lambda n, what: any(g.classify(x)[0] == what for x in tokens[max(at, j - n) : j])  # noqa: B023,E731
                if kind == toxicity.QUOTE:
                    told_open, said = not told_open, False
                elif kind == toxicity.SAID and not told_open:
                    said = True
                elif kind in toxicity.MATCHES:
                    share = 0.1 if kind == toxicity.THREAT and not near(4, toxicity.AGENT) else 1.0
                    share *= 0.5 if kind == toxicity.INSULT and j > at and g.classify(tokens[j - 1])[0] == toxicity.INSULT else 1.0
                    share *= (0.1 if near(3, toxicity.NEGATION) else 1.0) * (0.15 if said or told_open else 1.0)
                    aimed = kind == toxicity.INSULT and near(5, toxicity.TARGET)
                    total += weight * share * (1.6 if aimed else 0.55 if kind == toxicity.INSULT else 0.1)
                    pending = (j, 5 if kind == toxicity.INSULT else 2, 0.0 if aimed else weight * share * (1.6 - (0.55 if kind == toxicity.INSULT else 0.1)))
                elif kind == toxicity.TARGET and pending and j - pending[0] <= pending[1]:
                    total += pending[2]
                    pending = None
            if total:
                out.append(min(total, toxicity.CLAUSE))
            at = end + 1
        return out

    own = random.Random(3)
    for _ in range(400):
        tokens = own.choices(pool, k=own.randrange(1, 60))
        assert np.allclose(g.clauses(" ".join(tokens)), plain(tokens)), tokens


def test_scores_of_features(spark):
    """The classifier's score from its indicators one by one; every score of the grammar from its clauses."""
    texts = [(i, prose(30, i) + (" !!! $$$ AAA" if i % 3 == 0 else "")) for i in range(90)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i, _ in texts], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    for r in quality.score(df, model).collect():
        places = set(quality.indicators(dict(texts)[r["doc_id"]]).tolist())
        margin = sum(float(model.weights[p]) for p in places) / math.sqrt(len(places)) + model.bias
        assert abs(1 / (1 + math.exp(-(model.slope * margin + model.offset))) - r["score"]) < 1e-4
    g = toxicity.train(df, labels)
    for r in quality.score(df, g, 0.7).collect():
        x = math.log(1 + sum(g.clauses(dict(texts)[r["doc_id"]])))
        assert abs(1 / (1 + math.exp(-(g.slope * x + g.offset))) - r["score"]) < 1e-6


def test_odd_labels(spark):
    """Labels that repeat, conflict or are null, ids that repeat, columns that clash: a model is fitted, and the same in every run."""
    texts = [(i % 40, prose(20, i) + (" $$$ !!" if i % 2 else "")) for i in range(80)] + [(None, "x"), (3, None)]
    labels = [(i, i % 2, i % 2) for i in range(40)] + [(1, 0, 0), (1, None, None), (None, 1, 1), (2, 1, 0)]
    df = spark.createDataFrame([(i, t, "x", 9) for i, t in texts], "doc_id long, text string, label string, grams int")
    marks = spark.createDataFrame([(*r, "t") for r in labels], "doc_id long, quality int, toxic int, text string")
    a, b = (quality.train(df.repartition(n), marks) for n in (1, 5))
    assert np.array_equal(a.weights, b.weights) and a.slope == b.slope
    one, two = (toxicity.train(df.repartition(n), marks) for n in (1, 5))
    assert one.words == two.words and abs(one.slope - two.slope) < 1e-9


def test_packing_of_odd_lengths():
    """Documents of whole sequences, and pieces that only fit by an exchange."""
    lengths = np.array([4096] * 3 + [2048] * 7 + [1] * 10 + [3000, 1096] * 5)
    bins, offsets = packing.best_fit(lengths)
    assert bins.max() + 1 == packing.lower_bound(lengths) and all(offsets[lengths == 4096] == 0)


def test_url_suffixes(spark):
    """Suffix statistics aren't cut at a number of suffixes."""
    rows = [(f"http://w{i}.s{k}/x", k % 2) for k in range(400) for i in range(12)]
    model = urls.train(spark.createDataFrame(rows, "url string, label int"), trees=2)
    assert len(model.suffixes) > 300 and all((v > 0) == (int(s[1:]) % 2 == 1) for s, v in model.suffixes.items())
    assert model.score(urls.with_lexical(spark.createDataFrame([("http://q.s7/x",)], "url string"))).select(F.col("block_score") > 0.5).first()[0]
