"""Every stage of the pipeline, on planted rows, against brute force."""
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from schemaloom.llm import secrets, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _row long, _judged string"
own = random.Random(9)
WORDS = ["".join(own.choice(["ba", "do", "ki", "lu", "men", "sor", "ta"]) for _ in range(own.randrange(2, 5))) for _ in range(300)]
prose = lambda n, seed: " ".join(random.Random(seed).choices(WORDS, k=n))
ITEM = prose(25, 1)
TOXIC = "you are an idiot. you worthless scum, i will kill you"
KEY = "aB3xK9zQ7LmN2pR5tV8wY1cD4fG6hJ0k"
ROWS = [
    (1, prose(60, 2)), (2, prose(60, 2)), (2, prose(60, 2)), (3, prose(60, 2) + " more"), (None, prose(60, 2)), (4, prose(50, 3) + " " + TOXIC), (None, TOXIC + " " + prose(40, 4)),
    (4, prose(45, 5)), (5, prose(30, 6) + " " + ITEM + " " + prose(20, 7)), (None, ITEM), (6, prose(40, 8) + " export/data=" + KEY + " password: hunter2hunter2 end"), (7, None), (8, ""), (8, ""),
    (9, "they said you are not an idiot " + prose(30, 10)),
]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", "s", 1, 5, "x") for i, t in ROWS], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, prose(25, 99))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expect(stage, texts, spark):
    """The texts that a stage gives, by plain loops."""
    if stage == "toxicity":
        grammar = toxicity.ToxicGrammar(dict.fromkeys(toxicity.INSULTS, 1.0), {})
        return [t for t in texts if sum(grammar.clauses(t or "")) < 1]
    if stage == "near_duplicates":
        sets, kept = [shingles(t) for t in texts], []
        group = list(range(len(texts)))
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    group = [group[j] if g == group[i] else g for g in group]
        for g in set(group):
            kept.append(min(i for i in range(len(texts)) if group[i] == g))
        return [texts[i] for i in kept]
    if stage == "decontamination":
        return [t for t in texts if ITEM not in (t or "")]
    out = []
    for t in texts:  # secrets
        t = re.sub(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""", "[secret]", t) if t else t
        out.append(t and re.sub("[A-Za-z0-9+/_=-]*" + KEY, "[secret]", t))
    return out


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        wanted = expect(name, [r["text"] for r in docs.collect()], spark)
        after = corpus_pipeline.stored(stage(spark, docs, sf), name)
        assert after.columns == docs.columns
        got = [r["text"] for r in after.collect()]
        if name == "near_duplicates":  # one of each group, whichever
            assert Counter(frozenset(shingles(t)) for t in got if "more" not in (t or "")) <= Counter(frozenset(shingles(t)) for t in wanted) and len(got) == len(wanted)
        elif name == "secrets":
            assert all((KEY in (t or "")) is False and "hunter2" not in (t or "") for t in got) and sum("[secret]" in (t or "") for t in got) == 1
            assert Counter(t for t in got if "[secret]" not in (t or "")) == Counter(t for t in wanted if "[secret]" not in (t or ""))
        else:
            assert Counter(got) == Counter(wanted), name
        assert {(r["_row"], r["_judged"]) for r in after.collect()} == {(5, "x")}
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert Counter(r["doc_id"] for r in packed) == Counter(r["doc_id"] for r in docs.collect())
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()) == Counter(r["doc_id"] for r in packed)


def test_empty(spark, sf, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_masking_keeps_the_rest(spark):
    model = secrets.train(secrets.labelled_samples(spark, 1500))
    df = spark.createDataFrame([(1, f"a {KEY} b")], "doc_id long, text string")
    assert secrets.redact(df, model).first()["text"] == "a [secret] b"
