"""Secret scans: three base patterns, and character Markov models that tell random strings from ordinary identifiers.

Base spans, leftmost and non-overlapping for each kind, failing matches dropped afterwards:
assign (a key word, ``:`` or ``=``, a value of 8 or more), access (``AKIA`` keys of 16 or more), hex (32 or more digits).
The models add ``random`` spans. Base spans are blanked out of the text; in each run of 20 or more characters of ``[A-Za-z0-9+/_=-]`` that
is left, stretches are sought whose characters are likelier under the model of random strings than under the model of identifiers: the
log-likelihood ratio less ``THRESHOLD`` nats is summed along the run, a stretch begins where the sum was last 0, ends at the sum's peak,
and is closed when the sum falls to 0 or by ``DROP`` nats below the peak. It is a span if it has ``LENGTH`` characters, a digit, a letter
and a peak of ``EVIDENCE`` nats; so a secret is found wherever it is joined to ordinary words. The span reaches on both sides to the next of ``= / _ -`` or
the run's end; spans that meet are one. A run without such a stretch is a span as a whole if its sum is above 0. Both are first-order chains over a 65-character alphabet with add-one smoothing, trained from
labelled samples by ``train``; ``labelled_samples`` makes the default ones.

Every expression runs in the JVM. Offsets count code points, ends are exclusive. Null and empty texts have no spans;
rows that repeat are scanned each; an empty table gives an empty result; only doc_id and text are read. There is no limit on a text's length.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: The patterns of the base kinds, in the order in which they are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # a run is matched whole or not at all, so the length can stand in the pattern
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_"
THRESHOLD, DROP, LENGTH, EVIDENCE = 0.35, 8.0, 20, 8.0

#: Parts of ordinary identifiers, for the default samples.
PARTS = (
    "user name file path data list item index count value key table column row field type class node tree parent child "
    "start end time date year month day hour first last next prev page view model control handler manager service client "
    "server request response error message status state config option param result query filter order group sum total "
    "number string integer float array object buffer stream reader writer input output source target event action button "
    "image width height color font style text label title header footer content section element document window frame "
    "thread process task job queue stack cache store memory disk network socket port host address url http json html test "
    "the and for that with this from have not are was were which their there about would these other into more some than "
    "und der die das nicht mit sich auf den les des une pour que dans par sur est los las una por con para"
).split()


@dataclass(frozen=True)
class MarkovRatio:
    """ln P(next | this, random) - ln P(next | this, identifier), row by row over ``ALPHABET`` and one other symbol."""

    ratios: tuple[float, ...]

    def stretches(self, run: Column, threshold: float = THRESHOLD) -> Column:
        """array<struct<start, end>> of the stretches of ``run`` that look random, from 0, ends exclusive."""
        width = len(ALPHABET) + 1
        table = F.split(F.lit(",".join(f"{x - threshold:.6f}" for x in self.ratios)), ",").cast("array<double>")
        codes = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
        none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
        found = lambda acc: F.when(
            (acc["end"] - acc["start"] >= LENGTH) & (acc["peak"] >= EVIDENCE),
            F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))),
        ).otherwise(acc["out"])

        def step(acc: Column, code: Column) -> Column:
            at = acc["at"]  # the place of this character
            total = acc["total"] + F.when(at == 0, 0.0).otherwise(F.element_at(table, acc["before"] * width + code + 1))
            up, close = total > acc["peak"], (total <= 0) | (total < acc["peak"] - DROP)
            pick = lambda reset, raised, kept: F.when(close, reset).when(up, raised).otherwise(kept)
            return F.struct(
                code.alias("before"),
                F.when(close, 0.0).otherwise(total).alias("total"),
                pick(F.lit(0.0), total, acc["peak"]).alias("peak"),
                F.when(close, at).otherwise(acc["start"]).alias("start"),
                pick(at, at + 1, acc["end"]).alias("end"),
                F.when(close, found(acc)).otherwise(acc["out"]).alias("out"),
                (at + 1).alias("at"),
                (acc["sum"] + total - acc["total"]).alias("sum"),
            )

        zero = F.struct(
            F.lit(0).alias("before"), F.lit(0.0).alias("total"), F.lit(0.0).alias("peak"), F.lit(0).alias("start"), F.lit(0).alias("end"), none.alias("out"), F.lit(0).alias("at"),
            F.lit(0.0).alias("sum"),
        )
        ends = lambda acc: F.struct(found(acc).alias("out"), F.struct(F.lit(0).alias("start"), acc["at"].alias("end")).alias("whole"), (acc["sum"] > 0).alias("above"))
        done = F.transform(F.array(F.aggregate(codes, zero, step, ends)), lambda x: F.when((F.size(x["out"]) == 0) & x["above"], F.array(x["whole"])).otherwise(x["out"]))
        return F.element_at(done, 1)


def labelled_samples(spark: SparkSession, size: int = 6000) -> DataFrame:
    """(token, label): random strings (1) from digests in base 64 and hexadecimal, identifiers (0) from ``PARTS`` joined
    in snake, camel, kebab and path style, a third of them with a short number. ``size`` of each; the same in every run.
    """
    ids = spark.range(size)
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    random = ids.select(
        F.when(F.col("id") % 3 == 0, digest).otherwise(F.translate(F.base64(F.unhex(digest)), "=", "")).alias("token"), F.lit(1).alias("label")
    )
    parts = F.split(F.lit(" ".join(PARTS)), " ")
    pick = lambda k: F.element_at(parts, (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    words = [pick(k) for k in range(4)]
    tail = F.when(F.col("id") % 3 == 0, F.pmod(F.xxhash64(F.col("id"), F.lit(9)), F.lit(1000)).cast("string")).otherwise(F.lit(""))
    joined = (
        F.when(F.col("id") % 5 == 0, F.concat_ws("_", *words))
        .when(F.col("id") % 5 == 1, F.concat(words[0], *[F.initcap(w) for w in words[1:]]))
        .when(F.col("id") % 5 == 2, F.concat_ws("-", *words))
        .when(F.col("id") % 5 == 3, F.concat_ws("/", *words))
        .otherwise(F.upper(F.concat_ws("_", *words[:3])))
    )
    return random.unionByName(ids.select(F.concat(joined, tail).alias("token"), F.lit(0).alias("label")))


def train(samples: DataFrame) -> MarkovRatio:
    """Both chains, from (token, label); what reaches the driver is bounded by the square of the alphabet, twice."""
    width = len(ALPHABET) + 1
    pairs = samples.select("label", F.explode(F.expr("transform(sequence(1, greatest(length(token) - 1, 1)), i -> substring(token, i, 2))")).alias("pair"))
    code = lambda c: F.instr(F.lit(ALPHABET), c)
    coded = pairs.where("length(pair) = 2").select("label", code(F.substring("pair", 1, 1)).alias("a"), code(F.substring("pair", 2, 1)).alias("b"))
    seen = {0: [1.0] * width * width, 1: [1.0] * width * width}
    for r in coded.groupBy("label", "a", "b").agg(F.count("*").alias("n")).collect():
        seen[r["label"]][r["a"] * width + r["b"]] += r["n"]
    ratios = []
    for a in range(width):
        rows = {k: v[a * width : (a + 1) * width] for k, v in seen.items()}
        ratios += [math.log(rows[1][b] / sum(rows[1])) - math.log(rows[0][b] / sum(rows[0])) for b in range(width)]
    return MarkovRatio(tuple(ratios))


def _places(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start, kind, end, found>> of a pattern's matches: the lengths between matches give their offsets."""
    return _offsets(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), kind)


def _offsets(gaps: Column, found: Column, kind: int) -> Column:
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,found:string>>)")
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.element_at(gaps, acc["i"] + 1)
        end = start + F.length(x)
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x.alias("found"))
        return F.struct(end.alias("at"), (acc["i"] + 1).alias("i"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.when(F.size(found) == 0, empty).otherwise(F.aggregate(found, zero, step, lambda acc: acc["out"]))


def with_spans(docs: DataFrame, model: MarkovRatio, threshold: float = THRESHOLD, name: str = "_spans") -> DataFrame:
    """``docs`` with the column ``name``: array<struct<start, kind, end, found>>, by start, then kind as in ``KINDS``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    value = lambda x: F.regexp_extract(x["found"], ASSIGN, 2)
    base, run = fresh(docs, "_base"), fresh(docs, "_run")
    found = docs.withColumn(base, F.array_sort(F.concat(
        F.filter(_places(text, ASSIGN, 0), lambda x: F.length(value(x)) >= 8),
        F.filter(_places(text, ACCESS, 1), lambda x: F.length(x["found"]) >= 16),
        _places(text, HEX, 2),
    )))
    mixed = lambda x: x["found"].rlike("[0-9]") & x["found"].rlike("[A-Za-z]")
    runs = found.withColumn(run, F.filter(_places(blanked(text, F.col(base)), RUN, 3), mixed))

    def parts(x: Column) -> Column:
        span = lambda s: F.struct(
            (x["start"] + s["start"]).alias("start"), F.lit(3).alias("kind"), (x["start"] + s["end"]).alias("end"),
            F.substring(x["found"], s["start"] + 1, s["end"] - s["start"]).alias("found"),
        )
        return F.transform(widened(x["found"], model.stretches(x["found"], threshold)), span)

    random = F.filter(F.flatten(F.transform(F.col(run), parts)), mixed)
    return runs.withColumn(name, F.array_sort(F.concat(F.col(base), random))).drop(run, base)


def widened(run: Column, spans: Column) -> Column:
    """The spans out to the letters, digits and plus signs around them, those that meet joined."""
    around = lambda rest: F.length(F.regexp_extract(rest, "^[A-Za-z0-9+]*", 0))
    wide = F.transform(spans, lambda s: F.struct(
        (s["start"] - around(F.reverse(F.substring(run, F.lit(1), s["start"])))).alias("start"),
        (s["end"] + around(F.substring(run, s["end"] + 1, F.length(run)))).alias("end"),
    ))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def join(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(x["start"] <= last["end"], F.concat(F.slice(out, 1, F.size(out) - 1), F.array(grown))).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(wide, none, join)


def blanked(text: Column, spans: Column) -> Column:
    """``text`` with blanks in place of the spans, so that all offsets stay."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = F.greatest(acc["at"], x["start"])
        end = F.greatest(at, x["end"])
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, at - acc["at"]), F.repeat(F.lit(" "), end - at))
        return F.struct(end.alias("at"), out.alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def join_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def digest(docs: DataFrame, model: MarkovRatio) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every document."""
    found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).drop("text")
    count = lambda k: F.size(F.filter(F.col("_spans"), lambda x: x["kind"] == k)).cast("long")
    base = F.filter(F.col("_spans"), lambda x: x["kind"] < 3)
    return found.select(
        "doc_id",
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(join_spans(base).cast("binary"), 256).alias("base_sha256"),
        join_spans(F.col("_spans")).alias("spans"),
        count(3).alias("n_random"),
    )


def redact(docs: DataFrame, model: MarkovRatio, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark`` (overlapping ones by a single mark); texts without spans, nulls
    too, and all other columns stay as they are."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")

    def step(acc: Column, x: Column) -> Column:
        between = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        out = F.when(x["start"] >= acc["at"], F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    spans = fresh(docs, "_spans")
    done = F.aggregate(F.col(spans), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return with_spans(docs, model, name=spans).withColumn("text", F.when(F.size(spans) > 0, done).otherwise(text)).drop(spans)
