"""URL filters: rules on host and path first, gradient-boosted trees on lexical features for the rest.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the
end. A rule fits its host and all subdomains if the path starts with the rule's; the longest fitting rule wins. URLs that
no rule fits are judged by trees over length, depth, digit ratio, character entropy, parameter counts, hyphens and
suffix and word statistics (log odds of block, learnt with the trees), trained from labelled URLs (``train``); ``labelled_urls`` makes the
default ones, six families of ordinary and six of abusive shapes. Trees run as nested CASE expressions in the JVM.

A null url, or one without ``://``, has an empty host and an empty path and goes to the trees with what lexical features it has.
Repeated rows are judged each; an empty table gives an empty result; only page_id and url are read.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii

#: The most labelled rows that a fit looks at.
SAMPLE = 20_000
#: Words of so many characters at least have statistics; suffixes, domains and words of so many labelled URLs at least.
WORD, OFTEN = 3, 5
FEATURES = ("length", "host_length", "labels", "depth", "digits", "host_digits", "entropy", "parameters", "fragment", "hyphens", "escapes", "suffix", "domain", "words")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):  # the longest is asked first, hence built last
        fits = rule.fits(host, path)
        text, verdict = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def with_lexical(df: DataFrame) -> DataFrame:
    """``df`` (url) with the lexical features but the suffix statistics, and the suffix and domain they are of."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    chars = F.split(url, "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.greatest(F.length(url), F.lit(1))
    entropy = F.aggregate(F.array_distinct(F.filter(chars, lambda x: x != "")), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    host = F.col("host")
    return df.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumns({
        "length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "labels": count(host, r"\."),
        "depth": count(F.col("path"), "/"),
        "digits": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
        "host_digits": count(host, "[0-9]"),
        "entropy": entropy,
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1.0),
        "fragment": F.when(F.instr(url, "#") > 0, 1.0).otherwise(0.0),
        "hyphens": count(host, "-"),
        "escapes": count(url, "[%@]|xn--"),
        "_words": F.array_distinct(F.regexp_extract_all(lower_ascii(F.concat(host, F.lit("/"), F.col("path"))), F.lit(f"[a-z]{{{WORD},}}"), F.lit(0))),
        "_suffix": F.regexp_extract(host, r"([^.]*)\z", 1),
        "_domain": F.regexp_extract(host, r"([^.]*\.[^.]*)\z", 1),
    })


@dataclass(frozen=True)
class UrlModel:
    """suffixes, domains, words: log odds of block; trees: nested (feature, cut, left, right) with leaves of floats."""

    suffixes: dict
    domains: dict
    words: dict
    trees: tuple
    start: float

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``block_score``, the probability of block; ``with_lexical`` comes first."""
        df = df.withColumns({
            "suffix": _look_up(self.suffixes, F.col("_suffix")), "domain": _look_up(self.domains, F.col("_domain")), "words": _sum_of(self.words, F.col("_words"))
        })
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + _column(tree)
        return df.withColumn("block_score", 1 / (1 + F.exp(-total)))


def _look_up(values: dict, key: Column) -> Column:
    if not values:
        return F.lit(0.0)
    pairs = [F.lit(x) for k, v in values.items() for x in (k, float(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(0.0))


def _sum_of(values: dict, keys: Column) -> Column:
    if not values:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])
    return F.aggregate(keys, F.lit(0.0), lambda a, k: a + F.coalesce(F.try_element_at(table, k), F.lit(0.0)))


def _column(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, cut, left, right = tree
    return F.when(F.col(feature) <= F.lit(float(cut)), _column(left)).otherwise(_column(right))


#: Words of the families of ``labelled_urls``.
PLAIN = (
    "news blog shop wiki forum docs help about story photo music garden travel health science sport food city market review bank school library "
    "museum weather radio history cooking hotel train bike books film studio local county press tools project guide manual report index login"
).split()
BAIT = (
    "cheap free best win winner casino pills viagra loan bonus deal hot credit cash prize click adult replica porn sex escort bet poker slots "
    "payload malware crack keygen torrent phish verify suspended giveaway lottery miracle dating xxx jackpot"
).split()
COMMON_SUFFIXES = "com org net edu example.com example.org example.net co.uk de fr es io gov".split()
ODD_SUFFIXES = "xyz top click loan win bid info ru tk example.com example.net com net".split()


def labelled_urls(spark: SparkSession, size: int = 6000) -> DataFrame:
    """(url, label) made by rule, the same in every run, ``size`` of each label; 1 is block. Ordinary families: word pages with a query or
    fragment, manuals, hyphenated hosts, shop pages with parameters, home and login pages, dated articles. Abusive ones: hyphenated bait
    hosts, downloads from bare addresses, long login hosts under odd suffixes, bait run together with digits, bait paths under ordinary
    hosts, encoded hosts with many parameters.
    """
    hashed = lambda k: F.xxhash64(F.col("id"), F.lit(k))
    pick = lambda words, k: F.element_at(F.split(F.lit(" ".join(words)), " "), (F.pmod(hashed(k), F.lit(len(words))) + 1).cast("int"))
    digits = lambda k, below=100_000: F.pmod(hashed(k), F.lit(below)).cast("string")
    hexes = lambda k, n: F.substring(F.sha2(F.concat_ws("-", "id", F.lit(k)), 256), 1, n)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    w, c = (lambda k: pick(PLAIN, k)), pick(COMMON_SUFFIXES, 90)
    b, odd = (lambda k: pick(BAIT, k)), pick(ODD_SUFFIXES, 91)
    front = pick(["https://", "https://www.", "https://blog.", "http://", "http://m.", "http://www."], 92)
    tail = pick(["", ".html", "/", "?page=2&ref=x", "?utm_source=feed", "#top"], 93)
    plain = [
        text(front, w(1), w(2), ".", c, "/", w(3), "/", digits(4), tail),
        text("https://docs.", w(1), ".", c, "/", w(2), "/v", digits(3, 9), "/", w(4), "-", w(5), ".html"),
        text("https://", w(1), "-", w(2), ".", c, "/", w(3), tail),
        text("https://shop.", w(1), ".", c, "/product/", digits(2), "?color=", w(3), "&size=", digits(4, 50)),
        text(front, w(1), w(2), ".", c, pick(["", "/", "/login", "/about", "/contact"], 5)),
        text("https://www.", w(1), ".", c, "/20", (F.pmod(hashed(2), F.lit(15)) + 10).cast("string"), "/", digits(3, 12), "/", w(4), "-", w(5), "-", w(6), "-", w(7)),
    ]
    abuse = [
        text(front, b(1), "-", b(2), pick(["", "-x", "-online", "-24"], 3), ".", odd, "/", w(4), "/", digits(5), tail),
        text("http://", digits(1, 223), ".", digits(2, 255), ".", digits(3, 255), ".", digits(4, 255), "/", w(5), "/", b(6), pick([".exe", ".apk", ".zip", ".php"], 7)),
        text("http://", w(1), ".secure-", w(2), ".account-", hexes(3, 6), ".", odd, "/", hexes(4, 24), "/login?session=", hexes(5, 32)),
        text("http://", b(1), b(2), digits(3, 9999), ".", odd, "/", pick(["", "a/b/c/d/", "go/"], 4), digits(5)),
        text(front, w(1), ".", c, "/", b(2), "-", b(3), pick(["", "/", ".php", "?id=1"], 4)),
        text("http://xn--", hexes(1, 9), ".", odd, "/", b(2), "?id=", digits(3), "&s=", hexes(4, 8), "&aff=", digits(5), "&r=%2F%2F", b(6)),
    ]
    made = lambda families: F.element_at(F.array(*families), (F.pmod(F.col("id"), F.lit(6)) + 1).cast("int"))
    ids = spark.range(size)
    return ids.select(made(plain).alias("url"), F.lit(0).alias("label")).unionByName(ids.select(made(abuse).alias("url"), F.lit(1).alias("label")))


def train(labelled: DataFrame, sample: int = SAMPLE, trees: int = 40, depth: int = 4, rate: float = 0.3, seed: int = 0) -> UrlModel:
    """Statistics and trees from (url, label); at most ``sample`` rows, chosen by hash, reach the driver. The statistics are counted on one
    half of them and the trees grown on the other, so that they learn how far to trust them."""
    draw = F.xxhash64("url", F.lit(seed))
    share = min(1.0, sample / max(labelled.count(), 1))
    chosen = labelled.where("url is not null and label is not null").where(F.pmod(draw, F.lit(1 << 20)) <= int(share * (1 << 20)))
    plain = [f for f in FEATURES if f not in ("suffix", "domain", "words")]
    rows = with_lexical(chosen).select("label", "_suffix", "_domain", "_words", *plain, "url").orderBy(draw, "url", "label").limit(sample).toPandas()
    if rows["label"].nunique() < 2:
        return UrlModel({}, {}, {}, (), float(20 * rows["label"].mean() - 10) if len(rows) else -10.0)
    half = np.arange(len(rows)) % 2 == 0
    if rows["label"][half].nunique() < 2 or rows["label"][~half].nunique() < 2:
        half[:] = True
    base = math.log(rows["label"][half].sum() / (half.sum() - rows["label"][half].sum()))

    def odds(keys) -> dict:
        counts: dict = {}
        for key, label in zip(keys, rows["label"].loc[keys.index]):
            n, m = counts.get(key, (0, 0))
            counts[key] = (n + 1, m + label)
        return {k: math.log((m + 1) / (n - m + 1)) - base for k, (n, m) in counts.items() if n >= OFTEN}

    own = rows[half]
    suffixes, domains, words = (odds(own[c].explode().dropna()) for c in ("_suffix", "_domain", "_words"))
    rows["suffix"], rows["domain"] = rows["_suffix"].map(suffixes).fillna(0.0), rows["_domain"].map(domains).fillna(0.0)
    rows["words"] = [sum(words.get(w, 0.0) for w in ws) for ws in rows["_words"]]
    fit = rows if half.all() else rows[~half]
    start, grown = boost(fit[list(FEATURES)].to_numpy(float), fit["label"].to_numpy(float), FEATURES, trees, depth, rate)
    return UrlModel(suffixes, domains, words, tuple(grown), start)


def boost(x: np.ndarray, y: np.ndarray, names: tuple, trees: int, depth: int, rate: float, bins: int = 32, penalty: float = 1.0) -> tuple[float, list]:
    """Second-order boosting of the logistic loss with histograms over quantile bins."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    start = math.log(y.mean() / (1 - y.mean()))
    margin, grown = np.full(len(y), start), []

    def leaf(own: np.ndarray, g: np.ndarray, h: np.ndarray) -> float:
        value = -rate * g[own].sum() / (h[own].sum() + penalty)
        margin[own] += value
        return float(value)

    def grow(own: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        best, gs, hs = (1e-6, -1, -1), g[own].sum(), h[own].sum()
        for j in range(x.shape[1]) if left else ():
            gl = np.bincount(binned[own, j], g[own], len(cuts[j]) + 1).cumsum()[:-1]
            hl = np.bincount(binned[own, j], h[own], len(cuts[j]) + 1).cumsum()[:-1]
            gain = np.where((hl > 1e-3) & (hs - hl > 1e-3), gl**2 / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty) - gs**2 / (hs + penalty), 0)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), j, int(gain.argmax()))
        if best[1] < 0:
            return leaf(own, g, h)
        _, j, at = best
        low = binned[own, j] <= at
        return (names[j], float(cuts[j][at]), grow(own[low], g, h, left - 1), grow(own[~low], g, h, left - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grown.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth))
    return start, grown


def judge(pages: DataFrame, model: UrlModel, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score of every page."""
    scored = model.score(with_lexical(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "block_score")
