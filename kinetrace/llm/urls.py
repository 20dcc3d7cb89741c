"""URL filters: rules first, else host word segmentation and multinomial naive Bayes.

Rules name a host and a path prefix; a rule fits its host and all subdomains, and the longest that fits decides. URLs without a
rule are judged by naive Bayes over tokens: host labels split into words by a unigram model and Viterbi's algorithm, and the
path's tokens. The word model is fitted by hard expectation-maximisation on all distinct host labels, in Spark; its vocabulary is the
parts that occur in most labels and the most frequent whole labels, at most ``VOCABULARY`` of each: those above a frequency that a
histogram gives, so no task sends more than that to the driver. Words of more than ``LONGEST`` letters aren't looked for; longer names are split.
Naive Bayes is fitted on about ``ROWS`` URLs that a rule decides, each taken if its hash falls below their share. These bound what is
collected and the broadcast model, whatever the table's size.

Null URLs and those without ``://`` have an empty host and path and are judged by the classes' shares. A tie, or no labelled URL
at all, is ``allow``. Repeated URLs are judged alike. Extra columns don't matter; only ``url`` is read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow

VOCABULARY, ROWS, LONGEST, ROUNDS = 100_000, 20_000, 24, 8
#: Share of the most frequent label's hosts from which a label is a word by itself.
COMMON = 0.2
TOKEN = re.compile(r"[^\W_]+")
#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: str = "url") -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_of(rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict, from the columns host and path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first, so it comes last here
        fits = ((F.col("host") == h) | F.endswith("host", F.lit(f".{h}"))) & F.startswith("path", F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


@dataclass
class Words:
    """A unigram model: costs of words, and Viterbi's split under them. A letter outside the model costs ``unknown``."""

    costs: dict[str, float]
    unknown: float
    known: dict[str, list[str]] = field(default_factory=dict)

    def split(self, name: str) -> list[str]:
        if name in self.known:
            return self.known[name]
        best, back = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
        for j in range(1, len(name) + 1):
            for i in range(max(0, j - LONGEST), j):
                cost = self.costs.get(name[i:j], self.unknown * (j - i))
                if best[i] + cost < best[j] - 1e-12:
                    best[j], back[j] = best[i] + cost, i
        out, j = [], len(name)
        while j:
            out.append(name[back[j] : j])
            j = back[j]
        if len(self.known) > 50_000:
            self.known.clear()
        self.known[name] = out[::-1]
        return self.known[name]


def fit_words(labels: dict[str, int], rounds: int = ROUNDS) -> Words:
    """From host labels and the number of hosts that have them. Parts compete; each round counts the words of the best splits.

    A part must occur in two labels or more, so that a name isn't its own evidence; a label that a good share of hosts has is a
    word by itself. Labels count once each otherwise.
    """
    often = COMMON * max(labels.values(), default=0)
    weight = {x: n if n >= max(often, 2) else 1 for x, n in labels.items()}
    seen: Counter[str] = Counter()
    for x in labels:
        seen.update(_within(x))
    counts = {w: n for w, n in seen.items() if n >= 2} | {x: n for x, n in weight.items() if n > 1 and len(x) <= LONGEST}
    for _ in range(rounds):
        model, new = _costs(counts), Counter()
        for x, n in weight.items():
            for w in model.split(x):
                new[w] += n
        new = Counter({w: n for w, n in new.items() if w in counts})
        if dict(new) == counts:
            break
        counts = dict(new)
    return _costs(counts)


def _within(x: str) -> set[str]:
    return {x[i:j] for i in range(len(x)) for j in range(i + 1, min(len(x), i + LONGEST) + 1)}


def learn_words(labels: DataFrame, rounds: int = ROUNDS) -> Words:
    """:func:`fit_words` over a table (label, count) of any size. Only words of the vocabulary and their counts reach the driver."""
    scratch = Scratch(labels.sparkSession, "urls")
    labels = scratch.write(labels, "labels")
    often = COMMON * (labels.agg(F.max("count")).first()[0] or 0)
    weights = labels.select("label", F.when(F.col("count") >= max(often, 2), F.col("count")).otherwise(F.lit(1)).alias("n"))
    parts_of, sums_of = "word string", "word string, n bigint"
    part, total = arrow(parts_of), arrow(sums_of)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("label").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_within(x), pa.string())], schema=part)

    whole = weights.where((F.col("n") > 1) & (F.length("label") <= LONGEST)).select(F.col("label").alias("word"), F.col("n").alias("count"))
    seen = scratch.write(weights.mapInArrow(cut, parts_of).groupBy("word").count().where("count >= 2"), "parts")
    counts = _frequent(seen) | _frequent(whole)
    for _ in range(rounds):
        shipped = labels.sparkSession.sparkContext.broadcast(_costs(counts))

        def split(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            model = shipped.value
            for batch in batches:
                new: Counter[str] = Counter()
                for x, n in zip(batch.column("label").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    for w in model.split(x):
                        if w in model.costs:
                            new[w] += n
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.string()), pa.array(list(new.values()), pa.int64())], schema=total)

        new = {r[0]: r[1] for r in weights.mapInArrow(split, sums_of).groupBy("word").agg(F.sum("n")).collect()}
        shipped.destroy()
        if new == counts:
            break
        counts = new
    return _costs(counts)


def _frequent(words: DataFrame, most: int = VOCABULARY) -> dict[str, int]:
    """Words with their counts, from a table (word, count): all if there are at most ``most``, else those in the upper steps of a histogram by
    the logarithm of counts."""
    step = F.floor(F.log2("count") * 16)
    steps = sorted(words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)  # 16 rows for each doubling
    least, total = None, 0
    for r in steps:
        total += r["n"]
        if total > most:
            break
        least = r["step"]
    return {} if least is None else {r["word"]: r["count"] for r in words.where(step >= least).collect()}


def _costs(counts: dict[str, int]) -> Words:
    """A word costs its share's logarithm, and its letters in the lexicon, shared among its uses, so rare long ones don't win by themselves."""
    total = sum(counts.values()) or 1
    return Words({w: math.log(total / n) + 3.0 * len(w) / n for w, n in counts.items()}, math.log(total + 1) + 3.0)


@dataclass
class Bayes:
    words: Words
    prior: float
    weights: dict[str, float]  # log of P(token | block) / P(token | allow)

    def tokens(self, host: str, path: str) -> list[str]:
        return [w for label in TOKEN.findall(host) for w in self.words.split(label)] + ["/" + t for t in TOKEN.findall(path.lower())]

    def score(self, host: str, path: str) -> float:
        return self.prior + sum(self.weights.get(t, 0.0) for t in self.tokens(host, path))


def fit_bayes(rows: list[tuple[str, str, str]], words: Words) -> Bayes:
    """From (host, path, verdict). Laplace's smoothing; a token not seen says nothing."""
    model, n = Bayes(words, 0.0, {}), Counter(v for _, _, v in rows)
    if not rows:
        return model
    counts = {"allow": Counter(), "block": Counter()}
    for h, p, v in rows:
        counts[v].update(model.tokens(h, p))
    seen = set(counts["allow"]) | set(counts["block"])
    a, b = (sum(counts[v].values()) + len(seen) for v in ("allow", "block"))
    model.weights = {t: math.log((counts["block"][t] + 1) / b) - math.log((counts["allow"][t] + 1) / a) for t in seen}
    model.prior = math.log((n["block"] + 1) / (n["allow"] + 1))
    return model


def parsed(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, decided (the rule's verdict)."""
    rule, verdict = rule_of(rules)
    return pages.select("page_id", host_of().alias("host"), path_of().alias("path")).select("*", rule.alias("rule"), verdict.alias("decided"))


def train(urls: DataFrame) -> Bayes:
    """``urls`` as of :func:`parsed`. Labels count over all distinct hosts; naive Bayes takes a share of the rows by their hashes."""
    hosts = urls.where("host <> ''").select("host").distinct()
    labels = hosts.select(F.explode(F.split("host", r"[^\p{L}\p{N}]+")).alias("label")).where("label <> ''").groupBy("label").count()
    rows = urls.where("decided is not null")
    share = min(1.0, ROWS / max(1, rows.count()))
    taken = F.abs(F.xxhash64("page_id", "host", "path") / F.lit(2.0**63)) < share if share < 1 else F.lit(True)
    picked = rows.where(taken).select("host", "path", "decided").collect()  # about ROWS
    return fit_bayes(sorted(map(tuple, picked)), learn_words(labels))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of block by naive Bayes), words (of the host, joined by blanks)."""
    urls = parsed(pages, rules)
    shipped = pages.sparkSession.sparkContext.broadcast(train(urls))  # bounded by VOCABULARY and ROWS
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string, score double, words string"
    shape = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, model = shape, shipped.value
        for batch in batches:
            hosts, paths, decided = (batch.column(c).to_pylist() for c in ("host", "path", "decided"))
            scores = [model.score(h, p) for h, p in zip(hosts, paths, strict=True)]
            verdicts = [d or ("block" if s > 0 else "allow") for d, s in zip(decided, scores, strict=True)]
            words = [" ".join(w for label in TOKEN.findall(h) for w in model.words.split(label)) for h in hosts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64()), pa.array(words, pa.string())], schema=to)

    return urls.mapInArrow(run, schema)
