"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

Matches of the fixed patterns are the seeds. Every identifier-like word (with a digit or an @) and every
seed is an instance; the words around it induce lexical patterns: the two words before, the word before
with the word after, and the word before. Spark scores the pattern-instance graph for `ROUNDS` rounds: a
pattern by the share of its distinct instances' scores, an instance that is no seed by its best patterns
(noisy or), seeds staying at 1. Patterns of at least `SUPPORT` distinct seeds and a score of `CONFIDENT`
mark what they hold, unseen identifiers included, if their words say something: of all places where a
pattern's words stand, in the texts in which it holds anything, `EXCLUSIVE` of them at least must hold an
instance. So "of" or "the", which stand everywhere, never mark. The graph is tables throughout: nothing of
it is collected or broadcast. All scanning is linear in a text's length.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, whole_text

ROUNDS, SUPPORT, CONFIDENT, DOUBT, EXCLUSIVE = 3, 5, 0.75, 1.0, 0.5
KINDS = ("email", "ip", "card", "phone")
# The patterns of the contract. Mail addresses are anchored at their @ and numbers with dots
# begin at the first of their digits, where the leftmost match must, so that no run is read again and again.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _WORD, _LIKE, _SIGN = re.compile(r"[0-9]"), re.compile(r"[^\W_]+"), re.compile(r"[A-Za-z0-9@._+/-]{4,}"), re.compile(r"[0-9@]")
_HALF = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
CONTEXT = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("held", T.LongType()), T.StructField("seen", T.LongType())])
FOUND = T.StructType([T.StructField("seed", T.BooleanType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("what", T.StringType()), T.StructField("patterns", T.ArrayType(T.StringType()))])


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        total += _HALF[int(c)] if k % 2 else int(c)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, done, p = [], 0, text.find("@")
    while p >= 0:
        a = p
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        if a < p and (m := DOMAIN.match(text, p + 1)):
            found.append((a, m.end()))
            done = m.end()
        p = text.find("@", max(p + 1, done))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern matches by kind as listed, then start; leftmost and non-overlapping within a kind."""
    found = [("email", *s) for s in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def instances(text: str, base: list[tuple[str, int, int]]) -> tuple[list[tuple], list[tuple]]:
    """Seeds and other identifier-like words with the patterns around them; and of each pattern how often it
    holds an instance here and how often its words stand here at all."""
    if not base and "@" not in text and not _DIGIT.search(text):
        return [], []
    covered = sorted((a, b) for _, a, b in base)
    spans = [(True, a, b) for a, b in covered]
    k = 0
    for m in _LIKE.finditer(text):
        a, b = m.span()
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        if _SIGN.search(text, a, b) and not (k < len(covered) and covered[k][0] < b):
            spans.append((False, a, b))
    if not spans:
        return [], []
    starts, ends, words = [], [], []
    for m in _WORD.finditer(text):
        starts.append(m.start()), ends.append(m.end()), words.append(m[0].lower())
    one, two = Counter(words), Counter(zip(words, words[1:], strict=False))
    out, held, seen = [], Counter(), {}
    for seed, a, b in spans:
        i, j = bisect_right(ends, a), bisect_left(starts, b)
        if not i:
            continue
        last, after = words[i - 1], words[j] if j < len(words) else ""
        patterns = {f"3 {last} _ {after}": min(one[last], one[after]) if after else 1, f"1 {last}": one[last]}
        if i > 1:
            patterns[f"2 {words[i - 2]} {last}"] = two[words[i - 2], last]
        out.append((seed, a, b, text[a:b].lower(), list(patterns)))
        held.update(patterns.keys())
        seen.update(patterns)
    return out, [(p, n, max(seen[p], n)) for p, n in held.items()]


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, seeds, score) from edges (pattern, what, seed), one per pattern and instance."""
    scored = cut(edges.withColumn("score", F.col("seed").cast("double")))
    patterns = None
    for r in range(rounds):
        # written, so that the join below deals out both sides itself and Spark can split a hot pattern
        patterns = cut(scored.groupBy("pattern").agg(F.sum(F.col("seed").cast("long")).alias("seeds"), (F.sum("score") / (F.count("*") + F.lit(DOUBT))).alias("confidence")))
        if r < rounds - 1:
            doubt = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999))))
            back = scored.join(patterns.where("seeds > 0"), "pattern").where("NOT seed").groupBy("what").agg((1 - F.exp(doubt)).alias("lifted"))
            scored = cut(scored.drop("score").join(back, "what", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("lifted", F.lit(0.0)))).drop("lifted"))
    return patterns


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key and spans, an array of (kind, start, end) in code points, end exclusive,
    by kind as listed and then start. Kinds are those of the patterns, and `id` for what contexts add.

    Null and empty texts have no spans. Rows that repeat a key each get their own row. Other columns are
    ignored.
    """
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("__row", T.LongType()), T.StructField("__id", kind), T.StructField("base", T.ArrayType(SPAN)), T.StructField("found", T.ArrayType(FOUND)), T.StructField("contexts", T.ArrayType(CONTEXT))])

    def scan(frames):
        for frame in frames:
            base = [base_spans(t) for t in frame["__text"]]
            found = [instances(t, b) for t, b in zip(frame["__text"], base, strict=True)]
            yield pd.DataFrame({"__row": frame["__row"], "__id": frame["__id"], "base": base, "found": [f for f, _ in found], "contexts": [c for _, c in found]})

    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(key).alias("__id"), whole_text(text).alias("__text"))
    scanned = cut(rows.mapInPandas(scan, schema))
    seen = scanned.select("__row", F.explode("found").alias("f")).select("__row", "f.*")
    edges = seen.select(F.explode("patterns").alias("pattern"), "what", "seed").groupBy("pattern", "what").agg(F.max("seed").alias("seed"))
    likely = score_patterns(edges).where((F.col("seeds") >= SUPPORT) & (F.col("confidence") >= CONFIDENT)).select("pattern")
    said = scanned.select(F.explode("contexts").alias("c")).groupBy("c.pattern").agg(F.sum("c.held").alias("held"), F.sum("c.seen").alias("seen")).where(F.col("held") >= EXCLUSIVE * F.col("seen"))
    sure = cut(likely.join(said, "pattern", "left_semi"))  # written, so that a hot context is split in the join below
    added = (
        seen.where("NOT seed").select("__row", "start", "end", F.explode("patterns").alias("pattern")).join(sure, "pattern", "left_semi")
        .groupBy("__row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("more"))
    )
    more = F.transform(F.coalesce("more", F.array().cast("array<struct<start:int,end:int>>")), lambda s: F.struct(F.lit("id").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return scanned.select("__row", "__id", "base").join(added, "__row", "left").select(F.col("__id").alias(key), F.concat("base", more).alias("spans"))
