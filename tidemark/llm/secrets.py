"""Secret scans: fixed patterns, and a linear-chain conditional random field beside them.

The field tags white-space tokens as secret begin (B), inside (I) or outside (O). Its features are the
token's shape, how often its kind of character changes, its first bytes, itself and its neighbours as
hashed words, the neighbours' shapes, and features of the file the token stands in. It is trained here on
three bounded sets of windows of tokens: windows around the patterns' matches (`MATCHED`), windows without
any (`CLEAN`), both from a bounded sample of documents with and of documents without a match (`SAMPLE` of
each), and windows built by rule (`BUILT`): corpus windows with a secret put in under a name or a form that
the patterns don't know, or with something alike that is none. So the field reaches beyond what taught it.
Word features are dropped at random in training, so that shapes count too. Decoding is Viterbi over the
whole text. A token whose lead for O exceeds anything the transitions could give back is O on the best path
whatever its neighbours are, so the chain falls apart there and only the stretches between are searched,
with the same result.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, cut, whole_text
from .tokens import span_hashes, texts_of, word_spans

SAMPLE, MATCHED, CLEAN, BUILT, PER_DOC, REACH, ROUNDS = 2048, 1500, 2500, 3000, 8, 6, 50
KINDS = ("assign", "access", "hex")
# The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
NAMES = ("passw", "secret", "token", "api")
#: What a text with a match has at least, for Spark's own regular expressions.
HINT = r"(?i:passw|secret|token|api_?key)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

# feature blocks: shape, changes, first bytes, the word, the word before, the one before that, the word after, shape before, shape after, file
_SIZES = (1024, 64, 1024, 4096, 4096, 4096, 4096, 1024, 1024, 16)
_STARTS = np.concatenate([[0], np.cumsum(_SIZES)]).astype(np.int64)
_WORDY = (2, 3, 4, 5, 6)
# What secrets are called, here also by names that the patterns don't have, and how keys of services begin.
CALLED = "credential credentials pwd pass passphrase password passwd secret client_secret token auth_token access_token refresh_token bearer authorization api_key apikey api-key private_key access_key secret_key session_key signing_key master_key key login_key auth".split()
PREFIXES = "ghp_ gho_ glpat- xoxb- xoxp- sk_live_ sk_test_ pk_live_ rk_live_ AIza ya29. SG. npm_ dop_v1_ hf_ shpat_ key- AKIA ASIA".split()
PLAIN_NAMES = "name title status order date version number id colour size total page user host mail phone file path city code".split()
_CLASS = np.full(256, 3, np.int64)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 0, 1, 2
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "+/_=-."]] = True
_TRIM = "\"'`,;:()[]{}<>#$%&*!?|."


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern matches, by start and then kind as listed; leftmost and non-overlapping within a kind."""
    found = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and feature numbers (a row per token) of a block's tokens, and the texts' bounds."""
    starts, ends = word_spans(data, bounds)
    at = np.searchsorted(starts, bounds)
    if not len(starts):
        return starts, ends, np.zeros((0, len(_SIZES)), np.int64), at
    length = ends - starts
    kind = _CLASS[data]
    sums = [np.concatenate([[0], np.cumsum(x, dtype=np.int32)]) for x in (kind == 0, kind == 1, kind == 2, _MARK[data])]
    digit, upper, lower, mark = (s[ends] - s[starts] for s in sums)
    share = np.minimum(digit * 4 // length, 3)
    size = np.searchsorted([3, 6, 10, 16, 20, 32, 41], length, "right")
    other = length - digit - upper - lower - mark
    turns = np.concatenate([[0], np.cumsum(kind[1:] != kind[:-1], dtype=np.int32)])
    changes = np.searchsorted([1, 2, 4, 6, 9, 14, 20], turns[ends - 1] - turns[starts], "right") + 8 * np.searchsorted([3, 6, 10, 16, 20, 32, 41], length, "right")
    shape = size + 8 * (share + 4 * ((digit > 0) + 2 * ((upper > 1) + 2 * ((lower > 0) + 2 * ((mark > 0) + 2 * np.minimum(other, 1))))))
    hashes = span_hashes(data, starts, ends, (4,))
    word, head = (hashes[0] >> np.uint64(52)).astype(np.int64), (hashes[1] >> np.uint64(54)).astype(np.int64)
    first, last = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    first[at[:-1][at[:-1] < at[1:]]], last[at[1:][at[:-1] < at[1:]] - 1] = True, True
    before = lambda x, edge: np.where(first, edge, np.concatenate([[0], x[:-1]]))
    after = lambda x, edge: np.where(last, edge, np.concatenate([x[1:], [0]]))
    span = np.maximum(np.diff(bounds), 1)
    digits, symbols = (np.diff(s[bounds]) for s in (sums[0], np.concatenate([[0], np.cumsum(kind == 3, dtype=np.int32)])))
    count = np.diff(at)
    file = (digits * 33 > span) + 2 * (count < 100) + 4 * (symbols * 4 > span) + 8 * (np.diff(sums[3][bounds]) * 25 > span)
    last_word = before(word, 0)
    columns = (shape, changes, head, word, last_word, before(last_word, 0), after(word, 0), before(shape, 0), after(shape, 0), np.repeat(file, count))
    return starts, ends, np.stack([c + s for c, s in zip(columns, _STARTS, strict=False)], 1), at


def _leads(raw: bytes) -> np.ndarray:
    """The byte at which each code point begins, and the end."""
    data = np.frombuffer(raw, np.uint8)
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def _tags(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tags of a text's tokens by the patterns: 0 outside, 1 begin, 2 inside. Of an assignment, its value."""
    tags = np.zeros(len(starts), np.int8)
    whole = raw.decode("utf-8", "replace")
    base = base_spans(whole)
    if base:
        lead = _leads(raw)
        for a, b in [(m.start(2), m.end(2)) for m in ASSIGN.finditer(whole) if len(m[2]) >= 8] + [s[1:] for s in base if s[0] != "assign"]:
            i, j = int(np.searchsorted(ends, lead[a], "right")), int(np.searchsorted(starts, lead[b], "left"))
            tags[i:j] = 2
            if i < j:
                tags[i] = 1
    return tags


class Field:
    """Weights of a linear-chain conditional random field over B, I and O."""

    def __init__(self):
        self.w = np.zeros((int(_STARTS[-1]), 3))
        self.t = np.zeros((3, 3))

    def fit(self, rows: list[np.ndarray], tags: list[np.ndarray], rounds: int = ROUNDS, seed: int = 5) -> Field:
        """Full-batch AdaGrad on the conditional likelihood of windows of tokens, with a little decay."""
        rng = np.random.default_rng(seed)
        width, many = max(map(len, rows)), len(rows)
        at = np.zeros((many, width, len(_SIZES)), np.int64)
        y, real = np.zeros((many, width), np.int64), np.zeros((many, width), bool)
        for k, (r, t) in enumerate(zip(rows, tags, strict=True)):
            at[k, : len(r)], y[k, : len(r)], real[k, : len(r)] = r, t, True
        gw, gt = np.full_like(self.w, 1e-2), np.full_like(self.t, 1e-2)
        both = real[:, 1:] & real[:, :-1]
        for _ in range(rounds):
            on = np.ones(at.shape, bool)
            for k in _WORDY:
                on[..., k] = rng.random(at.shape[:2]) < 0.6
            score = (self.w[at] * on[..., None]).sum(2)
            a, b = np.zeros(score.shape), np.zeros(score.shape)
            a[:, 0] = score[:, 0]
            for i in range(1, width):
                step = _log_sum(a[:, i - 1, :, None] + self.t, 1) + score[:, i]
                a[:, i] = np.where(real[:, i, None], step, a[:, i - 1])
            for i in range(width - 2, -1, -1):
                step = _log_sum(self.t + (score[:, i + 1] + b[:, i + 1])[:, None, :], 2)
                b[:, i] = np.where(real[:, i + 1, None], step, 0)
            total = _log_sum(a[:, -1], 1)
            p = np.exp(np.minimum(a + b - total[:, None, None], 0)) * real[..., None]
            p /= np.maximum(p.sum(2, keepdims=True), 1e-12)
            pair = np.exp(a[:, :-1, :, None] + self.t + (score + b)[:, 1:, None, :] - total[:, None, None, None]) * both[..., None, None]
            off = (np.eye(3)[y] * real[..., None] - p) * np.where(y > 0, 2.0, 1.0)[..., None]
            dw = np.stack([np.bincount(at.ravel(), (off[..., None, c] * on).ravel(), len(self.w)) for c in range(3)], 1) - 0.02 * self.w
            dt = np.zeros((3, 3))
            np.add.at(dt, (y[:, :-1][both], y[:, 1:][both]), 1)
            dt += -pair.sum((0, 1)) - 0.02 * self.t
            gw, gt = gw + dw**2, gt + dt**2
            self.w += 0.3 * dw / np.sqrt(gw)
            self.t = np.clip(self.t + 0.3 * dt / np.sqrt(gt), -4, 4)
        return self

    def spans(self, rows: np.ndarray) -> list[tuple[int, int]]:
        """Token spans [i, j) of the secrets on the best path through one text."""
        if not len(rows):
            return []
        score = self.w[rows].sum(1)
        back = max(self.t[p, x] + self.t[x, n] - self.t[p, 0] - self.t[0, n] for x in (1, 2) for p in range(3) for n in range(3))
        open_at = np.flatnonzero(score[:, 0] - score[:, 1:].max(1) <= max(back, 0))
        found = []
        for run in np.split(open_at, np.flatnonzero(np.diff(open_at) > 1) + 1) if len(open_at) else []:
            tags = self._viterbi(score[run], run[0] > 0, run[-1] < len(rows) - 1)
            for k, tag in zip(run.tolist(), tags, strict=True):
                if tag == 2 and found and found[-1][1] == k:
                    found[-1][1] = k + 1
                elif tag:
                    found.append([k, k + 1])
        return [(a, b) for a, b in found]

    def _viterbi(self, score: np.ndarray, opened: bool, closed: bool) -> list[int]:
        best, back = score[0] + (self.t[0] if opened else 0), []
        for s in score[1:]:
            step = best[:, None] + self.t
            back.append(step.argmax(0))
            best = step.max(0) + s
        tag = int((best + (self.t[:, 0] if closed else 0)).argmax())
        tags = [tag]
        for b in reversed(back):
            tags.append(tag := int(b[tag]))
        return tags[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def _unsure(rows: np.ndarray) -> np.ndarray:
    """Tokens that may be secrets without a match: ten signs or more, letters and digits, changing often. A
    window that has one teaches nothing about what isn't a secret, unless it is an address."""
    shape, changes = rows[:, 0], rows[:, 1] - _STARTS[1]
    letters = (shape // 64 % 2 + shape // 128 % 2) > 0
    return (changes % 8 >= 4) & (shape % 8 >= 3) & (shape // 32 % 2 > 0) & letters


def _value(rng: random.Random, long: bool = False) -> str:
    """A made-up secret."""
    pick = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    digits, low, up = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    n = rng.randint(20, 48) if long else rng.randint(10, 44)
    form = rng.randrange(6)
    if form == 0:
        return pick("0123456789abcdef", max(n, 16))
    if form == 1:
        return rng.choice(PREFIXES) + pick(digits + low + up, max(n, 16))
    if form == 2:
        return pick(digits + low + up + "+/", n) + "=" * rng.randrange(3)
    if form == 3:
        return pick(digits + up, max(n, 16))
    if form == 4 and not long:
        return pick(low, 3) + pick(digits + low + up + "-_.!", n - 3)
    return pick(digits + low + up, n)


def _harmless(rng: random.Random, words: list[str]) -> str:
    """Something that stands where a secret could and is none."""
    n = lambda a, b: rng.randint(a, b)
    word = rng.choice(words) if words else "none"
    return (
        lambda: word, lambda: word.capitalize(), lambda: f"{word}-{rng.choice(words) if words else 'x'}", lambda: str(n(0, 10**n(1, 18))), lambda: f"{n(1900, 2099)}-{n(1, 12):02}-{n(1, 28):02}",
        lambda: f"{n(0, 255)}.{n(0, 255)}.{n(0, 255)}.{n(0, 255)}", lambda: f"{word}{n(1, 99)}@{word}.org", lambda: f"https://www.{word}.com/{word}/{n(1, 999)}", lambda: f"v{n(0, 20)}.{n(0, 20)}.{n(0, 99)}",
        lambda: f"{word.upper()[:4]}-{n(1990, 2030)}-{n(1, 9999):04}", lambda: word.upper(), lambda: f"{word[:6]}{n(1, 99)}", lambda: f"+{n(1, 99)}-{n(100, 999)}-{n(1000000, 9999999)}", lambda: f"#{n(0, 0xFFFFFF):06x}", lambda: f"{n(1, 999)},{n(0, 999):03}.{n(0, 99):02}", lambda: f"{word}_{n(1, 99)}.txt", lambda: word + rng.choice("!?,.;:)") * n(1, 3),
    )[rng.randrange(17)]()


def built_windows(texts: list[bytes], many: int = BUILT, seed: int = 11) -> list[tuple[bytes, list[int]]]:
    """Windows of the corpus with something put in, and the tags of their tokens."""
    rng, out = random.Random(seed), []
    for k in range(many if texts else 0):
        tokens = rng.choice(texts).split()[: 2 * REACH]
        words = [w.decode("utf-8", "replace").strip(_TRIM) for w in tokens]
        words = [w for w in words if len(w) > 2 and w.isalpha()]
        quote = rng.choice(("", "", '"', "'", "`"))
        end = rng.choice(("", "", "", ",", ".", ";", "!!"))
        if k % 2:
            name = rng.choice(CALLED)
            name = rng.choice((name, name, name.upper(), name.capitalize()))
            value = f"{quote}{_value(rng)}{quote}{end}"
            lead = rng.choice((f"{name} =", f"{name} :", f"{name}:", f"{name} is", f"the {name}:", f"my {name} is", f"{name} ->", f"{name}=", "Authorization: Bearer", ""))
            put = [*lead.split(), value] if lead and lead[-1] != "=" or lead.endswith(" =") else [lead + value]
            if not lead:
                put = [f"{quote}{rng.choice(PREFIXES) + _value(rng, True) if rng.random() < 0.5 else _value(rng, True)}{quote}{end}"]
            tags = [0] * (len(put) - 1) + [1]
        else:
            name = rng.choice(CALLED if k % 4 else PLAIN_NAMES)
            lead = rng.choice((f"{name} =", f"{name}:", f"{name} is", f"the {name}:", f"{name}", ""))
            put = [*lead.split(), f"{quote}{_harmless(rng, words)}{quote}{end}"]
            tags = [0] * len(put)
        at = rng.randint(0, len(tokens))
        line = b" ".join([*tokens[:at], *(w.encode() for w in put), *tokens[at:]])
        out.append((line, [0] * at + tags + [0] * (len(tokens) - at)))
    return [(line, tags) for line, tags in out if len(line.split()) == len(tags)]


def train(docs: DataFrame, key: str, text: str, sample: int = SAMPLE) -> Field | None:
    """A field from at most `sample` documents with a word or form of the patterns, as many without, and built
    windows; None where no document has a word."""
    rows = docs.select(F.col(key).alias("__id"), whole_text(text).alias("__text")).where("__id IS NOT NULL").withColumn("__hint", F.col("__text").rlike(HINT))
    ids = rows.groupBy("__id").agg(F.max("__hint").alias("hint"))
    chosen = bounded_sample(ids.where("hint"), "__id", sample).unionByName(bounded_sample(ids.where("NOT hint"), "__id", sample))
    # of a repeated key's texts, the one of the least hash
    picked = rows.join(F.broadcast(chosen.select("__id")), "__id").groupBy("__id").agg(F.min(F.struct(F.xxhash64("__text"), "__text")).alias("t")).select("t.__text")

    def windows(batches):
        for batch in batches:
            lines, files, tags = [], [], []
            for _, data, bounds in texts_of(batch, "__text", lower=False):
                starts, ends, rows, at = features(data, bounds)
                for k in range(len(at) - 1):
                    a, b = at[k], at[k + 1]
                    if a == b:
                        continue
                    y = _tags(data[bounds[k] : bounds[k + 1]].tobytes(), starts[a:b] - bounds[k], ends[a:b] - bounds[k])
                    odd = np.flatnonzero((y == 0) & (rows[a:b, 0] % 8 >= 2) & (rows[a:b, 0] // 8 % 8 > 0))
                    mid = [*np.flatnonzero(y == 1)[:PER_DOC], *odd[:: max(1, len(odd) // 3)][:3], *range(0, b - a, max(1, (b - a) // 2))][: 2 * PER_DOC]
                    unsure = np.flatnonzero((y == 0) & _unsure(rows[a:b]))
                    for m in mid:
                        i, j = max(0, m - REACH), min(b - a, m + REACH + 1)
                        if any(b"@" not in data[starts[a + u] : ends[a + u]].tobytes() for u in unsure[np.searchsorted(unsure, i) : np.searchsorted(unsure, j)]):
                            continue
                        lines.append(data[starts[a + i] : ends[a + j - 1]].tobytes()), files.append(int(rows[a, -1])), tags.append(y[i:j].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()), pa.array(files, pa.int64()), pa.array(tags, pa.binary())], ["line", "file", "tags"])

    found = cut(picked.mapInArrow(windows, "line binary, file long, tags binary").withColumn("hit", F.instr(F.hex("tags"), "1") > 0))
    turn = [F.xxhash64("line", "tags"), "line", "tags", "file"]
    some = [r for hit, most in ((True, MATCHED), (False, CLEAN)) for r in found.where(F.col("hit") == hit).orderBy(*turn).limit(most).collect()]
    if not some:
        return None
    clean = [bytes(r.line) for r in some if not r.hit]
    made = built_windows(clean or [bytes(r.line) for r in some])
    lines = [bytes(r.line) for r in some] + [line for line, _ in made]
    tags = [np.frombuffer(r.tags, np.int8) for r in some] + [np.array(t, np.int8) for _, t in made]
    rng = random.Random(13)
    files = [r.file for r in some] + [rng.choice(some).file for _ in made]
    data = np.frombuffer(b"".join(lines), np.uint8)
    _, _, rows, at = features(data, np.concatenate([[0], np.cumsum([len(x) for x in lines])]))
    each = [rows[i:j].copy() for i, j in zip(at[:-1], at[1:], strict=True)]
    for r, f in zip(each, files, strict=True):
        r[:, -1] = f
    return Field().fit(each, tags)


def _scan(field: Field | None, batch: pa.RecordBatch, column: str):
    """Each text of a batch with all its spans, by start and then kind."""
    for _, data, bounds in texts_of(batch, column, lower=False):
        starts, ends, rows, at = features(data, bounds) if field else (None,) * 4
        for k in range(len(bounds) - 1):
            raw = data[bounds[k] : bounds[k + 1]].tobytes()
            text = raw.decode("utf-8", "replace")
            spans = base_spans(text)
            more = field.spans(rows[at[k] : at[k + 1]]) if field else []
            if more:
                lead, taken = _leads(raw), _union(spans)
                for i, j in more:
                    a, b = (int(np.searchsorted(lead, int(x) - int(bounds[k]))) for x in (starts[at[k] + i], ends[at[k] + j - 1]))
                    word = text[a:b]
                    a += len(word) - len(word.lstrip(_TRIM))
                    b = a + len(word.strip(_TRIM))
                    last = bisect_left(taken, (b,)) - 1
                    if a < b and not (last >= 0 and taken[last][1] > a):
                        spans.append(("crf", a, b))
            yield text, sorted(spans, key=lambda s: (s[1], (*KINDS, "crf").index(s[0])))


def _union(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What spans, sorted by their starts, cover: stretches apart from each other."""
    out: list[tuple[int, int]] = []
    for _, a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: key and spans, an array of (kind, start, end) in code points, end exclusive.

    Kinds are those of the patterns and `crf` for what the field adds; an addition never overlaps a
    pattern's span. Null and empty texts have no spans; rows that repeat a key, or have none, each get their
    own row. Other columns are ignored.
    """
    field = docs.sparkSession.sparkContext.broadcast(train(docs, key, text, sample))
    rows = docs.select(F.col(key).alias("__id"), whole_text(text).alias("__text"))

    def scan(batches):
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in _scan(field.value, batch, "__text")]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(spans, ARROW_SPANS)], [key, "spans"])

    return rows.mapInArrow(scan, T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("spans", SPANS)]))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mask: str = "[SECRET]", sample: int = SAMPLE) -> DataFrame:
    """The documents with every secret replaced; `n_chars`, where there is one, follows the new text.
    Null texts stay null, texts without a secret are unchanged, and every row stays, repeated keys too."""
    field = docs.sparkSession.sparkContext.broadcast(train(docs, key, text, sample))

    def scan(batches):
        for batch in batches:
            out = []
            for whole, spans in _scan(field.value, batch, text):
                parts, done = [], 0
                for _, a, b in spans:
                    if a >= done:
                        parts += [whole[done:a], mask]
                    done = max(done, b)
                out.append("".join([*parts, whole[done:]]))
            kept = batch.column(text).is_valid().to_pylist()
            out = [t if k else None for t, k in zip(out, kept, strict=True)]
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns[text] = pa.array(out, batch.schema.field(text).type)
            if "n_chars" in columns:
                counts = [n if t is None else len(t) for t, n in zip(out, columns["n_chars"].to_pylist(), strict=True)]
                columns["n_chars"] = pa.array(counts, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(scan, docs.schema)
