import hashlib
import random
import re

from tests.llm.helpers import AWKWARD, docs, words
from tidemark.llm import fingerprints, pii, secrets
from tidemark.llm.html_text import Page, TreeModel, built_pages, main_text
from tidemark.llm.queries import QUERIES
from tidemark.llm.segmentations import Lattices, Vocabulary, decoded, sample, sampled_segmentations, split_words


def test_secret_patterns_and_field(spark):
    rng = random.Random(1)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [words(40, i) + (f"\ntoken = \"{key()}\" {words(5, i)}" if i % 3 == 0 else "") for i in range(60)]
    texts += ["api_key: ABCDEFGH/123", "AKIA" + "A" * 12, "PassWord='short'", "passwd=longenough1", "AKIAZZ", "a" * 31 + "g", "ab" * 16]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.secret_spans(docs(spark, texts)).collect()}
    assert all(any(s[0] == "assign" for s in got[i]) and any(s[0] == "hex" for s in got[i]) for i in range(0, 60, 3))
    base = lambda i: [s for s in got[i] if s[0] != "crf"]
    assert base(60) == [("assign", 0, 21)] and base(61) == [("access", 0, 16)] and base(62) == [] and base(63) == [("assign", 0, 18)] and base(64) == base(65) == [] and base(66) == [("hex", 0, 32)]
    for i in range(60):
        if i % 3:
            assert got[i] == []


def test_secrets_awkward_rows_and_redaction(spark):
    df = docs(spark, [*AWKWARD, "x password: hunter2hunter2 y"])
    assert secrets.secret_spans(df).count() == len(AWKWARD) + 1
    out = secrets.redact(df)
    assert out.columns == df.columns and out.count() == len(AWKWARD) + 1
    assert [r.text for r in out.where("doc_id = 15").collect()] == ["x [SECRET] y"]
    assert secrets.secret_spans(docs(spark, [])).count() == 0 and secrets.redact(docs(spark, [])).count() == 0


def plain_secrets(text):
    """The contract's patterns, read off one by one."""
    found = []
    for m in re.finditer(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f for _, _, f in sorted(found)]


def test_secret_query_against_the_patterns(spark, tmp_path):
    rng = random.Random(6)
    piece = lambda: rng.choice(["token", "Secret", " = ", ": ", "'", '"', "AKIA", "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 31, 33]))), "".join(rng.choice("ABCDEFGH0123") for _ in range(14)), "é😀", " the ", "api_key", "apikey", "passwd=", "a.b-c/d+e_f=", "\n"])
    texts = ["".join(piece() for _ in range(rng.randint(1, 40))) for _ in range(150)]
    docs(spark, [*texts, None, ""]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op7_secret_scan"](spark, str(tmp_path)).collect()}
    for i, t in enumerate([*texts, "", ""]):
        want, r = plain_secrets(t), got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("crf")] == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
        every = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s]
        assert every == sorted(every, key=lambda s: s[0]) and not any(a < y and x < b for a, b in (tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("crf")) for x, y in every if (a, b) != (x, y))


def test_field_finds_secrets_that_no_pattern_names(spark):
    rng = random.Random(8)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.choice(signs) for _ in range(n))
    texts = [words(80, 3000 + i) for i in range(150)]
    made = [f"{words(20, i)} {lead}{k} {words(20, 900 + i)}" for i in range(20) for lead, k in (("credential = ", key(24)), ("the pwd: ", key(22)), ("", "ghp_" + key(36)))]
    df = docs(spark, [*texts, *made])
    assert all(not secrets.base_spans(m) for m in made)
    got = {r.doc_id: [s.kind for s in r.spans] for r in secrets.secret_spans(df).collect()}
    assert sum("crf" in got[150 + i] for i in range(60)) >= 45
    assert sum(bool(got[i]) for i in range(150)) <= 1


def test_secrets_in_a_long_text_take_linear_time():
    import time

    import pyarrow as pa

    began = time.time()
    text = ("token = " + "ab12" * 10 + " ") * 20000
    (_, spans), = secrets._scan(None, pa.RecordBatch.from_arrays([pa.array([text])], ["text"]), "text")
    assert len(spans) == 40000 and time.time() - began < 20


def test_viterbi_cut_at_sure_tokens_equals_the_whole_chain():
    import numpy as np

    rng = np.random.default_rng(3)
    field = secrets.Field()
    field.w = rng.normal(size=field.w.shape)
    field.w[:, 0] += 0.6
    field.t = np.clip(rng.normal(size=(3, 3)), -4, 4)
    for _ in range(30):
        rows = np.stack([rng.integers(a, b, 40) for a, b in zip(secrets._STARTS[:-1], secrets._STARTS[1:], strict=True)], 1)
        whole = field._viterbi(field.w[rows].sum(1), False, False)
        found, runs = field.spans(rows), []
        for k, tag in enumerate(whole):
            if tag == 2 and runs and runs[-1][1] == k:
                runs[-1] = (runs[-1][0], k + 1)
            elif tag:
                runs.append((k, k + 1))
        assert found == runs


def test_pii_patterns():
    assert pii.base_spans("mail a.b@c-d.org, 10.0.0.255 and 300.1.1.1") == [("email", 5, 16), ("ip", 18, 28)]
    assert pii.base_spans("4111 1111 1111 1111") == [("card", 0, 19)] and pii.base_spans("4111 1111 1111 1112") == []
    assert pii.base_spans("call +49 (30) 1234-567 now") == [("phone", 5, 22)]


def plain_personal(text):
    """The contract's patterns as they are written."""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(d[-1::-2] + [2 * x - 9 * (x > 4) for x in d[-2::-2]]) % 10 == 0:
            found.append(("card", *m.span()))
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_pii_query_against_the_patterns(spark, tmp_path):
    rng = random.Random(12)
    parts = ["a", "b_", "@", "@x", ".", "..", "-", "1", "255", "0256", "4111 1111-1111 1111", "12345678", " ", "+", "+49 (0)", "é", "%", "x.org", "10.0.0.1", ",", "\n", "0" * 17]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    assert all(pii.base_spans(t) == plain_personal(t) for t in texts)
    docs(spark, [*texts[:80], None, ""]).write.parquet(str(tmp_path / "documents.parquet"))
    for r in QUERIES["op1_personal_data"](spark, str(tmp_path)).collect():
        want = [":".join(map(str, s)) for s in plain_personal([*texts[:80], "", ""][r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and [s for s in r.spans.split(",") if s and not s.startswith("id")] == want
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w.startswith(k) for w in want) for k in pii.KINDS)


def test_pii_scanning_is_linear():
    import time

    began = time.time()
    for text in ("a" * 1_000_000 + " 1", "1" * 1_000_000 + " .", "a" * 1_000_000 + " @", "1." * 500_000, "a@" * 500_000, "+1 " * 300_000, "a1" * 500_000):
        pii.instances(text, pii.base_spans(text))
    assert time.time() - began < 20


def test_pattern_scores_against_plain_loops(spark):
    from math import prod

    rng = random.Random(3)
    edges = sorted({(f"p{rng.randrange(12)}", f"w{rng.randrange(40)}") for _ in range(150)})
    seeds = {f"w{i}" for i in range(0, 40, 3)}
    score = {w: float(w in seeds) for _, w in edges}
    for r in range(pii.ROUNDS):
        confidence, many = {}, {}
        for p in {p for p, _ in edges}:
            own = [w for q, w in edges if q == p]
            confidence[p], many[p] = sum(score[w] for w in own) / (len(own) + pii.DOUBT), sum(w in seeds for w in own)
        if r < pii.ROUNDS - 1:
            for w in score:
                if w not in seeds:
                    score[w] = 1 - prod(1 - min(confidence[p], 0.999) for p, v in edges if v == w and many[p])
    got = {r.pattern: (r.seeds, r.confidence) for r in pii.score_patterns(spark.createDataFrame([(p, w, w in seeds) for p, w in edges], "pattern string, what string, seed boolean")).collect()}
    assert set(got) == set(confidence) and all(got[p][0] == many[p] and abs(got[p][1] - confidence[p]) < 1e-9 for p in got)


def test_pii_common_words_mark_nothing(spark):
    texts = [f"the of the and of {words(6, i)} of user{i}@site.org and the of {words(4, i)} the of" for i in range(40)]
    texts += [f"{words(6, 100 + i)} of number{i}-{i}75 {words(9, 50 + i)}" for i in range(3)]
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.personal_data(docs(spark, texts)).collect()}
    assert all(got[i] == ["email"] for i in range(40)) and all(got[i] == [] for i in range(40, 43))


def test_pii_contexts_find_unseen_identifiers(spark):
    texts = [f"{words(6, i)} the customer mail is user{i}@site.org thanks {words(4, i)}" for i in range(40)]
    texts += [f"{words(6, 100 + i)} the customer mail is user{i}#site-{i} thanks" for i in range(3)] + [f"{words(5, 300 + i)} costs {i}{i}75 euro" for i in range(20)]
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.personal_data(docs(spark, texts)).collect()}
    assert all(got[i] == ["email"] for i in range(40))
    assert all("id" in got[i] for i in range(40, 43)) and all(got[i] == [] for i in range(43, 63))


def test_pii_awkward_rows(spark):
    assert pii.personal_data(docs(spark, AWKWARD)).count() == len(AWKWARD)
    assert pii.personal_data(docs(spark, [])).count() == 0


def test_fingerprints_against_plain_form(spark):
    texts = [words(random.Random(i).randint(1, 400), i) for i in range(40)] + ["", None, "a", "ab", "äöü" * 9]
    got = {r.doc_id: r for r in fingerprints.fingerprints_with_next(docs(spark, texts)).collect()}
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        q, after = len(t) // 4, plain[(i + 1) % len(plain)]
        e = t[: len(t) - q] + after[:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.fingerprint(t), fingerprints.fingerprint(e))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def plain_chunks(data):
    """Chunks by the rolling hash, one byte at a time."""
    gear, h, at, out = fingerprints._GEAR.tolist(), 0, 0, []
    for i, b in enumerate(data):
        h = ((h << 1) + gear[b]) & 0xFFFFFFFF
        size = i + 1 - at
        mask = fingerprints.STRICT if size < fingerprints.NORMAL else fingerprints.LOOSE
        if size >= fingerprints.LEAST and h >> (32 - mask) == 0 and len(data) - at > fingerprints.LEAST or size == fingerprints.MOST:
            out.append(bytes(data[at : i + 1]))
            at = i + 1
    return [*out, bytes(data[at:])] if at < len(data) else out


def test_likeness_against_plain_chunks(spark):
    texts = [words(random.Random(i).randint(1, 300), i) for i in range(20)] + ["", "é" * 300] + [words(120, 7) + words(20, 5000)]
    got = {r.doc_id: r for r in fingerprints.fingerprints_with_next(docs(spark, texts)).collect()}

    def contained(a, b):
        a, b = set(plain_chunks(a.encode())), set(plain_chunks(b.encode()))
        return sum(map(len, a & b)) / sum(map(len, a)) if a else float(not b)

    for i, t in enumerate(texts):
        after, q = texts[(i + 1) % len(texts)], len(t) // 4
        assert abs(got[i].near_edited - contained(t, t[: len(t) - q] + after[:q])) < 1e-9 and abs(got[i].near_next - contained(t, after)) < 1e-9


def test_fingerprints_awkward_rows(spark):
    assert fingerprints.fingerprints_with_next(docs(spark, AWKWARD)).count() == len(AWKWARD)
    assert fingerprints.fingerprints_with_next(docs(spark, [])).count() == 0
    alone = fingerprints.fingerprints_with_next(docs(spark, ["some text here"])).first()
    assert alone.near_next == 1.0


def test_fingerprints_resist_shifts():
    import numpy as np

    text = words(2000, 9)
    of = lambda t: fingerprints.chunk_set(np.frombuffer(t.encode(), np.uint8), fingerprints.cuts(np.frombuffer(t.encode(), np.uint8)))
    assert fingerprints.likeness(of(text), of("new start " + text)) > 0.95


PAGE = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="ad">Buy now</div><article><h1>Title</h1><p><b>First &amp; one.<br><p>Second\n  part</p><aside>Other</aside><section class="comments"><p>I liked this</p></section></article><footer>&copy; me</footer></body></html>'


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, "v", None), (3, "w", ""), (4, None, "plain < text & more"), (5, "x", "<p>unclosed <b>tag"), (None, "y", "<" * 50 + "a b=\"" * 20), (6, "z", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in main_text(df).collect()}
    assert len(got) == 7 and got[1].text == "Title\nFirst & one.\nSecond part" and got[2].text == got[3].text == ""
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert main_text(df.limit(0)).count() == 0


def test_pages_as_browsers_read_them():
    texts = lambda h: [x for x in Page(h).texts if x]
    assert texts('<p>a</p><script src="a.js"/>var a=1;</script><style/>p{}</style><p>b</p>') == ["a", "b"]
    assert texts("<p>area is <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and more</p>") == ["area is x=2 and more"]
    assert texts('<p>a<svg class="x"/>b<svg><text>no</text></svg>c</p>') == ["abc"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    # comments that close at once, or by --!>, hide nothing after them; an open one hides the rest
    for c in ("<!-->", "<!--->", "<!---->", "<!--x--!>", "<!--a<!--b-->", "<!--x-->"):
        assert texts(f"<p>One.</p>{c}<p>Two.</p><!-- real --><p>Three.</p>") == ["One.", "Two.", "Three."], c
    assert texts("<p>One.</p><!-- x -- > <p>Two.</p>") == ["One."]
    long = "".join(f"<p>Line {i}.</p>" + "<!-->" * (i == 5000) for i in range(10000))
    assert len(texts(f"<article>{long}</article><!-- end -->")) == 10000
    page = Page("<table><tr><td>a<td>b<tr><td><p>c</table><p>d<div>e")
    assert [(page.tags[page.parents[i]], t) for i, t in enumerate(page.texts) if t] == [("td", "a"), ("td", "b"), ("p", "c"), ("p", "d"), ("div", "e")]


def test_deep_pages_take_linear_time():
    import time

    began, n = time.time(), 30000
    for html in ("<div>" * n + "</p>" * n, "<p><button>" + "<label>" * n + "<h2>x" * n, "<div>" * n + "x" + "</div>" * n, "<li>" * n, "</div>" * n + "<p>" * n):
        Page(html)
    assert time.time() - began < 20


def test_article_pages_that_were_not_learnt_from(spark, sf_dir):
    from tidemark.llm.html_text import article_labels, train

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = train(pages.where("page_id % 2 = 0"))
    good = bad = 0
    for r in pages.where("page_id % 2 = 1").collect():
        page = Page(r.html or "")
        if labels := article_labels(page):
            p, _ = model.beliefs(page)
            for t, y, q in zip(page.texts, labels, p, strict=True):
                if t is not None:
                    good, bad = good + ((q >= 0.5) == bool(y)), bad + ((q >= 0.5) != bool(y))
    assert good and good / (good + bad) >= 0.97, (good, bad)


def test_messages_equal_enumeration():
    from itertools import product
    from math import exp

    from tidemark.llm.html_text import _kind

    model = TreeModel().fit(built_pages()[:20], 2)
    page = Page("<div class=ad>one<p>two</p></div><p>three</p>")
    n = len(page.tags)
    one = [sum(model.unary.get(f, 0) for f in fs) for fs in page.features]
    total, good = 0.0, [0.0] * n
    for x in product((0, 1), repeat=n):
        w = exp(sum(o for o, y in zip(one, x, strict=True) if y) + sum(model.pair[_kind(page.tags[i])][x[page.parents[i]]][x[i]] for i in range(1, n)))
        total += w
        good = [g + w * y for g, y in zip(good, x, strict=True)]
    p, _ = model.beliefs(page)
    assert all(abs(a - g / total) < 1e-9 for a, g in zip(p, good, strict=True))


def test_segmentations_round_trip(spark):
    texts = [None, "", " ", "Hello  world\n", "ça va? 😀", words(50, 4), "x" * 300, "hello", "hello"]
    rows = [(i // 2, i % 2, t) for i, t in enumerate(texts)] + [(None, None, "no key")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, text string")
    out = sampled_segmentations(df, ("conv_id", "turn"), samples=3)
    back = decoded(out, text="back").collect()
    want = {(c, t): x or "" for c, t, x in rows}
    assert {(r.conv_id, r.turn) for r in back} == set(want) and all(r.back == want[r.conv_id, r.turn] for r in back)
    seen = [(r.conv_id, r.turn, tuple(r.pieces)) for r in back]
    assert len(seen) == len(set(seen)) and all(0 < r.inclusion <= 1 for r in back)
    again = {(r.conv_id, r.turn, r.sample): r.value for r in out.collect()}
    assert again == {(r.conv_id, r.turn, r.sample): r.value for r in back}
    assert sampled_segmentations(df.limit(0), ("conv_id", "turn")).count() == 0


def lattice_of(texts):
    import pyarrow as pa

    lattices = Lattices(Vocabulary())
    data, starts, ends, counts = split_words(pa.array(texts))
    return lattices, lattices.kinds(data, starts, ends), counts


def every_segmentation(text, v):
    """All segmentations of a text, by plain search over the pieces."""
    whole = "▁" + text.replace(" ", "▁")

    def after(i):
        if i == len(whole):
            yield [], 0.0
            return
        for j in range(i + 1, len(whole) + 1):
            if "▁" in whole[i + 1 : j]:
                break
            if (p := v.pieces.get(whole[i:j])) is not None:
                for ids, w in after(j):
                    yield [p, *ids], v.log_p[p] + w
        if whole[i] not in v.pieces:
            raw = whole[i].encode()
            for ids, w in after(i + 1):
                yield [*(int(v.bytes[b]) for b in raw), *ids], v.byte_p * len(raw) + w

    return list(after(0))


def test_samples_against_every_segmentation():
    import numpy as np

    v = Vocabulary()
    for text in ("they went", "aaa", "é😀x", "", " a  b", "\u2581", "nul\x00l"):
        plain = every_segmentation(text, v) if "\u2581" not in text else None
        n = 6 if plain is None else min(len(plain), 6)
        lattices, kinds, counts = lattice_of([text] * 50)
        found = sample(lattices, kinds, counts, np.arange(50, dtype=np.uint64), n)
        for f in found:
            ids = [lattices.pieces(s["edges"], np.array([len(s["edges"])]))[0].tolist() for s in f]
            assert all(v.decode(i) == text for i in ids) and len({tuple(i) for i in ids}) == len(ids)
            assert [s["value"] for s in f] == sorted((s["value"] for s in f), reverse=True)
            if plain:
                held = {tuple(i): w for i, w in plain}
                assert len(ids) == n and all(abs(held[tuple(i)] - s["log_p"]) < 1e-9 for i, s in zip(ids, f, strict=True))
        if plain:
            total = np.logaddexp.reduce([w for _, w in plain])
            assert abs(sum(lattices.masses[kinds[: counts[0]]]) - total) < 1e-9


def test_joined_pieces_equal_those_decoded_one_by_one():
    import pyarrow as pa

    from tidemark.llm.segmentations import joined

    v, rng = Vocabulary(), random.Random(4)
    ids = [i for i, r in enumerate(v.raw) if r]
    lists = [[rng.choice(ids) for _ in range(rng.randrange(12))] for _ in range(200)]
    good = [x for x in lists if v.decode(x).encode() == b"".join(v.raw[i] for i in x).removeprefix(b" ")]
    for rows in (lists, [*good, None, [], *good[:5]], [], [None]):
        want = [None if x is None else v.decode(x) for x in rows]
        assert joined(v, pa.array(rows, pa.list_(pa.int32()))).to_pylist() == want
        assert joined(v, pa.array(rows, pa.list_(pa.int32())).slice(1)).to_pylist() == want[1:]


def test_inclusion_is_unbiased():
    import numpy as np

    n = 4000
    lattices, kinds, counts = lattice_of(["they went"] * n)
    found = sample(lattices, kinds, counts, np.arange(n, dtype=np.uint64), 2)
    mass = float(lattices.masses[kinds[: counts[0]]].sum())
    assert abs(np.mean([sum(np.exp(s["log_p"] - mass) / s["inclusion"] for s in f) for f in found]) - 1) < 0.02


def test_segmentations_take_clashing_columns_and_long_words(spark):
    df = docs(spark, ["a b", "x" * 20000, None]).withColumnRenamed("keep_id", "sample").withColumnRenamed("__text", "pieces").withColumnRenamed("score", "__seed")
    back = decoded(sampled_segmentations(df, ("doc_id",)), text="back").collect()
    assert {(r.doc_id, r.back) for r in back} == {(0, "a b"), (1, "x" * 20000), (2, "")}


def test_segmentation_query_decodes_every_document(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect()}
    got = QUERIES["op8_sampled_segmentations"](spark, sf_dir).select("doc_id", "decoded_sha256").collect()
    assert {r.doc_id for r in got} == set(want)
    assert all(r.decoded_sha256 == want[r.doc_id] for r in got)


def test_main_text_takes_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Words of it and some more of them.</p></article>", 5, "no", "no")], "page_id long, url string, html string, n_chars int, text string, __html string")
    row = main_text(df).first()
    assert row.asDict() == {"page_id": 1, "url": "u", "text": "Words of it and some more of them.", "n_chars": 34}


def test_texts_of_a_million_signs(spark):
    """Whole texts of over a megabyte, one of words and one without a break, go through every operator."""
    from tests.llm.helpers import LABELS
    from tidemark.llm.near_dedup import near_duplicates
    from tidemark.llm.packing import best_fit
    from tidemark.llm.quality import quality
    from tidemark.llm.toxicity import toxicity

    long = words(220_000, 77)
    texts = [long, "x1" * 600_000, long + " token = " + "ab12" * 10 + " a.b@c.org", *(words(40, i) for i in range(40))]
    df, labels = docs(spark, texts), spark.createDataFrame([(i, 1, i % 2) for i in range(40)], LABELS)
    assert len(long) > 1_000_000
    spans = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in pii.personal_data(df).collect()}
    assert ("email", "a.b@c.org") in spans[2]
    spans = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in secrets.secret_spans(df).collect()}
    assert ("hex", "ab12" * 10) in spans[2]
    assert {r.doc_id: r.class_id for r in near_duplicates(df).collect() if r.doc_id < 3} == {0: 0, 1: 1, 2: 0}
    assert {r.doc_id: r.n_chars for r in fingerprints.fingerprints_with_next(df).collect()} == {i: len(t) for i, t in enumerate(texts)}
    assert sum(r.n_tokens for r in best_fit(df).collect() if r.doc_id == 0) == 220_000
    assert quality(df, labels).count() == toxicity(df, labels).count() == len(texts)
    back = decoded(sampled_segmentations(df.where("doc_id < 2"), ("doc_id",), samples=1), text="back").collect()
    assert all(r.back == texts[r.doc_id] for r in back) and len(back) == 2
