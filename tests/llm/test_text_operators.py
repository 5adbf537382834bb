"""The language-model operators against brute force, exact round trips and their edge cases."""

import hashlib
import math
import random
import re
import time
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from placeloom.llm import bpe, chat, decontaminate, htmltext, pii, quality, simhash, tokencount, toxicity, warc
from placeloom.llm.queries import PIECES, WORD_BPE, tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, extra=True):
    """Rows (doc_id, text); extra columns clash with names used inside."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    return df.withColumns({"n_words": F.lit(1), "fp": F.lit("x"), "h": F.lit(2), "w": F.lit("w"), "score": F.lit(0.5)}) if extra else df


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "no id at all"), (5, "a b c d e " * 3000)]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# ---- chat


def render_all(df):
    parts = {}
    for r in chat.render(df).collect():
        parts.setdefault(r.conv_id, {})[r.part] = r.text
    return {k: "".join(v[p] for p in sorted(v)) for k, v in parts.items()}


def brute_chat(rows):
    convs = {}
    for c, turn, role, text in set(rows):
        if c is not None:
            convs.setdefault(c, []).append((turn, role, text))
    seqs = {c: tuple((r, t) for _, r, t in sorted(v, key=lambda x: x[0])) for c, v in convs.items()}
    prefixes = {v[:n] for v in seqs.values() for n in range(1, len(v))}
    first = {}
    for c, v in seqs.items():
        first[v] = min(first.get(v, c), c)
    return {c: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in v) for v, c in first.items() if v not in prefixes}


def test_snapshots_collapse(spark):
    rng = random.Random(3)
    base = [[(k, "user" if k % 2 else "assistant", f"t{rng.randint(0, 3)}") for k in range(rng.randint(1, 9))] for _ in range(40)]
    base += [[(k, "user", f"long {k}") for k in range(n)] for n in (700, 640, 300)]
    rows = [(c, *t) for c, v in enumerate(base) for t in v]
    rows += rows[:20] + [(None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash"))
    assert render_all(df) == brute_chat(rows)


def test_chat_without_rows_and_with_nulls(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.render(spark.createDataFrame([], schema)).count() == 0
    got = render_all(spark.createDataFrame([(1, None, None, None), (1, 0, "user", "<|im_end|>")], schema))
    assert got[1].startswith("<|im_start|>unknown\n<|im_end|>\n") and got[1].count("<|im_end|>") == 2


# ---- quality


def brute_counts(t):
    w = words(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {x for x in tri if tri.count(x) > 1} if len(tri) < 500 else {x for x in set(tri) if tri.count(x) > 1}
    covered = {i + k for i, x in enumerate(tri) if x in again for k in range(3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(["a ", "b ", "ç ", "\n", "x|y ", "# ", "\t", " "]) for _ in range(rng.randint(0, 120)))) for i in range(200)]
    rows += [x for x in ODD if x[0] != 5] + [(9, "a b c\nd\na b c\nd"), (10, "\r\n x \r\n x ")]
    got = quality.counts(docs_of(spark, rows)).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert all(tuple(r[1:]) == brute_counts(r.text) for r in got) and len(got) == len(rows)


def test_binomial_tail(spark):
    from math import comb

    cases = [(3, 1000, 0.01), (0, 100, 0.02), (7, 1000, 0.01), (30, 9000, 0.01), (1, 3, 0.5)]
    for k, n, p in cases:
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n * p else 1.0
        got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p).alias("t")).first().t
        assert got == pytest.approx(want, rel=1e-9)
    k, n, p = 900, 50_000, 0.02  # many terms
    want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
    assert spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p).alias("t")).first().t == pytest.approx(want, rel=1e-7)


def test_cutoffs_reject_junk_and_limit_false_rejections(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, marks = [], []
    for i in range(1600):
        junk = i % 5 == 0
        rows.append((i, " ".join(word() + ("###" if junk else "") for _ in range(60))))
        marks.append((i, 0 if junk else 1))
    docs, labels = docs_of(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.assess(docs, labels).collect()}
    assert all(got[i] == (i % 5 != 0) for i in got)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 1280
    few = quality.assess(docs, labels.where("doc_id < 50"))  # too few labels certify nothing
    assert few.where("NOT kept").count() == 0


def test_false_rejections_stay_under_the_bound(spark):
    """200 random samples (as strata) of a population whose rules do reject good documents: few certified unions lose more than alpha.

    delta is a twentieth for each stratum.  A good document's scores are independent and uniform on 0..100, so a union's true
    risk follows from its cutoffs; bad ones score high in two rules.
    """
    rng = np.random.default_rng(7)
    n, strata, alpha = 400, 200, 0.2
    rows = n * strata
    bad = rng.random(rows) < 0.3
    scores = rng.integers(0, 101, (rows, 4))
    scores[bad, 0] = rng.integers(70, 101, bad.sum())
    scores[bad, 2] = rng.integers(80, 101, bad.sum())
    schema = "doc_id long, stratum string, symbols int, capitals int, lines int, repeats int"
    scored = spark.createDataFrame([(i, f"={i % strata}", *map(int, scores[i])) for i in range(rows)], schema)
    labels = spark.createDataFrame([(i, int(not bad[i])) for i in range(rows)], "doc_id long, quality int")
    cuts = quality.thresholds(scored, labels, alpha=alpha, delta=0.05 * strata).collect()
    risks = [1 - np.prod([(r[rule] or 101) / 101 for rule in quality.RULES]) for r in cuts]
    assert len(risks) > 60 and sum(r > alpha for r in risks) <= 0.05 * strata + 8, (len(risks), sum(r > alpha for r in risks))


def test_quality_edges(spark):
    labels = spark.createDataFrame([(None, 1), (1, None), (4, 1)], "doc_id long, quality int")
    r = quality.assess(docs_of(spark, ODD), labels)
    assert r.count() == len(ODD) and r.where("kept").count() == 0
    assert quality.assess(docs_of(spark, []), labels.limit(0)).count() == 0


# ---- warc


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 60
    rows = [(1, "u\n x", big), (2, None, big), (3, "u", None), (4, "u", ""), (None, "u", big), (5, "u", "a\r\n\r\nWARC/1.0\r\nb"), (6, "u", "short"), (7, "u", "short")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("value", F.lit("clash"))
    path = f"file://{tmp_path}/w"
    warc.write_warc(df, path)
    got = {r.record_id: r for r in warc.page_records(spark, path).collect()}
    assert len(got) == len(rows)
    assert got["<urn:page:2>"].record_type == "revisit" and got["<urn:page:2>"].refers_to == "<urn:page:1>" and got["<urn:page:2>"].payload_bytes == 120
    assert got["<urn:page:7>"].record_type == "response" and got["<urn:page:>"].record_type == "revisit"
    for i, _, h in rows:
        r = got[f"<urn:page:{'' if i is None else i}>"]
        assert r.payload_digest == hashlib.sha256((h or "").encode()).hexdigest() and r.payload_bytes == len((h or "").encode())


def test_warc_schemes_and_empty_tables(spark, tmp_path):
    assert warc.arrow_uri("s3a://b/k") == "s3://b/k" and warc.arrow_uri("dbfs:/x/y") == "file:///dbfs/x/y" and warc.arrow_uri("file:/x") == "file:///x" and warc.arrow_uri("/x/y:z") == "/x/y:z"
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"file:{tmp_path}/e")
    assert warc.page_records(spark, f"file:{tmp_path}/e").count() == 0


def test_warc_predicates_are_taken_over(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    warc.write_warc(spark.createDataFrame([(1, "a", "x" * 200), (2, "b", "x" * 200)], "page_id long, url string, html string"), path)
    reader = warc.WarcReader({"path": path})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("http_length",), 3)]))
    assert len(left) == 1 and reader.wanted({"warc-type": "revisit"}) and not reader.wanted({"warc-type": "response"})
    assert warc.read_warc(spark, path).where("record_type = 'revisit' AND target_uri IN ('b', 'c')").count() == 1


# ---- decontamination


def brute_contained(docs, items, percent=80):
    def split(t):
        return [x for x in re.split(r"[^\w]+|_", (t or "").lower()) if x]

    def sh(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    held = {}
    for i, t in docs:
        w = split(t)
        for j, u in items:
            v = split(u)
            if v:
                n = min(5, len(v))
                s = sh(v, n)
                key = (i, t, n)
                if key not in held:
                    held[key] = sh(w, n)
                if 100 * len(s & held[key]) >= percent * len(s):
                    yield i, j


def test_containment_equals_brute_force(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["red", "blue", "Sun", "moon", "tree", "x1", "sky"]) for _ in range(n))
    items = [(j, text(rng.randint(3, 40))) for j in range(25)] + [(100, None), (101, "")]
    docs = [(i, text(300) + " " + " ".join(items[i % 25][1].split()[: rng.randint(1, 40)]) + " " + text(50)) for i in range(60)] + [(80, items[3][1].upper() + "!"), *[x for x in ODD if x[0] != 5]]
    got = decontaminate.contained(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == set(brute_contained(docs, items))
    assert any(len(u.split()) < 5 for _, u in items if u) and len(set(brute_contained(docs, items))) >= 50
    clean = decontaminate.drop_contaminated(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((str(r.doc_id), r.text or "") for r in clean.collect()) == sorted((str(i), t or "") for i, t in docs if not any(brute_contained([(i, t)], items)))


def test_shingles_that_all_items_share_make_no_candidates(spark):
    """Items with common words in front: sketches prefer what few items share, and need many hits."""
    common = "please read the following question and choose the one right answer from these four"
    items = [(j, f"{common} {' '.join(f'w{j}x{k}' for k in range(16))}") for j in range(30)] + [(99, items_text) for items_text in [f"{common} {' '.join(f'w7x{k}' for k in range(16))}"]]
    frame = spark.createDataFrame(items, "item_id long, text string")
    sketch = decontaminate.sketches(decontaminate.shingled_items(frame))
    shared = {r.h for r in sketch.collect()} & {r.h for r in decontaminate.shingled_items(spark.createDataFrame([(1, common)], "item_id long, text string")).collect()}
    assert not shared and sketch.select("item_key").distinct().count() == 30
    docs = [(1, common), (2, items[7][1].upper()), (3, "x " * 9 + items[3][1] + " y"), (None, items[4][1]), (5, "a " * 40_000 + items[5][1])]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained(docs_of(spark, docs), frame).collect()}
    assert got == {(2, 7), (2, 99), (3, 3), (None, 4), (5, 5)} == set(brute_contained(docs, items))


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "x y z"), (2, None)], "item_id long, text string")
    assert decontaminate.contained(docs_of(spark, []), items).count() == 0
    assert decontaminate.contained(docs_of(spark, ODD), items.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs_of(spark, ODD), items.limit(0)).count() == len(ODD)
    got = decontaminate.contained(docs_of(spark, [(1, "zero ONE, two!"), (1, "zero ONE, two!"), (2, "one x two"), (None, "x y z")]), items)
    assert {(r.doc_id, r.item_id, r.n_shared) for r in got.collect()} == {(1, 1, 1), (None, None, 1)} and got.count() == 2


# ---- toxicity


def test_kernel_equals_brute_force():
    def brute(a, b, lam=0.6):
        return sum(lam ** (i[-1] - i[0] + j[-1] - j[0] + 2) for i in combinations(range(len(a)), 3) for j in combinations(range(len(b)), 3) if all(a[x] == b[y] for x, y in zip(i, j)))

    rng = random.Random(1)
    pairs = [tuple("".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(2)) for _ in range(60)]
    assert toxicity.kernel(pairs, 0.6) == pytest.approx([brute(*p) for p in pairs], rel=1e-4, abs=1e-6)


def test_disguised_insults_are_found(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8)))
    insults = ["scoundrel", "villain", "dimwit"]
    rows, marks = [], []
    for i in range(500):
        bad = i % 4 == 0
        w = [word() for _ in range(40)] + ([rng.choice(insults)] if bad else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    model = toxicity.train(docs_of(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int"))
    tests = [(1, "what a scoun-drel he is " + " ".join(word() for _ in range(20))), (2, "you d i m w i t there"), (3, "v.illai.n of a man"), (4, " ".join(word() for _ in range(30)))]
    got = {r.doc_id: r.score for r in toxicity.score(docs_of(spark, tests), model).collect()}
    assert min(got[1], got[2], got[3]) > got[4] + 0.2, got
    held = toxicity.score(docs_of(spark, rows), model).where("held_out").join(spark.createDataFrame(marks, "doc_id long, toxic int"), "doc_id")
    assert held.where("predicted <> toxic").count() <= 0.05 * held.count()


def test_toxicity_edges(spark):
    docs = docs_of(spark, ODD)
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    r = toxicity.score(docs, none)
    assert r.count() == len(ODD) and r.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


# ---- personal data


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("a.@-+ 0123456789().é") if rng.random() < 0.9 else rng.choice("@.1") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == brute_spans(t)


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"abc def call me {'+1 (555) 123-%04d' % (4000 + i) if i % 2 else '555 123 %04d' % (4000 + i)} now ok") for i in range(20)]
    rows += [(100 + i, f"the year was {i} of the {i}000 or so {5551230000 + i} said it") for i in range(20)]
    found = {r.doc_id: r for r in pii.find_spans(docs_of(spark, rows)).collect()}
    assert all(len(found[i].base) == i % 2 and len(found[i].added) == 1 - i % 2 for i in range(20))
    assert all(not found[100 + i].added for i in range(20))
    text = {r.doc_id: r.text for r in pii.redact(docs_of(spark, rows)).collect()}
    assert text[2] == "abc def call me <PHONE> now ok" and text[3] == text[2]


def test_patterns_are_induced_from_what_was_found(spark):
    loose = lambda i: "555 123 %04d" % i
    rows = [(i, f"abc call me +1 (555) 999-{7000 + i} now") for i in range(20)]  # seeds of one context
    rows += [(100 + i, f"abc call me {loose(i)} now") for i in range(5)]  # found by that context
    rows += [(200 + i, f"abc ring him {loose(i)} now") for i in range(5)]  # induce the next one
    rows += [(300 + i, f"abc ring him {loose(50 + i)} now") for i in range(1)]  # found by it
    rows += [(400, f"other words {loose(50)} now"), (401, loose(50)), (402, f"tel:{loose(2)}"), (403, f"other words {loose(77)} now")]
    found = {r.doc_id: r.added for r in pii.find_spans(docs_of(spark, rows)).collect()}
    assert all(len(found[i]) == 1 for i in (100, 104, 200, 204, 300, 400, 401, 402)) and not found[403]
    assert {r.text for r in pii.redact(docs_of(spark, [*rows, (500, "+1 (555) 999-7001 or 1 555 999 7001")])).where("doc_id = 500").collect()} == {"<PHONE> or <PHONE>"}


def brute_added(texts, trust=0.8, seeds=3):
    """The added spans of each text, from the definition: counts over all words and mentions, rounds until nothing changes."""
    norm = lambda t: [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in words(re.sub("[1-9]", "0", t or ""))]
    total, edges, seed, loose = {}, {}, set(), []
    for t in texts:
        w = norm(t)
        for x in [*[p + v for p in "1r" for v in w], *["2" + " ".join(v) for v in zip(w, w[1:])]]:
            total[x] = total.get(x, 0) + 1
        base, other = pii.mentions(t or "")
        seed |= {(m["kind"], m["value"]) for m in base}
        loose.append([m for m in other if m["valid"]])
        for m in base + other:
            for p in m["pats"]:
                if p[0] in "ghs":
                    total[p] = total.get(p, 0) + 1
                if m["valid"]:
                    key = (p, m["kind"], m["value"])
                    edges[key] = edges.get(key, 0) + 1
    score = {k[1:]: float(k[1:] in seed) for k in edges}
    kept = {}
    while True:
        before = (dict(kept), dict(score))
        for p in {k[0] for k in edges} - set(kept):
            sure = [k[1] for k in edges if k[0] == p and score[k[1:]] >= trust]
            top = max(sorted(set(sure)), key=sure.count, default=None)
            if top and sure.count(top) >= seeds * pii.NEED[p[0]] and sure.count(top) >= trust * len(sure):
                kept[p] = top
        best = {}
        for p, kind in kept.items():
            own = [(n, k[1:]) for k, n in edges.items() if k[:2] == (p, kind)]
            r = sum(n * score[i] for n, i in own) / (total[p] - sum(n * (1 - score[i]) for n, i in own if p[0] in "12r") + 1)
            for _, i in own:
                best[i] = max(best.get(i, 0), r)
        for i, r in best.items():
            if score[i] < 1 and r >= trust:
                score[i] = max(score[i], trust, int(r * 100 + 1e-9) / 100)
        if before == (kept, score):
            sure = seed | {i for i, v in score.items() if v >= trust}
            return [{(m["kind"], m["start"], m["end"]) for m in found if (m["kind"], m["value"]) in sure} for found in loose]


def personal_texts(rng, n=260):
    """Texts with identifiers of base and of looser shapes after words that announce them, and decoys; the places of the looser ones."""
    w = lambda m: " ".join("".join(rng.choice("abdefgilmnorst") for _ in range(rng.randint(2, 7))) for _ in range(m))
    number = lambda: f"{rng.randint(200, 999)} {rng.randint(200, 999)} {rng.randint(0, 9999):04d}"
    before = ["call me", "reach us", "Telefon privat", "phone home"]
    out = []
    for i in range(n):
        kind = i % 8
        if kind < 2:
            ident, known = "+1 " + number(), False
        elif kind == 2:
            ident, known = number(), True
        elif kind == 3:
            ident, known = number().replace(" ", "."), True
        elif kind == 4:
            ident, known = f"{w(1)}{i}@mail.example.org", False
        elif kind == 5:
            ident, known = f"{w(1)}{i} at mail dot example dot org", True
        else:
            ident, known = number(), False  # a decoy after words of its own
        announced = f"{rng.choice(['write to', 'mail for'])} " if kind in (4, 5) else f"{rng.choice(before)} " if kind < 4 else ""
        head = f"{w(12)} {announced}"
        out.append((f"{head}{ident} {w(9)}", (len(head), len(head) + len(ident)) if known else None))
    return out


def test_unseen_identifiers_are_found_and_spans_equal_brute_force(spark):
    planted = personal_texts(random.Random(12))
    texts = [t for t, _ in planted] + [None, "", "x " * 300, "4417744280351547 4929348385146306 glued", planted[2][0]]
    got = {r.doc_id: {(x.kind, x.start, x.end) for x in r.added} for r in pii.find_spans(docs_of(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == brute_added(texts)
    found = sum(len(got[i]) for i in range(len(planted)))
    right = sum(place in {x[1:] for x in got[i]} for i, (_, place) in enumerate(planted) if place)
    assert right >= 0.9 * sum(p is not None for _, p in planted) and right >= 0.95 * found


def test_numbers_side_by_side_are_told_by_their_shape(spark):
    def card(k):
        body = f"4{k:014d}"
        return next(body + str(d) for d in range(10) if pii.luhn(body + str(d)))

    rows = [(i, f"a word {card(7_000_000 + 77 * i)} and more") for i in range(60)] + [(100 + i, f"b {card(9_000_000 + 13 * i)} {card(8_000_000 + 31 * i)} c") for i in range(5)]
    rows += [(200, "b " + card(5) + " 190.137.223.204 c"), (201, "b +1 (826) 555-4081 190.137.223.204 c")]
    rows = [r for r in rows if r[0] < 100 or r[0] >= 200 or not pii.base_spans(r[1])]
    found = {r.doc_id: r.added for r in pii.find_spans(docs_of(spark, rows)).collect()}
    assert all(len(found[i]) == 2 for i in found if 100 <= i < 200) and any(i >= 100 for i in found) and not found[201]  # no phone of that shape is known


def test_patterns_that_do_not_settle_are_an_error(spark):
    rows = [(i, f"abc call me +1 (555) 999-{7000 + i} now") for i in range(20)]
    with pytest.raises(RuntimeError):
        pii.find_spans(docs_of(spark, rows), limit=1)


def test_pii_edges(spark):
    docs = docs_of(spark, [*ODD, (7, "9" * 50_000 + "." * 10 + "@" * 1000), (8, "a@b.cc 555 123 4567, " * 5000)])
    assert pii.find_spans(docs).count() == len(ODD) + 2 and pii.find_spans(docs_of(spark, [])).count() == 0
    red = pii.redact(docs)
    assert red.columns == docs.columns and red.where("text IS NULL").count() == 1


# ---- near-duplicates


def brute_fp(t):
    w = words((t or "").translate(simhash.LOWER))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(ids, fps):
    up = {i: i for i in range(len(fps))}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                up[root(i)] = root(j)
    low = {}
    for i, d in enumerate(ids):
        low[root(i)] = min(low.get(root(i), d), d)
    return [low[root(i)] for i in range(len(fps))]


@pytest.mark.parametrize("node_rows", [20_000, 7])
def test_near_duplicates_equal_brute_force(spark, node_rows):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("alpha beta gamma Delta eps zeta eta theta".split()) + str(rng.randint(0, 30)) for _ in range(n))
    rows = []
    for g in range(25):
        base = text(200).split()
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(200)] = "zzz"
            rows.append((len(rows), " ".join(w)))
    rows += [(500, None), (501, ""), (502, "one two"), (503, "ONE  two"), (4, rows[4][1])]
    fps = [brute_fp(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], [f"{f:016x}" for f in fps], brute_components([i for i, _ in rows], fps)))
    got = simhash.near_duplicates(docs_of(spark, rows), node_rows=node_rows)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == want
    kept = simhash.keep_one(docs_of(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want})


def test_trie_join_equals_all_pairs():
    rng = np.random.default_rng(0)
    x = np.unique(np.concatenate([b ^ np.array([sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(0, 4)))) for _ in range(5)], dtype=np.uint64) for b in rng.integers(0, 2**63, 60, dtype=np.uint64)]))
    for left, right in ((x, None), (x[::2], x[1::2])):
        got = {p for i, j in simhash.trie_links(left, right, 0, 4, chunk=64) for p in zip(i.tolist(), j.tolist())}
        other = left if right is None else right
        assert got == {(i, j) for i in range(len(left)) for j in range(len(other)) if (right is not None or i < j) and bin(int(left[i]) ^ int(other[j])).count("1") <= 4}


def test_simhash_edges(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    assert simhash.near_duplicates(docs_of(spark, ODD)).count() == len(ODD)
    assert simhash.keep_one(docs_of(spark, ODD)).columns == docs_of(spark, ODD).columns


# ---- tokens


def odd_texts(n, seed=2):
    rng = random.Random(seed)
    bits = ["a", "B", " ", "  ", "\n", "é", "é", "Σ", "İ", " ", "1", "'s", "'LL", "<|endoftext|>", "<|start", "oftext|>", "!", "?!", "漢字", "🤦🏼", "\t ", "x" * 40, "\x1f", "ﬁ", "the ", "▁", "$$$ "]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 300))) for _ in range(n)] + ["", None, " ", "x" * 5000, "word. " * 4000]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file(WORD_BPE)
    own = Tokenizer.from_file(path)
    texts = odd_texts(400)
    rows = spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    for r in bpe.encode_decode(rows, path, group_bytes=20_000).collect():
        ids = own.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), " ".join(map(str, ids)), own.decode(ids, skip_special_tokens=False))


def test_chunks_are_shared_and_joins_repaired():
    rng = random.Random(9)
    passage = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 9))) for _ in range(4000))
    a, b = f"first text {passage} end", f"quite another beginning {passage}"
    pieces = [{t.encode()[x:y] for x, y in zip([0, *c], [*c, len(t)])} for t in (a, b) for c in [bpe.cut_points(t.encode()).tolist()]]
    assert len(pieces[0] & pieces[1]) > 0.5 * len(pieces[0])


def test_repeated_content_is_served_from_chunks():
    """What one worker has seen before comes from its chunks: the share of repeated chunks, whole copies of short texts included."""
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(n))
    passage = text(900)
    texts = [text(rng.randint(5, 600)) for _ in range(60)]
    texts = [t for k, t in enumerate(texts) for t in ([t, t] if k % 3 == 0 else [f"{t} {passage} {text(30)}"] if k % 3 == 1 else [t])]
    encoder = bpe.ChunkEncoder(tokenizer_file(WORD_BPE))
    got = [x for t in texts for x in encoder.encode([t])]
    seen, repeated = set(), 0
    for t in texts:
        data = t.encode()
        c = bpe.cut_points(data).tolist()
        for x, y in zip([0, *c], [*c, len(data)]):
            repeated += (y - x) * (data[x:y] in seen)
            seen.add(data[x:y])
    assert encoder.served == repeated > 0.1 * encoder.seen
    assert [ids.decode() for _, ids, _ in got] == [" ".join(map(str, encoder.tokenizer.encode(t, add_special_tokens=False).ids)) for t in texts]


def test_joins_that_disagree_are_repaired_in_growing_windows(monkeypatch):
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(20_000))
    encoder = bpe.ChunkEncoder(tokenizer_file(WORD_BPE))
    want = " ".join(map(str, encoder.tokenizer.encode(text, add_special_tokens=False).ids)).encode()
    calls = []
    plain, joined = encoder.encode_plain, encoder.join
    monkeypatch.setattr(encoder, "encode_plain", lambda data: calls.append(len(data)) or plain(data))
    tried = []
    monkeypatch.setattr(encoder, "join", lambda a, w, b: tried.append(w) or (None if len(tried) == 2 else joined(a, w, b)))
    assert encoder.encode([text])[0][1] == want and len(tried) > 2 and max(calls) < 200  # a window, not the whole text
    encoder.fresh = {}
    rounds = []
    monkeypatch.setattr(encoder, "encode_plain", lambda data: (rounds.append(data.count(b" ") + 1), (plain(data) if len(rounds) > 3 else (b"0 " + plain(data)[0], b"")))[1])
    assert encoder.repair(text.encode(), len(text) // 2)[0][:-1] == want and rounds == [3, 5, 9, 17]


def test_token_counts_equal_the_library(spark):
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb

    path = tokenizer_file(PIECES)
    model = pb.ModelProto.FromString(open(path, "rb").read())
    model.trainer_spec.model_type = 1  # the same pieces and scores under the unigram tokenizer
    for p in model.pieces:
        if p.score <= tokencount.NEVER:
            p.type = 5
    own = spm.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = odd_texts(300, 7)
    for r in tokencount.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect():
        assert r.n_tokens == len(own.encode(texts[r.doc_id] or ""))


@pytest.mark.parametrize("mark", [True, False])
def test_unknown_characters_are_one_id_without_byte_fallback(tmp_path, mark):
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto.FromString(open(tokenizer_file(PIECES), "rb").read())
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 1, False
    for p in model.pieces:
        if p.score <= tokencount.NEVER or p.type == 6 or not mark and p.piece == tokencount.MARK:
            p.type = 5
    (tmp_path / "m").write_bytes(model.SerializeToString())
    own, counter = spm.SentencePieceProcessor(model_proto=model.SerializeToString()), tokencount.UnigramCounter(str(tmp_path / "m"))
    assert all(counter.count(t) == len(own.encode(t or "")) for t in ["漢字漢字", "abc ZZZZ def", *odd_texts(300, 4)])


def test_tokens_of_empty_tables(spark):
    empty = docs_of(spark, [])
    assert tokencount.count_tokens(empty, tokenizer_file(PIECES)).count() == 0 and bpe.encode_decode(empty, tokenizer_file(WORD_BPE)).count() == 0


# ---- html


PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><header>Site</header><nav><ul><li><a href=x>Home</a><li><a href=y>More</a></ul></nav>"
    "<div class='cookie-notice'>We use cookies</div><div class=\"content has-sidebar\"><div class=post><h1>{0}</h1><p>First &amp;\n  {0} <b>bold<p>Second {1}<ul><li>one {1}<li>two</ul><form><button>Go</button></form>"
    "<div id=comments><p>nice {1}</div></div><aside>ad {1}</aside></div><footer>&copy; {1}</footer></body></html>"
)


def test_extraction_of_a_host(spark):
    rows = [(i, f"https://h{i % 2}.example/{i}", PAGE.format(f"Title {i}", i)) for i in range(12)]
    got = {r.page_id: r.text for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert all(got[i] == f"Title {i}\nFirst & Title {i} bold\nSecond {i}\none {i}" for i in got)  # "two" is on all pages: template


def test_tree_matching_and_merging():
    a = htmltext.page_tree("<div><h1>x</h1><p>a</p></div>")
    b = htmltext.page_tree("<div><p>b</p><table><td>c</table></div>")
    assert htmltext.match(a, b, {}) == 3  # root, div, p
    m = htmltext.merge(a, b)
    kids = m[htmltext.KIDS][0][htmltext.KIDS]
    assert [k[0] for k in kids] == ["h1", "p", "table"] and len(kids[1][htmltext.TEXTS]) == 2
    assert htmltext.load(htmltext.dump(m)) == m


def brute_match(a, b):
    if a[0] != b[0]:
        return 0

    def best(xs, ys):
        return max(best(xs[:-1], ys), best(xs, ys[:-1]), best(xs[:-1], ys[:-1]) + brute_match(xs[-1], ys[-1])) if xs and ys else 0

    return 1 + best(a[htmltext.KIDS], b[htmltext.KIDS])


def test_tree_matching_equals_brute_force():
    rng = random.Random(8)

    def tree(depth):
        return [rng.choice("ab"), 1, [tree(depth - 1) for _ in range(rng.randint(0, 4))] if depth else [], {}, 0, 0, 0, 0]

    for _ in range(60):
        a, b = tree(3), tree(3)
        assert htmltext.match(a, b, {}) == brute_match(a, b)
        pairs = htmltext.align(a[htmltext.KIDS], b[htmltext.KIDS], {})
        assert pairs == sorted(pairs) and (a[0] != b[0] or 1 + sum(htmltext.match(a[2][i], b[2][j], {}) for i, j in pairs) == max(1, htmltext.match(a, b, {})))


def test_forgotten_texts_are_rare_ones():
    """Of thousands of texts in a slot, those on nearly all pages are kept with counts short by a twentieth at most, however merges are grouped."""
    rng = random.Random(3)
    pages = [f"<div>{''.join(f'<p>own {i} {k}</p>' for k in range(5))}{'<p>always</p>' if rng.random() < 0.97 else ''}</div>" for i in range(3000)]
    true = sum("always" in p for p in pages)
    parts = [None] * 7
    for i, p in enumerate(pages):
        t = htmltext.page_tree(p)
        parts[i % 7] = htmltext.merge(parts[i % 7], t) if parts[i % 7] else t
    total = parts[0]
    for x in parts[1:]:
        htmltext.merge(total, x)
    slot = total[htmltext.KIDS][0][htmltext.KIDS][0]
    n, lost, _ = slot[htmltext.TEXTS][htmltext.digest("always")]
    assert n <= true <= n + lost and lost <= htmltext.LOST * 3000 and len(slot[htmltext.TEXTS]) < 2000


def planted_host(rng, k, n=12):
    """n pages of a host of its own layout without any mark, and the main blocks of each."""
    w = lambda m: " ".join("".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(m))
    menu, notice, legal, last = w(3), w(8), w(5), w(6)
    menu_at, last_in, comments, links = k % 3, k % 2, k % 4 == 0, k % 5 == 0
    out = []
    for _ in range(n):
        main = [w(4), *[w(rng.randint(5, 30)) for _ in range(rng.randint(1, 9))]]
        body = f"<h1>{main[0]}</h1>" + "".join(f"<p>{x}</p>" for x in main[1:]) + (f"<p>{last}</p>" if last_in else "")
        body = f"<article>{body}</article>" if k % 7 == 0 else f"<div>{body}</div>" if k % 2 else body
        top = [f"<div>{menu}</div>", f"<ul><li>{menu}<li>{notice}</ul>", f"<p>{menu}</p>"][menu_at]
        top += "<ul>" + "".join(f"<li><a href=x>{w(1)}</a></li>" for _ in range(rng.randint(3, 7))) + "</ul>" if links else ""
        end = f"<div><h3>Comments</h3>{''.join(f'<p>{w(9)}</p>' for _ in range(rng.randint(1, 4)))}</div>" if comments else ""
        out.append((f"<html><body>{top}<div>{notice}</div>{body}{end}<div><p>{legal}</p></div></body></html>", main))
    return out


def test_unmarked_menus_notices_and_footers_are_told_by_the_wrapper(spark):
    rng = random.Random(17)
    hosts = {k: planted_host(rng, k) for k in range(30)}
    rows = [(k * 100 + i, f"https://h{k}.example/{i}", page) for k, v in hosts.items() for i, (page, _) in enumerate(v)]
    got = {r.page_id: r.blocks for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}

    def measures(found):
        right = sum(len(set(found[k * 100 + i]) & set(main)) for k, v in hosts.items() for i, (_, main) in enumerate(v))
        return right / sum(map(len, found.values())), right / sum(len(main) for v in hosts.values() for _, main in v)

    precision, recall = measures(got)
    assert precision >= 0.95 and recall >= 0.95, (precision, recall)
    alone, _ = measures({i: htmltext.extract(page) for i, _, page in rows})
    assert alone < 0.8  # without the wrapper nothing tells them apart


@pytest.mark.parametrize("page", ["<a" * 500_000, "<a b='" * 170_000, "<div>" * 200_000 + "x", "<font><li>" * 100_000 + "x", "</script " * 110_000, "<script>" + "</script " * 110_000, "<a \">" * 200_000, "<h1>a<h2>b" * 100_000, "<p>x" * 250_000, "<td>x<div>y" * 90_000, "<!" * 500_000])
def test_hostile_pages_are_read_in_linear_time(page):
    began = time.time()
    one = htmltext.page_tree(page)
    folded = time.time()
    tree = htmltext.merge(one, htmltext.page_tree(page + "<p>z"))
    path, constant, menus = htmltext.wrapper(htmltext.load(htmltext.dump(tree)))
    ready = time.time()
    htmltext.extract(page, path, set(constant), set(menus))
    assert folded - began < 15 and time.time() - ready < 15  # a megabyte each; 2 to 4 seconds if nothing else runs


def test_html_edges(spark):
    rows = [(1, None, None), (2, "nonsense", ""), (3, "https://a/", "plain text &lt; only"), (3, "https://a/", "plain text &lt; only"), (None, "https://a/", "<p>" * 3000 + "deep"), (5, "https://b/", "<article>a<br>b</article>"), (6, "https://c/", "<" * 2000), (7, "https://d/", "<div>" * 5000 + "deep <b>down" + "</i>" * 5000), (8, "https://d/", "<font><li>" * 3000 + "x")]
    got = htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and {r.text for r in got if r.page_id == 3} == {"plain text < only"} and [r.text for r in got if r.page_id == 5] == ["a b"]
    assert htmltext.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def texts_of(spark, pages):
    """The text of each page of one host."""
    rows = [(i, f"https://h.example/{i}", p) for i, p in enumerate(pages)]
    return [r.text for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_text_beside_the_largest_container_is_kept(spark):
    long = "word " * 200
    post = [f"<div class=post><h1>T{i}</h1><p>lead {i}</p><div class=body><p>{long}{i}</p></div><ul><li><a href=x>see {i}</a></ul></div>" for i in range(8)]
    assert texts_of(spark, post) == [f"T{i}\nlead {i}\n{long}{i}\nsee {i}" for i in range(8)]
    table = [f"<p>before {i}</p><table><tr><td>{long}{i}</td></tr></table><p>after {i}</p>" for i in range(8)]
    assert texts_of(spark, table) == [f"before {i}\n{long}{i}\nafter {i}" for i in range(8)]


BLOG = "<body><p class=top>Menu text</p><div><h1>{0}</h1>{1}</div></body><!-- {2} -->"


def test_copies_of_a_page_are_not_its_template(spark):
    pages = [BLOG.format("Same", "<blockquote>quoted words</blockquote><p>same text</p>", i) for i in range(6)]
    pages += [BLOG.format(f"Other {i}", f"<p>text {i}</p>", i) for i in range(6)]
    assert texts_of(spark, pages) == ["Same\nquoted words\nsame text"] * 6 + [f"Other {i}\ntext {i}" for i in range(6)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 12])
def test_constants_need_three_contents_and_nearly_all_pages(spark, n):
    """The rule for small hosts: a text is constant from three different contents on, if all pages have it."""
    inside = "<div>{0}<h2>Menu text</h2></div>"
    menu = "\nMenu text" if n < 3 else ""
    assert texts_of(spark, [inside.format(f"<p>text {i}</p>") for i in range(n)]) == [f"text {i}{menu}" for i in range(n)]


def test_text_on_half_of_the_pages_is_kept(spark):
    pages = [f"<div><h1>Title {i}</h1>{'<h2>Summary</h2>' * (i % 2)}<p>text {i}</p></div>" for i in range(12)]
    assert texts_of(spark, pages) == [f"Title {i}\n{'Summary' + chr(10) if i % 2 else ''}text {i}" for i in range(12)]
