"""Personal data: fixed shapes, and contextual patterns bootstrapped from them.

``base_spans`` finds e-mail addresses, IPv4 addresses, card and phone numbers of the agreed
shapes.  They seed a search for identifiers of looser shapes (a phone number without its plus, a
card number with other separators, an address whose dot is spelt out):

1. every mention of an identifier-like shape has lexical patterns of several widths: the two words
   left of it, the one word left, the word right, what it is glued to, and its own shape, with all
   digits alike or all but the first (so a number that touches another one is told by its shape),
2. a pattern seen with enough different trusted instances (seeds at first), nearly all of one kind,
   is kept; the wider a pattern, the more it needs (``NEED``),
3. over the graph of patterns and instances, scores go back and forth: a pattern's is the share of
   its occurrences held by trusted instances.  Words count all their occurrences in the whole
   corpus but those held by instances of the kind that are still open (ordinary words are followed
   by something else nearly always, so they score low); shapes count all mentions, open ones and
   those with a wrong check digit included, or any number would do.  An instance's score is that of its best pattern; instances that
   reach ``trust`` take part in 2 in the next round, until nothing changes,
4. trusted instances are added wherever a loose shape finds them, whatever precedes them there.

Text that has no such patterns gets its base spans only.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.llm.common import WHITE_RUN, batches_of, materialize

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits is tried from its start only: from inside it would fail or succeed alike
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# looser shapes, for the contextual search only
LOOSE_PHONE = re.compile(r"(?<![\w.+-])\(?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}(?![\w.-]*[\w])")
LOOSE_CARD = re.compile(r"(?<![\w.+-])[0-9](?:[ ./_-]?[0-9]){12,18}(?![\w.-]*[\w])")
DOT = r"(?:\.|(?: ?[\[(] ?| )(?:\.|dot)(?: ?[\])] ?| ))"
LOOSE_EMAIL = re.compile(rf"(?<![\w.@+-])[A-Za-z0-9._%+-]{{2,64}}(?:@|(?: ?[\[(] ?| )(?:@|at)(?: ?[\])] ?| ))[A-Za-z0-9-]{{2,63}}(?:{DOT}[A-Za-z0-9-]{{2,63}})*{DOT}[A-Za-z]{{2,24}}(?![\w@])")
LOOSE_IP = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")
NORMAL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
WHITE_CHARS = frozenset(" \t\n\x0b\x0c\r")
LETTERS, NUMBERS = re.compile(r"[A-Za-z]+"), re.compile(r"[0-9]+")
PIECE = re.compile(r"[^\x20]+")
#: Widths of patterns by their first character, and how many times ``seeds`` instances each needs.
NEED = {"2": 1, "g": 1, "h": 10, "s": 10, "1": 20, "r": 20}
FOUND = "array<struct<kind:string,start:int,end:int,value:string,valid:boolean,pats:array<string>>>"


def luhn(digits: str) -> bool:
    """The check digit rule of card numbers."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start; each scan is linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = digits_of(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def parts_of(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Parts of base shape and valid digits within longer runs that fail as a whole, as when two numbers stand side by side.

    From the left, the longest part that starts at a piece between spaces is taken.
    """
    out = []
    whole = {(k, a, b) for k, a, b in taken}
    for kind, found, low, high in (("card", CARD.finditer(text), 13, 19), ("phone", PHONE.finditer(text) if "+" in text else (), 9, 15)):
        for m in found:
            if (kind, *m.span()) in whole or " " not in m[0] or len(m[0]) <= low:
                continue
            pieces = [(m.start() + p.start(), m.start() + p.end()) for p in PIECE.finditer(m[0])]
            sizes = [len(digits_of(text[a:b])) for a, b in pieces]
            i = 0
            while i < len(pieces):
                best, size = None, 0
                for j in range(i, len(pieces)):
                    size += sizes[j]
                    if size > high or text[pieces[i][0]] == "+" and j > i and text[pieces[j][0]] == "+":
                        break
                    if size >= low and (luhn(digits_of(text[pieces[i][0] : pieces[j][1]])) if kind == "card" else text[pieces[i][0]] == "+"):
                        best = j
                if best is not None and not (i == 0 and best == len(pieces) - 1):
                    out.append((kind, pieces[i][0], pieces[best][1]))
                i = i + 1 if best is None else best + 1
    return out


def loose_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, bool]]:
    """Spans of looser shapes that touch no span in ``taken`` and not each other; False marks numbers with a wrong check digit."""
    out: list[tuple[str, int, int, bool]] = []
    busy: list[tuple[int, int]] = []  # apart from each other, in order
    for a, b in sorted((a, b) for _, a, b in taken):
        if busy and a < busy[-1][1]:
            busy[-1] = (busy[-1][0], max(b, busy[-1][1]))
        else:
            busy.append((a, b))

    def free(a: int, b: int) -> bool:
        k = bisect.bisect_left(busy, (b, 0))
        return not k or busy[k - 1][1] <= a

    if "@" in text or " at " in text or "(at)" in text or "[at]" in text:
        mails = LOOSE_EMAIL.finditer(text)
    else:
        mails = iter(())
    ips = LOOSE_IP.finditer(text) if ":" in text else iter(())
    wrong = []
    for kind, found, test in (
        ("", parts_of(text, taken), None),
        ("email", mails, lambda d: True),
        ("ip", ips, lambda d: True),
        ("card", LOOSE_CARD.finditer(text), luhn),
        ("phone", LOOSE_PHONE.finditer(text), lambda d: 7 <= len(d) <= 15),
    ):
        for m in found:
            span = m[1:] if test is None else m.span()
            if free(*span):
                if test is None or test(digits_of(m[0])):
                    out.append((kind or m[0], *span, True))
                    bisect.insort(busy, span)
                elif kind == "card":
                    wrong.append((kind, *span, False))
    return out + wrong


def _white_before(text: str, at: int, low: int = 0) -> int:
    """Where the last white space before ``at`` ends."""
    while at > low and text[at - 1] not in WHITE_CHARS:
        at -= 1
    return at


def word_before(text: str, at: int) -> tuple[int, int]:
    """(start, end) of the last word that ends before ``at``, which follows white space or the start of the text."""
    end = at
    while end > 0 and text[end - 1] in WHITE_CHARS:
        end -= 1
    return _white_before(text, end), end


def word_after(text: str, at: int) -> str:
    """The word after the white space at or after ``at``."""
    n = len(text)
    while at < n and text[at] not in WHITE_CHARS:
        at += 1
    while at < n and text[at] in WHITE_CHARS:
        at += 1
    end = at
    while end < n and text[end] not in WHITE_CHARS:
        end += 1
    return text[at:end]


def shape_of(kind: str, s: str) -> str:
    """The mention with all digits alike; letters too, by runs, in what is not a number."""
    return s.translate(NORMAL) if kind in ("card", "phone") else NUMBERS.sub("0", LETTERS.sub(lambda m: m[0] if m[0] in ("at", "dot") else "x", s))


def patterns_of(text: str, kind: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a mention, each with its width in front."""
    out = ["s" + shape_of(kind, text[start:end])]
    if kind in ("card", "phone"):
        head = NUMBERS.search(text, start).start() + 1
        out.append("h" + text[start:head] + text[head:end].translate(NORMAL))
    glued = _white_before(text, start)
    if glued < start:
        out.append("g" + text[glued:start].translate(NORMAL))
    else:
        a, b = word_before(text, start)
        if a < b:
            out.append("1" + text[a:b].translate(NORMAL))
            c, d = word_before(text, a)
            if c < d:
                out.append("2" + text[c:d].translate(NORMAL) + " " + text[a:b].translate(NORMAL))
    if after := word_after(text, end):
        out.append("r" + after.translate(NORMAL))
    return out


def mentions(text: str) -> tuple[list[dict], list[dict]]:
    """The base spans and the looser ones, with values and patterns.

    Words next to a mention are read whole, however long; a word is next to few mentions, so the
    scan stays linear.
    """

    def rows(spans: list[tuple]) -> list[dict]:
        return [{"kind": k, "start": a, "end": b, "value": digits_of(text[a:b]) if k in ("card", "phone") else text[a:b], "valid": ok, "pats": patterns_of(text, k, a, b)} for k, a, b, ok in spans]

    spans = base_spans(text)
    return rows([(*x, True) for x in spans]), rows(loose_spans(text, spans))


def _scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base and loose: the found mentions."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("valid", pa.bool_()), ("pats", pa.list_(pa.string()))]))
        for batch in batches:
            found = [mentions(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([x[k] for x in found], struct) for k in (0, 1)]], names=["doc_id", "text_key", "base", "loose"])

    return batches_of(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), 800).mapInArrow(run, f"doc_id {kind}, text_key long, base {FOUND}, loose {FOUND}")


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pat and total: how often the words of the patterns (column pat) stand in the texts, in one reading of them."""
    bare = F.substring("pat", 2, 1 << 30)
    first, second = F.substring_index(bare, " ", 1), F.substring_index(bare, " ", -1)
    two = F.col("pat").startswith("2")
    keyed = patterns.select("pat", F.when(two, F.xxhash64(first, second)).otherwise(F.xxhash64(bare)).alias("key"))
    keyed = materialize(keyed, "pii-words")
    plain = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    w = docs.select(F.filter(F.split(plain, WHITE_RUN), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.xxhash64(F.col("w")[i], F.col("w")[i + 1]))).otherwise(F.array().cast("array<bigint>"))
    wide = {bool(r[0]) for r in keyed.select(two.alias("two")).distinct().collect()}  # two rows at most
    if not wide:
        return keyed.select("pat", F.lit(0).cast("long").alias("total"))
    words = F.transform("w", lambda x: F.xxhash64(x))
    every = pairs if wide == {True} else words if wide == {False} else F.concat(pairs, words)
    total = w.select(F.explode(every).alias("key")).join(keyed.select("key").distinct(), "key").groupBy("key").agg(F.count("*").alias("total"))
    return keyed.join(total, "key").select("pat", "total")


def trusted_instances(docs: DataFrame, found: DataFrame, limit: int = 50, trust: float = 0.8, seeds: int = 3) -> DataFrame:
    """kind and value of the base instances and of those whose best pattern reaches ``trust``.

    A pattern once kept stays, and an instance's score counts in hundredths, so scores only rise
    and settle; a run that doesn't in ``limit`` rounds is an error.
    """
    spread = lambda c, is_seed: found.select(F.inline(c)).select("kind", "value", "valid", "pats", F.lit(is_seed).alias("seed"))
    known = materialize(spread("base", True).select("kind", "value").distinct(), "pii-known")
    held = spread("base", True).unionByName(spread("loose", False)).select("kind", "value", "valid", "seed", F.explode("pats").alias("pat"))
    edges = materialize(held.groupBy("pat", "kind", "value", "valid").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "pii-edges")
    wide = F.create_map(*[x for k, v in NEED.items() for x in (F.lit(k), F.lit(v * seeds))])
    need = wide[F.substring("pat", 1, 1)]
    # a loose occurrence of a base instance is a seed too
    slim = edges.where("valid").groupBy("pat", "kind", "value").agg(F.sum("n").alias("n"), F.max("seed").alias("seed"))
    slim = slim.join(known.withColumn("base", F.lit(True)), ["kind", "value"], "left")
    slim = materialize(slim.select("pat", "kind", "value", "n", (F.col("seed") | F.coalesce("base", F.lit(False))).alias("seed")), "pii-slim")
    # a pattern can only be kept for a kind if all its instances are enough, and outnumber the seeds of other kinds: those are trusted always
    by_kind = slim.groupBy("pat", "kind").agg(F.count("*").alias("every"), F.count_if(F.col("seed")).alias("sure"))
    by_pat = by_kind.groupBy("pat").agg(F.sum("sure").alias("sure"), F.collect_list(F.struct("every", "sure")).alias("k"))
    hope = by_pat.where(F.exists("k", lambda k: (k["every"] >= need) & (k["every"] >= trust * (k["every"] + F.col("sure") - k["sure"])))).select("pat")
    hope = materialize(hope, "pii-hope")
    if hope.isEmpty():
        return known
    lexical = F.substring("pat", 1, 1).isin("2", "1", "r")
    mentioned = edges.where(~lexical).join(hope, "pat", "left_semi").groupBy("pat").agg(F.sum("n").alias("total"))
    total = materialize(occurrences(docs, hope.where(lexical)).unionByName(mentioned), "pii-totals")
    edges = materialize(slim.join(total, "pat"), "pii-graph")
    kept, mark = None, None
    instances = edges.groupBy("kind", "value").agg(F.max(F.col("seed").cast("double")).alias("s"))
    for _ in range(limit):
        # induced patterns: enough different trusted instances, nearly all of one kind
        sure = edges.join(instances.where(F.col("s") >= trust).select("kind", "value"), ["kind", "value"], "left_semi")
        by_kind = sure.groupBy("pat", "kind").agg(F.count("*").alias("different"))
        induced = by_kind.groupBy("pat").agg(F.max_by("kind", F.struct("different", "kind")).alias("kind"), F.max("different").alias("most"), F.sum("different").alias("all"))
        induced = induced.where((F.col("most") >= need) & (F.col("most") >= trust * F.col("all"))).select("pat", "kind")
        kept = materialize(induced if kept is None else kept.unionByName(induced.join(kept, "pat", "left_anti")), "pii-induced")
        graph = edges.join(kept, ["pat", "kind"]).join(instances, ["kind", "value"])
        open_ = F.when(lexical, F.col("n") * (1 - F.col("s"))).otherwise(0.0)
        scored = graph.groupBy("pat", "kind").agg((F.sum(F.col("n") * F.col("s")) / (F.max("total") - F.sum(open_) + 1)).alias("score"))
        best = graph.join(scored, ["pat", "kind"]).groupBy("kind", "value").agg(F.max("score").alias("m"))
        cut = F.greatest(F.floor(F.col("m") * 100 + 1e-9) / 100, F.lit(trust))
        now = F.when(F.col("s") == 1, 1.0).when(F.col("m") >= trust, F.greatest("s", cut)).otherwise(F.col("s"))
        instances = materialize(instances.join(best, ["kind", "value"], "left").select("kind", "value", now.alias("s")), "pii-instances")
        now = (kept.count(), *instances.agg(F.count_if(F.col("s") >= trust), F.round(F.sum("s"), 3)).first())
        if now == mark:
            return known.unionByName(instances.where(F.col("s") >= trust).select("kind", "value")).distinct()
        mark = now
    raise RuntimeError(f"patterns did not settle in {limit} rounds")


def find_spans(docs: DataFrame, limit: int = 50, trust: float = 0.8, seeds: int = 3) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_key, base and added.

    base and added are arrays of (kind, start, end, value), in code points, end exclusive, by
    kind as in KINDS, then start.  Null and empty texts have none.  Rows that repeat an id and
    text get the same spans each.  Other columns are not read.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = materialize(_scan(docs), "pii-found")
    trusted = trusted_instances(docs, found, limit, trust, seeds)
    loose = found.select("doc_id", "text_key", F.inline("loose")).where("valid").drop("valid", "pats")
    extra = loose.join(trusted, ["kind", "value"], "left_semi").distinct()
    extra = materialize(extra.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("kind", "start", "end", "value")).alias("added")), "pii-added")
    e = extra.select(F.col("doc_id").alias("__i"), F.col("text_key").alias("__k"), "added")

    def of_kind(c: str | Column, kind: str) -> Column:
        return F.sort_array(F.filter(c, lambda x: x["kind"] == kind))

    order = lambda c: F.flatten(F.array(*[of_kind(c, k) for k in KINDS]))
    slim = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    joined = found.join(e, found["doc_id"].eqNullSafe(e["__i"]) & (found["text_key"] == e["__k"]), "left")
    return joined.select("doc_id", "text_key", order(slim).alias("base"), order(F.coalesce("added", none)).alias("added"))


def redact(docs: DataFrame, limit: int = 50, trust: float = 0.8, seeds: int = 3) -> DataFrame:
    """``docs`` with each span of its texts replaced by its kind in angle brackets, columns unchanged.

    Of spans that overlap, the one that starts first (the longer of two) is replaced whole with
    what it overlaps.  Null texts stay null.  n_chars, if present, is counted anew.
    """
    spans = find_spans(docs, limit, trust, seeds)
    added = materialize(spans.where(F.size("added") > 0).select(F.col("doc_id").alias("__i"), F.col("text_key").alias("__k"), F.col("added").alias("__added")).distinct(), "pii-redact")
    same = docs["doc_id"].eqNullSafe(added["__i"]) & (F.xxhash64(docs["text"]) == added["__k"])
    wide = docs.join(added, same, "left").drop("__i", "__k")
    names = wide.columns
    at, extra = names.index("text"), names.index("__added")

    def blank(text: str, more: list[dict] | None) -> str:
        spans = sorted([(a, -b, k) for k, a, b in base_spans(text)] + [(x["start"], -x["end"], x["kind"]) for x in more or []])
        out, pos = [], 0
        for a, b, k in spans:
            if a >= pos:
                out += [text[pos:a], f"<{k.upper()}>"]
            pos = max(pos, -b)
        return "".join([*out, text[pos:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [blank(t.as_py(), x.as_py()) if t.is_valid else None for t, x in zip(b.column(at), b.column(extra))]
            columns = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(len(names)) if k != extra]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n in names if n != "__added"])

    out = batches_of(wide, 800).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
