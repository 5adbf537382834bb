"""BPE encoding and decoding with content-defined chunk reuse.

A gear rolling hash over the last 32 bytes cuts a text where its top bits are zero, so equal
passages of different documents fall into equal chunks whatever surrounds them.  A chunk's inner
words (between its first and last white space) are encoded once and reused.  What is open at the
join of two chunks - the end of one and the start of the next - is repaired by re-encoding the
word it forms.  The repair is accepted only if encoding it together with the words on either side
gives exactly the ids put together; otherwise the window doubles, until its outer words agree with
their own encoding or it is the whole document.

Chunks are kept in each Python worker, in two generations of bounded bytes, the only chunk of a
short text too; a lost executor loses nothing but the reuse.  ``ChunkEncoder.served`` counts the
bytes that came from kept chunks.  Within a new chunk, words are kept in the same way: white space
always ends a word for this tokenizer (it is dropped before the merges).
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.llm.common import batches_of

GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64)
WHITE = b" \t\n\x0b\x0c\r"
#: Symbols that the pre-tokenizer always splits from letters before them, and that begin no special token.
TAIL = b".,!?;:#$%&*"


def cut_points(data: bytes, mean_bits: int = 11) -> np.ndarray:
    """Content-defined cuts inside ``data``, one in 2**mean_bits bytes on average, never within a character."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < 64:
        return np.empty(0, np.int64)
    h = GEAR[b]
    for step in (1, 2, 4, 8, 16):  # the sum over the last 32 bytes, each shifted by its distance
        h[step:] = h[step:] + (h[:-step] << np.uint64(step))
    at = np.flatnonzero(h[31:-1] >> np.uint64(64 - mean_bits) == 0) + 32
    return at[(b[at] & 0xC0) != 0x80]


class Kept:
    """A dictionary of two generations: when the young one is full, it replaces the old one."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old, self.size = limit, {}, {}, 0

    def get(self, key: bytes):
        x = self.young.get(key)
        if x is None and (x := self.old.get(key)) is not None:
            self.put(key, x, len(key) * 4 + 200)
        return x

    def put(self, key: bytes, value: tuple, cost: int) -> None:
        self.young[key] = value
        self.size += cost
        if self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0


class ChunkEncoder:
    """Encodes whole texts; an encoded piece is (decimal ids, decoded text), each id and token followed by one space."""

    def __init__(self, path: str, cache_mb: int = 150):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words, self.chunks = Kept(cache_mb * 1_000_000 * 3 // 4), Kept(cache_mb * 1_000_000 // 4)
        self.fresh: dict[bytes, tuple] = {}
        self.served = self.seen = 0  # bytes from kept chunks, and all

    def encode_plain(self, data: bytes) -> tuple:
        return self.piece(self.tokenizer.encode(data.decode(), add_special_tokens=False).ids)

    def piece(self, ids: list[int]) -> tuple:
        decoded = self.tokenizer.decode(ids, skip_special_tokens=False) if ids else ""
        return self.spaced(ids, decoded)

    @staticmethod
    def spaced(ids: list[int], decoded: str) -> tuple[bytes, bytes]:
        return (" ".join(map(str, ids)).encode() + b" ", decoded.encode() + b" ") if ids else (b"", b"")

    def learn(self, words: set[bytes]) -> None:
        """Encodes the words that are not kept, in one call."""
        self.fresh = fresh = {}
        young, old, new = self.words.young, self.words.old, []
        for w in words:
            x = young.get(w)
            if x is None:
                x = old.get(w)
                if x is None:
                    new.append(w)
                    continue
                self.words.put(w, x, 4 * len(w) + 300)
                young = self.words.young
            fresh[w] = x
        # letters followed by symbols are two pieces whatever they are, and case is dropped
        split = {}
        for w in new:
            stem = w.rstrip(TAIL)
            key = stem.lower() if stem.isalpha() else stem if stem and len(stem) < len(w) and unicodedata.normalize("NFC", stem.decode()).lower().isalpha() else w
            if key != w:
                split[w] = (key, w[len(stem) :])
        if split:
            parts = {p for pair in split.values() for p in pair if p}
            self.learn(parts)
            known, self.fresh = self.fresh, fresh
            for w, (a, b) in split.items():
                x, y = known[a], known[b] if b else (b"", b"")
                x = fresh[w] = (x[0] + y[0], x[1] + y[1])
                if len(w) <= 256:
                    self.words.put(w, x, 4 * len(w) + 300)
            rest, new = new, []
            for w in rest:
                if w in known:
                    fresh[w] = known[w]
                elif w not in split:
                    new.append(w)
        if new:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)]
            texts = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
            for w, i, t in zip(new, ids, texts):
                x = self.fresh[w] = self.spaced(i, t)
                if len(w) <= 256:
                    self.words.put(w, x, 4 * len(w) + 300)

    @staticmethod
    def parts(data: bytes) -> tuple[bytes, list[bytes] | None, bytes]:
        """What a chunk holds before its first white space, its inner words, and what follows its last; None without white space."""
        inner = data.split()
        if not inner:
            return (b"", [], b"") if data else (b"", None, b"")
        if len(inner) == 1 and len(inner[0]) == len(data):
            return data, None, b""
        head = b"" if data[0] in WHITE else inner.pop(0)
        tail = b"" if data[-1] in WHITE else inner.pop()
        return head, inner, tail

    def gather(self, words: list[bytes]) -> tuple:
        known = list(map(self.fresh.__getitem__, words))
        return b"".join([x[0] for x in known]), b"".join([x[1] for x in known])

    def join(self, before: bytes, word: bytes, after: bytes) -> tuple | None:
        """The repaired piece of a join, or None if it doesn't agree with its surroundings."""
        own = self.fresh[word]
        around = [w for w in (before, word, after) if w]
        window = self.tokenizer.encode(b" ".join(around).decode(), add_special_tokens=False).ids
        apart = b"".join([self.fresh[w][0] for w in around])
        return own if self.spaced(window, "")[0] == apart else None

    def repair(self, data: bytes, at: int) -> tuple:
        """The whole text's piece, where the word across byte ``at`` doesn't agree with its neighbours.

        The window of words that is encoded together doubles until the words at its ends come out
        as they do alone (or the text ends there); what is outside is put together from words.
        """
        words = data.split()
        self.learn(set(words))
        place, size = max(0, len(data[:at].split()) - 1), 1
        while True:
            lo, hi = max(0, place - size), min(len(words), place + size + 1)
            inner = self.encode_plain(b" ".join(words[lo:hi]))
            left = lo == 0 or inner[0].startswith(self.fresh[words[lo]][0])
            right = hi == len(words) or (b" " + inner[0]).endswith(b" " + self.fresh[words[hi - 1]][0])
            if left and right or lo == 0 and hi == len(words):
                parts = self.gather(words[:lo]), inner, self.gather(words[hi:])
                return b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])
            size *= 2

    def encode(self, texts: list[str | None]) -> list[tuple]:
        """(number of ids, ids, decoded text) of each text; null is as empty."""
        plans, need = [], set()
        for t in texts:
            data = (t or "").encode()
            cuts = cut_points(data).tolist()
            plan, chunks = [], [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
            self.seen += len(data)
            for c in chunks:
                kept = self.chunks.get(c)
                if kept is None:
                    head, inner, tail = self.parts(c)
                    if inner:
                        need.update(inner)
                    plan.append((c, head, inner, tail))
                else:
                    self.served += len(c)
                    plan.append((c, *kept))
            # the words at the joins, with what is on their left and right
            joins, open_, left = [], b"", b""
            for k, (_, head, inner, tail, *rest) in enumerate(plan):
                if inner is None:
                    open_ += head
                    continue
                ends = rest[1] if rest else (inner[0], inner[-1]) if inner else (b"", b"")
                if open_ or head:
                    joins.append((k, left, open_ + head, ends[0], bool(open_) and bool(head)))
                open_, left = tail, ends[1] or left
            joins.append((len(plan), left, open_, b"", False))
            for _, a, w, b, _ in joins:
                need.update(x for x in (a, w, b) if x)
            plans.append((data, plan, joins))
        self.learn(need)
        known = self.fresh
        out = []
        for data, plan, joins in plans:
            self.fresh = known
            pieces, at, failed, end = [], 0, [], 0
            for k, (c, head, inner, tail, *rest) in enumerate([*plan, (b"", b"", None, b"")]):
                if at < len(joins) and joins[at][0] == k:
                    _, a, w, b, across = joins[at]
                    at += 1
                    piece = (self.join(a, w, b) if across else self.fresh[w]) if w else (b"", b"")
                    if piece is None:
                        failed.append(end)
                        piece = (b"", b"")
                    pieces.append(piece)
                end += len(c)
                if inner is None:
                    continue
                if rest:
                    pieces.append(rest[0])
                else:
                    body = self.gather(inner)
                    pieces.append(body)
                    kept = (head, (), tail, body, (inner[0], inner[-1]) if inner else (b"", b""))
                    self.chunks.put(c, kept, 2 * len(c) + len(body[0]) + len(body[1]) + 500)
            if failed:
                pieces = [self.repair(data, failed[0]) if len(failed) == 1 else self.encode_plain(data)]
            ids = b"".join([p[0] for p in pieces])
            out.append((ids.count(b" "), ids[:-1], b"".join([p[1] for p in pieces])[:-1]))
        return out


_encoders: dict[str, ChunkEncoder] = {}


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", group_bytes: int = 8_000_000) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens (long), ids (decimal, joined by one space), decoded.

    Equal to the tokenizers library's ids of the whole text without added special tokens, and to
    its decoding of them.  ``tokenizer_path`` must exist on every executor.  Null texts are as
    empty ones: no ids, empty decoding.  Other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer_path) or _encoders.setdefault(tokenizer_path, ChunkEncoder(tokenizer_path))
        for batch in batches:
            sizes = np.cumsum([len(x) if x is not None else 0 for x in (s.as_buffer() if s.is_valid else None for s in batch.column(1).cast(pa.large_binary()))])
            edges = np.flatnonzero(np.diff(sizes // group_bytes, prepend=0)).tolist()
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
                if lo < hi:
                    found = encoder.encode(batch.column(1).slice(lo, hi - lo).to_pylist())
                    n, ids, decoded = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(ids, pa.binary()).cast(pa.string()), pa.array(decoded, pa.binary()).cast(pa.string())],
                        names=["doc_id", "n_tokens", "ids", "decoded"],
                    )

    return batches_of(docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids string, decoded string")
