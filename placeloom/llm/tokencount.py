"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates all vocabulary pieces in a text; the dynamic program keeps
for each place only the best score and the number of ids of its path.  Starts are visited from
left to right, and a path replaces another to the same place only if it is strictly better, which
is the tokenizer's rule for ties.  Characters without a piece cost ``unk`` each and count as their
bytes if the vocabulary falls back on bytes; else a run of them is one id.  Any file of pieces with scores will do; its scores
are taken as log-probabilities, whatever procedure learned them, and placeholders with scores of
a billion below zero are left out as unused.

If no piece has the word mark after another character, all paths meet at every word start, and if
scores are whole numbers their sums are exact: then a word's count does not depend on what
precedes it and is kept for reuse.  Otherwise the program runs over the text in one go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.llm.common import batches_of

MARK = "▁"
#: Pieces at or under this score are placeholders that no encoding may use.
NEVER = -1e8
RUN = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class UnigramCounter:
    """Counts the ids of texts under the pieces and scores of a model file."""

    def __init__(self, path: str, limit: int = 200_000):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            model = pb.ModelProto.FromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap:
            raise ValueError("vocabularies with a character map are not supported")
        self.prefix, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.bytes = model.trainer_spec.byte_fallback
        kind = pb.ModelProto.SentencePiece
        usable = [p for p in model.pieces if p.type == kind.USER_DEFINED or p.type == kind.NORMAL and p.score > NEVER]
        scores = [p.score for p in usable if p.type == kind.NORMAL]
        self.unk = float(np.float32(np.float32(min(scores)) - np.float32(10.0)))
        top = float(np.float32(max(scores)))
        self.machine = ahocorasick.Automaton()
        whole = True
        self.cuts = True
        for p in usable:
            size = len(p.piece.encode())
            score = size * top - 0.1 if p.type == kind.USER_DEFINED else float(np.float32(p.score))
            whole = whole and score == int(score)
            inner = p.piece.lstrip(MARK)
            self.cuts = self.cuts and MARK not in inner
            self.machine.add_word(p.piece, (len(p.piece), score))
        self.machine.make_automaton()
        self.marked = any(p.piece == MARK for p in usable)  # the mark is never unknown
        self.whole = whole and self.unk == int(self.unk)
        self.limit = limit
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def normal(self, text: str) -> str:
        """The text as the model sees it: spaces as marks, one put before it."""
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    def run(self, s: str) -> int:
        """Number of ids of the best path of ``s``."""
        n = len(s)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]  # by start, shortest first
        for end, piece in self.machine.iter(s):
            ends[end + 1 - piece[0]].append(piece)
        best = [-np.inf] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        unknown = [False] * (n + 1)  # whether the best path to here ends with an unknown character
        for i in range(n):
            here, ids = best[i], count[i] + 1
            pieces = ends[i]
            if not pieces or pieces[0][0] != 1:  # the automaton gives shorter pieces of a start first
                c = here + self.unk
                if c > best[i + 1]:
                    best[i + 1] = c
                    count[i + 1] = ids - 1 + (len(s[i].encode("utf-8", "surrogatepass")) if self.bytes else not unknown[i])
                    unknown[i + 1] = True
            for size, w in pieces:
                c = here + w
                if c > best[i + size]:
                    best[i + size] = c
                    count[i + size] = ids
                    unknown[i + size] = False
        return count[n]

    def word(self, w: str) -> int:
        x = self.old.get(w)
        if x is None:
            x = self.run(w)
        if len(w) <= 200:
            self.young[w] = x
            if len(self.young) > self.limit:
                self.old, self.young = self.young, {}
        return x

    def count(self, text: str | None) -> int:
        """Number of ids of a whole text; null is as empty."""
        s = self.normal(text or "")
        # without byte fallback a run of unknown characters may go on over a word's end
        if not (s and self.cuts and self.whole and (self.bytes or self.marked)):
            return self.run(s) if s else 0
        if MARK + MARK not in s:
            first, *rest = s.split(MARK)
            words = [first, *map(MARK.__add__, rest)] if first else map(MARK.__add__, rest)
        else:
            words = RUN.findall(s)  # a run of marks and what follows it
        total = 0
        for w in words:
            x = self.young.get(w)
            total += self.word(w) if x is None else x
        return total


_counters: dict[str, UnigramCounter] = {}


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and n_tokens (long) of each row's whole text.

    ``model_path`` must exist on every executor.  Null and empty texts have none; repeated rows
    are counted each; other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(model_path) or _counters.setdefault(model_path, UnigramCounter(model_path))
        for b in batches:
            counts = [counter.count(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return batches_of(docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))).mapInArrow(run, f"doc_id {kind}, n_tokens long")
