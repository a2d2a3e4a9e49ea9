"""Token counts of whole texts by byte-pair merging with a heap over a linked list.

The library's file gives the pieces and their scores; the merging is done here, since only
its number of steps is asked for. A text starts as one symbol a character, where a character
that is no piece counts as many times as it has bytes. The adjacent pair that makes the piece
of the best score, the leftmost of equals, is merged first: pairs wait in a heap, and a linked
list of symbols (each start knows its end and the start before it) tells which of them still
stand. The count is the symbols less the merges; no identifiers are made.

No merge crosses a place whose two characters stand side by side in no piece. Texts are cut
there, which changes no merge, and a worker remembers the counts of the parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import Forest
from ._store import pieces

#: Parts of texts that a worker remembers, and their longest; longer ones are counted anew.
REMEMBERED, LONGEST = 700_000, 64
#: What stands for a space in pieces.
SPACE = "▁"


class PairMerger:
    """Counts the tokens of texts by the pieces of a model file with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = model = SentencePieceProcessor(model_file=path)
        special = (model.is_unknown, model.is_control, model.is_byte, model.is_unused)
        plain = [i for i in range(model.get_piece_size()) if not any(f(i) for f in special)]
        scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        order = {s: n for n, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.single = {t for t in scores if len(t) == 1}
        self.rank = {t: order[s] for t, s in scores.items() if len(t) > 1}
        letters = {c for t in self.rank for c in t}
        if not letters <= self.single:
            raise ValueError("a piece has a character that is no piece by itself")
        self.joined = letters
        self.known: dict[str, int] = {}
        self.parts = re.compile(self._pattern()).findall

    def _pattern(self) -> str:
        """Parts: spaces before characters that meet each other in pieces, and all that joins nothing."""
        if any(SPACE in t.lstrip(SPACE) for t in self.rank):
            return "(?s).+"  # a space is joined to what stands before it: nowhere to cut
        letters = sorted(self.joined - {SPACE})
        at = {c: n for n, c in enumerate(letters)}
        met = Forest(len(letters))
        for t in self.rank:
            inner = t.lstrip(SPACE)
            for a, b in zip(inner, inner[1:]):
                met.union(at[a], at[b])
        classes: dict[int, str] = {}
        for c in letters:
            root = met.find(at[c])
            classes[root] = classes.get(root, "") + re.escape(c)
        inside = "".join(classes.values())
        common = sorted(classes.values(), key=len, reverse=True)
        return "|".join([*(f"{SPACE}*[{c}]+" for c in common), f"{SPACE}+", f"[^{SPACE}{inside}]+"])

    def merged(self, part: str) -> int:
        """Symbols of a part of joining characters less its merges."""
        n = total = len(part)
        rank, size = self.rank.get, n + 1
        # A waiting pair is its rank, its start and its length, as one number.
        heap = [(r * size + i) * size + 2 for i in range(n - 1) if (r := rank(part[i : i + 2])) is not None]
        heapify(heap)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            start, length = divmod(heappop(heap), size)
            i = start % size
            middle = end[i]
            # A start that went into another symbol has the end 0.
            if not middle or middle == n or end[middle] - i != length:
                continue
            stop = end[i] = end[middle]
            end[middle] = 0
            total -= 1
            if stop < n:
                before[stop] = i
                if (r := rank(part[i : end[stop]])) is not None:
                    heappush(heap, (r * size + i) * size + end[stop] - i)
            left = before[i]
            if left >= 0 and (r := rank(part[left:stop])) is not None:
                heappush(heap, (r * size + left) * size + stop - left)
        return total

    def count(self, part: str) -> int:
        if part[-1] in self.joined:
            return self.merged(part)
        return sum(1 if c in self.single else len(c.encode()) for c in part)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        known, count = self.known, self.count
        out = []
        for text in self.model.normalize(texts):
            parts = self.parts(text)
            try:
                out.append(sum(map(known.__getitem__, parts)))
            except KeyError:
                if len(known) > REMEMBERED:
                    known.clear()
                known.update((p, count(p)) for p in set(parts).difference(known) if len(p) <= LONGEST)
                out.append(sum(known[p] if len(p) <= LONGEST else count(p) for p in parts))
        return out


_workers: dict[str, PairMerger] = {}


def merger(path: str) -> PairMerger:
    """One merger for each Python worker."""
    if path not in _workers:
        _workers[path] = PairMerger(path)
    return _workers[path]


def _counted(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            counts = merger(path).counts([t or "" for t in b.column("text").to_pylist()])
            size = pc.cast(pc.fill_null(pc.binary_length(b.column("text")), 0), pa.int64())
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``, by the model file at ``path``.

    ``n_tokens`` is what the library gives without begin and end; special strings inside texts
    are ordinary text. A null text counts as empty and has no token. Rows of a null id and
    repeated rows each have their count. Texts of any length are counted whole: a task holds
    one text and the heap of one part of it at a time. An empty table gives an empty result;
    other columns, of any name, are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counted(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
