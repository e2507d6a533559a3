"""Exact token counts at every prefix of a text.

A byte-level BPE splits a text before white space that follows other characters, so the text falls into units
(white space, then non-space) that are encoded apart. Within a unit the counts of all prefixes come from dynamic
programming: the encoding of a prefix ends in the one token whose pair with the last token of the shorter prefix is
stable under the merges, and has one token more than that prefix. The table keeps the step from each count to the
next as 16-bit integers, one per character; totals, truncation and budgets are read from it without encoding again.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkclean.llm.common import Remembered, bounded_batches, worker_cache

CACHED_BYTES = 30_000_000  # of a generation of units, and of pre-tokens
CACHED_LENGTH = 64
# Unicode white space as the tokenizer's patterns see it, and its splitting pattern.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
WHITE_CHARS = WHITE.replace("\u2000-\u200a", "".join(map(chr, range(0x2000, 0x200B))))
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounter:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        as_bytes = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"] if all(c in letters for c in t)}
        self.token = {as_bytes[t]: i for t, i in spec["model"]["vocab"].items() if t in as_bytes}
        self.text = {i: b for b, i in self.token.items()}
        self.rank = {}
        self.made_by: dict[int, tuple[int, int, int]] = {}  # token: rank and parts of its merge
        self.ordered = True  # every token is made by one merge, after its parts
        for n, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y, z = self.token[as_bytes[a]], self.token[as_bytes[b]], self.token[as_bytes[a] + as_bytes[b]]
            self.rank[x, y] = (n, z)
            made = all(p in self.made_by or len(self.text[p]) == 1 for p in (x, y))
            self.ordered = self.ordered and made and z not in self.made_by and len(self.text[z]) > 1
            self.made_by[z] = (n, x, y)
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        # states of the search for tokens that end at a byte: the longest end of the text that begins a token
        self.begins = {t[:k] for t in self.token for k in range(1, len(t) + 1)}
        self.states: dict[bytes, int] = {b"": 0}
        self.state_text: list[bytes] = [b""]
        self.ends: list[list[tuple[int, int]]] = [[]]  # of each state: size and id of the tokens it ends in, longest first
        self.next: dict[int, int] = {}  # by state * 256 + byte
        self.split = regex.compile(SPLIT)
        self.stable: dict[tuple[int, int], bool] = {}
        self.units = Remembered(CACHED_BYTES)
        self.pieces = Remembered(CACHED_BYTES)
        self.unit = re.compile(r"\s*\S+|\s+")
        self.unit_strict = re.compile(rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

    def _merged(self, ids: list[int]) -> list[int]:
        """Plain byte-pair merging of a short sequence."""
        while len(ids) > 1:
            best = min((self.rank.get(p, (1 << 60, -1)) for p in zip(ids, ids[1:])), default=(1 << 60, -1))
            if best[1] < 0:
                return ids
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.rank.get((ids[i], ids[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _crossed(self, x: int, y: int, limit: int) -> bool:
        """Whether a merge of rank below ``limit`` joins an end of token ``x`` with a start of token ``y``.

        The merges inside both tokens are undone, the later one first: the parts at the seam are those that meet
        while these merges are made. Of merges of one rank the left one comes first.
        """
        leaf = (-1, -1, -1)
        while True:
            if self.rank.get((x, y), (limit, -1))[0] < limit:
                return True
            left, right = self.made_by.get(x, leaf), self.made_by.get(y, leaf)
            if left[0] < 0 and right[0] < 0:
                return False
            if left[0] > right[0]:
                limit, x = min(limit, left[0]), left[2]
            else:
                limit, y = min(limit, right[0] + 1), right[1]

    def _whole(self, token: int) -> bool:
        """Whether the bytes of a token are encoded as this one token."""
        known = self.stable.get((-1, token))
        if known is None:
            if self.ordered and token in self.made_by:
                n, x, y = self.made_by[token]
                known = self._whole(x) and self._whole(y) and not self._crossed(x, y, n)
            elif self.ordered:
                known = len(self.text[token]) == 1  # no merge makes a longer one
            else:
                known = self._merged([self.token[bytes([c])] for c in self.text[token]]) == [token]
            self.stable[-1, token] = known
        return known

    def _fits(self, before: int, token: int) -> bool:
        """Whether the two tokens (or the one, with before = -1) encode their own bytes."""
        if before < 0:
            return self._whole(token)
        known = self.stable.get((before, token))
        if known is None:
            if len(self.stable) > 1_000_000:
                self.stable.clear()
            if self.ordered:
                known = self._whole(before) and self._whole(token) and not self._crossed(before, token, len(self.rank))
            else:
                known = self._merged([self.token[bytes([c])] for c in self.text[before] + self.text[token]]) == [before, token]
            self.stable[before, token] = known
        return known

    def _state(self, state: int, byte: int) -> int:
        """The state after one more byte; made when it is first met, at most one per beginning of a token."""
        text = self.state_text[state] + bytes([byte])
        while text and text not in self.begins:
            text = text[1:]
        if text not in self.states:
            tokens = ((len(text) - k, self.token.get(text[k:])) for k in range(len(text)))
            self.ends.append([(size, t) for size, t in tokens if t is not None and self._whole(t)])
            self.state_text.append(text)
            self.states[text] = len(self.states)
        self.next[state << 8 | byte] = self.states[text]
        return self.states[text]

    def _piece(self, piece: str) -> list[int]:
        """Counts after each character of one pre-token."""
        body = piece.encode("utf-8", "surrogatepass")
        go, known, fits, ends = self.next.get, self.stable.get, self._fits, self.ends
        last, count, state = [-1], [0], 0
        for i, byte in enumerate(body, 1):
            to = go(state << 8 | byte)
            state = self._state(state, byte) if to is None else to
            for size, t in ends[state]:
                before = last[i - size]
                good = size == i or known((before, t))
                if good or (good is None and fits(before, t)):
                    last.append(t)
                    count.append(count[i - size] + 1)
                    break
        if len(body) == len(piece):
            return count[1:]
        places = itertools.accumulate(len(c.encode("utf-8", "surrogatepass")) for c in piece)
        return [count[e] for e in places]

    def _found(self, piece: str) -> bytes:
        """Steps of a pre-token as the pattern finds it."""
        if piece in CONTRACTIONS:
            short = [self._piece(piece[:1])[-1] + (self._piece(piece[1:k])[-1] if k > 1 else 0) for k in range(1, len(piece))]
            own = [*short, self._piece(piece)[-1]]
        else:
            own = self._piece(piece)
        return struct.pack(f"<{len(own)}h", *map(sub, own, [0, *own]))

    def counts(self, unit: str) -> list[int]:
        """Counts after each character of a unit, as if the text ended there."""
        white = len(unit) - len(unit.lstrip(WHITE_CHARS))
        out, base, rest = [], 0, unit
        if white == len(unit):
            return self._piece(unit) if unit else []
        if white > 1:  # a run of white space is one piece while nothing follows; then it gives up its last character
            out = self._piece(unit[:white])
            base, rest = out[white - 2], unit[white - 1 :]
        found = b"".join(map(self._found, self.split.findall(rest)))
        own = itertools.accumulate(struct.unpack(f"<{len(found) // 2}h", found), initial=base)
        return out + list(own)[2 if white > 1 else 1 :]

    def _steps(self, units: list[str]) -> list[bytes]:
        """Steps of units; a pre-token that several units hold is computed once."""
        plain = [u if u.lstrip(WHITE_CHARS) and not u[:2].isspace() else None for u in units]
        parts = [self.split.findall(u) if u else [] for u in plain]
        short = {p for own in parts for p in own if len(p) <= CACHED_LENGTH}
        known = self.pieces.fill(short, lambda new: map(self._found, new))
        out = []
        for unit, u, own in zip(units, plain, parts, strict=True):
            if u is None:
                found = self.counts(unit)
                out.append(struct.pack(f"<{len(found)}h", *map(sub, found, [0, *found])))
            else:
                out.append(b"".join([known[p] if len(p) <= CACHED_LENGTH else self._found(p) for p in own]))
        return out

    def _units(self, text: str) -> list[str]:
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        return (self.unit_strict if odd else self.unit).findall(text)

    def steps(self, text: str) -> bytes:
        """Step of the count at every character; the sum is the token count of the whole text."""
        for mark in self.special:
            if mark in text:
                return self._with_special(text, mark)
        units = self._units(text)
        kinds = set(units)
        long = [u for u in kinds if len(u) > CACHED_LENGTH]
        known = self.units.fill(kinds.difference(long), self._steps)
        if long:
            known = {u: known[u] for u in kinds.difference(long)} | dict(zip(long, self._steps(long), strict=True))
        return b"".join(map(known.__getitem__, units))

    def _with_special(self, text: str, mark: str) -> bytes:
        out = []
        parts = text.split(mark)
        for part in parts[:-1]:
            own = self.steps(part)
            units = self._units(part)
            before = units[-1] if units else ""
            run = self.counts(before + mark)[len(before) :][:-1]  # the mark is ordinary text until it is whole
            start = self.counts(before)[-1] if before else 0
            steps = np.diff(np.array([start, *run, start + 1], np.int64)).astype("<i2")
            out += [own, steps.tobytes()]
        return b"".join([*out, self.steps(parts[-1])])


def prefix_counts(steps: bytes) -> np.ndarray:
    """Token count of every prefix, from the empty one to the whole text."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, "<i2").astype(np.int64))])


def longest_prefix(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(prefix_counts(steps) <= budget)[-1]) if budget >= 0 else 0


def _table(docs: DataFrame, path: str, id_col: str, text_col: str, fields: str, row) -> DataFrame:
    bounded_batches(docs.sparkSession, rows=500)
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = own.schema["_id"].dataType.simpleString()
    names = ["_id", *(f.split()[0] for f in fields.split(", "))]

    def run(batches):
        counter = worker_cache(f"prefix_{path}", lambda: PrefixCounter(path))
        for batch in batches:
            rows = [row(t, counter.steps(t)) for t in batch.column("_text").to_pylist()]
            columns = [pa.array(c) for c in zip(*rows, strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("_id"), *columns], names)

    return own.mapInArrow(run, f"_id {kind}, {fields}").withColumnRenamed("_id", id_col)


def prefix_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_tokens``, ``steps`` (binary, see :func:`prefix_counts`).

    ``path`` names a byte-level BPE of the tokenizers library. A special string inside a text counts as its one
    token. A null text counts as empty: no bytes, no tokens, no steps. Null ids and repeated rows are kept.
    """
    fields = "n_bytes bigint, n_tokens bigint, steps binary"

    def row(t, s):
        return len(t.encode("utf-8", "surrogatepass")), int(np.frombuffer(s, "<i2").sum(dtype=np.int64)), s

    return _table(docs, path, id_col, text_col, fields, row)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Totals of the prefix table, whether they exceed ``limit``, and ``fit_chars``: the characters of the longest
    prefix within the limit. The steps are used where they are made and are not passed on."""

    def row(t, s):
        total = int(np.frombuffer(s, "<i2").sum(dtype=np.int64))
        fit = len(t) if total <= limit else longest_prefix(s, limit)
        return len(t.encode("utf-8", "surrogatepass")), total, total > limit, fit

    return _table(docs, path, id_col, text_col, "n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint", row)


def budget_prefixes(table: DataFrame, budget: int, id_col: str = "doc_id") -> DataFrame:
    """From a prefix table: id and characters of the longest prefix of at most ``budget`` tokens."""
    kind = table.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fit = [longest_prefix(s, budget) for s in batch.column("steps").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(fit, pa.int64())], [id_col, "fit_chars"])

    return table.select(id_col, "steps").mapInArrow(run, f"`{id_col}` {kind}, fit_chars bigint")
