"""Token counts by rank-synchronous array merging.

Reads a byte-level BPE vocabulary (a tokenizers JSON file with a split pattern) and counts the tokens of whole texts.
The distinct pre-tokens of a batch lie in one ragged numpy array of symbols. In each round every sequence finds its
own lowest-rank adjacent pair and merges all occurrences of it at once, left to right; sequences with no pair left
leave the array with their number of surviving symbols. Merging all occurrences together is exact because a merge
that uses a symbol always has a later rank than the merge that makes it; `load` verifies that.

A sequence of more than LONG symbols is first cut between neighbouring bytes that no token of the vocabulary has next to
each other: no merge crosses such a place, so the pieces merge apart, in the same rounds as all others. A piece that
is still longer would need a round for each rank it uses, on an array of its length; it is merged from a queue of pairs
instead, in time n log n, with the same result. Counts of pre-tokens of at most SHORT characters that were seen before
come from a dictionary of at most REMEMBER entries and one batch's.

Defined results: a null or empty text has no tokens; special strings inside a text are one token each, as the library
has it by default; repeated rows have equal counts; no text is cut, and a very long one takes memory in proportion to
its length; an empty table gives no rows; other columns, whatever their names, pass.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm._common import fresh

LONG = 512
#: Entries of a worker's dictionary of pre-tokens, and characters of the longest that it takes.
REMEMBER = 300_000
SHORT = 64
#: Characters of text that are split and counted together.
TOGETHER = 1 << 20
_NONE = np.iinfo(np.int64).max
#: Capital letters to small ones that the library knows and Python's older tables don't.
_NEW_CASES = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B} | {0x10D50 + i: 0x10D70 + i for i in range(22)}
_NEW = re.compile(f"[{''.join(map(chr, _NEW_CASES))}]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@dataclass
class Counter:
    """Counts tokens of texts; what it holds is plain and can be sent to executors."""

    keys: np.ndarray  # sorted left * size + right
    ranks: np.ndarray  # of keys
    made: np.ndarray  # the symbol that a rank makes
    size: int
    inner: np.ndarray  # symbol of each byte within a pre-token
    last: np.ndarray  # and at its end
    pattern: str
    special: str | None
    lower: bool
    nfc: bool
    joins: np.ndarray  # for each pair of bytes (left * 256 + right) whether some token has them next to each other
    known: dict[str, int] = field(default_factory=dict)
    pairs: dict[int, int] = field(default_factory=dict)  # keys to ranks, made where a piece needs the queue

    @classmethod
    def load(cls, path: str) -> Counter:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], _flat(spec["normalizer"], "normalizers")
        splits = _flat(spec["pre_tokenizer"], "pretokenizers")
        kinds = [s["type"] for s in steps]
        if model["type"] != "BPE" or [s["type"] for s in splits] != ["Split", "ByteLevel"] or not set(kinds) <= {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"{path}: only byte-level BPE with a split pattern is supported")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocab["".join(p)] for p in pairs], np.int64)
        size = max(vocab.values()) + 1
        first = np.full(size, -1, np.int64)
        first[made[::-1]] = np.arange(len(made))[::-1]
        if (np.maximum(first[left], first[right]) >= np.arange(len(made))).any():
            raise ValueError(f"{path}: a merge comes before one that makes its parts")
        keys = left * size + right
        order = np.argsort(keys)
        symbols = byte_symbols()
        value = {x: i for i, x in enumerate(symbols)}
        joins = np.zeros(1 << 16, bool)
        for token in vocab:
            data = np.array([value[x] for x in token.removesuffix(end) if x in value], np.int64)
            joins[data[:-1] * 256 + data[1:]] = True
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        return cls(
            keys[order], order.astype(np.int64), made, size, np.array([vocab[s] for s in symbols], np.int64), np.array([vocab[s + end] for s in symbols], np.int64),
            splits[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"), "|".join(map(re.escape, special)) or None, "Lowercase" in kinds, "NFC" in kinds, joins,
        )

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many special strings stand between them."""
        parts = re.split(self.special, text) if self.special else [text]
        find, out = regex.compile(self.pattern).findall, []
        for part in parts:
            if self.nfc and not part.isascii():
                part = unicodedata.normalize("NFC", part)
            if self.lower:
                part = part.replace("Σ", "σ").lower()  # letter by letter, without the rule for a final sigma
                if not part.isascii() and _NEW.search(part):
                    part = part.translate(_NEW_CASES)
            out += find(part)
        return out, len(parts) - 1

    def counts(self, texts: list[str | None]) -> list[int]:
        found = [self.pre_tokens(t or "") for t in texts]
        if len(self.known) > REMEMBER:
            self.known.clear()
        new = [t for t in set().union(*(p for p, _ in found)) if t not in self.known]
        self.known.update(zip(new, self.merge_counts([t.encode() for t in new]).tolist(), strict=True))
        out = [sum(map(self.known.__getitem__, tokens)) + special for tokens, special in found]
        for t in new:
            if len(t) > SHORT:
                del self.known[t]
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge_counts(self, tokens: list[bytes]) -> np.ndarray:
        """How many symbols survive in each of the pre-tokens."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        out = np.ones(len(tokens), np.int64)
        of = np.flatnonzero((lengths > 1) & (lengths <= LONG)).tolist()
        pieces, ends = [tokens[i] for i in of], [True] * len(of)
        for i in np.flatnonzero(lengths > LONG).tolist():
            own = self._pieces(tokens[i])
            of += [i] * len(own)
            pieces += own
            ends += [False] * (len(own) - 1) + [True]
        out[of] = 0
        np.add.at(out, of, self._merged(pieces, ends))
        return out

    def _symbols(self, raw: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The symbols of bytes; those at the places `last` end a pre-token."""
        symbols = self.inner[raw]
        symbols[last] = self.last[raw[last]]
        return symbols

    def _pieces(self, token: bytes) -> list[bytes]:
        raw = np.frombuffer(token, np.uint8).astype(np.int64)
        cuts = np.flatnonzero(~self.joins[raw[:-1] * 256 + raw[1:]]) + 1
        return [token[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(token)], strict=True)]

    def _merged(self, pieces: list[bytes], ends: list[bool]) -> np.ndarray:
        """How many symbols survive in each piece; ends: whether it ends its pre-token."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.ones(len(pieces), np.int64)
        for i in np.flatnonzero(lengths > LONG):
            out[i] = self._queued(pieces[i], ends[i])
        at = np.flatnonzero((lengths > 1) & (lengths <= LONG))
        lengths = lengths[at]
        raw = np.frombuffer(b"".join(pieces[i] for i in at), np.uint8)
        symbols = self._symbols(raw, (np.cumsum(lengths) - 1)[np.array(ends, bool)[at]])
        while len(at):
            starts = np.cumsum(lengths) - lengths
            owner = np.repeat(np.arange(len(at)), lengths)
            rank = np.full(len(symbols), _NONE)
            rank[:-1] = self._rank(symbols[:-1], symbols[1:])
            rank[starts + lengths - 1] = _NONE
            lowest = np.minimum.reduceat(rank, starts)
            merging = np.flatnonzero((rank == lowest[owner]) & (rank < _NONE))
            if len(merging):  # of pairs that overlap, as in a run of one symbol, each second one
                run = np.flatnonzero(np.diff(merging, prepend=-2) != 1)
                within = np.arange(len(merging)) - np.repeat(run, np.diff(run, append=len(merging)))
                merging = merging[within % 2 == 0]
                symbols[merging] = self.made[rank[merging]]
            stay = np.ones(len(symbols), bool)
            stay[merging + 1] = False
            lengths = lengths - np.bincount(owner[merging], minlength=len(at))
            done = lowest == _NONE
            out[at[done]] = lengths[done]
            stay &= ~done[owner]
            symbols, at, lengths = symbols[stay], at[~done], lengths[~done]
        return out

    def _queued(self, token: bytes, end: bool) -> int:
        raw = np.frombuffer(token, np.uint8)
        n = len(raw)
        symbols = self._symbols(raw, np.array([n - 1] if end else [], np.int64))
        after, before, own = [*range(1, n), -1], [*range(-1, n - 1)], symbols.tolist()
        queue = [(int(r), i) for i, r in enumerate(self._rank(symbols[:-1], symbols[1:])) if r != _NONE]
        heapq.heapify(queue)
        if not self.pairs:
            self.pairs.update(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        pair = lambda i: self.pairs.get(own[i] * self.size + own[after[i]]) if after[i] >= 0 else None
        left = n
        while queue:
            rank, i = heapq.heappop(queue)
            if own[i] < 0 or pair(i) != rank:
                continue
            j = after[i]
            own[i], own[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            left -= 1
            for k in (before[i], i):
                if k >= 0 and (r := pair(k)) is not None:
                    heapq.heappush(queue, (r, k))
        return left


def _flat(step: dict | None, within: str) -> list[dict]:
    return [] if step is None else step[within] if step["type"] == "Sequence" else [step]


def count_tokens(df: DataFrame, path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """df with a long column at the end, called name or, if df has that, the like: the tokens of column text."""
    counter = df.sparkSession.sparkContext.broadcast(Counter.load(path))  # as large as the vocabulary
    name, at = fresh(df, name), df.columns.index(text)
    df = df.withColumn(text, F.col(text).cast("string"))
    schema = df.withColumn(name, F.lit(None).cast("long")).schema
    fields = schema.names

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found, part, chars = batch.column(at), [], [], 0
            for t in texts:
                part.append(t.as_py())
                chars += len(part[-1] or "")
                if chars > TOGETHER:
                    found += counter.value.counts(part)
                    part, chars = [], 0
            found += counter.value.counts(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], fields)

    return df.mapInArrow(counted, schema)
