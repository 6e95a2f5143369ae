"""SentencePiece BPE encoding and decoding with a table of each prefix's last token.

In a text's encoding every part between two token borders is the encoding of that part, and a sequence of tokens is
an encoding exactly if each neighbouring pair is one. So each prefix has a unique last token: of the tokens that
end there (an Aho-Corasick automaton gives them, longest first), the one whose left neighbour, the last token of the
prefix before it, is compatible: merging the two tokens' characters gives the two tokens back. While a token is
merged, its first and last symbols grow step by step; two tokens are compatible unless a last symbol of the left one
and a first symbol of the right one make a piece that is due before either symbol is merged on within its own token.
The ids of a text are then read from the table backwards. The time is linear in the text, whatever its words are.

Texts are cut at places that no piece of the vocabulary spans (before a space, around line feeds), and the ids of
short parts are remembered in a dictionary of bounded size, as are compatible pairs. Characters without a piece are
encoded as their bytes.

Supported are BPE models with byte fallback, the identity normalizer, a space put before the text, and spaces kept;
`load` refuses others. Defined results: a null or empty text has the begin and end ids only and decodes to an empty
text; a literal U+2581 is a space to the model and decodes as one; strings like <s> in a text are ordinary text;
repeated rows have equal ids; no text is cut short.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm._common import fresh

SPACE = "▁"
#: Entries of a worker's dictionaries of parts and of pairs, and the length of parts worth remembering.
REMEMBER = 150_000
SHORT = 48

NEVER = float("-inf")

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


Growth = tuple[tuple[str, float], ...]


def _grown(piece: str, scores: dict[str, float]) -> tuple[Growth, Growth] | None:
    """The first and the last symbols that a piece has while it is merged from its characters; None if it isn't."""
    parts, first, last = list(piece), [], []
    while len(parts) > 1:
        due = [(-scores[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in scores]
        if not due:
            return None
        score, i = min(due)
        if i == 0:
            first.append((parts[0], -score))
        if i == len(parts) - 2:
            last.append((parts[-1], -score))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (*first, (piece, NEVER)), (*last, (piece, NEVER))


@dataclass
class Codec:
    """Encodes and decodes; holds plain values, and builds its automaton where it is first used."""

    pieces: list[str]
    scores: dict[str, float]  # of ordinary pieces
    ids: dict[str, int]  # of ordinary pieces
    byte_ids: list[int]
    bos: int
    eos: int
    unk: int
    firsts: dict[str, Growth]  # of a token: its first symbols, and the score at which each is merged on
    lasts: dict[str, Growth]
    parts: dict[str, bytes] = field(default_factory=dict)
    older: dict[str, bytes] = field(default_factory=dict)  # what parts held before it was full
    pairs: dict[tuple[str, str], bool] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Codec:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        trainer, norm = model.trainer_spec, model.normalizer_spec
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces:
            raise ValueError(f"{path}: not a BPE model of the supported kind")
        if any(p.type in (p.USER_DEFINED, p.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: user-defined and unused pieces aren't supported")
        sp = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        plain = {p.piece: i for i, p in enumerate(model.pieces) if p.type == p.NORMAL}
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        scores = {p: model.pieces[i].score for p, i in plain.items()}
        grown = {p: g for p in plain if (g := _grown(p, scores))}  # other pieces never come out of merging
        return cls(
            [p.piece for p in model.pieces], scores, plain, byte_ids, sp.bos_id(), sp.eos_id(), sp.unk_id(),
            {p: g[0] for p, g in grown.items()}, {p: g[1] for p, g in grown.items()},
        )

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("pieces", "scores", "ids", "byte_ids", "bos", "eos", "unk", "firsts", "lasts")} | {"parts": {}, "older": {}, "pairs": {}}

    def _build(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece in self.firsts:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        spanned = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        breaks = "" if any("\n" in p and len(p) > 1 for p in self.ids) else "\n"
        self.cut = re.compile("(?s).+" if spanned else f"{SPACE}*[^{SPACE}{breaks}]+|{SPACE}+" + ("|\n" if breaks else "")).findall
        self.packed = {p: i.to_bytes(4, "little") for p, i in self.ids.items()} | {self.pieces[i]: i.to_bytes(4, "little") for i in self.byte_ids}
        self.ends = self.bos.to_bytes(4, "little"), self.eos.to_bytes(4, "little")
        self.surface = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            self.surface[i] = bytes([b])
        self.surface[self.bos] = self.surface[self.eos] = b""
        self.surface[self.unk] = " ⁇ ".encode()

    def _compatible(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 2 * REMEMBER:
                self.pairs.clear()
            known = self.pairs[left, right] = not self._crossed(left, right)
        return known

    def _crossed(self, left: str, right: str) -> bool:
        """Whether merging joins the two; of equal scores the leftmost pair is due first."""
        score, firsts = self.scores.get, self.firsts.get(right) or ((right, NEVER),)
        for x, x_until in self.lasts.get(left) or ((left, NEVER),):
            for y, y_until in firsts:
                due = score(x + y)
                if due is not None and due > x_until and due >= y_until:
                    return True
        return False

    def tokens(self, part: str) -> list[str]:
        """The tokens of a text between two places that no token spans."""
        last: list[str | None] = [None] * len(part)  # of the prefix that ends with each character
        known = self.pairs.get
        for end, token in self.automaton.iter(part):
            if last[end] is None:
                before = end - len(token)
                if before < 0:
                    last[end] = token
                else:
                    left = last[before] or part[before]  # a character without a piece stands for itself
                    fits = known((left, token))
                    if self._compatible(left, token) if fits is None else fits:
                        last[end] = token
        out, at = [], len(part) - 1
        while at >= 0:
            token = last[at] or part[at]
            out.append(token)
            at -= len(token)
        out.reverse()
        return out

    def _part_ids(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            packed = self.packed
            ids = b"".join([packed.get(t) or b"".join(packed[f"<0x{b:02X}>"] for b in t.encode()) for t in self.tokens(part)])
        if len(part) <= SHORT:
            if len(self.parts) >= REMEMBER:
                self.older, self.parts = self.parts, {}
            self.parts[part] = ids
        return ids

    def pack(self, text: str | None) -> bytes:
        """The ids with begin and end, as little-endian unsigned 32-bit integers."""
        if not hasattr(self, "cut"):
            self._build()
        known, make = self.parts.get, self._part_ids
        parts = self.cut(SPACE + text.replace(" ", SPACE)) if text else ()
        return self.ends[0] + b"".join([known(p) or make(p) for p in parts]) + self.ends[1]

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.pack(text), "<u4")

    def decode(self, ids: Iterable[int]) -> str:
        if not hasattr(self, "cut"):
            self._build()
        ids = [i for i in ids if i not in (self.bos, self.eos)]
        head = self.surface[ids[0]] if ids else b""
        if ids and self.pieces[ids[0]].startswith(SPACE):
            head = head[1:]
        return (head + b"".join(map(self.surface.__getitem__, ids[1:]))).decode("utf-8", "each_byte")


_IDS, _TEXT = ("binary", pa.binary()), ("string", pa.string())


def _mapped(df: DataFrame, codec: Codec, column: str, made: dict[str, tuple[str, pa.DataType]], one: Callable[[Codec, object], tuple], keep: bool = True) -> DataFrame:
    """df with columns at the end: what `one` makes of each value of a column, which stays only if keep."""
    shared = df.sparkSession.sparkContext.broadcast(codec)  # as large as the vocabulary
    at, held = df.columns.index(column), [i for i, c in enumerate(df.columns) if keep or c != column]
    wide = df if keep else df.drop(column)
    for name, (kind, _) in made.items():
        wide = wide.withColumn(fresh(wide, name), F.lit(None).cast(kind))
    schema, fields, types = wide.schema, wide.columns, [t for _, t in made.values()]

    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                rows = [one(shared.value, x.as_py()) for x in batch.column(at)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in held), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], fields)

    return df.mapInArrow(mapped, schema)


def _pack(codec: Codec, text: str | None) -> tuple[bytes]:
    return (codec.pack(text),)


def _unpack(codec: Codec, ids: bytes | None) -> tuple[str]:
    return (codec.decode(np.frombuffer(ids or b"", "<u4").tolist()),)


def _pack_unpack(codec: Codec, text: str | None) -> tuple[bytes, str]:
    ids = codec.pack(text)
    return (ids, *_unpack(codec, ids))


def encode(df: DataFrame, codec: Codec, text: str = "text", name: str = "ids") -> DataFrame:
    """df with a binary column at the end: the ids, begin and end included, as little-endian 32-bit integers."""
    return _mapped(df.withColumn(text, F.col(text).cast("string")), codec, text, {name: _IDS}, _pack)


def decode(df: DataFrame, codec: Codec, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """df with a string column at the end: the text of a column of packed ids (null: none)."""
    return _mapped(df, codec, ids, {name: _TEXT}, _unpack)


def encode_decode(df: DataFrame, codec: Codec, text: str = "text") -> DataFrame:
    """df without its text but with columns ids and decoded (see encode and decode) at the end, in one pass."""
    return _mapped(df.withColumn(text, F.col(text).cast("string")), codec, text, {"ids": _IDS, "decoded": _TEXT}, _pack_unpack, keep=False)
