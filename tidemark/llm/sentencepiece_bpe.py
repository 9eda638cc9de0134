"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies, by a score-ordered agenda of adjacent symbol pairs.

No piece of such a vocabulary has a space mark after another letter, so merges never cross from one word to the next;
a text is encoded word by word, and words met before come from a bounded memory. Each word that is new to a worker, and
some whole texts of every Arrow batch, are held against the sentencepiece library.
"""

from __future__ import annotations

import codecs
import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import Memory, by_words, chosen_text

MARK = "▁"
#: Words up to so many letters take the agenda as a list, others as a heap: the same order of merges.
SHORT = 40
codecs.register_error("each_byte_replaced", lambda e: ("�" * (e.end - e.start), e.end))


class PieceModel:
    """The pieces of a model file and what its text rules ask for."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.library
        self.pieces = [sp.id_to_piece(k) for k in range(sp.get_piece_size())]
        self.scores = [sp.get_score(k) for k in range(len(self.pieces))]
        special = [sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) for k in range(len(self.pieces))]
        self.ids = {p: k for k, p in enumerate(self.pieces) if not special[k]}
        self.bytes = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if sp.is_byte(k)}
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        self.cost = {p: -self.scores[k] for p, k in self.ids.items()}  # the higher the score the earlier a pair merges
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes over a word's end: this vocabulary can't be encoded word by word")
        if any(sp.is_unused(k) for k in range(len(self.pieces))) or len(self.bytes) != 256:
            raise ValueError("vocabularies with unused pieces or without byte pieces aren't supported")
        if sp.normalize(" a  é ") != MARK + MARK + "a" + MARK * 2 + "é" + MARK:
            raise ValueError("only vocabularies that keep texts as they are, with one space put before, are supported")
        self.surface = [b"" if sp.is_control(k) else b" \xe2\x81\x87 " if sp.is_unknown(k) else bytes([int(p[3:5], 16)]) if sp.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(self.pieces)]

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word (marks for spaces). The best pair of neighbours, the leftmost of equals, merges until none is left."""
        symbols = self._merged_short(word) if len(word) <= SHORT else self._merged_long(word)
        try:
            return [self.ids[s] for s in symbols]
        except KeyError:
            return [k for s in symbols for k in ([self.ids[s]] if s in self.ids else [self.bytes[x] for x in s.encode()])]

    def _merged_short(self, word: str) -> list[str]:
        """The agenda is a list with the cost of each pair in place: for few symbols that beats a heap."""
        symbols, never, cost = list(word), float("inf"), self.cost.get
        agenda = [cost(a + b, never) for a, b in zip(word, word[1:])]
        while agenda and (best := min(agenda)) != never:
            i = agenda.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(symbols[i] + symbols[i + 1], never)
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + symbols[i], never)
        return symbols

    def _merged_long(self, word: str) -> list[str]:
        """The agenda is a heap; pairs whose symbols have merged otherwise meanwhile are passed over."""
        symbols: list[str | None] = list(word)
        n = len(symbols)
        agenda = [(self.cost[a + b], k, k + 1, a + b) for k, (a, b) in enumerate(zip(word, word[1:])) if a + b in self.cost]
        heapify(agenda)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            _, i, j, piece = heappop(agenda)
            a, b = symbols[i], symbols[j]
            if a is None or b is None or right[i] != j or a + b != piece:
                continue
            symbols[i], symbols[j] = piece, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (pair := piece + symbols[k]) in self.cost:
                    heappush(agenda, (self.cost[pair], i, k, pair))
            k = left[i]
            if k >= 0 and (pair := symbols[k] + piece) in self.cost:
                heappush(agenda, (self.cost[pair], k, i, pair))
        return [s for s in symbols if s is not None]

    def checked(self, words: list[str]) -> list[list[int]]:
        """The ids of words that begin with a mark, each held against the library."""
        own = [self.encode_word(w) for w in words]
        # the library puts a mark of its own before a text, unless it's empty: a lone mark can't be asked for
        theirs = self.library.encode([w[1:].replace(MARK, " ") for w in words], num_threads=1)
        for w, a, b in zip(words, own, theirs):
            if a != b and w != MARK:
                raise ValueError(f"the library encodes {w!r} in another way")
        return own

    def decode(self, ids: list[int]) -> str:
        surface = self.surface
        out = b"".join([surface[k] for k in ids])
        first = next((k for k in ids if surface[k]), None)
        if first is not None and self.pieces[first].startswith(MARK):
            out = out[1:]  # the space that encoding put before the text
        return out.decode("utf-8", "each_byte_replaced")


_WORDS = re.compile(f"{MARK}+[^{MARK}]*")
_models: dict[str, tuple[PieceModel, Memory]] = {}


def _model(path: str) -> tuple[PieceModel, Memory]:
    if path not in _models:
        _models[path] = PieceModel(path), Memory(400_000)
    return _models[path]


def _words(text: str) -> list[str]:
    """The words of a text, each with the marks before it; the first has one that encoding puts there."""
    if "  " in text or MARK in text or text[:1] == " " or text[-1:] == " ":
        return _WORDS.findall(MARK + text.replace(" ", MARK))
    return [MARK + w for w in text.split(" ")]


def encode_texts(texts: list[str | None], path: str, end: bool = True, longest: bool = True) -> list[bytes]:
    """The ids of each text, as the bytes of 32-bit integers. A null is an empty text.

    One text chosen by its hash, and the longest if longest is set, are held against the library as a whole.
    """
    model, memory = _model(path)
    tail = np.int32(model.end).tobytes() if end else b""
    out = [ids + tail for ids in by_words(texts, _words, lambda words: [array("i", ids).tobytes() for ids in model.checked(words)], memory)]
    for k in chosen_text(texts, longest):
        if np.frombuffer(out[k], np.int32).tolist() != model.library.encode(texts[k], add_eos=end):
            raise ValueError("the library encodes a text in another way")
    return out


def _lists(parts: list[bytes]) -> pa.Array:
    """list<int> from the bytes of each list."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _with(docs: DataFrame, name: str, kind: str, make) -> DataFrame:
    if name in docs.columns:
        raise ValueError(f"docs has a column {name} already")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):  # long texts: no more of them at once
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, make(part, not at)], [*part.schema.names, name])

    return docs.mapInArrow(run, docs.select("*", F.lit(None).cast(kind).alias(name)).schema)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", end: bool = True) -> DataFrame:
    """docs with one more column, the ids of each whole text (array<int>), with the end id if end is set.

    A null text is an empty one. Rows keep their other columns, repeated rows and empty tables stay as they are; a column named
    ids_col raises.
    """
    at = docs.columns.index(text_col)
    return _with(docs, ids_col, "array<int>", lambda b, first: _lists(encode_texts(b.column(at).to_pylist(), model_path, end, longest=first)))


def decode(docs: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with one more column, the text that the ids stand for. Null ids decode to an empty text; ids out of range raise.

    Of each 256 rows one chosen by its hash, and the longest of each batch, are held against the library. Repeated rows and
    empty tables stay as they are; a column named text_col raises.
    """
    at = docs.columns.index(ids_col)

    def make(b: pa.RecordBatch, first: bool) -> pa.Array:
        model, _ = _model(model_path)
        lists = b.column(at)
        flat, ends = lists.flatten().to_numpy().tolist(), np.cumsum(lists.value_lengths().fill_null(0)).tolist()
        spans = list(zip([0, *ends], ends))
        own = [model.decode(flat[i:j]) for i, j in spans]
        for k in chosen_text(own, first):
            if own[k] != model.library.decode(flat[spans[k][0] : spans[k][1]]):
                raise ValueError("the library decodes some ids in another way")
        return pa.array(own, pa.string())

    return _with(docs, text_col, "string", make)
