"""Packs tokenised documents into sequences of one length, by cutting-stock column generation.

A document longer than a sequence fills whole sequences first; its rest is an item. A linear program over patterns (how
many items of each class of lengths share a sequence) meets the histogram of classes; a knapsack by dynamic programming
finds the next patterns worth adding. The patterns are rounded, what rounding leaves is solved again, and each pattern
takes a range of ranks of each of its classes, so a document finds its place from its length and its rank among documents
of that length. Items lie close to each other; what is left at the end of a sequence is filled from the stream: the few
items that no pattern has taken, end to end, cut where needed. What the gaps don't take of it makes sequences of its own,
the last of which is split into powers of two, which need no padding.

The driver sees the histogram only: at most as many numbers as a sequence has tokens.
"""

from __future__ import annotations

import functools
import math
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, in_slices, shared_folder
from tidemark.llm.words import chosen_text

WIDTH = 1024
#: Classes of lengths that the linear program tells apart; lengths of a class differ by less than width / CLASSES.
CLASSES = 128
#: Parts that documents of one length are dealt into for their ranks.
SALTS = 4096
#: Fixed: how byte-level vocabularies of this family split a text into pieces that no merge goes across. `piece_starts` splits so; tests hold it against this.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same in a text of ASCII characters only.
ASCII_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
#: Kinds of characters that the pattern tells apart; END stands behind each text of a block.
OTHER, LETTER, NUMBER, SPACE, END = range(5)
#: Pieces that a worker remembers in each of two generations, and the longest of them in letters.
REMEMBERED, LONGEST = 200_000, 64
_tokenizers: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    """The tokenizer of a file, the pattern of its special tokens, those of its pieces in any and in ASCII texts, and the pieces met before."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        special = re.compile("|".join(re.escape(x.content) for x in t.get_added_tokens_decoder().values()) or r"(?!)")
        _tokenizers[path] = t, special, regex.compile(PATTERN), re.compile(ASCII_PATTERN, re.ASCII), Pieces(t.model)
    return _tokenizers[path]


def _byte_letters() -> np.ndarray:
    """The letter that byte-level vocabularies write for each byte: itself where it can be printed, else one from U+0100 on; a line feed for 255, which UTF-8 hasn't."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = np.arange(256).astype("<u2")
    letters[np.setdiff1d(letters, plain)] = 256 + np.arange(256 - len(plain))
    letters[255] = ord("\n")
    return letters


_SPELT = _byte_letters()


class Pieces(dict):
    """piece -> its ids as little-endian 32-bit bytes, by the library's model. When it holds `most` pieces, they become the older half, and the older half before goes."""

    def __init__(self, model, most: int = REMEMBERED):
        from tokenizers import Tokenizer, pre_tokenizers

        self.model, self.most, self.old = model, most, {}
        self.lines = Tokenizer(model)  # takes each line for a piece: no byte is spelt as a line feed
        self.lines.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        vocabulary = self.lines.get_vocab()
        self.letters = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # of each id
        self.letters[list(vocabulary.values())] = [len(x) for x in vocabulary]

    def encoded(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces by one call of the library."""
        parts = [*map(str.encode, pieces)]
        spelt = _SPELT[np.frombuffer(b"\xff".join(parts), np.uint8)].tobytes().decode("utf-16-le")
        (found,) = self.lines.encode_batch_fast([spelt], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        letters, want = self.letters[ids].cumsum(), np.fromiter(map(len, parts), np.int64, len(parts)).cumsum()
        last = np.searchsorted(letters, want)
        if last[-1] == len(ids) or (letters[last] != want).any():  # a vocabulary without some bytes
            return [np.array([token.id for token in self.model.tokenize(x)], "<u4").tobytes() for x in spelt.split("\n")]
        ids, till = ids.tobytes(), (4 * last + 4).tolist()
        return [ids[a:b] for a, b in zip([0, *till], till)]

    def of(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces; all that aren't remembered are encoded at once."""
        out = [*map(self.get, pieces)]
        away = [k for k, ids in enumerate(out) if ids is None]
        if not away:
            return out
        names = [pieces[k] for k in away]
        again = [*map(self.old.get, names)]
        new = [p for p, ids in zip(names, again) if ids is None]
        fresh = iter(self.encoded(new) if new else ())
        again = [next(fresh) if ids is None else ids for ids in again]
        for k, ids in zip(away, again):
            out[k] = ids
        kept = [(p, ids) for p, ids in zip(names, again) if len(p) <= LONGEST][: self.most]
        if len(self) + len(kept) > self.most:
            self.old = dict(self)
            self.clear()
        self.update(kept)
        return out

    def __missing__(self, piece: str) -> bytes:
        return self.of([piece])[0]


@functools.cache
def _kinds() -> np.ndarray:
    """The kind of each code point."""
    every = "".join(map(chr, range(0x110000)))
    kinds = np.full(len(every), OTHER, np.uint8)
    for kind, run in (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+"):
        for m in regex.finditer(run, every):
            kinds[m.start() : m.end()] = kind
    return kinds


def piece_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places in UTF-8 bytes where PATTERN's pieces start. Each text has a zero byte behind it, at `ends`, which is taken for a piece."""
    kind = _kinds()[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):  # all bytes of a character get its kind
        first = data[lead].astype(np.int32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = first & (0x7F >> size)
        for k in (1, 2, 3):
            more = size > k
            code[more] = code[more] << 6 | data[lead[more] + k] & 0x3F
        own = _kinds()[code]
        kind[lead] = own
        for k in (1, 2, 3):
            kind[lead[size > k] + k] = own[size > k]
    kind[ends] = END
    start = np.r_[True, kind[1:] != kind[:-1]]
    start[ends] = True
    at = np.flatnonzero(start)
    run = kind[at]

    # of white space before something else the last character stands alone, or goes to the next piece if it is a blank
    after = at[1:][(run[:-1] == SPACE) & (run[1:] != END)]
    blank = data[after - 1] == 32
    start[after[blank]] = False
    last = after - 1
    for _ in range(3):
        last -= data[last] & 0xC0 == 0x80
    start[last] = True

    # an apostrophe that starts a piece takes the letters of a contraction; the byte before the first text is an end
    quote = at[(data[at] == ord("'")) & (data[at - 1] != 32)]
    a, b = data[quote + 1], data[np.minimum(quote + 2, len(data) - 1)]
    one = np.isin(a, list(b"sdmt"))
    two = (a == ord("l")) & (b == ord("l")) | ((a == ord("v")) | (a == ord("r"))) & (b == ord("e"))
    start[quote[one | two] + 1] = False
    start[quote[one] + 2] = True
    start[quote[two] + 3] = True
    return np.flatnonzero(start)


def token_bytes(texts: list[str | None], path: str, end: int = 0, longest: bool = True) -> list[bytes]:
    """The ids of each text and the id `end`, as little-endian 32-bit bytes. A null text is an empty one.

    All ids come from the tokenizers library, whose merges stay inside of pieces: its model encodes each piece when it is
    first met, and a piece is looked up once for all texts. Texts that hold the string of a special token are encoded
    whole. Of each 256 texts one chosen by its hash, and the longest of the first 256 if longest is set, are held against
    the library's ids of the whole text.
    """
    if not texts:
        return []
    t, special, _, _, known = _tokenizer(path)
    tail = np.uint32(end).tobytes()

    def whole(text: str) -> bytes:
        return np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    apart = [k for k, x in enumerate(texts) if x and special.search(x)]
    plain = [x.encode() if x else b"" for x in texts]
    for k in apart:
        plain[k] = b""
    data = np.frombuffer(b"\0".join([*plain, b""]), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in plain]) - 1
    starts = piece_starts(data, ends)
    places = pa.py_buffer(np.append(starts, len(data)))
    pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [None, places, pa.py_buffer(data)]).dictionary_encode()
    found = [*known.of(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), tail]

    ids, size = np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found])
    which = pieces.indices.to_numpy(zero_copy_only=False).copy()
    last = np.searchsorted(starts, ends)
    which[last] = len(found) - 1
    own = size[which]
    till = own.cumsum()
    ids = ids[np.repeat((size.cumsum() - size)[which] + own - till, own) + np.arange(till[-1])]
    bounds = [0, *till[last].tolist()]
    out = [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
    for k in apart:
        out[k] = whole(texts[k]) + tail
    for at in range(0, len(texts), 256):
        for k in chosen_text(texts[at : at + 256], longest and not at):
            if out[at + k] != whole(texts[at + k]) + tail:
                raise ValueError("the pieces' ids aren't those that the tokenizers library gives for a whole text")
    return out


def tokenize(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0) -> DataFrame:
    """(row, id, n, ids): of each row of docs a row number that is only told apart, its id, and its ids as bytes, with their number.

    Ids are 16-bit where all of the vocabulary's are, else 32-bit: so many bytes as len(ids) / n says. An id column with
    one of the other names raises.
    """
    if id_col in _NAMES:
        raise ValueError(f"the id column can't be named {id_col}")

    def run(batches):
        small = max(_tokenizer(tokenizer_path)[0].get_vocab_size() - 1, end) < 1 << 16
        for b in batches:
            for k, part in enumerate(in_slices(iter([b]))):
                ids = token_bytes(part.column(2).to_pylist(), tokenizer_path, end, longest=not k)
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                if small:
                    ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n, pa.array(ids, pa.binary())], ["row", id_col, "n", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), id_col, text_col)
    return rows.mapInArrow(run, rows.select("row", id_col, F.lit(0).cast("long").alias("n"), F.lit(b"").alias("ids")).schema)


_NAMES = {"row", "n", "ids", "rank", "whole_rank", "start", "length", "doc_tokens", "sequence_id", "offset"}


def best_patterns(worth: np.ndarray, lengths: np.ndarray, most: np.ndarray, width: int, wanted: int = 12) -> list[np.ndarray]:
    """Patterns (items of each length, no more than most of it) by a knapsack: the best of all, then the best that hold each of the wanted best lengths."""
    best = np.zeros(width + 1)
    steps = []  # (length index, items, where taking them is better), in the order of the dynamic program
    for k in np.flatnonzero(worth > 1e-9):
        n, size = int(most[k]), 1
        while n > 0 and int(lengths[k]) * (size := min(size, n)) <= width:
            w = int(lengths[k]) * size
            more = best[:-w] + worth[k] * size
            up = more > best[w:] + 1e-12
            if up.any():
                best = np.r_[best[:w], np.where(up, more, best[w:])]
                steps.append((k, size, w, up))
            n, size = n - size, 2 * size

    def items(room: int) -> np.ndarray:
        a = np.zeros(len(lengths), np.int64)
        for k, size, w, up in reversed(steps):
            if room >= w and up[room - w]:
                a[k] += size
                room -= w
        return a

    found = [items(width)] if best[width] > 0 else []
    for k in np.argsort(-(worth + best[width - lengths]), kind="stable")[:wanted]:
        a = items(int(width - lengths[k]))
        a[k] += 1
        if a[k] <= most[k]:
            found.append(a)
    return found


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan steps, the largest pivot of each column first.

    np.linalg.inv isn't used: with more than 64 rows numpy's OpenBLAS waits for threads that are gone, for ever, in a process that had
    numpy loaded when it started another one by a fork, as the driver does if the session begins after numpy is imported.
    """
    n = len(a)
    both = np.c_[a, np.eye(n)]
    for k in range(n):
        top = k + int(np.abs(both[k:, k]).argmax())
        both[[k, top]] = both[[top, k]]
        both[k] /= both[k, k]
        rest = both[:, k].copy()
        rest[k] = 0
        both -= np.outer(rest, both[k])
    return both[:, n:]


def solve(lengths: np.ndarray, demand: np.ndarray, width: int, gap: float = 0.005, patience: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, how often each) of the linear program that covers demand exactly with fewest sequences.

    Revised simplex with generated columns, from pairs of lengths that fill a sequence. Prices are smoothed towards the
    lengths, which they end near. It ends at the optimum, within gap of what the tokens alone need, or when `patience`
    rounds of pricing have won less than a thousandth: any basis covers the demand.
    """
    m = len(lengths)
    most = np.minimum(demand, width // lengths)
    noise = np.random.default_rng(0)
    need = demand * (1 + 1e-3 * noise.random(m))  # no ties, so no pivots on the spot
    center = lengths / width * (1 + 0.02 * noise.random(m))
    basis = np.diag(most.astype(float))
    of = {int(n): k for k, n in enumerate(lengths)}
    for k, n in enumerate(lengths.tolist()):
        j = of.get(width - n, k)
        if k < j:  # the rarer of two lengths that fill a sequence gets the pair as its column
            basis[[k, j], k if need[k] <= need[j] else j] = 1
    inverse = inverted(basis)
    x = np.clip(inverse @ need, 0, None)
    least, seen = lengths @ demand / width, []
    while x.sum() > (1 + gap) * least:
        seen.append(x.sum())
        if len(seen) > patience and seen[-1 - patience] - seen[-1] < 1e-3 * seen[-1]:
            break
        dual = inverse.sum(0)
        for smooth in (0.8, 0.4, 0.0):
            worth = np.clip(smooth * center + (1 - smooth) * dual, 0, None)
            new = [a for a in best_patterns(worth, lengths, most, width) if a @ dual > 1 + 1e-6]
            if new:
                break
        if not new:
            break
        for a in new:
            if a @ inverse.sum(0) <= 1 + 1e-7:
                continue  # a pivot before has made it worthless
            step = inverse @ a
            up = step > 1e-9
            ratio = np.where(up, x / np.where(up, step, 1), np.inf)
            out = int(ratio.argmin())
            basis[:, out] = a
            pivot = inverse[out] / step[out]
            inverse -= np.outer(step, pivot)
            inverse[out] = pivot
            x = x - step * ratio[out]
            x[out] = ratio[out]
            x = np.clip(x, 0, None)
    if m:
        x = np.clip(inverted(basis) @ demand, 0, None)
    return basis.T.round().astype(np.int64), x


def rounded(lengths: np.ndarray, demand: np.ndarray, width: int, sequences: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, uses) in whole numbers, at most so many sequences in all: each solution's patterns, most used first, are rounded up
    as far as items last; what is left is solved again until nothing more is placed."""
    left, uses = demand.copy(), []
    while (at := np.flatnonzero(left)).size and sequences:
        patterns, often = solve(lengths[at], left[at], width)
        before = sequences
        for k in np.argsort(-often, kind="stable"):
            if often[k] < 1e-6:
                break
            own = np.zeros(len(lengths), np.int64)
            own[at] = patterns[k]
            n = min(math.ceil(often[k] - 1e-6), int((left[own > 0] // own[own > 0]).min()), sequences)
            if n:
                uses.append((own, n))
                left, sequences = left - n * own, sequences - n
        if sequences == before:
            break
    return uses


@dataclass(frozen=True)
class Plan:
    """slots: rows (length, first rank, end rank, offset, first sequence) of whole items; gaps: rows (place in the stream, size, uses,
    first sequence) at the ends of their sequences; loose: of each length (ranks from, place in the stream); stream: its tokens, of
    which `filling` lie in gaps and the others from sequence base on."""

    width: int
    slots: np.ndarray
    gaps: np.ndarray
    loose: dict[int, tuple[int, int]]
    stream: int
    filling: int
    base: int

    @property
    def end(self) -> int:
        """The first sequence that isn't taken."""
        own = self.stream - self.filling
        return self.base + own // self.width + (own % self.width).bit_count()


def plan(histogram: dict[int, int], width: int = WIDTH, classes: int = CLASSES) -> Plan:
    """Where items of each length (1 to width - 1) go."""
    size = math.ceil(width / classes)
    of: dict[int, list[int]] = {}  # class, in units of size -> its lengths; items of a class are ranked by length, then by rank in it
    for n in sorted(histogram):
        of.setdefault(-(-n // size), []).append(n)
    names = sorted(of)
    starts = {c: np.cumsum([0, *(histogram[n] for n in of[c])]) for c in names}
    total = sum(n * k for n, k in histogram.items())
    demand = np.array([starts[c][-1] for c in names], np.int64)
    slots, gaps, taken, sequence, filling = [], [], dict.fromkeys(names, 0), 0, 0
    # no more sequences than there are tokens for: what patterns leave open, the other items can fill then
    for pattern, n in rounded(np.array(names, np.int64), demand, width // size, total // width):
        own = []  # (class, rank in it) of each slot at the first use
        for k in np.flatnonzero(pattern):
            for _ in range(pattern[k]):
                own.append((names[k], taken[names[k]]))
                taken[names[k]] += n
        # uses with the same lengths in all slots
        edges = sorted({0, n, *(int(e) - r for c, r in own for e in starts[c] if 0 < e - r < n)})
        for lo, hi in zip(edges, edges[1:]):
            offset = 0
            for c, r in own:
                j = int(np.searchsorted(starts[c], r + lo, "right")) - 1
                first = r + lo - int(starts[c][j])
                slots.append((of[c][j], first, first + hi - lo, offset, sequence + lo))
                offset += of[c][j]
            if offset < width:
                gaps.append((filling, width - offset, hi - lo, sequence + lo))
                filling += (width - offset) * (hi - lo)
        sequence += n
    loose, stream = {}, 0
    for c in names:
        for n, start in zip(of[c], starts[c].tolist()):
            first = min(max(taken[c] - start, 0), histogram[n])
            loose[n] = (first, stream)
            stream += (histogram[n] - first) * n
    return Plan(width, np.array(slots, np.int64).reshape(-1, 5), np.array(gaps, np.int64).reshape(-1, 4), loose, stream, filling, sequence)


def cut_stream(at: int, n: int, p: Plan) -> list[tuple[int, int, int]]:
    """(length, sequence, offset) of the parts of n tokens at a place of the stream. Its last sequence is split into powers of two."""
    out = []
    whole = (p.stream - p.filling) // p.width * p.width
    while n:
        if at < p.filling:
            start, size, _, first = p.gaps[int(np.searchsorted(p.gaps[:, 0], at, "right")) - 1].tolist()
            use, inside = divmod(at - start, size)
            sequence, offset, room = first + use, p.width - size + inside, size - inside
        elif at - p.filling < whole:
            sequence, offset = p.base + (at - p.filling) // p.width, (at - p.filling) % p.width
            room = p.width - offset
        else:
            place, rest, start, k = at - p.filling - whole, p.stream - p.filling - whole, 0, 0
            while place >= start + (size := 1 << (rest.bit_length() - 1)):
                rest, start, k = rest - size, start + size, k + 1
            sequence, offset, room = p.base + whole // p.width + k, place - start, start + size - place
        took = min(n, room)
        out.append((took, sequence, offset))
        at, n = at + took, n - took
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, end: int = 0) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): one row per piece; ids are its little-endian 32-bit ids.

    Rows with equal ids or texts are packed one by one; null and empty texts are the end id alone; an empty table gives an
    empty one. Other columns are left out. Sequences count from 0: first those of patterns, then those of the stream, then
    the whole parts of long documents.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "tokens")
    tokenize(docs, tokenizer_path, id_col, text_col, end).write.option("compression", "zstd").parquet(folder)
    tokens = spark.read.parquet(folder)

    light = tokens.select("row", (F.col("n") % width).alias("rest"), F.expr(f"n div {width}").alias("whole"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    counts = cut(light.groupBy("rest", "salt").agg(F.count(F.lit(1)).alias("count"), F.sum("whole").alias("wholes")))
    totals = sorted(map(tuple, counts.groupBy("rest").agg(F.sum("count"), F.sum("wholes")).collect()))  # at most `width` rows
    p = plan({rest: n for rest, n, _ in totals if rest}, width)
    shared = spark.sparkContext.broadcast(p)  # bounded by `width`: no row of the table goes into it
    base = dict(zip((rest for rest, _, _ in totals), np.cumsum([p.end, *(w for _, _, w in totals)]).tolist()))  # first whole sequence of each rest

    earlier = Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("rest", "salt", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("count", "wholes")))
    own = Window.partitionBy("rest", "salt").orderBy("row")
    ranked = light.withColumn("r", F.row_number().over(own) - 1).withColumn("w", F.sum("whole").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("whole"))
    ranked = ranked.join(cut(offsets), ["rest", "salt"]).select("row", (F.col("count_before") + F.col("r")).alias("rank"), (F.col("wholes_before") + F.col("w")).alias("whole_rank"))

    def place(batches):
        names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        q = shared.value
        of = {}
        for k in np.unique(q.slots[:, 0]) if len(q.slots) else ():
            own = q.slots[q.slots[:, 0] == k]
            of[int(k)] = own[np.argsort(own[:, 1], kind="stable")]
        for b in in_slices(batches):
            out: list[list] = [[] for _ in names]
            for doc, n, ids, rank, whole_rank in zip(*(b.column(k).to_pylist() for k in range(5))):
                whole, rest = divmod(n, width)
                pieces = [(width, base[rest] + whole_rank + k, 0) for k in range(whole)]
                if rest:
                    own = of.get(rest)
                    k = int(np.searchsorted(own[:, 1], rank, "right")) - 1 if own is not None else -1
                    if k >= 0 and rank < own[k, 2]:
                        _, first, _, offset, sequence = own[k].tolist()
                        pieces.append((rest, sequence + rank - first, offset))
                    else:
                        first, at = q.loose[rest]
                        pieces += cut_stream(at + (rank - first) * rest, rest, q)
                start = 0
                if len(ids) == 2 * n:
                    ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                for length, sequence, offset in pieces:
                    for column, value in zip(out, (doc, start, length, ids[4 * start : 4 * (start + length)], n, sequence, offset)):
                        column.append(value)
                    start += length
            kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for at in range(0, max(1, len(out[0])), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 4096], t) for c, t in zip(out, kinds)], names)

    joined = tokens.join(ranked, "row").select(id_col, "n", "ids", "rank", "whole_rank")
    long = F.lit(0).cast("long")
    return joined.mapInArrow(place, joined.select(id_col, long.alias("start"), long.alias("length"), "ids", long.alias("doc_tokens"), long.alias("sequence_id"), long.alias("offset")).schema)
