"""Encoding texts word by word: what the encoders share."""

from __future__ import annotations

import zlib
from collections.abc import Callable

#: Words that a worker remembers in each of two generations, and the longest of them in letters.
REMEMBERED, LONGEST = 100_000, 64


class Memory:
    """word -> value, at most twice `most` of them: when the newer half is full, the older one goes."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.new, self.old = most, {}, {}

    def missing(self, words: set) -> list:
        """Those of words that aren't known; the others are all in the newer half then."""
        out = [w for w in words if w not in self.new]
        if len(self.new) + len(out) > self.most:
            self.new, self.old, out = {}, self.new, list(words)
        new, old, rest = self.new, self.old, []
        for w in out:
            if (v := old.get(w)) is None:
                rest.append(w)
            else:
                new[w] = v
        return rest


def by_words(texts: list[str | None], split: Callable[[str], list[str]], encode: Callable[[list[str]], list[bytes]], memory: Memory) -> list[bytes]:
    """Of each text its words' encodings, joined. Every word that the memory doesn't hold is encoded once in a block of texts."""
    out: list[bytes] = []
    held: list[list[str]] = []
    size = 0

    def done() -> None:
        distinct = set().union(*held)
        aside = {w for w in distinct if len(w) > LONGEST} if len(distinct) <= memory.most else distinct
        new = list(aside)  # words that the memory doesn't take
        once = dict(zip(new, encode(new))) if new else {}
        fresh = memory.missing(distinct - aside if aside else distinct)
        known = memory.new
        if fresh:
            known.update(zip(fresh, encode(fresh)))
        for words in held:
            out.append(b"".join([known[w] if w in known else once[w] for w in words] if once else [known[w] for w in words]))
        held.clear()

    for t in texts:
        held.append(split(t) if t else [])
        size += len(held[-1])
        if size > 100_000:
            done()
            size = 0
    done()
    return out


def chosen_text(texts: list[str | None], longest: bool) -> set[int]:
    """The places of the texts that are checked whole: that with the smallest hash, and the longest if wanted."""
    own = [k for k, t in enumerate(texts) if t]
    if not own:
        return set()
    by_hash = min(own, key=lambda k: zlib.crc32(texts[k][:256].encode("utf-8", "surrogatepass")))
    return {by_hash, max(own, key=lambda k: len(texts[k]))} if longest else {by_hash}
