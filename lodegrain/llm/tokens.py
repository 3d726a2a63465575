"""Token ids of whole texts by the tokenizers library, with a bounded memo of the words a worker has seen.

A byte-pair tokenizer first cuts a text into pre-tokens and encodes each alone, so the ids of a text are the ids of its
words in turn wherever a cut between words is also a cut between pre-tokens. That holds before every space of the two
layouts below (a run of white space that could be split differently, or the string of an added token, which the tokenizer
looks for before it cuts, sends the whole text to the tokenizer), and lets a
worker encode a word once instead of each time it occurs. The memo keeps the first words it sees, at most `memo_words`, among
them the frequent ones, and changes nothing but time.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: White space of Unicode, as the word layout drops it; the control characters 1C to 1F are not in it.
UNICODE_SPACE = "\t-\r \x85\xa0  -     　"
_WORDS = re.compile(f"[^{UNICODE_SPACE}]+")
_LONG_RUN = re.compile(r"\s\s(?:\s|\Z)")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: Marks of ASCII without the apostrophe, which starts pre-tokens of its own ('s, 'll).
_MARKS = "!-&(-/:-@\\[-`{-~"
#: A pre-token each in either layout: letters of Latin-1, marks, a line end before another of them.
_PART = re.compile(f"[{_LETTERS}]+|[{_MARKS}]+|\n")
_OF_PARTS = re.compile(f"(?:[{_LETTERS}{_MARKS}]|\n(?=[{_LETTERS}{_MARKS}]))+")
_STEM = re.compile(f"[{_LETTERS}]+")


class Encoder:
    """layout "joined": a space belongs to the word after it (byte-level); "dropped": white space gives no ids.

    Ids are kept as little-endian 32-bit bytes: of words after a space (`words`) and of pre-tokens without one (`first`, the
    same table if the layout drops spaces). Words that a text is the first to hold are taken apart into pre-tokens where
    that is safe, and all unknown runs of letters go to the tokenizer as one text; its ids are cut where a token of the
    vocabulary starts (joined: with the space's byte) or ends (dropped: with the suffix) a word. A word of several
    pre-tokens is kept while the table is less than half full, others while it is not full.
    """

    def __init__(self, path: str, layout: str, memo_words: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized or t.single_word for t in added):
            raise ValueError("added tokens are looked for in the text as it is")
        self.added = [t.content for t in added]
        self.tokenizer, self.layout, self.most = tokenizer, layout, memo_words
        self.joined = layout == "joined"
        self.words: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {} if self.joined else self.words
        vocabulary = tokenizer.get_vocab()
        self.bounds = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        # fixed values: the letter that stands for the space's byte in byte-level vocabularies, and the suffix of word-level ones
        self.bounds[[i for t, i in vocabulary.items() if (t.startswith("\u0120") if self.joined else t.endswith("</w>"))]] = True

    def _plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _stems(self, stems: list[str]) -> dict[str, bytes]:
        """Ids of runs of letters, each after a space, from one call."""
        text = " ".join(stems)
        ids = np.array(self.tokenizer.encode_batch_fast([" " + text if self.joined else text], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.bounds[ids])
        cuts = [*at.tolist(), len(ids)] if self.joined else [0, *(at + 1).tolist()]
        if len(cuts) != len(stems) + 1 or cuts[0] or cuts[-1] != len(ids):  # a vocabulary that marks words otherwise
            return {s: self._plain(" " * self.joined + s) for s in stems}
        whole = ids.tobytes()
        return {s: whole[4 * a : 4 * b] for s, a, b in zip(stems, cuts, cuts[1:])}

    def _keep(self, table: dict[str, bytes], found: dict[str, bytes], most: int) -> None:
        if len(table) + len(found) <= most:
            table.update(found if all(len(w) < 64 for w in found) else {w: ids for w, ids in found.items() if len(w) < 64})

    def _part(self, part: str) -> bytes:
        """Ids of a pre-token that has no space before it."""
        ids = self.first.get(part)
        if ids is None:
            ids = self._plain(part)
            self._keep(self.first, {part: ids}, self.most // 10 if self.joined else self.most)
        return ids

    def _unknown(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not in the table yet."""
        known, stems, parted = self.words, set(), {}
        for w in words:
            if w.isascii() and w.isalpha():
                stems.add(w)
            elif _OF_PARTS.fullmatch(w):
                parted[w] = p = _PART.findall(w)
                stems.update(x for x in (p[:1] if self.joined else p) if x not in known and _STEM.fullmatch(x))
        found = self._stems(list(stems)) if stems else {}
        self._keep(known, found, self.most)
        more = {}
        for w in words - found.keys():
            p = parted.get(w, ())
            if len(p) < 2:
                more[w] = self._plain(" " * self.joined + w)
            elif self.joined:
                lead = found.get(p[0]) or known.get(p[0]) or self._plain(" " + p[0])
                more[w] = lead + b"".join(map(self._part, p[1:]))
            else:
                more[w] = b"".join([found.get(x) or self._part(x) for x in p])
        self._keep(known, more, self.most // 2)
        found.update(more)
        return found

    def ids(self, text: str) -> bytes:
        """The ids of the whole text, four little-endian bytes each."""
        if any(t in text for t in self.added) or (self.joined and _LONG_RUN.search(text)):
            return self._plain(text)
        if self.joined:
            first, *words = text.split(" ")
        else:
            first, words = "", _WORDS.findall(text) if _SEPARATORS.search(text) else text.split()
        ids = list(map(self.words.get, words))
        if None in ids:
            places = [i for i, x in enumerate(ids) if x is None]
            found = self._unknown({words[i] for i in places})
            for i in places:
                ids[i] = found[words[i]]
        return self._part(first) + b"".join(ids) if first else b"".join(ids)


@lru_cache(maxsize=4)
def encoder(path: str, layout: str, memo_words: int = 1_200_000) -> Encoder:
    """One encoder and memo for all tasks of a Python worker."""
    return Encoder(path, layout, memo_words)
