"""Token ids of whole texts, by encoding each distinct chunk once.

Both vocabularies split a text before merging, so a text's ids are those of its chunks in order.  Chunks are cut only where
the tokenizer itself always cuts: at line ends and between words, a word of the byte-level vocabulary taking one blank before
it along.  New words of many texts are encoded in one call, kept apart by a separator whose ids no word can give.  A text in
which a special token or the separator may stand is encoded whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import islice

import numpy as np

from skysift.llm.common import utf8

BYTE_LEVEL, WORD_LEVEL = "byte_bpe_50k.json", "word_bpe_49k.json"
#: White space as the tokenizers see it (Python's ``\s`` also has U+001C to U+001F), other than blank and line end.
_OTHER = "\t\x0b-\r\x85\xa0  -     　"
_WHITE = rf" \n{_OTHER}"
_CHUNKS = re.compile(rf" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: White space other than single blanks and line ends between words.
_UNEVEN, _ENDS, _RARE = ("  ", " \n", "\n ", "\n\n"), ("", " ", "\n"), re.compile(rf"[{_OTHER}\x00]")
#: ASCII punctuation without the apostrophe, which starts contractions.
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SEPARATOR = "\ue000"
LIMIT, CORE = 800_000, 300_000


class Encoder:
    """``ids(texts)`` gives, for each text, its ids as little-endian unsigned 32-bit integers.

    At most ``limit`` words are remembered; beyond, all but the first ``core`` ones are forgotten (words that are met early
    are mostly the frequent ones).
    """

    def __init__(self, path: str, limit: int = LIMIT, core: int = CORE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = os.path.basename(path) == BYTE_LEVEL
        self.limit, self.core = limit, core
        self.known: dict[str, bytes] = {"": b""}
        self.line = self._whole("\n")
        mark = f" {SEPARATOR}\n" if self.spaced else f" {SEPARATOR} "
        self.mark, self.mark_ids = mark, np.frombuffer(self._whole(mark), "<u4")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str], together: int = 64) -> None:
        """Encode words ``together`` at a time, in one call."""
        groups = [words[i : i + together] for i in range(0, len(words), together)]
        m = len(self.mark_ids)
        for some, e in zip(groups, self.tokenizer.encode_batch_fast([self.mark.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            hit = np.ones(max(len(ids) - m + 1, 0), bool)
            for j in range(m):
                hit &= ids[j : len(ids) - m + 1 + j] == self.mark_ids[j]
            ends = np.flatnonzero(hit).tolist()
            if len(ends) != len(some) - 1:
                raise AssertionError("a word gave the ids of the separator")
            data = ids.tobytes()
            self.known.update(zip(some, [data[4 * a : 4 * b] for a, b in zip([0, *(x + m for x in ends)], [*ends, len(ids)], strict=True)], strict=True))

    def _remember(self, words: set[str]) -> None:
        known = self.known
        new = words.difference(known)  # given the dict itself, it walks the words alone; with its keys view, all known ones
        if len(known) + len(new) > self.limit:
            known = self.known = dict(islice(known.items(), self.core))
            new = words.difference(known)
        ended, plain = {}, set()
        for w in new:
            x = w.rstrip(_PUNCTUATION) if w[-1] in _PUNCTUATION else w
            if x is not w and x[-1:].isalpha() and (self.spaced or x[-1:].isascii()):
                ended[w] = x
                plain.update(part for part in (x, w[len(x) :]) if part not in known)
            elif w.isspace():
                known[w] = self._whole(w)
            else:
                plain.add(w)
        if plain:
            self._learn(list(plain))
        # Both tokenizers cut between a letter and punctuation.  The word-level one first rewrites letters, and some end in a mark
        # that keeps to the punctuation, so only plain letters count there.
        for w, x in ended.items():
            known[w] = known[x] + known[w[len(x) :]]

    def _cut(self, text: str) -> list[list[str]] | None:
        """Lines of words; None for a text to be encoded whole."""
        if "<|" in text or SEPARATOR in text:
            return None
        if not self.spaced:
            return [text.replace("\n", " ").split(" ")]
        if any(x in text for x in _UNEVEN) or text[:1] in _ENDS or text[-1:] in _ENDS or _RARE.search(text):
            return [_CHUNKS.findall(text)]
        return [x.replace(" ", "\x00 ").split("\x00") for x in text.split("\n")]

    def ids(self, texts: list[str]) -> list[bytes]:
        texts = [utf8(t).decode("utf-8", "replace") for t in texts]
        cut = [self._cut(t) for t in texts]
        self._remember(set().union(*[words for lines in cut if lines for words in lines]))
        get, line = self.known.__getitem__, self.line if self.spaced else b""
        return [self._whole(t) if lines is None else line.join([b"".join(map(get, words)) for words in lines]) for t, lines in zip(texts, cut, strict=True)]


def encoded(enc: Encoder, batch, together: int = 128):
    """``doc_id`` (a string; None for null) and ids of each row of a batch, some texts at a time."""
    for i in range(0, len(batch), together):
        some = batch.iloc[i : i + together]
        yield from zip(list(some["doc_id"]), enc.ids(list(some["text"])), strict=True)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary file."""
    return Encoder(path)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
