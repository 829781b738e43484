"""Benchmark decontamination by pigeonhole edit matching.

A test item of ``m`` characters may differ from a passage by ``k = floor(rate * m)`` edits.  It is cut into ``k + 1``
pieces, so any such passage holds one piece unchanged.  All pieces are found in one Aho-Corasick pass over each text.  A hit
is then verified by Myers' bit-parallel distance, from the piece up through the parts that it was cut from: a part may use
half of the budget of what it belongs to, so most chance hits end at a part twice as long as the piece, and nothing within
the budget is lost.

Test items are a stated query set: they are read in blocks of bounded size, and every block is matched against all texts, so
what is sent to the tasks is bounded by ``block_chars`` however many items there are.

Texts and items are compared in lower case, with every run of white space as one blank.

Defined results: null texts and items are empty; empty items match nothing; equal items are each reported; repeated rows
and null ids are reported like any other; an empty table gives no rows; extra columns are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import texts_by_name, with_long

MATCHES = "doc_id long, item_id long, distance int, start long, end long"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def ends_within(pattern: str, text: str, budget: int) -> list[tuple[int, int]]:
    """Places in ``text`` where an occurrence of ``pattern`` with at most ``budget`` edits ends: (end, distance).

    Myers (1999): the column of the distance table as two bit vectors of rises and falls.
    """
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    rise, fall, score, out = full, 0, m, []
    for j, c in enumerate(text):
        equal = masks.get(c, 0)
        vertical = equal | fall
        across = ((equal & rise) + rise ^ rise) | equal
        up = fall | full & ~(across | rise)
        down = rise & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full  # an occurrence may start anywhere
        down = down << 1 & full
        rise = down | full & ~(vertical | up)
        fall = up & vertical
        if score <= budget:
            out.append((j + 1, score))
    return out


@dataclass(frozen=True, eq=False)
class Part:
    """A stretch of an item with its share of the budget; ``parent`` is the part that it was cut from."""

    item: int
    start: int
    end: int
    budget: int
    parent: "Part | None"


def leaves(item: int, text: str, budget: int) -> list[Part]:
    """The pieces of an item: halves of halves, until a part has no budget.

    A part of budget ``b`` is cut in two of budgets that sum to ``b - 1``: if both halves exceeded theirs, the part would
    have more than ``b`` edits.  Lengths follow the numbers of pieces.
    """
    out, todo = [], [Part(item, 0, len(text), budget, None)]
    while todo:
        part = todo.pop()
        if not part.budget:
            out.append(part)
            continue
        left = part.budget // 2
        right = part.budget - 1 - left
        cut = part.start + (part.end - part.start) * (left + 1) // (part.budget + 1)
        todo += [Part(item, part.start, cut, left, part), Part(item, cut, part.end, right, part)]
    return out


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        """``items``: id and normalised text."""
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        by_piece: dict[str, list[Part]] = {}
        for n, t in enumerate(self.texts):
            if t:
                for part in leaves(n, t, min(int(rate * len(t)), len(t) - 1)):
                    by_piece.setdefault(t[part.start : part.end], []).append(part)
        self.pieces = ahocorasick.Automaton()
        for piece, parts in by_piece.items():
            self.pieces.add_word(piece, (len(piece), parts))
        if by_piece:
            self.pieces.make_automaton()
        self.any = bool(by_piece)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """Best match of each item in a normalised text: item id, distance, start, end; the leftmost end among equals."""
        if not self.any:
            return []
        best: dict[int, tuple[int, int]] = {}
        looked: set[tuple] = set()
        for last, (size, parts) in self.pieces.iter(text):
            for part in parts:
                if best.get(part.item, (1,))[0]:
                    self._climb(part, text, last + 1 - size, best, looked)
        out = []
        for n, (distance, end) in best.items():
            item = self.texts[n]
            low = max(0, end - len(item) - distance)
            back = [e for e, d in ends_within(item[::-1], text[low:end][::-1], distance) if d == distance]
            out.append((self.ids[n], distance, end - min(back), end))
        return out

    def _climb(self, part: Part, text: str, at: int, best: dict, looked: set) -> None:
        """``text[at:]`` starts with the piece ``part``; follow its parents while they match around it."""
        item = self.texts[part.item]
        origin = at - part.start  # where the item would start without edits
        node = part.parent
        while node is not None and node.parent is not None:
            if (node, origin) in looked:
                return  # the same window was judged before
            looked.add((node, origin))
            low = max(0, origin + node.start - node.budget)
            if not ends_within(item[node.start : node.end], text[low : origin + node.end + node.budget], node.budget):
                return
            node = node.parent
        budget = node.budget if node is not None else 0
        if (part.item, origin) in looked:
            return
        looked.add((part.item, origin))
        low = max(0, origin - budget)
        for end, distance in ends_within(item, text[low : origin + len(item) + budget], budget):
            found = (distance, low + end)
            if found < best.get(part.item, (budget + 1, 0)):
                best[part.item] = found


def _blocks(items: DataFrame, chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items, read to the driver block by block: about ``chars`` characters each, by the hash of the text."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // chars)
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == k) if n > 1 else rows
        yield [(r.item_id, normal(r.text)) for r in own.collect()]


def matches(docs: DataFrame, items: DataFrame, rate: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """``doc_id, item_id, distance, start, end`` of each item's best match in each text; positions in the normalised text."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], MATCHES)
    for block in _blocks(items, block_chars):
        shared = spark.sparkContext.broadcast(block)  # block_chars bounds it

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                rows = [(i, *m) for i, t in zip(batch["doc_id"], batch["text"], strict=True) for m in matcher.find(normal(t))]
                rows = [(i, None if item is None else str(item), *rest) for i, item, *rest in rows]
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in MATCHES.split(", ")], dtype=object)

        own = MATCHES.replace("doc_id long", "doc_id string").replace("item_id long", "item_id string")
        found = found.union(with_long(texts_by_name(docs).mapInPandas(run, own), "doc_id", "item_id"))
    return found


def _cleanness(shared, rate: float):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value, rate)
        for batch in batches:
            yield pd.Series([t is None or not matcher.find(normal(t)) for t in batch], dtype=bool)

    return clean


def keep_clean(docs: DataFrame, items: DataFrame, rate: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """The documents in which no item matches, with all their columns."""
    for block in _blocks(items, block_chars):
        docs = docs.where(_cleanness(docs.sparkSession.sparkContext.broadcast(block), rate)("text"))
    return docs
