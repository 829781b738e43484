"""License scans with ordered signature rules.

Some four hundred hand-written regular expressions (``license_rules``) over the words of a text, each gated by a keyword: one
Aho-Corasick pass finds which keywords occur, and only the rules of those keywords run.  Overlapping detections are resolved by priority: a detection that
lies inside the word interval of one with a higher priority is suppressed, and among equal priorities the longer one stays.

The base phrases are rules of the lowest priority whose labels are always reported, suppressed or not.

Defined results: a null text is the empty text; rows are judged one by one, so repeated rows and null ids give one row each;
an empty table gives no rows; very long texts are read whole; ids are longs of any size; extra columns are ignored.  Words are lower-cased (A-Z) runs of digits, letters and characters outside ASCII.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import texts, utf8
from skysift.llm.license_rules import SIGNATURES

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: str
    priority: int


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All signatures, most telling first."""
    out = []
    for line in SIGNATURES.strip().splitlines():
        head, keyword, pattern = (x.strip() for x in line.split(" | ", 2))
        priority, label = head.split(" ")
        out.append(Rule(label, pattern, keyword, int(priority)))
    return tuple(sorted(out, key=lambda r: -r.priority))


_SEPARATORS = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
#: Lower-cases A-Z and turns every other separator of words into a blank.
_FLAT = bytes(c + 32 if 65 <= c <= 90 else 32 if c in _SEPARATORS else c for c in range(256))


def words_of(text: str) -> list[bytes]:
    return utf8(text).translate(_FLAT).split()


@lru_cache(maxsize=1)
def _gate():
    """Keyword automaton and, per keyword, its compiled rules (whole words only)."""
    by_key: dict[str, list] = {}
    for r in rules():
        by_key.setdefault(r.keyword, []).append((r, re.compile(rf"(?<= ){r.pattern}(?= )")))
    auto = ahocorasick.Automaton()
    for k in [*by_key, *BASE]:
        auto.add_word(k, k)
    auto.make_automaton()
    return auto, by_key


def detect(flat: str, keys: set[str]) -> list[tuple[int, int, str, int]]:
    """Detections ``start, end, label, priority`` in the character positions of ``flat``, overlaps resolved.

    Contained means inside the interval of a detection that ranks higher by priority, then length, then start.
    """
    _, by_key = _gate()
    found = {(m.start(), m.end(), r.label, r.priority) for k in keys for r, p in by_key.get(k, ()) for m in p.finditer(flat)}
    starts = {x: i + 1 for i, x in enumerate(sorted({x[0] for x in found}))}
    ends = [0] * (len(starts) + 1)  # Fenwick tree: largest end among the kept detections that start no later
    kept = []
    for x in sorted(found, key=lambda x: (-x[3], x[0] - x[1], x)):
        i, reach = starts[x[0]], 0
        while i:
            reach = max(reach, ends[i])
            i &= i - 1
        if reach < x[1]:
            kept.append(x)
            i = starts[x[0]]
            while i < len(ends):
                ends[i] = max(ends[i], x[1])
                i += i & -i
    return sorted(kept)


def certainty(spans: list[dict]) -> float:
    """Of the label that is best attested: detections count by priority and length, and several of one label add up."""
    doubt: dict[str, float] = {}
    for x in spans:
        strength = x["priority"] / 100 * (0.7 + 0.3 * (1 - 0.5 ** ((x["end"] - x["start"]) / 4)))
        doubt[x["label"]] = doubt.get(x["label"], 1.0) * (1 - strength)
    return 1 - min(doubt.values(), default=1.0)


def scan(text: str) -> tuple:
    words = words_of(text)
    flat = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    auto, _ = _gate()
    keys = {k for _, k in auto.iter(flat)}
    if not keys:
        return len(words), 0, None, None, "", "", 0.0, []
    base = []
    for phrase, label in BASE.items():
        at = flat.find(f" {phrase} ") if phrase in keys else -1
        while at >= 0:
            base.append((at + 1, label))
            at = flat.find(f" {phrase} ", at + 1)
    found = detect(flat, keys)
    # positions in words: blanks before the position
    places = sorted({x for x, _ in base} | {p for x in found for p in x[:2]})
    number, last, count = {}, 0, 0
    for p in places:
        count += flat.count(" ", last, p)
        last, number[p] = p, count - 1
    starts = [number[x] for x, _ in base]
    own = sorted({label for _, label in base})
    spans = [{"label": lab, "start": number[a], "end": number[b] + 1, "priority": pr} for a, b, lab, pr in found]
    score = certainty(spans) or 0.3 * bool(base)
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(own), ",".join(sorted({*own, *(x[2] for x in found)})), score, spans


ROW = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "detections array<struct<label:string,start:long,end:long,priority:int>>"
)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: word counts, base places, labels, score and the detections as word intervals."""

    @F.pandas_udf(ROW)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(*scan(t),) for t in batch]
            out = pd.DataFrame(found, columns=[x.split()[0] for x in ROW.split(", ")[:8]])
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            yield out

    return texts(docs).select("doc_id", judged("text").alias("found")).select("doc_id", "found.*")
