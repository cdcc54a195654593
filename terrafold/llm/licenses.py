"""Operator 10: license scans by conditional compression.

A block of text that a license template explains compresses far better with the template as dictionary than without. Each
candidate block is compressed with each template that can be confirmed there, and the templates are ranked by how many
bytes that saves; the one that saves most is confirmed by the exact words in which the block differs: few, and none of them
a number, a negation or a word that names a license. What it explains is taken, and no other license that saves less is found
within. A template that saves nothing is none.

A template of n words may differ in DIFFERENT of them, so of one more piece than that of the template at least one is
found word for word; a template without such a piece in a block can't be confirmed there, so it needs no compressing.
Candidate blocks lie around the first words of such pieces. Words are counted across lines and without marks, so wrapped
notices and those in comments or tables are found.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Mapping
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES

#: The share of a template's words in which a block may differ.
DIFFERENT = 0.05
#: Words that name a license, a condition or a grant, and negations; like numbers, they never differ. Fixed values.
NAMES = frozenset(
    "gnu general lesser library affero public apache mit bsd isc mozilla mpl eclipse boost zlib creative commons cc cc0 attribution by sa nc nd by-sa by-nc by-nd by-nc-sa by-nc-nd "
    "attribution-sharealike attribution-noncommercial attribution-noderivatives attribution-noncommercial-sharealike attribution-noncommercial-noderivatives "
    "version v later only fee domain not no never nor neither without cannot except unless".split()
)
#: What every template holds; no confirmed block is without one, as these words never differ.
ANCHOR = re.compile(r"(?i)licen[sc]e|permission|redistribution|rights|unencumbered")
#: A notice is none after one of these in the same clause, so many characters back at most. Fixed values.
NEGATIONS = frozenset("not no never none nothing neither nor isn aren wasn weren doesn don without cannot".split())
BACK = 400
#: Where a clause ends: at a mark, a blank line, a line that begins with a capital, or before a new subject.
CLAUSE = re.compile(r"""[.!?;:]["')\]]*\s|\n[^\w\n]*\n|\n\W*(?=[A-Z])|,\s+(?:and|but)\s""")
#: Taken matches looked at before a new one. One that begins earlier and reaches as far would hold those between, which are
#: then wordings of its own license.
NEAR = 32
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
_LICENCE = re.compile(r"licence")


def wording(text: str) -> list[str]:
    """Words without case, marks and table bars; licence is spelt license."""
    return _LICENCE.sub("license", " ".join(_WORD.findall(text)).lower()).split()


@lru_cache(100_000)
def fixed(word: str) -> bool:
    """Whether a word may not differ."""
    return word in NAMES or any(map(str.isdigit, word)) or ANCHOR.search(word) is not None


def bits(words: list[str]) -> dict[str, int]:
    """The places of each word as bits."""
    out: dict[str, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def distances(masks: Mapping[str, int], n: int, words: list[str], anchored: bool) -> Iterator[int]:
    """After each word of a text: the least number of words to add, drop or change to make a pattern of n words (as bits) of
    what ends there; from anywhere on, or, if anchored, from the first word on. A column of the table of distances is two
    numbers of n bits, so a word costs a few operations whatever n is."""
    whole, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = whole, 0, n
    for w in words:
        same = masks.get(w, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = (down | ~(across | up)) & whole, up & across
        score += 1 if more & top else -1 if less & top else 0
        more, less = more << 1 | anchored, less << 1
        up, down = (less | ~(vertical | more)) & whole, more & vertical & whole
        yield score


class Match(NamedTuple):
    """A license found at words start to end (exclusive) of a text, its saving as a share of the block's compressed size, the
    differing words, and these as a share of the template's words."""

    start: int
    end: int
    name: str
    saved: float
    differing: int
    share: float


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, wording(text)
        n = len(self.words)
        if n < 2 or not any(ANCHOR.search(w) for w in self.words):
            raise ValueError(f"a template has two words or more and an anchor: {text}")
        #: How many words may differ; pieces of a template have three words or more, but for one of two words.
        self.most = max(0, min(int(DIFFERENT * n), n // 3 - 1))
        size = n // (self.most + 1)
        self.pieces = [(i * size, tuple(self.words[i * size : i * size + 3])) for i in range(self.most + 1)]
        self.fixed = [w for w in self.words if fixed(w)]
        self.forward, self.backward = bits(self.words), bits(self.words[::-1])
        raw = zstandard.ZstdCompressionDict(" ".join(self.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.packer = zstandard.ZstdCompressor(level=19, dict_data=raw, write_content_size=False)

    def places(self, block: list[str]) -> list[tuple[int, int, int]]:
        """(start, end, differences) of the places where the template is found with few enough differences and with its fixed
        words as they are: of ends one after another that with the fewest, the last of equal ones, from where it starts
        earliest."""
        n, most = len(self.words), self.most
        near: list[list[tuple[int, int]]] = []
        for end, d in enumerate(distances(self.forward, n, block, False), 1):
            if d <= most:
                if near and near[-1][-1][1] == 1 - end:
                    near[-1].append((d, -end))
                else:
                    near.append([(d, -end)])
        out = []
        for run in near:
            for d, end in sorted(run):
                back = block[max(0, -end - n - most) : -end][::-1]
                start = -end - max(i for i, own in enumerate(distances(self.backward, n, back, True), 1) if own == d)
                if [w for w in block[start:-end] if fixed(w)] == self.fixed:
                    out.append((start, -end, d))
                    break
        return out


class Scanner:
    def __init__(self, templates: Mapping[str, tuple[str, ...]] = TEMPLATES):
        self.templates = [Template(name, text) for name, texts in templates.items() for text in texts]
        self.plain = zstandard.ZstdCompressor(level=19, write_content_size=False)
        self.at: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        for t, template in enumerate(self.templates):
            for offset, words in template.pieces:
                self.at.setdefault(words, []).append((t, offset))
        self.begins: dict[str, set[int]] = {}
        for words in self.at:
            self.begins.setdefault(words[0], set()).add(len(words))
        self.seen: dict[tuple[str, int], tuple[int, float, list[tuple[int, int, int]]]] = {}

    def candidates(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(start, end, template): blocks of words in which a template may be found. Pieces that tell of about the same place
        give one block."""
        last: dict[int, int] = {}
        for i, w in enumerate(words):
            for size in self.begins.get(w, ()):
                for t, offset in self.at.get(tuple(words[i : i + size]), ()):
                    most, first = self.templates[t].most, i - offset
                    if t not in last or first - last[t] > most:
                        last[t] = first
                        yield max(0, first - 2 * most), min(len(words), first + len(self.templates[t].words) + 4 * most), t

    def reduction(self, block: str, t: int) -> tuple[int, int]:
        """Bytes that a block takes compressed, and how many of them a template saves."""
        data = block.encode()
        bare = len(self.plain.compress(data))
        return bare, bare - len(self.templates[t].packer.compress(data))

    def weighed(self, block: list[str], t: int) -> tuple[int, float, list[tuple[int, int, int]]]:
        """The bytes that a template saves of a block, these as a share of the block's, and where the wording confirms it (not
        asked where nothing is saved)."""
        key = " ".join(block), t
        if key not in self.seen:
            if len(self.seen) > 20_000:
                self.seen.clear()
            bare, saved = self.reduction(*key)
            self.seen[key] = saved, saved / max(1, bare), self.templates[t].places(block) if saved > 0 else []
        return self.seen[key]

    def find(self, text: str) -> list[Match]:
        """The licenses of a whole text: of what overlaps those that save most, none within that of another license which saves
        more, and none that is negated."""
        if ANCHOR.search(text) is None:
            return []
        words, ranked = wording(text), set()
        for start, end, t in self.candidates(words):
            saved, share, places = self.weighed(words[start:end], t)
            name, n = self.templates[t].name, len(self.templates[t].words)
            ranked.update((-saved, Match(start + a, start + b, name, share, d, d / n)) for a, b, d in places)
        starts: list[int] = []
        taken: list[Match] = []
        for _, m in sorted(ranked, key=lambda x: (x[0], x[1].share, x[1].start, x[1].name)):
            at = bisect.bisect_right(starts, m.start)
            if not any(m.name != o.name and m.end <= o.end for o in taken[max(0, at - NEAR) : at]):
                starts.insert(at, m.start)
                taken.insert(at, m)
        begins = [w.start() for w in _WORD.finditer(text)] if taken else []
        return [m for m in taken if not negated(text, begins[m.start])]


def negated(text: str, at: int) -> bool:
    """Whether a negation comes before a place in its clause; the character there tells whether a line begins with a capital."""
    clause = CLAUSE.split(text[max(0, at - BACK) : at + 1])[-1]
    return not NEGATIONS.isdisjoint(_WORD.findall(clause.lower()))


_LOADED: dict[tuple, Scanner] = {}


def scan(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """doc_id, n_licenses, licenses, saved, differing for every row of docs: the distinct licenses found in its whole text in
    code-point order, the largest saving (0 at least) and the fewest differing words (null without licenses). A null or
    empty text has none; repeated rows are scanned alike; extra columns are left out; an empty table gives an empty one.
    One scan, no shuffle."""
    items = tuple((k, tuple(v)) for k, v in templates.items())

    @F.pandas_udf("n_licenses int, licenses array<string>, saved double, differing int")
    def run(texts: pd.Series) -> pd.DataFrame:
        if items not in _LOADED:
            _LOADED.clear()
            _LOADED[items] = Scanner(dict(items))
        scanner, out = _LOADED[items], []
        for t in texts:
            found = scanner.find(t or "")
            names = sorted({m.name for m in found})
            out.append((len(names), names, max([0.0, *(m.saved for m in found)]), min((m.differing for m in found), default=None)))
        frame = pd.DataFrame(out, columns=["n_licenses", "licenses", "saved", "differing"])
        return frame.astype({"differing": "Int32", "n_licenses": "int32", "saved": "float64"})

    return docs.select("doc_id", run("text").alias("got")).select("doc_id", "got.*")
