"""Evaluation passages inside a corpus, found by one Aho-Corasick automaton.

The held-out items are normalised to words, stripped of the instructions many of them share, and
every run of ``SEED`` successive words of an item becomes a pattern of one automaton that knows the
items and positions that hold it. Each document is normalised by the same function and scanned once.
A hit ties a place in the document to a position in an item, that is, to a diagonal; only the
diagonals that hits name are compared with the item, word by word, and the matched pieces on them
are chained. Word offsets lead back to the original text.

A passage is a stretch of at least ``LEAST`` item words found in order, of which up to one in
``ONE_IN`` may be replaced, wherever in the passage the replaced words stand. Whole other lines may
stand between its lines, any number of them, so a piece may be followed by one on a later line if the
two reach the end and the start of their lines but for replaced words and ``SLACK`` others. Beside the
diagonals of an item's hits, a line counts if it holds two words of the item in a row, or has at most
``SEED`` words and any of the item.

Items of one kind share turns of phrase, so items compete for a passage with replaced words: it is
only an item's own if no other item with other words, and not the passages found so far together,
explain the same stretch of the document as well or better. A passage of ``LEAST`` words without a
replaced one always counts.

The items are the query set and do not grow with the corpus; their size is checked before they are
read, and they are scanned in blocks of ``MOST_WORDS`` words.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from wirelake.session import spread

#: Words of a pattern, of the shortest passage, and words per replaced word.
SEED, LEAST, ONE_IN = 3, 20, 7
#: Words that may stand beside a passage, such as a key or a call, on the two lines between which
#: whole other lines are skipped.
SLACK = 4
#: Item words that one automaton holds; more items are taken in further blocks.
MOST_WORDS = 2_000_000
#: Characters of all items together; a larger table is no query set and is refused.
MOST_CHARACTERS = 500_000_000
#: An opening paragraph that so many items share is an instruction.
SHARED = 3

_ESCAPE = re.compile(r"\\+(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|[nrtbfv0abe\"'/])")
_TAG = re.compile(r"</?(?:p|br|div|span|b|i|u|em|strong|li|ul|ol|code|pre|td|tr|th|table|tbody|h[1-6]|a|blockquote|tt|font|sup|sub|hr|section|article|html|body)(?:\s[^<>\n]*)?/?>", re.IGNORECASE)
_ENTITY = re.compile(r"&#?[0-9A-Za-z]{1,31};")
_PERCENT = re.compile(r"%([2-7][0-9a-fA-F])")
#: Letters and digits; combining marks and invisible joiners do not end a word.
_WORD = re.compile("[^\\W_][^\\W_\u0300-\u036f\u00ad\u200c\u200d\u2060\ufeff]*(?:[\u0300-\u036f\u00ad\u200c\u200d\u2060\ufeff]+[^\\W_]*)*")
_JOINERS = {ord(c): None for c in " \u00ad\u200c\u200d\u2060\ufeff"}
_BREAK = re.compile(r"[\n\r;]|//")
#: ASCII letters in lower case, digits, and blanks for all else
_ASCII = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256))


def _escape(m: re.Match) -> str:
    code = m.group(1) or m.group(2)
    if code:
        return " " if "\ud800" <= (c := chr(int(code, 16))) <= "\udfff" else c
    return "\n" if m.group()[-1] in "nr" else " "


#: What is undone before words are cut, in this order: a sign that must occur, the pattern, its replacement.
_LAYERS: tuple[tuple[str, re.Pattern, Callable[[re.Match], str]], ...] = (
    ("\\", _ESCAPE, _escape),
    ("&", _ENTITY, lambda m: html.unescape(m.group())),
    ("<", _TAG, lambda m: " "),
    ("%", _PERCENT, lambda m: m.group() if chr(int(m.group(1), 16)).isalnum() else " "),
)


def unwrapped(text: str, places: bool = False) -> tuple[str, np.ndarray | None, np.ndarray | None]:
    """The text without escapes and markup; with ``places`` also where each character begins and
    ends in the original."""
    begins = np.arange(len(text)) if places else None
    ends = np.arange(1, len(text) + 1) if places else None
    for sign, pattern, change in _LAYERS:
        if sign not in text:
            continue
        if not places:
            text = pattern.sub(change, text)
            continue
        parts, first, last, at = [], [], [], 0
        for m in pattern.finditer(text):
            new = change(m)
            parts += [text[at : m.start()], new]
            a, z = begins[m.start()], ends[m.end() - 1]
            first += [begins[at : m.start()], np.full(len(new), a)]
            last += [ends[at : m.start()], np.full(len(new), z)]
            at = m.end()
        if parts:
            text = "".join([*parts, text[at:]])
            begins, ends = np.concatenate([*first, begins[at:]]), np.concatenate([*last, ends[at:]])
    return text, begins, ends


def _word(word: str) -> str:
    return word.lower() if word.isascii() else unicodedata.normalize("NFKC", word).translate(_JOINERS).casefold()


def words_of(text: str) -> list[str]:
    """The words of a text: letter case, punctuation, layout, comment and quote marks, escapes and
    markup are gone, and each word has its composed form."""
    return _words(unwrapped(text)[0])


def _words(plain: str) -> list[str]:
    if plain.isascii():
        # the same as the expression, in three passes of C
        return plain.encode().translate(_ASCII).decode().split()
    return [_word(w) for w in _WORD.findall(plain)]


def places_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last character (exclusive) in the original of each of :func:`words_of`, and its line."""
    plain, begins, ends = unwrapped(text, places=True)
    if plain.isascii():
        edges = np.diff(np.frombuffer(plain.encode().translate(_ASCII), np.uint8) != 32, prepend=False, append=False).nonzero()[0]
        first, last = edges[::2], edges[1::2] - 1
    else:
        first, last = np.array([(m.start(), m.end() - 1) for m in _WORD.finditer(plain)], np.int64).reshape(-1, 2).T
    # statements of one-line files count as lines
    breaks = np.array([m.start() for m in _BREAK.finditer(plain)], np.int64)
    return begins[first], ends[last], np.searchsorted(breaks, first)


def bodies(items: dict[int, str], shared: int = SHARED) -> dict[int, list[str]]:
    """Words of each item without its opening instructions: leading paragraphs, the last one never
    among them, that at least ``shared`` items hold word for word."""
    paragraphs = {i: [w for p in re.split(r"\n\s*\n", t or "") if (w := words_of(p))] for i, t in items.items()}
    seen = Counter(w for ps in paragraphs.values() for w in {tuple(p) for p in ps})
    out = {}
    for i, ps in paragraphs.items():
        k = 0
        while k < len(ps) - 1 and seen[tuple(ps[k])] >= shared:
            k += 1
        out[i] = [w for p in ps[k:] for w in p]
    return out


@dataclass
class Passage:
    """A passage of item number ``item``: item words ``first`` to ``last``, ``replaced`` of them not
    found, and the document words of its pieces as (first, last)."""

    item: int
    first: int
    last: int
    replaced: int
    pieces: list[tuple[int, int]]

    @property
    def size(self) -> int:
        return self.last - self.first + 1


class Matcher:
    """The automaton over a block of items, and the alignment of a document with those it names."""

    def __init__(self, items: dict[int, list[str]], seed: int = SEED, least: int = LEAST, one_in: int = ONE_IN) -> None:
        self.seed, self.least, self.one_in = seed, least, one_in
        self.ids = [i for i, w in items.items() if len(w) >= least]
        self.words = words = [items[i] for i in self.ids]
        self.texts = [" " + " ".join(ws) + " " for ws in words]
        # all item words in one array: their codes, their items, and where each item begins
        self.vocabulary: dict[str, int] = {}
        self.coded = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for ws in words for w in ws], np.int64)
        self.sizes = np.array([len(ws) for ws in words], np.int64)
        self.owner = np.repeat(np.arange(len(words)), self.sizes)
        self.begins = np.cumsum(self.sizes) - self.sizes
        patterns: dict[str, list[int]] = defaultdict(list)
        for begin, ws in zip(self.begins.tolist(), words, strict=True):
            for p in range(len(ws) - seed + 1):
                patterns[" " + " ".join(ws[p : p + seed]) + " "].append(begin + p)
        # a hit gives the number of its pattern, which gives the item words where the pattern begins
        self.automaton = ahocorasick.Automaton()
        for number, p in enumerate(patterns):
            self.automaton.add_word(p, number)
        if patterns:
            self.automaton.make_automaton()
        self.holding = np.array([p for held in patterns.values() for p in held], np.int64)
        self.holders = np.array([len(held) for held in patterns.values()], np.int64)
        self.held_from = np.cumsum(self.holders) - self.holders
        self.far = self.owner * (2 * one_in * (len(self.coded) + 1))
        # runs of one to ``seed`` - 1 words as single numbers, for lines that hold no pattern
        self.runs = [self._numbers(self.coded, np.arange(len(self.coded) - n + 1), n) for n in range(1, seed)]
        self.sorted_runs = [np.argsort(r, kind="stable") for r in self.runs]
        # without a hit of its own, a passage lies in pieces of fewer than ``seed`` words on lines of
        # their own; so many lines that takes, the shortest passages of each number of replaced words
        # being the worst
        sizes = [max(least, n * one_in) for n in range(least // one_in + 2)]
        self.parted = min(-(-(x - x // one_in) // (seed - 1)) - x // one_in for x in sizes)

    def _numbers(self, codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for x in range(n):
            out = out * (len(self.vocabulary) + 1) + codes[at + x]
        return out

    def items_in(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, first, last character) of every passage-bearing item of a text, the place being
        that of the longest passage."""
        words = words_of(text)
        if len(words) < self.least - self.least // self.one_in or not len(self.holding):
            return []
        # the scan: one pass over the normalised text
        hits = list(self.automaton.iter(" " + " ".join(words) + " "))
        if not hits:
            return []
        get = self.vocabulary.get
        doc = np.array([get(w, -1) for w in words], np.int64)
        # no item can have a passage of which too many words stand nowhere in the document
        present = np.zeros(len(self.vocabulary) + 1, bool)
        present[doc] = True
        present[-1] = False
        able = np.zeros(len(self.ids), bool)
        able[self.owner[self.stretches(present[self.coded], self.far)]] = True
        if not able.any():
            return []
        hits = np.array(hits, np.int64)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        # each hit ties its place to the item words that hold it; one diagonal is one difference
        n = self.holders[hits[:, 1]]
        q = np.repeat(np.searchsorted(ends, hits[:, 0]) - self.seed + 1, n)
        p = self.holding[np.repeat(self.held_from[hits[:, 1]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        use = able[self.owner[p]]
        p, q = p[use], q[use]
        diagonals = np.unique(self._pairs(self.owner[p], q - p, len(words)))
        first, last, lines = places_of(text)
        starts = np.append(np.flatnonzero(np.diff(lines, prepend=-1)), len(lines))
        named = np.zeros(len(self.ids), bool)
        named[self.owner[p]] = True
        item, diagonal = self._unpaired(diagonals, len(words))
        pieces = self.pieces(item, diagonal, np.zeros_like(item), np.full_like(item, len(words)), doc, lines)
        pieces = np.concatenate([pieces, *self.short_pieces(doc, lines, starts, diagonals, named, able)])
        # only pieces in stretches of an item of which enough words are matched somewhere
        here = np.zeros(len(self.coded) + 1, np.int64)
        np.add.at(here, pieces[:, 3], 1)
        np.add.at(here, pieces[:, 3] + pieces[:, 4], -1)
        at = np.flatnonzero(able[self.owner])
        inside = np.zeros(len(self.coded), np.int64)
        inside[at] = self.stretches(np.cumsum(here)[at] > 0, self.far[at])
        inside = np.append(0, np.cumsum(inside))
        pieces = pieces[inside[pieces[:, 3] + pieces[:, 4]] > inside[pieces[:, 3]]]
        if not len(pieces):
            return []
        pieces = pieces[np.argsort(pieces[:, 0] * len(words) + pieces[:, 2], kind="stable")]
        # words before and after each piece on its line
        line = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[pieces[:, 2]]
        pieces = np.column_stack([pieces, pieces[:, 2] - starts[line], starts[line + 1] - pieces[:, 2] - pieces[:, 4]])
        found = {}
        cuts = np.flatnonzero(np.diff(pieces[:, 0], prepend=-1)).tolist()
        for a, z in zip(cuts, [*cuts[1:], len(pieces)], strict=False):
            item = int(pieces[a, 0])
            if passages := self.chained(item, pieces[a:z, 1:].tolist()):
                found[item] = passages
        return [(self.ids[x.item], int(first[x.pieces[0][0]]), int(last[x.pieces[-1][1]])) for x in self.own(found, lines)]

    def _pairs(self, k: np.ndarray, diagonal: np.ndarray, words: int) -> np.ndarray:
        """Items and diagonals (document word less item word of all) as single numbers, by item first."""
        return k * (words + len(self.coded)) + diagonal + len(self.coded)

    def _unpaired(self, pairs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        k, diagonal = np.divmod(pairs, words + len(self.coded))
        return k, diagonal - len(self.coded)

    def pieces(self, item: np.ndarray, diagonal: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, lines: np.ndarray, most: int = 1 << 20) -> np.ndarray:
        """Matched runs on the given diagonals of items between document words ``low`` and ``high``,
        parted at line ends: rows (item, line, document word, item word of all, words). ``most`` bounds
        the words compared at once."""
        out = [np.empty((0, 5), np.int64)]
        low = np.maximum(self.begins[item], low - diagonal)
        sizes = np.minimum(self.begins[item] + self.sizes[item], high - diagonal) - low
        for at in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1) if len(sizes) else ():
            k, n = item[at], sizes[at]
            total = np.cumsum(n)
            p = np.arange(total[-1]) + np.repeat(low[at] - total + n, n)
            q = p + np.repeat(diagonal[at], n)
            same = np.flatnonzero(doc[q] == self.coded[p])
            p, q, pair = p[same], q[same], np.searchsorted(total, same, "right")
            line = lines[q]
            new = np.ones(len(p), bool)
            new[1:] = (np.diff(p) != 1) | (np.diff(pair) != 0) | (np.diff(line) != 0)
            a = np.flatnonzero(new)
            out.append(np.stack([k[pair[a]], line[a], q[a], p[a], np.diff(np.append(a, len(p)))], axis=1))
        return np.concatenate(out)

    def short_pieces(self, doc: np.ndarray, lines: np.ndarray, starts: np.ndarray, diagonals: np.ndarray, named: np.ndarray, able: np.ndarray) -> list[np.ndarray]:
        """Pieces on further diagonals, each within one line: lines with two words or more in a row, and
        lines of at most ``seed`` words with any. Of the items named, or of all able ones where a
        passage could consist of short lines alone."""
        sizes = np.diff(starts)
        at = np.repeat(np.arange(len(sizes)), sizes)
        found, few = [], 0
        for n in range(1, self.seed):
            q = np.arange(len(doc) - n + 1)
            q = q[(doc[q] >= 0) & (sizes[at[q]] <= self.seed if n == 1 else at[q] == at[q + n - 1])]
            runs, order = self.runs[n - 1], self.sorted_runs[n - 1]
            key = self._numbers(doc, q, n)
            lo, hi = (np.searchsorted(runs, key, side, sorter=order) for side in ("left", "right"))
            few += len(np.unique(at[q[(hi > lo) & (sizes[at[q]] == n)]]))
            found.append((q, order, lo, hi))
        if few >= self.parted:
            named = able
        out = []
        for n, (q, order, lo, hi) in enumerate(found, 1):
            i = np.repeat(np.arange(len(q)), hi - lo)
            p = order[np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)]
            use = named[self.owner[p]] & (self.owner[p] == self.owner[p + n - 1])
            p, q = p[use], q[i[use]]
            pair = self._pairs(self.owner[p], q - p, len(doc))
            use = np.append(diagonals, -1)[np.searchsorted(diagonals, pair)] != pair
            pair, line = pair[use], at[q[use]]
            # once for each diagonal and line, however many runs it has there
            _, once = np.unique(pair * len(starts) + line, return_index=True)
            item, diagonal = self._unpaired(pair[once], len(doc))
            out.append(self.pieces(item, diagonal, starts[line[once]], starts[line[once] + 1], doc, lines))
        return out

    def stretches(self, here: np.ndarray, far: np.ndarray) -> np.ndarray:
        """For each item word whether it lies in a stretch of ``least`` or more words of its item of
        which at most one in ``one_in`` is not ``here``; ``far`` parts the items, see below."""
        # that is where the score, 1 a word less ``one_in`` a missing one, is not negative; running
        # scores of later items lie ``far`` lower, so that none begins in another item
        step = np.where(here, 1, 1 - self.one_in)
        score = np.cumsum(step) - far
        lowest = np.minimum.accumulate(score - step)
        good = score[self.least - 1 :] >= lowest[: max(0, len(score) - self.least + 1)]
        if not good.any():
            return np.zeros(len(here), bool)
        ends = np.full(len(score), np.iinfo(np.int64).min)
        ends[self.least - 1 :][good] = score[self.least - 1 :][good]
        return np.maximum.accumulate(ends[::-1])[::-1] >= lowest

    def chained(self, k: int, pieces: list[list[int]]) -> list[Passage]:
        """Passages of item ``k`` made of pieces, which come in order of their lines.

        A piece follows one on the same diagonal of its line, or one on an earlier line as the module
        says; item words between two pieces are replaced ones. Of the chains that end with an item word
        and as many words before the end of the line, those are kept that no chain beats in both length
        and replaced words; that is at most one for each number of replaced words the item allows,
        however often the document repeats itself.
        """
        begin, length, one_in = int(self.begins[k]), int(self.sizes[k]), self.one_in
        most = length // one_in
        # a chain: (first item word, replaced words, piece, chain before)
        tails: dict[int, dict[int, list[tuple]]] = {}
        ended: list[int] = []
        waiting: list[tuple[int, int, list[tuple]]] = []
        beside: dict[int, tuple[int, list[tuple]]] = {}
        complete: list[tuple[int, tuple]] = []
        now = -1
        for piece in pieces:
            line, q, p, n, head, tail = piece
            p -= begin
            if line != now:
                for end, left, chains in waiting:
                    if end not in tails:
                        ended.insert(bisect_left(ended, end), end)
                        tails[end] = {}
                    before = tails[end].get(left)
                    tails[end][left] = _best([*chains, *before]) if before else chains
                waiting, beside, now = [], {}, line
            last = p + n - 1
            chains = [(p, 0, piece, None)]
            if before := beside.get(q - p):
                gap = p - before[0] - 1
                chains += [(c[0], c[1] + gap, piece, c) for c in before[1]]
            if head <= SLACK + most:
                for end in ended[bisect_left(ended, p - 1 - most) :]:
                    if end >= last:
                        break
                    gap = max(0, p - end - 1)
                    # words of this piece that the chain already has stand beside the passage
                    free = gap + SLACK - head - max(0, end + 1 - p)
                    for left, before in tails[end].items():
                        if left <= free:
                            chains += [(c[0], c[1] + gap, piece, c) for c in before]
            chains = _best([c for c in chains if c[1] * one_in <= length - c[0]])
            beside[q - p] = (last, chains)
            if tail <= SLACK + most:
                waiting.append((last, tail, chains))
            complete += [(last, c) for c in chains if last - c[0] + 1 >= self.least and c[1] * one_in <= last - c[0] + 1]
        used: set[int] = set()
        out = []
        for last, chain in sorted(complete, key=lambda x: (x[1][0] - x[0], x[1][1])):
            if id(chain) in used:
                continue
            found, at = [], chain
            while at is not None:
                used.add(id(at))
                found.append((at[2][1], at[2][1] + at[2][3] - 1))
                at = at[3]
            out.append(Passage(k, chain[0], last, chain[1], found[::-1]))
        return out

    def own(self, found: dict[int, list[Passage]], lines: np.ndarray) -> list[Passage]:
        """Of each item the longest passage that is more than a turn of phrase that items share.

        Passages without a replaced word are. The others follow, those of the most words first: each
        must have more words of its stretch of the document than each other item has there, and than
        the passages before it have together; items that hold the very words of the passage do not
        compete with it.
        """
        if len(found) == 1 and not (x := next(iter(found.values())))[0].replaced:
            return x[:1]
        words = {id(x): {q for a, z in x.pieces for q in range(a, z + 1)} for xs in found.values() for x in xs}
        every = {k: set().union(*(words[id(x)] for x in xs)) for k, xs in found.items()}
        explained: dict[int, set[int]] = {k: set() for k in found}
        best: dict[int, Passage] = {}
        for x in sorted((x for xs in found.values() for x in xs), key=lambda x: (x.replaced > 0, x.replaced - x.size)):
            k, mine = x.item, words[id(x)]
            if x.replaced and len(found) > 1:
                on = {int(lines[q]) for q in mine}
                stretch = {q for q in range(x.pieces[0][0], x.pieces[-1][1] + 1) if int(lines[q]) in on}
                text = " " + " ".join(self.words[k][x.first : x.last + 1]) + " "
                rivals = [o for o in found if o != k and text not in self.texts[o]]
                together = set().union(*(explained[o] for o in rivals))
                if max(len(stretch & s) for s in (together, *(every[o] for o in rivals))) >= len(mine):
                    continue
            explained[k] |= mine
            if k not in best or x.size > best[k].size:
                best[k] = x
        return [best[k] for k in found if k in best]


def _best(chains: list[tuple]) -> list[tuple]:
    """Chains to one end that no other beats in both length and replaced words; of equal ones the first."""
    if len(chains) == 1:
        return chains
    out, fewest = [], 1 << 60
    for c in sorted(chains, key=lambda c: (c[0], c[1])):
        if c[1] < fewest:
            out.append(c)
            fewest = c[1]
    return out


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """Every document that carries a passage of an item: ``doc_id, item_id, start, end``, the
    characters of the longest passage in the original text, one row per document and item.

    * NULL and empty texts carry nothing; NULL ids pass through; items shorter than a passage, or with
      NULL text, are never found; items with equal texts are all reported; repeated documents are
      reported as often as they stand there; an empty table on either side gives an empty result;
      other columns, whatever their names, are ignored.
    * Items compete within a block of ``most_words``; items of more than ``MOST_CHARACTERS`` raise.
    """
    wanted = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    size = wanted.agg(F.sum(F.length("t"))).first()[0] or 0
    if size > MOST_CHARACTERS:
        raise ValueError(f"items of {size} characters are no query set; at most {MOST_CHARACTERS}")
    rows: list[Row] = wanted.collect()
    cleaned = bodies({n: r["t"] for n, r in enumerate(rows)})
    blocks: list[dict[int, list[str]]] = [{}]
    size = 0
    for n, words in cleaned.items():
        if size + len(words) > most_words and blocks[-1]:
            blocks.append({})
            size = 0
        blocks[-1][n] = words
        size += len(words)
    names = {n: r["i"] for n, r in enumerate(rows)}
    docs = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where(F.length("text") > 0)
    kind = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kind[0]}, item_id {kind[1]}, start long, end long"
    out = None
    for block in blocks:
        shared = documents.sparkSession.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for batch in batches:
                ids, found = [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    for hit in matcher.items_in(text):
                        ids.append(row)
                        found.append(hit)
                if found:
                    i, a, z = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array([names[x] for x in i]), pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["doc_id", "item_id", "start", "end"])

        part = spread(docs).mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return out


def contaminated(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id long, item_id long`` of :func:`leaked`, each pair once."""
    return leaked(documents, items).select("doc_id", "item_id").distinct()
