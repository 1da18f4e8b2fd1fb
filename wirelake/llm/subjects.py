"""Subject areas of documents by interpolated n-gram language models.

Every subject has a language model over the words of identifiers, remarks, strings and data; a
background model covers what belongs to none. The probability of a word after another interpolates

* its conditional in the source, pair counts over the mass of the first word, smoothed by the unigram
  of the source, with the conditional in all sources together,
* and its unigram in the source, which itself interpolates the word, its consonant skeleton, which
  abbreviations share with the words they stand for, the uniform and the overall distribution.

The weights of the unigram's parts are fitted by expectation-maximization on halves of the sample that
the counts have not seen; that of the overall conditional is calibrated on the same halves. A line is
ascribed to the subject whose cross-entropy lies furthest below the background's, and its words whose
own cross-entropy lies ``BEARING`` below count for that subject. A document has every subject that
holds a calibrated share of all bearing words.

The models are trained on all labelled documents. Labels are noisy and incomplete and a labelled
document is mostly background, so the words of a document are divided among its labels, the other
subjects and the background by expectation-maximization. All evaluation items are trained as
background, as carried items do not count for a subject; together they weigh no more than one for
every ``PER_ITEM`` labelled documents.

The documents stay on the executors as numbers, in parts. Every round sends them the distributions of
words and adds up what comes back by ranges of words; pairs are added up by their first word. The
driver holds the distributions, never documents.
"""

from __future__ import annotations

import pickle
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.leakage import _ESCAPE, _escape
from wirelake.session import cut, forget, kept, shuffle_width, small_side, spread

#: Labelled documents for each evaluation item in the weight of all items.
PER_ITEM = 40
#: Tokens of a part, the unit that the rounds work on, and of a task's parts at least and at most.
PART, LEAST_TASK, MOST_TASK = 200_000, 100_000, 5_000_000
#: Words of a range that is added up at once.
RANGE = 8192
#: Different words or pairs that a task holds before it hands them on.
FLUSH = 500_000
#: Subject codes, at most; a larger table is no list of subjects and is refused.
MOST_CODES = 10_000
#: Words of a token kept apart from abbreviations; shorter ones say too little.
SHORTEST = 2
#: Log ratio to the background from which a word bears a subject.
BEARING = 1.0
#: Subjects of a document, at most.
MOST_SUBJECTS = 2
#: Labelled documents from which on halves are held out to choose thresholds.
LEAST_HALVED = 40

_TOKEN = re.compile(r"[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+(?![a-zß-öø-ÿ])|[^\W\d_]+")
_REMARK = re.compile(r"\s*(?://+|#+|/?\*+/?|--+|;+|<!--|\"\"\"|'''|%+|rem\b)", re.IGNORECASE)
_LICENCE = re.compile(r"licen[cs]e|copyright|warranty|all rights reserved|property of|confidential|permission is|terms|liability", re.IGNORECASE)
#: What only a licence says.
_SURELY = re.compile(r"spdx|\(c\)\s*\d{4}|©\s*\d{4}|all rights reserved|^\W*(?:licen[cs]e\b\s*[:=]|copyright\s+(?:\(c\)|©|\d{4}|[A-Z]))", re.IGNORECASE | re.MULTILINE)
_CLOSING = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
_TITLE = re.compile(r"\W*(?:licen[cs]e\b|copyright\b|spdx)", re.IGNORECASE)
_VOWELS = str.maketrans("", "", "aeiouäöüáéíóúàèìòùâêîôû")


def _speaks_of_licence(block: str) -> bool:
    """Whether a remark is a licence: it says what only one says, or uses two of its words."""
    return bool(_SURELY.search(block)) or len({m.lower() for m in _LICENCE.findall(block)}) > 1


def without_header(text: str) -> str:
    """The text without a licence header: leading remark blocks that are a licence. What follows a
    block's closing mark on its line stays."""
    lines, at = text.lstrip("\ufeff").splitlines(), 0
    while True:
        start = at
        while start < len(lines) and (not lines[start].strip() or lines[start].startswith("#!")):
            start += 1
        end, rest = start, ""
        opening = next((m for m in _CLOSING if start < len(lines) and lines[start].lstrip().startswith(m)), None)
        if opening:
            while end < len(lines):
                begin = lines[end].index(opening) + len(opening) if end == start else 0
                closed = lines[end].find(_CLOSING[opening], begin)
                end += 1
                if closed >= 0:
                    rest = lines[end - 1][closed + len(_CLOSING[opening]) :]
                    break
                if end < len(lines) and not lines[end].strip():
                    break
        else:
            while end < len(lines) and lines[end].strip() and _REMARK.match(lines[end]):
                end += 1
        if end == start and start < len(lines) and _TITLE.match(lines[start]):
            # prose has no remark marks: the paragraph under a licence line belongs to it
            while end < len(lines) and lines[end].strip():
                end += 1
        block = "\n".join(lines[start:end])
        if end == start or not _speaks_of_licence(block[: len(block) - len(rest)]):
            return "\n".join(lines[at:])
        if rest.strip():
            lines[end - 1] = rest
            end -= 1
        at = end


def tokenized(text: str | None) -> list[list[str]]:
    """Lower-case words of each line that has any; identifiers are split at case and underscores."""
    if not text:
        return []
    text = without_header(text)
    if "\\" in text:
        text = _ESCAPE.sub(_escape, text)
    out = []
    for line in text.splitlines():
        words = [p for w in _TOKEN.findall(line) if (p := _PLAIN[w])]
        # minified files hold everything in one line, so long lines are cut at statements
        if len(words) > 60:
            for part in re.split(r"[;{}]|//|/\*", line):
                if words := [p for w in _TOKEN.findall(part) if (p := _PLAIN[w])]:
                    out.append(words)
        elif words:
            out.append(words)
    return out


def plain(word: str) -> str:
    """Lower case without the plural s."""
    word = word.lower()
    return word[:-1] if len(word) > 4 and word[-1] == "s" and word[-2] not in "sui" else word


class _Plain(dict):
    """:func:`plain` of words seen before; empty for words that are too short."""

    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = plain(word) if len(word) >= SHORTEST else ""
        return out


_PLAIN = _Plain()


def skeleton(word: str) -> str:
    """The word without the vowels after its first letter."""
    return word[:1] + word[1:].translate(_VOWELS)


@dataclass
class Model:
    """The trained models. Rows of ``uni`` and ``skel`` are log ratios of each subject to the
    background; ``share`` and ``least`` are the calibrated thresholds."""

    subjects: list[str]
    vocabulary: dict[str, int]
    uni: np.ndarray
    skeletons: dict[str, int]
    skel: np.ndarray
    pairs: np.ndarray
    pair_ratio: np.ndarray
    share: float = 0.22
    least: float = 3.0
    _known: dict[str, int] = field(default_factory=dict, repr=False)
    _table: np.ndarray | None = field(default=None, repr=False)
    _used: int = field(default=0, repr=False)
    _sorted: dict[str, list[str]] = field(default_factory=dict, repr=False)

    def resolved(self, word: str) -> tuple[int, np.ndarray]:
        """Vocabulary number (-1 for none) and log ratios of a word."""
        row = self._row(word)
        return (row if row < len(self.uni) else -1), self._table[row]

    def _row(self, word: str) -> int:
        """Row of a word in the table of ratios: that of the vocabulary, or one made for it."""
        if self._table is None or len(self._known) > 300_000:
            # the rows of the vocabulary, one of zeros, and room for words that come up
            self._known = dict(self.vocabulary)
            self._table = np.concatenate([self.uni, np.zeros((1024, len(self.subjects)), np.float32)])
            self._used = len(self.uni) + 1
        if (row := self._known.get(word)) is None:
            ratios = self._unseen(word)
            row = len(self.uni)
            if ratios.any():
                if self._used == len(self._table):
                    self._table = np.concatenate([self._table, np.zeros_like(self._table)])
                row, self._used = self._used, self._used + 1
                self._table[row] = ratios
            self._known[word] = row
        return row

    def _beginning(self, form: str, table: dict[str, int]) -> list[int]:
        """Numbers of the at most three entries of a table that begin with a form; more say nothing."""
        kind = "words" if table is self.vocabulary else "skeletons"
        if kind not in self._sorted:
            self._sorted[kind] = sorted(table)
        names = self._sorted[kind]
        at = bisect_left(names, form)
        found = [x for x in names[at : at + 4] if x.startswith(form)]
        return [table[x] for x in found] if len(found) <= 3 else []

    def _unseen(self, word: str) -> np.ndarray:
        form = skeleton(word)
        if len(form) >= 3 and (k := self.skeletons.get(form)) is not None:
            return self.skel[k]
        # words run together and cut short: a known word in front, or a known word's beginning
        for cut in range(len(word) - 1, 4, -1):
            if (k := self.vocabulary.get(word[:cut])) is not None:
                return self.uni[k]
        for text, table, rows in ((word, self.vocabulary, self.uni), (form, self.skeletons, self.skel)):
            if len(text) >= 4 and (found := self._beginning(text, table)):
                return rows[found].mean(axis=0)
        return np.zeros(len(self.subjects), np.float32)

    def weights(self, lines: list[list[str]]) -> np.ndarray:
        """Bearing words of each subject in a tokenized document."""
        return self.weights_of([lines])[0]

    def weights_of(self, docs: list[list[list[str]]]) -> np.ndarray:
        """Bearing words of each subject (columns) in tokenized documents (rows)."""
        known = self._known
        rows = [known[w] if w in known else self._row(w) for lines in docs for line in lines for w in line]
        if known is not self._known:  # the table began anew in between
            rows = [self._row(w) for lines in docs for line in lines for w in line]
        sizes = np.array([len(line) for lines in docs for line in lines], np.int64)
        owner = np.repeat(np.arange(len(docs)), [len(lines) for lines in docs])
        return self.rated(np.array(rows, np.int64), sizes, owner, len(docs))

    def weights_in(self, data: Corpus) -> np.ndarray:
        """The same of a corpus."""
        known = self._known
        rows = [self._row(w) for w in data.words]
        if known is not self._known:  # the table began anew in between
            rows = [self._row(w) for w in data.words]
        return self.rated(np.array(rows, np.int64)[data.ids], data.sizes, data.owner, data.n)

    def rated(self, ids: np.ndarray, sizes: np.ndarray, owner: np.ndarray, n_docs: int) -> np.ndarray:
        """The same from rows of the table of ratios, line sizes, and the document of each line."""
        total = np.zeros((n_docs, len(self.subjects)))
        if not len(ids):
            return total
        ratio = self._table[ids]
        starts = np.cumsum(sizes) - sizes
        if len(self.pairs):
            inner = np.ones(len(ids) - 1, bool)
            inner[starts[1:] - 1] = False
            inner &= (ids[:-1] < len(self.uni)) & (ids[1:] < len(self.uni))
            at = np.flatnonzero(inner)
            key = ids[at] * len(self.vocabulary) + ids[at + 1]
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = self.pairs[place] == key
            ratio[at[hit] + 1] = self.pair_ratio[place[hit]]
        # a line's cross-entropy against the background's, summed over its words
        gain = np.add.reduceat(np.clip(ratio, -2, 5), starts, axis=0)
        subject = gain.argmax(axis=1)
        of = np.repeat(subject, sizes)
        bearing = (ratio[np.arange(len(of)), of] > BEARING) & np.repeat(gain.max(axis=1) > BEARING, sizes)
        np.add.at(total, (np.repeat(owner, sizes)[bearing], of[bearing]), 1)
        return total

    def accept(self, weights: np.ndarray) -> list[str]:
        """Subjects of a document with these weights, the strongest first."""
        total = weights.sum()
        order = np.argsort(-weights, kind="stable")[:MOST_SUBJECTS]
        return [self.subjects[s] for s in order if weights[s] >= self.least and weights[s] >= self.share * total]


@dataclass
class Corpus:
    """Tokenized documents as numbers: the different words, the word of every token, the tokens of every
    line, the document of every line, and how many documents there are."""

    words: list[str]
    ids: np.ndarray
    sizes: np.ndarray
    owner: np.ndarray
    n: int


def corpus(docs: list[list[list[str]]]) -> Corpus:
    number: dict[str, int] = {}
    ids = array("i", (number.setdefault(w, len(number)) for d in docs for line in d for w in line))
    sizes = np.array([len(line) for d in docs for line in d], np.int64)
    return Corpus(list(number), np.array(ids, np.int64), sizes, np.repeat(np.arange(len(docs)), [len(d) for d in docs]), len(docs))


#: Part of every unigram that is the overall distribution; words of few documents have more of it, half
#: of it in ``RARE`` documents.
OVERALL, RARE = 0.05, 2
#: Evidence, in words, that the unigram is worth beside the counts of a pair's first word.
PRIOR = 300
#: Part of the conditionals in the bigram; the rest is the unigram.
CONDITIONAL = 0.6
#: What the part of the overall conditional is chosen from; 1 would leave only what all sources share.
SHARED = (0.5, 0.8, 0.2)


#: Rounds of expectation-maximization.
ROUNDS = 12
#: Words that every source has of every word before any is counted.
SMOOTH = 0.02


@dataclass
class Part:
    """Some documents to learn from, as numbers of the vocabulary (-1 for none): the words of tokens with
    line sizes and the document of each line; each document's word with its frequency; the ``half`` a
    document is trained in (2 for both), the ``side`` its counts are held out from, and its weight; and the
    mixture of sources in each document by training."""

    ids: np.ndarray
    sizes: np.ndarray
    owner: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    n: np.ndarray
    half: np.ndarray
    side: np.ndarray
    weight: np.ndarray
    prior: np.ndarray
    mix: np.ndarray

    def rows(self, usable: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, word and frequency of what training ``t`` uses."""
        if t == 0:
            return self.doc, self.word, self.n
        at = _used(self.half, t)[self.doc] & usable[t][self.word]
        return self.doc[at], self.word[at], self.n[at]


def _used(half: np.ndarray, t: int) -> np.ndarray:
    """Documents of training ``t``: of all (0), of half 0 (1), of half 1 (2)."""
    return np.ones(len(half), bool) if t == 0 else (half == 2) | (half == t - 1)


def _usable(n: np.ndarray, trainings: int) -> np.ndarray:
    """Words that occur twice in a training (rows), by their counts in half 0, half 1 and both."""
    return np.stack([n.sum(axis=0), n[0] + n[2], n[1] + n[2]])[:trainings] >= 2


def _part(data: Corpus, number: dict[str, int], labels: list[set[str]], subjects: list[str], half: np.ndarray, side: np.ndarray, weight: np.ndarray, trainings: int) -> Part:
    """``labels`` are the label sets of the documents; an empty one means seen to have no subject."""
    local = np.array([number.get(w, -1) for w in data.words], np.int64)
    word, doc, v = local[data.ids], np.repeat(data.owner, data.sizes), max(1, len(number))
    key, n = np.unique((doc * v + word)[word >= 0], return_counts=True)
    doc_of, word_of = np.divmod(key, v)
    place = {s: i for i, s in enumerate(subjects)}
    prior = np.full((data.n, len(subjects) + 1), 0.004)
    prior[:, -1] = 0.6
    for i, own in enumerate(labels):
        for s in own:
            if s in place:
                prior[i, place[s]] = 0.4
    prior /= prior.sum(axis=1, keepdims=True)
    # repeats within a document say less than repeats over documents
    small = (x.astype(np.int32) for x in (word, data.sizes, data.owner, doc_of, word_of))
    return Part(*small, 1 + np.log(n), half, side, weight, prior, np.repeat(prior[None], trainings, axis=0))


def _summed(at: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(at, weight[:, c], size) for c in range(weight.shape[1])], axis=1)


def _begun(part: Part, usable: np.ndarray) -> np.ndarray:
    """The first guess: a subject's words are those of its documents, the background's are all."""
    start = part.prior * (part.prior > 0.1)
    start[:, -1] = 1
    start *= part.weight[:, None]
    out = np.empty((*usable.shape, start.shape[1]))
    for t in range(len(usable)):
        doc, word, n = part.rows(usable, t)
        out[t] = _summed(word, n[:, None] * start[doc], usable.shape[1])
    return out


def _round(part: Part, usable: np.ndarray, p: np.ndarray, last: bool) -> np.ndarray:
    """A round of expectation-maximization: expected counts by training, word and source; at last those of
    either side beside each other and the number of documents. The mixtures of the part are renewed."""
    v, c = p.shape[1:]
    out = np.empty((len(usable), v, 2 * c + 1 if last else c))
    for t in range(len(usable)):
        doc, word, n = part.rows(usable, t)
        post = part.mix[t][doc] * p[t][word]
        post *= (n / post.sum(axis=1))[:, None]
        mix = _summed(doc, post, len(part.prior)) + 30 * part.prior
        part.mix[t] = mix / mix.sum(axis=1, keepdims=True)
        weight = part.weight[doc]
        post *= weight[:, None]
        if last:
            # what the documents of one side count is held out from the other
            side = part.side[doc]
            for k in (0, 1):
                out[t, :, k * c : (k + 1) * c] = _summed(word[side == k], post[side == k], v)
            out[t, :, -1] = np.bincount(word, weight, v)
        else:
            out[t] = _summed(word, post, v)
    return out


#: Different pairs, in how many documents each is, and expected counts by source.
Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _paired(part: Part, usable: np.ndarray, p: np.ndarray) -> list[Pairs]:
    """The pairs of a part for each training."""
    v, out = max(1, p.shape[1]), []
    inner = np.ones(len(part.ids), bool)
    inner[np.cumsum(part.sizes) - part.sizes] = False
    ids = part.ids.astype(np.int64)
    at = np.flatnonzero(inner[1:] & (ids[:-1] >= 0) & (ids[1:] >= 0))
    (pairs, docs), ns = _unique_pairs(ids[at] * v + ids[at + 1], np.repeat(part.owner, part.sizes)[at])
    for t in range(len(usable)):
        pair, doc, n = pairs, docs, ns
        if t:
            use = _used(part.half, t)[doc] & usable[t][pair // v] & usable[t][pair % v]
            pair, doc, n = pair[use], doc[use], n[use]
        different, code, n_docs = np.unique(pair, return_inverse=True, return_counts=True)
        first, second = np.divmod(different, v)
        # both words of a pair come from one source, so its share is the product of both
        post = part.mix[t][doc] * p[t][first[code]] * p[t][second[code]]
        post *= (part.weight[doc] * (1 + np.log(n)) / np.maximum(post.sum(axis=1), 1e-300))[:, None]
        out.append((different, n_docs, _summed(code, post, len(different))))
    return out


def _added(several: list[Pairs]) -> Pairs:
    if len(several) == 1:
        return several[0]
    pair, n_docs, counted = (np.concatenate(x) for x in zip(*several, strict=True))
    different, code = np.unique(pair, return_inverse=True)
    return different, np.bincount(code, n_docs, len(different)).astype(np.int64), _summed(code, counted, len(different))


def _settled(pairs: Pairs, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that count, with their counts; first words with the counts of all their pairs."""
    pair, n_docs, counted = pairs
    first, code = np.unique(pair // max(1, v), return_inverse=True)
    # what only one document holds may be there by chance
    often = n_docs >= 2
    return pair[often], counted[often], first, _summed(code, counted, len(first))


class Here:
    """Passes over parts in memory."""

    def __init__(self, parts: list[Part]) -> None:
        self.parts = parts

    def words(self, work: Callable[..., np.ndarray], *args: object) -> np.ndarray:
        """The sum of what ``work`` gives for all parts: arrays by training, word and column."""
        return sum(work(x, *args) for x in self.parts)

    def pairs(self, usable: np.ndarray, p: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Settled pairs of every training; the last pass, after which the parts go."""
        return [_settled(_added(list(x)), p.shape[1]) for x in zip(*(_paired(x, usable, p) for x in self.parts), strict=True)]


def _bytes(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


class There:
    """Passes over parts on the executors: a table of one part a row. A pass writes the renewed parts to
    the shared folder, where they take the place of those before."""

    STATE = "block int, source int, part binary, words binary, sums binary"
    PAIRS = "block int, t int, source int, pairs binary, n binary, sums binary"
    SETTLED = "t int, pairs binary, sums binary, firsts binary, first_sums binary"

    def __init__(self, parts: DataFrame) -> None:
        self.state, self.sc, self.blocks = parts, parts.sparkSession.sparkContext, 4 * shuffle_width(parts.sparkSession)

    def words(self, work: Callable[..., np.ndarray], usable: np.ndarray, *args: object) -> np.ndarray:
        shared = self.sc.broadcast((usable, *args))

        trainings, v = usable.shape

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, source = None, TaskContext.get().partitionId()

            def row(*values: object) -> pa.RecordBatch:
                kinds = pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()
                return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds, strict=True)], ["block", "source", "part", "words", "sums"])

            for batch in batches:
                for blob in batch.column(0):
                    part = pickle.loads(blob.as_buffer())
                    out = work(part, *shared.value)
                    total = out if total is None else np.add(total, out, out=total)
                    yield row(-1, source, pickle.dumps(part, 5), None, None)
            for at in range(0, 0 if total is None else v, RANGE):
                some = total[:, at : at + RANGE]
                if len(there := np.flatnonzero(some.any(axis=(0, 2)))):
                    yield row(at // RANGE, source, None, _bytes(there, "i4"), _bytes(some[:, there], "f4"))

        def add(rows: pa.Table) -> pa.Table:
            total = None
            for x in sorted(rows.to_pylist(), key=lambda x: x["source"]):
                there = np.frombuffer(x["words"], "i4")
                some = np.frombuffer(x["sums"], "f4").reshape(trainings, len(there), -1)
                if total is None:
                    total = np.zeros((trainings, min(RANGE, v - x["block"] * RANGE), some.shape[2]))
                total[:, there] += some
            return pa.table({"block": pa.array([x["block"]], pa.int32()), "sums": pa.array([_bytes(total, "f4")], pa.binary())})

        before, self.state = self.state, kept(self.state.where("block < 0").select("part").mapInArrow(task, self.STATE))
        got = self.state.where("block >= 0").select("block", "source", "words", "sums").groupBy("block").applyInArrow(add, "block int, sums binary").collect()
        forget(before)
        shared.destroy()
        # every word of the vocabulary is in some part, so no range is missing
        blocks = [np.frombuffer(r["sums"], "f4").reshape(trainings, min(RANGE, v - r["block"] * RANGE), -1) for r in sorted(got, key=lambda r: r["block"])]
        return np.concatenate(blocks, axis=1).astype(float) if blocks else np.zeros((trainings, 0, 1))

    def pairs(self, usable: np.ndarray, p: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        shared, blocks, (trainings, v, c) = self.sc.broadcast((usable, p)), self.blocks, p.shape

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, source = [[] for _ in range(trainings)], TaskContext.get().partitionId()

            def handed() -> Iterator[pa.RecordBatch]:
                for t, several in enumerate(held):
                    pair, n_docs, counted = _added(several)
                    block = pair // max(1, v) % blocks
                    order = np.argsort(block, kind="stable")
                    for at in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                        if len(at):
                            values = [block[at[0]]], [t], [source], [_bytes(pair[at], "i8")], [_bytes(n_docs[at], "i8")], [_bytes(counted[at], "f4")]
                            kinds = [pa.int32()] * 3 + [pa.binary()] * 3
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(values, kinds, strict=True)], ["block", "t", "source", "pairs", "n", "sums"])
                    several.clear()

            waiting = 0
            for batch in batches:
                for blob in batch.column(0):
                    for several, new in zip(held, _paired(pickle.loads(blob.as_buffer()), *shared.value), strict=True):
                        several.append(new)
                        waiting += len(new[0])
                    if waiting > FLUSH:
                        for several in held:
                            several[:] = [_added(several)]
                        waiting = sum(len(x[0][0]) for x in held)
                        if waiting > FLUSH // 2:
                            yield from handed()
                            waiting = 0
            if waiting:
                yield from handed()

        def add(rows: pa.Table) -> pa.Table:
            ordered = sorted(rows.to_pylist(), key=lambda x: (x["source"], x["pairs"]))
            several = [(np.frombuffer(x["pairs"], "i8"), np.frombuffer(x["n"], "i8"), np.frombuffer(x["sums"], "f4").reshape(-1, c).astype(float)) for x in ordered]
            out = _settled(_added(several), v)
            return pa.table({"t": pa.array([ordered[0]["t"]], pa.int32())} | {k: pa.array([_bytes(x, kind)], pa.binary()) for k, x, kind in zip(("pairs", "sums", "firsts", "first_sums"), out, ("i8", "f4", "i8", "f4"), strict=True)})

        got = self.state.where("block < 0").select("part").mapInArrow(task, self.PAIRS).groupBy("block", "t").applyInArrow(add, self.SETTLED).collect()
        forget(self.state)
        shared.destroy()
        out = []
        for t in range(trainings):
            own = [r for r in got if r["t"] == t]
            pair, first = (np.concatenate([np.empty(0, np.int64)] + [np.frombuffer(r[k], "i8") for r in own]) for k in ("pairs", "firsts"))
            sums, first_sums = (np.concatenate([np.empty((0, c))] + [np.frombuffer(r[k], "f4").reshape(-1, c) for r in own]) for k in ("sums", "first_sums"))
            order = np.argsort(pair)
            out.append((pair[order], sums[order], first, first_sums))
        return out


def fitted(passes: Here | There, words: list[str], usable: np.ndarray, subjects: list[str]) -> list[Counts]:
    """Counts of every training by expectation-maximization; rows of ``usable`` tell its words."""
    p = passes.words(_begun, usable)
    for k in range(ROUNDS):
        p = (p + SMOOTH) * usable[:, :, None]
        p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
        p = passes.words(_round, usable, p, k == ROUNDS - 1)
    c, v = len(subjects) + 1, len(words)
    out = [Counts([words[i] for i in np.flatnonzero(own)], subjects, [x[own, :c], x[own, c:-1]], x[own, -1]) for own, x in zip(usable, p, strict=True)]
    p = np.zeros((len(usable), v, c))
    for t, counts in enumerate(out):
        p[t, usable[t]] = counts.p
    for counts, own, (pair, counted, first, mass) in zip(out, usable, passes.pairs(usable, p), strict=True):
        local = np.cumsum(own) - 1
        counts.pairs = local[pair // max(1, v)] * max(1, len(counts.words)) + local[pair % max(1, v)]
        counts.counted = counted
        counts.first_mass[local[first]] = mass
    return out


class Counts:
    """Expected counts of words and pairs in every source, the last source being the background."""

    def __init__(self, words: list[str], subjects: list[str], parts: list[np.ndarray], spread: np.ndarray) -> None:
        """``parts`` are the counts of either side, ``spread`` the number of documents of each word."""
        self.words, self.subjects = words, subjects
        n_s, v = len(subjects), len(words)
        forms: dict[str, int] = {}
        self.forms = forms
        self.form = np.array([forms.setdefault(skeleton(w), len(forms)) for w in self.words], np.int64)
        mass = parts[0] + parts[1]
        weights = [[_held_out(self._components(a)[:, :, c], b[:, c]) for a, b in (parts, parts[::-1])] for c in (slice(0, n_s), slice(n_s, n_s + 1))]
        lam = [np.mean(w, axis=0) for w in weights]
        parts_of = self._components(mass)
        p = np.concatenate([np.tensordot(lam[0], parts_of[:, :, :n_s], 1), np.tensordot(lam[1], parts_of[:, :, n_s:], 1)], axis=1)
        p /= np.maximum(p.sum(axis=0), 1e-300)
        self.whole = mass.sum(axis=1) / max(mass.sum(), 1e-300)
        own = ((1 - OVERALL) * spread / (spread + RARE))[:, None]
        self.p = own * p + (1 - own) * self.whole[:, None]
        by_form = np.zeros((len(forms), n_s + 1))
        np.add.at(by_form, self.form, mass)
        rate = by_form / np.maximum(mass.sum(axis=0), 1e-9)
        overall = (by_form.sum(axis=1) / max(mass.sum(), 1e-300))[:, None]
        floor = 0.7 / max(mass.sum(axis=0).mean(), 1e-9)
        self.skel = np.log((rate[:, :n_s] + OVERALL * overall + floor) / (rate[:, n_s:] + OVERALL * overall + floor)).astype(np.float32)
        self.pairs, self.counted, self.first_mass = np.empty(0, np.int64), np.empty((0, n_s + 1)), np.zeros((v, n_s + 1))

    def _components(self, mass: np.ndarray) -> np.ndarray:
        """Distributions of words in each source: as counted, by the skeleton, and uniform."""
        sums = np.maximum(mass.sum(axis=0), 1e-9)
        form = np.zeros((len(self.forms), mass.shape[1]))
        np.add.at(form, self.form, mass)
        within = mass.sum(axis=1) + 0.1
        within /= np.bincount(self.form, within, len(self.forms))[self.form]
        return np.stack([mass / sums, (form / sums)[self.form] * within[:, None], np.full_like(mass, 1 / max(1, len(mass)))])

    def model(self, shared: float) -> Model:
        """The models with a given part of the overall conditional."""
        n_s = len(self.subjects)
        first, second = np.divmod(self.pairs, max(1, len(self.words)))
        overall = (self.counted.sum(axis=1) / np.maximum(self.first_mass[first].sum(axis=1), 1e-9))[:, None]
        expected = self.p[second] * (overall / np.maximum(self.whole[second], 1e-300)[:, None])
        own = (self.counted + PRIOR * expected) / (self.first_mass[first] + PRIOR)
        p = CONDITIONAL * ((1 - shared) * own + shared * overall) + (1 - CONDITIONAL) * self.p[second]
        ratio = np.log(p[:, :n_s] / p[:, n_s:]) if len(p) else np.empty((0, n_s))
        uni = np.log(self.p[:, :n_s] / self.p[:, n_s:]).astype(np.float32)
        return Model(self.subjects, {w: i for i, w in enumerate(self.words)}, uni, self.forms, self.skel, self.pairs, ratio.astype(np.float32))


def _unique_pairs(pair: np.ndarray, doc: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Different (pair, document) and how often each occurs."""
    order = np.lexsort((doc, pair))
    pair, doc = pair[order], doc[order]
    new = np.ones(len(pair), bool)
    new[1:] = (np.diff(pair) != 0) | (np.diff(doc) != 0)
    at = np.flatnonzero(new)
    return (pair[at], doc[at]), np.diff(np.append(at, len(pair)))


def _held_out(parts: np.ndarray, counts: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Weights of component distributions of greatest likelihood for counts that they have not seen."""
    lam = np.full(len(parts), 1 / len(parts))
    for _ in range(rounds):
        p = parts * lam[:, None, None]
        p /= np.maximum(p.sum(axis=0), 1e-300)
        lam = np.array([(x * counts).sum() for x in p]) + 1e-3
        lam /= lam.sum()
    return lam


def _here(data: Corpus, labels: list[set[str]], subjects: list[str], asked: np.ndarray, trainings: int) -> list[Counts]:
    """The trainings of documents in memory, those asked being in either half in turn."""
    turn = np.cumsum(asked) - 1
    half, side = np.where(asked, turn % 2, 2), np.where(asked, turn // 2, np.arange(data.n)) % 2
    of = half[np.repeat(data.owner, data.sizes)]
    n = np.stack([np.bincount(data.ids[of == k], minlength=len(data.words)) for k in (0, 1, 2)])
    often = np.flatnonzero(n.sum(axis=0) >= 2)
    words = [data.words[i] for i in often]
    part = _part(data, {w: i for i, w in enumerate(words)}, labels, subjects, half, side, np.ones(data.n), trainings)
    return fitted(Here([part]), words, _usable(n[:, often], trainings), subjects)


def train(docs: list[list[list[str]]], labels: list[set[str]], subjects: list[str]) -> Model:
    """Models from tokenized documents and their label sets, not calibrated."""
    return _here(corpus(docs), labels, subjects, np.ones(len(docs), bool), 1)[0].model(SHARED[0])


#: Thresholds to choose from, nearest to a quarter first: another must be better by more than chance.
SHARES, LEAST = (0.24, 0.22, 0.26, 0.2, 0.28, 0.18, 0.3, 0.16), (3, 4, 2, 5, 6, 8, 10)


def tallied(models: list[Model], data: Corpus, labels: list[set[str]]) -> np.ndarray:
    """Subjects given, those of them that are labels, and all labels, by model and thresholds."""
    truth = np.array([[s in own for s in models[0].subjects] for own in labels], bool).reshape(len(labels), -1)
    out = np.zeros((3, len(models), len(SHARES), len(LEAST)), np.int64)
    out[2] = truth.sum()
    for m, model in enumerate(models):
        w = model.weights_in(data)
        order = np.argsort(-w, axis=1, kind="stable")[:, :MOST_SUBJECTS]
        top, right = np.take_along_axis(w, order, 1), np.take_along_axis(truth, order, 1)
        total = w.sum(axis=1, keepdims=True)
        for i, share in enumerate(SHARES):
            for j, least in enumerate(LEAST):
                got = (top >= least) & (top >= share * total)
                out[:2, m, i, j] = got.sum(), (got & right).sum()
    return out


def thresholds(tally: np.ndarray) -> tuple[float, float, float]:
    """Part of the overall conditional, share and least weight of the best F1 on held-out documents."""
    best, chosen = -1.0, (SHARED[0], 0.22, 3.0)
    for m, shared in enumerate(SHARED):
        for i, share in enumerate(SHARES):
            for j, least in enumerate(LEAST):
                given, right, true = tally[:, m, i, j]
                f1 = 2 * right / max(1, given + true)
                if f1 > best + 0.002:
                    best, chosen = f1, (shared, share, float(least))
    return chosen


def _chosen(counts: Counts, tally: np.ndarray) -> Model:
    """The model of all documents with the thresholds that the halves told."""
    shared, share, least = thresholds(tally)
    model = counts.model(shared)
    model.share, model.least = share, least
    return model


def _of_half(data: Corpus, labels: list[set[str]], which: np.ndarray) -> tuple[Corpus, list[set[str]]]:
    """The documents of a corpus that are chosen."""
    lines = which[data.owner]
    new = np.cumsum(which) - 1
    return Corpus(data.words, data.ids[np.repeat(lines, data.sizes)], data.sizes[lines], new[data.owner[lines]], int(which.sum())), [own for own, w in zip(labels, which, strict=True) if w]


def calibrated(data: Corpus, labels: list[set[str]], subjects: list[str], asked: np.ndarray | None = None) -> Model:
    """Trained on all documents, weights and thresholds of the best F1 on halves of the ``asked`` ones
    that the models rating them have not seen."""
    asked = np.ones(data.n, bool) if asked is None else asked
    if asked.sum() < LEAST_HALVED:
        return _here(data, labels, subjects, asked, 1)[0].model(SHARED[0])
    counts = _here(data, labels, subjects, asked, 3)
    half = np.where(asked, (np.cumsum(asked) - 1) % 2, 2)
    tally = sum(tallied([counts[2 - k].model(x) for x in SHARED], *_of_half(data, labels, half == k)) for k in (0, 1))
    return _chosen(counts[0], tally)


def labelled(documents: DataFrame, labels: DataFrame, subjects: list[str], items: DataFrame | None = None) -> DataFrame:
    """Tokenized texts to learn from: ``own array<string>, half int, side int, lines string``. All labelled
    documents, in half 0 or 1 by a hash of their id, different texts of one id each; and all items, in half 2.

    Labels count in lower case and once; ``none`` and unknown ones give an empty set.
    """
    known = F.lower(F.trim("subject"))
    own = labels.where("doc_id IS NOT NULL AND subject IS NOT NULL").groupBy("doc_id").agg(F.collect_set(F.when(known.isin(subjects), known)).alias("own"))
    hashed = F.xxhash64("doc_id")
    rows = documents.select("doc_id", "text").where("text IS NOT NULL").join(small_side(cut(own)), "doc_id").dropDuplicates(["doc_id", "text"])
    rows = rows.select("own", hashed.bitwiseAND(1).cast("int").alias("half"), F.shiftright(hashed, 1).bitwiseAND(1).cast("int").alias("side"), "text")
    if items is not None:
        texts = items.select("text").where(F.length("text") > 0).distinct()
        rows = rows.unionByName(texts.select(F.array().cast("array<string>").alias("own"), F.lit(2).alias("half"), F.xxhash64("text").bitwiseAND(1).cast("int").alias("side"), "text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = ["\n".join(" ".join(line) for line in tokenized(t)) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lines, pa.string())], ["own", "half", "side", "lines"])

    return kept(spread(rows).mapInArrow(split, "own array<string>, half int, side int, lines string"))


def _words_of(lines: str) -> list[list[str]]:
    return [line.split(" ") for line in lines.split("\n")] if lines else []


def vocabulary(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Words that occur twice in the texts of :func:`labelled`, and their counts in half 0, 1 and 2."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [Counter(), Counter(), Counter()]

        def handed() -> pa.RecordBatch:
            words = list(n[0].keys() | n[1].keys() | n[2].keys())
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in n)], ["word", "a", "b", "c"])
            for c in n:
                c.clear()
            return out

        for batch in batches:
            for half, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[half].update(lines.split())
                if sum(map(len, n)) > FLUSH:
                    yield handed()
        yield handed()

    counted = rows.select("half", "lines").mapInArrow(count, "word string, a long, b long, c long").groupBy("word").agg(*(F.sum(x).alias(x) for x in "abc"))
    got = counted.where("a + b + c >= 2").orderBy("word").toArrow()
    return got.column(0).to_pylist(), np.stack([got.column(k).to_numpy() for k in (1, 2, 3)])


def learnt(rows: DataFrame, subjects: list[str]) -> Model | None:
    """The calibrated model of all texts of :func:`labelled`, nothing without a label; passes over the
    texts run on the executors."""
    spark = rows.sparkSession
    n_items, n, n_known = rows.select(*(F.coalesce(F.sum(x.cast("long")), F.lit(0)) for x in (F.col("half") == 2, F.col("half") < 2, F.size("own") > 0))).first()
    if not n_known:
        return None
    words, n_of = vocabulary(rows)
    trainings = 3 if n >= LEAST_HALVED else 1
    item = min(1.0, max(1, n // PER_ITEM) / max(1, n_items))
    shared = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, size = [], 0

        def handed() -> pa.RecordBatch:
            data = corpus([_words_of(d["lines"]) for d in docs])
            half, side = (np.array([d[k] for d in docs], np.int8) for k in ("half", "side"))
            part = _part(data, shared.value, [set(d["own"]) for d in docs], subjects, half, side, np.where(half == 2, item, 1.0), trainings)
            return pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([pickle.dumps(part, 5)], pa.binary())], ["block", "part"])

        for batch in batches:
            for d in batch.to_pylist():
                docs.append(d)
                size += d["lines"].count(" ") + d["lines"].count("\n") + 1
                if size >= PART:
                    yield handed()
                    docs, size = [], 0
        if docs:
            yield handed()

    tokens = int(n_of.sum())
    tasks = max(1, min(spark.sparkContext.defaultParallelism, tokens // LEAST_TASK), tokens // MOST_TASK)
    passes = There(kept(rows.repartition(tasks).mapInArrow(encode, "block int, part binary")))
    shared.destroy()
    counts = fitted(passes, words, _usable(n_of, trainings), subjects)
    if trainings == 1:
        return counts[0].model(SHARED[0])
    others = spark.sparkContext.broadcast(counts[1:])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [[c.model(x) for x in SHARED] for c in others.value[::-1]]
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, len(whole), 500)):
            docs = batch.to_pylist()
            for k in (0, 1):
                own = [d for d in docs if d["half"] == k]
                if own:
                    out = tallied(models[k], corpus([_words_of(d["lines"]) for d in own]), [set(d["own"]) for d in own])
                    yield pa.RecordBatch.from_arrays([pa.array(range(out.size), pa.int32()), pa.array(out.ravel(), pa.int64())], ["at", "n"])

    got = rows.where("half < 2").repartition(tasks).mapInArrow(tally, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    others.destroy()
    out = np.zeros((3, len(SHARED), len(SHARES), len(LEAST)), np.int64)
    for r in got:
        out.flat[r["at"]] = r["n"]
    return _chosen(counts[0], out)


def subject_areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Subjects of every document: ``doc_id, subject string, share double``; none, no row.

    ``subjects`` is the table of codes, of which more than ``MOST_CODES`` raise; ``items`` are evaluation
    items, whose words are learnt as background. NULL and empty texts, and texts of other content, have
    no subject; NULL ids pass through; repeated documents are rated as often as they stand there; with
    empty ``labels`` or ``subjects`` no subject is known and the result is empty; other columns, whatever
    their names, are ignored.
    """
    known = subjects.select(F.lower(F.trim("subject")).alias("subject")).where("subject NOT IN ('none', '')").distinct()
    if known.count() > MOST_CODES:
        raise ValueError(f"a table of more than {MOST_CODES} subjects")
    codes = sorted(r[0] for r in known.collect())
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, subject string, share double"
    spark, model = documents.sparkSession, None
    if codes:
        rows = labelled(documents, labels, codes, items)
        model = learnt(rows, codes)
        forget(rows)
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            at, subject, share = [], [], []
            for row, w in enumerate(model.weights_of([tokenized(t) for t in batch.column(1).to_pylist()])):
                for s in model.accept(w):
                    at.append(row)
                    subject.append(s)
                    share.append(float(w[model.subjects.index(s)] / w.sum()))
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(subject), pa.array(share)], ["doc_id", "subject", "share"])

    return spread(documents.select("doc_id", "text").where(F.length("text") > 0)).mapInArrow(rate, schema)
