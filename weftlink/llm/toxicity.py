"""Toxicity scores from a learned lexicon, met by Levenshtein automata and weighed by context."""

from __future__ import annotations

import bisect
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import takewhile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.llm.common import slices, texts_of, unused_name
from weftlink.session import cut_lineage

#: Labelled texts that the logistic weights of the features are fitted on, at most: those with the smallest hash of their
#: text. Terms are counted in all labelled texts.
SAMPLE = 12_000
#: Terms are beginnings of words of this many letters, or whole shorter words.
SHORTEST, LONGEST = 4, 12
#: A term is in at least so many times as large a share of toxic texts, and so far from chance (a log-likelihood ratio).
#: It also has that evidence if toxic texts with the same words around it count once: a passage they share is no term.
RATIO, EVIDENCE = 3.0, 15.0
#: Toxic texts that a term is in, at least: fewer have no evidence.
FEWEST = 4
#: A term is kept if this many toxic texts have none of the terms with more evidence.
NEW_TEXTS = 2
#: Share of toxic texts from which on a term is common.
COMMON_SHARE = 0.1
#: Share of a term's texts that hold the term as a word from which on it counts as a word and not as a stem.
WHOLE = 0.8
#: Words around a hit that decide whether it is quoted, and what a quoted hit counts.
WINDOW, QUOTED = 8, 0.35
#: Words that a worker remembers; above it the memory starts anew. It changes no result.
MEMO = 500_000
#: Counts that a task holds before it passes them on.
HELD_TERMS = 400_000
#: Labels, a key and a number each, that are sent to every task at most.
SENT_LABELS = 500_000
#: Bits of the table that tells which terms toxic texts have often enough.
FILTER_BITS = 1 << 24
SLICE_BYTES = 2 << 20
#: Characters of texts whose words are looked up together.
LOOKED_UP = 1 << 20
THRESHOLD = 0.7
#: The most that a text without a hit scores.
UNKNOWN = 0.4

# fixed values: look-alikes, quotation marks, words that report and words that address someone
LOOK_ALIKES = str.maketrans("013457@$!", "oieastasi")
OPENING, CLOSING = "\"“„«‹‘'>", "\"”“»›’'"
REPORTING = set("said says say wrote writes quote quoted quotes called calls word words term insult insults phrase".split())
ADDRESSING = set("you your yours you're youre u ur yourself du dich dein ihr tu te ton vous tú usted tus".split())

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INSIDE = re.compile(r"[\W_]+")


def plain(token: str) -> str:
    """A lower-case token without the marks around and inside it, look-alikes of letters replaced."""
    if token.isalpha():
        return token
    return _INSIDE.sub("", _EDGE.sub("", token).translate(LOOK_ALIKES))


def distance_allowed(term: str) -> int:
    """Edits that still count as a misspelling of a term."""
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


class Lexicon:
    """Terms in a trie. ``terms`` maps a term to its weight and whether it is a whole word or a stem."""

    def __init__(self, terms: dict[str, tuple[float, bool]]):
        self.terms = terms
        self.tries: dict[int, dict] = {}  # by the edits allowed
        self.pieces: dict[str, int] = {}  # a bit for each place where a piece may stand
        for term in terms:
            edits = distance_allowed(term)
            node = self.tries.setdefault(edits, {})
            for letter in term:
                node = node.setdefault(letter, {})
            node[""] = term
            # so many edits leave one of edits + 1 pieces whole, and move it by as many places at most
            cuts = [len(term) * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                for place in range(max(0, a - edits), a + edits + 1):
                    self.pieces[term[a:b]] = self.pieces.get(term[a:b], 0) | 1 << place
        # neighbours swapped, for terms that two edits would be too many for; of two terms the heavier
        self.swapped: dict[str, str] = {}
        for term in sorted(terms, key=lambda t: (terms[t][0], t)):
            if distance_allowed(term) == 1:
                for i in range(len(term) - 1):
                    self.swapped[term[:i] + term[i + 1] + term[i] + term[i + 2 :]] = term
        self.swap_sizes = sorted({len(t) for t in self.swapped})
        self.looks = sorted({(p, p + len(s)) for s, at in self.pieces.items() for p in range(at.bit_length()) if at >> p & 1})

        # by place, the terms of each piece: letters to look at, lengths of words, different letters, edits
        self.places: dict[tuple[int, int], dict[str, list[tuple]]] = {look: {} for look in self.looks}
        for term, (_, whole) in terms.items():
            edits, n = distance_allowed(term), len(term)
            told = (n + edits, n - edits, n + edits if whole else 1 << 30, frozenset(term), edits)
            cuts = [n * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                for place in range(max(0, a - edits), a + edits + 1):
                    self.places[place, place + b - a].setdefault(term[a:b], []).append(told)
        self.wanted: dict[tuple[int, int], np.ndarray] = {}
        for a, b in self.looks:
            here = sorted({s for s, at in self.pieces.items() if len(s) == b - a and at >> a & 1})
            self.wanted[a, b] = self._codes(np.array([list(map(ord, s)) for s in here], dtype=np.uint64))
        self.swap_heads = {t[:SHORTEST] for t in self.swapped}

    @staticmethod
    def _codes(letters: np.ndarray) -> np.ndarray:
        """A number for each row of letters; equal rows have equal numbers."""
        code = np.zeros(len(letters), dtype=np.uint64)
        for column in letters.T:
            code = code * np.uint64(0x9E3779B97F4A7C15) + column
        return code

    def hopeful(self, words: list[str]) -> list[str]:
        """The words that hold a piece of a term near its place, or begin as a term with swapped letters does."""
        reach = max((b for _, b in self.looks), default=0)
        if not words or not reach:
            return []
        letters = np.array(words, dtype=f"<U{reach}").view(np.uint32).reshape(len(words), reach).astype(np.uint64)
        found = np.zeros(len(words), dtype=bool)
        for (a, b), codes in self.wanted.items():
            found |= np.isin(self._codes(letters[:, a:b]), codes)
        heads = self.swap_heads
        return [w for w, f in zip(words, found.tolist(), strict=True) if f or w[:SHORTEST] in heads]

    def _candidate(self, word: str) -> bool:
        """Whether a term has a piece in the word near its place, and lacks no more of its letters there than edits can change."""
        for (a, b), terms in self.places.items():
            for reach, least, most, letters, edits in terms.get(word[a:b], ()):
                if least <= len(word) <= most and len(letters.difference(word[:reach])) <= edits:
                    return True
        return False

    def match(self, word: str) -> tuple[str, int] | None:
        """The term that the word is or begins with, or misspells; and by how many edits. Fewest edits, then weight.

        The automaton of the word has a bit for each prefix of it and a row for each number of edits. Walking down
        the trie feeds it the letters of the terms; branches that leave no bit are not entered.
        """
        if not word or not self._candidate(word):
            return None
        n = len(word)
        masks: dict[str, int] = {}
        for i, letter in enumerate(word):
            masks[letter] = masks.get(letter, 0) | (1 << i)
        full = (1 << (n + 1)) - 1
        best: tuple | None = None
        stack = [(root, [(1 << (e + 1)) - 1 & full for e in range(k + 1)]) for k, root in self.tries.items()]
        while stack:
            node, rows = stack.pop()
            for letter, child in node.items():
                if letter == "":
                    weight, whole = self.terms[child]
                    for e, row in enumerate(rows):
                        if (row >> n & 1) if whole else row:
                            best = min(best, (e, -weight, child)) if best else (e, -weight, child)
                            break
                    continue
                hit, fed = masks.get(letter, 0), []
                for e, row in enumerate(rows):
                    new = (row & hit) << 1
                    if e:  # a letter of the term too many, another letter, a letter of the word too many
                        new |= rows[e - 1] | rows[e - 1] << 1 | fed[-1] << 1
                    fed.append(new & full)
                if fed[-1]:
                    stack.append((child, fed))
        return (best[2], best[0]) if best else None


    def match_swapped(self, word: str) -> tuple[str, int] | None:
        """As ``match``; what it does not find may still be a term with two neighbouring letters swapped, one edit."""
        found = self.match(word)
        if found is None:
            for size in self.swap_sizes:
                term = self.swapped.get(word[:size])
                if term and (size == len(word) or not self.terms[term][1] and size < len(word)):
                    return term, 1
        return found


def quoted(words: list[str], at: int) -> bool:
    """Whether the word at a place is reported speech: in quotation marks, or near a word that reports and none that
    addresses someone."""
    low, high = max(0, at - WINDOW), min(len(words), at + WINDOW + 1)
    before, after = words[low : at + 1], words[at:high]
    opened = max((i for i, w in enumerate(before) if w[0] in OPENING), default=-1)
    closed = max((i for i, w in enumerate(before[:-1]) if w.rstrip(".,;:!?")[-1:] in CLOSING), default=-1)
    ends = any(w.rstrip(".,;:!?")[-1:] in CLOSING for w in after)
    if opened >= 0 and opened > closed and ends:
        return True
    near = {w.strip(".,;:!?\"'") for w in words[low:high]}
    return bool(near & REPORTING) and not near & ADDRESSING


@dataclass
class ToxicityModel:
    """Lexicon, words of clean texts that only look like misspellings, and the logistic weights of the features."""

    terms: dict[str, tuple[float, bool]]
    innocent: frozenset[str] = frozenset()
    weights: np.ndarray | None = None
    known: dict[str, tuple[str, int]] = field(default_factory=dict)
    clear: set[str] = field(default_factory=set)

    def __getstate__(self):
        return {"terms": self.terms, "innocent": self.innocent, "weights": self.weights, "known": {}, "clear": set()}

    def hits(self, words: list[str]) -> list[tuple[int, str, int]]:
        """Place, term and edits of each word that meets the lexicon."""
        self.ready([words])
        return self.met_in(words)

    def met_in(self, words: list[str]) -> list[tuple[int, str, int]]:
        """The same for words that have been looked up."""
        if not self.met.intersection(words):
            return []
        known = self.known
        return [(i, *known[w]) for i, w in enumerate(words) if w in known]

    def learn(self, words: set[str]) -> None:
        """Look up words that are not known yet, all at once."""
        if not hasattr(self, "lexicon"):
            self.lexicon = Lexicon(self.terms)
        bare = {w: plain(w) for w in words}
        met = set(self.lexicon.hopeful(list(bare.values())))
        for word, b in bare.items():
            found = self.lexicon.match_swapped(b) if b in met else None
            if found and not (found[1] and b in self.innocent):
                self.known[word] = found
            else:
                self.clear.add(word)

    def ready(self, texts: list[list[str]]) -> None:
        """Look up the words of some texts together; the memory starts anew when it is full."""
        words = set().union(*texts)
        if len(self.known) + len(self.clear) + len(words) > MEMO:
            self.known.clear()
            self.clear.clear()
        words = words.difference(self.clear).difference(self.known)
        if words:
            self.learn(words)
        self.met = set(self.known)  # few of all words

    def features(self, words: list[str] | str) -> list[float]:
        """The words of a text, or the text itself, as numbers: exact and misspelled hits by weight, the heaviest, their share of the words, its length.

        Each weight counts in full in abuse and little in quotation.
        """
        if isinstance(words, str):
            return self.all_features([words])[0]
        exact = near = top = 0.0
        n = 0
        for at, term, edits in self.met_in(words):
            worth = self.terms[term][0] * (QUOTED if quoted(words, at) else 1.0)
            exact, near = (exact + worth, near) if not edits else (exact, near + worth)
            top, n = max(top, worth / (1 + edits)), n + 1
        size = len(words)
        return [math.log1p(exact), math.log1p(near), top, math.sqrt((exact + near) / (size + 10)), math.log1p(n), math.log1p(size)]

    def all_features(self, texts: list[str]) -> list[list[float]]:
        words = [t.lower().split() for t in texts]
        self.ready(words)
        return [self.features(w) for w in words]

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([f for some in together(texts) for f in self.all_features(some)], dtype=float).reshape(len(texts), -1)
        if self.weights is None or not len(x):
            return np.full(len(texts), 0.0)
        score = 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ self.weights, -30, 30)))
        return np.where(x[:, 4] > 0, score, np.minimum(score, UNKNOWN))


def together(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about ``LOOKED_UP`` characters, one text at least."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= LOOKED_UP:
            yield some
            some, size = [], 0
    if some:
        yield some


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of the columns and a constant, by Newton's method with a small ridge on standardised columns."""
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / std, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / std, w[-1] - (w[:-1] * mean / std).sum())


def beginnings(word: str) -> list[str]:
    """What of a word may be a term: its beginnings, or a shorter word as it is."""
    if len(word) < SHORTEST:
        return [word] if word else []
    return [word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1)]


def _counted(texts: DataFrame, often: bytes | None = None) -> DataFrame:
    """``half, term, whole, n``: texts that hold each beginning of a word, and each word; all texts at ''.

    With a table of bits only terms whose bit is set are counted. A beginning is in at least the texts that longer ones are
    in, so the first beginning of a word that fails ends its list.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], Counter] = defaultdict(Counter)
        bare: dict[str, str] = {}
        starts: dict[str, list[str]] = {}

        def passes(term: str) -> int:
            bit = zlib.crc32(term.encode("utf-8", "replace")) % FILTER_BITS
            return often[bit >> 3] >> (bit & 7) & 1

        def found() -> Iterator[pa.RecordBatch]:
            for (half, whole), terms in held.items():
                arrays = [pa.array([half] * len(terms), pa.int32()), pa.array(list(terms), pa.string())]
                arrays += [pa.array([whole] * len(terms), pa.bool_()), pa.array(list(terms.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["half", "term", "whole", "n"])
            held.clear()

        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                for half, text in zip(rows.column("half").to_pylist(), texts_of(rows, "text"), strict=True):
                    tokens = set(text.lower().split())
                    for token in tokens.difference(bare):
                        word = plain(token)
                        begun = beginnings(word)
                        if often is not None:
                            begun = list(takewhile(passes, begun))
                            word = word if word and passes(word) else ""
                        bare[token], starts[token] = word, begun
                    words = set(map(bare.__getitem__, tokens))
                    words.discard("")
                    held[half, True].update(words)
                    held[half, False].update(set().union(*map(starts.__getitem__, tokens)))
                    held[half, False][""] += 1
                if len(bare) > MEMO:
                    bare.clear()
                    starts.clear()
                if sum(map(len, held.values())) > HELD_TERMS:
                    yield from found()
        yield from found()

    parts = texts.select("half", "text").mapInArrow(count, "half int, term string, whole boolean, n long")
    return parts.groupBy("half", "term", "whole").agg(F.sum("n").alias("n"))


def _term_counts(train: DataFrame) -> DataFrame:
    """``half, term, whole, toxic, clean`` of the terms that toxic texts hold, and of all texts at ''.

    A term needs ``FEWEST`` toxic texts of both halves together. So toxic texts are counted first, and of the clean ones only
    what may be such a term, by a table of bits of a fixed size; what passes by chance is counted and never chosen.
    """
    toxic = cut_lineage(_counted(train.filter("toxic = 1")))
    enough = toxic.groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= FEWEST)
    bit = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(FILTER_BITS))
    lanes = enough.select(F.shiftright(bit, 3).alias("at"), (bit % 8).cast("int").alias("b"))
    lanes = lanes.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1, b)")).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    bits[lanes["at"].to_numpy()] = lanes["bits"].to_numpy().astype(np.uint8)
    clean = _counted(train.filter("toxic = 0"), bits.tobytes()).withColumnRenamed("n", "clean")
    both = toxic.withColumnRenamed("n", "toxic").join(clean, ["half", "term", "whole"], "left")
    return both.select("half", "term", "whole", "toxic", F.coalesce("clean", F.lit(0)).alias("clean"))


def evidence(toxic: float, clean: float, all_toxic: float, all_clean: float) -> float:
    """Log-likelihood ratio of the shares of toxic and clean texts that hold a term against equal shares."""
    rate = min(max((toxic + clean) / (all_toxic + all_clean), 1e-12), 1 - 1e-12)
    g = 0.0
    for held, n in ((toxic, all_toxic), (clean, all_clean)):
        g += held * math.log(held / (n * rate)) if held > 0 else 0.0
        g += (n - held) * math.log((n - held) / (n * (1 - rate))) if held < n else 0.0
    return 2 * g


def _evidence_of(all_toxic: int, all_clean: int) -> Column:
    """``evidence`` as an expression of the columns ``toxic`` and ``clean``, a little too large rather than too small."""
    rate = (F.col("toxic") + F.col("clean")) / F.lit(float(all_toxic + all_clean))
    g = F.lit(1e-6)
    for held, n in (("toxic", float(all_toxic)), ("clean", float(all_clean))):
        h = F.col(held)
        g += F.when(h > 0, h * F.ln(h / (n * rate))).otherwise(0.0)
        g += F.when(h < n, (n - h) * F.ln((n - h) / (n * (1 - rate)))).otherwise(0.0)
    return 2 * g


def _different_contexts(train: DataFrame, terms: frozenset[str]) -> dict[str, int]:
    """For each term the different pairs of words before it in toxic texts, or after it if those are fewer.

    Copies of a passage count once, and so do its first and last word.
    """

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun: dict[str, list[str]] = {}
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                seen = set()
                for text in texts_of(rows, "text"):
                    words = list(map(plain, text.lower().split()))
                    for w in set(words).difference(begun):
                        begun[w] = [start for start in beginnings(w) if start in terms]
                    for i, w in enumerate(words):
                        for start in begun[w]:
                            seen.add((start, False, " ".join(words[max(0, i - 2) : i])))
                            seen.add((start, True, " ".join(words[i + 1 : i + 3])))
                    if len(begun) > MEMO:
                        begun.clear()
                names = ["term", "after", "words"]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in seen], t) for k, t in enumerate((pa.string(), pa.bool_(), pa.string()))], names=names)

    sides = train.filter("toxic = 1").select("text").mapInArrow(contexts, "term string, after boolean, words string")
    sides = sides.distinct().groupBy("term", "after").count()
    return {r["term"]: r["n"] for r in sides.groupBy("term").agg(F.min("count").alias("n")).collect()}


def choose_terms(counts: dict[str, tuple[int, int]], words: dict[str, int], all_toxic: int, all_clean: int) -> dict[str, tuple[float, bool]]:
    """Terms by evidence. What a chosen term explains is taken from its beginnings, about; longer ones are dropped."""
    left, ordered = dict(counts), sorted(counts)
    worth = {t: evidence(*c, all_toxic, all_clean) for t, c in left.items()}
    heap = [(-v, -len(t), t) for t, v in worth.items() if v >= EVIDENCE]
    heapq.heapify(heap)
    terms: dict[str, tuple[float, bool]] = {}
    while heap:
        value, _, term = heapq.heappop(heap)
        if term not in left or -value != worth[term]:
            continue  # dropped, or in the heap again with what is left of it
        toxic, clean = left[term]
        ratio = (toxic + 0.1) / (clean + 0.5) * all_clean / all_toxic
        if ratio >= RATIO:
            terms[term] = math.log(ratio), words.get(term, 0) >= WHOLE * toxic
        if len(term) < SHORTEST:
            continue  # a word of its own, no beginning of others
        for k in range(SHORTEST, len(term)):
            if (short := term[:k]) in left:
                left[short] = max(0, left[short][0] - toxic), max(0, left[short][1] - clean)
                worth[short] = evidence(*left[short], all_toxic, all_clean)
                if worth[short] >= EVIDENCE:
                    heapq.heappush(heap, (-worth[short], -k, short))
        for longer in ordered[bisect.bisect_left(ordered, term) : bisect.bisect_right(ordered, term + "\U0010ffff")]:
            left.pop(longer, None)
    return terms


def needed_terms(terms: dict[str, tuple[float, bool]], found: list[set[str]], times: list[int] | None = None) -> dict[str, tuple[float, bool]]:
    """Terms, in order of evidence, that toxic texts need: what only goes along with other terms is left out.

    ``found`` has the terms in each toxic text, or each set of terms that ``times`` texts have. A common term also stays
    without new texts of its own, if no kept term is in much the same texts.
    """
    times = [1] * len(found) if times is None else times
    places: dict[str, set[int]] = {}
    for i, f in enumerate(found):
        for term in f:
            places.setdefault(term, set()).add(i)
    kept: dict[str, set[int]] = {}
    covered: set[int] = set()
    common: dict[str, set[int]] = {}
    total, weigh = sum(times), lambda places: sum(times[i] for i in places)
    for term in terms:
        texts = places.get(term, set())
        often = weigh(texts) >= COMMON_SHARE * total > 0
        # a term in much the same texts as a common one is at least half as common
        alike = lambda other: 2 * weigh(texts & other) >= weigh(texts | other)
        if weigh(texts - covered) >= NEW_TEXTS or (often and not any(map(alike, common.values()))):
            kept[term] = texts
            if 2 * weigh(texts) >= COMMON_SHARE * total:
                common[term] = texts
            covered |= texts
    return {term: terms[term] for term in kept}


def learn_lexicon(train: DataFrame, counts: DataFrame) -> ToxicityModel:
    """The terms of some labelled texts, and the words of their clean ones that only look like terms."""
    total = counts.filter("term = '' and not whole").first()
    if not total or not total["toxic"] or not total["clean"]:
        return ToxicityModel({})
    all_toxic, all_clean = total["toxic"], total["clean"]
    # only what has the evidence is collected; what has less never becomes a term
    often = (F.col("toxic") >= FEWEST) & (F.col("term") != "") & (F.col("toxic") * all_clean >= 2 * F.col("clean") * all_toxic)
    rows = [r for r in counts.filter(often & (_evidence_of(all_toxic, all_clean) >= EVIDENCE)).collect()]
    starts = {r["term"]: (r["toxic"], r["clean"]) for r in rows if not r["whole"]}
    once = _different_contexts(train, frozenset(starts))

    def holds(term: str, toxic: int, clean: int) -> bool:
        """Whether there is evidence if copies of a passage count once; the clean texts are taken down as much."""
        n = min(toxic, once.get(term, 0))
        return n >= FEWEST and evidence(n, clean * n / toxic, all_toxic, all_clean) >= EVIDENCE

    starts = {t: c for t, c in starts.items() if holds(t, *c)}
    terms = choose_terms(starts, {r["term"]: r["toxic"] for r in rows if r["whole"]}, all_toxic, all_clean)
    known: dict[str, str | None] = {}

    def exact(word: str) -> str | None:
        """The heaviest term that the word is or begins with."""
        if word not in known:
            if len(known) > MEMO:
                known.clear()
            bare = plain(word)
            held = [bare[:k] for k in range(1, min(len(bare), LONGEST) + 1) if bare[:k] in terms]
            known[word] = min((t for t in held if t == bare or not terms[t][1]), key=lambda t: (-terms[t][0], t), default=None)
        return known[word]

    def terms_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [sorted({t for t in map(exact, set(v.lower().split())) if t}) for v in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string()))], names=["terms"])

    # one row for each set of terms that occurs
    found = train.filter("toxic = 1").select("text").mapInArrow(terms_in, "terms array<string>").groupBy("terms").count().collect()
    model = ToxicityModel(needed_terms(terms, [set(r["terms"]) for r in found], [r["count"] for r in found]))

    def lookalikes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words of clean texts that the lexicon takes for misspellings."""
        for batch in batches:
            seen: set[str] = set()
            for rows in slices(batch, "text", SLICE_BYTES):
                values = texts_of(rows, "text")
                texts = [v.lower().split() for v in values]
                model.ready(texts)
                for words in texts:
                    seen.update(plain(words[i]) for i, _, edits in model.met_in(words) if edits)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], names=["word"])

    clean_texts = train.filter("toxic = 0").select("text")
    innocent = frozenset(r["word"] for r in clean_texts.mapInArrow(lookalikes, "word string").distinct().collect())
    return ToxicityModel(model.terms, innocent)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> ToxicityModel:
    """Learn from labelled rows where ``learn`` (on the key) holds; labels with a null key or value say nothing.

    All of them are used, copies of a text once. The logistic weights come from features of each half of
    the texts, ``sample`` of both at most, by the lexicon of the other half, so they know how often an unknown word
    deceives; the lexicon itself is that of both. Without both classes no text scores above 0.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col("toxic").isNotNull() & learn)
    known = cut_lineage(known.groupBy(key).agg(F.max("toxic").cast("int").alias("toxic")))
    # labels of a bounded number go to the texts; more than that, and the texts are shuffled to meet them
    if known.count() <= SENT_LABELS:
        known = F.broadcast(known)
    train = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")).join(known, key)
    train = train.groupBy("text").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    train = cut_lineage(train.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")))
    counts = cut_lineage(_term_counts(train))
    n = train.count()
    # a bound on a spread hash of the text, which leaves about the sample of both halves
    near = F.lit(True) if n <= sample else F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * sample / n)
    made = []
    for half in (0, 1):
        other = learn_lexicon(train.filter(F.col("half") != half), counts.filter(F.col("half") != half))
        rows = train.filter((F.col("half") == half) & near)
        made.append(rows.select("toxic", "text").mapInArrow(_feature_rows(other), "toxic int, x array<double>").toPandas())
    rows = pd.concat(made)
    both = counts.groupBy("term", "whole").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    model = learn_lexicon(train, both)
    if rows["toxic"].nunique() == 2:
        x, y = np.array(rows["x"].tolist()), rows["toxic"].to_numpy(dtype=float)
        model.weights = fit_logistic(x, y)
        if (model.weights[:3] < 0).any():  # hits never speak for a text
            x[:, :3][:, model.weights[:3] < 0] = 0
            model.weights = fit_logistic(x, y)
    return model


def _feature_rows(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([f for some in together(texts_of(batch, "text")) for f in model.all_features(some)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), x], names=["toxic", "x"])

    return run


def toxicity_of(text: Column | str, model: ToxicityModel) -> Column:
    """The score of a text column, 0 to 1; null texts score as empty ones."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score([t if isinstance(t, str) else "" for t in texts]))

    return score(text)


def score_toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score, predicted``: a row for each row; other columns are not read."""
    scored = docs.select(key, toxicity_of(F.col(text), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The rows whose text scores under the threshold, with all their columns."""
    name = unused_name(docs, "score")
    return docs.withColumn(name, toxicity_of(F.col(text), model)).filter(F.col(name) < THRESHOLD).drop(name)
