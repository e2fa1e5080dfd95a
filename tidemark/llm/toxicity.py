"""Toxicity: a lexicon trie, Levenshtein automata for misspellings, and context that tells abuse from quotation.

A model is fitted on at most `sample` labelled rows (those whose ids have the least hashes; about 3 kB each on the driver):

* The lexicon: words, and stems (first letters that several words share), that occur in toxic texts and hardly in clean ones.
* Which entries may be matched with one error: those for which that brings no clean texts in.
* A logistic function of the evidence in a text.

A text's words are looked up in a trie of the lexicon by running the word's Levenshtein automaton over it. Few words get that
far: one within one error of an entry has the entry's first two letters or its last two. Each hit counts
by its context, a window of words around it: less inside quotation marks or beside words of reporting ("said", "the word"),
more beside a second person.

Every text is scored whole, alone and without a shuffle. Defined cases: null, empty and wordless texts get the score of no
evidence; rows that share a doc_id are scored each by its own text, and the least text is learned from; a null doc_id is not held out; without labelled
rows of both classes the lexicon is empty and all get the same score; other columns pass through.
"""

from __future__ import annotations

import os
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import private_name, table
from tidemark.llm.dealing import release
from tidemark.llm.textarrays import LOWER, blocks

SAMPLE, WINDOW = 4_000, 6
WORD = re.compile(r"[^\W_]+")
RUNS = re.compile(r"(.)\1{2,}")
#: Signs written for letters; marks of quotation; words of reporting and of address, in the tables' languages.
SIGNS = str.maketrans("013457", "oieast")
QUOTES = "\"'«»“”„‘’`"
REPORTING = frozenset("said says wrote writes called calls quote quoted term word words slur insult insulted phrase reported sagte schrieb wort genannt zitat dit écrit mot traité citation dijo escribió palabra llamó cita".split())
ADDRESS = frozenset("you your yours youre du dich dir dein deine ihr euch tu te toi ton vous votre usted tú tus vosotros".split())


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def plain(word: str) -> str:
    """word without signs for letters and with longer runs of a letter as one."""
    if not word.isalpha():
        word = word.translate(SIGNS)
    return RUNS.sub(r"\1", word)


class Trie:
    """Entries of a lexicon, each a whole word or the first letters of words; fuzzy ones may have one error."""

    def __init__(self, entries: Iterable[tuple[str, bool, bool]]):
        self.root: dict = {}
        for text, stem, fuzzy in entries:
            node = self.root
            for c in text:
                node = node.setdefault(c, {})
            node[""] = (text, stem, fuzzy)

    def find(self, word: str) -> tuple[str, int] | None:
        """(entry, errors) of the entry with the fewest errors.

        States of the automaton are (letters of word read, errors); it runs along the trie's branches as long as any state is
        left. A whole entry accepts in states that can drop the rest of word, a stem in any state.
        """
        n, best = len(word), None
        stack = [(self.root, {(0, 0), (1, 1)} if n else {(0, 0)})]
        while stack:
            node, states = stack.pop()
            if "" in node:
                text, stem, fuzzy = node[""]
                errors = min((e + (0 if stem else n - i) for i, e in states if stem or e + n - i <= 1), default=2)
                if errors == 0 or errors == 1 and fuzzy:
                    best = min(best or (text, 2), (text, errors), key=lambda x: (x[1], x[0]))
            for c, child in node.items():
                if not c:
                    continue
                after = set()
                for i, e in states:
                    if i < n and word[i] == c:
                        after.add((i + 1, e))
                    if e == 0:
                        after.add((i, 1))  # c is missing from word
                        if i < n:
                            after.add((i + 1, 1))  # another letter stands for c
                        if i + 1 < n and word[i + 1] == c:
                            after.add((i + 2, 1))  # word has a letter more
                if after:
                    stack.append((child, after))
        return best


class Lexicon:
    """Entries with quick tests that only words near one of them pass.

    One error leaves a word's first two letters or its last two as they are, and its length within one.
    """

    def __init__(self, entries: list[tuple[str, bool, bool]]):
        self.entries, self.trie = entries, Trie(entries)
        self.heads = {e[:2] for e, _, _ in entries}
        self.tails = {e[-2:] for e, stem, _ in entries if not stem}
        self.known: dict[str, tuple[str, int] | None] = {}
        # The same for whole blocks of bytes, where a word is of ASCII: two letters at either end by length (the last counts for all above).
        self.head, self.tail = (np.zeros((65536, LONGEST), bool) for _ in range(2))
        for e, stem, _ in entries:
            lo, hi = min(max(len(e) - 1, 1), LONGEST - 1), LONGEST if stem else len(e) + 2
            if e[:2].isascii():
                self.head[int.from_bytes(e[:2].encode(), "big"), lo:hi] = True
            if not stem and e[-2:].isascii():
                self.tail[int.from_bytes(e[-2:].encode(), "big"), lo:hi] = True

    def match(self, word: str) -> tuple[str, int] | None:
        """(entry, errors) for a word in lower case, as find() of the trie has it."""
        if word in self.known:
            return self.known[word]
        p = plain(word)
        found = self.trie.find(p) if p[:2] in self.heads or p[-2:] in self.tails else None
        if len(word) <= KEPT:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = found
        return found

    def token(self, raw: bytes) -> bool:
        """Whether a stretch of letters, digits and bytes beyond ASCII has a word that matches."""
        text = raw.decode("utf-8", "replace")
        # How a capital sigma is lowered depends on what follows it in the text.
        if "Σ" in text:
            return True
        text = text.lower()
        return bool(self.known[text]) if text in self.known else any(map(self.match, WORD.findall(text)))

    def hits(self, words: Iterable[str]) -> dict[str, tuple[str, int]]:
        """The distinct words that match, with entry and errors."""
        return {w: m for w in set(words) if (m := self.match(w))}

    def suspects(self, texts: pa.Array) -> np.ndarray:
        """Which texts may have hits: words of ASCII whose ends and length pass or that have a longer run, and all others, are matched."""
        out = np.zeros(len(texts), bool)
        for at, data, offsets in blocks(texts):
            low = PLAIN[data]
            inside = LETTER[data]
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            cut = offsets[:-1][offsets[:-1] < len(data)]
            first[cut] = inside[cut]
            start = np.flatnonzero(first)
            if not len(start):
                continue
            stop = np.flatnonzero(inside & np.append(~inside[1:] | first[1:], True)) + 1
            pick = np.maximum.reduceat(data, start) > 127
            run = np.flatnonzero((low[:-2] == low[1:-1]) & (low[:-2] == low[2:]) & inside[:-2])
            pick[np.searchsorted(start, run, "right") - 1] = True
            size = stop - start
            size[size < 2] = 0
            size = np.minimum(size, LONGEST - 1)
            ends = lambda i: (low[i].astype(np.int32) << 8) | low[np.minimum(i + 1, len(low) - 1)]
            pick = np.flatnonzero(pick | self.head[ends(start), size] | self.tail[ends(np.maximum(stop - 2, 0)), size])
            row = np.searchsorted(offsets, start[pick], "right") - 1
            body = data.tobytes()
            for r, x, y in zip((row + at).tolist(), start[pick].tolist(), stop[pick].tolist(), strict=True):
                if not out[r] and self.token(body[x:y]):
                    out[r] = True
        return out


#: Lengths of words told apart; longer words are matched anew each time.
LONGEST, KEPT = 40, 64
#: Bytes of letters and digits, ASCII or not; bytes as plain() has them.
LETTER = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])
PLAIN = LOWER.copy()
PLAIN[list(SIGNS)] = list(SIGNS.values())


def evidence(text: str, lexicon: Lexicon) -> tuple[float, float, int]:
    """(evidence of exact hits, of misspelled ones, number of hits) in a text, by context."""
    text = text.lower()
    found = list(WORD.finditer(text))
    names = [m.group() for m in found]
    hits = lexicon.hits(names)
    total, n = [0.0, 0.0], 0
    for i, m in enumerate(found) if hits else ():
        if names[i] not in hits:
            continue
        n += 1
        around = names[max(0, i - WINDOW) : i] + names[i + 1 : i + 1 + WINDOW]
        before, after = text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 40]
        weight = 1.0
        if any(q in before for q in QUOTES) and any(q in after for q in QUOTES):
            weight *= 0.4
        if REPORTING.intersection(around):
            weight *= 0.6
        if ADDRESS.intersection(around):
            weight *= 1.2
        total[min(1, hits[names[i]][1])] += weight
    return total[0], total[1], n


def features(exact: float, fuzzy: float) -> list[float]:
    """Evidence saturates: the first hit says most."""
    return [1.0, 1 - np.exp(-exact), 1 - np.exp(-fuzzy), min(exact + fuzzy, 5.0) / 5]


@dataclass
class Model:
    entries: list[tuple[str, bool, bool]] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [-2.0, 0.0, 0.0, 0.0])


def numbered(texts: Iterable[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, "" first; numbers of the words of all texts in turn; where each text begins in them, and the end)."""
    numbers: dict[str, int] = {"": 0}
    parts, ends = [np.zeros(0, np.int32)], [0]
    for t in texts:
        parts.append(np.array([numbers.setdefault(w, len(numbers)) for w in words_of(t)], np.int32))
        ends.append(ends[-1] + len(parts[-1]))
    return list(numbers), np.concatenate(parts), np.array(ends)


def fit_lexicon(names: list[str], words: np.ndarray, ends: np.ndarray, toxic: np.ndarray, purity: float = 0.95, chance: float = 0.01) -> list[tuple[str, bool, bool]]:
    """Entries whose texts are toxic too often to be so by chance, given how many words there are to choose from.

    A word of toxic texts counts once for each word it follows, so that copies of a text count as one text.
    """
    size = np.diff(ends)
    y = np.repeat(toxic > 0, size)
    last = np.concatenate([[0], words[:-1]])
    last[ends[:-1][size > 0]] = 0
    long = np.array([len(w) >= 3 for w in names])[words]
    pair = last.astype(np.int64) * len(names) + words
    first = np.zeros(len(words), bool)
    first[np.flatnonzero(long)[np.unique(pair[long], return_index=True)[1]]] = True
    bad_of, good_of = (np.bincount(words[at], minlength=len(names)) for at in (long & y & first, long & ~y))
    stems_of = lambda w: (w[:k] for k in range(4, min(8, len(w))))
    bad = Counter({(names[i], False): int(bad_of[i]) for i in np.flatnonzero(bad_of)})
    endings: dict[str, dict[str, int]] = defaultdict(dict)
    for (w, _), n in list(bad.items()):
        for k in stems_of(w):
            bad[k, True] += n
            endings[k][w] = n
    good = Counter({(w, False): int(n) for w, n in zip(names, good_of, strict=True) if n and (w, False) in bad})
    for i in np.flatnonzero(good_of):
        for k in stems_of(names[i]):
            if k in endings:
                good[k, True] += int(good_of[i])
    rate = min(max(int(y.sum()) / max(1, len(words)), 1e-3), 0.9)
    least = max(3, int(np.ceil(np.log(chance / max(1, sum(n > 2 for n in bad.values()))) / np.log(rate))))
    pure = lambda e: bad[e] >= least and bad[e] >= purity * (bad[e] + good[e])
    stems: list[str] = []
    for e, _ in sorted(e for e in bad if e[1] and pure(e)):
        # A stem needs several endings, none of them the rule; it reaches as far as its words agree.
        if len(endings[e]) >= 4 and max(endings[e].values()) < 0.5 * bad[e, True]:
            whole = os.path.commonprefix(list(endings[e]))
            if not any(whole.startswith(s) for s in stems):
                stems = [*(s for s in stems if not s.startswith(whole)), whole]
    kept = sorted(w for w, stem in bad if not stem and pure((w, False)) and not any(w.startswith(s) for s in stems))
    return [*((s, True, False) for s in stems), *((w, False, len(w) >= 5) for w in kept)]


def fit(texts: list[str], toxic: list[int]) -> Model:
    if not 0 < sum(toxic) < len(toxic):
        return Model()
    names, words, ends = numbered(texts)
    entries = fit_lexicon(names, words, ends, np.array(toxic))
    # Errors are allowed where they bring in next to no clean text.
    lexicon, bad, good = Lexicon(entries), Counter(), Counter()
    near = {i: m[0] for i, w in enumerate(names) if (m := lexicon.match(w)) and m[1]}
    marks = np.zeros(len(names), bool)
    marks[list(near)] = True
    for lo, hi, y in zip(ends[:-1], ends[1:], toxic, strict=True):
        own = words[lo:hi]
        (bad if y else good).update({near[i] for i in own[marks[own]].tolist()})
    del names, words, near
    entries = [(e, stem, fuzzy and good[e] <= max(1, bad[e] // 10)) for e, stem, fuzzy in entries]
    lexicon = Lexicon(entries)
    x = np.array([features(*evidence(t, lexicon)[:2]) for t in texts])
    y = np.array(toxic, float)
    # Misspellings are too rare to weigh for themselves: they share the weight of exact hits, at a discount.
    z = np.stack([x[:, 0], x[:, 1] + 0.9 * x[:, 2], x[:, 3]], axis=1)
    w, ridge = np.zeros(3), np.array([1e-3, 0.01, 0.01])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-6:
            break
    return Model(entries, [float(w[0]), float(w[1]), float(0.9 * w[1]), float(w[2])])


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[list[str], list[int]]:
    """Texts and labels of at most `sample` labelled rows that are not held out, those whose ids have the least hashes."""
    ids = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).where(~held_out(doc_id)).groupBy(F.col(doc_id).alias("label_id")).agg(F.max(F.col(label)).alias("y"))
    ids = ids.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    texts = docs.select(F.col(doc_id).alias("text_id"), F.col(text).alias("t"))
    rows = texts.join(F.broadcast(ids), F.col("text_id") == F.col("label_id")).groupBy("label_id").agg(F.min("t").alias("t"), F.min("y").alias("y"))  # of several texts the least
    rows = rows.orderBy("label_id").collect()
    return [r["t"] or "" for r in rows], [int(r["y"] > 0) for r in rows]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """docs with `into`: how likely each text is toxic, from 0 to 1."""
    spot = docs.columns.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, w = Lexicon(model.entries), np.array(model.weights)
        for batch in batches:
            x = np.tile(features(0.0, 0.0), (len(batch), 1))
            for i in np.flatnonzero(lexicon.suspects(batch.column(spot))):
                x[i] = features(*evidence(batch.column(spot)[i].as_py(), lexicon)[:2])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))], names=[*batch.schema.names, into])
        release()

    return docs.mapInArrow(each, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without those that score `threshold` or more, in their own columns."""
    into = private_name(docs, "score")
    return score(docs, model, text, into).where(F.col(into) < threshold).drop(into)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(*training_rows(docs, table(spark, sf_dir, "labels"))))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
