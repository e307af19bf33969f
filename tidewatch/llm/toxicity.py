"""Toxicity by a fuzzy lexicon and the context of its matches.

* The lexicon is learned: words and stems (written with a final *, any ending may follow) that are far more frequent in toxic
  labelled texts and together cover these; a term's weight is its log odds.  Copies (texts equal but for case, punctuation and
  spacing) count once, and there is no limit to the terms: the sample bounds them.
* Words of a text are matched by the intersection of the Levenshtein automata of all terms with the trie of the terms,
  made deterministic as far as texts need it: a state is the set of (trie node, edits used) that a prefix can reach.
  Words of up to 4 letters must match exactly, up to 8 within one edit, longer ones within two; stems of up to 6 letters
  exactly, longer ones within one.
* A match is weighed by its window: in quotation marks or near words of reporting it counts as a quotation, near words of
  address as abuse.
* A logistic model over the matches' counts and window sums gives the score.

Null and empty texts have no match and get the score of a text without match.  Without labelled rows of both classes there is
no model and every score is 0.  Only the text enters a score; repeated rows get equal scores.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.labelled import held_out, training_sample

WORD = re.compile(r"\w+")
THRESHOLD = 0.7
WINDOW = 8  # words on either side of a match
LEAST_TEXTS = 4  # distinct toxic texts that a term must be in
LEAST_GAIN = 2.0  # toxic texts that a term must add: four of which each has one other term
STEMS = range(3, 8)  # letters of a stem
KNOWN_WORDS = 200_000
# a quotation is a pair of marks of one style inside a paragraph; a mark without its partner within REACH characters is none
REACH = 400
QUOTATION = re.compile(
    r"„[^„“”\n]{1,%(n)d}+[“”]|“[^“”\n]{1,%(n)d}+”|«[^«»\n]{1,%(n)d}+»|»[^«»\n]{1,%(n)d}+«"
    r"|(?<!\w)\"(?=\S)[^\"\n]{1,%(n)d}+\"(?!\w)|(?<!\w)'(?=\w)(?:[^'\n]|(?<=\w)'(?=\w)){1,%(n)d}+'(?!\w)|‘(?:[^‘’\n]|(?<=\w)’(?=\w)){1,%(n)d}+’|‚[^‚‘’\n]{1,%(n)d}+[‘’]" % {"n": REACH}
)
# words of address and of reporting in the languages of the texts
ADDRESS = frozenset("you your youre yourself u ur thou tu te toi vous votre ton ta du dich dir dein deine ihr euch usted ustedes eres vosotros".split())
REPORT = frozenset(
    "said says say called calls wrote writes quote quoted quotes word words term slur insult insults reported "
    "dit disait écrit mot terme insulte sagte sagt schrieb wort beleidigung dijo dice escribió palabra insulto".split()
)
FEATURES = ("any", "exact", "near", "quoted", "direct", "terms", "weight", "density", "densest")


def edits_for(term: str) -> int:
    if term.endswith("*"):
        return 0 if len(term) <= 7 else 1
    return 0 if len(term) <= 4 else 1 if len(term) <= 8 else 2


def terms_of(text: str | None) -> set[str]:
    """Words of a text and their stems, as terms."""
    words = {w for w in WORD.findall(text.lower() if isinstance(text, str) else "") if len(w) > 2 and not w.isdigit()}
    return words | {w[:n] + "*" for w in words for n in STEMS if n < len(w)}


class Lexicon:
    """Deterministic product of the terms' trie and their Levenshtein automata, built as words are read."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term, self.stem = [""], [""]
        self.most = [0]  # edits that some term below the node allows
        for term in terms:
            node = 0
            self.most[0] = max(self.most[0], edits_for(term))
            for c in term.removesuffix("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append("")
                    self.stem.append("")
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], edits_for(term))
            (self.stem if term.endswith("*") else self.term)[node] = term
        self.letters = {c for t in terms for c in t if c != "*"}
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.accepts: list[tuple[str, int] | None] = []  # the word that ends here
        self.passes: list[tuple[str, int] | None] = []  # the stem that ends here
        self.table: list[dict[str, int]] = []
        self.dead = self._number({})
        self.start = self._number(self._close({0: 0}))

    def _close(self, state: dict[int, int]) -> dict[int, int]:
        """Add what missing letters reach."""
        todo = list(state.items())
        while todo:
            node, used = todo.pop()
            for child in self.children[node].values():
                if used + 1 <= self.most[child] and used + 1 < state.get(child, 99):
                    state[child] = used + 1
                    todo.append((child, used + 1))
        return state

    def _number(self, state: dict[int, int]) -> int:
        key = tuple(sorted(state.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.table.append({})
            for ends, names in ((self.accepts, self.term), (self.passes, self.stem)):
                found = [(used, names[node]) for node, used in key if names[node] and used <= edits_for(names[node])]
                ends.append((min(found)[1], min(found)[0]) if found else None)
        return self.numbers[key]

    def _step(self, number: int, letter: str) -> int:
        after: dict[int, int] = {}

        def reach(node: int, used: int) -> None:
            if used <= self.most[node] and used < after.get(node, 99):
                after[node] = used

        for node, used in self.states[number]:
            reach(node, used + 1)  # a letter too many
            for c, child in self.children[node].items():
                reach(child, used + (c != letter))
        return self._number(self._close(after))

    def find(self, word: str) -> tuple[str, int] | None:
        """The nearest word or else stem within its edits, and the distance."""
        state, table, letters, dead, passes = self.start, self.table, self.letters, self.dead, self.passes
        stem = None
        for c in word:
            c = c if c in letters else ""
            after = table[state].get(c)
            if after is None:
                after = table[state][c] = self._step(state, c)
            if after == dead:
                return stem
            state = after
            if passes[state] is not None and (stem is None or passes[state][1] <= stem[1]):
                stem = passes[state]
        whole = self.accepts[state]
        return stem if whole is None or stem is not None and stem[1] < whole[1] else whole


class Matches(dict):
    """word -> (term, distance) or None, remembered per worker."""

    def __init__(self, weights: dict[str, float]):
        self.lexicon, self.weights = Lexicon(list(weights)), weights

    def __missing__(self, word: str):
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = found = self.lexicon.find(word)
        return found


def features(text: str | None, matches: Matches) -> list[float]:
    """FEATURES of one whole text."""
    low = text.lower() if isinstance(text, str) else ""
    words = WORD.findall(low)
    hits = {w for w in set(words) if matches[w] is not None}
    if not hits:
        return [0.0] * len(FEATURES)
    spots = [m.start() for m in WORD.finditer(low)]
    spans = QUOTATION.finditer(low)
    span = next(spans, None)
    exact = near = told = direct = 0.0
    terms = set()
    weights = []
    for k, w in enumerate(words):
        if w not in hits:
            continue
        while span is not None and span.end() <= spots[k]:
            span = next(spans, None)
        around = words[max(0, k - WINDOW) : k + WINDOW + 1]
        quotation = span is not None and span.start() < spots[k] or not REPORT.isdisjoint(around)
        abuse = not ADDRESS.isdisjoint(around)
        term, distance = matches[w]
        terms.add(term)
        weight = matches.weights[term] / 4 * (1.0 if distance == 0 else 0.5) * (0.3 if quotation else 1.0) * (1.5 if abuse else 1.0)
        weights.append((k, weight))
        if quotation:
            told += 1
        elif distance == 0:
            exact += 1
        else:
            near += 1
        direct += abuse and not quotation
    densest = total = 0.0
    everything = sum(w for _, w in weights)
    first = 0
    for k, weight in weights:
        total += weight
        while weights[first][0] < k - 2 * WINDOW:
            total -= weights[first][1]
            first += 1
        densest = max(densest, total)
    log = math.log1p
    return [float(exact > 0), log(exact), log(near), log(told), log(direct), log(len(terms)), log(everything), math.log1p(100 * everything / len(words)), log(densest)]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; coefficients with the intercept last."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = weight / weight.sum()
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * beta
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        beta -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def adds_nothing(term: str, chosen: str) -> bool:
    """Whether ``term`` is a longer or shorter form of a chosen term; a stem does not stand for its words, which allow other edits."""
    a, b = term.removesuffix("*"), chosen.removesuffix("*")
    if chosen.endswith("*") and not term.endswith("*"):
        return False
    return a.startswith(b) or b.startswith(a)


def choose_terms(hits: list[tuple[int, float, np.ndarray]], candidates: list[str]) -> list[str]:
    """Greedy cover: the candidate that adds most toxic weight beyond the clean weight it touches, until too little is added.

    A toxic text counts half as much with every term that it already has, so that words which only go along with a
    few texts are not taken while the common terms are, also where they occur together.  Every choice takes at least
    half of LEAST_GAIN of the toxic weight, so there are at most as many terms as toxic texts.  Gains only fall, so a candidate
    whose fresh gain still leads is the best one.
    """
    toxic = np.array([y == 1 for y, _, _ in hits], bool)
    left = np.array([w for _, w, _ in hits], float)
    least = LEAST_GAIN * (left[toxic].mean() if toxic.any() else 1.0)
    sizes = np.array([len(c) for _, _, c in hits], np.int64)
    of = np.concatenate([np.asarray(c, np.int32) for _, _, c in hits]) if hits else np.empty(0, np.int32)
    order = np.argsort(of, kind="stable")
    text = np.repeat(np.arange(len(hits), dtype=np.int32), sizes)[order]
    cuts = np.searchsorted(of[order], np.arange(len(candidates) + 1))
    clean, found = np.zeros(len(candidates)), []
    for k in range(len(candidates)):
        mine = text[cuts[k] : cuts[k + 1]]
        clean[k] = left[mine[~toxic[mine]]].sum()
        found.append(mine[toxic[mine]])
    queue = [(clean[k] - left[found[k]].sum(), k) for k in range(len(candidates))]
    heapq.heapify(queue)
    chosen: list[int] = []
    while queue:
        stale, k = heapq.heappop(queue)
        if -stale < least:
            break
        if any(adds_nothing(candidates[k], candidates[c]) for c in chosen):
            continue
        fresh = (clean[k] - left[found[k]].sum(), k)
        if queue and fresh > queue[0]:
            heapq.heappush(queue, fresh)
        elif -fresh[0] >= least:
            chosen.append(k)
            left[found[k]] /= 2
    return [candidates[k] for k in chosen]


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], np.ndarray] | None:
    """Weighted terms and coefficients, from the training fold of ``labels``; None without both classes."""
    spark = docs.sparkSession
    sample = training_sample(labels, "toxic")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learned = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select("text", "label", "weight")  # bounded sample

    # of copies one; their words are the same
    bare = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\p{M}_]+", " ")
    distinct = learned.withColumn("copy", F.xxhash64(F.trim(bare))).dropDuplicates(["copy", "label"]).select("text", "label", "weight")

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, list[float]] = {}
            total = [0.0, 0.0]
            for text, label in zip(batch["text"], batch["label"]):
                total[label] += 1
                for w in terms_of(text):
                    seen.setdefault(w, [0.0, 0.0])[label] += 1
            seen[""] = total
            yield pd.DataFrame([(w, a, b) for w, (a, b) in seen.items()], columns=["word", "clean", "toxic"])

    counts = distinct.mapInPandas(words, "word string, clean double, toxic double").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = counts.filter("word = ''").collect()
    if not totals or not totals[0]["clean"] or not totals[0]["toxic"]:
        return None
    n_clean, n_toxic = totals[0]["clean"], totals[0]["toxic"]
    odds = F.log((F.col("toxic") + 0.5) / n_toxic) - F.log((F.col("clean") + 0.5) / n_clean)
    ranked = counts.filter((F.col("word") != "") & (F.col("toxic") >= LEAST_TEXTS)).withColumn("odds", odds).filter("odds >= 2").orderBy(F.desc(F.col("odds") * F.col("toxic")), F.col("word").endswith("*"), F.desc(F.length("word")), "word")
    ranked = ranked.select("word", "odds").collect()  # terms of the sample
    candidates = [r["word"] for r in ranked]
    places = {w: k for k, w in enumerate(candidates)}

    def spot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.array(sorted(places[w] for w in terms_of(t) if w in places), "<i4").tobytes() for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "weight": batch["weight"], "found": found})

    rows = distinct.mapInPandas(spot, "label int, weight double, found binary").filter("length(found) > 0").collect()  # of the sample
    terms = choose_terms(sorted(((r["label"], r["weight"], np.frombuffer(r["found"], "<i4")) for r in rows), key=lambda h: (h[0], h[1], h[2].tobytes())), candidates)
    odds_of = {r["word"]: min(8.0, r["odds"]) for r in ranked}
    weights = {t: odds_of[t] for t in terms}
    shared = spark.sparkContext.broadcast(weights)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matches = Matches(shared.value)
        for batch in batches:
            yield pd.DataFrame({"x": [features(t, matches) for t in batch["text"]], "label": batch["label"], "weight": batch["weight"]})

    rows = learned.mapInPandas(measure, "x array<double>, label int, weight double").groupBy("x", "label").agg(F.sum("weight").alias("weight")).collect()
    rows.sort(key=lambda r: (r["x"], r["label"]))  # the same sums on every run
    return weights, fit_logistic(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float), np.array([r["weight"] for r in rows]))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``, learned from ``labels`` (doc_id, toxic) outside the held-out fold."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, beta = model.value or ({}, None)
        matches = Matches(weights)
        for batch in batches:
            value = np.zeros(len(batch))
            if beta is not None and len(batch):
                x = np.array([features(t, matches) for t in batch["text"]])
                value = 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30, 30)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": value}).astype({"doc_id": "Int64"})

    scored = texts.mapInPandas(rate, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` below the threshold, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, beta = model.value or ({}, None)
        matches = Matches(weights)
        limit = math.log(THRESHOLD / (1 - THRESHOLD))
        for batch in texts:
            yield pd.Series([beta is None or float(np.dot(features(t, matches), beta[:-1]) + beta[-1]) < limit for t in batch], dtype=bool)

    return docs.filter(clean(F.col("text").cast("string")))
