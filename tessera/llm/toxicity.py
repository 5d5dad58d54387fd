"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows that tell quotation from abuse.

The lexicon is learned from labelled texts: words, and stems (beginnings of 4 to 8 letters, written `stem*`), that toxic
texts have much more often than others. The trie of the lexicon and the Levenshtein automaton of each term are run
together as one automaton, whose states (sets of trie node and edits so far) are made when first met; a word is
read once and mostly leaves the automaton after a few letters. Words of five letters or more match at one edit, stems and
shorter words only as they are. Matches add up their log-odds in a sliding window; a match inside quotation marks or
after a reporting verb counts to the quoted side, the others to the abusive side. A logistic regression over these
window scores, with a prior that keeps misspelt and quoted matches at set shares, gives the score.

Training rows: at most `per_class` labelled rows of either label, by hash of the id, of fold 1-4, in two halves, each
measured by a lexicon of the other for the regression. Without toxic training rows nothing is toxic. Null texts count as empty and score
as texts without matches. Repeated rows repeat their scores, an empty table stays empty; labels, lang, source and ids
are never inputs of a score.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, map_batches, materialize

STRIP = "\"'“”„«»‹›‘’.,;:!?()[]{}<>*_~`|#$%&-"
OPEN, CLOSE = "“„«‹‘", "”»›’"
QUOTES = OPEN + CLOSE
# Verbs and nouns that announce a quotation.
REPORTING = frozenset("said says wrote quoted quote called calling word words term dit disait écrit mot cité sagte schrieb wort zitat genannt dijo escribió palabra cita llamó".split())
WINDOW, BEFORE = 24, 4


class Lexicon:
    """terms: (text, is_stem, weight); look-ups give (term number, edits) or None. `exact` names terms that take no edit."""

    def __init__(self, terms: list[tuple[str, bool, float]], fuzzy_from: int = 5, remember: int = 300_000, exact: frozenset[str] = frozenset()):
        self.weights = [w for _, _, w in terms]
        self.child: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.slack: list[int] = [0]  # edits that some term below still allows
        for number, (text, stem, _) in enumerate(terms):
            node, slack = 0, int(not stem and len(text) >= fuzzy_from and text not in exact)
            self.slack[0] = max(self.slack[0], slack)
            for c in text:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.word.append(-1)
                    self.stem.append(-1)
                    self.slack.append(0)
                node = self.child[node][c]
                self.slack[node] = max(self.slack[node], slack)
            (self.stem if stem else self.word)[node] = number
        self.allowed = [int(not stem and len(text) >= fuzzy_from and text not in exact) for text, stem, _ in terms]
        self.known: dict[str, tuple[int, int] | None] = {}
        self.remember = remember
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """Closes a set under left-out letters, drops hopeless nodes, and numbers it; -1 is the empty set."""
        todo = list(nodes.items())
        while todo:
            node, edits = todo.pop()
            if edits > self.slack[node]:
                nodes.pop(node, None)
                continue
            if edits < self.slack[node]:
                for kid in self.child[node].values():
                    if self.slack[kid] > edits and nodes.get(kid, 9) > edits + 1:
                        nodes[kid] = edits + 1
                        todo.append((kid, edits + 1))
        key = tuple(sorted(nodes.items()))
        if not key:
            return -1
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        to: dict[int, int] = {}
        for node, edits in self.sets[state]:
            kid = self.child[node].get(c)
            if kid is not None and to.get(kid, 9) > edits:
                to[kid] = edits
            if edits < self.slack[node]:
                if to.get(node, 9) > edits + 1:
                    to[node] = edits + 1  # an extra letter
                for other in self.child[node].values():
                    if self.slack[other] > edits and to.get(other, 9) > edits + 1:
                        to[other] = edits + 1  # a wrong letter
        return self._state(to)

    def find(self, word: str) -> tuple[int, int] | None:
        """The best match of a word: fewest edits, then the greatest weight; an exact stem counts as no edit."""
        node, stem = 0, None
        for c in word:
            node = self.child[node].get(c, -1)
            if node < 0:
                break
            if self.stem[node] >= 0 and (stem is None or self.weights[self.stem[node]] > self.weights[stem]):
                stem = self.stem[node]
        if len(self.sets) > 50_000:  # the automaton is finite, but its memory has a bound of its own
            self.states, self.sets, self.moves = {}, [], []
            self.start = self._state({0: 0})
        state = self.start
        for c in word:
            if state < 0:
                break
            moves = self.moves[state]
            if c in moves:
                state = moves[c]
            else:
                moves[c] = state = self._move(state, c)
        ends = [(edits, -self.weights[t], t) for n, edits in (self.sets[state] if state >= 0 else ()) if (t := self.word[n]) >= 0 and edits <= self.allowed[t]]
        if stem is not None:
            ends.append((0, -self.weights[stem], stem))
        return (min(ends)[2], min(ends)[0]) if ends else None

    def look(self, token: str) -> tuple[int, int] | None:
        if token not in self.known:
            if len(self.known) > self.remember:
                self.known.clear()
            bare = token.strip(STRIP)
            self.known[token] = self.find(bare) if bare else None
        return self.known[token]


def quoted_at(words: list[str], at: list[int]) -> list[bool]:
    """Whether each place is between a pair of quotation marks, however long the quotation, or follows a reporting word.

    A straight mark before a word opens and one after a word closes; a mark that finds no partner, or that another opening mark follows first, means nothing.
    """
    spans, begin = [], None
    for i, word in enumerate(words):
        if '"' not in word and not any(c in word for c in QUOTES):
            continue
        lead = word[: len(word) - len(word.lstrip(STRIP))]
        tail = word[len(word.rstrip(STRIP)) :] if lead != word else ""
        if any(c in OPEN or c == '"' for c in lead):
            begin = i
        if any(c in CLOSE or c == '"' for c in tail) and begin is not None:
            spans.append((begin, i))
            begin = None
    starts = [a for a, _ in spans]
    out = []
    for i in at:
        k = bisect_left(starts, i + 1) - 1
        near = any(w.strip(STRIP) in REPORTING for w in words[max(0, i - BEFORE) : i])
        out.append(near or (k >= 0 and spans[k][1] >= i))
    return out


def measures(lexicon: Lexicon, text: str) -> np.ndarray:
    """Window maxima of abusive exact, abusive misspelt and quoted weights, and the logarithm of the matches by kind."""
    words = text.lower().split()
    look = lexicon.look
    hits = [(i, h) for i, h in enumerate(map(look, words)) if h is not None]
    out = np.zeros(6)
    if not hits:
        return out
    at = [i for i, _ in hits]
    quoted = quoted_at(words, at)
    weight = np.array([lexicon.weights[h[0]] for _, h in hits])
    kind = np.array([2 if q else 1 if h[1] else 0 for (_, h), q in zip(hits, quoted)])
    total = np.zeros((len(hits) + 1, 3))
    np.add.at(total, (np.arange(1, len(hits) + 1), kind), weight)
    total = total.cumsum(axis=0)
    ends = [bisect_left(at, i + WINDOW) for i in at]
    out[:3] = np.sqrt(np.maximum((total[ends] - total[:-1]).max(axis=0), 0))
    out[3:] = np.log1p(np.bincount(kind, minlength=3))
    return out


#: Where the regression starts from and is held to: exact, misspelt and quoted window scores, then the counts by kind.
PRIOR = np.array([1.6, 1.0, 0.4, 0.5, 0.3, 0.1])


def regress(x: np.ndarray, y: np.ndarray, hold: float = 0.02, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient descent, weights held to PRIOR and never below zero: a match never lowers the score."""
    w, b = PRIOR.copy(), -3.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y
        w = np.maximum(w - 0.3 * (x.T @ g / len(y) + hold * (w - PRIOR)), 0)
        b -= 0.3 * g.mean()
    return w, b


def closed(terms: list[tuple[str, bool, float, int]]) -> list[tuple[str, bool, float]]:
    """Without stems that a term one or more letters longer replaces: one that nearly as many toxic texts have."""
    best: dict[str, int] = {}
    for text, _, _, n in terms:
        for k in range(4, len(text) + 1):
            if k < len(text):
                best[text[:k]] = max(best.get(text[:k], 0), n)
    whole = {text: n for text, stem, _, n in terms if not stem}
    return [(t, stem, w) for t, stem, w, n in terms if not stem or max(best.get(t, 0), whole.get(t, 0)) < 0.9 * n]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = 4000, least: int = 3, share: float = 0.02) -> dict:
    """The lexicon (each term in `least` toxic texts and in `share` of them, which bounds it) and the regression.

    Rows are halved by hash. Three lexicons are learned, of either half and of all rows; the regression learns from each half measured by the other
    half's lexicon, and the lexicon of all rows goes with it.
    """
    sample = materialize(labelled_sample(docs, labels, label, id_col, text_col, per_class).withColumn("__half", F.pmod("__h", F.lit(2)).cast("int")), "labelled")
    sizes = {(r["__y"], r["__half"]): r["n"] for r in sample.groupBy("__y", "__half").agg(F.count("*").alias("n")).collect()}
    n = {y: [sizes.get((y, 0), 0), sizes.get((y, 1), 0), sizes.get((y, 0), 0) + sizes.get((y, 1), 0)] for y in (0, 1)}
    if not n[0][2] or not n[1][2]:
        return {"terms": [], "exact": frozenset(), "w": PRIOR, "b": -5.0}

    def start():
        def work(cols):
            out: dict[tuple[str, bool], list[int]] = {}
            for text, y, half in zip(*cols):
                words = {w.strip(STRIP) for w in text.lower().split()} - {""}
                for term in {(w, False) for w in words} | {(w[:k], True) for w in words for k in range(4, 9) if k < len(w)}:
                    out.setdefault(term, [0, 0, 0, 0])[2 * y + half] += 1
            return [[k[0] for k in out], [k[1] for k in out], *([v[j] for v in out.values()] for j in range(4))]

        return work

    names = ["d00", "d01", "d10", "d11"]
    counted = map_batches(sample.select("__text", "__y", "__half"), "term string, stem boolean, " + ", ".join(f"{c} long" for c in names), start, 2048)
    summed = counted.groupBy("term", "stem").agg(*(F.sum(c).alias(c) for c in names)).where((F.col("d10") + F.col("d11") >= least) & (F.col("d10") + F.col("d11") >= share * min(n[1]) if min(n[1]) else F.lit(True)))
    rows = [r.asDict() for r in summed.where((F.col("d10") + F.col("d11")) * (n[0][2] + 1) > 20 * (F.col("d00") + F.col("d01")) * n[1][2] / 2).collect()]
    lexicons = []
    for k in range(3):
        terms = []
        for r in rows:
            d0, d1 = ((r[f"d{y}0"], r[f"d{y}1"], r[f"d{y}0"] + r[f"d{y}1"])[k] for y in (0, 1))
            odds = np.log((d1 + 0.25) / (n[1][k] + 0.5)) - np.log((d0 + 0.25) / (n[0][k] + 0.5))
            sure = np.log(max(d1, 0.1) / n[1][k] if n[1][k] else 0.1) - np.log((d0 + 1) / max(n[0][k], 1))  # one clean text more would have it
            if d1 >= least and d1 >= share * n[1][k] and sure > 4.0:
                terms.append((r["term"], r["stem"], float(odds), d1))
        lexicons.append(closed(sorted(terms)))
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)

    def misses():
        own = [Lexicon(x) for x in shared.value]

        def work(cols):
            out: dict[tuple[int, str], int] = {}
            for text, half in zip(*cols):
                words = set(text.lower().split())
                for k in (half, 2):
                    for t in {shared.value[k][h[0]][0] for w in words if (h := own[k].look(w)) and h[1]}:
                        out[k, t] = out.get((k, t), 0) + 1
            return [[k for k, _ in out], [t for _, t in out], list(out.values())]

        return work

    # Terms that clean texts come within an edit of say nothing when misspelt.
    clean = sample.where("__y = 0").select("__text", "__half")
    close = map_batches(clean, "k int, term string, n long", misses, 512).groupBy("k", "term").agg(F.sum("n").alias("n")).collect()
    exact = [frozenset(r["term"] for r in close if r["k"] == k and r["n"] > 0.002 * n[0][k]) for k in range(3)]

    def begin():
        own = [Lexicon(shared.value[k], exact=exact[k]) for k in (1, 0)]
        return lambda cols: [cols[1], [measures(own[half], t).tolist() for t, half in zip(cols[0], cols[2])]]

    got = map_batches(sample.select("__text", "__y", "__half"), "y int, x array<double>", begin, 256).collect()
    x, y = np.array([r["x"] for r in got]).reshape(-1, 6), np.array([r["y"] for r in got], float)
    w, b = regress(x, y) if len(y) else (PRIOR, -3.0)
    return {"terms": lexicons[2], "exact": exact[2], "w": w, "b": min(b, -0.5)}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, held_out, score, predicted, n_matches)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        own = shared.value
        lexicon = Lexicon(own["terms"], exact=own["exact"])

        def work(cols):
            x = np.array([measures(lexicon, t) for t in cols[2]]).reshape(-1, 6)
            p = 1 / (1 + np.exp(-np.clip(x @ own["w"] + own["b"], -30, 30)))
            return [cols[0], cols[1], p, (p >= threshold).astype(np.int32), np.rint(np.expm1(x[:, 3:]).sum(axis=1)).astype(np.int64)]

        return work

    rows = docs.select(F.col(id_col), (fold(F.col(id_col)) == 0).alias("__held"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    return map_batches(rows, f"{id_col} {dict(docs.dtypes)[id_col]}, held_out boolean, score double, predicted int, n_matches long", start, 256)
