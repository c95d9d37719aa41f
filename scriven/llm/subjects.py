"""Subject areas of documents (problem 9).

Class-association rules are mined from labelled texts: patterns of terms that
occur in one sentence, with the subject of the text as consequence. Mining is
parallel frequent-pattern growth: the frequent terms are dealt to groups, each
sentence is sent to the groups of its terms as a prefix in order of frequency,
and each group grows the patterns of any length that end in its terms from a
prefix tree whose nodes count subjects. Every rule, those of one term included,
is read from these trees. Growth stops where no longer pattern can become more
confident, and leaves out terms that stand in every sentence of a pattern
(closed patterns); a rule is redundant when a part of it is as confident.
Confidences are calibrated: subjects weigh the same whatever their number of
labels, and small counts are shrunk towards chance. Further rounds mine the
sample again, with the subjects the rules so far gave its texts, which corrects
wrong labels and brings in terms and languages that few labels cover.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, stored
from .lookalike import same_form
from .sentences import split

#: Texts that rules are mined from, those of least id digest: labelled ones, and others. Longer texts are left out of mining only.
LABELLED_TEXTS, OTHER_TEXTS, MINED_CHARS = 2500, 1500, 6000
#: Confidence that a rule must have, and sentences that its pattern must stand in, in each round; early rounds weigh sparse and partly wrong labels.
ROUNDS = ((0.4, 3), (0.5, 5), (0.6, 7))
#: Sentences spread evenly over the subjects that calibration adds to each rule.
SHRINK = 4.0
#: Confidence that a longer pattern must add to its parts.
GAIN = 0.05
#: Groups that terms are dealt to; a sentence goes to at most so many.
GROUPS = 8

_RUN = re.compile(r"[ก-๛]+|[ぁ-ヿ㐀-鿿々]+|[^\W\d_ก-๛ぁ-ヿ㐀-鿿々]+|\d+")
_ASCII_RUN = re.compile(r"[a-z]+|[0-9]+")
_SPACELESS = re.compile("[ก-๛ぁ-ヿ㐀-鿿々]")


def plain_text(sentence: str) -> str:
    """A sentence in one form and lower case."""
    return same_form(sentence).lower()


def terms_of(plain: str) -> list[str]:
    """Terms of a plain sentence, repeated ones included.

    Words of four letters and pairs of words; in scripts without spaces, runs of three (Thai:
    six) characters.
    """
    if plain.isascii():
        words = _ASCII_RUN.findall(plain)
        runs: list[str] = []
    else:
        words = _RUN.findall(plain)
        runs = [w for w in words if _SPACELESS.match(w)]
    out = [w for w in words if len(w) >= 4 and not w[0].isdigit()] if not runs else [w for w in words if len(w) >= 4 and not w[0].isdigit() and not _SPACELESS.match(w)]
    for a, b in zip(words, words[1:], strict=False):
        if len(a) + len(b) >= 6 and a[0].isalpha() and b[0].isalpha() and not (runs and (_SPACELESS.match(a) or _SPACELESS.match(b))):
            out.append(a + " " + b)
    for w in runs:
        n = 6 if "ก" <= w[0] <= "๛" else 3
        out += [w[k : k + n] for k in range(len(w) - n + 1)]
    return out


class PrefixTree:
    """A frequent-pattern tree over term ranks; every node counts the subjects of the sentences through it."""

    def __init__(self, subjects: int):
        self.subjects = subjects
        self.root: dict = {}
        self.places: dict[int, list[list]] = {}  # rank: nodes [rank, parent, counts, children]

    def add(self, ranks: tuple[int, ...], counts: list[float]) -> None:
        level, parent = self.root, None
        for r in ranks:
            node = level.get(r)
            if node is None:
                node = level[r] = [r, parent, counts.copy(), {}]
                self.places.setdefault(r, []).append(node)
            else:
                node[2] = [x + y for x, y in zip(node[2], counts, strict=True)]
            level, parent = node[3], node

    def grow(self, ends: set[int] | None, wanted: float, least: int, suffix: tuple[int, ...] = (), held: tuple[float, ...] = ()) -> Iterator[tuple[tuple[int, ...], int, float]]:
        """(pattern, subject, confidence) of the rules that are more confident than the part they grew from; those that end in ``ends`` only, if given.

        ``held`` are the confidences of ``suffix`` by subject.
        """
        chance = SHRINK / self.subjects
        for r, nodes in self.places.items():
            if ends is not None and r not in ends:
                continue
            counts = nodes[0][2] if len(nodes) == 1 else [sum(c) for c in zip(*[n[2] for n in nodes], strict=True)]
            total = sum(counts)
            if total < least:
                continue
            pattern = (r, *suffix)
            sure = tuple((c + chance) / (total + SHRINK) for c in counts)
            s = max(range(self.subjects), key=sure.__getitem__)
            if sure[s] >= wanted and (not held or sure[s] > held[s] + GAIN):
                yield pattern, s, sure[s]
            # a longer pattern has at most these sentences of a subject, and in the best case no others
            hope = [k for k, c in enumerate(counts) if c >= least and sure[k] >= wanted / 2 and (c + chance) / (c + SHRINK) > max(wanted, sure[k] + GAIN)]
            if not hope:
                continue
            paths: dict[tuple[int, ...], list[float]] = {}
            for n in nodes:
                path, up = [], n[1]
                while up is not None:
                    path.append(up[0])
                    up = up[1]
                if path:
                    key = tuple(path)
                    paths[key] = [x + y for x, y in zip(paths[key], n[2], strict=True)] if key in paths else n[2]
            # terms with enough sentences of a hopeful subject, but not those in every sentence of the pattern
            with_: dict[int, list[float]] = {}
            for path, c in paths.items():
                for q in path:
                    with_[q] = [x + y for x, y in zip(with_[q], c, strict=True)] if q in with_ else c
            kept = {q for q, c in with_.items() if sum(c) < total - 1e-9 and any(c[k] >= least for k in hope)}
            if kept:
                below = PrefixTree(self.subjects)
                for path, c in paths.items():
                    if some := tuple(q for q in path[::-1] if q in kept):
                        below.add(some, c)
                yield from below.grow(None, wanted, least, pattern, sure)


class Rules:
    """Rules by their terms (picklable; bounded by the sample they were mined from)."""

    def __init__(self, subjects: list[str]):
        self.subjects = subjects
        # rules as (confidence, minus the subject's number): the greatest is the surest, of equal ones the first subject's
        self.single: dict[str, tuple[float, int]] = {}
        self.joint: dict[str, list[tuple[tuple[float, int], frozenset[str]]]] = {}
        self.known: set[str] = set()  # every term of a rule
        self.pairs: dict[str, set[str]] = {}  # second words of word pairs among them, by the first

    def add(self, pattern: tuple[str, ...], subject: int, confidence: float) -> None:
        self.known.update(pattern)
        for t in pattern:
            if " " in t:
                a, b = t.split(" ")
                self.pairs.setdefault(a, set()).add(b)
        if len(pattern) == 1:
            self.single[pattern[0]] = (confidence, -subject)
        else:
            # found by its rarest term, which growth started from
            self.joint.setdefault(pattern[-1], []).append(((confidence, -subject), frozenset(pattern[:-1])))

    def terms_in(self, plain: str) -> set[str]:
        """The terms of rules in a plain sentence: those of ``terms_of`` that are known."""
        known, pairs = self.known, self.pairs
        if plain.isascii():
            words = _ASCII_RUN.findall(plain)
            found = known.intersection(words)
        else:
            words = _RUN.findall(plain)
            found = set()
            for w in words:
                if not _SPACELESS.match(w):
                    if w in known:
                        found.add(w)
                else:
                    n = 6 if "ก" <= w[0] <= "๛" else 3
                    found.update(known.intersection([w[k : k + n] for k in range(len(w) - n + 1)]))
        for k in [k for k, w in enumerate(words[:-1]) if w in pairs]:
            if words[k + 1] in pairs[words[k]]:
                found.add(words[k] + " " + words[k + 1])
        return found

    def subject_of(self, plain: str) -> tuple[int, float]:
        """(subject, confidence) of the surest rule that matches a plain sentence, or (-1, 0)."""
        terms = self.terms_in(plain)
        single, joint = self.single, self.joint
        # rules that overlap are no evidence of their own: the surest one decides
        best = (0.0, 1)
        for t in terms:
            if t in single and single[t] > best:
                best = single[t]
        for t in terms:
            if t in joint:
                for rule, rest in joint[t]:
                    if rule > best and rest <= terms:
                        best = rule
        return (-best[1], best[0]) if best[0] else (-1, 0.0)

    def shares(self, text: str | None) -> dict[int, tuple[float, float]]:
        """{subject: (share of the sentences that deal with it, mean confidence)}."""
        cuts = split(text)
        if not cuts:
            return {}
        # the whole text is brought to one form at once; the sign between sentences is for private use and stays
        plain = plain_text("\ue000".join([text[a:b].replace("\ue000", " ") for a, b in cuts])).split("\ue000")
        got: dict[int, list[float]] = {}
        for p in plain:
            s, c = self.subject_of(p)
            if s >= 0:
                got.setdefault(s, []).append(c)
        return {s: (len(c) / len(cuts), sum(c) / len(c)) for s, c in got.items()}


def mine(sentences: DataFrame, classes: DataFrame, subjects: list[str], wanted: float, least: int) -> Rules:
    """Rules of at least the confidence ``wanted`` and ``least`` sentences from ``sentences`` (doc_id, terms) and ``classes`` (doc_id, subject, weight)."""
    rules = Rules(subjects)
    sizes = {r.subject: r.n for r in classes.groupBy("subject").agg(F.sum("weight").alias("n")).collect()}
    if not sizes:
        return rules
    even = sum(sizes.values()) / len(sizes)
    # frequent subjects, which wrong labels also name most, count no more than rare ones
    balance = F.create_map(*[F.lit(x) for s, n in sorted(sizes.items()) for x in (s, min(3.0, even / n))])
    rows = sentences.join(F.broadcast(classes.withColumn("weight", F.col("weight") * balance[F.col("subject")])), "doc_id")
    # the list of frequent terms: enough sentences, in several texts, and enough of them of one subject; a rule's every term must have half the
    # confidence wanted, so terms that stand with all subjects alike do not make the trees wide
    counts = rows.select("doc_id", "subject", "weight", F.explode("terms").alias("term")).groupBy("term", "subject")
    counts = counts.agg(F.sum("weight").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    counts = counts.groupBy("term").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.min("low").alias("low"), F.max("high").alias("high"))
    frequent = counts.where((F.col("n") >= least) & (F.col("low") != F.col("high")) & (F.col("most") >= least * wanted) & (F.col("most") >= F.col("n") * (wanted / 2)))
    names = frequent.select("term", "n").toPandas().sort_values(["n", "term"], ascending=[False, True])["term"].tolist()
    if not names:
        return rules
    rank = {t: k for k, t in enumerate(names)}
    at, width = {s: k for k, s in enumerate(subjects)}, len(subjects)

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for terms, subject, weight in zip(pdf["terms"], pdf["subject"], pdf["weight"], strict=True):
                ranks = sorted([rank[t] for t in terms if t in rank])
                done: set[int] = set()
                for k in range(len(ranks) - 1, -1, -1):
                    if (g := ranks[k] % GROUPS) not in done:
                        done.add(g)
                        out.append((g, ranks[: k + 1], at[subject], weight))
            yield pd.DataFrame(out, columns=["part", "ranks", "subject", "weight"])

    def grown(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = PrefixTree(width)
        same: dict[tuple[int, ...], list[float]] = {}
        for ranks, s, w in zip(pdf["ranks"], pdf["subject"], pdf["weight"], strict=True):
            same.setdefault(tuple(ranks.tolist()), [0.0] * width)[s] += w
        for ranks in sorted(same):
            tree.add(ranks, same[ranks])
        found = [(list(p), s, c) for p, s, c in tree.grow({r for r in tree.places if r % GROUPS == key[0]}, wanted, least)]
        return pd.DataFrame(found, columns=["ranks", "subject", "confidence"])

    sent = rows.select("terms", "subject", "weight").mapInPandas(prefixes, "part int, ranks array<int>, subject int, weight double")
    found = sent.groupBy("part").applyInPandas(grown, "ranks array<int>, subject int, confidence double").toPandas()
    # a part may end in another group's term: what is redundant is told when all groups are together, shorter rules first
    held: dict[tuple[frozenset[int], int], float] = {}
    for ranks, s, c in sorted(zip(found["ranks"].map(tuple), found["subject"].tolist(), found["confidence"].tolist(), strict=True), key=lambda x: (len(x[0]), x)):
        whole = frozenset(ranks)
        parts = [whole - {r} for r in ranks] + [frozenset([r]) for r in ranks] if len(ranks) > 1 else []
        if all(held.get((p, s), 0.0) <= c - GAIN for p in parts):
            held[whole, s] = c
            rules.add(tuple(names[k] for k in ranks), s, c)
    return rules


def clean_labels(labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject): labels in the spelling of ``areas``; others are dropped, repeated ones are one."""
    known = areas.select("subject", F.lower(F.trim("subject")).alias("key")).distinct()
    return labels.select("doc_id", F.lower(F.trim("subject")).alias("key")).join(F.broadcast(known), "key").select("doc_id", "subject").distinct()


def _sentences_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms = [], []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for a, b in split(t):
                    ids.append(i)
                    terms.append(sorted(set(terms_of(plain_text(t[a:b])))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.list_(pa.string()))], ["doc_id", "terms"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, terms array<string>")


def score(docs: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, subject, share, confidence) of every subject that some sentence of a text deals with. A map without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                out += [(i, rules.subjects[s], share, c) for s, (share, c) in sorted(rules.shares(t).items())]
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "subject", "share", "confidence"])

    picked = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    return picked.mapInArrow(run, "doc_id bigint, subject string, share double, confidence double")


def fit(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> Rules:
    """Rules mined from a bounded sample: ``LABELLED_TEXTS`` labelled texts and ``OTHER_TEXTS`` others, each those of least id digest.

    The labels of one text share its weight. Without labels there are no rules.
    """
    subjects = sorted(r.subject for r in areas.select("subject").distinct().collect())
    own = clean_labels(labels, areas)
    own = stored(own.join(own.groupBy("doc_id").agg((1.0 / F.count("*")).alias("weight")), "doc_id"))
    texts = docs.select("doc_id", "text").where((F.length("text") >= 20) & (F.length("text") <= MINED_CHARS))
    # the sample is chosen by ids alone; only its texts are then moved
    ids = texts.select("doc_id").join(own.select("doc_id").distinct().withColumn("known", F.lit(True)), "doc_id", "left")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [ids.where(c).orderBy(*order).limit(n).select("doc_id") for c, n in (("known", LABELLED_TEXTS), ("known IS NULL", OTHER_TEXTS))]
    chosen = stored(chosen[0].unionByName(chosen[1]).distinct())
    sample = stored(texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]))
    sentences = stored(_sentences_of(spread(sample)))
    classes = own.join(F.broadcast(chosen), "doc_id")
    for wanted, least in ROUNDS[:-1]:
        rules = mine(sentences, classes, subjects, wanted, least)
        # texts that mostly deal with one subject, by the rules so far
        main = score(spread(sample), rules).where("share >= 0.4").groupBy("doc_id").agg(F.max_by("subject", F.struct("share", "subject")).alias("subject"))
        classes = stored(main.withColumn("weight", F.lit(1.0)))
    return mine(sentences, classes, subjects, *ROUNDS[-1])
