"""Languages of documents and of their passages (problem 4).

Discrimination is hierarchical: the script of a sentence's letters gives its
family, and one-versus-one linear support vector machines over hashed
character n-grams tell the languages of a family apart. The machines are
fitted on the driver from a bounded sample of labelled rows; sentences that
contradict their label in an earlier fit, as wrong labels and mixed texts do,
are left out of the next. Classification is a map over whole texts: every sentence
gives evidence for its language that grows with its letters, and the best path
over a text's sentences (Viterbi, with a cost for each change of language)
decides short ones together with their neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lookalike import INVISIBLE, same_form
from .sentences import split

#: Languages by family.
FAMILIES = {"han": ("zh", "ja"), "latin": ("en", "de", "fr", "es", "pt"), "cyrillic": ("ru",), "thai": ("th",)}
LANGUAGES = tuple(sorted(c for f in FAMILIES.values() for c in f))
#: Labels that say nothing.
NO_LABEL = ("", "und", "unknown")
#: Labelled rows per language that the machines are fitted on, and the longest text among them.
SAMPLE_ROWS, SAMPLE_CHARS = 150, 4000
#: Sentences per language among them.
SAMPLE_SENTENCES = 500
#: Cost of a change of language between two sentences in log-odds, and the letters at which half of a machine's margin counts.
CHANGE, HALF = 0.35, 25.0
#: Log-odds that each letter of a script (less those of others) gives for a language of that script.
LETTER_ODDS = 0.5
_WORDS = re.compile(r"[^\W\d_]+")
_DIMS = 1 << 13
_BASE = np.uint32(0x01000193)

# fixed values: common words that stand in where a language has no labelled rows
COMMON_WORDS = {
    "en": "the of and to in is was for that with from which by as at this are were be have not under between",
    "de": "der die und den von zu mit das sich des auf für ist im dem nicht ein eine als auch wurde zwischen unter",
    "fr": "le la les de des et en un une du dans est que pour qui par sur au avec sont ne pas été entre selon",
    "es": "el la los las de del y en un una que es por con para se no su al como fue entre según más lo",
    "pt": "o a os as de do da e em um uma que é por com para se não no na dos das como foi entre segundo mais",
    "zh": "的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过",
    "ja": "のにはをたがでとしてれさあるいるもするからなことなっこのそのという本研究では",
}

_NAMES = ("latin", "cyrillic", "thai", "han")
_RANGES = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)),
    "cyrillic": ((0x400, 0x4FF),),
    "thai": ((0xE01, 0xE4E),),
    "han": ((0x3041, 0x30FF), (0x3400, 0x9FFF), (0xFF66, 0xFF9F), (0x2F00, 0x2FD5), (0x3005, 0x3005)),
}
#: How much text a letter carries, in Latin letters.
_WEIGHT = np.array([1.0, 1.0, 1.0, 2.5])
_PLAIN: list[np.ndarray] = []  # built once per process: script and plain lower-case letter of each BMP character


def _tables() -> list[np.ndarray]:
    if not _PLAIN:
        script = np.full(1 << 16, len(_NAMES), np.uint8)
        for k, name in enumerate(_NAMES):
            for low, high in _RANGES[name]:
                script[low : high + 1] = k
        letter = np.full(1 << 16, 32, np.uint32)
        for c in range(1 << 16):
            sign = chr(c)
            if sign.isalpha() or 0x300 <= c < 0x370 or 0xE31 <= c <= 0xE4E:
                form = (same_form(sign) or sign).lower()
                letter[c] = ord(form[0]) if len(form) == 1 and ord(form) < 1 << 16 else c
            elif INVISIBLE.match(sign):
                letter[c] = 0
        _PLAIN.extend([script, letter])
    return _PLAIN


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters of all texts, text of each); what lies beyond the BMP is a blank."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 1 << 16, codes, 32), np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def families(texts: list[str]) -> list[tuple[str | None, float, float]]:
    """(family of most letters, its letters weighed by the text they carry, its share of all letters) of each text; no texts, no result."""
    if not texts:
        return []
    codes, owner = _codes(texts)
    script = _tables()[0][codes]
    counts = np.bincount(owner * (len(_NAMES) + 1) + script, minlength=len(texts) * (len(_NAMES) + 1)).reshape(len(texts), -1)[:, :-1]
    weight = counts * _WEIGHT
    total = weight.sum(1)
    top = weight.argmax(1)
    rows = np.arange(len(texts))
    share = weight[rows, top] / np.maximum(total, 1)
    most = weight[rows, top]
    return [(_NAMES[t] if n else None, n, s) for t, n, s in zip(top.tolist(), most.tolist(), share.tolist(), strict=True)]


def features(texts: list[str], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams of all texts, text of each): n = 1 .. longest, runs of other signs as one blank."""
    codes, owner = _codes(texts)
    plain = _tables()[1][codes]
    keep = plain > 0
    plain, owner = plain[keep], owner[keep]
    keep = np.concatenate([[True], (plain[1:] != 32) | (plain[:-1] != 32) | (owner[1:] != owner[:-1])])[: len(plain)]
    plain, owner = plain[keep], owner[keep]
    grams, owners = [], []
    h = np.zeros(len(plain), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(longest):
            whole = len(plain) - n
            if whole <= 0:
                break
            h = (h[:whole] ^ plain[n:]) * _BASE + np.uint32(n)
            inside = owner[:whole] == owner[n:]
            mixed = (h ^ (h >> np.uint32(15))) & np.uint32(_DIMS - 1)
            grams.append(mixed[inside])
            owners.append(owner[:whole][inside])
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(grams).astype(np.int64), np.concatenate(owners)


def _matrix(texts: list[str], longest: int) -> np.ndarray:
    grams, owners = features(texts, longest)
    x = np.zeros((len(texts), _DIMS), np.float32)
    np.add.at(x, (owners, grams), 1)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def fit_machine(x: np.ndarray, y: np.ndarray, rounds: int = 150, cost: float = 20.0) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge loss, accelerated descent); the last one is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * cost
    w = np.zeros(x.shape[1], np.float32)
    ahead, rate = w.copy(), 1 / (1 + 4 * cost)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (ahead - 2 * ((share * slack * y) @ x))
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


def _borne_out(text: str, label: str, members: tuple[str, ...]) -> bool:
    words = set(text) if label in FAMILIES["han"] else set(_WORDS.findall(text.lower()))
    hits = {c: len(words & (set(COMMON_WORDS[c]) if c in FAMILIES["han"] else set(COMMON_WORDS[c].split()))) for c in members}
    return hits[label] > 0 and hits[label] == max(hits.values())


class Machines:
    """One-versus-one machines of each family with several languages."""

    def __init__(self, texts: list[str], labels: list[str]):
        self.weights: dict[str, tuple[list[tuple[int, int]], np.ndarray, int]] = {}
        for name, members in FAMILIES.items():
            if len(members) < 2:
                continue
            longest = 4 if name == "latin" else 2
            own = [(t, c) for t, c in zip(texts, labels, strict=True) if c in members]
            for c in members:
                words = COMMON_WORDS[c]
                own += [(words if name == "han" else " ".join(words.split()[k : k + 12]), c) for k in (0, 6, 12)]
            x = _matrix([t for t, _ in own], longest)
            y = np.array([members.index(c) for _, c in own])
            common = np.arange(len(y)) >= len(y) - 3 * len(members)
            # first by common words: a sentence bears out its label if no other language has more of them
            keep = common | np.array([_borne_out(t, c, members) for t, c in own])
            for _ in range(2):
                self.weights[name] = self._fit(x[keep], y[keep], members, longest)
                keep = common | (self._decide(name, x @ self.weights[name][1][:-1] + self.weights[name][1][-1])[0] == y)

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, members: tuple[str, ...], longest: int) -> tuple[list[tuple[int, int]], np.ndarray, int]:
        pairs = list(combinations(range(len(members)), 2))
        w = [fit_machine(x[(y == a) | (y == b)], np.where(y[(y == a) | (y == b)] == a, 1, -1).astype(np.float32)) for a, b in pairs]
        return pairs, np.stack(w, 1), longest

    def _decide(self, name: str, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language with most votes, least margin by which it won its votes)."""
        pairs, members = self.weights[name][0], FAMILIES[name]
        votes = np.zeros((len(scores), len(members)))
        for k, (a, b) in enumerate(pairs):
            votes[:, a] += (scores[:, k] > 0) + np.tanh(scores[:, k]) / 100
            votes[:, b] += (scores[:, k] <= 0) - np.tanh(scores[:, k]) / 100
        top = votes.argmax(1)
        margin = np.full(len(scores), np.inf)
        for k, (a, b) in enumerate(pairs):
            margin = np.where(top == a, np.minimum(margin, scores[:, k]), np.where(top == b, np.minimum(margin, -scores[:, k]), margin))
        return top, margin

    def languages(self, name: str, texts: list[str]) -> list[tuple[str, float]]:
        """(language, log-odds against the next one) of texts of one family; infinite in a family of one."""
        members = FAMILIES[name]
        if len(members) == 1 or not texts:
            return [(members[0], np.inf)] * len(texts)
        _, weights, longest = self.weights[name]
        grams, owners = features(texts, longest)
        # counts over the root of their number, as in the fit; sums of one column at a time stay in the cache
        scores = np.stack([np.bincount(owners, weights=w[grams], minlength=len(texts)) for w in weights[:-1].T.copy()], 1)
        scores = scores / np.sqrt(np.maximum(np.bincount(owners, minlength=len(texts)), 1))[:, None] + weights[-1]
        top, margin = self._decide(name, scores)
        return [(members[t], float(c)) for t, c in zip(top, 4 * np.clip(margin, 0, 5), strict=True)]


def plain_label(label: str | None) -> str | None:
    """The language a label names: lower case, without region; null where it names none."""
    code = re.split("[-_]", (label or "").strip().lower())[0]
    return None if code in NO_LABEL else code


def fit(labelled: DataFrame, label: str, text: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Machines:
    """Machines fitted on at most ``rows`` labelled texts per language of at most ``chars`` characters each.

    The sample is the rows of least text digest, so it does not depend on file order. An
    empty or unlabelled table leaves the common words alone to learn from.
    """
    code = F.lower(F.regexp_extract(F.trim(label), "^[A-Za-z]+", 0))
    picked = labelled.select(code.alias("code"), F.col(text).alias("text"))
    picked = picked.where(F.col("code").isin(*LANGUAGES) & (F.length("text") <= chars) & (F.length("text") >= 40))
    picked = picked.withColumn("digest", F.xxhash64("text"))
    order = Window.partitionBy("code").orderBy("digest", "text")
    sample = picked.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= rows).select("code", "digest", "text").distinct().collect()
    texts, labels = [], []
    kept = dict.fromkeys(LANGUAGES, 0)
    # in order of digest, so that the sentences are a sample too; each language weighs the same in a machine, and very many add nothing
    for r in sorted(sample, key=lambda r: (r.code, r.digest, r.text)):
        cut = [r.text[a:b] for a, b in split(r.text)]
        for t, (name, _, _) in zip(cut, families(cut), strict=True):
            if name and r.code in FAMILIES[name] and kept[r.code] < SAMPLE_SENTENCES:
                kept[r.code] += 1
                texts.append(t)
                labels.append(r.code)
    return Machines(texts, labels)


_SCHEMA = "tab string, rec_id string, label string, extent string, lang string, confidence double, start_pos int, end_pos int"


_FAMILY = {c: name for name, members in FAMILIES.items() for c in members}


def _spans(machines: Machines, texts: list[str]) -> Iterator[list[tuple[str, int, int, float, float]]]:
    """Per text: (language, start, end, log-odds within its family, log-odds against other families) of each sentence with a letter."""
    cuts = [[(a, b, t[a:b]) for a, b in split(t)] for t in texts]
    of: dict[str, list[tuple[int, int]]] = {}
    seen: dict[tuple[int, int], tuple[float, float]] = {}
    places = [(i, k) for i, c in enumerate(cuts) for k in range(len(c))]
    for at, (name, n, share) in zip(places, families([cuts[i][k][2] for i, k in places]), strict=True):
        if name:
            of.setdefault(name, []).append(at)
            seen[at] = (n, LETTER_ODDS * n * (2 * share - 1))
    said: dict[tuple[int, int], tuple[str, float]] = {}
    for name, where in of.items():
        for at, (lang, odds) in zip(where, machines.languages(name, [cuts[i][k][2] for i, k in where]), strict=True):
            said[at] = lang, odds * (seen[at][0] ** 2 / (seen[at][0] ** 2 + HALF**2))
    for i, c in enumerate(cuts):
        yield [(said[i, k][0], a, b, said[i, k][1], max(0.0, seen[i, k][1])) for k, (a, b, _) in enumerate(c) if (i, k) in said]


def best_path(spans: list[tuple[str, int, int, float, float]], change: float = CHANGE) -> list[str]:
    """The languages of a text's sentences that cost least: what a sentence's evidence loses, and ``change`` for each change of language.

    The first sentence may have any language. Ties go to the earlier language in the alphabet.
    """
    states = sorted({s[0] for s in spans})
    if len(states) < 2:
        return [s[0] for s in spans]
    cost, back = dict.fromkeys(states, 0.0), []
    for lang, _, _, inside, outside in spans:
        cheapest = min(states, key=cost.__getitem__)
        came = {c: c if cost[c] <= cost[cheapest] + change else cheapest for c in states}
        back.append(came)
        lost = {c: 0.0 if c == lang else inside if _FAMILY[c] == _FAMILY[lang] else outside for c in states}
        cost = {c: cost[came[c]] + (change if came[c] != c else 0.0) + lost[c] for c in states}
    now = min(states, key=cost.__getitem__)
    path = []
    for came in reversed(back):
        path.append(now)
        now = came[now]
    return path[::-1]


def identify(records: DataFrame, machines: Machines) -> DataFrame:
    """Languages of ``records`` (tab, rec_id, label, text).

    One row with extent ``main`` per record: the language most characters are
    written in. One row with extent ``segment`` per run of sentences in another
    language, with its offsets. A short sentence is a segment where its
    evidence outweighs the changes of language around it. The confidence is
    the mean probability of the row's sentences by characters; a sentence
    that goes with its neighbours against its own evidence counts one half. Null
    and blank texts, and texts without letters, give no row.
    """

    def sure(own: bool, odds: float) -> float:
        return 1 / (1 + float(np.exp(-min(odds, 30.0)))) if own else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                out: list[dict] = []
                for r, spans in zip(part, _spans(machines, [r["text"] for r in part]), strict=True):
                    if not spans:
                        continue
                    path = best_path(spans)
                    chars: dict[str, int] = {}
                    for lang, (_, a, b, _, _) in zip(path, spans, strict=True):
                        chars[lang] = chars.get(lang, 0) + b - a
                    main = max(sorted(chars), key=chars.__getitem__)
                    head = {k: r[k] for k in ("tab", "rec_id", "label")}
                    now = None
                    runs: list[list] = []  # [language, start, end, characters, sum of their probabilities]; the main one first
                    all_ = [main, spans[0][1], spans[-1][2], 0, 0.0]
                    for lang, (own, a, b, inside, outside) in zip(path, spans, strict=True):
                        if lang != main and lang != now:
                            runs.append([lang, a, b, 0, 0.0])
                        held = all_ if lang == main else runs[-1]
                        held[2] = max(held[2], b)
                        held[3] += b - a
                        held[4] += (b - a) * sure(lang == own, min(inside, outside))
                        now = lang
                    for k, (lang, a, b, n, p) in enumerate([all_, *runs]):
                        out.append(head | {"extent": "segment" if k else "main", "lang": lang, "confidence": p / n, "start_pos": a, "end_pos": b})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    picked = records.select("tab", "rec_id", "label", "text").where(F.col("text").isNotNull())
    return picked.mapInArrow(run, _SCHEMA)


_ARROW = pa.schema(
    [("tab", pa.string()), ("rec_id", pa.string()), ("label", pa.string()), ("extent", pa.string()), ("lang", pa.string())]
    + [("confidence", pa.float64()), ("start_pos", pa.int32()), ("end_pos", pa.int32())]
)


def wrong_or_further(found: DataFrame) -> DataFrame:
    """(tab, rec_id, lang, extent) of missing or wrong labels, and of every further language of a record."""
    code = F.lower(F.element_at(F.split(F.trim("label"), "[-_]"), 1))
    wrong = F.col("label").isNull() | code.isin(*NO_LABEL) | (code != F.col("lang"))
    return found.where((F.col("extent") == "segment") | wrong).select("tab", "rec_id", "lang", "extent").distinct()


REPORT = "plagiarism STRUCT<sent_results: ARRAY<STRUCT<text: STRING>>>"


def records(library: DataFrame, checks: DataFrame) -> DataFrame:
    """(tab, rec_id, label, text): library texts, and the texts submitted in reports.

    A report's text is its sentences in order; an unreadable report has none.
    """
    docs = library.select(F.lit("library_docs").alias("tab"), F.col("id").cast("string").alias("rec_id"), F.col("lang").alias("label"), F.col("content").alias("text"))
    said = F.from_json("report", REPORT)["plagiarism"]["sent_results"]
    text = F.array_join(F.transform(said, lambda s: s["text"]), " ")
    sent = checks.select(F.lit("checks").alias("tab"), F.col("id").alias("rec_id"), F.col("language").alias("label"), text.alias("text"))
    return docs.unionByName(sent).where(F.col("text").isNotNull())
