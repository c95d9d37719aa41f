"""Sentence boundaries across languages and scripts (problem 3).

A text is read as a lattice: its gaps are nodes, the stretches between them are
arcs. A gap has log-odds of a boundary; an arc costs what it is longer than a
sentence usually is. The best path through the lattice gives the sentences.

In spaced scripts the gaps are terminators, closing quotes and line breaks, and
their odds come from the terminator and its neighbourhood: abbreviations,
initials, ordinals, the case of the next word. Scripts without spaces are
segmented by a word lattice over a dictionary of particles, conjunctions and
openers; gaps are classified by the last word before them and the first behind
them, whose log-odds are counted in the texts (``fit_words``): how often a word
stands at a sure boundary against elsewhere. There a gap is possible between
any two words, marked or not; one without a mark has to outweigh ``UNMARKED``,
by strong words or by a stretch that is too long to be one sentence. Nothing
inside a quotation or bracket is cut. Offsets refer to the stored text:
invisible characters and width or look-alike variants are mapped one to one, or
dropped with their places remembered.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalike import INVISIBLE, LOOK_ALIKES

_ONE_TO_ONE = (
    {ord(a): b for a, b in LOOK_ALIKES.items()}
    | {c: chr(c - 0xFEE0) for c in range(0xFF02, 0xFF5F) if c != 0xFF1F}
    | {c: " " for c in (9, 11, 12, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}
    | {c: "\n" for c in (13, 0x85, 0x2028, 0x2029)}
    | {0xFF61: "。", 0xFF62: "「", 0xFF63: "」", 0x2025: "…"}
)


#: Variants that matter for boundaries; texts without them are read as they are.
_VARIANT = re.compile(r"[\t\x0b\x0c\r\u0085\u00a0\u1680\u2000-\u200a\u2025\u2028\u2029\u202f\u205f\u3000\uff04-\uff09\uff0e-\uff19\uff21-\uff5d\uff61-\uff63]")


def _fold(words: str) -> frozenset[str]:
    return frozenset(w.casefold().translate(_ONE_TO_ONE) for w in words.split())


# fixed values: abbreviations that do not end a sentence
ABBREVIATIONS = _fold(
    "dr dra prof mr mrs ms st sr sra jr mme mlle al cf vs approx aprox env ca circa e.g i.e eg ie viz resp ltd inc co corp u.n u.s a.m p.m "
    "z.b d.h u.a o.ä bzw vgl evtl ggf sog inkl zzgl hrsg p.ej ej p.ex ex см рис напр т.е т.к т.н др тр прим проф акад им гг г ул тыс млн"
)
#: Abbreviations only before a number.
NUMBER_ABBREVIATIONS = _fold("no nos nr nº n.º n° núm num fig figs abb tab p pp pág págs s str vol bd ch kap eq sec sect art стр табл п гл ст")
#: Abbreviations that may also close a sentence.
MAY_END = _fold("etc usw u.s.w т.д т.п")
MONTHS = _fold("januar februar märz april mai juni juli august september oktober november dezember")
ORDINAL_CUES = _fold("am vom der dem zum bis den im das die")
#: Words that open or close no heading.
FUNCTION_WORDS = _fold(
    "a an the in at from both after what of to and or for by with on as according is was were that which before during until between "
    "der die das den dem in im am an auf aus bei für mit nach von vor zwischen laut ist sind war kann und oder wie ob wurde "
    "le la les l un une des de du d en dans à au aux après avant selon entre pour sur par il nous est ce que qui et ou "
    "el los las del al según después antes entre para por con un una y o que es en estudiamos "
    "o os as da do das dos em no na nos nas depois antes segundo entre para por com um uma e ou que é será "
    "в во на по с со к из от до через после перед для при о об и или что как не это за"
)
# fixed values: dictionary of the word lattice for scripts without spaces
FINAL_PARTICLES = frozenset(
    "了 吗 呢 吧 啊 呀 嘛 哦 啦 呗 罢了 而已 似的 来着 为止 与否 没有 "
    "た だ です ます である だった であった ました でした ない ません か ね よ わ ぞ だろう でしょう のだ のである ください らしい ようだ "
    "ครับ ค่ะ คะ นะ แล้ว ด้วย เลย หรือไม่ ไหม เท่านั้น นั้น นี้".split()
)
CONTINUING = frozenset(
    "但 但是 而 而且 却 因为 所以 并 并且 以及 和 与 或 或者 及 的 地 得 之 随后 之后 "
    "と って が けれど けど けれども ので から し に を は も の で て へ や より まで など という "
    "และ แต่ หรือ ที่ ซึ่ง โดย เพราะ ว่า ของ กับ ให้ เป็น ๆ ฯ".split()
)
OPENING = frozenset(
    "然而 此外 因此 另外 首先 其次 最后 总之 同时 不过 于是 接着 例如 比如 其中 尽管 虽然 如果 由于 为了 根据 按照 结果 本文 本研究 我们 他们 在 从 对于 关于 当 目前 近年来 事实上 换言之 综上所述 "
    "しかし また さらに そして なお ただし したがって 一方 例えば つまり そこで まず 次に 最後に このため その後 本研究 本稿 これ それ 我々 私たち もし "
    "อย่างไรก็ตาม นอกจากนี้ ดังนั้น จากนั้น ต่อมา เมื่อ ระหว่าง หลังจาก ในขณะที่ ผลการ การศึกษา งานวิจัย ทั้งนี้ สำหรับ เนื่องจาก ถ้า หาก แม้ เขา เรา ใน จาก ตาม".split()
)
_DICTIONARY = FINAL_PARTICLES | CONTINUING | OPENING

#: Log-odds of a boundary between two words without a mark, before the words are looked at.
UNMARKED = -6.0
#: Characters that a sentence is hardly longer than (Chinese and Japanese, Thai, spaced scripts), and the cost of each further one.
LONG, LONG_THAI, LONG_SPACED, LENGTH_COST = 120, 200, 600, 0.1
#: Greatest log-odds of one word, and the occurrences at which half of them is counted, half assumed.
WORD_ODDS, HALF_KNOWN = 6.0, 10.0

_OPEN = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")）", "（": ")）", "[": "]", '"': '"', "《": "》", "【": "】"}
_MARKS = re.compile("[“”„«»「」『』()（）\\[\\]\"《》【】]|\n[ \n]*\n")
_CLOSERS = "”“»」』)）]\"’'》】"
_ENDS = r"(?:\.(?![0-9a-z])|[!?。！？…])[.!?。！？…]*|\n[ \n]*"
_GAP, _GAP_OR_BLANK = re.compile(_ENDS), re.compile(_ENDS + "| +")
_SPACELESS = re.compile("[฀-๿぀-ヿ㐀-鿿]")
_THAI = re.compile("[ก-๛]")
_IDEOGRAPHIC, _ASKING = frozenset("。！？"), frozenset("!?")
_WORD = re.compile(r"[^\W_]")
_TOKEN = re.compile(r"[^\s(\[{“„«\"]+$")
_NUMBERED = re.compile(r"(\d+(\.\d+)*\.?|[A-Za-z]\.|[IVX]+\.) +(?=\S)|[一二三四五六七八九十]+、|第[一二三四五六七八九十\d]+[章节]")
_DOTTED = re.compile(r"([^\W\d_]\.)+[^\W\d_]")
_CODE = re.compile(r"\d|[A-Z]{2,}-?\d")


def shadow(text: str) -> tuple[str, list[int] | None]:
    """(text with plain characters, places of its characters in ``text`` or None where they are the same)."""
    if text.isascii():
        return text, None
    places = None
    if INVISIBLE.search(text):
        places = [i for i, c in enumerate(text) if not INVISIBLE.match(c)]
        text = "".join([text[i] for i in places])
    return (text.translate(_ONE_TO_ONE) if _VARIANT.search(text) else text), places


class Words:
    """Log-odds of a boundary behind and before each dictionary word; assumed where nothing is counted."""

    def __init__(self, counts: dict[str, tuple[int, int, int]] | None = None, sentences: int = 0, chars: int = 0):
        """``counts`` has (occurrences, sentences ended, sentences begun) by word."""
        self.final = {w: 2.0 if w in FINAL_PARTICLES else 0.0 for w in _DICTIONARY}
        self.opening = {w: 3.0 if w in OPENING else -3.0 if w in CONTINUING else 0.0 for w in _DICTIONARY}
        gaps = max(1.0, chars / 3)  # about one word in three characters
        for w, (n, ended, begun) in (counts or {}).items():
            known = n / (n + HALF_KNOWN)
            for table, k in ((self.final, ended), (self.opening, begun)):
                odds = math.log((k + 0.5) / (sentences + 1)) - math.log((n - k + 0.5) / (gaps + 1))
                table[w] = known * max(-WORD_ODDS, min(WORD_ODDS, odds)) + (1 - known) * table[w]


PLAIN_WORDS = Words()
_AUTOMATON: list = []  # built once per process


def lattice_words(s: str) -> list[tuple[int, int]]:
    """(start, end) of the dictionary words on the best path through the word lattice of all spaceless runs of ``s``.

    A word costs one, a character outside the dictionary two. All words that
    occur come from one pass of an automaton; only their ends are nodes, as
    characters outside the dictionary only carry the best node so far along.
    """
    if not _AUTOMATON:
        a = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for w in _DICTIONARY:
            a.add_word(w)
        a.make_automaton()
        _AUTOMATON.append(a)
    ends, costs, nodes = [0], [0], [(0, -1)]  # nodes that are better than all before: end, cost less two per character, (start, node before)
    for last, size in _AUTOMATON[0].iter(s):
        end = last + 1
        start = end - size
        at = bisect_right(ends, start) - 1
        cost = costs[at] + 1 - 2 * size
        if cost < costs[-1]:
            if ends[-1] == end:
                costs[-1], nodes[-1] = cost, (start, at)
            else:
                ends.append(end)
                costs.append(cost)
                nodes.append((start, at))
    words, at = [], len(ends) - 1
    while at > 0:
        start, before = nodes[at]
        words.append((start, ends[at]))
        at = before
    return words[::-1]


class Lattice:
    """The words of a text by their ends and starts, and what they say about a gap."""

    def __init__(self, s: str, words: Words):
        self.spaceless = bool(_SPACELESS.search(s))
        self.path = lattice_words(s) if self.spaceless else []
        self.words = words
        self.ends = {b: s[a:b] for a, b in self.path}
        self.starts = {a: s[a:b] for a, b in self.path}

    def opening(self, at: int) -> float:
        return self.words.opening[self.starts[at]] if at in self.starts else 0.0

    def odds(self, left: int, right: int) -> float:
        return (self.words.final[self.ends[left]] if left in self.ends else 0.0) + self.opening(right)


def _protected(s: str) -> list[tuple[int, int]]:
    """Closed quotations and brackets as (place of the opening mark, place of the closing one), outermost only, in order."""
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    for m in _MARKS.finditer(s):
        c, at = m.group(), m.start()
        if c[0] == "\n":
            stack.clear()
            continue
        back = next((k for k in range(len(stack) - 1, -1, -1) if c in _OPEN[stack[k][0]]), None)
        if back is not None and not (c == "“" and stack[back][0] != "„"):
            spans.append((stack[back][1], at))
            del stack[back:]
        elif c in _OPEN and (c != '"' or at == 0 or not s[at - 1].isalnum() or _SPACELESS.match(s[at - 1])):
            stack.append((c, at))
    spans.sort()
    outer: list[tuple[int, int]] = []
    for a, b in spans:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def _line(s: str, begin: int) -> str:
    end = s.find("\n", begin)
    return s[begin : end if end >= 0 else len(s)].strip()


def _heading(s: str, begin: int) -> bool:
    """Whether the line at ``begin``, where a sentence may start, is a heading on its own line."""
    end = s.find("\n", begin)
    if end < 0:
        return False
    line = s[begin:end].strip()
    if not 0 < len(line) <= 80 or line[-1] in ".!?。！？…:;,、；：，" or not _WORD.search(line):
        return False
    number = _NUMBERED.match(line)
    rest = line[number.end() :] if number else line
    if not rest or any(c in rest for c in '“”„«»「」",，。!?！？') or re.search(r"\d|[.!?]", rest):
        return False
    spaceless = _SPACELESS.search(rest)
    if number:
        return len(rest) <= (20 if spaceless else 60)
    after = s[end:].lstrip()[:8]
    if spaceless:
        return len(rest) <= 12
    words = rest.casefold().translate(_ONE_TO_ONE).split()
    if len(words) > 6 or _case(rest, 0) not in ("upper", "caps") or words[0] in FUNCTION_WORDS or words[-1] in FUNCTION_WORDS:
        return False
    return bool(after) and _case(after, 0) != "lower" and not _CODE.match(after)


def _case(s: str, at: int) -> str:
    """How the word at ``at`` starts: upper (also an opening mark, or a word of turned-round case), lower, caps, digit or other."""
    if s[at] in "“„«\"¿¡「『":
        return "upper"
    word = re.match(r"[^\W\d_]+", s[at : at + 16])
    if not word:
        return "digit" if s[at].isdigit() else "other"
    word = word.group()
    if word[0].islower():
        return "upper" if len(word) > 1 and word[1:].isupper() else "lower"
    return "caps" if len(word) > 1 and word.isupper() and s[at + len(word) : at + len(word) + 1] != "-" else "upper" if word[0].isupper() else "other"


def _terminator_odds(s: str, begin: int, end: int, close: int, next_at: int, line_start: int, lattice: Lattice) -> float:
    """Log-odds that the terminators s[begin:end], with closing marks up to ``close``, end a sentence; s[next_at] is the next character."""
    if next_at >= len(s):
        return 20
    run, ahead = s[begin:end], s[next_at]
    parted = next_at > close
    plain = run == "."
    if not plain and not _IDEOGRAPHIC.isdisjoint(run):
        return 8 + lattice.odds(begin, next_at) / 2 if ahead not in "，,、" else -12
    if ahead in ",;:—–-，、；：%/)]":
        return -12
    before = s[begin - 1] if begin else ""
    # most texts hold no spaceless run at all
    cjk = (not plain or not parted) and lattice.spaceless and bool(_SPACELESS.match(ahead) or _SPACELESS.search(s, max(0, begin - 12), begin))
    if not plain and (run[0] == "…" or "..." in run or "…" in run):
        if ahead.islower():
            return -8
        word = re.match(r"\w+", s[next_at : next_at + 20])
        if word and word.group().casefold() in ("but", "and", "or", "mais", "et", "pero", "y", "mas", "e", "aber", "und", "но", "и"):
            return -8
        return 1.5 + (((lattice.odds(begin, next_at) + lattice.opening(next_at)) / 2 if ahead != "—" else -6) if cjk else 1)
    asks = not plain and not _ASKING.isdisjoint(run)
    if cjk and asks and (not parted or _SPACELESS.match(before)) and not ahead.islower():
        return 6 + lattice.odds(begin, next_at) / 2
    case = _case(s, next_at)
    if not parted and close == end:
        # no room behind the mark: decimals, codes, dotted abbreviations; or a blank that was lost between two sentences
        if cjk and _SPACELESS.match(ahead) and not before.isdigit():
            return 3
        if case != "upper" or not (s[next_at + 1 : next_at + 2].islower() or ahead in "“„«¿¡") or not re.search(r"\d|\w{3}", s[max(0, begin - 3) : begin]):
            return -12
    odds = 3.0 if asks else 1.0
    odds += {"lower": -9, "upper": 3, "caps": 2, "digit": 2}.get(case, 2 if _SPACELESS.match(ahead) else 1)
    if not plain or close > end:
        return odds
    token = _TOKEN.search(s, max(line_start, begin - 24), begin)
    token = token.group().casefold() if token else ""
    if not token.isascii():
        token = token.translate(_ONE_TO_ONE)
    if not token:
        return odds
    if begin - line_start < 24 and _NUMBERED.fullmatch(s[line_start : begin + 2].lstrip()[: begin + 2 - line_start]) and s[line_start:begin].strip() == s[line_start : begin].strip().split(" ")[0]:
        return -12  # the number of a heading or list item
    if token in MAY_END:
        odds -= 1
    elif token in ABBREVIATIONS or (token in NUMBER_ABBREVIATIONS and (ahead.isdigit() or ahead == "(")):
        odds -= 9
    elif len(token) == 1 and token.isalpha() and not _SPACELESS.match(token):
        odds -= 5  # an initial, or a letter of a dotted abbreviation
    elif _DOTTED.fullmatch(token):
        odds -= 5
    elif token.isdigit() and len(token) <= 2:
        word = re.match(r"\w+", s[next_at : next_at + 12])
        cue = re.search(r"(\w+)\s+$", s[max(0, begin - len(token) - 8) : begin - len(token)])
        if word and word.group().casefold() in MONTHS or cue and cue.group(1).casefold() in ORDINAL_CUES:
            odds -= 9
    return odds


def _gaps(s: str, spans: list[tuple[int, int]], lattice: Lattice) -> Iterator[tuple[int, int, float]]:
    """(end of the left side, begin of the right side, log-odds of a boundary) of each gap with a mark, a line break or a Thai blank, in order."""
    size, k, line_start, heads = len(s), 0, 0, _heading(s, 0)
    cut_at = 0  # begin of the present sentence, as far as it is certain
    thai = bool(_THAI.search(s))
    last = -1
    for m in (_GAP_OR_BLANK if thai else _GAP).finditer(s):
        begin, end = m.span()
        if begin < last:
            continue
        while k < len(spans) and spans[k][1] < begin:
            k += 1
        inside = k < len(spans) and spans[k][0] < begin
        if m.group()[0] == "\n":
            begins = end
            if begins >= size or inside and s.count("\n", begin, end) < 2:
                line_start = end
                continue
            paragraph = s.count("\n", begin, end) > 1
            was_heading, heads = heads, False
            ended = begin == last or begin == 0
            if not inside and (ended or was_heading or paragraph):
                heads = _heading(s, end)
            piece = s[cut_at:begin]
            if paragraph or was_heading or (heads and ended):
                yield begin, end, 20
                cut_at = end
            elif thai and _THAI.search(piece) and not inside:
                yield begin, end, 6 + lattice.odds(begin, end) / 2
                cut_at = end
                heads = _heading(s, end)
            elif not ended and not inside and _heading(s, end) and s[begin - 1 : begin] in _CLOSERS:
                yield begin, end, 6
                cut_at, heads = end, True
            last, line_start = begin, end
            continue
        if m.group()[0] == " ":
            if thai and not inside and end < size and s[end] != "\n" and _THAI.search(s, cut_at, begin) and not heads:
                yield begin, end, 6 + lattice.odds(begin, end) / 2
                cut_at = end
            continue
        if heads:
            continue  # the marks of a heading's number
        close = end
        quote_from = None
        if inside:
            # the quotation may close right behind the terminator
            inner = spans[k][1]
            if s[end:inner].strip(" ") or inner < end:
                continue
            close, quote_from = inner + 1, spans[k][0]
        while close < size and s[close] in _CLOSERS and not (close < size and any(a == close for a, _ in spans[k : k + 2])):
            close += 1
        next_at = close
        while next_at < size and s[next_at] in " \n":
            next_at += 1
        if quote_from is not None and next_at < size:
            ahead = s[next_at]
            if ahead in ",;:—–-，、；：":
                odds = -12.0
            elif _SPACELESS.match(ahead) and next_at == close:
                whole = not s[cut_at:quote_from].strip()
                odds = (1 if whole else -4) + lattice.opening(next_at)
            else:
                odds = 2.0 if _case(s, next_at) == "upper" and (next_at > close or quote_from == cut_at) else -9.0
        else:
            odds = _terminator_odds(s, begin, end, close, next_at, line_start, lattice)
        yield close, next_at, odds
        if odds > 0:
            cut_at = next_at
        last = close if odds > 0 else last
        if odds > 0 and close < next_at and s[close] == " " and "\n" in s[close:next_at]:
            last = s.index("\n", close)
        elif odds > 0:
            last = close


def _unmarked(s: str, begin: int, end: int, spans: list[tuple[int, int]], lattice: Lattice) -> list[tuple[int, int, float]]:
    """Gaps of a stretch between two characters of words, the right one the start of a dictionary word or the left one the end of one."""
    out, k = [], 0
    for at in sorted({*lattice.starts, *lattice.ends}):
        if not begin < at < end or not (s[at - 1].isalnum() or at in lattice.ends) or not (s[at].isalnum() or at in lattice.starts):
            continue
        while k < len(spans) and spans[k][1] < at:
            k += 1
        if (odds := lattice.odds(at, at)) > 0 and (k == len(spans) or spans[k][0] >= at):
            out.append((at, at, UNMARKED + odds))
    return out


def _most(s: str, begin: int, end: int) -> int:
    """How long a sentence of the script of a stretch hardly is."""
    if s.count(" ", begin, end) * 15 > end - begin or not _SPACELESS.search(s, begin, end):
        return LONG_SPACED
    return LONG_THAI if _THAI.search(s, begin, end) else LONG


def _best_path(gaps: list[tuple[int, int, float]], begin: int, end: int, most: int) -> list[tuple[int, int, float]]:
    """The gaps to cut the stretch from ``begin`` to ``end`` at: the greatest sum of odds less the cost of arcs longer than ``most``.

    Linear in the gaps: predecessors within ``most`` are a sliding maximum, those further off one running maximum.
    """
    value, back = [0.0], [-1]
    at = [begin, *(g[1] for g in gaps)]
    near: deque[int] = deque([0])
    far, far_at, seen = -math.inf, -1, 0
    for k in range(1, len(gaps) + 2):
        left, odds = (gaps[k - 1][0], gaps[k - 1][2]) if k <= len(gaps) else (end, 0.0)
        while at[seen] < left - most and seen < k - 1:
            if value[seen] + LENGTH_COST * at[seen] > far:
                far, far_at = value[seen] + LENGTH_COST * at[seen], seen
            seen += 1
        while near and near[0] < seen:
            near.popleft()
        best, before = (value[near[0]], near[0]) if near else (-math.inf, -1)
        if near and left - at[near[0]] > most:
            best -= LENGTH_COST * (left - at[near[0]] - most)
        if far_at >= 0 and far - LENGTH_COST * (left - most) > best:
            best, before = far - LENGTH_COST * (left - most), far_at
        value.append(best + odds)
        back.append(before)
        if k <= len(gaps):
            while near and value[near[-1]] <= value[k]:
                near.pop()
            near.append(k)
    path, k = [], back[-1]
    while k > 0:
        path.append(gaps[k - 1])
        k = back[k]
    return path[::-1]


def split(text: str | None, words: Words = PLAIN_WORDS) -> list[tuple[int, int]]:
    """Offsets (start, end) of the sentences of ``text``; blank and null texts have none."""
    if not text or text.isspace():
        return []
    s, places = shadow(text)
    spans = _protected(s)
    lattice = Lattice(s, words)
    # gaps at -8 or less are sure to lie inside a sentence
    gaps = [g for g in _gaps(s, spans, lattice) if g[2] > -8]
    cuts: list[tuple[int, int]] = []
    begin = 0

    def cut(chosen: list[tuple[int, int, float]]) -> None:
        # a stretch without a letter or digit is no sentence
        nonlocal begin
        for left, right, _ in chosen:
            if left > begin and _WORD.search(s, begin, left):
                cuts.append((begin, left))
                begin = right

    # gaps with positive odds are on every best path, as a longer arc never costs less; between them only arcs that cost can change it
    sure = [g for g in gaps if g[2] > 0]
    chosen: list[tuple[int, int, float]] = []
    starts = [0, *(g[1] for g in sure)]
    met = sorted(at for at in lattice.starts.keys() & lattice.ends.keys() if lattice.odds(at, at) > -UNMARKED)
    for k, (a, b) in enumerate(zip(starts, [*(g[0] for g in sure), len(s)], strict=True)):
        if b - a > LONG and b - a > (most := _most(s, a, b)) or bisect_right(met, b) > bisect_right(met, a):
            inner = [g for g in gaps if a < g[0] and g[1] < b]
            if lattice.path and (most := _most(s, a, b)) < LONG_SPACED:
                marked = {x for g in inner for x in g[:2]}
                inner = sorted(inner + [g for g in _unmarked(s, a, b, spans, lattice) if g[0] not in marked])
            chosen += _best_path(inner, a, b, _most(s, a, b))
        chosen += sure[k : k + 1]
    cut(chosen)
    if begin < len(s):
        if _WORD.search(s, begin) or not cuts:
            cuts.append((begin, len(s)))
        elif s[begin:].strip():
            cuts[-1] = (cuts[-1][0], len(s))
    out: list[tuple[int, int]] = []
    covered = 0
    for i, (a, b) in enumerate(cuts):
        if places is not None:
            stop = len(text) if i + 1 == len(cuts) else places[cuts[i + 1][0]]
            a, b = (places[a] if a < len(places) else len(text)), places[b - 1] + 1
            # invisible characters belong to what they touch: first to the left side, else to the right
            while b < stop and not text[b].isspace():
                b += 1
            while a > covered and not text[a - 1].isspace():
                a -= 1
            # those that stand alone between blanks go to the left side, or to the first sentence
            rest = text[b:stop]
            if stop < len(text):
                rest = rest[: len(rest) - len(re.search(r"\S*$", rest).group())]
            b += len(rest.rstrip())
            if i == 0:
                a = min(a, len(text) - len(text.lstrip()))
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
            covered = b
    if not out:
        a, b = len(text) - len(text.lstrip()), len(text.rstrip())
        return [(a, b)] if a < b else []
    return out


def word_counts(text: str) -> tuple[dict[str, list[int]], int, int]:
    """({word: [occurrences, sentences ended, sentences begun]}, sentences, characters) of the spaceless sentences of a text, as marks cut them."""
    counts: dict[str, list[int]] = {}
    n = chars = 0
    s, _ = shadow(text)
    if not _SPACELESS.search(s):
        return counts, 0, 0
    path = lattice_words(s)
    for a, b in path:
        counts.setdefault(s[a:b], [0, 0, 0])[0] += 1
    ends, starts = {b: s[a:b] for a, b in path}, {a: s[a:b] for a, b in path}
    for a, b in split(s):
        if _SPACELESS.search(s, a, b):
            n, chars = n + 1, chars + b - a
            while b > a and not s[b - 1].isalnum() and b not in ends:
                b -= 1
            if b in ends:
                counts[ends[b]][1] += 1
            if a in starts:
                counts[starts[a]][2] += 1
    return counts, n, chars


def fit_words(docs: DataFrame, text: str) -> Words:
    """Log-odds of the dictionary's words from counts over all texts; an empty table leaves those assumed.

    The boundaries counted are those that marks, line ends and Thai blanks
    make sure. Counts leave the map summed by word; the result has a row per dictionary word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = {}
        for batch in batches:
            for t in batch.column("text_").to_pylist():
                counts, n, chars = word_counts(t)
                if n:
                    counts[""] = [n, chars, 0]
                for w, c in counts.items():
                    held = total.setdefault(w, [0, 0, 0])
                    for k in range(3):
                        held[k] += c[k]
        rows = [pa.array(list(total), pa.string())] + [pa.array([c[k] for c in total.values()], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays(rows, ["word", "n", "ended", "begun"])

    picked = docs.select(F.col(text).alias("text_")).where(F.col("text_").isNotNull())
    sums = picked.mapInArrow(run, "word string, n bigint, ended bigint, begun bigint").groupBy("word")
    rows = {r.word: (r.n, r.ended, r.begun) for r in sums.agg(*[F.sum(c).alias(c) for c in ("n", "ended", "begun")]).collect()}
    sentences, chars, _ = rows.pop("", (0, 0, 0))
    return Words(rows, sentences, chars)


def sentence_offsets(docs: DataFrame, key: str, text: str, words: Words = PLAIN_WORDS) -> DataFrame:
    """(key, start_pos, end_pos) of every sentence of the distinct rows; null and blank texts give none.

    One pass over the texts in the map; only the offsets are shuffled, to drop
    those of repeated rows. Columns beyond ``key`` and ``text`` are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, ends = [], [], []
            for i, t in enumerate(batch.column("text_").to_pylist()):
                for a, b in split(t, words):
                    keys.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key_").take(pa.array(keys, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                ["key_", "start_pos", "end_pos"],
            )

    picked = docs.select(F.col(key).alias("key_"), F.col(text).alias("text_")).where(F.col("text_").isNotNull())
    return picked.mapInArrow(run, f"key_ {kind}, start_pos int, end_pos int").withColumnRenamed("key_", key).distinct()


def pieces_in_sentences(docs: DataFrame, pieces: DataFrame, words: Words = PLAIN_WORDS) -> DataFrame:
    """(doc_id, idx, start_pos, end_pos): the true sentences that each badly cut piece touches.

    ``pieces`` has (doc_id, idx, start_pos, end_pos) as the present splitter
    cut them; pieces with null offsets or without a document give no row.
    """
    true = sentence_offsets(docs.select(F.col("id").alias("doc_id"), "content"), "doc_id", "content", words)
    cut = pieces.select("doc_id", "idx", F.col("start_pos").alias("from_"), F.col("end_pos").alias("to_")).distinct()
    return cut.join(true, "doc_id").where("start_pos < to_ AND from_ < end_pos").select("doc_id", "idx", "start_pos", "end_pos")
