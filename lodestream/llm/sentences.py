"""Problem 10: sentence units in nine languages.

A text is cut at its line breaks. Within a line the marks that may end a sentence form a lattice: each
mark has two readings, *end* and *inside*, with costs, a path is a choice for every mark, and the
cheapest path gives the units. In spaced scripts the costs follow from what stands around the mark:
abbreviations, initials, numbers, dates, ellipses, and the quotation or bracket it stands in or closes.
In scripts without spaces the words around the gap come from a dictionary word lattice, and the gap is
classified by final particles before and opening words behind it. The dictionary is learned from all
documents, as a Spark aggregate: how often each run of up to four characters occurs, and how often it opens
or closes a clause; closed-class words are fixed values.

By the problem's statement a line without sentence marks is one unit. ``sentence_units`` can also cut at
gaps without marks, where the word before closes and the word behind opens a sentence (``unmarked``).

Defined results: null, empty and blank texts and lines without letters or digits give no units; a line
without marks is one unit; repeated rows give repeated units, of which ``found`` keeps one; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that never end a sentence.
NEVER = frozenset(
    """
    mr mrs ms dr prof st rev hon gen col capt lt sgt sr jr messrs fig figs sec secs ch chap no nos vol vols pp eq ed eds
    cf vs approx ca est dept univ e.g i.e viz al jan feb mar apr jun jul aug sep sept oct nov dec
    abb kap nr bzw vgl sog evtl ggf inkl exkl str hr fr frl co z.b d.h u.a o.ä i.d.r z.t geb gest bd hrsg usf tel abs art
    m mm mme mlle mgr c.-à-d p.ex env éd ann janv févr avr juil déc n° fasc
    sra dra srta srs sres d dña dn núm núms cap págs pág aprox ej p.ej av avda c vda tel ene abr ago
    тов гр проф акад доц им ул пр пл пер просп стр рис табл гл прил см ср напр ок тел обл р-н т.е т.к т.н т.о к.т.н д.т.н яв фев апр авг сен окт ноя дек
    ts ths pgs gs tp đt ks bs q p tx x z u
    डॉ प्रो श्री श्रीमती पं सं क्र रु मा
    """.split()
)
# Abbreviations that may close a sentence; they do where the next word could open one.
MAY = frozenset("inc ltd corp llc bros co.uk etc p.m a.m u.k u.s u.s.a s.a s.l s.r.l usw u.s.w uu v.v vv руб коп тыс млн млрд др пр т.д т.п г гг h a.c d.c min std".split())
# Ends of abbreviations written in parts.
PARTS = ("z. b", "d. h", "u. a", "o. ä", "i. d", "i. d. r", "z. t", "p. ex", "p. ej", "т. е", "т. к", "т. н", "к. т", "к. т. н", "д. т. н", "и. о", "c.-à-d", "ee", "v. v")
PARTS_MAY = ("p. m", "a. m", "т. д", "т. п", "u. s. w", "ee. uu", "s. a", "s. l")
MONTHS = frozenset(
    """
    januar februar märz april mai juni juli august september oktober november dezember jänner
    january february march may june july october december
    """.split()
)
# Closed-class words at a gap: what goes on behind a quotation, verbs of speech, words that open or close a sentence.
FOLLOWS_JA = "と って という といった といって とは などと などの だと の は が を に も で へ や から まで より".split()
FOLLOWS_ZH = "却 但 但是 可是 而 而且 就 便 也 还 并 并且 后 之后 的 地 得 几个字 这句话 一句".split()
SPEECH_ZH = "说 问 喊 叫 笑 道 答 嚷 写 连喊 大喊 高喊 喊道 说道 问道 回答".split()
SPEECH_HI = "चिल्ला कह पूछ बोल हंस हँस पुकार लिख".split()
OPENERS_ZH = "这个 那个 这 那 我们 你 你们 我 他 她 它 他们 她们 今天 昨天 明天 到底 为什么 所以 因为 如果 然后 不过 其实".split()
OPENERS_JA = "今日 明日 昨日 私 僕 彼 彼女 でも しかし そして また これ それ あれ この その だから ところで".split()
FINAL_ZH = "了 吧 吗 呢 啊 呀 嘛".split()
FINAL_JA = "た だ です ます でした ました か ね よ ですね ますね ですよ ますよ ますか ですか".split()

_CLOSED = (*FOLLOWS_JA, *"却 但 而 的 喊 嚷".split(), *(w for w in (*FOLLOWS_ZH, *SPEECH_ZH) if len(w) > 1))

#: Words of the learned dictionary, by their number; least number and cohesion of one; clause openings and endings count from this on.
LEXICON = 200_000
LEAST, COHESION, CLEAR = 5, 2.0, 1.2

_BREAK = re.compile(r"\r?\n")
_OPEN = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "《": "》", "‘": "’"}
_CLOSE = frozenset("”“»›」』)）]》’")
_BRACKETS = frozenset("(（[")
_TOKEN = re.compile(r"[.!?…。！？।॥｡]+|[“„«‹「『(（\[《‘”»›」』)）\]》’\"]")
_MARK = frozenset(".!?…。！？।॥｡")
_SPACELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々]")
_SPACELESS_RUN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々]+")
_EDGE = " \t　“”「」『』\"'（）()*>-–—•"
_KANA = regex.compile(r"[\p{Hiragana}\p{Katakana}ー]")
_CASELESS = regex.compile(r"[\p{Devanagari}\p{Han}\p{Hiragana}\p{Katakana}ー]")
_RUN = regex.compile(r"[\p{Katakana}ー]+|[\p{Latin}\p{N}]+|.", regex.S)
_BEFORE = frozenset("“„«‹「『(（[《‘\"¿¡")
_NAMED = regex.compile(r"(?:the|a|an|la|le|el|der|die|das)\s+\p{Lu}")
_BLANKS = re.compile(r"\s*")
_WORD = re.compile(r"[^\W\d_]+")
_ALNUM = re.compile(r"[^\W_]")


class Words:
    """The dictionary of the word lattice: what a word costs, and how far it closes or opens a sentence (as a logarithm of odds)."""

    def __init__(self, counts: dict[str, tuple[int, int, int]] | None = None) -> None:
        counts = counts or {}
        single = sum(n for w, (n, _, _) in counts.items() if len(w) == 1) or 1
        opened, closed = (sum(c[k] for w, c in counts.items() if len(w) == 1) or 1 for k in (1, 2))
        self.cost, self.final, self.opening = {}, {}, {}
        for w, (n, o, f) in counts.items():
            parts = [(w[:i], w[i:]) for i in range(1, len(w))]
            bound = min((math.log(n * single / (counts.get(a, (n,))[0] * counts.get(b, (n,))[0])) for a, b in parts), default=0.0)
            # a learned word may not hide one of the closed classes
            if parts and bound < COHESION or any(w != x and (w.startswith(x) or len(x) > 1 and x in w) for x in _CLOSED):
                continue
            self.cost[w] = math.log(single / n) / len(w) ** 0.5
            self.opening[w] = math.log((o + 0.5) / (n + 1) * single / opened)
            self.final[w] = math.log((f + 0.5) / (n + 1) * single / closed)
        for w in (*FOLLOWS_JA, *FOLLOWS_ZH, *SPEECH_ZH, *OPENERS_ZH, *OPENERS_JA, *FINAL_ZH, *FINAL_JA):
            self.cost[w] = min(1.0, self.cost.get(w, 1.0))
        self.opening |= {w: max(2.0, self.opening.get(w, 0.0)) for w in (*OPENERS_ZH, *OPENERS_JA)}
        self.final |= {w: max(2.0, self.final.get(w, 0.0)) for w in (*FINAL_ZH, *FINAL_JA)}
        self.longest = max(map(len, self.cost))
        self.dear = max([2.0, *(c for w, c in self.cost.items() if len(w) == 1)]) + 1

    def path(self, text: str) -> list[str]:
        """The cheapest path through the lattice of a text: dictionary words before runs of one script before single characters."""
        n = len(text)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(float("inf"), 0)] * n
        for i in range(n):
            cost = best[i][0]
            run = _RUN.match(text, i).end()
            if cost + self.dear < best[run][0]:
                best[run] = (cost + self.dear, i)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                own = self.cost.get(text[i:j])
                if own is not None and cost + own < best[j][0]:
                    best[j] = (cost + own, i)
        out, j = [], n
        while j:
            i = best[j][1]
            out.append(text[i:j])
            j = i
        return out[::-1]


@cache
def fixed_words() -> Words:
    return Words()


def _spaceless_end(line: str, mark: str, opened: int, start: int, after: int, words: Words) -> bool:
    """Whether a sentence ends behind a quotation closed in a script without spaces or case: by the words around the gap."""
    follow = line[after : after + 14].lstrip()
    if not follow:
        return True
    clause = re.split(r"[。！？।!?]", line[after : after + 40], maxsplit=1)[0]
    intro = line[start:opened].rstrip()
    introduced = intro[-1:] in ("：", ":", "，", ",", "、")
    soft = mark[-1] in ".。।॥｡"
    if _SPACELESS.match(follow):
        right = words.path(follow)[0]
        opens = words.opening.get(right, 0.0)
        if _KANA.search(line[start : after + 40]):
            if right in FOLLOWS_JA:
                return False
            left = words.path(line[max(start, opened - 6) : opened])[-1:] or [""]
            return not intro or soft or introduced or left[0] not in FOLLOWS_JA or words.final.get(left[0], 0.0) + opens >= 2 * CLEAR
        if right in FOLLOWS_ZH:
            return False
        if introduced:
            return True
        if intro:  # the sentence that the quotation stands in may go on
            return opens >= CLEAR
        return soft or opens >= 3 * CLEAR or not any(w in SPEECH_ZH for w in words.path(clause[:14]))
    if _CASELESS.match(follow):  # Devanagari
        if introduced or soft:
            return True
        return not intro and not any(v in clause for v in SPEECH_HI)
    return True


def _word_before(line: str, at: int) -> str:
    """What stands before ``at`` without white space or an opening mark in it."""
    i = at
    while i and line[i - 1] not in _BEFORE and not line[i - 1].isspace():
        i -= 1
    return line[i:at]


def _period_end(line: str, at: int, first: int, after: int, follow: str) -> bool:
    """Whether a single period with a space behind it ends a sentence."""
    word = _word_before(line, at)
    low = word.lower().lstrip("-–—•*>#")
    opens = follow[0].isupper() or follow[0] in "“„«‹「『¿¡\"([（" or bool(_CASELESS.match(follow))
    head, _, last = low.rpartition(".")
    if len(head.rpartition(".")[2]) > 3:  # a sentence that ended without a space before this word
        word, low = word[-len(last) :], last
    if not low:
        return opens
    tail = line[max(0, at - 9) : at].lower()
    for part in PARTS_MAY if tail.endswith(PARTS_MAY) else ():
        if tail.endswith(part) and not tail[: -len(part)][-1:].isalpha():
            return opens
    if low.isdigit():
        if at - len(word) <= first + 1 and not line[first : at - len(word)].strip("-–—•*>#( "):
            return False  # a list mark
        nextword = _WORD.match(follow)
        return not (nextword and nextword[0].lower() in MONTHS)
    for part in PARTS if tail.endswith(PARTS) else ():
        if tail.endswith(part) and not tail[: -len(part)][-1:].isalpha():
            return False
    if low == "г" and line[: at - 1].rstrip()[-1:].isdigit():
        return opens
    if len(low) == 1 and word.isupper():
        return False  # an initial
    if low in MAY and low != "г":
        return opens
    if low in NEVER or low == "г":
        return False
    if len(low) == 1 and low.isalpha() and not _CASELESS.match(low):
        return opens
    if "." in low and all(len(p) <= 2 for p in low.split(".")):
        return opens
    return True


def _ends(line: str, begin: int, end: int, after: int, closed: list[tuple[str, int]], start: int, first: int, words: Words) -> bool:
    """The reading of the mark ``line[begin:end]``, its closers up to ``after``; ``start`` is where its unit starts."""
    at = _BLANKS.match(line, after).end()
    if at == len(line):
        return True
    mark, spaced, follow = line[begin:end], at > after, line[at : at + 80]
    quotes = [(c, p) for c, p in closed if c not in _BRACKETS]
    capital = follow[0].isupper() or follow[0].isdigit() or follow[0] in "“„«‹「『¿¡\"(（•"
    ellipsis = "…" in mark or (len(mark) > 1 and set(mark) == {"."})
    if closed and not quotes:
        return spaced and capital and not ellipsis if not _CASELESS.match(follow) else mark[-1] in "。！？।" and bool(line[start : closed[0][1]].strip() == "")
    if quotes:
        opened = quotes[-1][1]
        if ellipsis:
            return capital
        if _CASELESS.match(follow):
            return _spaceless_end(line, mark, opened, start, after, words)
        if capital or mark[-1] in ".。।":
            return follow[0] not in ",;:"
        return bool(_NAMED.match(follow)) if follow[0].isalpha() else not follow[0] in ",;:-–—"
    if any(c in "。！？।॥｡" for c in mark) and "…" not in mark:
        return True
    if "!" in mark or "?" in mark:
        if spaced:
            return True
        return follow[0].isalpha() and (follow[0].isupper() or not follow[0].isascii()) or follow[0] in "“„«「『¿¡"
    if ellipsis:
        return spaced and follow[0].isupper() and not line[:begin].endswith((" ", " "))
    if not spaced:
        word = _word_before(line, begin)
        if "." in word or "@" in word or "/" in word:
            return False
        if _SPACELESS.match(follow) or follow[0] in "“„«「『":
            return len(word) > 1
        return len(word) > 2 and word[-1].islower() and word[-2].islower() and follow[0].isupper() and word.lower() not in NEVER
    return _period_end(line, begin, first, after, follow)


def _continues(line: str, at: int, words: Words) -> bool:
    """Whether the sentence goes on behind a closing quotation mark at ``at``."""
    follow = line[at + 1 :].lstrip()
    if not follow:
        return False
    if _CASELESS.match(follow):
        return not _spaceless_end(line, line[at - 1 : at] or "!", at, at, at + 1, words)
    return follow[0].islower() and not _NAMED.match(follow)


@dataclass(slots=True)
class Mark:
    """A mark of a line with the quotations it closes (up to ``after``) and the innermost one it stands in."""

    begin: int
    end: int
    after: int
    closed: list[tuple[str, int]]
    inside: tuple[str, int] | None
    alone: bool


def marks(line: str) -> list[Mark]:
    """The marks of a line that may end a sentence, with the quotations and brackets around them."""
    stack: list[tuple[str, int]] = []
    out, at, n = [], 0, len(line)
    while (m := _TOKEN.search(line, at)) is not None:
        begin, at = m.span()
        c = m[0]
        if c[0] not in _MARK:
            if c == '"':
                if any(o == '"' for o, _ in stack):
                    while stack.pop()[0] != '"':
                        pass
                elif begin == 0 or not line[begin - 1].isalnum():
                    stack.append((c, begin))
            elif c in _CLOSE and any(_OPEN.get(o) == c for o, _ in stack):
                while _OPEN.get(stack.pop()[0]) != c:
                    pass
            elif c in _OPEN and not (c == "‘"):
                stack.append((c, begin))
            continue
        after, closed = at, []
        while after < n:
            step = after
            if line[step] in "   " and line[step + 1 : step + 2] == "»" and any(o == "«" for o, _ in stack):
                step += 1
            x = line[step]
            if x == '"' and any(o == '"' for o, _ in stack) or x in _CLOSE and any(_OPEN.get(o) == x for o, _ in stack):
                while True:
                    o = stack.pop()
                    closed.append(o)
                    if o[0] == '"' and x == '"' or _OPEN.get(o[0]) == x:
                        break
                after = step + 1
            else:
                break
        out.append(Mark(begin, at, after, closed, stack[-1] if stack else None, len(stack) == 1))
        at = after
    return out


_SURE, _EMPTY, _GIVE_UP = 3.0, 2.0, 7.0


def _reads_end(line: str, m: Mark, start: int, first: int, words: Words) -> bool:
    """The cheaper reading of a mark alone, in a unit that starts at ``start``."""
    if m.inside:
        # only a quotation that makes up its unit by itself holds sentences of its own
        o, p = m.inside
        shut = line.find(_OPEN.get(o, '"'), m.after)
        if not (m.alone and o not in _BRACKETS and line[start:p].strip() == "" and shut > 0 and not _continues(line, shut, words)):
            return False
    return _ends(line, m.begin, m.end, m.after, m.closed, start, first, words)


def line_ends(line: str, words: Words | None = None) -> list[int]:
    """Where the units of a line end (the last one at its length): the cheapest path through the lattice of its marks.

    A node is a start of a unit. An arc to the end mark of a unit costs what reading that mark as an end and
    the marks before it as inside costs, and more where the unit holds no letter or digit.
    """
    words = words or fixed_words()
    first, n = len(line) - len(line.lstrip()), len(line)
    nodes = marks(line)
    if not nodes:
        return [n]
    # where every mark takes its cheaper reading and every unit holds a letter or digit, the path costs nothing and none is cheaper
    start, ends = first, []
    for m in nodes:
        if _reads_end(line, m, start, first, words):
            if not _ALNUM.search(line, start, m.after):
                break
            ends.append(m.after)
            start = _BLANKS.match(line, m.after).end()
    else:
        return ends if ends and ends[-1] == n else [*ends, n]
    free = [None if m.inside or m.closed else _reads_end(line, m, first, first, words) for m in nodes]
    starts = [first] + [m.after + len(line[m.after :]) - len(line[m.after :].lstrip()) for m in nodes]
    infinite = float("inf")
    best, back = [0.0] + [infinite] * len(nodes), [0] * (len(nodes) + 1)
    close, last = infinite, 0
    for j in range(len(nodes) + 1):
        if best[j] == infinite:
            continue
        inside, seen = best[j], False
        for i in range(j, len(nodes)):
            m = nodes[i]
            end = free[i] if free[i] is not None else _reads_end(line, m, starts[j], first, words)
            seen = seen or bool(_ALNUM.search(line, starts[j] if i == j else nodes[i - 1].after, m.after))
            cost = inside + (0.0 if end else _SURE) + (0.0 if seen else _EMPTY)
            if cost < best[i + 1]:
                best[i + 1], back[i + 1] = cost, j
            inside += _SURE if end else 0.0
            if inside - best[j] > _GIVE_UP:  # some other start always does better
                break
        else:
            if inside < close:
                close, last = inside, j
    ends = [n]
    while last:
        if nodes[last - 1].after < n:
            ends.append(nodes[last - 1].after)
        last = back[last]
    return ends[::-1]


def unmarked_ends(line: str, words: Words) -> list[int]:
    """Gaps without a mark between a word that closes and a word that opens a sentence, in scripts without spaces."""
    out = []
    for m in _SPACELESS_RUN.finditer(line):
        at, left = m.start(), ""
        for w in words.path(m[0]):
            if min(words.final.get(left, 0.0), words.opening.get(w, 0.0)) >= CLEAR:
                out.append(at)
            at, left = at + len(w), w
    return out


def line_units(line: str, words: Words | None = None, unmarked: bool = False) -> list[tuple[int, int]]:
    """Spans of the units of a line, each with a letter or digit, without white space around them."""
    spans: list[list[int]] = []
    last = 0
    ends = line_ends(line, words)
    if unmarked:
        ends = sorted({*ends, *unmarked_ends(line, words or fixed_words())})
    for end in ends:
        part = line[last:end]
        if _ALNUM.search(part):
            a = last + len(part) - len(part.lstrip())
            if spans and spans[0][1] < 0:
                a = spans.pop()[0]
            spans.append([a, last + len(part.rstrip())])
        elif part.strip():
            if spans and spans[-1][1] >= 0:
                spans[-1][1] = last + len(part.rstrip())
            elif not spans:
                spans.append([last + len(part) - len(part.lstrip()), -1])
        last = end
    return [(a, b) for a, b in spans if b >= 0]


def units(text: str, words: Words | None = None, unmarked: bool = False) -> list[tuple[int, int]]:
    """Spans of all sentence units of a text."""
    out, at = [], 0
    for m in [*_BREAK.finditer(text), None]:
        stop = m.start() if m else len(text)
        if stop > at:
            out += [(at + a, at + b) for a, b in line_units(text[at:stop], words, unmarked)]
        at = m.end() if m else stop
    return out


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of one to four characters of the clauses, with how often they occur, open and close one."""
    for pdf in batches:
        n, opened, closed = Counter(), Counter(), Counter()
        for clause, weight in zip(pdf["clause"], pdf["n"]):
            # behind a closing quotation mark the sentence may go on, so such a clause tells of no opening
            fresh = not clause.startswith(tuple(_CLOSE)) and clause[:1] != '"'
            clause = clause.strip(_EDGE)
            runs = [m.span() for m in _SPACELESS_RUN.finditer(clause)]
            for a, b in runs:
                for k in range(1, 5):
                    for i in range(a, b - k + 1):
                        n[clause[i : i + k]] += weight
            if runs:
                (a, b), (c, d) = runs[0], runs[-1]
                for k in range(1, 5):
                    if fresh and a == 0 and k <= b:
                        opened[clause[:k]] += weight
                    if d == len(clause) and k <= d - c:
                        closed[clause[-k:]] += weight
        yield pd.DataFrame({"word": pd.Series(list(n), dtype=object), "n": list(n.values()), "opened": [opened[w] for w in n], "closed": [closed[w] for w in n]})


def learn(documents: DataFrame, size: int = LEXICON, least: int = LEAST) -> Words:
    """The dictionary of the word lattice from the clauses of all documents; its ``size`` most frequent runs are kept."""
    clause = F.explode(F.split("text", r"[。！？!?…\r\n]+")).alias("clause")
    clauses = documents.select(clause).filter(F.col("clause").rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")).groupBy("clause").agg(F.count(F.lit(1)).alias("n"))
    runs = clauses.mapInPandas(_counted, "word string, n long, opened long, closed long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "opened", "closed")))
    kept = runs.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(size)
    return Words({r["word"]: (r["n"], r["opened"], r["closed"]) for r in kept.toLocalIterator()})


def _unit_rows(shared, unmarked: bool):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                spans = [units(t, words, unmarked) if t else [] for t in part["text"]]
                counts = [len(s) for s in spans]
                flat = np.array([x for s in spans for x in s], np.int64).reshape(-1, 2)
                yield pd.DataFrame({
                    "doc_id": np.repeat(part["doc_id"].to_numpy(), counts),
                    "unit_no": np.concatenate([np.arange(c) for c in counts] or [np.zeros(0, int)]),
                    "start_pos": flat[:, 0],
                    "end_pos": flat[:, 1],
                    "unit": pd.Series([t[a:b] for t, s in zip(part["text"], spans) for a, b in s], dtype=object),
                })

    return rows


def sentence_units(documents: DataFrame, words: Words | None = None, unmarked: bool = False) -> DataFrame:
    """``doc_id, unit_no, start_pos, end_pos, unit`` of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(words or learn(documents))
    return documents.select("doc_id", "text").mapInPandas(_unit_rows(shared, unmarked), "doc_id long, unit_no int, start_pos int, end_pos int, unit string")


def found(documents: DataFrame) -> DataFrame:
    return sentence_units(documents).select("doc_id", "start_pos").distinct()
