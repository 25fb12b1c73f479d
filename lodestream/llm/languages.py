"""Problem 6: the language of each document and of each of its segments.

Cross-parsing: per language a suffix automaton of labelled text; a segment is parsed greedily into the
longest pieces that occur in that text, and the language that needs the fewest pieces per character
wins. Confidence is how far it lies below the next one.

The labelled text is what ``locale`` names, of at most ``SAMPLE`` items a language chosen by hash; since
labels are noisy, a first set of automata is built from the segments whose words speak for their
label and the second adds what the first explain worst. ``TRAIN_CHARS`` bounds an automaton. Everything
else runs over all segments.

A segment is a sentence unit (problem 10) or a line without sentence marks. Links, handles, hash tags and
encoded data are no language and end where a script without spaces begins; a segment counts from ``LEAST_LETTERS`` letters on. Automata of one script compete; the
script of most letters of a segment picks them. All segments of a batch are parsed in lock step.

Each item gets a language: its shorter segments are joined by script and judged too, and an item with
nothing but segments that are explained badly is judged on those.

Defined results: texts without letters of these scripts, null and empty ones have no segments and a null
language of confidence 0; a locale that is null, blank or
names none of the languages equals none; copies of a record come out once; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm import sentences

LANGUAGES = ("en", "de", "fr", "es", "vi", "ru", "zh", "ja", "hi")
SAMPLE = 800
TRAIN_CHARS = 24_000
SURE = 0.15
LEAST_LETTERS = 20
# phrases a letter above which a segment is no language; one character is often a phrase in Han and kana
WORST_RATE = {"latin": 0.5, "cyrillic": 0.5, "devanagari": 0.5, "cjk": 1.0}
DENSE = 1 << 26
_SCRIPTS = {"latin": ("en", "de", "fr", "es", "vi"), "cyrillic": ("ru",), "devanagari": ("hi",), "cjk": ("zh", "ja")}
# characters of scripts without spaces end a link, an address or a tag, as white space does elsewhere
_SPACELESS = "\u2e80-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_JOINED = rf"[^\s@“”«»\u3000-\u303f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65{_SPACELESS}]"
_DROP = re.compile(rf"(?:https?://|(?<![A-Za-z0-9_])www\.)(?:{_JOINED}|@)+|(?<!{_JOINED}){_JOINED}+@{_JOINED}+|[@#](?:(?![{_SPACELESS}])\w)+|(?a:\b(?=\w*\d)\w{{16,}}\b)|[A-Za-z0-9+/=_-]{{40,}}")
_DROPS = re.compile(r"[@#]|://|www\.|[!-~]{16}")  # every match of _DROP holds one of these


def _table(spans: dict[int, list[tuple[int, int]]]) -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for value, ranges in spans.items():
        for a, b in ranges:
            out[a:b] = value
    return out


# 1 Latin, 2 Cyrillic, 3 Devanagari (with its signs), 4 Han and kana
_SCRIPT = _table({1: [(0x41, 0x5B), (0x61, 0x7B), (0xC0, 0x250), (0x1E00, 0x1F00)], 2: [(0x400, 0x530)], 3: [(0x900, 0x964), (0x971, 0x980)], 4: [(0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000)]})
_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Automaton:
    """The suffix automaton of a coded text; row 0 is no state."""

    def __init__(self, codes: list[int], width: int) -> None:
        link, length, nexts, last = [-1], [0], [{}], 0
        for c in codes:
            cur = len(link)
            link.append(0)
            length.append(length[last] + 1)
            nexts.append({})
            p = last
            while p != -1 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p != -1:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    twin = len(link)
                    link.append(link[q])
                    length.append(length[p] + 1)
                    nexts.append(dict(nexts[q]))
                    while p != -1 and nexts[p].get(c) == q:
                        nexts[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        self.rows, self.width = len(link) + 1, width
        self.edges = np.array([(state, c, to + 1) for state, own in enumerate(nexts, 1) for c, to in own.items()], np.int32).reshape(-1, 3)

    @property
    def table(self) -> np.ndarray:
        """The transitions as a dense table."""
        out = np.zeros((self.rows, self.width), np.int32)
        out[self.edges[:, 0], self.edges[:, 1]] = self.edges[:, 2]
        return out


def _steps(edges: np.ndarray, rows: int, width: int, dense: int):
    """Look-up of the target row's offset by row offset plus code; sorted edges where a dense table would be large."""
    keys, to = edges[:, 0].astype(np.int64) * width + edges[:, 1], edges[:, 2].astype(np.int64) * width
    if rows * width <= dense:
        table = np.zeros(rows * width, np.int32)
        table[keys] = to
        return table.__getitem__
    order = np.argsort(keys)
    keys, to = np.append(keys[order], np.iinfo(np.int64).max), np.append(to[order], 0)

    def look(at: np.ndarray) -> np.ndarray:
        i = np.searchsorted(keys, at)
        return np.where(keys[i] == at, to[i], 0)

    return look


class Judge:
    """The automata of all languages; built once for each worker from their texts."""

    def __init__(self, texts: dict[str, str], dense: int = DENSE) -> None:
        self.groups = []
        for script, languages in _SCRIPTS.items():
            letters = Counter(c for lang in languages for c in texts.get(lang, "").lower() if _LETTER[ord(c)] or _SCRIPT[ord(c)])
            width = len(letters) + 3
            code = np.ones(0x110000, np.int16)  # 1: a letter no automaton knows
            code[~_LETTER & (_SCRIPT == 0)] = 2  # 2: between words
            for i, (c, _) in enumerate(letters.most_common(), 3):
                code[ord(c)] = i
            edges, roots, at = [], [], 0
            for lang in languages:
                coded = _squeeze(code[np.frombuffer(texts.get(lang, "").lower().encode("utf-32-le"), np.uint32)])
                own = Automaton(coded.tolist(), width)
                edges.append(own.edges + np.array([at, 0, at], np.int32))
                roots.append(at + 1)
                at += own.rows
            # states are offsets of their rows, so a step is one addition and one look-up
            kind = np.int32 if at * width <= dense else np.int64
            look, roots = _steps(np.concatenate(edges), at, width, dense), np.array(roots, kind) * kind(width)
            first = look(roots[:, None] + np.arange(width, dtype=kind))
            self.groups.append((languages, code, look, np.where(first == 0, roots[:, None], first), roots, WORST_RATE[script]))

    def judge(self, segments: list[str], least: int = LEAST_LETTERS, limited: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each segment its letters, its language (as an index, -1 for none), the confidence and the rate of phrases.

        Segments under ``least`` letters and, if ``limited``, those above ``WORST_RATE`` have no language.
        """
        n = len(segments)
        letters, best, sure, rates = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n), np.ones(n)
        if not n:
            return letters, best, sure, rates
        lower = [s.lower() for s in segments]
        lengths = np.fromiter(map(len, lower), np.int64, n)
        points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(n), lengths)
        letters = np.bincount(owner[_LETTER[points]], minlength=n)
        script = _SCRIPT[points]
        # a letter of a script without an alphabet says about as much as two or three of one with
        share = np.stack([np.bincount(owner[script == k], minlength=n) * (2.5 if k == 4 else 1) for k in (1, 2, 3, 4)])
        most = np.where(letters >= least, share.argmax(axis=0), -1)
        for g, (languages, code, look, first, roots, worst) in enumerate(self.groups):
            own = np.flatnonzero((most == g) & (share[g] > 0))
            if not len(own):
                continue
            mine = np.zeros(n, bool)
            mine[own] = True
            inside = mine[owner]
            coded, of = code[points[inside]], owner[inside]
            # a run of non-letters is one
            keep = ~((coded == 2) & (np.concatenate([[0], coded[:-1]]) == 2))
            coded, size = coded[keep], np.bincount(of[keep], minlength=n)
            start = np.cumsum(size) - size
            own = own[np.argsort(-size[own], kind="stable")]
            rate = self._phrases(look, first, roots, coded, start[own], size[own]) / np.maximum(1, size[own])
            order = np.argsort(rate, axis=0)
            fewest = np.take_along_axis(rate, order[:1], 0)[0]
            second = np.take_along_axis(rate, order[1:2], 0)[0] if len(languages) > 1 else np.ones(len(own))
            ok = (fewest <= worst) | (not limited)
            best[own[ok]] = np.array([LANGUAGES.index(x) for x in languages])[order[0]][ok]
            sure[own], rates[own] = np.maximum(0, 1 - fewest / np.maximum(second, 1e-9)), fewest
        return letters, best, sure, rates

    @staticmethod
    def _phrases(look, first, roots, coded, start, size) -> np.ndarray:
        """Greedy cross-parses of all segments (longest first) by all automata at once, a character a step."""
        state = np.repeat(roots[:, None], len(start), axis=1)
        count = np.ones(state.shape, np.int32)
        alive = len(start)
        for t in range(int(size[0]) if len(size) else 0):
            while size[alive - 1] <= t:
                alive -= 1
            c = coded[start[:alive] + t]
            step = look(state[:, :alive] + c)
            miss = step == 0
            count[:, :alive] += miss
            state[:, :alive] = np.where(miss, first[:, c], step)
        return count


@lru_cache(maxsize=1)
def judge_of(texts: tuple[tuple[str, str], ...]) -> Judge:
    """The judge of these texts; a Python worker builds it once for all its tasks."""
    return Judge(dict(texts))


def _squeeze(codes: np.ndarray) -> np.ndarray:
    return codes[~((codes == 2) & (np.concatenate([[0], codes[:-1]]) == 2))] if len(codes) else codes


def pieces(text: str) -> list[tuple[int, str]]:
    """Start and text of the sentence units of a text, links and encoded data blanked out."""
    plain = _DROP.sub(lambda m: " " * len(m[0]), text) if _DROPS.search(text) else text
    return [(a, plain[a:b]) for a, b in sentences.units(text)]


def locale_language(locale):
    return F.regexp_extract(F.lower(F.trim(F.coalesce(locale, F.lit("")))), r"^([^_-]*)", 1)


def _items(envelopes: DataFrame) -> DataFrame:
    return envelopes.select("harvest_id", locale_language(F.col("item.locale")).alias("locale"), F.col("item.content").alias("text"))


def fit(envelopes: DataFrame, sample: int = SAMPLE, chars: int = TRAIN_CHARS) -> dict[str, str]:
    """The texts the automata are built from: at most ``sample`` items and ``chars`` characters a language."""
    rows = None
    items = _items(envelopes).filter(F.length("text").between(60, 4000)).withColumn("h", F.xxhash64("harvest_id"))
    part = items.filter(F.col("locale").isin(*LANGUAGES))
    # the least hashes of each language, kept by a bounded aggregate on every side of the shuffle
    rows = part.groupBy("locale").agg(F.min_by("h", "h").alias("h0"), F.count(F.lit(1)).alias("n")).select("locale", "n")
    share = F.least(F.lit(1.0), F.lit(1.5 * sample) / F.col("n"))
    picked = part.join(F.broadcast(rows), "locale").filter(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003).select("locale", "text", "h").orderBy("h").limit(2 * sample * len(LANGUAGES))
    said: dict[str, list[str]] = defaultdict(list)
    for r in picked.collect():
        said[r["locale"]] += [p for _, p in pieces(r["text"]) if sum(map(str.isalpha, p)) >= LEAST_LETTERS]
    said = _voted({lang: list(dict.fromkeys(lines)) for lang, lines in said.items()})
    first = Judge({lang: _take(lines, chars // 2) for lang, lines in said.items()})
    kept = {}
    for lang, lines in said.items():
        _, _, _, rate = first.judge(lines)
        # what the first automata explain worst adds most
        hard = [lines[i] for i in np.argsort(-rate, kind="stable")]
        kept[lang] = _take(lines, chars // 2) + "\n" + _varied(hard, chars // 2)
    return kept


def _voted(said: dict[str, list[str]]) -> dict[str, list[str]]:
    """The lines of each label whose words speak for it: labels are wrong or mixed here and there, words are not."""
    grams = {lang: [_words(x) for x in lines] for lang, lines in said.items()}
    counts = {lang: Counter(w for ws in own for w in ws) for lang, own in grams.items()}
    labels = list(counts)
    total = [sum(counts[k].values()) + 1 for k in labels]
    known: dict[str, np.ndarray] = {}

    def says(w: str) -> np.ndarray:
        if w not in known:
            known[w] = np.log([(counts[k][w] + 0.2) / t for k, t in zip(labels, total)])
        return known[w]

    out: dict[str, list[str]] = {lang: [] for lang in said}
    for lang, lines in said.items():
        for line, ws in zip(lines, grams[lang]):
            if ws and labels[int(np.sum([says(w) for w in ws], axis=0).argmax())] == lang:
                out[lang].append(line)
    return out


def _words(line: str) -> list[str]:
    """Words of a line, or pairs of characters where there are no spaces."""
    return [w for w in re.findall(r"[^\W\d_]{2,}", line.lower()) if _SCRIPT[ord(w[0])] != 4] + [line[i : i + 2] for i in range(len(line) - 1) if _SCRIPT[ord(line[i])] == 4]


def _varied(lines: list[str], chars: int) -> str:
    """The first lines that begin differently, up to the bound."""
    seen, out, size = set(), [], 0
    for line in lines:
        begin = re.sub(r"\W|\d", "", line)[-8:]
        if begin not in seen and size + len(line) <= chars:
            seen.add(begin)
            out.append(line)
            size += len(line)
    return "\n".join(out)


def _take(lines: list[str], chars: int) -> str:
    """Different lines, every n-th so that the bound reaches over all of them."""
    lines = list(dict.fromkeys(lines))
    total = sum(map(len, lines))
    return "\n".join(lines[:: max(1, total // chars)])[:chars]


def settle(owner: np.ndarray, letters: np.ndarray, best: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Segments that no language wins clearly take the language of most clear letters of their document, if of the same script."""
    groups = [tuple(LANGUAGES.index(x) for x in g) for g in _SCRIPTS.values()]
    clear = (best >= 0) & (sure >= SURE)
    weight = np.zeros((int(owner.max()) + 1 if len(owner) else 0, len(LANGUAGES)))
    np.add.at(weight, (owner[clear], best[clear]), letters[clear])
    out = best.copy()
    for i in np.flatnonzero((best >= 0) & ~clear):
        own = next(g for g in groups if best[i] in g)
        most = max(own, key=lambda k: weight[owner[i], k])
        if weight[owner[i], most] > 0:
            out[i] = most
    return out


def _rest(owner: np.ndarray, texts: list[str], letters: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Owner, script and text of what the segments leave: the short ones of each item joined by script, or all of an item that has nothing else."""
    has = set(owner[best >= 0]) | set(owner[(letters > 0) & (letters < LEAST_LETTERS)])
    joined: dict[tuple[int, int], list[str]] = defaultdict(list)
    for i in np.flatnonzero((letters > 0) & (best < 0)):
        if letters[i] < LEAST_LETTERS or owner[i] not in has:
            kinds = np.bincount(_SCRIPT[np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=5)
            joined[owner[i], int(kinds[1:].argmax())].append(texts[i])
    return np.array([k for k, _ in joined], np.int64), np.array([k for _, k in joined], np.int64), ["\n".join(x) for x in joined.values()]


def _judged(envelopes: DataFrame, texts: dict[str, str] | None, whole: bool) -> DataFrame:
    """The segments long enough to tell; if ``whole``, also the rest of each item (``start_pos`` below 0), if only that it has no language."""
    texts = texts or fit(envelopes)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = None
        for pdf in batches:
            judge = judge or judge_of(tuple(texts.items()))
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                parts = [pieces(t) if t else [] for t in part["text"]]
                flat = [x for p in parts for x in p]
                owner, start = np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.array([p for p, _ in flat], np.int64)
                letters, best, sure, _ = judge.judge([s for _, s in flat])
                if whole:
                    own, kinds, joined = _rest(owner, [s for _, s in flat], letters, best)
                    more = judge.judge(joined, 1, limited=False)
                    n = len(owner)
                    weight = np.concatenate([letters, np.zeros(len(own), np.int64)])
                    owner, letters, best, sure = (np.concatenate(x) for x in ((owner, own), (letters, more[0]), (best, more[1]), (sure, more[2])))
                    best = settle(owner, weight, best, sure)
                    none = np.setdiff1d(np.arange(len(parts)), owner[best >= 0])
                    start = np.concatenate([start, -1 - kinds, np.full(len(none), -9)])
                    owner, letters, best, sure = (np.concatenate(x) for x in ((owner, none), (letters, 0 * none), (best, 0 * none - 1), (sure, 0.0 * none)))
                    keep = (best >= 0) | (np.arange(len(owner)) >= n + len(own))
                else:
                    best = settle(owner, letters, best, sure)
                    keep = best >= 0
                out = pd.DataFrame({
                    "harvest_id": part["harvest_id"].to_numpy()[owner],
                    "locale": part["locale"].to_numpy()[owner],
                    "start_pos": start,
                    "letters": letters,
                    "lang": np.array([*LANGUAGES, None], object)[best],
                    "confidence": sure,
                })
                yield out[keep]

    schema = "harvest_id string, locale string, start_pos int, letters int, lang string, confidence double"
    return _items(envelopes).mapInPandas(rows, schema)


def segments(envelopes: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """``harvest_id, locale, start_pos, letters, lang, confidence`` of every segment long enough to tell."""
    return _judged(envelopes, texts, False)


def documents(envelopes: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """``harvest_id, lang, confidence`` of every item: the language of most of its letters, and their share of them."""
    own = _judged(envelopes, texts, True).groupBy("harvest_id", "start_pos", "lang").agg(F.max("letters").alias("letters"), F.max("confidence").alias("confidence"))
    own = own.groupBy("harvest_id", "lang").agg(F.sum("letters").alias("letters"), F.avg("confidence").alias("c"))
    return own.groupBy("harvest_id").agg(
        F.max_by("lang", F.struct("letters", "lang")).alias("lang"),
        F.round(F.coalesce(F.try_divide(F.max("letters"), F.sum("letters")), F.lit(0.0)) * F.max_by("c", F.struct("letters", "lang")), 4).alias("confidence"),
    )


def found(envelopes: DataFrame) -> DataFrame:
    return segments(envelopes).filter(F.col("lang") != F.col("locale")).select("harvest_id", "lang").distinct()
