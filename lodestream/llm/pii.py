"""Problem 7: personal information in free text.

A semi-Markov conditional random field over each line. Its segments are whole spans, each of which may take
one of its types or none; everything between is outside. Candidates are addresses of mail, runs of digits of
any length, street addresses, and for names all runs of up to ``NAME_WORDS`` name-shaped words (so many
characters in scripts without spaces) that hold a known name word or stand at a cue. Features look at
the whole span, at what stands around it, and at the type and distance of the span chosen before it.
Dynamic programming over spans and types picks boundaries and types together; the bound on the words of a
name bounds the spans of a line, and no span is cut short.

Two passes prepare it. The lexicon of name words is a Spark aggregate over all lines: words of names that
stand at a clear cue, at least twice. The model is trained here, by gradient ascent on the conditional
likelihood, on about ``TRAIN_LINES`` lines with a clear cue, drawn by their hash. Labels come from the cues,
so in a part of the lines the cues, and in another the lexicon, are hidden from the features, and the
weights of shape, known words and neighbours must explain the labels alone.

Defined results: null and empty texts have no rows; a line is numbered within the text as stored;
copies of a record come out once; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
TRAIN_LINES = 6_000
EPOCHS = 4
NAME_WORDS = 4
LEXICON_LEAST, LEXICON_SIZE = 2, 200_000

# Words beside which a span is clearly of a type, or clearly not personal.
CUES = {
    "PHONE": "call ring phone desk callback tel telefon rückruf unter centralita teléfono standard joignable số dây nóng nóng: телефон звоните связь 电话 電話 फोन से",
    "ID_NUMBER": "passport ssn ssn/id social id number document documento pasaporte dni ausweisnummer ausweis identité numéro căn cước cước паспорта снилс 身份证号 身分証番号 पहचान संख्या",
    "NOT": "order ticket issue build seed batch release version channel views drafts bestellung vorgang ausgabe pedido aviso edición commande đơn hàng bản lỗi заказ заявку сборка 订单 版本 问题 注文 版 不具合 आदेश संस्करण दोष",
}
NAME_LEFT = r"(?:[Gg]uest(?: today)? is|opened by|thanks to|[Ss]igned:?|[Mm]y name is|[Gg]ast ist(?: heute)?|gez\.|[Mm]ein Name ist|[Cc]ontact :?|[Ii]nvitée? du jour est|[Jj]e m['’]appelle|acompaña|[Ff]irmado:|[Mm]e llamo|[Mm]i nombre es|hôm nay là|[Ll]iên hệ|[Tt]ên tôi là|в гостях|[Сс]вязь:|[Мм]еня зовут|(?:^|\s)[—–])"
NAME_RIGHT = r"(?:lives at|,? who built|wohnt (?:in|am)|habite|vive en|sống ở|живёт)"
# Common given names of the languages.
GIVEN = frozenset(
    """
    james john robert michael william david thomas mark paul peter mary patricia jennifer linda elizabeth susan sarah karen anna emma
    hans jürgen wolfgang klaus stefan andreas matthias torsten lennart ursula monika petra sabine anke frauke heike katrin julia
    jean pierre michel philippe alain nicolas thibault luc marie claire sophie isabelle camille odette élodie solène nathalie
    josé juan carlos luis miguel javier antonio rodrigo álvaro maría maria carmen lucía ana inés isabel laura elena
    minh anh tuấn hùng dũng lan hoa linh thảo hương ngọc nam
    иван алексей дмитрий сергей андрей михаил тимур ольга елена наталья татьяна анна мария ирина
    अमित राहुल विजय संजय अनिल कबीर विहान प्रिया अनन्या सुनीता पूजा नेहा
    """.split()
)

_ZERO = regex.compile(r"\p{Cf}")
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {c: 32 for c in (0xA0, 0x2003, 0x2007, 0x2009, 0x202F, 0x3000)} | {c: 45 for c in (0x2010, 0x2011, 0x2012, 0x2212)}
_WIDE |= {0x1D7CE + i: 48 + i % 10 for i in range(50)}

_EMAIL = regex.compile(
    r"(?:mailto:)?[\w.+-]+@[\w-]+(?:\.[\w-]+)+|[\p{Latin}\d_.+-]+\s?[\[(](?:at|arroba|ät|@)[\])]\s?[\p{Latin}\d-]+(?:\s?(?:\.|[\[(](?:dot|punkt|punto|point)[\])])\s?[\p{Latin}\d-]+)+|[a-zA-Z0-9_.+-]+ at [a-zA-Z0-9-]+(?: dot [a-zA-Z]+)+",
    regex.I,
)
_NUMBER = regex.compile(
    r"(?<![\p{Latin}\p{N}_@#/.-])(?:[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]{4}){2,}(?:[ -]?[A-Z0-9]{1,4})?|(?:\+?\(?(?:[A-Z]{1,2})?\d|\(\d)[\d\s().\-/]{4,}\d[A-Z]?)(?![\p{Latin}\p{N}_@])|(?<![\p{Latin}\p{N}_@#])[A-Z]{1,2}\d{6,9}[A-Z]?(?![\p{Latin}\p{N}])"
)
_CITY = r"(?:,\s*(?:Apt\.?|Suite|Unit|Flat|Hinterhaus|piso|puerta|appt|Bât\.?|кв\.|д\.|корп\.|phường|quận|huyện)?\s*[\p{Lu}\p{N}][\p{L}\p{N}’'/-]*(?:\s[\p{Lu}\p{N}][\p{L}\p{N}’'-]*){0,3}){0,3}"
_ADDRESSES = [
    r"\d{1,5}[a-z]?\s(?:(?:N|S|E|W|North|South|East|West)\.?\s)?(?:[\p{Lu}\d][\p{L}\d’'-]*\s){1,4}(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Drive|Dr\.?|Court|Way|Place|Square|Terrace|Close|Boulevard|Blvd\.?|Row|Hill|Crescent)\b" + _CITY,
    r"\b(?:P\.?\s?O\.?\s?)?[Bb][Oo][Xx]\s\d+" + _CITY,
    r"\b(?:Postfach|[Aa]partado(?: de [Cc]orreos)?|BP|B\.P\.|[Bb]oîte postale|[Hh](?:ò|ộ)m thư(?: số)?|[Hh]ộp thư(?: số)?|а/я|А/я|абонентский ящик|पोस्ट बॉक्स|डाक पेटी|डाकपेटी)\s?(?:Nr\.|n[.°º]|№|số)?\s?\d+(?:\s?\d{2,3})?" + _CITY,
    r"\b(?:[\p{Lu}][\p{L}-]*(?:straße|strasse|str\.|weg|steig|gasse|platz|allee|ring|damm|ufer|pfad|hof|markt)|(?:Am|An der|Im|Zum|Zur|Auf dem)\s(?:[\p{Lu}][\p{L}-]+\s?){1,3}?)\s?\d{1,4}\s?[a-z]?\b" + r"(?:,\s*\p{Lu}\p{L}+)?(?:,\s*\d{5}\s\p{Lu}[\p{L}-]+)?",
    r"\d{1,4}(?:\s(?:bis|ter))?,?\s(?i:rue|avenue|allée|boulevard|place|chemin|impasse|quai|route|cours|passage)\s(?:d[eu]s?\s|de la\s|de l['’]|d['’])?[\p{L}’'-]+(?:\s[\p{Lu}\d][\p{L}\d’'-]*){0,4}(?:,\s*(?:\d{5}\s)?\p{Lu}[\p{L}-]+)?",
    r"\b(?i:calle|avenida|avda\.|c/|plaza|paseo|camino|carretera|travesía|ronda)\s(?:de(?:l| los| las| la)?\s)?\p{Lu}[\p{L}’'-]+(?:\s\p{Lu}[\p{L}’'-]+){0,3},?\s\d{1,4}\s?[a-z]?(?:,\s*piso\s\d+)?(?:,\s*(?:\d{5}\s)?\p{Lu}[\p{L}-]+)?",
    r"(?:\bsố\s)?\b\d{1,4}(?:/\d+)*[A-Za-z]?\s(?:(?:ngõ|ngách|hẻm|kiệt)\s\d+(?:/\d+)*\s)?(?:đường|phố|ngõ|hẻm)\s\p{Lu}\p{L}+(?:\s\p{Lu}\p{L}+){0,3}(?:,\s*(?:phường|quận|huyện|xã|tp\.?|TP\.?|thành phố)\s\p{Lu}\p{L}+(?:\s\p{Lu}\p{L}+){0,2})*",
    r"(?:\p{Lu}\p{L}+,\s)?(?i:ул\.|улица|пр\.|проспект|пер\.|бульвар|наб\.|шоссе)\s\p{Lu}[\p{L}-]+(?:\s\p{Lu}[\p{L}-]+)?,\s(?:д\.\s?|дом\s)?\d{1,4}[а-я]?(?:,\s*кв\.\s?\d+)?(?:,\s*\p{Lu}\p{L}+)?|(?:\p{Lu}\p{L}+,\s)?\p{Lu}[\p{L}-]+\s(?:переулок|улица|проспект|бульвар|площадь|шоссе|набережная|проезд|тупик),\s(?:д\.\s?|дом\s)?\d{1,4}[а-я]?(?:,\s*кв\.\s?\d+)?",
    r"(?:(?![到至往寄址])\p{Han}){1,4}?(?:[省市县州](?:(?![到至往寄址])\p{Han}){1,4}?)?[市区县镇乡]?(?:(?![到至往寄址])\p{Han}){1,5}(?:路|街|巷|道|弄|胡同)\d{1,5}号(?:\d+(?:室|楼|单元|栋))*|(?:邮政)?信箱\d+号?|邮箱\d+号",
    r"(?:[\p{Han}ヶケの]{1,5}[都道府県])?(?:[\p{Han}ヶケ]{1,5}[市区郡])?[\p{Han}ヶケ]{1,6}[町村区]?(?:[東西南北]|[\p{Han}])?\d{1,4}(?:丁目\d{1,4}(?:番地?)?(?:の?\d+号?)?|番地?\d*(?:の\d+)?|の\d{1,4})|私書箱第?\d+号?",
    r"(?:मकान|घर|फ्लैट|प्लॉट)\s(?:नं\.?\s|संख्या\s)?\d+[^,।\n]{0,3},\s[^,।\n\d]{2,25}(?:,\s[^,।\s\d]{2,20})?|\d{1,4}(?:/\d+)?,?\s[^,।\n\d]{2,25}(?:मार्ग|गली|सड़क|सडक|रोड|नगर|चौक|पथ|बाजार)(?:,\s[^,।\s\d]{2,20})?",
]
_ADDRESS = [regex.compile(p) for p in _ADDRESSES]
_W = r"\p{Lu}[\p{L}\p{M}’'-]+"
_TITLE = r"(?:(?:Dr|Prof|Mr|Mrs|Ms|Sr|Sra|Dra|Srta|Herr|Frau|Mme|M|Д-р|Проф|TS|ThS|डॉ|प्रो)\.?\s+)?"
_PERSON = rf"{_TITLE}(?:\p{{Lu}}{{2,}}(?:[\s-]\p{{Lu}}{{2,}})*,\s{_W}(?:\s\p{{Lu}}\.)?|{_W}(?:\s(?:\p{{Lu}}\.|{_W})){{1,3}})"
_NAMED = regex.compile(rf"{NAME_LEFT}\s*({_PERSON})")
_LED = regex.compile(rf"({_PERSON})\s+{NAME_RIGHT}")
_NAMED_HAN = regex.compile(r"(?:联系人|联络人|嘉宾是|主讲人|作者|我叫)[：:]?(\p{Han}{2,4})(?=[，,。、\s（(]|$)")
_NAMED_JA = regex.compile(r"(?:担当は|ゲストは|お相手は|講師は|筆者は|名前は)([\p{Han}ヶケ々\p{Hiragana}\p{Katakana}]{2,9}?)(?:さん|氏|様)")
_NAMED_HI = regex.compile(r"(?:अतिथि|संपर्क करें|मेहमान|मेरा नाम)\s((?:[\p{Devanagari}\p{M}]+\.?\s){1,3}?[\p{Devanagari}\p{M}]+)\s(?=हैं|से)")
_SPEAKS = regex.compile(r"[\p{L}\p{M}’'-]+")


# Words without which no pattern of an address (by its number above) or of a name can match.
_ADDRESS_WORDS = [
    "Street| St|Road| Rd|Lane| Ln|Avenue| Ave|Drive| Dr|Court| Way|Place|Square|Terrace|Close|Boulevard|Blvd| Row| Hill|Crescent",
    "Box |BOX |box ",
    "Postfach|partado|BP |B.P.|oîte postale|òm thư|ộm thư|ộp thư|а/я|А/я|бонентский|पोस्ट बॉक्स|डाक पेटी|डाकपेटी",
    "straße|strasse|str.|weg|steig|gasse|platz|allee|ring|damm|ufer|pfad|hof|markt|Am |An der |Im |Zum |Zur |Auf dem ",
    " rue | avenue | allée | boulevard | place | chemin | impasse | quai | route | cours | passage | Rue | Avenue | Allée | Boulevard | Place | Chemin | Impasse | Quai | Route | Cours | Passage ",
    "calle |avenida |avda.|c/|plaza |paseo |camino |carretera |travesía |ronda |Calle |Avenida |Avda.|C/|Plaza |Paseo |Camino |Carretera |Travesía |Ronda ",
    "đường |phố |ngõ |hẻm ",
    "Ул.|Улица|Проспект|ул.|улица|пр.|проспект|пер.|переулок|бульвар|площадь|шоссе|наб.|набережная|проезд|тупик",
    "号|信箱|邮箱",
    "丁目|番|私書箱|の0|の1|の2|の3|の4|の5|の6|の7|の8|の9",
    "मकान |घर |फ्लैट|प्लॉट|मार्ग|गली|सड़क|सडक|रोड|नगर|चौक|पथ|बाजार",
]
_NAME_WORDS = "uest |opened by|thanks to|igned|y name is|ast ist|gez.|Name ist|ontact|du jour est|appelle|acompaña|irmado|e llamo|nombre es|hôm nay là|iên hệ|ên tôi là|в гостях|вязь|зовут|अतिथि|संपर्क|मेहमान|मेरा नाम|—|–|lives at|who built|wohnt |habite|vive en|sống ở|живёт|联系人|联络人|嘉宾是|主讲人|作者|我叫|担当は|ゲストは|お相手は|講師は|筆者は|名前は"
_CUED = (_NAMED, _LED, _NAMED_HAN, _NAMED_JA, _NAMED_HI)
_STUDIO = re.compile(r"studio|weekly|radar|notes|lane$", re.I)
_TITLED = regex.compile(rf"{_TITLE}$")
#: What a line must hold for any candidate: a digit, an at sign, or a letter that opens a name or has no case.
_PLAIN = re.compile(r"\d|@|[^a-z\W][^\W\d_]|[(\[]at[)\]]")
_DIGITS = re.compile(r"\d[\d\s().\-/]{4,}\d|[A-Z]\d{6}")
_AT = re.compile(r"@\w|[\[(](?:at|arroba|ät|@)[\])]| at \S+ dot ", re.I)


@cache
def _automaton(lexicon: frozenset[str]):
    """Finds the words above and those of the lexicon in one pass over a line."""
    import ahocorasick

    groups: dict[str, set] = defaultdict(set)
    for k, words in enumerate(_ADDRESS_WORDS):
        for w in words.split("|"):
            groups[w].add(k)
    for w in _NAME_WORDS.split("|"):
        groups[w].add("name")
    for w in lexicon | GIVEN:
        for form in {w, w.title(), w.upper(), w.capitalize()}:
            groups[form].add("word")
    out = ahocorasick.Automaton()
    for w, g in groups.items():
        out.add_word(w, g)
    out.make_automaton()
    return out


def hints(line: str, lexicon: frozenset[str] = frozenset()) -> set:
    """Which kinds of candidates a line can hold at all."""
    out: set = set()
    for _, g in _automaton(lexicon).iter(line):
        out |= g
    if _AT.search(line):
        out.add("email")
    if _DIGITS.search(line):
        out.add("number")
    return out


@dataclass
class Span:
    begin: int
    end: int
    kind: str
    labels: tuple[str, ...]
    features: dict[str, list[str]] = field(default_factory=dict)
    gold: str | None = None


@dataclass(frozen=True)
class Hidden:
    """What a training line hides from the features."""

    cues: bool = False
    lexicon: bool = False


SHOWN = Hidden()


def clean(line: str) -> tuple[str, list[int] | None]:
    """The line with wide forms made plain and invisible characters dropped, and where each character was."""
    if line.isascii():
        return line, None
    line = line.translate(_WIDE)
    if not _ZERO.search(line):
        return line, None
    at = [i for i, c in enumerate(line) if not _ZERO.match(c)]
    return "".join(line[i] for i in at), at


def _cues(text: str) -> set[str]:
    low = text.lower()
    words = set(re.findall(r"[^\s,;:()]+", low)) | {w.strip(".:=#") for w in low.split()}
    out = set()
    for label, cues in CUES.items():
        if any(c in words or (not c.isascii() and ord(c[0]) > 0x900 and c in low) for c in cues.split()):
            out.add(label)
    return out


def _shape(span: str) -> str:
    """Groups of digits by length, with what joins them."""
    return re.sub(r"[A-Za-z]", "A", re.sub(r"\d+", lambda m: str(len(m[0])), span))


def candidates(line: str, lexicon: frozenset[str] = frozenset(), hidden: Hidden = SHOWN) -> list[Span]:
    """The candidate spans of a cleaned line in order of their ends."""
    hint = hints(line, lexicon)
    out: list[Span] = []
    if not hint:
        return out
    if "email" in hint:
        out += [Span(m.start(), m.end(), "email", ("EMAIL",)) for m in _EMAIL.finditer(line)]
    mails = [(s.begin, s.end) for s in out]
    if "number" in hint:
        out += [Span(m.start(), m.end(), "number", ("PHONE", "ID_NUMBER")) for m in _NUMBER.finditer(line) if sum(c.isdigit() for c in m[0]) >= 7]
    if any(c.isdigit() for c in line):
        for k, pattern in enumerate(_ADDRESS):
            if k in hint:
                out += [Span(m.start(), m.end(), f"address{k}", ("ADDRESS",)) for m in pattern.finditer(line)]
    cued = cued_names(line) if "name" in hint else {}
    names = dict.fromkeys(cued)
    if "name" in hint or "word" in hint:
        names |= dict.fromkeys(name_spans(line, lexicon, cued))
    # a name inside an address of mail is part of it
    out += [Span(a, b, "name", ("NAME",)) for a, b in names if not any(x <= a < y for x, y in mails)]
    for s in out:
        _describe(line, s, lexicon, cued, hidden)
        if s.kind == "name" and s.gold is None and any(o.kind.startswith("address") and o.begin < s.end and s.begin < o.end for o in out):
            s.gold = "O"
    return sorted(out, key=lambda s: (s.end, s.begin))


def cued_names(line: str) -> dict[tuple[int, int], int]:
    """Spans of the names at a clear cue, and the pattern that found them."""
    return {m.span(1): k for k, pattern in enumerate(_CUED) for m in pattern.finditer(line)}


def name_spans(line: str, lexicon: frozenset[str], cued: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """All runs of two to ``NAME_WORDS`` name-shaped words with a known one or within a cued run, and whole known names without spaces."""
    out: list[tuple[int, int]] = []
    runs: list[list[tuple[int, int, bool, bool]]] = [[]]
    for m in _SPEAKS.finditer(line):
        word, low = m[0], m[0].lower()
        if word[0] >= "\u2e80":
            continue
        initial = len(word) == 1 and word.isupper() and line[m.end() : m.end() + 1] == "."
        known = low in lexicon or low in GIVEN or word in lexicon
        shaped = word[0].isupper() and len(word) > 1 or initial or known and word[0] >= "\u0900"
        between = line[runs[-1][-1][1] : m.start()] if runs[-1] else ""
        if runs[-1] and (not shaped or between.strip(" .,") or len(between) > 3 or "." in between and not runs[-1][-1][3]):
            runs.append([])
        if shaped:
            runs[-1].append((m.start(), m.end(), known, initial))
    at_cue = [(a, b) for a, b in cued]
    for run in runs:
        for i in range(len(run)):
            if run[i][3]:
                continue
            for j in range(i + 1, min(len(run), i + NAME_WORDS + 2)):
                span, own = (run[i][0], run[j][1]), run[i : j + 1]
                if run[j][3] or sum(not w[3] for w in own) > NAME_WORDS:
                    continue
                if any(w[2] for w in own) or any(a <= span[0] and span[1] <= b for a, b in at_cue):
                    title = _TITLED.search(line, max(0, span[0] - 8), span[0])
                    out.append((title.start() if title and title[0] else span[0], span[1]))
    longest = max([0, *(len(w) for w in lexicon if w[0] >= "\u2e80")])
    if longest:
        for m in regex.finditer(r"[\p{Han}\p{Hiragana}\p{Katakana}ヶケ々]{2,}", line):
            for a in range(m.start(), m.end()):
                out += [(a, a + n) for n in range(2, min(longest, m.end() - a) + 1) if line[a : a + n] in lexicon]
    return out


def _describe(line: str, s: Span, lexicon: frozenset[str], cued: dict[tuple[int, int], int], hidden: Hidden) -> None:
    text = line[s.begin : s.end]
    before, after = line[max(0, s.begin - 34) : s.begin], line[s.end : s.end + 14]
    left, right = _cues(before[-26:]), _cues(after)
    shown, said = (set(), set()) if hidden.cues else (left, right)
    base = ["bias", s.kind]
    if s.kind == "number":
        shape = _shape(text)
        digits = sum(c.isdigit() for c in text)
        base += [f"shape={shape}", f"digits={min(digits, 17)}", f"plus={text[0] == '+'}", f"paren={'(' in text}", f"plain={text.isdigit()}", f"letter={any(c.isalpha() for c in text)}", f"first={shape[:3]}"]
        base += [f"left={c}" for c in sorted(shown)] + [f"right={c}" for c in sorted(said)] + ["left=none"] * (not shown)
    elif s.kind == "name":
        words = [w for w in _SPEAKS.findall(text) if len(w) > 1]
        held = frozenset() if hidden.lexicon else lexicon
        whole = text[0] >= "\u2e80"
        known = sum(w.lower() in held or w in held for w in words) if not whole else (3 if text in held else 0)
        given = any(w.lower() in GIVEN for w in words)
        cue = "none" if hidden.cues or (s.begin, s.end) not in cued else str(cued[s.begin, s.end])
        base += [f"known={min(3, known)}/{min(4, len(words))}", f"given={given}", f"studio={bool(_STUDIO.search(text))}", f"comma={',' in text}", f"caps={text.isupper()}", f"whole={whole}", f"cue={cue}"]
        base += [f"more={bool(regex.search(r'\p{Lu}[\p{L}.’-]*\s$', before))}", f"then={bool(regex.match(r',?\s?\p{Lu}', after))}", f"first={not before.strip()}", f"known&given={bool(known)},{given}", f"caps&known={text.isupper()},{min(3, known)}/{min(4, len(words))}"]
    elif s.kind.startswith("address"):
        base += [f"post={bool(re.search(r'[0-9]{5}', text))}", f"comma={',' in text}", f"long={len(text) > 12}", f"mid={bool(s.begin and line[s.begin - 1].isalnum())}"]
    s.features = {label: [f"{label}:{f}" for f in base] for label in s.labels}
    # what clear cues say of the span, for training
    if s.kind == "number":
        if "NOT" in left or "NOT" in right and not left:
            s.gold = "O"
        elif "ID_NUMBER" in left:
            s.gold = "ID_NUMBER"
        elif "PHONE" in left or text[0] == "+":
            s.gold = "PHONE"
    elif s.kind == "name":
        if (s.begin, s.end) in cued:
            s.gold = "O" if _STUDIO.search(text) else "NAME"
        elif any(a < s.end and s.begin < b for a, b in cued) or not whole and not given and 2 * sum(w.lower() in lexicon or w in lexicon for w in words) < len(words) + line.isupper():
            s.gold = "O"  # beside the labelled span, or hardly a known word in it
    else:
        s.gold = s.labels[0]


def _score(weights: dict[str, float], s: Span, label: str) -> float:
    return sum(weights.get(f, 0.0) for f in s.features[label])


def _link(before: tuple[Span, str] | None, s: Span, label: str) -> str:
    """The feature of two chosen spans that follow each other, or of the first one of a line."""
    if before is None:
        return f"{label}:opens"
    gap = s.begin - before[0].end
    return f"{before[1]}>{label}:{'near' if gap <= 4 else 'far' if gap <= 30 else 'apart'}"


def _lattice(spans: list[Span]) -> tuple[list[tuple[Span, str]], list[list[int]]]:
    """Nodes are spans with a type; the nodes that may come right before each, -1 for none.

    Between two chosen spans others stay outside, so every node that ends in time may come before.
    """
    nodes = [(s, t) for s in spans for t in s.labels]
    return nodes, [[-1, *(k for k in range(i) if nodes[k][0].end <= s.begin)] for i, (s, _) in enumerate(nodes)]


def decode(weights: dict[str, float], spans: list[Span]) -> list[tuple[Span, str]]:
    """The best set of spans that do not overlap, with their types."""
    nodes, before = _lattice(spans)
    best: list[tuple[float, int]] = []
    for i, (s, t) in enumerate(nodes):
        own = _score(weights, s, t)
        best.append(max((own + weights.get(_link(nodes[k] if k >= 0 else None, s, t), 0.0) + (best[k][0] if k >= 0 else 0.0), k) for k in before[i]))
    top, at = max([(0.0, -1), *((v, i) for i, (v, _) in enumerate(best))])
    out = []
    while at >= 0:
        out.append(nodes[at])
        at = best[at][1]
    return out[::-1]


def _expected(weights: dict[str, float], spans: list[Span], only_gold: bool) -> tuple[float, dict[str, float]]:
    """Log of the sum over segmentations, and the expected feature counts, by forward and backward sums."""
    nodes, before = _lattice(spans)
    gold = [s.gold == t for s, t in nodes]
    if only_gold:  # one path: the labelled spans in order
        counts: dict[str, float] = defaultdict(float)
        last, total = None, 0.0
        for (s, t), g in zip(nodes, gold):
            if g:
                if last and last[0].end > s.begin:
                    continue
                for f in (*s.features[t], _link(last, s, t)):
                    counts[f] += 1
                    total += weights.get(f, 0.0)
                last = (s, t)
        return total, counts
    add = lambda xs: (m := max(xs)) + math.log(sum(math.exp(x - m) for x in xs))
    own = [_score(weights, s, t) for s, t in nodes]
    links = [[weights.get(_link(nodes[k] if k >= 0 else None, s, t), 0.0) for k in before[i]] for i, (s, t) in enumerate(nodes)]
    ahead: list[float] = []
    for i in range(len(nodes)):
        ahead.append(own[i] + add([w + (ahead[k] if k >= 0 else 0.0) for k, w in zip(before[i], links[i])]))
    total = add([0.0, *ahead])
    back = [[0.0] for _ in nodes]
    done = [0.0] * len(nodes)
    counts = defaultdict(float)
    for i in reversed(range(len(nodes))):
        done[i] = add(back[i])
        s, t = nodes[i]
        for k, w in zip(before[i], links[i]):
            p = math.exp(min(0.0, (ahead[k] if k >= 0 else 0.0) + w + own[i] + done[i] - total))
            for f in (*s.features[t], _link(nodes[k] if k >= 0 else None, s, t)):
                counts[f] += p
            if k >= 0:
                back[k].append(w + own[i] + done[i])
    return total, counts


def train(lines: list[str], lexicon: frozenset[str]) -> dict[str, float]:
    """Weights from cleaned lines; by its hash a line hides its cues, the lexicon, or nothing."""
    weights: dict[str, float] = defaultdict(float)
    power: dict[str, float] = defaultdict(lambda: 1e-3)
    data = []
    for line in lines:
        turn = zlib.crc32(line.encode()) % 6
        spans = candidates(line, lexicon, Hidden(cues=turn in (0, 1), lexicon=turn in (1, 2)))
        if spans and len(spans) <= 60 and all(x.gold for x in spans):
            data.append(spans)
    for _ in range(EPOCHS):
        for spans in data:
            have, want = _expected(weights, spans, True), _expected(weights, spans, False)
            for f in {*have[1], *want[1]}:
                g = have[1].get(f, 0.0) - want[1].get(f, 0.0) - 1e-4 * weights[f]
                power[f] += g * g
                weights[f] += 0.3 * g / math.sqrt(power[f])
    return dict(weights)


def found_in(line: str, weights: dict[str, float], lexicon: frozenset[str]) -> list[tuple[int, int, str]]:
    """``begin, end, type`` of the personal spans of a line as stored."""
    text, at = clean(line)
    spans = candidates(text, lexicon)
    if not spans:
        return []
    out = []
    for s, label in decode(weights, spans):
        out.append((s.begin, s.end, label) if at is None else (at[s.begin], at[s.end - 1] + 1, label))
    return out


def _name_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of cued names with their number, and under the empty word the number of lines with a clear cue of any kind."""
    for pdf in batches:
        seen: Counter[str] = Counter()
        for line in {x for t in pdf["text"] if t for x in t.split("\n")}:
            if _PLAIN.search(line) and (hint := hints(line)):
                seen[""] += 1
                line = clean(line)[0]
                for a, b in cued_names(line) if "name" in hint else ():
                    text = regex.sub(rf"^{_TITLE}", "", line[a:b])
                    if _STUDIO.search(text):
                        continue
                    if text[0] >= "\u2e80":
                        seen[text] += 1
                    else:
                        seen.update(w.lower() for w in _SPEAKS.findall(text) if len(w) > 1)
        yield pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "n": list(seen.values())})


def _sample_rows(share: float):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lines = {x for t in pdf["text"] if t for x in t.split("\n")}
            kept = (x for x in lines if zlib.crc32(x.encode("utf-8", "surrogatepass")) < share * 2**32 and _PLAIN.search(x) and hints(x))
            yield pd.DataFrame({"line": sorted(y for y in map(lambda x: clean(x)[0], kept) if len(y) < 2000)}, dtype=object)

    return rows


def fit(records: DataFrame, lines: int = TRAIN_LINES) -> tuple[dict[str, float], frozenset[str]]:
    """Weights and lexicon: words of cued names over all lines, and a model from a share of the lines that holds about ``lines``."""
    words = records.select("text").mapInPandas(_name_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    kept = words.filter(F.col("n") >= LEXICON_LEAST).orderBy(F.desc("n"), "word").limit(LEXICON_SIZE + 1)
    counts = {r["word"]: r["n"] for r in kept.toLocalIterator()}
    share = min(1.0, lines / max(1, counts.pop("", 1)))
    lexicon = frozenset(counts)
    sample = records.select("text").mapInPandas(_sample_rows(share), "line string").distinct()
    return train(sorted(r["line"] for r in sample.toLocalIterator()), lexicon), lexicon


def _found_rows(model):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, lexicon = model.value
        known: dict[str, tuple] = {}
        for pdf in batches:
            out = []
            for kind, rid, text in zip(pdf["rec_kind"], pdf["rec_id"], pdf["text"]):
                for no, line in enumerate(text.split("\n")) if text else ():
                    if line not in known:
                        if len(known) > 50_000:
                            known.clear()
                        known[line] = tuple(found_in(line, weights, lexicon))
                    out += [(kind, rid, no, a, b, t, line[a:b]) for a, b, t in known[line]]
            yield pd.DataFrame(out, columns=["rec_kind", "rec_id", "line_no", "begin", "end", "pii_type", "value"])

    return rows


def spans(records: DataFrame, model=None) -> DataFrame:
    """``rec_kind, rec_id, line_no, begin, end, pii_type, value`` of every personal span."""
    model = model or fit(records)
    shared = records.sparkSession.sparkContext.broadcast(model)
    schema = "rec_kind string, rec_id string, line_no int, begin int, end int, pii_type string, value string"
    return records.select("rec_kind", "rec_id", "text").mapInPandas(_found_rows(shared), schema)


def redact(records: DataFrame, model=None) -> DataFrame:
    """``rec_kind, rec_id, text, redacted``: each span replaced by ``[TYPE]``, the rest unchanged."""
    shared = records.sparkSession.sparkContext.broadcast(model or fit(records))

    def hide(texts: pd.Series) -> pd.Series:
        weights, lexicon = shared.value

        def one(line: str) -> str:
            at, parts = 0, []
            for a, b, t in found_in(line, weights, lexicon):
                parts += (line[at:a], f"[{t}]")
                at = b
            return "".join(parts) + line[at:]

        return texts.map(lambda t: t if not t else "\n".join(map(one, t.split("\n"))))

    return records.select("rec_kind", "rec_id", "text").distinct().withColumn("redacted", F.pandas_udf(hide, "string")("text"))


def found(records: DataFrame) -> DataFrame:
    return spans(records).select("rec_kind", "rec_id", "line_no", "pii_type").distinct()
