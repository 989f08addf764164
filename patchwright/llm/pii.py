"""Personal information in free text: found, and replaced by a placeholder of its kind.

Method: regular expressions propose spans; validators (Verhoeff, Luhn, mod 97) and formats that hardly
occur by chance raise a span's score, and card and account numbers have to pass theirs; context words before and
after it raise or lower it. A number counts only as a whole, never a part of a longer row of its groups. A span counts from
a score of ACCEPT on. Where spans overlap, the one with the higher score, then the longer, stays.

Names are proposed by what stands around them (a title, a greeting, a signature, a role, a verb of the desk)
and by their parts: given and family names of a bounded list of people, and the endings that several
family names of that list share, which stand for people who aren't on it.

Defined results: null stays null; empty texts have no finds; texts are taken whole; repeated rows give
the same finds; everything outside the spans stays as it is, byte for byte.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCEPT = 2
MOST_PEOPLE = 200_000
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
_DIGITS = str.maketrans("०१२३४५६७८९", "0123456789")

# The tables of Verhoeff's check digit.
_VERHOEFF_D = ["0123456789", "1234067895", "2340178956", "3401289567", "4012395678", "5987604321", "6598710432", "7659821043", "8765932104", "9876543210"]
_VERHOEFF_P = ["0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258"]


def verhoeff(digits: str) -> bool:
    c = 0
    for i, x in enumerate(reversed(digits)):
        c = int(_VERHOEFF_D[c][int(_VERHOEFF_P[i % 8][int(x)])])
    return c == 0


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        d = int(x) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(digits: str) -> bool:
    """The last two digits complete the rest to 97."""
    return int(digits[-2:]) == 97 - int(digits[:-2]) % 97


def iban(number: str) -> bool:
    """The first four characters moved to the end, letters as numbers from 10: 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1


_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_AT_MARK = r"[\(\[\{<][ \t]?(?:at|AT|At)[ \t]?[\)\]\}>]"
_DOT_MARK = r"[\(\[\{<][ \t]?(?:dot|DOT|Dot)[ \t]?[\)\]\}>]"
_AT = rf"(?:[ \t]?{_AT_MARK}[ \t]?)"
_DOT = rf"(?:[ \t]?{_DOT_MARK}[ \t]?)"
EMAILS = [
    re.compile(rf"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*[@＠](?:{_LABEL}\.)+[A-Za-z]{{2,}}(?![\w@])"),
    re.compile(rf"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?:{_AT}|[@＠])(?:{_LABEL}(?:\.|{_DOT}))+[A-Za-z]{{2,}}(?![\w@])"),
    re.compile(rf"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?:{_AT}| at | AT ){_LABEL}(?:(?:{_DOT}| dot | DOT ){_LABEL})+(?![\w@])"),
    re.compile(r"(?<![\w.+-])[^\W_][\w.%+-]*[@＠](?:[^\W_][\w\u0900-\u0963-]*\.)+[^\W\d_](?:[^\W\d_]|[\u0900-\u0963])+(?![\w@\u0900-\u0963])"),  # names and domains of any script
]
#: Every form of EMAILS has one of these: ' at ' and ' AT ' count only with a dot in words.
_EMAIL_CUES = ("@", "＠", " dot ", " DOT ")
_EMAIL_MARK = re.compile(rf"{_AT_MARK}|{_DOT_MARK}")
PHONES = [  # numbers of known length first: what follows them may be a number of its own
    (5, re.compile(r"(?<![\w+])\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}(?![\w-])")),
    (5, re.compile(r"(?<![\w+])\+91[ .\-]?\d{5}[ .\-]?\d{5}(?![\w-])")),
    (5, re.compile(r"(?<![\w+])\+44[ .\-]?\d{4}[ .\-]?\d{3}[ .\-]?\d{3}(?![\w-])")),
    (4, re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .\-]?\(?\d{2,5}\)?){2,4}(?![\w-])")),
    (3, re.compile(r"(?<![\w(])\(\d{3}\) ?\d{3}[-. ]\d{4}(?![\w-])")),
    (2, re.compile(r"(?<![\w.+-])0\d{2,5}[ -]\d{5,8}(?![\w-])")),
    (2, re.compile(r"(?<![\w.+-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])")),
    (2, re.compile(r"(?<![\w.+\-/])[5-9]\d{9}(?![\w-])")),
    (1, re.compile(r"(?<![\w.+\-/])(?<!\d[ -])[6-9]\d{4}[ -]\d{5}(?![\w-])(?! \d)")),
    (1, re.compile(r"(?<![\w.+\-/])(?<!\d[ -])0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}(?![\w-])(?! \d)")),
]
IDS = [
    (1, verhoeff, re.compile(r"(?<![\w.+-])(?<!\d{4} )\d{4}([ -]?)\d{4}\1\d{4}(?![\w-])(?! \d{4}\b)")),
    (2, None, re.compile(r"(?<![\w-])[A-Z]{5}\d{4}[A-Z](?![\w-])")),
    (1, None, re.compile(r"(?<![\w-])[A-Z]\d{7}(?![\w-])")),
    (2, None, re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    (0, luhn, re.compile(r"(?<![\w.+-])\d{3}[ -]\d{3}[ -]\d{3}(?![\w-])")),
    (0, mod97, re.compile(r"(?<![\w.+-])[12] ?\d\d ?\d\d ?\d\d ?\d{3} ?\d{3} ?\d\d(?![\w-])")),
]
#: Numbers of cards and accounts: they have to pass their check, and cards without groups also need a word for them.
CARDS = re.compile(r"(?<![\w.+-])(?<!\d[ -])(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}|3\d{3}([ -]?)\d{6}\2\d{5})(?![\w-])(?! \d)")
CARD_CONTEXT = re.compile(r"(?i)\b(?:card|visa|mastercard|amex|rupay|credit|debit)\b|कार्ड")
ACCOUNTS = re.compile(r"(?<![\w.+-])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\w-])")
ID_CONTEXT = re.compile(
    r"(?i)\b(?:ID|identity|national|passport|tax|card|aadhaar|aadhar|PAN|SSN|licen[cs]e|voter)\b|ओळख|पहचान|आधार|पासपोर्ट|ओळखपत्र|पत्र क्र|परिचय|परवाना"
)
ID_AFTER = re.compile(r"(?i)^.{0,4}(?:copy attached|is on the form|was scanned|दर्ज|जोडले)")
NOT_PERSONAL = re.compile(
    r"(?i)\b(?:checksum|ticket|bytes|steps?|shard|fingerprint|epoch|loss|hash|order|invoice|version|build|seed|commit|run|port|isbn|doi|section)\b[^\n.!?।]{0,24}$"
)
NOT_PERSONAL_AFTER = re.compile(r"(?i)^[ \t]?\(?(?:order|ticket|invoice|build|commit|bytes|steps|tokens|rows|lines|records)\b")
PHONE_CONTEXT = re.compile(r"(?i)\b(?:tel|phone|mobile|cell|call|number|fax|whatsapp|reach|contact)\b|मो\.|दूरध्वनी|फ़ोन|फोन|मोबाईल|मोबाइल|संपर्क")

_CAP = r"[A-Z\u00c0-\u00d6\u00d8-\u00de][a-z\u00df-\u00f6\u00f8-\u017f]+"
_STREET = rf"(?:{_CAP} ){{1,4}}(?:Road|Rd\.?|Street|St\.?|Lane|Ln\.?|Avenue|Ave\.?|Marg|Nagar|Cross|Path|Colony|Drive|Dr\.?|Way|Close|Court|Square|Terrace)"
_PIN = r"(?:,?[ \t]*(?:[-–][ \t]*)?\d{6}(?!\d))"
_TOWN = rf"{_CAP}(?: {_CAP}(?={_PIN}))?"  # of two words only before a postal code, else a name may follow
_GAP = r",[ \t]*(?:\r?\n)?[ \t]*"
_DEVA = r"[ऀ-ॣॱ-ॿ]+"
ADDRESSES = [
    re.compile(rf"\b(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)(?: No\.)? \d+[A-Z]?{_GAP}(?:{_CAP} ){{1,3}}(?:Apartments?|Towers?|Heights|Society|House|Residency){_GAP}{_STREET}{_GAP}{_TOWN}{_PIN}?"),
    re.compile(rf"\b(?:House|Plot|Flat|Bungalow)(?: No\.?)? \d+(?:[-/]\w+)?{_GAP}{_STREET}{_GAP}(?:(?:Near|Opp\.?|Behind|Off) (?:{_CAP} ?)+{_GAP})?{_TOWN}{_PIN}?"),
    re.compile(rf"(?<![\w./-])\d{{1,4}}(?:-?[A-Z]|/\d+)?,? {_STREET}{_GAP}(?:(?:Near|Opp\.?|Behind|Off) (?:{_CAP} ?)+{_GAP})?{_TOWN}{_PIN}?"),
    re.compile(
        rf"(?:(?:घर|मकान|सदनिका|प्लॉट|बंगला|फ्लॅट|फ़्लैट|फ्लैट) (?:(?:क्र|नं|क्रमांक|नंबर)\.? )?)?(?<![\w./-])\d{{1,4}}(?:[-/][\w]+)?{_GAP}{_DEVA}(?: {_DEVA}){{0,3}} ?"
        rf"(?:मार्ग|गल्ली|गली|रोड|रस्ता|पथ|अपार्टमेंट|अपार्टमेंट्स|सोसायटी|सोसाइटी|नगर|चौक|पेठ|सड़क)(?:{_GAP}{_DEVA}(?: {_DEVA}){{0,2}} (?:मार्ग|गल्ली|गली|रोड|रस्ता|पथ))?{_GAP}{_DEVA}{_PIN}?"
    ),
]

_INITIAL = r"[A-Z]\."
NAME = rf"(?:(?:{_INITIAL} ?)+{_CAP}|{_CAP}(?: {_INITIAL})? {_CAP}|[A-Z]{{2,}}\.? [A-Z]{{3,}})"
REVERSED = rf"{_CAP}, (?:{_CAP}|{_INITIAL})"
_NL = r"[ \t]*\r?\n[ \t]*"
#: Each with what has to be in a text for the pattern to be tried at all.
CUED_NAMES = [
    # after a title
    (("Mr", "Ms", "Miss", "Dr", "Prof", "Shri", "Smt"), re.compile(rf"\b(?:Mr|Ms|Mrs|Miss|Dr|Prof|Shri|Smt)\.? (?:({REVERSED})(?= [a-z])|({NAME})|({_CAP})(?= [a-z]))")),
    # a copy, a role, someone to ask
    (("cc:", "Cc:", "CC:", "tator:", "lator:", "iewer:", "ditor:", "thor:", "peaker:", "reader:", "igned:", "ontact:", "ttn"), re.compile(rf"\b(?:[Cc]c|CC|Annotator|Translator|Reviewer|Editor|Author|Speaker|Proofreader|Signed|Contact|Attn)\.?: ({REVERSED}|{NAME})")),
    (("done by", "ed by", "itten by", "ask ", "asked ", "told ", "thank"), re.compile(rf"\b(?:done by|reviewed by|written by|checked by|translated by|ask|asked|told|thank|thanks to) ({REVERSED}|{NAME})")),
    # what a person does
    ((" wrote", " disagree", " rejected", " reviewed", " approved", " asked", " said", " thinks", " agree", " replied", " suggested", " annotated", " translated", " signed"), re.compile(rf"(?<![\w.])({REVERSED}|{NAME})(?= (?:wrote|disagrees|disagreed|rejected|reviewed|approved the|asked|said|thinks|agrees|agreed|replied|suggested|annotated|translated the|signed)\b)")),
    # whom somebody met or wrote to
    ((" met ", " called ", " emailed ", " phoned ", " interviewed ", " visited "), re.compile(rf"(?<=[a-zI] )(?:met|called|emailed|phoned|interviewed|visited) ({NAME})(?= (?:yesterday|today|tomorrow|last|this|on|at|in|about|again|and|to|before|after)\b|[.,;!?]|[ \t]*(?:[\r\n]|$))")),
    # greetings and signatures; here a given name alone counts
    (("Hi", "Hello", "Dear", "Hey"), re.compile(rf"\b(?:Hi|Hello|Dear|Hey),? ({NAME}|{_CAP})(?=,|[ \t]*[\r\n])")),
    (("Thanks,", "egards,", "Best,", "Cheers,", "Sincerely,", "Yours,", "thanks,"), re.compile(rf"\b(?:Thanks|Regards|Best|Cheers|Sincerely|Yours|Best regards|Kind regards|Warm regards|Many thanks),{_NL}({REVERSED}|{NAME}|{_CAP})(?=[ \t]*(?:[\r\n]|$))")),
    (("--",), re.compile(rf"(?:^|\n)--{_NL}({REVERSED}|{NAME}|{_CAP})(?=[ \t]*(?:[\r\n]|$))")),
]
_DNAME = rf"(?:(?:{_DEVA}\. ?)+{_DEVA}|{_DEVA},? {_DEVA})"
CUED_DEVA = [
    (("श्री", "सौ.", "डॉ.", "प्रा.", "कु.", "सुश्री"), re.compile(rf"(?<![ऀ-ॿ])(?:श्रीमती|श्री|सौ\.|डॉ\.|प्रा\.|कु\.|सुश्री|श्रीमान) ({_DNAME})")),
    (("कार:", "वादक:", "पादक:", "संपर्क:", "लेखक:", "क्षक:", "प्रति:"), re.compile(rf"(?<![ऀ-ॿ])(?:भाषांतरकार|अनुवादक|संपादक|संपर्क|लेखक|परीक्षक|समीक्षक|प्रति): ({_DNAME})")),
    (("कृपया ",), re.compile(rf"(?<![ऀ-ॿ])कृपया ({_DNAME})(?= (?:यांना|से|को|यांच्याशी))")),
]
#: What follows a name in Devanagari; the name is looked for backwards from it.
AFTER_DEVA = re.compile(r" (?:यांनी|यांना|यांच्याशी|यांच्याकडे|ने यह|ने इस|से पूछ|जी ने)(?![ऀ-ॿ])")
_DNAME_BEFORE = re.compile(rf"(?:^|(?<![ऀ-ॿ]))({_DEVA}\. ?{_DEVA}|{_DEVA},? {_DEVA})$")
_NAME_BEFORE = re.compile(rf"(?:^|(?<![\w.]))({REVERSED}|{NAME})$")
_STREETS = ("Road", "Rd", "Street", "St", "Lane", "Ln", "Avenue", "Ave", "Marg", "Nagar", "Cross", "Path", "Colony", "Drive", "Dr", "Way", "Close", "Court", "Square", "Terrace")
_DEVA_STREETS = ("मार्ग,", "गल्ली,", "गली,", "रोड,", "रस्ता,", "पथ,", "अपार्टमेंट,", "अपार्टमेंट्स,", "सोसायटी,", "सोसाइटी,", "नगर,", "चौक,", "पेठ,", "सड़क,", "मार्ग ,", "गल्ली ,")
#: Stretches that may hold a phone or an identity number: all their patterns need one of these.
_NUMBERS = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2}[A-Z0-9 ]*|[+(]?\d[\d().\- ]{7,}\d|[A-Z]{1,5}\d{4,}[A-Z]?")
_DEVA_DIGIT = re.compile("[०-९]")
NOT_NAMES = frozenset("The A An This That These Those There It Its We Their Our My Your Nobody Run Section Figure Table Old New Near House Flat No In On At Of And But Or".split())


class Names:
    """Given and family names of a list of people, and the endings that several family names share."""

    def __init__(self, given: list[str], family: list[str]):
        self.given, self.family = frozenset(given), frozenset(family)
        self.words = ahocorasick.Automaton()
        for w in self.given | self.family:
            self.words.add_word(w, len(w))
        if len(self.words):
            self.words.make_automaton()
        counts = Counter(x[-n:] for x in self.family for n in (2, 3, 4) if len(x) > n + 1)
        enough = max(4, len(self.family) // 60)
        often = {e: n for e, n in counts.items() if n >= enough}
        self.endings = tuple(sorted(e for e, n in often.items() if not any(x != e and x.endswith(e) and often[x] == n for x in often)))

    def family_like(self, word: str) -> bool:
        return word in self.family or (len(word) >= 4 and word.endswith(self.endings))

    def listed(self, text: str) -> Iterator[tuple[int, int]]:
        """Where names of the list stand as whole words."""
        for end, n in self.words.iter(text) if len(self.words) else ():
            a, b = end - n + 1, end + 1
            if not (a and _WORD.match(text, a - 1)) and not (b < len(text) and _WORD.match(text, b)):
                yield a, b


_WORD = re.compile(r"[\w@\u0900-\u0963]")


def _parts(name: str) -> list[str]:
    return [x for x in re.split(r"[ ,]+", name) if x and not x.endswith(".")]


def finds(text: str, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal information in a text, in order, without overlaps."""
    plain = text.translate(_DIGITS) if _DEVA_DIGIT.search(text) else text  # one digit for one: the positions stay
    spans: list[tuple[int, int, int, str]] = []
    if any(x in text for x in _EMAIL_CUES) or _EMAIL_MARK.search(text):
        for p in EMAILS:
            for m in p.finditer(plain):
                spans.append((9, m.start(), m.end(), "email"))
                at = m.start() - 3 if text.startswith(" | ", m.start() - 3) else m.start() - 2 if text.startswith(", ", m.start() - 2) else -1
                if at > 0:  # a name before its contact details
                    start = max(0, at - 80)
                    if n := _NAME_BEFORE.search(text[start:at]):
                        if _parts(n[1]) and _parts(n[1])[0].capitalize() not in NOT_NAMES:
                            spans.append((4, start + n.start(1), at, "name"))
                    elif n := _DNAME_BEFORE.search(text[start:at]):
                        _deva(spans, names, n[1], start + n.start(1))
    if any(x in text for x in _STREETS):
        spans += [(6, m.start(), m.end(), "address") for p in ADDRESSES[:3] for m in p.finditer(plain)]
    if any(x in text for x in _DEVA_STREETS):
        spans += [(6, m.start(), m.end(), "address") for m in ADDRESSES[3].finditer(plain)]
    for region in _NUMBERS.finditer(plain):
        a, b = region.start(), min(len(plain), region.end() + 2)
        for score, check, p in IDS:
            for m in p.finditer(plain, a, b):
                before = plain[max(0, m.start() - 36) : m.start()]
                near = re.split(r"[.!?।\n](?=\s)|\n", before.replace("क्र. ", "क्र  ").replace("no. ", "no  ").replace("No. ", "No  "))[-1]
                score_now = score + 2 * bool(ID_CONTEXT.search(near)) + bool(ID_AFTER.search(plain[m.end() : m.end() + 24])) - 4 * bool(NOT_PERSONAL.search(near))
                if check is not None:
                    score_now += check(re.sub(r"\D", "", m[0]))
                if score_now >= ACCEPT + 1 or (score == 2 and score_now >= ACCEPT):
                    spans.append((score_now + 2, m.start(), m.end(), "id_number"))
        for m in CARDS.finditer(plain, a, b):
            digits = re.sub(r"\D", "", m[0])
            near = plain[max(0, m.start() - 36) : m.end() + 12]
            if 13 <= len(digits) <= 19 and luhn(digits) and (len(digits) < len(m[0]) or CARD_CONTEXT.search(near)):
                spans.append((8, m.start(), m.end(), "id_number"))
        for m in ACCOUNTS.finditer(plain, a, b):
            number = m[0].replace(" ", "")
            if 15 <= len(number) <= 34 and iban(number):
                spans.append((8, m.start(), m.end(), "id_number"))
        for score, p in PHONES:
            for m in p.finditer(plain, a, b):
                before = plain[max(0, m.start() - 30) : m.start()]
                wrong = NOT_PERSONAL.search(before) or NOT_PERSONAL_AFTER.search(plain[m.end() : m.end() + 12])
                score_now = score + bool(PHONE_CONTEXT.search(before)) - 3 * bool(wrong)
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15 and score_now >= ACCEPT:
                    spans.append((score_now, m.start(), m.end(), "phone"))
    for cues, p in CUED_NAMES:
        if any(c in text for c in cues):
            for m in p.finditer(text):
                g = next(i for i in range(1, (m.lastindex or 0) + 1) if m[i])
                parts = _parts(m[g])
                if parts and parts[0].capitalize() not in NOT_NAMES:
                    spans.append((4, *m.span(g), "name"))
    for cues, p in CUED_DEVA:
        if any(c in text for c in cues):
            for m in p.finditer(text):
                _deva(spans, names, m[1], m.start(1))
    for m in AFTER_DEVA.finditer(text):
        start = max(0, m.start() - 60)
        if n := _DNAME_BEFORE.search(text[start : m.start()]):
            _deva(spans, names, n[1], start + n.start(1))
    for a, b in names.listed(text):  # people of the list, and those with a listed given name and a family name like theirs
        word = text[a:b]
        if word in names.given and (n := _NEXT.match(text, b)):
            if n[1] in names.family or (n[1][0].isupper() and names.family_like(n[1]) and word not in NOT_NAMES):
                spans.append((3, a, n.end(), "name"))
        if word in names.family and (n := _TURNED.match(text, b)) and n[1] in names.given:
            spans.append((3, a, n.end(), "name"))
        if word in names.family and a > 2 and text[a - 2 : a] == ". " and text[a - 3].isupper() and not (a > 3 and _WORD.match(text, a - 4)):
            spans.append((3, a - 3, b, "name"))
    return _apart(spans)


_NEXT = re.compile(rf" ({_CAP}|{_DEVA})(?![\w@])")
_TURNED = re.compile(rf", ({_CAP}|{_DEVA})(?![\w@])")


def _deva(spans: list[tuple[int, int, int, str]], names: Names, name: str, start: int) -> None:
    """A name in Devanagari beside a cue: it counts if one of its parts is listed or like a listed one."""
    parts = _parts(name)
    known = sum(x in names.given for x in parts[:1]) + sum(names.family_like(x) for x in parts[-1:]) + any(x in names.family for x in parts)
    if known:
        spans.append((3 + known, start, start + len(name), "name"))


def _apart(spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Of spans that overlap, the one with the higher score, then the longer; in order."""
    starts: list[int] = []
    kept: list[tuple[int, int, str]] = []
    for _, a, b, kind in sorted(set(spans), key=lambda x: (-x[0], x[1] - x[2], x[1], x[3])):
        i = bisect_left(starts, a)
        if (i == 0 or kept[i - 1][1] <= a) and (i == len(starts) or b <= starts[i]):
            starts.insert(i, a)
            kept.insert(i, (a, b, kind))
    return kept


def redacted(text: str, names: Names) -> str:
    out, at = [], 0
    for a, b, kind in finds(text, names):
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])


def listed(people: DataFrame, given: list[str], family: list[str]) -> Names:
    """The names of a list of people, which has to be bounded: it goes to every task."""
    rows = people.select(*given, *family).limit(MOST_PEOPLE + 1).collect()
    if len(rows) > MOST_PEOPLE:
        raise ValueError(f"the list has more than {MOST_PEOPLE} people")
    return Names([r[g] for r in rows for g in given if r[g]], [r[f] for r in rows for f in family if r[f]])


def found(docs: DataFrame, names: Names, record: str = "doc_id", text: str = "text") -> DataFrame:
    """record, kind, found_text: each passage once for each document."""
    held = docs.sparkSession.sparkContext.broadcast(names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in batches:
            rows: list[int] = []
            kinds: list[str] = []
            texts: list[str] = []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t:
                    for kind, passage in sorted({(kind, t[x:y]) for x, y, kind in finds(t, own)}):
                        rows.append(i)
                        kinds.append(kind)
                        texts.append(passage)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=["record", "kind", "found_text"])

    out = docs.select(F.col(record).cast("bigint").alias("record"), F.col(text).alias("text")).mapInArrow(scan, "record bigint, kind string, found_text string")
    return out.withColumnRenamed("record", record).distinct()


def replaced(docs: DataFrame, names: Names, record: str = "doc_id", text: str = "text") -> DataFrame:
    """record, text: every document with placeholders in place of its personal information."""
    held = docs.sparkSession.sparkContext.broadcast(names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in batches:
            texts = [redacted(t, own) if t else t for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["record", "text"])

    out = docs.select(F.col(record).cast("bigint").alias("record"), F.col(text).alias("text")).mapInArrow(scan, "record bigint, text string")
    return out.withColumnsRenamed({"record": record, "text": text})
