"""The consistent form of a text, and its words.

``consistent(col)`` gives a Column, ``to_consistent(str)`` is the same for one Python string.

Method: compatibility normalisation (width, ligatures, spaces) and deletion of ignorable characters
come first; then every word whose letters come from more than one of the Latin, Greek and Cyrillic
scripts (or Armenian, Cherokee, Coptic and Lisu, whose capitals pass for Latin ones) is resolved on a lattice: each letter has itself and its look-alikes as alternatives, and a
Viterbi search under script-consistent character bigram scores takes the best path that stays in one
script. Devanagari vowels, signs and eyelash ra written with other characters' pieces are put
together last, and the result is in the standard composed form.

Only texts that a JVM pattern finds suspicious cross to Python (``needs_work``), all others are already
in the consistent form. The patterns are built from the Unicode database, so they can't miss one.

Defined results: null stays null, an empty text stays empty, texts of any length are taken whole.
"""

from __future__ import annotations

import math
import re
import unicodedata as ud
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Look-alike letters. Each group holds letters that are drawn alike.
LOOK_ALIKES = [
    "aаα", "bЬ", "cсϲ", "dԁ", "eе", "gɡ", "hһ", "iіι", "jјϳ", "kкκ", "lӏ", "nпη", "oоοσ", "pрρ", "qԛ",
    "rг", "sѕ", "uυ", "vνѵ", "wԝω", "xхχ", "yуγ", "AАΑ", "BВΒ", "CСϹ", "EЕΕ", "HНΗ", "IІΙӀ", "lӀІ",
    "JЈ", "KКΚ", "MМΜ", "NΝ", "OОΟ", "PРΡ", "QԚ", "SЅ", "TТΤ", "WԜ", "XХΧ", "YУΥҮ", "ZΖ",
]

# How the Unicode standard says not to write a Devanagari vowel or sign, and its own character.
DEVANAGARI_PIECES = {
    "\u0905\u0946": "\u0904", "\u0905\u093e": "\u0906", "\u0930\u094d\u0907": "\u0908", "\u0909\u0941": "\u090a",
    "\u090f\u0945": "\u090d", "\u090f\u0946": "\u090e", "\u090f\u0947": "\u0910", "\u0905\u0949": "\u0911",
    "\u0906\u0945": "\u0911", "\u0905\u094a": "\u0912", "\u0906\u0946": "\u0912", "\u0905\u094b": "\u0913",
    "\u0906\u0947": "\u0913", "\u0905\u094c": "\u0914", "\u0906\u0948": "\u0914", "\u0905\u0945": "\u0972",
    "\u093e\u0945": "\u0949", "\u093e\u0946": "\u094a", "\u093e\u0947": "\u094b", "\u093e\u0948": "\u094c",
}

# Letters of further scripts and what they look like. They only count beside letters of another script.
FURTHER = [
    "oօ", "nո", "uս", "hհ", "gց", "qզ", "fք", "jյ", "lլ", "UՍ", "SՏ", "OՕ", "LԼ",
    "DᎠ", "RᎡ", "TᎢ", "iᎥ", "AᎪ", "JᎫ", "EᎬ", "MᎷ", "HᎻ", "WᎳ", "GᏀ", "hᏂ", "ZᏃ", "bᏏ", "SᏚ", "VᏙ", "LᏞ", "CᏟ", "PᏢ", "KᏦ", "dᏧ", "BᏴ",
    "oⲟ", "pⲣ", "cⲥ", "OⲞ", "PⲢ", "CⲤ", "MⲘ", "NⲚ", "TⲦ", "KⲔ", "HⲎ",
    "BꓐPꓑDꓓTꓔGꓖKꓗJꓙCꓚZꓜFꓝMꓟNꓠLꓡSꓢRꓣVꓦHꓧWꓪXꓫYꓬAꓮEꓰIꓲOꓳUꓴ",
]

#: Letter frequencies by bigram come from frequent words of a language in each script; only ambiguous look-alikes depend on them.
GREEK_WORDS = (
    "και το να του η της με που την από για είναι στο δεν τα των στην οι θα τη ότι σε τον μια αυτό ήταν ο αλλά ένα όπως μας σας πως όταν "
    "πολύ μου σου κάτι μόνο εδώ τώρα πριν μετά χρόνια κόσμος άνθρωπος ζωή ημέρα λόγος έργο πόλη χώρα σπίτι νερό γυναίκα παιδί μέρα νύχτα "
    "φορά λέει έχει κάνει ξέρει θέλει μπορεί πρέπει βλέπει καλά μεγάλο μικρό νέο άλλο όλα πρώτο δύο τρία γλώσσα λέξη βιβλίο όμως τους στη "
    "στον στα στους κατά προς χωρίς μέχρι γιατί ποιος τίποτα κάποιος πάντα ποτέ μαζί μέσα έξω πάνω κάτω χέρι μάτι όνομα τρόπος μέρος ώρα"
)
CYRILLIC_WORDS = (
    "и в не на я что он с как а то это по но из у за вы так же от все бы о его до для мы они ни если уже или быть был была было были когда "
    "даже нет ли её под чтобы где есть вот кто сам время год дело жизнь день рука раз человек мир дом слово место лицо друг глаз вопрос сторона "
    "страна работа час город земля вода книга язык школа новый большой первый хороший другой последний свой наш мой твой какой такой можно надо "
    "очень только ещё тоже там здесь теперь после перед между через без при два три один сказать знать думать видеть говорить хотеть идти жить "
    "работать сделать дать взять понять пойти стать сила конец народ право вид начало потом несколько"
)
LATIN_WORDS = (
    "the of and to in that is was it for with as his on be at by had not are but from or have they which one you were "
    "all her she there would their we him been has when who will no more if out so said what up its about than into them "
    "can only other new some could time these two may then do first any my now such like our over man me even most made "
    "after also did many before must through back years where much your way well down should because each just those "
    "people how too little state good very make world still own see men work long here get both between life being under "
    "never day same another know while last might us great old year off come since against go came right used take three"
)

#: Of these, the ones that look only roughly alike; a path through them costs more.
ROUGH = "Ьпηгγυ"

ZWJ = "\u200d"
_INVISIBLE_EXTRA = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x180F, 0x3164, 0xFFA0}
_COMPAT_TAGS = {"<wide>", "<narrow>", "<font>"}


def _is_invisible(cp: int) -> bool:
    return ud.category(chr(cp)) == "Cf" or cp in _INVISIBLE_EXTRA or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF


def _compat(cp: int) -> str | None:
    """The plain form of a character of other width, a ligature or an odd space; None where it has none."""
    c = chr(cp)
    if ud.category(c) == "Zs":
        return None if c == " " else " "
    tag, *points = ud.decomposition(c).split() or [""]
    if tag in _COMPAT_TAGS or (tag == "<compat>" and ("LIGATURE" in ud.name(c, "") or "DIGRAPH" in ud.name(c, ""))):
        return ud.normalize("NFKC", c)
    return None


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[int, str], set[int]]:
    scan = [*range(0xA0, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE01F0)]
    return {cp: s for cp in scan if (s := _compat(cp)) is not None}, {cp for cp in scan if _is_invisible(cp)}


def _script(c: str) -> str:
    cp = ord(c)
    if cp < 0x250 or 0x1E00 <= cp < 0x1F00:
        return "L"
    if 0x370 <= cp < 0x400 or 0x1F00 <= cp < 0x2000:
        return "G"
    for script, first, end in _BLOCKS:
        if first <= cp < end:
            return script
    return "L" if ud.name(c, "").startswith("LATIN") else "?"


#: Cyrillic, Armenian, Cherokee, Coptic, Lisu.
_BLOCKS = [("C", 0x400, 0x530), ("A", 0x530, 0x590), ("K", 0x13A0, 0x1400), ("K", 0xAB70, 0xABC0), ("O", 0x2C80, 0x2D00), ("S", 0xA4D0, 0xA500)]
_SCRIPTS = "LGCAKOS"


@lru_cache(maxsize=1)
def _alternatives() -> dict[str, dict[str, list[str]]]:
    """letter -> script -> the letters of that script that look like it."""
    out: dict[str, dict[str, list[str]]] = {}
    lisu = FURTHER[-1]
    for group in [*LOOK_ALIKES, *FURTHER[:-1], *(lisu[i : i + 2] for i in range(0, len(lisu), 2))]:
        for a in group:
            for b in group:
                slot = out.setdefault(a, {}).setdefault(_script(b), [])
                if b not in slot and not (a != b and _script(a) == _script(b)):
                    slot.append(b)
    return out


@lru_cache(maxsize=1)
def _bigrams() -> dict[str, dict[str, float]]:
    """script -> bigram -> its log share, from the words of the script with and without their accents."""
    out = {}
    for script, text in (("L", LATIN_WORDS), ("G", GREEK_WORDS), ("C", CYRILLIC_WORDS)):
        counts: dict[str, int] = {}
        for w in text.split():
            bare = "".join(c for c in ud.normalize("NFD", w) if not ud.combining(c))
            for x in {w, bare} if script == "G" else {w}:
                for a, b in zip("^" + x, x + "$"):
                    counts[a + b] = counts.get(a + b, 0) + 1
        total = sum(counts.values())
        out[script] = {k: math.log((n + 0.1) / (total + 70)) for k, n in counts.items()}
    return out


_RARE = math.log(0.1 / 600)
#: Scores of a path: a step in a script without a model, a letter kept, a rough look-alike, the text's main script.
_FLAT, _KEPT, _ROUGHLY, _MAIN = -8.0, 2.0, -6.0, 6.0


def _step(script: str, a: str, b: str) -> float:
    model = _bigrams().get(script)
    if model is None:
        return _FLAT
    case = -1.0 if b.isupper() and a.islower() else 0.0
    return case + model.get(a.lower() + b.lower(), _RARE)


def _main_script(text: str) -> str:
    """The one of the scripts in which most letters of a text are."""
    counts = dict.fromkeys(_SCRIPTS, 0)
    for c in text:
        if c.isalpha() and (s := _script(c)) in counts:
            counts[s] += 1
    return max(_SCRIPTS, key=counts.__getitem__)


def _resolve(word: str, main: str) -> str:
    """A word with letters of several scripts -> the best path through its look-alike lattice in one script.

    main: the script of most of the text's letters, preferred where a word can be read in several."""
    alts = _alternatives()
    bases = [(i, c) for i, c in enumerate(word) if _script(c) in _SCRIPTS and c.isalpha()]
    scripts = {_script(c) for _, c in bases}
    if len(scripts) < 2:
        return word
    best, best_score = word, -math.inf
    for script in sorted(scripts):
        layers = [[c] if _script(c) == script else alts.get(c, {}).get(script, []) for _, c in bases]
        decomposed = [ud.normalize("NFD", c) for _, c in bases]
        for k, (layer, d) in enumerate(zip(layers, decomposed)):
            if not layer and len(d) > 1:  # an accented letter: its base has the look-alike
                layers[k] = [ud.normalize("NFC", x + d[1:]) for x in alts.get(d[0], {}).get(script, [])]
        if not all(layers):
            continue
        start = _KEPT * sum(_script(c) == script for _, c in bases) + _MAIN * (script == main)
        paths = {"^": (start, [])}
        for layer, (_, own) in zip(layers, bases):
            nxt: dict[str, tuple[float, list[str]]] = {}
            for b in layer:
                rough = _ROUGHLY * (b != own and (b in ROUGH or own in ROUGH))
                s, path = max(((s + rough + _step(script, a, b), p) for a, (s, p) in paths.items()), key=lambda x: x[0])
                nxt[b] = (s, [*path, b])
            paths = nxt
        score, path = max(((s + _step(script, a, "$"), p) for a, (s, p) in paths.items()), key=lambda x: x[0])
        if score > best_score:
            chars = list(word)
            for (i, _), c in zip(bases, path):
                chars[i] = c
            best, best_score = "".join(chars), score
    return best


_MIXED_WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}]*[\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}\p{Coptic}\p{Lisu}][\p{L}\p{M}\p{Nd}]*")
_HAS_LOOK_ALIKES = re.compile("[\u0370-\u058f\u13a0-\u13ff\u1f00-\u1fff\u2c80-\u2cff\ua4d0-\ua4ff\uab70-\uabbf]")
_EYELASH = re.compile("\u0930\u094d\u200d(?=[\u0915-\u0939\u0958-\u095f])")
_COLON_SIGN = re.compile("(?<=[\u0904-\u0939\u093e-\u094c\u0958-\u0961]):(?=[\u0904-\u0939\u0958-\u0961])")
_PIECES = re.compile("|".join(sorted(DEVANAGARI_PIECES, key=len, reverse=True)))
#: An emoji with what belongs to it: joiners, variation selectors, skin tones, tags.
_EMOJI = regex.compile(
    r"[\p{Extended_Pictographic}\p{Regional_Indicator}][\p{EMod}\ufe0f\ufe0e\u20e3\U000e0020-\U000e007f]*"
    r"(?:\u200d\p{Extended_Pictographic}[\p{EMod}\ufe0f\ufe0e\U000e0020-\U000e007f]*)*"
)


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    compat, invisible = _tables()
    chars = lambda cps: "[" + "".join(f"\\U{cp:08x}" for cp in sorted(cps)) + "]"
    return re.compile(chars(compat)), re.compile(chars(invisible))


def to_consistent(text: str | None) -> str | None:
    """The consistent form of one text; None stays None."""
    if not text or text.isascii():
        return text
    compat, _ = _tables()
    compat_re, invisible_re = _patterns()
    if invisible_re.search(text):
        kept: list[str] = []
        at = 0
        for m in _EMOJI.finditer(text):
            if len(m[0]) > 1:
                kept += (_strip(text[at : m.start()]), m[0])
                at = m.end()
        text = "".join([*kept, _strip(text[at:])])
    text = compat_re.sub(lambda m: compat[ord(m[0])], text)
    text = ud.normalize("NFC", text)
    if _HAS_LOOK_ALIKES.search(text):
        main = _main_script(text)
        text = ud.normalize("NFC", _MIXED_WORD.sub(lambda m: _resolve(m[0], main), text))
    text = _COLON_SIGN.sub("\u0903", text)
    while _PIECES.search(text):
        text = _PIECES.sub(lambda m: DEVANAGARI_PIECES[m[0]], text)
    return text


def _strip(text: str) -> str:
    """Without invisible characters; a joiner that makes ra an eyelash ra becomes that letter."""
    invisible = _patterns()[1]
    text = invisible.sub(lambda m: ZWJ if m[0] == ZWJ else "", text)
    return _EYELASH.sub("\u0931\u094d", text).replace(ZWJ, "")


@lru_cache(maxsize=1)
def patterns() -> tuple[str, str]:
    """Two Java patterns: a text is sure to be in the consistent form if the first matches and the second isn't found."""
    compat, invisible = _tables()
    second = set()  # characters that may compose with the one before them
    for cp in range(0xC0, 0x10000):
        d = ud.decomposition(chr(cp))
        if d and d[0] != "<" and " " in d:
            second.add(int(d.split()[1], 16))
    indic_second = {0x09BE, 0x09D7, 0x0BBE, 0x0BD7}

    def safe(cp: int) -> bool:
        c = chr(cp)
        if cp in compat or cp in invisible or not ud.is_normalized("NFC", c):
            return False
        if cp in indic_second or cp in (0x094D, 0x09CD, 0x0ACD, 0x0BCD):
            return True
        if cp in second or ud.combining(c):
            return False
        return cp in (9, 10, 13) or not (ud.category(c) in ("Cc", "Cn", "Co", "Cs") or 0x370 <= cp < 0x530 or 0x1F00 <= cp < 0x2000)

    blocks = [(0x09, 0x17F), (0x0900, 0x0BFF), (0x2010, 0x2027)]  # few ranges keep the pattern fast; what lies outside goes to Python
    gaps = lambda cp: not ud.name(chr(cp), "") and cp > 0xA0  # noqa: E731  unassigned: joins ranges, not met in texts of this Unicode
    ranges: list[list[int]] = []
    for a, b in blocks:
        open_range = False
        for cp in range(a, b + 1):
            if safe(cp):
                if open_range:
                    ranges[-1][1] = cp
                else:
                    ranges.append([cp, cp])
                open_range = True
            elif not gaps(cp):
                open_range = False
    # a run of one block after another: the fewer ranges a class has, the faster; spaces go with Devanagari
    by_block: dict[int, list[str]] = {}
    for a, b in sorted(ranges, key=lambda r: (not r[0] - 1 <= 0x93C <= r[1] + 1, r[0] - r[1])):  # the two around the nukta are most of Devanagari
        by_block.setdefault(a >> 7, []).append(f"\\x{{{a:x}}}-\\x{{{b:x}}}" if b > a else f"\\x{{{a:x}}}")
    deva = by_block.pop(0x900 >> 7)
    by_block.pop(0)
    classes = [" " + "".join(deva[:2]), r"\t\n\r -~", "".join(deva[2:]), *("".join(by_block[k]) for k in sorted(by_block, key=lambda k: (k != 0x2010 >> 7, k)))]
    plain = "^(?:" + "|".join(f"[{c}]++" for c in classes) + ")*+\\z"
    pieces = [*DEVANAGARI_PIECES, "\u094d\u0907", "\u09c7\u09be", "\u09c7\u09d7", "\u0bc6\u0bbe", "\u0bc6\u0bd7", "\u0bc7\u0bbe", "\u0b92\u0bd7"]
    firsts, seconds = ("".join(sorted({k[i] for k in pieces if len(k) == 2})) for i in (0, 1))
    signs = "".join(c for c in seconds if not "\u093e" <= c <= "\u094c")
    return plain, f"[\u093e-\u094c{signs}](?<=[{firsts}].)"  # a few more pairs than there are pieces: they only go to Python


@F.pandas_udf(T.StringType())
def _consistent_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([to_consistent(t) if isinstance(t, str) else None for t in texts], dtype=object)


def needs_work(col: Column) -> Column:
    """Whether a text might differ from its consistent form; null for null."""
    plain, pieces = patterns()
    colon = F.contains(col, F.lit(":")) & col.rlike(":[\u0904-\u0939]")
    return (F.length(col) < F.octet_length(col)) & (~col.rlike(plain) | colon | col.rlike(pieces))  # ASCII is as it should be


def consistent(col: Column) -> Column:
    """The consistent form of a text column. Only suspicious texts leave the JVM."""
    return F.coalesce(_consistent_udf(F.when(needs_work(col), col)), col)


def words(col: Column) -> Column:
    """The words of a text that is already in the consistent form; an empty array for null."""
    found = F.array_remove(F.split(F.lower(col), r"[^\p{L}\p{M}\p{Nd}]+"), "")
    return F.coalesce(found, F.array().cast("array<string>"))


_WORDS = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")


def words_of(text: str | None) -> list[str]:
    """The words of one text, consistent form included."""
    return _WORDS.findall(to_consistent(text).lower()) if text else []


def changed(df: DataFrame, tbl: str, record: str, fields: list[str]) -> DataFrame:
    """tbl, rec_id, field of every value of the fields that differs from its consistent form. Only the
    suspicious values reach Python; a null value isn't a case."""
    values = df.select(
        F.col(record).cast("bigint").alias("rec_id"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x"),
    ).select("rec_id", "x.field", "x.value")
    return (
        values.where(needs_work(F.col("value")))
        .where(_consistent_udf("value") != F.col("value"))
        .select(F.lit(tbl).alias("tbl"), "rec_id", "field")
    )


def found(parts: list[DataFrame]) -> DataFrame:
    """The parts together, each row once."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def rewritten(df: DataFrame, tbl: str, record: str, fields: list[str]) -> DataFrame:
    """tbl, rec_id, field, text: every value of the fields in the consistent form."""
    values = df.select(
        F.col(record).cast("bigint").alias("rec_id"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x"),
    )
    return values.select(F.lit(tbl).alias("tbl"), "rec_id", "x.field", consistent(F.col("x.value")).alias("text"))
