"""Text functions: Columns in, Columns out. Null texts give null, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode block of the target script; callers may pass another.
DEVANAGARI = r"[\x{0900}-\x{097F}]"
LATIN_WORD = r"[A-Za-z]{2,}"
SENTENCE_END = r"[.!?\x{0964}]+"
#: White space of any kind.
WHITE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"

# Code points counted as rare.
RARE = (
    r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}\x{0900}\x{0901}\x{093C}\x{094D}\x{0951}-\x{0954}"
    r"\x{0955}-\x{0957}\x{0962}\x{0963}\x{0970}\x{0971}]"
)
# Keywords of two domains.
LEGAL = [
    "कायदा", "न्यायालय", "न्यायाधीश", "कलम", "विधेयक", "अधिनियम", "याचिका", "फिर्याद", "खटला", "अपील", "दंड", "शिक्षा",
    "जामीन", "वकील", "साक्षीदार", "पुरावा", "आरोप", "निकाल", "सुनावणी", "घटना", "संविधान", "कोर्ट", "हायकोर्ट", "सुप्रीम",
    "जिल्हा न्यायालय", "फौजदारी", "दिवाणी", "कायदेशीर", "प्रतिवादी", "फिर्यादी",
]
MEDICAL = [
    "रुग्ण", "डॉक्टर", "वैद्यकीय", "उपचार", "शस्त्रक्रिया", "रक्त", "रोग", "लक्षणे", "औषध", "हृदय", "कर्करोग", "मधुमेह",
    "रुग्णालय", "दवाखाना", "तपासणी", "निदान", "आजार", "संसर्ग", "प्रतिकारशक्ती", "लसीकरण", "इंजेक्शन", "ऑपरेशन", "अस्थि",
    "मज्जातंतू", "दंतवैद्य", "नेत्र", "चिकित्सा", "पॅथॉलॉजी",
]
# What the categories are called.
LABELS = {
    "compound": "Long compound words",
    "mixed": "Code-mixed Marathi-English",
    "rare": "Rare Unicode / uncommon Devanagari",
    "short": "Very short sentence (< 5 words)",
    "legal": "Domain-specific: legal",
    "medical": "Domain-specific: medical",
    "other": "Other",
}
# Patterns that show a credential, and what stands for it.
SECRETS = [
    (r"(https://)[^/\s:@]+:[^/\s@]+(@)", "$1***:***$2"),
    (r"\b(gh[pousr]_[A-Za-z0-9]{16,})", "***redacted-token***"),
    (r"\bgithub_pat_[A-Za-z0-9_]{20,}", "***redacted-token***"),
    (r"\bhf_[A-Za-z0-9]{20,}", "***redacted-token***"),
    (r"(?i)\b[0-9a-f]{40}\b(?=[^\n]*wandb)", "***redacted-token***"),
    (r"(?i)\b(token|password|passwd|secret|api[-_]?key)\b(\"?\s*[:=]\s*\"?)([^\s\"',]{6,})", "$1$2***redacted***"),
]


def stripped(col: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(col, f"^{WHITE}+|{WHITE}+$", "")


def long_enough(col: Column, least: int = 5) -> Column:
    """More than so many characters without outer spaces."""
    return F.length(stripped(col)) > least


def words(col: Column) -> Column:
    """Runs between white space; an empty array for a blank text."""
    return F.filter(F.split(col, f"{WHITE}+"), lambda w: w != "")


def sentences(col: Column, end: str = SENTENCE_END, newline_is_space: bool = True) -> Column:
    """Trimmed parts between sentence ends, without empty ones."""
    text = F.translate(col, "\n", " ") if newline_is_space else col
    return F.filter(F.transform(F.split(text, end), lambda s: stripped(s)), lambda s: s != "")


def preview(col: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(col, 1, n)


def script_count(col: Column, block: str = DEVANAGARI) -> Column:
    return F.regexp_count(col, F.lit(block))


def is_mixed(col: Column, block: str = DEVANAGARI) -> Column:
    """The target script and a word in Latin letters."""
    return col.rlike(block) & col.rlike(LATIN_WORD)


def has_compound(col: Column, block: str = DEVANAGARI, least: int = 15) -> Column:
    return col.rlike(f"{block}{{{least},}}")


def rare_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(RARE))


def keyword_count(col: Column, lexicon: list[str]) -> Column:
    """How many different keywords occur."""
    return sum((F.when(F.contains(col, F.lit(k)), 1).otherwise(0) for k in lexicon), F.lit(0))


def categories(col: Column) -> Column:
    """All labels of a text in fixed order; 'Other' if there are none."""
    legal, medical = keyword_count(col, LEGAL), keyword_count(col, MEDICAL)
    domain = F.when((legal >= 2) | (medical >= 2), F.when(legal >= medical, F.lit(LABELS["legal"])).otherwise(F.lit(LABELS["medical"])))
    found = F.filter(
        F.array(
            F.when(has_compound(col), F.lit(LABELS["compound"])),
            F.when(is_mixed(col), F.lit(LABELS["mixed"])),
            F.when(rare_count(col) >= 2, F.lit(LABELS["rare"])),
            F.when(F.size(words(col)) < 5, F.lit(LABELS["short"])),
            domain,
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(col.isNotNull(), F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(LABELS["other"]))))


def redacted(col: Column) -> Column:
    """Credentials masked."""
    for pattern, stand_in in SECRETS:
        col = F.regexp_replace(col, pattern, stand_in)
    return col


def secrets(col: Column) -> Column:
    """How many credentials there are, counted pattern after pattern as they are masked."""
    hits = F.lit(0)
    for pattern, stand_in in SECRETS:
        hits = hits + F.regexp_count(col, F.lit(pattern))
        col = F.regexp_replace(col, pattern, stand_in)
    return hits


def last_lines(col: Column, n: int) -> Column:
    """The last n lines of a text."""
    lines = F.split(col, "\n")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n), "\n")


def byte_values(col: Column) -> Column:
    """UTF-8 bytes as numbers, through pairs of hexadecimal digits: linear in the text's length."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(col, "UTF-8")), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))


def byte_tokens(col: Column, offset: int = 4) -> Column:
    """Byte ids with the first ones left for special tokens."""
    return F.transform(byte_values(col), lambda b: b + offset)


def text_of_tokens(tokens: Column, offset: int = 4) -> Column:
    """The text of byte ids; ids that are no bytes are left out, malformed parts become U+FFFD."""
    kept = F.filter(tokens, lambda t: (t >= offset) & (t < 256 + offset))
    digits = F.array_join(F.transform(kept, lambda t: F.lpad(F.hex((t - offset).cast("bigint")), 2, "0")), "")
    return F.make_valid_utf8(F.unhex(digits).cast("string"))


def sentence_seed(doc: Column, position: Column) -> Column:
    """The seed of a sentence's noise: a document has a thousand of them."""
    return doc * 1000 + position


def string_seed(label: str, seed: Column, noise: Column, position: Column) -> Column:
    """A seed that is drawn from a label, a run's seed, the noise and the position: 31 bits of an MD5 sum."""
    return draw(F.lit(label), seed.cast("string"), noise.cast("string"), position.cast("string")) % (1 << 31)


def model_name(col: Column) -> Column:
    """Lower case, underscores for spaces and hyphens."""
    return F.translate(F.lower(F.trim(col)), "- ", "__")


def metric_name(col: Column) -> Column:
    return F.when(F.lower(col).rlike(r"^chrf2?\+\+$"), F.lit("chrF++")).otherwise(col)


def draw(*parts: Column) -> Column:
    """A number from 0 to 2**32 - 1 that only depends on the parts: the first eight hexadecimal digits of an MD5 sum."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")
