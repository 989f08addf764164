"""Languages and personal information."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from patchwright.llm import language, pii


@pytest.fixture(scope="module")
def fit(spark, sf):
    return language.fitted(spark.read.parquet(f"{sf}/language_samples.parquet").where("sample_id % 4 <> 0"), spark.read.parquet(f"{sf}/language_panel.parquet"))


def test_held_out_sentences(spark, sf, fit):
    held = spark.read.parquet(f"{sf}/language_samples.parquet").where("sample_id % 4 = 0")
    got = language.languages(language.stretches(held, "sample_id", "sample_text", fit, ["lang"])).collect()
    right = sum(r["main"] == r["lang"] and r["langs"] == [r["lang"]] for r in got)
    assert len(got) > 80 and right >= 0.99 * len(got)


def test_mixed_sentences(spark, sf, fit):
    rows = [(r["lang"], r["sample_text"]) for r in spark.read.parquet(f"{sf}/language_samples.parquet").where("sample_id % 4 = 0").collect()]
    random.seed(4)
    mixed = []
    for i in range(150):
        (a, x), (b, y) = random.sample(rows, 2)
        if a != b and min(len(language.words_of(x)), len(language.words_of(y))) >= 6:
            mixed.append((i, f"{x} {y}", sorted([a, b])))
    df = spark.createDataFrame(mixed, "id bigint, t string, want array<string>")
    got = language.languages(language.stretches(df, "id", "t", fit, ["want"])).collect()
    assert sum(sorted(r["langs"]) == r["want"] for r in got) >= 0.97 * len(mixed) > 50


def test_defined_results(spark, sf, fit):
    panel = spark.read.parquet(f"{sf}/language_panel.parquet")
    mar = "हा मोठा वारा गाडीपासून शेतकऱ्यापर्यंत मुद्दाम बांधले होता."
    rows = [(1, None, "mr"), (2, " ", None), (3, "?!", "en"), (4, mar, " MR "), (5, mar, None), (6, mar, "und"), (7, mar, "hi"), (8, mar, "xx"), (9, mar * 3000, "mar_Deva"), (10, mar + " Nobody sold the map before noon.", "mr"), (11, mar + " report form", "mr"), (5, mar, None)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "id bigint, t string, label string, rec_id string, stretches string")
    got = {tuple(r) for r in language.cases(df, "x", "id", "t", "label", panel, fit).collect()}
    assert got == {("x", 5, "mar_Deva"), ("x", 6, "mar_Deva"), ("x", 7, "mar_Deva"), ("x", 8, "mar_Deva"), ("x", 10, "mar_Deva"), ("x", 10, "eng_Latn")}
    s = language.stretches(df, "id", "t", fit).where("rec_id = 10").first()["stretches"]
    assert [x["lang"] for x in s] == ["mar_Deva", "eng_Latn"] and all(0 <= x["confidence"] <= 1 for x in s)
    assert language.cases(df.limit(0), "x", "id", "t", "label", panel, fit).count() == 0


def test_many_languages():
    """More languages than a slot's word has bits."""
    rng = random.Random(2)
    langs = [f"l{i:03d}" for i in range(100)]
    spoken = {lang: ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(60)] for lang in langs}
    f = language.Filter([(lang, " ".join(ws)) for lang, ws in spoken.items()], langs)
    for k in (0, 31, 32, 63, 64, 99):
        assert [s[:3] for s in f.text(rng.sample(spoken[langs[k]], 8))] == [(0, 8, k)]
    assert [s[2] for s in f.text(spoken["l033"][:8] + spoken["l065"][:8])] == [33, 65]


PROBES = [
    ("my card 4111 1111 1111 1111 expires", [("id_number", "4111 1111 1111 1111")]),
    ("numbers 4111 1111 1111 1112 in a row", []),
    ("card: 4111111111111111.", [("id_number", "4111111111111111")]),
    ("IBAN GB82 WEST 1234 5698 7654 32 ok", [("id_number", "GB82 WEST 1234 5698 7654 32")]),
    ("IBAN DE89370400440532013000.", [("id_number", "DE89370400440532013000")]),
    ("IBAN DE89370400440532013001.", []),
    ("फोन 98765 43210", [("phone", "98765 43210")]),
    ("phone 020 7946 0958 now", [("phone", "020 7946 0958")]),
    ("rows 020 7946 0958 now", []),
    ("221B Baker Street, London", [("address", "221B Baker Street, London")]),
    ("I met John Smith yesterday", [("name", "John Smith")]),
    ("José Álvarez signed it", [("name", "José Álvarez")]),
    ("write to info@bücher.example now", [("email", "info@bücher.example")]),
    ("लिहा a@उदाहरण.भारत येथे", [("email", "a@उदाहरण.भारत")]),
    ("9876543210 order id", []),
    ("call 9876543210 now", [("phone", "9876543210")]),
]


@pytest.mark.parametrize(("text", "want"), PROBES)
def test_ordinary_text(text, want):
    names = pii.Names(["Asha"], ["Rao"])
    assert [(kind, text[a:b]) for a, b, kind in pii.finds(text, names)] == want


def test_search_counts_unclear_words():
    f = language.Filter([], ["a", "b", "c"])
    random.seed(8)
    f.cache = {"x": [0.0, -1.0, -2.0], **{f"u{i}": [-0.7, 0.0, -0.5] for i in range(9)}}
    assert [s[:3] for s in f.text(["x", *(f"u{i}" for i in range(9))])] == [(0, 10, 1)]  # nine unclear words outweigh a clear one
    for _ in range(300):
        n = random.randint(1, 6)
        logs = [[-random.choice([0, 0.5, 2, 6]) * random.random() for _ in range(3)] for _ in range(n)]
        logs = [[x - max(row) for x in row] for row in logs]
        f.cache = {f"w{i}": row for i, row in enumerate(logs)}
        stops = [random.random() < 0.3 for _ in range(n)]
        price = [0.0] + [language.CHANGE_SENTENCE if e else language.CHANGE for e in stops[:-1]]
        score = lambda path: sum(logs[i][k] - (i > 0 and path[i - 1] != k) * price[i] for i, k in enumerate(path))
        got = [k for _, m, k, _ in f.text([t for i in range(n) for t in ([f"w{i}", "."] if stops[i] else [f"w{i}"])]) for _ in range(m)]
        assert len(got) == n and abs(score(got) - max(map(score, itertools.product(range(3), repeat=n)))) < 1e-9


def test_false_positives_are_rare(fit):
    assert max(fit.false) < 1e-3


PEOPLE = pii.Names(["Leton", "Haro", "लेटोन"], ["Shapedish", "Dumare", "Likavan", "शापेदिश"])
CASES = {
    "Write to a.b+c@example.com, or x_y [at] lab [dot] example [dot] com.": [("email", "a.b+c@example.com"), ("email", "x_y [at] lab [dot] example [dot] com")],
    "see @river and blt_lcm@0.1 #x": [],
    "Tel. +91-5551835007 or (212) 555-0107, मो. ०५५५५६ ०५७९६ / 055582-54804": [("phone", "+91-5551835007"), ("phone", "(212) 555-0107"), ("phone", "०५५५५६ ०५७९६"), ("phone", "055582-54804")],
    "+1 312 555 0143 3899 trains, +91 55598 19847 12 cars": [("phone", "+1 312 555 0143"), ("phone", "+91 55598 19847")],
    "Checksum 976494424000 for shard 1. Ticket 2025-8567-5922 is open. Bytes 8803 4506 7935 per worker.": [],
    "For it: national ID 6521 7649 6813. ओळख क्रमांक २१७१ ७६५७ ९३६३": [("id_number", "6521 7649 6813"), ("id_number", "२१७१ ७६५७ ९३६३")],
    "passport Q1234567, Tax code ABCDE1234F, ID no. 000-12-3456": [("id_number", "Q1234567"), ("id_number", "ABCDE1234F"), ("id_number", "000-12-3456")],
    "I moved to Flat 22, Neelgath Apartments, Lower Canal Rd., Durvasari - 414515; ok": [("address", "Flat 22, Neelgath Apartments, Lower Canal Rd., Durvasari - 414515")],
    "\n7 Third Cross Avenue,\nRukhnav 418887\n": [("address", "7 Third Cross Avenue,\nRukhnav 418887")],
    "करार घर क्र. २३७, पिरोवड मार्ग, वरनोगाव 437160 येथे पाठवा.": [("address", "घर क्र. २३७, पिरोवड मार्ग, वरनोगाव 437160")],
    "68 ledgers on Belvador Road were counted in March": [],
    "Dear Hirun,\ncc: R. Tewick\nMs. Lelesh Juwick rejected both. Reviewed by Dr. Zomuwick, Fivulil last week.": [("name", "Hirun"), ("name", "R. Tewick"), ("name", "Lelesh Juwick"), ("name", "Zomuwick, Fivulil")],
    "Leton Shapedish said so. श्रीमती लेटोन शापेदिश यांच्याशी": [("name", "Leton Shapedish"), ("name", "लेटोन शापेदिश")],
    "Leton Likavan | leton.likavan@example.com": [("name", "Leton Likavan"), ("email", "leton.likavan@example.com")],
    "": [],
}


@pytest.mark.parametrize("text", CASES)
def test_finds(text):
    assert [(k, text[a:b]) for a, b, k in pii.finds(text, PEOPLE)] == CASES[text]


@pytest.mark.parametrize("address", ["x at y [dot] com", "x at y(dot)com", "x at y DOT com", "x ( at ) y.com", "x [At] y.com"])
def test_disguised_addresses(address):
    text = f"Leton Likavan | {address}, please"
    assert [(k, text[a:b]) for a, b, k in pii.finds(text, PEOPLE)] == [("name", "Leton Likavan"), ("email", address)]
    assert pii.redacted(f"to {address}, please", PEOPLE) == "to [EMAIL], please"


def test_no_form_of_an_address_is_skipped():
    marks = lambda words: [f"{a}{o}{i}{w}{i}{c}{a}" for o, c in ("()", "[]", "{}", "<>") for a in ("", " ", "\t") for i in ("", " ", "\t") for w in words]
    ats, dots = [*marks(["at", "AT", "At"]), " at ", " AT ", "@", "＠"], [*marks(["dot", "DOT", "Dot"]), " dot ", " DOT ", "."]
    tried = 0
    for text in (f"x{a}y{d}com" for a in ats for d in dots):
        if any(p.fullmatch(text) for p in pii.EMAILS):
            tried += 1
            assert pii.finds(text, PEOPLE) == [(0, len(text), "email")], text
    assert tried > 10_000


def test_replacement(spark):
    text = "Hi Kivun,\r\n call +1 312 555 0143 👨‍🌾  now "
    rows = [(1, text), (2, None), (3, ""), (4, "x " * 50_000 + "a@b.org"), (1, text)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id bigint, text string, kind string, record int")
    out = {r["doc_id"]: r["text"] for r in pii.replaced(df, PEOPLE).collect()}
    assert out[1] == "Hi [NAME],\r\n call [PHONE] 👨‍🌾  now " and out[2] is None and out[3] == "" and out[4] == "x " * 50_000 + "[EMAIL]"
    assert {tuple(r) for r in pii.found(df, PEOPLE).collect()} == {(1, "name", "Kivun"), (1, "phone", "+1 312 555 0143"), (4, "email", "a@b.org")}
    assert pii.found(df.limit(0), PEOPLE).count() == 0


def test_validators():
    assert pii.verhoeff("2363") and not pii.verhoeff("2364")
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.mod97("255081416802538") and not pii.mod97("255081416802539")


def test_bounded_list(spark, monkeypatch):
    monkeypatch.setattr(pii, "MOST_PEOPLE", 1)
    with pytest.raises(ValueError):
        pii.listed(spark.createDataFrame([("a", "b"), ("c", None)], "g string, f string"), ["g"], ["f"])
