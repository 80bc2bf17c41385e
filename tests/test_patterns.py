"""Many patterns in one scan equal a loop over them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from timberline.operators import patterns, text
from timberline.sources import registry


@pytest.mark.parametrize(
    ("pattern", "literals"),
    [
        ("magna ease", ["magna ease"]), (r"(?i)\bSAPIEN\s?3", ["sapien"]), (r"evolut|core ?valve", ["evolut", "valve"]), (r"ab|evolut", None), (r"a(?:bcdef)?g", None), (r"abc+d", ["abc"]), (r"abc?defg", ["defg"]),
        (r"[abc]{3}", None), (r"x\.y\.z", ["x.y.z"]), (r"ab{2,3}cde", ["cde"]), (r"(one|two) three", [" three"]), (r"abcd*", ["abc"]), (r"[]|]alpha", ["alpha"]), (r"beta[^|]gamma", ["gamma"]),
    ],
)
def test_literals_a_match_needs(pattern, literals):
    assert patterns.required_literals(pattern) == literals


def made(n, seed=1):
    r = random.Random(seed)
    syllables = ["mag", "na", "sap", "ien", "evo", "lut", "core", "per", "cev", "al", "tri", "fec", "ta", "ins", "piris"]
    name = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(2, 5)))
    forms = [lambda x: x, lambda x: rf"\b{x}\b", lambda x: x[:4] + r"\s?" + x[4:], lambda x: f"{x}|{name()}", lambda x: f"(?:{x})s?", lambda x: x + r"\s+\d{2}\s?mm", lambda x: x[:3] + ".?" + x[3:]]
    return [r.choice(forms)(name()) for _ in range(n)], [" ".join(r.choice([name(), name().upper(), "valve", "29 mm", "İstanbul", "reviewed in epic", "ß"]) for _ in range(r.randrange(0, 30))) for _ in range(60)] + [None, ""]


def test_twenty_thousand_patterns_equal_the_loop(spark):
    expressions, notes = made(20_000)
    df = spark.createDataFrame(list(enumerate(notes)), "id long, text string")
    got = {r["id"]: (r["all"], r["first"]) for r in df.select("id", patterns.matching(F.col("text"), expressions).alias("all"), patterns.matching(F.col("text"), expressions, first_only=True).alias("first")).collect()}
    compiled = [re.compile(p, re.IGNORECASE) for p in expressions]
    hits = 0
    for i, t in enumerate(notes):
        want = [k for k, c in enumerate(compiled) if c.search(t or "")]
        hits += len(want)
        assert got[i] == (want, want[:1])
    assert hits > 1000


def test_devices_and_brands_of_any_number(spark):
    expressions, notes = made(6000, 2)
    aliases = spark.createDataFrame([(f"m{i % 900}", p, i % 3 == 0) for i, p in enumerate(expressions)], "model string, pattern string, guarded boolean")
    df = spark.createDataFrame(list(enumerate(notes)), "id long, text string")
    got = {(r["id"], r["model"]) for r in text.device_matches(df, aliases, ["id"]).collect()}
    want = set()
    for k, p in enumerate(expressions):
        for i, t in enumerate(notes):
            for m in re.compile(p, re.IGNORECASE).finditer(t or ""):
                around = t[max(0, m.start() - 100) : m.end() + 100]
                if k % 3 or (re.search(text.DEVICE_CONTEXT, around) and not re.search(text.RECORD_CONTEXT, around)):
                    want.add((i, f"m{k % 900}"))
    assert got == want and len(want) > 300
    brands = spark.createDataFrame([(f"b{i}", p, i // 2, "SAVR", "x") for i, p in enumerate(expressions)], "model string, pattern string, priority int, route string, design_class string")
    records = spark.createDataFrame([(t, None, None, "co", None) for t in notes], f"brand string, description string, model_number string, company string, sizes {registry._SIZE}")
    models = {r["model"]: r["n_records"] for r in registry.roll_up_devices(records, brands)[0].filter("n_records is not null").collect()}
    order = sorted(range(len(expressions)), key=lambda i: (i // 2, f"b{i}"))
    first = [next((f"b{i}" for i in order if re.search(expressions[i], t or "", re.IGNORECASE)), None) for t in notes]
    assert models == {m: first.count(m) for m in set(first) - {None}}


def test_a_pattern_is_tried_only_where_all_it_needs_is_there():
    known = patterns.pattern_set((text.IMPLANT_YEAR, *text.EVENT_PATTERNS.values(), text.NEGATED_FIELDS, r"\bS3\b", r"\(#(\d{2})\)"))
    assert known.candidates("Prosthetic valve: mean gradient is 7 mmHg, DVI 0.11, EOA 1.1 cm2, trace aortic regurgitation.") == []
    assert known.candidates("Implanted in 2011, valve-in-valve, prosthetic aortic valve stenosis") == [0, 1, 3]
    assert patterns.needs(r"(?i)valve[- ]in|prosth(?:etic)? (?:leak|\d+ mm)\s?x+") == [[("valve in", "valve-in")], [("prosth ", "prosthetic "), (" mm", "leak"), ("x",)]]
    assert patterns.needs(r"\x41b|a*[^b]") == [[], []]


def test_letters_that_match_an_ascii_letter_hide_no_literal():
    for pattern, note in ((r"sapien", "SAPİEN 3"), (r"sapien", "sapıen"), (r"magna ease", "magna eaſe"), (r"konect", "Konect"), (r"[a\]b]evolut", "]evolut"), (r"\x45volut", "evolut")):
        assert re.search(pattern, note, re.IGNORECASE) and patterns.pattern_set((pattern,)).candidates(note) == [0]


def test_what_a_match_needs_is_in_every_match():
    r = random.Random(5)
    atoms = ["a", "b", "S", "i", "k", "ab", "val", r"\s", r"\d", r"\b", ".", "[ab]", "[^a]", "[]a]", r"[a\]b]", "[- ]", "[a-c]", "^", "$", r"\.", r"\(", "-", " ", "[^]b]", "[(|]", r"\x41"]
    letters = ["a", "b", "s", "S", "i", "I", "ı", "İ", "ſ", "K", "k", "v", "al", " ", "-", ".", "(", "]", "1", "\n", "ß", "|", "A", "val"]

    def made_pattern(depth=0):
        out = ""
        for _ in range(r.randrange(1, 5)):
            x = r.choice(atoms) if depth > 1 or r.random() < 0.7 else r.choice(["(", "(?:", "(?=", "(?!", "(?i:"]) + "|".join(made_pattern(depth + 1) for _ in range(r.randrange(1, 4))) + ")"
            out += x if x in ("^", "$", r"\b") else x + r.choice(["", "", "", "", "?", "*", "+", "{2}", "{0,1}", "+?", "??", "?+"])
        return out

    matches = spared = 0
    while matches < 2000:
        pattern = made_pattern()
        try:
            compiled = re.compile(pattern, re.IGNORECASE)
        except re.error:
            continue
        known = patterns.PatternSet([pattern])
        for _ in range(4):
            note = "".join(r.choice(letters) for _ in range(r.randrange(0, 14)))
            hit, tried = compiled.search(note) is not None, known.candidates(note) == [0]
            assert tried or not hit, (pattern, note)
            matches += hit
            spared += not tried
    assert spared > 100
