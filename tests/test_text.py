import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papercorpus.functions import text, works



def test_white_space_is_the_same_set_as_in_python():
    expected = {chr(i) for i in range(0x110000) if re.match(r"\s", chr(i))}
    assert set(text.WHITESPACE) == expected
    assert len(text.WHITESPACE) == len(expected)


def test_collapse_and_strip_over_all_code_points(values):
    chars = [chr(i) for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000]
    rows = [(f"{c}a{c}{c}b{c}",) for c in chars]
    got = values(rows, "x string", text.collapse(F.col("x")), text.strip(F.col("x")))
    for (source,), (collapsed, stripped) in zip(rows, got):
        assert collapsed == re.sub(r"\s+", " ", source).strip()
        assert stripped == source.strip()


def test_null_text_becomes_empty(values):
    assert values([(None,)], "x string", text.collapse(F.col("x")), text.strip(F.col("x"))) == [("", "")]
    assert values([(None,)], "x string", text.word_count(F.col("x"))) == [0]


def test_words(values):
    got = values([("A-b C1,é d_e",)], "x string", text.words(F.col("x")))
    assert got == [["a", "b", "c1", "d", "e"]]


def test_slug(values):
    rows = [("  Natural Language\tProcessing! ",), ("???",), ("a" * 100,), ("x-y_z",)]
    expected = ["natural_language_processing", "query", "a" * 80, "x-y_z"]
    assert values(rows, "x string", text.slug(F.col("x"))) == expected


def test_clean_title(values):
    cases = {
        '"Deep Nets"': "Deep Nets",
        "Title: Deep Nets": "Deep Nets",
        'Title: "Foo"': '"Foo',  # quotes go first, the one behind the prefix stays
        "`'title :  Foo'`": "Foo",
        "First line\nsecond line": "First line second line",
        " ".join("abcdefghijklmnopqrst"): " ".join("abcdefghijklmno"),
        "\"'`": "",
        "": "",
        "Subtitle: x": "Subtitle: x",
    }
    rows = [(raw,) for raw in cases]
    assert values(rows, "x string", text.clean_title(F.col("x"))) == list(cases.values())


def test_clean_title_without_word_limit(values):
    long = " ".join(["w"] * 40)
    assert values([(long,)], "x string", text.clean_title(F.col("x"), 0)) == [long]
    assert values([(None,)], "x string", text.clean_title(F.col("x"), 0)) == [""]


def test_bleu_tokens(values):
    cases = {
        "Hello, world.": "Hello , world .",
        "3.14 and 1,000": "3.14 and 1,000",
        "2-fold well-known": "2 - fold well-known",
        "a &amp; b &lt;c&gt;": "a & b < c >",
        "U.S. (state)": "U . S . ( state )",
        "<skipped>x": "x",
    }
    rows = [(raw,) for raw in cases]
    assert values(rows, "x string", text.bleu_text(F.col("x"))) == list(cases.values())


INDEX = "x map<string, array<int>>"


def test_rebuild_abstract(values):
    cases = [
        ('{"b": [1], "a": [0, 2]}', "a b a"),
        ('{"a": [0], "z": [5]}', "a z"),  # gap
        ('{"a": [0], "": [1], "b": [2]}', "a b"),  # empty word
        ('{"old": [0], "new": [0]}', "new"),  # later entry wins
        ('{"z": [0], "a": [0]}', "a"),
        ('{"a": [0], "": [0]}', None),  # the later, empty word wins
        ("{}", None),
        ('{"a": []}', None),
        (None, None),
    ]
    index = F.from_json("x", "map<string, array<int>>")  # keeps the order of the entries
    got = values([(c,) for c, _ in cases], "x string", works.rebuild_abstract(index))
    assert got == [expected for _, expected in cases]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.lists(st.text("abc", min_size=1, max_size=3), min_size=1), min_size=20, max_size=40))
def test_rebuild_undoes_indexing(values, texts):
    rows = []
    for words in texts:
        index = {}
        for place, word in enumerate(words):
            index.setdefault(word, []).append(place)
        rows.append((index,))
    assert values(rows, INDEX, works.rebuild_abstract(F.col("x"))) == [" ".join(w) for w in texts]


def test_short_id(values):
    rows = [("https://x.org/W1",), ("https://x.org/W1//",), ("W1",), ("",), (None,), ("///",)]
    assert values(rows, "x string", works.short_id(F.col("x"))) == ["W1", "W1", "W1", None, None, ""]


TOPICS = "x array<struct<id: string, display_name: string>>"


def test_topics(values):
    rows = [([("u/T1", None), ("u/T2", "two"), (None, "")],), (None,), ([],)]
    assert values(rows, TOPICS, works.display_names(F.col("x"))) == [["two"], [], []]
    assert values(rows, TOPICS, works.short_ids(F.col("x"))) == [["T1", "T2"], [], []]
    assert values(rows, TOPICS, works.primary_name(F.col("x"))) == [None, None, None]


def test_work_title(values):
    rows = [("t", "d"), ("", " d "), (None, "d"), ("  ", "d"), (None, None)]
    columns = works.work_title(F.col("x"), F.col("y"))
    assert values(rows, "x string, y string", columns) == ["t", "d", "d", "", ""]
