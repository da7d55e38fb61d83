"""Dictionary lookups against one regular expression for each alias."""

import random
import re

from strataline.operators import vocabulary


def plain(text, words):
    """Names by trying every spelling as a regular expression."""
    out = set()
    for name, aliases in words.items():
        for text_, more in (s for a in aliases for s in vocabulary.spellings(a.lower())):
            tail = {"+": r"\w+", "*": r"\w*", "": r"\b" if re.search(r"\w$", text_) else ""}[more]
            if re.search(r"\b" + re.escape(text_) + tail, text or "", re.IGNORECASE):
                out.add(name)
    return sorted(out)


def test_spellings():
    assert vocabulary.spellings("hugging ?face") == [("hugging face", ""), ("huggingface", "")]
    assert vocabulary.spellings("large[- ]scale") == [("large-scale", ""), ("large scale", "")]
    assert vocabulary.spellings("a/b test*") == [("a/b test", "*")] and vocabulary.spellings("resilien+") == [("resilien", "+")]
    assert vocabulary.spellings("c++") == [("c++", "")] and vocabulary.spellings("c#") == [("c#", "")]
    assert len(vocabulary.SKILLS) == 96 and {x for p in vocabulary.RELATED for x in p} <= set(vocabulary.SKILLS)


def test_names_equal_regular_expressions(spark):
    rng = random.Random(9)
    said = [t for aliases in vocabulary.SKILLS.values() for a in aliases for t, _ in vocabulary.spellings(a)]
    glue = [" ", ", ", ".", "/", "-", "+", "#", "s ", "\n", "é ", " x", "_", "ing ", "😀"]
    texts = ["".join(rng.choice([rng.choice(said), rng.choice(said).upper(), "word"]) + rng.choice(glue) for _ in range(rng.randint(0, 12))) for _ in range(700)] + [None, "", "ſql Kafka KAFKA", "c++11 C# c#x"]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id long, said string, name int").repartition(4)
    got = {r.key: r.names for r in vocabulary.names_by_key(rows, "id", "said", vocabulary.dictionary(spark, vocabulary.SKILLS)).collect()}
    assert got == {i: plain(t, vocabulary.SKILLS) for i, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 1500


def test_other_vocabularies(spark):
    words = {"one": ("alpha beta", "gamma+"), "two": ("beta",), "three": ("αβγ", "日本 語")}
    rows = spark.createDataFrame([(1, "alpha beta"), (1, "GAMMAX"), (None, "αβγ"), (2, "gamma"), (3, "日本 語"), (4, None)], "k long, t string")
    told = vocabulary.dictionary(spark, words)
    assert {r.key: r.names for r in vocabulary.names_by_key(rows, "k", "t", told).collect()} == {1: ["one", "two"], None: ["three"], 2: [], 3: ["three"], 4: []}
    assert {r.key: r.names for r in vocabulary.names_by_key(rows, "k", "t", told.limit(0)).collect()} == {1: [], None: [], 2: [], 3: [], 4: []}
