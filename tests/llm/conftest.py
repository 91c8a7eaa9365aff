import random

import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, shard int, kept boolean, `_run` long, words string"
SYLLABLES = {"en": "the th er on an re he in ed nd ha at en es of or".split(), "de": "sch ei en er ge un be ver ich ung keit ä ö ß".split(), "fr": "eau ou ai on en re le é è que ment tion".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls everywhere, empty and blank texts, copies, near copies, ties, odd characters and a very long text."""
    rng = random.Random(7)
    out = []
    for i in range(90):
        lang = rng.choice(list(SYLLABLES))
        out.append([i, prose(rng, lang, rng.randint(5, 120)), lang, f"src{min(i % 5, rng.randint(0, 4))}"])
    for i in range(90, 130):  # copies, with other spacing and case
        old = out[rng.randrange(20)]
        out.append([i, rng.choice([old[1], old[1].replace(" ", "  "), old[1].upper(), old[1] + "\n"]), old[2], old[3]])
    for i in range(130, 190):  # near copies of a few
        words = out[40 + i % 4][1].split(" ") * 3
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "new" + str(rng.randrange(9))
        out.append([i, " ".join(words), out[40 + i % 4][2], None])
    out += [[190, None, None, None], [191, "", "en", "src0"], [192, " \t\n\x0b\x0c\r", None, "src1"], [193, "one two", "en", ""], [194, "one two", "en", ""], [195, "12 34 -- !!", "en", "src2"]]
    out += [[196, "日本語 テスト ²Ⅷ İstanbul \x00 a\x1cb <|endoftext|> 's 'd don't", None, "src2"], [197, "CC-BY cc by, CC\nBY. All Rights Reserved; general public license", "en", "src3"]]
    out += [[198, prose(rng, "en", 30_000), "en", "src0"], [199, "x" * 100_000, "en", "src0"], [None, "no id here at all", "en", "src1"], [None, None, None, None]]
    out += [list(out[3]), list(out[3]), [3, "another text under a used id", "en", "src4"], [-5, "negative id text for all", "fr", "src4"]]
    return [(*r, None if r[1] is None else len(r[1]), 1, True, 5, "w") for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SHAPE).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SHAPE)
