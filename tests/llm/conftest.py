import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "score double, spans string, kept string, ids string, label int, node int, n int, gram int, words string, block int, row int, range int")
EXTRA = len(SCHEMA.split(",")) - 2


def _word(rnd):
    return "".join(rnd.choice(["th", "er", "on", "an", "é", "st", "ing", "ß"]) for _ in range(rnd.randint(1, 4)))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): plain, equal, near-equal, empty, null, very short and very long texts."""
    rnd = random.Random(5)
    texts = [" ".join(_word(rnd) for _ in range(rnd.randint(30, 200))) for _ in range(40)]
    passage = " ".join(_word(rnd) for _ in range(60))
    out = list(enumerate(texts))
    for i in range(12):                                           # near copies of one text, with chains
        w = texts[i % 3].split()
        for _ in range(i):
            w[rnd.randrange(len(w))] = _word(rnd)
        out.append((100 + i, " ".join(w)))
    out += [(200 + i, texts[7]) for i in range(9)]                # exact copies
    out += [(300 + i, texts[10 + i][:80] + " " + passage + " " + texts[20 + i][:50]) for i in range(9)]  # a shared passage
    out += [(400, ""), (401, None), (402, " \n\t "), (403, "one"), (404, "one two"), (405, "ONE two"), (406, "x" * 450), (407, "ab " * 400),
            (408, (texts[1] + "\n") * 60), (409, "Σας İß ＡＢ a\u0301 <|endoftext|> <|startoftext|>it's 12 ½!"),
            (410, 'token = "abcdef123456" and password=xy PASSWORD: a1b2c3 AKIA' + "Z9" * 9 + " " + "0123456789abcdef" * 2),
            (411, "Released under the MIT License. All rights reserved.\nPlain text."),
            (412, "password: token: abcdef123 api_key=QWERTY12 é key")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(d, t, *[None] * EXTRA) for d, t in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and repeated rows."""
    text = " ".join(f"word{i}" for i in range(80))
    return spark.createDataFrame([(None, text), (None, None), (None, ""), (5, text), (5, text), (6, text + " more"), (7, None), (7, None)], "doc_id long, text string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
