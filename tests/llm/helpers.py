"""Tables with every awkward case, shared by the operators' tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, chunk string, bucket int, row long, part int, kept string, spans string, carry_0 string, rep long, n long, key long"


def prose(seed, words):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeéöñst") for _ in range(draw.randint(1, 9))) for _ in range(400)]
    return " ".join(draw.choice(vocabulary) + draw.choice(["", "", ",", ".", "\n"]) for _ in range(words))


def texts():
    base, long_text = prose(1, 120), prose(2, 30_000)
    shared = prose(3, 40)
    near = base.split(" ")
    near[60] = "changed"
    return [
        (1, base),
        (2, base),
        (3, " ".join(near)),
        (4, base.upper()),
        (5, None),
        (6, ""),
        (7, " \n\t "),
        (8, "one two"),
        (9, "one  two"),
        (10, long_text),
        (11, prose(4, 50) + shared + prose(5, 50)),
        (12, shared + prose(6, 60)),
        (13, "ünï ﬁne Ⅳ 日本語テキスト 😀 ​ <|endoftext|> ▁ it's\r\n x"),
        (14, "a" * 300),
        (14, "a" * 300),
        (15, prose(7, 20) + "   " + prose(7, 20)),
        (None, "no id here at all"),
        (None, base),
        (40, shared),
    ]


def frame(spark, rows):
    full = [(d, t, "en", "s", -1, "x", 1, 2, 3, "k", "s", "c", 4, 5, 6) for d, t in rows]
    return spark.createDataFrame(full, DOCS)


def documents(spark):
    return frame(spark, texts()).repartition(3)


def empty(spark):
    return frame(spark, [])
