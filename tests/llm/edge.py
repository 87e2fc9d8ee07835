"""Tables with the awkward rows that every operator must handle."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, th string, signals int, kept string,"
    " language string, slots string, spans int, _words string, c0 int, rest string, gram int, part int"
)
EXTRA = (7, "th", 8, "kept", "language", "slots", 9, "_words", 10, "rest", 11, 12)


def prose(n, seed, words=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def rows():
    base, other = prose(300, 1), prose(260, 2)
    texts = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \n\t ", None, "a"),
        (4, "word", "en", None),
        (5, base, "en", "a"),
        (6, base, "en", "b"),
        (7, base.replace("a", "A", 3), "en", "b"),
        (8, other + "\n" + base[:700], "de", "b"),
        (9, "é😀<|endoftext|> \x0b x\x85y " * 40, "de", None),
        (10, "same line\n" * 200, "en", "a"),
        (11, "x" * 5000, None, None),
        (12, prose(30_000, 3), "en", "a"),
        (None, other, "de", "b"),
        (13, other, "de", "b"),
        (13, other, "de", "b"),
        (14, prose(90, 5), "en", "a"),
        (14, prose(90, 6), "en", "a"),
    ]
    return [(i, t, g, s, len(t or ""), *EXTRA) for i, t, g, s in texts]


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
