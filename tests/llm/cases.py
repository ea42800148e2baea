"""Documents with every odd case: null, empty and long texts, ties, copies, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, score string, row string, key int"


def words(n: int, seed: int, vocabulary: int = 400) -> str:
    random.seed(seed)
    return " ".join(f"w{random.randint(0, vocabulary)}" for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    base, long = words(120, 1), words(9000, 2, 50)
    near = base.replace(base.split()[60], "changed", 1)
    passage = words(60, 3)
    return [
        (1, base), (2, base), (3, near), (4, words(30, 4) + " " + passage + "\n" + words(30, 5)), (5, words(20, 6) + "\t" + passage), (6, None), (7, ""), (8, " \n\t "), (9, "one"), (10, "Ünï-Code ÀÉ 日本   x!"),
        (11, long), (12, words(13, 7)), (13, words(13, 7)), (14, words(12, 7)), (15, base.upper()), (None, words(40, 8)), (None, None), (5, words(20, 6) + "\t" + passage), (16, "a  b\n\nc <|endoftext|> d\r\n e"), (17, "x" * 30_000),
    ]


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(d, t, "en", "s", len(t) if t is not None else None, -1, "s", "r", 7) for d, t in rows], SCHEMA)
