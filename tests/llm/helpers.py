"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

WORDS = "the of and river stone über façade niño market 42 x_y end. light, table".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randrange(50)) if r.random() < 0.6 else "") for _ in range(n))


def documents(spark, rows, extra=True):
    """rows: (doc_id, text); the extra columns have names that the operators use themselves."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "t", [1]) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, score int, t string, spans array<int>")


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (None, prose(1, 30)), (None, None), (5, prose(2, 80)), (5, prose(2, 80)), (6, prose(2, 80)),
           (7, prose(3, 9000)), (8, "one"), (9, "###"), (10, prose(4, 60) + "\n" + prose(4, 60)), (11, "\x00퟿ ﻿\xa0")]
EMPTY: list = []
