"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

import random

BASE = [
    "The quick brown fox jumps over the lazy dog and runs away into the dark green forest before the night falls",
    "Le renard brun saute par dessus le chien paresseux et court dans la forêt verte avant la tombée de la nuit",
    "Der schnelle braune Fuchs springt über den faulen Hund und läuft in den dunklen grünen Wald bevor es Nacht wird",
]
CLASH = "'x' as node, 1 as bucket, 2 as comp, 'y' as sig, 3 as length, 4 as piece, 5 as score, true as held_out, 'z' as lang_pred, 6 as ids, 7 as row, 8 as n, 9 as start, 10 as part"


def texts():
    rnd = random.Random(4)
    words = [t.split() for t in BASE]
    rows = []
    for i in range(60):
        k = i % 3
        rows.append((i, " ".join(rnd.choice(words[k]) for _ in range(rnd.randint(3, 60))), ("en", "fr", "de")[k]))
    long = " ".join(rnd.choice(words[0]) for _ in range(30000))
    near = long.split()
    near[5] = "changed"
    rows += [
        (100, None, "en"), (101, "", "en"), (102, " \n\t ", None), (103, long, "en"), (104, " ".join(near), "en"), (105, BASE[0], None), (106, BASE[0], "en"), (106, BASE[0], "en"),
        (107, BASE[0].upper(), "en"), (108, "1234 5678", "en"), (109, "two words", "en"), (110, "TWO  words", "en"), (None, "no id here at all today", "en"), (None, None, None),
        (111, "write to ann.b@mail.example.com or 10.0.0.255, card 4111 1111 1111 1111, call +1 (415) 555-0123 now", "en"), (112, "é ▁ 中文 😀 \r\n<|endoftext|> </s>", "fr"),
        (113, "x" * 20000, "en"), (114, "1" * 30000 + "@" * 50, "en"),
    ]
    return rows


def documents(spark):
    df = spark.createDataFrame(texts(), "doc_id long, text string, lang string").selectExpr("*", "'src' as source", "cast(length(text) as long) as n_chars", *CLASH.split(", "))
    return df.repartition(5)


def empty_documents(spark):
    return documents(spark).limit(0)
