"""A small documents table with the awkward cases, and brute-force versions of the operators."""

import random

SCHEMA = "text string, doc_id long, lang string, source string, n_chars long, keys string, size long, `_doc` string, hot long"


def documents(spark, rows=None):
    """Extra columns carry names that operators use inside. Columns aren't in their usual order."""
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(t, i, g, "src0", None if t is None else len(t), "k", 1, "d", 2) for i, t, g in rows], SCHEMA)


def texts(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    rows = [(i, prose(rng.randint(5, 160)) + ".\n" + prose(8) + ".", "en") for i in range(n)]
    base = [rows[3][1], prose(400), prose(90), prose(20)]
    for k, text in enumerate(base * 3):
        words = text.split()
        for _ in range(max(1, len(words) // (30 if k < 8 else 12))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((100 + k, " ".join(words), "en"))
    rows += [(200, None, "en"), (201, "", None), (202, " \t\n ", "de"), (203, "one two", "en"), (204, "ONE  two\n", "en"), (205, rows[1][1], None)]
    rows += [(206, "Füße größer über\u3000Straße\nÄ" * 8, "de"), (207, prose(6000), "en"), (208, "x" * 5000, "en"), (None, rows[2][1], "en"), (209, "a a a a a a a a a a a a", "en")]
    rows += [rows[4], rows[4]]
    return rows


def words(text):
    return [] if text is None else text.encode().split()


def shingles(text, n=5):
    ws = [w.lower() for w in words(text)]
    return {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())
