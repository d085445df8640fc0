"""Small inputs with the awkward cases, and plain versions of what the operators compute."""

import random
import re

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score string, size string, n long, "
          "c string, ids string, target string, shingle string, host string")
WORDS = [a + b for a in "ba ke li mo nu sa te vi zo ra".split() for b in "n r st l m".split()]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward(seed=0, n=60):
    """(doc_id, text, lang, source): plain texts, copies, near copies, shared lines, nulls, empties, odd white space,
    a very long text and a null id."""
    rng = random.Random(seed)
    common = "  The very COMMON line of many documents\t"
    rows = []
    for i in range(n):
        text = "\n".join(sentence(rng, rng.randint(3, 12)) + "." for _ in range(rng.randint(1, 8)))
        if i % 3 == 0:
            text += "\n" + (common if i % 2 else common.strip().upper())
        rows.append((i, text, "en" if i % 2 else "fr", "hot" if i % 3 else f"s{i % 4}"))
    base = sentence(rng, 80)
    rows += [(n + 1, base, "en", "hot"), (n + 2, base, "en", None), (n + 3, base.upper() + "\n", None, "hot"),
             (n + 4, base + " " + sentence(rng, 6), "en", "hot"), (n + 5, None, "en", "hot"), (n + 6, "", "en", None),
             (n + 7, " \t\n\x0b ", "en", "s1"), (n + 8, "one two", "en", "s1"), (n + 9, "ONE  two", "en", "s2"),
             (n + 10, sentence(rng, 30_000), "en", "hot"), (n + 11, "12 34 !!", "en", "s9"),
             (n + 12, "Ünïcödé ßtraße — łódź 東京 \U0001f600 don't", "fr", "s9"), (None, "no id here at all", "en", "hot")]
    return rows


def documents(spark, rows):
    wide = [(*r[:4], len(r[1] or ""), "x", "y", 7, "z", "i", "t", "s", "h") for r in rows]
    return spark.createDataFrame(wide, SCHEMA)
