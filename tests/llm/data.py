"""Small dirty tables and plain statements of the contracts."""

import hashlib
import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def words(text):
    return WORD.findall((text or "").encode())


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" if rng.random() < 0.9 else rng.choice(["Éa", "naïve", "x,", "THE"]) for _ in range(n))


def documents(seed=1, n=40):
    """(doc_id, text) with copies, near copies, shared passages, a long text, nulls,
    empty texts, runs of one character and repeated rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 160)) for _ in range(n)]
    passage = prose(rng, 90)
    for k in range(0, n, 5):
        texts[k] += " " + passage + "\n" + prose(rng, 5)
    base = prose(rng, 200)
    near = [base] + [" ".join(w if rng.random() > 0.01 else "edit" for w in base.split()) for _ in range(8)]
    rows = list(enumerate([*texts, *near, base, base.upper(), "a" * 900, "a" * 450 + "b" + "a" * 450, prose(rng, 3000) + passage, None, "", " \t\n", "one", "one two three", "one two three"]))
    rows = [(i * 3 % 211, t) for i, t in rows]
    rows += [rows[3], rows[3], (None, base), (None, None), (500, passage)]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, key string, ord long, a int, node string, source string, lang string, _key int, tokens_taken int"


def frame(spark, rows):
    """The rows with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "k", 1, 2, "n", f"src{(i or 0) % 3}", "en", 7, 8) for i, t in rows], SCHEMA)


def sha(raw):
    return hashlib.sha256(raw).hexdigest()
