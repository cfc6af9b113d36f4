"""Small corpora with the awkward cases, for the tests of this folder."""

import random

DDL = "doc_id long, text string, chunk string, level int, hashes string, bucket double"


def frame(spark, rows):
    """Documents with more columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "x", 1, "y", 0.5) for i, t in rows], DDL)


def awkward(seed=0, n=60, words=30):
    """Rows (doc_id, text): copies, near copies, repeated rows, empty and null texts, one very long text."""
    r = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(n):
        text = [r.choice(vocabulary) for _ in range(r.randint(1, 3 * words))]
        kind = i % 6
        if kind == 1:
            k = r.randint(0, len(text))
            text[k:k] = passage[r.randint(0, 20) : r.randint(30, 60)]
        elif kind == 2 and rows:
            text = (rows[r.randrange(len(rows))][1] or "").split()
            if text and r.random() < 0.6:
                text[r.randrange(len(text))] = "changed"
        elif kind == 3:
            text = text * 3
        space = r.choice([" ", "\n", " \t ", "\r\n"])
        rows.append((i * 3 - 20, space.join(text)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (None, "w1 w2 w3"), (None, None), rows[5], rows[5], (1003, "one")]
    rows.append((1004, " ".join(["again and again"] * 3000 + passage)))
    return rows


def thue_morse(letters=1024):
    """Two unlike words that no polynomial modulo 2**64 tells apart."""
    word = "a"
    while len(word) < letters:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))
