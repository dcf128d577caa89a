import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def documents(spark, rows):
    """rows: (doc_id, text); with columns that clash with names the operators use inside."""
    full = [(i, t, None, "s", 0, "x", 1) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, part string, row int")


def odd_texts():
    long = " ".join(f"w{i % 977}" for i in range(6000))
    return [None, "", " \n\t ", "one", "two words", "tie tie tie", "tie tie tie", "é ÀÉ ß 漢字   x", long, long + " end", "a" * 500, "<|endoftext|> mark"]


def corpus(seed, n=60, vocabulary=120):
    """Random documents, some of which copy from each other."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(vocabulary)]
    texts = []
    for _ in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(0, 160))]
        if texts and rng.random() < 0.5:
            other = rng.choice(texts).split()
            a = rng.randint(0, max(0, len(other) - 1))
            text = text[: rng.randint(0, len(text))] + other[a : a + rng.randint(10, 90)] + text[len(text) // 2 :]
        elif texts and rng.random() < 0.3:
            text = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(words)
        texts.append(" ".join(text))
    return texts
