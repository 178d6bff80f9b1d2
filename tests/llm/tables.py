"""Small made-up tables with the awkward cases."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOW))


def made_documents(n=120, seed=5):
    """Rows with near and exact copies, nulls, empty, wordless, short and long texts, ties and a hot source."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    texts = []
    for i in range(n):
        if i % 5 == 3 and texts[-1]:
            w = texts[rng.randrange(len(texts))] or "x"
            w = w.split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 8])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            texts.append(rng.choice([" ", "\n", "  "]).join(rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 60, 90]))))
    texts += [None, "", " \n\t", "one", "one", "Two Words", "two words", "!!! ...", "A" * 5000 + " b" * 3000, texts[0], texts[0].upper()]
    sources = ["hot", "hot", "a", "b", None, ""]
    return [(i * 3, t, ["en", "de", None][i % 3], sources[i % 6], len(t or "")) for i, t in enumerate(texts)]


def clashing(df):
    """The frame with columns that have names an operator gives."""
    from pyspark.sql import functions as F

    names = "row text_ n_words spans items lang_pred score n_tokens n_bytes base_score kept component_id value u v block id host path rule verdict size start taken".split()
    return df.withColumns({c: F.lit("x") for c in names})
