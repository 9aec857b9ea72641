import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omicron", "pi", "rho", "sigma", "tau", "upsilon", "éa", "ñu"]


def prose(dice, n):
    return " ".join(dice.choice(WORDS) + dice.choice(["", "", "", ",", "."]) + str(dice.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents of all the odd kinds: null, empty, blank, long, repeated, near copies, shared lines."""
    dice = random.Random(5)
    base = [prose(dice, dice.randint(5, 120)) for _ in range(25)]
    shared = prose(dice, 60)
    out = [(1, None), (2, ""), (3, " \n\t\r\n "), (4, "one"), (5, "one two three"), (6, "Ünï cödé x 　 y"), (7, "a\r\nb\n\nc"), (8, "<|endoftext|> x")]
    for k, text in enumerate(base):
        out.append((10 + k, text))
        if k % 3 == 0:
            out.append((100 + k, text))  # exact copy
        if k % 4 == 0:
            words = text.split(" ")
            words[len(words) // 2] = "changed"
            out.append((200 + k, " ".join(words)))  # near copy
        if k % 5 == 0:
            out.append((300 + k, f"{prose(dice, 12)}\n{shared}\nshort line\n{prose(dice, 9)}"))
    out.append((400, " ".join(prose(dice, 2000) for _ in range(4))))
    out.append((401, "same words again " * 3000))
    return out + [(10, base[0]), (12, "another text of one id")]


@pytest.fixture(scope="session")
def docs(spark, rows):
    data = [(i, t, "en" if i % 2 else None, "s0", len(t or ""), "x") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, removed string").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def slow_ids(tokenizer):
    """Whole texts by the library alone, with the end id."""
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(tokenizer)
    held.encode_special_tokens = True
    return lambda text: [*held.encode(text or "", add_special_tokens=False).ids, 0]
