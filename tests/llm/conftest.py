import random

import pytest


def make_texts() -> list:
    """Distinct words, copies, near copies, shared passages, blanks, nulls, a long text, ties."""
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdeéß日", k=rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    passage = text(90)
    texts = [text(rng.randint(1, 120)) for _ in range(25)]
    texts += [texts[0]] * 6 + [None, None, "", "", "  \n\t ", "!!! ...", "one", "One", "one two", "x" * 1500, "x" * 1500 + "y", "ab" * 700]
    for k in range(6):
        words = texts[1].split() * 3
        words[5 * k] = f"edit{k}"
        texts.append(" ".join(words))
    texts += [text(20) + " " + passage + " " + text(20) for _ in range(4)] + [passage, passage.upper(), passage + " " + passage]
    texts.append(text(9000))
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """All texts, a null id, a repeated row, and extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t), 1, "r", 2, 3) for i, t in enumerate(texts)]
    rows += [(None, "a null id", None, None, 9, 1, "r", 2, 3), rows[3]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int, digest string, size int, shard int").repartition(3)


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)

