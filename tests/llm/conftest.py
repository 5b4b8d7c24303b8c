import random

import pytest

#: Names that operators use inside.
CLASH = ["_text", "_base", "_more", "_tests", "_found", "_spans", "_cell", "_key", "_p", "_salt", "_copy", "_lang", "_stats", "_before", "_h", "_rank", "secret_spans", "mix_kept", "lang_pred"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, bucket int, stage string, rid long, h long, " + ", ".join(f"{c} string" for c in CLASH)
_VOICES = {"en": ["the", "of", "and", "ing", "ther", "tion", "wh"], "fr": ["le", "eau", "que", "ç", "ment", "dé", "oi"]}


def words(rng, n, lang="en"):
    return ["".join(rng.choice(_VOICES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def corpus(seed=1):
    """Rows with copies, near copies, shared passages, nulls, blanks, repeated rows, one long text and columns whose names operators use inside."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    texts = [" ".join(words(rng, rng.choice([3, 12, 80, 300]), rng.choice(["en", "fr"]))) for _ in range(30)]
    texts += [texts[3], texts[3], "", None, "   \n\t ", "ß" * 80, "a a a a a " * 30, "x"]
    texts += [" ".join(words(rng, 40) + passage + words(rng, 40)) for _ in range(4)]
    base = words(rng, 200)
    for k in range(5):
        copy = list(base)
        copy[10 * k + 5] = f"edit{k}"
        texts.append("\n".join(" ".join(copy[i : i + 9]) for i in range(0, 200, 9)))
    texts.append(" ".join(words(rng, 9000)) + ' password = "hunter2hunter2" ' + " ".join(base))
    rows = [(i, t, "fr" if t and "eau" in t else "en" if i % 7 else None, f"src{i % 3}" if i % 5 else None, len(t or ""), i, None, "x", 3, -i, *[f"{c}{i}" for c in CLASH]) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [rows[4], rows[4]]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
