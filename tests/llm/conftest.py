import pytest

from latticework.llm import tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, count long, n string, words string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, copies, repeated rows and ids, clashing extra columns."""
    long = " ".join(f"wort{k % 97} und{k % 89} der" for k in range(4000))
    rows = [(0, None, "en", None), (1, "", None, "b"), (2, " \n\t ", "de", "a"), (3, long, "de", "a"), (4, "You are an idiot.\nYou are an idiot.", "en", "b"), (4, "You are an idiot.\nYou are an idiot.", "en", "b"), (None, "No id here, he said.", None, "c"), (5, "<|endoftext|> the  cat\u00a0sat \u2003 on ", "en", "a"), (6, "12345 !!!", "en", None), (7, "the same words in this text are here twice the same words in this text", "en", "a"), (8, "the same words in this text are here twice the same words in this text", "fr", "z")]
    return spark.createDataFrame([(i, t, la, s, len(t or ""), 1, 2, 3, "x", "y") for i, t, la, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def reference_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids
