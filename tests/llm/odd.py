"""Tables that hold every odd case at once."""

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(20000))
TEXTS = [
    None, "", "   \n\t", "a", "A a", "one two three four", "one two three four five", "Und der die das ist nicht ein Satz, und das ist gut so.",
    "The quick brown fox jumps over the lazy dog and runs away from it all.", "The quick brown fox jumps over the lazy dog and runs away from it all.",
    "%%% *** !!!", "日本語のテキスト 🎉 \x00 ▁ x", "x" * 5000, LONG, LONG + " end",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, h long, block int"


def rows():
    langs = [None, "en", "de"]
    out = [(i, t, langs[i % 3], None, None, 0.5, "k", 1, 2) for i, t in enumerate(TEXTS)]
    return [*out, (3, "a", "en", "s", 1, None, None, None, None), (3, "a", "en", "s", 1, None, None, None, None), (None, "The lazy dog", "en", None, 3, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


def docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like the operators' own."""
    return spark.createDataFrame(rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
