"""Rows and names for the odd tables of conftest."""

PASSAGE = "the quick brown fox jumps over the lazy dog while seven grey cats watch from an old wooden fence near the river bank"
EXTRA = ("key", "fp", "tk", "row_", "bin", "hub", "at", "marks", "gone", "n_links", "repeats_of", "log_ratio", "text_", "kept_id_", "leak_key_", "line", "node")


def odd_rows():
    return [
        (1, f"One line here. {PASSAGE}. And more of it.\nA closing line that is long enough to count.", "en", "s", 10),
        (2, f"One line here. {PASSAGE}. And more of it.\nA closing line that is long enough to count.", "en", "s", 10),
        (2, f"One line here. {PASSAGE}. And more of it.\nA closing line that is long enough to count.", "en", "s", 10),
        (3, None, None, None, None),
        (4, "", "en", None, 0),
        (5, " \n\t ", "en", "s", 4),
        (6, "word", "en", "s", 4),
        (None, "Text of a row without an id. It has a second sentence, which is rather longer than the first one was.", "en", "s", 9),
        (7, "the " * 30_000, "en", "s", 120_000),
        (8, "x" * 60_000, "de", "s", 60_000),
        (9, "Straße und Öl, 価格は 100 円。 Ça coûte 5€ !!! | | |", "de", "s", 9),
        (10, "\n".join(f"Line {i} of a text that goes on for very many lines, each of them long." for i in range(400)), "en", "s", 9),
    ]
