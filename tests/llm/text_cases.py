"""Rows and helpers that the tests of the text operators share."""

#: Columns that clash with names the operators use or return.
CLASHING = ["kept", "text_digest", "mark", "match", "kept_text", "score", "n_tokens", "Secrets", "row_key", "rank"]

LONG = "palabra larga " * 30_000
EDGE = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r "),
    (None, "a row without an id"),
    (None, "a row without an id"),
    (4, "the same text"),
    (5, "the  same\ttext "),
    (5, "the  same\ttext "),
    (6, "the  same text  "),
    (7, LONG),
    (8, "A" * 200_000),
    (9, "é 中文 😀 İstanbul <|endoftext|> ſ K\x1c\x85 "),
    (10, "one two"),
    (11, "\n\nline\n LINE \nline\n"),
]


def key(values):
    return sorted(values, key=lambda row: tuple((v is None, v) for v in row))
