"""Rows that operators must take."""

#: Nulls, empty and blank texts, repeated rows, one id twice, a long text.
ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one two three", "b"), (5, "one two three", "b"), (5, "one two three", "b"),
    (None, "some words here for nobody at all", None), (7, "long " * 30_000 + "end", "a"), (8, "x" * 200_000, "a"), (9, "ONE two\x0bthree", "c"), (10, "é中😀\0 \x1c", "c"),
]
