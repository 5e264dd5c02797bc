"""Rows that every operator must take."""

#: Nulls, empty and blank texts, ties, repeated rows, one id with two texts, a very long text.
ODD_ROWS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (4, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (5, "one two three"),
    (6, "ONE two Three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"), (7, "a"), (7, "b"),
    (None, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (None, None),
    (8, "é" * 70_000 + " word" * 9_000), (9, "日本 😀 text with a few words\nand a line\r\nand another"),
]
