"""Rows with everything that can be odd about a document."""

ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (None, "only an id is missing here, the words are there", "en", "a", 47),
    (3, " \n\t ", "en", "a", 4),
    (4, "word", "en", None, 4),
    (5, "the same words in two rows " * 30, "en", "a", 780),
    (5, "the same words in two rows " * 30, "en", "a", 780),
    (6, "x" * 5_000, "zz", "b", 5_000),
    (7, "naïve café – €5 \U0001f600 end", "fr", "b", 24),
]
