import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with what may go wrong: nulls, empty and long texts, ties, repeated rows and columns that clash."""
    long = "palabra " * 5000
    rows = [
        (0, "Hello  brave\tnew world of words", "en", 1), (1, "Hello brave new\nworld of words", "en", 2), (2, None, None, 3), (3, "", "en", 4), (4, " ", "fr", 5), (5, long, "es", 6), (6, long, "es", 7),
        (7, "write to a.b@example.com or +1 (555) 123-4567, card 4111 1111 1111 1111, from 10.0.0.1", "en", 8), (8, "12345 --- !!!", None, 9), (9, "Äpfel und Öl <|endoftext|> it's e\u0301t\u00e9\u2003x", "de", 10), (9, "Äpfel und Öl <|endoftext|> it's e\u0301t\u00e9\u2003x", "de", 10),
        (None, "no id here", "en", 11),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, digest int").withColumnRenamed("digest", "fp")
