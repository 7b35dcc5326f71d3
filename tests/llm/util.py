"""Texts with every awkward case, and the session's scratch."""

HARD = [
    (1, "Alpha beta gamma delta epsilon.\nA line that three documents hold in common.\nend", "en", "a", 1),
    (2, "Alpha beta gamma delta epsilon.\n  A LINE that three documents hold in common. \nother", "en", "a", 2),
    (3, "A line that three documents hold in common.", "fr", "b", 3),
    (4, None, None, None, None),
    (5, "", "en", "b", 0),
    (6, " \t\n ", "en", "b", 4),
    (7, "Alpha  beta\tgamma delta epsilon.\nA line that three documents hold in common.\nend", "en", "c", 5),
    (8, "word " * 30000, "de", "a", 6),
    (9, "É日本語 ñandú 🙂 \x0b x\r\ny z", None, "a", 7),
    (9, "É日本語 ñandú 🙂 \x0b x\r\ny z", None, "a", 7),
    (None, "no id at all", "en", None, 8),
    (10, "12345 678 !!", "en", "c", 9),
    (11, "x" * 5000, "en", "c", 10),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def hard(spark):
    """With columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(HARD, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("pos", "line", "n", "h1", "fp", "root", "piece", "start", "length", "score", "bucket", "key", "digest", "file", "row", "slot", "share", "word", "run", "dropped", "norm", "who")})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
