"""Small tables with the awkward rows every operator has to take."""

from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
SENTENCE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from their old oak tree at night"

DOCS = [
    (1, SENTENCE, "en", "a", 10),
    (2, SENTENCE, "en", "a", 10),
    (2, SENTENCE, "en", "a", 10),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, " \n\t ", "fr", "b", 3),
    (6, LONG, "en", "b", len(LONG)),
    (7, "ein wort", None, "c", 8),
    (8, SENTENCE + " indeed", "en", None, 0),
    (None, "no id here but words enough to make a few shingles of five", "en", "c", 1),
    (9, "Zeile eins\nZeile zwei\nZeile eins\n\nZeile eins é ü     😀", "de", "a", 5),
    (10, "a b c d e f g h " * 12, "en", "b", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows=None):
    """The rows, with extra columns whose names an operator might use itself."""
    df = spark.createDataFrame(DOCS if rows is None else rows, SCHEMA)
    return df.selectExpr("*", "1 as size", "'x' as rule", "2.0 as score", "3 as shard", "array(1) as words", "'y' as host")


#: Names that operators and stages give to columns of their own.
CLASHES = """_size _k _target _source_size _taken _copies _positions _position source_size n_words n_lines kept _g _s _x0 _lang _source _q_text _d _distance
    base_failed _base _added _sec_t hit row t all new mark keep _keep rule verdict name label component_id n_shingles id ids group part own_0 c0
    start length sequence_id offset doc_tokens width has_id slot shard _text""".split()


def clashing(spark, rows=None):
    """The rows with a column for each of those names."""
    return plain(spark, rows).select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


def plain(spark, rows=None):
    return spark.createDataFrame(DOCS if rows is None else rows, SCHEMA)


SMALL = "/root/testdata/sf0.01"
