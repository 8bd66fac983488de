from __future__ import annotations

import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.functions.dates import date_text, free_date, parse_date, rfc3339, unread_share, with_free_dates
from corpusmill.operators.text_tables import remove_listed_words, sentence_chunks

STOP = ("the", "of", "и")


def values(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column(F.col("t")).alias("v")).collect()
    return [row["v"] for row in sorted(rows)]


TEXTS = ["The cat_sat  of 12, (34) on\tThe.", "  Привет и мир\n", "", "a", "12 12a", "the", "x  y", " 　z\xa0"]
TOKENS = [
    ["the", "cat", "sat", "", "of", "12,", "(34)", "on\tthe."],
    ["привет", "и", "мир"],
    [""],
    ["a"],
    ["12", "12a"],
    ["the"],
    ["x", "", "y"],
    ["z"],
]
STRIPPED = ["cat_sat  on\tThe.", "  Привет мир", "", "a", "12a", "", "x  y", " z"]


def test_tokenize_keeps_empty_tokens(spark):
    assert values(spark, TEXTS, X.tokenize) == TOKENS
    assert values(spark, ["a  b"], X.tokenize) == [["a", "", "b"]]


def test_strip_stopwords(spark):
    assert values(spark, TEXTS, lambda c: X.strip_stopwords(c, STOP)) == STRIPPED


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abC .,1_\néи", max_size=30), min_size=1, max_size=20))
def test_properties_of_tokens_and_stripped_texts(spark, texts):
    for given_, tokens in zip(texts, values(spark, texts, X.tokenize)):
        assert "_" not in "".join(tokens) and " ".join(tokens) == given_.strip().lower().replace("_", " ")
    for given_, left in zip(texts, values(spark, texts, lambda c: X.strip_stopwords(c, STOP))):
        kept, rest = left.split(), iter(given_.split(" "))
        # Words keep their order, and none of them is a stop word or a number once punctuation is off.
        assert all(any(w in piece for piece in rest) for w in left.split(" ") if w.strip())
        plain = [w.translate(str.maketrans("", "", string.punctuation)).lower() for w in kept]
        assert not any(w.isdigit() or w in STOP for w, whole in zip(plain, kept) if whole in given_.split(" "))


def test_clean_silo_replaces_separators(spark):
    assert values(spark, ["client:the dog", "a:b"], lambda c: X.clean_silo(c, [":", " "], STOP)) == ["client dog", "a b"]


def test_clean_stopper(spark):
    got = values(spark, [" The Dog,12,of cat 7"], lambda c: X.clean_stopper(c, [" ", ","], STOP))
    assert got == ["dog of cat"]


def test_replace_map_in_order(spark):
    column = lambda c: X.replace_map(F.split(c, " "), {"a": "b", "b": "c"})
    assert values(spark, ["a b x.y"], column) == [["c", "c", "x.y"]]


def test_blank(spark):
    assert values(spark, ["", " \n\t", "　", "x"], X.is_blank) == [True, True, True, False]


def test_ngrams(spark):
    column = lambda c: X.vocab_tokens(c, ("of",), (1, 2))
    assert values(spark, ["Alpha of beta gamma x", "of", "one"], column) == [
        ["alpha", "beta", "gamma", "alpha beta", "beta gamma"],
        [],
        ["one"],
    ]


def test_dates(spark):
    texts = ["2021-03-04 05:06:07", "03/04/2021", "2021-03-04", "4 Mar 2021", "nonsense", "31/31/2021"]
    assert values(spark, texts, lambda c: date_text(parse_date(c))) == [
        "04/03/2021 05:06:07",
        "04/03/2021 00:00:00",
        "04/03/2021 00:00:00",
        "04/03/2021 00:00:00",
        None,
        None,
    ]


FREE = {
    "2024-03-05": "05/03/2024 00:00:00",
    "2024-03-05T10:20:30Z": "05/03/2024 10:20:30",
    "5 March 2024": "05/03/2024 00:00:00",
    "March 5th, 2024 3:07 pm": "05/03/2024 15:07:00",
    "Tue, 5 Mar 2024 10:20:30 +0100": "05/03/2024 10:20:30",
    "5. März 2024 um 14:30 Uhr": "05/03/2024 14:30:00",
    "5 de marzo de 2024": "05/03/2024 00:00:00",
    "5 марта 2024 г.": "05/03/2024 00:00:00",
    "05.03.2024 10:00": "05/03/2024 10:00:00",
    "12.25.2024": "25/12/2024 00:00:00",
    "05/03/2024": "03/05/2024 00:00:00",
    "25/12/23": "25/12/2023 00:00:00",
    "20240305": "05/03/2024 00:00:00",
    "1709633400": "05/03/2024 10:10:00",
    "1709633400000": "05/03/2024 10:10:00",
    "Mar 2024": "01/03/2024 00:00:00",
    "12:00 am 1 jan 2000": "01/01/2000 00:00:00",
    "12 pm 1 jan 2000": "01/01/2000 12:00:00",
    "le 14 juillet 1999 à 14h30": "14/07/1999 14:30:00",
    "sept. 3, 98": "03/09/1998 00:00:00",
    "5 may": None,
    "31 Feb 2024": None,
    "jui 5 2024": None,
    "5 mar 2024 13 pm": None,
    "2024-03-05 25:00": None,
    "5*5*2024": None,
    "login 5 may 2024": None,
    "99999999999999999999": None,
    "": None,
    None: None,
}


def test_freely_spelled_dates(spark):
    assert dict(zip(FREE, values(spark, list(FREE), lambda c: date_text(free_date(c))))) == FREE
    assert values(spark, ["5 may", "05/03/2024"], lambda c: date_text(free_date(c, True, 2020))) == ["05/05/2020 00:00:00", "05/03/2024 00:00:00"]


def test_order_of_day_and_month_is_that_of_the_column(spark):
    def read(texts):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        return [r["d"] for r in with_free_dates(df, "t", "d").select(date_text(F.col("d")).alias("d")).collect()]

    assert read(["05/03/2024", "25/12/2024", "13/01/2024", "01/31/2024"])[0] == "05/03/2024 00:00:00"
    assert read(["05/03/2024", "12/25/2024", None, ""])[0] == "03/05/2024 00:00:00"
    assert read(["05/03/2024"]) == ["03/05/2024 00:00:00"]
    assert read([]) == []


def test_share_of_unread_dates(spark):
    df = spark.createDataFrame([(t,) for t in ["2024-03-05", "never", " ", None, "x"]], "t string")
    assert unread_share(df.withColumn("d", free_date(F.col("t"))), "t", "d").first() == (3, 2, 2 / 3)
    assert unread_share(df.where("false").withColumn("d", free_date(F.col("t"))), "t", "d").first() == (0, 0, 0.0)


def test_rfc3339(spark):
    texts = ["2021-03-04", "2021-03-04T05:06", "2021-03-04 05:06:07.5", "2021-03-04T05:06:07+03:00", "2021-13-04", "x"]
    assert values(spark, texts, rfc3339) == [
        "2021-03-04T00:00:00Z",
        "2021-03-04T05:06:00Z",
        "2021-03-04T05:06:07.500000Z",
        "2021-03-04T05:06:07+03:00",
        None,
        None,
    ]


def test_sentence_chunks(spark):
    df = spark.createDataFrame([(1, "One. Two!  Three?\nFour 3.5")], "id int, t string")
    assert [(r[1], r[2]) for r in sentence_chunks(df, "id", "t").collect()] == [(0, "One."), (1, "Two!"), (2, "Three?"), (3, "Four 3.5")]


def test_word_list_by_join_equals_literal_list(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    words = spark.createDataFrame([(w,) for w in STOP], "word string")
    joined = {r["id"]: r["t"] for r in remove_listed_words(df, "id", "t", words).collect()}
    assert joined == dict(enumerate(STRIPPED))
